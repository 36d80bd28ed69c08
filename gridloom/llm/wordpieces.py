"""Greedy word-piece lengths by a linear longest-match automaton (operator 6).

The vocabulary is a trie over bytes with two roots: pieces that begin a word and pieces that
continue one. Every trie node has a failure link and the number of pieces that following it
pops, both computed ahead from the root down: a node that is a piece pops one and falls to
the continuation root; any other takes its parent's link and follows links from there until
the byte can go on. A word is then read once, byte by byte, adding up popped counts: no
piece is built and no prefix is tried twice. A word that can't be split is one unknown token.

Counts of distinct words are kept in a worker's memo of bounded size; words over
``LONGEST`` bytes are counted each time.

Defined results: null and blank texts have no words and no tokens; rows are independent;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.scratch import spread

MEMO, LONGEST, PIECE = 400_000, 64, 1 << 20
_PART = re.compile(rb"[^\x20\x09-\x0d]+")


class Automaton:
    """Trie of ``starts`` and ``follows`` (byte strings) with failure links and popped counts."""

    def __init__(self, starts: Iterable[bytes], follows: Iterable[bytes]):
        self.next: list[dict[int, int]] = [{}, {}]
        self.final = [False, False]
        for root, words in ((0, starts), (1, follows)):
            for word in words:
                node = root
                for byte in word:
                    after = self.next[node].get(byte)
                    if after is None:
                        after = self.next[node][byte] = len(self.next)
                        self.next.append({})
                        self.final.append(False)
                    node = after
                if word:
                    self.final[node] = True
        self.fail = [-1] * len(self.next)
        self.pops = [0] * len(self.next)
        queue = [0, 1]
        for parent in queue:
            for byte, node in self.next[parent].items():
                if self.final[node]:
                    self.fail[node], self.pops[node] = 1, 1
                else:
                    at, popped = self.fail[parent], self.pops[parent]
                    while at >= 0 and byte not in self.next[at]:
                        popped += self.pops[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[node], self.pops[node] = self.next[at][byte], popped
                queue.append(node)

    def count(self, word: bytes) -> int:
        """Number of greedy longest-match pieces of a word; 1 if it can't be split."""
        next_, fail, pops = self.next, self.fail, self.pops
        node = total = 0
        for byte in word:
            after = next_[node].get(byte)
            while after is None:
                total += pops[node]
                node = fail[node]
                if node < 0:
                    return 1
                after = next_[node].get(byte)
            node = after
        while node != 1:
            total += pops[node]
            node = fail[node]
            if node < 0:
                return 1
        return total


class _Memo(dict):
    def __init__(self, automaton: Automaton):
        self._automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self._automaton.count(word)
        if len(word) <= LONGEST:
            if len(self) >= MEMO:
                self.clear()
            self[word] = n
        return n


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes are themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def vocabulary(path: str) -> tuple[list[bytes], list[bytes]]:
    """(word-initial pieces, continuing pieces) of a byte-level vocabulary file.

    Tokens that begin with a space begin words; the others continue them. Single bytes do both.
    """
    with open(path, encoding="utf-8") as file:
        tokens = json.load(file)["model"]["vocab"]
    alphabet = byte_alphabet()
    raw = [bytes(alphabet[c] for c in t) for t in tokens if all(c in alphabet for c in t)]
    space = _PART.fullmatch
    starts = [t[1:] for t in raw if t[:1] == b" " and space(t[1:])]
    follows = [t for t in raw if space(t)]
    return sorted({*starts, *(t for t in follows if len(t) == 1)}), sorted(set(follows))


_MEMOS: dict[str, _Memo] = {}


def memo(path: str) -> _Memo:
    if path not in _MEMOS:
        _MEMOS[path] = _Memo(Automaton(*vocabulary(path)))
    return _MEMOS[path]


def count_text(text: str, memo_: _Memo) -> tuple[int, int]:
    """(words, tokens) of a text; long texts a piece at a time."""
    data = text.encode("utf-8", "surrogatepass")
    if len(data) <= PIECE:
        words = data.split()
        return len(words), sum(map(memo_.__getitem__, words))
    n = total = 0
    for m in _PART.finditer(data):
        n += 1
        total += memo_[m[0]]
    return n, total


def token_counts(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens of every whole text."""
    own_path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = memo(own_path)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                counts = [count_text(t or "", known) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c[0] for c in counts], pa.int64()), pa.array([c[1] for c in counts], pa.int64())], ["doc_id", "n_words", "n_tokens"])

    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return spread(own).mapInArrow(run, "doc_id long, n_words long, n_tokens long")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
