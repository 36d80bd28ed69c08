"""SentencePiece encoding and decoding by a score-ordered agenda (operator 10).

Merge-type vocabularies: a text starts as single characters, and of all adjacent symbol
pairs whose concatenation is a piece the one of the best score (leftmost on ties) is merged
until none is left; characters that end up outside the vocabulary become byte pieces.
Distinct words of a batch are merged together: one row per word, the row's agenda is the
array of its adjacent pairs' ranks, and every round merges the best pair of every row. Words
over ``WIDE`` characters use a heap of pairs. Each new word's ids are compared with the
sentencepiece library in the same batch; where they differ the library's are taken and
counted (``n_disagreed``).

Defined results: null and empty text have the begin and end ids alone; rows are independent,
so repeated rows repeat; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.chunked import ChunkEncoder
from gridloom.llm.scratch import spread

SPACE = "▁"
WIDE = 40
NONE = np.int32(1 << 30)
#: Words in a generation of a worker's cache: two of them are about 50 MB, 700,000 took over 200.
KEPT_WORDS = 150_000


class MergeVocabulary:
    """Ranks of mergeable pairs of a merge-type model, and the agenda over them."""

    def __init__(self, model_file: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        lib = self.library
        size = lib.get_piece_size()
        special = [lib.is_unknown(i) or lib.is_control(i) or lib.is_byte(i) or lib.is_unused(i) for i in range(size)]
        texts = [lib.id_to_piece(i) for i in range(size)]
        self.byte_ids = {int(texts[i][3:5], 16): i for i in range(size) if lib.is_byte(i)}
        self.unknown = lib.unk_id()
        ids = {texts[i]: i for i in range(size) if not special[i]}
        self.local = any(SPACE in t.lstrip(SPACE) for t in ids)
        symbols = dict(ids)
        for text in ids:
            for char in text:
                symbols.setdefault(char, len(symbols) + size)
        self.size = size
        self.symbol = symbols
        self.by_point = np.full(0x110000, -1, dtype=np.int32)
        for char, i in symbols.items():
            if len(char) == 1:
                self.by_point[ord(char)] = i
        order = sorted((t for t in ids if len(t) > 1), key=lambda t: (-lib.get_score(ids[t]), ids[t]))
        self.merged = np.array([ids[t] for t in order], dtype=np.int32)
        self.span = max(symbols.values()) + 2
        pairs = {}
        for rank, text in enumerate(order):
            for cut in range(1, len(text)):
                a, b = symbols.get(text[:cut]), symbols.get(text[cut:])
                if a is not None and b is not None:
                    pairs[a * self.span + b] = rank
        self.pairs = pairs
        keys = np.array(sorted(pairs), dtype=np.int64)
        bits = max(4, int(len(keys) * 4).bit_length())
        self._bits, self._keys, self._ranks = bits, *self._table(keys, np.array([pairs[k] for k in keys.tolist()], dtype=np.int32), bits)

    @staticmethod
    def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    def _table(self, keys: np.ndarray, ranks: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Open addressing; ``_probes`` is the longest run of steps that any key needs."""
        table, values = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, NONE, dtype=np.int32)
        self._probes = 1
        for key, rank, slot in zip(keys.tolist(), ranks.tolist(), self._slot(keys, bits).tolist(), strict=True):
            step = 1
            while table[slot] >= 0:
                slot, step = (slot + 1) & ((1 << bits) - 1), step + 1
            table[slot], values[slot] = key, rank
            self._probes = max(self._probes, step)
        return table, values

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols, ``NONE`` where they don't merge; negative symbols never do."""
        keys = left.astype(np.int64) * self.span + right
        slot = self._slot(keys, self._bits)
        out = np.where(self._keys[slot] == keys, self._ranks[slot], NONE)
        open_ = np.flatnonzero((self._keys[slot] != keys) & (self._keys[slot] >= 0))
        mask = (1 << self._bits) - 1
        for step in range(1, self._probes):
            if not len(open_):
                break
            at = (slot[open_] + step) & mask
            found = self._keys[at] == keys[open_]
            out[open_[found]] = self._ranks[at[found]]
            open_ = open_[~found & (self._keys[at] >= 0)]
        return np.where((left < 0) | (right < 0), NONE, out)

    def _code(self, symbols: list[int], chars: str) -> list[int]:
        """Ids of the final symbols; ``chars`` are the word's characters outside the vocabulary, in order."""
        lost = iter(chars)
        out: list[int] = []
        for s in symbols:
            if 0 <= s < self.size:
                out.append(s)
            else:
                char = next(lost)
                out += [self.byte_ids[b] for b in char.encode()] if self.byte_ids else [self.unknown]
        return out

    def _heap(self, word: str) -> list[int]:
        """Agenda as a heap of (rank, place); for long words."""
        symbol = self.symbol
        ids = [symbol.get(c, -1) for c in word]
        text = list(word)
        before, after = list(range(-1, len(ids) - 1)), [*range(1, len(ids)), -1]
        agenda: list[tuple[int, int, int, int]] = []

        def push(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and ids[a] >= 0 and ids[b] >= 0 and (r := self.pairs.get(ids[a] * self.span + ids[b])) is not None:
                heapq.heappush(agenda, (r, a, ids[a], ids[b]))

        for i in range(len(ids) - 1):
            push(i, i + 1)
        gone = [False] * len(ids)
        while agenda:
            r, a, left, right = heapq.heappop(agenda)
            b = after[a]
            if gone[a] or b < 0 or ids[a] != left or ids[b] != right:
                continue
            ids[a], text[a], gone[b], after[a] = int(self.merged[r]), text[a] + text[b], True, after[b]
            if after[b] >= 0:
                before[after[b]] = a
            push(before[a], a)
            push(a, after[a])
        kept = [i for i in range(len(ids)) if not gone[i]]
        return self._code([ids[i] for i in kept], "".join(text[i] for i in kept if not 0 <= ids[i] < self.size))

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers; a word holds the space symbol instead of spaces."""
        out = [b""] * len(words)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        for i in np.flatnonzero(lengths > WIDE).tolist():
            out[i] = np.array(self._heap(words[i]), dtype="<u4").tobytes()
        narrow = np.argsort(lengths, kind="stable")
        narrow = narrow[lengths[narrow] <= WIDE]
        for at in range(0, len(narrow), 8192):
            part = narrow[at : at + 8192]
            own = [words[i] for i in part.tolist()]
            for i, code in zip(part.tolist(), self._merge(own, lengths[part]), strict=True):
                out[i] = code
        return out

    def _merge(self, words: list[str], lengths: np.ndarray) -> Iterator[bytes]:
        size, longest = self.size, int(lengths[-1])
        if not longest:
            return iter([b""] * len(words))
        flat = self.by_point[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        columns = np.arange(longest + 1)
        table = np.full((len(words), longest + 1), -2, dtype=np.int32)
        table[columns[None, :] < lengths[:, None]] = flat
        odd = np.flatnonzero(((table == -1) | (table >= size)).any(axis=1))
        ranks = self.rank(table[:, :-1].ravel(), table[:, 1:].ravel()).reshape(len(words), longest)
        rows = np.arange(len(words))
        final = np.empty_like(table)
        while len(rows):
            best = ranks.argmin(axis=1)
            every = np.arange(len(rows))
            least = ranks[every, best]
            live = least < NONE
            if not live.all():
                final[rows[~live]] = table[~live]
                rows, table, ranks, best, least = rows[live], table[live], ranks[live], best[live], least[live]
                if not len(rows):
                    break
                every = np.arange(len(rows))
            table[every, best] = self.merged[least]
            index = columns[None, :] + (columns[None, :] > best[:, None])
            np.minimum(index, longest, out=index)
            table = np.take_along_axis(table, index, axis=1)
            table[:, longest] = -2
            np.minimum(index, longest - 1, out=index)
            ranks = np.take_along_axis(ranks, index[:, :-1], axis=1)
            ranks[:, longest - 1] = NONE
            left = np.maximum(best - 1, 0)
            right = np.minimum(best + 1, longest)
            pairs = self.rank(np.concatenate([table[every, left], table[every, best]]), np.concatenate([table[every, best], table[every, right]]))
            ranks[every, best] = pairs[len(rows) :]
            first = best > 0
            ranks[every[first], left[first]] = pairs[: len(rows)][first]
        ends = np.cumsum((final != -2).sum(axis=1)) * 4
        blob = final[final != -2].astype("<u4").tobytes()
        codes = [blob[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        for i in odd.tolist():
            codes[i] = np.array(self._heap(words[i]), dtype="<u4").tobytes()
        return iter(codes)


class PieceEncoder:
    """Whole texts to ids as the library gives them, with begin and end ids."""

    def __init__(self, model_file: str, verify: bool = True):
        self.vocabulary = MergeVocabulary(model_file)
        if self.vocabulary.local:
            raise ValueError("pieces of this vocabulary join words; it can't be encoded word by word")
        self.verify, self.disagreed = verify, 0
        lib = self.vocabulary.library
        self._ends = np.array([lib.bos_id(), lib.eos_id()], dtype="<u4")
        # spaces stay as they are until a word is new: with the space symbol every text and word takes two bytes a character
        self._chunks = ChunkEncoder(f"[ {SPACE}]+[^ {SPACE}]*|[^ {SPACE}]+", self._words, KEPT_WORDS)

    def _words(self, words: list[str]) -> list[bytes]:
        words = [w.replace(" ", SPACE) for w in words]
        found = self.vocabulary.words(words)
        if self.verify:
            # one call for all words of one leading space symbol, run together; word by word where that differs
            plain = [i for i, w in enumerate(words) if len(w) > 1 and w[0] == SPACE and w[1] != SPACE]
            other = [i for i, w in enumerate(words) if len(w) > 1 and w[:2] == SPACE * 2]
            together = self.vocabulary.library.encode("".join([words[i] for i in plain])[1:])
            if np.array(together, dtype="<u4").tobytes() != b"".join([found[i] for i in plain]):
                other = plain + other
            for i in other:
                ids = self.vocabulary.library.encode(words[i][1:])
                if (code := np.array(ids, dtype="<u4").tobytes()) != found[i]:
                    self.disagreed += 1
                    found[i] = code
        return found

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        begin, end = self._ends[:1].tobytes(), self._ends[1:].tobytes()
        for code in self._chunks.encode([f" {t}" if t else "" for t in texts]):
            yield begin + code + end

    def decode(self, code: bytes) -> str:
        return self.vocabulary.library.decode(np.frombuffer(code, dtype="<u4").tolist())


_ENCODERS: dict[tuple[str, bool], PieceEncoder] = {}


def encoder(model_file: str, verify: bool = True) -> PieceEncoder:
    """One encoder per worker process and model."""
    key = (model_file, verify)
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(model_file, verify)
    return _ENCODERS[key]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(documents: DataFrame, model_file: str | None = None, with_ids: bool = True, verify: bool = True, rows: int = 256) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_disagreed (and ids, decoded): one row per document."""
    path = model_file or default_model()
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_disagreed long" + ", ids array<int>, decoded string" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, verify)
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                before = own.disagreed
                counts, sums, decoded, all_ids, all_text = [], [], [], [], []
                for code in own.encode(texts):
                    counts.append(len(code) // 4)
                    sums.append(hashlib.sha256(code).hexdigest())
                    text = own.decode(code)
                    decoded.append(hashlib.sha256(text.encode()).hexdigest())
                    if with_ids:
                        all_ids.append(np.frombuffer(code, dtype="<u4").astype(np.int32))
                        all_text.append(text)
                wrong = [own.disagreed - before] + [0] * (len(texts) - 1)
                columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(decoded, pa.string()), pa.array(wrong[: len(texts)], pa.int64())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_disagreed"]
                if with_ids:
                    columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_text, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return spread(own).mapInArrow(run, schema)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)
