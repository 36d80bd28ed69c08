"""Token-id files as directly addressable codes (operator 1).

An id is split into chunks of ``WIDTHS`` bits. Level 0 holds every token's lowest chunk;
a continuation bitmap marks the tokens that go on, and level l + 1 holds the next chunk of
just those. A rank directory (set bits before every ``BLOCK`` bits) turns a token's place in
one level into its place in the next, so any token or span is read without decoding what
precedes it. A file also holds its documents' ids and first tokens.

Documents are range-partitioned and sorted by doc_id; each task encodes its texts and writes
files of about ``file_tokens`` tokens under names of its own attempt, so a retried task
leaves earlier files unused. A manifest table names the files that count.

Defined results: null and empty text hold the end id alone; a null doc_id sorts first;
equal doc_ids stand together, in order of a hash of the text; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator
from operator import attrgetter
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.chunked import ChunkEncoder
from gridloom.llm.scratch import scratch_dir, written

if TYPE_CHECKING:
    from tokenizers import Tokenizer

MAGIC = b"DACTOKN1"
WIDTHS = (8, 8, 16)
BLOCK = 512
_DTYPES = {8: np.dtype("u1"), 16: np.dtype("<u2")}
_HEAD = struct.Struct("<8sQQQ")
_SECTION = struct.Struct("<QQ")


def _aligned(n: int) -> int:
    return (n + 7) & ~7


def build(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, continuation bits as bytes, rank directory) of each level."""
    levels = []
    rest = ids.astype(np.uint32)
    for i, width in enumerate(WIDTHS):
        chunks = (rest & np.uint32((1 << width) - 1)).astype(_DTYPES[width])
        rest = rest >> np.uint32(width)
        on = rest > 0 if i + 1 < len(WIDTHS) else np.zeros(0, dtype=bool)
        bits = np.packbits(on, bitorder="little")
        counts = np.add.reduceat(on, np.arange(0, len(on), BLOCK), dtype=np.uint64) if len(on) else np.zeros(0, dtype=np.uint64)
        directory = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(counts, dtype=np.uint64)]).astype("<u8")
        levels.append((chunks, bits, directory))
        rest = rest[on] if len(on) else rest[:0]
    return levels


def file_bytes(ids: np.ndarray, doc_ids: np.ndarray, known: np.ndarray, starts: np.ndarray) -> bytes:
    """A whole file: header, section table, then doc_ids, not-null flags, first tokens and the levels."""
    sections = [doc_ids.astype("<i8"), known.astype("u1"), starts.astype("<u8")]
    for level in build(ids):
        sections.extend(level)
    at = _HEAD.size + _SECTION.size * len(sections)
    table, parts = [], []
    for s in sections:
        at = _aligned(at)
        table.append(_SECTION.pack(at, s.nbytes))
        parts.append((at, s.tobytes()))
        at += s.nbytes
    out = bytearray(_aligned(at))
    out[: _HEAD.size] = _HEAD.pack(MAGIC, len(ids), len(doc_ids), len(sections))
    out[_HEAD.size : _HEAD.size + _SECTION.size * len(table)] = b"".join(table)
    for place, data in parts:
        out[place : place + len(data)] = data
    return bytes(out)


class Reader:
    """Random access to a file's tokens; reads only the bytes a request needs."""

    def __init__(self, file: pa.NativeFile):
        self._file = file
        magic, self.n_tokens, self.n_docs, count = _HEAD.unpack(self._at(0, _HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        table = self._at(_HEAD.size, _SECTION.size * count)
        self._sections = [_SECTION.unpack_from(table, i * _SECTION.size) for i in range(count)]

    def _at(self, offset: int, size: int) -> bytes:
        return self._file.read_at(size, offset)

    def _slice(self, section: int, dtype: np.dtype, first: int, last: int) -> np.ndarray:
        at, _ = self._sections[section]
        return np.frombuffer(self._at(at + first * dtype.itemsize, (last - first) * dtype.itemsize), dtype=dtype)

    def documents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = self.n_docs
        return self._slice(0, np.dtype("<i8"), 0, n), self._slice(1, np.dtype("u1"), 0, n) > 0, self._slice(2, np.dtype("<u8"), 0, n + 1).astype(np.int64)

    def _rank(self, level: int, place: int) -> int:
        """Set continuation bits before ``place``."""
        block = place // BLOCK
        before = int(self._slice(5 + 3 * level, np.dtype("<u8"), block, block + 1)[0])
        bits = self._slice(4 + 3 * level, np.dtype("u1"), block * BLOCK // 8, (place + 7) // 8)
        return before + int(np.unpackbits(bits, bitorder="little")[: place - block * BLOCK].sum())

    def tokens(self, first: int, last: int, level: int = 0) -> np.ndarray:
        """Ids of the tokens ``first`` to ``last`` (excluded)."""
        width = WIDTHS[level]
        out = self._slice(3 + 3 * level, _DTYPES[width], first, last).astype(np.uint32)
        if level + 1 < len(WIDTHS) and last > first:
            low = first // 8
            bits = np.unpackbits(self._slice(4 + 3 * level, np.dtype("u1"), low, (last + 7) // 8), bitorder="little")
            on = np.flatnonzero(bits[first - low * 8 : last - low * 8])
            if len(on):
                begin = self._rank(level, first)
                out[on] |= self.tokens(begin, begin + len(on), level + 1) << np.uint32(width)
        return out

    def __getitem__(self, place: int) -> int:
        return int(self.tokens(place, place + 1)[0])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Unicode white space: chunks start at a run of it, and byte-level pre-tokens never cross such a start.
_W = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_TEXT: dict[str, ChunkEncoder] = {}


#: A run of letters, perhaps after a space: one pre-token, which the model may take without the pre-tokenizer.
_LETTERS = "a-zA-ZÀ-ÖØ-öø-ɏ"


def byte_symbols() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: itself if printable in Latin-1, else the next of those from U+0100."""
    printable = [b for b in range(256) if chr(b).isprintable() and b != 0x20]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + i) for i, b in enumerate(sorted(set(range(256)) - set(printable)))}


def run_codes(library: Tokenizer) -> Callable[[list[str]], dict[str, bytes]] | None:
    """Codes of letter runs by a byte-level tokenizer's model alone; None for other tokenizers."""
    from tokenizers import pre_tokenizers

    if not isinstance(library.pre_tokenizer, pre_tokenizers.ByteLevel) or library.normalizer is not None:
        return None
    symbols = byte_symbols()
    table, mark = str.maketrans(symbols), symbols[0x0A]
    tokenize, own_id = library.model.tokenize, attrgetter("id")

    def codes(runs: list[str]) -> dict[str, bytes]:
        if not runs:
            return {}
        # all runs' bytes become symbols at once; no run holds a line break
        ids, ends = [], [0]
        for word in "\n".join(runs).encode().decode("latin-1").translate(table).split(mark):
            ids.extend(map(own_id, tokenize(word)))
            ends.append(4 * len(ids))
        data = array("I", ids).tobytes()
        return {c: data[a:b] for c, a, b in zip(runs, ends[:-1], ends[1:], strict=True)}

    return codes


def text_encoder(tokenizer: str) -> ChunkEncoder:
    """One encoder per worker process; the tokenizers library encodes each distinct chunk, runs of letters by its model alone."""
    if tokenizer not in _TEXT:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(tokenizer)
        library.encode_special_tokens = True
        run, of_runs = re.compile(f" ?[{_LETTERS}]+").fullmatch, run_codes(library)

        def encode(chunks: list[str]) -> list[bytes]:
            runs = set(filter(run, chunks)) if of_runs else set()
            out = of_runs(list(runs)) if of_runs else {}
            rest = [c for c in chunks if c not in runs]
            for c, e in zip(rest, library.encode_batch_fast(rest, add_special_tokens=False), strict=True):
                out[c] = array("I", e.ids).tobytes()
            return [out[c] for c in chunks]

        # a letter run before a space or ASCII mark (but the apostrophe) is a pre-token of its own
        letters = f" ?[{_LETTERS}]+(?=[ !-&(-/:-@\\[-`{{-~\n]|\\Z)"
        _TEXT[tokenizer] = ChunkEncoder(f"{letters}|[{_W}]*[^{_W}]+|[{_W}]+", encode)
    return _TEXT[tokenizer]


def write_files(documents: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 0, file_tokens: int = 4_000_000) -> DataFrame:
    """Writes the files and returns the manifest: part, file, path, n_docs, n_tokens."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        own = text_encoder(path)
        end = np.array([end_id], dtype="<u4").tobytes()
        codes: list[bytes] = []
        ids: list[int | None] = []
        held, number = 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, number
            sizes = np.fromiter(map(len, codes), dtype=np.int64, count=len(codes)) // 4
            starts = np.concatenate([[0], np.cumsum(sizes)])
            data = file_bytes(np.frombuffer(b"".join(codes), dtype="<u4"), np.array([i or 0 for i in ids], dtype=np.int64), np.array([i is not None for i in ids]), starts)
            name = f"{base}/part-{part:06d}-{number:06d}-{attempt}.dac"
            with system.open_output_stream(name) as out:
                out.write(data)
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "file": pa.array([number], pa.int64()), "path": [name], "n_docs": pa.array([len(ids)], pa.int64()), "n_tokens": pa.array([int(starts[-1])], pa.int64())})
            codes.clear()
            ids.clear()
            held, number = 0, number + 1
            return row

        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                for doc_id, code in zip(batch.column(0).to_pylist(), own.encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                    codes.append(code + end)
                    ids.append(doc_id)
                    held += len(code) // 4 + 1
                    if held >= file_tokens:
                        yield flush()
        if ids:
            yield flush()

    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = own.repartitionByRange(*keys).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return written(ordered.mapInArrow(run, "part long, file long, path string, n_docs long, n_tokens long"), "dac-manifest")


def placed(manifest: DataFrame) -> DataFrame:
    """The manifest with each file's ``start``: tokens of all files before it.

    Running sums within a part, and over one row per part; no window runs over all files.
    """
    inside = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("part_start", F.coalesce(F.sum("part_tokens").over(before), F.lit(0)))
    own = manifest.withColumn("file_start", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return own.join(parts, "part").select("part", "file", "path", "n_docs", "n_tokens", (F.col("part_start") + F.col("file_start")).alias("start"))


def read_files(manifest: DataFrame, folder: str, with_ids: bool = False, span: int = 1 << 20) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document in the files of a placed manifest."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with system.open_input_file(path) as file:
                    reader = Reader(file)
                    doc_ids, known, starts = reader.documents()
                    at = 0
                    while at < reader.n_docs:
                        end = max(at + 1, int(np.searchsorted(starts, starts[at] + span, side="right")) - 1)
                        tokens = reader.tokens(int(starts[at]), int(starts[end])).astype("<u4")
                        cuts = starts[at : end + 1] - starts[at]
                        own = [tokens[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                        columns = [
                            pa.array(doc_ids[at:end], mask=~known[at:end]), pa.array(starts[at:end] + start, pa.int64()),
                            pa.array(np.diff(cuts), pa.int64()), pa.array([zlib.crc32(t.data) for t in own], pa.int64()),
                        ]
                        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                        if with_ids:
                            columns.append(pa.array([t.astype(np.int32) for t in own], pa.list_(pa.int32())))
                            names.append("ids")
                        yield pa.RecordBatch.from_arrays(columns, names)
                        at = end

    files = manifest.select("path", "start").repartition(max(1, manifest.count()))
    return files.mapInArrow(run, schema)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "dac")
    manifest = placed(write_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder))
    return read_files(manifest, folder)
