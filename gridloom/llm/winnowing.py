"""Document fingerprints by winnowing (operator 8).

Rolling hashes of all ``GRAM``-character grams; in every window of ``WINDOW`` consecutive
grams the least hash is chosen, the rightmost of equals. Two texts that share a passage of
``WINDOW + GRAM - 1`` characters share a chosen hash, and chosen positions are kept to tell
where. Texts are hashed in pieces of ``PIECE`` characters with the overlap that keeps every
window whole, so memory doesn't follow the text's length.

The query compares each document with an edited text made of its own beginning and the next
document's beginning. Documents are dealt to ranges of doc_id whose bounds are ids present in
the table; a bound's document is sent to the range before it as well, so every document meets
its successor without a global window and without a second shuffle of texts.

Defined results: null text counts as empty; the empty text has no grams, an empty
fingerprint and likeness 1 to another empty text, 0 to others; a text shorter than a gram
is one gram; null doc_ids come first; equal doc_ids follow each other in text order; a table
of one row has itself as the next document; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.words import mix64

GRAM, WINDOW = 16, 32
PIECE = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_LOW = np.uint64(0xFFFFFFFF)
_SHIFT = np.uint64(32)


def gram_hashes(points: np.ndarray, gram: int) -> np.ndarray:
    """32-bit hashes of all grams; ``gram`` doubles from 1, the last step overlaps if it is no power of two."""
    h = mix64(points.astype(np.uint64) + np.uint64(0x632BE5AB))
    width = 1
    while width < gram:
        step = min(width, gram - width)
        base = np.uint64(pow(_BASE, step, 1 << 64))
        h = h[: len(h) - step] * base + h[step:]
        width += step
    return mix64(h) >> _SHIFT


def winnow(text: str, gram: int = GRAM, window: int = WINDOW, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) chosen from ``text``, in order of position."""
    if not text:
        return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
    gram = min(gram, len(text))
    grams = len(text) - gram + 1
    window = min(window, grams)
    found = []
    for at in range(0, grams - window + 1, piece):
        end = min(at + piece + window - 1, grams)
        points = np.frombuffer(text[at : end + gram - 1].encode("utf-32-le", "surrogatepass"), dtype="<u4")
        key = (gram_hashes(points, gram) << _SHIFT) | (_LOW - np.arange(at, end, dtype=np.uint64))
        width = 1
        while width < window:
            step = min(width, window - width)
            key = np.minimum(key[: len(key) - step], key[step:])
            width += step
        found.append(key[np.concatenate([[True], key[1:] != key[:-1]])])
    keys = np.concatenate(found)
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    return (keys >> _SHIFT).astype(np.uint32), (_LOW - (keys & _LOW)).astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared share of two sorted sets of hashes."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def as_text(hashes: np.ndarray) -> str:
    """Fixed-width lower-case hex of the hashes in order of position."""
    return hashes.astype(">u4").tobytes().hex()


def fingerprints(documents: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """doc_id, fingerprint, hashes, positions of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [winnow(t or "", gram, window) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([as_text(h) for h, _ in found], pa.string()), pa.array([h.astype(np.int64) for h, _ in found], pa.list_(pa.int64())), pa.array([p for _, p in found], pa.list_(pa.int64()))],
                ["doc_id", "fingerprint", "hashes", "positions"],
            )

    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, fingerprint string, hashes array<long>, positions array<long>")


def _part(bounds: list[int], key: Column) -> Column:
    """Number of bounds at or below the key, by a coarse and a fine search; nulls go to part 0."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    fine = F.array(*[F.lit(b).cast("long") for b in bounds])
    coarse = F.array(*[F.lit(b).cast("long") for b in bounds[::step]])
    block = F.size(F.filter(coarse, lambda b: b <= key))
    first = F.greatest(block - 1, F.lit(0)) * step
    inside = F.size(F.filter(F.slice(fine, first + 1, F.lit(step)), lambda b: b <= key))
    return F.coalesce(F.when(block > 0, first + inside).otherwise(F.lit(0)), F.lit(0)).cast("int")


def beside_next(documents: DataFrame, parts: int) -> DataFrame:
    """Rows (part, doc_id, text, last) such that within a part, in order, every row that is not ``last`` is followed by its successor."""
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cuts = [i / parts for i in range(1, parts)] or [0.5]
    stats = own.agg(F.percentile_approx("doc_id", F.array(*[F.lit(c) for c in cuts]), 10_000).alias("cuts"), F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("nulls")).first()
    nulls = bool(stats["nulls"])
    bounds = sorted({c for c in stats["cuts"] or [] if nulls or c > stats["least"]}) if parts > 1 else []
    firsts = own.where(F.col("doc_id").isin([*bounds, *([] if nulls or stats["least"] is None else [stats["least"]])]) | (F.col("doc_id").isNull() & F.lit(nulls)))
    firsts = firsts.groupBy("doc_id").agg(F.min("text").alias("text"))
    start = F.col("doc_id").isNull() if nulls else F.col("doc_id").eqNullSafe(F.lit(stats["least"]).cast("long"))
    before = F.when(start, F.lit(len(bounds))).otherwise(_part(bounds, F.col("doc_id")) - 1).cast("int")
    follow = firsts.select(before.alias("part"), "doc_id", "text", F.lit(True).alias("last"))
    rows = own.select(_part(bounds, F.col("doc_id")).alias("part"), "doc_id", "text", F.lit(False).alias("last")).unionByName(follow)
    return rows.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", "last", F.col("doc_id").asc_nulls_first(), "text")


def compare_edited(documents: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and the fingerprint's positions of every document."""
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, positions array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                out = []
                for part, doc_id, text, last in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    hashes, places = winnow(text, gram, window)
                    distinct = np.unique(hashes)
                    if held is not None and held[0] == part:
                        _, own_id, own, own_hashes, own_places, own_distinct = held
                        half = len(own) // 2
                        edited = own[: len(own) - half] + text[:half]
                        edited_hashes = own_hashes if edited == own else winnow(edited, gram, window)[0]
                        digest = hashlib.sha256(edited.encode()).hexdigest()
                        out.append((own_id, len(own), digest, as_text(own_hashes), as_text(edited_hashes), likeness(own_distinct, np.unique(edited_hashes)), likeness(own_distinct, distinct), own_places))
                    held = None if last else (part, doc_id, text, hashes, places, distinct)
                if out:
                    columns = list(zip(*out, strict=True))
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.int64())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "positions"])

    return beside_next(documents, parts).mapInArrow(run, schema)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
