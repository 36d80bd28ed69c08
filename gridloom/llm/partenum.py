"""N-gram Jaccard join by PartEnum signatures (operator 2).

Sets of word shingles are put into bands of size in which every two sets of at least the
asked likeness lie in the same or the next band, and for which that likeness bounds the
number of differing elements by k. The shingle domain is hashed into ``k + 1 + spare`` parts;
of the subsets of parts that are enumerated (one of each pair of parts), sets that differ in
at most k elements agree on ``spare + 1`` at least. A signature is the hash of a set's
elements in one such subset.

Signatures that say little are left out without losing a link. Any subset of the domain
keeps the bound k, so shingles that a bounded sample shows to be common are not hashed. A set
with at most ``spare`` empty parts shares a part that is not empty with all it links with, so
empty parts are not signed; sets with more also sign their parts of the whole domain. And a
set must share ``spare + 1 - empty`` signatures in all, so sets that share fewer drop out.

Steps: (1) a pass gives every document its set's digest; (2) a pass sends signatures, packed
by bucket and of copies that a task has seen already none, and keeps those that two sets share; (3) sets that share
too few drop out and the rest are connected to clusters; (4) the documents that represent a
set of a cluster are read again and the cluster is compared by exact counts in one task; of
larger clusters every block meets a few leaders first, and only what is not connected with
most of the cluster is compared with all of it, block by block; (5) components over
representatives; (6) every document takes its set's component.

Exact and whole: no bucket is capped, and pairs within a group of copies are never formed.

Defined results: null or blank text has no shingles, links with nothing and is its own
component; fewer words than a shingle make one shingle; repeated rows and equal texts share
a component; rows of null doc_id have null component unless linked to a known one; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import contextlib
import functools
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.scratch import BROADCAST_IDS, beside, discard, spread, without, written
from gridloom.llm.words import hashed_texts, mix64, shingles
from gridloom.operators.graph import components

SEEN = 1 << 17
BLOCK_ROWS, BLOCK_BYTES = 512, 8 << 20
#: A shingle is common when ``COMMON_ROWS`` of about ``SAMPLE_ROWS`` sampled documents hold it; which ones are
#: taken for common changes the cost alone, never a link.
SAMPLE_ROWS, COMMON_ROWS = 8192, 8
LEADERS = 8
#: Elements of a block that are matched at a time.
RANGE_ITEMS = 1 << 17
#: Signatures that a task packs at a time, and those of a bucket, about.
PACKED_SIGNATURES, BUCKET_SIGNATURES = 1 << 19, 1 << 17
#: Bytes of the batches that go to Python, which an executor's JVM and its worker both hold.
BATCH_BYTES = "4m"


@dataclass(frozen=True)
class Join:
    """Shingles of ``n`` words; sets link when their Jaccard likeness is at least num / den."""

    n: int = 5
    num: int = 80
    den: int = 100
    spare: int = 8  # parts beyond the least number: one and another for each ``spare`` differences

    @functools.cached_property
    def bands(self) -> np.ndarray:
        """Largest size of each band, for sets of up to 2**40 elements."""
        ends, low = [], 1
        while low < 1 << 40:
            ends.append(low * self.den // self.num)
            low = ends[-1] + 1
        return np.array(ends, dtype=np.int64)

    def signatures(self, items: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(signatures, roles) of a set, for its own band and the next.

        A role tells a set's signatures of one band and domain apart and holds how many of them it must share.
        """
        band = int(np.searchsorted(self.bands, len(items)))
        rare = items
        if len(common):
            rare = items[common[np.minimum(np.searchsorted(common, items), len(common) - 1)] != items]
        found = [part for turn in (0, 1) for part in self._of_band(items, rare, band + turn, turn)]
        return np.concatenate([s for s, _ in found]), np.concatenate([np.full(len(s), role, dtype=np.int32) for s, role in found])

    def _of_band(self, items: np.ndarray, rare: np.ndarray, band: int, turn: int) -> Iterator[tuple[np.ndarray, int]]:
        # sizes a, b <= most and intersection >= num/den of the union: they differ in at most k elements
        k = (self.den - self.num) * 2 * int(self.bands[band]) // (self.den + self.num)
        spare = 1 + k // self.spare
        for domain, own in enumerate((rare, items)):
            codes, held = _parts(own, k + 1 + spare, 2 * band + domain)
            empty = len(held) - int(held.sum())
            few = empty <= spare
            yield codes[held] if few or domain == 0 else codes, turn + 2 * domain + 4 * (spare + 1 - empty if few else 1)
            if few:
                return


def _parts(items: np.ndarray, count: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of the elements in each of ``count`` parts, and which parts hold any."""
    part = (mix64(items ^ np.uint64(salt + 1)) % np.uint64(count)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    running = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix64(items + np.uint64(0x51ED270B))[order], dtype=np.uint64)])
    ends = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=count))])
    place = np.arange(count, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt << 20)
    return mix64(mix64(place) + np.diff(running[ends])), np.diff(ends) > 0


def _digest(items: np.ndarray) -> tuple[int, int]:
    low = np.sum(mix64(items ^ np.uint64(0xA5A5A5A5)), dtype=np.uint64)
    return int(mix64(np.array([low ^ np.uint64(len(items))]))[0].astype(np.int64)), int(np.sum(mix64(items + np.uint64(0x1234567)), dtype=np.uint64).astype(np.int64))


def _texts(documents: DataFrame) -> DataFrame:
    return spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def digests(documents: DataFrame, join: Join) -> DataFrame:
    """doc_id, n_shingles, k1, k2 (the set's digest) of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                ids, rows = batch.column(0).to_pylist(), []
                for i, words in hashed_texts(batch.column(1)):
                    items = shingles(words, join.n)
                    rows.append((ids[i], len(items), *(_digest(items) if len(items) else (None, None))))
                yield _batch(rows, schema)

    return _texts(documents).mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long")


def common_shingles(documents: DataFrame, rows: int, join: Join) -> np.ndarray:
    """Shingles that ``COMMON_ROWS`` documents of a sample hold, sorted; the sample is by hash of doc_id, about ``SAMPLE_ROWS`` rows.

    At most the sample's shingles / ``COMMON_ROWS`` come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, words in hashed_texts(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(words, join.n).view(np.int64))], ["item"])

    step = max(1, rows // SAMPLE_ROWS)
    chosen = documents.where(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(step)) == 0).select(F.col("text").cast("string").alias("text"))
    counted = chosen.mapInArrow(run, "item long").groupBy("item").count().where(F.col("count") >= COMMON_ROWS)
    return np.sort(np.array([r["item"] for r in counted.select("item").collect()], dtype=np.int64).view(np.uint64))


def bucket_count(shingles_: int, join: Join) -> int:
    """Buckets for the signatures of sets with so many elements in all, about ``BUCKET_SIGNATURES`` in each; any count gives the same rows."""
    differing = 2 * (join.den - join.num) / (join.den + join.num)
    return 1 + min(1 << 24, int(2.2 * differing * (1 + 1 / join.spare) * shingles_) // BUCKET_SIGNATURES)


def _packed(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], buckets: int) -> pa.RecordBatch:
    """(bucket, sigs, keys, roles): a row for each bucket that the signatures meet, its columns as bytes."""
    sigs, keys, roles = (np.concatenate(x) for x in zip(*held, strict=True))
    bucket = ((sigs >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    ends = np.append(starts, len(order))
    blobs = lambda x: pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((ends * x.itemsize).astype(np.int32)), pa.py_buffer(x[order])])
    return pa.RecordBatch.from_arrays([pa.array(bucket[starts]), blobs(sigs.view(np.int64)), blobs(keys), blobs(roles)], ["bucket", "sigs", "keys", "roles"])


def _unpacked(column: pa.Array, kind: type) -> np.ndarray:
    """A copy of the numbers in a column of bytes, row after row."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]].copy().view(kind)


def _of_two(sigs: np.ndarray, keys: np.ndarray, roles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The signatures that two keys share, once for each key, in order."""
    order = np.argsort(sigs)
    same = np.diff(sigs[order]) == 0
    order = order[np.append(same, False) | np.append(False, same)]
    order = order[np.lexsort((keys[order], sigs[order]))]
    first = np.ones(len(order), dtype=bool)
    first[1:] = (np.diff(sigs[order]) != 0) | (np.diff(keys[order]) != 0)
    order = order[first]
    same = np.diff(sigs[order]) == 0
    order = order[np.append(same, False) | np.append(False, same)] if len(order) else order
    return sigs[order], keys[order], roles[order]


def shared_signatures(documents: DataFrame, join: Join, common: np.ndarray, buckets: int = 1) -> DataFrame:
    """(sig, k1, role): the signatures that two sets share, once for each set.

    Signatures travel packed by bucket (their upper bits): as rows they would fill an executor's heap.
    """
    schema = pa.schema([("sig", pa.int64()), ("k1", pa.int64()), ("role", pa.int32())])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        held, n = [], 0
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                for _, words in hashed_texts(whole.column(0).slice(at, 128)):
                    items = shingles(words, join.n)
                    if not len(items) or (key := _digest(items)) in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(key)
                    own, role = join.signatures(items, common)
                    held.append((own, np.full(len(own), key[0], dtype=np.int64), role))
                    n += len(own)
                    if n >= PACKED_SIGNATURES:
                        yield _packed(held, buckets)
                        held, n = [], 0
        if n:
            yield _packed(held, buckets)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows are in order of their bucket; the last bucket of a batch may go on in the next one
        held, last = [], None
        found = lambda: pa.RecordBatch.from_arrays([pa.array(x) for x in _of_two(*(np.concatenate(x) for x in zip(*held, strict=True)))], schema=schema)
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = np.asarray(batch.column(0))
            cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
            for a, b in itertools.pairwise(cuts):
                if held and bucket[a] != last:
                    yield found()
                    held = []
                last = bucket[a]
                held.append(tuple(_unpacked(batch.column(i).slice(a, b - a), kind) for i, kind in ((1, np.int64), (2, np.int64), (3, np.int32))))
        if held:
            yield found()

    sent = _texts(documents).select("text").mapInArrow(sign, "bucket int, sigs binary, keys binary, roles binary").repartition("bucket").sortWithinPartitions("bucket")
    return written(sent.mapInArrow(shared, "sig long, k1 long, role int"), "shared")


def clusters(shared: DataFrame) -> DataFrame:
    """(node, component) over digests k1: sets that share enough signatures with others, connected by those."""
    enough = shared.groupBy("k1", "role").agg(F.count("*").alias("n")).where(F.col("n") >= F.shiftright("role", 2)).select("k1", "role")
    rows = written(shared.join(enough, ["k1", "role"], "left_semi").select("sig", "k1"), "enough")
    first = rows.groupBy("sig").agg(F.min("k1").alias("v"))
    edges = rows.join(first, "sig").where(F.col("k1") != F.col("v")).select(F.col("k1").alias("u"), "v").distinct()
    return components(edges)


def sets_of(documents: DataFrame, wanted: DataFrame, rows: int, join: Join) -> DataFrame:
    """(rep, k1, k2, items): the shingle sets of at most ``rows`` wanted documents, as bytes; of rows with one doc_id, those of the wanted set.

    A task gives a set once; other tasks may repeat it if the documents' rows do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[tuple[int, int, int]] = set()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                reps, k1, k2 = (batch.column(i).to_pylist() for i in (0, 2, 3))
                rows = []
                for i, words in hashed_texts(batch.column(1)):
                    items = shingles(words, join.n)
                    key = (reps[i], k1[i], k2[i])
                    if len(items) and key not in given and _digest(items) == key[1:]:
                        rows.append((*key, items.tobytes()))
                        if len(given) >= SEEN:
                            given.clear()
                        given.add(key)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["rep", "k1", "k2", "items"])

    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    read = own.join(beside(wanted, rows, BROADCAST_IDS), F.col("doc_id") == F.col("rep")).select("rep", "text", "k1", "k2")
    return read.mapInArrow(run, "rep long, k1 long, k2 long, items binary")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, size of the intersection) for all pairs of left and right sets (sorted) that share an element.

    Elements are taken by ranges of about ``RANGE_ITEMS`` in all, so the memory beside the sets and the counts does not grow with them.
    """
    counts = np.zeros((len(left), len(right)), dtype=np.float32)
    ranges = 1 + sum(len(s) for s in (*left, *right)) // RANGE_ITEMS
    ends = np.arange(1, ranges, dtype=np.uint64) * np.uint64(((1 << 64) - 1) // ranges)
    cuts = lambda sets: [np.concatenate([[0], np.searchsorted(s, ends), [len(s)]]) for s in sets]
    cuts_a = cuts(left)
    cuts_b = cuts_a if right is left else cuts(right)
    for k in range(ranges):
        _count([s[c[k] : c[k + 1]] for s, c in zip(left, cuts_a, strict=True)], [s[c[k] : c[k + 1]] for s, c in zip(right, cuts_b, strict=True)], counts)
    i, j = np.nonzero(counts)
    return i, j, counts[i, j].astype(np.int64)


def _count(left: list[np.ndarray], right: list[np.ndarray], counts: np.ndarray) -> None:
    """Adds the sizes of the intersections to ``counts``."""
    a, b = np.concatenate(left), np.concatenate(right)
    values, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    pa_, pb = place[: len(a)], place[len(a) :]
    # elements that only one side has can't count
    both = np.zeros(len(values), dtype=bool)
    both[pa_] = True
    right_has = np.zeros(len(values), dtype=bool)
    right_has[pb] = True
    number = np.cumsum(both & right_has) - 1
    both &= right_has
    owner_a, owner_b = np.repeat(np.arange(len(left)), [len(s) for s in left]), np.repeat(np.arange(len(right)), [len(s) for s in right])
    keep_a, keep_b = both[pa_], both[pb]
    width = int(both.sum())
    cols_a, rows_a = number[pa_[keep_a]], owner_a[keep_a]
    cols_b, rows_b = number[pb[keep_b]], owner_b[keep_b]
    order_a, order_b = np.argsort(cols_a, kind="stable"), np.argsort(cols_b, kind="stable")
    cols_a, rows_a, cols_b, rows_b = cols_a[order_a], rows_a[order_a], cols_b[order_b], rows_b[order_b]
    # products of 0/1 matrices over 1024 elements at a time; counts below 2**24 are exact in float32
    for at in range(0, width, 1024):
        sa, ea = np.searchsorted(cols_a, (at, at + 1024))
        sb, eb = np.searchsorted(cols_b, (at, at + 1024))
        span = min(1024, width - at)
        x, y = np.zeros((len(left), span), dtype=np.float32), np.zeros((len(right), span), dtype=np.float32)
        x[rows_a[sa:ea], cols_a[sa:ea] - at] = 1
        y[rows_b[sb:eb], cols_b[sb:eb] - at] = 1
        counts += x @ y.T


def linked(reps: np.ndarray, sets: list[np.ndarray], sides: np.ndarray, join: Join) -> list[tuple[int, int]]:
    """A spanning forest of the links within a block (all sides 0) or between two blocks."""
    first, second = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
    if not len(second):
        second = first
    if not len(first) or not len(second):
        return []
    sizes = np.array([len(s) for s in sets])
    own = [sets[k] for k in first]
    i, j, shared = overlaps(own, own if second is first else [sets[k] for k in second])
    a, b = first[i], second[j]
    ok = (a != b) & (join.den * shared >= join.num * (sizes[a] + sizes[b] - shared))
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    forest = []
    for x, y in zip(a[ok].tolist(), b[ok].tolist(), strict=True):
        p, q = root(x), root(y)
        if p != q:
            parent[p] = q
            forest.append((int(reps[x]), int(reps[y])))
    return forest


def _compared(rows: DataFrame, by: list[str], join: Join) -> DataFrame:
    """(u, v): a forest of the links within each group of rows (rep, k1, k2, side, items), or between its two sides."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        own = group.drop_duplicates(["rep", "k1", "k2"])
        found = linked(own["rep"].to_numpy(), [np.frombuffer(s, dtype=np.uint64) for s in own["items"]], own["side"].to_numpy(), join)
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    return rows.groupBy(*by).applyInPandas(run, "u long, v long")


def links(documents: DataFrame, groups: DataFrame, join: Join) -> DataFrame:
    """(u, v): links between representatives that connect all that are linked within a cluster (grp, rep, k1, k2, c, most)."""
    groups = written(groups.withColumn("block", F.least(F.lit(BLOCK_ROWS), F.greatest(F.lit(8), F.floor(F.lit(BLOCK_BYTES // 8) / F.col("most")))).cast("int")), "groups")
    keys = ["rep", "k1", "k2"]
    n = groups.count()
    small = groups.where("c <= block").select("grp", *keys)
    loaded = sets_of(documents, small.select(*keys), n, join).join(beside(small, n, BROADCAST_IDS), keys)
    out = _compared(loaded.withColumn("side", F.lit(0)), ["grp"], join)
    large = groups.where("c > block")
    if large.isEmpty():
        return out
    sets = written(sets_of(documents, large.select(*keys), n, join).dropDuplicates(keys), "sets")
    own = F.pmod(F.xxhash64("k1", "k2"), F.ceil(F.col("c") / F.col("block"))).cast("int")
    dealt = written(large.select("grp", *keys, "c", "block", own.alias("x")), "dealt")
    # every block meets the leaders of its cluster
    turn = F.xxhash64("k2", "k1")
    leaders = dealt.groupBy("grp").agg(F.min("c").alias("c"), F.min("block").alias("block"), F.slice(F.sort_array(F.collect_set(F.when(F.pmod(turn, F.ceil(F.col("c") / F.lit(4 * LEADERS))) == 0, F.struct(turn.alias("t"), *keys)))), 1, LEADERS).alias("leader"))
    every = F.explode(F.sequence(F.lit(0), F.ceil(F.col("c") / F.col("block")).cast("int") - 1)).alias("x")
    led = leaders.select("grp", "c", "block", F.explode("leader").alias("l")).select("grp", *[F.col(f"l.{k}").alias(k) for k in keys], every, F.lit(1).alias("side"))
    met = dealt.select("grp", *keys, "x", F.lit(0).alias("side")).unionByName(led)
    first = written(_compared(met.join(sets, keys), ["grp", "x"], join), "led")
    joined = written(dealt.join(components(first), F.col("rep") == F.col("node"), "left").select("grp", *keys, "c", "block", F.coalesce("component", "rep").alias("part")), "parts")
    # what is not in its cluster's largest part is compared with all of the cluster
    sizes = joined.groupBy("grp", "part").agg(F.count("*").alias("n"), F.min("c").alias("c"))
    most = sizes.groupBy("grp").agg(F.max_by("part", F.struct("n", "part")).alias("most_part"), F.max("n").alias("main"), F.min("c").alias("c"))
    placed = joined.join(most.select("grp", "most_part", "main"), "grp")
    is_main = F.col("part") == F.col("most_part")
    rest_blocks = F.ceil((F.col("c") - F.col("main")) / F.col("block")).cast("int")
    main_blocks = F.ceil(F.col("main") / F.col("block")).cast("int")
    deal = lambda blocks: F.pmod(F.xxhash64("k1", "k2"), F.greatest(blocks, F.lit(1))).cast("int")
    own = F.when(is_main, rest_blocks + deal(main_blocks)).otherwise(deal(rest_blocks))
    others = F.when(is_main, F.when(rest_blocks > 0, F.sequence(F.lit(0), rest_blocks - 1))).otherwise(F.sequence(F.lit(0), rest_blocks + main_blocks - 1))
    pairs = placed.select("grp", *keys, own.alias("own"), F.explode(others).alias("other"))
    pairs = pairs.select("grp", *keys, F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"))
    second = _compared(pairs.join(sets, keys), ["grp", "x", "y"], join)
    return out.unionByName(first).unionByName(second)


@contextlib.contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of at most about ``BATCH_BYTES`` go to Python meanwhile."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def jaccard_classes(documents: DataFrame, join: Join) -> DataFrame:
    """doc_id, n_shingles, class_id (least doc_id with the same set), component_id."""
    with _small_batches(documents.sparkSession):
        return _jaccard_classes(documents, join)


def _jaccard_classes(documents: DataFrame, join: Join) -> DataFrame:
    """All that runs Python is written before it returns."""
    table = written(digests(documents, join), "digests")
    size = table.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("shingles")).first()
    common = common_shingles(documents, size["rows"], join)
    classes = written(table.where("n_shingles > 0").groupBy("k1", "k2", F.col("n_shingles").alias("n")).agg(F.min("doc_id").alias("rep")), "classes")
    shared = shared_signatures(documents, join, common, bucket_count(size["shingles"], join))
    near = clusters(shared)
    groups = classes.where("rep is not null").join(near, F.col("k1") == F.col("node")).select(F.col("component").alias("grp"), "rep", "k1", "k2", "n")
    groups = written(groups, "clustered")
    discard(shared)
    sizes = groups.groupBy("grp").agg(F.count("*").alias("c"), F.max("n").alias("most"))
    found = components(links(documents, groups.join(sizes, "grp").drop("n"), join))
    named = classes.join(found, F.col("rep") == F.col("node"), "left").select("k1", "k2", "n", "rep", F.coalesce("component", "rep").alias("component"))
    t, c = table.alias("t"), written(named, "named").alias("c")
    full = t.join(c, (F.col("t.k1") == F.col("c.k1")) & (F.col("t.k2") == F.col("c.k2")) & (F.col("t.n_shingles") == F.col("c.n")), "left")
    own = F.col("t.doc_id")
    return full.select(own.alias("doc_id"), "t.n_shingles", F.coalesce("c.rep", own).alias("class_id"), F.coalesce("c.component", own).alias("component_id"))


def one_of_each(documents: DataFrame, join: Join) -> DataFrame:
    """The documents that stay: of every component the one of least doc_id; blank texts stay.

    Of rows that share a doc_id one stays (the least text), if that document stays at all; rows of null doc_id stay.
    """
    classes = written(jaccard_classes(documents, join), "jaccard")
    known = classes.where(F.col("doc_id").isNotNull())
    gone = known.groupBy("doc_id").agg(F.count("*").alias("rows"), F.max(F.col("doc_id") != F.col("component_id")).alias("linked"))
    gone = written(gone.where("linked or rows > 1"), "linked")
    out = without(documents, gone.select("doc_id"))
    again = gone.where("not linked").select(F.col("doc_id").alias("__again"))
    if again.isEmpty():
        return out
    first = documents.join(again, F.col("doc_id") == F.col("__again")).drop("__again")
    turn = Window.partitionBy("doc_id").orderBy("text")
    return out.unionByName(first.withColumn("__turn", F.row_number().over(turn)).where("__turn = 1").drop("__turn"))


OP2 = Join(n=3, num=90, den=100)

#: Whole tables are too large for all pairs in SQL; this oracle is for the small ones.
ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
r AS (SELECT s.doc_id, s.g, n.n, row_number() OVER (PARTITION BY s.doc_id ORDER BY f.f, s.g) AS place
      FROM s JOIN n USING (doc_id) JOIN (SELECT g, count(*) AS f FROM s GROUP BY g) f USING (g)),
p AS (SELECT doc_id, g, n FROM r WHERE place <= n - CAST(ceil(0.9 * n - 1e-9) AS BIGINT) + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)),
i AS (SELECT c.a, c.b, count(*) AS k FROM c JOIN s x ON x.doc_id = c.a JOIN s y ON y.doc_id = c.b AND y.g = x.g GROUP BY c.a, c.b),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
t AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT t.a, u.b FROM t JOIN u ON u.a = t.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM t GROUP BY a) m ON m.a = d.doc_id
"""


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), OP2).select("doc_id", "n_shingles", "component_id")
