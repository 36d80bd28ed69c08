"""Exact top-k search by inner product with block-at-a-time pruning (operator 7).

Vectors become integers ``floor(64 x)``. They are ordered by a locality key and cut into
blocks; a block keeps its vectors (the forward index) and every dimension's largest and
smallest value. A query's bound for a block is the sum over its dimensions of the query's
value times the block's largest (or, for negative values, smallest) one. Queries start from
the k-th best score within their own block; then, shard by shard, a query visits blocks in
falling order of bound and stops as soon as the bound lies below its k-th score. Equal bounds
are visited, since a tie goes to the smaller id.

Work is dealt by (shard of blocks, group of queries): both have a fixed size over the whole
table, whatever its partitions, so a task's memory does not grow with the table. A shard's
extremes are compared with a group's floors first, and only groups with a query whose bound
for the shard reaches its floor are sent to it.

Defined results: vectors that are null or hold null or non-finite components take no part;
rows of null id and empty vectors are no queries and no candidates; vectors of different length are not
compared; scores beyond 64 bits are clipped to them; repeated ids are separate candidates,
and a query is not compared with rows of its own id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.scratch import written
from gridloom.llm.words import mix64

BLOCK, SHARD_BLOCKS, GROUP = 512, 32, 2048
_EXACT = float(1 << 53)


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products, exact: in doubles while they can't round, else in 64-bit or Python integers."""
    if not queries.size or not rows.size:
        return np.zeros((len(queries), len(rows)), dtype=np.int64)
    most = float(np.abs(queries.astype(np.float64)).max()) * float(np.abs(rows.astype(np.float64)).max()) * queries.shape[1]
    if most < _EXACT:
        return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    if most < 2.0**62:
        return queries @ rows.T
    exact = queries.astype(object) @ rows.astype(object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def quantised(embeddings: DataFrame) -> DataFrame:
    """vec_id, dim, vector: valid rows only, components floor(64 x) as long."""
    own = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).where(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & (F.size("e") > 0))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return own.where(finite).select("vec_id", F.size("e").alias("dim"), F.transform("e", lambda x: F.floor(x * F.lit(64.0)).cast("long")).alias("vector"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.int64).reshape(-1, dim)


def _planes(dim: int, count: int) -> np.ndarray:
    seeds = mix64(np.arange(dim * count, dtype=np.uint64) + np.uint64(dim))
    return np.where(seeds & np.uint64(1), 1.0, -1.0).reshape(dim, count)


def with_locality(vectors: DataFrame) -> DataFrame:
    """Adds ``place``: the sides of 12 fixed random planes, so that near vectors share blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column(1))
            place = np.zeros(len(dims), dtype=np.int64)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                if dim:
                    rows = _matrix(batch.column(2).take(pa.array(at)), dim)
                    place[at] = ((rows @ _planes(dim, 12)) > 0) @ (1 << np.arange(12))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], ["vec_id", "dim", "vector", "place"])

    return vectors.mapInArrow(run, "vec_id long, dim int, vector array<long>, place long")


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best (score falling, id rising)."""
    if len(scores) > 4 * k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        kept = np.flatnonzero(scores >= kth)
    else:
        kept = np.arange(len(scores))
    return kept[np.lexsort((ids[kept], -scores[kept]))[:k]]


def packed(values: np.ndarray) -> bytes:
    """Integers in the fewest of 2, 4 or 8 bytes; the first byte tells."""
    most = int(np.abs(values).max()) if values.size else 0
    width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    return bytes([width]) + values.astype(f"<i{width}").tobytes()


def unpacked(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<i{data[0]}", offset=1).astype(np.int64).reshape(-1, dim)


def _least(scores: np.ndarray, k: int) -> int:
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else -(1 << 63)


def build_index(vectors: DataFrame, k: int, divisor: int, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """The written index: one row per block with its forward index, extremes, the floors of its own queries and its shard."""
    schema = "part long, before long, n long, dim int, ids binary, rows binary, high binary, low binary, floors binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = _partition()
        before, held, count, dim = 0, [], 0, -1

        def cut(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, count, before
            if not count:
                return
            ids = np.concatenate([h[0] for h in held])
            rows = np.concatenate([h[1] for h in held])
            at = 0
            while count - at >= block or (final and at < count):
                own_ids, own = ids[at : at + block], rows[at : at + block]
                asks = np.flatnonzero(own_ids % divisor == 0)
                scores = products(own[asks], own)
                scores = [s[own_ids != own_ids[q]] for s, q in zip(scores, asks.tolist(), strict=True)]
                floors = np.array([_least(s, k) for s in scores], dtype=np.int64)
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([part], pa.int64()), "before": pa.array([before], pa.int64()), "n": pa.array([len(own_ids)], pa.int64()), "dim": pa.array([dim], pa.int32()), "ids": [own_ids.tobytes()], "rows": [packed(own)],
                    "high": [own.max(axis=0).tobytes()], "low": [own.min(axis=0).tobytes()], "floors": [floors.tobytes()],
                })
                at, before = at + block, before + len(own_ids)
            held, count = [(ids[at:], rows[at:])], max(0, count - at)

        for batch in batches:
            dims = np.asarray(batch.column(1))
            for own_dim in np.unique(dims).tolist():
                if own_dim != dim:
                    yield from cut(True)
                    held, count, dim = [], 0, own_dim
                at = np.flatnonzero(dims == own_dim)
                held.append((np.asarray(batch.column(0))[at], _matrix(batch.column(2).take(pa.array(at)), own_dim)))
                count += len(at)
                yield from cut(False)
        yield from cut(True)

    ordered = with_locality(vectors).repartitionByRange("dim", "place", "vec_id").sortWithinPartitions("dim", "place", "vec_id")
    return _dealt(written(ordered.mapInArrow(run, schema), "topk-index"), "shard", block * shard_blocks)


def _dealt(rows: DataFrame, name: str, size: int) -> DataFrame:
    """``rows`` (part, before, n) with their number ``name`` when about ``size`` items stand together, counted over all partitions.

    One count for each partition comes to the driver.
    """
    sizes = sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.sum("n").alias("n")).collect())
    starts = np.cumsum([0] + [n for _, n in sizes]).tolist()
    table = rows.sparkSession.createDataFrame([(part, start) for (part, _), start in zip(sizes, starts, strict=False)], "part long, start long")
    return rows.join(F.broadcast(table), "part").withColumn(name, F.floor((F.col("start") + F.col("before")) / size)).drop("part", "before", "n", "start")


def _partition() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def query_groups(index: DataFrame, divisor: int, group: int = GROUP) -> DataFrame:
    """The written query set, in rows of at most ``group`` queries of one length: grp, dim, ids, rows, floors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = _partition(), 0
        for batch in batches:
            for dim, ids, rows, floors in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                ids = np.frombuffer(ids, dtype=np.int64)
                asks = ids % divisor == 0
                n = int(asks.sum())
                if n:
                    yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "before": pa.array([before], pa.int64()), "n": pa.array([n], pa.int64()), "dim": pa.array([dim], pa.int32()), "ids": [ids[asks].tobytes()], "rows": [packed(unpacked(rows, dim)[asks])], "floors": [floors]})
                    before += n

    found = index.select("dim", "ids", "rows", "floors").mapInArrow(run, "part long, before long, n long, dim int, ids binary, rows binary, floors binary")
    return _dealt(written(found, "topk-queries"), "grp", group)


def _bounds(rows: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The most that each query's product with any vector between ``low`` and ``high`` can be."""
    return products(np.maximum(rows, 0), high) + products(np.minimum(rows, 0), low)


def meetings(groups: DataFrame, index: DataFrame, chunk: int = 1024) -> DataFrame:
    """(g, s): groups and shards such that a query's bound for one of the shard's blocks reaches its floor.

    What meets here are a group's queries and two vectors for each block, ``chunk`` shards at a time.
    """
    def extremes(key: tuple, blocks: pd.DataFrame) -> pd.DataFrame:
        high, low = (np.stack([np.frombuffer(b, dtype=np.int64) for b in blocks[c]]) for c in ("high", "low"))
        return pd.DataFrame({"s": [key[0]], "dim": [key[1]], "high": [high.max(axis=0).tobytes()], "low": [low.min(axis=0).tobytes()]})

    ends = index.select("shard", "dim", "high", "low").groupBy("shard", "dim").applyInPandas(extremes, "s long, dim int, high binary, low binary")
    ends = written(ends, "topk-extremes")
    last = ends.agg(F.max("s")).first()[0], groups.agg(F.max("grp")).first()[0]
    if None in last:
        return groups.sparkSession.createDataFrame([], "g long, s long")
    every = lambda n, name: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n).cast("long"))).alias(name)
    asked = groups.select(F.col("grp").alias("g"), every(last[0] // chunk, "c"), "dim", "rows", "floors")
    own = ends.select(every(last[1], "g"), F.floor(F.col("s") / chunk).alias("c"), "s", "dim", "high", "low")

    def run(queries: pd.DataFrame, shards: pd.DataFrame) -> pd.DataFrame:
        out = set()
        for dim, rows, floors in zip(queries["dim"], queries["rows"], queries["floors"], strict=True):
            same = shards[shards["dim"] == dim]
            if len(same):
                high, low = (np.stack([np.frombuffer(b, dtype=np.int64) for b in same[c]]) for c in ("high", "low"))
                reached = (_bounds(unpacked(rows, int(dim)), high, low) >= np.frombuffer(floors, dtype=np.int64)[:, None]).any(axis=0)
                out.update(same["s"][reached].tolist())
        return pd.DataFrame({"g": [queries["g"].iloc[0] for _ in out], "s": sorted(out)}, dtype="int64")

    return asked.groupBy("g", "c").cogroup(own.groupBy("g", "c")).applyInPandas(run, "g long, s long")


def search_shard(asked: pd.DataFrame, blocks: pd.DataFrame, k: int) -> pd.DataFrame:
    """Best k of one shard for each query of one group, visiting blocks by falling bound."""
    out: list[tuple[np.ndarray, ...]] = []
    parts = [np.frombuffer(b, dtype=np.int64) for b in blocks["ids"]]
    for dim, ids, rows, floors in zip(asked["dim"], asked["ids"], asked["rows"], asked["floors"], strict=True):
        dim = int(dim)
        ids, floors = np.frombuffer(ids, dtype=np.int64), np.frombuffer(floors, dtype=np.int64)
        rows = unpacked(rows, dim)
        same = [i for i, d in enumerate(blocks["dim"]) if d == dim]
        if not same:
            continue
        high = np.array([np.frombuffer(blocks["high"].iloc[i], dtype=np.int64) for i in same]).reshape(len(same), dim)
        low = np.array([np.frombuffer(blocks["low"].iloc[i], dtype=np.int64) for i in same]).reshape(len(same), dim)
        forward = [unpacked(blocks["rows"].iloc[i], dim) for i in same]
        bounds = _bounds(rows, high, low)
        order = np.argsort(-bounds, axis=1, kind="stable")
        kth = floors.copy()
        best_scores = [np.zeros(0, dtype=np.int64)] * len(ids)
        best_ids = [np.zeros(0, dtype=np.int64)] * len(ids)
        live = np.arange(len(ids))
        for step in range(len(same)):
            at = order[live, step]
            live = live[bounds[live, at] >= kth[live]]
            if not len(live):
                break
            at = order[live, step]
            for b in np.unique(at).tolist():
                asks = live[at == b]
                scores = products(rows[asks], forward[b])
                block_ids = parts[same[b]]
                for q, own in zip(asks.tolist(), scores, strict=True):
                    kept = np.flatnonzero((own >= kth[q]) & (block_ids != ids[q]))
                    if not len(kept):
                        continue
                    s, i = np.concatenate([best_scores[q], own[kept]]), np.concatenate([best_ids[q], block_ids[kept]])
                    first = top(s, i, k)
                    best_scores[q], best_ids[q] = s[first], i[first]
                    if len(first) == k:
                        kth[q] = max(kth[q], s[first[-1]])
        counts = [len(s) for s in best_scores]
        out.append((np.repeat(ids, counts), np.concatenate(best_ids), np.concatenate(best_scores)))
    if not out:
        return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), (np.concatenate([o[i] for o in out]) for i in range(3)), strict=True)))


def search(embeddings: DataFrame, k: int = 20, divisor: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every row whose id is divisible by ``divisor``."""
    index = build_index(quantised(embeddings), k, divisor)
    groups = query_groups(index, divisor)
    pairs = written(meetings(groups, index), "topk-pairs")
    asked = groups.join(pairs, F.col("grp") == F.col("g")).select("g", "s", "dim", "ids", "rows", "floors")
    blocks = index.join(pairs, F.col("shard") == F.col("s")).select(F.col("g").alias("g"), F.col("s").alias("s"), "dim", "ids", "rows", "high", "low")
    found = asked.groupBy("g", "s").cogroup(blocks.groupBy("g", "s")).applyInPandas(lambda a, b: search_shard(a, b, k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 20
"""


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
