"""Quality classifier by hierarchical empirical Bayes (operator 5).

Document evidence: style measures of the whole text (marks, capitals, digits, repetition,
word lengths) are binned, and each bin's log-likelihood ratio of good to bad comes from the
labelled documents by one grouped aggregation; a document's evidence is the sum. Sites:
every document's probability is summed by host and by path within the host; a host's rate is
shrunk toward the global one and a path's toward its host's, by pseudo-counts estimated from
the spread between sites (method of moments), so sparse sites lean on what stands above
them. A document's prior is its path's posterior without the document itself, and prior and
evidence combine into the posterior, which is compared with ``THRESHOLD``.

Labels are used up to ``label_limit`` rows with the lowest md5 of their id; everything else covers
all rows. Defined results: null and blank texts have the bins of an empty text; null hosts and
paths are sites of their own; unlabelled tables (or labels of one class) give evidence 0 and
keep everything; equal rows get equal results; of several labels of a document all count; a
null or other label than 0 and 1 is not used; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.scratch import spread, without, written
from gridloom.llm.words import PIECE, _buffers, hashed_texts

THRESHOLD = 0.3
LABEL_LIMIT = 500_000
SMOOTHING = 1.0
MOST_EVIDENCE = 15.0
LEVELS = 12
#: Texts under 16, under 64 and from 64 words; all measures but length are compared within a class.
CLASSES = (16, 64)
BINS = LEVELS * (len(CLASSES) + 1)
MEASURES = ("symbols", "bangs", "pipes", "capitals", "digits", "word length", "stops", "distinct", "adjacent", "top word", "length")

_CLASS = np.zeros((256, 7), dtype=np.int64)
for _chars, _column in ((b"#$%&*@^~_=+<>\\{}[]", 0), (b"!", 1), (b"|", 2), (bytes(range(65, 91)), 3), (b"0123456789", 4), (bytes(range(97, 123)), 5), (b".?", 6)):
    _CLASS[list(_chars), _column] = 1


def _level(share: float) -> int:
    """Bin of a share by powers of two; 0 for none."""
    return int(min(LEVELS - 1, max(0.0, np.floor(np.log2(share * 2048 + 1)))))


def measures(counts: np.ndarray, size: int, words: np.ndarray) -> list[int]:
    """Bins of one text's measures, from its class counts, bytes and word hashes."""
    symbols, bangs, pipes, capitals, digits, small, stops = counts.tolist()
    n = len(words)
    if not n:
        return [0] * len(MEASURES)
    _, repeats = np.unique(words, return_counts=True)
    base = LEVELS * sum(n >= least for least in CLASSES)
    levels = [
        _level(min(1.0, symbols / n / 4)), _level(min(1.0, bangs / n / 2)), _level(min(1.0, pipes / n)), _level(capitals / max(1, capitals + small)), _level(min(1.0, digits / n / 4)),
        int(min(LEVELS - 1, size // n)), _level(min(1.0, stops / n)), int(len(repeats) / n * (LEVELS - 1)), _level(float(np.mean(words[1:] == words[:-1])) if n > 1 else 0.0),
        int(repeats.max() / n * (LEVELS - 1)) if n >= 20 else 0,
    ]
    return [*(base + level for level in levels), int(min(LEVELS - 1, np.log2(n)))]


def measured(documents: DataFrame, host: Column, path: Column) -> DataFrame:
    """doc_id, host, path, bins (one per measure) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                data, offsets = _buffers(batch.column(3))
                bins = []
                for i, words in hashed_texts(batch.column(3)):
                    counts = np.zeros(7, dtype=np.int64)
                    for start in range(int(offsets[i]), int(offsets[i + 1]), PIECE):
                        counts += np.bincount(data[start : min(start + PIECE, int(offsets[i + 1]))], minlength=256) @ _CLASS
                    bins.append(measures(counts, int(offsets[i + 1] - offsets[i]), words))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(bins, pa.list_(pa.int32()))], ["doc_id", "host", "path", "bins"])

    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    return spread(own).mapInArrow(run, "doc_id long, host string, path string, bins array<int>")


def learn(table: DataFrame, labels: DataFrame, label: str = "quality", label_limit: int = LABEL_LIMIT) -> tuple[list[list[float]], float]:
    """Log-likelihood ratios by measure and bin, and the labelled share of good documents.

    What comes to the driver is one count for each measure, bin and label.
    """
    used = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    first = used.withColumn("__order", F.md5(F.col("doc_id").cast("string"))).orderBy("__order", "y").limit(label_limit).drop("__order")
    marked = table.join(first, "doc_id").select("y", F.posexplode("bins").alias("measure", "bin"))
    rows = marked.groupBy("measure", "bin", "y").count().collect()
    counts = np.zeros((len(MEASURES), BINS, 2))
    for r in rows:
        counts[r["measure"], r["bin"], r["y"]] = r["count"]
    totals = counts[0].sum(axis=0)
    if not totals.all():
        return [[0.0] * BINS for _ in MEASURES], 1.0
    by_class = counts.reshape(len(MEASURES), len(CLASSES) + 1, LEVELS, 2)
    smooth = ((by_class + SMOOTHING) / (by_class.sum(axis=2, keepdims=True) + SMOOTHING * LEVELS)).reshape(counts.shape)
    ratio = np.log(smooth[:, :, 1] / smooth[:, :, 0])
    return ratio.tolist(), float((totals[1] + 1) / (totals.sum() + 2))


def _pseudo_count(sites: DataFrame, rate: Column, n: Column, center: Column) -> DataFrame:
    """One row with ``m``: how many documents a site's prior is worth, from the spread of site rates."""
    spread_ = F.sum(n * (rate - center) * (rate - center))
    each = F.avg(center * (1 - center))
    total, squares, count = F.sum(n), F.sum(n * n), F.count("*")
    between = (spread_ - (count - 1) * each) / F.greatest(total - squares / total, F.lit(1.0))
    return sites.agg(F.coalesce(F.least(F.lit(10_000.0), F.greatest(F.lit(1.0), F.when(between > 0, each / between - 1).otherwise(F.lit(10_000.0)))), F.lit(100.0)).alias("m"))


def _logit(p: Column) -> Column:
    safe = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(safe / (1 - safe))


def classify(documents: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, threshold: float = THRESHOLD, label: str = "quality", label_limit: int = LABEL_LIMIT) -> DataFrame:
    """doc_id, host, path, evidence, host_rate, prior, posterior, keep of every document."""
    table = written(measured(documents, F.col("source") if host is None else host, F.col("lang") if path is None else path), "measured")
    ratios, share = learn(table, labels, label, label_limit)
    flat = F.array(*[F.lit(float(x)) for row in ratios for x in row])
    places = F.transform("bins", lambda b, i: i * BINS + b + 1)
    evidence = F.aggregate(places, F.lit(0.0), lambda total, at: total + F.element_at(flat, at))
    limited = F.least(F.greatest(evidence, F.lit(-MOST_EVIDENCE)), F.lit(MOST_EVIDENCE))
    start = float(np.log(share / (1 - share))) if share < 1 else 12.0
    scored = written(table.select("doc_id", "host", "path", limited.alias("evidence")).withColumn("p", 1 / (1 + F.exp(-(F.col("evidence") + F.lit(start))))), "scored")
    paths = written(scored.groupBy("host", "path").agg(F.sum("p").alias("path_sum"), F.count("*").cast("double").alias("path_n")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("path_sum").alias("host_sum"), F.sum("path_n").alias("host_n"))
    world = hosts.agg((F.coalesce(F.sum("host_sum"), F.lit(0.0)) / F.greatest(F.sum("host_n"), F.lit(1.0))).alias("world"))
    hosts = hosts.crossJoin(F.broadcast(world))  # one row
    spread_hosts = _pseudo_count(hosts, F.col("host_sum") / F.col("host_n"), F.col("host_n"), F.col("world")).withColumnRenamed("m", "host_m")
    hosts = hosts.crossJoin(F.broadcast(spread_hosts)).withColumn("host_rate", (F.col("host_sum") + F.col("host_m") * F.col("world")) / (F.col("host_n") + F.col("host_m")))
    hosts = hosts.withColumnRenamed("host", "__host")
    sites = paths.join(hosts, F.col("host").eqNullSafe(F.col("__host"))).drop("__host")
    spread_paths = _pseudo_count(sites, F.col("path_sum") / F.col("path_n"), F.col("path_n"), F.col("host_rate")).withColumnRenamed("m", "path_m")
    sites = written(sites.crossJoin(F.broadcast(spread_paths)).select(F.col("host").alias("__host"), F.col("path").alias("__path"), "path_sum", "path_n", "path_m", "host_rate"), "sites")
    if sites.count() <= BROADCAST_SITES:
        sites = F.broadcast(sites)
    joined = scored.join(sites, F.col("host").eqNullSafe(F.col("__host")) & F.col("path").eqNullSafe(F.col("__path")))
    prior = (F.col("path_sum") - F.col("p") + F.col("path_m") * F.col("host_rate")) / (F.col("path_n") - 1 + F.col("path_m"))
    out = joined.withColumn("prior", F.least(F.greatest(prior, F.lit(1e-6)), F.lit(1 - 1e-6)))
    posterior = 1 / (1 + F.exp(-(_logit(F.col("prior")) + F.col("evidence"))))
    return out.select("doc_id", "host", "path", "evidence", "host_rate", "prior", posterior.alias("posterior")).withColumn("keep", F.col("posterior") >= F.lit(threshold))


#: Rows of the table of sites (about 100 bytes each) up to which it is sent to every task.
BROADCAST_SITES = 50_000


def kept_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose every row of that doc_id is kept, with all their columns."""
    return without(documents, classify(documents, labels).where(~F.col("keep")).select("doc_id").distinct())


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
