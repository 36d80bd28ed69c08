"""Signatures of the near-duplicate join travel packed by bucket, and in batches of bounded size."""

from collections import defaultdict

import numpy as np

from gridloom.llm import partenum
from gridloom.llm.words import hashed_texts, shingles

TEXTS = [" ".join(f"w{(i * 7 + j) % 90}" for j in range(20 + i % 9)) for i in range(60)] + [None, "", "one"]


def by_hand(join):
    """(sig, k1) of the signatures that two sets share."""
    import pyarrow as pa

    held = defaultdict(set)
    for _, words in hashed_texts(pa.array(TEXTS)):
        items = shingles(words, join.n)
        if len(items):
            for sig in join.signatures(items, np.zeros(0, dtype=np.uint64))[0].view(np.int64).tolist():
                held[sig].add(partenum._digest(items)[0])
    return {(sig, key) for sig, keys in held.items() if len(keys) > 1 for key in keys}


def test_any_number_of_buckets(spark, monkeypatch):
    join, none = partenum.Join(), np.zeros(0, dtype=np.uint64)
    docs = spark.createDataFrame(list(enumerate([*TEXTS, *TEXTS])), "doc_id long, text string").repartition(3)
    expected = by_hand(join)
    assert expected
    for buckets, packed in ((1, 1 << 19), (7, 50), (1000, 50)):
        monkeypatch.setattr(partenum, "PACKED_SIGNATURES", packed)
        rows = [(r["sig"], r["k1"]) for r in partenum.shared_signatures(docs, join, none, buckets).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == expected


def test_hot_signature_over_batches(spark):
    """A bucket that goes on from batch to batch is compared as one."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(4)
    spark.conf.set(key, 1)
    try:
        rows = {(r["sig"], r["k1"]) for r in partenum.shared_signatures(docs, partenum.Join(), np.zeros(0, dtype=np.uint64), 3).collect()}
    finally:
        spark.conf.unset(key)
    assert rows == by_hand(partenum.Join())


def test_batches_are_small_meanwhile(spark, monkeypatch):
    key, seen, real = "spark.sql.execution.arrow.maxBytesPerBatch", [], partenum.digests
    monkeypatch.setattr(partenum, "digests", lambda *a: (seen.append(spark.conf.get(key)), real(*a))[1])
    before = spark.conf.get(key)
    assert partenum.jaccard_classes(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"), partenum.Join()).count() == len(TEXTS)
    assert seen == [partenum.BATCH_BYTES] and spark.conf.get(key) == before
