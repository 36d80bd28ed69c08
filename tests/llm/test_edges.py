"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import hashlib
import itertools
import math
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import addressable, htmlcrf, mixing, partenum, pieces, pitmanyor, quality, topk, winnowing, wordpieces
from gridloom.llm.chunked import ChunkEncoder
from gridloom.llm.scratch import scratch_dir
from gridloom.llm.words import hashed_texts

LONG = "lorem ipsum " * 120_000
WORDS = "the quick brown fox jumps over the lazy dog and runs far away from here today".split()
BASE = " ".join(WORDS * 3)
TEXTS = [(1, None, None), (2, "", "a"), (3, "  \t\n ", "a"), (4, BASE, "b"), (5, BASE, "b"), (6, BASE + " indeed", "a"), (7, "One two", None), (8, "one TWO", "c"), (8, "one TWO", "c"), (9, LONG, "é"), (None, BASE, "b"), (10, "éÀ 😀 \x00 x", "a"), (11, "z" * 3000, "c")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, s, "en", len(t or ""), 1, 2, "x", 4, 5) for i, t, s in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, size int, h int, sig string, chunk int, part int")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def by_id(frame):
    return sorted((tuple(r) for r in frame.collect()), key=lambda r: (r[0] is not None, r[0] or 0, repr(r)))


def test_token_files(spark, docs, none):
    folder = scratch_dir(spark, "dac")
    got = addressable.read_files(addressable.placed(addressable.write_files(docs, folder, file_tokens=2000)), folder, with_ids=True).collect()
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(addressable.default_tokenizer())
    library.encode_special_tokens = True
    want = Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids) + (0,)) for i, t, _ in TEXTS)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == sorted((i for i, _, _ in TEXTS), key=lambda i: (i is not None, i))
    folder = scratch_dir(spark, "dac")
    assert addressable.read_files(addressable.placed(addressable.write_files(none, folder)), folder).count() == 0


def test_letter_runs_by_the_model_alone():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(addressable.default_tokenizer())
    rng = np.random.default_rng(3)
    letters = np.array(list("abcdefgzABZÀÖØöøɏßéñ"))
    runs = sorted({" " * int(rng.integers(2)) + "".join(rng.choice(letters, int(rng.integers(1, 80)))) for _ in range(3000)})
    codes = addressable.run_codes(library)
    assert codes(runs) == {c: np.array(library.encode(c, add_special_tokens=False).ids, dtype="<u4").tobytes() for c in runs}
    assert codes([]) == {}


def test_chunk_codes_survive_generations_and_long_chunks():
    asked = []

    def encode(chunks):
        asked.extend(chunks)
        return [c.encode() for c in chunks]

    own = ChunkEncoder("[^ ]+", encode, limit=3)
    texts = ["a b a", "", "c " + "x" * 100, "a d e", "f g a", "x" * 100]
    assert [b for t in texts for b in own.encode([t])] == [t.replace(" ", "").encode() for t in texts]
    assert asked.count("a") == 1 and asked.count("x" * 100) == 2


def test_old_chunk_codes_are_looked_up_and_not_walked():
    class Old(dict):
        def __iter__(self):
            raise AssertionError("all old codes are walked")

    asked = []

    def encode(chunks):
        asked.extend(chunks)
        return [c.encode() for c in chunks]

    own = ChunkEncoder("[^ ]+", encode)
    own._old = Old((f"w{i}", b"%d" % i) for i in range(100))
    assert list(own.encode(["w7 new w99 w7"])) == [b"7new997"]
    assert asked == ["new"]


def test_addressable_codes_any_token():
    rng = np.random.default_rng(0)
    ids = rng.choice([0, 5, 255, 256, 40_000, 70_000, 1 << 31], 3000).astype(np.uint32)
    import pyarrow as pa

    reader = addressable.Reader(pa.BufferReader(addressable.file_bytes(ids, np.array([3, 4]), np.array([True, False]), np.array([0, 10, 3000]))))
    assert [reader[i] for i in (0, 511, 512, 513, 2999)] == ids[[0, 511, 512, 513, 2999]].tolist()
    assert np.array_equal(reader.tokens(700, 2100), ids[700:2100])


def shingle_set(text, n):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def classes(rows, join):
    sets = [shingle_set(t, join.n) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            same = rows[a][0] is not None and rows[a][0] == rows[b][0]
            k = len(sets[a] & sets[b])
            if same or (sets[a] and sets[b] and join.den * k >= join.num * (len(sets[a]) + len(sets[b]) - k)):
                parent[root(a)] = root(b)
    least = {}
    for i, (doc_id, _, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return sorted(((rows[i][0], len(sets[i]), least.get(root(i))) for i in range(len(rows))), key=lambda r: (r[0] is not None, r[0] or 0, repr(r)))


@pytest.mark.parametrize("join", [partenum.OP2, partenum.Join()])
def test_jaccard_classes(docs, none, join):
    got = by_id(partenum.jaccard_classes(docs, join).select("doc_id", "n_shingles", "component_id"))
    assert got == classes(TEXTS, join)
    assert partenum.jaccard_classes(none, join).count() == 0


def test_overlaps_by_ranges(monkeypatch):
    monkeypatch.setattr(partenum, "RANGE_ITEMS", 50)
    rng = np.random.default_rng(9)
    base = np.append(rng.integers(0, 2**64 - 1, 200, dtype=np.uint64), np.array([0, 2**64 - 1], dtype=np.uint64))
    sets = [np.unique(rng.choice(base, int(rng.integers(1, 150)))) for _ in range(20)]
    for left, right in ((sets, sets), (sets[:7], sets[7:])):
        found = {(int(i), int(j)): int(n) for i, j, n in zip(*partenum.overlaps(left, right), strict=True)}
        assert found == {(i, j): n for i, a in enumerate(left) for j, b in enumerate(right) if (n := len(set(a.tolist()) & set(b.tolist())))}


def test_jaccard_large_clusters_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(partenum, "BLOCK_ROWS", 4)
    rng = np.random.default_rng(5)
    rows = []
    for i in range(40):
        words = [f"w{k}" for k in range(60)]
        for _ in range(rng.integers(0, 4)):
            words[rng.integers(60)] = f"x{rng.integers(1000)}"
        rows.append((i, " ".join(words), "a"))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert by_id(partenum.jaccard_classes(df, partenum.Join()).select("doc_id", "n_shingles", "component_id")) == classes(rows, partenum.Join())


def test_jaccard_large_cluster_that_leaders_dont_connect(spark, monkeypatch):
    """A chain: every text links with the next few alone."""
    monkeypatch.setattr(partenum, "BLOCK_ROWS", 4)
    rows = [(i, " ".join(f"w{k}" for k in range(3 * i, 3 * i + 60)), "a") for i in range(0, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for join in (partenum.Join(), partenum.Join(n=3, num=90)):
        assert by_id(partenum.jaccard_classes(df, join).select("doc_id", "n_shingles", "component_id")) == classes(rows, join)


def test_signatures_of_unlike_sets_are_not_shared():
    """Under 0.1 % of the memberships of random disjoint sets, and every linked pair shares enough of them."""
    rng, join = np.random.default_rng(1), partenum.Join()
    sets = [np.unique(rng.integers(0, 1 << 63, 200).astype(np.uint64)) for _ in range(300)]
    none = np.zeros(0, dtype=np.uint64)
    owners = Counter(s for items in sets for s in set(join.signatures(items, none)[0].tolist()))
    assert sum(n for n in owners.values() if n > 1) < 0.001 * sum(owners.values())
    for size in (1, 2, 5, 9, 30, 200, 1000):
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
            cut = int(rng.integers(0, size // 5 + 1))
            b = np.unique(np.concatenate([a[cut:], rng.integers(0, 1 << 63, cut // 2).astype(np.uint64)]))
            if join.den * (both := len(np.intersect1d(a, b))) < join.num * (len(a) + len(b) - both):
                continue
            common = np.sort(rng.choice(a, int(rng.integers(0, size + 1)), replace=False))
            (x, p), (y, q) = join.signatures(a, common), join.signatures(b, common)
            met = set(x.tolist()) & set(y.tolist())
            kept = [{s for s in met if Counter(r[np.isin(v, list(met))].tolist())[dict(zip(v.tolist(), r.tolist(), strict=True))[s]] >= dict(zip(v.tolist(), r.tolist(), strict=True))[s] >> 2} for v, r in ((x, p), (y, q))]
            assert kept[0] & kept[1]


def test_one_of_each(docs, none):
    kept = partenum.one_of_each(docs, partenum.Join())
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 2, 3, 4, 7, 9, 10, 11]
    assert partenum.one_of_each(none, partenum.Join()).count() == 0


def test_lm_scores(docs, none):
    got = pitmanyor.score(docs).collect()
    train = [zlib.crc32(str(i).encode() if i is not None else b"") % 5 != 1 for i, _, _ in TEXTS]
    words = [(t or "").encode().lower().split() + [None] for _, t, _ in TEXTS]
    counts = Counter(w for ws, k in zip(words, train, strict=True) if k for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), not k, len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 4)) for (i, _, _), k, ws in zip(TEXTS, train, words, strict=True))
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert pitmanyor.score(none).count() == 0


def test_lm_probabilities_sum_to_one():
    """Over all training words and the unknown one, in every context."""
    counts = np.array([7, 1, 3, 100, 2, 1], dtype=np.int64)
    contexts, word_of = np.array([0, 1, 0, 1, 0, 0]), np.array([0, 0, 1, 1, 2, 3])
    totals = pitmanyor.Totals(np.bincount(contexts, counts, minlength=33), np.bincount(contexts, minlength=33), 4, (2, 2), (1, 1))
    block = pitmanyor.Block(contexts, counts, word_of, 4, 1)
    *_, (tables, customers, root, _) = block.sample(totals, 1)
    assert (tables >= 1).all() and (tables <= counts).all() and (root <= customers).all()
    there, root_there = np.bincount(contexts, tables, minlength=33), float(root.sum())
    base = pitmanyor.root_probability(np.append(customers, 0), np.append(root, 0), there.sum(), root_there, totals)
    assert base.sum() == pytest.approx(1)
    for c in (0, 1, 5):
        own = np.zeros(5)
        np.add.at(own, word_of[contexts == c], (counts - totals.discount * tables)[contexts == c])
        assert ((own + (1 + totals.discount * there[c]) * base) / (1 + totals.customers[c])).sum() == pytest.approx(1)


def test_lm_contexts_are_the_words_before(spark):
    """Words whose hashes share their highest bits are contexts of their own."""
    words = [f"w{k}" for k in range(200)]
    hashes = words_of(words)
    a, b = next((words[i], words[j]) for i in range(200) for j in range(i) if hashes[i] >> np.uint64(59) == hashes[j] >> np.uint64(59))
    texts = [f"{a} x", f"{b} y"] * 60 + [f"{a} y", f"{b} x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {t: r["score"] for t, r in zip(texts, sorted(pitmanyor.score(docs).collect(), key=lambda r: r["doc_id"]), strict=True)}
    assert got[f"{a} x"] > got[f"{a} y"] + 0.5 and got[f"{b} y"] > got[f"{b} x"] + 0.5


def words_of(words):
    import pyarrow as pa

    return [h[0] for _, h in hashed_texts(pa.array(words))]


def test_mix(docs, none):
    got = mixing.mix(docs).collect()
    sizes = Counter()
    for _, t, s in TEXTS:
        sizes[s] += len((t or "").encode().split())
    assert {r["source"]: r["source_size"] for r in got} == dict(sizes)
    assert sum({r["source"]: r["target"] for r in got}.values()) == pytest.approx(sum(sizes.values()))
    assert all(r["taken"] <= 3 * r["size"] and r["target"] <= 3 * r["source_size"] for r in got)
    copies = Counter()
    for r in got:
        copies[r["doc_id"]] += r["copies"]
    rows = mixing.mixed_rows(docs)
    assert rows.columns == docs.columns and Counter(r["doc_id"] for r in rows.collect()) == +copies
    assert mixing.mix(none).count() == 0 and mixing.mixed_rows(none).count() == 0


def test_mix_comes_near_targets(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, "w " * int(rng.integers(1, 40)), f"s{i % 7}") for i in range(3000)], "doc_id long, text string, source string")
    for r in mixing.mix(df).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r["taken"] - r["target"]) <= 40


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, 0), (11, 0, 0), (9, 0, 1), (99, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == len({i for i, _, _ in TEXTS}) and got[4]["keep"] and got[4]["posterior"] == pytest.approx(got[5]["posterior"], abs=0.05)
    assert quality.classify(none, labels).count() == 0
    assert quality.kept_documents(docs, labels.limit(0)).count() == len(TEXTS)


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = quality.classify(spark.read.parquet(f"{d}/documents.parquet"), labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id")
    row = got.agg(F.avg((F.col("keep") == (F.col("quality") == 1)).cast("double")).alias("right"), F.avg(F.when(F.col("quality") == 1, F.col("keep").cast("double"))).alias("kept")).first()
    assert row["right"] > 0.95 and row["kept"] > 0.97


def greedy(word, first, later):
    n = at = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in (later if at else first)), None)
        if end is None:
            return 1
        n, at = n + 1, end
    return n


def test_token_counts(docs, none):
    first, later = map(set, wordpieces.vocabulary(wordpieces.default_vocabulary()))
    got = by_id(wordpieces.token_counts(docs))
    want = []
    for i, t, _ in TEXTS:
        words = (t or "").encode().split()
        want.append((i, len(words), sum(greedy(w, first, later) * k for w, k in Counter(words).items())))
    assert got == sorted(want, key=lambda r: (r[0] is not None, r[0] or 0, repr(r)))
    assert wordpieces.token_counts(none).count() == 0


def test_automaton_on_random_vocabularies():
    rng = np.random.default_rng(0)
    pick = lambda n: bytes(rng.choice(list(b"abc"), rng.integers(1, n)).tolist())
    for _ in range(100):
        first, later = {pick(6) for _ in range(6)}, {pick(6) for _ in range(6)}
        own = wordpieces.Automaton(first, later)
        for _ in range(40):
            word = pick(12)
            assert own.count(word) == greedy(word, first, later)


def test_topk(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8)], 1) for i in range(300)]
    rows += [(20, rows[20][1], 2), (301, None, 3), (302, [1.0, None] * 4, 3), (303, [float("nan")] * 8, 3), (304, [], 3), (None, rows[3][1], 3), (320, [1.0, -2.0], 3), (340, [0.5, 1.0], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    valid = [(i, np.floor(64 * np.array(e, dtype=np.float32).astype(float)).astype(int)) for i, e, _ in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    want = Counter()
    for q, a in {(i, tuple(v)) for i, v in valid if i % 20 == 0}:
        scored = sorted((-int(np.dot(a, v)), i) for i, v in valid if i != q and len(v) == len(a))[:20]
        for k, (s, i) in enumerate(scored):
            want[q, k + 1, i, -s] += 1
    got = Counter(tuple(r) for r in topk.search(df).collect() if r["query_id"] != 20)
    assert got == Counter({k: v for k, v in want.items() if k[0] != 20})
    assert topk.search(df.limit(0)).count() == 0
    assert topk.products(np.array([[1 << 40]]), np.array([[1 << 40]])).tolist() == [[(1 << 63) - 1]]


def test_fingerprints(docs, none):
    got = winnowing.compare_edited(docs).collect()
    order = sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    texts = [t or "" for _, t, _ in order]
    want = []
    for k, (i, _, _) in enumerate(order):
        own, after = texts[k], texts[(k + 1) % len(texts)]
        half = len(own) // 2
        want.append((str(i), len(own), hashlib.sha256((own[: len(own) - half] + after[:half]).encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want)
    same = {r["fingerprint"] for r in got if r["n_chars"] == len(BASE)}
    assert len(same) == 1 and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert winnowing.compare_edited(none).count() == 0
    assert winnowing.fingerprints(docs).count() == len(TEXTS)


def test_likeness_of_fingerprints(spark):
    """Positions hold the hashes that the fingerprint tells, and likenesses are shared shares of the sets of hashes."""
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list("abcd e"), int(rng.integers(0, 400)))) for _ in range(30)]
    rows = winnowing.compare_edited(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    hashes = lambda text: [int(text[i : i + 8], 16) for i in range(0, len(text), 8)]
    share = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    prints = {r["doc_id"]: hashes(r["fingerprint"]) for r in rows}
    for r in rows:
        text, after = texts[r["doc_id"]], texts[(r["doc_id"] + 1) % len(texts)]
        half = len(text) // 2
        edited = winnowing.winnow(text[: len(text) - half] + after[:half])[0].tolist()
        own, grams = prints[r["doc_id"]], min(winnowing.GRAM, len(text))
        assert hashes(r["edited_fingerprint"]) == edited and len(own) == len(r["positions"])
        for h, at in zip(own, r["positions"], strict=True):
            assert winnowing.gram_hashes(np.frombuffer(text[at : at + grams].encode("utf-32-le"), "<u4"), grams).tolist() == [h]
        assert r["near_edited"] == pytest.approx(share(set(own), set(edited)))
        assert r["near_next"] == pytest.approx(share(set(own), set(prints[(r["doc_id"] + 1) % len(texts)])))


def test_winnowing_against_brute_force():
    rng = np.random.default_rng(3)
    for n in (1, 5, 16, 17, 40, 200):
        text = "".join(rng.choice(list("ab"), n))
        h = winnowing.gram_hashes(np.frombuffer(text.encode("utf-32-le"), "<u4"), min(16, n)).tolist()
        w, want = min(32, len(h)), []
        for at in range(len(h) - w + 1):
            least = min(h[at : at + w])
            place = max(j for j in range(at, at + w) if h[j] == least)
            if not want or want[-1] != (least, place):
                want.append((least, place))
        hashes, places = winnowing.winnow(text, piece=7)
        assert list(zip(hashes.tolist(), places.tolist(), strict=True)) == want


def test_html(spark):
    page = '<html><nav><a href="/">Home</a><a href="/b">More</a></nav><article><h1>A &amp; B</h1><p>Some  long\ntext of the article, with words enough.<p>Second paragraph&nbsp;here, quite long as well.</article><footer>&copy; site</footer><script>var x = "<p>no</p>"</script>'
    rows = [(1, "u", None), (2, "u", ""), (3, "u", page), (3, "u", page), (None, None, "<p>unclosed <b"), (5, "u", "<" * 500), (6, "u", "<article>" + "<p>word text here, and more of it.</p>" * 20_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x")).withColumn("n_chars", F.lit(1))
    got = htmlcrf.extract(df).collect()
    texts = {r["page_id"]: r["text"] for r in got}
    assert texts[1] == texts[2] == "" and len(got) == len(rows)
    assert texts[3] == "A & B\n\nSome long text of the article, with words enough.\n\nSecond paragraph here, quite long as well."
    assert texts[6].count("\n\n") == 19_999
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert htmlcrf.extract(df.limit(0)).count() == 0


def test_html_scan_is_linear():
    for piece in ("<a ", '<a href="', "<svg>", "<!--", "<script", "</p ", "<"):
        began = time.process_time()
        htmlcrf.leaf_blocks(piece * 100_000)
        assert time.process_time() - began < 3
    blocks = htmlcrf.leaf_blocks("<p>a <svg viewBox=1 />b<object-x>c</object-x> <noscript>d</noscript><p title='x>y'>1 < 2<p don't>e")
    assert [b.text for b in blocks] == ["a b" + "c d", "1 < 2", "e"]


@pytest.mark.parametrize("place", range(len(htmlcrf.LAYOUTS)))
def test_html_held_out_layout(place):
    """Pages of a family of layouts by a model of the other families."""
    others = [x for i, x in enumerate(htmlcrf.LAYOUTS) if i != place]
    model = htmlcrf.train([blocks for _, blocks in htmlcrf.labelled_pages(300, 7, others) if blocks], steps=100)
    right = total = 0
    for _, blocks in htmlcrf.labelled_pages(60, 99, [htmlcrf.LAYOUTS[place]]):
        labels = htmlcrf.viterbi(model, blocks)
        right, total = right + sum(a == b.label for a, b in zip(labels, blocks, strict=True)), total + len(blocks)
    assert right / total > 0.85


def test_viterbi_against_all_labellings():
    rng = np.random.default_rng(8)
    for _, blocks in htmlcrf.labelled_pages(30, 5):
        blocks = blocks[: int(rng.integers(1, 9))]
        names = htmlcrf.features(blocks)
        model = htmlcrf.Model({n: tuple(rng.normal(size=2)) for own in names for n in own}, tuple(map(tuple, rng.normal(size=(2, 2)))))
        score = lambda labels: sum(model.weights[n][y] for own, y in zip(names, labels, strict=True) for n in own) + sum(model.moves[a][b] for a, b in itertools.pairwise(labels))  # noqa: E731, B023
        assert score(htmlcrf.viterbi(model, blocks)) == pytest.approx(max(map(score, itertools.product((0, 1), repeat=len(blocks)))))


def test_pieces(docs, none):
    got = pieces.encode(docs, with_ids=True).collect()
    library = pieces.encoder(pieces.default_model()).vocabulary.library
    for r in got:
        assert r["n_tokens"] == len(r["ids"]) and r["n_disagreed"] == 0
        assert r["ids_sha256"] == hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest()
    want = Counter((i, tuple(library.encode(t or "", add_bos=True, add_eos=True))) for i, t, _ in TEXTS)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want
    assert pieces.encode(none).count() == 0


def test_pipeline_ends_with_ids_and_text(spark, docs):
    library = pieces.encoder(pieces.default_model()).vocabulary.library
    got = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    want = [library.encode(t or "", add_bos=True, add_eos=True) for _, t, _ in TEXTS]
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in got) == Counter((i, tuple(ids), library.decode(ids)) for (i, _, _), ids in zip(TEXTS, want, strict=True))


def test_agenda_alone_equals_the_library():
    rng = np.random.default_rng(4)
    own = pieces.PieceEncoder(pieces.default_model(), verify=False)
    alphabet = [" ", "  ", "a", "the", "ing", "é", "\n", "日", "😀", "▁", "!", "0", "\t", "<s>"]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 90))) for _ in range(200)]
    for text, code in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(code, "<u4").tolist() == own.vocabulary.library.encode(text, add_bos=True, add_eos=True)


def test_pipeline_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.written(stage(spark, docs, d), "stage")
        if k < 3:
            assert out.columns == docs.columns
        if k < 2:
            assert out.count() < docs.count()
        if k == 1:
            rows = [(r["doc_id"], r["text"], None) for r in docs.collect()]
            assert sorted(r["doc_id"] for r in out.collect()) == sorted({c for _, _, c in classes(rows, partenum.Join())})
        docs = out
    assert docs.count() > 0


def test_lm_layout_changes_nothing(spark, monkeypatch):
    """Counts are the same in any layout of chunks, ranges and shards; scores differ by the draws alone."""
    texts = [f"a{k} b{k} c{k % 7}" for k in range(60)] + ["", None, "a1 b1 unseen"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    plain = {r["doc_id"]: r for r in pitmanyor.score(docs).collect()}
    assert len(plain) == len(texts)
    monkeypatch.setattr(pitmanyor, "CHUNK_ROWS", 3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "29")
    try:
        many = {r["doc_id"]: r for r in pitmanyor.score(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for k, r in plain.items():
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (many[k]["n_tokens"], many[k]["n_known"], many[k]["train_tokens"])
        assert many[k]["base_score"] == pytest.approx(r["base_score"])
        assert many[k]["score"] == pytest.approx(r["score"], abs=0.7)


def test_lm_beats_the_base_on_held_out_texts(spark):
    """Texts of fixed word pairs: the words before tell what follows."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{2 * k} w{2 * k + 1}" for k in rng.integers(0, 40, 12)) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["held_out"]: r for r in pitmanyor.perplexity(pitmanyor.score(docs)).collect()}
    assert got[True]["perplexity"] < 0.25 * got[True]["base_perplexity"]


def test_lm_packed_integers():
    rng = np.random.default_rng(6)
    for n in (0, 1, 5, 3000):
        arrays = [np.sort(rng.integers(0, 1 << 63, n).astype(np.uint64)), rng.integers(0, 9, n).astype(np.uint32), rng.integers(0, 2, n).astype(np.uint8)]
        got = pitmanyor.unpack(pitmanyor.pack(pitmanyor.rises(arrays[0]), *arrays[1:]))
        assert all(np.array_equal(a, b) and a.dtype == b.dtype for a, b in zip([np.cumsum(got[0], dtype=np.uint64), *got[1:]], arrays, strict=True))
