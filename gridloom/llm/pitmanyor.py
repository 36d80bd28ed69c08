"""Language-model scoring by a hierarchical Pitman-Yor model (operator 3).

Words are dishes. A word's context restaurant is the word before it (or the beginning); all
context restaurants share one parent, whose parent is uniform over the training words and one
slot for all unknown ones. Seating is sampled by Gibbs: for every (context, word) the number of
tables is redrawn from its conditional distribution given everything else (exactly, with
generalised Stirling numbers, up to ``EXACT`` customers; in blocks of a tenth of the seated
customers beyond), then the parent's. Discounts come from counts of counts. Predictive
probabilities are averaged over the last ``SAMPLES`` sweeps.

Layout: word hashes are cut into ``g`` ranges, pairs into a grid of ``g`` x ``g`` shards by the
ranges of their context and their word, so the pairs of one frequent word or context lie in
``g`` shards. A chunk of ``CHUNK_ROWS`` documents asks each shard for its distinct pairs and
each range for its words, as packed integers. A shard keeps the pairs that need sampling (a
pair of one customer has one table) as one file in the shared folder, and the lists of what
each chunk asked for. A sweep is one task a shard, which reads the seats of two ranges, and one
task a range, which adds up the tables of its row and its column; every sweep's files are new.
Answers are dealt by chunk; the chunk is read again to add them up. A training text's pair that
its dictionary lacks has one customer, a held-out text's has none. Texts are never shuffled.

Defined results: null and blank texts are one end token; a null doc_id counts as an empty id;
equal rows get equal scores; without training documents all words are unknown, N is 0 and
probabilities are the uniform ones; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.scratch import removed, scratch_dir, spread, written
from gridloom.llm.words import hashed_texts

END = np.uint64(1)
BEGIN = np.uint64(2)
STRENGTH = 1.0
EXACT = 64
SWEEPS, SAMPLES = 4, 2
CHUNK_ROWS = 4_096


def tokens(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text's dishes (words, then the end) and the words before them."""
    return np.append(words, END), np.concatenate([[BEGIN], words])


def pair_keys(dishes: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """Both are hashes already."""
    return dishes ^ (contexts << np.uint64(1) | contexts >> np.uint64(63))


def log_stirling(most: int, d: float) -> np.ndarray:
    """log of generalised Stirling numbers S(c, t) of discount ``d`` for c, t up to ``most``."""
    table = np.full((most + 1, most + 1), -np.inf)
    table[0, 0] = 0.0
    with np.errstate(divide="ignore"):
        for c in range(most):
            t = np.arange(1, c + 2)
            stay = np.where(c - d * t > 0, np.log(np.maximum(c - d * t, 1e-300)), -np.inf) + table[c, 1 : c + 2]
            table[c + 1, 1 : c + 2] = np.logaddexp(table[c, : c + 1], stay)
    return table


def draw_tables(c: np.ndarray, others: np.ndarray, base: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with ``c`` customers, given the restaurant's other tables and the dish's base probability."""
    t = np.minimum(c, 1).astype(np.int64)
    stirling = log_stirling(EXACT, d)
    low = 2
    while low <= EXACT:
        high = min(2 * low - 1, EXACT)
        rows = np.flatnonzero((c >= low) & (c <= high))
        for at in range(0, len(rows), 65_536):
            part = rows[at : at + 65_536]
            step = np.arange(high)
            weight = np.cumsum(np.log(STRENGTH + d * (others[part, None] + step)) + np.log(base[part, None]), axis=1) + stirling[c[part], 1 : high + 1]
            weight = np.exp(weight - weight.max(axis=1, keepdims=True))
            total = np.cumsum(weight, axis=1)
            t[part] = (total < rng.random(len(part))[:, None] * total[:, -1:]).sum(axis=1) + 1
        low = high + 1
    rows = np.flatnonzero(c > EXACT)
    seated = np.ones(len(rows), dtype=np.int64)
    while len(rows):
        size = np.minimum(np.maximum(1, seated // 10), c[rows] - seated)
        new = (STRENGTH + d * (others[rows] + t[rows])) * base[rows]
        t[rows] += rng.binomial(size, new / (new + seated - d * t[rows]))
        seated = seated + size
        left = seated < c[rows]
        rows, seated = rows[left], seated[left]
    return np.minimum(t, c)


class Totals:
    """Sums over all pairs: what the restaurants need to know of each other."""

    def __init__(self, customers: np.ndarray, types: np.ndarray, words: int, ones: tuple[int, int], twos: tuple[int, int]):
        self.customers, self.types, self.words = customers.astype(np.float64), types.astype(np.float64), words
        self.n = int(customers.sum())
        self.discount = ones[0] / max(1, ones[0] + 2 * twos[0]) * 0.98 + 0.01
        self.root_discount = ones[1] / max(1, ones[1] + 2 * twos[1]) * 0.98 + 0.01
        self.sweeps: list[tuple[np.ndarray, float]] = []  # tables of each context restaurant, tables of the parent


class Block:
    """The sampler over pairs in memory, sorted by word; ``fit`` runs the same sweeps over tables."""

    def __init__(self, contexts: np.ndarray, counts: np.ndarray, word_of: np.ndarray, n_words: int, seed: int):
        self.contexts, self.counts, self.word_of, self.n_words, self.seed = contexts, counts, word_of, n_words, seed
        self.known = np.bincount(word_of, weights=counts, minlength=n_words) > 0

    def sample(self, totals: Totals, upto: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(tables of pairs, customers of the parent, tables of the parent, parent's probabilities before the sweep) after each sweep."""
        uniform = 1.0 / (totals.words + 1)
        words = np.bincount(self.word_of, weights=self.counts, minlength=self.n_words)
        base = np.maximum(words / max(1, totals.n), uniform * 1e-3)
        tables = np.minimum(self.counts, 1)
        root_tables = np.zeros(self.n_words, dtype=np.int64)
        there, root_there = totals.types, float(totals.words)
        for sweep in range(upto):
            rng = np.random.default_rng((self.seed, sweep))
            tables = draw_tables(self.counts, np.maximum(0.0, there[self.contexts] - tables), base[self.word_of], totals.discount, rng)
            customers = np.bincount(self.word_of, weights=tables, minlength=self.n_words).astype(np.int64)
            root_tables = draw_tables(customers, np.maximum(0.0, root_there - root_tables), np.full(self.n_words, uniform), totals.root_discount, rng)
            yield tables, customers, root_tables, base
            if sweep < len(totals.sweeps):
                there, root_there = totals.sweeps[sweep]
                base = root_probability(customers, root_tables, there.sum(), root_there, totals)


def root_probability(customers: np.ndarray, tables: np.ndarray, all_customers: float, all_tables: float, totals: Totals) -> np.ndarray:
    d = totals.root_discount
    return (customers - d * tables + (STRENGTH + d * all_tables) / (totals.words + 1)) / (STRENGTH + all_customers)


def chunked(documents: DataFrame) -> DataFrame:
    """(chunk, doc_id, train, text): a chunk is a run of rows of one file; a table that isn't read from files is written first."""
    try:
        marked = documents.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    except AnalysisException:
        marked = written(spread(documents.select("doc_id", "text")), "documents").select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    own_id = F.col("doc_id").cast("long")
    train = F.crc32(F.coalesce(own_id.cast("string"), F.lit("")).cast("binary")) % 5 != 1
    chunk = F.xxhash64("__file", F.floor(F.col("__row") / CHUNK_ROWS))
    return marked.select(chunk.alias("chunk"), own_id.alias("doc_id"), train.alias("train"), F.col("text").cast("string").alias("text"))


_KINDS = {1: np.uint8, 4: np.uint32, 8: np.uint64}


def pack(*arrays: np.ndarray) -> bytes:
    """Unsigned arrays as bytes: bytes of equal weight together, then compressed."""
    codec, head, bodies = pa.Codec("zstd"), [len(arrays)], []
    for a in arrays:
        flat = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T
        bodies.append(codec.compress(flat.tobytes(), asbytes=True) if len(a) else b"")
        head += [len(a), a.itemsize, len(bodies[-1])]
    return np.array(head, dtype=np.uint32).tobytes() + b"".join(bodies)


def unpack(data: bytes) -> list[np.ndarray]:
    codec = pa.Codec("zstd")
    count = int(np.frombuffer(data, dtype=np.uint32, count=1)[0])
    head = np.frombuffer(data, dtype=np.uint32, count=3 * count, offset=4).reshape(count, 3).tolist()
    at, out = 4 + 12 * count, []
    for n, size, length in head:
        body = codec.decompress(data[at : at + length], decompressed_size=n * size, asbytes=True) if n else b""
        out.append(np.ascontiguousarray(np.frombuffer(body, dtype=np.uint8).reshape(size, n).T).view(_KINDS[size]).reshape(n))
        at += length
    return out


def rises(values: np.ndarray) -> np.ndarray:
    """Differences of values in order; ``np.cumsum`` undoes it."""
    return np.diff(values, prepend=values.dtype.type(0))


def _rising(values: np.ndarray) -> np.ndarray:
    return np.cumsum(values, dtype=values.dtype)


class Folder:
    """Files in the shared folder; a file appears whole, and attempts write the same content."""

    def __init__(self, uri: str):
        self.system, self.base = fs.FileSystem.from_uri(uri)

    def put(self, name: str, data: bytes) -> None:
        path = f"{self.base}/{name}"
        self.system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        part = f"{path}.{np.random.default_rng().integers(1 << 62):x}"
        with self.system.open_output_stream(part) as out:
            out.write(data)
        try:
            self.system.move(part, path)
        except OSError:  # an earlier attempt's file is there, and this store doesn't replace it
            if self.get(name) is None:
                raise
            self.system.delete_file(part)

    def get(self, name: str) -> bytes | None:
        path = f"{self.base}/{name}"
        if self.system.get_file_info(path).type == fs.FileType.NotFound:
            return None
        with self.system.open_input_stream(path) as file:
            return file.read()

    def put_rows(self, name: str, marks: list[int], blobs: list[bytes]) -> None:
        out = pa.BufferOutputStream()
        table = pa.table({"mark": pa.array(marks, pa.int64()), "blob": pa.array(blobs, pa.binary())})
        with pa.ipc.new_stream(out, table.schema) as writer:
            writer.write_table(table, max_chunksize=64)
        self.put(name, out.getvalue().to_pybytes())

    def rows(self, name: str) -> Iterator[tuple[int, bytes]]:
        data = self.get(name)
        for batch in pa.ipc.open_stream(data) if data else ():
            yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)


def range_of(words: np.ndarray, g: int) -> np.ndarray:
    """Which of ``g`` ranges of hashes each word is in."""
    return ((words >> np.uint64(32)) * np.uint64(g) >> np.uint64(32)).astype(np.int64)


def _rows_of(chunk: int, dishes: np.ndarray, contexts: np.ndarray, train: np.ndarray, test: np.ndarray, g: int) -> pa.RecordBatch:
    """What a chunk asks for: distinct pairs by shard, words by range (as -1 - range) with their training counts."""
    words, place = np.unique(np.concatenate([dishes, contexts]), return_inverse=True)
    w, u = place[: len(dishes)], place[len(dishes) :]
    of_word = np.bincount(w, weights=train, minlength=len(words)).astype(np.uint64)
    of_word[words == BEGIN] = train[contexts == BEGIN].sum()
    ranges = range_of(words, g)
    cell = ranges[u] * g + ranges[w]
    order = np.argsort((cell * len(words) + u) * len(words) + w)
    u, w, cell, train, test = u[order], w[order], cell[order], train[order], test[order]
    shards, blobs = [], []
    cuts = np.searchsorted(cell, np.arange(g * g + 1))
    for shard in np.flatnonzero(np.diff(cuts)).tolist():
        part = slice(cuts[shard], cuts[shard + 1])
        own_u, ui = np.unique(u[part], return_inverse=True)
        own_w, wi = np.unique(w[part], return_inverse=True)
        shards.append(shard)
        blobs.append(pack(rises(words[own_u]), rises(words[own_w]), rises(ui.astype(np.uint32)), wi.astype(np.uint32), train[part].astype(np.uint32), (test[part] > 0).astype(np.uint8)))
    cuts = np.searchsorted(ranges, np.arange(g + 1))
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        part = slice(cuts[k], cuts[k + 1])
        shards.append(-1 - k)
        blobs.append(pack(rises(words[part]), of_word[part]))
    return pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array([chunk] * len(shards), pa.int64()), pa.array(blobs, pa.binary())], ["shard", "chunk", "blob"])


def _wanted(g: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Distinct (context, word) pairs of each chunk with how often training and held-out texts have them."""

    def distinct(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        dishes, contexts, train, test = (np.concatenate([h[i] for h in parts]) for i in range(4))
        parts.clear()
        _, first, place = np.unique(pair_keys(dishes, contexts), return_index=True, return_inverse=True)
        return dishes[first], contexts[first], *(np.bincount(place, weights=n, minlength=len(first)).astype(np.uint32) for n in (train, test))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        merged: list[tuple[np.ndarray, ...]] = []
        now, size, kept = 0, 0, 0
        for batch in batches:
            chunks, train = np.asarray(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
            for i, words in hashed_texts(batch.column(2)):
                if (held or merged) and (chunks[i] != now or kept > 2_000_000):
                    merged.extend(held)
                    held.clear()
                    yield _rows_of(now, *distinct(merged), g)
                    size, kept = 0, 0
                now = int(chunks[i])
                dishes, contexts = tokens(words)
                of_train = np.full(len(dishes), train[i], dtype=np.uint32)
                held.append((dishes, contexts, of_train, 1 - of_train))
                size += len(dishes)
                if size > 500_000:
                    merged.append(distinct(held))
                    size, kept = 0, kept + len(merged[-1][0])
        if held or merged:
            merged.extend(held)
            held.clear()
            yield _rows_of(now, *distinct(merged), g)

    return run


def _gathered(folder: str) -> Callable[[tuple, pa.Table], pa.Table]:
    """Counts a shard's pairs or a range's words over all chunks and writes them, with what each chunk asked for."""

    def together(parts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        values, place = np.unique(np.concatenate(parts), return_inverse=True)
        return values, np.split(place, np.cumsum([len(p) for p in parts])[:-1])

    def of_words(shard: int, chunks: list[int], blobs: list[list[np.ndarray]], files: Folder) -> list[int]:
        words, places = together([_rising(b[0]) for b in blobs])
        n = np.zeros(len(words), dtype=np.uint64)
        for place, (_, counts) in zip(places, blobs, strict=True):
            n[place] += counts
        files.put(f"words/{-1 - shard}", pack(rises(words), n))
        files.put_rows(f"asked/{shard}", chunks, [pack(rises(p.astype(np.uint32))) for p in places])
        dishes = n[words != BEGIN]
        return [0, 0, int(dishes.sum()), int((dishes > 0).sum())]

    def of_pairs(shard: int, chunks: list[int], blobs: list[list[np.ndarray]], files: Folder) -> list[int]:
        us, u_places = together([_rising(b[0]) for b in blobs])
        ws, w_places = together([_rising(b[1]) for b in blobs])
        keys = [u[_rising(b[2])] * len(ws) + w[b[3]] for u, w, b in zip(u_places, w_places, blobs, strict=True)]
        pairs, places = together(keys)
        c = np.zeros(len(pairs), dtype=np.uint64)
        for place, b in zip(places, blobs, strict=True):
            c[place] += b[4]
        # one customer, one table: only held-out texts need to be told
        asked = [p[(c[p] > 1) | (c[p] == 1) & (b[5] > 0)] for p, b in zip(places, blobs, strict=True)]
        kept = c > 1
        for p in asked:
            kept[p] = True
        new = (np.cumsum(kept) - 1).astype(np.uint32)
        u, w = pairs // len(ws), pairs % len(ws)
        counts = [np.bincount(x[rows], minlength=len(of)).astype(np.uint32) for x, of in ((u, us), (w, ws)) for rows in (c > 0, c == 1)]
        files.put(f"types/{shard}", pack(rises(us), counts[0], counts[1], rises(ws), counts[2], counts[3]))
        own_u, u = np.unique(u[kept], return_inverse=True)
        own_w, w = np.unique(w[kept], return_inverse=True)
        files.put(f"pairs/{shard}", pack(rises(us[own_u]), rises(ws[own_w]), rises(u.astype(np.uint32)), w.astype(np.uint32), c[kept]))
        files.put_rows(f"asked/{shard}", chunks, [pack(rises(new[p])) for p in asked])
        return [int((c == 1).sum()), int((c == 2).sum()), 0, 0]

    def run(key: tuple, group: pa.Table) -> pa.Table:
        shard, files = key[0].as_py(), Folder(folder)
        blobs = [unpack(b) for b in group.column("blob").to_pylist()]
        sums = (of_words if shard < 0 else of_pairs)(shard, group.column("chunk").to_pylist(), blobs, files)
        return pa.table([pa.array([x], pa.int64()) for x in sums], ["ones", "twos", "n", "words"])

    return run


def _over(spark: SparkSession, n: int, work: Callable[[int], tuple[float, float]]) -> tuple[float, float]:
    """Runs ``work`` for each number below ``n`` in a task of its own; the sums of what it returns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [work(k) for k in batch.column(0).to_pylist()]
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.float64()) for x in zip(*sums, strict=True)], ["a", "b"])

    row = spark.range(0, n, 1, n).mapInArrow(run, "a double, b double").agg(F.sum("a"), F.sum("b")).first()
    return row[0] or 0.0, row[1] or 0.0


class Seating(NamedTuple):
    """What the sweeps leave: files below ``folder``, and for each sampled sweep its number and the parent's customers and tables."""

    totals: Totals
    folder: str
    g: int
    sampled: list[tuple[int, float, float]]


def _typed(folder: str, g: int) -> Callable[[int], tuple[float, float]]:
    """Adds up how many pairs, and pairs of one customer, a range's words have as dishes and as contexts."""

    def work(k: int) -> tuple[float, float]:
        files = Folder(folder)
        if (data := files.get(f"words/{k}")) is None:
            return 0, 0
        words = _rising(unpack(data)[0])
        types, ones, room, room_ones = (np.zeros(len(words), dtype=np.uint64) for _ in range(4))
        for other in range(g):
            for shard, at, (all_of, ones_of) in ((k * g + other, 0, (room, room_ones)), (other * g + k, 3, (types, ones))):
                if data := files.get(f"types/{shard}"):
                    keys, a, b = unpack(data)[at : at + 3]
                    place = np.searchsorted(words, _rising(keys))
                    all_of[place] += a
                    ones_of[place] += b
        files.put(f"ones/{k}", pack(ones, room_ones))
        files.put(f"sweep0/seats/{k}", pack(np.zeros_like(room), np.zeros_like(room), room))
        return int((types == 1).sum()), int((types == 2).sum())

    return work


def _drawn(folder: str, g: int, sweep: int, add: bool, totals: Totals, parent: tuple[float, float]) -> Callable[[int], tuple[float, float]]:
    """Redraws the tables of a shard's pairs and adds them up by context and by word."""

    def work(shard: int) -> tuple[float, float]:
        files = Folder(folder)
        if (data := files.get(f"pairs/{shard}")) is None:
            return 0, 0
        us, ws, u, w, c = unpack(data)
        u, c = _rising(u), c.astype(np.int64)
        row, column = divmod(shard, g)
        at_u = np.searchsorted(_rising(unpack(files.get(f"words/{row}"))[0]), _rising(us))
        words, n = unpack(files.get(f"words/{column}"))
        at_w = np.searchsorted(_rising(words), _rising(ws))
        there = unpack(files.get(f"sweep{sweep}/seats/{row}"))[2][at_u].astype(np.float64)
        customers, root, _ = (x[at_w].astype(np.float64) for x in unpack(files.get(f"sweep{sweep}/seats/{column}")))
        if sweep:
            base = root_probability(customers, root, *parent, totals)
            t, added = (x.astype(np.int64) for x in unpack(files.get(f"sweep{sweep}/tables/{shard}")))
        else:
            base = np.maximum(n[at_w] / max(1, totals.n), 1e-3 / (totals.words + 1))
            t, added = np.minimum(c, 1), np.zeros_like(c)
        t = draw_tables(c, np.maximum(0.0, there[u] - t), base[w], totals.discount, np.random.default_rng((1, shard, sweep)))
        sums = [np.bincount(x[c > 1], weights=t[c > 1], minlength=len(of)).astype(np.uint64) for x, of in ((u, us), (w, ws))]
        files.put(f"sweep{sweep + 1}/tables/{shard}", pack(t.astype(np.uint64), (added + t * add).astype(np.uint64)))
        files.put(f"sweep{sweep + 1}/sums/{shard}", pack(rises(at_u.astype(np.uint32)), sums[0], rises(at_w.astype(np.uint32)), sums[1]))
        return 0, 0

    return work


def _seated(folder: str, g: int, sweep: int, totals: Totals, there: float) -> Callable[[int], tuple[float, float]]:
    """Customers of the parent for a range's words, their tables redrawn, and tables in the words' own restaurants."""

    def work(k: int) -> tuple[float, float]:
        files = Folder(folder)
        if (data := files.get(f"ones/{k}")) is None:
            return 0, 0
        customers, rooms = unpack(data)
        for other in range(g):
            for shard, at, of in ((k * g + other, 0, rooms), (other * g + k, 2, customers)):
                if data := files.get(f"sweep{sweep + 1}/sums/{shard}"):
                    place, sums = unpack(data)[at : at + 2]
                    of[_rising(place)] += sums
        before = unpack(files.get(f"sweep{sweep}/seats/{k}"))[1].astype(np.float64)
        uniform = np.full(len(customers), 1.0 / (totals.words + 1))
        root = draw_tables(customers.astype(np.int64), np.maximum(0.0, there - before), uniform, totals.root_discount, np.random.default_rng((2, k, sweep)))
        files.put(f"sweep{sweep + 1}/seats/{k}", pack(customers, root.astype(np.uint64), rooms))
        return int(customers.sum()), int(root.sum())

    return work


def fit(own: DataFrame, sweeps: int, samples: int) -> Seating:
    """Counts pairs and words and runs the sweeps; each brings one row of sums to the driver."""
    spark = own.sparkSession
    folder = scratch_dir(spark, "lm")
    g = max(1, math.isqrt(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    asked = own.select("chunk", "train", "text").mapInArrow(_wanted(g), "shard int, chunk long, blob binary")
    sums = asked.groupBy("shard").applyInArrow(_gathered(folder), "ones long, twos long, n long, words long")
    ones, twos, n, words = (x or 0 for x in sums.agg(*[F.sum(c) for c in sums.columns]).first())
    root_ones, root_twos = _over(spark, g, _typed(folder, g))
    removed(spark, f"{folder}/types")
    totals = Totals(np.array([n]), np.array([0]), words, (ones, int(root_ones)), (twos, int(root_twos)))
    parent, sampled = (0.0, float(words)), []
    for sweep in range(sweeps):
        add = sweep >= sweeps - samples
        _over(spark, g * g, _drawn(folder, g, sweep, add, totals, parent))
        parent = _over(spark, g, _seated(folder, g, sweep, totals, parent[1]))
        removed(spark, f"{folder}/sweep{sweep}/tables")
        removed(spark, f"{folder}/sweep{sweep + 1}/sums")
        if add:
            sampled.append((sweep + 1, *parent))
    return Seating(totals, folder, g, sampled)


def _answers(spark: SparkSession, seating: Seating) -> DataFrame:
    """(chunk, kind, blob): 0 for pairs with customers and added tables, 1 for words with counts and each sample's customers, tables and tables as contexts."""
    folder, g, last = seating.folder, seating.g, seating.sampled[-1][0]

    def of_pairs(shard: int, files: Folder) -> Iterator[tuple[int, int, bytes]]:
        if (data := files.get(f"pairs/{shard}")) is None:
            return
        us, ws, u, w, c = unpack(data)
        us, ws, u = _rising(us), _rising(ws), _rising(u)
        added = unpack(files.get(f"sweep{last}/tables/{shard}"))[1]
        for chunk, blob in files.rows(f"asked/{shard}"):
            at = _rising(unpack(blob)[0])
            if len(at):
                own_u, ui = np.unique(u[at], return_inverse=True)
                own_w, wi = np.unique(w[at], return_inverse=True)
                yield chunk, 0, pack(rises(us[own_u]), rises(ws[own_w]), rises(ui.astype(np.uint32)), wi.astype(np.uint32), c[at], added[at])

    def of_words(k: int, files: Folder) -> Iterator[tuple[int, int, bytes]]:
        if (data := files.get(f"words/{k}")) is None:
            return
        words, n = unpack(data)
        words = _rising(words)
        seats = [x for sweep, *_ in seating.sampled for x in unpack(files.get(f"sweep{sweep}/seats/{k}"))]
        for chunk, blob in files.rows(f"asked/{-1 - k}"):
            at = _rising(unpack(blob)[0])
            yield chunk, 1, pack(rises(words[at]), n[at], *[x[at] for x in seats])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Folder(folder)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                for chunk, kind, blob in of_pairs(k, files) if k < g * g else of_words(k - g * g, files):
                    yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([kind], pa.int32()), pa.array([blob], pa.binary())], ["chunk", "kind", "blob"])

    return spark.range(0, g * g + g, 1, g * g + g).mapInArrow(run, "chunk long, kind int, blob binary")


def _dictionaries(answers: DataFrame, folder: str) -> int:
    """Writes one dictionary file for each chunk, of all its answers; how many there are."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        Folder(folder).put_rows(f"books/{key[0].as_py() & (1 << 64) - 1:016x}", group.column("kind").to_pylist(), group.column("blob").to_pylist())
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int64())})

    return answers.groupBy("chunk").applyInArrow(run, "chunk long").count()


class _Dictionary:
    """A chunk's words with counts, parent probabilities and shares of the parent; its pairs with what they have of their own."""

    def __init__(self, files: Folder, chunk: int, seating: Seating):
        totals, samples = seating.totals, len(seating.sampled)
        words, keys, own = [], [np.zeros(0, dtype=np.uint64)], [np.zeros(0)]
        for kind, blob in files.rows(f"books/{chunk & (1 << 64) - 1:016x}"):
            if kind:
                words.append(unpack(blob))
            else:
                us, ws, u, w, c, added = unpack(blob)
                keys.append(pair_keys(_rising(ws)[w], _rising(us)[_rising(u)]))
                own.append(c - totals.discount * added / samples)
        if not words:
            raise RuntimeError("the documents changed between the passes")
        self.words, first = np.unique(np.concatenate([_rising(x[0]) for x in words]), return_index=True)
        self.counts, *seats = (np.concatenate([x[i] for x in words])[first].astype(np.float64) for i in range(1, 2 + 3 * samples))
        self.bases = np.stack([root_probability(seats[3 * i], seats[3 * i + 1], *seating.sampled[i][1:], totals) for i in range(samples)], axis=1)
        self.shares = np.stack([(STRENGTH + totals.discount * seats[3 * i + 2]) / samples for i in range(samples)], axis=1)
        self.pairs, first = np.unique(np.concatenate(keys), return_index=True)
        self.own, self.single = np.concatenate(own)[first], 1 - totals.discount
        self.begin = int(self._word(np.array([BEGIN]))[0])

    def _word(self, words: np.ndarray) -> np.ndarray:
        at = _places(self.words, words)
        if not np.array_equal(self.words[at], words):
            raise RuntimeError("the documents changed between the passes")
        return at

    def find(self, texts: list[np.ndarray], train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where texts end, and counts and log10 probabilities of all their dishes; ``train`` tells of each text."""
        dishes, contexts = (np.concatenate(x) for x in zip(*map(tokens, texts), strict=True))
        lengths = np.array([len(x) + 1 for x in texts])
        ends = np.cumsum(lengths)
        at = self._word(dishes)
        before = np.append(self.begin, at[:-1])
        before[ends[:-1]] = self.begin
        probability = (self.shares[before] * self.bases[at]).sum(axis=1)
        own = np.repeat(np.where(train, self.single, 0.0), lengths)
        if len(self.pairs):
            keys = pair_keys(dishes, contexts)
            place = _places(self.pairs, keys)
            own = np.where(self.pairs[place] == keys, self.own[place], own)
        # a word is followed each time it occurs, and each text begins
        known = self.counts[before]
        return ends, self.counts[at], np.log10((own + probability) / (STRENGTH + known))


def _places(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """``np.searchsorted``, at most the last place; searching in order keeps to the cache."""
    order = np.argsort(wanted)
    out = np.empty(len(wanted), dtype=np.int64)
    out[order] = np.minimum(np.searchsorted(values, wanted[order]), len(values) - 1)
    return out


def score(documents: DataFrame, sweeps: int = SWEEPS, samples: int = SAMPLES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = documents.sparkSession
    own = chunked(documents)
    seating = fit(own, sweeps, samples)
    totals, folder = seating.totals, seating.folder
    _dictionaries(_answers(spark, seating), folder)
    for name in ("pairs", "words", "ones", "asked", *(f"sweep{k}" for k in range(sweeps + 1))):
        removed(spark, f"{folder}/{name}")
    n, floor = totals.n, 0.5
    denominator = math.log10(n + floor * (totals.words + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, now, book = Folder(folder), None, None
        for batch in batches:
            chunks, train = np.asarray(batch.column(0)), batch.column(2).to_numpy(zero_copy_only=False)
            out: list[tuple[int, int, float, float]] = []
            texts: list[np.ndarray] = []

            def flush() -> None:
                if not texts:
                    return
                ends, counts, scores = book.find(texts, train[len(out) : len(out) + len(texts)])
                known, base = counts > 0, np.log10(counts + floor)
                for begin, end in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    out.append((end - begin, int(known[begin:end].sum()), float(base[begin:end].sum()) - (end - begin) * denominator, float(scores[begin:end].sum())))
                texts.clear()

            size = 0
            for i, words in hashed_texts(batch.column(3)):
                if chunks[i] != now or size > 500_000:
                    flush()
                    size = 0
                if chunks[i] != now:
                    now, book = chunks[i], None
                    book = _Dictionary(files, int(now), seating)
                texts.append(words)
                size += len(words) + 1
            flush()
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)] if out else [pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64()), pa.array([], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(~train), columns[0], columns[1], pa.array(np.full(len(train), n, dtype=np.int64)), columns[2], columns[3]], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return own.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def perplexity(scored: DataFrame) -> DataFrame:
    """held_out, tokens, perplexity, base_perplexity over the scored documents."""
    each = scored.groupBy("held_out").agg(F.sum("n_tokens").alias("tokens"), F.sum("score").alias("score"), F.sum("base_score").alias("base"))
    return each.select("held_out", "tokens", F.pow(F.lit(10.0), -F.col("score") / F.col("tokens")).alias("perplexity"), F.pow(F.lit(10.0), -F.col("base") / F.col("tokens")).alias("base_perplexity"))


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
