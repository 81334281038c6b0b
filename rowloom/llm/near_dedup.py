"""Near-duplicate documents by consistent weighted sampling over TF-IDF shingles.

1. Document frequencies of all shingles go to a count-min sketch of fixed size, summed over tasks by blocks of cells.
   A cell adds to a shingle's frequency what others put there: a share of the documents that doesn't grow with their
   number, so that weights behave alike at every size. Weights lie between 1 and 1 + ``idf`` times the frequency in a
   document, so that large groups of copies, whose shingles are frequent for that reason, stay similar.
2. Rows are read once for their samples and written with a number of their own, the digest of their shingles and the
   compressed text. Rows with equal shingles are one node before any pair is looked at; its number is the least row's.
   Ids play no part until the end, so that they may be null or repeated.
3. Improved consistent weighted sampling gives each node its samples, in bands. Each member of a band's bucket is linked
   to the least member; links are verified by the exact weighted Jaccard similarity of the two texts, and connected by
   large-star and small-star steps, each written to the shared folder.
4. What a bucket still holds apart is compared in full: members outside the least one's component are compared with all
   others, dealt to chunks of bounded size. Found links are connected as before.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, remove, shared_path, table, texts, tune

CELLS, BLOCK = 1 << 20, 1 << 12
#: Members of a bucket that are compared with as many others in one group, about.
CHUNK = 200
M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a number."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = WordHashes()


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * M1
        h = (h ^ (h >> np.uint64(29))) * M2
        return h ^ (h >> np.uint64(32))


def shingles(text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of runs of ``size`` lower-case words, ascending, and how often each occurs; a shorter text is one shingle, none without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(size, len(words))
    n = len(words) - size + 1
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = out * M1 + h[k : k + n]
    return np.unique(mixed(out), return_counts=True)


def document_frequencies(docs: DataFrame, size: int) -> np.ndarray:
    """The sketch over all documents: CELLS sums of 64 bits, whatever the table's size."""

    def count(batches):
        cells, seen = np.zeros(CELLS, np.int64), False
        for b in batches:
            for t in b.column("text").to_pylist():
                np.add.at(cells, (shingles(t, size)[0] & np.uint64(CELLS - 1)).astype(np.int64), 1)
            seen = True
        if seen:
            pack = zstandard.ZstdCompressor(3).compress
            yield pa.RecordBatch.from_arrays([pa.array(range(CELLS // BLOCK), pa.int32()), pa.array([pack(x.astype("<u4").tobytes()) for x in cells.reshape(-1, BLOCK)], pa.binary())], names=["block", "counts"])

    def add(key, rows):
        unpack, total = zstandard.ZstdDecompressor().decompress, np.zeros(BLOCK, np.int64)
        for x in rows.column("counts").to_pylist():  # one for each task
            total += np.frombuffer(unpack(x), "<u4")
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    sums = docs.select("text").mapInArrow(count, "block int, counts binary").groupBy("block").applyInArrow(add, "block int, counts binary")
    out = np.zeros((CELLS // BLOCK, BLOCK), np.int64)
    for r in sums.collect():  # CELLS numbers
        out[r["block"]] = np.frombuffer(r["counts"], "<i8")
    return out.reshape(-1)


class Weights:
    """TF-IDF weights: frequency in the document times 1 + idf * (log inverse document frequency, as a part of its most)."""

    def __init__(self, cells: np.ndarray, n: int, idf: float):
        inverse = np.log1p(max(n, 1) / np.maximum(cells, 1))
        self.of_cell = (1 + idf * inverse / np.log1p(max(n, 1))).astype(np.float32)

    def __call__(self, found: np.ndarray, times: np.ndarray) -> np.ndarray:
        return times.astype(np.float32) * self.of_cell[(found & np.uint64(CELLS - 1)).astype(np.int64)]


class Sampler:
    """Improved consistent weighted sampling. The random numbers of a shingle are rows of three tables, chosen by different bits of its hash: two shingles hardly ever share all three."""

    ROWS, STEP = 1 << 11, 1 << 10

    def __init__(self, samples: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        shape = (self.ROWS, samples)
        self.r, self.b, self.c = (x.astype(np.float32) for x in (rng.gamma(2, 1, shape), rng.random(shape), np.log(rng.gamma(2, 1, shape))))
        self.inverse = 1 / self.r

    def __call__(self, found: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For each sample a hash of the shingle with the least value and of its level."""
        best, out, n = None, None, self.r.shape[1]
        logs = np.log(weights)[:, None]
        for s in range(0, len(found), self.STEP):
            f = found[s : s + self.STEP]
            i, j, k = ((f >> np.uint64(shift)).astype(np.int64) & (self.ROWS - 1) for shift in (53, 42, 31))
            b = self.b.take(j, 0)
            level = np.floor(logs[s : s + self.STEP] * self.inverse.take(i, 0) + b)
            value = self.c.take(k, 0) - self.r.take(i, 0) * (level - (b - 1))
            least_value = value.min(axis=0)
            at = np.flatnonzero(value == least_value)[::-1]  # of equal values the first shingle's stays
            least = np.empty(n, np.int64)
            least[at % n] = at // n
            with np.errstate(over="ignore"):
                h = mixed(f[least] + level[least, np.arange(n)].astype(np.int64).view(np.uint64) * M2)
            if best is None:
                best, out = least_value, h
            else:
                out = np.where(least_value < best, h, out)
                best = np.minimum(least_value, best)
        return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of (ascending shingles, weights)."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    both = b[0][at] == a[0]
    least = np.minimum(a[1], b[1][at])[both].sum(dtype=np.float64)
    return float(least / (a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64) - least))


def sorted_join(a: DataFrame, b: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A sort-merge join: both sides grow with the input, so neither is sent whole to the tasks; skewed keys are split by AQE."""
    return a.join(b.hint("merge"), on, how)


def components(links: DataFrame, under: str | None = None) -> DataFrame:
    """id and least id of its component, for links (a, b) of integers, by large-star and small-star steps until nothing changes."""
    links = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links", under)
    before = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = sorted_join(both.filter("b > a"), least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = materialize(large, "large-star", under)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        links = materialize(sorted_join(large, least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "small-star", under)
        now = links.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if now == before:
            return links.select(F.col("a").alias("id"), F.col("b").alias("least"))
        before = now


def bridges(members: list[tuple[int, int, int, np.ndarray, np.ndarray]], threshold: float) -> list[tuple[int, int]]:
    """Links that connect members (node, component, side, shingles, weights) of different components that are alike.

    Members of two sides are compared across them, those of one side with each other; links within what is connected
    already are left out.
    """
    n, top = len(members), {c: c for _, c, _, _, _ in members}

    def find(c):
        while top[c] != c:
            top[c] = c = top[top[c]]
        return c

    vocabulary, at = np.unique(np.concatenate([m[3] for m in members]), return_inverse=True)
    weights, sizes = np.concatenate([m[4] for m in members]), np.asarray([len(m[3]) for m in members])
    starts = np.cumsum(sizes) - sizes
    totals = np.add.reduceat(weights, starts, dtype=np.float64)
    component, side = np.unique([m[1] for m in members], return_inverse=True)[1], np.asarray([m[2] for m in members])
    table, out = np.zeros(len(vocabulary), np.float32), []
    both = len(np.unique(side)) > 1
    for i in range(n - 1):
        open_ = component[i + 1 :] != component[i]
        if both:
            open_ &= side[i + 1 :] != side[i]
        if not open_.any():
            continue
        first, last = starts[i], starts[i] + sizes[i]
        table[at[first:last]] = weights[first:last]
        shared = np.add.reduceat(np.minimum(table[at[last:]], weights[last:]), starts[i + 1 :] - last, dtype=np.float64)
        table[at[first:last]] = 0
        alike = shared / (totals[i + 1 :] + totals[i] - shared) >= threshold - 1e-6
        for j in (np.flatnonzero(alike & open_) + i + 1).tolist():
            a, b = find(members[i][1]), find(members[j][1])
            if a != b and similarity(members[i][3:], members[j][3:]) >= threshold:
                top[a] = b
                out.append((members[i][0], members[j][0]))
    return out


def near_duplicates(df: DataFrame, threshold: float = 0.8, size: int = 5, bands: int = 16, rows: int = 4, idf: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (the least id of the class), exact_id (the least id with equal shingles) and class_key for every row.

    Texts without words are one class. Classes are of rows, not ids: rows that repeat an id each get a row, with the
    class of their own text, and two classes can then have one class_id; ``class_key`` tells them apart. Null ids stay
    null and are the least of a class only where it has no others. Very long texts are compared whole; an empty table
    gives no rows. A pair at the threshold shares a bucket with probability 1 - (1 - threshold ** rows) ** bands,
    0.9998 by default; one that does is in one class, however large the bucket.
    """
    spark = df.sparkSession
    tune(spark)
    scratch = shared_path(spark, "near")
    docs = texts(df, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    n = docs.count()
    cells = document_frequencies(docs, size)
    sent = spark.sparkContext.broadcast((cells, n, idf))  # CELLS numbers
    state: dict = {}

    def weights() -> Weights:
        if "w" not in state:
            state["w"] = Weights(*sent.value)
        return state["w"]

    def sample(batches):
        """Each row with the digest of its shingles, the hashes of its bands, and its text, compressed."""
        sampler, w, pack = Sampler(bands * rows), weights(), zstandard.ZstdCompressor(3).compress
        for b in batches:
            same, keys, packed = [], [], []
            for t in b.column("text").to_pylist():
                found, times = shingles(t, size)
                same.append(xxhash.xxh3_128_digest(found.tobytes() + times.tobytes()))
                samples = sampler(found, w(found, times)).tobytes() if len(found) else b""
                keys.append(b"".join(xxhash.xxh3_64_digest(samples[8 * rows * k : 8 * rows * (k + 1)], seed=k) for k in range(bands)) if samples else b"")
                packed.append(pack(t.encode(errors="replace")))
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), *(pa.array(x, pa.binary()) for x in (same, keys, packed))], names=["row", "doc_id", "same", "keys", "packed"])

    signed = docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(sample, "row bigint, doc_id bigint, same binary, keys binary, packed binary")
    signed = materialize(signed, "samples", scratch)
    exact = materialize(signed.groupBy("same").agg(F.min("row").alias("node"), F.min("doc_id").alias("exact_id")), "nodes", scratch)

    def buckets(batches):
        """A row for each band of a node: the hash of its bucket."""
        for b in batches:
            at, keys = [], []
            for i, x in zip(b.column("row").to_pylist(), b.column("keys").to_pylist(), strict=True):
                if x:
                    at.append(i), keys.append(x)
            at, keys = np.repeat(np.asarray(at, np.int64), bands), np.frombuffer(b"".join(keys), "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(keys)], names=["node", "k"])

    nodes = exact.select(F.col("node").alias("row"))
    banded = materialize(sorted_join(signed.select("row", "keys"), nodes, "row", "left_semi").mapInArrow(buckets, "node bigint, k bigint"), "bands", scratch)
    centres = banded.groupBy("k").agg(F.min("node").alias("b"), F.count("*").alias("n")).filter("n > 1")
    members = materialize(sorted_join(banded, centres, "k").select("k", "node", "b", "n"), "members", scratch)
    pairs = members.filter("node <> b").select(F.col("node").alias("a"), "b").distinct()
    shared = members.select(F.col("node").alias("row")).distinct()
    read = materialize(sorted_join(signed.select("row", "packed"), shared, "row", "left_semi"), "candidates", scratch)

    def opened(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
        found, times = shingles(zstandard.ZstdDecompressor().decompress(packed).decode(), size)
        return found, weights()(found, times)

    def verify(batches):
        held: dict = {}

        def vector(i, packed):
            if i not in held:
                if len(held) > 500:
                    held.clear()
                held[i] = opened(packed)
            return held[i]

        for b in batches:
            a, c, x, y = (b.column(k).to_pylist() for k in ("a", "b", "x", "y"))
            ok = [similarity(vector(*p), vector(*q)) >= threshold for p, q in zip(zip(a, x, strict=True), zip(c, y, strict=True), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    first, second = read.select(F.col("row").alias("a"), F.col("packed").alias("x")), read.select(F.col("row").alias("b"), F.col("packed").alias("y"))
    near = sorted_join(sorted_join(pairs, first, "a"), second, "b").select("a", "b", "x", "y").mapInArrow(verify, "a bigint, b bigint")
    joined = components(near, scratch)

    # all else that buckets hold: members that no verified link connects with the least one are compared with all others
    component = lambda c, name: joined.select(F.col("id").alias(c), F.col("least").alias(name))
    placed = sorted_join(sorted_join(members.filter("n > 2").select("k", "node", "b"), component("node", "own"), "node", "left"), component("b", "top"), "b", "left")
    placed = placed.select("k", "node", F.coalesce("own", "node").alias("component"), F.coalesce("top", "b").alias("main")).withColumn("rest", F.col("component") != F.col("main"))
    sizes = placed.groupBy("k").agg(F.sum(F.col("rest").cast("long")).alias("r"), F.count("*").alias("n"), F.min("component").alias("c"), F.max("component").alias("d"))
    chunks = lambda of: F.ceil(of / CHUNK)
    sizes = sizes.filter("c <> d").select("k", chunks(F.col("r")).alias("rests"), chunks(F.col("n") - F.col("r")).alias("mains"))
    dealt = sorted_join(placed, sizes, "k").withColumn("chunk", F.when(F.col("rest"), F.pmod(F.xxhash64("node", "k"), "rests")).otherwise(-1 - F.pmod(F.xxhash64("node", "k"), "mains")))
    upto = lambda of: F.transform(F.sequence(F.lit(1).cast("long"), of), lambda x: x - 1)
    others = F.when(F.col("rest"), F.concat(upto(F.col("rests")), F.transform(upto(F.col("mains")), lambda x: -1 - x))).otherwise(upto(F.col("rests")))
    dealt = dealt.select("k", "node", "component", "chunk", F.explode(others).alias("other"))
    dealt = dealt.select("k", "component", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), F.col("node").alias("row"))

    def compare(group):
        ids, component, side, packed = (group.column(c).to_pylist() for c in ("row", "component", "chunk", "packed"))
        links = bridges([(i, c, s, *opened(x)) for i, c, s, x in zip(ids, component, side, packed, strict=True)], threshold) if len(set(component)) > 1 else []
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    more = materialize(sorted_join(dealt, read, "row").groupBy("k", "i", "j").applyInArrow(compare, "a bigint, b bigint"), "bridges", scratch)
    if not more.isEmpty():
        joined = components(more.unionByName(joined.select(F.col("id").alias("a"), F.col("least").alias("b"))), scratch)
    found = sorted_join(exact, component("node", "least"), "node", "left").withColumn("class_key", F.coalesce("least", "node"))
    least = found.groupBy("class_key").agg(F.min("exact_id").alias("class_id"))
    named = sorted_join(found.select("same", "exact_id", "class_key"), least, "class_key")
    classes = materialize(sorted_join(signed.select("doc_id", "same"), named, "same").select("doc_id", "class_id", "exact_id", "class_key"), "classes")
    remove(spark, scratch)  # only the classes are read from now on
    return classes


def op4_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
