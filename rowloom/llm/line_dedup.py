"""Line dedup through a sharded minimal perfect hash.

Lines' keys are hashed to 128 bits where the documents are read; Spark counts the documents of each key, with partial
sums on the map side. All distinct keys are dealt to shards by their hash, and each shard becomes one file with a
minimal perfect hash (levels of bit arrays; a key's place is the rank of its bit) over arrays of fingerprints, of counts
and of last documents. Documents probe those arrays: a task sorts the hashes of a batch by shard and maps the shards'
files into memory, so that neither texts nor lines are joined or shuffled; the count it finds decides.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped, materialize, put, shared_path, table, tune

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def line_keys(text: bytes, min_chars: int) -> list[bytes | None]:
    """The key of each line; None if it has fewer than ``min_chars`` code points."""
    out: list[bytes | None] = []
    for line in text.translate(LOWER).split(b"\n"):
        key = line.strip(SPACE)
        long = len(key) >= 4 * min_chars or len(key) >= min_chars and len(key.decode(errors="replace")) >= min_chars
        out.append(key if long else None)
    return out


def two_hashes(key: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(key)
    return h >> 64, h & 0xFFFFFFFFFFFFFFFF


def mix(h: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (h ^ np.uint64(level + 1) * GOLDEN) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


class MinimalPerfectHash:
    """Over distinct unsigned 64-bit keys: a level keeps the keys that are alone at their bit; the others go on."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, total = [], 0
        for bits in levels:
            ones = np.cumsum(np.bitwise_count(bits), dtype=np.int64)
            self.ranks.append(total + ones - np.bitwise_count(bits))
            total += int(ones[-1])
        self.n = total

    @classmethod
    def build(cls, keys: np.ndarray) -> MinimalPerfectHash:
        levels, left = [], keys
        while len(left):
            size = max(64, -(-2 * len(left) // 64) * 64)
            at = mix(left, len(levels)) % np.uint64(size)
            n = np.bincount(at.astype(np.int64), minlength=size)
            levels.append(np.packbits(n == 1, bitorder="little").view("<u8"))
            left = left[n[at.astype(np.int64)] > 1]
        return cls(levels)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """A number below n for each key, its own for the keys that were built in; -1 where no level has a bit."""
        out, left = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = mix(keys[left], level) % np.uint64(len(bits) * 64)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            hit = (bits[word] >> bit) & np.uint64(1) == 1
            below = bits[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = ranks[word[hit]] + np.bitwise_count(below)
            left = left[~hit]
        return out

    def dump(self) -> bytes:
        return np.asarray([len(self.levels), *(len(b) for b in self.levels)], dtype="<u8").tobytes() + b"".join(b.tobytes() for b in self.levels)

    @classmethod
    def load(cls, data: bytes | np.ndarray) -> MinimalPerfectHash:
        words = np.frombuffer(data, dtype="<u8") if isinstance(data, bytes) else data
        n = int(words[0])
        return cls(np.split(words[n + 1 :], np.cumsum(words[1 : n + 1].astype(np.int64))[:-1]) if n else [])


def line_counts(df: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """h1, h2, docs (rows that hold the key) and last (the largest id among them) for each key."""

    def hashes(batches):
        for b in batches:
            h1, h2, row = [], [], []
            for i, text in enumerate(b.column("text").cast(pa.binary()).to_pylist()):
                for key in {k for k in line_keys(text, min_chars) if k is not None}:
                    x, y = two_hashes(key)
                    h1.append(x), h2.append(y), row.append(i)
            yield pa.RecordBatch.from_arrays([*(pa.array(np.asarray(x, dtype=np.uint64).view(np.int64)) for x in (h1, h2)), b.column("doc_id").take(pa.array(row, pa.int64()))], names=["h1", "h2", "doc_id"])

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = docs.mapInArrow(hashes, "h1 bigint, h2 bigint, doc_id bigint")
    return found.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("doc_id").alias("last"))


def write_index(counts: DataFrame, path: str, shards: int) -> list[int]:
    """A file for each shard that has keys: mph, fingerprints, counts, last, and beside (keys that share their first hash with another). Gives the shards."""

    def build(key, rows):
        shard = key[0].as_py()
        h1, h2, docs, last = (rows.column(c).to_numpy() for c in ("h1", "h2", "docs", "last"))
        order = np.argsort(h1, kind="stable")
        again = np.zeros(len(h1), bool)
        again[order[1:]] = h1[order[1:]] == h1[order[:-1]]
        first = ~again
        mph = MinimalPerfectHash.build(h1[first].view(np.uint64))
        at = mph.index(h1[first].view(np.uint64))
        arrays = {"mph": np.frombuffer(mph.dump(), "<u8"), "beside": np.stack([x[again] for x in (h1, h2, docs, last)], axis=1).ravel().astype("<i8")}
        for name, x in (("fingerprints", h2), ("counts", docs.astype("<u4") if docs.max() < 1 << 32 else docs), ("last", last)):
            arrays[name] = np.zeros(len(at), x.dtype)
            arrays[name][at] = x[first]
        put(path, f"{shard:08d}", arrays)
        return pa.table({"shard": pa.array([shard], pa.int64())})

    dealt = counts.select("h1", "h2", "docs", F.coalesce("last", F.lit(-(2**63))).alias("last"), F.pmod(F.col("h1"), F.lit(shards)).alias("shard"))
    return [r[0] for r in dealt.groupBy("shard").applyInArrow(build, "shard bigint").collect()]  # a number for each file


class Probe:
    """The shards of an index in the shared folder; at most ``most`` of them open."""

    def __init__(self, path: str, shards: int, there: set[int], most: int = 256):
        self.path, self.shards, self.there, self.most, self.held = path, shards, there, most, OrderedDict()

    def shard(self, s: int):
        if s not in self.held:
            if len(self.held) >= self.most:
                self.held.popitem(last=False)
            a = mapped(self.path, f"{s:08d}")
            self.held[s] = (MinimalPerfectHash.load(a["mph"]), a["fingerprints"].view(np.uint64), a["counts"], a["last"], {(x, y): (n, last) for x, y, n, last in a["beside"].reshape(-1, 4).tolist()})
        self.held.move_to_end(s)
        return self.held[s]

    def find(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many documents hold each key (0: none) and the last of them."""
        counts, last = np.zeros(len(h1), dtype=np.int64), np.zeros(len(h1), dtype=np.int64)
        shard = h1.view(np.int64) % self.shards
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.diff(shard[order])) + 1
        for at in np.split(order, cuts) if len(order) else []:
            if int(shard[at[0]]) not in self.there:
                continue
            mph, prints, held, lasts, beside = self.shard(int(shard[at[0]]))
            k = mph.index(h1[at])
            ok = (k >= 0) & (prints[k] == h2[at])
            counts[at], last[at] = np.where(ok, held[k], 0), np.where(ok, lasts[k], 0)
            for i in at[~ok] if beside else []:
                if (got := beside.get((int(h1[i].view(np.int64)), int(h2[i].view(np.int64))))) is not None:
                    counts[i], last[i] = got
        return counts, last


def dedup_lines(df: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text", keys_per_shard: int = 250_000) -> DataFrame:
    """Adds n_lines, n_dropped and kept_text to every row; other columns stay, but for older ones of these names.

    A document is a row: rows that repeat an id count each, and a line stays in all rows of the largest id. A null or
    empty text is one empty line. Null ids come before all others. Very long texts are split whole; an empty table gives
    no rows.
    """
    spark = df.sparkSession
    tune(spark)
    counts = materialize(line_counts(df, id_col, text_col, min_chars), "line-counts")
    shards = max(1, -(-counts.count() // keys_per_shard))
    index = shared_path(spark, "line-index")
    sent = spark.sparkContext.broadcast(set(write_index(counts, index, shards)))  # a number for each file

    kept = [c for c in df.columns if c not in ("n_lines", "n_dropped", "kept_text")]
    schema = T.StructType([*(df.schema[c] for c in kept), *(T.StructField(c, k) for c, k in (("n_lines", T.LongType()), ("n_dropped", T.LongType()), ("kept_text", T.StringType())))])

    def drop(batches):
        probe = Probe(index, shards, sent.value)
        for b in batches:
            docs = [x or b"" for x in b.column(text_col).cast(pa.binary()).to_pylist()]
            ids = b.column(id_col).cast(pa.int64()).to_pylist()
            keys = [line_keys(x, min_chars) for x in docs]
            pairs = [(i, j, *two_hashes(k)) for i, ks in enumerate(keys) for j, k in enumerate(ks) if k is not None]
            gone: dict[int, set[int]] = {}
            if pairs:
                doc, line, h1, h2 = zip(*pairs, strict=True)
                found, last = probe.find(np.asarray(h1, dtype=np.uint64), np.asarray(h2, dtype=np.uint64))
                for at in np.flatnonzero(found >= min_docs):
                    i = doc[at]
                    if (ids[i] if ids[i] is not None else -(2**63)) != last[at]:
                        gone.setdefault(i, set()).add(line[at])
            n_lines = [len(k) for k in keys]
            n_dropped = [len(gone.get(i, ())) for i in range(len(docs))]
            left = [b"\n".join(x for j, x in enumerate(text.split(b"\n")) if j not in gone[i]) if i in gone else text for i, text in enumerate(docs)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(left, pa.binary()).cast(pa.string())], names=[*kept, "n_lines", "n_dropped", "kept_text"])

    return df.select(*kept).mapInArrow(drop, schema)


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, i, lines[i] AS line,
        translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM (SELECT r, doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)),
k AS (SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT r) >= 5),
m AS (SELECT l.r, l.doc_id, l.i, l.line, k.last IS NOT NULL AND k.last <> l.doc_id AS gone FROM l LEFT JOIN k ON l.key = k.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""
