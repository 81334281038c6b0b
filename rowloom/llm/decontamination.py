"""Benchmark decontamination with a positional inverted index that is stored and searched in shards of documents.

Index: each shard (documents of some MB) becomes one row of a Parquet table: its terms, how often each occurs, and the
ascending positions of each as compressed differences. Positions run through the shard's documents with a gap between
them, so that no phrase crosses documents. Building and searching need no shuffle, and a lost task rebuilds its shards.

Search: in each shard, a phrase starts from the postings of its rarest term; offset-adjusted, they are intersected
with the postings of the next rarer terms until all agree. All phrases are intersected together by binary search in
the sorted (term, position) pairs. The query set goes to the tasks in blocks of a bounded number of words.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_path, table, texts, tune

WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))
GAP = 64  # positions between documents, more than any phrase or proximity window reaches


def words(text: bytes) -> list[bytes]:
    """A-Z lower-cased; runs of ASCII letters, digits and all other code points from U+0080."""
    return text.translate(WORDS).split()


INDEX = "shard bigint, doc_ids binary, first binary, n_words binary, terms binary, term_counts binary, postings binary"


def build_index(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 8 << 20) -> None:
    """Store the postings of every word of every text (null: none). Ids are stored as 64-bit integers, null as the least."""

    def numbers():
        return defaultdict(count().__next__)

    def row(shard, ids, docs, number):
        n = np.asarray([len(d) for d in docs], dtype=np.int64)
        first = np.cumsum(n + GAP) - n
        terms = np.concatenate(docs)
        position = np.arange(len(terms)) + np.repeat(first - np.cumsum(n) + n, n)
        order = np.argsort(terms, kind="stable")
        counts = np.bincount(terms, minlength=len(number)).astype("<u4")
        deltas = np.diff(position[order], prepend=0)
        deltas[np.cumsum(counts)[:-1]] = position[order][np.cumsum(counts)[:-1]] if len(counts) > 1 else deltas[:0]
        pack = zstandard.ZstdCompressor(1).compress
        return shard, np.asarray(ids, dtype="<i8").tobytes(), first.astype("<i8").tobytes(), n.astype("<i8").tobytes(), pack(b"\n".join(number)), pack(counts.tobytes()), pack(deltas.astype("<u4").tobytes())

    def build(batches):
        from pyspark import TaskContext

        shard, ids, docs, held = TaskContext.get().partitionId() << 32, [], [], 0
        number = numbers()

        def done():
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row(shard, ids, docs, number), [pa.int64(), *[pa.binary()] * 6], strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])
        for b in batches:
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                found = words(text)
                ids.append(-(2**63) if i is None else i), docs.append(np.fromiter(map(number.__getitem__, found), dtype=np.int32, count=len(found)))
                held += len(text) + 200
                if held >= shard_bytes:
                    yield done()
                    shard, ids, docs, held, number = shard + 1, [], [], 0, numbers()
        if ids:
            yield done()

    docs = texts(df, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    docs.mapInArrow(build, INDEX).write.option("compression", "none").parquet(path)


class Shard:
    """One row of the index, opened for the terms of a block of phrases."""

    def __init__(self, row: dict, known: dict[bytes, int]):
        unpack = zstandard.ZstdDecompressor().decompress
        self.first, self.n_words, self.ids = (np.frombuffer(row[c], "<i8") for c in ("first", "n_words", "doc_ids"))
        counts = np.frombuffer(unpack(row["term_counts"]), "<u4").astype(np.int64)
        terms = unpack(row["terms"]).split(b"\n") if len(counts) else []
        ours = np.asarray([known.get(t, -1) for t in terms], dtype=np.int64)
        ends = np.cumsum(counts)
        deltas = np.frombuffer(unpack(row["postings"]), "<u4").astype(np.int64)
        sums = np.cumsum(deltas)
        here = np.flatnonzero(ours >= 0)
        here = here[np.argsort(ours[here])]
        self.count = np.zeros(len(known) + 1, dtype=np.int64)
        self.count[ours[here]] = counts[here]
        self.start = np.cumsum(self.count) - self.count  # of each term's postings in pairs
        n = counts[here]
        at = np.arange(int(n.sum())) + np.repeat(ends[here] - n - (np.cumsum(n) - n), n)
        position = sums[at] - np.repeat(sums[ends[here] - n] - deltas[ends[here] - n], n)
        self.pairs = np.repeat(ours[here], n) << 40 | position

    def postings(self, term: int) -> np.ndarray:
        s = self.start[term]
        return self.pairs[s : s + self.count[term]] & (1 << 40) - 1

    def phrases(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of ``terms``, position) of each occurrence of phrases of one length; a row has a phrase's terms."""
        n = self.count[terms]
        rows = np.flatnonzero((n > 0).all(axis=1))
        rarest = np.argsort(n[rows], axis=1, kind="stable")
        lead = terms[rows, rarest[:, 0]] if len(rows) else rows
        many = self.count[lead]
        at = np.repeat(np.arange(len(rows)), many)
        place = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
        start = (self.pairs[self.start[lead][at] + place] & (1 << 40) - 1) - rarest[at, 0] if len(at) else at
        for k in range(1, terms.shape[1]):
            if not len(at):
                break
            offset = rarest[at, k]
            want = terms[rows[at], offset] << 40 | np.maximum(start + offset, 0)
            found = np.searchsorted(self.pairs, want)
            ok = (found < len(self.pairs)) & (self.pairs[np.minimum(found, len(self.pairs) - 1)] == want)
            at, start = at[ok], start[ok]
        return rows[at], start

    def near(self, terms: list[int], within: int) -> np.ndarray:
        """Positions of the rarest term around which all terms are found within ``within`` words on either side."""
        rarest, *rest = sorted(terms, key=lambda t: self.count[t])
        at = self.postings(rarest)
        for t in rest:
            other = self.postings(t)
            k = np.searchsorted(other, at - within)
            at = at[(k < len(other)) & (other[np.minimum(k, len(other) - 1)] <= at + within)] if len(other) else at[:0]
        return at

    def documents(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, position, "right") - 1


def windows(text: bytes, size: int) -> list[list[bytes]]:
    """All runs of ``size`` words; the whole text if it has fewer, but not none."""
    w = words(text)
    return [w[i : i + size] for i in range(max(1, len(w) - size + 1))] if w else []


def blocks(df: DataFrame, id_col: str, text_col: str, words_most: int):
    """The query set as lists of (name, text), each of about ``words_most`` words at most (a longer text stands alone); one list is on the driver at a time. A null id's name is empty."""
    rows = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    block, held = [], 0
    for r in rows.toLocalIterator():
        block.append((r["id"], bytes(r["text"])))
        held += len(r["text"]) // 4
        if held >= words_most:
            yield block
            block, held = [], 0
    if block:
        yield block


PART = "shard bigint, place bigint, doc_id bigint, n_words bigint, hits array<bigint>, items array<string>, near array<string>"


def search_block(index: DataFrame, items: list[tuple[str, bytes]], size: int, within: int | None, complete: bool) -> DataFrame:
    """A row for each document of the index: FINISHED, or what is needed to put blocks together."""
    names = sorted({i for i, _ in items})
    number = {x: k for k, x in enumerate(names)}
    phrases = sorted({(tuple(w), number[i]) for i, text in items for w in windows(text, size)})
    known = {w: k for k, w in enumerate(sorted({w for p, _ in phrases for w in p}))}
    by_size: dict[int, tuple[list, list]] = {}
    for p, i in phrases:
        got = by_size.setdefault(len(p), ([], []))
        got[0].append([known[w] for w in p]), got[1].append(i)
    tables = {n: (np.asarray(t, dtype=np.int64), np.asarray(i, dtype=np.int64)) for n, (t, i) in by_size.items()}
    sent = index.sparkSession.sparkContext.broadcast((known, tables, names))  # bounded by words_most

    def search(batches):
        known, tables, names = sent.value
        for b in batches:
            for row in b.to_pylist():
                s = Shard(row, known)
                hits: dict[int, list] = defaultdict(list)
                found: dict[int, set] = defaultdict(set)
                close: dict[int, set] = defaultdict(set)
                for n, (terms, ids) in tables.items():
                    which, at = s.phrases(terms)
                    for d, p, i in zip(s.documents(at).tolist(), at.tolist(), ids[which].tolist(), strict=True):
                        hits[d].append((p - int(s.first[d]), p - int(s.first[d]) + n)), found[d].add(i)
                    for k in np.flatnonzero((s.count[terms] > 0).all(axis=1)) if within is not None else ():
                        for d in s.documents(s.near(sorted(set(terms[k].tolist())), within)).tolist():
                            close[d].add(int(ids[k]))
                spans = [[x for h in sorted(set(hits[d])) for x in h] if d in hits else [] for d in range(len(s.ids))]
                named = lambda x: [[names[i] for i in sorted(x[d])] if d in x else [] for d in range(len(s.ids))]  # noqa: E731, B023
                yield out(row["shard"], s.ids.tolist(), s.n_words.tolist(), spans, named(found), named(close))

    def out(shard, ids, n_words, spans, items, close):
        if complete:
            return finished(ids, n_words, spans, items, close)
        columns = [pa.array([shard] * len(ids), pa.int64()), pa.array(range(len(ids)), pa.int64()), pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int64())), *(pa.array(x, pa.list_(pa.string())) for x in (items, close))]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in PART.split(", ")])

    return index.mapInArrow(search, FINISHED if complete else PART)


FINISHED = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items array<string>, contaminated boolean, hits array<bigint>, items_sha256 string, near array<string>"


def finished(ids: list, n_words: list, spans: list, items: list, near: list) -> pa.RecordBatch:
    n_hit = [covered(h) for h in spans]
    names = [sorted(x) for x in items]
    ids = [None if x == -(2**63) else x for x in ids]
    digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]
    columns = [pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in names], pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array([n > 0 for n in n_hit], pa.bool_()), pa.array(spans, pa.list_(pa.int64())), pa.array(digests, pa.string()), pa.array([sorted(x) for x in near], pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in FINISHED.split(", ")])


def covered(hits: list[int]) -> int:
    """Words in the union of the pairs (first, end), given in ascending order."""
    total, reached = 0, 0
    for first, end in zip(hits[::2], hits[1::2], strict=True):
        if end > reached:
            total += end - max(first, reached)
            reached = end
    return total


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", words_most: int = 2_000_000, within: int | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (ids sorted as strings), contaminated, hits (spans of words) and near of every document.

    With ``within``, ``near`` has the ids of items that have a window whose words all lie within so many words of an
    occurrence of the rarest one, in any order. Ids of documents are integers; null ones are given back as null, and
    rows that repeat an id get a row each. Null texts have no words. Ids of items have any type; a null one counts as an
    empty name, and items that repeat an id count once. Very long texts fill a shard by themselves. Tables without rows
    are fine. Query sets beyond ``words_most`` words are searched block by block; each block's result is written, and
    their spans are put together.
    """
    spark = docs.sparkSession
    tune(spark)
    path = shared_path(spark, "postings")
    build_index(docs, path, id_col, text_col)
    index = spark.read.schema(T._parse_datatype_string(INDEX)).parquet(path)
    queries = blocks(items, item_col, item_text_col, words_most)
    block, following = next(queries, []), next(queries, None)
    if following is None:
        return search_block(index, block, size, within, True)
    parts = shared_path(spark, "blocks")
    while block is not None:
        search_block(index, block, size, within, False).write.mode("append").parquet(parts)
        block, following = following, next(queries, None)

    def merge(_, rows):
        got = rows.to_pydict()
        spans = sorted({(f, e) for h in got["hits"] for f, e in zip(h[::2], h[1::2], strict=True)})
        union = lambda c: sorted({i for x in got[c] for i in x})
        return pa.Table.from_batches([finished(got["doc_id"][:1], got["n_words"][:1], [[x for s in spans for x in s]], [union("items")], [union("near")])])

    found = spark.read.schema(T._parse_datatype_string(PART)).parquet(parts)
    return found.groupBy("shard", "place").applyInArrow(merge, FINISHED)  # a row for each block


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
