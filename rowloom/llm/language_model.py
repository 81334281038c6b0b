"""Language-model scores from an n-gram trie in Elias-Fano form.

Level 1 holds all training words as the ascending sequence of their 64-bit hashes, with exact counts; a word's place is
its number. Level k holds the runs of k words: under each context (its number in level k - 1) the ascending numbers of
the words after it. Each level is cut into files by ranges of contexts; a file has

* ``pointers``, a monotone Elias-Fano sequence: where each context's successors begin and end;
* ``keys``, one ascending Elias-Fano sequence of all successors, each relative to its context: the number of the word
  plus the last key of the contexts before. A lookup reads a context's two pointers, takes the key before the first as
  its base, and searches base + word between them;
* 16-bit codes of the discounted probabilities, and of the weight that a context leaves to shorter ones.

Texts are turned into numbers of words once and written. For each level, tasks count their runs and send them, sorted
and packed, to the file's range; one group merges a range and writes its file to the shared folder. Ranges hold about
equally many occurrences: a frequent context is split over several by its successors. Scoring tasks map the files into
memory and look up a batch's distinct runs in ascending order.

p(w | u v) = max(c(u, v, w) - D, 0) / c(u, v) + D * kinds(u, v) / c(u, v) * p(w | v), and so on down to
p(w) = (c(w) + 1) / (N + V + 1): sums to 1 for every context. Before a text's first word stands an end.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import count
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, materialize, put, shared_path, shuffle_partitions, table, texts, tune

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
END = b" end"  # no word holds a space
SIGN = np.uint64(1 << 63)
#: Quantised log10 of probabilities: 16 bits over this range.
LEAST_LOG = -14.0
#: In memory a run is context * (words + 1) + word, in 63 bits.
MOST_WORDS = isqrt(1 << 63) - 1
#: Runs that a task counts before it sends them on.
HELD = 2_000_000


def words(text: bytes) -> list[bytes]:
    """A-Z lower-cased, split at white space, and one end."""
    return [*text.translate(LOWER).split(), END]


def hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=np.uint64, count=len(found))


def kth_one(bits: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of the k-th one (from 0) in each 64-bit word, by halves."""
    bits, k, at = bits.copy(), k.astype(np.uint8), np.zeros(len(bits), np.uint8)
    for half in (32, 16, 8, 4, 2, 1):
        ones = np.bitwise_count(bits & np.uint64((1 << half) - 1))
        up = (k >= ones).astype(np.uint8)
        k -= ones * up
        up *= np.uint8(half)
        at += up
        bits >>= up.astype(np.uint64)
    return at.astype(np.int64)


class EliasFano:
    """An ascending sequence of unsigned 64-bit numbers: low bits packed, high bits in unary, with the sums of ones by word."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, upper: np.ndarray, ones: np.ndarray):
        self.n, self.low_bits, self.low, self.upper, self.ones = n, low_bits, low, upper, ones
        self.zeros = np.arange(64, 64 * len(upper) + 64, 64, dtype=ones.dtype) - ones

    @classmethod
    def build(cls, x: np.ndarray) -> EliasFano:
        n = len(x)
        bits = max(0, (int(x[-1]) // n).bit_length() - 1) if n else 0
        high = (x >> np.uint64(bits)).astype(np.int64)
        at = high + np.arange(n)
        size = (int(high[-1]) + n if n else 0) + 2
        upper = np.zeros(-(-size // 64) * 64, np.uint8)
        upper[at] = 1
        upper = np.packbits(upper, bitorder="little").view("<u8")
        kind = np.uint32 if len(upper) < 1 << 25 else np.int64
        ones = np.bitwise_count(upper)
        low = np.zeros(n * bits // 64 + 2, "<u8")
        if bits:
            low_part, start = x & np.uint64((1 << bits) - 1), np.arange(n, dtype=np.int64) * bits
            word, shift = start >> 6, (start & 63).astype(np.uint64)
            np.bitwise_or.at(low, word, low_part << shift)
            over = shift + np.uint64(bits) > 64
            np.bitwise_or.at(low, word[over] + 1, low_part[over] >> (np.uint64(64) - shift[over]))
        return cls(n, bits, low, upper, np.cumsum(ones, dtype=kind))

    def lows(self, at: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(at), np.uint64)
        start = at * self.low_bits
        word, shift = start >> 6, (start & 63).astype(np.uint64)
        got = self.low[word] >> shift
        over = shift > 64 - self.low_bits
        got[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        return got & np.uint64((1 << self.low_bits) - 1)

    def get(self, at: np.ndarray) -> np.ndarray:
        """The numbers at some places."""
        word = np.searchsorted(self.ones, at.astype(self.ones.dtype), "right")
        inside = at - np.where(word > 0, self.ones[word - 1], 0)
        place = word * 64 + kth_one(self.upper[word], inside)
        return (place - at).astype(np.uint64) << np.uint64(self.low_bits) | self.lows(at)

    def before(self, high: np.ndarray) -> np.ndarray:
        """How many numbers have smaller high bits: the place of the high-th zero less the zeros before it."""
        k = np.maximum(high - 1, 0)
        word = np.minimum(np.searchsorted(self.zeros, k.astype(self.zeros.dtype), "right"), len(self.upper) - 1)
        inside = k - np.where(word > 0, self.zeros[word - 1], 0)
        place = word * 64 + kth_one(~self.upper[word], inside)
        return np.where(high > 0, np.minimum(place - k, self.n), 0)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first number that is at least x, whether it is x)."""
        if not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        high, low = (x >> np.uint64(self.low_bits)).astype(np.int64), x & np.uint64((1 << self.low_bits) - 1)
        most = int(self.zeros[-1])
        inside = high < most - 1
        high = np.minimum(high, most - 2)
        first, e = self.before(high), self.before(high + 1)
        last = e.copy()
        open_ = np.flatnonzero(first < last)
        while len(open_):
            mid = (first[open_] + last[open_]) >> 1
            less = self.lows(mid) < low[open_]
            first[open_[less]], last[open_[~less]] = mid[less] + 1, mid[~less]
            open_ = open_[first[open_] < last[open_]]
        ok = inside & (first < e)
        ok[ok] = self.lows(first[ok]) == low[ok]
        return np.where(inside, first, self.n), ok

    def find(self, x: np.ndarray) -> np.ndarray:
        """Place of each number, or -1."""
        at, ok = self.successor(x)
        return np.where(ok, at, -1)

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.meta": np.asarray([self.n, self.low_bits], "<i8"), f"{name}.low": self.low, f"{name}.upper": self.upper, f"{name}.ones": self.ones}

    @classmethod
    def of(cls, a: dict[str, np.ndarray], name: str) -> EliasFano:
        n, bits = a[f"{name}.meta"].tolist()
        return cls(n, bits, *(a[f"{name}.{x}"] for x in ("low", "upper", "ones")))


def quantised(log10: np.ndarray) -> np.ndarray:
    return np.round(np.clip(log10, LEAST_LOG, 0) / LEAST_LOG * 65535).astype("<u2")


def probability(codes: np.ndarray) -> np.ndarray:
    return 10 ** (codes.astype(np.float64) / 65535 * LEAST_LOG)


class Files:
    """Files of a level, few of them open at a time."""

    def __init__(self, path: str, sequences: tuple[str, ...], most: int = 64):
        self.path, self.sequences, self.most, self.open = path, sequences, most, {}

    def at(self, shard: int) -> dict:
        if shard not in self.open:
            if len(self.open) >= self.most:
                self.open.pop(next(iter(self.open)))
            a = mapped(self.path, f"{shard:08d}")
            self.open[shard] = a | {x: EliasFano.of(a, x) for x in self.sequences}
        return self.open[shard]


class Words:
    """Level 1. ``starts``: each file's shard, least hash, and the number of words before it."""

    def __init__(self, path: str, starts: list[tuple[int, int, int]]):
        self.files, self.shards = Files(path, ("keys",)), [s for s, _, _ in starts]
        self.first = np.asarray([f for _, f, _ in starts], np.uint64)
        self.before = np.asarray([b for _, _, b in starts], np.int64)

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers (-1: none) and counts of ascending hashes."""
        number, counts = np.full(len(x), -1, np.int64), np.zeros(len(x), np.int64)
        shard = np.searchsorted(self.first, x, "right") - 1
        for k in np.unique(shard[shard >= 0]):
            a, here = self.files.at(self.shards[k]), np.flatnonzero(shard == k)
            at = a["keys"].find(x[here] - self.first[k])
            here, at = here[at >= 0], at[at >= 0]
            number[here], counts[here] = self.before[k] + at, a["counts"][at]
        return number, counts

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        """Counts of words' numbers; of others 0."""
        out, shard = np.zeros(len(numbers), np.int64), np.searchsorted(self.before, numbers, "right") - 1
        for k in np.unique(shard):
            a, here = self.files.at(self.shards[k])["counts"], np.flatnonzero(shard == k)
            at = numbers[here] - self.before[k]
            here = here[at < len(a)]
            out[here] = a[numbers[here] - self.before[k]]
        return out


class Successors:
    """A level of runs. ``cuts``: the least run of each file; ``before``: the runs of the files before it; ``split``: what contexts leave that are split over several files."""

    def __init__(self, level: dict, width: int):
        self.files, self.width = Files(level["path"], ("pointers", "keys")), width
        self.cuts, self.before, self.there, self.split = level["cuts"], level["before"], level["there"], level["split"]

    def find(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The numbers of ascending runs (-1: none), their discounted probabilities (0) and what their contexts leave (1)."""
        number, p, left = np.full(len(runs), -1, np.int64), np.zeros(len(runs)), np.ones(len(runs))
        shards = np.searchsorted(self.cuts, runs, "right") - 1
        borders = np.flatnonzero(np.diff(shards)) + 1
        for s, e in zip([0, *borders.tolist()], [*borders.tolist(), len(runs)], strict=True) if len(runs) else ():
            k = int(shards[s])
            if k < 0 or not self.there[k]:
                continue
            a = self.files.at(k)
            context, word = np.divmod(runs[s:e], self.width)
            c = context - self.cuts[k] // self.width
            known = np.flatnonzero(c < a["pointers"].n - 1)
            c, word = c[known], word[known]
            first, end = (a["pointers"].get(c + x).astype(np.int64) for x in (0, 1))
            base = np.where(first > 0, a["keys"].get(np.maximum(first - 1, 0)) + np.uint64(1), np.uint64(0))
            at, ok = a["keys"].successor(base + word.astype(np.uint64))
            ok &= at < end
            if k in self.split:
                left[s:e] = self.split[k]
            else:
                seen = first < end
                left[s + known[seen]] = probability(a["left"][c[seen]])
            number[s + known[ok]], p[s + known[ok]] = self.before[k] + at[ok], probability(a["codes"][at[ok]])
        return number, p, left


def cut(counts: np.ndarray, each: int) -> list[list[int]]:
    """Where ranges of about ``each`` occurrences begin: (place, part, parts, occurrences); one that has more by itself is in parts."""
    large = counts > each
    group = np.cumsum(np.where(large, 0, counts)) // each
    begins = np.concatenate([[True], (group[1:] != group[:-1]) | large[1:] | large[:-1]]) if len(counts) else np.zeros(0, bool)
    out = []
    for k in np.flatnonzero(begins).tolist():
        n = int(counts[k])
        parts = -(-n // each) if large[k] else 1
        out += [[k, part, parts, n] for part in range(parts)]
    return out


def write_words(rows: DataFrame, keys_each: int, path: str, n: int, each: int) -> tuple[list[tuple[int, int, int]], list[list[int]]]:
    """Range-partition words (key, n) by their hashes and write each range. Gives the files' starts and the cuts of the next level."""

    def write(batches):
        got = [b for b in batches if b.num_rows]
        if got:
            t = pa.Table.from_batches(got)
            key, counts = t.column("key").to_numpy(), t.column("n").to_numpy()
            x = key.view(np.uint64) ^ SIGN
            shard = TaskContext.get().partitionId()
            put(path, f"{shard:08d}", EliasFano.build(x - x[0]).arrays("keys") | {"counts": counts.astype("<u4") if counts.max() < 1 << 32 else counts})
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([int(key[0])], pa.int64()), pa.array([len(x)], pa.int64()), pa.array([cut(counts, each)], pa.list_(pa.list_(pa.int64())))], names=["shard", "first", "n", "cuts"])

    ordered = rows.repartitionByRange(max(shuffle_partitions(rows.sparkSession), -(-n // keys_each)), "key").sortWithinPartitions("key")
    starts, cuts, total = [], [], 0
    for r in sorted(ordered.mapInArrow(write, "shard bigint, first bigint, n bigint, cuts array<array<bigint>>").collect()):  # a row for each file
        starts.append((r["shard"], (r["first"] + (1 << 63)), total))
        cuts += [[total + k, *more] for k, *more in r["cuts"]]
        total += r["n"]
    return starts, cuts


def signed(x: np.ndarray) -> pa.Array:
    return pa.array((x ^ SIGN).view(np.int64))


def packed(runs: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending runs as differences, with counts, by planes of bytes."""
    planes = [np.diff(runs, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), counts.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()]
    return zstandard.ZstdCompressor(1).compress(b"".join(planes))


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(16, -1)
    differences, counts = (np.ascontiguousarray(x.T).view("<i8").ravel() for x in (planes[:8], planes[8:]))
    return np.cumsum(differences), counts


class Scorer:
    """The trie as a task sees it."""

    def __init__(self, sent: dict):
        self.V, self.N, self.end = sent["V"], sent["N"], sent["end"]
        self.words = Words(sent["word_path"], sent["word_starts"])
        self.levels = [Successors(x, self.V + 1) for x in sent["levels"]]

    def numbered(self, docs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of some texts as words' numbers (V: unknown); for each text its tokens, known tokens, and base score."""
        local = defaultdict(count().__next__)
        tokens = [words(t) for t in docs]
        lengths = np.asarray([len(t) for t in tokens], np.int64)
        ids = np.fromiter((local[w] for t in tokens for w in t), np.int64, int(lengths.sum()))
        hashed = hashes(list(local))
        order = np.argsort(hashed)
        number, counts = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        number[order], counts[order] = self.words.find(hashed[order])
        first = np.cumsum(lengths) - lengths
        known = np.add.reduceat((counts > 0).astype(np.int64)[ids], first)
        base = np.add.reduceat(np.log10((counts + 1) / (self.N + self.V + 1))[ids], first)
        return np.where(number < 0, self.V, number)[ids], lengths, known, base

    def contexts(self, ids: np.ndarray, lengths: np.ndarray, level: int, before: np.ndarray | None) -> np.ndarray:
        """For each token the number of the run before it in ``level`` (1: words), -1 if there is none; ``before``: the numbers of the runs that end at each token."""
        out = np.full(len(ids), -1, np.int64)
        out[1:] = (ids if level == 1 else before)[:-1]
        first = np.cumsum(lengths) - lengths
        out[first] = self.end if level == 1 else -1
        return np.where(out == self.V, -1, out) if level == 1 else out

    def runs(self, ids: np.ndarray, lengths: np.ndarray, levels: int):
        """For each of the first ``levels`` levels: places of the tokens whose context is known, their runs, and what is found of each."""
        before = None
        for k, level in enumerate(self.levels[:levels]):
            context = self.contexts(ids, lengths, k + 1, before)
            at = np.flatnonzero(context >= 0)
            distinct, which = np.unique(context[at] * (self.V + 1) + ids[at], return_inverse=True)
            number, p, left = level.find(distinct)
            before = np.full(len(ids), -1, np.int64)
            before[at] = number[which]
            yield at, which, p, left, before


def to_bytes(x: np.ndarray, most: int) -> np.ndarray:
    """Each number as a row of as many bytes as ``most`` needs."""
    return x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, : -(-most.bit_length() // 8) or 1]


def from_bytes(column, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of a batch of stored texts, and how many each has."""
    data = column.to_pylist()
    width = -(-most.bit_length() // 8) or 1
    rows = np.frombuffer(b"".join(data), np.uint8).reshape(-1, width)
    out = np.zeros((len(rows), 8), np.uint8)
    out[:, :width] = rows
    return out.view("<i8").ravel(), np.asarray([len(x) // width for x in data], np.int64)


NUMBERED = "n_tokens bigint, n_known bigint, base_score double, ids binary"


def number_texts(docs: DataFrame, trie: dict, columns: list[str]) -> DataFrame:
    """``columns`` of docs (with text), and its tokens as numbers."""
    sent = docs.sparkSession.sparkContext.broadcast(trie)
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns]

    def run(batches):
        s = Scorer(sent.value)
        for b in batches:
            texts_ = b.column("text").cast(pa.binary()).to_pylist()
            if texts_:
                ids, lengths, known, base = s.numbered(texts_)
                ids = np.split(to_bytes(ids, s.V), np.cumsum(lengths)[:-1])
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(lengths), pa.array(known), pa.array(base), pa.array([x.tobytes() for x in ids], pa.binary())], names=[*columns, "n_tokens", "n_known", "base_score", "ids"])

    return docs.select(*columns, "text").mapInArrow(run, ", ".join([*fields, NUMBERED]))


def train_words(docs: DataFrame, word_keys: int, each: int) -> dict:
    """Level 1 of all texts of ``docs`` (text)."""
    spark = docs.sparkSession

    def count_words(batches):
        def rows(c):
            return pa.RecordBatch.from_arrays([signed(hashes(list(c))), pa.array(list(c.values()), pa.int64())], names=["key", "n"])

        total: Counter = Counter()
        for b in batches:
            for t in b.column("text").cast(pa.binary()).to_pylist():
                total.update(words(t))
            if len(total) > 400_000:
                yield rows(total)
                total = Counter()
        yield rows(total)

    counts = materialize(docs.select("text").mapInArrow(count_words, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")), "word-counts")
    n_words, n_tokens = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if n_words > MOST_WORDS:
        raise ValueError(f"{n_words} distinct words: runs hold {MOST_WORDS} at most")
    path = shared_path(spark, "trie-words")
    starts, cuts = write_words(counts, word_keys, path, n_words, each)
    trie = {"word_path": path, "word_starts": starts, "V": n_words, "N": n_tokens, "end": -1, "levels": [], "cuts": cuts}
    if n_words:
        trie["end"] = int(Words(path, starts).find(hashes([END]))[0][0])
    return trie


def add_level(trie: dict, numbered: DataFrame, each: int, discount: float) -> dict:
    """The trie with one more level, counted in all rows of ``numbered`` (ids)."""
    spark, order, width = numbered.sparkSession, len(trie["levels"]) + 2, trie["V"] + 1
    contexts = trie["levels"][-1]["n"] if trie["levels"] else trie["V"]
    if contexts * width >= 1 << 63:
        raise ValueError(f"{contexts} contexts of {width} words: runs hold 63 bits")
    cuts = np.asarray([c * width + part * width // parts for c, part, parts, _ in trie["cuts"]], np.int64)
    totals = {k: n for k, (_, _, parts, n) in enumerate(trie["cuts"]) if parts > 1}
    path = shared_path(spark, f"trie-{order}")
    sent = spark.sparkContext.broadcast((trie, cuts, totals))  # a few numbers for each file

    def count_runs(batches):
        trie, cuts, _ = sent.value
        s, held, size = Scorer(trie), [], 0

        def flush():
            runs, n = np.unique(np.concatenate(held), return_counts=True)
            shard = np.searchsorted(cuts, runs, "right") - 1
            borders = np.flatnonzero(np.diff(shard)) + 1
            pieces = [(int(shard[a]), packed(runs[a:b], n[a:b])) for a, b in zip([0, *borders.tolist()], [*borders.tolist(), len(runs)], strict=True)] if len(runs) else []
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pieces], pa.int64()), pa.array([x for _, x in pieces], pa.binary())], names=["shard", "runs"])

        for b in batches:
            if not b.num_rows:
                continue
            ids, lengths = from_bytes(b.column("ids"), s.V)
            before = None
            for *_, before in s.runs(ids, lengths, order - 2):
                pass
            context = s.contexts(ids, lengths, order - 1, before)
            at = np.flatnonzero(context >= 0)
            held.append(context[at] * width + ids[at])
            size += len(at)
            if size >= HELD:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def merge(key, rows):
        _, cuts, totals = sent.value
        shard = key[0].as_py()
        pieces = [unpacked(x) for x in rows.column("runs").to_pylist()]
        runs, n = (np.concatenate([p[k] for p in pieces]) for k in (0, 1))
        at = np.argsort(runs, kind="stable")
        runs, n = runs[at], n[at]
        begins = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]]))
        runs, n = runs[begins], np.add.reduceat(n, begins)
        context, word = np.divmod(runs, width)
        context -= cuts[shard] // width
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        kinds = np.diff(np.append(first, len(runs)))
        total = np.full(len(first), totals[shard]) if shard in totals else np.add.reduceat(n, first)
        last = word[np.append(first[1:], len(runs)) - 1] + 1
        base = np.cumsum(last) - last
        pointers = np.searchsorted(context, np.arange(context[-1] + 2))
        left = np.zeros(context[-1] + 1, "<u2")
        left[context[first]] = quantised(np.log10(discount * kinds / total))
        keys = (np.repeat(base, kinds) + word).astype(np.uint64)
        codes = quantised(np.log10((n - discount) / np.repeat(total, kinds)))
        put(path, f"{shard:08d}", EliasFano.build(pointers.astype(np.uint64)).arrays("pointers") | EliasFano.build(keys).arrays("keys") | {"codes": codes, "left": left})
        return pa.table({"shard": pa.array([shard], pa.int64()), "n": pa.array([len(runs)], pa.int64()), "cuts": pa.array([cut(n, each)], pa.list_(pa.list_(pa.int64())))})

    files = numbered.select("ids").mapInArrow(count_runs, "shard bigint, runs binary").groupBy("shard").applyInArrow(merge, "shard bigint, n bigint, cuts array<array<bigint>>")
    sizes, there, following = np.zeros(len(cuts), np.int64), np.zeros(len(cuts), bool), []
    made = sorted(files.collect())  # a row for each file
    for r in made:
        sizes[r["shard"]], there[r["shard"]] = r["n"], True
    before = np.cumsum(sizes) - sizes
    for r in made:
        following += [[int(before[r["shard"]]) + k, *more] for k, *more in r["cuts"]]
    kinds: dict[int, int] = defaultdict(int)
    for k in totals:
        kinds[trie["cuts"][k][0]] += int(sizes[k])
    split = {k: discount * kinds[trie["cuts"][k][0]] / n for k, n in totals.items()}
    level = {"path": path, "cuts": cuts, "before": before, "there": there, "split": split, "n": int(sizes.sum())}
    return trie | {"levels": [*trie["levels"], level], "cuts": following}


def train(docs: DataFrame, order: int = 3, word_keys: int = 2_000_000, each: int = 4_000_000, discount: float = 0.75, numbered: DataFrame | None = None, words_: dict | None = None) -> dict:
    """The trie of all texts of ``docs`` (text), as what a Scorer needs: paths and borders of files, N and V.

    It holds every run of up to ``order`` words, whatever the size. Repeated rows count each; null texts are left to the
    caller; without any text there are no words. Very long texts need the memory of their tokens. More words than
    MOST_WORDS are an error. ``word_keys``: words of a file of level 1; ``each``: occurrences of a file of a level above.
    """
    trie = words_ if words_ is not None else train_words(docs, word_keys, each)
    if not trie["V"] or order < 2:
        return trie
    if numbered is None:
        numbered = materialize(number_texts(docs, trie, []), "numbered", compression="zstd")
    for _ in range(order - 1):
        trie = add_level(trie, numbered, each, discount)
    return trie


def score_numbered(numbered: DataFrame, trie: dict, columns: list[str]) -> DataFrame:
    """``columns`` and score of texts given as numbers."""
    sent = numbered.sparkSession.sparkContext.broadcast(trie)
    fields = [f"`{c}` {numbered.schema[c].dataType.simpleString()}" for c in columns]

    def run(batches):
        s = Scorer(sent.value)
        for b in batches:
            if not b.num_rows:
                continue
            ids, lengths = from_bytes(b.column("ids"), s.V)
            distinct, which = np.unique(ids, return_inverse=True)
            p = ((s.words.counts(distinct) + 1) / (s.N + s.V + 1))[which] if s.V else np.ones(len(ids))
            for at, of, found, left, _ in s.runs(ids, lengths, len(s.levels)):
                p[at] = found[of] + left[of] * p[at]
            total = np.add.reduceat(np.log10(p), np.cumsum(lengths) - lengths)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(total)], names=[*columns, "score"])

    return numbered.select(*columns, "ids").mapInArrow(run, ", ".join([*fields, "score double"]))


def score(df: DataFrame, trie: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score (log10) for every row.

    Null and empty texts have one token, the end. Repeated rows each get a row; ids may be null; an empty table gives no
    rows; very long texts need the memory of their tokens.
    """
    return score_numbered(number_texts(texts(df, id_col, text_col), trie, ["doc_id"]), trie, ["doc_id", "n_tokens", "n_known", "base_score"])


def op5_lm_scoring(spark, sf_dir: str) -> DataFrame:
    tune(spark)
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    docs = texts(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("held_out", out)
    first = train_words(docs.filter(~F.col("held_out")), 2_000_000, 4_000_000)
    numbered = materialize(number_texts(docs, first, ["doc_id", "held_out"]), "numbered", compression="zstd")
    trie = train(docs, numbered=numbered.filter(~F.col("held_out")), words_=first)
    found = score_numbered(numbered, trie, ["doc_id", "held_out", "n_tokens", "n_known", "base_score"])
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(trie["N"]).cast("long").alias("train_tokens"), "base_score", "score")
