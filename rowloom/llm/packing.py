"""Best-fit packing of token pieces into sequences by exact complements.

The plan needs only how many pieces have each length: at most ``capacity`` numbers, whatever the table's size. On it,
sequences are opened with the longest pieces left and their gaps filled exactly by one, two or three lengths looked up
by their sum among the available ones; a gap that no combination fills takes the longest piece that fits, until a
combination fills the rest. A step packs all alike sequences at once, so steps are bounded by the lengths, too. Spark
then numbers the pieces of each length and the plan's intervals of those numbers give every piece its place.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table, texts, tune
from .token_output import encoder


def exact_fill(counts: np.ndarray, gap: int) -> tuple[int, ...] | None:
    """One, two or three available lengths that sum to ``gap``; longer ones first."""
    if gap < len(counts) and counts[gap]:
        return (gap,)
    small = counts[: gap + 1]
    have = np.flatnonzero(small)
    have = have[have > 0]
    pair = have[(have * 2 >= gap) & (have < gap)]
    pair = pair[small[gap - pair] > (pair * 2 == gap)]
    if len(pair):
        return (int(pair[-1]), int(gap - pair[-1]))
    for first in have[::-1]:
        if first * 3 < gap:
            break
        rest = gap - first
        other = have[(have <= first) & (have * 2 >= rest) & (have < rest)]
        third = rest - other
        same = [(other == first).astype(int), (third == other).astype(int), (third == first).astype(int)]
        ok = (small[first] > same[0] + same[2]) & (small[other] > same[0] + same[1]) & (small[third] > same[1] + same[2])
        if ok.any():
            i = int(np.flatnonzero(ok)[-1])
            return (int(first), int(other[i]), int(third[i]))
    return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, number of alike sequences) for all pieces; every length from 1 to ``capacity``."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} is not within 1 and {capacity}")
        left[length] = n
    out, longest = [], capacity
    while True:
        while longest and not left[longest]:
            longest -= 1
        if not longest:
            return out
        taken, gap, trial = [longest], capacity - longest, left.copy()
        trial[longest] -= 1
        while gap:
            if fill := exact_fill(trial, gap):
                taken += fill
                break
            fits = np.flatnonzero(trial[1 : gap + 1])
            if not len(fits):
                break
            best = int(fits[-1]) + 1
            taken.append(best)
            trial[best] -= 1
            gap -= best
        lengths, times = np.unique(taken, return_counts=True)
        n = int((left[lengths] // times).min())
        left[lengths] -= n * times
        out.append((tuple(taken), n))


def intervals(steps: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each place of each step: pieces of ``length`` numbered from ``first`` go to sequences from ``sequence``, at ``offset``."""
    rows, used, sequence = [], {}, 0
    for taken, n in steps:
        offset = 0
        for length in taken:
            first = used.get(length, 0)
            rows.append((length, first, sequence, offset))
            used[length] = first + n
            offset += length
        sequence += n
    rows.sort()
    return dict(zip(("length", "first", "sequence", "offset"), np.asarray(rows, dtype=np.int64).reshape(-1, 4).T, strict=True))


def token_pieces(df: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every text's ids and its end id: doc_id, piece, start, length, ids_crc32."""
    end = np.asarray([end_id], dtype="<u4").tobytes()
    kind = df.schema[id_col].dataType.simpleString()

    def cut(batches):
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(encoder(tokenizer).encode(b.column("text").to_pylist())):
                ids += end
                for k, s in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[s : s + 4 * capacity]
                    row.append(i), piece.append(k), start.append(s // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts(df, id_col, text_col).mapInArrow(cut, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(pieces: DataFrame, capacity: int = 4096, length_col: str = "length", order: tuple[str, ...] = ("doc_id", "piece"), buckets: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces of 1 to ``capacity`` tokens.

    ``pieces`` must give the same rows each time it is read, such as a written table. Pieces of one length are numbered
    in ``buckets`` by a hash of ``order`` and the buckets' sizes summed, so that a length that a third of all pieces
    have isn't numbered by one task. Equal rows get different places. An empty table gives no rows.
    """
    bucketed = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sizes = bucketed.groupBy(length_col, "_bucket").agg(F.count("*").alias("_n"))
    by_length = {r[0]: r[1] for r in pieces.groupBy(length_col).agg(F.count("*")).collect()}  # at most ``capacity`` rows
    if len(by_length) > capacity:
        raise ValueError("lengths beyond the capacity")
    before = Window.partitionBy(length_col).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(length_col, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy(length_col, "_bucket").orderBy(*order))
    numbered = bucketed.withColumn("_in", within).join(bases, [length_col, "_bucket"]).withColumn("_rank", F.col("_base") + F.col("_in") - 1)
    places = intervals(plan(by_length, capacity))
    n_most = int(max(by_length.values(), default=0)) + 1
    keys = places["length"] * n_most + places["first"]
    keep = pieces.columns

    def place(batches):
        for b in batches:
            length, rank = (np.asarray(b.column(c)) for c in (length_col, "_rank"))
            at = np.searchsorted(keys, length * n_most + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(places["sequence"][at] + rank - places["first"][at]), pa.array(places["offset"][at])], names=[*keep, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in keep)
    return numbered.select(*keep, F.col("_rank").cast("long")).mapInArrow(place, f"{schema}, sequence_id bigint, offset bigint")


def assemble(placed: DataFrame, ids_col: str) -> DataFrame:
    """The sequences themselves: sequence_id and ids, for placed pieces with a list of their ids. At most a capacity of ids each."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", ids_col)))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda x: x[ids_col])).alias("ids"))


def pack_documents(df: DataFrame, tokenizer: str | None = None, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    tune(df.sparkSession)
    return pack(materialize(token_pieces(df, str(tokenizer), end_id, capacity), "pieces"), capacity)


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
