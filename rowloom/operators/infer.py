"""Column types from one aggregation: the kind of the first present cell, widened by what all cells are."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.convert import Cells

CHUNK = 150  # columns in one aggregation


@dataclass(frozen=True)
class Found:
    """What the aggregation says about a column."""

    kind: str | None
    first: str | None
    present: int
    rows: int
    low: int | None = None
    high: int | None = None
    distinct: int | None = None


#: What a column whose first cell has a kind may become; texts need no look at their other cells.
MAYBE = {"int": ("int", "decimal(38,0)", "float"), "string": ()}


def joined_kind(first: str | None, present: int, counts: dict[str, int]) -> str | None:
    """The column's kind: the first cell's if all cells have it, else a wider number, else text; None without cells."""
    if not present:
        return None
    return next((t for t in MAYBE.get(first, (first,)) if counts.get(t) == present), "string")


def infer(df: DataFrame, columns: list[Column], readers: list[Cells], firsts: list[str | None], pool: bool = False) -> list[Found]:
    """What a column's first present cell leaves open is counted in one pass. ``firsts``: those cells, where they are known
    (from the first lines); a pass looks for the others, in the order of files and their rows."""
    out: list[Found] = []
    for s in range(0, len(columns), CHUNK):
        part = list(enumerate(zip(columns[s : s + CHUNK], readers[s : s + CHUNK], strict=True)))
        values = [r.value(c) for _, (c, r) in part]
        known = dict(enumerate(firsts[s : s + CHUNK]))
        if unknown := [k for k, x in known.items() if x is None]:
            at = [F.col(c) for c in ("file", "rec") if c in df.columns] or [F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]
            if "file" in df.columns and "rec" not in df.columns:
                at.append(F.monotonically_increasing_id())
            placed = df.select("*", F.struct(*(c.alias(f"o{k}") for k, c in enumerate(at))).alias("_order"))
            row = placed.agg(*(F.min_by(values[k], F.when(values[k].isNotNull(), F.col("_order"))).alias(f"c{k}") for k in unknown)).first()
            known |= {k: row[f"c{k}"] for k in unknown}
        kinds = df.sparkSession.range(0, 1, 1, 1).select(*(F.when(F.lit(known[k]).isNotNull(), r.kind(F.lit(known[k]).cast("string"))).alias(f"k{k}") for k, (_, r) in part)).first()
        asked = [F.count("*").alias("rows")]
        for k, (_, r) in part:
            kind, v = kinds[f"k{k}"], values[k]
            asked.append(F.count(v).alias(f"n{k}"))
            asked += [F.count(r.to(v, t)).alias(f"{t[0]}_{k}") for t in (MAYBE.get(kind, (kind,)) if kind else ())]
            if kind == "int":
                asked += [F.min(r.to(v, "int")).alias(f"lo_{k}"), F.max(r.to(v, "int")).alias(f"hi_{k}")]
            if pool and kind == "string":
                asked.append(F.approx_count_distinct(v, 0.01).alias(f"u_{k}"))
        got = df.agg(*asked).first().asDict()
        for k, _ in part:
            kind = kinds[f"k{k}"]
            counts = {t: got[f"{t[0]}_{k}"] for t in (MAYBE.get(kind, (kind,)) if kind else ())}
            out.append(Found(joined_kind(kind, got[f"n{k}"], counts), kind, got[f"n{k}"], got["rows"], got.get(f"lo_{k}"), got.get(f"hi_{k}"), got.get(f"u_{k}")))
    return out


def smallest(low: int, high: int) -> str:
    """The smallest integer type that holds both."""
    return next((t for t, bits in (("tinyint", 8), ("smallint", 16), ("int32", 32)) if -(1 << bits - 1) <= low and high < 1 << bits - 1), "int")


def pooled(found: Found, pool, textual: bool) -> bool:
    """Whether a column is worth a dictionary: few distinct values (counted within about 1 %), and few for its rows."""
    if pool is False or pool is None or found.distinct is None or not textual:
        return False
    share, most = (1.0, None) if pool is True else pool if isinstance(pool, tuple) else (pool, None)
    return (most is None or found.distinct <= most) and (found.distinct - 1) / max(1, found.rows) <= share
