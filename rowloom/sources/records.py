"""Lines and records of text files, without a global sort.

A quote opens a cell only at the cell's start. Where a line ends inside a cell, its record goes on; so each line is a
function of two states (begun outside or inside a cell), told by two patterns in the JVM. Files without such lines are
read as lines. In others the lines' functions are composed by chunk of a block, then over the chunks, records are numbered by
sums over chunks, put together, and written once for all later passes. Chunks, not blocks, are dealt to tasks, so that
tasks get even shares, and there are tasks enough for the text's size.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.options import ReadOptions
from .storage import new_path


def literal(text: str) -> str:
    """A pattern for a text that also works within a class of characters."""
    return "".join(rf"\x{{{ord(c):X}}}" for c in text)


@dataclass(frozen=True)
class Grammar:
    """Patterns of cells for a delimiter; possessive, so that they take time in proportion to the line and no stack."""

    delim: str
    body: str
    rest: str
    opening: str
    cell: str
    close: str

    @classmethod
    def of(cls, delim: str, o: ReadOptions) -> Grammar:
        d, q, c, e = literal(delim), literal(o.open), literal(o.close), literal(o.escapechar)
        body = rf"(?:[^{c}]++|{c}{c})*+" if o.escapechar == o.close else rf"(?:[^{c}{e}]++|{e}.|{e}\z)*+"
        rest = rf"[^{d}]*+" if len(delim) == 1 else rf"(?:(?!{d}).)*+"
        blank = literal("".join(b for b in " \t" if b not in delim and b not in o.sentinels))
        opening = (f"[{blank}]*+" if blank else "") + q
        d = f"(?:{d})++" if o.ignorerepeated else d
        return cls(d, body, rest, opening, f"(?:{opening}{body}{c}{rest}|(?!{opening}){rest})", c)

    def opens(self) -> str:
        """Lines that end inside a cell if they begin outside."""
        return rf"(?s)\A(?:{self.cell}{self.delim})*+{self.opening}{self.body}\z"

    def stays(self) -> str:
        """Lines that end inside a cell if they begin inside."""
        return rf"(?s)\A{self.body}(?:\z|{self.close}{self.rest}(?:{self.delim}{self.cell})*+{self.delim}{self.opening}{self.body}\z)"

    def tokens(self, value: Column, delim: str, o: ReadOptions) -> Column:
        """The cells of a record with quotes; unquoted empty ones are null, quoted ones ''."""
        found = F.regexp_extract_all(F.concat(F.lit(delim), value), F.lit(f"(?s){self.delim}({self.cell})"), F.lit(1))
        whole = rf"(?s)\A{self.opening}({self.body}){self.close}({self.rest})\z"
        strip = (lambda c: F.btrim(c, F.lit(" \t"))) if o.stripwhitespace else lambda c: c

        def unquoted(c):
            inside, after = F.regexp_extract(c, whole, 1), F.regexp_extract(c, whole, 2)
            inside = F.replace(inside, F.lit(o.close * 2), F.lit(o.close)) if o.escapechar == o.close else F.regexp_replace(inside, rf"(?s){literal(o.escapechar)}(.)", "$1")
            cell = F.concat(inside, F.when(F.btrim(after, F.lit(" \t")) == "", "").otherwise(after))
            return F.when(c.rlike(rf"(?s)\A{self.opening}"), strip(cell)).otherwise(F.nullif(strip(c), F.lit("")))

        return F.transform(found, unquoted)


def lines(spark: SparkSession, paths: list[str], o: ReadOptions, delim: str) -> DataFrame:
    """file, block, at (ascending in a block), value, quotes (whether there are any), opens, stays."""
    text = spark.read.option("encoding", o.encoding).text(paths)
    found = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    if not o.quoted:
        return found.select("*", *(F.lit(False).alias(c) for c in ("quotes", "opens", "stays")))
    g, v = Grammar.of(delim, o), F.col("value")
    quotes = v.contains(o.open) | v.contains(o.close)
    opens = quotes & v.rlike(g.opens())
    if o.comment is not None:
        opens = ~v.startswith(o.comment) & opens
    return found.select("*", quotes.alias("quotes"), opens.alias("opens"), (~quotes | v.rlike(g.stays())).alias("stays"))


def states(df: DataFrame, part: list[str], order: list[str], opens: str, stays: str) -> DataFrame:
    """Composes the functions (opens, stays) of rows in order. Adds ``flips`` (how often the state turned) and ``reset``
    (the state, less those turns, since the last row that didn't depend on it; null before one): the state after a row
    that began in s is (coalesce(reset, s) + flips) % 2."""
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    turn = (F.col(opens) & ~F.col(stays)).cast("int")
    df = df.withColumn("flips", F.sum(turn).over(w))
    fixed = F.when(F.col(opens) == F.col(stays), (F.col(opens).cast("int") + F.col("flips")) % 2)
    return df.withColumn("reset", F.last(fixed, ignorenulls=True).over(w))


def after(reset: Column, flips: Column, begun: int) -> Column:
    return (F.coalesce(reset, F.lit(begun)) + flips) % 2


def before(column: str, order: tuple[str, ...] = ("block",)) -> Column:
    w = Window.partitionBy("file").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(w), F.lit(0))


#: Blocks whose sums are sent to all tasks, at most (a path and a few numbers each); beyond them they are joined by a shuffle.
BLOCKS_SENT = 50_000

#: Lines of a block that are dealt to tasks together (a power of two), and bytes of text that a task gets, about.
CHUNK_LINES, TASK_BYTES = 1 << 12, 64 << 20


def stored(df: DataFrame) -> DataFrame:
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def same_blocks(spark: SparkSession):
    """Scans in here cut files into the same blocks and tasks, also if executors come or go meanwhile: lines are known from one scan to the next by their place in them."""
    name = "spark.sql.files.minPartitionNum"
    told = spark.conf.get(name, None)
    if told is None:
        spark.conf.set(name, spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if told is None:
            spark.conf.unset(name)


def numbered_lines(found: DataFrame, blocks: DataFrame, n_blocks: int) -> DataFrame:
    """file, rec (row number in the file, from 1), total (rows of the file), value, quotes, where each line is a record; ``blocks``: file, block, first, n."""
    total = F.sum("n").over(Window.partitionBy("file"))
    at = blocks.select("file", "block", "first", before("n").alias("b"), total.alias("total"))
    at = F.broadcast(at) if n_blocks <= BLOCKS_SENT else at
    return found.join(at, ["file", "block"]).select("file", (F.col("b") + F.col("at") - F.col("first") + 1).alias("rec"), "total", "value", "quotes")


def dealt(df: DataFrame, size: int, *keys: str) -> DataFrame:
    """By the keys to as many tasks as ``size`` bytes need; left to Spark where its own number is enough."""
    n = -(-size // TASK_BYTES)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def joined_records(found: DataFrame, size: int) -> DataFrame:
    """The same where records span lines (``size`` bytes of text in all); written once. An unclosed cell at a file's end is an error.
    The lines are scanned several times, which needs ``same_blocks``."""
    key = ["file", "block", "chunk"]
    inside = Window.partitionBy(*key).orderBy("at")
    chunked = dealt(found.withColumn("chunk", F.shiftright("at", CHUNK_LINES.bit_length() - 1)), size, *key)
    within = states(chunked, key, ["at"], "opens", "stays")
    last = within.groupBy(*key).agg(F.max_by(F.struct("reset", "flips"), "at").alias("x"))
    ends = [after(F.col("x.reset"), F.col("x.flips"), s) == 1 for s in (0, 1)]
    over = states(last.select(*key, ends[0].alias("opens"), ends[1].alias("stays")), ["file"], ["block", "chunk"], "opens", "stays")
    over = stored(over.select(*key, after(F.col("reset"), F.col("flips"), 0).alias("ends")))
    if not over.groupBy("file").agg(F.max_by("ends", F.struct("block", "chunk")).alias("ends")).filter("ends = 1").isEmpty():
        raise ValueError("a quoted cell isn't closed before the end of the input")
    begun = over.select(*key, F.lag("ends", 1, 0).over(Window.partitionBy("file").orderBy("block", "chunk")).alias("begun"))
    state = (F.coalesce(F.col("reset"), F.col("begun")) + F.col("flips")) % 2
    marked = within.join(begun, key).withColumn("after", state).withColumn("start", 1 - F.coalesce(F.lag("after").over(inside), F.col("begun")))
    marked = marked.withColumn("k", F.sum("start").over(inside)).select(*key, "at", "value", "quotes", "start", "k")
    starts = stored(marked.groupBy(*key).agg(F.sum("start").alias("n")))
    starts = starts.select(*key, before("n", ("block", "chunk")).alias("s"), F.sum("n").over(Window.partitionBy("file")).alias("total"))
    numbered = dealt(marked.join(starts, key).withColumn("rec", F.col("s") + F.col("k")), size, "file", "rec")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), "\n")
    return stored(numbered.groupBy("file", "rec").agg(F.first("total").alias("total"), text.alias("value"), F.max("quotes").alias("quotes")))
