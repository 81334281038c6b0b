"""Reading delimited text: a plan from the first lines, one pass over all lines, one to infer types, then a lazy projection."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.convert import Cells
from ..operators.infer import infer, pooled, smallest
from ..plans.names import by_column, check_keys, head_records, header_names, kept_columns, skipped, sniff, split_line, unique
from ..plans.options import ReadOptions
from .records import BLOCKS_SENT, Grammar, joined_records, lines, literal, numbered_lines, same_blocks, stored
from .storage import readable

HEAD = 200  # lines looked at for the plan, at least
SPARK_TYPES = {"int": "bigint", "float": "double", "bool": "boolean", "datetime": "timestamp_ntz", "int32": "int", "float32": "float", "time": "string"}
KIND_OF = {"bigint": "int", "long": "int", "double": "float", "boolean": "bool", "timestamp_ntz": "datetime", "timestamp": "datetime", "int": "int32", "integer": "int32", "float": "float32", "smallint": "smallint", "short": "smallint", "tinyint": "tinyint", "byte": "tinyint", "decimal(38,0)": "decimal(38,0)", "date": "date", "string": "string", "time": "time"}


@dataclass(frozen=True)
class Plan:
    """How a source will be read, from its first lines."""

    paths: list[str]
    options: ReadOptions
    delim: str
    names: list[str]
    first_row: int
    last_row: int | None  # of a chunk
    header_row: int
    before: list[str]  # the records above the first row
    head: list[list[str | None]]  # cells of the first rows
    quotes: bool | None = None


@dataclass(frozen=True)
class Survey:
    """What one pass over all lines told."""

    blocks: DataFrame  # file, block, first, n: written
    n_blocks: int
    quotes: bool
    multiline: bool
    blank: bool  # lines of white space only
    width: int
    bad: int | None
    records: DataFrame | None = None


def plan_delimited(spark: SparkSession, source, **options) -> Plan:
    p = _plan(spark, readable(spark, source), ReadOptions.of(**options))
    return replace(p, quotes=survey(spark, p).quotes)


def _plan(spark: SparkSession, paths: list[str], o: ReadOptions) -> Plan:
    wanted = max([o.first_row(), *o.header_rows(), 1]) + HEAD
    text = [r[0] for r in spark.read.option("encoding", o.encoding).text(paths[:1]).limit(wanted).collect()] if paths else []
    least = min([*o.header_rows(), o.first_row()])
    delim = o.delim or sniff(text[least - 1 :], o, paths[0] if paths else "")
    found = dict(enumerate(head_records(text, delim, o), 1))
    rows = {k: v for k, v in found.items() if not skipped(v, o)}
    header, at = [], 0
    for want in o.header_rows():
        at = next((k for k in sorted(rows) if k >= max(want, at + 1)), want)
        if at in rows:
            header.append(cells_of(rows[at], delim, o))
    if o.header_rows() and o.skipto == o.header_rows()[-1]:
        header, first = [], o.skipto
    else:
        first = o.skipto if o.skipto is not None else at + 1
    data = [cells_of(rows[k], delim, o) for k in sorted(rows) if k >= first]
    width = max([len(data[0]) if data and not header and not o.given_names() else 0, *map(len, header)])
    return Plan(paths, o, delim, header_names(header, width, o), first, None, at, [v for k, v in found.items() if k < first], data)


def cells_of(record: str, delim: str, o: ReadOptions) -> list[str | None]:
    try:
        return split_line(record, delim, o)
    except ValueError:  # open at the end of the first lines: the survey tells whether it is closed
        return split_line(record, delim, replace(o, quoted=False))


def survey(spark: SparkSession, p: Plan, bad=None) -> Survey:
    """One pass over all lines, by blocks. ``bad`` makes, from a function of a column's number, a count of bad cells."""
    o, v = p.options, F.col("value")
    found = lines(spark, p.paths, o, p.delim).withColumn("data", ~v.isin(p.before)) if p.before else lines(spark, p.paths, o, p.delim).withColumn("data", F.lit(True))
    if o.comment is not None:
        found = found.withColumn("data", F.col("data") & ~v.startswith(o.comment))
    if o.ignoreemptyrows:
        found = found.withColumn("data", F.col("data") & (v != ""))
    cells = tokens(p, o.quoted)
    most = F.length(v) - F.length(F.replace(v, F.lit(p.delim), F.lit(""))) if len(p.delim) == 1 else F.lit(1 << 20)
    width = F.max(F.when(F.col("data"), F.when(most + 1 <= len(p.names), most + 1).otherwise(F.size(cells))))
    more = {}
    if bad is not None:
        found = found.withColumn("cells", cells)
        more["bad"] = F.sum(F.when(F.col("data"), bad(lambda i: F.get("cells", F.lit(i)))).otherwise(0))
    sums = found.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"), F.sum(F.octet_length(v)).alias("size"), F.max("quotes").alias("quotes"), F.max("opens").alias("opens"), F.max((v != "") & (F.btrim(v) == "")).alias("blank"), width.alias("width"), *(c.alias(k) for k, c in more.items()))
    sums = stored(sums)
    row = sums.agg(F.count("*").alias("k"), *(F.max(c).alias(c) for c in ("quotes", "opens", "blank", "width")), *(F.sum(c).alias(c) for c in ("size", *more))).first()
    multiline = bool(row["opens"]) if o.multiline is None else o.multiline and bool(row["opens"])
    with same_blocks(spark):
        records = joined_records(lines(spark, p.paths, o, p.delim), row["size"] or 0) if multiline else None
    return Survey(sums.select("file", "block", "first", "n"), row["k"], bool(row["quotes"]), multiline, bool(row["blank"]), row["width"] or 0, (row["bad"] or 0) if more else None, records)


def tokens(p: Plan, quotes: bool) -> Column:
    """The cells of a record (columns value, quotes) as an array."""
    o, delim, v = p.options, p.delim, F.col("value")
    mark = delim if len(delim) == 1 and delim not in ".$|()[{^?*+\\" else "\\" + delim if len(delim) == 1 else r"\Q" + delim + r"\E"
    if o.ignorerepeated:
        d = literal(delim)
        v = F.regexp_replace(v, f"^(?:{d})+|(?:{d})+$", "")
    plain = F.split(v, f"(?:{literal(delim)})+" if o.ignorerepeated else mark, -1)
    strip = (lambda c: F.btrim(c, F.lit(" \t"))) if o.stripwhitespace else lambda c: c
    plain = F.transform(plain, lambda c: F.nullif(strip(c), F.lit("")))
    return F.when(F.col("quotes"), Grammar.of(delim, o).tokens(v, delim, o)).otherwise(plain) if quotes else plain


def records(spark: SparkSession, p: Plan, s: Survey) -> DataFrame:
    """file, rec, total, value, quotes of all rows."""
    return s.records if s.records is not None else numbered_lines(lines(spark, p.paths, p.options, p.delim), s.blocks, s.n_blocks)


def cells(spark: SparkSession, p: Plan, s: Survey, numbered: bool = False):
    """The data rows, and a function that gives the column of a cell by its number. Rows are numbered (file, rec) only where that is needed."""
    o = p.options
    plain = s.records is None and not (numbered or o.footerskip or o.limit is not None or p.last_row)
    if plain and max(s.width, len(p.names)) and not s.quotes and not s.blank and len(p.delim) == 1 and o.comment is None and o.ignoreemptyrows and not (o.ignorerepeated or o.stripwhitespace) and (p.header_row, p.first_row) in ((0, 1), (1, 2)):
        width = max(s.width, len(p.names))
        schema = ", ".join(f"_c{k} string" for k in range(width))
        rows = spark.read.schema(schema).options(sep=p.delim, quote="", header=p.first_row == 2, encoding=o.encoding, maxColumns=width + 1, maxCharsPerColumn=-1).csv(p.paths)
        return rows, lambda i: F.col(f"_c{i}")
    if plain:
        r = lines(spark, p.paths, o, p.delim)
        begins = s.blocks.filter("block = 0").select("first")
        if p.first_row > 1 and s.n_blocks <= BLOCKS_SENT and not begins.isEmpty() and s.blocks.filter(F.col("n") < p.first_row).isEmpty():
            firsts = [x[0] for x in begins.collect()]  # one for each file
            gone = [F.col("at").between(x, x + p.first_row - 2) for x in firsts]
            if len(gone) > 64:
                plain = False
            for x in gone if plain else ():
                r = r.filter(~x)
        elif p.first_row > 1:
            plain = False
    if not plain:
        r = records(spark, p, s).filter(F.col("rec") >= p.first_row)
    if p.last_row:
        r = r.filter(F.col("rec") <= p.last_row)
    if o.footerskip:
        r = r.filter(F.col("rec") <= F.col("total") - o.footerskip)
    if o.comment is not None:
        r = r.filter(~F.col("value").startswith(o.comment))
    if o.ignoreemptyrows:
        r = r.filter(F.col("value") != "")
    if o.limit is not None:
        r = r.orderBy("file", "rec").limit(o.limit)
    return r.select(*(c for c in ("file", "rec") if c in r.columns), tokens(p, s.quotes).alias("cells")), lambda i: F.get(F.col("cells"), F.lit(i))


def wanted_type(given, i: int, name: str):
    """The type that the caller gives a column: a kind's name, or (function of a text column, Spark type)."""
    if given is None:
        return None
    if callable(given):
        t = given(i, name)
    elif isinstance(given, dict):
        t = by_column(given, i, name)
    elif isinstance(given, list):
        t = given[i - 1] if i <= len(given) else None
    else:
        t = given
    if t is None or isinstance(t, tuple):
        return t
    t = t.simpleString() if isinstance(t, T.DataType) else str(t)
    if t not in KIND_OF:
        raise ValueError(f"not a type for cells: {t}")
    return KIND_OF[t]


def _warn(o: ReadOptions, text: str) -> None:
    if not o.silencewarnings:
        warnings.warn(text, stacklevel=4)


def _table(spark: SparkSession, p: Plan, all_strings: bool = False, keep_order: bool = False, s: Survey | None = None) -> DataFrame:
    o = p.options
    told_all = [wanted_type(o.types, i + 1, n) for i, n in enumerate(p.names)]
    formats_all = [by_column(o.dateformat, i + 1, n) if isinstance(o.dateformat, dict) else o.dateformat for i, n in enumerate(p.names)]
    kept = kept_columns(p.names, o)

    def bad_cells(get, told, formats, kept):
        out = F.lit(0)
        for i in kept:
            if told[i] not in (None, "string"):
                value = Cells(o, formats[i]).value(get(i))
                out = out + (value.isNotNull() & typed_as(Cells(o, formats[i]), value, told[i]).isNull()).cast("long")
        return out

    checked = any(told_all[i] not in (None, "string") for i in kept)
    if s is None:
        s = survey(spark, p, (lambda get: bad_cells(get, told_all, formats_all, kept)) if checked and not o.silencewarnings and not o.strict and not p.last_row else None)
    numbered = keep_order or s.records is not None
    data, get = cells(spark, p, s, numbered)
    names = p.names
    if s.multiline or o.footerskip or o.limit is not None or p.last_row or s.width > len(names):
        width = data.agg(F.max(F.size("cells"))).first()[0] or 0 if "cells" in data.columns else s.width
        if width > len(names):
            if names:
                _warn(o, f"rows have up to {width} cells; columns are added")
            names = header_or(names, width)
    if o.validate:
        for what in ("types", "dateformat", "pool"):
            check_keys(getattr(o, what), names, what)
    told_all = [wanted_type(o.types, i + 1, n) for i, n in enumerate(names)]
    formats_all = [by_column(o.dateformat, i + 1, n) if isinstance(o.dateformat, dict) else o.dateformat for i, n in enumerate(names)]
    kept = kept_columns(names, o)
    columns, told = [get(i) for i in kept], [told_all[i] for i in kept]
    readers = [Cells(o, formats_all[i]) for i in kept]
    ask = [k for k, t in enumerate(told) if t is None and not all_strings]
    found = {}
    if ask:
        in_order = p.last_row is None and s.records is None
        firsts = [next((x for row in p.head if kept[k] < len(row) and (x := readers[k].present(row[kept[k]])) is not None), None) if in_order else None for k in ask]
        found = dict(zip(ask, infer(data, [columns[k] for k in ask], [readers[k] for k in ask], firsts, o.pool is not False), strict=True))
    out = []
    for k, i in enumerate(kept):
        value, meta = readers[k].value(columns[k]), {}
        if all_strings and told[k] is None:
            typed = value
        elif told[k] is not None:
            typed = typed_as(readers[k], value, told[k])
        else:
            f = found[k]
            kind = f.kind
            meta = {"missing_only": f.kind is None, "missing": f.present < f.rows}
            if kind == "int" and o.downcast:
                kind = smallest(f.low, f.high)
            if f.kind in o.typemap or SPARK_TYPES.get(f.kind, f.kind) in o.typemap:
                kind = KIND_OF[str(o.typemap.get(f.kind) or o.typemap[SPARK_TYPES.get(f.kind, f.kind)])]
            choice = o.pool(i + 1, names[i]) if callable(o.pool) else by_column(o.pool, i + 1, names[i]) if isinstance(o.pool, dict) else o.pool[i] if isinstance(o.pool, list) else o.pool
            meta["pooled"] = pooled(f, choice, kind in (None, "string") or o.pool is not choice)
            typed = typed_as(readers[k], value, kind)
        out.append(typed.alias(names[i], metadata=meta))
    if any(t not in (None, "string") for t in told) and (o.strict or not o.silencewarnings):
        n = s.bad
        if n is None or s.records is not None or len(names) != len(p.names) or o.strict or o.footerskip or o.limit is not None:
            n = data.agg(F.sum(bad_cells(get, told_all, formats_all, kept))).first()[0] or 0
        if n and o.strict:
            raise ValueError(f"{n} cells aren't of their columns' types")
        if n:
            _warn(o, f"{n} cells aren't of their columns' types and are null")
    order = [F.col("file").alias("_file"), F.col("rec").alias("_rec")] if keep_order else []
    return data.select(*order, *out)


def typed_as(reader: Cells, value: Column, kind) -> Column:
    if isinstance(kind, tuple):
        return kind[0](value).cast(kind[1])
    return reader.to(value, kind) if kind not in (None, "string") else value


def header_or(names: list[str], width: int) -> list[str]:
    return unique([*names, *(f"Column{i}" for i in range(len(names) + 1, width + 1))])


def read_delimited(spark: SparkSession, source, source_column=None, **options) -> DataFrame:
    """A table from a path, bytes, a file object, or a list of those.

    Several sources are put under the first one's columns by name, types widened, columns that one lacks null.
    ``source_column`` (a name, or a pair of a name and labels) adds where a row comes from, as the last column.
    """
    if isinstance(source, (list, tuple)):
        return read_many(spark, list(source), source_column, **options)
    o = ReadOptions.of(**options)
    paths = readable(spark, source)
    if o.transpose:
        return _transposed(spark, paths, o)
    return _table(spark, _plan(spark, paths, o))


def _transposed(spark: SparkSession, paths: list[str], o: ReadOptions) -> DataFrame:
    """Lines are columns. Cells are numbered and pivoted; the first line's width is the number of rows."""
    flat = _plan(spark, paths, replace(o, header=False, transpose=False, skipto=None))
    skip = int(o.header) if not isinstance(o.header, (list, tuple)) else 0
    data, _ = cells(spark, flat, survey(spark, flat), True)
    rows = data.orderBy("rec").select("rec", F.size("cells").alias("n"), F.get("cells", F.lit(max(skip - 1, 0))).alias("name")).collect()  # a row for each column
    names = unique([n if skip and n else f"Column{k}" for k, n in enumerate((r["name"] for r in rows), 1)]) if o.given_names() is None else header_names([], len(rows), o)
    if not rows:
        return spark.createDataFrame([], T.StructType([]))
    first = o.skipto - 1 if o.skipto else skip
    long = data.select("rec", F.posexplode("cells").alias("rec2", "cell")).filter((F.col("rec2") >= first) & (F.col("rec2") < rows[0]["n"]))
    wide = long.groupBy("rec2").pivot("rec", [r["rec"] for r in rows]).agg(F.first("cell"))
    wide = wide.select(F.lit("").alias("file"), F.col("rec2").cast("long").alias("rec"), F.array(*(F.col(f"`{r['rec']}`") for r in rows)).alias("cells"))
    columns = [F.get("cells", F.lit(k)) for k in range(len(rows))]
    readers = [Cells(o, by_column(o.dateformat, k + 1, n) if isinstance(o.dateformat, dict) else o.dateformat) for k, n in enumerate(names)]
    found = infer(wide.select("file", "rec", "cells"), columns, readers, [None] * len(columns))
    kept = kept_columns(names, o)
    kinds = [wanted_type(o.types, k + 1, names[k]) or found[k].kind for k in kept]
    return wide.orderBy("rec").select(*(readers[k].to(readers[k].value(columns[k]), t or "string").alias(names[k]) for k, t in zip(kept, kinds, strict=True)))


WIDER = ("tinyint", "smallint", "int", "bigint", "decimal(38,0)", "double")


def read_many(spark: SparkSession, sources: list, source_column=None, **options) -> DataFrame:
    if not sources:
        raise ValueError("no sources")
    name, labels = (source_column if isinstance(source_column, tuple) else (source_column, [str(s) for s in sources])) if source_column else (None, None)
    if labels is not None and len(labels) != len(sources):
        raise ValueError("as many labels as sources are needed")
    tables = [read_delimited(spark, s, **options) for s in sources]
    kinds: dict[str, str] = {}
    for c in tables[0].columns:
        found = {t.schema[c].dataType.simpleString() for t in tables if c in t.columns and not t.schema[c].metadata.get("missing_only")} or {"string"}
        kinds[c] = next(iter(found)) if len(found) == 1 else max(found, key=WIDER.index) if found <= set(WIDER) else "string"
    out = None
    for k, t in enumerate(tables):
        row = t.select(*((F.col(f"`{c}`").cast(kinds[c]) if c in t.columns else F.lit(None).cast(kinds[c])).alias(c) for c in kinds), *([F.lit(labels[k]).alias(name)] if name and len(sources) > 1 else []))
        out = row if out is None else out.unionByName(row)
    return out


def read(spark: SparkSession, source, sink, **options):
    """Reads and hands the table to ``sink``, a function."""
    if sink is None:
        raise ValueError("a sink is needed")
    return sink(read_delimited(spark, source, **options))


def read_rows(spark: SparkSession, source, **options) -> DataFrame:
    """Cells as they are: text columns, but for those whose type is given. Iterate with toLocalIterator()."""
    o = ReadOptions.of(**options)
    return _table(spark, _plan(spark, readable(spark, source), o), all_strings=True)


def iter_chunks(spark: SparkSession, source, ntasks: int = 8, infer_each: bool = True, **options):
    """``ntasks`` tables of consecutive rows; each infers its own types, or all have the whole table's."""
    if ntasks < 1:
        raise ValueError("ntasks must be positive")
    o = ReadOptions.of(**options)
    if o.transpose:
        raise ValueError("transposed input has no chunks")
    p = _plan(spark, readable(spark, source), o)
    s = survey(spark, p)
    whole = None if infer_each else _table(spark, p, keep_order=True, s=s)
    data, _ = cells(spark, p, s, True)
    last = data.agg(F.max("rec")).first()[0] or 0
    step = max(1, -(-(last - p.first_row + 1) // ntasks))
    for first in range(p.first_row, last + 1, step):
        if whole is not None:
            yield whole.filter(F.col("_rec").between(first, first + step - 1)).drop("_file", "_rec")
        else:
            yield _table(spark, replace(p, first_row=first, last_row=min(last, first + step - 1)), s=s)
