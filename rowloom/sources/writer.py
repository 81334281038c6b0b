"""Writing delimited text: one text column, formatted by expressions, to one file, to files by partition, or to lines."""

from __future__ import annotations

import gzip
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.convert import java_pattern
from ..plans.options import WriteOptions
from .storage import Store, new_path


def quoted(text: Column, o: WriteOptions, always: bool = False) -> Column:
    """Quotes where they are needed: for the delimiter, line ends, an opening quote at the start, or a closing one."""
    signs = re.escape(o.open) if o.open == o.close else f"{re.escape(o.open)}{re.escape(o.close)}"
    escaped = F.regexp_replace(text, f"([{signs}])", F.lit(re.sub(r"([\\$])", r"\\\1", o.escapechar) + "$1"))
    inside = F.concat(F.lit(o.open), escaped, F.lit(o.close))
    if always:
        return inside
    end = "|" + re.escape(o.newline) if o.newline not in ("", "\n", "\r", "\r\n") else ""
    return F.when(text.rlike(rf"[\r\n]|\Q{o.delim}\E|^{re.escape(o.open)}|{re.escape(o.close)}{end}"), inside).otherwise(text)


def cell(c: Column, kind: T.DataType, o: WriteOptions) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        s = F.replace(F.replace(F.replace(c.cast("string"), F.lit("Infinity"), F.lit("Inf")), F.lit("E"), F.lit("e")), F.lit("."), F.lit(o.decimal))
        s = quoted(s, o) if o.decimal == o.delim else s
    elif isinstance(kind, T.DecimalType):
        s = F.translate(c.cast("string"), ".", o.decimal)
        s = quoted(s, o) if o.decimal == o.delim else s
    elif isinstance(kind, T.DateType):
        s = quoted(F.date_format(c, java_pattern(o.dateformat)) if o.dateformat else c.cast("string"), o)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        iso = F.regexp_replace(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"(?<=\.\d{3})0+$|\.000000$", "")
        s = quoted(F.date_format(c, java_pattern(o.dateformat)) if o.dateformat else iso, o)
    elif isinstance(kind, (T.BooleanType, T.IntegralType)):
        s = c.cast("string")
    elif isinstance(kind, T.StringType):
        s = quoted(c, o, o.quotestrings)
    else:
        s = quoted(F.to_json(c) if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else c.cast("string"), o, o.quotestrings)
    return F.coalesce(s, F.lit(o.missingstring))


def transformed(df: DataFrame, o: WriteOptions) -> DataFrame:
    """``transform`` takes the column's number from 1, its name and the column."""
    if o.transform is None:
        return df
    return df.select(*(o.transform(i, n, F.col(f"`{n}`")).alias(n) for i, n in enumerate(df.columns, 1)))


def names(df: DataFrame, o: WriteOptions) -> list[str]:
    if isinstance(o.header, bool):
        return df.columns
    if len(o.header) != len(df.columns):
        raise ValueError("as many names as columns are needed")
    return list(o.header)


def plain_quoted(text: str, o: WriteOptions, always: bool = False) -> str:
    needed = o.delim in text or "\r" in text or "\n" in text or text.startswith(o.open) or o.close in text
    if not (needed or always):
        return text
    return o.open + "".join(o.escapechar + c if c in (o.open, o.close) else c for c in text) + o.close


def header_line(df: DataFrame, o: WriteOptions) -> str:
    return o.delim.join(plain_quoted(n, o, o.quotestrings) for n in names(df, o))


def format_rows(df: DataFrame, **options) -> DataFrame:
    """The rows as a text column ``line``, without the header."""
    o = WriteOptions.of(**options)
    t = transformed(df, o)
    return t.select(F.concat_ws(o.delim, *(cell(F.col(f"`{f.name}`"), f.dataType, o) for f in t.schema)).alias("line"))


def iter_rows(df: DataFrame, **options):
    """Lines with their ends, the header first."""
    o = WriteOptions.of(**options)
    if o.header:
        yield header_line(df, o) + o.newline
    for r in format_rows(df, **options).toLocalIterator():
        yield r["line"] + o.newline


def write_row(values, **options) -> str:
    """One row of Python values as text with its line end."""
    o = WriteOptions.of(**options)
    out = []
    for v in values:
        if v is None:
            out.append(o.missingstring)
        elif isinstance(v, bool):
            out.append(str(v).lower())
        elif isinstance(v, float):
            s = "NaN" if v != v else ("Inf" if v > 0 else "-Inf") if v in (float("inf"), float("-inf")) else repr(v)
            out.append(s.replace(".", o.decimal))
        elif isinstance(v, int):
            out.append(str(v))
        else:
            out.append(plain_quoted(v.isoformat() if hasattr(v, "isoformat") else str(v), o, o.quotestrings and isinstance(v, str)))
    return o.delim.join(out) + o.newline


def write_delimited(df: DataFrame, target, **options):
    """Writes to one file (parts are written by Spark and put together in order), a folder of files with
    ``partition``, or an object with write(). Returns the target. Compressed parts make one valid gzip file."""
    o = WriteOptions.of(**options)
    spark = df.sparkSession
    if hasattr(target, "write"):
        for x in iter_rows(df, **options):
            target.write(x)
        return target
    lines = format_rows(df, **options)
    text_options = {"lineSep": o.newline, **({"compression": "gzip"} if o.compress else {})}
    if o.newline == "":
        body = "".join(iter_rows(df, **options)).encode()
        Store(spark, str(target)).write([gzip.compress(body) if o.compress else body])
        return target
    if o.partition:
        head = header_line(df, o) if o.header else None

        def with_header(batches):
            import pyarrow as pa

            if head is not None:
                yield pa.RecordBatch.from_arrays([pa.array([head])], names=["line"])
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0)], names=["line"])

        lines.mapInArrow(with_header, "line string").write.options(**text_options).mode("append" if o.append else "error").text(str(target))
        return target
    parts = new_path(spark)
    lines.write.options(**text_options).text(parts)
    store = Store(spark, str(target))
    start = (b"\xef\xbb\xbf" if o.bom else b"") + (header_line(df, o) + o.newline if o.header else "").encode()
    old = [str(target)] if o.append and store.exists() else []
    store.write([*old, *([gzip.compress(start) if o.compress else start] if start else []), *Store(spark, parts).files()])
    Store(spark, parts).delete()
    return target


def writer(target, **options):
    """A function that writes a table to ``target`` and returns it."""
    return lambda df: write_delimited(df, target, **options)
