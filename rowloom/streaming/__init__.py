"""Delimited files as they arrive: an addition, for folders that grow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.convert import Cells
from ..plans.options import ReadOptions
from ..sources.reader import KIND_OF, _plan
from ..sources.storage import readable


def read_stream(spark: SparkSession, folder: str, sample: str, types: dict[str, str] | None = None, **options) -> DataFrame:
    """A stream of the rows of new files in ``folder``, with the names and delimiter of ``sample``.

    Text columns but for ``types``; cells that aren't of their type are null. Each file has its own header line.
    """
    o = ReadOptions.of(**options)
    p = _plan(spark, readable(spark, sample), o)
    schema = ", ".join(f"`{n}` string" for n in p.names)
    found = spark.readStream.schema(schema).option("header", bool(o.header_rows())).option("sep", p.delim).option("quote", o.quotechar if o.quoted else "").option("escape", o.escapechar).option("nullValue", "\x01N").option("emptyValue", "").csv(folder)
    cells = Cells(o)
    return found.select(*(cells.to(cells.value(F.col(f"`{n}`")), KIND_OF[types[n]] if types and n in types else "string").alias(n) for n in p.names))
