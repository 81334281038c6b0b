"""Registered queries: driver tables are written as delimited text and read back; results are held against SQL on the tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import detect_type, format_rows, iter_chunks, parse_cell, read_delimited, read_many, read_rows, write_delimited
from .sources.storage import Store, new_path

QUERIES, SQL = {}, {}
TABLES = {
    "region": ("r_regionkey", "r_name"), "nation": ("n_nationkey", "n_name", "n_regionkey"), "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
    "supplier": ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"),
}
INTS = ("r_regionkey", "n_nationkey", "n_regionkey", "c_nationkey", "s_nationkey", "p_size", "l_linenumber")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def trip(df: DataFrame, write: dict | None = None, suffix: str = "", **options) -> DataFrame:
    """Write to a folder of files in the shared folder (to one file where rows are counted from its ends), read it back."""
    path = new_path(df.sparkSession, suffix)
    single = suffix or any(o in options for o in ("skipto", "footerskip", "limit"))
    write_delimited(df, path, **{"partition": not single, **(write or {})})
    return read_delimited(df.sparkSession, path, **options)


def query(name: str, sql: str | None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def selected(columns, table_name: str) -> str:
    return "SELECT " + ", ".join(f"CAST({c} AS BIGINT) AS {c}" if c in INTS else c for c in columns) + f" FROM {table_name}"


for _t, _c in TABLES.items():
    query(f"scan_roundtrip_{_t}", selected(_c, _t))(lambda spark, d, t=_t, c=_c: trip(table(spark, d, t).select(*c)))
for _n, _d in (("tab", "\t"), ("pipe", "|"), ("semicolon", ";")):
    query(f"scan_sniff_{_n}", selected(TABLES["supplier"], "supplier"))(lambda spark, d, x=_d: trip(table(spark, d, "supplier"), {"delim": x}))
for _n, _o in {
    "select_names": {"select": ["c_custkey", "c_name"]}, "select_index": {"select": [1, 2]}, "select_mask": {"select": [True, True, False, False, False]}, "select_fn": {"select": lambda i, n: i < 3},
    "drop": {"drop": ["c_nationkey", "c_acctbal", "c_mktsegment"]},
}.items():
    query(f"scan_{_n}", "SELECT c_custkey, c_name FROM customer")(lambda spark, d, o=_o: trip(table(spark, d, "customer"), **o))

Q1 = """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus"""


@query("q1_over_delimited", Q1)
def q1_over_delimited(spark, d):
    """The flagship: lineitem out as text, back with inferred types, then an aggregate with pruned columns."""
    li = trip(table(spark, d, "lineitem"), pool=False)
    li = li.filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("scan_roundtrip_orders", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def scan_orders(spark, d):
    return trip(table(spark, d, "orders"))


@query("scan_roundtrip_lineitem", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity, l_extendedprice, l_shipdate FROM lineitem")
def scan_lineitem(spark, d):
    return trip(table(spark, d, "lineitem"), select=["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate"], pool=False)


@query("scan_multichar_delim", selected(TABLES["part"], "part"))
def multichar(spark, d):
    return trip(table(spark, d, "part"), {"delim": "::"}, delim="::")


@query("scan_gzip", selected(TABLES["customer"], "customer"))
def gz(spark, d):
    return trip(table(spark, d, "customer"), {"compress": True}, ".csv.gz")


@query("scan_gzip_noext", selected(TABLES["customer"], "customer"))
def gz_noext(spark, d):
    return trip(table(spark, d, "customer"), {"compress": True, "partition": False})


@query("scan_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 25")
def limit(spark, d):
    return trip(table(spark, d, "orders").select("o_orderkey", "o_totalprice").sort("o_orderkey"), limit=25)


@query("scan_skipto", "SELECT c_custkey, c_name FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) AS r FROM customer) WHERE r > 4")
def skipto(spark, d):
    return trip(table(spark, d, "customer").select("c_custkey", "c_name").sort("c_custkey"), skipto=6)


@query("scan_footerskip", "SELECT c_custkey, c_name FROM (SELECT *, row_number() OVER (ORDER BY c_custkey DESC) AS r FROM customer) WHERE r > 3")
def footerskip(spark, d):
    return trip(table(spark, d, "customer").select("c_custkey", "c_name").sort("c_custkey"), footerskip=3)


@query("scan_comment_multichar", "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 5 <> 0")
def comment(spark, d):
    df = table(spark, d, "customer").select(F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("//"), "c_custkey")).otherwise(F.col("c_custkey").cast("string")).alias("c_custkey"), "c_name")
    return trip(df, comment="//")


@query("scan_normalized_names", 'SELECT s_suppkey AS supplier_key, s_name AS "_2nd_name" FROM supplier')
def normalized(spark, d):
    return trip(table(spark, d, "supplier").select("s_suppkey", "s_name"), {"header": [" supplier key ", "2nd name"]}, normalizenames=True)


@query("scan_duplicate_names", "SELECT s_suppkey AS a, s_suppkey + 1 AS a_2, s_suppkey + 2 AS a_1 FROM supplier")
def duplicates(spark, d):
    s = F.col("s_suppkey")
    return trip(table(spark, d, "supplier").select(s, (s + 1).alias("x"), (s + 2).alias("y")), {"header": ["a", "a", "a_1"]})


def lines_of(spark, df: DataFrame, first: str, **options) -> DataFrame:
    """Reads rows of ready-made text."""
    parts, path = new_path(spark), new_path(spark)
    df.select("line").write.text(parts)
    Store(spark, path).write([(first + "\n").encode(), *Store(spark, parts).files()])
    return read_delimited(spark, path, **options)


@query("scan_multirow_header", "SELECT c_custkey AS c_custkey_key, c_name AS c_name_name FROM customer")
def multirow(spark, d):
    return lines_of(spark, format_rows(table(spark, d, "customer").select("c_custkey", "c_name")), "c_custkey,c_name\nkey,name", header=[1, 2])


@query("scan_stray_quotes", "SELECT c_custkey, c_custkey || '\" pipe' AS size, CASE WHEN c_custkey % 3 = 0 THEN 'a,\"b\"' || chr(10) || 'c' ELSE 'the \"' || c_name END AS text FROM customer")
def stray_quotes(spark, d):
    """Quote characters within plain cells are text; between them stand quoted cells over two lines."""
    k = F.col("c_custkey").cast("string")
    text = F.when(F.col("c_custkey") % 3 == 0, F.lit('"a,""b""\nc"')).otherwise(F.concat(F.lit('the "'), "c_name"))
    return lines_of(spark, table(spark, d, "customer").select(F.concat_ws(",", k, F.concat(k, F.lit('" pipe')), text).alias("line")), "c_custkey,size,text")


@query("scan_comment_quotes", "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 5 <> 0")
def comment_quotes(spark, d):
    line = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit('# they said "'), "c_name")).otherwise(F.concat_ws(",", F.col("c_custkey").cast("string"), F.concat(F.lit('"'), "c_name", F.lit('"'))))
    return lines_of(spark, table(spark, d, "customer").select(line.alias("line")), "c_custkey,c_name", comment="#")


@query("scan_no_header", 'SELECT c_custkey AS "Column1", c_name AS "Column2" FROM customer')
def no_header(spark, d):
    return trip(table(spark, d, "customer").select("c_custkey", "c_name"), {"header": False}, header=False)


@query("scan_given_names", "SELECT c_custkey AS k, c_name AS n FROM customer")
def given_names(spark, d):
    return trip(table(spark, d, "customer").select("c_custkey", "c_name"), {"header": False}, header=["k", "n"], skipto=1)


@query("scan_repeated_delims", "SELECT c_custkey, c_nationkey::BIGINT AS c_nationkey FROM customer")
def repeated_delims(spark, d):
    line = F.concat(F.lit("  "), F.col("c_custkey").cast("string"), F.lit("   "), F.col("c_nationkey").cast("string"), F.lit(" "))
    return lines_of(spark, table(spark, d, "customer").select(line.alias("line")), "c_custkey c_nationkey", delim=" ", ignorerepeated=True)


@query("scan_unquoted", "SELECT c_custkey, '\"' || c_name AS c_name FROM customer")
def unquoted(spark, d):
    return lines_of(spark, table(spark, d, "customer").select(F.concat(F.col("c_custkey").cast("string"), F.lit(',"'), "c_name").alias("line")), "c_custkey,c_name", quoted=False)


@query("scan_strip_whitespace", "SELECT c_custkey, c_name, ' x ' || c_custkey AS q FROM customer")
def strip_whitespace(spark, d):
    line = F.concat(F.lit(" "), F.col("c_custkey").cast("string"), F.lit(" ,\t"), "c_name", F.lit(' , "x '), F.col("c_custkey").cast("string"), F.lit('"'))
    df = lines_of(spark, table(spark, d, "customer").select(line.alias("line")), "c_custkey,c_name,q", stripwhitespace=True)
    return df.withColumn("q", F.concat(F.lit(" "), "q"))


@query("scan_empty_rows", "SELECT CASE WHEN c_custkey % 4 <> 0 THEN c_custkey END AS c_custkey FROM customer")
def empty_rows(spark, d):
    return lines_of(spark, table(spark, d, "customer").select(F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.col("c_custkey").cast("string")).alias("line")), "c_custkey", ignoreemptyrows=False)


@query("types_function", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CAST(c_acctbal AS FLOAT) AS c_acctbal FROM customer")
def types_function(spark, d):
    return trip(table(spark, d, "customer").select("c_custkey", "c_acctbal"), types=lambda i, n: "string" if n.endswith("key") else "float")


@query("types_one_strict", "SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, c_acctbal FROM customer")
def types_one_strict(spark, d):
    return trip(table(spark, d, "customer").select("c_custkey", "c_acctbal"), types="double", strict=True)


@query("dateformat_global", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + 1 AS b FROM orders")
def dateformat_global(spark, d):
    day = F.col("o_orderdate").cast("date")
    df = trip(table(spark, d, "orders").select("o_orderkey", day.alias("a"), F.date_add(day, 1).alias("b")), {"dateformat": "dd.mm.yyyy"}, dateformat="dd.mm.yyyy", types={1: "bigint", 2: "date", 3: "date"})
    return df


@query("concat_sources", "SELECT c_custkey, c_name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def concat_sources(spark, d):
    paths = [new_path(spark), new_path(spark)]
    write_delimited(table(spark, d, "customer").select("c_custkey", "c_name"), paths[0], partition=True)
    write_delimited(table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name")), paths[1], partition=True)
    return read_many(spark, paths)


@query("write_append_bom", "SELECT c_custkey, c_name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def append_bom(spark, d):
    """A file with a byte order mark, and rows appended to it."""
    path = new_path(spark)
    write_delimited(table(spark, d, "customer").select("c_custkey", "c_name"), path, bom=True)
    write_delimited(table(spark, d, "supplier").select("s_suppkey", "s_name"), path, append=True)
    return read_delimited(spark, path)


@query("write_newline", "SELECT c_custkey, c_name FROM customer")
def write_newline(spark, d):
    return trip(table(spark, d, "customer").select("c_custkey", "c_name"), {"newline": "\r\n"})


@query("infer_time", "SELECT event_id, strftime(ts, '%H:%M:%S') AS t FROM events")
def infer_time(spark, d):
    return trip(table(spark, d, "events").select("event_id", F.date_format("ts", "HH:mm:ss").alias("t")))


@query("scan_short_rows", "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS c_name, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS c_acctbal FROM customer")
def short(spark, d):
    k = F.col("c_custkey").cast("string")
    df = table(spark, d, "customer").select(F.when(F.col("c_custkey") % 3 == 0, k).otherwise(F.concat_ws(",", k, "c_name", F.col("c_acctbal").cast("string"))).alias("line"))
    return lines_of(spark, df, "c_custkey,c_name,c_acctbal")


@query("scan_widened_rows", 'SELECT c_custkey, c_name, CASE WHEN c_custkey % 4 = 0 THEN c_custkey * 2 END AS "Column3" FROM customer')
def widened(spark, d):
    k = F.col("c_custkey")
    df = table(spark, d, "customer").select(F.concat_ws(",", k.cast("string"), "c_name", F.when(k % 4 == 0, (k * 2).cast("string"))).alias("line"))
    return lines_of(spark, df, "c_custkey,c_name", delim=",", silencewarnings=True)


@query("infer_int_float_promote", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE c_custkey + 0.5 END::DOUBLE AS x FROM customer")
def int_float(spark, d):
    k = F.col("c_custkey")
    return trip(table(spark, d, "customer").select(k, F.when(k % 2 == 0, k.cast("string")).otherwise((k + 0.5).cast("string")).alias("x")))


@query("infer_string_promote", "SELECT c_custkey, CASE WHEN c_custkey % 100 = 0 THEN 'n/a' ELSE CAST(c_custkey AS VARCHAR) END AS x FROM customer")
def to_string(spark, d):
    k = F.col("c_custkey")
    return trip(table(spark, d, "customer").select(k, F.when(k % 100 == 0, "n/a").otherwise(k.cast("string")).alias("x")))


@query("infer_bool_date_datetime", "SELECT o_orderkey, o_orderkey % 2 = 0 AS b, CAST(o_orderdate AS DATE) AS d, o_orderdate AS t FROM orders")
def kinds(spark, d):
    return trip(table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 2 == 0).alias("b"), F.col("o_orderdate").cast("date").alias("d"), F.col("o_orderdate").alias("t")))


@query("typemap_int_to_string", "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name FROM supplier")
def typemap(spark, d):
    return trip(table(spark, d, "supplier").select("s_suppkey", "s_name"), typemap={"int": "string"})


@query("downcast_ints", "SELECT CAST(c_nationkey AS TINYINT) AS c_nationkey, c_name FROM customer")
def downcast(spark, d):
    return trip(table(spark, d, "customer").select("c_nationkey", "c_name"), downcast=True)


@query("explicit_types", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, CAST(p_size AS SMALLINT) AS p_size, CAST(p_retailprice AS DOUBLE) AS p_retailprice FROM part")
def explicit(spark, d):
    return trip(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), types={1: "string", "p_size": "smallint", re.compile("price$"): "double"})


@query("missing_sentinels", "SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 11 <> 0 THEN c_name END AS c_name FROM customer")
def sentinels(spark, d):
    k = F.col("c_custkey")
    return trip(table(spark, d, "customer").select(k, F.when(k % 7 != 0, F.col("c_acctbal")).alias("c_acctbal"), F.when(k % 11 == 0, "NULL").otherwise(F.col("c_name")).alias("c_name")), {"missingstring": "NA"}, missingstring=["NA", "NULL"])


@query("missing_none", "SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_name ELSE '' END AS c_name FROM customer")
def no_missing(spark, d):
    k = F.col("c_custkey")
    return trip(table(spark, d, "customer").select(k, F.when(k % 7 != 0, F.col("c_name")).alias("c_name")), missingstring=None)


@query("decimal_comma", "SELECT s_suppkey, s_acctbal FROM supplier")
def decimal_comma(spark, d):
    return trip(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), {"delim": ";", "decimal": ","}, delim=";", decimal=",")


@query("groupmark", "SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS price FROM orders")
def groupmark(spark, d):
    return trip(table(spark, d, "orders").select("o_orderkey", F.format_number(F.floor("o_totalprice"), 0).alias("price")), groupmark=",", delim=",")


@query("custom_bools", "SELECT c_custkey, c_custkey % 2 = 0 AS b FROM customer")
def bools(spark, d):
    return trip(table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "oui").otherwise("non").alias("b")), truestrings=("oui",), falsestrings=("non",))


@query("dateformat_dict", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def dateformat(spark, d):
    return trip(table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day")), {"dateformat": "mm/dd/yyyy"}, dateformat={"day": "mm/dd/yyyy"})


@query("lenient_bad_cells", "SELECT c_custkey, CASE WHEN c_custkey % 50 <> 0 THEN c_acctbal END AS x FROM customer")
def lenient(spark, d):
    k = F.col("c_custkey")
    return trip(table(spark, d, "customer").select(k, F.when(k % 50 == 0, "bad").otherwise(F.col("c_acctbal").cast("string")).alias("x")), types={"x": "double"}, silencewarnings=True)


@query("quoted_newlines", "SELECT doc_id, text, lang FROM documents")
def quoted_newlines(spark, d):
    return trip(table(spark, d, "documents").select("doc_id", "text", "lang"), pool=False)


@query("quoted_text_roundtrip", "SELECT event_id, user_id, event_type, props FROM events")
def quoted_props(spark, d):
    return trip(table(spark, d, "events").select("event_id", "user_id", "event_type", "props"), pool=False)


@query("open_close_quotes", "SELECT s_suppkey, s_name || ',' || s_suppkey AS x FROM supplier")
def open_close(spark, d):
    o = {"openquotechar": "{", "closequotechar": "}", "escapechar": "\\"}
    return trip(table(spark, d, "supplier").select("s_suppkey", F.concat("s_name", F.lit(","), "s_suppkey").alias("x")), o, **o)


def transposed(spark, df: DataFrame, key: str, name: str) -> DataFrame:
    """A line for each column, put together by Spark, read as columns."""
    line = lambda c: F.concat_ws(",", F.lit(c), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, F.col(c).cast("string").alias("x")))), lambda r: r["x"]), ","))
    path = new_path(spark)
    df.agg(F.array(line(key), line(name)).alias("x")).select(F.explode("x").alias("line")).coalesce(1).write.text(path)
    return read_delimited(spark, path, transpose=True)


query("transpose_customer", "SELECT c_custkey, c_name FROM customer")(lambda spark, d: transposed(spark, table(spark, d, "customer"), "c_custkey", "c_name"))
query("transpose_region", "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region")(lambda spark, d: transposed(spark, table(spark, d, "region"), "r_regionkey", "r_name"))


def two(spark, d):
    s = table(spark, d, "supplier")
    paths = [new_path(spark), new_path(spark)]
    write_delimited(s.filter("s_suppkey % 2 = 0").select("s_suppkey", "s_name", "s_acctbal"), paths[0])
    write_delimited(s.filter("s_suppkey % 2 = 1").select("s_name", F.col("s_suppkey").alias("s_suppkey"), F.lit(1).alias("more")), paths[1])
    return paths


TWO = "SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END AS s_acctbal"


@query("concat_missing_column", TWO + " FROM supplier")
def concat_missing(spark, d):
    return read_many(spark, two(spark, d))


@query("source_column", TWO + ", CASE WHEN s_suppkey % 2 = 0 THEN 'even' ELSE 'odd' END AS origin FROM supplier")
def source_column(spark, d):
    return read_many(spark, two(spark, d), ("origin", ["even", "odd"]))


def formatted(name: str, sql: str, make, **options):
    query(name, sql)(lambda spark, d: format_rows(make(spark, d), **options))


formatted("format_rows_quote", "SELECT event_id || ',\"' || replace(props, '\"', '\"\"') || '\"' AS line FROM events", lambda s, d: table(s, d, "events").select("event_id", "props"))
formatted("format_rows_quotestrings", "SELECT s_suppkey || ',\"' || s_name || '\"' AS line FROM supplier", lambda s, d: table(s, d, "supplier").select("s_suppkey", "s_name"), quotestrings=True)
formatted("format_rows_decimal", "SELECT s_suppkey || ';' || replace(CAST(s_acctbal AS VARCHAR), '.', ',') AS line FROM supplier", lambda s, d: table(s, d, "supplier").select("s_suppkey", "s_acctbal"), delim=";", decimal=",")
formatted("format_rows_dateformat", "SELECT o_orderkey || '|' || strftime(o_orderdate, '%d.%m.%Y') AS line FROM orders", lambda s, d: table(s, d, "orders").select("o_orderkey", "o_orderdate"), delim="|", dateformat="dd.mm.yyyy")
formatted("format_rows_missingstring", "SELECT c_custkey || ',' || CASE WHEN c_custkey % 3 = 0 THEN 'NULL' ELSE c_name END AS line FROM customer", lambda s, d: table(s, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("n")), missingstring="NULL")
formatted("format_rows_transform", "SELECT (c_custkey + 1) || ',' || upper(c_name) AS line FROM customer", lambda s, d: table(s, d, "customer").select("c_custkey", "c_name"), transform=lambda i, n, c: c + 1 if i == 1 else F.upper(c))


@query("rows_all_strings", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer")
def rows_all_strings(spark, d):
    path = new_path(spark)
    write_delimited(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"), path, partition=True)
    return read_rows(spark, path)


@query("chunks_union", "SELECT c_custkey, c_name FROM customer")
def chunks_union(spark, d):
    path, out = new_path(spark), None
    write_delimited(table(spark, d, "customer").select("c_custkey", "c_name"), path)
    for part in iter_chunks(spark, path, ntasks=3, infer_each=False):
        out = part if out is None else out.unionByName(part)
    return out


@query("partitioned_write", "SELECT c_custkey, c_name FROM customer")
def partitioned(spark, d):
    path = new_path(spark)
    write_delimited(table(spark, d, "customer").select("c_custkey", "c_name").repartition(3), path, partition=True)
    found = read_many(spark, Store(spark, path).files())
    return found


CELL = "CASE event_id % 6 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN user_id || '.25' WHEN 2 THEN strftime(ts, '%Y-%m-%d') WHEN 3 THEN strftime(ts, '%H:%M:%S') WHEN 4 THEN CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'F' END ELSE event_type END"


def mixed_cells(spark, d):
    """event_id and a text of one of six kinds."""
    k, user = F.col("event_id") % 6, F.col("user_id").cast("string")
    cell = F.when(k == 0, user).when(k == 1, F.concat(user, F.lit(".25"))).when(k == 2, F.date_format("ts", "yyyy-MM-dd")).when(k == 3, F.date_format("ts", "HH:mm:ss")).when(k == 4, F.when(F.col("user_id") % 2 == 0, "true").otherwise("F")).otherwise(F.col("event_type"))
    return table(spark, d, "events").select("event_id", cell.alias("cell"))


@query("detect_kind", rf"""SELECT event_id, CASE WHEN regexp_full_match(c, '[+-]?\d+') THEN 'int' WHEN regexp_full_match(c, '[+-]?\d+\.\d*') THEN 'float' WHEN try_cast(c AS DATE) IS NOT NULL THEN 'date'
    WHEN try_cast(c AS TIME) IS NOT NULL THEN 'time' WHEN c IN ('true', 'false', 'T', 'F') THEN 'bool' ELSE 'string' END AS kind FROM (SELECT event_id, {CELL} AS c FROM events)""")
def detect_kind(spark, d):
    return mixed_cells(spark, d).select("event_id", detect_type(F.col("cell")).alias("kind"))


@query("parse_cell", rf"""SELECT event_id, CASE WHEN c NOT LIKE '%.%' THEN try_cast(c AS BIGINT) END AS a, try_cast(c AS DOUBLE) AS b, CASE WHEN regexp_full_match(c, '\d+-\d+-\d+') THEN try_cast(c AS DATE) END AS day,
    CASE WHEN c IN ('true', 'T', '1') THEN true WHEN c IN ('false', 'F', '0') THEN false END AS yes FROM (SELECT event_id, {CELL} AS c FROM events)""")
def parsed(spark, d):
    c = F.col("cell")
    return mixed_cells(spark, d).select("event_id", parse_cell(c, "int").alias("a"), parse_cell(c, "float").alias("b"), parse_cell(c, "date").alias("day"), parse_cell(c, "bool").alias("yes"))


@query("pool_decision", "SELECT 'c_mktsegment' AS name, count(DISTINCT c_mktsegment) <= 500 AND (count(DISTINCT c_mktsegment) - 1) / count(*) <= 0.2 AS pooled FROM customer UNION ALL SELECT 'c_name', count(DISTINCT c_name) <= 500 AND (count(DISTINCT c_name) - 1) / count(*) <= 0.2 FROM customer")
def pool_decision(spark, d):
    df = trip(table(spark, d, "customer").select("c_name", "c_mktsegment"))
    return df.limit(1).select(F.explode(F.array(*(F.struct(F.lit(f.name).alias("name"), F.lit(f.metadata["pooled"]).alias("pooled")) for f in df.schema))).alias("x")).select("x.*")
