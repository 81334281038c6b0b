import datetime
import gzip
import re
import warnings

import pytest
from pyspark.sql import functions as F

from rowloom import detect, detect_type, iter_chunks, parse_cell, plan_delimited, read, read_delimited, read_many, read_rows
from rowloom.plans.names import normalized, unique
from rowloom.sources import records

D, DT = datetime.date, datetime.datetime
I, R, S = "bigint", "double", "string"

# text, options, names, types, rows
CASES = [
    ("x\n1\n3.14", {}, ["x"], [R], [(1.0,), (3.14,)]),
    ("x\n1\nabc", {}, ["x"], [S], [("1",), ("abc",)]),
    ("x\n\n1\n3.14\nabc", {"ignoreemptyrows": False}, ["x"], [S], [(None,), ("1",), ("3.14",), ("abc",)]),
    ("x\n1\n32767", {"downcast": True}, ["x"], ["smallint"], [(1,), (32767,)]),
    ("x\n1\n-128", {"downcast": True}, ["x"], ["tinyint"], [(1,), (-128,)]),
    ("x,y\n1,\n2,\n", {}, ["x", "y"], [I, S], [(1, None), (2, None)]),
    ("x\ty\n1\t\n2\t\n", {}, ["x", "y"], [I, S], [(1, None), (2, None)]),
    ("x y\n1 \n2 \n", {}, ["x", "y"], [I, S], [(1, None), (2, None)]),
    ("x|y\n1|\n2|\n", {}, ["x", "y"], [I, S], [(1, None), (2, None)]),
    ('x\n","\n","', {}, ["x"], [S], [(",",), (",",)]),
    ("x\nabc\n", {"types": "bigint", "silencewarnings": True}, ["x"], [I], [(None,)]),
    (' "2018-01-01", "1" ,1,2,3', {"skipto": 1}, ["Column1", "Column2", "Column3", "Column4", "Column5"], ["date", I, I, I, I], [(D(2018, 1, 1), 1, 1, 2, 3)]),
    (",column2\nNA,2\n2,3", {"missingstring": ["NA"]}, ["Column1", "column2"], [I, I], [(None, 2), (2, 3)]),
    ("col1\n\n \n  \n1\n2\n3", {"missingstring": ["", " ", "  "], "ignoreemptyrows": False}, ["col1"], [I], [(None,), (None,), (None,), (1,), (2,), (3,)]),
    ("1, a\n2, b\n3, c\n4, d\n\n", {"skipto": 1, "footerskip": 1}, ["Column1", "Column2"], [I, S], [(1, " a"), (2, " b"), (3, " c"), (4, " d")]),
    ("1, a\r\n2, b\r\n3, c\r\n4, d\r\n\r\n", {"skipto": 1, "footerskip": 2}, ["Column1", "Column2"], [I, S], [(1, " a"), (2, " b"), (3, " c")]),
    ("a,b,c\n1,2,3\n,null,4\n", {"missingstring": None}, ["a", "b", "c"], [S, S, I], [("1", "2", 3), ("", "null", 4)]),
    ("a, 0.1, 0.2, 0.3\nb, 0.4", {"transpose": True}, ["a", "b"], [R, R], [(0.1, 0.4), (0.2, None), (0.3, None)]),
    ("time,date,datetime\n10:00:00.0,04/16/2020,2020-04-16 23:14:00", {"dateformat": {2: "mm/dd/yyyy", 3: "yyyy-mm-dd HH:MM:SS"}}, ["time", "date", "datetime"], [S, "date", "timestamp_ntz"], [("10:00:00", D(2020, 4, 16), DT(2020, 4, 16, 23, 14))]),
    ("a,b\n1,2\n3,", {}, ["a", "b"], [I, I], [(1, 2), (3, None)]),
    ("x   y   z\n   1   2   3", {"delim": " ", "ignorerepeated": True}, ["x", "y", "z"], [I, I, I], [(1, 2, 3)]),
    ("a b c d e\n1 2  3 4 5\n1 2 3  4 5\n1  2 3  4 5", {"delim": " ", "silencewarnings": True}, ["a", "b", "c", "d", "e", "Column6", "Column7"], [I, I, I, I, I, I, I], [(1, 2, None, 3, 4, 5, None), (1, 2, 3, None, 4, 5, None), (1, None, 2, 3, None, 4, 5)]),
    ("A;B;C\n1,1,10\n2,0,16", {}, ["A", "B", "C"], [S, S, S], [("1,1,10", None, None), ("2,0,16", None, None)]),
    ("﻿col1,col2\r\n1.0,2\r\n", {}, ["col1", "col2"], [R, I], [(1.0, 2)]),
    ("a\r1\r2\r", {}, ["a"], [I], [(1,), (2,)]),
    ("a::b\n1::2\n", {"delim": "::"}, ["a", "b"], [I, I], [(1, 2)]),
    ("a,b\n{x,y},2\n", {"openquotechar": "{", "closequotechar": "}"}, ["a", "b"], [S, I], [("x,y", 2)]),
    ('a,b\n"x ""q"" y",""\n', {}, ["a", "b"], [S, S], [('x "q" y', "")]),
    ('a,b\n"x \\" y",1\n', {"escapechar": "\\"}, ["a", "b"], [S, I], [('x " y', 1)]),
    ('a,b\n"x\n\ny",1\n2,"p\nq"\n', {}, ["a", "b"], [S, S], [("x\n\ny", "1"), ("2", "p\nq")]),
    ("a,b\n\"x,1\n", {"quoted": False}, ["a", "b"], [S, I], [('"x', 1)]),
    ("#c\na,b\n#d\n1,2\n", {"comment": "#"}, ["a", "b"], [I, I], [(1, 2)]),
    ("// c\na,b\n// d\n1,2\n", {"comment": "//"}, ["a", "b"], [I, I], [(1, 2)]),
    ("a,b\nc,d\n1,2\n", {"header": [1, 2]}, ["a_c", "b_d"], [I, I], [(1, 2)]),
    ("x\ny\na,b\n1,2\n3,4\nend\n", {"header": 3, "footerskip": 1}, ["a", "b"], [I, I], [(1, 2), (3, 4)]),
    ("1,2\n", {"header": False}, ["Column1", "Column2"], [I, I], [(1, 2)]),
    ("1,2\n", {"header": ["p", "q"]}, ["p", "q"], [I, I], [(1, 2)]),
    ("a b,1st,class\n1,2,3\n", {"normalizenames": True}, ["a_b", "_1st", "_class"], [I, I, I], [(1, 2, 3)]),
    ("a,a,a_1\n1,2,3\n", {}, ["a", "a_2", "a_1"], [I, I, I], [(1, 2, 3)]),
    ("a,b,c\n1\n2,3\n4,5,6", {}, ["a", "b", "c"], [I, I, I], [(1, None, None), (2, 3, None), (4, 5, 6)]),
    ("a\n1\n2\n3\n", {"limit": 2}, ["a"], [I], [(1,), (2,)]),
    ("", {}, [], [], []),
    ("a,b\n", {}, ["a", "b"], [S, S], []),
    ("a;b\n3,14;1\n1,0;2\n", {"delim": ";", "decimal": ","}, ["a", "b"], [R, I], [(3.14, 1), (1.0, 2)]),
    ('a;b\n"1,234";1,000,000\n', {"delim": ";", "groupmark": ","}, ["a", "b"], [I, I], [(1234, 1000000)]),
    ("a,b,c\ntrue,T,1\nfalse,1,0\n", {}, ["a", "b", "c"], ["boolean", "boolean", I], [(True, True, 1), (False, True, 0)]),
    ("a\ny\nn\n", {"truestrings": ("y",), "falsestrings": ("n",)}, ["a"], ["boolean"], [(True,), (False,)]),
    ("a\n03494\n", {"typemap": {"int": "string"}}, ["a"], [S], [("03494",)]),
    ("a\n1\n9223372036854775808\n", {}, ["a"], ["decimal(38,0)"], [(1,), (9223372036854775808,)]),
    ("a\n9223372036854775808\n", {}, ["a"], [R], [(9223372036854775808.0,)]),
    ("a\n2019-02-30\n2019\n", {}, ["a"], [S], [("2019-02-30",), ("2019",)]),
    ("a,b\n2020-01-01T10:00:00.123,2020-01-01T00:00:00.12345\n", {}, ["a", "b"], ["timestamp_ntz", S], [(DT(2020, 1, 1, 10, 0, 0, 123000), "2020-01-01T00:00:00.12345")]),
    ("a\n1d\ninf\nyes\n", {}, ["a"], [S], [("1d",), ("inf",), ("yes",)]),
    ("a,b\n x , 2 \n", {"stripwhitespace": True}, ["a", "b"], [S, I], [("x", 2)]),
    ("t\n7/2/2020 9:05:00 PM\n", {"dateformat": "m/d/yyyy I:MM:SS p", "delim": ","}, ["t"], ["timestamp_ntz"], [(DT(2020, 7, 2, 21, 5),)]),
    ("a\x01b\n1\x012\n", {"delim": "\x01"}, ["a", "b"], [I, I], [(1, 2)]),
]


@pytest.mark.parametrize("text,options,names,types,rows", CASES)
def test_cases(spark, text, options, names, types, rows):
    df = read_delimited(spark, text.encode(), **options)
    assert df.columns == names
    assert [f.dataType.simpleString() for f in df.schema] == types
    assert sorted(map(tuple, df.collect()), key=str) == sorted(rows, key=str)


@pytest.mark.parametrize("given", [{"select": [1, 3, 5]}, {"select": ["e", "a", "c"]}, {"select": [True, False, True, False, True]}, {"select": lambda i, n: n in "ace"}, {"drop": [2, 4]}, {"drop": ["b", "d"]}, {"drop": [False, True, False, True, False]}, {"drop": lambda i, n: i in (2, 4)}])
def test_projection(spark, given):
    df = read_delimited(spark, b"a,b,c,d,e\n1,2,3,4,5\n6,7,8,9,10", **given)
    assert df.columns == ["a", "c", "e"] and list(map(tuple, df.collect())) == [(1, 3, 5), (6, 8, 10)]


@pytest.mark.parametrize("text,options", [("x\n\"never ends", {}), ("x\nabc", {"types": "bigint", "strict": True}), ("a\n1", {"types": {"zz": "bigint"}}), ("a\n1", {"delim": "\n"}), ("a\n1", {"select": [1], "drop": [1]}), ("a\n1", {"types": "nonsense"}), ("a\n1", {"ignorerepeated": True}), ("a\n1", {"pool": 2.0}), ("a\n1", {"header": 3, "skipto": 2}), ("a\n1", {"openquotechar": "{"})])
def test_errors(spark, text, options):
    with pytest.raises(ValueError):
        read_delimited(spark, text.encode(), **options).collect()


def test_missing_path(spark):
    with pytest.raises(ValueError):
        read_delimited(spark, "/nowhere/at.csv")
    with pytest.raises(ValueError):
        read(spark, b"a\n1", None)
    assert read(spark, b"a\n1", lambda df: df.count()) == 1


def test_types_by_key(spark):
    text = b"id,a1,a2\n1,2,3"
    df = read_delimited(spark, text, types={1: "smallint", re.compile("^a"): "double", "a2": "string"})
    assert [t for _, t in df.dtypes] == ["smallint", "double", "string"]
    df = read_delimited(spark, b"v\n1.5;2\n", types={"v": (lambda c: F.transform(F.split(c, ";"), lambda x: x.cast("double")), "array<double>")}, delim=",")
    assert df.first()[0] == [1.5, 2.0]
    with warnings.catch_warnings(record=True) as got:
        warnings.simplefilter("always")
        read_delimited(spark, b"a\nx", type="bigint", datarow=2)
    assert {g.category for g in got} >= {DeprecationWarning}


def test_gzip_and_sources(spark, tmp_path):
    data = b"a,b,c\n1,2,3\n4,5,6\n"
    (tmp_path / "x").write_bytes(gzip.compress(data))
    (tmp_path / "y.tsv").write_bytes(b"a\tb\tc\n7.14\t8\t9\n")
    assert read_delimited(spark, gzip.compress(data)).count() == 2
    df = read_many(spark, [str(tmp_path / "x"), str(tmp_path / "y.tsv"), b"a2,b\n1,2\n"], ("from", ["p", "q", "r"]))
    assert df.dtypes == [("a", "double"), ("b", "bigint"), ("c", "bigint"), ("from", "string")]
    assert sorted(map(tuple, df.collect()), key=str) == sorted([(1.0, 2, 3, "p"), (4.0, 5, 6, "p"), (7.14, 8, 9, "q"), (None, 2, None, "r")], key=str)
    with pytest.raises(ValueError):
        read_many(spark, [data, data], ("from", ["p"]))


def test_many_blocks(spark, tmp_path):
    rows = [(k, f"line {k}\nmore \"{k}\"" if k % 3 else f"plain {k}") for k in range(4000)]
    quote = '"'
    text = "k,t\n" + "".join(f'{k},"{t.replace(quote, quote * 2)}"\n' for k, t in rows)
    (tmp_path / "big.csv").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = read_delimited(spark, str(tmp_path / "big.csv"), footerskip=1, skipto=3)
        assert sorted(map(tuple, df.collect())) == rows[1:-1]
        flat = "k\n" + "".join(f"{k}\n" for k in range(5000))
        (tmp_path / "flat.csv").write_text(flat)
        assert [r[0] for r in read_delimited(spark, str(tmp_path / "flat.csv"), skipto=11, footerskip=7).sort("k").collect()] == list(range(9, 4993))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_rows_and_chunks(spark):
    df = read_rows(spark, b"x,y,z\n1,2,3\n4,5,6,7,8,", silencewarnings=True)
    assert df.columns[:3] == ["x", "y", "z"] and len(df.columns) == 6 and {t for _, t in df.dtypes} == {"string"}
    assert read_rows(spark, b"x,y\n1,2", types={"y": "bigint"}).dtypes == [("x", "string"), ("y", "bigint")]
    data = "a\n" + "".join(f"{k}\n" for k in range(20)) + "z\n"
    parts = list(iter_chunks(spark, data.encode(), ntasks=3))
    assert [p.dtypes[0][1] for p in parts] == ["bigint", "bigint", "string"] and sum(p.count() for p in parts) == 21
    assert {p.dtypes[0][1] for p in iter_chunks(spark, data.encode(), ntasks=3, infer_each=False)} == {"string"}
    with pytest.raises(ValueError):
        list(iter_chunks(spark, b"a\n1", ntasks=0))


def test_scalars(spark):
    assert [detect(x) for x in ("1", "1.5", "2020-01-01", "2020-13-01", "true", "abc")] == [1, 1.5, D(2020, 1, 1), "2020-13-01", True, "abc"]
    df = spark.createDataFrame([("1",), ("1.5",), ("10:00:00",), ("true",), ("x",), ("",)], "c string")
    assert [r[0] for r in df.select(detect_type(F.col("c"))).collect()] == ["int", "float", "time", "bool", "string", None]
    assert [r[0] for r in df.select(parse_cell(F.col("c"), "float")).collect()] == [1.0, 1.5, None, None, None, None]


def test_names():
    assert unique(["a", "a", "a"]) == ["a", "a_1", "a_2"] and unique(["a", "a_1", "a"]) == ["a", "a_1", "a_2"]
    assert [normalized(x) for x in (" x  y ", "", "2", "for", "a__b")] == ["x_y", "_", "_2", "_for", "a_b"]


def test_plan_and_pool(spark):
    p = plan_delimited(spark, b"a;b\n1;2\n3;4\n")
    assert (p.delim, p.names, p.first_row, p.quotes) == (";", ["a", "b"], 2, False)
    text = "a,b\n" + "".join(f"k{i % 3},v{i}\n" for i in range(100))
    df = read_delimited(spark, text.encode())
    assert [f.metadata["pooled"] for f in df.schema] == [True, False]
    assert [f.metadata["pooled"] for f in read_delimited(spark, text.encode(), pool=True).schema] == [True, True]
    assert [f.metadata["pooled"] for f in read_delimited(spark, b"a\n1\n1\n", pool=True).schema] == [False]


def test_stream(spark, tmp_path):
    from rowloom.streaming import read_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.csv").write_text('a,b\n1,"x,y"\n2,\n')
    q = read_stream(spark, str(tmp_path / "in"), str(tmp_path / "in" / "1.csv"), {"a": "bigint"}).writeStream.format("memory").queryName("arrived").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("arrived").collect())) == [(1, "x,y"), (2, None)]


STRAY = [
    ('a,b\n5" pipe,1\n6,2\n7" rod,3\n8,4\n', {}, [('5" pipe', 1), ("6", 2), ('7" rod', 3), ("8", 4)]),
    ('a,b\n5" pipe,1\n6,2\n', {}, [('5" pipe', 1), ("6", 2)]),
    ('a,b\n# they said "hi\n1,2\n', {"comment": "#"}, [(1, 2)]),
    ('a,b\n1,"x\n# no comment"\n2,y\n', {"comment": "#"}, [(1, "x\n# no comment"), (2, "y")]),
    ('a,b\n1,"x"" y"\n2, "z" \n3,"p"q\n', {}, [(1, 'x" y'), (2, "z"), (3, "pq")]),
    ('a,b\n1,"x\n""\n"",\n"\n2,""\n', {"missingstring": "NA"}, [(1, 'x\n"\n",\n'), (2, "")]),
    ("a,b\n1,{x\\}\ny}\n2,z}\n", {"openquotechar": "{", "closequotechar": "}", "escapechar": "\\"}, [(1, "x}\ny"), (2, "z}")]),
    ('a::b\n1::"x::\ny"\n2::q"z\n', {"delim": "::"}, [(1, "x::\ny"), (2, 'q"z')]),
    ("a,b\n1d,1e3\n0x1p3,.5\n", {}, [("1d", 1000.0), ("0x1p3", 0.5)]),
    ("a,b\n \n1,2\n", {}, [(" ", None), ("1", 2)]),
]


@pytest.mark.parametrize("text,options,rows", STRAY)
def test_stray_quotes(spark, text, options, rows):
    assert sorted(map(tuple, read_delimited(spark, text.encode(), **options).collect()), key=str) == sorted(rows, key=str)


@pytest.mark.parametrize("text", ['a\n1,"x\n', 'a,b\n1," open\n2,34\n', 'a\n"x""\n'])
def test_unclosed(spark, text):
    with pytest.raises(ValueError, match="closed"):
        read_delimited(spark, text.encode()).collect()


def test_quotes_at_borders(spark, tmp_path):
    """Blocks end at every place of a record with quotes: within cells, stray quotes, doubled ones and line ends."""
    rows = [(k, f'{k}" x', f'a\n"{k}",\nb' if k % 3 else "plain") for k in range(25)]
    cell = lambda t: '"' + t.replace('"', '""') + '"' if "\n" in t else t
    (tmp_path / "b.csv").write_text("k,s,t\n" + "".join(f"{k},{s},{cell(t)}\n" for k, s, t in rows))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        for size in (23, 64):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            assert sorted(map(tuple, read_delimited(spark, str(tmp_path / "b.csv")).collect())) == rows
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_block_is_dealt_to_many_tasks(spark, tmp_path, monkeypatch):
    """One block's lines go by chunks to as many tasks as the text's size needs, and records reach over chunks."""
    rows = [(k, "\n".join([f"{k}"] * (k % 30 + 1))) for k in range(400)]
    (tmp_path / "one.csv").write_text("k,t\n" + "".join(f'{k},"{t}"\n' for k, t in rows))
    plans, write = [], records.stored
    monkeypatch.setattr(records, "stored", lambda df: plans.append(df._jdf.queryExecution().toString()) or write(df))
    for name, value in (("CHUNK_LINES", 8), ("TASK_BYTES", 1000)):
        monkeypatch.setattr(records, name, value, raising=False)
    assert sorted(map(tuple, read_delimited(spark, str(tmp_path / "one.csv")).collect())) == rows
    keys = [(re.sub(r"#\d+L?", "", k).split(", ")) for k in re.findall(r"Exchange hashpartitioning\(([^()]*)\)", plans[-1])]
    text = [k for k in keys if k[:2] == ["file", "block"] or k[:2] == ["file", "rec"]]
    assert text and all(k[-2] in ("chunk", "rec") for k in text) and max(int(k[-1]) for k in text) > 4


def jobs(spark, run) -> int:
    group = f"counted-{id(run)}"
    spark.sparkContext.setJobGroup(group, group)
    run()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("other", "other")
    return n


def test_passes(spark, tmp_path):
    """An ordinary file is read for its first lines, once for all lines, once for inference, and for the result."""
    (tmp_path / "p.csv").write_text("a,b,c\n" + "".join(f"{k},{k / 4},x{k}\n" for k in range(500)))
    path = str(tmp_path / "p.csv")
    assert jobs(spark, lambda: read_delimited(spark, path, types=["bigint", "double", "string"]).collect()) <= 6
    assert jobs(spark, lambda: read_delimited(spark, path).collect()) <= 9
    plan = read_delimited(spark, path, types=["bigint", "double", "string"], select=["b"])._jdf.queryExecution().toString()
    assert "ReadSchema: struct<_c1:string>" in plan


def test_sources_of_all_kinds(spark, tmp_path):
    import io
    import subprocess

    data = b"a,b\n1,x\n2,y\n"
    want = [(1, "x"), (2, "y")]
    (tmp_path / "odd[1]{2}.csv").write_bytes(gzip.compress(data))
    (tmp_path / "latin.csv").write_bytes("a,b\n1,é\n".encode("latin-1"))
    got = lambda s, **o: list(map(tuple, read_delimited(spark, s, **o).sort("a").collect()))
    assert got(io.BytesIO(data)) == got(io.StringIO(data.decode())) == got(str(tmp_path / "odd[1]{2}.csv")) == got(str(tmp_path / "odd*.csv")) == want
    command = subprocess.Popen(["printf", "a,b\\n1,x\\n2,y\\n"], stdout=subprocess.PIPE)
    assert got(command) == want and command.wait() == 0
    assert got(str(tmp_path / "latin.csv"), encoding="ISO-8859-1") == [(1, "é")]


def test_lines_within_cells_do_not_count_for_the_delimiter(spark):
    """Ten lines, but three records: the ten blanks of a plain cell would divide evenly over the lines, the six commas don't."""
    long = "x\ny\nz\nu\nv\nw\np\nq, r"
    df = read_delimited(spark, f'doc_id,text,lang\n1,a b c d e f g h i j k,en\n2,"{long}",en\n'.encode())
    assert sorted(map(tuple, df.collect())) == [(1, "a b c d e f g h i j k", "en"), (2, long, "en")]
    endless = "\n".join("say, so" for _ in range(400))
    df = read_delimited(spark, f'doc_id|text\n1|"{endless}"\n2|b\n'.encode())
    assert sorted(map(tuple, df.collect())) == [(1, endless), (2, "b")]


@pytest.mark.parametrize("at", [1, 2, 3])
def test_cores_may_change_between_passes(spark, tmp_path, monkeypatch, at):
    """Files are cut by the number of cores; records over several lines are put together by several scans."""
    rows = [(k, "\n".join([f"{k}"] * (k % 30 + 1))) for k in range(800)]
    for f in range(4):
        (tmp_path / f"{f}.csv").write_text("k,t\n" + "".join(f'{k},"{t}"\n' for k, t in rows if k % 4 == f))
    cores, n, write = "spark.sql.leafNodeDefaultParallelism", [], records.stored

    def stored(df):
        n.append(1)
        out = write(df)
        if len(n) == at:
            spark.conf.set(cores, "3")
        return out

    monkeypatch.setattr(records, "stored", stored)
    spark.conf.set(cores, "12")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert sorted(map(tuple, read_delimited(spark, str(tmp_path)).collect())) == rows and len(n) == 3
        assert spark.conf.get("spark.sql.files.minPartitionNum", None) is None
    finally:
        spark.conf.unset(cores)
        spark.conf.unset("spark.sql.files.openCostInBytes")
