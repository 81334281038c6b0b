import datetime
import gzip
import io

import pytest

from rowloom import format_rows, iter_rows, read_delimited, write_delimited, write_row, writer
from rowloom.sources.storage import Store


@pytest.fixture
def df(spark):
    rows = [(1, "a", 1.5), (2, "b,c", float("nan")), (3, 'd"e', float("inf")), (4, None, float("-inf")), (5, "two\nlines", None)]
    return spark.createDataFrame(rows, "k int, t string, x double").coalesce(1).sort("k")


LINES = ["1,a,1.5", '2,"b,c",NaN', '3,"d""e",Inf', "4,,-Inf", '5,"two\nlines",']


def test_rows(df):
    assert [r["line"] for r in format_rows(df).collect()] == LINES
    assert "".join(iter_rows(df)) == "k,t,x\n" + "".join(x + "\n" for x in LINES)
    assert "".join(iter_rows(df, header=["a", "b", "c"], newline="\r\n", delim="\t")).startswith("a\tb\tc\r\n1\ta\t1.5\r\n")


def test_row():
    assert write_row([1, None, True, 1.5, "a,b", datetime.date(2020, 1, 2)]) == '1,,true,1.5,"a,b",2020-01-02\n'
    assert write_row([float("nan"), float("inf"), float("-inf")], decimal=",", delim=";") == "NaN;Inf;-Inf\n"
    assert write_row(['x"y'], escapechar="\\") == '"x\\"y"\n'
    assert write_row(["x"], quotestrings=True, newline="\r\n") == '"x"\r\n'


def test_file(df, tmp_path):
    whole = "k,t,x\n" + "".join(x + "\n" for x in LINES)
    at = str(tmp_path / "a.csv")
    assert write_delimited(df, at) == at and (tmp_path / "a.csv").read_text() == whole
    write_delimited(df, at, append=True)
    assert (tmp_path / "a.csv").read_text() == whole + "".join(x + "\n" for x in LINES)
    write_delimited(df, at, bom=True, header=False)
    assert (tmp_path / "a.csv").read_bytes() == b"\xef\xbb\xbf" + "".join(x + "\n" for x in LINES).encode()
    write_delimited(df, at, newline="\r\n", compress=True)
    assert gzip.decompress((tmp_path / "a.csv").read_bytes()).decode() == whole.replace("\n", "\r\n").replace("two\r\n", "two\n")
    write_delimited(df.limit(2), at, newline="")
    assert (tmp_path / "a.csv").read_text() == 'k,t,x1,a,1.52,"b,c",NaN'
    assert writer(at, header=False, missingstring="NA")(df) == at
    assert (tmp_path / "a.csv").read_text().splitlines()[3] == "4,NA,-Inf"


def test_streams_and_parts(spark, df, tmp_path):
    out = io.StringIO()
    assert write_delimited(df, out) is out and out.getvalue().splitlines()[1] == LINES[0]
    write_delimited(df.repartition(3), str(tmp_path / "parts"), partition=True, compress=True)
    files = Store(spark, str(tmp_path / "parts")).files()
    assert len(files) == 3 and all(f.endswith(".gz") for f in files)
    assert sorted(r["k"] for r in read_delimited(spark, str(tmp_path / "parts")).collect()) == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("options", [{"delim": "\n"}, {"quotechar": "é"}, {"openquotechar": "{"}, {"decimal": "::"}, {"header": ["only one"]}])
def test_errors(df, options):
    with pytest.raises(ValueError):
        list(iter_rows(df, **options))
