"""Canonical exact fingerprints of texts, with DataFrame functions only.

A text is brought to Unicode's composed form (NFC), its case is folded, and runs of white space become one space. The
fingerprint is 128 bits of xxhash64 under two seeds. Texts in one bucket of equal hashes are compared byte by byte; if
they ever differ, the later ones get a number after their hash, so that fingerprints are equal only for equal forms.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

SPACE = r"[\t-\r\x1c-\x1f\x85\p{Z}]+"


@lru_cache
def unicode_tables() -> tuple[str, str, str, str]:
    """From Python's Unicode data: a class of all code points that composing may change; JSON maps of decompositions, combining classes and compositions."""
    apart, classes, pairs, unsafe = {}, {}, {}, []
    for cp in range(0x80, 0x30000):
        c = chr(cp)
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xDFFF:
            continue
        d, n = unicodedata.normalize("NFD", c), unicodedata.combining(c)
        if n:
            classes[c] = n
        if d != c:
            apart[c] = d
            if unicodedata.normalize("NFC", d) == c:  # not excluded from composition
                first, second = (chr(int(x, 16)) for x in unicodedata.decomposition(c).split())
                pairs[first + second] = c
    for cp in {ord(p[1]) for p in pairs} | {ord(c) for c in apart if unicodedata.normalize("NFC", c) != c} | {ord(c) for c in classes} | set(range(0x1161, 0x11C3)):
        if not unicodedata.category(chr(cp)).startswith("M"):
            unsafe.append(cp)
    ranges: list[list[int]] = []
    for cp in sorted(unsafe):
        if ranges and cp - ranges[-1][1] < 64:  # more than needed is harmless
            ranges[-1][1] = cp
        else:
            ranges.append([cp, cp])
    return r"\p{M}" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges), json.dumps(apart), json.dumps(classes), json.dumps(pairs)


def _code_point(n: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(n), 4, "0")), "UTF-16BE")


def _composed(a: Column, b: Column, pairs: Column) -> Column:
    """The composition of two code points or null; Hangul syllables by arithmetic."""
    x, y = F.ascii(a), F.ascii(b)
    lv = x.between(0x1100, 0x1112) & y.between(0x1161, 0x1175)
    lvt = x.between(0xAC00, 0xD7A3) & ((x - 0xAC00) % 28 == 0) & y.between(0x11A8, 0x11C2)
    hangul = F.when(lv, _code_point((0xAC00 + ((x - 0x1100) * 21 + (y - 0x1161)) * 28).cast("int"))).when(lvt, _code_point((x + y - 0x11A7).cast("int")))
    return F.coalesce(F.element_at(pairs, F.concat(a, b)), hangul)


def _cluster(cluster: Column, apart: Column, classes: Column, pairs: Column) -> Column:
    chars = F.split(F.array_join(F.transform(F.split(cluster, ""), lambda c: F.coalesce(F.element_at(apart, c), c)), ""), "")
    kind = lambda c: F.coalesce(F.element_at(classes, c), F.lit(0))
    start = F.struct(F.lit(0).alias("block"), F.expr("CAST(array() AS array<struct<block: int, kind: int, at: int, c: string>>)").alias("out"))

    def number(s, c):
        block = F.when(kind(c) == 0, s["block"] + 1).otherwise(s["block"])
        return F.struct(block.alias("block"), F.array_append(s["out"], F.struct(block.alias("block"), kind(c).alias("kind"), F.size(s["out"]).alias("at"), c.alias("c"))).alias("out"))

    ordered = F.array_sort(F.aggregate(chars, start, number, lambda s: s["out"]))
    state = F.struct(F.lit("").alias("done"), F.lit("").alias("starter"), F.lit("").alias("tail"), F.lit(0).alias("last"))

    def compose(s, x):
        free = (s["starter"] != "") & ((s["tail"] == "") | (s["last"] < x["kind"]))
        both = F.when(free, _composed(s["starter"], x["c"], pairs))
        put = lambda done, starter, tail, last: F.struct(done.alias("done"), starter.alias("starter"), tail.alias("tail"), last.alias("last"))
        return (
            F.when(both.isNotNull(), put(s["done"], both, s["tail"], s["last"]))
            .when(x["kind"] == 0, put(F.concat(s["done"], s["starter"], s["tail"]), x["c"], F.lit(""), F.lit(0)))
            .otherwise(put(s["done"], s["starter"], F.concat(s["tail"], x["c"]), x["kind"]))
        )

    return F.aggregate(ordered, state, compose, lambda s: F.concat(s["done"], s["starter"], s["tail"]))


def nfc(text: Column) -> Column:
    """Unicode's composed normal form. Texts below U+0300, and those without marks or other changing code points, stay as they are."""
    unsafe, apart, classes, pairs = unicode_tables()
    maps = [F.from_json(F.lit(x), f"map<string, {k}>") for x, k in ((apart, "string"), (classes, "int"), (pairs, "string"))]
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s)[^{unsafe}](?=[{unsafe}])[{unsafe}]+|[{unsafe}]+|[^{unsafe}]+?(?=[^{unsafe}][{unsafe}]|\z)"), F.lit(0))
    done = F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(f"[{unsafe}]"), _cluster(p, *maps)).otherwise(p)), "")
    return F.when(text.rlike(r"[^\x00-\x{2FF}]") & text.rlike(f"[{unsafe}]"), done).otherwise(text)


def fold(text: Column) -> Column:
    """Case folding by way of upper case; both small sigmas are one."""
    return F.translate(F.lower(F.upper(text)), "ς", "σ")


def with_form(df: DataFrame, text: Column, out: str) -> DataFrame:
    """Adds the canonical form of a text column. A projection for each step, so that none is computed or planned twice."""
    steps = df.withColumn(out, text).withColumn(out, nfc(F.col(out))).withColumn(out, fold(F.col(out))).withColumn(out, nfc(F.col(out)))
    return steps.withColumn(out, F.trim(F.regexp_replace(F.col(out), SPACE, " ")))


def digest(form: Column) -> Column:
    """32 hexadecimal digits for a canonical form."""
    half = lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")
    return F.concat(half(F.xxhash64(form)), half(F.xxhash64(F.lit("second seed"), form)))


def differing(forms: DataFrame, fingerprint: str, form: str) -> DataFrame:
    """Fingerprints whose rows have forms that differ in a byte (in practice none); partial least and greatest forms before the shuffle."""
    again = forms.groupBy(fingerprint).agg(F.count("*").alias("n")).filter("n > 1").select(fingerprint)
    ends = forms.join(again, fingerprint, "left_semi").groupBy(fingerprint).agg(F.min(form).alias("a"), F.max(form).alias("b"))
    return ends.filter("a <> b").select(fingerprint)


def fingerprint(df: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint of every text (null: empty; it has a fingerprint, too). Equal canonical forms, and only they, get equal ones.

    Other columns stay, whatever their names, but for an older one of its name; repeated rows each get a row; very long
    texts are folded whole; an empty table gives no rows.
    """
    mine = F.struct(*(F.col(f"`{c}`") for c in df.columns if c != out)).alias("_row")
    rows = with_form(df.select(mine, F.coalesce(F.col(text_col), F.lit("")).alias("_form")), F.col("_form"), "_form").withColumn("_out", digest(F.col("_form")))
    return numbered(rows, differing(rows.select("_out", "_form"), "_out", "_form"), "_out").select("_row.*", F.col("_out").alias(out))


#: Rows of a few numbers or a hash that are sent to all tasks, at most; beyond them a shuffle joins.
SENT = 200_000


def sent_if_few(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= SENT else df


def numbered(rows: DataFrame, collided: DataFrame, out: str) -> DataFrame:
    """Appends a number to the fingerprints in ``collided``, by the rank of the form; the others need no shuffle."""
    if collided.isEmpty():
        return rows
    few = rows.join(collided, out, "left_semi").select(out, "_form").distinct()
    names = few.withColumn("_name", F.concat(out, F.lit("-"), F.row_number().over(Window.partitionBy(out).orderBy("_form")).cast("string")))
    return rows.join(names, [out, "_form"], "left").withColumn(out, F.coalesce("_name", out)).drop("_name")


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """fingerprint, n and the least id of each class of equal canonical forms; partial results before the shuffle."""
    return fingerprint(df.select(id_col, text_col), text_col).groupBy("fingerprint").agg(F.count("*").alias("n"), F.min(id_col).alias("first_id"))


def with_next(df: DataFrame, id_col: str, columns: list[str], rows_each: int = 1000) -> DataFrame:
    """Adds next_<column> from the next row in ascending order of the integer id (after the last: the first).

    Ranges of ids, of about ``rows_each`` rows by quantiles and even parts of them, are sorted by themselves; each also
    gets the first row after it. Null ids come first; rows with equal ids follow one another by a hash of the columns.
    """
    ids = df.select(F.col(id_col).cast("long").alias("i"))
    n, least = ids.agg(F.count("*"), F.min("i")).first()
    k = max(1, min(4096, n // rows_each))
    if least is None or k == 1:
        points = []
    else:
        points = sorted(set(ids.agg(F.percentile_approx("i", [x / k for x in range(1, k)], 10 * k)).first()[0]))
    parts = max(1, -(-n // (rows_each * (len(points) + 1))))
    step = max(1, int(len(points) ** 0.5))
    lists = [points[x : x + step] for x in range(0, len(points), step)]
    edges = [points[0] if points else 0, *points, points[-1] if points else 0]

    def number(i: Column) -> Column:
        """How many points are at most i: by the lists' first points, then within a list."""
        if not points:
            return F.lit(0)
        longs = lambda x: F.from_json(F.lit(json.dumps(x)), "array<bigint>")
        outer = F.size(F.filter(longs([x[0] for x in lists]), lambda p: p <= i))
        inner = F.element_at(F.from_json(F.lit(json.dumps(lists)), "array<array<bigint>>"), F.greatest(outer, F.lit(1)))
        return F.when(outer == 0, 0).otherwise((outer - 1) * step + F.size(F.filter(inner, lambda p: p <= i)))

    def ranged(d: DataFrame) -> DataFrame:
        i = F.col(id_col).cast("long")
        d = d.withColumn("_range", F.when(i.isNull(), -1).otherwise(number(i)).cast("int"))
        if parts == 1:
            return d.withColumn("_part", F.lit(0))
        low, high = (F.element_at(F.from_json(F.lit(json.dumps(edges[x : len(edges) - 1 + x])), "array<bigint>"), F.greatest(F.col("_range"), F.lit(0)) + 1) for x in (0, 1))
        part = F.floor((i - low).cast("double") / F.greatest(high - low, F.lit(1)) * parts)
        return d.withColumn("_part", F.coalesce(F.greatest(F.lit(0), F.least(F.lit(parts - 1), part)), F.lit(0)).cast("int"))

    firsts = ranged(df.select(id_col)).groupBy("_range", "_part").agg(F.min(id_col).alias("_first"))
    heads = firsts.groupBy("_range").agg(F.min(F.struct("_part", "_first")).alias("_head"))
    first = heads.agg(F.min_by("_head", "_range").alias("_all"))
    after = heads.crossJoin(F.broadcast(first)).select("_range", F.coalesce(F.lead("_head").over(Window.orderBy("_range")), F.col("_all")).alias("_after"))  # 4097 rows at most
    borders = firsts.join(after, "_range").select("_range", "_part", F.coalesce(F.lead("_first").over(Window.partitionBy("_range").orderBy("_part")), F.col("_after._first")).alias("_id"))
    rows = ranged(df.select(id_col, *columns)).withColumn("_border", F.lit(False))
    border = df.select(id_col, *columns).join(sent_if_few(borders, (len(points) + 2) * parts), F.col(id_col).eqNullSafe(F.col("_id"))).select(id_col, *columns, "_range", "_part", F.lit(True).alias("_border"))
    in_order = Window.partitionBy("_range", "_part").orderBy("_border", F.col(id_col).asc_nulls_first(), F.xxhash64(*columns))
    seen = rows.unionByName(border).select("*", *(F.lead(c).over(in_order).alias(f"next_{c}") for c in columns))
    return seen.filter(~F.col("_border")).drop("_range", "_part", "_border")


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text: its later half replaced by the start of the next document.

    The forms of documents with equal hashes are compared byte by byte; for edited texts, whose forms aren't kept, the
    lengths and a third hash are compared. A table of one row is its own next document; an empty table gives no rows.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    marks = lambda form: F.struct(digest(form).alias("hash"), F.length(form).alias("n"), F.xxhash64(F.lit("third seed"), form).alias("check"))
    own = with_form(docs, F.col("text"), "_form").select("doc_id", "text", marks(F.col("_form")).alias("mark"))
    both = with_next(own, "doc_id", ["text", "mark"])
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = both.select("doc_id", "text", "mark", "next_mark", F.concat(F.col("text").substr(F.lit(1), n - half), F.coalesce(F.col("next_text"), F.lit("")).substr(F.lit(1), half)).alias("edited"))
    rows = materialize(
        with_form(edited, F.col("edited"), "_form").select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "mark", "next_mark", marks(F.col("_form")).alias("edited_mark")),
        "fingerprints",
    )
    seen = rows.select("mark").unionByName(rows.select(F.col("edited_mark").alias("mark")))
    odd = seen.groupBy("mark.hash").agg(F.min("mark").alias("a"), F.max("mark").alias("b")).filter("a <> b").select("hash")
    forms = with_form(docs, F.col("text"), "_form").select(digest(F.col("_form")).alias("hash"), "_form")
    again = rows.groupBy("mark.hash").agg(F.count("*").alias("k")).filter("k > 1").select("hash")
    again = materialize(again, "again")
    ends = forms.join(sent_if_few(again, again.count()), "hash", "left_semi").groupBy("hash").agg(F.min("_form").alias("a"), F.max("_form").alias("b"))
    named = lambda m: F.col(f"{m}.hash")
    if not (odd.isEmpty() and ends.filter("a <> b").isEmpty()):
        named = lambda m: F.concat(F.col(f"{m}.hash"), F.lit("-"), F.col(f"{m}.n").cast("string"), F.lit("-"), F.hex(F.col(f"{m}.check")))
    like = lambda a, b: F.when(named(a) == named(b), 1.0).otherwise(0.0)
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", named("mark").alias("fingerprint"), named("edited_mark").alias("edited_fingerprint"),
        like("mark", "edited_mark").alias("near_edited"), like("mark", "next_mark").alias("near_next"),
    )


def op3_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
