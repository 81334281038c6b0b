import hashlib
import random
import re
import unicodedata

from pyspark.sql import functions as F

from rowloom.llm import fingerprints as fp

from .conftest import SMALL


def form(t):
    t = unicodedata.normalize("NFC", unicodedata.normalize("NFC", t).upper().lower()).replace("ς", "σ")
    return re.sub(r"[\t-\r\x1c-\x1f\x85\xa0  -     　 ]+", " ", t).strip(" ")


def test_nfc(spark):
    rng = random.Random(3)
    alphabet = "aeȨ̣́̂ 각한가क़ÅΩཱཱི̈́qַּ̀\U0001f600\U0002f800ொẤʹ中"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))) for _ in range(1500)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", fp.nfc(F.col("t"))).collect()
    assert {i: t for i, t in got} == {i: unicodedata.normalize("NFC", t) for i, t in enumerate(texts)}


def plain(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for k, (d, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        h = len(t) // 2
        e = t[: len(t) - h] + nxt[:h]
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), float(form(t) == form(e)), float(form(t) == form(nxt)), form(t), form(e)))
    return out


def compare(got, want):
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in got), key=str) == sorted((w[:5] for w in want), key=str)
    names = {}
    of = {w[0]: w for w in want}
    for r in got:
        for c, f in ((r["fingerprint"], of[r["doc_id"]][5]), (r["edited_fingerprint"], of[r["doc_id"]][6])):
            assert names.setdefault(c, f) == f
    assert len(names) == len({f for w in want for f in w[5:]})


def test_op3(spark, documents):
    compare(fp.op3_document_fingerprints(spark, SMALL).collect(), plain([(r["doc_id"], r["text"]) for r in documents.collect()]))


def test_ranges(spark, documents):
    rows = [(r["doc_id"] * r["doc_id"] + 7, r["text"][:50]) for r in documents.collect()]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    ids = sorted(r[0] for r in rows)
    got = {r["doc_id"]: r["next_doc"] for r in fp.with_next(df.select("doc_id", F.col("doc_id").alias("doc")), "doc_id", ["doc"], 7).collect()}
    assert got == dict(zip(ids, [*ids[1:], ids[0]]))


def test_odd(spark, odd, empty):
    got = fp.edited_fingerprints(odd.dropDuplicates(["doc_id"])).collect()
    compare(got, plain([(r["doc_id"], r["text"]) for r in odd.dropDuplicates(["doc_id"]).collect()]))
    assert fp.edited_fingerprints(odd).count() == odd.count()
    assert fp.edited_fingerprints(empty).count() == 0
    one = fp.edited_fingerprints(odd.filter("doc_id = 3")).first()
    assert one["near_next"] == 1.0
    assert {r["n"] for r in fp.groups(odd).collect()} == {1, 2, 3}


def test_collisions_are_told_apart(spark):
    rows = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "c"), ("y", "c")], "fp string, _form string")
    bad = fp.differing(rows, "fp", "_form")
    assert [r[0] for r in bad.collect()] == ["x"]
    assert sorted(r[0] for r in fp.numbered(rows, bad, "fp").select("fp").collect()) == ["x-1", "x-2", "y", "y"]
