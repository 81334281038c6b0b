"""Cases in which an operator once did less than its whole job."""

import random

import pytest

import corpus_pipeline
from rowloom.llm import decontamination, fingerprints, html_text, line_dedup, near_dedup, quality
from rowloom.llm import language_model as lm

from .conftest import SMALL
from .test_ops_4_8_9 import plain_classes


def test_op4_shared_passages(spark, monkeypatch):
    """Documents of common passages, most alike below the threshold, and copies of some with larger ids that differ in one passage."""
    monkeypatch.setattr(near_dedup, "CHUNK", 100, raising=False)
    rng = random.Random(7)
    passages = [[[f"p{k}v{v}w{w}" for w in range(10)] for v in range(4)] for k in range(40)]
    chosen = [[rng.randrange(1, 4) if rng.random() < 0.15 else 0 for _ in passages] for _ in range(1000)]
    for c in chosen[900:960]:
        k = rng.randrange(40)
        chosen.append([*c[:k], (c[k] + 1) % 4, *c[k + 1 :]])
    rows = [(i, " ".join(w for p, v in zip(passages, c) for w in p[v])) for i, c in enumerate(chosen)]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    want = plain_classes(rows)
    assert {i for i in got if got[i] != want[i]} == set()


def test_op5_too_many_words(spark, monkeypatch):
    monkeypatch.setattr(lm, "MOST_WORDS", 3, raising=False)
    docs = spark.createDataFrame([(1, "one two three"), (2, "four five")], "doc_id bigint, text string")
    with pytest.raises(ValueError, match="6 distinct words"):
        lm.train(docs)


def test_pipeline_rows_not_ids(spark):
    """Rows that share an id, or have none, are judged by their own texts."""
    passage = spark.read.parquet(f"{SMALL}/benchmark.parquet").filter("size(split(text, ' ')) > 12").first()["text"]
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcd")
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = lambda *pairs: spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in pairs], schema)
    texts = lambda df: sorted((str(r["doc_id"]), r["text"]) for r in df.collect())
    left = corpus_pipeline.drop_contaminated(spark, rows((None, passage), (None, a), (1, passage), (1, b), (2, c)), SMALL)
    assert texts(left) == [("1", b), ("2", c), ("None", a)]
    left = corpus_pipeline.drop_near_duplicates(spark, rows((1, a), (1, b), (2, b + " end"), (None, c), (None, c + " end"), (None, d)), SMALL)
    assert texts(left) in ([("1", a), ("1", b), ("None", x), ("None", d)] for x in (c, c + " end"))


def test_op8_copies(spark):
    """Hosts whose pages are mostly copies, with and without a marked article, and words that recur within paragraphs."""
    menu = "<div><span>Site name</span> <i>since 1999</i></div>"
    marked = [("http://a.example.com/", f"<nav>{k}</nav><article><h1>Copied</h1><p>Same story.</p></article>", "Copied\nSame story.") for k in range(12)]
    marked += [("http://a.example.com/", f"<article><h1>Page {k}</h1><p>Story {k}.</p></article>", f"Page {k}\nStory {k}.") for k in range(6)]
    plain = [("http://b.example.com/", f"{menu}<p>A copied story.</p>", "A copied story.")] * 12
    plain += [("http://b.example.com/", f"{menu}<p><b>Note</b> {k}</p>", f"Note {k}") for k in range(30)]
    rows = [(i, *r) for i, r in enumerate(marked + plain)]
    got = html_text.extract(spark.createDataFrame([r[:3] for r in rows], "id int, url string, html string")).collect()
    assert {r["id"]: r["text"] for r in got} == {r[0]: r[3] for r in rows}


def test_op4_ids_are_not_texts(spark):
    """Rows that repeat an id, or have none, are in the classes of their own texts."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(5, a), (5, b), (9, a + " end"), (10, b + " end"), (None, a), (None, b), (None, c), (None, c + " end")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    classes = {}
    for r in got:
        classes.setdefault(r["class_key"], []).append((r["doc_id"], r["class_id"]))
    order = lambda x: sorted(x, key=str)
    assert order(map(order, classes.values())) == order([order([(5, 5), (9, 5), (None, 5)]), order([(5, 5), (10, 5), (None, 5)]), [(None, None)] * 2])


def test_op8_templates_decide(spark, monkeypatch):
    """Pages without marks: what recurs on the host goes, by counts alone; compound classes and ids say nothing."""
    side = "<div class='entry-meta'><span>Follow us</span> <i>everywhere</i></div>"
    rows = [(k, "http://a.example.com/", f"{side}<div id='sharing-data'><h2>Sharing data {k}</h2><p>Body {k}.</p></div><div>All rights</div>", f"Sharing data {k}\nBody {k}.") for k in range(12)]
    rows += [(100 + k, "http://b.example.com/", f"<article><div class='entry-header'><h1>Title {k}</h1></div><h2>Summary</h2><p>Body {k}</p><p class='notice-board'>Keep?</p><div class='tools'>Print it</div></article>", f"Title {k}\nSummary\nBody {k}\nKeep?") for k in range(12)]
    cards = "".join(f"<article><p>Card {k}</p></article>" for k in range(3))
    rows += [(200, "http://c.example.com/", f"<div><p>{'A long text beside cards. ' * 20}</p></div>{cards}", None)]
    schema = "id int, url string, html string, _host string, _template int, part int, host string"
    df = spark.createDataFrame([(*r[:3], "mine", 7, 8, "also") for r in rows], schema)
    got = {r["id"]: r for r in html_text.extract(df).collect()}
    assert {i: r["text"] for i, r in got.items() if i < 200} == {r[0]: r[3] for r in rows[:-1]}
    assert got[200]["text"].startswith("A long text") and {(r["_host"], r["_template"], r["part"], r["host"]) for r in got.values()} == {("mine", 7, 8, "also")}
    # without the lists nearly all texts differ
    bare = lambda t: html_text.main_text(html_text.hashed(html_text.parse(t)), frozenset())
    assert all(bare(r[2]) != r[3] for r in rows[:-1])
    # a hot host dealt to several tasks gives the same
    monkeypatch.setattr(html_text, "TASK_BYTES", 500)
    monkeypatch.setattr(html_text, "LEAST_BYTES", 100)
    assert {r["id"]: r["text"] for r in html_text.extract(df).collect()} == {i: r["text"] for i, r in got.items()}
    twice = spark.createDataFrame([(1, "http://a.example.com/", None, "t"), (1, "http://a.example.com/", None, "t"), (None, None, "<p>x</p>", None), (3, "odd", "<p>" + "long " * 100000 + "</p>", "t")], "id int, url string, html string, text string")
    assert sorted((str(r["id"]), len(r["text"])) for r in html_text.extract(twice).collect()) == [("1", 0), ("1", 0), ("3", 499999), ("None", 1)]
    assert html_text.extract(twice.limit(0)).count() == 0


def test_op2_items(spark):
    """Null, textual and repeated item ids, blocks of one item each, and words near each other in another order."""
    passage = [" ".join(f"{x}{k}" for k in range(12)) for x in "abc"]
    docs = spark.createDataFrame([(1, passage[0]), (1, passage[1] + " " + passage[2]), (None, "x " + passage[0]), (4, " ".join(reversed(passage[0].split()))), (5, None)], "doc_id bigint, text string")
    items = spark.createDataFrame([(None, passage[0]), ("k", passage[1]), ("k", passage[2]), ("e", None)], "item_id string, text string")
    for most in (2_000_000, 1):
        got = decontamination.contamination(docs, items, words_most=most, within=12).collect()
        assert sorted((str(r["doc_id"]), r["n_hit"], r["n_items"], r["items"], r["near"]) for r in got) == [("1", 12, 1, [""], [""]), ("1", 24, 1, ["k"], ["k"]), ("4", 0, 0, [], [""]), ("5", 0, 0, [], []), ("None", 12, 1, [""], [""])]
    assert {r["n_hit"] for r in decontamination.contamination(docs, items.limit(0)).collect()} == {0}


def test_names_of_the_caller(spark):
    """Columns with the operators' own names come back as they were."""
    text = "A sentence of some words, which is long enough to be a line of its own. "
    rows = [(k, text * (k % 3), "mine", 1.5, k % 2) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _text string, s_chars double, _form bigint")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id bigint, quality int")
    for out in (quality.scored(df, labels).drop("score", "predicted"), fingerprints.fingerprint(df).drop("fingerprint"), line_dedup.dedup_lines(df).drop("n_lines", "n_dropped", "kept_text")):
        assert out.columns == df.columns and sorted(map(tuple, out.collect()), key=str) == sorted(rows, key=str)


def test_op10_counts_are_probed(spark, tmp_path):
    """Keys of one to nine documents, all in the index with their counts, in several shards."""
    lines = [f"a line number {k} with more than forty code points" for k in range(300)]
    rows = [(i, "\n".join(x for k, x in enumerate(lines) if i < k % 9 + 1)) for i in range(9)]
    counts = line_dedup.line_counts(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text", 40)
    there = line_dedup.write_index(counts, str(tmp_path), 7)
    probe = line_dedup.Probe(str(tmp_path), 7, set(there))
    import numpy as np

    h1, h2 = (np.asarray(x, np.uint64) for x in zip(*(line_dedup.two_hashes(x.encode()) for x in [*lines, "not there, but also more than forty code points"])))
    found, last = probe.find(h1, h2)
    assert found.tolist() == [k % 9 + 1 for k in range(300)] + [0] and last.tolist()[:300] == [k % 9 for k in range(300)]
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), keys_per_shard=40).collect()}
    assert got == {i: sum(k % 9 + 1 >= 5 and k % 9 != i for k in range(300) if i < k % 9 + 1) for i in range(9)}


def test_op9_plain(spark):
    """The compiled expression against the rules evaluated one by one on statistics counted in Python."""
    import math
    import re

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    model = quality.fit_documents(docs, labels.filter(~quality.held_out(quality.F.col("doc_id"))))
    got = {r["doc_id"]: r["score"] for r in quality.scored(docs, labels).collect()}

    def plain(t):
        t = t or ""
        words, parts = [w for w in re.split(r"[ \t-\r]+", t) if w], [x for x in t.split("\n") if x]
        n = lambda p: len(re.findall(p, t))
        share = lambda a, b: a / b if b else 0.0
        s = {"s_chars": len(t), "s_words": len(words), "s_lines": len(parts), "s_signs": share(n(r"[#$%&*+<=>@\\^_`{|}~\[\]]"), len(t)), "s_bars": share(t.count("|"), len(words)), "s_exclaims": share(t.count("!"), len(words))}
        s |= {"s_upper": share(sum(c.isupper() for c in t), len(t)), "s_digits": share(n("[0-9]"), len(t)), "s_stops": share(n("[.,;:?]"), len(words)), "s_word_length": share(len(t), len(words)), "s_line_length": share(len(words), len(parts))}
        s |= {"s_distinct_words": share(len(set(words)), len(words)), "s_distinct_lines": share(len(set(parts)), len(parts)), "s_repeats": share(n(r"(?<![^\s])(\S+)\s(?=\1(?:\s|$))"), len(words))}
        total = model.intercept + sum(w for rule, w in model.rules if all(s[c] <= x if low else s[c] > x for c, low, x in rule))
        return 1 / (1 + math.exp(-total))

    assert model.rules
    for r in docs.collect():
        assert got[r["doc_id"]] == pytest.approx(plain(r["text"]), abs=1e-9), r["doc_id"]
