import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.llm import html_text, near_dedup, quality

from .conftest import SMALL


def plain_classes(rows, idf=0.05, threshold=0.8):
    cells, found = np.zeros(near_dedup.CELLS, np.int64), {}
    for i, t in rows:
        s, n = near_dedup.shingles(t or "", 5)
        found[i] = s, n
        np.add.at(cells, (s & np.uint64(near_dedup.CELLS - 1)).astype(np.int64), 1)
    w = near_dedup.Weights(cells, len(rows), idf)
    vectors = {i: (s, w(s, n)) for i, (s, n) in found.items()}
    top = {i: i for i in vectors}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(vectors)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if near_dedup.similarity(vectors[i], vectors[j]) >= threshold:
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_op4(spark, documents):
    rng = random.Random(5)
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    base = [t.split() for _, t in rows[:30]]
    for k, words in enumerate(base):
        for copy in range(4):
            changed = [rng.choice(words) if rng.random() < 0.008 * copy else w for w in words]
            rows.append((1000 + 4 * k + copy, " ".join(changed)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(df).collect()}
    assert got == plain_classes(rows)
    assert len(near_dedup.op4_minhash_near_dedup(spark, SMALL).collect()) == documents.count()


def test_near_odd(spark, odd, empty):
    got = near_dedup.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    assert {(r["doc_id"], r["class_id"]) for r in got} == {(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (None, None), (7, 7)}
    assert near_dedup.near_duplicates(empty).count() == 0


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)] + [(200, k) for k in range(201, 230)]
    top = {x: x for p in links for x in p}
    for _ in range(200):
        for a, b in links:
            top[a] = top[b] = min(top[a], top[b])
    got = {r["id"]: r["least"] for r in near_dedup.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: m for x, m in top.items() if x != m}


def test_similarity_and_sampling():
    rng = np.random.default_rng(0)
    sampler = near_dedup.Sampler(2000)
    x = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
    w = rng.uniform(1, 3, len(x)).astype(np.float32)
    a, b = (x[:220], w[:220]), (x[60:], w[60:] * rng.choice([1, 1.5], len(x) - 60).astype(np.float32))
    want = near_dedup.similarity(a, b)
    both = np.minimum(w[60:220], b[1][:160]).sum()
    assert want == pytest.approx(both / (a[1].sum() + b[1].sum() - both), rel=1e-5)
    assert (sampler(*a) == sampler(*b)).mean() == pytest.approx(want, abs=0.05)


PAGES = [
    ("http://h.example.com/1", "<html><head><title>T</title></head><body><nav><a>Menu</a></nav><div class='ad big'>Buy</div><article><h1>Head</h1><p>One <b>two<br><p>Three&amp;four\n five</p><div class=comments><p>me too</p></div></article><footer>F</footer>", "Head\nOne two\nThree&four five"),
    ("http://h.example.com/2", "<p>a<p>b<script>var x='</p>';</script><ul><li>c<li>d</ul>", "a\nb\nc\nd"),
    ("http://h.example.com/3", "", ""),
    (None, None, ""),
    ("not a url", "just text &lt;3", "just text <3"),
    ("http://h.example.com/4", "<main><header><h1>x</h1></header><p>y &copy; &#233;</p></main><aside>z</aside>", "x\ny © é"),
    ("http://h.example.com/5", "<div id='cookie-notice'>ok?</div><div>body<form>q</form> rest</div>", "body rest"),
    ("http://h.example.com/6", "<!-- c --><p>open <i>it", "open it"),
    ("http://h.example.com/7", "<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
]


def test_pages(spark, empty):
    df = spark.createDataFrame([(k, u, h, "old") for k, (u, h, _) in enumerate(PAGES)], "page_id int, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
    assert got == {k: want for k, (_, _, want) in enumerate(PAGES)}
    assert html_text.extract(df.limit(0)).count() == 0


def test_templates(spark):
    rows = [(f"http://s.example.com/{k}", f"<div><div><span>Site name</span> <i>since 1999</i></div><p>Story {k} is here.</p><section>All rights</section></div>") for k in range(8)] + [("http://t.example.com/1", "<div><section>All rights</section></div>")]
    got = [r["text"] for r in html_text.extract(spark.createDataFrame(rows, "url string, html string")).sort("url").collect()]
    assert got == [f"Story {k} is here." for k in range(8)] + ["All rights"]


def test_op8(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    import html
    import re

    for r in html_text.op8_html_extraction(spark, SMALL).collect():
        article = re.search(r"<article>(.*)</article>", pages[r["page_id"]]["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_op9(spark):
    d = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in quality.op9_quality_classifier(spark, d).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    held = Counter((labels[i], r["predicted"]) for i, r in got.items() if r["held_out"] and i in labels)
    assert held[1, 0] + held[0, 1] <= 0.02 * sum(held.values()) and held[0, 0] >= 0.9 * (held[0, 0] + held[0, 1])


def test_quality_odd(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (3, None), (4, 0), (5, 1), (None, 1)], "doc_id bigint, quality int")
    got = quality.scored(odd, labels)
    assert got.count() == odd.count() and got.filter("score IS NULL").isEmpty() and got.columns[:4] == odd.columns
    assert {r["score"] for r in quality.scored(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.scored(empty, labels).count() == 0
    rows, names = quality.statistics(odd)
    by = {r["doc_id"]: r for r in rows.collect()}
    assert all(by[i][n] == 0 for i in (1, 2) for n in names)
    assert by[3]["s_words"] == 2 and by[None]["s_lines"] == 2 and by[5]["s_distinct_words"] < 0.001


def test_rules_are_the_model(spark):
    rows = spark.createDataFrame([(float(i % 10), float(i % 7), float(i % 10 > 4 and i % 7 < 3)) for i in range(400)], "a double, b double, y double")
    model = quality.fit(rows, ["a", "b"], "y")
    got = rows.withColumn("s", model.score()).collect()
    assert all((r["s"] > 0.5) == (r["y"] == 1) for r in got)
    assert defaultdict(int, {len(model.rules): 1})[0] == 0
    assert F.col("a") is not None
