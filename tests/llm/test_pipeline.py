import corpus_pipeline
from rowloom.llm.common import table

from .conftest import SMALL
from .test_ops_1_2_7_10 import check_placed, plain_contamination, plain_lines
from .test_ops_4_8_9 import plain_classes


def test_stages(spark):
    docs = table(spark, SMALL, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = corpus_pipeline.materialize(stage(spark, docs, SMALL), "stage")
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
            seen[name] = before, {r["doc_id"]: r["text"] for r in docs.collect()}
    before, after = seen["quality classifier"]
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SMALL, "labels").collect()}
    assert all(before[i] == t for i, t in after.items()) and sum(labels.get(i) == 1 for i in after) >= 0.95 * sum(q == 1 for i, q in labels.items())
    before, after = seen["line dedup"]
    assert after.keys() == before.keys() and sum(t != before[i] for i, t in after.items()) == sum(r[2] > 0 for r in plain_lines(list(before.items())))
    before, after = seen["near dedup"]
    assert after.keys() == {i for i, c in plain_classes(list(before.items())).items() if i == c}
    before, after = seen["decontamination"]
    items = [(r["item_id"], r["text"]) for r in table(spark, SMALL, "benchmark").collect()]
    short = {i: t for i, t in before.items() if len(t) < 4000}
    assert {i for i in after if i in short} == {r[0] for r in plain_contamination(short.items(), items) if not r[5]}
    rows = docs.collect()
    assert {r["doc_id"] for r in rows} == set(after)
    check_placed(rows, 4096)
    assert len(corpus_pipeline.run(spark, SMALL).collect()) == len(rows)
