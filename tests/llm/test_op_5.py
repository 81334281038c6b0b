import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from rowloom.llm import language_model as lm

from .conftest import SMALL


@pytest.mark.parametrize("most", [2**64 - 1, 10**6, 5000])
def test_elias_fano(most):
    rng = np.random.default_rng(0)
    x = np.unique(np.concatenate([rng.integers(0, most, 3000, dtype=np.uint64), np.arange(17, dtype=np.uint64)]))
    ef = lm.EliasFano.build(x)
    assert ef.find(x).tolist() == list(range(len(x)))
    assert (ef.get(np.arange(len(x))) == x).all()
    others = rng.integers(0, 2**64 - 1, 2000, dtype=np.uint64)
    others = others[~np.isin(others, x)]
    assert (ef.find(others) == -1).all()
    gaps = np.setdiff1d(x + np.uint64(1), x)
    assert (ef.find(gaps) == -1).all()
    assert lm.EliasFano.build(x[:0]).find(x[:3]).tolist() == [-1] * 3


def tokens(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")), None]


def plain(rows, order=3, d=0.75, all_rows=False):
    """Every run of up to ``order`` words counted in dicts, interpolated with absolute discounting."""
    train = [tokens(t) for i, t in rows if all_rows or i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    one = Counter(w for t in train for w in t)
    n, v = sum(one.values()), len(one)
    runs, total, kinds = Counter(), Counter(), Counter()
    for t in train:
        for k in range(2, order + 1):
            at = [None, *t]
            for x in range(len(at) - k + 1):
                runs[tuple(at[x : x + k])] += 1
    for r, c in runs.items():
        total[r[:-1]] += c
        kinds[r[:-1]] += 1
    out = []
    for i, t in rows:
        t = tokens(t)
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in t)
        full, at = 0.0, [None, *t]
        for x in range(1, len(at)):
            p = (one[at[x]] + 1) / (n + v + 1)
            for k in range(2, order + 1):
                c = tuple(at[x - k + 1 : x]) if x - k + 1 >= 0 else None
                if c in total:
                    p = max(runs[(*c, at[x])] - d, 0) / total[c] + d * kinds[c] / total[c] * p
            full += math.log10(p)
        out.append((i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, len(t), sum(one[w] > 0 for w in t), n, base, full))
    return out


def test_kth_one():
    rng = np.random.default_rng(0)
    bits = rng.integers(1, 2**64 - 1, 2000, dtype=np.uint64)
    k = rng.integers(0, np.bitwise_count(bits))
    want = [[b for b in range(64) if int(x) >> b & 1][i] for x, i in zip(bits, k)]
    assert lm.kth_one(bits, k).tolist() == want


def test_pointers_decide():
    """A word that follows one context isn't found under another: each search stays between its context's pointers."""
    assert lm.cut(np.asarray([3, 4, 20, 1, 1]), 8) == [[0, 0, 1, 3], [2, 0, 3, 20], [2, 1, 3, 20], [2, 2, 3, 20], [3, 0, 1, 1]]
    assert lm.cut(np.asarray([], np.int64), 8) == []


@pytest.mark.parametrize("each", [4_000_000, 700])
def test_op5(spark, documents, each):
    """Whole order-3 model against dicts; with small files, whose frequent contexts are split over several."""
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    want = {r[0]: r for r in plain(rows)}
    if each == 700:
        train = documents.selectExpr("doc_id", "coalesce(text, '') AS text").filter("crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 7 <> 2")
        trie = lm.train(train, word_keys=2000, each=each)
        assert len(trie["levels"]) == 2 and trie["levels"][0]["split"] and all(x["there"].sum() > 20 for x in trie["levels"])
        got = {r["doc_id"]: (r["doc_id"], want[r["doc_id"]][1], r["n_tokens"], r["n_known"], trie["N"], r["base_score"], r["score"]) for r in lm.score(documents, trie).collect()}
    else:
        got = {r["doc_id"]: tuple(r) for r in lm.op5_lm_scoring(spark, SMALL).collect()}
    assert got.keys() == want.keys()
    for i, g in got.items():
        assert g[:5] == want[i][:5] and g[5] == pytest.approx(want[i][5], rel=1e-9)
        assert g[6] == pytest.approx(want[i][6], abs=2e-4 * g[2] + 1e-6)
    held = [g for g in got.values() if g[1]]
    assert sum(g[6] for g in held) > sum(g[5] for g in held)


def test_odd(spark, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    trie = lm.train(odd.selectExpr("doc_id", "coalesce(text, '') AS text"), word_keys=3, each=50)
    assert all(x["split"] for x in trie["levels"])
    got = lm.score(odd, trie).collect()
    order = lambda x: sorted(x, key=str)
    for (i, n, total), (j, m, want) in zip(order((r["doc_id"], r["n_tokens"], r["score"]) for r in got), order((r[0], r[2], r[6]) for r in plain(rows, all_rows=True)), strict=True):
        assert (i, n) == (j, m) and total == pytest.approx(want, abs=2e-4 * n + 1e-6)
    assert len(got) == len(rows) and {r["n_tokens"] for r in got if r["doc_id"] in (1, 2)} == {1}
    none = lm.train(empty.select("doc_id", "text"))
    assert none["N"] == 0 and lm.score(empty, none).count() == 0
    assert {r["n_known"] for r in lm.score(odd, none).collect()} == {0}
