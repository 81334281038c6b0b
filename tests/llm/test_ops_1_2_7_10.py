import hashlib
import itertools
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rowloom.llm import decontamination, line_dedup, packing, token_output
from rowloom.llm.common import shared_path

from .conftest import SMALL

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def crc(ids):
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


@pytest.mark.parametrize("text", ["", "  ", "<|endoftext|> a<|startoftext|>b", "It's WE'RE don't, İstanbul ΟΔΟΣ. é ́x a b c\tq\r\n", "ﬁ ½ 12345 1,2.3 abc.def 中文字 한국 \U0001f600", "Ñandú&&& été!!! x### y'll ŸÆ. ǅͅ"])
def test_words_encode_as_whole_texts_do(tokenizer, text):
    got = np.frombuffer(token_output.WordEncoder(PATH, 3).encode([text])[0], "<u4").tolist()
    assert got == tokenizer.encode(text, add_special_tokens=False).ids


def test_words_kept_are_bounded(tokenizer):
    encoder = token_output.WordEncoder(PATH, 20)
    text = " ".join([*(f"Word{k}, other{k % 7}" for k in range(200)), "x" * 5000])
    for t in (text, text + " end"):
        assert np.frombuffer(encoder.encode([t])[0], "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids
        held = {**encoder.known, **getattr(encoder, "older", {})}
        assert len(held) <= 20 and max(map(len, held)) < 5000


class Counted:
    def __init__(self, model):
        self.model, self.n = model, 0

    def tokenize(self, word):
        self.n += 1
        return self.model.tokenize(word)


def test_letters_are_encoded_once_whatever_case_and_signs(tokenizer):
    encoder = token_output.WordEncoder(PATH, 260)
    encoder.model = counted = Counted(encoder.model)
    cores = ["".join(c) for c in itertools.product("bdfg", "aeiou", "lnrst")]
    words = [case(c) + sign for sign in ["", *",.;:!?)", "!!", "?!", ".)", "..."] for case in (str, str.title, str.upper) for c in cores]
    texts = [" ".join(words[i : i + 50]) for i in range(0, len(words), 50)]
    for t in texts:
        assert np.frombuffer(encoder.encode([t])[0], "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids
    assert counted.n == len(cores)


def test_pieces_encode_as_whole_texts_do(tokenizer):
    rng = random.Random(5)
    signs = [*"aZéÀßÿĀıſǅɏɐ×÷İµºªΣςя中한½²_-.,;|<>'&0129\t\r\x00\x1f\x7f\x85\xa0\u3000\u0301\u200d\U0001f600  \n\n", "<|endoftext|>", "<|STARTOFTEXT|>", "'s", "'Re", "x" * 70]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 60))) for _ in range(3000)] + ["\n", "x" * 300, " " * 90, "é" * 90 + " b"]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for block in (1, 40, 10**6):
        got = token_output.WordEncoder(PATH, 50, block).encode(texts)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == want
    assert token_output.WordEncoder(PATH).encode([]) == [] and token_output.WordEncoder(PATH).encode(["", ""]) == [b"", b""]


def test_other_vocabularies_get_whole_texts(tokenizer, tmp_path):
    texts = ["", "  Two  Words\n\tand 12 more!", "It's  a\nb c ", "café<|endoftext|> abc"]
    byte_level = str(public_tokenizers.path("byte_bpe_50k.json"))
    cased = json.loads(tokenizer.to_str())
    cased["normalizer"]["normalizers"].pop()
    added = json.loads(tokenizer.to_str())
    added["added_tokens"].append({"id": 49408, "content": "abc", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": False})
    paths = [byte_level]
    for name, parts in (("cased", cased), ("added", added)):
        paths.append(str(tmp_path / f"{name}.json"))
        (tmp_path / f"{name}.json").write_text(json.dumps(parts))
    assert token_output.WordEncoder(PATH).by_words
    for path in paths:
        other = token_output.WordEncoder(path)
        assert not other.by_words
        want = [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]
        assert [np.frombuffer(x, "<u4").tolist() for x in other.encode(texts)] == want


def test_op7(spark, documents, tokenizer):
    want, start = {}, 0
    for r in sorted(documents.collect()):
        ids = [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 2]
        want[r["doc_id"]] = (start, len(ids), crc(ids))
        start += len(ids)
    assert {r["doc_id"]: tuple(r)[1:] for r in token_output.op7_token_output(spark, SMALL).collect()} == want


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, odd, empty, encoding):
    path = shared_path(spark, "t")
    token_output.write_tokens(odd, PATH, path, 2, encoding=encoding)
    rows = token_output.read_tokens(spark, path).collect()
    assert len(rows) == odd.count() and rows[[r["doc_id"] for r in rows].index(None)]["start"] == 0
    ends = {r["start"] + r["n_tokens"] for r in rows}
    assert {r["start"] for r in rows} - {0} <= ends
    path = shared_path(spark, "t")
    token_output.write_tokens(empty, PATH, path, 2)
    assert token_output.read_tokens(spark, path).count() == 0


def check_placed(rows, capacity):
    at = {}
    for r in rows:
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in at.values():
        reached = 0
        for offset, length in sorted(s):
            assert offset == reached
            reached += length
        assert reached <= capacity
    return len(at)


def test_op1(spark, documents, tokenizer):
    rows = packing.op1_best_fit_packing(spark, SMALL).collect()
    want = {}
    for r in documents.collect():
        ids = [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 1]
        want |= {(r["doc_id"], k): (s, len(ids[s : s + 4096]), crc(ids[s : s + 4096])) for k, s in enumerate(range(0, len(ids), 4096))}
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    assert check_placed(rows, 4096) <= -(-sum(r["length"] for r in rows) // 4096) + 1


def test_packing_odd(spark, odd, empty):
    rows = packing.pack_documents(odd, capacity=64).collect()
    check_placed(rows, 64)
    assert {r["length"] for r in rows if r["doc_id"] in (1, 2)} == {1} and sum(r["doc_id"] == 4 for r in rows) == 2
    assert packing.pack_documents(empty).count() == 0


def test_plan_is_tight():
    rng = random.Random(1)
    for _ in range(30):
        counts = Counter(rng.choice([1, 2, 3, 7, 50, rng.randint(1, 100)]) for _ in range(rng.randint(1, 300)))
        steps = packing.plan(dict(counts), 100)
        got = Counter()
        for lengths, n in steps:
            assert sum(lengths) <= 100
            for x in lengths:
                got[x] += n
        assert got == counts
        big = sum(n for x, n in counts.items() if x > 50)
        assert sum(n for _, n in steps) <= max(-(-sum(x * n for x, n in counts.items()) // 100) * 11 // 9 + 1, big + 1)
    for gap in range(1, 40):
        counts = np.zeros(41, dtype=int)
        for x in rng.sample(range(1, 41), 5):
            counts[x] = rng.randint(1, 3)
        fill = packing.exact_fill(counts, gap)
        have = [x for x in range(1, 41) for _ in range(counts[x])]
        sums = {sum(have[i] for i in c) for k in (1, 2, 3) for c in __import__("itertools").combinations(range(len(have)), k)}
        assert (fill is None) == (gap not in sums)
        if fill:
            assert sum(fill) == gap and all(n <= counts[x] for x, n in Counter(fill).items())


def plain_contamination(docs, items, size=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans({c: c + 32 for c in range(65, 91)})
    split = lambda t: word.findall((t or "").translate(lower))
    wins = [(tuple(w[i : i + size]), n) for n, t in items for w in [split(t)] if w for i in range(max(1, len(w) - size + 1))]
    out = []
    for d, t in docs:
        w, hit, found = split(t), set(), set()
        for p, n in wins:
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit |= set(range(i, i + len(p)))
                    found.add(str(n))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_op2(spark, documents):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    words = [(r["doc_id"], r["text"]) for r in documents.collect()]
    got = sorted(map(tuple, decontamination.op2_decontamination(spark, SMALL).collect()), key=str)
    joined = {t for _, t in words}
    near = [(d, t) for d, t in words if len(t) < 4000]
    assert [g for g in got if g[0] in {d for d, _ in near}] == plain_contamination(near, items)
    assert len(got) == len(words) and any(g[5] for g in got) and joined


def test_decontamination_odd(spark, odd, empty):
    items = spark.createDataFrame([(10, "hello world"), (2, "Hello"), (3, None), (4, "..."), (5, "word number one and then some more of the words word number"), (6, "absent words")], "item_id bigint, text string")
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = plain_contamination(docs, [tuple(r) for r in items.collect()])
    for most in (10**6, 3):
        got = decontamination.contamination(odd, items, words_most=most).select(*names)
        assert sorted(map(tuple, got.collect()), key=str) == want
    assert decontamination.contamination(empty, items).count() == 0
    assert {r["n_hit"] for r in decontamination.contamination(odd, items.limit(0)).collect()} == {0}


def test_proximity():
    known = {w: i for i, w in enumerate([b"a", b"b", b"c"])}
    text = b"a x b y y y y c a b c"
    index = {}
    for w in known:
        index[w] = [i for i, x in enumerate(text.split()) if x == w]
    s = decontamination.Shard.__new__(decontamination.Shard)
    s.count = np.asarray([len(index[w]) for w in known] + [0])
    s.start = np.cumsum(s.count) - s.count
    s.pairs = np.asarray([k << 40 | p for w, k in known.items() for p in index[w]])
    assert s.near([0, 1, 2], 2).tolist() == [8] and set(s.near([0, 1], 2).tolist()) == {0, 8}


def plain_lines(docs, min_chars=40, min_docs=5):
    lower = str.maketrans({c: c + 32 for c in range(65, 91)})
    key = lambda x: x.strip("\x20\x09\x0a\x0b\x0c\x0d").translate(lower)
    low = -(2**63)
    held = Counter()
    last = {}
    for d, t in docs:
        for k in {key(x) for x in (t or "").split("\n")}:
            held[k] += 1
            last[k] = max(last.get(k, low), low if d is None else d)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        left = [x for x in lines if not (len(key(x)) >= min_chars and held[key(x)] >= min_docs and last[key(x)] != (low if d is None else d))]
        out.append((d, len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out, key=str)


def test_op10(spark, documents):
    got = sorted(map(tuple, line_dedup.op10_line_dedup(spark, SMALL).collect()), key=str)
    assert got == plain_lines([(r["doc_id"], r["text"]) for r in documents.collect()])
    assert sum(g[2] for g in got)


def test_lines_odd(spark, odd, empty):
    names = ["doc_id", "n_lines", "n_dropped"]
    docs = odd.unionByName(odd).unionByName(odd.selectExpr("doc_id + 10 AS doc_id", "text", "tokens", "h1"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = line_dedup.dedup_lines(docs, min_chars=3, min_docs=2, keys_per_shard=1)
    assert got.columns[:4] == odd.columns
    from pyspark.sql import functions as F

    assert sorted(map(tuple, got.select(*names, F.sha2("kept_text", 256)).collect()), key=str) == plain_lines(rows, 3, 2)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_minimal_perfect_hash():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 20_000).astype(np.uint64))
    mph = line_dedup.MinimalPerfectHash.load(line_dedup.MinimalPerfectHash.build(keys).dump())
    assert sorted(mph.index(keys).tolist()) == list(range(len(keys)))
    none = line_dedup.MinimalPerfectHash.load(line_dedup.MinimalPerfectHash.build(keys[:0]).dump())
    assert none.index(keys[:3]).tolist() == [-1, -1, -1]
