import math
import re
from collections import Counter

import pytest

from rowloom.llm import licenses as lic

from .conftest import SMALL


def plain_line(line, whole=False):
    found, idf, other = lic.templates()
    tf = Counter(lic.terms_of(line))
    norm = math.sqrt(sum((n * idf.get(t, other)) ** 2 for t, n in tf.items()))
    return max((sum(tf[t["t"]] * t["w"] for t in x["terms"]) / norm if norm else 0.0, x["name"]) for x in found if x["text"] or not whole)


def plain(rows, licence_file):
    own, given = [], {}
    for path, text in rows:
        text = text or ""
        units = [(u, k) for k, x in enumerate(text.split("\n"), 1) for u in re.split(lic.SENTENCES, x)]
        asked = [(" ".join(u for u, _ in units[i : i + n]), k, False) for i, (x, k) in enumerate(units) if re.search(lic.HEADER, x) for n in (1, 2, 3)]
        asked += [(text, 1, True)] if re.search(lic.HEADER, text) else []
        found = [(round(s, 9), -k, n, whole) for x, k, whole in asked for s, n in [plain_line(x, whole)]]
        best = max(found, default=None)
        whole = max((f[0] for f in found if f[3]), default=0)
        own.append(best if best and best[0] >= 0.6 else None)
        if own[-1] and path is not None and licence_file(path, whole):
            folder = path.rpartition("/")[0]
            given[folder] = min(given.get(folder, (9,)), (-own[-1][0], path, own[-1][2]))
    out = []
    for (path, _), b in zip(rows, own):
        at, origin, name = path, None, None
        while not b and at:
            at = at.rpartition("/")[0]
            if at in given:
                origin, name = at, given[at][2]
                break
        out.append((path, b[2], b[0], -b[1], "own") if b else (path, name, None, None, origin))
    return sorted(out, key=str)


def named(path, whole):
    return bool(re.search(lic.LICENSE_FILE, path)) or whole >= 0.6


def rounded(rows):
    return sorted(((p, n, s and round(s, 6), k, o) for p, n, s, k, o in rows), key=str)


def test_op6(spark, documents):
    rows = [(f"{r['source']}/{r['lang']}/{r['doc_id']}", r["text"]) for r in documents.collect()]
    got = [tuple(r)[1:] for r in lic.op6_license_scan(spark, SMALL).collect()]
    assert rounded(got) == rounded(plain(rows, named)) and any(g[4] == "own" for g in got)


def test_trees(spark):
    rows = [("LICENSE", "MIT License\n\nPermission is hereby granted"), ("a/b/c.py", "x"), ("a/COPYING", "This work is licensed under the GNU General Public License, version 3.\n"), ("a/b/d.py", "# SPDX-License-Identifier: Apache-2.0\nimport x"), ("z.py", None), (None, "y"), ("a/b/c.py", "x"), ("q/", ""), ("e/f/g/h.txt", "licensed for nothing at all in these many words"), ("b/license.md", "All rights reserved")]
    got = lic.scan(spark.createDataFrame(rows, "path string, text string")).collect()
    assert rounded(map(tuple, got)) == rounded(plain(rows, named))
    by = {r["path"]: r["license"] for r in got}
    assert by["a/b/c.py"] == "GPL-3.0" and by["a/b/d.py"] == "Apache-2.0" and by["z.py"] == "MIT" and by[None] is None


@pytest.mark.parametrize("text,name", [("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("Released under the MIT License.", "MIT"), ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"), ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0")])
def test_notices(text, name):
    score, got = plain_line(text)
    assert got == name and score > 0.9


def test_whole_texts(spark):
    """Licence texts without a title, by any file name; notices over several lines and within one long line; a hot directory."""
    copyright_ = "Copyright (c) 2020 Somebody\n\n"
    rows = [(f"{n}/any", copyright_ + t.replace(". ", ".\n\n")) for n, t in lic.TEXTS.items()]
    rows += [(f"{n}/deep/x{k}.py", f"code {k}") for n in lic.TEXTS for k in range(3)]
    rows += [("LICENSE.md", lic.NAMES["Apache-2.0"]), ("p/LICENSE", lic.TEXTS["MIT"]), ("p/a.py", "x"), ("q/a.py", "# under the terms of the GNU General Public License as published by the\n# Free Software Foundation, either version 3 of the License\nimport x")]
    rows += [("r/a.txt", "Some words come first. " + "Many words follow here. " * 30 + "Released under the MIT License. And more words. " * 2)]
    rows += [("hot/LICENSE", lic.TEXTS["ISC"])] + [(f"hot/{k}", "x") for k in range(1500)]
    got = {r["path"]: (r["license"], r["origin"]) for r in lic.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert {n: got[f"{n}/any"][0] for n in lic.TEXTS} == {n: n for n in lic.TEXTS}
    assert all(got[f"{n}/deep/x{k}.py"] == (n, n) for n in lic.TEXTS for k in range(3))
    assert got["p/a.py"] == ("MIT", "p") and got["q/a.py"][0] == "GPL-3.0" and got["r/a.txt"] == ("MIT", "own")
    assert all(got[f"hot/{k}"] == ("ISC", "hot") for k in range(1500))


def test_odd(spark, odd, empty):
    files = odd.selectExpr("tokens AS path", "text", "h1 AS license")
    assert lic.scan(files).count() == odd.count()
    assert lic.scan(empty.selectExpr("tokens AS path", "text")).count() == 0
