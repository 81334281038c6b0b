"""License scans with DataFrame functions only.

Headers are runs of one to three adjacent lines or sentences from one that names a licence on; a file is also compared
as a whole. Both are held against notice templates and whole licence texts by the cosine of sparse TF-IDF vectors,
computed beside the row, since the templates are few and fixed. A licence file (by name, by being a licence text as a
whole, or as told) gives its licence to its directory; a file without a licence of its own takes that of the nearest
ancestor directory, found by joining the distinct directories' ancestors with the licensed ones.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions, table

# fixed values: SPDX names, full names and short notices of public licences
NAMES = {
    "Apache-2.0": "Apache License, Version 2.0",
    "MIT": "MIT License",
    "BSD-2-Clause": "BSD 2-Clause License",
    "BSD-3-Clause": "BSD 3-Clause License",
    "GPL-2.0": "GNU General Public License, version 2",
    "GPL-3.0": "GNU General Public License, version 3",
    "LGPL-3.0": "GNU Lesser General Public License, version 3",
    "AGPL-3.0": "GNU Affero General Public License, version 3",
    "MPL-2.0": "Mozilla Public License, version 2.0",
    "ISC": "ISC License",
    "Unlicense": "Unlicense",
    "CC0-1.0": "CC0 1.0 Universal",
    "CC-BY-4.0": "CC BY 4.0",
    "CC-BY-SA-4.0": "CC BY-SA 4.0",
    "CC-BY-NC-4.0": "CC BY-NC 4.0",
}
FORMS = ("{}", "Licensed under {}", "Licensed under the {}", "Released under the {}", "This work is licensed under the {}", "This file is distributed under the terms of the {}", "SPDX-License-Identifier: {}")
WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version. "
GNU_END = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details."
#: Whole texts of the short licences, and the notices that the long ones tell their users to write.
TEXTS = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + WARRANTY,
    "BSD-2-Clause": BSD + BSD_END,
    "BSD-3-Clause": BSD + BSD_THIRD + BSD_END,
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "GPL-2.0": GNU.format("General Public License", 2) + GNU_END.format("General Public License"),
    "GPL-3.0": GNU.format("General Public License", 3) + GNU_END.format("General Public License"),
    "LGPL-3.0": GNU.format("Lesser General Public License", 3) + GNU_END.format("Lesser General Public License"),
    "AGPL-3.0": GNU.format("Affero General Public License", 3) + GNU_END.format("Affero General Public License"),
}
CLAUSE = "under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License"
GNU_CLAUSES = {"GPL-2.0": CLAUSE.format("General Public License", 2), "GPL-3.0": CLAUSE.format("General Public License", 3), "LGPL-3.0": CLAUSE.format("Lesser General Public License", 3), "AGPL-3.0": CLAUSE.format("Affero General Public License", 3)}
HEADER = r"(?i)licen[cs]|spdx|copying|public domain|permission (?:is hereby granted|to use)|redistribution and use|\b(?:cc0|cc[- ]by|gpl|lgpl|agpl)\b"
#: Between sentences of one line.
SENTENCES = r"(?<=[.;!?])[ \t]+(?=[A-Z])"
#: Units of a header, at most.
RUN = 3
LICENSE_FILE = r"(?i)(?:^|/)(?:licen[cs]e|copying|unlicense|notice)(?:[.-][^/]*)?$"
SPLIT = r"[^a-z0-9.]+|\.+(?=[^a-z0-9]|$)"


def terms_of(text: str) -> list[str]:
    return [t for t in re.split(SPLIT, text.lower()) if t]


def templates() -> tuple[list[dict], dict[str, float], float]:
    """Templates as unit vectors, the terms' inverse document frequencies among them, and that of other terms."""
    texts = [(name, form.format(name if "SPDX" in form else full), False) for name, full in NAMES.items() for form in FORMS] + [(name, x, False) for name, x in GNU_CLAUSES.items()] + [(name, x, True) for name, x in TEXTS.items()]
    df = Counter(t for _, x, _ in texts for t in set(terms_of(x)))
    idf = {t: math.log((1 + len(texts)) / (1 + n)) + 1 for t, n in df.items()}
    out = []
    for name, x, whole in texts:
        tf = Counter(terms_of(x))
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in tf.items()))
        out.append({"name": name, "text": whole, "terms": [{"t": t, "w": n * idf[t] * idf[t] / norm} for t, n in sorted(tf.items())]})
    return out, idf, math.log(1 + len(texts)) + 1


def bound(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def best_template(text: Column, whole: Column) -> Column:
    """struct(score, name) of the template nearest to a text, for a ``whole`` one among TEXTS; ties go to the later name."""
    found, idf, other = templates()
    at = {t: k for k, t in enumerate(idf)}
    placed = []
    for x in found:
        weights = [0.0] * len(idf)
        for y in x["terms"]:
            weights[at[y["t"]]] = y["w"]
        placed.append({"name": x["name"], "text": x["text"], "w": weights})
    all_ = F.from_json(F.lit(json.dumps(placed)), "array<struct<name: string, text: boolean, w: array<double>>>")
    of = F.from_json(F.lit(json.dumps(idf)), "map<string, double>")
    place = F.from_json(F.lit(json.dumps(at)), "map<string, int>")

    def squares(terms: Column) -> Column:
        """The squared length of a vector, by runs of equal terms."""
        state = lambda total, last, n: F.struct(total.alias("total"), last.alias("last"), n.alias("n"))
        square = lambda s: F.pow(s["n"] * F.coalesce(F.element_at(of, s["last"]), F.lit(other)), F.lit(2))
        step = lambda s, t: F.when(s["last"] == t, state(s["total"], t, s["n"] + 1)).otherwise(state(s["total"] + square(s), t, F.lit(1)))
        return F.aggregate(terms, state(F.lit(0.0), F.lit(""), F.lit(0)), step, lambda s: s["total"] + square(s))

    known = lambda terms: F.filter(F.transform(terms, lambda t: F.element_at(place, t)), lambda k: k.isNotNull())

    def nearest(v: Column) -> Column:
        dot = lambda x: F.aggregate(v["known"], F.lit(0.0), lambda s, k: s + F.get(x["w"], k))
        return F.array_max(F.transform(F.filter(all_, lambda x: x["text"] | ~whole), lambda x: F.struct(F.when(v["squares"] > 0, dot(x) / F.sqrt(v["squares"])).otherwise(0.0).alias("score"), x["name"].alias("name"))))

    terms = F.sort_array(F.filter(F.split(F.lower(text), SPLIT), lambda t: t != ""))
    return bound(bound(terms, lambda t: F.struct(squares(t).alias("squares"), known(t).alias("known"))), nearest)


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", least: float = 0.6, is_license_file: Column | None = None) -> DataFrame:
    """path, license, score, line, origin ("own", a directory, or null) for every row.

    ``is_license_file`` may tell licence files by columns path, text, license, score and whole (the whole text's score among TEXTS);
    by default, it goes by names, or by a whole text that is a licence's. Lines count from 1; of a file's headers and
    its whole text (line 1) the nearest to a template counts, the earliest of equals. A directory with several licence
    files takes the best score, then the least path. Null texts have no headers; a null path has no directory and
    inherits nothing; repeated rows each get a row. Very long texts are compared whole. An empty table gives no rows.
    """
    spark = files.sparkSession
    rows = files.select(F.col(path_col).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    units = F.flatten(F.transform(F.split("text", "\n"), lambda x, i: F.transform(F.split(x, SENTENCES), lambda u: F.struct(u.alias("text"), (i + 1).alias("line")))))
    begins = lambda u: F.filter(F.transform(u, lambda x, i: F.when(x["text"].rlike(HEADER), i + 1)), lambda i: i.isNotNull())
    run = lambda u, i, k: F.struct(F.array_join(F.transform(F.slice(u, i, F.lit(k)), lambda x: x["text"]), " ").alias("text"), F.element_at(u, i)["line"].alias("line"), F.lit(False).alias("whole"))
    runs = lambda u: F.flatten(F.transform(begins(u), lambda i: F.array(*(run(u, i, k) for k in range(1, RUN + 1)))))
    whole = F.array(F.struct(F.col("text").alias("text"), F.lit(1).alias("line"), F.lit(True).alias("whole")))
    rows = rows.withColumn("headers", F.when(F.col("text").rlike(HEADER), F.concat(bound(units, runs), whole)))
    near = F.transform("headers", lambda h: F.struct(best_template(h["text"], h["whole"]).alias("b"), (-h["line"]).alias("back"), h["whole"].alias("whole")))
    near = F.transform(near, lambda x: F.struct(F.round(x["b"]["score"], 9).alias("score"), x["back"].alias("back"), x["b"]["name"].alias("name"), x["whole"].alias("whole")))
    rows = rows.select("path", "text", F.inline_outer(F.array(F.struct(near.alias("found")))))  # computed once
    rows = rows.withColumn("near", F.array_max("found")).withColumn("whole", F.array_max(F.filter("found", lambda x: x["whole"]))["score"])
    ok = F.coalesce(F.col("near.score") >= least, F.lit(False))
    rows = rows.select("path", "text", "whole", F.when(ok, F.col("near.name")).alias("license"), F.when(ok, F.col("near.score")).alias("score"), F.when(ok, -F.col("near.back")).alias("line"))
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).when(F.col("path").isNotNull(), "")
    told = F.coalesce(is_license_file if is_license_file is not None else F.col("path").rlike(LICENSE_FILE) | (F.col("whole") >= least), F.lit(False))
    rows = rows.withColumn("told", told & F.col("license").isNotNull()).select("path", "license", "score", "line", "told", folder.alias("folder"))
    rows = materialize(rows, "licenses")  # texts are read and compared once
    licensed = rows.filter("told AND folder IS NOT NULL").groupBy("folder").agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "license"))["license"].alias("given"))
    wanted = rows.filter("license IS NULL AND folder IS NOT NULL").groupBy("folder").agg(F.count("*").alias("n"))
    wanted = materialize(wanted, "folders")
    parts = F.split("folder", "/")
    above = F.array_union(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))
    ancestors = wanted.select("folder", F.posexplode(above).alias("depth", "at"))
    nearest = ancestors.join(licensed.withColumnRenamed("folder", "at"), "at").groupBy("folder").agg(F.max(F.struct("depth", "at", "given")).alias("n"))
    # directories of many files are dealt to several tasks, a row for each share of files at most
    each = max(500, (wanted.agg(F.sum("n")).first()[0] or 0) // shuffle_partitions(spark))
    hot = F.broadcast(wanted.filter(F.col("n") > each).select("folder", F.ceil(F.col("n") / each).alias("parts")))
    share = F.coalesce("parts", F.lit(1).cast("long"))
    nearest = nearest.join(hot, "folder", "left").select("folder", "n", F.explode(F.sequence(F.lit(0).cast("long"), share - 1)).alias("part"))
    dealt = rows.join(hot, "folder", "left").withColumn("part", F.pmod(F.monotonically_increasing_id(), share))
    out = dealt.join(nearest, ["folder", "part"], "left")
    own = F.col("license").isNotNull()
    return out.select("path", F.coalesce("license", "n.given").alias("license"), "score", "line", F.when(own, "own").otherwise(F.col("n.at")).alias("origin"))


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    """Documents have no paths: their source, language and id stand for one. Those that are licence texts as a whole are their folder's licence files."""
    docs = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "text")
    return scan(docs).select(F.element_at(F.split("path", "/"), -1).cast("long").alias("doc_id"), "path", "license", F.round("score", 6).alias("score"), F.col("line").cast("long").alias("line"), "origin")
