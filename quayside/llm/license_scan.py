"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Texts and templates are lower-cased runs of letters and digits in shingles of five words. Templates are grouped by size;
for each size w, a power of two, texts are cut into windows of 2 w shingles, at steps of w, so that every copy of a
template of n shingles lies whole inside a window, with a Jaccard similarity J of at least 0.8 n / (n + 2 w - 0.8 n) even
if a fifth of it is changed. Each of BANDS bands is one minimum: a template is missed with probability at most
(1 - J)^BANDS, below 1e-6 for the worst n, just above w / 2, where J is 0.19.
A window can share a minimum with a template only if it holds that template's minimal shingle, so windows are sketched
only in texts that hold one; this prunes no collision.

Retrieved windows are verified: the share of the template's shingles among those of the window must be 0.8 or more.
Full notices hold the shorter notices they begin with, and both are reported; of BSD-3-Clause and BSD-2-Clause, which
differ in one clause only, choose leaves the one that fits: the former if about half of its own clause is there.

Defined results: one row per document and template found; a null, empty or short text has none; an empty table gives an
empty result; rows that repeat a document repeat its result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.plans.runtime import let

SHINGLE, CONTAINED, BANDS = 5, 0.8, 72

# Public license notices.
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT-notice": "Released under the MIT License.",
    "MIT-licensed": "Licensed under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC-permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

#: Templates that hold nearly all of another: where both are contained, one of them is chosen.
SPECIFIC = (("BSD-3-Clause", "BSD-2-Clause"),)


def shingles(text: Column, size: int) -> Column:
    """64-bit hashes of the shingles of a text, in order; none if it has fewer words than one."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    hashes = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[w[i + k] for k in range(size)]))
    return let(words, lambda w: F.when(F.size(w) < size, F.array().cast("array<bigint>")).otherwise(hashes(w)))


def minimum(hashes: Column, band: Column | int) -> Column:
    return F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, F.lit(band) if isinstance(band, int) else band)))


def least_shingle(hashes: Column, band: int) -> Column:
    return F.array_min(F.transform(hashes, lambda h: F.struct(F.xxhash64(h, F.lit(band)), h.alias("h"))))["h"]


def known(spark: SparkSession, templates: dict[str, str], size: int) -> list:
    """Of each template: its distinct shingles, its minimum in each band, and the shingle that gives it. A bounded table of our own."""
    frame = spark.createDataFrame(sorted(templates.items()), "license string, text string").withColumn("items", F.array_distinct(shingles(F.col("text"), size)))
    rows = frame.where(F.size("items") > 0).select("license", "items", F.array(*[minimum(F.col("items"), b) for b in range(BANDS)]).alias("minima"), F.array(*[least_shingle(F.col("items"), b) for b in range(BANDS)]).alias("least"))
    return rows.collect()


def size_class(n: int) -> int:
    """Templates are grouped by their number of shingles, rounded up to a power of two."""
    return 1 << max(0, n - 1).bit_length()


def longs(values) -> Column:
    return F.array(*[F.lit(int(v)).cast("long") for v in values])


def matches_of_class(items: Column, rows: list, width: int) -> Column:
    """Template matches (license, containment, start in shingles) of one size class in a text's shingles."""
    kind = "array<struct<license:string,containment:double,window:int>>"

    def in_window(window: Column, w: Column) -> Column:
        def retrieved(minima: Column) -> Column:
            def verified(row) -> Column:
                share = F.size(F.array_intersect(longs(row["items"]), window)) / F.lit(float(len(row["items"])))
                hit = F.exists(F.zip_with(minima, longs(row["minima"]), lambda a, b: a == b), lambda same: same)
                return F.struct(F.lit(row["license"]).alias("license"), F.when(hit, share).otherwise(0.0).alias("containment"), (w * width).alias("window"))

            return F.filter(F.array(*[verified(r) for r in rows]), lambda m: m["containment"] >= CONTAINED)

        # a bound variable's sketch is made once and held against all templates
        return let(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: minimum(window, b)), retrieved)

    least = {v for r in rows for v in r["least"]}
    cut = lambda w: F.slice(items, w * width + 1, F.lit(2 * width))
    windows = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(items) / width).cast("int") - 1))
    holding = F.filter(windows, lambda w: F.exists(cut(w), lambda h: h.isin(*least)))
    return F.flatten(F.transform(holding, lambda w: let(cut(w), lambda window: in_window(window, w)))).cast(kind)


def choice(rows: list):
    """A function that leaves one of each pair of SPECIFIC in an array of matches."""
    items = {r["license"]: set(r["items"]) for r in rows}
    kept = lambda m: m
    for special, general in SPECIFIC:
        if special in items and general in items:
            # between the share of the special template that a copy of the general one has, and all of it
            least = (1 + len(items[special] & items[general]) / len(items[special])) / 2
            fits = lambda s, g, least=least: s["containment"] >= least * g["containment"]
            beaten = lambda x, y, s=special, g=general, fits=fits: ((x["license"] == g) & (y["license"] == s) & fits(y, x)) | ((x["license"] == s) & (y["license"] == g) & ~fits(x, y))
            kept = lambda m, before=kept, beaten=beaten: let(before(m), lambda a: F.filter(a, lambda x: ~F.exists(a, lambda y: beaten(x, y))))
    return kept


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, choose: bool = False) -> DataFrame:
    """doc_id, license and containment: the best containment of each template found in a document; choose: one of each pair of SPECIFIC."""
    rows = known(docs.sparkSession, TEMPLATES if templates is None else templates, SHINGLE)
    classes: dict[int, list] = {}
    for r in rows:
        classes.setdefault(size_class(len(r["items"])), []).append(r)
    least = {v for r in rows for v in r["least"]}
    hashed = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select("doc_id", shingles(F.col("text"), SHINGLE).alias("items"))
    holding = hashed.where(F.exists("items", lambda h: h.isin(*least)) if least else F.lit(False))
    found = F.concat(*[matches_of_class(F.col("items"), rs, width) for width, rs in sorted(classes.items())]) if classes else F.array().cast("array<struct<license:string,containment:double,window:int>>")
    # a document's matches are merged in its own row: the best window of each template, the first of equals
    best = lambda m: F.array_distinct(F.transform(m, lambda x: F.struct(x["license"].alias("license"), F.array_max(F.transform(F.filter(m, lambda y: y["license"] == x["license"]), lambda y: y["containment"])).alias("containment"))))
    left = choice(rows) if choose else lambda m: m
    return holding.select("doc_id", F.explode(left(let(found, best))).alias("m")).select("doc_id", "m.license", F.round("m.containment", 6).alias("containment"))
