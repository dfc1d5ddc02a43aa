"""License scans by MinHash bands over overlapping windows, in DataFrame functions only.

Texts are lower-cased and cut into words of letters, digits and characters beyond ASCII; the unit is the run of five words
(shingle). For each template size class (a power of two of shingles, ``m``), a text is covered with windows of ``2 m`` shingles
that overlap by half, so every run of at most ``m`` shingles lies within one window. A window and a template meet if one of
``BANDS`` MinHash bands of one row agrees. A window that holds 0.8 of a template's shingles has a similarity of at least 0.8 / 2.6
with it if the template has more than ``m / 2`` shingles (0.8 x m/2 common, 2 m + 0.2 x m/2 or fewer together: over 0.19), so 48
bands retrieve it with probability 1 - 0.81^48 > 0.9999. What is retrieved is verified exactly: the share of the template's
shingles in the window, compared as texts.

A band agrees only if its minimum is the hash of a shingle that both sides have. Texts without any shingle of any template can
therefore have no collision, and are passed over before windows are made; so are, still earlier, texts without the longest word
of any template's shingle. Neither loses anything.

A template's share is that of all windows that met it together, so inserted words may spread it over several windows, as long as
each holds enough of it to be retrieved. Templates of fewer than five words are one shingle of their own length, and are looked for
as such. What is found is bounded by the list: notices in other words, or less than 0.8 of one, are not.

Templates are a bounded parameter (``MAX_SHINGLES`` in all, checked); they are sent as literals. Cases: null or short texts have
no shingles and no match; templates without a word are refused, as are null ones; repeated rows of a document are one; very long
texts are scanned whole; columns of ``docs`` other than doc_id and text are ignored; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, keep, scratch, table

SHINGLE, PERCENT, BANDS = 5, 80, 48
MAX_SHINGLES = 20_000

#: Public licence texts and notices, by SPDX identifier where there is one.
TEMPLATES = [
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", 'you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("MIT", 'Released under the MIT License'),
    ("MIT", 'Licensed under the MIT License'),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files'),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("Zlib", 'This software is provided "as-is", without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.'),
    ("Unlicense", 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.'),
    ("BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so'),
    ("WTFPL", 'Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.'),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause", '3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.'),
    ("BSD", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met'),
    ("GPL-3.0", 'This work is licensed under the GNU General Public License, version 3'),
    ("GPL-3.0", 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.'),
    ("GPL-2.0", 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.'),
    ("GPL-2.0", 'under the terms of the GNU General Public License version 2 as published by the Free Software Foundation'),
    ("GPL", 'under the terms of the GNU General Public License as published by the Free Software Foundation'),
    ("LGPL", 'under the terms of the GNU Lesser General Public License as published by the Free Software Foundation'),
    ("LGPL-3.0", 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.'),
    ("AGPL-3.0", 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.'),
    ("AGPL", 'under the terms of the GNU Affero General Public License as published by the Free Software Foundation'),
    ("MPL-2.0", 'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at'),
    ("MPL-2.0", 'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0'),
    ("EPL-2.0", 'This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0'),
    ("EPL-1.0", 'All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0'),
    ("CDDL-1.0", 'The contents of this file are subject to the terms of the Common Development and Distribution License'),
    ("OFL-1.1", 'This Font Software is licensed under the SIL Open Font License, Version 1.1'),
    ("Artistic-2.0", 'you can redistribute it and/or modify it under the terms of the Artistic License'),
    ("CC-BY-4.0", 'This work is licensed under a Creative Commons Attribution 4.0 International License'),
    ("CC-BY-SA-4.0", 'This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License'),
    ("CC-BY-NC-4.0", 'This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License'),
    ("CC-BY-ND-4.0", 'This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License'),
    ("CC-BY-NC-SA-4.0", 'This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License'),
    ("CC-BY-SA-3.0", 'This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License'),
    ("CC-BY-NC-4.0", 'Licensed under CC BY-NC 4.0'),
    ("CC-BY-4.0", 'Licensed under CC BY 4.0'),
    ("CC-BY-SA-4.0", 'Licensed under CC BY-SA 4.0'),
    ("CC-BY-SA-4.0", 'Text is available under the Creative Commons Attribution-ShareAlike License'),
    ("CC0-1.0", 'To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work'),
    ("public-domain", 'This work is in the public domain'),
    ("public-domain", 'released into the public domain'),
    ("proprietary", 'All rights reserved.'),
    ("proprietary", 'No part of this publication may be reproduced'),
    ("proprietary", 'may not be reproduced without the prior written permission of'),
    ("proprietary", 'unauthorized copying of this file, via any medium is strictly prohibited'),
]


def default_templates(spark: SparkSession) -> DataFrame:
    """(template_id, license, text) of the fixed notices."""
    return spark.createDataFrame([(i, *t) for i, t in enumerate(TEMPLATES)], "template_id int, license string, text string")


def words(text: Column) -> Column:
    """Lower-cased words; separators at the ends leave an empty word there."""
    return F.split(F.lower(text), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def _shingle_hashes(own: Column) -> Column:
    """Hashes of all runs of five words of an array of words; none for fewer words.

    The word hashes are bound as a lambda's variable, so that no optimizer rule can copy them into the inner lambda.
    """
    hashed = F.array(F.transform(own, lambda w: F.xxhash64(w)))
    runs = F.transform(hashed, lambda h: F.when(F.size(h) < SHINGLE, F.array().cast("array<long>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(F.size(h), F.lit(SHINGLE)) - SHINGLE), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(SHINGLE)]))))
    return runs[0]


def _band_keys(hashes: str | Column) -> Column:
    """BANDS keys of one MinHash row each; keys of different bands differ."""
    own = F.array(F.col(hashes) if isinstance(hashes, str) else hashes)  # bound, so that it is computed once
    bands = F.sequence(F.lit(1), F.lit(BANDS))
    return F.transform(own, lambda x: F.transform(bands, lambda b: F.xxhash64(b, F.array_min(F.transform(x, lambda h: F.xxhash64(h, b))))))[0]


def _windows(sizes: list[int], known: Column) -> Column:
    """(m, at, part) of the windows around known shingles of the words ``w``: size class, start and words of each.

    A shingle at place i is in the windows that start at the last two multiples of ``m``. Windows are cut inside the expression, so
    that rows never repeat a whole text.
    """

    def around(x, m):
        hits = F.filter(F.sequence(F.lit(0), F.size(x["sh"]) - 1), lambda i: F.array_contains(x["known"], F.get(x["sh"], i)))
        starts = F.array_distinct(F.flatten(F.transform(hits, lambda i: F.array(i - i % m, i - i % m - m))))
        cut = lambda at: F.struct(F.lit(m).alias("m"), at.alias("at"), F.slice(x["w"], at + 1, F.lit(2 * m + SHINGLE - 1)).alias("part"))
        return F.transform(F.filter(starts, lambda at: at >= 0), cut)

    hashed = F.array(F.struct(F.col("w").alias("w"), _shingle_hashes(F.col("w")).alias("sh")))
    bound = F.transform(hashed, lambda x: F.struct(x["w"].alias("w"), x["sh"].alias("sh"), F.array_intersect(x["sh"], known).alias("known")))
    return F.flatten(F.transform(bound, lambda x: F.flatten(F.array(*[around(x, m) for m in sizes]))))


def _shingle_texts(word_column: str, start: str, n: str) -> Column:
    """The distinct shingles, as texts, of ``n`` shingles from place ``start``."""
    return F.expr(f"array_distinct(transform(sequence(0, {n} - 1), i -> array_join(slice({word_column}, {start} + i + 1, {SHINGLE}), ' ')))")


def scan_licenses(docs: DataFrame, templates: DataFrame | None = None, percent: int = PERCENT) -> DataFrame:
    """(doc_id, template_id, license, first_word, last_word, n_windows, containment): one row for each document and template that it has.

    first_word and last_word bound the matching windows (words from 0), containment is that of the best window.
    """
    templates = default_templates(docs.sparkSession) if templates is None else templates
    own = templates.select("template_id", "license", F.filter(words(F.col("text")), lambda w: w != "").alias("w")).withColumn("sh", _shingle_hashes(F.col("w")))
    rows = own.limit(MAX_SHINGLES + 1).collect()
    if sum(max(1, len(r["sh"] or [])) for r in rows) > MAX_SHINGLES or any(not r["w"] for r in rows):
        raise ValueError(f"templates need words, and at most {MAX_SHINGLES} shingles in all")
    short, long = [r for r in rows if not r["sh"]], [r for r in rows if r["sh"]]
    found = None
    if long:
        with scratch():
            found = keep(_long_matches(docs, own.filter(F.size("sh") > 0), long, percent), "license-matches")
    if short:
        more = _short_matches(docs, short, templates.schema["template_id"].dataType.simpleString())
        found = more if found is None else found.unionByName(more)
    if found is None:
        raise ValueError("there are no templates")
    return found


def _long_matches(docs: DataFrame, own: DataFrame, rows: list, percent: int) -> DataFrame:
    own = own.withColumn("m", F.pow(F.lit(2), F.ceil(F.log2(F.size("sh")))).cast("int"))
    sizes = sorted({1 << (len(r["sh"]) - 1).bit_length() for r in rows})
    known = F.array(*[F.lit(h) for h in sorted({h for r in rows for h in r["sh"]})])
    anchors = sorted({max(r["w"][i : i + SHINGLE], key=lambda w: (len(w), w)) for r in rows for i in range(len(r["sh"]))})
    anchored = docs.filter(F.arrays_overlap(words(F.col("text")), F.array(*[F.lit(w) for w in anchors])))
    likely = anchored.filter(F.arrays_overlap(_shingle_hashes(words(F.col("text"))), known)).select("doc_id", words(F.col("text")).alias("w"))
    windows = likely.select("doc_id", F.inline(_windows(sizes, known))).withColumn("n", F.size("part") - (SHINGLE - 1)).filter("n > 0").withColumn("keys", _band_keys(_shingle_hashes(F.col("part"))))
    banded = own.select("template_id", "license", "m", _shingle_texts("w", "0", "size(sh)").alias("wanted"), F.explode(_band_keys("sh")).alias("key"))
    met = windows.select("doc_id", "m", "at", "n", "part", F.explode("keys").alias("key")).join(F.broadcast(banded), ["m", "key"]).withColumn("same", F.xxhash64("part")).dropDuplicates(["doc_id", "at", "template_id", "same"])
    common = cut(met.select("doc_id", "template_id", "license", "at", "n", F.size("wanted").alias("all"), F.array_intersect("wanted", _shingle_texts("part", "0", "n")).alias("common")).filter(F.size("common") > 0), "license-windows")
    each = common.select("*", F.explode("common").alias("one")).groupBy("doc_id", "template_id", "license", "one").agg(F.min("at").alias("first"), F.max(F.col("at") + F.col("n") + SHINGLE - 2).alias("last"), F.max("all").alias("all"))
    share = F.count("*") / F.max("all")
    whole = each.groupBy("doc_id", "template_id", "license").agg(F.min("first").alias("first_word"), F.max("last").alias("last_word"), share.alias("share")).filter(F.col("share") * 100 >= percent)
    counts = common.groupBy("doc_id", "template_id").agg(F.count_distinct("at").alias("n_windows"))
    whole = whole.withColumnsRenamed({"doc_id": "d", "template_id": "t"}).join(counts, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("template_id")))
    return whole.select("doc_id", "template_id", "license", "first_word", "last_word", "n_windows", F.round("share", 6).alias("containment"))


def _short_matches(docs: DataFrame, rows: list, kind: str) -> DataFrame:
    """Templates of fewer than five words, found as runs of words."""
    anchors = sorted({max(r["w"], key=lambda w: (len(w), w)) for r in rows})
    anchored = docs.filter(F.arrays_overlap(words(F.col("text")), F.array(*[F.lit(w) for w in anchors])))
    plain = anchored.select("doc_id", F.concat(F.lit(" "), F.array_join(F.filter(words(F.col("text")), lambda w: w != ""), " "), F.lit(" ")).alias("plain"))
    wanted = F.array(*[F.struct(F.lit(r["template_id"]).cast(kind).alias("template_id"), F.lit(r["license"]).alias("license"), F.lit(f" {' '.join(r['w'])} ").alias("run"), F.lit(len(r["w"])).alias("k")) for r in rows])
    spaces = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    hits = plain.select("doc_id", "plain", F.inline(wanted)).filter(F.contains("plain", F.col("run"))).withColumn("times", F.size(F.split("plain", F.concat(F.lit(r"\Q"), F.rtrim("run"), F.lit(r"\E(?= )")))) - 1)
    first = spaces(F.substr("plain", F.lit(1), F.instr("plain", F.col("run")))) - 1
    last = spaces("plain") - 2 - (spaces(F.substr(F.reverse("plain"), F.lit(1), F.instr(F.reverse("plain"), F.reverse("run")))) - 1)
    placed = hits.select("doc_id", "template_id", "license", first.alias("first_word"), last.alias("last_word"), "times")
    return placed.groupBy("doc_id", "template_id", "license").agg(F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"), F.max("times").cast("long").alias("n_windows"), F.lit(1.0).alias("containment"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices of every document."""
    return scan_licenses(table(spark, sf_dir, "documents"))
