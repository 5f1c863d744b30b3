"""License scans: a trained paragraph classifier, confirmed by comparison with templates.

Paragraphs are the lines of a text, and stretches of adjacent lines that hold a wrapped notice. A multinomial logistic regression over word uni- and bigrams (indicators) is trained on
notices of each licence family, on licence-like sentences of no family ("unknown") and on ordinary prose ("none"). Its
probabilities are calibrated by a temperature fitted to variants that the training left out. A paragraph of a family is
confirmed if it holds CONFIRM or more of the word trigrams of one of the family's templates; one that looks like a licence but
is not confirmed, or whose best family has too little probability, is reported as "unknown".

Each line is judged alone. Besides, each stretch of lines is judged as if it were one, from a line with a word of the vocabulary up to
SPAN words on (or a line without words), if it holds a trigram of a template. Stretches count only where a family is confirmed and
no line or shorter stretch within confirms it. Those that share a line and a template are one notice. It is reported at its first
line, and lines within that are unknown by themselves are not reported again.

The vocabulary leaves out n-grams of function words only. A line without any word of the vocabulary has no features, hence the
class "none" (its bias is the largest by construction, see fitted()), so most lines are settled by a look at their words. All
else is joins with tables of weights and templates, whose sizes depend on the templates alone (a few thousand rows: a bounded
broadcast). Only DataFrame functions touch the documents; training takes a moment on the driver.

Null and empty texts have no paragraphs. Repeated rows are reported each, rows without an id too. Extra columns are ignored, whatever
their names; an empty table gives no rows. Lines of any length are judged whole. Of classes of equal scores the first counts, of
templates of equal overlap the last by name.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Notices by family, as people write them; each is also a template.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "Apache License Version 2.0, January 2004",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
        "See the License for the specific language governing permissions and limitations under the License",
    ],
    "mit": [
        "Released under the MIT License",
        "This project is licensed under the terms of the MIT license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "SPDX-License-Identifier: MIT",
        "The MIT License (MIT)",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "Licensed under the BSD 3-Clause License",
        "Released under the BSD 2-Clause License",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Released under the GPL version 2 or later",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1",
        "modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Lesser General Public License along with this library",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "agpl": [
        "This work is licensed under the GNU Affero General Public License, version 3",
        "modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Affero General Public License along with this program",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0",
        "Licensed under the Mozilla Public License Version 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "provided that the above copyright notice and this permission notice appear in all copies",
        "Released under the ISC License",
        "SPDX-License-Identifier: ISC",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
        "Released under CC0 1.0 Universal Public Domain Dedication",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain",
        "SPDX-License-Identifier: Unlicense",
    ],
}
UNKNOWN_EXAMPLES = [
    "All rights reserved. No part of this publication may be reproduced without permission",
    "Copyright 2021 Example Corporation. All rights reserved",
    "Licensed under the terms of the vendor agreement",
    "This software is provided under a proprietary license",
    "Use of this product is subject to the end user license agreement",
    "See the license for the specific language governing permissions",
    "The software is provided as is, without warranty of any kind",
    "Distributed under the license of its owner",
    "All rights reserved",
    "All rights reserved by the authors",
    "Released under the zlib license",
    "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software",
    "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission",
    "You may not use this work except in compliance with the Licence",
    "Distributed under the Boost Software License, Version 1.0",
    "Licensed under the Artistic License 2.0",
    "Licensed under the Python Software Foundation License Version 2",
    "This software is subject to the terms of the Common Development and Distribution License",
    "Licensed under the Business Source License 1.1",
    "The Software shall be used for Good, not Evil",
    "The licensee may not sublicense, rent, lease or lend the software to any third party",
    "Licensed under the SIL Open Font License, Version 1.1",
    "Licensed under the Open Data Commons Open Database License",
    "You may install and use any number of copies of the software on your devices under this end user license",
    "SPDX-License-Identifier: Zlib",
    "SPDX-License-Identifier: EPL-2.0",
]
NONE_EXAMPLES = [
    "The committee will publish its report for the general public in the spring",
    "Please copy the file to the shared folder and compile the program again",
    "Version 3 of the plan is on the table and version 2 was dropped",
    "He lost his driving license on the way to work",
    "Anyone is free to come along to the meeting on Monday",
    "The library is open to any person with a card",
    "Our software and its documentation were written at the foundation",
    "They sell bread and distribute it without fee to the poor",
    "The author of this work was a professor of law",
    "You should have received a letter and a copy of the form",
    "In the attribution of the painting opinion is divided",
    "Apache helicopters flew over the public square in January",
    "The following conditions were met in the first half of the year",
    "A source of light and a binary star are in the field",
    "Creative people like the commons and the park",
    "The students of MIT and the team of Mozilla met in Berkeley",
    "The warranty of the car covers parts and labour for three years",
    "All conditions of the experiment are listed in the documentation of the work",
    "The copyright office moved to a new building and the notice on the door was removed",
    "Persons under eighteen are not permitted to purchase a ticket without a person of age",
    "The publisher will merge the two editions and sell copies of the second one at the fair",
    "A version of the software was installed on every machine of the library",
    "The distribution of income between persons and the rights of workers were subject to debate",
    "Materials provided with the course may be used for any purpose in the classroom",
    "Products derived from milk must be kept cold and the name of the holder written on them",
    "The terms of the agreement between the two states were made public in writing",
    "The European Commission will approve the plan as soon as the members are ready",
    "Use the source file to compile the program and copy the binary form to the disk",
]
FUNCTION_WORDS = set("a an and any are as at be by can for from has have he her his i if in into is it its may not of on or our she that the their they this to under was we were which will with without you your".split())
CONFIRM, LEAST_PROBABILITY = 0.6, 0.5
#: Words of a stretch of lines before its last line, at most: twice those of the longest template.
SPAN = 2 * max(len(re.findall("[A-Za-z0-9]+", line)) for lines in TEMPLATES.values() for line in lines)


def words_of(line: str) -> list[str]:
    return re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), line))


def grams_of(words: list[str]) -> set[str]:
    return set(words) | {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


def variants(line: str) -> list[list[str]]:
    """A notice, and what remains of it where it is cut or joined with other words."""
    w = words_of(line)
    out = [w, ["see", "file", *w], [*w, "and", "more", "text", "follows"]]
    return out + [w[2:], w[:-2]] if len(w) > 6 else out


@lru_cache(maxsize=1)
def fitted() -> tuple[list[str], dict[str, np.ndarray], np.ndarray]:
    """(classes, weights by n-gram, biases), the temperature applied. Classes "unknown" and "none" come last."""
    classes = [*TEMPLATES, "unknown", "none"]
    groups = [*TEMPLATES.values(), UNKNOWN_EXAMPLES, NONE_EXAMPLES]
    rows = [(v, c, i) for c, lines in enumerate(groups) for line in lines for i, v in enumerate(variants(line))]
    vocabulary = sorted({g for w, c, _ in rows for g in grams_of(w) if c < len(TEMPLATES) + 1 and not set(g.split(" ")) <= FUNCTION_WORDS})
    index = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(rows), len(vocabulary)))
    for r, (w, _, _) in enumerate(rows):
        x[r, [index[g] for g in grams_of(w) if g in index]] = 1
    y = np.array([c for _, c, _ in rows])
    learn = np.array([i != 2 for _, _, i in rows])
    t = np.eye(len(classes))[y]
    weight, bias = np.zeros((len(vocabulary), len(classes))), np.zeros(len(classes))
    scale = (1 / np.bincount(y[learn], minlength=len(classes)))[y[learn]][:, None]
    scale = scale / scale.sum()
    for _ in range(400):
        z = x[learn] @ weight + bias
        p = np.exp(z - z.max(1, keepdims=True))
        d = (p / p.sum(1, keepdims=True) - t[learn]) * scale
        weight -= 8.0 * (x[learn].T @ d + 1e-4 * weight)
        bias -= 8.0 * d.sum(0)
    bias[-1] = max(bias[-1], bias[:-1].max() + 1)  # without features: none

    def loss(temperature: float) -> float:
        z = (x[~learn] @ weight + bias) / temperature
        z = z - z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), y[~learn]]).mean())

    best = min((s / 20 for s in range(4, 81)), key=loss)
    weight, bias = weight / best, bias / best
    return classes, {g: weight[i] for g, i in index.items()}, bias


def _grams(words: Column, n: int) -> Column:
    """The n-grams of an array of words."""
    starts = F.sequence(F.lit(1), F.size(words) - n + 1)
    return F.when(F.size(words) >= n, F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", confirm: float = CONFIRM, least: float = LEAST_PROBABILITY) -> DataFrame:
    """(doc_id, line_no, family, best_family, probability, template, overlap) of each paragraph that is no ordinary prose."""
    spark = docs.sparkSession
    classes, weights, bias = fitted()
    single = sorted(g for g in weights if " " not in g)
    shapes = [(f, f"{f}/{n}", " ".join(w[i : i + 3]), k) for f, t in TEMPLATES.items() for n, line in enumerate(t) for w in [words_of(line)] for k in [max(1, len({*zip(w, w[1:], w[2:], strict=False)}))] for i in sorted({" ".join(w[i : i + 3]): i for i in range(max(1, len(w) - 2))}.values())]
    text = F.col(text_col).cast("string")
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    worded = F.transform(F.split(low, "\r?\n"), lambda x: F.filter(F.split(x, "[^a-z0-9]+"), lambda w: w != ""))
    lines = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("doc"), worded.alias("lines"))
    known, marks = F.array(*map(F.lit, single)), F.array(*[F.lit(g) for g in sorted({g for _, _, g, _ in shapes})])
    starts = F.filter(F.transform("lines", lambda ws, i: F.when(F.arrays_overlap(ws, known), i)), lambda i: i.isNotNull())
    ahead = lines.select("doc_id", "doc", F.explode(F.transform(starts, lambda i: F.struct(i.alias("line_no"), F.slice("lines", i + 1, SPAN + 1).alias("ahead")))).alias("s")).select("doc_id", "doc", "s.*")
    # How many lines on: each has words, and those before it have fewer than SPAN.
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("words"), F.lit(True).alias("open"))
    step = lambda a, ws: F.when(a["open"] & (F.size(ws) > 0) & (a["words"] < SPAN), F.struct((a["n"] + 1).alias("n"), (a["words"] + F.size(ws)).alias("words"), F.lit(True).alias("open"))).otherwise(F.struct(a["n"].alias("n"), a["words"].alias("words"), F.lit(False).alias("open")))
    ahead = ahead.withColumn("n", F.aggregate("ahead", none, step)["n"])
    stretches = ahead.select("doc_id", "doc", "line_no", "ahead", F.explode(F.sequence(F.lit(1), "n")).alias("n_lines")).select("doc_id", "doc", "line_no", "n_lines", F.flatten(F.slice("ahead", F.lit(1), F.col("n_lines"))).alias("words"))
    stretches = stretches.filter((F.col("n_lines") == 1) | (F.size(F.array_intersect("words", known)) > 1) & F.arrays_overlap(_grams(F.col("words"), 3), marks))
    key = ["doc_id", "doc", "line_no", "n_lines", "words"]
    paragraphs = stretches.groupBy(*key).agg(F.count("*").alias("copies"))
    columns = [f"w{i}" for i in range(len(classes))]
    table = F.broadcast(spark.createDataFrame([(g, *map(float, w)) for g, w in weights.items()], ["gram", *columns]))
    grams = paragraphs.withColumn("gram", F.explode(F.array_distinct(F.concat("words", _grams(F.col("words"), 2))))).join(table, "gram")
    sums = grams.groupBy(*key, "copies").agg(*[F.sum(c).alias(c) for c in columns])
    logits = F.array(*[F.col(c) + float(b) for c, b in zip(columns, bias, strict=True)])
    scored = sums.select(*key, "copies", logits.alias("z")).withColumn("top", F.array_max("z")).withColumn("p", F.transform("z", lambda z: F.exp(z - F.col("top"))))
    scored = scored.withColumn("total", F.aggregate("p", F.lit(0.0), lambda a, x: a + x)).withColumn("class", (F.array_position("z", F.col("top")) - 1).cast("int"))
    # Not ordinary prose: hold the rest against the templates.
    marked = scored.filter(F.col("class") < len(classes) - 1)
    named = F.element_at(F.array(*map(F.lit, classes)), F.col("class") + 1)
    marked = marked.select(*key, "copies", named.alias("best_family"), (1 / F.col("total")).alias("probability"))
    shapes_table = F.broadcast(spark.createDataFrame(shapes, "best_family string, template string, gram string, size int"))
    unit = ["doc_id", "doc", "line_no", "n_lines"]
    about = ["copies", "best_family", "probability"]
    hits = marked.select(*unit, *about, F.explode_outer(F.array_distinct(_grams(F.col("words"), 3))).alias("gram")).join(shapes_table, ["best_family", "gram"], "left")
    share = hits.groupBy(*unit, *about, "template").agg((F.count("template") / F.first("size")).alias("overlap"))
    found = share.groupBy(*unit, *about).agg(F.max(F.when(F.col("template").isNotNull(), F.struct("overlap", "template"))).alias("best"))
    found = found.withColumn("sure", (F.col("probability") >= least) & (F.coalesce("best.overlap", F.lit(0.0)) >= confirm)).filter("n_lines = 1 or sure")
    # Stretches: the shortest that confirm a family, the first of those that overlap; unknown lines only outside of them.
    doc = ["doc_id", "doc"]
    found = found.withColumn("stop", F.col("line_no") + F.col("n_lines") - 1).withColumn("template", F.col("best.template"))
    sure_stop, later = F.when(F.col("sure"), F.col("stop")), Window.partitionBy(*doc, "best_family").orderBy("line_no")
    covered = F.max(F.when(F.col("n_lines") > 1, F.col("stop"))).over(Window.partitionBy(*doc).orderBy("line_no").rangeBetween(Window.unboundedPreceding, 0))
    found = found.withColumn("covered", F.coalesce(covered, F.lit(-1)) >= F.col("line_no"))
    found = found.withColumn("here", F.min(sure_stop).over(later.rangeBetween(0, 0))).withColumn("within", F.min(sure_stop).over(later.rangeBetween(1, Window.unboundedFollowing)))
    found = found.filter((F.col("n_lines") == 1) & (F.col("sure") | ~F.col("covered")) | (F.col("n_lines") > 1) & (F.col("here") == F.col("stop")) & (F.coalesce("within", F.lit(2**31 - 1)) > F.col("stop")))
    before = F.lag("stop").over(Window.partitionBy(*doc, "best_family", "template", F.col("n_lines") > 1).orderBy("line_no"))
    found = found.withColumn("before", F.coalesce(before, F.lit(-1))).filter((F.col("n_lines") == 1) | (F.col("before") < F.col("line_no")))
    out = found.withColumn("family", F.when(F.col("sure"), F.col("best_family")).otherwise("unknown")).withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return out.select("doc_id", "line_no", "family", "best_family", F.round("probability", 6).alias("probability"), "template", F.round(F.coalesce("best.overlap", F.lit(0.0)), 6).alias("overlap"))
