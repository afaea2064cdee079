"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

DataFrame and SQL functions only. A file's segments are its sentences, lines, paragraphs of several lines, and its
whole text. Inverse document frequencies are those of all files. A segment that reaches the threshold has to hold one
of its template's key words: the other words' part of the template's vector is shorter than the threshold. So only
segments with a key word are scored, each different one once. A sentence, line or paragraph that is close enough to a
template is a header and licenses its file. A whole text that is close enough to a licence's full text, or any file of a licence
file's name with a header, is a licence file, which also licenses the other files of its directory and of those below
that have no nearer licence file; a file that holds no more than a notice licenses itself alone.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import drop, save

# Identifiers and short notices in the usual wordings of public licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("MIT", "MIT License"),
    ("MIT", "MIT License Copyright (c) Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", "Copyright (c) All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
# Identifiers of public licences with the names that notices give them.
_NAMES = (
    ("MIT", "MIT License"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("ISC", "ISC License"),
    ("MPL-2.0", "Mozilla Public License, Version 2.0"),
    ("EPL-2.0", "Eclipse Public License, Version 2.0"),
    ("Unlicense", "Unlicense"),
    ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-2.0-or-later", "GNU General Public License, version 2 or later"),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("GPL-3.0-or-later", "GNU General Public License, version 3 or later"),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"),
    ("LGPL-2.1-or-later", "GNU Lesser General Public License, version 2.1 or later"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("LGPL-3.0-or-later", "GNU Lesser General Public License, version 3 or later"),
    ("AGPL-3.0", "GNU Affero General Public License, version 3"),
    ("AGPL-3.0-or-later", "GNU Affero General Public License, version 3 or later"),
)
_NOTICES = ("Licensed under the {}.", "Released under the {}.", "This file is distributed under the {}.", "This project is licensed under the {} - see the LICENSE.md file for details.", "This program is licensed under the terms of the {}.")
_GNU = ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")
#: Licences that files are offered under one or the other of, either way round.
_EITHER = (("MIT", "Apache-2.0"), ("Apache-2.0", "GPL-2.0"), ("MIT", "GPL-2.0"), ("MIT", "GPL-3.0"), ("MIT", "BSD-3-Clause"))


def _ruled() -> tuple[tuple[str, str], ...]:
    """Every name in every notice, and the identifier lines."""
    notices = [(i, n.format(name)) for n in _NOTICES for i, name in _NAMES]
    marks = [(i, f"SPDX-License-Identifier: {i}") for i, _ in _NAMES] + [(i, f"SPDX-License-Identifier: {i}-only") for i in _GNU]
    either = [(f"{a} OR {b}", f"SPDX-License-Identifier: {a} OR {b}") for a, b in _EITHER]
    return tuple(dict.fromkeys(notices + marks + either))


TEMPLATES = tuple(dict.fromkeys(TEMPLATES + _ruled()))
#: A template of so many words is a full text, not a notice.
_FULL_WORDS = 100
_WORD = "[a-z0-9]+"


@dataclass(frozen=True)
class LicenseScan:
    """threshold: least cosine of a header or licence file; names: pattern of a licence file's base name, whose
    segments count for its directory as a whole text would."""

    threshold: float = 0.75
    names: str = r"(?i)^(licen[cs]e|copying|unlicense|notice)([.-].*)?$"


def _words(column: Column | str) -> Column:
    return F.regexp_extract_all(column, F.lit(_WORD), F.lit(0))


def template_bags() -> list[Counter]:
    return [Counter(re.findall(_WORD, t.lower())) for _, t in TEMPLATES]


def template_vectors(idf: dict[str, float]) -> list[dict[str, float]]:
    """Unit vectors of the templates."""
    unit = []
    for bag in template_bags():
        v = {w: n * idf[w] for w, n in bag.items()}
        length = math.sqrt(sum(x * x for x in v.values()))
        unit.append({w: x / length for w, x in v.items()})
    return unit


def key_words(unit: list[dict[str, float]], threshold: float) -> set[str]:
    """Words of which any segment that reaches the threshold holds one: of each template, all but the lightest words
    whose part of the vector is shorter than the threshold."""
    out = set()
    for v in unit:
        rest = 0.0
        for word, x in sorted(v.items(), key=lambda wx: (wx[1], wx[0])):
            rest += x * x
            if math.sqrt(rest) >= threshold - 1e-6:
                out.add(word)
    return out


def _idf(n: Column, files: int) -> Column:
    return F.log(1 + files / n)


def _segments(files: DataFrame, keys: set[str]) -> DataFrame:
    """(path, whole, segment): lower-case segments with a key word, whole being true for a file's whole text."""
    wanted = F.array(*(F.lit(k) for k in sorted(keys)))
    rows = files.select("path", F.lower(F.coalesce("text", F.lit(""))).alias("text")).where(F.arrays_overlap(_words("text"), wanted))
    lines = F.split("text", "\n")
    sentences = F.filter(F.flatten(F.transform(lines, lambda x: F.split(x, r"(?<=[.;!?])\s+(?=\S)"))), lambda x: x != "")
    paragraphs = F.filter(F.split("text", "\n[ \t\r]*\n"), lambda x: F.contains(x, F.lit("\n")))
    parts = rows.select("path", F.lit(False).alias("whole"), F.explode(F.array_distinct(F.concat(lines, sentences, paragraphs))).alias("segment"))
    return parts.unionByName(rows.select("path", F.lit(True).alias("whole"), F.col("text").alias("segment"))).where(F.arrays_overlap(_words("segment"), wanted))


def _scored(keys: DataFrame, frequency: DataFrame, total: int, idf: dict[str, float], p: LicenseScan) -> DataFrame:
    """keys(key, segment), a row per different segment: (key, license, full, score) of its best template, where close enough; full: whether that is a licence's full text.

    frequency(word, n): files that hold a word. Ties go to the template named first.
    """
    spark = keys.sparkSession
    unit = template_vectors(idf)
    templates = spark.createDataFrame([(w, i, x) for i, v in enumerate(unit) for w, x in v.items()], "word string, template int, unit double")
    words = keys.select("key", F.explode(_words("segment")).alias("word")).groupBy("key", "word").count()
    counted = words.join(frequency, "word").select("key", "word", (F.col("count") * _idf(F.col("n"), total)).alias("x"))
    length = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("key")))
    dots = counted.withColumn("length", length).join(F.broadcast(templates), "word")  # a row per word of a template
    dots = dots.groupBy("key", "template").agg((F.sum(F.col("x") * F.col("unit")) / F.max("length")).alias("cosine"))
    cosine = dots.withColumn("score", F.round("cosine", 9)).where(F.col("score") >= p.threshold)
    best = cosine.groupBy("key").agg(F.max(F.struct("score", -F.col("template"))).alias("best"))
    names = F.array(*(F.lit(name) for name, _ in TEMPLATES))
    full = F.array(*(F.lit(sum(bag.values()) >= _FULL_WORDS) for bag in template_bags()))
    at = 1 - F.col("best.col2")
    return best.select("key", F.element_at(names, at).alias("license"), F.element_at(full, at).alias("full"), F.col("best.score").alias("score"))


def _parent(path: Column) -> Column:
    """The directory of a path, without a slash at its end; the root is the empty text."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def _ancestors(directory: Column) -> Column:
    """The directory itself and all above it, nearest first, the root last."""
    parts = F.split(directory, "/")
    return F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def scan(files: DataFrame, p: LicenseScan = LicenseScan()) -> DataFrame:
    """files(path, text, ...): (path, license, score, origin, source), a row per different path.

    origin is header, file or inherited, and source the path that the licence was read from; all null without a
    licence. A file's best segment counts, whole texts close to a full text before all others, ties to the licence named first in the
    alphabet; of several licence files of a directory the best, ties to the first path. Null paths have no
    result; null and empty texts have no licence of their own; rows that share a path are one file. Other
    columns are ignored. The root directory licenses all paths.
    """
    named = files.where("path is not null")
    found = named.select(F.explode(F.array_distinct(_words(F.lower("text")))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    frequency = save(found, "word-files")
    known = {w for bag in template_bags() for w in bag}
    total = max(1, named.count())
    counts = {r.word: r.n for r in frequency.where(F.col("word").isin(*known)).collect()}  # words of the templates
    idf = {w: math.log(1 + total / counts.get(w, 1)) for w in known}
    segments = save(_segments(named, key_words(template_vectors(idf), p.threshold)).withColumn("key", F.xxhash64("segment")), "segments")
    scored = _scored(segments.groupBy("key").agg(F.first("segment").alias("segment")), frequency, total, idf, p)
    hits = segments.select("path", "whole", "key").join(scored, "key").withColumn("whole", F.col("whole") & F.col("full"))
    own = hits.groupBy("path").agg(F.max(F.struct("whole", "score", "license")).alias("best"))
    base = F.regexp_extract("path", "[^/]*$", 0)
    own = save(own.select("path", "best.license", "best.score", (F.col("best.whole") | F.rlike(base, F.lit(p.names))).alias("whole")), "licensed")
    drop(segments)
    drop(frequency)
    declared = own.where("whole").groupBy(_parent(F.col("path")).alias("directory")).agg(F.max_by(F.struct("license", "score", F.col("path").alias("source")), F.struct("score", _reversed("path"))).alias("by"))
    directories = named.select(_parent(F.col("path")).alias("dir")).distinct()
    above = directories.select("dir", F.posexplode(_ancestors(F.col("dir"))).alias("far", "directory"))
    nearest = above.join(declared, "directory").groupBy("dir").agg(F.min_by("by", "far").alias("by"))
    paths = named.select("path").distinct().join(own, "path", "left").withColumn("dir", F.when(F.col("license").isNull(), _parent(F.col("path"))))
    out = paths.join(nearest, "dir", "left")
    inherited = F.col("license").isNull() & F.col("by").isNotNull()
    return out.select(
        "path",
        F.coalesce("license", "by.license").alias("license"),
        F.coalesce("score", "by.score").alias("score"),
        F.when(inherited, "inherited").when(F.col("whole"), "file").when(F.col("license").isNotNull(), "header").alias("origin"),
        F.when(inherited, F.col("by.source")).when(F.col("license").isNotNull(), F.col("path")).alias("source"),
    )


def _reversed(column: str) -> Column:
    """Orders texts against the alphabet: the code points' complements."""
    return F.transform(F.split(column, ""), lambda c: -F.ascii(c))
