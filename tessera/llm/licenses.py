"""License scans: TF-IDF cosine to templates, then inheritance along directories.

A file's units are its lines, its paragraphs and its whole text.  Units and
templates are sparse TF-IDF vectors of words; every word's document frequency is
counted over all files.  The templates' words go to the executors, which find
each unit's dot products; the frequencies of its other words, which only its norm
needs, are joined to the units.  Units are left out only where that loses nothing:
a cosine is at most the norm of the part of a template's vector whose words the
unit has (and that at most the sum of each word's largest share in any template), and at most what it would be if all files had the unit's other words.
A file none of whose units can reach a threshold has ``own_score`` 0.
A file's own license is the template
of the unit with the largest cosine, if that reaches ``threshold``.  Files that
are named as license files, or whose whole text reaches ``whole``, speak for
their directory: a file without a license of its own takes that of the nearest
directory above it (its own included) that has one.

Inheritance joins the directories above each file with one row per licensed
directory, so a directory that holds a third of all files costs rows in
proportion to them and no group of files is ever gathered.

Cases: null and empty texts have no license of their own and may inherit; a
null path is a file in no directory; several license files in a directory: the
best score speaks, ties by license name and then path; repeated rows are each
reported; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Set

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .storage import durable, release

# Public license texts, their titles, and statements by which files name a license.
_BSD_GRANT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights '
    "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
)
_MIT_REST = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
)
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    "MIT": ("Released under the MIT License", "The MIT License (MIT). Permission is hereby granted, free of charge, to any person obtaining a copy of this software", _MIT_GRANT, _MIT_GRANT + _MIT_REST),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3", "GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2", "GNU General Public License as published by the Free Software Foundation, either version 2 of the License", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    "LGPL-2.1": ("Licensed under the GNU Lesser General Public License, version 2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License", _BSD_GRANT + _BSD_NAMES + _BSD_DISCLAIMER),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License", _BSD_GRANT + _BSD_DISCLAIMER),
    "ISC": ("Released under the ISC License", _ISC),
    "Unlicense": (_UNLICENSE,),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Mozilla Public License Version 2.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "Licensed under the Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0", "Licensed under the Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", "Licensed under the Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright; CC0 1.0 Universal Public Domain Dedication",),
}
LICENSE_NAME = r"(?i)(^|/)(un)?licen[sc]e[^/]*$|(^|/)copying[^/]*$"
THRESHOLD, WHOLE = 0.6, 0.95
WORD = re.compile(r"[0-9]+(?:\.[0-9]+)?|[^\W\d_]+")


def tokens(text: str) -> list[str]:
    return WORD.findall(text.lower())


#: Words whose counts a task holds at once.
WORDS_HELD = 200_000
UNITS = "array<struct<whole:boolean,dot:double,name:string,known:double,words:array<struct<word:string,n:int>>>>"


class Model:
    """Templates as vectors, and the idf of their words; ``least`` is the cosine of interest."""

    def __init__(self, templates: dict[str, tuple[str, ...]], df: dict[str, int], files: int, least: float) -> None:
        self.idf = {w: math.log((1 + files) / (1 + n)) + 1 for w, n in df.items()}
        self.vectors = [(name, self.vector(Counter(tokens(x)))) for name, texts in templates.items() for x in texts]
        self.least = max(least, 0.0) ** 2 * (1 - 1e-9)
        self.most: dict[str, float] = {}  # what a word adds at most to the square of any cosine
        for _, vector in self.vectors:
            for w, x in vector.items():
                self.most[w] = max(self.most.get(w, 0.0), x * x)

    def vector(self, count: Counter) -> dict[str, float]:
        raw = {w: n * self.idf[w] for w, n in count.items()}
        norm = math.sqrt(math.fsum(x * x for x in raw.values())) or 1.0
        return {w: x / norm for w, x in raw.items()}

    def reach(self, words: Set[str]) -> bool:
        """Whether a unit of some of these words, all of them the templates', can be near enough to a template."""
        if sum(self.most[w] for w in words) < self.least:
            return False
        return any(sum(x * x for w, x in vector.items() if w in words) >= self.least for _, vector in self.vectors)

    def units(self, text: str) -> list[dict]:
        """The units that may be near enough with their best template: its dot product, the square of the norm over the templates' words, all others."""
        if not self.reach(self.idf.keys() & tokens(text)):
            return []
        parts = [(True, text)]
        if "\n" in text:
            parts += [(False, x) for x in [*text.split("\n"), *(x for x in re.split(r"\n[ \t]*\n", text) if "\n" in x)]]
        found = []
        for whole, part in parts:
            count = Counter(tokens(part))
            own = {w: count.pop(w) * self.idf[w] for w in self.idf.keys() & count.keys()}
            if own and self.reach(own.keys()):
                dot, name = min(((math.fsum(x * own.get(w, 0.0) for w, x in vector.items()), name) for name, vector in self.vectors), key=lambda f: (-f[0], f[1]))
                known = math.fsum(x * x for x in own.values())
                if dot * dot >= self.least * (known + sum(n * n for n in count.values())):  # the least idf is 1
                    found.append({"whole": whole, "dot": dot, "name": name, "known": known, "words": [{"word": w, "n": n} for w, n in count.items()]})
        return found


def _frequencies(files: DataFrame) -> DataFrame:
    """(word, n): in how many files each word is; the word '' counts the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(count: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["word", "n"])

        count = Counter()
        for batch in batches:
            for text in batch.column(0):
                count[""] += 1
                count.update(set(tokens(text.as_py() or "")))
                if len(count) > WORDS_HELD:
                    yield rows(count)
                    count = Counter()
        yield rows(count)

    return files.select(F.col("text").cast("string")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _scores(units: DataFrame, frequencies: DataFrame, files: int) -> DataFrame:
    """(id, best, whole): each file's best (-score, name) and the score of its whole text."""
    unit = units.select("id", F.posexplode("units").alias("k", "u")).select("id", "k", "u.*")
    word = unit.select("id", "k", F.explode("words").alias("w")).select("id", "k", "w.*")
    needed = frequencies.join(word.select("word").distinct(), "word").select("word", (F.log((1 + files) / (1 + F.col("n"))) + 1).alias("idf"))
    squares = word.join(needed, "word").groupBy("id", "k").agg(F.array_sort(F.collect_list(F.pow(F.col("n") * F.col("idf"), 2.0))).alias("squares"))
    rest = F.coalesce(F.aggregate("squares", F.lit(0.0), lambda a, x: a + x), F.lit(0.0))  # in one order, so that equal units tie
    rated = unit.join(squares, ["id", "k"], "left").withColumn("score", F.least(F.lit(1.0), F.col("dot") / F.sqrt(F.col("known") + rest)))
    return rated.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("rank"), "name")).alias("best"), F.max(F.when(F.col("whole"), F.col("score"))).alias("whole"))


def scan(files: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, threshold: float = THRESHOLD, whole: float = WHOLE) -> DataFrame:
    """(key, path, own_license, own_score, speaks) of ``files(key, path, text)``.

    ``speaks`` says whether the file's license holds for its directory.
    """
    templates = templates or TEMPLATES
    vocabulary = {w for texts in templates.values() for x in texts for w in tokens(x)}
    frequencies = durable(_frequencies(files), "license-words")
    df = {r["word"]: r["n"] for r in frequencies.where(F.col("word").isin("", *vocabulary)).collect()}
    total = df.get("", 0)
    model = Model(templates, {w: df.get(w, 0) for w in vocabulary}, total, min(threshold, whole))
    kind = T._parse_datatype_string(f"units {UNITS}").fields[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_type(kind.dataType)
        for batch in batches:
            found = pa.array([model.units(text.as_py() or "") for text in batch.column(3)], arrow)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), found], ["key", "path", "named", "units"])

    rows = files.select(F.col("key"), F.col("path").cast("string").alias("path"), F.coalesce(F.col("path").rlike(LICENSE_NAME), F.lit(False)).alias("named"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), *T._parse_datatype_string("path string, named boolean").fields, kind])
    units = durable(rows.mapInArrow(run, schema).withColumn("id", F.monotonically_increasing_id()), "license-units")
    scored = units.join(_scores(units, frequencies, total), "id", "left")
    score = F.coalesce(-F.col("best.rank"), F.lit(0.0))
    speaks = (F.coalesce(F.col("whole"), F.lit(0.0)) >= whole) | (F.col("named") & (score >= threshold))
    found = durable(scored.select("key", "path", F.when(score >= threshold, F.col("best.name")).alias("own_license"), score.alias("own_score"), speaks.alias("speaks")), "license-scan")
    release(frequencies, units)
    return found


def _directories(path):
    """All directories above a path, the nearest last; '' is the root."""
    parts = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def inherit(scanned: DataFrame) -> DataFrame:
    """``scanned`` with ``license`` and ``license_from``: the own or the inherited one.

    ``license_from`` is the path of the license file, null for an own license.
    """
    directory = F.element_at(_directories(F.col("path")), -1)
    order = F.struct((-F.col("own_score")).alias("rank"), F.col("own_license").alias("license"), F.col("path").alias("path"))
    spoken = scanned.where("speaks and path is not null").groupBy(directory.alias("dir")).agg(F.min(order).alias("found"))
    lacking = scanned.where("own_license is null and path is not null").select("path").distinct().select("path", F.explode(_directories(F.col("path"))).alias("dir"))
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))
    nearest = lacking.join(spoken, "dir").groupBy("path").agg(F.max_by("found", depth).alias("found"))
    out = scanned.join(nearest, "path", "left")
    return out.select("key", "path", "own_license", "own_score", F.coalesce("own_license", "found.license").alias("license"), F.col("found.path").alias("license_from"))
