"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Templates are notices (headers and titles) and whole licence texts. Every line of a text that holds a word of the
trade (license, copyright, rights ...) is compared with each notice by the cosine of their TF-IDF vectors; inverse document
frequencies come from all documents, counted for the templates' words only. A notice wrapped over lines, or amid other
words, is found by windows of each notice's own length that slide, word by word, over the joined lines around any
HINT; short notices must then be matched nearly in full (SHORT, NEARLY). A match counts only if both sides agree on the words
that tell licences apart (KEYS: gpl, affero, sa, version numbers ...), so that a licence without a template is not
taken for its neighbour. Texts with a HINT are also compared as a whole with the whole licence texts; the best counts from
WHOLE on, if it leads any other licence's by MARGIN. SPDX tags are read exactly, whatever they name.

A whole licence decides first, then a tag, then the best notice above LEAST_SIMILARITY, wherever it stands; in a licence file (by its name, LICENSE_FILE)
the first notice, as licences speak of others further down. "All rights reserved", which stands in licensed files as well, decides
only without another one. Two licences that match equally well leave the smaller name.

Licence files, and files that are a whole licence, speak for their directory, and so does a notice in a file's leading block (after
nothing but lines of comment, of the trade, or without words) that refers to the tree's licence file; a mere header or tag speaks for its own file alone. Of a directory's licenses the most frequent
counts. A file without a license of its own gets that of its nearest ancestor directory that has one,
by joins on directory paths: directories are resolved first, each against its own ancestors, so that a directory of
any number of files is one row there, and files then join their own directory. Both joins are salted, as all directories share
the root and many files may share a directory.

Further templates are a parameter; ``read_templates`` makes them of a folder of licence texts.

Defined cases: a null or empty text has no license of its own; a null path has no directory and inherits nothing; texts of any length are
read whole; ties between templates go to the smaller name, between a directory's licenses to the smaller name; repeated rows are each
judged, and counted; empty tables give no rows; only the path, id and text columns are read, so other columns' names do no harm.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.llm.common import small_batches, stored

LEAST_SIMILARITY = 0.55
#: A longer line is compared in pieces of so many words, half overlapping; nothing of it is left out.
PIECE = 60
#: Templates of fewer words fill a window by chance: from there on they need this similarity.
SHORT, NEARLY = 8, 0.95
#: A text is a licence from this similarity to a whole one on, if it leads other licences' by the margin.
WHOLE, MARGIN = 0.9, 0.005
#: Templates of more words are whole licences.
NOTICE_WORDS = 90
SALTS = 16

#: The notices that name a licence, by name.
_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THREE = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
TEMPLATES = {
    "0BSD": [_ISC + "." + _ISC_END],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', "Apache License Version 2.0, January 2004"],
    "Artistic-2.0": ["The Artistic License 2.0", "Licensed under the Artistic License 2.0."],
    "BSD-2-Clause": ["BSD 2-Clause License", _BSD_START + _BSD_TWO + _BSD_END],
    "BSD-3-Clause": ["BSD 3-Clause License", "Licensed under the 3-Clause BSD License.", "Use of this source code is governed by a BSD-style license.", _BSD_START, _BSD_START + _BSD_TWO + _BSD_THREE + _BSD_END],
    "BSL-1.0": ["Boost Software License - Version 1.0", "Distributed under the Boost Software License, Version 1.0."],
    "CC0-1.0": ["This work is dedicated to the public domain under CC0 1.0.", "CC0 1.0 Universal", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0."],
    "CDDL-1.0": ["Common Development and Distribution License (CDDL) Version 1.0"],
    "EPL-1.0": ["Eclipse Public License v1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0"],
    "EPL-2.0": ["Eclipse Public License v2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0"],
    "EUPL-1.2": ["European Union Public Licence v. 1.2", "Licensed under the EUPL, Version 1.2"],
    "ISC": ["ISC License", "Licensed under the ISC License.", _ISC + ", provided that the above copyright notice and this permission notice appear in all copies.", _ISC + ", provided that the above copyright notice and this permission notice appear in all copies." + _ISC_END],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "The MIT License (MIT)", _MIT, _MIT + ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY],
    "Artistic-1.0": ["The \"Artistic License\" Preamble"],
    "GFDL-1.2": ["GNU Free Documentation License Version 1.2"],
    "GFDL-1.3": ["GNU Free Documentation License Version 1.3"],
    "MPL-1.1": ["Mozilla Public License Version 1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0"],
    "Proprietary": ["All rights reserved.", "Copyright. All rights reserved.", "Proprietary and confidential. Unauthorized copying is prohibited."],
    "Unlicense": [_UNLICENSE, _UNLICENSE + " In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _WARRANTY],
    "Zlib": ["Licensed under the zlib License.", _ZLIB],
}
#: Families of licences that differ by version or by terms.
for _name, _long, _versions in (("GPL", "GNU General Public License", ("1.0", "2.0", "3.0")), ("LGPL", "GNU Lesser General Public License", ("2.1", "3.0")), ("LGPL", "GNU Library General Public License", ("2.0",)), ("AGPL", "GNU Affero General Public License", ("3.0",))):
    for _v in _versions:
        _n = _v.removesuffix(".0")
        _start = f"you can redistribute it and/or modify it under the terms of the {_long} as published by the Free Software Foundation"
        TEMPLATES[f"{_name}-{_v}"] = [f"This work is licensed under the {_long}, version {_n}.", f"{_long} Version {_n}", f"Licensed under the {_name} version {_n}.", f"Released under the {_name} {_n} license.", f"This program is free software: {_start}, either version {_n} of the License, or any later version.", f"This library is free software; {_start}; either version {_n} of the License, or (at your option) any later version.", f"This program is free software; {_start}; version {_n} of the License."]
for _short, _terms in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")):
    TEMPLATES[f"CC-{_short}-4.0"] = [f"Licensed under CC {_short} 4.0.", f"This work is licensed under a Creative Commons {_terms} 4.0 International License.", f"Creative Commons {_terms} 4.0 International"]
#: Notices that licensed files hold as well.
RESERVED = frozenset(("All rights reserved.", "Copyright. All rights reserved."))
#: Words that tell licences apart; a notice must hold its template's, and no further one.
KEYS = frozenset("affero agpl apache artistic attribution boost bsd cc cc0 cddl clause creative eclipse epl eupl european general gnu gpl isc lesser lgpl library mit mozilla mpl nc nd noderivatives noncommercial sa sharealike some unlicense zlib".split())
#: Words that only the template's side must find.
NEEDED = frozenset("all commons copyright public reserved rights".split())
#: Names of files that hold a directory's licence.
LICENSE_FILE = re.compile(r"(?:^|/)(?:un)?(?:licen[cs]es?|copying(?:\.lesser)?|copyright)(?:[-_.][^/]*)?$", re.I)
#: How a notice refers to the licence file of its tree.
_REFERS = re.compile(r"\b(?:LICEN[CS]E|COPYING)(?:\.\w+)?\s+file\b")
#: What follows a tag is an expression of licence names.
_SPDX = re.compile(r"SPDX-License-Identifier:\s*(\(?[A-Za-z0-9][A-Za-z0-9.+-]*\)?(?:\s+(?:OR|AND|WITH)\s+\(?[A-Za-z0-9][A-Za-z0-9.+-]*\)?)*)")
#: Lines with one of these are compared on their own.
TRADE = re.compile(r"licen[sc]|copyright|rights\s+reserved|spdx|public\s+domain|redistribution|permission\s+is\s+hereby|proprietary|creative\s+commons|cc0|©", re.I)
#: What every such line holds in lower case; found faster than the pattern.
HINTS = ("licen", "copyright", "rights", "spdx", "public", "redistribution", "permission", "proprietary", "creative", "cc0", "©")
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
_VERSION = re.compile(r"([a-z]*?)v?([0-9]+(?:\.[0-9]+)*)")
#: What a line of comment begins with.
_COMMENT = re.compile(r"\s*(?:/\*|\*|//|#|--|;|%|<!--|\"\"\"|''')")
_SMALL = re.compile(r"[01]?[0-9](?:\.[0-9]+)*")
_HINT = re.compile("|".join(HINTS))


@cache
def _plain(word: str) -> tuple[str, ...]:
    """Versions stand alone, without their v and an ending .0."""
    found = _VERSION.fullmatch(word)
    if found is None or word in KEYS or (found[1] and found[1] not in KEYS):
        return (word,)
    return (*filter(None, (found[1],)), found[2].removesuffix(".0"))


def words_of(line: str) -> list[str]:
    out: list[str] = []
    for w in _WORD.findall(line.lower()):
        if w[-1].isdigit() and len(w) < 20:
            out += _plain(w)
        else:
            out.append(w)
    return out


def keys_of(words: Iterable[str]) -> tuple[frozenset[str], frozenset[str]]:
    """The words that tell licences apart, and those that a template needs besides; numbers below 20 may be versions."""
    every = frozenset(words)
    telling = frozenset(w for w in every if w in KEYS or _SMALL.fullmatch(w))
    return telling, telling | (every & NEEDED)


class Templates:
    """Unit TF-IDF vectors of the templates, as lists of (template, weight) per word."""

    def __init__(self, df: dict[str, int], n_docs: int, templates: dict[str, list[str]] = TEMPLATES):
        self.idf = {w: math.log((1 + n_docs) / (1 + k)) + 1 for w, k in df.items()}
        self.rare = math.log(1 + n_docs) + 1
        self.names: list[str] = []
        self.yields: list[bool] = []
        self.keys: list[tuple[frozenset[str], frozenset[str]]] = []
        #: Notices by their number of words, each as its unit vector; and whole licences.
        self.sizes: dict[int, list[tuple[int, dict[str, float]]]] = {}
        self.index: dict[str, list[tuple[int, float]]] = {}
        self.whole: list[tuple[str, dict[str, float]]] = []
        for name in sorted(templates):
            for notice in templates[name]:
                words = words_of(notice)
                unit = self._unit(words)
                if len(words) > NOTICE_WORDS:
                    self.whole.append((name, unit))
                    continue
                for word, weight in unit.items():
                    self.index.setdefault(word, []).append((len(self.names), weight))
                self.sizes.setdefault(len(words), []).append((len(self.names), unit))
                self.names.append(name)
                self.yields.append(notice in RESERVED)
                self.keys.append(keys_of(words))

    def _unit(self, words: list[str]) -> dict[str, float]:
        weights = {w: (1 + math.log(k)) * self.idf.get(w, self.rare) for w, k in Counter(words).items()}
        norm = math.sqrt(sum(x * x for x in weights.values()))
        return {w: x / norm for w, x in weights.items()} if norm else {}

    def _agree(self, k: int, words: list[str]) -> bool:
        telling, needed = self.keys[k]
        return needed.issubset(words) and keys_of(words)[0] <= telling

    def of_line(self, line: str) -> Iterator[tuple[float, int]]:
        """(cosine, template) of each notice that the line, or a piece of it, is like."""
        words = words_of(line)
        for at in range(0, max(1, len(words) - PIECE // 2), PIECE // 2):
            piece = words[at : at + PIECE]
            scores: dict[int, float] = {}
            for word, x in self._unit(piece).items():
                for k, y in self.index.get(word, ()):
                    scores[k] = scores.get(k, 0.0) + x * y
            for k, s in scores.items():
                if s >= LEAST_SIMILARITY and self._agree(k, piece):
                    yield round(s, 9), k

    def of_windows(self, words: list[str]) -> Iterator[tuple[float, int, int]]:
        """(cosine, template, place) of the windows of each notice's length that are similar enough."""
        idf = [self.idf.get(w, self.rare) for w in words]
        present = frozenset(words)
        for size, every in self.sizes.items():
            some = [(k, unit) for k, unit in every if self.keys[k][1] <= present]  # no window can agree with the others
            if not some:
                continue
            least = LEAST_SIMILARITY if size >= SHORT else NEARLY
            counts: dict[str, int] = {}
            norm2, dots = 0.0, [0.0] * len(some)
            for at in range(len(words)):
                for place, by in ((at, 1), (at - size, -1)):
                    if place >= 0:
                        word, n = words[place], counts.get(words[place], 0)
                        old, new = ((1 + math.log(x)) * idf[place] if x else 0.0 for x in (n, n + by))
                        counts[word] = n + by
                        norm2 += new * new - old * old
                        for j, (_, unit) in enumerate(some):
                            if word in unit:
                                dots[j] += (new - old) * unit[word]
                if at >= size - 1:
                    for j, (k, _) in enumerate(some):
                        if dots[j] > 0 and dots[j] * dots[j] >= least * least * norm2 * (1 - 1e-9) and self._agree(k, words[at - size + 1 : at + 1]):
                            yield round(dots[j] / math.sqrt(norm2), 9), k, at - size + 1

    def of_whole(self, words: list[str]) -> tuple[str, float] | None:
        """The licence that the words are, as a whole."""
        unit, best = self._unit(words), {}
        for name, other in self.whole:
            best[name] = max(best.get(name, 0.0), round(sum(x * unit.get(w, 0.0) for w, x in other.items()), 9))
        (s, name), (second, _) = sorted(((-s, n) for n, s in best.items()), key=lambda x: x)[:2] if len(best) > 1 else [next(((-s, n) for n, s in best.items()), (0.0, "")), (0.0, "")]
        return (name, -s) if -s >= WHOLE and second - s >= MARGIN else None

    def of_text(self, text: str | None, path: str | None = None) -> tuple[str | None, float, bool]:
        """The license, its similarity, and whether the file speaks for its directory."""
        low = (text or "").lower()
        if not any(hint in low for hint in HINTS):
            return None, 0.0, False
        named = bool(LICENSE_FILE.search(path or ""))
        lines = (text or "").lstrip().splitlines()
        words: list[str] = []
        line_of: list[int] = []
        hints: list[int] = []
        leading = len(lines)  # lines before this one, and it too, are the place of a leading notice
        for k, line in enumerate(lines):
            own = words_of(line)
            if k < leading and own and not _COMMENT.match(line) and not TRADE.search(line):
                leading = k
            if _HINT.search(line.lower()):
                hints += [len(words) + j for j, w in enumerate(own) if _HINT.search(w)] or [len(words)]
            words += own
            line_of += [k] * len(own)
        if found := self.of_whole(words):
            return *found, True
        if tag := _SPDX.search(text or ""):
            return tag[1], 1.0, named
        best: tuple | None = None

        def offer(s: float, k: int, line: int) -> None:
            nonlocal best
            mine = (self.yields[k], line if named else 0, -s, self.names[k], line > leading)
            if best is None or mine < best:
                best = mine

        for k, line in enumerate(lines):
            if TRADE.search(line):
                for s, template in self.of_line(line):
                    offer(s, template, k)
        reach = max(self.sizes, default=0)
        done = 0
        for n, hint in enumerate(hints):  # neighbouring hints share a stretch of words
            if n + 1 == len(hints) or hints[n + 1] - hint > 2 * reach:
                low_end, high_end = max(0, hints[done] - reach), hint + reach
                for s, template, at in self.of_windows(words[low_end:high_end]):
                    offer(s, template, line_of[low_end + at])
                done = n + 1
        if best is None:
            return None, 0.0, False
        return best[3], -best[2], named or (not best[4] and bool(_REFERS.search("\n".join(lines[: leading + 1]))))


def read_templates(spark: SparkSession, folder: str, templates: dict[str, list[str]] = TEMPLATES) -> dict[str, list[str]]:
    """The templates with those of a folder that holds one licence text per file, named by its licence."""
    more = {r["path"].rsplit("/", 1)[-1].removesuffix(".txt"): r["content"].decode("utf-8", "replace") for r in spark.read.format("binaryFile").load(folder).select("path", "content").collect()}
    return {name: [*templates.get(name, []), *([more[name]] if name in more else [])] for name in {*templates, *more}}


def document_frequencies(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES) -> tuple[dict[str, int], int]:
    """In how many of all documents each word of the templates occurs, and the number of documents."""
    vocabulary = frozenset(w for notices in templates.values() for n in notices for w in words_of(n))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(vocabulary.intersection(words_of(" ".join(set(_WORD.findall((text or "").lower()))))))
                seen[""] += 1
        yield pa.record_batch([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    rows = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # at most the templates' words
    counts = {r["word"]: r["n"] for r in rows}
    return counts, counts.pop("", 0)


def own_licenses(files: DataFrame, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """(file_id, path, own_license, similarity, speaks): speaks marks a licence that holds for the directory."""
    spark = files.sparkSession
    small_batches(spark)
    df, n = document_frequencies(files, templates)
    sent = spark.sparkContext.broadcast(Templates(df, n, templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sent.value.of_text(t, p) for t, p in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            names, similarity, head = zip(*found, strict=True) if found else ((), (), ())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(similarity, pa.float64()), pa.array(head, pa.bool_())], names=["file_id", "path", "own_license", "similarity", "speaks"])

    return files.select(F.col("file_id").cast("long").alias("file_id"), "path", "text").mapInArrow(run, "file_id long, path string, own_license string, similarity double, speaks boolean")


def directory_of(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).when(path.isNotNull(), F.lit(""))


def inherited(scanned: DataFrame) -> DataFrame:
    """Adds license and licensed_by (``file``, or the directory it comes from; null without any)."""
    files = scanned.withColumn("directory", directory_of(F.col("path")))
    spoken = files.where("speaks and directory is not null").groupBy("directory", "own_license").count()
    notices = spoken.groupBy("directory").agg(F.min(F.struct((-F.col("count")).alias("c"), "own_license")).alias("x")).select(F.col("directory").alias("ancestor"), F.col("x.own_license").alias("license"))
    places = files.where("directory is not null").select("directory").distinct()
    parts = F.split("directory", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int").alias("salt")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    lines = places.select("directory", F.explode(F.array_distinct(above)).alias("ancestor"), salt("directory"))
    nearest = lines.join(notices.select("*", salts), ["ancestor", "salt"]).groupBy("directory").agg(F.max(F.struct(F.length("ancestor").alias("n"), "ancestor", "license")).alias("x")).select("directory", "x.ancestor", F.col("x.license").alias("given"))
    out = files.withColumn("salt", salt("file_id")).join(nearest.select("*", salts), ["directory", "salt"], "left")
    return out.select("file_id", "path", "own_license", "similarity", F.coalesce("own_license", "given").alias("license"), F.when(F.col("own_license").isNotNull(), F.lit("file")).otherwise(F.col("ancestor")).alias("licensed_by"))


def scan(files: DataFrame, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    return inherited(stored(own_licenses(files, templates), "license-own"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files ``source/<id div 64>/<id>.txt``."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.expr("cast(doc_id div 64 as string)"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    files = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("file_id"), path.alias("path"), "text")
    return scan(files).withColumnRenamed("file_id", "doc_id")


QUERIES = {"op9_license_scan": op9_license_scan}
ORACLE_SQL: dict[str, str] = {}
