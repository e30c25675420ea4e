"""Operator 9, license scans: TF-IDF cosine of text lines and of windows to templates, then inheritance from the nearest
directory.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, as_bytes, checked_small, cut, sliced

#: A line or a window is taken for the license whose template it is most like, from this cosine on.
THRESHOLD = 0.7
#: What stands beside the notices of most licenses too: it counts only where no other license is found.
WEAK = frozenset(("proprietary",))
CHUNK = 4 << 20

#: (license, template): notices as they stand in headers, and how license files begin. Fixed values.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004. Terms and conditions for use, reproduction, and distribution."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("proprietary", "All rights reserved."),
]

#: (license, name, version) of the licenses whose headers differ in these only.
GNU = [("GPL-3.0", "General Public License", "3"), ("GPL-2.0", "General Public License", "2"), ("AGPL-3.0", "Affero General Public License", "3"), ("LGPL-3.0", "Lesser General Public License", "3"), ("LGPL-2.1", "Lesser General Public License", "2.1"), ("LGPL-2.0", "Library General Public License", "2")]
#: (license, template): file headers of several lines and the texts of licenses or their first paragraphs. Compared to windows only.
BLOCKS = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. License shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. Licensor shall mean the copyright owner or entity authorized by the copyright owner that is granting the License."),
    *((name, f"This {noun} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version.") for name, kind, v in GNU for noun in ("program", "library", "file")),
    *((name, f"This {noun} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind} version {v} as published by the Free Software Foundation.") for name, kind, v in GNU for noun in ("program", "library", "file")),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The licenses for most software are designed to take away your freedom to share and change it."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The GNU Affero General Public License is a free, copyleft license for software and other kinds of works."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. This is the first released version of the Lesser GPL. It also counts as the successor of the GNU Library Public License, version 2, hence the version number 2.1."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software. 1.2. Contributor Version means the combination of the Contributions of others (if any) used by a Contributor and that particular Contributor's Contribution."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
]

TERM = re.compile(rb"[a-z0-9]+(?:[.-][a-z0-9]+)*")
KINDS = {b"lesser", b"library", b"affero"}
Found = tuple[float, str | None]


def rank(found: Found) -> tuple[bool, float]:
    """By what a find is judged: any license comes before a weak one, whatever their scores."""
    return found[1] is not None and found[1] not in WEAK, found[0]


LICENSE_FILE = r"(?i)^(license|licence|copying|notice)([.-].*)?$"


def terms(text: bytes) -> list[bytes]:
    return TERM.findall(text.lower())


def named(words: list[bytes]) -> list[bytes]:
    """The terms with "general" told apart by the word before it, so that a GNU license's name is not confused with what
    its header calls the work ("This library ...")."""
    if b"general" not in words:
        return words
    return [b"%s-general" % before if word == b"general" and before in KINDS else word for before, word in zip([b"", *words], words, strict=False)]


#: What a term counts that a window has so many times; no window is longer than the longest template.
LOGS = [0.0, *(1 + math.log(c) for c in range(1, 1 << 12))]


class Scorer:
    """Cosine of a line to the templates, with weights (1 + log tf) * idf. Terms that no template has weigh as much as
    one that no document has.

    A line can reach the threshold with a template only if it has one of the template's leading terms, those by whose
    weight the rest alone stays below it. Only lines that have such a term are scored.
    """

    def __init__(self, templates: list[tuple[str, str]], df: dict[bytes, int], n: int, threshold: float):
        self.idf = {t: math.log((n + 1) / (c + 1)) + 1 for t, c in df.items()}
        self.other, self.threshold = math.log(n + 1) + 1, threshold
        self.by_term: dict[bytes, list[tuple[int, float]]] = {}
        self.names, leading = [], set()
        for i, (name, text) in enumerate(templates):
            w = self.weights(terms(text.encode()))
            norm = math.sqrt(sum(x * x for x in w.values()))
            self.names.append(name)
            rest = 1.0
            for t, x in sorted(w.items(), key=lambda p: (-p[1], p[0])):
                self.by_term.setdefault(t, []).append((i, x / norm))
                if rest >= threshold**2 * 0.999:
                    leading.add(t)
                rest -= (x / norm) ** 2
        self.leading = re.compile(rb"(?<![a-z0-9])(?:" + b"|".join(map(re.escape, sorted(leading))) + rb")(?![a-z0-9])")

    def weights(self, words: list[bytes]) -> dict[bytes, float]:
        return {t: (1 + math.log(c)) * self.idf.get(t, self.other) for t, c in Counter(words).items()}

    def best(self, words: list[bytes]) -> Found:
        """The template that is most like the words; of equal scores the earlier one. (0, None) below the threshold."""
        w = self.weights(words)
        dots: dict[int, float] = {}
        for t, x in w.items():
            for i, y in self.by_term.get(t, ()):
                dots[i] = dots.get(i, 0.0) + x * y
        norm = math.sqrt(sum(x * x for x in w.values()))
        found = [(dots[i] / norm, self.names[i]) for i in sorted(dots) if dots[i] >= self.threshold * norm]
        return max(found, key=rank, default=(0.0, None))

    def scan(self, text: bytes) -> tuple[float, str | None, list[tuple[int, int]]]:
        """The best of all lines, and between which terms the lines that reach the threshold lie."""
        low = text.lower()
        found, seen, taken = (0.0, None), set(), []
        for m in self.leading.finditer(low):
            begin, end = low.rfind(b"\n", 0, m.start()) + 1, low.find(b"\n", m.end())
            line = low[begin : end if end >= 0 else None]
            if begin not in seen:
                seen.add(begin)
                words = TERM.findall(line)
                score = self.best(words)
                found = max(found, score, key=rank)
                if score[1]:
                    first = len(TERM.findall(low, 0, begin))
                    taken.append((first, first + len(words)))
        return *found, taken


class Windows:
    """Cosine of every run of as many terms as a template has to that template, weighed as by Scorer. split gives a
    text's terms: terms, or those as named.

    A window's score is at most the root of what share of the template's squared weights the terms found in it have.
    So a text is skipped for a template if its terms have less than the threshold's square, and of the others only windows
    that have one of the template's leading terms are scored: nothing is lost.
    """

    def __init__(self, templates: list[tuple[str, str]], df: dict[bytes, int], n: int, threshold: float, split: Callable[[bytes], list[bytes]] = terms):
        words = [split(text.encode()) for _, text in templates]
        scorer = Scorer([(name, b" ".join(x).decode()) for (name, _), x in zip(templates, words, strict=True)], df, n, threshold)
        self.idf, self.other, self.threshold, self.names = scorer.idf, scorer.other, threshold, scorer.names
        self.sizes = [len(x) for x in words]
        self.places = {t: i for i, t in enumerate(scorer.by_term)}
        self.weight = np.zeros((len(templates), len(self.places)))
        for t, found in scorer.by_term.items():
            for i, y in found:
                self.weight[i, self.places[t]] = y
        self.leading = []
        for w in self.weight:
            order = np.argsort(-w, kind="stable")
            rest = 1 - np.cumsum(w[order] ** 2) + w[order] ** 2
            self.leading.append(np.isin(np.arange(len(w)), order[(rest >= threshold**2 * 0.999) & (w[order] > 0)]))

    def best(self, words: list[bytes], taken: list[tuple[int, int]] = ()) -> Found:
        """The best window; of equal scores that of the earlier template. (0, None) below the threshold.

        Windows within one of the runs of terms in taken don't count: such a line has been judged as one.
        """
        here = self.places.keys() & set(words)
        if not here:
            return 0.0, None
        present = np.zeros(len(self.places), dtype=bool)
        present[[self.places[t] for t in here]] = True
        able = np.flatnonzero((self.weight[:, present] ** 2).sum(1) >= self.threshold**2 * 0.999)
        if not len(able):
            return 0.0, None
        number = {t: i for i, t in enumerate(dict.fromkeys(words))}
        ids = np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words))
        idf = np.array([self.idf.get(t, self.other) for t in number])
        place = np.array([self.places.get(t, -1) for t in number])
        top: Found = (0.0, None)
        for k in able:
            y = np.where(place >= 0, self.weight[k, place], 0.0)
            score = self.slide(ids, idf, y, np.where(place >= 0, self.leading[k][place], False), self.sizes[k], taken)
            if score >= self.threshold:
                top = max(top, (score, self.names[k]), key=rank)
        return top

    def slide(self, ids: np.ndarray, idf: np.ndarray, y: np.ndarray, leading: np.ndarray, size: int, taken: list[tuple[int, int]]) -> float:
        """The best cosine of a window of so many terms, or of the whole text if it has fewer."""
        size = min(size, len(ids))
        first = np.concatenate([[0], np.cumsum(leading[ids])])
        counts = first[size:] > first[: len(first) - size]
        for begin, end in taken:
            counts[begin : max(begin, end - size + 1)] = False
        starts = np.flatnonzero(counts)
        count: dict[int, int] = {}
        top, dot, square, at = 0.0, 0.0, 0.0, -1
        ids, idf, y = ids.tolist(), idf.tolist(), y.tolist()

        def step(t: int, by: int) -> None:
            nonlocal dot, square
            c = count.get(t, 0)
            before, after = LOGS[c] * idf[t], LOGS[c + by] * idf[t]
            count[t] = c + by
            dot += (after - before) * y[t]
            square += after * after - before * before

        for begin in starts.tolist():
            if at < 0 or begin >= at + size:
                count.clear()
                dot = square = 0.0
                for t in ids[begin : begin + size]:
                    step(t, 1)
            else:
                for i in range(at, begin):
                    step(ids[i], -1)
                    step(ids[i + size], 1)
            at = begin
            if dot > top * math.sqrt(square):
                top = dot / math.sqrt(square)
        return top


def scan_licenses(files: DataFrame, id_col: str, path_col: str, text_col: str, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, blocks: list[tuple[str, str]] = BLOCKS) -> DataFrame:
    """One row per row of files: id, path, own_license, own_score, license, license_from.

    own_license is that of the best line of the whole text (null below the threshold, and for null or empty texts; of
    equal scores the earlier line, then the earlier template), or of the best window if that scores higher: windows as long
    as each of templates and blocks are taken from the whole text, however long and however its lines are broken, but not from within lines that have a
    license as they are. A license in WEAK is found only where no other is. license is the file's own, else that of the license
    files (LICENSE, COPYING, NOTICE, by name) of the nearest directory that has any with a license: of several in one
    directory the one that isn't weak, then with the highest score, then the smallest id. license_from is the id it is from. Files with null path have the
    empty directory. Repeated rows get a row each; other columns aren't read; an empty table gives no rows.

    Document frequencies of the templates' terms are counted over all texts; only those go to the driver. Directories,
    not files, are joined to their ancestors, and the nearest is put to the files by an equi-join on the directory.
    """
    own_terms = frozenset(t for _, text in templates for t in terms(text.encode()))
    vocabulary = own_terms.union(t for _, text in blocks for t in named(terms(text.encode())))
    rows = files.select(files[id_col].alias("id"), F.coalesce(files[path_col], F.lit("")).alias("path"), files[text_col].alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = Counter(), 0
        for batch in batches:
            for text in as_bytes(batch.column("text")):
                words = terms(text)
                df.update(vocabulary.intersection([*words, *named(words)] if b"general" in words else words))
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([*df, b""], pa.binary()), pa.array([*df.values(), n], pa.int64())], names=["term", "n"])

    df = {bytes(r["term"]): r["n"] for r in arrow_map(rows.select("text"), count, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n = df.pop(b"", 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(templates, {t: df.get(t, 0) for t in own_terms}, n, threshold)
        short = Windows(templates, {t: df.get(t, 0) for t in own_terms}, n, threshold)
        long = Windows(blocks, {t: df.get(t, 0) for t in vocabulary}, n, threshold, lambda x: named(terms(x)))
        for batch in sliced(batches, "text", CHUNK):
            out = []
            for x in as_bytes(batch.column("text")):
                *line, taken = scorer.scan(x)
                words = terms(x)
                window = max(short.best(words, taken), long.best(named(words), taken), key=rank)
                out.append(window if rank(window) > rank((line[0] + 1e-9, line[1])) else line)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("path"), pa.array([x[1] for x in out], pa.string()), pa.array([round(x[0], 9) for x in out], pa.float64())], names=["id", "path", "own_license", "own_score"])

    kind = rows.schema["id"].dataType.simpleString()
    scanned = cut(arrow_map(rows, run, f"id {kind}, path string, own_license string, own_score double"))
    scanned = scanned.withColumn("dir", F.when(F.col("path").contains("/"), F.expr("substring(path, 1, length(path) - length(substring_index(path, '/', -1)) - 1)")).otherwise(F.lit("")))
    givers = scanned.where(F.substring_index("path", "/", -1).rlike(LICENSE_FILE) & F.col("own_license").isNotNull())
    given = givers.groupBy(F.col("dir").alias("from_dir")).agg(F.min(F.struct(F.col("own_license").isin(*WEAK).alias("weak"), (-F.col("own_score")).alias("s"), "id", "own_license")).alias("best")).select("from_dir", F.col("best.id").alias("from_id"), F.col("best.own_license").alias("from_license"))
    parts = F.split("dir", "/", -1)
    up = scanned.select("dir").distinct().select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("above")))).alias("a")).select("dir", "a.depth", "a.above")
    nearest = up.join(checked_small(cut(given)), F.col("above") == F.col("from_dir")).groupBy("dir").agg(F.max_by(F.struct("from_id", "from_license"), "depth").alias("near")).select(F.col("dir").alias("of"), "near")
    joined = scanned.join(checked_small(cut(nearest)), F.col("dir") == F.col("of"), "left")
    own = F.col("own_license").isNotNull()
    return joined.select(F.col("id").alias(id_col), "path", "own_license", F.round("own_score", 6).alias("own_score"), F.coalesce("own_license", "near.from_license").alias("license"), F.when(own, F.col("id")).otherwise(F.col("near.from_id")).alias("license_from"))
