"""URL filters and license scans against brute force."""

import math
import random
import re
from collections import Counter
from pathlib import Path

from tallgrass.llm.licenses import BLOCKS, LICENSE_FILE, TEMPLATES, THRESHOLD, Scorer, Windows, named, scan_licenses, terms
from tallgrass.llm.urls import PATTERN_RULES, SITE_RULES, Index, judge_urls, parts, rule

URLS = [
    None, "", "no scheme", "http://", "://x", "http://Example.ORG/ES/a", "http://a.b.example.org/es/", "http://example.org/en/17", "http://example.org/en/2", "http://example.org", "http://org/", "http://myorg/",
    "http://xexample.org/es/q", "https://a.com/fr/1?q#f", "https://a.com/fr", "https://a.com/de/?x", "https://a.com?x/de/", "https://a.com#/de/", "https://spam-farm.example.com/en/", "http://www.cheap-pills.net/x",
    "http://notcheap-pills.net/x", "http://a.net/affiliate/z/click", "http://a.net/affiliate/click", "http://a.net/x/doorway", "http://a.net/wp-login.php?x", "http://a.net/robots.txt", "http://u:p@org:80/", "x://y://z.org/a", "http://é.com/fr/ü", "http://a.org/line\nbreak",
]


def brute_site(host, path):
    fits = []
    for verdict, r in SITE_RULES:
        h, _, p = r.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(r), r, verdict))
    return max(fits)[1:] if fits else (None, None)


def test_urls(spark):
    r = random.Random(1)
    urls = URLS + ["".join(r.choices(["http", "://", "/", "org", "com", ".", "example", "es", "fr", "de", "?", "#", "en", "1", "spam-farm", "doorway"], k=r.randint(1, 9))) for _ in range(400)]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, VERDICT2 string")
    got = {x["page_id"]: x for x in judge_urls(pages).collect()}
    every = [rule(v, p) for v, p in PATTERN_RULES]
    for i, u in enumerate(urls):
        m = re.search("://(.*)", u or "", re.DOTALL)
        host, path = ("", "") if not m else re.fullmatch(r"([^/?#]*)([^?#]*).*", m[1], re.DOTALL).groups()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        name, verdict = brute_site(host, path)
        fits = [] if name else sorted((p for p in every if re.search(p.regex, host + path, re.DOTALL)), key=lambda p: (-len(p.name), p.name))
        want = (i, host, path, name, verdict or (fits[0].verdict if fits else "allow"), fits[0].name if fits else None)
        assert tuple(got[i]) == want, u
    assert judge_urls(pages.limit(0)).count() == 0
    assert len(judge_urls(pages.unionAll(pages.limit(3))).collect()) == len(urls) + 3


def brute_fits(pattern, address):
    """Whether a pattern fits an address, by its definition and without regular expressions."""
    body, starts = pattern.removeprefix("||"), range(len(address) + 1)
    if body != pattern:
        host = address.partition("/")[0]
        starts = [i for i in starts if i == 0 or i <= len(host) and address[i - 1] == "."]

    def from_(i, k):
        if k == len(body):
            return True
        if body[k] == "*":
            return any(from_(j, k + 1) for j in range(i, len(address) + 1))
        if body[k] == "^":
            if i == len(address):
                return from_(i, k + 1)
            c = address[i]
            return not (c.isascii() and (c.isalnum() or c in "_.%-")) and from_(i + 1, k + 1)
        return i < len(address) and address[i] == body[k] and from_(i + 1, k + 1)

    return any(from_(i, 0) for i in starts)


def test_thousands_of_rules(spark):
    """Many rules against brute force, with letters outside A-Z beside tokens, very long urls and repeated rows."""
    r = random.Random(7)
    names = [f"{a}{b}" for a in ("spam", "Pills", "win", "x9", "free") for b in range(700)]
    rules = [(r.choice(["allow", "block"]), f"||{n}." if k % 3 == 0 else f"^{n}^" if k % 3 == 1 else f"/{n}^*^z{k % 7}^") for k, n in enumerate(names)]
    odd = ["\u212a", "\u0130", "ſ", "é", "", "", "/", "-", "."]
    urls = []
    for k in range(600):
        a, b = r.choice(names), r.choice(names)
        urls.append(f"http://{r.choice(['', 'www.', 'my'])}{a.lower()}{r.choice(odd)}.net/{b}{r.choice(odd)}{r.choice(['', '/z3', '/q/Z3/', '?x', '/z5'])}")
    urls += ["http://a.net/" + "x" * 200_000 + "/" + names[4] + "/", "http://a.net/doorway\u212a", "http://a.net/doorway\u0130x"] + urls[:3]
    rules.append(("block", "^doorway^"))
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)], "page_id long, url string, PATTERN string").repartition(3)
    got = {x["page_id"]: (x["pattern"], x["verdict"]) for x in judge_urls(pages, site_rules=[], pattern_rules=rules).collect()}
    by_name = {p: v for v, p in rules}
    hits = 0
    for k, u in enumerate(urls):
        host, path = parts(u)
        address = host + path
        fits = sorted((p for _, p in rules if brute_fits(p, address)), key=lambda p: (-len(p), p)) if len(address) < 1000 else [f"^{names[4]}^"]
        assert got[k] == ((fits[0], by_name[fits[0]]) if fits else (None, "allow")), u[:80]
        hits += bool(fits)
    assert hits > 150 and got[601][0] == got[602][0] == "^doorway^"


def test_tokens():
    assert rule("block", "||example.org/en/1").tokens == ("example", "org", "en")
    assert rule("block", "^affiliate^*^click^").tokens == ("affiliate", "click")
    assert rule("block", "abc").tokens == () and rule("block", "a-b*c-d").tokens == ()
    index = Index([rule("block", "abc"), rule("block", "||a.common.")], {"a": 5, "common": 1})
    assert list(index.by_token) == ["common"] and len(index.always) == 1
    assert [r.name for r in index.fitting("x.net", "/zabcz")] == ["abc"]
    assert parts("HTTP://A.B/C?d") == ("a.b", "/C")


def brute_cosine(words, text, df, n):
    weigh = lambda ws: {t: (1 + math.log(c)) * (math.log((n + 1) / (df.get(t, 0) + 1)) + 1) for t, c in Counter(ws).items()}
    a, b = weigh(words), weigh(terms(text.encode()))
    dot = sum(x * b.get(t, 0) for t, x in a.items())
    norm = math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
    return dot / norm if norm else 0.0


def test_licenses(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choices("abcdefg", k=4))
    files = []
    for i in range(150):
        lines = [" ".join(word() for _ in range(r.randint(1, 12))) for _ in range(r.randint(0, 5))]
        if r.random() < 0.4:
            notice = r.choice(TEMPLATES)[1].split()
            for _ in range(r.randint(0, 3)):
                notice[r.randrange(len(notice))] = word()
            lines.insert(r.randint(0, len(lines)), " ".join(notice))
        depth = r.randint(0, 3)
        name = r.choice(["a.c", "b.py", "LICENSE", "license.txt", "COPYING"])
        files.append((i, "/".join([f"d{r.randint(0, 1)}" for _ in range(depth)] + [name]), "\n".join(lines)))
    files += [(900, None, "x"), (901, "d0/x", None), (902, "d0/LICENSE", "Released under the\nMIT License.")]
    n = len(files)
    vocabulary = {t for _, x in TEMPLATES for t in terms(x.encode())}
    df = Counter(t for _, _, x in files for t in vocabulary.intersection(terms((x or "").encode())))
    own = {}
    for i, _, text in files:
        raw = (text or "").encode()
        words = terms(raw)
        parts_of = [terms(line) for line in raw.split(b"\n")]
        sizes = {len(terms(x.encode())) for _, x in TEMPLATES}
        parts_of += [words[i : i + size] for size in sizes for i in range(max(1, len(words) - size + 1))] if i == 902 else []  # only there a notice is broken over lines
        scores = [(brute_cosine(ws, x, df, n), -k, name) for ws in parts_of for k, (name, x) in enumerate(TEMPLATES)]
        top = max((s for s in scores if s[0] >= THRESHOLD), key=lambda s: (s[2] != "proprietary", s[0]), default=(0, 0, None))
        own[i] = (top[2], top[0]) if top[0] >= THRESHOLD else (None, 0.0)
    want = {}
    split = {i: (p or "").rpartition("/") for i, p, _ in files}
    for i, _, _ in files:
        name, score = own[i]
        given = (name, i if name else None)
        folder = split[i][0]
        while name is None:
            fits = sorted((own[k][0] == "proprietary", -round(own[k][1], 9), k) for k in own if split[k][0] == folder and re.search(LICENSE_FILE, split[k][2]) and own[k][0])
            if fits:
                given = (own[fits[0][2]][0], fits[0][2])
                break
            if not folder:
                break
            folder = folder.rpartition("/")[0]
        want[i] = (own[i][0], round(score, 4), *given)
    table = spark.createDataFrame([(*f, 1) for f in files], "doc_id long, path string, text string, dir int").repartition(4)
    got = {x["doc_id"]: (x["own_license"], round(x["own_score"], 4), x["license"], x["license_from"]) for x in scan_licenses(table, "doc_id", "path", "text").collect()}
    assert got == want and sum(x[0] is not None for x in got.values()) > 20 and sum(x[0] is None and x[2] is not None for x in got.values()) > 20
    assert scan_licenses(table.limit(0), "doc_id", "path", "text").count() == 0


def test_leading_terms_lose_nothing():
    r = random.Random(3)
    df = {t: r.randint(0, 90) for _, x in TEMPLATES for t in terms(x.encode())}
    scorer = Scorer(TEMPLATES, df, 100, THRESHOLD)
    for _ in range(2000):
        words = r.choice(TEMPLATES)[1].lower().split()
        line = " ".join(r.sample(words, r.randint(1, len(words))) + r.choices(["x", "the", "of"], k=r.randint(0, 3))).encode()
        score, name = scorer.best(terms(line))
        if name:
            assert scorer.leading.search(line)


GPL = """/* Frobnicate, a tool.
 * Copyright (C) 2021 A. Author
 *
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.
 */
"""
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
"""
GPL_TEXT = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.

                            Preamble

  The GNU General Public License is a free, copyleft license for
software and other kinds of works.

  The licenses for most software and other practical works are designed
to take away your freedom to share and change the works.
"""


def test_license_blocks_of_several_lines(spark):
    """Headers and license texts over line breaks are found, however long the text is; a notice inside a line too."""
    r = random.Random(5)
    filler = "\n".join(" ".join("".join(r.choices("hijklmn", k=5)) for _ in range(9)) for _ in range(80))
    lgpl = GPL.replace("GNU General", "GNU Lesser General")
    texts = {
        "GPL-3.0": [GPL + filler, GPL.replace("This program is", "This library is") + filler, filler + "\n" + GPL + filler, GPL_TEXT + filler],
        "GPL-2.0": [GPL.replace("version 3", "version 2") + filler],
        "LGPL-3.0": [lgpl.replace("This program is", y) + filler for y in ("This program is", "This library is", "Frobnicate is")],
        "LGPL-2.0": [GPL.replace("GNU General", "GNU Library General").replace("version 3", "version 2") + filler],
        "LGPL-2.1": [lgpl.replace("version 3", "version 2.1") + filler],
        "AGPL-3.0": [GPL.replace("GNU General", "GNU Affero General") + filler],
        "Apache-2.0": [APACHE + filler],
        "MIT": [f"{filler}\nReleased under\nthe MIT License.\n{filler}", f"{filler} Released under the MIT License. {filler}"],
        None: [filler, filler + "\nthis program is free and version 3 of it is the general one\n" + filler],
    }
    rows = [(name, text) for name, found in texts.items() for text in found]
    table = spark.createDataFrame([(i, "a.c", t) for i, (_, t) in enumerate(rows)], "doc_id long, path string, text string")
    got = {x["doc_id"]: x["own_license"] for x in scan_licenses(table, "doc_id", "path", "text").collect()}
    assert [got[i] for i in range(len(rows))] == [name for name, _ in rows]


BSD = """Copyright (c) 2020, A. Author
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
THIRD = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
DISCLAIMER = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.
"""


def test_license_files(spark):
    """Whole license files, wrapped as they come; that all rights are reserved says nothing beside a license. Very long texts, repeated
    rows and clashing names."""
    rows = [("BSD-3-Clause", BSD + THIRD + DISCLAIMER), ("BSD-2-Clause", BSD + DISCLAIMER), ("MIT", "All rights reserved.\nReleased under the MIT License."), ("proprietary", "Copyright 2020.\nAll rights reserved.\nKeep out."), ("MIT", "word " * 200_000 + "\nReleased under the MIT License.\n" + "more " * 50_000)]
    folder = Path("/usr/share/common-licenses")
    rows += [(name, (folder / f).read_text()) for name, f in (("GPL-3.0", "GPL-3"), ("GPL-2.0", "GPL-2"), ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3.0", "LGPL-3"), ("Apache-2.0", "Apache-2.0"), ("MPL-2.0", "MPL-2.0")) if (folder / f).exists()]
    rows += rows[:2]
    table = spark.createDataFrame([(i, "a/LICENSE", t, "x") for i, (_, t) in enumerate(rows)], "doc_id long, path string, text string, OWN_LICENSE string")
    got = {x["doc_id"]: x["own_license"] for x in scan_licenses(table, "doc_id", "path", "text").collect()}
    assert [got[i] for i in range(len(rows))] == [name for name, _ in rows]


def test_windows_against_brute_force():
    r = random.Random(6)
    both = [*TEMPLATES, *BLOCKS]
    split = [named(terms(x.encode())) for _, x in both]
    df, n, found = {t: r.randint(0, 90) for ws in split for t in ws}, 100, 0
    windows = Windows(both, df, n, THRESHOLD, lambda x: named(terms(x)))
    for _ in range(60):
        words = [r.choice([b"x", b"the", b"of", b"license"]) for _ in range(r.randint(0, 40))]
        part = list(r.choice(split))
        for _ in range(r.randint(0, len(part) // 3)):
            part[r.randrange(len(part))] = r.choice([b"y", b"z", b"software"])
        words[r.randint(0, len(words)) :] = part + words[:20]
        runs = [(brute_cosine(words[i : i + len(t)], b" ".join(t).decode(), df, n), name) for t, (name, _) in zip(split, both, strict=True) for i in range(max(1, len(words) - len(t) + 1))]
        runs = [x for x in runs if x[0] >= THRESHOLD and x[1] != "proprietary"] or runs
        top = max(runs, key=lambda x: x[0])
        score, name = windows.best(words)
        if top[0] >= THRESHOLD:
            assert abs(score - top[0]) < 1e-9 and name in {x for s, x in runs if s > top[0] - 1e-9}
            found += 1
        else:
            assert (score, name) == (0.0, None)
    assert 10 < found
