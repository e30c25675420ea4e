"""Exact, near, line and substring dedup on small tables, against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallgrass.llm import common, simhash, substring
from tallgrass.llm.common import connected_components, forest
from tallgrass.llm.exact import drop_exact, exact_groups
from tallgrass.llm.lines import drop_boilerplate, line_digests
from tallgrass.llm.simhash import drop_near, fingerprints_of, near_components, near_links
from tallgrass.llm.substring import Anchors, drop_repeated, sent_rows, shards_for, substring_digests, suspects

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(spark, rows, parts=5):
    """rows of (doc_id, text), with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, f"s{k % 3}", k, None) for k, (i, t) in enumerate(rows)], "doc_id long, text string, source string, id int, ROW string").repartition(parts)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdeéß", k=r.randint(1, 7)))
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(160):
        words = [word() for _ in range(r.randint(0, 90))]
        if r.random() < 0.3:
            at, k = r.randint(0, len(words)), r.randint(0, 40)
            words[at:at] = passage[k : k + r.randint(5, 60)]
        rows.append((i * 3, r.choice([" ", "\n", " \t"]).join(words)))
    for i in range(60):
        words = rows[r.randrange(160)][1].split()
        if words and r.random() < 0.6:
            words[r.randrange(len(words))] = word()
        rows.append((1000 + i, " ".join(words) if r.random() < 0.7 else " ".join(words).title()))
    hot = "Hot text " + " ".join(passage)
    rows += [(2000 + i, r.choice([hot, hot.upper(), hot.lower()])) for i in range(120)]
    rows += [(5000, None), (5001, ""), (5002, " \n"), (5003, None), (7, rows[5][1]), (rows[9][0], rows[9][1]), (6000, "x " * 3000 + "long" * 5000)]
    r.shuffle(rows)
    return rows


def test_exact(spark, corpus):
    rows = corpus + [(None, "only null"), (None, corpus[0][1]), (None, "only null")]
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOW)].append(i)
    for keep, best in (("largest", max), ("smallest", min)):
        got = exact_groups(docs_of(spark, rows), keep=keep).collect()
        assert len(got) == len(rows)
        kept = defaultdict(list)
        for r in got:
            if r["kept"]:
                kept[r["text_sha256"]].append(r["doc_id"])
        for t, ids in groups.items():
            stays = best((i for i in ids if i is not None), default=None)
            sha = hashlib.sha256(t.encode()).hexdigest()
            assert kept[sha] == [stays]
            assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in got if r["text_sha256"] == sha), key=repr) == sorted(((i, stays, len(ids)) for i in ids), key=repr)
        left = drop_exact(docs_of(spark, rows), keep=keep)
        assert left.columns == ["doc_id", "text", "source", "id", "ROW"]
        assert sorted(((r["doc_id"], (r["text"] or "").translate(LOW)) for r in left.collect()), key=repr) == sorted(((best((i for i in ids if i is not None), default=None), t) for t, ids in groups.items()), key=repr)


def test_exact_group_over_partitions(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = [(i, "Same" if i % 5 else f"own {i}") for i in range(4000)]
        got = exact_groups(docs_of(spark, rows, 16), keep="largest").where("group_size > 1").collect()
        assert len(got) == 3200 and {(r["keep_id"], r["group_size"]) for r in got} == {(3999, 3200)} and sum(r["kept"] for r in got) == 1
        assert drop_exact(docs_of(spark, rows, 16), keep="largest").count() == 801
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def brute_fingerprint(text):
    words = WORDS.findall((text or "").translate(LOW))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, near):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if near(i, j):
                parent[root(i)] = root(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[root(i)] = min(least.get(root(i), x), x)
    return [least.get(root(i)) for i in range(len(ids))]


def test_near(spark, corpus, monkeypatch):
    rows = corpus + [(None, "a b c d e")]
    fps = [brute_fingerprint(t) for _, t in rows]
    want = components([i for i, _ in rows], lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    for residents, visitors in ((simhash.RESIDENTS, simhash.VISITORS), (5, 7)):
        monkeypatch.setattr(simhash, "RESIDENTS", residents)
        monkeypatch.setattr(simhash, "VISITORS", visitors)
        got = near_components(docs_of(spark, rows)).collect()
        assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=repr) == sorted(((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, want, strict=True)), key=repr)
    left = drop_near(docs_of(spark, rows))
    assert sorted((x["doc_id"] for x in left.collect()), key=repr) == sorted((i for (i, _), c in zip(rows, want, strict=True) if i is None or i == c), key=repr)
    assert near_components(docs_of(spark, rows).limit(0)).count() == 0


def test_near_tells_rows_of_one_id_apart(spark):
    """A row goes by its own text, not because another row with its id is a near copy."""
    r = random.Random(8)
    copy, other = (" ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(60)) for _ in range(2))
    rows = [(1, copy), (2, copy.upper()), (2, other), (2, other.upper()), (3, other), (4, None), (4, copy)]
    left = drop_near(docs_of(spark, rows)).collect()
    assert sorted((x["doc_id"], x["text"] or "") for x in left) == sorted([(1, copy), (2, other), (2, other.upper()), (4, "")])


def test_tiles_lose_no_link(spark, monkeypatch):
    r = np.random.default_rng(5)
    base = r.integers(0, 2**63, 60, dtype=np.uint64)
    fps = {int(x) for x in base}
    for x in base.tolist():
        for _ in range(12):
            fps.add(x ^ sum(1 << int(b) for b in r.choice(64, r.integers(1, 5), replace=False)))
    fps = sorted(fps)
    want = components(fps, lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    df = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in fps], "fp long")
    for most in (simhash.VISITORS, 20):
        monkeypatch.setattr(simhash, "VISITORS", most)
        monkeypatch.setattr(simhash, "RESIDENTS", most)
        linked = {frozenset((a % 2**64, b % 2**64)) for a, b in near_links(df).collect()}
        assert components(fps, lambda i, j, linked=linked: frozenset((fps[i], fps[j])) in linked) == want


def test_dense_group_sends_few_links(spark):
    fps = [sum(1 << b for b in (i, j)) for i in range(40) for j in range(i)]
    links = near_links(spark.createDataFrame([(x,) for x in fps], "fp long").repartition(4))
    assert links.count() < 30 * len(fps)


def test_components(spark):
    r = random.Random(9)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(r.randint(3000, 3400), r.randint(3000, 3400)) for _ in range(250)] + [(-5, 7000)]
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    pairs = set(map(frozenset, edges))
    want = dict(zip(nodes, components(nodes, lambda i, j: frozenset((nodes[i], nodes[j])) in pairs), strict=True))
    assert got == want
    u, v = (np.array(x) for x in zip(*edges, strict=True))
    assert dict(zip(*(x.tolist() for x in forest(u, v)), strict=True)) == {n: c for n, c in want.items() if n != c}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_fingerprints_of_odd_texts():
    texts = [b"", b" ", b"One", b"one two", b"a b c", b"a b c d", "é À ß".encode()]
    assert [int(x) for x in fingerprints_of(texts)] == [brute_fingerprint(t.decode()) for t in texts]


def brute_substring(rows, window):
    starts = defaultdict(list)
    split = [WORDS.findall(t or "") for _, t in rows]
    for (i, _), words in zip(rows, split, strict=True):
        if i is not None:
            for k in range(len(words) - window + 1):
                starts[tuple(words[k : k + window])].append(i)
    out = []
    for (i, _), words in zip(rows, split, strict=True):
        gone = set()
        if i is not None:
            for k in range(len(words) - window + 1):
                if min(starts[tuple(words[k : k + window])]) < i:
                    gone.update(range(k, k + window))
        left = [w for k, w in enumerate(words) if k not in gone]
        out.append((i, len(words), len(gone), hashlib.sha256(" ".join(left).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("window", [13, 4])
def test_substring(spark, corpus, window, monkeypatch):
    rows = corpus + [(None, corpus[0][1]), (4, "q " * 30 + "end"), (4, "z " * 30), (5, "q " * 31)]
    want = sorted(brute_substring(rows, window), key=repr)
    assert sorted(map(tuple, substring_digests(docs_of(spark, rows), window=window).collect()), key=repr) == want
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(substring, "ROOM", 1e-4)  # a sketch so small that it filters next to nothing
    monkeypatch.setattr(substring, "GATHER", 300)
    monkeypatch.setattr(substring, "HOT_SHARE", 5)
    monkeypatch.setattr(substring, "CODES", 40)  # most words are written out
    assert sorted(map(tuple, substring_digests(docs_of(spark, rows), window=window).collect()), key=repr) == want


def test_substring_of_texts(spark):
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(1, long), (2, f"before\n{long}  after"), (3, long), (4, "clean\n text"), (5, None)]
    left = {r["doc_id"]: (r["text"], r["id"]) for r in drop_repeated(docs_of(spark, rows), chars_col="id").collect()}
    assert left[2] == ("before\nafter", 12) and left[4][0] == "clean\n text" and left[5][0] is None and left[1][0] == long and 3 not in left
    assert drop_repeated(docs_of(spark, rows)).schema == docs_of(spark, rows).schema
    assert substring_digests(docs_of(spark, rows).limit(0)).count() == 0


def test_left_text():
    text = b" a b\n\nc  d e\t"
    cut = lambda *runs: substring.left_text(text, [{"start": i, "length": n} for i, n in runs])
    assert cut((1, 2)) == b" a d e\t" and cut((0, 1)) == b" b\n\nc  d e\t" and cut((3, 2)) == b" a b\n\nc" and cut((0, 5)) == b"" and cut((0, 1), (2, 1)) == b" b\n\nd e\t"


def test_sketch_loses_no_window(spark, monkeypatch):
    """Every anchor that two texts have is told to both; a saturated sketch tells more, a roomy one few besides."""
    r = random.Random(2)
    texts = [" ".join(r.choices("abcdefghijklmnop", k=r.randint(0, 60))) for _ in range(300)]
    anchors = Anchors([t.encode() for t in texts], {}, 13)
    sets = [set(x.tolist()) for x in np.split(anchors.anchor, np.cumsum(anchors.many)[:-1])]
    times = defaultdict(int)
    for x in sets:
        for a in x:
            times[a] += 1
    want = {(k, a & 0xFFFFFFFF) for k, x in enumerate(sets) for a in x if times[a] > 1}
    every = {(k, a & 0xFFFFFFFF) for k, x in enumerate(sets) for a in x}
    rows = spark.createDataFrame(list(enumerate(texts)), "key long, text string").repartition(6)
    for gather, room in ((1 << 20, 8), (100, 8), (100, 1e-4)):
        monkeypatch.setattr(substring, "GATHER", gather)
        monkeypatch.setattr(substring, "ROOM", room)
        got = {(x["key"], int(a)) for x in suspects(rows, sum(len(t.split()) for t in texts), 13).collect() for a in np.frombuffer(x["anchors"], dtype=np.uint32)}
        assert want <= got <= every and (room < 1 or len(got - want) < 0.1 * len(every))


def test_shards_grow():
    assert shards_for(1) == 16 and shards_for(10**9) == 10**9 >> 21 and shards_for(10**12) == 10**12 >> 23
    a = np.array([5 << 40, 6 << 40, 5 << 40, 9 << 50], dtype=np.uint64)
    kinds = {b.column("kind")[0].as_py(): b for b in sent_rows(a, np.array([0, 0, 1, 1]), np.array([70, 71]), 16, 3)}
    assert kinds[1].num_rows == 1 and sum(map(sum, kinds[0].column("counts").to_pylist())) == 2 and kinds[2].column("docs").to_pylist() == [[70, 71]]


def test_substring_of_odd_ids(spark):
    """Ids of text; a window that very many rows share; words with odd bytes."""
    r = random.Random(12)
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(f"d{i:04}", " ".join(r.choices(["\x00", "\x01", "a\x00", "b", "é"], k=20)) + " " + (passage if i % 3 else "")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(7)
    assert sorted(map(tuple, substring_digests(docs).collect())) == sorted(brute_substring(rows, 13))
    assert substring_digests(docs.limit(0)).count() == 0 and drop_repeated(docs.limit(0)).count() == 0


def test_lines(spark):
    r = random.Random(4)
    rows = []
    for i in range(200):
        lines = [f"own line {i} {k}" for k in range(r.randint(0, 4))]
        for name, sites in (("everywhere", 30), ("ten", 10), ("nine", 9), ("eleven", 11)):
            if i % 30 < sites and r.random() < 0.9 or i < sites:
                lines.insert(r.randint(0, len(lines)), r.choice(["", " ", "\t"]) + name + r.choice(["", "\r"]))
        rows.append((i, "\n".join([*lines, ""]), f"site{i % 30}"))
    rows += [(500, None, "site1"), (501, "everywhere\n\nown", None), (501, "ten", None), (None, "eleven\nx", "site2"), (1, rows[1][1], "site1")]
    docs = spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, source string, KEY int")
    sites = defaultdict(set)
    for _, t, s in rows:
        for line in (t or "").split("\n"):
            sites[line.strip(" \t\r\x0b\x0c")].add(s)
    bad = {x for x, s in sites.items() if x and len(s - {None}) >= 10}
    assert bad == {"everywhere", "ten", "eleven"}
    want = []
    for i, t, _ in rows:
        lines = t.split("\n") if t is not None else []
        left = [x for x in lines if x.strip(" \t\r\x0b\x0c") not in bad]
        want.append((i, len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    assert sorted(map(tuple, line_digests(docs).collect()), key=repr) == sorted(want, key=repr)
    out = drop_boilerplate(docs)
    assert out.columns == docs.columns and {r["doc_id"]: r["text"] for r in out.collect()}[501] in ("\nown", "")
    plan = line_digests(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert line_digests(docs.limit(0)).count() == 0


def test_exact_of_odd_tables(spark, monkeypatch):
    """Ids of text, contents that agree over a splitter's whole length, runs held in pieces, empty tables."""
    from tallgrass.llm import common, exact

    docs = spark.createDataFrame([("b", "X", 1), ("a", "x", 2), ("c", None, 3), (None, "", 4), ("a", "x", 5)], "doc_id string, text string, PART int")
    got = sorted(map(tuple, exact_groups(docs, keep="largest").select("doc_id", "keep_id", "group_size", "kept").collect()), key=repr)
    assert got == sorted([("b", "b", 3, True), ("a", "b", 3, False), ("a", "b", 3, False), ("c", "c", 2, True), (None, "c", 2, False)], key=repr)
    assert sorted(r["doc_id"] for r in drop_exact(docs).collect()) == ["a", "c"]
    assert exact_groups(docs.limit(0)).count() == 0 and drop_exact(docs.limit(0)).count() == 0 and drop_exact(docs).schema == docs.schema

    monkeypatch.setattr(exact, "KEY", 8)
    monkeypatch.setattr(exact, "HELD", 7)
    rows = [(i, "Long lead " + ("same" if i % 3 else str(i % 40) if i % 2 else f"z{i % 50}") * 50) for i in range(600)]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    for most in (common.BROADCAST_ROWS, 0):  # runs that cross are broadcast, or joined by a shuffle
        monkeypatch.setattr(common, "BROADCAST_ROWS", most)
        got = exact_groups(docs_of(spark, rows), keep="smallest").collect()
        assert {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got} == {(i, ids[0], len(ids), i == ids[0]) for ids in groups.values() for i in ids} and len(got) == 600
        assert sorted(r["doc_id"] for r in drop_exact(docs_of(spark, rows)).collect()) == sorted(ids[0] for ids in groups.values())


def test_empty_tables_and_long_texts(spark):
    """Operators that return whole rows: nothing of an empty table; a very long text and repeated rows beside short ones; a clashing name."""
    r = random.Random(21)
    long = " ".join("".join(r.choices("abcdefghijkl", k=6)) for _ in range(60_000))
    docs = spark.createDataFrame([(1, long, "s"), (2, "short one", "s"), (2, "short one", "s"), (3, None, None), (4, "", "s")], "doc_id long, text string, source string").selectExpr("*", "1 AS gone", "2 AS PLACES")
    empty = docs.limit(0)
    for run in (drop_near, drop_boilerplate, drop_repeated, drop_exact):
        assert run(empty).count() == 0 and run(empty).columns == docs.columns
    assert sorted(x["doc_id"] for x in drop_near(docs).collect()) == [1, 2, 2, 3]
    assert sorted(x["doc_id"] for x in drop_repeated(docs).collect()) == [1, 2, 2, 3, 4]
    assert sorted(x["doc_id"] for x in drop_boilerplate(docs).collect()) == [1, 2, 2, 3, 4]
    assert {x["doc_id"]: x["text"] for x in drop_repeated(docs).collect()}[1] == long


def test_lines_on_thousands_of_sites(spark):
    """Sketches past their exact mode: lines on 990 to 1,010 sites against a threshold of 1,000, and lines far from it."""
    spread = {"few": 300, "under": 990, "just under": 999, "at": 1000, "over": 1001, "more": 1010, "everywhere": 3000}
    rows = [(i, "\n".join([f"own {i}", *(k for k, n in spread.items() if i < n)]), f"site{i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    gone = {k for k, n in spread.items() if n >= 1000}
    for x in drop_boilerplate(docs, min_sites=1000).where("doc_id in (0, 5, 995, 1005, 2000)").collect():
        assert x["text"] == "\n".join([f"own {x['doc_id']}", *(k for k, n in spread.items() if x["doc_id"] < n and k not in gone)])


def test_broadcasts_are_bounded_in_bytes(spark, monkeypatch):
    rows = spark.range(10).selectExpr("id", "array_repeat(1, 100) AS found")
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().analyzed().toString().lower()
    assert hinted(common.checked_small(rows, held=F.size("found")))
    monkeypatch.setattr(common, "BROADCAST_BYTES", 500)
    assert hinted(common.checked_small(rows)) and not hinted(common.checked_small(rows, held=F.size("found")))
