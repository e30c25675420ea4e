"""Best fit under conflicts: invariants, and bins against a plain search."""

import random
from collections import Counter, defaultdict

from tallgrass.llm.packing import best_fit, pack


def plain_best_fit(pieces, capacity):
    bins, out = [], []
    for length, source, cluster in pieces:
        fits = [(b[0], k) for k, b in enumerate(bins) if b[0] >= length and not (source >= 0 and source in b[1]) and not (cluster >= 0 and cluster in b[2])]
        if fits:
            k = min(fits)[1]
        else:
            k = len(bins)
            bins.append([capacity, set(), set()])
        bins[k][0] -= length
        bins[k][1].add(source)
        bins[k][2].add(cluster)
        out.append(k)
    return out


def test_against_a_plain_search():
    r = random.Random(1)
    for _ in range(60):
        pieces = sorted(((r.randint(1, 50), r.randint(-1, 6), r.randint(-1, 20)) for _ in range(r.randint(0, 120))), reverse=True)
        assert best_fit(pieces, 50) == plain_best_fit(pieces, 50)


def test_rows(spark):
    r = random.Random(2)
    rows = [(i, " ".join(["w"] * r.choice([0, 1, 5, 30, 90, 100, 101, 250]) + [str(i)]), f"s{r.choice([0, 0, 0, 1, 2, 3])}") for i in range(400)]
    rows += [(1000 + i, "Copy of a text " * 3, f"s{i % 5}") for i in range(30)] + [(2000, None, "s1"), (2001, " \n", None), (5, rows[5][1], rows[5][2]), (None, "no id", None)]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, source string, Piece int")
    out = pack(docs, capacity=100, together=150).collect()
    again = pack(docs.repartition(7), capacity=100, together=150).collect()
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, again), key=repr), "the same packing, however the rows lie"
    by_doc = defaultdict(list)
    for x in out:
        by_doc[x["doc_id"]].append(x)
    for i, text, _ in rows:
        words = len((text or "").split())
        copies = sum(1 for a in rows if a[0] == i)
        pieces = sorted((x["start"], x["length"]) for x in by_doc[i])
        want = [(s, min(100, words - s)) for s in range(0, words, 100)] or [(0, 0)]
        assert pieces == sorted(want * copies)
    bins = defaultdict(list)
    for x in out:
        if x["bin_no"] is not None:
            bins[x["bin_group"], x["bin_no"]].append(x)
        else:
            assert x["length"] == 0
    info = {i: (t, s) for i, t, s in rows}
    for held in bins.values():
        assert sum(x["length"] for x in held) <= 100
        sources = [info[x["doc_id"]][1] for x in held if info[x["doc_id"]][1] is not None]
        texts = [info[x["doc_id"]][0].lower() for x in held]
        assert len(set(sources)) == len(sources) and len(set(texts)) == len(texts)
    assert len({x["bin_group"] for x in out}) > 1
    assert pack(docs.limit(0)).count() == 0


def test_repeated_rows_are_spread(spark):
    """Rows of one (null) id and one text don't meet in one group, whatever their number; very long texts and empty tables."""
    rows = [(None, "same words here", "s")] * 3000 + [(1, "word " * 100_000, None), (2, None, "s"), (3, "", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS BIN_GROUP").repartition(4)
    out = pack(docs, together=100).collect()
    same = [r for r in out if r["doc_id"] is None]
    sizes = Counter(r["bin_group"] for r in same)
    assert len(same) == 3000 and max(sizes.values()) < 250 and len(sizes) > 20
    assert sum(r["length"] for r in out if r["doc_id"] == 1) == 100_000 and {(r["doc_id"], r["length"], r["bin_no"]) for r in out if r["doc_id"] in (2, 3)} == {(2, 0, None), (3, 0, None)}
    assert pack(docs.limit(0)).count() == 0
