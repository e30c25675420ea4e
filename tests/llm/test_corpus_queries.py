"""Registered queries over whole small tables: against SQL where there is some, else their shape; the pipeline's stages."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))

import corpus_pipeline
from tallgrass.llm.exact import exact_groups
from tallgrass.llm.packing import pack
from tallgrass.llm.quality import quality_rules
from tallgrass.llm.queries import ORACLES, QUERIES
from tallgrass.llm.simhash import near_components
from tallgrass.llm.substring import substring_digests

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


def plain(rows, columns):
    return sorted(repr([bool(x) if type(x).__name__ == "bool_" else x for x in (r[c] for c in columns)]) for r in rows)


@pytest.mark.parametrize("name", ORACLES)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    df = QUERIES[name](spark, str(DATA))
    want = con.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    assert plain([r.asDict() for r in df.collect()], columns) == plain([dict(zip(want.columns, r, strict=True)) for r in want.fetchall()], columns)


def test_names_and_rows(spark):
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    for name, n in (("op1_quality_rules", 200), ("op4_simhash_near_dedup", 200), ("op6_sentencepiece", 200), ("op9_license_scans", 200)):
        assert QUERIES[name](spark, str(DATA)).count() == n
    assert all(r["round_trip"] for r in QUERIES["op6_sentencepiece"](spark, str(DATA)).collect())


def test_pipeline(spark):
    """Each stage keeps what the decisions over its input say; the last packs what is left."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert len(steps) == 5
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())

    good = steps["quality rules"](spark, docs, str(DATA)).cache()
    assert good.schema == docs.schema and ids(good) == ids(quality_rules(docs).where("kept"))
    unique = steps["exact dedup"](spark, good, str(DATA)).cache()
    assert unique.columns == docs.columns and ids(unique) == ids(exact_groups(good, keep="largest").where("kept"))
    apart = steps["near dedup"](spark, unique, str(DATA)).cache()
    assert apart.columns == docs.columns and ids(apart) == ids(near_components(unique).where("doc_id = component_id"))
    cut = steps["substring dedup"](spark, apart, str(DATA)).cache()
    digests = {r["doc_id"]: r for r in substring_digests(apart).collect()}
    assert ids(cut) == sorted(i for i, r in digests.items() if r["n_removed"] < r["n_words"] or not r["n_words"])
    before = {r["doc_id"]: r for r in apart.collect()}
    for r in cut.collect():
        d = digests[r["doc_id"]]
        assert r["n_chars"] == len(r["text"]) and len(r["text"].split()) == d["n_words"] - d["n_removed"]
        assert d["n_removed"] or r == before[r["doc_id"]]
    packed = steps["best-fit packing"](spark, cut, str(DATA))
    assert sorted(map(tuple, packed.collect())) == sorted(map(tuple, pack(cut).collect())) == sorted(map(tuple, corpus_pipeline.run(spark, str(DATA)).collect()))
    spark.catalog.clearCache()


def test_pipeline_of_odd_tables(spark):
    """An empty table, and one of null, empty, repeated and very long texts, pass every stage."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = docs.limit(3).unionAll(docs.limit(1)).unionByName(spark.createDataFrame([(None, None, None, None, None), (-1, "", "en", "s", 0), (-2, " ".join(f"w{i}" for i in range(50_000)), "en", "s", 1)], docs.schema))
    for table in (docs.limit(0), odd):
        for name, stage in corpus_pipeline.STAGES:
            kept = table
            table = stage(spark, kept, str(DATA)).cache()
            assert name == "best-fit packing" or table.columns == docs.columns
        assert table.count() == 0 or table.where("doc_id = -2").agg({"length": "sum"}).first()[0] == 50_000
    spark.catalog.clearCache()
