"""Operator 5, line dedup across sites, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked_small, cut, fresh

#: A line is boilerplate if it stands on so many sites. Lines whose sketch says between LOW and HIGH times that many,
#: or one site less or more, are counted exactly; with 2**LG_K registers that is over six standard errors to each side.
MIN_SITES, LOW, HIGH, LG_K = 10, 0.9, 1.1, 12

BLANK = " \t\r\x0b\x0c"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def boilerplate(rows: DataFrame, min_sites: int) -> DataFrame:
    """(h1, h2): the 128-bit hashes of the trimmed lines that stand on min_sites sites or more. rows: (text, site).

    A sketch of the sites of each line merges by aggregation, map side first: a line of any number of documents is
    a row for each task. Only near-threshold lines get exact distinct counts, by (line, site) first.
    """
    lines = rows.select("site", F.explode(lines_of(F.col("text"))).alias("line")).select("site", F.btrim("line", F.lit(BLANK)).alias("line")).where("line != '' and site is not null")
    hashed = lines.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "site")
    spread = hashed.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites")).where(F.col("sites") >= min(LOW * min_sites, min_sites - 1))
    spread = cut(spread)
    sure = F.col("sites") > max(HIGH * min_sites, min_sites + 1)
    near = spread.where(~sure).select(F.col("h1").alias("n1"), F.col("h2").alias("n2"))
    at_near = hashed.join(checked_small(near), (F.col("h1") == F.col("n1")) & (F.col("h2") == F.col("n2")), "left_semi")
    exact = at_near.groupBy("h1", "h2", "site").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites)
    return cut(spread.where(sure).select("h1", "h2").unionAll(exact.select("h1", "h2")))


def marked(docs: DataFrame, id_col: str, text_col: str, site_col: str, min_sites: int) -> tuple[DataFrame, str]:
    """docs with an array of the places (from 0) of each text's boilerplate lines, null if it has none."""
    known, places, key = fresh(docs, "known", "places", "key")
    rows = docs.select(docs[text_col].alias("text"), docs[site_col].cast("string").alias("site"))
    bad = boilerplate(rows, min_sites).select(F.col("h1").alias("b1"), F.col("h2").alias("b2"))
    lines = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("key"), F.posexplode(lines_of(docs[text_col])).alias("place", "line")).select("id", "key", "place", F.btrim("line", F.lit(BLANK)).alias("line")).where("line != ''")
    hits = lines.select("id", "key", "place", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")).join(checked_small(bad), (F.col("h1") == F.col("b1")) & (F.col("h2") == F.col("b2")), "left_semi")
    per_doc = hits.groupBy("id", "key").agg(F.collect_set("place").alias("found")).select(F.col("id").alias(known), F.col("key").alias(key), F.col("found").alias(places))
    joined = docs.join(checked_small(cut(per_doc), held=4 * F.size(places)), docs[id_col].eqNullSafe(F.col(known)) & (F.xxhash64(docs[text_col]) == F.col(key)), "left")
    return joined, places


def kept_lines(text: Column, places: Column) -> Column:
    return F.when(places.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.filter(lines_of(text), lambda _, i: ~F.array_contains(places, i)), "\n"))


def line_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """One row per row of docs: id, n_lines, n_removed, kept_sha256 (of the kept lines, joined by \\n).

    Lines are parts between \\n, compared without white space at their ends. A line that stands on min_sites distinct
    sites or more is removed wherever it is; blank lines never are. A null text has no lines (n_lines 0) and keeps the empty
    text; null sites count for none, but boilerplate goes from their texts too. Repeated rows get a row each. Other
    columns aren't read; an empty table gives no rows.
    """
    joined, places = marked(docs.select(id_col, text_col, site_col), id_col, text_col, site_col, min_sites)
    text = F.col(text_col)
    return joined.select(
        F.col(id_col),
        F.when(text.isNull(), 0).otherwise(F.size(lines_of(text))).cast("long").alias("n_lines"),
        F.when(F.col(places).isNull(), 0).otherwise(F.size(F.col(places))).cast("long").alias("n_removed"),
        F.sha2(kept_lines(text, F.col(places)), 256).alias("kept_sha256"),
    )


def drop_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """docs with the boilerplate lines cut out of their texts; all rows and columns stay, whatever the columns are called.

    A null text stays null and an empty one empty; a text of boilerplate only becomes empty. Very long texts are cut whole, repeated
    rows alike. A null site counts for none. An empty table gives no rows."""
    joined, places = marked(docs, id_col, text_col, site_col, min_sites)
    return joined.select(*(F.when(F.col(places).isNull(), docs[c]).otherwise(kept_lines(docs[c], F.col(places))).alias(c) if c == text_col else docs[c] for c in docs.columns))
