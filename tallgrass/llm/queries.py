"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .exact import exact_groups
from .html import extract
from .licenses import TEMPLATES, THRESHOLD, WEAK, scan_licenses
from .lines import line_digests
from .packing import pack
from .pieces import decode, encode
from .quality import MAX_COVERED, MAX_LONGEST, MIN_REPEAT, quality_rules
from .simhash import near_components
from .substring import substring_digests
from .urls import judge_urls


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules' columns; long_repeat says whether the longest repeat is over its limit."""
    return quality_rules(table(spark, sf_dir, "documents")).withColumn("long_repeat", F.col("longest_repeat") > MAX_LONGEST).drop("longest_repeat")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digests(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids, joined by commas), round_trip (decoding gives the text again)."""
    rows = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def as_files(docs: DataFrame) -> DataFrame:
    """Documents as files of a repository for each source: a tenth of them are license files, at three depths."""
    doc = F.col("doc_id")
    name = F.when(doc % 10 == 0, F.concat(F.lit("LICENSE-"), doc)).otherwise(F.concat(doc, F.lit(".txt")))
    directory = F.when(doc % 100 == 0, F.col("source")).when(doc % 20 == 0, F.concat_ws("/", "source", "lang")).otherwise(F.concat_ws("/", "source", "lang", F.concat(F.lit("d"), doc % 13)))
    return docs.select("doc_id", F.concat_ws("/", directory, name).alias("path"), "text")


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(as_files(table(spark, sf_dir, "documents")), "doc_id", "path", "text")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_digests(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_exact_dedup, op3_url_filters, op4_simhash_near_dedup, op5_line_dedup,
    op6_sentencepiece, op7_html_extraction, op8_best_fit_packing, op9_license_scans, op10_substring_dedup,
)}



def joined_sql(size: int) -> str:
    """So many words from a place on, joined by spaces; null where the text ends before."""
    return " || ' ' || ".join(f"lead(word, {k}) OVER o" if k else "word" for k in range(size))


def covered_sql(size: int, texts: str = "p") -> str:
    """(doc_id, n): the words of each text in windows of so many words that are found twice or more in it."""
    return f"""(SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + {size})) AS place FROM
  (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, seq) AS times FROM (SELECT doc_id, i, md5({joined_sql(size)}) AS seq FROM {texts} WINDOW o AS (PARTITION BY doc_id ORDER BY i)) WHERE seq IS NOT NULL)
  WHERE times > 1) GROUP BY doc_id)"""


TEMPLATES_SQL = ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(TEMPLATES))
WEAK_SQL = ", ".join(f"'{x}'" for x in sorted(WEAK))
TERM_SQL = r"'[a-z0-9]+(?:[.-][a-z0-9]+)*'"
ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op1_quality_rules": rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
five AS {covered_sql(5)}, p5 AS (SELECT * FROM p SEMI JOIN five USING (doc_id)),
long AS {covered_sql(MIN_REPEAT, "p5")}, longer AS {covered_sql(MAX_LONGEST + 1, "p5")},
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
r AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(five.n, 0)::BIGINT AS n_repeat_words, coalesce(long.n, 0)::BIGINT AS n_covered_words, longer.n IS NOT NULL AS long_repeat
      FROM w LEFT JOIN five USING (doc_id) LEFT JOIN long USING (doc_id) LEFT JOIN longer USING (doc_id) LEFT JOIN lines USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM r)
SELECT *, NOT base_failed AND n_covered_words <= {MAX_COVERED} * n_words AND NOT long_repeat AS kept FROM b
""",
    "op2_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC) = 1 AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
WINDOW g AS (PARTITION BY norm)
""",
    "op3_url_filters": r"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
s AS (SELECT *, CASE WHEN regexp_matches(host || path, '^([^/]*\.)?example\.org/en/1') THEN 'example.org/en/1'
                     WHEN regexp_matches(host || path, '^([^/]*\.)?example\.org/es/') THEN 'example.org/es/'
                     WHEN regexp_matches(host || path, '^([^/]*\.)?com/fr/') THEN 'com/fr/'
                     WHEN regexp_matches(host || path, '^([^/]*\.)?com/de/') THEN 'com/de/'
                     WHEN regexp_matches(host || path, '^([^/]*\.)?org/') THEN 'org/' END AS rule FROM p),
m AS (SELECT *, CASE WHEN rule IS NOT NULL THEN NULL ELSE (
        SELECT arg_max(name, len(name)) FROM (VALUES
          ('||spam-farm.', '^([^/]*\.)?spam-farm\.'), ('||cheap-pills.', '^([^/]*\.)?cheap-pills\.'), ('||casino.', '^([^/]*\.)?casino\.'),
          ('||free-casino.', '^([^/]*\.)?free-casino\.'), ('||poker-online.', '^([^/]*\.)?poker-online\.'), ('||adult.', '^([^/]*\.)?adult\.'),
          ('||xxx.', '^([^/]*\.)?xxx\.'), ('||porn.', '^([^/]*\.)?porn\.'), ('||torrents.', '^([^/]*\.)?torrents\.'), ('||warez.', '^([^/]*\.)?warez\.'),
          ('||buy-followers.', '^([^/]*\.)?buy-followers\.'), ('^affiliate^*^click^', '[^A-Za-z0-9_.%-]affiliate[^A-Za-z0-9_.%-].*[^A-Za-z0-9_.%-]click([^A-Za-z0-9_.%-]|$)'),
          ('^doorway^', '[^A-Za-z0-9_.%-]doorway([^A-Za-z0-9_.%-]|$)'), ('^wp-login.php^', '[^A-Za-z0-9_.%-]wp-login\.php([^A-Za-z0-9_.%-]|$)'),
          ('^robots.txt^', '[^A-Za-z0-9_.%-]robots\.txt([^A-Za-z0-9_.%-]|$)')) AS t(name, regex)
        WHERE regexp_matches(host || path, regex)) END AS pattern FROM s)
SELECT page_id, host, path, rule, pattern,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN pattern = '^robots.txt^' THEN 'allow' WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM m
""",
    "op5_line_dedup": r"""
WITH l AS (SELECT doc_id, source, i, line, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS t
           FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)),
bad AS (SELECT t FROM l WHERE t != '' GROUP BY t HAVING count(DISTINCT source) >= 10),
kept AS (SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS left_text FROM l WHERE t NOT IN (SELECT t FROM bad) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(string_split(text, chr(10))), 0)::BIGINT AS n_lines,
       (coalesce(len(string_split(text, chr(10))), 0) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(left_text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
""",
    "op9_license_scans": rf"""
WITH t AS (SELECT * FROM (VALUES {TEMPLATES_SQL}) AS v(k, name, body)),
d AS (SELECT doc_id, {ASCII_LOWER.format("coalesce(text, '')")} AS low,
  (CASE WHEN doc_id % 100 = 0 THEN source WHEN doc_id % 20 = 0 THEN source || '/' || lang ELSE source || '/' || lang || '/d' || (doc_id % 13) END) AS dir,
  (CASE WHEN doc_id % 10 = 0 THEN 'LICENSE-' || doc_id ELSE doc_id || '.txt' END) AS base FROM documents),
tt AS (SELECT k, term, count(*) AS c FROM (SELECT k, unnest(regexp_extract_all(lower(body), {TERM_SQL})) AS term FROM t) GROUP BY ALL),
whole AS (SELECT doc_id, regexp_extract_all(low, {TERM_SQL}) AS words FROM d),
n AS (SELECT count(*) AS n FROM d),
df AS (SELECT term, count(DISTINCT doc_id) AS c FROM (SELECT doc_id, unnest(words) AS term FROM whole) SEMI JOIN tt USING (term) GROUP BY term),
idf AS (SELECT term, ln((n + 1) / (coalesce(df.c, 0) + 1)) + 1 AS idf FROM (SELECT DISTINCT term FROM tt) LEFT JOIN df USING (term), n),
tw AS (SELECT k, term, (1 + ln(c)) * idf AS x FROM tt JOIN idf USING (term)),
tn AS (SELECT k, sqrt(sum(x * x)) AS norm FROM tw GROUP BY k),
parts AS (SELECT doc_id, i, regexp_extract_all(line, {TERM_SQL}) AS words FROM (SELECT doc_id, unnest(string_split(low, chr(10))) AS line, unnest(range(len(string_split(low, chr(10))))) AS i FROM d)),
pt AS (SELECT doc_id, i, term, (1 + ln(count(*))) AS f FROM (SELECT doc_id, i, unnest(words) AS term FROM parts) GROUP BY ALL),
pw AS (SELECT doc_id, i, pt.term, f * coalesce(idf, (SELECT ln(n + 1) + 1 FROM n)) AS x FROM pt LEFT JOIN idf USING (term)),
pn AS (SELECT doc_id, i, sqrt(sum(x * x)) AS norm FROM pw GROUP BY ALL),
s AS (SELECT doc_id, i, k, round(dot / (pn.norm * tn.norm), 9) AS score FROM (SELECT doc_id, i, k, sum(pw.x * tw.x) AS dot FROM pw JOIN tw USING (term) GROUP BY ALL) JOIN pn USING (doc_id, i) JOIN tn USING (k)),
own AS (SELECT doc_id, name AS own_license, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY name IN ({WEAK_SQL}), score DESC, i, k) AS r FROM s JOIN t USING (k) WHERE score >= {THRESHOLD}) WHERE r = 1),
f AS (SELECT doc_id, dir, dir || '/' || base AS path, base LIKE 'LICENSE%' AS gives, own_license, coalesce(score, 0) AS own_score FROM d LEFT JOIN own USING (doc_id)),
g AS (SELECT dir AS above, doc_id AS from_id, own_license AS from_license FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY own_license IN ({WEAK_SQL}), own_score DESC, doc_id) AS r FROM f WHERE gives AND own_license IS NOT NULL) WHERE r = 1),
near AS (SELECT doc_id, from_id, from_license FROM (SELECT doc_id, from_id, from_license, row_number() OVER (PARTITION BY doc_id ORDER BY length(above) DESC) AS r FROM f JOIN g ON f.dir = above OR starts_with(f.dir, above || '/')) WHERE r = 1)
SELECT f.doc_id, path, own_license, round(own_score, 6) AS own_score, coalesce(own_license, from_license) AS license, CASE WHEN own_license IS NULL THEN from_id ELSE f.doc_id END AS license_from FROM f LEFT JOIN near USING (doc_id)
""",
    "op10_substring_dedup": rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
win AS (SELECT * FROM (SELECT doc_id, i, {joined_sql(13)} AS seq FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)) WHERE seq IS NOT NULL),
dup AS (SELECT doc_id, i FROM win JOIN (SELECT seq, min(doc_id) AS least FROM win GROUP BY seq) USING (seq) WHERE doc_id > least),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS place FROM dup),
kept AS (SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.i) AS left_text, count(*) AS n
         FROM p ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.place GROUP BY p.doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(left_text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
""",
}
