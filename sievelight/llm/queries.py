"""Queries of the operators in this package and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.llm import history, leaks, mojibake, overlap, percentiles, proportions, splits, tokens
from sievelight.plans import normal_sql as N
from sievelight.session import materialise


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return history.found(_read(spark, d, "manifest"))


def p1_clusters(spark: SparkSession, d: str) -> DataFrame:
    return history.clusters(_read(spark, d, "manifest"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return proportions.report(_read(spark, d, "manifest"), _read(spark, d, "sample_targets")).where("unmet").select("plan_id", "category")


def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    return proportions.sample(_read(spark, d, "manifest"), _read(spark, d, "sample_targets"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return proportions.report(_read(spark, d, "manifest"), _read(spark, d, "sample_targets")).select("plan_id", "by_field", "category", "supply", "wanted", "unmet")


def p2_shares(spark: SparkSession, d: str) -> DataFrame:
    """The whole report: per target also how many records are drawn, and their share of the sample."""
    return proportions.report(_read(spark, d, "manifest"), _read(spark, d, "sample_targets"))


def p2_check(spark: SparkSession, d: str) -> DataFrame:
    """Per target whether the sample holds what was reported and keeps the floor, and how many records it draws twice."""
    return proportions.sample_check(_read(spark, d, "manifest"), _read(spark, d, "sample_targets"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.torn_groups(_read(spark, d, "manifest"))


def p3_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.new_splits(_read(spark, d, "manifest"), _read(spark, d, "split_targets"))


def p3_shares(spark: SparkSession, d: str) -> DataFrame:
    """Per split whether its share of rows lies within tolerance, and how many groups are torn."""
    return splits.shares(_read(spark, d, "manifest"), _read(spark, d, "split_targets")).select("split", "within", "torn")


QUANTILES = [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99]


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Per group, with what is kept per day put together: value, n and the stated bound of each percentile's rank."""
    kept = materialise(percentiles.daily(_read(spark, d, "manifest"), _read(spark, d, "predictions")), "daily")
    return percentiles.named(percentiles.over_all_days(kept, QUANTILES))


def p4_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Whether every stated bound holds, counted over all rows."""
    manifest, predictions = _read(spark, d, "manifest"), _read(spark, d, "predictions")
    estimates = materialise(percentiles.over_all_days(percentiles.daily(manifest, predictions), QUANTILES), "estimates")
    held = percentiles.bounds_hold(estimates, manifest, predictions)
    return percentiles.named(held)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.found(_read(spark, d, "manifest"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(_read(spark, d, "manifest"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(_read(spark, d, "documents"))


def p7_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Whether each document's ids decode to its text."""
    documents = _read(spark, d, "documents")
    decoded = tokens.decode(materialise(tokens.encode(documents), "ids")).withColumnRenamed("text", "decoded")
    return documents.select("doc_id", "text").join(decoded, "doc_id").select("doc_id", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("same"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(_read(spark, d, "documents"), _read(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_near(spark: SparkSession, d: str) -> DataFrame:
    """Documents with nearly whole items in them, also where a word or two were changed."""
    return leaks.near_leaks(_read(spark, d, "documents"), _read(spark, d, "eval_items")).select("doc_id", "item_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.judged(_read(spark, d, "documents")).select("doc_id")


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    """The garbled documents' texts with every word restored that can be."""
    return mojibake.restored(_read(spark, d, "documents"))


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    """Per chain of encodings how many garbled documents were found and how many restored throughout."""
    return mojibake.rates(_read(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_clusters, p2_found, p2_sample, p2_report, p2_shares, p2_check, p3_found, p3_splits, p3_shares, p4_percentiles, p4_bounds, p5_found, p5_report, p7_ids, p7_roundtrip, p8_found, p8_near, p9_found, p9_restored, p9_rates)}

P2 = f"""
WITH pool AS (SELECT {N.sha()} AS sha, CAST(label AS VARCHAR) AS label, {N.name("generator")} AS generator, {N.name("source")} AS source FROM manifest WHERE {N.split()} = 'train'),
long AS (SELECT sha, 'label' AS f, label AS v FROM pool UNION ALL SELECT sha, 'generator', generator FROM pool UNION ALL SELECT sha, 'source', source FROM pool),
supply AS (SELECT f, v, count(DISTINCT sha) AS n FROM long WHERE sha IS NOT NULL GROUP BY 1, 2),
t AS (SELECT *, CASE WHEN by_field = 'label' THEN trim(category) ELSE {N.name("category")} END AS v FROM sample_targets)
SELECT plan_id, category FROM t LEFT JOIN supply ON supply.f = t.by_field AND supply.v = t.v
WHERE coalesce(n, 0) < greatest(min_rows, floor(target_share * sample_size + 0.5))"""

P2_REPORT = P2[: P2.index("SELECT plan_id, category")] + """SELECT plan_id, by_field, category, coalesce(n, 0) AS supply, CAST(greatest(min_rows, floor(target_share * sample_size + 0.5)) AS BIGINT) AS wanted,
 coalesce(n, 0) < greatest(min_rows, floor(target_share * sample_size + 0.5)) AS unmet FROM t LEFT JOIN supply ON supply.f = t.by_field AND supply.v = t.v"""

P2_CHECK = "SELECT plan_id, by_field, category, true AS as_reported, true AS floor_kept, CAST(0 AS BIGINT) AS repeated FROM sample_targets"

P3_SHARES = "SELECT split, true AS within, CAST(0 AS BIGINT) AS torn FROM split_targets"

P3 = f"""
WITH r AS (SELECT row_id, {N.name("source")} AS s, {N.name("generator")} AS g, {N.split()} AS sp FROM manifest)
SELECT min(row_id) AS group_row_id FROM r WHERE s IS NOT NULL AND g IS NOT NULL GROUP BY s, g HAVING count(DISTINCT sp) >= 2"""

#: Five blocks of 12 or 13 bits: of two values within four bits, one block is equal.
P5 = f"""
WITH r AS (SELECT row_id, {N.sha()} AS sha, {N.phash()} AS ph, {N.split()} AS sp FROM manifest),
e AS (SELECT * FROM r WHERE sp IN ('val', 'test_unseen', 'eval_only')), t AS (SELECT * FROM r WHERE sp = 'train'),
b AS (SELECT unnest([0, 13, 26, 39, 52]) AS lo),
ek AS (SELECT DISTINCT lo, (ph >> lo) & 8191 AS k, ph FROM e, b WHERE ph IS NOT NULL), tk AS (SELECT DISTINCT lo, (ph >> lo) & 8191 AS k, ph FROM t, b WHERE ph IS NOT NULL),
v AS (SELECT DISTINCT ek.ph AS pe, tk.ph AS pt FROM ek JOIN tk ON ek.lo = tk.lo AND ek.k = tk.k AND bit_count(xor(ek.ph, tk.ph)) <= 4),
pairs AS (SELECT e.row_id AS x, t.row_id AS y FROM e JOIN t ON e.sha = t.sha
 UNION SELECT e.row_id, t.row_id FROM v JOIN e ON e.ph = v.pe JOIN t ON t.ph = v.pt)
SELECT least(x, y) AS row_id_a, greatest(x, y) AS row_id_b FROM pairs"""

P5_REPORT = f"""WITH pairs AS ({P5}),
m AS (SELECT row_id, {N.split()} AS split, {N.name("source")} AS source, {N.sha()} AS sha, {N.phash()} AS ph FROM manifest),
p AS (SELECT e.split, e.source, e.row_id AS re, t.row_id AS rt, coalesce(e.sha = t.sha, false) AS same, coalesce(bit_count(xor(e.ph, t.ph)) <= 4, false) AS near
 FROM pairs JOIN m AS x ON x.row_id = row_id_a JOIN m AS e ON e.row_id = CASE WHEN x.split = 'train' THEN row_id_b ELSE row_id_a END JOIN m AS t ON t.row_id = CASE WHEN x.split = 'train' THEN row_id_a ELSE row_id_b END)
SELECT split, source, count(*) AS pairs, count(*) FILTER (same) AS pairs_same, count(*) FILTER (near) AS pairs_near, count(DISTINCT re) AS rows_evaluation, count(DISTINCT rt) AS rows_training FROM p GROUP BY ALL"""

P4 = f"""
WITH m AS (SELECT {N.name("source")} AS s, {N.name("generator")} AS g, CAST(width AS DOUBLE) AS width, CAST(height AS DOUBLE) AS height FROM manifest),
r AS (SELECT 'source' AS by_field, s AS name, 'width' AS metric, width AS x FROM m UNION ALL SELECT 'source', s, 'height', height FROM m
 UNION ALL SELECT 'generator', g, 'width', width FROM m UNION ALL SELECT 'generator', g, 'height', height FROM m
 UNION ALL SELECT 'condition', condition, 'pred', pred FROM predictions),
n AS (SELECT by_field, name, metric, count(*) AS n FROM r WHERE x IS NOT NULL AND NOT isnan(x) GROUP BY ALL)
SELECT by_field, name, metric, CAST(q AS DOUBLE) AS q, n, true AS holds FROM n, (SELECT unnest([0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99]) AS q)"""

P7 = "SELECT doc_id, true AS same FROM documents"

#: Words joined by single spaces, so that a run of words is a substring.
P8 = """
WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda x: lower(x)) AS w FROM documents),
i AS (SELECT item_id, list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda x: lower(x)) AS w FROM eval_items),
iw AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS run FROM i, unnest(range(1, len(w) - 10)) AS t(k) WHERE len(w) >= 12),
dw AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 11], ' ') AS run FROM d, unnest(range(1, len(w) - 10)) AS t(k) WHERE len(w) >= 12)
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (run)"""

ORACLES = {"p2_report": P2_REPORT, "p2_check": P2_CHECK, "p3_shares": P3_SHARES, "p5_report": P5_REPORT, "p7_roundtrip": P7, "p8_found": P8, "p4_bounds": P4, "p2_found": P2, "p3_found": P3, "p5_found": P5}
