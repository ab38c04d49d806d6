"""Queries on the manifest: validation, duplicates, quarantine, summaries, filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.operators import curate as C
from sievelight.operators import metrics as M
from sievelight.operators import nearest as P
from sievelight.plans import normal_sql as N

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def raw(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/manifest.parquet")


def rows(spark: SparkSession, d: str) -> DataFrame:
    return C.catalog(raw(spark, d))


CAT = f"""WITH cat AS (SELECT row_id, path, CASE WHEN label IN (0, 1) THEN label END AS label, {N.name('source')} AS source, {N.name('generator')} AS generator,
 {N.split()} AS split, {N.sha()} AS sha, {N.phash()} AS ph, width, height FROM manifest)"""
PREC = "CASE split WHEN 'eval_only' THEN 0 WHEN 'test_unseen' THEN 1 WHEN 'held' THEN 2 WHEN 'val' THEN 3 WHEN 'train' THEN 4 ELSE 99 END"


@query(f"""{CAT} SELECT source, split, label, count(*) AS n, median(width) AS median_width, median(height) AS median_height,
 min(least(width, height)) AS min_side, max(greatest(width, height)) AS max_side, count(DISTINCT generator) AS generators FROM cat GROUP BY 1, 2, 3""")
def agg_manifest_summary(spark, d):
    return C.summary(rows(spark, d))


@query(f"{CAT} SELECT sha, count(DISTINCT split) AS splits, count(*) AS rows FROM cat WHERE sha IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1")
def agg_cross_split(spark, d):
    return C.straddling(rows(spark, d))


@query(f"{CAT} SELECT row_id, split FROM (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY {PREC}, row_id) AS r FROM cat) WHERE sha IS NULL OR r = 1")
def win_dedup_precedence(spark, d):
    return C.dedup_parity(rows(spark, d)).select("row_id", "split")


@query(f"{CAT} SELECT row_id, split FROM (SELECT *, min({PREC}) OVER (PARTITION BY sha) AS k FROM cat) WHERE sha IS NULL OR {PREC} = k")
def join_chosen_split(spark, d):
    """Rows in the split chosen for their hash; duplicates within it stay."""
    return C.dedup_splits(rows(spark, d), within_split=False).select("row_id", "split")


SHA_HIT = "coalesce(split, '') <> 'eval_only' AND sha IN (SELECT sha FROM cat WHERE split = 'eval_only' AND sha IS NOT NULL)"


@query(f"{CAT} SELECT row_id, path, split FROM cat WHERE {SHA_HIT}")
def join_semi_sha(spark, d):
    return C.quarantined_by_sha(rows(spark, d)).select("row_id", "path", "split")


NEAR = f"""{CAT}, listed AS (SELECT ph, min(row_id) AS match_id FROM cat WHERE split = 'eval_only' AND ph IS NOT NULL GROUP BY 1),
near AS (SELECT row_id, min(struct_pack(d := CAST(bit_count(xor(cat.ph, listed.ph)) AS BIGINT), m := match_id)) AS b FROM cat, listed
 WHERE coalesce(split, '') <> 'eval_only' AND cat.ph IS NOT NULL AND bit_count(xor(cat.ph, listed.ph)) <= 10 GROUP BY 1)"""


@query(f"{NEAR} SELECT row_id, b.d AS distance, b.m AS match_id FROM near")
def join_range_phash(spark, d):
    """Nearest evaluation-only image within 10 bits of every other row."""
    data = rows(spark, d)
    return P.nearest_hash(data.where(C.trainable()), P.eval_only_list(data))


@query(f"""{NEAR}, hits AS (SELECT row_id, split, CASE WHEN {SHA_HIT} THEN 'sha256' WHEN row_id IN (SELECT row_id FROM near) THEN 'phash' END AS reason FROM cat)
SELECT row_id, split, coalesce(reason, 'kept') AS reason FROM hits""")
def join_anti_quarantine(spark, d):
    """Every row with why it goes, the exact reason before the near one."""
    data = rows(spark, d)
    near = P.nearest_hash(data.where(C.trainable()), P.eval_only_list(data)).select("row_id", F.lit(True).alias("n"))
    exact = C.quarantined_by_sha(data).select("row_id", F.lit(True).alias("s"))
    joined = data.select("row_id", "split").join(exact, "row_id", "left").join(near, "row_id", "left")
    return joined.select("row_id", "split", F.when(F.col("s"), "sha256").when(F.col("n"), "phash").otherwise("kept").alias("reason"))


BALANCE = """counts AS (SELECT split, label, count(*) AS c FROM cat WHERE split IS NOT NULL AND label IS NOT NULL AND split NOT IN ('eval_only', 'held') GROUP BY 1, 2),
bal AS (SELECT split, CAST(sum(c) AS BIGINT) AS n, count(*) AS classes, round(max(c) / CAST(sum(c) AS DOUBLE), 9) AS largest_share FROM counts GROUP BY 1),
balance AS (SELECT *, CASE WHEN classes < 2 THEN 'single_class' WHEN largest_share > 0.6 THEN 'imbalanced' END AS problem FROM bal)"""


@query(f"{CAT}, {BALANCE} SELECT * FROM balance")
def agg_class_balance(spark, d):
    return C.class_balance(rows(spark, d))


@query(f"""{NEAR}, {BALANCE}, v AS (SELECT 'label' AS rule, count(*) AS n FROM cat WHERE label IS NULL UNION ALL SELECT 'split', count(*) FROM cat WHERE split IS NULL
 UNION ALL SELECT 'size', count(*) FROM cat WHERE width <= 0 OR height <= 0 UNION ALL SELECT 'sha256', count(*) FROM cat WHERE sha IS NULL
 UNION ALL SELECT 'leakage', count(*) FROM (SELECT sha FROM cat WHERE sha IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1)
 UNION ALL SELECT 'contamination_sha256', count(*) FROM cat WHERE {SHA_HIT} UNION ALL SELECT 'contamination_phash', count(*) FROM near
 UNION ALL SELECT problem || ':' || split, n FROM balance WHERE problem IS NOT NULL) SELECT * FROM v WHERE n > 0""")
def agg_validate(spark, d):
    data = rows(spark, d)
    return C.violations(raw(spark, d), P.nearest_hash(data.where(C.trainable()), P.eval_only_list(data)))


@query(f"""SELECT 'label' AS field, CAST(label AS VARCHAR) AS value, count(*) AS n FROM manifest WHERE label IS NULL OR label NOT IN (0, 1) GROUP BY 2
UNION ALL SELECT 'split', split, count(*) FROM manifest WHERE {N.split()} IS NULL GROUP BY 2""")
def set_bad_values(spark, d):
    data = raw(spark, d)
    label = data.where(F.col("label").isNull() | ~F.col("label").isin(0, 1)).groupBy(F.col("label").cast("string").alias("value")).agg(F.count("*").alias("n"))
    split = data.where(C.split_of(F.col("split")).isNull()).groupBy(F.col("split").alias("value")).agg(F.count("*").alias("n"))
    return label.select(F.lit("label").alias("field"), "value", "n").unionByName(split.select(F.lit("split").alias("field"), "value", "n"))


@query(f"""{CAT} SELECT count(*) AS rows, count(DISTINCT sha) AS hashes, count(sha) - count(DISTINCT sha) AS duplicates,
 count(*) FILTER ({SHA_HIT}) AS collisions, count(*) FILTER (label = 0) AS authentic, count(*) FILTER (label = 1) AS generated FROM cat""")
def agg_prep_report(spark, d):
    return C.prep_report(rows(spark, d))


@query(f"{CAT} SELECT label, {', '.join(f'count(*) FILTER (split = {chr(39)}{s}{chr(39)}) AS {s}' for s in N.SPLITS)} FROM cat GROUP BY 1")
def agg_label_counts(spark, d):
    return rows(spark, d).groupBy("label").pivot("split", list(N.SPLITS)).count().fillna(0, subset=list(N.SPLITS))


@query(f"""{CAT}, g AS (SELECT coalesce(source, 'unknown') || ' / ' || coalesce(generator, 'unknown') AS diversity_group, count(*) FILTER (label = 0) AS authentic, count(*) FILTER (label = 1) AS generated FROM cat GROUP BY 1)
SELECT * FROM g ORDER BY authentic DESC, generated DESC, diversity_group LIMIT 20""")
def agg_crosstab(spark, d):
    g = F.concat_ws(" / ", F.coalesce("source", F.lit("unknown")), F.coalesce("generator", F.lit("unknown"))).alias("diversity_group")
    counts = rows(spark, d).groupBy(g).agg(F.count_if(F.col("label") == 0).alias("authentic"), F.count_if(F.col("label") == 1).alias("generated"))
    return counts.orderBy(F.desc("authentic"), F.desc("generated"), "diversity_group").limit(20)


@query(f"{CAT} SELECT source, split, path, row_id FROM cat ORDER BY source, split, path, row_id")
def sort_manifest(spark, d):
    return rows(spark, d).select("source", "split", "path", "row_id").orderBy("source", "split", "path", "row_id")


@query(f"{CAT} SELECT row_id, path FROM cat WHERE split = 'val'")
def flt_split(spark, d):
    return rows(spark, d).where("split = 'val'").select("row_id", "path")


@query(f"{CAT} SELECT row_id, split FROM cat WHERE coalesce(split, '') <> 'eval_only'")
def flt_trainable(spark, d):
    return rows(spark, d).where(C.trainable()).select("row_id", "split")


@query("""WITH n AS (SELECT manifest, count(DISTINCT variant) AS k FROM score_cache GROUP BY 1),
r AS (SELECT manifest, row_id, count(DISTINCT variant) AS v, bool_and(done AND score IS NOT NULL AND NOT isnan(score) AND score <> 0) AS ok FROM score_cache GROUP BY 1, 2)
SELECT r.manifest, row_id FROM r JOIN n USING (manifest) WHERE v = k AND ok""")
def flt_ready(spark, d):
    """Rows that are done, with a usable score, in every variant of their manifest."""
    c = spark.read.parquet(f"{d}/score_cache.parquet")
    n = c.groupBy("manifest").agg(F.count_distinct("variant").alias("k"))
    good = F.col("done") & F.col("score").isNotNull() & ~F.isnan("score") & (F.col("score") != 0)
    r = c.groupBy("manifest", "row_id").agg(F.count_distinct("variant").alias("v"), F.bool_and(good).alias("ok"))
    return r.join(F.broadcast(n), "manifest").where("v = k AND ok").select("manifest", "row_id")


GOOD = " AND ".join(f"{e} IS NOT NULL AND NOT isnan({e})" for e in M.EXPERTS)


@query(f"SELECT DISTINCT pred_id, row_id, condition FROM predictions WHERE {GOOD}")
def flt_scored(spark, d):
    """Scorings in which no expert's score is missing."""
    p = spark.read.parquet(f"{d}/predictions.parquet")
    return p.replace(float("nan"), None, subset=list(M.EXPERTS)).dropna("any", subset=list(M.EXPERTS)).select("pred_id", "row_id", "condition").distinct()


@query("SELECT DISTINCT p.pred_id, p.row_id, m.label, p.pred FROM predictions p JOIN manifest m USING (row_id) WHERE m.label IN (0, 1) AND p.pred IS NOT NULL AND NOT isnan(p.pred)")
def flt_labelled(spark, d):
    p = spark.read.parquet(f"{d}/predictions.parquet").where("pred IS NOT NULL AND NOT isnan(pred)").select("pred_id", "row_id", "pred")
    return p.join(raw(spark, d).where("label IN (0, 1)").select("row_id", "label"), "row_id").select("pred_id", "row_id", "label", "pred").distinct()


@query("SELECT DISTINCT replace(path, '\\', '/') AS path FROM manifest WHERE path IS NOT NULL")
def set_dedup_paths(spark, d):
    return raw(spark, d).where("path IS NOT NULL").select(F.replace("path", F.lit("\\"), F.lit("/")).alias("path")).dropDuplicates(["path"])


@query(f"{CAT} SELECT generator, CAST(sum(CAST(width AS BIGINT) * height) AS BIGINT) AS bytes, count(*) AS n FROM cat WHERE width > 0 AND height > 0 GROUP BY 1")
def agg_bytes_by_generator(spark, d):
    """Size and number of a generator's images; pixels stand for bytes."""
    good = rows(spark, d).where("width > 0 AND height > 0")
    return good.groupBy("generator").agg(F.sum(F.col("width").cast("bigint") * F.col("height")).alias("bytes"), F.count("*").alias("n")).orderBy(F.desc("n"))


@query("SELECT unnest(['community_forensics_pr', 'dinov3_l_pr']) AS missing")
def set_missing_columns(spark, d):
    """Columns wanted of a table but not in it."""
    wanted = ["row_id", "condition", "community_forensics_pr", "dinov3_l_pr"]
    have = set(spark.read.parquet(f"{d}/predictions.parquet").columns)
    return spark.createDataFrame([(c,) for c in wanted if c not in have], "missing string")


@query(f"{CAT} SELECT source, split, CAST(label AS INT) AS label, count(*) AS n, grouping_id(source, split, label) AS level FROM cat GROUP BY ROLLUP (source, split, label)")
def ext_rollup(spark, d):
    """An extension: summary counts with their subtotals."""
    return rows(spark, d).rollup("source", "split", "label").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
