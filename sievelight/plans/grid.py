"""Queries on score caches and the robustness grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.operators import grid as G
from sievelight.operators import metrics as M
from sievelight.plans.evaluation import CLEAN, LATEST, clean

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def cache(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/score_cache.parquet")


ONE = """WITH o AS (SELECT manifest, model, variant, row_id, max(CASE WHEN done AND NOT isnan(score) THEN score END) AS score, bool_or(done) AS done FROM score_cache GROUP BY 1, 2, 3, 4)"""


@query(f"{ONE} SELECT row_id, coalesce(score, 0.5) AS score, done FROM o WHERE manifest = 'train_manifest' AND model = 'dinov3_l' AND variant = 'clean'")
def src_score_cache(spark, d):
    """One cache: pushed down to the files by its three keys; missing scores as the fallback."""
    some = cache(spark, d).where("manifest = 'train_manifest' AND model = 'dinov3_l' AND variant = 'clean'")
    return G.with_fallback(G.one_score(some)).select("row_id", "score", "done")


@query("SELECT vec_id, len(embedding) AS dim, round(list_sum(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))), 6) > 0 AS ready FROM embeddings")
def src_feature_cache(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.abs(x.cast("double")))
    return e.select("vec_id", F.size("embedding").cast("bigint").alias("dim"), (F.round(total, 6) > 0).alias("ready"))


@query("SELECT DISTINCT variant, regexp_extract(variant, '^([a-z_]+)', 1) AS family, TRY_CAST(nullif(regexp_extract(variant, '([0-9.]+)$', 1), '') AS DOUBLE) AS value FROM score_cache WHERE variant IS NOT NULL")
def src_cache_discovery(spark, d):
    return G.variants(cache(spark, d))


@query(f"{ONE} SELECT o.model, o.variant, m.row_id, m.label, o.score FROM o JOIN manifest m USING (row_id) WHERE o.score IS NOT NULL")
def join_positional_scores(spark, d):
    m = spark.read.parquet(f"{d}/manifest.parquet").select("row_id", "label")
    return G.one_score(cache(spark, d)).where("score IS NOT NULL").join(m, "row_id").select("model", "variant", "row_id", "label", "score")


NAMES = ["clean", "jpeg60", "blur1.5"]


@query(f"""{ONE}, w AS (SELECT manifest, model, row_id, max(score) FILTER (variant = 'clean') AS "clean", max(score) FILTER (variant = 'jpeg60') AS jpeg60, max(score) FILTER (variant = 'blur1.5') AS blur1_5 FROM o GROUP BY 1, 2, 3)
SELECT * FROM w WHERE "clean" IS NOT NULL AND jpeg60 IS NOT NULL AND blur1_5 IS NOT NULL""")
def join_variant_features(spark, d):
    named = G.one_score(cache(spark, d)).withColumn("variant", F.replace("variant", F.lit("."), F.lit("_")))
    return G.wide_variants(named, [n.replace(".", "_") for n in NAMES])


@query(f"""{ONE}, w AS (SELECT manifest, model, row_id, max(score) FILTER (variant = 'jpeg60') AS v, max(score) FILTER (variant = 'clean') AS c FROM o WHERE variant IN ('clean', 'jpeg60') GROUP BY 1, 2, 3)
SELECT manifest, model, row_id, coalesce(v, c) AS score, v IS NULL AS fell_back FROM w WHERE coalesce(v, c) IS NOT NULL""")
def join_variant_fallback(spark, d):
    return G.variant_or_clean(G.one_score(cache(spark, d)), "jpeg60")


@query("SELECT manifest, row_id, row_number() OVER (PARTITION BY manifest ORDER BY row_id) - 1 AS position FROM (SELECT DISTINCT manifest, row_id FROM score_cache)")
def join_row_to_position(spark, d):
    return G.positions(cache(spark, d), "manifest", "row_id")


@query("""WITH m AS (SELECT replace(path, '\\', '/') AS p, min(label) AS label FROM manifest WHERE path IS NOT NULL GROUP BY 1)
SELECT p.pred_id, m.label FROM (SELECT DISTINCT pred_id, image_path FROM predictions) p LEFT JOIN m ON m.p = replace(p.image_path, '\\', '/')""")
def join_labels_by_path(spark, d):
    fwd = lambda c: F.replace(c, F.lit("\\"), F.lit("/"))
    m = spark.read.parquet(f"{d}/manifest.parquet").where("path IS NOT NULL").groupBy(fwd("path").alias("p")).agg(F.min("label").alias("label"))
    p = spark.read.parquet(f"{d}/predictions.parquet").select("pred_id", "image_path").distinct()
    return p.join(m, fwd("image_path") == F.col("p"), "left").select("pred_id", "label")


@query("""WITH a AS (SELECT label, count(*) AS n FROM manifest GROUP BY 1), b AS (SELECT m.label, count(*) AS n FROM (SELECT DISTINCT pred_id, row_id FROM predictions) p JOIN manifest m USING (row_id) GROUP BY 1)
SELECT CASE WHEN a.n IS NOT NULL THEN a.label ELSE b.label END AS label, coalesce(a.n, 0) AS manifest, coalesce(b.n, 0) AS predictions FROM a FULL JOIN b ON a.label IS NOT DISTINCT FROM b.label""")
def join_concat_columns(spark, d):
    """Counts of two tables side by side."""
    m = spark.read.parquet(f"{d}/manifest.parquet").select("row_id", "label")
    p = spark.read.parquet(f"{d}/predictions.parquet").select("pred_id", "row_id").distinct()
    counts = m.groupBy("label").agg(F.count("*").alias("manifest"), F.lit(0).cast("bigint").alias("predictions"))
    scored = p.join(m, "row_id").groupBy("label").agg(F.lit(0).cast("bigint").alias("manifest"), F.count("*").alias("predictions"))
    return counts.unionByName(scored).groupBy("label").agg(F.sum("manifest").alias("manifest"), F.sum("predictions").alias("predictions"))


@query("SELECT row_id, family, value, label, severity_rank FROM (SELECT row_id FROM manifest), degradation_cells")
def join_cross_grid(spark, d):
    rows = spark.read.parquet(f"{d}/manifest.parquet").select("row_id")
    return G.beside_cells(rows, spark.read.parquet(f"{d}/degradation_cells.parquet"))


@query("SELECT row_id, CAST(unnest([0, 1, 2]) AS INT) AS crop_pos FROM manifest")
def join_cross_crops(spark, d):
    return G.beside_crops(spark.read.parquet(f"{d}/manifest.parquet").select("row_id"), 3)


@query(f"{CLEAN} SELECT row_id, expert, CAST(t AS DOUBLE) AS threshold, CAST(p >= t AS INT) AS decision FROM c, (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9]) AS t)")
def join_cross_thresholds(spark, d):
    at = clean(spark, d).withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in (0.1, 0.3, 0.5, 0.7, 0.9)])))
    return at.select("row_id", "expert", "threshold", (F.col("p") >= F.col("threshold")).cast("int").alias("decision"))


@query("SELECT DISTINCT p.pred_id, p.condition, coalesce(c.severity_rank, 1) AS severity_rank FROM predictions p LEFT JOIN degradation_cells c ON c.label = p.condition")
def prj_severity_rank(spark, d):
    cells = spark.read.parquet(f"{d}/degradation_cells.parquet").select(F.col("label").alias("condition"), "severity_rank")
    p = spark.read.parquet(f"{d}/predictions.parquet").select("pred_id", "condition").distinct()
    return p.join(F.broadcast(cells), "condition", "left").select("pred_id", "condition", F.coalesce("severity_rank", F.lit(1)).alias("severity_rank"))  # fifteen cells


CONDITIONS = {"clean": "clean", "jpeg=60": "jpeg_60", "blur=1.5": "blur_1_5", "noise=0.08": "noise_0_08"}


@query(f"""WITH {LATEST} SELECT row_id, {', '.join(f"max(dinov3_l) FILTER (condition = '{c}' AND NOT isnan(dinov3_l)) AS {n}" for c, n in CONDITIONS.items())} FROM latest WHERE condition IN {tuple(CONDITIONS)} GROUP BY 1""")
def sink_predictions_wide(spark, d):
    """One row per image, one column per condition."""
    name = F.lit(None).cast("string")
    for c, n in CONDITIONS.items():
        name = F.when(F.col("condition") == c, n).otherwise(name)
    last = M.latest(spark.read.parquet(f"{d}/predictions.parquet").where(F.col("condition").isin(*CONDITIONS)))
    return last.withColumn("c", name).groupBy("row_id").pivot("c", list(CONDITIONS.values())).agg(F.max(F.when(~F.isnan("dinov3_l"), F.col("dinov3_l"))))


@query("""WITH s AS (SELECT manifest AS step, count(DISTINCT row_id) AS rows, count(DISTINCT variant) AS variants, count(DISTINCT model) AS experts FROM score_cache GROUP BY 1)
SELECT *, round(rows * 3 * variants / 30.0, 6) AS feature_seconds, round(rows * variants * experts / 30.0, 6) AS score_seconds, round(rows * 3 * variants / 30.0 + rows * variants * experts / 30.0, 6) AS seconds FROM s""")
def agg_plan_estimate(spark, d):
    steps = cache(spark, d).groupBy(F.col("manifest").alias("step")).agg(F.count_distinct("row_id").alias("rows"), F.count_distinct("variant").alias("variants"), F.count_distinct("model").alias("experts"))
    return G.plan_estimate(steps)
