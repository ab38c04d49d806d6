"""Problem 6: a few keys hold most records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievelight.operators.hotkeys import key_profile
from sievelight.plans import normal_sql as N


def p6_key_profile(spark: SparkSession, d: str) -> DataFrame:
    return key_profile(spark.read.parquet(f"{d}/manifest.parquet"), spark.read.parquet(f"{d}/predictions.parquet"))


def _profile_sql() -> str:
    q = ", ".join(f"round(quantile_cont({m}, {x}), 8) AS {m}_q{round(x * 100)}" for m in ("width", "height") for x in (0.1, 0.5, 0.9))
    p = ", ".join(f"round(quantile_cont(pred, {x}), 8) AS pred_q{round(x * 100)}" for x in (0.1, 0.5, 0.9))
    return f"""
WITH b AS (SELECT row_id, label, width, height, coalesce({N.name("source")}, '') AS source, coalesce({N.name("generator")}, '') AS generator FROM manifest),
r AS (SELECT 'source' AS by_field, source AS name, * FROM b UNION ALL SELECT 'generator', generator, * FROM b),
p AS (SELECT DISTINCT pred_id, row_id, pred FROM predictions WHERE pred IS NOT NULL AND NOT isnan(pred)),
s AS (SELECT by_field, name, p.pred FROM p JOIN r USING (row_id)),
counts AS (SELECT by_field, name, count(*) AS rows, count(*) FILTER (label = 0) AS n_authentic, count(*) FILTER (label = 1) AS n_generated,
 min(width) AS width_min, max(width) AS width_max, min(height) AS height_min, max(height) AS height_max,
 round(CAST(sum(width) AS DOUBLE) / count(width), 4) AS width_mean, round(CAST(sum(height) AS DOUBLE) / count(height), 4) AS height_mean, {q}
 FROM r GROUP BY 1, 2),
scores AS (SELECT by_field, name, count(*) AS n_scores, round(CAST(sum(CAST(pred AS DECIMAL(24, 6))) AS DOUBLE) / count(*), 6) AS pred_mean, min(pred) AS pred_min, max(pred) AS pred_max, {p} FROM s GROUP BY 1, 2)
SELECT counts.by_field, nullif(counts.name, '') AS name, counts.* EXCLUDE (by_field, name), coalesce(n_scores, 0) AS n_scores,
 scores.* EXCLUDE (by_field, name, n_scores), round(CAST(n_generated AS DOUBLE) / rows, 6) AS share_generated, round(CAST(n_authentic AS DOUBLE) / rows, 6) AS share_authentic
FROM counts LEFT JOIN scores ON counts.by_field = scores.by_field AND counts.name = scores.name"""


QUERIES = {"p6_key_profile": p6_key_profile}
ORACLES = {"p6_key_profile": _profile_sql()}
