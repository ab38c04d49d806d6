"""The robustness grid and the score caches: variants beside rows, aligned by row_id, never by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.operators.skew import bucket_rank

#: Cells that a grid may have.
MOST_CELLS = 1000


def usable() -> Column:
    return F.col("done") & F.col("score").isNotNull() & ~F.isnan("score")


def one_score(cache: DataFrame) -> DataFrame:
    """One row per (manifest, model, variant, row_id): the largest usable score of repeated keys, null if none is usable."""
    return cache.groupBy("manifest", "model", "variant", "row_id").agg(F.max(F.when(usable(), F.col("score"))).alias("score"), F.bool_or("done").alias("done"))


def with_fallback(scores: DataFrame, fallback: float = 0.5) -> DataFrame:
    """What a sink writes that knows no missing score."""
    return scores.withColumn("score", F.coalesce("score", F.lit(fallback)))


def beside_cells(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Every row at every cell; the cells (fifteen) are exploded beside the row, so nothing is joined."""
    listed = [r.asDict() for r in cells.orderBy("family", "severity_rank").limit(MOST_CELLS + 1).collect()]
    if len(listed) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells")
    each = F.array(*[F.struct(*[F.lit(r[c]).cast(t).alias(c) for c, t in cells.dtypes]) for r in listed])
    return rows.select("*", F.explode(each).alias("_c")).select(*rows.columns, "_c.*")


def beside_crops(rows: DataFrame, crops: int) -> DataFrame:
    return rows.withColumn("crop_pos", F.explode(F.sequence(F.lit(0), F.lit(crops - 1))))


def variants(cache: DataFrame) -> DataFrame:
    """The cached variants, clean first, by family and value."""
    family, value = F.regexp_extract("variant", r"^([a-z_]+)", 1), F.regexp_extract("variant", r"([\d.]+)$", 1).try_cast("double")
    found = cache.where("variant IS NOT NULL").select("variant").distinct()
    return found.select("variant", family.alias("family"), value.alias("value")).orderBy(F.col("variant") != "clean", "family", "value")


def wide_variants(scores: DataFrame, names: list[str]) -> DataFrame:
    """Rows that have a score in every named variant, one column each."""
    wide = scores.groupBy("manifest", "model", "row_id").pivot("variant", names).agg(F.max("score"))
    return wide.dropna("any", subset=names)


def variant_or_clean(scores: DataFrame, variant: str) -> DataFrame:
    """The score of a variant, else the clean one."""
    picked = scores.where(F.col("variant").isin(variant, "clean"))
    v, c = (F.max(F.when(F.col("variant") == x, F.col("score"))) for x in (variant, "clean"))
    return picked.groupBy("manifest", "model", "row_id").agg(F.coalesce(v, c).alias("score"), v.isNull().alias("fell_back")).where("score IS NOT NULL")


def positions(rows: DataFrame, key: str, ident: str) -> DataFrame:
    """A row's place in its manifest by id, from 0; ids are counted in runs of 4096, which are ordered one by one."""
    placed = bucket_rank(rows.select(key, ident).distinct(), [key], F.col(ident), F.floor(F.col(ident) / 4096))
    return placed.select(key, ident, (F.col("place") - 1).alias("position"))


def plan_estimate(steps: DataFrame, crops: int = 3, crops_per_second: float = 30.0, images_per_second: float = 30.0) -> DataFrame:
    """(step, rows, variants, experts) with the seconds that features and scores of each step would take."""
    feature = F.col("rows") * crops * F.col("variants") / crops_per_second
    score = F.col("rows") * F.col("variants") * F.col("experts") / images_per_second
    return steps.select("*", F.round(feature, 6).alias("feature_seconds"), F.round(score, 6).alias("score_seconds"), F.round(feature + score, 6).alias("seconds"))
