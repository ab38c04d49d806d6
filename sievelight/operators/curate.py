"""Curation of an image manifest: validation, duplicates across splits, quarantine, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.functions.normal import name_of, phash_of, sha256_of, split_of
from sievelight.operators.hotkeys import exact_quantiles
from sievelight.session import materialise

#: Which split keeps a record that lies in several; the strictest first.
PRECEDENCE = ("eval_only", "test_unseen", "held", "val", "train")
#: The largest share of one class, and the splits it doesn't bind.
MOST_OF_ONE_CLASS = 0.60
UNBOUND = ("eval_only", "held")


def catalog(manifest: DataFrame) -> DataFrame:
    """The manifest in normal form; label is 0, 1 or null."""
    return manifest.select(
        "row_id",
        "path",
        F.when(F.col("label").isin(0, 1), F.col("label")).alias("label"),
        name_of(F.col("source")).alias("source"),
        name_of(F.col("generator")).alias("generator"),
        split_of(F.col("split")).alias("split"),
        sha256_of(F.col("sha256")).alias("sha"),
        phash_of(F.col("phash")).alias("ph"),
        "width",
        "height",
    )


def trainable() -> Column:
    """All rows that aren't evaluation only: held and test_unseen are included, and rows in no split."""
    return F.coalesce(F.col("split"), F.lit("")) != "eval_only"


def rank_of_split() -> Column:
    out = F.lit(99)
    for i, s in enumerate(PRECEDENCE):
        out = F.when(F.col("split") == s, F.lit(i)).otherwise(out)
    return out


def summary(rows: DataFrame) -> DataFrame:
    """Per source, split and label; medians come from counts of values, so no group, however large, is gathered."""
    keyed = rows.withColumn("_k", F.to_json(F.struct("source", "split", "label")))  # never null, and tells a missing part from an empty one
    out = keyed.groupBy("_k", "source", "split", "label").agg(
        F.count("*").alias("n"),
        F.min(F.least("width", "height")).alias("min_side"),
        F.max(F.greatest("width", "height")).alias("max_side"),
        F.count_distinct("generator").alias("generators"),
    )
    for side in ("width", "height"):
        median = exact_quantiles(keyed.select("_k", side), ["_k"], side, [0.5]).select("_k", F.col("quantile").alias(f"median_{side}"))
        out = out.join(median, "_k", "left")
    return out.drop("_k")


def straddling(rows: DataFrame) -> DataFrame:
    """Hashes in more than one split."""
    spread = rows.where(F.col("sha").isNotNull()).groupBy("sha").agg(F.count_distinct("split").alias("splits"), F.count("*").alias("rows"))
    return spread.where("splits > 1")


def dedup_splits(rows: DataFrame, within_split: bool = True) -> DataFrame:
    """One row per hash: of the strictest split, the smallest row_id; rows without a hash stay.

    within_split=False keeps duplicates within the strictest split. The reference behaviour (duplicates within a split
    survive unless any hash straddles splits) is ``dedup_parity``.
    """
    best = F.min(F.struct(rank_of_split().alias("k"), "row_id")).alias("best")
    kept = rows.where(F.col("sha").isNotNull()).groupBy("sha").agg(best)
    bare = rows.where(F.col("sha").isNull())
    if within_split:
        chosen = kept.select(F.col("best.row_id").alias("row_id"))
        return rows.join(chosen, "row_id", "left_semi").unionByName(bare)
    joined = rows.join(kept.select("sha", F.col("best.k").alias("_k")), "sha").where(rank_of_split() == F.col("_k")).drop("_k")
    return joined.select(*rows.columns).unionByName(bare)


def dedup_parity(rows: DataFrame) -> DataFrame:
    """As ``dedup_splits`` if any hash straddles splits, else the rows as they are; one aggregation tells both."""
    best = F.min(F.struct(rank_of_split().alias("k"), "row_id")).alias("best")
    splits = F.bit_count(F.bit_or(F.when(F.col("split").isNotNull(), F.pow(F.lit(2.0), rank_of_split().cast("double")).cast("int")).otherwise(0))).alias("splits")
    kept = materialise(rows.where(F.col("sha").isNotNull()).groupBy("sha").agg(best, splits).select(F.col("best.row_id").alias("row_id"), "splits"), "kept")
    if kept.where("splits > 1").isEmpty():
        return rows
    return rows.join(kept.select("row_id"), "row_id", "left_semi").unionByName(rows.where(F.col("sha").isNull()))


def quarantined_by_sha(rows: DataFrame) -> DataFrame:
    """Trainable rows whose hash is one of an evaluation-only row."""
    listed = rows.where((F.col("split") == "eval_only") & F.col("sha").isNotNull()).select("sha").distinct()
    return rows.where(trainable()).join(listed, "sha", "left_semi")


def class_balance(rows: DataFrame) -> DataFrame:
    """(split, n, classes, largest_share, problem): problem is single_class, imbalanced or null."""
    counts = rows.where(F.col("split").isNotNull() & F.col("label").isNotNull() & ~F.col("split").isin(*UNBOUND)).groupBy("split", "label").agg(F.count("*").alias("c"))
    out = counts.groupBy("split").agg(F.sum("c").alias("n"), F.count("*").alias("classes"), F.round(F.max("c") / F.sum("c"), 9).alias("largest_share"))
    problem = F.when(F.col("classes") < 2, "single_class").when(F.col("largest_share") > MOST_OF_ONE_CLASS, "imbalanced")
    return out.withColumn("problem", problem)


def violations(manifest: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """(rule, n) of every rule that is broken; ``near`` are the rows near evaluation-only images, if they were looked for."""
    rows = catalog(manifest)
    simple = rows.agg(
        F.count_if(F.col("label").isNull() | ~F.col("label").isin(0, 1)).alias("label"),
        F.count_if(F.col("split").isNull()).alias("split"),
        F.count_if((F.col("width") <= 0) | (F.col("height") <= 0)).alias("size"),
        F.count_if(F.col("sha").isNull()).alias("sha256"),
    ).unpivot([], ["label", "split", "size", "sha256"], "rule", "n")
    counted = lambda df, rule: df.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
    out = simple.unionByName(counted(straddling(rows), "leakage")).unionByName(counted(quarantined_by_sha(rows), "contamination_sha256"))
    if near is not None:
        out = out.unionByName(counted(near, "contamination_phash"))
    balance = class_balance(rows).where(F.col("problem").isNotNull()).select(F.concat_ws(":", "problem", "split").alias("rule"), "n")
    return out.unionByName(balance).where("n > 0")


class ManifestError(ValueError):
    """A manifest broke at least one rule."""


def validate(manifest: DataFrame) -> DataFrame:
    """The manifest itself, or one error that names every broken rule."""
    missing = [c for c in ("path", "label", "source", "generator", "split", "sha256", "width", "height", "phash") if c not in manifest.columns]
    if missing:
        raise ManifestError(f"missing columns: {missing}")
    if manifest.isEmpty():
        raise ManifestError("empty manifest")
    broken = violations(manifest).collect()  # a row per rule
    if broken:
        raise ManifestError("; ".join(f"{r['rule']}: {r['n']}" for r in sorted(broken, key=lambda r: r["rule"])))
    return manifest


def prep_report(rows: DataFrame) -> DataFrame:
    listed = rows.where((F.col("split") == "eval_only") & F.col("sha").isNotNull()).select("sha").distinct().withColumn("hit", F.lit(True))
    joined = rows.join(listed, "sha", "left")
    per = joined.groupBy("sha").agg(
        F.count("*").alias("r"), F.count_if(F.col("hit") & trainable()).alias("h"), F.count_if(F.col("label") == 0).alias("a"), F.count_if(F.col("label") == 1).alias("g")
    )
    return per.agg(
        F.sum("r").alias("rows"),
        F.count("sha").alias("hashes"),
        F.sum(F.when(F.col("sha").isNotNull(), F.col("r") - 1).otherwise(0)).alias("duplicates"),
        F.sum("h").alias("collisions"),
        F.sum("a").alias("authentic"),
        F.sum("g").alias("generated"),
    )


