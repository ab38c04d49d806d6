"""Detector metrics as aggregates and windows over (label, score) rows; group keys are parameters.

Scores are first counted by distinct value, so curves are windows over distinct scores, not rows; and the running sums are
taken in two steps, over score bins and within a bin, so no task holds all scores of a group. Metrics that need both classes
are null where a group has one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from sievelight.session import materialise

#: Bins of the running sums.
CURVE_BINS = 1024
EXPERTS = ("community_forensics", "dinov3_l", "dinov3_b")


def exact_mean(p: Column) -> Column:
    """A mean over scores of six decimals that no order of summation changes."""
    return F.sum(p.cast("decimal(24,6)")).cast("double") / F.nullif(F.count(p), F.lit(0))


def valid(p: Column) -> Column:
    """A probability: not null, not NaN, within [0, 1]."""
    return p.isNotNull() & ~F.isnan(p) & p.between(0.0, 1.0)


def latest(predictions: DataFrame) -> DataFrame:
    """One scoring per image and condition: the last; rows delivered twice are one."""
    rest = [c for c in predictions.columns if c not in ("row_id", "condition", "scored_at", "pred_id")]
    last = F.max(F.struct("scored_at", "pred_id", *rest)).alias("s")
    return predictions.groupBy("row_id", "condition").agg(last).select("row_id", "condition", "s.*")


def scores(predictions: DataFrame, manifest: DataFrame, experts: tuple[str, ...] = EXPERTS) -> DataFrame:
    """(row_id, condition, y, expert, p): valid scores of every expert for rows labelled 0 or 1."""
    labels = manifest.where(F.col("label").isin(0, 1)).select("row_id", F.col("label").cast("bigint").alias("y"))
    wide = latest(predictions).join(labels, "row_id")
    long = wide.unpivot(["row_id", "condition", "y"], list(experts), "expert", "p")
    return long.where(valid(F.col("p")))


def histogram(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, p, pos, neg): rows of each class per distinct score. Written once; all metrics are sums over it."""
    counted = rows.groupBy(*keys, "p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    return materialise(counted, "scores")


def curve(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, p, pos, neg, tp, fp): per distinct score, rows of each class at it and at or above it."""
    return _curve(histogram(rows, keys), keys)


def _curve(counted: DataFrame, keys: list[str]) -> DataFrame:
    binned = counted.withColumn("_bin", F.floor(F.col("p") * CURVE_BINS))
    above = Window.partitionBy(*keys).orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    sums = binned.groupBy(*keys, "_bin").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    before = sums.select(*keys, "_bin", F.coalesce(F.sum("_p").over(above), F.lit(0)).alias("_tp"), F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_fp"))
    inside = Window.partitionBy(*keys, "_bin").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    joined = binned.join(before, [*keys, "_bin"])
    return joined.select(*keys, "p", "pos", "neg", (F.col("_tp") + F.sum("pos").over(inside)).alias("tp"), (F.col("_fp") + F.sum("neg").over(inside)).alias("fp"))


def separation(rows: DataFrame, keys: list[str], rates: tuple[float, ...] = (0.01, 0.05)) -> DataFrame:
    """(keys, n, n_real, n_fake, roc_auc, average_precision, tpr and threshold at each false positive rate)."""
    return _separation(histogram(rows, keys), keys, rates)


def _separation(counted: DataFrame, keys: list[str], rates: tuple[float, ...] = (0.01, 0.05)) -> DataFrame:
    points = _curve(counted, keys)
    sums = counted.groupBy(*keys).agg(F.sum("pos").alias("n_fake"), F.sum("neg").alias("n_real"))
    joined = points.join(sums, keys) if keys else points.crossJoin(F.broadcast(sums))
    both = (F.col("n_fake") > 0) & (F.col("n_real") > 0)
    agg = [
        F.sum(F.col("neg") * (2 * (F.col("tp") - F.col("pos")) + F.col("pos"))).alias("_auc"),
        F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("_ap"),
    ]
    for r in rates:
        within = F.col("fp") <= F.lit(r) * F.col("n_real")
        agg += [F.max(F.when(within, F.col("tp"))).alias(f"_tp{round(r * 100):02d}"), F.min(F.when(within, F.col("p"))).alias(f"_th{round(r * 100):02d}")]
    out = joined.groupBy(*keys, "n_fake", "n_real").agg(*agg)
    only = lambda c: F.when(both, c)
    named = [
        only(F.round(F.col("_auc") / (2.0 * F.col("n_fake") * F.col("n_real")), 9)).alias("roc_auc"),
        only(F.round(F.col("_ap") / F.col("n_fake"), 9)).alias("average_precision"),
    ]
    for r in rates:
        tag = f"{round(r * 100):02d}"
        named += [
            only(F.round(F.coalesce(F.col(f"_tp{tag}"), F.lit(0)) / F.col("n_fake"), 9)).alias(f"tpr_at_fpr{tag}"),
            only(F.coalesce(F.col(f"_th{tag}"), F.lit(float("inf")))).alias(f"threshold_at_fpr{tag}"),
        ]
    return out.select(*keys, (F.col("n_fake") + F.col("n_real")).alias("n"), "n_real", "n_fake", *named)


def roc_auc(rows: DataFrame, keys: list[str]) -> DataFrame:
    return separation(rows, keys).select(*keys, "roc_auc")


def compute(rows: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """All metrics of a group in one row: class counts and means, accuracy, and those of ``separation``."""
    counted = histogram(rows, keys)
    exact = F.col("p").cast("decimal(24,6)")
    mean = lambda n: F.round(F.sum((exact * F.col(n).cast("decimal(13,0)")).cast("decimal(38,6)")).cast("double") / F.nullif(F.sum(n), F.lit(0)), 9)
    simple = counted.groupBy(*keys).agg(
        mean("neg").alias("mean_score_real"),
        mean("pos").alias("mean_score_fake"),
        F.round(F.sum(F.when(F.col("p") >= threshold, F.col("pos")).otherwise(F.col("neg"))) / F.sum(F.col("pos") + F.col("neg")), 9).alias("accuracy"),
    )
    return _separation(counted, keys).join(simple, keys)


def confusion(rows: DataFrame, keys: list[str], thresholds: tuple[float, ...] = (0.1, 0.3, 0.5, 0.7, 0.9)) -> DataFrame:
    """(keys, threshold, tn, fp, fn, tp); the thresholds are a fixed list, exploded beside each row and combined map-side."""
    at = rows.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    up, y = F.col("p") >= F.col("threshold"), F.col("y")
    return at.groupBy(*keys, "threshold").agg(
        F.count_if(~up & (y == 0)).alias("tn"), F.count_if(up & (y == 0)).alias("fp"), F.count_if(~up & (y == 1)).alias("fn"), F.count_if(up & (y == 1)).alias("tp")
    )


def threshold_metrics(counts: DataFrame) -> DataFrame:
    """accuracy, precision, recall, specificity, f1, balanced accuracy and MCC of confusion counts.

    precision, recall, f1 and MCC are 0 where their divisor is; specificity is null there, and with it balanced accuracy.
    """
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    safe = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / F.nullif(b, F.lit(0.0)))
    precision, recall = safe(tp, tp + fp), safe(tp, tp + fn)
    specificity = tn / F.nullif(tn + fp, F.lit(0.0))
    r = lambda c, name: F.round(c, 9).alias(name)
    return counts.select(
        "*",
        r((tp + tn) / F.nullif(tp + tn + fp + fn, F.lit(0.0)), "accuracy"),
        r(precision, "precision"),
        r(recall, "recall"),
        r(specificity, "specificity"),
        r(safe(2 * precision * recall, precision + recall), "f1"),
        r((recall + specificity) / 2, "balanced_accuracy"),
        r(safe(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))), "mcc"),
    )


def probability_metrics(rows: DataFrame, keys: list[str], clip: float = 1e-7) -> DataFrame:
    """log loss (scores clipped) and Brier score."""
    p, y = F.greatest(F.least(F.col("p"), F.lit(1 - clip)), F.lit(clip)), F.col("y")
    loss = -(y * F.ln(p) + (1 - y) * F.ln(1 - p))
    return rows.groupBy(*keys).agg(F.round(F.avg(loss), 6).alias("log_loss"), F.round(F.avg(F.pow(F.col("p") - y, F.lit(2.0))), 6).alias("brier"))


def reliability(rows: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """Equal-width bins, the last closed on the right: rows, mean score, share of class 1."""
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).alias("bin")
    return rows.groupBy(*keys, b).agg(F.count("*").alias("n"), F.avg("p").alias("confidence"), F.avg("y").alias("observed"))


def expected_calibration_error(rows: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """Mean over rows of each bin's distance between score and outcome; sums are exact for scores of six decimals."""
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).alias("bin")
    off = F.abs(F.sum("y").cast("decimal(24,6)") - F.sum(F.col("p").cast("decimal(24,6)")))
    parts = rows.groupBy(*keys, b).agg(F.count("*").alias("n"), off.alias("off"))
    return parts.groupBy(*keys).agg(F.round(F.sum("off").cast("double") / F.sum("n"), 9).alias("ece"))


def calibration_curve(rows: DataFrame, keys: list[str], bins: int = 8) -> DataFrame:
    """Quantile bins: a score's bin is the number of edges below it; edges are interpolated quantiles of the scores.

    Edges come from the counts of distinct scores (``exact_quantiles``), so no group of scores is gathered.
    """
    from sievelight.operators.hotkeys import exact_quantiles

    edges = exact_quantiles(rows, keys, "p", [i / bins for i in range(1, bins)])
    lists = edges.groupBy(*keys).agg(F.sort_array(F.collect_list("quantile")).alias("_edges"))
    joined = rows.join(F.broadcast(lists), keys)  # one short list per group of experts
    b = F.size(F.filter("_edges", lambda e: e < F.col("p"))).cast("bigint").alias("bin")
    return joined.groupBy(*keys, b).agg(F.count("*").alias("n"), F.round(exact_mean(F.col("p")), 9).alias("mean_predicted"), F.round(F.avg("y"), 9).alias("fraction_positive"))


def robust_summary(cells: DataFrame, keys: list[str]) -> DataFrame:
    """From (keys, condition, roc_auc): clean AUC, mean and worst of the degraded cells, and the gap."""
    degraded = F.when(F.col("condition") != "clean", F.col("roc_auc"))
    worst = F.struct(degraded.alias("a"), F.col("condition").alias("c"))
    out = cells.groupBy(*keys).agg(
        F.max(F.when(F.col("condition") == "clean", F.col("roc_auc"))).alias("clean_auc"),
        F.avg(degraded).alias("robust_auc"),
        F.min(degraded).alias("worst_cell_auc"),
        F.min(F.when(degraded.isNotNull(), worst)).alias("_w"),
    )
    return out.select(*keys, "clean_auc", F.round("robust_auc", 8).alias("robust_auc"), "worst_cell_auc", F.col("_w.c").alias("worst_cell"), F.round(F.col("clean_auc") - F.col("robust_auc"), 8).alias("gap"))
