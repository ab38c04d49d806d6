"""Model selection: folds, cross-validation summaries, calibration fits, quality gates and error review."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import DoubleType, StructField, StructType

from sievelight.operators import metrics as M
from sievelight.session import materialise

CV_METRICS = ("accuracy", "precision", "recall", "specificity", "f1", "balanced_accuracy", "mcc", "log_loss", "brier")
#: The targets of the quality gates.
GATES = {"robust_auc": 0.85, "gap": 0.10, "correct_percent": 80.0, "tpr_at_fpr01": 30.0, "ece": 0.10}


def seeded(seed: int, *parts: Column | str) -> Column:
    """64 hex digits that order rows at random, the same on every engine and for any partitioning."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]), 256)


def hash_number(seed: int, *parts: Column | str) -> Column:
    """The first 32 bits of ``seeded`` as bigint."""
    return F.conv(F.substring(seeded(seed, *parts), 1, 8), 16, 10).cast("bigint")


def with_fold(rows: DataFrame, ident: str, folds: int, seed: int = 1337) -> DataFrame:
    return rows.withColumn("fold", hash_number(seed, ident) % folds)


def cv_summary(folded: DataFrame, keys: tuple[str, ...] = ("expert",)) -> DataFrame:
    """Mean, standard deviation and standard error over folds of every metric, per key and threshold."""
    each = M.threshold_metrics(M.confusion(folded, [*keys, "fold"]))
    p, y = F.greatest(F.least(F.col("p"), F.lit(1 - 1e-7)), F.lit(1e-7)), F.col("y")
    loss = folded.groupBy(*keys, "fold").agg(F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("log_loss"), F.avg(F.pow(F.col("p") - y, F.lit(2.0))).alias("brier"))
    rows = each.join(loss, [*keys, "fold"])
    aggs = [F.count_distinct("fold").alias("folds")]
    for m in CV_METRICS:
        aggs += [
            F.round(F.avg(m), 10).alias(f"mean_{m}"),
            F.round(F.stddev_samp(m), 10).alias(f"sd_{m}"),
            F.round(F.stddev_samp(m) / F.sqrt(F.count_distinct("fold")), 10).alias(f"se_{m}"),
        ]
    aggs += [F.avg(c).alias(f"mean_{c}") for c in ("tp", "tn", "fp", "fn")]
    return rows.groupBy(*keys, "threshold").agg(*aggs)


def select_best(cv: DataFrame) -> DataFrame:
    """The candidate of largest mean balanced accuracy, ties by least log loss."""
    return cv.orderBy(F.desc("mean_balanced_accuracy"), "mean_log_loss", "expert", "threshold").limit(1).select("expert", "threshold", "mean_balanced_accuracy", "mean_log_loss")


def fit_temperature(rows: DataFrame, keys: list[str], rounds: int = 200) -> DataFrame:
    """Per key the temperature of least mean cross-entropy; distinct (label, logit) pairs are counted first.

    The loss is convex in 1 / temperature, so its slope is followed to zero by Newton's steps within a bracket, without a
    grid. Least is 1e-6, where classes are separated; infinity where no finite temperature is best (no better than chance).
    """
    spark, least = rows.sparkSession, 1e-6
    p = F.greatest(F.least(F.col("p"), F.lit(1 - 1e-6)), F.lit(1e-6))
    counted = rows.select(*keys, "y", (F.ln(p) - F.ln(1 - p)).alias("z")).groupBy(*keys, "y", "z").agg(F.count("*").alias("n"))
    counted = materialise(counted.where("y IS NOT NULL AND z IS NOT NULL"), "counted")
    names = counted.select(*keys).schema

    def at(tried: dict[tuple, float]) -> dict[tuple, tuple[float, float, float]]:
        """By key: slope, curvature and loss at its inverse temperature."""
        points = spark.createDataFrame([(*k, b) for k, b in tried.items()], StructType([*names, StructField("b", DoubleType())]))
        x, n = F.col("z") * F.col("b"), F.col("n")
        e = F.exp(-F.abs(x))
        q = F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))
        loss = F.greatest(x, F.lit(0.0)) - x * F.col("y") + F.log1p(e)
        mean = lambda c: F.sum(n * c) / F.sum("n")
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        sums = counted.join(F.broadcast(points.withColumnsRenamed({k: f"_{k}" for k in keys})), same).groupBy(*keys).agg(mean(F.col("z") * (q - F.col("y"))).alias("g"), mean(F.col("z") * F.col("z") * e / (1 + e) / (1 + e)).alias("h"), mean(loss).alias("loss"))
        return {tuple(r[k] for k in keys): (r["g"], r["h"], r["loss"]) for r in sums.collect()}

    every = [tuple(r) for r in counted.select(*keys).distinct().collect()]
    low, high, done = at(dict.fromkeys(every, 0.0)), at(dict.fromkeys(every, 1 / least)), {}
    for k in every:
        if low[k][0] >= 0:
            done[k] = (math.inf, low[k][2])
        elif high[k][0] <= 0:
            done[k] = (least, high[k][2])
    now = {k: 1.0 for k in every if k not in done}
    bracket, last = {k: (least**2, 1 / least) for k in now}, dict.fromkeys(now, math.inf)
    for _ in range(rounds):
        if not now:
            break
        then = {}
        for k, (g, h, loss) in at(now).items():
            b, (lo, hi) = now[k], bracket[k]
            lo, hi = bracket[k] = (lo, b) if g > 0 else (b, hi)
            newton = b - g / h if h > 0 else b
            if g == 0 or abs(newton - b) <= 1e-9 * b or hi - lo <= 1e-9 * lo:
                done[k] = (1 / b, loss)
            else:
                then[k] = newton if lo < newton < hi and abs(g) < last[k] / 2 else math.sqrt(lo * hi)
                last[k] = abs(g)
        now = then
    if now:
        raise ArithmeticError(f"no temperature found after {rounds} rounds: {list(now)}")
    out = spark.createDataFrame([(*k, t, loss) for k, (t, loss) in done.items()], StructType([*names, StructField("temperature", DoubleType()), StructField("loss", DoubleType())]))
    return out.select(*keys, F.round("temperature", 6).alias("temperature"), F.round("loss", 6).alias("loss"))


def judged(rows: DataFrame, threshold: float) -> DataFrame:
    """row_id, y, p, whether the decision is right, distance to the threshold."""
    return rows.select("row_id", "y", "p", (F.when(F.col("p") >= threshold, 1).otherwise(0) == F.col("y")).alias("correct"), F.abs(F.col("p") - threshold).alias("distance"))


def review(rows: DataFrame, threshold: float, k: int) -> DataFrame:
    """Mistakes first, then what is nearest the threshold; the first k."""
    return judged(rows, threshold).orderBy("correct", "distance", "row_id").limit(k).withColumn("distance", F.round("distance", 6))


def top_errors(rows: DataFrame, k: int) -> DataFrame:
    """The k most confident false positives and false negatives; both are cut by TakeOrdered before they meet."""
    wrong = rows.withColumn("kind", F.when((F.col("y") == 0) & (F.col("p") >= 0.5), "false_positive").when((F.col("y") == 1) & (F.col("p") < 0.5), "false_negative"))
    sides = [wrong.where(F.col("kind") == kind).orderBy(order, "row_id").limit(k) for kind, order in (("false_positive", F.desc("p")), ("false_negative", F.asc("p")))]
    both = sides[0].unionByName(sides[1])
    order = F.when(F.col("kind") == "false_positive", -F.col("p")).otherwise(F.col("p"))
    return both.select("kind", "row_id", "p", F.row_number().over(Window.partitionBy("kind").orderBy(order, "row_id")).alias("place"))


def describe(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    from sievelight.operators.hotkeys import exact_quantiles

    simple = rows.groupBy(*keys).agg(F.count(value).alias("count"), F.round(M.exact_mean(F.col(value)), 9).alias("mean"), F.round(F.stddev_samp(value), 6).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    q = exact_quantiles(rows, keys, value, [0.25, 0.5, 0.75])
    wide = q.groupBy(*keys).agg(*[F.round(F.max(F.when(F.col("q") == x, F.col("quantile"))), 8).alias(f"q{round(x * 100)}") for x in (0.25, 0.5, 0.75)])
    return simple.join(wide, keys)


def best_epoch(history: DataFrame, epoch: str, metric: str) -> DataFrame:
    """The first epoch that reaches the largest value."""
    best = F.max(F.struct(F.col(metric).alias("m"), (-F.col(epoch)).alias("e"))).alias("b")
    return history.agg(best).select((-F.col("b.e")).alias(epoch), F.col("b.m").alias(metric))


def readiness(rows: DataFrame) -> DataFrame:
    """(expert, gate, status): PASS or FAIL of each quality gate; an unknown value fails."""
    clean = rows.where("condition = 'clean'")
    robust = M.robust_summary(M.roc_auc(rows, ["expert", "condition"]), ["expert"])
    right = F.when(F.col("p") >= 0.5, 1).otherwise(0) == F.col("y")
    correct = clean.groupBy("expert").agg((100.0 * F.count_if(right) / F.count("*")).alias("correct_percent"))
    wide = (
        robust.join(correct, "expert")
        .join(M.separation(clean, ["expert"]).select("expert", (100 * F.col("tpr_at_fpr01")).alias("tpr_at_fpr01")), "expert")
        .join(M.expected_calibration_error(clean, ["expert"]), "expert")
    )
    long = wide.unpivot(["expert"], list(GATES), "gate", "value")
    ok = F.lit(False)
    for gate, target in GATES.items():
        good = F.col("value") <= target if gate in ("gap", "ece") else F.col("value") >= target
        ok = F.when(F.col("gate") == gate, good).otherwise(ok)
    return long.select("expert", "gate", F.when(ok, "PASS").otherwise("FAIL").alias("status"))
