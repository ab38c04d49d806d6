"""Per-key results when a handful of keys hold most rows.

Counts, sums and extremes combine on the map side, so a hot key reaches its reducer as one row per task. Quantiles do not
combine that way; ``exact_quantiles`` selects them exactly without ever gathering a hot key: values are counted by (key,
value) — a mergeable histogram of the finest grain, spread over all tasks — and for hot keys the bins of ever narrower
histograms are counted until each wanted rank lies in a bin of one value.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from sievelight.functions.normal import name_of
from sievelight.operators.skew import HOT_SHARE
from sievelight.session import materialise

#: Bins of one refinement.
BINS = 1024


def _ranks(n: Column, quantiles: list[float]) -> Column:
    """Structs (q, rank, part) of the order statistics that a quantile interpolates; ranks from 0."""
    found = []
    for q in quantiles:
        at = F.lit(q) * (n - 1).cast("double")
        low = F.floor(at)
        for up in (0, 1):
            weight = (at - low) if up else (F.lit(1.0) - (at - low))
            found.append(F.struct(F.lit(q).alias("q"), F.least(low + up, n - 1).cast("bigint").alias("rank"), weight.alias("part")))
    return F.array(*found)


def exact_quantiles(values: DataFrame, keys: list[str], value: str, quantiles: list[float]) -> DataFrame:
    """(keys..., n, q, quantile): exact quantiles with linear interpolation, one row per key and wanted q.

    ``keys`` must not be null (name what is missing); null and NaN values are left out, and a key without values gets no
    row. Ties need no care, as equal values share a bin. An empty input gives an empty result.

    A key is hot if it has more than one in HOT_SHARE rows of the (key, value) histogram; hot keys are refined bin by
    bin, all others are ranked in one window each, which holds at most that share.
    """
    v = F.col(value).cast("double")
    kept = values.select(*keys, v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    # 0.0 is added, for -0.0 and 0.0 are one value
    histogram = materialise(kept.select(*keys, (F.col("v") + F.lit(0.0)).alias("v")).groupBy(*keys, "v").agg(F.count("*").alias("c")), "histogram")
    sums = materialise(
        histogram.groupBy(*keys).agg(F.sum("c").alias("n"), F.count("*").alias("values"), F.min("v").alias("lo"), F.max("v").alias("hi")), "sums"
    )
    total = sums.agg(F.coalesce(F.sum("values"), F.lit(0))).first()[0]
    hot = sums.where(F.col("values") * HOT_SHARE > F.lit(total))
    # where even the whole histogram is small, nothing is hot in any way that matters
    hot = hot.where(F.col("values") > BINS)

    hot_keys = [r.asDict() for r in hot.collect()]  # fewer than HOT_SHARE, by definition
    spark = values.sparkSession
    cold = histogram
    if hot_keys:
        listed = spark.createDataFrame([tuple(r[k] for k in keys) for r in hot_keys], sums.select(*keys).schema)
        cold = histogram.join(F.broadcast(listed), keys, "left_anti")
    window = Window.partitionBy(*keys)
    upto = F.sum("c").over(window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = cold.withColumn("upto", upto).withColumn("n", F.sum("c").over(window))
    inside = F.filter(_ranks(F.col("n"), quantiles), lambda t: (t["rank"] < F.col("upto")) & (t["rank"] >= F.col("upto") - F.col("c")))
    picked = ranked.select(*keys, "n", "v", F.explode(inside).alias("t")).select(*keys, "n", "t.q", "t.part", "v")
    if hot_keys:
        picked = picked.unionByName(_refine(histogram, hot_keys, keys, sums, quantiles))
    return picked.groupBy(*keys, "n", "q").agg(F.sum(F.col("part") * F.col("v")).alias("quantile"))


def _refine(histogram: DataFrame, hot_keys: list[dict], keys: list[str], sums: DataFrame, quantiles: list[float]) -> DataFrame:
    """(keys..., n, q, part, v) of the hot keys. The driver holds one interval per hot key and rank, never values."""
    spark = histogram.sparkSession
    key_type = sums.select(*keys).schema
    wanted, found = [], []
    for r in hot_keys:
        n = r["n"]
        for q in quantiles:
            at = q * float(n - 1)
            low = math.floor(at)
            for rank, part in ((low, 1.0 - (at - low)), (min(low + 1, n - 1), at - low)):
                wanted.append({"key": tuple(r[k] for k in keys), "n": n, "q": q, "part": part, "rank": rank, "below": 0, "lo": r["lo"], "hi": r["hi"]})
    schema = "lo double, hi double"
    while wanted:
        open_ = []
        for w in wanted:
            (found if w["lo"] == w["hi"] else open_).append(w)
        if not open_:
            break
        intervals = sorted({(w["key"], w["lo"], w["hi"]) for w in open_})
        asked = spark.createDataFrame([(*k, lo, hi, i) for i, (k, lo, hi) in enumerate(intervals)], f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in key_type)}, {schema}, i int")
        number = {x: i for i, x in enumerate(intervals)}
        place = F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BINS)
        binned = (
            histogram.join(F.broadcast(asked), keys)
            .where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
            .groupBy("i", F.least(place, F.lit(BINS - 1)).alias("bin"))
            .agg(F.sum("c").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        )
        upto = F.sum("c").over(Window.partitionBy("i").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
        ranks = spark.createDataFrame([(number[w["key"], w["lo"], w["hi"]], j, w["rank"] - w["below"]) for j, w in enumerate(open_)], "i int, j int, r bigint")
        chosen = binned.withColumn("upto", upto).join(F.broadcast(ranks), "i").where((F.col("r") < F.col("upto")) & (F.col("r") >= F.col("upto") - F.col("c")))
        wanted = []
        for row in chosen.select("j", "lo", "hi", (F.col("upto") - F.col("c")).alias("before")).collect():
            w = dict(open_[row["j"]])
            wanted.append(w | {"lo": row["lo"], "hi": row["hi"], "below": w["below"] + row["before"]})
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in key_type)
    return spark.createDataFrame([(*w["key"], w["n"], w["q"], w["part"], w["lo"]) for w in found], f"{columns}, n bigint, q double, part double, v double")


def key_profile(manifest: DataFrame, predictions: DataFrame, quantiles: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """One row per source and per generator name: rows, class shares, size and score statistics, exact quantiles.

    Names are compared by letters and digits; rows without a name are kept under name null. A prediction delivered twice
    (same pred_id) counts once; scores that are null or NaN are left out; sizes count as they are, nulls left out.
    """
    fields = ("source", "generator")
    base = manifest.select("row_id", "label", "width", "height", *[F.coalesce(name_of(F.col(f)), F.lit("")).alias(f) for f in fields])
    pairs = lambda: F.explode(F.array(*[F.struct(F.lit(f).alias("by_field"), F.col(f).alias("name")) for f in fields])).alias("k")
    rows = base.select("label", "width", "height", pairs()).select("k.*", "label", "width", "height")
    scored = (
        predictions.select("pred_id", "row_id", "pred")
        .join(base.select("row_id", *fields), "row_id")
        .dropDuplicates(["row_id", "pred_id"])
        .where(F.col("pred").isNotNull() & ~F.isnan("pred"))
        .select("pred", pairs())
        .select("k.*", "pred")
    )
    keys = ["by_field", "name"]
    counts = rows.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("label") == 0).alias("n_authentic"),
        F.count_if(F.col("label") == 1).alias("n_generated"),
        *[f(m).alias(f"{m}_{n}") for m in ("width", "height") for n, f in (("min", F.min), ("max", F.max))],
        *[F.round(F.sum(F.col(m).cast("bigint")).cast("double") / F.count(m), 4).alias(f"{m}_mean") for m in ("width", "height")],
    )
    exact = F.sum(F.col("pred").cast("decimal(24,6)"))
    scored = materialise(scored, "scored")
    scores = scored.groupBy(*keys).agg(
        F.count("*").alias("n_scores"),
        F.round(exact.cast("double") / F.count("*"), 6).alias("pred_mean"),
        F.min("pred").alias("pred_min"),
        F.max("pred").alias("pred_max"),
    )
    long = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in ("width", "height")])).alias("m")).select(*keys, "m.*")
    long = long.unionByName(scored.select(*keys, F.lit("pred").alias("metric"), F.col("pred").alias("v")))
    picked = exact_quantiles(long, [*keys, "metric"], "v", list(quantiles))
    wide = picked.groupBy(*keys).agg(
        *[F.round(F.max(F.when((F.col("metric") == m) & (F.col("q") == q), F.col("quantile"))), 8).alias(f"{m}_q{round(q * 100)}") for m in ("width", "height", "pred") for q in quantiles]
    )
    share = lambda c: F.round(F.col(c).cast("double") / F.col("rows"), 6)
    return (
        counts.join(scores, keys, "left")
        .join(wide, keys, "left")
        .withColumn("n_scores", F.coalesce("n_scores", F.lit(0)))
        .withColumn("share_generated", share("n_generated"))
        .withColumn("share_authentic", share("n_authentic"))
        .withColumn("name", F.when(F.col("name") != "", F.col("name")))
    )
