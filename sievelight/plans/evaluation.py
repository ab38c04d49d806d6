"""Queries on how well the detectors' scores separate and calibrate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from sievelight.operators import metrics as M
from sievelight.operators import selection as S
from sievelight.session import materialise

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rows(spark: SparkSession, d: str) -> DataFrame:
    return M.scores(spark.read.parquet(f"{d}/predictions.parquet"), spark.read.parquet(f"{d}/manifest.parquet"))


def clean(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, d).where("condition = 'clean'")


LATEST = """
latest AS (SELECT * FROM (SELECT DISTINCT * FROM predictions) QUALIFY row_number() OVER (PARTITION BY row_id, condition ORDER BY scored_at DESC NULLS LAST, pred_id DESC) = 1)"""
LONG = f"""WITH {LATEST},
wide AS (SELECT l.row_id, l.condition, CAST(m.label AS BIGINT) AS y, l.community_forensics, l.dinov3_l, l.dinov3_b FROM latest l JOIN manifest m USING (row_id) WHERE m.label IN (0, 1)),
every AS (SELECT row_id, condition, y, 'community_forensics' AS expert, community_forensics AS p FROM wide UNION ALL SELECT row_id, condition, y, 'dinov3_l', dinov3_l FROM wide UNION ALL SELECT row_id, condition, y, 'dinov3_b', dinov3_b FROM wide),
long AS (SELECT * FROM every WHERE p IS NOT NULL AND NOT isnan(p) AND p BETWEEN 0 AND 1)"""
CLEAN = f"{LONG}, c AS (SELECT * FROM long WHERE condition = 'clean')"


def curve_sql(table: str, keys: str) -> str:
    return f"""
counted AS (SELECT {keys}, p, CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1 - y) AS BIGINT) AS neg FROM {table} GROUP BY ALL),
curve AS (SELECT *, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp, CAST(sum(pos) OVER v AS BIGINT) AS n_fake, CAST(sum(neg) OVER v AS BIGINT) AS n_real
 FROM counted WINDOW w AS (PARTITION BY {keys} ORDER BY p DESC), v AS (PARTITION BY {keys})),
sep AS (SELECT {keys}, n_fake + n_real AS n, n_real, n_fake,
 CASE WHEN n_fake > 0 AND n_real > 0 THEN round(CAST(sum(neg * (2 * (tp - pos) + pos)) AS DOUBLE) / (2.0 * n_fake * n_real), 9) END AS roc_auc,
 CASE WHEN n_fake > 0 AND n_real > 0 THEN round(sum(CAST(pos AS DOUBLE) * tp / (tp + fp)) / n_fake, 9) END AS average_precision,
 CASE WHEN n_fake > 0 AND n_real > 0 THEN round(coalesce(max(tp) FILTER (fp <= 0.01 * n_real), 0) / CAST(n_fake AS DOUBLE), 9) END AS tpr_at_fpr01,
 CASE WHEN n_fake > 0 AND n_real > 0 THEN coalesce(min(p) FILTER (fp <= 0.01 * n_real), CAST('Infinity' AS DOUBLE)) END AS threshold_at_fpr01,
 CASE WHEN n_fake > 0 AND n_real > 0 THEN round(coalesce(max(tp) FILTER (fp <= 0.05 * n_real), 0) / CAST(n_fake AS DOUBLE), 9) END AS tpr_at_fpr05,
 CASE WHEN n_fake > 0 AND n_real > 0 THEN coalesce(min(p) FILTER (fp <= 0.05 * n_real), CAST('Infinity' AS DOUBLE)) END AS threshold_at_fpr05
 FROM curve GROUP BY {keys}, n_fake, n_real)"""


def compute_sql(table: str, keys: str) -> str:
    return f"""{curve_sql(table, keys)},
simple AS (SELECT {keys}, round(CAST(sum(CAST(p AS DECIMAL(24, 6))) FILTER (y = 0) AS DOUBLE) / nullif(count(*) FILTER (y = 0), 0), 9) AS mean_score_real, round(CAST(sum(CAST(p AS DECIMAL(24, 6))) FILTER (y = 1) AS DOUBLE) / nullif(count(*) FILTER (y = 1), 0), 9) AS mean_score_fake,
 round(count(*) FILTER ((p >= 0.5) = (y = 1)) / CAST(count(*) AS DOUBLE), 9) AS accuracy FROM {table} GROUP BY ALL),
comp AS (SELECT * FROM sep JOIN simple USING ({keys}))"""


COMPUTE = f"{CLEAN}, {compute_sql('c', 'expert')}"


@query(f"{COMPUTE} SELECT * FROM comp")
def agg_compute(spark, d):
    return M.compute(clean(spark, d), ["expert"])


@query(f"{CLEAN}, {curve_sql('c', 'expert')} SELECT expert, roc_auc FROM sep")
def win_auc(spark, d):
    return M.roc_auc(clean(spark, d), ["expert"])


@query(f"{CLEAN}, {curve_sql('c', 'expert')} SELECT expert, average_precision FROM sep")
def win_ap(spark, d):
    return M.separation(clean(spark, d), ["expert"]).select("expert", "average_precision")


@query(f"{CLEAN}, {curve_sql('c', 'expert')} SELECT expert, tpr_at_fpr01, threshold_at_fpr01, tpr_at_fpr05, threshold_at_fpr05 FROM sep")
def win_tpr_at_fpr(spark, d):
    return M.separation(clean(spark, d), ["expert"]).select("expert", "tpr_at_fpr01", "threshold_at_fpr01", "tpr_at_fpr05", "threshold_at_fpr05")


@query(f"""{CLEAN}, {curve_sql('c', 'expert')}
SELECT expert, p AS threshold, tp / CAST(n_fake AS DOUBLE) AS tpr, fp / CAST(n_real AS DOUBLE) AS fpr FROM curve
UNION ALL SELECT DISTINCT expert, CAST('Infinity' AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM curve""")
def win_roc_curve(spark, d):
    points = M.curve(clean(spark, d), ["expert"])
    sums = points.groupBy("expert").agg(F.sum("pos").alias("n_fake"), F.sum("neg").alias("n_real"))
    real = points.join(sums, "expert").select("expert", F.col("p").alias("threshold"), (F.col("tp") / F.col("n_fake")).alias("tpr"), (F.col("fp") / F.col("n_real")).alias("fpr"))
    return real.unionByName(sums.select("expert", F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr")))


@query(f"""{CLEAN}, {curve_sql('c', 'expert')}
SELECT expert, p AS threshold, tp / CAST(tp + fp AS DOUBLE) AS precision, tp / CAST(n_fake AS DOUBLE) AS recall FROM curve
UNION ALL SELECT DISTINCT expert, NULL, CAST(1 AS DOUBLE), CAST(0 AS DOUBLE) FROM curve""")
def win_pr_curve(spark, d):
    points = M.curve(clean(spark, d), ["expert"])
    sums = points.groupBy("expert").agg(F.sum("pos").alias("n_fake"))
    real = points.join(sums, "expert").select("expert", F.col("p").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / F.col("n_fake")).alias("recall"))
    return real.unionByName(sums.select("expert", F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")))


CONFUSION = """
conf AS (SELECT {keys}, t AS threshold, count(*) FILTER (p < t AND y = 0) AS tn, count(*) FILTER (p >= t AND y = 0) AS fp,
 count(*) FILTER (p < t AND y = 1) AS fn, count(*) FILTER (p >= t AND y = 1) AS tp
 FROM {table}, (SELECT CAST(unnest([0.1, 0.3, 0.5, 0.7, 0.9]) AS DOUBLE) AS t) GROUP BY ALL),
base AS (SELECT *, CAST(tn AS DOUBLE) AS a, CAST(fp AS DOUBLE) AS b, CAST(fn AS DOUBLE) AS e, CAST(tp AS DOUBLE) AS f FROM conf),
rates AS (SELECT *, CASE WHEN f + b = 0 THEN 0 ELSE f / (f + b) END AS pr, CASE WHEN f + e = 0 THEN 0 ELSE f / (f + e) END AS re, a / nullif(a + b, 0) AS sp FROM base),
thr AS (SELECT {keys}, threshold, tn, fp, fn, tp, round((f + a) / nullif(a + b + e + f, 0), 9) AS accuracy, round(pr, 9) AS precision, round(re, 9) AS recall, round(sp, 9) AS specificity,
 round(CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END, 9) AS f1, round((re + sp) / 2, 9) AS balanced_accuracy,
 round(CASE WHEN (f + b) * (f + e) * (a + b) * (a + e) = 0 THEN 0 ELSE (f * a - b * e) / sqrt((f + b) * (f + e) * (a + b) * (a + e)) END, 9) AS mcc FROM rates)"""
CONF = CONFUSION.format(keys="expert", table="c")


@query(f"{CLEAN}, {CONF} SELECT * FROM conf")
def agg_confusion(spark, d):
    return M.confusion(clean(spark, d), ["expert"])


@query(f"{CLEAN}, {CONF} SELECT * FROM thr")
def agg_threshold_metrics(spark, d):
    return M.threshold_metrics(M.confusion(clean(spark, d), ["expert"]))


PROB = """round(avg(-(y * ln(least(greatest(p, 1e-7), 1 - 1e-7)) + (1 - y) * ln(1 - least(greatest(p, 1e-7), 1 - 1e-7)))), 6) AS log_loss, round(avg((p - y) * (p - y)), 6) AS brier"""


@query(f"{CLEAN} SELECT expert, {PROB} FROM c GROUP BY 1")
def agg_prob_metrics(spark, d):
    return M.probability_metrics(clean(spark, d), ["expert"])


ECE = "bins AS (SELECT {keys}, least(floor(p * 10), 9) AS b, count(*) AS n, abs(CAST(sum(y) AS DECIMAL(24, 6)) - sum(CAST(p AS DECIMAL(24, 6)))) AS off FROM {table} GROUP BY ALL), ece AS (SELECT {keys}, round(CAST(sum(off) AS DOUBLE) / sum(n), 9) AS ece FROM bins GROUP BY {keys})"


@query(f"{CLEAN}, {ECE.format(keys='expert', table='c')} SELECT * FROM ece")
def agg_ece(spark, d):
    return M.expected_calibration_error(clean(spark, d), ["expert"])


@query(f"""{CLEAN}, e AS (SELECT expert, quantile_cont(p, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) AS q FROM c GROUP BY 1)
SELECT expert, CAST(len(list_filter(q, lambda x: x < p)) AS BIGINT) AS bin, count(*) AS n, round(CAST(sum(CAST(p AS DECIMAL(24, 6)))  AS DOUBLE) / nullif(count(*) , 0), 9) AS mean_predicted, round(avg(y), 9) AS fraction_positive FROM c JOIN e USING (expert) GROUP BY ALL""")
def agg_calibration_curve(spark, d):
    return M.calibration_curve(clean(spark, d), ["expert"])


GRID = f"{LONG}, {compute_sql('long', 'expert, condition')}"


@query(f"{GRID} SELECT * FROM comp")
def agg_grid(spark, d):
    return M.compute(rows(spark, d), ["expert", "condition"])


ROBUST = """rob AS (SELECT expert, max(roc_auc) FILTER (condition = 'clean') AS clean_auc, avg(roc_auc) FILTER (condition <> 'clean') AS r,
 min(roc_auc) FILTER (condition <> 'clean') AS worst_cell_auc, min(struct_pack(a := roc_auc, c := condition)) FILTER (condition <> 'clean' AND roc_auc IS NOT NULL) AS w FROM sep GROUP BY 1)"""


@query(f"{LONG}, {curve_sql('long', 'expert, condition')}, {ROBUST} SELECT expert, clean_auc, round(r, 8) AS robust_auc, worst_cell_auc, w.c AS worst_cell, round(clean_auc - r, 8) AS gap FROM rob")
def agg_robust_summary(spark, d):
    return M.robust_summary(M.roc_auc(rows(spark, d), ["expert", "condition"]), ["expert"])


@query(f"{LONG}, {curve_sql('long', 'expert, condition')}, {ROBUST} SELECT expert, w.c AS worst_cell, w.a AS roc_auc, round(w.a - clean_auc, 8) AS delta FROM rob")
def topk_worst_cell(spark, d):
    cells = M.roc_auc(rows(spark, d), ["expert", "condition"]).where(F.col("roc_auc").isNotNull())
    worst = F.min(F.when(F.col("condition") != "clean", F.struct("roc_auc", "condition"))).alias("w")
    out = cells.groupBy("expert").agg(worst, F.max(F.when(F.col("condition") == "clean", F.col("roc_auc"))).alias("c"))
    return out.select("expert", F.col("w.condition").alias("worst_cell"), F.col("w.roc_auc").alias("roc_auc"), F.round(F.col("w.roc_auc") - F.col("c"), 8).alias("delta"))


@query(f"""{LONG}, {curve_sql('long', 'expert, condition')}
SELECT a.expert, a.condition, a.roc_auc, a.average_precision, a.tpr_at_fpr01, a.tpr_at_fpr05, CASE WHEN a.condition <> 'clean' THEN round(a.roc_auc - b.roc_auc, 8) END AS delta_auc
FROM sep a LEFT JOIN sep b ON a.expert = b.expert AND b.condition = 'clean'""")
def sink_markdown_grid(spark, d):
    """The rows of the robustness table; sources.sinks.markdown writes them."""
    cells = M.separation(rows(spark, d), ["expert", "condition"])
    base = cells.where("condition = 'clean'").select("expert", F.col("roc_auc").alias("_clean"))
    delta = F.when(F.col("condition") != "clean", F.round(F.col("roc_auc") - F.col("_clean"), 8))
    return cells.join(base, "expert", "left").select("expert", "condition", "roc_auc", "average_precision", "tpr_at_fpr01", "tpr_at_fpr05", delta.alias("delta_auc"))


@query(f"""{COMPUTE}, b AS (SELECT expert, count(*) FILTER ((p >= 0.5) = (y = 1)) * 100.0 / count(*) AS a, count(*) FILTER (p < 0.5 AND y = 0) * 100.0 / nullif(count(*) FILTER (y = 0), 0) AS r, count(*) FILTER (p >= 0.5 AND y = 1) * 100.0 / nullif(count(*) FILTER (y = 1), 0) AS g FROM c GROUP BY 1)
SELECT comp.*, round(CAST(a AS DOUBLE), 6) AS correct_percent, round(CAST(r AS DOUBLE), 6) AS authentic_correct_percent, round(CAST(g AS DOUBLE), 6) AS generated_correct_percent FROM comp JOIN b USING (expert)""")
def agg_branch_metrics(spark, d):
    data = clean(spark, d)
    right = F.when(F.col("p") >= 0.5, 1).otherwise(0) == F.col("y")
    share = lambda c, of: F.round(100.0 * F.count_if(c & of) / F.nullif(F.count_if(of), F.lit(0)), 6)
    some = data.groupBy("expert").agg(
        share(right, F.lit(True)).alias("correct_percent"), share(right, F.col("y") == 0).alias("authentic_correct_percent"), share(right, F.col("y") == 1).alias("generated_correct_percent")
    )
    return M.compute(data, ["expert"]).join(some, "expert")


FOLDS = "folded AS (SELECT *, CAST('0x' || left(sha256('1337:' || row_id), 8) AS BIGINT) % 5 AS fold FROM c)"
CV = f"""{CLEAN}, {FOLDS}, {CONFUSION.format(keys='expert, fold', table='folded')},
prob AS (SELECT expert, fold, avg(-(y * ln(least(greatest(p, 1e-7), 1 - 1e-7)) + (1 - y) * ln(1 - least(greatest(p, 1e-7), 1 - 1e-7)))) AS log_loss, avg((p - y) * (p - y)) AS brier FROM folded GROUP BY 1, 2),
allm AS (SELECT * FROM thr JOIN prob USING (expert, fold)),
cv AS (SELECT expert, threshold, count(DISTINCT fold) AS folds, {', '.join(f'round(avg({m}), 10) AS mean_{m}, round(stddev_samp({m}), 10) AS sd_{m}, round(stddev_samp({m}) / sqrt(count(DISTINCT fold)), 10) AS se_{m}' for m in ('accuracy', 'precision', 'recall', 'specificity', 'f1', 'balanced_accuracy', 'mcc', 'log_loss', 'brier'))},
 avg(tp) AS mean_tp, avg(tn) AS mean_tn, avg(fp) AS mean_fp, avg(fn) AS mean_fn FROM allm GROUP BY 1, 2)"""


@query(f"{CV} SELECT * FROM cv")
def agg_cv_summary(spark, d):
    return S.cv_summary(S.with_fold(clean(spark, d), "row_id", 5))


@query(f"{CV} SELECT expert, threshold, mean_balanced_accuracy, mean_log_loss FROM cv ORDER BY mean_balanced_accuracy DESC, mean_log_loss, expert, threshold LIMIT 1")
def ml_select(spark, d):
    return S.select_best(S.cv_summary(S.with_fold(clean(spark, d), "row_id", 5)))


@query(f"{CV} SELECT expert, threshold, mean_balanced_accuracy, mean_log_loss, row_number() OVER (ORDER BY mean_balanced_accuracy DESC, mean_log_loss, expert, threshold) AS place FROM cv")
def sort_multi_dir(spark, d):
    """Candidates by metric, descending, ties by loss, ascending; there are as many as experts x thresholds."""
    cv = S.cv_summary(S.with_fold(clean(spark, d), "row_id", 5)).select("expert", "threshold", "mean_balanced_accuracy", "mean_log_loss")
    order = Window.orderBy(F.desc("mean_balanced_accuracy"), "mean_log_loss", "expert", "threshold")
    return cv.withColumn("place", F.row_number().over(order).cast("bigint"))


#: The slope of the loss in b = 1 / temperature rises, so halving the interval sixty times finds its zero.
BISECT = CLEAN.replace("WITH ", "WITH RECURSIVE ", 1)


@query(f"""{BISECT},
l AS (SELECT expert, y, ln(least(greatest(p, 1e-6), 1 - 1e-6)) - ln(1 - least(greatest(p, 1e-6), 1 - 1e-6)) AS z, CAST(count(*) AS DOUBLE) AS n FROM c GROUP BY ALL),
it AS (SELECT DISTINCT expert, 0 AS k, CAST(0 AS DOUBLE) AS lo, CAST(1000 AS DOUBLE) AS hi FROM l UNION ALL
 SELECT expert, k + 1, CASE WHEN g > 0 THEN lo ELSE (lo + hi) / 2 END, CASE WHEN g > 0 THEN (lo + hi) / 2 ELSE hi END
 FROM (SELECT it.expert, k, lo, hi, sum(n * z * (1 / (1 + exp(-z * (lo + hi) / 2)) - y)) AS g FROM it JOIN l ON l.expert = it.expert WHERE k < 60 GROUP BY it.expert, k, lo, hi)),
b AS (SELECT expert, (lo + hi) / 2 AS b FROM it WHERE k = 60)
SELECT b.expert, round(1 / any_value(b), 6) AS temperature, round(sum(n * (greatest(z * b, 0) - z * b * y + ln(1 + exp(-abs(z * b))))) / sum(n), 6) AS loss FROM b JOIN l ON l.expert = b.expert GROUP BY b.expert""")
def ml_temperature_fit(spark, d):
    return S.fit_temperature(clean(spark, d), ["expert"])


CHAIN = f"""{CLEAN}, err AS (SELECT *, CASE WHEN y = 0 AND p >= 0.5 THEN 'false_positive' WHEN y = 1 AND p < 0.5 THEN 'false_negative' END AS kind FROM c WHERE expert = 'dinov3_l')"""


@query(f"""{CHAIN} SELECT kind, row_id, p, CAST(r AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY CASE WHEN kind = 'false_positive' THEN -p ELSE p END, row_id) AS r FROM err WHERE kind IS NOT NULL) WHERE r <= 10""")
def topk_errors(spark, d):
    return S.top_errors(clean(spark, d).where("expert = 'dinov3_l'"), 10)


REVIEW = f"""{CLEAN}, r AS (SELECT row_id, y, p, CAST((p >= 0.7) AS INT) = y AS correct, abs(p - 0.7) AS distance FROM c WHERE expert = 'dinov3_l')"""


@query(f"{REVIEW} SELECT row_id, y, p, correct, round(distance, 6) AS distance FROM r ORDER BY correct, r.distance, row_id LIMIT 12")
def topk_review(spark, d):
    return S.review(clean(spark, d).where("expert = 'dinov3_l'"), 0.7, 12)


@query(f"{REVIEW}, m AS (SELECT row_id, p FROM r WHERE NOT correct), u AS (SELECT row_id, p FROM r ORDER BY r.distance, row_id LIMIT 50) SELECT * FROM m UNION SELECT * FROM u")
def set_union_distinct(spark, d):
    """Mistakes and the uncertain, each row once."""
    judged = S.judged(clean(spark, d).where("expert = 'dinov3_l'"), 0.7)
    return judged.where("NOT correct").select("row_id", "p").union(judged.orderBy("distance", "row_id").limit(50).select("row_id", "p")).distinct()


@query(f"{REVIEW} SELECT row_id, p FROM r WHERE row_id NOT IN (SELECT row_id FROM r WHERE NOT correct)")
def set_except(spark, d):
    """Rows that are no mistakes."""
    judged = S.judged(clean(spark, d).where("expert = 'dinov3_l'"), 0.7)
    return judged.select("row_id", "p").join(judged.where("NOT correct").select("row_id"), "row_id", "left_anti")


@query(f"{CLEAN} SELECT row_id FROM c WHERE expert = 'dinov3_l' INTERSECT SELECT row_id FROM c WHERE expert = 'dinov3_b'")
def set_intersect(spark, d):
    data = clean(spark, d)
    return data.where("expert = 'dinov3_l'").select("row_id").intersect(data.where("expert = 'dinov3_b'").select("row_id"))


@query(f"""{CLEAN} SELECT expert, count(*) AS count, round(CAST(sum(CAST(p AS DECIMAL(24, 6)))  AS DOUBLE) / nullif(count(*) , 0), 9) AS mean, round(stddev_samp(p), 6) AS std, min(p) AS min, round(quantile_cont(p, 0.25), 8) AS q25, round(quantile_cont(p, 0.5), 8) AS q50, round(quantile_cont(p, 0.75), 8) AS q75, max(p) AS max FROM c GROUP BY 1""")
def agg_describe(spark, d):
    return S.describe(clean(spark, d), ["expert"], "p")


@query(f"""{LONG}, w AS (SELECT row_id, condition, max(p) FILTER (expert = 'community_forensics') AS a, max(p) FILTER (expert = 'dinov3_l') AS b, max(p) FILTER (expert = 'dinov3_b') AS c FROM long GROUP BY 1, 2 HAVING count(*) = 3)
SELECT round(corr(a, b), 7) AS cf_l, round(corr(a, c), 7) AS cf_b, round(corr(b, c), 7) AS l_b FROM w""")
def agg_corr(spark, d):
    w = rows(spark, d).groupBy("row_id", "condition").pivot("expert", list(M.EXPERTS)).agg(F.max("p")).dropna("any", subset=list(M.EXPERTS))
    a, b, c = M.EXPERTS
    return w.select(F.round(F.corr(a, b), 7).alias("cf_l"), F.round(F.corr(a, c), 7).alias("cf_b"), F.round(F.corr(b, c), 7).alias("l_b"))


def development(spark, d) -> DataFrame:
    """Clean scorings with a label and all three scores; folds keep sources and generators together."""
    from sievelight.operators.candidates import CALIBRATION, FOLDS, INNER
    from sievelight.plans.fusion import wide

    group = F.concat_ws(" / ", F.coalesce("source", F.lit("unknown")), F.coalesce("generator", F.lit("unknown")))
    some = wide(spark, d).where("condition = 'clean' AND y IS NOT NULL").withColumn("g", group)
    inner = S.hash_number(1337, F.lit("inner:"), F.col("g")) % (INNER * CALIBRATION)
    return some.select("row_id", "y", *M.EXPERTS, (S.hash_number(1337, F.col("g")) % FOLDS).alias("fold"), inner.alias("inner"))


DEV = f"""WITH {LATEST}, dev AS (SELECT l.row_id, CAST(m.label AS INT) AS y, community_forensics AS a, dinov3_l AS b, dinov3_b AS c,
 CAST('0x' || left(sha256('1337:' || coalesce(m.source, 'unknown') || ' / ' || coalesce(m.generator, 'unknown')), 8) AS BIGINT) % 5 AS fold
 FROM latest l JOIN manifest m USING (row_id) WHERE condition = 'clean' AND m.label IN (0, 1) AND {' AND '.join(f'{e} IS NOT NULL AND NOT isnan({e}) AND {e} BETWEEN 0 AND 1' for e in M.EXPERTS)})"""


@query(f"""{DEV}, k AS (SELECT i, j FROM (SELECT unnest(range(0, 11)) AS i), (SELECT unnest(range(0, 11)) AS j) WHERE i + j <= 10), f AS (SELECT unnest(range(0, 5)) AS held),
l AS (SELECT held, i, j, round(-sum(y * ln(p) + (1 - y) * ln(1 - p)), 6) AS loss FROM (SELECT held, i, j, y, least(greatest(i / 10.0::DOUBLE * a + j / 10.0::DOUBLE * b + (10 - i - j) / 10.0::DOUBLE * c, 1e-7), 1 - 1e-7) AS p FROM dev, f, k WHERE fold <> held) GROUP BY 1, 2, 3),
w AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY held ORDER BY loss, i, j) = 1)
SELECT row_id, fold, 'equal_average' AS model, y, round((a + b + c) / 3, 6) AS p FROM dev
UNION ALL SELECT row_id, fold, 'constrained_mean', y, round(i / 10.0::DOUBLE * a + j / 10.0::DOUBLE * b + (10 - i - j) / 10.0::DOUBLE * c, 6) FROM dev JOIN w ON held = fold""")
def ml_oof(spark, d):
    """Scores of the two candidates that SQL can fit, by models fitted on the other folds."""
    from sievelight.operators.candidates import out_of_fold

    return out_of_fold(development(spark, d), list(M.EXPERTS), ["equal_average", "constrained_mean"]).withColumn("p", F.round("p", 6))


@query()
def ml_cv_fusion(spark, d):
    """The candidates fitted by sums over five folds and five thresholds, with an inner grid; means, deviations and errors of every metric."""
    from sievelight.operators.candidates import CANDIDATES, out_of_fold

    names = [c.name for c in CANDIDATES.values() if c.kind != "library"]
    return S.cv_summary(materialise(out_of_fold(development(spark, d), list(M.EXPERTS), names), "out_of_fold"), ("model",))


@query()
def ml_cv_library(spark, d):
    """The same for the candidates of Spark's library, trees and a small network."""
    from sievelight.operators.candidates import CANDIDATES, out_of_fold

    names = [c.name for c in CANDIDATES.values() if c.kind == "library"]
    return S.cv_summary(materialise(out_of_fold(development(spark, d), list(M.EXPERTS), names), "out_of_fold"), ("model",))


@query()
def ml_feature_importance(spark, d):
    """What the logistic candidate and the one with splines owe to each expert."""
    from sievelight.operators.candidates import importance

    data = materialise(development(spark, d), "development")
    both = [importance(data, list(M.EXPERTS), name).withColumn("model", F.lit(name)) for name in ("logistic", "splines")]
    return both[0].unionByName(both[1])


@query(f"""{COMPUTE}, w AS (SELECT expert, 2 * roc_auc - 1 AS weight FROM comp) SELECT expert, round(weight, 8) AS weight, round(abs(weight) / sum(abs(weight)) OVER (), 8) AS share FROM w""")
def ml_separation_share(spark, d):
    """Shares of absolute weights; the weights are each expert's separation, twice its AUC less one."""
    w = M.roc_auc(clean(spark, d), ["expert"]).select("expert", (2 * F.col("roc_auc") - 1).alias("weight"))
    whole = Window.partitionBy(F.lit(0))  # one row per expert
    return w.select("expert", F.round("weight", 8).alias("weight"), F.round(F.abs("weight") / F.sum(F.abs("weight")).over(whole), 8).alias("share"))


@query(f"""{LONG}, {curve_sql('long', 'expert, condition')}, {ROBUST}, cl AS (SELECT * FROM long WHERE condition = 'clean'), {ECE.format(keys='expert', table='cl')},
acc AS (SELECT expert, round(100.0 * count(*) FILTER ((p >= 0.5) = (y = 1)) / count(*), 8) AS correct FROM cl GROUP BY 1),
v AS (SELECT rob.expert, r, clean_auc - r AS gap, correct, tpr_at_fpr01, ece.ece FROM rob JOIN acc USING (expert) JOIN ece USING (expert) JOIN sep ON sep.expert = rob.expert AND sep.condition = 'clean')
SELECT expert, gate, status FROM (SELECT expert, unnest([
 struct_pack(gate := 'robust_auc', status := CASE WHEN r >= 0.85 THEN 'PASS' ELSE 'FAIL' END), struct_pack(gate := 'gap', status := CASE WHEN gap <= 0.10 THEN 'PASS' ELSE 'FAIL' END),
 struct_pack(gate := 'correct_percent', status := CASE WHEN correct >= 80 THEN 'PASS' ELSE 'FAIL' END), struct_pack(gate := 'tpr_at_fpr01', status := CASE WHEN 100 * tpr_at_fpr01 >= 30 THEN 'PASS' ELSE 'FAIL' END),
 struct_pack(gate := 'ece', status := CASE WHEN ece <= 0.10 THEN 'PASS' ELSE 'FAIL' END)], recursive := true) FROM v)""")
def ml_readiness(spark, d):
    return S.readiness(rows(spark, d))


@query(f"""{CLEAN}, {curve_sql('c', 'expert')}, e AS (SELECT *, row_number() OVER (ORDER BY expert) AS epoch FROM sep)
SELECT epoch, roc_auc FROM e ORDER BY roc_auc DESC, epoch LIMIT 1""")
def win_best_epoch(spark, d):
    """The first row with the largest AUC of a history; the experts in order of name stand for epochs."""
    history = M.roc_auc(clean(spark, d), ["expert"]).withColumn("epoch", F.row_number().over(Window.orderBy("expert")).cast("bigint"))
    return S.best_epoch(history, "epoch", "roc_auc")


@query("""WITH h AS (SELECT condition, CAST(scored_at AS DATE) AS day, CAST(sum(CAST(pred AS DECIMAL(24, 6))) AS DOUBLE) / count(*) AS m FROM predictions WHERE pred IS NOT NULL AND NOT isnan(pred) AND scored_at IS NOT NULL AND condition IS NOT NULL GROUP BY 1, 2)
SELECT condition, round(arg_min(m, day), 9) AS first_mean, round(arg_max(m, day), 9) AS last_mean, count(*) AS days FROM h GROUP BY 1""")
def win_first_last(spark, d):
    p = spark.read.parquet(f"{d}/predictions.parquet").where("pred IS NOT NULL AND NOT isnan(pred) AND scored_at IS NOT NULL AND condition IS NOT NULL")
    h = p.groupBy("condition", F.to_date("scored_at").alias("day")).agg(M.exact_mean(F.col("pred")).alias("m"))
    return h.groupBy("condition").agg(F.round(F.min_by("m", "day"), 9).alias("first_mean"), F.round(F.max_by("m", "day"), 9).alias("last_mean"), F.count("*").alias("days"))


@query("SELECT condition, count(*) FILTER (upper(trim(verdict)) = 'FAKE') AS fake, count(*) FILTER (upper(trim(verdict)) = 'REAL') AS real, count(*) FILTER (verdict IS NULL OR upper(trim(verdict)) NOT IN ('FAKE', 'REAL')) AS skipped FROM predictions GROUP BY 1")
def agg_verdict_counts(spark, d):
    v = F.upper(F.trim("verdict"))
    p = spark.read.parquet(f"{d}/predictions.parquet")
    return p.groupBy("condition").agg(F.count_if(v == "FAKE").alias("fake"), F.count_if(v == "REAL").alias("real"), F.count_if(v.isNull() | ~v.isin("FAKE", "REAL")).alias("skipped"))


@query("""WITH v AS (SELECT row_id, variant, avg(1 / (1 + exp(-(ln(s) - ln(1 - s))))) AS m, max(s) AS x, 1 / (1 + exp(-avg(ln(s) - ln(1 - s)))) AS l
 FROM (SELECT row_id, variant, least(greatest(score, 1e-6), 1 - 1e-6) AS s FROM score_cache WHERE done AND score IS NOT NULL AND NOT isnan(score)) GROUP BY 1, 2)
SELECT row_id, variant, round(m, 9) AS mean_probability, round(x, 6) AS max_probability, round(l, 9) AS logit_mean_probability FROM v""")
def agg_crop_mean(spark, d):
    """One probability per image and variant from several: mean, maximum, and sigmoid of the mean logit."""
    s = F.least(F.greatest("score", F.lit(1e-6)), F.lit(1 - 1e-6))
    c = spark.read.parquet(f"{d}/score_cache.parquet").where("done AND score IS NOT NULL AND NOT isnan(score)").select("row_id", "variant", s.alias("s"), (F.ln(s) - F.ln(1 - s)).alias("z"))
    return c.groupBy("row_id", "variant").agg(
        F.round(F.avg(1 / (1 + F.exp(-F.col("z")))), 9).alias("mean_probability"), F.round(F.max("s"), 6).alias("max_probability"), F.round(1 / (1 + F.exp(-F.avg("z"))), 9).alias("logit_mean_probability")
    )
