"""Queries that fuse, calibrate and decide."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.functions import scores as P
from sievelight.operators import metrics as M
from sievelight.plans.evaluation import LATEST

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def wide(spark: SparkSession, d: str) -> DataFrame:
    """Scorings in which all three experts' probabilities are valid, with the label where there is one."""
    w = M.latest(spark.read.parquet(f"{d}/predictions.parquet"))
    labels = spark.read.parquet(f"{d}/manifest.parquet").select("row_id", F.when(F.col("label").isin(0, 1), F.col("label")).alias("y"), "source", "generator")
    good = F.lit(True)
    for e in M.EXPERTS:
        good = good & M.valid(F.col(e))
    return w.where(good).join(labels, "row_id")


def abc() -> dict:
    return dict(zip(("a", "b", "c"), map(F.col, M.EXPERTS)))


WIDE = f"""WITH {LATEST}, w AS (SELECT l.row_id, l.condition, l.pred, CASE WHEN m.label IN (0, 1) THEN m.label END AS y, m.source, m.generator, community_forensics AS a, dinov3_l AS b, dinov3_b AS c FROM latest l JOIN manifest m USING (row_id)
 WHERE {' AND '.join(f'{e} IS NOT NULL AND NOT isnan({e}) AND {e} BETWEEN 0 AND 1' for e in M.EXPERTS)})"""
Z = "(ln(least(greatest({0}, 1e-6), 1 - 1e-6)) - ln(1 - least(greatest({0}, 1e-6), 1 - 1e-6)))"
TREE = {"children": [{"weight": 0.7, "children": [{"weight": 0.6, "expert": "a"}, {"weight": 0.4, "expert": "b"}]}, {"weight": 0.3, "expert": "c"}]}


def one(spark, d, column) -> DataFrame:
    return wide(spark, d).select("row_id", "condition", F.round(column, 8).alias("fused"))


def sql(expression: str) -> str:
    return f"{WIDE} SELECT row_id, condition, round({expression}, 8) AS fused FROM w"


@query(sql(Z.format("b")))
def fn_logit(spark, d):
    return one(spark, d, P.logit(abc()["b"]))


@query(sql("1 / (1 + exp(-(4 * b - 2)))"))
def fn_sigmoid(spark, d):
    return one(spark, d, P.sigmoid(4 * abc()["b"] - 2))


@query(sql(f"1 / (1 + exp(-least(greatest({Z.format('b')} / 1.7, -60), 60)))"))
def fn_temperature(spark, d):
    return one(spark, d, P.temperature(abc()["b"], 1.7))


@query(sql("a * 0.5 + b * 0.3 + c * 0.2"))
def fn_weighted_mean(spark, d):
    return one(spark, d, P.weighted_mean(list(abc().values()), [5, 3, 2]))


@query(sql("(a + b + c) / 3"))
def fn_equal_avg(spark, d):
    return one(spark, d, P.weighted_mean(list(abc().values())))


@query(sql(f"1 / (1 + exp(-({Z.format('a')} + {Z.format('b')} + {Z.format('c')}) / 3))"))
def fn_logit_mean(spark, d):
    return one(spark, d, P.logit_mean(list(abc().values())))


@query(sql("a * 0.42 + b * 0.28 + c * 0.3"))
def fn_fusion_tree(spark, d):
    return one(spark, d, P.fuse(abc(), "hierarchical", tree=TREE))


FUSED = f"(0.42 * {Z.format('a')} + 0.28 * {Z.format('b')} + 0.3 * {Z.format('c')})"


#: As FUSED for a tree without the expert a.
WITHOUT = f"(0.6 * {Z.format('b')} + 0.4 * {Z.format('c')})"
SURE = f"abs({Z.format('a')}) >= 1.5 AND abs({Z.format('c')}) >= 0.5 AND sign({Z.format('a')}) = sign({Z.format('c')})"


def _moved(fused: str) -> str:
    return f"CASE WHEN {SURE} AND sign({Z.format('a')}) <> sign({fused}) THEN {fused} + 2.5 * sign({Z.format('a')}) ELSE {fused} END"


@query(f"""{WIDE} SELECT row_id, condition, round(1 / (1 + exp(-{_moved(FUSED)})), 8) AS fused,
 round(1 / (1 + exp(-CASE WHEN sign({Z.format('b')}) = sign({Z.format('c')}) AND sign({Z.format('a')}) <> sign({Z.format('b')}) THEN {WITHOUT} ELSE {_moved(WITHOUT)} END)), 8) AS outvoted FROM w""")
def fn_dual_gate(spark, d):
    """Gated fusion by a tree that holds the dissenter, and by one that can do without it."""
    gate = P.Gate(trusted={"a": 1.5, "c": 0.5}, voters=("b", "c"), quorum=2, dissenter="a")
    without = {"children": [{"weight": 0.6, "expert": "b"}, {"weight": 0.4, "expert": "c"}]}
    columns = {"fused": P.fuse(abc(), "hierarchical", tree=TREE, gate=gate), "outvoted": P.fuse(abc(), "hierarchical", tree=without, gate=gate)}
    return wide(spark, d).select("row_id", "condition", *[F.round(c, 8).alias(n) for n, c in columns.items()])


@query(f"""{WIDE} SELECT row_id, condition, round((a + b + c) / 3, 8) AS mean, round((2 * a + b + c) / 4, 8) AS weighted, round(1 / (1 + exp(-(2 * {Z.format('a')} + {Z.format('b')} + {Z.format('c')}) / 4)), 8) AS logit, round(a * 0.42 + b * 0.28 + c * 0.3, 8) AS hierarchical FROM w""")
def fn_fuse(spark, d):
    v, w = abc(), {"a": 2.0}
    modes = {"mean": P.fuse(v), "weighted": P.fuse(v, "weighted", w), "logit": P.fuse(v, "logit", w), "hierarchical": P.fuse(v, "hierarchical", tree=TREE)}
    return wide(spark, d).select("row_id", "condition", *[F.round(c, 8).alias(m) for m, c in modes.items()])


@query(sql("1 / (1 + exp(-1.8 * (0.1 + (a - 0.5) / 0.3 * 0.9 + (b - 0.45) / 0.25 * 1.1 + (c - 0.55) / 0.28 * 0.7) + 0.05))"))
def fn_fusion_linear_svm(spark, d):
    return one(spark, d, P.linear(list(abc().values()), [0.5, 0.45, 0.55], [0.3, 0.25, 0.28], [0.9, 1.1, 0.7], 0.1, -1.8, 0.05))


@query(f"""{WIDE}, k AS (SELECT i / 10.0 AS wa, j / 10.0 AS wb, (10 - i - j) / 10.0 AS wc FROM (SELECT unnest(range(0, 11)) AS i), (SELECT unnest(range(0, 11)) AS j) WHERE i + j <= 10),
l AS (SELECT wa, wb, wc, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 9) AS loss FROM (SELECT wa, wb, wc, y, least(greatest(CAST(wa AS DOUBLE) * a + CAST(wb AS DOUBLE) * b + CAST(wc AS DOUBLE) * c, 1e-7), 1 - 1e-7) AS p FROM w, k WHERE y IS NOT NULL) GROUP BY 1, 2, 3)
SELECT CAST(wa AS DOUBLE) AS wa, CAST(wb AS DOUBLE) AS wb, CAST(wc AS DOUBLE) AS wc, round(loss, 6) AS log_loss FROM l ORDER BY loss, wa, wb, wc LIMIT 1""")
def fn_constrained_mean(spark, d):
    """Weights that are not negative and sum to one, of least log loss on a grid of tenths; one pass, grid points beside each row."""
    grid = [(i / 10, j / 10, (10 - i - j) / 10) for i in range(11) for j in range(11 - i)]
    points = F.explode(F.array(*[F.struct(F.lit(x).alias("wa"), F.lit(y).alias("wb"), F.lit(z).alias("wc")) for x, y, z in grid])).alias("k")
    v = abc()
    tried = wide(spark, d).where("y IS NOT NULL").select("y", *[c.alias(n) for n, c in v.items()], points).select("y", "a", "b", "c", "k.*")
    p = P.clip(F.col("wa") * F.col("a") + F.col("wb") * F.col("b") + F.col("wc") * F.col("c"), 1e-7)
    loss = tried.groupBy("wa", "wb", "wc").agg(F.round(F.avg(-(F.col("y") * F.ln(p) + (1 - F.col("y")) * F.ln(1 - p))), 9).alias("loss"))
    return loss.orderBy("loss", "wa", "wb", "wc").limit(1).select("wa", "wb", "wc", F.round("loss", 6).alias("log_loss"))


VALID = "CASE WHEN pred IS NOT NULL AND NOT isnan(pred) THEN pred END"
PRED = f"WITH {LATEST}, v AS (SELECT l.row_id, l.condition, {VALID} AS p, m.label FROM latest l JOIN manifest m USING (row_id))"


def final(spark: SparkSession, d: str) -> DataFrame:
    p = F.when(F.col("pred").isNotNull() & ~F.isnan("pred"), F.col("pred"))
    return M.latest(spark.read.parquet(f"{d}/predictions.parquet")).select("row_id", "condition", p.alias("p")).join(spark.read.parquet(f"{d}/manifest.parquet").select("row_id", "label"), "row_id")


@query(f"{PRED} SELECT row_id, condition, CAST(p >= 0.7 AS INT) AS prediction FROM v")
def prj_threshold(spark, d):
    return final(spark, d).select("row_id", "condition", P.decision(F.col("p"), 0.7).alias("prediction"))


@query(f"{PRED} SELECT row_id, condition, CASE WHEN p >= 0.7 THEN 'FAKE' WHEN p < 0.7 THEN 'REAL' ELSE 'SKIPPED' END AS name FROM v")
def prj_label_name(spark, d):
    return final(spark, d).select("row_id", "condition", P.label_name(P.decision(F.col("p"), 0.7)).alias("name"))


@query(f"{PRED} SELECT row_id, condition, round(CASE WHEN p >= 0.7 THEN p ELSE 1 - p END, 8) AS confidence FROM v")
def prj_confidence(spark, d):
    return final(spark, d).select("row_id", "condition", F.round(P.confidence(F.col("p"), 0.7), 8).alias("confidence"))


@query(f"{PRED} SELECT row_id, condition, label = CAST(p >= 0.7 AS INT) AS correct FROM v")
def prj_correct(spark, d):
    return final(spark, d).select("row_id", "condition", (F.col("label") == P.decision(F.col("p"), 0.7)).alias("correct"))


@query("""WITH g AS (SELECT row_id, coalesce(source, 'unknown') || ' / ' || coalesce(generator, 'unknown') AS g FROM manifest)
SELECT row_id, CASE WHEN CAST('0x' || left(sha256('1337:' || g), 8) AS BIGINT) < 1288490188 THEN 'final_test' ELSE 'development' END AS partition FROM g""")
def prj_partition_tag(spark, d):
    from sievelight.operators.selection import hash_number

    g = F.concat_ws(" / ", F.coalesce("source", F.lit("unknown")), F.coalesce("generator", F.lit("unknown")))
    m = spark.read.parquet(f"{d}/manifest.parquet").select("row_id", g.alias("g"))
    return m.select("row_id", F.when(hash_number(1337, F.col("g")) < 1288490188, "final_test").otherwise("development").alias("partition"))


ZA, ZB = Z.format("a"), Z.format("b")
SG = "(1 / (1 + exp(-({0}))))"


def ce(z: str) -> str:
    return f"(greatest({z}, 0) - {z} * y + ln(1 + exp(-abs({z}))))"


def foc(z: str) -> str:
    p = SG.format(z)
    return f"({ce(z)} * pow(greatest(1 - ({p} * y + (1 - {p}) * (1 - y)), 1e-6), 2) * 0.5)"


@query(f"""{WIDE}, x AS (SELECT condition, y, {ZA} AS za, {ZB} AS zb FROM w WHERE y IS NOT NULL), l AS (SELECT condition, avg({foc('za')}) AS f, avg({foc('zb')}) AS g,
 avg(least(greatest({SG.format('za')}, 1e-6), 1 - 1e-6) * ln(least(greatest({SG.format('za')}, 1e-6), 1 - 1e-6) / least(greatest({SG.format('zb')}, 1e-6), 1 - 1e-6)) + (1 - least(greatest({SG.format('za')}, 1e-6), 1 - 1e-6)) * ln((1 - least(greatest({SG.format('za')}, 1e-6), 1 - 1e-6)) / (1 - least(greatest({SG.format('zb')}, 1e-6), 1 - 1e-6)))) AS k FROM x GROUP BY 1)
SELECT condition, round(f, 6) AS focal_a, round(g, 6) AS focal_b, round(k, 6) AS kl, round(f + g + 0.5 * k, 6) AS total FROM l""")
def fn_losses(spark, d):
    """Focal loss of two experts, the divergence between them, and their weighted sum."""
    x = wide(spark, d).where("y IS NOT NULL").select("condition", "y", P.logit(F.col(M.EXPERTS[0])).alias("za"), P.logit(F.col(M.EXPERTS[1])).alias("zb"))
    za, zb, y = F.col("za"), F.col("zb"), F.col("y")
    g = x.groupBy("condition").agg(F.avg(P.focal(za, y)).alias("f"), F.avg(P.focal(zb, y)).alias("g"), F.avg(P.bernoulli_kl(za, zb)).alias("k"))
    return g.select("condition", F.round("f", 6).alias("focal_a"), F.round("g", 6).alias("focal_b"), F.round("k", 6).alias("kl"), F.round(F.col("f") + F.col("g") + 0.5 * F.col("k"), 6).alias("total"))


@query("SELECT CAST(s AS BIGINT) AS step, round(CASE WHEN s < 100 THEN (s + 1) / 100.0 ELSE 0.5 * (1 + cos(pi() * least(1.0, (s - 100) / 900.0))) END, 8) AS factor FROM (SELECT unnest(range(0, 1100)) AS s)")
def fn_lr_schedule(spark, d):
    return spark.range(1100).select(F.col("id").alias("step"), F.round(P.learning_rate(F.col("id"), 100, 1000), 8).alias("factor"))


@query("SELECT CAST(e AS BIGINT) AS epoch, round(greatest(0.1, 0.4 - 0.3 * e / 19.0), 8) AS clean, round(0.4 - 0.1 * e / 19.0, 8) AS mild, round(0.15 + 0.2 * e / 19.0, 8) AS moderate, round(0.05 + 0.2 * e / 19.0, 8) AS heavy FROM (SELECT unnest(range(0, 20)) AS e)")
def fn_tier_weights(spark, d):
    from sievelight.operators.sampling import tier_weights

    return spark.createDataFrame([(e, *[round(w, 8) for w in tier_weights(e, 20).values()]) for e in range(20)], "epoch bigint, clean double, mild double, moderate double, heavy double")


@query("""WITH p AS (SELECT 'jpeg' AS family, 95.0 AS lo, 25.0 AS hi, true AS whole UNION ALL SELECT 'blur', 0, 2.5, false UNION ALL SELECT 'resize', 1, 0.2, false UNION ALL SELECT 'noise', 0, 0.12, false UNION ALL SELECT 'jitter', 0, 0.3, false UNION ALL SELECT 'crop', 1, 0.65, false),
v AS (SELECT family, severity_rank, whole, CAST(lo AS DOUBLE) + (CAST(hi AS DOUBLE) - CAST(lo AS DOUBLE)) * (least(greatest(CAST(severity_rank AS DOUBLE), 0), 5) / 5) AS v FROM degradation_cells JOIN p USING (family))
SELECT family, severity_rank, round(CASE WHEN whole THEN round_even(v, 0) ELSE v END, 8) AS value FROM v""")
def fn_severity_value(spark, d):
    """A family's parameter at each rank taken as a severity."""
    from sievelight.operators.sampling import FAMILIES

    value = F.lit(None).cast("double")
    for name, (lo, hi, whole) in FAMILIES.items():
        value = F.when(F.col("family") == name, P.severity_value(F.col("severity_rank").cast("double"), lo, hi, whole)).otherwise(value)
    cells = spark.read.parquet(f"{d}/degradation_cells.parquet").where(F.col("family").isin(list(FAMILIES)))
    return cells.select("family", "severity_rank", F.round(value, 8).alias("value"))


NORM = "sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)))"


@query(f"SELECT vec_id, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE) / greatest({NORM}, 1e-12), 6)) AS unit FROM embeddings")
def fn_l2_normalise(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select("vec_id", F.transform(P.unit(F.col("embedding")), lambda x: F.round(x, 6)).alias("unit"))


@query("""SELECT expert, bool_and(p IS NOT NULL AND NOT isnan(p) AND p >= 0 AND p <= 1) AS holds, count(*) FILTER (p IS NULL OR isnan(p) OR p < 0 OR p > 1) AS broken FROM
 (SELECT 'community_forensics' AS expert, community_forensics AS p FROM predictions UNION ALL SELECT 'dinov3_l', dinov3_l FROM predictions UNION ALL SELECT 'dinov3_b', dinov3_b FROM predictions) GROUP BY 1""")
def fn_score_contract(spark, d):
    long = spark.read.parquet(f"{d}/predictions.parquet").unpivot([], list(M.EXPERTS), "expert", "p")
    ok = P.contract_holds(F.col("p"))
    return long.groupBy("expert").agg(F.bool_and(ok).alias("holds"), F.count_if(~ok).alias("broken"))
