"""Queries that sample and split the manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.operators import curate as C
from sievelight.operators import sampling as S
from sievelight.operators.selection import hash_number, seeded
from sievelight.plans.curation import CAT

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Generators that only the unseen test split may hold.
UNSEEN = ("mirageadvanced", "quartzdiff", "folioar")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rows(spark: SparkSession, d: str) -> DataFrame:
    return C.catalog(spark.read.parquet(f"{d}/manifest.parquet"))


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, d).where("label IS NOT NULL")


H = "sha256('1337:' || row_id)"
N32 = "CAST('0x' || left({0}, 8) AS BIGINT)"
LAB = f"{CAT}, lab AS (SELECT * FROM cat WHERE label IS NOT NULL)"


@query(f"{LAB} SELECT label, row_id FROM lab QUALIFY row_number() OVER (PARTITION BY label ORDER BY row_id) <= 25")
def win_top_per_label(spark, d):
    return S.first_per(labelled(spark, d), ["label"], ["row_id"], 25).select("label", "row_id")


@query(f"{LAB} SELECT label, row_id FROM lab QUALIFY row_number() OVER (PARTITION BY label ORDER BY {H}) <= 200")
def win_balanced_sample(spark, d):
    return S.balanced(labelled(spark, d), "label", "row_id", 200, 1337).select("label", "row_id")


@query(f"{CAT} SELECT row_id FROM cat ORDER BY {H} LIMIT 300")
def samp_uniform(spark, d):
    return S.uniform_sample(rows(spark, d), "row_id", 300, 1337).select("row_id")


@query(f"{CAT} SELECT row_id, row_number() OVER (ORDER BY {H}) AS place FROM cat")
def samp_shuffle(spark, d):
    """A random permutation: each row's place."""
    return S.random_rank(rows(spark, d).select("row_id"), [], seeded(1337, "row_id")).select("row_id", "place")


GROUP = "coalesce(source, 'unknown') || ' / ' || coalesce(generator, 'unknown')"


@query(f"""{LAB}, g AS (SELECT label, row_id, {GROUP} AS diversity_group FROM lab), t AS (SELECT *, row_number() OVER (PARTITION BY label, diversity_group ORDER BY {H}) AS turn FROM g)
SELECT label, row_id, diversity_group FROM t QUALIFY row_number() OVER (PARTITION BY label ORDER BY turn, sha256('1337:' || label || diversity_group)) <= 250""")
def win_round_robin(spark, d):
    g = F.concat_ws(" / ", F.coalesce("source", F.lit("unknown")), F.coalesce("generator", F.lit("unknown")))
    data = labelled(spark, d).select("label", "row_id", g.alias("diversity_group"))
    return S.round_robin(data, "label", "diversity_group", "row_id", 250, 1337)


@query(f"{LAB} SELECT label, row_id FROM lab WHERE source IS NOT NULL QUALIFY row_number() OVER (PARTITION BY label ORDER BY source, row_id) <= 150")
def samp_budget(spark, d):
    """Per class the first rows in order of shard (source) until the budget is spent."""
    return S.first_per(labelled(spark, d).where("source IS NOT NULL"), ["label"], ["source", "row_id"], 150).select("label", "row_id")


@query(f"{CAT} SELECT generator, row_id FROM cat WHERE source IS NOT NULL AND generator IS NOT NULL QUALIFY row_number() OVER (PARTITION BY generator ORDER BY source, row_id) <= 40")
def samp_per_generator(spark, d):
    return S.first_per(rows(spark, d).where("source IS NOT NULL AND generator IS NOT NULL"), ["generator"], ["source", "row_id"], 40).select("generator", "row_id")


@query(f"""{CAT} SELECT generator, row_id FROM cat WHERE generator IS NOT NULL QUALIFY row_number() OVER (PARTITION BY generator ORDER BY sha256('1337:' || generator || CAST(row_id // 24 AS VARCHAR)), row_id) <= 60""")
def samp_windows(spark, d):
    return S.windows(rows(spark, d).where("generator IS NOT NULL").select("generator", "row_id"), "generator", "row_id", 60, 1337)


@query()
def samp_byte_budget(spark, d):
    """Iterative cuts, tested against a plain loop on a fixture."""
    data = rows(spark, d).where("generator IS NOT NULL AND width > 0 AND height > 0").select("row_id", "generator", (F.col("width").cast("bigint") * F.col("height")).alias("bytes"))
    whole = data.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    return S.byte_budget(data, "generator", "bytes", seeded(1337, "row_id"), whole // 2, 100).select("row_id", "generator", "bytes")


@query(f"""{CAT}, need AS (SELECT least(count(*) FILTER (split = 'test_unseen' AND label = 1) - count(*) FILTER (split = 'test_unseen' AND label = 0), count(*) FILTER (split = 'train' AND label = 0) - 1) AS k FROM cat),
pool AS (SELECT row_id, coalesce(generator, '') AS g FROM cat WHERE split = 'train' AND label = 0), c AS (SELECT g, count(*) AS n FROM pool GROUP BY 1),
e AS (SELECT ceil(greatest(k, 0) / CAST((SELECT count(*) FROM c) AS DOUBLE)) AS each, greatest(k, 0) AS k FROM need),
t AS (SELECT g, least(n, each) AS m, k, coalesce(sum(least(n, each)) OVER (ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c, e),
moved AS (SELECT row_id FROM (SELECT row_id, g, row_number() OVER (PARTITION BY g ORDER BY {H}) AS r FROM pool) JOIN t USING (g) WHERE r <= greatest(0, least(m, k - before)))
SELECT row_id, CASE WHEN row_id IN (SELECT row_id FROM moved) THEN 'test_unseen' ELSE split END AS split FROM cat""")
def samp_balance_unseen(spark, d):
    return S.balance_unseen(rows(spark, d))


@query(f"""{LAB}, c AS (SELECT label, CAST(round_even(count(*) * 0.5, 0) AS BIGINT) AS cut FROM lab GROUP BY 1)
SELECT row_id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY {H}) <= cut THEN 1 ELSE 2 END AS half FROM lab JOIN c USING (label)""")
def samp_stratified_half(spark, d):
    return S.halves(labelled(spark, d).select("row_id", "label"), "label", "row_id", 0.5, 1337)


U = "((CAST('0x' || left(sha256('1337:{0}:' || row_id || {1} ':1'), 8) AS BIGINT) + 0.5) / 4294967296.0)"


@query(f"""{CAT}, w AS (SELECT 0.4 - 0.3 * (1 / 3.0) AS c, 0.4 - 0.1 * (1 / 3.0) AS m, 0.15 + 0.2 * (1 / 3.0) AS o, 0.05 + 0.2 * (1 / 3.0) AS h),
t AS (SELECT row_id, CASE WHEN {U.format('tier', '')} < c / (c + m + o + h) THEN 'clean' WHEN {U.format('tier', '')} < (c + m) / (c + m + o + h) THEN 'mild' WHEN {U.format('tier', '')} < (c + m + o) / (c + m + o + h) THEN 'moderate' ELSE 'heavy' END AS tier FROM cat, w),
n AS (SELECT *, CASE tier WHEN 'clean' THEN 0 WHEN 'mild' THEN 1 + floor({U.format('n', '')} * 3) WHEN 'moderate' THEN 3 + floor({U.format('n', '')} * 4) ELSE 6 END AS k FROM t),
f AS (SELECT *, unnest(['jpeg', 'blur', 'resize', 'noise', 'jitter', 'crop']) AS family FROM n),
p AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY sha256('1337:f:' || row_id || family || ':1')) AS place FROM f),
z AS (SELECT *, sqrt(-2 * ln({U.format('a', 'family ||')})) * cos(6.283185307179586 * {U.format('b', 'family ||')}) AS g FROM p WHERE place <= k),
s AS (SELECT *, least(greatest(CASE tier WHEN 'mild' THEN 2.5 * g WHEN 'moderate' THEN 2.5 + 2.0 * g WHEN 'heavy' THEN 3.5 + g ELSE 0 END, 0), 5) AS v FROM z)
SELECT row_id, tier, CAST(place AS INT) AS place, family, round(CASE family WHEN 'jpeg' THEN round_even(95 - 70 * v / 5, 0) WHEN 'blur' THEN 2.5 * v / 5 WHEN 'resize' THEN 1 - 0.8 * v / 5 WHEN 'noise' THEN 0.12 * v / 5 WHEN 'jitter' THEN 0.3 * v / 5 ELSE 1 - 0.35 * v / 5 END, 6) AS value FROM s""")
def samp_curriculum(spark, d):
    return S.curriculum(rows(spark, d), "row_id", 1, 4)


@query(f"""{LAB}, g AS (SELECT {GROUP} AS g, count(*) AS n, sum(label) AS pos FROM lab GROUP BY 1), t AS (SELECT *, unnest(range(0, 500)) AS candidate FROM g),
s AS (SELECT candidate, sum(n) AS n, sum(pos) AS p, coalesce(sum(n) FILTER (x), 0) AS tn, coalesce(sum(pos) FILTER (x), 0) AS tp FROM (SELECT *, CAST('0x' || left(sha256('1337:' || candidate || ':' || g), 8) AS BIGINT) < 1288490188 AS x FROM t) GROUP BY 1),
e AS (SELECT candidate, round(abs(tn / CAST(n AS DOUBLE) - 0.3) + abs((p - tp) / CAST(n - tn AS DOUBLE) - p / CAST(n AS DOUBLE)) + abs(tp / CAST(tn AS DOUBLE) - p / CAST(n AS DOUBLE)), 9) AS error, CAST(tn AS BIGINT) AS rows FROM s WHERE tp > 0 AND tp < tn AND p - tp > 0 AND p - tp < n - tn)
SELECT CAST(candidate AS INT) AS candidate, error, rows FROM e ORDER BY error, candidate LIMIT 1""")
def split_group_holdout(spark, d):
    """The best of 500 candidates."""
    g = F.concat_ws(" / ", F.coalesce("source", F.lit("unknown")), F.coalesce("generator", F.lit("unknown")))
    return S.group_holdout(labelled(spark, d).select("label", g.alias("g")), "g", "label", 0.3)


@query(f"""{LAB} SELECT CAST('0x' || left(sha256('1337:' || {GROUP}), 8) AS BIGINT) % 5 AS fold, label, count(*) AS n, count(DISTINCT {GROUP}) AS groups FROM lab GROUP BY 1, 2""")
def split_strat_group_kfold(spark, d):
    g = F.concat_ws(" / ", F.coalesce("source", F.lit("unknown")), F.coalesce("generator", F.lit("unknown")))
    folded = S.group_folds(labelled(spark, d).select("label", g.alias("g")), "g", 5)
    return folded.groupBy("fold", "label").agg(F.count("*").alias("n"), F.count_distinct("g").alias("groups"))


@query(f"""{CAT} SELECT row_id, CASE WHEN generator IN {UNSEEN} THEN 'test_unseen' WHEN {N32.format(H)} < 644245094 THEN 'val' ELSE 'train' END AS new_split FROM cat""")
def prj_unseen_split(spark, d):
    new = F.when(F.col("generator").isin(*UNSEEN), "test_unseen").when(hash_number(1337, "row_id") < 644245094, "val").otherwise("train")
    return rows(spark, d).select("row_id", new.alias("new_split"))


@query(f"{CAT} SELECT row_id, CASE WHEN label = 2 THEN 'held' ELSE split END AS new_split, CASE WHEN label = 0 THEN 0 ELSE 1 END AS new_label FROM cat")
def prj_assign_split(spark, d):
    """Class to (split, label): class 0 is authentic, class 2 (altered in part) is held out as generated, all others are generated."""
    return rows(spark, d).select("row_id", F.when(F.col("label") == 2, "held").otherwise(F.col("split")).alias("new_split"), F.when(F.col("label") == 0, 0).otherwise(1).alias("new_label"))


@query("SELECT row_id, path FROM manifest WHERE row_id < 100")
def limit_head(spark, d):
    """The first rows by id; a plain limit has no order."""
    return spark.read.parquet(f"{d}/manifest.parquet").where("row_id < 100").select("row_id", "path")
