import numpy as np
import pytest

from sievelight.operators import hotkeys, skew
from sievelight.operators.hotkeys import exact_quantiles


@pytest.fixture
def skewed(spark):
    """One key holds most rows, with many distinct values."""
    rng = np.random.default_rng(5)
    rows = [("hot", float(x)) for x in rng.normal(0, 1000, 6000)] + [("hot", 1.0)] * 2000 + [(f"k{i % 40}", float(i % 7)) for i in range(400)]
    return spark.createDataFrame(rows, "k string, v double"), rows


def test_quantiles_are_exact_under_skew(skewed):
    df, rows = skewed
    got = {(r["k"], r["q"]): r["quantile"] for r in exact_quantiles(df, ["k"], "v", [0.0, 0.1, 0.5, 0.99, 1.0]).collect()}
    for k in {r[0] for r in rows}:
        values = [v for key, v in rows if key == k]
        for q in (0.0, 0.1, 0.5, 0.99, 1.0):
            assert got[k, q] == pytest.approx(np.quantile(values, q), abs=1e-9)


def test_quantiles_of_nulls_nan_ties_and_extremes(spark):
    rows = [("a", None), ("a", float("nan")), ("b", 2.0), ("b", 2.0), ("c", -0.0), ("c", 0.0), ("d", 1e300), ("d", -1e300), ("d", 5.0)]
    got = {(r["k"], r["q"]): (r["n"], r["quantile"]) for r in exact_quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", [0.5]).collect()}
    assert got == {("b", 0.5): (2, 2.0), ("c", 0.5): (2, 0.0), ("d", 0.5): (3, 5.0)}
    assert exact_quantiles(spark.createDataFrame([], "k string, v double"), ["k"], "v", [0.5]).count() == 0


def test_profile_of_empty_and_odd_tables(spark):
    m = "row_id bigint, label int, width int, height int, source string, generator string, rows string, name string, metric string"
    p = "pred_id bigint, row_id bigint, pred double, k string"
    assert hotkeys.key_profile(spark.createDataFrame([], m), spark.createDataFrame([], p)).count() == 0
    manifest = [(1, 1, 10, None, "A b", "G", "x", "y", "z"), (2, None, None, -5, "a-B", None, None, None, None), (3, 0, 20, 7, None, "g", None, None, None)]
    predictions = [(1, 1, 0.5, "c"), (1, 1, 0.5, "c"), (2, 1, float("nan"), None), (3, 2, None, None), (4, 99, 0.1, None)]
    got = {(r["by_field"], r["name"]): r for r in hotkeys.key_profile(spark.createDataFrame(manifest, m), spark.createDataFrame(predictions, p)).collect()}
    ab = got["source", "ab"]
    assert (ab["rows"], ab["n_generated"], ab["n_scores"], ab["width_q50"], ab["pred_q50"]) == (2, 1, 1, 10.0, 0.5)
    assert got["source", None]["rows"] == 1 and got["generator", None]["rows"] == 1


def test_hot_join_keeps_all_rows(spark):
    big = spark.createDataFrame([("h", i) for i in range(3000)] + [(f"c{i}", i) for i in range(50)] + [(None, 1)], "k string, i int")
    small = big.where("k IS NOT NULL").groupBy("k").count().withColumnRenamed("count", "n")
    assert skew.hot_join(big, small, ["k"], "n", 3050).count() == 3050


def test_take_by_hash_and_random_rank(spark):
    rows = spark.createDataFrame([("a", i) for i in range(500)] + [("b", i) for i in range(3)], "k string, i int")
    wanted = spark.createDataFrame([("a", 120), ("b", 10)], "k string, take bigint")
    got = skew.take_by_hash(rows, wanted, ["k"], "i", 3, buckets=16)
    assert {r["k"]: r["count"] for r in got.groupBy("k").count().collect()} == {"a": 120, "b": 3}
    assert got.distinct().count() == 123
    from sievelight.operators.selection import seeded

    placed = skew.random_rank(rows, ["k"], seeded(1, "i")).collect()
    assert sorted(r["place"] for r in placed if r["k"] == "a") == list(range(1, 501))
