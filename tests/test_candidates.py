"""Fusion candidates against plain NumPy, and joins and lists that are spread over tasks."""

import numpy as np
import pytest

from sievelight.operators import candidates as C
from sievelight.operators import nearest, scoring, skew
from sievelight.streaming import incremental

EXPERTS = ["a", "b", "c"]
SCHEMA = "row_id bigint, fold bigint, inner bigint, y int, a double, b double, c double"


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 600)
    x = 1 / (1 + np.exp(-(1.5 * (2 * y - 1)[:, None] * np.array([1.0, 0.4, 0.0]) + rng.normal(0, 1.2, (600, 3)))))
    x = np.round(x, 6)
    fold, inner = rng.integers(0, 5, 600), rng.integers(0, 15, 600)
    rows = [(i, int(fold[i]), int(inner[i]), int(y[i]), *map(float, x[i])) for i in range(600)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5), x, y, fold, inner


def loss(w, z, y, c):
    s = z @ w
    return c * (np.logaddexp(0, s) - y * s).sum() + 0.5 * (w[:-1] ** 2).sum()


def test_logistic_fits_are_optimal(data):
    df, x, y, fold, _ = data
    fits = [C.Fit(C.plain, c, "log", f) for c in (0.1, 10.0) for f in (0, 3)]
    C.fit_all(df, EXPERTS, fits)
    rng = np.random.default_rng(1)
    for fit in fits:
        some = fold != fit.fold
        z = np.column_stack([(x[some] - x[some].mean(axis=0)) / x[some].std(axis=0), np.ones(some.sum())])
        assert np.allclose(fit.means, x[some].mean(axis=0)) and np.allclose(fit.scales, x[some].std(axis=0))
        best = loss(fit.weights, z, y[some], fit.penalty)
        assert all(loss(fit.weights + rng.normal(0, 1e-3, 4), z, y[some], fit.penalty) >= best - 1e-9 for _ in range(50))


def test_scores_are_out_of_fold(data):
    df, x, y, fold, _ = data
    told = ["equal_average", "constrained_mean", "logistic", "splines", "svm_linear", "svm_gaussian", "stacked", "logistic_pairs"]
    got = {}
    for r in C.out_of_fold(df, EXPERTS, told).collect():
        got.setdefault(r["model"], {})[r["row_id"]] = (r["fold"], r["y"], r["p"])
    assert set(got) == set(told)
    for model, rows in got.items():
        assert len(rows) == 600 and all(rows[i][:2] == (fold[i], y[i]) and 0 <= rows[i][2] <= 1 for i in rows)
        auc = np.mean([rows[i][2] > rows[j][2] for i in range(0, 600, 7) for j in range(0, 600, 5) if y[i] and not y[j]])
        assert auc > 0.85, model
    assert all(got["equal_average"][i][2] == pytest.approx(x[i].mean()) for i in range(600))


def test_importance_finds_what_matters(data):
    df = data[0]
    for name, how in (("logistic", "coefficient"), ("splines", "permutation"), ("constrained_mean", "weight")):
        got = {r["expert"]: r for r in C.importance(df, EXPERTS, name).collect()}
        assert got["a"]["share"] > got["b"]["share"] > got["c"]["share"] - 1e-9 and got["a"]["how"] == how
        assert sum(r["share"] for r in got.values()) == pytest.approx(1.0)


def test_library_candidates(data):
    df = data[0]
    rows = C.out_of_fold(df, EXPERTS, ["forest"]).collect()
    assert len(rows) == 600 and all(0 <= r["p"] <= 1 for r in rows)
    one_class = df.where("y = 1")
    assert C.out_of_fold(one_class, EXPERTS, ["forest"]).count() == 0 and C.out_of_fold(one_class, EXPERTS, ["logistic"]).count() == one_class.count()
    assert C.out_of_fold(df.limit(0), EXPERTS, ["equal_average", "logistic", "constrained_mean"]).count() == 0
    with pytest.raises(ValueError):
        C.register(C.CANDIDATES["logistic"])


def test_nearest_in_many_shards(spark, monkeypatch):
    monkeypatch.setattr(nearest, "MOST_HASHES", 12)
    monkeypatch.setattr(nearest, "TASK_ROWS", 40)
    rng = np.random.default_rng(8)
    listed = rng.integers(-(2**63), 2**63, 60)
    rows = []
    for i in range(500):
        v = int(listed[rng.integers(60)]) & (2**64 - 1)
        for b in rng.choice(64, rng.integers(0, 14), replace=False):
            v ^= 1 << int(b)
        rows.append((i, v - 2**64 if v >> 63 else v))
    rows += [(900, None), (901, rows[0][1]), (902, rows[0][1])]
    got = {r["row_id"]: (r["distance"], r["match_id"]) for r in nearest.nearest_hash(spark.createDataFrame(rows, "row_id bigint, ph bigint"), spark.createDataFrame([(i, int(v)) for i, v in enumerate(listed)], "row_id bigint, ph bigint")).collect()}
    want = {}
    for i, v in rows:
        if v is not None:
            d, j = min((((v ^ int(h)) & (2**64 - 1)).bit_count(), j) for j, h in enumerate(listed))
            if d <= 10:
                want[i] = (d, j)
    assert got == want and len(want) > 300


def test_joins_salted_by_hot_buckets(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_SHARE", 3)
    big = spark.createDataFrame([(1 if i % 2 else i, i) for i in range(9000)] + [(None, -1)], "k bigint, i bigint")
    small = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (7, None), (None, "n")], "k bigint, s string")
    hot = skew.hot_buckets(big, ["k"], 9001)
    assert len(hot) == 1
    plain = sorted(map(tuple, big.join(small, "k").collect()), key=str)
    assert sorted(map(tuple, skew.salted_join(big, small, ["k"], hot, 8).select("k", "i", "s").collect()), key=str) == plain
    assert sorted(map(tuple, skew.salted_join(big, small, ["k"], []).select("k", "i", "s").collect()), key=str) == plain
    assert skew.hot_buckets(big.limit(0), ["k"], 0) == []


def test_ensembles_refuse_what_they_cannot_hold(spark):
    rows = spark.createDataFrame([(1, [10] * 64, 8), (2, None, 8)], "row_id bigint, pixels array<int>, side int")
    got = {r["row_id"]: r["score"] for r in scoring.ensemble(rows, {"experts": {"constant": {"value": 0.2}, "mean_intensity": {}}}).collect()}
    assert got[1] == pytest.approx((0.2 + 10 / 255) / 2) and got[2] is None
    for bad in ({}, {"experts": {"x": {"model": "ensemble"}}}):
        with pytest.raises(ValueError):
            scoring.ensemble(rows, bad)


def test_files_that_are_missing(spark):
    listing = spark.createDataFrame([("a", 5), ("a", 5), ("b", 7), ("c", 3), (None, 1)], "path string, bytes bigint")
    present = spark.createDataFrame([("a", 5), ("b", 2), (None, 1)], "path string, bytes bigint")
    assert sorted(map(tuple, incremental.missing_files(listing, present).collect())) == [("b", 7), ("c", 3)]
    assert incremental.missing_files(listing.limit(0), present).count() == 0
