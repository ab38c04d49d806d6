"""Problems 2, 3 and 4."""

import os
import random
import sys
from collections import Counter

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import fixtures as X

from sievelight.llm import percentiles, proportions, splits

TARGETS = "plan_id int, by_field string, category string, target_share double, min_rows int, sample_size int, supply string, compared string"


@pytest.fixture(scope="module")
def rows():
    return X.manifest(900, seed=11)


def targets():
    out = [(1, "label", "0", 0.5, 5, 60), (1, "label", "1", 0.5, 5, 60), (2, "source", "ALPHA-1", 0.7, 3, 80), (2, "source", "beta", 0.2, 2, 80), (2, "source", "nowhere", 0.1, 4, 80)]
    out += [(3, "generator", "gen x", 0.0, 500, 100), (3, "generator", None, 1.0, 1, 100), (None, "label", "1", 0.1, 1, 5), (4, "other", "z", 0.3, 0, 10)]
    return [(*t, "a", "b") for t in out]


def test_found_is_the_plain_count(spark, rows):
    pool = [r for r in rows if X.split(r) == "train" and X.hashes(r)[0]]
    want = set()
    for plan, field, category, share, least, size, *_ in targets():
        c = None if category is None else category.strip() if field == "label" else X.name(category)
        of = {"label": lambda r: None if r[3] is None else str(r[3]), "source": lambda r: X.name(r[4]), "generator": lambda r: X.name(r[5])}.get(field, lambda r: None)
        supply = len({X.hashes(r)[0] for r in pool if c is not None and of(r) == c})
        if plan is not None and supply < max(least, int(share * size + 0.5)):
            want.add((plan, category))
    report = proportions.report(spark.createDataFrame(rows, X.SCHEMA).drop("_split", "_sha"), spark.createDataFrame(targets(), TARGETS).drop("supply", "compared"))
    assert {(r["plan_id"], r["category"]) for r in report.where("unmet AND plan_id IS NOT NULL").collect()} == want


def test_sample_meets_floors_and_shares(spark, rows):
    manifest, wanted = spark.createDataFrame(rows, X.SCHEMA), spark.createDataFrame(targets(), TARGETS).drop("supply", "compared")
    report = {(r["plan_id"], r["category"]): r for r in proportions.report(manifest, wanted).collect()}
    drawn = [tuple(r) for r in proportions.sample(manifest, wanted).collect()]
    assert len({(d[0], d[3]) for d in drawn}) == len(drawn)  # no record twice in a plan
    by = Counter((d[0], d[2]) for d in drawn)
    sha = {r[0]: X.hashes(r)[0] for r in rows}
    assert len({(d[0], sha[d[3]]) for d in drawn}) == len(drawn)
    for (plan, category), r in report.items():
        if plan in (1, 2):
            c = category.lower().replace("-", "") if plan == 2 else category
            assert by[plan, c] == r["drawn"]
    first = {}
    for r in sorted((r for r in rows if X.split(r) == "train" and X.hashes(r)[0]), key=lambda r: r[0]):
        first.setdefault(X.hashes(r)[0], str(r[3]))  # a record counts under its first row's category
    assert all(by[1, c] == min(30, list(first.values()).count(c)) for c in "01")


def test_sample_decides_what_is_unmet(spark, rows, monkeypatch):
    plans = [(1, "generator", "real", 0.9, 2, 40), (1, "generator", "gen x", 0.1, 500, 40), (1, "generator", "GEN-Y", 0.0, 7, 40)]
    plans += [(2, "label", "0", 0.5, 3, 60), (2, "label", "1", 0.5, 3, 60), (2, "source", "beta", 0.3, 3, 60), (2, "source", "alpha 1", 0.7, 3, 60), (2, "label", "", 0.0, 0, 60), (None, "label", "7", 0.0, 9, 5), (None, "label", "9", 0.0, 1, 5)]
    manifest, wanted = spark.createDataFrame(rows, X.SCHEMA), spark.createDataFrame([(*t, "a", "b") for t in plans], TARGETS).drop("supply", "compared")
    of = {"label": lambda r: None if r[3] is None else str(r[3]), "source": lambda r: X.name(r[4]), "generator": lambda r: X.name(r[5])}
    sha, has = {r[0]: X.hashes(r)[0] for r in rows}, {}
    for r in rows:
        if X.split(r) == "train" and sha[r[0]]:
            for f, g in of.items():
                has.setdefault((f, g(r)), set()).add(sha[r[0]])
    drawn = proportions.sample(manifest, wanted).collect()
    assert len({(d["plan_id"], sha[d["row_id"]]) for d in drawn}) == len(drawn)
    report = {(r["plan_id"], r["category"]): r for r in proportions.report(manifest, wanted).collect()}
    for plan, field, category, share, least, size in plans:
        r, supply = report[plan, category], has.get((field, category if field == "label" else X.name(category)), set())
        want = max(least, int(share * size + 0.5))
        held = sum(sha[d["row_id"]] in supply for d in drawn if d["plan_id"] == plan)
        assert held >= min(want, len(supply)) and r["drawn"] >= min(want, r["owned"])  # short only if the pool is
        assert (r["wanted"], r["held"], r["unmet"]) == (want, held, held < want)
    assert {k for k, r in report.items() if r["unmet"]} == {(1, "gen x"), (None, "9")}
    assert {d["by_field"] for d in drawn if d["plan_id"] == 2} == {"label|source"}  # one sample for both fields
    checked = proportions.sample_check(manifest, wanted).collect()
    assert len(checked) == len(plans) and all(r["as_reported"] and r["floor_kept"] and not r["repeated"] for r in checked)

    take = proportions.take_by_hash
    monkeypatch.setattr(proportions, "take_by_hash", lambda *a, **k: take(*a, **k).where("NOT exists(signature, s -> s.first = 'real')"))
    report = {(r["plan_id"], r["category"]): r for r in proportions.report(manifest, wanted).collect()}
    assert report[1, "real"]["unmet"] and not report[1, "GEN-Y"]["unmet"]  # what isn't drawn isn't held


def test_repair_holds_what_is_wanted_and_no_more():
    a, both = (("a", ("a",)),), (("a", ("a", "b")),)
    got = proportions.repair({a: 90, both: 4}, {(0, "a"): 0.5, (0, "b"): 0.5}, {}, 6, 1, {(0, "a"): 3, (0, "b"): 3})
    assert got[both] >= 3 and sum(got.values()) == 6
    pool = {((x, (x,)), (y, (y,))): 50 for x in "ab" for y in "cde"}
    shares = {(0, "a"): 0.5, (0, "b"): 0.5, (1, "c"): 0.2, (1, "d"): 0.3, (1, "e"): 0.5}
    got = proportions.repair(pool, shares, {}, 60, 1, {c: round(60 * x) for c, x in shares.items()})
    assert sum(got.values()) == 60 and all(sum(n for k, n in got.items() if k[i][0] == c) == round(60 * x) for (i, c), x in shares.items())


def test_swap_repair_ends_at_the_least_deviation():
    rng = random.Random(2)
    for _ in range(60):
        pool = {c: rng.randint(0, 40) for c in "abcd"}
        shares = dict(zip("abcd", np.random.default_rng(rng.randint(0, 9)).dirichlet(np.ones(4))))
        floors, size = {c: rng.randint(0, 5) for c in "abcd"}, rng.randint(0, 60)
        got = proportions.swap_repair(pool, shares, floors, size, 1)
        least = {c: min(floors[c], pool[c]) for c in pool}
        n = min(max(size, sum(least.values())), sum(pool.values()))
        assert sum(got.values()) == n and all(least[c] <= got[c] <= pool[c] for c in pool)
        off = lambda x: sum(abs(x[c] - shares[c] * n) for c in pool)
        for i in pool:  # no single exchange lowers the deviation
            for j in pool:
                if i != j and got[i] > least[i] and got[j] < pool[j]:
                    assert off(got | {i: got[i] - 1, j: got[j] + 1}) >= off(got) - 1e-9
    assert proportions.swap_repair({}, {}, {}, 10, 1) == {}


def test_empty_pool_and_targets(spark):
    none = spark.createDataFrame([], X.SCHEMA)
    wanted = spark.createDataFrame(targets(), TARGETS)
    assert proportions.report(none, wanted).where("drawn > 0").count() == 0 and proportions.sample(none, wanted).count() == 0
    assert proportions.report(spark.createDataFrame(X.manifest(30), X.SCHEMA), spark.createDataFrame([], TARGETS)).count() == 0


def test_torn_groups_are_the_plain_ones(spark, rows):
    groups = {}
    for r in rows:
        if X.name(r[4]) and X.name(r[5]):
            groups.setdefault((X.name(r[4]), X.name(r[5])), []).append(r)
    want = {min(r[0] for r in g) for g in groups.values() if len({X.split(r) for r in g} - {None}) >= 2}
    assert {r[0] for r in splits.torn_groups(spark.createDataFrame(rows, X.SCHEMA)).collect()} == want and want
    assert splits.torn_groups(spark.createDataFrame([], X.SCHEMA)).count() == 0


def test_new_splits_keep_groups_and_shares(spark):
    rng = random.Random(5)
    base = X.manifest(1500, seed=4)
    rows = [(*r[:4], f"s{rng.randint(0, 300)}" if rng.random() > 0.1 else None, *r[5:]) for r in base]
    goal = spark.createDataFrame([("train", 0.8, 0.02), ("val", 0.1, 0.01), ("test_unseen", 0.1, 0.01)], "split string, target_share double, tolerance double")
    got = {r["row_id"]: r for r in splits.new_splits(spark.createDataFrame(rows, X.SCHEMA), goal).collect()}
    assert set(got) == {r[0] for r in rows}
    shares = Counter(r["new_split"] for r in got.values())
    assert abs(shares["train"] / 1500 - 0.8) <= 0.02 and abs(shares["val"] / 1500 - 0.1) <= 0.01
    for key in {(X.name(r[4]), X.name(r[5])) for r in rows if X.name(r[4]) and X.name(r[5])}:
        assert len({got[r[0]]["new_split"] for r in rows if (X.name(r[4]), X.name(r[5])) == key}) == 1
    assert splits.new_splits(spark.createDataFrame([], X.SCHEMA), goal).count() == 0


def test_hash_to_min_and_several_links(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(40)] + [(100, rng.randint(101, 130)) for _ in range(30)] + [(7, 7)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in splits.hash_to_min(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for x in parent}
    rows = [(1, "a", "x"), (2, "a", "y"), (3, "b", "y"), (4, "c", None), (5, "c", "z"), (6, None, None), (7, None, "z")]
    found = splits.components(spark.createDataFrame(rows, "row_id bigint, author string, entity string"), "row_id", [["author"], ["entity"]])
    assert {(r["author"], r["entity"]): r["component"] for r in found.collect()} == {("a", "x"): 1, ("a", "y"): 1, ("b", "y"): 1, ("c", None): 4, ("c", "z"): 4, (None, "z"): 4}


def test_percentiles_within_bounds(spark, monkeypatch):
    monkeypatch.setattr(percentiles, "SIZE", 64)
    monkeypatch.setattr(percentiles, "BUFFERS", 4)
    rng = np.random.default_rng(1)
    classes, err = percentiles.shrink({1: np.sort(rng.normal(size=50_000))})
    assert sum(w * len(v) for w, v in classes.items()) == 50_000 and sum(map(len, classes.values())) <= 256 and err < 2500
    kept, rest = percentiles.collapse(np.arange(10.0), 4)
    assert list(kept) == [1.0, 5.0] and list(rest) == [8.0, 9.0]


def test_percentiles_combine_by_day(spark):
    rng = np.random.default_rng(2)
    rows = [("g", int(d), float(v), "x") for d, v in zip(rng.integers(0, 5, 30_000), np.round(rng.normal(size=30_000), 2))] + [("one", 1, 4.0, "x"), ("nan", 1, float("nan"), "x"), ("null", None, None, "x")]
    df = spark.createDataFrame(rows, "name string, day int, v double, metric string").drop("metric").repartition(5)
    daily = percentiles.combine(percentiles.sketch(df, ["name", "day"], ["v"]), ["name", "day", "metric"])
    got = {(r["name"], r["q"]): r for r in percentiles.percentiles(percentiles.combine(daily, ["name", "metric"]), ["name", "metric"], [0.0, 0.1, 0.5, 0.99, 1.0]).collect()}
    assert {k[0] for k in got} == {"g", "one"} and got["one", 0.5]["value"] == 4.0 and got["one", 0.5]["rank_error"] == 0
    values = np.sort([r[2] for r in rows if r[0] == "g"])
    for q in (0.0, 0.1, 0.5, 0.99, 1.0):
        r, rank = got["g", q], max(1, int(np.ceil(q * len(values))))
        assert r["n"] == len(values) and r["rank_error"] < 0.01 * len(values)
        assert np.searchsorted(values, r["value"], "left") + 1 - r["rank_error"] <= rank <= np.searchsorted(values, r["value"], "right") + r["rank_error"]
    assert percentiles.percentiles(percentiles.combine(percentiles.sketch(df.limit(0), ["name", "day"], ["v"]), ["name", "metric"]), ["name", "metric"], [0.5]).count() == 0


def test_one_link_goes_through_the_exchange(spark, monkeypatch):
    seen = []
    exchange = splits.hash_to_min
    monkeypatch.setattr(splits, "hash_to_min", lambda edges: seen.append(edges.count()) or exchange(edges))
    rows = [(5, "a", "x", "train"), (3, "a", "x", "val"), (7, "a", "y", "train"), (8, None, "x", "val"), (9, "a", None, "val"), (2, "b", "x", "val"), (4, "b", "x", "val")]
    df = spark.createDataFrame(rows, "row_id bigint, source string, generator string, split string")
    assert [r[0] for r in splits.torn_groups(df).collect()] == [3]
    got = {(r["source"], r["generator"]): (r["component"], r["rows"]) for r in splits.components(df, "row_id", [["source", "generator"]]).collect()}
    assert got == {("a", "x"): (3, 2), ("a", "y"): (7, 1), ("b", "x"): (2, 2)}
    assert seen == [3, 3] and splits.torn_groups(df.limit(0)).count() == 0
