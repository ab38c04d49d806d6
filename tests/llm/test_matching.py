"""Problems 1 and 5 against plain loops."""

import os
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import fixtures as X

from sievelight.llm import hamming, history, overlap
from sievelight.llm.fulltext import ShardIndex


@pytest.fixture(scope="module", params=[False, True], ids=["plain", "hot"])
def rows(request):
    return X.manifest(420, seed=3, hot=request.param)


def cases(rows):
    accepted, out = [], set()
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        h = X.hashes(r)
        if r[1] and any(X.match(h, a) for a in accepted):
            out.add(r[0])
        else:
            accepted.append(h)
    return out


def test_cases_are_those_of_the_plain_loop(spark, rows):
    got = {r[0] for r in history.found(spark.createDataFrame(rows, X.SCHEMA)).collect()}
    assert got == cases(rows) and len(got) > 50


def test_rounds_settle_the_same(spark, monkeypatch):
    monkeypatch.setattr(history, "LEFT", 0)
    rows = X.manifest(200, seed=5)
    got = {r[0] for r in history.found(spark.createDataFrame(rows, X.SCHEMA)).collect()}
    assert got == cases(rows) and len(got) > 20


def test_merging_in_one_task_is_the_exchange(spark):
    from sievelight.llm.splits import hash_to_min

    rng = random.Random(12)
    edges = spark.createDataFrame([(rng.randint(0, 90), rng.randint(0, 90)) for _ in range(60)], "a bigint, b bigint")
    one = edges.repartition(1).mapInArrow(history._union_find, "node bigint, component bigint")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, hash_to_min(edges).collect()))


def test_batch_by_batch_is_the_same(spark, rows):
    df = spark.createDataFrame(rows, X.SCHEMA)
    h = history.begin(df.where("batch_no = 0"))
    got = set()
    for b in (1, 2, 3):
        got |= {r[0] for r in h.ingest(df.where(f"batch_no = {b}")).collect()}
    assert got == cases(rows)


def test_clusters(spark, rows):
    got = {r["row_id"]: (r["class_id"], r["links"]) for r in history.clusters(spark.createDataFrame(rows, X.SCHEMA)).collect()}
    found = cases(rows)
    by = {r[0]: X.hashes(r) for r in rows}
    assert set(got) == {i for i, h in by.items() if h != (None, None)}
    for i in found:  # a case is linked, and lies in a class with an accepted row that it matches
        assert got[i][1] >= 1
        assert any(X.match(by[i], by[j]) and got[j][0] == got[i][0] for j in got if j not in found)


def test_learned_weights():
    w = history.learn_weights({("same", "0"): 900, ("same", "3"): 50, ("differs", "4"): 300, ("missing", "0"): 100})
    assert w["sha"]["same"] > w["sha"]["differs"] and w["ph"]["0"] > w["ph"]["4"]
    assert history.learn_weights({}) == {"sha": {}, "ph": {}}


def test_no_rows_and_no_hashes(spark):
    empty = spark.createDataFrame([], X.SCHEMA)
    assert history.found(empty).count() == 0 and overlap.found(empty).count() == 0 and history.clusters(empty).count() == 0
    bare = [(i, i % 2, None, None, None, None, "train" if i % 2 else "val", None, None, None, None, None, *X.EXTRA) for i in range(6)]
    df = spark.createDataFrame(bare, X.SCHEMA)
    assert history.found(df).count() == 0 and overlap.found(df).count() == 0 and overlap.overlap_report(df).count() == 0


def test_overlaps_are_those_of_the_plain_loop(spark, rows):
    want = set()
    e = [r for r in rows if X.split(r) in ("val", "test_unseen", "eval_only")]
    t = [r for r in rows if X.split(r) == "train"]
    for a in e:
        for b in t:
            if X.match(X.hashes(a), X.hashes(b)):
                want.add((min(a[0], b[0]), max(a[0], b[0])))
    got = [tuple(r) for r in overlap.found(spark.createDataFrame(rows, X.SCHEMA)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


@pytest.mark.parametrize("blocks", [6, 7])
def test_all_near_pairs_meet_once_even_where_crowded(spark, monkeypatch, blocks):
    monkeypatch.setattr(hamming, "CROWDED_ROWS", 5)
    monkeypatch.setattr(hamming, "CROWDED_SHARE", 1000)
    rng = random.Random(8)
    values = set()
    for _ in range(500):
        v = rng.getrandbits(64) & rng.choice([(1 << 64) - 1, (1 << 30) - 1, 0xFF])
        values |= {v, v ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6)))}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in [*signed, None]], "ph bigint")
    crowded = hamming.crowded_blocks(df, "ph", blocks)
    assert any(crowded)
    plan = hamming.plan_for(len(values), crowded, blocks)
    slots = hamming.packed(df, "ph", plan).groupBy("slot").agg(F.collect_list("phs").alias("phs")).collect()
    want = {(x, y) for x in values for y in values if x < y and (x ^ y).bit_count() <= 4}
    by_key, by_index = [], []
    assert any(plan.tag_of(r["slot"]) >= len(plan.choices) for r in slots)
    for r in slots:
        held = hamming.unpacked(r["phs"])
        for a, b, d in hamming.meetings(plan, plan.tag_of(r["slot"]), held, held, 4):
            assert all((x ^ y).bit_count() == z for x, y, z in zip(a.tolist(), b.tolist(), d.tolist()))
            by_key += zip(a.tolist(), b.tolist())
        for a, b, d, agree in overlap.near_in_shard(plan, r["slot"], held, held):
            assert all((x ^ y).bit_count() == z for x, y, z in zip(a.tolist(), b.tolist(), d.tolist())) and (agree >= blocks - 4).all()
            by_index += zip(a.tolist(), b.tolist())
    for found in (by_key, by_index):
        assert len(found) == len(set(found)) and {p for p in found if p[0] < p[1]} == want


def test_keys_grow_longer_with_the_values():
    sizes = [hamming.plan_for(n).blocks for n in (10**5, 10**8, 10**9, 10**11, 10**13)]
    assert sizes == sorted(sizes) and sizes[0] == 6 and sizes[-1] > 7


def test_history_goes_on_after_it_is_closed_and_opened(spark, rows, monkeypatch):
    monkeypatch.setattr(hamming, "CROWDED_ROWS", 5)
    monkeypatch.setattr(hamming, "CROWDED_SHARE", 1000)
    monkeypatch.setattr(history, "GROWTH", 2)  # so keys are also chosen anew
    df = spark.createDataFrame(rows, X.SCHEMA)
    h = history.begin(df.where("batch_no = 0"))
    got = set()
    for b in (1, 2, 3):
        path = h.path
        h.close()
        h = history.History(spark, path=path)
        got |= {r[0] for r in h.ingest(df.where(f"batch_no = {b}")).collect()}
    assert got == cases(rows)
    # each case has a representative that it links, and merged representatives share a root
    reps = {r["row_id"]: r["rep"] for r in h.table(history.REPS).collect()}
    assert got - set(reps) == set() and not set(reps.values()) & got
    roots = {r["node"]: r["root"] for r in h.roots().collect()}
    assert all(roots.get(r, r) == r for r in roots.values())


def test_an_unfinished_delivery_is_not_seen(spark, rows):
    df = spark.createDataFrame(rows, X.SCHEMA)
    h = history.begin(df.where("batch_no = 0"))
    order = history.Order(df)
    h.accept(history.identified(df.where("batch_no > 0"), order))  # and then the driver is lost
    h = history.History(spark, path=h.path)
    assert {r[0] for r in h.ingest(df.where("batch_no > 0")).collect()} == cases(rows)


def test_backward_search():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 5, (300, 4))
    index = ShardIndex(words, 3)
    patterns = rng.integers(0, 6, (200, 4))
    for least in (1, 2, 4):
        got = {}
        for pattern, word, span, rest in index.matches(patterns, least, most=7):
            for p, w, s, r in zip(pattern, word, span, rest):
                assert (r == words[w, : 4 - least]).all()
                got[int(p), int(w)] = int(s)
        want = {}
        for k, p in enumerate(patterns):
            for i, w in enumerate(words):
                s = next((n for n in range(4) if w[3 - n] != p[3 - n]), 4)
                if s >= least:
                    want[k, i] = s
        assert got == want
