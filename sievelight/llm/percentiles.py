"""Percentiles of very large numeric columns by deterministic buffer collapsing.

A sketch of a group is a set of rows, each a sorted buffer of values of one weight. Buffers of a group are put together
freely (a union of rows); when a group stores more than BUFFERS x SIZE values, the values of one weight w are merged and
every c-th is kept, from the middle of the first c, with weight c x w: a collapse. It moves the rank of no value by more
than w x (c // 2); these amounts are added up in ``err``, so every result states its own bound. Weights are powers of two.

Scheduling is a tree: a task collapses what it reads, per group and day; days are combined per group; anything kept per
day can be combined again later, in any order, with bounds that add up.

Defined results: null and NaN values are left out, and a group without values has no row; values out of any range count as
they are; ties are ordinary values; a null name is a group of its own; repeated rows count each; an empty table gives an
empty result. The percentile q of n values is the value of rank ceil(q x n), at least 1; groups of at most BUFFERS x SIZE
values are exact (err 0).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from sievelight.functions.normal import name_of
from sievelight.operators.skew import hot_join
from sievelight.session import materialise

SIZE, BUFFERS = 1024, 8
#: Values that a task holds before it collapses them.
HELD = 400_000


def collapse(values: np.ndarray, c: int) -> tuple[np.ndarray, np.ndarray]:
    """(kept, rest) of a sorted array: kept are the middles of each c values, rest what is too short for another c."""
    whole = len(values) // c * c
    return values[(c + 1) // 2 - 1 : whole : c], values[whole:]


def shrink(classes: dict[int, np.ndarray]) -> tuple[dict[int, np.ndarray], int]:
    """Collapse sorted values by weight until at most BUFFERS x SIZE are stored; and the rank error this adds."""
    err = 0
    while sum(map(len, classes.values())) > BUFFERS * SIZE:
        full = [w for w, v in classes.items() if len(v) >= SIZE]
        w = min(full) if full else max(classes, key=lambda k: len(classes[k]))
        values = classes.pop(w)
        c = 2
        while len(values) > c * SIZE:
            c *= 2
        kept, rest = collapse(values, c)
        err += w * (c // 2)
        if len(rest):
            classes[w] = rest
        up = classes.get(w * c)
        classes[w * c] = kept if up is None else np.sort(np.concatenate([up, kept]))
    return classes, err


def _codes(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each row's key, and a row that has it for each number."""
    code = np.zeros(len(columns[0]), dtype=np.int64)
    for column in columns:
        one = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        code = code * (int(one.max(initial=0)) + 1) + one
        _, code = np.unique(code, return_inverse=True)
    _, first, code = np.unique(code, return_index=True, return_inverse=True)
    return code.reshape(-1), first


def _compact(code: np.ndarray, weight: np.ndarray, value: np.ndarray, err: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One sorted buffer per group and weight: (group, weight, err, offsets, values). ``err`` is per group."""
    order = np.lexsort((value, weight, code))
    code, weight, value = code[order], weight[order], value[order]
    stored = np.bincount(code, minlength=len(err))
    large = np.flatnonzero(stored > BUFFERS * SIZE)
    if len(large):
        keep = stored[code] <= BUFFERS * SIZE
        ends = np.cumsum(stored)
        parts = [(code[keep], weight[keep], value[keep])]
        for g in large:  # few: each holds more than BUFFERS x SIZE values
            at = slice(ends[g] - stored[g], ends[g])
            w, v = weight[at], value[at]
            cuts = np.flatnonzero(np.diff(w)) + 1
            classes = {int(ws[0]): vs for ws, vs in zip(np.split(w, cuts), np.split(v, cuts))}
            classes, more = shrink(classes)
            err[g] += more
            for k, vs in sorted(classes.items()):
                parts.append((np.full(len(vs), g), np.full(len(vs), k), vs))
        code, weight, value = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((value, weight, code))
        code, weight, value = code[order], weight[order], value[order]
    start = np.flatnonzero(np.r_[True, (np.diff(code) != 0) | (np.diff(weight) != 0)]) if len(code) else np.zeros(0, dtype=np.int64)
    group = code[start]
    lead = np.r_[True, np.diff(group) != 0] if len(group) else np.zeros(0, dtype=bool)
    return group, weight[start], np.where(lead, err[group], 0), np.r_[start, len(value)].astype(np.int32), value


def _rows(keys: list[pa.Array], names: list[str], first: np.ndarray, found) -> pa.RecordBatch:
    group, weight, err, offsets, values = found
    at = pa.array(first[group])
    columns = [k.take(at) for k in keys]
    return pa.RecordBatch.from_arrays([*columns, pa.array(weight), pa.array(err), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=[*names, "weight", "err", "buffer"])


def _gather(batches: Iterator[pa.RecordBatch], most: int, size) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += size(batch)
        if n >= most:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _flat(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _schema(rows: DataFrame, keys: list[str]) -> str:
    kinds = dict(rows.dtypes)
    return ", ".join(f"`{k}` {kinds[k]}" for k in keys)


def sketch(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys..., metric, weight, err, buffer): what each task makes of its rows; no shuffle."""
    picked = rows.select(*keys, *[F.col(v).cast("double").alias(v) for v in values])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gather(batches, HELD, lambda b: b.num_rows):
            if not table.num_rows:
                continue
            columns = [_flat(table.column(k)) for k in keys]
            code, first = _codes(columns)
            for v in values:
                x = _flat(table.column(v)).to_numpy(zero_copy_only=False)
                some = ~np.isnan(x)
                if not some.any():
                    continue
                found = _compact(code[some], np.ones(int(some.sum()), dtype=np.int64), x[some], np.zeros(len(first), dtype=np.int64))
                out = _rows(columns, keys, first, found)
                yield pa.RecordBatch.from_arrays([*out.columns[: len(keys)], pa.array([v] * out.num_rows, pa.string()), *out.columns[len(keys) :]], names=[*keys, "metric", "weight", "err", "buffer"])

    return picked.mapInArrow(run, f"{_schema(picked, keys)}, metric string, weight bigint, err bigint, buffer array<double>")


def combine(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches put together per group of ``keys`` (which include the metric); other keys are given up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gather(batches, HELD, lambda b: len(b.column(b.schema.get_field_index("buffer")).flatten()) + b.num_rows):
            if not table.num_rows:
                continue
            columns = [_flat(table.column(k)) for k in keys]
            code, first = _codes(columns)
            lists = _flat(table.column("buffer"))
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            weight = _flat(table.column("weight")).to_numpy(zero_copy_only=False)
            err = np.bincount(code, weights=_flat(table.column("err")).to_numpy(zero_copy_only=False), minlength=len(first)).astype(np.int64)
            yield _rows(columns, keys, first, _compact(np.repeat(code, sizes), np.repeat(weight, sizes), lists.flatten().to_numpy(zero_copy_only=False), err))

    shuffled = sketches.select(*keys, "weight", "err", "buffer").repartition(*keys).sortWithinPartitions(*keys)
    return shuffled.mapInArrow(run, f"{_schema(sketches, keys)}, weight bigint, err bigint, buffer array<double>")


def percentiles(sketches: DataFrame, keys: list[str], quantiles: list[float]) -> DataFrame:
    """(keys..., n, q, value, rank_error) of combined sketches: the true rank of value is at most rank_error off ceil(q x n)."""
    total = sketches.groupBy(*keys).agg(F.sum(F.col("weight") * F.size("buffer")).alias("n"), F.sum("err").alias("rank_error"))
    window = Window.partitionBy(*keys)
    weighed = sketches.select(*keys, "weight", F.explode("buffer").alias("v"))
    upto = weighed.withColumn("upto", F.sum("weight").over(window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("weight").over(window))
    ranks = F.array(*[F.struct(F.lit(q).alias("q"), F.greatest(F.ceil(F.lit(q) * F.col("n")), F.lit(1)).alias("rank")) for q in quantiles])
    inside = F.filter(ranks, lambda t: (t["rank"] <= F.col("upto")) & (t["rank"] > F.col("upto") - F.col("weight")))
    picked = upto.select(*keys, "v", F.explode(inside).alias("t")).select(*keys, F.col("t.q").alias("q"), F.col("v").alias("value"))
    return picked.join(total, keys).select(*keys, "n", "q", "value", "rank_error")


def day_of(column: str):
    """Days since 1970 as int; rows without a time are day null."""
    return F.unix_date(F.col(column).cast("date"))


def keyed(name: Column) -> Column:
    """A name as a key that is never null and takes no null for an empty name: null is empty, all others begin with a sign."""
    return F.coalesce(F.concat(F.lit("="), name), F.lit(""))


def named(rows: DataFrame) -> DataFrame:
    """Keys back to names."""
    return rows.withColumn("name", F.when(F.col("name") != "", F.substr("name", F.lit(2))))


def manifest_values(manifest: DataFrame) -> DataFrame:
    fields = ("source", "generator")
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("by_field"), keyed(name_of(F.col(f))).alias("name")) for f in fields]))
    return manifest.select("width", "height", day_of("added_at").alias("day"), pairs.alias("k")).select("k.*", "day", "width", "height")


def prediction_values(predictions: DataFrame) -> DataFrame:
    return predictions.select(F.lit("condition").alias("by_field"), keyed(F.col("condition")).alias("name"), day_of("scored_at").alias("day"), "pred")


KEYS = ["by_field", "name", "metric"]


def daily(manifest: DataFrame, predictions: DataFrame) -> DataFrame:
    """Sketches per group and day, to be kept: sizes by source and generator, scores by condition."""
    days = ["by_field", "name", "day"]
    sizes = sketch(manifest_values(manifest), days, ["width", "height"])
    scores = sketch(prediction_values(predictions), days, ["pred"])
    return combine(sizes.unionByName(scores), [*days, "metric"])


def over_all_days(kept: DataFrame, quantiles: list[float]) -> DataFrame:
    return percentiles(materialise(combine(kept, KEYS), "sketches"), KEYS, quantiles)


def bounds_hold(estimates: DataFrame, manifest: DataFrame, predictions: DataFrame) -> DataFrame:
    """(by_field, name, metric, q, n, holds): whether each value's true rank lies within its stated bound, counted over all rows."""
    long = lambda rows, metrics: rows.select("by_field", "name", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics])).alias("m")).select("by_field", "name", "m.*")
    rows = long(manifest_values(manifest), ["width", "height"]).unionByName(long(prediction_values(predictions), ["pred"])).where(F.col("x").isNotNull() & ~F.isnan("x"))
    asked = materialise(estimates.groupBy(*KEYS).agg(F.max("n").alias("n"), F.collect_list(F.struct("q", "value", "rank_error")).alias("asked")), "asked")
    total = asked.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    met = hot_join(rows, asked, KEYS, "n", total).select(*KEYS, "n", "x", F.explode("asked").alias("a")).select(*KEYS, "n", "x", "a.*")
    counts = met.groupBy(*KEYS, "n", "q", "value", "rank_error").agg(F.count_if(F.col("x") < F.col("value")).alias("less"), F.count_if(F.col("x") <= F.col("value")).alias("upto"))
    rank = F.greatest(F.ceil(F.col("q") * F.col("n")), F.lit(1))
    return counts.select(*KEYS, "q", "n", ((rank >= F.col("less") + 1 - F.col("rank_error")) & (rank <= F.col("upto") + F.col("rank_error"))).alias("holds"))
