"""Joins and selections that keep their balance when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: A key is hot if it holds more than one in HOT_SHARE rows, so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 1000


def hot_join(big: DataFrame, small: DataFrame, on: list[str], rows: str, total: int) -> DataFrame:
    """Inner join of ``big`` with ``small`` (unique in ``on``), whose column ``rows`` counts the rows of ``big`` by key.

    Hot keys, fewer than HOT_SHARE by their definition, are broadcast; all other keys meet by shuffle, in which none of
    them is larger than total / HOT_SHARE rows. Null keys meet nothing. No row is dropped or sent twice.
    """
    hot = small.where(F.col(rows) * HOT_SHARE > F.lit(total))
    cold = small.where(F.col(rows) * HOT_SHARE <= F.lit(total))
    near = big.join(F.broadcast(hot), on)
    far = big.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on)
    return near.unionByName(far)


def uniform(*parts: Column | str, seed: int = 0) -> Column:
    """A number in (0, 1) that depends on the values of ``parts`` only."""
    bits = F.shiftrightunsigned(F.xxhash64(*parts, F.lit(seed)), 12)
    return (bits.cast("double") + 0.5) / float(1 << 52)


def take_by_hash(rows: DataFrame, wanted: DataFrame, keys: list[str], ident: str, seed: int, buckets: int = 4096) -> DataFrame:
    """Of each key the ``take`` rows (a column of ``wanted``, which is unique in ``keys`` and has a proven bound) of least hash.

    Rows are counted by key and hash bucket, a cumulated count finds the bucket in which the last wanted row lies, and
    only the rows of that one bucket are ranked. So a hot key costs one task no more than its share / buckets.
    """
    hashed = rows.withColumn("_h", uniform(ident, seed=seed)).withColumn("_b", F.floor(F.col("_h") * buckets).cast("int"))
    counts = hashed.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    cut = (
        counts.withColumn("_upto", upto)
        .join(F.broadcast(wanted.select(*keys, "take")), keys)
        .where((F.col("_upto") >= F.col("take")) & (F.col("_upto") - F.col("_n") < F.col("take")))
        .select(*keys, F.col("_b").alias("_cut"), (F.col("take") - F.col("_upto") + F.col("_n")).alias("_rest"))
    )
    state = hashed.join(F.broadcast(wanted.select(*keys, "take")), keys).join(F.broadcast(cut), keys, "left")
    whole = state.where((F.col("take") > 0) & (F.col("_cut").isNull() | (F.col("_b") < F.col("_cut"))))
    last = state.where((F.col("take") > 0) & (F.col("_b") == F.col("_cut")))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_h", ident))
    last = last.withColumn("_r", rank).where(F.col("_r") <= F.col("_rest"))
    return whole.select(*rows.columns).unionByName(last.select(*rows.columns))


def random_rank(rows: DataFrame, keys: list[str], digits: Column) -> DataFrame:
    """``rows`` with ``place``: 1, 2, ... within each key by ``digits`` (hex digits that order rows at random).

    The first three digits are the bucket, so a key that holds most rows is spread over 4096 windows.
    """
    return bucket_rank(rows, keys, digits, F.substring(digits, 1, 3))


def bucket_rank(rows: DataFrame, keys: list[str], order: Column, bucket: Column) -> DataFrame:
    """``rows`` with ``place``: 1, 2, ... within each key by ``order``; ``bucket`` must not fall as ``order`` rises.

    A running count of buckets gives where each begins, and only rows of one bucket are ordered together.
    """
    drawn = rows.withColumn("_d", order).withColumn("_b", bucket)
    counts = drawn.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    names = [*keys, "_b"]
    start = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(names)], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_at"))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(names)]
    joined = drawn.join(start, on).drop(*[f"_k{i}" for i in range(len(names))])
    inside = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_d"))
    return joined.withColumn("place", (F.col("_at") + inside).cast("bigint")).drop("_d", "_b", "_at")


#: Buckets by which hot keys are looked for.
KEY_BUCKETS = 1 << 16


def key_bucket(on: list[str]) -> Column:
    return F.pmod(F.xxhash64(*on), F.lit(KEY_BUCKETS))


def hot_buckets(big: DataFrame, on: list[str], total: int) -> list[int]:
    """Buckets of key hashes that hold more than one in HOT_SHARE of ``total`` rows, so fewer than HOT_SHARE; every hot key lies in one.

    Counts are combined map-side, so at most KEY_BUCKETS rows leave a task. No key of fewer than 1000 rows is hot.
    """
    least = max(total // HOT_SHARE, 1000)
    if total <= least:
        return []
    some = F.lit(True)
    for c in on:
        some = some & F.col(c).isNotNull()
    counts = big.where(some).groupBy(key_bucket(on).alias("b")).agg(F.count("*").alias("n"))
    return [r["b"] for r in counts.where(F.col("n") > least).collect()]


def salted_join(big: DataFrame, small: DataFrame, on: list[str], hot: list[int], salts: int = 64) -> DataFrame:
    """Inner join on ``on``. Rows of ``big`` under a key in a hot bucket are spread over ``salts`` tasks, to each of which go copies of the few rows of ``small`` under such keys."""
    if not hot:
        return big.join(small, on)
    is_hot = key_bucket(on).isin(hot)
    every = [c for c in big.columns if c not in on]
    left = big.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(*(every or on)), F.lit(salts))).otherwise(F.lit(0).cast("bigint")))
    right = small.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint")))))
    return left.join(right, [*on, "_salt"]).drop("_salt")
