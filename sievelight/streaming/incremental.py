"""Incremental scoring: only what isn't in the output yet is scored, in batches or as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.sources.sinks import append_scores

KEYS = ("manifest", "model", "variant")


def written(spark: SparkSession, path: str) -> DataFrame:
    """What an output holds; nothing where it doesn't exist yet."""
    from sievelight.sources.readers import _exists

    schema = "row_id bigint, score double, done boolean, manifest string, model string, variant string"
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def resume(rows: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, manifest: str, model: str, variant: str) -> int:
    """Score the rows (row_id, ...) that the output lacks under this key, append them, and say how many there were.

    The key is part of the output's path, so another model or variant starts afresh. Rows that could not be scored are
    written as done without a score and are not tried again.
    """
    spark = rows.sparkSession
    done = written(spark, path).where((F.col("manifest") == manifest) & (F.col("model") == model) & (F.col("variant") == variant)).select("row_id")
    pending = rows.join(done, "row_id", "left_anti").persist()
    n = pending.count()
    if n:
        scored = score(pending).select("row_id", "score", F.lit(True).alias("done"))
        append_scores(scored.select("*", F.lit(manifest).alias("manifest"), F.lit(model).alias("model"), F.lit(variant).alias("variant")), path)
    pending.unpersist()
    return n


def missing_files(listing: DataFrame, present: DataFrame) -> DataFrame:
    """Files of a listing (path, bytes) that aren't present (path, bytes), or only in part: those that a resumed download still has to fetch, each once."""
    wanted = listing.where(F.col("path").isNotNull()).groupBy("path").agg(F.max("bytes").alias("bytes"))
    have = present.groupBy("path").agg(F.max("bytes").alias("_have"))
    met = wanted.join(have, "path", "left")
    return met.where(F.col("_have").isNull() | (F.col("_have") < F.col("bytes"))).select("path", "bytes")


def stream_files(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], files: int = 1000) -> None:
    """Everything new in a folder of Parquet files since the last run, through ``transform``, appended to ``sink`` exactly once."""
    new = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    query = transform(new).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def event_windows(events: DataFrame, time: str, keys: list[str], length: str, late: str) -> DataFrame:
    """Counts and sums per tumbling window and key; works on streams, where events later than ``late`` are dropped."""
    timed = events.withWatermark(time, late) if events.isStreaming else events
    out = timed.groupBy(F.window(time, length).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), *keys, "n", F.round("total", 6).alias("total"))


def event_sessions(events: DataFrame, time: str, keys: list[str], gap: str, late: str) -> DataFrame:
    """Counts per session: events of a key no further apart than ``gap``."""
    timed = events.withWatermark(time, late) if events.isStreaming else events
    out = timed.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def once(events: DataFrame, ident: list[str], time: str, late: str) -> DataFrame:
    """Each event once; on a stream within the watermark, so that state stays bounded."""
    if events.isStreaming:
        return events.withWatermark(time, late).dropDuplicatesWithinWatermark(ident)
    return events.dropDuplicates(ident)


def exponential_average(rows: DataFrame, key: str, time: str, value: str, decay: float) -> DataFrame:
    """(key, n, ema): the exponential moving average of each key's values in order of time.

    A fold over a key's values; sums of decayed values per day are combined, so no task holds a key's whole series.
    """
    ms = F.unix_micros(F.col(time).cast("timestamp"))
    days = rows.select(key, ms.alias("t"), F.col(value).alias("v")).withColumn("day", F.floor(F.col("t") / 86_400_000_000))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("t", "v"))), lambda x: x["v"])
    folded = days.groupBy(key, "day").agg(ordered.alias("vs")).select(key, "day", F.size("vs").alias("n"), F.aggregate("vs", F.lit(0.0), lambda s, x: s * decay + x * (1 - decay)).alias("s"), F.element_at("vs", 1).alias("first"))
    step = F.array_sort(F.collect_list(F.struct("day", "n", "s", "first")))
    daily = folded.groupBy(key).agg(step.alias("d"))
    start = F.element_at("d", 1)["first"]
    total = F.aggregate("d", start, lambda s, x: s * F.pow(F.lit(decay), x["n"].cast("double")) + x["s"])
    return daily.select(key, F.aggregate("d", F.lit(0).cast("bigint"), lambda s, x: s + x["n"]).alias("n"), total.alias("ema"))
