"""Queries that write and read again, resume, stream, and read archives. They write below the shared folder."""

from __future__ import annotations

import io
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from sievelight.operators import metrics as M
from sievelight.operators import scoring
from sievelight.plans.evaluation import CV
from sievelight.session import shared_dir
from sievelight.sources import archives, readers, sinks
from sievelight.streaming import incremental as R

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/sievelight/{name}-{uuid.uuid4().hex}"


def manifest(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/manifest.parquet")


@query("SELECT nullif(path, '') AS path, label, nullif(source, '') AS source, nullif(generator, '') AS generator, nullif(split, '') AS split, coalesce(sha256, '') AS sha256, width, height, coalesce(phash, '') AS phash FROM manifest")
def src_manifest_csv(spark, d):
    """Written as a manifest file and read with its schema, which has no empty texts; a missing hash comes back empty."""
    path = place(spark, "manifest")
    sinks.manifest_csv(manifest(spark, d), path)
    return readers.manifest_csv(spark, path)


@query("SELECT CAST(label AS INT) AS label, count(*) AS n, CAST(sum(width) AS BIGINT) AS width FROM manifest GROUP BY 1")
def src_csv_inferred(spark, d):
    path = place(spark, "inferred")
    manifest(spark, d).select("row_id", "label", "width").write.option("header", True).csv(path)
    return readers.inferred_csv(spark, path).groupBy(F.col("label").cast("int").alias("label")).agg(F.count("*").alias("n"), F.sum(F.col("width").cast("bigint")).alias("width"))


@query("SELECT row_id, label FROM manifest WHERE label IS NOT NULL QUALIFY row_number() OVER (PARTITION BY label ORDER BY row_id) <= 100")
def src_parquet_shards(spark, d):
    """Two columns of all shards, up to a budget per class."""
    from sievelight.operators.sampling import first_per

    return first_per(readers.shards(spark, f"{d}/manifest.parquet", ["row_id", "label"]).where("label IS NOT NULL"), ["label"], ["row_id"], 100)


@query("SELECT nullif(path, '') AS path, label, nullif(source, '') AS source, nullif(generator, '') AS generator, nullif(split, '') AS split, nullif(sha256, '') AS sha256, width, height, nullif(phash, '') AS phash FROM manifest")
def sink_split_manifests(spark, d):
    """One manifest file per split, read again; no split and an empty one share a folder."""
    path = place(spark, "splits")
    sinks.split_manifests(manifest(spark, d), path)
    columns = ", ".join(c for c in readers.MANIFEST_SCHEMA.split(", ") if not c.startswith("split ")) + ", split string"
    return spark.read.schema(columns).option("header", True).csv(path).select(*readers.MANIFEST_COLUMNS)


@query("SELECT count(*) AS n, CAST(0 AS BIGINT) AS out_of_order FROM manifest")
def sink_manifest(spark, d):
    """Written in order of source, split and path; rows that stand before a smaller one, within a file or across files, are counted."""
    path = place(spark, "sorted")
    sinks.manifest_csv(manifest(spark, d), path)
    read = spark.read.schema(readers.MANIFEST_SCHEMA).option("header", True).csv(path)
    place_of = F.struct("_metadata.file_block_start", F.monotonically_increasing_id().alias("i"))
    text = F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in ("source", "split", "path")])
    lines = read.select(F.col("_metadata.file_name").alias("file"), place_of.alias("at"), text.alias("key"))
    w = Window.partitionBy("file").orderBy("at")  # a file holds what one task wrote
    inside = lines.select("file", "key", F.lag("key").over(w).alias("before"))
    files = inside.groupBy("file").agg(F.count("*").alias("n"), F.count_if(F.col("before") > F.col("key")).alias("bad"), F.min("key").alias("low"), F.max("key").alias("high"))
    across = files.select("n", "bad", "low", F.lag("high").over(Window.orderBy("file")).alias("before"))  # one row per file
    return across.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("bad") + (F.col("before") > F.col("low")).cast("bigint")), F.sum("bad"), F.lit(0)).alias("out_of_order"))


@query("SELECT image_path, round(least(greatest(CASE WHEN pred IS NULL OR isnan(pred) THEN 0.5 ELSE pred END, 0), 1), 6) AS pred FROM predictions")
def sink_pred_json(spark, d):
    path = place(spark, "json")
    sinks.predictions_json(spark.read.parquet(f"{d}/predictions.parquet"), path)
    return spark.read.schema("image_path string, pred double").json(path)


TEXT = "CASE WHEN {0} IS NULL OR isnan({0}) THEN 'NaN' ELSE printf('%.6f', {0}) END"


@query(f"""SELECT image_path, {TEXT.format('pred')} AS pred, CASE WHEN pred IS NULL OR isnan(pred) THEN 'UNREADABLE' WHEN pred >= 0.5 THEN 'FAKE' ELSE 'REAL' END AS verdict, {TEXT.format('dinov3_l')} AS dinov3_l FROM predictions""")
def sink_pred_csv(spark, d):
    path = place(spark, "csv")
    sinks.predictions_csv(spark.read.parquet(f"{d}/predictions.parquet"), path, ["dinov3_l"])
    return spark.read.option("header", True).csv(path)


@query("SELECT p.pred_id, p.image_path, m.label AS actual, CASE WHEN NOT isnan(p.pred) THEN p.pred END AS pred FROM predictions p JOIN manifest m USING (row_id)")
def sink_records(spark, d):
    """Records with their nullable fields, as JSON and back."""
    path = place(spark, "records")
    p = spark.read.parquet(f"{d}/predictions.parquet").select("pred_id", "row_id", "image_path", F.when(~F.isnan("pred"), F.col("pred")).alias("pred"))
    p.join(manifest(spark, d).select("row_id", F.col("label").alias("actual")), "row_id").drop("row_id").write.json(path)
    return spark.read.schema("pred_id bigint, image_path string, actual int, pred double").json(path)


@query("SELECT DISTINCT lower(trim(phash)) AS hash FROM manifest WHERE split = 'eval_only' AND regexp_full_match(lower(trim(phash)), '[0-9a-f]{16}')")
def src_hash_list(spark, d):
    """A hash list, written with comments and read again."""
    path = place(spark, "hashes")
    h = F.lower(F.trim("phash"))
    some = manifest(spark, d).where("split = 'eval_only'").where(F.regexp_like(h, F.lit("^[0-9a-f]{16}$"))).select(F.concat(F.upper(h), F.lit("  # listed")).alias("hash"))
    sinks.hash_list(some, path, "perceptual hashes\nof evaluation images")
    return readers.hash_list(spark, path)


@query(f"{CV} SELECT * FROM cv")
def sink_cv_csv(spark, d):
    """Cross-validation results as a file and back, all numbers of it."""
    from sievelight.operators.selection import cv_summary, with_fold
    from sievelight.plans.evaluation import clean

    path = place(spark, "cv")
    cv = cv_summary(with_fold(clean(spark, d), "row_id", 5))
    cv.write.option("header", True).csv(path)
    return spark.read.schema(cv.schema).option("header", True).csv(path)


def pending(spark: SparkSession, d: str) -> DataFrame:
    return scoring.images_of(spark.read.parquet(f"{d}/embeddings.parquet"))


def scorer(rows: DataFrame) -> DataFrame:
    return scoring.score(rows, "mean_intensity")


@query("SELECT 'first' AS run, count(*) AS added FROM embeddings UNION ALL SELECT 'second', 0 UNION ALL SELECT 'written', count(*) FROM embeddings")
def inc_resume(spark, d):
    """A second run over the same rows adds nothing."""
    path = place(spark, "scores")
    added = [(n, R.resume(pending(spark, d), scorer, path, "m", "mean_intensity", "clean")) for n in ("first", "second")]
    return spark.createDataFrame([*added, ("written", R.written(spark, path).count())], "run string, added bigint")


@query("SELECT 'clean' AS variant, count(*) AS added FROM embeddings UNION ALL SELECT 'jpeg60', count(*) FROM embeddings")
def inc_invalidate(spark, d):
    """Another variant is another key: all of it is scored."""
    path = place(spark, "keys")
    return spark.createDataFrame([(v, R.resume(pending(spark, d), scorer, path, "m", "mean_intensity", v)) for v in ("clean", "jpeg60")], "variant string, added bigint")


@query("""WITH l AS (SELECT path, max(CAST(width AS BIGINT) * height) AS bytes FROM manifest WHERE path IS NOT NULL GROUP BY 1), h AS (SELECT path, max(CAST(width AS BIGINT) * height) AS have FROM manifest WHERE batch_no < 3 AND path IS NOT NULL GROUP BY 1)
SELECT l.path, l.bytes FROM l LEFT JOIN h USING (path) WHERE have IS NULL OR have < bytes""")
def inc_download_resume(spark, d):
    """What of a listing is not there yet, or only in part; sizes in pixels stand for bytes."""
    listing = manifest(spark, d).select("path", (F.col("width").cast("bigint") * F.col("height")).alias("bytes"), "batch_no")
    return R.missing_files(listing, listing.where("batch_no < 3"))


@query("SELECT vec_id AS row_id, v AS variant, len(embedding) AS size, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings, (SELECT unnest(['clean', 'mild']) AS v)")
def sink_feature_cache(spark, d):
    """Vectors kept under (manifest, model, variant) in two runs and read again; a variant that isn't kept is an error."""
    path = place(spark, "features")
    vectors = spark.read.parquet(f"{d}/embeddings.parquet").select(F.lit("m").alias("manifest"), F.lit("v").alias("model"), F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<float>").alias("vector"))
    for v in ("clean", "mild"):
        sinks.append_features(vectors.withColumn("variant", F.lit(v)), path)
    try:
        readers.feature_cache(spark, path, "m", "v", ["clean", "heavy"])
        raise AssertionError("a missing cache went unnoticed")
    except FileNotFoundError:
        pass
    read = readers.feature_cache(spark, path, "m", "v", ["clean", "mild"])
    return read.select("row_id", "variant", F.size("vector").alias("size"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def ext_stream_windows(spark, d):
    """Daily windows of the event stream, run as a batch; the same function takes the stream."""
    e = spark.read.parquet(f"{d}/events.parquet")
    out = R.event_windows(e.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], "1 day", "1 hour")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT event_id, user_id, round(value * 2, 6) AS twice FROM events")
def inc_micro_batch(spark, d):
    """A folder of files streamed into a sink in micro-batches, twice; the second run finds nothing new."""
    source, sink, state = place(spark, "in"), place(spark, "out"), place(spark, "state")
    spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "value").repartition(4).write.parquet(source)
    for _ in range(2):
        R.stream_files(spark, source, "event_id bigint, user_id bigint, value double", sink, state, lambda s: s.select("event_id", "user_id", F.round(F.col("value") * 2, 6).alias("twice")), files=2)
    return spark.read.parquet(sink)


@query("SELECT user_id, count(*) AS n, round(list_reduce(list(value ORDER BY ts, value), lambda s, x: s * 0.9 + x * CAST(0.1 AS DOUBLE)), 9) AS ema FROM events GROUP BY 1")
def inc_ema(spark, d):
    """Counts and exponential averages."""
    return R.exponential_average(spark.read.parquet(f"{d}/events.parquet"), "user_id", "ts", "value", 0.9).withColumn("ema", F.round("ema", 9))


@query("SELECT CAST(item_id AS VARCHAR) || '.txt' AS name, octet_length(encode(text)) AS size, sha256(text) AS digest FROM eval_items")
def src_remote_zip(spark, d):
    """The evaluation items, which do not grow, packed into an archive and read through the data source."""
    path = _archive(spark, d, zipfile.ZIP_DEFLATED)
    spark.dataSource.register(archives.ZipSource)
    members = spark.read.format("zip_members").option("max_span", 20_000).load(path)
    return members.select("name", "size", F.sha2("content", 256).alias("digest"))


def _archive(spark: SparkSession, d: str, method: int) -> str:
    """The evaluation items, which do not grow, as an archive in the shared folder."""
    path = place(spark, "archive") + ".zip"
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", method) as z:
        for r in spark.read.parquet(f"{d}/eval_items.parquet").select("item_id", "text").toLocalIterator():
            z.writestr(f"{r['item_id']}.txt", r["text"])
    archives.write(path, packed.getvalue())
    return path


@query("SELECT CAST(item_id AS VARCHAR) || '.txt' AS name, octet_length(encode(text)) AS size, reads FROM eval_items, (SELECT unnest([1, 1]) AS reads)")
def src_zip_index_cache(spark, d):
    """An archive's directory kept as a table under the archive's place and size: asked twice, it is read once."""
    path, kept = _archive(spark, d, zipfile.ZIP_STORED), place(spark, "members")
    reads: list[str] = []
    read = lambda p: reads.append(p) or archives.directory(p)
    first = archives.indexed(spark, path, kept, read)
    second = archives.indexed(spark, path, kept, read)
    return first.unionByName(second).select("name", "size", F.lit(len(reads)).alias("reads"))


@query("""WITH m AS (SELECT source, doc_id * 600 AS s, doc_id * 600 + n_chars AS e FROM documents WHERE source IS NOT NULL AND n_chars IS NOT NULL),
r AS (SELECT *, max(e) OVER (PARTITION BY source ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM m),
f AS (SELECT *, sum(CASE WHEN reached IS NULL OR s - reached > 2000 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY s, e) AS island FROM r)
SELECT source, CAST(island AS BIGINT) AS island, min(s) AS first, max(e) AS last, count(*) AS members FROM f GROUP BY 1, 2""")
def win_coalesce_spans(spark, d):
    """Documents as members of one archive per source: those with small gaps share an island."""
    islands = archives.gap_groups(spans_of(spark, d), "source", "s", "e", 2000)
    return islands.groupBy("source", F.col("island").cast("bigint").alias("island")).agg(F.min("s").alias("first"), F.max("e").alias("last"), F.count("*").alias("members"))


def spans_of(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet").where("source IS NOT NULL AND n_chars IS NOT NULL")
    return docs.select("source", (F.col("doc_id") * 600).alias("s"), (F.col("doc_id") * 600 + F.col("n_chars")).alias("e"))


@query()
def win_coalesce_spans_capped(spark, d):
    """The islands cut into spans of bounded length; tested against a plain loop."""
    return archives.span_groups(spans_of(spark, d), "source", "s", "e", 2000, 20_000)


@query("SELECT 'items/' || item_id || '.txt' AS path, octet_length(encode(text)) AS bytes, CAST(4 AS INT) AS pages FROM eval_items")
def src_repo_listing(spark, d):
    """A repository's listing, read page by page (of 100; the last is short) and kept: asked again, no page is read."""
    items = spark.read.parquet(f"{d}/eval_items.parquet").select("item_id", F.octet_length("text").alias("n")).orderBy("item_id").collect()  # does not grow
    entries = [{"Path": "items", "Type": "tree"}, *({"Path": f"items/{r['item_id']}.txt", "Type": "blob", "Size": r["n"]} for r in items)]
    asked: list[int] = []

    def page(number: int) -> list[dict]:
        asked.append(number)
        return entries[(number - 1) * 100 : number * 100]

    kept = place(spark, "listing")
    for _ in range(2):
        files = readers.repository_listing(spark, page, kept)
    return files.withColumn("pages", F.lit(len(asked)))


#: The published fusion artifact.
ARTIFACT = """{
  "model": "SVM (linear)",
  "threshold": 0.7,
  "criterion": "max mean CV balanced accuracy; tie-break min mean CV log loss",
  "test_set_used_for_selection": false,
  "feature_order": ["Community Forensics Pr", "DINOv3-L detector Pr", "DINOv3-B stacking detector Pr"],
  "best_params": {"model__C": 0.1},
  "development_rows": 1383,
  "final_test_rows": 617,
  "random_state": 1337,
  "group_source": "_diversity_group"
}"""
FEATURES = dict(zip(("Community Forensics Pr", "DINOv3-L detector Pr", "DINOv3-B stacking detector Pr"), M.EXPERTS))


@query("""WITH f AS (SELECT 1 AS place, 'community_forensics' AS feature, community_forensics AS p FROM predictions UNION ALL SELECT 2, 'dinov3_l', dinov3_l FROM predictions UNION ALL SELECT 3, 'dinov3_b', dinov3_b FROM predictions)
SELECT place, feature, CAST(0.65 AS DOUBLE) AS threshold, count(*) FILTER (NOT isnan(p) AND p BETWEEN 0 AND 1) AS usable, count(*) FILTER (NOT isnan(p) AND p BETWEEN 0 AND 1 AND p >= 0.65) AS above FROM f GROUP BY 1, 2""")
def src_model_artifact(spark, d):
    """The artifact's features in its order, with its threshold overridden, applied to the predictions' columns."""
    artifact = readers.config(ARTIFACT, ["threshold=0.65"])
    p = spark.read.parquet(f"{d}/predictions.parquet")
    columns = [FEATURES[f] for f in artifact["feature_order"]]
    long = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("place"), F.lit(c).alias("feature"), F.col(c).alias("p")) for i, c in enumerate(columns)]))
    usable = M.valid(F.col("p"))
    counts = p.select(long.alias("x")).select("x.*").groupBy("place", "feature").agg(F.count_if(usable).alias("usable"), F.count_if(usable & (F.col("p") >= artifact["threshold"])).alias("above"))
    return counts.withColumn("threshold", F.lit(artifact["threshold"]))
