"""Image operators over the embeddings, taken as 8 x 8 grey images, and scorers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.functions import images as I
from sievelight.operators import scoring as S
from sievelight.session import shared_dir
from sievelight.sources import readers

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rows(spark: SparkSession, d: str) -> DataFrame:
    return S.images_of(spark.read.parquet(f"{d}/embeddings.parquet"))


PIX = "WITH x AS (SELECT vec_id AS row_id, list_transform(embedding, lambda x: CAST(least(greatest(floor(CAST(x AS DOUBLE) * 255 + 128), 0), 255) AS INT)) AS p FROM embeddings)"


def pixels(img) -> dict:
    return {"pixels": [int(v) for v in img.reshape(-1)]}


@query(f"{PIX} SELECT row_id, round(CAST(list_sum(p) AS DOUBLE) / 64 / 255, 8) AS intensity FROM x")
def img_mean_intensity(spark, d):
    return S.score(rows(spark, d), "mean_intensity").select("row_id", F.round("score", 8).alias("intensity"))


@query(f"{PIX} SELECT row_id, flatten(list_transform([2, 3, 4, 5, 6, 7], lambda r: p[(r - 1) * 8 + 2 : (r - 1) * 8 + 7])) AS pixels FROM x")
def img_center_crop(spark, d):
    return S.each(rows(spark, d), lambda i, x: pixels(I.centre_crop(x, 0.7)), "pixels array<int>")


@query(f"{PIX} SELECT row_id, list_transform(p, lambda v: round((v / 255.0 - 0.485) / 0.229, 6)) AS red FROM x")
def img_to_tensor(spark, d):
    return S.each(rows(spark, d), lambda i, x: {"red": [round(float(v), 6) for v in I.to_tensor(x)[0].reshape(-1)]}, "red array<double>")


@query(f"{PIX} SELECT row_id, flatten(list_transform([1, 2, 3, 4, 5, 6, 7, 8, 1, 2, 3, 4], lambda r: list_concat(p[(r - 1) * 8 + 1 : r * 8], p[(r - 1) * 8 + 1 : (r - 1) * 8 + 4]))) AS pixels FROM x")
def img_fit(spark, d):
    return S.each(rows(spark, d), lambda i, x: pixels(I.fit(x, 12)), "pixels array<int>")


@query()
def img_phash(spark, d):
    return S.each(rows(spark, d), lambda i, x: {"phash": I.phash(x)}, "phash string")


@query()
def img_blur(spark, d):
    return S.each(rows(spark, d), lambda i, x: pixels(I.blur(x, 1.5)), "pixels array<int>")


@query()
def img_resize(spark, d):
    return S.each(rows(spark, d), lambda i, x: pixels(I.resize(x, 0.6)), "pixels array<int>")


@query()
def img_noise(spark, d):
    return S.each(rows(spark, d), lambda i, x: pixels(I.noise(x, 0.08, I.generator(1337, i, "noise=0.08"))), "pixels array<int>")


@query()
def img_jitter(spark, d):
    return S.each(rows(spark, d), lambda i, x: pixels(I.jitter(x, 0.25, I.generator(1337, i, "jitter=0.25"))), "pixels array<int>")


@query()
def img_chain(spark, d):
    steps = [("resize", 0.6), ("noise", 0.03), ("blur", 0.7)]
    return S.each(rows(spark, d), lambda i, x: pixels(I.chain(x, steps, I.generator(1337, i, "chain"))), "pixels array<int>")


@query()
def img_grid(spark, d):
    """The mean intensity of every image at every cell but those that need a codec."""
    cells = spark.read.parquet(f"{d}/degradation_cells.parquet").where("family <> 'jpeg'")
    listed = [(r["label"], r["family"], r["value"]) for r in cells.collect()]  # fifteen at most

    def each_cell(i, x):
        return {"means": [I.mean_intensity(I.degrade(x, f, v, I.generator(1337, i, label))) for label, f, v in listed]}

    means = S.each(rows(spark, d), each_cell, "means array<double>")
    names = F.array(*[F.lit(label) for label, _, _ in listed])
    pairs = means.select("row_id", F.explode(F.arrays_zip(names.alias("label"), F.col("means").alias("intensity"))).alias("c"))
    return pairs.select("row_id", "c.label", F.round("c.intensity", 8).alias("intensity"))


@query()
def img_take_crop(spark, d):
    return S.each(rows(spark, d), lambda i, x: pixels(I.take_crop(x, 5, "random_crop", I.generator(1337, i, "crop"))), "pixels array<int>")


@query()
def img_multicrop(spark, d):
    return S.each(rows(spark, d), lambda i, x: {"crops": [[int(v) for v in c.reshape(-1)] for c in I.crops(x, 12, 3, I.generator(1337, i, "crops"))]}, "crops array<array<int>>")


def folder(spark, d) -> str:
    """All images as PNG files in the shared folder, one of each ten with an upper-case suffix, and as many texts beside them."""
    from sievelight.functions.headers import png
    from sievelight.sources import sinks

    root = f"{shared_dir(spark)}/sievelight/images-{uuid.uuid4().hex}"
    files = S.each(rows(spark, d), lambda i, x: {"content": png(x)}, "content binary")
    name = F.concat("row_id", F.when(F.col("row_id") % 10 == 0, F.lit(".PNG")).otherwise(F.lit(".png")))
    named = files.select(F.concat(F.lit("g"), F.col("row_id") % 3).alias("folder"), name.alias("name"), "content")
    texts = rows(spark, d).select(F.lit("texts").alias("folder"), F.concat("row_id", F.lit(".txt")).alias("name"), F.lit(b"no image").alias("content"))
    sinks.image_bytes(named.unionByName(texts), root)
    return root


FILE = "'g' || (vec_id % 3) || '/' || vec_id || CASE WHEN vec_id % 10 = 0 THEN '.PNG' ELSE '.png' END"


def tail() -> Column:
    return F.concat_ws("/", F.slice(F.split("path", "/"), -2, 2)).alias("file")


@query(f"SELECT {FILE} AS file FROM embeddings")
def src_image_dir(spark, d):
    """The image files below a folder, whatever the case of their suffix."""
    return readers.image_files(spark, folder(spark, d)).select(tail())


@query(f"SELECT {FILE} AS file, CAST(8 AS INT) AS width, CAST(8 AS INT) AS height FROM embeddings")
def src_image_size(spark, d):
    """Sizes from the files' headers."""
    return readers.image_sizes(spark, folder(spark, d)).select(tail(), "width", "height")


@query(f"{PIX} SELECT {FILE.replace('vec_id', 'row_id')} AS file, p AS pixels, CAST(NULL AS VARCHAR) AS error FROM x")
def src_image_decode(spark, d):
    """Pixels of all files, decoded."""
    found = readers.decoded_images(spark, folder(spark, d) + "/g*")
    level = F.transform(F.sequence(F.lit(1), F.length("pixels")), lambda i: F.conv(F.hex(F.substring("pixels", i, 1)), 16, 10).cast("int"))
    return found.select(tail(), level.alias("pixels"), "error")


@query("SELECT count(*) AS errors, true AS all_texts FROM embeddings")
def src_image_decode_safe(spark, d):
    """Files that are no images are rows with an error."""
    bad = readers.decoded_images(spark, folder(spark, d)).where("error IS NOT NULL AND pixels IS NULL")
    return bad.agg(F.count("*").alias("errors"), F.bool_and(F.col("path").endswith(".txt")).alias("all_texts"))


@query(f"SELECT {FILE} AS what, 'image' AS kind FROM embeddings WHERE vec_id % 3 = 0 UNION ALL SELECT * FROM (VALUES ('texts', 'no images'), ('nowhere', 'not found'), ('README.md', 'not found'))")
def src_paths_args(spark, d):
    """What a user names: a folder (twice), one without images, and names that aren't there."""
    root = folder(spark, d)
    paths, problems = readers.path_arguments(spark, [f"{root}/g0", f"{root}/texts", f"{root}/nowhere", f"{root}/g0", f"{root}/README.md"])
    found = spark.createDataFrame([(p, "image") for p in paths] or [("", "")], "path string, kind string").where("kind = 'image'").select(tail().alias("what"), "kind")
    return found.unionByName(spark.createDataFrame([(n.rsplit("/", 1)[1], why) for n, why in problems], "what string, kind string"))


@query("SELECT vec_id AS row_id, CAST(0.25 AS DOUBLE) AS score FROM embeddings")
def udf_scorer(spark, d):
    return S.score(rows(spark, d), "constant", value=0.25)


@query(f"""{PIX}, e AS (SELECT row_id, CAST(list_sum(p) AS DOUBLE) / 64 / 255 AS light FROM x), f AS (SELECT row_id, light, (3 * light + 0.25) / 4 AS s FROM e)
SELECT row_id, round(light, 8) AS light, CAST(0.25 AS DOUBLE) AS flat, round(1 / (1 + exp(-ln(s / (1 - s)) / 1.5)), 8) AS score FROM f""")
def udf_scorer_config(spark, d):
    """An ensemble of two registered scorers as configured: weights and a temperature."""
    config = {"experts": {"light": {"model": "mean_intensity"}, "flat": {"model": "constant", "value": 0.25}}, "fusion": {"mode": "weighted", "weights": {"light": 3.0}}, "calibration": {"temperature": 1.5}}
    out = S.ensemble(rows(spark, d), config)
    return out.select("row_id", F.round("light", 8).alias("light"), "flat", F.round("score", 8).alias("score"))


@query("SELECT unnest(['blur', 'crop', 'jitter', 'jpeg', 'noise', 'resize']) AS family")
def udf_family(spark, d):
    """The registered degradations; the cells of the grid name no other."""
    return spark.createDataFrame([(f,) for f in sorted(I.FAMILIES)], "family string")


@query()
def fn_layernorm_mlp(spark, d):
    return S.score(rows(spark, d), "mlp")


@query("SELECT unnest(['constant', 'mean_intensity', 'mlp', 'random']) AS scorer")
def udf_registry(spark, d):
    return spark.createDataFrame([(n,) for n in S.available()], "scorer string")
