"""Readers: manifests, hash lists, image folders, shards, configuration."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.functions.headers import HEAD, shown_size, size_of, upright
from sievelight.functions.images import scaled, to_uint8
from sievelight.functions.paths import IMAGE_SUFFIXES
from sievelight.sources.files import opened

try:
    import yaml
except ImportError:  # JSON is read without it
    yaml = None

#: The columns of a manifest file, in order.
MANIFEST_COLUMNS = ("path", "label", "source", "generator", "split", "sha256", "width", "height", "phash")
MANIFEST_SCHEMA = "path string, label int, source string, generator string, split string, sha256 string, width int, height int, phash string"


def manifest_csv(spark: SparkSession, path: str) -> DataFrame:
    """A manifest file; a malformed row is an error, an empty hash is empty, not null."""
    read = spark.read.schema(MANIFEST_SCHEMA).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)
    return read.fillna("", subset=["sha256", "phash"])


def inferred_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def hash_list(spark: SparkSession, path: str) -> DataFrame:
    """(hash): the first word of each line, in lower case, without what follows '#'. No file gives no hash."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "hash string")
    text = F.trim(F.element_at(F.split("value", "#"), 1))
    return spark.read.text(path).select(text.alias("t")).where("t <> ''").select(F.lower(F.element_at(F.split("t", r"\s+"), 1)).alias("hash")).distinct()


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def feature_cache(spark: SparkSession, path: str, manifest: str, model: str, variants: list[str]) -> DataFrame:
    """(variant, row_id, vector) of the cached vectors of some variants; a variant that isn't cached is an error that names it. Only their folders are read."""
    folder = lambda v: f"{path}/manifest={manifest}/model={model}/variant={v}"
    absent = [v for v in variants if not _exists(spark, folder(v))]
    if absent:
        raise FileNotFoundError(f"no cached features of {model} on {manifest} for {absent}")
    schema = "row_id bigint, vector array<float>, manifest string, model string, variant string"
    read = spark.read.schema(schema).option("basePath", path).parquet(*[folder(v) for v in variants])
    return read.select("variant", "row_id", "vector")


def image_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modificationTime, content) of all image files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*IMAGE_SUFFIXES))


def image_sizes(spark: SparkSession, root: str) -> DataFrame:
    """(path, width, height) of all image files below a folder, as shown; only headers are read. What is no image has no size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column(0).to_pylist():
                with opened(unquote(path)) as f:
                    found.append(shown_size(f.read(HEAD)) or (None, None))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([w for w, _ in found], pa.int32()), pa.array([h for _, h in found], pa.int32())], names=["path", "width", "height"])

    return image_files(spark, root).select("path").mapInArrow(run, "path string, width int, height int")


DECODED = "path string, width int, height int, channels int, pixels binary, error string"


def decoded_images(spark: SparkSession, root: str, most: int | None = None) -> DataFrame:
    """(path, width, height, channels, pixels, error): what can't be decoded is a row with an error, not a failure.

    Pixels are in rows, red first; transparency lies on white; images are turned as their EXIF says; ``most`` bounds the longer
    side. A file that is no image of its kind, or is cut off, is an error.
    """
    images = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", False).load(root)
    turned = image_files(spark, root).where(F.lower("path").rlike(r"\.jpe?g$")).select("path").mapInArrow(_turned, "path string, turned int")
    raw = images.select(F.col("image.origin").alias("path"), F.col("image.width").alias("w"), F.col("image.height").alias("h"), F.col("image.nChannels").alias("c"), F.col("image.data").alias("data"))
    joined = raw.join(turned.where("turned > 1"), "path", "left").select("path", "w", "h", "c", "data", "turned")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, w, h, c, data, turn in zip(*(batch.column(i).to_pylist() for i in range(6))):
                row = {"path": path, "width": None, "height": None, "channels": None, "pixels": None, "error": "not an image that can be decoded"}
                if w and w > 0:
                    img = _plain(np.frombuffer(data, dtype=np.uint8).reshape(h, w, c))
                    img = upright(img, turn or 1)
                    longer = max(img.shape[:2])
                    if most and longer > most:
                        img = scaled(img, max(1, round(img.shape[0] * most / longer)), max(1, round(img.shape[1] * most / longer)))
                    row |= {"width": img.shape[1], "height": img.shape[0], "channels": img.shape[2], "pixels": img.tobytes(), "error": None}
                yield pa.RecordBatch.from_pylist([row], schema=_DECODED)

    return joined.mapInArrow(run, DECODED)


_DECODED = pa.schema([("path", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("channels", pa.int32()), ("pixels", pa.binary()), ("error", pa.string())])


def _turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for path in batch.column(0).to_pylist():
            with opened(unquote(path)) as f:
                size = size_of(f.read(HEAD))
            found.append(size[2] if size else 1)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int32())], names=["path", "turned"])


def _plain(img: np.ndarray) -> np.ndarray:
    """Blue-first pixels of any number of channels as grey or red-first; transparent ones show white."""
    if img.shape[2] == 4:
        alpha = img[:, :, 3:].astype(np.float64) / 255
        img = to_uint8(img[:, :, :3] * alpha + 255 * (1 - alpha))
    return img[:, :, ::-1] if img.shape[2] == 3 else img


def path_arguments(spark: SparkSession, arguments: list[str]) -> tuple[list[str], list[tuple[str, str]]]:
    """(paths, problems) of what a user names: files, and the image files below folders, in order and each once.

    A name that is not there, a file that is no image by its suffix and a folder without images are problems, with the reason.
    The list is what a user types, so it is handled here; folders are listed by Spark.
    """
    jvm = spark.sparkContext._jvm
    paths: dict[str, None] = {}
    problems: list[tuple[str, str]] = []
    for name in arguments:
        where = jvm.org.apache.hadoop.fs.Path(name)
        files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(where):
            problems.append((name, "not found"))
        elif files.getFileStatus(where).isDirectory():
            found = [r["path"] for r in image_files(spark, name).select("path").orderBy("path").toLocalIterator()]
            if not found:
                problems.append((name, "no images"))
            paths |= dict.fromkeys(found)
        elif name.rsplit(".", 1)[-1].lower() not in IMAGE_SUFFIXES:
            problems.append((name, "not an image"))
        else:
            paths[files.makeQualified(where).toString()] = None
    return list(paths), problems


def shards(spark: SparkSession, pattern: str, columns: list[str]) -> DataFrame:
    """Columns of all Parquet shards that match; only those columns are read."""
    return spark.read.parquet(pattern).select(*columns)


def repository_files(listing: list[dict]) -> list[tuple[str, int]]:
    """(path, bytes) of the files in a repository's listing; folders are left out."""
    return [(e["Path"], int(e.get("Size") or 0)) for e in listing if e.get("Type") != "tree"]


def repository_listing(spark: SparkSession, page: Callable[[int], list[dict]], kept: str) -> DataFrame:
    """(path, bytes) of a repository's files. ``page`` gives the entries of page 1, 2, ... until one is empty; what was read is kept as a table, which later calls read instead."""
    schema = "path string, bytes bigint"
    if not _exists(spark, f"{kept}/_SUCCESS"):  # which is written last
        found, number = [], 1
        while entries := page(number):
            found += repository_files(entries)
            number += 1
        spark.createDataFrame(found, schema).write.mode("overwrite").parquet(kept)
    return spark.read.schema(schema).parquet(kept)


def config(text_or_path: str, overrides: list[str] = ()) -> dict:
    """A JSON configuration (or YAML, where its library is there) with dotted overrides such as 'a.b=3'; values are read as int, float, bool, null or text."""
    text = open(text_or_path).read() if os.path.exists(text_or_path) else text_or_path
    try:
        out = json.loads(text)
    except json.JSONDecodeError:
        if yaml is None:
            raise
        out = yaml.safe_load(text)
    for item in overrides:
        key, _, value = item.partition("=")
        at = out
        *above, last = key.split(".")
        for k in above:
            at = at.setdefault(k, {})
        at[last] = _typed(value)
    return out


def _typed(value: str):
    for kind in (int, float):
        try:
            return kind(value)
        except ValueError:
            pass
    return {"true": True, "false": False, "null": None, "none": None}.get(value.lower(), value)
