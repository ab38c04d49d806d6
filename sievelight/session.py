"""Session settings and the shared folder in which lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sievelight")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SIEVELIGHT_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where neither that setting nor a
    checkpoint folder exists is a folder of our own made and set, and only under a local master.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if named:
        if not current:
            context.setCheckpointDir(named)
        return named.rstrip("/")
    if not current:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sievelight-"))
        current = context.getCheckpointDir()
    return current.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage like ``checkpoint()``, but columnar and compressed; losing an executor
    loses nothing of it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sievelight/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables written into the shared folder that are dropped together, once what was made of them is written."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.path = f"{shared_dir(spark)}/sievelight/{uuid.uuid4().hex}"
        self.written = 0
        self.named: list[str] = []

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """As ``materialise``."""
        self.written += 1
        path = f"{self.path}/{self.written}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def put_bucketed(self, df: DataFrame, name: str, by: str, buckets: int) -> DataFrame:
        """As ``put``, bucketed, so that a join with a table of as many buckets shuffles neither."""
        self.written += 1
        self.named.append(f"scratch_{uuid.uuid4().hex}")
        df.write.format("parquet").bucketBy(buckets, by).option("path", f"{self.path}/{self.written}-{name}").saveAsTable(self.named[-1])
        return self.spark.table(self.named[-1])

    def drop(self) -> None:
        for name in self.named:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(self.spark, self.path)


def release(spark: SparkSession) -> None:
    """Have the driver forget finished queries, whose shuffle files Spark then deletes; else they stay until memory runs short."""
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, whichever that is."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
