"""Sessions and the shared folder for tables that cut lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def build_session(name: str = "loomspark", **conf) -> SparkSession:
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        "spark.ui.showConsoleProgress": "false",
    }
    builder = SparkSession.builder.appName(name)
    for k, v in {**base, **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where none is named and the master is local, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='loomspark-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
        atexit.register(shutil.rmtree, folder[7:], True)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Writes df once to the shared folder and returns what was written, without df's lineage."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def new_path(spark: SparkSession, name: str = "loomspark") -> str:
    """A path in the shared folder that goes when the driver ends, on whatever file system."""
    path = os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")
    if path.startswith("file:") or "://" not in path:
        _made.append(path)
    else:
        file_system(spark, path)[0].deleteOnExit(file_system(spark, path)[1])
    return path


def file_system(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def cut_bucketed(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """Like `cut`, written in buckets of a column, so that joins and aggregations by it need no shuffle."""
    spark, name = df.sparkSession, f"loomspark_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, column).sortBy(column).option("path", new_path(spark)).format("parquet").saveAsTable(name)
    return spark.table(name)


@atexit.register
def _clean() -> None:
    for path in _made:
        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_loomspark_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="loomspark-code-")
    atexit.register(shutil.rmtree, folder, True)
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "loomspark_code"), "zip", os.path.dirname(home), os.path.basename(home)))
    sc._loomspark_shipped = True


def hash_sample(df: DataFrame, key: str, limit: int) -> list:
    """About `limit` rows, never more, with hashes of the key in one range: the same rows each time, and no more of them move when the table is larger."""
    from pyspark.sql import functions as F

    n = df.count()
    if n > limit:
        df = df.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < F.lit(int((1 << 30) * limit * 0.9 / n)))
    return df.limit(limit).collect()
