"""Tables that cut lineage, in the folder all executors share.

The folder is the cluster's `spark.checkpoint.dir`. Only a local session (tests, one machine) may go without
it; then a temporary folder of this process is used and removed at exit.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_local: dict[str, str] = {}
_made: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="evalspark-")
        atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
    return f"file://{_local[app]}"


def _files(spark: SparkSession, path: str):
    """Hadoop's file system and path of a URI."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, never reused, so a lost or repeated run can't mix its rows with another's.

    The application's folder is removed when its driver ends.
    """
    app = f"{shared_dir(spark)}/evalspark/{spark.sparkContext.applicationId}"
    if app not in _made:
        files, target = _files(spark, app)
        files.mkdirs(target)
        files.deleteOnExit(target)
        _made.add(app)
    return f"{app}/{name}-{uuid.uuid4().hex[:12]}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a table that nothing reads any more."""
    files, target = _files(spark, path)
    files.delete(target, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file, null if there is none."""
    files, target = _files(spark, path)
    if not files.exists(target):
        return None
    stream = files.open(target)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file, written beside its place and renamed, so that a reader never meets half of it."""
    files, target = _files(spark, path)
    new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target.getParent().toString()}/.{uuid.uuid4().hex[:12]}")
    stream = files.create(new, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if files.exists(target):
        files.delete(target, False)
    files.rename(new, target)


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """`df` written once as a Parquet table in the shared folder and read back: the plan starts anew, columns prune.

    With `by` the rows of each value of that column lie in files of their own, so a filter on it reads no others.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str, condition: Column) -> tuple[DataFrame, int]:
    """`df` written like `written`, and how many of its rows meet a condition, counted while they are written."""
    seen = Observation()
    table = written(df.observe(seen, F.count_if(condition).alias("n")), name)
    return table, seen.get["n"]


def spread(df: DataFrame) -> DataFrame:
    """`df` over at least as many tasks as there are cores, for stages that are heavy in Python.

    Tables of a few large row groups would keep most cores idle; a table with more splits than cores, as any
    large one has, is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
