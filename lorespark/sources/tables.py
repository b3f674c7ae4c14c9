"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where that is unset and all runs in one process."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = tempfile.mkdtemp(prefix="lorespark-")
    return _own_folders[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet and read from there: it cuts the lineage and outlives executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int, *keys: str, each: int = 1 << 19) -> DataFrame:
    """df dealt by its keys to so many partitions that one holds some `each` of its rows, however many there are; at least the session's number."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // each)), *keys)


def fills(spark: SparkSession, rows: int, each: int = 1 << 19) -> bool:
    """Whether rows fill more partitions than the session's number."""
    return rows > each * int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, rows: int, *keys: str, each: int = 1 << 19) -> DataFrame:
    """df spread by its keys where its rows fill more partitions than the session's number; else as it is, left to the planner."""
    return spread(df, rows, *keys, each=each) if fills(df.sparkSession, rows, each) else df


def last_version(spark: SparkSession, folder: str) -> int:
    """The last of the tables 1, 2, … in a folder that has been written whole; 0 if there is none."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return 0
    done = (int(f.getPath().getName()) for f in fs.listStatus(path) if f.getPath().getName().isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS")))
    return max(done, default=0)
