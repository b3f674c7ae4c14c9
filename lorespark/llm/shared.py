"""Tables in the shared folder, and what several operators need."""

from __future__ import annotations

import re
import sys
import tempfile
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and TAB to CR. Python's bytes.split() splits at the same six bytes.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset and all runs in one process."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = tempfile.mkdtemp(prefix="llm-shared-")
    return _own_folders[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read from there: it cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a table of written() that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for top in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(top)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 1000, megabytes: int = 16) -> None:
    """Arrow batches of few rows and bytes, as one text may take megabytes. The setting holds for the session's later plans, which are run lazily."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))


def spare(frame: DataFrame, *names: str) -> list[str]:
    """For each name one that frame has no column of, in any case of letters."""
    taken, out = {c.lower() for c in frame.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def once_a_worker(key: tuple, make):
    """make(), computed once in each Python process: functions sent by value have no module to keep it in."""
    kept = vars(sys.modules.setdefault("_lorespark_kept", types.ModuleType("_lorespark_kept")))
    if str(key) not in kept:
        kept[str(key)] = make()
    return kept[str(key)]


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def let(value: Column, body) -> Column:
    """body(value), with value computed once inside a lambda."""
    return F.transform(F.array(value), body)[0]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b), a != b: one row (node, component) per node of an edge.

    component is the smallest node reachable. Each round hangs every node below its smallest neighbour, links its
    other neighbours to that one, and shortens the paths; the number of rounds grows with the logarithm of a
    component's diameter. All of it are joins and sums of written tables, so a hub's rows can be split.
    """
    e = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        p = written(e.groupBy("a").agg(F.min("b").alias("p")), "parents")
        if e.count() == p.count() and e.join(p.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            forget(e)
            roots = p.select(F.col("p").alias("node")).distinct().select("node", F.col("node").alias("component"))
            return p.select(F.col("a").alias("node"), F.col("p").alias("component")).unionByName(roots)
        hooks = e.join(p, "a").filter("b <> p").select(F.greatest("b", "p").alias("a"), F.least("b", "p").alias("b"))
        kept = p.select("a", F.col("p").alias("b")).unionByName(hooks).distinct()
        up = p.select(F.col("a").alias("b"), F.col("p").alias("q"))
        new = written(kept.join(up, "b", "left").select("a", F.coalesce("q", "b").alias("b")).distinct(), "edges")
        forget(e)
        forget(p)
        e = new
