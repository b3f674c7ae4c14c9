"""Exact deduplication by keyed streaming state.

The state (RocksDB, checkpointed in the shared folder, never expired) keeps for each digest of a normalised text the
identifier and the content locator of the row that stays, and the number of rows seen. Every call adds the keys of its
rows to the inbox that the state streams from, so a later call with the same state folder goes on where the last one
ended. Rows whose digest has been seen before are hits; their full bytes are compared, those of rows of earlier calls
being fetched through the locator. Texts that share a digest without being equal are told apart by the texts
themselves, which are kept beside the state from then on.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm.shared import SPACE, new_path, text_or_empty, written

#: Places over which the copies of a text are dealt while their bytes are compared.
PARTS = 32
_STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
}


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def sha256_of(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def normalised(name: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(name), SPACE, "")


def _there(spark: SparkSession, path: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def read_state(spark: SparkSession, folder: str) -> DataFrame:
    """(digest, best, copies) as the last call left them."""
    held = spark.read.format("statestore").load(folder)
    best, copies = (f.name for f in held.schema["value"].dataType.fields)
    return held.select("key.digest", F.col(f"value.{best}").alias("best"), F.col(f"value.{copies}").alias("copies"))


def update_state(spark: SparkSession, inbox: str, schema, folder: str) -> DataFrame:
    """Stream what is new in inbox (Parquet) into the state in folder; the state as (digest, best, copies)."""
    with _settings(spark, _STATE_CONF):
        stream = spark.readStream.schema(schema).parquet(inbox)
        state = stream.groupBy("digest").agg(F.max(F.struct("n", "inverse_id", "locator")).alias("best"), F.count(F.lit(1)).alias("copies"))
        run = state.writeStream.outputMode("update").format("noop").option("checkpointLocation", folder).trigger(availableNow=True).start()
        run.awaitTermination()
        return read_state(spark, folder)


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", locator: Column | None = None, digest=sha256_of, state_folder: str | None = None, fetch: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, digest, locator (of the row that stays).

    Texts are equal when they are the same after white space is deleted; null counts as empty, so empty, blank and
    null texts form one group. The row with the most code points, then the smallest id stays; a null id comes last.
    Rows that repeat an id with an equal text are counted in group_size and share one `kept`. No rows give no rows.
    Very long texts are hashed and compared whole. Other columns of docs are not read, whatever their names.

    With a state_folder the rows of earlier calls take part: keep_id may be one of theirs and group_size counts them.
    fetch turns a frame with a column locator, of such rows, into (locator, text). Without a locator of the caller's the
    normalised texts are kept in the state folder and fetched from there.
    """
    spark = docs.sparkSession
    folder = state_folder or new_path(spark, "exact-state")
    call = uuid.uuid4().hex
    own_store = locator is None and state_folder is not None
    where = F.concat_ws("/", F.lit(call), F.col(id_col).cast("string"), digest(normalised(text_col))) if own_store else F.col(id_col).cast("string") if locator is None else locator
    row = [F.col(id_col).alias("id"), digest(normalised(text_col)).alias("digest"), F.length(text_or_empty(text_col)).alias("n"), F.bitwise_not(F.col(id_col)).alias("inverse_id"), where.alias("locator")]
    inbox, state_path, store, clashes = (f"{folder}/{x}" for x in ("inbox", "state", "texts", "clashes"))
    earlier = _there(spark, state_path)
    docs.select(*row).write.parquet(f"{inbox}/call={call}")
    schema = docs.select(*row).schema
    keys = spark.read.schema(schema).parquet(f"{inbox}/call={call}")
    if own_store:
        docs.select(where.alias("locator"), normalised(text_col).alias("text")).write.parquet(f"{store}/call={call}")
    texts = docs.select(*row, normalised(text_col).alias("norm"))
    # Every digest is dealt to PARTS places by a hash of the id, so that many copies of one text do not meet in one task.
    part = F.pmod(F.xxhash64("id"), F.lit(PARTS)).alias("part")
    old, told_before = None, None
    if earlier:
        mine = keys.select("digest").distinct()
        with _settings(spark, _STATE_CONF):
            old = written(read_state(spark, state_path).join(mine, "digest", "left_semi"), "exact-before")
        if _there(spark, clashes):
            told_before = written(spark.read.parquet(clashes).join(mine, "digest", "left_semi").groupBy("digest", "norm").agg(F.max("best").alias("best"), F.max("copies").alias("copies")), "exact-told")
            old = old.join(told_before.select("digest").distinct(), "digest", "left_anti")
        asked = old.select(F.col("best.locator").alias("locator"))
        if fetch is None:
            if not _there(spark, store):
                raise ValueError("rows of earlier calls have locators of the caller's: fetch must say how to read them")
            of_call = F.element_at(F.split("locator", "/"), 1)
            fetch = lambda wanted: spark.read.parquet(store).join(wanted.withColumn("call", of_call), ["locator", "call"], "left_semi").select("locator", "text")
        read = fetch(asked).select("locator", normalised().alias("norm")).dropDuplicates(["locator"])
        old = written(old.withColumn("locator", F.col("best.locator")).join(read, "locator", "left").select("digest", "best", "copies", "norm"), "exact-fetched")
        lost = old.filter("norm is null").select("best.locator").first()
        if lost is not None:
            raise ValueError(f"nothing was fetched for the locator {lost[0]}")
    state = update_state(spark, inbox, schema, state_path)
    with _settings(spark, _STATE_CONF):  # readers open the state with these settings too
        state = written(state.join(keys.select("digest").distinct(), "digest", "left_semi") if earlier else state, "exact-groups")
    several = state.filter("copies > 1").select("digest", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))).alias("part"))
    hits = texts.select("digest", part, "norm").join(several, ["digest", "part"], "left_semi")
    if old is not None:
        hits = hits.unionByName(old.select("digest", F.lit(0).cast("long").alias("part"), "norm"))
    # Of each digest the least and greatest text: when these two are equal, all are.
    ends = hits.groupBy("digest", "part").agg(F.min("norm").alias("least"), F.max("norm").alias("most")).groupBy("digest").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    clash = ends.filter("least <> most").select("digest")
    if told_before is not None:
        clash = clash.unionByName(told_before.select("digest")).distinct()
    clash = written(clash, "exact-clashes")
    same = keys.select("id", "digest").join(state, "digest")
    if not clash.isEmpty():
        same = same.join(clash, "digest", "left_anti")
        odd = texts.join(clash, "digest", "left_semi")
        groups = odd.groupBy("digest", "norm").agg(F.max(F.struct("n", "inverse_id", "locator")).alias("best"), F.count(F.lit(1)).alias("copies"))
        for before in (old, told_before):
            if before is not None:
                groups = groups.unionByName(before.join(clash, "digest", "left_semi").select("digest", "norm", "best", "copies"))
        groups = written(groups.groupBy("digest", "norm").agg(F.max("best").alias("best"), F.sum("copies").alias("copies")), "exact-odd")
        if state_folder is not None:
            groups.write.mode("append").parquet(clashes)
        same = same.unionByName(odd.select("id", "digest", "norm").join(groups, ["digest", "norm"]).select("id", "digest", "best", "copies"))
    keep = F.bitwise_not(F.col("best.inverse_id"))
    return same.select(F.col("id").alias(id_col), keep.alias("keep_id"), F.col("copies").alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), "digest", F.col("best.locator").alias("locator"))
