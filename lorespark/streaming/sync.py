"""Incremental synchronisation of triples, expiring state, and event-time windows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from lorespark.sources.formats import from_documents
from lorespark.sources.tables import last_version, new_path, written
from lorespark.streaming.stateful import use_rocksdb

_KEY = ["s", "p", "o", "o_kind", "o_type", "o_lang"]


class SyncStopped(RuntimeError):
    """A sync that reached a limit; what it had committed stays, and the next call goes on from there."""


class _Guard(StreamingQueryListener):
    """Stops one query once its state takes more than so many bytes, or it has read so many rows."""

    def __init__(self, name: str, state_bytes: int | None, documents: int | None):
        self.name, self.state_bytes, self.documents, self.read, self.reason, self.query = name, state_bytes, documents, 0, None, None

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name != self.name:
            return
        self.read += p.numInputRows
        held = sum(o.memoryUsedBytes for o in p.stateOperators)
        if self.state_bytes is not None and held > self.state_bytes:
            self.reason = f"its state takes {held} bytes of at most {self.state_bytes}"
        elif self.documents is not None and self.read >= self.documents:
            self.reason = ""
        if self.reason is not None and self.query is not None:
            self.query.stop()


def sync_triples(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, files_per_batch: int = 100, bytes_per_batch: int | None = None, state_bytes: int | None = None, documents: int | None = None) -> DataFrame:
    """Read the documents that have come to source since the last call, and append new triples to target.

    The checkpoint holds how far reading has come, and the set of triples seen, which is kept on disk. The files of a
    batch are bounded by number or by bytes (one file at least). The call ends early, after a whole batch, once it has
    read so many documents; if the state outgrows its limit, SyncStopped is raised. Either way the next call goes on
    where this one ended. Returns the whole target table.
    """
    use_rocksdb(spark)
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files_per_batch) if bytes_per_batch is None else reader.option("maxBytesPerTrigger", bytes_per_batch)
    fresh = from_documents(reader.parquet(source)).dropDuplicates(_KEY)
    guard = _Guard(f"sync-{uuid.uuid4().hex}", state_bytes, documents)
    spark.streams.addListener(guard)
    try:
        run = fresh.writeStream.queryName(guard.name).format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        guard.query = run
        run.awaitTermination()
    finally:
        spark.streams.removeListener(guard)
    if guard.reason:
        raise SyncStopped(guard.reason)
    return spark.read.parquet(target)


_BOOKMARK = "ts long, id string, documents long, added long"


def bulk_sync(documents: DataFrame, folder: str, most: int | None = None) -> dict[str, int]:
    """One run over documents (id, _ts, type, subject, predicate, object) in the order of _ts and id, from where the last one ended.

    At most `most` documents are taken. New triples are written as a version of their own, then a bookmark; a run that
    is stopped before that leaves no trace. Rows without _ts come first, as time 0. Returns version, documents, added.
    """
    spark = documents.sparkSession
    done = last_version(spark, f"{folder}/bookmark")
    place = F.struct(F.coalesce(F.col("_ts").cast("long"), F.lit(0)).alias("ts"), F.col("id").cast("string").alias("id"))
    rest = documents.withColumn("__at", place)
    if done:
        last = spark.read.schema(_BOOKMARK).parquet(f"{folder}/bookmark/{done}").first()
        rest = rest.filter(F.col("__at") > F.struct(F.lit(last.ts).alias("ts"), F.lit(last.id).alias("id")))
    part = rest if most is None else rest.orderBy("__at").limit(most)
    part = written(part, "sync-part")
    end = part.agg(F.max("__at").alias("at"), F.count(F.lit(1)).alias("n")).first()
    if not end["n"]:
        return {"version": done, "documents": 0, "added": 0}
    known = synced(spark, folder, done)
    same = [F.col(f"n.{k}").eqNullSafe(F.col(f"k.{k}")) for k in _KEY]
    new = from_documents(part).dropDuplicates(_KEY).alias("n").join(known.alias("k"), same, "left_anti")
    path = f"{folder}/triples/{done + 1}"
    new.write.mode("overwrite").parquet(path)
    added = spark.read.parquet(path).count()
    spark.createDataFrame([(end["at"]["ts"], end["at"]["id"], end["n"], added)], _BOOKMARK).coalesce(1).write.mode("overwrite").parquet(f"{folder}/bookmark/{done + 1}")
    return {"version": done + 1, "documents": end["n"], "added": added}


def synced(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The triples of all whole versions of bulk_sync(), up to one."""
    last = last_version(spark, f"{folder}/bookmark") if version is None else version
    schema = ", ".join(f"{k} string" for k in _KEY)
    return spark.read.schema(schema).parquet(*(f"{folder}/triples/{v}" for v in range(1, last + 1))) if last else spark.createDataFrame([], schema)


def run_to_end(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All results of a streaming query over what its source holds now, as a table in the shared folder."""
    spark = stream.sparkSession
    out, checkpoint = new_path(spark, name), new_path(spark, f"{name}-checkpoint")
    if mode == "append":
        run = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)
    kept: list[DataFrame] = []

    def keep(batch: DataFrame, _: int) -> None:
        kept[:] = [written(batch, name)]

    run = stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    run.awaitTermination()
    return kept[0] if kept else spark.createDataFrame([], stream.schema)


def event_stream(events: DataFrame) -> DataFrame:
    """A stream of the rows of events: they are written to the shared folder and read from there."""
    spark = events.sparkSession
    path = new_path(spark, "events")
    events.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def tumbling(stream: DataFrame, width: str = "1 day") -> DataFrame:
    w = F.window("ts", width)
    return stream.withWatermark("ts", "1 hour").groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(stream: DataFrame, gap: str = "5 minutes", key: str = "user_id") -> DataFrame:
    w = F.session_window("ts", gap)
    return stream.withWatermark("ts", "1 hour").groupBy(w, key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def deduplicated(stream: DataFrame, keys: list[str], within: str | None = None) -> DataFrame:
    """The first row of each key, for ever or within the watermark."""
    if within is None:
        return stream.dropDuplicates(keys)
    return stream.withWatermark("ts", within).dropDuplicatesWithinWatermark(keys)


def unexpired(stream: DataFrame, seconds: int, now) -> DataFrame:
    return stream.filter(F.unix_seconds("ts") + seconds > F.unix_seconds(now))


def learn_online(stream: DataFrame, checkpoint: str, update: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hand every batch of interactions to update(batch, id)."""
    return stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
