"""Lifecycles of branches and sessions, folded from their ordered events."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.operators.memory import SESSION_SECONDS

_HISTORY = "repository_url string, id long, accepted boolean, error string, active_branch string, live int, archived int"


def branch_history(events: DataFrame, first: str = "main") -> DataFrame:
    """What each event (repository_url, id, at, operation, branch_name) did, and the repository after it.

    Operations: create, create_and_switch, switch, switch_or_create, archive and delete; the last two remove a branch,
    and archive keeps a record of it. A repository begins with the branch `first`, which is active. A branch can't be
    created twice, nor switched to or removed unless it is there, nor removed while it is active; what is not accepted
    changes nothing and has an error. Events are in the order of at and id, null first; other operations are errors.

    Each event depends on all before it, so one task goes through a repository's events; it holds the names of its
    branches only, and rows stream through it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repository, live, gone, active, begun = None, set(), set(), first, False
        names = [c.split()[0] for c in _HISTORY.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.int32(), pa.int32()]
        for b in batches:
            rows = []
            for repo, id_, operation, branch in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not begun or repo != repository:
                    repository, live, gone, active, begun = repo, {first}, set(), first, True
                error = None
                missing = operation == "switch_or_create" and branch not in live
                if branch is None or operation not in ("create", "create_and_switch", "switch", "switch_or_create", "archive", "delete"):
                    error = "unknown operation" if branch is not None else "no branch is named"
                elif operation.startswith("create") or missing:
                    error = "it already exists" if branch in live else None
                elif branch not in live:
                    error = "it does not exist"
                elif operation in ("archive", "delete") and branch == active:
                    error = "it is active"
                if error is None:
                    if operation in ("archive", "delete"):
                        live.discard(branch)
                        gone.discard(branch)
                        if operation == "archive":
                            gone.add(branch)
                    else:
                        live.add(branch)
                        gone.discard(branch)
                        if operation != "create":
                            active = branch
                rows.append((repo, id_, error is None, error, active, len(live), len(gone)))
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    ordered = events.select(F.col("repository_url").cast("string").alias("repository_url"), F.col("id").cast("long").alias("id"), "at", "operation", "branch_name")
    ordered = ordered.repartition("repository_url").sortWithinPartitions("repository_url", "at", "id")
    return ordered.select("repository_url", "id", "operation", "branch_name").mapInArrow(run, _HISTORY)


def session_generations(touches: DataFrame, now: Column, seconds: int = SESSION_SECONDS, least_seconds: int = 60) -> DataFrame:
    """(session_id, generation, started_at, last_seen, touches, expires_at, live) of touches (session_id, ts).

    A session expires seconds after its last touch; a later touch begins the next generation. It counts as live where a
    minute or more is left to it.
    """
    before = F.lag("ts").over(Window.partitionBy("session_id").orderBy("ts"))
    begins = F.when(before.isNull() | (F.unix_millis("ts") - F.unix_millis(before) >= seconds * 1000), 1).otherwise(0)
    so_far = Window.partitionBy("session_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = touches.select("session_id", "ts", begins.alias("begins")).withColumn("generation", F.sum("begins").over(so_far))
    out = marked.groupBy("session_id", "generation").agg(F.min("ts").alias("started_at"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("touches"))
    end = F.col("last_seen") + F.make_dt_interval(secs=F.lit(seconds))
    return out.withColumn("expires_at", end).withColumn("live", F.unix_millis("expires_at") - F.unix_millis(now) >= least_seconds * 1000)
