"""Streams with state and timers: follow-ups as feedback, and polled metrics in a ring.

Both hold the rows of a key until the watermark has passed them, and then take them in the order of their times, so
that results do not depend on the order in which rows arrive. State is in RocksDB, keyed by session or container; a
timer wakes a key when it has something to do, and clears what a silent key leaves behind. A timer too many does no
harm, as all that the watermark allows is done at the first, so timers are set without a look at those that are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lorespark.functions.scoring import implied_feedback

# --- fixed values: seconds that a follow-up counts for, that metrics are kept for, and between polls
FOLLOW_UP_SECONDS, RING_SECONDS, POLL_SECONDS = 300, 24 * 3600, 300
# --- end of fixed values
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State of the session's later streams on disk rather than in the executors' heaps."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _FollowUps(StatefulProcessor):
    """Buffers a session's rows as (ms, id, query, response_ms) and hands out each with what followed within the limit, once nothing more can."""

    def __init__(self, seconds: int):
        self.ms = seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "ms long, id long, query string, response_ms double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [(r.ms, r.id, r.query, r.response_ms) for r in rows]
        self.held.appendList(new)
        self.handle.registerTimer(min(ms for ms, *_ in new) + self.ms)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        held = sorted(self.held.get(), key=lambda r: (r[0], r[1]))
        n = sum(ms + self.ms <= now for ms, *_ in held)
        for i, (ms, id_, _, response) in enumerate(held[:n]):
            after = held[i + 1] if i + 1 < len(held) and held[i + 1][0] - ms <= self.ms else None
            yield Row(session_id=key[0], id=id_, response_ms=response, follow_up=after and after[2], engaged_s=None if after is None else float(after[0] // 1000 - ms // 1000))
        if n == len(held):
            self.held.clear()
        else:
            if n:
                self.held.put(held[n:])
            self.handle.registerTimer(held[n][0] + self.ms)

    def close(self) -> None:
        pass


def follow_up_feedback(interactions: DataFrame, delay: str = "10 minutes", seconds: int = FOLLOW_UP_SECONDS) -> DataFrame:
    """(session_id, id, feedback_type, confidence) of a stream of interactions (session_id, id, ts, query, response_ms).

    What the next query of the session says about this one, if it comes within the limit; a session that stays silent
    for so long is content. A row comes out when the watermark, delay behind the latest time, has passed the limit;
    rows that come later than that are left out. Equal times are in the order of ids.
    """
    use_rocksdb(interactions.sparkSession)
    keyed = interactions.select("session_id", F.col("ts").cast("timestamp").alias("ts"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.col("id").cast("long").alias("id"), F.col("query").cast("string").alias("query"), F.col("response_ms").cast("double").alias("response_ms"))
    kind = dict(keyed.dtypes)["session_id"]
    out = keyed.withWatermark("ts", delay).groupBy("session_id").transformWithState(
        _FollowUps(seconds), f"session_id {kind}, id long, response_ms double, follow_up string, engaged_s double", "append", "eventTime"
    )
    return out.withColumn("f", implied_feedback(F.col("response_ms") / 1000, F.col("follow_up"), F.col("engaged_s"))).select("session_id", "id", "follow_up", "engaged_s", "f.feedback_type", "f.confidence")


#: Polls that wait are kept by the hour, in arrays of so many at most; null values are told by none.
_HOUR_MS, _CHUNK = 3600 * 1000, 1 << 15
_POLL = np.dtype([("ms", "<i8"), ("id", "<i8"), ("value", "<f8"), ("none", "?")])


class _Ring(StatefulProcessor):
    """The polls of a container that the watermark has not passed, by hours, and the ring of the last ones that it has.

    A task holds the polls of one hour at a time, however many wait.
    """

    def __init__(self, seconds: int, most: int):
        self.ms, self.most = seconds * 1000, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "hour long, chunk long", "polls binary")
        self.chunks = handle.getValueState("chunks", "n long")
        self.ring = handle.getListState("ring", "ms long, id long, value double")

    def _keep(self, polls: np.ndarray, n: int) -> int:
        """Add polls to their hours; n chunks were made before, and the number after this is returned."""
        hours = polls["ms"] // _HOUR_MS
        for hour in np.unique(hours):
            self.waiting.updateValue((int(hour), n), (polls[hours == hour].tobytes(),))
            n += 1
        return n

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        found = self.chunks.get()
        n, first, new = found[0] if found else 0, None, []
        for r in rows:
            new.append((r.ms, r.id, 0.0 if r.value is None else r.value, r.value is None))
            first = r.ms if first is None else min(first, r.ms)
            if len(new) == _CHUNK:
                n, new = self._keep(np.array(new, _POLL), n), []
        if new:
            n = self._keep(np.array(new, _POLL), n)
        self.chunks.update((n,))
        self.handle.registerTimer(first)
        yield from ()

    def _rings(self, container: str, polls: np.ndarray, old: int) -> Iterator[Row]:
        """The ring after each poll but the old ones, a block of polls at a time."""
        start = np.maximum(np.arange(len(polls)) - self.most + 1, np.searchsorted(polls["ms"], polls["ms"] - self.ms, "right"))
        back, step = np.arange(1 - self.most, 1), max(1, (1 << 20) // self.most)
        for i in range(old, len(polls), step):
            at = np.arange(i, min(i + step, len(polls)))
            place = at[:, None] + back
            inside = place >= start[at, None]
            place = np.maximum(place, 0)
            inside &= ~polls["none"][place]
            values, n = polls["value"][place], inside.sum(1)
            least, most = np.where(inside, values, np.inf).min(1), np.where(inside, values, -np.inf).max(1)
            total = np.where(inside, values, 0.0).sum(1)
            for id_, size, k, low, sum_, high in zip(polls["id"][at].tolist(), (at - start[at] + 1).tolist(), n.tolist(), least.tolist(), total.tolist(), most.tolist(), strict=True):
                yield Row(container=container, id=id_, polls=size, least=low if k else None, mean=sum_ / k if k else None, most=high if k else None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        hours: dict[int, list[int]] = {}
        for hour, chunk in self.waiting.keys():
            hours.setdefault(hour, []).append(chunk)
        ring = np.array([(ms, id_, value or 0.0, value is None) for ms, id_, value in self.ring.get()], _POLL)
        later = None
        for hour in sorted(hours):
            if hour * _HOUR_MS > now:
                later = min(np.frombuffer(self.waiting.getValue((hour, c))[0], _POLL)["ms"].min() for c in hours[hour])
                break
            polls = np.concatenate([np.frombuffer(self.waiting.getValue((hour, c))[0], _POLL) for c in hours[hour]])
            polls = polls[np.lexsort((polls["id"], polls["ms"]))]
            due = int(np.searchsorted(polls["ms"], now, "right"))
            yield from self._rings(key[0], np.concatenate([ring, polls[:due]]), len(ring))
            ring = np.concatenate([ring, polls[:due]])[-self.most :]
            if due:
                for c in hours[hour]:
                    self.waiting.removeKey((hour, c))
            if due < len(polls):
                if due:
                    self.waiting.updateValue((hour, hours[hour][0]), (polls[due:].tobytes(),))
                later = polls["ms"][due]
                break
        ring = [(ms, id_, None if none else value) for ms, id_, value, none in ring[ring["ms"] > now - self.ms].tolist()]
        self.ring.put(ring) if ring else self.ring.clear()
        if later is not None:
            self.handle.registerTimer(int(later))
        else:
            self.chunks.clear()
            if ring:  # a silent container is forgotten with its last poll
                self.handle.registerTimer(ring[-1][0] + self.ms)

    def close(self) -> None:
        pass


def polled_metrics(polls: DataFrame, delay: str = "10 minutes", seconds: int = RING_SECONDS, interval: int = POLL_SECONDS) -> DataFrame:
    """(container, id, polls, least, mean, most) for each poll of a stream (container, id, ts, value): the ring after it.

    The ring of a container holds its polls of the last day, and as many of them at most as fit at one each interval.
    Null values are polls that gave nothing. A poll comes out when the watermark has passed it.
    """
    use_rocksdb(polls.sparkSession)
    keyed = polls.select(F.col("container").cast("string").alias("container"), F.col("id").cast("long").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.col("value").cast("double").alias("value"))
    return keyed.withWatermark("ts", delay).groupBy("container").transformWithState(
        _Ring(seconds, max(1, seconds // interval)), "container string, id long, polls int, least double, mean double, most double", "append", "eventTime"
    )
