"""Incremental indexes against full rebuilds, and streams with state fed in several batches against their batch queries."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lorespark.operators.memory import with_implied_feedback
from lorespark.operators.relink import LinkedIndex, resolved
from lorespark.sources.tables import new_path
from lorespark.streaming import stateful, sync

CHANGES, ENTITIES, REFERENCES = "change_type string, old_path string, path string", "path string, name string, entity_type string", "path string, source string, type string, target_name string"


def links_of(df):
    return sorted((r.path, r.target_name, r.target_path or "") for r in df.collect())


def full(files):
    """Links of {path: (names, uses)} by plain look-ups."""
    first = {}
    for p in sorted(files):
        for n in files[p][0]:
            first.setdefault(n, p)
    return sorted((p, u, p if u in names else first.get(u, "")) for p, (names, uses) in files.items() for u in uses)


def frames(spark, changes, files):
    written = [p for k, _, p in changes if k != "D"]
    return (
        spark.createDataFrame(changes, CHANGES),
        spark.createDataFrame([(p, n, "function") for p in written for n in files[p][0]], ENTITIES),
        spark.createDataFrame([(p, "s", "calls", u) for p in written for u in files[p][1]], REFERENCES),
    )


def test_every_commit_gives_what_a_full_rebuild_gives(spark):
    rng = random.Random(6)
    names = [f"n{i}" for i in range(9)]
    index, files, states = LinkedIndex(spark, new_path(spark, "index")), {}, []
    pick = lambda: (set(rng.sample(names, 2)), set(rng.sample(names, 3)))
    for step in range(4):
        changes = []
        for p in rng.sample([f"p{i}" for i in range(8)], 4):
            if p in files and rng.random() < 0.3:
                del files[p]
                changes.append(("D", None, p))
            else:
                changes.append(("M" if p in files else "A", None, p))
                files[p] = pick()
        if step == 2:
            old = next(p for p in files if all(p != c[2] for c in changes))
            files["moved"] = files.pop(old)
            changes.append(("R", old, "moved"))
        assert index.update(*frames(spark, changes, files)) == step + 1
        states.append(full(files))
    for version, want in enumerate(states, 1):
        assert links_of(index.links(version)) == want  # earlier versions can still be read
    assert sorted((r.path, r.name) for r in index.entities().collect()) == sorted((p, n) for p in files for n in files[p][0])


def test_only_what_a_change_touches_is_resolved_again(spark):
    files = {f"f{i:02d}": ({f"own{i}", "shared"}, {f"own{(i + 1) % 30}", "shared", "nowhere"}) for i in range(30)}
    index = LinkedIndex(spark, new_path(spark, "index"))
    index.update(*frames(spark, [("A", None, p) for p in files], files))
    files["f07"] = ({"renamed7"}, {"own8"})
    index.update(*frames(spark, [("M", None, "f07")], files))
    again = links_of(index.resolved_in(2))
    assert again == [("f06", "own7", ""), ("f07", "own8", "f08")] and links_of(index.links()) == full(files)
    # A writer that stops before its last table leaves no version behind, and its leftovers are written over.
    broken = LinkedIndex(spark, index.folder)
    spark.createDataFrame([("f01", "stray", "function", 3)], ENTITIES + ", version int").write.parquet(f"{index.folder}/entities/3")
    assert broken.last_version() == 2 and links_of(broken.links()) == full(files)
    del files["f00"]
    assert broken.update(*frames(spark, [("D", None, "f00")], files)) == 3 and links_of(broken.links()) == full(files)
    empty = spark.createDataFrame([], CHANGES)
    assert broken.update(empty, *frames(spark, [], files)[1:]) == 4 and links_of(broken.links()) == full(files)


def test_names_that_many_files_have_and_use(spark):
    n = 3000
    has = spark.range(n).select(F.format_string("f%05d", "id").alias("path"), F.lit("main").alias("name"))
    uses = spark.range(n).select(F.format_string("g%05d", "id").alias("path"), F.lit("s").alias("source"), F.lit("calls").alias("type"), F.lit("main").alias("target_name"))
    assert resolved(uses, has).filter("target_path = 'f00000'").count() == n


def batches(spark, rows, schema, size):
    """A stream of rows that come in several files, one file a batch."""
    path = new_path(spark, "stream")
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.fixture(scope="module")
def interactions():
    rng, start, rows = random.Random(8), datetime(2024, 1, 1), []
    for i in range(240):
        at = start + timedelta(seconds=i * 20 + rng.randrange(60), milliseconds=rng.randrange(1000))
        rows.append((rng.randrange(12), i, at, rng.choice(["ok", "a longer question", None]), float(rng.randrange(5000))))
    return rows  # out of order by up to a minute


def test_follow_ups_in_batches_equal_the_batch_query(spark, interactions):
    schema = "session_id long, id long, ts timestamp, query string, response_ms double"
    end = (0, 999, datetime(2024, 1, 3), "the end", 1.0)
    rows = [*interactions, end]
    got = sync.run_to_end(stateful.follow_up_feedback(batches(spark, rows, schema, 60), "5 minutes"), "follow-ups")
    want = with_implied_feedback(spark.createDataFrame(rows, schema), "query", 300).filter("id < 999")
    columns = ["session_id", "id", "follow_up", "engaged_s", "feedback_type", "confidence"]
    rounded = lambda df: sorted(((*r[:5], round(r[5], 6)) for r in df.select(*columns).collect()), key=str)
    assert rounded(got) == rounded(want) and any(r.follow_up for r in got.collect())


def test_rings_in_batches(spark, interactions):
    rows = [(f"c{s % 3}", i, at, None if i % 7 == 0 else v) for s, i, at, _, v in interactions] + [("c0", 999, datetime(2024, 1, 3), 5.0)]
    stream = batches(spark, rows, "container string, id long, ts timestamp, value double", 50)
    got = {r.id: r for r in sync.run_to_end(stateful.polled_metrics(stream, "5 minutes", seconds=600, interval=60), "polls").collect()}
    for c, i, at, _ in rows[:-1]:
        before = sorted((t, k, v) for d, k, t, v in rows if d == c and (t, k) <= (at, i))[-10:]
        ring = [v for t, _, v in before if t > at - timedelta(seconds=600)]
        seen = [v for v in ring if v is not None]
        r = got[i]
        assert (r.polls, r.least, r.most) == (len(ring), min(seen, default=None), max(seen, default=None))
        assert (r["mean"] is None) == (not seen) and (not seen or abs(r["mean"] - sum(seen) / len(seen)) < 1e-9)
    assert set(got) == {r[1] for r in rows[:-1]}


def test_a_sync_in_bounded_runs_equals_one_run(spark):
    rng = random.Random(2)
    rows = [(f"d{i:03d}", rng.choice([None, *range(40)]), "rdf_triple", f"http://x/{rng.randrange(30)}", "http://x/p", f'"{rng.randrange(5)}"') for i in range(150)]
    docs = spark.createDataFrame(rows, "id string, _ts long, type string, subject string, predicate string, object string").repartition(4)
    folder, one = new_path(spark, "bulk"), new_path(spark, "bulk")
    order = sorted(rows, key=lambda r: (r[1] or 0, r[0]))
    for k in range(3):
        got = sync.bulk_sync(docs, folder, 40)
        seen = {(r[3], r[5]) for r in order[: 40 * (k + 1)]}
        assert got["version"] == k + 1 and got["documents"] == 40 and sync.synced(spark, folder).count() == len(seen)
    # A run that stops before its bookmark leaves nothing that counts.
    sync.synced(spark, folder).limit(1).write.parquet(f"{folder}/triples/4")
    assert sync.synced(spark, folder).count() == len(seen)
    assert sync.bulk_sync(docs, folder)["documents"] == 30 and sync.bulk_sync(docs, folder) == {"version": 4, "documents": 0, "added": 0}
    assert sync.bulk_sync(docs, one)["documents"] == 150
    assert sorted(map(tuple, sync.synced(spark, folder).collect()), key=str) == sorted(map(tuple, sync.synced(spark, one).collect()), key=str)


def test_a_stream_stops_at_its_limits_and_goes_on(spark):
    schema = "type string, subject string, predicate string, object string"
    source, target, checkpoint = (new_path(spark, x) for x in ("source", "target", "checkpoint"))
    for i in range(4):
        spark.createDataFrame([("rdf_triple", f"http://x/{j % 30}", "http://x/p", f'"{i}"') for j in range(50)], schema).coalesce(1).write.mode("append").parquet(source)
    first = sync.sync_triples(spark, source, schema, target, checkpoint, bytes_per_batch=1, documents=50).count()
    assert 30 <= first <= 120 and first % 30 == 0
    with pytest.raises(sync.SyncStopped, match="state takes"):
        sync.sync_triples(spark, source, schema, new_path(spark, "target"), new_path(spark, "checkpoint"), files_per_batch=1, state_bytes=1)
    assert sync.sync_triples(spark, source, schema, target, checkpoint, bytes_per_batch=1).count() == 120


def test_a_ring_holds_the_waiting_polls_of_one_hour_at_a_time(spark, interactions, monkeypatch):
    class Map(dict):
        removeKey, getValue = dict.pop, dict.get
        updateValue = dict.__setitem__

    class One(list):
        def get(self):
            return self[0] if self and isinstance(self[0], int) is False and len(self) == 1 and len(self[0]) == 1 else iter(self)

        def update(self, v):
            self[:] = [v]

        put = lambda self, v: self.__setitem__(slice(None), v)

    class Handle:
        registerTimer = lambda self, at: None
        getMapState = lambda self, *a: Map()
        getValueState = getListState = lambda self, *a: One()

    ring = stateful._Ring(600, 10)
    ring.init(Handle())
    monkeypatch.setattr(stateful, "_CHUNK", 100)
    hour = 3600 * 1000
    rows = [Row(ms=(i % 20) * hour + i, id=i, value=None if i % 7 == 0 else float(i)) for i in range(2000)]
    ring.chunks.append((0,))
    assert not list(ring.handleInputRows(("c",), iter(rows), None))
    assert max(len(v[0]) for v in ring.waiting.values()) <= 100 * stateful._POLL.itemsize and len({k[0] for k in ring.waiting}) == 20
    now = type("T", (), {"getCurrentWatermarkInMs": lambda self: 7 * hour + 500})()
    first = list(ring.handleExpiredTimer(("c",), now, None))
    assert [r.id for r in first] == [r.id for r in sorted(rows, key=lambda r: r.ms) if r.ms <= 7 * hour + 500]
    assert sum(len(v[0]) for v in ring.waiting.values()) == (2000 - len(first)) * stateful._POLL.itemsize


def test_follow_ups_set_timers_without_listing_them(spark):
    class Handle:
        timers = []
        registerTimer = lambda self, at: self.timers.append(at)
        getListState = lambda self, *a: self
        appendList = lambda self, rows: setattr(self, "rows", rows)

    f, handle = stateful._FollowUps(300), Handle()
    f.init(handle)
    assert not list(f.handleInputRows((1,), iter([Row(ms=m, id=m, query="q", response_ms=1.0) for m in (5, 3)]), None))
    assert handle.timers == [300_003] and len(handle.rows) == 2
