"""Lifecycles against a plain replay, layers of memory, cross-validation, and online models."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lorespark.operators.lifecycle import branch_history, session_generations
from lorespark.operators.memory import recalled, short_term
from lorespark.operators.online import OnlineModel, OnlineRegressor, hashed_words
from lorespark.operators.records import cross_validated, fold_of
from lorespark.sources.tables import last_version, new_path
from lorespark.streaming import sync

START = datetime(2024, 1, 1)


def test_branches_step_by_step(spark):
    steps = [
        ("create", "dev", None, "main", 2, 0), ("create", "dev", "it already exists", "main", 2, 0), ("switch", "dev", None, "dev", 2, 0), ("delete", "dev", "it is active", "dev", 2, 0), ("switch", "nowhere", "it does not exist", "dev", 2, 0),
        ("switch_or_create", "fix", None, "fix", 3, 0), ("archive", "dev", None, "fix", 2, 1), ("delete", "dev", "it does not exist", "fix", 2, 1), ("create_and_switch", "dev", None, "dev", 3, 0), ("delete", "main", None, "dev", 2, 0),
        ("paint", "dev", "unknown operation", "dev", 2, 0), ("create", None, "no branch is named", "dev", 2, 0),
    ]
    rows = [("a", i, START + timedelta(seconds=i), op, b) for i, (op, b, *_) in enumerate(steps)] + [("b", 99, None, "delete", "dev"), (None, 98, START, "create", "x")]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "repository_url string, id long, at timestamp, operation string, branch_name string")
    got = {r.id: (r.error, r.active_branch, r.live, r.archived) for r in branch_history(df).collect()}
    assert [got[i] for i in range(len(steps))] == [tuple(s[2:]) for s in steps]
    assert got[99] == ("it does not exist", "main", 1, 0) and got[98] == (None, "main", 2, 0)
    assert branch_history(df.limit(0)).count() == 0


def test_sessions_expire_and_begin_again(spark):
    day = timedelta(days=1)
    rows = [(1, START), (1, START + day - timedelta(milliseconds=1)), (1, START + 2 * day - timedelta(milliseconds=1)), (2, START)]
    df = spark.createDataFrame(rows, "session_id int, ts timestamp")
    at = lambda t: sorted((r.session_id, r.generation, r.touches, r.live) for r in session_generations(df, F.to_timestamp(F.lit(t))).collect())
    assert at("2024-01-03 23:58:59.999") == [(1, 1, 2, False), (1, 2, 1, True), (2, 1, 1, False)]  # a minute is left
    assert at("2024-01-03 23:59:00") == [(1, 1, 2, False), (1, 2, 1, False), (2, 1, 1, False)]


def test_layers_of_memory(spark):
    rows = [(1, f"m{i}", f"word{i} the cat", 0.1 * i, START + timedelta(minutes=i)) for i in range(10)] + [(1, "old", "the cat sat", 0.95, START - timedelta(hours=3)), (2, "other", "the cat", 0.9, START)]
    df = spark.createDataFrame(rows, "session_id int, id string, content string, importance double, stored_at timestamp")
    now = F.to_timestamp(F.lit("2024-01-01 00:30:00"))
    assert sorted(r.id for r in short_term(df.filter("session_id = 1"), now, most=4).collect()) == ["m6", "m7", "m8", "m9"]
    asked = spark.createDataFrame([(1, "CAT word7"), (3, "cat")], "session_id int, query string")
    got = [(r.id, r.layer) for r in recalled(df, asked, now, limit=6, most=4).orderBy("rank").collect()]
    # Short-term: m7 has both words, then m6 and m8 by id; long-term: old, m9 and m8, which the other layer has already.
    assert got == [("old", "long"), ("m9", "long"), ("m8", "short"), ("m7", "short"), ("m6", "short")]


def test_cross_validation_equals_a_loop(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("abc"), rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(150)] + [(500, "z", 9.0, 9.0), (501, None, 1.0, 1.0), (502, "a", None, 1.0)]
    df = spark.createDataFrame(rows, "id int, label string, x double, y double")
    fold = {r.id: r.f for r in df.select("id", fold_of(F.col("id")).alias("f")).collect()}
    known = [r for r in rows if None not in r]
    for r in cross_validated(df, "id", "label", ["x", "y"]).collect():
        others = [o for o in known if fold[o[0]] != r.fold]
        means = {c: [sum(o[k] for o in others if o[1] == c) / sum(o[1] == c for o in others) for k in (2, 3)] for c in {o[1] for o in others}}
        far = {c: (r.x - m[0]) ** 2 + (r.y - m[1]) ** 2 for c, m in means.items()}
        best = min(far.values())
        assert r.fold == fold[r.id] and abs(far[r.guess] - best) < 1e-9
    assert cross_validated(df, "id", "label", ["x", "y"]).count() == len(known)


def test_hashed_words_are_those_of_a_plain_loop(spark):
    from zlib import crc32

    texts = ["One two  TWO\tthree", "", None, "ä", " x "]
    got = [r.h for r in spark.createDataFrame([(t,) for t in texts], "t string").select(hashed_words(F.col("t"), 97).alias("h")).collect()]
    for t, h in zip(texts, got, strict=True):
        words = (t or "").lower().split()
        assert h == [crc32(x.encode()) % 97 for x in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]]


def _sentences(n, seed):
    rng = random.Random(seed)
    good, bad = ["good", "great", "fine", "lovely"], ["bad", "awful", "poor", "sad"]
    rows = []
    for _ in range(n):
        words = [rng.choice(good + bad) for _ in range(rng.randrange(1, 9))]
        rows.append((" ".join(words), float(sum(w in good for w in words) - sum(w in bad for w in words)) / len(words)))
    return rows


def test_a_regressor_learns_over_batches_and_resumes(spark):
    held = spark.createDataFrame(_sentences(100, 99) + [("no value", None)], "text string, value double")
    folder = new_path(spark, "weights")
    batches = [spark.createDataFrame(_sentences(120, i), "text string, value double").repartition(3) for i in range(4)]
    model = OnlineRegressor(features=200, rate=1.0, inner=3, folder=folder)
    errors = [model.errors(held).first()["mse"]]
    for i, b in enumerate(batches[:3], 1):
        errors.append(model.partial_fit(b, version=i).errors(held).first()["mse"])
    assert all(b < a for a, b in zip(errors, errors[1:], strict=False)) and errors[-1] < 0.5 * errors[0]
    assert last_version(spark, folder) == 3
    again = OnlineRegressor.resumed(spark, folder, features=200, rate=1.0, inner=3)
    before = again.weights["value"].copy()
    again.partial_fit(batches[0], version=2)  # a batch that has been there
    assert again.steps == 3 and (again.weights["value"] == before).all() and abs(before - model.weights["value"]).max() < 1e-12
    for m in (again, model):
        m.partial_fit(batches[3], version=4)
    assert abs(again.weights["value"] - model.weights["value"]).max() < 1e-9
    one = OnlineRegressor(features=200, rate=1.0, inner=3)
    one.partial_fit(batches[0].coalesce(1))
    many = OnlineRegressor(features=200, rate=1.0, inner=3)
    many.partial_fit(batches[0].repartition(7))
    assert abs(one.weights["value"] - many.weights["value"]).max() < 1e-9 and model.predict("great fine") > 0 > model.predict("sad poor")
    assert OnlineRegressor(features=200).partial_fit(held.limit(0)).predict("x") == 0.0


def test_a_classifier_on_a_stream_goes_on_where_it_stopped(spark):
    folder, source, checkpoint = (new_path(spark, x) for x in ("weights", "source", "checkpoint"))
    schema = "text string, label string"

    def feed(seed):
        rows = [(t, "pos" if v > 0 else "neg") for t, v in _sentences(80, seed) if v] + [("unlabelled", None)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    for n in (1, 2):
        feed(n)
        model = OnlineModel.resumed(spark, folder, features=300, inner=2)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        sync.learn_online(stream, checkpoint, lambda batch, i, model=model: model.partial_fit(batch, version=i + 1)).awaitTermination()
        assert model.steps == n
    assert set(model.weights) == {"pos", "neg"} and model.predict("great fine") == "pos" and model.predict("poor awful sad") == "neg"
    assert OnlineModel(features=9).predict("x") is None
