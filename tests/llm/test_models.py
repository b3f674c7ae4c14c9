import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespark.llm import hmm_lm
from lorespark.llm.hmm_lm import Model, score_texts
from lorespark.llm.toxicity import best_threshold, fit, score, train


def small_model(symbols=6, states=3, seed=1):
    rng = np.random.default_rng(seed)
    m = Model.__new__(Model)
    m.share = np.full(symbols, 1 / symbols)
    m.start, m.move, m.emit = rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), states), rng.dirichlet(np.ones(symbols), states).T
    m.counts = None
    return m


def paths(m, x):
    """Probability of x and expected counts, by adding up all ways through the states."""
    k = len(m.start)
    total, start, move, emit = 0.0, np.zeros(k), np.zeros((k, k)), np.zeros(m.emit.shape)
    for s in itertools.product(range(k), repeat=len(x)):
        p = m.start[s[0]] * np.prod([m.move[a, b] for a, b in zip(s, s[1:], strict=False)]) * np.prod([m.emit[v, a] for v, a in zip(x, s, strict=True)])
        total += p
        start[s[0]] += p
        for a, b in zip(s, s[1:], strict=False):
            move[a, b] += p
        for v, a in zip(x, s, strict=True):
            emit[v, a] += p
    return total, start / total, move / total, emit / total


@pytest.fixture
def three_states(monkeypatch):
    monkeypatch.setattr(hmm_lm, "STATES", 3)
    monkeypatch.setattr(hmm_lm, "_NUMBERS", np.float64)


def test_forward_recursion_and_counts_equal_the_sum_over_all_paths(three_states):
    m = small_model()
    texts = [np.array(x, np.int32) for x in ([0], [1, 0], [2, 3, 4, 0], [5, 5, 1, 2, 0], [1, 2, 3, 4, 5, 1, 0])]
    every = [paths(m, t) for t in texts]
    assert m.likelihoods(texts) == pytest.approx([np.log(e[0]) for e in every])
    *counts, likely = m.expected(texts)
    assert likely == pytest.approx(sum(np.log(e[0]) for e in every))
    for got, want in zip(counts, (sum(e[i] for e in every) for i in (1, 2, 3)), strict=True):
        assert got == pytest.approx(want)


def test_counts_in_single_precision(three_states, monkeypatch):
    m = small_model()
    texts = [np.random.default_rng(n).integers(0, 6, n).astype(np.uint16) for n in (1, 5, 300, 700, 2500)]
    whole = m.expected(texts)
    monkeypatch.setattr(hmm_lm, "_NUMBERS", np.float32)
    for got, want in zip(m.expected(texts), whole, strict=True):
        assert got == pytest.approx(want, rel=1e-4)


@pytest.mark.parametrize("places", [1 << 17, 40])
def test_counts_of_stretches_are_those_of_whole_texts(three_states, monkeypatch, places):
    rng, m = np.random.default_rng(5), small_model()
    texts = [rng.integers(0, 6, n).astype(np.uint16) for n in (1, 2, 7, 8, 9, 15, 16, 33, 100)]
    whole = m.expected(texts)
    monkeypatch.setattr(hmm_lm, "_PLACES", places)
    for stretch in (1, 2, 7, 8, 99):
        monkeypatch.setattr(hmm_lm, "STRETCH", stretch)
        for got, want in zip(m.expected(texts), whole, strict=True):
            assert got == pytest.approx(want)
    short = [paths(m, t) for t in texts[:4]]
    monkeypatch.setattr(hmm_lm, "STRETCH", 3)
    for got, want in zip(m.expected(texts[:4])[:3], (sum(e[i] for e in short) for i in (1, 2, 3)), strict=True):
        assert got == pytest.approx(want)


def test_long_texts_in_pieces_equal_one_pass(three_states, monkeypatch):
    m = small_model()
    x = np.random.default_rng(2).integers(0, 6, 5000).astype(np.int32)
    pieces = m.likelihoods([x])
    monkeypatch.setattr(hmm_lm, "STRETCH", 5000)
    assert m.likelihoods([x]) == pytest.approx(pieces)


def test_scores_of_odd_rows(spark, odd_docs, no_docs):
    out = score_texts(odd_docs).collect()
    assert len(out) == odd_docs.count() and score_texts(no_docs).count() == 0
    by = {r.doc_id: r for r in out}
    assert by[3].n_tokens == by[4].n_tokens == by[5].n_tokens == 1 and by[6].n_tokens == 30_001
    assert all(np.isfinite(r.score) and np.isfinite(r.base_score) for r in out)


def test_model_beats_words_alone_and_base_is_exact(spark, sf_dir):
    from collections import Counter
    from zlib import crc32

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    words = {r.doc_id: r.text.encode().lower().split() + [b""] for r in rows}
    c = Counter(w for i, ws in words.items() if crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(c.values()), len(c)
    out = score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    for r in out:
        assert r.base_score == pytest.approx(sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words[r.doc_id]))
        assert r.n_known == sum(c[w] > 0 for w in words[r.doc_id]) and r.train_tokens == n and r.held_out == (crc32(str(r.doc_id).encode()) % 10 == 0)
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_shares_of_a_bucket_sum_to_one_with_many_tied_words(spark, monkeypatch):
    from zlib import crc32

    monkeypatch.setattr(hmm_lm, "SYMBOL_WORDS", 8)
    monkeypatch.setattr(hmm_lm, "KNOWN_WORDS", 20)
    monkeypatch.setattr(hmm_lm, "BUCKETS", 4)
    c = {f"often{i}": 9 - i for i in range(5)} | {f"tied{i:03d}": 1 for i in range(100)}
    words = [(w.encode(), n) for w, n in c.items()] + [(b"", 3)]
    counts = spark.createDataFrame([(bytearray(w), n) for w, n in words], "word binary, c long")
    m = hmm_lm._first_model(counts)
    # The words of five counts, and the first three of the tied ones by name.
    assert [w.decode() for w in m.known] == [f"often{i}" for i in range(5)] + [f"tied{i:03d}" for i in range(3)]
    shares = np.zeros(4)
    for w, n in words[:-1]:
        if w not in m.known:
            shares[crc32(w) % 4] += (n + 0.1) / 10 ** m.bucket_log[crc32(w) % 4]
    kinds = np.bincount([crc32(w) % 4 for w, _ in words[:-1] if w not in m.known], minlength=4)
    assert shares + 0.1 / 10**m.bucket_log == pytest.approx(np.ones(4)) and kinds.sum() == 97
    # A probability has no positive logarithm.
    docs = spark.createDataFrame([(i, w) for i, w in enumerate(w for w, n in c.items() for _ in range(n))], "doc_id long, text string")
    assert all(r.score < 0 for r in score_texts(docs).collect())


def test_the_model_is_estimated_from_all_training_texts_alike(spark):
    texts = [f"a b{i % 3} c" for i in range(160)]
    training = spark.createDataFrame([(bytearray(t.encode()),) for t in texts], "text binary")
    m = hmm_lm._first_model(hmm_lm.count_words(training))
    coded = spark.createDataFrame([(bytearray(m.symbols(t.encode().split())[0].astype(np.uint16).tobytes()),) for t in texts], "symbols binary")
    gained = hmm_lm.fit(m, coded)
    assert len(gained) >= 2 and all(b >= a - 1e-3 for a, b in zip(gained, gained[1:], strict=False))
    words = {w: m.counts[2][i + 1].sum() for w, i in m.known.items()}
    assert words == pytest.approx({b"a": 160, b"c": 160, b"b0": 54, b"b1": 53, b"b2": 53})
    assert m.counts[0].sum() == pytest.approx(160) and m.counts[2][0].sum() == pytest.approx(160)


def toxic_docs(spark, n=300):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(n):
        toxic = i % 4 == 0
        t = list(rng.choice(words, rng.integers(5, 60)))
        if toxic:
            t.insert(int(rng.integers(len(t))), "grumble" if i % 8 else "snarl")
        rows.append((i, " ".join(t), "en" if i % 3 else "de", int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")


def test_classifier_learns_held_out_rows(spark):
    all_ = toxic_docs(spark)
    docs = all_.select("doc_id", "text", "lang")
    model = train(docs, all_.select("doc_id", "toxic"))
    out = score(docs, model).join(all_.select("doc_id", F.col("toxic").alias("label")), "doc_id").toPandas()
    held = out[[__import__("zlib").crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]]
    assert ((held.score >= 0.5) == (held.label == 1)).mean() > 0.9 and ((out.score >= 0) & (out.score <= 1)).all()


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (4, 0), (8, 1), (None, 1), (77, None), (6, 0)], "doc_id long, toxic int")
    model = train(odd_docs, labels)
    out = score(odd_docs, model)
    assert out.count() == odd_docs.count() and set(odd_docs.columns) <= set(out.columns)
    assert len({r.score for r in out.collect() if not (r.text or "").strip()}) == 1
    assert score(no_docs, model).count() == 0
    none = train(no_docs, labels.limit(0))
    assert all(r.score < 0.5 for r in score(odd_docs, none).collect())


def test_whole_texts_count(spark, monkeypatch):
    from lorespark.llm import toxicity

    texts = [b"calm words only"] * 20 + [b"calm words snarl"] * 20
    c = fit(texts, np.array([0] * 20 + [1] * 20))
    long = b"calm words only " * 30_000
    mixed = [long, long + b"snarl", b"", b"snarl", b"calm snarl words " + long, b"one", long + b"snarl " + long]
    pieces = c.pooled(mixed)
    assert c.raw([long + b"snarl"])[0] > c.raw([long])[0]
    assert pieces == pytest.approx(np.concatenate([c.pooled([t]) for t in mixed]), abs=1e-5)  # no text sees its neighbours
    assert (pieces[6] >= pieces[0]).all() and (pieces[6] != pieces[0]).any()
    for at_once in (7, 1 << 30):
        monkeypatch.setattr(toxicity, "_AT_ONCE", at_once)
        some = mixed if at_once > 7 else mixed[2:4] + [b"calm snarl words only calm " * 5]
        monkeypatch.setattr(toxicity, "_AT_ONCE", 1 << 15)
        want = c.pooled(some)
        monkeypatch.setattr(toxicity, "_AT_ONCE", at_once)
        assert c.pooled(some) == pytest.approx(want, abs=1e-5)


def test_threshold():
    def of(scores, labels, most=1000):
        counts = np.zeros((most, 2), int)
        np.add.at(counts, ((np.array(scores) * most).astype(int), labels), 1)
        return best_threshold(counts)

    assert 0.4 < of([0.1, 0.3, 0.6, 0.9], [0, 0, 1, 1]) < 0.5
    assert of([0.1, 0.9], [0, 1]) == pytest.approx(0.5, abs=0.01) and of([0.05, 0.1], [1, 1]) == 0.2 and of([0.95, 0.99], [0, 1]) == 0.8
    rng = np.random.default_rng(2)
    for _ in range(20):  # no other threshold within the bounds has a higher F1
        labels = rng.integers(0, 2, 60)
        scores = np.clip(rng.normal(0.4 + 0.2 * labels, 0.1), 0.21, 0.79).round(2) + 0.0005
        f1 = lambda t: 2 * (labels[scores >= t]).sum() / ((scores >= t).sum() + labels.sum())  # noqa: B023, E731
        assert f1(of(scores, labels)) == pytest.approx(max(f1(t) for t in scores))


def plain_maxima(c, text):
    """Every filter at every word, in loops; the text is followed by blanks."""
    from zlib import crc32

    from lorespark.llm.toxicity import DIMENSION, FILTERS, START_BUCKETS, START_BYTES, WIDTHS, WORD_BUCKETS

    words = text.lower().split()
    x = [np.concatenate([c.word[crc32(w) % (WORD_BUCKETS - 1) + 1], c.start[crc32(w[:START_BYTES]) % (START_BUCKETS - 1) + 1]]) for w in words]
    blank = np.concatenate([c.word[0], c.start[0]])
    assert len(blank) == 2 * DIMENSION
    out, at = [], 0
    for n, width in enumerate(WIDTHS):
        for f in range(FILTERS):
            best = -np.inf
            for i in range(len(words) + 1):
                total = c.shift[n * FILTERS + f]
                for k in range(width):
                    total = total + (x[i + k] if i + k < len(words) else blank) @ c.kernel[:, (at + k) * FILTERS + f]
                best = max(best, total)
            out.append(max(best, 0))
        at += width
    return np.array(out)


def test_pooled_equals_loops():
    from lorespark.llm.toxicity import Classifier

    c = Classifier.blank(3)
    c.shift[:] = np.random.default_rng(1).normal(0, 0.1, len(c.shift))
    texts = [b"", b"one", b"Two words", b"a b c d e f g h", b"long " * 40 + b"end"]
    assert c.pooled(texts) == pytest.approx(np.stack([plain_maxima(c, t) for t in texts]), abs=1e-5)


def test_gradients_equal_differences(monkeypatch):
    from lorespark.llm import toxicity
    from lorespark.llm.toxicity import BATCH, RATE, Classifier, features

    monkeypatch.setattr(toxicity, "EPOCHS", 1)
    monkeypatch.setattr(toxicity, "STEPS", 0)
    texts, labels = [b"calm words only here", b"a snarl of words", b"snarl", b"other words of calm"], np.array([0, 1, 1, 0])
    assert len(texts) <= BATCH
    before, after = Classifier.blank(1), fit(texts, labels)

    def loss(c):
        p = np.clip(1 / (1 + np.exp(-c.raw(texts))), 1e-12, 1 - 1e-12)
        return float(-(labels * np.log(p) + (1 - labels) * np.log(1 - p)).mean())  # both classes have half of the weight

    def slope_of(a, at):
        old, out = a[at], []
        for d in (1e-2, -1e-2):
            a[at] = old + d
            out.append(loss(before))
        a[at] = old
        return (out[0] - out[1]) / 2e-2

    def step_of(gradient):  # the first step of Adagrad
        return -RATE * gradient / np.sqrt(1e-4 + gradient**2)

    word, start, _ = features(texts)
    for name, places in (("out", [(k,) for k in range(0, 24, 5)]), ("kernel", [(k, 3 * k) for k in range(10)]), ("shift", [(2,), (20,)]), ("word", [(int(word[8]), 0), (int(word[0]), 3)]), ("start", [(int(start[8]), 1)])):
        for at in places:
            moved = float(getattr(after, name)[at] - getattr(before, name)[at])
            assert moved == pytest.approx(step_of(slope_of(getattr(before, name), at)), abs=0.02), (name, at)


def test_toxicity_without_languages_and_with_clashing_names(spark):
    all_ = toxic_docs(spark)
    docs = all_.select("doc_id", "text", F.lit(1).alias("of"), F.lit(2).alias("label"), F.lit(3).alias("text_bytes"), F.lit(4).alias("__id"))
    model = train(docs, all_.select("doc_id", "toxic", F.lit(0).alias("of"), F.lit("x").alias("label")))
    assert model.thresholds == {}
    out = score(docs, model).collect()
    assert len(out) == 300 and all((r.of, r.label, r.text_bytes, r["__id"]) == (1, 2, 3, 4) for r in out)
    named = train(all_.select("doc_id", "text", F.when(F.col("lang") == "en", "en").alias("lang")), all_.select("doc_id", "toxic"))
    assert set(named.thresholds) == {"en"}
    score(docs, named).collect()


def test_thresholds_follow_all_labelled_rows(spark):
    from lorespark.llm.toxicity import STEPS_OF_SCORE

    all_ = toxic_docs(spark, 600)
    docs, labels = all_.select("doc_id", "text", "lang"), all_.select("doc_id", "toxic")
    model = train(docs, labels, sample=60)
    # 60 rows of a class are sampled, a fifth of them calibrate, and every other labelled row outside the fold counts.
    rows = [r for r in score(docs, model).join(labels.withColumnRenamed("toxic", "label"), "doc_id").collect() if __import__("zlib").crc32(str(r.doc_id).encode()) % 5]
    f1 = lambda t: 2 * sum(r.label for r in rows if r.score >= t) / (sum(r.score >= t for r in rows) + sum(r.label for r in rows))
    assert f1(model.other) >= max(f1(t / STEPS_OF_SCORE) for t in range(200, 801, 5)) - 0.02


def test_known_words_are_bounded(spark, monkeypatch):
    rows = [(bytearray(b"w%d" % i), c) for i, c in enumerate([100_000, 99_999, 70_000] + [5] * 40 + [3] * 30 + [1] * 100)]
    df = spark.createDataFrame(rows, "word binary, c long")
    for most, want in ((50, 43), (2, 2), (1000, 173), (42, 3)):
        monkeypatch.setattr(hmm_lm, "KNOWN_WORDS", most)
        got = hmm_lm._frequent(df)
        assert len(got) == want and [r["c"] for r in got] == sorted((r["c"] for r in got), reverse=True)
    assert hmm_lm._frequent(df.limit(0)) == []
