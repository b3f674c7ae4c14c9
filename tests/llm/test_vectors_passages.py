import random

import numpy as np
import pyarrow as pa
from xxhash import xxh64_intdigest

from lorespark.llm import embeddings
from lorespark.llm.embeddings import near_vectors
from lorespark.llm.passages import compact_windows, each_shingles, hashed, matching_passages, repeated_passages, shingle_hashes, word_hashes


def brute(rows, least=0.95):
    good = {i: np.asarray(v, float) for i, (_, v) in enumerate(rows) if v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = {i: {j for j in good if j != i and good[i] @ good[j] / np.sqrt((good[i] @ good[i]) * (good[j] @ good[j])) >= least} for i in good}
    label = {i: i for i in good}
    while True:
        new = {i: min([label[i], *(label[j] for j in links[i])], key=lambda k: (rows[k][0], k)) for i in good}
        if new == label:
            break
        label = new
    return sorted((r[0], len(links.get(i, ())), rows[label[i]][0] if i in label else r[0]) for i, r in enumerate(rows))


def vectors(rng, n=150):
    rows = []
    for c in range(4):
        centre = rng.normal(size=8)
        rows += [(len(rows) + k, (centre * rng.uniform(0.5, 2) + rng.normal(size=8) * s).astype(np.float32).tolist()) for k, s in enumerate(rng.uniform(0, 0.5, n // 5))]
    rows += [(1000 + i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(n // 5)]
    rows += [(2000, None), (2001, [0.0] * 8), (2002, [1.0, None] + [0.0] * 6), (2003, [float("nan")] + [1.0] * 7), (2004, [float("inf")] * 8), (2005, [1.0] * 5), (2006, []), (2007, rows[0][1]), (2007, rows[0][1])]
    return rows


def test_links_equal_brute_force(spark, monkeypatch):
    rows = vectors(np.random.default_rng(1))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in near_vectors(df).collect()) == brute(rows)
    assert near_vectors(df.limit(0)).count() == 0
    assert [tuple(r) for r in near_vectors(df.filter("vec_id = 2001")).collect()] == [(2001, 0, 2001)]


def test_recall_with_windows_far_smaller_than_the_table(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(700, 16))
    x = np.concatenate([base, base[:300] + rng.normal(size=(300, 16)) * 0.22])
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    u = np.array([r[1] for r in rows], float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    true = np.triu(u @ u.T >= 0.95, 1).sum()
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), window=16).agg({"n_links": "sum"}).first()[0] / 2
    assert true > 50 and 0.9 * true <= got <= true


def links_found(spark, x, **more):
    """Links found, true links, and whether any vector has more than its true ones."""
    x = np.asarray(x, np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    true = (u @ u.T >= 0.95).sum(axis=1) - 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = np.array([r.n_links for r in near_vectors(df, **more).orderBy("vec_id").collect()])
    assert (got <= true).all()
    return got.sum(), true.sum()


def test_many_groups_far_larger_than_a_window(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CROWD", 8)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=32) + rng.normal(size=(80, 32)) * s for s in rng.uniform(0.02, 0.25, 40)])
    got, true = links_found(spark, x, window=4)
    assert true > 60_000 and got >= 0.97 * true


def test_links_within_a_dense_cone(spark):
    """A third of all vectors lie in a cone of cosine 0.85 with one another, where signs of projections tell little."""
    rng = np.random.default_rng(5)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    axis = unit(rng.normal(size=64))
    cone = np.sqrt(0.85) * axis + np.sqrt(0.15) * unit(rng.normal(size=(700, 64)))
    near = unit(cone[:150] + 0.3 * unit(rng.normal(size=(150, 64))))
    got, true = links_found(spark, np.concatenate([cone, near, rng.normal(size=(1500, 64))]), window=16)
    assert true > 200 and got >= 0.97 * true


def test_equal_vectors_doubles_and_other_lengths(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(2, 8))
    rows = [(i, a.tolist()) for i in range(300)] + [(300, (a * 1e-200).tolist()), (301, (b * 1e200).tolist()), (302, b.tolist())]
    rows += [(400 + i, [1.0, 2.0, 3.0]) for i in range(3)] + [(500, [1.0, 2.0, 3.0, 0.0])]
    # The cosine of these two is 0.95 in double precision, and less with single-precision components.
    c = np.array([1.0, 0.0, 1e-9])
    rows += [(600, c.tolist()), (601, [0.95, float(np.sqrt(1 - 0.95**2)), 1e-9])]
    true = c @ np.array(rows[-1][1]) / np.linalg.norm(c) / np.linalg.norm(rows[-1][1]) >= 0.95
    out = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert len(out) == len(rows) and {out[i] for i in range(301)} == {(300, 0)}
    assert out[301] == out[302] == (1, 301) and {out[400 + i] for i in range(3)} == {(2, 400)} and out[500] == (0, 500)
    assert out[601][0] == out[600][0] == int(true)


def test_compact_windows_hold_every_subsequence_once():
    rng = np.random.default_rng(3)
    for v in (rng.integers(0, 50, 60), np.zeros(40, int), np.arange(30)):
        got = {}
        for a, c, b in compact_windows(v, 5):
            for i in range(a, c + 1):
                for j in range(c, b + 1):
                    if j - i + 1 >= 5:
                        assert (i, j) not in got and v[c] == v[i : j + 1].min()
                        got[i, j] = c
        assert len(got) == sum(1 for i in range(len(v)) for j in range(i + 4, len(v)))


def test_repetitive_texts_make_shallow_trees():
    assert len(compact_windows(hashed(shingle_hashes(b"word " * 100_000), 0), 46)) < 10_000


def test_words_hashed_together_are_the_same_as_one_by_one():
    r = random.Random(4)
    pieces = [b"a", b"B", b"\xc3\xa9", b" ", b"\n", b"\t", b"\x0b", b"\x1c", b"\x85", b"\x00", b"z" * 9, b"q" * 70]
    texts = [b"".join(r.choice(pieces) for _ in range(r.randrange(60))) for _ in range(300)] + [b"", b"word " * 60_000, b"x" * 300_000]
    for x in texts:
        assert word_hashes(x)[0].tolist() == [xxh64_intdigest(w, 0) for w in x.split()]
    for x, got in zip(texts, each_shingles(pa.array(texts, pa.binary())), strict=True):
        assert len(got) == max(0, len(x.split()) - 4) and np.array_equal(got, shingle_hashes(x))
    assert np.array_equal(shingle_hashes(b"A b C d E f"), shingle_hashes(b"\ta B c D e\nF "))


def test_passages_are_measured():
    a = shingle_hashes(" ".join(f"x{i}" for i in range(100)).encode())
    b = shingle_hashes((" ".join(f"y{i}" for i in range(30)) + " " + " ".join(f"x{i}" for i in range(20, 90))).encode())
    assert [p[:4] for p in matching_passages(a, b, 46, 0.8)] == [(20, 86, 30, 96)]
    assert matching_passages(a, shingle_hashes(b"z " * 80), 46, 0.8) == []


def words(rng, n):
    return [f"w{i}" for i in rng.integers(0, 5000, n)]


def test_planted_passages_are_found_and_clean_documents_left_alone(spark):
    rng = np.random.default_rng(5)
    passage, other = words(rng, 55), words(rng, 120)
    docs = {i: words(rng, int(rng.integers(60, 400))) for i in range(40)}
    for i in range(10):
        docs[i] = docs[i][:20] + passage + docs[i][20:]
    for i in range(10, 14):
        changed = list(other)
        changed[int(rng.integers(120))] = "changed"
        docs[i] = docs[i][:30] + changed + docs[i][30:]
    docs[20] = docs[21][:]  # a copy
    rows = [(i, " ".join(w)) for i, w in docs.items()] + [(50, None), (51, ""), (None, " ".join(passage)), (52, " ".join(passage[:40]))]
    out = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in out} | {r.other_id for r in out} == {*range(14), 20, 21}
    assert {r.doc_id for r in out if r.other_id == 0} == set(range(1, 10))
    assert all(r.start <= 20 and r.end >= 75 for r in out if r.other_id == 0)
    assert {(r.doc_id, r.other_id) for r in out if r.doc_id in (20, 21)} == {(21, 20)}


def test_odd_rows(odd_docs, no_docs):
    assert {r.doc_id for r in repeated_passages(odd_docs).collect()} <= {6}
    assert repeated_passages(no_docs).count() == 0


def test_edits_in_the_middle_do_not_cut_a_passage_short():
    for n in (85, 90, 100, 103):
        one = [f"x{i}" for i in range(n)]
        for at in range(0, n - 4):
            other = [*one[:at], *(f"y{i}" for i in range(5)), *one[at + 5 :]]
            a, b = (set(zip(*(w[k:] for k in range(5)))) for w in (one, other))  # noqa: B905
            similarity = len(a & b) / len(a | b)
            found = matching_passages(shingle_hashes(" ".join(one).encode()), shingle_hashes(" ".join(other).encode()), 46, 0.8)
            if similarity >= 0.8:
                assert found, (n, at, similarity)


def test_two_passages_with_much_between_stay_apart():
    x, y = [f"x{i}" for i in range(60)], [f"y{i}" for i in range(60)]
    a = shingle_hashes(" ".join(x + [f"a{i}" for i in range(200)] + y).encode())
    b = shingle_hashes(" ".join(x + [f"b{i}" for i in range(200)] + y).encode())
    assert [p[:4] for p in matching_passages(a, b, 46, 0.8)] == [(0, 56, 0, 56), (260, 316, 260, 316)]


def test_runs_that_a_third_document_masks_are_found(spark):
    rng = np.random.default_rng(9)
    rows, pairs = [], []
    for k in range(60):
        run = words(rng, 56)
        a = int(rng.integers(0, 8))
        rows += [(10 * k, words(rng, 60) + run[a : a + 49] + words(rng, 60)), (10 * k + 1, words(rng, 80) + run + words(rng, 50)), (10 * k + 2, words(rng, 30) + run + words(rng, 90))]
        pairs.append((10 * k + 2, 10 * k + 1))
    out = repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.other_id) for r in out} == set(pairs)


def test_shared_runs_equal_a_comparison_of_all_pairs(spark):
    """Every document with a run of 50 words or more of an earlier one has a row, and no other: texts share whole runs only."""
    rng = np.random.default_rng(10)
    pool = [words(rng, int(n)) for n in (45, 49, 50, 51, 60, 80, 150)]
    docs = {}
    for i in range(80):
        parts = [words(rng, int(rng.integers(5, 60)))]
        for k in rng.choice(len(pool), int(rng.integers(0, 3)), replace=False):
            cut = pool[k][int(rng.integers(0, 4)) :]
            parts += [cut, words(rng, int(rng.integers(5, 60)))]
        docs[i] = [w for p in parts for w in p]
    runs = {i: {tuple(w[k : k + 50]) for k in range(len(w) - 49)} for i, w in docs.items()}
    want = {i for i in docs if any(runs[i] & runs[j] for j in range(i))}
    out = repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string"), similarity=0.999).collect()
    assert {r.doc_id for r in out} == want
    assert all(r.other_id < r.doc_id and r.end - r.start >= 50 and runs[r.doc_id] & runs[r.other_id] for r in out)


def test_runs_beside_those_of_the_first_are_found(spark):
    """The second document shares a run with the first and another, which overlaps it, with the third."""
    rng = np.random.default_rng(12)
    rows, pairs = [], set()
    for k in range(100):
        run = words(rng, 68)
        rows += [(10 * k, words(rng, 40) + run[:56] + words(rng, 30)), (10 * k + 1, words(rng, 20) + run + words(rng, 50)), (10 * k + 2, words(rng, 30) + run[12:] + words(rng, 60))]
        pairs |= {(10 * k + 1, 10 * k), (10 * k + 2, 10 * k + 1)}
    out = repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.other_id) for r in out} == pairs
