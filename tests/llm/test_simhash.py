import numpy as np
import xxhash

from lorespark.llm import simhash
from lorespark.llm.simhash import BKForest, fingerprint, linked_fingerprints, near_duplicates, shingles


def plain_fingerprint(text, k=3):
    w = text.lower().split()
    s = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [b" ".join(w)] if w else []
    bits = [0] * 64
    for x in s:
        h = xxhash.xxh64(x, seed=42).intdigest()
        for i in range(64):
            bits[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * bits[i] > len(s))


def brute_components(fps, radius):
    label = {f: f for f in fps}
    while True:
        new = {f: min(label[g] for g in fps if bin(f ^ g).count("1") <= radius) for f in fps}
        if new == label:
            return label
        label = new


def test_fingerprints():
    for t in (b"", b"one", b"One two", b"a b c", b"A b c a b c d", "wörter ÜBER alles".encode(), b"x " * 5000):
        assert fingerprint(t) == plain_fingerprint(t)
    assert shingles(b"A B", 3) == [b"a b"]


def clusters(rng, centres, size):
    out = set()
    for c in rng.integers(0, 2**63, centres, dtype=np.uint64):
        for _ in range(size):
            f = int(c)
            for i in rng.choice(64, rng.integers(0, 5), replace=False):
                f ^= 1 << int(i)
            out.add(f)
    return sorted(out)


def test_bk_search_equals_brute_force():
    rng = np.random.default_rng(1)
    fps = np.array(clusters(rng, 8, 30), np.uint64)
    shard = rng.integers(0, 2, len(fps))
    tree = BKForest(shard, fps)
    found = {(int(fps[q]), int(tree.fp[n])) for qs, ns in tree.search(shard, fps, 2) for q, n in zip(qs, ns, strict=True)}
    assert found == {(int(a), int(b)) for a, s in zip(fps, shard, strict=True) for b, t in zip(fps, shard, strict=True) if s == t and bin(int(a) ^ int(b)).count("1") <= 2}


def test_links_have_the_components_of_all_pairs(spark, monkeypatch):
    from lorespark.llm.shared import components

    rng = np.random.default_rng(2)
    fps = clusters(rng, 6, 40)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    for radius, tree in ((2, 2048), (2, 7), (4, 2048)):
        monkeypatch.setattr(simhash, "TREE_SIZE", tree)
        got = {r.node: r.component for r in components(linked_fingerprints(df, radius)).collect()}
        want = brute_components(signed_pairs := fps, radius)
        assert signed_pairs is fps
        groups = {}
        for f, s in zip(fps, signed, strict=True):
            groups.setdefault(want[f], set()).add(s)
        mine = {}
        for s in signed:
            mine.setdefault(got.get(s, s), set()).add(s)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_components_of_chains_and_stars(spark):
    from lorespark.llm.shared import components

    edges = [(i, i + 1) for i in range(100, 140)] + [(0, i) for i in range(1, 60)] + [(7, 7 + 500)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 141)} == {100} and {got[i] for i in range(60)} == {0} and got[507] == 0
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(odd_docs, no_docs):
    out = {(r.doc_id, r.component_id) for r in near_duplicates(odd_docs).collect()}
    assert {(1, 1), (2, 1), (3, 3), (4, 3), (5, 3)} <= out and (None, None) in out
    assert near_duplicates(odd_docs).count() == odd_docs.count() and near_duplicates(no_docs).count() == 0


def test_near_copies_of_any_similarity_from_0_8_leave_the_pipeline(spark, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = np.random.default_rng(8)
    rows = []
    for i in range(60):
        t = [f"w{k}" for k in rng.integers(0, 5000, int(rng.integers(100, 400)))]
        rows.append((2 * i, t))
        u = t[:]
        for k in rng.choice(len(u), max(1, round(len(u) * float(rng.uniform(0.005, 0.035)))), replace=False):
            u[k] = "other"
        rows.append((2 * i + 1, u))
    hub = [f"h{k}" for k in range(120)]
    rows += [(200 + i, [*hub[:i], f"x{i}", *hub[i + 1 :]]) for i in range(60)]
    rows += [(300, []), (301, []), (None, hub), (302, ["one"]), (302, ["two"])]
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} or {tuple(t)} for _, t in rows]
    label = list(range(len(rows)))
    near = [[j for j in range(len(rows)) if len(a & sets[j]) >= 0.8 * len(a | sets[j])] for a in sets]
    while (new := [min((label[j] for j in js), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k)) for js in near]) != label:
        label = new
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    out = simhash.similar_texts(df).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in out) == sorted((rows[k][0] or -1, rows[label[k]][0]) if rows[k][0] != 0 else (-1, 0) for k in range(len(rows)))
    # One row of each group, and so not the copy without an id, which used to stay.
    kept = [r.doc_id for r in corpus_pipeline.near_copy_removal(spark, df, "").collect()]
    assert sorted(kept) == sorted(rows[k][0] for k in range(len(rows)) if label[k] == k)
    assert 5 < sum(label[2 * i + 1] != 2 * i for i in range(60)) < 55
