"""The prefix trie and hard negatives against brute force, in small runs, ranges, shards and blocks."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespark.llm.prefix_trie import conversation_trie, merge, ordered_turns, prefix_trie, runs, with_shared_heads
from lorespark.llm.vantage import VPTree, hard_negatives

KIND = "conv_id long, turn long, role string, text string"


def brute_trie(sequences):
    """Nodes of {conv_id: list of (role, text)} by plain prefixes."""
    members = {}
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = children.get(p, [])
        leaves[p] = sum(leaves[x] for x in below) or 1
        saved[p] = sum(saved[x] for x in below) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(sequences[c]) == len(p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t, key=lambda x: x[:2])] for c, t in own.items()}
    return {c: own.get(c - c % 100, [])[: (h := zlib.crc32(str(c).encode()) % 6)] + t[h:] for c, t in own.items()}


def rows_of(df):
    return sorted((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def small_trie(df, **sizes):
    return prefix_trie(with_shared_heads(ordered_turns(df)), **sizes)


def conversations(seed, n, words=3, copies=0.3):
    rng = random.Random(seed)
    rows, before = [], []
    for c in range(n):
        turns = rng.choice(before) if before and rng.random() < copies else [(rng.choice(["user", "assistant"]), f"w{rng.randrange(words)}" * rng.randrange(1, 4)) for _ in range(rng.randrange(1, 9))]
        before.append(turns)
        rows += [(c, k, *t) for k, t in enumerate(turns)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "run_size", "range_turns"), [(1, 16_384, 200_000), (2, 7, 60), (3, 3, 25), (4, 1000, 11)])
def test_trie_equals_brute_force(spark, seed, run_size, range_turns):
    rows = conversations(seed, 250)
    df = spark.createDataFrame(rows, KIND).repartition(5)
    assert rows_of(small_trie(df, run_size=run_size, range_turns=range_turns)) == brute_trie(rebuilt(rows))


def test_a_third_of_all_conversations_alike_and_a_common_first_turn(spark):
    rows = conversations(5, 60) + [(c, k, "user", f"same {k}") for c in range(1000, 1030) for k in range(4)]
    rows += [(c, k, "user", "hello" if k == 0 else f"turn {c * 7 % 13} {k}") for c in range(2001, 2200) for k in range(5)]
    df = spark.createDataFrame(rows, KIND)
    assert rows_of(small_trie(df, run_size=20, range_turns=50)) == brute_trie(rebuilt(rows))


def test_trie_of_odd_rows(spark):
    long = "ä" * 100_000
    rows = [(1, None, None, None), (1, 0, "user", long), (2, None, "", ""), (2, 0, "user", long), (3, 5, "user", "𝒳"), (100, 0, None, "base"), (101, 0, "user", "x"), (101, 1, "user", "y"), (None, 0, "user", "lost"), (-5, 0, "a", "b"), (7, 0, "s", "t"), (7, 1, "s", "t"), (7, 2, "s", "t")]
    df = spark.createDataFrame([(*r, "mine") for r in rows], KIND + ", turns string")
    assert rows_of(conversation_trie(df)) == brute_trie(rebuilt(rows))
    assert conversation_trie(df.limit(0)).count() == 0 and conversation_trie(df.filter("conv_id is null")).count() == 0
    twice = spark.createDataFrame([(100, 0, "u", "x"), (100, 0, "u", "x")], KIND)
    assert [(r.depth, r.n_convs) for r in conversation_trie(twice).orderBy("depth").collect()] == [(0, 1), (1, 1), (2, 1)]


def test_a_deep_conversation(spark):
    rows = [(1, k, "user", f"t{k}") for k in range(3000)] + [(2, k, "user", f"t{k}") for k in range(2000)]
    assert rows_of(small_trie(spark.createDataFrame(rows, KIND), range_turns=2500)) == brute_trie(rebuilt(rows))


def test_merged_runs_are_in_order_and_compare_no_shared_turn_again():
    rng = random.Random(9)
    reads = [0]

    class Turn(int):
        def __eq__(self, other):
            reads[0] += 1
            return int(self) == int(other)

        __hash__ = int.__hash__

    prefix = [Turn(0)] * 300
    records = [(prefix + [Turn(rng.randrange(5)) for _ in range(rng.randrange(1, 6))],) for _ in range(400)]
    pieces = list(runs(iter(records), 50))
    reads[0] = 0
    got = list(merge([[(*r, None) for r in p] for p in pieces]))
    shared = reads[0]
    want = sorted(r[0] for r in records)
    assert [r[0] for r in got] == want
    assert [r[1] for r in got] == [0, *(next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if int(x) != int(y)), min(len(a), len(b))) for a, b in zip(want, want[1:], strict=False))]
    assert shared < 400 * 10 * 3 + 8 * 300 * 3  # a merge that began at the first turn would read some 300 x 400 x 3


def brute_negatives(rows, positives=5, k=10, low=30, high=90):
    q = [(i, label, [int(np.floor(256 * float(x))) for x in v]) for i, v, label in rows if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    q = list({(i, label, tuple(v)): None for i, label, v in q})
    out = []
    for a in q:
        if a[0] is None or a[0] % 100:
            continue
        score = lambda b: sum(x * y for x, y in zip(a[2], b[2], strict=False))
        order = sorted((b for b in q if b is not a), key=lambda b: (-score(b), b[0] is None, b[0] or 0, b[1], b[2]))
        for p in [b for b in order if b[1] == a[1]][:positives]:
            for rank, n in enumerate([b for b in order if b[1] != a[1] and low * score(p) <= 100 * score(b) <= high * score(p)][:k], 1):
                out.append((a[0], p[0], rank, n[0], score(p), score(n)))
    return sorted(out, key=str)


def negatives(df, **sizes):
    return sorted(((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in hard_negatives(df, **sizes).collect()), key=str)


VECTORS = "vec_id long, embedding array<float>, label int"


def clusters(seed, n, dimension=12, groups=9):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, dimension))
    rows = []
    for i in range(n):
        v = middle[i % groups] * (i % 3 != 0) + rng.normal(size=dimension) * rng.choice([0.05, 0.6])
        rows.append((i * 5, [float(x) for x in (v / np.linalg.norm(v) * rng.choice([1, 1, 0.4, 2.5])).astype(np.float32)], int(rng.integers(0, 4))))
    return rows + [(10_000 + i, rows[7][1], i % 2) for i in range(60)]  # equal vectors: ties


@pytest.mark.parametrize("sizes", [{}, {"shard": 40, "block": 7, "sample": 100, "regions": 6}])
def test_negatives_equal_brute_force(spark, sizes):
    rows = clusters(1, 500)
    got = negatives(spark.createDataFrame(rows, VECTORS), **sizes)
    assert got == brute_negatives(rows) and len(got) > 500


def test_negatives_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    v = lambda n=4: [float(x) for x in rng.normal(size=n).astype(np.float32)]
    rows = [(100 * (i // 9) if i % 9 == 0 else 1000 + i, v(), i % 3) for i in range(60)]
    rows += [(None, v(), 0), (None, v(), 1), (7, None, 1), (8, v(), None), (9, [1.0, None], 0), (10, [float("nan")] * 4, 0), (11, [float("inf")] * 4, 1), (12, [], 1), (13, [0.0] * 4, 2), (14, v(7), 0), (15, v(2), 1)]
    rows += [rows[0], (rows[1][0], v(), 2), (300, [0.0] * 4, 0)]
    df = spark.createDataFrame([(*r, "mine", 1) for r in rows], VECTORS + ", score string, vid int")
    got = negatives(df)
    assert got == brute_negatives(rows) and any(r[3] is None or r[1] is None for r in got)
    assert hard_negatives(df.limit(0)).count() == 0 and hard_negatives(df.filter("label is null")).count() == 0
    assert hard_negatives(df.filter(F.col("vec_id") % 100 != 0)).count() == 0


def test_traversal_takes_the_nearest_leaves_first_and_ends_early():
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(900, 3)), rng.normal(size=(5, 3))
    d = np.sqrt(((x - q[:, None]) ** 2).sum(2))
    inner, outer = np.full(5, 0.8), np.full(5, 2.5)
    looked, found = np.zeros(5), [[] for _ in q]
    tree = VPTree(x, 16)
    for asking, rows in tree.nearest_first(q, inner, outer):
        for i in asking:
            looked[i] += len(rows)
            found[i] = sorted([*found[i], *(r for r in rows if 0.8 <= d[i, r] <= 2.5)], key=lambda r: d[i, r])[:12]
            if len(found[i]) == 12:
                outer[i] = min(outer[i], d[i, found[i][-1]])
    for i in range(5):
        assert found[i] == [r for r in np.argsort(d[i]) if 0.8 <= d[i, r] <= 2.5][:12]
    assert (looked < 900).all() and looked.mean() < 450
