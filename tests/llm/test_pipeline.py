"""Each stage against brute force over its own input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from lorespark.llm.shared import written
from tests.llm.test_exact_and_lines import brute_lines
from tests.llm.test_simhash import plain_fingerprint


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, f in p.STAGES:
        out.append(docs := written(f(spark, docs, sf_dir), name))
    return out


def test_columns(stages):
    for before in stages[1:-1]:
        assert before.columns == stages[0].columns


def test_toxicity_keeps_rows_as_they_are(stages):
    assert stages[1].exceptAll(stages[0]).count() == 0 and stages[1].count() >= 0.7 * stages[0].count()


def test_lines(stages):
    rows = sorted((r.doc_id, r.text) for r in stages[1].collect())
    gone = brute_lines(rows, 4)
    want = {}
    for (i, t), g in zip(rows, gone, strict=True):
        left = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in g)
        if not g or left.strip():
            want[i] = left
    got = {r.doc_id: r for r in stages[2].collect()}
    assert {i: r.text for i, r in got.items()} == want and all(len(r.text) == r.n_chars for r in got.values())


def test_near_copies(stages):
    rows = sorted((r.doc_id, plain_fingerprint(r.text.encode(), 5)) for r in stages[2].collect())
    label = {i: i for i, _ in rows}
    fp = dict(rows)
    while True:
        new = {i: min(label[j] for j in fp if bin(fp[i] ^ fp[j]).count("1") <= 4) for i in fp}
        if new == label:
            break
        label = new
    assert {r.doc_id for r in stages[3].collect()} == {i for i in fp if label[i] == i}


def test_mixing_and_packing(stages):
    before = {r.doc_id: r for r in stages[3].collect()}
    taken = {r.doc_id: r["n"] for r in stages[4].groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(taken) <= set(before) and max(taken.values()) <= 2
    firsts = stages[5].filter("piece = 0").groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in firsts} == taken
    assert stages[5].groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for t in (a, b))
    return 1.0 if not x and not y else len(x & y) / len(x | y)


def one_of_each_group(rows):
    """Brute force: of each group of linked texts the first row by id (null last) and place."""
    label = list(range(len(rows)))
    while True:
        new = [min(label[j] for j in range(len(rows)) if jaccard(rows[i][1] or "", rows[j][1] or "") >= 0.8) for i in range(len(rows))]
        if new == label:
            return label
        label = new


def test_near_copies_keep_one_row_of_each_group_whatever_the_ids(spark, sf_dir):
    words = [f"w{i}" for i in range(60)]
    t, u, v = " ".join(words), " ".join(f"u{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    near = " ".join(["x", *words[1:]])
    rows = [(1, t), (2, t), (2, u), (3, v), (3, v), (None, t), (4, near), (2, near), (None, "lonely words without an id here"), (None, None), (5, ""), (5, " \t")]
    docs = spark.createDataFrame([(i, x, "en", "s", 0, "mine", n) for n, (i, x) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, kept string, digest int")
    out = p.near_copy_removal(spark, docs, sf_dir)
    assert out.columns == docs.columns
    left = out.collect()
    label = one_of_each_group(rows)
    assert sorted(label[r.digest] for r in left) == sorted(set(label))
    for r in left:
        group = [rows[i][0] for i in range(len(rows)) if label[i] == label[r.digest]]
        assert r.doc_id == min((i for i in group if i is not None), default=None)
    assert p.near_copy_removal(spark, docs.limit(0), sf_dir).count() == 0


def test_odd_rows(spark, odd_docs, sf_dir):
    docs = odd_docs.withColumns({c: F.concat(F.lit(f"{c} "), F.coalesce("kept", F.lit("-"))) for c in ("score", "toxic", "clean", "n_lines", "deleted", "copies", "id", "digest")})
    own = {r.score[6:]: r for r in docs.collect()}
    for name, f in p.STAGES:
        empty = f(spark, docs.limit(0), sf_dir)
        assert empty.count() == 0
        before = docs
        docs = written(f(spark, docs, sf_dir), "odd")
        if name != p.STAGES[-1][0]:
            assert docs.columns == before.columns
            for r in docs.collect():
                assert all(r[c] == own[r.score[6:]][c] for c in docs.columns if c not in ("text", "n_chars", "doc_id"))
    assert docs.count() > 0
