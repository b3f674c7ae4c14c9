import re

from pyspark.sql import functions as F

from lorespark.llm.exact_dedup import exact_dedup
from lorespark.llm.line_dedup import line_dedup
from lorespark.llm.shared import new_path


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((i, t))
    out = []
    for i, t in rows:
        g = groups[norm(t)]
        keep = min(g, key=lambda x: (-len(x[1] or ""), x[0] is None, x[0] or 0))[0]
        out.append((i, keep, len(g), i == keep))
    return sorted(out, key=str)


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(odd_docs).collect()), key=str) == brute(rows)
    assert exact_dedup(no_docs).count() == 0


def test_equal_digests_of_different_texts_are_told_apart(spark):
    rows = [(i, t) for i, t in enumerate(["aa", "a a", "bb", "cc", "b  b", "dd"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    weak = exact_dedup(df, digest=lambda t: F.lit("same"))
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in weak.collect()), key=str) == brute(rows)


def as_rows(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect()), key=str)


def test_calls_go_on_from_the_state_and_clashes_across_calls_are_told_apart(spark):
    texts = [["aa", "x y", "bb"], ["a a", "xy", "cc", "x  y "], ["aa", "xy", "bb", "dd"]]
    for weak in (None, lambda t: F.substring(t, 1, 0)):
        folder, seen = new_path(spark, "test-state"), []
        for n, part in enumerate(texts):
            rows = [(10 * n + i, t) for i, t in enumerate(part)]
            seen += rows
            more = {} if weak is None else {"digest": weak}
            out = as_rows(exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), state_folder=folder, **more))
            assert out == [r for r in brute(seen) if r[0] in dict(rows)]


def test_locators_of_earlier_calls_are_followed(spark):
    import pytest

    def docs(rows):
        return spark.createDataFrame(rows, "doc_id long, text string")

    folder, where = new_path(spark, "test-state"), F.concat(F.lit("row "), F.col("doc_id"))
    same = lambda t: F.lit("one digest")
    first, second = [(1, "first text")], [(2, "other text"), (3, "firsttext")]
    assert as_rows(exact_dedup(docs(first), locator=where, digest=same, state_folder=folder)) == brute(first)
    asked = []

    def fetch(wanted):
        asked.extend(r.locator for r in wanted.collect())
        return docs(first).select(where.alias("locator"), "text")

    out = exact_dedup(docs(second), locator=where, digest=same, state_folder=folder, fetch=fetch)
    assert as_rows(out) == [r for r in brute(first + second) if r[0] > 1] and asked == ["row 1"]
    with pytest.raises(ValueError, match="fetch"):
        exact_dedup(docs(second), locator=where, state_folder=folder)


def brute_lines(docs, least):
    """Positions that lie in a run with at least `least` words which stands earlier; docs in order."""
    places = [(k, [(i, x, len(re.findall(r"[^\x20\x09-\x0D]+", x))) for i, x in enumerate(t.split("\n")) if re.search(r"[^\x20\x09-\x0D]", x)]) for k, (_, t) in enumerate(docs)]
    gone = [set() for _ in docs]
    first = {}
    for k, lines in places:
        for a in range(len(lines)):
            n = 0
            for b in range(a, len(lines)):
                n += lines[b][2]
                if n >= least:
                    run = tuple(x for _, x, _ in lines[a : b + 1])
                    if first.setdefault(run, (k, a)) < (k, a):
                        gone[k] |= {i for i, _, _ in lines[a : b + 1]}
    return [sorted(g) for g in gone]


def test_lines_equal_brute_force(spark):
    import random

    rng = random.Random(4)
    lines = ["one", "two words", "a longer line of words", "", "x y", "z", "more of the same here", "  "]
    docs = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 9)))) for i in range(40)]
    out = {r.doc_id: r for r in line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for (i, t), want in zip(docs, brute_lines(docs, 4), strict=True):
        assert out[i].deleted == want
        assert out[i].clean == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want)


def test_lines_of_odd_rows(odd_docs, no_docs):
    out = line_dedup(odd_docs).collect()
    assert len(out) == odd_docs.count() and line_dedup(no_docs).count() == 0
    by = {r.doc_id: r for r in out}
    assert by[1].deleted == [] and by[2].deleted == [0, 1] and by[2].clean == "" and by[3].clean == "" and by[3].n_lines == 1
    assert by[2].kept == "x"  # other columns stay


def test_lines_keep_columns_with_any_name(spark):
    df = spark.createDataFrame([(1, "a b c d", 7, 8, 9), (2, "a b c d", 7, 8, 9)], "doc_id long, text string, id_of long, gone long, __hash long")
    out = sorted(line_dedup(df).collect(), key=lambda r: r.doc_id)
    assert [(r.deleted, r.id_of, r.gone, r["__hash"]) for r in out] == [([], 7, 8, 9), ([0], 7, 8, 9)]


def test_a_hundred_thousand_lines_in_one_text(spark):
    import time

    def texts(n):
        lines = [f"line {i} has some words" if i % 3 else f"short {i}" for i in range(n)]
        return spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(["an own line of words", *lines[n // 2 :]]))], "doc_id long, text string")

    line_dedup(texts(100)).collect()
    began = time.time()
    out = {r.doc_id: (len(r.deleted), r.deleted[:2]) for r in line_dedup(texts(100_000)).collect()}
    assert out == {1: (0, []), 2: (50_000, [1, 2])}
    assert time.time() - began < 120
