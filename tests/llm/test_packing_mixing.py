import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lorespark.llm.mixing import apply_copies, mix_sources
from lorespark.llm.packing import best_fit, crossover, cuts, evolve, least_bins, pack, pack_documents, sequences, token_ids


def test_ids_equal_those_of_tokenizers(spark, sf_dir):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + ["", " ", "a b c", "don't we'll ẞß 漢字 🙂🙂", "x" * 3000, "tab\t\tnew\n\n\nline  end  ", "1234567890 ½ Ⅷ"]
    for text in texts:
        assert token_ids(text, "byte_bpe_50k.json").tolist() == [*t.encode(text, add_special_tokens=False).ids, 0]


def test_cuts():
    assert cuts(5, 4) == [(0, 1), (1, 4)] and cuts(8, 4) == [(0, 4), (4, 4)] and cuts(3, 4) == [(0, 3)]


def checked(sizes, p, size):
    fill = np.bincount(p.bin_of, sizes)
    assert (fill == p.fill).all() and fill.max() <= size and fill.min() > 0 and len(p.bin_of) == len(sizes)


def test_genetic_packing():
    rng = np.random.default_rng(1)
    for sizes in (rng.integers(500, 1100, 600), rng.integers(1, 2048, 300), np.full(50, 1024), np.array([2047]), np.ones(5000, int)):
        first = best_fit(sizes, np.argsort(-sizes, kind="stable"), 2048)
        checked(sizes, first, 2048)
        p = evolve(sizes, [], 2048, 1)
        checked(sizes, p, 2048)
        assert least_bins(sizes, 2048) <= len(p.fill) <= len(first.fill)
        checked(sizes, crossover(rng, sizes, p, first, 2048), 2048)


def test_lower_bound_holds_for_the_best_packing():
    rng = np.random.default_rng(2)
    for _ in range(40):
        sizes = rng.integers(1, 11, 6)
        best = 6
        for code in range(6**6):
            bins = [code // 6**k % 6 for k in range(6)]
            if max(np.bincount(bins, sizes)) <= 10:
                best = min(best, len(set(bins)))
                if best == -(-sizes.sum() // 10):
                    break
        assert least_bins(sizes, 10) <= best


def test_packed_documents(spark, odd_docs, no_docs):
    out = pack_documents(odd_docs).collect()
    texts = sorted((r.text or "") for r in odd_docs.collect())
    spans = {}
    for r in out:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for s in spans.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048
    tokens = sum(len(token_ids(t, "byte_bpe_50k.json")) for t in texts)
    assert sum(r.length for r in out) == tokens
    assert pack_documents(no_docs).count() == 0
    whole = {r.sequence_id: len(r.ids) // 4 for r in sequences(pack_documents(odd_docs)).collect()}
    assert sum(whole.values()) == tokens


def test_islands_over_many_blocks(spark, monkeypatch):
    from lorespark.llm import packing

    monkeypatch.setattr(packing, "BLOCK", 40)
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 2049, 200)
    out = pack(spark.createDataFrame([(i, int(n)) for i, n in enumerate(sizes)], "rid long, length long")).collect()
    assert sorted(r.rid for r in out) == list(range(200))
    fill = {}
    for r in out:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + int(sizes[r.rid])
    assert max(fill.values()) <= 2048 and len(fill) < 1.2 * least_bins(sizes, 2048)


def test_crossover_beats_best_fit_decreasing():
    from lorespark.llm.packing import best_fit, evolve

    better = 0
    for seed in range(12):
        sizes = np.random.default_rng(seed).integers(300, 1100, 400)
        greedy = len(best_fit(sizes, np.argsort(-sizes, kind="stable"), 2048).fill)
        alone = evolve(sizes, [], 2048, seed)
        assert alone.generations >= 1 and least_bins(sizes, 2048) <= len(alone.fill) <= greedy
        better += len(alone.fill) < greedy
    assert better


def test_blocks_tell_what_the_genetic_part_gained(spark, monkeypatch):
    from lorespark.llm import packing

    monkeypatch.setattr(packing, "BLOCK", 40)
    sizes = np.random.default_rng(3).integers(300, 2049, 200)
    out = pack(spark.createDataFrame([(i, int(n)) for i, n in enumerate(sizes)], "rid long, length long")).collect()
    for block in {r.block for r in out if r.block is not None}:
        rows = [r for r in out if r.block == block]
        assert {r.bins for r in rows} == {len({r.sequence_id for r in rows})} and rows[0].bins <= rows[0].greedy_bins


def test_mix_of_many_blocks(spark):
    rows = [(i, "w " * (i % 23 + 1), f"s{'ab' if i % 3 else 'c'}") for i in range(3000)] + [(9000, "w " * 5000, "sc")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mix_sources(df).collect()
    again = {(r.doc_id, r.copies) for r in mix_sources(df).collect()}
    assert {(r.doc_id, r.copies) for r in out} == again and len(out) == len(rows)
    sums = {}
    for r in out:
        assert r.copies in (0, 1, 2)
        sums.setdefault(r.source, [0, r.target, r.source_size])[0] += r.copies * r.size
    total = sum(v[2] for v in sums.values())
    assert abs(sum(v[1] for v in sums.values()) - 1.5 * total) < 1e-6 * total
    largest = {s: max(r.size for r in out if r.source == s) for s in sums}
    for source, (taken, target, size) in sums.items():
        assert target <= 2 * size + 1e-6 and abs(taken - target) <= largest[source] / 2  # 11.5 and, for the source with one huge document, 2500


def test_expectations_are_kept(spark):
    sizes = (40, 40, 30, 20, 10, 10, 5, 5, 3, 1)
    rows = [(1000 * k + i, "w " * n, f"s{k:03}") for k in range(400) for i, n in enumerate(sizes)]
    out = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1,), share=0.6).collect()
    mean = [np.mean([r.copies for r in out if r.doc_id % 1000 == i]) for i in range(len(sizes))]
    assert np.allclose(mean, 0.6, atol=0.1)  # four standard deviations of 400 draws


def spark_hash(*values):
    """xxhash64() of ints (as (n,)) and longs."""
    p1, p2, p3, p4, p5, m = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5, (1 << 64) - 1
    rot = lambda x, r: (x << r | x >> (64 - r)) & m
    h = 42
    for v in values:
        if isinstance(v, tuple):
            h = (rot((h + p5 + 4) & m ^ (v[0] & 0xFFFFFFFF) * p1 & m, 23) * p2 + p3) & m
        else:
            h = (rot((h + p5 + 8) & m ^ rot((v & m) * p2 & m, 31) * p1 & m, 27) * p1 + p4) & m
        h = (h ^ h >> 33) * p2 & m
        h = (h ^ h >> 29) * p3 & m
        h ^= h >> 32
    return h


def plain_rounding(rows, p, seed):
    """Copies of (id, size): documents meet one after another, the largest first."""
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    order = sorted(rows, key=lambda r: (-r[1], signed(spark_hash((seed + 1,), *r))))
    left, out = [*order[0], p], {}
    for i, n in order[1:]:
        old_up, old_down, new_up, new_down = left[1] * (1 - left[2]), left[1] * left[2], n * (1 - p), n * p
        gain, loss = min(old_up, new_down), min(old_down, new_up)
        rises = (spark_hash((seed,), (0,), left[0], left[1], i, n) >> 11) / 2**53 * (gain + loss) < loss
        q, r = (left[2] + gain / left[1], p - gain / n) if rises else (left[2] - loss / left[1], p + loss / n)
        if (old_up <= new_down) if rises else (old_down <= new_up):
            out[left[0]], left = int(rises), [i, n, r]
        else:
            out[i], left[2] = int(not rises), q
    return out | {left[0]: int(left[2] >= 0.5)}


def test_one_block_equals_a_plain_run(spark):
    rng = np.random.default_rng(8)
    rows = [(i, int(n)) for i, n in enumerate(rng.integers(1, 90, 200))]
    out = mix_sources(spark.createDataFrame([(i, "w " * n, "s") for i, n in rows], "doc_id long, text string, source string"), share=0.37, seed=5).collect()
    assert {r.doc_id: r.copies for r in out} == plain_rounding(rows, 0.37, 5)


def test_water_level(spark):
    rows = [(1, "w " * 10, "a"), (2, "w " * 100, "b"), (3, "w " * 100, "c"), (4, "w " * 7, None)]
    out = {r.source: r.target for r in mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    # weights 3, 1, 2, 3: a and the null source stop at 20 and 14; the rest of 325.5 is dealt 1 to 2.
    assert {k: round(v, 6) for k, v in out.items()} == {"a": 20.0, None: 14.0, "b": round(291.5 / 3, 6), "c": round(583 / 3, 6)}


def test_odd_rows_are_mixed(odd_docs, no_docs):
    out = mix_sources(odd_docs).collect()
    assert len(out) == odd_docs.count() and all(r.copies <= 2 for r in out)
    assert mix_sources(no_docs).count() == 0 and apply_copies(no_docs, mix_sources(no_docs)).count() == 0
    mixed = mix_sources(odd_docs)
    copies = apply_copies(odd_docs, mixed)
    assert copies.columns == odd_docs.columns and copies.count() == sum(r.copies for r in mixed.collect())


def test_mixed_rows_keep_columns_with_any_name(spark):
    df = spark.createDataFrame([(1, "w w", "s", 5, 6, 7)], "doc_id long, text string, source string, id_of long, copies long, __n long")
    assert [tuple(r) for r in apply_copies(df, mix_sources(df)).collect()] == [(1, "w w", "s", 5, 6, 7)] * 2
