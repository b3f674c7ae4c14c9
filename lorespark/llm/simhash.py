"""SimHash near-duplicates, linked through BK-trees.

Fingerprints are sharded by what two of them must share: of 64 bits in `radius + 1` pieces one piece is equal, and of
the other bits in as many pieces again one more. Every shard gets a BK-tree, whose children are keyed by their integer
distance to the parent, and its fingerprints search it along the edges within the radius. A shard of more than
TREE_SIZE fingerprints is dealt out as several trees; each tree is sent to the fingerprints of every block of the
shard, so no task holds more than a tree and a block. A search yields links to one fingerprint per group found, never
all pairs of a group; groups are joined across shards afterwards.

Where texts of a given Jaccard similarity are wanted, some ten bits and more may differ, which no pieces can shard.
Shards are then bands of MinHashes, of which similar texts share one; their trees are searched at a wide radius, and
within the groups that this gives every link is verified on the shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lorespark.llm.shared import components, small_batches, text_or_empty, written

#: Fingerprints in one BK-tree, and in one block of those that search it.
TREE_SIZE = 2048
#: Fingerprints whose trees are built and searched together in a task.
_AT_ONCE = 40_000
#: Bands and MinHashes in each: at a similarity of 0.8, 0.9996 share a band. Bits that may then differ (some 10 are usual).
BANDS, ROWS, WIDE = 20, 5, 20
#: Texts in one block whose links are verified; a task holds two.
BLOCK = 1024


def shingles(text: bytes, words: int) -> list[bytes]:
    """Word shingles of a text, repeats included; A-Z is lower-cased and words end at white space."""
    w = text.lower().split()
    return [b" ".join(x) for x in zip(*(w[i:] for i in range(words)), strict=False)] if len(w) >= words else [b" ".join(w)] if w else []


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """64 bits, each 1 if it is set in more than half of the shingles' XXH64; 0 for a text without words."""
    h = np.fromiter(map(xxh64_intdigest, s := shingles(text, words), repeat(seed)), np.uint64, -1)
    if not len(s):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp): the fingerprint of each row as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x.as_buffer().to_pybytes(), words) for x in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["id", "fp"])

    small = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).cast("binary").alias("text"))
    return small.mapInArrow(run, "id long, fp long")


def _masks(radius: int) -> list[int]:
    """Masks of a piece of the 64 bits and a piece of the rest: two fingerprints within the radius agree under one."""
    n, masks = radius + 1, []
    cuts = [64 * i // n for i in range(n + 1)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        outer = [i for i in range(64) if not a <= i < b]
        for k in range(n):
            inner = outer[len(outer) * k // n : len(outer) * (k + 1) // n]
            masks.append(sum(1 << i for i in [*range(a, b), *inner]))
    return masks


class BKForest:
    """BK-trees of several shards at once. The first fingerprint of a shard is its root."""

    def __init__(self, shard: np.ndarray, fp: np.ndarray):
        order = np.lexsort((fp, shard))
        self.fp, shard = fp[order], shard[order]
        self.shards, roots = np.unique(shard, return_index=True)
        self.roots = roots
        at = np.repeat(roots, np.diff(np.append(roots, len(shard))))
        waiting = np.setdiff1d(np.arange(len(shard)), roots, assume_unique=True)
        keys, nodes = [], []
        while len(waiting):  # one level: of those that reach a node at one distance the first becomes its child
            node = at[waiting]
            key = node * 65 + np.bitwise_count(self.fp[waiting] ^ self.fp[node])
            _, first, back = np.unique(key, return_index=True, return_inverse=True)
            keys.append(key[first])
            nodes.append(waiting[first])
            at[waiting] = waiting[first][back]
            waiting = np.delete(waiting, first)
        keys, nodes = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, nodes))
        order = np.argsort(keys)
        self.edges, self.children = keys[order], nodes[order]

    def search(self, shard: np.ndarray, fp: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (position in fp, node) within the radius, level by level."""
        known = np.searchsorted(self.shards, shard)
        known = np.where(known < len(self.shards), known, 0)
        query = np.flatnonzero(self.shards[known] == shard) if len(self.shards) else np.zeros(0, np.int64)
        node = self.roots[known[query]]
        while len(query):
            d = np.bitwise_count(fp[query] ^ self.fp[node]).astype(np.int64)
            hit = d <= radius
            yield query[hit], node[hit]
            low = np.searchsorted(self.edges, node * 65 + np.maximum(d - radius, 1))
            n = np.searchsorted(self.edges, node * 65 + np.minimum(d + radius, 64), side="right") - low
            query = np.repeat(query, n)
            node = self.children[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - low, n)]


def _least(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Of each of n nodes the least node that the links a-b lead to."""
    label = np.arange(n)
    while True:
        new = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _linked(shard: np.ndarray, role: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints that share a shard: role 1 is in the tree, 2 searches, 3 does both."""
    in_tree, asks = (role & 1) > 0, np.flatnonzero(role & 2)
    tree = BKForest(shard[in_tree], fp[in_tree])
    names = np.unique(fp)
    label = np.arange(len(names))
    spot = np.searchsorted(names, tree.fp)
    step = 4096 if radius < 8 else 512
    for i in range(0, len(asks), step):
        part = asks[i : i + step]
        found = [(np.searchsorted(names, fp[part[q]]), spot[n]) for q, n in tree.search(shard[part], fp[part], radius)]
        a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int))
        label = _least(np.concatenate([a, np.arange(len(names))]), np.concatenate([b, label]), len(names))
    far = label != np.arange(len(names))
    return names[far], names[label[far]]


def _key(radius: int, fp: Column) -> Column:
    return F.explode(F.array(*(F.struct(F.lit(i).alias("piece"), fp.bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("bits")) for i, m in enumerate(_masks(radius)))))


def linked_fingerprints(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (a, b) of fingerprints fp (distinct) whose components are those of all pairs within the radius."""
    return _linked_in_shards(fps.select("fp", _key(radius, F.col("fp")).alias("k")).select("fp", "k.*"), radius)


def _linked_in_shards(keyed: DataFrame, radius: int) -> DataFrame:
    """keyed: distinct (fp, piece, bits), with a shard for each piece and bits."""
    crowds = written(keyed.groupBy("piece", "bits").count().filter("count > 1").withColumn("blocks", F.ceil(F.col("count") / TREE_SIZE).cast("int")).drop("count"), "bk-shards")
    members = keyed.join(crowds, ["piece", "bits"])
    block = F.when(F.col("blocks") == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    pairs = F.when(
        F.col("blocks") == 1, F.array(F.struct(F.lit(0).alias("tree"), F.lit(0).alias("block"), F.lit(3).alias("role")))
    ).otherwise(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, F.col("own")).alias("tree"), F.greatest(j, F.col("own")).alias("block"), F.when(j == F.col("own"), 3).when(j > F.col("own"), 1).otherwise(2).alias("role"))))
    dealt = members.withColumn("own", block).select("fp", "piece", "bits", F.explode(pairs).alias("p")).select(F.xxhash64("piece", "bits", "p.tree", "p.block").alias("shard"), F.col("p.role").alias("role"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[np.ndarray]) -> pa.RecordBatch:
            shard, role, fp = rows
            a, b = _linked(shard, role, fp.view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        held: list[list[np.ndarray]] = []
        for batch in batches:
            held.append([batch.column(i).to_numpy() for i in range(3)])
            if sum(len(x[0]) for x in held) >= _AT_ONCE:
                rows = [np.concatenate(x) for x in zip(*held, strict=True)]
                cut = int(np.searchsorted(rows[0], rows[0][-1]))  # rows come sorted by shard; the last may go on
                if cut:
                    yield out([x[:cut] for x in rows])
                held = [[x[cut:] for x in rows]]
        if held:
            yield out([np.concatenate(x) for x in zip(*held, strict=True)])

    return dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """One row per row of docs: id, fp, component_id: the smallest id reachable over links of at most radius bits.

    Null counts as empty; texts without words have fingerprint 0, which links like any other. Texts with fewer words
    than a shingle count as one shingle. Ids are integers; a null id is never the smallest unless all are null. Rows
    with equal texts or ids each get a row; no rows give no rows. Other columns are not read.
    """
    of_doc = written(simhash(docs, id_col, text_col, words), "simhash")
    fps = written(of_doc.groupBy("fp").agg(F.min("id").alias("first")), "fingerprints")
    groups = written(components(written(linked_fingerprints(fps.select("fp"), radius), "bk-links")), "simhash-groups")
    named = fps.join(groups, fps["fp"] == groups["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    first = written(named.groupBy("component").agg(F.min("first").alias("component_id")), "simhash-first")
    named = written(named.select("fp", "component").join(first, "component").select("fp", "component_id"), "simhash-named")
    return of_doc.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def sketch(text: bytes, words: int, seed: int = 42) -> tuple[np.ndarray, int, int, np.ndarray]:
    """The distinct shingles' hashes in order, a hash of all of them, their SimHash, and a hash of each band of MinHashes."""
    h = np.unique(np.fromiter(map(xxh64_intdigest, s := shingles(text, words), repeat(seed)), np.uint64, len(s)))
    if not len(h):
        return h, 0, 0, np.zeros(0, np.uint64)
    ones, least = np.zeros(64, np.int64), np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), 1 << 12):
        part = h[i : i + (1 << 12)]
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        least = np.minimum(least, (part * _FACTORS).min(axis=1))
    bands = [xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(least.reshape(BANDS, ROWS))]
    return h, xxh64_intdigest(h.tobytes(), seed), int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big"), np.array(bands, np.uint64)


_FACTORS = np.random.default_rng(7).integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)


def _similar(fp: np.ndarray, sets: list[np.ndarray], asks: np.ndarray, tree: np.ndarray, similarity: float) -> np.ndarray:
    """Of each text the least place in its group, by links between asks and tree of at least that Jaccard similarity."""
    label, size = np.arange(len(fp)), np.array([len(x) for x in sets])
    for i in asks.tolist():
        near = (np.bitwise_count(fp[tree] ^ fp[i]) <= WIDE) & (np.minimum(size[tree], size[i]) >= similarity * np.maximum(size[tree], size[i]))
        for j in tree[near].tolist():
            if label[i] != label[j]:
                same = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if same >= similarity * (size[i] + size[j] - same):
                    a, b = sorted((label[i], label[j]))
                    label[label == b] = a
    return label


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per row of docs: id, digest (XXH64 of the text), component_id, kept.

    component_id is the smallest id reachable over links of at least that Jaccard similarity of the word shingles. Of
    each component the rows with the first id (null last) and then the least digest are kept; rows that agree in both
    are all kept or not, so that a caller chooses among them. Texts without words make up one group; null counts as
    empty; texts with fewer words than a shingle count as one. Very long texts are read whole, a row at a time; ties
    cannot occur. Ids are integers, and may be null, repeat, or stand at different texts. No rows give no rows; other
    columns are not read, whatever their names.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [sketch(x.as_buffer().to_pybytes(), words)[1:] for x in b.column(1)]
            of, fp = (np.array([r[k] for r in rows], np.uint64).view(np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(of), pa.array(fp), pa.array([r[2].view(np.int64) for r in rows], pa.list_(pa.int64()))], ["id", "at", "node", "fp", "bands"])

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([sketch(x.as_buffer().to_pybytes(), words)[0].tobytes() for x in b.column(b.num_columns - 1)], pa.binary())], ["node", "fp", "crowd", "shingles"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            role, node = np.array([r[1] for r in rows]), np.array([r[2] for r in rows], np.int64)
            label = _similar(np.array([r[3] for r in rows], np.int64).view(np.uint64), [np.frombuffer(r[4], np.uint64) for r in rows], np.flatnonzero(role & 2), np.flatnonzero(role & 1), similarity)
            far = label != np.arange(len(label))
            return pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(node[label[far]])], ["a", "b"])

        rows: list[tuple] = []
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if rows and r[0] != rows[0][0]:
                    yield out(rows)
                    rows = []
                rows.append(r)
        if rows:
            yield out(rows)

    small = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).cast("binary").alias("text"))
    of_text = F.struct(F.xxhash64("text").alias("digest"), F.coalesce("id", F.lit(-1)).alias("row"))
    of_doc = written(small.select("id", "text", of_text.alias("at")).mapInArrow(run, "id long, at struct<digest: long, row: long>, node long, fp long, bands array<long>"), "sketches")
    keyed = of_doc.select("fp", F.posexplode("bands").alias("piece", "bits")).distinct()
    crowds = written(components(written(_linked_in_shards(keyed, WIDE), "wide-links")), "crowds")
    # Of the texts with one set of shingles one goes on, found again by its digest and id.
    lead = F.struct(F.col("id").isNull().alias("none"), "id", "at.digest")
    first = of_doc.groupBy("node").agg(F.min("id").alias("id"), F.min("at").alias("at"), F.min("fp").alias("fp"), F.min(lead).alias("lead"))
    named = written(first.join(crowds.select(F.col("node").alias("fp"), "component"), "fp", "left").select("node", "id", "at", "fp", "lead", F.coalesce("component", "fp").alias("crowd")), "crowd-texts")
    sizes = named.filter("node <> 0").groupBy("crowd").count().filter("count > 1").select("crowd", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    chosen = named.filter("node <> 0").join(sizes, "crowd").select("node", "fp", "crowd", "at.*")
    texts = small.select(of_text.alias("at"), "text").select("at.*", "text").join(chosen, ["digest", "row"]).select("node", "fp", "crowd", "text")
    sets = written(texts.mapInArrow(held, "node long, fp long, crowd long, shingles binary"), "crowd-shingles").join(sizes, "crowd").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, F.col("own")).alias("tree"), F.greatest(j, F.col("own")).alias("block"), F.when(j == F.col("own"), 3).when(j > F.col("own"), 1).otherwise(2).alias("role")))
    dealt = sets.select("node", "fp", "crowd", "shingles", F.explode(pairs).alias("p")).select(F.xxhash64("crowd", "p.tree", "p.block").alias("shard"), F.col("p.role").alias("role"), "node", "fp", "shingles")
    edges = written(dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(verified, "a long, b long").filter("a <> b").distinct(), "similar-links")
    groups = written(components(edges), "similar-groups").withColumnRenamed("node", "of")
    grouped = named.join(groups, named["node"] == groups["of"], "left").select("node", "id", "lead", F.coalesce("component", "node").alias("component"))
    least = grouped.groupBy("component").agg(F.min("id").alias("component_id"), F.min("lead").alias("lead"))
    ends = written(grouped.select("node", "component").join(least, "component").select("node", "component_id", "lead"), "similar-named")
    kept = F.col("id").eqNullSafe(F.col("lead.id")) & (F.col("at.digest") == F.col("lead.digest"))
    return of_doc.join(ends, "node").select(F.col("id").alias(id_col), F.col("at.digest").alias("digest"), "component_id", kept.alias("kept"))
