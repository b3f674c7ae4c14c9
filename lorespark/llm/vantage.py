"""Hard negatives by vantage-point trees over norm-augmented vectors.

Inner products become distances: a vector x gets one more component, the root of M^2 - |x|^2 for a bound M on all norms,
and a query q gets a zero there, so |q - x|^2 = |q|^2 + M^2 - 2 q.x. The highest scores are the nearest vectors, and a
window of scores is an annulus around the query. A traversal leaves out the nodes of a tree beyond the annulus on either
side, takes the leaves of the others nearest first by the least distance that their bounds allow, and ends when it has k
vectors nearer than any leaf that is left; the queries of a block go through a tree together. Scores are integers and
computed exactly; distances only order and prune, with room for rounding.

The top of the tree is fitted on a bounded sample and routes every row to a region; regions are cut into shards of
bounded size by a hash, and a task builds the tree of a shard and searches it for a block of queries. A query first goes
to the regions nearest to its annulus. Then it goes to each other region whose bounds allow a better result than the
k-th found, so results are exact; how many these are depends on the vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.llm.shared import small_batches, written

#: Rows of a shard and queries of a block, on average; vectors in a leaf.
SHARD, BLOCK, LEAF = 4096, 2048, 64
#: Rows of the sample that the top of the tree is fitted on, at most; its regions, at most; regions of the first search.
SAMPLE, REGIONS, FIRST = 16_384, 256, 2
#: Share of distances that rounding may take; among others that of the root of M^2 - |x|^2 where it is near zero.
_ROOM = 1e-7
_FREE, _NONE = 1 << 62, -(1 << 63) + 1


def quantised(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(256.0) * x.cast("double")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of long lists, with zeros after the end of shorter ones."""
    ends = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if (ends == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < ends[:, None]] = flat
    return out


def _augmented(x: np.ndarray, bound: float) -> np.ndarray:
    x = x.astype(float)
    return np.column_stack([x, np.sqrt(np.maximum(bound - np.einsum("ij,ij->i", x, x), 0))])


class VPTree:
    """A vantage-point tree. Of each node, by number: its vantage point and children, or its rows if it is a leaf."""

    def __init__(self, points: np.ndarray, leaf: int, most: int | None = None):
        self.vantage: list[np.ndarray | None] = []
        self.rows: list[np.ndarray | None] = []
        self.children: list[tuple[int, int]] = []
        self.near: list[tuple[float, float]] = []  # bounds of the distances of a node's rows to its parent's vantage point
        self._grow(points, leaf, most)

    def _grow(self, points: np.ndarray, leaf: int, most: int | None) -> None:
        waiting = [(np.arange(len(points)), (0.0, math.inf))]
        leaves = 1
        place = 0
        while place < len(waiting):  # breadth first, so that the largest nodes are cut first
            rows, bounds = waiting[place]
            self.near.append(bounds)
            self.vantage.append(None)
            self.children.append((-1, -1))
            self.rows.append(rows)
            if len(rows) > leaf and (most is None or leaves < most):
                start = points[rows[len(rows) // 2]]
                far = points[rows[np.argmax(((points[rows] - start) ** 2).sum(1))]]  # a point at the edge cuts best
                d = np.sqrt(((points[rows] - far) ** 2).sum(1))
                border = float(np.median(d))
                inner = d < border
                if inner.any():
                    self.vantage[place], self.rows[place] = far, None
                    self.children[place] = (len(waiting), len(waiting) + 1)
                    for part in (inner, ~inner):
                        waiting.append((rows[part], (float(d[part].min()), float(d[part].max()))))
                    leaves += 1
            place += 1

    def nearest_first(self, q: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(queries, rows): the leaves that may hold points of the queries' annuli, for each query the nearest first.

        The caller lowers outer as it finds what it wants; leaves beyond that are left out.
        """
        leaves, low, high = self._bounds(q)
        near = np.where((low <= outer[:, None]) & (high >= inner[:, None]), low, np.inf)
        order = np.argsort(near, axis=1, kind="stable")
        for place in order.T:
            distance = near[np.arange(len(q)), place]
            go = np.flatnonzero((distance <= outer) & (distance < np.inf))
            if not len(go):
                return
            go = go[np.argsort(place[go], kind="stable")]
            cuts = np.flatnonzero(np.diff(place[go])) + 1
            for part in np.split(go, cuts):
                yield part, self.rows[leaves[place[part[0]]]]

    def _bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Leaves, and for each query the least and the greatest distance that their points can have."""
        inner_nodes = [i for i, v in enumerate(self.vantage) if v is not None]
        low, high = np.zeros((len(q), len(self.rows))), np.full((len(q), len(self.rows)), math.inf)
        if inner_nodes:
            v = np.array([self.vantage[i] for i in inner_nodes])
            d = np.sqrt(np.maximum((q**2).sum(1)[:, None] + (v**2).sum(1) - 2.0 * (q @ v.T), 0))
            for node, of_node in zip(inner_nodes, d.T, strict=True):
                for child in self.children[node]:
                    a, b = self.near[child]
                    room = _ROOM * (1.0 + of_node + b)
                    low[:, child] = np.maximum(low[:, node], np.maximum(a - of_node, of_node - b) - room)
                    high[:, child] = np.minimum(high[:, node], of_node + b + room)
        leaves = np.array([i for i, v in enumerate(self.vantage) if v is None])
        return leaves, low[:, leaves], high[:, leaves]

    def regions(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point; those on a border go out."""
        at = np.zeros(len(points), np.int64)
        for node, vantage in enumerate(self.vantage):
            if vantage is not None:
                here = np.flatnonzero(at == node)
                d = np.sqrt(((points[here] - vantage) ** 2).sum(1))
                a, b = self.children[node]
                at[here] = np.where(d < self.near[b][0], a, b)
        return at

    def reach(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Leaves, and for each query the least and the greatest distance that any point routed there can have."""
        low, high = np.zeros((len(q), len(self.rows))), np.full((len(q), len(self.rows)), math.inf)
        for node, vantage in enumerate(self.vantage):
            if vantage is not None:
                d = np.sqrt(((q - vantage) ** 2).sum(1))
                inner, outer = self.children[node]
                border = self.near[outer][0]
                room = _ROOM * (1.0 + d + border)
                low[:, inner], high[:, inner] = np.maximum(low[:, node], d - border - room), np.minimum(high[:, node], d + border + room)
                low[:, outer], high[:, outer] = np.maximum(low[:, node], border - d - room), high[:, node]
        leaves = np.array([i for i, v in enumerate(self.vantage) if v is None])
        return leaves, low[:, leaves], high[:, leaves]


class _Index:
    """All rows (vid, label, v: long array), routed to shards, and what a search of them needs."""

    def __init__(self, rows: DataFrame, sample: int, regions: int, shard: int):
        self.spark = rows.sparkSession
        norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
        n, bound, width = rows.agg(F.count(F.lit(1)), F.max(norm), F.max(F.size("v"))).first()
        self.count, self.bound, self.width = n, (bound or 0.0) * (1 + 1e-12), width or 0
        if not n:
            return
        share = F.pmod(F.xxhash64("vid", "label", "v"), F.lit(1 << 20)) < max(1, (sample << 20) // max(n, sample))
        some = rows.filter(share).select("v").orderBy(F.xxhash64("v")).limit(sample).toArrow() if n > shard else None
        points = _augmented(_matrix(some.column(0).combine_chunks(), self.width), self.bound) if some is not None and some.num_rows else np.zeros((1, self.width + 1))
        want = min(regions, -(-n // shard))
        self.top = top = VPTree(points, max(1, len(points) // max(1, 4 * want)), want)
        bound, width = self.bound, self.width
        small_batches(self.spark)

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = top.regions(_augmented(_matrix(b.column(2), width), bound))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at)], ["vid", "label", "v", "region"])

        routed = written(rows.select("vid", "label", "v").mapInArrow(route, "vid long, label long, v array<long>, region long"), "vp-routed")
        sizes = routed.groupBy("region").count().select("region", F.ceil(F.col("count") / shard).cast("int").alias("pieces"))
        self.pieces = written(sizes, "vp-regions")
        piece = F.pmod(F.xxhash64("vid", "label", "v"), F.col("pieces")).cast("int")
        self.rows = written(routed.join(F.broadcast(self.pieces), "region").select("vid", "label", "v", "region", piece.alias("piece")), "vp-rows")  # at most REGIONS rows are broadcast

    def aims(self, queries: DataFrame, first: int | None) -> DataFrame:
        """queries (qid, v, low, high, worst) with the regions to search: the first nearest ones, or all others that may have better than worst."""
        top, bound, width = self.top, self.bound, self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                q = _matrix(b.column(1), width).astype(float)
                norms = np.einsum("ij,ij->i", q, q) + bound
                leaves, least, most = top.reach(np.column_stack([q, np.zeros(len(q))]))
                low, high, worst = (b.column(c).to_numpy().astype(float) for c in (2, 3, 4))
                inner, outer, limit = (np.sqrt(np.maximum(norms - 2.0 * x, 0)) for x in (high, low, np.maximum(low, worst)))
                near = np.where((least <= outer[:, None] * (1 + _ROOM)) & (most >= inner[:, None] * (1 - _ROOM)), np.maximum(least, inner[:, None]), np.inf)
                order = np.argsort(near, axis=1, kind="stable")
                now = np.take_along_axis(near, order, 1) < np.inf
                if first is None:  # what the first search has left, as far as its k-th score leaves room
                    now &= np.take_along_axis(least, order, 1) <= limit[:, None] * (1 + _ROOM)
                    now[:, :FIRST] = False
                else:
                    now[:, first:] = False
                qid, place = np.nonzero(now)
                near = leaves[order[qid, place]]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(qid)), pa.array(near)], ["qid", "region"])

        small_batches(self.spark)
        return queries.select("qid", "v", "low", "high", "worst").mapInArrow(run, "qid long, region long")

    def hits(self, queries: DataFrame, first: int | None, k: int, same: bool, block: int) -> DataFrame:
        """(qid, vid, score): the first k rows of each region searched for each query."""
        aims = written(self.aims(queries, first), "vp-aims").join(F.broadcast(self.pieces), "region")
        blocks = written(aims.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")), "vp-blocks")
        asked = aims.join(F.broadcast(blocks), "region").withColumn("block", F.pmod(F.xxhash64("qid", "region"), F.col("blocks")).cast("int"))
        asked = asked.select("qid", "region", "block", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece")).join(queries, "qid")
        there = self.rows.join(F.broadcast(blocks), "region").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        bound, width = self.bound, self.width

        def find(rows: pa.Table, asks: pa.Table) -> pa.Table:
            none = pa.table([pa.array([], pa.int64())] * 3, ["qid", "vid", "score"])
            if not rows.num_rows or not asks.num_rows:
                return none
            rows = rows.sort_by("vid")  # of equal scores in a leaf the smaller id comes first
            x, q = (_matrix(t.column("v").combine_chunks(), width) for t in (rows, asks))
            vid, label = (rows.column(c).to_numpy() for c in ("vid", "label"))
            qid, own, of, low, high, worst = (asks.column(c).to_numpy() for c in ("qid", "own", "label", "low", "high", "worst"))
            tree = VPTree(_augmented(x, bound), LEAF)
            base = (q.astype(float) ** 2).sum(1) + bound
            least = np.maximum(low, worst)  # scores below are of no use any more
            inner, outer = (np.sqrt(np.maximum(base - 2.0 * s, 0)) * (1 + sign * _ROOM) for s, sign in ((high.astype(float), -1), (least.astype(float), 1)))
            score, found = np.full((len(q), k), _NONE), np.zeros((len(q), k), np.int64)
            points = np.column_stack([q.astype(float), np.zeros(len(q))])
            if float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, width) < 2.0**53:
                x, q = x.astype(float), q.astype(float)  # exact, and much faster
            for asking, leaf in tree.nearest_first(points, inner, outer):
                s = (q[asking] @ x[leaf].T).astype(np.int64)
                other = label[leaf] != of[asking, None]
                fits = (s >= least[asking, None]) & (s <= high[asking, None]) & (~other & (vid[leaf] != own[asking, None]) if same else other)
                hit = fits.any(axis=1)
                asking, s = asking[hit], np.where(fits[hit], s[hit], _NONE)
                if len(asking):
                    all_s, all_v = np.column_stack([score[asking], s]), np.column_stack([found[asking], np.broadcast_to(vid[leaf], s.shape)])
                    best = np.lexsort((all_v, -all_s), axis=1)[:, :k]
                    score[asking], found[asking] = np.take_along_axis(all_s, best, 1), np.take_along_axis(all_v, best, 1)
                    least[asking] = np.maximum(least[asking], score[asking, -1])
                    outer[asking] = np.sqrt(np.maximum(base[asking] - 2.0 * least[asking], 0)) * (1 + _ROOM)
            i, j = np.nonzero(score > _NONE)
            return pa.table([pa.array(qid[i]), pa.array(found[i, j]), pa.array(score[i, j])], ["qid", "vid", "score"])

        keys = ["region", "piece", "block"]
        return there.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(find, "qid long, vid long, score long")

    def search(self, queries: DataFrame, k: int, same: bool, block: int) -> DataFrame:
        """(qid, vid, score, rank): the first k rows for each query, by score and then vid.

        queries: (qid, own, label, v, low, high); same: rows of the query's label but for own itself, else of other
        labels. Both searches keep equal scores, so ties are broken over all regions.
        """
        order = Window.partitionBy("qid").orderBy(F.desc("score"), F.col("vid"))

        def firsts(hits: DataFrame) -> DataFrame:
            return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

        near = written(firsts(self.hits(queries.withColumn("worst", F.lit(-_FREE)), FIRST, k, same, block)), "vp-near")
        worst = near.filter(F.col("rank") == k).select("qid", F.col("score").alias("worst"))
        again = written(queries.join(worst, "qid", "left").withColumn("worst", F.coalesce("worst", F.lit(-_FREE))), "vp-again")
        return written(firsts(near.drop("rank").unionByName(self.hits(again, None, k, same, block))), "vp-found")


def hard_negatives(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", anchors: Column | None = None,
    positives: int = 5, k: int = 10, low: int = 30, high: int = 90, sample: int = SAMPLE, regions: int = REGIONS, shard: int = SHARD, block: int = BLOCK,
) -> DataFrame:
    """For each anchor and each of its first positives the first k rows of other labels that score from low to high percent of the positive.

    A component counts as floor(256 x), a score is the integer inner product with the anchor; higher scores come first,
    ties by smaller id, null ids last. anchors tells which rows are anchors, by default those whose id is divisible by
    100; positives are other rows of the anchor's label. Returns anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score. Rows with a null label or vector, or a null or non-finite component, take no part.
    Rows that agree in id, label and vector count as one; rows that agree in the id alone are rows of their own, in the
    order of label and vector. Labels and ids are integers.
    Vectors may differ in length: shorter ones count as if zeros followed. Percentages of negative scores leave an
    empty window. No rows give no rows; other columns are not read. Results are exact; `sample` rows at most fit the top
    of the tree, which only decides where rows are put.
    """
    spark = vectors.sparkSession
    usable = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    ids = F.col(id_col).cast("long")
    picked = (ids % 100 == 0) if anchors is None else anchors
    rows = vectors.filter(F.col(label_col).isNotNull() & F.col(vec_col).isNotNull() & usable)
    rows = written(rows.select(ids.alias("id"), F.col(label_col).cast("long").alias("label"), quantised(F.col(vec_col)).alias("v"), F.coalesce(picked, F.lit(False)).alias("anchor")), "vp-vectors")
    plain = rows.groupBy("id").count().filter("count > 1 or id is null").isEmpty()
    if plain:
        named = rows.withColumn("vid", F.col("id"))
    else:  # rows are known by their place in the order of ids, so that ties within an id are broken too
        once = rows.groupBy("id", "label", "v").agg(F.max("anchor").alias("anchor")).orderBy(F.col("id").asc_nulls_last(), "label", "v")
        named = written(once.withColumn("vid", F.monotonically_increasing_id()), "vp-named")
    index = _Index(named, sample, regions, shard)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    if not index.count:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    asks = written(named.filter("anchor").select(F.col("vid").alias("qid"), F.col("vid").alias("own"), "label", "v", F.lit(-_FREE).alias("low"), F.lit(_FREE).alias("high")), "vp-anchors")
    found = index.search(asks, positives, True, block).select(F.col("qid").alias("own"), F.col("vid").alias("positive"), F.col("score").alias("positive_score"))
    # Scores between low and high percent, in whole numbers.
    window = [F.ceil(F.expr(f"{low} * cast(positive_score as decimal(38, 0)) / 100")).cast("long").alias("low"), F.floor(F.expr(f"{high} * cast(positive_score as decimal(38, 0)) / 100")).cast("long").alias("high")]
    pairs = written(asks.select("own", "label", "v").join(found, "own").withColumn("qid", F.monotonically_increasing_id()).select("qid", "own", "label", "v", "positive", "positive_score", *window), "vp-windows")
    mined = index.search(pairs.filter("low <= high").drop("positive", "positive_score"), k, False, block)
    out = mined.join(pairs.select("qid", "own", "positive", "positive_score"), "qid").select(F.col("own").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("vid").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    if plain:
        return out.select(*names)
    ids = written(named.select("vid", "id"), "vp-ids")
    for name in ("anchor_id", "positive_id", "negative_id"):
        out = out.join(ids.withColumnsRenamed({"vid": name, "id": f"{name}_of"}), name).drop(name).withColumnRenamed(f"{name}_of", name)
    return out.select(*names)
