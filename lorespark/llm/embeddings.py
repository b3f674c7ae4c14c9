"""Embedding near-duplicates by sorted projection passes.

A pass orders the vectors by the concatenated signs of random projections and compares each with a bounded window of
its neighbours; the verified pairs of all passes are united. How much a window misses is measured: a linked vector is
within the window if it agrees in the bits that a vector shares with the end of its window, and one more. Passes go on,
with windows twice as wide each round, over the vectors for which the passes so far leave too great a chance of a
missed link or of which the last round has met new neighbours, so crowded places get more of them until, at last, a
window holds all vectors that are left.

Equal vectors take part once. As a window should not have to hold a large group of near copies, the passes run over
balls: vectors within half the link angle of a centre, which therefore all link with one another. Whether the members of
two balls link follows from the angles to the centres where these leave no doubt, and is computed for each remaining
pair of members, so no link that the passes lead to is lost or made up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.llm.shared import components, small_batches, written

#: Neighbours on each side in the first passes; passes in a round.
WINDOW, PASSES = 512, 4
#: Vectors with one key that are not yet looked through for balls; share of them that must join for another look.
CROWD, WORTHWHILE = 128, 0.05
#: Rows of a chunk, in windows.
_CHUNK = 4
#: Angles that differ by less are not told apart without computing the cosine itself.
_DOUBT = 1e-6


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    x = np.asarray(column.flatten(), float).reshape(-1, dimension)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _bits(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """For every 64 (or fewer) columns of planes a signed long that sorts like the string of signs."""
    signs = x @ planes > 0
    out = np.zeros(len(x), np.uint64)
    for i in range(planes.shape[1]):
        out |= signs[:, i].astype(np.uint64) << np.uint64(63 - i)
    return (out ^ np.uint64(1 << 63)).view(np.int64)


def _shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading bits in which keys agree."""
    differ = (a ^ b).view(np.uint64)
    high = differ >> np.uint64(32)
    top = np.where(high > 0, high, differ & np.uint64(0xFFFFFFFF)).astype(float)  # exact in double precision
    length = np.frexp(top)[1] + np.where(high > 0, 32, 0)
    return 64 - length


def cosine(a: str, b: str) -> Column:
    """Cosine of two array columns in double precision."""
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> double(x) * double(y)), 0D, (s, x) -> s + x) / sqrt(aggregate({a}, 0D, (s, x) -> s + double(x) * double(x)) * aggregate({b}, 0D, (s, x) -> s + double(x) * double(x)))")


def _angle(a: str, b: str) -> Column:
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine(a, b))))


def _balls(vectors: DataFrame, number: int, dimension: int, radius: float, seed: int) -> DataFrame:
    """(rid, centre) for (rid, vec): vectors with equal short keys join the ball of one of them, if it is near enough.

    Keys have as many bits as leave some sixteen of `number` vectors to a key, were they spread evenly. Keys with more
    than CROWD vectors are looked through again with other bits, as long as that gains something; a centre may find
    company in each round, while a vector joins once; what joins no ball is one of its own.
    """
    spark, kind = vectors.sparkSession, vectors.schema["vec"].dataType.simpleString()
    bits = max(1, min(60, math.ceil(math.log2(max(2, number) / 16))))

    def keyed(frame: DataFrame, k: int) -> DataFrame:
        planes = np.random.default_rng((seed, k)).normal(size=(dimension, bits))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(_bits(_matrix(b.column(1), dimension), planes))], ["rid", "vec", "key"])

        return frame.select("rid", "vec").mapInArrow(run, f"rid long, vec {kind}, key long")

    joined = spark.createDataFrame([], "rid long, centre long")
    centres, crowd, k = None, vectors, 0
    while True:
        now = keyed(crowd, k)
        crowded = written(now.groupBy("key").count().filter(F.col("count") > CROWD).select("key"), "ball-crowds")
        if crowded.isEmpty():
            break
        inside = written(now.join(crowded, "key"), "ball-keys")
        known = inside.withColumn("fresh", F.lit(1))
        if centres is not None:
            known = known.unionByName(keyed(centres, k).join(crowded, "key", "left_semi").withColumn("fresh", F.lit(0)))
        chosen = written(known.groupBy("key").agg(F.min(F.struct("fresh", F.xxhash64("rid", F.lit(k)).alias("at"), "rid", "vec")).alias("c")).select("key", F.col("c.fresh").alias("fresh"), F.col("c.rid").alias("centre"), F.col("c.vec").alias("middle")), "ball-centres")
        near = written(inside.join(chosen, "key").filter(F.col("rid") != F.col("centre")).filter(_angle("vec", "middle") <= radius).select("rid", "centre"), "balls")
        gained, looked = near.count(), inside.count()
        joined = joined.unionByName(near)
        new = near.select(F.col("centre").alias("rid")).distinct().join(chosen.filter("fresh = 1").select(F.col("centre").alias("rid"), F.col("middle").alias("vec")), "rid")
        centres = written(new if centres is None else centres.unionByName(new), "ball-middles")
        if gained < WORTHWHILE * looked:
            break
        crowd = written(inside.select("rid", "vec").join(near.select("rid").unionByName(centres.select("rid")), "rid", "left_anti"), "ball-free")
        k += 1
    grouped = joined if centres is None else joined.unionByName(centres.select("rid", F.col("rid").alias("centre")))
    alone = vectors.select("rid").join(grouped.select("rid"), "rid", "left_anti").withColumn("centre", F.col("rid"))
    return written(grouped.unionByName(alone), "ball-members")


def _band(key: np.ndarray, rid: np.ndarray, x: np.ndarray, slack: np.ndarray, reach: np.ndarray, first: int, angle: float, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places i < j, j from `first` on, at most window apart, whose vectors may link."""
    found = []
    for a in range(first, len(x), 256):
        b, low = min(a + 256, len(x)), max(0, a - window)
        bound = np.cos(np.minimum(angle + reach[a:b, None] + reach[None, low:b], np.pi)) - slack[a:b, None] - slack[None, low:b]
        j, i = np.nonzero(x[a:b] @ x[low:b].T >= bound)
        i, j = i + low, j + a
        ok = (i < j) & (j - i <= window)
        found.append((i[ok], j[ok]))
    return tuple(np.concatenate(f) for f in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 2


def _passes(todo: DataFrame, dimension: int, angle: float, window: int, seed: tuple[int, ...]) -> DataFrame:
    """PASSES passes over todo (rid, vec, reach): rows (a, b) of pairs that may link, a < b, and rows (a, null, pass, miss).

    miss is the chance that a link of a to one side is not found in that pass, by the place its window reached.
    """
    spark = todo.sparkSession

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dimension)
            for k in range(PASSES):
                planes = np.random.default_rng((*seed, k)).normal(size=(dimension, 64))
                n = len(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k, np.int32)), pa.array(_bits(x, planes)), batch.column(0)], ["pass", "key", "rid"])

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A byte a component, with the factor and the error of that."""
        for batch in batches:
            x = _matrix(batch.column(1), dimension)
            factor = np.abs(x).max(axis=1) / 127
            q = np.round(x / factor[:, None]).astype(np.int8)
            error = np.sqrt(np.square(x - q * factor[:, None]).sum(axis=1))
            column = pa.FixedSizeBinaryArray.from_buffers(pa.binary(dimension), len(x), [None, pa.py_buffer(q.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), column, pa.array(factor), pa.array(error), batch.column(2)], ["rid", "q", "factor", "error", "reach"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = todo.mapInArrow(keys, "pass int, key long, rid long").withColumn("at", F.xxhash64("rid", "pass"))
    order = order.repartitionByRange(parts, "pass", "key", "at").sortWithinPartitions("pass", "key", "at").drop("at")
    order = written(order.withColumn("row", F.monotonically_increasing_id()), "pass-order")
    part, before, starts = F.shiftright("row", 33), 0, []
    for r in order.groupBy(part.alias("part")).count().orderBy("part").collect():  # one row a partition
        starts += [F.lit(r["part"]), F.lit(before)]
        before += r["count"]
    place = F.create_map(*starts)[part] + F.col("row").bitwiseAND((1 << 33) - 1)
    size = _CHUNK * window
    chunk = F.floor(F.col("place") / size)
    # The last rows of a chunk are looked at from the next one too.
    chunks = F.when(F.pmod("place", F.lit(size)) >= size - window - 1, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    dealt = order.select("pass", "key", "rid", place.alias("place")).select("pass", "key", "rid", "place", F.explode(chunks).alias("chunk"))
    rows = dealt.join(written(todo.mapInArrow(small, "rid long, q binary, factor double, error double, reach double"), "pass-vectors"), "rid")

    def compare(key, t):
        t = t.sort_by("place").combine_chunks()
        passes, keys, rid, place, factor, error, reach = (t[c].to_numpy() for c in ("pass", "key", "rid", "place", "factor", "error", "reach"))
        x = np.frombuffer(b"".join(t["q"].to_pylist()), np.int8).reshape(-1, dimension).astype(np.float32) * factor[:, None].astype(np.float32)
        own = int(np.searchsorted(place, key[0].as_py() * size))
        out = [[], [], [], []]
        for k in np.unique(passes):  # a chunk may hold the end of one pass and the beginning of the next
            s = slice(*np.searchsorted(passes, [k, k + 1]))
            first = max(0, own - s.start)
            i, j = _band(keys[s], rid[s], x[s], error[s] + 1e-5, reach[s] + 1e-9, first, angle, window)
            u, v = rid[s][i], rid[s][j]
            out[0] += [np.minimum(u, v)]
            out[1] += [np.maximum(u, v)]
            out[2] += [np.full(len(u), k)]
            out[3] += [np.full(len(u), np.nan)]
            mine = np.arange(first, len(keys[s]))
            far = mine - window - 1
            shared = np.where(far >= 0, _shared_bits(keys[s][mine], keys[s][np.maximum(far, 0)]) + 1, 0)
            for ends, bits in ((mine, shared), (far[far >= 0], shared[far >= 0])):  # a window's end sees it from the other side
                out[0] += [rid[s][ends]]
                out[1] += [np.full(len(ends), -1)]
                out[2] += [np.full(len(ends), k)]
                out[3] += [1 - (1 - np.minimum(angle + reach[s][ends], np.pi) / np.pi) ** bits]
        a, b, of, miss = (np.concatenate(c) for c in out)
        return pa.table({"a": a, "b": pa.array(b, mask=b < 0), "pass": pa.array(of, pa.int32()), "miss": pa.array(miss, mask=b >= 0)})

    return written(rows.groupBy("chunk").applyInArrow(compare, "a long, b long, pass int, miss double"), "passes")


def _candidates(balls: DataFrame, dimension: int, angle: float, window: int, recall: float, seed: int) -> DataFrame:
    """(a, b), a < b, of balls (rid, vec, reach) that come near each other in some pass.

    A ball goes on to the next round if its windows leave too great a chance of a miss, or if this round has met more
    new neighbours of it than one would expect to be left.
    """
    spark = balls.sparkSession
    todo, n = balls, 0
    pairs, missed, met = spark.createDataFrame([], "a long, b long"), None, spark.createDataFrame([], "rid long, n long")
    while todo.count() > 1:
        found = _passes(todo, dimension, angle, window << n, (seed, 1, n))
        new = written(found.filter("b is not null").select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti"), "pass-pairs")
        pairs = pairs.unionByName(new)
        gained = new.select(F.col("a").alias("rid")).unionByName(new.select(F.col("b").alias("rid"))).groupBy("rid").agg(F.count(F.lit(1)).alias("new"))
        met = written(met.join(gained, "rid", "full").select("rid", (F.coalesce("n", F.lit(0)) + F.coalesce("new", F.lit(0))).alias("n"), F.coalesce("new", F.lit(0)).alias("new")), "pass-met")
        late = met.filter(F.col("new") > (1 - recall) * F.col("n")).select("rid")
        met = met.drop("new")
        miss = found.filter("b is null").groupBy(F.col("a").alias("rid"), "pass").agg(F.max("miss").alias("miss")).groupBy("rid").agg(F.product("miss").alias("miss"))
        if missed is not None:
            miss = miss.join(missed.withColumnRenamed("miss", "so_far"), "rid").select("rid", (F.col("miss") * F.col("so_far")).alias("miss"))
        missed = written(miss, "pass-missed")
        again = missed.filter(F.col("miss") > 1 - recall).select("rid").unionByName(late)
        todo = written(todo.join(again, "rid", "left_semi"), "pass-todo")
        n += 1
    return pairs


def _linked(good: DataFrame, dimension: int, least: float, window: int, recall: float, seed: int) -> DataFrame:
    """(rid, n_links, component) for distinct vectors (rid, vec, w) of one length, w being the rows that each stands for."""
    angle = math.acos(least)
    members = _balls(good.select("rid", "vec"), good.count(), dimension, angle / 2 - _DOUBT, seed)
    middle = good.select(F.col("rid").alias("centre"), F.col("vec").alias("middle"))
    placed = written(members.join(good, "rid").join(middle, "centre").withColumn("off", F.when(F.col("rid") == F.col("centre"), 0.0).otherwise(_angle("vec", "middle") + _DOUBT)).select("rid", "w", "centre", "vec", "off"), "ball-vectors")
    balls = written(placed.groupBy("centre").agg(F.sum("w").alias("size"), F.count(F.lit(1)).alias("kinds"), F.max("off").alias("reach")).join(middle, "centre"), "ball-list")
    found = _candidates(balls.select(F.col("centre").alias("rid"), F.col("middle").alias("vec"), "reach"), dimension, angle, window, recall, seed)
    side = lambda c: balls.select(F.col("centre").alias(c), F.col("size").alias(f"size_{c}"), F.col("kinds").alias(f"kinds_{c}"), F.col("reach").alias(f"reach_{c}"), F.col("middle").alias(f"vec_{c}"))
    pairs = found.join(side("a"), "a").join(side("b"), "b").withColumn("cos", cosine("vec_a", "vec_b"))
    apart = F.acos(F.least(F.lit(1.0), F.col("cos")))
    both = F.col("reach_a") + F.col("reach_b")
    verdict = F.when((F.col("kinds_a") == 1) & (F.col("kinds_b") == 1), F.when(F.col("cos") >= least, 1).otherwise(0)).when(apart + both + _DOUBT < angle, 1).when(apart - both - _DOUBT > angle, 0).otherwise(2)
    pairs = written(pairs.select("a", "b", "size_a", "size_b", verdict.alias("verdict")).filter("verdict > 0"), "ball-pairs")
    sure = pairs.filter("verdict = 1")
    whole = sure.select(F.col("a").alias("centre"), F.col("size_b").alias("n")).unionByName(sure.select(F.col("b").alias("centre"), F.col("size_a").alias("n")))
    # Of a doubtful pair each member is held against the other centre first, and then what is still in doubt against what is.
    doubt = pairs.filter("verdict = 2")
    ways = doubt.select("a", "b", F.col("a").alias("centre"), F.col("b").alias("to"), F.lit(0).alias("way")).unionByName(doubt.select("a", "b", F.col("b").alias("centre"), F.col("a").alias("to"), F.lit(1).alias("way")))
    against = ways.join(placed, "centre").join(balls.select(F.col("centre").alias("to"), "size", "reach", "middle"), "to").withColumn("gap", _angle("vec", "middle"))
    state = F.when(F.col("gap") + F.col("reach") + _DOUBT < angle, 1).when(F.col("gap") - F.col("reach") - _DOUBT > angle, 0).otherwise(2)
    against = written(against.select("a", "b", "way", "rid", "w", "vec", "size", state.alias("state")), "ball-doubts")
    # Linked with all of the other ball; for a doubtful member that includes those of the other ball that link with all of its own.
    all_of = against.filter("state = 1").groupBy("a", "b", "way").agg(F.sum("w").alias("n"))
    other = all_of.select("a", "b", (1 - F.col("way")).alias("way"), "n")
    some = against.filter("state = 2")
    left = some.filter("way = 0").select("a", "b", F.col("rid").alias("u"), F.col("w").alias("of_u"), F.col("vec").alias("p"))
    right = some.filter("way = 1").select("a", "b", F.col("rid").alias("v"), F.col("w").alias("of_v"), F.col("vec").alias("q"))
    direct = written(left.join(right, ["a", "b"]).filter(cosine("p", "q") >= least).select("a", "b", "u", "v", "of_u", "of_v"), "member-links")
    counts = [
        placed.join(placed.groupBy("centre").agg((F.sum("w") - 1).alias("n")), "centre").select("rid", "n"),
        placed.select("rid", "centre").join(whole.groupBy("centre").agg(F.sum("n").alias("n")), "centre").select("rid", "n"),
        against.filter("state = 1").select("rid", F.col("size").alias("n")),
        some.select("a", "b", "way", "rid").join(other, ["a", "b", "way"]).select("rid", "n"),
        direct.select(F.col("u").alias("rid"), F.col("of_v").alias("n")),
        direct.select(F.col("v").alias("rid"), F.col("of_u").alias("n")),
    ]
    every = counts[0]
    for c in counts[1:]:
        every = every.unionByName(c)
    links = written(every.groupBy("rid").agg(F.sum("n").alias("n_links")), "link-counts")
    joined = sure.select("a", "b").unionByName(all_of.select("a", "b")).unionByName(direct.select("a", "b")).distinct()
    groups = components(joined)
    of = placed.select("rid", "centre").join(groups.select(F.col("node").alias("centre"), "component"), "centre", "left").select("rid", F.coalesce("component", "centre").alias("component"))
    return links.join(of, "rid")


def near_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, window: int = WINDOW, recall: float = 0.99, seed: int = 3) -> DataFrame:
    """One row per row of table: id, n_links, component_id (smallest id reachable over links).

    Rows link when their cosine is at least `least`; equal vectors do. Vectors that are null, empty or zero, or hold
    null or non-finite components link with nothing, and those of different lengths not with one another; each length
    is gone through by itself. Rows that repeat an id are vectors of their own. No rows give no rows. Other columns are
    not read, whatever their names. Passes end for a vector when its windows give each of its links a probability of at
    least `recall` to have been met, and a round has added no more than 1 - recall to its neighbours. `recall` is an
    aim for each vector rather than a bound; the README has measured figures.
    """
    small_batches(table.sparkSession, 2000)
    precise = "double" if "double" in table.select(vector_col).schema[0].dataType.simpleString() else "float"
    vec = F.col(vector_col).cast(f"array<{precise}>")
    if precise == "double":  # squares of very large or small components would not be numbers
        size = F.array_max(F.transform(vec, F.abs))
        vec = F.when((size > 0) & (size < float("inf")), F.transform(vec, lambda x: x / size)).otherwise(vec)
    rows = written(table.select(F.col(id_col).alias("id"), vec.alias("vec")).withColumn("rid", F.monotonically_increasing_id()), "vectors")
    sound = F.col("vec").isNotNull() & F.expr("not exists(vec, x -> x is null or isnan(x) or abs(x) = float('inf'))") & F.expr("exists(vec, x -> x <> 0)")
    digest = [F.xxhash64("vec").alias("d"), F.xxhash64(F.lit(1), "vec").alias("e")]
    of = written(rows.filter(sound).select("rid", *digest), "vector-digests")
    first = written(rows.filter(sound).groupBy(*digest).agg(F.min(F.struct("rid", "vec")).alias("f"), F.count(F.lit(1)).alias("w")).select("d", "e", F.col("f.rid").alias("rid"), F.col("f.vec").alias("vec"), "w"), "distinct-vectors")
    out = None
    for r in first.groupBy(F.size("vec").alias("n")).count().orderBy("n").collect():  # one row a length
        part = _linked(first.filter(F.size("vec") == r["n"]).select("rid", "vec", "w"), r["n"], least, window, recall, seed)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    found = of.join(first.select("d", "e", F.col("rid").alias("of")), ["d", "e"]).join(out.withColumnRenamed("rid", "of"), "of").select("rid", "n_links", "component")
    named = written(rows.select("rid", "id").join(found, "rid", "left").select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", F.col("rid")).alias("component")), "vector-groups")
    least_id = named.groupBy("component").agg(F.min("id").alias("component_id"))
    return named.join(least_id, "component").select(F.col("id").alias(id_col), "n_links", "component_id")
