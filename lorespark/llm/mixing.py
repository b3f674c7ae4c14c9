"""Mixing sources to target weights by pivotal dependent rounding.

A source's share of words gives each of its documents the same expected number of copies. The whole part is sure; the
fraction is rounded so that the words taken stay what they were: of two documents with fractions one gains words that
the other loses, in a random direction that keeps both expectations, until one of them has a whole number of copies.
Blocks of documents are folded so, large ones first, and what is left of each block goes up a tree of blocks until one
document of the source is left, which alone is rounded to the nearer number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.llm.shared import WORD, let, spare, text_or_empty, written

#: Documents in a block of the reduction tree, on average at the leaves and at most above.
FAN_IN = 512


def word_count(name: str = "text") -> Column:
    return F.regexp_count(text_or_empty(name), F.lit(WORD)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """Number the sources from 0 by code point, null last, without bringing them into one task."""
    ordered = written(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("row", F.monotonically_increasing_id()), "mix-order")
    part = F.shiftright("row", 33)
    before, starts = 0, []
    for r in ordered.groupBy(part.alias("part")).count().orderBy("part").collect():  # one row per partition
        starts += [F.lit(r["part"]), F.lit(before)]
        before += r["count"]
    start = F.create_map(*starts)[part] if starts else F.lit(0)
    return ordered.withColumn("rank", start + F.col("row").bitwiseAND((1 << 33) - 1)).drop("row")


def source_targets(units: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, units, source_size, target): share of all words by weight; a target stops at `most` times its source's size and the excess goes to the others by weight."""
    sums = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count(F.lit(1)).alias("units"))
    table = _ranked(sums)
    weight = F.array(*map(F.lit, weights))[F.pmod(F.col("rank"), F.lit(len(weights))).cast("int")]
    table = written(table.withColumn("weight", weight).withColumn("cap", most * F.col("source_size")), "mix-sources")
    total = (table.agg(F.sum("source_size")).first()[0] or 0) * share
    level, above = 0.0, -1
    while True:
        over = F.col("cap") < level * F.col("weight")
        n, capped, rest = table.agg(F.count_if(over), F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("weight")))).first()
        if n == above or not rest:
            break
        above, level = n, (total - (capped or 0)) / rest
    return table.select("source", "units", "source_size", F.least(F.col("cap"), level * F.col("weight")).alias("target"))


def _fold(items: Column, seed: int, level: int) -> Column:
    """Fold an array of (id, size, words, p) to (left, done): one item left over, and those rounded, with up 0 or 1."""
    kind = "id bigint, size bigint, rows bigint, words double, p double"

    def item(x: Column, p: Column) -> Column:
        return F.struct(*(x[k].alias(k) for k in ("id", "size", "rows", "words")), p.alias("p"))

    def settled(x: Column, up: Column) -> Column:
        return F.array(F.struct(*(x[k].alias(k) for k in ("id", "size", "rows")), up.cast("int").alias("up")))

    def pair(state: Column, new: Column) -> Column:
        old = state["left"]
        room = F.struct(
            (old["words"] * (1 - old["p"])).alias("old_up"), (old["words"] * old["p"]).alias("old_down"), (new["words"] * (1 - new["p"])).alias("new_up"), (new["words"] * new["p"]).alias("new_down"),
            (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(level), old["id"], old["size"], new["id"], new["size"]), 11) / float(1 << 53)).alias("u"),
        )

        def move(r: Column) -> Column:
            gain, loss = F.least(r["old_up"], r["new_down"]), F.least(r["old_down"], r["new_up"])
            # The old one gains with probability loss / (gain + loss).
            end = F.when(
                r["u"] * (gain + loss) < loss,
                F.when(r["old_up"] <= r["new_down"], F.struct(item(new, new["p"] - gain / new["words"]).alias("left"), settled(old, F.lit(1)).alias("done"))).otherwise(F.struct(item(old, old["p"] + gain / old["words"]).alias("left"), settled(new, F.lit(0)).alias("done"))),
            ).otherwise(F.when(r["old_down"] <= r["new_up"], F.struct(item(new, new["p"] + loss / new["words"]).alias("left"), settled(old, F.lit(0)).alias("done"))).otherwise(F.struct(item(old, old["p"] - loss / old["words"]).alias("left"), settled(new, F.lit(1)).alias("done"))))
            return let(end, lambda e: F.struct(e["left"].alias("left"), F.concat(state["done"], e["done"]).alias("done")))

        return let(room, move)

    start = F.struct(items[0].cast(f"struct<{kind}>").alias("left"), F.array().cast("array<struct<id:bigint,size:bigint,rows:bigint,up:int>>").alias("done"))
    return F.aggregate(F.slice(items, 2, F.size(items)), start, pair)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """One row per row of docs: id, source, size, source_size, target, copies.

    size is the number of words; null and empty texts have none. A source's documents take share words of the total by
    weight (sources in code-point order, null last). Every document but one of a source is expected to be taken as often
    as the source's ratio says, and the words taken miss the target by no more than half of that one document.
    Rows that agree in id, source and size are taken together. Documents without words get the whole part of their
    source's ratio. copies is at most ceil(most). The same rows and seed give the same copies. Ids are integers or
    null. No rows give no rows; very long texts are counted whole; other columns are not read, whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"))
    units = written(rows.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("rows")), "mix-units")
    targets = written(source_targets(units, weights, share, most).withColumn("blocks", F.ceil(F.col("units") / FAN_IN)), "mix-targets")
    ratio = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    ids = targets.select(F.col("source").alias("at"), "source_size", "target", "blocks", F.floor(ratio).alias("whole"), (ratio - F.floor(ratio)).alias("p"))
    dealt = units.join(ids, F.col("source").eqNullSafe(F.col("at"))).drop("at")
    clear = (F.col("size") == 0) | (F.col("p") == 0)
    sure = dealt.filter(clear).select("id", "source", "size", "rows", F.lit(0).alias("up"))
    block = F.pmod(F.xxhash64(F.lit(seed), "id", "size"), F.col("blocks"))
    level = dealt.filter(~clear).select("source", block.alias("block"), F.struct("id", "size", "rows", (F.col("size") * F.col("rows")).cast("double").alias("words"), "p").alias("item"))
    level = written(level, "mix-leaves")
    done, n, blocks = [sure], 0, targets.agg(F.max("blocks")).first()[0] or 1

    def folded(level: DataFrame, n: int) -> DataFrame:
        # Large documents first, so that smaller ones are left to take up what they leave.
        order = F.array_sort(F.collect_list(F.struct((-F.col("item.words")).alias("words"), F.xxhash64(F.lit(seed + 1), "item.id", "item.size").alias("at"), "item")))
        return written(level.groupBy("source", "block").agg(order.alias("items")).select("source", "block", _fold(F.transform("items", lambda x: x["item"]), seed, n).alias("f")), "mix-level")

    while True:
        out = folded(level, n)
        done.append(out.select("source", F.explode("f.done").alias("d")).select("d.id", "source", "d.size", "d.rows", "d.up"))
        if blocks == 1:
            break
        level = out.select("source", F.floor(F.col("block") / FAN_IN).alias("block"), F.col("f.left").alias("item"))
        n, blocks = n + 1, -(-blocks // FAN_IN)
    last = F.col("f.left")
    done.append(out.select("source", last["id"].alias("id"), last["size"].alias("size"), last["rows"].alias("rows"), F.when(last["p"] < 0.5, 0).otherwise(1).alias("up")).select("id", "source", "size", "rows", "up"))
    ups = done[0]
    for d in done[1:]:
        ups = ups.unionByName(d)
    out = ups.join(ids.select("at", "source_size", "target", "whole"), F.col("source").eqNullSafe(F.col("at")))
    return out.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows")))).select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", (F.col("whole") + F.col("up")).cast("int").alias("copies"))


def apply_copies(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs, each as often as mix_sources() says; columns may have any names."""
    of, source, size, copies, n = spare(docs, "id_of", "source_of", "words", "copies", "copy")
    times = mixed.select(F.col(id_col).cast("long").alias(of), F.col(source_col).alias(source), F.col("size").alias(size), F.col("copies").alias(copies)).distinct()
    on = [F.col(id_col).eqNullSafe(F.col(of)), F.col(source_col).eqNullSafe(F.col(source)), word_count(text_col) == F.col(size)]
    joined = docs.join(times, on).filter(F.col(copies) > 0)
    return joined.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*(docs[c] for c in docs.columns))
