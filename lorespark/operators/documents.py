"""Relational operators over document tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.sources.tables import written


def contains_any(columns: list[Column], text: str) -> Column:
    """Whether any of the columns holds the text, without regard to case."""
    return reduce(lambda a, b: a | b, (F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(text.lower())) for c in columns))


def filtered(df: DataFrame, **wanted) -> DataFrame:
    """Equality filters for the arguments that are given; lists are IN lists, None is no filter."""
    for name, v in wanted.items():
        if v is not None:
            df = df.filter(F.col(name).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(name) == v)
    return df


def point_read(df: DataFrame, key: str, value, **partition) -> DataFrame:
    return filtered(df, **partition).filter(F.col(key) == value).limit(1)


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key: keep-first, keep-last and preferred-winner removal of duplicates.

    The row is found by an aggregate, which sums up before the shuffle, so one frequent key does no harm.
    """
    names = [c for c in df.columns if c not in keys]
    w = df.withColumn("__order", F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order))))
    best = w.groupBy(*keys).agg(F.min(F.struct("__order", *names)).alias("__b"))
    return best.select(*keys, *(F.col(f"__b.{n}").alias(n) for n in names)).select(*df.columns)


def last_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    names = [c for c in df.columns if c not in keys]
    w = df.withColumn("__order", F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order))))
    best = w.groupBy(*keys).agg(F.max(F.struct("__order", *names)).alias("__b"))
    return best.select(*keys, *(F.col(f"__b.{n}").alias(n) for n in names)).select(*df.columns)


def top_rows(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


def ranked(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first rows of all with their rank; what is ranked is no more than the limit."""
    top = df.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def balance(df: DataFrame, key: str) -> DataFrame:
    """Groups with over twice or under half of the mean number of rows are hot or cold."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    mean = counts.agg(F.avg("n").alias("mean"))
    state = F.when(F.col("n") > 2 * F.col("mean"), "hot").when(F.col("n") < 0.5 * F.col("mean"), "cold").otherwise("normal")
    return counts.join(F.broadcast(mean), how="cross").select(key, "n", state.alias("state"))  # one row


def balance_score(df: DataFrame, key: str) -> DataFrame:
    states = balance(df, key)
    return states.agg((1 - F.count_if(F.col("state") != "normal") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("balance_score"))


def floor_percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """sorted[int(share * n)] of each group, the rule of the index rather than interpolation; counts first, then one row for each place.

    The places are found by ranks within the group over its distinct values and their counts.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*keys)
    upto = counts.withColumn("__upto", F.sum("__n").over(w.orderBy(value))).withColumn("__all", F.sum("__n").over(w))
    picks = [F.min(F.when(F.col("__upto") > F.least(F.floor(F.lit(p) * F.col("__all")), F.col("__all") - 1), F.col(value))).alias(name) for name, p in shares.items()]
    total = F.sum(F.col(value) * F.col("__n"))
    return upto.groupBy(*keys).agg(F.sum("__n").alias("n"), (total / F.sum("__n")).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), *picks)


def moving_average(df: DataFrame, keys: list[str], order: list[str], value: str, weight: float = 0.1) -> DataFrame:
    """Exponential moving average of each group, seeded by its first value.

    A run of rows changes the average to decay * average + gain, whatever it was, so a group's rows are folded in
    chunks of bounded size, ordered over the whole cluster, and one row a chunk remains to be put in order.
    """
    v = F.col(value).cast("double")
    ordered = df.select(*keys, *(c for c in order if c not in keys), v.alias("__v")).repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("__row", F.monotonically_increasing_id())
    fold = lambda start: F.aggregate(F.transform("__items", lambda x: x["__v"]), start, lambda s, x: F.when(s.isNull(), x).otherwise(weight * x + (1 - weight) * s))
    chunks = ordered.groupBy(*keys, F.shiftright("__row", 12).alias("__chunk")).agg(F.array_sort(F.collect_list(F.struct("__row", "__v"))).alias("__items"))
    part = F.struct("__chunk", fold(F.lit(None).cast("double")).alias("seeded"), fold(F.lit(0.0)).alias("gain"), F.pow(F.lit(1 - weight), F.size("__items")).alias("decay"))
    parts = chunks.select(*keys, part.alias("__p")).groupBy(*keys).agg(F.array_sort(F.collect_list("__p")).alias("__parts"))
    whole = F.aggregate("__parts", F.lit(None).cast("double"), lambda s, p: F.when(s.isNull(), p["seeded"]).otherwise(p["gain"] + p["decay"] * s))
    return parts.select(*keys, whole.alias("average"))


def running_mean(df: DataFrame, keys: list[str], order: list[Column], value: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running_mean", F.avg(value).over(w))


def rate(part: Column, scale: float = 1.0) -> Column:
    """The share of rows where part holds; null if there are none."""
    return F.try_divide(F.count_if(part) * scale, F.count(F.lit(1)))


def resolved(references: DataFrame, entities: DataFrame, candidates: Column) -> DataFrame:
    """References joined with the entity that the first of their candidate names finds. entities: (key, entity_id)."""
    tries = references.select("*", F.posexplode(candidates).alias("__try", "key"))
    found = tries.join(entities, "key")
    keys = references.columns
    return found.groupBy(*keys).agg(F.min(F.struct("__try", "entity_id")).alias("__b")).select(*keys, F.col("__b.entity_id").alias("entity_id"))


def same_group_pairs(df: DataFrame, key: str, id_col: str, most: int) -> DataFrame:
    """Pairs of rows of a group, each of them among its first `most` rows by a hash of the id."""
    few = top_rows(df.select(key, id_col), [key], [F.xxhash64(id_col), F.col(id_col)], most).drop("rank")
    other = few.select(key, F.col(id_col).alias("other_id"))
    return few.join(other, key).filter(F.col(id_col) < F.col("other_id"))


def classification_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Precision, recall and F1 of every class."""
    classes = df.select(F.explode(F.array(F.struct(F.col(label).alias("c"), F.lit(1).alias("t"), (F.col(predicted) == F.col(label)).cast("int").alias("hit"), F.lit(0).alias("p")), F.struct(F.col(predicted).alias("c"), F.lit(0).alias("t"), F.lit(0).alias("hit"), F.lit(1).alias("p")))).alias("x")).select("x.*")
    sums = classes.groupBy(F.col("c").alias("class")).agg(F.sum("hit").alias("hits"), F.sum("t").alias("support"), F.sum("p").alias("predicted"))
    p, r = F.coalesce(F.try_divide(F.col("hits") * 1.0, "predicted"), F.lit(0.0)), F.coalesce(F.try_divide(F.col("hits") * 1.0, "support"), F.lit(0.0))
    return sums.select("class", "support", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def containing_join(parts: DataFrame, wholes: DataFrame, anchor: int = 8) -> DataFrame:
    """Each part (part_id, part) with the first whole (whole_id, whole), by id, that holds it as a substring.

    Parts are looked up by an anchor of so many characters, or of all of a shorter one: of those at their beginning,
    middle and end the one that the fewest wholes have. Wholes are cut into substrings of that length only, so a whole
    gives a few short rows a character, and those that share an anchor with a part are compared. Empty parts find nothing.
    """
    n = F.least(F.length("part"), F.lit(anchor))
    ends = F.array(F.left("part", n), F.substring(F.col("part"), F.floor((F.length("part") - n) / 2).cast("int") + 1, n), F.right("part", n))
    tried = parts.filter("part <> ''").select("part_id", "part", F.explode(F.array_distinct(ends)).alias("anchor"))
    sizes = [r[0] for r in tried.select(F.length("anchor")).distinct().collect()]  # at most `anchor` numbers
    none = F.array().cast("array<string>")
    cuts = F.flatten(F.transform(F.array(*map(F.lit, sizes)).cast("array<int>"), lambda k: F.when(F.length("whole") >= k, F.transform(F.sequence(F.lit(1), F.length("whole") - k + 1), lambda i: F.substring(F.col("whole"), i, k))).otherwise(none)))
    there = written(wholes.select("whole_id", F.explode(F.array_distinct(cuts)).alias("anchor")).join(tried.select("anchor").distinct(), "anchor", "left_semi"), "anchors")
    counts = there.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    rarest = tried.join(counts, "anchor", "left").groupBy("part_id", "part").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "anchor")).alias("a")).filter("a.n > 0")
    met = rarest.select("part_id", "part", "a.anchor").join(there, "anchor")
    sure = met.filter("part = anchor").select("part_id", "part", "whole_id")
    checked = met.filter("part <> anchor").join(wholes, "whole_id").filter(F.contains("whole", "part")).select("part_id", "part", "whole_id")
    return sure.unionByName(checked).groupBy("part_id", "part").agg(F.min("whole_id").alias("whole_id"))


def emptied(df: DataFrame) -> DataFrame:
    return df.limit(0)


def checked_uuid(value: str) -> str:
    """The value in canonical form; ValueError if it is no UUID."""
    return str(uuid.UUID(value))


def created(spark, name: str, schema: str, partition_by: list[str]) -> None:
    """Make a Parquet table unless it is there."""
    by = f" PARTITIONED BY ({', '.join(partition_by)})" if partition_by else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet{by}")
