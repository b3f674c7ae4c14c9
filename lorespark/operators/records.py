"""Maps, guards, comparisons and listings over plain records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Relationships that make up a dependency graph, and types of nodes in it.
DEPENDENCIES, MODULES = ("imports", "depends_on", "requires"), ("module", "import")


def get_or(map_: Column, key: Column, default: Column) -> Column:
    """The value of a key, or the default."""
    return F.coalesce(F.try_element_at(map_, key), default)


def incremented(map_: Column, key: Column, step: float = 0.1, most: float = 1.0, start: float = 0.0) -> Column:
    """The map with the value of a key raised by step, no further than most; absent keys begin at start."""
    new = F.least(get_or(map_, key, F.lit(start)) + step, F.lit(most))
    return F.map_concat(F.map_filter(map_, lambda k, v: k != key), F.map_from_arrays(F.array(key), F.array(new)))


def merged(first: Column, second: Column) -> Column:
    """Both maps; of a key in both, the second's value."""
    return F.map_concat(F.map_filter(first, lambda k, v: ~F.array_contains(F.map_keys(second), k)), second)


def json_or_default(text: Column, defaults: dict[str, str | float | int | bool]) -> Column:
    """A struct of fields of a JSON object, each with its default where it is missing, null or of another type, or the text no object."""
    kinds = {bool: "boolean", int: "bigint", float: "double", str: "string"}
    return F.struct(*(F.coalesce(F.get_json_object(text, f"$.{name}").try_cast(kinds[type(v)]), F.lit(v)).alias(name) for name, v in defaults.items()))


def due(last: Column, now: Column, hours: int = 24) -> Column:
    """Whether something may run again: never run, or so long ago."""
    return last.isNull() | (now >= last + F.make_dt_interval(hours=F.lit(hours)))


def throughput(done: Column, seconds: Column) -> Column:
    """Done a second; 0 if no time has passed."""
    return F.when(seconds > 0, done / seconds).otherwise(0.0)


def regression(before: DataFrame, after: DataFrame, value: str, key: str, most: float = 0.2) -> DataFrame:
    """(key, before, after, change, regressed): means of both runs; slower by more than `most` counts as regressed."""
    means = (df.groupBy(key).agg(F.avg(value).alias(name)) for df, name in ((before, "before"), (after, "after")))
    joined = next(means).join(next(means), key)
    change = F.try_divide(F.col("after") - F.col("before"), F.col("before"))
    return joined.select(key, "before", "after", change.alias("change"), F.coalesce(change > most, F.lit(False)).alias("regressed"))


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """(label, predicted, n): the cells of a confusion matrix that hold any row."""
    return df.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def fold_of(key: Column, folds: int = 5) -> Column:
    """A fold from 0 on by the MD5 of a key's text."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int")


def accuracy_by_fold(rows: DataFrame, key: str, label: str, guess: str, folds: int = 5) -> DataFrame:
    """Accuracy of guesses that are there already, by fold."""
    return rows.groupBy(fold_of(F.col(key), folds).alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(label) == F.col(guess)).cast("int")).alias("accuracy"))


def cross_validated(rows: DataFrame, key: str, label: str, features: list[str], folds: int = 5) -> DataFrame:
    """rows with fold and guess: the class whose mean features, of the rows in the other folds, lie nearest.

    All folds are fitted in one plan: means of a fold's complement are the sums of all rows less those of the fold, so
    rows are read for the sums and once more for the guesses, which meet one row a fold and class. Of equal distances
    the smaller class wins; rows with a null feature or label take no part. A class that a complement lacks is no guess.
    """
    known = rows.filter(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in [label, *features]))).withColumn("fold", fold_of(F.col(key), folds))
    sums = known.groupBy("fold", label).agg(F.count(F.lit(1)).alias("__n"), *(F.sum(F.col(c).cast("double")).alias(f"__s{i}") for i, c in enumerate(features)))
    of_class = Window.partitionBy(label)
    every = known.select("fold").distinct().crossJoin(F.broadcast(known.select(label).distinct()))  # folds times classes
    full = every.join(sums, ["fold", label], "left").fillna(0)
    rest = full.select("fold", F.col(label).alias("__class"), *((F.sum(c).over(of_class) - F.col(c)).alias(c) for c in ("__n", *(f"__s{i}" for i in range(len(features))))))
    means = rest.filter("__n > 0").select("fold", "__class", *((F.col(f"__s{i}") / F.col("__n")).alias(f"__m{i}") for i in range(len(features))))
    classes = means.groupBy("fold").agg(F.collect_list(F.struct("__class", *(f"__m{i}" for i in range(len(features))))).alias("__classes"))
    far = lambda m: sum(((F.col(c).cast("double") - m[f"__m{i}"]) ** 2 for i, c in enumerate(features)), F.lit(0.0))
    nearest = F.array_min(F.transform("__classes", lambda m: F.struct(far(m).alias("d"), m["__class"].alias("guess"))))
    return known.join(F.broadcast(classes), "fold", "left").withColumn("guess", nearest["guess"]).drop("__classes")  # one row a fold


def neighbour_pairs(nodes: DataFrame, keys: list[str], order: str, most: int = 5) -> DataFrame:
    """(keys, source, target): each of a list's first nodes with the next one, `most` pairs at most."""
    w = Window.partitionBy(*keys).orderBy(order)
    first = nodes.select(*keys, order, F.row_number().over(w).alias("__rank")).filter(F.col("__rank") <= most + 1)
    return first.withColumn("target", F.lead(order).over(w)).filter("target is not null").select(*keys, F.col(order).alias("source"), "target")


def names_of(df: DataFrame, key: str, name: str) -> DataFrame:
    """(key, names): the set of names of each key, in order; duplicates go before the shuffle."""
    return df.select(key, name).distinct().groupBy(key).agg(F.sort_array(F.collect_set(name)).alias("names"))


def needs_update(stored: DataFrame, remote: DataFrame, key: str, sha: str, force: bool = False) -> DataFrame:
    """The remote rows whose sha differs from the stored one, or that are new; all of them if forced."""
    if force:
        return remote
    return remote.join(stored.select(key, F.col(sha).alias("__sha")), key, "left").filter(F.col("__sha").isNull() | (F.col("__sha") != F.col(sha))).drop("__sha")


def dependency_graph(nodes: DataFrame, edges: DataFrame, external: bool = True) -> tuple[DataFrame, DataFrame]:
    """Modules and what they import: nodes (id, type, external), edges (source_id, target_id, type); without external ones if so wanted."""
    kept = nodes.filter(F.col("type").isin(*MODULES))
    if not external:
        kept = kept.filter(~F.coalesce(F.col("external"), F.lit(False)))
    ids = kept.select("id")
    links = edges.filter(F.col("type").isin(*DEPENDENCIES))
    links = links.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return kept, links.select("source_id", "target_id", "type")


def relationships_of(edges: DataFrame, entity) -> DataFrame:
    """(parent_id, other_id, type, direction): all relationships of an entity, whichever end it is."""
    out = edges.filter(F.col("source_id") == entity).select(F.col("source_id").alias("parent_id"), F.col("target_id").alias("other_id"), "type", F.lit("outgoing").alias("direction"))
    back = edges.filter(F.col("target_id") == entity).select(F.col("target_id").alias("parent_id"), F.col("source_id").alias("other_id"), "type", F.lit("incoming").alias("direction"))
    return out.unionByName(back)


def result_graph(results: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes that a query found (id), and the edges among them."""
    found = nodes.join(results.select("id"), "id", "left_semi")
    ids = found.select("id")
    inside = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return found, inside


def is_import_line(line: Column) -> Column:
    """Whether a line of source code imports something."""
    return F.regexp_like(line, F.lit(r"^\s*(import\s|from\s+\S+\s+import\s|#include\s|using\s|require\s*\()"))


def imported_module(line: Column) -> Column:
    """The module that an import line names; null for other lines."""
    name = F.regexp_extract(line, r"^\s*(?:import\s+(?:static\s+)?|from\s+|using\s+|#include\s+[<\"]|require\s*\(\s*['\"])([^\s;,'\"<>()]+)", 1)
    return F.when(is_import_line(line) & (name != ""), name)


def visibility(name: Column) -> Column:
    """Names that begin with an underscore are private."""
    return F.when(name.startswith("_"), "private").otherwise("public")


def path_parts(path: Column) -> Column:
    """(name, stem, suffix, parent) of a path with either kind of slashes."""
    p = F.regexp_replace(path, r"\\", "/")
    name = F.regexp_extract(p, r"([^/]*)$", 1)
    suffix = F.regexp_extract(name, r"[^.](\.[^.]+)$", 1)
    return F.struct(name.alias("name"), F.left(name, F.length(name) - F.length(suffix)).alias("stem"), suffix.alias("suffix"), F.regexp_extract(p, r"^(.*)/[^/]*$", 1).alias("parent"))


def parsed_key(key: Column) -> Column:
    """The parts of a composite key: (repository, branch); null unless there are two."""
    parts = F.split(key, "#")
    return F.when(F.size(parts) == 2, F.struct(parts[0].alias("repository"), parts[1].alias("branch")))


def export_patterns(patterns: DataFrame, path: str) -> str:
    """Write intent patterns as JSON lines; the path."""
    patterns.write.mode("overwrite").json(path)
    return path
