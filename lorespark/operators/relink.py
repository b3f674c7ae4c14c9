"""Incremental indexing of a code base: versioned tables of files, entities, references and links.

Every update writes one version: the changed files with what is new in them, and the links that the change moves.
Nothing of earlier versions is rewritten, so an update costs what it touches, and any version can be read again. A
table as of a version is its rows whose file has no later version; a link that a later version has resolved anew is
taken from there.

A reference is resolved by name: to the entity of its own file, else to the one in the first file by path, else to
none. An update resolves the references of the changed files, and of all others only those to names whose first file
has changed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.operators.versioning import changed_paths
from lorespark.sources.tables import last_version

_FILES = "path string, action string, version int"
_ENTITIES = "path string, name string, entity_type string, version int"
_REFERENCES = "path string, source string, type string, target_name string, version int"
_LINKS = "path string, source string, type string, target_name string, target_path string, version int"
_KEY = ["path", "source", "type", "target_name"]


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


@dataclass
class LinkedIndex:
    """Versions in a folder that driver and executors share. One writer at a time; a version counts once its files table is there."""

    spark: SparkSession
    folder: str

    def _read(self, table: str, schema: str, version: int) -> DataFrame:
        paths = [f"{self.folder}/{table}/{v}" for v in range(1, version + 1)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def last_version(self) -> int:
        """The number of the last whole version: its files table is written last."""
        return last_version(self.spark, f"{self.folder}/files")

    def _heads(self, version: int) -> DataFrame:
        """(path, version, action): the last change of every path."""
        last = self._read("files", _FILES, version).groupBy("path").agg(F.max(F.struct("version", "action")).alias("h"))
        return last.select("path", "h.version", "h.action")

    def _current(self, table: str, schema: str, version: int) -> DataFrame:
        heads = self._heads(version).filter("action <> 'delete'").select("path", "version")
        return self._read(table, schema, version).join(heads, ["path", "version"], "left_semi")

    def entities(self, version: int | None = None) -> DataFrame:
        return self._current("entities", _ENTITIES, self.last_version() if version is None else version).drop("version")

    def references(self, version: int | None = None) -> DataFrame:
        return self._current("references", _REFERENCES, self.last_version() if version is None else version).drop("version")

    def links(self, version: int | None = None) -> DataFrame:
        """(path, source, type, target_name, target_path): target_path is null where no file has the name."""
        v = self.last_version() if version is None else version
        heads = self._heads(v).filter("action <> 'delete'").select("path", F.col("version").alias("head"))
        last = self._read("links", _LINKS, v).groupBy(*_KEY).agg(F.max(F.struct("version", "target_path")).alias("l"))
        return last.join(heads, "path").filter(F.col("l.version") >= F.col("head")).select(*_KEY, "l.target_path")

    def update(self, changes: DataFrame, entities: DataFrame, references: DataFrame) -> int:
        """Apply one commit; returns the number of its version.

        changes: (change_type A/M/D/R, old_path, path); entities (path, name, entity_type) and references (path, source,
        type, target_name) are those of the added and modified files, read whole, and may hold repeated rows; rows of
        other files are left out. A path that is both deleted and written counts as written.
        """
        done = self.last_version()
        version = done + 1
        net = changed_paths(changes).groupBy("path").agg(F.max("action").alias("action"))  # update comes after delete
        net = net.withColumn("version", F.lit(version))
        kept = net.filter("action = 'update'").select("path")
        new_entities = entities.join(kept, "path", "left_semi").select("path", "name", "entity_type").distinct().withColumn("version", F.lit(version))
        new_references = references.join(kept, "path", "left_semi").select(*_KEY).distinct().withColumn("version", F.lit(version))
        # A writer that was stopped leaves tables without a files table; they are written over.
        entities_path, references_path = f"{self.folder}/entities/{version}", f"{self.folder}/references/{version}"
        new_entities.write.mode("overwrite").parquet(entities_path)
        new_references.write.mode("overwrite").parquet(references_path)
        new_entities, new_references = (self.spark.read.schema(s).parquet(p) for s, p in ((_ENTITIES, entities_path), (_REFERENCES, references_path)))

        before = self._current("entities", _ENTITIES, done)
        gone = before.join(net.select("path"), "path", "left_semi")
        touched = gone.select("name").unionByName(new_entities.select("name")).distinct()
        rest = before.join(net.select("path"), "path", "left_anti")
        candidates = rest.select("path", "name", F.lit(0).alias("side")).unionByName(gone.select("path", "name", F.lit(-1).alias("side"))).unionByName(new_entities.select("path", "name", F.lit(1).alias("side"))).join(touched, "name", "left_semi")
        first = candidates.groupBy("name").agg(F.min(F.when(F.col("side") <= 0, F.col("path"))).alias("old"), F.min(F.when(F.col("side") >= 0, F.col("path"))).alias("new"))
        moved = first.filter(~F.col("old").eqNullSafe(F.col("new"))).select(F.col("name").alias("target_name"))
        others = self._current("references", _REFERENCES, done).join(net.select("path"), "path", "left_anti").join(moved, "target_name", "left_semi")
        now = rest.select("path", "name").unionByName(new_entities.select("path", "name"))
        fresh = resolved(new_references.select(*_KEY).unionByName(others.select(*_KEY)), now).withColumn("version", F.lit(version))
        fresh.select(*_columns(_LINKS)).write.mode("overwrite").parquet(f"{self.folder}/links/{version}")
        net.select(*_columns(_FILES)).write.mode("overwrite").parquet(f"{self.folder}/files/{version}")
        return version

    def resolved_in(self, version: int) -> DataFrame:
        """The links that a version has resolved."""
        return self.spark.read.schema(_LINKS).parquet(f"{self.folder}/links/{version}").drop("version")


def resolved(references: DataFrame, entities: DataFrame) -> DataFrame:
    """references with target_path: their own file if it has the name, else the first file by path that has it, else null.

    Only the first file of each name asked for takes part in the join, so a name that many files share, or many files
    ask for, costs partial minima and a join with one row a name.
    """
    asked = references.select(F.col("target_name").alias("name")).distinct()
    has = entities.select("path", "name").distinct()
    first = has.join(asked, "name", "left_semi").groupBy(F.col("name").alias("target_name")).agg(F.min("path").alias("__first"))
    own = has.select("path", F.col("name").alias("target_name"), F.lit(True).alias("__own"))
    out = references.join(own, ["path", "target_name"], "left").join(first, "target_name", "left")
    return out.select(*references.columns, F.when(F.col("__own"), F.col("path")).otherwise(F.col("__first")).alias("target_path"))


def replayed(index: LinkedIndex, commits: list[tuple[DataFrame, DataFrame, DataFrame]]) -> LinkedIndex:
    """The index after commits (changes, entities, references) in order."""
    return reduce(lambda i, c: (i.update(*c), i)[1], commits, index)
