"""Registered queries over plain records and graphs of modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.operators import records as r
from lorespark.sources.catalog import GROUP, Catalog, imported
from lorespark.sources.tables import new_path

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return Catalog(spark, sf).table(name)


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with a map of three weights, of which one is absent from some."""
    n = F.pmod("event_id", F.lit(10)) / 10.0
    whole = F.create_map(F.lit("graph"), n, F.lit("vector"), F.lit(0.95))
    return _table(spark, sf, "events").withColumn("weights", F.when(F.col("event_type") == "error", F.map_filter(whole, lambda k, v: k == "vector")).otherwise(whole))


def _modules(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Parts as modules, imports and functions; what they import, call or require."""
    part = _table(spark, sf, "part")
    kind = F.when(F.col("p_size") % 3 == 0, "module").when(F.col("p_size") % 3 == 1, "import").otherwise("function")
    nodes = part.select(F.col("p_partkey").alias("id"), kind.alias("type"), (F.col("p_size") > 40).alias("external"))
    link = F.when(F.col("p_partkey") % 4 == 0, "calls").when(F.col("p_partkey") % 4 == 1, "imports").when(F.col("p_partkey") % 4 == 2, "depends_on").otherwise("requires")
    return nodes, part.select(F.col("p_partkey").alias("source_id"), imported(F.col("p_partkey")).alias("target_id"), link.alias("type"))


def _patterns(spark: SparkSession, sf: str) -> DataFrame:
    path = r.export_patterns(_table(spark, sf, "region").select("r_regionkey", "r_name"), new_path(spark, "patterns"))
    return spark.read.schema("r_regionkey int, r_name string").json(path)


def _regression(spark: SparkSession, sf: str) -> DataFrame:
    e = _table(spark, sf, "events")
    out = r.regression(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), "value", "event_type", 0.01)
    return out.select("event_type", *(F.round(c, 6).alias(c) for c in ("before", "after", "change")), "regressed")


def _line(k: str) -> str:
    """A line of code for each part, in five languages."""
    return f"""CASE {k} % 6 WHEN 0 THEN concat('import mod', {k}) WHEN 1 THEN concat('from pkg', {k}, '.sub import name') WHEN 2 THEN concat('#include <lib', {k}, '.h>') WHEN 3 THEN concat('using Space', {k}, ';')
        WHEN 4 THEN concat('  require("r', {k}, '")') ELSE concat('important = ', {k}) END"""


_NEXT = f"p_partkey - p_partkey % {GROUP} + (p_partkey % {GROUP} * 6 + 1) % {GROUP}"
_MODULES = f"""nodes AS (SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'module' WHEN 1 THEN 'import' ELSE 'function' END AS type, p_size > 40 AS external FROM part),
    edges AS (SELECT p_partkey AS source_id, {_NEXT} AS target_id, CASE p_partkey % 4 WHEN 0 THEN 'calls' WHEN 1 THEN 'imports' WHEN 2 THEN 'depends_on' ELSE 'requires' END AS type FROM part)"""
_PATH = "concat('src\\\\lib/', p_brand, '/', CASE WHEN p_size % 5 = 0 THEN '.hidden' ELSE concat(p_name, '.v', p_size, '.py') END)"

QUERIES: dict[str, Query] = {
    "map_default_and_increment": lambda spark, sf: _events(spark, sf).select("event_id", F.round(r.get_or(F.col("weights"), F.lit("graph"), F.lit(0.5)), 6).alias("graph"), F.round(r.incremented(F.col("weights"), F.lit("graph"))["graph"], 6).alias("raised"), F.round(r.incremented(F.col("weights"), F.lit("vector"))["vector"], 6).alias("capped")),
    "map_merge": lambda spark, sf: _events(spark, sf).select("event_id", r.merged(F.col("weights"), F.create_map(F.lit("graph"), F.lit(2.0), F.lit("id"), F.col("event_id").cast("double"))).alias("m")).select("event_id", F.explode("m").alias("key", "value")).select("event_id", "key", F.round("value", 6).alias("value")),
    "json_defaults": lambda spark, sf: _table(spark, sf, "events").select("event_id", r.json_or_default(F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.lit("no json")).otherwise(F.lit('{"k": "text"}')), {"k": -1, "label": "none"}).alias("j")).select("event_id", "j.k", "j.label"),
    "retrain_due": lambda spark, sf: _table(spark, sf, "events").select("event_id", r.due(F.when(F.col("event_type") != "error", F.col("ts").cast("timestamp")), F.to_timestamp(F.lit("2024-01-10 00:00:00"))).alias("due")),
    "sync_throughput": lambda spark, sf: _table(spark, sf, "events").select("event_id", F.round(r.throughput(F.col("value"), F.col("event_id") % 4), 6).alias("rate")),
    "regression_detector": _regression,
    "confusion_matrix": lambda spark, sf: r.confusion(_table(spark, sf, "labels"), "quality", "toxic"),
    "accuracy": lambda spark, sf: _table(spark, sf, "labels").agg(F.round(F.avg((F.col("quality") == F.col("toxic")).cast("int")), 6).alias("accuracy")),
    "accuracy_by_fold": lambda spark, sf: r.accuracy_by_fold(_table(spark, sf, "labels"), "doc_id", "quality", "toxic").select("fold", "n", F.round("accuracy", 6).alias("accuracy")),
    "neighbour_pairs": lambda spark, sf: r.neighbour_pairs(_table(spark, sf, "events"), ["user_id"], "event_id"),
    "names_of_type": lambda spark, sf: r.names_of(_table(spark, sf, "part"), "p_type", "p_brand").select("p_type", F.array_join("names", ",").alias("names")),
    "needs_update": lambda spark, sf: r.needs_update(_table(spark, sf, "documents").filter("lang <> 'de'").select("doc_id", F.when(F.col("lang") == "en", F.md5("text")).otherwise(F.md5("lang")).alias("sha")), _table(spark, sf, "documents").select("doc_id", F.md5("text").alias("sha")), "doc_id", "sha").select("doc_id"),
    "dependency_nodes": lambda spark, sf: r.dependency_graph(*_modules(spark, sf), external=False)[0],
    "dependency_edges": lambda spark, sf: r.dependency_graph(*_modules(spark, sf), external=False)[1],
    "dependency_edges_with_external": lambda spark, sf: r.dependency_graph(*_modules(spark, sf))[1],
    "entity_relationships": lambda spark, sf: r.relationships_of(_modules(spark, sf)[1], 31),
    "result_graph": lambda spark, sf: r.result_graph(_table(spark, sf, "part").filter("p_size > 20").select(F.col("p_partkey").alias("id")), *_modules(spark, sf))[1].select("source_id", "target_id", "type"),
    "import_lines": lambda spark, sf: _table(spark, sf, "part").selectExpr("p_partkey", f"{_line('p_partkey')} AS line").select("p_partkey", r.is_import_line(F.col("line")).alias("imports"), r.imported_module(F.col("line")).alias("module")),
    "visibility": lambda spark, sf: _table(spark, sf, "part").select("p_partkey", r.visibility(F.concat(F.when(F.col("p_size") % 2 == 0, "_").otherwise(""), F.col("p_name"))).alias("visibility")),
    "path_parts": lambda spark, sf: _table(spark, sf, "part").selectExpr("p_partkey", f"{_PATH} AS path").select("p_partkey", r.path_parts(F.col("path")).alias("x")).select("p_partkey", "x.*"),
    "partition_key_parse": lambda spark, sf: _table(spark, sf, "part").select("p_partkey", r.parsed_key(F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise(F.concat_ws("#", "p_name", "p_type"))).alias("k")).select("p_partkey", "k.repository", "k.branch"),
    "export_patterns": _patterns,
    "bag_union": lambda spark, sf: _table(spark, sf, "nation").select(F.col("n_regionkey").alias("k")).unionByName(_table(spark, sf, "region").select(F.col("r_regionkey").alias("k"), "r_name"), allowMissingColumns=True),
    "set_difference": lambda spark, sf: _table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).subtract(_table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k"))),
}

ORACLE_SQL: dict[str, str] = {
    "map_default_and_increment": """WITH e AS (SELECT event_id, event_type = 'error' AS bare, event_id % 10 / 10.0::DOUBLE AS g FROM events)
        SELECT event_id, round(CASE WHEN bare THEN 0.5 ELSE g END, 6) AS graph, round(least(CASE WHEN bare THEN 0 ELSE g END + 0.1, 1), 6) AS raised, 1.0::DOUBLE AS capped FROM e""",
    "map_merge": """SELECT event_id, 'graph' AS key, 2.0::DOUBLE AS value FROM events UNION ALL SELECT event_id, 'id', event_id::DOUBLE FROM events UNION ALL SELECT event_id, 'vector', 0.95 FROM events""",
    "json_defaults": """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), -1) ELSE -1 END AS k,
        CASE WHEN event_id % 3 = 0 THEN coalesce(json_extract_string(props, '$.label'), 'none') ELSE 'none' END AS label FROM events""",
    "retrain_due": "SELECT event_id, event_type = 'error' OR TIMESTAMP '2024-01-10' >= ts + INTERVAL 24 HOUR AS due FROM events",
    "sync_throughput": "SELECT event_id, CASE WHEN event_id % 4 > 0 THEN round(value / (event_id % 4), 6) ELSE 0 END AS rate FROM events",
    "regression_detector": """WITH m AS (SELECT event_type, avg(value) FILTER (event_id % 2 = 0) AS before, avg(value) FILTER (event_id % 2 = 1) AS after FROM events GROUP BY event_type)
        SELECT event_type, round(before, 6) AS before, round(after, 6) AS after, round((after - before) / before, 6) AS change, (after - before) / before > 0.01 AS regressed FROM m""",
    "confusion_matrix": "SELECT quality AS label, toxic AS predicted, count(*) AS n FROM labels GROUP BY ALL",
    "accuracy": "SELECT round(avg((quality = toxic)::INT), 6) AS accuracy FROM labels",
    "neighbour_pairs": """WITH n AS (SELECT user_id, event_id, row_number() OVER w AS k, lead(event_id) OVER w AS target FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
        SELECT user_id, event_id AS source, target FROM n WHERE k <= 5 AND target IS NOT NULL""",
    "names_of_type": "SELECT p_type, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS names FROM part GROUP BY p_type",
    "needs_update": "SELECT doc_id FROM documents WHERE lang <> 'en'",
    "dependency_nodes": f"WITH {_MODULES} SELECT * FROM nodes WHERE type <> 'function' AND NOT external",
    "dependency_edges": f"WITH {_MODULES}, k AS (SELECT id FROM nodes WHERE type <> 'function' AND NOT external) SELECT * FROM edges WHERE type <> 'calls' AND source_id IN (SELECT id FROM k) AND target_id IN (SELECT id FROM k)",
    "dependency_edges_with_external": f"WITH {_MODULES}, k AS (SELECT id FROM nodes WHERE type <> 'function') SELECT * FROM edges WHERE type <> 'calls' AND source_id IN (SELECT id FROM k) AND target_id IN (SELECT id FROM k)",
    "entity_relationships": f"""WITH {_MODULES} SELECT source_id AS parent_id, target_id AS other_id, type, 'outgoing' AS direction FROM edges WHERE source_id = 31
        UNION ALL SELECT target_id, source_id, type, 'incoming' FROM edges WHERE target_id = 31""",
    "result_graph": f"WITH {_MODULES}, k AS (SELECT p_partkey AS id FROM part WHERE p_size > 20) SELECT * FROM edges WHERE source_id IN (SELECT id FROM k) AND target_id IN (SELECT id FROM k)",
    "import_lines": """SELECT p_partkey, p_partkey % 6 < 5 AS imports, CASE p_partkey % 6 WHEN 0 THEN 'mod' || p_partkey WHEN 1 THEN 'pkg' || p_partkey || '.sub' WHEN 2 THEN 'lib' || p_partkey || '.h' WHEN 3 THEN 'Space' || p_partkey
        WHEN 4 THEN 'r' || p_partkey END AS module FROM part""",
    "visibility": "SELECT p_partkey, CASE WHEN p_size % 2 = 0 OR p_name LIKE '\\_%' ESCAPE '\\' THEN 'private' ELSE 'public' END AS visibility FROM part",
    "path_parts": """SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '.hidden' ELSE p_name || '.v' || p_size || '.py' END AS name, CASE WHEN p_size % 5 = 0 THEN '.hidden' ELSE p_name || '.v' || p_size END AS stem,
        CASE WHEN p_size % 5 = 0 THEN '' ELSE '.py' END AS suffix, 'src/lib/' || p_brand AS parent FROM part""",
    "partition_key_parse": "SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN p_name END AS repository, CASE WHEN p_size % 3 <> 0 THEN p_type END AS branch FROM part",
    "export_patterns": "SELECT r_regionkey, r_name FROM region",
    "bag_union": "SELECT n_regionkey AS k, NULL AS r_name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region",
    "set_difference": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'",
}
