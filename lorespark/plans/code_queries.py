"""Registered queries over source code, and questions in words over the graph."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.operators import questions
from lorespark.operators.code_scan import code_entities
from lorespark.sources.catalog import EX, Catalog

Query = Callable[[SparkSession, str], DataFrame]

#: Of each language: its first two lines, one line for each member, its last lines; {k} is the part, {i} the member.
_CODE = {
    "java": ("/* class Fake{k} {{ */\nclass C{k} {{", '  void m{i}(int a) {{ String s = "}} class Z {{"; if (a > {k}) {{ go(); }} }}', "}}"),
    "csharp": ("// class Fake{k} {{\nclass C{k} {{", '  void m{i}(int a) {{ var s = @"}} class \\"; foreach (var x in y) {{ go(); }} }}', "}}"),
    "cpp": ("/* class Fake{k} {{ */\nclass C{k} {{", '  void m{i}(int a) const {{ auto s = R"(}} class Z {{)"; while (a) {{ go(); }} }}', "}};"),
    "javascript": ("// class Fake{k} {{\nclass C{k} {{", "  m{i}(a) {{ const s = `}} ${{`class Z {{`}}`; if (a) {{ go() }} }}", "}}"),
    "typescript": ("/* class Fake{k} {{ */\nexport class C{k} {{", "  m{i}(a: number): string {{ return '}} class Z {{'; }}", "}}"),
    "rust": ("/* a /* fn fake{k}() {{ */ */\nimpl C{k} {{", '  fn m{i}(a: i32) {{ let s = r#"}} fn z() {{"#; if a > 1 {{ go(); }} }}', "}}"),
    "go": ("// func fake() {{\ntype C{k} struct {{ a int }}", "func (c *C{k}) m{i}(a int) {{ s := `}} func z() {{`; if a > {k} {{ stop(s) }} }}", ""),
    "c": ("/* void fake(int a) {{ */\nstruct C{k} {{ int a; }};", 'static int m{i}(int a) {{ char *s = "}} {{"; if (a) {{ go(s); }} return 0; }}', ""),
    "css": ("/* .fake {{ */\n@media (min-width: {k}px) {{", '  .m{i} {{ content: "}} .z {{" }}', "}}"),
    "html": ("<!-- <b{k}> -->\n<ul id=C{k}>", "  <li>m{i} &lt;p&gt;</li>", "</ul>"),
    "python": ("# class Fake{k}:\nclass C{k}:", '    def m{i}(self): return "class Z:"', "    x = 1"),
}


def _files(spark: SparkSession, sf: str) -> DataFrame:
    """A file for each part: its language by the key, its members by the size."""
    def line(text: str):
        pieces = text.replace("{{", "\0").replace("}}", "\1").replace("{k}", "\2k\2").replace("{i}", "\2i\2").replace("\0", "{").replace("\1", "}").split("\2")
        return lambda i: F.concat(*({"k": F.col("p_partkey").cast("string"), "i": i.cast("string")}[p] if p in ("k", "i") else F.lit(p) for p in pieces))

    content = F.lit("")
    for n, (first, member, last) in enumerate(_CODE.values()):
        members = F.transform(F.sequence(F.lit(1), F.col("p_size") % 4 + 1), line(member))
        whole = F.concat_ws("\n", line(first)(F.lit(0)), F.array_join(F.slice(members, 1, F.col("p_size") % 4), "\n"), line(last)(F.lit(0)))
        whole = F.when(F.col("p_size") % 4 == 0, F.concat_ws("\n", line(first)(F.lit(0)), line(last)(F.lit(0)))).otherwise(whole)
        content = F.when(F.col("p_partkey") % len(_CODE) == n, whole).otherwise(content)
    language = F.element_at(F.array(*map(F.lit, _CODE)), (F.col("p_partkey") % len(_CODE) + 1).cast("int"))
    return Catalog(spark, sf).table("part").select(F.col("p_partkey").cast("string").alias("path"), language.alias("language"), content.alias("content"))


SCHEMA = questions.Schema(
    EX,
    (("placedBy", "Order", "Customer"), ("contains", "Order", "Part"), ("suppliedBy", "Part", "Supplier"), ("imports", "Part", "Part"), ("inNation", "Customer", "Nation"), ("inNation", "Supplier", "Nation"), ("inRegion", "Nation", "Region")),
    {"Order": ("order", "orders"), "Customer": ("customer", "customers"), "Part": ("part", "parts"), "Supplier": ("supplier", "suppliers"), "Nation": ("nation", "nations"), "Region": ("region", "regions")},
    {"placedBy": ("placed", "ordered"), "contains": ("contain", "containing"), "suppliedBy": ("supplied", "supply"), "imports": ("import",), "inNation": ("nation", "live"), "inRegion": ("region",)},
)


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """Questions that name each nation, region, supplier and part, and some that name nothing known."""
    t = Catalog(spark, sf).table
    ask = lambda df, *text: df.select(F.concat(*text).alias("question"))
    nation, region, supplier = t("nation"), t("region"), t("supplier")
    parts = [
        ask(nation, F.lit("Which suppliers are in "), "n_name", F.lit("?")),
        ask(nation, F.lit("How many customers live in "), F.lower("n_name"), F.lit(" ?")),
        ask(region, F.lit("List the nations of the region "), "r_name", F.lit(".")),
        ask(supplier, F.lit("parts supplied by "), "s_name"),
        ask(t("part").select("p_name").distinct(), F.lit("Number of suppliers that supply a \""), F.initcap("p_name"), F.lit("\"")),
        ask(nation.crossJoin(F.broadcast(region)), F.lit("What suppliers of "), "n_name", F.lit(" are in "), "r_name", F.lit("?")),
        ask(region, F.lit("Which suppliers are in Atlantis "), F.col("r_regionkey").cast("string")),
        ask(region, F.lit("What is the weather in "), "r_name"),
    ]
    return reduce(DataFrame.unionByName, parts).select(F.xxhash64("question").alias("id"), "question")


QUERIES: dict[str, Query] = {
    "code_entities": lambda spark, sf: code_entities(_files(spark, sf)),
    "question_answers": lambda spark, sf: questions.answered(Catalog(spark, sf).stated, _asked(spark, sf).distinct(), SCHEMA).select("question", "answer", "error"),
    "question_translations": lambda spark, sf: questions.translated(_asked(spark, sf), questions.label_index(Catalog(spark, sf).triples, SCHEMA), SCHEMA).select("question", "target", "is_count", F.array_join("labels", "|").alias("labels"), (F.col("confidence") >= questions.GATE).alias("sure")),
}

ORACLE_SQL: dict[str, str] = {
    "code_entities": """WITH f AS (SELECT p_partkey AS k, p_size % 4 AS m, ['java', 'csharp', 'cpp', 'javascript', 'typescript', 'rust', 'go', 'c', 'css', 'html', 'python'][p_partkey % 11 + 1] AS language FROM part),
        outer_ AS (SELECT k, language, CASE language WHEN 'css' THEN 'media' WHEN 'html' THEN 'ul' ELSE 'C' || k END AS name,
            CASE WHEN language IN ('go', 'c') THEN 'struct' WHEN language = 'rust' THEN 'impl' WHEN language = 'css' THEN 'media_query' WHEN language = 'html' THEN 'element' ELSE 'class' END AS entity_type,
            NULL AS parent_entity, 2 AS line_start, CASE WHEN language IN ('go', 'c') THEN 2 ELSE 3 + m END AS line_end FROM f),
        inner_ AS (SELECT k, language, unnest(range(1, m + 1)) AS i FROM f)
        SELECT k::VARCHAR AS path, language, name, entity_type, parent_entity, line_start, line_end::INT AS line_end FROM outer_
        UNION ALL SELECT k::VARCHAR, language, CASE language WHEN 'css' THEN '.m' || i WHEN 'html' THEN 'li' ELSE 'm' || i END, CASE language WHEN 'css' THEN 'rule_set' WHEN 'html' THEN 'element' WHEN 'c' THEN 'function' ELSE 'method' END,
            CASE language WHEN 'css' THEN 'media' WHEN 'html' THEN 'ul' WHEN 'c' THEN NULL ELSE 'C' || k END, (2 + i)::INT, (2 + i)::INT FROM inner_
        UNION ALL SELECT k::VARCHAR, language, '<b' || k || '>', 'comment', NULL, 1, 1 FROM f WHERE language = 'html'""",
    "question_answers": """WITH a AS (
        SELECT 'Which suppliers are in ' || n_name || '?' AS question, 'http://example.org/supplier/' || s_suppkey AS answer FROM nation JOIN supplier ON s_nationkey = n_nationkey
        UNION ALL SELECT 'How many customers live in ' || lower(n_name) || ' ?', count(c_custkey)::VARCHAR FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name
        UNION ALL SELECT 'List the nations of the region ' || r_name || '.', 'http://example.org/nation/' || n_nationkey FROM region JOIN nation ON n_regionkey = r_regionkey
        UNION ALL SELECT DISTINCT 'parts supplied by ' || s_name, 'http://example.org/part/' || l_partkey FROM supplier JOIN lineitem ON l_suppkey = s_suppkey
        UNION ALL SELECT 'Number of suppliers that supply a "' || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') || '"', count(DISTINCT l_suppkey)::VARCHAR FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_name
        UNION ALL SELECT 'What suppliers of ' || n_name || ' are in ' || r_name || '?', 'http://example.org/supplier/' || s_suppkey FROM nation JOIN region ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey)
        SELECT question, answer, NULL AS error FROM a
        UNION ALL SELECT 'Which suppliers are in Atlantis ' || r_regionkey, NULL, 'it names nothing that the graph has' FROM region
        UNION ALL SELECT 'What is the weather in ' || r_name, NULL, 'it asks for no kind of thing that the graph has' FROM region""",
    "question_translations": """SELECT 'Which suppliers are in ' || n_name || '?' AS question, 'Supplier' AS target, false AS is_count, lower(n_name) AS labels, true AS sure FROM nation
        UNION ALL SELECT 'How many customers live in ' || lower(n_name) || ' ?', 'Customer', true, lower(n_name), true FROM nation
        UNION ALL SELECT 'List the nations of the region ' || r_name || '.', 'Nation', false, lower(r_name), true FROM region
        UNION ALL SELECT 'parts supplied by ' || s_name, 'Part', false, lower(s_name), true FROM supplier
        UNION ALL SELECT DISTINCT 'Number of suppliers that supply a "' || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') || '"', 'Supplier', true, p_name, true FROM part
        UNION ALL SELECT 'What suppliers of ' || n_name || ' are in ' || r_name || '?', 'Supplier', false, lower(n_name) || '|' || lower(r_name), true FROM nation, region
        UNION ALL SELECT 'Which suppliers are in Atlantis ' || r_regionkey, NULL, NULL, '', false FROM region
        UNION ALL SELECT 'What is the weather in ' || r_name, NULL, NULL, '', false FROM region""",
}
