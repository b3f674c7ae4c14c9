"""Reading and writing graphs, query results and files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions.text import language
from lorespark.sparql.compiler import datatype, is_literal, lexical

MAX_FILE = 1 << 20


# --- triples
def from_nested(docs: DataFrame) -> DataFrame:
    """Triples of documents with an array rdf_triples of (subject, predicate, object, object_type)."""
    t = docs.select(F.explode("rdf_triples").alias("t")).select("t.*")
    kind = F.when(F.col("object_type") == "literal", "literal").otherwise("uri")
    return t.select(F.col("subject").alias("s"), F.col("predicate").alias("p"), F.col("object").alias("o"), kind.alias("o_kind"), F.lit(None).cast("string").alias("o_type"), F.lit(None).cast("string").alias("o_lang")).filter("s is not null and p is not null and o is not null")


def from_documents(docs: DataFrame) -> DataFrame:
    """Triples of documents (type, subject, predicate, object): of type rdf_triple and complete; objects in quotes are literals with or without a type."""
    rows = docs.filter((F.col("type") == "rdf_triple") & F.col("subject").isNotNull() & F.col("predicate").isNotNull() & F.col("object").isNotNull())
    o = F.col("object")
    typed = F.regexp_extract(o, r'(?s)^"?(.*?)"?\^\^<?([^>"]*)>?$', 2)
    is_iri = F.regexp_like(o, F.lit(r"^(https?://|urn:)")) & ~o.startswith('"')
    kind = F.when(is_iri, "uri").when(o.startswith("_:"), "bnode").otherwise("literal")
    text = F.when(typed != "", F.regexp_extract(o, r'(?s)^"?(.*?)"?\^\^<?([^>"]*)>?$', 1)).otherwise(F.regexp_replace(o, r'^"+|"+$', ""))
    return rows.select(F.col("subject").alias("s"), F.col("predicate").alias("p"), F.when(kind == "literal", text).otherwise(o).alias("o"), kind.alias("o_kind"), F.when((kind == "literal") & (typed != ""), typed).alias("o_type"), F.lit(None).cast("string").alias("o_lang"))


def _escaped(c: Column) -> Column:
    for raw, mark in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(raw), F.lit(mark))
    return c


def _node(c: Column) -> Column:
    return F.when(c.startswith("_:"), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))


def _object(prefix: str = "") -> Column:
    o, kind, type_, lang = (F.col(prefix + c) for c in ("o", "o_kind", "o_type", "o_lang"))
    tail = F.when(lang.isNotNull(), F.concat(F.lit("@"), lang)).when(type_.isNotNull() & ~type_.endswith("#string"), F.concat(F.lit("^^<"), type_, F.lit(">"))).otherwise("")
    return F.when(kind == "literal", F.concat(F.lit('"'), _escaped(o), F.lit('"'), tail)).otherwise(_node(o))


def n_triples(triples: DataFrame) -> DataFrame:
    """One line of N-Triples a row."""
    return triples.select(F.concat_ws(" ", _node(F.col("s")), F.concat(F.lit("<"), F.col("p"), F.lit(">")), _object(), F.lit(".")).alias("value"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, pairs) of rows (hash, node, pair) in the order of their hashes: the different pairs of a node, in order."""

    def joined(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        t = t.take(pc.sort_indices(t, [("hash", "ascending"), ("node", "ascending"), ("pair", "ascending")])).combine_chunks()
        nodes, pairs = (pa.concat_arrays(t.column(c).chunks) for c in ("node", "pair"))
        new = np.ones(len(nodes), bool)
        new[1:] = pc.not_equal(nodes[1:], nodes[:-1]).to_numpy(zero_copy_only=False)
        kept = new.copy()
        kept[1:] |= pc.not_equal(pairs[1:], pairs[:-1]).to_numpy(zero_copy_only=False)
        ends = np.append((np.cumsum(kept) - 1)[new], kept.sum())
        listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs.filter(pa.array(kept)))
        return pa.RecordBatch.from_arrays([nodes.filter(pa.array(new)), pc.binary_join(listed, " ;\n    ")], ["node", "pairs"])

    held, last = [], None  # rows of the last hash, which may go on
    for b in batches:
        if not b.num_rows:
            continue
        hashes = b.column("hash").to_numpy()
        cut = int(np.searchsorted(hashes, hashes[-1]))
        if held and (cut or hashes[0] != last):
            yield joined([*held, b[:cut]])
            held = []
        elif cut:
            yield joined([b[:cut]])
        held.append(b[cut:])
        last = hashes[-1]
    if held:
        yield joined(held)


def turtle(triples: DataFrame) -> DataFrame:
    """One block of Turtle a subject; repeated triples count once.

    Rows are sorted by a hash of the subject, a number, and blocks are joined from Arrow batches of them: sets of objects
    a subject, which Spark sorts by the whole strings, take longer.
    """
    pair = F.concat_ws(" ", F.concat(F.lit("<"), F.col("p"), F.lit(">")), _object())
    rows = triples.select(F.xxhash64("s").alias("hash"), F.coalesce(_node(F.col("s")), F.lit("")).alias("node"), pair.alias("pair"))
    blocks = rows.repartition("hash").sortWithinPartitions("hash").mapInArrow(_blocks, "node string, pairs string")
    return blocks.select(F.when(F.col("node") != "", F.concat("node", F.lit(" "), "pairs", F.lit(" ."))).alias("value"))


def json_ld(triples: DataFrame) -> DataFrame:
    """One JSON object a subject, its predicates as lists of values."""
    v = F.when(F.col("o_kind") == "literal", F.to_json(F.struct(F.col("o").alias("@value"), F.col("o_type").alias("@type"), F.col("o_lang").alias("@language")))).otherwise(F.to_json(F.struct(F.col("o").alias("@id"))))
    by_p = triples.groupBy("s", "p").agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_set(v)), ","), F.lit("]")).alias("values"))
    entry = F.concat(F.lit('"'), _escaped(F.col("p")), F.lit('":'), F.col("values"))
    return by_p.groupBy("s").agg(F.array_join(F.array_sort(F.collect_list(entry)), ",").alias("body")).select(F.concat(F.lit('{"@id":"'), _escaped(F.col("s")), F.lit('",'), F.col("body"), F.lit("}")).alias("value"))


def rdf_xml(triples: DataFrame) -> DataFrame:
    """One rdf:Description a triple, without the enclosing element."""
    safe = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    space, name = F.regexp_extract("p", "^(.*[/#])([^/#]*)$", 1), F.regexp_extract("p", "^(.*[/#])([^/#]*)$", 2)
    inside = F.when(F.col("o_kind") == "literal", F.concat(F.lit(">"), safe(F.col("o")), F.lit("</p:"), name, F.lit(">"))).otherwise(F.concat(F.lit(' rdf:resource="'), safe(F.col("o")), F.lit('"/>')))
    return triples.select(F.concat(F.lit('<rdf:Description rdf:about="'), safe(F.col("s")), F.lit('"><p:'), name, F.lit(' xmlns:p="'), safe(space), F.lit('"'), inside, F.lit("</rdf:Description>")).alias("value"))


SERIALIZERS = {"nt": n_triples, "turtle": turtle, "n3": turtle, "json-ld": json_ld, "xml": rdf_xml}


def export(triples: DataFrame, path: str, kind: str = "nt") -> None:
    SERIALIZERS[kind](triples).write.mode("overwrite").text(path)


# --- query results
def sparql_json(result: DataFrame) -> DataFrame:
    """One JSON binding a row; unbound variables are left out."""

    def bound(name: str) -> Column:
        c = F.col(f"`{name}`")
        kind = F.when(is_literal(c), F.when(datatype(c).endswith("#string"), "literal").otherwise("typed-literal")).when(c.startswith("_:"), "bnode").otherwise("uri")
        return F.when(c.isNotNull(), F.struct(kind.alias("type"), lexical(c).alias("value"), F.when(kind == "typed-literal", datatype(c)).alias("datatype"))).alias(name)

    return result.select(F.to_json(F.struct(*map(bound, result.columns))).alias("value"))


def json_document(result: DataFrame, most: int = 10_000) -> str:
    """The whole SPARQL-JSON document of at most so many rows."""
    rows = [r[0] for r in sparql_json(result).limit(most).collect()]
    names = ",".join(f'"{c}"' for c in result.columns)
    return f'{{"head":{{"vars":[{names}]}},"results":{{"bindings":[{",".join(rows)}]}}}}'


def _cell(c: Column) -> Column:
    text = F.coalesce(lexical(c), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(F.regexp_like(text, F.lit('[,"]')), quoted).otherwise(text)


def csv_lines(result: DataFrame) -> DataFrame:
    """Quoted only where a comma or a quote stands; unbound is empty."""
    return result.select(F.concat_ws(",", *(_cell(F.col(f"`{c}`")) for c in result.columns)).alias("value"))


def tsv_lines(result: DataFrame) -> DataFrame:
    return result.select(F.concat_ws("\t", *(F.coalesce(lexical(F.col(f"`{c}`")), F.lit("")) for c in result.columns)).alias("value"))


def nodes_and_edges(result: DataFrame, most: int = 100) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a result by the endings of its column names."""
    few = result.limit(most)
    ends = [c for c in few.columns if c.endswith(("_subject", "_entity")) or c in ("s", "o", "subject", "object")]
    nodes = few.select(F.explode(F.array(*(lexical(F.col(f"`{c}`")) for c in ends))).alias("id")).filter("id is not null").distinct().withColumn("label", F.element_at(F.split("id", "[/#]"), -1))
    links = [c for c in few.columns if c.endswith(("_relationship", "_predicate")) or c in ("p", "predicate")]
    label = lexical(F.col(f"`{links[0]}`")) if links else F.lit("related")
    edges = few.select(lexical(F.col(f"`{ends[0]}`")).alias("source"), lexical(F.col(f"`{ends[-1]}`")).alias("target"), label.alias("label")) if len(ends) > 1 else None
    return nodes, edges


# --- files
def source_files(spark: SparkSession, path: str, skip: tuple[str, ...] = (".git", "node_modules", "__pycache__", "venv", "dist", "build")) -> DataFrame:
    """(path, language, content) of text files in a known language, of 1 MB at most, outside of skipped folders.

    A file is binary if its first kilobyte holds a NUL byte or under 75 % printable characters.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter((F.col("length") <= MAX_FILE) & F.col("length").isNotNull())
    for s in skip:
        files = files.filter(~F.contains("path", F.lit(f"/{s}/")))
    head = F.decode(F.substring("content", 1, 1024), "ISO-8859-1")
    printable = F.length(F.regexp_replace(head, r"[^\x09\x0a\x0d\x20-\x7e\x80-\xff]", ""))
    text = ~F.contains(head, F.lit("\x00")) & (printable >= 0.75 * F.length(head))
    known = files.withColumn("language", language(F.col("path"))).filter(F.col("language").isNotNull() & text)
    utf8 = F.expr("try_validate_utf8(cast(content as string))")
    return known.select("path", "language", F.coalesce(utf8, F.decode("content", "ISO-8859-1")).alias("content"))


def backup(tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Write every table as JSON lines; (name, rows) of what was written."""
    spark = next(iter(tables.values())).sparkSession
    counts = []
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")
        counts.append((name, spark.read.text(f"{folder}/{name}").count()))
    return spark.createDataFrame(counts, "name string, rows long")
