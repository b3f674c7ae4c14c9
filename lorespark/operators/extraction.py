"""Entities and imports out of source text."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.functions.text import ENTITY_PATTERNS, called_names, strip

_ENTITY = "path string, name string, entity_type string, parent_entity string, signature string, line_start int, line_end int, is_async boolean, has_docstring boolean, calls array<string>, imports array<string>"


def pattern_entities(files: DataFrame, language: str) -> DataFrame:
    """(path, type, line, content) of lines that match a pattern of the language; lines count from 1."""
    lines = files.select("path", F.posexplode(F.split("content", "\n", -1)).alias("n", "text"))
    rules = F.array(*(F.when(F.regexp_like(F.col("text"), F.lit(p)), F.lit(kind)) for kind, p in ENTITY_PATTERNS.get(language, ()))) if language in ENTITY_PATTERNS else F.array().cast("array<string>")
    found = lines.select("path", (F.col("n") + 1).alias("line"), "text", F.explode(F.array_compact(rules)).alias("type"))
    return found.select("path", "type", "line", F.left(strip(F.col("text")), F.lit(100)).alias("content"))


def python_entities(files: DataFrame) -> DataFrame:
    """Functions, methods and classes of Python files (path, content) by their syntax trees; files that do not parse have none."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _ENTITY.split(", ")]
        for pdf in batches:
            rows = []
            for path, text in zip(pdf.path, pdf.content, strict=True):
                try:
                    tree = ast.parse(text or "")
                except (SyntaxError, ValueError, RecursionError):
                    continue
                imports = sorted({a.name for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names} | {n.module for n in ast.walk(tree) if isinstance(n, ast.ImportFrom) and n.module})
                todo = [(n, None) for n in tree.body]
                while todo:
                    n, parent = todo.pop(0)
                    if not isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                        continue
                    is_class = isinstance(n, ast.ClassDef)
                    called = sorted({c.func.id if isinstance(c.func, ast.Name) else c.func.attr for c in ast.walk(n) if isinstance(c, ast.Call) and isinstance(c.func, (ast.Name, ast.Attribute))})
                    bases = ", ".join(map(ast.unparse, n.bases)) if is_class else ast.unparse(n.args)
                    kind = "class" if is_class else "method" if parent else "function"
                    rows.append((path, n.name, kind, parent, f"{n.name}({bases})", n.lineno, n.end_lineno, isinstance(n, ast.AsyncFunctionDef), ast.get_docstring(n) is not None, [] if is_class else called, imports))
                    if is_class:
                        todo += [(m, n.name) for m in n.body]
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(parse, _ENTITY)


def call_targets(calls: DataFrame, text: Column) -> DataFrame:
    return calls.withColumn("target", F.explode(called_names(text)))


def page_links(pages: DataFrame) -> DataFrame:
    """(source_id, target) of every link of a page (page_id, html)."""
    return pages.select(F.col("page_id").alias("source_id"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("target"))


def import_candidates(name: Column) -> Column:
    """The names an import may go by, the likeliest first."""
    bare = F.regexp_replace(name, r"^(\.{1,2}/)+", "")
    last = F.element_at(F.split(bare, r"\."), -1)
    return F.array_distinct(F.array(name, F.concat(F.lit("class_"), name), F.concat(F.lit("function_"), name), last, F.concat(last, F.lit("."), last), bare))


def enrichment_candidates(entities: DataFrame) -> DataFrame:
    """Entities of 50 to 8000 characters that have no summary yet, each content once."""
    kinds = ("function", "class", "module", "interface", "struct", "enum", "method", "property", "variable", "constant", "html_element", "css_rule", "docstring", "other")
    wanted = entities.filter(F.col("entity_type").isin(*kinds) & F.length("content").between(50, 8000) & F.col("summary").isNull())
    return wanted.withColumn("content_hash", F.sha2("content", 256))


def enriched(entities: DataFrame, analyses: DataFrame) -> DataFrame:
    """entities with the summary of analyses (content_hash, summary) where they have none."""
    a = analyses.select("content_hash", F.col("summary").alias("__new"))
    return entities.withColumn("content_hash", F.sha2("content", 256)).join(a, "content_hash", "left").withColumn("summary", F.coalesce("summary", "__new")).drop("__new", "content_hash")
