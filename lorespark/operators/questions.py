"""Questions to SPARQL with the entities that they name, for a whole frame of questions at once.

The labels of the graph are an index: texts of names, lower-cased, with the classes of what bears them. The word
sequences of all questions are joined with it, and of overlapping hits in a question the longest stay. A question asks
for a class of things; what links it with each entity named is the shortest way through the graph's schema, of equally
short ones that whose predicates the question mentions. From this a query's algebra is built and written as text. To
answer, questions of one shape share a query: it leaves the names open, and its rows are joined with the questions'
labels, so the number of queries run is bounded by the schema and not by the number of questions. These queries begin
with the things that questions name, found once, and carry their labels, so a name is normalised once and not in each row.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.sources.tables import dealt, spread, written
from lorespark.sparql.compiler import Graph, lexical
from lorespark.sparql.parser import RDF_TYPE, SparqlError, parse

# --- fixed values: words that ask for a number
COUNT_WORDS = ("how many", "number of", "count")
# --- end of fixed values
#: Words of a label, at most.
LABEL_WORDS = 5
GATE = 0.7
#: What links things with the labels that questions name, in the queries that answer them.
LABEL = "urn:lorespark:label"


class SelectText:
    """A SELECT query put together from triples, values and filters, and its text."""

    def __init__(self):
        self.patterns: list[str] = []

    @staticmethod
    def iri(value: str) -> str:
        if any(c in '<>"{}|\\^`' or c <= " " for c in value):
            raise ValueError(f"no IRI: {value!r}")
        return f"<{value}>"

    @staticmethod
    def literal(value: str) -> str:
        escaped = value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
        return f'"{escaped}"'

    def triple(self, s: str, p: str, o: str) -> SelectText:
        self.patterns.append(f"{s} {p} {o} .")
        return self

    def values(self, variable: str, terms: list[str]) -> SelectText:
        self.patterns.append(f"VALUES {variable} {{ {' '.join(terms)} }}")
        return self

    def filter(self, expression: str) -> SelectText:
        self.patterns.append(f"FILTER({expression})")
        return self

    def text(self, *variables: str, distinct: bool = False, count: str | None = None, limit: int | None = None) -> str:
        head = " ".join(variables) if count is None else f"(COUNT(DISTINCT {count}) AS ?count)"
        return f"SELECT {'DISTINCT ' if distinct and count is None else ''}{head} WHERE {{ {' '.join(self.patterns)} }}" + (f" LIMIT {limit}" if limit is not None else "")


@dataclass(frozen=True)
class Schema:
    """What predicates link which classes, and the words for both; IRIs without their base."""

    base: str
    edges: tuple[tuple[str, str, str], ...]  # (predicate, class of the subject, class of the object)
    class_words: dict[str, tuple[str, ...]]
    predicate_words: dict[str, tuple[str, ...]] = field(default_factory=dict)
    name: str = "name"

    def way(self, start: str, end: str, text: str = "") -> list[tuple[str, bool]] | None:
        """The shortest way as (predicate, forwards); of equal ones that with most predicates mentioned, then the first by the order of edges."""
        best: dict[str, list[list[tuple[str, bool]]]] = {start: [[]]}
        waiting = deque([start])
        while waiting:
            at = waiting.popleft()
            for p, a, b in self.edges:
                for to, forwards in ([(b, True)] if a == at else []) + ([(a, False)] if b == at else []):
                    more = [[*w, (p, forwards)] for w in best[at]]
                    if to not in best:
                        best[to] = more
                        waiting.append(to)
                    elif len(best[to][0]) == len(more[0]):
                        best[to] += more
        return max(best[end], key=lambda w: self.told(w, text)) if end in best else None

    def told(self, way: list[tuple[str, bool]], text: str) -> int:
        """How many predicates of a way a text mentions."""
        return sum(any(x in text for x in self.predicate_words.get(p, ())) for p, _ in way)

    @staticmethod
    def discovered(triples: DataFrame, base: str) -> set[tuple[str, str, str]]:
        """The edges that triples have between typed things; as many rows as the schema has reach the driver."""
        kinds = triples.filter(F.col("p") == RDF_TYPE).select("s", F.col("o").alias("kind")).distinct()
        links = triples.filter((F.col("p") != RDF_TYPE) & (F.col("o_kind") == "uri"))
        out = links.join(kinds.withColumnRenamed("kind", "a"), "s").join(kinds.select(F.col("s").alias("o"), F.col("kind").alias("b")), "o").select("p", "a", "b").distinct()
        return {tuple(x.removeprefix(base) for x in r) for r in out.collect()}


def _words(question: Column) -> Column:
    bare = F.transform(F.split(F.lower(question), r"\s+"), lambda w: F.regexp_replace(w, r"^[^\w#]+|[^\w#]+$", ""))
    return F.filter(bare, lambda w: w != "")


def _normal(text: Column) -> Column:
    """A label: the words as questions are cut into, with single spaces."""
    return F.array_join(_words(text), " ")


def label_index(triples: DataFrame, schema: Schema) -> DataFrame:
    """(label, class, texts): each normalised name with a class that bears it and its spellings."""
    names = triples.filter(F.col("p") == schema.base + schema.name).select("s", F.col("o").alias("text"))
    kinds = triples.filter((F.col("p") == RDF_TYPE) & F.col("o").startswith(schema.base)).select("s", F.substring("o", len(schema.base) + 1, 1 << 20).alias("class"))
    return names.join(kinds, "s").groupBy(_normal(F.col("text")).alias("label"), "class").agg(F.sort_array(F.collect_set("text")).alias("texts"))


def linked(questions: DataFrame, index: DataFrame, longest: int = LABEL_WORDS) -> DataFrame:
    """(id, question, words, entities) for questions (id, question): entities (at, n, label, classes, texts) that do not overlap, longer ones first."""
    q = questions.select("id", "question", _words(F.coalesce("question", F.lit(""))).alias("words"))
    starts = F.when(F.size("words") > 0, F.sequence(F.lit(0), F.size("words") - 1)).otherwise(F.array().cast("array<int>"))
    grams = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("words") - i)), lambda n: F.struct(i.alias("at"), n.alias("n"), F.array_join(F.slice("words", i + 1, n), " ").alias("label")))))
    said = q.select("id", F.explode(grams).alias("g")).select("id", "g.*")
    by_label = index.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("class", "texts"))).alias("kinds"))
    asked = said.select("label").distinct()
    hits = said.join(by_label.join(asked, "label", "left_semi"), "label").groupBy("id").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "at", "n", "label", "kinds"))).alias("hits"))
    kind = "array<struct<less:int,at:int,n:int,label:string,kinds:array<struct<class:string,texts:array<string>>>>>"
    apart = F.aggregate("hits", F.array().cast(kind), lambda kept, h: F.when(F.exists(kept, lambda k: (h["at"] < k["at"] + k["n"]) & (k["at"] < h["at"] + h["n"])), kept).otherwise(F.concat(kept, F.array(h))))
    return q.join(hits, "id", "left").select("id", "question", "words", F.coalesce(F.array_sort(apart, lambda a, b: a["at"] - b["at"]), F.array().cast(kind)).alias("entities"))


def plan(words: list[str], entities: list[dict], schema: Schema) -> dict:
    """What a question means: target class, count or list, and for each entity its label, spellings, class and way; or an error."""
    inside = {i for e in entities for i in range(e["at"], e["at"] + e["n"])}
    text = " ".join(w for i, w in enumerate(words) if i not in inside)
    free = [w for i, w in enumerate(words) if i not in inside]
    target = next((c for w in free for c, named in schema.class_words.items() if w in named), None)
    if target is None:
        return {"error": "it asks for no kind of thing that the graph has"}
    if not entities:
        return {"error": "it names nothing that the graph has"}
    parts = []
    for e in entities:
        ways = [(schema.way(target, k["class"], text), k) for k in e["kinds"]]
        ways = [(w, k) for w, k in ways if w is not None]
        if not ways:
            return {"error": f"nothing links {target} with {e['label']}"}
        way, k = min(ways, key=lambda x: (-schema.told(x[0], text), not x[0], len(x[0])))
        parts.append({"label": e["label"], "texts": list(k["texts"]), "class": k["class"], "way": way})
    understood = (len(inside) + sum(any(w in named for named in (*schema.class_words.values(), *schema.predicate_words.values())) for w in free)) / max(1, len(words))
    parts.sort(key=lambda p: (p["class"], p["way"], p["label"]))
    return {"target": target, "count": any(c in text for c in COUNT_WORDS), "parts": parts, "understood": understood}


def query_text(meaning: dict, schema: Schema, open_names: bool = False, limit: int | None = None) -> str:
    """The SPARQL of a plan; with open_names the labels of its entities are variables ?label0, … of the result."""
    t, iri = SelectText(), lambda p: SelectText.iri(schema.base + p)
    t.triple("?x", SelectText.iri(RDF_TYPE), iri(meaning["target"]))
    for i, part in enumerate(meaning["parts"]):
        at = "?x"
        for j, (p, forwards) in enumerate(part["way"]):
            to = f"?v{i}_{j}"
            t.triple(*((at, iri(p), to) if forwards else (to, iri(p), at)))
            at = to
        t.triple(at, SelectText.iri(RDF_TYPE), iri(part["class"]))
        if open_names:
            t.triple(at, SelectText.iri(LABEL), f"?label{i}")
        else:
            t.triple(at, iri(schema.name), f"?name{i}").values(f"?name{i}", [SelectText.literal(x) for x in part["texts"]])
    if open_names:
        return t.text("?x", *(f"?label{i}" for i in range(len(meaning["parts"]))), distinct=True)
    return t.text("?x", distinct=True, count="?x" if meaning["count"] else None, limit=limit)


def _confidence(meaning: dict, errors: int) -> float:
    patterns = sum(len(p["way"]) + 1 for p in meaning.get("parts", ()))
    return max(0.0, min(1.0, 0.5 + 0.3 * meaning.get("understood", 0.0) - 0.1 * errors + min(0.05 * patterns, 0.2) + (0.1 if meaning.get("parts") else 0.0)))


_TRANSLATED = "id long, question string, sparql string, confidence double, error string, target string, is_count boolean, labels array<string>, shape string"


def translated(questions: DataFrame, index: DataFrame, schema: Schema) -> DataFrame:
    """One row per question (id, question): sparql, confidence, error, target, is_count, labels and shape.

    Questions that cannot be translated have an error and no sparql. Null and empty questions name nothing. Ids are
    distinct integers. Questions are dealt to tasks by their number, as a small frame of them is much work.
    """
    asked = written(questions.select(F.col("id").cast("long").alias("id"), "question"), "asked")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for id_, question, words, entities in zip(pdf.id, pdf.question, pdf.words, pdf.entities, strict=True):
                m = plan(list(words), [{**e, "kinds": list(e["kinds"])} for e in entities], schema)
                if "error" in m:
                    rows.append((id_, question, None, _confidence(m, 1), m["error"], None, None, [], None))
                    continue
                shape = {"target": m["target"], "count": m["count"], "parts": [{"class": p["class"], "way": p["way"]} for p in m["parts"]]}
                text = query_text(m, schema)
                try:
                    parse(text, {})
                except SparqlError as e:
                    rows.append((id_, question, None, _confidence(m, 1), str(e), None, None, [], None))
                    continue
                rows.append((id_, question, text, _confidence(m, 0), None, m["target"], m["count"], [p["label"] for p in m["parts"]], json.dumps(shape)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _TRANSLATED.split(", ")])

    return spread(linked(asked, index), asked.count(), "id", "question", each=1 << 10).mapInPandas(run, _TRANSLATED)


def _with_labels(graph: Graph, known: DataFrame, schema: Schema) -> Graph:
    """The graph, and a triple with LABEL for each name that a question asks for; joins begin with these."""
    asked = known.select(F.explode("labels").alias("o")).distinct()
    names = graph.triples.filter(F.col("p") == schema.base + schema.name).select("s", _normal(F.col("o")).alias("o"))
    none = F.lit(None).cast("string")
    labels = written(names.join(asked, "o", "left_semi").select("s", "o"), "labels").select("s", F.lit(LABEL).alias("p"), "o", F.lit("literal").alias("o_kind"), none.alias("o_type"), none.alias("o_lang"))
    return Graph(graph.triples.select(*labels.columns).unionByName(labels), graph.prefixes, graph.counts | {LABEL: 1}, rows=graph.rows)


def answered(graph: Graph, questions: DataFrame, schema: Schema, index: DataFrame | None = None) -> DataFrame:
    """(id, question, answer, error): an IRI for each thing asked for, a number for questions of how many, an error where there is one.

    Questions of one shape are answered by one query. A list without anything has no row; a count has one, with 0. The
    triples may be repeated; ids are distinct.
    """
    index = label_index(graph.triples, schema) if index is None else index
    known = written(translated(questions, index, schema), "translated")
    shapes = [r[0] for r in known.filter("shape is not null").select("shape").distinct().collect()]  # bounded by the schema
    parts = [known.filter("error is not null").select("id", "question", F.lit(None).cast("string").alias("answer"), "error")]
    labelled = _with_labels(graph, known, schema) if shapes else graph
    for shape in sorted(shapes):
        m = json.loads(shape)
        labels = [f"label{i}" for i in range(len(m["parts"]))]
        rows = labelled.query(query_text(m, schema, open_names=True))  # a set
        mine = known.filter(F.col("shape") == shape).select("id", "question", *(F.concat(F.lit('"'), F.col("labels")[i], F.lit('"')).alias(c) for i, c in enumerate(labels)))
        if m["count"]:
            found = mine.join(rows.groupBy(*labels).agg(F.count("x").alias("n")), labels, "left").withColumn("answer", F.coalesce("n", F.lit(0)).cast("string"))
        else:
            many = max((graph.rows.get(schema.base + p, 0) for part in m["parts"] for p, _ in part["way"]), default=0)
            found = mine.join(dealt(rows, many, *labels), labels).withColumn("answer", lexical(F.col("x")))
        parts.append(found.select("id", "question", "answer", F.lit(None).cast("string").alias("error")))
    return reduce(DataFrame.unionByName, parts)


def suggestions(index: DataFrame, beginning: str, limit: int = 10) -> DataFrame:
    """(label, class): names in the graph that begin like this, in order."""
    return index.filter(F.startswith("label", _normal(F.lit(beginning)))).select("label", "class").orderBy("label", "class").limit(limit)
