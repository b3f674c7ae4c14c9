"""One object with all the tools of the knowledge base, over tables given by name."""

from __future__ import annotations

import hashlib
import time
import uuid
from concurrent.futures import ThreadPoolExecutor, wait
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions.scoring import importance
from lorespark.functions.text import entity_names
from lorespark.operators import fusion, graph, memory, questions, retrieval, routing
from lorespark.sources import formats
from lorespark.sources.tables import written
from lorespark.sparql import Graph, SparqlError


@dataclass
class Stats:
    queries: int = 0
    hits: int = 0
    seconds: float = 0.0
    errors: int = 0


#: How sure strategies are of what they find.
CONFIDENCE = {"vector": 0.9, "database": 0.85, "graph": 0.8}


@dataclass
class Outcome:
    strategy: str
    rows: list[tuple]
    confidence: float
    error: str | None


@dataclass
class Engine:
    """tables: documents (id, content, embedding), nodes, edges, triples, memory, interactions; those that a tool needs must be there.

    Query results are kept for ttl seconds by a key of text, bindings and form; what is kept is the plan's persisted
    frame. embed turns a text into a vector; without one hashed words are used.
    """

    spark: SparkSession
    tables: dict[str, DataFrame]
    prefixes: dict[str, str] = field(default_factory=dict)
    ttl: int = 3600
    embed: object = None
    dimension: int = 64

    def __post_init__(self):
        self.graph = Graph(self.tables["triples"], self.prefixes) if "triples" in self.tables else None
        self.translator = routing.Translator(self.prefixes)
        self.stats = Stats()
        self._kept: dict[str, tuple[float, DataFrame]] = {}
        self._outcomes: list[Outcome] = []
        self._labels: dict[str, DataFrame] = {}

    # --- queries over triples
    def sparql(self, text: str, bindings: dict[str, str] | None = None, limit: int | None = None, form: str | None = None) -> DataFrame:
        """The result as terms, or as lines of json, csv, tsv, nt, turtle, xml or json-ld."""
        key = hashlib.sha256(repr((text, sorted((bindings or {}).items()), limit, form)).encode()).hexdigest()
        now = time.monotonic()
        self.stats.queries += 1
        if key in self._kept and self._kept[key][0] > now:
            self.stats.hits += 1
            return self._kept[key][1]
        for old in [k for k, (until, _) in self._kept.items() if until <= now]:
            self._kept.pop(old)[1].unpersist()
        try:
            out = self.graph.query(text, bindings, limit)
            if form in ("json", "csv", "tsv"):
                out = {"json": formats.sparql_json, "csv": formats.csv_lines, "tsv": formats.tsv_lines}[form](out)
            elif form is not None:
                out = formats.SERIALIZERS[form](_as_triples(out))
        except SparqlError:
            self.stats.errors += 1
            raise
        self.stats.seconds += time.monotonic() - now
        self._kept[key] = (now + self.ttl, out.persist())
        return out

    def validate(self, text: str) -> list[str]:
        return self.translator.validate(text)

    def clear_cache(self) -> int:
        for _, df in self._kept.values():
            df.unpersist()
        n, self._kept = len(self._kept), {}
        return n

    def ask(self, question: str, limit: int | None = None) -> tuple[routing.Translation, DataFrame | None]:
        """The translation of a question, and its result if the translation is sure and free of errors."""
        found = self.translator.translate(question, limit)
        return found, self.sparql(found.sparql) if found.executable else None

    def label_index(self, schema: questions.Schema) -> DataFrame:
        """The names in the graph, written once for a schema."""
        if schema.base not in self._labels:
            self._labels[schema.base] = written(questions.label_index(self.graph.triples, schema), "labels")
        return self._labels[schema.base]

    def translate_batch(self, asked: DataFrame, schema: questions.Schema) -> DataFrame:
        """Questions (id, question) with their SPARQL, confidence and error, a row each."""
        return questions.translated(asked, self.label_index(schema), schema)

    def answer_batch(self, asked: DataFrame, schema: questions.Schema) -> DataFrame:
        """Answers of questions (id, question): (id, answer, error)."""
        return questions.answered(self.graph, asked, schema, self.label_index(schema))

    def suggest(self, beginning: str, schema: questions.Schema, limit: int = 10) -> DataFrame:
        return questions.suggestions(self.label_index(schema), beginning, limit)

    def discover_schema(self, type_: str | None = None) -> dict[str, DataFrame]:
        t = self.tables["triples"]
        out = {"types": graph.type_counts(t), "predicates": graph.predicate_counts(t)}
        return out if type_ is None else out | {"properties": graph.properties_of_type(t, type_)}

    def visualize(self, result: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        return formats.nodes_and_edges(result)

    # --- retrieval
    def vector(self, text: str) -> list[float]:
        if self.embed is not None:
            return list(self.embed(text))
        row = self.spark.createDataFrame([(text,)], "t string").select(retrieval.hashed_embeddings(self.dimension)(F.col("t"))).first()
        return list(row[0])

    def vector_search(self, text: str, limit: int = retrieval.LIMIT, threshold: float = 0.7) -> DataFrame:
        return retrieval.vector_search(self.tables["nodes"], self.vector(text), limit, threshold)

    def hierarchical_search(self, text: str, **scope) -> DataFrame:
        return retrieval.hierarchical_search(self.tables["nodes"], self.vector(text), **scope)

    def hybrid_search(self, text: str) -> DataFrame:
        return retrieval.hybrid_search(self.tables["documents"], text, self.vector(text))

    def rerank(self, text: str, results: DataFrame, limit: int = retrieval.RERANKED) -> DataFrame:
        return retrieval.rerank(results, text, limit)

    def code_graph(self, node, relationship: str = "all") -> DataFrame:
        near = graph.neighbours(self.tables["edges"], node, relationship)
        return self.tables["nodes"].join(near, "id", "left_semi")

    def children(self, node) -> DataFrame:
        return graph.children(self.tables["nodes"], node)

    def parents(self, node, max_depth: int | None = None) -> DataFrame:
        return graph.ancestors(self.tables["nodes"], node, max_depth)

    def siblings(self, node) -> DataFrame:
        return graph.siblings(self.tables["nodes"], node)

    def stats_of_repository(self) -> DataFrame:
        return graph.repository_stats(self.tables["nodes"], self.tables["edges"])

    # --- fusion and orchestration
    def process_query(self, text: str, intent: str = "HYBRID", confidence: float = 1.0, enough: int = 10, parallel: bool = True, timeout: float = 30.0) -> DataFrame:
        """Results of the strategies for an intent: (strategy, id, content, score); outcomes() tells how each of them went."""
        names = routing.strategies(intent, confidence)
        self._outcomes = self._side_by_side(names, text, enough, timeout) if parallel else self._one_by_one(names, text, enough)
        rows = [(*row, o.strategy) for o in self._outcomes for row in o.rows]
        return self.spark.createDataFrame(rows, "id string, content string, score double, strategy string")

    def outcomes(self) -> DataFrame:
        """(strategy, success, n, confidence, error) of the last process_query(); strategies that were not run have no row."""
        rows = [(o.strategy, o.error is None, len(o.rows), o.confidence, o.error) for o in self._outcomes]
        return self.spark.createDataFrame(rows, "strategy string, success boolean, n int, confidence double, error string")

    def _outcome(self, name: str, text: str, enough: int, tag: str | None = None) -> Outcome:
        if tag is not None:
            self.spark.sparkContext.addJobTag(tag)
        try:
            rows = [tuple(r) for r in self._run(name, text, enough).collect()]  # `enough` rows at most
        except Exception as e:  # noqa: BLE001  a strategy that fails must not take the others with it
            return Outcome(name, [], 0.0, f"{type(e).__name__}: {e}".splitlines()[0])
        return Outcome(name, rows, CONFIDENCE.get(name, 0.8) if rows else 0.0, None)

    def _side_by_side(self, names: list[str], text: str, enough: int, timeout: float) -> list[Outcome]:
        """All strategies at once; the jobs of those that are not done in time are cancelled."""
        tags = {name: f"{name}-{uuid.uuid4().hex}" for name in names}
        pool = ThreadPoolExecutor(max(1, len(names)))
        try:
            running = {name: pool.submit(self._outcome, name, text, enough, tags[name]) for name in names}
            done, _ = wait(running.values(), timeout)
            late = [name for name in names if running[name] not in done]
            for name in late:
                self.spark.sparkContext.cancelJobsWithTag(tags[name])
            return [Outcome(name, [], 0.0, f"not done in {timeout:g} s") if name in late else running[name].result() for name in names]
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    def _one_by_one(self, names: list[str], text: str, enough: int) -> list[Outcome]:
        """One strategy after another, until one brings enough rows with a confidence above 0.8."""
        out = []
        for name in names:
            out.append(self._outcome(name, text, enough))
            if out[-1].error is None and len(out[-1].rows) >= enough and out[-1].confidence > 0.8:
                break
        return out

    def _run(self, name: str, text: str, n: int) -> DataFrame:
        shape = lambda df, content, score: df.select(F.col("id").cast("string").alias("id"), content.alias("content"), score.cast("double").alias("score")).limit(n)
        if name == "vector":
            return shape(retrieval.vector_search(self.tables["documents"], self.vector(text), n, None), F.col("content"), F.col("score"))
        if name == "database":
            names = self.spark.createDataFrame([(text,)], "t string").select(entity_names(F.col("t"))).first()[0]
            words = [w.lower() for w in names] or [w for w in text.lower().split() if len(w) > 2][:3] or [text.lower()]
            found = self.tables["documents"]
            hit = F.lit(False)
            for w in words:
                hit = hit | F.contains(F.lower("content"), F.lit(w))
            return shape(found.filter(hit).orderBy("id"), F.col("content"), F.lit(0.85))
        t, result = self.ask(text, n)
        if result is None:
            raise SparqlError("; ".join(t.errors) or "not sure enough")
        first = F.col(f"`{result.columns[0]}`")
        return shape(result.withColumn("id", first), F.concat_ws(" ", *(F.col(f"`{c}`") for c in result.columns)), F.lit(0.8))

    def aggregate_results(self, sources: DataFrame, query_vector: list[float], now: Column, strategy: str = "balanced", config: fusion.FusionConfig = fusion.FusionConfig()) -> DataFrame:
        """Extract, remove copies and near copies, score, and choose."""
        items = fusion.without_copies(fusion.extracted(sources))
        items = fusion.without_near_copies(items, config.similarity_threshold)
        return fusion.fused(fusion.scored(items, F.array(*map(F.lit, query_vector)), now), strategy, config)

    def rank_context(self, items: DataFrame, query_vector: list[float], now: Column, config: fusion.FusionConfig = fusion.FusionConfig()) -> DataFrame:
        return fusion.fused(fusion.scored(items, F.array(*map(F.lit, query_vector)), now), "balanced", config)

    # --- memory
    def save_memory(self, session, content: str, kind: str, now: Column) -> None:
        row = self.spark.createDataFrame([(session, kind, content)], self.tables["memory"].select("session_id", "type", "content").schema)
        self.tables["memory"] = self.tables["memory"].unionByName(memory.memories(row, now), allowMissingColumns=True)

    def retrieve_memory(self, session, query: str, limit: int = 10) -> DataFrame:
        held = self.tables["memory"]
        if "importance" not in held.columns:
            held = held.withColumn("importance", importance(F.col("content"), F.col("type")))
        return memory.retrieve(held, held, session, query, limit)

    def clear_memory(self, session) -> None:
        self.tables["memory"] = memory.cleared(self.tables["memory"], session)

    # --- learning
    def session_state(self) -> DataFrame:
        return memory.feedback_ratios(self.tables["interactions"])


def _as_triples(terms: DataFrame) -> DataFrame:
    """CONSTRUCT and DESCRIBE results as rows of a graph."""
    from lorespark.sparql.compiler import datatype, is_literal, lexical

    o = F.col("o")
    kind = F.when(is_literal(o), "literal").when(o.startswith("_:"), "bnode").otherwise("uri")
    return terms.select("s", "p", lexical(o).alias("o"), kind.alias("o_kind"), datatype(o).alias("o_type"), F.lit(None).cast("string").alias("o_lang"))
