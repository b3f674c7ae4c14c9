"""Routing of questions: keyword router, intents, strategies, and translation to SPARQL by templates."""

from __future__ import annotations

import random
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions.scoring import translation_confidence
from lorespark.functions.text import any_keyword, keyword_hits
from lorespark.sparql.parser import SparqlError, parse

# --- fixed values: words that decide
GRAPH_WORDS = ("dependencies", "depends on", "uses", "used by", "relationships", "connects to", "imports", "imported by", "related to", "hierarchy", "children", "parents", "graph", "network", "architecture")
VECTOR_WORDS = ("similar", "like", "resembles", "related concepts", "semantic search", "find similar", "similar to", "comparable", "equivalent")
TEMPLATE_WORDS = {
    "function_calls": (("calls", "invokes", "function", "method", "procedure"), 0.9),
    "inheritance_hierarchy": (("inherits", "extends", "class", "inheritance", "parent", "child"), 0.85),
    "dependency_analysis": (("imports", "depends", "uses", "module", "package", "dependency"), 0.8),
}
ENTITY_WORDS = {"function": ("function", "method", "procedure", "routine"), "class": ("class", "type", "object"), "module": ("module", "package", "namespace", "library"), "variable": ("variable", "field", "property"), "interface": ("interface", "contract", "protocol"), "package": ("package", "bundle", "component")}
RELATION_WORDS = {"calls": ("calls", "invokes", "executes"), "inherits": ("inherits", "extends", "derives"), "implements": ("implements", "realizes"), "imports": ("imports", "includes", "uses"), "uses": ("uses", "utilizes", "employs"), "references": ("references", "refers", "points"), "dependsOn": ("depends", "requires", "needs"), "contains": ("contains", "includes", "has")}
DIAGRAM_WORDS = {
    "flowchart": ("process", "workflow", "flow", "step", "procedure", "algorithm", "decision", "if", "then", "loop"),
    "sequenceDiagram": ("interaction", "communication", "sequence", "message", "api", "request", "response", "call", "exchange"),
    "classDiagram": ("class", "object", "inheritance", "extends", "implements", "relationship", "association", "composition", "aggregation"),
    "erDiagram": ("database", "table", "entity", "relationship", "schema", "foreign key", "primary key", "one-to-many", "many-to-many"),
    "gitgraph": ("git", "branch", "merge", "commit", "version control", "feature branch", "release", "hotfix"),
    "journey": ("user journey", "customer journey", "experience", "touchpoint", "user flow", "persona", "interaction path"),
    "gantt": ("timeline", "schedule", "project", "milestone", "task", "duration", "deadline", "phases", "deliverable"),
}
INTENTS = ("GRAPH_RAG", "VECTOR_RAG", "DATABASE_RAG", "HYBRID")
CONFIDENT, GATE = 0.7, 0.7
# --- end of fixed values


def route(question: Column) -> Column:
    """By parts of words: graph words first, then vector words, else the database."""
    return F.when(any_keyword(question, GRAPH_WORDS), "graph_rag").when(any_keyword(question, VECTOR_WORDS), "vector_rag").otherwise("database_rag")


def template_match(question: Column) -> Column:
    """(template, score) of the best template; null if no word of any occurs. Of equals the first by name of the list wins."""
    options = [F.struct((keyword_hits(question, words) / len(words) * weight).alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("template")) for i, (name, (words, weight)) in enumerate(TEMPLATE_WORDS.items())]
    best = F.greatest(*options)
    return F.when(best["score"] > 0, F.struct(best["template"].alias("template"), best["score"].alias("score")))


def named_things(question: Column, words: dict[str, tuple[str, ...]]) -> Column:
    """The kinds of which a word occurs, in the order of the table."""
    return F.array_compact(F.array(*(F.when(any_keyword(question, w), F.lit(k)) for k, w in words.items())))


def diagram_type(description: Column) -> Column:
    """The type with most words in the description, the first of equals; a flow chart if there are none."""
    options = [F.struct(keyword_hits(description, w).alias("n"), F.lit(-i).alias("order"), F.lit(k).alias("type")) for i, (k, w) in enumerate(DIAGRAM_WORDS.items())]
    best = F.greatest(*options)
    return F.when(best["n"] > 0, best["type"]).otherwise("flowchart TD")


def strategies(intent: str, confidence: float, multi_source: bool = False, max_sources: int = 3) -> list[str]:
    """What to ask: by intent; all for HYBRID; others too if the intent is unsure or several sources are wanted."""
    own = {"GRAPH_RAG": "graph", "VECTOR_RAG": "vector", "DATABASE_RAG": "database"}
    every = list(own.values())
    if intent == "HYBRID":
        return every[:max_sources]
    chosen = [own.get(intent, "vector")]
    if confidence < 0.8 or multi_source:
        chosen += [s for s in every if s not in chosen][: max(0, max_sources - 1)]
    return chosen


def strategy_column(intent: Column, confidence: Column) -> Column:
    """strategies() as a column, joined by commas."""
    first = F.when(intent == "GRAPH_RAG", "graph").when(intent == "DATABASE_RAG", "database").otherwise("vector")
    every = F.array(F.lit("graph"), F.lit("vector"), F.lit("database"))
    chosen = F.when(intent == "HYBRID", every).when(confidence < 0.8, F.concat(F.array(first), F.array_remove(every, first))).otherwise(F.array(first))
    return F.array_join(chosen, ",")


@dataclass
class Translation:
    question: str
    sparql: str | None
    template: str | None
    confidence: float
    errors: list[str] = field(default_factory=list)
    explanation: str = ""
    alternatives: list[str] = field(default_factory=list)

    @property
    def executable(self) -> bool:
        return self.sparql is not None and not self.errors and self.confidence >= GATE


class Translator:
    """Questions to SPARQL by templates; texts are named by template and may be replaced."""

    def __init__(self, prefixes: dict[str, str], texts: dict[str, str] | None = None):
        self.prefixes = prefixes
        self.texts = texts or {
            "function_calls": "SELECT ?caller ?callee WHERE { ?caller ex:contains ?callee }",
            "inheritance_hierarchy": "SELECT ?subclass ?superclass WHERE { ?subclass ex:inNation ?superclass }",
            "dependency_analysis": "SELECT ?source ?target WHERE { ?source ex:imports ?target }",
        }

    def validate(self, sparql: str) -> list[str]:
        try:
            parse(sparql, self.prefixes)
        except SparqlError as e:
            return [str(e)]
        return []

    def translate(self, question: str, limit: int | None = None) -> Translation:
        low, best, score = question.lower(), None, 0.0
        for name, (words, weight) in TEMPLATE_WORDS.items():
            s = sum(w in low for w in words) / len(words) * weight
            if s > score:
                best, score = name, s
        if best is None:
            return Translation(question, None, None, 0.5, ["no template matches"], "No query was made")
        text = self.texts[best] + (f" LIMIT {limit}" if limit else "")
        errors = self.validate(text)
        patterns = text.count(" . ") + 1
        confidence = max(0.0, min(1.0, 0.5 + 0.3 * score - 0.1 * len(errors) + min(0.05 * patterns, 0.2) + 0.1))
        others = [f"Consider {n}" for n, (words, _) in TEMPLATE_WORDS.items() if n != best and any(w in low for w in words)]
        return Translation(question, text, best, confidence, errors, f"SELECT query from the {best} template", others)

    def batch(self, questions: list[str]) -> tuple[list[Translation], float]:
        """All translations, and the share of those that can be executed."""
        out = [self.translate(q) for q in questions]
        return out, sum(t.executable for t in out) / len(out) if out else 0.0


def translations(questions: DataFrame) -> DataFrame:
    """(…, template, template_score, confidence) for a frame with a column question, without a driver loop."""
    m = template_match(F.col("question"))
    out = questions.withColumn("__m", m)
    return out.select(*questions.columns, F.col("__m.template").alias("template"), F.col("__m.score").alias("template_score"), translation_confidence(F.col("__m.score"), F.lit(0), F.lit(1), F.col("__m").isNotNull()).alias("confidence"))


# --- intent model
_PATTERNS = {
    "GRAPH_RAG": ("what are the dependencies of {e}", "show the imports of {e}", "which functions call {e}", "what inherits from {e}", "show the relationships of {e}"),
    "VECTOR_RAG": ("find code similar to {e}", "what resembles {e}", "show me something like {e}", "find semantically related code for {e}", "which snippets are comparable to {e}"),
    "DATABASE_RAG": ("list all {e}", "how many {e} are there", "get the details of {e}", "show the record of {e}", "count the {e}"),
    "HYBRID": ("explain {e} and everything related to it", "analyze {e} with its dependencies and similar code", "give a complete overview of {e}", "compare {e} with similar modules and list their users", "how does {e} work and what uses it"),
}
_ENTITIES = ("the parser", "User", "AuthService", "the cache module", "database models", "flask", "django views", "config loader", "the scheduler", "HTTP client")


def training_set(spark: SparkSession, per_class: int = 50, seed: int = 42) -> DataFrame:
    """(text, intent): as many questions of each class, made from patterns, entities and small variations."""
    rng, rows = random.Random(seed), []
    for intent in INTENTS:
        for i in range(per_class):
            text = rng.choice(_PATTERNS[intent]).format(e=rng.choice(_ENTITIES))
            rows.append((i, rng.choice(("", "please ", "can you ", "I need to ")) + text + rng.choice(("", "?", " for me")), intent))
    return spark.createDataFrame(rows, "n int, text string, intent string")


class IntentModel:
    """Hashed words into a random forest."""

    def __init__(self, trees: int = 40, features: int = 1 << 10, seed: int = 42):
        from pyspark.ml import Pipeline
        from pyspark.ml.classification import RandomForestClassifier
        from pyspark.ml.feature import HashingTF, StringIndexer, Tokenizer

        self.pipeline = Pipeline(stages=[
            StringIndexer(inputCol="intent", outputCol="label", stringOrderType="alphabetAsc", handleInvalid="keep"),
            Tokenizer(inputCol="text", outputCol="words"), HashingTF(inputCol="words", outputCol="features", numFeatures=features),
            RandomForestClassifier(numTrees=trees, maxDepth=12, seed=seed),
        ])
        self.model = None

    def fit(self, questions: DataFrame) -> IntentModel:
        self.model = self.pipeline.fit(questions)
        return self

    def classify(self, questions: DataFrame) -> DataFrame:
        """Adds intent, confidence, level, alternatives; unsure ones become HYBRID."""
        from pyspark.ml.functions import vector_to_array

        names = [F.lit(x) for x in self.model.stages[0].labels]
        scored = self.model.transform(questions.withColumn("intent", F.lit(None).cast("string")))
        pairs = F.reverse(F.array_sort(F.arrays_zip(F.slice(vector_to_array("probability"), 1, len(names)).alias("p"), F.array(*names).alias("intent"))))
        out = scored.select(*questions.columns, pairs.alias("__p"))
        confidence = F.col("__p")[0]["p"]
        sure = confidence >= CONFIDENT
        level = F.when(confidence >= 0.8, "high").when(confidence >= 0.6, "medium").otherwise("low")
        return out.select(*questions.columns, F.when(sure, F.col("__p")[0]["intent"]).otherwise("HYBRID").alias("intent"), confidence.alias("confidence"), level.alias("level"), F.slice("__p", 2, 3).alias("alternatives"))
