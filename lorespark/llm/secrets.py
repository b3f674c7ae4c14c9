"""Secret scans through a trigram inverted index.

A Boolean trigram query is derived from the regular expression of each rule: an OR of alternatives, each an AND of
trigrams that any match of it must hold. Each text is read once for its trigrams; the index has a posting (trigram,
document) for every one that some query asks for, and is kept as a table. Intersecting the postings gives a rule's
candidate documents, in which the expression itself is then searched. Rules from which no trigram follows are searched
in every document.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.llm.shared import text_or_empty, written


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of pattern whose group has at least min_length characters."""

    kind: str
    pattern: str
    group: int = 0
    min_length: int = 1


#: The patterns the contract fixes. Of the hexadecimal rule only whole runs of 32 or more are searched for, which are
#: the same matches as those of [0-9a-f]+ with 32 characters or more.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: What this method adds.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

#: Alternatives and characters of a class that are spelled out; what has more counts as unknown text.
_MOST_ALTERNATIVES, _MOST_CHARACTERS = 64, 6
#: Stands for unknown text between known pieces.
_GAP = "\0"


def _spelled(items) -> list[str]:
    """The texts a parsed expression may match, in lower case, with _GAP for any unknown part."""
    texts = [""]
    for kind, value in items:
        if kind is sre.LITERAL:
            more = [chr(value).lower()]
        elif kind is sre.IN and all(k is sre.LITERAL for k, _ in value) and len(value) <= _MOST_CHARACTERS:
            more = sorted({chr(v).lower() for _, v in value})
        elif kind is sre.SUBPATTERN:
            more = _spelled(value[-1])
        elif kind is sre.BRANCH:
            more = sorted({t for b in value[1] for t in _spelled(b)})
        elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, inner = value
            once = _spelled(inner)
            more = ["", *once] if (least, most) == (0, 1) else [t + _GAP for t in once] if least else [_GAP]
        else:
            more = [_GAP]
        if len(texts) * len(more) > _MOST_ALTERNATIVES:
            more = [_GAP]
        texts = [a + b for a in texts for b in more]
    return texts


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """An OR of ANDs of trigrams of the lower-cased text; None if a match need not hold any trigram."""
    ands = {frozenset(run[i : i + 3] for run in text.split(_GAP) for i in range(len(run) - 2)) for text in _spelled(sre_parser.parse(pattern))}
    if frozenset() in ands:
        return None
    return sorted((a for a in ands if not any(b < a for b in ands)), key=sorted)


#: Spans that are put together before they are added to a text's list.
_AT_ONCE = 256


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """Array of (start, rank, end) of a rule's matches, in code points."""
    pattern = F.lit(rule.pattern)
    found, between = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, rule.pattern, -1)
    held = found if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    kind = "array<struct<start:int,rank:int,end:int>>"

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["between"])
        end = start + F.length(x["found"])
        span = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end")))
        some = F.when(F.length(x["held"]) >= rule.min_length, F.concat(state["some"], span)).otherwise(state["some"])
        full = F.size(some) >= _AT_ONCE
        return F.struct(end.alias("at"), F.when(full, F.array().cast(kind)).otherwise(some).alias("some"), F.when(full, F.concat(state["all"], F.array(some))).otherwise(state["all"]).alias("all"))

    each = F.arrays_zip(found.alias("found"), F.slice(between, 1, F.size(found)).alias("between"), held.alias("held"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("some"), F.array().cast(f"array<{kind}>").alias("all"))
    return F.when(F.regexp_like(text, pattern), F.aggregate(each, start, step, lambda s: F.concat(F.flatten(s["all"]), s["some"]))).otherwise(F.array().cast(kind))


def _any_of(trigrams: list[str]) -> str:
    """An expression for any of the trigrams, with common beginnings written once."""
    heads = {}
    for t in sorted(trigrams):
        heads.setdefault(t[0], {}).setdefault(t[1], []).append(t[2])
    quoted = re.escape
    return "|".join(f"{quoted(a)}(?:{'|'.join(f'{quoted(b)}(?:{"|".join(map(quoted, c))})' for b, c in more.items())})" for a, more in heads.items())


def trigrams_of(text: Column, wanted: list[str]) -> Column:
    """The distinct trigrams of text that are wanted, found in one pass over all its places."""
    if not wanted:
        return F.array().cast("array<string>")
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?=({_any_of(wanted)}))"), F.lit(1)))


def candidates(postings: DataFrame, queries: dict[int, list[frozenset[str]]]) -> DataFrame:
    """(id, text_hash, rules): the rules whose trigram query a document's postings satisfy."""
    wanted = []
    for rank, ands in queries.items():
        for n, trigrams in enumerate(ands):
            wanted += [(rank, n, t, 1 << k, (1 << len(trigrams)) - 1) for k, t in enumerate(sorted(trigrams))]
    table = postings.sparkSession.createDataFrame(wanted, "rank int, n int, trigram string, bit long, full long")
    hits = postings.join(F.broadcast(table), "trigram")  # as many rows as the rules have trigrams
    met = hits.groupBy("id", "text_hash", "rank", "n", "full").agg(F.bit_or("bit").alias("bits")).filter("bits = full")
    return met.groupBy("id", "text_hash").agg(F.collect_set("rank").alias("rules"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """One row per row of docs: id, spans: an array of (kind, start, end), by start and then in the order of the rules.

    start and end count code points, end exclusive. Null texts count as empty and have no spans; no rows give no rows.
    Rows that repeat an id are searched each in its own text; very long texts are searched whole. Other columns are not
    read, whatever their names.
    """
    text = text_or_empty(text_col)
    asked = {rank: trigram_query(r.pattern) for rank, r in enumerate(rules)}
    queries = {rank: q for rank, q in asked.items() if q is not None}
    trigrams = sorted({t for ands in queries.values() for a in ands for t in a})
    kind = "array<struct<start:int,rank:int,end:int>>"
    everywhere = F.concat(F.array().cast(kind), *(_spans(text, rules[rank], rank) for rank, q in asked.items() if q is None))
    # One row a document with its trigrams is both the list of documents and the index, whose postings are its exploded rows.
    scanned = written(docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), trigrams_of(F.lower(text), trigrams).alias("trigrams"), everywhere.alias("spans")), "secret-index")
    postings = scanned.select("id", "text_hash", F.explode("trigrams").alias("trigram"))
    found = written(candidates(postings, queries), "secret-candidates")
    verify = F.concat(F.array().cast(kind), *(F.when(F.array_contains("rules", rank), _spans(F.col("text"), rules[rank], rank)).otherwise(F.array().cast(kind)) for rank in queries))
    check = docs.select(F.col(id_col).alias("of"), F.xxhash64(text).alias("hash"), text.alias("text")).join(found, F.col("of").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("text_hash")))
    verified = written(check.select("id", "text_hash", verify.alias("more")).filter("size(more) > 0").dropDuplicates(["id", "text_hash"]), "secret-verified")
    more = verified.select(F.col("id").alias("of"), F.col("text_hash").alias("hash"), "more")
    joined = scanned.join(more, F.col("id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("hash")), "left")
    spans = F.array_sort(F.when(F.col("more").isNull(), F.col("spans")).otherwise(F.concat("spans", F.col("more"))))
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return joined.select(F.col("id").alias(id_col), F.transform(spans, lambda s: F.struct(F.get(kinds, s["rank"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))
