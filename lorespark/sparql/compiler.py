"""SPARQL syntax trees to DataFrames.

Triples have the columns s, p, o, o_kind (uri, literal, bnode), o_type and o_lang. In a solution every variable is a
string column that holds a whole term: an IRI as it is, a blank node with the prefix "_:", a literal in quotes with its
type or language, so that joins and DISTINCT compare terms. Catalyst gets the query as joins of filtered scans.
"""

from __future__ import annotations

import copy
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.sources.tables import dealt, fills, spread, written
from lorespark.sparql.parser import RDF_TYPE, XSD, Query, SparqlError, parse

_NUMERIC = tuple(XSD + t for t in ("integer", "decimal", "double", "float", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "unsignedInt", "unsignedLong"))
_DATE_TIME = r"^(-?\d{4,})-(\d\d)-(\d\d)(?:T(\d\d):(\d\d):(\d\d(?:\.\d+)?))?"
_TIME_PARTS = {"YEAR": 1, "MONTH": 2, "DAY": 3, "HOURS": 4, "MINUTES": 5, "SECONDS": 6}
_LITERAL = r'(?s)^"(.*)"(?:\^\^([^"]*)|@([^"]*))?$'


@dataclass(frozen=True)
class Value:
    """An expression: kind is term, text, number or truth; a null column is an error or an unbound variable."""

    kind: str
    column: Column


def literal(text: str, type_: str | None = None, lang: str | None = None) -> str:
    return f'"{text}"' + (f"@{lang}" if lang else f"^^{type_}" if type_ and type_ != XSD + "string" else "")


def encoded(term: tuple) -> str:
    return term[1] if term[0] == "iri" else literal(term[1], term[2], term[3])


def is_literal(c: Column) -> Column:
    return c.startswith('"')


def lexical(c: Column) -> Column:
    """The text of a term: of a literal without its quotes and type."""
    return F.when(is_literal(c), F.regexp_extract(c, _LITERAL, 1)).otherwise(c)


def datatype(c: Column) -> Column:
    kind = F.regexp_extract(c, _LITERAL, 2)
    return F.when(is_literal(c), F.when(kind != "", kind).otherwise(XSD + "string"))


def object_term(prefix: str = "") -> Column:
    o, kind, type_, lang = (F.col(prefix + c) for c in ("o", "o_kind", "o_type", "o_lang"))
    tail = F.when(lang.isNotNull(), F.concat(F.lit("@"), lang)).when(type_.isNotNull() & (type_ != XSD + "string"), F.concat(F.lit("^^"), type_)).otherwise("")
    return F.when(kind == "literal", F.concat(F.lit('"'), o, F.lit('"'), tail)).otherwise(o)


@dataclass
class Solutions:
    """A frame with one column a variable; maybe holds those that some rows leave unbound."""

    df: DataFrame
    names: list[str]
    maybe: frozenset[str] = frozenset()
    #: Columns with other names than their variables, inside of join conditions.
    renamed: dict[str, str] | None = None


def _null_or(a: Column, b: Column) -> Column:
    return a.isNull() | b.isNull() | (a == b)


def _split_join(left: Solutions, right: Solutions, r: DataFrame, shared: list[str], extra: Column | None) -> DataFrame:
    """An inner join on variables that either side may leave unbound, by cases: rows that bind them join on equality, so only unbound ones meet all."""
    cases = [(left.df, r, [] if extra is None else [extra])]
    for n in shared:
        a, b, more = F.col(f"`{n}`"), F.col(f"`{n}__r`"), []
        for x, y, on in cases:
            more.append((x.filter(a.isNotNull()), y.filter(b.isNotNull()), [*on, a == b]))
            if n in left.maybe:
                more.append((x.filter(a.isNull()), y, on))
            if n in right.maybe:
                more.append((x.filter(a.isNotNull()), y.filter(b.isNull()), on))
        cases = more
    return reduce(DataFrame.unionByName, (x.join(y, reduce(lambda c, d: c & d, on)) if on else x.crossJoin(y) for x, y, on in cases))


def join(left: Solutions, right: Solutions, how: str = "inner", extra: Column | None = None) -> Solutions:
    """Compatible solutions: shared variables agree, or one side leaves them unbound."""
    shared = [n for n in left.names if n in right.names]
    r = right.df.select(*(F.col(f"`{n}`").alias(f"{n}__r") for n in right.names))
    conditions = [_null_or(F.col(f"`{n}`"), F.col(f"`{n}__r`")) if n in left.maybe | right.maybe else F.col(f"`{n}`") == F.col(f"`{n}__r`") for n in shared]
    if extra is not None:
        conditions.append(extra)
    if how == "inner" and shared and all(n in left.maybe | right.maybe for n in shared) and len(shared) <= 2:
        joined = _split_join(left, right, r, shared, extra)
    elif conditions:
        joined = left.df.join(r, reduce(lambda a, b: a & b, conditions), how)
    elif how == "inner":
        joined = left.df.crossJoin(r)
    else:
        joined = left.df.join(r, F.lit(True), how)
    if how in ("left_semi", "left_anti"):
        return replace(left, df=joined)
    new = [n for n in right.names if n not in left.names]
    columns = [F.coalesce(F.col(f"`{n}`"), F.col(f"`{n}__r`")).alias(n) if n in shared and n in left.maybe else F.col(f"`{n}`") for n in left.names]
    maybe = {n for n in left.maybe if n not in shared or n in right.maybe or how == "left"} | {n for n in right.maybe if n not in shared} | (set(new) if how == "left" else set())
    return Solutions(joined.select(*columns, *(F.col(f"`{n}__r`").alias(n) for n in new)), [*left.names, *new], frozenset(maybe))


class Graph:
    """Triples to be queried. counts gives, where known, the number of triples of each predicate, by which joins are ordered.

    quads are triples with the IRI g of a named graph, for GRAPH, or make them when they are asked for; now is what NOW() returns.
    rows gives the true number of triples of predicates that have many: joins with these are dealt to partitions by it.
    """

    def __init__(self, triples: DataFrame, prefixes: dict[str, str] | None = None, counts: dict[str, int] | None = None, quads: DataFrame | Callable[[], DataFrame] | None = None, now: Column | None = None, rows: dict[str, int] | None = None):
        self.triples, self.prefixes, self.counts, self.quads, self.now, self.rows = triples, dict(prefixes or {}), counts or {}, quads, now, rows or {}
        #: Within GRAPH ?g the name g, which every triple pattern then binds.
        self._graph_name: str | None = None
        self.spark: SparkSession = triples.sparkSession
        self._parsed: dict[str, Query] = {}

    # --- entry points
    def parsed(self, text: str) -> Query:
        if text not in self._parsed:
            self._parsed[text] = parse(text, self.prefixes)
        return self._parsed[text]

    def query(self, text: str, bindings: dict[str, str] | None = None, limit: int | None = None) -> DataFrame:
        """SELECT: a column of terms for each variable. ASK: one row with `answer`. CONSTRUCT and DESCRIBE: s, p, o as terms.

        bindings fixes variables to terms: IRIs as they are, literals in quotes.
        """
        q = self.parsed(text)
        if q.kind == "ASK":
            s = self.group(q.where, bindings)
            return s.df.select(F.lit(1).alias("one")).limit(1).agg((F.count("one") > 0).alias("answer"))
        if q.kind == "CONSTRUCT":
            return self.construct(q, bindings)
        if q.kind == "DESCRIBE":
            return self.describe(q, bindings)
        df = self.select(q, bindings).df
        return df if limit is None else df.limit(limit)

    def values(self, text: str, bindings: dict[str, str] | None = None) -> DataFrame:
        """The result of a SELECT with the texts of its terms."""
        df = self.query(text, bindings)
        return df.select(*(lexical(F.col(f"`{c}`")).alias(c) for c in df.columns))

    # --- queries
    def select(self, q: Query, bindings: dict[str, str] | None = None) -> Solutions:
        s = self.group(q.where, bindings)
        wanted = q.select if q.select is not None else [(("var", n), n) for n in s.names if not n.startswith("_blank_")]
        if q.group_by or any(_has_aggregate(e) for e, _ in wanted) or q.having:
            s, outer = self.grouped(q, s, wanted)
        else:
            order = [(self.value(e, s), up) for e, up in q.order_by if not self._is_output(e, wanted, s)]
            extra = [self.term_of(v).alias(f"__order{i}") for i, (v, _) in enumerate(order)]
            columns = [self.term_of(self.value(e, s)).alias(n) for e, n in wanted]
            s = Solutions(s.df.select(*columns, *(extra if not q.distinct else [])), [n for _, n in wanted])
            outer = iter(range(len(extra)))
        if q.distinct:
            s = replace(s, df=s.df.select(*(F.col(f"`{n}`") for n in s.names)).distinct())
        keys = []
        for e, up in q.order_by:
            if self._is_output(e, wanted, s):
                c = F.col(f"`{e[1]}`")
            elif q.distinct:
                raise SparqlError("ORDER BY of a DISTINCT query must use what it selects")
            else:
                c = F.col(f"__order{next(outer)}")
            keys.append((c, up))
        df = _ordered(s.df, keys)
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return Solutions(df.select(*(F.col(f"`{n}`") for n in s.names)), s.names, frozenset(s.names))

    @staticmethod
    def _is_output(e: tuple, wanted: list, s: Solutions) -> bool:
        return e[0] == "var" and any(n == e[1] for _, n in wanted)

    def grouped(self, q: Query, s: Solutions, wanted: list):
        keys = []
        for i, (e, name) in enumerate(q.group_by):
            keys.append(self.term_of(self.value(e, s)).alias(name or f"__key{i}"))
        key_names = [name or f"__key{i}" for i, (_, name) in enumerate(q.group_by)]
        found: list[tuple] = []

        def collect(e):
            if isinstance(e, tuple) and e and e[0] == "agg":
                if e not in found:
                    found.append(e)
            elif isinstance(e, (tuple, list)):
                for x in e:
                    collect(x)

        for e, _ in wanted:
            collect(e)
        for e in q.having:
            collect(e)
        for e, _ in q.order_by:
            collect(e)
        aggregates = [self.aggregate(e, s).alias(f"__agg{i}") for i, e in enumerate(found)] or [F.count(F.lit(1)).alias("__none")]
        df = s.df.groupBy(*keys).agg(*aggregates)
        groups = Solutions(df, [*key_names, *(f"__agg{i}" for i in range(len(found)))], frozenset(f"__agg{i}" for i in range(len(found))))

        def swapped(e):
            if isinstance(e, tuple) and e and e[0] == "agg":
                return ("var", f"__agg{found.index(e)}")
            if isinstance(e, tuple):
                for i, (g, name) in enumerate(q.group_by):
                    if e == g and e[0] != "var":
                        return ("var", name or f"__key{i}")
                return tuple(swapped(x) for x in e)
            return [swapped(x) for x in e] if isinstance(e, list) else e

        for e in q.having:
            df = df.filter(_truth(self.value(swapped(e), groups)))
        groups = replace(groups, df=df)
        order = [self.value(swapped(e), groups) for e, _ in q.order_by if not self._is_output(e, wanted, groups)]
        columns = [self.term_of(self.value(swapped(e), groups)).alias(n) for e, n in wanted]
        extra = [self.term_of(v).alias(f"__order{i}") for i, v in enumerate(order)]
        return Solutions(df.select(*columns, *extra), [n for _, n in wanted]), iter(range(len(extra)))

    def aggregate(self, e: tuple, s: Solutions) -> Column:
        _, name, distinct, arg, separator = e
        if arg is None:
            if distinct:
                return _number_term(F.count_distinct(F.struct(*(F.col(f"`{n}`") for n in s.names))), "integer")
            return _number_term(F.count(F.lit(1)), "integer")
        v = self.value(arg, s)
        term = self.term_of(v)
        if name == "COUNT":
            return _number_term(F.count_distinct(term) if distinct else F.count(term), "integer")
        if name in ("SUM", "AVG"):
            n = _number(v)
            total = (F.sum_distinct(n) if distinct else F.sum(n)) if name == "SUM" else F.avg(F.when(n.isNotNull(), n))
            return _number_term(F.coalesce(total, F.lit(0.0)), "double")
        if name in ("MIN", "MAX"):
            pick = F.min if name == "MIN" else F.max
            return pick(F.struct(F.coalesce(_number(v), F.lit(float("-inf"))).alias("n"), term.alias("t")))["t"]
        if name == "SAMPLE":
            return F.min(term)
        texts = F.sort_array(F.collect_set(_text(v)) if distinct else F.collect_list(_text(v)))
        return F.concat(F.lit('"'), F.array_join(texts, separator), F.lit('"'))

    def construct(self, q: Query, bindings: dict[str, str] | None) -> DataFrame:
        s = self.group(q.where, bindings)
        df = s.df
        if q.order_by:
            df = _ordered(df, [(self.term_of(self.value(e, s)), up) for e, up in q.order_by])
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)

        def part(t: tuple) -> Column:
            if t[0] == "link":
                return F.lit(t[1])
            if t[0] == "var":
                return F.col(f"`{t[1]}`") if t[1] in s.names else F.concat(F.lit(f"_:{t[1]}"), F.lit("_"), F.xxhash64(*(F.col(f"`{n}`") for n in s.names)).cast("string"))
            return F.lit(encoded(t))

        rows = F.explode(F.array(*(F.struct(part(a).alias("s"), part(b).alias("p"), part(c).alias("o")) for a, b, c in q.template)))
        out = df.select(rows.alias("t")).select("t.*")
        return out.filter("s is not null and p is not null and o is not null and not startswith(s, '\"') and not startswith(p, '\"')").distinct()

    def describe(self, q: Query, bindings: dict[str, str] | None) -> DataFrame:
        fixed = [t[1] for t in q.targets if t[0] == "iri"]
        names = [t[1] for t in q.targets if t[0] == "var"]
        rows = self.triples.select("s", "p", object_term().alias("o"))
        parts = [rows.filter(F.col("s").isin(fixed))] if fixed else []
        if names:
            s = self.group(q.where, bindings)
            wanted = reduce(DataFrame.unionByName, (s.df.select(F.col(f"`{n}`").alias("s")) for n in names)).distinct()
            parts.append(rows.join(wanted, "s", "left_semi"))
        return reduce(DataFrame.unionByName, parts).distinct()

    # --- patterns
    def unit(self) -> Solutions:
        return Solutions(self.spark.range(1).select(), [])

    def group(self, g: tuple, bindings: dict[str, str] | None = None) -> Solutions:
        """The patterns of a group in order; its filters hold for the whole group."""
        s: Solutions | None = None
        filters = []
        if bindings:
            names = list(bindings)
            s = Solutions(self.spark.createDataFrame([tuple(bindings[n] for n in names)], ", ".join(f"`{n}` string" for n in names)), names)
        with_ = lambda new: new if s is None else join(s, new)
        for p in g[1]:
            kind = p[0]
            if kind == "filter":
                filters.append(p[1])
            elif kind == "bgp":
                s = self.bgp(p[1], s)
            elif kind == "group":
                s = with_(self.group(p))
            elif kind == "select":
                s = with_(self.select(p[1]))
            elif kind == "union":
                s = with_(self.union([self.group(x) for x in p[1]]))
            elif kind == "values":
                s = with_(self.inline(p[1], p[2]))
            elif kind == "optional":
                inner_filters = [x[1] for x in p[1][1] if x[0] == "filter"]
                right = self.group(("group", [x for x in p[1][1] if x[0] != "filter"]))
                s = self.optional(s or self.unit(), right, inner_filters)
            elif kind == "graph":
                s = with_(self.named(p[1], p[2]))
            elif kind == "minus":
                right = self.group(p[1])
                s = s or self.unit()
                if set(s.names) & set(right.names):
                    both = [n for n in s.names if n in right.names]
                    some = reduce(lambda a, b: a | b, (F.col(f"`{n}`").isNotNull() & F.col(f"`{n}__r`").isNotNull() for n in both))
                    s = join(s, right, "left_anti", some)
            else:
                s = s or self.unit()
                names = s.names
                s, e = self._marked(s, p[1])
                s = replace(s, names=names)
                column = self.term_of(self.value(e, s))
                s = Solutions(s.df.select(*(F.col(f"`{n}`") for n in s.names), column.alias(p[2])), [*s.names, p[2]], s.maybe | {p[2]})
        s = s or self.unit()
        for f in filters:
            s = self.filtered(s, f)
        return s

    def filtered(self, s: Solutions, e: tuple) -> Solutions:
        if e[0] == "op" and e[1] == "&&":
            return self.filtered(self.filtered(s, e[2][0]), e[2][1])
        if e[0] == "op" and e[1] == "!" and e[2][0][0] == "exists":
            e = ("exists", e[2][0][1], not e[2][0][2])
        if e[0] == "exists":
            inner = [x[1] for x in e[1][1] if x[0] == "filter"]
            right = self.group(("group", [x for x in e[1][1] if x[0] != "filter"]))
            extra = None
            if inner:
                both = self._side_by_side(s, right)
                extra = reduce(lambda a, b: a & b, (_truth(self.value(f, both)) for f in inner))
            return join(s, right, "left_semi" if e[2] else "left_anti", extra)
        marked, e = self._marked(s, e)
        kept = marked.df.filter(_truth(self.value(e, marked)))
        return replace(s, df=kept if marked is s else kept.select(*(F.col(f"`{n}`") for n in s.names)))

    def _marked(self, s: Solutions, e) -> tuple[Solutions, tuple]:
        """s with a column of truth for each EXISTS inside of an expression, and the expression with these in their places."""
        if isinstance(e, tuple) and e and e[0] == "exists":
            name = f"__mark{len(s.df.columns)}"
            return self._with_mark(s, e, name), ("mark", name)
        if isinstance(e, (tuple, list)):
            out = []
            for x in e:
                s, y = self._marked(s, x)
                out.append(y)
            return s, type(e)(out)
        return s, e

    def _with_mark(self, s: Solutions, e: tuple, name: str) -> Solutions:
        inner = [x[1] for x in e[1][1] if x[0] == "filter"]
        right = self.group(("group", [x for x in e[1][1] if x[0] != "filter"]))
        shared = [n for n in s.names if n in right.names]
        has = [F.col(f"`{c}`") for c in s.df.columns]
        mark = (F.coalesce(F.col("__found"), F.lit(False)) == F.lit(e[2])).alias(name)
        if not shared and not inner:
            some = right.df.select(F.lit(1).alias("one")).limit(1).agg((F.count("one") > 0).alias("__found"))
            return replace(s, df=s.df.crossJoin(F.broadcast(some)).select(*has, mark))  # one row
        if not inner and not set(shared) & (s.maybe | right.maybe):
            keys, on = right.df.select(*(F.col(f"`{n}`").alias(f"{n}__k") for n in shared)), shared
        else:  # the distinct solutions that have a match, found again by all that they bind
            extra = None
            if inner:
                both = self._side_by_side(s, right)
                extra = reduce(lambda a, b: a & b, (_truth(self.value(f, both)) for f in inner))
            some = replace(s, df=s.df.select(*(F.col(f"`{n}`") for n in s.names)).distinct())
            keys, on = join(some, right, "left_semi", extra).df.select(*(F.col(f"`{n}`").alias(f"{n}__k") for n in s.names)), s.names
        same = reduce(lambda a, b: a & b, (F.col(f"`{n}`").eqNullSafe(F.col(f"`{n}__k`")) for n in on))
        return replace(s, df=s.df.join(keys.distinct().withColumn("__found", F.lit(True)), same, "left").select(*has, mark))

    def named(self, term: tuple, group: tuple) -> Solutions:
        """A group within one named graph, or within each in turn, whose IRI the variable then holds."""
        if self.quads is None:
            raise SparqlError("there are no named graphs")
        if not isinstance(self.quads, DataFrame):
            self.quads = self.quads()
        inside = copy.copy(self)
        if term[0] == "var":
            inside.triples, inside._graph_name = self.quads, term[1]
            if not group[1]:
                return Solutions(self.quads.select(F.col("g").alias(term[1])).distinct(), [term[1]])
        else:
            inside.triples, inside._graph_name = self.quads.filter(F.col("g") == term[1]), None
        return inside.group(group)

    @staticmethod
    def _side_by_side(left: Solutions, right: Solutions) -> Solutions:
        """Names as they are within the condition of join()."""
        new = [n for n in right.names if n not in left.names]
        return Solutions(left.df, [*left.names, *new], renamed={n: f"{n}__r" for n in new})

    def optional(self, left: Solutions, right: Solutions, filters: list) -> Solutions:
        extra = None
        if filters:
            both = self._side_by_side(left, right)
            extra = reduce(lambda a, b: a & b, (_truth(self.value(f, both)) for f in filters))
        return join(left, right, "left", extra)

    def union(self, parts: list[Solutions]) -> Solutions:
        names = list(dict.fromkeys(n for p in parts for n in p.names))
        df = reduce(lambda a, b: a.unionByName(b), (p.df.select(*(F.col(f"`{n}`") if n in p.names else F.lit(None).cast("string").alias(n) for n in names)) for p in parts))
        return Solutions(df, names, frozenset(n for n in names if any(n not in p.names or n in p.maybe for p in parts)))

    def inline(self, names: list[str], rows: list) -> Solutions:
        data = [tuple(None if t is None else encoded(t) for t in r) for r in rows]
        df = self.spark.createDataFrame(data, ", ".join(f"`{n}` string" for n in names))
        return Solutions(df, names, frozenset(n for i, n in enumerate(names) if any(r[i] is None for r in data)))

    # --- basic graph patterns
    def bgp(self, triples: list, start: Solutions | None) -> Solutions:
        """Joins of the triple patterns: the most selective first, then those that share a variable with what is there."""
        left, s, many = list(triples), start, 0
        # Terms take many times their size in a file, by which the planner would broadcast them.
        large = fills(self.spark, max(self.rows.values(), default=0))
        while left:
            bound = set(s.names) if s else set()
            best = min(left, key=lambda t: (bool(bound) and not bound & _variables(t), self.cost(t, bound), triples.index(t)))
            left.remove(best)
            new = self.pattern(best, s)
            rows = self.rows.get(best[1][1], 0) if best[1][0] == "link" else 0
            if s is not None and (shared := [n for n in s.names if n in new.names]):
                if many:
                    s = replace(s, df=dealt(s.df, max(many, rows), *shared))
                else:
                    new = replace(new, df=dealt(new.df, rows, *shared))
            many = max(many, rows)
            s = new if s is None else join(s, replace(new, df=new.df.hint("merge")) if large else new)
        return s or self.unit()

    def cost(self, t: tuple, bound: set[str]) -> float:
        s, p, o = t
        rows = float(self.counts.get(p[1], 1e6)) if p[0] == "link" else 1e9 if p[0] in ("plus", "star", "opt", "seq", "alt", "not", "inv") else 1e8
        return rows / (1e4 if s[0] != "var" else 10 if s[1] in bound else 1) / (1e2 if o[0] != "var" else 10 if o[1] in bound else 1)

    def pattern(self, t: tuple, so_far: Solutions | None = None) -> Solutions:
        s, p, o = t
        if p[0] in ("link", "var"):
            df = self.triples
            if p[0] == "link":
                df = df.filter(F.col("p") == p[1])
            if s[0] != "var":
                df = df.filter(F.col("s") == s[1])
            if o[0] == "iri":
                df = df.filter((F.col("o") == o[1]) & (F.col("o_kind") != "literal"))
            elif o[0] == "lit":
                df = df.filter((F.col("o") == o[1]) & (object_term() == encoded(o)))
            graph = [] if self._graph_name is None else [(("var", self._graph_name), "g")]
            return _bound(df.select(F.col("s"), F.col("p"), object_term().alias("o"), *(F.col("g") for _ in graph)), [(s, "s"), (p, "p"), (o, "o"), *graph])
        if self._graph_name is not None:
            raise SparqlError("a path within GRAPH needs the IRI of a graph")
        known = s[1] if s[0] == "iri" else None
        target = encoded(o) if o[0] != "var" else None
        return _bound(self.path(p, known, target), [(s, "s"), (o, "o")])

    # --- property paths
    def path(self, p: tuple, known: str | None = None, target: str | None = None) -> DataFrame:
        """Pairs (s, o) of terms; where an end is known, those with that end."""

        def ends(df: DataFrame) -> DataFrame:
            df = df if known is None else df.filter(F.col("s") == known)
            return df if target is None else df.filter(F.col("o") == target)

        kind = p[0]
        if kind == "link":
            return ends(self.triples.filter(F.col("p") == p[1]).select("s", object_term().alias("o")))
        if kind == "inv":
            return self.path(p[1], target, known).filter("not startswith(o, '\"')").select(F.col("o").alias("s"), F.col("s").alias("o"))
        if kind == "alt":
            return reduce(DataFrame.unionByName, (self.path(x, known, target) for x in p[1]))
        if kind == "seq":
            out = self.path(p[1][0], known, None)
            for i, x in enumerate(p[1][1:], 2):
                nxt = self.path(x, None, target if i == len(p[1]) else None).select(F.col("s").alias("m"), F.col("o").alias("e"))
                out = out.select("s", F.col("o").alias("m")).join(nxt, "m").select("s", F.col("e").alias("o"))
            return out
        if kind == "not":
            rows = self.triples.select("s", "p", object_term().alias("o"))
            parts = []
            if p[1] or not p[2]:
                parts.append(rows.filter(~F.col("p").isin(p[1])).select("s", "o"))
            if p[2]:
                parts.append(rows.filter(~F.col("p").isin(p[2]) & ~is_literal(F.col("o"))).select(F.col("o").alias("s"), F.col("s").alias("o")))
            return ends(reduce(DataFrame.unionByName, parts))
        steps = self.path(p[1])
        if kind == "opt":
            reached = steps.distinct()
        elif known is not None:
            reached = reach(steps, known)
        elif target is not None:
            reached = reach(steps.select(F.col("o").alias("s"), F.col("s").alias("o")), target).select(F.col("o").alias("s"), F.col("s").alias("o"))
        else:
            reached = closure(steps)
        if kind in ("star", "opt"):
            nodes = self.triples.select(F.col("s").alias("n")).unionByName(self.triples.select(object_term().alias("n"))).distinct()
            fixed = known if known is not None else target
            same = self.spark.createDataFrame([(fixed, fixed)], "s string, o string") if fixed is not None else nodes.select(F.col("n").alias("s"), F.col("n").alias("o"))
            reached = reached.unionByName(same).distinct()
        return ends(reached)

    # --- expressions
    def value(self, e: tuple, s: Solutions) -> Value:
        kind = e[0]
        if kind == "var":
            name = (s.renamed or {}).get(e[1], e[1])
            return Value("term", F.col(f"`{name}`") if e[1] in s.names else F.lit(None).cast("string"))
        if kind == "iri":
            return Value("term", F.lit(e[1]))
        if kind == "lit":
            if e[2] in _NUMERIC:
                return Value("number", F.lit(float(e[1])))
            if e[2] == XSD + "boolean":
                return Value("truth", F.lit(e[1] in ("true", "1")))
            return Value("term", F.lit(encoded(e)))
        if kind == "mark":
            return Value("truth", F.col(e[1]))
        if kind == "exists":
            raise SparqlError("EXISTS is supported in FILTER and BIND")
        if kind == "agg":
            raise SparqlError("an aggregate stands outside of a grouped query")
        return self.call(e[1], e[2], s)

    def call(self, name: str, args: list, s: Solutions) -> Value:
        name = name.upper() if ":" not in name else name
        if name == "BOUND":
            return Value("truth", self.value(args[0], s).column.isNotNull())
        v = [self.value(a, s) for a in args]
        if name in ("&&", "||"):
            a, b = map(_truth, v)
            return Value("truth", a & b if name == "&&" else a | b)
        if name == "!":
            return Value("truth", ~_truth(v[0]))
        if name in ("=", "!=", "<", ">", "<=", ">="):
            return Value("truth", _compare(name, v[0], v[1]))
        if name == "IN":
            return Value("truth", reduce(lambda a, b: a | b, (_compare("=", v[0], x) for x in v[1:]), F.lit(False)))
        if name in ("+", "-", "*", "/"):
            a, b = map(_number, v)
            return Value("number", {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b)}[name]())
        if name == "neg":
            return Value("number", -_number(v[0]))
        if name in ("ABS", "CEIL", "FLOOR"):
            return Value("number", {"ABS": F.abs, "CEIL": F.ceil, "FLOOR": F.floor}[name](_number(v[0])).cast("double"))
        if name == "ROUND":
            return Value("number", F.floor(_number(v[0]) + 0.5).cast("double"))
        if name == "STR":
            return Value("text", _text(v[0]))
        if name in ("LCASE", "UCASE"):
            return Value("text", (F.lower if name == "LCASE" else F.upper)(_text(v[0])))
        if name == "STRLEN":
            return Value("number", F.length(_text(v[0])).cast("double"))
        if name == "CONTAINS":
            return Value("truth", F.contains(_text(v[0]), _text(v[1])))
        if name == "STRSTARTS":
            return Value("truth", F.startswith(_text(v[0]), _text(v[1])))
        if name == "STRENDS":
            return Value("truth", F.endswith(_text(v[0]), _text(v[1])))
        if name == "STRBEFORE":
            at = F.instr(_text(v[0]), _text(v[1]))
            return Value("text", F.when(at > 0, F.substring(_text(v[0]), F.lit(1), at - 1)).otherwise(""))
        if name == "STRAFTER":
            at = F.instr(_text(v[0]), _text(v[1]))
            return Value("text", F.when(at > 0, F.substring(_text(v[0]), at + F.length(_text(v[1])), F.length(_text(v[0])))).otherwise(""))
        if name == "SUBSTR":
            start = _number(v[1]).cast("int")
            size = _number(v[2]).cast("int") if len(v) > 2 else F.length(_text(v[0]))
            return Value("text", F.substring(_text(v[0]), start, size))
        if name == "CONCAT":
            return Value("text", F.concat(*map(_text, v)))
        if name in ("MD5", "SHA1", "SHA256", "SHA384", "SHA512"):
            text = _text(v[0]).cast("binary")
            return Value("text", F.md5(text) if name == "MD5" else F.sha1(text) if name == "SHA1" else F.sha2(text, int(name[3:])))
        if name == "NOW":
            if self.now is None:
                raise SparqlError("NOW() needs a graph with a time")
            return Value("term", F.concat(F.date_format(self.now, "'\"'yyyy-MM-dd'T'HH:mm:ss'Z\"^^'"), F.lit(XSD + "dateTime")))
        if name in _TIME_PARTS:
            return Value("number", F.regexp_extract(_text(v[0]), _DATE_TIME, _TIME_PARTS[name]).try_cast("double"))
        if name == "REPLACE":
            return Value("text", F.regexp_replace(_text(v[0]), _text(v[1]), _text(v[2])))
        if name == "REGEX":
            flags = args[2][1] if len(args) > 2 else ""
            return Value("truth", F.regexp_like(_text(v[0]), F.concat(F.lit(f"(?{flags})" if flags else ""), _text(v[1]))))
        if name in ("ISIRI", "ISURI"):
            return Value("truth", ~is_literal(v[0].column) & ~v[0].column.startswith("_:") if v[0].kind == "term" else F.lit(False))
        if name == "ISBLANK":
            return Value("truth", v[0].column.startswith("_:") if v[0].kind == "term" else F.lit(False))
        if name == "ISLITERAL":
            return Value("truth", is_literal(v[0].column) if v[0].kind == "term" else F.lit(True))
        if name == "ISNUMERIC":
            return Value("truth", _number(v[0]).isNotNull())
        if name == "LANG":
            return Value("text", F.regexp_extract(v[0].column, _LITERAL, 3))
        if name == "LANGMATCHES":
            return Value("truth", F.when(_text(v[1]) == "*", _text(v[0]) != "").otherwise(F.lower(_text(v[0])).startswith(F.lower(_text(v[1])))))
        if name == "DATATYPE":
            return Value("term", datatype(self.term_of(v[0])))
        if name in ("IRI", "URI"):
            return Value("term", _text(v[0]))
        if name == "SAMETERM":
            return Value("truth", self.term_of(v[0]) == self.term_of(v[1]))
        if name == "IF":
            return Value("term", F.when(_truth(v[0]), self.term_of(v[1])).otherwise(self.term_of(v[2])))
        if name == "COALESCE":
            return Value("term", F.coalesce(*map(self.term_of, v)))
        if name in (XSD + "integer", XSD + "double", XSD + "decimal", XSD + "float"):
            return Value("number", _text(v[0]).try_cast("double"))
        if name == XSD + "string":
            return Value("text", _text(v[0]))
        raise SparqlError(f"unknown function {name}")

    @staticmethod
    def term_of(v: Value) -> Column:
        if v.kind == "term":
            return v.column
        if v.kind == "text":
            return F.concat(F.lit('"'), v.column, F.lit('"'))
        if v.kind == "truth":
            return F.concat(F.lit('"'), v.column.cast("string"), F.lit(f'"^^{XSD}boolean'))
        return _number_term(v.column, None)


def _has_aggregate(e) -> bool:
    return isinstance(e, (tuple, list)) and (bool(e) and e[0] == "agg" or any(_has_aggregate(x) for x in e))


def _variables(t: tuple) -> set[str]:
    return {x[1] for x in t if x[0] == "var"}


def _bound(df: DataFrame, places: list) -> Solutions:
    """Name the columns by the variables that stand there; a variable that stands twice must agree."""
    seen: dict[str, str] = {}
    for term, column in places:
        if term[0] == "var":
            if term[1] in seen:
                df = df.filter(F.col(column) == F.col(seen[term[1]]))
            else:
                seen[term[1]] = column
    return Solutions(df.select(*(F.col(c).alias(n) for n, c in seen.items())), list(seen))


def _number_term(c: Column, type_: str | None) -> Column:
    whole = c.cast("double") == F.floor(c.cast("double"))
    if type_ == "integer":
        return F.concat(F.lit('"'), c.cast("long").cast("string"), F.lit(f'"^^{XSD}integer'))
    as_text = F.when(whole & (F.abs(c) < 1e15), c.cast("long").cast("string")).otherwise(c.cast("string"))
    kind = F.when(whole, XSD + "integer").otherwise(XSD + "double") if type_ is None else F.lit(XSD + type_)
    return F.concat(F.lit('"'), as_text, F.lit('"^^'), kind)


def _text(v: Value) -> Column:
    return lexical(v.column) if v.kind == "term" else v.column if v.kind == "text" else lexical(Graph.term_of(v))


def _number(v: Value) -> Column:
    if v.kind == "number":
        return v.column
    if v.kind == "term":
        return F.when(datatype(v.column).isin(*_NUMERIC), lexical(v.column).try_cast("double"))
    return F.lit(None).cast("double")


def _truth(v: Value) -> Column:
    if v.kind == "truth":
        return v.column
    if v.kind == "number":
        return v.column != 0
    if v.kind == "text":
        return v.column != ""
    n = _number(v)
    return F.when(n.isNotNull(), n != 0).when(datatype(v.column) == XSD + "boolean", lexical(v.column) == "true").when(is_literal(v.column), lexical(v.column) != "")


def _compare(op: str, a: Value, b: Value) -> Column:
    """Numbers by value, if both are; otherwise terms for (in)equality, and the texts of literals for order."""
    do = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}[op]
    if "number" in (a.kind, b.kind):
        return do(_number(a), _number(b))
    if a.kind == b.kind == "truth":
        return do(a.column, b.column)
    x, y = _number(a), _number(b)
    other = do(Graph.term_of(a), Graph.term_of(b)) if op in ("=", "!=") else F.when(is_literal(Graph.term_of(a)) & is_literal(Graph.term_of(b)), do(_text(a), _text(b)))
    return F.when(x.isNotNull() & y.isNotNull(), do(x, y)).otherwise(other)


def _ordered(df: DataFrame, by: list[tuple[Column, bool]]) -> DataFrame:
    """Unbound first, then blank nodes, IRIs and literals; numbers by value. Keys are computed once a row, not once a comparison."""
    keys, order = [], []
    for i, (c, up) in enumerate(by):
        kind = F.when(c.startswith("_:"), 0).when(is_literal(c), 2).otherwise(1)
        for k, key in enumerate((kind, _number(Value("term", c)), lexical(c), c)):
            name = f"__by{i}_{k}"
            keys.append(key.alias(name))
            order.append(F.col(name).asc_nulls_first() if up else F.col(name).desc_nulls_last())
    return df.select("*", *keys).orderBy(*order) if keys else df


#: Steps that one task follows on its own; more are followed in rounds of joins.
FEW_STEPS = 200_000


def _followed(start: str):
    """Breadth-first search over all steps in one task."""

    def run(batches):
        import pandas as pd

        ways: dict[str, list[str]] = {}
        for pdf in batches:
            for a, b in zip(pdf.s, pdf.o, strict=True):
                ways.setdefault(a, []).append(b)
        found: dict[str, None] = {}
        todo = [start]
        while todo:
            new = [b for a in todo for b in ways.get(a, ()) if b not in found]
            todo = list(dict.fromkeys(new))
            found.update(dict.fromkeys(todo))
        yield pd.DataFrame({"s": [start] * len(found), "o": list(found)}, dtype=str)

    return run


def reach(steps: DataFrame, start: str) -> DataFrame:
    """(s, o): all that one or more steps lead to from start. Only new nodes are followed in each round."""
    edges = written(steps.select("s", "o").repartition("s", "o").distinct(), "steps")
    if edges.count() <= FEW_STEPS:
        return edges.coalesce(1).mapInPandas(_followed(start), "s string, o string")
    new = written(edges.filter(F.col("s") == start).select(F.col("o").alias("n")).distinct(), "reached")
    seen = new
    while not new.isEmpty():
        nxt = edges.join(new.select(F.col("n").alias("s")), "s", "left_semi").select(F.col("o").alias("n")).distinct()
        new = written(nxt.join(seen, "n", "left_anti"), "reached")
        seen = seen.unionByName(new)
    return seen.select(F.lit(start).alias("s"), F.col("n").alias("o"))


def closure(steps: DataFrame) -> DataFrame:
    """(s, o): all pairs that one or more steps join; the number of rounds is the logarithm of the longest way.

    Round k has the pairs joined by fewer than 2^k steps, and those joined by 2^k, which lengthen the former: a way is
    found by one split of its steps, not by each. Sets are dealt to partitions by their rows before they are formed.
    """
    pairs = ways = written(steps.select("s", "o").repartition("s", "o").distinct(), "closure")
    n = m = pairs.count()

    def then(df: DataFrame) -> DataFrame:
        return df.select("s", F.col("o").alias("m")).join(ways.select(F.col("s").alias("m"), F.col("o").alias("e")), "m").select("s", F.col("e").alias("o"))

    while True:
        ways = written(spread(then(ways), 2 * m, "s", "o", each=1 << 18).distinct(), "ways")
        m = ways.count()
        pairs = written(spread(pairs.unionByName(ways).unionByName(then(pairs)), 2 * (n + m), "s", "o", each=1 << 18).distinct(), "closure")
        if (now := pairs.count()) == n:
            return pairs
        n = now


__all__ = ["Graph", "RDF_TYPE", "Solutions", "Value", "closure", "encoded", "lexical", "literal", "object_term", "reach"]
