"""The prefix trie of conversations by an LCP-aware external mergesort.

A turn takes part as a fingerprint of 128 bits of its role and text, so texts are read once and never shuffled. Equal
conversations are one record with the number of its members; their ids pass a task in order, which hashes them as they
come and holds none. Records are sorted in runs, each record with the length of the prefix that it shares with the one
before it (LCP), and the runs are written to the shared folder. Spark deals them out by ranges of the order; the pieces
of the runs in a range are merged by a loser tree that compares LCPs first and turns only where these agree, from the
LCP on. The merged stream keeps a stack of the nodes on the path to the present record, and lets a node go when the
stream leaves it: by then all of its subtree has passed.

Nodes on the path to a range's first or last record may go on in the range beside it. They are few, are written as
parts, added up by key, and get what hangs below them as sums along those paths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.llm.shared import written

#: Records of a run; turns of a range, on average.
RUN, RANGE = 16_384, 200_000

EMPTY = hashlib.sha256(b"").hexdigest()
Turn = tuple[int, int, int]


def _lcp(a: list[Turn], b: list[Turn], start: int = 0) -> int:
    n = min(len(a), len(b))
    while start < n and a[start] == b[start]:
        start += 1
    return start


def runs(records: Iterator[tuple], size: int = RUN) -> Iterator[list[tuple]]:
    """Sorted runs of (turns, lcp, *rest) for records (turns, *rest); lcp is that with the record before in the run."""
    held: list[tuple] = []

    def cut():
        held.sort(key=lambda r: r[0])
        before: list[Turn] = []
        out = []
        for turns, *rest in held:
            out.append((turns, _lcp(before, turns), *rest))
            before = turns
        return out

    for r in records:
        held.append(r)
        if len(held) == size:
            yield cut()
            held = []
    if held:
        yield cut()


def merge(pieces: list[list[tuple]]) -> Iterator[tuple]:
    """The records (turns, lcp, *rest) of sorted runs in one order, with the LCP between neighbours of that order.

    A loser tree: every inner node keeps the run that lost there, with the LCP of its head and the last record that
    came out. Of two heads the one with the longer LCP comes first, as it is nearer to that record; where LCPs agree,
    turns are compared from there on, and the loser's LCP becomes the one found.
    """
    k = max(1, len(pieces))
    at = [0] * k
    heads = [p[0][0] if p else None for p in pieces] or [None]
    lcps = [0] * k
    losers = [-1] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two runs."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if lcps[a] != lcps[b]:
            return (a, b) if lcps[a] > lcps[b] else (b, a)
        same = _lcp(x, y, lcps[a])
        first, last = (a, b) if x[same:same + 1] <= y[same:same + 1] else (b, a)
        lcps[last] = same
        return first, last

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1) if k > 1 else 0
    while heads[winner] is not None:
        run, i = pieces[winner], at[winner]
        yield (run[i][0], lcps[winner], *run[i][2:])
        at[winner] = i = i + 1
        heads[winner], lcps[winner] = (run[i][0], run[i][1]) if i < len(run) else (None, 0)
        node = (winner + k) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


class _Node:
    """A node on the open path, with the sums over what has left its subtree."""

    __slots__ = ("children", "chars", "ends", "first", "leaves", "least", "n", "saved", "waiting")

    def __init__(self, chars: int, first: bool):
        self.chars, self.first, self.n, self.least, self.ends = chars, first, 0, None, EMPTY
        self.children = self.leaves = self.saved = 0
        self.waiting: list[list] = []  # rows of children, until the smallest member is known


def _key(turns: list[Turn], depth: int) -> bytes:
    return hashlib.blake2b(np.array([t[:2] for t in turns[:depth]], np.int64).tobytes(), digest_size=16).digest()


#: Rows of a range: kind 0 is a finished node, 1 one whose parent is a part, 2 a part.
_ROW = "kind int, range long, chain int, key binary, parent binary, conv_id long, depth int, parent_conv_id long, n long, children long, leaves long, saved long, chars long, ends string"


def nodes_of_range(merged: Iterator[tuple], number: int) -> Iterator[list]:
    """The rows of a range from its merged records (turns, lcp, least member, members, ends)."""
    path: list[_Node] = []
    first: list[_Node] = []
    before: list[Turn] = []
    start: list[Turn] = []

    def leave(depth: int) -> Iterator[list]:
        while len(path) > depth:
            node, up = path.pop(), path[-1]
            yield from ([*row[:7], node.least, *row[8:]] for row in node.waiting)
            node.waiting = []
            if node.first:  # the stream never comes back to it, but an earlier range may have begun it
                continue
            leaves = node.leaves or 1
            saved = node.saved + (node.n - 1) * node.chars
            row = [0, number, 0, None, None, node.least, len(path), None, node.n, node.children, leaves, saved, None, node.ends]
            up.children, up.leaves, up.saved = up.children + 1, up.leaves + leaves, up.saved + saved
            if up.first:
                yield [1, *row[1:4], _key(before, len(path) - 1), *row[5:]]
            else:
                up.waiting.append(row)

    for turns, lcp, least, members, ends in merged:
        if not path:
            start = turns
            path.append(_Node(0, True))
        yield from leave(min(lcp, len(before)) + 1)
        opened = not first
        for depth in range(len(path) - 1, len(turns)):
            path.append(_Node(turns[depth][2], opened))
        if opened:
            first = list(path)
        for node in path:
            node.n += members
            node.least = least if node.least is None else min(least, node.least)
        path[-1].ends = ends
        before = turns
    last = list(path)
    shared = sum(node.first for node in last)
    for depth, node in enumerate(last):  # children of the last path that are not on it wait for a parent that is a part
        yield from ([1, *row[1:4], _key(before, depth), *row[5:]] for row in node.waiting)
    for chain, nodes, turns in ((0, first, start), (1, last, before)):
        for depth, node in enumerate(nodes):
            parent = None if depth == 0 else _key(turns, depth - 1)
            known = chain == 1 and depth < shared
            sums = [0] * 4 if known else [node.n, node.children, node.leaves, node.saved]
            yield [2, number, chain, _key(turns, depth), parent, node.least, depth, None, *sums, node.chars, None if known or node.ends == EMPTY else node.ends]


def _digest(codes: Column) -> list[Column]:
    plain = F.transform(codes, lambda t: F.struct(t["a"], t["b"]))
    return [F.xxhash64(plain).alias("da"), F.xxhash64(F.lit(1), plain, F.size(codes)).alias("db")]


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): fingerprints and code points of a conversation's turns in order, ties by fingerprint."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turn = F.struct("turn", F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), role, text).alias("b"), F.length(text).cast("long").alias("n"))
    lists = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return lists.select("conv_id", F.transform("turns", lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), t["n"].alias("n"))).alias("turns"))


def with_shared_heads(turns: DataFrame, every: int = 100, heads: int = 6) -> DataFrame:
    """Conversation c begins with the first h turns of conversation c - c % every, h = crc32(c) % heads, and goes on with its own after its first h."""
    base = turns.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    mixed = turns.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).withColumn("h", h).join(base, "base", "left")
    begin = F.when(F.col("head").isNull() | (F.col("h") == 0), F.slice("turns", 1, 0)).otherwise(F.slice("head", 1, F.col("h")))
    return mixed.select("conv_id", F.concat(begin, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def _members(sequences: DataFrame) -> DataFrame:
    """(conv_id, members, ends) for each distinct sequence: its smallest member, their number, SHA-256 of all ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, least, n = None, None, None, 0

        def done(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["conv_id", "members", "ends"])

        for b in batches:
            rows = []
            a, c, ids = (b.column(i).to_numpy() for i in range(3))
            cuts = [0, *(np.flatnonzero((np.diff(a) != 0) | (np.diff(c) != 0)) + 1).tolist(), len(ids)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                text = ",".join(map(str, ids[i:j].tolist())).encode()
                if (a[i], c[i]) == key:
                    state.update(b"," + text)
                    n += j - i
                    continue
                if key is not None:
                    rows.append((least, n, state.hexdigest()))
                key, state, least, n = (a[i], c[i]), hashlib.sha256(text), int(ids[i]), j - i
            if rows:
                yield done(rows)
        if key is not None:
            yield done([(least, n, state.hexdigest())])

    return sequences.select("da", "db", "conv_id").repartition("da", "db").sortWithinPartitions("da", "db", "conv_id").mapInArrow(run, "conv_id long, members long, ends string")


def _records(batch: pa.RecordBatch, name: str) -> list[list[Turn]]:
    lists = batch.column(batch.schema.get_field_index(name))
    fields = [lists.values.field(i).to_pylist() for i in range(3)]
    turns = list(zip(*fields, strict=True))
    ends = lists.offsets.to_pylist()
    return [turns[i:j] for i, j in zip(ends, ends[1:], strict=False)]


_SEQUENCE = "turns array<struct<a: long, b: long, n: long>>, lcp int, conv_id long, members long, ends string"
_LIST = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())]))


def _sorted_runs(distinct: DataFrame, size: int) -> DataFrame:
    """(run, at, turns, lcp, conv_id, members, ends) of each sorted run, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        rows = (r for b in batches for r in zip(_records(b, "turns"), *(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True))
        for number, piece in enumerate(runs(rows, size)):
            for i in range(0, len(piece), 2048):
                turns, *rest = zip(*piece[i : i + 2048], strict=True)
                n = len(turns)
                plain = pa.array([[{"a": a, "b": b, "n": c} for a, b, c in t] for t in turns], _LIST)
                yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + number] * n), pa.array(range(i, i + n), pa.int32()), plain, pa.array(rest[0], pa.int32()), *map(pa.array, rest[1:])], ["run", "at", "turns", "lcp", "conv_id", "members", "ends"])

    return written(distinct.select("turns", "conv_id", "members", "ends").mapInArrow(run, "run long, at int, " + _SEQUENCE), "trie-runs")


def prefix_trie(sequences: DataFrame, run_size: int = RUN, range_turns: int = RANGE) -> DataFrame:
    """The nodes of the trie of sequences (conv_id, turns: array of structs of two fingerprints and code points).

    One row per distinct sequence of the first d turns of some conversation, from d = 0 on: conv_id (the smallest
    member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens and ends_sha256 (of
    the ids of the conversations that end there, ascending). Conversations without turns end at the root. No
    conversations give no rows. Ids are distinct. A task holds a range of about range_turns turns of distinct
    sequences, and at least one conversation's fingerprints; equal sequences count once, however many there are.
    """
    spark = sequences.sparkSession
    marked = written(sequences.select("conv_id", "turns", *_digest(F.col("turns"))), "trie-sequences")
    ends = written(_members(marked), "trie-members")
    piled = _sorted_runs(marked.select("conv_id", "turns").join(ends, "conv_id"), run_size)
    total = piled.agg(F.sum(F.size("turns") + 1)).first()[0] or 0
    if not total:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        rows = [r for b in batches for r in zip(b.column(0).to_pylist(), _records(b, "turns"), *(b.column(i).to_pylist() for i in (3, 4, 5, 6)), strict=True)]
        pieces = [[r[1:] for r in group] for _, group in groupby(rows, key=lambda r: r[0])]
        del rows
        out: list[list] = []
        for row in nodes_of_range(merge(pieces), number) if pieces else ():
            out.append(row)
            if len(out) == 4096:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    ranged = piled.repartitionByRange(max(1, -(-total // range_turns)), "turns").sortWithinPartitions("run", "at")
    rows = written(ranged.mapInArrow(run, _ROW), "trie-rows")
    parts = rows.filter("kind = 2")
    # Parts of one node add up; the first range and path that has it owns its sums.
    nodes = written(parts.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.sum("n").alias("n"), F.sum("children").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.first("chars").alias("chars"), F.max("ends").alias("ends"), F.min(F.struct("range", "chain")).alias("owner")), "trie-parts")
    below = nodes.groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("more"))
    nodes = written(nodes.join(below, "key", "left").withColumn("children", F.col("children") + F.coalesce("more", F.lit(0))).drop("more"), "trie-open")
    own = nodes.select("key", "owner", F.when(F.col("children") == 0, F.lit(1)).otherwise(F.col("leaves")).alias("own_leaves"), (F.col("saved") + (F.col("n") - 1) * F.col("chars")).alias("own_saved"))
    chains = parts.select("range", "chain", "depth", "key").join(own, "key")
    mine = F.struct("range", "chain") == F.col("owner")
    deeper = Window.partitionBy("range", "chain").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(F.when(mine, F.col(f"own_{c}")).otherwise(0)).over(deeper), F.lit(0)).alias(f"far_{c}") for c in ("leaves", "saved")]
    far = chains.select("key", *sums).groupBy("key").agg(F.sum("far_leaves").alias("far_leaves"), F.sum("far_saved").alias("far_saved"))
    totals = own.join(far, "key").select("key", (F.col("own_leaves") + F.col("far_leaves")).alias("n_leaves"), (F.col("own_saved") + F.col("far_saved")).alias("saved_tokens"))
    up = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    shape = ["conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children")]
    open_nodes = nodes.join(totals, "key").join(up, "parent", "left").select(*shape, "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"))
    rest = [F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256")]
    under = rows.filter("kind = 1").drop("parent_conv_id").join(up, "parent").select(*shape, *rest)
    return rows.filter("kind = 0").select(*shape, *rest).unionByName(under).unionByName(open_nodes)


def _batch(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), *[pa.int64()] * 6, pa.string()]
    names = [x.split()[0] for x in _ROW.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations rebuilt with shared heads, one row per node: see prefix_trie and with_shared_heads.

    Turns are in the order of turn, null first; turns that agree in it in that of their fingerprints. Null roles and
    texts count as empty; repeated rows are turns of their own; rows without a conv_id belong to no conversation. Other
    columns are not read. Texts of any length count by their fingerprint.
    """
    return prefix_trie(with_shared_heads(written(ordered_turns(conversations), "trie-turns")))
