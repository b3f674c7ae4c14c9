"""Best-fit packing of tokenised documents by a grouping genetic algorithm.

Pieces of documents are dealt to blocks of bounded size. The packings of a block evolve on several islands, which are
tasks of their own: a crossover injects well-filled bins of one parent whole into the other, drops the bins that hold
their pieces already, and best-fits what that displaced. Between epochs the best packing of each island migrates to
the next one. The first island starts from best-fit decreasing, the others from blurred orders only. Every island runs
at least one generation, and then stops at a packing with as few bins as a lower bound allows. Results say how many
bins best-fit decreasing alone would have taken.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.shared import once_a_worker, small_batches, text_or_empty, written

#: Pieces in a block, on average.
BLOCK = 8192
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 3, 2, 8, 4


def _byte_of_symbol() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as code points from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def _encoding(vocabulary: str):
    return once_a_worker(("encoding", vocabulary), lambda: _loaded(vocabulary))


def _loaded(vocabulary: str):
    """The byte-level BPE of a tokenizers file, run by tiktoken, which gives the same ids in a third of the time."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(vocabulary), encoding="utf-8") as f:
        kept = json.load(f)
    special = {t["content"]: t["id"] for t in kept["added_tokens"]}
    code = _byte_of_symbol()
    ranks = {bytes(code[c] for c in token): i for token, i in kept["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding(base64.b16encode(vocabulary.encode()).decode(), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def token_ids(text: str, vocabulary: str, end: int = 0) -> np.ndarray:
    return np.append(np.asarray(_encoding(vocabulary).encode(text, allowed_special="all"), np.uint32), np.uint32(end))


def cuts(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all but the first have size tokens."""
    first = n % size or size if n else 0
    return [(0, first), *((s, size) for s in range(first, n, size))]


def encode_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, vocabulary: str = "byte_bpe_50k.json", end: int = 0) -> DataFrame:
    """Per piece: id, piece, start, length, ids (little-endian unsigned 32-bit). Null and empty texts have the end id only."""
    small_batches(docs.sparkSession, 250)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(vocabulary)
        names = ["id", "piece", "start", "length", "ids"]
        for b in batches:
            rows = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.append(np.asarray(encoding.encode_to_numpy(text, allowed_special="all"), "<u4"), np.array([end], "<u4"))
                rows += [(key, k, s, n, ids[s : s + n].tobytes()) for k, (s, n) in enumerate(cuts(len(ids), size))]
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names)

    small = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return small.mapInArrow(run, "id long, piece int, start long, length long, ids binary")


def least_bins(sizes: np.ndarray, size: int) -> int:
    """A lower bound on the bins: for each limit, large pieces need bins of their own and the middle ones what room these leave."""
    count = np.bincount(sizes, minlength=size + 1)
    n, total = np.cumsum(count), np.cumsum(count * np.arange(size + 1))
    half = size // 2
    limit = np.arange(1, half + 1)
    alone = n[size] - n[size - limit]  # longer than size - limit
    wide, wide_sum = n[size - limit] - n[half], total[size - limit] - total[half]
    middle = total[half] - total[limit - 1]
    return int((alone + wide + np.maximum(0, -(-(middle - (wide * size - wide_sum)) // size))).max(initial=-(-total[size] // size)))


class Packing:
    """bin_of: the bin of each piece; fill: tokens in each bin, with no bin empty."""

    def __init__(self, sizes: np.ndarray, bin_of: np.ndarray):
        self.bin_of, self.generations = np.unique(bin_of, return_inverse=True)[1], 0
        self.fill = np.bincount(self.bin_of, sizes).astype(np.int64)

    def worth(self) -> tuple[int, float]:
        """Fewer bins are better; among equals, those that fill some bins well and leave room in others."""
        return -len(self.fill), float(np.square(self.fill.astype(float)).sum())


def best_fit(sizes: np.ndarray, order: np.ndarray, size: int, bin_of: np.ndarray | None = None, fill: np.ndarray | None = None) -> Packing:
    """Put pieces, in order, each into the fullest bin that has room, or else a new one."""
    bin_of = np.full(len(sizes), -1) if bin_of is None else bin_of.copy()
    room = [size - int(f) for f in (fill if fill is not None else [])]
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    some = 0  # bit r is set if some bin has r tokens of room
    for b, r in enumerate(room):
        by_room[r].append(b)
        some |= 1 << r
    for i, s in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fits = some >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                some &= ~(1 << r)
        else:
            b, r = len(room), size
            room.append(size)
        r -= s
        by_room[r].append(b)
        some |= 1 << r
        bin_of[i] = b
    return Packing(sizes, bin_of)


def crossover(rng: np.random.Generator, sizes: np.ndarray, a: Packing, b: Packing, size: int) -> Packing:
    """a with well-filled bins of b injected."""
    rank = np.argsort(-(b.fill + rng.random(len(b.fill))))
    share = rng.uniform(0.1, 0.6)
    chosen = np.zeros(len(b.fill), bool)
    chosen[rank[: max(1, int(share * len(rank)))]] = True
    chosen &= rng.random(len(chosen)) < 0.9
    injected = chosen[b.bin_of]
    broken = np.zeros(len(a.fill), bool)
    broken[a.bin_of[injected]] = True
    kept = ~broken[a.bin_of]
    bin_of = np.full(len(sizes), -1)
    bin_of[kept] = a.bin_of[kept]
    bin_of[injected] = len(a.fill) + b.bin_of[injected]
    placed = kept | injected
    names, bin_of[placed] = np.unique(bin_of[placed], return_inverse=True)
    fill = np.bincount(bin_of[placed], sizes[placed], minlength=len(names))
    loose = np.flatnonzero(~placed)
    return best_fit(sizes, loose[np.argsort(-sizes[loose], kind="stable")], size, bin_of, fill)


def evolve(sizes: np.ndarray, population: list[Packing], size: int, seed: int, first: bool = True) -> Packing:
    """The best packing after some generations on one island; generations: how many.

    first: whether the population starts with best-fit decreasing; its other members come from blurred orders.
    """
    rng, bound = np.random.default_rng(seed), least_bins(sizes, size)
    population = list(population)
    while len(population) < POPULATION:
        blur = sizes if first and not population else sizes * rng.uniform(0.8, 1.25, len(sizes))
        population.append(best_fit(sizes, np.argsort(-blur, kind="stable"), size))
    for n in range(1, GENERATIONS + 1):
        population.sort(key=Packing.worth, reverse=True)
        for k in range(1, POPULATION):
            mate = population[int(rng.integers(k))]
            child = crossover(rng, sizes, *((mate, population[k]) if rng.random() < 0.5 else (population[k], mate)), size)
            if child.worth() > population[k].worth():
                population[k] = child
        if min(len(p.fill) for p in population) <= bound:
            break
    best = max(population, key=Packing.worth)
    best.generations = n
    return best


def pack(pieces: DataFrame, size: int = 2048, seed: int = 7) -> DataFrame:
    """(rid, sequence_id, offset, block, bins, greedy_bins) for pieces (rid unique long >= 0, length from 1 to size).

    block is the block a piece was packed in (null for pieces that fill a sequence), bins the number of its sequences,
    greedy_bins that of best-fit decreasing alone. No rows give no rows.
    """
    none = F.lit(None).cast("long")
    whole = pieces.filter(F.col("length") == size).select("rid", (-F.col("rid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), none.alias("block"), none.alias("bins"), none.alias("greedy_bins"))
    part = pieces.filter(F.col("length") < size)
    blocks = max(1, -(-part.count() // BLOCK))
    block = F.pmod(F.xxhash64(F.lit(seed), "rid"), F.lit(blocks)).alias("block")

    def epoch(n: int):
        def run(key, t):
            island, arrived = key[1].as_py(), []
            for origin in np.unique(t["origin"].to_numpy()):  # its own packing and the one that migrated here
                one = t.filter(pa.compute.equal(t["origin"], int(origin))).sort_by("rid")
                sizes = one["length"].to_numpy()
                if n:
                    arrived.append(Packing(sizes, one["bin"].to_numpy()))
            p = evolve(sizes, arrived, size, abs(hash((seed, key[0].as_py(), island, n))), first=island == 0)
            greedy = one["greedy"].to_numpy() if n else np.full(len(sizes), len(best_fit(sizes, np.argsort(-sizes, kind="stable"), size).fill))
            more = {"bin": p.bin_of, "bins": np.full(len(sizes), len(p.fill)), "greedy": greedy, "island": np.full(len(sizes), island)}
            return pa.table({k: one[k] for k in ("rid", "length", "block")} | {k: pa.array(v.astype(np.int64)) for k, v in more.items()})

        return run

    islands = F.sequence(F.lit(0).cast("long"), F.lit(ISLANDS - 1).cast("long"))
    zero = F.lit(0).cast("long")
    now = part.select("rid", "length", block, zero.alias("bin"), zero.alias("greedy"), F.explode(islands).alias("island"), zero.alias("origin"))
    for n in range(EPOCHS):
        out = written(now.groupBy("block", "island").applyInArrow(epoch(n), "rid long, length long, block long, bin long, bins long, greedy long, island long"), "pack-epoch")
        elite = out.select("rid", "length", "block", "bin", "greedy", F.explode(F.array("island", F.pmod(F.col("island") + 1, F.lit(ISLANDS)))).alias("to"), F.col("island").alias("origin"))
        now = elite.withColumnRenamed("to", "island")
    winner = out.groupBy("block").agg(F.min(F.struct("bins", "island")).alias("w")).select(F.col("block").alias("of"), F.col("w.island").alias("won"))
    best = out.join(winner, (F.col("block") == F.col("of")) & (F.col("island") == F.col("won")))
    placed = best.groupBy("block", "bin", "bins", "greedy").agg(F.array_sort(F.collect_list(F.struct("rid", "length"))).alias("in"))  # at most `size` pieces
    offset = F.expr("transform(in, (x, i) -> struct(x.rid AS rid, coalesce(aggregate(slice(in, 1, i), 0L, (a, y) -> a + y.length), 0L) AS offset))")
    rows = placed.select((F.col("block") * (1 << 24) + F.col("bin")).alias("sequence_id"), F.explode(offset).alias("x"), "block", "bins", F.col("greedy").alias("greedy_bins"))
    return whole.unionByName(rows.select("x.rid", "sequence_id", "x.offset", "block", "bins", "greedy_bins"))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, vocabulary: str = "byte_bpe_50k.json", with_ids: bool = True) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset, those of pack() and, if wanted, ids.

    A document is its ids and the id 0; null counts as empty. Longer documents than size are cut into pieces of size
    ids, the first of which may be shorter. Rows that repeat an id are documents of their own, numbered as they come.
    Sequences have no gaps and no more than size ids. No rows give no rows. Very long texts are encoded whole. Other
    columns are not read, whatever their names.
    """
    crc = F.crc32("ids").alias("ids_crc32")
    keep = ["ids"] if with_ids else []
    coded = encode_pieces(docs, id_col, text_col, size, vocabulary)
    pieces = written(coded.select("id", "piece", "start", "length", crc, *keep).withColumn("rid", F.monotonically_increasing_id()), "pieces")
    placed = pack(pieces.select("rid", "length"), size)
    return pieces.join(placed, "rid").drop("rid").withColumnRenamed("id", id_col)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the ids of every sequence of pack_documents(), little-endian unsigned 32-bit."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(inside.alias("in")).select("sequence_id", F.expr("aggregate(in, X'', (a, x) -> concat(a, x.ids))").alias("ids"))
