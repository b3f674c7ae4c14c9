"""A hidden Markov language model over words.

The states emit symbols: the end of a text, each of the most frequent words, and hash buckets of all other words. A
word in a bucket has its smoothed share of the bucket's count, so the model is a distribution over texts of any words,
and its tables are bounded at any size of the corpus. Texts are turned into symbols once and written. Every round of
Baum-Welch counts transitions and emissions over all training texts, whole ones: long texts are cut into stretches, whose
ends get the forward and backward distributions of the whole text. The counts are summed in two levels before the driver
gets them, and rounds go on until the likelihood settles. The scaled forward recursion gives a text's exact likelihood.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.llm.shared import small_batches, text_or_empty, written

STATES, BUCKETS = 8, 1024
#: Words with symbols of their own; words whose counts every task knows (the others are joined); bytes of such a word.
SYMBOL_WORDS, KNOWN_WORDS, WORD_BYTES = 8192, 1 << 17, 64
#: Rounds of Baum-Welch at most, and the gain in natural logarithms a token under which they end.
ROUNDS, SETTLED = 4, 0.004
#: Steps of a long text that are taken at once; stretches meet in one symbol.
STRETCH = 512
#: Places of a padded matrix of texts; numbers of the distributions in training (scores have double precision, sums as well).
_PLACES, _NUMBERS = 1 << 17, np.float32
#: The word of the end of a text.
END = b""


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def count_words(texts: DataFrame) -> DataFrame:
    """(word, c) of a frame with one binary column; the end has a row if there is any text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(c: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c.keys(), pa.binary()), pa.array(c.values(), pa.int64())], ["word", "c"])

        held: Counter = Counter()
        for b in batches:
            for x in b.column(0):
                held.update(words_of(x.as_buffer().to_pybytes()))
                if len(held) > 200_000:
                    yield out(held)
                    held.clear()
            held[END] += b.num_rows
        if held[END]:
            yield out(held)

    return texts.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Model:
    """start (K), move (K, K), emit (symbols, K); known: the most frequent words and their places in symbol_of and log_of."""

    def __init__(self, known: list[tuple[bytes, int]], share: np.ndarray, bucket_log: np.ndarray, seed: int = 11):
        """known: words and counts, the most frequent first; log_of is that of the smoothed counts."""
        rng = np.random.default_rng(seed)
        self.known, self.share, self.bucket_log = {w: i for i, (w, _) in enumerate(known)}, share, bucket_log
        bucket = len(share) - BUCKETS
        self.symbol_of = np.array([i + 1 if i < SYMBOL_WORDS else bucket + crc32(w) % BUCKETS for i, (w, _) in enumerate(known)] or [0], np.int32)
        self.log_of = np.log10(np.array([c for _, c in known] or [0]) + 0.1)
        self.first_bucket = len(share) - BUCKETS
        self.counts = None
        self.start = np.full(STATES, 1 / STATES)
        self.move = np.full((STATES, STATES), 0.1 / (STATES - 1)) + np.eye(STATES) * (0.9 - 0.1 / (STATES - 1))
        emit = share[:, None] * np.exp(rng.normal(0, 0.5, (len(share), STATES)))
        self.emit = emit / emit.sum(axis=0)

    def symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of the words and the end; the places of the words in `known`, or -1."""
        place = np.fromiter(map(self.known.get, words, repeat(-1)), np.int32, len(words))
        out = np.zeros(len(words) + 1, np.int32)
        out[:-1] = self.symbol_of[place]
        for i in np.flatnonzero(place < 0).tolist():
            out[i] = self.first_bucket + crc32(words[i]) % BUCKETS
        return out, place

    def learn(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        """Estimate anew from expected counts, smoothed a little."""
        self.counts = [start, move, emit]
        self.start = (start + 1) / (start + 1).sum()
        self.move = (move + 0.5) / (move + 0.5).sum(axis=1, keepdims=True)
        weight = 0.02 * emit.sum(axis=0) + 50
        self.emit = (emit + self.share[:, None] * weight) / (emit.sum(axis=0) + weight)

    def likelihoods(self, texts: list[np.ndarray]) -> np.ndarray:
        """Natural logarithms, by the scaled forward recursion."""
        out = np.zeros(len(texts))
        for chosen, _, _, _, scale in self._forward(texts):
            np.add.at(out, [p[4] for p in chosen], np.log(scale).sum(axis=0))
        return out

    def _stretches(self, texts: list[np.ndarray], long: list[int]) -> list[tuple]:
        """The texts at those places as (symbols, opens, forward, backward, place): each stretch begins with the last symbol of the one before.

        forward is the distribution of the states at its first symbol, given all symbols so far; backward is in
        proportion to the probability of all symbols after its last, given the state there.
        """
        if not long:
            return []
        cut = [[t[i : i + STRETCH + 1] for i in range(0, len(t) - 1, STRETCH)] for t in (texts[k] for k in long)]
        full = [x for parts in cut for x in parts[:-1]]
        maps = np.empty((len(full), STATES, STATES))
        for at in range(0, len(full), 1024):
            body = np.stack(full[at : at + 1024])
            m = np.repeat(np.eye(STATES)[:, None, :], len(body), axis=1)  # state before, text, state after
            for t in range(1, STRETCH + 1):
                m = (m.reshape(-1, STATES) @ self.move).reshape(m.shape)
                m *= self.emit[body[:, t]]
                if t % 8 == 0:
                    m /= m.max(axis=(0, 2))[:, None]
            maps[at : at + 1024] = (m / m.max(axis=(0, 2))[:, None]).transpose(1, 0, 2)
        # From the end of each text back to where its last stretch begins.
        order = sorted(range(len(long)), key=lambda i: -len(cut[i][-1]))
        x, active = _padded([cut[i][-1][:0:-1] for i in order])
        back = np.ones((len(long), STATES))
        for t, n in enumerate(active):
            b = (self.emit[x[t, :n]] * back[:n]) @ self.move.T
            back[:n] = b / b.sum(axis=1, keepdims=True)
        out, at = [], 0
        for i, parts in enumerate(cut):
            own = maps[at : at + len(parts) - 1]
            at += len(parts) - 1
            a = self.start * self.emit[parts[0][0]]
            forward, backward = [a / a.sum()], [None, back[order.index(i)]]
            for m in own:
                a = forward[-1] @ m
                forward.append(a / a.sum())
            for m in own[:0:-1]:
                b = m @ backward[-1]
                backward.append(b / b.sum())
            out += [(x, k == 0, f, b, long[i]) for k, (x, f, b) in enumerate(zip(parts, forward, backward[::-1], strict=True))]
        return out

    def _forward(self, texts: list[np.ndarray], numbers: type = np.float64) -> Iterator[tuple]:
        """Pieces of whole texts in groups of much the same length, with their symbols, how many reach each step, forward distributions and scales."""
        short, long = ([i for i, t in enumerate(texts) if (len(t) > STRETCH + 1) == k] for k in (False, True))
        pieces = [(texts[i], True, None, None, i) for i in short] + self._stretches(texts, long)
        pieces.sort(key=lambda p: -len(p[0]))
        start, move, emit = (x.astype(numbers) for x in (self.start, self.move, self.emit))
        while pieces:
            n = max(1, min(512, _PLACES // len(pieces[0][0])))
            chosen, pieces = pieces[:n], pieces[n:]
            x, active = _padded([p[0] for p in chosen])
            goes_on = np.array([not p[1] for p in chosen])
            a, scale = np.zeros((*x.shape, STATES), numbers), np.ones(x.shape, numbers)
            for t, n in enumerate(active):
                now = emit[x[t, :n]]
                now *= a[t - 1, :n] @ move if t else start
                if t == 0 and goes_on.any():
                    now[goes_on] = [p[2] for p in chosen if not p[1]]
                scale[t, :n] = s = now.sum(axis=1)
                np.divide(now, s[:, None], out=a[t, :n])
            scale[0, goes_on] = 1
            yield chosen, x, active, a, scale

    def expected(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Baum-Welch counts of some whole texts: start, moves, emissions; their natural log likelihood."""
        start, move, emit, likely = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((len(self.share), STATES)), 0.0
        emissions, back = self.emit.astype(_NUMBERS), self.move.T.astype(_NUMBERS)
        for chosen, x, active, a, scale in self._forward(texts, _NUMBERS):
            likely += float(np.log(scale).sum(dtype=float))
            (steps, width), lengths, opens = x.shape, np.array([len(p[0]) for p in chosen]), np.array([p[1] for p in chosen])
            real = np.arange(steps)[:, None] < lengths
            e = emissions[x]
            e *= (real / scale)[:, :, None]
            b = np.ones((steps, width, STATES), _NUMBERS)
            for i, p in enumerate(chosen):
                if p[3] is not None:
                    b[lengths[i] - 1, i] = p[3] / (a[lengths[i] - 1, i] @ p[3])
            for t in range(steps - 2, -1, -1):
                n = active[t + 1]
                e[t + 1, :n] *= b[t + 1, :n]
                np.matmul(e[t + 1, :n], back, out=b[t, :n])
            move += self.move * (a[:-1].reshape(-1, STATES).T @ e[1:].reshape(-1, STATES))
            g = a * b
            start += g[0, opens].sum(axis=0, dtype=float)
            real[0, ~opens] = False  # counted as the last symbol of the stretch before
            flat, weight = x[real], g[real].T.astype(float)
            for s in range(STATES):
                emit[:, s] += np.bincount(flat, weight[s], minlength=len(emit))
        return start, move, emit, likely


def _padded(texts: list[np.ndarray]) -> tuple[np.ndarray, list[int]]:
    """Texts, longest first, as columns of a matrix; how many of them reach each row."""
    lengths = np.array([len(t) for t in texts])
    x = np.zeros((lengths[0], len(texts)), np.int32)
    for i, t in enumerate(texts):
        x[: len(t), i] = t
    return x, np.searchsorted(-lengths, -np.arange(lengths[0]), side="left").tolist()


def _frequent(counts: DataFrame) -> list:
    """The words with the highest counts, at most KNOWN_WORDS, by count and then by word.

    Each task of a top-k would send that many words. So the counts themselves, to twelve binary digits, are counted
    first, and only words above the least count that leaves few enough are collected.
    """
    size = F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.floor(F.log2("c")) - 11)).cast("long")
    rounded = F.col("c") - F.col("c") % size
    least, n = None, 0
    for r in sorted(counts.groupBy(rounded.alias("c")).count().collect(), key=lambda r: -r["c"]):
        n += r["count"]
        if n > KNOWN_WORDS:
            break
        least = r["c"]
    return [] if least is None else sorted(counts.filter(F.col("c") >= least).collect(), key=lambda r: (-r["c"], bytes(r["word"])))


def _first_model(counts: DataFrame) -> Model:
    short = counts.filter((F.col("word") != F.lit(END)) & (F.length("word") <= WORD_BYTES))
    frequent = _frequent(short)
    if len(frequent) < SYMBOL_WORDS:  # of the counts below, shared by too many words, the first words have symbols too
        below = short.filter(F.col("c") < frequent[-1]["c"]) if frequent else short
        frequent += below.orderBy(F.desc("c"), "word").limit(SYMBOL_WORDS - len(frequent)).collect()
    own = frequent[:SYMBOL_WORDS]
    known = [(bytes(r["word"]), r["c"]) for r in frequent]
    last = own[-1] if own else None
    # Below the last word with a symbol in the same order, or too long for one.
    rest = F.lit(True) if last is None else (F.length("word") > WORD_BYTES) | (F.col("c") < last["c"]) | ((F.col("c") == last["c"]) & (F.col("word") > F.lit(bytearray(last["word"]))))
    sums, kinds = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts.filter((F.col("word") != F.lit(END)) & rest).groupBy(F.pmod(F.crc32("word"), F.lit(BUCKETS)).alias("b")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect():
        sums[r["b"]], kinds[r["b"]] = r["c"], r["v"]
    ends = counts.filter(F.col("word") == F.lit(END)).first()
    share = np.concatenate([[ends["c"] if ends else 0], [r["c"] for r in own], sums + 0.1 * kinds]) + 0.1
    return Model(known, share / share.sum(), np.log10(sums + 0.1 * (kinds + 1)))


def _sent(docs: DataFrame, model: Model):
    return docs.sparkSession.sparkContext.broadcast(vars(model))  # bounded by KNOWN_WORDS and the numbers of symbols and states


def _received(sent) -> Model:
    m = Model.__new__(Model)
    vars(m).update(sent.value)
    return m


def fit(model: Model, training: DataFrame) -> list[float]:
    """Baum-Welch over training, a frame with one binary column of symbols (unsigned 16-bit); the log likelihood a token of each round."""
    shapes = ((STATES,), (STATES, STATES), (len(model.share), STATES), (2,))
    gained: list[float] = []
    while len(gained) < ROUNDS and (len(gained) < 2 or gained[-1] - gained[-2] >= SETTLED):
        sent = _sent(training, model)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m, total = _received(sent), None  # noqa: B023
            for b in batches:
                texts = [np.frombuffer(x.as_buffer(), np.uint16) for x in b.column(0)]
                *found, likely = m.expected(texts)
                found.append(np.array([likely, sum(map(len, texts))]))
                total = found if total is None else [x + y for x, y in zip(total, found, strict=True)]
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([p.ravel() for p in total]).tobytes()])], ["counts"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                for x in b.column(0):
                    one = np.frombuffer(x.as_buffer())
                    total = one if total is None else total + one
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["counts"])

        rows = training.mapInArrow(count, "counts binary").repartition(12).mapInArrow(add, "counts binary").collect()  # 12 rows of one size at most
        sent.unpersist()
        if not rows:
            break
        total = sum(np.frombuffer(r["counts"]) for r in rows)
        *parts, (likely, tokens) = (p.reshape(s) for p, s in zip(np.split(total, np.cumsum([np.prod(s) for s in shapes])[:-1]), shapes, strict=True))
        model.learn(*parts)
        gained.append(likely / tokens)
    return gained


def held_out(id_col: str) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from the rows whose crc32 of the id as text is not 0 modulo 10 (a null id counts as an empty
    one). Null texts count as empty: one token, the end. Scores are base-10 logarithms. Rows that repeat an id or a
    text are scored and counted each. Without training rows every base score is 0 per token; no rows give no rows.
    Very long texts are trained on and scored whole, in stretches. Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    small_batches(spark, 500)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("held"), text_or_empty(text_col).cast("binary").alias("text"))
    counts = written(count_words(rows.filter(~F.col("held")).select("text")), "word-counts")
    tokens, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    model = _first_model(counts)
    ends = (counts.filter(F.col("word") == F.lit(END)).select("c").collect() or [{"c": 0}])[0]["c"]
    sent = _sent(docs, model)
    end_log = float(np.log10(ends + 0.1))
    names = ["id", "held", "rid", "n", "local", "buckets", "known", "symbols", "rare"]
    far_type = pa.struct([("word", pa.binary()), ("times", pa.int64())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _received(sent)
        for b in batches:
            of_doc, starts, words_far, times_far = [], [0], [], []
            for x in b.column("text"):
                words = words_of(x.as_buffer().to_pybytes())
                symbols, place = m.symbols(words)
                far = Counter([words[i] for i in np.flatnonzero(place < 0).tolist()])
                words_far.extend(far.keys())
                times_far.extend(far.values())
                starts.append(len(words_far))
                near = place >= 0
                logs = m.log_of[place[near]]
                inside = symbols[:-1] >= m.first_bucket
                bucket_logs = logs[inside[near]].sum() - m.bucket_log[symbols[:-1][inside] - m.first_bucket].sum()
                of_doc.append((len(words) + 1, logs.sum() + end_log, bucket_logs, int(near.sum()) + (ends > 0), symbols.astype(np.uint16).tobytes()))
            d = list(zip(*of_doc, strict=True)) if of_doc else [[]] * 5
            columns = [pa.array(c, t) for c, t in zip(d, (pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.binary()), strict=True)]
            rare = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.StructArray.from_arrays([pa.array(words_far, pa.binary()), pa.array(times_far, pa.int64())], fields=list(far_type)))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("held"), b.column("rid"), *columns, rare], names)

    kind = "id long, held boolean, rid long, n long, local double, buckets double, known long, symbols binary, rare array<struct<word: binary, times: long>>"
    coded = written(rows.select("id", "held", F.monotonically_increasing_id().alias("rid"), "text").mapInArrow(encode, kind), "encoded")
    sent.unpersist()
    fit(model, coded.filter(~F.col("held")).select("symbols"))
    final = _sent(docs, model)

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _received(final)
        for b in batches:
            found = m.likelihoods([np.frombuffer(x.as_buffer(), np.uint16) for x in b.column(b.num_columns - 1)]) / np.log(10)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found)], [*names[:-2], "likely"])

    scored = coded.select(*names[:-1]).mapInArrow(likely, "id long, held boolean, rid long, n long, local double, buckets double, known long, likely double")
    rare = coded.select("rid", F.explode("rare").alias("r")).select("rid", "r.word", "r.times")
    met = rare.join(counts, "word", "left").select("rid", (F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1))).alias("far"), F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0).alias("met"))
    sums = met.groupBy("rid").agg(F.sum("far").alias("far"), F.sum("met").alias("met"))
    far = F.coalesce("far", F.lit(0.0))
    floor = float(np.log10(tokens + 0.1 * (kinds + 1)))
    return scored.join(sums, "rid", "left").select(
        F.col("id").alias(id_col), F.col("held").alias("held_out"), F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("met", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("local") + far - F.col("n") * floor).alias("base_score"), (F.col("likely") + F.col("buckets") + far).alias("score"),
    )
