"""Toxicity by a convolutional text classifier, trained in numpy.

A word is the concatenation of two hashed embeddings, of the word and of its first bytes. Filters of several widths
run over the words of the whole text; the maximum of each over the text feeds a logistic output, whose scale is
calibrated on labelled rows that the filters were not fitted to. The thresholds of the languages follow from the scores
of all labelled rows outside the fold but those that the filters were fitted to.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from lorespark.llm.shared import small_batches, spare, text_or_empty

#: Labelled rows of each class that the classifier is fitted and calibrated on, at most: those with the least hashes.
SAMPLE = 3000
#: Share of the sample that calibrates.
CALIBRATE = 0.2
#: Steps in which scores are counted for the thresholds; rows, and toxic or other ones, that a language needs for its own.
STEPS_OF_SCORE, LEAST_ROWS, LEAST_OF_CLASS = 1000, 30, 5
WORD_BUCKETS, START_BUCKETS, START_BYTES, DIMENSION = 1 << 18, 1 << 16, 4, 6
WIDTHS, FILTERS = (1, 2, 3), 8
EPOCHS, STEPS, BATCH, RATE = 6, 1200, 32, 0.1
#: Words whose filters are computed at once.
_AT_ONCE = 1 << 15


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word and start buckets of all texts in a row, each text ended by blanks (bucket 0); where each text starts."""
    blanks = max(WIDTHS)
    lists = [t.lower().split() for t in texts]
    lengths = np.array([len(x) + blanks for x in lists], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    word, start = np.zeros((2, starts[-1]), np.int32)
    for at, x in zip(starts, lists, strict=False):
        word[at : at + len(x)] = np.fromiter(map(crc32, x), np.uint32, len(x)) % (WORD_BUCKETS - 1) + 1
        start[at : at + len(x)] = np.fromiter(map(crc32, [w[:START_BYTES] for w in x]), np.uint32, len(x)) % (START_BUCKETS - 1) + 1
    return word, start, starts


@dataclass
class Classifier:
    word: np.ndarray
    start: np.ndarray
    kernel: np.ndarray  # (2 * DIMENSION, sum(WIDTHS) * FILTERS): a slab of FILTERS for each width and offset
    shift: np.ndarray
    out: np.ndarray
    bias: float = 0.0
    slope: float = 1.0
    offset: float = 0.0

    @staticmethod
    def blank(seed: int = 1) -> Classifier:
        rng = np.random.default_rng(seed)
        n = len(WIDTHS) * FILTERS
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        return Classifier(draw(WORD_BUCKETS, DIMENSION, scale=0.1), draw(START_BUCKETS, DIMENSION, scale=0.1), draw(2 * DIMENSION, sum(WIDTHS) * FILTERS, scale=0.3), np.zeros(n, np.float32), draw(n, scale=0.3))

    def embedded(self, word: np.ndarray, start: np.ndarray) -> np.ndarray:
        return np.concatenate([self.word[word], self.start[start]], axis=1)

    def filtered(self, x: np.ndarray) -> np.ndarray:
        """Every filter at every word, before the threshold; the last words see blanks only if x ends with them."""
        n, at = len(x) - max(WIDTHS) + 1, 0
        slabs, parts = x @ self.kernel, []
        for w in WIDTHS:
            parts.append(sum(slabs[k : n + k, (at + k) * FILTERS : (at + k + 1) * FILTERS] for k in range(w)))
            at += w
        return np.concatenate(parts, axis=1) + self.shift

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """The maximum of every filter over each whole text, in pieces of bounded size."""
        word, start, starts = features(texts)
        best = np.full((len(texts), len(self.shift)), -np.inf, np.float32)
        over = max(WIDTHS) - 1
        crossing = np.zeros(len(word), bool)  # places whose widest filter would reach into the next text
        crossing[(starts[1:, None] - np.arange(1, over + 1)).ravel()] = True
        for a in range(0, len(word) - over, _AT_ONCE):
            b = min(a + _AT_ONCE, len(word) - over)
            f = self.filtered(self.embedded(word[a : b + over], start[a : b + over]))
            f[crossing[a:b]] = -np.inf
            first = np.searchsorted(starts, a, side="right") - 1
            last = np.searchsorted(starts, b, side="left")
            cuts = np.maximum(starts[first:last] - a, 0)
            best[first:last] = np.maximum(best[first:last], np.maximum.reduceat(f, cuts, axis=0))
        return np.maximum(best, 0)

    def raw(self, texts: list[bytes]) -> np.ndarray:
        return (self.pooled(texts) @ self.out + self.bias).astype(float)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(texts) + self.offset, -30, 30))) if texts else np.zeros(0)


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 1) -> Classifier:
    """Adagrad over the logistic loss, both classes weighing the same, for EPOCHS epochs or, of few texts, up to STEPS steps. Words never seen stay neutral."""
    c, rng = Classifier.blank(seed), np.random.default_rng(seed)
    share = np.bincount(labels, minlength=2) / max(1, len(labels))
    weight = np.where(labels == 1, 0.5 / max(share[1], 1e-9), 0.5 / max(share[0], 1e-9))
    squares = [np.full_like(a, 1e-4) for a in (c.word, c.start, c.kernel, c.shift, c.out)]
    bias_square, seen, seen_start = 1e-4, np.zeros(WORD_BUCKETS, bool), np.zeros(START_BUCKETS, bool)

    def step(a: np.ndarray, square: np.ndarray, rows, gradient: np.ndarray) -> None:
        square[rows] += gradient**2
        a[rows] -= RATE * gradient / np.sqrt(square[rows])

    for _ in range(max(EPOCHS, min(60, STEPS * BATCH // max(1, len(texts))))):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), BATCH):
            chosen = order[i : i + BATCH]
            word, start, starts = features([texts[j] for j in chosen])
            seen[word], seen_start[start] = True, True
            x = c.embedded(word, start)
            f = c.filtered(x)
            place = np.stack([a + f[a : b - max(WIDTHS) + 1].argmax(axis=0) for a, b in zip(starts, starts[1:], strict=False)])
            top = np.maximum(np.take_along_axis(f, place, axis=0), 0)
            p = 1 / (1 + np.exp(-np.clip(top @ c.out + c.bias, -30, 30)))
            g = ((p - labels[chosen]) * weight[chosen] / len(chosen)).astype(np.float32)
            down = g[:, None] * c.out * (top > 0)
            kernel_g, x_g, at = np.zeros_like(c.kernel), {}, 0
            rows, parts = [], []
            for n, w in enumerate(WIDTHS):
                own = slice(n * FILTERS, (n + 1) * FILTERS)
                for k in range(w):
                    slab = slice((at + k) * FILTERS, (at + k + 1) * FILTERS)
                    spot = place[:, own] + k
                    kernel_g[:, slab] += np.einsum("bfd,bf->df", x[spot], down[:, own])
                    rows.append(spot.ravel())
                    parts.append((down[:, own, None] * c.kernel[:, slab].T).reshape(-1, 2 * DIMENSION))
                at += w
            spots, which = np.unique(np.concatenate(rows), return_inverse=True)
            x_g = np.zeros((len(spots), 2 * DIMENSION), np.float32)
            np.add.at(x_g, which, np.concatenate(parts))
            for table, square, ids, part in ((c.word, squares[0], word[spots], x_g[:, :DIMENSION]), (c.start, squares[1], start[spots], x_g[:, DIMENSION:])):
                own_ids, back = np.unique(ids, return_inverse=True)
                total = np.zeros((len(own_ids), DIMENSION), np.float32)
                np.add.at(total, back, part)
                step(table, square, own_ids, total)
            step(c.kernel, squares[2], ..., kernel_g)
            step(c.shift, squares[3], ..., down.sum(axis=0))
            step(c.out, squares[4], ..., g @ top)
            bias_square += float(g.sum()) ** 2
            c.bias -= RATE * float(g.sum()) / bias_square**0.5
    c.word[~seen], c.start[~seen_start] = 0, 0
    c.word[0], c.start[0] = 0, 0
    return c


def calibrate(c: Classifier, raw: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> None:
    """Scale the output by a logistic regression of the labels on it; weight makes the classes as common as they are."""
    a, b = 1.0, 0.0
    target = np.where(labels == 1, 0.98, 0.02)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
        g, h = weight * (p - target), np.maximum(weight * p * (1 - p), 1e-9)
        m = np.array([[(h * raw * raw).sum() + 1e-3, (h * raw).sum()], [(h * raw).sum(), h.sum() + 1e-3]])
        move = np.linalg.solve(m, [(g * raw).sum() + 1e-3 * (a - 1), g.sum() + 1e-3 * b])
        a, b = a - float(np.clip(move[0], -1, 1)), b - float(np.clip(move[1], -1, 1))
    if a > 0:
        c.slope, c.offset = a, b


def best_threshold(counts: np.ndarray) -> float:
    """The middle of the best range for F1, kept within 0.2 and 0.8, from counts (steps of score, 2) of clean and toxic rows."""
    steps = len(counts)
    toxic, every = (np.cumsum(c[::-1])[::-1] for c in (counts[:, 1], counts.sum(axis=1)))
    f1 = np.where(every > 0, 2 * toxic / np.maximum(1, every + toxic[0]), 0)
    k = steps - 1 - int(f1[::-1].argmax())
    below = np.flatnonzero(counts[:k].sum(axis=1))
    return float(np.clip((k + (below[-1] + 1 if len(below) else 0)) / 2 / steps, 0.2, 0.8))


@dataclass
class ToxicityModel:
    classifier: Classifier
    thresholds: dict[str, float]
    other: float = 0.5


def _number(id_col: str, folds: int) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic", folds: int = 5, sample: int = SAMPLE) -> ToxicityModel:
    """Fit on at most `sample` labelled rows of each class, and set thresholds by all labelled rows; those in fold 0 are never used.

    Rows without a label or an id, and labels other than 0 and 1, are left out; of labels that contradict each other
    the larger counts. Without rows of both classes every score is 0.5 times the share of toxic labels or less. Docs
    without a language column, and null languages, count for the threshold of all languages together. Very long texts
    are read whole, those of the sample by the driver. Columns may have any other names.
    """
    small_batches(docs.sparkSession)
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (_number(id_col, folds) != 0)).groupBy(F.col(id_col).alias("of")).agg(F.max(label_col).cast("int").alias("label"))
    rank = F.xxhash64(F.lit(5), "of")
    parts = [known.filter(F.col("label") == y).orderBy(rank, "of").limit(sample) for y in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # at most 2 * sample rows
    counts = dict(known.groupBy("label").count().collect())
    language = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    small = docs.select(F.col(id_col).alias("id"), language.alias("lang"), text_or_empty(text_col).alias("text"))
    rows = small.join(chosen, F.col("id") == F.col("of")).select("id", "label", "text").collect()
    rows = sorted({r["id"]: r for r in rows}.values(), key=lambda r: r["id"])
    y = np.array([r["label"] for r in rows], np.int64)
    if len(set(y.tolist())) < 2:
        c = Classifier.blank()
        c.out[:] = 0
        c.offset = float(np.log((0.25 + y.sum()) / (0.75 + len(y) - y.sum()))) if len(y) == 0 or not y.any() else 3.0
        return ToxicityModel(c, {})
    texts = [r["text"].encode() for r in rows]
    last = np.array([crc32(f"{r['id']}/part".encode()) % 1000 < 1000 * CALIBRATE for r in rows])
    c = fit([t for t, x in zip(texts, last, strict=True) if not x], y[~last])
    held = last if len(set(y[last].tolist())) == 2 else np.ones(len(rows), bool)
    some = [t for t, x in zip(texts, held, strict=True) if x]
    of_class = np.bincount(y[held], minlength=2)
    weight = np.array([counts.get(k, 1) / of_class[k] for k in (0, 1)])[y[held]]
    calibrate(c, c.raw(some), y[held], weight / weight.mean())
    fitted = docs.sparkSession.createDataFrame([(r["id"],) for r, x in zip(rows, held, strict=True) if not x], known.select("of").schema)  # at most 2 * sample rows
    # Scores are joined with the labels, rather than texts.
    scored = _scored(small.filter(F.col("id").isNotNull() & (_number("id", folds) != 0)), c, ["id", "lang"], "text")
    judged = scored.join(known.join(F.broadcast(fitted), "of", "left_anti"), F.col("id") == F.col("of"))
    step = F.least(F.floor(F.col("score") * STEPS_OF_SCORE), F.lit(STEPS_OF_SCORE - 1)).cast("int")
    histogram: dict[str | None, np.ndarray] = {}
    # At most two rows for each step and language.
    for r in judged.groupBy("lang", "label", step.alias("step")).count().collect():
        for key in {r["lang"], ""}:
            histogram.setdefault(key, np.zeros((STEPS_OF_SCORE, 2), np.int64))[r["step"], r["label"]] += r["count"]
    every = histogram.pop("", np.zeros((STEPS_OF_SCORE, 2), np.int64))
    enough = {k: h for k, h in histogram.items() if k is not None and h.sum() >= LEAST_ROWS and h.sum(axis=0).min() >= LEAST_OF_CLASS}
    return ToxicityModel(c, {k: best_threshold(h) for k, h in sorted(enough.items())}, best_threshold(every) if every[:, 1].any() else 0.5)


def _scored(docs: DataFrame, classifier: Classifier, kept: list[str], text_col: str) -> DataFrame:
    """The columns kept of docs, and score."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(vars(classifier))  # some 8 MB at any size of input
    (as_bytes,) = spare(docs, "text_bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(**sent.value)
        for b in batches:
            texts = [x.as_buffer().to_pybytes() for x in b.column(b.num_columns - 1)]
            scores = np.concatenate([np.zeros(0), *(model.scores(texts[i : i + 100]) for i in range(0, len(texts), 100))])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scores)], [*kept, "score"])

    with_bytes = docs.select(*kept, text_or_empty(text_col).cast("binary").alias(as_bytes))
    return with_bytes.mapInArrow(run, StructType([*docs.select(*kept).schema.fields]).add("score", DoubleType()))


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs with score (0 to 1, of the text alone) and toxic: whether it reaches its language's threshold.

    Null texts count as empty, and empty ones get the score of a text without words; unknown, null and absent languages
    get the threshold of all languages together. Rows that repeat a text have the same score; no rows give no rows.
    Very long texts are read whole, in pieces. Columns of docs called score or toxic are replaced; others stay.
    """
    kept = [c for c in docs.columns if c not in ("score", "toxic")]
    out = _scored(docs, model.classifier, kept, text_col)
    known = F.lit(model.other)
    if lang_col in kept:
        for language, t in model.thresholds.items():
            known = F.when(F.col(lang_col) == language, t).otherwise(known)
    return out.withColumn("toxic", F.col("score") >= known)
