"""Online text classification and regression by gradient steps over hashed words and word pairs.

Words are hashed in the JVM; a task turns its Arrow batches into sparse rows and their gradient into one array of a
fixed size, and the arrays are added up in two rounds, so neither the number of rows nor that of tasks grows what the
driver gets. Weights may be kept in a folder, a version for each batch: a stopped stream goes on from the last whole
version, and a batch that is delivered twice counts once.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.sources.tables import last_version

#: Tasks that add up the gradients of all others.
SUMMING = 8
_WEIGHTS = "label string, weights array<double>, steps int"


def hashed_words(text: Column, features: int) -> Column:
    """The features of a text, repeats included: CRC-32 of its lower-case words and pairs of neighbours."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.size(words) + 1), lambda a, b: F.concat_ws(" ", a, b))
    return F.transform(F.concat(words, pairs), lambda w: (F.crc32(w.cast("binary")) % features).cast("int"))


def _sparse(lists: pa.Array, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of unit-length rows with counts of their features."""
    sizes = np.diff(lists.offsets.to_numpy())
    keys, counts = np.unique(np.repeat(np.arange(len(sizes)), sizes).astype(np.int64) * features + lists.flatten().to_numpy(), return_counts=True)
    row, column = np.divmod(keys, features)
    value = counts.astype(float)
    return row, column, value / np.sqrt(np.bincount(row, value**2, len(sizes)))[row]


def _outputs(weights: np.ndarray, row: np.ndarray, column: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(row, value * w[column], n) + w[-1] for w in weights], axis=1)


class _Online:
    """What both models share: weights of one row each class or output, their steps and versions."""

    def __init__(self, features: int = 10_000, rate: float = 0.5, decay: float = 1e-4, inner: int = 1, folder: str | None = None):
        self.features, self.rate, self.decay, self.inner, self.folder = features, rate, decay, inner, folder
        self.weights: dict[object, np.ndarray] = {}
        self.steps = 0

    @classmethod
    def resumed(cls, spark: SparkSession, folder: str, **settings):
        """The model as its last whole version in the folder has it; a new one if there is none."""
        model = cls(folder=folder, **settings)
        model.steps = last_version(spark, folder)
        if model.steps:
            for r in spark.read.schema(_WEIGHTS).parquet(f"{folder}/{model.steps}").collect():  # a row each class
                model.weights[model._label(r["label"])] = np.array(r["weights"])
        return model

    @staticmethod
    def _label(text: str):
        return text

    def _fit(self, rows: DataFrame, version: int | None) -> bool:
        """Steps on rows (x: features, y); False if this version has been there."""
        if version is not None and version <= self.steps:
            return False
        features, targets = self.features, self._targets()
        for _ in range(self.inner):
            weights = np.array([self.weights[k] for k in self.weights])

            def gradients(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total, n = np.zeros_like(weights), 0  # noqa: B023
                for b in batches:
                    row, column, value = _sparse(b.column(0), features)
                    off = targets(_outputs(weights, row, column, value, b.num_rows), b.column(1))  # noqa: B023
                    for c in range(len(total)):
                        total[c, :-1] += np.bincount(column, value * off[row, c], features)
                    total[:, -1] += off.sum(axis=0)
                    n += b.num_rows
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n])], ["g", "n"])

            parts = rows.mapInArrow(gradients, "g binary, n long").repartition(SUMMING).mapInArrow(_added, "g binary, n long").collect()  # SUMMING rows at most
            if not parts:
                break
            n = sum(p["n"] for p in parts)
            total = sum(np.frombuffer(p["g"]).reshape(weights.shape) for p in parts)
            weights -= self.rate * len(weights) * total / n
            weights[:, :-1] *= 1 - self.decay
            self.weights = dict(zip(self.weights, weights, strict=True))
        self.steps = self.steps + 1 if version is None else version
        if self.folder is not None:
            rows_out = [(str(k), w.tolist(), self.steps) for k, w in self.weights.items()]
            rows.sparkSession.createDataFrame(rows_out, _WEIGHTS).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/{self.steps}")
        return True

    def _scores(self, texts: list[str]) -> np.ndarray:
        out = []
        for text in texts:
            words = (text or "").lower().split()
            found = [crc32(t.encode()) % self.features for t in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]]
            row, column, value = _sparse(pa.array([found], pa.list_(pa.int32())), self.features)
            out.append(_outputs(np.array(list(self.weights.values())), row, column, value, 1)[0])
        return np.array(out)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = None, 0
    for b in batches:
        for g, k in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            part = np.frombuffer(g.as_buffer())
            total, n = part.copy() if total is None else total + part, n + k
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n])], ["g", "n"])


class OnlineModel(_Online):
    """One-against-all logistic regression; labels are texts or numbers, new ones get weights of their own."""

    def partial_fit(self, batch: DataFrame, text: str = "text", label: str = "label", version: int | None = None) -> OnlineModel:
        """inner steps on the rows of a batch that have a label. With a version, a batch that has been there is passed over."""
        known = batch.filter(F.col(label).isNotNull())
        if version is not None and version <= self.steps:
            return self
        for r in known.select(F.col(label).cast("string").alias("y")).distinct().collect():  # a row each class
            self.weights.setdefault(r["y"], np.zeros(self.features + 1))
        if self.weights:
            self._fit(known.select(hashed_words(F.col(text), self.features).alias("x"), F.col(label).cast("string").alias("y")), version)
        return self

    def _targets(self):
        names = list(self.weights)

        def off(z: np.ndarray, y: pa.Array) -> np.ndarray:
            return 1 / (1 + np.exp(-np.clip(z, -30, 30))) - (np.array(y.to_pylist(), object)[:, None] == np.array(names, object)[None])

        return off

    def predict(self, text: str) -> str | None:
        """The likeliest label, the first in order of equals; None before any was seen."""
        if not self.weights:
            return None
        scores = dict(zip(self.weights, self._scores([text])[0], strict=True))
        return max(sorted(scores), key=scores.get)


class OnlineRegressor(_Online):
    """Linear regression by squared loss; texts without words get the intercept."""

    def __init__(self, *args, **settings):
        super().__init__(*args, **settings)
        self.weights = {"value": np.zeros(self.features + 1)}

    def partial_fit(self, batch: DataFrame, text: str = "text", value: str = "value", version: int | None = None) -> OnlineRegressor:
        """inner steps on the rows of a batch that have a finite value."""
        known = batch.select(hashed_words(F.col(text), self.features).alias("x"), F.col(value).cast("double").alias("y"))
        self._fit(known.filter(F.col("y").isNotNull() & ~F.isnan("y") & (F.abs("y") < float("inf"))), version)
        return self

    def _targets(self):
        return lambda z, y: z - y.to_numpy()[:, None]

    def predict(self, text: str) -> float:
        return float(self._scores([text])[0, 0])

    def errors(self, rows: DataFrame, text: str = "text", value: str = "value") -> DataFrame:
        """One row (n, mse) over rows that have a value."""
        weights, features = np.array(list(self.weights.values())), self.features

        def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                z = _outputs(weights, *_sparse(b.column(0), features), b.num_rows)[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array((z - b.column(1).to_numpy()) ** 2)], ["e"])

        known = rows.filter(F.col(value).isNotNull()).select(hashed_words(F.col(text), features).alias("x"), F.col(value).cast("double").alias("y"))
        return known.mapInArrow(squares, "e double").agg(F.count("e").alias("n"), F.avg("e").alias("mse"))
