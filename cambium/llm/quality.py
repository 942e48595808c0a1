"""Quality classifier: regularised quadratic discriminant analysis.

Each class is a normal distribution over transformed statistics of a text. Its covariance is shrunk towards that of both
classes and then towards a multiple of the identity, so that few labelled rows are enough. The inverses of the Cholesky
factors are made once and sent to the workers. The score is the posterior of label 1 from the difference of the two
Mahalanobis log densities, divided by a temperature: statistics of one text depend on each other, which makes the plain
difference too sure of itself. Both shrinkages and the temperature are those of least log loss in cross-validation.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cambium.llm import stats
from cambium.llm.common import fresh, small_batches, text_slices, text_udf

D = len(stats.FEATURES)
#: What cross-validation chooses from: share of the pooled covariance in each class's, of the identity in that (statistics
#: are standardised before), and what log-density differences are divided by. The first of each stands where a label has
#: fewer than FOLDS * 2 rows.
POOLED, RIDGE, TEMPERATURE = (0.1, 0.02, 0.5), (0.02, 0.005, 0.1), (3.0, 1.0, 2.0, 5.0)
FOLDS = 4
#: Labelled rows that the model is fitted on, about; of more, those whose ids have the least hashes.
FIT_ROWS = 50_000
CUT = 0.3


@dataclass
class Model:
    center: np.ndarray
    scale: np.ndarray
    means: np.ndarray  # class, statistic
    roots: np.ndarray  # class, inverse of the lower Cholesky factor
    prior: float  # of label 1
    temperature: float

    def gaps(self, x: np.ndarray) -> np.ndarray:
        """Log density under label 1 less that under label 0."""
        z = (x - self.center) / self.scale
        logs = []
        for mean, root in zip(self.means, self.roots, strict=True):
            y = (z - mean) @ root.T
            logs.append(-0.5 * (y * y).sum(axis=1) + np.log(np.diag(root)).sum())
        return logs[1] - logs[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.round(self._posterior(self.gaps(x), self.temperature), 12)

    def _posterior(self, gaps: np.ndarray, temperature: float) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(gaps / temperature + np.log(self.prior / (1 - self.prior)), -500, 500)))


def discriminant(x: np.ndarray, label: np.ndarray, pooled: float, ridge: float, temperature: float) -> Model:
    """The model of rows x with labels 0 and 1, both of which occur twice or more."""
    center = x.mean(axis=0)
    scale = np.sqrt(np.maximum(x.var(axis=0), 1e-8))
    z = (x - center) / scale
    parts = [z[label == c] for c in (0, 1)]
    spread = [np.cov(p.T, bias=True) for p in parts]
    both = sum(len(p) * s for p, s in zip(parts, spread, strict=True)) / len(x)
    roots = []
    for cov in spread:
        cov = (1 - pooled) * cov + pooled * both
        cov = (1 - ridge) * cov + ridge * np.eye(D) * max(np.trace(cov) / D, 1e-3)
        roots.append(np.linalg.inv(np.linalg.cholesky((cov + cov.T) / 2)))
    return Model(center, scale, np.array([p.mean(axis=0) for p in parts]), np.array(roots), float(label.mean()), temperature)


def _loss(p: np.ndarray, label: np.ndarray) -> float:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return float(-np.log(np.where(label == 1, p, 1 - p)).sum())


def fit(x: np.ndarray, label: np.ndarray) -> Model | float:
    """Of rows in any fixed order. With under two rows of a label: the share of label 1 (0.5 if none)."""
    rows = [int((label == c).sum()) for c in (0, 1)]
    if min(rows) < 2:
        return rows[1] / sum(rows) if sum(rows) else 0.5
    best = (POOLED[0], RIDGE[0], TEMPERATURE[0])
    if min(rows) >= FOLDS * 2:
        fold = np.zeros(len(label), np.int64)
        for c in (0, 1):  # each fold has its share of either label
            fold[label == c] = np.arange(rows[c]) % FOLDS
        losses = dict.fromkeys(((p, r, t) for p in POOLED for r in RIDGE for t in TEMPERATURE), 0.0)
        for p in POOLED:
            for r in RIDGE:
                for k in range(FOLDS):
                    model = discriminant(x[fold != k], label[fold != k], p, r, 1.0)
                    gaps = model.gaps(x[fold == k])
                    for t in TEMPERATURE:
                        losses[p, r, t] += _loss(model._posterior(gaps, t), label[fold == k])
        best = min(losses, key=lambda choice: losses[choice])
    return discriminant(x, label, *best)


def held_out(column: str = "doc_id"):
    """Rows whose labels the classifier never sees. A null id has no label and isn't held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", fit_rows: int = FIT_ROWS) -> Model | float:
    """The model from the labelled rows of docs that are not held out, at most about fit_rows of them.

    Labels other than 0 and 1, null labels and labels of ids not in docs count for nothing. An id with both labels counts
    under each; one that stands twice in docs counts once, with the least of its statistics.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("labelled_id"), F.col("quality").cast("int").alias("label"))
    marks = marks.where(F.col("label").isin(0, 1) & F.col("labelled_id").isNotNull() & ~held_out("labelled_id")).distinct()
    share = fit_rows / max(fit_rows, marks.count())
    marks = marks.where(F.pmod(F.xxhash64("labelled_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # About fit_rows rows of two numbers: that bounds the broadcast, and what the driver gets.
    known = docs.select(F.col("doc_id").cast("long").alias("labelled_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(marks), "labelled_id")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            made = [stats.features(x.encode("utf-8")) for x in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(made, pa.list_(pa.float64()))], names=["id", "label", "v"])

    rows = known.select("labelled_id", "label", "text").mapInArrow(featured, "id long, label int, v array<double>")
    rows = rows.groupBy("id", "label").agg(F.min("v").alias("v")).toPandas().sort_values(["id", "label"])
    x = np.array(rows["v"].tolist(), np.float64).reshape(-1, D)
    return fit(x, rows["label"].to_numpy(np.int64))


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, columns: list[str] | None = None, text: str = "text", fit_rows: int = FIT_ROWS) -> tuple[DataFrame, list[str]]:
    """columns of docs (all by default), held_out, score and predicted, and the names under which those three stand.

    A score is made from the whole text alone (null: empty), in one pass that sends workers the texts and nothing else. For
    the labels that count see train. With under two rows of either label all scores are the share of label 1. Columns of
    docs that are named as the new ones stay, and the new names get an underscore. An empty docs gives an empty table.
    """
    small_batches(spark)
    keep = list(columns or docs.columns)
    names = fresh(docs, "held_out", "score", "predicted")
    shared = spark.sparkContext.broadcast(train(docs, labels, text, fit_rows))

    def scored(texts: list[str]) -> pa.Array:
        model = shared.value
        if not isinstance(model, Model):
            return pa.array([model] * len(texts), pa.float64())
        return pa.array(model.scores(np.array([stats.features(x.encode("utf-8")) for x in texts]).reshape(-1, D)))

    out = docs.withColumn(names[1], text_udf(scored, "double")(F.col(text).cast("string")))
    return out.select(*keep, held_out("doc_id").alias(names[0]), names[1], (F.col(names[1]) >= CUT).cast("int").alias(names[2])), names


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that are predicted 0; all columns of docs."""
    out, names = score(spark, docs, labels)
    return out.where(F.col(names[2]) == 1).select(*docs.columns)
