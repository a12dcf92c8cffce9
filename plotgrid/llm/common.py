"""Pieces that several operators share: table reads, words, held-out rows, row identity."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotgrid.session import attach

HELD_OUT_FOLDS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return attach(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from every fit: crc32 of the id as text, modulo 5, is 0.
    A row without an id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_FOLDS == 0, F.lit(True))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits; none for a missing text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def with_columns_replaced(df: DataFrame, row: str, added: dict[str, Column]) -> DataFrame:
    """The fields of the struct ``row`` with ``added`` appended; a field of the same name gives way."""
    names = [f.name for f in df.schema[row].dataType.fields]
    taken = {name.lower() for name in added}
    kept = [F.col(row).getField(n).alias(n) for n in names if n.lower() not in taken]
    # worked out one step before the fields become columns, whose names may be any
    made = df.select(row, F.struct(*(c.alias(n) for n, c in added.items())).alias("added"))
    return made.select(*kept, *(F.col("added").getField(n).alias(n) for n in added))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id, text, label): at most ``per_class`` training documents of each label 0 and 1.

    Rows that ``held_out`` keeps back, labels other than 0 and 1, and documents labelled both ways are left
    out. The ids are chosen by hash before any text is read, so the choice is repeatable and
    the broadcast holds ``2 * per_class`` ids at most.
    """
    known = (
        labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("other"))
        .where(F.col("label") == F.col("other")).select("doc_id", "label")
    )
    chosen = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.union(part)
    chosen = chosen.select(F.col("doc_id").alias("chosen_id"), "label")
    texts = docs.select("doc_id", "text")
    return texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen_id")).select("doc_id", "text", "label")


def prior_shift(labels: DataFrame, label: str, sampled: list[int]) -> float:
    """What to add to log-odds learned on a sample so that they hold for the classes' shares among all
    training labels."""
    counts = {r[0]: r[1] for r in labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy(label).count().collect()}
    ones, zeros = sum(sampled), len(sampled) - sum(sampled)
    if not ones or not zeros or not counts.get(0) or not counts.get(1):
        return 0.0
    return float(np.log(counts[1] / ones) - np.log(counts[0] / zeros))


def calibration_fold(doc_id: Column) -> Column:
    """A third of the training rows, kept from the model and used to calibrate it."""
    return F.xxhash64(F.lit("calibration"), doc_id) % 3 == 0


def fit_logistic(x, y, ridge: float = 1e-2) -> tuple[float, float]:
    """(slope, intercept) of a logistic curve with a slope of at least 0; the base rate
    alone where only one class, or nothing, is given."""
    x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
    base = (y.sum() + 1) / (len(y) + 2)
    flat = (0.0, float(np.log(base / (1 - base))))
    if len(y) == 0 or y.min() == y.max() or x.std() == 0:
        return flat
    mean, scale = x.mean(), x.std()
    z = np.stack([(x - mean) / scale, np.ones_like(x)], axis=1)
    w = np.array([0.0, flat[1]])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) + ridge * np.array([w[0], 0.0])
        hessian = (z * (p * (1 - p))[:, None]).T @ z + np.diag([ridge, 1e-9])
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    if w[0] <= 0:
        return flat
    return float(w[0] / scale), float(w[1] - w[0] * mean / scale)


def logistic(x, curve: tuple[float, float]):
    return 1 / (1 + np.exp(-np.clip(np.asarray(x, dtype=float) * curve[0] + curve[1], -50, 50)))


class Memo:
    """Bounded memo of two generations: a full young one becomes the old one, what is used again moves back."""

    def __init__(self, size: int):
        self.size = size
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def recall(self, key: str) -> bytes | None:
        """The value of a key that is not in the young generation."""
        value = self.old.get(key)
        if value is not None:
            self.store(key, value)
        return value

    def store(self, key: str, value: bytes) -> None:
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value
