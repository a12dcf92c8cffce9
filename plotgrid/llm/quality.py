"""Quality classifier that compares how well two dictionaries compress a text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotgrid.llm.common import calibration_fold, documents, fit_logistic, held_out, labelled_sample, logistic, prior_shift, table
from plotgrid.llm.registry import query
from plotgrid.session import cut_lineage

PER_CLASS = 4_500
PIECES_PER_TEXT = 4
PIECE_BYTES = 1_000
DICTIONARY_BYTES = 112_640
LEVEL = 3
ACCEPT = 0.3


@dataclass(frozen=True)
class QualityModel:
    """Dictionary of accepted and of rejected text, and the curve that calibrates the difference:
    score ``scores[i]`` at difference ``points[i]``, straight lines between."""

    good: bytes
    bad: bytes
    points: tuple[float, ...]
    scores: tuple[float, ...]


def train_dictionary(pieces: list[bytes]) -> bytes:
    """A trained dictionary, or the pieces themselves where they are too few to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(pieces)[-DICTIONARY_BYTES:]


def _compressor(content: bytes):
    if not content:
        return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
    trained = content[:4] == b"\x37\xa4\x30\xec"
    kind = zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressor(
        level=LEVEL, dict_data=zstandard.ZstdCompressionDict(content, dict_type=kind),
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )


def size_difference(text: str | None, good, bad) -> float:
    """Bytes that the good dictionary saves over the bad one, as a part of the text's bytes.

    The whole text goes through in pieces, since a long text soon is its own dictionary.
    """
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return 0.0
    saved = 0
    for at in range(0, len(data), PIECE_BYTES):
        piece = data[at : at + PIECE_BYTES]
        saved += len(bad.compress(piece)) - len(good.compress(piece))
    return saved / len(data)


def rising_curve(x: list[float], y: list[int]) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """(points, scores): share of label 1 as a function of x that never falls.

    Neighbouring values are pooled until the shares rise (isotonic regression); each pool
    counts one more row of the base rate. A twentieth of a logistic curve is mixed in, so the score still
    rises inside a pool.
    """
    order = np.argsort(x, kind="stable")
    x, y = np.asarray(x, dtype=float)[order], np.asarray(y, dtype=float)[order]
    base = (y.sum() + 1) / (len(y) + 2)
    line = fit_logistic(x, y)
    if line[0] == 0:
        return (0.0,), (float(base),)
    pools: list[list[float]] = []
    for value, label in zip(x, y):
        pools.append([value, value, label, 1.0])
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            _, high, ones, n = pools.pop()
            pools[-1] = [pools[-1][0], high, pools[-1][2] + ones, pools[-1][3] + n]
    points = np.array([p for low, high, _, _ in pools for p in (low, high)])
    shares = np.repeat([(ones + base) / (n + 1) for _, _, ones, n in pools], 2)
    shares = np.maximum.accumulate(shares)
    return tuple(points), tuple(0.95 * shares + 0.05 * logistic(points, line))


def score_column(text: Column, model: QualityModel, calibrated: bool = True) -> Column:
    """The calibrated score of every whole text, or the size difference itself."""
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        good, bad = _compressor(model.good), _compressor(model.bad)
        for texts in batches:
            x = np.array([size_difference(t, good, bad) for t in texts], dtype=float)
            yield pd.Series(np.interp(x, model.points, model.scores) if calibrated else x)

    return score.asNondeterministic()(text)  # evaluated once, also when its result is filtered


def _pieces(sample: DataFrame) -> list:
    """(label, piece) of the rows outside the calibration fold: evenly spaced pieces, few per text."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, pieces = [], []
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = (text or "").encode("utf-8", "surrogatepass")
                places = range(0, len(data), PIECE_BYTES)
                step = max(1, -(-len(places) // PIECES_PER_TEXT))
                for at in places[::step]:
                    labels.append(label)
                    pieces.append(data[at : at + PIECE_BYTES])
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(pieces, pa.binary())], names=["label", "piece"])

    rows = sample.where(~calibration_fold(F.col("doc_id"))).select(F.col("label").cast("int"), "text")
    return rows.mapInArrow(cut, "label int, piece binary").orderBy("label", F.xxhash64("piece"), "piece").collect()


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> QualityModel:
    """Model of a sample of at most ``per_class`` labelled documents of each class.

    Two thirds of the sample give the dictionaries' pieces (``PIECES_PER_TEXT`` of
    ``PIECE_BYTES`` of each), the rest calibrates the difference of the whole texts. Without
    labels of both classes the score is the base rate.
    """
    sample = cut_lineage(labelled_sample(docs, labels, label, per_class), "quality-sample")
    pieces = _pieces(sample)
    good = train_dictionary([bytes(r["piece"]) for r in pieces if r["label"] == 1])
    bad = train_dictionary([bytes(r["piece"]) for r in pieces if r["label"] == 0])
    if not good or not bad:
        good = bad = b""
    held = sample.where(calibration_fold(F.col("doc_id"))).select(
        score_column(F.col("text"), QualityModel(good, bad, (), ()), calibrated=False).alias("x"), "label"
    ).collect()
    truth = [r["label"] for r in held]
    points, scores = rising_curve([r["x"] for r in held], truth)
    factor = np.exp(prior_shift(labels, label, truth))
    scores = tuple(s * factor / (s * factor + 1 - s) for s in scores)
    return QualityModel(good, bad, points, scores)


def with_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``docs`` with quality_score in [0, 1], higher for text like the accepted one.

    A null or empty text has difference 0 and the score that belongs to it. Only the text is read;
    other columns pass through (a column of that name is replaced), repeated rows get equal scores.
    """
    return docs.withColumn("quality_score", score_column(F.col("text"), model))


def keep_good(docs: DataFrame, model: QualityModel, accept: float = ACCEPT) -> DataFrame:
    """The rows with a score of at least ``accept``, with the columns of ``docs``."""
    scored = docs.select(F.struct("*").alias("row"), score_column(F.col("text"), model).alias("score"))
    return scored.where(F.col("score") >= accept).select("row.*")


@query("op1_quality_classifier")
def op1_quality_classifier(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = with_quality(docs, model)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"),
        (F.col("quality_score") >= ACCEPT).cast("int").alias("predicted"),
    )
