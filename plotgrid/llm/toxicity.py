"""Toxic passages as maximum-scoring segments of token log-odds."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotgrid.llm.common import calibration_fold, documents, fit_logistic, held_out, labelled_sample, logistic, prior_shift, table, words_of
from plotgrid.llm.registry import query
from plotgrid.session import cut_lineage

PER_CLASS = 6_000
PRIOR = 5.0
STEMS = (4, 5, 6)
WITNESSES = 2
DRIFT = 1.5
TRIM = 0.95
DECAYS = np.geomspace(0.05, 20, 240)
SIGNIFICANCE = 1e-3
ACCEPT = 0.5

WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class ToxicModel:
    """Scores of words and word stems, the tail of clean text's segment scores, the curve."""

    words: dict[str, float]
    stems: dict[str, float]
    decay: float
    scale: float
    curve: tuple[float, float]


def token_log_odds(sample: DataFrame) -> DataFrame:
    """(token, stem, score): log-odds of words and word stems between the classes.

    A document counts once for each of its tokens, so a text that repeats itself is one
    witness. Every token has a Dirichlet prior of ``PRIOR`` documents, divided as the tokens of
    both classes are, so rare tokens stay near 0. Tokens of fewer than ``WITNESSES`` documents are
    left out; they would stand nearest to 0. ``stem`` is 0 for words, else the stem's length.
    """
    words = sample.select("doc_id", "label", F.explode(F.array_distinct(words_of(F.col("text")))).alias("word"))
    stems = F.array(
        F.struct(F.col("word").alias("token"), F.lit(0).alias("stem")),
        *[F.when(F.length("word") > n, F.struct(F.substring("word", 1, n).alias("token"), F.lit(n).alias("stem"))) for n in STEMS],
    )
    tokens = (
        words.select("doc_id", "label", F.explode(stems).alias("t")).where(F.col("t").isNotNull())
        .select("doc_id", "label", "t.token", "t.stem").distinct()
        .groupBy("token", "stem").agg(F.sum("label").cast("double").alias("y1"), F.sum(1 - F.col("label")).cast("double").alias("y0"))
        .where(F.col("y1") + F.col("y0") >= WITNESSES)
    )
    totals = words.agg(F.sum("label"), F.sum(1 - F.col("label"))).first()
    n1, n0 = float(totals[0] or 0), float(totals[1] or 0)
    prior1 = PRIOR * n1 / max(n1 + n0, 1.0)
    prior0 = PRIOR - prior1
    if not n1 or not n0:
        return tokens.select("token", "stem", F.lit(0.0).alias("score"))
    # both classes' totals grow by the same part of themselves, so their ratio stays n1 / n0
    odds = F.log((F.col("y1") + prior1) / (F.col("y0") + prior0)) - float(np.log(n1 / n0))
    return tokens.select("token", "stem", odds.alias("score"))


def hits(text: str | None, words: dict[str, float], stems: dict[str, float]) -> tuple[Iterator[tuple[int, float, int, int]], int]:
    """(index, score, start, end) of every token with a score, one after another, and the number of tokens.

    A word counts with its own score or that of its longest scored stem.
    """
    low = (text or "").lower()

    def scored():
        for i, match in enumerate(WORD.finditer(low)):
            word = match.group()
            score = words.get(word)
            if score is None:
                score = next((s for k in reversed(STEMS) if len(word) > k and (s := stems.get(word[:k])) is not None), None)
            if score is not None:
                yield i, score, match.start(), match.end()

    return scored(), sum(1 for _ in WORD.finditer(low))


def maximal_segments(found: Iterable[tuple[int, float, int, int]], drift: float = DRIFT) -> list[tuple[float, int, int]]:
    """(score, start, end) of all maximal scoring segments, by one scan.

    Tokens without a score cost ``drift`` each. The list holds candidate segments with the
    running sums before and after them; a new token's segment joins the candidates back to the
    last one whose sum before it is lower, as long as that raises the score.
    """
    total, last, stack = 0.0, -1, []
    for index, score, start, end in found:
        total -= drift * (index - last - 1)
        last = index
        before, total = total, total + score
        if score <= 0:
            continue
        left, after, first = before, total, start
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= after:
                stack.append((left, after, first, end, j))
                break
            left, first = stack[j][0], stack[j][2]
            del stack[j:]
    return [(after - left, first, end) for left, after, first, end, _ in stack]


def statistic(segments: list[tuple[float, int, int]], n: int, decay: float, scale: float) -> float:
    """Joint strength of the segments: over all of them, how far minus the log of the number
    expected in clean text of this length lies above 0; the best one's value where none does.
    On a log scale on both sides of 0, since strong passages differ by their length more than by their kind."""
    values = [decay * s - np.log(scale * max(n, 1)) for s, _, _ in segments]
    x = max(max(values), sum(v for v in values if v > 0)) if values else -np.log(scale * max(n, 1) + 1)
    return float(np.copysign(np.log1p(abs(x)), x))


def tail_law(best: list[float], tokens: list[int]) -> tuple[float, float]:
    """(decay, scale) of the extreme-value law of the best segment's score in clean texts.

    The best of n tokens stays below s with probability ``exp(-scale * n * exp(-decay * s))``; a text
    without a segment has the best score 0. Both values are the likeliest ones on ``DECAYS``, with one
    text of mean length and best score 1 added. The share of the highest scores above ``TRIM`` is left out, as labels err.
    """
    s, n = np.asarray(best, dtype=float), np.asarray(tokens, dtype=float)
    if len(s):
        kept = s <= np.quantile(s, TRIM)
        s, n = s[kept], n[kept]
    s, n = np.append(s, 1.0), np.append(n, max(n.mean(), 1.0) if len(n) else 1.0)
    some = s > 0
    scales = np.array([some.sum() / np.sum(n * np.exp(-d * s)) for d in DECAYS])
    likelihood = some.sum() * np.log(scales * DECAYS) - DECAYS * s[some].sum()
    at = int(likelihood.argmax())
    return float(DECAYS[at]), float(scales[at])


def per_text(text: Column, words: dict[str, float], stems: dict[str, float], kind: str, names: list[str], result) -> Column:
    """``result(segments, number of tokens)`` of every whole text, as a struct of the type ``kind``."""
    @F.pandas_udf(kind)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for text in texts:
                found, n = hits(text, words, stems)
                out.append(result(maximal_segments(found), n))
            yield pd.DataFrame(out, columns=names)

    return scan.asNondeterministic()(text)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> ToxicModel:
    """Model of a sample of at most ``per_class`` labelled documents of each class.

    Token scores come from two thirds of the sample, the extreme-value law and the curve from the
    rest; of the rest only numbers reach the driver. A token's score is its log-odds less ``DRIFT``, the price of a passage's length, which
    unknown tokens pay too. Without labels of both classes no token stands out and the score is the base rate.
    """
    sample = cut_lineage(labelled_sample(docs, labels, label, per_class), "toxic-sample")
    odds = token_log_odds(sample.where(~calibration_fold(F.col("doc_id")))).collect()
    words = {r["token"]: r["score"] - DRIFT for r in odds if r["stem"] == 0}
    stems = {r["token"]: r["score"] - DRIFT for r in odds if r["stem"] > 0}
    held = sample.where(calibration_fold(F.col("doc_id")))
    best = held.where("label = 0").select(per_text(
        F.col("text"), words, stems, "best double, n long", ["best", "n"], lambda found, n: (max((s for s, _, _ in found), default=0.0), n)
    ).alias("b")).select("b.*").collect()
    decay, scale = tail_law([r["best"] for r in best], [r["n"] for r in best])
    rows = held.select("label", per_text(
        F.col("text"), words, stems, "x double", ["x"], lambda found, n: (statistic(found, n, decay, scale),)
    ).alias("s")).select("label", "s.x").collect()
    truth = [r["label"] for r in rows]
    slope, intercept = fit_logistic([r["x"] for r in rows], truth)
    return ToxicModel(words, stems, decay, scale, (slope, intercept + prior_shift(labels, label, truth)))


def with_toxicity(docs: DataFrame, model: ToxicModel, significance: float = SIGNIFICANCE) -> DataFrame:
    """``docs`` with toxic_score in [0, 1] and toxic_spans.

    toxic_spans lists every passage (start and end in code points of the lower-cased text, score)
    that clean text of this length holds with an expectation of at most ``significance``; in a text whose
    score reaches ``ACCEPT`` also those expected less than once, which make up its score, so that no text is called toxic without a
    passage. A null or empty text has no passage
    and the lowest score. Only the text is read; other columns pass through
    (columns of these names are replaced), repeated rows and ties get equal results, an empty table gives no rows.
    """
    decay, scale, curve = model.decay, model.scale, model.curve

    def judge(found, n):
        score = float(logistic(statistic(found, n, decay, scale), curve))
        limit = 1.0 if score >= ACCEPT else significance
        return score, [{"start": a, "end": b, "score": s} for s, a, b in found if scale * max(n, 1) * np.exp(-decay * s) <= limit]

    judged = docs.select(F.struct("*").alias("row"), per_text(
        F.col("text"), model.words, model.stems, "score double, spans array<struct<start:long,end:long,score:double>>", ["score", "spans"], judge
    ).alias("judged"))
    names = [c for c in docs.columns if c.lower() not in ("toxic_score", "toxic_spans")]
    return judged.select(
        *[F.col("row").getField(c).alias(c) for c in names],
        F.col("judged.score").alias("toxic_score"), F.col("judged.spans").alias("toxic_spans"),
    )


@query("op10_toxicity")
def op10_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = with_toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= ACCEPT).cast("int").alias("predicted"), F.size("toxic_spans").alias("n_passages"),
    )
