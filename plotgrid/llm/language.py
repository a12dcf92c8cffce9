"""Language identification by averaged hashed subword embeddings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotgrid.llm.common import calibration_fold, documents, held_out
from plotgrid.llm.registry import query
from plotgrid.session import cut_lineage

SAMPLE = 6_000
FIRST_PIECE = 64
PIECE_GROWTH = 4
GRAMS = (1, 2, 3, 4)
BUCKETS = 1 << 15
DIMENSIONS = 16
EPOCHS = 4
RATE = 8.0
REJECTED = 0.01
MISLABELLED = 1e-4
UNKNOWN = "und"
BLOCK = 1 << 15
TEMPERATURES = np.geomspace(1e-3, 1e2, 240)


@dataclass(frozen=True)
class LanguageModel:
    """Weights per bucket and language (embedding times softmax layer), temperature, rejection level,
    and what the languages' shares among all training rows add to the log-odds learned on the sample."""

    names: tuple[str, ...]
    weights: np.ndarray
    temperature: float
    level: float
    shift: tuple[float, ...] | float = 0.0


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def code_points(text: str | None) -> np.ndarray:
    """Code points of the lower-cased text, one space for every run of other characters than letters, and at both ends."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    codes = np.where(letters()[codes], codes, 32)
    codes = np.concatenate(([32], codes, [32])).astype(np.uint32)
    again = (codes[1:] == 32) & (codes[:-1] == 32)
    return codes[np.concatenate(([True], ~again))]


def subword_buckets(codes: np.ndarray) -> np.ndarray:
    """Hash buckets of all subwords: runs of 1 to 4 characters of a word, whose ends count as characters."""
    space = codes == 32
    out = []
    for n in GRAMS:
        if len(codes) < n:
            break
        size = len(codes) - n + 1
        mixed = np.full(size, 2166136261 + n, dtype=np.uint32)
        inner = np.zeros(size, dtype=bool)
        for i in range(n):
            mixed = (mixed ^ codes[i : i + size]) * np.uint32(16777619)
            if 0 < i < n - 1:
                inner |= space[i : i + size]
        if n == 1:
            inner = space[:size]
        mixed ^= mixed >> np.uint32(15)
        out.append(mixed[~inner] & np.uint32(BUCKETS - 1))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)


def averaged(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Mean of the weights' rows over all subwords of the whole text, block by block."""
    total, n, reach = np.zeros(weights.shape[1]), 0, max(GRAMS) - 1
    for at in range(0, len(codes), BLOCK):
        part = codes[at : at + BLOCK + reach]
        counts = np.bincount(subword_buckets(part), minlength=BUCKETS)
        total += counts @ weights if len(part) > 2000 else weights[counts > 0].T @ counts[counts > 0]
        n += int(counts.sum())
    return total / max(n, 1)


def _probabilities(logits: np.ndarray, temperature: float, shift=0.0) -> np.ndarray:
    z = logits / temperature + np.asarray(shift)
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _train(examples: list[tuple[np.ndarray, np.ndarray, int]], n_languages: int) -> np.ndarray:
    """Embedding (BUCKETS x DIMENSIONS) and softmax layer by stochastic gradient descent, multiplied."""
    rng = np.random.default_rng(7)
    embedding = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)) / DIMENSIONS
    layer = np.zeros((DIMENSIONS, n_languages))
    prepared = [(buckets, counts / counts.sum(), y) for buckets, counts, y in examples]
    steps, done = EPOCHS * len(prepared), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(prepared)):
            buckets, share, y = prepared[i]
            rate = RATE * (1 - done / steps)
            hidden = share @ embedding[buckets]
            error = _probabilities(hidden @ layer, 1.0)
            error[y] -= 1.0
            back = layer @ error
            layer -= 0.1 * rate * np.outer(hidden, error)
            embedding[buckets] -= rate * np.outer(share, back)
            done += 1
    return embedding @ layer


def equal_quota(counts: list[int], total: int) -> int:
    """The largest number of rows of each class that keeps all classes together within ``total``."""
    left, ordered = total, sorted(counts)
    for i, n in enumerate(ordered):
        quota = left // (len(ordered) - i)
        if n > quota:
            return quota
        left -= n
    return ordered[-1] if ordered else 0


def language_sample(known: DataFrame, sample: int) -> tuple[DataFrame, dict[str, int]]:
    """(chosen, chosen_lang, rank) of at most ``sample`` documents, and the documents per language.

    Every language has the same quota by hash, and what small ones leave goes to the others, so a rare
    language keeps all its documents. Only where there are more than ``sample`` languages do the rarest stay out. Ids far
    above the quota are dropped by hash before they are ranked.
    """
    ids = known.select("doc_id", F.col("lang").cast("string").alias("lang"))
    found = (
        ids.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.02).alias("n"))
        .orderBy(F.desc("n"), "lang").limit(sample).collect()
    )
    counts = {r["lang"]: max(r["n"], 1) for r in found}
    quota = equal_quota(list(counts.values()), sample)
    near = 2 * quota + 50
    shares = known.sparkSession.createDataFrame(
        [(lang, 1.0 if n <= near else near / n) for lang, n in counts.items()], "chosen_lang string, share double"
    )
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(1 << 30)
    few = (
        ids.join(F.broadcast(shares), F.col("lang") == F.col("chosen_lang")).where(place < F.col("share"))
        .select(F.col("doc_id").alias("chosen"), "chosen_lang", place.alias("place")).distinct()
    )
    order = Window.partitionBy("chosen_lang").orderBy("place", F.xxhash64("chosen"), "chosen")
    chosen = few.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= quota)
    return chosen.drop("place"), counts


def lowest_share(values: np.ndarray, weights: np.ndarray, share: float) -> float:
    """The highest of ``values`` that has at most ``share`` of the weight below it."""
    order = np.argsort(values)
    reached = np.cumsum(weights[order]) / weights.sum()
    return float(values[order][min(int(np.searchsorted(reached, share, side="right")), len(values) - 1)])


def pieces(codes: np.ndarray) -> Iterator[np.ndarray]:
    """A whole text in parts of growing length, so that short and long texts are learned from alike."""
    at, size = 0, FIRST_PIECE
    while at < len(codes):
        yield codes[at : at + size]
        at, size = at + size, size * PIECE_GROWTH


def _examples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, buckets, counts) of every piece of every text, as numbers."""
    for batch in batches:
        out = []
        for lang, text in zip(batch["lang"], batch["text"]):
            for piece in pieces(code_points(text)):
                buckets, counts = np.unique(subword_buckets(piece), return_counts=True)
                if len(buckets):
                    out.append((lang, buckets.astype("<u4").tobytes(), counts.astype("<u4").tobytes()))
        yield pd.DataFrame(out, columns=["lang", "buckets", "counts"])


def best_temperature(logits: np.ndarray, truth: np.ndarray, weight: np.ndarray, shift: np.ndarray) -> float:
    """The temperature of least log loss. A share ``MISLABELLED`` of the rows is taken to be of another language, so
    the least loss lies at a finite temperature also where every row is told apart."""
    target = np.full(logits.shape, MISLABELLED / max(logits.shape[1] - 1, 1))
    target[np.arange(len(truth)), truth] = 1 - MISLABELLED

    def loss(t: float) -> float:
        return -((target * np.log(_probabilities(logits, t, shift) + 1e-300)).sum(axis=1) * weight).sum()

    return min((float(t) for t in TEMPERATURES), key=loss)


def fit(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """Model of at most ``sample`` training documents whose language is known, chosen by hash per language.

    Whole texts are learned from, in pieces of growing length (``pieces``). A third of the sample is held back from this: its
    pieces set the temperature of the softmax, and its whole texts the level below which a prediction is rejected,
    so that ``REJECTED`` of known text with letters falls below it. A language's first document always trains. Texts
    stay in tasks; the driver gets counts per hash bucket and scores. Rows of the sample weigh as many documents as they
    stand for, and the languages' shares among all training documents enter the log-odds.
    """
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    ids, counts = language_sample(known, sample)
    rows = (
        known.join(F.broadcast(ids), (F.col("doc_id") == F.col("chosen")) & (F.col("lang").cast("string") == F.col("chosen_lang")))
        .select(F.col("chosen_lang").alias("lang"), (calibration_fold(F.col("doc_id")) & (F.col("rank") > 1)).alias("held"), "text")
    )
    rows = cut_lineage(rows, "language-sample")
    found = rows.where(~F.col("held")).select("lang", "text").mapInPandas(_examples, "lang string, buckets binary, counts binary")
    train = found.orderBy("lang", F.xxhash64("buckets", "counts"), "buckets", "counts").collect()
    names = tuple(sorted({r["lang"] for r in train}))
    place = {name: i for i, name in enumerate(names)}
    examples = [(np.frombuffer(r["buckets"], "<u4"), np.frombuffer(r["counts"], "<u4"), place[r["lang"]]) for r in train]
    weights = _train(examples, max(len(names), 1)).astype(np.float32)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for lang, text in zip(batch["lang"], batch["text"]):
                codes = code_points(text)
                if lang in place and (codes != 32).any():
                    out.append((lang, True, averaged(codes, weights).tolist()))
                    out += [(lang, False, averaged(p, weights).tolist()) for p in pieces(codes) if (p != 32).any()]
            yield pd.DataFrame(out, columns=["lang", "whole", "logits"])

    held = rows.where("held").select("lang", "text").mapInPandas(scored, "lang string, whole boolean, logits array<double>").collect()
    quota = equal_quota(list(counts.values()), sample)
    stands_for = np.array([counts[name] / min(counts[name], quota) for name in names])
    shift = np.log(stands_for)
    temperature, level = 1.0, 0.0
    if held and len(names) > 1:
        def taken(whole: bool) -> tuple[np.ndarray, np.ndarray]:
            some = [r for r in held if r["whole"] == whole]
            return np.array([r["logits"] for r in some]), np.array([place[r["lang"]] for r in some])

        logits, truth = taken(False)
        temperature = best_temperature(logits, truth, stands_for[truth], shift)
        logits, truth = taken(True)
        level = lowest_share(_probabilities(logits, temperature, shift).max(axis=1), stands_for[truth], REJECTED)
    return LanguageModel(names, weights, temperature, level, tuple(shift.tolist()) or 0.0)


def with_language(docs: DataFrame, model: LanguageModel, reject: bool = True) -> DataFrame:
    """``docs`` with lang_pred, lang_score in [0, 1] and lang_rejected; an empty table gives no rows.

    A text that is null, empty or without a letter is ``und`` with score 0, and rejected. A
    calibrated probability below the model's level is rejected; with ``reject`` its lang_pred is ``und`` as
    well. A model without languages answers ``und``. Only the text is read; other columns pass
    through (columns of these names are replaced), repeated rows get equal results.
    """
    @F.pandas_udf("lang string, score double, rejected boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for text in texts:
                codes = code_points(text)
                if not model.names or not (codes != 32).any():
                    out.append((UNKNOWN, 0.0, True))
                    continue
                p = _probabilities(averaged(codes, model.weights), model.temperature, model.shift)
                best = int(p.argmax())
                refused = bool(p[best] < model.level)
                out.append((UNKNOWN if refused and reject else model.names[best], float(p[best]), refused))
            yield pd.DataFrame(out, columns=["lang", "score", "rejected"])

    judged = docs.select(F.struct("*").alias("row"), predict.asNondeterministic()("text").alias("p"))
    names = [c for c in docs.columns if c.lower() not in ("lang_pred", "lang_score", "lang_rejected")]
    return judged.select(
        *[F.col("row").getField(c).alias(c) for c in names],
        F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("lang_score"), F.col("p.rejected").alias("lang_rejected"),
    )


@query("op6_language_id")
def op6_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = fit(docs)
    found = with_language(docs.select("doc_id", "text"), model, reject=False)
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"),
        F.col("lang_rejected").alias("rejected"),
    )
