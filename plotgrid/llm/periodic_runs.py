"""Periodic runs of words, found by recursive frequency splitting and a lag scan of what survives."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotgrid.llm.common import documents
from plotgrid.llm.registry import query

MIN_LENGTH = 24
REPEATS = 3
SLICE_BYTES = 4_000_000
PAIRS_AT_ONCE = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)

WORDS = r"[^\x20\x09-\x0D]+"
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
Run = tuple[int, int, int]


class Numbering(dict):
    """Numbers words in the order in which they first appear."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def surviving_segments(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, min_length: int, repeats: int) -> list[tuple[int, int]]:
    """Parts of the given segments of ``ids`` in which every word stands at least ``repeats`` times.

    A run of exponent ``repeats`` holds each of its words that often, so a word that is rarer within its
    segment lies in no run and splits the segment. The parts are counted anew, all of a round at
    once, until none is split; parts shorter than ``min_length`` go.
    """
    done: list[tuple[int, int]] = []
    n_words = int(ids.max(initial=0)) + 1
    while True:
        long_enough = ends - starts >= min_length
        starts, ends = starts[long_enough], ends[long_enough]
        if not len(starts):
            return sorted(done)
        sizes = ends - starts
        segment = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(segment)) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
        _, back, counts = np.unique(segment * n_words + ids[place], return_inverse=True, return_counts=True)
        rare = counts[back] < repeats
        split = np.bincount(segment[rare], minlength=len(sizes)) > 0
        done += zip(starts[~split].tolist(), ends[~split].tolist())
        kept = ~rare & split[segment]
        place, segment = place[kept], segment[kept]
        if not len(place):
            return sorted(done)
        begins = np.concatenate(([True], (np.diff(place) != 1) | (np.diff(segment) != 0)))
        starts = place[begins]
        ends = place[np.concatenate((begins[1:], [True]))] + 1


def _inside(found: list[Run], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether each stretch [low, high) lies in one of the runs."""
    if not found:
        return np.zeros(len(low), dtype=bool)
    spans = np.array(sorted((s, s + n) for s, n, _ in found), dtype=np.int64)
    reach = np.maximum.accumulate(spans[:, 1])
    at = np.searchsorted(spans[:, 0], low, side="right") - 1
    return (at >= 0) & (reach[at] >= high)


def _stretches(ids: np.ndarray, lag: int, places: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, length) of the maximal stretches of period ``lag`` that hold two equal blocks at one of ``places``."""
    size = len(ids) - lag
    breaks = np.concatenate(([-1], np.flatnonzero(ids[lag:] != ids[:size]), [size]))
    at = np.searchsorted(breaks, places)
    at = np.unique(at[breaks[at] >= places + lag])
    for start, end in zip((breaks[at - 1] + 1).tolist(), breaks[at].tolist()):
        yield start, end - start + lag


def lag_scan(ids: np.ndarray, min_length: int = MIN_LENGTH, repeats: int = REPEATS) -> list[Run]:
    """(start, length, period) of every maximal run of one segment, by start and period.

    A run of period q and length 3q or more holds two equal neighbouring blocks [kq, kq + q) and
    [kq + q, kq + 2q). So for every lag only the m / q such pairs are compared, by sums of word hashes; pairs that
    agree are extended exactly. Lags rise, and a pair inside a run that is already found has a multiple of that
    run's period as its lag and is passed over, so every run is found with its smallest period.
    """
    m, found = len(ids), []
    power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(m, BASE))), dtype=np.uint64)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(mixed * power[:m], dtype=np.uint64)))
    lags = np.arange(1, m // repeats + 1)
    pairs = m // lags - 1
    group = (np.cumsum(pairs) - pairs) // PAIRS_AT_ONCE
    for some in np.split(np.arange(len(lags)), np.flatnonzero(np.diff(group)) + 1) if len(lags) else []:
        n = pairs[some]
        lag = np.repeat(lags[some], n)
        place = (np.arange(len(lag)) - np.repeat(np.cumsum(n) - n, n)) * lag
        middle, end = sums[place + lag], sums[place + 2 * lag]
        equal = (middle - sums[place]) * power[lag] == end - middle
        lag, place = lag[equal], place[equal]
        while len(lag):
            new = ~_inside(found, place, place + 2 * lag)
            lag, place = lag[new], place[new]
            if not len(lag):
                break
            q = int(lag[0])
            this = lag == q
            for start, length in _stretches(ids, q, place[this]):
                if length >= max(min_length, repeats * q):
                    found.append((start, length, q))
            lag, place = lag[~this], place[~this]
    return sorted((s, n, q) for s, n, q in found)


def runs_of(texts: list[bytes | None], min_length: int, repeats: int) -> Iterator[tuple[int, list[Run], bytes]]:
    """(number of words, runs, collapsed text) of each text."""
    words = [(t or b"").split() for t in texts]  # ASCII white space only, as for all bytes
    number = Numbering()
    ids = np.fromiter((number[w] for part in words for w in part), dtype=np.int64, count=sum(map(len, words)))
    ends = np.cumsum([len(part) for part in words], dtype=np.int64)
    starts = ends - np.array([len(part) for part in words], dtype=np.int64)
    runs: list[list[Run]] = [[] for _ in texts]
    for low, high in surviving_segments(ids, starts, ends, min_length, repeats):
        text = int(np.searchsorted(ends, low, side="right"))
        lead = low - int(starts[text])
        runs[text] += [(s + lead, n, q) for s, n, q in lag_scan(ids[low:high], min_length, repeats)]
    for part, own in zip(words, runs):
        own.sort(key=lambda r: (r[0], r[2]))
        kept = part
        if own:
            drop = np.zeros(len(part), dtype=bool)
            for start, length, period in own:
                drop[start + period : start + length] = True
            kept = [w for w, gone in zip(part, drop.tolist()) if not gone]
        yield len(part), own, b" ".join(kept)


def _slices(texts: list[bytes | None]) -> Iterator[list[bytes | None]]:
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text or b"")
        if size >= SLICE_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def runs_column(text: Column, min_length: int = MIN_LENGTH, repeats: int = REPEATS) -> Column:
    """struct(n_words, runs, collapsed) of every whole text."""
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    @F.arrow_udf(f"n_words bigint, runs {RUNS}, collapsed string")
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            counts, lists, texts = [], [], []
            for part in _slices(batch.cast(pa.binary()).to_pylist()):
                for n, runs, collapsed in runs_of(part, min_length, repeats):
                    counts.append(n)
                    lists.append([{"start": s, "length": m, "period": q} for s, m, q in runs])
                    texts.append(collapsed)
            yield pa.StructArray.from_arrays(
                [pa.array(counts, pa.int64()), pa.array(lists, pa.list_(run)), pa.array(texts, pa.binary()).cast(pa.string())],
                names=["n_words", "runs", "collapsed"],
            )

    return scan.asNondeterministic()(text)  # evaluated once, also when several fields are read


def with_runs(docs: DataFrame, min_length: int = MIN_LENGTH, repeats: int = REPEATS) -> DataFrame:
    """``docs`` with n_words, runs (start, length and period in words, by start and period) and collapsed_text.

    A run is a stretch of words with smallest period q and at least ``max(min_length, repeats * q)`` words that no neighbouring
    word continues. collapsed_text keeps of every run its first period, and all words outside, joined by one space. A null or
    empty text, or one of white space, has no word, no run and the empty collapsed text. Runs may overlap; all
    are listed, with ties of start by period. Whole texts of any length are scanned, one text at a time in memory beside its batch.
    Only the text is read; other columns pass through (columns of the new names are replaced), repeated
    rows get equal results, an empty table gives no rows. ``repeats`` is at least 3: the lag scan needs two whole blocks.
    """
    if repeats < 3:
        raise ValueError("a run repeats three times at least")
    judged = docs.select(F.struct("*").alias("row"), runs_column(F.col("text"), min_length, repeats).alias("found"))
    added = {"n_words": "n_words", "runs": "runs", "collapsed_text": "collapsed"}
    names = [c for c in docs.columns if c.lower() not in added]
    return judged.select(
        *[F.col("row").getField(c).alias(c) for c in names], *[F.col(f"found.{old}").alias(new) for new, old in added.items()]
    )


def strongest(runs: Column) -> Column:
    """The run of greatest length / period, compared exactly; of equals the first by start and period. NULL without runs."""
    return F.reduce(
        F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0))), F.try_element_at(runs, F.lit(1)),
        lambda best, run: F.when(run["length"] * best["period"] > best["length"] * run["period"], run).otherwise(best),
    )


def with_planted_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` where the tail of every tenth text, by the hash of its id, repeats one period; other texts stay."""
    h = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(1))
    marked = docs.withColumn("h", h).withColumn(
        "all_words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORDS), F.lit(0)))
    )
    numbers = marked.withColumn("n", F.size("all_words").cast("bigint")).withColumn("g", F.expr("h div 10"))
    numbers = numbers.withColumn("a", F.when(F.col("n") > 0, F.expr("g % n")))
    numbers = numbers.withColumn("p", F.when(F.col("n") > 0, F.expr("1 + (n - a) div (3 + g % 8)")))
    tail = F.expr("transform(sequence(a, n - 1), i -> element_at(all_words, cast(1 + a + (i - a) % p as int)))")
    text = F.when(F.col("n") > 0, F.array_join(F.concat(F.expr("slice(all_words, 1, cast(a as int))"), tail), " "))
    return numbers.select("doc_id", F.coalesce(text, F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """One row per document: number of runs, the strongest one, and digests of all runs and of the collapsed text."""
    best = found.withColumn("best", strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return best.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.encode(F.array_join(lines, ""), "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed_text", "UTF-8"), 256).alias("collapsed_sha256"),
    )


@query("op11_periodic_runs")
def op11_periodic_runs(spark, sf_dir):
    docs = with_planted_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return digests(with_runs(docs))
