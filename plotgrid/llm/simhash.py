"""Near duplicates by SimHash fingerprints and multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotgrid.llm.common import documents
from plotgrid.llm.components import components
from plotgrid.llm.registry import query
from plotgrid.session import cut_lineage

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of the text's word shingles, repeats included; 0 without a word.

    Bytes split at exactly the ASCII white space and ``lower`` touches A-Z only.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return digest(b" ".join(parts), SEED)
    shifted = [parts[i:] for i in range(words)]
    hashes = np.array([digest(s, SEED) for s in map(b" ".join, zip(*shifted))], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        block = hashes[at : at + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text as a signed 64-bit number."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(made.view(np.int64), pa.int64())], names=["doc_id", "fp"]
            )

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        of_batches, "doc_id bigint, fp bigint"
    )


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _plan(max_bits: int) -> list[tuple[int, int, int, int]]:
    """(table, mask, flip, low): every key that a fingerprint looks up.

    The 64 bits fall into ``max_bits + 1`` blocks. Table t's segment is all bits outside
    block t. Take two fingerprints within the limit and t the first block where they differ:
    outside it they differ in at most ``max_bits - 1`` bits, all in later blocks. So table t is
    asked for the Hamming ball of that radius over the later blocks' bits. Of two fingerprints
    whose segments differ, only the one that has 0 at the lowest differing bit asks.
    """
    edges = [64 * i // (max_bits + 1) for i in range(max_bits + 2)]
    plan = []
    for t in range(max_bits + 1):
        block = ((1 << edges[t + 1]) - 1) ^ ((1 << edges[t]) - 1)
        mask = ((1 << 64) - 1) ^ block
        for radius in range(max_bits):
            for bits in combinations(range(edges[t + 1], 64), radius):
                flip = sum(1 << b for b in bits)
                low = 1 << bits[0] if bits else 0
                plan.append((t, _signed(mask), _signed(flip), _signed(low)))
    return plan


def hamming_links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, other): every pair of distinct fingerprints at most ``max_bits`` bits apart, once.

    Segments leave out one block only, so a bucket holds fingerprints that agree in 42 bits
    or more; the pairs tried stay close to the pairs that hold, however large a
    group of near copies is.
    """
    if max_bits == 0:
        return distinct.select("fp", F.col("fp").alias("other")).where(F.lit(False))
    plan = F.array(*[
        F.struct(F.lit(t).alias("t"), F.lit(m).alias("mask"), F.lit(f).alias("flip"), F.lit(low).alias("low"))
        for t, m, f, low in _plan(max_bits)
    ])
    asks = (
        distinct.select("fp", F.explode(plan).alias("p"))
        .where(F.col("fp").bitwiseAND(F.col("p.low")) == 0)
        .select(
            "fp", F.col("p.t").alias("t"), (F.col("p.flip") == 0).alias("same"),
            F.col("fp").bitwiseAND(F.col("p.mask")).bitwiseXOR(F.col("p.flip")).alias("key"),
        )
    )
    segments = F.array(*[
        F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
        for t, m in sorted({(t, m) for t, m, _, _ in _plan(max_bits)})
    ])
    masks = F.array(*[F.lit(m) for _, m in sorted({(t, m) for t, m, _, _ in _plan(max_bits)})])
    differ = F.col("fp").bitwiseXOR(F.col("other"))
    held = distinct.select(F.col("fp").alias("other"), F.inline(segments).alias("t", "key"))
    return (
        asks.join(held.hint("merge"), ["t", "key"])  # either side holds many rows per fingerprint, more than size estimates say
        .where(F.bit_count(differ) <= max_bits)
        .where(differ.bitwiseAND(F.get(masks, F.col("t"))) != differ)  # they differ in the block that the table leaves out
        .where(~F.col("same") | (F.col("fp") < F.col("other")))
        .select("fp", "other")
    )


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id): every row with the least doc_id its links reach.

    Rows with equal fingerprints form one class and are never paired; links and components
    are worked out between distinct fingerprints only. A null or blank text has fingerprint 0 and
    links like any other. A null doc_id is carried along and never names a component unless
    all of it is null. Repeated rows give repeated rows, an empty table gives none; other columns
    are not read.
    """
    rows = cut_lineage(fingerprints(docs, words), "fingerprints")
    classes = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-classes")
    found = components(hamming_links(classes.select("fp"), max_bits), "fp", "other")
    linked = found.join(classes, F.col("node") == F.col("fp")).select("fp", "root", "least")
    ids = linked.groupBy("root").agg(F.min("least").alias("component"))
    named = classes.join(linked.select("fp", "root"), "fp", "left").join(ids, "root", "left").select(
        "fp", F.coalesce("component", "least").alias("component_id")
    )
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` whose doc_id names its own component; rows that repeat one doc_id
    stay together, rows without a doc_id stay."""
    gone = (
        near_duplicates(docs, words, max_bits)
        .where(F.col("doc_id") != F.col("component_id"))
        .select(F.col("doc_id").alias("gone_id")).distinct()
    )
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


@query("op3_simhash_near_dedup")
def op3_simhash_near_dedup(spark, sf_dir):
    found = near_duplicates(documents(spark, sf_dir), SHINGLE_WORDS, MAX_BITS)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")
