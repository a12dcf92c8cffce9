"""Benchmark decontamination: short test items found inside long documents."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotgrid.llm.common import documents, table, words_of
from plotgrid.llm.registry import query
from plotgrid.operators.sizes import broadcast_if_small
from plotgrid.session import cut_lineage

SHINGLE_WORDS = 5
THRESHOLD = Fraction(4, 5)


def shingle_rows(texts: DataFrame, key: str, size: int) -> DataFrame:
    """(key, w0, w1, ..): a row per shingle of neighbouring words of the column ``words``.

    A text of fewer words than ``size`` is one shingle
    (nulls for the words it lacks), a text without words gives no row.
    """
    parts = [F.slice("words", i + 1, F.greatest(F.size("words"), F.lit(1))).alias(f"w{i}") for i in range(size)]
    each = texts.select(
        key, F.greatest(F.size("words") - (size - 1), F.lit(1)).alias("n"),
        F.posexplode(F.arrays_zip(*parts)).alias("place", "s"),
    )
    return each.where(F.col("place") < F.col("n")).select(key, *(F.col(f"s.w{i}").alias(f"w{i}") for i in range(size)))


def _words(size: int) -> list[str]:
    return [f"w{i}" for i in range(size)]


def _hash(size: int) -> Column:
    return F.xxhash64(*_words(size)).alias("h")


def _shingle(size: int) -> Column:
    return F.concat_ws(" ", *_words(size)).alias("shingle")


def _with_words(texts: DataFrame) -> DataFrame:
    return texts.withColumn("words", words_of(F.col("text")))


def item_shingles(items: DataFrame, size: int, threshold: Fraction) -> DataFrame:
    """(item, q, in_sketch, h, shingle): every item's distinct shingles and its MinHash sketch.

    Items are partitioned by the power of two that bounds their number q of distinct
    shingles. A document that holds ``threshold`` of an item's shingles lacks fewer than
    ``floor((1 - threshold) * bound) + 1`` of them, so that many minimal hashes are the sketch
    size of the whole partition: one of them at least is in the document, no item is missed.
    """
    texts = items.select(F.col("item_id").alias("item"), words_of(F.col("text")).alias("words"))
    missing = 1 - threshold
    sets = (
        shingle_rows(texts, "item", size).select("item", _hash(size), _shingle(size)).distinct()
        .groupBy("item").agg(F.array_sort(F.collect_list(F.struct(
            F.xxhash64(F.lit("rank"), "h").alias("rank"), "h", "shingle"))).alias("ranked"))
        .withColumn("q", F.size("ranked"))
        .withColumn("bound", F.pow(F.lit(2), F.ceil(F.log2("q"))).cast("bigint"))
        .withColumn("sketch", F.expr(f"bound * {missing.numerator} div {missing.denominator} + 1"))
    )
    return sets.select("item", "q", "sketch", F.posexplode("ranked").alias("place", "s")).select(
        "item", "q", (F.col("place") < F.col("sketch")).alias("in_sketch"), "s.h", "s.shingle"
    )


def contained_items(
    docs: DataFrame, items: DataFrame, size: int = SHINGLE_WORDS, threshold: Fraction = THRESHOLD
) -> DataFrame:
    """(doc_id, item_id, n_item, n_found, containment): items of whose distinct word shingles
    the document holds at least ``threshold``.

    All shingles of all documents meet the items' sketches; the pairs found so are verified
    by the words of the shingles. An item of fewer words than a shingle is one shingle and
    matches documents of just these words; an item without a word matches nothing. Rows of
    equal doc_id (item_id) are one document (item), a null id is an id like any other.
    Empty tables give no rows; other columns are not read. The items' shingles are
    broadcast only where a count proves them few.
    """
    wanted = cut_lineage(item_shingles(items, size, threshold), "item-shingles")
    plain = docs.select(F.col("doc_id").alias("doc"), "text")
    sketches = broadcast_if_small(wanted.where("in_sketch").select(F.col("h").alias("hash"), "item"))
    pairs = cut_lineage(
        shingle_rows(_with_words(plain), "doc", size).select("doc", _hash(size))
        .join(sketches, F.col("h") == F.col("hash"))
        .select("doc", "item").distinct(), "containment-candidates"
    )
    chosen = pairs.select(F.col("doc").alias("chosen")).distinct()
    candidates = plain.join(chosen, F.col("doc").eqNullSafe(F.col("chosen")), "left_semi")
    full = broadcast_if_small(wanted.select("shingle", "item", "q"))
    asked = pairs.select(F.col("doc").alias("asked_doc"), F.col("item").alias("asked_item"))
    found = (
        shingle_rows(_with_words(candidates), "doc", size).select("doc", _shingle(size))
        .join(full, "shingle").groupBy("doc", "item", "q").agg(F.count_distinct("shingle").alias("n_found"))
        .join(asked, F.col("doc").eqNullSafe(F.col("asked_doc")) & F.col("item").eqNullSafe(F.col("asked_item")), "left_semi")
    )
    return found.where(F.col("n_found") * threshold.denominator >= F.col("q") * threshold.numerator).select(
        F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), F.col("q").cast("bigint").alias("n_item"),
        "n_found", (F.col("n_found") / F.col("q")).alias("containment"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = SHINGLE_WORDS, threshold: Fraction = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that contain no item."""
    bad = contained_items(docs, items, size, threshold).select(F.col("doc_id").alias("bad_id")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]), "left_anti")


CHECK = r"""
WITH texts AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') FROM benchmark
), places AS (
  SELECT side, id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM texts WHERE len(w) > 0
), shingled AS (
  SELECT DISTINCT side, id, array_to_string(w[p:p + 4], ' ') AS s FROM places
), items AS (
  SELECT id AS item_id, s, count(*) OVER (PARTITION BY id) AS q FROM shingled WHERE side = 'i'
), found AS (
  SELECT d.id AS doc_id, i.item_id, i.q AS n_item, count(*) AS n_found
  FROM shingled d JOIN items i ON d.s = i.s WHERE d.side = 'd' GROUP BY ALL
)
SELECT *, n_found / n_item AS containment FROM found WHERE n_found * 5 >= n_item * 4
"""


@query("op5_benchmark_decontamination", CHECK)
def op5_benchmark_decontamination(spark, sf_dir):
    return contained_items(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), SHINGLE_WORDS, THRESHOLD)
