"""Removal of lines that many documents share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotgrid.llm.common import ascii_lower, documents, with_columns_replaced
from plotgrid.llm.registry import query
from plotgrid.session import cut_lineage

WHITE = " \t\n\x0b\x0c\r"
MIN_CHARS = 40
MIN_DOCUMENTS = 5


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc, text_hash, place, h1, h2): one row per line whose key is long enough.

    The key is 128 bits wide, so that lines of a corpus of any size do not collide.
    """
    return (
        docs.select(
            F.col("doc_id").alias("doc"),
            F.xxhash64("text").alias("text_hash"),
            F.posexplode(split_lines(F.col("text"))).alias("place", "line"),
        )
        .where(F.length("line") >= min_chars)
        .select("doc", "text_hash", "place", F.btrim("line", F.lit(WHITE)).alias("line"))
        .where(F.length("line") >= min_chars)
        .select("doc", "text_hash", "place", ascii_lower(F.col("line")).alias("key"))
        .select("doc", "text_hash", "place", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))
    )


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """Drop lines found in at least ``min_documents`` documents, except in the largest doc_id.

    A line's key is the line without outer white space, A-Z lower-cased; shorter keys than
    ``min_chars`` code points are never dropped. Returns the columns of ``docs`` with
    ``text`` reduced to the lines that stay, and n_lines, n_dropped (columns of these names
    are replaced). Only hashes and places are exploded; a document's text moves once, to
    meet the places to drop.

    A null or empty text is one empty line. Rows with equal doc_id are one document; a null
    doc_id is a document below all others. An empty table gives no rows.
    """
    lines = line_keys(docs, min_chars)
    # a table of its own: next to the join its aggregation would keep a very common line's rows in one task
    shared = cut_lineage(
        lines.groupBy("h1", "h2")
        .agg(F.count_distinct(F.struct("doc")).alias("n"), F.max("doc").alias("keeper"))
        .where(F.col("n") >= min_documents)
        .select("h1", "h2", "keeper"),
        "shared-lines",
    )
    drops = (
        lines.join(shared, ["h1", "h2"])
        .where(~F.col("doc").eqNullSafe(F.col("keeper")))
        .groupBy("doc", "text_hash")
        .agg(F.collect_set("place").alias("places"))
    )
    rows = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash")
    )
    joined = rows.join(
        drops, F.col("id").eqNullSafe(F.col("doc")) & (F.col("hash") == F.col("text_hash")), "left"
    ).select("row", "places", split_lines(F.col("row.text")).alias("lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("places"))
    kept = F.array_join(F.transform(stay, lambda i: F.col("lines")[i]), "\n")
    text = F.when(F.col("places").isNull(), F.coalesce(F.col("row.text"), F.lit(""))).otherwise(kept)
    return with_columns_replaced(joined, "row", {
        "text": text,
        "n_lines": F.size("lines").cast("bigint"),
        "n_dropped": F.when(F.col("places").isNull(), 0).otherwise(F.size("places")).cast("bigint"),
    })


CHECK = r"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(parts))) AS place, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT doc_id, place, line,
    translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.doc_id, k.place, k.line, s.key IS NOT NULL AND k.doc_id <> s.keeper AS gone
  FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op2_line_dedup", CHECK)
def op2_line_dedup(spark, sf_dir):
    kept = dedup_lines(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))
