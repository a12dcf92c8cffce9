"""Global row numbers without sorting all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotgrid.session import cut_lineage


def with_row_number(df: DataFrame, lead: list[str], rest: list[str], name: str) -> DataFrame:
    """Zero-based position of every row in the order ``lead + rest``, which must be unique.

    Rows are dealt by ranges of the whole order and numbered inside their range; one count per
    range is brought together. A frequent ``lead`` value spreads over several ranges. The
    dealt rows are written once, so that a retried task cannot deal them differently; this runs a job
    when called.
    """
    order = [*lead, *rest]
    dealt = cut_lineage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("_part").agg(F.count("*").alias("_size")).select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy("_part").orderBy(*order)
    return (
        dealt.withColumn("_in", F.row_number().over(inside)).join(offsets, "_part")
        .withColumn(name, (F.col("_before") + F.col("_in") - 1).cast("bigint"))
        .drop("_in", "_before", "_part")
    )


def previous_row(df: DataFrame, keys: list[str], ts: str, order: list[str], columns: list[str], width: float) -> DataFrame:
    """Append ``prev_<column>``: the values of the row before, per key in ``order``.

    A key may hold a large share of all rows, so rows are ordered inside time buckets of
    ``width`` and only the last row of each bucket is handed to the next one. ``order``
    must start with ``ts`` (or follow it).
    """
    bucketed = df.withColumn("_bucket", F.floor(F.col(ts) / width))
    if columns == order[:1]:  # a plain maximum is counted without sorting
        tail = F.struct(F.max(columns[0]).alias(columns[0]))
    else:
        tail = F.max_by(F.struct(*columns), F.struct(*order))
    tails = bucketed.groupBy(*keys, "_bucket").agg(tail.alias("_tail"))
    over_buckets = Window.partitionBy(*keys).orderBy("_bucket")
    handed = tails.select(*keys, "_bucket", F.lag("_tail").over(over_buckets).alias("_handed"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    near = bucketed.withColumn("_near", F.lag(F.struct(*columns)).over(inside))
    joined = near.join(handed, [*keys, "_bucket"], "left")
    before = F.coalesce(F.col("_near"), F.col("_handed"))
    return joined.withColumns({f"prev_{c}": before[c] for c in columns}).drop("_bucket", "_near", "_handed")
