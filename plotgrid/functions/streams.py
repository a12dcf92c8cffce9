"""Arrow functions over streamed batches.

An Arrow function in a select keeps every row in a queue of the task until Python answers. Once a page of memory is
refused, that queue is a file that takes all later rows and is deleted when the task ends, so its size grows
with the rows of the task. Here whole batches go to Python and come back, and no row waits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def with_streamed(
    df: DataFrame, made: dict[str, tuple[str, Callable[[pa.RecordBatch], pa.Array]]], drop: tuple[str, ...] = ()
) -> DataFrame:
    """Append columns (name: type and function of a batch) and leave out those of ``drop``; others pass as they are."""
    passed = [f for f in df.schema.fields if f.name not in drop and f.name not in made]
    names = [f.name for f in passed]
    functions = {name: function for name, (_, function) in made.items()}

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(n) for n in names] + [function(batch) for function in functions.values()]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *functions])

    schema = T.StructType([*passed, *T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, (t, _) in made.items())).fields])
    return df.mapInArrow(stream, schema)
