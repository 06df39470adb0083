"""Rules that depend on all that came before: rows of a key, folded in order.

Rows are dealt by key and sorted by Spark, which spills; one pass over the sorted batches
carries a key and its state from row to row and batch to batch, so a key of any length
takes the memory of one batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows that are taken apart at once.
ROWS = 10_000


def fold_in_order(rows: DataFrame, key: str, order: list[str], step: Callable[[object, dict], tuple[object, tuple]], added: str) -> DataFrame:
    """rows with the columns `added` ('name type, ...'): step(state, row) gives the next state and the row's own values.

    The state is None before a key's first row. Null keys are one key; rows of one key that
    are equal in `order` come in any order. No rows, no result.
    """
    columns = rows.columns
    names = [*columns, *[c.split()[0] for c in added.split(", ")]]
    types = {"boolean": pa.bool_(), "long": pa.int64()}
    kinds = [types[c.split()[1]] for c in added.split(", ")]
    at = columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), None
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                b, out = whole.slice(start, ROWS), []
                for k, row in zip(b.column(at).to_pylist(), b.to_pylist(), strict=True):
                    if k != last:
                        last, state = k, None
                    state, found = step(state, row)
                    out.append(found)
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True))], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, f"{schema}, {added}")
