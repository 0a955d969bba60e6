"""Sums of whole vectors by key: partial sums of arrays in each task, then one merge of sorted partials."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Keys whose partial sums a task holds before it hands them on.
HELD = 4096


def by_key(df: DataFrame, key: str, scalars: list[str], vectors: list[str]) -> DataFrame:
    """(key, scalars, vectors): sums of numbers and, element by element, of arrays of equal length. Each task adds up its rows as
    matrices and hands on a row a key; these are dealt and sorted by key and added as they pass."""
    kinds = dict(df.dtypes)
    names = [key, *scalars, *vectors]
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in names)

    def added(t: pa.Table | pa.RecordBatch) -> pa.RecordBatch:
        keys = t.column(0).to_numpy(zero_copy_only=False) if isinstance(t, pa.RecordBatch) else t.column(0).to_numpy()
        order = np.argsort(keys, kind="stable")
        ids, begin = np.unique(keys[order], return_index=True)
        out = [pa.array(ids, t.schema.field(0).type)]
        for n in range(1, len(names)):
            kind = t.schema.field(n).type
            x = t.column(n).to_numpy(zero_copy_only=False) if isinstance(t, pa.RecordBatch) else t.column(n).to_numpy()
            if pa.types.is_list(kind) or pa.types.is_large_list(kind):
                out.append(pa.array(list(np.add.reduceat(np.stack(x)[order], begin, axis=0)), kind))
            else:
                out.append(pa.array(np.add.reduceat(x[order], begin), kind))
        return pa.RecordBatch.from_arrays(out, names=names)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            one = added(batch)
            held = one if held is None else added(pa.Table.from_batches([held, one]))
            if held.num_rows > HELD:
                yield held
                held = None
        if held is not None:
            yield held

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # keys come sorted: all but the last of a batch are complete
        for batch in batches:
            if not batch.num_rows:
                continue
            one = added(batch if held is None else pa.Table.from_batches([held, batch.cast(held.schema)]))
            if one.num_rows > 1:
                yield one.slice(0, one.num_rows - 1)
            held = one.slice(one.num_rows - 1)
        if held is not None:
            yield held

    partial = df.select(*names).mapInArrow(part, schema)
    return partial.repartition(key).sortWithinPartitions(key).mapInArrow(merge, schema)
