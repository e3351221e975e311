"""Groups of rows in Arrow batches: one exchange, one sort, and a task that walks its groups.

For many small groups this costs far less than one Arrow stream per group; memory is bounded by one batch, ``BYTES`` and
the largest group, which callers keep bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomwright.llm.wordhash import trim

ROWS, BYTES = 20_000, 8 << 20


def map_groups(df: DataFrame, keys: list[str], f: Callable[[pa.Table], pa.Table | None], schema: str) -> DataFrame:
    """f over the rows of each value of the integer columns ``keys``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[pa.Table] = []

        def flush() -> Iterator[pa.RecordBatch]:
            yield from pa.concat_tables(out).combine_chunks().to_batches()
            out.clear()

        held: list[pa.RecordBatch] = []
        for batch in batches:
            step = max(1, min(ROWS, batch.num_rows * BYTES // max(1, batch.nbytes)))
            for low in range(0, batch.num_rows, step):
                held.append(batch.slice(low, step))
                table = pa.Table.from_batches(held).combine_chunks()
                cuts = boundaries(table, keys)
                for a, b in zip(cuts[:-2], cuts[1:-1], strict=False):
                    if (got := f(table.slice(a, b - a))) is not None:
                        out.append(got)
                held = table.slice(cuts[-2]).to_batches()
                if sum(t.num_rows for t in out) >= ROWS:
                    yield from flush()
        if held and (got := f(pa.Table.from_batches(held).combine_chunks())) is not None:
            out.append(got)
        if out:
            yield from flush()
        trim()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def boundaries(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where groups begin, and the end."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in keys:
        x = table[k].to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)
