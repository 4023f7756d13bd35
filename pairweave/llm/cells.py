"""Groups of rows in sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

CELL = ("key", "left", "right")


def cell_tables(batches: Iterator[pa.RecordBatch], columns: Sequence[str] = CELL) -> Iterator[pa.Table]:
    """Rows sorted by integer ``columns``: one table for each of their values, whole."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        cells = np.stack([rest.column(c).to_numpy() for c in columns])
        cut = np.flatnonzero((cells[:, 1:] != cells[:, :-1]).any(axis=0)) + 1
        first = 0
        for end in cut:
            yield rest.slice(first, end - first)
            first = int(end)
        rest = rest.slice(first)
    if rest is not None and rest.num_rows:
        yield rest
