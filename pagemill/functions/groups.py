"""Arrow batches cut where groups end."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(it: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Sorted rows in tables that end where a group ends."""
    held: list[pa.RecordBatch] = []
    for batch in it:
        if not batch.num_rows:
            continue
        held.append(batch)
        t = pa.Table.from_batches(held)
        k = t.column(key).to_numpy()
        cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
        if len(cuts):
            yield t.slice(0, int(cuts[-1]))
            held = t.slice(int(cuts[-1])).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)
