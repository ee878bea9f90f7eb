"""Groups of rows as a Python task sees them, from a table sorted by their keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def by_cell(batches: Iterator[pa.RecordBatch], cell: list[str]) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Tables of whole groups from sorted batches, and where each group begins and ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        same = np.ones(batch.num_rows - 1, bool)
        columns = [batch.column(c).to_numpy() for c in cell]
        for c in columns:
            same &= c[1:] == c[:-1]
        breaks = np.flatnonzero(~same) + 1
        continues = bool(held) and all(held[-1].column(c)[-1].as_py() == batch.column(c)[0].as_py() for c in cell)
        if held and not continues:
            whole = pa.Table.from_batches(held)
            yield whole, [(0, whole.num_rows)]
            held = []
        if not len(breaks):
            held.append(batch)
            continue
        head = pa.Table.from_batches([*held, batch.slice(0, breaks[-1])])
        shift = head.num_rows - int(breaks[-1])
        edges = [0, *(breaks + shift).tolist()]
        yield head, list(zip(edges[:-1], edges[1:]))
        held = [batch.slice(breaks[-1])]
    if held:
        whole = pa.Table.from_batches(held)
        yield whole, [(0, whole.num_rows)]
