"""Arrow batches of texts, cut to a bounded number of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(batches: Iterator[pa.RecordBatch], col: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches as they are, in slices of at most ``limit`` bytes in ``col`` (one row at least)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(col))), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(ends):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def bounded(batches: Iterator[pa.RecordBatch], col: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``limit`` bytes in ``col`` (one row at least); nulls in ``col`` become empty.

    What a task holds is then set by the limit and by the longest single text, not by the batch size.
    """
    for batch in slices(batches, col, limit):
        k = batch.schema.get_field_index(col)
        yield batch.set_column(k, col, pc.fill_null(batch.column(k).cast(pa.large_binary()), b""))


def joined(text: pa.Array) -> tuple[bytes, np.ndarray]:
    """The bytes of all rows in one piece, and the offsets of the rows in it (one more than rows)."""
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    whole = b"" if data is None else data[int(offsets[0]) : int(offsets[-1])].to_pybytes()
    return whole, offsets - offsets[0]
