"""Small helpers over arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def spans(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each length, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths) + np.repeat(first, lengths)


def flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the items of all lists, for each its row); a null list has none."""
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    return lists.flatten(), np.repeat(np.arange(len(lists)), n)


def numbers(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """flat() of lists of whole numbers."""
    items, row = flat(lists.combine_chunks())
    return items.to_numpy().astype(np.int64), row
