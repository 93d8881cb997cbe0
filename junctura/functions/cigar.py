"""CIGAR strings, many at a time, on NumPy.

All operations of a batch are parsed at once from the strings' bytes; nothing is done per read.
The same as columns of built-in functions is operators.reads.aligned_blocks, which is some
hundred times slower per core, as higher-order functions are interpreted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_BLOCK = np.zeros(256, bool)
_BLOCK[[ord(c) for c in "M=X"]] = True
MOVE = _BLOCK.copy()
MOVE[[ord(c) for c in "DN"]] = True
_SKIP_IN_BLOCK = ord("D")


def blocks(cigars: pa.Array, pos: np.ndarray, n_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of each aligned block, in order; null and "*" have none.

    With n_only, deletions count as part of a block.
    """
    col = (cigars.fill_null("") if cigars.null_count else cigars).cast(pa.large_binary())
    offs = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    data = np.frombuffer(col.buffers()[2], np.uint8)[offs[0] : offs[-1]] if col.buffers()[2] is not None else np.empty(0, np.uint8)
    offs = offs - offs[0]
    at = np.flatnonzero(~_DIGIT[data])
    row = np.searchsorted(offs, at, "right") - 1
    begin = np.maximum(np.concatenate(([0], at[:-1] + 1))[: len(at)], offs[row])
    size, scale = np.zeros(len(at), np.int64), 1
    for k in range(1, int((at - begin).max(initial=0)) + 1):
        there = at - k >= begin
        size[there] += (data[at[there] - k].astype(np.int64) - 48) * scale
        scale *= 10
    return placed(row, data[at], size, len(offs) - 1, pos, n_only)


def placed(row: np.ndarray, op: np.ndarray, size: np.ndarray, n_rows: int, pos: np.ndarray, n_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of each aligned block of operations, letters and lengths, given by row in order."""
    if n_only:
        op = np.where(op == _SKIP_IN_BLOCK, ord("M"), op)
    move = np.where(MOVE[op], size, 0)
    before = np.cumsum(move) - move
    first = np.searchsorted(row, np.arange(n_rows))
    base = pos[row] - (before[first[row]] if len(row) else 0)
    is_block = _BLOCK[op]
    start = (base + before)[is_block]
    return row[is_block], start, start + size[is_block]


def junctions(row: np.ndarray, start: np.ndarray, end: np.ndarray, min_anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, longer anchor) of gaps between neighbouring blocks with both anchors long enough."""
    if len(row) < 2:
        return (np.empty(0, np.int64),) * 4
    size = end - start
    ok = (row[1:] == row[:-1]) & (start[1:] > end[:-1]) & (size[1:] >= min_anchor) & (size[:-1] >= min_anchor)
    return row[1:][ok], end[:-1][ok], start[1:][ok], np.maximum(size[1:], size[:-1])[ok]


def pairs(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all pairs i < j of entries of one row; rows are contiguous."""
    left, right, step = [], [], 1
    while step < len(row):
        same = np.flatnonzero(row[step:] == row[:-step])
        if not len(same):
            break
        left.append(same)
        right.append(same + step)
        step += 1
    none = np.empty(0, np.int64)
    return np.concatenate(left or [none]), np.concatenate(right or [none])
