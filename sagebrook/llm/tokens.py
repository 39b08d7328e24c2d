"""Vectorised splitting and hashing of texts held in Arrow buffers, in steps of bounded size."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
#: Bytes of text that one vectorised step takes; a longer text is cut into several.
STEP = 1 << 19
#: Runs of letters, digits or signs longer than this count as several.
LONGEST_RUN = 1 << 8

SPACE, LETTER, DIGIT, OTHER = range(4)


def _classes(words: bool) -> np.ndarray:
    table = np.full(256, LETTER if words else OTHER, np.uint8)
    if not words:
        for low, high, kind in ((ord("a"), ord("z"), LETTER), (ord("A"), ord("Z"), LETTER), (128, 255, LETTER), (ord("0"), ord("9"), DIGIT)):
            table[low : high + 1] = kind
    table[[32, *range(9, 14)]] = SPACE
    return table


#: By byte: white space or part of a word; and letters, digits and signs apart.
WORD_CLASS, RUN_CLASS = _classes(True), _classes(False)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Step(NamedTuple):
    """Consecutive whole rows, or a part of one long text."""

    first: int  # row of the first text
    data: np.ndarray
    offsets: np.ndarray
    begins: bool  # False: goes on with the text of the step before
    ends: bool  # False: the text goes on in the next step

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, raw_offsets, raw = column.buffers()
    offsets = np.frombuffer(raw_offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8), offsets


def _cut(data: np.ndarray, at: int, end: int, table: np.ndarray, longest: int | None, step: int) -> int:
    """Where the part that starts at ``at`` ends: the last edge between runs within ``step`` bytes.

    Inside a run that is longer than ``step`` the cut falls on a multiple of ``longest``, or,
    without that, behind the run's end; white space may be cut anywhere.
    """
    kind = table[data[at : at + step]]
    edges = np.flatnonzero(kind[1:] != kind[:-1])
    if len(edges):
        return at + int(edges[-1]) + 1
    if longest is not None or kind[0] == SPACE:
        return at + step
    to = at + step
    while to < end:
        other = np.flatnonzero(table[data[to : min(end, to + step)]] != kind[0])
        if len(other):
            return to + int(other[0])
        to = min(end, to + step)
    return end


def steps(column: pa.Array, table: np.ndarray, longest: int | None = None, step: int = STEP) -> Iterator[Step]:
    """The rows of a column of strings in steps of at most ``step`` bytes.

    A longer text comes alone, in parts that end between two runs of a class of ``table``.
    Only a single run without an allowed cut is longer than ``step``. ``step`` is a multiple of ``longest``.
    """
    n = len(column)
    if not n:
        return
    data, offsets = _flat(column)
    row = 0
    while row < n:
        to = int(np.searchsorted(offsets, offsets[row] + step, "right")) - 1
        if to > row:
            yield Step(row, data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row], True, True)
            row = to
            continue
        at, end = int(offsets[row]), int(offsets[row + 1])
        begins = True
        while end - at > step and (cut := _cut(data, at, end, table, longest, step)) < end:
            yield Step(row, data[at:cut], np.array([0, cut - at]), begins, False)
            at, begins = cut, False
        yield Step(row, data[at:end], np.array([0, end - at]), begins, True)
        row += 1


def overlapping(column: pa.Array, overlap: int, step: int = STEP) -> Iterator[Step]:
    """Steps of at most ``step`` bytes; the parts of a long text share ``overlap`` bytes with the part before."""
    n = len(column)
    if not n:
        return
    data, offsets = _flat(column)
    row = 0
    while row < n:
        to = int(np.searchsorted(offsets, offsets[row] + step, "right")) - 1
        if to > row:
            yield Step(row, data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row], True, True)
            row = to
            continue
        first, end = int(offsets[row]), int(offsets[row + 1])
        for at in range(first, end, step):
            low, high = max(first, at - overlap), min(end, at + step)
            yield Step(row, data[low:high], np.array([0, high - low]), at == first, high == end)
        row += 1


def runs(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, longest: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the runs of one class within a text, white space left out."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    kind = table[data]
    edge = np.r_[True, kind[1:] != kind[:-1]]
    edge[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(edge)
    ends = np.r_[starts[1:], len(data)]
    keep = kind[starts] != SPACE
    starts, ends = starts[keep], ends[keep]
    if longest is not None and len(starts) and (ends - starts).max() > longest:
        parts = -(-(ends - starts) // longest)
        own = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts, ends = np.repeat(starts, parts) + own * longest, np.repeat(ends, parts)
        ends = np.minimum(ends, starts + longest)
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _powers_of(base: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(2 * STEP, base, np.uint64)])


_POWERS: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    if not _POWERS:
        _POWERS.extend([_powers_of(_ODD), _powers_of(_INVERSE)])
    return _POWERS


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span, from running sums of the bytes times powers of an odd number."""
    powers, inverse = _powers()
    if len(data) > 2 * STEP:  # a single long word, summed in parts
        sums = []
        for a, b in zip(starts.tolist(), ends.tolist()):
            total = 0
            for at in range(a, b, STEP):
                part = data[at : min(b, at + STEP)]
                total += int(((part.astype(np.uint64) + np.uint64(1)) * powers[: len(part)]).sum()) * pow(_ODD, at - a, 1 << 64)
            sums.append(total % (1 << 64))
        return mixed(np.array(sums, np.uint64))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=total[1:])
    return mixed((total[ends] - total[starts]) * inverse[starts])


def sums_by_row(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Sums of ``values`` (first axis) over equal, ascending row numbers."""
    out = np.zeros((rows, *values.shape[1:]), np.float64)
    if len(row):
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        out[row[first]] = np.add.reduceat(values, first, axis=0, dtype=np.float64)
    return out


def gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as a binary array."""
    size = ends - starts
    offsets = np.r_[0, np.cumsum(size)]
    at = np.repeat(starts - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[at]))])
