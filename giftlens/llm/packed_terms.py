"""Terms as machine words: length-bucketed packing, radix sorting and run counting in numpy.

A term of at most 8 bytes is one uint64, of at most 16 bytes two: its bytes from
the high end, zeros behind them, so that number order is byte order (no term
holds a zero byte). Longer terms stay bytes and are sorted in buckets of like
length. All functions work on bounded parts of texts inside a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SHORT = 16
_WIDEST = 256


def runs_of(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, bytes, document) of the maximal runs of marked bytes; a run ends with its document."""
    if not inside.any():
        return (np.zeros(0, np.int64),) * 3
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    full = np.diff(offsets) > 0
    at, last = offsets[:-1][full], offsets[1:][full] - 1
    begins[at] = inside[at]
    ends[last] = inside[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1 - starts, np.searchsorted(offsets, starts, "right") - 1


def _load(raw: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ``size`` (0 to 8) bytes from each place as a big-endian number, zeros behind. ``raw`` has 16 spare bytes."""
    words = np.ndarray((len(raw) - 7,), np.dtype(">u8"), raw, strides=(1,))
    shift = (np.uint64(64) - np.uint64(8) * size.astype(np.uint64))
    none = shift == 64
    shift[none] = 0
    out = (words[at].astype(np.uint64) >> shift) << shift
    out[none] = 0
    return out


def pack(raw: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, second word) of terms of at most 16 bytes."""
    raw = np.concatenate([raw, np.zeros(16, np.uint8)])
    first = _load(raw, starts, np.minimum(size, 8))
    second = np.zeros(len(starts), np.uint64)
    more = np.flatnonzero(size > 8)
    second[more] = _load(raw, starts[more] + 8, size[more] - 8)
    return first, second


def unpack(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all terms one behind another, bytes per term)."""
    cells = np.empty((len(first), 2), ">u8")
    cells[:, 0], cells[:, 1] = first, second
    cells = cells.view(np.uint8).reshape(len(first), SHORT)
    filled = cells != 0
    return cells[filled], filled.sum(axis=1)


def radix_order(*keys: np.ndarray) -> np.ndarray:
    """Stable order by the keys, the first key foremost: least digit first, 16 bits a pass; even digits cost nothing."""
    order = np.arange(len(keys[0]))
    for key in reversed(keys):
        key = key.astype(np.uint64, copy=False)
        spread = np.bitwise_or.reduce(key ^ key[0]) if len(key) else np.uint64(0)
        for shift in range(0, 64, 16):
            if (int(spread) >> shift) & 0xFFFF:
                digit = ((key >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def heads(*keys: np.ndarray) -> np.ndarray:
    """Marks the first row of each run of equal keys."""
    out = np.zeros(len(keys[0]), bool)
    out[:1] = True
    for key in keys:
        out[1:] |= key[1:] != key[:-1]
    return out


def totals(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each run whose first rows are marked."""
    at = np.flatnonzero(first)
    return np.add.reduceat(values, at) if len(at) else values[:0]


def long_numbers(terms: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """(the distinct terms, each term's place there): sorted in one bucket per power of two of their length."""
    size = np.fromiter(map(len, terms), np.int64, len(terms))
    place, found = np.zeros(len(terms), np.int64), []
    width = np.where(size > _WIDEST, 0, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        own = [terms[i] for i in at]
        kind = np.array(own, f"S{w}") if w else np.array(own + [None], object)[:-1]
        distinct, number = np.unique(kind, return_inverse=True)
        place[at] = len(found) + number
        found += distinct.tolist()
    return found, place


def strings(raw: np.ndarray, size: np.ndarray) -> pa.Array:
    """A large string column of terms that stand one behind another."""
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw.tobytes())])
