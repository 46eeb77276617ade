"""Tokens of many texts at once, as numpy arrays over an Arrow column's own bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

_KIND = np.full(256, 2, np.uint8)  # 0 white space, 1 word, 2 other signs
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = _KIND == 0
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null rows are empty."""
    column = column.cast(pa.large_binary())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1 + column.offset)[column.offset :].copy()
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    if column.null_count:
        lengths = np.where(np.asarray(column.is_valid()), np.diff(offsets), 0)
        if lengths.sum() != offsets[-1]:
            keep = np.repeat(np.asarray(column.is_valid()), np.diff(offsets))
            data = data[keep]
        offsets = np.concatenate(([0], np.cumsum(lengths)))
    return data, offsets


_held: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_held[0]) <= n:
        for k, base in enumerate((_BASE, _INVERSE)):
            power = np.full(n + 1, base, np.uint64)
            power[0] = 1
            _held[k] = np.multiply.accumulate(power)
    return _held[0][: n + 1], _held[1][: n + 1]


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each run, from prefix sums; the same for equal bytes anywhere."""
    if not len(starts):
        return np.empty(0, np.uint64)
    out = np.empty(len(starts), np.uint64)
    step = 1 << 20  # bytes at a time, cut between runs
    up, down = _powers(step)
    at = 0
    while at < len(starts):
        lo = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, lo + step, "right")))
        part = data[lo : ends[to - 1]]
        if len(part) > step:
            up, down = _powers(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
        s, e = starts[at:to] - lo, ends[at:to] - lo
        h = (sums[e] - sums[s]) * down[s]
        h += (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        out[at:to] = h ^ (h >> np.uint64(29))
        at = to
    return out


def _edges(change: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    mark = np.zeros(n + 1, bool)
    mark[1:n] = change
    mark[offsets] = True
    return np.nonzero(mark)[0]


def sign_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, kind) of maximal runs of word characters (1) and of other signs (2), cut at text borders."""
    kind = _KIND[data]
    cuts = _edges(kind[1:] != kind[:-1], offsets, len(data))
    starts, ends = cuts[:-1], cuts[1:]
    k = kind[starts] if len(starts) else np.empty(0, np.uint8)
    keep = k > 0
    return starts[keep], ends[keep], k[keep]


def space_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of maximal runs of characters that aren't white space, cut at text borders."""
    space = _SPACE[data]
    cuts = _edges(space[1:] != space[:-1], offsets, len(data))
    starts, ends = cuts[:-1], cuts[1:]
    keep = ~space[starts] if len(starts) else np.empty(0, bool)
    return starts[keep], ends[keep]


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, other bytes as they are."""
    return _LOWER[data]


def batches_of(column: pa.Array, most: int = 4 << 20):
    """Slices of a column with at most ``most`` bytes each (one longer text alone): bounds the arrays that they need."""
    lengths = np.concatenate(([0], np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0)))))
    at, n = 0, len(column)
    while at < n:
        to = max(at + 1, int(np.searchsorted(lengths, lengths[at] + most, "right")) - 1)
        yield at, column.slice(at, to - at)
        at = to
