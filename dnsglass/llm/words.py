"""Words of Arrow text columns as numpy arrays: bounds, and hashes of word sequences."""

from __future__ import annotations

import numpy as np

from .arrow import U64, _pows, mix

#: Bytes that are white space: \t..\r and the space.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_bounds(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the words of the rows data[offsets[i]:offsets[i+1]]: runs of
    bytes that are not `blank`."""
    word = np.zeros(len(data) + 2, np.int8)
    word[1:-1] = ~blank[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero((word[1:] == 1) & ((word[:-1] == 0) | edge))
    ends = np.flatnonzero((word[:-1] == 1) & ((word[1:] == 0) | edge))
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


class SequenceHash:
    """64-bit hashes of any stretches of an array of 64-bit values, by prefix sums."""

    def __init__(self, values: np.ndarray):
        pw, self.inv = _pows(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, U64)
        np.cumsum(values * pw[:len(values)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, length: int) -> np.ndarray:
        return mix((self.sums[start + length] - self.sums[start]) * self.inv[start] + U64(length) * U64(0x632BE59BD9B4E019))
