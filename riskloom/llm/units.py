"""Texts as runs of repeating units, for work that depends on a unit alone.

A unit is a run of spaces and the word after it. Where no token of a tokenizer
can span the border between two units, everything that follows from the tokens
of a unit is worked out once per distinct unit of a block and gathered by
index for whole texts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

SPACE = 0x20


def after_other_than_space(data: np.ndarray) -> np.ndarray:
    """Places of a space that follows neither a space nor U+2581, which stands for one."""
    cut = data == SPACE
    cut[1:] &= data[:-1] != SPACE
    cut[3:] &= ~((data[:-3] == 0xE2) & (data[1:-2] == 0x96) & (data[2:-1] == 0x81))
    return cut


#: Leads of the two- and three-byte UTF-8 blocks that hold Unicode's white space beyond ASCII (fixed values).
WIDE_SPACE_2 = 0xC2
WIDE_SPACE_3 = ((0xE1, 0x9A), (0xE2, 0x80), (0xE2, 0x81), (0xE3, 0x80))


def after_solid(data: np.ndarray) -> np.ndarray:
    """Places of a space that follows no white space of any kind (nor a character of the same small code block)."""
    cut = after_other_than_space(data)
    cut[1:] &= data[:-1] > SPACE
    cut[2:] &= data[:-2] != WIDE_SPACE_2
    for a, b in WIDE_SPACE_3:
        cut[3:] &= ~((data[:-3] == a) & (data[1:-2] == b))
    return cut


class Units:
    """The distinct units of a block, and each text as a run of indices into them.

    A space is put before every text that is not empty; an empty text has no units.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, cuts: Callable[[np.ndarray], np.ndarray]) -> None:
        filled = np.diff(offsets) > 0
        spaced = np.insert(data, offsets[:-1][filled], SPACE)
        begin = offsets + np.concatenate([[0], np.cumsum(filled)])
        cut = cuts(spaced)
        cut[begin[:-1][filled]] = True
        at = np.append(np.flatnonzero(cut), len(spaced)).astype(np.int64)
        every = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(spaced))])
        coded = every.dictionary_encode()
        self.distinct: pa.Array = coded.dictionary
        self.index: np.ndarray = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.first: np.ndarray = np.searchsorted(at[:-1], begin)

    def texts(self) -> int:
        return len(self.first) - 1

    def sums(self, per_unit: np.ndarray) -> np.ndarray:
        """Per text, the sum of an integer of its units."""
        total = np.concatenate([[0], np.cumsum(per_unit[self.index])])
        return total[self.first[1:]] - total[self.first[:-1]]

    def gather(self, per_unit: pa.Array) -> pa.LargeListArray:
        """Per text, the list of its units' values."""
        return pa.LargeListArray.from_arrays(pa.array(self.first, pa.int64()), per_unit.take(pa.array(self.index)))
