"""Compressed bitmaps over integer codes, in numpy.

Codes are split at 2^16. Each block keeps either its sorted codes (up to 4,096 of them) or 8 KiB of bits, whichever is
smaller; absent blocks take no room.
"""

from __future__ import annotations

import numpy as np

_BLOCK, _SPARSE = 1 << 16, 4096


class Bitmap:
    """A set of non-negative integer codes."""

    __slots__ = ("blocks",)

    def __init__(self, blocks: dict[int, np.ndarray] | None = None):
        self.blocks = blocks or {}

    @classmethod
    def of(cls, codes: np.ndarray) -> Bitmap:
        """Of codes in any order, repeated or not."""
        codes = np.unique(np.asarray(codes, dtype=np.int64))
        high = codes >> 16
        cuts = np.flatnonzero(np.diff(high)) + 1
        return cls({int(part[0] >> 16): _pack((part & (_BLOCK - 1)).astype(np.uint16)) for part in np.split(codes, cuts) if part.size})

    def and_not(self, other: Bitmap) -> Bitmap:
        """The codes of this set that the other lacks."""
        out = {}
        for k, mine in self.blocks.items():
            theirs = other.blocks.get(k)
            if theirs is None:
                out[k] = mine
                continue
            if mine.dtype == np.uint16 and theirs.dtype == np.uint16:
                left = np.setdiff1d(mine, theirs, assume_unique=True)
            elif mine.dtype == np.uint16:
                left = mine[((theirs[mine >> 3] >> (7 - (mine & 7)).astype(np.uint8)) & 1) == 0]
            else:
                left = _unpack(mine & ~(theirs if theirs.dtype == np.uint8 else _bits(theirs)))
            if left.size:
                out[k] = _pack(left)
        return Bitmap(out)

    def codes(self) -> np.ndarray:
        """The codes in order."""
        parts = [(_unpack(b) if b.dtype == np.uint8 else b).astype(np.int64) + (k << 16) for k, b in sorted(self.blocks.items())]
        return np.concatenate(parts) if parts else np.empty(0, np.int64)

    def __len__(self) -> int:
        return sum(int(np.unpackbits(b).sum()) if b.dtype == np.uint8 else b.size for b in self.blocks.values())

    @property
    def nbytes(self) -> int:
        return sum(b.nbytes for b in self.blocks.values())


def _bits(low: np.ndarray) -> np.ndarray:
    flags = np.zeros(_BLOCK, bool)
    flags[low] = True
    return np.packbits(flags)


def _pack(low: np.ndarray) -> np.ndarray:
    return low if low.size <= _SPARSE else _bits(low)


def _unpack(bits: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bits)).astype(np.uint16)
