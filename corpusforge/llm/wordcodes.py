"""Words of texts as numbers and hashes, for the operators that compare word sequences in Arrow tasks."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash

#: An odd factor and two shifts that mix 64 bits.
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)


class WordCodes:
    """Numbers of the words that one task has seen, in order of appearance, and a 64-bit hash of each (never 0)."""

    def __init__(self, seed: int = 0) -> None:
        self.seed = seed
        self.number: defaultdict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.hashes = np.zeros(0, np.uint64)

    def encoded(self, words: Sequence[bytes]) -> tuple[np.ndarray, list[bytes]]:
        """The words' hashes, and the words that are new."""
        numbers = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        new = list(islice(reversed(self.number), len(self.number) - len(self.hashes)))[::-1]
        if new:
            digest, seed = xxhash.xxh64_intdigest, self.seed
            self.hashes = np.concatenate([self.hashes, np.fromiter((digest(w, seed) or 1 for w in new), np.uint64, len(new))])
        return self.hashes[numbers], new


def mixed(left: np.ndarray, right: np.ndarray | np.uint64) -> np.ndarray:
    """One hash of two; the order counts."""
    both = (left * _FACTOR) ^ right
    both ^= both >> _SHIFT
    both *= _FACTOR
    return both ^ (both >> _SHIFT)


def long_lists(values: np.ndarray, lengths: Sequence[int]) -> pa.Array:
    """A list<long> array of unsigned values, dealt by lengths."""
    ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))


def flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list<long> array without nulls, unsigned, and its lengths."""
    return lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.diff(lists.offsets.to_numpy())


def as_bytes(column: pa.Array) -> list[bytes]:
    """A text column as UTF-8 bytes; nulls are empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]
