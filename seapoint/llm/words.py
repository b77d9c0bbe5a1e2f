"""Words of many texts at once, as arrays of 64-bit hashes, for the Arrow tasks of this package.

Every function takes the texts of one slice of a batch; the words of its texts stand one after
another in one array, so that the arithmetic is done once per slice and not once per text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 4 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)
_hash = xxhash.xxh3_64_intdigest


def as_bytes(column: pa.Array) -> pa.Array:
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    return column.cast(pa.large_binary() if large else pa.binary())


def slices(
    batches: Iterator[pa.RecordBatch], text: str = "text", budget: int = SLICE_BYTES
) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Row slices of about ``budget`` bytes of text (one row at least) with their UTF-8 texts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = as_bytes(batch.column(batch.schema.get_field_index(text)))
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + budget, side="right")))
            yield batch.slice(start, end - start), column.slice(start, end - start).to_pylist()
            start = end


def plain_words(text: bytes | None) -> list[bytes]:
    """Runs of anything but ASCII white space (the six bytes at which ``bytes.split`` cuts)."""
    return text.split() if text else []


class Words:
    """Hashes of the words of several texts: ``values``, with text ``i`` at ``starts[i]:starts[i + 1]``."""

    def __init__(self, lists: list[list[bytes]]):
        self.lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int64)
        total = int(self.starts[-1])
        self.values = np.fromiter(map(_hash, chain.from_iterable(lists)), np.uint64, total)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.lengths)), self.lengths)

    def inside(self, width: int) -> np.ndarray:
        """For each window start, the text it lies in whole, or -1."""
        owner = self.owner
        if len(owner) < width:
            return np.empty(0, np.int64)
        first, last = owner[: len(owner) - width + 1], owner[width - 1 :]
        return np.where(first == last, first, -1)

    def windows(self, width: int, second: bool = False) -> np.ndarray:
        """A hash of every ``width`` consecutive words; ``second`` gives an independent one."""
        return rolling(mixed(self.values) if second else self.values, width, _SECOND if second else _BASE)


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = values ^ (values >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers_of(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(int(base))
    if have is None or len(have[0]) < n:
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        size = max(n, 1 << 16)
        have = tuple(np.cumprod(np.full(size, b, np.uint64)) for b in (base, inverse))
        if n <= 1 << 21:
            _powers[int(base)] = have
    return have[0][:n], have[1][:n]


def rolling(values: np.ndarray, width: int, base: np.uint64 = _BASE) -> np.ndarray:
    """Polynomial hashes modulo 2^64 of all windows of ``width`` values, from prefix sums."""
    n = len(values)
    if n < width:
        return np.empty(0, np.uint64)
    up, down = _powers_of(base, n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up, dtype=np.uint64)])
    return mixed((sums[width:] - sums[:-width]) * down[: n - width + 1])


def signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values, dtype=np.uint64).view(np.int64)
