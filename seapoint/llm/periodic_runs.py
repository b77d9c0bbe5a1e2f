"""Runs: maximal stretches of words with a period, found by minimizers at several scales.

The words of a slice of texts stand in one array, with a value of its own between two texts, so no run crosses them.

- *Short periods*, under ``2 * SCALE``, by direct scans: one comparison of the array with itself for each lag.
- *Scales* ``w = SCALE, 2 SCALE, ...`` have the periods from ``2w`` to ``4w``. The minimizer of each window of ``w`` words is its
  least word hash, the leftmost of equals, so windows of equal content have it at the same place, and inside a run it comes again one
  period later with the same ``w`` words after it. Equal contexts so far apart seed an extension to both sides, by a binary
  search over prefix hashes. Only texts of ``4w`` words and more take part.
- *Periodic contexts*, of a period up to ``w / 2``, come again at every step and are not paired with each other. They lie in runs that
  smaller scales have found. Two contexts of one run lead to that run only; two of different runs of the same period
  can seed a longer period only with starts or ends of these runs aligned, or where one run goes over into the other.
  These lags are seeds instead. So a context has at most some eight partners, and no text makes the work square.

Of the periods of one stretch the smallest one stays. Texts may be of any length; every text is read whole.

Defined cases: a null or empty text has no words and no runs; a null ``doc_id`` changes no words; rows that repeat a
``doc_id`` are judged one by one; other columns are not looked at. Words are told apart by 64-bit hashes, and stretches by two hashes
of 31 bits each.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seapoint.llm.words import Words, mixed, plain_words, slices

LEAST_LENGTH = 12
SCALE = 16
_PRIMES = (2147483629, 2147483587)
_BASES = (1303515621, 1674302873)


class _Prefix:
    """Hashes of all stretches of an array, from prefix sums modulo two primes."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self._sums, self._powers = [], []
        for prime, base in zip(_PRIMES, _BASES, strict=True):
            p = np.uint64(prime)
            powers = np.ones(self.n + 1, np.uint64)
            done = 1
            while done <= self.n:
                more = min(done, self.n + 1 - done)
                step = np.uint64(pow(base, done, prime))
                powers[done : done + more] = powers[:more] * step % p
                done += more
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(values % p * powers[:-1] % p, out=sums[1:])
            self._sums.append(sums % p)
            self._powers.append(powers)

    def keys(self, at: np.ndarray, width: int) -> np.ndarray:
        """A hash of ``width`` values from each place ``at``, wherever it is."""
        out = np.zeros(len(at), np.uint64)
        for prime, sums, powers in zip(_PRIMES, self._sums, self._powers, strict=True):
            p = np.uint64(prime)
            part = (sums[at + width] + p - sums[at]) % p * powers[self.n - at] % p
            out = out << np.uint64(31) | part
        return out

    def same(self, a: np.ndarray, b: np.ndarray, width: np.ndarray) -> np.ndarray:
        """Are the ``width`` values from ``a`` and from ``b`` equal? ``a <= b``."""
        equal = np.ones(len(a), bool)
        for prime, sums, powers in zip(_PRIMES, self._sums, self._powers, strict=True):
            p = np.uint64(prime)
            left = (sums[a + width] + p - sums[a]) % p * powers[b - a] % p
            equal &= left == (sums[b + width] + p - sums[b]) % p
        return equal

    def extend(self, at: np.ndarray, lag: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """The widest ``[l, r)`` around ``at`` where each value equals the one ``lag`` further on; empty if it differs at ``at``."""
        right, left = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        step = 1 << max(reach, 1).bit_length()
        while step:
            fits = at + lag + right + step <= self.n
            start = at + right
            fits[fits] = self.same(start[fits], (start + lag)[fits], np.full(int(fits.sum()), step))
            right[fits] += step
            fits = at - left - step >= 0
            start = at - left - step
            fits[fits] = self.same(start[fits], (start + lag)[fits], np.full(int(fits.sum()), step))
            left[fits] += step
            step >>= 1
        return np.where(right > 0, at - left, at), at + right


def _stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of True."""
    edges = np.flatnonzero(np.diff(equal.view(np.int8), prepend=0, append=0))
    return edges[::2], edges[1::2]


def _distinct(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row per stretch, with its smallest period, by start and end."""
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return start[new], end[new], period[new]


def _near(keys: np.ndarray, at: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and distance of the pairs of equal keys with ``low <= distance < high``; ``keys`` sorted, with ``at`` rising in each."""
    places, lags = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    first, k = np.arange(len(at)), 1
    while len(first := first[first + k < len(at)]):
        lag = at[first + k] - at[first]
        first = first[close] if not (close := (keys[first + k] == keys[first]) & (lag < high)).all() else first
        lag = at[first + k] - at[first]
        places.append(at[first][lag >= low])
        lags.append(lag[lag >= low])
        k += 1
    return np.concatenate(places), np.concatenate(lags)


def _seeds_of_runs(start, end, period, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and lag of what runs of equal period may have in common with their next ones."""
    order = np.lexsort((start, period))
    start, end, period = start[order], end[order], period[order]
    # Starts aligned, ends aligned (the last value of both).
    by_start = _near(period, start, low, high)
    by_end = _near(period, end - 1, low, high)
    places, lags = [by_start[0], by_end[0]], [by_start[1], by_end[1]]
    for i in np.flatnonzero((period[1:] == period[:-1]) & (start[1:] <= end[:-1])):
        # One goes over into the next: any lag that both reach.
        lag = np.arange(low, min(high, end[i] - start[i] + 1, end[i + 1] - start[i + 1] + 1))
        places.append(end[i] - lag)
        lags.append(lag)
    return np.concatenate(places), np.concatenate(lags)


def runs_of(values: np.ndarray, longest: int, least: int = LEAST_LENGTH, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of all runs of an array whose parts have at most ``longest`` values.

    ``least`` is at most ``scale``. Parts are parted by values that come once.
    """
    found = [np.empty((0, 3), np.int64)]
    for lag in range(1, min(2 * scale, len(values))):
        start, end = _stretches(values[:-lag] == values[lag:])
        enough = end - start >= max(lag, least - lag)
        found.append(np.stack([start[enough], end[enough] + lag, np.full(int(enough.sum()), lag)], axis=1))
    runs = _distinct(*np.concatenate(found).T)
    if longest < 4 * scale:
        return runs
    prefix = _Prefix(values)
    place = np.arange(len(values), dtype=np.uint64)
    minima = mixed(values) >> np.uint64(32) << np.uint64(32) | place
    width, w = 1, scale
    while 4 * w <= longest:
        while width < w:
            minima, width = np.minimum(minima[:-width], minima[width:]), 2 * width
        at = np.unique(minima & np.uint64(0xFFFFFFFF)).astype(np.int64)
        at = at[at + w <= len(values)]
        start, end, period = (x[(runs[2] <= w // 2) & (runs[1] - runs[0] >= w)] for x in runs)
        if len(start):
            order = np.argsort(start, kind="stable")
            inside = np.searchsorted(start[order], at, side="right") - 1
            at = at[(inside < 0) | (at + w > end[order][inside])]
        keys = prefix.keys(at, w)
        order = np.argsort(keys, kind="stable")
        seeds = _near(keys[order], at[order], 2 * w, 4 * w)
        more = _seeds_of_runs(start, end, period, 2 * w, 4 * w)
        at, lag = (np.concatenate(x) for x in zip(seeds, more, strict=True))
        if len(at):
            left, right = prefix.extend(at, lag, longest)
            enough = right - left >= lag
            new = (left[enough], (right + lag)[enough], lag[enough])
            runs = _distinct(*(np.concatenate(x) for x in zip(runs, new, strict=True)))
        w *= 2
    return runs


def find_runs(lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start, length and period of all runs, by text, start and period."""
    words = Words(lists)
    n = len(lists)
    if not len(words.values):
        return tuple(np.empty(0, np.int64) for _ in range(4))
    found = []
    # Texts too short for scales in one array; of the others those of one order of size.
    groups = np.where(words.lengths >= 4 * SCALE, np.floor(np.log2(np.maximum(words.lengths, 1))).astype(np.int64), 0)
    for group in np.unique(groups[words.lengths >= LEAST_LENGTH]):
        texts = np.flatnonzero((groups == group) & (words.lengths >= LEAST_LENGTH))
        sizes = words.lengths[texts] + 1
        ends = np.cumsum(sizes)
        starts = ends - sizes
        values = np.zeros(int(ends[-1]), np.uint64)
        for i, at in zip(texts, starts):
            values[at : at + words.lengths[i]] = words.values[words.starts[i] : words.starts[i + 1]]
        # A word hash that equals one of these counters: as unlikely as two words of one hash.
        values[ends - 1] = np.arange(1, len(texts) + 1, dtype=np.uint64)
        start, end, period = runs_of(values, int(words.lengths[texts].max()))
        text = np.searchsorted(ends, start, side="right")
        found.append(np.stack([texts[text], start - starts[text], end - start, period]))
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    text, start, length, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, start, text))
    return text[order], start[order], length[order], period[order]


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document; of every tenth, by the checksum of its id, with a tail that repeats."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    block = words[a : a + p]
    return words[:a] + (block * ((n - a) // p + 1))[: n - a]


RUNS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _all_runs(prepare, give):
    """A task that hands ``give`` the words and the runs of each slice of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            lists = [prepare(doc, plain_words(t)) for doc, t in zip(batch.column(0).to_pylist(), texts, strict=True)]
            yield give(batch.column(0), lists, *find_runs(lists))

    return run


def _as_rows(ids: pa.Array, lists, text, start, length, period) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(text)), pa.array(start), pa.array(length), pa.array(period)], names=["doc_id", "start", "length", "period"]
    )


def _as_digests(ids: pa.Array, lists, text, start, length, period) -> pa.RecordBatch:
    bounds = np.searchsorted(text, np.arange(len(lists) + 1))
    columns = [[] for _ in range(7)]
    for i, words in enumerate(lists):
        low, high = bounds[i], bounds[i + 1]
        s, n, q = start[low:high], length[low:high], period[low:high]
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in zip(s.tolist(), n.tolist(), q.tolist()))
        best = (None,) * 4
        if len(s):
            k = np.lexsort((q, s, -n))[0]
            best = (int(s[k]), int(n[k]), int(q[k]), 1000 * int(n[k]) // int(q[k]))
            words = _collapsed(words, s, n, q)
        row = (len(s), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest())
        for column, value in zip(columns, row, strict=True):
            column.append(value)
    kinds = [pa.int64()] * 5 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays(
        [ids, *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
        names=[x.split()[0] for x in RUNS.split(", ")],
    )


def _collapsed(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> list[bytes]:
    """The words that no run holds after its first period."""
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, start + length, -1)
    return [w for w, d in zip(words, np.cumsum(depth[:-1]).tolist()) if not d]


def as_they_are(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    return words


def _rows(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def document_runs(documents: DataFrame, prepare=as_they_are) -> DataFrame:
    """``doc_id, start, length, period`` of every run. ``prepare`` gives the words to look at from a document's id and words."""
    task = _all_runs(prepare, _as_rows)
    return _rows(documents).mapInArrow(task, "doc_id long, start long, length long, period long")


def run_digests(documents: DataFrame, prepare=repeated_tail) -> DataFrame:
    """Per row: the number of runs, the longest one, and digests of all runs and of the words that stay without the repeats."""
    return _rows(documents).mapInArrow(_all_runs(prepare, _as_digests), RUNS)
