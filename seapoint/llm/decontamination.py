"""Benchmark decontamination by winnowing.

A window is ``SPAN`` consecutive words of an item (an item of fewer words is one window). Of the
``KGRAM``-word hashes inside each window the smallest is kept: two equal windows keep the same one,
so a shared span of ``SPAN`` words always shares a fingerprint. Fingerprints of documents and items
are joined, and the hit is extended to the whole window by its 128-bit hash.

Documents are read once. What a task emits is screened by a bit table of the benchmark's
fingerprints with a fixed size (``SCREEN_BITS``): it can let strangers through, never keep a hit
back, and the join decides.

Defined cases: a null or empty text has no words; rows are judged one by one, so a repeated
``doc_id`` gives a row each time; an item with a null id marks words but is not listed; copies of
an item count once per ``item_id``; other columns of the inputs are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seapoint.llm.marks import without
from seapoint.llm.staging import scratch, staged
from seapoint.llm.words import Words, signed, slices

SPAN = 10
KGRAM = 6
SCREEN_BITS = 1 << 22
# Of text at a time in a Python worker, which takes many times as much for its words and hashes.
SLICE_BYTES = 1 << 20

# Bytes that are no part of a word become a blank; A-Z becomes a-z.
_FOLD = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)
_WINDOWS = "array<struct<start:int,len:int,print:bigint,h1:bigint,h2:bigint>>"


def folded_words(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def _fingerprints(words: Words, span: int, kgram: int) -> np.ndarray:
    """The smallest ``kgram`` hash of every window of ``span`` words."""
    grams = words.windows(kgram)
    starts = len(words.values) - span + 1
    if starts <= 0:
        return np.empty(0, np.uint64)
    least = grams[:starts].copy()
    for shift in range(1, span - kgram + 1):
        np.minimum(least, grams[shift : shift + starts], out=least)
    return least


def _spans(words: Words, length: int, span: int, kgram: int):
    """Owner, start, fingerprint and two hashes of all windows of ``length`` words."""
    prints = _fingerprints(words, length, kgram) if length == span else words.windows(length)
    owner = words.inside(length)
    keep = np.flatnonzero(owner >= 0)
    return owner[keep], keep, prints[keep], words.windows(length)[keep], words.windows(length, True)[keep]


def _row_lists(n: int, found: list[tuple], starts: np.ndarray) -> pa.Array:
    """One list of windows per row from the found (length, owner, at, print, h1, h2)."""
    if found:
        owner, at, length, prints, h1, h2 = (
            np.concatenate(x)
            for x in zip(*[(o, a, np.full(len(o), n_, np.int32), p, x, y) for n_, o, a, p, x, y in found])
        )
    else:
        owner = at = length = prints = h1 = h2 = np.empty(0, np.uint64)
    order = np.argsort(owner, kind="stable")
    owner, at = owner[order].astype(np.int64), at[order].astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
    values = pa.StructArray.from_arrays(
        [
            pa.array((at - starts[owner]).astype(np.int32)),
            pa.array(length[order].astype(np.int32)),
            pa.array(signed(prints[order])),
            pa.array(signed(h1[order])),
            pa.array(signed(h2[order])),
        ],
        names=["start", "len", "print", "h1", "h2"],
    )
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _item_windows(items: DataFrame, span: int, kgram: int) -> DataFrame:
    """``item_id`` and all windows of each item."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, budget=SLICE_BYTES):
            words = Words([folded_words(t) for t in texts])
            found = [(span, *_spans(words, span, span, kgram))]
            for length in {int(n) for n in words.lengths if 0 < n < span}:
                owner, at, *hashes = _spans(words, length, span, kgram)
                whole = words.lengths[owner] == length
                found.append((length, owner[whole], at[whole], *[h[whole] for h in hashes]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), _row_lists(len(texts), found, words.starts)], names=["item_id", "windows"]
            )

    item_type = items.schema["item_id"].dataType.simpleString()
    return (
        items.select("item_id", F.col("text").cast("string").alias("text"))
        .mapInArrow(read, f"item_id {item_type}, windows {_WINDOWS}")
        .select("item_id", F.inline("windows"))
    )


def _screen(windows: DataFrame, bits: int) -> tuple[np.ndarray, list[int]]:
    """The bit table of all fingerprints (at most ``bits / 64`` rows) and the window lengths there are."""
    slot = F.col("print").bitwiseAND(bits - 1)
    rows = (
        windows.groupBy(F.shiftright(slot, 6).alias("slot"))
        .agg(F.bit_or(F.expr("shiftleft(1L, CAST(print & 63 AS INT))")).alias("mask"))
        .toPandas()
    )
    table = np.zeros(bits // 64, np.int64)
    table[rows["slot"].to_numpy(np.int64)] = rows["mask"].to_numpy(np.int64)
    lengths = [r.len for r in windows.select("len").distinct().collect()]
    return table.view(np.uint64), lengths


def benchmark_hits(
    documents: DataFrame,
    benchmark: DataFrame,
    span: int = SPAN,
    kgram: int = KGRAM,
    screen_bits: int = SCREEN_BITS,
) -> DataFrame:
    """Per document row: ``doc_id, n_words, n_hit, items`` (ids as sorted strings) and ``spans``.

    ``spans`` are the (start, end) word ranges of all hit windows, by start.
    """
    if span < kgram:
        raise ValueError("a span holds at least one k-gram")
    items = staged(_item_windows(benchmark, span, kgram), "items")
    known = staged(
        items.groupBy("print", "h1", "h2", "len").agg(
            F.collect_set(F.col("item_id").cast("string")).alias("items")
        ),
        "windows",
    )
    table, lengths = _screen(known, screen_bits)
    shared = documents.sparkSession.sparkContext.broadcast(table)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch, texts in slices(batches, budget=SLICE_BYTES):
            words = Words([folded_words(t) for t in texts])
            found = []
            for length in lengths:
                prints = _fingerprints(words, span, kgram) if length == span else words.windows(length)
                slot = prints & np.uint64(screen_bits - 1)
                maybe = (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1)
                keep = np.flatnonzero(maybe)
                owner = words.inside(length)[keep]
                keep, owner = keep[owner >= 0], owner[owner >= 0]
                if len(keep):
                    found.append(
                        (length, owner, keep, prints[keep], words.windows(length)[keep], words.windows(length, True)[keep])
                    )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(words.lengths, pa.int64()),
                    _row_lists(len(texts), found, words.starts),
                ],
                names=["doc_id", "n_words", "windows"],
            )

    id_type = documents.schema["doc_id"].dataType.simpleString()
    scanned = staged(
        documents.select("doc_id", F.col("text").cast("string").alias("text"))
        .mapInArrow(scan, f"doc_id {id_type}, n_words bigint, windows {_WINDOWS}")
        .withColumn("row", F.monotonically_increasing_id()),
        "scanned",
    )
    hits = (
        scanned.select("row", F.inline("windows"))
        .join(known, ["print", "h1", "h2", "len"])
        .groupBy("row")
        .agg(
            F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("len")).alias("end")))).alias("spans"),
            F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda done, s: F.struct(
            (done["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(done["to"], s["start"]))).alias("n"),
            F.greatest(done["to"], s["end"]).alias("to"),
        ),
    )["n"]
    empty_items, empty_spans = F.array().cast("array<string>"), F.array().cast("array<struct<start:int,end:int>>")
    return (
        scanned.drop("windows")
        .join(hits.withColumn("n_hit", covered.cast("long")), "row", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.coalesce("items", empty_items).alias("items"),
            F.coalesce("spans", empty_spans).alias("spans"),
        )
    )


def without_contaminated(documents: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """``documents`` without the rows whose text holds a benchmark window; columns unchanged.

    Rows are judged by their texts, told apart by SHA-256: one with a null ``doc_id`` goes too, a clean one that shares its id with
    a contaminated one stays.
    """
    text = documents["text"].cast("string")
    with scratch(documents.sparkSession) as kept:
        hits = benchmark_hits(documents.select(F.sha2(text, 256).alias("doc_id"), documents["text"]), benchmark, **how)
        dirty = kept(hits.filter("n_hit > 0").select(F.col("doc_id").alias("digest")).distinct(), "dirty")
    digest = F.sha2(text, 256)
    return without(documents, F.xxhash64(digest), digest == dirty["digest"], dirty, F.xxhash64(dirty["digest"]))
