"""Substring dedup with difference-cover anchors.

A window is ``WINDOW`` consecutive words. Anchors are hashes of ``ANCHOR`` words at the positions of a text that lie in
``COVER`` modulo ``PERIOD``. In a difference cover every difference occurs, so two equal windows, wherever they
start, have an offset below ``PERIOD`` at which both texts hold an anchor; as ``PERIOD + ANCHOR - 1 <= WINDOW`` it lies
inside the windows and is the same in both. Only windows around anchors that another document shares can repeat:
they are hashed whole, and the least ``doc_id`` of each hash tells which of them begin in an earlier document.

Anchors and windows are counted before the shuffle, and what is shared is joined back from a written table, so
that a passage which a third of all documents hold is joined in parts. No pairs are formed. Exact copies of
a text are left out of the comparison (their earliest copy speaks for them): a later one loses every window.

Defined cases: a null or empty text has no words; a row with a null ``doc_id`` loses nothing and takes nothing from others;
rows that repeat a ``doc_id`` are no earlier document for each other; other columns are not looked at.
Windows are told apart by 64-bit hashes: among ``n`` different shared windows about ``n^2 / 2^65`` are taken for equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seapoint.llm.staging import staged
from seapoint.llm.words import Words, plain_words, signed, slices

WINDOW = 50
# A perfect difference set, every residue modulo 31 but 0 is one of its differences once.
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)
ANCHOR = WINDOW - PERIOD + 1
_IN_COVER = np.isin(np.arange(PERIOD), COVER)


def _anchors(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, place and hash of the anchors of texts that have a window at all."""
    owner = words.inside(ANCHOR)
    place = np.arange(len(owner)) - words.starts[np.maximum(owner, 0)]
    keep = np.flatnonzero((owner >= 0) & _IN_COVER[place % PERIOD] & (words.lengths[np.maximum(owner, 0)] >= WINDOW))
    return owner[keep], place[keep], words.windows(ANCHOR)[keep]


def _keyed(documents: DataFrame) -> DataFrame:
    """``key`` stands for a row's id and text, so equal rows share it."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("key", F.xxhash64("doc_id", "text"))


def _emit_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``anchor, key``, once per text."""
    for batch, texts in slices(batches):
        owner, _, hashes = _anchors(Words([plain_words(t) for t in texts]))
        order = np.lexsort((hashes, owner))
        owner, hashes = owner[order], hashes[order]
        first = np.ones(len(owner), bool)
        first[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays(
            [pa.array(signed(hashes[first])), pa.array(keys[owner[first]], pa.int64())], names=["anchor", "key"]
        )


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text in compressed form, as it goes through a shuffle."""
    packer = zstandard.ZstdCompressor(level=1)
    for batch, texts in slices(batches):
        packed = pa.array([packer.compress(t or b"") for t in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], names=["key", "doc_id", "packed"])


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _unpacked(column: pa.Array) -> list[bytes]:
    unpack = zstandard.ZstdDecompressor()
    return [unpack.decompress(x) for x in column.to_pylist()]


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row: its words' count and digest, and start and hash of the windows around shared anchors."""
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            packed = batch.column(2)
            lists = [plain_words(t) for t in _unpacked(packed)]
            words = Words(lists)
            shared = batch.column(3)
            sizes = np.array([len(x) if x.is_valid else 0 for x in shared], np.int64)
            known = shared.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            owner, place, hashes = _anchors(words)
            # An anchor counts for its own row: compare (row, hash) pairs.
            mine = np.zeros(len(owner), bool)
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            cuts = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            for i in np.flatnonzero(sizes):
                part = slice(cuts[i], cuts[i + 1])
                mine[part] = np.isin(signed(hashes[part]), known[bounds[i] : bounds[i + 1]])
            owner, place = owner[mine], place[mine]
            edge = np.zeros(len(words.values) + 1, np.int64)
            base = words.starts[owner]
            np.add.at(edge, base + np.maximum(place - PERIOD + 1, 0), 1)
            np.add.at(edge, base + place + 1, -1)
            starts = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
            inside = words.inside(WINDOW)
            starts = starts[starts < len(inside)]
            starts = starts[inside[starts] >= 0]
            rows = inside[starts]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=batch.num_rows))]).astype(np.int32)
            hashes = signed(words.windows(WINDOW)[starts]) if len(starts) else np.empty(0, np.int64)
            kept = [x if offsets[i + 1] > offsets[i] else None for i, x in enumerate(packed.to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(words.lengths, pa.int64()),
                    pa.array([_digest(x) for x in lists], pa.string()),
                    batch.column(4),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array((starts - words.starts[rows]).astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes)),
                    pa.array(kept, pa.binary()),
                ],
                names=["key", "doc_id", "n_words", "sha", "copy", "starts", "hashes", "packed"],
            )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, n_removed, sha`` of the rows that lose the windows at ``starts``."""
    for batch in batches:
        removed, shas = [], []
        for text, starts in zip(_unpacked(batch.column(1)), batch.column(2), strict=True):
            words = plain_words(text)
            edge = np.zeros(len(words) + 1, np.int64)
            at = np.unique(starts.values.to_numpy(zero_copy_only=False))
            edge[at] += 1
            edge[at + WINDOW] -= 1
            gone = np.cumsum(edge[:-1]) > 0
            removed.append(int(gone.sum()))
            shas.append(_digest([w for w, g in zip(words, gone, strict=True) if not g]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(removed, pa.int64()), pa.array(shas, pa.string())], names=["key", "n_removed", "cut_sha"]
        )


def remove_repeats(documents: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row."""
    rows = _keyed(documents)
    compared = rows.filter("doc_id IS NOT NULL")
    anchors = compared.select("key", "text").mapInArrow(_emit_anchors, "anchor long, key long")
    shared = staged(anchors.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "anchors")
    around = anchors.join(shared, "anchor").groupBy("key").agg(F.collect_set("anchor").alias("anchors"))
    firsts = compared.groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    copies = (
        compared.select("key", "doc_id", F.sha2("text", 256).alias("sha"))
        .join(staged(firsts, "texts"), "sha")
        .filter("doc_id > first")
        .select("key")
        .distinct()
        .withColumn("copy", F.lit(True))
    )
    info = staged(around.join(copies, "key", "full_outer").withColumn("anchors", F.when(F.col("copy").isNull(), F.col("anchors"))), "around")
    packed = rows.select("key", "doc_id", "text").mapInArrow(_pack, "key long, doc_id long, packed binary")
    judged = staged(
        packed.join(info, "key", "left")
        .select("key", "doc_id", "packed", "anchors", "copy")
        .mapInArrow(
            _candidates,
            "key long, doc_id long, n_words long, sha string, copy boolean, starts array<int>, hashes array<long>, packed binary",
        ),
        "windows",
    )
    windows = judged.select("key", "doc_id", F.explode(F.arrays_zip("starts", "hashes")).alias("w")).select(
        "key", "doc_id", F.col("w.starts").alias("start"), F.col("w.hashes").alias("hash")
    )
    earliest = staged(
        windows.groupBy("hash")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        .filter("first < last")
        .select("hash", "first"),
        "earliest",
    )
    repeats = staged(
        windows.join(earliest, "hash").filter("first < doc_id").groupBy("key").agg(F.collect_set("start").alias("starts")), "repeats"
    )
    cut = staged(
        judged.filter("packed IS NOT NULL")
        .select("key", "packed")
        .dropDuplicates(["key"])
        .join(repeats, "key")
        .select("key", "packed", "starts")
        .mapInArrow(_cut, "key long, n_removed long, cut_sha string"),
        "cut",
    )
    all_gone = F.col("copy").isNotNull() & (F.col("n_words") >= WINDOW)
    return (
        judged.select("key", "doc_id", "n_words", "sha", "copy")
        .join(cut, "key", "left")
        .select(
            "doc_id",
            "n_words",
            F.when(all_gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
            F.when(all_gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
        )
    )
