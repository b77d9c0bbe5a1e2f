"""Language-model scores by stupid backoff, with n-gram counts over all other documents.

A word after its context scores the count of the n-gram over that of the context; where the n-gram does not
occur, ``ALPHA`` times the score with a context shorter by one word. Counts are those of the whole corpus less the document's
own, so a text doesn't vouch for itself. N-grams have up to ``ORDER`` words.

Documents are dealt to blocks of about ``BLOCK_BYTES`` by a hash. A block counts its own n-grams first and sends each
once, in ``buckets`` by the leading bits of its hash; a bucket adds up the blocks' counts (a very common n-gram
comes once per block, not once per occurrence) and answers each block with what the others have; the
block joins the answers to its n-grams and sums the scores of each document. Blocks and buckets grow in number with
the corpus and not in size.

Defined cases: a null or empty text has no words, the score 0 and no mean; each row is a document, so a repeated row counts as
another one; a word that no other document has scores ``ALPHA / (other words + 1)``; other columns are not looked at.
N-grams are told apart by 64-bit hashes, those of at most four words that all are among the ``CODED`` commonest of a bounded sample by these words' numbers: exactly,
and in fewer bits, so they are sent in fewer bytes. What the sample holds changes the bytes, not the scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seapoint.llm.words import Words, mixed, plain_words, signed, slices

ORDER = 3
ALPHA = 0.4
BLOCK_BYTES = 3 << 20
BUCKET_WORDS = 2_000_000
CODED = (1 << 16) - 1
SAMPLE_BYTES = 16 << 20
_SPREAD = np.uint64(0x9E3779B97F4A7C15)

SCORES = "doc_id long, n_words long, log_score double, mean_log double"


def _squeezed(values: np.ndarray) -> bytes:
    """An array as compressed bytes; equal bytes of neighbouring values stand together."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw).tobytes())


def _released(blob: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel()


def _steps(values: np.ndarray) -> np.ndarray:
    """Sorted values as differences."""
    return np.diff(values, prepend=np.uint64(0))


def _grams(words: Words, n: int, known: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Kind, position of the last word and key of every n-gram within a document: ``2 n`` with hashes, ``2 n + 1`` with the numbers of ``known`` words."""
    hashes = words.windows(n) if n > 1 else mixed(words.values)
    at = np.flatnonzero(words.inside(n) >= 0)
    if n > 4 or not len(known):
        return [(2 * n, at + n - 1, hashes[at])]
    place = np.minimum(np.searchsorted(known, words.values), len(known) - 1)
    number = np.where(known[place] == words.values, place + 1, 0).astype(np.uint64)
    whole, key = np.ones(len(at), bool), np.zeros(len(at), np.uint64)
    for i in range(n):
        whole &= number[at + i] > 0
        key = (key << np.uint64(16)) | number[at + i]
    # The numbers fill the leading bits; an odd factor spreads them over the buckets and keeps them apart.
    key = (key << np.uint64(64 - 16 * n)) * _SPREAD
    return [(2 * n, at[~whole] + n - 1, hashes[at[~whole]]), (2 * n + 1, at[whole] + n - 1, key[whole])]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, texts in slices(batches):
        values, counts = np.unique(Words([plain_words(t) for t in texts]).values, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(signed(values)), pa.array(counts)], names=["word", "n"])


def _commonest(rows: DataFrame, size: int) -> np.ndarray:
    """Sorted hashes of the ``CODED`` commonest words of about ``SAMPLE_BYTES`` of ``rows``, which have ``size`` bytes."""
    share = min(1.0, SAMPLE_BYTES / max(size, 1))
    sample = rows.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30))).select("text")
    counts = sample.mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = counts.filter("n > 1").orderBy(F.desc("n"), "word").limit(CODED).select("word").toPandas()["word"]
    return np.sort(words.to_numpy(np.int64).view(np.uint64))


def _pack(block_count: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch, texts in slices(batches):
            block = batch.column(0).to_numpy(zero_copy_only=False) % block_count
            packed = pa.array([packer.compress(t or b"") for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), batch.column(1), packed], names=["block", "doc_id", "packed"])

    return pack


def _block_words(rows: pa.Table) -> Words:
    unpack = zstandard.ZstdDecompressor()
    return Words([plain_words(unpack.decompress(x)) for x in rows.column("packed").to_pylist()])


def score_documents(documents: DataFrame, order: int = ORDER, alpha: float = ALPHA, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_words, log_score, mean_log`` of every row (natural logarithms)."""
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in slices(batches):
            size, words = sum(map(len, texts)), sum(len(plain_words(t)) for t in texts)
            yield pa.RecordBatch.from_arrays([pa.array([size]), pa.array([words])], names=["size", "words"])

    whole = rows.select("text").mapInArrow(sizes, "size long, words long").agg(F.sum("size").alias("size"), F.sum("words").alias("words")).first()
    total_words = int(whole["words"] or 0)
    block_count = max(1, -(-int(whole["size"] or 0) // block_bytes))
    bits = max(0, (order * total_words // BUCKET_WORDS).bit_length())
    shared = documents.sparkSession.sparkContext.broadcast(_commonest(rows, int(whole["size"] or 0)))
    # Equal rows share a block; what a block holds follows from the rows alone.
    keyed = rows.select(F.expr("pmod(xxhash64(doc_id, text), 9223372036854775807)").alias("key"), "doc_id", "text")
    blocks = keyed.mapInArrow(_pack(block_count), "block long, doc_id long, packed binary")

    def count(key: tuple, rows: pa.Table) -> pa.Table:
        words = _block_words(rows)
        out: dict[str, list] = {"bucket": [], "block": [], "kind": [], "grams": [], "counts": []}
        for kind, _, keys in (x for n in range(1, order + 1) for x in _grams(words, n, shared.value)):
            hashes, counts = np.unique(keys, return_counts=True)
            cuts = np.searchsorted(hashes, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(1, np.int64)
            for bucket, (lo, hi) in enumerate(zip(cuts, [*cuts[1:], len(hashes)], strict=True)):
                if hi > lo:
                    out["bucket"].append(bucket)
                    out["block"].append(key[0].as_py())
                    out["kind"].append(kind)
                    out["grams"].append(_squeezed(_steps(hashes[lo:hi])))
                    out["counts"].append(_squeezed(counts[lo:hi].astype(np.uint64)))
        return pa.table(out, schema=counted)

    counted = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("kind", pa.int64()), ("grams", pa.binary()), ("counts", pa.binary())])

    def add_up(key: tuple, rows: pa.Table) -> pa.Table:
        grams = [np.cumsum(_released(x, "<u8"), dtype=np.uint64) for x in rows.column("grams").to_pylist()]
        counts = [_released(x, "<u8") for x in rows.column("counts").to_pylist()]
        ends = np.cumsum([len(x) for x in grams])
        _, inverse = np.unique(np.concatenate(grams), return_inverse=True)
        own = np.concatenate(counts)
        total = np.zeros(int(inverse.max()) + 1, np.uint64)
        np.add.at(total, inverse, own)
        others = total[inverse] - own
        answers = [_squeezed(x) for x in np.split(others, ends[:-1])]
        return pa.table(
            {"block": rows.column("block"), "kind": rows.column("kind"), "bucket": rows.column("bucket"), "others": pa.array(answers, pa.binary())}
        )

    def score(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        words = _block_words(rows)
        size = len(words.values)
        owner = words.owner
        elsewhere = []  # per order, the count in other documents of the n-gram that ends at each position, -1 without one
        listed = sorted(zip(*[answers.column(c).to_pylist() for c in ("kind", "bucket", "others")], strict=True), key=lambda x: x[:2])
        for n in range(1, order + 1):
            value = np.full(size, -1, np.int64)
            for kind, at, keys in _grams(words, n, shared.value):
                if len(at):
                    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
                    others = np.concatenate([_released(blob, "<u8") for m, _, blob in listed if m == kind])
                    total = counts + others.astype(np.int64)
                    pair = inverse * np.int64(len(words.lengths)) + owner[at]
                    _, where, own = np.unique(pair, return_inverse=True, return_counts=True)
                    value[at] = total[inverse] - own[where]
            elsewhere.append(value)
        rest = (total_words - words.lengths[owner]).astype(np.float64)
        logs = np.full(size, np.nan)
        tries = np.zeros(size)
        for n in range(order, 0, -1):
            value = elsewhere[n - 1]
            if n > 1:
                context = np.empty(size, np.int64)
                context[:1] = 0
                context[1:] = elsewhere[n - 2][:-1]
            else:
                context = rest
            hit = np.isnan(logs) & (value > 0)
            logs[hit] = np.log(value[hit] / context[hit]) + tries[hit] * math.log(alpha)
            tries += value >= 0
        unseen = np.isnan(logs)
        logs[unseen] = tries[unseen] * math.log(alpha) - np.log(rest[unseen] + 1.0)
        sums = np.zeros(len(words.lengths))
        some = words.lengths > 0
        if size:
            sums[some] = np.add.reduceat(logs, words.starts[:-1][some])
        means = pa.array(sums / np.maximum(words.lengths, 1), mask=~some)
        return pa.table({"doc_id": rows.column("doc_id"), "n_words": pa.array(words.lengths), "log_score": pa.array(sums), "mean_log": means})

    counts = blocks.groupBy("block").applyInArrow(count, "bucket long, block long, kind long, grams binary, counts binary")
    answers = counts.groupBy("bucket", "kind").applyInArrow(add_up, "block long, kind long, bucket long, others binary")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, SCORES)
