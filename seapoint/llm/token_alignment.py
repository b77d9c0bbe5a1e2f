"""Two tokenizers' tokens of the same text, cut where both end, and how often each pair of tokens ends together.

A text goes to both tokenizers, and both give the same bytes: a space and the text. Groups are what lies between places
where tokens of both end; the last tokens of a group are linked, as their bytes end together.

- *First pass.* The texts are aligned, and each row's links written down, packed. Each task counts its linked pairs of ids. What the
  tasks send is one row per distinct pair and task.
- *Minimal perfect hashing.* The distinct pairs are dealt to buckets of about ``BUCKET_PAIRS``. In a bucket each pair gets a number
  below the number of its pairs, by levels of bit tables: a pair that is alone in its place of a level stays there, the others go on to the next, and
  its number is the rank of its bit. The pairs themselves are kept at these numbers, and every lookup is verified by them.
- *Dense counts.* Tasks' counts become vectors indexed by that number, and these are summed in a tree of ``FAN`` at a time.
- *Second pass.* The counts of the links written down are looked up; no text is read again. Up to ``MOST_SHARED`` distinct pairs, tables
  and counts go to all tasks (17 bytes a pair). Beyond that links travel to the tables, in parts per bucket and group of tasks, and
  sums come back. Both ways give the same rows.

Both tokenizers treat what lies between a space after something else than white space and the next such space by itself:
the byte-level pattern ends a match there, and no piece of the other one has a space other than at its front. So such chunks are
aligned once, when they are first met, and kept (up to ``MOST_CHUNKS``; that changes the work only).

Defined cases: a null or empty text, and one whose tokens of either kind spell other bytes than a space and the text, have no
tokens: zeros and an empty string, and they count for no pair. Rows that repeat a ``doc_id``, and null ids, are rows of their own and
all count; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import os
from collections import Counter
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seapoint.llm.bpe import chunks, in_process, shared_file, windows
from seapoint.llm.staging import scratch, staged
from seapoint.llm.words import mixed, signed, slices

BUCKET_PAIRS = 1 << 13
MOST_SHARED = 1 << 21
SLICE_LINKS = 1 << 19
MOST_CHUNKS = 1 << 19
LONG_CHUNK = 256
FAN = 16


def byte_level_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Aligner:
    """Chunks of text to their groups and links; the common and short ones are kept, with numbers of their own.

    ``bad`` has the numbers of chunks that a tokenizer spells otherwise.
    """

    def __init__(self, first: bytes, second: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tokenizers

        self._a = tokenizers.Tokenizer.from_buffer(first)
        self._a.encode_special_tokens = True
        self._b = sentencepiece.SentencePieceProcessor(model_proto=second)
        stands_for = byte_level_bytes()
        vocabulary = self._a.get_vocab(with_added_tokens=False)
        self._a_bytes = {i: bytes(stands_for[c] for c in token) for token, i in vocabulary.items()}
        self._b_bytes = []
        for i in range(self._b.get_piece_size()):
            piece = self._b.id_to_piece(i)
            if "▁" in piece.lstrip("▁"):
                raise ValueError(f"piece {i} has a space inside, so texts can't be cut at spaces")
            self._b_bytes.append(bytes([int(piece[1:-1], 16)]) if self._b.is_byte(i) else piece.replace("▁", " ").encode())
        ids_a = range(max(self._a_bytes) + 1)
        self._a_sizes = np.array([len(self._a_bytes.get(i, b"")) for i in ids_a])
        self._b_sizes = np.array([len(x) for x in self._b_bytes])
        # Each id as text with what may follow it in the text of groups.
        self._a_text = {end: np.array([f"{i}{end}" for i in ids_a], object) for end in ",|"}
        self._b_text = {end: np.array([f"{i}{end}" for i in range(len(self._b_bytes))], object) for end in ",;\n"}
        self._space = self._b.piece_to_id("▁")
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.bad: set[int] = set()
        self.groups: list[str] = []
        self._sizes, self._links = [np.zeros((3, 0), np.int64)], [np.zeros(0, np.uint64)]

    @property
    def sizes(self) -> np.ndarray:
        """Numbers of first and second tokens and of groups (so of links) of each chunk."""
        if len(self._sizes) > 1:
            self._sizes = [np.concatenate(self._sizes, axis=1)]
        return self._sizes[0]

    @property
    def links(self) -> np.ndarray:
        """The linked pairs of all chunks, one chunk after another; both ids in one number."""
        if len(self._links) > 1:
            self._links = [np.concatenate(self._links)]
        return self._links[0]

    def align(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """For each text: groups as text; numbers of tokens and groups; all linked pairs; and whether it has tokens."""
        whole = [(" " + t).encode() for t in texts]
        a = [x.ids for x in self._a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        # The second tokenizer puts its space before any text but an empty one.
        b = [x or [self._space] for x in self._b.encode(texts, num_threads=1)]
        good = np.ones(len(texts), bool)
        if b"".join(map(self._a_bytes.__getitem__, chain.from_iterable(a))) != (joined := b"".join(whole)) or b"".join(
            map(self._b_bytes.__getitem__, chain.from_iterable(b))
        ) != joined:
            for i, text in enumerate(whole):
                good[i] = b"".join(map(self._a_bytes.__getitem__, a[i])) == text == b"".join(map(self._b_bytes.__getitem__, b[i]))
                if not good[i]:
                    a[i], b[i] = [], []
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        # All texts behind one another: their ends are ends of both kinds of tokens.
        ids_a, ids_b = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((a, n_a), (b, n_b)))
        ends_a, ends_b = np.cumsum(self._a_sizes[ids_a]), np.cumsum(self._b_sizes[ids_b])
        cuts, in_a, in_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        last_b = np.cumsum(n_b)[good] - 1
        n_groups = np.zeros(len(texts), np.int64)
        n_groups[good] = np.diff(np.searchsorted(cuts, ends_b[last_b], side="right"), prepend=0)
        text_a, text_b = self._a_text[","][ids_a], self._b_text[","][ids_b]
        text_a[in_a], text_b[in_b] = self._a_text["|"][ids_a[in_a]], self._b_text[";"][ids_b[in_b]]
        text_b[last_b] = self._b_text["\n"][ids_b[last_b]]
        # First tokens of a group, then its second ones.
        place = np.concatenate([2 * np.searchsorted(in_a, np.arange(len(ids_a))), 2 * np.searchsorted(in_b, np.arange(len(ids_b))) + 1])
        lines = iter("".join(np.concatenate([text_a, text_b])[np.argsort(place, kind="stable")]).split("\n"))
        groups = [next(lines) if g else "" for g in good.tolist()]
        links = ids_a[in_a].astype(np.uint64) << np.uint64(32) | ids_b[in_b].astype(np.uint64)
        return groups, np.stack([n_a, n_b, n_groups]), links, good

    def _add(self, new: list[str]) -> None:
        groups, sizes, links, good = self.align(new)
        start = len(self.groups)
        self.number.update(zip(new, range(start, start + len(new))))
        self.bad.update((np.flatnonzero(~good) + start).tolist())
        self.groups += groups
        self._sizes.append(sizes)
        self._links.append(links)

    def numbers(self, texts: list[str]) -> list[list[int] | None]:
        """The numbers of each text's chunks; None if it has no tokens."""
        parted = []
        for text in texts:
            # A later window begins with the space that its first chunk has anyway.
            parts = (chunks(w[1:] if i else w) for i, w in enumerate(windows(text)))
            parted.append([c for part in parts for c in part])
        new = list({c for part in parted for c in part if c not in self.number})
        for at in range(0, len(new), 4096):
            self._add(new[at : at + 4096])
        out = [list(map(self.number.__getitem__, part)) for part in parted]
        for chunk in new:
            if len(chunk) > LONG_CHUNK:
                del self.number[chunk]
        return [x if x and self.bad.isdisjoint(x) else None for x in out]


# ---- minimal perfect hashing ---------------------------------------------------------------


def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mixed(keys ^ mixed(np.array([level + 1], np.uint64))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """A number below ``len(keys)`` for each of ``keys``, which are distinct."""

    def __init__(self, keys: np.ndarray):
        self.levels: list[np.ndarray] = []
        left = np.asarray(keys, np.uint64)
        while len(left):
            size = 2 * len(left)
            place = _places(left, len(self.levels), size)
            alone = np.bincount(place, minlength=size) == 1
            self.levels.append(alone)
            left = left[~alone[place]]
        self._ranks()

    def _ranks(self) -> None:
        self._rank, total = [], 0
        for bits in self.levels:
            before = np.cumsum(bits, dtype=np.int64) - bits + total
            self._rank.append(before)
            total += int(bits.sum())

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Their numbers; for a key that was not among them, any number or -1."""
        out = np.full(len(keys), -1, np.int64)
        open_rows = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            place = _places(keys[open_rows], level, len(bits))
            here = bits[place]
            out[open_rows[here]] = self._rank[level][place[here]]
            open_rows = open_rows[~here]
        return out

    def dump(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], np.int64)
        return sizes.tobytes() + b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def load(cls, data: bytes) -> PerfectHash:
        self = cls(np.empty(0, np.uint64))
        n = int(np.frombuffer(data, np.int64, 1)[0])
        at = 8 * (n + 1)
        for size in np.frombuffer(data, np.int64, n, 8).tolist():
            packed = np.frombuffer(data, np.uint8, -(-size // 8), at)
            self.levels.append(np.unpackbits(packed, count=size).astype(bool))
            at += len(packed)
        self._ranks()
        return self


_UNCOUNTED = "a pair of tokens that the first pass didn't count"


class PairTable:
    """The pairs of one bucket: their hash, and the pairs at their numbers."""

    def __init__(self, table: bytes, keys: bytes):
        self.hash, self.keys = PerfectHash.load(table), np.frombuffer(keys, np.uint64)

    def numbers(self, pairs: np.ndarray) -> np.ndarray:
        """-1 for what is not in the bucket."""
        at = self.hash(pairs)
        return np.where((at >= 0) & (self.keys[at] == pairs), at, -1)

    def all_numbers(self, pairs: np.ndarray) -> np.ndarray:
        at = self.numbers(pairs)
        if (at < 0).any():
            raise LookupError(_UNCOUNTED)
        return at


def bucket_of(pairs: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(pairs) % np.uint64(buckets)).astype(np.int64)


# ---- tasks --------------------------------------------------------------------------------


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table[name].combine_chunks().to_numpy(zero_copy_only=False)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch, texts in slices(batches):
        yield batch, [(t or b"").decode("utf-8", "replace") for t in texts]


COUNTS = ("n_a", "n_b", "n_groups", "n_links")
ALIGNED = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", groups_sha256 string"
FIRST = ALIGNED + ", links binary, task long, pair long, n long"
_KINDS = [pa.int64()] * 5 + [pa.string(), pa.binary()] + [pa.int64()] * 3
_NAMES = ["doc_id", *COUNTS, "groups_sha256", "links", "task", "pair", "n"]


def _packed(links: np.ndarray) -> bytes:
    """Links as compressed bytes; equal bytes of neighbours stand together."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(links.view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpacked(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).ravel()


def _first_pass(holders, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with its links, and (in rows without) this task's linked pairs and how often it has them."""
    aligner, task = _aligner(holders), TaskContext.get().partitionId()
    counts: Counter[int] = Counter()

    def batch_of(**columns) -> pa.RecordBatch:
        rows = len(next(iter(columns.values())))
        given = [pa.array(columns[c], k) if c in columns else pa.nulls(rows, k) for c, k in zip(_NAMES, _KINDS, strict=True)]
        return pa.RecordBatch.from_arrays(given, names=_NAMES)

    def counted() -> pa.RecordBatch:
        times = np.zeros(len(aligner.groups), np.int64)
        times[list(counts)] = list(counts.values())
        times = np.repeat(times, aligner.sizes[2])
        pairs, at = np.unique(aligner.links, return_inverse=True)
        n = np.zeros(len(pairs), np.int64)
        np.add.at(n, at, times)
        counts.clear()
        return batch_of(task=np.full(int((n > 0).sum()), task), pair=signed(pairs[n > 0]), n=n[n > 0])

    for batch, texts in _texts(batches):
        every = aligner.numbers(texts)
        starts = np.concatenate([[0], np.cumsum(aligner.sizes[2])])
        described, links = [], []
        for numbers in every:
            counts.update(numbers or ())
            described.append(_described(aligner, numbers))
            links.append(_packed(_links_of(aligner, starts, numbers or [])))
        yield batch_of(doc_id=batch.column(0), **dict(zip([*COUNTS, "groups_sha256"], map(list, zip(*described, strict=True)))), links=links)
        if len(aligner.groups) >= MOST_CHUNKS:
            yield counted()
            aligner.forget()
    yield counted()


def _links_of(aligner: Aligner, starts: np.ndarray, numbers: list[int]) -> np.ndarray:
    """The links of some chunks, one after another."""
    at = np.array(numbers, np.int64)
    sizes = aligner.sizes[2][at]
    before = np.cumsum(sizes) - sizes
    return aligner.links[np.repeat(starts[at] - before, sizes) + np.arange(int(sizes.sum()))]


def _aligner(holders) -> Aligner:
    first, second = holders
    return in_process(first, "aligner", lambda content: Aligner(content, second.value["file"]))


def _built(table: pa.Table) -> pa.Table:
    """One bucket's distinct pairs as a table of its own."""
    pairs = _column(table, "pair").astype(np.uint64)
    hashed = PerfectHash(pairs)
    keys = np.empty(len(pairs), np.uint64)
    keys[hashed(pairs)] = pairs
    return pa.table(
        {"bucket": table["bucket"].slice(0, 1), "table": pa.array([hashed.dump()], pa.binary()), "keys": pa.array([keys.tobytes()], pa.binary())}
    )


def _vector(rows: pa.Table, tables: pa.Table) -> pa.Table:
    """The counts of a few tasks in one bucket, indexed by the hash."""
    pairs = PairTable(tables["table"][0].as_py(), tables["keys"][0].as_py())
    sums = np.zeros(len(pairs.keys), np.int64)
    np.add.at(sums, pairs.all_numbers(_column(rows, "pair").astype(np.uint64)), _column(rows, "n"))
    return pa.table({"bucket": rows["bucket"].slice(0, 1), "branch": rows["branch"].slice(0, 1), "sums": pa.array([sums.tobytes()], pa.binary())})


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.int64) for x in table["sums"].to_pylist())
    return pa.table({"bucket": table["bucket"].slice(0, 1), "branch": table["branch"].slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})


def _unfolded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Second id and count of each pair of some buckets."""
    for batch in batches:
        for keys, sums in zip(batch["keys"].to_pylist(), batch["sums"].to_pylist(), strict=True):
            second = np.frombuffer(keys, np.uint64) & np.uint64(0xFFFFFFFF)
            yield pa.RecordBatch.from_arrays([pa.array(signed(second)), pa.array(np.frombuffer(sums, np.int64))], names=["second", "n"])


def _described(aligner: Aligner, numbers: list[int] | None) -> tuple:
    """Numbers of tokens, groups and links, and the digest."""
    if numbers is None:
        return 0, 0, 0, 0, ""
    n_a, n_b, n_groups = aligner.sizes[:, numbers].sum(axis=1).tolist()
    digest = hashlib.sha256(";".join(map(aligner.groups.__getitem__, numbers)).encode()).hexdigest()
    return n_a, n_b, n_groups, n_groups, digest


def _row_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of about ``SLICE_LINKS`` links, one row at least."""
    for batch in batches:
        ends = np.cumsum(batch["n_links"].to_numpy())
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + SLICE_LINKS, side="right")))
            yield batch.slice(start, end - start)
            start = end


def _looked_up(lookup, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The second pass with tables and counts at hand."""
    held = lookup.value
    if "tables" not in held:
        held["tables"] = {b: PairTable(t, k) for b, t, k, _ in held["rows"]}
        held["sums"] = {b: np.frombuffer(s, np.int64) for b, _, _, s in held["rows"]}
    for batch in _row_slices(batches):
        pairs, at = np.unique(np.concatenate([_unpacked(x) for x in batch["links"].to_pylist()]), return_inverse=True)
        n = np.zeros(len(pairs), np.int64)
        bucket = bucket_of(pairs, held["buckets"])
        order = np.argsort(bucket, kind="stable")
        present, first = np.unique(bucket[order], return_index=True)
        for b, here in zip(present.tolist(), np.split(order, first[1:])):
            if b not in held["tables"]:
                raise LookupError(_UNCOUNTED)
            n[here] = held["sums"][b][held["tables"][b].all_numbers(pairs[here])]
        top = (n == held["best"][(pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)]).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(batch["n_links"].to_numpy())])
        sums = [np.diff(np.concatenate([[0], np.cumsum(x[at])])[ends]) for x in (top, n)]
        yield pa.RecordBatch.from_arrays(
            [*(batch[c] for c in ("doc_id", *COUNTS, "groups_sha256")), *map(pa.array, sums)], names=["doc_id", *COUNTS, "groups_sha256", "n_best", "count_sum"]
        )


def _sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The second pass without: each row with its distinct links, to be sent to their tables."""
    for batch in _row_slices(batches):
        links = [np.unique(_unpacked(x), return_counts=True) for x in batch["links"].to_pylist()]
        ends = pa.array(np.concatenate([[0], np.cumsum([len(p) for p, _ in links])]), pa.int32())
        pairs, times = (np.concatenate(x) for x in zip(*links, strict=True))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (signed(pairs), times.astype(np.int64))]
        names = ["doc_id", "row", *COUNTS, "groups_sha256"]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), *lists], names=[*names, "pairs", "times"])


def _answered(best: np.ndarray, rows: pa.Table, tables: pa.Table) -> pa.Table:
    """Per row: its links in this bucket that are the best of their second id, and the sum of their counts."""
    table = PairTable(tables["table"][0].as_py(), tables["keys"][0].as_py())
    pairs, times = _column(rows, "pair").astype(np.uint64), _column(rows, "times")
    n = np.frombuffer(tables["sums"][0].as_py(), np.int64)[table.all_numbers(pairs)]
    top = n == best[(pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)]
    row, at = np.unique(_column(rows, "row"), return_inverse=True)
    sums = np.zeros((2, len(row)), np.int64)
    np.add.at(sums[0], at, top * times)
    np.add.at(sums[1], at, n * times)
    return pa.table({"row": row, "n_best": sums[0], "count_sum": sums[1]})


def _dealt(buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bucket = bucket_of(batch["pair"].to_numpy().astype(np.uint64), buckets)
        yield batch.append_column("bucket", pa.array(bucket))


# ---- passes -------------------------------------------------------------------------------


def pair_counts(parts: DataFrame) -> tuple[DataFrame, int, int]:
    """``bucket, table, keys, sums`` of the linked pairs ``task, pair, n``, the number of buckets and of pairs."""
    pairs = staged(parts.select("pair").distinct(), "pairs")
    total = pairs.count()
    buckets = max(1, -(-total // BUCKET_PAIRS))

    tables = staged(
        pairs.mapInArrow(partial(_dealt, buckets), "pair long, bucket long").groupBy("bucket").applyInArrow(_built, "bucket long, table binary, keys binary"), "tables"
    )
    sent = parts.select(F.floor(F.col("task") / FAN).alias("branch"), "pair", "n").mapInArrow(partial(_dealt, buckets), "branch long, pair long, n long, bucket long")
    sent = staged(sent, "sent")
    beside = staged(sent.select("bucket", "branch").distinct().join(tables, "bucket"), "beside")
    vector = "bucket long, branch long, sums binary"
    sums = staged(sent.groupBy("bucket", "branch").cogroup(beside.groupBy("bucket", "branch")).applyInArrow(_vector, vector), "sums")
    while (sums.agg(F.max("branch").alias("m")).first().m or 0) > 0:
        folded = sums.withColumn("branch", F.floor(F.col("branch") / FAN))
        sums = staged(folded.groupBy("bucket", "branch").applyInArrow(_added, vector), "sums")
    return tables.join(sums.drop("branch"), "bucket"), buckets, total


def align_tokens(documents: DataFrame, first_path: str, second_path: str, most_shared: int = MOST_SHARED) -> DataFrame:
    """Per row of ``documents``: the numbers of tokens, groups and links, links whose pair is the best of its second id, the sum of counts."""
    spark = documents.sparkSession
    holders = shared_file(spark, first_path), shared_file(spark, second_path)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with scratch(spark) as kept:
        first = staged(rows.mapInArrow(partial(_first_pass, holders), FIRST), "first")
        counts, buckets, total = pair_counts(first.filter("pair IS NOT NULL").select("task", "pair", "n"))
        rows = first.filter("links IS NOT NULL").select("doc_id", *COUNTS, "groups_sha256", "links")
        counts = staged(counts, "counts")
        # One number for each id of the second vocabulary.
        tops = counts.mapInArrow(_unfolded, "second long, n long").groupBy("second").agg(F.max("n").alias("n")).collect()
        best = np.zeros(max((r.second for r in tops), default=0) + 1, np.int64)
        for r in tops:
            best[r.second] = r.n
        order = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        if total <= most_shared:
            lookup = spark.sparkContext.broadcast({"rows": [tuple(r) for r in counts.select("bucket", "table", "keys", "sums").collect()], "buckets": buckets, "best": best})
            found = rows.mapInArrow(partial(_looked_up, lookup), ALIGNED + ", n_best long, count_sum long")
            return kept(found.select(*order), "aligned")
        numbered = rows.withColumn("row", F.monotonically_increasing_id())
        aligned = staged(numbered.mapInArrow(_sent, ALIGNED.replace("doc_id long", "doc_id long, row long") + ", pairs array<long>, times array<long>"), "aligned")

        # The part of a row's number that names its task, cut into stretches of rows.
        part = F.shiftright("row", 12).alias("part")
        links = aligned.select("row", part, F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")
        links = staged(links.mapInArrow(partial(_dealt, buckets), "row long, part long, pair long, times long, bucket long"), "sent")
        beside = staged(links.select("bucket", "part").distinct().join(counts, "bucket"), "beside")
        answers = links.groupBy("bucket", "part").cogroup(beside.groupBy("bucket", "part")).applyInArrow(partial(_answered, best), "row long, n_best long, count_sum long")
        sums = answers.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
        zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_best", "count_sum")}
        return kept(aligned.join(sums, "row", "left").withColumns(zero).select(*order), "aligned")
