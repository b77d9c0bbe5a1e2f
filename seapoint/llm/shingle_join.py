"""Documents whose sets of word shingles are similar: a parity-sketch join.

Each shingle flips one bit of a sketch of ``2^bits`` bits, which is held sparsely: its positions. Two sketches differ in at most as
many bits as the sets do, so a similarity of at least ``PERCENT`` bounds their Hamming distance by the sizes.

- *Candidates.* With ``n`` shingles, at most ``n - ceil(0.75 n)`` positions of a set may be missing in a partner. By the pigeonhole
  principle two partners share one of their first ``n - ceil(0.75 n) + 1`` positions, in any order that is the same for
  all. The order puts positions that are frequent in a bounded sample last; what the sample holds changes the work, not the result.
- *Screen.* Partners must lie in each other's size band; what stands before their first common position is missing in the other, which
  bounds what they can share; and a dense sketch of ``DENSE_BITS`` bits gives a lower bound of the symmetric difference by ``bit_count`` alone.
  In large sets it says nothing, so what it leaves goes through a sketch that grows with the set.
- *Verify.* The exact similarity of the shingle sets of both whole texts.

Vertices are the distinct sets: equal ones are one vertex from the start, whatever their ids. Then every vertex is verified against
one pivot of its groups, twice, and connected components are formed; pivots are the vertices that have a group's position first, as these
have least beside what the group shares and link to most of it. After that only vertices of *different* components that
share a position are still compared, first each with the nearest sketch and then those that are still apart, which completes the
components: a pair inside one component needs no link of its own.

Defined cases: a null or empty text, or one without words, has no shingles and links with nothing; a text of fewer words
than a shingle is one shingle; a row with a null ``doc_id`` links with nothing and has no component; rows that repeat a
``doc_id`` with different texts join the components of all these texts, as the id is one document; other columns are not looked at.
Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seapoint.llm.components import connected_components
from seapoint.llm.marks import marks, without
from seapoint.llm.staging import scratch, staged
from seapoint.llm.words import Words, mixed, plain_words, signed, slices

SHINGLE = 5
# Of text at a time in a Python worker, which takes many times as much for its words and sets.
SLICE_BYTES = 1 << 20
PERCENT = 75
SAMPLE_DOCUMENTS = 8000
SAMPLE_COUNT = 6
MAX_LATE = 1 << 17
DENSE_BITS = 1024
SHORT_BITS = 512
BEFORE = 4
PARTS = 8


def lowered_words(text: bytes | None) -> list[bytes]:
    return plain_words(text.lower()) if text else []


def shingle_sets(texts: list[bytes | None], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Owner and hash of the distinct shingles of several texts, by owner and hash."""
    words = Words([lowered_words(t) for t in texts])
    owner, hashes = words.inside(width), words.windows(width)
    parts = [(owner[owner >= 0], hashes[owner >= 0])]
    for length in {int(n) for n in words.lengths if 0 < n < width}:
        at = words.starts[:-1][words.lengths == length]
        parts.append((np.flatnonzero(words.lengths == length), mixed(words.windows(length)[at] + np.uint64(length))))
    owner, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    return owner[new], hashes[new]


def prefix_length(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return n - -(-n * percent // 100) + 1


def _rows(documents: DataFrame) -> DataFrame:
    """``doc_id, key, text``; rows of one id are told apart by the key."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))


def _vertices(rows: int, owner: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A 64-bit name of each row's whole set: rows with equal sets are one vertex, whatever their ids."""
    sums = [np.zeros(rows, np.uint64) for _ in range(2)]
    for total, values in zip(sums, (mixed(hashes), mixed(hashes ^ np.uint64(0x5851F42D4C957F2D))), strict=True):
        np.add.at(total, owner, values)
    return signed(mixed(sums[0] ^ mixed(sums[1])))


def _prefixes(owner: np.ndarray, hashes: np.ndarray, n: np.ndarray, bits: int, late: np.ndarray) -> pa.ListArray:
    """The first sketch positions of each set, in the order of all sets."""
    place = hashes >> np.uint64(64 - bits)
    rank = mixed(place) >> np.uint64(1)
    if len(late):
        at = np.minimum(np.searchsorted(late, place), len(late) - 1)
        rank |= (late[at] == place).astype(np.uint64) << np.uint64(63)
    order = np.lexsort((rank, owner))
    start = np.concatenate([[0], np.cumsum(n)])
    first = np.arange(len(owner)) - start[owner] < prefix_length(n)[owner]
    ends = np.cumsum(np.bincount(owner[first], minlength=len(n)))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(signed(place[order][first])))


def _sketches(owner: np.ndarray, hashes: np.ndarray, n: np.ndarray) -> tuple[pa.ListArray, pa.ListArray]:
    """Each set's parity sketch in ``DENSE_BITS`` bits, and one with two to four bits for each of its shingles, which folds to the other."""
    least = DENSE_BITS // 64
    width = np.maximum(least, 1 << np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64) >> 6)
    ends = np.concatenate([[0], np.cumsum(width)])
    wide = np.zeros(ends[-1], np.uint64)
    place = hashes & (width[owner].astype(np.uint64) * np.uint64(64) - np.uint64(1))
    np.bitwise_xor.at(wide, ends[owner] + (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
    dense = np.zeros((len(n), least), np.uint64)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        dense[rows] = np.bitwise_xor.reduce(wide[ends[rows][:, None] + np.arange(w)].reshape(len(rows), -1, least), axis=1)
    offsets = np.arange(len(n) + 1) * least
    return tuple(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(signed(x.ravel()))) for at, x in ((offsets, dense), (ends, wide)))


def _describe(bits: int, late, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row: set size, vertex, sketches and prefix."""
    for batch, texts in slices(batches, budget=SLICE_BYTES):
        owner, hashes = shingle_sets(texts)
        n = np.bincount(owner, minlength=len(texts)).astype(np.int64)
        dense, wide = _sketches(owner, hashes, n)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array(n),
                pa.array(_vertices(len(texts), owner, hashes)),
                dense,
                wide,
                _prefixes(owner, hashes, n, bits, late.value),
            ],
            names=["doc_id", "key", "n", "vertex", "dense", "wide", "places"],
        )


def _all_places(bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every sketch position of each row."""
    for _, texts in slices(batches, budget=SLICE_BYTES):
        yield pa.RecordBatch.from_arrays([pa.array(signed(shingle_sets(texts)[1] >> np.uint64(64 - bits)))], names=["place"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=1)
    for batch, texts in slices(batches, budget=SLICE_BYTES):
        packed = pa.array([packer.compress(t or b"") for t in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], names=["doc_id", "key", "packed"])


def _pair_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of ``a, b, pa, pb`` whose texts take about ``SLICE_BYTES`` when unpacked (one pair at least)."""
    for whole in batches:
        # Sizes are read from few packed texts at a time.
        for at in range(0, whole.num_rows, 200):
            batch = whole.slice(at, 200)
            sizes = (map(zstandard.frame_content_size, batch.column(c).to_pylist()) for c in (2, 3))
            ends = np.cumsum([x + y for x, y in zip(*sizes, strict=True)])
            start = 0
            while start < batch.num_rows:
                before = int(ends[start - 1]) if start else 0
                end = max(start + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
                yield batch.slice(start, end - start)
                start = end


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sets are similar."""
    unpack = zstandard.ZstdDecompressor()
    for batch in _pair_slices(batches):
        rows = batch.num_rows
        owner, hashes = shingle_sets([unpack.decompress(x) for c in (2, 3) for x in batch.column(c).to_pylist()])
        n = np.bincount(owner, minlength=2 * rows)
        # Both sets of a pair under one owner: what comes twice is shared.
        pair = owner % rows
        order = np.lexsort((hashes, pair))
        pair, both = pair[order], hashes[order]
        twice = (pair[1:] == pair[:-1]) & (both[1:] == both[:-1])
        common = np.bincount(pair[1:][twice], minlength=rows)
        keep = 100 * common >= PERCENT * (n[:rows] + n[rows:] - common)
        yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep & (common > 0))) for i in (0, 1)], names=["a", "b"])


def _similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The edges among ``pairs(a, b)``; texts travel compressed, one at a time."""
    first = pairs.join(texts.select(F.col("doc").alias("a"), F.col("packed").alias("pa")), "a")
    both = first.join(texts.select(F.col("doc").alias("b"), F.col("packed").alias("pb")), "b")
    return both.select("a", "b", "pa", "pb").mapInArrow(_verify, "a long, b long")


def _shareable(a: str, b: str) -> Column:
    """Sizes within each other's band, and enough left from the common position on, of rows with ``n`` and ``ordinal``."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    left = F.least(n - F.col(f"{a}.ordinal"), m - F.col(f"{b}.ordinal"))
    # common >= p (n + m) / (100 + p)
    return (100 * F.least(n, m) >= PERCENT * F.greatest(n, m)) & (left * (100 + PERCENT) >= PERCENT * (n + m))


def _folded(own: Column, other: Column) -> Column:
    """A sketch in as many bits as another one of at most half its length."""
    size = F.size(other)
    halves = F.zip_with(F.slice(own, 1, size), F.slice(own, size + 1, size), lambda p, q: p.bitwiseXOR(q))
    return F.when(F.size(own) > size, halves).otherwise(own)


def _little_apart(a: Column, b: Column, n: Column) -> Column:
    """Whether sketches of sets of ``n`` shingles together are near enough for a link."""
    differing = F.aggregate(F.zip_with(a, b, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, c: t + c)
    # |A ^ B| = n + m - 2 common
    return differing * (100 + PERCENT) <= (100 - PERCENT) * n


def _short(dense: str) -> list[Column]:
    """A dense sketch folded to ``SHORT_BITS`` bits, a column for each word: an expression that is compiled."""
    words, width = DENSE_BITS // 64, SHORT_BITS // 64
    folded = (reduce(Column.bitwiseXOR, [F.col(dense)[j] for j in range(i, words, width)]) for i in range(width))
    return [x.alias(f"word{i}") for i, x in enumerate(folded)]


def _short_apart(a: str, b: str) -> tuple[Column, Column]:
    """Differing bits of the short sketches of two rows, and whether these are few enough for a link."""
    apart = sum(F.bit_count(F.col(f"{a}.word{i}").bitwiseXOR(F.col(f"{b}.word{i}"))) for i in range(SHORT_BITS // 64))
    return apart, apart * (100 + PERCENT) <= (100 - PERCENT) * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def _with_before(rest: DataFrame) -> DataFrame:
    """``rest`` with the ``BEFORE`` positions that stand before each one in its set, nearest first."""
    order = Window.partitionBy("doc").orderBy("ordinal", "place")
    return rest.select("*", *(F.lag("place", i + 1).over(order).alias(f"before{i}") for i in range(BEFORE)))


def _sketched(open_groups: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows of open groups with short sketches."""
    return open_groups.join(facts.select("doc", *_short("dense")), "doc")


def _stars(open_groups: DataFrame) -> DataFrame:
    """Each vertex with one pivot, in ``a, b``: of those of its groups the one that it shares most positions with.

    A group's pivot has its position first of all: in a group of variants of one text, the one that has least beside that text.
    """
    pivots = staged(open_groups.groupBy("place").agg(F.min(F.struct("ordinal", "doc", "component", "n")).alias("pivot")), "pivots")
    return (
        open_groups.join(pivots, "place")
        .select("doc", "component", "pivot", F.struct("n", "ordinal").alias("own"))
        .filter((F.col("component") != F.col("pivot.component")) & _shareable("own", "pivot"))
        .groupBy(F.col("doc").alias("a"), F.col("pivot.doc").alias("b"))
        .agg(F.count("*").alias("n"))
        .groupBy("a")
        .agg(F.max_by("b", F.struct("n", "b")).alias("b"))
    )


def _near_pivots(rest: DataFrame) -> DataFrame:
    """Each vertex outside a group's main component with one of the group's pivots, in ``a, b``: the one whose sketch is nearest.

    A group is dealt to ``PARTS`` parts by the ids, and the vertex that has the position first is a part's pivot, so a vertex meets few rows however large the group is.
    """
    rest = staged(rest, "sketched")
    row = F.struct("ordinal", "doc", "component", "n", *(f"word{i}" for i in range(SHORT_BITS // 64)))
    part = F.pmod(F.xxhash64("doc"), F.lit(PARTS))
    pivots = rest.groupBy("place", part.alias("part")).agg(F.min(row).alias("y")).select("place", "y")
    x = rest.filter("component <> main").select("place", row.alias("x"))
    apart, near = _short_apart("x", "y")
    met = x.join(staged(pivots, "pivots"), "place").filter((F.col("x.component") != F.col("y.component")) & _shareable("x", "y") & near)
    share = apart / (F.col("x.n") + F.col("y.n"))
    return met.groupBy(F.col("x.doc").alias("a")).agg(F.min(F.struct(share.alias("share"), F.col("y.doc").alias("b"))).alias("y")).select("a", "y.b")


def _last_pairs(rest: DataFrame) -> DataFrame:
    """Pairs ``a > b`` of different components that share a position of ``rest``, whose sizes and short sketches allow a link."""
    x, y = rest.filter("component <> main").alias("x"), rest.alias("y")
    # Both apart from the group's main component: the pair is met twice, and taken once.
    once = (F.col("y.component") == F.col("y.main")) | (F.col("x.doc") < F.col("y.doc"))
    apart, near = _short_apart("x", "y")
    met = (F.col("x.place") == F.col("y.place")) & (F.col("x.component") != F.col("y.component"))
    # A position just before, in both: the pair is met there, where more is left to share, and need not come again.
    again = [F.coalesce(F.col(f"x.before{i}") == F.col(f"y.before{j}"), F.lit(False)) for i in range(BEFORE) for j in range(BEFORE)]
    found = x.join(y, met & once & _shareable("x", "y") & ~reduce(Column.__or__, again) & near)
    share = (apart / (F.col("x.n") + F.col("y.n"))).alias("share")
    return found.select(F.greatest("x.doc", "y.doc").alias("a"), F.least("x.doc", "y.doc").alias("b"), share)


def _nearest(pairs: DataFrame) -> DataFrame:
    """For each vertex of ``pairs(a, b, share)`` the pair that differs in the least share."""
    both = pairs.select(F.explode(F.array("a", "b")).alias("doc"), F.struct("share", "a", "b").alias("pair"))
    return both.groupBy("doc").agg(F.min("pair").alias("pair")).select("pair.a", "pair.b").distinct()


def _apart(pairs: DataFrame, component: DataFrame) -> DataFrame:
    """``pairs`` of different components."""
    x, y = (component.select(F.col("vertex").alias(k), F.col("component").alias(f"c{k}")) for k in "ab")
    named = pairs.join(x, "a", "left").join(y, "b", "left")
    return named.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b"))


def _screened(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """``pairs`` with the greater id first, those whose sketches differ little enough: dense ones, then those that grow with the sets."""
    x, y = (facts.select(F.col("doc").alias(k), F.col("n").alias(f"n{k}"), F.col("dense").alias(f"d{k}")) for k in "ab")
    near = pairs.join(x, "a").join(y, "b").filter(_little_apart(F.col("da"), F.col("db"), F.col("na") + F.col("nb")))
    near = staged(near.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), (F.col("na") + F.col("nb")).alias("n")).distinct(), "dense")
    x, y = (facts.select(F.col("doc").alias(k), F.col("wide").alias(f"w{k}")) for k in "ab")
    a, b = F.col("wa"), F.col("wb")
    # The sizes are within each other's band, so the lengths are equal or one is twice the other.
    close = near.join(x, "a").join(y, "b").filter(_little_apart(_folded(a, b), _folded(b, a), F.col("n")))
    return close.select("a", "b")


def _late_positions(rows: DataFrame, total: int, bits: int) -> np.ndarray:
    """Positions that several rows of a bounded sample share, sorted; at most ``MAX_LATE``, the commonest."""
    share = min(1.0, SAMPLE_DOCUMENTS / max(total, 1))
    sample = rows.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30)))
    common = (
        sample.select("text")
        .mapInArrow(partial(_all_places, bits), "place long")
        .groupBy("place")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") >= SAMPLE_COUNT)
        .orderBy(F.desc("n"), "place")
        .limit(MAX_LATE)
        .select("place")
        .toPandas()["place"]
    )
    return np.sort(common.to_numpy(np.int64).view(np.uint64))


def link_documents(documents: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row."""
    with scratch(documents.sparkSession) as kept:
        return kept(_linked(_rows(documents)), "linked")


def _linked(rows: DataFrame) -> DataFrame:
    counted = rows.agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("size")).first()
    # Positions enough that two different shingles hardly ever share one, so 14 bits beyond the most that there can be of them.
    bits = min(63, max(32, (int(counted["size"] or 0) // 2).bit_length() + 14))
    spark = rows.sparkSession
    late = spark.sparkContext.broadcast(_late_positions(rows.filter("doc_id IS NOT NULL"), counted["rows"], bits))

    with scratch(spark) as kept:
        sets = "doc_id long, key long, n long, vertex long, dense array<long>, wide array<long>, places array<long>"
        sets = staged(rows.mapInArrow(partial(_describe, bits, late), sets), "prefixes")
        described = kept(sets.drop("places"), "sets")
        # Equal sets are one vertex; one of its rows, that of the least id, shows its text.
        usable = described.filter("doc_id IS NOT NULL AND n > 0")
        shown = staged(usable.groupBy(F.col("vertex").alias("doc")).agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n")), "shown")
        places = sets.filter("doc_id IS NOT NULL AND n > 0").select(F.col("vertex").alias("doc"), F.posexplode("places").alias("ordinal", "place"))
        met = staged(
            places.groupBy("place").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low < high").select("place"), "places"
        )
        groups = staged(places.join(met, "place").groupBy("place", "doc").agg(F.min("ordinal").alias("ordinal")), "groups")
        grouped = staged(groups.select("doc").distinct().join(shown, "doc"), "grouped")
        # Rows that repeat an id with texts of equal sets show any of these.
        sketches = usable.select("doc_id", "key", F.col("vertex").alias("doc"), "dense", "wide").join(grouped, ["doc", "doc_id"])
        facts = kept(sketches.select("doc", "doc_id", "key", "n", "dense", "wide").dropDuplicates(["doc"]), "facts")
        packed = rows.filter("doc_id IS NOT NULL").mapInArrow(_pack, "doc_id long, key long, packed binary")
        texts = kept(packed.join(facts.select("doc", "doc_id", "key"), ["doc_id", "key"]).select("doc", "packed").dropDuplicates(["doc"]), "packed")
        groups = kept(groups.join(grouped.select("doc", "n"), "doc"), "sized")

    edges = groups.select(F.col("doc").alias("a"), F.col("doc").alias("b")).limit(0)
    component = staged(connected_components(edges), "components")
    tested = None
    for first in (True, False):
        with scratch(spark) as kept:
            open_groups = _open(groups, component)
            # One pivot for each vertex: the one that it shares most positions with, then, of several in each group, the one with the nearest sketch.
            found = _stars(open_groups) if first else _near_pivots(_sketched(open_groups, facts))
            pairs = _screened(staged(found, "stars"), facts)
            pairs = kept(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
            tested = pairs if tested is None else tested.unionByName(pairs)
            edges = edges.unionByName(kept(_similar(pairs, texts), "similar"))
            component = kept(connected_components(edges), "components")

    # What is left: vertices that share a position but not a component.
    with scratch(spark) as kept:
        # Sketches go along, so that the join of a large group makes rows of pairs that may link and not of all.
        rest = staged(_with_before(_sketched(_open(groups, component), facts)), "rest")
        last = staged(_last_pairs(rest).distinct(), "near")
        last = kept(last.join(tested, ["a", "b"], "left_anti"), "untested")
    # First each vertex with the one whose sketch is nearest, as that links most often and then no other pair inside the component is needed.
    for nearest in (True, False):
        with scratch(spark) as kept:
            pairs = _nearest(last) if nearest else _apart(last, component)
            pairs = staged(_screened(staged(pairs.select("a", "b"), "chosen"), facts), "pairs")
            edges = edges.unionByName(kept(_similar(pairs, texts), "similar"))
            component = kept(connected_components(edges), "components")
    return _named(described, usable, component)


def _named(described: DataFrame, usable: DataFrame, component: DataFrame) -> DataFrame:
    """From components of texts to those of documents: an id that several texts carry joins them."""
    vertices = usable.groupBy("vertex").agg(F.min("doc_id").alias("doc_id"))
    labels = staged(
        vertices.join(component, "vertex", "left").select("vertex", "doc_id", F.coalesce("component", "vertex").alias("label")), "labels"
    )
    several = usable.groupBy("doc_id").agg(F.min("vertex").alias("low"), F.max("vertex").alias("high")).filter("low < high")
    carried = (
        usable.select("doc_id", "vertex").distinct().join(several.select("doc_id"), "doc_id").join(labels.select("vertex", "label"), "vertex")
    )
    carried = staged(carried.select("doc_id", "label").distinct(), "carried")
    first = carried.groupBy("doc_id").agg(F.min("label").alias("b"))
    joined = staged(connected_components(carried.join(first, "doc_id").select(F.col("label").alias("a"), "b")), "joined")
    named = labels.join(joined.select(F.col("vertex").alias("label"), "component"), "label", "left").select(
        "vertex", "doc_id", F.coalesce("component", "label").alias("label")
    )
    named = staged(named, "named")
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    ends = named.join(least, "label").select("vertex", "component_id")
    # One answer for each id, also for those of its rows that have no words.
    documents = usable.groupBy("doc_id").agg(F.min("vertex").alias("vertex"))
    answers = staged(documents.join(ends, "vertex").select("doc_id", "component_id"), "answers")
    return described.join(answers, "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def _open(groups: DataFrame, component: DataFrame) -> DataFrame:
    """``place, doc, component, n, ordinal, main`` of the groups that hold more than one component; ``main`` is the least of them."""
    named = groups.join(component.withColumnRenamed("vertex", "doc"), "doc", "left").select(
        "place", "doc", "n", "ordinal", F.coalesce("component", "doc").alias("component")
    )
    with scratch(groups.sparkSession) as kept:
        named = staged(named, "named")
        open_places = staged(
            named.groupBy("place").agg(F.min("component").alias("main"), F.max("component").alias("high")).filter("main < high").select("place", "main"),
            "open",
        )
        return kept(named.join(open_places, "place"), "open")


def one_of_each(documents: DataFrame) -> DataFrame:
    """``documents`` with one row of each group of similar texts, the one of the least ``doc_id``; columns unchanged.

    Rows are judged by their texts, whatever their ids: a copy with a null ``doc_id`` goes like any other, and rows that repeat an id
    with texts that have nothing in common stay. A null ``doc_id`` comes after all others; among rows of one id the choice falls by a hash
    of the text, then of the whole row, so it is the same in every run. Rows without words stay. Texts are told apart by 64-bit hashes.
    """
    text = F.xxhash64(F.coalesce(documents["text"].cast("string"), F.lit("")))
    # Nulls are hashed as nothing, so that they are named beside the values.
    whole = F.xxhash64(*[x for c in documents.columns for x in (documents[c], documents[c].isNull())])
    with scratch(documents.sparkSession) as kept:
        texts = documents.select(text.alias("doc_id"), documents["text"])
        groups = (
            link_documents(texts).filter("n_shingles > 0").select(F.col("doc_id").alias("key"), F.col("component_id").alias("group")).distinct()
        )
        rows = documents.select(text.alias("key"), whole.alias("row"), documents["doc_id"].cast("long").alias("id"))
        # Copies of a whole row are one here, so a text that fills a third of the table is joined once for each of its rows' values.
        rows = staged(rows.groupBy("key", "row", "id").agg(F.count("*").alias("n")), "rows")
        named = staged(rows.join(staged(groups, "groups"), "key"), "named")
        rank = F.struct(F.col("id").isNull().alias("last"), "id", "key", "row")
        first = staged(named.groupBy("group").agg(F.min(rank).alias("first")), "first")
        other = (F.col("key") != F.col("first.key")) | (F.col("row") != F.col("first.row"))
        gone = kept(named.join(first, "group").filter(other).select("key", "row").distinct(), "gone")
        again = kept(named.filter("n > 1").select("key", "row").distinct(), "again")

    def met(found: DataFrame) -> Column:
        return (text == found["key"]) & (whole == found["row"])

    left = without(documents, whole, met(gone), gone, gone["row"])
    if again.isEmpty():
        return left
    # These are alike in every column, so it makes no difference which one stays.
    copied = documents.filter(marks(again.select(F.col("row").alias("key")))(whole)).join(again, met(again), "left_semi")
    return without(left, whole, met(again), again, again["row"]).unionByName(copied.join(gone, met(gone), "left_anti").distinct())
