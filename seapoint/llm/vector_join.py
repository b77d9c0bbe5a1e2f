"""Near-duplicate vectors by an exact metric range join.

Cosine at least ``c`` is an angle of at most ``r = acos(c)``, and angles are a metric. Every vector
belongs to the cell of its nearest pivot. A partner in another cell lies within ``r``, so by the
triangle inequality a vector has to visit cell ``j`` only if its angle to pivot ``j`` is at most the
cell's radius plus ``r`` and exceeds that to its own pivot by at most ``2 r``. A cell compares its own
vectors with all that visit it; all links of a vector are found in its own cell, and a cell passes on only
counts and one edge per vector to the least vector that its links reach, never the pairs.

Pivots are a bounded sample (at most ``MAX_PIVOTS``). Cells come in parts of at most ``PART_ROWS`` own
vectors, dealt by a hash, so that no task holds more of them at once, whatever the cell's size;
visitors stream past in batches.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with
nothing; vectors of other lengths are compared among themselves only; a repeated ``vec_id`` is a vector of
its own for counts, and links to its copy count; null ids keep no component (null);
other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seapoint.llm.components import connected_components
from seapoint.llm.staging import staged

COSINE = 0.95
CELL_ROWS = 4096
PART_ROWS = 8192
MAX_PIVOTS = 1024
SLACK = 1e-9
BLOCK = 512


def _read_vectors(vectors: DataFrame) -> tuple[DataFrame, type]:
    """``vec_id, vec`` with the components as bytes (null where the vector can link with nothing)."""
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    number = np.float32 if kind == "float" else np.float64
    column = F.col("embedding") if kind in ("float", "double") else F.col("embedding").cast("array<double>")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(1):
                if x.as_py() is None or len(x.values) == 0 or x.values.null_count:
                    out.append(None)
                    continue
                v = x.values.to_numpy(zero_copy_only=False).astype(number)
                largest = np.abs(v).max()
                out.append(v.tobytes() if np.isfinite(largest) and largest > 0 else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "vec"])

    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), column.alias("embedding"))
        .mapInArrow(read, "vec_id long, vec binary")
        .withColumn("vec", F.when(F.col("vec_id").isNotNull(), F.col("vec")))
    ), number


def _unit(rows: list[bytes], number) -> np.ndarray:
    """Vectors of length 1. Scaled by the largest component first: squares of very large or small ones leave the range of doubles."""
    m = np.frombuffer(b"".join(rows), number).reshape(len(rows), -1).astype(np.float64)
    # By an exact power of two, so that nothing is rounded; in two steps, as its inverse may not be a double.
    power = np.frexp(np.abs(m).max(axis=1, keepdims=True))[1]
    m = np.ldexp(np.ldexp(m, -(power // 2)), -(power - power // 2))
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _angles(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(m @ pivots.T, -1.0, 1.0))


def _by_length(rows: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    for size in np.unique(sizes):
        yield int(size), np.flatnonzero(sizes == size)


class _Cells:
    """Pivots by vector length, and the first cell number of each length."""

    def __init__(self, number, pivots: dict, first: dict):
        self.number, self.pivots, self.first = number, pivots, first

    @staticmethod
    def parts(rows: list[bytes], lengths: list[int], number) -> tuple:
        pivots, first, cell = {}, {}, 0
        for size in sorted(lengths):
            own = [r for r in rows if len(r) == size]
            pivots[size] = _unit(own, number) if own else None
            first[size] = cell
            cell += max(1, len(own))
        return number, pivots, first

    def near(self, size: int, rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Angles to all pivots, nearest cell, angle to it. A length without a pivot is one cell."""
        pivots = self.pivots[size]
        angles = _angles(_unit(rows, self.number), pivots) if pivots is not None else np.zeros((len(rows), 1))
        home = angles.argmin(1)
        return angles, home, angles[np.arange(len(rows)), home]


class _Part:
    """Own vectors of one part of a cell; visitors are compared as they come."""

    def __init__(self, number, cosine: float):
        self.number, self.cosine = number, cosine
        self.cls: list[int] = []
        self.rep: list[int] = []
        self.vec: list[bytes] = []
        self.unit: np.ndarray | None = None

    def add(self, cls, rep, vec) -> None:
        self.cls += cls
        self.rep += rep
        self.vec += vec

    def meet(self, rep: np.ndarray, n: np.ndarray, vec: list[bytes]) -> Iterator[tuple[int, int]]:
        """Compare visitors with the own vectors; gives one edge for each visitor that has a link."""
        if self.unit is None:
            self.unit = _unit(self.vec, self.number)
            self.reps = np.array(self.rep, np.int64)
            self.links = np.zeros(len(self.rep), np.int64)
            self.root = np.arange(len(self.rep))
        for start in range(0, len(vec), BLOCK):
            near = _unit(vec[start : start + BLOCK], self.number) @ self.unit.T >= self.cosine
            self.links += n[start : start + BLOCK] @ near
            for i in np.flatnonzero(near.any(1)):
                roots = np.unique(self.root[near[i]])
                if len(roots) > 1:
                    self.root[np.isin(self.root, roots)] = roots[0]
                yield int(rep[start + i]), int(self.reps[roots[0]])

    def close(self) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        return self.cls, self.links, self.reps, self.reps[self.root]


def link_vectors(
    vectors: DataFrame, cosine: float = COSINE, cell_rows: int = CELL_ROWS, part_rows: int = PART_ROWS
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row."""
    spark = vectors.sparkSession
    reach = math.acos(cosine) + SLACK
    rows, number = _read_vectors(vectors)
    rows = staged(rows, "vectors")
    classes = staged(
        rows.filter("vec IS NOT NULL")
        .groupBy("vec")
        .agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
        .withColumn("cls", F.monotonically_increasing_id()),
        "classes",
    )
    total = classes.count()
    wanted = max(1, min(MAX_PIVOTS, -(-total // cell_rows)))
    sample = [bytes(r.vec) for r in classes.orderBy(F.xxhash64("vec"), "vec").limit(wanted).select("vec").collect()]
    lengths = [r.size for r in classes.select(F.length("vec").alias("size")).distinct().collect()]
    share = spark.sparkContext.broadcast(_Cells.parts(sample, lengths, number))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Cells(*share.value)
        for batch in batches:
            vec = [bytes(v) for v in batch["vec"]]
            for size, at in _by_length(vec):
                _, home, angle = known.near(size, [vec[i] for i in at])
                yield pd.DataFrame({"cell": home + known.first[size], "angle": angle})

    measured = {
        r.cell: (r.radius, r.n)
        for r in classes.select("vec")
        .mapInPandas(measure, "cell long, angle double")
        .groupBy("cell")
        .agg(F.max("angle").alias("radius"), F.count("*").alias("n"))
        .collect()
    }
    radii = spark.sparkContext.broadcast({k: (radius, -(-n // part_rows)) for k, (radius, n) in measured.items()})

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, sizes = _Cells(*share.value), radii.value
        for batch in batches:
            all_vec = [bytes(v) for v in batch["vec"]]
            for size, at in _by_length(all_vec):
                part = batch.iloc[at]
                vec = part["vec"].to_numpy()
                cls = part["cls"].to_numpy(np.int64)
                angles, home, own = known.near(size, [all_vec[i] for i in at])
                for j in range(angles.shape[1]):
                    radius, parts = sizes.get(j + known.first[size], (None, 0))
                    if radius is None:
                        continue
                    goes = (home == j) | ((angles[:, j] <= radius + reach) & (angles[:, j] <= own + 2 * reach))
                    k = np.flatnonzero(goes)
                    for q in range(parts if len(k) else 0):
                        sent = pd.DataFrame(
                            {
                                "cell": j + known.first[size],
                                "part": q,
                                "own": False,
                                "cls": cls[k],
                                "rep": part["rep"].to_numpy(np.int64)[k],
                                "n": part["n"].to_numpy(np.int64)[k],
                                "vec": vec[k],
                            }
                        )
                        yield sent
                        # Own vectors come as owners too, before all visitors.
                        mine = (home[k] == j) & (cls[k] * 2654435761 % 4294967291 % parts == q)
                        if mine.any():
                            yield sent[mine].assign(own=True)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None

        def frame(cls, links, a, b) -> pd.DataFrame:
            return pd.DataFrame({k: pd.array(v, "Int64") for k, v in (("cls", cls), ("links", links), ("a", a), ("b", b))})

        def edges(found) -> pd.DataFrame:
            pairs = sorted({(a, b) for a, b in found if a != b})
            none = [None] * len(pairs)
            return frame(none, none, [a for a, _ in pairs], [b for _, b in pairs])

        def closed() -> Iterator[pd.DataFrame]:
            if state is not None and state.cls:
                yield frame(*state.close())

        for batch in batches:
            keys = list(zip(batch["cell"], batch["part"], strict=True))
            cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if keys[lo] != at:
                    yield from closed()
                    at, state = keys[lo], _Part(number, cosine)
                rows = batch.iloc[lo:hi]
                vec = [bytes(v) for v in rows["vec"]]
                own = rows["own"].to_numpy(bool)
                if own.any():
                    k = np.flatnonzero(own)
                    state.add(rows["cls"].iloc[k].tolist(), rows["rep"].iloc[k].tolist(), [vec[i] for i in k])
                k = np.flatnonzero(~own)
                if len(k) and state.cls:
                    yield edges(state.meet(rows["rep"].to_numpy(np.int64)[k], rows["n"].to_numpy(np.int64)[k], [vec[i] for i in k]))
        yield from closed()

    visits = (
        classes.select("cls", "rep", "n", "vec")
        .mapInPandas(visit, "cell long, part long, own boolean, cls long, rep long, n long, vec binary")
    )
    found = staged(
        visits.repartition("cell", "part")
        .sortWithinPartitions("cell", "part", F.desc("own"))
        .mapInPandas(compare, "cls long, links long, a long, b long"),
        "links",
    )
    components = staged(connected_components(found.select("a", "b")), "components")
    links = found.filter("cls IS NOT NULL").select("cls", "links")
    described = staged(
        classes.select("vec", "cls", "rep")
        .join(links, "cls", "left")
        .join(components.withColumnRenamed("vertex", "rep"), "rep", "left")
        .select("vec", "links", F.coalesce("component", "rep").alias("component_id")),
        "described",
    )
    return rows.join(described, "vec", "left").select(
        "vec_id",
        F.coalesce(F.col("links") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
