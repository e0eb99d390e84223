"""Vector code compression: product codebooks by integer Lloyd rounds with Drake-Hamerly adaptive bounds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

LARGEST = 1 << 28  # integer components are kept within this, so that sums of squares stay below 2^63
NONE = 255  # no candidate at this place
SLACK = 1e-9  # relative error allowed for in bounds, which are floating-point numbers


@dataclass(frozen=True)
class Shape:
    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: int = 4096
    least: int = 2  # bounds of single candidates that a part keeps, at least and at most
    most: int = 8

    def cuts(self, dimension: int) -> list[int]:
        return [p * dimension // self.parts for p in range(self.parts + 1)]


Book = list[np.ndarray]  # by part: entries x components, int64


def moves(old: Book, new: Book) -> list[np.ndarray]:
    """By part: how far each entry moved, rounded up."""
    return [np.sqrt(((n - o).astype(float) ** 2).sum(1)) * (1 + SLACK) for o, n in zip(old, new)]


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x to the rows of entries (both int64), rows x entries."""
    found = np.empty((len(x), len(entries)), np.int64)
    for e, entry in enumerate(entries):
        gap = x - entry
        found[:, e] = np.einsum("ij,ij->i", gap, gap)
    return found


@dataclass
class Bounds:
    """What one part of each vector knows: `own` entry and an upper bound of its distance; the `near` next entries with
    lower bounds in ascending order; one lower bound, `outer`, of all other entries."""

    own: np.ndarray
    upper: np.ndarray
    near: np.ndarray
    lower: np.ndarray
    outer: np.ndarray

    @classmethod
    def fresh(cls, distances: np.ndarray, kept: int, most: int) -> Bounds:
        """From exact squared distances to all entries: the `kept` closest after the own one are candidates."""
        order = np.argsort(distances, axis=1, kind="stable")  # ties to the lower index
        roots = np.sqrt(np.take_along_axis(distances, order, 1).astype(float))
        n, k = distances.shape
        kept = min(kept, k - 1)
        near, lower = np.full((n, most), NONE, np.uint8), np.full((n, most), np.inf)
        near[:, :kept], lower[:, :kept] = order[:, 1 : kept + 1], roots[:, 1 : kept + 1] * (1 - SLACK)
        outer = roots[:, kept + 1] * (1 - SLACK) if kept + 1 < k else np.full(n, np.inf)
        return cls(order[:, 0].astype(np.uint8), roots[:, 0] * (1 + SLACK), near, lower, outer)

    def put(self, rows: np.ndarray, other: Bounds) -> None:
        for name in ("own", "upper", "near", "lower", "outer"):
            getattr(self, name)[rows] = getattr(other, name)

    def moved(self, move: np.ndarray) -> None:
        """Bounds after the entries moved."""
        far = np.append(move, np.zeros(NONE + 1 - len(move)))
        self.upper += move[self.own]
        self.lower -= far[self.near]
        self.outer -= move.max(initial=0.0)


def reassign(x: np.ndarray, entries: np.ndarray, b: Bounds, kept: int) -> np.ndarray:
    """Brings b, whose bounds hold for the present entries, to the nearest entries; returns how many of its candidates
    each row had to look at (0: the upper bound was enough; most + 1: all entries).

    An entry is out only where its lower bound is over the upper bound; the rest, which may be ties, are decided by exact
    integer distances, ties to the lower index.
    """
    most = b.near.shape[1]
    used = np.zeros(len(x), np.int64)
    floor = np.minimum(b.lower.min(1, initial=np.inf), b.outer)
    rows = np.flatnonzero(b.upper >= floor)
    if not len(rows):
        return used
    gap = x[rows] - entries[b.own[rows]]
    exact = np.einsum("ij,ij->i", gap, gap)
    b.upper[rows] = np.sqrt(exact.astype(float)) * (1 + SLACK)
    open_ = b.upper[rows] >= floor[rows]
    rows, exact = rows[open_], exact[open_]
    if not len(rows):
        return used
    whole = b.upper[rows] >= b.outer[rows]
    if whole.any():
        all_rows = rows[whole]
        b.put(all_rows, Bounds.fresh(squared(x[all_rows], entries), kept, most))
        used[all_rows] = most + 1
        rows, exact = rows[~whole], exact[~whole]
    if not len(rows):
        return used
    near, lower, own = b.near[rows], b.lower[rows], b.own[rows]
    look = (lower <= b.upper[rows][:, None]) & (near != NONE)
    used[rows] = (look * np.arange(1, most + 1)).max(1)
    r, c = np.nonzero(look)
    gap = x[rows[r]] - entries[near[r, c]]
    found = np.full(look.shape, np.iinfo(np.int64).max)
    found[r, c] = np.einsum("ij,ij->i", gap, gap)
    # All that were looked at, the own entry first, then the candidates left alone with their old bounds.
    ids = np.concatenate((own[:, None], near), 1)
    values = np.concatenate((exact[:, None], found), 1)
    best = np.lexsort((ids, values), axis=1)[:, 0]
    at = np.arange(len(rows))
    roots = np.where(np.concatenate((np.ones((len(rows), 1), bool), look), 1), np.sqrt(values.astype(float)) * (1 - SLACK), np.concatenate((np.zeros((len(rows), 1)), lower), 1))
    b.own[rows] = ids[at, best]
    b.upper[rows] = np.sqrt(values[at, best].astype(float)) * (1 + SLACK)
    roots[at, best] = -np.inf  # first, and so left out of the candidates
    order = np.argsort(roots, axis=1, kind="stable")[:, 1:]
    b.near[rows], b.lower[rows] = np.take_along_axis(ids, order, 1), np.take_along_axis(roots, order, 1)
    return used


def narrowed_to(b: Bounds, kept: int) -> None:
    """Candidates beyond the first `kept` fall under the outer bound."""
    b.outer[:] = np.minimum(b.outer, b.lower[:, kept:].min(1, initial=np.inf))
    b.near[:, kept:], b.lower[:, kept:] = NONE, np.inf


STATE = "id long, v array<int>, own binary, near binary, bounds binary, used binary"


def packed(id_: pa.Array, v: pa.Array, states: list[Bounds], used: np.ndarray) -> pa.RecordBatch:
    n = len(id_)
    blob = lambda a: pa.FixedSizeBinaryArray.from_buffers(pa.binary(a[0].nbytes if n else 1), n, [None, pa.py_buffer(np.ascontiguousarray(a))]).cast(pa.binary())
    own = np.stack([b.own for b in states], 1)
    near = np.stack([b.near for b in states], 1)
    bounds = np.stack([np.concatenate((b.upper[:, None], b.outer[:, None], b.lower), 1) for b in states], 1)
    return pa.RecordBatch.from_arrays([id_, v, *map(blob, (own, near, bounds, used))], ["id", "v", "own", "near", "bounds", "used"])


def vectors(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dimension)


def unpacked(batch: pa.RecordBatch, shape: Shape) -> list[Bounds]:
    n = batch.num_rows
    read = lambda name, kind, *of: np.frombuffer(b"".join(batch.column(name).to_pylist()), kind).reshape(n, shape.parts, *of).copy()
    own, near, bounds = read("own", np.uint8), read("near", np.uint8, shape.most), read("bounds", np.float64, shape.most + 2)
    return [Bounds(own[:, p].copy(), bounds[:, p, 0].copy(), near[:, p].copy(), bounds[:, p, 2:].copy(), bounds[:, p, 1].copy()) for p in range(shape.parts)]


def assigned(state: DataFrame, old: Book | None, book: Book, kept: int, shape: Shape, dimension: int) -> DataFrame:
    """The state of every vector after it is given to the entries of book; old: the book that its bounds were made for."""
    cuts = shape.cuts(dimension)
    move = moves(old, book) if old else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = vectors(batch.column("v"), dimension)
            states = unpacked(batch, shape) if old else []
            used = np.full((len(x), shape.parts), shape.most + 1, np.uint8)
            for p in range(shape.parts):
                own = x[:, cuts[p] : cuts[p + 1]]
                if not old:
                    states.append(Bounds.fresh(squared(own, book[p]), kept, shape.most))
                    continue
                states[p].moved(move[p])
                used[:, p] = reassign(own, book[p], states[p], kept)
                narrowed_to(states[p], kept)
            yield packed(batch.column("id"), batch.column("v"), states, used)

    return state.mapInArrow(run, STATE)


def gathered(state: DataFrame, shape: Shape, dimension: int) -> pd.DataFrame:
    """part, entry, place, total, n: of each entry the number of parts given to it and the sums of their components; rows
    of part -1: how many parts looked at `entry` of their candidates. A batch gives at most entries x components rows,
    which Spark adds up before and after the shuffle."""
    cuts = shape.cuts(dimension)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = vectors(batch.column("v"), dimension)
            own = np.frombuffer(b"".join(batch.column("own").to_pylist()), np.uint8).reshape(-1, shape.parts)
            looks = np.bincount(np.frombuffer(b"".join(batch.column("used").to_pylist()), np.uint8))
            rows = [(-1, d, 0, n, n) for d, n in enumerate(looks.tolist())]
            for p in range(shape.parts):
                mine = x[:, cuts[p] : cuts[p + 1]]
                for e, n in enumerate(np.bincount(own[:, p]).tolist()):
                    if n:
                        rows += [(p, e, i, s, n) for i, s in enumerate(mine[own[:, p] == e].sum(0).tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["part", "entry", "place", "total", "n"])

    each = state.mapInArrow(run, "part long, entry long, place long, total long, n long")
    return each.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toPandas()


def adapted(kept: int, sums: pd.DataFrame, shape: Shape) -> int:
    """How many candidates parts keep from now on: as many as 98 % of those that had to look looked at; twice as many as
    now where over a tenth of all had to look at every entry."""
    looks = sums[sums["part"] == -1].sort_values("entry")
    every = looks.loc[looks["entry"] > shape.most, "n"].sum()
    if every > 0.1 * looks["n"].sum():
        return min(shape.most, 2 * kept)
    some = looks[(looks["entry"] > 0) & (looks["entry"] <= shape.most)]
    upto = some["n"].cumsum()
    enough = some.loc[upto >= 0.98 * some["n"].sum(), "entry"]
    return max(shape.least, min(kept, int(enough.iloc[0]) if len(enough) else 0))


def means(book: Book, sums: pd.DataFrame) -> Book:
    """Componentwise floor of the means; entries that have no part stay."""
    new = [b.copy() for b in book]
    for r in sums[sums["part"] >= 0].itertuples(index=False):
        new[r.part][r.entry, r.place] = int(r.total) // int(r.n)
    return new


def integers(vectors: DataFrame, key: str, value: str, label: str, scale: int) -> DataFrame:
    """id (any unique number), key, label, v: integer vectors of the rows whose vector is whole."""
    fine = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    scaled = F.transform(value, lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(x.cast("double") * scale))).cast("int"))
    return vectors.filter(F.col(value).isNotNull() & fine).select(F.col(key).alias("key"), F.col(label).alias("label"), scaled.alias("v"), F.monotonically_increasing_id().alias("id"))


def compress(table: DataFrame, key: str = "vec_id", value: str = "embedding", label: str = "label", shape: Shape = Shape()) -> tuple[DataFrame, Book, dict]:
    """key, label, codes array<int>, error long of every row with a whole vector; the codebooks; what the rounds did.

    A row whose vector is null or holds a null or non-finite component is dropped. Components are floor(scale * x), within
    +-2^28. A codebook starts as its part of the vectors of the `entries` smallest keys (nulls last, ties by vector); of
    fewer vectors it has as many entries. Vectors must have one length: those that haven't the most common one (of equally
    common ones the largest) are dropped too. A length that isn't a multiple of `parts` is cut at p * length // parts. Equal keys are rows of
    their own, a null label is a label like any other, and other columns are ignored. An empty table gives no rows.

    A round is one pass of batches: bounds are moved by how far the entries moved, what they can't decide is decided by
    exact integer distances. Vectors and bounds are persisted between rounds, with their lineage, so a lost executor's are
    made again from the table of integers; only one round's are held. Sums of at most entries x components numbers reach
    the driver. The number of candidates that a part keeps follows how many of them parts had to look at in the round before.
    """
    spark = table.sparkSession
    whole = written(integers(table, key, value, label, shape.scale))
    common = whole.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("n")).first()
    dimension = common["n"] if common else 0
    of = whole.filter(F.size("v") == dimension)
    first = [r["v"] for r in of.orderBy(F.col("key").asc_nulls_last(), "v").select("v").limit(shape.entries).collect()]
    cuts = shape.cuts(dimension)
    book: Book = [np.array([v[cuts[p] : cuts[p + 1]] for v in first], np.int64).reshape(len(first), cuts[p + 1] - cuts[p]) for p in range(shape.parts)]
    if not first:
        found = of.select("key", "label", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error"))
        return found.toDF(key, label, "codes", "error"), book, {"kept": []}

    none = lambda: F.lit(None).cast("binary")
    state = of.select("id", "v", none().alias("own"), none().alias("near"), none().alias("bounds"), none().alias("used"))
    old, kept, done = None, max(shape.least, min(shape.most, shape.entries // 4)), []
    for _ in range(shape.rounds):
        new = assigned(state, old, book, kept, shape, dimension).persist(StorageLevel.MEMORY_AND_DISK)
        sums = gathered(new, shape, dimension)
        if old:
            state.unpersist()
        done.append(kept)
        kept = adapted(kept, sums, shape) if old else kept
        state, old, book = new, book, means(book, sums)
    final = assigned(state, old, book, kept, shape, dimension)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = vectors(batch.column("v"), dimension)
            own = np.frombuffer(b"".join(batch.column("own").to_pylist()), np.uint8).reshape(-1, shape.parts)
            error = np.zeros(len(x), np.int64)
            for p in range(shape.parts):
                gap = x[:, cuts[p] : cuts[p + 1]] - book[p][own[:, p]]
                error += np.einsum("ij,ij->i", gap, gap)
            codes = pa.ListArray.from_arrays(pa.array(np.arange(0, own.size + 1, shape.parts, dtype=np.int32)), pa.array(own.astype(np.int32).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), codes, pa.array(error)], ["id", "codes", "error"])

    coded = written(final.mapInArrow(last, "id long, codes array<int>, error long"))
    state.unpersist()
    return of.select("id", "key", "label").join(coded, "id").select(F.col("key").alias(key), F.col("label").alias(label), "codes", "error"), book, {"kept": done}


def book_digest(book: Book) -> str:
    """SHA-256 of all entries' decimal components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(str(x) for part in book for x in part.ravel().tolist()).encode()).hexdigest()


def label_errors(coded: DataFrame, label: str = "label") -> DataFrame:
    """Adds label_error: error summed over the rows of a label, nulls together. The sums are a written table, which Spark
    broadcasts if it is small and else joins by key, splitting a label with many rows."""
    sums = written(coded.groupBy(F.col(label).alias("_label")).agg(F.sum("error").alias("label_error")))
    return coded.join(sums, F.col(label).eqNullSafe(F.col("_label")), "left").drop("_label")
