"""Vector code compression by ball k-means over whole numbers.

Components become whole numbers and vectors are cut into parts; every part position has
a codebook, and a vector's code names the nearest entry of each part. Entries are moved
to the mean of their parts in rounds.

A ball is an entry with the parts grouped around it. In a round its radius is the
distance of its farthest part. An entry is a neighbour of the ball if it is no farther
than twice the radius from the ball's entry; no other can be as near to a part of the
ball as its own entry. With neighbours in order of distance, half these distances cut
the ball into a stable core, whose parts cannot move and are not compared, and into
rings: the parts of the n-th ring are compared with the first n neighbours. Distances
are exact whole numbers, so ties are seen and go to the lower index, and results do not
depend on how the rows are dealt. This holds for any grouping; the parts are grouped as
the first round placed them, and written once with that grouping, so later rounds only
read. What leaves a round's tasks are sums for each entry; codebooks are all that the
driver holds and sends out, at most ``entries`` times the components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesengine.llm.common import slices, stored

#: Components from here on, after scaling, are beyond exact 64-bit squared distances.
BEYOND = 1 << 28
#: Members of a ball compared at once, those of neighbouring rings.
AT_ONCE = 64
ROWS = 8_192


@dataclass(frozen=True)
class Settings:
    parts: int = 4
    entries: int = 256
    rounds: int = 4
    scale: int = 1024


def whole_numbers(vectors: DataFrame, settings: Settings, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, cells): scaled and floored components of the vectors that take part.

    Null vectors and those with null, non-finite or out-of-range components
    (2^28 / scale or more) take none.
    """
    cells = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * settings.scale))

    def bad(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * settings.scale) >= BEYOND)

    fine = F.col(vector_col).isNotNull() & ~F.coalesce(F.exists(F.col(vector_col), bad), F.lit(True))
    return vectors.where(fine).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), cells.cast("array<int>").alias("cells")
    )


def exact_type(cells: np.ndarray, books: np.ndarray) -> type:
    """Doubles where they hold all distances exactly, as products are faster then."""
    largest = max(np.abs(cells).max(initial=0), np.abs(books).max(initial=0))
    return np.float64 if 4 * books.shape[-1] * int(largest) ** 2 < 1 << 53 else np.int64


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all entries, in the type of the rows."""
    return (x * x).sum(axis=1)[:, None] + (entries * entries).sum(axis=1)[None, :] - 2 * (x @ entries.T)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entries by comparing all, and their distances; ties go to the lower index."""
    all_of = distances(x, entries)
    code = all_of.argmin(axis=1)
    return code, all_of[np.arange(len(x)), code]


def nearest_in_balls(x: np.ndarray, entries: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Like ``nearest``, for parts grouped around the entries ``home``."""
    code = home.astype(np.int64)
    own = ((x - entries[code]) ** 2).sum(axis=1)
    best = own.copy()
    # an entry at squared distance D can be as near as the own one only from D / 4 on
    need = np.ceil(distances(entries, entries) / 4) if x.dtype == np.float64 else (distances(entries, entries) + 3) // 4
    by_ball = np.argsort(code, kind="stable")
    balls, starts = np.unique(code[by_ball], return_index=True)
    for ball, members in zip(balls.tolist(), np.split(by_ball, starts[1:])):
        radius = own[members].max()
        others = np.flatnonzero(need[ball] <= radius)
        others = others[others != ball]
        others = others[np.argsort(need[ball][others], kind="stable")]
        ring = np.searchsorted(need[ball][others], own[members], side="right")
        members = members[ring > 0]  # the others are the stable core
        order = np.argsort(ring[ring > 0], kind="stable")
        members, ring = members[order], ring[ring > 0][order]
        for at in range(0, len(members), AT_ONCE):
            some = members[at : at + AT_ONCE]
            candidates = np.append(others[: ring[min(at + AT_ONCE, len(ring)) - 1]], ball)
            candidates.sort()
            far = distances(x[some], entries[candidates])
            first = far.argmin(axis=1)
            code[some], best[some] = candidates[first], far[np.arange(len(some)), first]
    return code, best


def _parts(part: pa.RecordBatch, count: int) -> np.ndarray:
    """(parts, rows, width) of a batch's cells."""
    flat = part.column("cells").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(part.num_rows, count, -1).transpose(1, 0, 2)


def _assign(
    part: pa.RecordBatch, books: np.ndarray, count: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells by part, codes (rows, parts), and the squared distances summed over parts."""
    cells = _parts(part, count)
    kind = exact_type(cells, books)
    homes = None
    if "home" in part.schema.names:
        joined = b"".join(part.column("home").to_pylist())
        homes = np.frombuffer(joined, np.uint8).reshape(part.num_rows, count)
    codes, error = np.zeros((part.num_rows, count), np.uint8), np.zeros(part.num_rows, np.int64)
    for p in range(count):
        x, entries = cells[p].astype(kind), books[p].astype(kind)
        code, far = nearest(x, entries) if homes is None else nearest_in_balls(x, entries, homes[:, p])
        codes[:, p] = code
        error += far.astype(np.int64)
    return cells, codes, error


def _first_books(cells: DataFrame, settings: Settings) -> np.ndarray | None:
    """(parts, entries, width) from the rows with the smallest ids; None without a row."""
    rows = cells.where("vec_id IS NOT NULL").orderBy("vec_id", "cells").limit(settings.entries).collect()
    if not rows or not len(rows[0].cells) or len(rows[0].cells) % settings.parts:
        return None
    length = len(rows[0].cells)
    same = np.array([r.cells for r in rows if len(r.cells) == length], np.int64)
    return same.reshape(len(same), settings.parts, -1).transpose(1, 0, 2).copy()


def grouped(cells: DataFrame, books: np.ndarray, settings: Settings) -> DataFrame:
    """The rows with the entries next to their parts as ``home``, a byte for each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, ROWS):
            _, codes, _ = _assign(part, books, settings.parts)
            home = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns, home], [*part.schema.names, "home"])

    schema = cells.withColumn("home", F.lit(b"")).schema
    return cells.mapInArrow(run, schema)


def moved(state: DataFrame, books: np.ndarray, settings: Settings) -> np.ndarray:
    """The codebooks after a round: entries at the floored mean of their parts, unused ones as they were."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for part in slices(batches, ROWS):
            cells, codes, _ = _assign(part, books, parts)
            for p in range(parts):
                np.add.at(sums[p], codes[:, p], cells[p])
                counts[p] += np.bincount(codes[:, p], minlength=entries)
        at = np.argwhere(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(at[:, 0], pa.int32()),
                pa.array(at[:, 1], pa.int32()),
                pa.array(counts[at[:, 0], at[:, 1]], pa.int64()),
                pa.array(list(sums[at[:, 0], at[:, 1]]), pa.list_(pa.int64())),
            ],
            ["part", "entry", "n", "sums"],
        )

    found = state.mapInArrow(run, "part int, entry int, n long, sums array<long>")
    totals = found.groupBy("part", "entry").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums")
    )
    after = books.copy()
    for row in totals.collect():  # at most one for each entry of each part
        after[row.part, row.entry] = np.array(row.sums, np.int64) // row.n
    return after


def compress(
    vectors: DataFrame,
    settings: Settings = Settings(),
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of every vector that takes part, and the codebooks.

    ``code`` has a byte for each part, ``error`` is the squared distance to the coded
    vector. Codebooks (parts, entries, width) begin with the parts of the ``entries``
    rows with the smallest ids, equal ids by their vectors; there are fewer for fewer
    rows. See ``whole_numbers`` for the rows that take no part; so do those that are not
    as long as the vector with the smallest id. Rows without an id are coded, but never
    begin a codebook. Without a row to begin with, or if its length does not divide into
    parts, nothing is coded and the codebooks are empty. Repeated rows are kept; other
    columns are not read.
    """
    if not 1 <= settings.entries <= 256:
        raise ValueError("an entry's number is one byte")
    cells = whole_numbers(vectors, settings, id_col, vector_col, label_col)
    books = _first_books(cells, settings)
    schema = cells.select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")).schema
    if books is None:
        none = np.zeros((settings.parts, 0, 0), np.int64)
        return cells.sparkSession.createDataFrame([], schema), none
    fitting = cells.where(F.size("cells") == books.shape[0] * books.shape[2])
    state = stored(grouped(fitting, books, settings))
    for _ in range(settings.rounds):
        books = moved(state, books, settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, ROWS):
            _, codes, error = _assign(part, books, settings.parts)
            code = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id"), part.column("label"), code, pa.array(error)], ["vec_id", "label", "code", "error"]
            )

    return state.mapInArrow(run, schema), books


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
