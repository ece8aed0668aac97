import math

import numpy as np
import pytest

from salesengine.llm import vector_codes as vc

VECTORS = "vec_id long, embedding array<float>, label int, error string, code int"


def plain(rows, parts=4, entries=256, rounds=4, scale=1024):
    """Lloyd's rounds with Python's whole numbers; rows are (id, vector)."""
    cells = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows]
    width = len(cells[0][1]) // parts
    cut = [(i, [c[p * width : (p + 1) * width] for p in range(parts)]) for i, c in cells]
    first = sorted((x for x in cut if x[0] is not None), key=lambda x: (x[0], sum(x[1], [])))[:entries]
    books = [[list(c[p]) for _, c in first] for p in range(parts)]

    def near(x, book):
        far = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in book]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for _, c in cut:
                members.setdefault(near(c[p], books[p])[0], []).append(c[p])
            for e, xs in members.items():
                books[p][e] = [sum(col) // len(xs) for col in zip(*xs)]
    out = []
    for i, c in cut:
        found = [near(c[p], books[p]) for p in range(parts)]
        out.append((i, bytes(e for e, _ in found), sum(d for _, d in found)))
    return out, books


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], VECTORS)


def coded(df):
    return sorted(((r.vec_id, bytes(r.code), r.error) for r in df.collect()), key=str)


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_like_plain_rounds(spark, spread):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    data = centres[rng.integers(0, 6, 260)] + rng.normal(scale=spread, size=(260, 8))
    rows = [(int(i), v.tolist()) for i, v in enumerate(data.astype(np.float32))]
    settings = vc.Settings(entries=12)
    df, books = vc.compress(frame(spark, rows), settings)
    expected, wanted = plain(rows, entries=12)
    assert books.tolist() == wanted
    assert coded(df) == sorted(expected, key=str)


def test_ties_and_repeated_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i % 70, (rng.integers(-2, 3, 8) / 1024).tolist()) for i in range(210)]
    rows += [(None, [0.0] * 8), (200, rows[0][1]), (200, rows[0][1])]
    df, books = vc.compress(frame(spark, rows), vc.Settings(entries=9))
    expected, wanted = plain(rows, entries=9)
    assert books.tolist() == wanted and coded(df) == sorted(expected, key=str)


@pytest.mark.parametrize("size", [3.0, 200_000.0])
def test_balls_are_exact(size):
    rng = np.random.default_rng(7)
    x = np.floor(1024 * rng.normal(scale=size / 4, size=(700, 4))).clip(-(2**28) + 1, 2**28 - 1).astype(np.int64)
    entries = x[:60].copy()
    entries[7] = entries[3]
    kind = vc.exact_type(x, entries)
    assert kind == (np.float64 if size == 3.0 else np.int64)
    for home in (vc.nearest(x, entries)[0], rng.integers(0, 60, 700)):
        moved = entries + rng.integers(-40, 40, entries.shape)
        code, far = vc.nearest_in_balls(x.astype(kind), moved.astype(kind), home)
        every = ((x[:, None, :] - moved[None, :, :]) ** 2).sum(axis=2)
        assert (code == every.argmin(axis=1)).all() and (far.astype(np.int64) == every.min(axis=1)).all()


def test_rows_that_take_no_part(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(5, [1.0, 2.0, 3.0, 4.0]), (1, [0.0, 0.0, 0.0, -0.0001]), (2, None), (3, [1.0, None, 1.0, 1.0])]
    rows += [(4, [nan, 1.0, 1.0, 1.0]), (6, [inf, 1.0, 1.0, 1.0]), (7, []), (8, [1.0] * 8), (9, [3e5, 0.0, 0.0, 0.0]), (0, [2.0**17] * 4)]
    df, books = vc.compress(frame(spark, rows))
    kept = [r for r in rows if r[0] in (0, 1, 5)]
    expected, wanted = plain(kept)
    assert books.tolist() == wanted and coded(df) == sorted(expected, key=str)


def test_empty_and_lengths_that_do_not_divide(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0, 3.0])], [(None, [1.0] * 4)]):
        df, books = vc.compress(frame(spark, rows))
        assert df.collect() == [] and books.size == 0
    assert vc.books_digest(books) == vc.hashlib.sha256(b"").hexdigest()
