import numpy as np
import pytest
from conftest import MEDIUM
from pyspark.sql import functions as F

from salesengine.llm import graph_ann, queries
from salesengine.llm.common import table

VECTORS = "vec_id long, embedding array<float>, point int, rank string"


def brute(ids, vectors, query, k):
    scores = (vectors * vectors[query]).sum(axis=1)
    order = [i for i in np.lexsort((ids, -scores)) if i != query][:k]
    return [(int(ids[i]), float(scores[i])) for i in order]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], VECTORS)


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r["rank"]
    return out


@pytest.mark.parametrize("norms", [False, True])
def test_recall(spark, norms):
    rng = np.random.default_rng(0)
    data = rng.normal(size=(3_000, 24)).astype(np.float32)
    if norms:
        data *= rng.lognormal(sigma=0.5, size=(3_000, 1)).astype(np.float32)
    settings = graph_ann.Settings(shard_rows=1_000, query_block=40)
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(data)])
    out = answers(graph_ann.search(df, F.col("vec_id") % 20 == 0, k=10, settings=settings))
    assert sorted(out) == list(range(0, 3_000, 20))
    hits = [len({i for i, _ in brute(np.arange(3_000), data.astype(float), q, 10)} & {i for i, _ in found}) for q, found in out.items()]
    assert np.mean(hits) >= 9
    for q, found in out.items():
        assert np.allclose([s for _, s in found], [(data[i].astype(float) * data[q].astype(float)).sum() for i, _ in found], rtol=1e-12)
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)


def recall(spark, data, k, settings=graph_ann.Settings(), every=20):
    """Mean and least recall over the queries, whose scores must be right."""
    n = len(data)
    df = spark.createDataFrame([(i, v.tolist(), 1, "x") for i, v in enumerate(data)], VECTORS)
    out = answers(graph_ann.search(df, F.col("vec_id") % every == 0, k=k, settings=settings))
    assert sorted(out) == list(range(0, n, every)) and all(len(f) == k for f in out.values())
    exact = data.astype(float)
    hits = [len({i for i, _ in brute(np.arange(n), exact, q, k)} & {i for i, _ in found}) / k for q, found in out.items()]
    return np.mean(hits), min(hits)


@pytest.mark.parametrize("sigma", [0.0, 0.5, 1.0])
def test_recall_on_clusters_of_unequal_length(spark, sigma):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(200, 32))
    data = centres[rng.integers(0, 200, 6_000)] + rng.normal(scale=0.1, size=(6_000, 32))
    data = data / np.linalg.norm(data, axis=1, keepdims=True) * rng.lognormal(sigma=sigma, size=(6_000, 1))
    mean, least = recall(spark, data.astype(np.float32), 20)
    assert mean >= 0.95 and least >= 0.6


def test_recall_over_several_shards_and_blocks(spark):
    rng = np.random.default_rng(7)
    data = rng.normal(size=(4_000, 16)) * rng.lognormal(sigma=0.3, size=(4_000, 1))
    mean, _ = recall(spark, data.astype(np.float32), 10, graph_ann.Settings(shard_rows=400, query_block=50))
    assert mean >= 0.9


def test_recall_of_the_query(spark):
    rows = table(spark, MEDIUM, "embeddings").collect()
    ids, data = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    out = answers(queries.op10_nearest(spark, MEDIUM))
    place = {int(v): i for i, v in enumerate(ids)}
    assert sorted(out) == sorted(int(i) for i in ids if i % 20 == 0)
    hits = [len({i for i, _ in brute(ids, data, place[q], 20)} & {i for i, _ in found}) / 20 for q, found in out.items()]
    assert np.mean(hits) >= 0.9 and all(len(found) == 20 for found in out.values())


def test_a_vector_that_many_share(spark):
    rng = np.random.default_rng(1)
    data = rng.integers(-3, 4, (300, 6)).astype(np.float32)
    data[np.abs(data).sum(axis=1) == 0, 0] = 1
    data[100:220] = data[100]
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(data)])
    out = answers(graph_ann.search(df, F.col("vec_id") % 10 == 0, k=20))
    for q, found in out.items():
        assert found == brute(np.arange(300), data.astype(float), q, 20)


def test_rows_that_take_no_part(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0])]
    rows += [(7, []), (None, [1.0, 1.0]), (8, [1.0]), (10, [3.0]), (1, [2.0, 1.0]), (12, [-1.0, -1.0])]
    out = answers(graph_ann.search(frame(spark, rows), F.col("vec_id") >= 0, k=3))
    assert out == {
        0: [(1, 4.0), (12, -3.0)],
        1: [(0, 4.0), (12, -3.0)],
        12: [(0, -3.0), (1, -3.0)],
        8: [(10, 3.0)],
        10: [(8, 3.0)],
    }


def test_empty_and_alone(spark):
    assert graph_ann.search(frame(spark, []), F.col("vec_id") >= 0).collect() == []
    assert graph_ann.search(frame(spark, [(1, [1.0])]), F.col("vec_id") >= 0).collect() == []


def test_edges_are_diverse():
    data = graph_ann.equal_length(np.random.default_rng(2).normal(size=(500, 8)).astype(np.float32))
    of = np.arange(50)
    candidates = np.tile(np.arange(500), (50, 1))
    kept = graph_ann.prune(data, of, candidates, 12, 1.2)
    for point, row in zip(of, kept):
        row = row[row >= 0]
        assert len(set(row.tolist())) == len(row) and point not in row
        far = ((data[row] - data[point]) ** 2).sum(axis=1)
        assert (np.diff(far) >= -1e-4).all()
        for i, b in enumerate(row):
            between = ((data[row[:i]] - data[b]) ** 2).sum(axis=1)
            assert (1.2**2 * between > far[i] - 1e-3).all()
