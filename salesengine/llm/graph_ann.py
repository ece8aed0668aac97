"""Approximate nearest neighbours by a robust-pruned directed graph in every shard.

Vectors get one more component that makes them equally long, after which the largest
inner product is the nearest point. A shard's graph starts at random; greedy searches
for its own points propose neighbours, and pruning keeps those that no kept neighbour
is nearer to by the factor ``alpha``, so that edges are diverse; edges back are added
and pruned alike. A query runs a beam search in every shard. Found vectors are scored
again in double precision on the original components.

Equal vectors are one point of the graph, with the smallest ids that an answer can
need, so a vector that a third of all rows share weighs no more than any other.
Points are dealt to bands of like length first, so that the added component stays small
beside the others, and within a band by a hash to shards that hold ``shard_rows`` points
or fewer on average. The graph is a written table, and blocks of queries meet the graphs
of the shards. The longest bands are searched first. A shard whose longest vector could not
reach a query's last answer so far, even in the query's own direction, is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from salesengine.llm.common import stored


@dataclass(frozen=True)
class Settings:
    degree: int = 32
    build_beam: int = 64
    search_beam: int = 128
    alpha: float = 1.2
    shard_rows: int = 8_192
    query_block: int = 32_768
    band: float = 1.25
    batch: int = 256
    at_once: int = 4
    seed: int = 5


def points(vectors: DataFrame, copies: int, id_col: str, vector_col: str) -> DataFrame:
    """(point, embedding, ids): distinct usable vectors and their smallest ids, at most ``copies``.

    The point is named by its smallest id. Null ids, null, empty and zero vectors and
    those with a null or non-finite component are left out; of rows that share an id
    the smallest vector counts.
    """
    usable = _usable(vectors, id_col, vector_col)
    rank = F.row_number().over(W.partitionBy("embedding").orderBy("id"))
    first = usable.withColumn("rank", rank).where(F.col("rank") <= copies)
    return first.groupBy("embedding").agg(
        F.min("id").alias("point"), F.array_sort(F.collect_list("id")).alias("ids")
    )


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    def bad(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    v = F.col(vector_col)
    fine = F.col(id_col).isNotNull() & v.isNotNull() & ~F.coalesce(F.exists(v, bad), F.lit(True))
    return (
        vectors.where(fine & F.exists(v, lambda x: x != 0))
        .groupBy(F.col(id_col).cast("long").alias("id"))
        .agg(F.min(v).alias("embedding"))
    )


def equal_length(vectors: np.ndarray) -> np.ndarray:
    """One more component, so that all are as long as the longest."""
    squares = (vectors.astype(float) ** 2).sum(axis=1)
    rest = np.sqrt(np.maximum(squares.max() - squares, 0))
    return np.hstack([vectors, rest[:, None]]).astype(np.float32)


def beam_search(
    data: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, beam: int, at_once: int
) -> tuple[np.ndarray, np.ndarray]:
    """Points found, best first, and their inner products; -1 where there are fewer than the beam."""
    count, rows = len(queries), np.arange(len(queries))[:, None]
    seen = np.zeros((count, len(data) + 1), bool)  # the last column is for -1, no point
    owner = np.zeros((count, len(data) + 1), np.int16)
    ids = np.full((count, beam), -1)
    near = np.full((count, beam), -np.inf, np.float32)
    done = np.ones((count, beam), bool)
    ids[:, 0], near[:, 0], done[:, 0] = entry, queries @ data[entry], False
    seen[:, entry] = True
    while True:
        waiting = ~done
        chosen = waiting & (np.cumsum(waiting, axis=1) <= at_once)
        active = np.flatnonzero(chosen.any(axis=1))
        if not len(active):
            return ids, near
        done |= chosen
        order = np.argsort(~chosen[active], axis=1, kind="stable")[:, :at_once]
        picked = np.take_along_axis(ids[active], order, axis=1)
        picked[~np.take_along_axis(chosen[active], order, axis=1)] = -1
        next_ids = graph[picked].reshape(len(active), -1)
        next_ids[np.repeat(picked < 0, graph.shape[1], axis=1)] = -1
        here = active[:, None]
        places = np.arange(next_ids.shape[1], dtype=np.int16)[None, :]
        owner[here, next_ids] = places  # of points named twice one place stays
        fresh = (next_ids >= 0) & ~seen[here, next_ids] & (owner[here, next_ids] == places)
        r, c = np.nonzero(fresh)
        found = next_ids[r, c]
        seen[active[r], found] = True
        scores = np.full(next_ids.shape, -np.inf, np.float32)
        scores[r, c] = np.einsum("ij,ij->i", data[found], queries[active[r]])
        all_ids = np.concatenate([ids[active], np.where(fresh, next_ids, -1)], axis=1)
        all_near = np.concatenate([near[active], scores], axis=1)
        all_done = np.concatenate([done[active], ~fresh], axis=1)
        best = np.argsort(-all_near, axis=1, kind="stable")[:, :beam]
        ids[active] = np.take_along_axis(all_ids, best, axis=1)
        near[active] = np.take_along_axis(all_near, best, axis=1)
        done[active] = np.take_along_axis(all_done, best, axis=1)


def prune(
    data: np.ndarray, of: np.ndarray, candidates: np.ndarray, degree: int, alpha: float
) -> np.ndarray:
    """Diverse neighbours of the points ``of`` among their candidates, -1 where there are fewer."""
    twice = 2 * float((data[0] ** 2).sum())
    invalid = (candidates < 0) | (candidates == of[:, None])
    vectors = data[candidates]
    to_point = twice - 2 * np.einsum("ijk,ik->ij", vectors, data[of])
    between = twice - 2 * vectors @ vectors.transpose(0, 2, 1)
    alive_distance = np.where(invalid, np.inf, to_point)
    rows = np.arange(len(of))
    out = np.full((len(of), degree), -1)
    for i in range(degree):
        best = alive_distance.argmin(axis=1)
        left = np.isfinite(alive_distance[rows, best])
        if not left.any():
            break
        out[left, i] = candidates[rows, best][left]
        covered = alpha**2 * between[rows, best] <= to_point
        alive_distance[covered & left[:, None]] = np.inf
        alive_distance[rows, best] = np.inf
        same = candidates == candidates[rows, best][:, None]
        alive_distance[same & left[:, None]] = np.inf
    return out


def build(vectors: np.ndarray, settings: Settings) -> tuple[np.ndarray, int]:
    """Neighbours of every point, -1 where there are fewer, and the point where searches begin."""
    n = len(vectors)
    data = equal_length(vectors)
    entry = int((data @ data.mean(axis=0)).argmax())
    rng = np.random.default_rng(settings.seed)
    graph = np.full((n, settings.degree), -1)
    if n > 1:
        some = min(settings.degree // 2, n - 1)
        graph[:, :some] = (np.arange(n)[:, None] + rng.integers(1, n, (n, some))) % n
    order = rng.permutation(n)
    for start in range(0, n, settings.batch):
        batch = order[start : start + settings.batch]
        found, _ = beam_search(data, graph, entry, data[batch], settings.build_beam, settings.at_once)
        graph[batch] = prune(
            data, batch, np.hstack([found, graph[batch]]), settings.degree, settings.alpha
        )
        sources = np.repeat(batch, settings.degree)
        targets = graph[batch].ravel()
        sources, targets = sources[targets >= 0], targets[targets >= 0]
        by = np.argsort(targets, kind="stable")
        sources, targets = sources[by], targets[by]
        firsts = np.flatnonzero(np.diff(targets, prepend=-1))
        place = np.arange(len(targets)) - np.repeat(firsts, np.diff(np.append(firsts, len(targets))))
        for low in range(0, int(place.max(initial=-1)) + 1, settings.degree):
            part = (place >= low) & (place < low + settings.degree)
            reached, number = np.unique(targets[part], return_inverse=True)
            added = np.full((len(reached), settings.degree), -1)
            added[number, place[part] - low] = sources[part]
            for at in range(0, len(reached), settings.batch):
                some_of = reached[at : at + settings.batch]
                both = np.hstack([graph[some_of], added[at : at + settings.batch]])
                graph[some_of] = _with(data, some_of, both, settings)
    return graph, entry


def _with(data: np.ndarray, of: np.ndarray, both: np.ndarray, settings: Settings) -> np.ndarray:
    """The neighbours as they are where they fit the degree, else pruned."""
    both = np.sort(both, axis=1)[:, ::-1]
    both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
    both = np.sort(both, axis=1)[:, ::-1].copy()
    out = both[:, : settings.degree].copy()
    full = np.flatnonzero(both[:, settings.degree] >= 0) if both.shape[1] > settings.degree else []
    if len(full):
        out[full] = prune(data, of[full], both[full], settings.degree, settings.alpha)
    return out


def _length(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def build_index(
    vectors: DataFrame,
    copies: int,
    settings: Settings = Settings(),
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> tuple[DataFrame, DataFrame]:
    """Two written tables: all points with their graphs, and the bands.

    (shard, place, point, ids, embedding, neighbours, entry) and (dims, band, parts, top,
    before): the shards of a band, its longest vector, and the points of longer bands.
    Shards are named by the number of components, as vectors with different ones have no
    inner product, the band, and a part of it. A band's vectors differ in length by the
    factor ``settings.band`` at most; unit vectors lie in the middle of theirs.
    """
    all_points = stored(
        points(vectors, copies, id_col, vector_col)
        .withColumn("dims", F.size("embedding"))
        .withColumn("length", _length(F.col("embedding")))
        .withColumn("band", F.round(F.log("length") / math.log(settings.band)).cast("int"))
    )
    longer = W.partitionBy("dims").orderBy(F.desc("band")).rowsBetween(W.unboundedPreceding, -1)
    bands = stored(
        all_points.groupBy("dims", "band")
        .agg(F.count("*").alias("n"), F.max("length").alias("top"))
        # one row for each band, of which the range of doubles allows some thousands
        .select(
            "dims",
            "band",
            F.ceil(F.col("n") / settings.shard_rows).cast("int").alias("parts"),
            "top",
            F.coalesce(F.sum("n").over(longer), F.lit(0)).alias("before"),
        )
    )
    part = F.pmod(F.xxhash64("embedding"), F.col("parts"))
    dealt = all_points.join(bands.select("dims", "band", "parts"), ["dims", "band"]).select(
        _shard("dims", "band", part), "point", "ids", "embedding"
    )

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values("point", ignore_index=True)
        data = np.stack(shard["embedding"].to_numpy())
        graph, entry = build(data, settings)
        shard["place"] = np.arange(len(shard))
        shard["neighbours"] = list(graph.astype(np.int32))
        shard["entry"] = entry
        return shard

    kind = dict(all_points.dtypes)["embedding"]
    index = dealt.groupBy("shard").applyInPandas(
        run,
        f"shard string, point long, ids array<long>, embedding {kind}, place int, "
        "neighbours array<int>, entry int",
    )
    return stored(index), bands


def _shard(dims: str, band: str, part: Column) -> Column:
    return F.concat_ws(":", dims, band, part).alias("shard")


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    settings: Settings = Settings(),
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every query among all other rows.

    Queries are the usable rows for which ``is_query`` holds, a condition on the id
    column. Ties of the score go to the smaller id; there are fewer than k rows only
    if there are fewer candidates of the query's length. See ``points`` for the rows
    that take no part. Other columns are not read.
    """
    index, bands = build_index(vectors, k + 1, settings, id_col, vector_col)
    usable = _usable(vectors.where(is_query), id_col, vector_col)
    asked = stored(
        usable.join(index.select("embedding", "point"), "embedding").select(
            F.col("id").alias("query_id"), "point", "embedding"
        )
    )
    distinct = stored(
        asked.groupBy("point").agg(F.first("embedding").alias("query")).withColumn("dims", F.size("query"))
    )
    blocks = max(1, math.ceil(distinct.count() / settings.query_block))
    first = F.col("before") < settings.shard_rows
    meets = bands.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    meets = meets.select("dims", "top", first.alias("first"), _shard("dims", "band", F.col("part")))

    def run(graph: pd.DataFrame, query: pd.DataFrame) -> pd.DataFrame:
        if graph.empty or query.empty:
            return pd.DataFrame({"query": [], "point": [], "ids": [], "score": []})
        return pd.concat(found_in(graph.sort_values("place", ignore_index=True), query, k + 1, settings))

    def found(queries: DataFrame) -> DataFrame:
        """Answers of queries (shard, point, query), a block and a shard at a time."""
        in_blocks = queries.withColumn("block", F.pmod(F.xxhash64("point"), F.lit(blocks)).cast("int"))
        wanted = in_blocks.select(F.col("shard").alias("of"), F.col("block").alias("for_block")).distinct()
        graphs = index.join(wanted, F.col("shard") == F.col("of")).drop("of")
        return (
            graphs.groupBy("shard", "for_block")
            .cogroup(in_blocks.groupBy("shard", "block"))
            .applyInPandas(run, "query long, point long, ids array<long>, score double")
        )

    order = W.partitionBy("query").orderBy(F.desc("score"), "point")

    def nearest(rows: DataFrame) -> DataFrame:
        return rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)

    every = distinct.join(meets, "dims").select("shard", "point", "query", "top", "first")
    answered = nearest(found(every.where("first").select("shard", "point", "query")))
    if bands.where(~first).limit(1).count():
        answered = stored(answered)
        last = answered.where(F.col("n") == k + 1).select(F.col("query").alias("of"), F.col("score").alias("last"))
        reach = _length(F.col("query")) * F.col("top") * (1 + 1e-9)
        rest = every.where("NOT first").join(last, F.col("point") == F.col("of"), "left")
        rest = rest.where(F.col("last").isNull() | (reach >= F.col("last")))
        answered = nearest(answered.drop("n").unionByName(found(rest.select("shard", "point", "query"))))
    answers = answered.select("query", "score", F.explode("ids").alias("vec_id"))
    at = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best = answers.withColumn("n", F.row_number().over(at)).where(F.col("n") <= k + 1)
    lists = best.groupBy("query").agg(
        F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("best")
    )
    own = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    return (
        asked.join(lists, F.col("point") == F.col("query"))
        .select("query_id", F.posexplode(own).alias("rank", "b"))
        .select("query_id", (F.col("rank") + 1).alias("rank"), "b.vec_id", "b.score")
    )


def found_in(
    graph: pd.DataFrame, query: pd.DataFrame, wanted: int, settings: Settings
) -> Iterator[pd.DataFrame]:
    """The best points of one shard for a block of queries, scored in double precision."""
    vectors = np.stack(graph["embedding"].to_numpy())
    exact = vectors.astype(float)
    data = equal_length(vectors)
    neighbours = np.stack(graph["neighbours"].to_numpy()).astype(int)
    asked = np.stack(query["query"].to_numpy()).astype(float)
    names, ids, points_ = query["point"].to_numpy(), graph["ids"].to_numpy(), graph["point"].to_numpy()
    beam = max(settings.search_beam, 2 * wanted)
    for start in range(0, len(asked), settings.batch):
        part = asked[start : start + settings.batch]
        wide = np.hstack([part, np.zeros((len(part), 1))]).astype(np.float32)
        found, _ = beam_search(data, neighbours, int(graph["entry"][0]), wide, beam, settings.at_once)
        scores = np.where(found >= 0, (exact[found] * part[:, None, :]).sum(axis=2), -np.inf)
        best = np.lexsort((points_[found], -scores), axis=1)[:, :wanted]
        rows, _ = np.nonzero(np.take_along_axis(found, best, axis=1) >= 0)
        place = np.take_along_axis(found, best, axis=1)
        kept = place >= 0
        yield pd.DataFrame(
            {
                "query": names[start + rows],
                "point": points_[place[kept]],
                "ids": ids[place[kept]],
                "score": np.take_along_axis(scores, best, axis=1)[kept],
            }
        )
