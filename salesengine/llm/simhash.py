"""SimHash near-duplicates: fingerprints of word shingles, linked within a few bits.

Meet-in-the-middle ball hashing. The 64 bits are dealt to three or more blocks. Two
fingerprints that differ in at most ``radius`` bits differ in a bit of some block,
or not at all, so that without that block they differ in at most ``radius - 1``
bits and the balls of half that radius around both meet. Every fingerprint emits,
for each block left out, all variants of the other bits within that half; the
variants are shuffled and equal ones stand next to each other. All that meet are
verified on the whole 64 bits, so links are exact. (Whole balls of half the radius,
rounded up as they must be for 3 bits, would have 2,081 variants instead of 132.)

Only distinct fingerprints take part: copies have been merged by a pre-aggregated
group before, and meet their component again by a join on the fingerprint, whose
hot keys Spark splits. A task reads its variants as a sorted stream, keeps one run
of equal ones at a time, and returns at most one link for each member of a run.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesengine.llm.common import in_small_batches, stored, text_batches, unused

BLOCK = 65_536
SEED = 42
#: Members of a run compared in one block of pairs.
PAIR_BLOCK = 2_048


def fingerprint(text: str, shingle: int) -> int:
    """SimHash of the whole text, as a signed 64-bit number; 0 without a word."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > shingle:
        starts, ends = starts[: 1 - shingle or None], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(starts), BLOCK):
        spans = zip(starts[i : i + BLOCK].tolist(), ends[i : i + BLOCK].tolist())
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    value = np.packbits(2 * ones > len(starts), bitorder="little").view("<i8")[0]
    return int(value)


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp): one row for each row of ``docs``; a null text has no word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_batches(batches, "text"):
            values = pa.array([fingerprint(t, shingle) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("text_hash"), values], ["doc_id", "text_hash", "fp"]
            )

    source = in_small_batches(docs).select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")
    )
    return source.mapInArrow(run, "doc_id long, text_hash long, fp long")


def blocks_left_out(radius: int) -> list[list[int]]:
    """The bits left out at a time; none if equality is asked."""
    if not radius:
        return [[]]
    count = max(3, radius)
    bounds = [64 * i // count for i in range(count + 1)]
    return [list(range(a, b)) for a, b in zip(bounds, bounds[1:])]


def variants(fps: np.ndarray, left_out: list[int], half: int) -> np.ndarray:
    """(number of fps, number of variants): the other bits, with up to ``half`` of them flipped."""
    kept = [b for b in range(64) if b not in set(left_out)]
    flips = [0]
    for n in range(1, half + 1):
        flips += [sum(1 << b for b in chosen) for chosen in combinations(kept, n)]
    mask = np.uint64(sum(1 << b for b in kept))
    return (fps & mask)[:, None] ^ np.array(flips, np.uint64)[None, :]


def _links(members: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, its root) that connect what is within the radius in one run.

    Compares blocks of pairs and joins them at once, so no list of pairs is kept.
    """
    n = len(members)
    root = np.arange(n)
    for i in range(0, n, PAIR_BLOCK):
        for j in range(i, n, PAIR_BLOCK):
            near = np.bitwise_count(members[i : i + PAIR_BLOCK, None] ^ members[None, j : j + PAIR_BLOCK]) <= radius
            while True:
                # a member takes the smallest root among its neighbours until none changes
                a, b = root[i : i + PAIR_BLOCK], root[j : j + PAIR_BLOCK]
                left = np.minimum(a, np.where(near, b[None, :], n).min(axis=1))
                right = np.minimum(b, np.where(near, a[:, None], n).min(axis=0))
                if (left == a).all() and (right == b).all():
                    break
                for old, new in ((a, left), (b, right)):
                    for o, v in set(zip(old[old != new].tolist(), new[old != new].tolist())):
                        root[root == o] = np.minimum(root[root == o], v)
    moved = root != np.arange(n)
    return members[moved], members[root[moved]]


def links(fps: DataFrame, radius: int) -> DataFrame:
    """(a, b): links that connect all fingerprints within the radius of each other.

    ``fps`` has distinct values in ``fp``. Equal variants of different blocks may
    meet, too; they are verified like the others.
    """
    blocks, half = blocks_left_out(radius), max(0, radius) // 2

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for start in range(0, len(whole), 2048):
                values = whole[start : start + 2048]
                for left_out in blocks:
                    keys = variants(values, left_out, half)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(keys.ravel().view(np.int64)),
                            pa.array(np.repeat(values, keys.shape[1]).view(np.int64)),
                        ],
                        ["variant", "fp"],
                    )

    def found(variant: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        starts = np.concatenate([[0], np.flatnonzero(variant[1:] != variant[:-1]) + 1])
        sizes = np.diff(np.concatenate([starts, [len(fp)]]))
        values = fp.view(np.uint64)
        pairs = starts[sizes == 2]
        near = pairs[np.bitwise_count(values[pairs] ^ values[pairs + 1]) <= radius]
        a, b = [values[near]], [values[near + 1]]
        for at, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            more = _links(np.unique(values[at : at + size]), radius)
            a.append(more[0])
            b.append(more[1])
        edges = np.stack([np.concatenate(a), np.concatenate(b)], axis=1)
        edges = np.unique(np.sort(edges[edges[:, 0] != edges[:, 1]], axis=1), axis=0)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.ascontiguousarray(edges[:, i]).view(np.int64)) for i in (0, 1)], ["a", "b"]
        )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.empty(0, np.int64), np.empty(0, np.int64))
        for batch in batches:
            variant, fp = (
                np.concatenate([old, new.to_numpy(zero_copy_only=False)])
                for old, new in zip(held, batch.columns)
            )
            if not len(variant):
                continue
            cut = np.searchsorted(variant, variant[-1])  # the last run may go on in the next batch
            if cut:
                yield found(variant[:cut], fp[:cut])
            held = variant[cut:], fp[cut:]
        if len(held[0]):
            yield found(*held)

    emitted = fps.select("fp").mapInArrow(emit, "variant long, fp long")
    together = emitted.repartition("variant").sortWithinPartitions("variant")
    return together.mapInArrow(verify, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of the links (a, b).

    Alternates two steps until nothing changes: every node's larger neighbours are
    linked to its smallest one, then its smaller ones. Rounds grow with the
    logarithm of the longest path; the links of a round are a written table.
    """
    current = stored(edges.where("a <> b").select("a", "b").distinct())
    before = None
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least"))
        large = (
            both.join(least, "a")
            .where("b > a")
            .select(F.col("b").alias("a"), F.least("a", "least").alias("b"))
            .distinct()
        )
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        smallest = down.groupBy("a").agg(F.min("b").alias("least"))
        small = (
            down.join(smallest, "a")
            .select(F.col("b").alias("x"), "a", "least")
            .select(F.explode(F.array(F.struct("x", "least"), F.struct(F.col("a").alias("x"), "least"))).alias("e"))
            .select(F.col("e.x").alias("a"), F.col("e.least").alias("b"))
            .where("a <> b")
            .distinct()
        )
        current = stored(small)
        state = current.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        if before == state:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state


def near_duplicates(
    docs: DataFrame, shingle: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, text_hash, fp, component_id, root): one row for each row of ``docs``.

    Documents are linked if their fingerprints differ in at most ``radius`` bits;
    component_id is the smallest id that links lead to, the document's own
    included; root is a fingerprint and tells components apart whose members share
    an id. Null and empty texts have fingerprint 0, which is linked like any
    other. Rows with a null id take part and get their component; it is null if no
    member has an id. Repeated rows are kept. Other columns are not read.
    """
    prints = stored(fingerprints(docs, shingle, id_col, text_col))
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(distinct, radius))
    placed = distinct.join(roots, distinct.fp == roots.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    named = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    final = stored(placed.join(named, "root").select("fp", "component_id", "root"))
    return prints.join(final, "fp").select("doc_id", "text_hash", "fp", "component_id", "root")


def keep_first(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, that of its smallest id.

    Rows are told apart by their id and the hash of their text, as an id may stand on
    several texts; of those with the same the one with the smallest hash of all its
    columns stays. Rows without an id cannot be told apart by it and all stay.
    """
    own = [unused(docs, name) for name in ("keeper", "keeper_text", "text_hash", "row_order")]
    keeper, keeper_text, text_hash, order = own
    chosen = (
        groups.where("doc_id IS NOT NULL")
        .groupBy("root")
        .agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
        .select(F.col("first.doc_id").alias(keeper), F.col("first.text_hash").alias(keeper_text))
    )
    same = (F.col(id_col) == F.col(keeper)) & (F.col(text_hash) == F.col(keeper_text))
    hashed = docs.withColumn(text_hash, F.xxhash64(text_col))
    kept = hashed.join(chosen, same, "left_semi").withColumn(order, F.xxhash64(*docs.columns))
    # the join has dealt the rows by id and text already
    first = kept.groupBy(id_col, text_hash).agg(F.min_by(F.struct(*docs.columns), F.col(order)).alias("row"))
    return first.select("row.*").unionByName(docs.where(F.col(id_col).isNull()))
