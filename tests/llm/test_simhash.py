import random
import re

import numpy as np
import pytest
import xxhash
from conftest import SMALL

from salesengine.llm import queries, simhash
from salesengine.llm.common import table

DOCS = "doc_id long, text string, fp string, keeper long"


def plain_fingerprint(text, size=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]
    shingles = shingles or ([" ".join(words)] if words else [])
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def plain_components(rows, radius):
    """Smallest id reachable, by comparing all pairs."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= radius:
                root[find(i)] = find(j)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            groups[find(i)] = min(groups.get(find(i), doc), doc)
    return [groups.get(find(i)) for i in range(len(rows))]


def test_fingerprints(spark):
    texts = [None, "", " \t\n", "One", "a b", "a B c", "x " * 70_000, "Ünï çode\x85é words"]
    texts += ["the cat sat on the mat the cat sat " * 5]
    assert [simhash.fingerprint(t or "", 3) % 2**64 for t in texts] == list(map(plain_fingerprint, texts))


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4, 5])
def test_links_like_all_pairs(spark, radius):
    rng = random.Random(radius)
    centres = [rng.getrandbits(64) for _ in range(12)]
    values = set(centres)
    for c in centres:
        for _ in range(25):
            flips = rng.randint(1, 6)
            values.add(c ^ sum(1 << b for b in rng.sample(range(64), flips)))
    rows = [(i, v) for i, v in enumerate(sorted(values))]
    signed = [(int(np.uint64(v).astype(np.int64)),) for _, v in rows]
    fps = spark.createDataFrame(signed, "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(fps, radius)).collect()}
    mine = [roots.get(s, s) for (s,) in signed]
    theirs = plain_components(rows, radius)
    assert len(set(zip(mine, theirs))) == len(set(mine)) == len(set(theirs))


def test_long_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1100)]
    out = simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in out} == {
        **{i: 0 for i in range(1, 301)},
        **{i: 1000 for i in range(1001, 1100)},
    }


def test_many_in_one_run():
    rng = np.random.default_rng(0)
    centre = np.uint64(rng.integers(1 << 62))
    members = np.unique(centre ^ (np.uint64(1) << rng.integers(0, 64, 5_000).astype(np.uint64)))
    nodes, roots = simhash._links(np.append(members, centre ^ np.uint64(0b1111111)), 2)
    assert len(nodes) == len(members) - 1 and len(set(roots.tolist())) == 1


def test_nulls_repeats_and_clashing_names(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta"
    rows = [(5, base), (3, base), (3, base), (None, base), (9, None), (7, ""), (None, "only here"), (8, "q")]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], DOCS)
    out = simhash.near_duplicates(docs)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.fp, r.component_id) for r in out.collect())
    plain = plain_components([(i, plain_fingerprint(t)) for i, t in rows], 3)
    signed = [int(np.uint64(plain_fingerprint(t)).astype(np.int64)) for _, t in rows]
    want = [(i is None, i or 0, f, c) for (i, _), f, c in zip(rows, signed, plain)]
    assert got == sorted(want, key=lambda r: (r[0], r[1], r[2]))
    kept = simhash.keep_first(docs, out)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [3, 7, 8] and ids.count(None) == 2


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    out = simhash.near_duplicates(docs)
    assert out.collect() == [] and simhash.keep_first(docs, out).collect() == []


def test_query_like_all_pairs(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").collect()]
    prints = [(i, plain_fingerprint(t)) for i, t in docs]
    want = {i: (f"{p:016x}", c) for (i, p), c in zip(prints, plain_components(prints, 3))}
    out = queries.op2_simhash(spark, SMALL).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in out} == want and len(out) == len(docs)


def test_one_row_of_each_component_where_ids_repeat(spark):
    one, two = "alpha beta gamma delta epsilon zeta", "the cat sat on the mat and slept"
    texts = [(1, one), (1, two), (1, two), (2, two), (2, "q r s t u v w x"), (3, one)]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in texts], DOCS)
    kept = simhash.keep_first(docs, simhash.near_duplicates(docs)).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, one), (1, two), (2, "q r s t u v w x")]
