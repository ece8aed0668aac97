import math
from collections import Counter

import numpy as np
from conftest import MEDIUM, SMALL

from salesengine.llm import quality_model, queries
from salesengine.llm.common import table


def test_posteriors_find_the_labellers():
    rng = np.random.default_rng(0)
    n, counts = 20_000, Counter()
    good = rng.random(n) < 0.85
    kind = rng.integers(0, 3, n)  # each kind of bad text is known to one labeller or two
    for g, k in zip(good, kind):
        fires = [not g and (k == i or k == (i + 1) % 3) and rng.random() < 0.9 for i in range(3)]
        counts["".join("-" if f else "+" for f in fires)] += 1
    labels = quality_model.estimate(counts, labellers=3)
    chance = {p: labels.good(p) for p in counts}
    assert chance["+++"] > 0.95 and max(v for p, v in chance.items() if "-" in p) < 0.5
    assert abs(labels.share[0] - 0.85) < 0.02


def plain_estimate(counts, labellers, rounds):
    """The same with Python's loops, and no early end."""
    classes = range(labellers + 1)
    belief = {}
    for p in counts:
        bad = [v == "-" for v in p]
        belief[p] = [0.1] + [0.9 * b / sum(bad) for b in bad] if any(bad) else [0.9] + [0.1 / labellers] * labellers
    for _ in range(rounds):
        share = [0.5 + sum(counts[p] * belief[p][c] for p in counts) for c in classes]
        share = [s / sum(share) for s in share]
        rate = {}
        for c in classes:
            for i in range(labellers):
                minus, plus = (0.2, 99.8) if c == 0 else (0.5, 0.5)
                minus += sum(counts[p] * belief[p][c] for p in counts if p[i] == "-")
                plus += sum(counts[p] * belief[p][c] for p in counts if p[i] == "+")
                rate[c, i] = {"-": minus / (minus + plus), "+": plus / (minus + plus), "0": 1.0}
        for p in counts:
            odds = [share[c] * math.prod(rate[c, i][v] for i, v in enumerate(p)) for c in classes]
            belief[p] = [o / sum(odds) for o in odds]
    return share, rate


def test_like_plain_rounds():
    rng = np.random.default_rng(2)
    counts = {"".join(rng.choice(list("-0+"), 4, p=[0.2, 0.2, 0.6])): int(rng.integers(1, 500)) for _ in range(40)}
    labels = quality_model.estimate(counts, labellers=4, rounds=30)
    share, rate = plain_estimate(counts, 4, 30)
    assert np.allclose(labels.share, share)
    for (c, i), r in rate.items():
        assert np.allclose(labels.rates[c, i], [r["-"], r["+"]])


def test_counts_decide_as_the_corpus_grows():
    """Where there are many texts the rates are what the counts and beliefs say, and no prior."""
    rng = np.random.default_rng(1)
    n = 2_000_000
    good, kind = rng.random(n) < 0.9, rng.integers(0, 3, n)
    # the first two labellers call 2 of 100 good texts bad, and do so together
    slip = rng.random(n) < 0.02
    fires = np.stack([np.where(good, slip & (i < 2), (kind != i) & (rng.random(n) < 0.9)) for i in range(3)])
    counts = Counter(map("".join, np.where(fires.T, "-", "+").tolist()))
    labels = quality_model.estimate(counts, labellers=3)
    belief = {p: labels.good(p) for p in counts}
    for i in range(3):
        called = sum(c * belief[p] for p, c in counts.items() if p[i] == "-")
        assert abs(called / sum(c * belief[p] for p, c in counts.items()) - labels.rates[0, i, 0]) < 1e-3


def test_votes_not_seen_before(spark):
    docs = spark.createDataFrame([(i, "the cat sat on the mat and looked out of the window again " * 3) for i in range(40)], "doc_id long, text string")
    other = spark.createDataFrame([(1, "### *** $$$ ### ***  buy buy buy buy " * 9), (2, "a"), (3, "BUY NOW!! " * 30)], "doc_id long, text string")
    for table_ in (docs, docs.limit(0)):
        out = quality_model.score(other, *quality_model.train(table_)).collect()
        assert len(out) == 3 and all(0 <= r.posterior <= 1 for r in out)
        assert min(r.posterior for r in out if "-" in r.votes) < 0.5


def test_held_out_labels(spark):
    """Labels are never seen by the model: all of them are held out."""
    out = queries.op7_quality_model(spark, MEDIUM)
    both = out.join(table(spark, MEDIUM, "labels").dropDuplicates(["doc_id"]), "doc_id").collect()
    good, bad = [r.kept for r in both if r.quality == 1], [r.kept for r in both if r.quality == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)
    assert all(r.kept == (r.score >= quality_model.KEPT) and 0 <= r.posterior <= 1 for r in both)


def test_votes_like_the_labellers(spark):
    docs = {r.doc_id: r.text for r in table(spark, SMALL, "documents").collect()}
    out = queries.op7_quality_model(spark, SMALL).collect()
    assert len(out) == len(docs)
    for row in out:
        assert row.votes == quality_model.votes(quality_model.Text(docs[row.doc_id]))


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b c"), (None, "a b c"), (3, "x" * 400_000), (4, "w " * 100_000), (4, "w " * 100_000)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, votes int, kept string")
    model, chance = quality_model.train(docs)
    out = quality_model.score(docs, model, chance).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    empty = docs.limit(0)
    assert quality_model.score(empty, *quality_model.train(empty)).collect() == []


def test_scorer_matches_its_fit():
    good = ["the cat sat on the mat and looked out of the window again"] * 30
    bad = ["### *** $$$ ### *** buy buy buy buy buy buy"] * 30
    labels = np.array([0.95] * 30 + [0.02] * 30)
    scorer = quality_model.Scorer(quality_model.fit(good + bad, labels, quality_model.Settings()))
    assert scorer.score(good[0].encode().split()) > 0.8 > 0.2 > scorer.score(bad[0].encode().split())
