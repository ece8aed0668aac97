import itertools
import random
import zlib

import numpy as np
import pytest
from conftest import MEDIUM, SMALL

from salesengine.llm import queries, toxicity
from salesengine.llm.common import table


def by_all_paths(emissions, start, moves):
    """Marginals and expected moves by summing over all paths of states."""
    weights = {}
    for path in itertools.product((0, 1), repeat=len(emissions)):
        w = start[path[0]] + sum(e for e, s in zip(emissions, path) if s)
        weights[path] = np.exp(w + sum(moves[a, b] for a, b in zip(path, path[1:])))
    total = sum(weights.values())
    chances = [sum(w for p, w in weights.items() if p[i]) / total for i in range(len(emissions))]
    expected = np.zeros((2, 2))
    for path, w in weights.items():
        for pair in zip(path, path[1:]):
            expected[pair] += w / total
    return chances, expected


def test_forward_backward_like_all_paths():
    rng = np.random.default_rng(1)
    lengths = np.array([3, 1, 8, 5, 8, 2])
    emissions, start, moves = rng.normal(size=lengths.sum()) * 2, rng.normal(size=2), rng.normal(size=(2, 2))
    chances, expected = toxicity.marginals(emissions, lengths, start, moves, pairs=True)
    parts = [by_all_paths(e, start, moves) for e in np.split(emissions, np.cumsum(lengths)[:-1])]
    assert np.allclose(chances, np.concatenate([p[0] for p in parts]))
    assert np.allclose(expected, sum(p[1] for p in parts))


def test_chains():
    stops = np.zeros(200, bool)
    stops[[3, 4, 150]] = True
    assert toxicity.chains(stops).tolist() == [4, 1, 64, 64, 18, 49]
    assert toxicity.chains(np.zeros(0, bool)).tolist() == []


def test_held_out_accuracy(spark):
    out = queries.op8_toxicity(spark, MEDIUM)
    both = out.join(table(spark, MEDIUM, "labels"), "doc_id").collect()
    for r in both:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    unseen = [r for r in both if r.held_out]
    # some languages have two or three toxic documents to learn from here
    assert np.mean([r.predicted == r.toxic for r in unseen]) >= 0.95
    assert not any(r.predicted for r in unseen if not r.toxic)
    assert all(r.predicted == (r.score >= 0.5) for r in both)


def test_spans_name_words(spark):
    docs = {r.doc_id: r.text for r in table(spark, SMALL, "documents").collect()}
    out = queries.op8_toxicity(spark, SMALL).collect()
    assert len(out) == len(docs)
    for row in out:
        for span in row.spans:
            word = docs[row.doc_id][span.start : span.end]
            assert word == word.strip() and len(word.split()) == 1 and 0.5 <= span.chance <= 1


@pytest.fixture(scope="module")
def marked(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("aeioulmnrst") for _ in range(5)) for _ in range(300)]
    vocabulary += ["calm", "friendly", "garden.", "creature"] * 20

    def text():
        return " ".join(rng.choice(vocabulary) for _ in range(30)) + "."

    clean = [text() for _ in range(60)]
    toxic = [f"{text()} you vile{'abcdefghij'[i % 10]} creature {text()}" for i in range(60)]
    docs = [(i, t, 1) for i, t in enumerate(clean + toxic)]
    labels = [(i, int(i >= 60)) for i in range(120)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, label int"),
        spark.createDataFrame(labels + [(None, 1), (3, None), (999, 1)], "doc_id long, toxic int"),
    )


def test_unseen_forms_and_odd_rows(spark, marked):
    model = toxicity.train(*marked)
    rows = [(1, None), (2, ""), (None, "vilezz creature"), (None, "vilezz creature"), (4, "a friendly garden."), (5, "calm " * 100_000)]
    docs = spark.createDataFrame([(i, t, 0.5, "x") for i, t in rows], "doc_id long, text string, score double, spans string")
    out = toxicity.score(docs, model).collect()
    assert len(out) == len(rows)
    by_id = {r.doc_id: r for r in out}
    assert by_id[None].score > 0.5 and by_id[None].spans[0].end == 6
    assert max(by_id[i].score for i in (1, 2, 4, 5)) < 0.5
    empty = docs.limit(0)
    assert toxicity.score(empty, model).collect() == []


def test_without_labels(spark, marked):
    docs, labels = marked
    for none in (labels.limit(0), labels.where("toxic = 0")):
        out = toxicity.score(docs, toxicity.train(docs, none)).collect()
        assert len(out) == 120 and all(0 <= r.score < 0.5 for r in out)


def test_distinct_documents_are_no_copies():
    """Texts of common pairs of words share some with many others, and most with none."""
    rng = random.Random(5)
    common = [f"w{i} v{i}" for i in range(60)]
    texts = [" ".join(rng.sample(common, 25) + [f"own{i}x{j}" for j in range(25)]).encode().split() for i in range(200)]
    assert not any(toxicity.near_copies(texts))
    changed = [[b"other", *words[1:]] for words in texts]
    assert toxicity.near_copies(texts + changed) == [False] * 200 + [True] * 200
    assert toxicity.near_copies([[], [], [b"a"], [b"b"], [b"a"]]) == [False, True, False, False, True]
    toxic = [[b"vile", *words] for words in texts[:100]]
    listed = toxicity.word_labels(toxic[:12] + texts[100:], [1] * 12 + [0] * 100, toxicity.Settings())
    assert b"=vile" in listed


def test_fitted_on_every_document(monkeypatch):
    fitted = []
    monkeypatch.setattr(toxicity, "_fit_field", lambda model, words, *rest: fitted.extend(words))
    texts = [f"w{i} " + ("vile " if i % 2 else "calm ") * 5_000 for i in range(400)]
    toxicity.fit(texts, [i % 2 for i in range(400)], toxicity.Settings())
    assert {f"w{i}".encode() for i in range(400) if i % 4} <= set(fitted) and len(fitted) == 300 * 5_001
