import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from conftest import MEDIUM

from salesengine.llm import queries
from salesengine.llm import suffix_dedup as sd
from salesengine.llm.common import table

DOCS = "doc_id long, text string, kept string, spans int"


def plain(texts, length):
    """Spans and other bytes of every text, by counting all strings."""
    data = [(t or "").encode() for t in texts]
    count = Counter(d[p : p + length] for d in data for p in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for p in range(len(d) - length + 1):
            if count[d[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        edges = np.flatnonzero(np.diff(np.array([0, *gone, 0], np.int8)))
        spans = [(int(a), int(b)) for a, b in edges.reshape(-1, 2)]
        out.append((len(d), spans, bytes(c for c, g in zip(d, gone) if not g)))
    return out


def found(spark, texts, settings):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], DOCS)
    rows = sd.remove_repeats(df, settings).collect()
    assert len(rows) == len(texts)
    return [(r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in sorted(rows, key=lambda r: r.doc_id)]


def corpus(dice, count, alphabet="abcdefgh ü"):
    """Texts of own words with passages, whole texts and halves of others in them."""
    def words(n):
        return "".join(dice.choice(alphabet) for _ in range(n))

    passages = [words(dice.randint(20, 160)) for _ in range(6)]
    texts = []
    for _ in range(count):
        parts = [words(dice.randint(0, 90)) for _ in range(dice.randint(1, 4))]
        for _ in range(dice.randint(0, 3)):
            passage = dice.choice(passages)
            low = dice.randint(0, len(passage) // 3)
            parts.insert(dice.randint(0, len(parts)), passage[low : low + dice.randint(10, 200)])
        texts.append("".join(parts))
        if texts and dice.random() < 0.15:
            texts.append(dice.choice(texts))
    return texts


@pytest.mark.parametrize("settings", [sd.Settings(40, 12), sd.Settings(40, 12, together=3, piece=100), sd.Settings(33, 33), sd.Settings(16, 8)])
def test_like_counting(spark, settings):
    texts = corpus(random.Random(settings.length + settings.together), 120)
    assert found(spark, texts, settings) == plain(texts, settings.length)


def test_periods_few_letters_and_one_hot_gram(spark):
    dice = random.Random(8)
    texts = ["a" * 500, "ab" * 90, "abc" * 70 + "x", "xy" * 30 + "a" * 39, "a" * 40]
    texts += ["".join(dice.choice("ab") for _ in range(dice.randint(10, 120))) for _ in range(40)]
    hot = "the same words everywhere, "  # more classes in one bucket than are refined together
    texts += ["".join(dice.choice("klmn") for _ in range(dice.randint(0, 30))) + hot + str(i % 17) * (i % 23) for i in range(120)]
    for settings in (sd.Settings(40, 16, together=8), sd.Settings(40, 16)):
        assert found(spark, texts, settings) == plain(texts, 40)


def test_nulls_copies_short_and_empty(spark):
    one = "".join(chr(97 + (i * i) % 23) for i in range(260))
    texts = [None, "", "short", one, one, "z" + one[:200], one[1:200], "y" + one[30:229]]
    out = found(spark, texts, sd.Settings())
    assert out == plain(texts, 200)
    assert out[3] == (260, [(0, 260)], b"") and out[5] == (201, [(1, 201)], b"z")
    assert out[6][1] == [] and out[7][1] == []
    assert found(spark, [], sd.Settings()) == []


def test_null_and_repeated_ids(spark):
    text = "".join(chr(97 + (i * i) % 23) for i in range(230))
    df = spark.createDataFrame([(None, text, "", 0), (7, text, "", 0), (7, "other", "", 0)], DOCS)
    rows = {(r.doc_id, r.n_bytes, len(r.kept)) for r in sd.remove_repeats(df).collect()}
    assert rows == {(None, 230, 0), (7, 230, 0), (7, 5, 5)}


def test_long_texts(spark):
    dice = random.Random(2)
    long = "".join(dice.choices("abcdefghijklmnop \n", k=1_500_000))
    texts = [long, "q" + long[1_000_000:1_000_300] + "r", long[600_000 : 600_000 + 199]]
    (n, spans, kept), small, none = found(spark, texts, sd.Settings())
    assert (n, spans, len(kept)) == (1_500_000, [(1_000_000, 1_000_300)], 1_499_700)
    assert small == (302, [(1, 301)], b"qr") and none[1] == []


def test_refine_compares_bytes():
    dice = random.Random(5)
    for _ in range(20):
        length, rows = 16, []
        for _ in range(60):
            n = dice.randint(1, 12)
            rows.append((dice.randint(0, 2), dice.choice([1, 1, 2]), dice.randint(n, 14), bytes(dice.choice(b"ab") for _ in range(n + length - 1))))
        count = Counter()
        for b, w, way, s in rows:
            for p in range(len(s) - length + 1):
                count[b, p - way, s[p : p + length]] += w
        wanted = [(i, p) for i, (b, _, way, s) in enumerate(rows) for p in range(len(s) - length + 1) if count[b, p - way, s[p : p + length]] > 1]
        bucket, weight, way = (np.array([r[i] for r in rows]) for i in range(3))
        own, place = sd.refine(bucket, weight, way, [r[3] for r in rows], length)
        assert list(zip(own.tolist(), place.tolist())) == wanted


def test_query_like_counting(spark):
    rows = table(spark, MEDIUM, "documents").select("doc_id", "text").collect()
    expected = {
        r.doc_id: (n, sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest())
        for r, (n, spans, kept) in zip(rows, plain([r.text for r in rows], 200))
    }
    out = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op12_repeats(spark, MEDIUM).collect()}
    assert out == expected
