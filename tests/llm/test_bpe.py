import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from conftest import SMALL

from salesengine.llm import bpe, queries
from salesengine.llm.common import table

PATH = queries.tokenizer_path()
PIECES = ["a", "B", "é", "é", "J̌", "̌", " ", "  ", "\n", "\t", "<|endoftext|>", "<|ENDOFTEXT|>", "<|"]
PIECES += ["'s", "'S", "1", "23", ",", ".", "!!", "ß", "İ", "\x1c", "\x85", "\xa0", "中", "😀", "it's", "The", "K"]


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(PATH)


def odd_texts():
    rng = random.Random(1)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 2_000))) for _ in range(100)]
    texts += ["", " ", "x" * 40_000, "ab" * 20_000 + " c", "é" * 30_000, "\n" * 9_999]
    return texts


def test_cuts_are_by_content():
    rng = random.Random(2)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(20_000)).encode()
    one, two = b"left " * 50 + shared, b"another beginning " * 99 + shared
    chunks = [{d[a:b] for a, b in zip(bpe.cuts(d), bpe.cuts(d)[1:])} for d in (one, two)]
    assert sum(map(len, chunks[0] & chunks[1])) > 0.8 * len(shared)
    for text in odd_texts():
        data = text.encode()
        bounds = bpe.cuts(data)
        assert bounds[0] == 0 and bounds[-1] == len(data) and bounds == sorted(set(bounds))
        for a, b in zip(bounds, bounds[1:]):
            assert b - a <= bpe.MOST
            data[a:b].decode()


def test_whole_texts_from_chunks(encoder):
    texts = [t.encode() for t in odd_texts()]
    known = []
    for data in texts:
        bounds = bpe.cuts(data)
        inner = {i: bpe.core(data[a:b]) for i, (a, b) in enumerate(zip(bounds, bounds[1:])) if i % 2}
        encoder.learn([words for words in inner.values() if words])
        known.append({i: encoder.ids(words) for i, words in inner.items() if words is not None})
    want = encoder.library(texts)
    assert bpe.encode_texts(encoder, texts, known) == want
    assert bpe.encode_texts(encoder, texts, [{}] * len(texts)) == want


def test_wrong_ids_at_a_join_are_repaired(encoder):
    """A word remembered wrongly next to a join is found, and the text encoded whole."""
    data = " ".join(f"word{i} thing" for i in range(400)).encode()
    place = bpe.cuts(data)[1]
    word = bpe.join_window(data, place)[0]
    encoder.learn([[word]])
    right, encoder.memory[word] = encoder.memory[word], b"\0\0\0\0"
    try:
        assert bpe.encode_texts(encoder, [data], [{}]) == encoder.library([data])
    finally:
        encoder.memory[word] = right


def check(rows, docs):
    encoder = bpe.Encoder(PATH)
    want = sorted(
        (str(i), ids) for (i, _), ids in zip(docs, encoder.library([(t or "").encode() for _, t in docs]))
    )
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in rows) == want
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert r.decoded == encoder.tokenizer.decode(ids, skip_special_tokens=False)


def test_operator(spark):
    rng = random.Random(7)
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(2_000))
    docs = list(enumerate(odd_texts())) + [(500, None), (None, passage), (None, passage), (None, None)]
    docs += [(600 + i, "start %d " % i + passage) for i in range(5)] + [(600, "start 0 " + passage)]
    df = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in docs], "doc_id long, text string, row int, ids int, data string")
    out = bpe.decode(bpe.encode(df, PATH), PATH)
    assert out.columns == ["doc_id", "ids", "decoded"]
    check(out.collect(), docs)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(df, PATH), PATH).collect() == []


def test_query_like_the_library(spark):
    docs = table(spark, SMALL, "documents").collect()
    encoder = bpe.Encoder(PATH)
    want = {}
    for doc, ids in zip(docs, encoder.library([d.text.encode() for d in docs])):
        text = encoder.tokenizer.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
        want[doc.doc_id] = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    out = queries.op5_bpe(spark, SMALL).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out} == want and len(out) == len(docs)


def test_tokenizers_of_another_kind_are_refused(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    with pytest.raises(ValueError):
        bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))


def test_texts_are_shuffled_once(spark):
    """Texts that give chunks and texts that take them come from one shuffle."""
    passage = " ".join(f"word{i}" for i in range(2_000))
    docs = spark.createDataFrame([(i, f"{i} {passage} {i}") for i in range(6)], "doc_id long, text string")
    out = bpe.encode(docs, queries.tokenizer_path())
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan


def test_decoded_in_the_same_pass(spark):
    docs = table(spark, SMALL, "documents")
    both = bpe.encode(docs, PATH, decoded_col="text").collect()
    apart = bpe.decode(bpe.encode(docs, PATH), PATH, text_col="text").collect()
    assert sorted((r.doc_id, r.ids, r.text) for r in both) == sorted((r.doc_id, r.ids, r.text) for r in apart)


def test_slices_of_bounded_size():
    data = [None, b"a" * 50, b"", b"b" * 30, b"c" * 200, None, b"d" * 90]
    batch = bpe.pa.RecordBatch.from_arrays([bpe.pa.array(data, bpe.pa.binary())], ["data"])
    parts = [p.column(0).to_pylist() for p in bpe.light_slices(iter([batch]), "data", 4, 100)]
    assert [x for p in parts for x in p] == data
    assert all(len(p) <= 4 and (sum(len(x or b"") for x in p) <= 100 or sum(x not in (None, b"") for x in p) == 1) for p in parts)
