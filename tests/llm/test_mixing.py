import time

import pytest
from pyspark.sql import functions as F

from salesengine.llm import mixing

DOCS = "doc_id long, source string, slot string, mix_at int"


def docs(spark, sizes):
    rows = [(1000 * s + i, name, "x", 1) for s, (name, n) in enumerate(sizes.items()) for i in range(n)]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("weights", [[1], [1, 1], [7, 3], [5, 1, 1], [8, 4, 2] + [1] * 17, [13, 11, 9, 7, 1], [97, 2, 1]])
def test_period_is_fair(spark, weights):
    sources = spark.createDataFrame([(f"s{i:02}", w) for i, w in enumerate(weights)], "source string, weight long")
    turns = mixing.period(sources).collect()
    slots = sum(weights)
    assert sorted(t.slot for t in turns) == list(range(slots))
    done = dict.fromkeys((f"s{i:02}" for i in range(len(weights))), 0)
    for t in sorted(turns, key=lambda t: t.slot):
        w = weights[int(t.source[1:])]
        assert t.turn == done[t.source] and t.slots == slots and t.weight == w
        assert t.turn * slots // w <= t.slot < -(-(t.turn + 1) * slots // w)
        done[t.source] += 1
        for name, n in done.items():
            assert abs(n - (t.slot + 1) * weights[int(name[1:])] / slots) < 1


@pytest.mark.parametrize("bucket_rows", [20_000, 10])
def test_mixed_within_a_block(spark, bucket_rows, monkeypatch):
    """At every slot every source that is not used up has its share, give or take a block."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket_rows)
    sizes, weights = {"a": 700, "b": 500, "c": 90, None: 40}, {"a": 5, "b": 4, "c": 2}
    mixed = mixing.mix(docs(spark, sizes), weights, other=1, block=4)
    assert mixed.columns == ["doc_id", "source", "mix_at", "slot", "position"]
    rows = sorted(mixed.collect(), key=lambda r: r.position)
    assert len({r.position for r in rows}) == len(rows) == sum(sizes.values())
    assert len({r.doc_id for r in rows}) == len(rows)
    taken = dict.fromkeys(sizes, 0)
    last = max(r.slot for r in rows)
    by_slot = {}
    for r in rows:
        by_slot.setdefault(r.slot, set()).add(r.source)
        assert r.position // 4 == r.slot
    for slot in range(last + 1):
        names = by_slot.get(slot, set())
        assert len(names) <= 1
        for name in names:
            taken[name] += 1
        for name, n in sizes.items():
            blocks = -(-n // 4)
            if taken[name] < blocks:
                assert abs(taken[name] - (slot + 1) * weights.get(name, 1) / 12) < 1


def test_order_is_that_of_the_hashes_whatever_the_buckets(spark, monkeypatch):
    rows = docs(spark, {"a": 400, "b": 300})
    want = {r.doc_id: r.position for r in mixing.mix(rows, {"a": 2}).collect()}
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 5)
    assert {r.doc_id: r.position for r in mixing.mix(rows, {"a": 2}).collect()} == want


def test_nulls_repeats_and_empty(spark):
    rows = [(None, "a", "x", 1)] * 3 + [(5, "a", "x", 1)] * 2 + [(6, None, None, None)]
    frame = spark.createDataFrame(rows, DOCS)
    out = mixing.mix(frame, {}, block=2).collect()
    assert sorted(r.position for r in out if r.source == "a") == [2, 3, 6, 7, 10]
    assert [(r.doc_id, r.position) for r in out if r.source is None] == [(6, 0)]
    assert mixing.in_order(frame, {}).schema == frame.schema
    assert mixing.in_order(spark.createDataFrame([], DOCS), {}).collect() == []


def test_files_hold_the_order(spark, tmp_path):
    rows = docs(spark, {"a": 200, "b": 100}).select("doc_id", "source")
    mixed = mixing.mix(rows, {"a": 2}, block=3)
    mixing.in_order(rows, {"a": 2}, block=3).write.parquet(str(tmp_path / "out"))
    read = spark.read.parquet(str(tmp_path / "out")).select("doc_id", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i"))
    order = [r.doc_id for r in sorted(read.collect(), key=lambda r: (r.f, r.i))]
    assert order == [r.doc_id for r in sorted(mixed.collect(), key=lambda r: r.position)]


def plain_period(weights):
    """Every slot to the released block with the earliest deadline, then the first source."""
    slots, done, out = sum(weights), [0] * len(weights), []
    for slot in range(slots):
        ready = [(-(-(done[i] + 1) * slots // w), i) for i, w in enumerate(weights) if done[i] * slots // w <= slot]
        i = min(ready)[1]
        out.append((i, done[i], slot))
        done[i] += 1
    return out


@pytest.mark.parametrize("weights", [[3, 3, 2, 2, 5], [8, 4, 2] + [1] * 300, [7, 1, 7, 2, 2, 2, 90], list(range(1, 25))])
def test_period_like_plain_python(spark, weights):
    sources = spark.createDataFrame([(f"s{i:03}", w) for i, w in enumerate(weights)], "source string, weight long")
    found = sorted((int(t.source[1:]), t.turn, t.slot) for t in mixing.period(sources).collect())
    assert found == sorted(plain_period(weights))


def test_twenty_thousand_sources(spark):
    rows = spark.range(30_000).selectExpr("id AS doc_id", "concat('s', id % 20000) AS source")
    began = time.perf_counter()
    mixed = mixing.mix(rows, {"s1": 8, "s2": 4}, block=1).collect()
    assert time.perf_counter() - began < 60
    assert len({r.position for r in mixed}) == 30_000
    slots = {r.doc_id: r.slot for r in mixed if r.source == "s1"}
    assert len(slots) == 2 and max(slots.values()) < 2 * -(-20_010 // 8)


def test_rows_of_one_id_have_a_fixed_order(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 4)
    rows = [(i, f"text {j}") for i in (None, None, 5, 7) for j in range(40)] + [(i, "x") for i in range(100, 140)]
    frame = spark.createDataFrame([(i, "a", t) for i, t in rows], "doc_id long, source string, text string")
    runs = []
    for parts in (1, 7):
        out = mixing.mix(frame.repartition(parts), {}, block=3).collect()
        runs.append(sorted((r.position, str(r.doc_id), r.text) for r in out))
        assert [p for p, _, _ in runs[-1]] == list(range(200))
    assert runs[0] == runs[1]


@pytest.mark.parametrize("sent, bytes_, equal", [(100_000, 2**25, 1), (100_000, 2**25, 30), (1, 2**25, 30), (100_000, 0, 1)])
def test_files_hold_the_order_of_odd_rows(spark, tmp_path, monkeypatch, sent, bytes_, equal):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 6)
    monkeypatch.setattr(mixing, "FILE_ROWS", 9)
    monkeypatch.setattr(mixing, "SENT_SLOTS", sent)
    monkeypatch.setattr(mixing, "SENT_BYTES", bytes_)
    rows = [(i, s, f"text {i} {j}", 1) for i in (None, 3, 4) for s in ("a", None) for j in range(25)]
    rows += [(i, "abc"[i % 3], "t", 2) for i in range(100, 190)] + [(7, "a", "equal", 3)] * equal
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string, mix_file int")
    mixed = sorted(mixing.mix(frame, {"a": 3}, block=2).collect(), key=lambda r: r.position)
    mixing.in_order(frame, {"a": 3}, block=2).write.parquet(str(tmp_path / "out"))
    read = spark.read.parquet(str(tmp_path / "out"))
    assert read.columns == frame.columns
    found = sorted(mixing.file_positions(read).collect(), key=lambda r: r.position)
    assert [r.position for r in found] == list(range(len(rows)))
    assert [(r.doc_id, r.source, r.text) for r in found] == [(r.doc_id, r.source, r.text) for r in mixed]


def test_whole_documents_are_shuffled_once(spark):
    rows = docs(spark, {"a": 200, "b": 100}).withColumn("text", F.repeat(F.lit("x"), 50))
    plan = mixing.in_order(rows, {"a": 2}, block=3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("BroadcastExchange") + 1
    for operator in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"):
        assert operator not in plan


def test_refused(spark):
    with pytest.raises(ValueError):
        mixing.mix(docs(spark, {"a": 1}), {"a": 0})
