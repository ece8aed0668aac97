"""Versions that notice each other, and the stored catalog that relies on them."""

import random
import time
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from conftest import rows
from test_catalog import batch, product, replay, state

from salesengine.operators import catalog
from salesengine.sources import results, versions
from salesengine.sources.scratch import scratch_folder

NONE = (None,) * 6


def new(name):
    return (name, None, None, None, 2.0, None)


def held(spark, folder):
    found = catalog.load(spark, folder)
    products = {r["product_key"]: r for r in rows(found.catalog)}
    return products, sorted(r["product_key"] for r in rows(found.tombstones))


def test_numbers_order_versions_not_clocks(spark, monkeypatch):
    folder = scratch_folder(spark)
    assert versions.current(spark, folder) is None
    monkeypatch.setattr(time, "time_ns", iter(range(100, 0, -1)).__next__)
    assert [versions.add(spark, folder, name) for name in "abc"] == [1, 2, 3]
    assert versions.current(spark, folder).name == "c"
    assert not versions.commit(spark, folder, "late", 1)
    assert versions.commit(spark, folder, "next", 3, {"a": 1})
    assert versions.current(spark, folder) == versions.Version(4, "next", {"a": 1})


def test_one_writer_gets_a_number(spark):
    folder = scratch_folder(spark)
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: versions.commit(spark, folder, str(i), 0), range(8)))
    assert sum(won) == 1 and versions.current(spark, folder).name == str(won.index(True))
    with ThreadPoolExecutor(8) as pool:
        numbers = list(pool.map(lambda i: versions.add(spark, folder, str(i)), range(8)))
    assert sorted(numbers) == list(range(2, 10))


def test_a_file_system_that_renames(spark, monkeypatch):
    folder = scratch_folder(spark)
    at = versions._at

    class Renaming:
        def __init__(self, files):
            self.files = files

        def __getattr__(self, name):
            return getattr(self.files, name)

        def getScheme(self):
            return "other"

    monkeypatch.setattr(versions, "_at", lambda s, p: (Renaming(at(s, p)[0]), at(s, p)[1]))
    assert versions.commit(spark, folder, "first", 0) and not versions.commit(spark, folder, "second", 0)
    assert versions.current(spark, folder).name == "first"
    assert versions.children(spark, f"{folder}/versions") == ["000000000001"]


def test_two_batches_from_one_base(spark, monkeypatch):
    folder = scratch_folder(spark)
    catalog.save(state(spark, [product(k) for k in range(1, 9)]), folder, buckets=4)
    mine = batch(spark, [(1, "update", 1, *new("Mine")), (2, "insert", None, *new("My new")), (3, "delete", 3, *NONE)])
    theirs = batch(spark, [(1, "update", 2, *new("Theirs")), (2, "insert", None, *new("Their new")), (3, "update", 3, *new("Gone soon"))])
    store, others = catalog._store_batch, [theirs]

    def interrupted(*args):
        written = store(*args)
        if others:  # another batch comes first, from the same base
            catalog.apply_stored(spark, folder, others.pop())
        return written

    monkeypatch.setattr(catalog, "_store_batch", interrupted)
    catalog.apply_stored(spark, folder, mine)
    products, dead = held(spark, folder)
    assert {k: p["product_name"] for k, p in products.items()} == {
        1: "Mine", 2: "Theirs", 4: "Name", 5: "Name", 6: "Name", 7: "Name", 8: "Name", 9: "Their new", 10: "My new"
    }
    assert dead == [3] and versions.current(spark, folder).number == 3
    used = {g for v in (1, 2, 3) for g in versions.version(spark, folder, v).details["generations"] if g}
    assert set(versions.children(spark, f"{folder}/catalog")) == used


def test_batches_at_the_same_time(spark):
    folder = scratch_folder(spark)
    catalog.save(state(spark, [product(1)]), folder, buckets=2)
    batches = [batch(spark, [(1, "insert", None, *new(f"Batch {i}"))]) for i in range(3)]
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda b: catalog.apply_stored(spark, folder, b), batches))
    products, _ = held(spark, folder)
    assert sorted(products) == [1, 2, 3, 4]
    assert {p["product_name"] for p in products.values()} == {"Name", "Batch 0", "Batch 1", "Batch 2"}


@pytest.mark.parametrize("seed", range(2))
def test_stored_batches_like_a_replay(spark, seed):
    dice = random.Random(seed)
    folder = scratch_folder(spark)
    products, tombstones = [product(k) for k in (1, 2, 4, 7)], [5, 9]
    catalog.save(state(spark, products, tombstones), folder, buckets=3)
    every, seq = [], 0
    for _ in range(3):
        changes = []
        for _ in range(12):
            seq += dice.randint(1, 3)
            op = dice.choice(["insert", "update", "update", "delete"])
            key = None if op == "insert" else dice.randint(1, 16)
            changes.append((seq, op, key, *(NONE if op == "delete" else new(f"n{seq}"))))
        catalog.apply_stored(spark, folder, batch(spark, changes))
        every += changes
    table, dead, _ = replay(products, tombstones, every)
    assert held(spark, folder) == (table, sorted(dead))


def test_an_empty_store_and_an_empty_batch(spark):
    folder = scratch_folder(spark)
    assert held(spark, folder) == ({}, [])
    catalog.apply_stored(spark, folder, batch(spark, []))
    catalog.apply_stored(spark, folder, batch(spark, [(1, "insert", None, *new("First"))]))
    products, dead = held(spark, folder)
    assert list(products) == [1] and dead == []
    number = versions.current(spark, folder).number
    catalog.apply_stored(spark, folder, batch(spark, []))
    assert versions.current(spark, folder).number == number


def files_of(folder):
    return {str(p): (p.stat().st_mtime_ns, p.stat().st_size) for p in Path(folder).rglob("*.parquet")}


def test_only_touched_buckets_are_written(spark):
    folder = scratch_folder(spark)
    catalog.save(state(spark, [product(k) for k in range(1, 200)]), folder, buckets=16)
    before, base = files_of(folder), versions.current(spark, folder).details["generations"]
    catalog.apply_stored(spark, folder, batch(spark, [(1, "update", 5, *new("Five")), (2, "delete", 6, *NONE)]))
    after = files_of(folder)
    assert {k: after[k] for k in before} == before
    generations = versions.current(spark, folder).details["generations"]
    moved = {b for b in range(16) if generations[b] != base[b]}
    assert 1 <= len(moved) <= 2
    fresh = {p.split("bucket=")[1].split("/")[0] for p in set(after) - set(before)}
    assert fresh == {str(b) for b in moved}
    products, dead = held(spark, folder)
    assert len(products) == 198 and products[5]["product_name"] == "Five" and dead == [6]


def test_the_catalog_is_not_shuffled_for_a_batch(spark):
    folder = scratch_folder(spark)
    catalog.save(state(spark, [product(k) for k in range(1, 50)]), folder, buckets=4)
    details = versions.current(spark, folder).details
    changes = batch(spark, [(1, "update", 5, *new("Five"))])
    born = catalog.inserted(catalog.load(spark, folder), changes)
    outcomes = catalog._sent(catalog._outcomes(changes, catalog._aimed(changes, born)))
    lives = catalog._stored_rows(spark, folder, details, {0, 1})
    assert all(f"bucket={b}/" in p for p in lives.inputFiles() for b in [p.split("bucket=")[1][0]] if b in "01")
    plan = catalog._after(lives, outcomes)._jdf.queryExecution().executedPlan().toString()
    scan = next(i for i, line in enumerate(plan.splitlines()) if "Scan parquet" in line)
    above = "\n".join(plan.splitlines()[:scan])
    assert "BroadcastHashJoin" in above and "Exchange hashpartitioning" not in above.split("BroadcastExchange")[0]


def test_vacuum_keeps_what_versions_list(spark):
    folder = scratch_folder(spark)
    catalog.save(state(spark, [product(k) for k in range(1, 60)]), folder, buckets=4)
    for key in (1, 2, 3):
        catalog.apply_stored(spark, folder, batch(spark, [(1, "update", key, *new(f"To {key}"))]))
    now, earlier = held(spark, folder), rows(catalog.load(spark, folder, 3).catalog.orderBy("product_key"))
    assert catalog.vacuum(spark, folder, keep=2)
    assert held(spark, folder) == now
    assert rows(catalog.load(spark, folder, 3).catalog.orderBy("product_key")) == earlier
    assert versions.listed(spark, folder) == [3, 4]
    assert catalog.vacuum(spark, folder, keep=2) == []
    with pytest.raises(ValueError):
        catalog.vacuum(spark, folder, keep=0)


def test_runs_that_are_forgotten(spark):
    folder = scratch_folder(spark)
    for name in ("one", "two", "three"):
        results.publish(spark.range(2).selectExpr("id", "'x' AS source"), f"{folder}/{name}", "trend")
        versions.add(spark, folder, name)
    assert [g.rsplit("/", 1)[1] for g in results.forget_runs(spark, folder, 1)] == ["one", "two"]
    assert sorted(p.name for p in Path(folder).iterdir()) == ["three", "versions"]
    assert results.current_run(spark, folder).endswith("/three")
