"""Batches of changes against a replay of the same changes one by one."""

import random

import pytest
from conftest import rows

from salesengine.operators import catalog
from salesengine.operators.catalog import (
    ATTRIBUTES,
    CATALOG_SCHEMA,
    CHANGE_SCHEMA,
    CatalogState,
)

COLUMNS = [f.name for f in CATALOG_SCHEMA.fields]


def product(key, name="Name", line="R", color="Red", size="M", price=1.0, model="Model"):
    return (key, name, line, color, size, price, model, 5.0, 2)


def state(spark, products, tombstones=()):
    return CatalogState(
        spark.createDataFrame(list(products), CATALOG_SCHEMA),
        spark.createDataFrame([(k,) for k in tombstones], "product_key bigint"),
    )


def batch(spark, changes):
    return spark.createDataFrame(list(changes), CHANGE_SCHEMA)


def replay(products, tombstones, changes):
    """The changes one at a time, on plain dictionaries."""
    table = {p[0]: dict(zip(COLUMNS, p)) for p in products}
    dead = set(tombstones)
    largest = max([*table, *dead, 0])
    report = []
    for seq, op, key, *values in sorted(changes):
        given = dict(zip(ATTRIBUTES, values))
        if op == "insert":
            largest += 1
            table[largest] = {
                "product_key": largest, **given, "sales_amount": 0.0, "order_count": 0
            }
            report.append((seq, op, largest, True))
            continue
        report.append((seq, op, key, key in table))
        if op == "update" and key in table:
            table[key].update(given)
        elif op == "delete" and key in table:
            del table[key]
            dead.add(key)
    return table, dead, report


def check(spark, products, tombstones, changes):
    before = state(spark, products, tombstones)
    made = batch(spark, changes)
    table, dead, report = replay(products, tombstones, changes)
    after = catalog.apply_changes(before, made)
    assert {r["product_key"]: r for r in rows(after.catalog)} == table
    kept = [r["product_key"] for r in rows(after.tombstones)]
    assert sorted(kept) == sorted(dead)
    found = [tuple(r.values()) for r in rows(catalog.change_report(before, made))]
    assert found == report


@pytest.mark.parametrize("seed", range(4))
def test_random_batches(spark, seed):
    dice = random.Random(seed)
    keys = list(range(1, 12))
    products = [product(k) for k in dice.sample(keys, 6)]
    listed = {p[0] for p in products}
    tombstones = [k for k in keys if k not in listed and dice.random() < 0.5]
    changes = []
    for seq in dice.sample(range(0, 5_000_000), 40):
        op = dice.choice(["insert", "update", "update", "delete"])
        # Keys of products the batch itself will insert are aimed at too.
        key = None if op == "insert" else dice.randint(1, 20)
        if op == "delete":
            values = [None] * 6
        else:
            values = [f"n{seq}", dice.choice(["A", None]), None, "S", float(seq % 7), None]
        changes.append((seq, op, key, *values))
    check(spark, products, tombstones, changes)


def test_update_and_delete_in_either_order(spark):
    new = ("New", None, None, None, 2.0, None)
    none = (None,) * 6
    check(
        spark,
        [product(1), product(2), product(3)],
        [9],
        [
            (1, "update", 1, *new),
            (2, "delete", 1, *none),
            (3, "delete", 2, *none),
            (4, "update", 2, *new),
            (5, "update", 7, *new),
            (6, "delete", 8, *none),
            (7, "insert", None, *new),
            (8, "insert", None, *new),
            (9, "update", 10, *new),
            (10, "delete", 9, *none),
        ],
    )


def test_one_product_with_most_changes(spark):
    updates = [(s, "update", 1, f"n{s}", None, None, None, 0.0, None) for s in range(500)]
    check(spark, [product(1), product(2)], [], updates + [(501, "delete", 2, *(None,) * 6)])


def test_positions_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(catalog, "NUMBERING_BUCKETS", 10)
    sequence = [-15, -3, 0, 9, 10, 11, 57, 1_000_003]
    numbered = catalog.numbered(spark.createDataFrame([(s,) for s in sequence], "seq bigint"))
    found = {r["seq"]: r["position"] for r in rows(numbered)}
    assert found == {s: i for i, s in enumerate(sequence, start=1)}


def test_seed_only_fills_an_empty_catalog(spark, star):
    t = star(
        internet=[],
        products=[(k, f"P{k}" if k % 2 else None, None, None, None, None, None) for k in range(1, 81)],
    )
    fresh = rows(catalog.seed(t, state(spark, []).catalog))
    assert [r["product_key"] for r in fresh] == list(range(79, 19, -2))
    assert (fresh[0]["product_line"], fresh[0]["list_price"]) == ("Unknown", 0.0)
    assert (fresh[0]["sales_amount"], fresh[0]["order_count"]) == (0.0, 0)
    kept = rows(catalog.seed(t, state(spark, [product(5)]).catalog))
    assert [r["product_key"] for r in kept] == [5]


@pytest.mark.parametrize(
    "text, found",
    [
        ("roAD", [1, 2]),
        ("r%d", [1, 2, 3]),
        ("_oad", [1, 2]),
        ("100%", [2, 4]),
        ("\\", [4]),
        ("É", [3]),
        ("é", []),
        ("", [1, 2, 3, 4]),
    ],
)
def test_search_by_name(spark, text, found):
    names = {1: "Road bike", 2: "ROAD 100", 3: "Rides É", 4: "100\\%x"}
    table = state(spark, [product(k, name=n) for k, n in names.items()]).catalog
    assert sorted(r["product_key"] for r in rows(catalog.search(table, text))) == found


def test_search_by_line_newest_first(spark):
    table = state(spark, [product(1), product(2, line="M"), product(3)]).catalog
    assert [r["product_key"] for r in rows(catalog.search(table, None, "R"))] == [3, 1]


def test_overlay(spark):
    ranking = spark.createDataFrame(
        [(k, f"old{k}", "L", "C", "S", 10.0 - k) for k in (1, 2, 3)],
        "product_key bigint, product_name string, product_line string, color string, "
        "size string, sales_amount double",
    )
    known = state(spark, [product(2, name="new", color=None)], [1])
    found = rows(catalog.overlay(ranking, known))
    assert [(r["product_key"], r["product_name"], r["color"]) for r in found] == [
        (2, "new", None),
        (3, "old3", "C"),
    ]
    assert rows(catalog.overlay(ranking, state(spark, []))) == rows(ranking)
    priced = ranking.selectExpr("product_key", "product_name", "0.5D AS list_price")
    assert {r["product_key"]: r["list_price"] for r in rows(catalog.overlay(priced, known))} == {
        2: 1.0,
        3: 0.5,
    }


def test_lookup(spark):
    table = state(spark, [product(1), product(2)]).catalog
    assert [r["product_key"] for r in rows(catalog.lookup(table, 2))] == [2]
    assert rows(catalog.lookup(table, 3)) == []
