"""The star loaded from a warehouse that is a set of views: no database runs here.

The two calls that need a driver are replaced; the questions are answered by Spark,
and a table is read slice by slice, as the predicates say.
"""

from functools import reduce

import pytest
from conftest import rows
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesengine.operators import snapshot
from salesengine.sources import jdbc
from salesengine.sources.star import CONTRACT, TABLE_NAMES

CONNECTION = jdbc.Connection("url", "user", "password", "driver")
INTERNET = [
    (20010105, 1, 7, "A1", "10.00"),
    (20010105, 2, 7, "A1", "2.50"),
    (20010220, 3, 8, "A2", "4.25"),
    (20010228, 1, 9, "A3", "1.00"),
    (None, 2, 9, "A4", "8.00"),
    (20010301, None, 8, "A5", "3.00"),
]
RESELLER = [(20010110, 1, "B1", "100.00"), (20010415, 3, "B2", "7.75"), (20010415, None, "B3", "0.50")]
PRODUCTS = [(k, f"Product {k}", "R", None, "M", 1.0, "Model") for k in (1, 2, 3)]
CUSTOMERS = [(7, 70), (8, 71), (9, None)]
PLACES = [(70, "Germany", "Hessen", "Kassel"), (71, "France", "Alsace", "Colmar")]
DAYS = [20010105, 20010110, 20010220, 20010228, 20010301, 20010415]


@pytest.fixture
def asked(spark, star, monkeypatch):
    """A warehouse with the tables of the star and a column no one asks for; what is asked of it."""
    t = star(INTERNET, RESELLER, PRODUCTS, CUSTOMERS, PLACES, DAYS)
    tables = {name: getattr(t, name).withColumn("Unread", F.lit("x")) for name in TABLE_NAMES}
    by_table = {TABLE_NAMES[name]: df for name, df in tables.items()}
    log = {"star": t, "tables": by_table, "slices": {}, "queries": []}

    def read_query(spark, connection, query):
        log["queries"].append(query)
        name = next(name for name in by_table if f".{name}" in query)
        by_table[name].createOrReplaceTempView(name)
        # numbers divide as whole ones in the warehouse
        return spark.sql(query.replace(f"{connection.schema}.{name}", name).replace(" / ", " DIV "))

    def read_table(spark, connection, table, slices=jdbc.Slices()):
        log["slices"][table] = slices
        slices.options()  # refused if it has no bounds
        whole = by_table[table]
        if not slices.predicates:
            return whole
        return reduce(DataFrame.unionByName, [whole.where(p) for p in slices.predicates])

    monkeypatch.setattr(jdbc, "read_query", read_query)
    monkeypatch.setattr(jdbc, "read_table", read_table)
    return log


def same(left: DataFrame, right: DataFrame) -> bool:
    return left.columns == right.columns and left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


@pytest.mark.parametrize("rows_per_slice", [jdbc.ROWS_PER_SLICE, 1])
def test_loaded_tables_are_those_of_the_warehouse(spark, asked, monkeypatch, rows_per_slice):
    """Every row once, also without a date or a product, from few slices and from many."""
    cut = jdbc.fact_slices
    monkeypatch.setattr(jdbc, "fact_slices", lambda months, day, key: cut(months, day, key, rows_per_slice))
    t = jdbc.load_jdbc(spark, CONNECTION)
    for name, table in TABLE_NAMES.items():
        loaded = getattr(t, name)
        assert loaded.columns == list(CONTRACT[name])
        assert same(loaded, asked["tables"][table].select(*CONTRACT[name])), name
    by_table = asked["slices"]
    assert len(by_table["FactInternetSales"].predicates) == (3 if rows_per_slice > 1 else 5)
    assert by_table["DimCustomer"] == jdbc.Slices("CustomerKey", 7, 9, 1)
    assert by_table["DimProduct"] == jdbc.Slices("ProductKey", 1, 3, 1)
    assert by_table["DimDate"] == by_table["DimGeography"] == jdbc.Slices()
    assert len(asked["queries"]) == 4  # one for each table that is cut


def test_figures_of_loaded_tables(spark, asked):
    t, direct = jdbc.load_jdbc(spark, CONNECTION), asked["star"]
    assert rows(snapshot.kpis(t)) == rows(snapshot.kpis(direct))
    (kpis,) = rows(snapshot.kpis(t))
    assert (kpis["total_sales"], kpis["order_count"], kpis["customer_count"]) == (137.0, 8, 3)
    assert rows(snapshot.channels(t)) == rows(snapshot.channels(direct))
    assert [(r["city"], r["sales_amount"]) for r in rows(snapshot.geo(t))] == [("Kassel", 12.5), ("Colmar", 7.25)]


def test_given_slices_ask_nothing(spark, asked):
    whole = {name: jdbc.Slices() for name in ("internet", "reseller", "customer", "product")}
    t = jdbc.load_jdbc(spark, CONNECTION, whole)
    assert asked["queries"] == []
    assert t.internet.count() == len(INTERNET)


def test_empty_warehouse(spark, asked):
    for name, df in asked["tables"].items():
        asked["tables"][name] = df.limit(0)
    t = jdbc.load_jdbc(spark, CONNECTION)
    assert set(asked["slices"].values()) == {jdbc.Slices()}
    assert t.internet.count() == 0 and rows(snapshot.kpis(t))[0]["order_count"] == 0


def test_a_key_that_is_not_unique_is_refused(spark, asked):
    products = asked["tables"]["DimProduct"]
    asked["tables"]["DimProduct"] = products.unionByName(products.where("ProductKey = 1"))
    t = jdbc.load_jdbc(spark, CONNECTION)
    with pytest.raises(ValueError):
        t.size("product")
