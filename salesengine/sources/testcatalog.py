"""A catalog, its tombstones and a batch of changes made from the test products.

All three grow with the product table. Products of size 13 are deleted ones;
the catalog holds all others but one line, left out so that changes meet
products that are not listed, under new attributes, NULL colors among them; the
changes cover every order of insert, update and delete a product can meet.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesengine.operators.catalog import (
    ATTRIBUTES,
    DELETE,
    INSERT,
    UPDATE,
    CatalogState,
)
from salesengine.sources.star import SalesTables

# Fixed values of the fixture.
OTHER_LINE = "STANDARD"
DELETED_SIZE = "13"
STEPS = 10  # sequence numbers kept for the changes of one product


def _products(t: SalesTables) -> DataFrame:
    return t.product.withColumn("product_key", F.col("ProductKey").cast("bigint"))


def _in_catalog() -> Column:
    listed = F.coalesce("ProductLine", F.lit("")) != OTHER_LINE
    return listed & (F.col("Size") != DELETED_SIZE)


def catalog_state(t: SalesTables) -> CatalogState:
    products = _products(t)
    catalog = products.where(_in_catalog()).select(
        "product_key",
        F.concat(F.lit("Renamed "), F.col("product_key").cast("string")).alias("product_name"),
        F.lit("X").alias("product_line"),
        F.lit(None).cast("string").alias("color"),
        F.lit("S").alias("size"),
        F.col("ListPrice").cast("double").alias("list_price"),
        F.col("ModelName").alias("model_name"),
        F.lit(0.0).alias("sales_amount"),
        F.lit(0).cast("bigint").alias("order_count"),
    )
    tombstones = products.where(F.col("Size") == DELETED_SIZE).select("product_key")
    return CatalogState(catalog, tombstones)


def _change(products: DataFrame, which: Column, step: int, op: str, name: str) -> DataFrame:
    key = F.col("product_key")
    given = {
        "product_name": F.concat(F.lit(name + " "), key.cast("string")),
        "product_line": F.lit(None).cast("string"),
        "color": F.lit("teal"),
        "size": F.lit(None).cast("string"),
        "list_price": F.col("ListPrice").cast("double") + 1,
        "model_name": F.col("ModelName"),
    }
    kinds = {"list_price": "double"}
    values = [
        F.lit(None).cast(kinds.get(a, "string")).alias(a) if op == DELETE else given[a].alias(a)
        for a in ATTRIBUTES
    ]
    target = F.lit(None).cast("bigint") if op == INSERT else key
    return products.where(which).select(
        (key * STEPS + step).alias("seq"), F.lit(op).alias("op"), target.alias("product_key"), *values
    )


def changes(t: SalesTables) -> DataFrame:
    products = _products(t)
    listed, other = _in_catalog(), F.col("ProductLine") == OTHER_LINE
    brand, color = F.col("ModelName"), F.col("Color")
    batch = [
        _change(products, listed & (color == "blue"), 1, UPDATE, "First"),
        _change(products, listed & (brand == "Brand#2"), 2, UPDATE, "Second"),
        _change(products, listed & (color == "red"), 3, UPDATE, "Doomed"),
        _change(products, brand == "Brand#6", 4, INSERT, "New"),
        _change(products, listed & (color == "red"), 5, DELETE, ""),
        _change(products, listed & (color == "red"), 6, UPDATE, "Too late"),
        _change(products, listed & (color == "red") & (brand == "Brand#2"), 7, DELETE, ""),
        _change(products, other & (brand == "Brand#3"), 1, UPDATE, "Not listed"),
        _change(products, other & (brand == "Brand#4"), 5, DELETE, ""),
    ]
    return reduce(DataFrame.unionByName, batch).unionByName(_on_first_new_key(t))


def _on_first_new_key(t: SalesTables) -> DataFrame:
    """An update of the first inserted product, before it exists and after."""
    state = catalog_state(t)
    used = state.catalog.select("product_key").unionByName(state.tombstones)
    ends = used.agg((F.max("product_key") + 1).alias("product_key"))
    last = _products(t).agg(F.max("product_key").alias("last")).scalar()
    times = F.array(F.lit(0).cast("bigint"), last * STEPS + STEPS)
    return ends.select(
        F.explode(times).alias("seq"),
        F.lit(UPDATE).alias("op"),
        "product_key",
        F.lit("First new").alias("product_name"),
        F.lit("Y").alias("product_line"),
        F.lit(None).cast("string").alias("color"),
        F.lit("L").alias("size"),
        F.lit(9.5).alias("list_price"),
        F.lit(None).cast("string").alias("model_name"),
    )
