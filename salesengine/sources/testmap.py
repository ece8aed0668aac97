"""The star schema as views over the order tables used for tests.

Every line of every order is a sales line: the remainder of the order number
only says in which channel it was sold, and both channels are always read.
With gaps, some products and the places of one nation are left out of the
dimensions (not of the facts), so that lines without a match exist and left and
inner joins give different results; only queries named for unmatched lines ask
for them.
"""

from __future__ import annotations

from dataclasses import replace
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salesengine.sources.scratch import scratch_folder, stored
from salesengine.sources.star import SalesTables, checked

# Fixed values of the mapping.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
RESELLER_EVERY = 5
PRODUCT_GAP = 97
NATION_GAP = 24
LINE_WITHOUT_NAME = "PROMO"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _date_key(day: Column) -> Column:
    return (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)).cast("int")


def _geography_key(nation: Column, segment: Column) -> Column:
    place = F.array_position(F.array(*[F.lit(s) for s in SEGMENTS]), segment) - 1
    return nation.cast("bigint") * 10 + place


def star_views(spark: SparkSession, sf_dir: str, gaps: bool = False) -> SalesTables:
    lineitem = _table(spark, sf_dir, "lineitem")
    orders = _table(spark, sf_dir, "orders")
    customer = _table(spark, sf_dir, "customer")
    part = _table(spark, sf_dir, "part")
    nation = _table(spark, sf_dir, "nation")
    region = _table(spark, sf_dir, "region")

    headers = orders.select(
        F.col("o_orderkey").alias("l_orderkey"),
        _date_key(F.col("o_orderdate")).alias("OrderDateKey"),
        F.col("o_custkey").alias("CustomerKey"),
        F.concat(F.lit("SO"), F.col("o_orderkey")).alias("SalesOrderNumber"),
    )
    lines = lineitem.join(headers, "l_orderkey").select(
        "l_orderkey",
        "OrderDateKey",
        (F.col("l_partkey") + 1).alias("ProductKey"),
        "CustomerKey",
        "SalesOrderNumber",
        F.col("l_extendedprice").cast("decimal(18,2)").alias("SalesAmount"),
    )
    by_reseller = F.col("l_orderkey") % RESELLER_EVERY == 0
    places = customer.select("c_nationkey", "c_mktsegment").distinct()
    if gaps:
        part = part.where(F.col("p_partkey") % PRODUCT_GAP != 0)
        places = places.where(F.col("c_nationkey") != NATION_GAP)
    return SalesTables(
        internet=lines.where(~by_reseller).drop("l_orderkey"),
        reseller=lines.where(by_reseller).drop("l_orderkey", "CustomerKey"),
        date=orders.select(F.to_date("o_orderdate").alias("day"))
        .distinct()
        .select(
            _date_key(F.col("day")).alias("DateKey"),
            F.col("day").alias("FullDateAlternateKey"),
            F.year("day").alias("CalendarYear"),
            F.month("day").alias("MonthNumberOfYear"),
        ),
        product=part.select(
            (F.col("p_partkey") + 1).alias("ProductKey"),
            F.col("p_name").alias("EnglishProductName"),
            F.nullif(F.col("p_type"), F.lit(LINE_WITHOUT_NAME)).alias("ProductLine"),
            F.split_part(F.col("p_name"), F.lit(" "), F.lit(1)).alias("Color"),
            F.col("p_size").cast("string").alias("Size"),
            F.col("p_retailprice").alias("ListPrice"),
            F.col("p_brand").alias("ModelName"),
        ),
        customer=customer.select(
            F.col("c_custkey").alias("CustomerKey"),
            _geography_key(F.col("c_nationkey"), F.col("c_mktsegment")).alias("GeographyKey"),
        ),
        geography=places.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            _geography_key(F.col("c_nationkey"), F.col("c_mktsegment")).alias("GeographyKey"),
            F.col("r_name").alias("EnglishCountryRegionName"),
            F.col("n_name").alias("StateProvinceName"),
            F.col("c_mktsegment").alias("City"),
        ),
    )


# Derived tables by session, folder, and the state of the folder's files.
_stored: dict[tuple, SalesTables] = {}


def _state(spark: SparkSession, sf_dir: str, *names: str) -> tuple:
    """Names, sizes and times of the files of the tables that derived ones come from."""
    folders = [f"{sf_dir.rstrip('/')}/{name}.parquet" for name in names]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folders)
    rows = files.select("path", "length", "modificationTime").collect()  # listings only
    return tuple(sorted((r["path"], r["length"], r["modificationTime"]) for r in rows))


def load_star(
    spark: SparkSession, sf_dir: str, gaps: bool = False, facts: bool = False
) -> SalesTables:
    """Checked tables.

    Dates and places are distinct values of large tables: they are stored, as
    dimensions of a warehouse are, and derived anew when their files change. The
    facts stay views, which join lines and orders whenever they are read; with
    ``facts``, for those who read them several times, they are stored likewise.
    """
    if facts:
        return _with_facts(spark, sf_dir, load_star(spark, sf_dir, gaps), gaps)
    key = (spark.sparkContext.applicationId, sf_dir, gaps, _state(spark, sf_dir, "orders", "customer"))
    if key not in _stored:
        views = star_views(spark, sf_dir, gaps)
        folder = scratch_folder(spark)
        _stored[key] = checked(
            replace(
                views,
                date=stored(views.date, folder, "date"),
                geography=stored(views.geography, folder, "geography"),
            )
        )
    return _stored[key]


def _with_facts(spark: SparkSession, sf_dir: str, t: SalesTables, gaps: bool) -> SalesTables:
    """The same tables with every line of both facts written once, joined with its order."""
    read = _state(spark, sf_dir, "orders", "customer", "lineitem")
    key = (spark.sparkContext.applicationId, sf_dir, gaps, "facts", read)
    if key not in _stored:
        folder = scratch_folder(spark)
        _stored[key] = replace(
            t,
            internet=stored(t.internet, folder, "internet"),
            reseller=stored(t.reseller, folder, "reseller"),
        )
    return _stored[key]
