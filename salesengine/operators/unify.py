"""Sales lines of both channels and the dimension columns joined to them.

The two families are kept apart here: the snapshot keeps every line and its
exact amount, the filtered family keeps lines with a known date and product and
rounds each amount to cents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesengine.functions.exact import LINE_CENTS, LINE_EXACT
from salesengine.functions.filters import Filters, where_all
from salesengine.functions.labels import known
from salesengine.sources.star import SalesTables

INTERNET = "Internet"
RESELLER = "Reseller"


def _lines(fact: DataFrame, channel: str, customer: Column, amount_type: str) -> DataFrame:
    return fact.select(
        F.lit(channel).alias("sales_channel"),
        F.col("OrderDateKey").alias("order_date_key"),
        F.col("ProductKey").alias("product_key"),
        customer.alias("customer_key"),
        F.col("SalesOrderNumber").alias("sales_order_number"),
        F.col("SalesAmount").cast(amount_type).alias("sales_amount"),
    )


def internet_lines(t: SalesTables, amount_type: str) -> DataFrame:
    return _lines(t.internet, INTERNET, F.col("CustomerKey"), amount_type)


def reseller_lines(t: SalesTables, amount_type: str) -> DataFrame:
    """Lines sold by resellers have no customer."""
    key_type = t.internet.schema["CustomerKey"].dataType
    return _lines(t.reseller, RESELLER, F.lit(None).cast(key_type), amount_type)


def dates(t: SalesTables) -> DataFrame:
    return t.date.select(
        F.col("DateKey").alias("order_date_key"),
        F.col("FullDateAlternateKey").alias("full_date"),
        F.col("CalendarYear").cast("int").alias("year"),
        F.col("MonthNumberOfYear").cast("int").alias("month"),
    )


def products(t: SalesTables) -> DataFrame:
    """Products with their attributes as stored, NULLs included."""
    return t.product.select(
        F.col("ProductKey").alias("product_key"),
        F.col("EnglishProductName").alias("product_name"),
        F.col("ProductLine").alias("product_line"),
        F.col("Color").alias("color"),
        F.col("Size").alias("size"),
    )


def shown_products(t: SalesTables) -> DataFrame:
    """Products with missing line, color and size shown as Unknown."""
    shown = [known(F.col(c)).alias(c) for c in ("product_line", "color", "size")]
    return products(t).select("product_key", "product_name", *shown)


def geography(t: SalesTables) -> DataFrame:
    return t.geography.select(
        F.col("GeographyKey").alias("geography_key"),
        F.col("EnglishCountryRegionName").alias("country"),
        F.col("StateProvinceName").alias("state_province"),
        F.col("City").alias("city"),
    )


def customers(t: SalesTables) -> DataFrame:
    return t.customer.select(
        F.col("CustomerKey").alias("customer_key"),
        F.col("GeographyKey").alias("geography_key"),
    )


def customer_places(t: SalesTables) -> DataFrame:
    """Customers with their place, joined before any fact is touched."""
    places = t.side("geography", geography(t))
    return customers(t).join(places, "geography_key", "left").drop("geography_key")


def places(t: SalesTables) -> DataFrame:
    """Geography with one key for each distinct place.

    Several geography keys may share country, state and city; the smallest of
    them stands for the place, so that lines are grouped by one number instead
    of three names.
    """
    same_names = Window.partitionBy("country", "state_province", "city")
    return geography(t).withColumn("place_key", F.min("geography_key").over(same_names))


def unified_sales(t: SalesTables) -> DataFrame:
    return internet_lines(t, LINE_EXACT).unionByName(reseller_lines(t, LINE_EXACT))


def sales_wide(t: SalesTables) -> DataFrame:
    """Every line with all its dimension columns, NULL where nothing matches.

    Only Internet lines meet the customers: the others have no customer, and
    sending all of them through that join would put one NULL key on one task.
    """
    internet = internet_lines(t, LINE_EXACT).join(
        t.side("customer", customer_places(t), with_place=True), "customer_key", "left"
    )
    sales = internet.unionByName(reseller_lines(t, LINE_EXACT), allowMissingColumns=True)
    wide = sales.join(t.side("date", dates(t)), "order_date_key", "left").join(
        t.side("product", shown_products(t)), "product_key", "left"
    )
    return wide.select(
        "sales_channel",
        "order_date_key",
        "product_key",
        "customer_key",
        "sales_order_number",
        "sales_amount",
        "full_date",
        "year",
        "month",
        "product_name",
        "product_line",
        "color",
        "size",
        "country",
        "state_province",
        "city",
    )


def unified_sales_geo(t: SalesTables) -> DataFrame:
    """Lines in cents with the country of the customer, NULL for resellers."""
    countries = customer_places(t).select("customer_key", F.col("country").alias("country_region"))
    internet = internet_lines(t, LINE_CENTS).join(
        t.side("customer", countries, with_place=True), "customer_key", "left"
    )
    return internet.unionByName(reseller_lines(t, LINE_CENTS), allowMissingColumns=True)


def sales_in_cents(t: SalesTables, f: Filters) -> DataFrame:
    """Lines that pass the channel and country filters.

    The customers are joined only when a country is asked for.
    """
    if f.country:
        sales = unified_sales_geo(t)
    else:
        sales = internet_lines(t, LINE_CENTS).unionByName(reseller_lines(t, LINE_CENTS))
    return where_all(sales, f.on_sales())


def dated(
    sales: DataFrame, t: SalesTables, first_day: Column | None = None, last_day: Column | None = None
) -> DataFrame:
    """Lines with a known date between two days, with that date's columns.

    The smallest date key from the first day on and the largest up to the last
    one are also compared with the lines themselves: those are values the scan
    can use to skip files and row groups (or partitions) of other dates, which a
    join cannot do. Sorted limits find them, as a scan takes plain values only
    and two aggregates would be merged into one structure.
    """
    calendar = dates(t)
    key, day = F.col("order_date_key"), F.col("full_date")
    bounds, tests = [], []
    if first_day is not None:
        tests.append(day >= first_day)
        keys = calendar.where(tests[-1] & key.isNotNull()).select(key)
        bounds.append(key >= keys.orderBy(key).limit(1).scalar())
    if last_day is not None:
        tests.append(day <= last_day)
        keys = calendar.where(tests[-1] & key.isNotNull()).select(key)
        bounds.append(key <= keys.orderBy(key.desc()).limit(1).scalar())
    found = t.side("date", where_all(calendar, tests))
    return where_all(sales, bounds).join(found, "order_date_key")


def product_keys(t: SalesTables, f: Filters) -> DataFrame:
    """Keys of the products that pass the product filter, 8 bytes each."""
    keys = where_all(products(t), f.on_products()).select("product_key")
    return t.side("product", keys, "product_key")


def of_known_products(rows: DataFrame, t: SalesTables, f: Filters) -> DataFrame:
    """Rows whose product exists and passes the product filter.

    Keys are unique, so this only keeps or drops rows. It is an inner join and
    not a semi join because Spark pushes a semi join below an aggregation by
    product_key in some uses of it and not in others, and the aggregation would
    then run twice instead of being reused.
    """
    return rows.join(product_keys(t, f), "product_key")


def filtered_sales(t: SalesTables, f: Filters = Filters()) -> DataFrame:
    """Lines that pass all filters and have a known date and product."""
    sales = dated(sales_in_cents(t, f), t, f.first_day, f.last_day)
    return of_known_products(sales, t, f)


def filtered_sales_geo(t: SalesTables, f: Filters = Filters()) -> DataFrame:
    """The same lines with the columns of unified_sales_geo."""
    unified = unified_sales_geo(t)
    sales = dated(where_all(unified, f.on_sales()), t, f.first_day, f.last_day)
    return of_known_products(sales, t, f).select(unified.columns)


def distinct_customers(rows: DataFrame, t: SalesTables, counting: bool = True) -> DataFrame:
    """One row with n, the exact number of different customers of some rows, NULL not counted.

    Keys between the least and the largest of the customer table are bits of bitmaps, one
    for 32,768 keys, which are combined before they are shuffled and merge exactly. That
    is done only where the keys are dense, as a table of few customers with keys far apart
    would need a bitmap for each. Other keys are shuffled one by one, and so are all if
    the customers have not been counted and are not to be counted for this.
    """
    key = F.col("customer_key")
    size = t.size("customer") if counting else t.sizes.get("customer")
    if size is None or not size.dense:
        return rows.agg(F.count_distinct(key).alias("n"))
    inside = key.between(F.lit(size.least), F.lit(size.largest))
    bits = (
        rows.where(inside)
        .groupBy(F.bitmap_bucket_number(key).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(key)).alias("bits"))
        .agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n"))
    )
    others = rows.where(~inside).agg(F.count_distinct(key).alias("n"))
    return bits.unionByName(others).agg(F.sum("n").alias("n"))


def side_by_side(*figures: DataFrame) -> DataFrame:
    """One row from several frames of one row and different columns.

    The frames are branches of a union, so Spark computes them at the same time.
    """
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), figures)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
