"""The published metric modules, over all sales and without filters."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesengine.functions.exact import LINE_EXACT, cents, quotient, rounded
from salesengine.functions.filters import check_limit
from salesengine.functions.labels import year_month
from salesengine.operators.unify import (
    customers,
    dates,
    distinct_customers,
    internet_lines,
    places,
    shown_products,
    side_by_side,
    unified_sales,
)
from salesengine.sources.star import SalesTables

DEFAULT_TOP = 10
#: Places shown unless another limit is asked for; None shows all.
PLACES_SHOWN = 100


@dataclass(frozen=True)
class LabelRules:
    # Fixed values of the business rules.
    growth_band: float = 0.02
    primary_channel_share: float = 0.5
    high_contribution_share: float = 0.08
    high_value_fraction: Decimal = Decimal("0.65")


LABELS = LabelRules()


def kpis(t: SalesTables) -> DataFrame:
    """One row of headline figures; no dimension is needed for it.

    Each distinct count is a pass over its own column, customers as bitmaps if their
    table has been counted for another module, and the amounts come with the products. Together they read what one pass would, without multiplying
    every line for the several distinct counts.
    """
    sales = unified_sales(t)
    amounts = (
        sales.groupBy("product_key")
        .agg(F.sum("sales_amount").alias("total"))
        .agg(
            F.coalesce(F.sum("total"), F.lit(0)).alias("total"),
            F.count("product_key").alias("product_count"),
        )
    )
    orders = sales.agg(F.count_distinct("sales_order_number").alias("order_count"))
    buyers = distinct_customers(
        sales.where(F.col("customer_key").isNotNull()), t, counting=False
    ).withColumnRenamed("n", "customer_count")
    average = rounded(quotient(F.col("total"), F.col("order_count")), 2)
    return side_by_side(amounts, orders, buyers).select(
        F.col("total").cast("double").alias("total_sales"),
        "order_count",
        "customer_count",
        F.col("product_count").alias("hot_product_count"),
        "product_count",
        F.coalesce(average, F.lit(0.0)).alias("avg_order_value"),
    )


def trend(t: SalesTables, labels: LabelRules = LABELS) -> DataFrame:
    """Sales of each month and its growth over the month listed before it."""
    monthly = (
        unified_sales(t)
        .join(t.side("date", dates(t)), "order_date_key", "left")
        .groupBy("year", "month")
        .agg(
            F.coalesce(F.sum("sales_amount"), F.lit(0)).alias("total"),
            F.count_distinct("sales_order_number").alias("order_count"),
        )
    )
    # The window sees one row for each month of the calendar.
    previous = F.lag("total").over(Window.orderBy("year", "month"))
    growth = F.when(previous > 0, quotient(F.col("total") - previous, previous)).otherwise(0.0)
    return (
        monthly.withColumn("growth", growth)
        .select(
            "year",
            "month",
            cents(F.col("total")).alias("sales_amount"),
            "order_count",
            year_month(F.col("year"), F.col("month")).alias("year_month"),
            rounded(F.col("growth"), 4).alias("mom_growth_rate"),
            F.when(F.col("growth") > labels.growth_band, "up")
            .when(F.col("growth") < -labels.growth_band, "down")
            .otherwise("stable")
            .alias("trend_direction"),
        )
        .orderBy("year", "month")
    )


def channels(t: SalesTables, labels: LabelRules = LABELS) -> DataFrame:
    by_channel = (
        unified_sales(t)
        .groupBy("sales_channel")
        .agg(
            F.coalesce(F.sum("sales_amount"), F.lit(0)).alias("total"),
            F.count_distinct("sales_order_number").alias("order_count"),
        )
    )
    every = Window.partitionBy()  # over the two channel rows
    share = F.coalesce(quotient(F.col("total"), F.sum("total").over(every)), F.lit(0.0))
    order_share = quotient(F.col("order_count"), F.sum("order_count").over(every))
    per_order = rounded(quotient(F.col("total"), F.col("order_count")), 2)
    return (
        by_channel.withColumn("share", share)
        .withColumn("order_share", F.coalesce(order_share, F.lit(0.0)))
        .orderBy(F.desc("total"), "sales_channel")
        .select(
            "sales_channel",
            cents(F.col("total")).alias("sales_amount"),
            "order_count",
            rounded(F.col("share"), 4).alias("sales_ratio"),
            rounded(F.col("order_share"), 4).alias("order_ratio"),
            F.coalesce(per_order, F.lit(0.0)).alias("avg_order_amount"),
            F.when(F.col("share") >= labels.primary_channel_share, "primary")
            .otherwise("supplementary")
            .alias("performance_summary"),
        )
    )


def top_products(
    t: SalesTables, limit: int = DEFAULT_TOP, labels: LabelRules = LABELS
) -> DataFrame:
    """The best-selling products with their share of all sales.

    Sales are summed for every product, which partial aggregation keeps small;
    orders are counted only for the products that made the list, so order
    numbers of the other products are never shuffled.
    """
    sales = unified_sales(t)
    by_product = sales.groupBy("product_key").agg(
        F.coalesce(F.sum("sales_amount"), F.lit(0)).alias("total")
    )
    grand_total = by_product.agg(F.sum("total").alias("total")).scalar()
    best = by_product.orderBy(F.desc("total"), "product_key").limit(check_limit(limit))
    listed = best.select(F.col("product_key").alias("listed_key"))
    same = F.col("product_key").eqNullSafe(F.col("listed_key"))
    orders = (
        sales.select("product_key", "sales_order_number")
        .join(F.broadcast(listed), same, "left_semi")  # at most `limit` keys
        .groupBy(F.col("product_key").alias("listed_key"))
        .agg(F.count_distinct("sales_order_number").alias("order_count"))
    )
    # Names of the listed products only: product keys are unique, so at most `limit` rows.
    names = shown_products(t).join(
        F.broadcast(listed), F.col("product_key") == F.col("listed_key"), "left_semi"
    )
    return (
        best.join(F.broadcast(orders), same, "left")
        .join(F.broadcast(names), "product_key", "left")
        .withColumn("share", F.coalesce(quotient(F.col("total"), grand_total), F.lit(0.0)))
        .orderBy(F.desc("total"), "product_key")
        .select(
            "product_key",
            "product_name",
            "product_line",
            "color",
            "size",
            cents(F.col("total")).alias("sales_amount"),
            "order_count",
            rounded(F.col("share"), 4).alias("contribution_rate"),
            F.when(F.col("share") >= labels.high_contribution_share, "high_contribution")
            .otherwise("stable")
            .alias("product_health"),
        )
    )


def first_rows(rows: DataFrame, limit: int | None, *order) -> DataFrame:
    return rows if limit is None else rows.orderBy(*order).limit(limit)


def by_place(sales: DataFrame, t: SalesTables, listed: DataFrame) -> DataFrame:
    """Exact sales, customers and orders of each listed place.

    Lines are first summed by customer and order, combined before their only shuffle.
    A customer has one place, so these pairs meet it after that, as a number, and all
    figures come from them, in one pass; names are joined last.
    """
    place_of = customers(t).join(
        t.side("geography", listed.select("geography_key", "place_key")), "geography_key"
    )
    place_of = t.side("customer", place_of.drop("geography_key"), "customer_key", "place_key")
    names = listed.where(F.col("geography_key") == F.col("place_key")).drop("geography_key")
    pairs = (
        sales.where(F.col("customer_key").isNotNull())
        .groupBy("customer_key", "sales_order_number")
        .agg(F.sum("sales_amount").alias("total"))
        .join(place_of, "customer_key")
    )
    found = pairs.groupBy("place_key").agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("total"),
        F.count_distinct("customer_key").alias("customer_count"),
        F.count_distinct("sales_order_number").alias("order_count"),
    )
    return found.join(t.side("geography", names), "place_key").drop("place_key")


def geo(
    t: SalesTables, limit: int | None = PLACES_SHOWN, labels: LabelRules = LABELS
) -> DataFrame:
    """The places with most sales, or all for no limit. Only Internet lines have a place."""
    listed = places(t).where(F.col("country").isNotNull())
    found = by_place(internet_lines(t, LINE_EXACT), t, listed)
    best = first_rows(found, limit, F.desc("total"), "country", "state_province", "city")
    largest = best.agg(F.max("total")).scalar()
    # A largest amount of 0 counts as 1.
    bar = F.when(largest == 0, F.lit(1)).otherwise(largest) * F.lit(labels.high_value_fraction).cast(
        "decimal(3,2)"
    )
    return (
        best.withColumn("high", F.col("total") >= bar)
        .orderBy(F.desc("total"), "country", "state_province", "city")
        .select(
            "country",
            "state_province",
            "city",
            cents(F.col("total")).alias("sales_amount"),
            "customer_count",
            "order_count",
            F.when(F.col("high"), "high_value").otherwise("potential").alias("region_level"),
        )
    )
