"""Business rules that turn metric rows into alerts.

Each rule is a DataFrame of no or one row (the watch list: up to two), so the
alerts of a family are a union. Rules read the published figures, that is the
rounded ones. Amounts are compared as decimals, so a bound is met exactly.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesengine.functions.exact import SUM_CENTS
from salesengine.functions.labels import month_index, product_label


@dataclass(frozen=True)
class AlertThresholds:
    # Fixed values of the business rules.
    sales_drop: Decimal = Decimal("0.85")
    top_product_share: float = 0.18
    channel_share: float = 0.75
    region_sales: Decimal = Decimal("0")
    volatility: Decimal = Decimal("0.65")
    watched_products: int = 2


DEFAULT = AlertThresholds()


def _exact(amount: Column) -> Column:
    return F.coalesce(amount, F.lit(0.0)).cast(SUM_CENTS)


def _alert(
    rows: DataFrame,
    order: Column | int,
    level: str,
    kind: str,
    title: str,
    description: Column,
    metric: Column,
    value: Column,
    reference: Column,
) -> DataFrame:
    return rows.select(
        (F.lit(order) if isinstance(order, int) else order).cast("int").alias("rule_order"),
        F.lit(level).alias("level"),
        F.lit(kind).alias("type"),
        F.lit(title).alias("title"),
        description.alias("description"),
        F.to_json(metric).alias("metric"),
        value.cast("double").alias("metric_value"),
        reference.cast("double").alias("metric_reference"),
    )


def _row(df: DataFrame, prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c).alias(c) for c in df.columns])


def sales_drop(trend: DataFrame, limits: AlertThresholds = DEFAULT) -> DataFrame:
    by_month = Window.orderBy("year", "month")  # over monthly rows
    # Column by column, so that figures nobody reads are not computed.
    before = [F.lag(c).over(by_month).alias(f"previous_{c}") for c in trend.columns]
    place = F.row_number().over(by_month).alias("place")
    last = (
        trend.select("*", *before, place)
        .orderBy(F.desc("place"))
        .limit(1)
        .where(F.col("place") > 1)
        .where(
            _exact(F.col("sales_amount"))
            < _exact(F.col("previous_sales_amount")) * F.lit(limits.sales_drop)
        )
    )
    return _alert(
        last,
        1,
        "high",
        "sales_drop",
        "Latest month below its bound",
        F.concat(
            F.col("year_month"),
            F.lit(f" reached less than {limits.sales_drop} of the sales of "),
            F.col("previous_year_month"),
            F.lit("."),
        ),
        F.struct(_row(trend).alias("current"), _row(trend, "previous_").alias("previous")),
        F.col("sales_amount"),
        F.col("previous_sales_amount"),
    )


def top_product_dependency(products: DataFrame, limits: AlertThresholds = DEFAULT) -> DataFrame:
    first = (
        products.orderBy(F.desc("sales_amount"), "product_key")
        .limit(1)
        .where(F.col("contribution_rate") >= F.lit(limits.top_product_share))
    )
    return _alert(
        first,
        2,
        "medium",
        "top_product_dependency",
        "One product above its share",
        F.concat(
            F.lit("Product "),
            F.col("product_key").cast("string"),
            F.lit(f" makes {limits.top_product_share} or more of all sales."),
        ),
        _row(products),
        F.col("contribution_rate"),
        F.lit(limits.top_product_share),
    )


def channel_imbalance(channels: DataFrame, limits: AlertThresholds = DEFAULT) -> DataFrame:
    largest = (
        channels.orderBy(F.desc("sales_ratio"), F.desc("sales_amount"), "sales_channel")
        .limit(1)
        .where(F.col("sales_ratio") >= F.lit(limits.channel_share))
    )
    return _alert(
        largest,
        3,
        "medium",
        "channel_imbalance",
        "One channel above its share",
        F.concat(
            F.col("sales_channel"),
            F.lit(f" makes {limits.channel_share} or more of all sales."),
        ),
        _row(channels),
        F.col("sales_ratio"),
        F.lit(limits.channel_share),
    )


def high_value_region(geo: DataFrame, limits: AlertThresholds = DEFAULT) -> DataFrame:
    first = (
        geo.orderBy(F.desc("sales_amount"), "country", "state_province", "city")
        .limit(1)
        .where(_exact(F.col("sales_amount")) >= F.lit(limits.region_sales))
    )
    place = F.coalesce(
        F.nullif(F.col("country"), F.lit("")), F.nullif(F.col("city"), F.lit("")), F.lit("A place")
    )
    return _alert(
        first,
        4,
        "info",
        "high_value_region",
        "Place with most sales",
        F.concat(place, F.lit(" is first by sales of all places listed.")),
        _row(geo),
        F.col("sales_amount"),
        F.lit(None),
    )


def snapshot_alerts(
    kpis: Callable[[], DataFrame],
    trend: Callable[[], DataFrame],
    products: Callable[[], DataFrame],
    channels: Callable[[], DataFrame],
    geo: Callable[[], DataFrame],
    limits: AlertThresholds = DEFAULT,
) -> DataFrame:
    """The alerts of the published modules; a stable notice if none fires.

    The rules are asked when this is called, four rows at most, and the result holds
    their answers. Each is a job of its own, planned and handed to Spark beside the
    others; the headline figures are only computed if none of them fires.
    """

    def ask(rule: Callable[..., DataFrame], module: Callable[[], DataFrame]) -> tuple:
        asked = rule(module(), limits)
        return asked.collect(), asked.schema, asked.sparkSession  # a row at most

    rules = {
        sales_drop: trend,
        top_product_dependency: products,
        channel_imbalance: channels,
        high_value_region: geo,
    }
    with ThreadPoolExecutor(max_workers=len(rules)) as pool:
        answers = list(pool.map(ask, rules, rules.values()))
    fired = [row for rows, _, _ in answers for row in rows]
    if not fired:
        return stable(kpis())
    # a column may hold nulls if it may in the answer of any rule
    schema = T.StructType(
        [
            T.StructField(same[0].name, same[0].dataType, any(f.nullable for f in same))
            for same in zip(*(schema for _, schema, _ in answers))
        ]
    )
    return answers[0][2].createDataFrame(fired, schema)


def stable(kpis: DataFrame) -> DataFrame:
    return _alert(
        kpis,
        5,
        "info",
        "stable_operation",
        "No rule fired",
        F.lit("All figures are within their bounds."),
        _row(kpis),
        F.col("total_sales"),
        F.lit(None),
    )


def monthly_volatility(monthly: DataFrame, limits: AlertThresholds = DEFAULT) -> DataFrame:
    sales = F.coalesce(F.col("sales_amount"), F.lit(0.0))
    month = month_index(F.col("year"), F.col("month"))
    highest, lowest = F.struct(sales, -month), F.struct(sales, month)
    ends = monthly.agg(
        *[F.max_by(c, highest).alias(f"peak_{c}") for c in monthly.columns],
        *[F.min_by(c, lowest).alias(f"valley_{c}") for c in monthly.columns],
    ).where(
        (_exact(F.col("peak_sales_amount")) != 0)
        & (
            _exact(F.col("valley_sales_amount"))
            < _exact(F.col("peak_sales_amount")) * F.lit(limits.volatility)
        )
    )
    return _alert(
        ends,
        1,
        "high",
        "monthly_volatility",
        "Months far apart",
        F.concat(
            F.col("valley_year_month"),
            F.lit(f" reached less than {limits.volatility} of the sales of "),
            F.col("peak_year_month"),
            F.lit("."),
        ),
        F.struct(_row(monthly, "peak_").alias("peak"), _row(monthly, "valley_").alias("valley")),
        F.col("valley_sales_amount"),
        F.col("peak_sales_amount"),
    )


def top_product_watch(products: DataFrame, limits: AlertThresholds = DEFAULT) -> DataFrame:
    """One alert for each of the first products of the ranking shown to users."""
    place = F.row_number().over(Window.orderBy(F.desc("sales_amount"), "product_key"))
    watched = (
        products.orderBy(F.desc("sales_amount"), "product_key")
        .limit(limits.watched_products)
        .withColumn("place", place)  # over the rows just limited
    )
    return _alert(
        watched,
        F.col("place") + 1,
        "medium",
        "top_product_watch",
        "Leading product",
        F.concat(
            product_label(F.col("product_name"), F.col("product_key")),
            F.lit(" is number "),
            F.col("place").cast("string"),
            F.lit(" by sales."),
        ),
        _row(products),
        F.col("sales_amount"),
        F.col("order_count"),
    )


def live_alerts(
    monthly: DataFrame, products: DataFrame, limits: AlertThresholds = DEFAULT
) -> DataFrame:
    """The alerts of the filtered family: volatility first, then the watch list."""
    return (
        monthly_volatility(monthly, limits)
        .unionByName(top_product_watch(products, limits))
        .orderBy("rule_order")
    )
