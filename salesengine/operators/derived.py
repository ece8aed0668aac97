"""Tables derived from metric rows for display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesengine.functions.exact import SUM_CENTS, cents, quotient, rounded
from salesengine.functions.filters import CHANNELS, Filters, check_limit
from salesengine.functions.labels import month_index, month_label, product_label
from salesengine.operators.filtered import is_in_trailing_year, product_months, product_totals
from salesengine.operators.unify import sales_in_cents, shown_products
from salesengine.sources.star import SalesTables

# Fixed values of the display.
PLACES_RANKED = 8
SMALLEST_BAR = 8.0
SPARK_MONTHS = 6
SPARK_WIDTH = 72
SPARK_BASE = 22
SPARK_HEIGHT = 20
PIVOT_MONTHS = 6
PIVOT_PRODUCTS = 8
TILE_FIGURES = ("sales_amount", "order_count", "sales_ratio", "order_ratio")


def mom_growth_pct(trend: DataFrame) -> DataFrame:
    """Growth over the row before in percent, one decimal.

    The first row has 0; a previous amount of 0 counts as 1.
    """
    amount = F.col("sales_amount").cast(SUM_CENTS)
    before = F.lag(amount).over(Window.orderBy("year", "month"))  # over monthly rows
    base = F.when(before == 0, F.lit(1).cast(SUM_CENTS)).otherwise(before)
    growth = F.when(before.isNull(), 0.0).otherwise(quotient((amount - base) * 100, base))
    return trend.select(
        "year",
        "month",
        month_label(F.col("year_month"), F.col("year"), F.col("month")).alias("month_label"),
        "sales_amount",
        rounded(growth, 1).alias("growth_pct"),
    ).orderBy("year", "month")


def channel_tiles(channels: DataFrame) -> DataFrame:
    """One row with the figures of both channels, zeros for an absent one."""
    tiles = []
    for channel in CHANNELS:
        of_channel = F.col("sales_channel") == F.lit(channel)
        for figure in TILE_FIGURES:
            value = F.max(F.when(of_channel, F.col(figure)))
            zero = F.lit(0).cast(channels.schema[figure].dataType)
            tiles.append(F.coalesce(value, zero).alias(f"{channel.lower()}_{figure}"))
    return channels.agg(*tiles)


def geo_rank(geo: DataFrame, limit: int = PLACES_RANKED) -> DataFrame:
    """The first places of a geo module with bars relative to the largest.

    Rows are not summed by country: a country is listed once for each place.
    """
    order = [F.desc("sales_amount"), F.asc("country"), F.asc("state_province"), F.asc("city")]
    first = geo.orderBy(*order).limit(limit)
    largest = F.max("sales_amount").over(Window.partitionBy())  # over the rows just limited
    bar = rounded(
        quotient(
            F.col("sales_amount").cast(SUM_CENTS) * 100,
            F.when(largest == 0, 1.0).otherwise(largest).cast(SUM_CENTS),
        ),
        4,
    )
    place = F.row_number().over(Window.orderBy(*order))
    name = F.coalesce(
        F.nullif(F.col("country"), F.lit("")),
        F.nullif(F.col("city"), F.lit("")),
        F.concat(F.lit("Region "), place.cast("string")),
    )
    return first.select(
        place.alias("place"),
        name.alias("name"),
        "sales_amount",
        F.greatest(F.lit(SMALLEST_BAR), bar).alias("bar_width"),
    ).orderBy("place")


def _point(value: Column, index: Column, last: Column, low: Column, high: Column) -> Column:
    span = high - low
    x = index.cast("double") / F.greatest(last, F.lit(1)).cast("double") * SPARK_WIDTH
    y = F.lit(float(SPARK_BASE)) - (value - low) / F.when(span == 0, 1.0).otherwise(
        span
    ) * SPARK_HEIGHT
    digit = [c.cast("decimal(38,10)").cast("decimal(9,1)").cast("string") for c in (x, y)]
    return F.concat(digit[0], F.lit(","), digit[1])


def sparkline(panel: DataFrame) -> DataFrame:
    """For each product and month the line through its last six months.

    A product's window holds its monthly rows only. The scale always includes
    0, and reaches at least up to 1.
    """
    trailing = (
        Window.partitionBy("product_key").orderBy("year", "month").rowsBetween(1 - SPARK_MONTHS, 0)
    )
    values = panel.withColumn(
        "amounts", F.collect_list(F.coalesce("sales_amount", F.lit(0.0))).over(trailing)
    )
    low = F.least(F.array_min("amounts"), F.lit(0.0))
    high = F.greatest(F.array_max("amounts"), F.lit(1.0))
    last = F.size("amounts") - 1
    points = F.transform("amounts", lambda v, i: _point(v, i, last, low, high))
    return values.select(
        "product_key",
        "year",
        "month",
        month_label(F.col("year_month"), F.col("year"), F.col("month")).alias("month_label"),
        "sales_amount",
        F.array_join(points, " ").alias("points"),
    )


def product_month_pivot(
    t: SalesTables,
    f: Filters = Filters(),
    product_key: int | None = None,
    limit: int = PIVOT_PRODUCTS,
) -> DataFrame:
    """The last six months of one product and of the other top products.

    The chosen product (the best-selling one if none is named) leads and fixes
    the months, month_6 being its latest; others follow by their sales, up to
    the limit, which at most MAX_LIMIT products may have. Months in which a product sold nothing have 0.
    """
    ranked = product_totals(t, f).orderBy(F.desc("total"), "product_key")
    if product_key is None:
        rows = ranked.limit(check_limit(limit))
        leads = F.lit(False)
    else:
        leads = F.col("product_key") == F.lit(product_key)
        chosen = ranked.where(leads)
        rows = chosen.unionByName(ranked.where(~leads).limit(check_limit(limit) - 1))
    # From here on at most `limit` products with one row for each month.
    place = F.row_number().over(Window.orderBy(F.desc(leads), F.desc("total"), "product_key"))
    listed = rows.select("product_key", place.alias("place"))
    sales = sales_in_cents(t, f).join(
        F.broadcast(listed.select("product_key")), "product_key", "left_semi"
    )
    index = month_index(F.col("year"), F.col("month"))
    shown = (F.col("place") == 1) & F.col("in_year")
    newest_first = Window.partitionBy("product_key").orderBy(F.desc("in_year"), F.desc("index"))
    # How recent each month is for the leading product, on the rows of all.
    recent = F.max(F.when(shown, F.col("age"))).over(Window.partitionBy("index"))
    monthly = (
        product_months(sales, t, f)
        .join(F.broadcast(listed), "product_key")
        .withColumn("in_year", is_in_trailing_year(f))
        .withColumn("index", index)
        .withColumn("age", F.row_number().over(newest_first))
        .withColumn("recent", recent)
        .where(F.col("recent").between(1, PIVOT_MONTHS) | (F.col("place") > 1))
    )
    label = F.when(shown, month_label(F.lit(None).cast("string"), F.col("year"), F.col("month")))
    figures = monthly.groupBy("place", "product_key").agg(
        F.array_join(F.array_sort(F.collect_list(label)), ",").alias("months"),
        *[
            F.sum(F.when(F.col("recent") == PIVOT_MONTHS + 1 - position, F.col("total"))).alias(
                f"month_{position}"
            )
            for position in range(1, PIVOT_MONTHS + 1)
        ],
    )
    return (
        figures.join(t.side("product", shown_products(t)), "product_key")
        .select(
            "place",
            "product_key",
            product_label(F.col("product_name"), F.col("product_key")).alias("product_name"),
            "product_line",
            F.max("months").over(Window.partitionBy()).alias("months"),
            *[
                F.coalesce(cents(F.col(f"month_{i}")), F.lit(0.0)).alias(f"month_{i}")
                for i in range(1, PIVOT_MONTHS + 1)
            ],
        )
        .orderBy("place")
    )
