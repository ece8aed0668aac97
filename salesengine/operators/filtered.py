"""The live metrics, computed under the five optional filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesengine.functions.exact import LINE_EXACT, cents, quotient, rounded
from salesengine.functions.filters import CHANNELS, Filters, check_limit, check_product_key, where_all
from salesengine.functions.labels import known, month_index, year_month
from salesengine.operators.snapshot import DEFAULT_TOP, PLACES_SHOWN, by_place, first_rows
from salesengine.operators.unify import (
    RESELLER,
    dated,
    distinct_customers,
    filtered_sales,
    internet_lines,
    of_known_products,
    places,
    sales_in_cents,
    shown_products,
    side_by_side,
)
from salesengine.sources.star import SalesTables

# Fixed values of the business rules.
WINDOW_MONTHS = 12
PEAK_REASON = "No listed month sold more."
VALLEY_REASON = "No listed month sold less."

NO_FILTER = Filters()


def product_totals(t: SalesTables, f: Filters = NO_FILTER) -> DataFrame:
    """Exact sales of each product; products are matched after the sum."""
    by_product = (
        dated(sales_in_cents(t, f), t, f.first_day, f.last_day)
        .groupBy("product_key")
        .agg(F.sum("sales_amount").alias("total"))
    )
    return of_known_products(by_product, t, f)


def product_sales(t: SalesTables, f: Filters = NO_FILTER) -> DataFrame:
    return product_totals(t, f).select("product_key", cents(F.col("total")).alias("sales_amount"))


def _all_products(totals: DataFrame) -> Column:
    """Sales of all products and their number, as one value."""
    return totals.agg(
        F.struct(
            F.coalesce(F.sum("total"), F.lit(0)).alias("sales"),
            F.count("total").alias("products"),
        ).alias("all")
    ).scalar()


def _hot(totals: DataFrame) -> DataFrame:
    """sales >= all sales / products, without forming a rounded average."""
    everything = _all_products(totals)
    return totals.where(
        F.col("total") * everything.getField("products") >= everything.getField("sales")
    )


def hot_products(t: SalesTables, f: Filters = NO_FILTER) -> DataFrame:
    """Products that sell at least as much as the average product."""
    return _hot(product_totals(t, f)).select(
        "product_key", cents(F.col("total")).alias("sales_amount")
    )


def kpis(t: SalesTables, f: Filters = NO_FILTER) -> DataFrame:
    """One row of headline figures.

    Amounts come from the sums per product, which the hot products need anyway;
    the lines themselves are only read for the two distinct counts, which share one
    shuffle of orders with their customers.
    """
    totals = product_totals(t, f)
    pairs = filtered_sales(t, f).select("sales_order_number", "customer_key").distinct()
    orders = pairs.agg(F.count_distinct("sales_order_number").alias("order_count"))
    buyers = distinct_customers(pairs, t).withColumnRenamed("n", "customer_count")
    amounts = totals.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"))
    hot = _hot(totals).agg(F.count("*").alias("hot_product_count"))
    return side_by_side(orders, buyers, amounts, hot).select(
        cents(F.col("total")).alias("total_sales"),
        "order_count",
        "customer_count",
        "hot_product_count",
    )


def _window_end(last_sale: Column, f: Filters) -> Column:
    """The asked end date, or the last sale where that is earlier or none is asked."""
    if f.end_date is None:
        return last_sale
    return F.when(last_sale < F.lit(f.end_date), last_sale).otherwise(
        F.when(last_sale.isNotNull(), F.lit(f.end_date))
    )


def _last_sale(sales: DataFrame, t: SalesTables, f: Filters) -> Column:
    """The latest date among the lines of known products, from keys alone.

    With products too many to broadcast, only one row for each product is
    shuffled to meet them.
    """
    latest = F.max("full_date").alias("full_date")
    sales = dated(sales, t)
    if not t.fits_broadcast("product", "product_key"):
        sales = sales.groupBy("product_key").agg(latest)
    return of_known_products(sales, t, f).agg(latest).scalar()


def _end_of_window(sales: DataFrame, t: SalesTables, f: Filters) -> Column:
    """The end date that holds for these lines, as a value found when the plan runs.

    With an asked one, a single line after it is looked for first, among files of
    later dates. If there is one, the asked date holds, and the bound on the date keys
    of the lines that are read for their last sale lets the scan skip all of them.
    """
    if f.end_date is None:
        return _last_sale(sales, t, f)
    asked = F.lit(f.end_date).cast("date")
    later = of_known_products(dated(sales, t, first_day=F.date_add(asked, 1)), t, f)
    kind = sales.schema["order_date_key"].dataType
    none, every = (F.lit(end).cast(kind) for end in (-(2**31), 2**31 - 1))
    # one plain value, which a scan can use
    bound = later.select(none.alias("bound")).limit(1).agg(F.coalesce(F.max("bound"), every).alias("bound")).scalar()
    unread = sales.where(F.col("order_date_key") <= bound)
    return F.when(bound == none, asked).otherwise(_window_end(_last_sale(unread, t, f), f))


def _trailing_year(sales: DataFrame, t: SalesTables, f: Filters) -> DataFrame:
    """Monthly sales of the twelve calendar months up to the end date.

    The end date is found first; the main pass then only reads and shuffles
    lines inside the window. The start date does not take part. No line is
    later than the last sale, so only an asked end date bounds them.
    """
    end = _end_of_window(sales, t, f)
    first_day = F.add_months(F.trunc(end, "MM"), 1 - WINDOW_MONTHS)
    return (
        of_known_products(dated(sales, t, first_day, f.last_day), t, f)
        .groupBy("year", "month")
        .agg(
            F.sum("sales_amount").alias("total"),
            F.count_distinct("sales_order_number").alias("order_count"),
        )
        .orderBy("year", "month")
        .select(
            "year",
            "month",
            year_month(F.col("year"), F.col("month")).alias("year_month"),
            cents(F.col("total")).alias("sales_amount"),
            "order_count",
        )
    )


def trend(t: SalesTables, f: Filters = NO_FILTER) -> DataFrame:
    return _trailing_year(sales_in_cents(t, f), t, f)


def product_monthly(t: SalesTables, product_key: int, f: Filters = NO_FILTER) -> DataFrame:
    """The trend of one product; its own last sale bounds the window."""
    one = F.col("product_key") == F.lit(check_product_key(product_key))
    return _trailing_year(sales_in_cents(t, f).where(one), t, f)


def product_months(sales: DataFrame, t: SalesTables, f: Filters) -> DataFrame:
    """Sales of each product and month up to the asked end date.

    Months after the end date stay, with no sales, for their last_sale.
    """
    counted = F.lit(True) if f.end_date is None else F.col("full_date") <= F.lit(f.end_date)
    by_month = (
        dated(sales, t)
        .groupBy("product_key", "year", "month")
        .agg(
            F.sum(F.when(counted, F.col("sales_amount"))).alias("total"),
            F.count_distinct(F.when(counted, F.col("sales_order_number"))).alias("order_count"),
            F.max("full_date").alias("last_sale"),
            F.count_if(counted).alias("lines"),
        )
    )
    return of_known_products(by_month, t, f)


def is_in_trailing_year(f: Filters) -> Column:
    """Whether a row of product_months lies inside the window of its product.

    The window is a whole number of months, so it is applied to monthly rows:
    each product's last sale comes from its own months (a bounded number), and
    the lines are never joined back to a per-product end date.
    """
    end = _window_end(F.max("last_sale").over(Window.partitionBy("product_key")), f)
    age = month_index(F.year(end), F.month(end)) - month_index(F.col("year"), F.col("month"))
    return (F.col("lines") > 0) & age.between(0, WINDOW_MONTHS - 1)


def product_monthly_panel(t: SalesTables, f: Filters = NO_FILTER) -> DataFrame:
    """product_monthly of every product.

    The last sale of each product is found first, from keys and dates that are
    combined before they are shuffled. It meets the lines as two days, so only
    lines inside the window of their product are shuffled with their orders.
    """
    sales = sales_in_cents(t, f)
    last = dated(sales, t).groupBy("product_key").agg(F.max("full_date").alias("last_sale"))
    end = _window_end(F.col("last_sale"), f)
    windows = of_known_products(last, t, f).select(
        "product_key",
        F.add_months(F.trunc(end, "MM"), 1 - WINDOW_MONTHS).alias("first_day"),
        end.alias("last_day"),
    )
    windows = t.side("product", windows, "product_key", "first_day", "last_day")
    return (
        dated(sales, t, last_day=f.last_day)
        .join(windows, "product_key")
        .where(F.col("full_date").between(F.col("first_day"), F.col("last_day")))
        .groupBy("product_key", "year", "month")
        .agg(
            F.sum("sales_amount").alias("total"),
            F.count_distinct("sales_order_number").alias("order_count"),
        )
        .select(
            "product_key",
            "year",
            "month",
            year_month(F.col("year"), F.col("month")).alias("year_month"),
            cents(F.col("total")).alias("sales_amount"),
            "order_count",
        )
    )


def peak_valley(monthly: DataFrame, reasons: bool = True) -> DataFrame:
    """The months with most and least sales, the earliest one on ties.

    Works on the trend of either family; one pass over its rows.
    """
    sales = F.coalesce(F.col("sales_amount"), F.lit(0.0))
    # The month of lines without a date comes first.
    month = F.coalesce(month_index(F.col("year"), F.col("month")), F.lit(-1))
    row = F.struct(*monthly.columns)
    # Equal sales: the peak ordering prefers the smaller month by its negative.
    ends = monthly.agg(
        F.max_by(row, F.struct(sales, -month)).alias("peak"),
        F.min_by(row, F.struct(sales, month)).alias("valley"),
    ).where(F.col("peak").isNotNull())
    kinds = F.array(
        F.struct(
            F.lit("peak").alias("kind"), F.lit(PEAK_REASON).alias("reason"), F.col("peak").alias("r")
        ),
        F.struct(
            F.lit("valley").alias("kind"),
            F.lit(VALLEY_REASON).alias("reason"),
            F.col("valley").alias("r"),
        ),
    )
    out = ends.select(F.explode(kinds).alias("k"))
    columns = ["k.kind", "k.r.*"] + (["k.reason"] if reasons else [])
    return out.select(*columns)


def trend_peak_valley(t: SalesTables, f: Filters = NO_FILTER) -> DataFrame:
    return peak_valley(trend(t, f))


def top_products(t: SalesTables, f: Filters = NO_FILTER, limit: int = DEFAULT_TOP) -> DataFrame:
    """The best-selling products under the filters.

    As in the snapshot, orders are counted only for the listed products.
    """
    best = (
        product_totals(t, f).orderBy(F.desc("total"), "product_key").limit(check_limit(limit))
    )
    orders = (
        dated(sales_in_cents(t, f), t, f.first_day, f.last_day)
        .select("product_key", "sales_order_number")
        .join(F.broadcast(best.select("product_key")), "product_key", "left_semi")
        .groupBy("product_key")
        .agg(F.count_distinct("sales_order_number").alias("order_count"))
    )
    names = shown_products(t).join(
        F.broadcast(best.select("product_key")), "product_key", "left_semi"
    )
    return (
        best.join(F.broadcast(orders), "product_key")  # at most `limit` rows
        .join(F.broadcast(names), "product_key")
        .orderBy(F.desc("total"), "product_key")
        .select(
            "product_key",
            "product_name",
            "product_line",
            "color",
            "size",
            cents(F.col("total")).alias("sales_amount"),
            "order_count",
        )
    )


def geo(
    t: SalesTables, f: Filters = NO_FILTER, limit: int | None = PLACES_SHOWN
) -> DataFrame:
    """The places with most Internet sales, or all for no limit; none for resellers.

    Amounts are summed exactly and rounded after the sum.
    """
    country = [F.col("country") == F.lit(f.country)] if f.country else []
    sales = dated(internet_lines(t, LINE_EXACT), t, f.first_day, f.last_day)
    if f.channel == RESELLER:
        sales = sales.where(F.lit(False))
    found = by_place(of_known_products(sales, t, f), t, where_all(places(t), country))
    figures = found.select(
        "country",
        "state_province",
        "city",
        cents(F.col("total")).alias("sales_amount"),
        "customer_count",
        "order_count",
    )
    order = [F.desc("sales_amount"), "country", "state_province", "city"]
    return first_rows(figures, limit, *order).orderBy(*order)


def channels(t: SalesTables, f: Filters = NO_FILTER) -> DataFrame:
    """Shares of the channels; NULL where a total or an order count is 0."""
    by_channel = (
        filtered_sales(t, f)
        .groupBy("sales_channel")
        .agg(
            F.sum("sales_amount").alias("total"),
            F.count_distinct("sales_order_number").alias("order_count"),
        )
    )
    every = Window.partitionBy()  # over the two channel rows
    return by_channel.select(
        "sales_channel",
        cents(F.col("total")).alias("sales_amount"),
        "order_count",
        rounded(quotient(F.col("total"), F.sum("total").over(every)), 4).alias("sales_ratio"),
        rounded(quotient(F.col("order_count"), F.sum("order_count").over(every)), 4).alias(
            "order_ratio"
        ),
        rounded(quotient(F.col("total"), F.col("order_count")), 2).alias("avg_order_amount"),
    ).orderBy(F.desc("sales_amount"), "sales_channel")


def filter_options_grouped(t: SalesTables) -> DataFrame:
    """The values of each filter as one list, with the fixed list of channels."""
    channel_rows = F.array(*[F.lit(c) for c in CHANNELS])
    grouped = (
        filter_options(t)
        .groupBy("option_type")
        .agg(F.array_sort(F.collect_list("option_value")).alias("option_values"))
    )
    channel_list = t.date.sparkSession.range(1).select(
        F.lit("channel").alias("option_type"), channel_rows.alias("option_values")
    )
    return grouped.unionByName(channel_list)


def filter_options(t: SalesTables) -> DataFrame:
    """The values each filter can take, one row for each."""

    def options(kind: str, source: DataFrame, value: Column) -> DataFrame:
        return source.select(
            F.lit(kind).alias("option_type"), value.cast("string").alias("option_value")
        ).distinct()

    countries = t.geography.where(F.col("EnglishCountryRegionName").isNotNull())
    return (
        options("product_line", t.product, known(F.col("ProductLine")))
        .unionByName(options("country", countries, F.col("EnglishCountryRegionName")))
        .unionByName(options("year", t.date, F.col("CalendarYear")))
        .orderBy("option_type", "option_value")
    )
