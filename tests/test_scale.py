"""The ways taken by large or skewed tables give the same results."""

import contextlib
import re
from dataclasses import replace

import pytest
from conftest import SMALL, rows
from test_plans import explained

from pyspark.sql import functions as F

from salesengine.functions.filters import Filters
from salesengine.operators import catalog, derived, filtered, snapshot, unify
from salesengine.plans import job
from salesengine.session import TARGET_PARTITION_BYTES, shuffle_partitions
from salesengine.sources.scratch import scratch_folder
from salesengine.sources.star import ROW_OVERHEAD, SalesTables, checked
from salesengine.sources.testcatalog import catalog_state, changes
from salesengine.sources.testmap import load_star, star_views


@contextlib.contextmanager
def settings(spark, **values):
    before = {key: spark.conf.get(key) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


NOTHING_BROADCAST = {"spark.sql.autoBroadcastJoinThreshold": "-1"}
SKEW = {
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}
F2 = Filters(end_date="2000-03-31", country="EUROPE")
METRICS = {
    "sales_wide": lambda t: unify.sales_wide(t).orderBy("sales_order_number", "product_key", "sales_amount"),
    "kpis": snapshot.kpis,
    "trend": snapshot.trend,
    "channels": snapshot.channels,
    "top": lambda t: snapshot.top_products(t, 50),
    "geo": snapshot.geo,
    "live_kpis": filtered.kpis,
    "live_kpis_country": lambda t: filtered.kpis(t, F2),
    "live_trend": filtered.trend,
    "live_trend_country": lambda t: filtered.trend(t, F2),
    "live_top": lambda t: filtered.top_products(t, F2, 50),
    "live_geo": lambda t: filtered.geo(t, F2),
    "panel": lambda t: filtered.product_monthly_panel(t, F2).orderBy("product_key", "year", "month"),
    "pivot": derived.product_month_pivot,
    "alerts": job.snapshot_alerts,
    "overlay": lambda t: job.live_ranking(t, Filters(), 50, catalog_state(t)),
    "changes": lambda t: catalog.apply_changes(catalog_state(t), changes(t)).catalog.orderBy(
        "product_key"
    ),
}


@pytest.mark.parametrize("name", sorted(METRICS))
def test_same_results_without_broadcast(spark, name):
    t = load_star(spark, SMALL)
    large = replace(t, broadcast_bytes=0)
    with_broadcast = rows(METRICS[name](t))
    with settings(spark, **NOTHING_BROADCAST):
        assert rows(METRICS[name](large)) == with_broadcast


def test_dimensions_beyond_the_bound_are_not_broadcast(spark):
    t = load_star(spark, SMALL)
    assert t.fits_broadcast("product") and t.fits_broadcast("customer")
    # Four sides share the bound, and every row takes more than its values.
    size = t.sizes["product"]
    need = 4 * (size.bytes + ROW_OVERHEAD * size.rows)
    assert replace(t, broadcast_bytes=need).fits_broadcast("product")
    tight = replace(t, broadcast_bytes=need - 4)
    assert not tight.fits_broadcast("product")
    # Keys alone need less than whole rows.
    assert tight.fits_broadcast("product", "product_key")
    keys = 4 * (8 + ROW_OVERHEAD) * size.rows
    assert not replace(t, broadcast_bytes=keys - 4).fits_broadcast("product", "product_key")
    # Customers carry their place: their own size alone does not decide.
    customers = t.sizes["customer"]
    own = replace(t, broadcast_bytes=4 * (customers.bytes + ROW_OVERHEAD * customers.rows))
    assert own.fits_broadcast("customer") and not own.fits_broadcast("customer", with_place=True)
    assert not replace(t, sizes={}, counted=False).fits_broadcast("date")
    with settings(spark, **NOTHING_BROADCAST):
        joined = explained(unify.sales_wide(replace(t, broadcast_bytes=0)))
        assert "BroadcastHashJoin" not in joined and "SortMergeJoin" in joined


def test_dimensions_are_counted_when_first_joined(spark):
    t = checked(star_views(spark, SMALL))
    snapshot.kpis(t)
    assert t.sizes == {}
    snapshot.trend(t)
    assert set(t.sizes) == {"date"}


def test_panel_counts_orders_inside_the_windows_only(spark):
    """The days of a product meet its lines below the distinct count."""
    plan = explained(filtered.product_monthly_panel(load_star(spark, SMALL)), "simple")
    top = plan.index("count(distinct" if "count(distinct" in plan else "count(sales_order_number")
    joined = re.search(r"full_date[^\n]*>= first_day", plan)
    assert joined and joined.start() > top


def test_sparse_numbers_are_dealt_evenly(spark):
    batch = spark.range(2_000).select((F.col("id") * 1_000_003).alias("seq"))
    out = catalog.numbered(batch)
    found = {r["seq"]: r["position"] for r in rows(out)}
    assert found == {i * 1_000_003: i + 1 for i in range(2_000)}
    buckets = re.findall(r"Window \[sum\(n[^\n]*", explained(out, "simple"))
    assert buckets  # offsets are summed over the buckets alone
    sizes = batch.select(F.col("seq")).count() / catalog.NUMBERING_BUCKETS
    assert sizes < 10


@pytest.fixture(scope="module")
def stored_facts(spark):
    """The small folder with its Internet fact as files of one date range each."""
    t = load_star(spark, SMALL)
    path = f"{scratch_folder(spark)}/internet"
    t.internet.repartitionByRange(8, "OrderDateKey").write.parquet(path)
    return replace(t, internet=spark.read.parquet(path))


def test_date_filters_reach_the_scan_of_the_facts(spark, stored_facts):
    f = Filters(start_date="2000-07-01", end_date="2000-12-31", channel="Internet")
    for df in (filtered.product_sales(stored_facts, f), filtered.trend(stored_facts, f)):
        with settings(spark, **{"spark.sql.maxMetadataStringLength": "2000"}):
            plan = explained(df, "simple")
        assert "GreaterThanOrEqual(OrderDateKey,ScalarSubquery" in plan
        assert "LessThanOrEqual(OrderDateKey,ScalarSubquery" in plan
    # Without an end date the window is still bounded from below.
    with settings(spark, **{"spark.sql.maxMetadataStringLength": "2000"}):
        open_ended = explained(filtered.trend(stored_facts, Filters(channel="Internet")), "simple")
    assert "GreaterThanOrEqual(OrderDateKey,ScalarSubquery" in open_ended
    assert "ScalarSubquery" not in explained(filtered.product_sales(stored_facts), "simple")


@pytest.mark.parametrize("end", ["2000-12-31", "1990-01-01", "2030-01-01"])
def test_stored_facts_give_the_same_results(spark, stored_facts, end):
    t = load_star(spark, SMALL)
    f = Filters(end_date=end, channel="Internet")
    for metric in (filtered.kpis, filtered.trend, filtered.top_products):
        assert rows(metric(stored_facts, f)) == rows(metric(t, f))


LINES = 300_000


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the lines belongs to one product, one customer and one order."""
    n = F.col("id")
    hot = n % 3 == 0
    lines = spark.range(0, LINES, 1, 6).select(
        (F.lit(20010101) + (n % 28).cast("int")).alias("OrderDateKey"),
        F.when(hot, 1).otherwise(2 + n % 5000).cast("bigint").alias("ProductKey"),
        F.when(hot, 1).otherwise(2 + n % 7000).cast("bigint").alias("CustomerKey"),
        F.when(hot, "S1").otherwise(F.concat(F.lit("S"), (n % 90_000 + 2).cast("string"))).alias(
            "SalesOrderNumber"
        ),
        F.lit(1).cast("decimal(18,4)").alias("SalesAmount"),
    )
    day = F.to_date((F.col("id") + 20010101).cast("string"), "yyyyMMdd")
    return checked(
        SalesTables(
            internet=lines,
            reseller=lines.where("false").drop("CustomerKey"),
            date=spark.range(28).select(
                (F.col("id") + 20010101).cast("int").alias("DateKey"),
                day.alias("FullDateAlternateKey"),
                F.year(day).alias("CalendarYear"),
                F.month(day).alias("MonthNumberOfYear"),
            ),
            product=spark.range(1, 5002).select(
                F.col("id").alias("ProductKey"),
                F.concat(F.lit("P"), "id").alias("EnglishProductName"),
                F.lit("R").alias("ProductLine"),
                F.lit("Red").alias("Color"),
                F.lit("M").alias("Size"),
                F.lit(1.0).alias("ListPrice"),
                F.lit("Model").alias("ModelName"),
            ),
            customer=spark.range(1, 7002).select(
                F.col("id").alias("CustomerKey"), (F.col("id") % 10 + 1).alias("GeographyKey")
            ),
            geography=spark.range(1, 11).select(
                F.col("id").alias("GeographyKey"),
                F.lit("Land").alias("EnglishCountryRegionName"),
                F.concat(F.lit("State "), "id").alias("StateProvinceName"),
                F.lit("City").alias("City"),
            ),
        )
    )


def test_hot_keys_with_large_dimensions(spark, skewed):
    large = replace(skewed, broadcast_bytes=0)
    with settings(spark, **NOTHING_BROADCAST, **SKEW):
        wide = unify.filtered_sales(large)
        assert wide.count() == LINES
        (kpis,) = rows(filtered.kpis(large))
        assert kpis["total_sales"] == LINES
        assert kpis["customer_count"] == len({1, *(2 + n % 7000 for n in range(LINES) if n % 3)})
        assert kpis["order_count"] == len({1, *(2 + n % 90_000 for n in range(LINES) if n % 3)})
        assert kpis["hot_product_count"] == 1
        first = snapshot.top_products(large, 1).first()
        assert (first["product_key"], first["sales_amount"], first["order_count"]) == (
            1,
            LINES / 3,
            1,
        )
        assert first["contribution_rate"] == 0.3333
        places = rows(snapshot.geo(large))
        assert sum(p["sales_amount"] for p in places) == LINES
        assert places[0]["state_province"] == "State 2"  # the place of customer 1


def test_a_hot_key_is_split_over_tasks(spark, skewed):
    """Joining lines to customers too many to broadcast, AQE splits the hot one."""
    large = replace(skewed, broadcast_bytes=0)
    with settings(spark, **NOTHING_BROADCAST, **SKEW):
        wide = unify.unified_sales_geo(large)
        assert len(wide.collect()) == LINES
        assert "skew=true" in explained(wide, "simple")


def test_shuffle_partitions_grow_with_the_data():
    assert shuffle_partitions(0, 8) == 8
    assert shuffle_partitions(25 * 2**40, 8000) == 25 * 2**40 // TARGET_PARTITION_BYTES
