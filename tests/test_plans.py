"""What the plans look like: pruning, pushdown, top-N, no product of tables."""

import contextlib
import io
import re
from dataclasses import replace

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from __spark_entry__ import queries
from salesengine.functions.filters import Filters
from salesengine.operators import filtered, snapshot, unify
from salesengine.sources.star import TABLE_NAMES, load_files
from salesengine.sources.testmap import load_star

# These start jobs of their own while they are built, or work on texts.
PUBLISHING = re.compile(r"published|read_or_compute|result|output|report|op\d+_|pipeline")


def explained(df, mode="formatted"):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


def scans(df):
    return re.findall(r"Location: InMemoryFileIndex \[[^\]]*/(\w+)\.parquet\]", explained(df))


def columns_read(df, table):
    plan = explained(df)
    read = re.findall(rf"/{table}\.parquet\][\s\S]*?ReadSchema: struct<([^>]*)>", plan)
    return [{c.split(":")[0] for c in text.split(",")} for text in read]


@pytest.fixture(scope="module")
def t(spark):
    return load_star(spark, SMALL)


def test_channel_filter_drops_the_other_fact(t):
    both = scans(unify.filtered_sales(t))
    one = scans(unify.filtered_sales(t, Filters(channel="Internet")))
    assert both.count("lineitem") == 2
    assert one.count("lineitem") == 1


def test_contradicting_filters_read_nothing(t):
    sales = unify.filtered_sales(t, Filters(country="EUROPE", channel="Reseller"))
    assert "lineitem" not in scans(sales)


def test_country_filter_drops_resellers(t):
    assert scans(unify.filtered_sales(t, Filters(country="EUROPE"))).count("lineitem") == 1


def test_resellers_have_no_places_to_read(t):
    assert scans(filtered.geo(t, Filters(channel="Reseller"))) == []


def test_headline_figures_read_no_dimension(t):
    assert set(scans(snapshot.kpis(t))) == {"lineitem", "orders"}


def test_customers_are_read_only_for_places(t):
    for df in (snapshot.trend(t), snapshot.channels(t), filtered.trend(t), filtered.kpis(t)):
        assert "customer" not in scans(df)


def test_only_used_columns_are_read(t):
    for read in columns_read(filtered.product_sales(t), "lineitem"):
        assert read == {"l_orderkey", "l_partkey", "l_extendedprice"}
    for read in columns_read(snapshot.channels(t), "lineitem"):
        assert read == {"l_orderkey", "l_extendedprice"}


@pytest.mark.parametrize("build", [snapshot.top_products, filtered.top_products, snapshot.geo])
def test_rankings_never_sort_everything(t, build):
    assert "TakeOrderedAndProject" in explained(build(t))


def test_rankings_count_orders_of_listed_products_only(t):
    plan = explained(snapshot.top_products(t))
    assert "LeftSemi" in plan


def test_sums_are_combined_before_the_shuffle(t):
    plan = explained(filtered.product_sales(t))
    assert "partial_sum" in plan


def test_product_sums_are_computed_once(t):
    """The average takes the sums from the shuffle the products go through."""
    df = filtered.hot_products(t)
    df.collect()
    assert re.search(
        r"ReusedExchange \[product_key[^\]]*\], Exchange hashpartitioning\(product_key",
        explained(df, "simple"),
    )


@pytest.mark.parametrize("name", sorted(n for n in queries() if not PUBLISHING.search(n)))
def test_no_product_of_tables_and_no_python(spark, name):
    plan = explained(queries()[name](spark, SMALL), "simple")
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEval", "MapInPandas"):
        assert operator not in plan


def test_trends_start_no_job_while_they_are_built(spark, t):
    for name in ("product", "date", "customer", "geography"):
        t.size(name)  # counted once, when first joined
    tracker, group = spark.sparkContext.statusTracker(), "built"
    spark.sparkContext.setJobGroup(group, group)
    try:
        f = Filters(end_date="1995-06-30", country="EUROPE")
        dfs = [filtered.trend(t, f), filtered.product_monthly(t, 5, f), filtered.trend(t), filtered.trend_peak_valley(t, f)]
        assert list(tracker.getJobIdsForGroup(group)) == []
        assert dfs[0].collect()
        assert list(tracker.getJobIdsForGroup(group)) != []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_the_last_sale_is_not_read_where_a_later_one_exists(spark, star, tmp_path):
    lines = [(20130101, 1, 1, "A", 5), (20130401, 1, 1, "B", 6), (20130901, 1, 1, "C", 7), (20140101, 1, 1, "D", 8)]
    made = star(internet=lines, days=sorted({x[0] for x in lines} | {20130630}))
    for name, table in TABLE_NAMES.items():
        getattr(made, name).write.parquet(f"{tmp_path}/{table}")
    t = load_files(spark, str(tmp_path))
    for end, holds in (("2013-06-30", "2013-06-30"), ("2013-09-01", "2013-09-01"), ("2030-01-01", "2014-01-01")):
        f = Filters(end_date=end, channel="Internet")
        day = filtered._end_of_window(unify.sales_in_cents(t, f), t, f)
        df = spark.range(1).select(day.alias("end"))
        assert str(df.first()["end"]) == holds
        # the scan for the last sale gets the outcome of the search as a plain value
        assert re.search(r"\(OrderDateKey#\d+ <= scalar-subquery", explained(df, "extended"))


def test_lines_are_shuffled_once_for_places(spark, t):
    wide = replace(t, broadcast_bytes=0)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = snapshot.by_place(unify.internet_lines(wide, unify.LINE_EXACT), wide, unify.places(wide))
        df.collect()
        plan = explained(df, "simple")
        final = plan.split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    # lines meet nothing before they are summed by customer and order, and do so once
    assert len(re.findall(r"partial_sum\(sales_amount", final)) == 1
    assert len(re.findall(r"Exchange hashpartitioning\(customer_key\S*, sales_order_number", final)) == 1
    assert len(re.findall(r"Scan parquet[^\n]*lineitem", final)) == 1


def test_several_distinct_counts_without_multiplying_lines(t):
    t.size("customer")
    for df in (filtered.kpis(t), snapshot.kpis(t)):
        plan = explained(df)
        assert "Expand" not in plan and "bitmap_construct_agg" in plan
        assert not re.search(r"Exchange[^\n]*\n[^\n]*hashpartitioning\(customer_key#\d+[L]?, \d+\)", plan)
