"""Edge cases on small tables."""

from decimal import Decimal

import pytest
from conftest import rows

from salesengine.functions.filters import Filters
from salesengine.operators import alerts, derived, filtered, snapshot
from salesengine.plans import job
from salesengine.sources.star import SalesTables, checked


def test_no_sales_at_all(star):
    t = star()
    (kpis,) = rows(snapshot.kpis(t))
    assert set(kpis.values()) == {0}
    (live,) = rows(filtered.kpis(t))
    assert set(live.values()) == {0}
    for empty in (
        snapshot.trend(t),
        snapshot.channels(t),
        snapshot.top_products(t),
        snapshot.geo(t),
        filtered.trend(t),
        filtered.trend_peak_valley(t),
        filtered.channels(t),
        filtered.top_products(t),
        filtered.geo(t),
        filtered.product_monthly_panel(t),
        job.live_alerts(t),
    ):
        assert rows(empty) == []
    assert [a["type"] for a in rows(job.snapshot_alerts(t))] == ["stable_operation"]


def test_unknown_date(star):
    t = star(internet=[(0, 1, 1, "A", 10), (20010105, 1, 1, "B", 5)])
    first, second = rows(snapshot.trend(t))
    assert (first["year"], first["year_month"], first["sales_amount"]) == (None, "", 10.0)
    assert (second["year_month"], second["mom_growth_rate"]) == ("2001-01", -0.5)
    assert rows(filtered.kpis(t))[0]["total_sales"] == 5.0


def test_unknown_product(star):
    t = star(internet=[(20010105, 0, 1, "A", 10), (20010105, 1, 1, "B", 5)])
    first = rows(snapshot.top_products(t))[0]
    assert first["product_key"] == 0
    assert first["product_line"] is None and first["product_name"] is None
    assert [r["product_key"] for r in rows(filtered.top_products(t))] == [1]


def test_product_key_missing_on_the_line(star):
    t = star(internet=[(20010105, None, 1, "A", 10), (20010105, 1, 1, "B", 5)], products=[])
    first = rows(snapshot.top_products(t))[0]
    assert first["product_key"] is None
    assert (first["sales_amount"], first["order_count"]) == (10.0, 1)


def test_missing_attributes_show_as_unknown(star):
    t = star(
        internet=[(20010105, 1, 1, "A", 10)], products=[(1, "One", None, None, None, 1.0, None)]
    )
    for ranking in (snapshot.top_products(t), filtered.top_products(t)):
        (row,) = rows(ranking)
        assert (row["product_line"], row["color"], row["size"]) == ("Unknown",) * 3
    assert rows(filtered.kpis(t, Filters(product_line="Unknown")))[0]["order_count"] == 1


def test_growth_is_against_the_previous_row(star):
    t = star(internet=[(20010105, 1, 1, "A", 100), (20010405, 1, 1, "B", 150)])
    assert [r["mom_growth_rate"] for r in rows(snapshot.trend(t))] == [0.0, 0.5]


@pytest.mark.parametrize("before", [0, -50])
def test_growth_without_a_positive_base(star, before):
    t = star(internet=[(20010105, 1, 1, "A", before), (20010205, 1, 1, "B", 100)])
    months = rows(snapshot.trend(t))
    assert months[1]["mom_growth_rate"] == 0.0
    assert months[1]["trend_direction"] == "stable"
    pct = rows(derived.mom_growth_pct(snapshot.trend(t)))[1]["growth_pct"]
    assert pct == (9900.0 if before == 0 else -300.0)


@pytest.mark.parametrize(
    "amount, direction",
    [(102, "stable"), ("102.01", "up"), (98, "stable"), ("97.99", "down")],
)
def test_growth_band(star, amount, direction):
    t = star(internet=[(20010105, 1, 1, "A", 100), (20010205, 1, 1, "B", amount)])
    assert rows(snapshot.trend(t))[1]["trend_direction"] == direction


@pytest.mark.parametrize("share, health", [(799, "stable"), (800, "high_contribution")])
def test_product_health(star, share, health):
    lines = [(20010105, 1, 1, "A", share)]
    # The other products sell less than the first each, and 10000 together.
    rest = 10000 - share
    lines += [(20010105, k, 1, f"B{k}", Decimal(rest) / 20) for k in range(2, 22)]
    t = star(internet=lines)
    first = rows(snapshot.top_products(t))[0]
    assert (first["product_key"], first["product_health"]) == (1, health)


@pytest.mark.parametrize("amount, summary", [(4999, "supplementary"), (5000, "primary")])
def test_channel_summary(star, amount, summary):
    t = star(
        internet=[(20010105, 1, 1, "A", amount)], reseller=[(20010105, 1, "B", 10000 - amount)]
    )
    found = {r["sales_channel"]: r["performance_summary"] for r in rows(snapshot.channels(t))}
    assert found["Internet"] == summary


def _products(spark, rate):
    return spark.createDataFrame(
        [(1, "One", 10.0, rate)],
        "product_key bigint, product_name string, sales_amount double, contribution_rate double",
    )


@pytest.mark.parametrize("rate, fires", [(0.1799, 0), (0.18, 1)])
def test_top_product_dependency(spark, rate, fires):
    assert alerts.top_product_dependency(_products(spark, rate)).count() == fires


@pytest.mark.parametrize("ratio, fires", [(0.7499, 0), (0.75, 1)])
def test_channel_imbalance(spark, ratio, fires):
    channels = spark.createDataFrame(
        [("Internet", 1.0, ratio)], "sales_channel string, sales_amount double, sales_ratio double"
    )
    assert alerts.channel_imbalance(channels).count() == fires


def _months(spark, *amounts):
    return spark.createDataFrame(
        [(2001, i, f"2001-{i:02d}", a) for i, a in enumerate(amounts, start=1)],
        "year int, month int, year_month string, sales_amount double",
    )


@pytest.mark.parametrize("last, fires", [(85.0, 0), (84.99, 1), (120.0, 0)])
def test_sales_drop(spark, last, fires):
    assert alerts.sales_drop(_months(spark, 1000.0, 100.0, last)).count() == fires
    assert alerts.sales_drop(_months(spark, last)).count() == 0


@pytest.mark.parametrize("valley, fires", [(65.0, 0), (64.99, 1)])
def test_monthly_volatility(spark, valley, fires):
    found = rows(alerts.monthly_volatility(_months(spark, 80.0, 100.0, valley)))
    assert len(found) == fires
    if fires:
        assert (found[0]["metric_value"], found[0]["metric_reference"]) == (valley, 100.0)


def test_no_volatility_without_sales(spark):
    assert alerts.monthly_volatility(_months(spark, 0.0, -5.0)).count() == 0


def test_first_month_wins_ties(spark):
    months = _months(spark, 50.0, 90.0, 50.0, 90.0)
    found = {r["kind"]: r["month"] for r in rows(filtered.peak_valley(months))}
    assert found == {"peak": 2, "valley": 1}


def _two_places(star, first, second):
    return star(
        internet=[(20010105, 1, 1, "A", first), (20010105, 1, 2, "B", second)],
        customers=[(1, 1), (2, 2)],
        places=[(1, "Here", "S", "C"), (2, "There", "S", "C")],
    )


@pytest.mark.parametrize("second, level", [(650, "high_value"), ("649.99", "potential")])
def test_region_level(star, second, level):
    found = rows(snapshot.geo(_two_places(star, 1000, second)))
    assert [r["region_level"] for r in found] == ["high_value", level]


def test_regions_without_sales_are_potential(star):
    assert {r["region_level"] for r in rows(snapshot.geo(_two_places(star, 0, 0)))} == {"potential"}


def test_places_of_one_name_are_one_place(star):
    """Two geography keys share their names; an order over both counts once."""
    t = star(
        internet=[
            (20010105, 1, 1, "A", 10),
            (20010105, 1, 2, "A", 20),
            (20010105, 1, 3, "B", 5),
        ],
        customers=[(1, 1), (2, 2), (3, 3)],
        places=[(1, "Here", "S", None), (2, "Here", "S", None), (3, None, "S", "C")],
    )
    expected = [("Here", None, 30.0, 2, 1)]
    names = ("country", "city", "sales_amount", "customer_count", "order_count")
    assert [tuple(r[n] for n in names) for r in rows(snapshot.geo(t))] == expected
    live = [tuple(r[n] for n in names) for r in rows(filtered.geo(t))]
    assert live == expected + [(None, "C", 5.0, 1, 1)]


def test_one_order_in_both_channels(star):
    t = star(internet=[(20010105, 1, 1, "A", 10)], reseller=[(20010105, 1, "A", 5)])
    assert rows(snapshot.kpis(t))[0]["order_count"] == 1
    assert {r["order_count"] for r in rows(snapshot.channels(t))} == {1}
    assert {r["order_ratio"] for r in rows(snapshot.channels(t))} == {0.5}


def test_single_channel_tiles(star):
    t = star(internet=[(20010105, 1, 1, "A", 10)])
    (tiles,) = rows(derived.channel_tiles(filtered.channels(t)))
    assert (tiles["internet_sales_amount"], tiles["internet_order_count"]) == (10.0, 1)
    assert {v for k, v in tiles.items() if k.startswith("reseller")} == {0}


def test_zero_totals(star):
    t = star(internet=[(20010105, 1, 1, "A", 0)])
    assert rows(snapshot.channels(t))[0]["sales_ratio"] == 0.0
    assert rows(filtered.channels(t))[0]["sales_ratio"] is None


def test_duplicate_dimension_key(star):
    t = star(internet=[(20010105, 1, 1, "A", 1)], customers=[(1, 1), (1, 2)])
    with pytest.raises(ValueError, match="DimCustomer"):
        filtered.geo(checked(t))


def test_contract_names_every_problem(star, spark):
    t = star(internet=[(20010105, 1, 1, "A", 1)])
    broken = SalesTables(
        internet=t.internet.drop("SalesAmount"),
        reseller=t.reseller,
        date=t.date.withColumn("FullDateAlternateKey", t.date.DateKey.cast("string")),
        product=t.product,
        customer=t.customer,
        geography=t.geography,
    )
    with pytest.raises(ValueError, match="SalesAmount is missing.*FullDateAlternateKey is string"):
        checked(broken)


def test_filtered_amounts_are_rounded_line_by_line(star):
    t = star(internet=[(20010105, 1, 1, "A", "0.005"), (20010105, 1, 1, "A", "0.005")])
    assert rows(filtered.kpis(t))[0]["total_sales"] == 0.02
    assert rows(snapshot.kpis(t))[0]["total_sales"] == 0.01


def test_window_ends_at_the_products_own_last_sale(star):
    lines = [(20000115, 1, 1, "A", 1), (20010315, 1, 1, "B", 2), (20020315, 2, 1, "C", 3)]
    t = star(internet=lines)
    months = [r["year_month"] for r in rows(filtered.product_monthly(t, 1))]
    assert months == ["2001-03"]
    panel = [(r["product_key"], r["year_month"]) for r in rows(filtered.product_monthly_panel(t))]
    assert sorted(panel) == [(1, "2001-03"), (2, "2002-03")]


@pytest.mark.parametrize("end", [None, "2001-03-10", "2001-03-15", "2001-06-30", "2030-01-01"])
def test_panel_agrees_with_single_products(star, end):
    days = [20000115, 20000401, 20010310, 20010311, 20010315, 20010601]
    lines = [
        (day, 1 + (i + j) % 3, 1, f"S{i}", 10 * i + j) for i, day in enumerate(days) for j in (0, 1)
    ]
    t = star(internet=lines)
    f = Filters(end_date=end)
    panel = rows(filtered.product_monthly_panel(t, f))
    for key in (1, 2, 3):
        one = rows(filtered.product_monthly(t, key, f))
        many = [
            {k: v for k, v in r.items() if k != "product_key"}
            for r in panel
            if r["product_key"] == key
        ]
        assert one == sorted(many, key=lambda r: r["year_month"])


def test_sparkline_points(spark):
    panel = spark.createDataFrame(
        [(1, 2001, m, f"2001-{m:02d}", a) for m, a in [(1, 0.0), (2, 50.0), (3, 100.0)]],
        "product_key bigint, year int, month int, year_month string, sales_amount double",
    )
    lines = [r["points"] for r in rows(derived.sparkline(panel).orderBy("month"))]
    assert lines == ["0.0,22.0", "0.0,22.0 72.0,2.0", "0.0,22.0 36.0,12.0 72.0,2.0"]


def test_geo_rank_bars(spark):
    places = spark.createDataFrame(
        [("A", "s", "c", 1000.0), (None, "s", "d", 500.0), (None, None, None, 1.0)],
        "country string, state_province string, city string, sales_amount double",
    )
    found = [(r["place"], r["name"], r["bar_width"]) for r in rows(derived.geo_rank(places))]
    assert found == [(1, "A", 100.0), (2, "d", 50.0), (3, "Region 3", 8.0)]
