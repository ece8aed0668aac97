"""Known values at sf 0.01, computed independently of this code."""

import pytest
from conftest import MEDIUM, rows

from salesengine.operators import filtered, snapshot
from salesengine.plans.registry import PRESETS
from salesengine.sources.testmap import load_star


@pytest.fixture(scope="module")
def t(spark):
    return load_star(spark, MEDIUM, gaps=True)


def test_kpis_snapshot(t):
    (row,) = rows(snapshot.kpis(t))
    assert row["total_sales"] == 3183256271.63
    assert (row["order_count"], row["customer_count"], row["product_count"]) == (14743, 1499, 2000)
    assert row["hot_product_count"] == 2000


KPIS = {
    "f0": (3149876965.77, 14728, 1499, 957),
    "f1": (152654222.33, 2133, 1009, 130),
    "f2": (405583354.36, 1897, 305, 879),
    "f3": (635911229.93, 2946, 0, 920),
    "f4": (415818829.07, 5761, 1469, 156),
    "f5": (0.0, 0, 0, 0),
    "f6": (0.0, 0, 0, 0),
    "f7": (247978364.92, 1151, 666, 796),
}


@pytest.mark.parametrize("preset", sorted(KPIS))
def test_kpis_filtered(t, preset):
    (row,) = rows(filtered.kpis(t, PRESETS[preset]))
    found = [row[c] for c in ("total_sales", "order_count", "customer_count", "hot_product_count")]
    assert tuple(found) == KPIS[preset]


TREND = {
    "f0": (12, "2000-09", "2001-08", 430547174.06),
    "f1": (12, "2000-01", "2000-12", 77525297.78),
    "f2": (12, "1999-04", "2000-03", 72747417.60),
    "f3": (12, "2000-08", "2001-07", 97999636.52),
    "f4": (12, "2000-08", "2001-07", 61179237.30),
    "f7": (12, "2000-01", "2000-12", 501595617.23),
}


@pytest.mark.parametrize("preset", sorted(TREND))
def test_trend_filtered(t, preset):
    months = rows(filtered.trend(t, PRESETS[preset]))
    count, first, last, total = TREND[preset]
    assert len(months) == count
    assert (months[0]["year_month"], months[-1]["year_month"]) == (first, last)
    assert sum(m["sales_amount"] for m in months) == pytest.approx(total, abs=0.005)


@pytest.mark.parametrize("preset", ["f5", "f6"])
def test_trend_without_sales(t, preset):
    assert rows(filtered.trend(t, PRESETS[preset])) == []


def test_channels_and_places(t):
    found = {r["sales_channel"]: r for r in rows(snapshot.channels(t))}
    assert found["Internet"]["sales_amount"] == 2540132775.78
    assert found["Internet"]["order_count"] == 11794
    assert found["Reseller"]["sales_amount"] == 643123495.85
    assert found["Reseller"]["order_count"] == 2949
    best = snapshot.geo(t).first()
    assert (best["country"], best["state_province"], best["city"]) == (
        "ASIA",
        "NATION_12",
        "HOUSEHOLD",
    )
    assert best["sales_amount"] == 35873847.02


def test_products_and_months(t):
    best = [(r["product_key"], r["sales_amount"]) for r in snapshot.top_products(t).take(3)]
    assert best == [(707, 2861628.12), (1408, 2784446.73), (657, 2702557.57)]
    months = {r["year_month"]: (r["sales_amount"], r["order_count"]) for r in rows(snapshot.trend(t))}
    assert months["2001-08"] == (495077.01, 2)
    assert months["2001-07"] == (43630620.39, 204)
    assert filtered.product_sales(t).count() == 1979
    assert t.sizes["date"].rows == 2399
