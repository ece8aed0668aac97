from datetime import date

import pytest

from salesengine.functions.filters import Filters, check_limit, check_product_key


def test_text_is_trimmed_and_blank_means_none():
    f = Filters(product_line="  R ", country="   ")
    assert f.product_line == "R"
    assert f.country is None
    assert Filters(country=" ").is_empty


def test_dates_from_text():
    assert Filters(start_date="2001-02-03").start_date == date(2001, 2, 3)


@pytest.mark.parametrize(
    "bad",
    [
        {"start_date": "2001-01-02", "end_date": "2001-01-01"},
        {"start_date": "01/02/2001"},
        {"channel": "Shop"},
        {"channel": " Internet "},
        {"channel": ""},
        {"product_line": ""},
        {"product_line": "x" * 51},
        {"country": "x" * 101},
    ],
)
def test_bad_filters_are_refused(bad):
    with pytest.raises(ValueError):
        Filters(**bad)


def test_longest_texts_and_equal_dates_are_accepted():
    Filters(product_line="x" * 50, country="y" * 100)
    Filters(start_date="2001-01-01", end_date="2001-01-01")


@pytest.mark.parametrize("limit", [0, 51, -1])
def test_limit_bounds(limit):
    with pytest.raises(ValueError):
        check_limit(limit)
    assert check_limit(1) == 1 and check_limit(50) == 50


def test_product_key_bounds():
    with pytest.raises(ValueError):
        check_product_key(0)
    assert check_product_key(1) == 1
