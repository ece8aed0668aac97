"""The five optional filters of the live metrics and the columns they test."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesengine.functions.labels import known

CHANNELS = ("Internet", "Reseller")
MAX_PRODUCT_LINE = 50
MAX_COUNTRY = 100
MAX_LIMIT = 50


def _text(name: str, value: str | None, longest: int) -> str | None:
    if value is None:
        return None
    if not 1 <= len(value) <= longest:
        raise ValueError(f"{name} must have 1 to {longest} characters")
    return value.strip() or None


def _day(name: str, value: date | str | None) -> date | None:
    if value is None or isinstance(value, date):
        return value
    try:
        return date.fromisoformat(value)
    except ValueError:
        raise ValueError(f"{name} must be a date as YYYY-MM-DD, not {value!r}") from None


@dataclass(frozen=True)
class Filters:
    start_date: date | str | None = None
    end_date: date | str | None = None
    product_line: str | None = None
    country: str | None = None
    channel: str | None = None

    def __post_init__(self) -> None:
        clean = {
            "start_date": _day("start_date", self.start_date),
            "end_date": _day("end_date", self.end_date),
            "product_line": _text("product_line", self.product_line, MAX_PRODUCT_LINE),
            "country": _text("country", self.country, MAX_COUNTRY),
        }
        for name, value in clean.items():
            object.__setattr__(self, name, value)
        if self.channel is not None and self.channel not in CHANNELS:
            raise ValueError(f"channel must be one of {', '.join(CHANNELS)}")
        if self.start_date and self.end_date and self.start_date > self.end_date:
            raise ValueError("start_date must be on or before end_date")

    @property
    def is_empty(self) -> bool:
        return self == Filters()

    @property
    def first_day(self) -> Column | None:
        return None if self.start_date is None else F.lit(self.start_date)

    @property
    def last_day(self) -> Column | None:
        return None if self.end_date is None else F.lit(self.end_date)

    def on_products(self) -> list[Column]:
        """'Unknown' selects the products without a line."""
        if self.product_line is None:
            return []
        return [known(F.col("product_line")) == F.lit(self.product_line)]

    def on_sales(self) -> list[Column]:
        tests = []
        if self.channel:
            tests.append(F.col("sales_channel") == F.lit(self.channel))
        if self.country:
            tests.append(F.col("country_region") == F.lit(self.country))
        return tests


def where_all(df: DataFrame, tests: list[Column]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def check_limit(limit: int) -> int:
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be between 1 and {MAX_LIMIT}")
    return limit


def check_product_key(product_key: int) -> int:
    if product_key < 1:
        raise ValueError("product_key must be 1 or more")
    return product_key
