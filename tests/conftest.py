import sys
from datetime import date
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from salesengine.session import build_session  # noqa: E402
from salesengine.sources.star import SalesTables  # noqa: E402

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        extra={
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


FACT = (
    "OrderDateKey int, ProductKey bigint, CustomerKey bigint, SalesOrderNumber string, "
    "SalesAmount decimal(18,4)"
)
PRODUCT = (
    "ProductKey bigint, EnglishProductName string, ProductLine string, Color string, "
    "Size string, ListPrice double, ModelName string"
)
GEOGRAPHY = (
    "GeographyKey bigint, EnglishCountryRegionName string, StateProvinceName string, City string"
)


def date_row(key: int):
    day = date(key // 10000, key // 100 % 100, key % 100)
    return (key, day, day.year, day.month)


@pytest.fixture(scope="session")
def star(spark):
    """Builds small star schemas.

    Lines are (date key, product, customer, order, amount); resellers' have no
    customer.
    """
    from decimal import Decimal

    def build(internet=(), reseller=(), products=None, customers=(), places=(), days=None):
        lines = [(*row[:4], Decimal(str(row[4]))) for row in internet]
        resold = [(row[0], row[1], None, row[2], Decimal(str(row[3]))) for row in reseller]
        if days is None:
            days = sorted({row[0] for row in lines + resold} - {0})
        if products is None:
            keys = sorted({row[1] for row in lines + resold} - {0})
            products = [(k, f"Product {k}", "R", "Red", "M", 1.0, "Model") for k in keys]
        return SalesTables(
            internet=spark.createDataFrame(lines, FACT),
            reseller=spark.createDataFrame(resold, FACT).drop("CustomerKey"),
            date=spark.createDataFrame(
                [date_row(k) for k in days],
                "DateKey int, FullDateAlternateKey date, CalendarYear int, MonthNumberOfYear int",
            ),
            product=spark.createDataFrame(list(products), PRODUCT),
            customer=spark.createDataFrame(
                list(customers), "CustomerKey bigint, GeographyKey bigint"
            ),
            geography=spark.createDataFrame(list(places), GEOGRAPHY),
        )

    return build


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]
