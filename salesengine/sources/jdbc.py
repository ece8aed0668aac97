"""The star schema read from a warehouse over JDBC, in parallel.

A scan is cut into slices by ranges of a numeric column or by given predicates.
Only the columns of the contract are asked for; Spark pushes filters down.
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from salesengine.sources.star import CONTRACT, TABLE_NAMES, SalesTables, checked

# Rows that one connection reads, about.
ROWS_PER_SLICE = 2_000_000

ENVIRONMENT = {
    "url": "SALES_JDBC_URL",
    "user": "SALES_JDBC_USER",
    "password": "SALES_JDBC_PASSWORD",
    "driver": "SALES_JDBC_DRIVER",
}


@dataclass(frozen=True)
class Connection:
    url: str
    user: str
    password: str = field(repr=False)
    driver: str
    schema: str = "dbo"
    fetch_size: int = 10_000

    @staticmethod
    def from_environment() -> Connection:
        missing = [name for name in ENVIRONMENT.values() if not os.environ.get(name)]
        if missing:
            raise ValueError("set " + ", ".join(missing))
        return Connection(**{key: os.environ[name] for key, name in ENVIRONMENT.items()})

    def options(self) -> dict[str, str]:
        return {
            "url": self.url,
            "user": self.user,
            "password": self.password,
            "driver": self.driver,
            "fetchsize": str(self.fetch_size),
        }


@dataclass(frozen=True)
class Slices:
    """How one table is cut: by equal ranges of a column, or by predicates.

    Predicates (say one for each month) keep slices even where the values of a
    column are not; together they must cover every row exactly once.
    """

    column: str | None = None
    lower: int | None = None
    upper: int | None = None
    count: int = 1
    predicates: tuple[str, ...] = ()

    def options(self) -> dict[str, str]:
        if self.column is None:
            return {}
        if self.lower is None or self.upper is None or self.lower > self.upper:
            raise ValueError(f"{self.column} needs bounds, the lower one first")
        return {
            "partitionColumn": self.column,
            "lowerBound": str(self.lower),
            "upperBound": str(self.upper),
            "numPartitions": str(self.count),
        }


def read_table(
    spark: SparkSession, connection: Connection, table: str, slices: Slices = Slices()
) -> DataFrame:
    name = f"{connection.schema}.{table}"
    if slices.predicates:
        properties = {k: v for k, v in connection.options().items() if k != "url"}
        return spark.read.jdbc(
            connection.url, name, predicates=list(slices.predicates), properties=properties
        )
    options = {**connection.options(), **slices.options(), "dbtable": name}
    return spark.read.format("jdbc").options(**options).load()


def read_query(spark: SparkSession, connection: Connection, query: str) -> DataFrame:
    """A query the warehouse answers itself."""
    return spark.read.format("jdbc").options(**connection.options(), query=query).load()


def key_slices(
    spark: SparkSession,
    connection: Connection,
    table: str,
    column: str,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> Slices:
    """Equal ranges of a key, as many as the rows need; the warehouse counts them."""
    row = read_query(spark, connection, bounds_query(connection, table, column)).first()
    if row is None or row["low"] is None:
        return Slices()
    count = -(-int(row["n"]) // rows_per_slice)
    return Slices(column, int(row["low"]), int(row["high"]), max(1, count))


def bounds_query(connection: Connection, table: str, column: str) -> str:
    return (
        f"SELECT MIN({column}) AS low, MAX({column}) AS high, COUNT(*) AS n "
        f"FROM {connection.schema}.{table}"
    )


def months_query(connection: Connection, table: str, day: str, key: str) -> str:
    """Rows and key bounds of every month; days are numbers like 20140331."""
    return (
        f"SELECT {day} / 100 AS month, COUNT(*) AS n, MIN({key}) AS low, MAX({key}) AS high "
        f"FROM {connection.schema}.{table} WHERE {day} IS NOT NULL GROUP BY {day} / 100"
    )


@dataclass(frozen=True)
class Month:
    month: int
    rows: int
    low: int | None
    high: int | None


def fact_slices(
    months: Sequence[Month], day: str, key: str, rows_per_slice: int = ROWS_PER_SLICE
) -> Slices:
    """A slice for each month, and ranges of a key within months that have more rows.

    Days before the first month and NULL days are in its slices, days after the
    last one in that one's; NULL keys are in the first range of their month. So
    every row is in exactly one slice, also one added while the table is read.
    """
    if not months:
        return Slices()
    ordered = sorted(months, key=lambda m: m.month)
    predicates = []
    for i, month in enumerate(ordered):
        tests = []
        if i:
            tests.append(f"{day} >= {month.month * 100}")
        if i + 1 < len(ordered):
            tests.append(f"{day} < {ordered[i + 1].month * 100}")
        within = " AND ".join(tests)
        if not i:
            within = f"({within} OR {day} IS NULL)" if within else "1 = 1"
        pieces = max(1, -(-month.rows // rows_per_slice))
        if month.low is None or month.high is None:
            pieces = 1
        cuts = [
            month.low + (month.high - month.low + 1) * piece // pieces for piece in range(1, pieces)
        ]
        cuts = sorted(set(cuts))
        for low, high in zip([None, *cuts], [*cuts, None]):
            of_key = []
            if low is not None:
                of_key.append(f"{key} >= {low}")
            if high is not None:
                of_key.append(f"{key} < {high}")
            if not of_key:
                predicates.append(within)
            elif low is None:
                predicates.append(f"{within} AND ({of_key[0]} OR {key} IS NULL)")
            else:
                predicates.append(f"{within} AND {' AND '.join(of_key)}")
    return Slices(predicates=tuple(predicates))


def counted_months(
    spark: SparkSession, connection: Connection, table: str, day: str, key: str
) -> list[Month]:
    rows = read_query(spark, connection, months_query(connection, table, day, key))
    return [
        Month(int(r["month"]), int(r["n"]), r["low"], r["high"])
        for r in rows.collect()  # one row for each month
    ]


# What the larger tables are cut by.
FACT_CUTS = {"internet": ("OrderDateKey", "ProductKey"), "reseller": ("OrderDateKey", "ProductKey")}
DIMENSION_CUTS = {"customer": "CustomerKey", "product": "ProductKey"}


def load_jdbc(
    spark: SparkSession, connection: Connection, slices: dict[str, Slices] | None = None
) -> SalesTables:
    """The six tables; slices are given by logical table name.

    Facts for which none are given are cut by month and product key, customers
    and products by key, into slices of about ROWS_PER_SLICE rows.
    """
    by_name = dict(slices or {})
    for name, (day, key) in FACT_CUTS.items():
        if name not in by_name:
            months = counted_months(spark, connection, TABLE_NAMES[name], day, key)
            by_name[name] = fact_slices(months, day, key)
    for name, key in DIMENSION_CUTS.items():
        if name not in by_name:
            by_name[name] = key_slices(spark, connection, TABLE_NAMES[name], key)
    return checked(
        SalesTables(
            **{
                name: read_table(
                    spark, connection, table, by_name.get(name, Slices())
                ).select(*CONTRACT[name])
                for name, table in TABLE_NAMES.items()
            }
        )
    )
