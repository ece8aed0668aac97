"""The six tables of the star schema, their contract and their sizes."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from threading import RLock

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = T.IntegralType
NUMBER = T.NumericType
TEXT = T.StringType
DAY = T.DateType

# Warehouse table and column names.
TABLE_NAMES = {
    "internet": "FactInternetSales",
    "reseller": "FactResellerSales",
    "date": "DimDate",
    "product": "DimProduct",
    "customer": "DimCustomer",
    "geography": "DimGeography",
}
CONTRACT: dict[str, dict[str, type[T.DataType]]] = {
    "internet": {
        "OrderDateKey": KEY,
        "ProductKey": KEY,
        "CustomerKey": KEY,
        "SalesOrderNumber": TEXT,
        "SalesAmount": NUMBER,
    },
    "reseller": {
        "OrderDateKey": KEY,
        "ProductKey": KEY,
        "SalesOrderNumber": TEXT,
        "SalesAmount": NUMBER,
    },
    "date": {
        "DateKey": KEY,
        "FullDateAlternateKey": DAY,
        "CalendarYear": KEY,
        "MonthNumberOfYear": KEY,
    },
    "product": {
        "ProductKey": KEY,
        "EnglishProductName": TEXT,
        "ProductLine": TEXT,
        "Color": TEXT,
        "Size": TEXT,
        "ListPrice": NUMBER,
        "ModelName": TEXT,
    },
    "customer": {"CustomerKey": KEY, "GeographyKey": KEY},
    "geography": {
        "GeographyKey": KEY,
        "EnglishCountryRegionName": TEXT,
        "StateProvinceName": TEXT,
        "City": TEXT,
    },
}
DIMENSION_KEYS = {
    "date": "DateKey",
    "product": "ProductKey",
    "customer": "CustomerKey",
    "geography": "GeographyKey",
}

# Sides broadcast in one plan take at most this together. A plan joins each of the
# four dimensions at most once as such a side, so each may take a quarter.
BROADCAST_BYTES = 64 * 1024 * 1024
# What a row of a hashed relation takes besides its values: header, pointers and
# its share of a key array that is half empty.
ROW_OVERHEAD = 64


# Numbers between the ends of a dimension's keys for each key at most, for bitmaps of
# its keys to be no larger than the keys themselves.
DENSE = 64


@dataclass(frozen=True)
class DimensionSize:
    rows: int
    bytes: int
    widest_row: int
    least: int | None = field(default=None, compare=False)
    largest: int | None = field(default=None, compare=False)

    @property
    def dense(self) -> bool:
        """Whether there are so many keys that a bitmap is a good set of them."""
        if self.least is None or self.largest is None:
            return False
        return self.largest - self.least < DENSE * self.rows


@dataclass(frozen=True)
class SalesTables:
    internet: DataFrame
    reseller: DataFrame
    date: DataFrame
    product: DataFrame
    customer: DataFrame
    geography: DataFrame
    sizes: dict[str, DimensionSize] = field(default_factory=dict, compare=False)
    broadcast_bytes: int = BROADCAST_BYTES
    counted: bool = False
    counting: RLock = field(default_factory=RLock, compare=False, repr=False)

    def size(self, name: str) -> DimensionSize | None:
        """The size of a dimension, counted when it is first asked for.

        Uncounted tables have the sizes they were given, if any.
        """
        if not self.counted:
            return self.sizes.get(name)
        with self.counting:  # modules are built by several threads
            if name not in self.sizes:
                self.sizes[name] = measure(self, name)
            return self.sizes[name]

    def fits_broadcast(self, name: str, *numbers: str, with_place: bool = False) -> bool:
        """Whether what a join needs of a dimension is within its share of the bound.

        The counted bytes of whole rows, or 8 for each column if only the named
        number columns are joined, and the overhead of every row; with_place adds
        the widest place to every row. An uncounted dimension does not fit: Spark
        then picks the join from its own estimates.
        """
        size = self.size(name)
        if size is None:
            return False
        total = 8 * len(numbers) * size.rows if numbers else size.bytes
        total += ROW_OVERHEAD * size.rows
        if with_place:
            places = self.size("geography")
            if places is None:
                return False
            total += size.rows * places.widest_row
        return total <= self.broadcast_bytes // len(DIMENSION_KEYS)

    def side(
        self, name: str, df: DataFrame, *numbers: str, with_place: bool = False
    ) -> DataFrame:
        """A join side made from one dimension, broadcast if that was counted small.

        Beyond the bound the join shuffles, and AQE splits skewed keys.
        """
        fits = self.fits_broadcast(name, *numbers, with_place=with_place)
        return F.broadcast(df) if fits else df


def check_contract(tables: SalesTables) -> None:
    problems = []
    for name, columns in CONTRACT.items():
        present = {f.name.lower(): f.dataType for f in getattr(tables, name).schema.fields}
        for column, kind in columns.items():
            found = present.get(column.lower())
            if found is None:
                problems.append(f"{TABLE_NAMES[name]}.{column} is missing")
            elif not isinstance(found, kind):
                problems.append(f"{TABLE_NAMES[name]}.{column} is {found.simpleString()}")
    if problems:
        raise ValueError("tables break the contract: " + "; ".join(problems))


def _row_bytes(df: DataFrame) -> Column:
    """Bytes of one row: 8 per column plus the length of each text."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    lengths = [F.coalesce(F.octet_length(F.col(c)), F.lit(0)).cast("bigint") for c in texts]
    return reduce(lambda a, b: a + b, lengths, F.lit(8 * len(df.columns)).cast("bigint"))


def measure(tables: SalesTables, name: str) -> DimensionSize:
    """Count a dimension; a duplicate key is an error.

    Joins rely on the key being unique, and broadcasts on the size found here.
    """
    dimension = getattr(tables, name)
    counted = (
        dimension.select(
            F.col(DIMENSION_KEYS[name]).alias("key"), _row_bytes(dimension).alias("width")
        )
        .groupBy("key")
        .agg(F.count("*").alias("n"), F.sum("width").alias("b"), F.max("width").alias("w"))
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
            F.coalesce(F.sum("b"), F.lit(0)).alias("bytes"),
            F.coalesce(F.max("w"), F.lit(0)).alias("widest"),
            F.count_if((F.col("n") > 1) & F.col("key").isNotNull()).alias("repeated"),
            F.min("key").alias("least"),
            F.max("key").alias("largest"),
        )
    )
    row = counted.first()
    if row["repeated"]:
        raise ValueError(f"duplicate keys in {TABLE_NAMES[name]} ({row['repeated']} keys)")
    return DimensionSize(row["rows"], row["bytes"], row["widest"], row["least"], row["largest"])


def checked(tables: SalesTables) -> SalesTables:
    """Tables that keep the contract, narrowed to its columns; counted when first joined."""
    check_contract(tables)
    narrow = {name: getattr(tables, name).select(*columns) for name, columns in CONTRACT.items()}
    return replace(tables, **narrow, sizes={}, counted=True, counting=RLock())


def load_files(spark: SparkSession, directory: str, file_format: str = "parquet") -> SalesTables:
    """Tables stored as one folder each, named as in the warehouse."""
    base = directory.rstrip("/")
    return checked(
        SalesTables(
            **{
                name: spark.read.format(file_format).load(f"{base}/{table}")
                for name, table in TABLE_NAMES.items()
            }
        )
    )
