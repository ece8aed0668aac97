"""Exact money arithmetic: decimals inside, doubles only on output.

Sums are taken over decimals, so their value does not depend on the order in
which tasks finish. A quotient is one division of doubles, brought to ten
decimal digits and then half up to the wanted scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LINE_EXACT = "decimal(18,4)"  # snapshot family, and regional sums
LINE_CENTS = "decimal(18,2)"  # filtered family: each line rounded before summing
SUM_CENTS = "decimal(28,2)"


def cents(total: Column) -> Column:
    """A decimal sum rounded half up to two digits, as double."""
    return total.cast(SUM_CENTS).cast("double")


def quotient(part: Column, whole: Column) -> Column:
    """part / whole as double; NULL where whole is 0."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def rounded(value: Column, scale: int) -> Column:
    return value.cast("decimal(38,10)").cast(f"decimal(28,{scale})").cast("double")


def clean_values(df: DataFrame) -> DataFrame:
    """Decimals to double and dates to ISO text, as results leave the engine."""

    def clean(field: T.StructField) -> Column:
        if isinstance(field.dataType, T.DecimalType):
            return F.col(field.name).cast("double").alias(field.name)
        if isinstance(field.dataType, T.DateType):
            return F.date_format(field.name, "yyyy-MM-dd").alias(field.name)
        return F.col(field.name)

    return df.select(*[clean(field) for field in df.schema.fields])
