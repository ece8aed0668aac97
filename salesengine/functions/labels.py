"""Month labels, display fallbacks and text matching."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "Unknown"


def known(attribute: Column) -> Column:
    return F.coalesce(attribute, F.lit(UNKNOWN))


def year_month(year: Column, month: Column) -> Column:
    """'2001-07'; empty text where the date is unknown."""
    return F.concat_ws("-", year.cast("string"), F.lpad(month.cast("string"), 2, "0"))


def month_index(year: Column, month: Column) -> Column:
    """Months counted without gaps, so that windows of months are differences."""
    return year * 12 + month


def month_label(label: Column, year: Column, month: Column) -> Column:
    return F.coalesce(F.nullif(label, F.lit("")), year_month(year, month))


def product_label(name: Column, key: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), F.concat(F.lit("Product "), key.cast("string")))


def matches_name(name: Column, fragment: str) -> Column:
    """Substring search; % and _ act as wildcards, only ASCII letters fold case.

    Folding is done by translate, as ilike would fold letters beyond ASCII too.
    A backslash is an ordinary character here, so it is doubled for LIKE.
    """
    folded = F.translate(name, string.ascii_uppercase, string.ascii_lowercase)
    pattern = fragment.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    return folded.like("%" + pattern.replace("\\", "\\\\") + "%")
