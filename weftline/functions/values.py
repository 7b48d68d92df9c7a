"""What counts as missing, in one place.

A value is empty if it is null, or text that is blank after trimming. Numbers count by their text, so a
record's 0 is a value here; only is_falsy() takes it as missing, where a rule asks for that.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for a missing value when a record is shown, compared, or read from CSV.
SHOWN_AS_MISSING = ("", "-", "null")
UNFILLED = ("", "无", "null", "none")
CSV_MISSING = ("", "NULL", "null", "None", "N/A", "NA")


def text(value: Column) -> Column:
    """The value as trimmed text, null as ''."""
    return F.coalesce(F.trim(value.cast("string")), F.lit(""))


def is_empty(value: Column) -> Column:
    return text(value) == ""


def is_falsy(value: Column) -> Column:
    return is_empty(value) | F.coalesce(value.cast("string").rlike(r"^-?0+(\.0+)?$"), F.lit(False))


def present(*values: Column) -> Column:
    return reduce(lambda a, b: a & b, (~is_empty(v) for v in values))


def first_present(*values: Column, missing: tuple[str, ...] = SHOWN_AS_MISSING) -> Column:
    """The first value that is not missing, as text; null if all are."""
    return F.coalesce(*[F.when(~text(v).isin(*missing), text(v)) for v in values])


def filled(value: Column) -> Column:
    return ~F.lower(text(value)).isin(*UNFILLED)


def filled_share(*values: Column) -> Column:
    return reduce(lambda a, b: a + b, (filled(v).cast("int") for v in values)) / F.lit(float(len(values)))


def weighted_mean(parts: list[tuple[Column, Column, float]]) -> Column:
    """Mean of (value, whether it counts, weight), weights renormalised over those that count; 0 if none does."""
    total = reduce(lambda a, b: a + b, (F.when(c, v * w).otherwise(0.0) for v, c, w in parts))
    weight = reduce(lambda a, b: a + b, (F.when(c, F.lit(float(w))).otherwise(0.0) for v, c, w in parts))
    return F.when(weight > 0, total / weight).otherwise(0.0)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0 or null."""
    return F.when(whole > 0, part / whole).otherwise(0.0)


def finite(value: Column) -> Column:
    """NaN and infinities as null."""
    x = value.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(math.inf)), x)
