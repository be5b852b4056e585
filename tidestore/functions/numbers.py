"""Numbers and enumerations of round-robin archive dumps, as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Consolidation functions and source types of both dump versions.
CF_V1 = ("AVERAGE", "MIN", "MAX", "LAST")
CF_V3 = (*CF_V1, "HWPREDICT", "SEASONAL", "DEVPREDICT", "DEVSEASONAL", "FAILURES", "MHWPREDICT")
DS_V1 = ("GAUGE", "COUNTER", "DERIVE", "ABSOLUTE")
DS_V3 = (*DS_V1, "COMPUTE")
LONG_MAX, LONG_MIN = (1 << 63) - 1, -(1 << 63)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _key(text: Column) -> Column:
    return F.lower(F.trim(text))


def parse_double(text: Column | str) -> Column:
    """``U`` is null, ``nan`` and ``unkn`` NaN, ``inf`` and ``-inf`` infinite, whatever the case; else a number."""
    text = _col(text)
    key = _key(text)
    return (
        F.when(key == "u", F.lit(None).cast("double"))
        .when(key.isin("nan", "unkn"), F.lit(float("nan")))
        .when(key == "inf", F.lit(float("inf")))
        .when(key == "-inf", F.lit(float("-inf")))
        .otherwise(F.trim(text).try_cast("double"))
    )


def format_double(value: Column | str) -> Column:
    """Text of a number; null stays null."""
    value = _col(value)
    return (
        F.when(F.isnan(value), F.lit("NaN"))
        .when(value == float("inf"), F.lit("inf"))
        .when(value == float("-inf"), F.lit("-inf"))
        .otherwise(value.cast("string"))
    )


def parse_long(text: Column | str) -> Column:
    """``U`` is null, infinities are the extreme longs; else a whole number, null if it is none."""
    text = _col(text)
    key = _key(text)
    return F.when(key == "u", F.lit(None).cast("bigint")).when(key == "inf", F.lit(LONG_MAX)).when(key == "-inf", F.expr("-9223372036854775808L")).otherwise(F.trim(text).try_cast("bigint"))


def format_long(value: Column | str) -> Column:
    """Text of a whole number; null stays null."""
    value = _col(value)
    return F.when(value == LONG_MAX, F.lit("inf")).when(value == F.expr("-9223372036854775808L"), F.lit("-inf")).otherwise(value.cast("string"))


def parse_enum(text: Column | str, allowed: tuple[str, ...]) -> Column:
    """The trimmed name; null stays null, and a name that isn't ``allowed`` is an error."""
    name = F.trim(_col(text))
    return F.when(name.isNull() | name.isin(*allowed), name).otherwise(F.raise_error(F.concat(F.lit("unknown name: "), name)).cast("string"))


def known_enum(text: Column | str, allowed: tuple[str, ...]) -> Column:
    """Whether ``parse_enum`` takes a name; null is taken."""
    name = F.trim(_col(text))
    return name.isNull() | name.isin(*allowed)


def is_counter(ds_type: Column | str) -> Column:
    return _col(ds_type) != "GAUGE"


def is_average(cf: Column | str) -> Column:
    return _col(cf) == "AVERAGE"


def metric_type(ds_type: Column | str) -> Column:
    return F.when(is_counter(ds_type), F.lit("count")).otherwise(F.lit("gauge"))
