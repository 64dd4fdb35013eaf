"""Column expressions that the operators share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

MAD_TO_SIGMA = 1.4826


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_even(c: Column | str, digits: int = 0) -> Column:
    """Rounds as numpy does: scaled, to the nearest, halves to even."""
    scale = float(10**digits)
    return F.rint(col(c) * scale) / scale if digits else F.rint(col(c))


def finite(c: Column | str) -> Column:
    """Null for NaN and infinities."""
    c = col(c)
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def nan_to_num(c: Column | str) -> Column:
    """Nulls and NaN to 0, infinities to the largest single-precision numbers."""
    c, most = col(c), 3.4028234663852886e38
    return F.when(c.isNull() | F.isnan(c), F.lit(0.0)).otherwise(F.greatest(F.least(c, F.lit(most)), F.lit(-most)))


def sinc(c: Column | str) -> Column:
    x = col(c) * 3.141592653589793
    return F.when(x == 0, F.lit(1.0)).otherwise(F.sin(x) / x)


def in_bands(freq: Column | str, bands: Iterable[tuple[float, float]]) -> Column:
    """Within any band, ends included."""
    out = F.lit(False)
    for lo, hi in bands:
        out = out | col(freq).between(lo, hi)
    return out


def flag(c: Column | str) -> Column:
    """Null counts as false."""
    return F.coalesce(col(c), F.lit(False))


def is_off_scan(name: Column | str) -> Column:
    return F.upper(col(name)).contains("_OFF")


def mjd_to_timestamp(mjd: Column | str) -> Column:
    return F.timestamp_seconds((col(mjd) - 40587) * 86400)


def file_stem(path: Column | str) -> Column:
    """Name without folders, query and last suffix."""
    name = F.element_at(F.split(F.element_at(F.split(col(path), "[?]"), 1), "/"), -1)
    return F.regexp_replace(name, "[.][^.]*$", "")
