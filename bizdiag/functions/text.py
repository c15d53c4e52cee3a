"""Number and sentence formatting as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def percent(c: Column | str, digits: int = 1, signed: bool = False) -> Column:
    """0.1234 as 12.3%; NULL stays NULL."""
    c = _col(c)
    sign = "+" if signed else ""
    return F.when(c.isNotNull(), F.format_string(f"%{sign}.{digits}f%%", c.cast("double") * 100))


def fixed(c: Column | str, digits: int = 2, signed: bool = False) -> Column:
    """Number with fixed decimals; NULL stays NULL."""
    c = _col(c)
    sign = "+" if signed else ""
    return F.when(c.isNotNull(), F.format_string(f"%{sign}.{digits}f", c.cast("double")))


def wan(c: Column | str, signed: bool = False) -> Column:
    """Amount in ten thousands."""
    c = _col(c)
    return F.concat(fixed(c.cast("double") / 10000, 2, signed), F.lit(" 万"))


def joined(separator: str, *flags: tuple[Column, Column]) -> Column:
    """Texts whose condition holds, in the given order, joined by the separator."""
    return F.concat_ws(separator, *[F.when(cond, text) for cond, text in flags])
