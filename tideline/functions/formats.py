"""Text forms of ages, trades and decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def age(seconds: str) -> Column:
    """Hours from one hour on, minutes below, a dash for null; one decimal."""
    s = F.col(seconds)
    return F.when(s.isNull(), "-").when(s >= 3600, F.format_string("%.1fh", s / 3600)).otherwise(F.format_string("%.1fm", s / 60))


def trade_line(time: str = "time", product: str = "product_id", side: str = "side", price: str = "price", size: str = "size", trade_id: str = "trade_id") -> Column:
    """One aligned line a trade; absent fields show as a question mark (the time as blanks)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    arrow = F.when(F.col(side) == "buy", "^").otherwise("v")
    stamp = F.substring(F.coalesce(F.col(time).cast("string"), F.lit("")), 1, 23)
    return F.format_string("%-23s  %-8s  %s %-4s  price=%12s  size=%14s  id=%s", stamp, text(product), arrow, text(side), text(price), text(size), text(trade_id))


def candle_json(columns: list[str], decimals: tuple[str, ...] = ("open", "high", "low", "close", "volume")) -> Column:
    """A candle as JSON: exact decimals as strings, doubles as numbers."""
    return F.to_json(F.struct(*(F.col(c).cast("string").alias(c) if c in decimals else F.col(c) for c in columns)))
