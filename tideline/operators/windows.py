"""Windowed market aggregates: candles over tumbling windows, rolling metrics over sliding ones, order flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.trades import aggressor
from tideline.operators.ordering import numbered, steps


def turnover() -> Column:
    """Price times size in doubles: a product of two money columns would lose its scale."""
    return F.col("price").cast("double") * F.col("size").cast("double")


def average_price(traded: str = "traded") -> Column:
    """The volume-weighted price of summed turnover; null where no size was traded."""
    return F.try_divide(traded, F.col("volume").cast("double"))


def instant() -> Column:
    """(event_time, sequence) as one decimal: a number orders in place, where a struct would make aggregates sort. A null
    sequence comes first."""
    time = F.unix_micros("event_time").cast("decimal(18,0)") * F.lit("10000000000000000000").cast("decimal(20,0)")
    return (time + F.coalesce(F.col("sequence"), F.lit(-(1 << 62))).cast("decimal(19,0)")).cast("decimal(38,0)")


def candles(silver: DataFrame, interval: str = "1 minute") -> DataFrame:
    """One row a product and window: open and close by (event_time, sequence), exact volume, vwap (null where no size
    was traded), trade_count, and the UTC date of the window's start. One hash aggregate; nothing is sorted."""
    trades = silver.select("product_id", "price", "size", F.window("event_time", interval).alias("span"), instant().alias("instant"), turnover().alias("turnover"))
    summed = {
        "open": F.min_by("price", "instant"), "close": F.max_by("price", "instant"), "low": F.min("price"), "high": F.max("price"),
        "trade_count": F.count(F.lit(1)), "volume": F.sum("size"), "traded": F.sum("turnover"),
    }
    bars = trades.groupBy("product_id", "span").agg(*(c.alias(n) for n, c in summed.items())).withColumns({"interval_start": F.col("span.start"), "interval_end": F.col("span.end"), "vwap": average_price()})
    return bars.select("product_id", "interval_start", "interval_end", "open", "high", "low", "close", "volume", "vwap", "trade_count", F.to_date("interval_start").alias("date"))


def sliding(trades: DataFrame, size: str = "1 minute", slide: str = "15 seconds", delay: str | None = None) -> DataFrame:
    """Rolling metrics; with a delay, over a watermarked stream. Volatility is the sample deviation, null for one trade."""
    timed = trades if delay is None else trades.withWatermark("event_time", delay)
    summed = {"trade_count": F.count(F.lit(1)), "volume": F.sum("size"), "traded": F.sum(turnover()), "price_volatility": F.stddev(F.col("price").cast("double"))}
    spans = timed.groupBy("product_id", F.window("event_time", size, slide).alias("span")).agg(*(c.alias(n) for n, c in summed.items()))
    return spans.select("product_id", F.col("span.start").alias("window_start"), F.col("span.end").alias("window_end"), "trade_count", "volume", average_price().alias("vwap"), "price_volatility")


def order_flow(silver: DataFrame, interval: str = "1 hour") -> DataFrame:
    """Taker flow a product and window: bought and sold sizes, their imbalance, the bought share, and the signed vwap
    (turnover of taker buys less that of taker sells, over all size)."""
    size, bought, sold = F.col("size").cast("double"), aggressor() == "buy", aggressor() == "sell"
    total = lambda side, of: F.coalesce(F.sum(F.when(side, of)), F.lit(0.0))
    rows = silver.groupBy(F.window("event_time", interval).alias("span"), "product_id").agg(
        total(bought, size).alias("taker_bought"), total(sold, size).alias("taker_sold"), (total(bought, turnover()) - total(sold, turnover())).alias("signed")
    )
    both = F.col("taker_bought") + F.col("taker_sold")
    return rows.select(
        "product_id", F.col("span.start").alias("interval_start"), "taker_bought", "taker_sold", F.try_divide(F.col("taker_bought") - F.col("taker_sold"), both).alias("imbalance"),
        F.try_divide("taker_bought", both).alias("buy_ratio"), F.try_divide("signed", both).alias("signed_vwap"),
    )


def sequence_gaps(silver: DataFrame) -> DataFrame:
    """Where a product's sequence numbers skip."""
    skips = steps(silver, "product_id", "sequence").where(F.col("sequence") - F.col("previous") > 1)
    return skips.withColumn("missing", F.col("sequence") - F.col("previous") - 1)


def sweeps(silver: DataFrame, least: int = 2) -> DataFrame:
    """Orders that matched several resting ones."""
    rows = silver.groupBy("product_id", "taker_order_id").agg(F.count(F.lit(1)).alias("fills"), F.sum("size").alias("size"), F.min("price").alias("low"), F.max("price").alias("high"), F.min("event_time").alias("first_fill"))
    return rows.where(F.col("fills") >= least)


def feed_rates(feed: DataFrame, every: str = "5 seconds") -> DataFrame:
    """Messages a product and interval, their rate, and the running total with its rate since the feed's first interval."""
    rows = feed.groupBy("product_id", F.window("event_time", every).alias("w")).agg(F.count(F.lit(1)).alias("messages"))
    rows = rows.select("product_id", F.col("w.start").alias("interval_start"), F.col("w.end").alias("interval_end"), "messages")
    width = F.unix_micros("interval_end") - F.unix_micros("interval_start")
    so_far = Window.partitionBy("product_id").orderBy("interval_start").rowsBetween(Window.unboundedPreceding, 0)
    since = F.unix_micros("interval_end") - F.unix_micros(F.min("interval_start").over(Window.partitionBy("product_id")))
    return rows.select("product_id", "interval_start", "messages", (F.col("messages") * 1e6 / width).alias("rate"), F.sum("messages").over(so_far).alias("total"), (F.sum("messages").over(so_far) * 1e6 / since).alias("average_rate"))


def feed_peak(feed: DataFrame, micros: int = 1_000_000) -> DataFrame:
    """The most messages in any closed second of the feed. A frame over all time would need one task, so each message
    is counted in its own stretch of the clock and in the next, whose messages may look back to it."""
    at = F.unix_micros("event_time")
    stretch = F.lit(3600 * 1_000_000)
    own = F.floor(at / stretch)
    spread = F.explode(F.when(F.floor((at + micros) / stretch) == own, F.array(own)).otherwise(F.array(own, own + 1)))
    rows = feed.select(at.alias("at"), own.alias("own"), spread.alias("stretch"))
    recent = Window.partitionBy("stretch").orderBy("at").rangeBetween(-micros, 0)
    return rows.select("own", "stretch", F.count(F.lit(1)).over(recent).alias("n")).where("own = stretch").agg(F.coalesce(F.max("n"), F.lit(0)).alias("peak_1s"))


def throughput(feed: DataFrame, every: int = 100) -> DataFrame:
    """The rate of each full run of ``every`` messages of a log partition."""
    placed = numbered(feed, "partition", F.col("offset"), ["offset"], 1 << 20, "place")
    runs = placed.withColumn("run", F.floor(F.col("place") / every)).groupBy("partition", "run").agg(F.count(F.lit(1)).alias("messages"), F.min("kafka_timestamp").alias("low"), F.max("kafka_timestamp").alias("high"))
    return runs.where(F.col("messages") == every).select("partition", "run", F.try_divide(F.col("messages") * 1e6, F.unix_micros("high") - F.unix_micros("low")).alias("rate"))
