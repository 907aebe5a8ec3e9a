"""From the raw log to typed trades: landing, parsing, conforming, quarantine, deduplication, ranges."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions import trades as T
from tideline.functions.intervals import aligned

KEY = ("product_id", "trade_id")
#: Where a message stands in the log.
PLACE = ("topic", "partition", "offset")
PARSE_FAILURE, SILVER_FAILURE, GOLD_FAILURE = "parse_or_contract_failure", "silver_dq_failure", "gold_dq_failure"


def land(log: DataFrame, now: Column | None = None) -> DataFrame:
    """The log's envelope as bronze: bytes to text, broker columns renamed, stamped; nothing parsed."""
    return log.select(
        F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "topic", "partition", "offset",
        F.col("timestamp").alias("kafka_timestamp"), F.col("timestampType").alias("kafka_timestamp_type"), (now if now is not None else F.current_timestamp()).alias("ingest_timestamp"),
    )


def parse(bronze: DataFrame) -> DataFrame:
    return bronze.select("value", "ingest_timestamp", T.once(T.parsed(), "t"), *(c for c in PLACE if c in bronze.columns))


def conform(parsed: DataFrame, now: Column | None = None) -> DataFrame:
    """The valid trades in silver's columns."""
    names = ("product_id", "trade_id", "side", "price", "size", "sequence", "maker_order_id", "taker_order_id")
    stamp = (now if now is not None else F.current_timestamp()).alias("silver_timestamp")
    return parsed.where(T.is_valid()).select(*(F.col(f"t.{n}").alias(n) for n in names), F.col("t.time").alias("event_time"), "ingest_timestamp", stamp)


def quarantine(parsed: DataFrame, now: Column | None = None) -> DataFrame:
    """What conform leaves out, with its place in the log if that is known; the two together are the input."""
    return parsed.where(~T.is_valid()).select(*(c for c in PLACE if c in parsed.columns), "value", "ingest_timestamp", F.lit(PARSE_FAILURE).alias("reason"), (now if now is not None else F.current_timestamp()).alias("quarantined_at"))


def flagged(rows: DataFrame, violation: Column, reason: str, now: Column | None = None) -> DataFrame:
    """Copies of the rows that break a rule; the table keeps them."""
    return rows.where(violation).withColumn("reason", F.lit(reason)).withColumn("quarantined_at", now if now is not None else F.current_timestamp())


def speed_trades(log: DataFrame) -> DataFrame:
    """What the speed layer needs of a message: neither an id nor deduplication."""
    t = log.select(T.once(F.from_json(F.col("value").cast("string"), "product_id string, price decimal(38,18), size decimal(38,18), time timestamp"), "t"))
    return t.select("t.product_id", "t.price", "t.size", F.col("t.time").alias("event_time")).dropna()


def latest_per_key(rows: DataFrame, keys: tuple[str, ...], order: list[Column]) -> DataFrame:
    """One row of each key, the first in order; rows with a null in the key match nothing and stay."""
    whole = reduce(and_, (F.col(k).isNotNull() for k in keys))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", F.when(whole, place).otherwise(1)).where("_place = 1").drop("_place")


def dedup_stream(silver: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Keyed deduplication in bounded state: a repeat that comes later than the delay passes."""
    return silver.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(list(KEY))


def scoped(silver: DataFrame, product: str | None = None, since_days: int | None = None, as_of: Column | None = None) -> DataFrame:
    """The trades of a product and of the days since ``since_days`` before as_of."""
    rows = silver
    if since_days is not None:
        rows = rows.where(F.to_date("event_time") >= F.date_sub(as_of if as_of is not None else F.current_date(), since_days))
    return rows.where(F.col("product_id") == product) if product is not None else rows


def between(rows: DataFrame, column: str, start: datetime, end: datetime) -> DataFrame:
    """start <= column < end, on literals, so the scan can skip."""
    return rows.where((F.col(column) >= F.lit(start)) & (F.col(column) < F.lit(end)))


def ingested_around(bronze: DataFrame, start: datetime, end: datetime, pad: timedelta = timedelta(days=1)) -> DataFrame:
    """A coarse range on the landing time, before anything is parsed."""
    return between(bronze, "ingest_timestamp", start - pad, end + pad)


def backfill_trades(bronze: DataFrame, start: datetime, end: datetime, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(silver, quarantine) of a range of event time. What cannot be parsed has no event time, so quarantine takes it
    from all that was landed around the range."""
    parsed = parse(ingested_around(bronze, start, end))
    return between(conform(parsed, now), "event_time", start, end), quarantine(parsed, now)


def backfill_candles(silver: DataFrame, start: datetime, end: datetime, interval: str = "1 minute") -> DataFrame:
    """Whole candles that start in the range: the trades read reach to the edges of the windows."""
    from tideline.operators.windows import candles

    low, high = aligned(start, end, interval)
    return between(candles(between(silver, "event_time", low, high), interval), "interval_start", start, end)


def event_time_range(bronze: DataFrame) -> DataFrame:
    return parse(bronze).agg(F.min("t.time").alias("first_event"), F.max("t.time").alias("last_event"), F.count(F.lit(1)).alias("messages"))
