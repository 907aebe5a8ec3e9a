"""Declared schemas; nothing is inferred but the transaction log's own JSON."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(38, 18)
#: The fields of a trade message and their types: fixed by the feed.
TRADE = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("trade_id", T.LongType()), T.StructField("maker_order_id", T.StringType()), T.StructField("taker_order_id", T.StringType()),
    T.StructField("side", T.StringType()), T.StructField("size", MONEY), T.StructField("price", MONEY), T.StructField("product_id", T.StringType()), T.StructField("sequence", T.LongType()), T.StructField("time", T.TimestampType()),
])
BRONZE = "key string, value string, topic string, partition int, offset bigint, kafka_timestamp timestamp, kafka_timestamp_type int, ingest_timestamp timestamp"
ENVELOPE = "key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp, timestampType int"
SILVER = "product_id string, trade_id bigint, side string, price decimal(38,18), size decimal(38,18), sequence bigint, maker_order_id string, taker_order_id string, event_time timestamp, ingest_timestamp timestamp, silver_timestamp timestamp"
GOLD = "product_id string, interval_start timestamp, interval_end timestamp, open decimal(38,18), high decimal(38,18), low decimal(38,18), close decimal(38,18), volume decimal(38,18), vwap double, trade_count bigint, date date"
REALTIME = "product_id string, window_start timestamp, window_end timestamp, trade_count bigint, volume decimal(38,18), vwap double, price_volatility double"
DQ_METRICS = "table_name string, row_count bigint, checked_at timestamp"
RUNS = "job string, layer string, event string, rows bigint, dq_passed int, dq_failed int, duration_seconds double, freshness_seconds double, ts timestamp"
