"""The tables as market data: trades over ``events``, the raw log over trades, bulk trades over ``lineitem``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOPIC = "trades.raw"
PARTITIONS = 6
#: Ids whose message is damaged in the raw log: not JSON, no price, a field too many, a side out of its domain; and those sent twice.
BROKEN, PRICELESS, EXTRA, SIDELESS, TWICE = 97, 89, 83, 71, 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver rows, without the two processing timestamps."""
    user = F.col("user_id")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("product_id"), F.col("event_id").alias("trade_id"), F.when(user % 2 == 0, "buy").otherwise("sell").alias("side"),
        F.col("value").cast("decimal(38,18)").alias("price"), F.from_json("props", "k int")["k"].cast("decimal(38,18)").alias("size"), F.col("event_id").alias("sequence"),
        F.concat(F.lit("m"), user.cast("string")).alias("maker_order_id"), F.concat(F.lit("t"), (user % 7).cast("string")).alias("taker_order_id"), F.col("ts").cast("timestamp").alias("event_time"),
    )


def log_partition(key: str) -> Column:
    """The log partition of a key: stable over runs and engines."""
    return (F.conv(F.substring(F.md5(F.col(key)), 1, 7), 16, 10).cast("bigint") % PARTITIONS).cast("int")


def bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw log as landed: messages as sent, some damaged, some twice."""
    t = trades(spark, sf_dir)
    n = F.col("trade_id")
    sent = F.struct(
        F.lit("match").alias("type"), n.alias("trade_id"), "maker_order_id", "taker_order_id", F.when(n % SIDELESS == 0, "hold").otherwise(F.col("side")).alias("side"),
        F.col("size").cast("string").alias("size"), F.when(n % PRICELESS != 0, F.col("price").cast("string")).alias("price"), "product_id", "sequence",
        F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("time"), F.when(n % EXTRA == 0, 1).alias("extra"),
    )
    copies = F.explode(F.when(n % TWICE == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    value = F.when(n % BROKEN == 0, "{not valid json").otherwise(F.to_json(sent))
    rows = t.select("*", value.alias("value"), copies.alias("copy"))
    stamp = F.col("event_time") + F.expr("INTERVAL 1 SECOND")
    return rows.select(
        F.col("product_id").alias("key"), "value", F.lit(TOPIC).alias("topic"), log_partition("product_id").alias("partition"), (n * 2 + F.col("copy")).alias("offset"),
        stamp.alias("kafka_timestamp"), F.lit(0).alias("kafka_timestamp_type"), (stamp + F.expr("INTERVAL 1 SECOND")).alias("ingest_timestamp"),
    )


def bulk_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many trades with natural duplicates of (order, line), for throughput."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("product_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("trade_id"), F.lit("buy").alias("side"),
        F.col("l_extendedprice").cast("decimal(38,18)").alias("price"), F.col("l_quantity").cast("decimal(38,18)").alias("size"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10_000_000 + F.col("l_partkey")).alias("sequence"),
        F.lit("m").alias("maker_order_id"), F.lit("t").alias("taker_order_id"), F.col("l_shipdate").cast("timestamp").alias("event_time"),
    )
