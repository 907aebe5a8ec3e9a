"""Reports and reads over gold, the run metrics and the drift baselines."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions import formats

CANDLE = ("product_id", "interval_start", "interval_end", "open", "high", "low", "close", "volume", "vwap", "trade_count")
REALTIME = ("product_id", "window_start", "window_end", "trade_count", "volume", "vwap", "price_volatility")


def latest_runs(runs: DataFrame) -> DataFrame:
    """The newest row of each job and layer; of equal times, that of the last event by name."""
    newest = Window.partitionBy("job", "layer").orderBy(F.desc("ts"), F.desc("event"))
    return runs.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n").orderBy("job", "layer")


def run_report(runs: DataFrame) -> DataFrame:
    """The latest runs as shown: passed of all checks, age, and whether a check fails."""
    passed, failed = (F.coalesce(c, F.lit(0)) for c in ("dq_passed", "dq_failed"))
    dq = F.when(F.col("dq_passed").isNull() & F.col("dq_failed").isNull(), "-").otherwise(F.concat_ws("/", passed.cast("string"), (passed + failed).cast("string")))
    return latest_runs(runs).select("job", "layer", F.coalesce(F.format_number("rows", 0), F.lit("-")).alias("rows"), dq.alias("dq"), formats.age("freshness_seconds").alias("age"), F.date_format("ts", "yyyy-MM-dd HH:mm").alias("last_run"), (failed > 0).alias("failing"))


def prior_row_count(metrics: DataFrame, table_name: str) -> DataFrame:
    return metrics.where(F.col("table_name") == table_name).orderBy(F.desc("checked_at")).limit(1).select("row_count")


def prior_rows(runs: DataFrame, layer: str) -> DataFrame:
    return runs.where((F.col("layer") == layer) & F.col("rows").isNotNull()).orderBy(F.desc("ts")).limit(1).select("rows")


def scalar(one: DataFrame) -> int | None:
    """The value of a report of one row at most."""
    rows = one.take(1)
    return None if not rows or rows[0][0] is None else int(rows[0][0])


def recent_candles(gold: DataFrame, n: int = 10) -> DataFrame:
    return gold.orderBy(F.desc("interval_start"), "product_id").limit(n)


def layer_counts(silver: DataFrame, gold: DataFrame) -> DataFrame:
    """Rows and distinct keys of each layer; a repeated key shows as a difference."""
    one = lambda df, layer, *key: df.agg(F.lit(layer).alias("layer"), F.count(F.lit(1)).alias("row_count"), F.count_distinct(*key).alias("distinct_keys"))
    return one(silver, "silver", "product_id", "trade_id").union(one(gold, "gold", "product_id", "interval_start"))


def _checked(limit: int, most: int) -> int:
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be from 1 to {most}")
    return limit


def api_candles(gold: DataFrame, product: str, start: datetime | None = None, end: datetime | None = None, limit: int = 200) -> DataFrame:
    """A product's candles, newest first; both bounds belong to the range."""
    rows = gold.where(F.col("product_id") == product)
    rows = rows.where(F.col("interval_start") >= F.lit(start)) if start else rows
    rows = rows.where(F.col("interval_start") <= F.lit(end)) if end else rows
    return rows.select(*CANDLE).orderBy(F.desc("interval_start")).limit(_checked(limit, 5000))


def api_realtime(realtime: DataFrame, product: str | None = None, limit: int = 100) -> DataFrame:
    rows = realtime.where(F.col("product_id") == product) if product else realtime
    return rows.select(*REALTIME).orderBy(F.desc("window_start"), "product_id").limit(_checked(limit, 5000))


def api_runs(runs: DataFrame, limit: int = 50) -> DataFrame:
    return runs.orderBy(F.desc("ts"), "job", "layer").limit(_checked(limit, 1000))


def api_json(candles: DataFrame) -> DataFrame:
    """The response rows: decimals as exact strings."""
    return candles.select("product_id", "interval_start", formats.candle_json(["product_id", "open", "high", "low", "close", "volume", "trade_count"]).alias("body"))


def reconciled(batch: DataFrame, streamed: DataFrame) -> DataFrame:
    """Windows that one of two layers lacks, or whose counts or volumes differ."""
    key = ["product_id", "window_start"]
    a = batch.select(*key, F.col("trade_count").alias("batch_count"), F.col("volume").alias("batch_volume"))
    b = streamed.select(*key, F.col("trade_count").alias("speed_count"), F.col("volume").alias("speed_volume"))
    return a.join(b, key, "full_outer").where(~(F.col("batch_count").eqNullSafe(F.col("speed_count")) & F.col("batch_volume").eqNullSafe(F.col("speed_volume"))))


def representative_filter(columns: list[str]) -> Column:
    """A predicate that a layout probe can time: on the product, else on the log key, else none."""
    for name in ("product_id", "key"):
        if name in columns:
            return F.col(name).isNotNull()
    return F.lit(True)
