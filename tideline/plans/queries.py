"""Every operator as a query over the driver's tables: name -> function of (session, folder).

Processing times are frozen and timestamps leave without a zone, so that another engine can be held against them.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline import schemas, session
from tideline.functions import formats
from tideline.functions import trades as fn
from tideline.operators import medallion, observe, quality, reports, windows
from tideline.plans import jobs as jobs_
from tideline.plans.jobs import GoldReader, Lake, backfill, gold_batch, gold_job, layout_probe, silver_batch
from tideline.sources import log as logs
from tideline.sources import tables
from tideline.store.table import Table
from tideline.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
AS_OF = datetime(2024, 2, 1, tzinfo=UTC)
START, END = datetime(2024, 1, 10, tzinfo=UTC), datetime(2024, 1, 12, tzinfo=UTC)
ACTIVE = "click"


def at() -> F.Column:
    return F.lit(AS_OF)


def plain(df: DataFrame) -> DataFrame:
    """Zoned times as UTC wall time, dates as text, money as its exact digits; doubles to six places."""
    def one(f: T.StructField) -> F.Column:
        c = F.col(f.name)
        if isinstance(f.dataType, T.TimestampType):
            return c.cast("timestamp_ntz").alias(f.name)
        if isinstance(f.dataType, T.DateType):
            return c.cast("string").alias(f.name)
        if isinstance(f.dataType, T.DecimalType):
            return F.translate(F.format_number(c, f.dataType.scale), ",", "").alias(f.name)
        return F.round(c + 1e-9, 6).alias(f.name) if isinstance(f.dataType, T.DoubleType) else c

    return df.select(*map(one, df.schema.fields))


def query(f: Query) -> Query:
    QUERIES[f.__name__] = lambda spark, sf_dir: plain(f(session.pin(spark), sf_dir))
    return f


def _lake(spark: SparkSession, name: str) -> Lake:
    return Lake(spark, session.scratch(spark, name))


def _silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed trades with the frozen processing times."""
    return tables.trades(spark, sf_dir).withColumn("ingest_timestamp", at()).withColumn("silver_timestamp", at())


def _gold(spark: SparkSession, sf_dir: str, interval: str = "1 hour") -> DataFrame:
    return windows.candles(tables.trades(spark, sf_dir), interval)


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run record for each trade."""
    t = tables.trades(spark, sf_dir)
    n = F.col("trade_id")
    return t.select(
        F.concat(F.lit("job"), (n % 3).cast("string")).alias("job"), F.when(n % 20 == 0, "silver").otherwise("gold").alias("layer"), F.lit("done").alias("event"), F.when(n % 70 != 0, n).alias("rows"),
        F.when(n % 30 != 0, 8).alias("dq_passed"), F.when(n % 30 != 0, (n % 40 / 20).cast("int")).alias("dq_failed"), (n % 50).cast("double").alias("duration_seconds"), F.when(n % 60 != 0, (n * 7 % 20000).cast("double")).alias("freshness_seconds"), F.col("event_time").alias("ts"),
    )


def _dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver with defects of every kind."""
    n = F.col("trade_id")
    rows = _silver(spark, sf_dir).withColumn("price", F.when(n % 91 == 0, F.lit(0).cast("decimal(38,18)")).when(n % 101 != 0, F.col("price"))).withColumn("side", F.when(n % 61 == 0, "long").when(n % 67 != 0, F.col("side")))
    return rows.withColumn("product_id", F.when(n % 103 != 0, F.col("product_id"))).withColumn("event_time", F.when(n % 107 != 0, F.col("event_time"))).withColumn("trade_id", F.when(n % 109 == 0, 0).otherwise(n))


def _dirty_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.day("interval_start")
    rows = _gold(spark, sf_dir, "1 day")
    return rows.withColumn("high", F.when(n == 3, (F.col("low") - 1).cast("decimal(38,18)")).otherwise(F.col("high"))).withColumn("volume", F.when(n == 5, -F.col("volume")).otherwise(F.col("volume"))).withColumn("close", F.when(n != 7, F.col("close"))).withColumn("product_id", F.when(n != 9, F.col("product_id")))


# scans and projections


@query
def scan_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.trades(spark, sf_dir)


@query
def scan_bulk_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.bulk_trades(spark, sf_dir).groupBy("product_id").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.count_distinct("trade_id").alias("ids"))


@query
def bronze_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = logs.envelopes(tables.bronze(spark, sf_dir), "key", "value", "kafka_timestamp", "offset", tables.TOPIC)
    return medallion.land(sent, at())


@query
def log_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logs.envelopes(tables.trades(spark, sf_dir).withColumn("value", F.col("trade_id").cast("string")), "product_id", "value", "event_time", "trade_id", tables.TOPIC)
    path = session.scratch(spark, "log")
    logs.produce(rows, path)
    return logs.read(spark, path).select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "topic", "partition", "offset", "timestamp")


@query
def silver_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return medallion.parse(tables.bronze(spark, sf_dir)).select("partition", "offset", "t.trade_id", "t.product_id", "t.side", "t.price", "t.size", "t.time")


@query
def silver_conform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return medallion.conform(medallion.parse(tables.bronze(spark, sf_dir)), at())


@query
def quarantine_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return medallion.quarantine(medallion.parse(tables.bronze(spark, sf_dir)), at())


@query
def speed_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return medallion.speed_trades(tables.bronze(spark, sf_dir))


@query
def ingest_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.bronze(spark, sf_dir).withColumn("product", fn.ingest_key()).where("product IS NOT NULL").groupBy("product").agg(F.count("*").alias("n"))


@query
def gold_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.candles(medallion.scoped(tables.trades(spark, sf_dir), ACTIVE, 10, at()), "1 hour")


@query
def backfill_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return medallion.backfill_trades(tables.bronze(spark, sf_dir), START, END, at())[0]


@query
def dq_silver_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dirty(spark, sf_dir).where(fn.silver_violation()).select("product_id", "trade_id", "side", "price", "sequence")


@query
def dq_gold_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dirty_gold(spark, sf_dir).where(fn.gold_violation()).select("product_id", "interval_start", "high", "close", "volume")


@query
def fmt_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).select("job", "layer", "ts", formats.age("freshness_seconds").alias("age"))


@query
def fmt_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.trades(spark, sf_dir).withColumn("time", F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).withColumn("price", F.when(F.col("trade_id") % 9 != 0, F.col("price").cast("decimal(18,2)").cast("string"))).withColumn("size", F.col("size").cast("int"))
    return t.select("trade_id", formats.trade_line().alias("line"))


# contract


@query
def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.contract_rows(tables.bronze(spark, sf_dir)).select("partition", "offset", F.array_join("violations", ",").alias("violations"))
    return rows.where("violations <> ''")


@query
def contract_unknown_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.contract_rows(tables.bronze(spark, sf_dir))
    return rows.select(F.explode(F.filter("violations", lambda v: v.startswith("unknown:"))).alias("field")).groupBy("field").agg(F.count("*").alias("n"))


@query
def contract_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.contract_report(tables.bronze(spark, sf_dir))


@query
def contract_per_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.contract_per_product(tables.bronze(spark, sf_dir))


@query
def contract_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.contract_samples(tables.bronze(spark, sf_dir)).select("partition", "offset", F.array_join("violations", ",").alias("violations"))


# aggregates and windows


def _candles(interval: str) -> Query:
    return lambda spark, sf_dir: plain(windows.candles(tables.trades(session.pin(spark), sf_dir), interval))


QUERIES |= {f"gold_ohlc_{k}": _candles(v) for k, v in {"1m": "1 minute", "5m": "5 minutes", "1h": "1 hour", "1d": "1 day"}.items()}


@query
def gold_ohlc_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.candles(tables.bulk_trades(spark, sf_dir), "1 day")


@query
def speed_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sliding(tables.trades(spark, sf_dir), "1 hour", "15 minutes")


@query
def layer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.layer_counts(_dirty(spark, sf_dir), _dirty_gold(spark, sf_dir))


@query
def distinct_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dirty(spark, sf_dir).agg(F.count_distinct("product_id", "trade_id").alias("n"))


@query
def distinct_keys_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dirty(spark, sf_dir).agg(F.count_distinct(F.struct("product_id", "trade_id")).alias("n"))


@query
def dq_silver_one_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.silver_counts(_dirty(spark, sf_dir))


@query
def dq_gold_one_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.gold_counts(_dirty_gold(spark, sf_dir))


@query
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.trades(spark, sf_dir).agg(F.max("event_time").alias("newest"))


@query
def event_time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return medallion.event_time_range(tables.bronze(spark, sf_dir))


@query
def feed_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.feed_rates(tables.trades(spark, sf_dir))


@query
def feed_peak_1s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.feed_peak(tables.trades(spark, sf_dir))


@query
def producer_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.throughput(tables.bronze(spark, sf_dir))


@query
def order_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.order_flow(tables.trades(spark, sf_dir))


@query
def sequence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sequence_gaps(tables.trades(spark, sf_dir))


@query
def sweeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sweeps(tables.trades(spark, sf_dir))


# quality


@query
def dq_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.check_silver(_dirty(spark, sf_dir), at(), 12_000)


@query
def dq_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.check_gold(_dirty_gold(spark, sf_dir), 100)


@query
def dq_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.tally(quality.check_silver(_dirty(spark, sf_dir), at()).union(quality.check_gold(_gold(spark, sf_dir))))


@query
def row_count_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.check_silver(tables.trades(spark, sf_dir), at(), 12_000).where("name = 'row_count_drift'")


@query
def quarantine_silver_dq(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _lake(spark, "dq").table("silver/quarantine/dq")
    table.append(medallion.flagged(_dirty(spark, sf_dir), fn.silver_violation(), medallion.SILVER_FAILURE, at()))
    return table.read().select("product_id", "trade_id", "price", "sequence", "reason", "quarantined_at")


@query
def quarantine_gold_dq(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _lake(spark, "dq").table("gold/quarantine/dq")
    table.append(medallion.flagged(_dirty_gold(spark, sf_dir), fn.gold_violation(), medallion.GOLD_FAILURE, at()))
    return table.read().select("product_id", "interval_start", "high", "reason", "quarantined_at")


# reads and reports


@query
def recent_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.recent_candles(_gold(spark, sf_dir))


@query
def run_metrics_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.latest_runs(_runs(spark, sf_dir))


@query
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.run_report(_runs(spark, sf_dir))


@query
def run_metrics_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _lake(spark, "runs").runs
    for i in range(3):
        observe.record_run(table, f"job{i}", "silver", "done", rows=100 * i, dq_passed=8, dq_failed=i, at=AS_OF)
    return table.read()


@query
def prior_row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = _runs(spark, sf_dir).select(F.col("layer").alias("table_name"), F.col("rows").alias("row_count"), F.col("ts").alias("checked_at"))
    return reports.prior_row_count(metrics.where("row_count IS NOT NULL"), "silver")


@query
def prior_rows_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.prior_rows(_runs(spark, sf_dir), "gold")


@query
def api_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = _lake(spark, "api")
    lake.gold("1 hour").append(_gold(spark, sf_dir), ["date"])
    return GoldReader(lake, interval="1 hour").candles(ACTIVE)


@query
def api_candles_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.api_candles(_gold(spark, sf_dir), ACTIVE, START, END)


@query
def api_candles_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.api_json(reports.api_candles(_gold(spark, sf_dir), ACTIVE, START, END))


@query
def api_realtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.api_realtime(windows.sliding(tables.trades(spark, sf_dir), "1 hour", "15 minutes"))


@query
def api_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.api_runs(_runs(spark, sf_dir))


@query
def api_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = _lake(spark, "health")
    lake.gold().append(_gold(spark, sf_dir), ["date"])
    return spark.createDataFrame(list(GoldReader(lake).table_status().items()), "table_name string, reachable boolean")


# versioned tables


def _versioned(spark: SparkSession, sf_dir: str) -> Table:
    table = Table(spark, session.scratch(spark, "versions"), ["trade_id"])
    rows = tables.trades(spark, sf_dir).select("trade_id", "product_id", "price")
    table.overwrite(rows.where("trade_id % 3 = 0"))
    table.append(rows.where("trade_id % 3 <> 0"))
    return table


@query
def time_travel_v0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versioned(spark, sf_dir).read(0)


@query
def table_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versioned(spark, sf_dir).read()


@query
def table_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versioned(spark, sf_dir).history().select("version", "operation")


@query
def table_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versioned(spark, sf_dir).log().select("version", "operation", F.aggregate("add", F.lit(0).cast("bigint"), lambda n, f: n + f["rows"]).alias("row_count"))


@query
def table_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versioned(spark, sf_dir).detail().select("row_count", "version", F.array_join("partition_columns", ",").alias("partition_columns"))


def _merged(spark: SparkSession, sf_dir: str) -> Table:
    """Odd trades, then all of the even ones and every fifth again at twice the price."""
    table = Table(spark, session.scratch(spark, "merge"), ["trade_id"])
    rows = _silver(spark, sf_dir).drop("ingest_timestamp", "silver_timestamp")
    table.merge(rows.where("trade_id % 2 = 1"), medallion.KEY)
    table.merge(rows.where("trade_id % 2 = 0 OR trade_id % 5 = 0").withColumn("price", (F.col("price") * 2).cast("decimal(38,18)")), medallion.KEY)
    return table


@query
def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).read()


@query
def merge_self_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _merged(spark, sf_dir)
    table.self_update(medallion.KEY, F.col("product_id") == ACTIVE, 500)
    return table.read().select("product_id", "trade_id", "price")


@query
def merge_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _merged(spark, sf_dir)
    before = table.read()
    for _ in range(2):
        table.self_update(medallion.KEY)
    after = table.read()
    return before.exceptAll(after).union(after.exceptAll(before)).agg(F.count("*").alias("differences"))


@query
def optimize_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = Table(spark, session.scratch(spark, "optimize"))
    for i in range(3):
        table.append(_gold(spark, sf_dir).where(F.day("interval_start") % 3 == i), ["date"])
    table.optimize()
    return table.read()


@query
def optimize_zorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _versioned(spark, sf_dir)
    table.optimize(64 << 10, ["product_id", "trade_id"])
    return table.read()


@query
def optimize_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that a filter holds before and after the layout changes."""
    table = _versioned(spark, sf_dir)
    out = layout_probe(table, ["product_id", "trade_id"], F.col("product_id") == ACTIVE, 64 << 10)
    return spark.createDataFrame([(out["before"]["rows"], out["after"]["rows"], out["files_added"] > 0)], "rows_before bigint, rows_after bigint, rewritten boolean")


@query
def clustered_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = Table(spark, session.scratch(spark, "clustered"))
    table.append(_gold(spark, sf_dir), ["date"], ["product_id", "interval_start"])
    return table.read().crossJoin(table.detail().select(F.array_join("clustering_columns", ",").alias("clustering_columns")))


@query
def snapshot_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last version has and the first has not, by SQL names of snapshots."""
    table = _versioned(spark, sf_dir)
    table.view("trades_now")
    table.view("trades_first", 0)
    return spark.sql("SELECT product_id, count(*) AS n, sum(price) AS price FROM trades_now LEFT ANTI JOIN trades_first USING (trade_id) GROUP BY product_id")


@query
def vacuum_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _versioned(spark, sf_dir)
    table.overwrite(table.read())
    return spark.createDataFrame([(len(table.vacuum()), len(table.vacuum(0)) > 0)], "within_retention bigint, beyond boolean")


@query
def partition_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = Table(spark, session.scratch(spark, "partitions"))
    table.append(_gold(spark, sf_dir), ["date"])
    return table.partitions()


@query
def schema_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = Table(spark, session.scratch(spark, "schema"), ["trade_id"])
    rows = tables.trades(spark, sf_dir).select("trade_id", "product_id", "price", "side")
    table.append(rows.where("trade_id % 3 < 2").drop("side"))
    table.append(rows.where("trade_id % 3 = 2"), merge_schema=True)
    return table.read()


# jobs


def _landed(spark: SparkSession, sf_dir: str) -> Lake:
    lake = _lake(spark, "lake")
    lake.bronze.append(tables.bronze(spark, sf_dir))
    return lake


@query
def silver_batch_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = _landed(spark, sf_dir)
    for _ in range(2):
        silver_batch(lake, at())
    return lake.silver.read().drop("silver_timestamp")


@query
def gold_batch_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = _lake(spark, "lake")
    lake.silver.append(_silver(spark, sf_dir))
    gold_batch(lake, "1 hour", ACTIVE)
    gold_batch(lake, "1 hour")
    return lake.gold("1 hour").read()


@query
def gold_full_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest candles, and the counts that two runs of the job recorded."""
    lake = _lake(spark, "lake")
    lake.silver.append(_silver(spark, sf_dir))
    gold_job(lake, "1 hour", ACTIVE)
    newest = gold_job(lake, "1 hour")
    runs = lake.runs.read().agg(F.count("*").alias("runs"), F.max("rows").alias("candles"))
    counts = lake.counts.read().agg(F.array_join(F.array_sort(F.collect_list("row_count")).cast("array<string>"), ",").alias("counted"))
    return newest.select("product_id", "interval_start", "open", "close", "volume").crossJoin(runs.crossJoin(counts))  # three small results side by side


@query
def layer_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver and its candles; bronze is not there and run records cannot be read."""
    lake = _lake(spark, "lake")
    lake.silver.append(_silver(spark, sf_dir))
    gold_batch(lake, "1 hour")
    observe.record_run(lake.runs, "job", "silver", "done")
    for path in lake.runs.snapshot().files:
        lake.runs.files.delete(path)
    return jobs_.layer_report(lake, "1 hour")


@query
def backfill_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = _landed(spark, sf_dir)
    backfill(lake, START, END, gold=False)
    return lake.silver.read().drop("silver_timestamp")


@query
def backfill_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = _lake(spark, "lake")
    lake.silver.append(_silver(spark, sf_dir))
    backfill(lake, START, END, "7 hours", silver=False)
    return lake.gold("7 hours").read()


# streams


def _log_files(spark: SparkSession, sf_dir: str, name: str) -> str:
    path = session.scratch(spark, name)
    b = tables.bronze(spark, sf_dir)
    b.select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), "topic", "partition", "offset", F.col("kafka_timestamp").alias("timestamp"), F.col("kafka_timestamp_type").alias("timestampType")).coalesce(1).write.parquet(path)
    return path


@query
def bronze_stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    home = session.scratch(spark, "bronze")
    table = Table(spark, f"{home}/table")
    for _ in range(2):  # the second run finds nothing new
        jobs.bronze(logs.stream(spark, _once(spark, sf_dir, home)), table, f"{home}/checkpoint", None).awaitTermination()
    return table.read(schema=schemas.BRONZE).select("key", "value", "topic", "partition", "offset", "kafka_timestamp")


def _once(spark: SparkSession, sf_dir: str, home: str) -> str:
    path = f"{home}/log"
    if not Table(spark, home).files.exists(path):
        b = tables.bronze(spark, sf_dir)
        b.select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), "topic", "partition", "offset", F.col("kafka_timestamp").alias("timestamp"), F.col("kafka_timestamp_type").alias("timestampType")).coalesce(1).write.parquet(path)
    return path


def _silver_stream(spark: SparkSession, sf_dir: str) -> Lake:
    lake = _lake(spark, "stream")
    lake.bronze.append(tables.bronze(spark, sf_dir).coalesce(1))
    for q in jobs.silver(lake.bronze.stream(), lake.silver, lake.quarantine, f"{lake.home}/checkpoint", None):
        q.awaitTermination()
    return lake


@query
def silver_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _silver_stream(spark, sf_dir).silver.read().select("product_id", "trade_id", "price", "size", "event_time")


@query
def quarantine_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _silver_stream(spark, sf_dir).quarantine.read().drop("quarantined_at")


@query
def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a log gets after its reader has started: the messages of the month's second half."""
    home = session.scratch(spark, "tail")
    rows = logs.envelopes(tables.trades(spark, sf_dir).withColumn("value", F.col("trade_id").cast("string")), "product_id", "value", "event_time", "trade_id", tables.TOPIC)
    late = F.day("timestamp") > 15
    logs.produce(rows.where(~late), f"{home}/log")
    since = logs.now(spark, f"{home}/log")
    logs.produce(rows.where(late), f"{home}/log")
    table = Table(spark, f"{home}/table")
    jobs.bronze(logs.tail(spark, f"{home}/log", since), table, f"{home}/checkpoint", None).awaitTermination()
    return table.read(schema=schemas.BRONZE).select("key", "value", "partition", "offset", "kafka_timestamp")


def _speed(spark: SparkSession, sf_dir: str, start: Callable) -> DataFrame:
    home = session.scratch(spark, "speed")
    table = Table(spark, f"{home}/table")
    start(logs.stream(spark, _log_files(spark, sf_dir, "speed-log")), table, f"{home}/checkpoint", None, "1 hour", "15 minutes", "1 minute").awaitTermination()
    return table.read(schema=schemas.REALTIME)


@query
def speed_stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _speed(spark, sf_dir, jobs.speed)


@query
def speed_stream_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _speed(spark, sf_dir, jobs.speed_upserts)


@query
def reconcile_speed_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = windows.sliding(medallion.speed_trades(tables.bronze(spark, sf_dir)), "1 hour", "15 minutes")
    return reports.reconciled(batch, _speed(spark, sf_dir, jobs.speed))


FLAGSHIP = "gold_ohlc_1h"
