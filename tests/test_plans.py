"""What the optimizer makes of the hot queries."""

import pytest
from pyspark.sql import functions as F

from tideline.functions import trades as T
from tideline.operators import medallion, ordering, quality, windows
from tideline.sources import log, tables

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_messages_are_parsed_once(spark):
    bronze = tables.bronze(spark, SF)
    made = plan(bronze).count("from_json")  # of the fixture itself
    assert plan(medallion.conform(medallion.parse(bronze))).count("from_json") == made + 1
    assert plan(medallion.quarantine(medallion.parse(bronze))).count("from_json") == made + 1
    assert plan(medallion.speed_trades(bronze)).count("from_json") == made + 1
    report = plan(quality.contract_report(bronze))
    assert report.count("from_json") == made + 1 and "get_json_object" not in report and "json_object_keys" not in report


def test_candles_are_hash_aggregated(spark):
    text = plan(windows.candles(tables.trades(spark, SF)))
    assert "HashAggregate" in text and "SortAggregate" not in text and "Sort [" not in text


def test_scans_are_pruned_and_filtered(spark):
    text = plan(windows.candles(tables.bulk_trades(spark, SF).where(F.col("product_id") == "NO").where(F.col("event_time") >= "1995-01-01"), "1 day"))
    assert "l_comment" not in text and "l_tax" not in text and "PushedFilters: [" in text


@pytest.mark.parametrize("width", [1, 7, 1 << 20])
def test_numbers_and_steps_along_an_order(spark, width):
    rows = spark.createDataFrame([(g, v, i) for i, (g, v) in enumerate([("a", 3), ("a", 3), ("a", 9), ("a", None), ("b", -20), ("b", 40), (None, 5), ("a", 10), ("b", -21)])], "g string, v bigint, i int")
    got = {(r["g"], r["i"]): r["n"] for r in ordering.numbered(rows, "g", F.col("v"), ["v", "i"], width, "n").collect()}
    assert got == {("a", 3): 0, ("a", 0): 1, ("a", 1): 2, ("a", 2): 3, ("a", 7): 4, ("b", 8): 0, ("b", 4): 1, ("b", 5): 2, (None, 6): 0}
    assert sorted(map(tuple, ordering.steps(rows, "g", "v", width).collect())) == [("a", 3, 3), ("a", 3, 9), ("a", 9, 10), ("b", -21, -20), ("b", -20, 40)]
    assert ordering.steps(rows.limit(0), "g", "v", width).isEmpty() and ordering.numbered(rows.limit(0), "g", F.col("v"), ["v"], width, "n").isEmpty()


def test_no_task_sorts_a_whole_log_partition(spark):
    text = plan(log.envelopes(tables.trades(spark, SF).withColumn("value", F.lit("x")), "product_id", "value", "event_time", "trade_id", "t"))
    assert "hashpartitioning(partition#" in text and text.count("_stretch") > 2


def test_null_prices_and_sequences_in_candles(spark):
    rows = spark.sql("SELECT 'A' AS product_id, timestamp'2026-07-01 00:00:00' + make_interval(0,0,0,0,0,0,s) AS event_time, n AS sequence, CAST(p AS DECIMAL(38,18)) AS price, CAST(1 AS DECIMAL(38,18)) AS size FROM VALUES (0, 5L, 1), (0, NULL, 2), (9, 1L, 3), (9, 7L, 4) t(s, n, p)")
    one = windows.candles(rows).first()
    assert (one["open"], one["close"]) == (2, 4)


def test_strict_contract_and_lenient_json(spark):
    rows = spark.createDataFrame([('{"price": NaN}',), ("[]",), ("",), ("5",)], "value string")
    assert [r[0] for r in rows.select(T.contract_violations()).collect()] == [["malformed"]] * 4
