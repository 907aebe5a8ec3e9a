import json
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tideline.functions import formats
from tideline.functions import trades as T
from tideline.operators import medallion, quality, windows

GOOD = {
    "type": "match", "trade_id": 7, "maker_order_id": "m", "taker_order_id": "t", "side": "buy", "size": "0.00634069", "price": "63109.18", "product_id": "BTC-USD", "sequence": 9, "time": "2026-07-01T12:00:00.123456Z",
}


def message(**change):
    return json.dumps({k: v for k, v in (GOOD | change).items() if v is not ...})


def rows(spark, *values):
    return spark.createDataFrame([(v, datetime(2026, 7, 1)) for v in values], "value string, ingest_timestamp timestamp")


@pytest.mark.parametrize(("value", "broken"), [
    (message(), []), (message(price="0"), ["price"]), (message(price="-5"), ["price"]), (message(size="0"), ["size"]), (message(side="long"), ["side"]), (message(type="heartbeat"), ["type"]), (message(trade_id=0), ["trade_id"]),
    (message(product_id=""), ["product_id"]), (message(price=...), ["price"]), (message(fee=1), ["unknown:fee"]), (message(price="not-a-number"), ["price"]), (message(price="12,345.6"), ["price"]), (message(price=1.5), []),
    (message(sequence=1.5), ["sequence"]), (message(time="later"), ["time"]), ("{not valid json", ["malformed"]), (None, ["malformed"]),
])
def test_contract(spark, value, broken):
    assert rows(spark, value).select(T.contract_violations().alias("v")).first()["v"] == broken


def test_parse_conform_quarantine(spark):
    parsed = medallion.parse(rows(spark, message(), message(price=...), "{not valid json", message(time="bad"), None))
    good, bad = medallion.conform(parsed).collect(), medallion.quarantine(parsed).collect()
    assert len(good) == 1 and len(bad) == 4
    assert good[0]["price"] == Decimal("63109.180000000000000000") and good[0]["size"] == Decimal("0.006340690000000000")
    assert {r["reason"] for r in bad} == {medallion.PARSE_FAILURE}


@pytest.mark.parametrize(("value", "key"), [(message(), "BTC-USD"), (message(type="last_match"), "BTC-USD"), (message(type="ticker"), None), (message(product_id=None), None), (message(product_id=""), None), (message(product_id=123), None), (message(product_id=...), None), ("x", None)])
def test_ingest_key(spark, value, key):
    assert rows(spark, value).select(T.ingest_key().alias("k")).first()["k"] == key


SILVER = "product_id string, trade_id bigint, side string, price double, size double, event_time timestamp"
OK = ("BTC-USD", 1, "buy", 100.0, 1.0, datetime(2026, 7, 1))


def checks(spark, data, prior=None):
    as_of = F.lit("2026-07-02").cast("timestamp")
    return {r.name: r.passed for r in quality.collected(quality.check_silver(spark.createDataFrame(data, SILVER), as_of, prior))}


@pytest.mark.parametrize(("data", "failing"), [
    ([OK], set()), ([OK, OK], {"unique_dedup_key"}), ([(*OK[:3], 0.0, *OK[4:])], {"price_positive"}), ([(*OK[:4], -1.0, OK[5])], {"size_positive"}), ([(*OK[:2], "long", *OK[3:])], {"side_valid"}),
    ([(*OK[:2], None, *OK[3:])], set()), ([(*OK[:5], datetime(2000, 1, 1))], {"freshness"}), ([(None, *OK[1:])], {"null_keys"}), ([(*OK[:3], None, *OK[4:])], {"null_money_or_time"}), ([], {"freshness"}),
])
def test_silver_checks(spark, data, failing):
    assert {k for k, ok in checks(spark, data).items() if not ok} == failing


def test_drift(spark):
    assert not checks(spark, [OK], 100)["row_count_drift"]
    assert checks(spark, [OK], 1)["row_count_drift"] and checks(spark, [OK], 0)["row_count_drift"]


def test_gold_checks(spark):
    schema = "product_id string, interval_start timestamp, open double, high double, low double, close double, volume double"
    at = datetime(2026, 7, 1)
    run = lambda *data: {r.name for r in quality.collected(quality.check_gold(spark.createDataFrame(list(data), schema))) if not r.passed}
    good = ("BTC-USD", at, 100.0, 110.0, 90.0, 105.0, 5.0)
    assert run(good) == set() and run() == set()
    assert run(("BTC-USD", at, 92.0, 90.0, 95.0, 92.0, 5.0)) == {"ohlc_sane"}
    assert run((*good[:6], -1.0)) == {"volume_non_negative"}
    assert run(good, good) == {"grain_unique"}
    assert run((None, *good[1:])) == {"null_grain"} and run((*good[:2], None, *good[3:])) == {"null_ohlc"}


def test_candles_at_edges_and_ties(spark):
    schema = "product_id string, event_time timestamp, sequence bigint, price decimal(38,18), size decimal(38,18), side string"
    d = Decimal
    data = [
        ("A", datetime(2026, 7, 1, 0, 0), 2, d(5), d(1), "buy"), ("A", datetime(2026, 7, 1, 0, 0), 1, d(3), d(1), "sell"), ("A", datetime(2026, 7, 1, 0, 0, 59), 3, d(4), d(2), "buy"),
        ("A", datetime(2026, 7, 1, 0, 1), 4, d(9), d(0), "buy"),
    ]
    first, second = windows.candles(spark.createDataFrame(data, schema)).orderBy("interval_start").collect()
    assert (first["open"], first["close"], first["high"], first["low"], first["volume"], first["trade_count"], first["vwap"]) == (3, 4, 5, 3, 4, 3, 4.0)
    assert second["vwap"] is None and second["open"] == 9
    one = windows.sliding(spark.createDataFrame(data[3:], schema)).collect()
    assert len(one) == 4 and all(r["price_volatility"] is None for r in one)


def test_peak_counts_across_stretches(spark):
    times = [datetime(2026, 7, 1, 0, 59, 59, 500000), datetime(2026, 7, 1, 1, 0, 0, 0), datetime(2026, 7, 1, 1, 0, 0, 500000), datetime(2026, 7, 1, 1, 0, 2)]
    assert windows.feed_peak(spark.createDataFrame([(t,) for t in times], "event_time timestamp")).first()["peak_1s"] == 3
    assert windows.feed_peak(spark.createDataFrame([], "event_time timestamp")).first()["peak_1s"] == 0


def test_formats(spark):
    df = spark.createDataFrame([(None,), (90.0,), (7200.0,)], "s double").select(formats.age("s").alias("a"))
    assert [r["a"] for r in df.collect()] == ["-", "1.5m", "2.0h"]
