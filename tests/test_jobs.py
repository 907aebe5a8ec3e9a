"""Workflows, the command line, events and alerts, and what watches streams."""

import io
import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F
from test_tables import bronze_rows, silver_rows

from tideline.operators import observe
from tideline.plans import jobs
from tideline.plans.jobs import Lake, Step, backfill_run, gold_job, main, nightly, workflow
from tideline.sources import log
from tideline.sources.log import Replay
from tideline.store.table import Table
from tideline.streaming import jobs as streams


def test_workflow_tries_again_and_stops():
    seen, alerts = [], []

    def flaky():
        seen.append("flaky")
        if seen.count("flaky") < 3:
            raise ValueError("not yet")

    assert workflow("w", [Step("flaky", flaky), Step("next", lambda: seen.append("next"))], 2, 0, to=alerts.append)
    assert seen == ["flaky"] * 3 + ["next"] and alerts == []
    seen.clear()
    assert not workflow("w", [Step("flaky", flaky), Step("never", lambda: seen.append("never"))], 1, 0, "run-1", alerts.append)
    assert seen == ["flaky"] * 2
    assert {k: alerts[0][k] for k in ("alert", "dag_id", "task_id", "run_id", "try_number", "max_tries", "error")} == {"alert": "task_failed", "dag_id": "w", "task_id": "flaky", "run_id": "run-1", "try_number": 2, "max_tries": 2, "error": "not yet"}
    assert not workflow("w", [Step("checks", lambda: False)], 3, 0, to=alerts.append) and alerts[-1]["try_number"] == 1


def test_nightly_goes_product_by_product(spark, tmp_path, monkeypatch):
    lake, seen = Lake(spark, str(tmp_path)), []
    monkeypatch.setattr(jobs, "gold_batch", lambda lake, interval, product=None, *a: seen.append(product))
    monkeypatch.setattr(jobs, "validate", lambda lake, layer, interval: seen.append(layer) or layer == "silver")
    assert nightly(lake, products=["A", "B"]) is False and seen == ["A", "B", "silver", "gold"]
    seen.clear()
    assert nightly(lake) is False and seen == [None, "silver", "gold"]


def test_backfill_as_a_workflow(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    lake.bronze.append(bronze_rows(spark))
    assert backfill_run(lake, "2023-11-14", "2023-11-16", wait_seconds=0)
    assert lake.silver.read().count() == 49 and lake.gold().read().agg(F.sum("trade_count")).first()[0] == 49
    told = []
    assert not backfill_run(Lake(spark, str(tmp_path / "none")), "2023-11-14", "2023-11-16", wait_seconds=0, to=told.append)
    assert told[0]["task_id"] == "backfill_silver" and told[0]["try_number"] == 2
    with pytest.raises(ValueError):
        backfill_run(lake, "2023-11-16", "2023-11-16")


def test_full_gold_job(spark, tmp_path, capsys):
    lake = Lake(spark, str(tmp_path))
    lake.silver.append(silver_rows(spark))
    newest = gold_job(lake)
    assert newest.count() <= 10 and newest.first()["interval_start"] == lake.gold().read().agg(F.max("interval_start")).first()[0]
    lake.gold().overwrite(lake.gold().read().limit(1), ["date"])
    lake.silver.overwrite(silver_rows(spark, 1))
    gold_job(lake)
    events = [json.loads(x) for x in capsys.readouterr().err.splitlines() if x.startswith('{"ts"')]
    drift = [e["passed"] for e in events if e.get("check") == "row_count_drift"]
    assert drift == [True, False] and [e["event"] for e in events[:2]] == ["started", "candles_written"]
    assert lake.runs.read().count() == 2 and lake.counts.read().count() == 2


def test_command_line(spark, tmp_path, capsys):
    home = str(tmp_path)
    lake = Lake(spark, home)
    lake.bronze.append(bronze_rows(spark))
    assert main([home, "backfill", "--show-range"]) == 0 and "2023-11-14" in capsys.readouterr().out
    assert main([home, "backfill"]) == 1 and main([home, "backfill", "--start", "2023-11-15", "--end", "2023-11-15"]) == 1
    assert main([home, "backfill", "--start", "2023-11-14", "--end", "2023-11-16", "--skip-gold"]) == 0 and not lake.gold().exists()
    assert main([home, "silver"]) == 0 and main([home, "gold", "--minimal", "--product", "A"]) == 0 and not lake.runs.exists()
    assert main([home, "gold"]) == 0 and main([home, "validate", "--layer", "gold"]) == 0 and main([home, "validate"]) == 1
    assert main([home, "nightly", "--tries", "1"]) == 1 and main([home, "report"]) == 0 and main([home, "optimize", "--zorder", "interval_start"]) == 0
    assert main([home, "counts"]) == 0 and "49" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main([home, "backfill", "--start", "yesterday"])


def test_events_are_lines_of_json():
    out = io.StringIO()
    observe.emit("j", "done", to=out, rows=3, at=datetime(2026, 7, 1, tzinfo=UTC), error=ValueError("x"))
    told = json.loads(out.getvalue())
    assert out.getvalue().count("\n") == 1 and told["job"] == "j" and told["rows"] == 3 and told["error"] == "x" and told["at"].startswith("2026-07-01") and told["level"] == "INFO"


def test_a_receiver_that_fails_does_not_break_the_alert(capsys):
    def broken(payload):
        raise OSError("down")

    assert observe.alert({"run_id": "r"}, broken)["run_id"] == "r" and "alert_not_delivered" in capsys.readouterr().err


def test_listener_tells_every_batch_once(spark, tmp_path):
    told = []
    listener = streams.ProgressListener(lambda name, fields: told.append((name, fields)))
    spark.streams.addListener(listener)
    try:
        log.produce(log.envelopes(spark.range(10).select(F.lit("k").alias("k"), F.lit("v").alias("v"), F.current_timestamp().alias("t"), "id"), "k", "v", "t", "id", "topic"), f"{tmp_path}/log")
        for _ in range(2):
            streams.bronze(log.stream(spark, f"{tmp_path}/log", files_per_trigger=1), Table(spark, f"{tmp_path}/t"), f"{tmp_path}/c", None).awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    batches = [f["batch_id"] for n, f in told if n == "bronze" and f.get("input_rows")]
    assert batches == sorted(set(batches)) and sum(f["input_rows"] for n, f in told if n == "bronze") == 10


def test_tail_skips_what_is_there(spark, tmp_path):
    rows = lambda *x: log.envelopes(spark.createDataFrame([("k", str(i), datetime(2026, 7, 1), i) for i in x], "k string, v string, t timestamp, i int"), "k", "v", "t", "i", "topic")
    path = f"{tmp_path}/log"
    log.produce(rows(1, 2), path)
    since = log.now(spark, path)
    log.produce(rows(3), path)
    table = Table(spark, f"{tmp_path}/t")
    streams.bronze(log.tail(spark, path, since), table, f"{tmp_path}/c", None).awaitTermination()
    assert [r["value"] for r in table.read().collect()] == ["3"]


def test_a_feed_that_is_away_and_comes_back(tmp_path):
    from tideline.sources.log import _ReplayReader

    feed, reader = tmp_path / "feed", None
    reader = _ReplayReader({"path": str(feed), "rowsperbatch": "2"})
    rows, at = reader.read(reader.initialOffset())
    assert list(rows) == [] and at == reader.initialOffset()  # not there yet
    feed.write_text('{"n":1}\n{"n":2}\n{"n":3}\n{"n"')
    rows, one = reader.read(at)
    assert [n for _, n in rows] == [0, 1]
    rows, two = reader.read(one)
    assert list(rows) == [('{"n":3}', 2)]  # the last line is not whole
    feed.write_text('{"n":1}\n{"n":2}\n{"n":3}\n{"n":4}\n')
    assert list(reader.read(two)[0]) == [('{"n":4}', 3)] and [n for _, n in reader.readBetweenOffsets(at, two)] == [0, 1, 2]
    assert Replay.name() == "replay"
