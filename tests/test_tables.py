import os
import threading
import time
from datetime import UTC, date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tideline import schemas
from tideline.operators import medallion, observe, reports
from tideline.plans.jobs import GoldReader, Lake, backfill, gold_batch, layer_report, layout_probe, nightly, prove_idempotent, quarantine_violations, silver_batch, validate
from tideline.sources.log import Replay
from tideline.store.files import AlreadyThere
from tideline.store.table import ConcurrentCommit, Table
from tideline.streaming import jobs


@pytest.fixture
def table(spark, tmp_path):
    return Table(spark, str(tmp_path / "t"), ["id"])


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_versions(spark, table):
    assert not table.exists()
    assert table.read(schema="id int").isEmpty()
    with pytest.raises(ValueError):
        table.read()
    table.overwrite(spark.createDataFrame([(1, "a"), (2, "b")], "id int, p string"))
    table.append(spark.createDataFrame([(3, "c")], "id int, p string"))
    assert ids(table.read()) == [1, 2, 3] and ids(table.read(0)) == [1, 2]
    table.overwrite(spark.createDataFrame([(9, "z")], "id int, p string"))
    assert ids(table.read()) == [9] and ids(table.read(1)) == [1, 2, 3]
    with pytest.raises(ValueError):
        table.read(7)
    with pytest.raises(ValueError):
        table.append(spark.createDataFrame([(3, "c", 1)], "id int, p string, more int"))
    assert [r["operation"] for r in table.history().orderBy("version").collect()] == ["overwrite", "append", "overwrite"]
    assert table.detail().first()["row_count"] == 1


def test_replayed_batch_is_written_once(spark, table):
    df = spark.createDataFrame([(1,)], "id int")
    table.append(df, app="q", batch=0)
    table.append(df, app="q", batch=0)
    table.append(df, app="q", batch=1)
    assert ids(table.read()) == [1, 1]


def test_a_version_has_one_owner(spark, table):
    table.append(spark.createDataFrame([(1,)], "id int"))
    with pytest.raises(AlreadyThere):
        table.files.create(f"{table.path}/_log/{0:020d}.json", "{}")
    base = table.snapshot()
    table.append(spark.createDataFrame([(2,)], "id int"))
    with pytest.raises(ConcurrentCommit):
        table._commit(base, "merge", base.schema, [], [])
    assert ids(table.read()) == [1, 2]


def test_appends_at_once_all_land(spark, table):
    table.append(spark.createDataFrame([(0,)], "id int"))
    threads = [threading.Thread(target=Table(spark, table.path).append, args=(spark.createDataFrame([(i,)], "id int"),)) for i in range(1, 4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert ids(table.read()) == [0, 1, 2, 3]


def test_merge(spark, table):
    schema = "id int, v string, at int"
    table.merge(spark.createDataFrame([(1, "a", 0), (2, "b", 0), (None, "n", 0)], schema), ["id"])
    done = table.merge(spark.createDataFrame([(2, "late", 2), (2, "early", 1), (3, "c", 0), (None, "m", 0)], schema), ["id"], [F.col("at")])
    assert {(r["id"], r["v"]) for r in table.read().collect()} == {(1, "a"), (2, "early"), (3, "c"), (None, "n"), (None, "m")}
    assert (done["rows_updated"], done["rows_inserted"]) == (1, 2)
    table.merge(spark.createDataFrame([(3, "x", 0), (8, "y", 0)], schema), ["id"], insert=False)
    assert {(r["id"], r["v"]) for r in table.read().where("id > 2").collect()} == {(3, "x")}
    table.merge(spark.createDataFrame([], schema), ["id"])
    assert table.read().count() == 5
    assert prove_idempotent(table, ["id"])


def test_merge_rewrites_only_files_in_range(spark, table):
    for low in (0, 100):
        table.append(spark.range(low, low + 10).select(F.col("id").cast("int")).coalesce(1))
    assert table.merge(spark.createDataFrame([(105,)], "id int"), ["id"])["files_rewritten"] == 1
    assert ids(table.read()) == [*range(10), *range(100, 110)]


def test_partitions_optimize_vacuum(spark, table):
    for i in range(3):
        table.append(spark.createDataFrame([(i, date(2026, 7, 1)), (i + 10, date(2026, 7, 2))], "id int, d date"), ["d"])
    assert [r["d"].day for r in table.partitions().collect()] == [1, 2]
    before = ids(table.read())
    assert table.optimize()["files_removed"] == 6
    assert ids(table.read()) == before and table.detail().first()["num_files"] == 2
    table.optimize(zorder=["id", "d"])
    assert ids(table.read()) == before
    assert table.vacuum() == [] and len(table.vacuum(0)) == 8
    table.vacuum(0, dry_run=False)
    assert ids(table.read()) == before and table.vacuum(0) == []
    assert ids(table.read(id=(11, 12)).where("id BETWEEN 11 AND 12")) == [11, 12]


@pytest.fixture
def zone(spark):
    """Sets the time zone of driver and session, and puts both back."""
    before = os.environ.get("TZ"), spark.conf.get("spark.sql.session.timeZone")

    def put(name):
        os.environ["TZ"] = name
        time.tzset()
        spark.conf.set("spark.sql.session.timeZone", name)

    yield put
    put(before[1])
    os.environ.pop("TZ") if before[0] is None else os.environ.update(TZ=before[0])
    time.tzset()


def at(*micros):
    return [f"timestamp_micros({m})" for m in micros]


def test_merge_across_time_zones(spark, tmp_path, zone):
    """Rows written under one zone are found under another, and in the hour that a daylight-saving night repeats."""
    hour, night = 3_600_000_000, 1_762_063_200_000_000  # 2025-11-02 06:00 UTC: 02:00 in New York comes back to 01:00
    for first, then, instants in (("UTC", "America/New_York", (0, 5 * hour)), ("America/New_York", "America/New_York", (night - hour // 2, night + hour // 2))):
        table = Table(spark, str(tmp_path / f"{first}{instants[0]}".replace("/", "_")), ["t"])
        rows = lambda n: spark.sql(" UNION ALL ".join(f"SELECT {x} AS t, {n} AS n" for x in at(*instants)))  # noqa: B023, E731
        zone(first)
        table.merge(rows(1), ["t"])
        zone(then)
        assert table.merge(rows(2), ["t"])["rows_updated"] == 2
        assert [(r["n"], r["k"]) for r in table.read().groupBy("n").agg(F.count("*").alias("k")).collect()] == [(2, 2)]
        ends = [datetime.fromtimestamp(m / 1e6, UTC) for m in instants]
        assert table.read(t=(ends[0], ends[1])).count() == 2 and table.read(t=(ends[1] + timedelta(days=1), None)).isEmpty()
    with pytest.raises(ValueError):
        table.read(t=(datetime(2025, 1, 1), None))


def test_merge_evaluates_its_source_once(spark, table):
    table.append(spark.range(10).select(F.col("id").cast("int")))
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    source = spark.range(5, 12).select(F.col("id").cast("int")).mapInArrow(count, "id int")
    assert table.merge(source, ["id"])["rows_updated"] == 5 and seen.value == 7 and ids(table.read()) == list(range(12))


def drained(spark, table, home, rows):
    q = jobs.sink(table.stream(), Table(spark, f"{home}/out"), f"{home}/checkpoint", "copy")
    q.awaitTermination()
    assert ids(Table(spark, f"{home}/out").read()) == rows


def test_streams_read_committed_appends_only(spark, table, tmp_path):
    add = lambda *x: table.append(spark.createDataFrame([(i,) for i in x], "id int").coalesce(1))
    add(1, 2)
    spark.createDataFrame([(99,)], "id int").write.parquet(f"{table.path}/data/orphan")  # its writer died before the commit
    table._write(spark.createDataFrame([(98,)], "id int"), [], [])
    drained(spark, table, tmp_path, [1, 2])
    table.merge(spark.createDataFrame([(2,), (3,)], "id int"), ["id"])
    table.optimize()
    for i in range(4, 30):  # over several compact batches
        add(i)
    drained(spark, table, tmp_path, [1, 2, *range(4, 30)])
    assert ids(table.read()) == list(range(1, 30))
    assert {n for n in table.files.names(f"{table.path}/data/_spark_metadata") if n.endswith(".compact")} == {"9.compact", "19.compact"}
    table.files.delete(f"{table.path}/data/_spark_metadata/26")  # as if its writer had died before it told
    add(30)
    drained(spark, table, tmp_path, [1, 2, *range(4, 31)])


def test_snapshots_start_from_checkpoints(spark, table, monkeypatch):
    for i in range(45):
        table._commit(table.snapshot(), "append", spark.range(0).schema, [{"path": f"f{i}", "bytes": 1, "rows": 1, "ranges": {}}], [f"f{i - 3}"] if i > 2 else [], app="q", batch=i)
    whole = [table.snapshot(v) for v in (19, 20, 21, 44)]
    assert table.files.names(f"{table.path}/_checkpoints") == [f"{v:020d}.json" for v in (20, 40)]
    read, seen = table._commit_of, []
    monkeypatch.setattr(table, "_commit_of", lambda v: seen.append(v) or read(v))
    assert table.snapshot() == whole[-1] and seen == [41, 42, 43, 44] and list(table.snapshot().files) == ["f42", "f43", "f44"]
    for n in table.files.names(f"{table.path}/_checkpoints"):
        table.files.delete(f"{table.path}/_checkpoints/{n}")
    assert [table.snapshot(v) for v in (19, 20, 21, 44)] == whole


def test_a_snapshot_has_a_name_in_sql(spark, table):
    table.append(spark.createDataFrame([(1,)], "id int"))
    table.append(spark.createDataFrame([(2,)], "id int"))
    table.view("now")
    table.view("before", 0)
    assert ids(spark.sql("SELECT * FROM now WHERE id NOT IN (SELECT id FROM before)")) == [2]


def test_unreadable_tables_are_told_apart(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    lake.gold().append(silver_rows(spark, 1).select(F.lit("A").alias("product_id")))
    lake.runs.append(observe.run_row(spark, "j", "silver", "done"))
    for f in lake.gold().snapshot().files:
        lake.gold().files.delete(f)
    assert GoldReader(lake).table_status() == {"ohlc": False, "realtime_metrics": False, "observability_runs": True}
    counts = {r["layer"]: r["row_count"] for r in layer_report(lake).collect()}
    assert counts == {"bronze": None, "silver": None, "gold": None, "runs": 1}


def test_clustered_tables_skip_files(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"))
    for day in (1, 2):
        table.append(spark.range(day * 100, day * 100 + 20).select("id", F.lit(date(2026, 7, day)).alias("d")), ["d"], ["id"])
    assert table.detail().first()["clustering_columns"] == ["id"]
    assert len(table.read(id=(105, 110)).inputFiles()) == 1 and table.read(d=(date(2026, 7, 2), None)).count() == 20


def test_zorder_lets_scans_skip(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"), ["a", "b"])
    table.append(spark.range(20_000).select((F.col("id") % 101).alias("a"), (F.col("id") * 7 % 103).alias("b")).repartition(16))
    probe = lambda: len(table.read(a=(10, 12), b=(50, 52)).inputFiles())
    before = probe()
    out = layout_probe(table, ["a", "b"], F.col("a").between(10, 12) & F.col("b").between(50, 52), target_bytes=8 << 10)
    assert out["before"]["rows"] == out["after"]["rows"] > 0 and out["after"]["seconds"] > 0 and out["files_added"] >= 8
    assert before == 16 and probe() < out["files_added"] / 2


def silver_rows(spark, n=50):
    t = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 7)
    return spark.range(n).select(
        F.lit("A").alias("product_id"), F.col("id").alias("trade_id"), F.lit("buy").alias("side"), (F.col("id") + 1).cast("decimal(38,18)").alias("price"), F.lit(1).cast("decimal(38,18)").alias("size"), F.col("id").alias("sequence"),
        F.lit("m").alias("maker_order_id"), F.lit("t").alias("taker_order_id"), t.alias("event_time"), t.alias("ingest_timestamp"), t.alias("silver_timestamp"),
    )


def bronze_rows(spark):
    s = silver_rows(spark)
    value = F.to_json(F.struct(F.lit("match").alias("type"), "trade_id", "maker_order_id", "taker_order_id", "side", F.col("size").cast("string").alias("size"), F.col("price").cast("string").alias("price"), "product_id", "sequence", F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time")))
    rows = s.select("product_id", F.when(F.col("trade_id") == 3, "{").otherwise(value).alias("value"), "event_time", "trade_id")
    return rows.union(rows.where("trade_id < 5")).select(F.col("product_id").alias("key"), "value", F.lit("t").alias("topic"), F.lit(0).alias("partition"), F.col("trade_id").alias("offset"), F.col("event_time").alias("kafka_timestamp"), F.lit(0).alias("kafka_timestamp_type"), F.col("event_time").alias("ingest_timestamp"))


def test_jobs(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    assert GoldReader(lake).table_status() == {"ohlc": False, "realtime_metrics": False, "observability_runs": False}
    assert GoldReader(lake).candles("A").isEmpty() and GoldReader(lake).runs().isEmpty() and GoldReader(lake).realtime().isEmpty()
    lake.bronze.append(bronze_rows(spark))
    for _ in range(2):
        silver_batch(lake)
    assert lake.silver.read().count() == 49 and lake.quarantine.read().count() == 1
    gold_batch(lake)
    one = lake.gold().read()
    backfill(lake, datetime(2023, 11, 14, tzinfo=UTC), datetime(2023, 11, 16, tzinfo=UTC))
    two = lake.gold().read()
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty() and two.agg(F.sum("trade_count")).first()[0] == 49
    assert validate(lake, fresh_hours=None) and not validate(lake, "silver")
    assert reports.scalar(reports.prior_rows(lake.runs.read(), "silver")) == 49
    assert quarantine_violations(lake) == (0, 0)
    assert nightly(lake, tries=1) is False  # the trades are old
    with pytest.raises(ValueError):
        validate(lake, "bronze")
    with pytest.raises(ValueError):
        GoldReader(lake).runs(0)
    assert GoldReader(lake).candles("A", datetime(2023, 11, 14, 22, 14), datetime(2023, 11, 14, 22, 15)).count() == 2


def test_record_run_never_raises(spark, tmp_path):
    table = Table(spark, str(tmp_path / "runs"))
    assert observe.record_run(table, "j", "silver", "done", rows=1)
    assert not observe.record_run(table, "j", "silver", "done", rows="many")
    assert table.read().count() == 1


def test_streams(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    lake.bronze.append(bronze_rows(spark).coalesce(1))
    for _ in range(2):
        for q in jobs.silver(lake.bronze.stream(), lake.silver, lake.quarantine, f"{tmp_path}/checkpoint", None):
            q.awaitTermination()
    assert lake.silver.read().count() == 49 and lake.quarantine.read().count() == 2
    speed = lake.table("gold/realtime_metrics")
    jobs.speed(lake.bronze.stream(), speed, f"{tmp_path}/speed", None).awaitTermination()
    from tideline.operators.windows import sliding

    batch = sliding(medallion.speed_trades(lake.bronze.read()))
    edge = lake.bronze.read().agg(F.max("kafka_timestamp") - F.expr("INTERVAL 1 MINUTE")).first()[0]
    closed = batch.where(F.col("window_end") <= F.lit(edge)).select("product_id", "window_start", "trade_count")
    streamed = speed.read(schema=schemas.REALTIME).select("product_id", "window_start", "trade_count")
    assert closed.exceptAll(streamed).isEmpty() and streamed.exceptAll(closed).isEmpty() and not streamed.isEmpty()
    jobs.stop_all(spark)


def test_replay_source(spark, tmp_path):
    (tmp_path / "feed.jsonl").write_text('{"type":"match","n":1}\n{"type":"heartbeat"}\n[]\n{"type":"match","n":2}\n')
    spark.dataSource.register(Replay)
    feed = spark.readStream.format("replay").option("path", str(tmp_path / "feed.jsonl")).option("channel", "match,last_match").load()
    table = Table(spark, str(tmp_path / "out"))
    q = jobs.sink(feed, table, str(tmp_path / "cp"), "feed", every=1)
    q.processAllAvailable()
    q.stop()
    assert sorted(r["line"] for r in table.read().collect()) == [0, 3]
