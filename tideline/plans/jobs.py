"""Batch jobs over tables: silver, gold, validation, backfill, the idempotency proof, and their command line."""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline import schemas, session
from tideline.functions import intervals
from tideline.functions import trades as T
from tideline.operators import medallion, observe, quality, reports
from tideline.operators.windows import candles
from tideline.store.table import Table

GRAIN = ("product_id", "interval_start")


@dataclass
class Lake:
    """Where each table is."""

    spark: SparkSession
    home: str

    def table(self, name: str, stats: Sequence[str] = ()) -> Table:
        return Table(self.spark, f"{self.home}/{name}", stats)

    @property
    def bronze(self) -> Table:
        return self.table("bronze/trades", ["ingest_timestamp"])

    @property
    def silver(self) -> Table:
        return self.table("silver/trades", ["product_id", "trade_id", "event_time"])

    @property
    def quarantine(self) -> Table:
        return self.table("silver/quarantine/parse", list(medallion.PLACE))

    def gold(self, interval: str = "1 minute") -> Table:
        """A table for each grain, so that grains never overwrite one another."""
        return self.table(f"gold/ohlc_{intervals.seconds(interval)}s", ["product_id", "interval_start"])

    @property
    def runs(self) -> Table:
        return self.table("gold/_observability/runs")

    @property
    def counts(self) -> Table:
        """Row counts of earlier runs, for drift."""
        return self.table("gold/_observability/counts")


def _first() -> list[Column]:
    return [F.asc_nulls_last("ingest_timestamp"), F.xxhash64("event_time", "sequence", "price", "size", "side", "maker_order_id", "taker_order_id")]


def silver_batch(lake: Lake, now: Column | None = None) -> dict:
    """Bronze to silver by upsert; what does not parse to quarantine, once each however often this runs."""
    parsed = medallion.parse(lake.bronze.read())
    done = lake.silver.merge(medallion.conform(parsed, now), medallion.KEY, _first())
    _quarantine(lake, medallion.quarantine(parsed, now))
    return done


def _quarantine(lake: Lake, rows: DataFrame) -> None:
    """A message is known by its place in the log, so equal messages are kept apart and the same one comes once."""
    if lake.quarantine.exists() or not rows.isEmpty():
        lake.quarantine.merge(rows, medallion.PLACE, [F.col("quarantined_at")])


def gold_batch(lake: Lake, interval: str = "1 minute", product: str | None = None, since_days: int | None = None, as_of: Column | None = None) -> dict:
    """Silver to candles by upsert; scoped to a product and to recent days if told."""
    rows = candles(medallion.scoped(lake.silver.read(), product, since_days, as_of), interval)
    return lake.gold(interval).merge(rows, GRAIN, partition_by=["date"])


def gold_job(lake: Lake, interval: str = "1 minute", product: str | None = None, since_days: int | None = None) -> DataFrame:
    """The whole gold job: candles by upsert, a run record, the checks of gold and what they tell, the count for the next
    run's drift check; returns the newest candles. gold_batch() is the part that only writes."""
    began = time.monotonic()
    observe.emit("gold", "started", interval=interval, product=product, since_days=since_days)
    gold_batch(lake, interval, product, since_days)
    gold = lake.gold(interval)
    rows, took = gold.detail().first()["row_count"], round(time.monotonic() - began, 2)
    observe.emit("gold", "candles_written", rows=rows, duration_seconds=took)
    observe.record_run(lake.runs, "gold", "gold", "candles_written", rows=rows, duration_seconds=took)
    name = f"gold/{intervals.seconds(interval)}s"
    prior = reports.scalar(reports.prior_row_count(lake.counts.read(schema=schemas.DQ_METRICS), name))
    for r in quality.collected(quality.check_gold(gold.read(), prior)):
        observe.emit("gold", "check", "INFO" if r.passed else "WARNING", check=r.name, passed=r.passed, detail=r.detail)
    observe.save_row_count(lake.counts, name, rows)
    return reports.recent_candles(gold.read())


def validate(lake: Lake, layer: str = "all", interval: str = "1 minute", as_of: Column | None = None, fresh_hours: int | None = quality.FRESH_HOURS) -> bool:
    """The checks of a layer, each from one scan; records a run for each layer. False if a check fails."""
    if layer not in ("all", "silver", "gold"):
        raise ValueError(f"no layer {layer!r}")
    ok = True
    for name in ("silver", "gold") if layer == "all" else (layer,):
        began = time.monotonic()
        runs = lake.runs.read(schema=schemas.RUNS)
        prior = reports.scalar(reports.prior_rows(runs, name))
        table = lake.silver if name == "silver" else lake.gold(interval)
        rows = table.read(schema=schemas.SILVER if name == "silver" else schemas.GOLD)
        results = quality.collected(quality.check_silver(rows, as_of, prior, fresh_hours) if name == "silver" else quality.check_gold(rows, prior))
        passed = sum(r.passed for r in results)
        for r in results:
            observe.emit("dq_validate", "check", check=r.name, passed=r.passed, detail=r.detail)
        drift = next(r for r in results if r.name == "row_count_drift")
        age = next((r.detail.partition("=")[2] for r in results if r.name == "freshness"), "none")
        observe.record_run(lake.runs, "dq_validate", name, "dq", rows=int(drift.detail.split()[0].partition("=")[2]), dq_passed=passed, dq_failed=len(results) - passed, duration_seconds=time.monotonic() - began, freshness_seconds=None if age == "none" else float(age))
        ok = ok and passed == len(results)
    return ok


def quarantine_violations(lake: Lake, interval: str = "1 minute") -> tuple[int, int]:
    """Copies rows that break the rules of silver and of gold; how many of each."""
    out = []
    for table, bad, reason, name in ((lake.silver, T.silver_violation(), medallion.SILVER_FAILURE, "silver/quarantine/dq"), (lake.gold(interval), T.gold_violation(), medallion.GOLD_FAILURE, "gold/quarantine/dq")):
        rows = medallion.flagged(table.read(), bad, reason)
        out.append(lake.table(name).append(rows)["rows"])
    return out[0], out[1]


def backfill(lake: Lake, start: datetime, end: datetime, interval: str = "1 minute", silver: bool = True, gold: bool = True) -> None:
    if silver:
        good, bad = medallion.backfill_trades(lake.bronze.read(), start, end)
        lake.silver.merge(good, medallion.KEY, _first())
        _quarantine(lake, bad)
    if gold:
        lake.gold(interval).merge(medallion.backfill_candles(lake.silver.read(), start, end, interval), GRAIN, partition_by=["date"])


@dataclass
class Step:
    """A named part of a workflow. A run that raises or returns False has failed."""

    name: str
    run: Callable[[], object]


def workflow(name: str, steps: Sequence[Step], retries: int, wait_seconds: float, run_id: str = "manual", to: Callable[[dict], None] | str | None = None) -> bool:
    """Runs steps in order; one that raises is tried again after a while, one that returns False is not. The first that
    fails for good raises an alert and stops the workflow."""
    for step in steps:
        for n in range(1, retries + 2):
            error: Exception | None = None
            try:
                if step.run() is not False:
                    break
                error = RuntimeError(f"{step.name} failed")
            except Exception as e:  # noqa: BLE001
                error = e
                if n <= retries:
                    observe.emit(name, "retry", "WARNING", step=step.name, attempt=n, error=e)
                    time.sleep(wait_seconds)
                    continue
            task = SimpleNamespace(task_id=step.name, try_number=n, max_tries=retries + 1, log_url=None)
            observe.alert({"dag": SimpleNamespace(dag_id=name), "task_instance": task, "run_id": run_id, "exception": error}, to)
            return False
    return True


def nightly(lake: Lake, interval: str = "1 minute", tries: int = 3, wait_seconds: float = 300, products: Sequence[str] = (), to: Callable[[dict], None] | str | None = None) -> bool:
    """Gold (a step a product, or one of all), then the checks of silver and of gold, each only if all before it passed."""
    steps = [Step(f"gold_{p or 'all'}", lambda p=p: gold_batch(lake, interval, p)) for p in products or (None,)]
    steps += [Step(f"dq_{layer}", lambda layer=layer: validate(lake, layer, interval)) for layer in ("silver", "gold")]
    return workflow("nightly", steps, tries - 1, wait_seconds, to=to)


def backfill_run(lake: Lake, start: str, end: str, interval: str = "1 minute", retries: int = 1, wait_seconds: float = 600, to: Callable[[dict], None] | str | None = None) -> bool:
    """A backfill of the days from start to before end (ISO dates, UTC) as a workflow: silver, then gold."""
    span = intervals.utc_bounds(intervals.parse_day(start), intervals.parse_day(end))
    steps = [Step("backfill_silver", lambda: backfill(lake, *span, interval, gold=False)), Step("backfill_gold", lambda: backfill(lake, *span, interval, silver=False))]
    return workflow("backfill", steps, retries, wait_seconds, f"{start}/{end}", to)


def layer_report(lake: Lake, interval: str = "1 minute") -> DataFrame:
    """Rows and distinct keys of each layer; nulls for a table that is not there or cannot be read."""
    keyed = {"silver": (lake.silver, medallion.KEY), "gold": (lake.gold(interval), GRAIN), "bronze": (lake.bronze, ()), "runs": (lake.runs, ())}
    rows = []
    for name, (table, key) in keyed.items():
        try:
            found = table.read().agg(F.count(F.lit(1)), F.count_distinct(*key) if key else F.lit(None).cast("bigint")).first()
            rows.append((name, *found))
        except Exception as e:  # noqa: BLE001
            observe.emit("layer_report", "unreadable", "WARNING", table=table.path, error=str(e).partition("\n")[0])
            rows.append((name, None, None))
    return lake.spark.createDataFrame(rows, "layer string, row_count bigint, distinct_keys bigint")


def layout_probe(table: Table, zorder: Sequence[str] = (), where: Column | None = None, target_bytes: int = 128 << 20) -> dict:
    """Optimizes a table between two timed counts of the rows a filter holds; the counts must agree."""
    where = reports.representative_filter(table.read().columns) if where is None else where

    def timed() -> dict:
        began = time.perf_counter()
        return {"rows": table.read().where(where).count(), "seconds": time.perf_counter() - began}

    before = timed()
    done = table.optimize(target_bytes, zorder)
    return {"before": before, "after": timed(), **done}


def prove_idempotent(table: Table, keys: Sequence[str]) -> bool:
    """Whether merging a table into itself twice leaves its rows as they were: all of them, not their number alone."""
    before = table.snapshot().version
    for _ in range(2):
        table.self_update(keys)
    a, b = table.read(before), table.read()
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


class GoldReader:
    """What a read service answers from; a table that isn't there yet is empty."""

    def __init__(self, lake: Lake, products: Sequence[str] = ("BTC-USD", "ETH-USD"), interval: str = "1 minute") -> None:
        self.lake, self._products, self.interval = lake, list(products), interval

    def products(self) -> list[str]:
        return list(self._products)

    def candles(self, product: str, start: datetime | None = None, end: datetime | None = None, limit: int = 200) -> DataFrame:
        start, end = (intervals.as_utc(x) if x else None for x in (start, end))
        return reports.api_candles(self.lake.gold(self.interval).read(schema=schemas.GOLD, product_id=(product, product)), product, start, end, limit)

    def realtime(self, product: str | None = None, limit: int = 100) -> DataFrame:
        return reports.api_realtime(self.lake.table("gold/realtime_metrics").read(schema=schemas.REALTIME), product, limit)

    def runs(self, limit: int = 50) -> DataFrame:
        return reports.api_runs(self.lake.runs.read(schema=schemas.RUNS), limit)

    def table_status(self) -> dict[str, bool]:
        tables = {"ohlc": self.lake.gold(self.interval), "realtime_metrics": self.lake.table("gold/realtime_metrics"), "observability_runs": self.lake.runs}
        return {name: t.readable() for name, t in tables.items()}


def main(args: Sequence[str] | None = None) -> int:
    """python -m tideline.plans.jobs LAKE {silver,gold,validate,backfill,report,counts,optimize,nightly} [options]"""
    p = argparse.ArgumentParser(prog="tideline")
    p.add_argument("lake")
    sub = p.add_subparsers(dest="job", required=True)
    jobs = {name: sub.add_parser(name) for name in ("silver", "gold", "validate", "nightly", "report", "counts", "optimize", "backfill")}
    for s in jobs.values():
        s.add_argument("--interval", default="1 minute")
    jobs["gold"].add_argument("--product")
    jobs["gold"].add_argument("--since-days", type=int)
    jobs["gold"].add_argument("--minimal", action="store_true")
    jobs["validate"].add_argument("--layer", default="all", choices=("all", "silver", "gold"))
    jobs["nightly"].add_argument("--products", nargs="*", default=[])
    jobs["nightly"].add_argument("--tries", type=int, default=3)
    jobs["optimize"].add_argument("--zorder", nargs="*", default=[])
    jobs["backfill"].add_argument("--start", type=intervals.parse_day)
    jobs["backfill"].add_argument("--end", type=intervals.parse_day)
    for flag in ("--skip-silver", "--skip-gold", "--show-range"):
        jobs["backfill"].add_argument(flag, action="store_true")
    a = p.parse_args(args)
    lake = Lake(session.build(f"tideline-{a.job}"), a.lake)
    if a.job == "backfill":
        return _backfill_command(lake, a)
    todo: dict[str, Callable[[], object]] = {
        "silver": lambda: silver_batch(lake),
        "gold": lambda: gold_batch(lake, a.interval, a.product, a.since_days) if a.minimal else gold_job(lake, a.interval, a.product, a.since_days).show(truncate=False),
        "validate": lambda: validate(lake, a.layer, a.interval),
        "nightly": lambda: nightly(lake, a.interval, a.tries, products=a.products),
        "report": lambda: reports.run_report(lake.runs.read(schema=schemas.RUNS)).show(1000, truncate=False),
        "counts": lambda: layer_report(lake, a.interval).show(truncate=False),
        "optimize": lambda: observe.emit("optimize", "done", **layout_probe(lake.gold(a.interval), a.zorder)),
    }
    return 1 if todo[a.job]() is False else 0


def _backfill_command(lake: Lake, a: argparse.Namespace) -> int:
    if a.show_range:
        medallion.event_time_range(lake.bronze.read()).show(truncate=False)
        return 0
    try:
        if not a.start or not a.end:
            raise ValueError("--start and --end are needed")
        start, end = intervals.utc_bounds(a.start, a.end)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    backfill(lake, start, end, a.interval, not a.skip_silver, not a.skip_gold)
    return 0


if __name__ == "__main__":
    sys.exit(main())
