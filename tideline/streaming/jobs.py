"""The streaming side: exactly-once landing, silver and quarantine, speed windows, progress records.

Every sink commits through the table's log with (application, batch), so a batch that is run again after a crash is
written once. available_now drains what is there and stops; else a query runs at its interval.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tideline.functions import progress
from tideline.operators import medallion
from tideline.operators.windows import sliding
from tideline.store.table import Table

#: Seconds between batches of the services.
BRONZE_EVERY, SILVER_EVERY, SPEED_EVERY = 10, 10, 15


def sink(rows: DataFrame, table: Table, checkpoint: str, app: str, every: int | None = None, keys: tuple[str, ...] = ()) -> StreamingQuery:
    """Appends each batch, or merges it by keys; every None drains and stops."""

    def write(batch: DataFrame, number: int) -> None:
        if keys:
            table.merge(batch, keys)
        else:
            table.append(batch, app=app, batch=number)

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update" if keys else "append").queryName(app)
    return (writer.trigger(processingTime=f"{every} seconds") if every else writer.trigger(availableNow=True)).start()


def bronze(log: DataFrame, table: Table, checkpoint: str, every: int | None = BRONZE_EVERY) -> StreamingQuery:
    return sink(medallion.land(log), table, checkpoint, "bronze", every)


def silver(bronze_stream: DataFrame, table: Table, quarantine: Table, checkpoint: str, every: int | None = SILVER_EVERY, delay: str = "1 hour") -> list[StreamingQuery]:
    """Two queries with checkpoints of their own: the stateful one must not hold up the other."""
    parsed = medallion.parse(bronze_stream)
    good = medallion.dedup_stream(medallion.conform(parsed), delay)
    return [sink(good, table, f"{checkpoint}/silver", "silver", every), sink(medallion.quarantine(parsed), quarantine, f"{checkpoint}/quarantine", "quarantine", every)]


def speed(log: DataFrame, table: Table, checkpoint: str, every: int | None = SPEED_EVERY, size: str = "1 minute", slide: str = "15 seconds", delay: str = "1 minute") -> StreamingQuery:
    """Finished windows only, each once."""
    return sink(sliding(medallion.speed_trades(log), size, slide, delay), table, checkpoint, "speed", every)


def speed_upserts(log: DataFrame, table: Table, checkpoint: str, every: int | None = SPEED_EVERY, size: str = "1 minute", slide: str = "15 seconds", delay: str = "1 minute") -> StreamingQuery:
    """Windows in progress too: each batch replaces those it changed."""
    return sink(sliding(medallion.speed_trades(log), size, slide, delay), table, checkpoint, "speed-upserts", every, ("product_id", "window_start"))


class ProgressListener(StreamingQueryListener):
    """Hands the fields of every batch that was run to ``report``: none is missed, none told twice."""

    def __init__(self, report: Callable[[str, dict[str, Any]], None]) -> None:
        self.report = report

    def onQueryStarted(self, event: Any) -> None:
        pass

    def onQueryProgress(self, event: Any) -> None:
        import json

        p = json.loads(event.progress.json)
        self.report(p.get("name") or p["id"], progress.fields(p))

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        pass


def stop_all(spark: SparkSession) -> None:
    for query in spark.streams.active:
        query.stop()
