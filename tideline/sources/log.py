"""The append-only log: producing keyed envelopes, reading it whole, as a stream from its start, or from its tail."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from datetime import datetime, timedelta
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from tideline import schemas
from tideline.operators.ordering import numbered
from tideline.sources.tables import log_partition
from tideline.store.files import Files

#: Microseconds.
HOUR = 3_600_000_000


def envelopes(messages: DataFrame, key: str, value: str, at: str, order: str, topic: str) -> DataFrame:
    """messages as the log holds them: a key goes to one partition, offsets count the rows of a partition. Offsets are
    given hour by hour, so the log's partitions don't bound the tasks."""
    rows = messages.select(log_partition(key).alias("partition"), F.col(key).cast("binary").alias("key"), F.col(value).cast("binary").alias("value"), F.col(at).alias("timestamp"), F.col(order).alias("order"))
    rows = numbered(rows, "partition", F.unix_micros("timestamp"), ["timestamp", "order"], HOUR, "offset")
    return rows.select("key", "value", F.lit(topic).alias("topic"), "partition", "offset", "timestamp", F.lit(0).alias("timestampType"))


def produce(messages: DataFrame, path: str) -> None:
    """Appends envelopes to a log of files, each a run of offsets."""
    messages.repartitionByRange("partition", "offset").sortWithinPartitions("partition", "offset").write.mode("append").parquet(path)


def read(spark: SparkSession, path: str, schema: str = schemas.ENVELOPE) -> DataFrame:
    """All that the log holds now; a batch read commits no offsets."""
    return spark.read.schema(schema).parquet(path)


def stream(spark: SparkSession, path: str, schema: str = schemas.ENVELOPE, files_per_trigger: int | None = None, kafka: dict[str, str] | None = None) -> DataFrame:
    """The log from its start (a restarted query goes on from its checkpoint). kafka: options of a broker, where its
    connector is on the class path."""
    if kafka:
        return spark.readStream.format("kafka").option("startingOffsets", "earliest").option("failOnDataLoss", "false").options(**kafka).load()
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def now(spark: SparkSession, path: str) -> str:
    """The start marker of a tail: when the newest file that is there was written; later files get a later time, to the
    whole second that some file systems keep."""
    newest = max((at for _, _, at in Files(spark, path).walk(path)), default=0)
    time.sleep(max(0.0, newest / 1000 + 1.1 - time.time()))
    return (datetime(1970, 1, 1) + timedelta(milliseconds=newest)).isoformat(timespec="milliseconds") + "Z"


def tail(spark: SparkSession, path: str, since: str, schema: str = schemas.ENVELOPE, kafka: dict[str, str] | None = None) -> DataFrame:
    """What comes after ``since`` (a UTC timestamp): files that were there before are skipped."""
    if kafka:
        return spark.readStream.format("kafka").option("startingOffsets", "latest").option("failOnDataLoss", "false").options(**kafka).load()
    rows = spark.readStream.schema(schema).parquet(path)
    return rows.where(F.col("_metadata.file_modification_time") > F.lit(since).cast("timestamp")).select(*rows.columns)


class Replay(DataSource):
    """``format("replay")``: the messages of a JSON-lines file, so many a batch, as a live feed would deliver them.

    The file may grow and may be away for a while, as a feed's connection may: what can't be read now is tried again at
    the next batch, from where the last one ended. Only whole lines are delivered; ``channel`` keeps some types."""

    @classmethod
    def name(cls) -> str:
        return "replay"

    def schema(self) -> str:
        return "value string, line bigint"

    def simpleStreamReader(self, schema: object) -> SimpleDataSourceStreamReader:
        return _ReplayReader(self.options)


class _ReplayReader(SimpleDataSourceStreamReader):
    """An offset is the number of lines delivered and the byte that the next one starts at, so no line is read twice but
    those of a batch that is run again."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.rows = options["path"], int(options.get("rowsperbatch", 100))
        self.channels = set(filter(None, options.get("channel", "").split(",")))

    def _wanted(self, line: bytes) -> bool:
        if not self.channels:
            return True
        try:
            return json.loads(line).get("type") in self.channels
        except (ValueError, AttributeError):
            return False

    def _lines(self, start: dict[str, int], most: int) -> tuple[list[tuple[str, int]], dict[str, int]]:
        out, line, byte = [], start["line"], start["byte"]
        try:
            with open(self.path, "rb") as feed:
                feed.seek(byte)
                for text in islice(feed, most):
                    if not text.endswith(b"\n"):
                        break  # its end is still to come
                    if self._wanted(text):
                        out.append((text[:-1].decode("utf-8", "replace"), line))
                    line, byte = line + 1, byte + len(text)
        except FileNotFoundError:
            pass
        return out, {"line": line, "byte": byte}

    def initialOffset(self) -> dict[str, int]:
        return {"line": 0, "byte": 0}

    def read(self, start: dict[str, int]) -> tuple[Iterator[tuple[str, int]], dict[str, int]]:
        out, end = self._lines(start, self.rows)
        return iter(out), end

    def readBetweenOffsets(self, start: dict[str, int], end: dict[str, int]) -> Iterator[tuple[str, int]]:
        return iter(self._lines(start, end["line"] - start["line"])[0])

    def commit(self, end: dict[str, int]) -> None:
        """Nothing to release."""
