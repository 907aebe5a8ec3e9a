"""Lag and throughput of a stream, from Spark's progress records."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

#: Fixed names: a progress record's, and those that dashboards read.
RENAMED = {"batchId": "batch_id", "numInputRows": "input_rows", "inputRowsPerSecond": "input_rows_per_sec", "processedRowsPerSecond": "processed_rows_per_sec", "batchDuration": "batch_duration_ms"}


class Offsets(dict[tuple[str, str], int]):
    """Where a reader stands in each partition of each topic."""

    @classmethod
    def told(cls, text: Any) -> Offsets | None:
        """From JSON text or what it stands for, {topic: {partition: offset}}; what isn't a number is left out, and
        without such an object at all there are no offsets."""
        try:
            tree = json.loads(text) if isinstance(text, str) else text
        except ValueError:
            return None
        if not isinstance(tree, Mapping):
            return None
        flat = ((topic, part, str(n)) for topic, parts in tree.items() if isinstance(parts, Mapping) for part, n in parts.items())
        return cls({(topic, part): int(n) for topic, part, n in flat if n.lstrip("-").isdigit()})

    def behind(self, log: Offsets) -> int:
        """How many messages of the log are still to be read; a reader ahead of what the log last told is not behind."""
        return max(0, log.total - self.total)

    @property
    def total(self) -> int:
        return sum(self.values())


def offsets_total(offsets: Any) -> int | None:
    found = Offsets.told(offsets)
    return None if found is None else found.total


def lag(progress: Mapping[str, Any]) -> int | None:
    """Of the first source that tells where it and its log stand; None if no source does."""
    told = ((Offsets.told(s.get("endOffset")), Offsets.told(s.get("latestOffset"))) for s in progress.get("sources") or [])
    return next((own.behind(log) for own, log in told if own is not None and log is not None), None)


def fields(progress: Mapping[str, Any]) -> dict[str, Any]:
    """What is reported of a batch; absent values are left out, zeros stay."""
    record = {**progress, "kafka_lag": lag(progress)}
    return {RENAMED.get(k, k): v for k, v in record.items() if v is not None and (k in RENAMED or k == "kafka_lag")}
