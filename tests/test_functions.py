from datetime import UTC, date, datetime

import pytest

from tideline.functions import intervals, progress
from tideline.operators import observe


def test_offsets_total():
    assert progress.offsets_total({"t": {"0": 3, "1": "4"}, "u": {"0": 5}}) == 12
    assert progress.offsets_total('{"t": {"0": 3}}') == 3
    assert progress.offsets_total(None) is None and progress.offsets_total([1]) is None and progress.offsets_total("no json") is None
    assert progress.offsets_total({"t": {"0": "x", "1": 2}, "u": 9}) == 2


def test_lag():
    source = {"latestOffset": {"t": {"0": 10}}, "endOffset": {"t": {"0": 4}}}
    assert progress.lag({"sources": [{}, source]}) == 6
    assert progress.lag({"sources": [source | {"latestOffset": {"t": {"0": 1}}}]}) == 0
    assert progress.lag({"sources": []}) is None and progress.lag({}) is None


def test_progress_fields_keep_zero():
    out = progress.fields({"batchId": 0, "numInputRows": 0, "batchDuration": None})
    assert out == {"batch_id": 0, "input_rows": 0}


@pytest.mark.parametrize(("text", "width"), [("1 minute", 60), ("7 days", 604800), ("2 Hours", 7200), ("15 seconds", 15), ("1 week", 604800)])
def test_intervals(text, width):
    assert intervals.seconds(text) == width


@pytest.mark.parametrize("text", ["", "0 minutes", "1 month", "minute"])
def test_odd_intervals(text):
    with pytest.raises(ValueError):
        intervals.seconds(text)


def test_bounds():
    assert intervals.utc_bounds(date(2024, 1, 1), date(2024, 1, 2)) == (datetime(2024, 1, 1, tzinfo=UTC), datetime(2024, 1, 2, tzinfo=UTC))
    with pytest.raises(ValueError):
        intervals.utc_bounds(date(2024, 1, 2), date(2024, 1, 2))
    low, high = intervals.aligned(datetime(2024, 1, 1, 3, 30), datetime(2024, 1, 1, 4), "1 hour")
    assert (low.hour, high.hour) == (3, 4)


def test_alert_payload_of_a_sparse_context():
    assert observe.alert_payload({})["dag_id"] is None
    full = observe.alert_payload({"exception": ValueError("x"), "run_id": "r", "dag": type("D", (), {"dag_id": "d"})})
    assert (full["error"], full["run_id"], full["dag_id"], full["alert"]) == ("x", "r", "d", "task_failed")
    assert observe.alert({"exception": ValueError("x")}, "http://127.0.0.1:1/")["error"] == "x"
