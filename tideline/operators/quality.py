"""Data quality: each layer's checks in one pass, contract reports, drift, tallies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import trades as T

FRESH_HOURS, LEAST_RATIO = 168, 0.95


@dataclass(frozen=True)
class CheckResult:
    name: str
    passed: bool
    detail: str


def _any_null(*columns: str) -> Column:
    return F.exists(F.array(*(F.col(c).isNull() for c in columns)), lambda x: x)


def silver_counts(silver: DataFrame) -> DataFrame:
    """One row: rows, distinct keys (null keys count), newest event, and a count for each rule."""
    return silver.agg(
        F.count(F.lit(1)).alias("row_count"), F.count_distinct(F.struct("product_id", "trade_id")).alias("distinct_keys"),
        F.count_if(_any_null("product_id", "trade_id")).alias("null_keys"), F.count_if(_any_null("price", "size", "event_time")).alias("null_money_or_time"),
        F.count_if(F.col("price") <= 0).alias("bad_price"), F.count_if(F.col("size") <= 0).alias("bad_size"), F.count_if(~F.col("side").isin(*T.SIDES)).alias("bad_side"), F.max("event_time").alias("newest"),
    )


def gold_counts(gold: DataFrame) -> DataFrame:
    return gold.agg(
        F.count(F.lit(1)).alias("row_count"), F.count_distinct(F.struct("product_id", "interval_start")).alias("distinct_keys"),
        F.count_if(_any_null("product_id", "interval_start")).alias("null_grain"), F.count_if(_any_null("open", "high", "low", "close")).alias("null_ohlc"),
        F.count_if(F.col("volume") < 0).alias("negative_volume"), F.count_if(T.insane_candle()).alias("insane"),
    )


def drift_ratio(rows: Column, prior: int | None) -> Column:
    """rows over the prior count; 1 where there is none or it is zero."""
    return rows.cast("double") / prior if prior else F.lit(1.0)


def _results(counts: DataFrame, layer: str, checks: list[tuple[str, Column, Column]]) -> DataFrame:
    row = lambda name, passed, detail: F.struct(F.lit(layer).alias("layer"), F.lit(name).alias("name"), passed.alias("passed"), detail.cast("string").alias("detail"))
    return counts.select(F.inline(F.array(*(row(*c) for c in checks))))


def _none(column: str) -> tuple[Column, Column]:
    return F.col(column) == 0, F.concat(F.lit("violations="), F.col(column))


def _drift(prior: int | None) -> tuple[Column, Column]:
    ratio = drift_ratio(F.col("row_count"), prior)
    return ratio >= LEAST_RATIO, F.concat(F.lit("rows="), F.col("row_count"), F.lit(f" prior={'none' if prior is None else prior}"))


def check_silver(silver: DataFrame, as_of: Column | None = None, prior: int | None = None, fresh_hours: int | None = FRESH_HOURS) -> DataFrame:
    """(layer, name, passed, detail) of the eight silver checks, from one scan. An empty table passes the row checks and
    fails freshness; fresh_hours None reports the age and passes."""
    age = F.timestamp_diff("SECOND", F.col("newest"), as_of if as_of is not None else F.current_timestamp())
    fresh = F.lit(True) if fresh_hours is None else F.coalesce(age <= fresh_hours * 3600, F.lit(False))
    repeats = F.col("row_count") - F.col("distinct_keys")
    return _results(silver_counts(silver), "silver", [
        ("null_keys", *_none("null_keys")), ("null_money_or_time", *_none("null_money_or_time")), ("price_positive", *_none("bad_price")), ("size_positive", *_none("bad_size")), ("side_valid", *_none("bad_side")),
        ("unique_dedup_key", repeats == 0, F.concat(F.lit("duplicates="), repeats)), ("freshness", fresh, F.concat(F.lit("age_seconds="), F.coalesce(age.cast("string"), F.lit("none")))), ("row_count_drift", *_drift(prior)),
    ])


def check_gold(gold: DataFrame, prior: int | None = None) -> DataFrame:
    """The six gold checks, from one scan."""
    repeats = F.col("row_count") - F.col("distinct_keys")
    return _results(gold_counts(gold), "gold", [
        ("null_grain", *_none("null_grain")), ("grain_unique", repeats == 0, F.concat(F.lit("duplicates="), repeats)), ("null_ohlc", *_none("null_ohlc")),
        ("volume_non_negative", *_none("negative_volume")), ("ohlc_sane", *_none("insane")), ("row_count_drift", *_drift(prior)),
    ])


def tally(results: DataFrame) -> DataFrame:
    return results.groupBy("layer").agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.bool_and("passed").alias("ok"))


def collected(results: DataFrame) -> list[CheckResult]:
    """At most a row a check."""
    return [CheckResult(r["name"], r["passed"], r["detail"]) for r in results.collect()]


def contract_rows(log: DataFrame) -> DataFrame:
    """The log with the ``fields`` of each message and the ``violations`` of the contract; a message is parsed once."""
    return log.select("*", T.once(T.json_fields(), "fields")).withColumn("violations", T.contract_of(F.col("fields")))


def contract_report(log: DataFrame) -> DataFrame:
    """total, valid, invalid, duplicates among the valid, and the verdict, over all that the log holds."""
    ok = F.size("violations") == 0
    field = lambda n: F.when(ok, F.col("fields")[n])
    rows = contract_rows(log).select(ok.alias("ok"), F.when(ok, F.struct(field("product_id"), field("trade_id").cast("bigint"))).alias("key"))
    out = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("valid"), F.count_distinct("key").alias("keys"))
    invalid = F.col("total") - F.col("valid")
    return out.select("total", "valid", invalid.alias("invalid"), (F.col("valid") - F.col("keys")).alias("duplicates"), F.when((invalid == 0) & (F.col("total") > 0), "PASS").otherwise("CHECK").alias("verdict"))


def contract_per_product(log: DataFrame) -> DataFrame:
    return contract_rows(log).where("size(violations) = 0").groupBy(F.col("fields")["product_id"].alias("product_id")).agg(F.count(F.lit(1)).alias("messages"))


def contract_samples(log: DataFrame, n: int = 5) -> DataFrame:
    """The first broken messages of the log, for a report."""
    return contract_rows(log).where("size(violations) > 0").orderBy("partition", "offset").limit(n).select("partition", "offset", "violations")
