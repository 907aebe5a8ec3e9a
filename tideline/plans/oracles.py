"""The same results in plain SQL, for another engine to run over the same tables.

Quotients get 1e-9 before they are rounded, as plain() does it: exact halves would else fall by the order of summation.
"""

from __future__ import annotations

_D = "DECIMAL(38,18)"
_AS_OF = "TIMESTAMP '2024-02-01 00:00:00'"
_START, _END = "TIMESTAMP '2024-01-10 00:00:00'", "TIMESTAMP '2024-01-12 00:00:00'"

_TRADES = f"""trades AS (
    SELECT event_type AS product_id, event_id AS trade_id, CASE WHEN user_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side,
        CAST(CAST(value AS VARCHAR) AS {_D}) AS price, CAST(CAST(json_extract(props, '$.k') AS INTEGER) AS {_D}) AS size, event_id AS sequence,
        'm' || CAST(user_id AS VARCHAR) AS maker_order_id, 't' || CAST(user_id % 7 AS VARCHAR) AS taker_order_id, CAST(ts AS TIMESTAMP) AS event_time
    FROM events)"""

#: Each message of the raw log as what became of it: parsed fields, null where the message lacks them.
_SENT = f"""{_TRADES}, sent AS (
    SELECT trade_id AS n, product_id AS key, CAST(('0x' || substr(md5(product_id), 1, 7)) AS BIGINT) % 6 AS part, trade_id * 2 + copy AS off,
        event_time + INTERVAL 1 SECOND AS kafka_timestamp, event_time + INTERVAL 2 SECOND AS ingest_timestamp, trade_id % 97 <> 0 AS json,
        product_id, trade_id, CASE WHEN trade_id % 71 = 0 THEN 'hold' ELSE side END AS side, CASE WHEN trade_id % 89 <> 0 THEN price END AS price, size, sequence,
        maker_order_id, taker_order_id, event_time, trade_id % 83 = 0 AS extra
    FROM trades, (SELECT unnest([0, 1]) AS copy) WHERE copy = 0 OR trade_id % 50 = 0),
good AS (SELECT * FROM sent WHERE json AND price IS NOT NULL)"""

_SILVER = f"{_TRADES}, silver AS (SELECT *, {_AS_OF} AS ingest_timestamp, {_AS_OF} AS silver_timestamp FROM trades)"

_MESSAGE = """'{"type":"match","trade_id":' || trade_id || ',"maker_order_id":"' || maker_order_id || '","taker_order_id":"' || taker_order_id || '","side":"' || side
    || '","size":"' || CAST(size AS VARCHAR) || '"' || CASE WHEN price IS NULL THEN '' ELSE ',"price":"' || CAST(price AS VARCHAR) || '"' END || ',"product_id":"' || product_id
    || '","sequence":' || sequence || ',"time":"' || strftime(event_time, '%Y-%m-%dT%H:%M:%S.%f') || 'Z"' || CASE WHEN extra THEN ',"extra":1' ELSE '' END || '}'"""
_VALUE = f"CASE WHEN json THEN {_MESSAGE} ELSE '{{not valid json' END"

_BAD_MESSAGE = f"""'trades.raw' AS topic, CAST(part AS INTEGER) AS partition, off AS "offset", {_VALUE} AS value, ingest_timestamp, 'parse_or_contract_failure' AS reason"""

_DIRTY = f"""{_TRADES}, dirty AS (
    SELECT CASE WHEN trade_id % 103 <> 0 THEN product_id END AS product_id, CASE WHEN trade_id % 109 = 0 THEN 0 ELSE trade_id END AS trade_id,
        CASE WHEN trade_id % 61 = 0 THEN 'long' WHEN trade_id % 67 <> 0 THEN side END AS side,
        CASE WHEN trade_id % 91 = 0 THEN CAST(0 AS {_D}) WHEN trade_id % 101 <> 0 THEN price END AS price, size, sequence,
        CASE WHEN trade_id % 107 <> 0 THEN event_time END AS event_time FROM trades)"""
_BAD_SILVER = "product_id IS NULL OR trade_id IS NULL OR price IS NULL OR size IS NULL OR event_time IS NULL OR price <= 0 OR size <= 0 OR side NOT IN ('buy', 'sell')"
_BAD_GOLD = "product_id IS NULL OR interval_start IS NULL OR open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume < 0 OR high < low OR open > high OR open < low OR close > high OR close < low"
_INSANE = "high < low OR open > high OR open < low OR close > high OR close < low"


def _floor(column: str, seconds: int) -> str:
    return f"make_timestamp((epoch_us({column}) // {seconds * 1000000}) * {seconds * 1000000})"


def _candles(rows: str, seconds: int) -> str:
    return f"""SELECT product_id, s AS interval_start, s + INTERVAL {seconds} SECOND AS interval_end, arg_min(price, {{'a': event_time, 'b': sequence}}) AS open, max(price) AS high, min(price) AS low,
        arg_max(price, {{'a': event_time, 'b': sequence}}) AS close, CAST(sum(size) AS {_D}) AS volume,
        round(sum(CAST(price AS DOUBLE) * CAST(size AS DOUBLE)) / nullif(sum(CAST(size AS DOUBLE)), 0) + 1e-9, 6) AS vwap, count(*) AS trade_count, CAST(CAST(s AS DATE) AS VARCHAR) AS date
    FROM (SELECT *, {_floor('event_time', seconds)} AS s FROM {rows}) GROUP BY product_id, s"""


def _sliding(rows: str) -> str:
    return f"""SELECT product_id, s AS window_start, s + INTERVAL 3600 SECOND AS window_end, count(*) AS trade_count, CAST(sum(size) AS {_D}) AS volume,
        round(sum(CAST(price AS DOUBLE) * CAST(size AS DOUBLE)) / nullif(sum(CAST(size AS DOUBLE)), 0) + 1e-9, 6) AS vwap, round(stddev_samp(CAST(price AS DOUBLE)) + 1e-9, 6) AS price_volatility
    FROM (SELECT *, {_floor('event_time', 900)} - i * INTERVAL 900 SECOND AS s FROM {rows}, (SELECT unnest(range(0, 4)) AS i)) GROUP BY product_id, s"""


_DIRTY_GOLD = f"""{_TRADES}, gold AS ({_candles('trades', 86400)}), dirty_gold AS (
    SELECT CASE WHEN day(interval_start) <> 9 THEN product_id END AS product_id, interval_start, interval_end, open, CASE WHEN day(interval_start) = 3 THEN CAST(low - 1 AS {_D}) ELSE high END AS high, low,
        CASE WHEN day(interval_start) <> 7 THEN close END AS close, CASE WHEN day(interval_start) = 5 THEN -volume ELSE volume END AS volume, vwap, trade_count, date FROM gold)"""

_RUNS = f"""{_TRADES}, runs AS (
    SELECT 'job' || (trade_id % 3) AS job, CASE WHEN trade_id % 20 = 0 THEN 'silver' ELSE 'gold' END AS layer, 'done' AS event, CASE WHEN trade_id % 70 <> 0 THEN trade_id END AS rows,
        CASE WHEN trade_id % 30 <> 0 THEN CAST(8 AS INTEGER) END AS dq_passed, CASE WHEN trade_id % 30 <> 0 THEN CAST((trade_id % 40) // 20 AS INTEGER) END AS dq_failed,
        CAST(trade_id % 50 AS DOUBLE) AS duration_seconds, CASE WHEN trade_id % 60 <> 0 THEN CAST(trade_id * 7 % 20000 AS DOUBLE) END AS freshness_seconds, event_time AS ts
    FROM trades)"""
_AGE = "CASE WHEN freshness_seconds IS NULL THEN '-' WHEN freshness_seconds >= 3600 THEN printf('%.1fh', freshness_seconds / 3600 + 1e-9) ELSE printf('%.1fm', freshness_seconds / 60 + 1e-9) END"
_LATEST = "SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY job, layer ORDER BY ts DESC, event DESC) = 1"

_BROKEN = """CASE WHEN NOT json THEN 'malformed' ELSE array_to_string(list_filter([CASE WHEN trade_id <= 0 THEN 'trade_id' END, CASE WHEN side NOT IN ('buy', 'sell') THEN 'side' END,
    CASE WHEN size <= 0 THEN 'size' END, CASE WHEN price IS NULL OR price <= 0 THEN 'price' END, CASE WHEN sequence <= 0 THEN 'sequence' END, CASE WHEN extra THEN 'unknown:extra' END], lambda x: x IS NOT NULL), ',') END"""
_CONTRACT = f"{_SENT}, judged AS (SELECT *, {_BROKEN} AS violations FROM sent)"

_SILVER_COUNTS = f"""SELECT count(*) AS row_count, count(DISTINCT struct_pack(a := product_id, b := trade_id)) AS distinct_keys, count(*) FILTER (product_id IS NULL OR trade_id IS NULL) AS null_keys,
    count(*) FILTER (price IS NULL OR size IS NULL OR event_time IS NULL) AS null_money_or_time, count(*) FILTER (price <= 0) AS bad_price, count(*) FILTER (size <= 0) AS bad_size,
    count(*) FILTER (side NOT IN ('buy', 'sell')) AS bad_side, max(event_time) AS newest FROM"""
_GOLD_COUNTS = f"""SELECT count(*) AS row_count, count(DISTINCT struct_pack(a := product_id, b := interval_start)) AS distinct_keys, count(*) FILTER (product_id IS NULL OR interval_start IS NULL) AS null_grain,
    count(*) FILTER (open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL) AS null_ohlc, count(*) FILTER (volume < 0) AS negative_volume, count(*) FILTER ({_INSANE}) AS insane FROM"""


def _check_silver(rows: str, prior: int | None) -> str:
    ratio = f"row_count / {prior}.0 >= 0.95" if prior else "true"
    line = lambda name, column: f"SELECT 'silver' AS layer, '{name}' AS name, {column} = 0 AS passed, 'violations=' || {column} AS detail FROM c"
    return f"""(WITH c AS ({_SILVER_COUNTS} {rows}) {line('null_keys', 'null_keys')} UNION ALL {line('null_money_or_time', 'null_money_or_time')} UNION ALL {line('price_positive', 'bad_price')}
        UNION ALL {line('size_positive', 'bad_size')} UNION ALL {line('side_valid', 'bad_side')}
        UNION ALL SELECT 'silver', 'unique_dedup_key', row_count = distinct_keys, 'duplicates=' || (row_count - distinct_keys) FROM c
        UNION ALL SELECT 'silver', 'freshness', (epoch_us({_AS_OF}) - epoch_us(newest)) // 1000000 <= 168 * 3600, 'age_seconds=' || ((epoch_us({_AS_OF}) - epoch_us(newest)) // 1000000) FROM c
        UNION ALL SELECT 'silver', 'row_count_drift', {ratio}, 'rows=' || row_count || ' prior={prior or 'none'}' FROM c)"""


def _check_gold(rows: str, prior: int | None) -> str:
    ratio = f"row_count / {prior}.0 >= 0.95" if prior else "true"
    line = lambda name, column: f"SELECT 'gold' AS layer, '{name}' AS name, {column} = 0 AS passed, 'violations=' || {column} AS detail FROM c"
    return f"""(WITH c AS ({_GOLD_COUNTS} {rows}) {line('null_grain', 'null_grain')} UNION ALL SELECT 'gold', 'grain_unique', row_count = distinct_keys, 'duplicates=' || (row_count - distinct_keys) FROM c
        UNION ALL {line('null_ohlc', 'null_ohlc')} UNION ALL {line('volume_non_negative', 'negative_volume')} UNION ALL {line('ohlc_sane', 'insane')}
        UNION ALL SELECT 'gold', 'row_count_drift', {ratio}, 'rows=' || row_count || ' prior={prior or 'none'}' FROM c)"""


_CANDLE = "product_id, interval_start, interval_end, open, high, low, close, volume, vwap, trade_count"
_SILVER_COLUMNS = "product_id, trade_id, side, price, size, sequence, maker_order_id, taker_order_id, event_time"
_BULK = f"""bulk AS (SELECT l_returnflag || l_linestatus AS product_id, l_orderkey * 10 + l_linenumber AS trade_id, CAST(CAST(l_extendedprice AS VARCHAR) AS {_D}) AS price,
    CAST(CAST(l_quantity AS VARCHAR) AS {_D}) AS size, (l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey AS sequence, CAST(l_shipdate AS TIMESTAMP) AS event_time FROM lineitem)"""
_VERSIONED = f"WITH {_TRADES} SELECT trade_id, product_id, price FROM trades"
_DOUBLED = "CASE WHEN trade_id % 2 = 0 OR trade_id % 5 = 0 THEN CAST(price * 2 AS DECIMAL(38,18)) ELSE price END"
_ONCE = f"SELECT DISTINCT {_SILVER_COLUMNS}, ingest_timestamp FROM good"
_SPEED = f"WITH {_SENT}, w AS ({_sliding('good')}) SELECT * FROM w"
_CLOSED = "window_end <= (SELECT max(event_time) - INTERVAL 1 MINUTE FROM good)"

ORACLES: dict[str, str] = {
    "scan_trades": f"WITH {_TRADES} SELECT * FROM trades",
    "scan_bulk_trades": f"WITH {_BULK} SELECT product_id, count(*) AS n, CAST(sum(size) AS {_D}) AS size, count(DISTINCT trade_id) AS ids FROM bulk GROUP BY product_id",
    "bronze_envelope": f"""WITH {_SENT} SELECT key, {_VALUE} AS value, 'trades.raw' AS topic, CAST(part AS INTEGER) AS partition, row_number() OVER (PARTITION BY part ORDER BY kafka_timestamp, off) - 1 AS "offset",
        kafka_timestamp, CAST(0 AS INTEGER) AS kafka_timestamp_type, {_AS_OF} AS ingest_timestamp FROM sent""",
    "log_envelope": f"""WITH {_TRADES}, p AS (SELECT *, CAST(('0x' || substr(md5(product_id), 1, 7)) AS BIGINT) % 6 AS part FROM trades) SELECT product_id AS key, CAST(trade_id AS VARCHAR) AS value, 'trades.raw' AS topic,
        CAST(part AS INTEGER) AS partition, row_number() OVER (PARTITION BY part ORDER BY event_time, trade_id) - 1 AS "offset", event_time AS timestamp FROM p""",
    "silver_parse": f"""WITH {_SENT} SELECT CAST(part AS INTEGER) AS partition, off AS "offset", CASE WHEN json THEN trade_id END AS trade_id, CASE WHEN json THEN product_id END AS product_id, CASE WHEN json THEN side END AS side,
        CASE WHEN json THEN price END AS price, CASE WHEN json THEN size END AS size, CASE WHEN json THEN event_time END AS time FROM sent""",
    "silver_conform": f"WITH {_SENT} SELECT {_SILVER_COLUMNS}, ingest_timestamp, {_AS_OF} AS silver_timestamp FROM good",
    "quarantine_parse": f"WITH {_SENT} SELECT {_BAD_MESSAGE}, {_AS_OF} AS quarantined_at FROM sent WHERE NOT json OR price IS NULL",
    "speed_trades": f"WITH {_SENT} SELECT product_id, price, size, event_time FROM good",
    "ingest_filter": f"WITH {_SENT} SELECT product_id AS product, count(*) AS n FROM sent WHERE json GROUP BY product_id",
    "gold_scoped": f"WITH {_TRADES}, s AS (SELECT * FROM trades WHERE product_id = 'click' AND CAST(event_time AS DATE) >= DATE '2024-01-22') {_candles('s', 3600)}",
    "backfill_range": f"WITH {_SENT} SELECT {_SILVER_COLUMNS}, ingest_timestamp, {_AS_OF} AS silver_timestamp FROM good WHERE event_time >= {_START} AND event_time < {_END}",
    "dq_silver_violations": f"WITH {_DIRTY} SELECT product_id, trade_id, side, price, sequence FROM dirty WHERE {_BAD_SILVER}",
    "dq_gold_violations": f"WITH {_DIRTY_GOLD} SELECT product_id, interval_start, high, close, volume FROM dirty_gold WHERE {_BAD_GOLD}",
    "fmt_age": f"WITH {_RUNS} SELECT job, layer, ts, {_AGE} AS age FROM runs",
    "fmt_trade": f"""WITH {_TRADES} SELECT trade_id, strftime(event_time, '%Y-%m-%dT%H:%M:%S.%g') || '  ' || rpad(product_id, CAST(greatest(8, length(product_id)) AS INTEGER), ' ') || '  ' || CASE WHEN side = 'buy' THEN '^' ELSE 'v' END || ' ' || rpad(side, 4, ' ')
        || '  price=' || lpad(CASE WHEN trade_id % 9 <> 0 THEN CAST(CAST(price AS DECIMAL(18,2)) AS VARCHAR) ELSE '?' END, 12, ' ') || '  size=' || lpad(CAST(CAST(size AS INTEGER) AS VARCHAR), 14, ' ') || '  id=' || trade_id AS line FROM trades""",
    "contract_violations": f"""WITH {_CONTRACT} SELECT CAST(part AS INTEGER) AS partition, off AS "offset", violations FROM judged WHERE violations <> ''""",
    "contract_unknown_fields": f"WITH {_SENT} SELECT 'unknown:extra' AS field, count(*) AS n FROM sent WHERE json AND extra HAVING count(*) > 0",
    "contract_report": f"""WITH {_CONTRACT} SELECT count(*) AS total, count(*) FILTER (violations = '') AS valid, count(*) FILTER (violations <> '') AS invalid,
        count(*) FILTER (violations = '') - count(DISTINCT CASE WHEN violations = '' THEN product_id || '/' || trade_id END) AS duplicates, CASE WHEN count(*) > 0 AND count(*) FILTER (violations <> '') = 0 THEN 'PASS' ELSE 'CHECK' END AS verdict FROM judged""",
    "contract_per_product": f"WITH {_CONTRACT} SELECT product_id, count(*) AS messages FROM judged WHERE violations = '' GROUP BY product_id",
    "contract_samples": f"""WITH {_CONTRACT} SELECT CAST(part AS INTEGER) AS partition, off AS "offset", violations FROM judged WHERE violations <> '' ORDER BY part, off LIMIT 5""",
    **{f"gold_ohlc_{k}": f"WITH {_TRADES} {_candles('trades', s)}" for k, s in {"1m": 60, "5m": 300, "1h": 3600, "1d": 86400}.items()},
    "gold_ohlc_bulk": f"WITH {_BULK}, c AS ({_candles('bulk', 86400)}) SELECT * FROM c",
    "speed_sliding": f"WITH {_TRADES} {_sliding('trades')}",
    "layer_counts": f"""WITH {_DIRTY}, {_DIRTY_GOLD.removeprefix(_TRADES + ', ')} SELECT 'silver' AS layer, count(*) AS row_count, count(DISTINCT CASE WHEN product_id IS NOT NULL AND trade_id IS NOT NULL THEN product_id || '/' || trade_id END) AS distinct_keys FROM dirty
        UNION ALL SELECT 'gold', count(*), count(DISTINCT CASE WHEN product_id IS NOT NULL THEN product_id || '/' || interval_start END) FROM dirty_gold""",
    "distinct_keys": f"WITH {_DIRTY} SELECT count(DISTINCT product_id || '/' || trade_id) AS n FROM dirty",
    "distinct_keys_struct": f"WITH {_DIRTY} SELECT count(DISTINCT struct_pack(a := product_id, b := trade_id)) AS n FROM dirty",
    "dq_silver_one_scan": f"WITH {_DIRTY} {_SILVER_COUNTS} dirty",
    "dq_gold_one_scan": f"WITH {_DIRTY_GOLD} {_GOLD_COUNTS} dirty_gold",
    "freshness": "SELECT CAST(max(ts) AS TIMESTAMP) AS newest FROM events",
    "event_time_range": f"WITH {_SENT} SELECT min(CASE WHEN json THEN event_time END) AS first_event, max(CASE WHEN json THEN event_time END) AS last_event, count(*) AS messages FROM sent",
    "feed_rates": f"""WITH {_TRADES}, g AS (SELECT product_id, {_floor('event_time', 5)} AS interval_start, count(*) AS messages FROM trades GROUP BY ALL) SELECT product_id, interval_start, messages, round(messages * 1e6 / 5000000 + 1e-9, 6) AS rate,
        CAST(sum(messages) OVER w AS BIGINT) AS total, round(sum(messages) OVER w * 1e6 / (epoch_us(interval_start) + 5000000 - epoch_us(min(interval_start) OVER (PARTITION BY product_id))) + 1e-9, 6) AS average_rate FROM g WINDOW w AS (PARTITION BY product_id ORDER BY interval_start)""",
    "feed_peak_1s": f"WITH {_TRADES}, n AS (SELECT count(*) OVER (ORDER BY epoch_us(event_time) RANGE BETWEEN 1000000 PRECEDING AND CURRENT ROW) AS n FROM trades) SELECT max(n) AS peak_1s FROM n",
    "producer_throughput": f"""WITH {_SENT}, p AS (SELECT part, kafka_timestamp AS t, (row_number() OVER (PARTITION BY part ORDER BY off) - 1) // 100 AS run FROM sent) SELECT CAST(part AS INTEGER) AS partition, run,
        round(100 * 1e6 / nullif(epoch_us(max(t)) - epoch_us(min(t)), 0) + 1e-9, 6) AS rate FROM p GROUP BY part, run HAVING count(*) = 100""",
    "order_flow": f"""WITH {_TRADES}, f AS (SELECT product_id, {_floor('event_time', 3600)} AS interval_start, coalesce(sum(CAST(size AS DOUBLE)) FILTER (side = 'sell'), 0) AS taker_bought, coalesce(sum(CAST(size AS DOUBLE)) FILTER (side = 'buy'), 0) AS taker_sold
        , sum(CAST(price AS DOUBLE) * CAST(size AS DOUBLE) * CASE WHEN side = 'sell' THEN 1 ELSE -1 END) AS signed FROM trades GROUP BY ALL) SELECT * EXCLUDE (signed), round(signed / nullif(taker_bought + taker_sold, 0) + 1e-9, 6) AS signed_vwap, round((taker_bought - taker_sold) / nullif(taker_bought + taker_sold, 0) + 1e-9, 6) AS imbalance, round(taker_bought / nullif(taker_bought + taker_sold, 0) + 1e-9, 6) AS buy_ratio FROM f""",
    "sequence_gaps": f"WITH {_TRADES}, g AS (SELECT product_id, lag(sequence) OVER (PARTITION BY product_id ORDER BY sequence) AS previous, sequence FROM trades) SELECT *, sequence - previous - 1 AS missing FROM g WHERE sequence - previous > 1",
    "sweeps": f"WITH {_TRADES} SELECT product_id, taker_order_id, count(*) AS fills, CAST(sum(size) AS {_D}) AS size, min(price) AS low, max(price) AS high, min(event_time) AS first_fill FROM trades GROUP BY ALL HAVING count(*) >= 2",
    "dq_silver": f"WITH {_DIRTY} SELECT * FROM {_check_silver('dirty', 12000)}",
    "dq_gold": f"WITH {_DIRTY_GOLD} SELECT * FROM {_check_gold('dirty_gold', 100)}",
    "dq_tally": f"""WITH {_DIRTY}, hourly AS ({_candles('trades', 3600)}), r AS (SELECT * FROM {_check_silver('dirty', None)} UNION ALL SELECT * FROM {_check_gold('hourly', None)})
        SELECT layer, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, bool_and(passed) AS ok FROM r GROUP BY layer""",
    "row_count_drift": f"WITH {_TRADES} SELECT * FROM {_check_silver('trades', 12000)} WHERE name = 'row_count_drift'",
    "quarantine_silver_dq": f"WITH {_DIRTY} SELECT product_id, trade_id, price, sequence, 'silver_dq_failure' AS reason, {_AS_OF} AS quarantined_at FROM dirty WHERE {_BAD_SILVER}",
    "quarantine_gold_dq": f"WITH {_DIRTY_GOLD} SELECT product_id, interval_start, high, 'gold_dq_failure' AS reason, {_AS_OF} AS quarantined_at FROM dirty_gold WHERE {_BAD_GOLD}",
    "recent_candles": f"WITH {_TRADES} {_candles('trades', 3600)} ORDER BY interval_start DESC, product_id LIMIT 10",
    "run_metrics_latest": f"WITH {_RUNS} {_LATEST}",
    "run_report": f"""WITH {_RUNS}, l AS ({_LATEST}) SELECT job, layer, coalesce(format('{{:,}}', rows), '-') AS rows, CASE WHEN dq_passed IS NULL AND dq_failed IS NULL THEN '-' ELSE coalesce(dq_passed, 0) || '/' || (coalesce(dq_passed, 0) + coalesce(dq_failed, 0)) END AS dq,
        {_AGE} AS age, strftime(ts, '%Y-%m-%d %H:%M') AS last_run, coalesce(dq_failed, 0) > 0 AS failing FROM l""",
    "run_metrics_append": f"""SELECT 'job' || i AS job, 'silver' AS layer, 'done' AS event, CAST(100 * i AS BIGINT) AS rows, CAST(8 AS INTEGER) AS dq_passed, CAST(i AS INTEGER) AS dq_failed, CAST(NULL AS DOUBLE) AS duration_seconds, CAST(NULL AS DOUBLE) AS freshness_seconds,
        {_AS_OF} AS ts FROM (SELECT unnest(range(0, 3)) AS i)""",
    "prior_row_count": f"WITH {_RUNS} SELECT rows AS row_count FROM runs WHERE layer = 'silver' AND rows IS NOT NULL ORDER BY ts DESC LIMIT 1",
    "prior_rows_layer": f"WITH {_RUNS} SELECT rows FROM runs WHERE layer = 'gold' AND rows IS NOT NULL ORDER BY ts DESC LIMIT 1",
    "api_candles": f"WITH {_TRADES}, c AS ({_candles('trades', 3600)}) SELECT {_CANDLE} FROM c WHERE product_id = 'click' ORDER BY interval_start DESC LIMIT 200",
    "api_candles_range": f"WITH {_TRADES}, c AS ({_candles('trades', 3600)}) SELECT {_CANDLE} FROM c WHERE product_id = 'click' AND interval_start BETWEEN {_START} AND {_END} ORDER BY interval_start DESC LIMIT 200",
    "api_candles_json": f"""WITH {_TRADES}, c AS ({_candles('trades', 3600)}) SELECT product_id, interval_start, '{{"product_id":"' || product_id || '","open":"' || open || '","high":"' || high || '","low":"' || low || '","close":"' || close || '","volume":"' || volume
        || '","trade_count":' || trade_count || '}}' AS body FROM c WHERE product_id = 'click' AND interval_start BETWEEN {_START} AND {_END}""",
    "api_realtime": f"WITH {_TRADES}, w AS ({_sliding('trades')}) SELECT * FROM w ORDER BY window_start DESC, product_id LIMIT 100",
    "api_runs": f"WITH {_RUNS} SELECT * FROM runs ORDER BY ts DESC, job, layer LIMIT 50",
    "api_health": "SELECT * FROM (VALUES ('ohlc', true), ('realtime_metrics', false), ('observability_runs', false)) t(table_name, reachable)",
    "time_travel_v0": f"{_VERSIONED} WHERE trade_id % 3 = 0",
    "table_latest": _VERSIONED,
    "table_history": "SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'overwrite'), (CAST(1 AS BIGINT), 'append')) t(version, operation)",
    "table_log": "SELECT CAST(0 AS BIGINT) AS version, 'overwrite' AS operation, count(*) AS row_count FROM events WHERE event_id % 3 = 0 UNION ALL SELECT 1, 'append', count(*) FROM events WHERE event_id % 3 <> 0",
    "table_detail": "SELECT count(*) AS row_count, CAST(1 AS BIGINT) AS version, '' AS partition_columns FROM events",
    "merge_upsert": f"WITH {_TRADES} SELECT * REPLACE ({_DOUBLED} AS price) FROM trades",
    "merge_self_update": f"WITH {_TRADES} SELECT product_id, trade_id, {_DOUBLED} AS price FROM trades",
    "merge_idempotent": "SELECT CAST(0 AS BIGINT) AS differences",
    "optimize_compaction": f"WITH {_TRADES} {_candles('trades', 3600)}",
    "optimize_zorder": _VERSIONED,
    "optimize_probe": f"WITH {_TRADES} SELECT count(*) AS rows_before, count(*) AS rows_after, true AS rewritten FROM trades WHERE product_id = 'click'",
    "clustered_append": f"WITH {_TRADES}, c AS ({_candles('trades', 3600)}) SELECT *, 'product_id,interval_start' AS clustering_columns FROM c",
    "snapshot_in_sql": f"WITH {_TRADES} SELECT product_id, count(*) AS n, sum(price) AS price FROM trades WHERE trade_id % 3 <> 0 GROUP BY product_id",
    "vacuum_dry_run": "SELECT CAST(0 AS BIGINT) AS within_retention, true AS beyond",
    "partition_values": "SELECT DISTINCT CAST(CAST(ts AS DATE) AS VARCHAR) AS date FROM events",
    "schema_evolution": f"WITH {_TRADES} SELECT trade_id, product_id, price, CASE WHEN trade_id % 3 = 2 THEN side END AS side FROM trades",
    "silver_batch_job": f"WITH {_SENT} {_ONCE}",
    "gold_batch_job": f"WITH {_TRADES} {_candles('trades', 3600)}",
    "gold_full_job": f"""WITH {_TRADES}, c AS ({_candles('trades', 3600)}), n AS (SELECT count(*) AS n, count(*) FILTER (product_id = 'click') AS k FROM c)
        SELECT product_id, interval_start, open, close, volume, CAST(2 AS BIGINT) AS runs, n AS candles, k || ',' || n AS counted FROM c, n ORDER BY interval_start DESC, product_id LIMIT 10""",
    "layer_report": f"""WITH {_TRADES}, c AS ({_candles('trades', 3600)}) SELECT 'silver' AS layer, count(*) AS row_count, count(*) AS distinct_keys FROM trades UNION ALL SELECT 'gold', count(*), count(*) FROM c
        UNION ALL SELECT 'bronze', NULL, NULL UNION ALL SELECT 'runs', NULL, NULL""",
    "backfill_silver": f"WITH {_SENT} {_ONCE} WHERE event_time >= {_START} AND event_time < {_END}",
    "backfill_gold": f"WITH {_TRADES}, c AS ({_candles('trades', 25200)}) SELECT * FROM c WHERE interval_start >= {_START} AND interval_start < {_END}",
    "bronze_stream_append": f"""WITH {_SENT} SELECT key, {_VALUE} AS value, 'trades.raw' AS topic, CAST(part AS INTEGER) AS partition, off AS "offset", kafka_timestamp FROM sent""",
    "silver_stream": f"WITH {_SENT} SELECT DISTINCT product_id, trade_id, price, size, event_time FROM good",
    "quarantine_stream": f"WITH {_SENT} SELECT {_BAD_MESSAGE} FROM sent WHERE NOT json OR price IS NULL",
    "log_tail": f"""WITH {_TRADES}, p AS (SELECT *, CAST(('0x' || substr(md5(product_id), 1, 7)) AS BIGINT) % 6 AS part FROM trades), l AS (SELECT product_id AS key, CAST(trade_id AS VARCHAR) AS value,
        CAST(part AS INTEGER) AS partition, row_number() OVER (PARTITION BY part ORDER BY event_time, trade_id) - 1 AS "offset", event_time AS kafka_timestamp FROM p) SELECT * FROM l WHERE day(kafka_timestamp) > 15""",
    "speed_stream_append": f"{_SPEED} WHERE {_CLOSED}",
    "speed_stream_upserts": _SPEED,
    "reconcile_speed_batch": f"WITH {_SENT}, w AS ({_sliding('good')}) SELECT product_id, window_start, trade_count AS batch_count, volume AS batch_volume, CAST(NULL AS BIGINT) AS speed_count, CAST(NULL AS {_D}) AS speed_volume FROM w WHERE NOT ({_CLOSED})",
}

#: Money leaves as its exact digits, as plain() has it.
_MONEY = {
    "price size": "scan_trades silver_parse silver_conform speed_trades backfill_range merge_upsert silver_batch_job backfill_silver silver_stream",
    "size": "scan_bulk_trades",
    "open high low close volume": "gold_scoped gold_ohlc_1m gold_ohlc_5m gold_ohlc_1h gold_ohlc_1d gold_ohlc_bulk clustered_append recent_candles api_candles api_candles_range optimize_compaction gold_batch_job backfill_gold",
    "price": "snapshot_in_sql dq_silver_violations quarantine_silver_dq time_travel_v0 table_latest merge_self_update optimize_zorder schema_evolution",
    "high close volume": "dq_gold_violations",
    "open close volume": "gold_full_job",
    "volume": "speed_sliding api_realtime speed_stream_append speed_stream_upserts",
    "size low high": "sweeps",
    "high": "quarantine_gold_dq",
    "batch_volume speed_volume": "reconcile_speed_batch",
}
for _columns, _names in _MONEY.items():
    for _name in _names.split():
        ORACLES[_name] = f"SELECT * REPLACE ({', '.join(f'CAST(CAST({c} AS DECIMAL(38,18)) AS VARCHAR) AS {c}' for c in _columns.split())}) FROM ({ORACLES[_name]})"
