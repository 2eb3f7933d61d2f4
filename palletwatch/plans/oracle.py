"""DuckDB SQL for the registered queries, written from their definitions."""

from __future__ import annotations

LEADS = """
leads AS (
    SELECT l.*, o.o_orderpriority, o.o_orderdate,
           date_diff('day', o.o_orderdate::DATE, l.l_shipdate::DATE) AS lead
    FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
)"""

LIMITS = """
limits(priority, limit_days) AS (
    VALUES ('1-URGENT', 30), ('2-HIGH', 60), ('3-MEDIUM', 90), ('4-NOT SPECIFIED', 120), ('5-LOW', 120)
)"""

# Declared places: quantity 3, price 2, discount and tax 4.
NET = "l_extendedprice::DECIMAL(12,2) * (1 - l_discount::DECIMAL(6,4))"
GROSS = f"{NET} * (1 + l_tax::DECIMAL(6,4))"
QTY = "sum(l_quantity::DECIMAL(12,3))"


def _lead_spread(key: str) -> str:
    return f"""
WITH {LEADS}
SELECT {key}, count(*) AS lines, min(lead)::BIGINT AS min_lead, round(quantile_cont(lead, 0.5), 6) AS median_lead,
       round(quantile_cont(lead, 0.9), 6) AS p90_lead, max(lead)::BIGINT AS max_lead
FROM leads WHERE lead >= 0 GROUP BY {key}"""


# A stream has given out what its watermark has passed: the newest event less the delay.
WATERMARK = """
mark AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE AS reached FROM events)"""

HOURLY = """
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end,
       event_type, count(*) AS events
FROM events GROUP BY ALL"""

SLIDING = """
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, count(*) AS events
FROM (
    SELECT time_bucket(INTERVAL 15 MINUTE, ts) - step * INTERVAL 15 MINUTE AS window_start
    FROM events, range(4) steps(step)
)
GROUP BY window_start"""

SESSIONS = """
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS events
FROM (
    SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session
    FROM (
        SELECT user_id, ts, event_id,
               CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR
                    THEN 0 ELSE 1 END AS opens
        FROM events
    )
)
GROUP BY user_id, session"""


def _silence(end: str, until: str = "TRUE") -> str:
    return f"""
SELECT user_id, last_event, last_event + INTERVAL 24 HOUR AS alert_at
FROM (
    SELECT user_id, ts AS last_event,
           coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), {end}) AS next_event
    FROM events WHERE {until}
)
WHERE next_event > last_event + INTERVAL 24 HOUR"""


def _empty_days(members: str, key: str, seen: str) -> str:
    return f"""
WITH days AS (
    SELECT {key}, day::DATE AS day
    FROM {members}, (
        SELECT unnest(generate_series(min(l_shipdate)::DATE, max(l_shipdate)::DATE, INTERVAL 1 DAY)) AS day FROM lineitem
    )
    WHERE ({key}, day::DATE) NOT IN ({seen})
)
SELECT {key}, min(day) AS first_day, max(day) AS last_day, count(*) AS days
FROM (SELECT {key}, day, day - row_number() OVER (PARTITION BY {key} ORDER BY day)::INTEGER AS stretch FROM days)
GROUP BY {key}, stretch"""


BATCH = {
    "receipt_fact": f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate::DATE AS receipt_day, o_orderdate::DATE AS order_day,
       o_orderpriority, p_name, p_brand, s_name, n_name, r_name,
       l_quantity AS quantity, ({NET})::DOUBLE AS net_value
FROM lineitem, orders, part, supplier, nation, region
WHERE l_orderkey = o_orderkey AND l_partkey = p_partkey AND l_suppkey = s_suppkey
  AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey""",
    "daily_receipts": f"""
SELECT l_suppkey, l_shipdate::DATE AS receipt_day, count(*) AS lines, {QTY}::DOUBLE AS quantity,
       sum({NET})::DOUBLE AS net_value
FROM lineitem GROUP BY ALL""",
    "open_orders": """
SELECT o_orderkey, o_orderpriority, o_orderdate::DATE AS order_day,
       date_diff('day', o_orderdate::DATE, DATE '1997-06-30') AS days_open
FROM orders WHERE o_orderdate::DATE <= DATE '1997-06-30' AND NOT EXISTS (
    SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate::DATE <= DATE '1997-06-30'
)""",
    "order_progress": f"""
SELECT l_orderkey, count(*) AS lines, {QTY}::DOUBLE AS quantity,
       min(l_shipdate)::DATE AS first_receipt, max(l_shipdate)::DATE AS last_receipt
FROM lineitem GROUP BY l_orderkey""",
    "lead_time_stats": _lead_spread("l_suppkey"),
    "suggested_limits": _lead_spread("o_orderpriority"),
    "lead_time_quarantine": f"""
WITH {LEADS}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderdate::DATE AS order_day,
       l_shipdate::DATE AS receipt_day, lead
FROM leads WHERE l_shipdate < o_orderdate""",
    "late_receipts": f"""
WITH {LEADS}, {LIMITS}
SELECT o_orderpriority, count(*) AS lines, count(*) FILTER (lead > limit_days) AS late_lines,
       count(*) FILTER (lead > limit_days) / count(*)::DOUBLE AS late_share
FROM leads LEFT JOIN limits ON priority = o_orderpriority
WHERE lead >= 0 GROUP BY o_orderpriority""",
    "supplier_scorecard": f"""
WITH {LIMITS},
leads AS (
    SELECT l.*, o_orderpriority, date_diff('day', o_orderdate::DATE, l_shipdate::DATE) AS lead
    FROM lineitem l LEFT JOIN orders ON o_orderkey = l_orderkey
),
scores AS (
    SELECT l_suppkey, count(*) AS lines, count(*) FILTER (l_returnflag = 'R') AS returned_lines,
           count(*) FILTER (lead >= 0) AS eligible_lines,
           count(*) FILTER (lead >= 0 AND lead > limit_days) AS late_lines
    FROM leads LEFT JOIN limits ON priority = o_orderpriority GROUP BY l_suppkey
),
shares AS (
    SELECT *, returned_lines / lines::DOUBLE AS returned_share,
           late_lines / nullif(eligible_lines, 0)::DOUBLE AS late_share
    FROM scores
)
SELECT *, dense_rank() OVER (ORDER BY returned_share DESC) AS returned_rank,
       CASE WHEN late_share IS NOT NULL
            THEN dense_rank() OVER (ORDER BY late_share DESC NULLS LAST) END AS late_rank
FROM shares""",
    "repeated_keys": f"""
SELECT l_orderkey, l_linenumber, count(*) AS times, {QTY}::DOUBLE AS quantity
FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
    "latest_per_part": """
SELECT DISTINCT ON (l_partkey) l_partkey, l_shipdate::DATE AS receipt_day, l_orderkey, l_linenumber, l_suppkey,
       l_quantity AS quantity
FROM lineitem
ORDER BY l_partkey, l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_quantity DESC""",
    "rolling_quantity": f"""
SELECT l_suppkey, receipt_day, quantity::DOUBLE AS quantity,
       sum(quantity) OVER (PARTITION BY l_suppkey ORDER BY receipt_day
                           RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)::DOUBLE AS rolling_quantity
FROM (SELECT l_suppkey, l_shipdate::DATE AS receipt_day, {QTY} AS quantity FROM lineitem GROUP BY ALL)""",
    "value_classes": """
WITH parts AS (
    SELECT l_partkey, sum(l_extendedprice::DECIMAL(12,2))::DECIMAL(30,2) AS value FROM lineitem GROUP BY l_partkey
),
ranked AS (
    SELECT l_partkey, value, (SELECT sum(value) FROM parts)::DECIMAL(30,2) AS overall,
           (sum(value) OVER (ORDER BY value DESC, l_partkey) - value)::DECIMAL(30,2) AS value_before
    FROM parts
)
SELECT l_partkey, value::DOUBLE AS value, value_before::DOUBLE AS value_before,
       CASE WHEN value_before < overall * 0.80 THEN 'A'
            WHEN value_before < overall * 0.95 THEN 'B' ELSE 'C' END AS value_class
FROM ranked""",
    "receipt_gaps": """
SELECT l_suppkey, previous_day, receipt_day, date_diff('day', previous_day, receipt_day) AS gap_days
FROM (
    SELECT l_suppkey, l_shipdate::DATE AS receipt_day,
           lag(l_shipdate::DATE) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate) AS previous_day
    FROM lineitem
)
WHERE date_diff('day', previous_day, receipt_day) > 30""",
    "geography_totals": f"""
SELECT r_name, n_name, l_suppkey, count(*) AS lines, {QTY}::DOUBLE AS quantity,
       grouping(r_name) AS all_regions, grouping(n_name) AS all_nations, grouping(l_suppkey) AS all_suppliers
FROM lineitem, supplier, nation, region
WHERE l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey
GROUP BY ROLLUP (r_name, n_name, l_suppkey)""",
    "empty_days_by_region": _empty_days(
        "region", "r_name",
        "SELECT r_name, l_shipdate::DATE FROM lineitem, supplier, nation, region "
        "WHERE l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey",
    ),
    "empty_days_by_supplier": _empty_days(
        "(SELECT s_suppkey AS l_suppkey FROM supplier)", "l_suppkey",
        "SELECT l_suppkey, l_shipdate::DATE FROM lineitem",
    ),
    "volume_anomalies": f"""
SELECT receipt_day, quantity::DOUBLE AS quantity, round(mean, 6) AS mean, round(deviation, 6) AS deviation,
       round((quantity - mean) / deviation, 6) AS z
FROM (
    SELECT receipt_day, quantity, count(*) OVER before AS days, avg(quantity::DOUBLE) OVER before AS mean,
           stddev_samp(quantity::DOUBLE) OVER before AS deviation
    FROM (SELECT l_shipdate::DATE AS receipt_day, {QTY} AS quantity FROM lineitem GROUP BY ALL)
    WINDOW before AS (ORDER BY receipt_day ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING)
)
WHERE days = 28 AND deviation > 0 AND abs((quantity - mean) / deviation) > 3""",
    "value_reconciliation": f"""
SELECT o_orderkey, order_value::DOUBLE AS order_value, received_value::DOUBLE AS received_value,
       (order_value - received_value)::DOUBLE AS difference,
       CASE WHEN received_value IS NULL THEN 'no receipt'
            WHEN abs(order_value - received_value) <= 0.01 THEN 'matched' ELSE 'differs' END AS status
FROM (
    SELECT o_orderkey, any_value(o_totalprice)::DECIMAL(12,2) AS order_value, sum({GROSS}) AS received_value
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey
)""",
    "rule_violations": """
SELECT 'null l_orderkey' AS rule, count(*) AS violations FROM lineitem WHERE l_orderkey IS NULL
UNION ALL SELECT 'null l_partkey', count(*) FROM lineitem WHERE l_partkey IS NULL
UNION ALL SELECT 'null l_suppkey', count(*) FROM lineitem WHERE l_suppkey IS NULL
UNION ALL SELECT 'null l_linenumber', count(*) FROM lineitem WHERE l_linenumber IS NULL
UNION ALL SELECT 'quantity not positive', count(*) FROM lineitem WHERE l_quantity <= 0
UNION ALL SELECT 'discount outside 0 to 1', count(*) FROM lineitem WHERE l_discount < 0 OR l_discount > 1
UNION ALL SELECT 'l_quantity finer than 3 places', count(*) FROM lineitem WHERE l_quantity <> round(l_quantity, 3)
UNION ALL SELECT 'l_extendedprice finer than 2 places', count(*) FROM lineitem WHERE l_extendedprice <> round(l_extendedprice, 2)
UNION ALL SELECT 'l_discount finer than 4 places', count(*) FROM lineitem WHERE l_discount <> round(l_discount, 4)
UNION ALL SELECT 'l_tax finer than 4 places', count(*) FROM lineitem WHERE l_tax <> round(l_tax, 4)
UNION ALL SELECT 'o_totalprice finer than 2 places', count(*) FROM orders WHERE o_totalprice <> round(o_totalprice, 2)
UNION ALL SELECT 'orphan l_orderkey', count(*) FROM lineitem
    WHERE l_orderkey IS NOT NULL AND l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'orphan l_partkey', count(*) FROM lineitem
    WHERE l_partkey IS NOT NULL AND l_partkey NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'orphan l_suppkey', count(*) FROM lineitem
    WHERE l_suppkey IS NOT NULL AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier)""",
    "hourly_events": HOURLY,
    "sliding_events": SLIDING,
    "dock_sessions": SESSIONS,
    "unique_events": """
SELECT DISTINCT ON (event_id) * FROM events ORDER BY event_id, ts, user_id, event_type, value, props""",
    "silent_docks": _silence("TIMESTAMP '2024-01-20'", "ts <= TIMESTAMP '2024-01-20'"),
}

STREAM = {
    "hourly_events_stream": f"WITH {WATERMARK} SELECT * FROM ({HOURLY}) WHERE window_end <= (SELECT reached FROM mark)",
    "sliding_events_stream": f"WITH {WATERMARK} SELECT * FROM ({SLIDING}) WHERE window_end <= (SELECT reached FROM mark)",
    "dock_sessions_stream": f"WITH {WATERMARK} SELECT * FROM ({SESSIONS}) WHERE session_end <= (SELECT reached FROM mark)",
    "unique_events_stream": "SELECT DISTINCT event_id, ts, user_id, event_type, value, props FROM events",
    "silent_docks_stream": f"""
WITH {WATERMARK} SELECT * FROM ({_silence("TIMESTAMP 'infinity'")}) WHERE alert_at <= (SELECT reached FROM mark)""",
    "late_event_report": "SELECT count(*) AS events, 0::BIGINT AS late FROM events",
}
