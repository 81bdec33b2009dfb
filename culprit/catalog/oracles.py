"""The same questions in plain SQL, to check the queries against another engine."""

from __future__ import annotations

from culprit.catalog.fixtures import (
    EVENTS_OBSERVED_AT,
    LINE_TEST,
    OBSERVED_AT,
)

ORACLES: dict[str, str] = {}


def with_ctes(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + select.strip()


# --- the line fleet -----------------------------------------------------------------------

FEED = f"""
feed_lines AS (
  SELECT l_suppkey AS feed_id, l_orderkey * 10 + l_linenumber AS line_key,
         CASE WHEN NOT (l_discount = 0 AND l_tax = 0) THEN l_orderkey END AS order_ref,
         l_shipdate AS ship_ts
  FROM lineitem),
settled AS (
  SELECT CASE WHEN substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 2) = '00' THEN -o_orderkey
              ELSE o_orderkey END AS o_orderkey, o_orderdate FROM orders)
"""
FEED_EVIDENCE = (
    FEED
    + f""",
per_feed AS (
  SELECT feed_id, count(*) AS n, count(order_ref) AS filled, count(DISTINCT order_ref) AS refs,
         count(DISTINCT line_key) AS keys, max(ship_ts) AS latest,
         coalesce(skewness(CAST(order_ref AS DOUBLE)), 0.0) AS skew
  FROM feed_lines GROUP BY feed_id),
parent AS (
  SELECT count(*) AS n, count(*) - count(DISTINCT o_orderkey) AS extra, max(o_orderdate) AS latest
  FROM settled),
orphans AS (
  SELECT feed_id, count(*) AS c FROM feed_lines
  WHERE order_ref IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM settled WHERE o_orderkey = order_ref)
  GROUP BY feed_id),
lags AS (
  SELECT feed_id,
         date_diff('microsecond', latest, TIMESTAMP '{OBSERVED_AT}') / 1e6 / 60 AS lag_min,
         (SELECT date_diff('microsecond', latest, TIMESTAMP '{OBSERVED_AT}') / 1e6 / 60
          FROM parent) AS parent_lag_min
  FROM per_feed),
line_evidence AS (
  SELECT f.feed_id, 'relationships' AS failing_test_kind, 'stg_lines' AS failing_model,
         'order_ref' AS failing_column, 'feed_lines' AS blame_model, 'order_ref' AS blame_column,
         'line_key' AS blame_pk_column, 'settled_orders' AS parent_table,
         'o_orderkey' AS parent_pk_column,
         n AS blame_row_count, (n - filled) / n AS blame_null_rate,
         refs / filled AS blame_cardinality_ratio, n - keys AS blame_pk_dupe_count,
         lag_min / 1440 AS blame_lag_ratio, CAST(0 AS DOUBLE) AS blame_integer_compatible_ratio,
         CAST(0 AS DOUBLE) AS blame_float_compatible_ratio, FALSE AS blame_dtype_mismatch,
         n - keys > 0 OR (SELECT extra FROM parent) > 0 AS blame_join_fanout_risk,
         CAST(0 AS DOUBLE) AS blame_value_drift_z,
         parent_lag_min > 1440 AND lag_min < 120 AS blame_stale_dimension,
         abs(skew) AS blame_anomaly_score, coalesce(c, 0) AS orphan_fk_count,
         (SELECT n FROM parent) AS parent_row_count
  FROM per_feed f JOIN lags USING (feed_id) LEFT JOIN orphans USING (feed_id))
"""
)
EVENT_EVIDENCE = f"""
feed_events AS (
  SELECT user_id, event_id, ts, value,
         CASE WHEN event_type = 'error' AND value < 10 THEN 'error'
              ELSE json_extract_string(props, '$.k') END AS code
  FROM events),
baseline AS (SELECT avg(value) AS mean, stddev_samp(value) / 20 AS tolerance FROM feed_events),
per_user AS (
  SELECT user_id, count(*) AS n, count(DISTINCT event_id) AS keys,
         count(code) AS codes, count(DISTINCT code) AS distinct_codes,
         count(*) FILTER (regexp_matches(code, '^[+-]?[0-9]+$')) AS ints,
         count(*) FILTER (regexp_matches(code, '^[+-]?[0-9]*\\.?[0-9]+([eE][+-]?[0-9]+)?$'))
           AS floats,
         count(value) AS values_n, count(DISTINCT value) AS distinct_values,
         coalesce(avg(value), 0.0) AS mean, coalesce(skewness(value), 0.0) AS skew,
         date_diff('microsecond', max(ts), TIMESTAMP '{EVENTS_OBSERVED_AT}') / 1e6 / 60 / 1440
           AS lag_ratio
  FROM feed_events GROUP BY user_id),
event_evidence AS (
  SELECT user_id, 'code' AS target, n AS blame_row_count, (n - codes) / n AS blame_null_rate,
         CASE WHEN codes > 0 THEN distinct_codes / codes ELSE 0.0 END AS blame_cardinality_ratio,
         n - keys AS blame_pk_dupe_count, lag_ratio AS blame_lag_ratio,
         CASE WHEN codes > 0 THEN ints / codes ELSE 0.0 END AS blame_integer_compatible_ratio,
         CASE WHEN codes > 0 THEN floats / codes ELSE 0.0 END AS blame_float_compatible_ratio,
         TRUE AS blame_dtype_mismatch, n - keys > 0 AS blame_join_fanout_risk,
         CAST(0 AS DOUBLE) AS blame_value_drift_z, FALSE AS blame_stale_dimension,
         CAST(0 AS DOUBLE) AS blame_anomaly_score, 0 AS orphan_fk_count
  FROM per_user
  UNION ALL
  SELECT user_id, 'value', n, (n - values_n) / n,
         CASE WHEN values_n > 0 THEN distinct_values / values_n ELSE 0.0 END, n - keys, lag_ratio,
         CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), FALSE, n - keys > 0,
         abs(mean - (SELECT mean FROM baseline)) / (SELECT tolerance FROM baseline), FALSE,
         abs(skew), 0
  FROM per_user)
"""
EVIDENCE_COLUMNS = (
    "blame_row_count", "blame_null_rate", "blame_cardinality_ratio", "blame_pk_dupe_count",
    "blame_lag_ratio", "blame_integer_compatible_ratio", "blame_float_compatible_ratio",
    "blame_dtype_mismatch", "blame_join_fanout_risk", "blame_value_drift_z",
    "blame_stale_dimension", "blame_anomaly_score", "orphan_fk_count",
)
_DOUBLES = {
    "blame_null_rate", "blame_cardinality_ratio", "blame_lag_ratio",
    "blame_integer_compatible_ratio", "blame_float_compatible_ratio", "blame_value_drift_z",
    "blame_anomaly_score",
}


def rounded_columns(names: tuple[str, ...] = EVIDENCE_COLUMNS) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" if n in _DOUBLES else n for n in names)


BOTH = (
    FEED_EVIDENCE
    + ","
    + EVENT_EVIDENCE
    + f""",
evidence AS (
  SELECT 'feed/' || feed_id AS incident, {', '.join(EVIDENCE_COLUMNS)} FROM line_evidence
  UNION ALL
  SELECT 'user/' || user_id || '/' || target, {', '.join(EVIDENCE_COLUMNS)} FROM event_evidence)
"""
)
LINES_ONLY = (
    FEED_EVIDENCE
    + """,
evidence AS (SELECT *, CAST(feed_id AS VARCHAR) AS incident FROM line_evidence)
"""
)

# slot, cause, condition, score, evidence keys
DETECTORS = {
    "detect_null_spike": (
        "upstream_null_spike", "blame_null_rate > 0.001e0",
        "least(1e0, blame_null_rate * 10e0) * CASE WHEN orphan_fk_count > 0 AND "
        "blame_null_rate < 0.05e0 THEN 0.5e0 ELSE 1e0 END", "blame_null_rate"),
    "detect_duplicate": (
        "duplicate_ingestion", "blame_pk_dupe_count > 0",
        "least(1e0, 0.7e0 + blame_pk_dupe_count / greatest(blame_row_count, 1) * 30e0)",
        "blame_pk_dupe_count"),
    "detect_dropout": (
        "broken_join_dropout", "orphan_fk_count > 0",
        "CASE WHEN blame_null_rate >= 0.05e0 THEN 0.3e0 ELSE "
        "least(1e0, 0.6e0 + orphan_fk_count / greatest(blame_row_count, 1) * 20e0) END",
        "orphan_fk_count"),
    "detect_late": (
        "late_arriving", "blame_lag_ratio > 1",
        "least(1e0, 0.7e0 + (blame_lag_ratio - 1e0) * 0.2e0)", "blame_lag_ratio"),
    "detect_type_coercion": (
        "type_coercion",
        "blame_integer_compatible_ratio >= 0.95e0 OR blame_float_compatible_ratio >= 0.95e0",
        "greatest(blame_integer_compatible_ratio, blame_float_compatible_ratio)",
        "blame_integer_compatible_ratio,blame_float_compatible_ratio"),
    "detect_schema_change": (
        "source_schema_change", "blame_dtype_mismatch", "1e0", "blame_dtype_mismatch"),
    "detect_fanout": (
        "broken_join_fanout", "blame_join_fanout_risk", "0.9e0", "blame_join_fanout_risk"),
    "detect_unit_drift": (
        "unit_encoding_drift", "blame_value_drift_z > 3",
        "least(1e0, 0.7e0 + (blame_value_drift_z - 3e0) * 0.05e0)", "blame_value_drift_z"),
    "detect_stale_dim": (
        "stale_dimension", "blame_stale_dimension", "0.9e0", "blame_stale_dimension"),
    "detect_skew": (
        "unknown", "blame_anomaly_score > 2",
        "least(1e0, 0.5e0 + (blame_anomaly_score - 2e0) * 0.1e0)", "blame_anomaly_score"),
}
SCORED = (
    "fired AS (\n"
    + "\nUNION ALL\n".join(
        f"SELECT incident, {i} AS slot, '{cause}' AS cause_class, {score} AS score "
        f"FROM evidence WHERE {when}"
        for i, (cause, when, score, _) in enumerate(DETECTORS.values())
    )
    + """),
scores AS (
  SELECT * FROM fired
  UNION ALL
  SELECT incident, 99, 'unknown', 0.5e0 FROM evidence
  WHERE incident NOT IN (SELECT incident FROM fired)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY incident ORDER BY score DESC, slot) AS rank
  FROM scores),
top AS (
  SELECT incident, max(score) FILTER (rank = 1) AS top, max(score) FILTER (rank = 2) AS second,
         max(cause_class) FILTER (rank = 1) AS cause,
         string_agg(cause_class, '>' ORDER BY rank) AS causes
  FROM ranked GROUP BY incident),
verdicts AS (
  SELECT *, CASE WHEN top >= 0.85e0 AND top - coalesce(second, 0e0) >= 0.15e0 THEN 'auto'
                 WHEN top >= 0.6e0 THEN 'two_candidate' ELSE 'triage_only' END AS verdict_type
  FROM top)
"""
)
INCIDENTS = (
    LINES_ONLY
    + ","
    + SCORED
    + f""",
summed AS (
  SELECT 'inc_' || substr(md5(feed_id || '|{LINE_TEST}'), 1, 12) AS incident_id,
         (SELECT max(ship_ts) FROM feed_lines l WHERE l.feed_id = e.feed_id) AS created_at,
         '{LINE_TEST}' AS failing_test_name, failing_model, failing_column,
         orphan_fk_count AS failing_row_count, blame_model, blame_column,
         CAST(1 AS DOUBLE) AS blame_certainty, 1 AS hops, causes, cause AS top_class,
         top AS confidence, verdict_type,
         CASE WHEN verdict_type = 'triage_only' THEN NULL ELSE cause END AS final_cause,
         CASE cause
           WHEN 'upstream_null_spike' THEN 'Blame column shows '
             || printf('%.1f', blame_null_rate * 100e0) || '% null rate over '
             || blame_row_count || ' rows.'
           WHEN 'duplicate_ingestion' THEN 'Blame PK has ' || blame_pk_dupe_count
             || ' duplicate occurrence(s) in ' || blame_row_count || ' rows.'
           WHEN 'broken_join_dropout' THEN orphan_fk_count
             || ' orphan FK value(s) in blame column have no matching parent row.'
           ELSE 'No deterministic detector fired (score ' || printf('%.2f', top) || ').'
         END AS evidence_summary,
         CASE cause
           WHEN 'upstream_null_spike' THEN
             'Backfill or filter NULLs in feed_lines.order_ref; check upstream extract.'
           WHEN 'duplicate_ingestion' THEN
             'De-duplicate feed_lines.order_ref before downstream models consume it.'
           WHEN 'broken_join_dropout' THEN 'Restore deleted parent rows referenced by '
             || 'feed_lines.order_ref, or soft-delete instead.'
           ELSE 'Inspect feed_lines.order_ref manually — no rule fired.' END AS suggested_fix
  FROM evidence e JOIN verdicts USING (incident))
"""
)
INCIDENT_SELECT = """
SELECT incident_id, created_at, failing_test_name, failing_model, failing_column,
       failing_row_count, blame_model, blame_column, blame_certainty, hops, causes, top_class,
       round(confidence, 6) AS confidence, evidence_summary, suggested_fix, verdict_type,
       coalesce(final_cause, 'none') AS final_class
FROM summed
"""
STORED = (
    INCIDENTS
    + """,
stored AS (
  SELECT incident_id, created_at, failing_test_name, failing_model, failing_column,
         failing_row_count, blame_model, blame_column, blame_certainty,
         FALSE AS blame_hit_agg_boundary, verdict_type, final_cause AS final_cause_class,
         CASE WHEN verdict_type = 'triage_only' THEN CAST(-1 AS DOUBLE)
              ELSE round(confidence, 6) END AS confidence,
         CAST(0 AS DOUBLE) AS time_to_verdict_s, CAST(0 AS DOUBLE) AS token_cost_usd,
         'none' AS human_label
  FROM summed)
"""
)

# --- artifacts ----------------------------------------------------------------------------

FAILED = (
    FEED_EVIDENCE
    + f""",
failing AS (
  SELECT 'run_' || feed_id AS run_id, 'not_null_stg_lines_order_ref' AS test_name,
         'not_null' AS kind, 'stg_lines' AS model, 'order_ref' AS column_name,
         NULL AS parent_model, NULL AS parent_column, 'wh.failures.nulls_' || feed_id
         AS failures_table
  FROM line_evidence WHERE blame_null_rate > 0
  UNION ALL
  SELECT 'run_' || feed_id, 'unique_stg_lines_line_key', 'unique', 'stg_lines', 'line_key', NULL,
         NULL, 'wh.failures.unique_stg_lines_line_key'
  FROM line_evidence WHERE blame_pk_dupe_count > 0
  UNION ALL
  SELECT 'run_' || feed_id, '{LINE_TEST}', 'relationships', 'stg_lines', 'order_ref',
         'settled_orders', 'o_orderkey', ''
  FROM line_evidence WHERE orphan_fk_count > 0
  UNION ALL
  SELECT 'run_' || feed_id, 'd4', 'unknown', '?', NULL, NULL, NULL, ''
  FROM line_evidence WHERE blame_row_count % 2 = 1)
"""
)
ORACLES["failing_tests"] = with_ctes(FAILED, select="SELECT * FROM failing")
ORACLES["run_totals"] = with_ctes(
    FEED_EVIDENCE,
    select="""
SELECT 'run_' || feed_id AS run_id,
       CAST(blame_null_rate > 0 AS BIGINT) + CAST(blame_pk_dupe_count > 0 AS BIGINT)
         + CAST(orphan_fk_count > 0 AS BIGINT) + CAST(blame_row_count % 2 = 1 AS BIGINT) AS failed,
       4 - failed AS passed
FROM line_evidence""",
)
ORACLES["test_name_parse"] = """
SELECT CASE l_returnflag WHEN 'A' THEN 'not_null_stg_' || l_suppkey || '_order_ref'
            WHEN 'N' THEN 'relationships_stg_' || l_suppkey || '_order_ref__key__ref_orders_'
            ELSE 'custom_stg_' || l_suppkey || '_order_ref' END AS test_name,
       CASE l_returnflag WHEN 'A' THEN 'not_null' WHEN 'N' THEN 'relationships'
            ELSE 'unknown' END AS kind,
       CASE WHEN l_returnflag IN ('A', 'N') THEN 'stg_' || l_suppkey ELSE 'stg' END AS model,
       CASE WHEN l_returnflag IN ('A', 'N') THEN 'order_ref' END AS column_name,
       count(*) AS n_lines
FROM lineitem GROUP BY l_suppkey, l_returnflag
"""
ORACLES["test_kind"] = """
SELECT CASE event_type WHEN 'click' THEN 'not_null' WHEN 'view' THEN 'unique'
            WHEN 'purchase' THEN 'accepted_values' WHEN 'signup' THEN 'relationships'
            ELSE 'unknown' END AS kind, count(*) AS n_tests
FROM events GROUP BY 1
"""
ORACLES["manifest_nodes"] = """
SELECT 'run_' || l_suppkey AS run_id, v.* FROM (SELECT DISTINCT l_suppkey FROM lineitem),
 (VALUES ('model.retail.stg_lines', 'stg_lines', 'Main_Staging', 'stg_lines', '', 'model'),
         ('model.retail.settled_orders', 'settled_orders', 'main_marts', 'orders_settled', '',
          'model'),
         ('seed.retail.raw_lines', 'raw_lines', 'main', 'raw_lines', '', 'seed'),
         ('source.retail.feed_lines', 'feed_lines', 'main', 'lines', '', 'source')
 ) v(unique_id, name, schema_name, alias, database, kind)
"""
ORACLES["resolve_relation"] = """
SELECT 'run_' || l_suppkey AS run_id, v.* FROM (SELECT DISTINCT l_suppkey FROM lineitem),
 (VALUES ('MAIN_staging', 'STG_lines', 'stg_lines'),
         ('main_marts', 'orders_settled', 'settled_orders'),
         (NULL, 'feed_lines', 'feed_lines'), ('main', 'absent', NULL)
 ) v(ref_schema, ref_table, node_name)
"""
_CHOOSE = """
SELECT run_id, test_name, model FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY {first}
    CASE WHEN starts_with(model, 'stg_') THEN 0 ELSE 1 END, model, test_name) AS rn FROM failing)
WHERE rn = 1
"""
ORACLES["choose_exact_test"] = with_ctes(
    FAILED,
    select="""
SELECT 'exact' AS asked, run_id, test_name, model FROM failing
WHERE test_name = 'unique_stg_lines_line_key'""",
)
ORACLES["choose_test"] = with_ctes(FAILED, select=_CHOOSE.format(first=""))
ORACLES["choose_named_test"] = with_ctes(
    FAILED,
    select=_CHOOSE.format(
        first="CASE WHEN starts_with(test_name, 'unique_stg') THEN 0 ELSE 1 END,"
    ),
)

# --- faults -------------------------------------------------------------------------------

TRIALS = """
patterns(family, pattern_id, fraction, tail, conditional, cause_class) AS (VALUES
  ('null_spike', 'null_spike.flat_5pct', 0.05e0, FALSE, FALSE, 'upstream_null_spike'),
  ('null_spike', 'null_spike.heavy_30pct', 0.30e0, FALSE, FALSE, 'upstream_null_spike'),
  ('null_spike', 'null_spike.conditional_status_returned', 0.50e0, FALSE, TRUE,
   'upstream_null_spike'),
  ('duplicate_ingestion', 'duplicate_ingestion.flat_1pct', 0.01e0, FALSE, FALSE,
   'duplicate_ingestion'),
  ('duplicate_ingestion', 'duplicate_ingestion.heavy_5pct', 0.05e0, FALSE, FALSE,
   'duplicate_ingestion'),
  ('duplicate_ingestion', 'duplicate_ingestion.burst_recent_10pct', 0.10e0, TRUE, FALSE,
   'duplicate_ingestion'),
  ('broken_join_dropout', 'broken_join_dropout.flat_1pct', 0.01e0, FALSE, FALSE,
   'broken_join_dropout'),
  ('broken_join_dropout', 'broken_join_dropout.heavy_5pct', 0.05e0, FALSE, FALSE,
   'broken_join_dropout'),
  ('broken_join_dropout', 'broken_join_dropout.targeted_recent_5pct', 0.05e0, TRUE, FALSE,
   'broken_join_dropout')),
trials AS (
  SELECT *, substr(sha256('retail|' || pattern_id || '|' || seed), 1, 16) AS incident_key
  FROM patterns, (SELECT unnest(range(1, {seeds} + 1)) AS seed))
"""


def pick(name: str, family: str, source: str, pk: str, condition: str = "TRUE") -> str:
    """The chosen keys of every trial of a family."""
    return f"""
{name} AS (
  SELECT incident_key, {pk} FROM (
    SELECT t.incident_key, t.fraction, s.{pk},
           count(*) OVER (PARTITION BY t.incident_key) AS n,
           row_number() OVER (PARTITION BY t.incident_key ORDER BY
             CASE WHEN t.tail THEN s.{pk} END DESC,
             md5(CAST(s.{pk} AS VARCHAR) || '#' || t.seed), s.{pk}) AS rn
    FROM trials t JOIN {source} s ON NOT t.conditional OR {condition}
    WHERE t.family = '{family}')
  WHERE rn <= greatest(1, floor(n * fraction)))
"""


NULL_PICK = pick("null_pick", "null_spike", "orders", "o_orderkey", "s.o_orderstatus = 'P'")
DUPE_PICK = pick("dupe_pick", "duplicate_ingestion", "orders", "o_orderkey")
DROP_PICK = (
    "used AS (SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)),"
    + pick("drop_pick", "broken_join_dropout", "used", "c_custkey")
)


def one_trial(pattern: str, seed: int = 1) -> str:
    return f"""
one AS (SELECT incident_key FROM trials WHERE pattern_id = '{pattern}' AND seed = {seed})
"""


def fault_ctes(picked: str, pattern: str) -> tuple[str, ...]:
    return (TRIALS.format(seeds=1), picked, one_trial(pattern))


_RAW_ORDERS = "o_orderkey, o_custkey, o_orderdate, o_orderstatus"
for _key, _pattern in {
    "fault_null_flat": "null_spike.flat_5pct",
    "fault_null_heavy": "null_spike.heavy_30pct",
    "fault_null_conditional": "null_spike.conditional_status_returned",
}.items():
    ORACLES[_key] = with_ctes(
        *fault_ctes(NULL_PICK, _pattern),
        select="""
SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT o_orderkey FROM null_pick JOIN one USING
       (incident_key)) THEN NULL ELSE o_custkey END AS o_custkey, o_orderdate, o_orderstatus
FROM orders""",
    )
for _key, _pattern in {
    "fault_dupe_flat": "duplicate_ingestion.flat_1pct",
    "fault_dupe_heavy": "duplicate_ingestion.heavy_5pct",
    "fault_dupe_tail": "duplicate_ingestion.burst_recent_10pct",
}.items():
    ORACLES[_key] = with_ctes(
        *fault_ctes(DUPE_PICK, _pattern),
        select=f"""
SELECT {_RAW_ORDERS} FROM orders UNION ALL
SELECT {_RAW_ORDERS} FROM orders
WHERE o_orderkey IN (SELECT o_orderkey FROM dupe_pick JOIN one USING (incident_key))""",
    )
for _key, _pattern in {
    "fault_drop_flat": "broken_join_dropout.flat_1pct",
    "fault_drop_heavy": "broken_join_dropout.heavy_5pct",
    "fault_drop_tail": "broken_join_dropout.targeted_recent_5pct",
}.items():
    ORACLES[_key] = with_ctes(
        *fault_ctes(DROP_PICK, _pattern),
        select="""
SELECT c_custkey, c_name FROM customer
WHERE c_custkey NOT IN (SELECT c_custkey FROM drop_pick JOIN one USING (incident_key))""",
    )
ORACLES["failing_pks_not_null"] = with_ctes(
    *fault_ctes(NULL_PICK, "null_spike.heavy_30pct"),
    select="""
SELECT 'not_null_stg_orders_customer_id' AS test_name, CAST(o_orderkey AS VARCHAR) AS pk
FROM null_pick JOIN one USING (incident_key)""",
)
ORACLES["failing_pks_unique"] = with_ctes(
    *fault_ctes(DUPE_PICK, "duplicate_ingestion.heavy_5pct"),
    select="""
SELECT 'unique_stg_orders_order_id' AS test_name, CAST(o_orderkey AS VARCHAR) AS pk
FROM dupe_pick JOIN one USING (incident_key)""",
)
ORACLES["failing_pks_relationships"] = with_ctes(
    *fault_ctes(DROP_PICK, "broken_join_dropout.heavy_5pct"),
    select="""
SELECT 'relationships_stg_orders_customer_id__customer_id__ref_stg_customers_' AS test_name,
       CAST(o_orderkey AS VARCHAR) AS pk
FROM orders JOIN drop_pick ON c_custkey = o_custkey JOIN one USING (incident_key)""",
)
ORACLES["failing_pks_stored"] = with_ctes(
    *fault_ctes(DROP_PICK, "broken_join_dropout.heavy_5pct"),
    select="""
SELECT 'relationships_stg_orders_customer_id__customer_id__ref_stg_customers_' AS test_name,
       CAST(o_orderkey AS VARCHAR) AS pk
FROM orders JOIN drop_pick ON c_custkey = o_custkey JOIN one USING (incident_key)
UNION ALL
SELECT 'unique_stg_payments_payment_id', CAST(l_orderkey * 10 + l_linenumber AS VARCHAR)
FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
)
ORACLES["verify_rows"] = with_ctes(
    *fault_ctes(DROP_PICK, "broken_join_dropout.heavy_5pct"),
    select="""
SELECT count(DISTINCT o_custkey) AS verified_rows FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer) AND o_custkey NOT IN
  (SELECT c_custkey FROM drop_pick JOIN one USING (incident_key))""",
)
ORACLES["keyed_attribution"] = with_ctes(
    *fault_ctes(NULL_PICK, "null_spike.flat_5pct"),
    select="""
SELECT 'raw_orders' AS blame_model, 'o_custkey' AS blame_column, certainty,
       CAST(o_orderkey AS VARCHAR) AS pk
FROM null_pick JOIN one USING (incident_key), (VALUES (1e0), (0.7e0)) v(certainty)""",
)
_POOLS = """
pools(family, conditional, n) AS (
  SELECT 'null_spike', FALSE, count(*) FROM orders UNION ALL
  SELECT 'null_spike', TRUE, count(*) FROM orders WHERE o_orderstatus = 'P' UNION ALL
  SELECT 'duplicate_ingestion', FALSE, count(*) FROM orders UNION ALL
  SELECT 'broken_join_dropout', FALSE, count(*) FROM customer
  WHERE c_custkey IN (SELECT o_custkey FROM orders))
"""
ORACLES["trial_suite"] = with_ctes(
    TRIALS.format(seeds=5),
    _POOLS,
    select="""
SELECT incident_key, family, pattern_id, CAST(seed AS INTEGER) AS seed, cause_class,
       CAST(greatest(1, floor(n * fraction)) AS BIGINT) AS n_chosen
FROM trials JOIN pools USING (family, conditional)""",
)
ORACLES["incident_key"] = """
SELECT doc_id, substr(sha256(source || '|' || lang || '|' || doc_id), 1, 16) AS incident_key
FROM documents
"""
_SUITE = (
    TRIALS.format(seeds=5),
    NULL_PICK,
    DUPE_PICK,
    DROP_PICK,
    """
truth_rows AS (
  SELECT incident_key, CAST(o_orderkey AS VARCHAR) AS pk FROM null_pick UNION ALL
  SELECT incident_key, CAST(o_orderkey AS VARCHAR) FROM dupe_pick UNION ALL
  SELECT incident_key, CAST(o_orderkey AS VARCHAR)
  FROM drop_pick JOIN orders ON o_custkey = c_custkey),
truth_sizes AS (
  SELECT incident_key, count(*) AS n_rows, min_by(pk, (length(pk), pk)) AS first_pk,
         max_by(pk, (length(pk), pk)) AS last_pk
  FROM truth_rows GROUP BY incident_key),
truths AS (
  SELECT incident_key, cause_class, 'raw_orders' AS source_table,
         CASE family WHEN 'duplicate_ingestion' THEN 'o_orderkey' ELSE 'o_custkey' END
           AS source_column,
         pattern_id AS fault_pattern,
         CASE family WHEN 'duplicate_ingestion' THEN 'duplicated rows in raw_orders.o_orderkey'
              WHEN 'broken_join_dropout' THEN 'deleted parents from raw_customers.c_custkey'
              ELSE '' END AS notes
  FROM trials),
totals AS (SELECT count(*) AS n FROM orders),
evidence AS (
  SELECT incident_key AS incident, family, pattern_id, seed, cause_class AS true_class,
         CASE family WHEN 'duplicate_ingestion' THEN 'unique_stg_orders_order_id'
              WHEN 'null_spike' THEN 'not_null_stg_orders_customer_id'
              ELSE 'relationships_stg_orders_customer_id__customer_id__ref_stg_customers_'
         END AS test_name,
         CASE family WHEN 'duplicate_ingestion' THEN 'unique' WHEN 'null_spike' THEN 'not_null'
              ELSE 'relationships' END AS kind,
         CASE family WHEN 'duplicate_ingestion' THEN 'order_id' ELSE 'customer_id' END AS col,
         CASE family WHEN 'duplicate_ingestion' THEN 'o_orderkey' ELSE 'o_custkey' END
           AS blame_column,
         n_rows, CASE family WHEN 'duplicate_ingestion' THEN n + n_rows ELSE n END
           AS blame_row_count,
         CASE family WHEN 'null_spike' THEN n_rows / n ELSE 0e0 END AS blame_null_rate,
         CASE family WHEN 'duplicate_ingestion' THEN n_rows ELSE 0 END AS blame_pk_dupe_count,
         CASE family WHEN 'broken_join_dropout' THEN n_rows ELSE 0 END AS orphan_fk_count,
         0e0 AS blame_lag_ratio, 0e0 AS blame_integer_compatible_ratio,
         0e0 AS blame_float_compatible_ratio, FALSE AS blame_dtype_mismatch,
         blame_pk_dupe_count > 0 AS blame_join_fanout_risk, 0e0 AS blame_value_drift_z,
         FALSE AS blame_stale_dimension, 0e0 AS blame_anomaly_score
  FROM trials JOIN truth_sizes USING (incident_key), totals)""",
    SCORED,
    """
said AS (SELECT incident AS incident_key, cause AS cause_class, top AS confidence, e.*
         FROM verdicts v JOIN evidence e USING (incident))""",
)
ORACLES["ground_truth"] = with_ctes(
    *_SUITE, select="SELECT * FROM truths JOIN truth_sizes USING (incident_key)"
)
ORACLES["ground_truth_roundtrip"] = with_ctes(
    *_SUITE,
    select="SELECT t.*, n_rows FROM truths t JOIN truth_sizes USING (incident_key)",
)
ORACLES["ground_truth_upsert"] = with_ctes(
    *_SUITE,
    select="""
SELECT * REPLACE (CASE WHEN cause_class = 'upstream_null_spike' THEN 'checked' ELSE notes END
       AS notes) FROM truths JOIN truth_sizes USING (incident_key)""",
)
ORACLES["stealth_faults"] = with_ctes(
    TRIALS.format(seeds=5),
    select="""
SELECT substr(sha256('retail_dates|' || pattern_id || '|' || seed), 1, 16) AS incident_key,
       pattern_id, CAST(seed AS INTEGER) AS seed
FROM trials WHERE family = 'null_spike'""",
)
ORACLES["trial_diagnostics"] = with_ctes(
    *_SUITE,
    select="""
SELECT incident_key, CAST(seed AS INTEGER) AS seed, pattern_id, true_class,
       test_name AS chosen_test, n_rows AS n_failing_pks, cause_class AS predicted_class,
       round(confidence, 3) AS predicted_score, round(blame_null_rate, 4) AS evidence_null_rate,
       blame_pk_dupe_count AS evidence_dupe_count, orphan_fk_count AS evidence_orphan_fk_count
FROM said""",
)
ORACLES["suite_counters"] = with_ctes(
    *_SUITE,
    select="""
SELECT (SELECT count(*) FROM trials) AS trials, count(*) AS predictions, 0::BIGINT AS stealth,
       0::BIGINT AS no_attribution FROM said""",
)
ORACLES["metric_pairs"] = with_ctes(
    *_SUITE,
    select="""
SELECT incident_key, 'raw_orders' AS candidate_tables, blame_column, cause_class,
       round(confidence, 6) AS confidence, n_rows / 1000 AS latency_seconds, true_class,
       'raw_orders' AS source_table, blame_column AS source_column
FROM said""",
)
ORACLES["metrics_report"] = with_ctes(
    *_SUITE,
    """
bins AS (SELECT least(CAST(floor(confidence * 10) AS INTEGER), 9) AS bin, count(*) AS n,
                abs(avg(CAST(cause_class = true_class AS DOUBLE)) - avg(confidence)) AS gap
         FROM said GROUP BY 1)""",
    select="""
SELECT count(*) AS n_incidents, 1e0 AS top1_table_acc, 1e0 AS top3_table_acc,
       1e0 AS column_acc_given_table, 1e0 AS row_recall, 1e0 AS row_precision, 1e0 AS row_f1,
       1e0 AS macro_class_f1,
       (SELECT round(sum(n * gap) / sum(n), 6) FROM bins) AS ece,
       round(median(n_rows / 1000), 6) AS median_latency_s
FROM said""",
)

_SUPPLY = (
    TRIALS.format(seeds=5).replace("retail|", "supply|"),
    pick("null_pick", "null_spike", "lineitem", "l_orderkey", "s.l_returnflag = 'R'"),
    DUPE_PICK,
    "used AS (SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem)),"
    + pick("drop_pick", "broken_join_dropout", "used", "s_suppkey"),
    """
hit AS (
  SELECT incident_key, l_orderkey AS k FROM null_pick UNION ALL
  SELECT incident_key, o_orderkey FROM dupe_pick UNION ALL
  SELECT incident_key, l_orderkey FROM drop_pick JOIN lineitem ON l_suppkey = s_suppkey)""",
)
ORACLES["fault_supply_targets"] = with_ctes(
    *_SUPPLY,
    select="""
SELECT incident_key, count(DISTINCT k) AS n_keys FROM hit JOIN trials USING (incident_key)
GROUP BY incident_key""",
)
ORACLES["suite_supply"] = with_ctes(
    *_SUPPLY,
    """
placed AS (
  SELECT 'null_spike' AS family, 'lineitem' AS t, 'l_partkey' AS c
  UNION ALL SELECT 'duplicate_ingestion', 'orders', 'o_orderkey'
  UNION ALL SELECT 'broken_join_dropout', 'lineitem', 'l_suppkey'),
sizes AS (
  SELECT incident_key, family, count(DISTINCT k) AS n FROM hit JOIN trials USING (incident_key) GROUP BY ALL)""",
    select="""
SELECT incident_key, t AS source_table, c AS source_column, t AS blame_table, c AS blame_column,
       n AS n_predicted, n AS n_true, n AS n_common
FROM sizes JOIN placed USING (family)""",
)

# --- baselines ----------------------------------------------------------------------------

_KIND_CAUSE = """CASE kind WHEN 'not_null' THEN 'upstream_null_spike'
  WHEN 'unique' THEN 'duplicate_ingestion' ELSE 'broken_join_dropout' END"""


def _baseline(table: str, column: str, cause: str, confidence: str) -> str:
    return with_ctes(
        *_SUITE,
        select=f"""
SELECT incident_key, {table} AS candidate_tables, {column} AS blame_column,
       {cause} AS cause_class, {confidence} AS confidence, 0e0 AS latency_seconds FROM said""",
    )


def _draw(options: tuple[str, ...], salt: str) -> str:
    number = f"CAST('0x' || substr(md5(incident_key || '#{salt}'), 1, 8) AS BIGINT)"
    return f"[{', '.join(repr(o) for o in options)}][{number} % {len(options)} + 1]"


ORACLES["baseline_test_name"] = _baseline("'stg_orders'", "col", _KIND_CAUSE, "1e0")
ORACLES["baseline_random"] = _baseline(
    _draw(("raw_customers", "raw_orders", "raw_payments"), "table"),
    "col",
    _draw(("upstream_null_spike", "duplicate_ingestion", "broken_join_dropout"), "cause"),
    "0.33e0",
)
ORACLES["baseline_name_heuristic"] = _baseline(
    "CASE WHEN contains(test_name, 'customer') THEN 'raw_customers' ELSE 'raw_orders' END",
    "col", _KIND_CAUSE, "0.8e0",
)
ORACLES["baseline_walk_only"] = _baseline("'raw_orders'", "blame_column", _KIND_CAUSE, "0.8e0")

# --- data tests and models ----------------------------------------------------------------

ORACLES["test_not_null"] = with_ctes(
    FEED, select="SELECT feed_id, line_key, ship_ts FROM feed_lines WHERE order_ref IS NULL"
)
ORACLES["test_unique"] = """
SELECT l_orderkey * 10 + l_linenumber AS unique_field, count(*) AS n_records
FROM lineitem GROUP BY 1 HAVING count(*) > 1
"""
ORACLES["test_relationships"] = """
SELECT doc_id AS from_field FROM documents
WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM labels)
"""
ORACLES["test_accepted_values"] = """
SELECT o_orderstatus AS value_field, count(*) AS n_records FROM orders
WHERE o_orderstatus NOT IN ('F', 'O') GROUP BY 1
"""
STG = """
stg_customers AS (SELECT c_custkey AS customer_id, c_name AS customer_name FROM customer),
stg_orders AS (SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS order_date,
                      o_orderstatus AS status FROM orders),
stg_payments AS (SELECT l_orderkey * 10 + l_linenumber AS payment_id, l_orderkey AS order_id,
                        l_returnflag AS payment_method, l_extendedprice / 100.0 AS amount
                 FROM lineitem),
mart_orders AS (
  SELECT o.order_id, o.customer_id, o.order_date, o.status, coalesce(p.amount, 0) AS amount
  FROM stg_orders o LEFT JOIN (SELECT order_id, sum(amount) AS amount FROM stg_payments GROUP BY 1)
    p USING (order_id)),
mart_customers AS (
  SELECT c.customer_id, c.customer_name, first_order, most_recent_order,
         coalesce(number_of_orders, 0) AS number_of_orders, coalesce(total, 0)
           AS customer_lifetime_value
  FROM stg_customers c LEFT JOIN (
    SELECT customer_id, min(order_date) AS first_order, max(order_date) AS most_recent_order,
           count(order_id) AS number_of_orders, sum(amount) AS total
    FROM mart_orders GROUP BY 1) h USING (customer_id))
"""
ORACLES["stg_customers"] = with_ctes(STG, select="SELECT * FROM stg_customers")
ORACLES["stg_orders"] = with_ctes(STG, select="SELECT * FROM stg_orders")
ORACLES["stg_payments"] = with_ctes(
    STG, select="SELECT * REPLACE (round(amount, 4) AS amount) FROM stg_payments"
)
ORACLES["mart_orders"] = with_ctes(
    STG, select="SELECT * REPLACE (round(amount, 4) AS amount) FROM mart_orders"
)
ORACLES["mart_customers"] = with_ctes(
    STG,
    select="""SELECT * REPLACE (round(customer_lifetime_value, 4) AS customer_lifetime_value)
FROM mart_customers""",
)


def _suite_sql() -> str:
    from culprit.plans.retail import TESTS

    names = {"orders": "mart_orders", "customers": "mart_customers"}
    parts = []
    for t in TESTS:
        model, col = names.get(t.model, t.model), t.column
        if t.kind == "not_null":
            body = f"SELECT count(*) AS f FROM {model} WHERE {col} IS NULL"
        elif t.kind == "unique":
            body = (
                f"SELECT count(*) AS f FROM (SELECT {col} FROM {model} WHERE {col} IS NOT NULL "
                f"GROUP BY 1 HAVING count(*) > 1)"
            )
        elif t.kind == "relationships":
            parent = names.get(t.parent_model, t.parent_model)
            body = (
                f"SELECT count(*) AS f FROM {model} c WHERE {col} IS NOT NULL AND NOT EXISTS "
                f"(SELECT 1 FROM {parent} p WHERE p.{t.parent_column} = c.{col})"
            )
        else:
            values = ", ".join(repr(v) for v in t.accepted)
            body = f"SELECT count(DISTINCT {col}) AS f FROM {model} WHERE {col} NOT IN ({values})"
        parts.append(f"SELECT '{t.name}' AS test_name, f AS failures FROM ({body})")
    union = "\nUNION ALL\n".join(parts)
    return with_ctes(
        STG,
        f"counted AS ({union})",
        select="""SELECT test_name, failures, CASE WHEN failures > 0 THEN 'fail' ELSE 'pass' END
AS status FROM counted""",
    )


ORACLES["test_suite_results"] = _suite_sql()

# --- probes -------------------------------------------------------------------------------

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
           "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
ORACLES["probe_row_count"] = "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in _TABLES
)
_TYPED = {
    "region": ("r_regionkey", "r_name"),
    "nation": ("n_nationkey", "n_name", "n_regionkey"),
    "supplier": ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"),
    "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"),
    "documents": ("doc_id", "text", "lang", "source", "n_chars"),
    "embeddings": ("vec_id", "embedding", "label"),
    "pages": ("page_id", "url", "html"),
    "benchmark": ("item_id", "text"),
    "labels": ("doc_id", "quality", "toxic"),
    "conversations": ("conv_id", "turn", "role", "text"),
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
               "o_orderpriority"),
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                 "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                 "l_shipdate"),
    "events": ("event_id", "ts", "user_id", "event_type", "value", "props"),
}
_TYPES_CTE = (
    "typed AS ("
    + "\nUNION ALL\n".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, max(typeof({c})) AS declared, "
        f"count({c}) AS filled_rows FROM {t}"
        for t, columns in _TYPED.items()
        for c in columns
    )
    + "), kinds AS (SELECT *, CASE WHEN declared = 'VARCHAR' THEN 'STRING' "
    "WHEN declared LIKE '%INT%' THEN 'INT' WHEN declared LIKE 'DOUBLE%' OR declared LIKE 'FLOAT%' THEN 'FLOAT' "
    "ELSE 'TIMESTAMP_NTZ' END AS dtype FROM typed)"
)
ORACLES["probe_column_dtype"] = with_ctes(
    _TYPES_CTE, select="SELECT table_name, column_name, dtype, filled_rows FROM kinds"
)
ORACLES["schema_mismatch"] = with_ctes(
    _TYPES_CTE,
    select="""SELECT table_name, column_name, column_name LIKE '%key' AND dtype <> 'STRING'
AS dtype_mismatch, filled_rows FROM kinds""",
)


def _stats(table: str, column: str) -> str:
    return (
        f"SELECT '{table}' AS table_name, '{column}' AS column_name, count(*) AS row_count, "
        f"count(*) - count({column}) AS null_count, count(DISTINCT {column}) AS distinct_count, "
        f"round((count(*) - count({column})) / count(*), 6) AS null_rate, "
        f"round(count(DISTINCT {column}) / count({column}), 6) AS cardinality_ratio FROM {table}"
    )


ORACLES["probe_column_stats"] = with_ctes(
    FEED,
    select="\nUNION ALL\n".join(
        [_stats("feed_lines", c) for c in ("line_key", "order_ref")]
        + [_stats("documents", c) for c in ("doc_id", "text", "lang", "source")]
    ),
)
ORACLES["probe_dupe_keys"] = """
SELECT CAST(l_orderkey AS VARCHAR) AS key_text, count(*) AS n_rows FROM lineitem
GROUP BY l_orderkey HAVING count(*) > 1
"""
ORACLES["probe_dupe_composite"] = """
SELECT l_orderkey || '|' || l_linenumber AS key_text, count(*) AS n_rows FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
"""
ORACLES["dupe_extra_rows"] = "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS extra_rows, "
    f"count(*) AS dupe_keys FROM (SELECT count(*) AS c FROM {t} GROUP BY {k} HAVING count(*) > 1)"
    for t, k in (("lineitem", "l_orderkey, l_linenumber"), ("documents", "text"),
                 ("orders", "o_orderkey"))
)
ORACLES["probe_freshness"] = f"""
SELECT event_type, max(ts) AS max_ts,
       round(date_diff('microsecond', max(ts), TIMESTAMP '{EVENTS_OBSERVED_AT}') / 1e6, 6)
         AS lag_seconds
FROM events GROUP BY event_type
"""
ORACLES["lag_ratio"] = with_ctes(
    FEED_EVIDENCE,
    select="SELECT feed_id, round(blame_lag_ratio, 6) AS blame_lag_ratio FROM line_evidence",
)
ORACLES["probe_dtype_distribution"] = with_ctes(
    EVENT_EVIDENCE,
    select="""
SELECT user_id, round(blame_integer_compatible_ratio, 6) AS int_ratio,
       round(blame_float_compatible_ratio, 6) AS float_ratio
FROM event_evidence WHERE target = 'code'""",
)
ORACLES["probe_numeric_moments"] = "\nUNION ALL\n".join(
    [
        f"SELECT '{c}' AS column_name, round(avg({c}), 4) AS mean, "
        f"round(stddev_samp({c}), 4) AS stddev FROM lineitem"
        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    ]
    + ["SELECT 'l_returnflag', 0e0, 0e0"]
)
ORACLES["probe_skew"] = """
SELECT user_id, 'value' AS column_name, round(coalesce(skewness(value), 0), 6) AS skew
FROM events GROUP BY user_id
UNION ALL SELECT DISTINCT user_id, 'event_type', 0e0 FROM events
"""

# --- evidence -----------------------------------------------------------------------------

ORACLES["evidence"] = with_ctes(
    FEED_EVIDENCE,
    select=f"""
SELECT feed_id, failing_test_kind, failing_model, failing_column, blame_model, blame_column,
       blame_pk_column, parent_table, parent_pk_column, {rounded_columns()}, parent_row_count
FROM line_evidence""",
)
ORACLES["evidence_events"] = with_ctes(
    EVENT_EVIDENCE, select=f"SELECT user_id, target, {rounded_columns()} FROM event_evidence"
)


def _fleet(incident: str, table: str, column: str | None, pk: str, parent: str = "",
           parent_pk: str = "") -> str:
    filled = f"count({column})" if column else "NULL"
    orphans = (
        f"(SELECT count(*) FROM {table} c WHERE {column} IS NOT NULL AND NOT EXISTS "
        f"(SELECT 1 FROM {parent} p WHERE p.{parent_pk} = c.{column}))"
        if parent
        else "0"
    )
    parent_dupes = (
        f"(SELECT count(*) - count(DISTINCT {parent_pk}) FROM {parent}) > 0" if parent else "FALSE"
    )
    parent_rows = f"(SELECT count(*) FROM {parent})" if parent else "-1"
    null_rate = f"round((count(*) - {filled}) / count(*), 6)" if column else "0e0"
    ratio = f"round(count(DISTINCT {column}) / {filled}, 6)" if column else "0e0"
    return (
        f"SELECT '{incident}' AS incident, count(*) AS blame_row_count, "
        f"{null_rate} AS blame_null_rate, {ratio} AS blame_cardinality_ratio, "
        f"count(*) - count(DISTINCT {pk}) AS blame_pk_dupe_count, "
        f"(count(*) - count(DISTINCT {pk})) > 0 OR {parent_dupes} AS blame_join_fanout_risk, "
        f"{orphans} AS orphan_fk_count, {parent_rows} AS parent_row_count FROM {table}"
    )


ORACLES["evidence_fleet"] = with_ctes(
    "payments AS (SELECT l_orderkey * 10 + l_linenumber AS payment_key, l_orderkey FROM lineitem)",
    select="\nUNION ALL\n".join(
        [
            _fleet("payments_key", "payments", "payment_key", "payment_key"),
            _fleet("payments_order", "payments", "l_orderkey", "payment_key", "orders",
                   "o_orderkey"),
            _fleet("orders_customer", "orders", "o_custkey", "o_orderkey", "customer",
                   "c_custkey"),
            _fleet("documents_label", "documents", "doc_id", "doc_id", "labels", "doc_id"),
            _fleet("documents_text", "documents", "text", "text"),
            _fleet("documents_gone", "documents", None, "doc_id"),
            "SELECT 'table_gone', 0, 0e0, 0e0, 0, count(*) > count(DISTINCT doc_id), 0, count(*) FROM labels",
            "SELECT 'back\\slash''s', 0, 0e0, 0e0, 0, FALSE, 0, -1",
        ]
    ),
)
ORACLES["fanout_risk"] = with_ctes(
    FEED_EVIDENCE,
    select="SELECT feed_id, blame_pk_dupe_count, blame_join_fanout_risk FROM line_evidence",
)
ORACLES["value_drift_z"] = with_ctes(
    EVENT_EVIDENCE,
    select="""SELECT user_id, round(blame_value_drift_z, 6) AS blame_value_drift_z
FROM event_evidence WHERE target = 'value'""",
)
ORACLES["orphan_fk_count"] = """
SELECT 'plain' AS variant, count(*) AS orphan_fk_count FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'null_parent', count(*) FROM documents
WHERE doc_id NOT IN (SELECT CASE WHEN quality = 1 THEN doc_id END FROM labels)
UNION ALL SELECT 'nulls_ignored', count(*) FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)
"""
ORACLES["stale_dimension"] = with_ctes(
    FEED_EVIDENCE, select="SELECT feed_id, blame_stale_dimension FROM line_evidence"
)

_FINGERPRINT = sorted(
    (*EVIDENCE_COLUMNS, "failing_test_kind", "failing_model", "failing_column", "blame_model",
     "blame_column", "blame_pk_column", "parent_table", "parent_pk_column", "parent_row_count")
)
ORACLES["evidence_fingerprint"] = with_ctes(
    FEED_EVIDENCE,
    select="SELECT feed_id, sha256(CAST(to_json({"
    + ", ".join(
        f"'{n}': CAST({n} AS DECIMAL(18, 6))" if n in _DOUBLES else f"'{n}': {n}"
        for n in _FINGERPRINT
    )
    + "}) AS VARCHAR)) AS fingerprint FROM line_evidence",
)

# --- lineage ------------------------------------------------------------------------------


def _lineage_ctes() -> tuple[str, str]:
    from culprit.plans.retail import EDGES

    rows = ",\n".join(
        f"('{d}', '{dc}', '{u}', '{uc}', '{'AGG' if agg else 'DIRECT'}', {agg})"
        for d, dc, u, uc, agg, _, _ in EDGES
    )
    return (
        f"RECURSIVE edges(dm, dc, um, uc, tag, agg) AS (VALUES {rows})",
        """
suspects AS (
  SELECT CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'orders' WHEN '2' THEN 'orders'
              WHEN '3' THEN 'customers' WHEN '4' THEN 'stg_customers' WHEN '5' THEN 'raw_orders'
              ELSE 'unknown_model' END AS model,
         CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'customer_id' WHEN '2' THEN 'amount'
              WHEN '3' THEN 'customer_lifetime_value' WHEN '4' THEN 'customer_id'
              WHEN '5' THEN 'o_custkey' ELSE 'any' END AS column_name,
         o_orderkey
  FROM orders),
counted AS (SELECT model, column_name, count(*) AS n_rows FROM suspects GROUP BY 1, 2),
steps AS (
  SELECT model, column_name, model AS at_model, column_name AS at_column, 0 AS hops,
         FALSE AS hit, '' AS path
  FROM counted
  UNION ALL
  SELECT model, column_name, um, uc, hops + 1, hit OR agg,
         path || CASE WHEN hops > 0 THEN '>' ELSE '' END || um || '.' || uc || ':' || tag
  FROM steps JOIN edges ON dm = at_model AND dc = at_column WHERE hops < 8),
walks AS (
  SELECT model, column_name, arg_max(at_model, hops) AS blame_model,
         arg_max(at_column, hops) AS blame_column, arg_max(hit, hops) AS hit_agg_boundary,
         max(hops) AS hops, arg_max(path, hops) AS path
  FROM steps GROUP BY 1, 2)""",
    )


_LINEAGE = _lineage_ctes()
ORACLES["lineage_walk"] = with_ctes(
    *_LINEAGE,
    select="""
SELECT model, column_name, blame_model, blame_column,
       CASE WHEN hops = 0 THEN 0.5e0 WHEN hit_agg_boundary THEN 0.6e0 ELSE 1e0 END AS certainty,
       hit_agg_boundary, hops, path, n_rows
FROM walks JOIN counted USING (model, column_name)""",
)
ORACLES["lineage_hop"] = with_ctes(
    *_LINEAGE,
    select="""
SELECT dm AS downstream_model, dc AS downstream_column, um AS upstream_model,
       uc AS upstream_column, tag AS transform_type, n_rows
FROM counted JOIN edges ON dm = model AND dc = column_name""",
)
ORACLES["edge_transform"] = """
SELECT CASE WHEN l_returnflag = 'R' THEN 'AGG' WHEN l_linestatus = 'F' THEN 'WINDOW'
            WHEN l_linenumber > 4 THEN 'CAST' ELSE 'DIRECT' END AS transform_type,
       count(*) AS n_edges
FROM lineitem GROUP BY 1
"""
ORACLES["blame_rows"] = with_ctes(
    *_LINEAGE,
    select="""
SELECT model, column_name, blame_model, blame_column, CAST(o_orderkey AS VARCHAR) AS pk
FROM suspects JOIN walks USING (model, column_name) WHERE NOT hit_agg_boundary""",
)
ORACLES["blame_rows_first"] = with_ctes(
    *_LINEAGE,
    select="""
SELECT model, pk, CAST(position AS INTEGER) AS position FROM (
  SELECT model, CAST(o_orderkey AS VARCHAR) AS pk, row_number() OVER (PARTITION BY model
    ORDER BY length(CAST(o_orderkey AS VARCHAR)), CAST(o_orderkey AS VARCHAR)) AS position
  FROM suspects) WHERE position <= 20""",
)
ORACLES["parent_walk"] = """
SELECT 'relationships_stg_orders_customer_id__customer_id__ref_stg_customers_' AS test_name,
       'raw_customers' AS parent_table, 'c_custkey' AS parent_pk_column, count(*) AS n_rows
FROM orders
UNION ALL SELECT 'relationships_stg_payments_order_id__order_id__ref_stg_orders_', 'raw_orders',
       'o_orderkey', count(*) FROM lineitem
UNION ALL SELECT 'relationships_orders_customer_id__customer_id__ref_customers_', 'raw_customers',
       'c_custkey', count(*) FROM orders
"""

# --- detectors, ranking, calibration ------------------------------------------------------

for _key, (_cause, _when, _score, _fields) in DETECTORS.items():
    _shown = f"'{_fields}'"
    if _key == "detect_dropout":
        _shown = (
            "CASE WHEN blame_null_rate >= 0.05e0 THEN 'orphan_fk_count,blame_null_rate' "
            "ELSE 'orphan_fk_count' END"
        )
    ORACLES[_key] = with_ctes(
        BOTH,
        select=f"""
SELECT incident, '{_cause}' AS cause_class, round({_score}, 6) AS score,
       {_shown} AS evidence_keys
FROM evidence WHERE {_when}""",
    )
ORACLES["classify_rank"] = with_ctes(
    BOTH,
    SCORED,
    select="""SELECT incident, CAST(rank AS INTEGER) AS rank, cause_class,
round(score, 6) AS score FROM ranked""",
)
ORACLES["classify_uncertain"] = with_ctes(
    BOTH,
    SCORED,
    select="""SELECT incident, top < 0.7e0 OR coalesce(top - second < 0.1e0, FALSE)
AS is_uncertain FROM top""",
)
ORACLES["verdict"] = with_ctes(BOTH, SCORED, select="SELECT incident, verdict_type FROM verdicts")
_STEPS = ", ".join(
    repr(sum(0.36787944117144233 / f for f in (1, 1, 2, 6, 24, 120, 720, 5040)[:k])) + "e0"
    for k in range(1, 9)
)
_ISOTONIC = """
pairs AS (
  SELECT feed_id, round(top, 2) AS score, CAST(s_nationkey < 12 AS DOUBLE) AS y
  FROM evidence JOIN top USING (incident) JOIN supplier ON s_suppkey = feed_id),
points AS (
  SELECT score, avg(y) AS label, CAST(count(*) AS DOUBLE) AS weight,
         row_number() OVER (ORDER BY score) AS i
  FROM pairs GROUP BY score),
cumulated AS (
  SELECT *, sum(label * weight) OVER (ORDER BY i) AS sy, sum(weight) OVER (ORDER BY i) AS sw
  FROM points),
spans AS (
  SELECT a.i AS a, b.i AS b,
         (b.sy - a.sy + a.label * a.weight) / (b.sw - a.sw + a.weight) AS mean
  FROM cumulated a JOIN cumulated b ON a.i <= b.i),
lowest AS (
  SELECT p.i, a, min(mean) AS m FROM points p JOIN spans ON a <= p.i AND b >= p.i GROUP BY 1, 2),
fitted AS (SELECT i, max(m) AS calibrated FROM lowest GROUP BY i)
"""
ORACLES["calibration_fit"] = with_ctes(
    LINES_ONLY,
    SCORED,
    _ISOTONIC,
    select="""SELECT score, weight, round(label, 6) AS label, round(calibrated, 6) AS calibrated
FROM points JOIN fitted USING (i)""",
)
ORACLES["calibration_apply"] = with_ctes(
    LINES_ONLY,
    SCORED,
    _ISOTONIC,
    select="""SELECT feed_id, score, round(calibrated, 6) AS calibrated
FROM pairs JOIN points USING (score) JOIN fitted USING (i)""",
)

ORACLES["calibration_heldout"] = with_ctes(
    BOTH,
    SCORED,
    f"""
judged AS (
  SELECT round(top, 2) AS score, split_part(incident, '/', 1) || '/' || split_part(incident, '/', 2) AS owner,
         CASE WHEN CAST('0x' || substr(md5(incident || '#label'), 1, 8) AS BIGINT) / 4294967296e0
                   < round(top, 2) * round(top, 2) THEN 1e0 ELSE 0e0 END AS y
  FROM top),
parts AS (
  SELECT *, CASE WHEN spot < 60 THEN 'fit' WHEN spot < 80 THEN 'tune' ELSE 'test' END AS part
  FROM (SELECT *, CAST('0x' || substr(md5(owner), 1, 8) AS BIGINT) % 100 AS spot FROM judged)),
points AS (
  SELECT score, avg(y) AS label, CAST(count(*) AS DOUBLE) AS weight,
         row_number() OVER (ORDER BY score) AS i
  FROM parts WHERE part = 'fit' GROUP BY score),
prior AS (SELECT avg(y) AS prior FROM parts WHERE part = 'fit'),
tenths AS (
  SELECT b, (coalesce(sum(y), 0e0) + any_value(prior)) / (count(y) + 1) AS share
  FROM (SELECT unnest(range(10)) AS b) CROSS JOIN prior
  LEFT JOIN (SELECT y, least(CAST(round(score * 1000) AS BIGINT) // 100, 9) AS tenth FROM parts
             WHERE part = 'fit') ON tenth = b GROUP BY b),
cumulated AS (
  SELECT *, sum(label * weight) OVER (ORDER BY i) AS sy, sum(weight) OVER (ORDER BY i) AS sw
  FROM points),
spans AS (
  SELECT a.i AS a, b.i AS b,
         (b.sy - a.sy + a.label * a.weight) / (b.sw - a.sw + a.weight) AS mean
  FROM cumulated a JOIN cumulated b ON a.i <= b.i),
lowest AS (
  SELECT p.i, a, min(mean) AS m FROM points p JOIN spans ON a <= p.i AND b >= p.i GROUP BY 1, 2),
knots AS (SELECT any_value(score) AS x, max(m) AS y FROM lowest JOIN points USING (i) GROUP BY i),
around AS (
  SELECT score, max(x) FILTER (x <= score) AS below, min(x) FILTER (x >= score) AS above
  FROM (SELECT DISTINCT score FROM parts), knots GROUP BY score),
curve AS (
  SELECT score, CASE WHEN lo.x IS NULL THEN hi.y WHEN hi.x IS NULL OR hi.x = lo.x THEN lo.y
                ELSE lo.y + (score - lo.x) / (hi.x - lo.x) * (hi.y - lo.y) END AS level
  FROM around LEFT JOIN knots lo ON lo.x = below LEFT JOIN knots hi ON hi.x = above),
said AS (
  SELECT part, owner, y, 'raw' AS method, 0 AS slot, score AS p FROM parts
  UNION ALL SELECT part, owner, y, 'prior', 1, prior FROM parts, prior
  UNION ALL SELECT part, owner, y, 'bins', 2, share FROM parts
    JOIN tenths ON b = least(CAST(round(score * 1000) AS BIGINT) // 100, 9)
  UNION ALL SELECT part, owner, y, 'isotonic', 3, level FROM parts JOIN curve USING (score)),
tuned AS (
  SELECT method, any_value(slot) AS slot, count(*) AS n_tune, avg((p - y) * (p - y)) AS brier
  FROM said WHERE part = 'tune' GROUP BY method),
gaps AS (
  SELECT method, owner, least(CAST(round(p * 1000) AS BIGINT) // 100, 9) AS b, sum(y - p) AS gap,
         count(*) AS n
  FROM said WHERE part = 'test' GROUP BY ALL),
drawn AS (
  SELECT *, CASE WHEN draw = 0 THEN 1 ELSE (
      SELECT count(*) FROM (SELECT unnest([{_STEPS}]) AS step) WHERE u >= step) END AS times
  FROM (SELECT *, CAST('0x' || substr(md5(owner || '#' || draw), 1, 8) AS BIGINT) / 4294967296e0 AS u
        FROM gaps, (SELECT unnest(range(0, 201)) AS draw))),
errors AS (
  SELECT method, draw, sum(abs(gap)) / nullif(sum(n), 0) AS ece, sum(n) AS n
  FROM (SELECT method, draw, b, sum(times * gap) AS gap, sum(times * n) AS n FROM drawn GROUP BY ALL)
  GROUP BY ALL),
tested AS (
  SELECT method, CAST(max(n) FILTER (draw = 0) AS BIGINT) AS n_test, max(ece) FILTER (draw = 0) AS ece,
         quantile_cont(ece, 0.025e0) FILTER (draw > 0) AS ece_low,
         quantile_cont(ece, 0.975e0) FILTER (draw > 0) AS ece_high
  FROM errors GROUP BY method)""",
    select="""
SELECT method, n_tune, round(brier, 6) AS brier,
       row_number() OVER (ORDER BY brier, slot) = 1 AS chosen, n_test, round(ece, 6) AS ece,
       round(ece_low, 6) AS ece_low, round(ece_high, 6) AS ece_high
FROM tuned JOIN tested USING (method)""",
)

# --- incidents ----------------------------------------------------------------------------

ORACLES["incidents"] = with_ctes(INCIDENTS, select=INCIDENT_SELECT)
ORACLES["incident_roundtrip"] = ORACLES["incidents"]
ORACLES["evidence_summary"] = with_ctes(
    INCIDENTS, select="SELECT incident_id, evidence_summary FROM summed"
)
ORACLES["suggested_fix"] = with_ctes(
    INCIDENTS, select="SELECT incident_id, suggested_fix FROM summed"
)
ORACLES["incident_rows"] = with_ctes(STORED, select="SELECT * FROM stored")
ORACLES["incident_upsert"] = with_ctes(
    STORED,
    select="""
SELECT * REPLACE (CASE WHEN verdict_type = 'auto' THEN failing_row_count ELSE 0 END
       AS failing_row_count) FROM stored
UNION ALL
SELECT * REPLACE (incident_id || '_b' AS incident_id) FROM stored WHERE verdict_type = 'auto'""",
)
ORACLES["incident_by_id"] = with_ctes(
    STORED,
    select="SELECT * FROM stored ORDER BY failing_row_count DESC, incident_id DESC LIMIT 1",
)
ORACLES["incident_store_lifecycle"] = with_ctes(
    STORED,
    select="""
SELECT * REPLACE (
  CASE WHEN failing_row_count % 2 = 1 THEN 0.5e0 ELSE 0e0 END AS token_cost_usd,
  CASE WHEN failing_row_count % 2 = 1 OR failing_row_count % 6 = 0 THEN 'none'
       ELSE coalesce(final_cause_class, 'none') END AS human_label)
FROM stored WHERE failing_row_count % 3 <> 0 OR failing_row_count % 6 = 0""",
)
ORACLES["incident_list"] = with_ctes(
    STORED,
    select="SELECT * FROM stored WHERE verdict_type = 'two_candidate'",
)
ORACLES["incident_delete"] = with_ctes(
    STORED,
    select="""SELECT * FROM stored
WHERE NOT (verdict_type = 'triage_only' OR failing_row_count > 3)""",
)
ORACLES["label_update"] = with_ctes(
    STORED,
    select="""
SELECT incident_id,
       CASE WHEN verdict_type = 'auto' THEN final_cause_class ELSE 'none' END AS human_label,
       CASE WHEN verdict_type = 'auto' THEN final_cause_class ELSE 'none' END AS payload_label
FROM stored""",
)
ORACLES["incident_summary"] = with_ctes(
    INCIDENTS,
    select="""SELECT incident_id, created_at, failing_model, verdict_type, top_class AS cause
FROM summed""",
)
_TOLD = f"""
told AS (
  SELECT *, '🚨 Data Quality Failure: {LINE_TEST}' AS headline,
    'A test failure was detected in model `stg_lines` on column `order_ref`.' || chr(10) || chr(10)
    || 'The attribution walker tracked the root blame to `feed_lines` column `order_ref`. '
    || 'Rules classification determined the likely cause is `' || top_class
    || '` with the current evidence.' AS narrative,
    CASE WHEN verdict_type = 'triage_only' THEN 'Inspect the raw warehouse table.'
         ELSE suggested_fix END AS one_line_fix
  FROM summed)
"""
ORACLES["narrative"] = with_ctes(
    INCIDENTS,
    _TOLD,
    select="SELECT incident_id, headline, narrative, one_line_fix FROM told",
)
_BUTTON = """{{'type': 'button', 'text': {{'type': 'plain_text', 'text': '{label}',
 'emoji': TRUE}}, 'style': '{style}', 'value': 'feedback|' || incident_id || '|{answer}',
 'action_id': '{answer}_verdict'}}"""
ORACLES["message_payload"] = with_ctes(
    INCIDENTS,
    _TOLD,
    select=f"""
SELECT incident_id,
  '[' || concat_ws(',',
    to_json({{'type': 'header', 'text': {{'type': 'plain_text', 'text':
      CASE verdict_type WHEN 'auto' THEN '🟢 [AUTO-RESOLVED]'
        WHEN 'two_candidate' THEN '🟡 [TWO-CANDIDATE]' ELSE '🔴 [TRIAGE-ONLY]' END
      || ' ' || headline, 'emoji': TRUE}}}}),
    to_json({{'type': 'context', 'elements': [{{'type': 'mrkdwn', 'text': '*Incident:* `'
      || incident_id || '` | *Failing Test:* `{LINE_TEST}` | *Failing Model:* '
      || '`stg_lines.order_ref`'}}]}}),
    to_json({{'type': 'divider'}}),
    to_json({{'type': 'section', 'text': {{'type': 'mrkdwn', 'text': narrative}}}}),
    to_json({{'type': 'section', 'text': {{'type': 'mrkdwn', 'text':
      '*Suggested One-Line Fix:*' || chr(10) || '```' || one_line_fix || '```'}}}}),
    to_json({{'type': 'divider'}}),
    to_json({{'type': 'actions', 'elements': [
      {_BUTTON.format(label='👍 Accept Verdict', style='primary', answer='accept')},
      {_BUTTON.format(label='👎 Reject Verdict', style='danger', answer='reject')}]}})
  ) || ']' AS chat_blocks,
  '## 🚨 Data Quality Failure Diagnosed: ' || headline || chr(10) || chr(10)
  || '| Attribute | Details |' || chr(10) || '|---|---|' || chr(10)
  || '| **Incident ID** | `' || incident_id || '` |' || chr(10)
  || '| **Failing Test** | `{LINE_TEST}` |' || chr(10)
  || '| **Failing Model** | `stg_lines.order_ref` |' || chr(10)
  || '| **Attributed Blame** | `feed_lines.order_ref` |' || chr(10) || chr(10)
  || '---' || chr(10) || chr(10) || '### 🔍 Root-Cause Analysis' || chr(10) || chr(10)
  || narrative || chr(10) || chr(10) || '### 💡 Suggested Actionable Fix' || chr(10) || chr(10)
  || '```sql' || chr(10) || one_line_fix || chr(10) || '```' || chr(10) AS review_body
FROM told""",
)

ORACLES["triage_stream"] = with_ctes(
    INCIDENTS,
    select="SELECT incident_id, failing_test_name, verdict_type FROM summed WHERE failing_row_count > 0",
)

# --- repairs ------------------------------------------------------------------------------

ORACLES["repair_nulls"] = with_ctes(
    FEED,
    select="""
SELECT 'drop' AS mode, feed_id, count(*) AS n_rows, min(order_ref) AS least_ref
FROM feed_lines WHERE order_ref IS NOT NULL GROUP BY feed_id
UNION ALL
SELECT 'fill', feed_id, count(*), min(coalesce(order_ref, -1)) FROM feed_lines GROUP BY feed_id""",
)
ORACLES["repair_duplicates_nulls"] = with_ctes(
    FEED,
    select="""
SELECT feed_id, ship_ts, order_text, line_key FROM (
  SELECT feed_id, ship_ts, CAST(order_ref AS VARCHAR) AS order_text, line_key,
         row_number() OVER (PARTITION BY feed_id, ship_ts
           ORDER BY CAST(order_ref AS VARCHAR) DESC NULLS LAST, line_key) AS rn
  FROM feed_lines) WHERE rn = 1""",
)
ORACLES["repair_duplicates"] = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_extendedprice DESC, l_partkey, l_suppkey) AS rn FROM lineitem)
WHERE rn = 1
"""
ORACLES["repair_orphans"] = with_ctes(
    FEED,
    """
marked AS (SELECT *, order_ref IS NULL OR EXISTS (SELECT 1 FROM settled
           WHERE o_orderkey = order_ref) AS ok FROM feed_lines)""",
    select="""
SELECT 'drop' AS mode, feed_id, count(*) FILTER (ok) AS n_rows, 0 AS n_fallback
FROM marked GROUP BY feed_id
UNION ALL
SELECT 'fallback', feed_id, count(*), count(*) FILTER (NOT ok) FROM marked GROUP BY feed_id""",
)

# --- scores -------------------------------------------------------------------------------

ORACLES["predictions"] = with_ctes(
    INCIDENTS,
    select="""
SELECT incident_id AS incident_key, 'feed_lines' AS candidate_tables, blame_column,
       top_class AS cause_class, round(confidence, 6) AS confidence, 0e0 AS latency_seconds
FROM summed""",
)
_NOISY = (
    LINES_ONLY,
    SCORED,
    """
pairs AS (
  SELECT incident AS incident_key, cause AS said, top AS confidence, s_nationkey AS nation,
         blame_row_count / 1000 AS latency,
         CASE WHEN s_nationkey < 8 THEN 'broken_join_fanout' WHEN s_nationkey < 16
              THEN 'late_arriving' ELSE 'duplicate_ingestion' END AS true_class
  FROM evidence JOIN top USING (incident) JOIN supplier ON s_suppkey = feed_id),
cheap AS (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS k, l_orderkey || '-' || l_linenumber AS pk
          FROM lineitem WHERE l_returnflag <> 'N'),
late AS (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS k, l_orderkey || '-' || l_linenumber AS pk
         FROM lineitem WHERE l_linestatus = 'F'),
sizes AS (
  SELECT incident_key, (SELECT count(*) FROM cheap WHERE k = incident_key) AS n_said,
         (SELECT count(*) FROM late WHERE k = incident_key) AS n_true,
         (SELECT count(*) FROM cheap JOIN late USING (k, pk) WHERE k = incident_key) AS n_common
  FROM pairs),
row_means AS (
  SELECT coalesce(avg(n_common / n_true) FILTER (n_true > 0), 0) AS recall,
         coalesce(avg(n_common / n_said) FILTER (n_said > 0), 0) AS prec
  FROM sizes),
f1s AS (
  SELECT c, 2 * count(*) FILTER (said = c AND true_class = c)
            / (count(*) FILTER (said = c) + count(*) FILTER (true_class = c)) AS f1
  FROM pairs, (SELECT DISTINCT true_class AS c FROM pairs) GROUP BY c),
bins AS (
  SELECT least(CAST(floor(confidence * 10) AS INTEGER), 9) AS bin, count(*) AS n,
         abs(avg(CAST(said = true_class AS DOUBLE)) - avg(confidence)) AS gap
  FROM pairs GROUP BY 1),
report AS (
  SELECT count(*) AS n_incidents, avg(CAST(nation < 15 AS DOUBLE)) AS top1_table_acc,
         avg(CAST(nation < 20 AS DOUBLE)) AS top3_table_acc,
         avg(CAST(nation < 10 AS DOUBLE)) FILTER (nation < 15) AS column_acc_given_table,
         (SELECT recall FROM row_means) AS row_recall,
         (SELECT prec FROM row_means) AS row_precision,
         (SELECT 2 * recall * prec / (recall + prec) FROM row_means) AS row_f1,
         (SELECT avg(f1) FROM f1s) AS macro_class_f1,
         (SELECT sum(n * gap) / sum(n) FROM bins) AS ece, median(latency) AS median_latency_s
  FROM pairs)""",
)
_REPORT_FIELDS = (
    "top1_table_acc", "top3_table_acc", "column_acc_given_table", "row_recall", "row_precision",
    "row_f1", "macro_class_f1", "ece", "median_latency_s",
)


def _report(*fields: str) -> str:
    shown = ", ".join(f if f == "n_incidents" else f"round({f}, 6) AS {f}" for f in fields)
    return with_ctes(*_NOISY, select=f"SELECT {shown} FROM report")


ORACLES["metric_topk"] = _report("n_incidents", "top1_table_acc", "top3_table_acc")
ORACLES["metric_column_acc"] = _report("column_acc_given_table")
ORACLES["metric_row_recall"] = _report("row_recall")
ORACLES["metric_row_precision"] = _report("row_precision")
ORACLES["metric_row_f1"] = _report("row_f1")
ORACLES["metric_macro_f1"] = _report("macro_class_f1")
ORACLES["metric_ece"] = _report("ece")
ORACLES["metric_median_latency"] = _report("median_latency_s")
ORACLES["metrics_report_fleet"] = _report("n_incidents", *_REPORT_FIELDS)
ORACLES["metric_per_class"] = with_ctes(
    *_NOISY,
    select="""
SELECT true_class AS class, round(avg(CAST(said = true_class AS DOUBLE)), 6) AS accuracy,
       count(*) AS n FROM pairs GROUP BY 1""",
)
ORACLES["metrics_report_row"] = with_ctes(
    *_NOISY,
    select="""
SELECT '| culprit | ' || printf('%.1f%%', top1_table_acc * 100) || ' | '
  || printf('%.1f%%', top3_table_acc * 100) || ' | '
  || printf('%.1f%%', column_acc_given_table * 100) || ' | ' || printf('%.2f', row_recall) || ' | '
  || printf('%.2f', row_f1) || ' | ' || printf('%.2f', macro_class_f1) || ' | '
  || printf('%.1fs', median_latency_s) || ' | ' || printf('%.3f', ece) || ' |' AS report_row
FROM report""",
)
ORACLES["triage_retail"] = """
WITH p AS (SELECT count(*) AS n, count(DISTINCT l_orderkey * 10 + l_linenumber) AS keys,
                  (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber
                   HAVING count(*) > 1)) AS dupe_keys FROM lineitem)
SELECT 'inc_' || substr(md5(failing_test_name), 1, 12) AS incident_id, *
FROM (
  SELECT TIMESTAMP '2024-01-01 00:00:00' AS created_at,
         'unique_stg_payments_payment_id' AS failing_test_name, 'stg_payments' AS failing_model,
         'payment_id' AS failing_column, dupe_keys AS failing_row_count,
         'raw_payments' AS blame_model, 'payment_key' AS blame_column,
         CAST(1 AS DOUBLE) AS blame_certainty, 1 AS hops,
         'duplicate_ingestion>broken_join_fanout' AS causes, 'duplicate_ingestion' AS top_class,
         least(1e0, 0.7e0 + (n - keys) / n * 30e0) AS confidence,
         'Blame PK has ' || (n - keys) || ' duplicate occurrence(s) in ' || n || ' rows.'
           AS evidence_summary,
         'De-duplicate raw_payments.payment_key before downstream models consume it.'
           AS suggested_fix,
         'two_candidate' AS verdict_type, 'duplicate_ingestion' AS final_class
  FROM p
  UNION ALL
  SELECT TIMESTAMP '2024-01-01 00:00:00', 'accepted_values_stg_orders_status__F__O', 'stg_orders',
         'status', 0, 'raw_orders', 'o_orderstatus', CAST(1 AS DOUBLE), 1, 'unknown', 'unknown',
         0.5e0, 'No deterministic detector fired (score 0.50).',
         'Inspect raw_orders.o_orderstatus manually — no rule fired.', 'triage_only', 'none')
"""

# --- places, classes, layers --------------------------------------------------------------

ORACLES["metric_confusion"] = with_ctes(
    *_NOISY, select="SELECT true_class, said AS cause_class, count(*) AS n FROM pairs GROUP BY 1, 2"
)
ORACLES["incidents_by_place"] = with_ctes(
    INCIDENTS,
    select="""
SELECT blame_model, blame_column, coalesce(final_cause, top_class) AS cause,
       count(*) AS n_incidents, min(created_at) AS first_seen, max(created_at) AS last_seen
FROM summed GROUP BY 1, 2, 3""",
)
ORACLES["lag_ratio_sla"] = with_ctes(
    FEED_EVIDENCE,
    select="""
SELECT feed_id, round(blame_lag_ratio * 1440 / (SELECT count(*) FROM orders), 6) AS blame_lag_ratio
FROM line_evidence""",
)
ORACLES["first_temporal"] = """
SELECT 'orders' AS table_name, 'o_orderdate' AS column_name, count(o_orderdate) AS filled_rows
FROM orders
UNION ALL SELECT 'lineitem', 'l_shipdate', count(l_shipdate) FROM lineitem
UNION ALL SELECT 'events', 'ts', count(ts) FROM events
"""
ORACLES["key_column"] = with_ctes(
    *_LINEAGE,
    select="""
SELECT model, CASE model WHEN 'orders' THEN 'order_id' WHEN 'customers' THEN 'customer_id'
  WHEN 'stg_customers' THEN 'customer_id' WHEN 'raw_orders' THEN 'o_orderkey' ELSE 'id' END
  AS key_column, count(*) AS n_rows
FROM suspects GROUP BY 1, 2""",
)
ORACLES["seed_csv"] = "SELECT s_suppkey, s_name, s_nationkey FROM supplier"
ORACLES["materialised_layers"] = with_ctes(
    STG,
    select="""
SELECT customer_id, customer_name, number_of_orders
FROM stg_customers JOIN mart_customers USING (customer_id, customer_name)""",
)

# --- history ------------------------------------------------------------------------------

ORACLES["null_rate_trend"] = with_ctes(
    FEED,
    """
daily AS (
  SELECT CAST(ship_ts AS DATE) AS day, count(*) AS n_rows,
         (count(*) - count(order_ref)) / count(*) AS null_rate
  FROM feed_lines WHERE ship_ts IS NOT NULL GROUP BY 1),
trend AS (
  SELECT d.day, any_value(d.n_rows) AS n_rows, any_value(d.null_rate) AS null_rate,
         median(b.null_rate) AS p50, avg(b.null_rate) AS mean, stddev_samp(b.null_rate) AS spread
  FROM daily d LEFT JOIN daily b ON b.day >= d.day - 30 AND b.day < d.day GROUP BY d.day)""",
    select="""
SELECT CAST(day AS VARCHAR) AS day, n_rows, round(null_rate, 6) AS null_rate,
       round(p50, 6) AS null_rate_p50,
       round(CASE WHEN spread > 0 THEN (null_rate - mean) / spread ELSE 0e0 END, 6) AS null_rate_z
FROM trend""",
)
ORACLES["schema_diff"] = with_ctes(
    _TYPES_CTE,
    select="""
SELECT table_name, column_name,
       CASE WHEN column_name = 'l_tax' THEN 'none' WHEN column_name LIKE '%key' THEN 'STRING'
            ELSE dtype END AS old_dtype,
       CASE WHEN column_name = 'o_orderpriority' THEN 'none' ELSE dtype END AS new_dtype,
       CASE WHEN column_name = 'l_tax' THEN 'added' WHEN column_name = 'o_orderpriority'
            THEN 'dropped' ELSE 'retyped' END AS change, filled_rows
FROM kinds WHERE column_name IN ('l_tax', 'o_orderpriority') OR column_name LIKE '%key'""",
)
ORACLES["expired_references"] = """
SELECT l_suppkey AS feed_id, count(*) AS n_rows,
       count(*) FILTER (s_nationkey > 0
         AND TIMESTAMP '1996-01-01' + to_days(CAST(s_nationkey * 100 AS INTEGER)) < l_shipdate) AS n_expired
FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1
"""
ORACLES["interval_references"] = """
WITH contracts AS (
  SELECT l_suppkey AS member, o_orderdate AS valid_from,
         CASE WHEN o_orderkey % 101 <> 0 THEN o_orderdate + to_days(CAST(o_orderkey % 60 AS INTEGER))
         END AS valid_to
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey % 13 = 0),
begun AS (SELECT member, min(valid_from) AS earliest FROM contracts GROUP BY 1),
lines AS (
  SELECT l_suppkey, l_orderkey, l_linenumber, l_shipdate,
         EXISTS (SELECT 1 FROM contracts c WHERE c.member = l_suppkey AND c.valid_from <= l_shipdate
                 AND (c.valid_to IS NULL OR c.valid_to >= l_shipdate)) AS covered
  FROM lineitem)
SELECT l_suppkey AS feed_id, count(*) AS n_rows,
       count(*) FILTER (earliest > l_shipdate) AS n_early,
       count(*) FILTER (earliest <= l_shipdate AND NOT covered) AS n_expired,
       count(*) FILTER (earliest IS NULL) AS n_unknown
FROM lines LEFT JOIN begun ON member = l_suppkey GROUP BY 1
"""
ORACLES["row_carry"] = """
WITH busy AS (
  SELECT o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)
  GROUP BY 1 HAVING count(*) >= 20),
picked AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 50 = 0),
ranked AS (
  SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place
  FROM orders),
found AS (
  SELECT 'customers' AS model, 'first_order' AS column_name, 'orders' AS blame_model,
         'order_date' AS blame_column, o_orderkey AS pk, 0.7e0 AS certainty, 'agg_boundary' AS ended, 1 AS hops
  FROM orders WHERE o_custkey IN (SELECT o_custkey FROM busy)
  UNION ALL
  SELECT 'customers', 'customer_name', 'raw_customers', 'c_name', o_custkey, 1e0, 'source', 2 FROM busy
  UNION ALL
  SELECT 'orders', 'customer_id', 'raw_orders', 'o_custkey', o_orderkey, 1e0, 'source', 2 FROM picked
  UNION ALL
  SELECT 'orders', 'customer_id', 'raw_customers', 'c_custkey', c_custkey, 0.85e0, 'source', 2
  FROM customer WHERE c_custkey IN (SELECT o_custkey FROM picked)
  UNION ALL
  SELECT 'orders', 'amount', 'stg_payments', 'amount', l_orderkey * 10 + l_linenumber, 0.7e0, 'agg_boundary', 1
  FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 400 = 1)
  UNION ALL
  SELECT 'order_ranks', 'order_rank', 'raw_orders', 'o_orderdate', o_orderkey, 0.8e0, 'source', 2
  FROM orders WHERE o_custkey IN (SELECT o_custkey FROM ranked WHERE place = 15))
SELECT DISTINCT * REPLACE (CAST(pk AS VARCHAR) AS pk) FROM found
"""
ORACLES["unit_shift"] = """
SELECT user_id, CASE WHEN user_id % 3 = 0 THEN 100e0 ELSE 1e0 END AS unit_factor
FROM events GROUP BY user_id
"""
ORACLES["hash_split"] = """
SELECT doc_id, CASE WHEN spot < 60 THEN 'fit' WHEN spot < 80 THEN 'tune' ELSE 'test' END AS part
FROM (SELECT doc_id, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 AS spot
      FROM labels)
"""
ORACLES["blame_outside"] = with_ctes(
    INCIDENTS, select="SELECT count(*) AS n_incidents, count(*) AS n_outside FROM summed"
)
ORACLES["metric_interval"] = with_ctes(
    *_NOISY,
    f"""
drawn AS (
  SELECT CASE WHEN nation < 15 THEN 1e0 ELSE 0e0 END AS hit, draw,
         CAST('0x' || substr(md5(incident_key || '#' || draw), 1, 8) AS BIGINT) / 4294967296e0 AS u
  FROM pairs, (SELECT unnest(range(1, 201)) AS draw)),
counted AS (
  SELECT hit, draw, (SELECT count(*) FROM (SELECT unnest([{_STEPS}]) AS step) WHERE u >= step) AS times
  FROM drawn),
means AS (SELECT draw, sum(hit * times) / sum(times) AS mean FROM counted GROUP BY draw)""",
    select="""
SELECT round(quantile_cont(mean, 0.025e0), 6) AS low, round(quantile_cont(mean, 0.975e0), 6) AS high,
       (SELECT round(avg(CASE WHEN nation < 15 THEN 1e0 ELSE 0e0 END), 6) FROM pairs) AS mean
FROM means""",
)
ORACLES["triage_calibrated"] = with_ctes(
    LINES_ONLY,
    SCORED,
    _ISOTONIC,
    """
knots AS (SELECT score AS x, calibrated AS y FROM points JOIN fitted USING (i)),
asked AS (
  SELECT 'unique_stg_payments_payment_id' AS failing_test_name,
         (SELECT least(1e0, 0.7e0 + (count(*) - count(DISTINCT l_orderkey * 10 + l_linenumber))
                 / count(*) * 30e0) FROM lineitem) AS confidence
  UNION ALL SELECT 'accepted_values_stg_orders_status__F__O', 0.5e0),
around AS (
  SELECT failing_test_name, any_value(confidence) AS confidence,
         any_value(round(confidence, 3)) AS s, max(x) FILTER (x <= round(confidence, 3)) AS below,
         min(x) FILTER (x >= round(confidence, 3)) AS above
  FROM asked, knots GROUP BY failing_test_name)""",
    select="""
SELECT failing_test_name, round(confidence, 6) AS confidence, round(CASE
    WHEN below IS NULL THEN (SELECT y FROM knots WHERE x = above)
    WHEN above IS NULL OR above = below THEN (SELECT y FROM knots WHERE x = below)
    ELSE (SELECT y FROM knots WHERE x = below) + (s - below) / (above - below)
      * ((SELECT y FROM knots WHERE x = above) - (SELECT y FROM knots WHERE x = below)) END, 6) AS calibrated
FROM around""",
)
ORACLES["fact_stream"] = """
WITH settled AS (
  SELECT DISTINCT CASE WHEN substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 2) = '00' THEN -o_orderkey
                  ELSE o_orderkey END AS k FROM orders),
lines AS (
  SELECT l_suppkey AS feed_id, l_orderkey * 10 + l_linenumber AS line_key, l_shipdate AS at_time,
         CASE WHEN NOT (l_discount = 0 AND l_tax = 0) THEN l_orderkey END AS order_ref,
         year(l_shipdate) % 3 AS turn
  FROM lineitem),
judged AS (SELECT lines.*, order_ref IS NOT NULL AND k IS NULL AS orphan
           FROM lines LEFT JOIN settled ON order_ref = k),
turns AS (SELECT feed_id, turn, count_if(orphan) AS n FROM judged GROUP BY ALL),
stand AS (
  SELECT feed_id, count(*) AS n_deliveries, arg_max(n, turn) AS now, sum(n) - arg_max(n, turn) AS earlier
  FROM turns GROUP BY feed_id)
SELECT feed_id, count(*) AS n_rows, count(*) - count(order_ref) AS n_null,
       count_if(orphan) AS n_orphans, count(line_key) - count(DISTINCT line_key) AS n_repeated,
       strftime(max(at_time), '%Y-%m-%d %H:%M:%S') AS latest, any_value(n_deliveries) AS n_deliveries,
       any_value(CASE WHEN now + earlier = 0 THEN 'clean' WHEN now = 0 THEN 'resolved'
                 WHEN earlier > 0 THEN 'repeated' ELSE 'open' END) AS status
FROM judged JOIN stand USING (feed_id) GROUP BY feed_id
"""
