"""Record schemas and the closed value sets they use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: these must equal the published record definitions -----------
CAUSE_CLASSES = (
    "late_arriving",
    "upstream_null_spike",
    "type_coercion",
    "duplicate_ingestion",
    "broken_join_fanout",
    "broken_join_dropout",
    "source_schema_change",
    "stale_dimension",
    "unit_encoding_drift",
    "unknown",
)
TRANSFORMS = ("DIRECT", "CAST", "AGG", "JOIN_KEY", "CASE", "UDF", "WINDOW", "OPAQUE")
VERDICTS = ("auto", "two_candidate", "triage_only")
TEST_KINDS = ("not_null", "unique", "accepted_values", "relationships")
FAILED_STATUSES = ("fail", "error", "warn")
# --------------------------------------------------------------------------------

TEXT, WHOLE, REAL, FLAG, MOMENT = (
    T.StringType(),
    T.LongType(),
    T.DoubleType(),
    T.BooleanType(),
    T.TimestampType(),
)
TEXTS = T.ArrayType(TEXT)


def record(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


EDGE = record(
    downstream_model=TEXT,
    downstream_column=TEXT,
    upstream_model=TEXT,
    upstream_column=TEXT,
    has_agg=FLAG,
    has_window=FLAG,
    has_cast=FLAG,
    ordinal=T.IntegerType(),
)
NODE = record(unique_id=TEXT, name=TEXT, schema=TEXT, alias=TEXT, database=TEXT, kind=TEXT)
WALK_STEP = record(
    downstream_model=TEXT,
    downstream_column=TEXT,
    upstream_model=TEXT,
    upstream_column=TEXT,
    transform_type=TEXT,
    attribution_certainty=REAL,
)
CLASS_SCORE = record(cause_class=TEXT, score=REAL, evidence_keys=TEXTS)
HYPOTHESIS = record(
    cause_class=TEXT,
    blame_model=TEXT,
    blame_column=TEXT,
    blame_rows_sample=TEXTS,
    confidence=REAL,
    confidence_calibrated=REAL,
    evidence_summary=TEXT,
    suggested_one_line_fix=TEXT,
)
BLAME = record(
    model=TEXT,
    column=TEXT,
    certainty=REAL,
    walk_path=T.ArrayType(WALK_STEP),
    hit_agg_boundary=FLAG,
)
INCIDENT = record(
    incident_id=TEXT,
    created_at=MOMENT,
    failing_test_name=TEXT,
    failing_model=TEXT,
    failing_column=TEXT,
    failing_row_count=WHOLE,
    failing_rows_sample=TEXTS,
    blame_location=BLAME,
    upstream_stats=TEXTS,
    class_scores=T.ArrayType(CLASS_SCORE),
    hypotheses=T.ArrayType(HYPOTHESIS),
    verdict_type=TEXT,
    final_verdict=HYPOTHESIS,
    human_label=TEXT,
    time_to_verdict_seconds=REAL,
    token_cost_usd=REAL,
)
GROUND_TRUTH = record(
    incident_key=TEXT,
    cause_class=TEXT,
    source_table=TEXT,
    source_column=TEXT,
    injected_at=MOMENT,
    fault_pattern=TEXT,
    notes=TEXT,
)
TRUTH_ROW = record(incident_key=TEXT, pk=TEXT)
PREDICTION = record(
    incident_key=TEXT,
    candidate_tables=TEXTS,
    blame_column=TEXT,
    cause_class=TEXT,
    confidence=REAL,
    latency_seconds=REAL,
)

# One evidence row per incident.  The value is the neutral default a probe falls
# back to when it has nothing to say, so that detectors never meet a null.
# --- fixed values: evidence fields and what they are where nothing was found ----------
EVIDENCE_DEFAULTS: dict[str, object] = {
    "blame_row_count": 0,
    "blame_null_rate": 0.0,
    "blame_cardinality_ratio": 0.0,
    "blame_pk_dupe_count": 0,
    "blame_lag_ratio": 0.0,
    "blame_integer_compatible_ratio": 0.0,
    "blame_float_compatible_ratio": 0.0,
    "blame_dtype_mismatch": False,
    "blame_join_fanout_risk": False,
    "blame_value_drift_z": 0.0,
    "blame_stale_dimension": False,
    "blame_anomaly_score": 0.0,
    "orphan_fk_count": 0,
}
EVIDENCE_LABELS = (
    "failing_test_kind",
    "failing_model",
    "failing_column",
    "blame_model",
    "blame_column",
    "blame_pk_column",
    "parent_table",
    "parent_pk_column",
)
EVIDENCE_FIELDS = (*EVIDENCE_LABELS, *EVIDENCE_DEFAULTS, "parent_row_count")


def in_unit_interval(col: Column) -> Column:
    return col.between(0.0, 1.0)


def bound_violations(df: DataFrame, score_columns: list[str], **closed: tuple) -> DataFrame:
    """Rows that break the record rules: scores outside [0,1] or values outside a set."""
    broken = F.lit(False)
    for name in score_columns:
        broken = broken | ~in_unit_interval(F.col(name))
    for name, allowed in closed.items():
        broken = broken | ~F.col(name).isin(*allowed)
    return df.filter(F.coalesce(broken, F.lit(False)))
