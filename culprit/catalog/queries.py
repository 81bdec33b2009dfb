"""The registered queries: one per operator, over the whole given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from culprit.catalog import fixtures as fx
from culprit.functions.detectors import DETECTORS, Detector, verdict
from culprit.functions.dtypes import first_temporal, norm_dtype
from culprit.functions.keys import incident_key, text_key
from culprit.operators import (
    baselines,
    calibration,
    carry,
    datatests,
    history,
    lineage,
    metrics,
    probes,
    repair,
)
from culprit.operators.evidence import Target, assemble_evidence, fingerprint, schema_mismatch
from culprit.operators.faults import NULLS, FaultTarget, find_cuts, inject, trial_frame, trials_for
from culprit.operators.incidents import (
    build_incidents,
    choose_test,
    classify,
    from_payload,
    incident_rows,
    incident_summary,
    incidents_by_place,
    narrate,
    ranked_causes,
)
from culprit.plans import retail, supply
from culprit.plans.suite import project, run_suite
from culprit.plans.triage import triage
from culprit.schemas import EVIDENCE_DEFAULTS, EVIDENCE_FIELDS
from culprit.session import scratch_path
from culprit.sources import artifacts, jsonl, store
from culprit.sources.tables import materialise, seed_csv
from culprit.streaming.fact_stream import feed_facts, start_fact_stream
from culprit.streaming.triage_stream import triage_stream, write_artifacts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__.removeprefix("q_")] = function
    return function


# --- artifacts -------------------------------------------------------------------------


@query
def q_failing_tests(spark: SparkSession, folder: str) -> DataFrame:
    found = artifacts.failing_tests(artifacts.documents_of(*fx.artifacts(spark, folder)))
    return found.withColumnRenamed("column", "column_name").drop("position")


@query
def q_run_totals(spark: SparkSession, folder: str) -> DataFrame:
    return artifacts.run_totals(artifacts.documents_of(*fx.artifacts(spark, folder)))


def _named_lines(spark: SparkSession, folder: str) -> DataFrame:
    """A generated test name for every (supplier, return flag) of the order lines."""
    lines = fx.read(spark, folder, "lineitem")
    model = F.concat(F.lit("stg_"), F.col("l_suppkey").cast("string"))
    kind = (
        F.when(F.col("l_returnflag") == "A", "not_null")
        .when(F.col("l_returnflag") == "N", "relationships")
        .otherwise("custom")
    )
    rest = F.when(F.col("l_returnflag") == "N", "order_ref__key__ref_orders_").otherwise("order_ref")
    return lines.groupBy("l_suppkey", "l_returnflag").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.first(F.concat_ws("_", kind, model, rest)).alias("test_name"),
        F.first(F.array(F.lit("stg"), model)).alias("ref_models"),
    )


@query
def q_test_name_parse(spark: SparkSession, folder: str) -> DataFrame:
    named = _named_lines(spark, folder).withColumn(
        "kind", artifacts.test_kind(F.col("test_name"))
    )
    kinds = F.when(F.col("kind") != "unknown", F.array("kind")).otherwise(
        F.array().cast("array<string>")
    )
    owner = artifacts.parse_test_name(F.col("test_name"), F.col("ref_models"), kinds)
    return named.withColumn("owner", owner).select(
        "test_name",
        "kind",
        F.col("owner.model").alias("model"),
        F.col("owner.column").alias("column_name"),
        "n_lines",
    )


@query
def q_test_kind(spark: SparkSession, folder: str) -> DataFrame:
    events = fx.read(spark, folder, "events")
    name = (
        F.when(F.col("event_type") == "click", "not_null_a_b")
        .when(F.col("event_type") == "view", "unique_a_b")
        .when(F.col("event_type") == "purchase", "accepted_values_a_b__x")
        .when(F.col("event_type") == "signup", "relationships_a_b__c__ref_d_")
        .otherwise("check_a_b")
    )
    kinds = events.select(artifacts.test_kind(name).alias("kind"), "value")
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n_tests"))


@query
def q_manifest_nodes(spark: SparkSession, folder: str) -> DataFrame:
    _, manifests = fx.artifacts(spark, folder)
    return artifacts.manifest_nodes(manifests).withColumnRenamed("schema", "schema_name")


@query
def q_resolve_relation(spark: SparkSession, folder: str) -> DataFrame:
    _, manifests = fx.artifacts(spark, folder)
    nodes = artifacts.manifest_nodes(manifests)
    pairs = (("MAIN_staging", "STG_lines"), ("main_marts", "orders_settled"),
             (None, "feed_lines"), ("main", "absent"))
    asked = F.array(
        *[
            F.struct(F.lit(s).cast("string").alias("ref_schema"), F.lit(t).alias("ref_table"))
            for s, t in pairs
        ]
    )
    references = manifests.select("run_id", F.inline(asked))
    return artifacts.resolve_relation(references, nodes)


@query
def q_choose_test(spark: SparkSession, folder: str) -> DataFrame:
    failing = artifacts.failing_tests(artifacts.documents_of(*fx.artifacts(spark, folder)))
    chosen = choose_test(failing, ["run_id"])
    return chosen.select("run_id", "test_name", "model")


@query
def q_choose_named_test(spark: SparkSession, folder: str) -> DataFrame:
    failing = artifacts.failing_tests(artifacts.documents_of(*fx.artifacts(spark, folder)))
    chosen = choose_test(failing, ["run_id"], "unique_stg")
    return chosen.select("run_id", "test_name", "model")


@query
def q_choose_exact_test(spark: SparkSession, folder: str) -> DataFrame:
    """The longer name sorts first, the exact one is chosen; no such test, no row."""
    failing = artifacts.failing_tests(artifacts.documents_of(*fx.artifacts(spark, folder)))
    name = "unique_stg_lines_line_key"
    longer = failing.filter(F.col("test_name") == name).select(
        *[F.concat(F.col(c), F.lit("_a")).alias(c) if c == "test_name"
          else F.lit("a").alias(c) if c == "model" else c for c in failing.columns]
    )
    both = failing.unionByName(longer)
    exact = choose_test(both, ["run_id"], name, strict=True).withColumn("asked", F.lit("exact"))
    absent = choose_test(both, ["run_id"], "no_such_test", strict=True).withColumn(
        "asked", F.lit("absent")
    )
    return exact.unionByName(absent).select("asked", "run_id", "test_name", "model")


# --- failing keys ----------------------------------------------------------------------


def _failing_keys(spark: SparkSession, folder: str, pattern: str, test: str) -> DataFrame:
    raw, _ = fx.one_fault(spark, folder, pattern)
    spec = next(t for t in retail.TESTS if t.name.startswith(test))
    keys = datatests.failing_keys(retail.staging(raw), spec, retail.PK_MAP[spec.model])
    return keys.select("test_name", "pk")


@query
def q_failing_pks_not_null(spark: SparkSession, folder: str) -> DataFrame:
    return _failing_keys(
        spark, folder, "null_spike.heavy_30pct", "not_null_stg_orders_customer_id"
    )


@query
def q_failing_pks_unique(spark: SparkSession, folder: str) -> DataFrame:
    return _failing_keys(
        spark, folder, "duplicate_ingestion.heavy_5pct", "unique_stg_orders_order_id"
    )


@query
def q_failing_pks_relationships(spark: SparkSession, folder: str) -> DataFrame:
    return _failing_keys(
        spark, folder, "broken_join_dropout.heavy_5pct", "relationships_stg_orders_customer_id"
    )


@query
def q_failing_pks_stored(spark: SparkSession, folder: str) -> DataFrame:
    """Keys behind failures tables that were written out and read back, one per shape."""
    raw, _ = fx.one_fault(spark, folder, "broken_join_dropout.heavy_5pct")
    models = retail.staging(raw)
    kinds = ("unique_stg_payments", "relationships_stg_orders", "accepted_values_stg_orders")
    tests = [t for t in retail.TESTS if t.name.startswith(kinds)]
    places = datatests.store_failures(models, tests, scratch_path(spark, "failures"))
    parts = [
        datatests.keys_from_failures(
            spark.read.parquet(places[t.name]), models[t.model], retail.PK_MAP[t.model], t.column
        ).select(F.lit(t.name).alias("test_name"), "pk")
        for t in tests
    ]
    return reduce(DataFrame.unionByName, parts)


# --- data tests ------------------------------------------------------------------------


@query
def q_test_not_null(spark: SparkSession, folder: str) -> DataFrame:
    failed = datatests.not_null_failures(fx.feed_lines(spark, folder), "order_ref")
    return failed.select("feed_id", "line_key", "ship_ts")


@query
def q_test_unique(spark: SparkSession, folder: str) -> DataFrame:
    payments = retail.staging(retail.sources(spark, folder))["stg_payments"]
    return datatests.unique_failures(payments, "payment_id")


@query
def q_test_relationships(spark: SparkSession, folder: str) -> DataFrame:
    documents = fx.read(spark, folder, "documents")
    labels = fx.read(spark, folder, "labels")
    return datatests.relationship_failures(documents, "doc_id", labels, "doc_id")


@query
def q_test_accepted_values(spark: SparkSession, folder: str) -> DataFrame:
    orders = retail.staging(retail.sources(spark, folder))["stg_orders"]
    return datatests.accepted_values_failures(orders, "status", ("F", "O"))


@query
def q_test_suite_results(spark: SparkSession, folder: str) -> DataFrame:
    return datatests.run_tests(retail.models(retail.sources(spark, folder)), retail.TESTS)


# --- models ----------------------------------------------------------------------------


@query
def q_stg_customers(spark: SparkSession, folder: str) -> DataFrame:
    return retail.models(retail.sources(spark, folder))["stg_customers"]


@query
def q_stg_orders(spark: SparkSession, folder: str) -> DataFrame:
    return retail.models(retail.sources(spark, folder))["stg_orders"]


@query
def q_stg_payments(spark: SparkSession, folder: str) -> DataFrame:
    return fx.rounded(retail.models(retail.sources(spark, folder))["stg_payments"], 4)


@query
def q_mart_orders(spark: SparkSession, folder: str) -> DataFrame:
    return fx.rounded(retail.models(retail.sources(spark, folder))["orders"], 4)


@query
def q_mart_customers(spark: SparkSession, folder: str) -> DataFrame:
    return fx.rounded(retail.models(retail.sources(spark, folder))["customers"], 4)


@query
def q_seed_csv(spark: SparkSession, folder: str) -> DataFrame:
    """The suppliers written as a seed file and read back with their schema."""
    path = scratch_path(spark, "seed")
    suppliers = fx.read(spark, folder, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    suppliers.write.csv(path, header=True)
    return seed_csv(spark, path, suppliers.schema)


@query
def q_materialised_layers(spark: SparkSession, folder: str) -> DataFrame:
    """A staging model as a view, and the mart over it as a table."""
    models = retail.models(retail.sources(spark, folder))
    name = f"culprit_{uuid.uuid4().hex}"
    materialise(models["stg_customers"], "staging", f"{name}_stg")
    materialise(models["customers"], "marts", name)
    mart, view = spark.table(name), spark.table(f"{name}_stg")
    return view.join(mart.select("customer_id", "number_of_orders"), "customer_id")


# --- probes ----------------------------------------------------------------------------

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query
def q_probe_row_count(spark: SparkSession, folder: str) -> DataFrame:
    counts = [
        probes.row_count(fx.read(spark, folder, t)).withColumn("table_name", F.lit(t))
        for t in TABLES
    ]
    return reduce(DataFrame.unionByName, counts)


def _typed_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Column types with the number of filled rows behind each, one scan per table."""
    parts = []
    for table in TABLES:
        df = fx.read(spark, folder, table)
        types = probes.column_dtypes(df, table)
        filled = df.agg(*[F.count(c).alias(c) for _, c, _ in types])
        rows = F.array(
            *[
                F.struct(
                    F.lit(t).alias("table_name"), F.lit(c).alias("column_name"),
                    F.lit(d).alias("dtype"), F.col(c).alias("filled_rows"),
                )
                for t, c, d in types
            ]
        )
        parts.append(filled.select(F.inline(rows)))
    return reduce(DataFrame.unionByName, parts)


@query
def q_probe_column_dtype(spark: SparkSession, folder: str) -> DataFrame:
    return _typed_columns(spark, folder).withColumn("dtype", norm_dtype(F.col("dtype")))


@query
def q_schema_mismatch(spark: SparkSession, folder: str) -> DataFrame:
    """Declared types, with every key expected as text, against the actual ones."""
    actual = _typed_columns(spark, folder)
    is_key = F.col("column_name").endswith("key")
    expected = actual.select(
        "table_name", "column_name", F.when(is_key, "varchar").otherwise(F.col("dtype")).alias("dtype")
    )
    return schema_mismatch(actual, expected).select(
        "table_name", "column_name", "dtype_mismatch", "filled_rows"
    )


@query
def q_probe_column_stats(spark: SparkSession, folder: str) -> DataFrame:
    lines = probes.profile_columns(
        fx.feed_lines(spark, folder), ["line_key", "order_ref"], "feed_lines"
    )
    documents = probes.profile_columns(
        fx.read(spark, folder, "documents"), ["doc_id", "text", "lang", "source"], "documents"
    )
    both = lines.unionByName(documents).select(
        "table_name", "column_name", "row_count", "null_count", "distinct_count", "null_rate",
        "cardinality_ratio",
    )
    return fx.rounded(both)


@query
def q_probe_dupe_keys(spark: SparkSession, folder: str) -> DataFrame:
    return probes.dupe_keys(fx.read(spark, folder, "lineitem"), ["l_orderkey"])


@query
def q_probe_dupe_composite(spark: SparkSession, folder: str) -> DataFrame:
    return probes.dupe_keys(fx.read(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query
def q_dupe_extra_rows(spark: SparkSession, folder: str) -> DataFrame:
    keys = {"lineitem": ["l_orderkey", "l_linenumber"], "documents": ["text"],
            "orders": ["o_orderkey"]}
    parts = [
        probes.dupe_extra_rows(fx.read(spark, folder, t), k).withColumn("table_name", F.lit(t))
        for t, k in keys.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@query
def q_probe_freshness(spark: SparkSession, folder: str) -> DataFrame:
    events = fx.read(spark, folder, "events")
    found = probes.freshness(events, "ts", fx.EVENTS_OBSERVED_AT, by=["event_type"])
    return fx.rounded(found)


@query
def q_lag_ratio(spark: SparkSession, folder: str) -> DataFrame:
    return fx.rounded(fx.line_evidence(spark, folder).select("feed_id", "blame_lag_ratio"))


@query
def q_probe_dtype_distribution(spark: SparkSession, folder: str) -> DataFrame:
    profile = probes.profile_columns(
        fx.feed_events(spark, folder), ["code"], "feed_events", by=["user_id"]
    )
    return fx.rounded(profile.select("user_id", "int_ratio", "float_ratio"))


@query
def q_probe_numeric_moments(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"]
    profile = probes.profile_columns(
        fx.read(spark, folder, "lineitem"), columns, "lineitem", wanted=["mean", "stddev"]
    )
    return fx.rounded(profile.select("column_name", "mean", "stddev"), 4)


@query
def q_probe_skew(spark: SparkSession, folder: str) -> DataFrame:
    profile = probes.profile_columns(
        fx.read(spark, folder, "events"), ["value", "event_type"], "events", by=["user_id"]
    )
    return fx.rounded(profile.select("user_id", "column_name", "skew"))


# --- evidence --------------------------------------------------------------------------


@query
def q_evidence(spark: SparkSession, folder: str) -> DataFrame:
    fields = [f for f in EVIDENCE_FIELDS if f != "parent_row_count"]
    return fx.rounded(
        fx.line_evidence(spark, folder).select("feed_id", *fields, "parent_row_count")
    )


@query
def q_evidence_events(spark: SparkSession, folder: str) -> DataFrame:
    return fx.rounded(
        fx.event_evidence(spark, folder).select("user_id", "target", *EVIDENCE_DEFAULTS)
    )


FLEET = (
    Target("payments_key", "unique", "stg_payments", "payment_id", "raw_payments", "payment_key",
           "payment_key"),
    Target("payments_order", "relationships", "stg_payments", "order_id", "raw_payments",
           "l_orderkey", "payment_key", "raw_orders", "o_orderkey"),
    Target("orders_customer", "relationships", "stg_orders", "customer_id", "raw_orders",
           "o_custkey", "o_orderkey", "raw_customers", "c_custkey"),
    Target("documents_label", "relationships", "stg_documents", "doc_id", "documents", "doc_id",
           "doc_id", "labels", "doc_id"),
    Target("documents_text", "unique", "stg_documents", "text", "documents", "text", "text"),
    Target("documents_gone", "not_null", "stg_documents", "gone", "documents", "gone", "doc_id"),
    Target("table_gone", "relationships", "stg_gone", "key", "gone", "key", "key", "labels", "doc_id"),
    Target("back\\slash's", "not_null", "stg_gone", "key", "gone", "key", "key"),
)


@query
def q_evidence_fleet(spark: SparkSession, folder: str) -> DataFrame:
    """Six incidents over five whole tables, and two over a table that is not there."""
    tables = retail.sources(spark, folder)
    tables |= {t: fx.read(spark, folder, t) for t in ("documents", "labels")}
    found = assemble_evidence(FLEET, tables)
    return fx.rounded(
        found.select(
            F.col("target").alias("incident"), "blame_row_count", "blame_null_rate",
            "blame_cardinality_ratio", "blame_pk_dupe_count", "blame_join_fanout_risk",
            "orphan_fk_count", F.coalesce("parent_row_count", F.lit(-1)).alias("parent_row_count"),
        )
    )


@query
def q_fanout_risk(spark: SparkSession, folder: str) -> DataFrame:
    return fx.line_evidence(spark, folder).select(
        "feed_id", "blame_pk_dupe_count", "blame_join_fanout_risk"
    )


@query
def q_lag_ratio_sla(spark: SparkSession, folder: str) -> DataFrame:
    """Lag against an SLA table: lines may be as many minutes old as there are orders."""
    minutes = F.count(F.lit(1)).cast("double").alias("sla_minutes")
    slas = fx.read(spark, folder, "orders").agg(minutes).withColumn("blame_model", F.lit("feed_lines"))
    found = assemble_evidence(
        [fx.LINE_TARGET], fx.line_tables(spark, folder), by=["feed_id"],
        observed_at=fx.OBSERVED_AT, slas=slas,
    )
    return fx.rounded(found.select("feed_id", "blame_lag_ratio"))


@query
def q_first_temporal(spark: SparkSession, folder: str) -> DataFrame:
    """The column that tells how fresh each table is, with its filled rows."""
    parts = []
    for table in TABLES:
        df = fx.read(spark, folder, table)
        column = first_temporal(df.schema)
        if column is not None:
            parts.append(
                df.agg(F.count(column).alias("filled_rows")).select(
                    F.lit(table).alias("table_name"), F.lit(column).alias("column_name"), "filled_rows"
                )
            )
    return reduce(DataFrame.unionByName, parts)


@query
def q_value_drift_z(spark: SparkSession, folder: str) -> DataFrame:
    found = fx.event_evidence(spark, folder).filter("target = 'value'")
    return fx.rounded(found.select("user_id", "blame_value_drift_z"))


@query
def q_orphan_fk_count(spark: SparkSession, folder: str) -> DataFrame:
    """Plain parent, null-holding parent under NOT IN, and the same with nulls ignored."""
    child = fx.read(spark, folder, "documents")
    parent = fx.read(spark, folder, "labels")
    holed = parent.select(F.when(F.col("quality") == 1, F.col("doc_id")).alias("doc_id"))
    cases = {
        "plain": probes.orphan_count(child, "doc_id", parent, "doc_id"),
        "null_parent": probes.orphan_count(child, "doc_id", holed, "doc_id"),
        "nulls_ignored": probes.orphan_count(
            child, "doc_id", holed, "doc_id", ignore_null_parents=True
        ),
    }
    parts = [df.withColumn("variant", F.lit(name)) for name, df in cases.items()]
    return reduce(DataFrame.unionByName, parts)


@query
def q_stale_dimension(spark: SparkSession, folder: str) -> DataFrame:
    return fx.line_evidence(spark, folder).select("feed_id", "blame_stale_dimension")


@query
def q_evidence_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence hashed with its rates as fixed-point numbers."""
    found = fx.line_evidence(spark, folder)
    fixed = {n: F.col(n).cast("decimal(18,6)") for n, t in found.dtypes if t == "double"}
    return found.withColumns(fixed).select("feed_id", fingerprint().alias("fingerprint"))


# --- lineage ---------------------------------------------------------------------------


def _suspects(spark: SparkSession, folder: str) -> DataFrame:
    """Every order points at one mart column, by its priority."""
    orders = fx.read(spark, folder, "orders")
    priority = F.substring("o_orderpriority", 1, 1)
    spots = {
        "1": ("orders", "customer_id"), "2": ("orders", "amount"),
        "3": ("customers", "customer_lifetime_value"), "4": ("stg_customers", "customer_id"),
        "5": ("raw_orders", "o_custkey"),
    }
    model: Column = F.lit("unknown_model")
    column: Column = F.lit("any")
    for digit, (m, c) in spots.items():
        model = F.when(priority == digit, m).otherwise(model)
        column = F.when(priority == digit, c).otherwise(column)
    return orders.select(model.alias("model"), column.alias("column"), "o_orderkey")


def _counted_suspects(spark: SparkSession, folder: str) -> DataFrame:
    found = _suspects(spark, folder)
    return found.groupBy("model", "column").agg(F.count(F.lit(1)).alias("n_rows"))


@query
def q_lineage_walk(spark: SparkSession, folder: str) -> DataFrame:
    starts = _counted_suspects(spark, folder)
    walks = lineage.walk_lineage(starts, retail.edges(spark), retail.nodes(spark))
    path = F.array_join(
        F.transform(
            "walk_path",
            lambda s: F.concat(
                s["upstream_model"], F.lit("."), s["upstream_column"], F.lit(":"),
                s["transform_type"],
            ),
        ),
        ">",
    )
    met = walks.join(starts, ["model", "column"])
    return met.select(
        "model", F.col("column").alias("column_name"), "blame_model", "blame_column", "certainty",
        "hit_agg_boundary", "hops", path.alias("path"), "n_rows",
    )


@query
def q_row_carry(spark: SparkSession, folder: str) -> DataFrame:
    """Suspect rows of the marts carried up through groups, joins and windows."""
    raw = retail.sources(spark, folder)
    tables = {**raw, **retail.models(raw)}
    tables["order_ranks"] = retail.order_ranks(tables["stg_orders"])
    suspects = [
        ("customers", "first_order", tables["customers"].filter("number_of_orders >= 20")),
        ("customers", "customer_name", tables["customers"].filter("number_of_orders >= 20")),
        ("orders", "customer_id", tables["orders"].filter("order_id % 50 = 0")),
        ("orders", "amount", tables["orders"].filter("order_id % 400 = 1")),
        ("order_ranks", "order_rank", tables["order_ranks"].filter("order_rank = 15")),
    ]
    found = []
    for model, column, rows in suspects:
        keys = rows.select(text_key(retail.PK_MAP[model]).alias("pk"))
        ends = carry.carry_rows(tables, retail.CARRY_EDGES, retail.PK_MAP, model, column, keys)
        named = carry.carried(ends).withColumns({"model": F.lit(model), "column_name": F.lit(column)})
        found.append(named)
    return fx.rounded(reduce(DataFrame.unionByName, found))


@query
def q_lineage_hop(spark: SparkSession, folder: str) -> DataFrame:
    starts = _counted_suspects(spark, folder)
    step = lineage.hops(retail.edges(spark), retail.nodes(spark))
    met = starts.join(
        step, (F.col("model") == F.col("downstream_model"))
        & (F.col("column") == F.col("downstream_column")),
    )
    return met.select(
        "downstream_model", "downstream_column", "upstream_model", "upstream_column",
        "transform_type", "n_rows",
    )


@query
def q_edge_transform(spark: SparkSession, folder: str) -> DataFrame:
    """Tag precedence over flags taken from every order line."""
    flags = fx.read(spark, folder, "lineitem").select(
        (F.col("l_returnflag") == "R").alias("has_agg"),
        (F.col("l_linestatus") == "F").alias("has_window"),
        (F.col("l_linenumber") > 4).alias("has_cast"),
    )
    tagged = flags.select(lineage.transform_tag().alias("transform_type"))
    return tagged.groupBy("transform_type").agg(F.count(F.lit(1)).alias("n_edges"))


@query
def q_key_column(spark: SparkSession, folder: str) -> DataFrame:
    """The key column that each suspect's model is looked up by."""
    found = _suspects(spark, folder).withColumn(
        "key_column", lineage.key_column(F.col("model"), retail.PK_MAP)
    )
    return found.groupBy("model", "key_column").agg(F.count(F.lit(1)).alias("n_rows"))


@query
def q_blame_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of the suspects, carried upstream unless an aggregation was crossed."""
    suspects = _suspects(spark, folder).select(
        "model", "column", text_key("o_orderkey").alias("pk")
    )
    walks = lineage.walk_lineage(suspects, retail.edges(spark), retail.nodes(spark))
    kept = lineage.carry_keys(suspects, walks, ["model", "column"])
    met = kept.join(walks.select("model", "column", "blame_model", "blame_column"),
                    ["model", "column"])
    return met.select("model", F.col("column").alias("column_name"), "blame_model",
                      "blame_column", "pk")


@query
def q_blame_rows_first(spark: SparkSession, folder: str) -> DataFrame:
    """The first 20 keys per place in display order (a report)."""
    suspects = _suspects(spark, folder).select("model", text_key("o_orderkey").alias("pk"))
    return lineage.first_keys(suspects, ["model"], 20)


@query
def q_verify_rows(spark: SparkSession, folder: str) -> DataFrame:
    raw, _ = fx.one_fault(spark, folder, "broken_join_dropout.heavy_5pct")
    keys = raw["raw_orders"].select(text_key("o_custkey").alias("pk"))
    return lineage.verify_rows(raw["raw_customers"], "c_custkey", keys)


@query
def q_keyed_attribution(spark: SparkSession, folder: str) -> DataFrame:
    raw, truth = fx.one_fault(spark, folder, "null_spike.flat_5pct")
    tables = {**raw, **retail.models(raw)}
    same = lineage.keyed_attribution(
        tables, retail.KEYED_EDGES, "orders", "customer_id", "order_id", truth.select("pk")
    )
    other = lineage.keyed_attribution(
        tables, retail.KEYED_EDGES, "orders", "customer_id", "row_id", truth.select("pk")
    )
    return same.unionByName(other)


@query
def q_parent_walk(spark: SparkSession, folder: str) -> DataFrame:
    """Where the parents of the relationship tests come from, with the rows at stake."""
    models = retail.models(retail.sources(spark, folder))
    links = [t for t in retail.TESTS if t.kind == "relationships"]
    parts = [
        probes.row_count(models[t.model]).select(
            F.lit(t.name).alias("test_name"), F.lit(t.parent_model).alias("model"),
            F.lit(t.parent_column).alias("column"), F.col("row_count").alias("n_rows"),
        )
        for t in links
    ]
    starts = reduce(DataFrame.unionByName, parts)
    walks = lineage.walk_lineage(starts, retail.edges(spark), retail.nodes(spark))
    return starts.join(walks, ["model", "column"]).select(
        "test_name", F.col("blame_model").alias("parent_table"),
        F.col("blame_column").alias("parent_pk_column"), "n_rows",
    )


# --- detectors -------------------------------------------------------------------------


def _detect(detector: Detector) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        hit = fx.both_fleets(spark, folder).withColumn("hit", detector())
        return fx.rounded(
            hit.filter(F.col("hit").isNotNull()).select(
                "incident", F.col("hit.cause_class").alias("cause_class"),
                F.col("hit.score").alias("score"),
                F.array_join("hit.evidence_keys", ",").alias("evidence_keys"),
            )
        )

    return run


DETECTOR_KEYS = (
    "detect_null_spike", "detect_duplicate", "detect_dropout", "detect_late",
    "detect_type_coercion", "detect_schema_change", "detect_fanout", "detect_unit_drift",
    "detect_stale_dim", "detect_skew",
)
for _key, _detector in zip(DETECTOR_KEYS, DETECTORS):
    QUERIES[_key] = _detect(_detector)


@query
def q_classify_rank(spark: SparkSession, folder: str) -> DataFrame:
    return fx.rounded(ranked_causes(classify(fx.both_fleets(spark, folder)), ["incident"]))


@query
def q_classify_uncertain(spark: SparkSession, folder: str) -> DataFrame:
    return classify(fx.both_fleets(spark, folder)).select("incident", "is_uncertain")


@query
def q_verdict(spark: SparkSession, folder: str) -> DataFrame:
    scored = classify(fx.both_fleets(spark, folder))
    return scored.select("incident", verdict(F.col("class_scores")).alias("verdict_type"))


def _labelled_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Top scores of the line fleet; the supplier's nation stands in for a reviewer."""
    top = F.get("class_scores", F.lit(0))["score"]
    scored = classify(fx.line_evidence(spark, folder)).select(
        "feed_id", F.round(top, 2).alias("score")
    )
    supplier = fx.read(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("feed_id"), (F.col("s_nationkey") < 12).alias("correct")
    )
    return scored.join(supplier, "feed_id")


@query
def q_calibration_fit(spark: SparkSession, folder: str) -> DataFrame:
    """The fitted level of every distinct score."""
    pairs = _labelled_scores(spark, folder)
    model = calibration.fit_calibration(pairs)
    groups = calibration.score_groups(pairs)
    fitted = calibration.apply_calibration(groups, model)
    return fx.rounded(fitted.select("score", "weight", "label", "calibrated"))


@query
def q_calibration_apply(spark: SparkSession, folder: str) -> DataFrame:
    pairs = _labelled_scores(spark, folder)
    model = calibration.fit_calibration(pairs)
    return fx.rounded(
        calibration.apply_calibration(pairs, model).select("feed_id", "score", "calibrated")
    )


@query
def q_calibration_heldout(spark: SparkSession, folder: str) -> DataFrame:
    """Curves for both fleets' scores, chosen and scored on feeds and users they did not see.

    The reviewer is a hash of the incident that agrees less often than the score says.
    """
    top = F.get("class_scores", F.lit(0))["score"]
    scored = classify(fx.both_fleets(spark, folder)).select("incident", F.round(top, 2).alias("score"))
    luck = F.conv(
        F.substring(F.md5(F.concat(F.col("incident"), F.lit("#label"))), 1, 8), 16, 10
    ).cast("double") / F.lit(2.0**32)
    pairs = scored.withColumn("correct", luck < F.col("score") * F.col("score"))
    owner = F.substring_index("incident", "/", 2)
    return fx.rounded(calibration.held_out(pairs, owner))


# --- incidents -------------------------------------------------------------------------


def _flat(incidents: DataFrame) -> DataFrame:
    """Incident records with nested parts as text columns."""
    guess = F.get("hypotheses", F.lit(0))
    flat = incidents.select(
        "incident_id", "created_at", "failing_test_name", "failing_model", "failing_column",
        "failing_row_count", F.col("blame_location.model").alias("blame_model"),
        F.col("blame_location.column").alias("blame_column"),
        F.col("blame_location.certainty").alias("blame_certainty"),
        F.size("blame_location.walk_path").alias("hops"),
        F.array_join(F.transform("class_scores", lambda s: s["cause_class"]), ">").alias("causes"),
        guess["cause_class"].alias("top_class"), guess["confidence"].alias("confidence"),
        guess["evidence_summary"].alias("evidence_summary"),
        guess["suggested_one_line_fix"].alias("suggested_fix"), "verdict_type",
        F.coalesce("final_verdict.cause_class", F.lit("none")).alias("final_class"),
    )
    return fx.wall_clock(fx.rounded(flat))


@query
def q_incidents(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(fx.line_incidents(spark, folder))


@query
def q_evidence_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(fx.line_incidents(spark, folder)).select("incident_id", "evidence_summary")


@query
def q_suggested_fix(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(fx.line_incidents(spark, folder)).select("incident_id", "suggested_fix")


ROW_FIELDS = (
    "incident_id", "created_at", "failing_test_name", "failing_model", "failing_column",
    "failing_row_count", "blame_model", "blame_column", "blame_certainty",
    "blame_hit_agg_boundary", "verdict_type", "final_cause_class", "time_to_verdict_s",
    "token_cost_usd",
)


def _rows(rows: DataFrame) -> DataFrame:
    return fx.wall_clock(fx.rounded(rows)).select(
        *ROW_FIELDS,
        F.coalesce("confidence", F.lit(-1.0)).alias("confidence"),
        F.coalesce("human_label", F.lit("none")).alias("human_label"),
    )


@query
def q_incident_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(incident_rows(fx.line_incidents(spark, folder)))


@query
def q_incident_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Records that come back from their payload unchanged."""
    rows = incident_rows(fx.line_incidents(spark, folder))
    back = from_payload(rows)
    return _flat(back)


def _revised(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Stored rows, and a batch that revises the uncertain ones and brings copies as new."""
    rows = incident_rows(fx.line_incidents(spark, folder))
    redone = rows.filter("verdict_type <> 'auto'").withColumn("failing_row_count", F.lit(0).cast("bigint"))
    fresh = rows.filter("verdict_type = 'auto'").withColumn(
        "incident_id", F.concat("incident_id", F.lit("_b"))
    )
    return rows, redone.unionByName(fresh)


@query
def q_incident_upsert(spark: SparkSession, folder: str) -> DataFrame:
    rows, batch = _revised(spark, folder)
    return _rows(store.upsert(rows, batch, "incident_id"))


@query
def q_incident_by_id(spark: SparkSession, folder: str) -> DataFrame:
    """The incident of the feed with the most orphans, looked up by its id."""
    rows = incident_rows(fx.line_incidents(spark, folder))
    wanted = rows.agg(
        F.max_by("incident_id", F.struct("failing_row_count", "incident_id"))
    ).scalar()
    return _rows(store.by_id(rows, "incident_id", wanted))


@query
def q_incident_list(spark: SparkSession, folder: str) -> DataFrame:
    """All two-candidate incidents, the newest first."""
    rows = incident_rows(fx.line_incidents(spark, folder))
    return _rows(store.listing(rows, verdict_type="two_candidate"))


@query
def q_incident_delete(spark: SparkSession, folder: str) -> DataFrame:
    rows = incident_rows(fx.line_incidents(spark, folder))
    gone = rows.filter("verdict_type = 'triage_only' or failing_row_count > 3")
    return _rows(store.delete(rows, gone, "incident_id"))


@query
def q_label_update(spark: SparkSession, folder: str) -> DataFrame:
    """Labels for all automatic verdicts; row and payload must agree."""
    rows = incident_rows(fx.line_incidents(spark, folder))
    labels = rows.filter("verdict_type = 'auto'").select(
        "incident_id", F.col("final_cause_class").alias("human_label")
    )
    changed = store.set_labels(rows, labels)
    inside = F.get_json_object("payload", "$.human_label")
    return changed.select(
        "incident_id", F.coalesce("human_label", F.lit("none")).alias("human_label"),
        F.coalesce(inside, F.lit("none")).alias("payload_label"),
    )


@query
def q_incident_store_lifecycle(spark: SparkSession, folder: str) -> DataFrame:
    """Saved, labelled, triaged again, deleted, saved again, replayed, compacted."""
    kept = store.IncidentStore(spark, scratch_path(spark, "lifecycle"))
    kept.save(fx.line_incidents(spark, folder), batch="stream#0")
    first = kept.current()
    kept.label_rows(
        first.filter("verdict_type <> 'triage_only'").select(
            "incident_id", F.col("final_cause_class").alias("human_label")
        )
    )
    again = first.filter("failing_row_count % 2 = 1")
    kept.save_rows(again.withColumn("token_cost_usd", F.lit(0.5)), batch="stream#1")
    kept.compact()
    kept.delete_rows(first.filter("failing_row_count % 3 = 0").select("incident_id"))
    kept.save_rows(first.filter("failing_row_count % 6 = 0"))
    kept.save_rows(first, batch="stream#0")
    return _rows(kept.current())


@query
def q_ground_truth_upsert(spark: SparkSession, folder: str) -> DataFrame:
    run = fx.suite(spark, folder)
    counted = _truth_counts(run)
    revised = counted.filter("cause_class = 'upstream_null_spike'").withColumn(
        "notes", F.lit("checked")
    )
    return store.upsert(counted, revised, "incident_key")


@query
def q_incident_summary(spark: SparkSession, folder: str) -> DataFrame:
    return fx.wall_clock(incident_summary(fx.line_incidents(spark, folder)))


@query
def q_incidents_by_place(spark: SparkSession, folder: str) -> DataFrame:
    return fx.wall_clock(incidents_by_place(fx.line_incidents(spark, folder)))


@query
def q_narrative(spark: SparkSession, folder: str) -> DataFrame:
    return narrate(fx.line_incidents(spark, folder)).select(
        "incident_id", "headline", "narrative", "one_line_fix"
    )


@query
def q_message_payload(spark: SparkSession, folder: str) -> DataFrame:
    return narrate(fx.line_incidents(spark, folder)).select(
        "incident_id", "chat_blocks", "review_body"
    )


# --- repairs ---------------------------------------------------------------------------


@query
def q_repair_nulls(spark: SparkSession, folder: str) -> DataFrame:
    lines = fx.feed_lines(spark, folder)
    dropped = repair.repair_nulls(lines, "order_ref").withColumn("mode", F.lit("drop"))
    filled = repair.repair_nulls(lines, "order_ref", -1).withColumn("mode", F.lit("fill"))
    return dropped.unionByName(filled).groupBy("mode", "feed_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("order_ref").alias("least_ref")
    )


@query
def q_repair_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """The most expensive line survives."""
    lines = fx.read(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"
    )
    return repair.repair_duplicates(
        lines, ["l_orderkey", "l_linenumber"], [("l_extendedprice", False)]
    )


@query
def q_repair_duplicates_nulls(spark: SparkSession, folder: str) -> DataFrame:
    """Of each feed's lines per order date the one with the latest text; nulls lose."""
    lines = fx.feed_lines(spark, folder).select(
        "feed_id", "ship_ts", F.col("order_ref").cast("string").alias("order_text"), "line_key"
    )
    return repair.repair_duplicates(
        lines, ["feed_id", "ship_ts"], [("order_text", False), ("line_key", True)]
    )


@query
def q_repair_orphans(spark: SparkSession, folder: str) -> DataFrame:
    lines = fx.feed_lines(spark, folder)
    parents = fx.settled_orders(spark, folder)
    kept = repair.repair_orphans(lines, "order_ref", parents, "o_orderkey")
    moved = repair.repair_orphans(lines, "order_ref", parents, "o_orderkey", fallback=-1)
    both = kept.withColumn("mode", F.lit("drop")).unionByName(
        moved.withColumn("mode", F.lit("fallback"))
    )
    return both.groupBy("mode", "feed_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("order_ref") == -1).alias("n_fallback"),
    )


# --- faults ----------------------------------------------------------------------------


def _fault(pattern: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        raw, _ = fx.one_fault(spark, folder, pattern)
        family = pattern.split(".")[0]
        return raw[retail.TARGETS[family].table]

    return run


FAULT_KEYS = {
    "fault_null_flat": "null_spike.flat_5pct",
    "fault_null_heavy": "null_spike.heavy_30pct",
    "fault_null_conditional": "null_spike.conditional_status_returned",
    "fault_dupe_flat": "duplicate_ingestion.flat_1pct",
    "fault_dupe_heavy": "duplicate_ingestion.heavy_5pct",
    "fault_dupe_tail": "duplicate_ingestion.burst_recent_10pct",
    "fault_drop_flat": "broken_join_dropout.flat_1pct",
    "fault_drop_heavy": "broken_join_dropout.heavy_5pct",
    "fault_drop_tail": "broken_join_dropout.targeted_recent_5pct",
}
for _key, _pattern in FAULT_KEYS.items():
    QUERIES[_key] = _fault(_pattern)


@query
def q_fault_supply_targets(spark: SparkSession, folder: str) -> DataFrame:
    """The second target set: truth rows per trial over lines, orders and suppliers."""
    tables = {t: fx.read(spark, folder, t) for t in ("lineitem", "orders", "supplier")}
    parts = []
    for family, target in retail.SUPPLY_TARGETS.items():
        trials = trials_for("full", [family])
        _, truth = inject(tables, target, trials, "supply")
        parts.append(truth.groupBy("incident_key").agg(F.count_distinct("pk").alias("n_keys")))
    return reduce(DataFrame.unionByName, parts)


@query
def q_suite_supply(spark: SparkSession, folder: str) -> DataFrame:
    """The second target set triaged: where each trial's fault was found, and its rows."""
    run = run_suite(spark, supply.sources(spark, folder), "full", at=F.lit(fx.FAULTS_AT), models=supply)
    found = metrics.row_overlap(run.prediction_rows, run.truth_rows)
    said = run.predictions.select(
        "incident_key", F.get("candidate_tables", F.lit(0)).alias("blame_table"), "blame_column"
    )
    return run.truths.select("incident_key", "source_table", "source_column").join(said, "incident_key").join(
        found, "incident_key"
    )


@query
def q_trial_suite(spark: SparkSession, folder: str) -> DataFrame:
    """All 45 trials with the number of keys each one hits."""
    raw = retail.sources(spark, folder)
    used = raw["raw_orders"].filter("o_custkey is not null").select(
        F.col("o_custkey").alias("c_custkey")
    )
    status = F.col("o_orderstatus") == "P"
    pools = {
        "null_spike": raw["raw_orders"].withColumn("_eligible", status),
        "duplicate_ingestion": raw["raw_orders"].withColumn("_eligible", F.lit(True)),
        "broken_join_dropout": raw["raw_customers"].join(used, "c_custkey", "left_semi").withColumn(
            "_eligible", F.lit(True)
        ),
    }
    sizes = {}
    for family, pool in pools.items():
        trials = trials_for("full", [family])
        found = find_cuts(pool, retail.TARGETS[family].pk, trials, retail.DATASET)
        sizes |= {key: cut.n_chosen for key, cut in found.items()}
    known = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(n))])
    trials = trial_frame(spark, trials_for("full"), retail.DATASET)
    return trials.select(
        "incident_key", "family", "pattern_id", "seed", "cause_class",
        F.element_at(known, F.col("incident_key")).cast("bigint").alias("n_chosen"),
    )


@query
def q_incident_key(spark: SparkSession, folder: str) -> DataFrame:
    documents = fx.read(spark, folder, "documents")
    key = incident_key(F.col("source"), F.col("lang"), F.col("doc_id"))
    return documents.select("doc_id", key.alias("incident_key"))


def _truth_counts(run) -> DataFrame:
    counted = run.truth_rows.groupBy("incident_key").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min_by("pk", F.struct(F.length("pk"), "pk")).alias("first_pk"),
        F.max_by("pk", F.struct(F.length("pk"), "pk")).alias("last_pk"),
    )
    return run.truths.drop("injected_at").join(counted, "incident_key")


@query
def q_ground_truth(spark: SparkSession, folder: str) -> DataFrame:
    return _truth_counts(fx.suite(spark, folder))


@query
def q_ground_truth_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Labels and keys written as JSON lines and read back."""
    run = fx.suite(spark, folder)
    path = scratch_path(spark, "truths")
    jsonl.write_truths(run.truths, run.truth_rows, path)
    labels, rows = jsonl.read_truths(spark, path)
    counted = rows.groupBy("incident_key").agg(F.count(F.lit(1)).alias("n_rows"))
    return labels.drop("injected_at").join(counted, "incident_key")


@query
def q_stealth_faults(spark: SparkSession, folder: str) -> DataFrame:
    """Order dates carry no test, so nulling them goes unnoticed."""
    raw = retail.sources(spark, folder)
    trials = trials_for("full", [NULLS])
    tests = [t for t in retail.TESTS if t.model == "stg_orders" and t.kind == "not_null"]
    failing, all_trials = [], []
    for dataset, column in (("retail", "o_custkey"), ("retail_dates", "o_orderdate")):
        base = retail.TARGETS[NULLS]
        target = FaultTarget(base.table, column, base.pk, "", base.condition)
        faulted, _ = inject(raw, target, trials, dataset)
        models = retail.staging({**raw, target.table: faulted}, ["incident_key"])
        results = datatests.run_tests(models, tests, by=["incident_key"])
        failing.append(results.filter("status = 'fail'").select("incident_key"))
        all_trials.append(trial_frame(spark, trials, dataset))
    broke = failing[0].unionByName(failing[1]).distinct()
    return all_trials[0].unionByName(all_trials[1]).join(broke, "incident_key", "left_anti").select(
        "incident_key", "pattern_id", "seed"
    )


# --- scores ----------------------------------------------------------------------------


@query
def q_trial_diagnostics(spark: SparkSession, folder: str) -> DataFrame:
    return fx.suite(spark, folder).diagnostics()


@query
def q_suite_counters(spark: SparkSession, folder: str) -> DataFrame:
    return fx.suite(spark, folder).counters()


@query
def q_predictions(spark: SparkSession, folder: str) -> DataFrame:
    found = metrics.predictions_from_incidents(
        fx.line_incidents(spark, folder), F.col("incident_id")
    )
    flat = found.withColumn("candidate_tables", F.array_join("candidate_tables", ","))
    return fx.rounded(flat)


@query
def q_metric_pairs(spark: SparkSession, folder: str) -> DataFrame:
    pairs = fx.suite(spark, folder).pairs()
    flat = pairs.withColumn("candidate_tables", F.array_join("candidate_tables", ","))
    return fx.rounded(flat)


def _noisy_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Feeds as predictions: right or wrong by what the data says, so scores differ from 1."""
    top = F.get("class_scores", F.lit(0))
    said = classify(fx.line_evidence(spark, folder)).select(
        F.col("feed_id").cast("string").alias("incident_key"),
        F.array("blame_model", "parent_table").alias("candidate_tables"),
        "blame_column",
        top["cause_class"].alias("cause_class"),
        top["score"].alias("confidence"),
        (F.col("blame_row_count") / 1000).alias("latency_seconds"),
    )
    supplier = fx.read(spark, folder, "supplier")
    nation = F.col("s_nationkey")
    truths = supplier.select(
        F.col("s_suppkey").cast("string").alias("incident_key"),
        F.when(nation < 8, "broken_join_fanout")
        .when(nation < 16, "late_arriving")
        .otherwise("duplicate_ingestion")
        .alias("cause_class"),
        F.when(nation < 15, "feed_lines").when(nation < 20, "settled_orders").otherwise("raw").alias(
            "source_table"
        ),
        F.when(nation < 10, "order_ref").otherwise("line_key").alias("source_column"),
    )
    return metrics.pair(said, truths)


def _noisy_rows(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Finished lines as the truth and returnable lines as the answer, by feed."""
    lines = fx.read(spark, folder, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("incident_key"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("pk"),
        "l_linestatus",
        "l_returnflag",
    )
    true = lines.filter("l_linestatus = 'F'").select("incident_key", "pk").distinct()
    said = lines.filter("l_returnflag <> 'N'").select("incident_key", "pk").distinct()
    return said, true


@query
def q_metric_topk(spark: SparkSession, folder: str) -> DataFrame:
    found = metrics.table_and_latency(_noisy_pairs(spark, folder))
    return fx.rounded(found.select("n_incidents", "top1_table_acc", "top3_table_acc"))


@query
def q_metric_column_acc(spark: SparkSession, folder: str) -> DataFrame:
    found = metrics.table_and_latency(_noisy_pairs(spark, folder))
    return fx.rounded(found.select("column_acc_given_table"))


def _row_scores(spark: SparkSession, folder: str) -> DataFrame:
    overlap = metrics.row_overlap(*_noisy_rows(spark, folder))
    return fx.rounded(metrics.row_scores(overlap, _noisy_pairs(spark, folder)))


@query
def q_metric_row_recall(spark: SparkSession, folder: str) -> DataFrame:
    return _row_scores(spark, folder).select("row_recall")


@query
def q_metric_row_precision(spark: SparkSession, folder: str) -> DataFrame:
    return _row_scores(spark, folder).select("row_precision")


@query
def q_metric_row_f1(spark: SparkSession, folder: str) -> DataFrame:
    return _row_scores(spark, folder).select("row_f1")


@query
def q_metric_macro_f1(spark: SparkSession, folder: str) -> DataFrame:
    return fx.rounded(metrics.macro_f1(_noisy_pairs(spark, folder)))


@query
def q_metric_per_class(spark: SparkSession, folder: str) -> DataFrame:
    return fx.rounded(metrics.per_class(_noisy_pairs(spark, folder)))


@query
def q_metric_ece(spark: SparkSession, folder: str) -> DataFrame:
    return fx.rounded(metrics.calibration_error(_noisy_pairs(spark, folder)))


@query
def q_metric_median_latency(spark: SparkSession, folder: str) -> DataFrame:
    found = metrics.table_and_latency(_noisy_pairs(spark, folder))
    return fx.rounded(found.select("median_latency_s"))


@query
def q_metrics_report_fleet(spark: SparkSession, folder: str) -> DataFrame:
    said, true = _noisy_rows(spark, folder)
    return fx.rounded(metrics.evaluate(_noisy_pairs(spark, folder), said, true))


@query
def q_metrics_report(spark: SparkSession, folder: str) -> DataFrame:
    return fx.rounded(fx.suite(spark, folder).report())


@query
def q_metrics_report_row(spark: SparkSession, folder: str) -> DataFrame:
    said, true = _noisy_rows(spark, folder)
    report = metrics.evaluate(_noisy_pairs(spark, folder), said, true)
    return report.select(metrics.report_line("culprit").alias("report_row"))


@query
def q_metric_confusion(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.confusion(_noisy_pairs(spark, folder))


@query
def q_metric_interval(spark: SparkSession, folder: str) -> DataFrame:
    pairs = _noisy_pairs(spark, folder)
    return fx.rounded(history.bootstrap_interval(pairs, "incident_key", metrics.top_k_hit(1)))


@query
def q_blame_outside(spark: SparkSession, folder: str) -> DataFrame:
    """Feeds are sources, so a table of models alone knows none of them."""
    nodes = artifacts.manifest_nodes(fx.artifacts(spark, folder)[1])
    listed = nodes.filter(F.col("kind") == "model").select(F.col("name"))
    return metrics.blame_outside(fx.line_incidents(spark, folder), listed)


# --- history ---------------------------------------------------------------------------


@query
def q_null_rate_trend(spark: SparkSession, folder: str) -> DataFrame:
    found = history.null_rate_trend(fx.feed_lines(spark, folder), "order_ref", "ship_ts")
    return fx.rounded(found.withColumn("day", F.col("day").cast("string")))


@query
def q_schema_diff(spark: SparkSession, folder: str) -> DataFrame:
    """A snapshot with keys as text and without tax, against one without priorities."""
    types = _typed_columns(spark, folder).withColumn("dtype", norm_dtype(F.col("dtype")))
    is_key = F.col("column_name").endswith("key")
    before = types.filter("column_name <> 'l_tax'").withColumn(
        "dtype", F.when(is_key, "STRING").otherwise(F.col("dtype"))
    )
    found = history.schema_diff(before, types.filter("column_name <> 'o_orderpriority'"))
    filled = types.select("table_name", "column_name", "filled_rows")
    return found.join(filled, ["table_name", "column_name"]).select(
        "table_name", "column_name", F.coalesce("old_dtype", F.lit("none")).alias("old_dtype"),
        F.coalesce("new_dtype", F.lit("none")).alias("new_dtype"), "change", "filled_rows",
    )


@query
def q_expired_references(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers whose contract ran out, by nation, before the line was shipped."""
    ends = F.timestamp_add("DAY", F.col("s_nationkey") * 100, F.lit("1996-01-01").cast("timestamp_ntz"))
    contracts = fx.read(spark, folder, "supplier").select(
        "s_suppkey", F.when(F.col("s_nationkey") > 0, ends).alias("valid_to")
    )
    return history.expired_references(
        fx.feed_lines(spark, folder), "feed_id", "ship_ts", contracts, "s_suppkey", "valid_to",
        by=["feed_id"],
    )


@query
def q_interval_references(spark: SparkSession, folder: str) -> DataFrame:
    """Lines by feed against the contracts that the feeds' orders of 1995 to 1997 made.

    A contract begins with an order and runs for a number of days that follows the order's
    key; some have no end.  Contracts overlap, and leave gaps.
    """
    date = F.col("o_orderdate").cast("timestamp_ntz")
    made = fx.read(spark, folder, "orders").filter("o_orderkey % 13 = 0").select(
        F.col("o_orderkey").alias("l_orderkey"),
        date.alias("valid_from"),
        F.when(
            F.col("o_orderkey") % 101 != 0, F.timestamp_add("DAY", (F.col("o_orderkey") % 60).cast("int"), date)
        ).alias("valid_to"),
    )
    lines = fx.read(spark, folder, "lineitem").select("l_orderkey", "l_suppkey")
    contracts = lines.join(made, "l_orderkey").select("l_suppkey", "valid_from", "valid_to")
    return history.interval_references(
        fx.feed_lines(spark, folder), "feed_id", "ship_ts", contracts, "l_suppkey", "valid_from",
        "valid_to", by=["feed_id"],
    )


@query
def q_unit_shift(spark: SparkSession, folder: str) -> DataFrame:
    """Users whose mean value left in another unit: cents for every third one."""
    value = F.when(F.col("user_id") % 3 == 0, F.col("value") * 100).otherwise(F.col("value"))
    means = fx.read(spark, folder, "events").groupBy("user_id").agg(
        F.avg("value").alias("before"), F.avg(value).alias("now")
    )
    factor = history.unit_factor(F.col("now"), F.col("before"))
    return means.select("user_id", F.coalesce(factor, F.lit(1.0)).alias("unit_factor"))


@query
def q_hash_split(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents dealt 60 / 20 / 20 for fitting, tuning and testing."""
    labels = fx.read(spark, folder, "labels")
    split = history.hash_split(labels, F.col("doc_id"), {"fit": 60, "tune": 20, "test": 20})
    return split.select("doc_id", "part")


# --- baselines -------------------------------------------------------------------------


def _chosen(spark: SparkSession, folder: str) -> DataFrame:
    return fx.suite(spark, folder).classified.select(
        "incident_key", "test_name", F.col("failing_test_kind").alias("kind"),
        F.col("failing_model").alias("model"), F.col("failing_column").alias("column"),
    )


def _baseline(found: DataFrame) -> DataFrame:
    return found.withColumn("candidate_tables", F.array_join("candidate_tables", ","))


@query
def q_baseline_test_name(spark: SparkSession, folder: str) -> DataFrame:
    return _baseline(baselines.by_test_name(_chosen(spark, folder)))


@query
def q_baseline_random(spark: SparkSession, folder: str) -> DataFrame:
    return _baseline(baselines.by_chance(_chosen(spark, folder), retail.SOURCE_NAMES))


@query
def q_baseline_name_heuristic(spark: SparkSession, folder: str) -> DataFrame:
    return _baseline(
        baselines.by_name_heuristic(
            _chosen(spark, folder), "customer", "raw_customers", "raw_orders"
        )
    )


@query
def q_baseline_walk_only(spark: SparkSession, folder: str) -> DataFrame:
    failing = _chosen(spark, folder)
    walks = lineage.walk_lineage(
        failing.select("model", "column"), retail.edges(spark), retail.nodes(spark)
    )
    return _baseline(baselines.by_walk_only(failing, walks))


# --- whole paths -----------------------------------------------------------------------


@query
def q_triage_retail(spark: SparkSession, folder: str) -> DataFrame:
    """The project's own failures, from tests to incidents."""
    raw = retail.sources(spark, folder)
    answer = triage(
        spark, raw, retail.models(raw), project(spark), created_at=F.lit(fx.FAULTS_AT)
    )
    return _flat(answer.incidents)


@query
def q_triage_calibrated(spark: SparkSession, folder: str) -> DataFrame:
    """The same incidents with confidences on a curve fitted to the line fleet's labels."""
    raw = retail.sources(spark, folder)
    model = calibration.fit_calibration(_labelled_scores(spark, folder))
    answer = triage(
        spark, raw, retail.models(raw), project(spark), created_at=F.lit(fx.FAULTS_AT),
        calibrate=calibration.calibrator(model),
    )
    guess = F.get("hypotheses", F.lit(0))
    return fx.rounded(
        answer.incidents.select(
            "failing_test_name", guess["confidence"].alias("confidence"),
            guess["confidence_calibrated"].alias("calibrated"),
        )
    )


@query
def q_triage_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Run artifacts as files, triaged by the stream into a store."""
    path = scratch_path(spark, "stream")
    runs, manifests = fx.artifacts(spark, folder)
    write_artifacts(runs, manifests, f"{path}/artifacts")

    def respond(failing: DataFrame) -> DataFrame:
        """Evidence for the feeds of this batch only."""
        feeds = failing.select(F.expr("substring(run_id, 5)").cast("bigint").alias("feed_id"))
        # Kept and counted, so that Spark knows their size when it plans the reads of the lines.
        feeds = feeds.distinct().persist()
        feeds.count()
        evidence = fx.line_classified(spark, folder, feeds).withColumn(
            "run_id", F.concat(F.lit("run_"), F.col("feed_id").cast("string"))
        )
        met = failing.select("run_id", "test_name").join(evidence, ["run_id", "test_name"])
        return build_incidents(
            met, identity=["feed_id", "test_name"], created_at=F.lit(fx.FAULTS_AT)
        )

    stored = triage_stream(
        spark,
        f"{path}/artifacts",
        respond,
        store.IncidentStore(spark, f"{path}/store"),
        f"{path}/progress",
    )
    return stored.current().select("incident_id", "failing_test_name", "verdict_type")


@query
def q_fact_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Facts of all feeds after three deliveries of their lines, each read once."""
    path = scratch_path(spark, "facts")
    lines = fx.feed_lines(spark, folder)
    for turn in range(3):
        arrived = lines.filter(F.year("ship_ts") % 3 == turn)
        arrived.write.mode("append").parquet(f"{path}/arrivals")
        start_fact_stream(
            spark.readStream.schema(lines.schema).parquet(f"{path}/arrivals"),
            path,
            by=["feed_id"],
            key="line_key",
            reference="order_ref",
            parent=fx.settled_orders(spark, folder),
            parent_key="o_orderkey",
            moment="ship_ts",
        ).awaitTermination()
    found = feed_facts(spark, path, ["feed_id"])
    return found.withColumn("latest", F.date_format("latest", "yyyy-MM-dd HH:mm:ss"))
