"""Inputs the registered queries share: fleets and runs derived from the given tables.

Two fleets stand for many loads in one table.  In the line fleet every supplier is a
feed that delivers order lines; in the event fleet every user is one.  Runs, artifacts
and labelled faults are derived from the same tables by Spark, so they grow with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from culprit.functions.keys import ntz
from culprit.operators.evidence import Target, assemble_evidence
from culprit.operators.faults import Trial, inject, trials_for
from culprit.operators.incidents import build_incidents, classify
from culprit.operators.lineage import edge_frame, walk_lineage
from culprit.plans import retail
from culprit.plans.suite import SuiteRun, run_suite
from culprit.schemas import EVIDENCE_DEFAULTS

OBSERVED_AT = "2001-11-04 01:00:00"
EVENTS_OBSERVED_AT = "2024-02-01 00:00:00"
LINE_TEST = "relationships_stg_lines_order_ref__o_orderkey__ref_settled_orders_"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that summation order does not show."""
    doubles = {n: F.round(n, digits) for n, t in df.dtypes if t == "double"}
    return df.withColumns(doubles) if doubles else df


def wall_clock(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {n: F.col(n).cast("timestamp_ntz") for n, t in df.dtypes if t == "timestamp"}
    )


# --- the line fleet -------------------------------------------------------------------


def feed_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines by feed; lines without discount and tax arrive without their order."""
    bare = (F.col("l_discount") == 0) & (F.col("l_tax") == 0)
    return read(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("feed_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_key"),
        F.when(~bare, F.col("l_orderkey")).alias("order_ref"),
        F.col("l_shipdate").alias("ship_ts"),
    )


def settled_orders(spark: SparkSession, folder: str) -> DataFrame:
    """All orders; one in 256, by the hash of its key, still has a provisional key."""
    provisional = F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 2) == "00"
    return read(spark, folder, "orders").select(
        F.when(provisional, -F.col("o_orderkey")).otherwise(F.col("o_orderkey")).alias("o_orderkey"),
        "o_orderdate",
    )


LINE_TARGET = Target(
    LINE_TEST, "relationships", "stg_lines", "order_ref", "feed_lines", "order_ref",
    "line_key", "settled_orders", "o_orderkey",
)


def line_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {
        "feed_lines": feed_lines(spark, folder),
        "settled_orders": settled_orders(spark, folder),
    }


def line_evidence(
    spark: SparkSession, folder: str, feeds: DataFrame | None = None
) -> DataFrame:
    """Evidence by feed, of all feeds or of those in `feeds`.

    That of all feeds, a row each, is kept: most queries read it several times, and each
    time would be a pass over all lines.
    """
    tables = line_tables(spark, folder)
    if feeds is not None:
        tables["feed_lines"] = tables["feed_lines"].join(feeds, "feed_id", "left_semi")
    found = assemble_evidence([LINE_TARGET], tables, by=["feed_id"], observed_at=OBSERVED_AT)
    return found.persist() if feeds is None else found


def line_edges(spark: SparkSession) -> DataFrame:
    return edge_frame(
        spark,
        [
            ("stg_lines", "order_ref", "feed_lines", "order_ref", False, False, False),
            ("stg_lines", "line_key", "feed_lines", "line_key", False, False, False),
        ],
    )


def line_classified(
    spark: SparkSession, folder: str, feeds: DataFrame | None = None
) -> DataFrame:
    """Feed evidence with ranked causes and the lineage walk it came from."""
    scored = classify(line_evidence(spark, folder, feeds))
    starts = scored.select(
        F.col("failing_model").alias("model"), F.col("failing_column").alias("column")
    )
    walks = walk_lineage(starts, line_edges(spark)).select(
        F.col("model").alias("failing_model"),
        F.col("column").alias("failing_column"),
        "certainty",
        "hit_agg_boundary",
        "walk_path",
    )
    met = scored.join(walks, ["failing_model", "failing_column"])
    return met.withColumn("failing_row_count", F.col("orphan_fk_count")).withColumnRenamed(
        "target", "test_name"
    )


def line_incidents(spark: SparkSession, folder: str) -> DataFrame:
    """One incident per feed, dated by the feed's last delivery."""
    seconds = F.round(F.col("blame_lag_ratio") * 86400).cast("int")
    delivered = F.timestamp_add("SECOND", -seconds, ntz(OBSERVED_AT))
    return build_incidents(
        line_classified(spark, folder), identity=["feed_id", "test_name"], created_at=delivered
    )


# --- the event fleet ------------------------------------------------------------------


def feed_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events by user; the payload code is a number as text, except for cheap errors."""
    code = F.get_json_object("props", "$.k")
    return read(spark, folder, "events").select(
        "user_id",
        "event_id",
        "ts",
        "value",
        F.when((F.col("event_type") == "error") & (F.col("value") < 10), "error")
        .otherwise(code)
        .alias("code"),
    )


EVENT_TARGETS = (
    Target("code", "not_null", "stg_events", "code", "feed_events", "code", "event_id",
           expected_dtype="bigint"),
    Target("value", "not_null", "stg_events", "value", "feed_events", "value", "event_id",
           expected_dtype="double"),
)


def event_baselines(events: DataFrame) -> DataFrame:
    """The expected mean of `value`, with a twentieth of its spread as tolerance."""
    return events.agg(
        F.avg("value").alias("expected_mean"),
        (F.stddev_samp("value") / 20).alias("expected_stddev"),
    ).withColumn("target", F.lit("value"))


def event_evidence(spark: SparkSession, folder: str) -> DataFrame:
    events = feed_events(spark, folder)
    return assemble_evidence(
        EVENT_TARGETS,
        {"feed_events": events},
        by=["user_id"],
        observed_at=EVENTS_OBSERVED_AT,
        baselines=event_baselines(events),
    )


def both_fleets(spark: SparkSession, folder: str) -> DataFrame:
    """All evidence rows under one text key."""
    lines = line_evidence(spark, folder).withColumn(
        "incident", F.concat_ws("/", F.lit("feed"), F.col("feed_id").cast("string"))
    )
    events = event_evidence(spark, folder).withColumn(
        "incident", F.concat_ws("/", F.lit("user"), F.col("user_id").cast("string"), "target")
    )
    fields = ["incident", *EVIDENCE_DEFAULTS]
    return lines.select(*fields).unionByName(events.select(*fields))


# --- artifacts ------------------------------------------------------------------------


def _constant(node: dict) -> Column:
    """A nested constant with the manifest's node fields."""
    text = "string"
    return F.struct(
        F.lit(node["name"]).alias("name"),
        F.lit(node.get("schema")).cast(text).alias("schema"),
        F.lit(node.get("alias")).cast(text).alias("alias"),
        F.lit(node.get("relation_name")).cast(text).alias("relation_name"),
        F.struct(
            F.array(*[F.lit(d) for d in node.get("depends", [])]).cast("array<string>").alias(
                "nodes"
            )
        ).alias("depends_on"),
        F.struct(F.struct(F.lit(node.get("field")).cast(text).alias("field")).alias("kwargs")).alias(
            "test_metadata"
        ),
    )


NODES = {
    "test.retail.not_null_stg_lines_order_ref.a1": {
        "name": "not_null_stg_lines_order_ref",
        "depends": ["model.retail.stg", "model.retail.stg_lines"],
    },
    "test.retail.unique_stg_lines_line_key.b2": {
        "name": "unique_stg_lines_line_key",
        "depends": ["model.retail.stg_lines"],
        "relation_name": '"wh"."failures"."unique_stg_lines_line_key"',
    },
    "test.retail.relationships_stg_lines.c3": {
        "name": LINE_TEST,
        "depends": ["model.retail.settled_orders", "model.retail.stg_lines"],
        "field": "o_orderkey",
    },
    "model.retail.stg_lines": {"name": "stg_lines", "schema": "Main_Staging"},
    "model.retail.settled_orders": {
        "name": "settled_orders", "schema": "main_marts", "alias": "orders_settled",
    },
    "seed.retail.raw_lines": {"name": "raw_lines", "schema": "main"},
}
SOURCES = {"source.retail.feed_lines": {"name": "feed_lines", "schema": "main", "alias": "lines"}}


def feed_status(spark: SparkSession, folder: str) -> DataFrame:
    """Outcome counts of each feed's tests."""
    return line_evidence(spark, folder).select(
        "feed_id",
        F.round(F.col("blame_null_rate") * F.col("blame_row_count")).cast("bigint").alias("nulls"),
        F.col("blame_pk_dupe_count").alias("dupes"),
        F.col("orphan_fk_count").alias("orphans"),
        F.col("blame_row_count").alias("n_rows"),
    )


def artifacts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """One run_results and one manifest document per feed, as JSON text."""

    def result(uid: str, status: Column, relation: Column | None = None) -> Column:
        return F.struct(
            F.lit(uid).alias("unique_id"),
            status.alias("status"),
            (relation if relation is not None else F.lit(None).cast("string")).alias(
                "relation_name"
            ),
        )

    def failed(count: str, word: str) -> Column:
        return F.when(F.col(count) > 0, word).otherwise("pass")

    feed_text = F.col("feed_id").cast("string")
    quoted = F.concat(F.lit('"wh"."failures"."nulls_'), feed_text, F.lit('"'))
    results = F.array(
        result("model.retail.stg_lines", F.lit("success")),
        result("test.retail.not_null_stg_lines_order_ref.a1", failed("nulls", "fail"), quoted),
        result("test.retail.unique_stg_lines_line_key.b2", failed("dupes", "warn")),
        result("test.retail.relationships_stg_lines.c3", failed("orphans", "error")),
        result(
            "test.retail.unlisted.d4", F.when(F.col("n_rows") % 2 == 1, "fail").otherwise("pass")
        ),
    )
    run_id = F.concat(F.lit("run_"), feed_text)
    status = feed_status(spark, folder)
    runs = status.select(
        run_id.alias("run_id"), F.to_json(F.struct(results.alias("results"))).alias("run_results")
    )
    nodes = F.create_map(*[x for k, v in NODES.items() for x in (F.lit(k), _constant(v))])
    origin = F.create_map(
        *[
            x
            for k, v in SOURCES.items()
            for x in (
                F.lit(k),
                F.struct(
                    F.lit(v["name"]).alias("name"),
                    F.lit(v["schema"]).alias("schema"),
                    F.lit(v["alias"]).alias("identifier"),
                ),
            )
        ]
    )
    manifest = F.to_json(F.struct(nodes.alias("nodes"), origin.alias("sources")))
    manifests = status.select(run_id.alias("run_id"), manifest.alias("manifest"))
    return runs, manifests


# --- labelled faults ------------------------------------------------------------------

FAULTS_AT = "2024-01-01 00:00:00"


def one_fault(
    spark: SparkSession, folder: str, pattern_id: str, seed: int = 1
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Raw tables with one fault applied, and the truth rows."""
    pattern = next(t.pattern for t in trials_for("smoke") if t.pattern.pattern_id == pattern_id)
    target = retail.TARGETS[pattern.family]
    raw = retail.sources(spark, folder)
    faulted, truth = inject(raw, target, [Trial(pattern, seed)], retail.DATASET)
    return {**raw, target.table: faulted.drop("incident_key")}, truth


def suite(spark: SparkSession, folder: str) -> SuiteRun:
    """The whole labelled suite.

    A millisecond per failing row stands in for the clock, so the figure can be checked.
    """
    return run_suite(
        spark,
        retail.sources(spark, folder),
        "full",
        at=F.lit(FAULTS_AT),
        latency=F.col("failing_row_count") / 1000,
    )
