"""Test-run artifacts: failing tests, nodes and relations out of JSON documents.

One row is one document, so a folder of a million runs is a table of a million rows
and parses in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from culprit.schemas import FAILED_STATUSES, TEST_KINDS

# --- fixed values: the fields read from the artifacts -----------------------------
RUN_RESULTS = "results array<struct<unique_id:string,status:string,relation_name:string>>"
MANIFEST_NODE = (
    "struct<name:string,schema:string,alias:string,database:string,"
    "original_file_path:string,relation_name:string,"
    "depends_on:struct<nodes:array<string>>,"
    "test_metadata:struct<kwargs:struct<field:string,`to`:string>>>"
)
MANIFEST_SOURCE = "struct<name:string,schema:string,identifier:string,database:string>"
MANIFEST = (
    f"nodes map<string,{MANIFEST_NODE}>, sources map<string,{MANIFEST_SOURCE}>"
)
TEST_PREFIX, MODEL_PREFIX, SEED_PREFIX = "test.", "model.", "seed."
UNKNOWN_MODEL = "?"
# ----------------------------------------------------------------------------------


def read_documents(spark: SparkSession, path: str, column: str) -> DataFrame:
    """Whole JSON files as (path, column)."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias(column))


def test_kind(name: Column) -> Column:
    kind: Column = F.lit("unknown")
    for k in reversed(TEST_KINDS):
        kind = F.when(name.startswith(f"{k}_"), k).otherwise(kind)
    return kind


def parse_test_name(name: Column, models: Column, kinds: Column) -> Column:
    """struct<model, column> from a generated test name.

    Among the models whose `<kind>_<model>_` prefixes the name, the longest one owns the
    test; its column runs to the first double underscore.  Otherwise the first model, or
    a mark, and no column.  `kinds` is the array of prefixes to try.
    """
    prefixes = F.flatten(
        F.transform(
            models,
            lambda m: F.transform(
                kinds, lambda k: F.struct(F.concat(k, F.lit("_"), m, F.lit("_")).alias("p"),
                                          m.alias("m"))
            ),
        )
    )
    fitting = F.filter(prefixes, lambda c: name.startswith(c["p"]))
    ranked = F.transform(
        fitting, lambda c: F.struct(F.length(c["m"]).alias("n"), c["m"].alias("m"), c["p"])
    )
    best = F.array_max(ranked)
    rest = F.substring(name, F.length(best["p"]) + 1, F.length(name))
    column = F.nullif(F.get(F.split(rest, "__"), F.lit(0)), F.lit(""))
    found = F.struct(best["m"].alias("model"), column.alias("column"))
    first = F.coalesce(F.get(models, F.lit(0)), F.lit(UNKNOWN_MODEL))
    other = F.struct(first.alias("model"), F.lit(None).cast("string").alias("column"))
    return F.when(F.size(fitting) > 0, found).otherwise(other)


def last_part(unique_id: Column) -> Column:
    return F.element_at(F.split(unique_id, r"\."), -1)


def documents_of(runs: DataFrame, manifests: DataFrame, on: str = "run_id") -> DataFrame:
    """Both documents of each run in one row; a run may lack its manifest."""
    return runs.select(on, "run_results").join(manifests.select(on, "manifest"), on, "left")


def test_results(documents: DataFrame, on: str = "run_id") -> DataFrame:
    """Every test of every run with its manifest entry.

    `documents` holds (run key, run_results JSON, manifest JSON).  Each result looks up
    its node in the row's own manifest before anything is exploded, so nodes neither
    move nor multiply.
    """
    both = F.struct(
        F.from_json("run_results", RUN_RESULTS)["results"].alias("results"),
        F.from_json("manifest", MANIFEST)["nodes"].alias("nodes"),
    )
    # The one-element explode pins the parsed documents: inlined into the look-up they
    # would be parsed again for every result.
    parsed = documents.select(on, F.explode(F.array(both)).alias("d"))
    numbered = F.transform(
        "d.results",
        lambda r, i: F.struct(
            i.alias("position"),
            r["unique_id"].alias("unique_id"),
            r["status"].alias("status"),
            r["relation_name"].alias("relation_name"),
            F.col("d.nodes")[r["unique_id"]].alias("node"),
        ),
    )
    tests = F.filter(numbered, lambda r: r["unique_id"].startswith(TEST_PREFIX))
    return parsed.select(on, F.inline(tests))


def failing_tests(documents: DataFrame, on: str = "run_id") -> DataFrame:
    """Failing tests with kind, model, column, parent and failures table."""
    failed = test_results(documents, on).filter(F.col("status").isin(*FAILED_STATUSES))
    name = F.coalesce("node.name", last_part(F.col("unique_id")))
    depends = F.coalesce("node.depends_on.nodes", F.array().cast("array<string>"))
    models = F.transform(
        F.filter(depends, lambda d: d.startswith(MODEL_PREFIX)), lambda d: last_part(d)
    )
    named = failed.withColumns({"test_name": name, "ref_models": models})
    named = named.withColumn("kind", test_kind(F.col("test_name")))
    kinds = F.when(F.col("kind") != "unknown", F.array("kind")).otherwise(
        F.array().cast("array<string>")
    )
    parsed = named.withColumn(
        "owner", parse_test_name(F.col("test_name"), F.col("ref_models"), kinds)
    )
    others = F.filter("ref_models", lambda m: m != F.col("owner.model"))
    is_link = F.col("kind") == "relationships"
    field = F.coalesce("node.test_metadata.kwargs.field", "owner.column")
    relation = F.coalesce(
        F.nullif(F.col("relation_name"), F.lit("")), "node.relation_name", F.lit("")
    )
    return parsed.select(
        on,
        "position",
        "test_name",
        "kind",
        F.col("owner.model").alias("model"),
        F.col("owner.column").alias("column"),
        F.when(is_link, F.get(others, F.lit(0))).alias("parent_model"),
        F.when(is_link, field).alias("parent_column"),
        F.replace(relation, F.lit('"'), F.lit("")).alias("failures_table"),
    )


def run_totals(documents: DataFrame, on: str = "run_id") -> DataFrame:
    """Passed and failed tests per run."""
    results = test_results(documents, on)
    return results.groupBy(on).agg(
        F.count_if(F.col("status") == "pass").alias("passed"),
        F.count_if(F.col("status").isin(*FAILED_STATUSES)).alias("failed"),
    )


def manifest_nodes(manifests: DataFrame, on: str = "run_id") -> DataFrame:
    """Models, seeds and sources; other node kinds are no lineage targets."""
    parsed = manifests.select(on, F.from_json("manifest", MANIFEST).alias("m"))
    nodes = parsed.select(on, F.explode("m.nodes").alias("unique_id", "n"))
    uid = F.col("unique_id")
    kind = F.when(uid.startswith(MODEL_PREFIX), "model").when(uid.startswith(SEED_PREFIX), "seed")
    own = nodes.withColumn("kind", kind).filter(F.col("kind").isNotNull())
    sources = parsed.select(on, F.explode("m.sources").alias("unique_id", "n")).withColumn(
        "kind", F.lit("source")
    )

    def shaped(df: DataFrame, alias: str) -> DataFrame:
        return df.select(
            on,
            "unique_id",
            "n.name",
            "n.schema",
            F.coalesce(F.nullif(F.col(f"n.{alias}"), F.lit("")), "n.name").alias("alias"),
            F.coalesce("n.database", F.lit("")).alias("database"),
            "kind",
        )

    return shaped(own, "alias").unionByName(shaped(sources, "identifier"))


def resolve_relation(references: DataFrame, nodes: DataFrame, on: str = "run_id") -> DataFrame:
    """Node of each (schema, table) reference: by relation, else by name, case-blind."""
    by_relation = nodes.groupBy(
        on, F.lower("schema").alias("_schema"), F.lower("alias").alias("_table")
    ).agg(F.max("name").alias("relation_hit"))
    by_name = nodes.groupBy(on, F.lower("name").alias("_table")).agg(
        F.max("name").alias("name_hit")
    )
    asked = references.withColumns(
        {"_schema": F.lower("ref_schema"), "_table": F.lower("ref_table")}
    )
    met = asked.join(by_relation, [on, "_schema", "_table"], "left").join(
        by_name, [on, "_table"], "left"
    )
    return met.withColumn("node_name", F.coalesce("relation_hit", "name_hit")).drop(
        "_schema", "_table", "relation_hit", "name_hit"
    )
