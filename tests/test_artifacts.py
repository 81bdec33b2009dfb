import json

from conftest import rows
from pyspark.sql import functions as F

from culprit.sources import artifacts

NODES = {
    "test.p.not_null_stg_orders_customer_id.1": {
        "name": "not_null_stg_orders_customer_id",
        "depends_on": {"nodes": ["model.p.stg_orders"]},
    },
    "test.p.rel.2": {
        "name": "relationships_stg_orders_customer_id__customer_id__ref_stg_customers_",
        "depends_on": {"nodes": ["model.p.stg_customers", "model.p.stg_orders"]},
        "relation_name": '"db"."fail"."rel"',
        "test_metadata": {"kwargs": {"field": "customer_id", "to": "ref('stg_customers')"}},
    },
    "model.p.stg_orders": {"name": "stg_orders", "schema": "Main", "alias": None},
    "seed.p.raw": {"name": "raw", "schema": "main", "alias": "raw_alias", "database": "db"},
    "snapshot.p.s": {"name": "s", "schema": "main"},
}
RESULTS = [
    {"unique_id": "model.p.stg_orders", "status": "success"},
    {"unique_id": "test.p.not_null_stg_orders_customer_id.1", "status": "fail",
     "relation_name": '"db"."fail"."nn"'},
    {"unique_id": "test.p.rel.2", "status": "warn"},
    {"unique_id": "test.p.passed.3", "status": "pass"},
    {"unique_id": "test.p.lost.abc", "status": "error"},
]


def documents(spark, results=RESULTS):
    source = {"source.p.ext": {"name": "ext", "schema": "raw", "identifier": "ext_v2"}}
    runs = spark.createDataFrame([("r", json.dumps({"results": results}))], "run_id string, run_results string")
    manifests = spark.createDataFrame(
        [("r", json.dumps({"nodes": NODES, "sources": source}))], "run_id string, manifest string"
    )
    return runs, manifests


def test_failing_tests(spark):
    got = artifacts.failing_tests(artifacts.documents_of(*documents(spark))).orderBy("position").collect()
    assert [(r.kind, r.model, r.column, r.parent_model, r.parent_column, r.failures_table) for r in got] == [
        ("not_null", "stg_orders", "customer_id", None, None, "db.fail.nn"),
        ("relationships", "stg_orders", "customer_id", "stg_customers", "customer_id", "db.fail.rel"),
        ("unknown", "?", None, None, None, ""),
    ]
    assert got[2].test_name == "abc"
    assert rows(artifacts.run_totals(artifacts.documents_of(*documents(spark)))) == [("r", 1, 3)]


def test_nothing_failed(spark):
    assert artifacts.failing_tests(artifacts.documents_of(*documents(spark, []))).count() == 0


def test_name_parse(spark):
    cases = [
        ("not_null_stg_orders_customer_id", ["stg_orders"], ["not_null"], ("stg_orders", "customer_id")),
        ("relationships_stg_orders_customer_id__customer_id__ref_stg_customers_",
         ["stg_orders", "stg_customers"], ["relationships"], ("stg_orders", "customer_id")),
        ("unique_stg_orders_order_id", ["stg", "stg_orders"], ["unique"], ("stg_orders", "order_id")),
        ("some_custom_test", ["my_model"], [], ("my_model", None)),
        ("some_custom_test", [], [], ("?", None)),
        # Runs may try every kind instead of the detected one.
        ("unique_a_b", ["a"], ["not_null", "unique"], ("a", "b")),
    ]
    df = spark.createDataFrame([c[:3] for c in cases], "n string, m array<string>, k array<string>")
    owner = artifacts.parse_test_name(F.col("n"), F.col("m"), F.col("k"))
    got = [tuple(r.o) for r in df.select(owner.alias("o")).collect()]
    assert got == [c[3] for c in cases]


def test_nodes_and_relations(spark):
    _, manifests = documents(spark)
    nodes = artifacts.manifest_nodes(manifests)
    assert rows(nodes, "name", "alias", "database", "kind") == [
        ("ext", "ext_v2", "", "source"), ("raw", "raw_alias", "db", "seed"),
        ("stg_orders", "stg_orders", "", "model"),
    ]
    asked = spark.createDataFrame(
        [("r", "MAIN", "STG_ORDERS"), ("r", None, "raw"), ("r", "main", "RAW_ALIAS"), ("r", "x", "y")],
        "run_id string, ref_schema string, ref_table string",
    )
    got = artifacts.resolve_relation(asked, nodes)
    assert rows(got, "ref_table", "node_name") == [
        ("RAW_ALIAS", "raw"), ("STG_ORDERS", "stg_orders"), ("raw", "raw"), ("y", None)]


def test_documents_from_files(spark, tmp_path):
    (tmp_path / "run_results.json").write_text(json.dumps({"results": RESULTS}, indent=1))
    got = artifacts.read_documents(spark, str(tmp_path), "run_results").first()
    assert got.path.endswith("run_results.json")
    assert len(json.loads(got.run_results)["results"]) == 5
