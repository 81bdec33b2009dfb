import pytest
from conftest import rows
from pyspark.sql import functions as F

from culprit.operators import lineage
from culprit.plans import retail
from culprit.schemas import TEXT, record
from culprit.sources.constants import constant_frame

SPOT = record(model=TEXT, column=TEXT)


def walk(spark, starts, edges=None, nodes=None):
    frame = constant_frame(spark, starts, SPOT)
    found = lineage.walk_lineage(
        frame, retail.edges(spark) if edges is None else edges, nodes
    )
    return {(r.model, r.column): r for r in found.collect()}


def test_known_pairs(spark):
    pairs = {
        ("stg_orders", "customer_id"): ("raw_orders", "o_custkey"),
        ("stg_orders", "order_id"): ("raw_orders", "o_orderkey"),
        ("stg_customers", "customer_id"): ("raw_customers", "c_custkey"),
        ("stg_payments", "amount"): ("raw_payments", "l_extendedprice"),
        ("orders", "customer_id"): ("raw_orders", "o_custkey"),
        ("orders", "order_id"): ("raw_orders", "o_orderkey"),
    }
    got = walk(spark, list(pairs), nodes=retail.nodes(spark))
    assert {k: (r.blame_model, r.blame_column) for k, r in got.items()} == pairs
    assert all(r.certainty == 1.0 and not r.hit_agg_boundary for r in got.values())


def test_aggregation_drops_keys(spark):
    got = walk(spark, [("orders", "amount"), ("orders", "order_id")])
    agg = got[("orders", "amount")]
    assert [s.transform_type for s in agg.walk_path] == ["AGG", "DIRECT"]
    assert (agg.certainty, agg.hit_agg_boundary, agg.blame_model) == (0.6, True, "raw_payments")
    keys = spark.sql("SELECT * FROM VALUES ('orders','amount','1'),('orders','order_id','2') t(model,column,pk)")
    blamed = lineage.walk_lineage(keys, retail.edges(spark))
    assert rows(lineage.carry_keys(keys, blamed, ["model", "column"]), "pk") == [("2",)]


def test_no_hop(spark):
    got = walk(spark, [("raw_orders", "x"), ("nowhere", None)])
    assert got[("raw_orders", "x")].certainty == 0.5
    assert got[("nowhere", "")].hops == 0


def test_only_models_lead_on(spark):
    edges = lineage.edge_frame(spark, [("s", "a", "t", "b", False, False, False)])
    nodes = retail.nodes(spark)
    assert walk(spark, [("s", "a")], edges)[("s", "a")].blame_model == "t"
    assert walk(spark, [("s", "a")], edges, nodes)[("s", "a")].blame_model == "s"


def test_first_source_and_tags(spark):
    edges = lineage.edge_frame(
        spark,
        [("m", "c", "late", "x", False, False, True, 2), ("m", "c", "early", "y", False, True, True, 1)],
    )
    got = walk(spark, [("m", "c")], edges)[("m", "c")]
    assert (got.blame_model, got.walk_path[0].transform_type) == ("early", "WINDOW")


def test_cycles_and_long_chains(spark):
    ring = lineage.edge_frame(
        spark, [("a", "c", "b", "c", False, False, False), ("b", "c", "a", "c", False, False, False)]
    )
    stopped = walk(spark, [("a", "c")], ring)[("a", "c")]
    assert (stopped.hops, stopped.blame_model) == (1, "b")  # a was seen, so b is the end
    chain = lineage.edge_frame(
        spark, [(f"m{i}", "c", f"m{i+1}", "c", False, False, False) for i in range(12)]
    )
    for start in range(12):
        found = walk(spark, [(f"m{start}", "c")], chain)[(f"m{start}", "c")]
        assert (found.blame_model, found.hops) == ("m12", 12 - start)
    loop = lineage.edge_frame(
        spark,
        [("t", "c", "x", "c", False, False, False), ("x", "c", "y", "c", True, False, False),
         ("y", "c", "z", "c", False, False, False), ("z", "c", "x", "c", False, False, False),
         ("s", "c", "s", "c", False, False, False)],
    )
    got = walk(spark, [("t", "c"), ("y", "c"), ("s", "c")], loop)
    assert [s.upstream_model for s in got[("t", "c")].walk_path] == ["x", "y", "z"]
    assert [s.upstream_model for s in got[("y", "c")].walk_path] == ["z", "x"]
    assert got[("t", "c")].hit_agg_boundary and not got[("y", "c")].hit_agg_boundary
    assert got[("s", "c")].hops == 0


def test_walks_use_only_the_steps_their_starts_lead_to(spark, monkeypatch):
    """The same walks from few starts, from more than are pruned, and beyond the pruned hops."""
    lines = [(f"p{k}m{i}", "c", f"p{k}m{i + 1}", "c", i == 3, False, False) for k in range(5) for i in range(11)]
    ring = [("r0", "c", "r1", "c", False, False, False), ("r1", "c", "r0", "c", False, False, False)]
    edges = lineage.edge_frame(spark, lines + ring)
    starts = [("p0m0", "c"), ("p0m4", "c"), ("p3m9", "c"), ("r0", "c"), ("gone", None), ("p4m11", "c")]
    used = []
    inner = lineage._on_the_way
    monkeypatch.setattr(lineage, "_on_the_way", lambda *a: used.append(inner(*a)) or used[-1])
    want = walk(spark, starts, edges)
    assert used[-1][1].count() == 11 + 2 + 2
    assert (want[("p0m0", "c")].hops, want[("p0m4", "c")].hit_agg_boundary) == (11, False)
    assert want[("r0", "c")].hops == 1 and want[("gone", "")].hops == 0
    for name, least in (("PRUNED_PLACES", 3), ("PRUNED_PLACES", 8), ("PRUNED_HOPS", 4)):
        with monkeypatch.context() as less:
            less.setattr(lineage, name, least)
            assert walk(spark, starts, edges) == want
            assert used[-1][1].count() == len(lines + ring)
    assert walk(spark, [], edges) == {}


def test_first_keys_order(spark):
    keys = spark.sql("SELECT * FROM VALUES ('g','10'),('g','9'),('g','100'),('g','2') t(g, pk)")
    got = lineage.first_keys(keys, ["g"], 3).orderBy("position").collect()
    assert [r.pk for r in got] == ["2", "9", "10"]


def test_keyed_attribution(spark):
    up = spark.sql("SELECT * FROM VALUES (1),(2),(3) t(id)")
    edge = lineage.KeyedEdge("stg", "c", "raw", "u", "order_id", "id")
    keys = spark.sql("SELECT * FROM VALUES ('2'),('3'),('99') t(pk)")
    got = lineage.keyed_attribution({"raw": up}, [edge], "stg", "c", "order_id", keys)
    assert rows(got) == [("raw", "u", 1.0, "2"), ("raw", "u", 1.0, "3")]
    other = lineage.keyed_attribution({"raw": up}, [edge], "stg", "c", "id", keys)
    assert other.first().certainty == pytest.approx(0.7)


def test_verify_rows_and_key_column(spark):
    up = spark.sql("SELECT * FROM VALUES (1),(2) t(id)")
    keys = spark.sql("SELECT * FROM VALUES ('2'),('2'),('9') t(pk)")
    assert lineage.verify_rows(up, "id", keys).first()[0] == 1
    from pyspark.sql import functions as F

    known = constant_frame(spark, [("orders", ""), ("x", "")], SPOT).select(
        "model", lineage.key_column(F.col("model"), retail.PK_MAP).alias("pk")
    )
    assert rows(known) == [("orders", "order_id"), ("x", "id")]


def test_keys_of_a_hot_place_are_dealt_over_tasks(spark):
    """Six places, one of which holds nearly all keys: tasks get like numbers of them."""
    keys = spark.range(20_000).select(
        F.when(F.col("id") % 50 == 0, F.concat(F.lit("m"), F.col("id") % 6)).otherwise("hot").alias("model"),
        F.col("id").cast("string").alias("pk"),
    )
    blamed = spark.sql("SELECT * FROM VALUES ('hot', false), ('m0', false), ('m2', true), ('m0', false) t(model, hit_agg_boundary)")
    old = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = lineage.carry_keys(keys, blamed, ["model"])
        assert got.count() == keys.filter("model in ('hot', 'm0')").count()
        sizes = [r[1] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) <= 2 * sum(sizes) / len(sizes) and len(sizes) > 4
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
