"""Lineage closure (cycles, hops), contract prediction, snapshot and restore."""

import random

from pyspark.sql import functions as F

from faultbench.operators import lineage
from faultbench.operators.lineage import closure, path_counts, placed, reach_sizes
from faultbench.operators.downstream import MANAGED_TABLES
from faultbench.operators.snapshots import snapshot, verify_restore
from faultbench.plans.lineage_contract import downstream_tables, predicted_tables
from tests.fixture import fixture_tables
from tests.shuffles import bytes_shuffled


def test_closure_terminates_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "node string")
    got = {r["node"]: r["hops"] for r in closure(edges, seeds).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3}


def brute_reach(pairs):
    out = {}
    for start in {x for p in pairs for x in p}:
        seen, todo = {start}, [start]
        while todo:
            now = todo.pop()
            for a, b in pairs:
                if a == now and b not in seen:
                    seen.add(b)
                    todo.append(b)
        out[start] = seen
    return out


def test_closure_of_random_graphs(spark):
    for seed in range(3):
        draw = random.Random(seed)
        pairs = [(f"n{draw.randint(0, 40)}", f"n{draw.randint(0, 40)}") for _ in range(60)] + [("hub", f"n{i}") for i in range(30)]
        edges = spark.createDataFrame([*pairs, pairs[0], (None, "n1")], "src string, dst string")
        reach = brute_reach(pairs)
        for together in (100_000, 4):  # 4: the hub's edges lie in several places
            got = {r["node"] for r in closure(edges, spark.createDataFrame([("hub",), ("alone",)], "node string"), together=together).collect()}
            assert got == reach["hub"] | {"alone"}
        sizes = {r["node"]: (r["size"], r["exact"]) for r in reach_sizes(edges, k=64).collect()}
        assert sizes == {n: (len(r), len(r) < 64) for n, r in reach.items()}
        rough = {r["node"]: r["size"] for r in reach_sizes(edges, k=16).collect()}
        assert all(abs(rough[n] / len(r) - 1) < 4 / 14**0.5 for n, r in reach.items())


def test_sketches_over_many_hops(spark, monkeypatch):
    """A chain with a loop, a shortcut and repeated edges: more hops than parts are kept."""
    monkeypatch.setattr(lineage, "MOST_PARTS", 2)
    pairs = [(f"n{i}", f"n{i + 1}") for i in range(6)] + [("n6", "n4"), ("n1", "n5"), ("n4", "leaf")]
    edges = spark.createDataFrame([*pairs, *pairs[:3], (None, "n1"), ("n1", None)], "src string, dst string")
    reach = brute_reach(pairs)
    got = {r["node"]: (r["size"], r["exact"]) for r in reach_sizes(edges, k=64).collect()}
    assert got == {n: (len(r), True) for n, r in reach.items()}
    cut = {r["node"]: r["exact"] for r in reach_sizes(edges, k=5).collect()}
    assert cut == {n: len(r) < 5 for n, r in reach.items()}
    short = {r["node"]: r["size"] for r in reach_sizes(edges, k=64, max_hops=1).collect()}
    assert short == {n: 1 + len({b for a, b in pairs if a == n} - {n}) for n in reach}
    assert {r["size"] for r in reach_sizes(edges, k=64, max_hops=0).collect()} == {1.0}


def test_sketches_move_little(spark):
    """Bytes shuffled for each edge of a graph of many ends (before: 268, from several shuffles of all sketches a hop)."""
    code = """
from faultbench.operators.lineage import reach_sizes
edges = spark.range(60000).selectExpr("concat('o:', id DIV 6) AS src", "concat('l:', id DIV 6, ':', id % 6) AS dst")
reach_sizes(edges, k=16).write.format("noop").mode("overwrite").save()
"""
    assert bytes_shuffled(code) < 100 * 60000


def test_paths_of_a_tree_and_a_diamond(spark):
    pairs = [("r", "a"), ("r", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("d", "e"), ("r", None), ("r", "a")]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    for hops, r, c in ((1, 3, 1), (2, 5, 2), (3, 7, 2)):
        got = {x["node"]: x["paths"] for x in path_counts(edges, hops).collect()}
        assert (got["r"], got["c"], got["d"]) == (r, c, 1) and set(got) == {"r", "a", "b", "c", "d"}


def test_known_nodes_are_not_shuffled_again(spark):
    """A checkpointed part keeps its partitioning by node, so only the new targets move."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        part = spark.range(1000).select(F.col("id").cast("string").alias("node"))
        part = placed(part, 8, "node")
        new = spark.range(900, 1100).select(F.col("id").cast("string").alias("node")).distinct().join(part, "node", "left_anti")
        assert new.count() == 100
        plan = new._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        assert plan.count("Exchange") == 1 and "SortMergeJoin" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_contract_prediction():
    assert len(downstream_tables("raw_orders")) == 5
    assert "daily_revenue" not in predicted_tables("raw_orders", ["customer_id"])
    assert "daily_revenue" in predicted_tables("raw_orders", ["amount_cents"])
    assert set(predicted_tables("raw_customers", ["*"])) == {
        "raw_customers", "orders_enriched", "customer_value", "executive_dashboard"
    }


def test_snapshot_restore_verifies(spark):
    from faultbench.operators.downstream import build_tables, plain
    from faultbench.operators.variants import VariantSet

    t = fixture_tables(spark)
    tables = {k: plain(v) for k, v in build_tables(t["raw_customers"], t["raw_orders"], VariantSet()).items()}
    path = snapshot(spark, tables, seed=1)
    rows = verify_restore(spark, path, list(MANAGED_TABLES)).collect()
    assert len(rows) == 6 and all(r["verified"] for r in rows)
