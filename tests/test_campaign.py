"""Enforcing runs, detection against clean data, typed bounds, many faults, snapshots."""

import pytest
from pyspark.sql import functions as F

from faultbench.operators.controls import Control, detection_matrix, failing_on_clean
from faultbench.operators.downstream import build_tables
from faultbench.operators.faults import FaultSpec
from faultbench.operators.snapshots import SnapshotMismatch, remove_snapshot, require_verified, snapshot
from faultbench.operators.variants import VariantSet
from faultbench.plans.campaign import Campaign, CampaignFailed
from faultbench.plans.contract import BASELINE_CONTROLS
from faultbench.session import checkpoint_dir
from tests.fixture import fixture_tables


def scale(fault_id, column="amount_cents", factor=10, **count):
    return FaultSpec(fault_id, "numeric_scale", "raw_orders", {"column": column, "factor": factor, **(count or {"percent": 10})})


def camp(spark, faults, tables=None, **kw):
    return Campaign(spark, "unused", faults=faults, tables_in=tables or fixture_tables(spark), **kw)


def test_run_reports_the_loop(spark):
    c = camp(spark, (scale("big", factor=1000),))
    paths = c._paths
    r = c.run()
    assert r.mutated_rows == {"big": 12} and r.baseline_detected == () and r.detected == ("big",)
    assert r.generated == ("orders_amount_cents_reasonable",) and r.gaps == () and r.radius_mismatches == ()
    assert c._paths == [] and paths is not None


def test_broken_load_constraints_stop_the_run(spark):
    t = fixture_tables(spark)
    t["raw_orders"] = t["raw_orders"].union(t["raw_orders"].limit(1))
    with pytest.raises(CampaignFailed, match="orders_order_id_unique"):
        camp(spark, (scale("big"),), t).run()


def test_a_fault_that_changes_nothing_stops_the_run(spark):
    t = fixture_tables(spark)
    t["raw_orders"] = t["raw_orders"].withColumn("amount_cents", F.lit(0).cast("bigint"))
    with pytest.raises(CampaignFailed, match="changed nothing.*zero"):
        camp(spark, (scale("zero"),), t).run()


def test_an_open_gap_stops_a_strict_run_only(spark):
    keys = FaultSpec("keys", "join_key_corruption", "raw_orders", {"column": "customer_id", "percent": 10})
    with pytest.raises(CampaignFailed, match="stay open.*keys"):
        camp(spark, (keys,)).run()
    r = camp(spark, (keys,)).run(strict=False)
    assert r.gaps == ("keys",) and [f for f, _ in r.refused] == ["keys"]


def test_a_loud_generated_control_stops_the_run(spark):
    class Loud(Campaign):
        def _bound(self, column, value):
            return str(int(value) // 2)

    with pytest.raises(CampaignFailed, match="fire on clean"):
        Loud(spark, "unused", faults=(scale("big", factor=1000),), tables_in=fixture_tables(spark)).run()


def test_clean_failures_detect_nothing(spark):
    t = fixture_tables(spark)
    t["raw_orders"] = t["raw_orders"].withColumn("customer_id", F.expr("CASE WHEN order_id % 3 = 0 THEN NULL ELSE customer_id END"))
    surge = FaultSpec("surge", "null_density_surge", "raw_orders", {"column": "customer_id", "row_count": 5})
    c = camp(spark, (scale("big"), surge), t)
    try:
        m = {r["fault_id"]: r["detected"] for r in c.baseline_matrix().collect()}
        assert m == {"big": False, "surge": True}
        assert c.gaps == ("big",)
        assert [r["control_id"] for r in failing_on_clean(c.baseline_results).collect()] == ["orders_customer_id_not_null"]
    finally:
        c.close()


def test_matrix_needs_more_than_clean(spark):
    rows = [("clean", "a", 3), ("f", "a", 3), ("g", "a", 4), ("clean", "b", 0), ("f", "b", 0), ("g", "b", 1)]
    res = spark.createDataFrame(rows, "variant string, control_id string, violation_count long").withColumn("passed", F.col("violation_count") == 0)
    faults = spark.createDataFrame([("f", "x"), ("g", "x")], "fault_id string, kind string")
    got = {r["fault_id"]: r["failing_control_ids"] for r in detection_matrix(res, faults).collect()}
    assert got == {"f": "", "g": "a,b"}


def test_two_faults_share_a_bound_of_the_columns_type(spark):
    t = fixture_tables(spark)
    t["raw_orders"] = t["raw_orders"].selectExpr("*", "CAST(amount_cents / 100 AS DECIMAL(12,2)) AS exact", "amount_cents / 8D AS price")
    faults = tuple(scale(f"{c}-{n}", c, n) for c in ("exact", "price") for n in (100, 1000))
    c = camp(spark, faults, t)
    try:
        controls = {x.control_id: x for x in c.generated_controls}
        assert set(controls) == {"orders_exact_reasonable", "orders_price_reasonable"}
        assert "exact-100, exact-1000" in controls["orders_exact_reasonable"].description
        assert "AS DECIMAL(12,2))" in controls["orders_exact_reasonable"].predicate
        res = {(r["variant"], r["control_id"]): r["violation_count"] for r in c.control_results(c.generated_controls).collect()}
        assert all(n == 0 for (v, _), n in res.items() if v == "clean")
        assert res[("exact-1000", "orders_exact_reasonable")] > 0 and res[("price-1000", "orders_price_reasonable")] > 0
        assert res[("exact-1000", "orders_price_reasonable")] == 0
    finally:
        c.close()


def test_more_faults_than_a_mask_holds(spark):
    faults = tuple(scale(f"f{i}", factor=2 + i, row_count=3) for i in range(64))
    c = camp(spark, faults)
    try:
        res = c.control_results([BASELINE_CONTROLS[0]]).collect()
        assert len(res) == 65 and sorted(r["variant"] for r in res) == sorted(["clean", *(f.fault_id for f in faults)])
        assert c.mutation_evidence().count() == 64
        with pytest.raises(ValueError, match="2 blocks"):
            c.faulted
    finally:
        c.close()


def test_snapshot_compares_copies_with_their_source(spark, tmp_path):
    t = fixture_tables(spark)
    path = snapshot(spark, t, 1, str(tmp_path / "s"))
    assert set(require_verified(spark, path, list(t))) == set(t)
    t["raw_orders"].limit(3).write.mode("overwrite").parquet(f"{path}/raw_orders")
    with pytest.raises(SnapshotMismatch, match="raw_orders"):
        require_verified(spark, path, list(t))
    remove_snapshot(spark, path)
    assert not (tmp_path / "s").exists()
    unstable = t["raw_orders"].withColumn("amount_cents", F.expr("unix_micros(current_timestamp())"))
    with pytest.raises(SnapshotMismatch, match="differ from their sources"):
        snapshot(spark, {"raw_orders": unstable}, 1)


def test_written_tables_are_removed(spark):
    import os

    c = camp(spark, (scale("big"),))
    assert c.checksums().count() == 12
    paths = [p.removeprefix("file:") for p in c._paths]  # of the enriched table
    assert len(paths) == 1 and all(p.startswith(checkpoint_dir(spark).removeprefix("file:")) and os.path.isdir(p) for p in paths)
    c.close()
    assert not any(map(os.path.exists, paths))


def test_hot_keys_do_not_gather_in_customer_value_and_orphans(spark):
    """40 % NULL and 30 % one customer are summed on the map side before any shuffle on the key."""
    n = 40_000
    orders = spark.range(n, numPartitions=8).selectExpr(
        "id AS order_id",
        "CASE WHEN id % 10 < 4 THEN NULL WHEN id % 10 < 7 THEN 1 ELSE id % 5000 END AS customer_id",
        "timestampadd(SECOND, CAST(id AS INT), TIMESTAMP_NTZ'2024-01-01 00:00:00') AS order_ts",
        "id AS amount_cents", "'USD' AS currency", "DATE'2024-01-01' AS source_partition",
    )
    customers = spark.range(5000).selectExpr("id AS customer_id", "'n' AS customer_name", "'s' AS segment", "'c' AS country_code")
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        vs = VariantSet()
        tables = build_tables(customers, orders, vs)
        cv = tables["customer_value"]
        assert cv.agg(F.sum("order_count")).first()[0] == n
        from faultbench.operators.controls import evaluate_controls

        orphan = Control("o", "raw_orders", kind="orphan", columns=("customer_id",), parent_table="raw_customers", parent_columns=("customer_id",))
        for df in (cv, evaluate_controls(tables, vs, [orphan])):
            plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
            # every shuffle on the key carries aggregated rows, never plain orders
            lines = plan.split("\n")
            for i, line in enumerate(lines):
                if "Exchange hashpartitioning(customer_id" in line or "Exchange hashpartitioning(_k0" in line:
                    assert "HashAggregate" in lines[i + 1], lines[i + 1]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
