"""Fault operators, stacking invariants, controls and spec validation."""

import pytest
from pyspark.sql import functions as F

from faultbench.operators.checksum import table_checksums
from faultbench.operators.controls import Control, ControlError, evaluate_controls
from faultbench.operators.faults import (
    DUPLICATE_KEYS,
    NUMERIC_SCALE,
    REF_INTEGRITY_BREAK,
    FaultError,
    FaultSpec,
    apply_faults,
    validate_spec,
)
from faultbench.operators.variants import VariantSet, expand, only, stack, RowChange, wide_aggregate
from faultbench.plans.contract import PRIMARY_KEYS, default_faults
from tests.fixture import fixture_tables


@pytest.fixture(scope="module")
def faulted(spark):
    return apply_faults(fixture_tables(spark), PRIMARY_KEYS, default_faults(percent=10), 20260724)


def test_clean_variant_is_untouched(spark, faulted):
    clean = fixture_tables(spark)["raw_orders"]
    got = only(faulted.tables["raw_orders"], faulted.variants, "clean")
    assert got.exceptAll(clean).count() == 0 and clean.exceptAll(got).count() == 0


def test_only_selected_rows_change(spark, faulted):
    clean = fixture_tables(spark)["raw_orders"]
    for pl in faulted.plans:
        v = only(faulted.tables["raw_orders"], faulted.variants, pl.spec.fault_id)
        changed = v.exceptAll(clean).select("order_id")
        chosen = faulted.flagged["raw_orders"].filter(pl.change.selected).select("order_id")
        # 10 % of 120 orders; the stale fault draws from the 30 latest-per-customer rows
        expected = 3 if pl.spec.kind == "stale_partition" else 12
        assert changed.count() == pl.selected_count == chosen.count() == expected
        assert changed.exceptAll(chosen).count() == 0


def test_checksums_order_independent_and_duplicate_sensitive(spark):
    df = spark.range(100).withColumn("v", F.col("id") % 7)
    a = table_checksums({"t": df}).collect()[0]
    b = table_checksums({"t": df.repartition(5).orderBy(F.desc("id"))}).collect()[0]
    c = table_checksums({"t": df.union(df.limit(1))}).collect()[0]
    assert a["checksum"] == b["checksum"] and a["row_count"] == 100
    assert c["checksum"] != a["checksum"] and c["row_count"] == 101


def test_stacked_equals_naive_expansion(spark):
    df = spark.range(50).select(F.col("id").alias("k"), (F.col("id") % 5).alias("g"))
    vs = VariantSet.of(["a", "b"])
    st = stack(df, vs, [
        RowChange("a", F.col("k") < 10, "update", {"g": F.lit(99)}),
        RowChange("b", F.col("k") % 2 == 0, "delete"),
    ])
    ex = {(r["variant"], r["k"], r["g"]) for r in expand(st, vs).collect()}
    want = {("clean", k, k % 5) for k in range(50)}
    want |= {("a", k, 99 if k < 10 else k % 5) for k in range(50)}
    want |= {("b", k, k % 5) for k in range(50) if k % 2}
    assert ex == want
    agg = wide_aggregate(st, vs, ["g"], [("n", "count", None)])
    got = {(r["variant"], r["g"], r["n"]) for r in expand(agg, vs).collect()}
    naive = {}
    for v, _, g in want:
        naive[(v, g)] = naive.get((v, g), 0) + 1
    assert got == {(v, g, n) for (v, g), n in naive.items()}


def test_duplicate_and_ref_integrity_faults_are_detected(spark):
    specs = (
        FaultSpec("dup", DUPLICATE_KEYS, "raw_orders", {"row_count": 3}),
        FaultSpec("drop", REF_INTEGRITY_BREAK, "raw_customers", {"row_count": 2}),
    )
    ft = apply_faults(fixture_tables(spark), PRIMARY_KEYS, specs, 5)
    controls = [
        Control("uniq", "raw_orders", kind="unique", columns=("order_id",)),
        Control("orphan", "raw_orders", kind="orphan", columns=("customer_id",),
                parent_table="raw_customers", parent_columns=("customer_id",)),
    ]
    res = {(r["variant"], r["control_id"]): r["violation_count"]
           for r in evaluate_controls(ft.tables, ft.variants, controls).collect()}
    assert res[("clean", "uniq")] == 0 and res[("dup", "uniq")] == 3
    assert res[("clean", "orphan")] == 0 and res[("drop", "orphan")] > 0


@pytest.mark.parametrize(
    "params,reason",
    [
        ({"column": "amount_cents", "factor": 1, "row_count": 1}, "factor"),
        ({"column": "amount_cents", "factor": 1001, "row_count": 1}, "factor"),
        ({"column": "currency", "factor": 10, "row_count": 1}, "type"),
        ({"column": "nope", "factor": 10, "row_count": 1}, "not a column"),
        ({"column": "amount_cents", "factor": 10}, "row_count or percent"),
        ({"column": "amount_cents", "factor": 10, "row_count": 1, "percent": 5}, "row_count or percent"),
        ({"column": "amount_cents", "factor": 10, "percent": 101}, "percent"),
        ({"column": "amount_cents", "factor": 10, "row_count": 1, "extra": 1}, "unexpected"),
    ],
)
def test_spec_validation(spark, params, reason):
    schema = fixture_tables(spark)["raw_orders"].schema
    reasons = validate_spec(FaultSpec("f", NUMERIC_SCALE, "raw_orders", params), schema, "order_id")
    assert any(reason in r for r in reasons), reasons


def test_row_count_beyond_available_is_refused(spark):
    spec = FaultSpec("f", NUMERIC_SCALE, "raw_orders", {"column": "amount_cents", "factor": 10, "row_count": 121})
    with pytest.raises(Exception):
        apply_faults(fixture_tables(spark), PRIMARY_KEYS, [spec], 1)
    with pytest.raises(FaultError):
        apply_faults(fixture_tables(spark), PRIMARY_KEYS, [spec, spec], 1)


def test_control_identifiers_are_checked():
    with pytest.raises(ControlError):
        Control("c", "t", kind="unique", columns=("bad name",))


def test_stale_fault_with_text_keys_joined_either_way(spark):
    t = fixture_tables(spark)
    orders = t["raw_orders"].withColumn("order_id", F.concat(F.lit("o-"), F.col("order_id").cast("string")))
    specs = [s for s in default_faults(percent=40) if s.kind == "stale_partition"]
    got = []
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for threshold in ("10m", "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            ft = apply_faults({"raw_orders": orders}, PRIMARY_KEYS, specs, 9)
            got.append(sorted(map(str, expand(ft.tables["raw_orders"], ft.variants).collect())))
            assert ft.plans[0].selected_count == 12  # 40 % of the 30 latest rows
            ft.release()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got[0] == got[1]


def test_fault_kinds_can_be_added(spark):
    from faultbench.operators import faults as FM

    kind = FM.FaultKind(
        "blank_text", {"column": FM.column_of(FM.T.StringType)}, changes=("column",),
        updates=lambda p: {str(p["column"]): "''"}, needs="column",
    )
    FM.register_fault(kind)
    try:
        with pytest.raises(FaultError):
            FM.register_fault(kind)
        spec = FaultSpec("blank", "blank_text", "raw_orders", {"column": "currency", "row_count": 5})
        ft = apply_faults(fixture_tables(spark), PRIMARY_KEYS, [spec], 1)
        assert only(ft.tables["raw_orders"], ft.variants, "blank").filter("currency = ''").count() == 5
        assert spec.changed_columns == ("currency",)
    finally:
        del FM.FAULT_KINDS["blank_text"]


def test_payload_rename_is_top_level_only(spark):
    rows = [(1, '{"k": 1, "n": {"k": "\\"k\\": 2"}}'), (2, "[1]"), (3, "not json"), (4, '{"k": 1, "j": 2}'), (5, '{"a": [{"k": 0}]}'), (6, None)]
    df = spark.createDataFrame(rows, "event_id long, props string")
    spec = FaultSpec("r", "payload_key_rename", "events", {"column": "props", "key": "k", "new_key": "j", "percent": 100})
    ft = apply_faults({"events": df}, {"events": "event_id"}, [spec], 1)
    got = {r["event_id"]: r["props"] for r in only(ft.tables["events"], ft.variants, "r").collect()}
    import json

    assert json.loads(got[1]) == {"j": 1, "n": {"k": '"k": 2'}}
    assert {i: got[i] for i in (2, 3, 4, 5, 6)} == dict(rows[1:])


def test_scaling_keeps_decimal_and_double_types(spark):
    df = spark.range(50).selectExpr("id AS k", "CAST(id + 0.25 AS DECIMAL(8,2)) AS d", "id + 0.5D AS f")
    specs = [FaultSpec(c, NUMERIC_SCALE, "t", {"column": c, "factor": 10, "percent": 20}) for c in ("d", "f")]
    ft = apply_faults({"t": df}, {"t": "k"}, specs, 1)
    assert dict(ft.tables["t"].dtypes)["d"] == "decimal(8,2)"
    for c in ("d", "f"):
        changed = only(ft.tables["t"], ft.variants, c).exceptAll(df).collect()
        assert len(changed) == 10 and all(float(r[c]) == 10 * (r["k"] + (0.25 if c == "d" else 0.5)) for r in changed)


def test_dropped_duplicate_parent_keeps_each_order_once(spark):
    orders = fixture_tables(spark)["raw_orders"].filter("customer_id = 1").limit(4)
    assert orders.count() == 4
    parents = spark.createDataFrame(
        [(1, "a", "x", "DE"), (1, "b", "x", "DE"), (2, "c", "y", "FR")],
        "customer_id int, customer_name string, segment string, country_code string",
    )
    from faultbench.operators.downstream import build_enriched, customer_value

    vs = VariantSet.of(["drop"])
    st = stack(parents, vs, [RowChange("drop", "customer_id = 1", "delete")])
    e = build_enriched(orders, st, vs, customers_vary=True)
    assert only(e, vs, "clean").count() == 8 and only(e, vs, "drop").count() == 4
    assert only(e, vs, "drop").filter("customer_name IS NULL").count() == 4
    cv = customer_value(orders, st, vs, customers_vary=True)
    assert [r["order_count"] for r in only(cv, vs, "drop").collect()] == [4]
    assert sorted(r["customer_name"] for r in only(cv, vs, "clean").collect()) == ["a", "b"]


def test_unknown_fault_kind_is_refused(spark):
    schema = fixture_tables(spark)["raw_orders"].schema
    assert validate_spec(FaultSpec("f", "teleport_rows", "raw_orders", {"row_count": 1}), schema, "order_id") == [
        "unknown fault kind teleport_rows"
    ]
    with pytest.raises(FaultError):
        apply_faults(fixture_tables(spark), PRIMARY_KEYS, [FaultSpec("f", "teleport_rows", "raw_orders", {})], 1)


def test_wide_aggregate_with_null_measures(spark):
    rows = [(k, k % 3, None if k % 3 == 2 or (k % 2 and k % 3 == 1) else k) for k in range(30)]
    df = spark.createDataFrame(rows, "k int, g int, x int")
    vs = VariantSet.of(["a", "b"])
    st = stack(df, vs, [
        RowChange("a", "k < 6", "update", {"x": "NULL"}),
        RowChange("b", "g = 0", "delete"),
    ])
    agg = wide_aggregate(st, vs, ["g"], [("n", "count", None), ("s", "sum", F.col("x")), ("m", "max", F.col("x"))])
    got = {(r["variant"], r["g"], r["n"], r["s"], r["m"]) for r in expand(agg, vs).collect()}

    def naive(variant):
        out = {}
        for k, g, x in rows:
            if variant == "b" and g == 0:
                continue
            if variant == "a" and k < 6:
                x = None
            n, s, m = out.get(g, (0, None, None))
            out[g] = (n + 1, s if x is None else (s or 0) + x, m if x is None else max(m if m is not None else x, x))
        return {(variant, g, *v) for g, v in out.items()}

    assert got == naive("clean") | naive("a") | naive("b")


def test_checksum_of_empty_table(spark):
    empty = spark.range(0).withColumnRenamed("id", "k")
    vs = VariantSet.of(["a"])
    rows = {(r["variant"], r["table_name"]): (r["row_count"], r["checksum"])
            for r in table_checksums({"e": empty, "t": spark.range(3)}, vs).collect()}
    assert rows[("clean", "e")] == (0, "0") and rows[("a", "e")] == (0, "0")
    assert rows[("clean", "t")][0] == 3
