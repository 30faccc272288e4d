"""Catalog operators on payload fixtures: valid shapes pass, each mutation fails."""

import copy
import json

import pytest

from faultbench.operators import catalog as C
from faultbench.operators.faults import drift_schema
from faultbench.plans.contract import SCHEMA_CONTRACT

SRC = "urn:li:dataset:(urn:li:dataPlatform:spark,fb.raw_orders,DEV)"
DOWN = "urn:li:dataset:(urn:li:dataPlatform:spark,fb.orders_enriched,DEV)"


def page(urns, **over):
    d = {
        "facets": [], "hasMore": False, "offset": 0, "returned": len(urns), "total": len(urns),
        "searchResults": [{"entity": {"urn": u, "type": "DATASET"}, "degree": 1} for u in urns],
    }
    d.update(over)
    return {"downstreams": d}


def envelopes(spark, payloads):
    rows = [(SRC, json.dumps(p)) for p in payloads]
    return C.lineage_envelopes(spark.createDataFrame(rows, "source_urn string, payload string")).collect()


def test_lineage_valid_shapes(spark):
    ok, empty = envelopes(spark, [page([DOWN]), {"downstreams": {"facets": [], "total": 0}}])
    assert ok["violations"] == [] and ok["downstream_urns"] == [DOWN]
    assert empty["violations"] == [] and empty["downstream_urns"] == []


@pytest.mark.parametrize(
    "payload,violation",
    [
        ({"downstreams": {"facets": [], "total": 0}, "extra": 1}, "envelope"),
        ({"downstreams": {"facets": [], "total": 2}}, "empty_total_zero"),
        (page([DOWN], hasMore=True), "complete_page"),
        (page([DOWN], offset=1), "complete_page"),
        (page([DOWN], returned=2), "complete_page"),
        (page([DOWN], total=5), "complete_page"),
        ({"downstreams": {**page([DOWN])["downstreams"], "cursor": "x"}}, "shape"),
        (page(["urn:li:chart:1"]), "datasets_only"),
        (page([SRC]), "no_self"),
        (page([DOWN, DOWN]), "no_duplicates"),
    ],
)
def test_lineage_malformed(spark, payload, violation):
    [row] = envelopes(spark, [payload])
    assert violation in row["violations"]


def test_lineage_non_direct(spark):
    p = page([DOWN])
    p["downstreams"]["searchResults"][0]["degree"] = 2
    [row] = envelopes(spark, [p])
    assert "direct_only" in row["violations"]


def test_schema_fields_and_drift(spark):
    fields = [{"fieldPath": c, "nativeDataType": t.lower(), "nullable": n}
              for tb, c, t, n in SCHEMA_CONTRACT if tb == "raw_orders"]
    bad = copy.deepcopy(fields)
    del bad[0]["nullable"]
    rows = [("ok", json.dumps({"urn": "o", "total": len(fields), "fields": fields})),
            ("bad", json.dumps({"urn": "b", "total": len(bad), "fields": bad}))]
    flat = C.catalog_fields(spark.createDataFrame(rows, "k string, payload string"))
    valid = {r["urn"]: r["v"] for r in flat.groupBy("urn").agg({"valid": "min"}).withColumnRenamed("min(valid)", "v").collect()}
    assert valid == {"o": True, "b": False}
    contract = C.contract_frame(spark, [r for r in SCHEMA_CONTRACT if r[0] == "raw_orders"])
    observed = flat.filter("urn = 'o'").selectExpr("'raw_orders' AS table_name", "field_path AS field", "native_type", "nullable")
    assert {r["status"] for r in C.schema_drift(observed, contract).collect()} == {"ok"}


def test_schema_drift_classes(spark):
    from tests.fixture import fixture_tables

    orders = fixture_tables(spark)["raw_orders"]
    drifted = drift_schema(orders, rename={"amount_cents": "amount"}, retype={"customer_id": "int"})
    obs = C.observed_schema(spark, {"raw_orders": drifted.union(drifted).select(*drifted.columns)})
    contract = C.contract_frame(spark, [r for r in SCHEMA_CONTRACT if r[0] == "raw_orders"])
    st = {r["field"]: r["status"] for r in C.schema_drift(obs, contract, check_nullability=False).collect()}
    assert st["amount_cents"] == "missing" and st["amount"] == "extra"
    assert st["customer_id"] == "type_mismatch" and st["order_id"] == "ok"


def test_contract_vs_physical_type_drift(spark):
    # A contract typed HUGEINT against a physical BIGINT column is reported.
    contract = C.contract_frame(spark, [("dash", "total_orders", "HUGEINT", True)])
    observed = C.contract_frame(spark, [("dash", "total_orders", "BIGINT", True)]).withColumnRenamed("native_type", "native_type")
    [row] = C.schema_drift(observed, contract).collect()
    assert row["status"] == "type_mismatch"


POLICY = {
    "platform": "spark", "environment": "DEV", "domain_urn": "urn:li:domain:fb",
    "tag_urns": ["urn:li:tag:project", "urn:li:tag:sandbox"], "owner_urn": "urn:li:corpuser:qa",
    "owner_type": "DATAOWNER", "properties": {"sandbox": "true", "project_slug": "fb"},
}


def entity(urn, name):
    return {
        "urn": urn, "type": "DATASET", "name": name,
        "platform": {"urn": "urn:li:dataPlatform:spark", "name": "spark"}, "environment": "DEV",
        "domain": {"urn": "urn:li:domain:fb", "name": "d"},
        "tags": [{"urn": "urn:li:tag:sandbox", "name": "s"}, {"urn": "urn:li:tag:project", "name": "p"}],
        "owners": [{"urn": "urn:li:corpuser:qa", "type": "DATAOWNER"}],
        "properties": {"customProperties": {"sandbox": "true", "project_slug": "fb"}},
        "status": {"removed": False},
    }


@pytest.mark.parametrize(
    "mutate,failed",
    [
        (lambda e: None, None),
        (lambda e: e.update(name="other"), "name"),
        (lambda e: e["tags"].pop(), "tags"),
        (lambda e: e["properties"]["customProperties"].pop("sandbox"), "property:sandbox"),
        (lambda e: e.update(domain={"urn": "urn:li:domain:x", "name": "x"}), "domain"),
        (lambda e: e["owners"].append({"urn": "urn:li:corpuser:x", "type": "DATAOWNER"}), "owners"),
        (lambda e: e.update(status={"removed": True}), "status"),
        (lambda e: e.update(environment="PROD"), "environment"),
    ],
)
def test_governance(spark, mutate, failed):
    e = entity(SRC, "fb.raw_orders")
    mutate(e)
    ents = spark.createDataFrame([(json.dumps(e),)], "payload string")
    exp = spark.createDataFrame([(SRC, "fb.raw_orders", False)], "urn string, name string, removed boolean")
    [row] = C.catalog_governance(ents, exp, POLICY).collect()
    assert row["compliant"] == (failed is None)
    if failed:
        assert failed in row["failed_checks"]


def test_assertions_flatten_and_contract(spark):
    payload = {"dataset": {"urn": SRC, "assertions": {"total": 2, "assertions": [
        {"urn": "urn:li:assertion:a", "info": {"type": "CUSTOM", "description": "d", "customAssertion": {
            "type": "not_null", "entityUrn": SRC, "logic": "customer_id IS NULL"}},
         "runEvents": {"runEvents": [
             {"timestampMillis": 1, "result": {"type": "FAILURE", "nativeResults": [{"key": "v", "value": "3"}]}},
             {"timestampMillis": 5, "result": {"type": "SUCCESS", "nativeResults": [{"key": "v", "value": "0"}]}}]}},
        {"urn": "urn:li:assertion:b", "info": {"type": "CUSTOM", "description": "d", "customAssertion": {
            "type": "unique", "entityUrn": SRC, "logic": "changed"}}, "runEvents": {"runEvents": []}},
    ]}}}
    obs = C.catalog_assertions(spark.createDataFrame([(json.dumps(payload),)], "payload string"))
    rows = {r["assertion_urn"]: r for r in obs.collect()}
    assert rows["urn:li:assertion:a"]["latest_result"] == "SUCCESS"
    assert rows["urn:li:assertion:a"]["latest_native_results"] == {"v": "0"}
    exp = spark.createDataFrame(
        [("urn:li:assertion:a", "not_null", SRC, "customer_id IS NULL"),
         ("urn:li:assertion:b", "unique", SRC, "order_id"),
         ("urn:li:assertion:c", "row", SRC, "x")],
        "assertion_urn string, assertion_type string, entity_urn string, logic string")
    st = {r["assertion_urn"]: r["status"] for r in C.assertion_contract_check(obs, exp).collect()}
    assert st == {"urn:li:assertion:a": "ok", "urn:li:assertion:b": "contradictory", "urn:li:assertion:c": "missing"}


def test_urn_eligibility_and_gate(spark):
    urns = spark.createDataFrame([(SRC,), ("urn:li:dataset:(urn:li:dataPlatform:mysql,fb.x,DEV)",), ("bad",)], "urn string")
    res = {r["urn"]: r for r in C.urn_eligibility(urns, ["spark"], ["dev"], "fb.").collect()}
    assert res[SRC]["eligible"] and "platform_allowlisted" in res[urns.collect()[1][0]]["failed_checks"]
    assert "dataset_urn" in res["bad"]["failed_checks"]
    settings = {"enabled": True, "urn_prefix": "fb.", "platforms": ["spark"], "environments": ["DEV"],
                "paths": ["/data/x"], "marker_value": "true", "project_tag": "p", "sandbox_tag": "s"}
    target = "urn:li:dataset:(urn:li:dataPlatform:spark,fb.raw.orders,DEV)"
    base = dict(urn=target, schema_name="raw", table_name="orders", platform="spark", environment="DEV",
                path="/data/x", marker="true", tags=["p", "s"], approval_digest="a", manifest_digest="a")
    cases = [
        ({}, None), ({"approval_digest": "b"}, "approved_manifest"),
        ({"table_name": "other"}, "expected_name"),
        ({"platform": "mysql"}, "known_platform"), ({"environment": "PROD"}, "known_environment"),
        ({"path": "/elsewhere"}, "known_path"), ({"marker": "false"}, "marker"),
        ({"tags": ["s"]}, "tag_of_project"), ({"tags": ["p"]}, "tag_of_sandbox"),
    ]
    schema = ("urn string, schema_name string, table_name string, platform string, environment string, "
              "path string, marker string, tags array<string>, approval_digest string, manifest_digest string")
    manifest = spark.createDataFrame([(target,)], "urn string")
    for change, first in cases:
        row = {**base, **change}
        t = spark.createDataFrame([tuple(row[k] for k in base)], schema)
        [r] = C.injection_gate(t, manifest, settings).collect()
        assert r["first_failed_check"] == first, change
    t = spark.createDataFrame([tuple(base[k] for k in base)], schema)
    [r] = C.injection_gate(t, manifest.limit(0), settings).collect()
    assert r["first_failed_check"] == "listed_target"
    [r] = C.injection_gate(t, manifest, {**settings, "enabled": False}).collect()
    assert r["first_failed_check"] == "switched_on"


@pytest.mark.parametrize(
    "sql,failed",
    [
        ("SELECT count(*) FROM raw_orders WHERE amount_cents > 5;", ""),
        ("-- header\nSELECT count(*) FROM raw_orders", ""),
        ("", "not_empty"),
        ("DELETE FROM raw_orders", "read_only_select"),
        ("SELECT 1 FROM raw_orders; DROP TABLE raw_orders", "forbidden_operations_absent"),
        ("SELECT 1 FROM raw_orders; SELECT 2 FROM raw_orders", "single_statement"),
        ("SELECT * FROM other_table", "approved_relations_only"),
        ("SELECT * FROM raw_orders, raw_customers", "approved_relations_only"),
        ("SELECT * FROM raw_orders JOIN secrets ON 1=1", "approved_relations_only"),
    ],
)
def test_control_sql_lint(spark, sql, failed):
    df = spark.createDataFrame([("c", sql)], "control_id string, violation_sql string")
    [row] = C.control_sql_lint(df, ["raw_orders", "raw_customers"]).collect()
    if failed:
        assert failed in row["failed_checks"].split(",")
    else:
        assert row["passed"], row["failed_checks"]


def test_aspect_plan_and_tombstones(spark):
    ds = spark.createDataFrame([(f"u{i}",) for i in range(6)], "urn string")
    assert C.catalog_aspect_plan(ds, ["d", "t1", "t2"]).count() == 45
    allow = spark.createDataFrame([("a",), ("b",), ("c",)], "urn string")
    status = spark.createDataFrame([("a", True), ("b", False)], "urn string, removed boolean")
    got = {r["urn"]: r["action"] for r in C.tombstone_plan(allow, status).collect()}
    assert got == {"a": "already_removed", "b": "write_tombstone", "c": "not_found"}


def test_context_digest_ignores_capture_time_and_order(spark):
    a = spark.createDataFrame([("x", 1, "t1"), ("y", 2, "t1")], "k string, v int, captured_at string")
    b = spark.createDataFrame([("y", 2, "t9"), ("x", 1, "t9")], "k string, v int, captured_at string")
    da = C.context_digest({"entities": a})
    db = C.context_digest({"entities": b})
    assert da.collect() == db.collect()


def test_context_is_bound_to_the_tables(spark):
    from faultbench.operators.checksum import table_checksums

    context = C.context_digest({"entities": spark.createDataFrame([("u", 1)], "urn string, v int")})
    other = C.context_digest({"entities": spark.createDataFrame([("u", 2)], "urn string, v int")})
    sums = table_checksums({"t": spark.range(5)})
    changed = table_checksums({"t": spark.range(6)})
    stored = C.bound_context(context, sums)

    def compared(c, t):
        r = C.context_binding(stored, C.bound_context(c, t)).first()
        return r["same_context"], r["same_tables"], r["bound"]

    assert compared(context, table_checksums({"t": spark.range(5).repartition(3)})) == (True, True, True)
    assert compared(context, changed) == (True, False, False)
    assert compared(other, sums) == (False, True, False)


def test_assertion_gaps_and_ranking(spark):
    contract = C.contract_frame(spark, list(SCHEMA_CONTRACT))
    covered = spark.createDataFrame([("raw_orders", "customer_id"), ("raw_orders", "order_id")], "table_name string, field string")
    gaps = C.assertion_gaps(contract, covered)
    assert gaps.filter("table_name = 'raw_orders'").count() == 4
    sizes = spark.createDataFrame([("raw_orders", 5), ("raw_customers", 4)], "table_name string, closure_size int")
    top = C.target_ranking(sizes, gaps).first()
    assert top["table_name"] == "raw_orders" and top["score"] == 20


def test_lineage_edges_and_upstream_sets(spark):
    env = C.lineage_envelopes(spark.createDataFrame(
        [(SRC, json.dumps(page([DOWN]))), ("urn:x", json.dumps(page([SRC], hasMore=True)))],
        "source_urn string, payload string"))
    edges = C.lineage_edges(env).collect()
    assert [(r["source_urn"], r["downstream_urn"]) for r in edges] == [(SRC, DOWN)]
    observed = spark.createDataFrame([("a", "t"), ("b", "t")], "upstream string, downstream string")
    expected = spark.createDataFrame([("a", "t"), ("c", "t")], "upstream string, downstream string")
    st = {r["upstream"]: r["status"] for r in C.upstream_set_check(observed, expected).collect()}
    assert st == {"a": "ok", "b": "unexpected", "c": "missing"}


def test_recommended_conf_scales_partitions():
    from faultbench.session import recommended_conf

    small, big = recommended_conf(1 << 30), recommended_conf(100 << 40)
    assert int(small["spark.sql.shuffle.partitions"]) == 200
    assert int(big["spark.sql.shuffle.partitions"]) == (100 << 40) // (256 << 20)
