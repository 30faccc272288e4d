"""The campaign on the reference's 120-order fixture reproduces its published outcome."""

from datetime import date

import pytest

from faultbench.operators.faults import FaultSpec
from faultbench.plans.campaign import Campaign
from faultbench.plans.contract import default_faults
from faultbench.operators.downstream import MANAGED_TABLES, build_tables, plain
from faultbench.operators.variants import VariantSet
from tests.fixture import fixture_tables


def _fixture_faults():
    out = []
    for s in default_faults():
        p = {k: v for k, v in s.parameters.items() if k != "percent"}
        p["row_count"] = 12
        out.append(FaultSpec(s.fault_id, s.kind, s.target_table, p, s.expected_tables, s.expected_controls))
    return tuple(out)


@pytest.fixture(scope="module")
def camp(spark):
    c = Campaign(spark, "unused", faults=_fixture_faults(), tables_in=fixture_tables(spark))
    yield c
    c.close()


def test_table_counts(spark):
    t = build_tables(**{"customers": fixture_tables(spark)["raw_customers"],
                        "orders": fixture_tables(spark)["raw_orders"]}, vs=VariantSet())
    counts = {n: plain(t[n]).count() for n in MANAGED_TABLES}
    assert counts == {
        "raw_customers": 30,
        "raw_orders": 120,
        "orders_enriched": 120,
        "daily_revenue": 14,
        "customer_value": 30,
        "executive_dashboard": 1,
    }


def test_clean_profile_bounds(camp):
    prof = {r["statistic"]: r["value"] for r in camp.clean_profile_frame(
        [s.fault_id for s in camp.faults]).collect()}
    assert prof["max"] == "124365"
    assert prof["min"] == date(2026, 7, 1).isoformat()


def test_coverage_one_third_to_full(camp):
    rows = {r["phase"]: r for r in camp.coverage_report().collect()}
    assert (rows["baseline"]["detected_faults"], rows["baseline"]["total_faults"]) == (1, 3)
    assert rows["baseline"]["coverage_pct"] == 33.3
    assert (rows["improved"]["detected_faults"], rows["improved"]["coverage_pct"]) == (3, 100.0)


def test_each_fault_mutates_twelve_rows(camp):
    ev = {r["fault_id"]: r for r in camp.mutation_evidence().collect()}
    assert all(r["mutated_rows"] == 12 and r["changed"] for r in ev.values())


def test_violation_counts(camp):
    res = {(r["variant"], r["control_id"]): r["violation_count"] for r in camp.all_results().collect()}
    assert res[("null-customer-density-10pct", "orders_customer_id_not_null")] == 12
    assert res[("scale-order-amounts-100x", "orders_amount_cents_reasonable")] == 12
    assert res[("stale-order-partitions-45d", "orders_partition_not_stale")] == 12
    assert all(v == 0 for (variant, _), v in res.items() if variant == "clean")


def test_blast_radius_matches_prediction(camp):
    rows = camp.radius_comparison().collect()
    assert all(r["status"] == "matched" for r in rows)
    per = {}
    for r in rows:
        per.setdefault(r["fault_id"], set()).add(r["table_name"])
    assert len(per["scale-order-amounts-100x"]) == 5
    assert len(per["stale-order-partitions-45d"]) == 5
    assert per["null-customer-density-10pct"] == {
        "raw_orders", "orders_enriched", "customer_value", "executive_dashboard"
    }


@pytest.mark.parametrize("mode", ["checkpoint", "none"])
def test_materialize_modes_agree(spark, camp, mode):
    other = Campaign(spark, "unused", faults=_fixture_faults(), materialize=mode, tables_in=fixture_tables(spark))
    try:
        a = sorted(tuple(r) for r in camp.checksums().collect())
        b = sorted(tuple(r) for r in other.checksums().collect())
        assert a == b
        assert sorted(map(tuple, camp.coverage_report().collect())) == sorted(
            map(tuple, other.coverage_report().collect())
        )
    finally:
        other.close()


def test_campaign_evidence_is_write_once(spark, camp):
    import tempfile

    from faultbench.operators.snapshots import EvidenceConflict

    root = tempfile.mkdtemp(prefix="fb-evidence-")
    assert set(camp.write_evidence(root).values()) == {"written"}
    assert set(camp.write_evidence(root).values()) == {"identical"}
    other = Campaign(spark, "unused", faults=_fixture_faults(), tables_in=fixture_tables(spark, seed=7))
    try:
        with pytest.raises(EvidenceConflict):
            other.write_evidence(root)
    finally:
        other.close()
