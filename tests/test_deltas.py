"""Rebuild by deltas against full rebuilds of every variant, and what it reads."""

import random
from datetime import date, datetime, timedelta

import pytest

from faultbench.operators.checksum import table_checksums
from faultbench.operators.deltas import DeltaRebuild
from faultbench.operators.downstream import DERIVED_TABLES, build_tables
from faultbench.operators.faults import FaultSpec, apply_faults
from faultbench.operators.variants import expand
from faultbench.plans.contract import DEFAULT_SEED, PRIMARY_KEYS, default_faults
from tests.conftest import SF_SMALL
from tests.fixture import fixture_tables
from tests.scans import rows_read

ORDERS = "order_id bigint, customer_id bigint, order_ts timestamp_ntz, amount_cents bigint, currency string, source_partition date"
CUSTOMERS = "customer_id bigint, customer_name string, segment string, country_code string"


def awkward_tables(spark, seed):
    """Null keys, amounts and dates, orders without a customer, customers that share a key, ties of the latest order."""
    draw = random.Random(seed)
    customers = [(i % 9 if i % 7 else None, f"c{i % 5}", "s", None) for i in range(14)]
    orders = []
    for i in range(80):
        ts = datetime(2026, 7, 1) + timedelta(days=draw.randint(0, 3))
        when = ts if draw.random() < 0.9 else None
        orders.append((i, draw.choice([*range(12), None]), when, draw.choice([None, 5, 5, 700]), draw.choice("ab"), date(2026, 7, 1)))
    orders += orders[:3]  # equal rows
    return {"raw_customers": spark.createDataFrame(customers, CUSTOMERS), "raw_orders": spark.createDataFrame(orders, ORDERS)}


def many_faults(draw):
    kinds = [
        ("numeric_scale", "raw_orders", {"column": "amount_cents", "factor": 3}),
        ("stale_partition", "raw_orders", dict(default_faults()[1].parameters, days=2, percent=50)),
        ("null_density_surge", "raw_orders", {"column": "customer_id"}),
        ("null_density_surge", "raw_orders", {"column": "amount_cents"}),
        ("null_density_surge", "raw_orders", {"column": "order_ts"}),
        ("join_key_corruption", "raw_orders", {"column": "customer_id"}),
        ("duplicate_keys", "raw_orders", {}),
        ("ref_integrity_break", "raw_orders", {}),
        ("ref_integrity_break", "raw_customers", {}),
        ("duplicate_keys", "raw_customers", {}),
        ("null_density_surge", "raw_customers", {"column": "segment"}),
    ]
    out = []
    for i, (kind, table, p) in enumerate(kinds):
        out.append(FaultSpec(f"f{i}", kind, table, {"percent": draw.choice([20, 60, 100]), **p}))
    return out


def assert_equal_to_rebuild(spark, tables, faults):
    ft = apply_faults(tables, PRIMARY_KEYS, faults, DEFAULT_SEED)
    vary = any(f.target_table == "raw_customers" for f in faults)
    full = build_tables(ft.tables["raw_customers"], ft.tables["raw_orders"], ft.variants, customers_vary=vary)
    rebuild = DeltaRebuild(spark, tables, ft)
    try:
        want = sorted(map(tuple, table_checksums(full, ft.variants).collect()))
        assert sorted(map(tuple, rebuild.checksums().collect())) == want
        for name in DERIVED_TABLES[1:]:
            got = sorted(map(str, expand(rebuild.mart(name), ft.variants).collect()))
            assert got == sorted(map(str, expand(full[name], ft.variants).select("variant", *[c for c in rebuild.mart(name).columns if c != "_vmask"]).collect()))
    finally:
        rebuild.close()
        ft.release()


@pytest.mark.parametrize("seed", [1])
def test_awkward_tables(spark, seed):
    assert_equal_to_rebuild(spark, awkward_tables(spark, seed), many_faults(random.Random(seed)))


def test_golden_fixture_and_sizes(spark):
    tables = fixture_tables(spark)
    assert_equal_to_rebuild(spark, tables, default_faults())
    ft = apply_faults(tables, PRIMARY_KEYS, default_faults(), DEFAULT_SEED)
    rebuild = DeltaRebuild(spark, tables, ft)
    sizes = {(r.variant, r.table_name): (r.removed, r.added) for r in rebuild.sizes().collect()}
    rebuild.close()
    null = "null-customer-density-10pct"
    assert sizes[null, "raw_orders"] == sizes[null, "orders_enriched"] == (12, 12)
    assert (null, "daily_revenue") not in sizes  # no effect: the delta ends there
    assert sizes["scale-order-amounts-100x", "executive_dashboard"] == (1, 1)


def test_empty_tables_and_no_faults(spark):
    tables = {"raw_customers": spark.createDataFrame([], CUSTOMERS), "raw_orders": spark.createDataFrame([], ORDERS)}
    assert_equal_to_rebuild(spark, tables, [])
    full = awkward_tables(spark, 3)
    assert_equal_to_rebuild(spark, full, [])
    only = FaultSpec("all-gone", "ref_integrity_break", "raw_orders", {"percent": 100})
    assert_equal_to_rebuild(spark, full, [only])


CODE = """
from faultbench.plans.campaign import Campaign
from faultbench.operators.faults import FaultSpec
from faultbench.plans.contract import default_faults
more = [FaultSpec(f"scale-{{i}}", "numeric_scale", "raw_orders", {{"column": "amount_cents", "factor": 2 + i, "percent": 5}}) for i in range({n})]
c = Campaign(spark, {sf!r}, "events", [*default_faults(), *more])
c.faulted
counted()
assert c.delta_checksums().count() == 6 * (4 + {n})
c.close()
"""


@pytest.mark.parametrize("more", [0, 20])
def test_sources_are_read_once_whatever_the_faults(more):
    assert rows_read(CODE.format(n=more, sf=SF_SMALL), SF_SMALL) == {"events": 1000, "customer": 150, "nation": 25}
