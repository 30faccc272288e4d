"""Smallest mutations against brute force over all factors, all row counts and all single keys left out."""

import hashlib
import random


import pytest
from pyspark.sql import functions as F

from faultbench.operators.controls import Control
from faultbench.operators.deltas import DeltaRebuild
from faultbench.operators.faults import FaultError, FaultSpec, apply_faults
from faultbench.operators.minimize import _numbered, critical_factors, critical_row_counts, minimal_rows
from faultbench.operators.variants import as_column
from faultbench.plans.contract import DEFAULT_SEED, PRIMARY_KEYS, REF_INTEGRITY_CONTROL, default_faults
from tests.fixture import fixture_rows, fixture_tables

SCALE = default_faults()[0]


def row(name, predicate, table="raw_orders"):
    return Control(name, table, predicate=predicate)


def tables_with(spark, orders):
    customers, _ = fixture_rows()
    plain = fixture_tables(spark)
    return {"raw_customers": plain["raw_customers"], "raw_orders": spark.createDataFrame(orders, plain["raw_orders"].schema)}


def brute_factors(orders, chosen, test):
    """``test``: violations of rows (order, scaled amount). Smallest detected and escaping factor of 2..1000."""
    clean = test([(o, o[3]) for o in orders])
    found = [None, None]
    for f in range(2, 1001):
        n = test([(o, o[3] if o[0] not in chosen or o[3] is None else o[3] * f) for o in orders])
        at = 0 if n > clean else 1
        found[at] = found[at] if found[at] is not None else f
    return tuple(found)


def per_row(check):
    return lambda rows: sum(1 for _, a in rows if a is not None and check(a))


def per_group(key, check):
    def test(rows):
        sums = {}
        for o, a in rows:
            have = sums.setdefault(key(o), [])
            if a is not None:
                have.append(a)
        return sum(1 for have in sums.values() if have and check(sum(have)))

    return test


def day(o):
    return (o[2].date(), o[4])


CASES = [
    (row("max", "amount_cents > 124365"), per_row(lambda a: a > 124365)),
    (row("half", "amount_cents >= 62000"), per_row(lambda a: a >= 62000)),
    (row("tiny", "amount_cents < 3000"), per_row(lambda a: a < 3000)),
    (row("low", "amount_cents <= -40000"), per_row(lambda a: a <= -40000)),
    (row("far", "amount_cents > 999999999"), per_row(lambda a: a > 999999999)),
    (row("other", "order_id > 5"), lambda rows: 0),
    (row("day", "revenue_cents > 1500000", "daily_revenue"), per_group(day, lambda s: s > 1500000)),
    (row("negative", "revenue_cents < 0", "daily_revenue"), per_group(day, lambda s: s < 0)),
    (row("customer", "lifetime_value_cents > 900000", "customer_value"), per_group(lambda o: o[1], lambda s: s > 900000)),
    (row("all", "total_revenue_cents > 20000000", "executive_dashboard"), per_group(lambda o: 0, lambda s: s > 20000000)),
]


@pytest.mark.parametrize("awkward", [False, True])
def test_critical_factors_equal_brute_force(spark, awkward):
    _, orders = fixture_rows()
    if awkward:  # refunds, zeros and missing amounts
        draw = random.Random(4)
        orders = [(*o[:3], draw.choice([o[3], -o[3], 0, None]), *o[4:]) for o in orders]
    tables = tables_with(spark, orders)
    ft = apply_faults(tables, PRIMARY_KEYS, [SCALE], DEFAULT_SEED)
    rebuild = DeltaRebuild(spark, tables, ft)
    chosen = {r[0] for r in ft.flagged["raw_orders"].filter(as_column(ft.plans[0].change.selected)).select("order_id").collect()}
    got = {r[0]: tuple(r)[1:] for r in critical_factors(rebuild, SCALE, [c for c, _ in CASES]).collect()}
    want = {c.control_id: brute_factors(orders, chosen, test) for c, test in CASES}
    rebuild.close()
    assert got == want
    assert got["far"] == (None, 2)  # never detected within the range
    assert not awkward and got["half"][1] is None or got["half"][0] is not None
    alone = critical_factors(DeltaRebuild(spark, tables, ft), SCALE, [CASES[0][0]]).collect()  # orders alone are read
    assert [tuple(r) for r in alone] == [("max", *want["max"])]
    with pytest.raises(FaultError):
        critical_factors(rebuild, default_faults()[2], [])


def test_factors_of_double_amounts(spark):
    tables = fixture_tables(spark)
    lines = tables["raw_orders"].withColumn("price", F.col("amount_cents") / 7)
    spec = FaultSpec("p", "numeric_scale", "raw_orders", {"column": "price", "factor": 2, "percent": 30})
    tables = tables | {"raw_orders": lines}
    ft = apply_faults(tables, PRIMARY_KEYS, [spec], DEFAULT_SEED)
    chosen = [r[0] for r in ft.flagged["raw_orders"].filter(as_column(ft.plans[0].change.selected)).select("price").collect()]
    for bound in (max(chosen) * 3, 1e6, 77777.7):
        [got] = critical_factors(DeltaRebuild(spark, tables, ft), spec, [row("c", f"price > {bound!r}D")]).collect()
        clean = sum(p > bound for p in chosen)
        hit = [f for f in range(2, 1001) if sum(f * p > bound for p in chosen) > clean]
        assert got["smallest_detected_factor"] == min(hit)


def test_critical_row_counts_equal_brute_force(spark):
    _, orders = fixture_rows()
    orders += [(7, 1, orders[0][2], 500, "USD", orders[0][5])] * 3  # a repeated key
    table = tables_with(spark, orders)["raw_orders"]
    for spec, control, gain in (
        (SCALE, row("max", "amount_cents > 12000000"), lambda o: o[3] * 100 > 12000000),
        (SCALE, row("tiny", "amount_cents < 3000"), lambda o: -(o[3] < 3000)),
        (SCALE, row("span", "amount_cents > 5000000 OR amount_cents < 20000"), lambda o: (o[3] * 100 > 5000000) - (o[3] < 20000)),
        (default_faults()[2], row("null", "customer_id IS NULL"), lambda o: 1),
    ):
        def rank(k, spec=spec):
            return int(hashlib.md5(f"{DEFAULT_SEED}:{spec.fault_id}:{k}".encode()).hexdigest()[:15], 16)

        found, total, rows = [None, None], 0, 0
        for k in sorted({o[0] for o in orders}, key=lambda k: (rank(k), k)):
            own = [o for o in orders if o[0] == k]
            total += sum(int(gain(o)) for o in own)
            at = 0 if total > 0 else 1
            found[at] = found[at] if found[at] is not None else rows + 1
            rows += len(own)
        [got] = critical_row_counts(table, "order_id", spec, [control], DEFAULT_SEED).collect()
        assert tuple(got)[1:] == tuple(found), control


def violations(orders, chosen, limit):
    sums = {}
    for o in orders:
        sums[day(o)] = sums.get(day(o), 0) + o[3] * (2 if o[0] in chosen else 1)
    return sum(s > limit for s in sums.values())


def test_minimal_rows_are_detected_and_no_fewer(spark):
    _, orders = fixture_rows()
    tables = fixture_tables(spark)
    spec = FaultSpec("double", "numeric_scale", "raw_orders", {"column": "amount_cents", "factor": 2, "percent": 80})
    limit = 1_000_000
    keys, n = minimal_rows(spark, tables, PRIMARY_KEYS, spec, [row("day", f"revenue_cents > {limit}", "daily_revenue")], DEFAULT_SEED)
    chosen = {r[0] for r in keys.collect()}
    clean = violations(orders, set(), limit)
    assert len(chosen) == n > 1 and violations(orders, chosen, limit) > clean
    assert all(violations(orders, chosen - {k}, limit) <= clean for k in chosen)


def test_minimal_rows_of_other_kinds(spark):
    tables = fixture_tables(spark)
    gone = FaultSpec("gone", "ref_integrity_break", "raw_customers", {"percent": 50})
    keys, n = minimal_rows(spark, tables, PRIMARY_KEYS, gone, [REF_INTEGRITY_CONTROL], DEFAULT_SEED)
    assert n == 1 and keys.count() == 1
    with pytest.raises(FaultError, match="not detected"):
        minimal_rows(spark, tables, PRIMARY_KEYS, SCALE, [REF_INTEGRITY_CONTROL], DEFAULT_SEED)


def test_numbers_of_keys(spark):
    keys = spark.range(500).selectExpr("id * 7 AS k")
    got = _numbered(keys, "k", buckets=8).collect()
    assert sorted(r["_chunk"] for r in got) == list(range(500)) and {r["k"] for r in got} == {7 * i for i in range(500)}


def test_latest_row_faults_have_no_row_count(spark):
    with pytest.raises(FaultError):
        critical_row_counts(fixture_tables(spark)["raw_orders"], "order_id", default_faults()[1], [row("x", "order_id > 1")], 1)
