"""Bounds by group: limits, gap histograms, marks and shares of NULL; repeated keys and NaN in campaigns."""

import math
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from faultbench.operators.controls import evaluate_controls
from faultbench.operators.faults import FaultSpec, apply_faults, mutation_evidence
from faultbench.operators.groupwise import (
    gap_histogram,
    marks,
    marks_control,
    most_expected,
    null_limits,
    null_share_control,
    profile_groups,
)
from faultbench.operators.variants import VariantSet, expand, only
from faultbench.plans.campaign import Campaign
from faultbench.plans.contract import DEFAULT_SEED, PRIMARY_KEYS, default_faults
from tests.conftest import SF_SMALL

ORDERS = "order_id bigint, customer_id bigint, order_ts timestamp_ntz, amount_cents bigint, currency string, source_partition date"


def test_limits_hold_their_false_alarm_rate():
    for expected in (0.0, 0.3, 2.0, 40.0):
        for rate in (0.1, 0.01, 1e-4):
            limit = most_expected(expected, rate)
            below = sum(math.exp(-expected) * expected**k / math.factorial(k) for k in range(limit + 1))
            assert 1 - below <= rate and limit >= expected - 1
    for bad in (0, 1, -1):
        with pytest.raises(ValueError):
            most_expected(1.0, bad)


def rows():
    draw = random.Random(8)
    out = []
    for i in range(300):
        day = date(2026, 1, 1) + timedelta(days=draw.randint(0, 400))
        out.append((draw.choice([*range(20), None]), day if draw.random() < 0.9 else None))
    return out


def test_gaps_and_marks_equal_brute_force(spark):
    data = rows()
    df = spark.createDataFrame(data, "g bigint, d date")
    by = {}
    for g, d in data:
        if d:
            by.setdefault(g, set()).add(d)
    gaps = [(b - a).days for own in by.values() for a, b in zip(sorted(own), sorted(own)[1:])]
    got = {r["gap"]: r["n"] for r in gap_histogram(df, "g", "d").collect()}
    assert got == {x: gaps.count(x) for x in set(gaps)}
    assert {r["g"]: r["_mark"] for r in marks(df, "g", "d").collect()} == {g: max(own) for g, own in by.items()}
    p = profile_groups(df, "g", "d", false_alarm=0.1)
    assert (p.groups, p.gaps) == (len(by), len(gaps))
    assert p.slack == sorted(gaps)[math.ceil(len(gaps) * 0.1) - 1]
    assert p.share == sum(x > p.slack for x in gaps) / len(gaps)
    none = profile_groups(df.limit(0), "g", "d")
    assert (none.groups, none.gaps, none.slack, none.share) == (0, 0, 0, 1.0)


def test_groups_behind_their_marks(spark):
    day = date(2026, 5, 1)
    clean = spark.createDataFrame([(i, day - timedelta(days=i)) for i in range(40)] + [(None, day)], "g bigint, d date")
    profile = profile_groups(clean, "g", "d")
    control = marks_control(profile, "t", "m")
    # half a year later: ten groups moved back, five are gone, the rest moved on
    now = clean.filter("g IS NULL OR g < 35").withColumn("d", F.when(F.col("g") < 10, F.date_sub("d", 20)).otherwise(F.date_add("d", 180)))
    for table, behind in ((clean, 0), (now, 15), (clean.limit(0), 41)):
        [r] = evaluate_controls({"t": table, "m": marks(clean, "g", "d")}, VariantSet(), [control]).collect()
        assert r["violation_count"] == max(0, behind - profile.limit)
        assert r["passed"] == (behind <= profile.limit)


def test_shares_of_null_by_group(spark):
    clean = spark.createDataFrame(
        [(g, None if i < nulls else i) for g, n, nulls in (("a", 1000, 0), ("b", 1000, 300), (None, 50, 1)) for i in range(n)],
        "g string, v bigint",
    )
    limits = {r["_g"]: r["_limit"] for r in null_limits(clean, "v", "g").collect()}
    assert limits["a"] < 15 and 300 < limits["b"] < 420 and 1 < limits[None] < 30
    surge = clean.withColumn("v", F.when((F.col("g") == "a") & (F.col("v") < 30), None).otherwise(F.col("v")))
    new = clean.union(spark.createDataFrame([("new", None)], "g string, v bigint"))
    control = null_share_control("v", "g", "t", "l")
    for table, n in ((clean, 0), (surge, 1), (new, 1)):
        [r] = evaluate_controls({"t": table, "l": null_limits(clean, "v", "g")}, VariantSet(), [control]).collect()
        assert r["violation_count"] == n
    assert null_limits(clean, "v", None).count() == 1


def test_orders_campaign_closes_every_gap_and_stays_silent_on_clean(spark):
    c = Campaign(spark, SF_SMALL, "orders")
    report = c.run()  # raises if a gap stays open or a control fires on clean data
    assert report.gaps == () and "orders_customer_id_not_behind" in report.generated and report.refused == ()


def test_null_surge_where_nulls_are_usual(spark):
    base = spark.range(2000).selectExpr(
        "id AS order_id", "if(id % 10 = 0, NULL, id % 50) AS customer_id", "TIMESTAMP_NTZ'2026-01-01 00:00:00' + make_dt_interval(CAST(id % 9 AS INT)) AS order_ts",
        "id AS amount_cents", "'USD' AS currency", "DATE'2026-01-01' AS source_partition",
    )
    customers = spark.range(50).selectExpr("id AS customer_id", "'x' AS customer_name", "'s' AS segment", "'c' AS country_code")
    surge = FaultSpec("surge", "null_density_surge", "raw_orders", {"column": "amount_cents", "percent": 10})
    c = Campaign(spark, "", faults=(surge,), tables_in={"raw_orders": base, "raw_customers": customers})
    assert c.gaps == ("surge",) and [k.control_id for k in c.group_controls] == ["orders_amount_cents_null_share"]
    assert c.refused() == []
    detected = {r["phase"]: r["detected"] for r in c.matrices().collect()}
    assert detected == {"baseline": False, "improved": True}
    c.close()


def test_stale_fault_where_a_key_is_the_latest_of_two_groups(spark):
    ts = datetime(2026, 7, 1)
    orders = [(1, 10, ts, 5, "USD", ts.date()), (1, 20, ts, 6, "USD", ts.date()), (2, 30, ts, 7, "USD", ts.date())]
    tables = {"raw_orders": spark.createDataFrame(orders, ORDERS)}
    stale = default_faults(100)[1]
    ft = apply_faults(tables, PRIMARY_KEYS, [stale], DEFAULT_SEED)
    assert sorted(map(tuple, only(ft.tables["raw_orders"], ft.variants, "clean").collect())) == sorted(orders)
    moved = expand(ft.tables["raw_orders"], ft.variants).filter("variant != 'clean'").collect()
    assert len(moved) == 3 and all(r["order_ts"] == ts - timedelta(days=45) for r in moved)
    assert mutation_evidence(ft, PRIMARY_KEYS).first()["mutated_rows"] == 3
    ft.release()


def test_bounds_come_from_finite_values(spark):
    prices = [1.5, 2.5, float("nan"), float("inf"), float("-inf"), None, *[3.0] * 30]
    orders = [(i, 1, datetime(2026, 7, 1), 5, "USD", date(2026, 7, 1), p) for i, p in enumerate(prices)]
    tables = {
        "raw_orders": spark.createDataFrame(orders, ORDERS + ", price double"),
        "raw_customers": spark.createDataFrame([(1, "a", "b", "c")], "customer_id bigint, customer_name string, segment string, country_code string"),
    }
    spec = FaultSpec("scale", "numeric_scale", "raw_orders", {"column": "price", "factor": 10, "percent": 90})
    c = Campaign(spark, "", faults=(spec,), tables_in=tables)
    assert c.clean_profile_frame(["scale"]).first()["value"] == "3.0"
    results = {r["variant"]: r["violation_count"] for r in c.control_results(c.generated_controls).collect()}
    assert results["scale"] > results["clean"] == 0
    c.close()


def test_marks_where_a_column_bound_detects_the_stale_fault(spark, tmp_path):
    """Customers whose only orders are of the first days fall below the least date; the marks are measured all the same."""
    import duckdb

    from faultbench.plans.queries import QUERIES, SQL

    day = datetime(1995, 1, 1)
    orders = [(i, i % 60, "O", 10.0 + i, day + timedelta(days=i % 60 if i % 60 < 40 else i), "5-LOW") for i in range(600)]
    for name, rows, schema in (
        ("orders", orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"),
        ("customer", [(i, f"c{i}", i % 5, 1.0, "A") for i in range(60)], "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        ("nation", [(i, f"n{i}", 0) for i in range(5)], "n_nationkey int, n_name string, n_regionkey int"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in ("orders", "customer", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    c = Campaign(spark, str(tmp_path), "orders")
    assert "stale-order-partitions-45d" not in c._open and c.group_controls == ()
    c.close()
    for name in ("group_control_results", "group_recall", "campaign_coverage_orders"):
        got = QUERIES[name](spark, str(tmp_path))
        want = con.execute(SQL[name])
        order = [d[0] for d in want.description]
        assert sorted(got.columns) == sorted(order)
        assert sorted(map(repr, map(tuple, got.select(*order).collect()))) == sorted(map(repr, want.fetchall()))
