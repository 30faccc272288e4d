"""The campaign's fixed data model: tables, keys, lineage, controls, faults.

Fixed values (they define the behaviour to match):
  campaign seed 20260724;
  baseline controls orders_customer_id_not_null (raw_orders: customer_id IS NULL),
  orders_order_id_unique (raw_orders: order_id), daily_revenue_non_negative
  (daily_revenue: revenue_cents < 0);
  faults scale-order-amounts-100x (numeric_scale, amount_cents, factor 100),
  stale-order-partitions-45d (stale_partition, order_ts, source_partition, 45 days),
  null-customer-density-10pct (null_density_surge, customer_id);
  generated control ids orders_<column>_reasonable and orders_partition_not_stale.
Faults select 10 percent of their candidate rows.
"""

from __future__ import annotations

from faultbench.operators.controls import Control
from faultbench.operators.faults import (
    NULL_DENSITY_SURGE,
    NUMERIC_SCALE,
    STALE_PARTITION,
    FaultSpec,
)

DEFAULT_SEED = 20260724

PRIMARY_KEYS = {"raw_customers": "customer_id", "raw_orders": "order_id"}

# Table-level lineage (upstream, downstream).
TABLE_EDGES = (
    ("raw_customers", "orders_enriched"),
    ("raw_orders", "orders_enriched"),
    ("orders_enriched", "daily_revenue"),
    ("orders_enriched", "customer_value"),
    ("customer_value", "executive_dashboard"),
)

# Column-level lineage: (upstream table, column, downstream table, column). "*" is the
# row set: adding or removing rows of the upstream changes the marked downstream
# columns. Group keys feed every aggregate of their table (rows move between groups).
_CV_KEYS = ("customer_id", "customer_name", "segment", "country_code")
_CV_AGGS = ("order_count", "lifetime_value_cents", "last_order_ts")
_DR_AGGS = ("order_count", "revenue_cents")
COLUMN_EDGES = (
    ("raw_orders", "*", "orders_enriched", "*"),
    ("raw_orders", "order_id", "orders_enriched", "order_id"),
    ("raw_orders", "customer_id", "orders_enriched", "customer_id"),
    *[("raw_orders", "customer_id", "orders_enriched", a) for a in _CV_KEYS[1:]],
    *[("raw_customers", "customer_id", "orders_enriched", a) for a in _CV_KEYS[1:]],
    *[("raw_customers", "*", "orders_enriched", a) for a in _CV_KEYS[1:]],
    *[("raw_customers", a, "orders_enriched", a) for a in _CV_KEYS[1:]],
    ("raw_orders", "order_ts", "orders_enriched", "order_ts"),
    ("raw_orders", "order_ts", "orders_enriched", "order_date"),
    ("raw_orders", "amount_cents", "orders_enriched", "amount_cents"),
    ("raw_orders", "currency", "orders_enriched", "currency"),
    ("raw_orders", "source_partition", "orders_enriched", "source_partition"),
    *[("orders_enriched", k, "daily_revenue", k) for k in ("order_date", "currency")],
    *[("orders_enriched", k, "daily_revenue", a) for k in ("order_date", "currency", "*") for a in _DR_AGGS],
    ("orders_enriched", "amount_cents", "daily_revenue", "revenue_cents"),
    *[("orders_enriched", k, "customer_value", k) for k in _CV_KEYS],
    *[("orders_enriched", k, "customer_value", a) for k in (*_CV_KEYS, "*") for a in _CV_AGGS],
    ("orders_enriched", "amount_cents", "customer_value", "lifetime_value_cents"),
    ("orders_enriched", "order_ts", "customer_value", "last_order_ts"),
    *[("customer_value", k, "executive_dashboard", "active_customers") for k in (*_CV_KEYS, "*")],
    ("customer_value", "order_count", "executive_dashboard", "total_orders"),
    ("customer_value", "lifetime_value_cents", "executive_dashboard", "total_revenue_cents"),
    ("customer_value", "last_order_ts", "executive_dashboard", "latest_order_ts"),
)

# Declared schema contract (table, column, type, nullable).
SCHEMA_CONTRACT = (
    ("raw_customers", "customer_id", "BIGINT", False),
    ("raw_customers", "customer_name", "VARCHAR", True),
    ("raw_customers", "segment", "VARCHAR", True),
    ("raw_customers", "country_code", "VARCHAR", True),
    ("raw_orders", "order_id", "BIGINT", False),
    ("raw_orders", "customer_id", "BIGINT", True),
    ("raw_orders", "order_ts", "TIMESTAMP", True),
    ("raw_orders", "amount_cents", "BIGINT", True),
    ("raw_orders", "currency", "VARCHAR", True),
    ("raw_orders", "source_partition", "DATE", True),
    ("orders_enriched", "order_id", "BIGINT", True),
    ("orders_enriched", "customer_id", "BIGINT", True),
    ("orders_enriched", "customer_name", "VARCHAR", True),
    ("orders_enriched", "segment", "VARCHAR", True),
    ("orders_enriched", "country_code", "VARCHAR", True),
    ("orders_enriched", "order_ts", "TIMESTAMP", True),
    ("orders_enriched", "order_date", "DATE", True),
    ("orders_enriched", "amount_cents", "BIGINT", True),
    ("orders_enriched", "currency", "VARCHAR", True),
    ("orders_enriched", "source_partition", "DATE", True),
    ("daily_revenue", "order_date", "DATE", True),
    ("daily_revenue", "currency", "VARCHAR", True),
    ("daily_revenue", "order_count", "BIGINT", False),
    ("daily_revenue", "revenue_cents", "BIGINT", True),
    ("customer_value", "customer_id", "BIGINT", True),
    ("customer_value", "customer_name", "VARCHAR", True),
    ("customer_value", "segment", "VARCHAR", True),
    ("customer_value", "country_code", "VARCHAR", True),
    ("customer_value", "order_count", "BIGINT", False),
    ("customer_value", "lifetime_value_cents", "BIGINT", True),
    ("customer_value", "last_order_ts", "TIMESTAMP", True),
    ("executive_dashboard", "active_customers", "BIGINT", False),
    ("executive_dashboard", "total_orders", "BIGINT", True),
    ("executive_dashboard", "total_revenue_cents", "BIGINT", True),
    ("executive_dashboard", "latest_order_ts", "TIMESTAMP", True),
)

BASELINE_CONTROLS = (
    Control(
        "orders_customer_id_not_null",
        "raw_orders",
        predicate="customer_id IS NULL",
        detects_faults=(NULL_DENSITY_SURGE,),
    ),
    Control(
        "orders_order_id_unique",
        "raw_orders",
        kind="unique",
        columns=("order_id",),
    ),
    Control(
        "daily_revenue_non_negative",
        "daily_revenue",
        predicate="revenue_cents < 0",
    ),
)

# What must hold of the sources before any fault is injected: keys present and unique.
LOAD_CONTROLS = (
    Control("orders_order_id_not_null", "raw_orders", predicate="order_id IS NULL"),
    Control("orders_order_id_unique", "raw_orders", kind="unique", columns=("order_id",)),
    Control("customers_customer_id_not_null", "raw_customers", predicate="customer_id IS NULL"),
    Control("customers_customer_id_unique", "raw_customers", kind="unique", columns=("customer_id",)),
)

REF_INTEGRITY_CONTROL = Control(
    "orders_customer_exists",
    "raw_orders",
    kind="orphan",
    columns=("customer_id",),
    parent_table="raw_customers",
    parent_columns=("customer_id",),
)


def default_faults(percent: int = 10) -> tuple[FaultSpec, ...]:
    return (
        FaultSpec(
            "scale-order-amounts-100x",
            NUMERIC_SCALE,
            "raw_orders",
            {"column": "amount_cents", "factor": 100, "percent": percent},
        ),
        FaultSpec(
            "stale-order-partitions-45d",
            STALE_PARTITION,
            "raw_orders",
            {
                "timestamp_column": "order_ts",
                "partition_column": "source_partition",
                "group_column": "customer_id",
                "days": 45,
                "percent": percent,
            },
        ),
        FaultSpec(
            "null-customer-density-10pct",
            NULL_DENSITY_SURGE,
            "raw_orders",
            {"column": "customer_id", "percent": percent},
            expected_controls=("orders_customer_id_not_null",),
        ),
    )
