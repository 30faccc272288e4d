"""The managed downstream tables (staging, marts, reporting), for any variant set.

Each builder accepts plain tables or variant tables (see ``variants``); with a
variant table every variant is rebuilt in the same job.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultbench.functions.hashing import qi
from faultbench.operators.variants import MASK, VariantSet, wide_aggregate, with_mask
from faultbench.session import remove_folder, scratch_path

# Managed tables in dependency order (fixed names of the campaign's data model).
SOURCE_TABLES = ("raw_customers", "raw_orders")
DERIVED_TABLES = ("orders_enriched", "daily_revenue", "customer_value", "executive_dashboard")
MANAGED_TABLES = SOURCE_TABLES + DERIVED_TABLES


ATTRIBUTES = ("customer_name", "segment", "country_code")


def join_customers(
    left: DataFrame, customers: DataFrame, vs: VariantSet, *, customers_vary: bool = False
) -> DataFrame:
    """Left join a variant table with ``customer_id`` to customers, for every variant.

    Returns the columns of ``left`` and the customer attributes. A row keeps NULL
    attributes in the variants in which no customer row has its key. The join strategy
    is left to AQE: broadcast when the customer side is small at runtime, otherwise a
    sort-merge join between two plain shuffles, whose hot or NULL key AQE can split.

    ``customers_vary`` must be set when a fault changes customer rows. Every key then
    gets one more customer row, without attributes, in the variants in which it has no
    row; so a left row emits its unmatched part once, however many customer rows share
    the key.
    """
    cols = [qi(c) for c in left.columns if c != MASK]
    attrs = [qi(a) for a in ATTRIBUTES]
    if not customers_vary:
        c = customers.selectExpr("customer_id AS _ck", *attrs)
        return left.join(c, F.col("customer_id") == F.col("_ck"), "left").selectExpr(*cols, *attrs, MASK)
    c = with_mask(customers, vs).selectExpr("customer_id AS _ck", *attrs, f"{MASK} AS _cm")
    absent = c.groupBy("_ck").agg(F.expr(f"{vs.all_mask} & ~bit_or(_cm) AS _cm")).filter("_cm != 0")
    c = c.unionByName(absent.selectExpr("_ck", *[f"CAST(NULL AS STRING) AS {a}" for a in attrs], "_cm"))
    joined = left.join(c, F.col("customer_id") == F.col("_ck"), "left")
    mask = f"CASE WHEN _cm IS NULL THEN {MASK} ELSE {MASK} & _cm END"
    return joined.selectExpr(*cols, *attrs, f"{mask} AS {MASK}").filter(f"{MASK} != 0")


def build_enriched(
    orders: DataFrame, customers: DataFrame, vs: VariantSet, *, customers_vary: bool = False
) -> DataFrame:
    """Orders with their customer's attributes; keeps orders without a customer."""
    return join_customers(with_mask(orders, vs), customers, vs, customers_vary=customers_vary).selectExpr(
        "order_id", "customer_id", *ATTRIBUTES, "order_ts", "CAST(order_ts AS DATE) AS order_date",
        "amount_cents", "currency", "source_partition", MASK,
    )


def daily_revenue(enriched: DataFrame, vs: VariantSet) -> DataFrame:
    return wide_aggregate(
        enriched,
        vs,
        ["order_date", "currency"],
        [("order_count", "count", None), ("revenue_cents", "sum", F.col("amount_cents"))],
    )


def customer_totals(rows: DataFrame, vs: VariantSet) -> DataFrame:
    """Totals per customer of an enriched variant table that is read, not joined, here: the
    map-side sums then collapse a hot or NULL key."""
    return wide_aggregate(
        rows,
        vs,
        ["customer_id", *ATTRIBUTES],
        [
            ("order_count", "count", None),
            ("lifetime_value_cents", "sum", F.col("amount_cents")),
            ("last_order_ts", "max", F.col("order_ts")),
        ],
    )


def customer_value(
    orders: DataFrame, customers: DataFrame, vs: VariantSet, *, customers_vary: bool = False
) -> DataFrame:
    """Totals per customer. NULL customer keys form one group, as in SQL GROUP BY.

    Orders are summed by key before the join, on the map side first, so a hot or NULL
    key is a few rows by the time it is shuffled or joined. Customer rows that share a
    key each get the key's totals; equal ones are summed.
    """
    per_key = wide_aggregate(
        with_mask(orders, vs),
        vs,
        ["customer_id"],
        [
            ("order_count", "count", None),
            ("lifetime_value_cents", "sum", F.col("amount_cents")),
            ("last_order_ts", "max", F.col("order_ts")),
        ],
    )
    return wide_aggregate(
        join_customers(per_key, customers, vs, customers_vary=customers_vary),
        vs,
        ["customer_id", *ATTRIBUTES],
        [
            ("order_count", "sum", F.col("order_count")),
            ("lifetime_value_cents", "sum", F.col("lifetime_value_cents")),
            ("last_order_ts", "max", F.col("last_order_ts")),
        ],
    )


def executive_dashboard(customer_value_df: DataFrame, vs: VariantSet) -> DataFrame:
    """Aggregate of an aggregate; a NULL-customer group counts as one customer."""
    return wide_aggregate(
        customer_value_df,
        vs,
        [],
        [
            ("active_customers", "count", None),
            ("total_orders", "sum", F.col("order_count")),
            ("total_revenue_cents", "sum", F.col("lifetime_value_cents")),
            ("latest_order_ts", "max", F.col("last_order_ts")),
        ],
        global_agg=True,
    )


def build_tables(
    customers: DataFrame, orders: DataFrame, vs: VariantSet, *, customers_vary: bool = False
) -> dict[str, DataFrame]:
    """All six managed tables as (lazy) variant tables."""
    customers = with_mask(customers, vs)
    orders = with_mask(orders, vs)
    enriched = build_enriched(orders, customers, vs, customers_vary=customers_vary)
    cv = customer_value(orders, customers, vs, customers_vary=customers_vary)
    return {
        "raw_customers": customers,
        "raw_orders": orders,
        "orders_enriched": enriched,
        "daily_revenue": daily_revenue(enriched, vs),
        "customer_value": cv,
        "executive_dashboard": executive_dashboard(cv, vs),
    }


def plain(df: DataFrame) -> DataFrame:
    """Drop the mask of a single-variant table."""
    return df.drop(MASK) if MASK in df.columns else df


@contextmanager
def written_tables(customers: DataFrame, orders: DataFrame) -> Iterator[dict[str, DataFrame]]:
    """The six clean tables; the joined one is written first and the marts derive from that copy,
    which goes at the end."""
    spark, vs = orders.sparkSession, VariantSet()
    path = scratch_path(spark, "enriched")
    try:
        joined = build_enriched(orders, customers, vs)
        joined.write.parquet(path)
        enriched = spark.read.schema(joined.schema).parquet(path)
        totals = customer_totals(enriched, vs)
        tables = {
            "raw_customers": customers,
            "raw_orders": orders,
            "orders_enriched": enriched,
            "daily_revenue": daily_revenue(enriched, vs),
            "customer_value": totals,
            "executive_dashboard": executive_dashboard(totals, vs),
        }
        yield {name: plain(df) for name, df in tables.items()}
    finally:
        remove_folder(spark, path)


#: How each derived table follows from the plain tables before it.
BUILDERS = {
    "orders_enriched": lambda t: plain(build_enriched(t["raw_orders"], t["raw_customers"], VariantSet())),
    "daily_revenue": lambda t: plain(daily_revenue(t["orders_enriched"], VariantSet())),
    "customer_value": lambda t: plain(customer_totals(t["orders_enriched"], VariantSet())),
    "executive_dashboard": lambda t: plain(executive_dashboard(t["customer_value"], VariantSet())),
}
