"""Sources: the driver's parquet tables, adapted to the order/customer shape.

The managed tables of a campaign are

    raw_customers(customer_id, customer_name, segment, country_code)
    raw_orders(order_id, customer_id, order_ts, amount_cents, currency, source_partition)

Two profiles map the TPC-H-like parquet onto them:

* ``orders``: ``orders`` rows; money is integer cents of ``o_totalprice``.
* ``events``: ``events`` rows (30 days of activity, the freshness profile);
  ``user_id`` is the customer key and ``event_type`` plays the currency.

Customers are ``customer`` joined to ``nation`` for the country; the planner
broadcasts ``nation`` from its measured size (no hint).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

PROFILES = ("orders", "events")

ORDER_COLUMNS = (
    "order_id",
    "customer_id",
    "order_ts",
    "amount_cents",
    "currency",
    "source_partition",
)
CUSTOMER_COLUMNS = ("customer_id", "customer_name", "segment", "country_code")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def raw_orders(spark: SparkSession, sf_dir: str, profile: str = "orders") -> DataFrame:
    """The ``raw_orders`` source table for a profile (column pruning reaches the scan)."""
    if profile == "orders":
        src = read_table(spark, sf_dir, "orders")
        return src.select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_orderdate").alias("order_ts"),
            F.round(F.col("o_totalprice") * 100).cast("bigint").alias("amount_cents"),
            F.lit("USD").alias("currency"),
            F.col("o_orderdate").cast("date").alias("source_partition"),
        )
    if profile == "events":
        src = read_table(spark, sf_dir, "events")
        return src.select(
            F.col("event_id").alias("order_id"),
            F.col("user_id").alias("customer_id"),
            F.col("ts").alias("order_ts"),
            F.round(F.col("value") * 100).cast("bigint").alias("amount_cents"),
            F.col("event_type").alias("currency"),
            F.col("ts").cast("date").alias("source_partition"),
        )
    raise ValueError(f"unknown profile {profile!r}; expected one of {PROFILES}")


def raw_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``raw_customers`` table: customers with their nation name as country."""
    customer = read_table(spark, sf_dir, "customer")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left").select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        F.col("c_mktsegment").alias("segment"),
        F.col("n_name").alias("country_code"),
    )


def source_tables(spark: SparkSession, sf_dir: str, profile: str = "orders") -> dict[str, DataFrame]:
    return {
        "raw_customers": raw_customers(spark, sf_dir),
        "raw_orders": raw_orders(spark, sf_dir, profile),
    }
