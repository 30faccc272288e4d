"""Synthetic commerce tables of any size, derived from ``spark.range`` and a seed.

Every column is a pure function of (seed, row id) through hash60, so generation is
parallel, partition independent and reproducible; there is no sequential generator.
Used by tests and experiments only (registered queries read the driver's tables).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultbench.functions.hashing import hash60

# Segments and countries of the commerce fixture.
SEGMENTS = ("enterprise", "mid_market", "small_business")
COUNTRIES = ("US", "CA", "GB", "DE")


def _draw(seed: int, what: str, id_col: str, lo: int, hi: int):
    h = hash60(F.concat(F.lit(f"{seed}:{what}:"), F.col(id_col).cast("string")))
    return F.lit(lo) + F.pmod(h, F.lit(hi - lo + 1))


def synthetic_commerce(
    spark: SparkSession,
    n_customers: int,
    n_orders: int,
    seed: int,
    *,
    start: str = "2026-07-01 08:00:00",
    days: int = 14,
) -> dict[str, DataFrame]:
    customers = spark.range(1, n_customers + 1).select(
        F.col("id").alias("customer_id"),
        F.format_string("Customer %03d", F.col("id")).alias("customer_name"),
        F.element_at(F.array(*[F.lit(s) for s in SEGMENTS]), (F.pmod(F.col("id") - 1, F.lit(3)) + 1).cast("int")).alias("segment"),
        F.element_at(F.array(*[F.lit(c) for c in COUNTRIES]), (F.pmod(F.col("id") - 1, F.lit(4)) + 1).cast("int")).alias("country_code"),
    )
    base = F.expr(f"TIMESTAMP_NTZ'{start}'")
    minutes = _draw(seed, "day", "id", 0, days - 1) * 1440 + _draw(seed, "hour", "id", 0, 11) * 60 + _draw(
        seed, "minute", "id", 0, 59
    )
    ts = F.timestamp_add("MINUTE", minutes.cast("int"), base)
    orders = spark.range(1, n_orders + 1).select(
        F.col("id").alias("order_id"),
        _draw(seed, "customer", "id", 1, n_customers).cast("bigint").alias("customer_id"),
        ts.alias("order_ts"),
        _draw(seed, "amount", "id", 1500, 125000).cast("bigint").alias("amount_cents"),
        F.lit("USD").alias("currency"),
    ).withColumn("source_partition", F.col("order_ts").cast("date"))
    return {"raw_customers": customers, "raw_orders": orders}
