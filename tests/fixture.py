"""The reference's golden commerce fixture (30 customers, 120 orders), built in tests.

Fixed values: seed 20260724; segments enterprise, mid_market, small_business;
countries US, CA, GB, DE; names "Customer NNN"; orders start 2026-07-01 08:00 and
draw customer 1..30, day 0..13, hour 0..11, minute 0..59, amount 1500..125000 from
one seeded generator in that order; currency USD; partition = order date.
"""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

SEED = 20260724
SEGMENTS = ("enterprise", "mid_market", "small_business")
COUNTRIES = ("US", "CA", "GB", "DE")
START = datetime(2026, 7, 1, 8, 0)


def fixture_rows(seed: int = SEED):
    customers = [
        (i, f"Customer {i:03d}", SEGMENTS[(i - 1) % 3], COUNTRIES[(i - 1) % 4]) for i in range(1, 31)
    ]
    draw = random.Random(seed)
    orders = []
    for order_id in range(1, 121):
        cust = draw.randint(1, 30)
        ts = START + timedelta(days=draw.randint(0, 13), hours=draw.randint(0, 11), minutes=draw.randint(0, 59))
        amount = draw.randint(1500, 125000)
        orders.append((order_id, cust, ts, amount, "USD", ts.date()))
    return customers, orders


def fixture_tables(spark: SparkSession, seed: int = SEED) -> dict[str, DataFrame]:
    customers, orders = fixture_rows(seed)
    return {
        "raw_customers": spark.createDataFrame(
            customers, "customer_id bigint, customer_name string, segment string, country_code string"
        ),
        "raw_orders": spark.createDataFrame(
            orders,
            "order_id bigint, customer_id bigint, order_ts timestamp_ntz, amount_cents bigint, "
            "currency string, source_partition date",
        ),
    }
