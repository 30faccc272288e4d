"""Seeded selection: exact against brute force, partition-independent, bounded."""

import hashlib

import pytest
from pyspark.sql import functions as F

from faultbench.operators.selection import (
    Boundary,
    SelectionError,
    SelectionRequest,
    resolve_boundaries,
    selection_predicate,
)


def brute(keys, seed, salt, n):
    def rank(k):
        return int(hashlib.md5(f"{seed}:{salt}:{k}".encode()).hexdigest()[:15], 16)

    return sorted(sorted(keys, key=lambda k: (rank(k), k))[:n])


def selected(df, boundary, seed, salt):
    return sorted(r["k"] for r in df.filter(selection_predicate(boundary, seed, salt, "k")).collect())


@pytest.mark.parametrize("params,n", [({"row_count": 37}, 37), ({"percent": 10}, 500), ({"percent": 100}, 5000)])
def test_matches_brute_force(spark, params, n):
    df = spark.range(5000).withColumnRenamed("id", "k")
    [b] = resolve_boundaries([SelectionRequest(df, "k", 7, "f", dict(params))])
    assert selected(df, b, 7, "f") == brute(range(5000), 7, "f", n)


def test_null_keys_are_never_candidates(spark):
    df = spark.range(1000).select(F.when(F.col("id") >= 400, F.col("id")).alias("k"))  # 40 % NULL
    for params, n in (({"percent": 10}, 60), ({"row_count": 600}, 600)):
        [b] = resolve_boundaries([SelectionRequest(df, "k", 3, "x", dict(params))])
        assert (b.n, b.available) == (n, 600)
        assert selected(df, b, 3, "x") == brute(range(400, 1000), 3, "x", n)
    with pytest.raises(SelectionError, match="600 available"):
        resolve_boundaries([SelectionRequest(df, "k", 3, "x", {"row_count": 601})])


def test_repeated_keys_are_selected_whole(spark):
    df = spark.range(1_000_300).select(F.when(F.col("id") < 1_000_000, F.lit(7)).otherwise(F.col("id") % 100).alias("k"))
    rows = df.groupBy("k").count().collect()
    order = [k for k in brute(range(100), 5, "r", 100)]
    order.sort(key=lambda k: (int(hashlib.md5(f"5:r:{k}".encode()).hexdigest()[:15], 16), k))
    size = {r["k"]: r["count"] for r in rows}
    for n in (1, 10, 100):
        [b] = resolve_boundaries([SelectionRequest(df, "k", 5, "r", {"row_count": n})])
        chosen, total = [], 0
        for k in order:
            if total >= n:
                break
            chosen.append(k)
            total += size[k]
        assert b.n == total and b.available == 1_000_300
        assert sorted({r["k"] for r in df.filter(selection_predicate(b, 5, "r", "k")).distinct().collect()}) == sorted(chosen)


def test_text_decimal_and_date_keys(spark):
    df = spark.range(500).selectExpr(
        "concat('it''s ', id) AS t", "CAST(id AS DECIMAL(12,2)) AS d", "date_add(DATE'2020-01-01', CAST(id AS INT)) AS day"
    )
    reqs = [SelectionRequest(df, c, 9, "k", {"percent": "2.5"}) for c in df.columns]
    for c, b in zip(df.columns, resolve_boundaries(reqs)):
        assert b.n == 12 and df.filter(selection_predicate(b, 9, "k", c)).count() == 12


def test_double_keys_are_compared_as_doubles(spark):
    df = spark.range(400).selectExpr("id / 7 - 20.3D AS k", "CAST(id / 3 AS FLOAT) AS f", "id % 2 = 0 AS flag", "array(id) AS a")
    for n in (1, 13, 200):
        reqs = [SelectionRequest(df, c, 9, "k", {"row_count": n}) for c in ("k", "f")]
        for c, b in zip(("k", "f"), resolve_boundaries(reqs)):
            assert b.n == n and df.filter(selection_predicate(b, 9, "k", c)).count() == n
    with pytest.raises(SelectionError, match="list"):
        selection_predicate(Boundary(1, [1], 1, 1), 9, "k", "a")


def test_fractions_of_a_percent(spark):
    df = spark.range(8000).withColumnRenamed("id", "k")
    for p, n in ((0.05, 4), ("0.0125", 1), (99.9, 7992)):
        [b] = resolve_boundaries([SelectionRequest(df, "k", 1, "p", {"percent": p})])
        assert b.n == n
    for bad in (0, -1, 100.5, "x", True, None):
        with pytest.raises(SelectionError):
            resolve_boundaries([SelectionRequest(df, "k", 1, "p", {"percent": bad})])


def test_requests_share_one_scan_of_a_source(spark, tmp_path):
    spark.range(2000).withColumnRenamed("id", "k").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    from faultbench.operators.selection import _ranked

    reqs = [SelectionRequest(df, "k", i, "p", {"percent": 10}, eligible="k % 2 = 0" if i else None) for i in range(3)]
    plan = _ranked(list(enumerate(reqs)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    a, b, _ = resolve_boundaries(reqs)
    assert (a.available, b.available) == (2000, 1000)


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_partition_independent(spark, parts):
    df = spark.range(3000).withColumnRenamed("id", "k").repartition(parts)
    [b] = resolve_boundaries([SelectionRequest(df, "k", 11, "p", {"percent": 10})])
    assert selected(df, b, 11, "p") == brute(range(3000), 11, "p", 300)


def test_seed_changes_selection(spark):
    df = spark.range(3000).withColumnRenamed("id", "k")
    a, b = resolve_boundaries(
        [SelectionRequest(df, "k", 1, "p", {"row_count": 50}), SelectionRequest(df, "k", 2, "p", {"row_count": 50})]
    )
    assert selected(df, a, 1, "p") != selected(df, b, 2, "p")


def test_too_many_rows_is_an_error(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    with pytest.raises(SelectionError):
        resolve_boundaries([SelectionRequest(df, "k", 1, "p", {"row_count": 11})])
    with pytest.raises(SelectionError):
        resolve_boundaries([SelectionRequest(df.filter(F.lit(False)), "k", 1, "p", {"percent": 10})])
