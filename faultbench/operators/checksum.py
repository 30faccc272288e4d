"""Order-independent multiset checksums and observed blast radius.

A table checksum is ``(row_count, sum of row hashes)``. Row hashes are hash60 of a
length-prefixed canonical text that starts with the table and column names. The sum
is a multiset digest: independent of row order and partitioning, duplicated rows
count twice (xor would cancel them), and one pass with partial aggregation suffices.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultbench.functions.hashing import (
    combine_parts_sql,
    hash60_sql,
    hash_parts_sql,
    row_text_sql,
    table_prefix,
)
from faultbench.operators.variants import (
    CLEAN,
    VariantSet,
    data_columns,
    per_variant,
    with_mask,
)


def row_hash_sql(df: DataFrame, table_name: str) -> str:
    """The hash of a row of ``df``, as SQL over its columns."""
    cols = data_columns(df)
    types = {f.name: f.dataType for f in df.schema.fields}
    return hash60_sql(row_text_sql(types, cols, table_prefix(table_name, cols)))


def _hashed(df: DataFrame, table_name: str, vs: VariantSet) -> DataFrame:
    """``(table_name, _vmask, _h)``: one row hash per stored row."""
    df = with_mask(df, vs)
    return df.selectExpr(f"'{table_name}' AS table_name", "_vmask", f"{row_hash_sql(df, table_name)} AS _h")


def table_checksums(tables: Mapping[str, DataFrame], vs: VariantSet | None = None) -> DataFrame:
    """``(variant, table_name, row_count, checksum)`` for every table and variant.

    All tables' row hashes are unioned and summed in one aggregate grouped by table:
    one shuffle stage for the whole table set, whatever its size.
    """
    vs = vs or VariantSet()
    hashed = None
    for name, df in tables.items():
        part = _hashed(df, name, vs)
        hashed = part if hashed is None else hashed.unionByName(part)
    # One row per table in no variant (mask 0): an empty table still reports
    # row_count 0 and checksum '0' for every variant.
    spark = hashed.sparkSession
    sentinel = spark.createDataFrame(
        [(name, 0, None) for name in tables], "table_name string, _vmask bigint, _h bigint"
    )
    hashed = hashed.unionByName(sentinel)
    hi, mid, lo = hash_parts_sql("_h")
    sums = per_variant(
        hashed,
        vs,
        [("row_count", "count", None), ("_h2", "sum", hi), ("_h1", "sum", mid), ("_h0", "sum", lo)],
        keys=["table_name"],
    )
    return sums.selectExpr(
        "variant",
        "table_name",
        "row_count",
        f"{combine_parts_sql('_h2', '_h1', '_h0')} AS checksum",
    )


def table_checksum(df: DataFrame, table_name: str, vs: VariantSet | None = None) -> DataFrame:
    return table_checksums({table_name: df}, vs)


def observed_blast_radius(checksums: DataFrame) -> DataFrame:
    """Per (fault variant, table): did the checksum or row count move off clean?

    The clean values are spread over the table's rows by a window over the checksum rows
    (one per variant and table), so the checksums are computed once. A table that only
    clean has is reported with a NULL fault.
    """
    per_table = Window.partitionBy("table_name")
    is_clean = F.col("variant") == CLEAN
    rows = checksums.select(
        F.when(~is_clean, F.col("variant")).alias("fault_id"),
        "table_name",
        F.max(F.when(is_clean, F.col("row_count"))).over(per_table).alias("clean_row_count"),
        F.when(~is_clean, F.col("row_count")).alias("fault_row_count"),
        F.max(F.when(is_clean, F.col("checksum"))).over(per_table).alias("_clean"),
        F.when(~is_clean, F.col("checksum")).alias("_fault"),
        F.count(F.when(~is_clean, 1)).over(per_table).alias("_faults"),
    )
    return rows.filter("fault_id IS NOT NULL OR _faults = 0").select(
        "fault_id",
        "table_name",
        "clean_row_count",
        "fault_row_count",
        (
            ~F.col("_fault").eqNullSafe(F.col("_clean"))
            | ~F.col("fault_row_count").eqNullSafe(F.col("clean_row_count"))
        ).alias("changed"),
    )


def compare_blast_radius(observed: DataFrame, predicted: DataFrame) -> DataFrame:
    """matched / missed / unexpected per (fault_id, table_name).

    ``observed``: output of :func:`observed_blast_radius`; ``predicted``:
    ``(fault_id, table_name)`` rows.
    """
    obs = observed.filter("changed").select("fault_id", "table_name", F.lit(True).alias("_obs"))
    pred = predicted.select("fault_id", "table_name", F.lit(True).alias("_pred"))
    j = obs.join(pred, ["fault_id", "table_name"], "full_outer")
    return j.select(
        "fault_id",
        "table_name",
        F.coalesce("_pred", F.lit(False)).alias("predicted"),
        F.coalesce("_obs", F.lit(False)).alias("observed"),
        F.when(F.col("_pred") & F.col("_obs"), "matched")
        .when(F.col("_pred"), "missed")
        .otherwise("unexpected")
        .alias("status"),
    )


def radius_summary(comparison: DataFrame) -> DataFrame:
    """One row per fault: counts per class and exact_match."""
    return comparison.groupBy("fault_id").agg(
        F.count(F.when(F.col("predicted"), 1)).alias("predicted_tables"),
        F.count(F.when(F.col("observed"), 1)).alias("observed_tables"),
        F.count(F.when(F.col("status") == "matched", 1)).alias("matched_tables"),
        F.count(F.when(F.col("status") == "missed", 1)).alias("missed_tables"),
        F.count(F.when(F.col("status") == "unexpected", 1)).alias("unexpected_tables"),
        (F.count(F.when(F.col("status") != "matched", 1)) == 0).alias("exact_match"),
    )


def changed_rows(
    table: DataFrame, vs: VariantSet, keys: Sequence[str], variant: str
) -> DataFrame:
    """Row-level radius: groups of a variant table whose values differ from clean.

    Rows shared by clean and the variant carry both bits and drop out; the rest are
    matched on the key with a null-safe full outer join.
    """
    table = with_mask(table, vs)
    cols = [c for c in data_columns(table) if c not in keys]
    cb, vb = vs.bit(CLEAN), vs.bit(variant)
    m = F.col("_vmask")
    only_clean = table.filter((m.bitwiseAND(F.lit(cb)) != 0) & (m.bitwiseAND(F.lit(vb)) == 0))
    only_var = table.filter((m.bitwiseAND(F.lit(vb)) != 0) & (m.bitwiseAND(F.lit(cb)) == 0))
    a = only_clean.select(
        *keys, *[F.col(c).alias(f"clean_{c}") for c in cols], F.lit(True).alias("_in_a")
    ).alias("a")
    b = only_var.select(
        *keys, *[F.col(c).alias(f"fault_{c}") for c in cols], F.lit(True).alias("_in_b")
    ).alias("b")
    cond = None
    for k in keys:
        e = F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        cond = e if cond is None else cond & e
    j = a.join(b, cond, "full_outer")
    return j.select(
        F.lit(variant).alias("fault_id"),
        *[F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in keys],
        *[F.col(f"clean_{c}") for c in cols],
        *[F.col(f"fault_{c}") for c in cols],
        F.when(F.col("_in_b").isNull(), "removed")
        .when(F.col("_in_a").isNull(), "added")
        .otherwise("changed")
        .alias("change"),
    )
