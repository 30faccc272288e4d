"""Data-quality controls and their evaluation over variant tables.

A control counts violations in one table; it passes iff the count is 0. Kinds:

* ``row``: a SQL boolean predicate per row (``customer_id IS NULL``). All row
  controls of a table, for all variants, become one aggregate with one conditional
  count per (control, variant): a single scan however many controls and faults.
* ``unique``: number of key values that occur more than once.
* ``orphan``: rows whose non-null key has no row in a parent table.
* ``behind``: groups whose latest date fell behind their mark (see ``groupwise``).
* ``null_share``: groups with more NULLs in a column than their share explains.

Predicates are plain SQL expressions over safe identifiers, so the same text runs
in Spark (``F.expr``) and in any SQL engine (the exported artifact).
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultbench.functions.hashing import sql_str
from faultbench.operators.variants import CLEAN, MASK, VariantSet, per_variant, with_mask

_IDENT = re.compile(r"^[a-z_][a-z0-9_]*$")


class ControlError(ValueError):
    pass


def safe_identifier(name: str) -> str:
    if not _IDENT.match(name or ""):
        raise ControlError(f"{name!r} is not a safe identifier")
    return name


@dataclass(frozen=True)
class Control:
    control_id: str
    target_table: str
    kind: str = "row"
    predicate: str | None = None
    columns: tuple[str, ...] = ()
    parent_table: str | None = None
    parent_columns: tuple[str, ...] = ()
    description: str = ""
    detects_faults: tuple[str, ...] = ()
    generated: bool = False
    # behind, null_share: the column looked at, and what is still in order
    measure: str | None = None
    slack: int = 0
    limit: int = 0

    def __post_init__(self) -> None:
        if self.kind not in ("row", "unique", "orphan", "behind", "null_share"):
            raise ControlError(f"unknown control kind {self.kind}")
        if self.kind == "row" and not self.predicate:
            raise ControlError("row controls need a predicate")
        for c in (*self.columns, *self.parent_columns):
            safe_identifier(c)

    def violation_sql(self) -> str:
        """The control as one SQL statement returning the violation count."""
        t = self.target_table
        if self.kind == "row":
            return f"SELECT count(*) AS violation_count FROM {t} WHERE {self.predicate}"
        if self.kind == "unique":
            cols = ", ".join(self.columns)
            return (
                "SELECT count(*) AS violation_count FROM ("
                f"SELECT {cols} FROM {t} GROUP BY {cols} HAVING count(*) > 1) AS d"
            )
        if self.kind == "behind":
            (g,), d = self.columns, self.measure
            return (
                f"SELECT greatest(count(*) - {self.limit}, 0) AS violation_count FROM {self.parent_table} AS m LEFT JOIN "
                f"(SELECT {g}, max({d}) AS latest FROM {t} GROUP BY {g}) AS l ON l.{g} IS NOT DISTINCT FROM m.{g} "
                f"WHERE l.latest IS NULL OR m._mark - l.latest > {self.slack}"
            )
        if self.kind == "null_share":
            g = ", ".join(self.columns) or "0"
            return (
                f"SELECT count(*) AS violation_count FROM (SELECT {g} AS g, count(*) FILTER (WHERE {self.measure} IS NULL) AS n "
                f"FROM {t} GROUP BY g) AS c LEFT JOIN {self.parent_table} AS l ON l._g IS NOT DISTINCT FROM c.g "
                "WHERE c.n > coalesce(l._limit, 0)"
            )
        on = " AND ".join(f"c.{a} = p.{b}" for a, b in zip(self.columns, self.parent_columns))
        nn = " AND ".join(f"c.{a} IS NOT NULL" for a in self.columns)
        return (
            f"SELECT count(*) AS violation_count FROM {t} AS c WHERE {nn} AND NOT EXISTS "
            f"(SELECT 1 FROM {self.parent_table} AS p WHERE {on})"
        )


def _row_controls(df: DataFrame, vs: VariantSet, controls: Sequence[Control]) -> DataFrame:
    # A row violates when the predicate is TRUE; NULL (unknown) does not violate.
    sums = per_variant(
        df, vs, [(f"c{i}", "count_true", f"({c.predicate})") for i, c in enumerate(controls)]
    )
    rows = ", ".join(
        f"named_struct('control_id', {sql_str(c.control_id)}, 'target_table', "
        f"{sql_str(c.target_table)}, 'violation_count', CAST(coalesce(c{i}, 0) AS BIGINT))"
        for i, c in enumerate(controls)
    )
    return sums.selectExpr("variant", f"inline(array({rows}))")


def _unique_control_wide(df: DataFrame, vs: VariantSet, c: Control) -> DataFrame:
    """Duplicate keys per variant: one shuffle on the key, one row per key and task."""
    df = with_mask(df, vs)
    per_key = df.groupBy(*c.columns).agg(
        *[F.count(F.when(vs.member(v), 1)).alias(f"_n{i}") for i, v in enumerate(vs.names)]
    )
    totals = per_key.agg(
        *[F.count(F.when(F.col(f"_n{i}") > 1, 1)).alias(f"_d{i}") for i in range(len(vs.names))]
    )
    rows = F.array(
        *[
            F.struct(F.lit(v).alias("variant"), F.col(f"_d{i}").cast("bigint").alias("violation_count"))
            for i, v in enumerate(vs.names)
        ]
    )
    return totals.select(F.explode(rows).alias("r")).select(
        "r.variant",
        F.lit(c.control_id).alias("control_id"),
        F.lit(c.target_table).alias("target_table"),
        "r.violation_count",
    )


def _orphan_control(df: DataFrame, parent: DataFrame, vs: VariantSet, c: Control) -> DataFrame:
    """Child rows whose key has no parent row in the same variant.

    Both sides are reduced first: parents to (key, OR of masks), children to a count per
    (key, mask), on the map side. A hot key is a few rows when it reaches the join.
    """
    keys = [f"_k{i}" for i in range(len(c.columns))]
    children = (
        with_mask(df, vs)
        .select(*[F.col(x).alias(k) for x, k in zip(c.columns, keys)], MASK)
        .dropna(subset=keys)
        .groupBy(*keys, MASK)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    parents = (
        with_mask(parent, vs)
        .select(*[F.col(x).alias(k) for x, k in zip(c.parent_columns, keys)], MASK)
        .groupBy(*keys)
        .agg(F.bit_or(MASK).alias("_pmask"))
    )
    orphans = children.join(parents, keys, "left").selectExpr(
        "_n", f"{MASK} & ~coalesce(_pmask, 0) AS {MASK}"
    )
    sums = per_variant(orphans, vs, [("violation_count", "sum", "_n")])
    return sums.select(
        "variant",
        F.lit(c.control_id).alias("control_id"),
        F.lit(c.target_table).alias("target_table"),
        F.coalesce("violation_count", F.lit(0)).cast("bigint").alias("violation_count"),
    )


def _group_control(tables: Mapping[str, DataFrame], vs: VariantSet, c: Control) -> DataFrame:
    from faultbench.operators.groupwise import behind_counts, null_share_results

    if c.parent_table not in tables:
        raise ControlError(f"{c.control_id}: unknown table {c.parent_table}")
    df, bounds = tables[c.target_table], tables[c.parent_table]
    if c.kind == "behind":
        behind = behind_counts(df, bounds, vs, c)
        counts = behind.select("variant", F.greatest(F.col("behind") - c.limit, F.lit(0)).alias("violation_count"))
    else:
        counts = null_share_results(df, bounds, vs, c.measure, c.columns[0] if c.columns else None)
    return counts.select(
        "variant",
        F.lit(c.control_id).alias("control_id"),
        F.lit(c.target_table).alias("target_table"),
        F.col("violation_count").cast("bigint").alias("violation_count"),
    )


def evaluate_controls(
    tables: Mapping[str, DataFrame], vs: VariantSet, controls: Sequence[Control]
) -> DataFrame:
    """``(variant, control_id, target_table, violation_count, passed)`` for all pairs."""
    ids = [c.control_id for c in controls]
    if len(set(ids)) != len(ids):
        raise ControlError("control ids must be unique")
    parts = []
    by_table: dict[str, list[Control]] = {}
    for c in controls:
        if c.target_table not in tables:
            raise ControlError(f"{c.control_id}: unknown table {c.target_table}")
        if c.kind == "row":
            by_table.setdefault(c.target_table, []).append(c)
        elif c.kind == "unique":
            parts.append(_unique_control_wide(tables[c.target_table], vs, c))
        elif c.kind in ("behind", "null_share"):
            parts.append(_group_control(tables, vs, c))
        else:
            if c.parent_table not in tables:
                raise ControlError(f"{c.control_id}: unknown parent {c.parent_table}")
            parts.append(_orphan_control(tables[c.target_table], tables[c.parent_table], vs, c))
    for name, group in by_table.items():
        parts.append(_row_controls(tables[name], vs, group))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("passed", F.col("violation_count") == 0)


def against_clean(results: DataFrame) -> DataFrame:
    """Results with ``clean_count``, the control's violations on the clean table, and
    ``detects``: it counts more violations on the variant than on clean. What was wrong
    before a fault says nothing about the fault."""
    clean = F.max(F.when(F.col("variant") == CLEAN, F.col("violation_count")))
    return results.withColumn(
        "clean_count", F.coalesce(clean.over(Window.partitionBy("control_id")), F.lit(0))
    ).withColumn("detects", (F.col("variant") != CLEAN) & (F.col("violation_count") > F.col("clean_count")))


def failing_on_clean(results: DataFrame) -> DataFrame:
    """``(control_id, target_table, violation_count)`` of controls that fail on clean data."""
    return results.filter((F.col("variant") == CLEAN) & ~F.col("passed")).select(
        "control_id", "target_table", "violation_count"
    )


def detection_matrix(results: DataFrame, faults: DataFrame) -> DataFrame:
    """Per fault: detecting controls (sorted, comma-joined), count and detected flag.

    ``faults``: ``(fault_id, kind)``. A control detects a fault when it counts more
    violations on its variant than on the clean table (see :func:`against_clean`).
    """
    per_fault = against_clean(results).filter("detects").groupBy(F.col("variant").alias("fault_id")).agg(
        F.concat_ws(",", F.sort_array(F.collect_list("control_id"))).alias("failing_control_ids"),
        F.count(F.lit(1)).alias("failing_controls"),
    )
    return faults.join(per_fault, "fault_id", "left").select(
        "fault_id",
        "kind",
        F.coalesce("failing_control_ids", F.lit("")).alias("failing_control_ids"),
        F.coalesce("failing_controls", F.lit(0)).cast("bigint").alias("failing_controls"),
        (F.coalesce("failing_controls", F.lit(0)) > 0).alias("detected"),
    )


def coverage(matrix: DataFrame, phase: str) -> DataFrame:
    return matrix.agg(
        F.lit(phase).alias("phase"),
        F.count(F.when(F.col("detected"), 1)).cast("bigint").alias("detected_faults"),
        F.count(F.lit(1)).cast("bigint").alias("total_faults"),
    ).withColumn(
        "coverage_pct",
        F.round(F.col("detected_faults") * 100.0 / F.col("total_faults"), 1),
    )
