"""Smallest mutations that a control still detects, and that still escape it.

* ``critical_factors``: for a scale fault, the exact smallest whole factor of a range that each control
  detects and that escapes it. A scaled value ``u + f * s`` (a cell, or a sum with unscaled parts) is
  monotone in f, so each selected row or touched group changes its verdict at one factor at most. That
  factor is found by bisection with the control's own comparison, hence in the column's own
  arithmetic; counting rows by it gives the control's count at every factor of the range in one pass.
* ``critical_row_counts``: the same for the number of mutated rows, which are taken in rank order.
* ``minimal_rows``: a set of mutated rows that some control detects, and does not without any one of
  them, by delta debugging: chunks and their complements are variants of one table set, so a
  pass tries up to 60 of them.

A control detects a mutation when it counts more violations than on the clean table.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultbench.functions.hashing import key_rank_sql, qi
from faultbench.operators.controls import Control, against_clean, evaluate_controls
from faultbench.operators.deltas import CUSTOMER_KEYS, DAILY_KEYS, ENRICHED, FIRST, SELECTED, DeltaRebuild
from faultbench.operators.downstream import build_tables
from faultbench.operators.faults import FAULT_KINDS, NUMERIC_SCALE, FaultError, FaultSpec, apply_faults
from faultbench.operators.selection import BUCKET_BITS, RANK_BITS
from faultbench.operators.variants import MAX_VARIANTS, RowChange, VariantSet, as_column, stack
from faultbench.session import remove_folder, scratch_path

_COMPARISON = re.compile(r"^\s*`?([a-z_][a-z0-9_]*)`?\s*(<=|>=|<|>)\s*(.+?)\s*$", re.IGNORECASE | re.DOTALL)
#: Marts whose column is a sum of a scaled cell: (table, column) -> (group keys, cell).
SUMS = {
    ("daily_revenue", "revenue_cents"): (DAILY_KEYS, "amount_cents"),
    ("customer_value", "lifetime_value_cents"): (CUSTOMER_KEYS, "amount_cents"),
    ("executive_dashboard", "total_revenue_cents"): ((), "amount_cents"),
}


def _scaled(rows: DataFrame, v: int, column: str, control: Control) -> tuple[DataFrame, str] | None:
    """Rows (u, s) whose value at factor f is u + f * s, and the comparison; None: scaling can't change the verdict."""
    found = _COMPARISON.match(control.predicate or "")
    if control.kind != "row":
        return None
    if not found or re.search(r"\b(and|or|not)\b", control.predicate, re.IGNORECASE):
        if re.search(rf"\b{column}\b", control.predicate):
            raise FaultError(f"{control.control_id} is no comparison of one column")
        return None
    name, sign, bound = found.groups()
    chosen = f"{SELECTED} & {1 << v} != 0"
    if control.target_table in ("raw_orders", "orders_enriched"):
        if name != column:
            return None
        own = rows.filter(chosen) if control.target_table == "orders_enriched" else rows.filter(f"{chosen} AND {FIRST}")
        return own.selectExpr(f"{qi(name)} * 0 AS u", f"{qi(name)} AS s"), f"{sign} ({bound})"
    keys, cell = SUMS.get((control.target_table, name), (None, None))
    if keys is None or cell != column:
        return None
    parts = rows.selectExpr(*ENRICHED, f"{chosen} AS _own").groupBy(*keys).agg(
        F.expr(f"coalesce(sum(CASE WHEN NOT _own THEN {cell} END), 0) AS u"),
        F.expr(f"sum(CASE WHEN _own THEN {cell} END) AS s"),
    )
    return parts.filter("s IS NOT NULL").select("u", "s"), f"{sign} ({bound})"


def critical_factors(
    rebuild: DeltaRebuild, spec: FaultSpec, controls: Sequence[Control], lowest: int = 2, highest: int = 1000
) -> DataFrame:
    """(control_id, smallest_detected_factor, smallest_escaping_factor) within ``lowest`` to ``highest``.

    ``spec`` is a scale fault of ``rebuild``; its own factor plays no part. NULL: no factor of the range
    is detected, or none escapes. Controls that scaling can't reach detect none. If all controls are on the
    orders themselves, only these are read.
    """
    if spec.kind != NUMERIC_SCALE:
        raise FaultError(f"{spec.fault_id} has no factor")
    v, column = rebuild.variants.names.index(spec.fault_id), str(spec.parameters["column"])
    plain = all(c.target_table == "raw_orders" for c in controls)
    every = rebuild.selected_orders() if plain else rebuild.joined_orders
    parts, unreached = [], []
    for control in controls:
        found = _scaled(every, v, column, control)
        if found is None:
            unreached.append((control.control_id, None, lowest))
            continue
        rows, compare = found

        def violates(factor: str, compare: str = compare) -> str:
            return f"coalesce(u + {factor} * s {compare}, false)"

        rows = rows.selectExpr(
            "u", "s", f"{violates('1')} AS _clean", f"{violates(str(lowest))} AS _low", f"{violates(str(highest))} AS _high"
        ).filter("_low OR _high OR _clean")
        # First factor with the verdict of the highest: the half that holds it is kept.
        rows = rows.selectExpr("*", f"{lowest} AS _a", f"{highest} AS _b")
        for _ in range((highest - lowest).bit_length()):
            rows = rows.selectExpr("* EXCEPT (_a, _b)", "_a", "_b", "shiftright(_a + _b, 1) AS _m").selectExpr(
                "* EXCEPT (_a, _b, _m)",
                f"CASE WHEN {violates('_m')} = _high THEN _a ELSE least(_m + 1, _b) END AS _a",
                f"CASE WHEN {violates('_m')} = _high THEN _m ELSE _b END AS _b",
            )
        steps = [
            f"named_struct('f', {lowest}, 'n', CAST(_low AS INT) - CAST(_clean AS INT))",
            "CASE WHEN _low != _high THEN named_struct('f', _a, 'n', CASE WHEN _high THEN 1 ELSE -1 END) END",
        ]
        counted = rows.selectExpr(f"explode(array({', '.join(steps)})) AS _e").filter("_e IS NOT NULL")
        counted = counted.groupBy(F.col("_e.f").alias("f")).agg(F.sum("_e.n").alias("n"))
        parts.append(counted.select(F.lit(control.control_id).alias("control_id"), "f", "n"))
    spark = rebuild.spark
    reached = [c.control_id for c in controls if c.control_id not in {u[0] for u in unreached}]
    # A row for the lowest factor of each control; then at most one for each factor.
    steps = spark.createDataFrame([(c, lowest, 0) for c in reached], "control_id string, f int, n bigint")
    for part in parts:
        steps = steps.unionByName(part)
    steps = steps.groupBy("control_id", "f").agg(F.sum("n").alias("n"))
    running = Window.partitionBy("control_id").orderBy("f")
    more = steps.withColumn("more", F.sum("n").over(running) > 0)
    out = more.groupBy("control_id").agg(
        F.min(F.when(F.col("more"), F.col("f"))).alias("smallest_detected_factor"),
        F.min(F.when(~F.col("more"), F.col("f"))).alias("smallest_escaping_factor"),
    )
    rest = spark.createDataFrame(unreached, "control_id string, smallest_detected_factor int, smallest_escaping_factor int")
    return out.unionByName(rest)


def critical_row_counts(
    source: DataFrame, key: str, spec: FaultSpec, controls: Sequence[Control], seed: int
) -> DataFrame:
    """(control_id, smallest_detected_rows, smallest_escaping_rows): over every ``row_count`` the fault can have.

    For row controls on the fault's table. Keys are mutated in rank order, a repeated key as a whole;
    ``row_count`` n mutates keys until n rows are. Running counts are taken within rank buckets and
    moved by the totals of the buckets before, so no task holds more than a bucket.
    """
    kind, p = FAULT_KINDS[spec.kind], dict(spec.parameters)
    if kind.latest is not None:
        raise FaultError(f"{spec.fault_id} does not select rows by rank alone")
    salt = str(p.get("salt", spec.fault_id))
    candidates = source.filter(F.col(key).isNotNull())
    if kind.needs:
        candidates = candidates.filter(F.col(str(p[kind.needs])).isNotNull())
    updates, types = kind.updates(p), {f.name: f.dataType for f in source.schema.fields}
    now = {c: as_column(u).cast(types[c]) for c, u in updates.items()}
    rank = F.expr(f"{key_rank_sql(seed, salt, key)} + 1").alias("_rank")
    wide = candidates.select(
        rank, F.col(key).alias("_key"),
        F.struct(*source.columns).alias("was"),
        F.struct(*[now.get(c, F.col(c)).alias(c) for c in source.columns]).alias("now"),
    )
    part = None
    for control in controls:
        if control.kind != "row":
            raise FaultError(f"{control.control_id} is not a row control")
        before = wide.select("_rank", "_key", "now", "was.*").withColumn("_b", F.coalesce(F.expr(control.predicate), F.lit(False)))
        after = before.select("_rank", "_key", "_b", "now.*").withColumn("_a", F.coalesce(F.expr(control.predicate), F.lit(False)))
        gain = {
            "update": F.col("_a").cast("int") - F.col("_b").cast("int"),
            "delete": -F.col("_b").cast("int"),
            "insert": F.col("_a").cast("int"),
        }[kind.mode]
        keyed = after.groupBy("_rank", "_key").agg(F.sum(gain).alias("_gain"), F.count(F.lit(1)).alias("_rows"))
        keyed = keyed.withColumn("control_id", F.lit(control.control_id))
        part = keyed if part is None else part.unionByName(keyed)
    part = part.withColumn("_bucket", F.expr(f"shiftright(_rank, {RANK_BITS - BUCKET_BITS})"))
    within = Window.partitionBy("control_id", "_bucket").orderBy("_rank", "_key").rowsBetween(Window.unboundedPreceding, 0)
    inside = part.select(
        "control_id", "_bucket",
        F.sum("_gain").over(within).alias("_more"),
        (F.sum("_rows").over(within) - F.col("_rows")).alias("_before"),
    )
    totals = part.groupBy("control_id", "_bucket").agg(F.sum("_gain").alias("_g"), F.sum("_rows").alias("_r"))
    earlier = Window.partitionBy("control_id").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        "control_id", "_bucket",
        F.coalesce(F.sum("_g").over(earlier), F.lit(0)).alias("_g"),
        F.coalesce(F.sum("_r").over(earlier), F.lit(0)).alias("_r"),
    )
    placed = inside.join(totals, ["control_id", "_bucket"])
    rows, more = F.col("_before") + F.col("_r") + 1, F.col("_more") + F.col("_g") > 0
    return placed.groupBy("control_id").agg(
        F.min(F.when(more, rows)).alias("smallest_detected_rows"), F.min(F.when(~more, rows)).alias("smallest_escaping_rows")
    )


def _numbered(keys: DataFrame, key: str, buckets: int = 4096) -> DataFrame:
    """Distinct keys with a number of their own from 0 on: numbered within buckets, moved by the buckets before."""
    dealt = keys.select(key, F.pmod(F.xxhash64(key), F.lit(buckets)).alias("_b"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    moved = dealt.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    moved = moved.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_moved"))
    own = F.row_number().over(Window.partitionBy("_b").orderBy(key)) - 1
    return dealt.withColumn("_own", own).join(moved, "_b").select(key, (F.col("_own") + F.col("_moved")).cast("int").alias("_chunk"))


def minimal_rows(
    spark: SparkSession,
    sources: Mapping[str, DataFrame],
    keys: Mapping[str, str],
    spec: FaultSpec,
    controls: Sequence[Control],
    seed: int,
) -> tuple[DataFrame, int]:
    """Keys of a 1-minimal set of the fault's rows, and their number.

    Some control detects the set, and none does when any one key is left out. Raises FaultError if
    the whole fault is not detected. Rounds that keep a chunk shrink the set about thirtyfold.
    """
    ft = apply_faults(sources, keys, [spec], seed)
    (plan,), table, key = ft.plans, spec.target_table, keys[spec.target_table]
    ways, paths = (MAX_VARIANTS - 2) // 2, []

    def written(df: DataFrame) -> DataFrame:
        path = scratch_path(spark, "minimal")
        df.write.parquet(path)
        paths.append(path)
        return spark.read.schema(df.schema).parquet(path)

    def detected(chunked: DataFrame, picks: list[tuple[int, bool]]) -> list[bool]:
        """For each (chunk, whether it is left out): is the set detected?"""
        out: list[bool] = []
        for start in range(0, len(picks), MAX_VARIANTS - 1):
            some = picks[start : start + MAX_VARIANTS - 1]
            vs = VariantSet.of(f"v{i}" for i in range(len(some)))
            changes = [
                RowChange(f"v{i}", f"_chunk {'!=' if out_ else '='} {c}" if c >= 0 else "_chunk IS NOT NULL", plan.change.mode, plan.change.updates)
                for i, (c, out_) in enumerate(some)
            ]
            changes = [RowChange(ch.variant, f"coalesce({ch.selected}, false)", ch.mode, ch.updates) for ch in changes]
            joined = sources[table].join(chunked, key, "left")
            tables = dict(sources) | {table: stack(joined, vs, changes).drop("_chunk")}
            built = build_tables(tables["raw_customers"], tables["raw_orders"], vs, customers_vary=table == "raw_customers")
            found = against_clean(evaluate_controls(built, vs, controls)).filter("detects")
            names = {r["variant"] for r in found.select("variant").distinct().collect()}
            out += [f"v{i}" in names for i in range(len(some))]
        return out

    try:
        flagged = ft.flagged[table]
        now = written(flagged.filter(as_column(plan.change.selected)).select(key).distinct())
        size, parts = now.count(), 2
        if not detected(now.withColumn("_chunk", F.lit(0)), [(-1, False)])[0]:
            raise FaultError(f"{spec.fault_id} is not detected by any of the controls")
        round_ = 0
        while size > 1:
            # While they are many, try as many chunks as one pass holds; then exactly one key each, if need be.
            parts = min(size, max(parts, min(ways, size)))
            if parts == size:
                chunked = written(_numbered(now, key))
            else:
                number = F.pmod(F.xxhash64(key, F.lit(round_)), F.lit(parts)).cast("int")
                chunked = written(now.select(key, number.alias("_chunk")))
            round_ += 1
            hits = detected(chunked, [(i, False) for i in range(parts)])
            if any(hits):
                chosen, parts_next = F.col("_chunk") == hits.index(True), 2
            else:
                hits = detected(chunked, [(i, True) for i in range(parts)])
                if any(hits):
                    chosen, parts_next = F.col("_chunk") != hits.index(True), max(2, parts - 1)
                elif parts == size:
                    break
                else:
                    parts = min(size, 2 * parts)
                    continue
            left = written(chunked.filter(chosen).select(key))
            smaller = left.count()
            parts = parts_next if smaller < size else min(size, 2 * parts)  # an unlucky deal: all keys in one chunk
            now, size = left, smaller
        return spark.createDataFrame(now.collect(), now.schema) if size <= 1 << 16 else now.checkpoint(eager=True), size
    finally:
        ft.release()
        for path in paths:
            remove_folder(spark, path)
