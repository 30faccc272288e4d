"""Registered queries: Spark DataFrames and their independent SQL (DuckDB) forms.

Every query reads the driver's parquet tables in full. Campaign-level queries run on
the ``events`` profile (the freshness flagship); table-level ones on ``orders``.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultbench.functions.ordering import pack_sql, unpack_key_sql, unpack_ts_sql
from faultbench.operators import checksum as ck
from faultbench.operators.controls import Control, evaluate_controls
from faultbench.operators.deltas import DeltaRebuild
from faultbench.operators.faults import (
    DUPLICATE_KEYS,
    JOIN_KEY_CORRUPTION,
    NULL_DENSITY_SURGE,
    NUMERIC_SCALE,
    REF_INTEGRITY_BREAK,
    FaultSpec,
)
from faultbench.operators.groupwise import (
    FALSE_ALARM,
    WITHDRAWN,
    behind_counts,
    null_limits,
    null_share_control,
    profile_groups,
)
from faultbench.operators.downstream import BUILDERS, MANAGED_TABLES, build_tables, plain, written_tables
from faultbench.operators.minimize import critical_factors, critical_row_counts
from faultbench.operators.variants import VariantSet, as_column, expand, only
from faultbench.plans.campaign import Campaign
from faultbench.plans.contract import BASELINE_CONTROLS, LOAD_CONTROLS, PRIMARY_KEYS, REF_INTEGRITY_CONTROL
from faultbench.plans.lineage_contract import predicted_tables
from faultbench.plans.oracle import (
    COLUMNS,
    RAW_CUSTOMERS_SQL,
    Oracle,
    field_text,
    hash60,
    q,
    raw_orders_sql,
)
from faultbench.sources.tables import raw_customers, raw_orders, read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return deco


# -- campaigns (selection boundaries are resolved once while the files stay as they are) --
_CAMPAIGNS: OrderedDict[tuple, Campaign] = OrderedDict()
KEPT_CAMPAIGNS = 8

INTEGRITY_FAULTS = (
    FaultSpec("duplicate-order-keys-1pct", DUPLICATE_KEYS, "raw_orders", {"percent": 1}),
    FaultSpec(
        "corrupt-order-customer-keys-1pct",
        JOIN_KEY_CORRUPTION,
        "raw_orders",
        {"column": "customer_id", "percent": 1},
    ),
    FaultSpec("drop-customers-1pct", REF_INTEGRITY_BREAK, "raw_customers", {"percent": 1}),
)
INTEGRITY_CONTROLS = (BASELINE_CONTROLS[1], REF_INTEGRITY_CONTROL)

MIN_FACTORS = (2, 3, 5, 10, 20, 50, 100, 1000)
MINIMIZATION_FAULTS = tuple(
    FaultSpec(
        f"scale-amounts-{f}x",
        NUMERIC_SCALE,
        "raw_orders",
        {"column": "amount_cents", "factor": f, "percent": 10, "salt": "scale-grid"},
    )
    for f in MIN_FACTORS
)


def _stamp(spark: SparkSession, sf: str) -> tuple:
    """What tells one state of the source files from another: path, sizes and times."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for table in ("orders", "events", "customer", "nation", "lineitem"):
        path = jvm.org.apache.hadoop.fs.Path(f"{sf}/{table}.parquet")
        fs = path.getFileSystem(conf)
        if fs.exists(path):
            status = fs.getFileStatus(path)
            out.append((str(status.getPath()), status.getModificationTime(), fs.getContentSummary(path).getLength()))
    return tuple(out)


def campaign(spark: SparkSession, sf: str, profile: str = "events", faults=None, tables_in=None, name: str = "") -> Campaign:
    """The campaign over the files as they are now; the last few are kept, older ones closed."""
    app = spark.sparkContext.applicationId
    key = (app, _stamp(spark, sf), profile, name, None if faults is None else repr(tuple(faults)))
    if key in _CAMPAIGNS:
        _CAMPAIGNS.move_to_end(key)
        return _CAMPAIGNS[key]
    for old in [k for k in _CAMPAIGNS if k[0] != app]:  # their session has ended
        del _CAMPAIGNS[old]
    while len(_CAMPAIGNS) >= KEPT_CAMPAIGNS:
        _CAMPAIGNS.popitem(last=False)[1].close()
    kw = {} if faults is None else {"faults": tuple(faults)}
    _CAMPAIGNS[key] = Campaign(spark, sf, profile=profile, tables_in=tables_in, **kw)
    return _CAMPAIGNS[key]


def _rebuild(c: Campaign) -> DeltaRebuild:
    c.faulted  # one block
    return c.rebuilds[0]


EV = Oracle("events")
OR = Oracle("orders")
INT = Oracle("orders", INTEGRITY_FAULTS)
MIN = Oracle("events", MINIMIZATION_FAULTS)


def _clean_tables(spark: SparkSession, sf: str, profile: str = "orders") -> dict[str, DataFrame]:
    t = build_tables(raw_customers(spark, sf), raw_orders(spark, sf, profile), VariantSet())
    return {k: plain(v) for k, v in t.items()}


def _clean_sql(body: str) -> str:
    return OR.with_(body)


# -- S1 / S6 / S3: sources, counts, load constraints ------------------------------
register("source_orders", raw_orders_sql("orders"))(
    lambda spark, sf: raw_orders(spark, sf, "orders")
)
register("source_events_orders", raw_orders_sql("events"))(
    lambda spark, sf: raw_orders(spark, sf, "events")
)
register("source_customers", RAW_CUSTOMERS_SQL)(lambda spark, sf: raw_customers(spark, sf))


@register(
    "table_counts",
    _clean_sql(
        " UNION ALL ".join(
            f"SELECT {q(t)} AS table_name, count(*) AS row_count FROM v_{t} WHERE variant = 'clean'"
            for t in MANAGED_TABLES
        )
    ),
)
def table_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows counted in each table as it is built, so a builder that loses or doubles rows shows."""
    with written_tables(raw_customers(spark, sf), raw_orders(spark, sf, "orders")) as tables:
        counts = [
            table.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"))
            for name, table in tables.items()
        ]
        found = reduce(DataFrame.unionByName, counts)
        return spark.createDataFrame(found.collect(), found.schema)


def _control_sql(o: Oracle, c: Control, variants_table: str = "v_") -> str:
    t = f"{variants_table}{c.target_table}"
    head = f"SELECT variant, {q(c.control_id)} AS control_id, {q(c.target_table)} AS target_table"
    if c.kind == "row":
        return f"{head}, count(*) FILTER (WHERE {c.predicate}) AS violation_count FROM {t} GROUP BY variant"
    if c.kind == "unique":
        cols = ", ".join(c.columns)
        return (
            f"{head}, count(*) FILTER (WHERE n > 1) AS violation_count FROM (SELECT variant, "
            f"{cols}, count(*) AS n FROM {t} GROUP BY variant, {cols}) GROUP BY variant"
        )
    on = " AND ".join(f"ch.{a} = p.{b}" for a, b in zip(c.columns, c.parent_columns))
    nn = " AND ".join(f"ch.{a} IS NOT NULL" for a in c.columns)
    return (
        f"{head}, count(*) FILTER (WHERE {nn} AND NOT EXISTS (SELECT 1 FROM "
        f"{variants_table}{c.parent_table} AS p WHERE {on} AND p.variant = ch.variant)) "
        f"AS violation_count FROM {t} AS ch GROUP BY variant"
    )


def _results_sql(o: Oracle, controls) -> str:
    inner = " UNION ALL ".join(_control_sql(o, c) for c in controls)
    return f"SELECT *, violation_count = 0 AS passed FROM ({inner})"


@register(
    "load_constraint_check",
    _clean_sql(
        "SELECT control_id, target_table, violation_count, passed FROM ("
        + _results_sql(OR, LOAD_CONTROLS)
        + ") WHERE variant = 'clean'"
    ),
)
def load_constraint_check(spark: SparkSession, sf: str) -> DataFrame:
    tables = {
        "raw_orders": raw_orders(spark, sf, "orders"),
        "raw_customers": raw_customers(spark, sf),
    }
    res = evaluate_controls(tables, VariantSet(), LOAD_CONTROLS)
    return res.drop("variant")


# -- T1-T4: the managed downstream tables ------------------------------------------
for _t in ("orders_enriched", "daily_revenue", "customer_value", "executive_dashboard"):
    _cols = ", ".join(c for c, _ in COLUMNS[_t])
    register(_t, _clean_sql(f"SELECT {_cols} FROM v_{_t} WHERE variant = 'clean'"))(
        (lambda name: lambda spark, sf: _clean_tables(spark, sf)[name])(_t)
    )


# -- W1: latest order per customer --------------------------------------------------
@register(
    "latest_order_per_customer",
    _clean_sql(
        "SELECT customer_id, order_id, order_ts FROM raw_orders QUALIFY row_number() OVER "
        "(PARTITION BY customer_id ORDER BY order_ts DESC NULLS LAST, order_id DESC) = 1"
    ),
)
def latest_order_per_customer(spark: SparkSession, sf: str) -> DataFrame:
    """Hash aggregate over a packed (ts, key) decimal: no sort, no window."""
    o = raw_orders(spark, sf, "orders")
    ts_type = o.schema["order_ts"].dataType
    m = o.groupBy("customer_id").agg(F.expr(f"max({pack_sql('order_ts', ts_type, 'order_id')}) AS m"))
    return m.selectExpr(
        "customer_id", f"{unpack_key_sql('m')} AS order_id", f"{unpack_ts_sql('m', ts_type)} AS order_ts"
    )


# -- M1-M5, M8: faults on the orders profile ---------------------------------------
@register(
    "fault_key_selection",
    OR.with_(
        " UNION ALL ".join(
            f"SELECT {q(s.fault_id)} AS fault_id, k AS order_id FROM sel{i}"
            for i, s in enumerate(OR.faults)
        )
    ),
)
def fault_key_selection(spark: SparkSession, sf: str) -> DataFrame:
    """One scan: a row emits one entry for every fault that selected it."""
    plans = campaign(spark, sf, "orders").faulted.plans
    df = campaign(spark, sf, "orders").faulted.flagged["raw_orders"]
    chosen = [F.when(as_column(pl.change.selected), F.lit(pl.spec.fault_id)) for pl in plans]
    return df.select(F.explode(F.array(*chosen)).alias("fault_id"), "order_id").filter("fault_id IS NOT NULL")


_ORDER_COLS = ", ".join(c for c, _ in COLUMNS["raw_orders"])
for _key, _fid in (
    ("fault_numeric_scale", "scale-order-amounts-100x"),
    ("fault_stale_partition", "stale-order-partitions-45d"),
    ("fault_null_surge", "null-customer-density-10pct"),
):
    register(_key, OR.with_(f"SELECT {_ORDER_COLS} FROM v_raw_orders WHERE variant = {q(_fid)}"))(
        (lambda fid: lambda spark, sf: only(
            campaign(spark, sf, "orders").faulted.tables["raw_orders"],
            campaign(spark, sf, "orders").variants,
            fid,
        ))(_fid)
    )

register("stacked_variants", OR.with_("SELECT * FROM v_raw_orders"))(
    lambda spark, sf: expand(
        campaign(spark, sf, "orders").faulted.tables["raw_orders"],
        campaign(spark, sf, "orders").variants,
    )
)


def _evidence_sql(o: Oracle) -> str:
    types = dict(COLUMNS["raw_orders"])
    parts = []
    for i, s in enumerate(o.faults):
        key = PRIMARY_KEYS[s.target_table]
        changed = [c for c in s.changed_columns if c != "*"]
        cols = [key, *changed]
        before = " || ".join(["''"] + [field_text(c, types[c]) for c in cols])
        after_exprs = []
        for c in cols:
            m = o.mutated(s, c)
            expr = f"CAST({m} AS {types[c] if types[c] != 'VARCHAR' else 'VARCHAR'})" if m else c
            after_exprs.append(field_text(f"({expr})", types[c]))
        after = " || ".join(["''", *after_exprs])
        parts.append(
            f"SELECT {q(s.fault_id)} AS fault_id, {q(s.kind)} AS kind, {q(s.target_table)} AS "
            f"target_table, count(*) AS mutated_rows, COALESCE(CAST(sum(CAST({hash60(before)} AS "
            f"HUGEINT)) AS VARCHAR), '0') AS before_digest, COALESCE(CAST(sum(CAST({hash60(after)} "
            f"AS HUGEINT)) AS VARCHAR), '0') AS after_digest FROM {s.target_table} WHERE {key} IN "
            f"(SELECT k FROM sel{i})"
        )
    return o.with_(
        "SELECT *, before_digest <> after_digest AS changed FROM (" + " UNION ALL ".join(parts) + ")"
    )


register("mutation_evidence", _evidence_sql(OR))(
    lambda spark, sf: campaign(spark, sf, "orders").mutation_evidence()
)


# -- F1, B1-B3: checksums and blast radius -----------------------------------------
register("table_checksums", EV.with_("SELECT * FROM checksums", [EV.checksums_cte()]))(
    lambda spark, sf: campaign(spark, sf).checksums()
)
register("table_checksums_orders", OR.with_("SELECT * FROM checksums", [OR.checksums_cte()]))(
    lambda spark, sf: campaign(spark, sf, "orders").checksums()
)
register(
    "blast_radius_observed",
    EV.with_("SELECT * FROM observed", [EV.checksums_cte(), EV.observed_cte()]),
)(lambda spark, sf: campaign(spark, sf).observed_radius())


def _predicted_values(o: Oracle) -> str:
    rows = []
    for s in o.faults:
        for t in s.expected_tables or predicted_tables(s.target_table, s.changed_columns):
            rows.append(f"({q(s.fault_id)}, {q(t)})")
    return "predicted AS (SELECT * FROM (VALUES " + ", ".join(rows) + ") AS p(fault_id, table_name))"


COMPARE_BODY = (
    "SELECT COALESCE(p.fault_id, ob.fault_id) AS fault_id, COALESCE(p.table_name, "
    "ob.table_name) AS table_name, p.fault_id IS NOT NULL AS predicted, ob.fault_id IS NOT "
    "NULL AS observed, CASE WHEN p.fault_id IS NOT NULL AND ob.fault_id IS NOT NULL THEN "
    "'matched' WHEN p.fault_id IS NOT NULL THEN 'missed' ELSE 'unexpected' END AS status "
    "FROM predicted AS p FULL OUTER JOIN (SELECT fault_id, table_name FROM observed WHERE "
    "changed) AS ob ON p.fault_id = ob.fault_id AND p.table_name = ob.table_name"
)


def _compare_sql(o: Oracle, body: str = COMPARE_BODY) -> str:
    return o.with_(body, [o.checksums_cte(), o.observed_cte(), _predicted_values(o)])


register("blast_radius_compare", _compare_sql(EV))(
    lambda spark, sf: campaign(spark, sf).radius_comparison()
)
register("blast_radius_compare_orders", _compare_sql(OR))(
    lambda spark, sf: campaign(spark, sf, "orders").radius_comparison()
)


def _changed_daily_sql(o: Oracle, fid: str) -> str:
    return o.with_(
        f"SELECT {q(fid)} AS fault_id, COALESCE(a.order_date, b.order_date) AS order_date, "
        "COALESCE(a.currency, b.currency) AS currency, a.order_count AS clean_order_count, "
        "a.revenue_cents AS clean_revenue_cents, b.order_count AS fault_order_count, "
        "b.revenue_cents AS fault_revenue_cents, CASE WHEN b.ind IS NULL THEN 'removed' WHEN "
        "a.ind IS NULL THEN 'added' ELSE 'changed' END AS change FROM (SELECT *, TRUE AS ind "
        "FROM v_daily_revenue WHERE variant = 'clean') AS a FULL OUTER JOIN (SELECT *, TRUE AS "
        f"ind FROM v_daily_revenue WHERE variant = {q(fid)}) AS b ON a.order_date IS NOT "
        "DISTINCT FROM b.order_date AND a.currency IS NOT DISTINCT FROM b.currency WHERE "
        "a.ind IS NULL OR b.ind IS NULL OR a.order_count IS DISTINCT FROM b.order_count OR "
        "a.revenue_cents IS DISTINCT FROM b.revenue_cents"
    )


register("changed_daily_rows", _changed_daily_sql(EV, "stale-order-partitions-45d"))(
    lambda spark, sf: ck.changed_rows(
        campaign(spark, sf).tables["daily_revenue"],
        campaign(spark, sf).variants,
        ["order_date", "currency"],
        "stale-order-partitions-45d",
    )
)


# -- Q1-Q4 and the referential-integrity control -----------------------------------
for _key, _ctl in zip(
    ("control_not_null", "control_unique", "control_non_negative"), BASELINE_CONTROLS
):
    register(_key, EV.with_(_results_sql(EV, [_ctl])))(
        (lambda ctl: lambda spark, sf: campaign(spark, sf).control_results([ctl]))(_ctl)
    )
register("control_results_baseline", EV.with_(_results_sql(EV, BASELINE_CONTROLS)))(
    lambda spark, sf: campaign(spark, sf).control_results(BASELINE_CONTROLS)
)

LINEITEM_UNIQUE = Control(
    "lineitem_key_unique", "lineitem", kind="unique", columns=("l_orderkey", "l_linenumber")
)


@register(
    "control_unique_lineitem",
    "SELECT 'lineitem_key_unique' AS control_id, 'lineitem' AS target_table, count(*) AS "
    "violation_count, count(*) = 0 AS passed FROM (SELECT l_orderkey, l_linenumber FROM "
    "lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)",
)
def control_unique_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    res = evaluate_controls({"lineitem": read_table(spark, sf, "lineitem")}, VariantSet(), [LINEITEM_UNIQUE])
    return res.drop("variant")


# -- M9, M10, M12: integrity faults and their controls -----------------------------
def _integrity(spark: SparkSession, sf: str) -> Campaign:
    return campaign(spark, sf, "orders", INTEGRITY_FAULTS)


register(
    "fault_duplicate_keys",
    INT.with_(f"SELECT {_ORDER_COLS} FROM v_raw_orders WHERE variant = 'duplicate-order-keys-1pct'"),
)(lambda spark, sf: only(_integrity(spark, sf).faulted.tables["raw_orders"], _integrity(spark, sf).variants, "duplicate-order-keys-1pct"))
register(
    "fault_join_key_corruption",
    INT.with_(
        f"SELECT {_ORDER_COLS} FROM v_raw_orders WHERE variant = 'corrupt-order-customer-keys-1pct'"
    ),
)(lambda spark, sf: only(_integrity(spark, sf).faulted.tables["raw_orders"], _integrity(spark, sf).variants, "corrupt-order-customer-keys-1pct"))
register(
    "fault_ref_integrity",
    INT.with_(
        "SELECT customer_id, customer_name, segment, country_code FROM v_raw_customers "
        "WHERE variant = 'drop-customers-1pct'"
    ),
)(lambda spark, sf: only(_integrity(spark, sf).faulted.tables["raw_customers"], _integrity(spark, sf).variants, "drop-customers-1pct"))
register("control_ref_integrity", INT.with_(_results_sql(INT, INTEGRITY_CONTROLS)))(
    lambda spark, sf: _integrity(spark, sf).control_results(INTEGRITY_CONTROLS)
)
register(
    "integrity_checksums", INT.with_("SELECT * FROM checksums", [INT.checksums_cte()])
)(lambda spark, sf: _integrity(spark, sf).checksums())


# -- G1-G5, R1-R5: profile, generation, scoring (events campaign) ------------------
from faultbench.operators.controls import coverage as _coverage  # noqa: E402
from faultbench.operators.lineage import (  # noqa: E402
    RECORD_EDGES_SQL,
    closure,
    neighbor_counts,
    neighbors,
    path_counts,
    reach_sizes,
    record_edges,
)
from faultbench.operators.profile import column_profile as _column_profile  # noqa: E402
from faultbench.operators.snapshots import remove_snapshot, snapshot, verify_restore  # noqa: E402
from faultbench.operators.variants import CLEAN  # noqa: E402
from faultbench.plans.oracle import campaign_ctes, eligible_generators  # noqa: E402


def _camp_sql(o: Oracle, body: str, extra=(), more_ctes=(), more_results: str = "") -> str:
    return o.with_(body, [*campaign_ctes(o, _results_sql(o, BASELINE_CONTROLS), more_ctes, more_results), *extra])


register("clean_profile", _camp_sql(EV, "SELECT * FROM profile"))(
    lambda spark, sf: campaign(spark, sf).clean_profile_frame()
)


@register("measured_gaps", _camp_sql(EV, "SELECT fault_id, kind FROM gaps"))
def measured_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return campaign(spark, sf).baseline_matrix().filter(~F.col("detected")).select("fault_id", "kind")


def _generation_sql(o: Oracle) -> str:
    gen_rows = ", ".join(
        f"({q(fid)}, {q(cid)}, {q(op)})" for fid, _k, _c, _s, cid, op in eligible_generators(o)
    ) or "(NULL, NULL, NULL)"
    return _camp_sql(
        o,
        "SELECT g.fault_id, g.kind, e.control_id, p.column_name, CASE WHEN p.statistic = 'max' "
        "THEN p.column_name || ' > ' || p.value WHEN p.statistic = 'min' THEN p.column_name || "
        "' < DATE ''' || p.value || '''' END AS predicate, CASE WHEN p.fault_id IS NULL THEN "
        "'refused: no bounded generator for this kind and column type' ELSE 'generated' END AS "
        "status FROM gaps AS g LEFT JOIN profile AS p ON p.fault_id = g.fault_id LEFT JOIN "
        f"(SELECT * FROM (VALUES {gen_rows}) AS t(fault_id, control_id, op)) AS e ON "
        "e.fault_id = p.fault_id",
    )


@register("control_generation", _generation_sql(EV))
def control_generation(spark: SparkSession, sf: str) -> DataFrame:
    c = campaign(spark, sf)
    gaps = c.baseline_matrix().filter(~F.col("detected")).select("fault_id", "kind")
    prof = c.clean_profile_frame()
    j = gaps.join(prof, "fault_id", "left")
    is_max = F.col("statistic") == "max"
    return j.select(
        "fault_id",
        "kind",
        F.when(is_max, F.concat(F.lit("orders_"), F.col("column_name"), F.lit("_reasonable")))
        .when(F.col("statistic") == "min", F.lit("orders_partition_not_stale"))
        .alias("control_id"),
        "column_name",
        F.when(is_max, F.concat_ws(" > ", "column_name", "value"))
        .when(
            F.col("statistic") == "min",
            F.concat(F.col("column_name"), F.lit(" < DATE '"), F.col("value"), F.lit("'")),
        )
        .alias("predicate"),
        F.when(F.col("statistic").isNull(), "refused: no bounded generator for this kind and column type")
        .otherwise("generated")
        .alias("status"),
    )


register(
    "generated_control_results",
    _camp_sql(EV, "SELECT variant, control_id, target_table, violation_count, passed FROM gen"),
)(lambda spark, sf: campaign(spark, sf).all_results().filter("generated").drop("generated"))
register(
    "generated_controls_clean",
    _camp_sql(EV, "SELECT control_id, violation_count, passed FROM gen WHERE variant = 'clean'"),
)(
    lambda spark, sf: campaign(spark, sf)
    .all_results()
    .filter(F.col("generated") & (F.col("variant") == CLEAN))
    .select("control_id", "violation_count", "passed")
)
register("detection_matrix", _camp_sql(EV, "SELECT * FROM matrix"))(
    lambda spark, sf: campaign(spark, sf).matrices()
)
register("coverage_report", _camp_sql(EV, "SELECT * FROM coverage"))(
    lambda spark, sf: campaign(spark, sf).coverage_report()
)


def campaign_coverage_frame(c: Campaign) -> DataFrame:
    m = c.matrices()
    cov = _coverage(m.filter(F.col("phase") == "baseline"), "baseline").unionByName(
        _coverage(m.filter(F.col("phase") == "improved"), "improved")
    )
    return m.join(cov, "phase")


register(
    "campaign_coverage",
    _camp_sql(EV, "SELECT m.*, c.detected_faults, c.total_faults, c.coverage_pct FROM matrix AS m JOIN coverage AS c ON m.phase = c.phase"),
)(lambda spark, sf: campaign_coverage_frame(campaign(spark, sf)))
def _selected_counts(o: Oracle) -> str:
    return "selcounts AS (" + " UNION ALL ".join(
        f"SELECT {q(s.fault_id)} AS fault_id, count(*) AS mutated_rows FROM sel{i}"
        for i, s in enumerate(o.faults)
    ) + ")"


# -- G1, G3, G4 by group: marks and shares of NULL, for gaps that column bounds leave open --
MARKS_CONTROL = "orders_customer_id_not_behind"
STALE = "stale-order-partitions-45d"


def _limit_sql(expected: str, level: str) -> str:
    e, l = f"({expected})", f"({level})"  # noqa: E741
    return f"CAST(floor({e} + {l} / 3 + sqrt({l} * {l} / 9 + 2 * {e} * {l})) AS BIGINT)"


MARKS_CTES = [
    "marks AS (SELECT customer_id, max(source_partition) AS mark FROM raw_orders WHERE source_partition IS NOT NULL GROUP BY customer_id)",
    "days AS (SELECT DISTINCT customer_id, source_partition AS d FROM raw_orders WHERE source_partition IS NOT NULL)",
    "gap AS (SELECT * FROM (SELECT date_diff('day', lag(d) OVER (PARTITION BY customer_id ORDER BY d), d) AS gap FROM days) WHERE gap IS NOT NULL)",
    "slack AS (SELECT coalesce(min(gap), 0) AS slack FROM (SELECT gap, row_number() OVER (ORDER BY gap) AS i, count(*) OVER () AS n "
    f"FROM gap) WHERE i >= ceil(n * {FALSE_ALARM}))",
    "gaps_of AS (SELECT count(*) AS gaps, count(*) FILTER (WHERE gap > slack) AS longer FROM gap, slack)",
    "prof AS (SELECT (SELECT count(*) FROM marks) AS groups, gaps, slack, CASE WHEN gaps = 0 THEN CAST(1 AS DOUBLE) ELSE "
    "CAST(longer AS DOUBLE) / gaps END AS share FROM gaps_of, slack)",
    f"allowed AS (SELECT *, {_limit_sql(f'groups * {WITHDRAWN}::DOUBLE * share', f'-ln({FALSE_ALARM}::DOUBLE)')} AS most FROM prof)",
    "latest AS (SELECT variant, customer_id, max(source_partition) AS latest FROM v_raw_orders GROUP BY variant, customer_id)",
    "behind AS (SELECT v.variant, count(*) FILTER (WHERE l.latest IS NULL OR date_diff('day', l.latest, m.mark) > (SELECT slack FROM "
    "slack)) AS behind FROM (SELECT DISTINCT variant FROM v_raw_orders) AS v CROSS JOIN marks AS m LEFT JOIN latest AS l ON l.variant = "
    "v.variant AND l.customer_id IS NOT DISTINCT FROM m.customer_id GROUP BY v.variant)",
    f"marked AS (SELECT variant, {q(MARKS_CONTROL)} AS control_id, 'raw_orders' AS target_table, CAST(greatest(behind - (SELECT most "
    "FROM allowed), 0) AS BIGINT) AS violation_count FROM behind)",
]
_FIRST_RESULTS = "(SELECT * FROM base UNION ALL SELECT * FROM gen)"
MARKS_RESULTS = (
    "SELECT *, violation_count = 0 AS passed, TRUE AS generated FROM marked WHERE NOT EXISTS (SELECT 1 FROM "
    f"{_FIRST_RESULTS} AS b JOIN {_FIRST_RESULTS} AS c ON c.control_id = b.control_id AND c.variant = 'clean' WHERE "
    f"b.variant = {q(STALE)} AND b.violation_count > c.violation_count)"
)
register(
    "campaign_coverage_orders",
    _camp_sql(
        OR,
        "SELECT m.*, c.detected_faults, c.total_faults, c.coverage_pct FROM matrix AS m JOIN coverage AS c ON m.phase = c.phase",
        more_ctes=MARKS_CTES,
        more_results=MARKS_RESULTS,
    ),
)(lambda spark, sf: campaign_coverage_frame(campaign(spark, sf, "orders")))


@register(
    "group_bound_profile",
    OR.with_(
        "SELECT 'customer_id' AS group_column, 'source_partition' AS date_column, groups, gaps, CAST(slack AS BIGINT) AS slack_days, "
        "round(share, 6) AS share, most AS most_behind FROM allowed",
        MARKS_CTES,
    ),
)
def group_bound_profile(spark: SparkSession, sf: str) -> DataFrame:
    """What the control on marks is made of: the clean gaps between a customer's dates and what they allow."""
    p = profile_groups(campaign(spark, sf, "orders").sources["raw_orders"], "customer_id", "source_partition")
    return spark.createDataFrame(
        [(p.group, p.date, p.groups, p.gaps, p.slack, round(p.share, 6), p.limit)],
        "group_column string, date_column string, groups bigint, gaps bigint, slack_days bigint, share double, most_behind bigint",
    )


register(
    "group_control_results",
    OR.with_("SELECT variant, control_id, target_table, violation_count, violation_count = 0 AS passed FROM marked", MARKS_CTES),
)(lambda spark, sf: campaign(spark, sf, "orders").group_results(measured=True))


@register(
    "group_recall",
    OR.with_(
        "SELECT s.fault_id, b.behind, s.mutated_rows, CAST(round(b.behind / s.mutated_rows, 4) AS DOUBLE) AS recall FROM behind AS b "
        "JOIN selcounts AS s ON s.fault_id = b.variant",
        [*MARKS_CTES, _selected_counts(OR)],
    ),
)
def group_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Groups behind their mark against the rows that each fault mutated."""
    c = campaign(spark, sf, "orders")
    controls, tables, _ = c.measured_bounds
    control = next(k for k in controls if k.kind == "behind")
    behind = behind_counts(c.tables["raw_orders"], tables[control.parent_table], c.variants, control)
    mutated = spark.createDataFrame(
        [(p.spec.fault_id, p.selected_count) for p in c.faulted.plans], "fault_id string, mutated_rows bigint"
    )
    recall = F.round(F.col("behind") / F.col("mutated_rows"), 4)
    return behind.join(mutated, F.col("variant") == F.col("fault_id")).select("fault_id", "behind", "mutated_rows", recall.alias("recall"))


NULL_FAULTS = (
    FaultSpec("null-amounts-5pct", NULL_DENSITY_SURGE, "raw_orders", {"column": "amount_cents", "percent": 5}),
    FaultSpec("null-partitions-half-pct", NULL_DENSITY_SURGE, "raw_orders", {"column": "source_partition", "percent": "0.5"}),
    FaultSpec("scale-amounts-2x", NUMERIC_SCALE, "raw_orders", {"column": "amount_cents", "factor": 2, "percent": 10}),
)
NUL = Oracle("events", NULL_FAULTS)


def _null_share_sql() -> str:
    parts, ctes = [], []
    for c, g in (("amount_cents", None), ("source_partition", "currency"), ("amount_cents", "currency")):
        key, name = g or "0", f"{c}_{g}"
        level = f"ln(count(*) OVER () / {FALSE_ALARM}::DOUBLE)" if g else f"-ln({FALSE_ALARM}::DOUBLE)"
        ctes.append(
            f"lim_{name} AS (SELECT g, {_limit_sql('n * (x + 1) / CAST(n + 2 AS DOUBLE)', level)} AS most FROM (SELECT {key} AS g, "
            f"count(*) AS n, count(*) FILTER (WHERE {c} IS NULL) AS x FROM raw_orders GROUP BY 1))"
        )
        control = f"orders_{c}_null_share" + (f"_by_{g}" if g else "")
        parts.append(
            f"SELECT variant, {q(control)} AS control_id, count(*) FILTER (WHERE x > coalesce(most, 0)) AS violation_count FROM (SELECT "
            f"variant, {key} AS g, count(*) FILTER (WHERE {c} IS NULL) AS x FROM v_raw_orders GROUP BY 1, 2) AS v LEFT JOIN "
            f"lim_{name} AS l ON l.g IS NOT DISTINCT FROM v.g GROUP BY variant"
        )
    return NUL.with_("SELECT *, violation_count = 0 AS passed FROM (" + " UNION ALL ".join(parts) + ")", ctes)


@register("null_share_results", _null_share_sql())
def null_share_query(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of NULL by column and by event type, against their limits."""
    c = campaign(spark, sf, "events", NULL_FAULTS)
    orders, tables, controls = c.sources["raw_orders"], {}, []
    for column, group in (("amount_cents", None), ("source_partition", "currency"), ("amount_cents", "currency")):
        name = f"limits_{column}_{group}"
        tables[name] = null_limits(orders, column, group)
        controls.append(null_share_control(column, group, "raw_orders", name))
    found = evaluate_controls({**c.tables, **tables}, c.variants, controls)
    return found.select("variant", "control_id", "violation_count", "passed")


DECLARED = (
    ("orders_customer_id_not_null", "null_density_surge"),
    ("orders_amount_cents_reasonable", "numeric_scale"),
    ("orders_partition_not_stale", "stale_partition"),
)


@register(
    "detection_attribution",
    _camp_sql(
        EV,
        "SELECT r.variant AS fault_id, f.kind, r.control_id, d.kind IS NOT NULL AS declared, "
        "NOT r.passed AS fired, CASE WHEN NOT r.passed AND d.kind IS NOT NULL THEN "
        "'true_positive' WHEN NOT r.passed THEN 'unexpected_detection' WHEN d.kind IS NOT NULL "
        "THEN 'false_negative' ELSE 'true_negative' END AS status FROM allres AS r JOIN faults "
        "AS f ON r.variant = f.fault_id LEFT JOIN (SELECT * FROM (VALUES "
        + ", ".join(f"({q(a)}, {q(b)})" for a, b in DECLARED)
        + ") AS t(control_id, kind)) AS d ON d.control_id = r.control_id AND d.kind = f.kind",
    ),
)
def detection_attribution(spark: SparkSession, sf: str) -> DataFrame:
    c = campaign(spark, sf)
    res = c.all_results().filter(F.col("variant") != CLEAN)
    faults = c.fault_table().select("fault_id", "kind")
    pairs = [(cid, k) for ctl in (*c.baseline_controls, *c.generated_controls, *c.group_controls)
             for cid, k in [(ctl.control_id, kk) for kk in ctl.detects_faults]]
    declared = spark.createDataFrame(pairs, "control_id string, kind string").withColumn(
        "declared", F.lit(True)
    )
    j = res.join(faults, res.variant == faults.fault_id).join(declared, ["control_id", "kind"], "left")
    fired = ~F.col("passed")
    dec = F.coalesce(F.col("declared"), F.lit(False))
    return j.select(
        "fault_id",
        "kind",
        "control_id",
        dec.alias("declared"),
        fired.alias("fired"),
        F.when(fired & dec, "true_positive")
        .when(fired, "unexpected_detection")
        .when(dec, "false_negative")
        .otherwise("true_negative")
        .alias("status"),
    )


@register(
    "weighted_coverage",
    _camp_sql(
        EV,
        "SELECT m.phase, CAST(sum(w.weight) AS BIGINT) AS total_weight, CAST(sum(CASE WHEN "
        "m.detected THEN w.weight ELSE 0 END) AS BIGINT) AS detected_weight, CAST(round(sum(CASE "
        "WHEN m.detected THEN w.weight ELSE 0 END) * 100.0 / sum(w.weight), 1) AS DOUBLE) AS "
        "weighted_coverage_pct FROM matrix AS m JOIN "
        "(SELECT fault_id, count(*) AS weight FROM predicted GROUP BY fault_id) AS w ON "
        "m.fault_id = w.fault_id GROUP BY m.phase",
        [_predicted_values(EV)],
    ),
)
def weighted_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Coverage weighted by each fault's predicted blast radius (tables reached)."""
    c = campaign(spark, sf)
    w = c.predicted_radius().groupBy("fault_id").agg(F.count(F.lit(1)).alias("weight"))
    m = c.matrices().join(w, "fault_id")
    det = F.sum(F.when(F.col("detected"), F.col("weight")).otherwise(0))
    return m.groupBy("phase").agg(
        F.sum("weight").alias("total_weight"),
        det.alias("detected_weight"),
        F.round(det * 100.0 / F.sum("weight"), 1).alias("weighted_coverage_pct"),
    )


register(
    "generated_recall",
    _camp_sql(
        EV,
        "SELECT s.fault_id, g.control_id, g.violation_count, s.mutated_rows, CAST(round("
        "g.violation_count / s.mutated_rows, 4) AS DOUBLE) AS recall FROM gen AS g JOIN selcounts "
        "AS s ON g.variant = s.fault_id",
        [_selected_counts(EV)],
    ),
)(lambda spark, sf: campaign(spark, sf).generated_recall())


# -- G7: column profile --------------------------------------------------------------
def _profile_sql() -> str:
    types = {"order_id": "bigint", "customer_id": "bigint", "order_ts": "timestamp_ntz",
             "amount_cents": "bigint", "currency": "string", "source_partition": "date"}
    native = dict(COLUMNS["raw_orders"])
    parts = []
    for c, t in types.items():
        def txt(e: str) -> str:
            return f"strftime({e}, '%Y-%m-%dT%H:%M:%S.%f')" if native[c] == "TIMESTAMP" else f"CAST({e} AS VARCHAR)"
        parts.append(
            f"SELECT {q(c)} AS column_name, {q(t)} AS data_type, count(*) AS row_count, count(*) "
            f"FILTER (WHERE {c} IS NULL) AS null_count, {txt(f'min({c})')} AS min_value, "
            f"{txt(f'max({c})')} AS max_value FROM raw_orders"
        )
    return OR.with_(" UNION ALL ".join(parts))


register("column_profile", _profile_sql())(
    lambda spark, sf: _column_profile(raw_orders(spark, sf, "orders"))
)


# -- M14: smallest escaping mutation: a grid of factors, and the exact limits of a range ---
LOWEST, HIGHEST = 2, 1000


@register(
    "fault_minimization",
    MIN.with_(
        "SELECT *, min(CASE WHEN NOT detected THEN factor END) OVER () AS smallest_escaping_factor, "
        "min(CASE WHEN detected THEN factor END) OVER () AS smallest_detected_factor, "
        "(SELECT min(CAST(f AS INT)) FILTER (WHERE n > 0) FROM every) AS exact_smallest_detected_factor, "
        "(SELECT min(CAST(f AS INT)) FILTER (WHERE n = 0) FROM every) AS exact_smallest_escaping_factor FROM ("
        "SELECT v.variant AS fault_id, f.factor, count(*) FILTER (WHERE v.amount_cents > "
        "(SELECT max(amount_cents) FROM raw_orders)) AS violation_count, s.mutated_rows, "
        "count(*) FILTER (WHERE v.amount_cents > (SELECT max(amount_cents) FROM raw_orders)) > 0 "
        "AS detected FROM v_raw_orders AS v JOIN (SELECT * FROM (VALUES "
        + ", ".join(f"({q(s.fault_id)}, {s.parameters['factor']})" for s in MINIMIZATION_FAULTS)
        + ") AS t(fault_id, factor)) AS f ON v.variant = f.fault_id JOIN selcounts AS s ON "
        "s.fault_id = v.variant GROUP BY v.variant, f.factor, s.mutated_rows)",
        [
            _selected_counts(MIN),
            "every AS (SELECT f, count(*) FILTER (WHERE f * amount_cents > (SELECT max(amount_cents) FROM raw_orders)) AS n "
            f"FROM raw_orders, range({LOWEST}, {HIGHEST + 1}) AS r(f) WHERE order_id IN (SELECT k FROM sel0) GROUP BY f)",
        ],
    ),
)
def fault_minimization(spark: SparkSession, sf: str) -> DataFrame:
    """The generated amount bound against scale factors 2..1000 on the same rows: counts on a grid, and
    the exact smallest factors that escape it and that it detects."""
    c = campaign(spark, sf, "events", MINIMIZATION_FAULTS)
    plans = c.faulted.plans
    factors = spark.createDataFrame(
        [(p.spec.fault_id, int(p.spec.parameters["factor"]), p.selected_count) for p in plans],
        "fault_id string, factor int, mutated_rows bigint",
    )
    column, _, bound = c.clean_profile_frame([MINIMIZATION_FAULTS[0].fault_id]).first()[1:]
    control = Control(f"orders_{column}_reasonable", "raw_orders", predicate=f"{column} > {int(bound)}")
    grid = (
        c.control_results([control])
        .join(factors, F.col("variant") == F.col("fault_id"))
        .select("fault_id", "factor", "violation_count", "mutated_rows", (F.col("violation_count") > 0).alias("detected"))
    )
    exact = critical_factors(_rebuild(c), MINIMIZATION_FAULTS[0], [control], LOWEST, HIGHEST).first()
    every = Window.partitionBy()  # one row per factor
    return grid.select(
        "*",
        F.min(F.when(~F.col("detected"), F.col("factor"))).over(every).alias("smallest_escaping_factor"),
        F.min(F.when(F.col("detected"), F.col("factor"))).over(every).alias("smallest_detected_factor"),
        F.lit(exact["smallest_detected_factor"]).cast("int").alias("exact_smallest_detected_factor"),
        F.lit(exact["smallest_escaping_factor"]).cast("int").alias("exact_smallest_escaping_factor"),
    )


SUM_BOUNDS = (("daily_revenue", "revenue_cents"), ("customer_value", "lifetime_value_cents"))


def _critical_factors_sql() -> str:
    scaled = "CASE WHEN order_id IN (SELECT k FROM sel0) THEN f * amount_cents ELSE amount_cents END"
    counts = [
        "SELECT 'orders_amount_cents_reasonable' AS control_id, f, count(*) FILTER (WHERE x > (SELECT max(amount_cents) "
        "FROM raw_orders)) AS n, 0 AS c FROM scaled GROUP BY f",
        "SELECT 'orders_customer_id_not_null', f, count(*) FILTER (WHERE customer_id IS NULL), "
        "(SELECT count(*) FROM raw_orders WHERE customer_id IS NULL) FROM scaled GROUP BY f",
    ]
    for (t, column), keys in zip(SUM_BOUNDS, (["order_date", "currency"], ["customer_id", "customer_name", "segment", "country_code"])):
        over = f"(SELECT max({column}) FROM v_{t} WHERE variant = 'clean')"
        counts.append(
            f"SELECT {q(f'{t}_{column}_reasonable')}, f, count(*) FILTER (WHERE s > {over}), 0 FROM "
            f"(SELECT f, {', '.join(keys)}, sum(x) AS s FROM scaled GROUP BY ALL) GROUP BY f"
        )
    counts.append(
        "SELECT 'daily_revenue_non_negative', f, count(*) FILTER (WHERE s < 0), 0 FROM (SELECT f, order_date, currency, "
        "sum(x) AS s FROM scaled GROUP BY ALL) GROUP BY f"
    )
    return EV.with_(
        "SELECT control_id, CAST(min(f) FILTER (WHERE n > c) AS INT) AS smallest_detected_factor, "
        "CAST(min(f) FILTER (WHERE n <= c) AS INT) AS smallest_escaping_factor FROM counted GROUP BY control_id",
        [
            f"scaled AS (SELECT f, order_date, currency, customer_id, customer_name, segment, country_code, {scaled} AS x FROM "
            f"v_orders_enriched, range({LOWEST}, {HIGHEST + 1}) AS r(f) WHERE variant = 'clean')",
            "counted AS (" + " UNION ALL ".join(counts) + ")",
        ],
    )


@register("critical_factors", _critical_factors_sql())
def critical_factors_query(spark: SparkSession, sf: str) -> DataFrame:
    """Exact limits of the scale fault's factor for controls on cells, on sums by day and by customer."""
    c = campaign(spark, sf)
    spec, rebuild = c.faults[0], _rebuild(c)
    column, _, bound = c.clean_profile_frame([spec.fault_id]).first()[1:]
    controls = [
        Control(f"orders_{column}_reasonable", "raw_orders", predicate=f"{column} > {int(bound)}"),
        BASELINE_CONTROLS[0],
        BASELINE_CONTROLS[2],
    ]
    for t, name in SUM_BOUNDS:
        most = rebuild.clean[t].agg(F.max(name)).first()[0]
        controls.append(Control(f"{t}_{name}_reasonable", t, predicate=f"{name} > {int(most)}"))
    return critical_factors(rebuild, spec, controls, LOWEST, HIGHEST)


def _row_counts_sql() -> str:
    parts = []
    for spec, control, gain in (
        (OR.faults[0], "orders_amount_cents_reasonable", "CAST(100 * amount_cents > (SELECT max(amount_cents) FROM raw_orders) AS INT)"),
        (OR.faults[2], "orders_customer_id_not_null", "1"),
    ):
        needs = "customer_id IS NOT NULL" if spec is OR.faults[2] else "TRUE"
        r = OR.rank(spec.fault_id, "order_id")
        parts.append(
            f"SELECT {q(spec.fault_id)} AS fault_id, {q(control)} AS control_id, min(n) FILTER (WHERE more > 0) AS "
            "smallest_detected_rows, min(n) FILTER (WHERE more = 0) AS smallest_escaping_rows FROM (SELECT row_number() OVER o AS n, "
            f"sum({gain}) OVER o AS more FROM raw_orders WHERE {needs} WINDOW o AS (ORDER BY {r}, order_id "
            "ROWS UNBOUNDED PRECEDING))"
        )
    return OR.with_(" UNION ALL ".join(parts))


@register("critical_row_counts", _row_counts_sql())
def critical_row_counts_query(spark: SparkSession, sf: str) -> DataFrame:
    """Over every number of mutated rows: the smallest one that is detected, and that escapes."""
    c = campaign(spark, sf, "orders")
    orders = c.sources["raw_orders"]
    column, _, bound = c.clean_profile_frame([c.faults[0].fault_id]).first()[1:]
    amount = Control(f"orders_{column}_reasonable", "raw_orders", predicate=f"{column} > {int(bound)}")
    out = [
        critical_row_counts(orders, "order_id", spec, [control], c.seed).select(F.lit(spec.fault_id).alias("fault_id"), "*")
        for spec, control in ((c.faults[0], amount), (c.faults[2], BASELINE_CONTROLS[0]))
    ]
    return out[0].unionByName(out[1])


# -- G1, G4, M2 on DECIMAL and DOUBLE columns: prices of line items ------------------
PRICE_FAULTS = (
    FaultSpec("scale-price-3x", NUMERIC_SCALE, "raw_orders", {"column": "price", "factor": 3, "percent": 10}),
    FaultSpec("scale-price-100x", NUMERIC_SCALE, "raw_orders", {"column": "price", "factor": 100, "percent": "2.5"}),
    FaultSpec("scale-exact-price-10x", NUMERIC_SCALE, "raw_orders", {"column": "exact_price", "factor": 10, "percent": 0.5}),
)
LINES_SQL = (
    "SELECT l_orderkey * 8 + l_linenumber AS order_id, l_suppkey AS customer_id, l_extendedprice AS price, "
    "CAST(l_extendedprice AS DECIMAL(14,2)) AS exact_price FROM lineitem"
)


def _typed_bounds_sql() -> str:
    ctes, parts = [f"raw_orders AS ({LINES_SQL})"], []
    for i, s in enumerate(PRICE_FAULTS):
        ctes += MIN.selection_ctes(i, s)
    for c in ("price", "exact_price"):
        cid = q(f"orders_{c}_reasonable")
        over = f"(SELECT max({c}) FROM raw_orders)"
        parts.append(f"SELECT 'clean' AS variant, {cid} AS control_id, count(*) FILTER (WHERE {c} > {over}) AS violation_count FROM raw_orders")
        for i, s in enumerate(PRICE_FAULTS):
            now = f"CASE WHEN order_id IN (SELECT k FROM sel{i}) THEN {c} * {s.parameters['factor']} ELSE {c} END" if s.parameters["column"] == c else c
            parts.append(f"SELECT {q(s.fault_id)}, {cid}, count(*) FILTER (WHERE {now} > {over}) FROM raw_orders")
    return f"WITH {', '.join(ctes)} SELECT *, violation_count = 0 AS passed FROM ({' UNION ALL '.join(parts)})"


@register("typed_bounds_lineitem", _typed_bounds_sql())
def typed_bounds_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    """Generated bounds on a DOUBLE and a DECIMAL column; two faults share one control."""
    lines = read_table(spark, sf, "lineitem").selectExpr(
        "l_orderkey * 8 + l_linenumber AS order_id",
        "l_suppkey AS customer_id",
        "CAST(l_shipdate AS TIMESTAMP_NTZ) AS order_ts",
        "CAST(round(l_extendedprice * 100) AS BIGINT) AS amount_cents",
        "l_returnflag AS currency",
        "CAST(l_shipdate AS DATE) AS source_partition",
        "l_extendedprice AS price",
        "CAST(l_extendedprice AS DECIMAL(14,2)) AS exact_price",
    )
    suppliers = read_table(spark, sf, "supplier").selectExpr(
        "s_suppkey AS customer_id", "s_name AS customer_name", "CAST(NULL AS STRING) AS segment",
        "CAST(s_nationkey AS STRING) AS country_code",
    )
    tables = {"raw_orders": lines, "raw_customers": suppliers}
    c = campaign(spark, sf, "lines", PRICE_FAULTS, tables, "typed-bounds")
    return c.control_results(c.generated_controls).select("variant", "control_id", "violation_count", "passed")


# -- L1, L2: record-level lineage --------------------------------------------------
@register(
    "lineage_closure",
    "WITH RECURSIVE " + RECORD_EDGES_SQL + ", reach(node, hops) AS (SELECT 'n:' || "
    "CAST(n_nationkey AS VARCHAR), 0 FROM nation UNION SELECT e.dst, "
    "r.hops + 1 FROM reach AS r JOIN edges AS e ON e.src = r.node) SELECT node, min(hops) AS hops "
    "FROM reach GROUP BY node",
)
def lineage_closure(spark: SparkSession, sf: str) -> DataFrame:
    """Every record downstream of every nation (nation -> customer -> order -> line),
    with its hop distance: the record-level blast radius of the whole graph."""
    seeds = read_table(spark, sf, "nation").select(
        F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("node")
    )
    return closure(record_edges(spark, sf), seeds)


register(
    "lineage_neighbors",
    "WITH " + RECORD_EDGES_SQL + " SELECT src AS node, dst AS neighbor, 'downstream' AS direction FROM edges "
    "UNION SELECT dst, src, 'upstream' FROM edges",
)(lambda spark, sf: neighbors(record_edges(spark, sf)))
register(
    "lineage_neighbor_counts",
    "WITH " + RECORD_EDGES_SQL + " SELECT COALESCE(d.node, u.node) AS node, COALESCE(u.n, 0) AS "
    "upstreams, COALESCE(d.n, 0) AS downstreams FROM (SELECT src AS node, count(*) AS n FROM "
    "edges GROUP BY src) AS d FULL OUTER JOIN (SELECT dst AS node, count(*) AS n FROM edges "
    "GROUP BY dst) AS u ON d.node = u.node",
)(lambda spark, sf: neighbor_counts(record_edges(spark, sf)))


# -- E1/E2: snapshot and verified restore ------------------------------------------
@register(
    "restore_verification",
    OR.with_(
        "SELECT table_name, row_count, checksum, row_count AS manifest_row_count, checksum AS "
        "manifest_checksum, TRUE AS verified FROM checksums WHERE variant = 'clean'",
        [OR.checksums_cte()],
    ),
)
def restore_verification(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshot, restore and compare; the six result rows outlive the snapshot."""
    sources = {"raw_customers": raw_customers(spark, sf), "raw_orders": raw_orders(spark, sf, "orders")}
    path = snapshot(spark, sources, seed=DEFAULT_SEED, derive=BUILDERS)
    try:
        found = verify_restore(spark, path, list(MANAGED_TABLES))
        return spark.createDataFrame(found.collect(), found.schema)
    finally:
        remove_snapshot(spark, path)


# -- C1/C3 on data: JSON payload schema drift; M11 payload drift fault ---------------
from faultbench.operators.catalog import (  # noqa: E402
    control_sql_lint,
    lint_body_sql,
    payload_schema_drift,
)
from faultbench.operators.faults import PAYLOAD_KEY_RENAME, apply_faults  # noqa: E402
from faultbench.plans.contract import DEFAULT_SEED  # noqa: E402

PROPS_CONTRACT = {"k": "integer"}
PAYLOAD_FAULT = FaultSpec(
    "rename-props-key-10pct",
    PAYLOAD_KEY_RENAME,
    "events",
    {"column": "props", "key": "k", "new_key": "k_renamed", "percent": 10},
)

_DUCK_CLASS = (
    "CASE WHEN t IN ('BIGINT','UBIGINT','INTEGER','UINTEGER','SMALLINT','TINYINT','HUGEINT') "
    "THEN 'integer' WHEN t = 'DOUBLE' OR t = 'FLOAT' OR t LIKE 'DECIMAL%' THEN 'number' WHEN t "
    "= 'VARCHAR' THEN 'string' WHEN t = 'BOOLEAN' THEN 'boolean' WHEN t = 'OBJECT' THEN "
    "'object' WHEN t = 'ARRAY' THEN 'array' WHEN t = 'NULL' THEN 'null' ELSE lower(t) END"
)


def _payload_drift_sql(src: str, column: str, contract: dict) -> str:
    exp_map = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in contract.items()) + "}"
    exp = f"{exp_map}[field]"
    obj = f"json_valid({column}) AND json_type({column}) = 'OBJECT'"
    missing = " UNION ALL ".join(
        f"SELECT {q(column)} AS column_name, {q(k)} AS field, {q(v)} AS expected_type, CAST(NULL "
        f"AS VARCHAR) AS observed_type, 'missing' AS status, count(*) AS rows FROM {src} WHERE {obj} "
        f"AND NOT json_exists({column}, {q('$.' + k)}) HAVING count(*) > 0"
        for k, v in contract.items()
    )
    return (
        f"SELECT {q(column)} AS column_name, field, {exp} AS expected_type, observed_type, CASE "
        f"WHEN {exp} IS NULL THEN 'extra' WHEN {exp} = observed_type THEN 'ok' ELSE "
        "'type_mismatch' END AS status, count(*) AS rows FROM (SELECT field, "
        f"{_DUCK_CLASS} AS observed_type FROM (SELECT u.field, json_type({column}, '$.\"' || "
        f"u.field || '\"') AS t FROM {src}, unnest(json_keys({column})) AS u(field) WHERE {obj})) "
        f"GROUP BY field, observed_type UNION ALL {missing} UNION ALL SELECT {q(column)}, NULL, "
        f"NULL, NULL, 'not_an_object', count(*) FROM {src} WHERE {column} IS NOT NULL AND NOT "
        f"({obj}) HAVING count(*) > 0"
    )


register("payload_schema_drift", _payload_drift_sql("events", "props", PROPS_CONTRACT))(
    lambda spark, sf: payload_schema_drift(read_table(spark, sf, "events"), "props", PROPS_CONTRACT)
)


def _payload_fault_sql() -> str:
    o = Oracle("events", (PAYLOAD_FAULT,))
    r = o.rank(PAYLOAD_FAULT.fault_id, "event_id")
    return (
        f"WITH sel AS (SELECT k FROM (SELECT event_id AS k, row_number() OVER (ORDER BY {r}, "
        "event_id) AS rn, count(*) OVER () AS cnt FROM events WHERE props IS NOT NULL) WHERE rn "
        "<= cnt * 10 // 100), ev AS (SELECT event_id, CASE WHEN event_id IN (SELECT k FROM sel) "
        "AND json_valid(props) AND json_type(props) = 'OBJECT' AND json_exists(props, '$.k') AND NOT "
        "json_exists(props, '$.k_renamed') THEN (SELECT CAST(json_group_object(CASE WHEN f = 'k' THEN "
        "'k_renamed' ELSE f END, json_extract(props, '$.\"' || f || '\"')) AS VARCHAR) FROM "
        "unnest(json_keys(props)) AS u(f)) ELSE props END AS props FROM events) " + _payload_drift_sql("ev", "props", PROPS_CONTRACT)
    )


@register("fault_payload_drift", _payload_fault_sql())
def fault_payload_drift(spark: SparkSession, sf: str) -> DataFrame:
    """M11 inside a JSON column: drift report of the variant with a renamed key."""
    ev = read_table(spark, sf, "events").select("event_id", "props")
    ft = apply_faults({"events": ev}, {"events": "event_id"}, [PAYLOAD_FAULT], DEFAULT_SEED)
    return payload_schema_drift(only(ft.tables["events"], ft.variants, PAYLOAD_FAULT.fault_id), "props", PROPS_CONTRACT)


# -- Q6: lint of the campaign's control SQL (baseline + generated from the profile) ----
GENERATED_HEADER = "-- generated from the clean profile; zero violations pass\n"


def _control_sql_frame(spark: SparkSession, c: Campaign) -> DataFrame:
    base = spark.createDataFrame(
        [(ctl.control_id, ctl.violation_sql()) for ctl in c.baseline_controls],
        "control_id string, violation_sql string",
    )
    gen = control_generation(spark, c.sf_dir).filter(F.col("status") == "generated").select(
        "control_id",
        F.concat(
            F.lit(GENERATED_HEADER + "SELECT count(*) AS violation_count FROM raw_orders WHERE "),
            F.col("predicate"),
        ).alias("violation_sql"),
    )
    return base.unionByName(gen)


def _lint_sql(o: Oracle) -> str:
    from faultbench.operators.catalog import CLAUSE_END, FORBIDDEN_KEYWORDS

    base_rows = ", ".join(f"({q(ctl.control_id)}, {q(ctl.violation_sql())})" for ctl in BASELINE_CONTROLS)
    body = lint_body_sql("violation_sql")
    allowed = "[" + ", ".join(q(t) for t in MANAGED_TABLES) + "]"
    sources = (
        f"list_transform(string_split_regex(lower({body}), '\\bfrom\\b')[2:], "
        f"lambda s: string_split_regex(s, '{CLAUSE_END}')[1])"
    )
    rels = (
        f"list_filter(list_transform(flatten(list_transform({sources}, lambda s: string_split_regex(s, "
        "'\\bjoin\\b'))), lambda s: string_split_regex(trim(s), '\\s+')[1]), lambda s: s NOT LIKE '(%')"
    )
    forbidden = "(?i)\\b(" + "|".join(FORBIDDEN_KEYWORDS) + ")\\b"
    checks = [
        ("not_empty", f"length({body}) > 0"),
        ("read_only_select", f"regexp_matches({body}, '(?i)^(select|with)\\b')"),
        ("forbidden_operations_absent", f"NOT regexp_matches({body}, '{forbidden}')"),
        ("single_statement", f"strpos(regexp_replace({body}, ';+\\s*$', ''), ';') = 0"),
        ("approved_relations_only", f"len({rels}) > 0 AND len(list_filter({rels}, lambda x: NOT "
         f"list_contains({allowed}, x))) = 0 AND len(list_filter({sources}, lambda s: contains(s, ','))) = 0"),
    ]
    fails = "list_filter([" + ", ".join(f"CASE WHEN NOT ({c}) THEN {q(n)} END" for n, c in checks) + "], lambda x: x IS NOT NULL)"
    header = q(GENERATED_HEADER + "SELECT count(*) AS violation_count FROM raw_orders WHERE ")
    gen_rows = ", ".join(
        f"({q(fid)}, {q(cid)}, {q(op)})" for fid, _k, _c, _s, cid, op in eligible_generators(o)
    )
    return _camp_sql(
        o,
        f"SELECT control_id, array_to_string({fails}, ',') AS failed_checks, len({fails}) = 0 AS "
        "passed FROM (SELECT * FROM (VALUES " + base_rows + ") AS b(control_id, violation_sql) "
        f"UNION ALL SELECT e.control_id, {header} || CASE WHEN p.statistic = 'max' THEN "
        "p.column_name || ' > ' || p.value ELSE p.column_name || ' < DATE ''' || p.value || '''' "
        f"END FROM profile AS p JOIN (SELECT * FROM (VALUES {gen_rows}) AS t(fault_id, control_id, "
        "op)) AS e ON e.fault_id = p.fault_id)",
    )


register("control_sql_lint", _lint_sql(EV))(
    lambda spark, sf: control_sql_lint(_control_sql_frame(spark, campaign(spark, sf)), MANAGED_TABLES)
)


# -- E4: replay digest over the detection matrices and the final checksums -----------
from faultbench.plans.oracle import hash60 as _ohash, row_text as _orow  # noqa: E402

_MATRIX_COLS = [("fault_id", "VARCHAR"), ("kind", "VARCHAR"), ("failing_control_ids", "VARCHAR"),
                ("failing_controls", "BIGINT"), ("detected", "BOOLEAN"), ("phase", "VARCHAR")]
_CK_COLS = [("variant", "VARCHAR"), ("table_name", "VARCHAR"), ("row_count", "BIGINT"), ("checksum", "VARCHAR")]


def _digest_select(name: str, src: str, cols) -> str:
    prefix = f"{name}|{','.join(c for c, _ in cols)}|"
    h = _ohash(_orow(cols, prefix))
    return (
        f"SELECT {q(name)} AS table_name, count(*) AS row_count, COALESCE(CAST(sum(CAST({h} AS "
        f"HUGEINT)) AS VARCHAR), '0') AS checksum FROM {src}"
    )


register(
    "replay_digest",
    _camp_sql(
        EV,
        _digest_select("detection_matrix", "matrix", _MATRIX_COLS) + " UNION ALL "
        + _digest_select("table_checksums", "checksums", _CK_COLS),
        [EV.checksums_cte()],
    ),
)(
    lambda spark, sf: ck.table_checksums(
        {
            "detection_matrix": campaign(spark, sf).matrices().select(*[c for c, _ in _MATRIX_COLS]),
            "table_checksums": campaign(spark, sf).checksums(),
        }
    ).drop("variant")
)


# -- B3 summary: exact match of predicted and observed radius per fault ---------------
register(
    "blast_radius_exact_match",
    _compare_sql(
        EV,
        "SELECT fault_id, count(*) FILTER (WHERE predicted) AS predicted_tables, count(*) FILTER "
        "(WHERE observed) AS observed_tables, count(*) FILTER (WHERE status = 'matched') AS "
        "matched_tables, count(*) FILTER (WHERE status = 'missed') AS missed_tables, count(*) "
        "FILTER (WHERE status = 'unexpected') AS unexpected_tables, count(*) FILTER (WHERE status "
        "<> 'matched') = 0 AS exact_match FROM (" + COMPARE_BODY + ") GROUP BY fault_id",
    ),
)(lambda spark, sf: ck.radius_summary(campaign(spark, sf).radius_comparison()))


# -- E1/S5: snapshot with manifest (seed + checksums + content-derived id) -------------
from faultbench.operators.snapshots import read_manifest  # noqa: E402


@register(
    "snapshot_manifest",
    OR.with_(
        "SELECT table_name, row_count, checksum, CAST(" + str(DEFAULT_SEED) + " AS BIGINT) AS seed, "
        "sha256('" + str(DEFAULT_SEED) + "|' || (SELECT string_agg(table_name || ':' || "
        "CAST(row_count AS VARCHAR) || ':' || checksum, ',' ORDER BY table_name) FROM checksums "
        "WHERE variant = 'clean')) AS snapshot_id FROM checksums WHERE variant = 'clean'",
        [OR.checksums_cte()],
    ),
)
def snapshot_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Write the six clean tables to a fresh snapshot folder and return its manifest."""
    sources = {"raw_customers": raw_customers(spark, sf), "raw_orders": raw_orders(spark, sf, "orders")}
    path = snapshot(spark, sources, seed=DEFAULT_SEED, derive=BUILDERS)
    try:
        manifest = read_manifest(spark, path).select(
            "table_name",
            F.col("row_count").cast("bigint").alias("row_count"),
            "checksum",
            F.col("seed").cast("bigint").alias("seed"),
            "snapshot_id",
        )
        return spark.createDataFrame(manifest.collect(), manifest.schema)
    finally:
        remove_snapshot(spark, path)


# -- G4/G6: the generated-control SQL artifact, bound to manifest and profile digests --
from faultbench.plans.manifest import manifest_sha256  # noqa: E402

ARTIFACT_HEAD = "-- Generated from the measured gaps and the clean profile.\n"


def _stmt_spark() -> F.Column:
    return F.concat(
        F.lit("SELECT '"), F.col("control_id"), F.lit("' AS control_id, count(*) AS violation_count "),
        F.lit("FROM raw_orders WHERE "), F.col("predicate"),
    )


@register(
    "generated_artifact",
    _camp_sql(
        EV,
        "SELECT count(*) AS control_count, sha256(string_agg(column_name || ':' || statistic || "
        "':' || value, ',' ORDER BY fault_id)) AS profile_sha256, sha256("
        + q(ARTIFACT_HEAD + f"-- manifest_sha256={manifest_sha256(EV.faults, DEFAULT_SEED)}\n")
        + " || '-- profile_sha256=' || sha256(string_agg(column_name || ':' || statistic || ':' || "
        "value, ',' ORDER BY fault_id)) || chr(10) || string_agg('SELECT ''' || control_id || "
        "''' AS control_id, count(*) AS violation_count FROM raw_orders WHERE ' || predicate, "
        "chr(10) || 'UNION ALL' || chr(10) ORDER BY control_id) || chr(10) || 'ORDER BY "
        "control_id' || chr(10)) AS artifact_sha256 FROM (SELECT p.*, e.control_id, CASE WHEN "
        "p.statistic = 'max' THEN p.column_name || ' > ' || p.value ELSE p.column_name || ' < "
        "DATE ''' || p.value || '''' END AS predicate FROM profile AS p JOIN (SELECT * FROM "
        "(VALUES " + ", ".join(f"({q(fid)}, {q(cid)})" for fid, _k, _c, _s, cid, _o in eligible_generators(EV))
        + ") AS t(fault_id, control_id)) AS e ON e.fault_id = p.fault_id)",
    ),
)
def generated_artifact(spark: SparkSession, sf: str) -> DataFrame:
    """SQL text of the generated controls (UNION ALL, ordered by id) with a header that
    binds it to the campaign manifest and the clean profile; returns the digests."""
    c = campaign(spark, sf)
    gen = control_generation(spark, sf).filter(F.col("status") == "generated")
    prof = c.clean_profile_frame()
    rows = gen.join(prof.select("fault_id", "statistic", "value"), "fault_id")
    prof_text = F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("fault_id", F.concat_ws(":", "column_name", "statistic", "value").alias("t")))),
        lambda x: x["t"]), ",")
    stmts = F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("control_id", _stmt_spark().alias("s")))),
        lambda x: x["s"]), "\nUNION ALL\n")
    head = ARTIFACT_HEAD + f"-- manifest_sha256={manifest_sha256(c.faults, c.seed)}\n"
    agg = rows.agg(F.count(F.lit(1)).alias("control_count"), prof_text.alias("p"), stmts.alias("s"))
    return agg.select(
        "control_count",
        F.sha2("p", 256).alias("profile_sha256"),
        F.sha2(F.concat(F.lit(head + "-- profile_sha256="), F.sha2("p", 256), F.lit("\n"), F.col("s"),
                        F.lit("\nORDER BY control_id\n")), 256).alias("artifact_sha256"),
    )


# -- S4, T1-T4, F1 by deltas: only what a fault changes is computed again -------------
register("delta_checksums", EV.with_("SELECT * FROM checksums", [EV.checksums_cte()]))(
    lambda spark, sf: campaign(spark, sf).delta_checksums()
)
register("delta_checksums_integrity", INT.with_("SELECT * FROM checksums", [INT.checksums_cte()]))(
    lambda spark, sf: _integrity(spark, sf).delta_checksums()
)
for _t, _profile, _o in (
    ("daily_revenue", "events", EV),
    ("customer_value", "orders", OR),
    ("executive_dashboard", "orders", OR),
):
    register(f"delta_{_t}", _o.with_(f"SELECT * FROM v_{_t}"))(
        (lambda t, profile: lambda spark, sf: expand(
            _rebuild(campaign(spark, sf, profile)).mart(t), campaign(spark, sf, profile).variants
        ))(_t, _profile)
    )


def _delta_sizes_sql(o: Oracle) -> str:
    parts = []
    for t in MANAGED_TABLES:
        cols = ", ".join(c for c, _ in COLUMNS[t])
        for s in o.faults:
            now, was = (f"SELECT {cols} FROM v_{t} WHERE variant = {q(v)}" for v in (s.fault_id, "clean"))
            parts.append(
                f"SELECT {q(s.fault_id)} AS variant, {q(t)} AS table_name, (SELECT count(*) FROM ({was} EXCEPT ALL {now})) "
                f"AS removed, (SELECT count(*) FROM ({now} EXCEPT ALL {was})) AS added"
            )
    return o.with_("SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE removed + added > 0")


register("delta_sizes", _delta_sizes_sql(INT))(lambda spark, sf: _rebuild(_integrity(spark, sf)).sizes())


# -- L4: how many records each record reaches, from sketches passed against the edges ----------
REACH_K = 256
_REACH_SQL = (
    "WITH l AS (SELECT l_orderkey AS k, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) GROUP BY 1), "
    "o AS (SELECT o_custkey AS c, o_orderkey AS k, 1 + coalesce(n, 0) AS size FROM orders LEFT JOIN l ON l.k = o_orderkey), "
    "c AS (SELECT c_nationkey AS n, c_custkey AS k, 1 + coalesce(s, 0) AS size FROM customer LEFT JOIN (SELECT c, sum(size) AS s FROM o "
    "GROUP BY c) ON c = c_custkey), "
    "sizes AS (SELECT 'l:' || l_orderkey || ':' || l_linenumber AS node, 1 AS size FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) "
    "UNION ALL SELECT 'o:' || k, size FROM o UNION ALL SELECT 'c:' || k, size FROM c "
    "UNION ALL SELECT 'n:' || n, 1 + sum(size) FROM c GROUP BY n) "
)


@register("reach_sizes", _REACH_SQL + f"SELECT node, CAST(size AS BIGINT) AS size FROM sizes WHERE size < {REACH_K}")
def reach_sizes_query(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of the closures that are smaller than a sketch, which are exact."""
    found = reach_sizes(record_edges(spark, sf), k=REACH_K)
    return found.filter("exact").select("node", F.col("size").cast("bigint").alias("size"))


@register(
    "reach_size_errors",
    _REACH_SQL + "SELECT node, CAST(size AS BIGINT) AS size, TRUE AS within_four_errors FROM sizes WHERE node LIKE 'n:%'",
)
def reach_size_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Every nation's exact size beside its estimate: off by four standard errors at most."""
    edges = record_edges(spark, sf)
    nations = edges.select("src").filter("src LIKE 'n:%'").distinct()
    estimate = reach_sizes(edges, k=REACH_K).join(nations, F.col("node") == F.col("src")).select("node", "size")
    # A record has one upstream at most, so the paths over the levels are exact here.
    paths = path_counts(edges, 3).join(nations, F.col("node") == F.col("src"))
    exact = paths.select("node", (F.col("paths") + 1).alias("exact_size"))
    error = F.abs(F.col("size") / F.col("exact_size") - 1) * (REACH_K - 2) ** 0.5
    return exact.join(estimate, "node").select("node", F.col("exact_size").alias("size"), (error <= 4).alias("within_four_errors"))
