"""Independent SQL renderings of the campaign queries, for DuckDB.

The SQL here is the naive form: one full table per variant (UNION ALL), keys
selected with ``row_number()`` over the same md5 rank, downstream tables rebuilt
per variant with GROUP BY variant. It shares nothing with the Spark plan but the
definitions, which is what makes it a useful oracle.
"""

from __future__ import annotations

from collections.abc import Sequence

from faultbench.operators.faults import (
    DUPLICATE_KEYS,
    JOIN_KEY_CORRUPTION,
    NULL_DENSITY_SURGE,
    NUMERIC_SCALE,
    REF_INTEGRITY_BREAK,
    STALE_PARTITION,
    FaultSpec,
)
from faultbench.operators.downstream import MANAGED_TABLES
from faultbench.operators.selection import share
from faultbench.plans.contract import DEFAULT_SEED, PRIMARY_KEYS, SCHEMA_CONTRACT, default_faults

TS_FMT = "%Y-%m-%dT%H:%M:%S.%f"

COLUMNS = {}
for _t, _c, _ty, _n in SCHEMA_CONTRACT:
    COLUMNS.setdefault(_t, []).append((_c, _ty))


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def hash60(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT"


def field_text(col: str, native: str) -> str:
    text = f"CAST(epoch_us({col}) AS VARCHAR)" if native == "TIMESTAMP" else f"CAST({col} AS VARCHAR)"
    return f"(CASE WHEN {col} IS NULL THEN '~' ELSE CAST(length({text}) AS VARCHAR) || ':' || {text} END)"


def row_text(cols: Sequence[tuple[str, str]], prefix: str = "", alias: str = "") -> str:
    a = f"{alias}." if alias else ""
    return " || ".join([q(prefix)] + [field_text(a + c, ty) for c, ty in cols])


def raw_orders_sql(profile: str) -> str:
    if profile == "orders":
        return (
            "SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS order_ts, "
            "CAST(round(o_totalprice * 100) AS BIGINT) AS amount_cents, 'USD' AS currency, "
            "CAST(o_orderdate AS DATE) AS source_partition FROM orders"
        )
    return (
        "SELECT event_id AS order_id, user_id AS customer_id, ts AS order_ts, "
        "CAST(round(value * 100) AS BIGINT) AS amount_cents, event_type AS currency, "
        "CAST(ts AS DATE) AS source_partition FROM events"
    )


RAW_CUSTOMERS_SQL = (
    "SELECT c.c_custkey AS customer_id, c.c_name AS customer_name, c.c_mktsegment AS segment, "
    "n.n_name AS country_code FROM customer AS c LEFT JOIN nation AS n "
    "ON c.c_nationkey = n.n_nationkey"
)

ORDER_COLS = ["order_id", "customer_id", "order_ts", "amount_cents", "currency", "source_partition"]
CUSTOMER_COLS = ["customer_id", "customer_name", "segment", "country_code"]
TABLE_COLS = {"raw_orders": ORDER_COLS, "raw_customers": CUSTOMER_COLS}


class Oracle:
    def __init__(
        self,
        profile: str = "events",
        faults: Sequence[FaultSpec] | None = None,
        seed: int = DEFAULT_SEED,
    ) -> None:
        self.profile = profile
        self.faults = tuple(default_faults() if faults is None else faults)
        self.seed = seed
        self.variants = ["clean", *[f.fault_id for f in self.faults]]

    # -- selection ------------------------------------------------------------
    def rank(self, salt: str, key: str) -> str:
        return hash60(f"{q(f'{self.seed}:{salt}:')} || CAST({key} AS VARCHAR)")

    def _n(self, spec: FaultSpec, total: str) -> str:
        p = spec.parameters
        if "row_count" in p:
            return str(int(p["row_count"]))
        part = share(p["percent"])
        return f"({total} * {part.numerator} // {part.denominator})"

    def selection_ctes(self, i: int, spec: FaultSpec) -> list[str]:
        table = spec.target_table
        key = PRIMARY_KEYS[table]
        p = spec.parameters
        r = self.rank(str(p.get("salt", spec.fault_id)), key)
        if spec.kind == STALE_PARTITION:
            ts, grp = p["timestamp_column"], p["group_column"]
            return [
                f"cand{i} AS (SELECT {key}, {ts} FROM (SELECT {key}, {ts}, row_number() OVER "
                f"(PARTITION BY {grp} ORDER BY {ts} DESC NULLS LAST, {key} DESC) AS rn "
                f"FROM {table}) WHERE rn = 1)",
                f"anchor{i} AS (SELECT {key} FROM {table} ORDER BY {ts} DESC NULLS LAST, "
                f"{key} DESC LIMIT 1)",
                f"sel{i} AS (SELECT {key} AS k FROM anchor{i} UNION ALL SELECT k FROM "
                f"(SELECT {key} AS k, row_number() OVER (ORDER BY {r}, {key}) AS rn, "
                f"count(*) OVER () + 1 AS cnt FROM cand{i} WHERE {key} NOT IN "
                f"(SELECT {key} FROM anchor{i})) WHERE rn <= {self._n(spec, 'cnt')} - 1)",
            ]
        cond = "TRUE"
        if spec.kind in (NULL_DENSITY_SURGE, JOIN_KEY_CORRUPTION):
            cond = f"{p['column']} IS NOT NULL"
        return [
            f"sel{i} AS (SELECT k FROM (SELECT {key} AS k, row_number() OVER "
            f"(ORDER BY {r}, {key}) AS rn, count(*) OVER () AS cnt FROM {table} "
            f"WHERE {cond}) WHERE rn <= {self._n(spec, 'cnt')})"
        ]

    def mutated(self, spec: FaultSpec, col: str) -> str | None:
        p = spec.parameters
        if spec.kind == NUMERIC_SCALE and col == p["column"]:
            return f"{col} * {int(p['factor'])}"
        if spec.kind == STALE_PARTITION:
            if col == p["timestamp_column"]:
                return f"{col} - INTERVAL {int(p['days'])} DAY"
            if col == p["partition_column"]:
                return f"{col} - {int(p['days'])}"
        if spec.kind == NULL_DENSITY_SURGE and col == p["column"]:
            return "NULL"
        if spec.kind == JOIN_KEY_CORRUPTION and col == p["column"]:
            return f"-{col} - 1"
        return None

    def variant_table_cte(self, table: str) -> str:
        cols = TABLE_COLS[table]
        key = PRIMARY_KEYS[table]
        parts = [f"SELECT 'clean' AS variant, {', '.join(cols)} FROM {table}"]
        for i, spec in enumerate(self.faults):
            v = q(spec.fault_id)
            if spec.target_table != table:
                parts.append(f"SELECT {v} AS variant, {', '.join(cols)} FROM {table}")
                continue
            sel = f"{key} IN (SELECT k FROM sel{i})"
            if spec.kind == REF_INTEGRITY_BREAK:
                parts.append(f"SELECT {v}, {', '.join(cols)} FROM {table} WHERE NOT ({sel})")
            elif spec.kind == DUPLICATE_KEYS:
                parts.append(f"SELECT {v}, {', '.join(cols)} FROM {table}")
                parts.append(f"SELECT {v}, {', '.join(cols)} FROM {table} WHERE {sel}")
            else:
                exprs = []
                for c in cols:
                    m = self.mutated(spec, c)
                    exprs.append(f"CASE WHEN {sel} THEN {m} ELSE {c} END AS {c}" if m else c)
                parts.append(f"SELECT {v}, {', '.join(exprs)} FROM {table}")
        return f"v_{table} AS ({' UNION ALL '.join(parts)})"

    def ctes(self) -> list[str]:
        out = [
            f"raw_orders AS ({raw_orders_sql(self.profile)})",
            f"raw_customers AS ({RAW_CUSTOMERS_SQL})",
        ]
        for i, spec in enumerate(self.faults):
            out += self.selection_ctes(i, spec)
        out.append(self.variant_table_cte("raw_orders"))
        out.append(self.variant_table_cte("raw_customers"))
        out.append(
            "v_orders_enriched AS (SELECT o.variant, o.order_id, o.customer_id, c.customer_name, "
            "c.segment, c.country_code, o.order_ts, CAST(o.order_ts AS DATE) AS order_date, "
            "o.amount_cents, o.currency, o.source_partition FROM v_raw_orders AS o LEFT JOIN "
            "v_raw_customers AS c ON o.customer_id = c.customer_id AND o.variant = c.variant)"
        )
        out.append(
            "v_daily_revenue AS (SELECT variant, order_date, currency, count(*) AS order_count, "
            "CAST(sum(amount_cents) AS BIGINT) AS revenue_cents FROM v_orders_enriched "
            "GROUP BY variant, order_date, currency)"
        )
        out.append(
            "v_customer_value AS (SELECT variant, customer_id, customer_name, segment, "
            "country_code, count(*) AS order_count, CAST(sum(amount_cents) AS BIGINT) AS "
            "lifetime_value_cents, max(order_ts) AS last_order_ts FROM v_orders_enriched "
            "GROUP BY variant, customer_id, customer_name, segment, country_code)"
        )
        out.append(
            "v_executive_dashboard AS (SELECT variant, count(*) AS active_customers, "
            "CAST(sum(order_count) AS BIGINT) AS total_orders, CAST(sum(lifetime_value_cents) "
            "AS BIGINT) AS total_revenue_cents, max(last_order_ts) AS latest_order_ts "
            "FROM v_customer_value GROUP BY variant)"
        )
        out.append(
            "faults AS (SELECT * FROM (VALUES "
            + ", ".join(f"({q(s.fault_id)}, {q(s.kind)}, {q(s.target_table)})" for s in self.faults)
            + ") AS t(fault_id, kind, target_table))"
        )
        return out

    def with_(self, body: str, extra: Sequence[str] = ()) -> str:
        return "WITH " + ",\n".join([*self.ctes(), *extra]) + "\n" + body

    # -- checksums ------------------------------------------------------------
    def checksum_select(self, table: str) -> str:
        cols = COLUMNS[table]
        prefix = f"{table}|{','.join(c for c, _ in cols)}|"
        h = hash60(row_text(cols, prefix))
        return (
            f"SELECT variant, {q(table)} AS table_name, count(*) AS row_count, "
            f"COALESCE(CAST(sum(CAST({h} AS HUGEINT)) AS VARCHAR), '0') AS checksum "
            f"FROM v_{table} GROUP BY variant"
        )

    def checksums_cte(self) -> str:
        return "checksums AS (" + " UNION ALL ".join(
            self.checksum_select(t) for t in MANAGED_TABLES
        ) + ")"

    def observed_cte(self) -> str:
        return (
            "observed AS (SELECT f.variant AS fault_id, f.table_name, c.row_count AS "
            "clean_row_count, f.row_count AS fault_row_count, (f.checksum IS DISTINCT FROM "
            "c.checksum OR f.row_count IS DISTINCT FROM c.row_count) AS changed FROM "
            "(SELECT * FROM checksums WHERE variant <> 'clean') AS f FULL OUTER JOIN "
            "(SELECT * FROM checksums WHERE variant = 'clean') AS c ON f.table_name = c.table_name)"
        )


def eligible_generators(o: Oracle) -> list[tuple[str, str, str, str, str, str]]:
    """(fault_id, kind, column, statistic, control_id, comparison) for generator kinds."""
    types = dict(COLUMNS["raw_orders"])
    out = []
    for s in o.faults:
        if s.target_table != "raw_orders":
            continue
        if s.kind == NUMERIC_SCALE:
            col = str(s.parameters["column"])
            if types.get(col) in ("BIGINT", "INTEGER", "DECIMAL"):
                out.append((s.fault_id, s.kind, col, "max", f"orders_{col}_reasonable", ">"))
        elif s.kind == STALE_PARTITION:
            col = str(s.parameters["partition_column"])
            if types.get(col) == "DATE":
                out.append((s.fault_id, s.kind, col, "min", "orders_partition_not_stale", "<"))
    return out


def campaign_ctes(
    o: Oracle, baseline_controls_sql: str, more_ctes: Sequence[str] = (), more_results: str = ""
) -> list[str]:
    """base, gaps, profile, gen, allres, matrix, coverage; ``more_results`` joins the generated ones."""
    ctes = [
        f"base AS ({baseline_controls_sql})",
        "gaps AS (SELECT fault_id, kind FROM faults WHERE fault_id NOT IN (SELECT b.variant FROM "
        "base AS b JOIN base AS c ON c.control_id = b.control_id AND c.variant = 'clean' WHERE "
        "b.violation_count > c.violation_count))",
    ]
    prof, gen = [], []
    for fid, _kind, col, stat, cid, op in eligible_generators(o):
        prof.append(
            f"SELECT * FROM (SELECT {q(fid)} AS fault_id, {q(col)} AS column_name, {q(stat)} AS "
            f"statistic, CAST({stat}({col}) AS VARCHAR) AS value FROM raw_orders) WHERE fault_id "
            "IN (SELECT fault_id FROM gaps)"
        )
        gen.append(
            f"SELECT variant, {q(cid)} AS control_id, 'raw_orders' AS target_table, count(*) FILTER "
            f"(WHERE {col} {op} (SELECT {stat}({col}) FROM raw_orders)) AS violation_count FROM "
            f"v_raw_orders WHERE {q(fid)} IN (SELECT fault_id FROM gaps) GROUP BY variant"
        )
    empty_prof = (
        "SELECT CAST(NULL AS VARCHAR) AS fault_id, CAST(NULL AS VARCHAR) AS column_name, "
        "CAST(NULL AS VARCHAR) AS statistic, CAST(NULL AS VARCHAR) AS value WHERE FALSE"
    )
    empty_gen = (
        "SELECT CAST(NULL AS VARCHAR) AS variant, CAST(NULL AS VARCHAR) AS control_id, "
        "CAST(NULL AS VARCHAR) AS target_table, CAST(0 AS BIGINT) AS violation_count WHERE FALSE"
    )
    ctes.append("profile AS (" + (" UNION ALL ".join(prof) or empty_prof) + ")")
    ctes.append(
        "gen AS (SELECT *, violation_count = 0 AS passed FROM ("
        + (" UNION ALL ".join(gen) or empty_gen)
        + "))"
    )
    ctes += more_ctes
    more = f" UNION ALL {more_results}" if more_results else ""
    ctes.append(
        f"allres AS (SELECT *, FALSE AS generated FROM base UNION ALL SELECT *, TRUE AS generated FROM gen{more})"
    )

    def phase(name: str, cond: str) -> str:
        return (
            f"SELECT f.fault_id, f.kind, COALESCE(string_agg(r.control_id, ',' ORDER BY "
            "r.control_id), '') AS failing_control_ids, count(r.control_id) AS failing_controls, "
            f"count(r.control_id) > 0 AS detected, {q(name)} AS phase FROM faults AS f LEFT JOIN "
            f"(SELECT b.* FROM allres AS b JOIN allres AS c ON c.control_id = b.control_id AND "
            f"c.variant = 'clean' WHERE b.violation_count > c.violation_count AND b.{cond}) AS r "
            "ON r.variant = f.fault_id "
            "GROUP BY f.fault_id, f.kind"
        )

    ctes.append(
        "matrix AS (" + phase("baseline", "generated = FALSE") + " UNION ALL " + phase("improved", "variant <> 'clean'") + ")"
    )
    ctes.append(
        "coverage AS (SELECT phase, count(*) FILTER (WHERE detected) AS detected_faults, count(*) "
        "AS total_faults, CAST(round(count(*) FILTER (WHERE detected) * 100.0 / count(*), 1) AS "
        "DOUBLE) AS coverage_pct FROM matrix GROUP BY phase)"
    )
    return ctes
