"""Fault operators: seeded, bounded, reproducible changes to copies of tables.

Every fault kind turns a :class:`FaultSpec` into a :class:`~variants.RowChange`: a
row predicate (which rows) and the change (new column values, deletion or an extra
copy). All faults of a campaign are applied in one projection by
:func:`variants.stack`; the clean table is never modified.

Kinds (parameters):

* ``numeric_scale`` (column, factor 2..1000): value * factor, of any numeric type.
* ``stale_partition`` (timestamp_column, partition_column, days 1..365,
  group_column): shift timestamp and partition back by ``days``; candidates are the
  latest row of each group (ties by key), and the newest row overall is always taken.
* ``null_density_surge`` (column): set a non-null value to NULL.
* ``duplicate_keys``: add an identical copy of the row.
* ``join_key_corruption`` (column): key -> ``-key - 1`` (outside a non-negative
  key domain), so the row no longer joins.
* ``ref_integrity_break``: delete parent rows (run on the parent table).
* ``payload_key_rename`` (column, key, new_key): schema drift inside a JSON object
  column: the top-level key is renamed in the selected rows (the table schema stays).

:func:`register_fault` adds a kind. Table-level schema drift (renamed or retyped
columns) changes the schema, so it is not a row change: see :func:`drift_schema`.

Each takes ``row_count`` or ``percent`` of the candidates; asking for more rows than
exist is an error. Rows with a NULL key are never candidates.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultbench.functions.hashing import combine_parts, field_text, hash60, hash_parts, qi, row_text, sql_str
from faultbench.functions.ordering import pack_sql, packable, unpack_key_sql
from faultbench.operators.selection import (
    Boundary,
    SelectionError,
    SelectionRequest,
    resolve_boundaries,
    selection_predicate,
    share,
)
from faultbench.operators.variants import RowChange, VariantSet, as_column, stack, with_mask

NUMERIC_SCALE = "numeric_scale"
STALE_PARTITION = "stale_partition"
NULL_DENSITY_SURGE = "null_density_surge"
DUPLICATE_KEYS = "duplicate_keys"
JOIN_KEY_CORRUPTION = "join_key_corruption"
REF_INTEGRITY_BREAK = "ref_integrity_break"
PAYLOAD_KEY_RENAME = "payload_key_rename"


class FaultError(ValueError):
    pass


@dataclass(frozen=True)
class FaultSpec:
    fault_id: str
    kind: str
    target_table: str
    parameters: Mapping[str, object]
    expected_tables: tuple[str, ...] | None = None
    expected_controls: tuple[str, ...] = ()

    @property
    def changed_columns(self) -> tuple[str, ...]:
        """The columns that change, ``*`` for whole rows."""
        kind = FAULT_KINDS[self.kind]
        return tuple(str(self.parameters[name]) for name in kind.changes) or ("*",)


@dataclass(frozen=True)
class FaultPlan:
    spec: FaultSpec
    change: RowChange
    boundary: Boundary | None
    selected_count: int
    flag_column: str | None = None


# -- fault kinds ---------------------------------------------------------------------

_IDENT = "^[a-z_][a-z0-9_]*$"

# A check returns the reason why a parameter value is refused, or None.
Check = Callable[[str, object, Mapping[str, T.DataType], str], "str | None"]


def whole_number(low: int, high: int) -> Check:
    def check(name: str, value: object, types: Mapping[str, T.DataType], key: str) -> str | None:
        if isinstance(value, bool) or not isinstance(value, int):
            return f"{name} must be an integer"
        return None if low <= value <= high else f"{name} is outside {low}..{high}"

    return check


def column_of(*kinds: type, not_key: bool = False) -> Check:
    def check(name: str, value: object, types: Mapping[str, T.DataType], key: str) -> str | None:
        if not isinstance(value, str) or not re.match(_IDENT, value):
            return f"{name} is not a safe column name"
        if value not in types:
            return f"{name} {value} is not a column of the target"
        if kinds and not isinstance(types[value], kinds):
            return f"{name} {value} has type {types[value].simpleString()}"
        if not_key and value == key:
            return "the key column cannot be changed by this fault"
        return None

    return check


def json_key(name: str, value: object, types: Mapping[str, T.DataType], key: str) -> str | None:
    return None if isinstance(value, str) and re.match(_IDENT, value) else f"{name} is not a safe JSON key"


@dataclass(frozen=True)
class FaultKind:
    """How one kind of fault is checked and turned into a row change.

    ``parameters``: a check for each parameter; ``changes``: the parameters that name the
    changed columns (none: whole rows); ``updates``: new values by column as SQL text;
    ``mode``: see :class:`~variants.RowChange`; ``needs``: the parameter whose column must
    not be NULL in a candidate; ``latest``: the parameters (group, timestamp) if only the
    latest row of each group is a candidate.
    """

    name: str
    parameters: Mapping[str, Check]
    changes: tuple[str, ...] = ()
    updates: Callable[[Mapping[str, object]], Mapping[str, str]] = lambda p: {}
    mode: str = "update"
    needs: str | None = None
    latest: tuple[str, str] | None = None


FAULT_KINDS: dict[str, FaultKind] = {}


def register_fault(kind: FaultKind) -> FaultKind:
    """Make a fault kind known; a name can be taken once."""
    if kind.name in FAULT_KINDS:
        raise FaultError(f"fault kind {kind.name} exists")
    FAULT_KINDS[kind.name] = kind
    return kind


def _shifted(p: Mapping[str, object]) -> dict[str, str]:
    ts, part, days = str(p["timestamp_column"]), str(p["partition_column"]), int(p["days"])  # type: ignore[call-overload]
    return {ts: f"{qi(ts)} - make_dt_interval({days})", part: f"date_sub({qi(part)}, {days})"}


def _renamed(p: Mapping[str, object]) -> dict[str, str]:
    """The object is parsed, so nested keys and text values that look like the key stay.
    Text that is no object, or has no such key or the new one already, stays as it is."""
    c, old, new = qi(str(p["column"])), sql_str(str(p["key"])), sql_str(str(p["new_key"]))
    entries = f"try_cast(try_parse_json({c}) AS MAP<STRING, VARIANT>)"
    keys = f"map_keys({entries})"
    renamed = f"transform_keys({entries}, (k, v) -> CASE WHEN k = {old} THEN {new} ELSE k END)"
    found = f"coalesce(array_contains({keys}, {old}) AND NOT array_contains({keys}, {new}), false)"
    return {str(p["column"]): f"CASE WHEN {found} THEN to_json({renamed}) ELSE {c} END"}


def _on_column(expression: str) -> Callable[[Mapping[str, object]], dict[str, str]]:
    return lambda p: {str(p["column"]): expression.format(column=qi(str(p["column"])), **{k: v for k, v in p.items() if k != "column"})}


register_fault(FaultKind(
    NUMERIC_SCALE,
    {"column": column_of(T.NumericType), "factor": whole_number(2, 1000)},
    changes=("column",),
    updates=_on_column("{column} * {factor}"),
))
register_fault(FaultKind(
    STALE_PARTITION,
    {
        "timestamp_column": column_of(T.TimestampType, T.TimestampNTZType),
        "partition_column": column_of(T.DateType),
        "group_column": column_of(),
        "days": whole_number(1, 365),
    },
    changes=("timestamp_column", "partition_column"),
    updates=_shifted,
    latest=("group_column", "timestamp_column"),
))
register_fault(FaultKind(
    NULL_DENSITY_SURGE,
    {"column": column_of(not_key=True)},
    changes=("column",),
    updates=_on_column("NULL"),
    needs="column",
))
register_fault(FaultKind(
    JOIN_KEY_CORRUPTION,
    {"column": column_of(T.IntegralType, not_key=True)},
    changes=("column",),
    updates=_on_column("-{column} - 1"),
    needs="column",
))
register_fault(FaultKind(
    PAYLOAD_KEY_RENAME,
    {"column": column_of(T.StringType), "key": json_key, "new_key": json_key},
    changes=("column",),
    updates=_renamed,
    needs="column",
))
register_fault(FaultKind(DUPLICATE_KEYS, {}, mode="insert"))
register_fault(FaultKind(REF_INTEGRITY_BREAK, {}, mode="delete"))


def validate_spec(spec: FaultSpec, schema: T.StructType, key: str) -> list[str]:
    """All reasons a spec is refused (empty list = valid)."""
    kind = FAULT_KINDS.get(spec.kind)
    if kind is None:
        return [f"unknown fault kind {spec.kind}"]
    reasons = []
    p = dict(spec.parameters)
    types = {f.name: f.dataType for f in schema.fields}
    if not re.match(_IDENT, spec.fault_id.replace("-", "_")):
        reasons.append("fault_id is not a safe identifier")
    if key not in types:
        reasons.append(f"key column {key} missing from target")
    for name, check in kind.parameters.items():
        reason = check(name, p.get(name), types, key)
        if reason:
            reasons.append(reason)
    if ("row_count" in p) == ("percent" in p):
        reasons.append("exactly one of row_count or percent is required")
    elif "row_count" in p:
        reason = whole_number(1, 1 << 62)("row_count", p["row_count"], types, key)
        if reason:
            reasons.append(reason)
    else:
        try:
            share(p["percent"])
        except SelectionError as e:
            reasons.append(str(e))
    extra = set(p) - set(kind.parameters) - {"row_count", "percent", "salt"}
    if extra:
        reasons.append(f"unexpected parameters {sorted(extra)}")
    return reasons


def _latest_per_group(df: DataFrame, key: str, group: str, ts: str) -> DataFrame:
    """Latest row of each group by (ts desc, key desc); a NULL group is one group.

    Returns ``(key, _latest)`` where ``_latest`` orders candidates like (ts, key).
    An aggregate, not a window: partial aggregation collapses a hot group on the map
    side, so no task ever holds a whole group; with an integer key the (ts, key) pair
    is packed into a decimal so the aggregate stays hash based.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    held = df.filter(F.col(key).isNotNull())
    if packable(types[ts], types[key]):
        packed = held.groupBy(group).agg(F.expr(f"max({pack_sql(ts, types[ts], key)}) AS _latest"))
        return packed.selectExpr(f"{unpack_key_sql('_latest')} AS {qi(key)}", "_latest")
    latest = held.groupBy(group).agg(F.max(F.struct(F.col(ts), F.col(key))).alias("_latest"))
    return latest.select(F.col(f"_latest.{key}").alias(key), "_latest")


@dataclass
class _Pending:
    spec: FaultSpec
    index: int
    key: str
    salt: str
    request: SelectionRequest


def _prepare(spec: FaultSpec, df: DataFrame, key: str, seed: int, index: int) -> _Pending:
    """Validate one fault and turn it into a selection request (no job runs here)."""
    reasons = validate_spec(spec, df.schema, key)
    if reasons:
        raise FaultError(f"{spec.fault_id}: " + "; ".join(reasons))
    kind = FAULT_KINDS[spec.kind]
    p = dict(spec.parameters)
    salt = str(p.pop("salt", spec.fault_id))
    count = {k: v for k, v in p.items() if k in ("row_count", "percent")}
    if kind.latest is None:
        eligible = f"{qi(str(p[kind.needs]))} IS NOT NULL" if kind.needs else None
        req = SelectionRequest(df, key, seed, salt, count, eligible=eligible)
        return _Pending(spec, index, key, salt, req)
    group, ts = (str(p[name]) for name in kind.latest)
    # One row per group, read by both selection jobs and by the flag join: kept.
    cands = _latest_per_group(df, key, group, ts).persist(StorageLevel.MEMORY_AND_DISK)
    # The newest candidate (= newest row overall) is always selected: it ranks 0.
    # It is a scalar subquery, evaluated inside the jobs that use it.
    anchor = cands.agg(F.max("_latest")).scalar()
    req = SelectionRequest(cands, key, seed, salt, count, anchor=anchor, anchor_order=("_latest",))
    return _Pending(spec, index, key, salt, req)


def _finish(pend: _Pending, boundary: Boundary, df: DataFrame, seed: int) -> tuple[DataFrame, FaultPlan]:
    spec, key, req = pend.spec, pend.key, pend.request
    kind, p = FAULT_KINDS[spec.kind], spec.parameters
    selected = selection_predicate(boundary, seed, pend.salt, key, req.anchor, req.anchor_order)
    flag = None
    if kind.latest is not None:
        # The selected rows are known by key only: one join for any type and number of
        # keys, planned by their real size (broadcast or sort-merge). A key may be the latest
        # of several groups: it is joined once, and all its rows are selected.
        flag = f"_sel{pend.index}"
        keyed = req.candidates.filter(selected).select(key).distinct().withColumn(flag, F.lit(True))
        df = df.join(keyed, key, "left")
        selected = f"{qi(flag)} IS NOT NULL"
    elif kind.needs:
        selected = f"{qi(str(p[kind.needs]))} IS NOT NULL AND {selected}"
    change = RowChange(spec.fault_id, selected, kind.mode, dict(kind.updates(p)))
    return df, FaultPlan(spec, change, boundary, boundary.n, flag)


@dataclass
class FaultedTables:
    """Result of :func:`apply_faults`.

    ``tables``: variant tables; ``flagged``: the clean targets with the selection
    flag columns joined on (the input of mutation evidence).
    """

    tables: dict[str, DataFrame]
    variants: VariantSet
    plans: list[FaultPlan]
    flagged: dict[str, DataFrame] = field(default_factory=dict)
    kept: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        for df in self.kept:
            df.unpersist()
        self.kept = []


def apply_faults(
    tables: Mapping[str, DataFrame],
    keys: Mapping[str, str],
    specs: Sequence[FaultSpec],
    seed: int,
) -> FaultedTables:
    """All faults at once: every table becomes a variant table over one VariantSet.

    Every fault starts from the same clean table (never cumulative).
    """
    ids = [s.fault_id for s in specs]
    if len(set(ids)) != len(ids):
        raise FaultError("fault ids must be unique")
    unknown = {s.target_table for s in specs} - set(tables)
    if unknown:
        raise FaultError(f"faults target unknown tables {sorted(unknown)}")
    vs = VariantSet.of(ids)
    pending = [
        _prepare(spec, tables[spec.target_table], keys[spec.target_table], seed, i)
        for i, spec in enumerate(specs)
    ]
    boundaries = resolve_boundaries([pd.request for pd in pending]) if pending else []
    out: dict[str, DataFrame] = {}
    flagged: dict[str, DataFrame] = {}
    plans: list[FaultPlan] = []
    for name, df in tables.items():
        mine = [(pd, b) for pd, b in zip(pending, boundaries) if pd.spec.target_table == name]
        if not mine:
            out[name] = with_mask(df, vs)
            continue
        changes, flags = [], []
        for pd, boundary in mine:
            df, plan = _finish(pd, boundary, df, seed)
            plans.append(plan)
            changes.append(plan.change)
            if plan.flag_column:
                flags.append(plan.flag_column)
        flagged[name] = df
        stacked = stack(df, vs, changes)
        out[name] = stacked.drop(*flags) if flags else stacked
    order = {s.fault_id: i for i, s in enumerate(specs)}
    plans.sort(key=lambda pl: order[pl.spec.fault_id])
    kept = [pd.request.candidates for pd in pending if FAULT_KINDS[pd.spec.kind].latest]
    return FaultedTables(out, vs, plans, flagged, kept)


def mutation_evidence(faulted: FaultedTables, keys: Mapping[str, str]) -> DataFrame:
    """Per fault: mutated row count and before/after digests of the changed values.

    The digests cover the key plus the changed columns of the selected rows of the
    clean table (before) and of the changed rows (after): one aggregate per target
    table for all its faults.
    """
    out = None
    by_table: dict[str, list[FaultPlan]] = {}
    for pl in faulted.plans:
        by_table.setdefault(pl.spec.target_table, []).append(pl)
    for name, group in by_table.items():
        key = keys[name]
        df = faulted.flagged[name]
        types = {f.name: f.dataType for f in df.schema.fields}
        data_cols = [c for c in df.columns if not c.startswith("_sel") and c != "_vmask"]
        measures = []
        for pl in group:
            changed = [c for c in pl.spec.changed_columns if c != "*"] or [
                c for c in data_cols if c != key
            ]
            cols = [key, *changed]
            before = hash60(row_text(df, cols))
            after_text = F.concat(
                F.lit(""),
                *[
                    field_text(
                        as_column(pl.change.updates[c]).cast(types[c]) if c in pl.change.updates else F.col(c),
                        types[c],
                    )
                    for c in cols
                ],
            )
            after = hash60(after_text)
            sel = as_column(pl.change.selected)

            def digest(h: Column, weight: int = 1) -> Column:
                parts = [F.sum(F.when(sel, x * F.lit(weight))) for x in hash_parts(h)]
                return combine_parts(*parts)

            if pl.change.mode == "delete":
                after_digest = F.lit("0")
            elif pl.change.mode == "insert":
                after_digest = digest(before, 2)
            else:
                after_digest = digest(after)
            measures.append(
                F.struct(
                    F.lit(pl.spec.fault_id).alias("fault_id"),
                    F.lit(pl.spec.kind).alias("kind"),
                    F.lit(name).alias("target_table"),
                    F.count(F.when(sel, 1)).alias("mutated_rows"),
                    digest(before).alias("before_digest"),
                    after_digest.alias("after_digest"),
                )
            )
        part = df.agg(F.array(*measures).alias("_e")).select(F.explode("_e").alias("e")).select("e.*")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("changed", F.col("before_digest") != F.col("after_digest"))


def drift_schema(
    df: DataFrame, rename: Mapping[str, str] | None = None, retype: Mapping[str, str] | None = None
) -> DataFrame:
    """Table-level schema drift: renamed and/or retyped columns (a new DataFrame)."""
    rename, retype = dict(rename or {}), dict(retype or {})
    unknown = (set(rename) | set(retype)) - set(df.columns)
    if unknown:
        raise FaultError(f"unknown columns {sorted(unknown)}")
    cols = []
    for c in df.columns:
        e = F.col(c).cast(retype[c]) if c in retype else F.col(c)
        cols.append(e.alias(rename.get(c, c)))
    return df.select(*cols)
