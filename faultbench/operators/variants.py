"""Variant tables: the clean table and every fault variant in one DataFrame.

A *variant table* carries a bigint column ``_vmask``; bit ``i`` set means the row is
part of variant ``i`` (bit 0 is always ``clean``). A row that no fault touches is
stored once with every bit set; a row that fault ``f`` changes is stored twice: the
original without bit ``f`` and the changed row with only bit ``f``. Hence the data
volume is one copy of the table plus the changed rows, however many faults run, and
every later step (joins, aggregates, hashes, controls) processes shared rows once.

Per-variant aggregates are computed "wide": group by the business key only, with one
conditional aggregate per variant. Map-side partial aggregation then emits one row
per key and partition, not one per key, variant and partition. Each output group is
folded back into mask rows: variants with equal results share one row.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultbench.functions.hashing import qi, sql_str

MASK = "_vmask"
CLEAN = "clean"
MAX_VARIANTS = 62


@dataclass(frozen=True)
class VariantSet:
    names: tuple[str, ...] = (CLEAN,)

    def __post_init__(self) -> None:
        if not self.names or self.names[0] != CLEAN:
            raise ValueError("the first variant must be 'clean'")
        if len(set(self.names)) != len(self.names):
            raise ValueError("variant names must be unique")
        if len(self.names) > MAX_VARIANTS:
            raise ValueError(f"at most {MAX_VARIANTS} variants fit one mask")

    @classmethod
    def of(cls, fault_ids: Iterable[str]) -> VariantSet:
        return cls((CLEAN, *fault_ids))

    def bit(self, name: str) -> int:
        return 1 << self.names.index(name)

    @property
    def all_mask(self) -> int:
        return (1 << len(self.names)) - 1

    def member_sql(self, name: str, mask: str = MASK) -> str:
        return f"(`{mask}` & {self.bit(name)}) != 0"

    def member(self, name: str, mask: Column | None = None) -> Column:
        if mask is None:
            return F.expr(self.member_sql(name))
        return mask.bitwiseAND(F.lit(self.bit(name))) != 0


def with_mask(df: DataFrame, vs: VariantSet) -> DataFrame:
    """A plain table seen as a variant table: every row in every variant."""
    if MASK in df.columns:
        return df
    return df.withColumn(MASK, F.lit(vs.all_mask).cast("bigint"))


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != MASK]


@dataclass(frozen=True)
class RowChange:
    """How one variant changes the rows for which ``selected`` holds.

    mode ``update``: the row is replaced by ``updates`` applied to it;
    mode ``delete``: the row is absent from the variant;
    mode ``insert``: the row stays and a copy (with ``updates``) is added.
    ``selected`` and the update values are Columns or SQL expression text.
    """

    variant: str
    selected: Column | str
    mode: str = "update"
    updates: Mapping[str, Column | str] = field(default_factory=dict)


def as_column(x: Column | str) -> Column:
    return F.expr(x) if isinstance(x, str) else x


def stack(df: DataFrame, vs: VariantSet, changes: Sequence[RowChange]) -> DataFrame:
    """Apply per-variant row changes in one projection + explode (no shuffle).

    Selection predicates are evaluated once per row into flag columns. The generator
    explodes only a small integer per row (0 = the original row, i + 1 = the changed
    row of change i), and every output column is then an ordinary expression of the
    input columns and that integer; unused columns are pruned down to the scan.
    """
    df = with_mask(df, vs)
    cols = data_columns(df)
    types = {f.name: f.dataType for f in df.schema.fields}
    for ch in changes:
        if ch.mode not in ("update", "delete", "insert"):
            raise ValueError(f"unknown change mode {ch.mode!r}")
        unknown = set(ch.updates) - set(cols)
        if unknown:
            raise ValueError(f"change {ch.variant} updates unknown columns {sorted(unknown)}")
    flags = [f"_s{i}" for i in range(len(changes))]
    extra: list[Column] = []
    for i, (ch, f) in enumerate(zip(changes, flags)):
        member = vs.member_sql(ch.variant)
        if isinstance(ch.selected, str):
            extra.append(F.expr(f"({ch.selected}) AND {member} AS {qi(f)}"))
        else:
            extra.append((ch.selected & F.expr(member)).alias(f))
        # Column-valued updates are evaluated only for selected rows.
        for c, u in ch.updates.items():
            if not isinstance(u, str):
                extra.append(F.when(F.col(f), u).alias(f"_u{i}_{cols.index(c)}"))
    pre = df.select("*", *extra)
    cleared = " + ".join(
        f"CASE WHEN {qi(f)} THEN {vs.bit(ch.variant)} ELSE 0 END"
        for ch, f in zip(changes, flags)
        if ch.mode in ("update", "delete")
    ) or "0"
    entries = ["0"] + [
        f"CASE WHEN {qi(f)} THEN {i + 1} END"
        for i, (ch, f) in enumerate(zip(changes, flags))
        if ch.mode != "delete"
    ]
    exploded = pre.selectExpr("*", f"explode(array({', '.join(entries)})) AS _which").filter(
        "_which IS NOT NULL"
    )
    mask = (
        f"CASE _which WHEN 0 THEN {qi(MASK)} & ({vs.all_mask} - ({cleared})) "
        + " ".join(
            f"WHEN {i + 1} THEN CAST({vs.bit(ch.variant)} AS BIGINT)"
            for i, ch in enumerate(changes)
            if ch.mode != "delete"
        )
        + " END"
    )
    out_cols = []
    for j, c in enumerate(cols):
        cases = []
        for i, ch in enumerate(changes):
            if ch.mode != "delete" and c in ch.updates:
                u = ch.updates[c]
                e = f"({u})" if isinstance(u, str) else qi(f"_u{i}_{j}")
                cases.append(f"WHEN {i + 1} THEN CAST({e} AS {types[c].simpleString()})")
        expr = f"CASE _which {' '.join(cases)} ELSE {qi(c)} END" if cases else qi(c)
        out_cols.append(f"{expr} AS {qi(c)}")
    return exploded.selectExpr(*out_cols, f"{mask} AS {MASK}").filter(f"{MASK} <> 0")


def expand(df: DataFrame, vs: VariantSet, variant_col: str = "variant") -> DataFrame:
    """One row per (variant, row): the naive representation, for output only."""
    df = with_mask(df, vs)
    names = ", ".join(f"CASE WHEN {vs.member_sql(v)} THEN {sql_str(v)} END" for v in vs.names)
    cols = [qi(c) for c in data_columns(df)]
    return df.selectExpr(f"explode(array({names})) AS {qi(variant_col)}", *cols).filter(
        F.col(variant_col).isNotNull()
    )


def only(df: DataFrame, vs: VariantSet, name: str) -> DataFrame:
    """The plain table of one variant."""
    df = with_mask(df, vs)
    return df.filter(vs.member(name)).select(*data_columns(df))


# An aggregate spec: (output name, function, expression); function is one of
# count (expression ignored: count of rows), count_true (rows where the boolean
# expression is TRUE), sum, max, min, bit_or. Expressions are Columns or SQL text.
Agg = tuple[str, str, "Column | str | None"]


def _project_measures(
    df: DataFrame, keys: Sequence[str], aggs: Sequence[Agg]
) -> tuple[DataFrame, list[tuple[str, str, str | None]]]:
    """Evaluate every measure expression once per row, before the aggregate.

    Each measure is referenced by one conditional aggregate per variant; inlined,
    an expensive expression (a row hash) would be evaluated once per variant and the
    aggregate could outgrow whole-stage codegen. Catalyst keeps such a projection
    separate because it does not inline non-cheap expressions referenced repeatedly.
    """
    cols: list[Column] = [F.col(k) for k in keys] + [F.col(MASK)]
    out: list[tuple[str, str, str | None]] = []
    for j, (name, fn, expr) in enumerate(aggs):
        if expr is None:
            out.append((name, fn, None))
            continue
        e = F.expr(expr) if isinstance(expr, str) else expr
        cols.append(e.alias(f"_m{j}"))
        out.append((name, fn, f"`_m{j}`"))
    return df.select(*cols), out


def _conditional_sql(fn: str, member: str, expr: str | None) -> str:
    if fn == "count":
        return f"count(CASE WHEN {member} THEN 1 END)"
    if fn == "count_true":
        return f"count(CASE WHEN {member} AND {expr} THEN 1 END)"
    if fn in ("sum", "max", "min", "bit_or"):
        return f"{fn}(CASE WHEN {member} THEN {expr} END)"
    raise ValueError(f"unknown aggregate {fn!r}")


def _aggregate(df: DataFrame, keys: Sequence[str], exprs: list[str]) -> DataFrame:
    cols = [F.expr(e) for e in exprs]
    return df.groupBy(*keys).agg(*cols) if keys else df.agg(*cols)


def wide_aggregate(
    df: DataFrame,
    vs: VariantSet,
    keys: Sequence[str],
    aggs: Sequence[Agg],
    *,
    global_agg: bool = False,
) -> DataFrame:
    """``GROUP BY keys`` of every variant at once, returned as a variant table.

    With ``global_agg`` (no keys) every variant yields exactly one row, like SQL's
    aggregate without GROUP BY; otherwise a group exists in a variant only if the
    variant has a row in it.
    """
    df, aggs_p = _project_measures(with_mask(df, vs), keys, aggs)
    exprs = []
    for i, v in enumerate(vs.names):
        m = vs.member_sql(v)
        exprs.append(f"{_conditional_sql('count', m, None)} AS `_n{i}`")
        for name, fn, expr in aggs_p:
            exprs.append(f"{_conditional_sql(fn, m, expr)} AS `_a{i}_{name}`")
    grouped = _aggregate(df, keys, exprs)
    entries = []
    for i, v in enumerate(vs.names):
        values = ", ".join(f"'{name}', `_a{i}_{name}`" for name, _, _ in aggs_p)
        e = f"named_struct('b', CAST({vs.bit(v)} AS BIGINT), 'v', named_struct({values}))"
        if not global_agg:
            e = f"CASE WHEN `_n{i}` > 0 THEN {e} END"
        entries.append(e)
    present = f"filter(array({', '.join(entries)}), z -> z IS NOT NULL)"
    folded = (
        f"array_distinct(transform({present}, x -> named_struct('v', x.v, 'm', "
        f"aggregate(filter({present}, y -> y.v <=> x.v), CAST(0 AS BIGINT), "
        "(acc, y) -> acc | y.b))))"
    )
    kq = [qi(k) for k in keys]
    return grouped.selectExpr(*kq, f"explode({folded}) AS _e").selectExpr(
        *kq, *[f"_e.v.`{name}` AS `{name}`" for name, _, _ in aggs_p], f"_e.m AS {MASK}"
    )


def per_variant(
    df: DataFrame,
    vs: VariantSet,
    measures: Sequence[Agg],
    *,
    keys: Sequence[str] = (),
    variant_col: str = "variant",
) -> DataFrame:
    """Aggregates per variant as plain rows ``(variant, *keys, *measures)``."""
    df, ms = _project_measures(with_mask(df, vs), keys, measures)
    exprs = [
        f"{_conditional_sql(fn, vs.member_sql(v), expr)} AS `_a{i}_{name}`"
        for i, v in enumerate(vs.names)
        for name, fn, expr in ms
    ]
    grouped = _aggregate(df, keys, exprs)
    rows = ", ".join(
        f"named_struct('{variant_col}', {sql_str(v)}, "
        + ", ".join(f"'{name}', `_a{i}_{name}`" for name, _, _ in ms)
        + ")"
        for i, v in enumerate(vs.names)
    )
    kq = [qi(k) for k in keys]
    return grouped.selectExpr(*kq, f"inline(array({rows}))").selectExpr(
        qi(variant_col), *kq, *[qi(name) for name, _, _ in ms]
    )
