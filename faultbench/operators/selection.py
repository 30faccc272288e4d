"""Seeded, exact selection of N rows by hash rank, without gathering rows.

Keys are ranked by ``(hash60('<seed>:<salt>:<key>'), key)``; the rows of the first keys
are selected until N rows are reached. Instead of materialising the selected keys, the
last selected pair (the *boundary*) is found, and selection becomes the row predicate
``(rank, key) <= boundary`` that later jobs evaluate locally: no join, no shuffle.

All selections of a campaign are resolved together, in two jobs, whatever their number
and size. Each job reads a source once for all its requests:

1. an aggregate counts rows by the top bits of every request's rank; a window over that
   histogram (bounded by the number of buckets) finds the candidate count, the bucket
   that holds the N-th row and how many rows precede it: one row per request reaches
   the driver;
2. the rows of those buckets are counted by (rank, key) and a running sum picks the
   pair. A bucket holds one 2**16-th of the distinct keys; a key repeated any number
   of times is one row there, counted on the map side.

A NULL key is never a candidate. Where keys repeat, whole keys are selected, as many as
it takes to reach N rows; ``Boundary.n`` is the number of rows actually selected. The
result is identical for any partitioning and for any engine that computes md5.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultbench.functions.hashing import key_rank, key_rank_sql, qi, sql_str

# Ranks are hash60 + 1, so rank 0 is free for a forced first row (an anchor);
# they fit in 61 bits.
RANK_BITS = 61
BUCKET_BITS = 16


class SelectionError(ValueError):
    pass


def literal_sql(value: object) -> str:
    """A key value as an SQL literal of its own type."""
    if isinstance(value, str):
        return sql_str(value)
    if isinstance(value, Decimal):
        return f"{value:f}BD"
    if isinstance(value, datetime):
        return f"TIMESTAMP'{value.isoformat(sep=' ')}'" if value.tzinfo else f"TIMESTAMP_NTZ'{value.isoformat(sep=' ')}'"
    if isinstance(value, date):
        return f"DATE'{value.isoformat()}'"
    if isinstance(value, float):
        return f"CAST('{value!r}' AS DOUBLE)"
    if isinstance(value, bool):
        return repr(value)
    if isinstance(value, int):
        return repr(value)
    raise SelectionError(f"keys of type {type(value).__name__} can't be selected")


@dataclass(frozen=True)
class Boundary:
    rank: int
    key: object
    n: int
    available: int

    def predicate(self, rank: Column, key: Column) -> Column:
        return (rank < F.lit(self.rank)) | ((rank == F.lit(self.rank)) & (key <= F.lit(self.key)))

    def predicate_sql(self, rank: str, key: str) -> str:
        return f"(({rank}) < {self.rank} OR (({rank}) = {self.rank} AND {qi(key)} <= {literal_sql(self.key)}))"


@dataclass(frozen=True)
class SelectionRequest:
    """Select ``row_count`` or ``percent`` of the rows of ``candidates`` with a non-null
    ``key`` for which ``eligible`` (SQL text) holds."""

    candidates: DataFrame
    key: str
    seed: int
    salt: str
    parameters: dict
    # optional anchor: a row (given by a scalar-subquery Column comparing equal to
    # ``struct(anchor_order...)``) that always ranks first
    anchor: Column | None = None
    anchor_order: tuple[str, ...] = ()
    eligible: str | None = None

    def rank(self) -> Column:
        return selection_rank(self.seed, self.salt, self.key, self.anchor, self.anchor_order)

    def is_candidate(self) -> Column:
        held = F.col(self.key).isNotNull()
        return held if self.eligible is None else held & F.expr(self.eligible)


def share(percent: object) -> Fraction:
    """``percent`` (int, float or decimal text, over 0 and up to 100) as an exact share."""
    try:
        if isinstance(percent, bool):
            raise ValueError
        out = Fraction(str(percent)) / 100
    except (ValueError, ZeroDivisionError):
        raise SelectionError("percent must be a number") from None
    if not 0 < out <= 1:
        raise SelectionError("percent must be over 0 and at most 100")
    return out


def requested_count(parameters: dict, available: int) -> int:
    """``row_count`` (absolute) or ``percent`` of the candidates, rounded down."""
    if "row_count" in parameters and "percent" in parameters:
        raise SelectionError("give row_count or percent, not both")
    if "row_count" in parameters:
        n = parameters["row_count"]
    elif "percent" in parameters:
        n = int(available * share(parameters["percent"]))
    else:
        raise SelectionError("row_count or percent is required")
    if isinstance(n, bool) or not isinstance(n, int) or n < 1:
        raise SelectionError("selected row count must be a positive integer")
    if n > available:
        raise SelectionError(f"fault row_count {n} exceeds the {available} available rows")
    return n


def _needed_sql(parameters: dict) -> str:
    """``requested_count`` as SQL over ``_total``."""
    if "percent" in parameters:
        part = share(parameters["percent"])
        return f"CAST(_total AS DECIMAL(20,0)) * {part.numerator} DIV {part.denominator}"
    requested_count(parameters, 1 << 62)  # raises with the reason
    return str(int(parameters["row_count"]))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _ranked(requests: Sequence[tuple[int, SelectionRequest]], buckets: dict[int, int] | None = None) -> DataFrame:
    """``(_rid, _rank, _key)`` of all requests' candidates: each source is read once and
    its rows explode into one small struct for every request they are a candidate of."""
    groups: list[list[tuple[int, SelectionRequest]]] = []
    for i, r in requests:
        for g in groups:
            if g[0][1].key == r.key and g[0][1].candidates.sameSemantics(r.candidates):
                g.append((i, r))
                break
        else:
            groups.append([(i, r)])
    parts = []
    for group in groups:
        first = group[0][1]
        ranks = first.candidates.select(
            F.col(first.key).alias("_key"),
            *[F.when(r.is_candidate(), r.rank()).alias(f"_r{i}") for i, r in group],
        )
        entries = []
        for i, _ in group:
            held = f"_r{i} IS NOT NULL"
            if buckets is not None:
                held += f" AND {_bucket(f'_r{i}')} = {buckets[i]}"
            entries.append(f"CASE WHEN {held} THEN named_struct('_rid', {i}, '_rank', _r{i}) END")
        parts.append(
            ranks.selectExpr("_key", f"explode(array({', '.join(entries)})) AS _e")
            .filter("_e IS NOT NULL")
            .selectExpr("_e._rid AS _rid", "_e._rank AS _rank", "_key")
        )
    return _union(parts)


def _bucket(rank: str) -> str:
    return f"shiftright({rank}, {RANK_BITS - BUCKET_BITS})"


def resolve_boundaries(requests: Sequence[SelectionRequest]) -> list[Boundary]:
    """Boundaries of all requests, in two jobs for each type of key."""
    by_type: dict[str, list[int]] = {}
    for i, r in enumerate(requests):
        by_type.setdefault(r.candidates.schema[r.key].dataType.simpleString(), []).append(i)
    out: list[Boundary | None] = [None] * len(requests)
    for idx in by_type.values():
        for i, b in zip(idx, _resolve_same_type([requests[i] for i in idx])):
            out[i] = b
    return out  # type: ignore[return-value]


def _resolve_same_type(reqs: list[SelectionRequest]) -> list[Boundary]:
    numbered = list(enumerate(reqs))
    need = " ".join(f"WHEN {i} THEN {_needed_sql(r.parameters)}" for i, r in numbered)
    per_req = Window.partitionBy("_rid")
    running = per_req.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    located = (
        _ranked(numbered)
        .groupBy("_rid", F.expr(f"{_bucket('_rank')} AS _b"))
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_total", F.sum("_c").over(per_req))
        .withColumn("_cum", F.sum("_c").over(running))
        .withColumn("_need", F.expr(f"CAST(CASE _rid {need} END AS BIGINT)"))
        # the boundary's bucket; where too few rows are there, the last one tells the total
        .filter("_cum - _c < _need AND _cum >= _need OR _cum = _total AND (_need > _total OR _need < 1)")
        .select("_rid", "_b", "_c", "_cum", "_total", "_need")
        .collect()
    )
    found = {int(row["_rid"]): row for row in located}
    for i, r in numbered:
        requested_count(r.parameters, int(found[i]["_total"]) if i in found else 0)  # raises with the reason
    buckets = {i: int(found[i]["_b"]) for i, _ in numbered}
    before = {i: int(found[i]["_cum"]) - int(found[i]["_c"]) for i, _ in numbered}
    rest = " ".join(f"WHEN {i} THEN {int(found[i]['_need']) - before[i]}" for i, _ in numbered)
    up_to = Window.partitionBy("_rid").orderBy("_rank", "_key").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    picked = (
        _ranked(numbered, buckets)
        .groupBy("_rid", "_rank", "_key")
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_cum", F.sum("_c").over(up_to))
        .withColumn("_rest", F.expr(f"CAST(CASE _rid {rest} END AS BIGINT)"))
        .filter("_cum - _c < _rest AND _cum >= _rest")
        .collect()
    )
    exact = {int(row["_rid"]): row for row in picked}
    return [
        Boundary(int(exact[i]["_rank"]), exact[i]["_key"], before[i] + int(exact[i]["_cum"]), int(found[i]["_total"]))
        for i, _ in numbered
    ]


def selection_rank(
    seed: int,
    salt: str,
    key: str,
    anchor: Column | None = None,
    anchor_order: tuple[str, ...] = (),
) -> Column:
    """hash60 + 1 of the seeded key text; 0 for the anchor row, if any."""
    r = key_rank(seed, salt, key) + F.lit(1)
    if anchor is not None:
        this = F.col(anchor_order[0]) if len(anchor_order) == 1 else F.struct(*[F.col(c) for c in anchor_order])
        r = F.when(this == anchor, F.lit(0)).otherwise(r)
    return r


def selection_predicate(
    boundary: Boundary,
    seed: int,
    salt: str,
    key: str,
    anchor: Column | None = None,
    anchor_order: tuple[str, ...] = (),
) -> Column | str:
    """Row predicate of a resolved selection: SQL text, or a Column with an anchor."""
    if anchor is None:
        return boundary.predicate_sql(f"{key_rank_sql(seed, salt, key)} + 1", key)
    rank = selection_rank(seed, salt, key, anchor, anchor_order)
    return boundary.predicate(rank, F.col(key))
