"""Predicted blast radius from the fixed column-level lineage contract.

The contract graph has a few dozen edges (configuration, not data), so its closure
is computed on the driver. Data-scale graphs use ``operators.lineage.closure``.
"""

from __future__ import annotations

from collections.abc import Iterable

from faultbench.plans.contract import COLUMN_EDGES, TABLE_EDGES


def _closure(edges: Iterable[tuple[object, object]], seeds: Iterable[object]) -> set:
    out: dict[object, list[object]] = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    seen = set(seeds)
    frontier = list(seen)
    while frontier:
        nxt = []
        for node in frontier:
            for m in out.get(node, ()):
                if m not in seen:
                    seen.add(m)
                    nxt.append(m)
        frontier = nxt
    return seen


def downstream_tables(table: str) -> tuple[str, ...]:
    """Table-level closure including the source, sorted."""
    return tuple(sorted(_closure(TABLE_EDGES, [table])))


def predicted_tables(table: str, columns: Iterable[str]) -> tuple[str, ...]:
    """Tables reached from changed columns of ``table`` by column-level lineage."""
    col_edges = [((a, b), (c, d)) for a, b, c, d in COLUMN_EDGES]
    reached = _closure(col_edges, [(table, c) for c in columns])
    return tuple(sorted({t for t, _ in reached}))
