"""Rebuild of the managed tables by deltas: only what a fault changes is computed again.

A variant differs from the clean tables by a signed multiset: rows it removes (weight -1) and
rows it adds (+1). The clean tables are built once; every table's delta then follows from the
deltas above it, for all variants together:

* join: a removed order takes its enriched rows along, an added one is joined only if the join
  key changed; a changed customer meets the orders of its key;
* count and sum: clean value plus the weighted delta of the touched groups;
* max: the larger of both, unless a row with the clean maximum was removed: only then are the
  rows of that group read again;
* checksum: a sum over row hashes, so clean plus the weighted hashes of the delta.

Groups whose values end up equal are dropped, so a delta ends where it has no effect. The
sources are read once, however many faults there are: a selection bit for each variant is
written along with the joined orders, and everything else is derived from that copy.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultbench.functions.hashing import combine_parts_sql, hash60_sql, hash_parts_sql, qi, row_text_sql, table_prefix
from faultbench.operators.downstream import ATTRIBUTES, MANAGED_TABLES
from faultbench.operators.faults import FaultedTables
from faultbench.operators.variants import MASK, Agg, RowChange, VariantSet, as_column
from faultbench.session import remove_folder, scratch_path

VARIANT, WEIGHT = "_variant", "_weight"
SELECTED, FIRST = "_chosen", "_first"

DAILY_KEYS = ("order_date", "currency")
CUSTOMER_KEYS = ("customer_id", *ATTRIBUTES)
DAILY: tuple[Agg, ...] = (("order_count", "count", None), ("revenue_cents", "sum", "amount_cents"))
CUSTOMER: tuple[Agg, ...] = (
    ("order_count", "count", None),
    ("lifetime_value_cents", "sum", "amount_cents"),
    ("last_order_ts", "max", "order_ts"),
)
DASHBOARD: tuple[Agg, ...] = (
    ("active_customers", "count", None),
    ("total_orders", "sum", "order_count"),
    ("total_revenue_cents", "sum", "lifetime_value_cents"),
    ("latest_order_ts", "max", "last_order_ts"),
)
ENRICHED = (
    "order_id", "customer_id", *ATTRIBUTES, "order_ts", "CAST(order_ts AS DATE) AS order_date",
    "amount_cents", "currency", "source_partition",
)


def same(left: str, right: str, keys: Sequence[str]) -> Column:
    """Null-safe equality of ``keys`` between two aliased tables."""
    each = [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys]
    return functools.reduce(lambda a, b: a & b, each)


def changed_rows(
    df: DataFrame, changes: Sequence[tuple[int, RowChange]], columns: Sequence[str], signs: tuple[int, ...] = (-1, 1)
) -> DataFrame:
    """``columns``, the variant's number and a weight: the rows that each change removes or adds.

    ``df`` has a bit for each variant in ``SELECTED``. Rows that no change selects are dropped by a
    filter that reaches the scan; the others emit one small number for each of their changes.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    codes = [
        f"CASE WHEN {SELECTED} & {1 << v} != 0 THEN {s * v} END"
        for v, ch in changes
        for s in signs
        if ch.mode in (("update", "delete") if s < 0 else ("update", "insert"))
    ]
    if not codes:
        none = [F.lit(0).alias(VARIANT), F.lit(0).alias(WEIGHT)]
        return df.select(*columns, *none).limit(0)
    found = df.filter(f"{SELECTED} != 0").withColumn("_code", F.explode(F.expr(f"array({', '.join(codes)})")))
    found = found.filter("_code IS NOT NULL")
    out = []
    for c in columns:
        value = None
        for v, ch in changes:
            if c in ch.updates:
                now = as_column(ch.updates[c]).cast(types[c])
                value = (F if value is None else value).when(F.col("_code") == v, now)
        out.append((F.col(c) if value is None else value.otherwise(F.col(c))).alias(c))
    return found.select(*out, F.abs("_code").alias(VARIANT), F.signum("_code").cast("int").alias(WEIGHT))


def _value(expr: Column | str | None) -> Column:
    return as_column(expr) if expr is not None else F.lit(1)


def _held(name: str) -> str:
    return f"_held_{name}"


def clean_groups(rows: DataFrame, keys: Sequence[str], aggs: Sequence[Agg]) -> DataFrame:
    """``GROUP BY keys``, with the rows of each group and how many values each sum has (an empty sum is NULL)."""
    measures = [F.count(F.lit(1)).alias("_rows")]
    for name, fn, expr in aggs:
        if fn not in ("count", "sum", "max"):
            raise ValueError(f"no delta rule for aggregate {fn!r}")
        measures.append({"count": F.count, "sum": F.sum, "max": F.max}[fn](_value(expr)).alias(name))
        if fn == "sum":
            measures.append(F.count(_value(expr)).alias(_held(name)))
    return rows.groupBy(*keys).agg(*measures)


def group_delta(
    clean: DataFrame, rows: DataFrame, delta: DataFrame, keys: Sequence[str], aggs: Sequence[Agg]
) -> DataFrame:
    """The signed rows (keys, aggregates, variant, weight) by which groups differ from ``clean``.

    ``clean``: output of :func:`clean_groups` over ``rows``; ``delta``: signed rows below them.
    Without keys there is one group, which never vanishes.
    """
    keys, maxima = list(keys), [(name, expr) for name, fn, expr in aggs if fn == "max"]
    w = F.col(WEIGHT)
    measures = [F.sum(w).alias("_d_rows")]
    for name, fn, expr in aggs:
        if fn == "sum":
            measures.append(F.sum(w * _value(expr)).alias(f"_d_{name}"))
            measures.append(F.sum(F.when(_value(expr).isNotNull(), w)).alias(f"_c_{name}"))
        elif fn == "max":
            measures.append(F.max(F.when(w > 0, _value(expr))).alias(f"_up_{name}"))
            measures.append(F.max(F.when(w < 0, _value(expr))).alias(f"_down_{name}"))
    touched = delta.groupBy(VARIANT, *keys).agg(*measures)
    if keys:
        joined = touched.alias("t").join(clean.alias("c"), same("t", "c", keys), "left")
        joined = joined.select("t.*", *[F.col(f"c.{c}").alias(f"_was_{c}") for c in clean.columns if c not in keys])
    else:  # one clean row: a scalar, not a join
        whole = clean.select(F.struct(*clean.columns)).scalar()
        joined = touched.withColumn("_was", whole).select("*", *[F.col(f"_was.{c}").alias(f"_was_{c}") for c in clean.columns])
    joined = joined.withColumn("_now__rows", F.coalesce("_was__rows", F.lit(0)) + F.col("_d_rows"))
    for name, fn, _ in aggs:
        was, now = F.col(f"_was_{name}"), f"_now_{name}"
        if fn == "count":
            joined = joined.withColumn(now, F.col("_now__rows"))
        elif fn == "sum":
            held = F.coalesce(f"_was_{_held(name)}", F.lit(0)) + F.coalesce(f"_c_{name}", F.lit(0))
            joined = joined.withColumn(now, F.when(held > 0, F.coalesce(was, F.lit(0)) + F.coalesce(f"_d_{name}", F.lit(0))))
        else:
            joined = joined.withColumn(now, F.when(F.col("_now__rows") > 0, F.greatest(was, F.col(f"_up_{name}"))))
    for name, expr in maxima:
        lost = F.col(f"_down_{name}").eqNullSafe(F.col(f"_was_{name}")) & F.col(f"_down_{name}").isNotNull()
        beaten = F.coalesce(F.col(f"_up_{name}") >= F.col(f"_was_{name}"), F.lit(False))
        open_ = joined.filter(lost & ~beaten & (F.col("_now__rows") > 0)).select(VARIANT, *keys)
        again = _remaining_max(rows, delta, open_, keys, expr, name)
        on = same("j", "a", [VARIANT, *keys])
        joined = joined.alias("j").join(again.alias("a"), on, "left").select(
            *[F.col(f"j.{c}") for c in joined.columns if c != f"_now_{name}"],
            F.when(F.col("a._found"), F.col("a._max")).otherwise(F.col(f"j._now_{name}")).alias(f"_now_{name}"),
        )
    names = [name for name, _, _ in aggs]
    equal = functools.reduce(lambda a, b: a & b, [F.col(f"_was_{n}").eqNullSafe(F.col(f"_now_{n}")) for n in names])
    there = F.lit(True) if not keys else F.col("_was__rows").isNotNull()
    stays = F.lit(True) if not keys else F.col("_now__rows") > 0
    sides = [
        F.when(there, F.struct(*[F.col(f"_was_{n}").alias(n) for n in names], F.lit(-1).alias(WEIGHT))),
        F.when(stays, F.struct(*[F.col(f"_now_{n}").alias(n) for n in names], F.lit(1).alias(WEIGHT))),
    ]
    moved = joined.filter(~(equal & there & stays)).select(*keys, VARIANT, F.explode(F.array(*sides)).alias("_s"))
    return moved.filter("_s IS NOT NULL").select(*keys, *[f"_s.{n}" for n in names], VARIANT, f"_s.{WEIGHT}")


def _remaining_max(
    rows: DataFrame, delta: DataFrame, open_: DataFrame, keys: list[str], expr: Column | str | None, name: str
) -> DataFrame:
    """Largest value left in each open (variant, group): equal values are counted before and after the delta."""
    value = _value(expr).alias("_v")
    have = rows.select(*keys, value).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias(WEIGHT))
    if keys:
        have = have.alias("h").join(open_.alias("o"), same("h", "o", keys)).select(
            f"o.{VARIANT}", *[f"h.{k}" for k in keys], "h._v", f"h.{WEIGHT}"
        )
    else:  # every value counts for each open variant
        have = have.withColumn(VARIANT, F.explode(open_.select(F.collect_list(VARIANT)).scalar())).select(VARIANT, "_v", WEIGHT)
    on = [VARIANT, *keys]
    diff = delta.select(VARIANT, *keys, value, F.col(WEIGHT).cast("long").alias(WEIGHT)).alias("d")
    diff = diff.join(open_.alias("o"), same("d", "o", on), "left_semi")
    left = have.unionByName(diff).groupBy(*on, "_v").agg(F.sum(WEIGHT).alias("_n")).filter("_n > 0")
    return left.groupBy(*on).agg(F.max("_v").alias("_max")).withColumn("_found", F.lit(True))


@dataclass
class DeltaRebuild:
    """All managed tables of a set of faults: the clean ones, and each table's signed delta.

    ``sources``: the clean ``raw_customers`` and ``raw_orders``. ``close`` removes the written copies.
    """

    spark: SparkSession
    sources: Mapping[str, DataFrame]
    faulted: FaultedTables
    paths: list[str] = field(default_factory=list)

    @property
    def variants(self) -> VariantSet:
        return self.faulted.variants

    def _changes(self, table: str) -> list[tuple[int, RowChange]]:
        number = {v: i for i, v in enumerate(self.variants.names)}
        return [(number[pl.change.variant], pl.change) for pl in self.faulted.plans if pl.spec.target_table == table]

    def _with_bits(self, table: str) -> DataFrame:
        """The clean rows and, in SELECTED, a bit for each variant that changes the row."""
        df = self.faulted.flagged.get(table, self.sources[table])
        bits = F.lit(0).cast("bigint")
        for v, ch in self._changes(table):
            bits = bits + F.when(as_column(ch.selected), F.lit(1 << v)).otherwise(F.lit(0))
        return df.select(*self.sources[table].columns, bits.alias(SELECTED))

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, f"deltas-{name}")
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        for path in self.paths:
            remove_folder(self.spark, path)
        self.paths = []
        for name in ("_customers", "_orders", "deltas", "clean"):
            self.__dict__.pop(name, None)

    def selected_orders(self) -> DataFrame:
        """The clean orders from their source, with their bits."""
        return self._with_bits("raw_orders").withColumn(FIRST, F.lit(True))

    # -- the copies: each source is read once ------------------------------------
    @functools.cached_property
    def _customers(self) -> DataFrame:
        """Customers with their bits; FIRST marks one row of each key."""
        own = self._written(self._with_bits("raw_customers").withColumn("_id", F.monotonically_increasing_id()), "customers")
        first = own.groupBy("customer_id").agg(F.min("_id").alias("_least"))
        keyed = own.alias("c").join(first.alias("f"), same("c", "f", ["customer_id"]))
        return keyed.select("c.*", (F.col("_id") == F.col("_least")).alias(FIRST)).drop("_id")

    @functools.cached_property
    def _orders(self) -> DataFrame:
        """Orders with their bits and each matching customer's attributes; FIRST marks an order's first row."""
        c = self._customers.select(F.col("customer_id").alias("_ck"), *ATTRIBUTES, F.col(FIRST))
        orders = self._with_bits("raw_orders")
        joined = orders.join(c, F.col("customer_id") == F.col("_ck"), "left")
        return self._written(joined.select(*orders.columns, *ATTRIBUTES, F.coalesce(FIRST, F.lit(True)).alias(FIRST)), "orders")

    @property
    def joined_orders(self) -> DataFrame:
        """The written copy: a row for each order and matching customer, with the order's bits."""
        return self._orders

    # -- clean tables --------------------------------------------------------------
    @functools.cached_property
    def clean(self) -> dict[str, DataFrame]:
        """The clean tables; marts with the helper columns of :func:`clean_groups`."""
        enriched = self._orders.selectExpr(*ENRICHED)
        daily = self._written(clean_groups(enriched, DAILY_KEYS, DAILY), "daily")
        customer = self._written(clean_groups(enriched, CUSTOMER_KEYS, CUSTOMER), "customer")
        return {
            "raw_customers": self._customers.select(*self.sources["raw_customers"].columns),
            "raw_orders": self._orders.filter(FIRST).select(*self.sources["raw_orders"].columns),
            "orders_enriched": enriched,
            "daily_revenue": daily,
            "customer_value": customer,
            "executive_dashboard": clean_groups(customer, (), DASHBOARD),
        }

    # -- deltas --------------------------------------------------------------------
    def _enriched_delta(self, orders_delta: DataFrame, customers_delta: DataFrame) -> DataFrame:
        changes = self._changes("raw_orders")
        stay = [(v, ch) for v, ch in changes if "customer_id" not in ch.updates]
        move = [(v, ch) for v, ch in changes if "customer_id" in ch.updates]
        columns = [c for c in self._orders.columns if c not in (SELECTED, FIRST)]
        signs = [VARIANT, WEIGHT]
        parts = [changed_rows(self._orders, stay, columns), changed_rows(self._orders, move, columns, (-1,))]
        moved = [v for v, _ in move]
        if moved:  # a new join key: the added rows meet the customers again
            c = self._customers.select(F.col("customer_id").alias("_ck"), *ATTRIBUTES)
            added = orders_delta.filter((F.col(WEIGHT) > 0) & F.col(VARIANT).isin(moved))
            parts.append(added.join(c, F.col("customer_id") == F.col("_ck"), "left").drop("_ck"))
        if self._changes("raw_customers"):
            parts.append(self._through_customers(customers_delta))
        return functools.reduce(DataFrame.unionByName, [p.selectExpr(*ENRICHED, *signs) for p in parts])

    def _through_customers(self, customers_delta: DataFrame) -> DataFrame:
        """Orders of the keys whose customers change. A key that loses its last customer gets one row
        without attributes, one that gets its first loses that row: the join keeps every order."""
        held = customers_delta.filter("customer_id IS NOT NULL")
        moved = held.groupBy(VARIANT, "customer_id").agg(F.sum(WEIGHT).alias("_d"))
        n = self._customers.groupBy("customer_id").agg(F.count(F.lit(1)).alias("_n"))
        both = moved.join(n, "customer_id", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
        pad = F.when((F.col("_n") > 0) & (F.col("_n") + F.col("_d") == 0), 1)
        pad = pad.when((F.col("_n") == 0) & (F.col("_d") > 0), -1)
        empty = [F.lit(None).cast("string").alias(a) for a in ATTRIBUTES]
        padded = both.select("customer_id", *empty, VARIANT, pad.alias(WEIGHT)).filter(f"{WEIGHT} IS NOT NULL")
        every = held.select("customer_id", *ATTRIBUTES, VARIANT, WEIGHT).unionByName(padded)
        orders = self._orders.filter(FIRST).select(*self.sources["raw_orders"].columns)
        return orders.join(every, "customer_id")

    @functools.cached_property
    def deltas(self) -> dict[str, DataFrame]:
        """Signed rows (columns, variant's number, weight) of every managed table."""
        clean = self.clean
        customers = changed_rows(self._customers, self._changes("raw_customers"), self.sources["raw_customers"].columns)
        first = self._orders.filter(FIRST)
        orders = changed_rows(first, self._changes("raw_orders"), self.sources["raw_orders"].columns)
        enriched = self._written(self._enriched_delta(orders, customers), "delta-enriched")
        daily = group_delta(clean["daily_revenue"], clean["orders_enriched"], enriched, DAILY_KEYS, DAILY)
        value = group_delta(clean["customer_value"], clean["orders_enriched"], enriched, CUSTOMER_KEYS, CUSTOMER)
        value = self._written(value, "delta-customer")
        return {
            "raw_customers": customers,
            "raw_orders": orders,
            "orders_enriched": enriched,
            "daily_revenue": self._written(daily, "delta-daily"),
            "customer_value": value,
            "executive_dashboard": group_delta(clean["executive_dashboard"], clean["customer_value"], value, (), DASHBOARD),
        }

    # -- results -------------------------------------------------------------------
    def _columns(self, table: str) -> list[str]:
        return [c for c in self.deltas[table].columns if c not in (VARIANT, WEIGHT)]

    def sizes(self) -> DataFrame:
        """(variant, table_name, removed, added): rows of each delta that has any."""
        parts = [
            self.deltas[t].groupBy(VARIANT).agg(
                F.lit(t).alias("table_name"),
                F.sum(F.when(F.col(WEIGHT) < 0, -F.col(WEIGHT)).otherwise(0)).alias("removed"),
                F.sum(F.when(F.col(WEIGHT) > 0, F.col(WEIGHT)).otherwise(0)).alias("added"),
            )
            for t in MANAGED_TABLES
        ]
        return self._named(functools.reduce(DataFrame.unionByName, parts), "table_name", "removed", "added")

    def _named(self, df: DataFrame, *columns: str) -> DataFrame:
        names = F.array(*[F.lit(v) for v in self.variants.names])
        return df.select(F.element_at(names, F.col(VARIANT).cast("int") + 1).alias("variant"), *columns)

    def mart(self, table: str) -> DataFrame:
        """The variant table of a mart: clean rows, without those a variant removes, and the added ones."""
        keys = {"daily_revenue": DAILY_KEYS, "customer_value": CUSTOMER_KEYS, "executive_dashboard": ()}[table]
        columns, delta = self._columns(table), self.deltas[table]
        bit = f"shiftleft(CAST(1 AS BIGINT), CAST({VARIANT} AS INT))"
        gone = delta.filter(F.col(WEIGHT) < 0).groupBy(*keys).agg(F.expr(f"bit_or({bit})").alias("_gone"))
        clean = self.clean[table].select(*columns)
        if keys:
            rest = clean.alias("c").join(gone.alias("g"), same("c", "g", keys), "left").select("c.*", "g._gone")
        else:
            rest = clean.withColumn("_gone", gone.scalar())
        left = F.lit(self.variants.all_mask).bitwiseAND(F.bitwise_not(F.coalesce("_gone", F.lit(0).cast("bigint"))))
        rest = rest.select(*columns, left.alias(MASK)).filter(f"{MASK} != 0")
        return rest.unionByName(delta.filter(F.col(WEIGHT) > 0).selectExpr(*map(qi, columns), f"{bit} AS {MASK}"))

    def checksums(self) -> DataFrame:
        """(variant, table_name, row_count, checksum): equal to the checksums of the rebuilt tables."""
        parts = []
        for t in MANAGED_TABLES:
            columns, types = self._columns(t), {f.name: f.dataType for f in self.deltas[t].schema.fields}
            h = f"{hash60_sql(row_text_sql(types, columns, table_prefix(t, columns)))} AS _h"
            base = self.clean[t].selectExpr(f"'{t}' AS table_name", f"0 AS {VARIANT}", f"1 AS {WEIGHT}", h)
            parts += [base, self.deltas[t].selectExpr(f"'{t}' AS table_name", VARIANT, WEIGHT, h)]
        hashed = functools.reduce(DataFrame.unionByName, parts)
        sums = [f"sum({WEIGHT} * ({p})) AS _h{i}" for i, p in zip((2, 1, 0), hash_parts_sql("_h"))]
        totals = hashed.groupBy("table_name", VARIANT).agg(F.sum(WEIGHT).alias("_n"), *[F.expr(s) for s in sums])
        # Clean totals count for every variant; tables without rows and without changes have a row of zeros.
        every = F.expr(f"CASE WHEN {VARIANT} = 0 THEN sequence(0, {len(self.variants.names) - 1}) ELSE array({VARIANT}) END")
        spread = totals.withColumn(VARIANT, F.explode(every))
        zeros = self.spark.createDataFrame([(t, 0) for t in MANAGED_TABLES], f"table_name string, {VARIANT} int")
        zeros = zeros.withColumn(VARIANT, F.explode(every)).select("*", *[F.lit(0).cast("bigint").alias(c) for c in totals.columns[2:]])
        out = self._named(spread.unionByName(zeros), *[c for c in totals.columns if c != VARIANT])
        return out.groupBy("variant", "table_name").agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"),
            F.expr(f"{combine_parts_sql('sum(_h2)', 'sum(_h1)', 'sum(_h0)')} AS checksum"),
        )
