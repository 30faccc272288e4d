"""A fault campaign end to end, as a handful of Spark jobs.

1. selection: a few small jobs per fault resolve the seeded key selections;
2. baseline: every fault variant of every managed table, their checksums and all
   baseline controls come out of one shared plan (``variants``);
3. gaps: faults no baseline control caught (a small result on the driver);
4. profile: one aggregate over the clean source for the gap columns;
5. improved: generated controls are evaluated over the same variant tables.

Nothing but aggregated results (one row per fault, control or table) reaches the
driver.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import date
from decimal import Decimal

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultbench.operators import checksum as ck
from faultbench.operators.controls import (
    Control,
    coverage,
    detection_matrix,
    evaluate_controls,
    failing_on_clean,
    safe_identifier,
)
from faultbench.operators.faults import (
    NULL_DENSITY_SURGE,
    NUMERIC_SCALE,
    STALE_PARTITION,
    FaultedTables,
    FaultSpec,
    apply_faults,
    mutation_evidence,
)
from faultbench.operators.deltas import DeltaRebuild
from faultbench.operators.groupwise import (
    FALSE_ALARM,
    WITHDRAWN,
    marks,
    marks_control,
    null_limits,
    null_share_control,
    profile_groups,
)
from faultbench.operators.downstream import (
    MANAGED_TABLES,
    build_enriched,
    customer_totals,
    customer_value,
    daily_revenue,
    executive_dashboard,
)
from faultbench.operators.snapshots import remove_snapshot, require_verified, snapshot
from faultbench.operators.variants import CLEAN, MAX_VARIANTS, VariantSet
from faultbench.session import checkpoint_dir, remove_folder, scratch_path
from faultbench.plans.contract import (
    BASELINE_CONTROLS,
    DEFAULT_SEED,
    LOAD_CONTROLS,
    PRIMARY_KEYS,
    default_faults,
)
from faultbench.plans.lineage_contract import predicted_tables
from faultbench.sources.tables import source_tables


class GenerationRefused(ValueError):
    pass


class CampaignFailed(RuntimeError):
    """A condition that an enforcing run checks does not hold."""


@dataclass(frozen=True)
class CampaignReport:
    """Small results of an enforcing run."""

    mutated_rows: dict[str, int]
    failing_on_clean: tuple[str, ...]
    baseline_detected: tuple[str, ...]
    detected: tuple[str, ...]
    gaps: tuple[str, ...]
    generated: tuple[str, ...]
    refused: tuple[tuple[str, str], ...]
    radius_mismatches: tuple[tuple[str, str, str], ...]


@dataclass
class Campaign:
    spark: SparkSession
    sf_dir: str
    profile: str = "events"
    faults: Sequence[FaultSpec] = field(default_factory=default_faults)
    seed: int = DEFAULT_SEED
    baseline_controls: Sequence[Control] = BASELINE_CONTROLS
    # How the large shared intermediates (the stacked orders and the enriched variant
    # table) are kept between the campaign's jobs. "written" (default): checksums, which
    # read every column of every table, write the enriched table once to the shared
    # checkpoint folder, and all marts are derived from that copy; controls before that
    # read only the columns they need from the sources. "none": every job goes back to
    # the sources. "cache" (executor memory and disk) and "checkpoint" keep both from the
    # start. ``close`` removes what was kept. Small aggregated results are always kept.
    materialize: str = "written"
    # Rates that the bounds by group are set for (see ``operators.groupwise``).
    false_alarm: float = FALSE_ALARM
    withdrawn: float = WITHDRAWN
    # Source tables ``raw_customers`` / ``raw_orders``; read from ``sf_dir`` if None.
    tables_in: dict[str, DataFrame] | None = None

    def __post_init__(self) -> None:
        self._kept: list[DataFrame] = []
        self._paths: list[str] = []

    # -- inputs -------------------------------------------------------------
    @functools.cached_property
    def sources(self) -> dict[str, DataFrame]:
        if self.tables_in is not None:
            return dict(self.tables_in)
        return source_tables(self.spark, self.sf_dir, self.profile)

    @functools.cached_property
    def blocks(self) -> list[FaultedTables]:
        """The faults' variant tables. A mask holds MAX_VARIANTS variants, so more faults
        than that are worked off in several blocks, each beside the clean variant."""
        ids = [s.fault_id for s in self.faults]
        if len(set(ids)) != len(ids):
            raise ValueError("fault ids must be unique")
        size = MAX_VARIANTS - 1
        chunks = [self.faults[i : i + size] for i in range(0, len(self.faults), size)] or [()]
        return [apply_faults(self.sources, PRIMARY_KEYS, chunk, self.seed) for chunk in chunks]

    @property
    def faulted(self) -> FaultedTables:
        """The variant tables of a campaign with a single block of faults."""
        if len(self.blocks) > 1:
            raise ValueError(f"{len(self.faults)} faults fill {len(self.blocks)} blocks: see blocks")
        return self.blocks[0]

    @property
    def variants(self):
        return self.faulted.variants

    def _keep(self, df: DataFrame, name: str, mode: str) -> DataFrame:
        if mode == "cache":
            df = df.persist(StorageLevel.MEMORY_AND_DISK)
            self._kept.append(df)
        elif mode == "checkpoint":
            checkpoint_dir(self.spark)
            df = df.checkpoint(eager=True)
        elif mode == "written":
            path = scratch_path(self.spark, f"campaign-{name}")
            df.write.parquet(path)
            self._paths.append(path)
            df = self.spark.read.schema(df.schema).parquet(path)
        elif mode != "none":
            raise ValueError(f"unknown materialize mode {mode!r}")
        return df

    def _built(self, ft: FaultedTables, mode: str) -> dict[str, DataFrame]:
        vs, customers = ft.variants, ft.tables["raw_customers"]
        vary = any(pl.spec.target_table == "raw_customers" for pl in ft.plans)
        orders = ft.tables["raw_orders"]
        if mode != "written":
            orders = self._keep(orders, "orders", mode)
        enriched = self._keep(build_enriched(orders, customers, vs, customers_vary=vary), "enriched", mode)
        if mode == "written":  # the join is done already: sum its rows
            cv = customer_totals(enriched, vs)
        else:
            cv = customer_value(orders, customers, vs, customers_vary=vary)
        return {
            "raw_customers": customers,
            "raw_orders": orders,
            "orders_enriched": enriched,
            "daily_revenue": daily_revenue(enriched, vs),
            "customer_value": cv,
            "executive_dashboard": executive_dashboard(cv, vs),
        }

    @functools.cached_property
    def _lazy_tables(self) -> list[dict[str, DataFrame]]:
        mode = "none" if self.materialize == "written" else self.materialize
        return [self._built(ft, mode) for ft in self.blocks]

    @functools.cached_property
    def _written_tables(self) -> list[dict[str, DataFrame]]:
        return [self._built(ft, "written") for ft in self.blocks]

    def block_tables(self, whole: bool = False) -> list[dict[str, DataFrame]]:
        """All managed tables of each block; ``whole``: they will be read in full."""
        if self.materialize == "written" and (whole or "_written_tables" in self.__dict__):
            return self._written_tables
        return self._lazy_tables

    @property
    def tables(self) -> dict[str, DataFrame]:
        self.faulted  # one block only
        return self.block_tables()[0]

    def _each_block(self, make) -> DataFrame:
        """Union of ``make(tables, variants)`` over the blocks; clean rows from the first only."""
        out = None
        for ft, tables in zip(self.blocks, self.block_tables()):
            part = make(tables, ft.variants)
            out = part if out is None else out.unionByName(part.filter(F.col("variant") != CLEAN))
        return out

    # -- rebuild by deltas --------------------------------------------------
    @functools.cached_property
    def rebuilds(self) -> list[DeltaRebuild]:
        """The managed tables of each block as clean tables and signed deltas."""
        return [DeltaRebuild(self.spark, self.sources, ft) for ft in self.blocks]

    def delta_checksums(self) -> DataFrame:
        """As ``checksums``, from clean sums and the hashes of changed rows only."""
        first, *more = [r.checksums() for r in self.rebuilds]
        return functools.reduce(DataFrame.unionByName, [first, *[m.filter(F.col("variant") != CLEAN) for m in more]])

    def close(self) -> None:
        """Release cached intermediates and remove written ones."""
        for rebuild in self.__dict__.get("rebuilds", []):
            rebuild.close()
        for df in self._kept:
            df.unpersist()
        for path in self._paths:
            remove_folder(self.spark, path)
        self._kept, self._paths = [], []
        for ft in self.__dict__.get("blocks", []):
            ft.release()
        for name in ("_lazy_tables", "_written_tables", "baseline_results", "bound_results", "_open", "_group_bounds",
                     "measured_bounds", "_gaps_and_profile", "rebuilds", "blocks"):
            self.__dict__.pop(name, None)

    def fault_table(self) -> DataFrame:
        rows = [(s.fault_id, s.kind, s.target_table) for s in self.faults]
        return self.spark.createDataFrame(rows, "fault_id string, kind string, target_table string")

    # -- evidence -----------------------------------------------------------
    def checksums(self) -> DataFrame:
        self.block_tables(whole=True)
        return self._each_block(lambda tables, vs: ck.table_checksums({n: tables[n] for n in MANAGED_TABLES}, vs))

    def mutation_evidence(self) -> DataFrame:
        return functools.reduce(DataFrame.unionByName, [mutation_evidence(ft, PRIMARY_KEYS) for ft in self.blocks])

    def observed_radius(self) -> DataFrame:
        return ck.observed_blast_radius(self.checksums())

    def predicted_radius(self) -> DataFrame:
        rows = []
        for s in self.faults:
            tables = s.expected_tables or predicted_tables(s.target_table, s.changed_columns)
            rows += [(s.fault_id, t) for t in tables]
        return self.spark.createDataFrame(rows, "fault_id string, table_name string")

    def radius_comparison(self) -> DataFrame:
        return ck.compare_blast_radius(self.observed_radius(), self.predicted_radius())

    # -- controls -----------------------------------------------------------
    def control_results(self, controls: Sequence[Control]) -> DataFrame:
        return self._each_block(lambda tables, vs: evaluate_controls(tables, vs, controls))

    @functools.cached_property
    def baseline_results(self) -> DataFrame:
        """Baseline control results, kept (one row per variant and control): the gap
        decision and the final matrices both read them, so the controls run once."""
        df = self.control_results(self.baseline_controls).persist(StorageLevel.MEMORY_AND_DISK)
        self._kept.append(df)
        return df

    def baseline_matrix(self) -> DataFrame:
        return detection_matrix(self.baseline_results, self.fault_table())

    @functools.cached_property
    def _gaps_and_profile(self) -> tuple[tuple[str, ...], dict[str, tuple[str, str, str]]]:
        """One action: undetected faults of the baseline and the clean profile of every
        generator-eligible fault (one small row each)."""
        m = self.baseline_matrix().filter(~F.col("detected")).select(
            F.lit("gap").alias("row"), "fault_id",
            F.lit(None).cast("string").alias("column_name"),
            F.lit(None).cast("string").alias("statistic"),
            F.lit(None).cast("string").alias("value"),
        )
        eligible = [s.fault_id for s in self.faults]
        p = self.clean_profile_frame(eligible).select(F.lit("profile").alias("row"), "*")
        rows = m.unionByName(p).collect()
        found = {r["fault_id"] for r in rows if r["row"] == "gap"}
        gaps = tuple(s.fault_id for s in self.faults if s.fault_id in found)
        prof = {r["fault_id"]: (r["column_name"], r["statistic"], r["value"]) for r in rows if r["row"] == "profile"}
        return gaps, prof

    @property
    def gaps(self) -> tuple[str, ...]:
        return self._gaps_and_profile[0]

    # -- profile and generation --------------------------------------------
    def _generator(self, fault_id: str) -> tuple[str, str] | str:
        """(column, statistic) of the bound that can catch a fault, or why there is none."""
        s = next(f for f in self.faults if f.fault_id == fault_id)
        if s.target_table != "raw_orders":
            return f"no generator for faults on {s.target_table}"
        types = {f.name: f.dataType for f in self.sources["raw_orders"].schema.fields}
        for kind, parameter, wanted, statistic in (
            (NUMERIC_SCALE, "column", T.NumericType, "max"),
            (STALE_PARTITION, "partition_column", T.DateType, "min"),
        ):
            if s.kind == kind:
                column = safe_identifier(str(s.parameters[parameter]))
                if isinstance(types.get(column), wanted):
                    return column, statistic
                return f"column {column} has no type that can be bounded"
        return f"no generator for kind {s.kind}"

    def profile_columns(self, gaps: Sequence[str]) -> list[tuple[str, str, str]]:
        """(fault_id, column, statistic) for every generator-eligible gap.

        Type guard: a numeric bound on any numeric column, freshness only on DATE.
        """
        if len(set(gaps)) != len(gaps):
            raise GenerationRefused("measured gaps are duplicated")
        found = [(g, self._generator(g)) for g in gaps]
        return [(g, *how) for g, how in found if not isinstance(how, str)]

    def refused(self, gaps: Sequence[str] | None = None) -> list[tuple[str, str]]:
        """(fault_id, reason) of gaps for which no control is generated."""
        found = [(g, self._generator(g)) for g in (self.gaps if gaps is None else gaps)]
        by_group = self._group_bounds[2] if gaps is None else {}
        return [(g, how) for g, how in found if isinstance(how, str) and g not in by_group]

    def clean_profile_frame(self, gaps: Sequence[str] | None = None) -> DataFrame:
        """One aggregate over the clean source for all profiled columns."""
        wanted = self.profile_columns(self.gaps if gaps is None else gaps)
        src = self.sources["raw_orders"]
        aggs = []
        for fault_id, col, stat in wanted:
            fn = F.max if stat == "max" else F.min
            value = F.col(col)
            if isinstance(src.schema[col].dataType, (T.DoubleType, T.FloatType)):
                # NaN exceeds every number and no value exceeds it, nor infinity: bounds come from finite values.
                value = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
            aggs.append(
                F.struct(
                    F.lit(fault_id).alias("fault_id"),
                    F.lit(col).alias("column_name"),
                    F.lit(stat).alias("statistic"),
                    fn(value).cast("string").alias("value"),
                )
            )
        if not aggs:
            return self.spark.createDataFrame(
                [], "fault_id string, column_name string, statistic string, value string"
            )
        return src.agg(F.array(*aggs).alias("p")).select(F.explode("p").alias("p")).select("p.*")

    @property
    def clean_profile(self) -> list[tuple[str, str, str, str]]:
        """Profile rows of the measured gaps (from the same action as the gaps)."""
        gaps, prof = self._gaps_and_profile
        eligible = {f for f, _, _ in self.profile_columns(gaps)}
        return [(f, *prof[f]) for f in gaps if f in eligible and f in prof]

    def _bound(self, column: str, value: str) -> str:
        """A profile value as a literal of the column's type."""
        dtype = self.sources["raw_orders"].schema[column].dataType
        if isinstance(dtype, T.IntegralType):
            return str(int(value))
        if isinstance(dtype, T.DateType):
            return f"DATE '{date.fromisoformat(value).isoformat()}'"
        Decimal(value)  # digits only
        kind = dtype.simpleString() if isinstance(dtype, T.DecimalType) else "double"
        return f"CAST('{value}' AS {kind.upper()})"

    def _finite(self, column: str) -> str:
        """Bounds come from finite values and judge finite values: infinity is no number to be scaled, and
        NaN sorts above it."""
        floating = isinstance(self.sources["raw_orders"].schema[column].dataType, (T.DoubleType, T.FloatType))
        return f" AND {column} < CAST('Infinity' AS DOUBLE)" if floating else ""

    @property
    def generated_controls(self) -> tuple[Control, ...]:
        """One control for each bound column and statistic, for all faults that share it."""
        by: dict[tuple[str, str], tuple[str, list[str]]] = {}
        for fault_id, col, stat, value in self.clean_profile:
            if value is None:
                raise GenerationRefused(f"clean profile of {col} is empty")
            by.setdefault((col, stat), (value, []))[1].append(fault_id)
        out = []
        for (col, stat), (value, fault_ids) in by.items():
            if stat == "max":
                name, kind, op = f"orders_{col}_reasonable", NUMERIC_SCALE, ">"
            else:
                part = "partition" if col == "source_partition" else col
                name, kind, op = f"orders_{part}_not_stale", STALE_PARTITION, "<"
            out.append(
                Control(
                    name,
                    "raw_orders",
                    predicate=f"{col} {op} {self._bound(col, value)}{self._finite(col)}",
                    description=f"{stat} of {col} on clean data, for " + ", ".join(fault_ids),
                    detects_faults=(kind,),
                    generated=True,
                )
            )
        return tuple(out)

    @functools.cached_property
    def bound_results(self) -> DataFrame:
        """Results of the generated bounds, kept like those of the baseline."""
        df = self.control_results(self.generated_controls).persist(StorageLevel.MEMORY_AND_DISK)
        self._kept.append(df)
        return df

    @functools.cached_property
    def _open(self) -> set[str]:
        """Faults that neither baseline nor column bounds detect."""
        results = self.baseline_results
        if self.generated_controls:
            results = results.unionByName(self.bound_results)
        return {r["fault_id"] for r in detection_matrix(results, self.fault_table()).filter("NOT detected").collect()}

    @functools.cached_property
    def _group_bounds(self) -> tuple[tuple[Control, ...], dict[str, DataFrame], dict[str, str]]:
        """Controls by group for faults that neither baseline nor column bounds detect, the tables that
        they compare with, and which control was made for which fault."""
        return self._bounds_by_group([s for s in self.faults if s.fault_id in self._open])

    @functools.cached_property
    def measured_bounds(self) -> tuple[tuple[Control, ...], dict[str, DataFrame], dict[str, str]]:
        """As ``_group_bounds``, with marks also where another control detects a stale partition already:
        one group that fell below a column's bound says nothing about the others."""
        wanted = [s for s in self.faults if s.fault_id in self._open or s.kind == STALE_PARTITION]
        if all(s.fault_id in self._open for s in wanted):
            return self._group_bounds
        return self._bounds_by_group(wanted)

    def _bounds_by_group(
        self, faults: Sequence[FaultSpec]
    ) -> tuple[tuple[Control, ...], dict[str, DataFrame], dict[str, str]]:
        orders = self.sources["raw_orders"]
        types = {f.name: f.dataType for f in orders.schema.fields}
        controls: dict[str, Control] = {}
        tables: dict[str, DataFrame] = {}
        made: dict[str, str] = {}
        for s in faults:
            if s.target_table != "raw_orders":
                continue
            if s.kind == STALE_PARTITION and isinstance(types.get(str(s.parameters["partition_column"])), T.DateType):
                group, day = (safe_identifier(str(s.parameters[p])) for p in ("group_column", "partition_column"))
                name = f"marks_{group}_{day}"
                if name not in tables:
                    profile = profile_groups(orders, group, day, self.false_alarm, self.withdrawn)
                    tables[name] = self._keep(marks(orders, group, day), name, "written")
                    controls[name] = marks_control(profile, "raw_orders", name, (STALE_PARTITION,))
            elif s.kind == NULL_DENSITY_SURGE:
                column = safe_identifier(str(s.parameters["column"]))
                name = f"nulls_{column}"
                if name not in tables:
                    tables[name] = self._keep(null_limits(orders, column, None, self.false_alarm), name, "written")
                    controls[name] = null_share_control(column, None, "raw_orders", name, (NULL_DENSITY_SURGE,))
            else:
                continue
            made[s.fault_id] = controls[name].control_id
        return tuple(controls.values()), tables, made

    @property
    def group_controls(self) -> tuple[Control, ...]:
        return self._group_bounds[0]

    def group_results(self, measured: bool = False) -> DataFrame:
        """Results of the controls by group; ``measured``: of all of ``measured_bounds``."""
        controls, tables, _ = self.measured_bounds if measured else self._group_bounds
        return self._each_block(lambda built, vs: evaluate_controls({**built, **tables}, vs, controls))

    def all_results(self) -> DataFrame:
        """Control results of baseline + generated controls."""
        out = self.baseline_results.withColumn("generated", F.lit(False))
        if self.generated_controls:
            out = out.unionByName(self.bound_results.withColumn("generated", F.lit(True)))
        if self.group_controls:
            out = out.unionByName(self.group_results().withColumn("generated", F.lit(True)))
        return out

    def matrices(self) -> DataFrame:
        res = self.all_results()
        faults = self.fault_table()
        base = detection_matrix(res.filter(~F.col("generated")), faults).withColumn(
            "phase", F.lit("baseline")
        )
        improved = detection_matrix(res, faults).withColumn("phase", F.lit("improved"))
        return base.unionByName(improved)

    def coverage_report(self) -> DataFrame:
        m = self.matrices()
        return coverage(m.filter(F.col("phase") == "baseline"), "baseline").unionByName(
            coverage(m.filter(F.col("phase") == "improved"), "improved")
        )

    def generated_recall(self) -> DataFrame:
        """Per generated control and fault: violations vs rows the fault mutated."""
        res = self.all_results().filter("generated")
        ev = self.mutation_evidence().select("fault_id", "mutated_rows")
        return res.join(ev, res.variant == ev.fault_id).select(
            "fault_id",
            "control_id",
            "violation_count",
            "mutated_rows",
            F.round(F.col("violation_count") / F.col("mutated_rows"), 4).alias("recall"),
        )

    # -- an enforcing run ----------------------------------------------------
    def run(self, strict: bool = True) -> CampaignReport:
        """The whole campaign, with every condition enforced, in order:

        the sources' keys are present and unique; every fault changed data; generated
        controls are silent on clean data; with ``strict`` no gap stays open; a snapshot of
        the sources restores to the same checksums. Raises CampaignFailed (or
        SnapshotMismatch) where one does not hold. Baseline controls that fail on clean
        data are reported, and detect nothing. What was kept is removed in any case.
        """
        names = list(self.sources)
        path = None
        try:
            load = evaluate_controls(self.sources, VariantSet(), LOAD_CONTROLS)
            self._require("load constraints violated", load.filter("NOT passed"), "control_id")
            path = snapshot(self.spark, self.sources, self.seed)
            evidence = self.mutation_evidence().collect()
            same = sorted(r["fault_id"] for r in evidence if not r["changed"])
            if same:
                raise CampaignFailed(f"faults that changed nothing: {same}")
            results = self.all_results().persist(StorageLevel.MEMORY_AND_DISK)
            self._kept.append(results)
            loud = results.filter(F.col("generated") & (F.col("variant") == CLEAN) & ~F.col("passed"))
            self._require("generated controls that fire on clean data", loud, "control_id")
            found = [r["fault_id"] for r in detection_matrix(results, self.fault_table()).filter("detected").collect()]
            open_ = sorted({s.fault_id for s in self.faults} - set(found))
            if strict and open_:
                raise CampaignFailed(f"gaps that stay open: {open_}")
            radius = self.radius_comparison().filter("status != 'matched'").collect()
            noisy = failing_on_clean(results.filter("NOT generated")).collect()
            report = CampaignReport(
                mutated_rows={r["fault_id"]: int(r["mutated_rows"]) for r in evidence},
                failing_on_clean=tuple(sorted(r["control_id"] for r in noisy)),
                baseline_detected=tuple(s.fault_id for s in self.faults if s.fault_id not in self.gaps),
                detected=tuple(s.fault_id for s in self.faults if s.fault_id in found),
                gaps=tuple(open_),
                generated=tuple(c.control_id for c in (*self.generated_controls, *self.group_controls)),
                refused=tuple(self.refused()),
                radius_mismatches=tuple((r["fault_id"], r["table_name"], r["status"]) for r in radius),
            )
            require_verified(self.spark, path, names)
            return report
        finally:
            if path:
                remove_snapshot(self.spark, path)
            self.close()

    @staticmethod
    def _require(what: str, bad: DataFrame, column: str) -> None:
        names = sorted(r[column] for r in bad.select(column).distinct().collect())
        if names:
            raise CampaignFailed(f"{what}: {names}")

    # -- evidence -----------------------------------------------------------
    def write_evidence(self, root: str) -> dict[str, str]:
        """Write the campaign's results as write-once JSON under
        ``<root>/m-<manifest digest>``: a replay with identical results succeeds,
        different results for the same manifest raise ``EvidenceConflict``."""
        from faultbench.operators.snapshots import write_evidence
        from faultbench.plans.manifest import manifest_sha256

        base = f"{root.rstrip('/')}/m-{manifest_sha256(self.faults, self.seed)[:16]}"
        parts = {
            "coverage": self.coverage_report(),
            "detection_matrix": self.matrices(),
            "table_checksums": self.checksums(),
            "mutation_evidence": self.mutation_evidence(),
            "blast_radius": self.radius_comparison(),
        }
        return {name: write_evidence(df, f"{base}/{name}", "json") for name, df in parts.items()}
