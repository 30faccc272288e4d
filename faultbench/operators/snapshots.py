"""Snapshots of table sets and verified restore.

A snapshot is a fresh folder under the shared checkpoint folder: one parquet
directory per table, then a manifest (table, rows, checksum, snapshot id) written
last; a folder without a manifest is not a snapshot. The manifest's checksums are
taken from the source tables; before it is written, the files must have the same ones.
Derived tables are built from the copies, and their checksums taken while they are written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from faultbench.operators.checksum import row_hash_sql, table_checksums
from faultbench.session import remove_folder, scratch_path

MANIFEST = "_manifest"


class SnapshotMismatch(RuntimeError):
    """A copy differs from what it should hold."""


def _sums(tables: Mapping[str, DataFrame]) -> dict[str, tuple[int, str]]:
    """Row count and checksum of each table (one row per table reaches the driver)."""
    rows = table_checksums(tables).collect()
    return {r["table_name"]: (int(r["row_count"]), r["checksum"]) for r in rows}


def snapshot(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    seed: int,
    path: str | None = None,
    derive: Mapping[str, Callable[[Mapping[str, DataFrame]], DataFrame]] | None = None,
) -> str:
    """Copy ``tables`` and publish their manifest; raises if a copy differs from its source.

    ``derive``: further tables in order, each a function of the copies before it; the sources are read
    twice, however many there are.
    """
    path = path or scratch_path(spark, "snapshot")
    wanted = _sums(tables)
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
    copies = restore(spark, path, list(tables), require_manifest=False)
    for name, build in (derive or {}).items():
        seen, df = Observation(f"copy-{name}"), build(copies)
        h = F.expr(f"sum(CAST({row_hash_sql(df, name)} AS DECIMAL(20,0)))")
        df.observe(seen, F.count(F.lit(1)).alias("n"), h.alias("h")).write.mode("errorifexists").parquet(f"{path}/{name}")
        wanted[name] = (int(seen.get["n"]), str(int(seen.get["h"] or 0)))
        copies[name] = spark.read.parquet(f"{path}/{name}")
    written = _sums(copies)
    differing = sorted(t for t in wanted if written.get(t) != wanted[t])
    if differing:
        raise SnapshotMismatch(f"the copies of {differing} differ from their sources")
    # The id digests seed + sorted checksums.
    rows = sorted((t, n, c) for t, (n, c) in wanted.items())
    text = f"{seed}|" + ",".join(f"{t}:{n}:{c}" for t, n, c in rows)
    snapshot_id = hashlib.sha256(text.encode()).hexdigest()
    manifest = spark.createDataFrame(
        [(t, n, c, seed, snapshot_id) for t, n, c in rows],
        "table_name string, row_count bigint, checksum string, seed bigint, snapshot_id string",
    )
    manifest.coalesce(1).write.mode("errorifexists").json(f"{path}/{MANIFEST}")
    return path


def remove_snapshot(spark: SparkSession, path: str) -> None:
    """Delete a snapshot, its manifest first."""
    remove_folder(spark, f"{path}/{MANIFEST}")
    remove_folder(spark, path)


def _readable(spark: SparkSession, fmt: str, path: str) -> bool:
    """Whether a finished dataset exists at ``path`` (any filesystem Spark can read)."""
    try:
        spark.read.format(fmt).load(path).schema
        return True
    except Exception as e:  # noqa: BLE001 - Spark raises AnalysisException for a missing path
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return False
        raise


def restore(
    spark: SparkSession, path: str, names: list[str], *, require_manifest: bool = True
) -> dict[str, DataFrame]:
    if require_manifest and not _readable(spark, "json", f"{path}/{MANIFEST}"):
        raise FileNotFoundError(f"{path} has no manifest: not a complete snapshot")
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(f"{path}/{MANIFEST}")


def verify_restore(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Recompute checksums of the restored tables and compare with the manifest."""
    sums = table_checksums(restore(spark, path, names)).drop("variant")
    man = read_manifest(spark, path).select(
        "table_name",
        F.col("row_count").cast("bigint").alias("manifest_row_count"),
        F.col("checksum").alias("manifest_checksum"),
    )
    j = sums.join(man, "table_name", "full_outer")
    return j.select(
        "table_name",
        "row_count",
        "checksum",
        "manifest_row_count",
        "manifest_checksum",
        (
            F.col("checksum").eqNullSafe(F.col("manifest_checksum"))
            & F.col("row_count").eqNullSafe(F.col("manifest_row_count"))
        ).alias("verified"),
    )


def require_verified(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    """The restored tables; raises if one differs from the manifest."""
    bad = sorted(str(r["table_name"]) for r in verify_restore(spark, path, names).filter("NOT verified").collect())
    if bad:
        raise SnapshotMismatch(f"restored tables {bad} differ from the manifest")
    return restore(spark, path, names)


class EvidenceConflict(RuntimeError):
    pass


def write_evidence(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Write-once evidence: a new path is written; an existing one must hold exactly
    the same rows (multiset, compared with ``exceptAll`` both ways) or it is an error.
    Returns ``"written"`` or ``"identical"``.

    The writer claims the path first, by a file beside it that the file system creates for one
    writer only. Of several writers at once one writes; the others find the claim and, until the
    evidence is complete, an error. A write that fails gives its claim back.
    """
    spark = df.sparkSession
    if _readable(spark, fmt, path):
        old = spark.read.format(fmt).schema(df.schema).load(path)
        if old.exceptAll(df).isEmpty() and df.exceptAll(old).isEmpty():
            return "identical"
        raise EvidenceConflict(f"{path} already holds different evidence")
    claim = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.claim")
    if not claim.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).createNewFile(claim):
        raise EvidenceConflict(f"{path} is claimed by a writer that has not finished")
    try:
        df.write.mode("errorifexists").format(fmt).save(path)
    except BaseException:
        remove_folder(spark, claim.toString())
        raise
    return "written"
