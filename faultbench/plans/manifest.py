"""Campaign manifest: digest (creation time excluded) and bulk validation.

The manifest itself is a handful of fault specs (configuration); its digest is
computed on the driver. Validation against the catalog of known tables is a left anti
join, so it also works for campaigns over many tables.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultbench.operators.faults import FaultSpec


def manifest_payload(specs: Sequence[FaultSpec], seed: int) -> dict:
    return {
        "seed": seed,
        "faults": [
            {
                "fault_id": s.fault_id,
                "kind": s.kind,
                "target_table": s.target_table,
                "parameters": {k: s.parameters[k] for k in sorted(s.parameters)},
                "expected_tables": sorted(s.expected_tables) if s.expected_tables else None,
                "expected_controls": sorted(s.expected_controls),
            }
            for s in specs
        ],
    }


def manifest_sha256(specs: Sequence[FaultSpec], seed: int) -> str:
    text = json.dumps(manifest_payload(specs, seed), sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()


def manifest_frame(spark: SparkSession, specs: Sequence[FaultSpec]) -> DataFrame:
    return spark.createDataFrame(
        [(s.fault_id, s.kind, s.target_table) for s in specs],
        "fault_id string, kind string, target_table string",
    )


def manifest_validation(faults: DataFrame, known_tables: DataFrame) -> DataFrame:
    """Per fault: unique id and known target (left anti join against the catalog)."""
    dup = faults.groupBy("fault_id").agg(F.count(F.lit(1)).alias("n"))
    unknown = faults.select("target_table").distinct().join(
        known_tables.select(F.col("table_name").alias("target_table")), "target_table", "left_anti"
    ).withColumn("_unknown", F.lit(True))
    j = faults.join(dup, "fault_id").join(unknown, "target_table", "left")
    return j.select(
        "fault_id",
        "target_table",
        F.array_compact(F.array(
            F.when(F.col("n") > 1, F.lit("duplicate_fault_id")),
            F.when(F.col("_unknown").isNotNull(), F.lit("unknown_target")),
        )).alias("violations"),
    )
