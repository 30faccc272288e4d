"""Synthetic sources, write-once evidence, manifest digest and validation, artifacts."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from faultbench.operators import catalog as C
from faultbench.operators.checksum import table_checksums
from faultbench.operators.snapshots import EvidenceConflict, write_evidence
from faultbench.plans.contract import default_faults
from faultbench.plans.manifest import manifest_frame, manifest_sha256, manifest_validation
from faultbench.sources.synthetic import synthetic_commerce


def test_synthetic_is_reproducible(spark):
    a = synthetic_commerce(spark, 30, 120, 1)
    b = synthetic_commerce(spark, 30, 120, 1)
    c = synthetic_commerce(spark, 30, 120, 2)
    ck = lambda t: table_checksums({"o": t["raw_orders"].repartition(3)}).first()["checksum"]
    assert ck(a) == ck(b) != ck(c)
    o = a["raw_orders"].agg(F.min("amount_cents"), F.max("amount_cents"), F.countDistinct("source_partition")).first()
    assert o[0] >= 1500 and o[1] <= 125000 and o[2] <= 14


def test_write_once_evidence(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="fb-ev-"), "e")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert write_evidence(df, path) == "written"
    assert write_evidence(df.orderBy(F.desc("k")), path) == "identical"
    with pytest.raises(EvidenceConflict):
        write_evidence(df.limit(1), path)


def test_one_of_two_concurrent_writers_fails(spark):
    from threading import Barrier, Thread

    path, start, out = os.path.join(tempfile.mkdtemp(prefix="fb-ev-"), "e"), Barrier(2), []
    rows = [spark.range(n).toDF("k") for n in (10, 20)]

    def write(df):
        start.wait()
        try:
            out.append(write_evidence(df, path))
        except EvidenceConflict:
            out.append("conflict")

    threads = [Thread(target=write, args=(df,)) for df in rows]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(out) == ["conflict", "written"]
    assert spark.read.parquet(path).count() in (10, 20)
    failing = spark.range(3).selectExpr("raise_error('x') AS k")
    other = path + "2"
    with pytest.raises(Exception, match="x"):
        write_evidence(failing, other)
    assert write_evidence(rows[0], path + "3") == "written" and not os.path.exists(other + ".claim")


def test_manifest_digest_and_validation(spark):
    specs = default_faults()
    assert manifest_sha256(specs, 1) == manifest_sha256(specs, 1) != manifest_sha256(specs, 2)
    faults = manifest_frame(spark, list(specs) + [specs[0]])
    tables = spark.createDataFrame([("raw_customers",)], "table_name string")
    rows = manifest_validation(faults, tables).collect()
    assert all("unknown_target" in r["violations"] for r in rows)
    assert any("duplicate_fault_id" in r["violations"] for r in rows)


def test_tag_removal_fault_is_caught_by_governance(spark):
    from tests.test_catalog import POLICY, SRC, entity
    import json

    ents = spark.createDataFrame([(json.dumps(entity(SRC, "fb.raw_orders")),)], "payload string")
    faulted = C.remove_tag(ents, "urn:li:tag:sandbox", F.lit(True))
    exp = spark.createDataFrame([(SRC, "fb.raw_orders", False)], "urn string, name string, removed boolean")
    assert C.catalog_governance(ents, exp, POLICY).first()["compliant"]
    assert "tags" in C.catalog_governance(faulted, exp, POLICY).first()["failed_checks"]
