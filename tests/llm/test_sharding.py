import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from faultbench.llm import sharding
from faultbench.llm.sharding import jump_shards, shard_documents

from awkward import documents, text


def jump(key, n):
    key &= 2**64 - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * sharding.MULTIPLIER + 1) & (2**64 - 1)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_equals_the_published_loop(spark):
    random.seed(1)
    keys = [random.getrandbits(64) - 2**63 for _ in range(500)] + [0, 1, -1, 2**63 - 1, -(2**63)]
    for n in (1, 2, 40, 500):
        for r in spark.createDataFrame([(k,) for k in keys], "k long").select("k", jump_shards("k", n)).collect():
            assert (r.jump.shard, r.jump.grown) == (jump(r.k, n), jump(r.k, n + 1))


def test_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_WINDOW", 3)  # several windows a shard
    rows = shard_documents(documents(spark), shards=3).collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=str) == sorted(
        ((d, len(t.encode()) + 16, zlib.crc32(t.encode())) for d, t in text()), key=str
    )
    assert {r.law for r in rows} == {"key"}
    for shard in range(3):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r.shard, 3) for r in rows)
    assert len({r.shard for r in rows if r.doc_id == 5}) == 1
    assert shard_documents(documents(spark, [])).collect() == []


def test_one_more_shard_takes_its_share_only(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    rows = {r.doc_id: r for r in shard_documents(docs, 9).collect()}
    more = {r.doc_id: r.shard for r in shard_documents(docs, 10).collect()}
    assert all(more[d] == r.grown_shard for d, r in rows.items())
    assert 0.08 < sum(more[d] != r.shard for d, r in rows.items()) / len(rows) < 0.12
    sizes = Counter(r.shard for r in rows.values())
    assert max(sizes.values()) < 1.1 * min(sizes.values())
