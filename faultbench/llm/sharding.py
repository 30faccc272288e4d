"""Jump consistent hashing of stable keys to shards, in DataFrame functions only.

Lamping and Veach's jump hash walks a chain of bucket numbers 0 = b0 < b1 < ... that depends
on the key alone; with n shards the key lives in the last bucket of the chain below n. So one
walk answers for every shard count, and a shard appended at the end takes exactly the keys
whose chain names it: about 1/(n+1) of them, and from every old shard alike. No ring table
exists anywhere.

The generator is the published 64-bit linear congruential step. Spark's bigint product raises
on overflow, so the state is kept as two unsigned 32-bit halves and multiplied by limbs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultbench.llm.common import checkpointed

#: Fixed value: the multiplier of the published jump hash generator.
MULTIPLIER = 2862933555777941757
#: Rows that one window of the slot numbering sorts, on average.
ROWS_PER_WINDOW = 100_000


def jump_shards(key: str, shards: int, name: str = "jump") -> Column:
    """Struct ``(shard, grown)`` of a bigint key: its shard of ``shards``, and of one more.

    Null keys count as the key 0.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    c1, c0 = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
    low = "4294967295"
    # x = hi * 2^32 + lo; x * C + 1 mod 2^64. lo is cut in 16-bit limbs, so no product reaches 2^63.
    p0 = f"((a.lo & 65535) * {c0}L)"
    p1 = f"(shiftright(a.lo, 16) * {c0}L)"
    t = f"({p0} + shiftleft({p1} & 65535, 16) + 1L)"
    cross = f"(((a.hi & 65535) * {c0}L + shiftleft((shiftright(a.hi, 16) * {c0}L) & 65535, 16)) & {low}L)"
    hi = f"((shiftright({t}, 32) + shiftright({p1}, 16) + ((a.lo * {c1}L) & {low}L) + {cross}) & {low}L)"
    step = f"named_struct('hi', {hi}, 'lo', {t} & {low}L, 'shard', a.nxt, 'grown', a.grown, 'nxt', a.nxt)"
    jump = "cast(floor((b.shard + 1) * (2147483648D / (shiftright(b.hi, 1) + 1))) as bigint)"
    key = f"coalesce({key}, 0L)"
    # Every step moves at least one bucket ahead, so shards + 1 steps pass the last one.
    walked = f"""aggregate(
        sequence(1, {shards + 1}),
        named_struct('hi', shiftright({key}, 32) & {low}L, 'lo', {key} & {low}L,
                     'shard', 0L, 'grown', 0L, 'nxt', 0L),
        (a, i) -> CASE WHEN a.nxt > {shards}L THEN a ELSE
            transform(array({step}), b -> named_struct(
                'hi', b.hi, 'lo', b.lo,
                'shard', CASE WHEN b.shard < {shards}L THEN b.shard ELSE a.shard END,
                'grown', b.shard, 'nxt', {jump}))[0] END,
        a -> named_struct('shard', cast(a.shard as int), 'grown', cast(a.grown as int)))"""
    return F.expr(walked).alias(name)


def with_slots(df: DataFrame, shard: str, order: list[str], rows: int) -> DataFrame:
    """Add ``slot``: 0, 1, 2, ... without a gap inside each shard.

    A shard is never numbered in one window: its rows are dealt to hash buckets of about
    ROWS_PER_WINDOW rows, numbered there, and shifted by the running total of the buckets
    before. ``rows`` only sizes the buckets. Rows equal in all of ``order`` are alike, so
    which of them comes first doesn't show.
    """
    buckets = max(1, -(-rows // ROWS_PER_WINDOW))
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy(F.col(shard).alias("_s"), F.col("_bucket").alias("_b"))
        .agg(F.count("*").alias("_n"))
        .select("_s", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("long").alias("_start"))
    )
    inside = Window.partitionBy(shard, "_bucket").orderBy(*order)
    numbered = dealt.withColumn("_row", F.row_number().over(inside))
    return (
        numbered.join(starts, (F.col(shard) == F.col("_s")) & (F.col("_bucket") == F.col("_b")))
        .withColumn("slot", F.col("_start") + F.col("_row") - 1)
        .drop("_bucket", "_row", "_s", "_b", "_start")
    )


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Place every row in a shard by its doc_id.

    Returns doc_id, size (UTF-8 bytes + 16), text_crc32, law (``key``), shard, slot,
    grown_shard. A null text counts as empty; null doc_ids share the shard of one fixed key;
    repeated rows each get a slot. Only these narrow columns are shuffled, never the texts.
    Extra columns are ignored.
    """
    data = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(data) + 16).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.xxhash64(F.col("doc_id").cast("long")).alias("_key"),
    )
    placed = rows.select("doc_id", "size", "text_crc32", jump_shards("_key", shards)).select(
        "doc_id", "size", "text_crc32",
        F.col("jump.shard").alias("shard"),
        F.col("jump.grown").alias("grown_shard"),
    )
    # Written once, so that the texts are read once and the chain is walked once a row.
    placed = checkpointed(placed)
    return with_slots(placed, "shard", ["doc_id", "text_crc32", "size"], placed.count()).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
