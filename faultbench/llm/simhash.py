"""SimHash near-duplicates, with candidates from pigeonring filtering.

The 64 bits of a fingerprint are cut into m = max_distance + 1 segments on a ring. If two
fingerprints differ in at most t bits, then from some segment on, every chain of l consecutive
segments differs in at most l * t / m bits (a strong form of the pigeonhole principle). With
m = t + 1 the first segment is equal, two differ in one bit at most, three in two, and so on.

The chain of two is the join key: the first segment, and the second with one bit blanked, once
for each bit. The longer chains are checked on the joined pair before the full distance. Equal
fingerprints are one node, so copies never meet each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultbench.llm.common import checkpointed, sliced, strings, unused
from faultbench.llm.components import connected_components

BITS = 64
#: Words that are hashed at a time within one text.
BLOCK = 200_000


def fingerprint(text: str, shingle: int = 4, seed: int = 42) -> int:
    """The unsigned fingerprint: a bit is 1 if it is set in over half the shingle hashes."""
    words = text.encode().lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    for start in range(0, n, BLOCK):
        own = words[start : min(start + BLOCK, n) + shingle - 1]
        joined = b" ".join(own)
        stops = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
        begins = [0, *(stops[:-1] + 1).tolist()]
        hashes = [xxhash.xxh64_digest(joined[a:b], seed) for a, b in zip(begins, stops[min(shingle, len(own)) - 1 :].tolist())]
        ones += np.unpackbits(np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """Rows (doc_id, row, fp): a key of id and text, and the fingerprint as a signed bigint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            fps = np.array([fingerprint(t, shingle, seed) for t in strings(batch)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("row"), pa.array(fps.view(np.int64), pa.int64())],
                names=["doc_id", "row", "fp"],
            )

    return docs.select("doc_id", _row().alias("row"), "text").mapInArrow(run, "doc_id long, row binary, fp long")


def _row() -> Column:
    """128 bits that tell rows of different ids or texts apart (a null one is no empty one)."""
    each = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in ("doc_id", "text")]
    return F.unhex(F.md5(F.concat_ws("|", *each)))


def _segments(max_distance: int) -> list[tuple[int, int]]:
    """Start and width of each of the max_distance + 1 segments."""
    m = max_distance + 1
    widths = [BITS // m + (i < BITS % m) for i in range(m)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def _signed(x: int) -> int:
    x &= 2**64 - 1
    return x - 2**64 if x >= 2**63 else x


def links(nodes: DataFrame, max_distance: int, halves: bool = False) -> DataFrame:
    """Pairs (a, b), a < b, of different ``fp`` of ``nodes`` at most ``max_distance`` bits apart.

    With ``halves`` a key holds one half of the second segment (one bit differs at most, so the other half is
    equal) instead of all but one bit: 2 keys a segment and not one for each bit, so far fewer rows are
    shuffled and more pairs looked at. The pairs found are the same.
    """
    segments = _segments(max_distance)
    m = len(segments)
    if m < 2:
        return nodes.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("a < b")
    if halves:
        return _links_by_halves(nodes, max_distance)
    mask = [((1 << w) - 1) << s for s, w in segments]
    keys = []  # (number of the key, bits of the first and second segment that count, the blanked bit)
    chains = []  # for each key, the bits of the chains of 3, 4, ... segments
    for i in range(m):
        j = (i + 1) % m
        for p in range(segments[j][1]):
            blank = 1 << (segments[j][0] + p)
            keys.append((len(keys), _signed(mask[i] | mask[j] & ~blank), _signed(blank), _signed(mask[j]), p == 0))
            chains.append([_signed(sum(mask[(i + k) % m] for k in range(n))) for n in range(3, m)])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(x).alias("x")) for k, x, *_ in keys]))
    rows = nodes.select("fp", each.alias("e")).select(F.col("e.k").alias("k"), F.col("fp").bitwiseAND(F.col("e.x")).alias("part"), "fp")
    a = rows.select("k", "part", F.col("fp").alias("a"))
    b = rows.select("k", "part", F.col("fp").alias("b"))

    def of(values: list) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), F.col("k") + 1)

    x = F.expr("a ^ b")
    second = x.bitwiseAND(of([s for *_, s, _ in keys]))
    # One of the keys that agree: where the second segments are equal, the first of them.
    once = (second == of([d for _, _, d, *_ in keys])) | ((second == 0) & of([z for *_, z in keys]))
    near = F.bit_count(x) <= max_distance
    for n in range(3, m):
        near = (F.bit_count(x.bitwiseAND(of([c[n - 3] for c in chains]))) <= n * max_distance // m) & near
    return a.join(b, ["k", "part"]).where((F.col("a") < F.col("b")) & once & near).select("a", "b").distinct()


def _links_by_halves(nodes: DataFrame, max_distance: int) -> DataFrame:
    segments = _segments(max_distance)
    m = len(segments)
    mask = [((1 << w) - 1) << s for s, w in segments]
    keys = []  # the bits that count: the first segment and a half of the second
    chains = []  # for each key, the bits of the chains of 2, 3, ... segments
    firsts = []  # for each key of a second half, the bits of the first half; else none
    for i in range(m):
        start, width = segments[(i + 1) % m]
        low = ((1 << width // 2) - 1) << start
        for half, first in ((low, 0), (mask[(i + 1) % m] & ~low, low)):
            keys.append(_signed(mask[i] | half))
            firsts.append(_signed(first))
            chains.append([_signed(sum(mask[(i + k) % m] for k in range(n))) for n in range(2, m)])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(x).alias("x")) for k, x in enumerate(keys)]))
    rows = nodes.select("fp", each.alias("e")).select(F.col("e.k").alias("k"), F.col("fp").bitwiseAND(F.col("e.x")).alias("part"), "fp")
    a = rows.select("k", "part", F.col("fp").alias("a"))
    b = rows.select("k", "part", F.col("fp").alias("b"))

    def of(values: list) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), F.col("k") + 1)

    x = F.expr("a ^ b")
    # Where both halves are equal, the key of the first.
    first = of(firsts)
    near = ((first == 0) | (x.bitwiseAND(first) != 0)) & (F.bit_count(x) <= max_distance)
    for n in range(2, m):
        near = (F.bit_count(x.bitwiseAND(of([c[n - 2] for c in chains]))) <= n * max_distance // m) & near
    return a.join(b, ["k", "part"]).where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def roots(nodes: DataFrame, max_distance: int, halves: bool = False) -> DataFrame:
    """Rows (node, root) for every ``fp`` of ``nodes`` that isn't its component's smallest."""
    return connected_components(links(nodes, max_distance, halves))


def _grouped(docs: DataFrame, shingle: int, max_distance: int, seed: int) -> DataFrame:
    """Rows (doc_id, row, fp, root, component_id); root is the component's smallest fingerprint."""
    fps = checkpointed(fingerprints(docs, shingle, seed))
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    linked = roots(nodes.select("fp"), max_distance)
    members = linked.union(linked.select(F.col("root").alias("node"), "root").distinct())
    # Tables that the next join reads are written first: both its sides then are plain
    # shuffles, whose hot keys (a large component, a text with many copies) Spark can split.
    least = checkpointed(
        members.join(nodes, F.col("node") == F.col("fp")).groupBy("root").agg(F.min("least").alias("component_id"))
    )
    named = members.join(least, "root").select("node", "root", "component_id")
    labels = checkpointed(
        nodes.join(named, nodes["fp"] == named["node"], "left").select(
            F.col("fp").alias("_fp"),
            F.coalesce("root", "fp").alias("root"),
            F.when(F.col("node").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"),
        )
    )
    return fps.join(labels, fps["fp"] == labels["_fp"]).drop("_fp")


def near_duplicates(docs: DataFrame, shingle: int = 4, max_distance: int = 4, seed: int = 42) -> DataFrame:
    """Per row of ``docs``: doc_id, fp (signed bigint), component_id.

    component_id is the smallest doc_id that linked fingerprints lead to, the row's own
    included; it is null only where all doc_ids of a component are. Null and empty texts have
    fingerprint zero and are linked like any other; repeated rows share a component; an empty
    table gives an empty result; extra columns are ignored.
    """
    return _grouped(docs, shingle, max_distance, seed).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, shingle: int = 4, max_distance: int = 4, seed: int = 42) -> DataFrame:
    """One row of ``docs``, all columns, of each component: the one with the smallest doc_id."""
    grouped = _grouped(docs, shingle, max_distance, seed)
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))).alias("first")
    row, chosen = unused(docs, "_row", "_chosen")
    kept = grouped.groupBy("root").agg(first).select(F.col("first.row").alias(chosen))
    # Repeated rows have one key; the join has brought them together already.
    rows = docs.withColumn(row, _row()).join(kept, F.col(row) == F.col(chosen))
    return rows.dropDuplicates([row]).select(*docs.columns)
