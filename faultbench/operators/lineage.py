"""Lineage operators over edge tables of any size.

``closure`` is a breadth-first frontier loop. Edges and reached nodes stay where they are,
partitioned by node; a hop joins its frontier with the edges in place, shuffles the targets it
found, and drops those that are known by joins in place too. Reached nodes are kept in parts that
are checkpointed (in the shared checkpoint folder) and merged when a newer part has grown as large
as the one before, so a node is moved about once for each doubling, not once a hop. A node with very
many edges is spread over several partitions. Cycles terminate: a hop without a new node is the last.

``reach_sizes`` estimates for every node how many nodes it reaches, without any node's closure.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultbench.session import checkpoint_dir, release, remove_folder, scratch_path
from faultbench.sources.tables import read_table

#: Edges of one node that are kept together.
TOGETHER = 100_000
#: Parts of the sketches, one for each hop, before they are made one.
MOST_PARTS = 8


def placed(df: DataFrame, n: int, *columns: str) -> DataFrame:
    """``df`` checkpointed in ``n`` partitions by ``columns``, which later joins on them need not shuffle again.

    An adaptive plan does not tell a checkpoint how its rows are partitioned, so this one shuffle is planned
    without.
    """
    conf, name = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return df.repartition(n, *columns).checkpoint(eager=True)
    finally:
        conf.set(name, before)


def closure(
    edges: DataFrame, seeds: DataFrame, *, max_hops: int | None = None, together: int = TOGETHER
) -> DataFrame:
    """Nodes reachable from ``seeds`` (including them) with their hop distance.

    ``edges``: ``(src, dst)``; ``seeds``: ``(node)``. Returns ``(node, hops)``.
    """
    spark = edges.sparkSession
    checkpoint_dir(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL")
    # Nodes with very many edges, and over how many places these are spread: edges / together of them at most.
    hot = held.groupBy("src").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > together)
    hot = hot.select(F.col("src").alias("_hot"), F.ceil(F.col("_n") / together).cast("int").alias("_places")).checkpoint(eager=True)
    spread = held.join(hot, F.col("src") == F.col("_hot"), "left").select(
        "src", F.when(F.col("_places").isNull(), 0).otherwise(F.pmod(F.xxhash64("dst"), F.col("_places"))).cast("int").alias("_place"), "dst"
    )
    e = placed(spread, n, "src", "_place")

    def kept(nodes: DataFrame) -> tuple[DataFrame, int]:
        out = placed(nodes.checkpoint(eager=True), n, "node")
        return out, out.count()

    frontier, size = kept(seeds.select("node").filter(F.col("node").isNotNull()).distinct().withColumn("hops", F.lit(0)))
    parts, hop = [(frontier, size)], 0
    while size and (max_hops is None or hop < max_hops):
        hop += 1
        places = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_places"), F.lit(1)) - 1))
        here = frontier.join(hot, F.col("node") == F.col("_hot"), "left").select("node", places.alias("_at"))
        found = here.join(e, (F.col("node") == F.col("src")) & (F.col("_at") == F.col("_place"))).select(F.col("dst").alias("node"))
        new = found.distinct()
        for part, _ in parts:
            new = new.join(part.select("node"), "node", "left_anti")
        frontier, size = kept(new.withColumn("hops", F.lit(hop)))
        parts.append((frontier, size))
        while len(parts) > 1 and parts[-1][1] >= parts[-2][1]:
            (a, x), (b, y) = parts.pop(), parts.pop()
            parts.append((kept(a.unionByName(b))[0], x + y))
    out = parts[0][0]
    for part, _ in parts[1:]:
        out = out.unionByName(part)
    return out


def _joined_lists(k: int):
    """Of each Arrow batch of (node, values): one list of the k smallest distinct values for each node.

    So a hot node, and a value that many edges bring, are cut before their shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded, lists = batch.column("node").dictionary_encode(), batch.column("values")
            lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            node = np.repeat(coded.indices.to_numpy(zero_copy_only=False), lengths)
            value = lists.flatten().to_numpy(zero_copy_only=False)
            order = np.lexsort((value, node))
            node, value = node[order], value[order]
            new = np.ones(len(node), bool)
            new[1:] = (node[1:] != node[:-1]) | (value[1:] != value[:-1])
            node, value = node[new], value[new]
            first = np.searchsorted(node, node)
            least = np.arange(len(node)) - first < k
            node, value = node[least], value[least]
            starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.zeros(0, np.int64)
            out = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(node)], pa.int32()), pa.array(value, pa.int64()))
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(node[starts])), out], names=["node", "values"])

    return run


def _least_values(rows: DataFrame, k: int) -> DataFrame:
    """(node, values): each node's k smallest distinct values, sorted, of rows (node, values) of any number a node."""
    kind = rows.schema["node"].dataType.simpleString()
    each = rows.mapInArrow(_joined_lists(k), f"node {kind}, values array<bigint>").repartition("node")
    each = each.select("node", F.explode("values").alias("value"))
    rank = F.dense_rank().over(Window.partitionBy("node").orderBy("value"))
    least = each.withColumn("_i", rank).filter(F.col("_i") <= k)
    return least.groupBy("node").agg(F.sort_array(F.collect_set("value")).alias("values"))


def _least_of(values: Column, k: int) -> Column:
    return F.slice(F.array_sort(F.array_distinct(values)), 1, k)


def reach_sizes(edges: DataFrame, *, k: int = 256, max_hops: int | None = None) -> DataFrame:
    """``(node, size, exact)``: about how many nodes each node reaches, itself included.

    Every node has a hash; a node's sketch is the k smallest hashes among the nodes that it reaches. Sketches
    pass against the edges' direction, merged and cut to k, until none changes: a hop carries on only
    the hashes that are new to a sketch. A sketch of fewer than k hashes is the closure itself, so its size is
    exact; otherwise the k-th smallest hash tells how dense the hashes lie, with a relative standard error of
    1 / sqrt(k - 2). Memory and shuffle are at most k hashes a node, whatever the closures' sizes; cycles are
    no special case.

    A node without edges of its own reaches itself only, so its hash passes once, with the edges, and later hops
    need only the edges between nodes that have some. Sketches are lists in Parquet parts in the shared
    checkpoint folder: a hop writes those that changed. ``edges`` is read twice. The result is a table in that
    folder, which stays until the folder goes.
    """
    spark = edges.sparkSession
    paths: list[str] = []

    def written(df: DataFrame, name: str = "reach") -> DataFrame:
        path = scratch_path(spark, name)
        if name == "reach":
            paths.append(path)
        df.write.parquet(path)
        release(spark)
        return spark.read.schema(df.schema).parquet(path)

    def hashed(column: str) -> Column:
        return F.xxhash64(F.col(column).cast("string"))

    def removed(*gone: str) -> None:
        for path in gone:
            remove_folder(spark, path)
            paths.remove(path)

    try:
        e = edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL")
        own = [hashed("src")] if max_hops == 0 else [hashed("src"), hashed("dst")]
        least = _least_values(e.select(F.col("src").alias("node"), F.array(*own).alias("values")), k)
        itself = F.array(hashed("node"))
        # kept: what a part before knew of a node, or the node itself; added: what this hop brought.
        kept, added = F.array_intersect("values", itself).alias("kept"), F.array_except("values", itself).alias("added")
        parts, at = [written(least.select("node", kept, added))], [paths[-1]]
        sources = parts[0].select("node")
        own_edges = F.when(F.col("node").isNotNull(), F.col("src")).alias("src")
        targets = written(e.join(sources, F.col("dst") == F.col("node"), "left").select("dst", own_edges))
        inner, hop = targets.filter("src IS NOT NULL"), 1
        while max_hops is None or hop < max_hops:
            hop += 1
            frontier = parts[-1].filter("size(added) > 0").select(F.col("node").alias("_from"), F.col("added").alias("values"))
            passed = frontier.join(inner, F.col("_from") == F.col("dst")).select(F.col("src").alias("node"), "values")
            # Written, so that Spark knows whether it is small enough to be sent to where the sketches are.
            got, got_at = written(_least_values(passed, k)), paths[-1]
            had = reduce(DataFrame.unionByName, parts).select("node", F.concat("kept", "added").alias("had"))
            met = got.join(had, "node").groupBy("node").agg(F.first("values").alias("got"), F.flatten(F.collect_list("had")).alias("had"))
            met = met.withColumn("values", _least_of(F.concat("had", "got"), k))
            kept, added = F.array_intersect("values", "had").alias("kept"), F.array_except("values", "had").alias("added")
            part, part_at = written(met.select("node", kept, added).filter("size(added) > 0")), paths[-1]
            removed(got_at)
            if part.isEmpty():
                break
            if len(parts) == MOST_PARTS:
                known = F.flatten(F.collect_list(F.concat("kept", "added")))
                one = reduce(DataFrame.unionByName, parts).groupBy("node").agg(_least_of(known, k).alias("kept"))
                parts = [written(one.withColumn("added", F.array().cast("array<bigint>")))]
                removed(*at)
                at = [paths[-1]]
            parts.append(part)
            at.append(part_at)
        # The newest part that holds a node has its sketch.
        newest = [
            p.select("node", F.struct(F.lit(i).alias("i"), (F.size("kept") + F.size("added")).alias("_n"), F.array_max(F.concat("kept", "added")).alias("_last")).alias("s"))
            for i, p in enumerate(parts)
        ]
        sketch = reduce(DataFrame.unionByName, newest).groupBy("node").agg(F.max("s").alias("s")).select("node", "s._n", "s._last")
        ends = targets.filter("src IS NULL").select(F.col("dst").alias("node")).distinct()
        counted = sketch.unionByName(ends.select("node", F.lit(1).alias("_n"), hashed("node").alias("_last")))
        # Hashes as fractions of their range, from the smallest value on.
        last = (F.col("_last").cast("double") + F.lit(float(1 << 63))) / F.lit(float(1 << 64))
        exact = F.col("_n") < k
        size = F.when(exact, F.col("_n").cast("double")).otherwise((k - 1) / last)
        return written(counted.select("node", size.alias("size"), exact.alias("exact")), "reach-sizes")
    finally:
        removed(*list(paths))


def path_counts(edges: DataFrame, hops: int) -> DataFrame:
    """``(node, paths)``: how many paths of 1 to ``hops`` different edges' steps leave each node that has edges.

    Counts move against the edges' direction, so no path is a row; only edges to nodes with edges of their own are joined.
    """
    spark = edges.sparkSession
    pairs = edges.select("src", "dst").filter("src IS NOT NULL")

    def written(df: DataFrame) -> DataFrame:
        path = scratch_path(spark, "paths")
        df.write.parquet(path)
        release(spark)
        return spark.read.schema(df.schema).parquet(path)

    steps = written(pairs.distinct().groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("steps")))
    out = steps.select("node", F.col("steps").alias("paths"))
    if hops < 2:
        return out
    inner = written(pairs.join(steps.select("node"), F.col("dst") == F.col("node"), "left_semi").distinct())
    for _ in range(hops - 1):
        on = inner.join(out, F.col("dst") == F.col("node")).groupBy("src").agg(F.sum("paths").alias("on"))
        out = steps.join(on, F.col("node") == F.col("src"), "left").select("node", (F.col("steps") + F.coalesce("on", F.lit(0))).alias("paths"))
    return out


def neighbors(edges: DataFrame) -> DataFrame:
    """Direct neighbours as rows ``(node, neighbor, direction)``; direction is ``downstream``
    or ``upstream`` of the node. Rows, not lists: a node may have any number of them."""
    e = edges.select("src", "dst").dropna().distinct()
    both = (
        "stack(2, src, dst, 'downstream', dst, src, 'upstream') AS (node, neighbor, direction)"
    )
    return e.selectExpr(both)


def neighbor_counts(edges: DataFrame) -> DataFrame:
    """Direct upstream / downstream counts per node."""
    down = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("downstreams"))
    up = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("upstreams"))
    j = down.join(up, "node", "full_outer")
    return j.select(
        "node",
        F.coalesce("upstreams", F.lit(0)).alias("upstreams"),
        F.coalesce("downstreams", F.lit(0)).alias("downstreams"),
    )


def record_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record-level lineage: nation -> customer -> order -> line item."""
    c = read_table(spark, sf_dir, "customer")
    o = read_table(spark, sf_dir, "orders")
    li = read_table(spark, sf_dir, "lineitem")
    return (
        c.select(
            F.concat(F.lit("n:"), F.col("c_nationkey").cast("string")).alias("src"),
            F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("dst"),
        )
        .unionByName(
            o.select(
                F.concat(F.lit("c:"), F.col("o_custkey").cast("string")).alias("src"),
                F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("dst"),
            )
        )
        .unionByName(
            li.select(
                F.concat(F.lit("o:"), F.col("l_orderkey").cast("string")).alias("src"),
                F.concat(
                    F.lit("l:"), F.col("l_orderkey").cast("string"), F.lit(":"),
                    F.col("l_linenumber").cast("string"),
                ).alias("dst"),
            )
        )
    )


RECORD_EDGES_SQL = (
    "edges AS (SELECT 'n:' || CAST(c_nationkey AS VARCHAR) AS src, 'c:' || CAST(c_custkey AS "
    "VARCHAR) AS dst FROM customer UNION ALL SELECT 'c:' || CAST(o_custkey AS VARCHAR), 'o:' || "
    "CAST(o_orderkey AS VARCHAR) FROM orders UNION ALL SELECT 'o:' || CAST(l_orderkey AS VARCHAR), "
    "'l:' || CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR) FROM lineitem)"
)
