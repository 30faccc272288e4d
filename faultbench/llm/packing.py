"""Best-fit packing of documents into sequences, with certified bin counts.

Documents are dealt to partitions of bounded size, and each partition is packed by best-fit
decreasing. Dual feasible functions give a lower bound on the bins that any packing of the
partition needs; where best fit meets it, the partition is certified. Partitions with a gap
exchange their documents: they are dealt anew among each other and packed again, for as long as
that saves bins; at last the bins with free space of all partitions are packed anew together.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultbench.llm.common import checkpointed, sliced
from faultbench.llm.token_counts import encoder

#: Pieces that one partition packs, on average.
ITEMS = 50_000
#: Remembered pieces, and rows and text bytes that are encoded at a time. Less than the encoder's own
#: limits: as a pipeline's last stage, packing shares an executor with all that earlier stages left there.
MEMORY, BATCH_ROWS, BATCH_BYTES = 200_000, 8192, 8 << 20
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(docs: DataFrame, path: str, capacity: int = 2048, end: int = 0) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32): each document's ids, closed by ``end``, cut.

    Only documents over ``capacity`` are cut; their first piece takes what is left over, the
    others are full.
    """
    last = end.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, MEMORY)
        for batch in sliced(batches, rows=BATCH_ROWS, size=BATCH_BYTES):
            ids, counts = enc.encode_flat(batch.column("text"))
            data, at, rows = memoryview(ids.astype("<u4").tobytes()), 0, []
            for doc, n in zip(batch.column("doc_id").cast(pa.int64()).to_pylist(), (counts + 1).tolist()):
                own = data[at : at + 4 * n - 4]
                at += 4 * n - 4
                cuts = [0, *range(n % capacity or capacity, n, capacity)] if n > capacity else [0]
                for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    rows.append((doc, i, a, b - a, zlib.crc32(own[4 * a : 4 * b])))
                rows.append((doc, len(cuts) - 1, cuts[-1], n - cuts[-1], zlib.crc32(last, zlib.crc32(own[4 * cuts[-1] :]))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), *[pa.int64()] * 3))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, PIECE)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length: longest first, each into the fullest bin that takes it.

    Bins are kept by their free space; a bit mask over the free spaces finds the tightest.
    """
    order = np.argsort(-lengths, kind="stable").tolist()
    sizes = lengths.tolist()
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = used = 0
    for i in order:
        size = sizes[i]
        fits = mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            at = by_free[free].pop()
            if not by_free[free]:
                mask ^= 1 << free
        else:
            at, free, used = used, capacity, used + 1
        bins[i], offsets[i] = at, capacity - free
        if left := free - size:
            by_free[left].append(at)
            mask |= 1 << left
    return np.array(bins, np.int64), np.array(offsets, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int, steps: int = 100) -> int:
    """Bins that every packing needs, the best of two families of dual feasible functions.

    The first drops lengths under k and rounds those over capacity - k up to whole bins; the
    second rounds (k + 1) * length / capacity down to whole parts, of which k make a bin.
    """
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1)
    many, total = np.cumsum(count), np.cumsum(count * x)
    best = -(-int(total[-1]) // capacity)
    k = np.arange(1, capacity // 2 + 1)
    whole = many[-1] - many[capacity - k]
    middle = total[capacity - k] - total[k - 1]
    if len(k):
        best = max(best, int((whole - (-middle // capacity)).max()))
    for k in range(1, steps + 1):
        parts = (k + 1) * x
        share = np.where(parts % capacity == 0, k * x, parts // capacity * capacity)
        best = max(best, -(-int((count * share).sum()) // (k * capacity)))
    return best


def _packed(items: DataFrame, parts: int, round_: int, capacity: int) -> DataFrame:
    """Items with their sequence and offset, and their partition's bins and lower bound."""
    names = ["uid", "doc_id", "piece", "start", "length", "ids_crc32"]

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("uid")
        lengths = table["length"].to_numpy()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        n, part = len(lengths), table["part"][0].as_py()
        table = table.select(names)
        for name, value in (
            ("part", np.full(n, part)),
            ("sequence_id", (part << 20) + bins),
            ("offset", offsets),
            ("bins", np.full(n, bins.max() + 1)),
            ("bound", np.full(n, lower_bound(lengths, capacity))),
        ):
            table = table.append_column(name, pa.array(value, pa.int64()))
        return table

    part = F.pmod(F.xxhash64("uid", F.lit(round_)), F.lit(parts)).cast("long") + F.lit(round_ << 32)
    schema = f"uid long, {PIECE}, part long, sequence_id long, offset long, bins long, bound long"
    return checkpointed(items.select(*names, part.alias("part")).groupBy("part").applyInArrow(pack, schema))


def _bins(packed: DataFrame) -> int:
    return packed.groupBy("part").agg(F.first("bins").alias("bins")).agg(F.sum("bins")).first()[0] or 0


def exchanged(now: DataFrame, capacity: int) -> DataFrame:
    """``now`` (from ``_packed``) after exchanges between its partitions, for as long as they save bins.

    Partitions above their bound are dealt anew among each other and packed again; a lone one
    exchanges with a certified partition. When that saves nothing more, the bins with free
    space of all partitions are packed anew together (each partition may hold a last bin that is
    nearly empty), again for as long as that saves bins.
    """
    round_, certified = 1, False
    while True:
        if not certified:
            parts = now.groupBy("part").agg(*[F.first(c).alias(c) for c in ("bins", "bound")], F.count("*").alias("n"))
            gap = F.col("bins") > F.col("bound")
            gaps, partner = parts.agg(F.count_if(gap), F.min(F.when(~gap, F.col("part")))).first()
            chosen = gap if gaps != 1 or partner is None else gap | (F.col("part") == partner)
            bins, n = parts.where(chosen).agg(F.sum("bins"), F.sum("n")).first()
            if gaps == 0 or (gaps == 1 and partner is None):
                certified = True
                continue
            rest, items = now.where(~chosen), now.where(chosen)
        else:
            used = F.sum("length").over(Window.partitionBy("sequence_id"))
            open_ = checkpointed(now.withColumn("_open", used < capacity))
            rest, items = open_.where("not _open").drop("_open"), open_.where("_open").drop("_open")
            bins, n = items.agg(F.count_distinct("sequence_id"), F.count("*")).first()
        if not bins:
            return now
        again = _packed(items, max(1, -(-n // ITEMS)), round_, capacity)
        if _bins(again) < bins:
            now = rest.unionByName(again)
        elif certified:
            return now
        else:
            certified = True
        round_ += 1


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end: int = 0) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece of the closing id alone; repeated rows are packed one by
    one; null doc_ids and extra columns do no harm; an empty table gives an empty result. The
    driver sees a few sums a round.
    """
    # Fixed by the checkpoint, so a piece's number stays its own when tasks run again.
    pieces = checkpointed(pieces_of(docs, path, capacity, end)).withColumn("uid", F.monotonically_increasing_id())
    full = pieces.where(F.col("length") == capacity)
    items = pieces.where(F.col("length") < capacity)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    whole = full.select(*columns[:5], (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    now = _packed(items, max(1, -(-items.count() // ITEMS)), 0, capacity)
    return whole.union(exchanged(now, capacity).select(*columns))
