"""Exact top-k inner products over a bit-sliced index.

Vectors are quantised to integers and dealt to blocks of rows. A block's index keeps, for each
dimension, one bitmap for each binary digit of the (shifted, so unsigned) values: bit r of slice
(d, b) is digit b of row r's dimension d. A query adds the slices its weights ask for with carry-
save bitmap adders, so one machine word works on 64 rows; the sum is again a list of slices. The
best rows are then read off from the most significant slice downward. Rows that tie at the
boundary are settled by their ids, so the answer is exact.

A negative weight w is added as |w| times the complement of the dimension's slices; the constants
that shifting and complementing bring in are taken off the score at the end.

Components may have any finite size. Vectors with a component of 2**24 or more are indexed in blocks of
their own, and they and the scores that may pass 64 bits are handled in whole numbers of any
length; the bitmap arithmetic is the same.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultbench.llm.common import checkpointed

#: Rows of a block and queries of a group, on average: one meeting of the two is a task's unit of work.
BLOCK_ROWS, QUERY_ROWS = 16_384, 512
#: Vectors with a component this large or larger have blocks of their own.
LARGE = 1 << 24
#: Ends of a bigint.
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def build(vectors: np.ndarray) -> tuple[int, np.ndarray]:
    """The shift and the slices (dimensions, digits, words) of a block's integer vectors."""
    low = int(vectors.min())
    digits = max(1, int(vectors.max() - low).bit_length())
    rows = -(-len(vectors) // 64) * 64
    whole = np.uint64 if digits <= 62 else object
    moved = np.zeros((vectors.shape[1], rows), dtype=whole)
    moved[:, : len(vectors)] = (vectors - low).T
    slices = np.empty((vectors.shape[1], digits, rows // 64), dtype=np.uint64)
    one = np.uint64(1) if whole is np.uint64 else 1
    for b in range(digits):
        bits = ((moved >> (np.uint64(b) if whole is np.uint64 else b)) & one).astype(np.uint8)
        slices[:, b] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    return low, slices


def _add_up(layers: list[np.ndarray]) -> list[np.ndarray]:
    """Slices of the sum of bitmaps; ``layers[p]`` holds bitmaps (count, words) of weight 2**p."""
    out, p = [], 0
    while p < len(layers):
        now = layers[p]
        while len(now) > 1:
            third = len(now) // 3
            if third:  # three bitmaps make a sum bit and a carry
                a, b, c = now[:third], now[third : 2 * third], now[2 * third : 3 * third]
                odd = a ^ b
                carry = (a & b) | (odd & c)
                now = np.concatenate([odd ^ c, now[3 * third :]])
            else:
                carry = now[:1] & now[1:2]
                now = now[:1] ^ now[1:2]
            if p + 1 == len(layers):
                layers.append(carry)
            else:
                layers[p + 1] = np.concatenate([layers[p + 1], carry])
        out.append(now[0] if len(now) else None)
        p += 1
    while out and out[-1] is None:
        out.pop()
    return out


def weighted_sum(slices: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    """Slices of sum |w_d| * x_d over the dimensions, x_d complemented where w_d is negative."""
    size = np.abs(weights)
    digits, words = slices.shape[1:]
    layers: list[list[np.ndarray]] = []
    for p in range(int(size.max()).bit_length() if len(size) else 0):
        has = ((size >> p) & 1).astype(bool)
        plus, minus = slices[has & (weights > 0)], slices[has & (weights < 0)]
        for b in range(digits):
            while len(layers) <= p + b:
                layers.append([])
            layers[p + b] += [plus[:, b], ~minus[:, b]]
    return _add_up([np.concatenate(x) if x else np.empty((0, words), np.uint64) for x in layers])


def _rows(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def top_rows(total: list[np.ndarray], valid: np.ndarray, k: int) -> np.ndarray:
    """The k rows of the largest sums, from the top slice downward; ties to the smaller row.

    ``sure`` holds rows that are certainly in, ``maybe`` those that tie so far.
    """
    sure, maybe, n = np.zeros_like(valid), valid, 0
    for s in reversed(total):
        if s is None:
            continue
        ones = maybe & s
        c = int(np.bitwise_count(ones).sum())
        if n + c > k:
            maybe = ones
        else:
            sure, n = sure | ones, n + c
            maybe = maybe & ~s
            if n == k:
                break
    return np.sort(np.concatenate([_rows(sure), _rows(maybe)[: k - n]]))


def search(low: int, slices: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int):
    """Arrays (query, id, score) of each query's best k rows of a block whose rows are in id order.

    Scores are 64-bit where none can pass that, whole Python numbers otherwise."""
    digits, words = slices.shape[1:]
    full = np.packbits(np.arange(words * 64) < len(ids), bitorder="little").view(np.uint64)
    top = (1 << digits) - 1
    found = []
    for own, weights in zip(query_ids, queries):
        valid = full
        mine = slice(*np.searchsorted(ids, [own, own + 1]))
        if mine.start < mine.stop:
            bits = np.zeros(words * 64, np.uint8)
            bits[mine] = 1
            valid = full & ~np.packbits(bits, bitorder="little").view(np.uint64)
        total = weighted_sum(slices, weights)
        rows = top_rows(total, valid, k)
        whole = weights.astype(object)
        moved = low * int(whole.sum()) + top * int(whole[weights < 0].sum())
        kind = np.int64 if abs(moved) + (1 << len(total)) < MOST else object
        score = np.full(len(rows), moved, dtype=kind)
        for b, s in enumerate(total):
            if s is not None:
                score += ((s[rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64).astype(kind) << b
        found.append((np.full(len(rows), own), ids[rows], score))
    return [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 3


def order_key(score: int) -> bytes:
    """Bytes that order like whole numbers of any size: the number of bytes first, negative ones downward."""
    n = (abs(score).bit_length() + 7) // 8
    size = abs(score).to_bytes(n, "big")
    if score >= 0:
        return (32768 + n).to_bytes(2, "big") + size
    return (32768 - n).to_bytes(2, "big") + bytes(255 - x for x in size)


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """Rows (vec_id, x): floor(scale * component) as whole doubles, without vectors that are null, or hold a
    null or non-finite component (or one that is after scaling). Null ids take no part either."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) < float("inf")))

    def floor(c: Column) -> Column:
        y = c * scale  # from 2**53 on, doubles are whole
        return F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(y)

    return vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & fine).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, floor).alias("x")
    )


def _matrix(rows, dims: int) -> np.ndarray:
    """Integer vectors as a matrix, short ones filled up with zeros; whole Python numbers where they are large."""
    out = np.zeros((len(rows), dims))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    if not out.size or np.abs(out).max() < LARGE:
        return out.astype(np.int64)
    return np.array([[int(c) for c in r] for r in out], dtype=object).reshape(out.shape)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k best rows for each vec_id with ``is_query``.

    Candidates are all rows but those with the query's own vec_id; ties go to the smaller
    vec_id, and repeated rows are candidates each. A repeated query id is one query, its smallest
    vector. Shorter vectors count as filled up with zeros. Extra columns are ignored; an empty
    table gives an empty result. Components of any finite size are exact, and so is the order of scores; a
    score beyond a bigint is given as the bigint next to it.

    Every block of rows meets every group of queries once, in a task of its own; a meeting works
    for seconds on about a megabyte. It keeps k rows a query, and the final ranking cuts to k
    before its shuffle too.
    """
    # No answer holds more than k copies of a row, so more than k of them need not be indexed.
    copies = quantised(vectors, scale).groupBy("vec_id", "x").agg(F.count("*").alias("n"))
    each = F.explode(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")))
    large = F.exists("x", lambda c: F.abs(c) >= LARGE)
    rows = checkpointed(copies.select("vec_id", "x", large.alias("large"), each.alias("copy")))
    n, wide, dims = rows.agg(F.count("*"), F.count_if("large"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("x").alias("x"))
    plain, more = max(1, -(-(n - wide) // BLOCK_ROWS)), -(-wide // BLOCK_ROWS)
    blocks = plain + more
    groups = max(1, -(-queries.count() // QUERY_ROWS))
    dealt = {"index": (rows, blocks), "group": (queries, groups)}

    def as_index(frame: pd.DataFrame) -> pd.DataFrame:
        order = frame.sort_values("vec_id", kind="stable")
        low, slices = build(_matrix(order["x"], dims)) if dims else (0, np.zeros((0, 1, -(-len(order) // 64)), np.uint64))
        return pd.DataFrame(
            {
                "block": [int(frame["part"].iloc[0])],
                "low": [str(low)],
                "digits": [slices.shape[1]],
                "ids": [order["vec_id"].to_numpy(np.int64).tobytes()],
                "slices": [slices.tobytes()],
            }
        )

    def as_group(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "group": [int(frame["part"].iloc[0])],
                "query_ids": [frame["vec_id"].to_numpy(np.int64).tobytes()],
                "weights": [pickle.dumps(_matrix(frame["x"], dims))],
            }
        )

    def meet(block: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        if not len(block) or not len(group):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("query_id", "vec_id", "score")} | {"key": np.zeros(0, object)})
        b, g = block.iloc[0], group.iloc[0]
        ids, own = np.frombuffer(b["ids"], np.int64), np.frombuffer(g["query_ids"], np.int64)
        slices = np.frombuffer(b["slices"], np.uint64).reshape(dims, b["digits"], -(-len(ids) // 64))
        weights = pickle.loads(g["weights"])
        q, v, s = search(int(b["low"]), slices, ids, weights, own, k)
        exact = s.tolist()
        s = s if s.dtype != object else np.array([min(max(x, LEAST), MOST) for x in exact], np.int64)
        return pd.DataFrame({"query_id": q, "vec_id": v, "score": s, "key": [order_key(x) for x in exact]})

    def parted(name: str) -> DataFrame:
        table, parts = dealt[name]
        if name == "index":
            h = F.xxhash64("vec_id", "x")
            part = F.when(F.col("large"), plain + F.pmod(h, F.lit(max(1, more)))).otherwise(F.pmod(h, F.lit(plain)))
        else:
            part = F.pmod(F.xxhash64("vec_id"), F.lit(parts))
        return table.withColumn("part", part.cast("int")).groupBy("part")

    def numbers(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    index = parted("index").applyInPandas(as_index, "block int, low string, digits int, ids binary, slices binary")
    group = parted("group").applyInPandas(as_group, "group int, query_ids binary, weights binary")
    meeting = ["block", "group"]
    left = index.withColumn("group", numbers(groups)).groupBy(*meeting)
    right = group.withColumn("block", numbers(blocks)).groupBy(*meeting)
    best = left.cogroup(right).applyInPandas(meet, "query_id long, vec_id long, score long, key binary")
    order = Window.partitionBy("query_id").orderBy(F.desc("key"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
