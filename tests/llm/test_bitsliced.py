import math
import random

import numpy as np
from pyspark.sql import functions as F

from faultbench.llm import bitsliced
from faultbench.llm.bitsliced import build, order_key, search, top_k

SCHEMA = "vec_id long, embedding array<float>, rank int, part int, x int, copy int"


def brute(rows, every, k):
    fine = [
        (i, [math.floor(256 * c) for c in v]) for i, v in rows
        if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)
    ]
    out = set()
    for q in {i for i, _ in fine if i % every == 0}:
        own = min(v for i, v in fine if i == q)
        best = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in fine if i != q)[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA)


def test_block_search_is_exact():
    rng = np.random.default_rng(5)
    for n, d in ((1, 3), (64, 4), (500, 7), (130, 1)):
        x = rng.integers(-20, 30, (n, d))
        ids = np.sort(rng.choice(5000, n, replace=False))
        x[n // 2 :] = x[0]  # ties
        queries, own = rng.integers(-9, 9, (12, d)), np.r_[ids[:6], np.arange(9000, 9012)][:12]
        q, v, s = search(*build(x), ids, queries, own, 5)
        for w, o in zip(queries, own):
            want = sorted((-int(a), int(i)) for a, i in zip(x @ w, ids) if i != o)[:5]
            assert sorted(zip((-s[q == o]).tolist(), v[q == o].tolist())) == want


def test_keys_order_like_scores():
    random.seed(10)
    some = [0, 1, -1, 255, 256, -255, -256, 2**63, -(2**63)] + [random.randint(-(2**n), 2**n) for n in range(1, 300) for _ in range(5)]
    assert [x for _, x in sorted((order_key(x), x) for x in some)] == sorted(some)


def test_awkward_vectors(spark, monkeypatch):
    monkeypatch.setattr(bitsliced, "BLOCK_ROWS", 25)
    monkeypatch.setattr(bitsliced, "QUERY_ROWS", 7)
    random.seed(6)
    f = lambda: float(np.float32(random.uniform(-1, 1)))
    rows = [(i, [f() for _ in range(6)]) for i in range(120)]
    rows += [(i, rows[0][1]) for i in range(200, 260)]  # one hot vector
    rows += [(300, rows[1][1])] * 20  # repeated rows
    rows += [(310, None), (311, [None] * 6), (312, [float("nan")] * 6), (313, [float("inf")] + [0.0] * 5), (None, [1.0] * 6)]
    rows += [(320, [0.5, 0.25]), (321, []), (330, [0.0] * 6), (40, rows[2][1])]
    got = {tuple(r) for r in top_k(table(spark, rows), F.col("vec_id") % 10 == 0, 5).collect()}
    pad = [(i, v + [0.0] * (6 - len(v)) if v is not None else v) for i, v in rows]
    want = {(q, r, i, s) for q, r, i, s in brute(pad, 10, 5)}
    assert got == want
    assert top_k(table(spark, []), F.col("vec_id") % 10 == 0).collect() == []
    assert top_k(table(spark, [(50, [1.0])]), F.col("vec_id") % 10 == 0).collect() == []


def test_components_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(bitsliced, "BLOCK_ROWS", 25)
    random.seed(9)
    f = lambda: float(np.float32(random.uniform(-1, 1)))
    rows = [(i, [f() for _ in range(4)]) for i in range(60)]
    big = (70000.0, -70000.0, 1e9, -1e19, 1e30, -3e38, 3e38, float(np.float32(2**40 + 2**20)))
    rows += [(100 + i, [f(), float(np.float32(x)), f(), f()]) for i, x in enumerate(big)]
    rows += [(110, [float(np.float32(1e30))] * 4), (120, [float(np.float32(1e30))] * 4)]  # ties beyond a bigint
    got = sorted(tuple(r) for r in top_k(table(spark, rows), F.col("vec_id") % 10 == 0, 5).collect())
    want = {(q, r, i, min(max(s, -(2**63)), 2**63 - 1)) for q, r, i, s in brute(rows, 10, 5)}
    assert got == sorted(want)
    assert {r for r in got if r[0] == 0} and any(abs(s) == 2**63 - 1 for *_, s in got)
