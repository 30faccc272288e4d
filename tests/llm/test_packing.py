import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest

from pyspark.sql import functions as F

from faultbench.llm import packing
from faultbench.llm.packing import best_fit_decreasing, lower_bound, pack_documents, pieces_of

from awkward import documents, text

PATH = public_tokenizers.path("byte_bpe_50k.json")


def optimum(lengths, capacity):
    for n in range(1, len(lengths) + 1):
        for deal in itertools.product(range(n), repeat=len(lengths) - 1):
            if np.bincount([0, *deal], lengths, n).max() <= capacity:
                return n
    return 0


def test_bound_and_packing_around_the_optimum():
    rng = np.random.default_rng(16)
    for _ in range(60):
        c = int(rng.integers(4, 30))
        lengths = rng.integers(1, c + 1, rng.integers(1, 7))
        bins, offsets = best_fit_decreasing(lengths, c)
        assert np.bincount(bins, lengths).max() <= c
        best = optimum(lengths.tolist(), c)
        assert lower_bound(lengths, c) <= best <= bins.max() + 1


def test_bound_sees_more_than_the_sum():
    assert lower_bound(np.full(10, 51), 100) == 10
    assert lower_bound(np.array([40, 40, 40, 40, 40, 40]), 100) == 3
    assert lower_bound(np.full(6, 34), 100) == 3


def check(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("items", [50_000, 5])
def test_awkward_rows(spark, monkeypatch, items):
    monkeypatch.setattr(packing, "ITEMS", items)  # few items a partition: gaps are exchanged
    tok = pytest.importorskip("tokenizers").Tokenizer.from_file(PATH)
    rows = pack_documents(documents(spark), PATH, capacity=64).collect()
    check(rows, 64)
    want = []
    for d, t in text():
        ids = [*tok.encode(t, add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % 64 or 64, len(ids) + 1, 64)] if len(ids) > 64 else [0, len(ids)]
        for i, (a, b) in enumerate(itertools.pairwise(cuts)):
            want.append((d, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(want, key=str)
    assert pack_documents(documents(spark, []), PATH).collect() == []


def test_exchange_keeps_every_piece_and_saves_bins(spark, monkeypatch):
    monkeypatch.setattr(packing, "ITEMS", 8)
    docs = documents(spark, [(i, "a " * (3 + i * 7 % 29), "en", "s") for i in range(200)])
    rows = pack_documents(docs, PATH, capacity=32).collect()
    assert {r.doc_id for r in rows} == set(range(200))
    once = pieces_of(docs, PATH, 32).withColumn("uid", F.monotonically_increasing_id()).where("length < 32")
    dealt = packing._packed(once, 25, 0, 32)
    before = dealt.select("sequence_id").distinct().count()
    assert check(packing.exchanged(dealt, 32).collect(), 32) < before
    assert check(rows, 32) <= before + sum(r.length == 32 for r in rows)


def placed(spark, lengths, round_, start):
    rows = [(start + i, start + i, 0, 0, n, 0) for i, n in enumerate(lengths)]
    return packing._packed(spark.createDataFrame(rows, f"uid long, {packing.PIECE}"), 1, round_, 32)


def test_open_bins_of_all_partitions_are_packed_together(spark):
    """Six of 11 need 3 bins and 10, 9 one more, all certified; together they need 3."""
    now = placed(spark, [11] * 6, 0, 0).union(placed(spark, [10, 9], 1, 6))
    assert now.where("bins > bound").count() == 0 and now.select("sequence_id").distinct().count() == 4
    got = packing.exchanged(now, 32).collect()
    assert sorted(r.uid for r in got) == list(range(8)) and check(got, 32) == 3


def test_lone_gap_exchanges_with_a_certified_partition(spark):
    rng = np.random.default_rng(7)
    while True:
        gap = rng.integers(6, 17, 12)
        if best_fit_decreasing(gap, 32)[0].max() + 1 > lower_bound(gap, 32):
            break
    now = placed(spark, gap.tolist(), 0, 0).union(placed(spark, [1] * 40, 1, 12))
    assert now.where("bins > bound").select("part").distinct().count() == 1
    got = packing.exchanged(now, 32).collect()
    assert sorted(r.uid for r in got) == list(range(52))
    assert check(got, 32) < now.select("sequence_id").distinct().count()
