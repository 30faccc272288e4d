import hashlib
import random
import zlib

import numpy as np
import pytest

from faultbench.llm.queries import op13_periodic_runs
from faultbench.llm.runs import diagonal_runs, periodic_runs

from awkward import documents, text


def brute(words, shortest=24, repeats=3):
    """Every maximal stretch of every lag, without those that have a smaller period."""
    found = []
    for q in range(1, len(words) // repeats + 1):
        i = q
        while i < len(words):
            j = i
            while j < len(words) and words[j] == words[j - q]:
                j += 1
            own = words[i - q : j]
            if len(own) >= max(shortest, repeats * q) and j > i:
                if not any(own[p:] == own[:-p] for p in range(1, q)):
                    found.append((i - q, len(own), q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def rows(found):
    return list(zip(*[x.tolist() for x in found]))


def test_runs_equal_brute_force():
    rng = random.Random(13)
    total = 0
    for _ in range(400):
        docs = []
        for _ in range(rng.randint(0, 4)):
            words = []
            for _ in range(rng.randint(0, 5)):
                words += rng.choices(range(rng.choice([1, 2, 3, 5])), k=rng.randint(1, 25)) * rng.randint(1, 8)
                words += words[-rng.randint(0, 40) :] if rng.random() < 0.3 else []
            docs.append(words)
        shortest, repeats = rng.choice([(24, 3), (24, 3), (6, 3), (10, 4), (1, 3)])
        flat, stops = np.array([x for d in docs for x in d], np.int64), np.cumsum([len(d) for d in docs]).astype(np.int64)
        want, before = [], 0
        for d in docs:
            want += [(s + before, n, p) for s, n, p in brute(d, shortest, repeats)]
            before += len(d)
        got = rows(diagonal_runs(flat, stops, shortest, repeats))
        assert got == sorted(want, key=lambda r: (r[0], r[2]))
        total += len(got)
    assert total > 1000


def test_runs_inside_runs_and_long_periods():
    block = [0, 1] * 20 + [2]
    words = np.array(block * 5)
    inner = [(41 * i, 40, 2) for i in range(5)]
    assert sorted(rows(diagonal_runs(words, np.array([205])))) == sorted([(0, 205, 41), *inner])
    assert rows(diagonal_runs(np.arange(5000) % 1600, np.array([5000]))) == [(0, 5000, 1600)]
    assert rows(diagonal_runs(np.arange(5000) % 1700, np.array([5000]))) == []
    assert rows(diagonal_runs(np.zeros(23, int), np.array([23]))) == []
    assert rows(diagonal_runs(np.zeros(46, int), np.array([23, 46]))) == []
    with pytest.raises(ValueError):
        diagonal_runs(words, np.array([205]), repeats=2)


def test_one_word_a_million_times():
    assert rows(diagonal_runs(np.zeros(10**6, int), np.array([10**6]))) == [(0, 10**6, 1)]


MORE = [
    (20, "x " * 30 + "y z " * 40 + "end", "en", "s"),
    (21, "\x85 b" * 30, "en", "s"),
    (22, "x " * 23, "en", "s"),
]


def test_awkward_rows(spark):
    from awkward import ROWS

    table = documents(spark, ROWS + MORE)
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(table).collect()]
    want = []
    for d, t in text(ROWS + MORE):
        words = t.encode().split()
        runs = brute(words) if len(words) < 1000 else [(s, n, p) for s, n, p in _long_runs(words)]
        gone = {i for s, n, p in runs for i in range(s + p, s + n)}
        want.append((d, len(words), runs, b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(len(r[2]) > 1 for r in got)
    assert periodic_runs(documents(spark, [])).collect() == []


def _long_runs(words):
    """For texts too long for every lag: lags at which the words near the middle or ends recur."""
    ids = {}
    flat = np.array([ids.setdefault(w, len(ids)) for w in words])
    found = []
    for q in range(1, len(flat) // 3 + 1):
        same = np.flatnonzero(np.diff(np.r_[0, flat[q:] == flat[:-q], 0]))
        for a, b in zip(same[::2].tolist(), same[1::2].tolist()):
            own = flat[a : b + q]
            if len(own) >= max(24, 3 * q) and not any((own[p:] == own[:-p]).all() for p in range(1, q)):
                found.append((a, b - a + q, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_query_plants_runs_and_digests(spark, tmp_path):
    base = " ".join(f"w{i}" for i in range(100))
    table = documents(spark, [(i, base, "en", "s") for i in range(60)] + [(100, None, "en", "s"), (None, base, "en", "s")])
    table.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op13_periodic_runs(spark, str(tmp_path)).collect()}
    planted = 0
    for d, r in got.items():
        words = base.split() if d != 100 else []
        h = zlib.crc32(str(d).encode())
        if words and d is not None and h % 10 == 0:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            planted += 1
        runs = brute(words)
        gone = {i for s, n, p in runs for i in range(s + p, s + n)}
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None,) * 3)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    assert planted > 2
