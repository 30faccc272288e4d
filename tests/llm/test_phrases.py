import random
import re
from collections import Counter

import numpy as np
import pytest

from faultbench.llm import phrases
from faultbench.llm.phrases import collocations, phrase_counts, subtree_counts

from awkward import EXTRA, ROWS, documents

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def brute_counts(rows, longest=4):
    f = Counter()
    for _, text, lang, _ in rows:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            for k in range(1, longest + 1):
                f.update((lang or "und", *w[i : i + k]) for i in range(len(w) - k + 1))
    return f


def brute(rows, longest=4, least=30, share=80, top=2000):
    f = brute_counts(rows, longest)
    n = Counter()
    for p, v in f.items():
        n[p[0]] += v if len(p) == 2 else 0
    found = {p: v for p, v in f.items() if len(p) > 2 and v >= least}
    inside = {}
    for p, v in found.items():
        w = p[1:]
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                q = (p[0], *w[i : i + k])
                inside[q] = max(inside.get(q, 0), v)
    by = {}
    for p, a in found.items():
        if 100 * inside.get(p, 0) >= share * a and p in inside:
            continue
        w = p[1:]
        cuts = [(2_000_000 * a // ((l := f[(p[0], *w[:k])]) + (r := f[(p[0], *w[k:])])), k, l, r) for k in range(1, len(w))]
        score, _, l, r = min(cuts)
        by.setdefault(p[0], []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted(
        (lang, i, w.decode(), -a, l, r, n[lang], -s)
        for lang, own in by.items()
        for i, (s, a, w, l, r) in enumerate(sorted(own)[:top], 1)
    )


def corpus(n=400):
    random.seed(21)
    words = ["the", "The", "of", "a", "é", "É", "x-1", "日本", "\x85", "und", *[f"w{i}" for i in range(30)]]
    weights = [40, 5, 20, 15, 5, 5, 5, 5, 5, 5, *[1] * 30]
    rows = []
    for i in range(n):
        t = "".join(w + random.choice([" ", " ", "  ", "\t", ". ", ",", "\n", " ; ", "\r\n"]) for w in random.choices(words, weights, k=60))
        rows.append((i, t + (" new york city hall" if i % 3 else " new york"), random.choice(["en", "en", "fr", None, "und"]), "s"))
    return rows


@pytest.mark.parametrize("budget", [1 << 20, 200, 20])
def test_equals_brute_force(spark, monkeypatch, budget):
    rows = corpus()
    monkeypatch.setattr(phrases, "ROWS", 50)  # counts of many slices are added up
    got = collocations(documents(spark, rows), budget=budget, least=10).collect()
    want = brute(rows, least=10)
    assert len(want) > 200 and sorted(map(tuple, got)) == want


def test_limits_ties_and_shares(spark):
    rows = corpus(150)
    got = collocations(documents(spark, rows), longest=3, least=5, share=50, top=7).collect()
    assert sorted(map(tuple, got)) == brute(rows, 3, 5, 50, 7)


def test_all_counts_below_the_budget_and_above(spark):
    rows = corpus(100)
    want = {(p[0], " ".join(p[1:]), v) for p, v in brute_counts(rows).items() if len(p) > 2 and v >= 3}
    for budget in (5, 50, 10**6):
        _, found = phrase_counts(documents(spark, rows), least=3, budget=budget)
        assert sorted(map(tuple, found.collect())) == sorted(want)


def test_saturated_filter_changes_nothing(spark, monkeypatch):
    rows = corpus(100)
    want = sorted(map(tuple, phrase_counts(documents(spark, rows), least=5)[1].collect()))
    full = np.full(1 << (phrases.FILTER_BITS - 5), 2**32 - 1, np.uint32)
    monkeypatch.setattr(phrases, "_bits", lambda places: full)
    assert sorted(map(tuple, phrase_counts(documents(spark, rows), least=5)[1].collect())) == want


def test_subtree_counts():
    rows = np.array([[0, 1, 2], [0, 1, -1], [0, 1, 2], [0, 2, 2], [3, 0, 1]])
    got = {
        (tuple(rows[i, :size].tolist()), int(v))
        for at, size, total in subtree_counts(np.zeros(5, int), rows, np.array([1, 5, 2, 1, 4]), np.full(5, 2), 2)
        for i, v in zip(at, total)
    }
    assert got == {((0, 1), 8), ((0, 1, 2), 3), ((3, 0), 4), ((3, 0, 1), 4)}


def test_awkward_rows(spark):
    got = collocations(documents(spark), least=2).collect()
    assert sorted(map(tuple, got)) == brute(ROWS, least=2)
    assert set(EXTRA) <= set(documents(spark).columns)
    assert collocations(documents(spark, [])).collect() == []
    assert collocations(documents(spark, [(1, None, None, None), (2, " \n", "en", "s")])).collect() == []
