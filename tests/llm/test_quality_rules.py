import random
import re
from collections import Counter
from itertools import combinations

from corpus_pipeline import clean_lines
from faultbench.llm.quality_rules import LineLimits, cleaned, normalised, quality_rules, repeated_words

from awkward import documents, text
from test_simhash import brute_components, brute_fingerprint

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(t):
    words = WORD.findall(t)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen, marked = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            marked |= set(range(i, i + 5))
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(marked)


def failed(c):
    return c[0] < 10 or 100 * c[4] > 20 * c[0]


def test_repeated_words():
    random.seed(11)
    for _ in range(2000):
        words = random.choices([b"a", b"b", b"c"], k=random.randint(0, 40))
        assert repeated_words(words) == brute(b" ".join(words).decode())[4]


def test_awkward_rows(spark):
    got = [(r.doc_id, *r[1:6], r.base_failed, r.kept) for r in quality_rules(documents(spark)).collect()]
    want = [(d, *(c := brute(t)), failed(c), not failed(c)) for d, t in text()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert quality_rules(documents(spark, [])).collect() == []


def corpus():
    """A host with boilerplate, junk made of it, copies and near copies of a clean text, and a small host."""
    random.seed(12)
    word = lambda: "".join(random.choices("abcdefghij", k=6))
    line = lambda n: " ".join(word() for _ in range(n))
    menu = [line(6) for _ in range(8)]
    rows = [(i, f"{line(40)}\n{menu[0].upper()}  {i}\n{line(35)}", "en", "big") for i in range(40)]
    rows += [(100 + i, "\n".join(menu) + f"\n{line(3)}", "en", "big") for i in range(30)]
    rows += [(200 + i, "\n".join(menu[:4]) + "\nx", "en", "small") for i in range(3)]
    copy = "\n".join(line(9) for _ in range(6))
    rows += [(300 + i, copy, "en", "big") for i in range(60)]
    head, tail = line(50), line(50)
    rows += [(400 + i, f"{head} {word()}\n{tail}", "en", "big") for i in range(60)]
    return rows, menu


def lines_of(t):
    return [x for x in t.split("\n") if WORD.search(x)]


def frequent_lines(rows, limits):
    """(host, normalised line) above the limits, in plain Python."""
    texts, many = {}, {}
    for _, t, _, h in rows:
        texts.setdefault(h or "", set()).add(t or "")
    held = {(h, t): {normalised(x) for x in lines_of(t)} for h, own in texts.items() for t in own}
    for (h, t), own in held.items():
        for x in own:
            many.setdefault((h, x), set()).add(t)

    def above(counts):
        return {k for k, v in counts.items() if len(v) > max(limits.min_docs, limits.min_share * len(texts[k[0]]))}

    found = above(many)
    if limits.near is None:
        return found
    some = {t for (h, t), own in held.items() if any((h, x) in found for x in own)}
    fps = {t: brute_fingerprint(t) for t in some}
    nodes = sorted(set(fps.values()))
    root = brute_components([(a, b) for a, b in combinations(nodes, 2) if (a ^ b).bit_count() <= limits.near], nodes)
    return above({k: {root[fps[t]] for t in many[k]} for k in found})


def verdict(t, h, found, limits):
    """Removed words, and whether the document is kept."""
    gone = sum(len(WORD.findall(x)) for x in lines_of(t) if (h or "", normalised(x)) in found)
    c = brute(t)
    return gone, not failed(c) and c[0] - gone >= limits.min_kept * c[0]


def test_line_frequency_against_brute_force(spark):
    rows, menu = corpus()
    for near in (None, 4, 20):
        limits = LineLimits(min_docs=10, min_share=0.01, min_kept=0.2, near=near)
        got = {r.doc_id: r for r in quality_rules(documents(spark, rows), limits).collect()}
        found = frequent_lines(rows, limits)
        assert found
        assert {d: (got[d].removed_words, got[d].kept) for d in got} == {d: verdict(t, h, found, limits) for d, t, _, h in rows}
        if near is None:
            assert not any(got[100 + i].kept for i in range(30))  # menus alone
        assert all(got[d].kept for d in [*range(40), *range(200, 203), *range(300, 360)])


def test_lines_of_any_length_count(spark):
    """200 documents of one host, each one line that all share and one word of its own."""
    random.seed(15)
    word = lambda: "".join(random.choices("abcdefghij", k=6))
    for size in (30, 40, 400):
        shared = " ".join(word() for _ in range(size))
        rows = [(i, f"{shared}\n{word()}", "en", "big") for i in range(200)]
        limits = LineLimits(near=None)
        assert not any(r.kept for r in quality_rules(documents(spark, rows), limits).collect())
        # by groups they are few documents, all near copies of one
        many = frequent_lines(rows, LineLimits())
        got = {r.doc_id: r.kept for r in quality_rules(documents(spark, rows)).collect()}
        assert got == {d: verdict(t, h, many, LineLimits())[1] for d, t, _, h in rows}


def test_cleaned_removes_lines_and_keeps_columns(spark):
    rows, menu = corpus()
    docs = documents(spark, rows)
    out = cleaned(docs, LineLimits(min_docs=10, min_share=0.01, near=None))
    assert out.schema == docs.schema
    got = {r.doc_id: r for r in out.collect()}
    assert not any(100 <= d < 130 for d in got) and len(got) == len(rows) - 30
    # digits count as 0: ten documents have the line with one digit, thirty the one with two
    assert all(got[d].text.count("\n") == (2 if d < 10 else 1) for d in range(40))
    assert all(got[d].n_chars == len(got[d].text) for d in got)
    assert got[300].text == rows[73][1]
    awkward = cleaned(documents(spark))
    assert sorted((r.doc_id for r in awkward.collect()), key=str) == sorted((d for d, t in text() if not failed(brute(t))), key=str)


def near_copies():
    """On one host, 30 texts of 20 short lines, one word changed in each; and other texts."""
    random.seed(13)
    word = lambda: "".join(random.choices("abcdefghij", k=6))
    base = [[word() for _ in range(12)] for _ in range(20)]
    rows = []
    for i in range(30):
        own = [list(x) for x in base]
        own[i % 20][i % 12] = word()
        rows.append((i, "\n".join(map(" ".join, own)), "en", "big"))
    menu = " ".join(word() for _ in range(9))
    return rows + [(100 + i, menu + "\n" + " ".join(word() for _ in range(60)), "en", "big") for i in range(25)], menu


def test_near_copies_of_a_host_count_once(spark):
    rows, menu = near_copies()
    docs = documents(spark, rows)
    assert {r.doc_id for r in quality_rules(docs, LineLimits(near=None)).where("kept").collect()} == set(range(100, 125))
    got = {r.doc_id: r for r in quality_rules(docs).collect()}
    assert all(r.kept and r.removed_words == (9 if d >= 100 else 0) for d, r in got.items()) and len(got) == 55
    out = {r.doc_id: r.text for r in clean_lines(spark, docs, "").collect()}
    assert out == {d: t.removeprefix(menu + "\n") for d, t, *_ in rows}


def test_long_lines_count_in_the_pipeline(spark):
    random.seed(14)
    line = lambda n: " ".join("".join(random.choices("abcdefghij", k=6)) for _ in range(n))
    passages = [line(60) for _ in range(8)]
    rows = [(i, "\n".join(x), "en", "big") for i, x in enumerate(combinations(passages, 3))]  # each in 21
    rows += [(100 + i, f"{line(90)}\n{passages[0]}", "en", "big") for i in range(5)]
    rows += [(200 + i, "\n".join(passages[:3]), "en", "small") for i in range(3)]
    out = {r.doc_id: r.text for r in clean_lines(spark, documents(spark, rows), "").collect()}
    assert out == {d: t.split("\n")[0] if d < 200 else t for d, t, *_ in rows if d >= 100}
