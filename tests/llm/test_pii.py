import hashlib
import random
import re

import numpy as np

from faultbench.llm.pii import KINDS, SkipChain, base_spans, digests, find_spans, graph, mask, masked, personal_spans, train

from awkward import documents, text

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def check_digit(s):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def brute(t):
    out = [(0, *m.span()) for m in re.finditer(PATTERNS[0], t)]
    out += [(1, *m.span()) for m in re.finditer(PATTERNS[1], t) if all(int(x) <= 255 for x in m[0].split("."))]
    for k, low, high in ((2, 16, 19), (3, 8, 15)):
        for m in re.finditer(PATTERNS[k], t):
            d = re.sub("[^0-9]", "", m[0])
            if low <= len(d) <= high and (k == 3 or check_digit(d)):
                out.append((k, *m.span()))
    return out


def teaching(n=300):
    """Documents with one span each, at times next to another number."""
    random.seed(14)
    out = []
    for i in range(n):
        words = random.choices("alpha beta gamma delta".split(), k=30)
        card = "".join(random.choices("0123456789", k=15))
        card = next(card + c for c in "0123456789" if check_digit(card + c))
        words.insert(random.randrange(30), [f"ann{i}@mail{i % 9}.example.com", ".".join(str(random.randrange(256)) for _ in range(4)), card, f"+1 ({random.randint(200, 999)}) 555-{random.randint(1000, 9999)}"][i % 4])
        if i % 3 == 0:
            words.insert(random.randrange(30), str(random.randrange(10 ** random.randint(1, 6))))
        out.append(" ".join(words))
    return out


def model():
    texts = teaching()
    return SkipChain().fit(graph(texts, [base_spans(t) for t in texts]))


def test_base_spans_against_the_patterns():
    random.seed(15)
    parts = [*"ab.@-_+%12 ()90,é", "a@b.co", "1.2.3.4", "4111 1111 1111 1111", "+1 (415) 555-0100", "255.", "."]
    for _ in range(20_000):
        t = "".join(random.choices(parts, k=random.randint(0, 30)))
        assert base_spans(t) == brute(t), t


def test_long_runs_stay_fast():
    for t in ("1" * 100_000, "a" * 100_000 + "@", "+1" + " " * 100_000, "1." * 50_000, "a@" * 50_000, "@" * 100_000):
        assert base_spans(t) == [] or t.startswith("1.")


def test_other_mentions_get_the_label_of_the_known_one():
    m = model()
    t = "call +1 (499) 555-6503 now, room 3000; again (499) 555-6503 or card 4111111111111111 x 4111.1111.1111.1111 y 1234567890123456"
    got = [(KINDS[k], t[a:b], s) for k, a, b, s in find_spans([t], m)[0]]
    assert ("phone", "+1 (499) 555-6503", True) in got and ("card", "4111111111111111", True) in got
    extra = {x[1] for x in got if not x[2]}
    assert "4111.1111.1111.1111" in extra and any("555-6503" in x for x in extra)
    assert not any("3000" in x or "1234567890123456" in x for x in extra)
    assert [x for x in find_spans(["room 3000 in 2024, 12:30, 10.5 % or 256.1.1.1"], m)[0]] == []


def test_message_passing_is_exact_on_a_tree():
    m = model()
    g = graph(["x1 22 +333 4@4"], [[]])
    keep = g.types == 0
    g.edges, g.types = g.edges[keep], g.types[keep]
    n, labels = len(g.base), 5
    field = g.x @ m.unary
    total, by = 0.0, np.zeros((n, labels))
    for code in range(labels**n):
        y = [code // labels**i % labels for i in range(n)]
        w = np.exp(sum(field[i, y[i]] for i in range(n)) + sum(m.pair[0][y[a], y[b]] for a, b in g.edges))
        total += w
        for i in range(n):
            by[i, y[i]] += w
    np.testing.assert_allclose(m.marginals(g, rounds=60), by / total, atol=1e-4)


def test_a_document_does_not_depend_on_its_batch():
    m, texts = model(), teaching(40)
    assert find_spans(texts, m) == [find_spans([t], m)[0] for t in texts]


def test_mask():
    spans = [(0, 2, 5, True), (3, 4, 8, False), (1, 9, 10, True)]
    assert mask("abcdefghijk", spans) == "ab[EMAIL]i[IP]k"


def test_awkward_rows(spark):
    docs = documents(spark)
    m = train(docs)
    rows = {r.doc_id: r for r in digests(personal_spans(docs, m)).collect()}
    for d, t in text():
        own = brute(t)
        assert [rows[d][f"n_{k}"] for k in KINDS] == [sum(x[0] == i for x in own) for i in range(4)] or d is None
        if d is not None:
            shown = ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in own)
            assert rows[d].base_sha256 == hashlib.sha256(shown.encode()).hexdigest()
            assert set(filter(None, shown.split(","))) <= set(rows[d].spans.split(","))
    out = masked(docs, m)
    assert out.schema == docs.schema
    got = {r.doc_id: r for r in out.collect()}
    assert got[5].text == "The same text, twice over: mail [EMAIL] now." and got[5].n_chars == len(got[5].text)
    assert got[0].text is None and got[1].text == "" and out.count() == len(text())
    empty = documents(spark, [])
    assert personal_spans(empty, train(empty)).collect() == [] and masked(empty, SkipChain()).collect() == []


def test_untrained_model_adds_nothing():
    t = "call +1 (499) 555-6503 or 12"
    assert [s[3] for s in find_spans([t], SkipChain())[0]] == [True]


def test_evidence_reaches_every_mention():
    model = SkipChain(agreement=4.0)
    model.unary[:] = 0  # the tokens' shapes say nothing
    t = "call +1 (415) 555-0199 now" + ", then 555-0199 again" * 100
    g = graph([t], [base_spans(t)])
    bare = [i for i, (_, a, b) in enumerate(g.cores) if not g.base[i]]
    assert len(bare) == 100
    assert model.marginals(g)[bare, KINDS.index("phone") + 1].min() > 0.95
    # A long document's result doesn't depend on those beside it.
    spans = find_spans([t], model)
    assert len(spans[0]) == 101 and find_spans(["a1 b2", t, "x1 22 +333"], model)[1] == spans[0]
    # With no pattern span near, evidence goes from mention to mention until it has arrived.
    keep = g.types < 2
    g.edges, g.types = g.edges[keep], g.types[keep]
    p = model.marginals(g)[bare, KINDS.index("phone") + 1]
    assert (np.diff(p) < 0).all() and p[60] > 0.2 + 1e-9
