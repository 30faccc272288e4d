import random
from collections import defaultdict

import xxhash

from faultbench.llm.components import connected_components
from faultbench.llm.simhash import fingerprint, links, near_duplicates, one_of_each
from tests.shuffles import bytes_shuffled

from awkward import documents, text


def brute_fingerprint(t):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64))


def brute_components(pairs, nodes):
    around = defaultdict(set)
    for a, b in pairs:
        around[a].add(b)
        around[b].add(a)
    least = {}
    for n in sorted(nodes):
        if n not in least:
            todo = [n]
            while todo:
                x = todo.pop()
                if x not in least:
                    least[x] = n
                    todo += around[x]
    return least


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def test_fingerprint():
    random.seed(8)
    some = ["", " ", "a", "A b C", "a b c d", "É\xa0é x Y z\x1cw v", *(" ".join(random.choices("ab Cd eF\tg".split(" "), k=n)) for n in range(60))]
    assert [fingerprint(t) for t in some] == [brute_fingerprint(t) for t in some]


def test_links_lose_nothing(spark):
    random.seed(9)
    base = [random.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base:  # balls of near fingerprints, dense and sparse
        for _ in range(25):
            x = b
            for _ in range(random.randint(1, 7)):
                x ^= 1 << random.randrange(64)
            fps.add(x)
    fps = sorted(map(signed, fps | {0, 1, 2**63, 15, 2**64 - 1}))
    near = lambda d: {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= d}
    table = spark.createDataFrame([(x,) for x in fps], "fp long")
    for d in (1, 3, 4, 6):
        got = [tuple(r) for r in links(table, d).collect()]
        assert len(got) == len(set(got)) and set(got) == near(d), d
    assert links(table, 0).collect() == []


def test_components(spark):
    random.seed(10)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(random.randrange(90), random.randrange(90)) for _ in range(60)]
    pairs += [(200, 200)] + [(300, i) for i in range(301, 400)] + [(-5, 170), (170, 180)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = brute_components(pairs, {x for p in pairs for x in p})
    assert got == {n: r for n, r in want.items() if n != r}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_awkward_rows_and_one_of_each(spark):
    rows = text()
    fps = [signed(brute_fingerprint(t)) for _, t in rows]
    nodes = sorted(set(fps))
    near = [(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 4]
    root = brute_components(near, nodes)
    least = {r: min((d for (d, _), f in zip(rows, fps) if root[f] == r and d is not None), default=None) for r in set(root.values())}
    want = sorted(((d, f, least[root[f]]) for (d, _), f in zip(rows, fps)), key=str)
    assert sorted(map(tuple, near_duplicates(documents(spark)).collect()), key=str) == want
    kept = one_of_each(documents(spark))
    assert kept.columns == documents(spark).columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(least.values(), key=str)
    empty = documents(spark, [])
    assert near_duplicates(empty).collect() == [] and one_of_each(empty).collect() == []


def test_rows_have_keys_of_128_bits(spark):
    from faultbench.llm.simhash import _row

    rows = [(1, "a b"), (1, "a  b"), (11, ""), (1, None), (None, "1"), (None, None), (11, None), (1, "1")]
    keys = documents(spark, [(d, t, "en", "s") for d, t in rows]).select(_row().alias("k")).collect()
    assert len({bytes(r.k) for r in keys}) == len(rows) and {len(r.k) for r in keys} == {16}


def test_keys_of_halves_find_the_same_links(spark):
    draw = random.Random(11)
    base = [draw.getrandbits(64) for _ in range(40)]
    fps = {x ^ sum(1 << b for b in draw.sample(range(64), n)) for x in base for n in (0, 1, 2, 3, 4, 5, 6)} | {0, 1, 2**64 - 1}
    table = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in fps], "fp long")
    for d in (1, 2, 3, 4, 7):
        want = {tuple(r) for r in links(table, d).collect()}
        got = [tuple(r) for r in links(table, d, halves=True).collect()]
        assert len(got) == len(set(got)) and set(got) == want and want


def test_keys_of_halves_move_little():
    """Bytes shuffled for each fingerprint (a key for each of 64 bits: 718)."""
    code = """
from pyspark.sql import functions as F
from faultbench.llm.simhash import links
spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
links(spark.range(20000).select(F.xxhash64("id").alias("fp")), 4, halves=True).write.format("noop").mode("overwrite").save()
"""
    assert bytes_shuffled(code) < 300 * 20000
