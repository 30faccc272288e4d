import random
import zlib

import numpy as np
import pytest

from faultbench.llm.quality_cnn import BLOCK, HALF, Network, Training, accepted, held_out, score, train

from awkward import documents, text

WORDS = "the river went over green hills while we read old books in a quiet house".split()


def corpus(spark, n=240):
    random.seed(13)
    rows, labels = [], []
    for i in range(n):
        words = random.choices(WORDS, k=random.randint(5, 300))
        good = i % 3 > 0
        rows.append((i, " ".join(words) if good else "!! ".join(words).upper() if i % 2 else " | ".join(words), "en", "s"))
        labels.append((i, int(good), None))
    labels += [(None, 1, 0), (7, None, 0), (9999, 1, 0), (8, 5, 0), (3, 0, 0)]
    return rows, documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def loss(net, texts, y):
    p = net.scores(texts)
    return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))


def test_gradients():
    net, texts, y = Network(3), [b"hello world " * 60, b"abc!!! $$$" * 5, b""], np.array([1, 0, 1], np.float32)
    grad = net.step(texts, y, np.ones(3, np.float32))
    for k, p in net.p.items():
        flat, g = p.ravel(), grad[k].ravel()
        i = int(np.abs(g).argmax())
        old = flat[i]
        flat[i] = old + 1e-2
        up = loss(net, texts, y)
        flat[i] = old - 1e-2
        down = loss(net, texts, y)
        flat[i] = old
        assert abs((up - down) / 2e-2 - g[i]) < 0.02 * abs(g[i]) + 1e-5, k


def test_features_cover_the_whole_text_against_loops():
    net, long = Network(1), b"ab c" * (HALF // 2) + b"!!!!!!!!" + b"xy" * HALF
    for t in (b"", b"a", long, long * 3):
        data = t + b" " * ((-len(t)) % HALF or (0 if t else HALF)) + b" " * 8
        n = max(1, -(-len(t) // HALF))
        hit = np.array([net.p["embed"][list(data[i : i + 8])].ravel() @ net.p["filter"] + net.p["shift"] for i in range(0, n * HALF, 4)])
        half = np.maximum(hit, 0).reshape(n, -1, hit.shape[1]).max(axis=1)
        chunks = [half[i : i + 2].max(axis=0) for i in range(max(1, n - 1))]
        want = np.r_[np.mean(chunks, axis=0), half.max(axis=0)]
        np.testing.assert_allclose(net.features([b"other", t])[1], want, rtol=1e-4, atol=1e-5)


def test_blocks_do_not_change_scores():
    net, t = Network(2), bytes(random.Random(1).choices(range(256), k=HALF * (BLOCK + 3) + 17))
    near = net.scores([t])[0]
    assert abs(near - net.scores([b"x" * 900, t, b""])[1]) < 1e-5


def test_learns_and_scores_rows_it_never_saw(spark):
    rows, docs, labels = corpus(spark)
    net = train(docs, labels, Training(rows=200, least_steps=300))
    docs = docs.select("doc_id", "text")
    out = score(docs, net).select("doc_id", "_score", "_predicted", held_out().alias("held")).collect()
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    unseen = [r for r in out if r.held]
    assert sum(r._predicted == (r.doc_id % 3 > 0) for r in unseen) >= 0.95 * len(unseen)
    assert all(0 <= r._score <= 1 and r._predicted == (r._score >= 0.7) for r in out)


def test_held_out_labels_change_nothing(spark):
    _, docs, labels = corpus(spark, 60)
    how = Training(rows=40, least_steps=20)
    turned = labels.withColumn("quality", (held_out().cast("int") + labels.quality) % 2)
    a, b = train(docs, labels, how), train(docs, turned.where("quality is not null"), how)
    assert all(np.array_equal(a.p[k], b.p[k]) for k in a.p)


def test_awkward_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(3, 1), (6, 1), (5, 0), (5, 0)], "doc_id long, quality int")
    net = train(docs, labels, Training(least_steps=5))
    with pytest.raises(ValueError):
        score(docs, net)  # it has columns of these names
    out = score(docs, net, names=("s", "p"))
    assert out.columns == [*docs.columns, "s", "p"]
    assert out.count() == len(text()) and out.where("s is null").count() == 0
    kept = accepted(docs, net)
    assert kept.schema == docs.schema and kept.count() == out.where("p = 1").count()
    empty = documents(spark, [])
    none = train(empty, labels.limit(0))
    assert score(empty, none, names=("s", "p")).collect() == []
    assert {r.s for r in score(docs, none, names=("s", "p")).collect()} == {0.5}
