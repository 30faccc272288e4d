"""The pipeline against a plain Python version of its stages, and the registered queries."""

import random

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from faultbench.llm.pii import find_spans, mask
from faultbench.llm.pii import train as train_pii
from faultbench.llm.quality_cnn import train
from faultbench.llm.quality_rules import LineLimits, normalised
from faultbench.llm.queries import QUERIES, SQL

from awkward import documents, text
from test_packing import check
from test_quality_rules import frequent_lines, verdict
from test_simhash import brute_components, brute_fingerprint

WORDS = [f"{a}{b}{c}" for a in ("ri", "mo", "ta", "len", "su") for b in ("ver", "nd", "sto", "ka") for c in ("", "s", "ing", "er")]


def corpus():
    """Clean texts, junk, copies and near copies, personal data, boilerplate, awkward rows."""
    random.seed(21)
    rows, labels = [], []
    line = "Cookies keep this site going."
    for i in range(260):
        words = random.choices(WORDS, k=random.randint(60, 160))
        kind = i % 13
        if kind < 3:
            body = "!! ".join(words).upper()
        elif kind == 3:
            body = " | ".join(words)
        else:
            body = " ".join(words)
        if kind == 4:
            body += f"\nmail ann.{i}@mail.example.com or +1 (415) 555-{1000 + i}, again 555-{1000 + i} now"
        if kind in (5, 6):
            body = f"{line}\n{body}"
        rows.append((i, body, "en", "s0" if kind in (5, 6) else f"s{i % 3}"))
        labels.append((i, int(kind > 3)))
    base = " ".join(random.choices(WORDS, k=400))
    rows += [(300 + i, base, "en", "s0") for i in range(5)]
    rows += [(310 + i, base.replace(base.split()[7 + i], "changed", 1), "en", "s1") for i in range(5)]
    rows += [(d, t, lang, s) for d, t, lang, s in [(None, base + " x", None, None), (401, None, "en", "s0"), (402, "", "en", "s0"), (20, rows[20][1], "en", "s2")]]
    return rows, labels


def by_hand(spark, rows, labels):
    """The rows after each stage but the last, in plain Python; models as the stages learn them."""
    docs = documents(spark, rows)
    net = train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    keep = np.round(net.scores([(t or "").encode() for _, t, *_ in rows]), 6) >= 0.7
    out = [[r for r, k in zip(rows, keep) if k]]
    limits, passed = LineLimits(near=4), []
    found = frequent_lines(out[0], limits)
    for d, t, lang, h in out[0]:
        if t and verdict(t, h, found, limits)[1]:
            stay = [x for x in t.split("\n") if not x.split() or (h or "", normalised(x)) not in found]
            passed.append((d, "\n".join(stay), lang, h))
    out.append(passed)
    fps = [brute_fingerprint(t) for _, t, *_ in passed]
    nodes = sorted(set(fps))
    near = [(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :] if (a ^ b).bit_count() <= 4]
    root, first = brute_components(near, nodes), {}
    for r, f in sorted(zip(passed, fps), key=lambda x: (x[0][0] is None, x[0][0] or 0)):
        first.setdefault(root[f], r)
    out.append(list(first.values()))
    model = train_pii(documents(spark, out[2]))
    out.append([(d, mask(t, s) if (s := find_spans([t], model)[0]) else t, lang, h) for d, t, lang, h in out[2]])
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, labels = corpus()
    path = tmp_path_factory.mktemp("sf")
    documents(spark, rows).repartition(3).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(path / "labels.parquet"))
    return str(path)


def test_every_stage_equals_the_plain_version(spark, folder):
    rows, labels = corpus()
    want = by_hand(spark, rows, labels)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, sizes = docs.columns, [len(rows)]
    for (name, stage), expected in zip(corpus_pipeline.STAGES, want):
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
        path = f"{folder}/{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        got = sorted(((r.doc_id, r.text, r.lang, r.source) for r in docs.collect()), key=str)
        expected = sorted(expected, key=str)
        assert [r for r in got if r not in expected] == [r for r in expected if r not in got], name
        assert got == expected, name
        sizes.append(len(got))
    assert sizes == sorted(sizes, reverse=True) and sizes[0] > sizes[1] > sizes[2] and sizes[2] > sizes[3] == sizes[4]
    assert any("[EMAIL]" in t and "[PHONE]" in t for _, t, *_ in want[3])
    assert not any("Cookies keep" in t for _, t, *_ in want[1])


def test_run_packs_what_the_stages_leave(spark, folder):
    rows, labels = corpus()
    last = by_hand(spark, rows, labels)[-1]
    out = corpus_pipeline.run(spark, folder).collect()
    tok = pytest.importorskip("tokenizers").Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    size = {d: len(tok.encode(t, add_special_tokens=False).ids) + 1 for d, t, *_ in last}
    got = {}
    for r in out:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == size
    assert check(out, 2048) <= -(-sum(size.values()) // 2048) + 1


def test_empty_tables_pass_through(spark, tmp_path):
    documents(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_awkward_rows_pass_every_stage(spark, tmp_path):
    docs = documents(spark)
    spark.createDataFrame([(6, 1), (5, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() <= len(text()) or name == "best_fit_packing"
        if name != "best_fit_packing":
            assert out.schema == docs.schema, name


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_match_their_sql(spark, name):
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    want = sorted(map(str, cur.fetchall()))
    assert sorted(str(tuple(r[n] for n in names)) for r in QUERIES[name](spark, folder).collect()) == want
