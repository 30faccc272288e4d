"""Document quality rules: base statistics, and line frequency across a host's documents.

Lines of any length are normalised (lower case, digits to 0, white space to one space) and
hashed. A line that occurs in too many distinct documents of one host is boilerplate; it is removed,
and a document of which too little remains is rejected. A group of near copies on a host is one
document: such groups are the near-duplicate stage's business and would otherwise lose their last
member here. Groups are made only of texts that hold a line above the limits by a plain count of
texts, since no other line can be above them by groups.

Texts are told apart by 128 bits (MD5), lines of a host by 64 bits: two lines of one hash count together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultbench.llm.common import checkpointed, sliced, strings, unused
from faultbench.llm.simhash import fingerprint, roots
from faultbench.session import release

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\r\x0b\x0c"
WINDOW = 5
_digits = re.compile(r"\d")


@dataclass(frozen=True)
class LineLimits:
    """A line is removed if it is in more than ``min_docs`` documents of its host, and in more than
    ``min_share`` of the host's distinct texts. A document is rejected if less than ``min_kept`` of its
    words remain.

    Documents that SimHash fingerprints at most ``near`` bits apart lead to, among the texts with a line
    above these limits, count as one; with None, only those of equal texts do."""

    min_docs: int = 20
    min_share: float = 0.0005
    min_kept: float = 0.2
    near: int | None = 4


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 5-word window found at least twice."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    # First a hash of each window: where all differ, no window repeats.
    key = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = key[:n].copy()
    for i in range(1, WINDOW):
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed += key[i : n + i]
    mixed.sort()
    if (mixed[1:] != mixed[:-1]).all():
        return 0
    index: dict[bytes, int] = {}
    ids = np.array([index.setdefault(w, len(index)) for w in words], dtype=np.int64)
    code = ids[:n]
    for i in range(1, WINDOW):
        code = np.unique(code * len(index) + ids[i : n + i], return_inverse=True)[1]
    again = np.bincount(code)[code] > 1
    inside = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(inside, np.flatnonzero(again), 1)
    np.add.at(inside, np.flatnonzero(again) + WINDOW, -1)
    return int((np.cumsum(inside) > 0).sum())


def normalised(line: str) -> str:
    return _digits.sub("0", " ".join(line.lower().split()))


def line_hash(line: str) -> int:
    return xxhash.xxh64_intdigest(normalised(line).encode()) - 2**63


def statistics(text: str) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the hashes of its lines with
    the words that each holds in all."""
    data = text.encode()
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip(SPACE)]
    held: dict[int, int] = {}
    for line in lines:
        h = line_hash(line.decode())
        held[h] = held.get(h, 0) + len(line.split())
    return (
        len(words),
        len(text) - (len(data) - len(data.translate(None, SPACE))),
        len(data) - len(data.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        list(held),
        list(held.values()),
    )


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _measured(docs: DataFrame, limits: LineLimits) -> DataFrame:
    """One narrow row per document: counts, a text key, its lines, and its fingerprint (null without ``near``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = strings(batch)
            columns = list(zip(*[statistics(t) for t in texts]))
            if limits.near is None:
                fps = pa.nulls(len(texts), pa.int64())
            else:
                fps = pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("host"),
                    batch.column("text_key"),
                    *[pa.array(x, pa.int64()) for x in columns[:5]],
                    *[pa.array(x, pa.list_(pa.int64())) for x in columns[5:]],
                    fps,
                ],
                names=["doc_id", "host", "text_key", *COUNTS, "hashes", "sizes", "fp"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_keys(), "text")
    schema = "doc_id long, host string, text_key binary, " + ", ".join(f"{c} long" for c in COUNTS)
    return checkpointed(rows.mapInArrow(run, schema + ", hashes array<long>, sizes array<long>, fp long"))


def _keys() -> list:
    """A null host is the host with the empty name; the key of a null text is the empty text's."""
    return [
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"),
        F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("text_key"),
    ]


def _above(counted: DataFrame, hosts: DataFrame, limits: LineLimits) -> DataFrame:
    """(host, h) of the lines with more rows in ``counted`` than the limits allow."""
    return (
        counted.groupBy("host", "h")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > limits.min_docs)
        .join(hosts, "host")
        .where(F.col("n") > limits.min_share * F.col("docs"))
        .select("host", "h")
    )


def _frequent_lines(measured: DataFrame, limits: LineLimits) -> tuple[DataFrame, DataFrame]:
    """Lines of distinct texts (host, text_key, h, size) above the limits by a plain count, and (host, h) of
    those above them by groups."""
    # Written once: it is read for the hosts, the counts and the lines above the limits.
    texts = checkpointed(measured.dropDuplicates(["host", "text_key"]).select("host", "text_key", "hashes", "sizes", "fp"))
    lines = texts.select("host", "text_key", F.explode(F.arrays_zip("hashes", "sizes")).alias("x")).select(
        "host", "text_key", F.col("x.hashes").alias("h"), F.col("x.sizes").alias("size")
    )
    hosts = checkpointed(texts.groupBy("host").agg(F.count("*").alias("docs")))
    frequent = checkpointed(_above(lines, hosts, limits))
    held = checkpointed(lines.join(frequent, ["host", "h"]).select("host", "text_key", "h", "size"))
    if limits.near is None:
        return held, frequent
    # A line is in no more groups than texts, so only these lines and the texts with them matter.
    own = held.select("host", "text_key").distinct()
    fps = checkpointed(texts.select("host", "text_key", "fp").join(own, ["host", "text_key"]))
    del texts, lines
    release(measured.sparkSession)
    linked = roots(fps.select("fp").distinct(), limits.near, halves=True)
    grouped = fps.join(linked, F.col("fp") == F.col("node"), "left")
    grouped = checkpointed(grouped.select("host", "text_key", F.coalesce("root", "fp").alias("root")))
    counted = held.join(grouped, ["host", "text_key"]).select("host", "root", "h").distinct()
    return held, _above(counted, hosts, limits)


def judged(docs: DataFrame, limits: LineLimits = LineLimits()) -> DataFrame:
    """Per row of ``docs``: doc_id, host, text_key, the counts, base_failed, removed_words,
    removed (hashes of the lines to remove) and kept.

    Null texts count as empty (base_failed); null hosts are one host; repeated rows and equal
    texts of a host get the same verdict; an empty table gives an empty result; extra columns
    are ignored. A hot host, line or text is counted with map-side partial sums.
    """
    measured = _measured(docs, limits)
    lines, frequent = _frequent_lines(measured, limits)
    # Aggregates are written before they are joined: a join of two plain shuffles can be split
    # where a host, line or text is hot, one that reuses the shuffle of an aggregate can't.
    removed = checkpointed(
        lines.join(checkpointed(frequent), ["host", "h"])
        .groupBy("host", "text_key")
        .agg(F.sum("size").alias("removed_words"), F.collect_list("h").alias("removed"))
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("removed_words", F.lit(0))
    return (
        measured.drop("hashes", "sizes", "fp")
        .join(removed, ["host", "text_key"], "left")
        .withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (left >= limits.min_kept * F.col("n_words")))
    )


def quality_rules(docs: DataFrame, limits: LineLimits = LineLimits()) -> DataFrame:
    """Per row: doc_id, the counts, base_failed, removed_words, kept (see ``judged``)."""
    return judged(docs, limits).select("doc_id", *COUNTS, "base_failed", "removed_words", "kept")


def drop_lines(text: str, removed: set[int]) -> str:
    """The text without its lines whose hash is in ``removed``."""
    return "\n".join([x for x in text.split("\n") if not (x.encode().split() and line_hash(x) in removed)])


def cleaned(docs: DataFrame, limits: LineLimits = LineLimits()) -> DataFrame:
    """The kept rows of ``docs``, all columns, with lines above the limits removed from ``text``.

    ``n_chars``, if there is one, is set to the new length where a text changed.
    """
    host, key, own_host, own_key, removed = unused(docs, "_host", "_key", "_own_host", "_own_key", "_removed")
    verdicts = checkpointed(  # as above: texts with many copies
        judged(docs, limits)
        .where("kept")
        .dropDuplicates(["host", "text_key"])
        .select(F.col("host").alias(host), F.col("text_key").alias(key), F.col("removed").alias(removed))
    )
    rows = docs.select("*", *[c.alias(n) for c, n in zip(_keys(), (own_host, own_key))])
    rows = rows.join(verdicts, (F.col(own_host) == F.col(host)) & (F.col(own_key) == F.col(key)))
    names, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            marks = batch.column(removed).to_pylist()
            out = {n: batch.column(n) for n in names}
            if any(marks):
                texts = batch.column("text").to_pylist()
                new = [drop_lines(t, set(m)) if m else t for t, m in zip(texts, marks)]
                out["text"] = pa.array(new, out["text"].type)
                if "n_chars" in out:
                    old = out["n_chars"].to_pylist()
                    size = [len(t) if m else n for t, m, n in zip(new, marks, old)]
                    out["n_chars"] = pa.array(size, out["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(out.values()), names=names)

    return rows.select(*names, removed).mapInArrow(run, schema)
