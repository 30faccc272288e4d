"""Quality classifier: a byte-level convolutional network in numpy.

Each byte has a learned vector; learned filters look at WIDTH bytes at every STRIDE-th byte of
the whole text. The text is seen as chunks of 2 * HALF bytes that overlap by half; a filter's
largest response in a chunk is the chunk's feature. A text's features are each filter's mean
and maximum over its chunks, and one logistic layer combines them into a probability. Chunk
maxima come from the maxima of half chunks, so the overlap costs nothing, and a text of any
length is worked off block by block.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from faultbench.llm.common import sliced, strings, unused

EMBED, WIDTH, STRIDE, FILTERS, HALF = 6, 8, 4, 24, 256
#: Half chunks whose responses are computed at a time.
BLOCK = 4096
PAD = 32


@dataclass(frozen=True)
class Training:
    """The bounded sample and the schedule: at most ``rows`` labelled texts, half of each label,
    the first by a hash of the id; texts of over ``max_bytes`` bytes are left out of it. A small
    sample is gone through until ``least_steps`` batches have been learnt from."""

    rows: int = 3000
    max_bytes: int = 32_768
    epochs: int = 6
    least_steps: int = 1500
    batch: int = 16
    rate: float = 0.01
    seed: int = 7


def _padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, each text filled up to whole half chunks; half chunks of each text (1 at least)."""
    halves = np.array([max(1, -(-len(t) // HALF)) for t in texts])
    data = b"".join([t + bytes([PAD]) * (n * HALF - len(t)) for t, n in zip(texts, halves.tolist())])
    return np.frombuffer(data + bytes([PAD]) * WIDTH, np.uint8), halves


def _windows(data: np.ndarray, start: int, n: int, embed: np.ndarray) -> np.ndarray:
    """The embedded windows of half chunks ``start`` to ``start + n``, a row each."""
    part = embed[data[start * HALF : (start + n) * HALF + WIDTH]]
    step = part.strides[0]
    view = np.lib.stride_tricks.as_strided(part, (n * HALF // STRIDE, WIDTH * EMBED), (step * STRIDE, part.strides[1]))
    return np.ascontiguousarray(view)


class Network:
    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.p = {
            "embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
            "filter": rng.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32),
            "shift": np.zeros(FILTERS, np.float32),
            "out": rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
            "bias": np.zeros(1, np.float32),
        }

    def features(self, texts: list[bytes]) -> np.ndarray:
        """Mean and maximum of each filter over each text's chunks."""
        data, halves = _padded(texts)
        per = HALF // STRIDE
        best = np.concatenate(
            [
                (_windows(data, i, min(BLOCK, halves.sum() - i), self.p["embed"]) @ self.p["filter"])
                .reshape(-1, per, FILTERS)
                .max(axis=1)
                for i in range(0, int(halves.sum()), BLOCK)
            ]
        )
        best = np.maximum(best + self.p["shift"], 0)
        return _pooled(best, halves)[0]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        z = self.features(texts).astype(np.float64) @ self.p["out"] + self.p["bias"][0]
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    def step(self, texts: list[bytes], labels: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weighted logistic loss."""
        data, halves = _padded(texts)
        n, per = int(halves.sum()), HALF // STRIDE
        seen = _windows(data, 0, n, self.p["embed"])
        raw = (seen @ self.p["filter"]).reshape(n, per, FILTERS)
        where = raw.argmax(axis=1)
        best = np.maximum(np.take_along_axis(raw, where[:, None], 1)[:, 0] + self.p["shift"], 0)
        feats, back = _pooled(best, halves)
        z = feats @ self.p["out"] + self.p["bias"][0]
        dz = ((1 / (1 + np.exp(-np.clip(z, -60, 60))) - labels) * weights / weights.sum()).astype(np.float32)
        d_best = back(dz[:, None] * self.p["out"][None, :]) * (best > 0)
        rows = (np.arange(n)[:, None] * per + where).ravel()
        cols = np.tile(np.arange(FILTERS), n)
        used = np.flatnonzero(d_best.ravel())
        rows, cols, d = rows[used], cols[used], d_best.ravel()[used]
        d_filter = np.zeros_like(self.p["filter"])
        d_embed = np.zeros_like(self.p["embed"])
        for f in range(FILTERS):
            own = cols == f
            d_filter[:, f] = d[own] @ seen[rows[own]]
            at = data[(rows[own] * STRIDE)[:, None] + np.arange(WIDTH)].ravel()
            grad = (d[own][:, None] * self.p["filter"][:, f]).reshape(-1, EMBED)
            for k in range(EMBED):
                d_embed[:, k] += np.bincount(at, grad[:, k], 256)
        return {"embed": d_embed, "filter": d_filter, "shift": d_best.sum(0), "out": dz @ feats, "bias": dz.sum(keepdims=True)}

    def fit(self, texts: list[bytes], labels: np.ndarray, how: Training) -> Network:
        """Adam over shuffled small batches; both labels weigh the same in all."""
        rng = np.random.default_rng(how.seed)
        share = labels.mean()
        if not 0 < share < 1:  # one label only: answer with it
            self.p["out"][:] = 0
            self.p["bias"][:] = 4 if share == 1 else -4
            return self
        weights = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        batches = -(-len(texts) // how.batch)
        epochs = max(how.epochs, -(-how.least_steps // batches))
        steps, t = epochs * batches, 0
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for i in range(0, len(texts), how.batch):
                own = order[i : i + how.batch]
                t += 1
                rate = how.rate * (1 - (t - 1) / steps)
                for k, g in self.step([texts[j] for j in own], labels[own], weights[own]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        return self


def _pooled(best: np.ndarray, halves: np.ndarray):
    """Features of each text from its half-chunk maxima, and the way back for gradients."""
    starts = np.cumsum(halves) - halves
    last = starts + halves - 1
    after = np.minimum(np.arange(len(best)) + 1, np.repeat(last, halves))  # a last half is a chunk of its own
    first_wins = best >= best[after]
    chunk = np.where(first_wins, best, best[after])
    # Chunks: each half with the next one; the last only where it is the only half.
    real = np.ones(len(best), bool)
    real[last[halves > 1]] = False
    n = np.maximum(halves - 1, 1)
    weight = (real / np.repeat(n, halves)).astype(np.float32)[:, None]
    mean = np.add.reduceat(chunk * weight, starts)
    top = np.maximum.reduceat(best, starts)

    def back(d: np.ndarray) -> np.ndarray:
        d_chunk = np.repeat(d[:, :FILTERS], halves, axis=0) * weight
        out = np.where(first_wins, d_chunk, 0)
        np.add.at(out, after, np.where(first_wins, 0, d_chunk))
        is_top = best == np.repeat(top, halves, axis=0)
        ties = np.add.reduceat(is_top, starts, dtype=np.float32)
        return out + is_top * np.repeat(d[:, FILTERS:] / ties, halves, axis=0)

    return np.concatenate([mean, top], axis=1), back


def held_out(doc_id: str = "doc_id"):
    """Whether the crc32 of the id's text leaves 2 when divided by 4; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, how: Training = Training()) -> Network:
    """A network fitted to ``labels.quality`` on a bounded sample, in one task; the driver gets
    its weights alone. Rows that ``held_out`` names, null labels and other label values take no part."""
    marked = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_y")).where(
        F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & ~held_out("_id")
    )
    known = marked.groupBy("_id").agg(F.min("_y").alias("_y"))
    good, bad = (
        known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(how.rows // 2) for y in (1, 0)
    )
    fitting = docs.select(F.col("doc_id").alias("_d"), "text").where(
        F.coalesce(F.octet_length("text"), F.lit(0)) <= how.max_bytes
    )
    # Ids and labels only, how.rows of them at most, whatever the size of the tables.
    chosen = F.broadcast(good.union(bad))
    sample = fitting.join(chosen, F.col("_d") == F.col("_id")).select("_id", "_y", "text", F.lit(1).alias("_all"))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_id", "text"], na_position="first").drop_duplicates("_id")
        texts = [(t or "").encode() for t in rows["text"]]
        net = Network(how.seed).fit(texts, rows["_y"].to_numpy(np.float32), how)
        return pd.DataFrame({"weights": [pickle.dumps(net.p)]})

    found = sample.groupBy("_all").applyInPandas(fit, "weights binary").collect()
    net = Network(how.seed)
    if found:
        net.p = pickle.loads(found[0].weights)
    else:  # no labelled row: every text is as likely as not
        net.p["out"][:] = 0
    return net


def score(
    docs: DataFrame, net: Network, threshold: float = 0.7, names: tuple[str, str] = ("_score", "_predicted")
) -> DataFrame:
    """All columns of ``docs``, then the score and the prediction (1 if the score reaches the
    threshold) under ``names``, which docs must not have.

    Every whole text is scored; null texts count as empty, an empty text as one blank chunk.
    There is no shuffle.
    """
    weights = net.p
    if unused(docs, *names) != list(names):
        raise ValueError(f"docs has a column {names}")
    columns = docs.columns
    schema = StructType([*docs.schema, StructField(names[0], DoubleType()), StructField(names[1], IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network()
        own.p = weights
        for batch in sliced(batches, rows=256):
            s = np.round(own.scores([t.encode() for t in strings(batch)]), 6)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())],
                names=[*columns, *names],
            )

    return docs.mapInArrow(run, schema)


def accepted(docs: DataFrame, net: Network, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches the threshold."""
    names = tuple(unused(docs, "_score", "_predicted"))
    return score(docs, net, threshold, names).where(F.col(names[1]) == 1).select(*docs.columns)
