"""Personal data by patterns and a skip-chain conditional random field.

The base spans come from fixed patterns with checks. The field then labels the document's
candidate tokens (those with a digit or an @): neighbouring tokens share a chain potential, and
tokens that are equal or similar (same text, same digits, same local part of an address), how-
ever far apart, share a skip potential, also each with the nearest one in a base span. Loopy
message passing carries what the base spans know
to the other mentions, so that one number is personal data everywhere in a document or nowhere.
Weights are learnt by pseudo-likelihood from a bounded sample, with base spans as labels.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultbench.llm.common import sliced, strings

KINDS = ["email", "ip", "card", "phone"]
LABELS = len(KINDS) + 1  # 0: none
CLAMP = 8.0
#: Messages that change by no more are settled; and the rounds after which unsettled ones end.
SETTLED, MOST_ROUNDS = 1e-6, 1000

_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits does: within a run, all begins end alike.
_ip = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_card = re.compile(r"[0-9](?:[ -]?[0-9])+")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_not_digit = re.compile(r"[^0-9]")
_sign = re.compile(r"[0-9@]")
_space = re.compile(r"\s")
_hex = re.compile(r"[0-9a-f]{24,}", re.I)


def _emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _local:
            start -= 1
        m = _domain.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) < 256


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the pattern matches, by kind and start; offsets in code points."""
    out = [(0, a, b) for a, b in _emails(text)]
    out += [(1, *m.span()) for m in _ip.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _card.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _not_digit.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _phone.finditer(text) if 8 <= len(_not_digit.sub("", m[0])) <= 15]
    return out


def tokens(text: str) -> list[tuple[int, int]]:
    """White-space separated tokens that hold a digit or an @."""
    out, at = [], 0
    while m := _sign.search(text, at):
        i = m.start()
        start = i
        while start > at and not text[start - 1].isspace():
            start -= 1
        stop = _space.search(text, i)
        at = stop.start() if stop else len(text)
        out.append((start, at))
    return out


def _core(text: str, start: int, end: int) -> tuple[int, int]:
    """The token without punctuation around it; an opening + or bracket of a number stays."""
    while start < end and not (text[start].isalnum() or text[start] in "+("):
        start += 1
    while end > start and not (text[end - 1].isalnum() or text[end - 1] == ")"):
        end -= 1
    return start, end


FEATURES = 24


def _features(core: str) -> list[int]:
    """Numbers of the features that hold for a token; never which base pattern it matches."""
    digits = _not_digit.sub("", core)
    n, dots, letters = len(digits), core.count("."), any(c.isalpha() for c in core)
    on = [0, 1 + (0 if n == 0 else 1 if n < 4 else 2 if n < 7 else 3 if n < 10 else 4 if n < 16 else 5 if n < 20 else 6)]
    on.append(8 + min(dots, 4))
    for i, held in enumerate(
        (
            "@" in core,
            core[:1] == "+",
            "-" in core,
            "(" in core or ")" in core,
            letters,
            "=" in core or '"' in core,
            bool(_hex.search(core)),
            not letters and 16 <= n <= 19 and luhn(digits),
            dots == 3 and all(p.isdecimal() and p.isascii() and _small(p) for p in core.split(".")),
            n == len(core),
            len(core) > 40,
        )
    ):
        if held:
            on.append(13 + i)
    return on


def _keys(core: str) -> list[str]:
    """What makes two tokens equal or similar."""
    digits, low = _not_digit.sub("", core), core.lower()
    keys = [f"w{low}"] if len(low) >= 4 else []
    if 7 <= len(digits) <= 19 and not any(c.isalpha() for c in low):
        keys += [f"d{digits}", f"t{digits[-7:]}"]
    if "@" in low:
        local = low.partition("@")[0]
        if len(local) >= 4 and any(c.isdigit() for c in local):
            keys.append(f"w{local}")
    return keys


@dataclass
class Graph:
    """Nodes and edges of many documents: feature matrix, base labels (0: none), and edges
    (i, j) by type: 0 neighbours in the text, 1 equal or similar and next to each other among
    those, 2 equal or similar to the nearest token of a base span (no training edge)."""

    x: np.ndarray
    base: np.ndarray
    edges: np.ndarray
    types: np.ndarray
    cores: list[tuple[int, int, int]]  # document, start, end


def graph(texts: list[str], spans: list[list[tuple[int, int, int]]]) -> Graph:
    feats, base, cores, edges = [], [], [], []
    links = set()
    for d, (text, own) in enumerate(zip(texts, spans)):
        marked = sorted((a, b, k) for k, a, b in own)
        at, last_end, seen = 0, -2, {}
        mentions: dict[str, list[int]] = {}
        longest: list[int] = []  # furthest end of the spans so far
        for a, b, _ in marked:
            longest.append(max(b, longest[-1] if longest else 0))
        for start, end in tokens(text):
            a, b = _core(text, start, end)
            if a == b:
                continue
            while at < len(marked) and longest[at] <= a:
                at += 1
            label = next((k + 1 for x, y, k in marked[at : at + 4] if x < b and y > a), 0)
            i = len(cores)
            core = text[a:b]
            feats.append(_features(core))
            base.append(label)
            cores.append((d, a, b))
            if start - last_end == 1:
                edges.append((i - 1, i, 0))
            for key in dict.fromkeys(_keys(core)):
                if key in seen:
                    edges.append((seen[key], i, 1))
                seen[key] = i
                mentions.setdefault(key, []).append(i)
            last_end = end
        for own in mentions.values():
            links |= _to_nearest(own, base)
    x = np.zeros((len(cores), FEATURES), np.float32)
    for i, on in enumerate(feats):
        x[i, on] = 1
    edges += [(a, b, 2) for a, b in links - {(a, b) for a, b, t in edges if t == 1}]
    e = np.array(sorted(set(edges)), np.int64).reshape(-1, 3)
    return Graph(x, np.array(base, np.int64), e[:, :2], e[:, 2], cores)


def _to_nearest(nodes: list[int], base: list[int]) -> set[tuple[int, int]]:
    """Edges between each of the ascending ``nodes`` without base label and the nearest with one."""
    known = [i for i in nodes if base[i]]
    out, at = set(), 0
    for i in nodes if known else []:
        if not base[i]:
            while at + 1 < len(known) and abs(known[at + 1] - i) < abs(known[at] - i):
                at += 1
            out.add((min(i, known[at]), max(i, known[at])))
    return out


class SkipChain:
    """Weights: unary (features, labels), chain (label, next label), skip (label, label).

    Skip weights are drawn towards ``agreement`` on the diagonal, their prior: samples in which
    few tokens repeat say little about them.
    """

    def __init__(self, agreement: float = 4.0) -> None:
        self.unary = np.zeros((FEATURES, LABELS), np.float64)
        self.unary[0, 0] = 4.0  # untrained: nothing is personal data
        self.prior = agreement * np.eye(LABELS)
        self.pair = np.stack([np.zeros((LABELS, LABELS)), self.prior])

    def fit(self, g: Graph, steps: int = 300, rate: float = 0.5, decay: float = 1e-4) -> SkipChain:
        """Pseudo-likelihood: each token's base label given its features and its neighbours' labels."""
        n = len(g.base)
        if not n:
            return self
        one = np.eye(LABELS)[g.base]
        i, j = g.edges.T
        around = np.zeros((3, n, LABELS))  # labels before in the chain, after in the chain, over skips
        chain, skip = g.types == 0, g.types == 1
        np.add.at(around[0], j[chain], one[i[chain]])
        np.add.at(around[1], i[chain], one[j[chain]])
        np.add.at(around[2], j[skip], one[i[skip]])
        np.add.at(around[2], i[skip], one[j[skip]])
        x = np.concatenate([g.x, *around], axis=1)
        w = np.zeros((x.shape[1], LABELS))
        w[FEATURES + 2 * LABELS :] = self.prior
        prior = w.copy()
        weight = 1 / np.sqrt(np.bincount(g.base, minlength=LABELS)[g.base])
        weight /= weight.sum()
        v = np.zeros_like(w)
        for _ in range(steps):
            z = x @ w
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            grad = x.T @ ((p - one) * weight[:, None]) + decay * (w - prior)
            v = 0.9 * v + grad
            w -= rate * v
        self.unary = w[:FEATURES]
        before, after, over = (w[FEATURES + k * LABELS : FEATURES + (k + 1) * LABELS] for k in range(3))
        self.pair[0] = (before + after.T) / 2
        self.pair[1] = (over + over.T) / 2
        return self

    def marginals(self, g: Graph, rounds: int = 30, damping: float = 0.5) -> np.ndarray:
        """Label probabilities by loopy message passing, all messages of a round at once.

        After ``rounds`` rounds a document goes on until its own messages settle, so its result
        doesn't depend on its batch. Loops may keep messages from settling: MOST_ROUNDS ends them.
        """
        field = g.x @ self.unary
        known = np.flatnonzero(g.base)
        field[known] = 0
        field[known, g.base[known]] = CLAMP * 4
        i, j = g.edges.T
        m = len(i)
        src, dst = np.concatenate([i, j]), np.concatenate([j, i])
        back = np.concatenate([np.arange(m) + m, np.arange(m)])
        pair = self.pair[np.minimum(g.types, 1)]
        pot = np.concatenate([pair, pair.transpose(0, 2, 1)])
        msg = np.zeros((2 * m, LABELS))
        doc = np.array([d for d, *_ in g.cores], np.int64)[src] if m else src
        live = np.arange(2 * m)  # messages of the documents that go on
        for round_ in range(1, max(rounds, MOST_ROUNDS) + 1):
            if not len(live):
                break
            total = field.copy()
            np.add.at(total, dst[live], msg[live])
            out = (total[src[live]] - msg[back[live]])[:, :, None] + pot[live]
            top = out.max(axis=1)
            new = top + np.log(np.exp(out - top[:, None, :]).sum(axis=1))
            new = np.clip(new - new.max(axis=1, keepdims=True), -CLAMP * 4, 0)
            new = damping * msg[live] + (1 - damping) * new
            if round_ >= rounds:
                change = np.zeros(doc.max() + 1)
                np.maximum.at(change, doc[live], np.abs(new - msg[live]).max(axis=1))
                msg[live] = new
                live = live[change[doc[live]] > SETTLED]
            else:
                msg[live] = new
        total = field.copy()
        np.add.at(total, dst, msg)
        p = np.exp(total - total.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def find_spans(texts: list[str], model: SkipChain, sure: float = 0.95) -> list[list[tuple[int, int, int, bool]]]:
    """For each text its spans (kind, start, end, base), by kind and start."""
    spans = [base_spans(t) for t in texts]
    out = [[(k, a, b, True) for k, a, b in own] for own in spans]
    g = graph(texts, spans)
    if not len(g.base):
        return out
    p = model.marginals(g)
    label = np.where(g.base > 0, 0, np.where(p.max(axis=1) >= sure, p.argmax(axis=1), 0))
    chained = {(int(a), int(b)) for (a, b), t in zip(g.edges, g.types) if t == 0}
    last = -2
    for i in np.flatnonzero(label).tolist():
        d, a, b = g.cores[i]
        own, kind = out[d], int(label[i]) - 1
        if last == i - 1 and label[last] == label[i] and (last, i) in chained:
            k, x, _, base = own.pop()
            own.append((k, x, b, base))
        else:
            own.append((kind, a, b, False))
        last = i
    return [sorted(own) for own in out]


@dataclass(frozen=True)
class Sample:
    """At most ``rows`` documents with a base span, the first by a hash of text and id, none over
    ``max_chars`` characters, teach the weights."""

    rows: int = 2000
    max_chars: int = 50_000


def train(docs: DataFrame, how: Sample = Sample()) -> SkipChain:
    """The field's weights from a bounded sample of ``docs``; the driver gets only the weights."""
    text = F.col("text")
    # Broader than the patterns, and cheap: which rows can hold a span at all.
    some = docs.select("doc_id", "text").where(
        (F.length(text) <= how.max_chars) & text.rlike(r"@[A-Za-z0-9-]|\+[0-9]|[0-9]\.[0-9]+\.[0-9]+\.[0-9]|[0-9][0-9 -]{14}[0-9]")
    )
    first = some.select(F.xxhash64("text", "doc_id").alias("_h")).distinct().orderBy("_h").limit(how.rows)
    rows = some.withColumn("_h", F.xxhash64("text", "doc_id")).join(F.broadcast(first), "_h").select("_h", "text", F.lit(1).alias("_all"))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        texts = frame.drop_duplicates("_h").sort_values("_h")["text"].tolist()
        model = SkipChain().fit(graph(texts, [base_spans(t) for t in texts]))
        return pd.DataFrame({"unary": [model.unary.tobytes()], "pair": [model.pair.tobytes()]})

    model = SkipChain()
    for row in rows.groupBy("_all").applyInPandas(fit, "unary binary, pair binary").collect():
        model.unary = np.frombuffer(row.unary).reshape(FEATURES, LABELS)
        model.pair = np.frombuffer(row.pair).reshape(2, LABELS, LABELS)
    return model


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def personal_spans(docs: DataFrame, model: SkipChain, sure: float = 0.95) -> DataFrame:
    """Rows (doc_id, spans): every whole text's spans, by kind (as in KINDS) and start.

    Null texts count as empty (no spans); null doc_ids, repeated rows and extra columns pass
    through one by one; an empty table gives an empty result. There is no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = find_spans(strings(batch), model, sure)
            rows = [[{"kind": KINDS[k], "start": a, "end": b, "base": s} for k, a, b, s in own] for own in found]
            kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(rows, pa.list_(kind))], names=["doc_id", "spans"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, spans {SPANS}")


def digests(found: DataFrame) -> DataFrame:
    """Counts and digests of the spans that ``personal_spans`` gives."""
    spans = F.col("spans")

    def shown(of: Column) -> Column:
        return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter(spans, lambda s: s.base)
    return found.select(
        "doc_id",
        *map(number, KINDS),
        F.sha2(shown(base), 256).alias("base_sha256"),
        shown(spans).alias("spans"),
    )


def mask(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    """The text with every span's characters replaced by its kind in brackets; spans that overlap
    become one, named after the first."""
    out, end = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b, _ in spans):
        if a >= end:
            out += [text[end:a], f"[{KINDS[k].upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def masked(docs: DataFrame, model: SkipChain, sure: float = 0.95) -> DataFrame:
    """All columns of ``docs``, with the spans masked in ``text`` and ``n_chars``, if there is one,
    set to the new length where a text changed. Null texts stay null."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column("text").to_pylist()
            found = find_spans([t or "" for t in texts], model, sure)
            out = {n: batch.column(n) for n in names}
            new = [mask(t, s) if s else t for t, s in zip(texts, found)]
            out["text"] = pa.array(new, out["text"].type)
            if "n_chars" in out:
                old = out["n_chars"].to_pylist()
                out["n_chars"] = pa.array([len(t) if s else n for t, s, n in zip(new, found, old)], out["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(out.values()), names=names)

    return docs.mapInArrow(run, docs.schema)
