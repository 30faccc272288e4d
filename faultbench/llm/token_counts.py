"""Byte-level BPE by rank-synchronous array merging.

A batch of pre-tokens is held as ragged arrays (all symbols in one array, a length for each
pre-token). In each round every pre-token finds the lowest rank among its adjacent pairs and
merges that pair wherever it stands, all pre-tokens at once; pre-tokens without a known pair
leave the batch. What survives are the tokens. Ranks of pairs come from an open-addressing
table in numpy; after a round only pairs beside a merged symbol are looked up again.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from faultbench.llm.common import sliced
from faultbench.llm.pretokens import WHITE, pieces, pretokens

NONE = np.int32(2**31 - 1)
#: Pieces that a Python worker remembers, and the longest remembered one.
MEMORY = 1_000_000
LONGEST = 256
#: Pieces whose ids are merged or gathered at a time; it bounds the arrays in between, not results.
AT_ONCE = 65_536
#: Rows and text bytes that are encoded at a time; longer texts are encoded alone.
BATCH_ROWS, BATCH_BYTES = 16_384, 16 << 20


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class PairTable:
    """Ranks of symbol pairs, by open addressing."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, np.iinfo(np.uint64).max, dtype=np.uint64)
        self.ranks = np.full(1 << self.bits, NONE, dtype=np.int32)
        todo, slot, self.probes = np.arange(len(keys)), self._slot(keys), 0
        while len(todo):
            free = self.ranks[slot] == NONE
            first = np.zeros(len(todo), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]], self.ranks[slot[put]] = keys[todo[put]], todo[put]
            todo, slot = todo[~put], (slot[~put] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = self._slot(keys)
        found = np.where(self.keys[slot] == keys, self.ranks[slot], NONE)
        open_ = np.flatnonzero((found == NONE) & (self.ranks[slot] != NONE))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            at = slot[open_]
            hit = self.keys[at] == keys[open_]
            found[open_[hit]] = self.ranks[at[hit]]
            open_ = open_[~hit & (self.ranks[at] != NONE)]
        return found


class ByteBPE:
    """The byte-level vocabulary of a tokenizer file (``.json``)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.first = np.array([vocab[c] for c in byte_alphabet()], dtype=np.int32)
        pairs = spec["model"]["merges"]
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        self.table = PairTable(
            np.array([vocab[a] for a, _ in pairs], dtype=np.int64), np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        )

    def merge(self, data: bytes, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in one array, and the end of each word in it.

        The words stand in ``data`` one after another, each of ``lens`` bytes.
        """
        sym = self.first[np.frombuffer(data, dtype=np.uint8)]
        counts = np.zeros(len(lens), dtype=np.int64)
        rows = np.flatnonzero(lens)
        lens = lens[rows]
        done_rows, done_lens, done_sym = [], [], []
        rank = self._ranks(sym, lens)
        while len(rows):
            starts = np.cumsum(lens) - lens
            lowest = np.minimum.reduceat(rank, starts)
            live = lowest != NONE
            if not live.all():
                keep = np.repeat(live, lens)
                done_rows.append(rows[~live])
                done_lens.append(lens[~live])
                done_sym.append(sym[~keep])
                sym, rank, rows, lens, lowest = sym[keep], rank[keep], rows[live], lens[live], lowest[live]
                if not len(rows):
                    break
            at = np.flatnonzero(rank == np.repeat(lowest, lens))
            if len(at) > 1 and (np.diff(at) == 1).any():  # a pair of twins overlaps itself: take every other
                fresh = np.r_[True, np.diff(at) != 1]
                begin = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - begin) % 2 == 0]
            sym[at] = self.merged[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            ends = np.cumsum(lens)
            lens = lens - (np.searchsorted(at, ends) - np.searchsorted(at, ends - lens))
            sym, rank = sym[keep], rank[keep]
            at = at - np.arange(len(at))  # one symbol fewer for each merge before
            self._again(sym, rank, at, np.cumsum(lens) - 1)
        if not done_rows:
            return np.zeros(0, np.int32), counts
        rows, lens = np.concatenate(done_rows), np.concatenate(done_lens)
        counts[rows] = lens
        ends = np.cumsum(counts)
        out = np.empty(int(ends[-1]), dtype=np.int32)
        begin = (ends - counts)[rows]
        shift = np.repeat(begin - (np.cumsum(lens) - lens), lens)
        out[np.arange(len(shift)) + shift] = np.concatenate(done_sym)
        return out, ends

    def _ranks(self, sym: np.ndarray, lens: np.ndarray) -> np.ndarray:
        rank = np.full(len(sym), NONE, dtype=np.int32)
        if len(sym) > 1:
            rank[:-1] = self.table.find(sym[:-1], sym[1:])
        rank[np.cumsum(lens) - 1] = NONE
        return rank

    def _again(self, sym: np.ndarray, rank: np.ndarray, at: np.ndarray, last: np.ndarray) -> None:
        """Look up the pairs that merged symbols at ``at`` are part of; ``last``: ends of rows."""
        right = at[at < len(sym) - 1]
        rank[at] = NONE
        rank[right] = self.table.find(sym[right], sym[right + 1])
        left = at[at > 0] - 1
        rank[left] = self.table.find(sym[left], sym[left + 1])
        rank[last] = NONE


class ByteEncoder:
    """Ids of whole texts, many texts at a time.

    Arrow splits the texts at spaces and numbers their distinct pieces; only pieces that are not
    remembered are merged, and ids or counts of the texts are then taken by number. The memory
    is one dictionary into one array of ids; when it is full, pieces that were met in most calls stay.
    """

    def __init__(self, path: str, memory: int = MEMORY):
        self.bpe, self.memory = ByteBPE(path), memory
        self.known: dict[str, int] = {}
        self._empty()

    def _empty(self) -> None:
        self.begin, self.size, self.uses = (np.zeros(0, np.int64) for _ in range(3))
        self.ids = np.zeros(0, np.uint32)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian uint32 bytes."""
        ids, counts = self.encode_flat(pa.array(texts, pa.string()))
        out, ends = ids.astype("<u4").tobytes(), (np.cumsum(counts) * 4).tolist()
        return [out[a:b] for a, b in zip([0, *ends], ends)]

    def encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the number of ids of each text. Null: empty."""
        number, of_text = self._pieces(texts)
        size = self.size[number]
        ids, at = np.empty(int(size.sum()), np.uint32), 0
        for i in range(0, len(number), AT_ONCE):
            own = size[i : i + AT_ONCE]
            ends = np.cumsum(own)
            shift = np.repeat(self.begin[number[i : i + AT_ONCE]] - (ends - own), own)
            shift += np.arange(len(shift))
            ids[at : at + len(shift)] = self.ids[shift]
            at += len(shift)
        counts = self._per_text(size, of_text, len(texts))
        self._forget()
        return ids, counts

    def counts(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text. Null: none."""
        number, of_text = self._pieces(texts)
        counts = self._per_text(self.size[number], of_text, len(texts))
        self._forget()
        return counts

    @staticmethod
    def _per_text(size: np.ndarray, of_text: np.ndarray, texts: int) -> np.ndarray:
        """Sums of ``size`` over each text's pieces; ``of_text``: the number of pieces before each text's end."""
        total = np.append(0, np.cumsum(size))
        return np.diff(total[np.append(0, of_text)])

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers in memory of the pieces of all texts, and how many pieces stand before each text's end."""
        texts = pc.fill_null(texts, "")
        special = np.zeros(len(texts), bool)
        for word in self.bpe.specials:
            special |= pc.match_substring(texts, word).to_numpy(zero_copy_only=False)
        split = pc.split_pattern(texts, " ")
        stops = split.offsets.to_numpy().astype(np.int64)
        stops -= stops[0]
        values = split.flatten().dictionary_encode()
        number, distinct = values.indices.to_numpy(), values.dictionary.to_pylist()
        # A space before white space is no cut: texts with such a piece are cut again by the rule.
        odd = np.fromiter((not x or x[0] in WHITE for x in distinct), bool, len(distinct))
        broken = odd[number]
        broken[stops[:-1]] = False
        special |= np.diff(np.append(0, np.cumsum(broken))[stops]) > 0
        number = self._remembered(["" if o else x for o, x in zip(odd.tolist(), distinct)])[number]
        if len(texts):
            first = values.take(pa.array(stops[:-1])).cast(pa.string()).to_pylist()
            number[stops[:-1]] = self._remembered([x and " " + x for x in first])
        at = np.flatnonzero(special)
        if not len(at):
            return number, stops[1:]
        cut = [self._cut(x) for x in texts.take(pa.array(at)).to_pylist()]
        sizes = np.diff(stops)
        plain = number[np.repeat(~special, sizes)]
        sizes[at] = [len(x) for x in cut]
        # Pieces stand text by text: those cut again, then the others; put them in their texts' order.
        order = np.append(at, np.flatnonzero(~special))
        begin = np.zeros(len(texts), np.int64)
        begin[order] = np.cumsum(sizes[order]) - sizes[order]
        stops = np.cumsum(sizes)
        shift = np.repeat(begin - (stops - sizes), sizes)
        return np.append(self._remembered([y for x in cut for y in x]), plain)[shift + np.arange(len(shift))], stops

    def _cut(self, text: str) -> list[str]:
        """Pieces of one text by the rule, as ``_remembered`` takes them."""
        out = []
        for i, part in enumerate(self._special.split(text)) if self._special else [(0, text)]:
            if i % 2:
                out.append("\n" + part)
            elif part:
                first, *rest = pieces(part)
                out += [" " + first, *rest] if first else rest
        return out

    @cached_property
    def _special(self) -> re.Pattern | None:
        each = sorted(self.bpe.specials, key=len, reverse=True)
        return re.compile("(" + "|".join(map(re.escape, each)) + ")") if each else None

    def _remembered(self, some: list[str]) -> np.ndarray:
        """Numbers in memory of pieces.

        A piece after a space stands without it; a text's first piece has a space in front here, which no
        piece after a space begins with, nor with "\n", which marks a special string. An empty piece has no ids.
        """
        known = self.known
        new = list(dict.fromkeys([x for x in some if x not in known]))
        for i in range(0, len(new), AT_ONCE):
            self._learn(new[i : i + AT_ONCE])
        number = np.fromiter(map(known.__getitem__, some), np.int64, len(some))
        self.uses[number] += 1
        return number

    def _learn(self, new: list[str]) -> None:
        self._add([x for x in new if not x], np.zeros(0, np.uint32), np.zeros(int("" in new), np.int64))
        marked = [x for x in new if x[:1] == "\n"]
        self._add(marked, np.array([self.bpe.specials[x[1:]] for x in marked], np.uint32), np.ones(len(marked), np.int64))
        # Letters only: the piece and the space before it are one pre-token.
        plain = [p for p in new if p.isalpha()]
        data = "".join([" " + p for p in plain]).encode()
        starts = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
        ids, ends = self.bpe.merge(data, np.diff(np.r_[starts, len(data)]))
        self._add(plain, ids, np.diff(np.append(0, ends)))
        first = [p for p in new if p[:1] == " "]
        rest = [p for p in new if p and p[0] not in " \n" and not p.isalpha()]
        words, sizes = [], []
        for piece in first:
            own = pretokens(piece[1:])
            words += own
            sizes.append(len(own))
        # Spaces in front of a visible character are the pieces' own starts, so one scan cuts them all.
        joined = pretokens(" " + " ".join(rest)) if rest else []
        begins = [i for i, w in enumerate(joined) if w[0] == " " and len(w) > 1 and w[1] not in WHITE]
        words += joined
        sizes = np.append(np.array(sizes, np.int64), np.diff(np.array([*begins, len(joined)])))
        index: dict[str, int] = {}
        number = np.array([index.setdefault(w, len(index)) for w in words], np.int64)
        each = [w.encode() for w in index]
        ids, ends = self.bpe.merge(b"".join(each), np.fromiter(map(len, each), np.int64, len(each)))
        size = np.diff(np.append(0, ends))[number]
        shift = np.repeat((np.append(0, ends)[:-1])[number] - (np.cumsum(size) - size), size)
        total = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(sizes))]
        self._add(first + rest, ids[shift + np.arange(len(shift))], np.diff(total))

    def _add(self, some: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        if some:
            self.known.update(zip(some, range(len(self.size), len(self.size) + len(some))))
            self.begin = np.append(self.begin, len(self.ids) + np.cumsum(size) - size)
            self.size = np.append(self.size, size)
            self.uses = np.append(self.uses, np.zeros(len(some), np.int64))
            self.ids = np.append(self.ids, ids.astype(np.uint32))

    def _forget(self) -> None:
        """Keep pieces met in two calls at least, and none that is long; of more than half the memory, those met oftenest."""
        long = len(self.ids) > 16 * self.memory
        if len(self.size) <= self.memory and not long:
            return
        uses, half = self.uses, self.memory // 2
        least = max(1, -np.partition(-uses, half)[half]) if len(uses) > half else 1
        often = (uses > least).tolist()
        kept = {p: i for p, i in self.known.items() if often[i] and len(p) <= LONGEST}
        at = np.fromiter(kept.values(), np.int64, len(kept))
        begin, size = self.begin[at], self.size[at]
        shift = np.repeat(begin - (np.cumsum(size) - size), size)
        ids = self.ids[shift + np.arange(len(shift))]
        self.known = {}
        self._empty()
        self._add(list(kept), ids, size)


_encoders: dict[tuple[str, int], ByteEncoder] = {}


def encoder(path: str, memory: int = MEMORY) -> ByteEncoder:
    """The worker's encoder of a vocabulary file, kept between tasks."""
    if (path, memory) not in _encoders:
        _encoders[path, memory] = ByteEncoder(path, memory)
    return _encoders[path, memory]


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null texts count as empty (0 tokens); null doc_ids, repeated rows and extra columns pass
    through one by one; an empty table gives an empty result. There is no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in sliced(batches, rows=BATCH_ROWS, size=BATCH_BYTES):
            n = enc.counts(batch.column("text"))
            size = pc.fill_null(pc.binary_length(batch.column("text")), 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), size.cast(pa.int64()), pa.array(n), pa.array(n > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
