"""BPE encoding and decoding with word ends, by batched numpy merge rounds.

The symbols of many words lie in one flat array, words apart by a wall that is in no pair. A
round looks up every adjacent pair by binary search over the sorted pair keys, finds each
word's lowest rank, and merges that pair in all words together; words without a known pair
are taken out. Words met before are remembered. A word of thousands of letters would need thousands of
rounds over all of them: such a word keeps its pairs in a heap, by rank and place, and after a merge
only the two pairs beside it are looked up, among the same sorted keys.

Normalisation and pre-tokens follow the tokenizer file's pipeline: NFC, white-space runs to one
space, lower case letter by letter, then contractions, letter runs, single digits and runs of
anything else, with white space dropped. A tokenizer file without a decoder decodes to its
tokens joined by single spaces.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache, cached_property
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from faultbench.llm.common import sliced, strings
from faultbench.llm.pretokens import SPACE
from faultbench.llm.token_counts import byte_alphabet

WALL, NONE = -1, np.int64(2**62)
#: Words that a Python worker remembers, and the longest remembered one.
MEMORY, LONGEST = 300_000, 256
#: Bytes from which on a word is merged by itself, and bits of a place in it.
ALONE, PLACE = 4096, 40

# The words where only ASCII, Latin-1 and Latin Extended-A letters occur.
_latin = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-ſ]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\s0-9a-z\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xdf-\xf6\xf8-ſ]+")
_byte = {c: b for b, c in enumerate(byte_alphabet())}
_not_latin = re.compile("[^\t-\r\x20-ſ]")


def normalise(text: str) -> str:
    """NFC, then lower case one character at a time (so a final sigma stays a plain one)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


@cache
def _any() -> re.Pattern:
    """The tokenizer file's word pattern, with letters and numbers as this Python's Unicode has them."""

    def ranges(kind: str) -> str:
        own = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == kind]
        begins = [c for c, before in zip(own, [-9, *own]) if c != before + 1]
        ends = [c for c, after in zip(own, [*own[1:], -9]) if c != after - 1]
        return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(begins, ends))

    letters, numbers = ranges("L"), ranges("N")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{SPACE}{letters}{numbers}]+")


def words_of(text: str, library: Tokenizer) -> list[str]:
    """Words of a text; white space of any length only parts them.

    Characters newer than this Python's Unicode tables have a class in the library alone, so a
    text with one of them gets its words from the library's normaliser and pre-tokeniser.
    """
    low = normalise(text)
    if not _not_latin.search(low):
        return _latin.findall(low)
    if any(unicodedata.category(c) == "Cn" for c in set(text)):
        found = library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text))
        return [bytes(map(_byte.__getitem__, word)).decode() for word, _ in found]
    return _any().findall(low)


class WordBPE:
    """The vocabulary of a tokenizer file whose model marks word ends."""

    def __init__(self, path: str, memory: int = MEMORY):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.tokens = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) or r"(?!)")
        letters = byte_alphabet()
        self.first = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.last = np.array([vocab[c + end] for c in letters], dtype=np.int64)
        self.size = max(self.tokens) + 1
        pairs = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]], dtype=np.int64)
        keys = pairs[:, 0] * self.size + pairs[:, 1]
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.merged = keys[order], order, pairs[:, 2]
        self.memory, self.known = memory, {}

    def ranks(self, flat: np.ndarray) -> np.ndarray:
        """Rank of the pair that begins at each symbol; NONE before a wall and for unknown pairs."""
        left, right = flat[:-1], flat[1:]
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = (self.keys[at] == key) & (left != WALL) & (right != WALL)
        return np.append(np.where(known, self.rank[at], NONE), NONE)

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word. Every word of one merge round merges its own lowest pair."""
        out: list[list[int]] = [[] for _ in words]
        data = [w.encode() for w in words]
        for i, w in enumerate(data):
            if len(w) > ALONE:
                out[i] = self._merge_alone(w)
        here = np.array([i for i, w in enumerate(data) if 0 < len(w) <= ALONE], dtype=np.int64)
        if not len(here):
            return out
        raw = np.frombuffer(b"".join([data[i] + b"\0" for i in here]), dtype=np.uint8)
        flat = self.first[raw]
        ends = np.cumsum([len(data[i]) + 1 for i in here]) - 1  # the walls
        flat[ends - 1] = self.last[raw[ends - 1]]
        flat[ends] = WALL
        while len(here):
            rank = self.ranks(flat)
            starts = np.append(0, ends[:-1] + 1)
            lowest = np.minimum.reduceat(rank, starts)
            sizes = ends - starts + 1
            done = lowest == NONE
            if done.any():
                gone = np.repeat(done, sizes)
                ids, stop = flat[gone].tolist(), np.cumsum(sizes[done]).tolist()
                for i, a, b in zip(here[done].tolist(), [0, *stop], stop):
                    out[i] = ids[a : b - 1]
                flat, rank = flat[~gone], rank[~gone]
                here, sizes, lowest = here[~done], sizes[~done], lowest[~done]
                if not len(here):
                    break
            at = np.flatnonzero(rank == np.repeat(lowest, sizes))
            twin = np.diff(at) == 1
            if twin.any():  # x x x holds the pair x x twice over: count from the left
                begin = np.maximum.accumulate(np.where(np.append(True, ~twin), np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - begin) % 2 == 0]
            flat[at] = self.merged[rank[at]]
            stay = np.ones(len(flat), bool)
            stay[at + 1] = False
            flat = flat[stay]
            ends = np.flatnonzero(flat == WALL)
        return out

    def _merge_alone(self, word: bytes) -> list[int]:
        """Ids of one long word. A new pair's rank is above that of the merge that made it, so ranks only rise."""
        raw = np.frombuffer(word, np.uint8)
        flat = self.first[raw]
        flat[-1] = self.last[raw[-1]]
        rank = self.ranks(flat)
        at = np.flatnonzero(rank != NONE)
        heap = ((rank[at] << PLACE) | at).tolist()
        heapify(heap)
        sym, n, size = flat.tolist(), len(flat), self.size
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        keys, ranks, merged = self._lists
        last = len(keys)

        def find(left: int, right: int) -> int:
            key = left * size + right
            i = bisect_left(keys, key)
            return ranks[i] if i < last and keys[i] == key else -1

        while heap:
            x = heappop(heap)
            r, i = x >> PLACE, x & ((1 << PLACE) - 1)
            j = after[i]
            if sym[i] < 0 or j >= n or find(sym[i], sym[j]) != r:
                continue  # merged since
            sym[i], sym[j] = merged[r], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := find(sym[i], sym[k])) >= 0:
                    heappush(heap, r << PLACE | i)
            if (h := before[i]) >= 0 and (r := find(sym[h], sym[i])) >= 0:
                heappush(heap, r << PLACE | h)
        return [x for x in sym if x >= 0]

    @cached_property
    def _lists(self) -> tuple[list[int], list[int], list[int]]:
        return self.keys.tolist(), self.rank.tolist(), self.merged.tolist()

    def _learn(self, new: list[str]) -> None:
        for word, ids in zip(new, self.encode_words(new)):
            self.known[word] = (len(ids), " ".join(map(str, ids)), " ".join([self.tokens[i] for i in ids]))

    def encode(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """For each text: the number of ids, the decimal ids and the decoded text, space-joined."""
        cut: list[list[str]] = []
        for text in texts:
            own: list[str] = []
            start = 0
            for m in self.special.finditer(text):
                own += words_of(text[start : m.start()], self.library)
                own.append("\0" + m[0])  # no word of a text begins with this mark and goes on with letters
                start = m.end()
            own += words_of(text[start:] if start else text, self.library)
            cut.append(own)
        seen = set().union(*cut)
        if len(self.known) + len(seen) > self.memory:
            self.known = {w: self.known[w] for w in seen if w in self.known}
        marked = {"\0" + s: (1, str(i), s) for s, i in self.specials.items()}
        self._learn([w for w in seen if w not in self.known and w not in marked])
        known = self.known | marked if any(w in seen for w in marked) else self.known
        out = []
        for own in cut:
            each = [known[w] for w in own]
            out.append((sum([x[0] for x in each]), " ".join([x[1] for x in each]), " ".join([x[2] for x in each])))
        for w in [w for w in seen if len(w) > LONGEST]:
            self.known.pop(w, None)
        return out


_codecs: dict[str, WordBPE] = {}


def codec(path: str) -> WordBPE:
    if path not in _codecs:
        _codecs[path] = WordBPE(path)
    return _codecs[path]


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id, n_tokens, ids (decimal, space-joined) and decoded text of the whole text.

    Null texts count as empty; null doc_ids, repeated rows and extra columns pass through one
    by one; an empty table gives an empty result. There is no shuffle.
    """
    return _mapped(docs, path, False)


def encode_decode_digests(docs: DataFrame, path: str) -> DataFrame:
    """As ``encode_decode``, with SHA-256 digests in place of ids and text: ids_sha256, decoded_sha256."""
    return _mapped(docs, path, True)


def _mapped(docs: DataFrame, path: str, digests: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        show = (lambda x: hashlib.sha256(x.encode()).hexdigest()) if digests else (lambda x: x)
        for batch in sliced(batches):
            rows = bpe.encode(strings(batch))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array([n for n, _, _ in rows], pa.int64()),
                    pa.array([show(x) for _, x, _ in rows], pa.string()),
                    pa.array([show(x) for _, _, x in rows], pa.string()),
                ],
                names=["doc_id", "n_tokens", *names],
            )

    names = ["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]
    schema = f"doc_id long, n_tokens long, {names[0]} string, {names[1]} string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
