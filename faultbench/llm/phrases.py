"""Word collocations from depth-truncated suffix trees, built group by group.

A phrase of up to ``longest`` words is a path from the root of the tree over all suffixes, cut after
``longest`` words; its count is the total of the leaves below. The tree is never held whole. Its
suffixes are partitioned by their first words: a prefix with more occurrences than the memory budget
is extended by a word, as often as needed, and prefixes are put into groups that hold about the
budget. Each group's subtree is then built by itself, in one task's memory, from sorted suffixes.

Suffixes that are equal are counted together before they are shuffled, and end before the first word
or pair of words that is too rare to be in any phrase. Rare ones are told by filters of fixed size
made from the counts of words and (hashed) pairs, which the partitioning needs too; a few pass wrongly,
which costs time only, since every phrase's count comes from the leaves. What goes to the driver are
those filters, a table of bucket sizes of fixed size, and the hashes of the prefixes over the budget,
of which there are at most words / budget a level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from faultbench.llm.common import checkpointed, sliced

#: Occurrences that a group of prefixes may have, bits of the filter, bits that number the buckets of prefixes.
BUDGET, FILTER_BITS, BUCKET_BITS = 1 << 18, 25, 16
SEED = 42
#: Rows and text bytes that a task counts at a time.
ROWS, BYTES = 16_384, 8 << 20
#: What ends a piece, as bytes; the mark of an end; what parts words.
ENDS, END, BLANKS = b".,;:!?\n\x0b\x0c\r", b"\x0b", b" \t"
_table = bytes.maketrans(ENDS + BLANKS, END * len(ENDS) + b" " * len(BLANKS))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    """For each language of a slice: its distinct words, and all words in order, -1 where a piece ends."""
    for batch in sliced(batches, rows=ROWS, size=BYTES):
        by_lang: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            if text:
                by_lang.setdefault("und" if lang is None else lang, []).append(text.encode())
        for lang, texts in by_lang.items():
            data = END.join(texts).lower().translate(_table).replace(END, b" " + END + b" ")
            values = pc.split_pattern(pa.array([data], pa.binary()), " ").flatten().dictionary_encode()
            number, words = values.indices.to_numpy(), values.dictionary.to_pylist()
            is_word = np.array([w not in (b"", END) for w in words], bool)
            new = np.where(is_word, np.cumsum(is_word) - 1, [-2 if w == b"" else -1 for w in words]).astype(np.int32)
            flat = new[number]
            yield lang, [w for w in words if w not in (b"", END)], flat[flat != -2]


def _rows(lang: str, phrases: pa.Array, counts: np.ndarray, names: list[str], *more: np.ndarray) -> pa.RecordBatch:
    langs = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(phrases), np.int32)), pa.array([lang])).cast(pa.string())
    return pa.RecordBatch.from_arrays([langs, phrases.cast(pa.string()), pa.array(counts.astype(np.int64)), *map(pa.array, more)], names=names)


def word_counts(docs: DataFrame) -> DataFrame:
    """Rows (lang, phrase, f): occurrences of every word in each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, flat in _words(batches):
            yield _rows(lang, pa.array(words, pa.binary()), np.bincount(flat[flat >= 0], minlength=len(words)), ["lang", "phrase", "f"])

    some = docs.select("lang", "text").mapInArrow(run, "lang string, phrase string, f long")
    return some.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _following(flat: np.ndarray, longest: int) -> np.ndarray:
    """Row i: the words from i on, up to ``longest``, -1 from the piece's end on."""
    padded = np.append(flat, np.full(longest, -1, flat.dtype))
    out = np.stack([padded[k : k + len(flat)] for k in range(longest)], axis=1)
    out[np.logical_or.accumulate(out < 0, axis=1)] = -1
    return out


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of small whole numbers from -1 on, and how often each occurs."""
    key, size = np.zeros(len(rows), np.int64), int(rows.max(initial=0)) + 2
    fits = size ** rows.shape[1] < 1 << 62
    for column in rows.T:
        key = key * size + (column + 1)
        if not fits:  # numbers instead of keys: they stay below rows * words
            key = np.unique(key, return_inverse=True)[1]
    if fits:
        key, count = np.unique(key, return_counts=True)
        out = np.empty((len(key), rows.shape[1]), np.int32)
        for i in range(rows.shape[1] - 1, -1, -1):
            key, out[:, i] = np.divmod(key, size)
        return out - 1, count
    _, first, count = np.unique(key, return_index=True, return_counts=True)
    return rows[first], count


def _joined(words: list[bytes], rows: np.ndarray) -> pa.Array:
    """Each row's words joined by single spaces."""
    # A word after the first brings its space along; a missing one is the empty string.
    known = pa.array([b"", *[b" " + w for w in words]], pa.binary())
    first = pa.array([b"", *words], pa.binary()).take(pa.array(rows[:, 0] + 1))
    return pc.binary_join_element_wise(first, *[known.take(pa.array(c + 1)) for c in rows.T[1:]], pa.scalar(b"", pa.binary()))


def _word_hash(lang: F.Column, phrase: F.Column) -> F.Column:
    return F.xxhash64(F.concat(lang, F.lit("\0"), phrase))


def _bits(places: DataFrame) -> np.ndarray:
    """A filter of fixed size with a bit set at each ``p``."""
    part = places.groupBy(F.shiftright("p", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 31 as int))")).alias("b"))
    bits = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    for batch in part.toArrow().to_batches():  # 2^20 rows at most, whatever the input
        bits[batch.column("w").to_numpy()] = batch.column("b").to_numpy()
    return bits


def _word_filter(words: DataFrame, least: int) -> np.ndarray:
    """Bits set at two places for each (lang, word) that occurs ``least`` times."""
    h, mask = _word_hash(F.col("lang"), F.col("phrase")), (1 << FILTER_BITS) - 1
    two = F.array(h.bitwiseAND(mask), F.shiftrightunsigned(h, FILTER_BITS).bitwiseAND(mask))
    return _bits(words.where(F.col("f") >= least).select(F.explode(two).alias("p")))


def _passes(bits: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    out = np.ones(len(first), bool)
    for p in (first, second):
        out &= (bits[p >> 5] >> (p & 31).astype(np.uint32)) & 1 == 1
    return out


def _places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << FILTER_BITS) - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(FILTER_BITS)) & mask).astype(np.int64)


def _fold(key: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The hash of a phrase from that of its first words and that of its last one."""
    key = (key ^ (key >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    key = (key ^ (key >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) + h
    return key ^ (key >> np.uint64(31))


def _frequent_words(
    batches: Iterator[pa.RecordBatch], bits: np.ndarray
) -> Iterator[tuple[str, list[bytes], np.ndarray, np.ndarray]]:
    """As ``_words``, with words that are too rare taken for ends, and the words' hashes."""
    for lang, words, flat in _words(batches):
        start = lang.encode() + b"\0"
        h = np.array([xxhash.xxh64_intdigest(start + w, SEED) for w in words], np.uint64)
        frequent = np.append(_passes(bits, *_places(h)), False)  # the last is where -1 points to
        number = np.where(frequent, np.cumsum(frequent) - 1, -1).astype(np.int32)
        yield lang, [w for w, f in zip(words, frequent) if f], number[flat], h[frequent[:-1]]


def _phrase_sizes(
    docs: DataFrame, bits: np.ndarray, size: int, least: int, parts: int, within: np.ndarray | None = None
) -> DataFrame:
    """Rows (h, n): hashes of phrases of ``size`` frequent words, with their occurrences, ``least`` or more.

    Only prefixes over the budget (``within``: their sorted hashes) are followed, if given. Hashes travel
    as sorted arrays, one for each part of their range, and are merged there. Two phrases of one
    hash seem more frequent than they are: that costs time later, not results.
    """
    sent, b = docs.sparkSession.sparkContext.broadcast((bits, within)), parts.bit_length() - 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, within = sent.value
        for _, _, flat, h in _frequent_words(batches, bits):
            rows = _following(flat, size)
            rows = rows[rows[:, -1] >= 0]
            key = h[rows[:, 0]]
            for d in range(1, size):
                if d == size - 1 and within is not None:
                    own = np.isin(_short(key, parts), within)
                    rows, key = rows[own], key[own]
                key = _fold(key, h[rows[:, d]])
            key, n = np.unique(key >> np.uint64(32 - b), return_counts=True)
            at = np.searchsorted(key >> np.uint64(32), np.arange(parts + 1)).tolist()
            kept = [(p, a, z) for p, (a, z) in enumerate(zip(at, at[1:])) if a < z]
            low = key.astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([p for p, _, _ in kept], pa.int32()),
                    pa.array([_planes(np.diff(low[a:z], prepend=np.uint32(0))) for _, a, z in kept], pa.binary()),
                    pa.array([_planes(n[a:z]) for _, a, z in kept], pa.binary()),
                ],
                names=["part", "keys", "counts"],
            )

    def merge(table: pa.Table) -> pa.Table:
        key = np.concatenate([np.cumsum(_numbers(x), dtype=np.uint64) for x in table["keys"].to_pylist()])
        n = np.concatenate([_numbers(x) for x in table["counts"].to_pylist()]).astype(np.int64)
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        begins = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        total = np.add.reduceat(n, begins)
        good = total >= least
        h = ((key[begins][good] | np.uint64(table["part"][0].as_py() << 32)) << np.uint64(32 - b))
        first, second = _phrase_places(h)
        return pa.table({"h": h.view(np.int64), "n": total[good], "first": first, "second": second})

    some = docs.select("lang", "text").mapInArrow(count, "part int, keys binary, counts binary")
    return checkpointed(some.groupBy("part").applyInArrow(merge, "h long, n long, first long, second long"))


def _short(key: np.ndarray, parts: int) -> np.ndarray:
    """The leading bits of hashes by which phrases are counted: 32 within each part."""
    low = np.uint64((1 << (33 - parts.bit_length())) - 1)
    return key & ~low


def _phrase_places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint64(64 - FILTER_BITS)
    return tuple((h * np.uint64(c) >> shift).astype(np.int64) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))


def _planes(numbers: np.ndarray) -> bytes:
    """Whole numbers of 32 bits, all first bytes first: small ones leave planes of zeros, which compress."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _suffixes(
    docs: DataFrame, bits: np.ndarray, pairs: np.ndarray, heavy: list[np.ndarray], groups: list[int], longest: int, parts: int
) -> DataFrame:
    """Rows (group, lang, suffixes, counts, depths): the distinct suffixes of a slice that fall into a group, a
    line each, how often each occurs there, and how many words its prefix has, by which it is grouped. A
    suffix ends before the first word that is too rare, alone or with the word before it. ``heavy``: for 1, 2..
    words, the sorted hashes of prefixes over the budget."""
    sent = docs.sparkSession.sparkContext.broadcast((bits, pairs, heavy, np.array(groups, np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, pairs, heavy, groups = sent.value
        for lang, words, flat, h in _frequent_words(batches, bits):
            both = np.flatnonzero((flat[:-1] >= 0) & (flat[1:] >= 0))
            both = both[_passes(pairs, *_phrase_places(_short(_fold(h[flat[both]], h[flat[both + 1]]), parts)))]
            linked = np.zeros(len(flat) + longest, bool)  # whether a word goes with the one before it
            linked[both + 1] = True
            rows = _following(flat, longest)[both]
            for d in range(2, longest):
                rows[~linked[both + d], d:] = -1
            rows, count = _distinct(rows)
            if not len(rows):
                continue
            depth, prefix, now = np.ones(len(rows), np.uint8), h[rows[:, 0]], np.arange(len(rows))
            for d in range(1, longest):
                own = prefix[now] if d == 1 else _short(prefix[now], parts)
                now = now[np.isin(own, heavy[d - 1])] if len(heavy) >= d else now[:0]
                depth[now] = d + 1
                now = now[rows[now, d] >= 0]  # a suffix that ends here has no longer prefix
                prefix[now] = _fold(prefix[now], h[rows[now, d]])
            group = groups[(prefix >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
            order = np.argsort(group, kind="stable")
            group, rows, count, depth = group[order], rows[order], count[order], depth[order]
            begins = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            ends = np.append(begins[1:], len(group))
            lists = pa.ListArray.from_arrays(pa.array(np.append(begins, len(group)), pa.int32()), _joined(words, rows))
            spans = list(zip(begins.tolist(), ends.tolist()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(group[begins], pa.int32()),
                    pa.array([lang] * len(begins), pa.string()),
                    pc.binary_join(lists, b"\n"),
                    pa.array([_planes(count[a:z]) for a, z in spans], pa.binary()),
                    pa.array([depth[a:z].tobytes() for a, z in spans], pa.binary()),
                ],
                names=["group", "lang", "suffixes", "counts", "depths"],
            )

    return docs.select("lang", "text").mapInArrow(
        run, "group int, lang string, suffixes binary, counts binary, depths binary"
    )


def _bucket(h: F.Column) -> F.Column:
    return F.shiftrightunsigned(h, 64 - BUCKET_BITS).cast("int")


def _groups(sizes: list[tuple[int, int]], budget: int) -> list[int]:
    """The group of each bucket: neighbours go together until they exceed the budget."""
    of, group, held = [0] * (1 << BUCKET_BITS), 0, 0
    size = dict(sizes)
    for b in range(1 << BUCKET_BITS):
        if held and held + size.get(b, 0) > budget:
            group, held = group + 1, 0
        held += size.get(b, 0)
        of[b] = group
    return of


def subtree_counts(langs: np.ndarray, rows: np.ndarray, counts: np.ndarray, depth: np.ndarray, least: int):
    """(row, words, count) of the nodes of 2 words or more that ``least`` leaves of a group lie below.

    ``rows``: suffixes as numbers, -1 from their end on; ``depth``: words of their prefix. The nodes above
    a prefix that was extended have leaves in other groups too, so they are given whatever their count.
    """
    order = np.lexsort((*rows.T[::-1], langs))
    langs, rows, counts, depth = langs[order], rows[order], counts[order], depth[order]
    new = np.append(True, langs[1:] != langs[:-1])[: len(rows)]
    for size in range(1, rows.shape[1] + 1):
        column = rows[:, size - 1]
        new = new | np.append(True, column[1:] != column[:-1])[: len(rows)]
        if size < 2 or not len(rows):
            continue
        begins = np.flatnonzero(new)
        total = np.add.reduceat(counts, begins)
        shared = np.maximum.reduceat(depth, begins) > size
        good = (column[begins] >= 0) & ((total >= least) | shared)
        yield order[begins[good]], size, total[good]


def _grown(suffixes: DataFrame, longest: int, least: int) -> DataFrame:
    """Rows (lang, phrase, f): nodes of every group's subtrees with ``least`` occurrences."""

    def grow(table: pa.Table) -> pa.Table:
        lines = pc.split_pattern(table["suffixes"].combine_chunks(), "\n")
        own_lang = table["lang"].combine_chunks().dictionary_encode()
        langs = np.repeat(own_lang.indices.to_numpy(), np.diff(lines.offsets.to_numpy()))
        split = pc.split_pattern(lines.flatten(), " ")
        words = split.flatten().dictionary_encode()
        stops = split.offsets.to_numpy().astype(np.int64)
        stops -= stops[0]
        sizes = np.diff(stops)
        rows = np.full((len(sizes), longest), -1, np.int32)
        row = np.repeat(np.arange(len(sizes)), sizes)
        rows[row, np.arange(len(row)) - stops[:-1][row]] = words.indices.to_numpy()
        counts = np.concatenate([_numbers(x) for x in table["counts"].to_pylist()]).astype(np.int64)
        depth = np.concatenate([np.frombuffer(x, np.uint8) for x in table["depths"].to_pylist()])
        known = words.dictionary.to_pylist()
        own = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])
        made = [own.empty_table()]
        for at, size, total in subtree_counts(langs, rows, counts, depth, least):
            phrases = _joined(known, rows[at, :size]).cast(pa.string())
            made.append(pa.Table.from_arrays([own_lang.dictionary.take(pa.array(langs[at])), phrases, pa.array(total)], schema=own))
        return pa.concat_tables(made)

    return suffixes.groupBy("group").applyInArrow(grow, "lang string, phrase string, f long")


def phrase_counts(docs: DataFrame, longest: int = 4, least: int = 30, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """Rows (lang, phrase, f): all words with their counts, and all phrases of 2 to ``longest`` words that
    occur ``least`` times. Both are written to the shared checkpoint folder."""
    words = checkpointed(word_counts(docs)).withColumn("h", _word_hash(F.col("lang"), F.col("phrase")))
    total = words.agg(F.sum("f")).first()[0] or 0
    parts = 1 << max(5, min(20, (total // (8 * budget)).bit_length()))  # about 2^21 occurrences each
    bits = _word_filter(words, least)
    frequent = words.where(F.col("f") >= least).select("h", F.col("f").alias("n"))
    level, sizes, heavy, pairs = frequent, frequent.where(F.col("n") <= budget), [], None
    for size in range(2, longest + 1):
        # Prefixes over the budget: words / budget of them at most.
        over = np.sort(np.array([r.h for r in level.where(F.col("n") > budget).toLocalIterator()], np.int64).view(np.uint64))
        if size > 2 and not len(over):
            break
        heavy.append(over)
        level = _phrase_sizes(docs, bits, size, least, parts, None if size == 2 else over)
        if size == 2:
            pairs = _bits(level.select(F.explode(F.array("first", "second")).alias("p")))
        level = level.select("h", "n")
        if len(over):
            sizes = sizes.union(level.where((F.col("n") <= budget) | F.lit(size == longest)))
    buckets = sizes.groupBy(_bucket(F.col("h")).alias("b")).agg(F.sum("n")).collect()  # 2^16 rows at most
    suffixes = _suffixes(docs, bits, pairs, heavy, _groups([tuple(r) for r in buckets], budget), longest, parts)
    grown = _grown(suffixes, longest, least).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return words.drop("h"), checkpointed(grown.where(F.col("f") >= least))


def collocations(
    docs: DataFrame, longest: int = 4, least: int = 30, share: int = 80, top: int = 2000, budget: int = BUDGET
) -> DataFrame:
    """Per language the ``top`` phrases by score: lang, rank, phrase, a, l, r, n, score.

    Words are lower-cased in A-Z, end at blanks and lie in pieces between ``.,;:!?`` and line ends. a is a phrase's
    number of occurrences (``least`` or more), n the language's words. Each cut of a phrase in two has the
    score floor(2000000 a / (l + r)), l and r the counts of its parts; the cut with the lowest score counts,
    the earliest of several. Phrases inside a longer one that has ``share`` percent of their occurrences
    or more are left out. Order: score, a (both descending), phrase by bytes. Null languages are ``und``,
    null and empty texts have no words, equal rows count each, extra columns are ignored, an empty table
    gives an empty result.
    """
    words, phrases = phrase_counts(docs, longest, least, budget)
    parts = F.split("phrase", " ")
    n = F.size("w")
    cut = phrases.select("lang", "phrase", F.col("f").alias("a"), parts.alias("w"))
    cut = cut.withColumn("k", F.explode(F.sequence(F.lit(1), n - 1)))
    cut = cut.select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice("w", 1, F.col("k")), " ").alias("first"),
        F.array_join(F.slice("w", F.col("k") + 1, n - F.col("k")), " ").alias("rest"),
    )
    counts = words.where(F.col("f") >= least).union(phrases)
    for part, name in (("first", "l"), ("rest", "r")):
        cut = cut.join(counts.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)), ["lang", part])
    score = F.expr("cast(2000000 as decimal(38, 0)) * cast(a as decimal(20, 0)) div (cast(l as decimal(20, 0)) + r)")
    scored = cut.select("lang", "phrase", "a", F.struct(score.cast("long").alias("score"), "k", "l", "r").alias("c"))
    scored = scored.groupBy("lang", "phrase", "a").agg(F.min("c").alias("c"))

    longer = phrases.select("lang", F.col("f").alias("inside"), parts.alias("w")).where(n > 2)
    spans = [(b, s) for s in range(2, longest) for b in range(1, longest - s + 2)]
    inner = F.array(*[F.when((n > s) & (b + s - 1 <= n), F.array_join(F.slice("w", b, s), " ")) for b, s in spans])
    longer = longer.select("lang", "inside", F.explode(F.array_compact(F.array_distinct(inner))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("inside").alias("inside"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(
        F.col("inside").isNull() | (100 * F.col("inside") < share * F.col("a"))
    )
    best = Window.partitionBy("lang").orderBy(F.desc("c.score"), F.desc("a"), "phrase")
    first = kept.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= top)
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))  # a row for each language
    return first.join(total, "lang").select("lang", "rank", "phrase", "a", "c.l", "c.r", "n", "c.score")
