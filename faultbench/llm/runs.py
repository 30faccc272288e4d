"""Periodic runs of words, by a sparse diagonal DP.

A run of period q is a stretch of words on which words q apart are equal: on the diagonal of lag q
of the text against itself, a stretch of matches. For each word, its earlier occurrences step the
match lengths of their lags; a diagonal that ends with enough matches is a run and is given out.

Most earlier occurrences can't lie on such a diagonal, and only those that can are looked at. A
run holds 3 periods or more and ``shortest`` words, so a diagonal of lag q needs 2 q matches in a
row, and ``shortest`` - q. Hence the occurrences of a word *with the g words from it on* are enough,
where g is a power of two that no such diagonal falls short of: one g for all short lags, then 2 g
for lags from g on, and so on. Since g is more than the lag, such a string holds a whole period.
Would it stand nearer than one smallest period q within the run, then q were not the smallest. So
among the occurrences only the latest one counts, each word steps one lag for each g, and a lag
that is a multiple of the smallest period never has matches. Equal strings get equal numbers by
doubling (the number of 2 g words is that of the pair of its halves), without hashes; positions
whose string is alone in its text leave at once. Time grows with words x log(words), for texts of one
repeated word too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from faultbench.llm.common import sliced, strings

RUN = "start long, length long, period long"


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each key, and whether the key occurs again."""
    _, number, count = np.unique(keys, return_inverse=True, return_counts=True)
    return number, count[number] > 1


def _least_matches(shortest: int, repeats: int) -> int:
    """Matches in a row that the diagonal of every run has, whatever its lag."""
    return min(max(shortest - q, (repeats - 1) * q) for q in range(1, max(2, shortest) + 1))


def diagonal_runs(
    words: np.ndarray, stops: np.ndarray, shortest: int = 24, repeats: int = 3
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of every run, in order of starts, then periods.

    ``words`` holds the word numbers of several texts one after another, ``stops`` each text's
    end. A run is maximal, lies within one text, and has ``repeats`` (3 or more) periods and
    ``shortest`` words at least.
    """
    if repeats < 3:
        raise ValueError("runs of fewer than 3 periods are not told apart by their latest occurrence")
    n = len(words)
    at = np.arange(n)
    text = np.searchsorted(stops, at, side="right")
    name = np.full(n + 1, -1, np.int64)  # of the g words from a position on; -1: alone in its text
    number, again = _numbered(text * (int(words.max(initial=0)) + 1) + words)
    at = at[again]
    name[at] = number[again]
    g, first, found = 1, 1, []
    least = _least_matches(shortest, repeats)
    while len(at):
        if 2 * g > least and first < g:  # lags from first to g - 1: their diagonals have g matches
            found.append(_ended(at, name[at], g, first, shortest, repeats))
            first = g
        other = at + g
        whole = other < n
        at, other = at[whole], other[whole]
        both = (name[other] >= 0) & (text[other] == text[at])
        at, other = at[both], other[both]
        number, again = _numbered(name[at] * (n + 1) + name[other])
        name[:] = -1
        at = at[again]
        name[at] = number[again]
        g *= 2
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, length, period = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _ended(
    at: np.ndarray, name: np.ndarray, g: int, first: int, shortest: int, repeats: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs whose diagonals have lags from ``first`` to g - 1, in the order in which these end."""
    order = np.argsort(name, kind="stable")  # positions of one string stay in their order
    same = np.r_[False, name[order][1:] == name[order][:-1]]
    lag = np.zeros(len(at), np.int64)
    lag[order[same]] = at[order[same]] - at[order[np.flatnonzero(same) - 1]]
    live = (lag >= first) & (lag < g)
    at, lag = at[live], lag[live]
    # A word goes on with the lag of the word before it, or that diagonal has ended.
    begins = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (np.diff(lag) != 0)][: len(at)])
    steps = np.diff(np.r_[begins, len(at)])
    period = lag[begins]
    length = steps - 1 + g + period
    enough = length >= np.maximum(shortest, repeats * period)
    return at[begins][enough] - period[enough], length[enough], period[enough]


def _kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words that no run holds after its first period."""
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, shortest: int = 24, repeats: int = 3) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, runs (start, length, period) and the collapsed text.

    Words are what ASCII white space parts. ``collapsed`` joins by one space the words that no
    run holds after its first period. A text of any length is worked on as a whole by one task. Null
    and empty texts have no words, no runs and an empty collapsed text; null doc_ids, repeated rows
    and extra columns pass through one by one; an empty table gives an empty result. There is no
    shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [t.encode().split() for t in strings(batch)]
            index: dict[bytes, int] = {}
            words = np.array([index.setdefault(w, len(index)) for t in texts for w in t], np.int64)
            stops = np.cumsum([len(t) for t in texts])
            own: list[list[tuple[int, int, int]]] = [[] for _ in texts]
            start, length, period = diagonal_runs(words, stops, shortest, repeats)
            text = np.searchsorted(stops, start, side="right")
            before = np.append(0, stops)[text]
            for i, *found in zip(text.tolist(), (start - before).tolist(), length.tolist(), period.tolist()):
                own[i].append(tuple(found))
            collapsed = [b" ".join(_kept(t, r) if r else t).decode() for t, r in zip(texts, own)]
            kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))
            rows = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in own]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array(rows, kind),
                    pa.array(collapsed, pa.string()),
                ],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id long, n_words long, runs array<struct<{RUN.replace(' long', ': long')}>>, collapsed string"
    )
