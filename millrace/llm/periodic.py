"""Runs of words that repeat with a period, by a suffix tree of each text.

The tree is that of the text's words: suffixes in order, and the intervals of suffixes that share a prefix are its inner
nodes. A node of depth d that has leaves i and i + d in different children is a branching tandem repeat: the word string
of length d stands twice at i and is not followed by its own first word. Only the leaves of all children but the largest are
walked, from which i + d and i - d are looked up, so each leaf is met at most log n times. All other repeats of a run
are rotations of its last one: a repeat is rotated to the left as far as it goes, and repeats that end together and whose periods
are multiples are merged. What is left are the maximal runs with their smallest periods.

Runs count from ``LEAST`` words and ``TIMES`` periods on. Such a run has a branching repeat of three words or more (three
words for period 1, two periods for period 2), so nodes of a depth below three are never needed. It has some three words in a row at least three times,
so a text without such words has no run and needs no tree.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import slices

#: A run has at least so many words and so many periods.
LEAST, TIMES = 6, 4
#: Nodes of a smaller depth are not walked.
DEPTH = 3


@dataclass(frozen=True, order=True)
class Run:
    """Words ``start`` to ``end``, the last excluded, repeat every ``period`` words."""

    start: int
    end: int
    period: int

    @property
    def length(self) -> int:
        return self.end - self.start


def suffixes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes in order, the place of each, and how many words each shares with the one before it.

    Places by the first word become places by 2, 4, 8, ... words, until all differ. Places by so many words tell where two suffixes
    still agree, so the shared words add up from the largest step down.
    """
    n, step = len(words), 1
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    levels = [rank.astype(np.int32)]
    while rank.max() + 1 < n:
        behind = np.zeros(n, np.int64)
        behind[: n - step] = rank[step:] + 1
        rank = np.unique(rank * (n + 1) + behind, return_inverse=True)[1].astype(np.int64)
        levels.append(rank.astype(np.int32))
        step *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    a, b, shared = order[:-1], order[1:], np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + shared, b + shared
        inside = np.maximum(x, y) < n
        same = np.zeros(n - 1, bool)
        # Equal places by 2**k words are equal words only where neither suffix ends before.
        same[inside] = levels[k][x[inside]] == levels[k][y[inside]]
        shared[same] += 1 << k
    return order, rank, np.concatenate([[0], shared])


def small_children(shared: np.ndarray) -> np.ndarray:
    """Rows ``(depth, first, last, child's first, child's last)`` of all children but the largest of every node from ``DEPTH`` on; intervals of suffixes, the last excluded."""
    out, stack = [], []

    def leave(hi: int) -> int:
        depth, lo, starts = stack.pop()
        ends = [*starts[1:], hi]
        largest = max(range(len(starts)), key=lambda c: ends[c] - starts[c])
        out.extend((depth, lo, hi, starts[c], ends[c]) for c in range(len(starts)) if c != largest)
        return lo

    for i in [*np.flatnonzero(shared >= DEPTH), -1]:
        # Where suffixes in between share less, all open nodes end.
        if stack and i != last + 1:
            while stack:
                leave(last + 1)
        if i < 0:
            break
        last, depth, lo = i, int(shared[i]), int(i) - 1
        while stack and stack[-1][0] > depth:
            lo = leave(i)
        if not stack or stack[-1][0] < depth:
            stack.append((depth, lo, [lo]))
        stack[-1][2].append(int(i))
    return np.array(out, np.int64).reshape(-1, 5)


def repeats(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and half-lengths of the branching tandem repeats of three words or more, twice."""
    order, rank, shared = suffixes(words)
    depth, lo, hi, first, end = small_children(shared).T
    size, n = end - first, len(words)
    at = np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)
    depth, lo, hi = (np.repeat(x, size) for x in (depth, lo, hi))
    leaf, starts, halves = order[at], [], []
    for other, start in ((leaf + depth, leaf), (leaf - depth, leaf - depth)):
        inside = (other >= 0) & (other < n)
        place = rank[np.where(inside, other, 0)]
        found = inside & (place >= lo) & (place < hi)
        s, d = start[found], depth[found]
        after = s + 2 * d
        branching = (after == n) | (words[np.minimum(after, n - 1)] != words[s + d])
        starts.append(s[branching])
        halves.append(d[branching])
    return np.concatenate(starts), np.concatenate(halves)


def rotated(words: np.ndarray, start: int, period: int) -> int:
    """The first word from which on ``words`` repeat with ``period`` up to ``start``."""
    step = 16
    while start > 0:
        a = max(start - step, 0)
        differ = np.flatnonzero(words[a:start] != words[a + period : start + period])
        if len(differ):
            return a + int(differ[-1]) + 1
        start, step = a, step * 2
    return 0


def smallest_period(part: np.ndarray, period: int) -> int:
    """The smallest period of ``part``, which repeats with ``period``. Smaller ones from ``DEPTH`` on would have been met before."""
    for p in range(1, min(DEPTH, period)):
        if period % p == 0 and (part[p:] == part[:-p]).all():
            return p
    return period


def runs(words: np.ndarray) -> list[Run]:
    """The maximal runs of ``LEAST`` words and ``TIMES`` periods or more, in order of start, then period."""
    out, here, place = [], [], -1
    starts, halves = repeats(words)
    for end, d in sorted(set(zip((starts + 2 * halves).tolist(), halves.tolist()))):
        if end != place:
            here, place = [], end
        # A multiple of a run's period within it is that run again.
        if any(d % r.period == 0 and end - 2 * d >= r.start for r in here):
            continue
        first = rotated(words, end - 2 * d, d)
        run = Run(first, end, smallest_period(words[first : first + 2 * d], d))
        here.append(run)
        if run.length >= max(LEAST, TIMES * run.period):
            out.append(run)
    return sorted(out)


def periodic(text: str | None, key: int | None) -> tuple[list[bytes], list[Run]]:
    """The words of a text and its runs. Every tenth key, by its checksum, has its text made periodic from some word on."""
    words = (text or "").encode().split()
    n, h = len(words), 1 if key is None else zlib.crc32(str(key).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words[a:] = [words[a + k % p] for k in range(n - a)]
    if max(Counter(zip(words, words[1:], words[2:])).values(), default=0) < 3:
        return words, []
    numbers: dict[bytes, int] = {}
    return words, runs(np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64))


def digest(text: str | None, key: int | None) -> tuple:
    """Number of runs, the one of most periods, digests of all runs and of what is left, and that itself."""
    words, found = periodic(text, key)
    drop = np.zeros(len(words), bool)
    for r in found:
        drop[r.start + r.period : r.end] = True
    left = b" ".join([w for w, gone in zip(words, drop.tolist()) if not gone] if found else words)
    listed = "".join(f"{r.start},{r.length},{r.period}\n" for r in found).encode()
    best = None
    for r in found:
        # In order of start, then period, so the first of equals stays.
        if best is None or r.length * best.period > best.length * r.period:
            best = r
    top = (best.start, best.length, best.period, 1000 * best.length // best.period) if best else (None,) * 4
    return len(found), *top, hashlib.sha256(listed).hexdigest(), hashlib.sha256(left).hexdigest(), left


#: Names and types of what :func:`digest` gives.
COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "collapsed"]
KINDS = [pa.int64()] * 5 + [pa.string()] * 3


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", texts: bool = False) -> DataFrame:
    """For each row its number of runs, the one of most periods, and digests of all runs and of the text without repetition.

    Words are what white space of ASCII parts, as they are. ``start``, ``length``, ``period`` and ``exponent_milli`` are null without a run.
    With ``texts`` the column ``collapsed`` has what is left, words between single spaces. A null text is an empty one; a null key's text is
    taken as it is. Rows that repeat each get their row; other columns are not read. Each row is worked on by itself, a long one in a memory of
    some 100 bytes a word beside four bytes a word and step of doubling.
    """
    n = len(COLUMNS) if texts else len(COLUMNS) - 1
    names = [key, *COLUMNS[:n]]
    own = docs.select(key, text).schema[key].dataType.simpleString()
    types = ", ".join(f"`{c}` {t}" for c, t in zip(names, [own] + ["long"] * 5 + ["string"] * 3))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            rows = [digest(t, k) for k, t in zip(b[key].to_pylist(), b[text].to_pylist())]
            made = [pa.array(c, kind) for c, kind in zip(list(zip(*rows))[:n], KINDS)]
            yield pa.RecordBatch.from_arrays([b[key], *made], names)

    return docs.select(key, text).mapInArrow(find, types)
