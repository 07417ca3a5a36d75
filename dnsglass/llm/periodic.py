"""Periodic runs of words by a suffix automaton with link-cut access (operator 12).

A run is a stretch of consecutive words with smallest period q (words q apart are
equal), of at least `exponent` periods and `shortest` words, that no neighbouring word
extends keeping the period.

Automaton.  The words of a stretch are appended to a suffix automaton one by one.  A
link-cut forest over its suffix links keeps, for every state, the end of the last
occurrence of its strings: the states of one preferred path share that end, and the
access of the state of the prefix appended last recolours its whole path to the root.
On its way, access meets the path's old segments.  A segment with last end e and
deepest state of length m says that the m words up to now also ended at e; with
d = now - e <= m these occurrences overlap or touch: a square of period d, and the
stretch of m + d words that ends here has period d.  Both m and the state are maximal,
so it starts where a run starts; the run's end is the last word at which the same
(start, period) is met.  Where m >= 3 d, d is the smallest period, since a smaller one
would have set a later e (the last occurrence of the suffix).  So with four periods and
more each run is reported exactly once.

Before that, words that cannot lie in a run are cut off, which loses none: all
consecutive triples of words of a run of `exponent` periods occur `exponent` - 1 times
in it, so that only stretches of such triples go to the automaton, one automaton each.

A document is worked on by one task; memory grows with its longest such stretch.

Cases: null or empty text, or white space only -> no words, no runs, empty kept text.
Rows without doc_id and repeated rows are documents like any other, each row gives one
row.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow import U64, ByteHash, chunks, mix, string_bytes, task
from .tables import texts
from .words import word_bounds

EXPONENT = 4
SHORTEST = 6
_ODD = mix(np.arange(701, 705, dtype=U64)) | U64(1)


class SuffixAutomaton:
    """A suffix automaton over integers below `symbols`, with its link tree held as
    link-cut paths of equal last occurrence.  State 1 is the root, 0 none."""

    def __init__(self, symbols: int):
        self.symbols = symbols
        self.length, self.link = [0, 0], [0, 0]
        self.step: dict[int, int] = {}  # state * symbols + symbol -> state
        self.out: list[list[int]] = [[], []]  # symbols that leave a state
        self.up, self.left, self.right = [0, 0], [0, 0], [0, 0]  # splay trees of the paths, by depth
        self.end = [-1, -1]  # last occurrence's end, at the root of a path's splay tree
        self.last, self.now = 1, -1

    def _state(self, length: int, link: int, out: list[int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.out.append(out)
        for a in (self.up, self.left, self.right):
            a.append(0)
        self.end.append(-1)
        return len(self.length) - 1

    def append(self, symbol: int) -> list[tuple[int, int]]:
        """Appends a symbol; (d, m) for every segment of its path whose m symbols up to
        now also ended d symbols ago."""
        step, out, link, length, n = self.step, self.out, self.link, self.length, self.symbols
        self.now += 1
        p = self.last
        cur = self._state(length[p] + 1, 0, [])
        key = p * n + symbol
        while p and key not in step:
            step[key] = cur
            out[p].append(symbol)
            p = link[p]
            key = p * n + symbol
        if not p:
            parent = 1
        else:
            parent = step[key]
            if length[parent] != length[p] + 1:
                parent = self._split(parent, p, symbol)
        link[cur] = self.up[cur] = parent
        self.last = cur
        return self._access(cur)

    def _split(self, q: int, p: int, symbol: int) -> int:
        """A clone of q that takes the strings shorter than those by way of p."""
        step, n = self.step, self.symbols
        clone = self._state(self.length[p] + 1, self.link[q], list(self.out[q]))
        for s in self.out[q]:
            step[clone * n + s] = step[q * n + s]
        while p and step.get(p * n + symbol) == q:
            step[p * n + symbol] = clone
            p = self.link[p]
        self.link[q] = clone
        # it comes between q and its parent, on the path of q: the same occurrences so far
        self._splay(q)
        above = self.left[q]
        self.left[clone] = above
        if above:
            self.up[above] = clone
        self.left[q], self.up[clone] = clone, q
        return clone

    def _splay(self, x: int) -> None:
        up, left, right, end = self.up, self.left, self.right, self.end
        while True:
            y = up[x]
            if not y or (left[y] != x and right[y] != x):
                return
            z = up[y]
            inner = z and (left[z] == y or right[z] == y)
            turns = (y, x) if inner and (left[z] == y) == (left[y] == x) else (x, x) if inner else (x,)
            for v in turns:  # rotate v above its parent
                u = up[v]
                w = up[u]
                if w and left[w] == u:
                    left[w] = v
                elif w and right[w] == u:
                    right[w] = v
                else:
                    end[v] = end[u]
                if left[u] == v:
                    c = right[v]
                    left[u], right[v] = c, u
                else:
                    c = left[v]
                    right[u], left[v] = c, u
                if c:
                    up[c] = u
                up[u], up[v] = v, w

    def _access(self, x: int) -> list[tuple[int, int]]:
        """Makes the path from x to the root one, coloured with the present end."""
        up, right, end, length, now = self.up, self.right, self.end, self.length, self.now
        found = []
        below = 0
        while x:
            self._splay(x)
            e = end[x]
            if e >= 0 and now - e <= length[x]:
                found.append((now - e, length[x]))
            if r := right[x]:
                end[r] = e
            right[x] = below
            below = x
            x = up[x]
        end[below] = now
        return found


def runs_of(symbols: list[int], exponent: int = EXPONENT, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence of small integers, sorted."""
    automaton = SuffixAutomaton(max(symbols, default=0) + 1)
    last: dict[tuple[int, int], int] = {}
    for i, s in enumerate(symbols):
        for d, m in automaton.append(s):
            if m >= (exponent - 1) * d and m + d >= shortest:
                last[i - m - d + 1, d] = i
    return sorted((start, i - start + 1, d) for (start, d), i in last.items())


def candidate_stretches(words: np.ndarray, row: np.ndarray, exponent: int = EXPONENT, shortest: int = SHORTEST) -> tuple[np.ndarray, np.ndarray]:
    """[start, end) of the stretches of words (hashes, in order of their rows) that can
    hold runs: all their triples occur often enough in the stretch."""
    least = min(exponent - 1, max(shortest, exponent) - 2)
    n = len(words)
    if n < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    triple = words[:-2] * _ODD[0] + words[1:-1] * _ODD[1] + words[2:] * _ODD[2]
    part, start = row[:-2].astype(U64), np.flatnonzero(row[:-2] == row[2:])
    while True:
        _, which, count = np.unique(mix(triple[start] + part[start] * _ODD[3]), return_inverse=True, return_counts=True)
        kept = start[count[which] >= least]
        new = np.ones(len(kept), bool)
        new[1:] = (kept[1:] != kept[:-1] + 1) | (row[kept[1:]] != row[kept[:-1]])
        group = np.cumsum(new) - 1
        size = np.bincount(group) if len(kept) else np.zeros(0, np.int64)
        kept = kept[size[group] >= max(shortest, exponent) - 2]
        settled = 8 * (len(start) - len(kept)) <= len(start)  # another round would cut little more
        start = kept
        if settled:
            break
        new = np.ones(len(start), bool)
        new[1:] = (start[1:] != start[:-1] + 1) | (row[start[1:]] != row[start[:-1]])
        part[start] = np.cumsum(new).astype(U64)
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1] + 1) | (row[start[1:]] != row[start[:-1]])
    edge = np.r_[np.flatnonzero(new), len(start)]
    return start[edge[:-1]], start[edge[1:] - 1] + 3


def periodic_runs(docs: DataFrame, exponent: int = EXPONENT, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, n_words, runs (array of struct<start, length, period>, words numbered from
    0, by start and period) and kept (the words outside the runs and those of each run's
    first period, joined by one space) of every row of `docs` (doc_id, text)."""
    if exponent < 4:
        raise ValueError("a run has at least four periods")
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", run_type), ("kept", pa.string())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data, off = string_bytes(batch.column(1))
            for a, b in chunks(off):
                raw, o = data[off[a]:off[b]], off[a:b + 1] - off[a]
                start, end, row = word_bounds(raw, o)
                text = raw.tobytes()
                count = np.bincount(row, minlength=b - a)
                base = np.cumsum(count) - count
                found: dict[int, list[tuple[int, int, int]]] = {}
                for s, e in zip(*(x.tolist() for x in candidate_stretches(ByteHash(raw)(start, end), row, exponent, shortest))):
                    names: dict[bytes, int] = {}
                    ids = [names.setdefault(text[x:y], len(names)) for x, y in zip(start[s:e].tolist(), end[s:e].tolist())]
                    if told := runs_of(ids, exponent, shortest):
                        at = int(s - base[row[s]])
                        found.setdefault(int(row[s]), []).extend((x + at, n, q) for x, n, q in told)
                kept, listed = [], []
                for i in range(b - a):
                    words = text[o[i]:o[i + 1]].split()
                    here = sorted(found.get(i, ()))
                    if here:
                        gone = bytearray(len(words))
                        for x, n, q in here:
                            gone[x + q:x + n] = b"\1" * (n - q)
                        words = [w for w, g in zip(words, gone) if not g]
                    kept.append(b" ".join(words).decode())
                    listed.append([{"start": x, "length": n, "period": q} for x, n, q in here])
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(count, pa.int64()), pa.array(listed, run_type), pa.array(kept, pa.string())], schema=schema)

    return texts(docs).mapInArrow(task(run), "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, kept string")
