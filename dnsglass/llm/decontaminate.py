"""Benchmark decontamination by the q-gram lemma (operator 6).

Texts are lower-cased and runs of white space become one space.  Every benchmark
item is cut into overlapping probes of PROBE characters (a shorter item is one
probe).  A document is contaminated by an item if some region of it can be turned
into one of its probes with at most BUDGET of the probe's length in edits, or if it
holds a verbatim excerpt of EXCERPT characters or more of the item, wherever in the
item the excerpt starts.

An alignment of a probe of n characters with at most k edits keeps at least
n - Q + 1 - k * Q of its q-grams, all within k diagonals.  The shared q-grams of a
document and a probe are counted in bands of 2k + 2 diagonals, laid every k + 1, so
any such alignment lies in one band as a whole; bands that reach the bound are
verified by an alignment confined to the band's diagonals.  The lemma loses no
region within the budget.

Every excerpt of EXCERPT characters lies in some probe, for probes overlap by STEP.
So the index also has the hashes of all strings of EXCERPT characters of its probes;
those of a document are looked up there and compared character by character.

The probes are split by hash into blocks of a bounded number of characters.  Each
block's index is bounded whatever the benchmark's size, and all documents pass by
each block, so nothing depends on the benchmark being small.

Cases: null or empty documents have no hits; empty items and items shorter than Q
have no probe (a probe needs a q-gram).  Repeated items and documents give
repeated hits once per item_id and doc_id.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import U64, mix, runs, spread
from .tables import texts

PROBE, STEP, Q = 100, 50, 10
#: Every verbatim excerpt of at least this many normalised characters is found (at most PROBE - STEP).
EXCERPT = 50
#: Edits allowed per character of a probe.
BUDGET = 0.06
#: Probe characters of one block of the index.
BLOCK_CHARS = 4_000_000
_CHUNK = 400_000
_GAP = 0x110000  # stands between texts, is no character


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(chars: np.ndarray, q: int = Q) -> np.ndarray:
    """Hashes of the q-grams at every place."""
    if len(chars) < q:
        return np.zeros(0, U64)
    h, have = chars.astype(U64) * U64(0x9E3779B97F4A7C15), 1
    while 2 * have <= q:
        h = h[:-have] * U64(0xC2B2AE3D27D4EB4F + 2 * have) + h[have:]
        have *= 2
    rest = q - have
    if rest:  # two overlapping halves cover the gram
        h = h[:len(h) - rest] * U64(0x165667B19E3779F9) + h[rest:]
    return mix(h)


def allowed(n: int) -> int:
    return int(n * BUDGET)


def bound(n: int, q: int = Q) -> int:
    """Least number of shared q-grams of a probe of n characters."""
    return max(1, n - q + 1 - allowed(n) * q)


class Lookup:
    """The entries of each hash."""

    def __init__(self, h: np.ndarray):
        self.entry = np.argsort(h, kind="stable")
        h = h[self.entry]
        edge = runs(h)
        self.hash, self.first, self.count = h[edge[:-1]], edge[:-1], np.diff(edge)
        bits = max(16, int(4 * len(self.hash)).bit_length() + 2)
        self.shift = U64(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[(self.hash >> self.shift).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in h, entry) of every hash that is known."""
        at = np.flatnonzero(self.seen[(h >> self.shift).astype(np.int64)])
        slot = np.searchsorted(self.hash, h[at])
        slot[slot == len(self.hash)] = 0
        same = self.hash[slot] == h[at]
        at, slot = at[same], slot[same]
        n = self.count[slot]
        return np.repeat(at, n), self.entry[spread(self.first[slot], n)]


class Index:
    """The q-grams and excerpts of a block of probes (item, number, text)."""

    def __init__(self, probes: list[tuple[int, int, str]]):
        self.item = np.array([p[0] for p in probes], np.int64)
        self.text = [p[2] for p in probes]
        size = np.array([len(t) for t in self.text], np.int64)
        self.edits = np.array([allowed(n) for n in size.tolist()], np.int64)
        self.need = np.array([bound(n) for n in size.tolist()], np.int64)
        h, self.probe, self.place = self._places(Q)
        self.grams = Lookup(h)
        h, probe, place = self._places(EXCERPT)
        _, self.own = np.unique(self.item, return_inverse=True)
        by = np.lexsort((place, probe, self.own[probe], h)) if len(h) else np.zeros(0, np.int64)
        h, probe, place = h[by], probe[by], place[by]
        new = np.ones(len(h), bool)  # an excerpt counts once for its item
        new[1:] = (h[1:] != h[:-1]) | (self.own[probe[1:]] != self.own[probe[:-1]])
        self.excerpt_probe, self.excerpt_place = probe[new], place[new]
        self.excerpts = Lookup(h[new])

    def _places(self, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, probe, place in the probe) of every q-gram."""
        hashes = [grams(codes(t), q) for t in self.text]
        count = np.array([len(h) for h in hashes], np.int64)
        return (np.concatenate(hashes) if hashes else np.zeros(0, U64), np.repeat(np.arange(len(self.text)), count),
                spread(np.zeros(len(self.text), np.int64), count))

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the text, probe, place in the probe) of every shared q-gram."""
        at, entry = self.grams(h)
        return at, self.probe[entry], self.place[entry]

    def copied(self, chars: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, item, place) of the first excerpt of each item in each of the texts that
        begin at `start` in `chars`."""
        at, entry = self.excerpts(grams(chars, EXCERPT))
        probe, place = self.excerpt_probe[entry], self.excerpt_place[entry]
        text = np.searchsorted(start, at, "right") - 1
        pair = text * len(self.item) + self.own[probe]
        by = np.argsort(pair, kind="stable")
        edge = runs(pair[by])
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            for j in by[a:b].tolist():
                p, n = int(probe[j]), int(place[j])
                if (chars[at[j]:at[j] + EXCERPT] == codes(self.text[p][n:n + EXCERPT])).all():
                    yield int(text[j]), int(self.item[p]), int(at[j] - start[text[j]])
                    break

    def bands(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probe, first diagonal) of the bands that reach the bound."""
        at, probe, place = self.hits(grams(chars))
        enough = np.bincount(probe, minlength=len(self.need)) >= self.need  # a band cannot have more than the whole
        keep = enough[probe]
        at, probe, place = at[keep], probe[keep], place[keep]
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        step = self.edits[probe] + 1
        band = (at - place + PROBE) // step  # diagonals from -PROBE on
        span = len(chars) + 2 * PROBE
        key = np.r_[probe * span + band, probe * span + band - 1]
        key, n = np.unique(key, return_counts=True)
        probe, band = key // span, key % span
        wrapped = band == span - 1  # band -1 of the next probe
        probe, band = probe + wrapped, np.where(wrapped, -1, band)
        good = n >= self.need[probe]
        probe, band = probe[good], band[good]
        return probe, band * (self.edits[probe] + 1) - PROBE


def banded(probe: str, text: str, first: int, width: int, most: int) -> tuple[int, int] | None:
    """Fewest edits, at most `most`, between the probe and a region of the text whose
    alignment stays on the diagonals first .. first + width - 1; and the region's end."""
    a, n = codes(probe).astype(np.int64), len(probe)
    b = np.full(n + width + 1, -1, np.int64)
    lo, hi = max(0, first), min(len(text), first + n + width)
    if hi <= lo:
        return None
    b[lo - first:hi - first] = codes(text[lo:hi])
    far = 1 << 20
    inside = (np.arange(n + width + 1) + first >= 0) & (np.arange(n + width + 1) + first <= len(text))
    row = np.where(inside[:width], 0, far)  # a region may start on any diagonal
    ramp = np.arange(width)
    for i in range(n):  # row[d]: edits for probe[:i] against a region that ends at first + i + d
        sub = row + (b[i:i + width] != a[i])
        drop = np.r_[row[1:], far] + 1
        row = np.where(inside[i + 1:i + 1 + width], np.minimum(sub, drop), far)
        row = np.minimum.accumulate(row - ramp) + ramp  # characters of the text that the probe lacks
    best = int(row.argmin())
    return (int(row[best]), first + n + best) if row[best] <= most else None


def _blocks(chars: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    a, total = 0, 0
    for i, c in enumerate(chars):
        total += len(c) + 1
        if total >= _CHUNK:
            yield a, i + 1
            a, total = i + 1, 0
    if a < len(chars):
        yield a, len(chars)


def probes_of(benchmark: DataFrame) -> DataFrame:
    """(item_id, probe_no, text) of a table (item_id, text)."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t = normal(t)
                if i is None or len(t) < Q:
                    continue
                starts = [0] if len(t) <= PROBE else [*range(0, len(t) - PROBE, STEP), len(t) - PROBE]
                out += [(i, n, t[s:s + PROBE]) for n, s in enumerate(starts)]
            cols = list(zip(*out)) or [()] * 3
            yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())], names=["item_id", "probe_no", "text"])

    return (benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(run, "item_id long, probe_no int, text string"))


def contaminated(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, edits, region_end, n_probes: one row for each document and item
    that it holds a region of; the best probe's edits and where its region ends in
    the normalised text.  Where only an excerpt is found, n_probes is 0, edits 0 and
    region_end the end of its first EXCERPT characters."""
    probes = probes_of(benchmark)
    total = probes.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = max(1, -(-total // block_chars))
    found = None
    for block in range(n_blocks):  # each of bounded size
        own = [tuple(r) for r in probes.filter(F.pmod(F.xxhash64("item_id", "probe_no"), F.lit(n_blocks)) == block)
               .dropDuplicates(["item_id", "text"]).orderBy("item_id", "probe_no").collect()]
        part = _against(docs, own)
        found = part if found is None else found.union(part)
    return found.groupBy("doc_id", "item_id").agg(
        F.min(F.struct(F.col("n_probes") == 0, "edits", "region_end")).alias("best"), F.sum("n_probes").alias("n_probes")).select(
        "doc_id", "item_id", "best.edits", "best.region_end", "n_probes")


def _against(docs: DataFrame, probes: list[tuple[int, int, str]]) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(probes)
        for batch in it:
            ids = batch.column(0)
            out: list[tuple[int | None, int, int, int, int]] = []
            for a in range(0, len(batch), 500):
                part = [normal(t.as_py()) for t in batch.column(1).slice(a, 500)]
                chars = [codes(t) for t in part]
                for lo, hi in _blocks(chars):
                    _search(index, part[lo:hi], chars[lo:hi], [ids[a + i].as_py() for i in range(lo, hi)], out)
            cols = list(zip(*out)) or [()] * 5
            yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "edits", "region_end", "n_probes"])

    return texts(docs).filter("text is not null").mapInArrow(run, "doc_id long, item_id long, edits long, region_end long, n_probes long")


def _search(index: Index, part: list[str], chars: list[np.ndarray], ids: list[int | None], out: list) -> None:
    """Appends the hits of some documents, laid one after the other."""
    size = np.array([len(c) + 1 for c in chars])
    start = np.cumsum(size) - size
    flat = np.full(int(size.sum()), _GAP, np.uint32)
    flat[spread(start, size - 1)] = np.concatenate(chars) if chars else []
    probe, diagonal = index.bands(flat)
    best: dict[tuple[int, int], list[int]] = {}
    done: set[tuple[int, int]] = set()
    for p, d in zip(probe.tolist(), diagonal.tolist()):
        k = int(index.edits[p])
        # the band's region may touch two documents
        first = max(0, int(np.searchsorted(start, d, "right")) - 1)
        last = max(0, int(np.searchsorted(start, d + 2 * k + 2 + len(index.text[p]), "right")) - 1)
        for i in range(first, last + 1):
            if (p, i) in done:
                continue
            text, shift = part[i], d - int(start[i])
            at = text.find(index.text[p], max(0, shift), max(0, shift + 2 * k + 2 + len(index.text[p])))
            hit = (0, at + len(index.text[p])) if at >= 0 else banded(index.text[p], text, shift, 2 * k + 2, k)
            if hit:
                done.add((p, i))
                b = best.setdefault((i, int(index.item[p])), [hit[0], hit[1], 0])
                b[:2] = min(b[:2], [*hit])
                b[2] += 1
    for i, item, at in index.copied(flat, start):
        best.setdefault((i, item), [0, at + EXCERPT, 0])
    out += [(ids[i], item, *b) for (i, item), b in best.items()]
