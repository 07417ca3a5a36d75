"""Removal of repeated word passages by difference-cover anchors (operator 11).

A window is `length` (50) consecutive words of one document.  A word is removed if a
window that covers it also starts in a document with a smaller doc_id; windows are
judged on the input.

1.  Anchors.  `COVER` is a difference cover modulo `PERIOD`: for every two positions
    there is a shift below PERIOD that takes both onto cover positions.  So two equal
    windows share an aligned anchor, the `length - PERIOD + 1` words at a cover
    position, and only 5 of 21 positions are hashed.  One shuffle by hash brings equal
    anchors together; an anchor is a few numbers, no text.  In an Arrow batch only the
    first document with an anchor goes to the anchor's partition; the others already
    have a document before them, their lead, and are routed at random, so that a
    passage held by a third of all documents sends one row of a batch to its key; an
    anchor that a document repeats is one row with a list of places.
2.  Leads.  Every anchor that a smaller document holds too gets one such place as its
    lead.  An anchor of the smallest document is told that others share it.
3.  Extension along the diagonal.  Anchors of a document with the same lead document
    and the same distance that overlap make one stretch of equal words: the windows in
    it are repeats.
4.  Extension at the ends.  The other windows around a shared anchor, at most
    `PERIOD` on each side of a stretch, are extended word by word: each start gets the
    128-bit hash of its whole window.  The smallest document with a window is always
    among them (no smaller one can have settled it in 3), so the later ones of a hash
    are exactly the repeats that are left.  Batches settle their own copies first, as
    in 1.
5.  The spans of a document meet its text in one more join, for which Spark reuses the
    exchange of step 4.

Cases: null or empty text, or white space only -> no words, nothing removed, kept is
the empty text.  A null doc_id counts as smaller than all others; documents without
doc_id are not compared with each other, as neither is smaller, and the same holds for
several texts of one doc_id.  Rows that repeat doc_id and text give equal results.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import U64, ByteHash, batches, chunks, mix, runs, string_bytes, table_of, task
from .tables import cut
from .words import SequenceHash, word_bounds

LENGTH = 50
PERIOD = 21
#: Every distance modulo 21 is the difference of two of these.
COVER = (0, 1, 4, 14, 16)

NO_ID = -(1 << 63)
#: lead_pos of an anchor: without a lead, or the first one and known to be shared.
ALONE, SHARED = -1, -2
_FIRST, _SECOND = table_of(41), table_of(43)
ANCHORS = pa.schema([("route", pa.int64()), ("key", pa.int64()), ("doc", pa.int64()), ("copy", pa.int64()), ("pos", pa.list_(pa.int32())), ("lead", pa.int64()), ("lead_pos", pa.int32())])
LED = pa.schema([("doc", pa.int64()), ("copy", pa.int64()), ("pos", pa.list_(pa.int32())), ("lead", pa.int64()), ("lead_pos", pa.int32())])
#: `len` starts of repeated windows from pos on, or (0) a window still to be compared.
WINDOWS = pa.schema([("route", pa.int64()), ("one", pa.int64()), ("two", pa.int64()), ("doc", pa.int64()), ("copy", pa.int64()), ("pos", pa.list_(pa.int32())), ("len", pa.int32())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.list_(pa.int32()): "array<int>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _columns(batch: pa.RecordBatch, n: int) -> list[np.ndarray]:
    return [np.asarray(batch.column(i)) for i in range(n)]


def _table(schema: pa.Schema, *columns: np.ndarray | pa.Array) -> pa.Table:
    cols = (c if isinstance(c, pa.Array) else pa.array(c.view(np.int64) if c.dtype == U64 else c) for c in columns)
    return pa.table([c.cast(f.type) for c, f in zip(cols, schema)], schema=schema)


def _places(first: np.ndarray, pos: np.ndarray) -> pa.Array:
    """Lists of the places from first[i] up to first[i + 1]."""
    return pa.ListArray.from_arrays(pa.array(np.r_[first, len(pos)], pa.int32()), pa.array(pos, pa.int32()))


def _scattered(doc: np.ndarray, copy: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """A route for rows that need not meet others."""
    return mix(mix(doc.view(U64) + copy.view(U64)) + pos.astype(U64))


def _starts(*by: np.ndarray) -> np.ndarray:
    """Where runs of equal neighbours start."""
    new = np.ones(len(by[0]), bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in by])
    return np.flatnonzero(new)


def is_cover(cover: Sequence[int], period: int) -> bool:
    """Whether every distance modulo `period` is a difference of two cover positions."""
    return {(x - y) % period for x in cover for y in cover} == set(range(period))


def anchors(docs: DataFrame, length: int = LENGTH, period: int = PERIOD, cover: Sequence[int] = COVER) -> DataFrame:
    """The anchors of a table (doc, copy, text).  Where lead_pos >= 0, the batch holds the
    anchor in a smaller document and `route` is arbitrary; otherwise it is the key."""
    if not is_cover(cover, period) or period > length:
        raise ValueError(f"{tuple(cover)} is no difference cover modulo {period} for windows of {length} words")
    seed = length - period + 1
    at_cover = np.isin(np.arange(period), cover)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids, copies = _columns(batch, 2)
            data, off = string_bytes(batch.column(2))
            parts = []
            for a, b in chunks(off):
                raw, o = data[off[a]:off[b]], off[a:b + 1] - off[a]
                start, end, row = word_bounds(raw, o)
                if len(start) < length:
                    continue
                count = np.bincount(row, minlength=b - a)
                pos = np.arange(len(start)) - np.repeat(np.cumsum(count) - count, count)
                left = count[row] - pos
                take = np.flatnonzero(at_cover[pos % period] & (left >= seed) & (count[row] >= length))
                h = SequenceHash(ByteHash(raw, _FIRST)(start, end))
                parts.append((h(take, seed), ids[a + row[take]], copies[a + row[take]], pos[take]))
            if not parts:
                continue
            key, doc, copy, pos = (np.concatenate(x) for x in zip(*parts))
            by = np.lexsort((pos, copy, doc, key))
            key, doc, copy, pos = key[by], doc[by], copy[by], pos[by]
            first = _starts(key, doc, copy)  # an anchor that a document repeats is one row with all its places
            places = _places(first, pos)
            key, doc, copy, pos = key[first], doc[first], copy[first], pos[first]
            edge = runs(key)
            first = np.repeat(edge[:-1], np.diff(edge))
            led = doc != doc[first]
            told = np.zeros(len(key), bool)  # the first of an anchor that later documents of the batch hold
            told[first[led]] = True
            route = np.where(led, mix(key + np.arange(len(key), dtype=U64)), key)
            lead_pos = np.where(led, pos[first], np.where(told, SHARED, ALONE))
            yield from batches(_table(ANCHORS, route, key, doc, copy, places, np.where(led, doc[first], 0), lead_pos), ANCHORS)

    return docs.mapInArrow(task(run), _ddl(ANCHORS))


def led_anchors(found: DataFrame) -> DataFrame:
    """The anchors that several documents hold, each with a lead; lead_pos is ALONE for
    those of the smallest document."""
    rows = found.repartition("route").sortWithinPartitions("key", "doc")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_now, lead, shared = None, (0, 0), False
        held: list[pa.RecordBatch] = []  # anchors of the smallest document at hand, not yet known to be shared

        def led(part: pa.RecordBatch, lead: np.ndarray | None = None, at: np.ndarray | None = None) -> pa.Table:
            n = len(part)
            return _table(LED, *(part.column(i) for i in (2, 3, 4)), np.zeros(n, np.int64) if lead is None else lead, np.full(n, ALONE) if at is None else at)

        for batch in it:
            at = np.asarray(batch.column(6))
            known = np.flatnonzero(at >= 0)
            if len(known):
                part = batch.take(pa.array(known))
                yield from batches(led(part, np.asarray(part.column(5)), at[known]), LED)
                batch = batch.take(pa.array(np.flatnonzero(at < 0)))
            if not len(batch):
                continue
            _, key, doc = _columns(batch, 3)
            told = np.asarray(batch.column(6)) == SHARED
            edge = runs(key)
            size = np.diff(edge)
            lists = batch.column(4)
            lead_doc, lead_at = doc[edge[:-1]].copy(), np.asarray(lists.flatten())[(np.asarray(lists.offsets) - np.asarray(lists.offsets)[0])[edge[:-1]]].copy()
            goes_on = key[0] == key_now
            if goes_on:
                lead_doc[0], lead_at[0] = lead
            first = doc == np.repeat(lead_doc, size)
            several = np.logical_or.reduceat(~first | told, edge[:-1])
            if goes_on:
                several[0] |= shared
            if held:
                if goes_on and several[0]:
                    for part in held:
                        yield from batches(led(part), LED)
                if not goes_on or several[0]:
                    held = []
            later = np.flatnonzero(~first)
            if len(later):
                group = np.searchsorted(edge, later, "right") - 1
                yield from batches(led(batch.take(pa.array(later)), lead_doc[group], lead_at[group]), LED)
            own = np.flatnonzero(first & np.repeat(several, size))
            if len(own):
                yield from batches(led(batch.take(pa.array(own))), LED)
            key_now, lead, shared = key[-1], (lead_doc[-1], lead_at[-1]), bool(several[-1])
            if not shared:
                held.append(batch.slice(edge[-2]))

    return rows.mapInArrow(task(run), _ddl(LED))


def stretches(pos: np.ndarray, lead: np.ndarray, lead_pos: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """[start, end) of the stretches of overlapping anchors with one lead document and one
    distance."""
    by = np.lexsort((pos, lead_pos - pos, lead))
    pos, lead, far = pos[by], lead[by], (lead_pos - pos)[by]
    new = np.ones(len(pos), bool)
    new[1:] = (lead[1:] != lead[:-1]) | (far[1:] != far[:-1]) | (pos[1:] > pos[:-1] + seed)
    edge = np.r_[np.flatnonzero(new), len(pos)]
    return pos[edge[:-1]], pos[edge[1:] - 1] + seed


def _marked(n: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A mask of n places: those in any of the ranges [lo, hi)."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, lo, 1)
    np.add.at(step, hi, -1)
    return np.cumsum(step[:n]) > 0


def _lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of a column of lists of structs (places, ...): the first place and the number of
    places of each row, all places, and the other fields at each place."""
    size = np.asarray(pc.fill_null(pc.list_value_length(col), 0))
    places, *others = col.flatten().flatten()
    count = np.asarray(pc.list_value_length(places))
    edge = np.r_[0, np.cumsum(count)][np.r_[0, np.cumsum(size)]]
    return edge[:-1], np.diff(edge), [np.asarray(places.flatten()).astype(np.int64)] + [np.repeat(np.asarray(x).astype(np.int64), count) for x in others]


def windows(led: DataFrame, docs: DataFrame, length: int = LENGTH, period: int = PERIOD) -> DataFrame:
    """Spans of windows that a stretch settles, and the hashes of the others around a
    shared anchor."""
    seed = length - period + 1
    listed = led.groupBy("doc", "copy").agg(F.collect_set(F.struct("pos", "lead", "lead_pos")).alias("anchors"))
    rows = docs.join(listed, ["doc", "copy"]).select("doc", "copy", "text", "anchors")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids, copies = _columns(batch, 2)
            data, off = string_bytes(batch.column(2))
            at, size, (pos, lead, lead_pos) = _lists(batch.column(3))
            spans, asked = [], []
            for a, b in chunks(off):
                raw, o = data[off[a]:off[b]], off[a:b + 1] - off[a]
                start, end, row = word_bounds(raw, o)
                count = np.bincount(row, minlength=b - a)
                base = np.cumsum(count) - count
                places = []
                for i in range(a, b):
                    n = int(count[i - a])
                    part = slice(at[i], at[i] + size[i])
                    p = pos[part]
                    if n < length or not len(p):
                        continue
                    lo, hi = np.maximum(p + seed - length, 0), np.minimum(p, n - length) + 1
                    near = _marked(n, lo, np.maximum(lo, hi))
                    has = lead_pos[part] >= 0
                    if has.any():
                        s, e = stretches(p[has], lead[part][has], lead_pos[part][has], seed)
                        whole = e - s >= length
                        s, e = s[whole], e[whole]
                        if len(s):
                            near &= ~_marked(n, s, e - length + 1)
                            spans.append((np.full(len(s), i), s, e - length + 1 - s))
                    places.append(base[i - a] + np.flatnonzero(near))
                if places and len(take := np.concatenate(places)):
                    one, two = (SequenceHash(ByteHash(raw, t)(start, end))(take, length) for t in (_FIRST, _SECOND))
                    asked.append((one, two, a + row[take], take - base[row[take]]))
            if spans:
                i, p, n = (np.concatenate(x) for x in zip(*spans))
                r = _scattered(ids[i], copies[i], p)
                yield from batches(_table(WINDOWS, r, r, r, ids[i], copies[i], _places(np.arange(len(p)), p), n), WINDOWS)
            if asked:
                one, two, i, p = (np.concatenate(x) for x in zip(*asked))
                doc, copy = ids[i], copies[i]
                by = np.lexsort((p, copy, doc, two, one))
                one, two, p, doc, copy = one[by], two[by], p[by], doc[by], copy[by]
                first = _starts(one, two, doc, copy)  # a window that a document repeats is one row
                places = _places(first, p)
                one, two, p, doc, copy = one[first], two[first], p[first], doc[first], copy[first]
                edge = np.r_[_starts(one, two), len(one)]
                again = doc != np.repeat(doc[edge[:-1]], np.diff(edge))  # the batch has it in a smaller document
                route = np.where(again, _scattered(doc, copy, p), one)
                yield from batches(_table(WINDOWS, route, one, two, doc, copy, places, again.astype(np.int64)), WINDOWS)

    return rows.mapInArrow(task(run), _ddl(WINDOWS))


def repeated_starts(found: DataFrame) -> DataFrame:
    """(doc, copy, pos, len): starts of the repeated windows among `windows`."""
    rows = found.repartition("route").sortWithinPartitions("one", "two", "doc")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first_now = None, 0
        for batch in it:
            _, one, two, doc = _columns(batch, 4)
            size = np.asarray(batch.column(6))
            out = size > 0
            open_ = np.flatnonzero(~out)
            if len(open_):
                o, t, d = one[open_], two[open_], doc[open_]
                new = np.ones(len(o), bool)
                new[1:] = (o[1:] != o[:-1]) | (t[1:] != t[:-1])
                new[0] = (o[0], t[0]) != now
                lead = np.maximum.accumulate(np.where(new, np.arange(len(o)), -1))
                first = np.where(lead >= 0, d[lead], first_now)
                out[open_[d != first]] = True
                now, first_now = (o[-1], t[-1]), first[-1]
            if out.any():
                part = batch.filter(pa.array(out))
                yield pa.record_batch([*(part.column(i) for i in (3, 4, 5)), pa.array(np.maximum(size[out], 1))], names=["doc", "copy", "pos", "len"])

    return rows.mapInArrow(task(run), "doc long, copy long, pos array<int>, len int")


def without_passages(docs: DataFrame, length: int = LENGTH, period: int = PERIOD, cover: Sequence[int] = COVER) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space) and
    removed (array of struct<start, words>, the runs of removed words) of every row of
    `docs` (doc_id, text)."""
    text = F.col("text").cast("string")
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("copy"), text.alias("text"))
    led = cut(led_anchors(anchors(keyed, length, period, cover)))
    spans = repeated_starts(windows(led, keyed, length, period)).groupBy("doc", "copy").agg(F.collect_set(F.struct("pos", "len")).alias("spans"))
    rows = keyed.join(spans, ["doc", "copy"], "left").select("doc", "text", "spans")
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()),
                        ("removed", pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())])))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data, off = string_bytes(batch.column(1))
            at, size, (pos, more) = _lists(batch.column(2))
            for lo in range(0, len(batch), 500):
                out = []
                for i in range(lo, min(lo + 500, len(batch))):
                    words = data[off[i]:off[i + 1]].tobytes().split()
                    kept, removed = words, []
                    if size[i]:
                        part = slice(at[i], at[i] + size[i])
                        gone = _marked(len(words), pos[part], np.minimum(pos[part] + more[part] - 1 + length, len(words)))
                        kept = [w for w, g in zip(words, gone.tolist()) if not g]
                        edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8))).tolist()
                        removed = [{"start": s, "words": e - s} for s, e in zip(edge[::2], edge[1::2])]
                    out.append((len(words), len(words) - len(kept), b" ".join(kept).decode(), removed))
                n, m, kept, removed = zip(*out)
                ids = batch.column(0).slice(lo, len(out))
                yield pa.record_batch([pc.if_else(pc.equal(ids, NO_ID), None, ids), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(kept, pa.string()), pa.array(removed, schema.field(4).type)], schema=schema)

    return rows.mapInArrow(task(run), "doc_id long, n_words long, n_removed long, kept string, removed array<struct<start: long, words: long>>")
