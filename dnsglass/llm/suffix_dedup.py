"""Removal of repeated passages by suffix arrays (operator 1).

A byte is removed if a string of LENGTH bytes that covers it also starts earlier:
in a document with a smaller doc_id, or earlier in the same one.  Everything is
judged on the input.  A document is a doc_id and a text: all numbers below carry
doc (the doc_id) and copy (the text's 64-bit hash), and joins are on both.

1.  Anchors.  A string of LENGTH bytes has one anchor, its least 16-byte gram by
    hash.  Equal strings have equal anchors at equal offsets, so the starts of a
    document fall into short pieces of neighbours with the same anchor (and the same
    half of the offsets), and two equal strings lie in pieces that share the bytes
    common to all of the piece's strings: the piece's key.  One shuffle by key
    brings them together; a piece is a few numbers, no text.  Copies inside an Arrow
    batch are settled before the shuffle and routed at random, so a passage that
    a third of the documents hold sends one row of a batch to its key.
2.  Of the pieces of a key that are equal as a whole, the first is kept and the
    starts of the others are repeats.  A key that has several different pieces
    (the borders of a copied passage) goes on to 3.
3.  The bytes of those pieces are fetched by a join on doc and copy.  The pieces of a key
    form one small text, and its suffix array (`lyndon.suffix_arrays`) puts equal
    strings next to each other: all but the earliest of a run are repeats.  Keys
    with more than `MOST` different pieces are split further instead: each of
    their strings becomes a row keyed by its own hash, which needs no text.
4.  The spans of a document meet its text in one more join on doc and copy, for which
    Spark reuses the exchange of step 3.

Cases: null or empty text -> 0 bytes, nothing removed.  A null doc_id counts as
smaller than all others.  Rows that repeat doc_id and text are one document and
give equal results, also without a doc_id.  Different texts of one doc_id, or
without one, are different documents, in the order of their copy.  Extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import CHUNK_BYTES, U64, batches, chunks, mix, runs, spread, string_bytes, table_of, task, ByteHash
from .lyndon import suffix_arrays
from .tables import cut

LENGTH = 100
GRAM = 16
#: Different pieces of a key up to which they are sorted as one text.
MOST = 48
#: Characters handed to one call of the suffix sorter.
SORT_CHARS = 1 << 20

NO_ID = -(1 << 63)
REPEAT, PIECE, SPLIT = 0, 1, 2
_GRAMS = table_of(17)
_SECOND = table_of(23)
PIECES = pa.schema([("route", pa.int64()), ("key", pa.int64()), ("same", pa.int64()), ("doc", pa.int64()), ("copy", pa.int64()), ("pos", pa.int64()), ("len", pa.int32())])
FOUND = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("doc", pa.int64()), ("copy", pa.int64()), ("pos", pa.int64()), ("len", pa.int32())])
SEGMENTS = pa.schema([("key", pa.int64()), ("same", pa.int64()), ("doc", pa.int64()), ("copy", pa.int64()), ("pos", pa.int64()), ("len", pa.int32()), ("bytes", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of `width` values."""
    step = 1
    while 2 * step <= width:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    if rest := width - step:
        values = np.minimum(values[:-rest], values[rest:])
    return values


def find_pieces(data: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(first start, number of starts, key, whole) of the pieces of the rows that are
    laid one after the other in `data`; `ends` has each byte's row end."""
    width = length - GRAM + 1
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, U64),) * 2
    h = _GRAMS[data]
    step = 1
    while step < GRAM:
        h = h[:-step] * U64(0x9E3779B97F4A7C15 + 2 * step) + h[step:]
        step *= 2
    h ^= h >> U64(29)
    h *= U64(0xBF58476D1CE4E5B9)
    bits = U64(int(len(h)).bit_length())
    h >>= bits  # the hash's upper bits, then the position: ties go to the leftmost
    h <<= bits
    h |= np.arange(len(h), dtype=U64)
    anchor = (_least(h, width) & ((U64(1) << bits) - U64(1))).astype(np.int64)
    starts = np.arange(len(anchor))
    valid = starts + length <= ends[:len(anchor)]
    half = width // 2
    upper = anchor - starts > half
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (upper[1:] != upper[:-1]) | ~valid[:-1]
    last = np.ones(len(anchor), bool)
    last[:-1] = new[1:] | ~valid[1:]
    first = np.flatnonzero(new & valid)
    size = np.flatnonzero(last & valid) - first + 1
    at, up = anchor[first], upper[first]
    least, most = np.where(up, half + 1, 0), np.where(up, width - 1, half)
    one, two = ByteHash(data), ByteHash(data, _SECOND)
    key = one(at - least, at - most + length) * np.where(up, U64(3), U64(1))
    whole = two(first, first + size - 1 + length)
    return first, size, key, whole


def _views(col: pa.Array, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets, row of each byte's end, shift) for parts of a text
    column; a long text comes in parts that overlap by length - 1 bytes."""
    data, off = string_bytes(col)
    for a, b in chunks(off):
        lo, hi = int(off[a]), int(off[b])
        if hi - lo <= 4 * CHUNK_BYTES or b > a + 1:
            o = off[a:b + 1] - lo
            yield a, data[lo:hi], o, np.repeat(o[1:], np.diff(o)), np.zeros(b - a, np.int64)
        else:
            for s in range(lo, hi - length + 1, CHUNK_BYTES):
                e = min(hi, s + CHUNK_BYTES + length - 1)
                yield a, data[s:e], np.array([0, e - s]), np.full(e - s, e - s), np.array([s - lo])


def _order(*by: np.ndarray) -> np.ndarray:
    """Stable order by the given columns, the first one weighs most."""
    return np.lexsort(by[::-1])


def _copy(text: Column) -> Column:
    return F.xxhash64(text).alias("copy")


def pieces(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """route, key, same, doc, copy, pos, len of every piece of a table (doc, text); where
    route is not the key, an equal piece of the batch comes earlier, and the row is a
    repeat."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            batch = batch.take(pa.array(_order(*_columns(batch, 2))))
            ids, copies = _columns(batch, 2)
            parts = []
            for a, data, off, ends, shift in _views(batch.column(2), length):
                first, size, key, whole = find_pieces(data, ends, length)
                row = np.searchsorted(off, first, "right") - 1
                parts.append((ids[a + row], copies[a + row], first - off[row] + shift[row], size.astype(np.int32), key, whole))
            if not parts:
                continue
            doc, copy, pos, size, key, whole = (np.concatenate(x) for x in zip(*parts))
            both = mix(key + whole * U64(0xC2B2AE3D27D4EB4F))
            order = np.argsort(both, kind="stable")
            lead = np.empty(len(both), np.int64)  # the first of the equal pieces
            edge = runs(both[order])
            lead[order] = np.repeat(order[edge[:-1]], np.diff(edge))
            again = (doc != doc[lead]) | (copy != copy[lead]) | (pos != pos[lead])
            route = np.where(again, mix(both + np.arange(len(both), dtype=U64)) | U64(1), key & ~U64(1))
            key = key & ~U64(1)
            yield from batches(pa.table([pa.array(x.view(np.int64)) for x in (route, key, whole)] + [pa.array(doc), pa.array(copy), pa.array(pos), pa.array(size)], schema=PIECES), PIECES)

    doc, text = docs.columns
    return docs.select(doc, _copy(F.col(text)), text).mapInArrow(task(run), _ddl(PIECES))


def _columns(batch: pa.RecordBatch, n: int) -> list[np.ndarray]:
    return [np.asarray(batch.column(i)) for i in range(n)]


def settle(found: DataFrame) -> DataFrame:
    """REPEAT rows, and of every key with different pieces the first of each kind
    (PIECE, or SPLIT if there are more than MOST)."""
    rows = found.repartition("route").sortWithinPartitions("key", "same", "doc", "copy", "pos")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # of the last key: its firsts that are not yet told (rows of key, doc, copy, pos, len)
        key_now, same_now, many = None, None, False
        first_now = np.zeros(3, np.int64)  # doc, copy and pos of the first of the equal pieces at hand

        def told(kind: int, x: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([pa.array(np.full(x.shape[1], kind, np.int32)), *(pa.array(y) for y in x[:4]), pa.array(x[4].astype(np.int32))], schema=FOUND)

        def closed() -> Iterator[pa.RecordBatch]:
            if held:
                x = np.concatenate(held, axis=1)
                if many or x.shape[1] > 1:
                    yield told(SPLIT if many or x.shape[1] > MOST else PIECE, x)
                held.clear()

        for batch in it:
            route, key, same, doc, copy, pos, size = _columns(batch, 7)
            known = route != key
            rows = np.stack([key, doc, copy, pos, size.astype(np.int64)])
            if known.any():
                yield told(REPEAT, rows[:, known])
                keep = ~known
                key, same, rows = key[keep], same[keep], rows[:, keep]
            if not len(key):
                continue
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (same[1:] != same[:-1])
            fresh[0] = key[0] != key_now or same[0] != same_now
            lead = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), -1))
            first = np.where(lead >= 0, rows[1:4, lead], first_now[:, None])
            yield told(REPEAT, rows[:, (rows[1:4] != first).any(axis=0)])  # a repeated row is no repeat of itself
            first_now = first[:, -1].copy()
            same_now, last = same[-1], key[-1]
            firsts = rows[:, fresh]
            edge = runs(firsts[0])
            count = np.diff(edge)
            if len(count) and firsts[0, 0] == key_now:  # these belong to the key held
                held.append(firsts[:, :count[0]])
                firsts, edge, count = firsts[:, count[0]:], edge[1:] - count[0], count[1:]
            if len(count):  # another key has begun
                yield from closed()
                many = False
                whole, n = firsts[:, :edge[-2]], np.repeat(count[:-1], count[:-1])
                yield told(PIECE, whole[:, (n > 1) & (n <= MOST)])
                yield told(SPLIT, whole[:, n > MOST])
                held.append(firsts[:, edge[-2]:])
            if sum(x.shape[1] for x in held) > MOST:
                many = True
                yield from closed()
            key_now = last
        yield from closed()

    return rows.mapInArrow(task(run), _ddl(FOUND))


def _text(rows: pa.StructArray) -> pa.Array:
    """The text of a column of structs (text, ...)."""
    return pc.struct_field(rows, [0])


def segments(open_pieces: DataFrame, docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The bytes of every PIECE, and a row for every string of a SPLIT (no bytes)."""
    listed = open_pieces.groupBy("doc", "copy").agg(F.collect_list(F.struct("kind", "key", "pos", "len")).alias("pieces"))
    rows = docs.join(listed, ["doc", "copy"]).select("doc", "copy", "row", "pieces")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data, off = string_bytes(_text(batch.column(2)))
            (ids, copies), lists = _columns(batch, 2), batch.column(3)
            at = np.asarray(lists.offsets)
            kind, key, pos, size = (np.asarray(x) for x in lists.values.flatten())
            for i in range(len(batch)):
                a, b = at[i], at[i + 1]
                text = data[off[i]:off[i + 1]]
                raw = text.tobytes()
                cols: list[list] = [[], [], [], [], []]
                for k, p, n in zip(key[a:b][kind[a:b] == PIECE].tolist(), pos[a:b][kind[a:b] == PIECE].tolist(), size[a:b][kind[a:b] == PIECE].tolist()):
                    for c, v in zip(cols, (k, 0, p, n, raw[p:p + n - 1 + length])):
                        c.append(v)
                if cols[0]:
                    yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(np.full(len(cols[0]), ids[i])), pa.array(np.full(len(cols[0]), copies[i])),
                                           pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.binary())], schema=SEGMENTS)
                split = kind[a:b] == SPLIT
                if split.any():
                    start = spread(pos[a:b][split], size[a:b][split].astype(np.int64))
                    lo, hi = int(start.min()), int(start.max()) + length
                    one, two = ByteHash(text[lo:hi]), ByteHash(text[lo:hi], _SECOND)
                    k, s = one(start - lo, start - lo + length), two(start - lo, start - lo + length)
                    yield from batches(pa.table([pa.array((k | U64(1)).view(np.int64)), pa.array(s.view(np.int64)), pa.array(np.full(len(start), ids[i])), pa.array(np.full(len(start), copies[i])), pa.array(start),
                                                 pa.array(np.ones(len(start), np.int32)), pa.nulls(len(start), pa.binary())], schema=SEGMENTS), SEGMENTS)

    return rows.mapInArrow(task(run), _ddl(SEGMENTS))


def repeats_in(blocks: list[list[tuple[int, int, int, int, bytes]]], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, copy, pos) of the repeated strings of each block of segments (doc, copy, pos,
    number of starts, bytes): suffix arrays of all blocks, then runs of equal strings."""
    found = []
    a = 0
    sizes = np.array([sum(len(s[4]) + 1 for s in b) + 1 for b in blocks])
    order = np.argsort(sizes, kind="stable")
    while a < len(order):
        b = max(a + 1, a + int(np.searchsorted(np.cumsum(sizes[order[a:]]), SORT_CHARS, "right")))
        part = [blocks[i] for i in order[a:b]]
        size = sizes[order[a:b]]
        segs = [s for block in part for s in block]
        # a separator (1) after each segment, the least symbol (0) after each block
        width = np.array([len(s[4]) for s in segs])
        tail = np.zeros(len(segs), np.int64)
        tail[np.cumsum([len(x) for x in part]) - 1] = 1
        first = np.cumsum(width + 1 + tail) - (width + 1 + tail)
        symbols = np.zeros(int(size.sum()), np.int64)
        symbols[first + width] = 1
        flat = np.frombuffer(b"".join(s[4] for s in segs), np.uint8)
        symbols[spread(first, width)] = flat.astype(np.int64) + 2
        suffixes = suffix_arrays(symbols, size)
        starts = np.array([s[3] for s in segs])
        place = spread(first, starts)  # where a whole string of `length` starts
        seg = np.full(len(symbols), -1)
        seg[place] = np.repeat(np.arange(len(segs)), starts)
        ranked = suffixes[seg[suffixes] >= 0]
        text = symbols.astype(np.uint16)
        same = np.zeros(len(ranked), bool)
        windows = np.lib.stride_tricks.sliding_window_view(text, length)
        block = np.repeat(np.arange(len(part)), size)[ranked]
        for lo in range(1, len(ranked), 20_000):
            x, y = ranked[lo - 1:lo + 19_999], ranked[lo:lo + 20_000]
            same[lo:lo + 20_000] = (windows[x[:len(y)]] == windows[y]).all(axis=1)
        same[1:] &= block[1:] == block[:-1]
        group = np.cumsum(~same)
        s = seg[ranked]
        doc = np.array([x[0] for x in segs], np.int64)[s]
        copy = np.array([x[1] for x in segs], np.int64)[s]
        pos = np.array([x[2] for x in segs], np.int64)[s] + ranked - first[s]
        by = _order(group, doc, copy, pos)
        edge = runs(group[by])
        lead = np.repeat(by[edge[:-1]], np.diff(edge))
        later = (doc[by] != doc[lead]) | (copy[by] != copy[lead]) | (pos[by] != pos[lead])
        found.append((doc[by[later]], copy[by[later]], pos[by[later]]))
        a = b
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def sort_segments(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc, copy, pos, len) of the repeats among segments: suffix arrays per key, and the
    later ones of equal split strings."""
    rows = rows.repartition("key").sortWithinPartitions("key", "same", "doc", "copy", "pos")

    def spans(doc: np.ndarray, copy: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
        by = _order(doc, copy, pos)
        doc, copy, pos = doc[by], copy[by], pos[by]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (copy[1:] != copy[:-1]) | (pos[1:] > pos[:-1] + 1)
        edge = np.r_[np.flatnonzero(new), len(doc)]
        return pa.record_batch([*(pa.array(x[edge[:-1]]) for x in (doc, copy, pos)),
                                pa.array((pos[edge[1:] - 1] - pos[edge[:-1]] + 1).astype(np.int32))], names=["doc", "copy", "pos", "len"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: list[list[tuple[int, int, int, int, bytes]]] = []
        chars, key_now, before = 0, None, None
        first_now = np.zeros(3, np.int64)
        for batch in it:
            key, same, doc, copy, pos, size = _columns(batch, 6)
            text = batch.column(6)
            single = np.asarray(text.is_null())
            if single.any():
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (same[1:] != same[:-1])
                new[0] = (key[0], same[0]) != before
                lead = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
                at = np.stack([doc, copy, pos])
                first = np.where(lead >= 0, at[:, lead], first_now[:, None])
                first_now = first[:, -1].copy()
                again = single & (at != first).any(axis=0)
                if again.any():
                    yield spans(*at[:, again])
            before = (key[-1], same[-1])
            for i in np.flatnonzero(~single).tolist():
                if key[i] != key_now:
                    if chars > SORT_CHARS:
                        yield spans(*repeats_in(blocks, length))
                        blocks, chars = [], 0
                    blocks.append([])
                    key_now = key[i]
                raw = text[i].as_py()
                blocks[-1].append((int(doc[i]), int(copy[i]), int(pos[i]), int(size[i]), raw))
                chars += len(raw)
        if blocks:
            yield spans(*repeats_in(blocks, length))

    return rows.mapInArrow(task(run), "doc long, copy long, pos long, len int")


def merge_spans(pos: np.ndarray, size: np.ndarray, n_bytes: int, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed runs [start, end) from repeated starts pos .. pos + size - 1."""
    by = np.argsort(pos, kind="stable")
    lo, hi = pos[by], np.minimum((pos + size - 1 + length)[by], n_bytes)
    reach = np.maximum.accumulate(hi)
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return lo[first], reach[np.r_[first[1:], len(lo)] - 1]


def repeated_spans(docs: DataFrame, length: int = LENGTH, also: list[str] | None = None) -> DataFrame:
    """(doc, row struct<text, ...>, spans array<struct<pos, len>>) of every row: the
    starts of its repeated strings, null if there are none.  doc is NO_ID where
    doc_id is null; the struct holds the other columns asked for."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), _copy(F.col("text").cast("string")),
                       F.struct(F.col("text").cast("string").alias("text"), *(F.col(f"`{c}`") for c in also or [])).alias("row"))
    found = cut(settle(pieces(docs.select("doc", F.col("row.text").alias("text")), length)))
    rest = found.filter(F.col("kind") != REPEAT)
    spans = found.filter(F.col("kind") == REPEAT).select("doc", "copy", "pos", "len").union(
        sort_segments(segments(rest, docs, length), length))
    listed = spans.groupBy("doc", "copy").agg(F.collect_list(F.struct("pos", "len")).alias("spans"))
    return docs.join(listed, ["doc", "copy"], "left").select("doc", "row", "spans")


def _removed(batch: pa.RecordBatch, length: int) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray]]:
    data, off = string_bytes(_text(batch.column(1)))
    lists = batch.column(2)
    at = np.asarray(lists.offsets)
    pos, size = (np.asarray(x).astype(np.int64) for x in lists.values.flatten())
    has = np.asarray(lists.is_valid())
    for i in range(len(batch)):
        raw = data[off[i]:off[i + 1]].tobytes()
        lo, hi = merge_spans(pos[at[i]:at[i + 1]], size[at[i]:at[i + 1]], len(raw), length) if has[i] and len(raw) and at[i + 1] > at[i] else (np.zeros(0, np.int64),) * 2
        yield i, raw, lo, hi


def _kept(raw: bytes, lo: np.ndarray, hi: np.ndarray) -> bytes:
    starts, ends = [0, *hi.tolist()], [*lo.tolist(), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(starts, ends))


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = [(len(raw), int((hi - lo).sum()), len(lo), hashlib.sha256(_kept(raw, lo, hi)).hexdigest()) for _, raw, lo, hi in _removed(batch, length)]
            ids = [None if x == NO_ID else x for x in batch.column(0).to_pylist()]
            cols = list(zip(*out)) or [()] * 4
            yield pa.record_batch([pa.array(ids, pa.int64()), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())],
                                  names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return repeated_spans(docs, length).mapInArrow(task(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows of `docs`, all columns, with the repeats taken out of text (a character
    that is only partly covered stays whole) and n_chars, if there is one, counted anew."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    schema = docs.schema

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out, rows = [], batch.column(1)
            for _, raw, lo, hi in _removed(batch, length):
                if len(lo):
                    lead = (np.frombuffer(raw + b"\0", np.uint8) & 0xC0) != 0x80  # where characters start
                    begins = np.flatnonzero(lead)
                    lo = begins[np.searchsorted(begins, lo)]
                    hi = begins[np.searchsorted(begins, hi, "right") - 1]
                    keep = hi > lo
                    lo, hi = lo[keep], hi[keep]
                out.append(_kept(raw, lo, hi).decode())
            text = pa.array(out, pa.string())
            made = {"doc_id": pc.if_else(pc.equal(batch.column(0), NO_ID), None, batch.column(0)),
                    "text": pc.if_else(pc.is_null(_text(rows)), None, text)}
            for i, c in enumerate(others, 1):
                made[c] = pc.struct_field(rows, [i])
            if "n_chars" in made:
                made["n_chars"] = pc.if_else(pc.is_null(made["n_chars"]), None, pc.utf8_length(text)).cast(made["n_chars"].type)
            yield pa.record_batch([made[f.name] for f in schema.fields], names=[f.name for f in schema.fields])

    return repeated_spans(docs, length, others).mapInArrow(task(run), schema)
