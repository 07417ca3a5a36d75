"""MinHash near-duplicates with tensored banding (operator 7).

Words are runs of bytes other than space and \\t..\\r after lower-casing A-Z; a
document's set holds its distinct 5-word shingles (all words as one shingle if
there are fewer).  Documents with equal sets form one class.

Candidates.  Two collections of `SIDE` band hashes, each of `WIDTH` minhashes, are
made for a class; every pair (i, j) of one hash from each forms the key of one of
SIDE * SIDE tables.  So SIDE * SIDE tables of 2 * WIDTH rows cost 2 * SIDE * WIDTH
minhashes instead of 2 * SIDE * SIDE * WIDTH.  A pair of similarity s meets with
probability (1 - (1 - s**WIDTH)**SIDE)**2: 0.9995 at 0.75, 0.99993 at 0.8, for one
pair by itself.

Verification.  The classes of all buckets that begin with one class (the lead) form a
group.  Inside the tasks full sets are compared, and what leaves a task is one edge per
member, to the least member that it is connected with by verified links: no pairs of
a group are made.
1.  A group is cut into parts of about `PART` members, and the lead goes to each of them:
    every text travels once per group, however large the group is.  The links found give
    components over all groups.
2.  Members of one group that are still in different components may have links between
    parts.  The members outside the group's largest component are compared with each
    other and with that component, in pairs of blocks of about `BLOCK` members.  So a
    group whose members all hang together costs nothing here, and one with r members
    left over sends a text of the largest component r / BLOCK times.
A link between any two members of a group is found by 1, or joins what is one component
already, or is found by 2.

Cases: null or empty text or white space only -> empty set, linked with nothing,
its own component.  Rows without doc_id keep a null component unless their text
equals another's.  Rows that repeat a doc_id are one node.  Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import U64, chunks, mix, string_bytes, task, ByteHash
from .components import components
from .tables import cut, texts

SHINGLE = 5
#: Least likeness in hundredths.
PERCENT = 75
SIDE, WIDTH = 10, 2
PART, BLOCK = 128, 512
#: Tasks over which the members of one lead are dealt.
SALTS = 16

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = mix(np.arange(1, 64, dtype=U64) * U64(0xA0761D6478BD642F)) | U64(1)
_XOR = mix(np.arange(101, 201, dtype=U64) * U64(0xE7037ED1A0B428DB))
_MUL = mix(np.arange(301, 401, dtype=U64) * U64(0x8EBC6AF09C88C6E3)) | U64(1)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the rows, and the row of each word."""
    data = _LOWER[data]
    word = np.zeros(len(data) + 2, np.int8)
    word[1:-1] = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero((word[1:] == 1) & ((word[:-1] == 0) | edge))
    ends = np.flatnonzero((word[:-1] == 1) & ((word[1:] == 0) | edge))
    return ByteHash(data)(starts, ends), np.searchsorted(offsets, starts, "right") - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """For each row the sorted distinct 64-bit hashes of its shingles."""
    words, row = word_hashes(data, offsets)
    n = len(offsets) - 1
    count = np.bincount(row, minlength=n) if len(row) else np.zeros(n, np.int64)
    first = np.cumsum(count) - count
    grams = np.zeros(max(0, len(words) - size + 1), U64)
    for j in range(size):
        grams += words[j:j + len(grams)] * _ODD[j]
    grams = mix(grams)
    out = []
    for a, c in zip(first.tolist(), count.tolist()):
        if c >= size:
            out.append(np.unique(grams[a:a + c - size + 1]))
        elif c:
            out.append(mix((words[a:a + c] * _ODD[size:size + c]).sum(keepdims=True) + U64(c)))
        else:
            out.append(np.zeros(0, U64))
    return out


def text_sets(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sets of the following rows) for pieces of a batch."""
    data, off = string_bytes(batch.column(column))
    for a, b in chunks(off):
        yield a, shingle_sets(data[off[a]:off[b]], off[a:b + 1] - off[a])


def band_hashes(values: np.ndarray, side: int = SIDE, width: int = WIDTH) -> np.ndarray:
    """2 * side band hashes of `width` minhashes each: the two collections."""
    k = 2 * side * width
    least = np.full(k, np.iinfo(np.uint64).max, U64)
    for a in range(0, len(values), 4096):
        part = (values[a:a + 4096, None] ^ _XOR[:k]) * _MUL[:k]
        least = np.minimum(least, part.min(axis=0))
    bands = np.zeros(2 * side, U64)
    for w in range(width):
        bands += least[w::width] * _ODD[20 + w]
    return mix(bands)


def table_keys(bands: np.ndarray, side: int = SIDE) -> np.ndarray:
    """One key for each pair of a hash of the first collection and one of the second."""
    a, b = bands[:, :side, None] * _ODD[30], bands[:, None, side:] * _ODD[31]
    return mix(a + b + np.arange(side * side, dtype=U64).reshape(side, side)).reshape(len(bands), side * side)


def sketches(docs: DataFrame, side: int = SIDE, width: int = WIDTH) -> DataFrame:
    """(doc_id, n, set_id, bands) of every row: the set's size, a digest of the whole
    set (null if empty) and its band hashes."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("set_id", pa.binary()), ("bands", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for a, sets in text_sets(batch, 1):
                yield pa.record_batch([
                    batch.column(0).slice(a, len(sets)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.sha256(s.tobytes()).digest()[:16] if len(s) else None for s in sets], pa.binary()),
                    pa.array([band_hashes(s, side, width).tobytes() if len(s) else None for s in sets], pa.binary())], schema=schema)

    return texts(docs).mapInArrow(task(run), "doc_id long, n long, set_id binary, bands binary")


def _keys(classes: DataFrame, side: int) -> DataFrame:
    """(key, doc): the table keys of every class."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for a in range(0, len(batch), 1000):
                part = batch.slice(a, 1000)
                bands = np.frombuffer(b"".join(x.as_py() for x in part.column(1)), U64).reshape(len(part), 2 * side)
                keys = table_keys(bands, side)
                yield pa.record_batch([pa.array(keys.ravel().view(np.int64)),
                                       pa.array(np.repeat(np.asarray(part.column(0)), side * side))], names=["key", "doc"])

    return classes.select("doc", "bands").mapInArrow(task(run), "key long, doc long")


def connected(sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """For each set the first one that it is connected with by links of that likeness."""
    count = np.array([len(x) for x in sets])
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([0, 0 if both and 100 * both >= percent * (count.sum() - both) else 1])
    values, slot, holders = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), count)
    shared = holders[slot] > 1  # only these matter to an intersection
    row, slot = row[shared], (np.cumsum(holders > 1) - 1)[slot[shared]]
    both = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(slot, kind="stable")
    row, slot = row[order], slot[order]
    edge = np.searchsorted(slot, np.arange(0, (slot[-1] if len(slot) else 0) + 2049, 2048))
    for k, (a, b) in enumerate(zip(edge[:-1], edge[1:])):
        m = np.zeros((len(sets), 2048), np.float32)
        m[row[a:b], slot[a:b] - 2048 * k] = 1
        both += m @ m.T
    linked = (both > 0) & (100 * both >= percent * (count[:, None] + count - both))
    label = np.arange(len(sets))
    while True:
        new = np.where(linked, label, len(sets)).min(axis=1)
        new = np.minimum(label, new)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compared(rows: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Edges (u, v), by label, that connect the documents of each part (lead, i, j) as far as
    links of full sets do; `rows` are (doc, label, lead, i, j)."""
    # sort-merge at every size: the number of rows has no bound that would allow a broadcast
    rows = (rows.hint("merge").join(texts(docs).filter("text is not null and doc_id is not null").withColumnRenamed("doc_id", "doc"), "doc")
            .select("lead", "i", "j", "doc", "label", "text").repartition("lead", "i", "j").sortWithinPartitions("lead", "i", "j", "doc"))

    def edges(held: list[tuple[int, np.ndarray]]) -> list[tuple[int, int]]:
        if len(held) < 2:
            return []
        first = connected([x for _, x in held], percent)
        return [(held[i][0], held[f][0]) for i, f in enumerate(first.tolist()) if f != i]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in it:
            parts = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            labels = batch.column(4).to_pylist()
            found: list[tuple[int, int]] = []
            for a, sets in text_sets(batch, 5):
                for k, s in enumerate(sets, a):
                    if parts[k] != now:
                        found += edges(held)
                        now, held = parts[k], []
                    held.append((labels[k], s))
            yield _edges(found)
        yield _edges(edges(held))

    return rows.mapInArrow(task(run), "u long, v long").filter("u <> v").distinct()


def _slot(n) -> Column:
    return F.pmod(F.xxhash64("doc"), n)


def _of_lead(members: DataFrame, leads: DataFrame, how: str = "inner") -> DataFrame:
    """`members` with the columns of `leads`, one row per lead; a hot lead's members are dealt
    over `SALTS` tasks."""
    salts = F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))
    return (members.withColumn("salt", F.pmod(F.hash("doc"), F.lit(SALTS)).cast("long"))
            .join(leads.withColumn("salt", F.explode(salts)), ["lead", "salt"], how).drop("salt"))


def _several(pairs: DataFrame, part: int) -> DataFrame:
    """(lead, parts): the leads of groups of more than one part."""
    return pairs.groupBy("lead").agg(F.ceil(F.count("*") / part).alias("parts")).filter("parts > 1")


def verified(pairs: DataFrame, docs: DataFrame, percent: int = PERCENT, block: int = PART) -> DataFrame:
    """Edges (u, v) that connect the members of each part of a lead's group with each other and
    with the lead; the members are the documents of its pairs (doc, lead)."""
    parts = _of_lead(pairs, _several(pairs, block), "left").select(
        "doc", F.col("doc").alias("label"), "lead", _slot(F.coalesce("parts", F.lit(1))).alias("i"), F.lit(0).alias("j"))
    leads = parts.select("lead", "i").distinct().select(F.col("lead").alias("doc"), F.col("lead").alias("label"), "lead", "i", F.lit(0).alias("j"))
    return _compared(parts.union(leads), docs, percent)


def left_apart(pairs: DataFrame, found: DataFrame, part: int = PART, block: int = BLOCK) -> DataFrame:
    """(doc, label, lead, i, j): the members of groups of several parts by the pairs of blocks
    in which they are to be compared, given the components (node, component) of the parts;
    label is the component.  Groups that are one component have no rows."""
    members = (_of_lead(pairs, _several(pairs, part)).join(found.withColumnRenamed("node", "doc"), "doc", "left")
               .select("doc", "lead", F.coalesce("component", "doc").alias("label")))
    shares = members.groupBy("lead", "label").agg(F.count("*").alias("n"))
    groups = (shares.groupBy("lead").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("size"), F.count("*").alias("labels")).filter("labels > 1")
              .select("lead", F.col("most.label").alias("largest"), F.ceil((F.col("size") - F.col("most.n")) / block).alias("others"),
                      F.ceil(F.col("most.n") / block).alias("own")))
    others = F.col("label") != F.col("largest")
    at = _of_lead(members, groups).withColumn("at", F.when(others, _slot(F.col("others"))).otherwise(F.col("others") + _slot(F.col("own"))))
    last = F.when(others, F.col("others") + F.col("own")).otherwise(F.col("others")) - 1
    return (at.withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), last)))
            .select("doc", "label", "lead", F.least("at", "to").alias("i"), F.greatest("at", "to").alias("j")))


def linked(pairs: DataFrame, docs: DataFrame, percent: int = PERCENT, part: int = PART, block: int = BLOCK) -> DataFrame:
    """(node, component): the components that the verified links of the leads' groups form, for
    every document with a link."""
    found = cut(components(verified(pairs, docs, percent, part)))
    joined = components(_compared(left_apart(pairs, found, part, block), docs, percent))
    least = joined.select(F.col("node").alias("component"), F.col("component").alias("least"))
    alone = joined.join(found, "node", "left_anti").select("node", "component")  # without a link in their own part
    return found.join(least, "component", "left").select("node", F.coalesce("least", "component").alias("component")).union(alone)


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["u", "v"])


def near_duplicates(docs: DataFrame, percent: int = PERCENT, side: int = SIDE, width: int = WIDTH, part: int = PART, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of `docs`."""
    all_sets = cut(sketches(docs, side, width))
    classes = cut(all_sets.filter("set_id is not null and doc_id is not null").groupBy("set_id").agg(
        F.min("doc_id").alias("doc"), F.first("bands").alias("bands")))
    keys = _keys(classes, side)
    shared = keys.groupBy("key").agg(F.min("doc").alias("lead"), F.max("doc").alias("last")).filter("lead < last").select("key", "lead")
    pairs = cut(keys.join(shared, "key").filter("doc > lead").select("doc", "lead").distinct())
    found = linked(pairs, docs, percent, part, block)
    label = classes.select("set_id", "doc").join(found.withColumnRenamed("node", "doc"), "doc", "left").select(
        "set_id", F.coalesce("component", "doc").alias("component"))
    out = all_sets.select("doc_id", "n", "set_id").join(label, "set_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))
