"""Phrase collocations by set-oriented relational mining (SETM, operator 13).

Occurrence relations.  R_1 holds the words of every piece, in order of piece and
position; R_k holds the frequent phrases of k words that start at a position.  A
relation is persisted as a table of blocks, one language each: a block is about `BLOCK`
words of whole pieces, its positions run on with a gap between pieces, and it holds one
number a position, which names one of the block's own phrases, or -1.

A level.  The extension merges R_k with itself at the adjacent position: where frequent
phrases of k words start at a position and at the next one, a phrase of k + 1 words
starts, named by the pair.  A block counts its pairs (the pre-aggregation); one shuffle
of (pair, count, block) by pair adds up the blocks, a window total, and pairs of at
least `least` occurrences get an id.  The frequent ones go back to the blocks that
hold them (the semi-join), which merge again and drop all other occurrences before the
next extension.  A phrase in every document is one row of a block, and no group is held
in memory.

Ids are exact: a word by its spelling and language, a phrase by the ids of its first
and last k words; nothing is decided by hashes.

Scores.  A frequent phrase carries the frequencies of its prefixes and suffixes, joined
from the level before, so all cuts are at hand.  Arithmetic is in decimals.

Cases: null or empty text has no words; null lang is `und`; texts, pieces and rows that
repeat count each time; an empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import ByteHash, batches, chunks, string_bytes, table_of, task
from .tables import cut
from .words import word_bounds

LEAST = 30
LONGEST = 4
TOP = 2_000
SCALE = 2_000_000
#: Hundredths of a phrase's occurrences that lie in a longer one from which on it is dropped.
PART = 80
#: Words of a block, give or take one text.
BLOCK = 1 << 22

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
_BLANK = _BREAK.copy()
_BLANK[[32, 9]] = True
_SECOND = table_of(61)
#: A block's number is the task's, then its place in the task.
_PLACES = 1 << 20


def _packed(items: np.ndarray) -> bytes:
    """int32 numbers, -1 and up, compressed by planes of their bytes."""
    planes = np.ascontiguousarray((items + np.int32(1)).astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return len(items).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int32) - np.int32(1)


class _Block:
    """Words of one language, gathered for a block."""

    def __init__(self):
        self.names: dict[bytes, int] = {}
        self.items: list[np.ndarray] = []
        self.size = 0

    def add(self, names: list[bytes], which: np.ndarray, breaks: np.ndarray) -> None:
        """Words given as indices into `names`; `breaks` marks the first words of pieces."""
        of = np.array([self.names.setdefault(w, len(self.names)) for w in names], np.int32)
        self.items.append(np.insert(of[which], np.flatnonzero(breaks), -1))
        self.size += len(which)

    def row(self) -> tuple[bytes, list[str], list[int]]:
        items = np.concatenate(self.items)
        count = np.bincount(items[items >= 0], minlength=len(self.names))
        by = np.argsort(-count, kind="stable")  # frequent words get small numbers
        rank = np.empty(len(by) + 1, np.int32)
        rank[by], rank[-1] = np.arange(len(by)), -1
        names = list(self.names)
        return _packed(rank[items]), [names[i].decode() for i in by.tolist()], count[by].tolist()


def _distinct_words(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct words of a text, and which one each word is."""
    text = raw.tobytes()
    one = ByteHash(raw)(start, end)
    _, first, which = np.unique(one, return_index=True, return_inverse=True)
    two = ByteHash(raw, _SECOND)(start, end)
    if (two != two[first][which]).any():  # two words of one hash
        names: dict[bytes, int] = {}
        which = np.array([names.setdefault(text[a:b], len(names)) for a, b in zip(start.tolist(), end.tolist())])
        return list(names), which
    return [text[a:b] for a, b in zip(start[first].tolist(), end[first].tolist())], which


def word_relation(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """R_1 with all words: (block, lang, items, words, counts), items being the packed
    numbers of the words in order, -1 between pieces."""
    schema = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("items", pa.binary()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, made = TaskContext.get().partitionId(), 0
        at_hand: dict[str, _Block] = {}

        def closed(lang: str) -> pa.RecordBatch:
            nonlocal made
            if made == _PLACES:
                raise ValueError(f"more than {_PLACES} blocks in a task; use smaller partitions")
            items, words, counts = at_hand.pop(lang).row()
            made += 1
            return pa.record_batch([pa.array([number * _PLACES + made - 1], pa.int64()), pa.array([lang]), pa.array([items], pa.binary()),
                                    pa.array([words], schema.field(3).type), pa.array([counts], schema.field(4).type)], schema=schema)

        for batch in it:
            langs = batch.column(0).to_pylist()
            data, off = string_bytes(batch.column(1))
            for a, b in chunks(off):
                raw, o = _LOWER[data[off[a]:off[b]]], off[a:b + 1] - off[a]
                start, end, row = word_bounds(raw, o, _BLANK)
                if not len(start):
                    continue
                names, which = _distinct_words(raw, start, end)
                ends_before = np.cumsum(_BREAK[raw])[start]
                new = np.ones(len(start), bool)
                new[1:] = (row[1:] != row[:-1]) | (ends_before[1:] != ends_before[:-1])
                of = np.array(langs[a:b], object)[row]
                for lang in sorted(set(langs[a:b])):
                    take = np.flatnonzero(of == lang)
                    if not len(take):
                        continue
                    here, local = np.unique(which[take], return_inverse=True)
                    part = at_hand.setdefault(lang, _Block())
                    part.add([names[i] for i in here.tolist()], local, new[take])
                    if part.size >= block:
                        yield closed(lang)
        for lang in sorted(at_hand):
            yield closed(lang)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(task(run), "block long, lang string, items binary, words array<string>, counts array<long>")


def frequent(asked: DataFrame, by: list[str], least: int) -> DataFrame:
    """The rows of the groups with at least `least` occurrences (the sum of n), with the
    group's total f and an id that no other group has; `leads` is true in one row of each."""
    rows = asked.repartition(*by).withColumn("row", F.monotonically_increasing_id())
    group = Window.partitionBy(*by)
    return (rows.withColumn("f", F.sum("n").over(group)).withColumn("id", F.min("row").over(group))
            .filter(F.col("f") >= least).withColumn("leads", F.col("id") == F.col("row")).drop("row", "n"))


def _pairs(items: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The merge of a block with itself at the adjacent position: (positions, which pair each
    is, the pairs as head * len(ids) + tail, their counts)."""
    at = np.flatnonzero((items[:-1] >= 0) & (items[1:] >= 0))
    pair, which, count = np.unique(items[at] * np.int64(len(ids)) + items[at + 1], return_inverse=True, return_counts=True)
    return at, which, pair, count


def frequent_words(relation: DataFrame, kept: DataFrame) -> DataFrame:
    """R_1 (block, lang, items, ids) of the frequent words: ids holds the int64 ids that the
    items name."""
    listed = kept.groupBy("block").agg(F.collect_list(F.struct("place", "id")).alias("known"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in range(len(batch)):
                items = _unpacked(batch.column(2)[i].as_py())
                place, ids = (np.asarray(x) for x in batch.column(3)[i].values.flatten())
                by = np.argsort(place)
                rank = np.full(max(int(items.max(initial=-1)), int(place.max())) + 2, -1, np.int32)  # the last one is for -1
                rank[place[by]] = np.arange(len(by))
                yield _row(batch, i, rank[items], ids[by])

    rows = relation.select("block", "lang", "items").join(listed, "block").select("block", "lang", "items", "known")
    return rows.mapInArrow(task(run), RELATION)


RELATION = "block long, lang string, items binary, ids binary"


def _row(batch: pa.RecordBatch, i: int, items: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([_packed(items)], pa.binary()), pa.array([ids.tobytes()], pa.binary())],
                           names=["block", "lang", "items", "ids"])


def phrase_counts(relation: DataFrame) -> DataFrame:
    """(head, tail, n, block): the phrases of k + 1 words in each block of R_k, as pairs of
    ids, with their counts."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in range(len(batch)):
                ids = np.frombuffer(batch.column(2)[i].as_py(), np.int64)
                _, _, pair, count = _pairs(_unpacked(batch.column(1)[i].as_py()), ids)
                head, tail = ids[pair // len(ids)], ids[pair % len(ids)]
                by = np.lexsort((tail, head))
                yield from batches(pa.table([pa.array(head[by]), pa.array(tail[by]), pa.array(count[by].astype(np.int64)), pa.array(np.full(len(by), batch.column(0)[i].as_py()))], schema=COUNTS), COUNTS)

    return relation.select("block", "items", "ids").mapInArrow(task(run), "head long, tail long, n long, block long")


COUNTS = pa.schema([(c, pa.int64()) for c in ("head", "tail", "n", "block")])


def extended(relation: DataFrame, kept: DataFrame) -> DataFrame:
    """R_(k+1) from R_k and the frequent phrases (block, head, tail, id) of its blocks."""
    listed = kept.groupBy("block").agg(F.collect_list(F.struct("head", "tail", "id")).alias("known"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in range(len(batch)):
                items, own = _unpacked(batch.column(2)[i].as_py()), np.frombuffer(batch.column(3)[i].as_py(), np.int64)
                head, tail, ids = (np.asarray(x) for x in batch.column(4)[i].values.flatten())
                place = np.argsort(own)  # own[place] ascends
                known = place[np.searchsorted(own, head, sorter=place)] * np.int64(len(own)) + place[np.searchsorted(own, tail, sorter=place)]
                at, which, pair, _ = _pairs(items, own)
                rank = np.full(len(pair), -1, np.int32)
                rank[np.searchsorted(pair, known)] = np.arange(len(known))
                out = np.full(len(items), -1, np.int32)
                out[at] = rank[which]
                yield _row(batch, i, out, ids)

    rows = relation.join(listed, "block").select("block", "lang", "items", "ids", "known")
    return rows.mapInArrow(task(run), RELATION)


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, block: int = BLOCK) -> tuple[list[DataFrame], DataFrame]:
    """For k = 1 .. longest the phrases of k words with at least `least` occurrences (id,
    lang, phrase, f, heads and tails: the frequencies of its first and last 1 .. k words,
    inner: ids of its phrases of 2 .. k - 1 words as struct<k, id>), and (lang, n), the
    number of all words."""
    relation = cut(word_relation(docs, block))
    zipped = F.arrays_zip(F.col("words").alias("word"), F.col("counts").alias("n"))
    words = relation.select("block", "lang", F.posexplode(zipped).alias("place", "e")).select("lang", "e.word", "e.n", "block", "place")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    kept = cut(frequent(words, ["lang", "word"], least))
    inner = "array<struct<k: int, id: bigint>>"
    level = kept.filter("leads").select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("final"), "f",
                                        F.array("f").alias("heads"), F.array("f").alias("tails"), F.expr(f"cast(array() as {inner})").alias("inner"))
    levels = [level]
    for k in range(2, longest + 1):
        relation = cut(frequent_words(relation, kept) if k == 2 else extended(relation, kept))
        kept = cut(frequent(phrase_counts(relation), ["head", "tail"], least))
        own = F.array(*(F.struct(F.lit(k - 1).alias("k"), F.col(c).alias("id")) for c in ("head", "tail"))) if k > 2 else F.expr(f"cast(array() as {inner})")
        a, b = (level.select(F.col("id").alias(n), *(F.col(c).alias(f"{n}_{c}") for c in ("lang", "phrase", "final", "heads", "tails", "inner"))) for n in ("head", "tail"))
        level = cut(kept.filter("leads").join(a, "head").join(b, "tail").select(
            "id", F.col("head_lang").alias("lang"), F.concat_ws(" ", "head_phrase", "tail_final").alias("phrase"), F.col("tail_final").alias("final"), "f",
            F.concat("head_heads", F.array("f")).alias("heads"), F.concat("tail_tails", F.array("f")).alias("tails"),
            F.array_distinct(F.concat(own, "head_inner", "tail_inner")).alias("inner")))
        levels.append(level)
    return levels, totals


def cut_scores(length: int, scale: int = SCALE) -> F.Column:
    """struct<score, k, l, r> of a phrase's lowest-scoring cut, the smallest k of equal ones."""
    def exact(c: F.Column) -> F.Column:
        return c.cast("decimal(19,0)")

    cuts = []
    for k in range(1, length):
        left, right = F.col("heads")[k - 1], F.col("tails")[length - k - 1]
        score = F.call_function("div", exact(F.col("f")) * F.lit(scale).cast("decimal(19,0)"), exact(left) + exact(right))
        cuts.append(F.struct(score.cast("long").alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))
    return F.least(*cuts) if len(cuts) > 1 else cuts[0]


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, part: int = PART, block: int = BLOCK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases of 2 ..
    `longest` words, without those that mostly lie in a longer one."""
    levels, totals = frequent_phrases(docs, least, longest, block)
    scored = [level.select(F.lit(k).alias("k"), "id", "lang", "phrase", F.col("f").alias("a"), cut_scores(k).alias("s"))
              for k, level in enumerate(levels[1:], 2)]
    holders = [level.select("f", F.explode("inner").alias("i")).groupBy(F.col("i.k").alias("k"), F.col("i.id").alias("id")).agg(F.max("f").alias("longer"))
               for level in levels[2:]]
    found = reduce(DataFrame.union, scored)
    if holders:
        most = reduce(DataFrame.union, holders).groupBy("k", "id").agg(F.max("longer").alias("longer"))
        held = F.col("longer").cast("decimal(19,0)") * 100 >= F.col("a").cast("decimal(19,0)") * part
        found = found.join(most, ["k", "id"], "left").filter(F.coalesce(~held, F.lit(True)))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.select("lang", "phrase", "a", F.col("s.l").alias("l"), F.col("s.r").alias("r"), F.col("s.score").alias("score")).withColumn(
        "rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
