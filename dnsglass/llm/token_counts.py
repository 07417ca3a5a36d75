"""Token counts of sections (operator 10).

A document is encoded once, as a whole, with the byte-level BPE of `bpe`.  Each token
has the span of characters from the one that holds its first byte to the one that holds
its last.  The spans are joined to the document's sections, any list of half-open
character intervals (they may nest, overlap or leave gaps): both ends of the tokens are
sorted, so an interval's tokens are found by two binary searches.

Rule: a token counts for the sections that hold its first character.  So the counts of
sections that tile a text add up to the text's tokens.  A token that starts in a
section and ends beyond it is also reported as crossing.

Cases: null or empty text -> no tokens; by lines it has one empty section.  An empty
interval holds no token.  Intervals are clipped to the text.  Null sections -> no rows
for them, but the row of the whole (section -1) is always there.  Rows are independent
of each other; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import task
from .bpe import load, public_vocabulary

OUT = pa.schema([("doc_id", pa.int64()), ("section", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("n_tokens", pa.int64()), ("n_crossing", pa.int64())])


def spans(text: str, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and end of each token, from the tokens' lengths in bytes."""
    raw = np.frombuffer(text.encode(), np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1  # the character that a byte belongs to
    stop = np.cumsum(lengths)
    return char[stop - lengths], char[stop - 1] + 1


def attribute(first: np.ndarray, end: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens that start in [lo, hi), those of them that end beyond hi) of each interval."""
    hi = np.maximum(lo, hi)
    a, b = np.searchsorted(first, lo), np.searchsorted(first, hi)
    within = np.searchsorted(end, hi, "right")  # tokens that end by hi; both ends only grow
    return b - a, np.where(b > a, b - np.clip(within, a, b), 0)


def token_counts(docs: DataFrame, sections: Column | None = None, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, section, start, end, n_tokens, n_crossing: one row for each section of each
    document, numbered from 0, and one for the whole document (section -1).  `sections`
    is an array<struct<start, end>> column of docs; without it a section is a line."""
    path, pattern = vocabulary or public_vocabulary()
    by_line = sections is None
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    rows = docs.select(*columns) if by_line else docs.select(*columns, sections.cast("array<struct<start:long,end:long>>").alias("sections"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        size = np.zeros(max(bpe.token) + 1, np.int64)
        for rank, token in bpe.token.items():
            size[rank] = len(token)
        for batch in it:
            ids = batch.column(0).to_pylist()
            out: list[tuple[np.ndarray, ...]] = []
            held = 0
            for i, (t, own_ids) in enumerate(bpe.encode_column(batch.column(1))):
                text = t or ""
                lengths = size[own_ids]
                first, end = spans(text, lengths) if text else (np.zeros(0, np.int64),) * 2
                if by_line:
                    hi = np.cumsum([len(x) + 1 for x in text.split("\n")])
                    hi[-1] -= 1
                    lo = np.r_[0, hi[:-1]]
                else:
                    own = [s for s in batch.column(2)[i].as_py() or [] if s and s["start"] is not None and s["end"] is not None]
                    lo, hi = (np.clip(np.array([s[k] for s in own], np.int64), 0, len(text)) for k in ("start", "end"))
                n, crossing = attribute(first, end, lo, hi)
                out.append((np.full(len(lo) + 1, i), np.arange(-1, len(lo)), np.r_[0, lo], np.r_[len(text), hi], np.r_[len(first), n], np.r_[0, crossing]))
                held += len(lo) + 1
                if held > 50_000:
                    yield _rows(out, ids)
                    out, held = [], 0
            if out:
                yield _rows(out, ids)

    return rows.mapInArrow(task(run), "doc_id long, section int, start long, end long, n_tokens long, n_crossing long")


def _rows(out: list[tuple[np.ndarray, ...]], ids: list[int | None]) -> pa.RecordBatch:
    row, section, lo, hi, n, crossing = (np.concatenate(x) for x in zip(*out))
    return pa.record_batch([pa.array([ids[i] for i in row.tolist()], pa.int64()), pa.array(section.astype(np.int32)), pa.array(lo), pa.array(hi), pa.array(n), pa.array(crossing)], schema=OUT)
