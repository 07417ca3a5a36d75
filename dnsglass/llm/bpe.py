"""Byte-level BPE encoding and decoding (operator 5).

Two-tier lookup.  A minimal perfect hash over the vocabulary (hash and displace)
resolves a whole pre-token that is itself a token: one probe, then a comparison
of the stored bytes.  A miss is merged with a heap of candidate pairs over a
doubly linked list of its bytes, so a pre-token of n bytes costs O(n log n)
however long it is.  Misses of at most SHORT bytes, as most words are, are merged
many at once: the words with the same number of parts are the rows of a matrix, and
each step joins the lowest, leftmost pair of every row.  About a megabyte of texts is
encoded at a time; each distinct pre-token in it is looked up once.  Resolved
pre-tokens stay in a table of bounded size, those not met for long go first.

Cases: null or empty text -> no ids, digests of the empty string.  Ties in the
heap (equal ranks) merge the leftmost pair first.  Rows are independent, so
repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from .arrow import chunks, string_bytes, task
from .tables import texts

#: Distinct pre-tokens kept before the older half of the resolved ones is dropped.
MEMO_SIZE = 200_000
#: Bytes up to which missed pre-tokens are merged side by side.
SHORT = 48
#: Pre-tokens in one matrix at most.
BLOCK = 20_000
#: Rank of a pair that is no token.
NO_RANK = np.iinfo(np.int32).max


class PerfectHash:
    """Minimal perfect hash by hash and displace over a fixed set of byte strings."""

    def __init__(self, keys: list[bytes]):
        self.n = n = len(keys)
        self.groups = max(1, n // 2)
        hashes = [xxhash.xxh3_128_intdigest(k) for k in keys]
        members: list[list[int]] = [[] for _ in range(self.groups)]
        for i, h in enumerate(hashes):
            members[h % self.groups].append(i)
        self.shift = [0] * self.groups
        self.slot_of = [-1] * n
        free = bytearray(b"\1") * n
        for g in sorted(range(self.groups), key=lambda g: -len(members[g])):
            if not members[g]:
                break
            if len(members[g]) == 1:  # a lone key takes any slot that is left, named directly
                s = free.index(1)
                free[s], self.shift[g], self.slot_of[members[g][0]] = 0, -1 - s, s
                continue
            d = 0
            while True:
                slots = [self._slot(hashes[i], d) for i in members[g]]
                if len(set(slots)) == len(slots) and all(free[s] for s in slots):
                    break
                d += 1
            self.shift[g] = d
            for i, s in zip(members[g], slots):
                free[s] = 0
                self.slot_of[i] = s

    def _slot(self, h: int, d: int) -> int:
        x = ((h >> 64) ^ (d * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
        x = (x * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF
        return (x >> 16) % self.n

    def __call__(self, key: bytes) -> int:
        h = xxhash.xxh3_128_intdigest(key)
        d = self.shift[h % self.groups]
        return self._slot(h, d) if d >= 0 else -1 - d


class ByteBPE:
    """Encoder and decoder for a rank table `{bytes: rank}`."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.token = {r: b for b, r in ranks.items()}
        keys = list(ranks)
        self.hash = PerfectHash(keys)
        self.slots: list[tuple[bytes, int]] = [(b"", -1)] * len(keys)
        for key, s in zip(keys, self.hash.slot_of):
            self.slots[s] = (key, ranks[key])
        #: Ids of resolved pre-tokens as int32 bytes: those met of late, and the half before them.
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        pairs = sorted((ranks[k[:i]] << 32 | ranks[k[i:]], r) for k, r in ranks.items() for i in range(1, len(k)) if k[:i] in ranks and k[i:] in ranks)
        self.pair_keys = np.array([k for k, _ in pairs] + [-1], np.int64)  # the last stands for any key beyond
        self.pair_ranks = np.array([r for _, r in pairs] + [NO_RANK], np.int32)
        #: A byte that is no token could only be merged by its bytes, by the heap.
        self.short = SHORT if all(bytes([i]) in ranks for i in range(256)) else 0
        self.byte_ranks = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int64)

    def whole(self, piece: bytes) -> int:
        """The rank of a piece that is a token, else -1."""
        key, rank = self.slots[self.hash(piece)]
        return rank if key == piece else -1

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Heap of mergeable neighbours over linked bytes, lowest rank first."""
        ranks, n = self.ranks, len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        end = list(range(1, n + 1))  # end[i]: where the part that starts at i ends; 0 once it is merged away
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            j = after[i] if end[i] else n
            if j >= n or end[j] != stop:
                continue  # one of the two has grown or gone since
            end[i], end[j] = stop, 0
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(piece[i:end[k]])) is not None:
                    heappush(heap, (r, i, end[k]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
                heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:end[i]]])
            i = after[i]
        return tuple(out)

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each token a followed by b as one token, else NO_RANK."""
        key = a << 32 | b
        at = np.searchsorted(self.pair_keys[:-1], key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NO_RANK)

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """`merge` of each piece as int32 bytes.  Rows of `ids` are pieces of as many parts
        as the step says, `pair` has the rank of each part joined with the next; a row
        without a pair is done, the others go on with one part less."""
        out = [b""] * len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        row, ids, pair = np.zeros(0, np.int64), np.zeros((0, 0), np.int64), np.zeros((0, 0), np.int32)
        for n in range(int(size.max(initial=0)), 0, -1):
            new = np.flatnonzero(size == n)
            if len(new):
                raw = np.frombuffer(b"".join([pieces[i] for i in new.tolist()]), np.uint8).reshape(len(new), n)
                own = self.byte_ranks[raw]
                ids = np.concatenate([ids.reshape(len(row), n), own])
                pair = np.concatenate([pair.reshape(len(row), n - 1), self.joined(own[:, :-1], own[:, 1:])])
                row = np.r_[row, new]
            if not len(row):
                continue
            low = pair.min(1, initial=NO_RANK)
            done = low == NO_RANK
            ended = ids[done].astype(np.int32).tobytes()
            for i, r in enumerate(row[done].tolist()):
                out[r] = ended[4 * n * i:4 * n * (i + 1)]
            row, ids, pair = row[~done], ids[~done], pair[~done]
            if not len(row):
                continue
            at, k = np.arange(len(row)), pair.argmin(1)
            ids[at, k] = low[~done]
            keep = np.ones(ids.shape, bool)
            keep[at, k + 1] = False
            ids = ids[keep].reshape(len(row), n - 1)
            pair = pair[keep[:, 1:]].reshape(len(row), n - 2)  # without the pair that was joined
            i = np.flatnonzero(k < n - 2)
            pair[i, k[i]] = self.joined(ids[i, k[i]], ids[i, k[i] + 1])
            i = np.flatnonzero(k > 0)
            pair[i, k[i] - 1] = self.joined(ids[i, k[i] - 1], ids[i, k[i]])
        return out

    def resolve(self, pre_tokens: list[str]) -> dict[str, bytes]:
        """The ids of each pre-token as int32 bytes."""
        out: dict[str, bytes] = {}
        missed: dict[str, bytes] = {}
        for p in pre_tokens:
            piece = p.encode()
            if (rank := self.whole(piece)) >= 0:
                out[p] = rank.to_bytes(4, sys.byteorder)
            elif len(piece) <= self.short:
                missed[p] = piece
            else:
                out[p] = np.array(self.merge(piece), np.int32).tobytes()
        names, pieces = list(missed), list(missed.values())
        for a in range(0, len(names), BLOCK):  # one text may have any number of words
            out.update(zip(names[a:a + BLOCK], self.merge_many(pieces[a:a + BLOCK])))
        return out

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, int32."""
        parts = [self.find(t) if t else [] for t in texts]
        if len(self.memo) > MEMO_SIZE // 2:
            self.memo, self.older = {}, self.memo
        new = set().union(*parts).difference(self.memo)
        known = new.intersection(self.older)
        self.memo.update((p, self.older[p]) for p in known)
        self.memo.update(self.resolve(list(new - known)))
        return [np.frombuffer(b"".join(map(self.memo.__getitem__, p)), np.int32) for p in parts]

    def encode_column(self, col: pa.Array) -> Iterator[tuple[str | None, np.ndarray]]:
        """(text, ids) of each row, about a megabyte of texts at a time."""
        for a, b in chunks(string_bytes(col)[1]):
            part = col.slice(a, b - a).to_pylist()
            yield from zip(part, self.encode_many(part))

    def encode(self, text: str | None) -> list[int]:
        return self.encode_many([text])[0].tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Ranks from lines of `base64 rank`."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBPE:
    """The encoder of a rank file that every worker has (an installed package's
    vocabulary); made once for each Python worker."""
    with open(path, "rb") as f:
        return ByteBPE(read_ranks(f.read()), pattern)


def public_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path(name), public_tokenizers.PATTERN


def encode(docs: DataFrame, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, ids array<int>, decoded binary) for every row of `docs`."""
    path, pattern = vocabulary or public_vocabulary()
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in it:
            for a in range(0, len(batch), 200):
                part = batch.slice(a, 200)
                ids = [x for _, x in bpe.encode_column(part.column(1))]
                yield pa.record_batch([part.column(0), pa.array(ids, schema.field(1).type),
                                       pa.array([bpe.decode(x.tolist()) for x in ids], pa.binary())], schema=schema)

    return texts(docs).mapInArrow(task(run), "doc_id long, ids array<int>, decoded binary")


def encode_digests(docs: DataFrame, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and exact: whether the decoded
    bytes are the text's) for every row; ids and bytes do not leave the task."""
    path, pattern = vocabulary or public_vocabulary()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        names = {r: str(r) for r in bpe.token}.__getitem__
        for batch in it:
            out: list[tuple[int, str, str, bool]] = []
            for t, x in bpe.encode_column(batch.column(1)):
                text, ids = t or "", x.tolist()
                back = bpe.decode(ids)
                out.append((len(ids), hashlib.sha256(" ".join(map(names, ids)).encode()).hexdigest(),
                            hashlib.sha256(back).hexdigest(), back == text.encode()))
            cols = list(zip(*out)) or [(), (), (), ()]
            yield pa.record_batch([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()),
                                   pa.array(cols[2], pa.string()), pa.array(cols[3], pa.bool_())],
                                  names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "exact"])

    return texts(docs).mapInArrow(task(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean")
