"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a whole pre-token that
is a token already costs one probe and one comparison of bytes. Tier two, for
the rest, merges a doubly linked list of byte nodes, with a heap that yields
the lowest rank first. Each slice of texts is cut into pre-tokens as arrays,
only its distinct pre-tokens are resolved, and a bounded memo keeps resolved
ones between slices.

The ranks come from a file given as a parameter; they are broadcast, and their
size is bounded by the vocabulary.

Defined cases: a null or empty text has no ids; its digests are those of no
bytes. Repeated rows and null ids each give a row of their own. Other columns
of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quire.llm import byteops as B
from quire.llm.columns import map_arrow
from quire.llm.pretokens import pretokens, ragged

#: Pre-tokens that a worker remembers.
MEMO = 600_000


def load_ranks(path: str) -> list[bytes]:
    """Token bytes by rank from a file with lines of base64 and rank."""
    pairs = [line.split() for line in Path(path).read_bytes().splitlines() if line.strip()]
    tokens = [b""] * (1 + max(int(rank) for _, rank in pairs))
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def pack(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    off = np.concatenate(([0], np.cumsum([len(t) for t in tokens])))
    return np.frombuffer(b"".join(tokens), np.uint8), off


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys by hash and displace.

    Keys are grouped into buckets; large buckets first, a seed is sought that
    sends a bucket's keys to free slots; buckets of one key store their slot.
    """

    def __init__(self, keys: np.ndarray, per_bucket: int = 4):
        n = len(keys)
        if len(np.unique(keys)) != n:
            raise ValueError("keys must be distinct")
        self.n, self.r = n, max(1, n // per_bucket)
        self.seed = np.zeros(self.r, np.int64)  # >= 0: a seed, < 0: -1 - slot
        bucket = (keys % np.uint64(self.r)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(self.r + 1))
        size = np.diff(bounds)
        taken = np.zeros(n, dtype=bool)
        tries = np.arange(64)
        for b in np.argsort(-size, kind="stable"):
            if size[b] < 2:
                break
            own, base = keys[order[bounds[b] : bounds[b + 1]]], 0
            while True:
                slots = self._slot(own[None, :], (tries + base)[:, None])
                flat = np.sort(slots, axis=1)
                good = ~taken[slots].any(axis=1) & (flat[:, 1:] != flat[:, :-1]).all(axis=1)
                if good.any():
                    k = int(np.argmax(good))
                    self.seed[b] = base + k
                    taken[slots[k]] = True
                    break
                base += len(tries)
        free = np.flatnonzero(~taken)
        single = np.flatnonzero(size == 1)
        self.seed[single] = -1 - free[: len(single)]

    def _slot(self, keys: np.ndarray, seeds: np.ndarray) -> np.ndarray:
        return (B.mix(keys ^ (seeds.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) % np.uint64(self.n)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        seed = self.seed[(keys % np.uint64(self.r)).astype(np.int64)]
        return np.where(seed < 0, -1 - seed, self._slot(keys, np.maximum(seed, 0)))


class Vocabulary:
    """Token bytes, the perfect hash over them, and the ranks for merging."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.buf, self.off = pack(tokens)
        ids = np.flatnonzero(np.diff(self.off) > 0)
        keys = B.word_hashes(self.buf, self.off[ids], self.off[ids + 1])
        self.hash = PerfectHash(keys)
        self.slot_id = np.zeros(len(ids), np.int64)
        self.slot_id[self.hash(keys)] = ids
        self._ranks: dict[bytes, int] | None = None

    def __getstate__(self):
        return {**self.__dict__, "_ranks": None}

    @property
    def ranks(self) -> dict[bytes, int]:
        if self._ranks is None:
            self._ranks = {t: i for i, t in enumerate(self.tokens) if t}
        return self._ranks

    def whole(self, keys: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Ids of the spans that are tokens as they are, else -1. Bytes decide."""
        ids = self.slot_id[self.hash(keys)]
        size = ends - starts
        same = (self.off[ids + 1] - self.off[ids]) == size
        rows = np.flatnonzero(same)
        if len(rows):
            n = size[rows]
            equal = buf[ragged(starts[rows], n)] == self.buf[ragged(self.off[ids[rows]], n)]
            same[rows] = np.logical_and.reduceat(equal, np.concatenate(([0], np.cumsum(n)[:-1])))
        return np.where(same, ids, -1)

    def merge(self, piece: bytes) -> list[int]:
        """Merge a pre-token's bytes, lowest rank first and leftmost on ties."""
        ranks, n = self.ranks, len(piece)
        node = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get = ranks.get
        heap = [(r, i, 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            _, i, size = pop(heap)
            left = node[i]
            if left is None or (j := after[i]) >= n:
                continue
            both = left + node[j]
            if len(both) != size:  # one side has changed since
                continue
            node[i], node[j] = both, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                pair = both + node[k]
                if (r := get(pair)) is not None:
                    push(heap, (r, i, len(pair)))
            h = before[i]
            if h >= 0:
                pair = node[h] + both
                if (r := get(pair)) is not None:
                    push(heap, (r, h, len(pair)))
        return [ranks[x] for x in node if x is not None]


class Memo:
    """Ids of distinct pre-tokens by hash: a table of slots over one id array."""

    def __init__(self, resolve, limit: int = MEMO):
        self.resolve, self.limit = resolve, limit
        self.clear()

    def clear(self) -> None:
        self.slot: dict[int, int] = {}
        self.start, self.size = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.ids, self.used = np.zeros(4096, np.int32), 0

    def _grow(self, rows: int, ids: int) -> None:
        while rows > len(self.start):
            self.start, self.size = (np.concatenate((a, np.zeros_like(a))) for a in (self.start, self.size))
        while ids > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in the slice, and where each text's ids begin."""
        begins, bounds = pretokens(buf, off)
        if len(begins) == 1:
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        keys, first, where = np.unique(B.word_hashes(buf, begins[:-1], begins[1:]), return_index=True, return_inverse=True)
        if len(self.slot) + len(keys) > self.limit and self.slot:
            self.clear()
        get, listed = self.slot.get, keys.tolist()
        slots = np.array([get(k, -1) for k in listed], np.int64)
        new = np.flatnonzero(slots < 0)
        if len(new):
            sizes, ids = self.resolve(keys[new], buf, begins[first[new]], begins[first[new] + 1])
            base = len(self.slot)
            self._grow(base + len(new), self.used + len(ids))
            own = np.arange(base, base + len(new))
            slots[new] = own
            self.size[own] = sizes
            self.start[own] = self.used + np.cumsum(sizes) - sizes
            self.ids[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
            self.slot.update(zip((listed[i] for i in new.tolist()), own.tolist(), strict=True))
        slot = slots[where]
        sizes = self.size[slot]
        ids = self.ids[ragged(self.start[slot], sizes)]
        return ids, np.concatenate(([0], np.cumsum(sizes)))[bounds]


def two_tier(vocabulary: Vocabulary):
    """Resolves distinct pre-tokens: the perfect hash, then the heap."""

    def resolve(keys, buf, starts, ends):
        ids = vocabulary.whole(keys, buf, starts, ends)
        sizes = np.ones(len(ids), np.int64)
        misses = np.flatnonzero(ids < 0)
        if not len(misses):
            return sizes, ids
        raw, merge = buf.tobytes(), vocabulary.merge
        merged = [merge(raw[a:b]) for a, b in zip(starts[misses].tolist(), ends[misses].tolist(), strict=True)]
        sizes[misses] = [len(x) for x in merged]
        out = np.zeros(int(sizes.sum()), np.int64)
        at = np.cumsum(sizes) - sizes
        hit = np.flatnonzero(ids >= 0)
        out[at[hit]] = ids[hit]
        out[ragged(at[misses], sizes[misses])] = [i for x in merged for i in x]
        return sizes, out

    return resolve


def encode(df: DataFrame, ranks_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with an array of token ids beside its columns."""
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary(load_ranks(ranks_path)))
    schema = T.StructType([*df.drop(ids).schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(two_tier(shared.value))
        for batch in batches:
            kept = batch.select([c for c in batch.schema.names if c != ids])
            for lo, hi, buf, off in B.slices(B.column(batch, text)):
                values, bounds = memo.encode(buf, off)
                arrays = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.astype(np.int32)))
                part = kept.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, arrays], names=[*part.schema.names, ids])

    return map_arrow(df, run, schema)


def decode_bytes(vocabulary: Vocabulary, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all ids, and where each text's bytes begin."""
    size = vocabulary.off[ids + 1] - vocabulary.off[ids]
    return vocabulary.buf[ragged(vocabulary.off[ids], size)], np.concatenate(([0], np.cumsum(size)))[bounds]


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``df`` with the text of its token ids (invalid UTF-8 is replaced); null ids give null."""
    shared = df.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    schema = T.StructType([*df.drop(text).schema.fields, T.StructField(text, T.StringType())])

    def run(batches):
        tokens = shared.value
        for batch in batches:
            kept = batch.select([c for c in batch.schema.names if c != text])
            out = [None if x is None else b"".join([tokens[i] for i in x]).decode("utf-8", "replace") for x in B.column(batch, ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(out, pa.string())], names=[*kept.schema.names, text])

    return map_arrow(df, run, schema)


def round_trip(docs: DataFrame, ranks_path: str) -> DataFrame:
    """Encode every text, decode the ids again, and digest both.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256, one row per row of
    ``docs``. One pass over the scan, no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(load_ranks(ranks_path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        memo, digest = Memo(two_tier(vocabulary)), hashlib.sha256
        for batch in batches:
            ids = B.column(batch, "doc_id")
            for lo, hi, buf, off in B.slices(B.column(batch, "text")):
                values, bounds = memo.encode(buf, off)
                decoded, ends = decode_bytes(vocabulary, values.astype(np.int64), bounds)
                raw, text = memoryview(values.astype("<u4").tobytes()), memoryview(decoded.tobytes())
                b, e = (bounds * 4).tolist(), ends.tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, hi - lo),
                        pa.array(np.diff(bounds)),
                        pa.array([digest(raw[x:y]).hexdigest() for x, y in zip(b, b[1:], strict=False)], pa.string()),
                        pa.array([digest(text[x:y]).hexdigest() for x, y in zip(e, e[1:], strict=False)], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
