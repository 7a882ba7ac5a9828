"""Hierarchical multi-length packing of token streams into context windows.

Each document's stream is its text's ids, then the end id 1.

1. Route. A document goes whole to the shortest tier (256, 512, 1024 or 2048
   tokens) that holds it. One longer than the longest tier gives whole windows
   of it first; its rest is routed like a document.
2. Pack each tier, longest first. Its longest document opens a sequence of the
   tier's size. The gap is filled with whole documents, in long windows from
   the shorter tiers: one that fits exactly, else two or three that do together, else the
   longest that fits. Only when none fits is a piece cut off to close the gap: from a
   document beyond the longest tier if there is one (it has to be cut anyway),
   else from the shortest document there is.
3. Balance. A step group holds sequences of one tier and ``STEP_TOKENS`` tokens.
   Sequences of a tier are numbered over all tasks, so every group of a tier
   but its last is full.

A task tokenizes and packs the documents of its own input partition in one
pass without a shuffle. It keeps a pool of at most about ``POOL`` tokens, so
that fillers of many lengths are at hand; what is left at the end is packed
too, and only the last sequence of a task can be short of its tier's size.
The pieces, numbers only, are written to shared storage before groups are
numbered, so that both see the same sequences whichever executors are lost.

Defined cases: a null or empty text is the end id alone. Repeated rows are
packed as often as they occur; null ids stay null. Other columns are ignored,
whatever their names. No rows give no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import byteops as B
from quire.llm.bpe import Memo
from quire.llm.memory import returning
from quire.session import materialize

WINDOW = 2048
#: Sizes of sequences, longest first.
TIERS = (WINDOW, 1024, 512, 256)
END_ID = 1
#: Tokens that wait in a task's pool: above it sequences are closed until half are left.
POOL = 1 << 20
#: Lengths, from the longest, that are tried as one of three that fill a gap.
TRIES = 64
#: Tokens of a step group.
STEP_TOKENS = 16 * WINDOW

_NUMBERS = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "task", "place"]
_PIECES = "doc_id long, " + ", ".join(f"{c} long" for c in _NUMBERS)


class Packer:
    """A task's pool of documents and its sequences.

    A document or what is left of one is (doc_id, id bytes, first id, tokens left). ``rows`` gets a row a
    piece: doc_id, then start, length, crc32, tokens, sequence, offset, tier, task, the sequence's place in its tier.
    """

    def __init__(self, task: int):
        self.task, self.rows = task, []
        self.sequences, self.places = 0, dict.fromkeys(TIERS, 0)
        self.long: list[list] = []  # longer than the window
        self.by_length: dict[int, list] = {}
        # Lengths in the pool as bits, and the same from the other end, to find pairs of a given sum.
        self.lengths = self.mirrored = 0
        self.tokens = 0

    def add(self, doc, data: bytes) -> None:
        self.tokens += len(data) // 4
        self._put([doc, data, 0, len(data) // 4])
        if self.tokens > POOL:
            self.close(POOL // 2)

    def _put(self, rest: list) -> None:
        n = rest[3]
        if n > WINDOW:
            self.long.append(rest)
        elif n:
            self.by_length.setdefault(n, []).append(rest)
            self.lengths |= 1 << n
            self.mirrored |= 1 << (WINDOW - n)

    def _take(self, n: int) -> list:
        own = self.by_length[n]
        rest = own.pop()
        if not own:
            self.lengths &= ~(1 << n)
            self.mirrored &= ~(1 << (WINDOW - n))
        return rest

    def _exact(self, gap: int) -> list[int]:
        """Lengths of one or two whole documents that fill the gap."""
        if self.lengths >> gap & 1:
            return [gap]
        pair = self.lengths & (self.mirrored >> (WINDOW - gap)) & ((1 << gap) - 1)
        a = pair.bit_length() - 1
        if pair and (2 * a != gap or len(self.by_length[a]) > 1):
            return [a, gap - a]
        return []

    def _fitting(self, gap: int) -> list[int]:
        """Lengths of whole documents to put into a gap next; none if none fits."""
        found = self._exact(gap)
        if found:
            return found
        below = self.lengths & ((1 << gap) - 1)
        longest, rest = below.bit_length() - 1, below
        for _ in range(TRIES):
            a = rest.bit_length() - 1
            if a < gap // 3:
                break
            others = self._exact(gap - a)
            # A length may be wanted more often than there are documents of it.
            if others and len(self.by_length[a]) >= 1 + others.count(a):
                return [a, *others]
            rest &= ~(1 << a)
        return [longest] if below else []

    def _place(self, rest: list, size: int, offset: int, tier: int) -> int:
        """Put the next ``size`` ids of ``rest`` at ``offset`` of the open sequence."""
        doc, data, start, left = rest
        own = data if size * 4 == len(data) else data[4 * start : 4 * (start + size)]
        self.rows.append((doc, start, size, crc32(own), len(data) // 4, (self.task << 36) + self.sequences, offset, tier, self.task, self.places[tier]))
        rest[2], rest[3] = start + size, left - size
        self.tokens -= size
        return offset + size

    def close(self, keep: int) -> None:
        """Pack sequences until ``keep`` tokens are left in the pool."""
        while self.tokens > keep:
            if self.long:
                rest, tier = self.long.pop(), WINDOW
                filled = self._place(rest, WINDOW, 0, WINDOW)
                self._put(rest)
            else:
                longest = self.lengths.bit_length() - 1
                tier = min(t for t in TIERS if t >= longest)
                filled = self._place(self._take(longest), longest, 0, tier)
            while filled < tier:
                fitting = self._fitting(tier - filled)
                for n in fitting:
                    filled = self._place(self._take(n), n, filled, tier)
                if fitting:
                    continue
                if self.long:
                    rest = self.long.pop()
                elif self.lengths:
                    rest = self._take((self.lengths & -self.lengths).bit_length() - 1)
                else:
                    break  # the task's last sequence
                filled = self._place(rest, tier - filled, filled, tier)
                self._put(rest)
            self.places[tier] += 1
            self.sequences += 1

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = np.array([r[1:] for r in rows], np.int64).reshape(-1, len(_NUMBERS)).T
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array(c) for c in columns)], names=["doc_id", *_NUMBERS])


def library_ids(definition: bytes, special: str = "<|endoftext|>"):
    """Encoders over a tokenizer's definition: whole texts, and distinct pre-tokens."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_buffer(definition)

    def whole(text: str) -> list[int]:
        return tokenizer.encode(text, add_special_tokens=False).ids

    def resolve(keys, buf, starts, ends):
        raw = buf.tobytes()
        pieces = [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        got = [e.ids for e in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        return np.array([len(x) for x in got], np.int64), np.array([i for x in got for i in x], np.int64)

    return whole, resolve, special.encode()


def pieces(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Pieces of all documents' ids, with the sequence's tier, its task and its place among the task's of the tier."""
    shared = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_bytes())  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        whole, resolve, special = library_ids(shared.value)
        memo = Memo(resolve)
        packer = Packer(TaskContext.get().partitionId())
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            ids = B.column(batch, "doc_id")
            for lo, hi, buf, off in B.slices(B.column(batch, "text")):
                values, bounds = memo.encode(buf, off)
                raw = values.astype("<u4").tobytes()
                text = buf.tobytes()
                marked = special in text
                b, o = (4 * bounds).tolist(), off.tolist()
                for i, doc in enumerate(ids.slice(lo, hi - lo).to_pylist()):
                    data = raw[b[i] : b[i + 1]]
                    if marked and special in text[o[i] : o[i + 1]]:
                        data = np.array(whole(text[o[i] : o[i + 1]].decode()), "<u4").tobytes()
                    packer.add(doc, data + end)
                if packer.rows:
                    yield packer.batch()
        packer.close(0)
        if packer.rows:
            yield packer.batch()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(returning(run), _PIECES)


def pack(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Pieces of all documents' ids in sequences of at most ``WINDOW`` tokens.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    tier (the sequence's size), step_group.
    """
    packed = materialize(pieces(docs, tokenizer_path), "packed")
    # A row a task and tier: where the task's sequences stand among all of the tier.
    counts = packed.where("offset = 0").groupBy("task", "tier").agg(F.count("*").alias("n"))
    order = Window.partitionBy("tier").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select("task", "tier", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("ahead"))
    totals = {r["tier"]: r["n"] for r in counts.groupBy("tier").agg(F.sum("n").alias("n")).collect()}
    first, used = F.lit(0).cast("long"), 0
    for tier in TIERS:
        first = F.when(F.col("tier") == tier, F.lit(used)).otherwise(first)
        used += -(-totals.get(tier, 0) * tier // STEP_TOKENS)
    group = (first + F.expr(f"(ahead + place) * tier div {STEP_TOKENS}")).cast("long")
    return packed.join(ahead, ["task", "tier"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", F.col("tier").cast("int").alias("tier"), group.alias("step_group"))


def cuts(packed: DataFrame) -> DataFrame:
    """Per tier, longest piece's: documents, those in one piece, and pieces. Repeated rows of a doc_id count as one."""
    per_doc = packed.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("tier").alias("tier"))
    return per_doc.groupBy("tier").agg(F.count("*").alias("documents"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("whole"), F.sum("n").alias("pieces"))
