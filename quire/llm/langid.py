"""Language identification by rank-order profiles.

A profile is the ranked list of the most frequent byte n-grams (one to three
bytes, of letters and word gaps) of a language's training texts. A document's
own ranked list is compared with each profile by the out-of-place distance:
the sum, over the document's n-grams, of the difference of ranks, with a fixed
penalty for n-grams that the profile lacks. The nearest profile wins.

Counts cover every training text: each task reports its n-gram counts by
language once per few slices, and those are summed. A profile has ``PROFILE``
entries, so what reaches the driver is bounded by languages x PROFILE. Scoring
is one pass without a shuffle.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
so is every text if nothing could be learned. Documents with null lang or text
teach nothing. Ties of counts go to the smaller n-gram, ties of distance to
the smaller language name. Repeated rows count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import byteops as B
from quire.llm.columns import map_arrow, named, own
from quire.llm.memory import returning

#: Ranked n-grams of a language profile and of a document.
PROFILE = 400

# What an n-gram sees: ASCII letters in lower case, bytes of other scripts, one gap for all else.
_GAP = 0x5F
_SEEN = np.full(256, _GAP, np.uint8)
_SEEN[0x61:0x7B] = np.arange(0x61, 0x7B)
_SEEN[0x41:0x5B] = np.arange(0x61, 0x7B)
_SEEN[0x80:] = np.arange(0x80, 0x100)


def _normal(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text as gap, words joined by single gaps, gap, gap."""
    n = np.diff(off)
    size = n + 3
    end = np.cumsum(size)
    out = np.full(int(end[-1]) if len(end) else 0, _GAP, np.uint8)
    owner = np.repeat(np.arange(len(n)), size)
    place = np.arange(len(buf)) + np.repeat(end - size + 1 - off[:-1], n)
    out[place] = _SEEN[buf]
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = (out[1:] != _GAP) | (out[:-1] != _GAP) | (owner[1:] != owner[:-1])
    kept = owner[keep]
    bounds = np.searchsorted(kept, np.arange(len(n) + 1))
    return out[keep], bounds


def gram_counts(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, n-gram, count) of all texts; an n-gram of fewer than three bytes has leading zeros.

    The three-byte counts come from one sort; the shorter ones are their sums.
    """
    seen, bounds = _normal(buf, off)
    owner = np.repeat(np.arange(len(off) - 1, dtype=np.uint64), np.diff(bounds))
    wide = np.concatenate((seen, np.full(2, _GAP, np.uint8))).astype(np.uint64)
    key = (owner << np.uint64(24)) | (wide[:-2] << np.uint64(16)) | (wide[1:-1] << np.uint64(8)) | wide[2:]
    # The byte after a text's last belongs to the next text: its n-grams end in gaps.
    last = bounds[1:][bounds[1:] > bounds[:-1]] - 1
    key[last] = (owner[last] << np.uint64(24)) | (wide[last] << np.uint64(16)) | np.uint64(_GAP << 8 | _GAP)
    key.sort()
    three, first = np.unique(key, return_index=True)
    count = np.diff(np.append(first, len(key)))
    doc, gram = three >> np.uint64(24), three & np.uint64(0xFFFFFF)
    parts = [(three, count)]
    for shift in (8, 16):
        short = (doc << np.uint64(24)) | (gram >> np.uint64(shift))
        edge = np.flatnonzero(np.append(True, short[1:] != short[:-1]))
        parts.append((short[edge], np.add.reduceat(count, edge) if len(edge) else count[:0]))
    key, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    return (key >> np.uint64(24)).astype(np.int64), (key & np.uint64(0xFFFFFF)).astype(np.int64), count


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


@lru_cache(maxsize=1)
def _ascii_letter() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[0x41:0x5B] = table[0x61:0x7B] = True
    return table


def lettered(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which texts have a letter; bytes decide unless a text has no ASCII letter."""
    total = np.concatenate(([0], np.cumsum(_ascii_letter()[buf])))
    out = np.diff(total[off]) > 0
    for i in np.flatnonzero(~out & (np.diff(off) > 0)).tolist():
        out[i] = has_letter(buf[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, list[int]]:
    """The profile of every language in ``docs``: its n-grams by rank."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = B.column(batch, lang).to_pylist()
            known = sorted(set(names))
            code = np.array([known.index(x) for x in names], np.int64)
            sums: list[tuple[np.ndarray, np.ndarray]] = []
            for lo, hi, buf, off in B.slices(B.column(batch, text)):
                owner, gram, n = gram_counts(buf, off)
                key, where = np.unique((code[lo:hi][owner] << 24) | gram, return_inverse=True)
                sums.append((key, np.bincount(where, n).astype(np.int64)))
            if not sums:
                continue
            key, where = np.unique(np.concatenate([k for k, _ in sums]), return_inverse=True)
            n = np.bincount(where, np.concatenate([c for _, c in sums])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([known[i] for i in (key >> 24).tolist()], pa.string()), pa.array((key & 0xFFFFFF).astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    taught = docs.where(named(text).isNotNull() & named(lang).isNotNull()).select(named(text), named(lang))
    counts = taught.mapInArrow(returning(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # The gap alone says nothing about a language.
    counts = counts.where(~F.col("gram").isin(_GAP, _GAP << 8 | _GAP, _GAP << 16 | _GAP << 8 | _GAP))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= PROFILE)
    profiles: dict[str, list[int]] = {}
    for row in ranked.orderBy("lang", "r").collect():
        profiles.setdefault(row["lang"], []).append(row["gram"])
    return profiles


class Ranker:
    """Distances of texts to profiles."""

    def __init__(self, profiles: dict[str, list[int]]):
        self.names = sorted(profiles)
        grams = sorted({g for p in profiles.values() for g in p})
        self.grams = np.array(grams, np.int64)
        self.ranks = np.full((len(grams) + 1, len(self.names)), -1, np.int32)  # the last row: in no profile
        for j, name in enumerate(self.names):
            at = np.searchsorted(self.grams, profiles[name])
            self.ranks[at, j] = np.arange(len(profiles[name]))

    def __call__(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest profile (-1: undetermined) and the score of each text."""
        n = len(off) - 1
        known = lettered(buf, off)
        if not self.names or not known.any():
            return np.full(n, -1), np.zeros(n)
        owner, gram, count = gram_counts(buf, off)
        keep = ~np.isin(gram, (_GAP, _GAP << 8 | _GAP, _GAP << 16 | _GAP << 8 | _GAP))
        owner, gram, count = owner[keep], gram[keep], count[keep]
        # by text, then falling count, then n-gram
        order = np.lexsort((gram, -count, owner))
        owner, gram = owner[order], gram[order]
        start = np.searchsorted(owner, np.arange(n))
        rank = np.arange(len(owner)) - start[owner]
        top = rank < PROFILE
        owner, gram, rank = owner[top], gram[top], rank[top]
        at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        at = np.where(self.grams[at] == gram, at, len(self.grams))
        theirs = self.ranks[at]
        apart = np.where(theirs < 0, PROFILE, np.abs(theirs - rank[:, None]))
        size = np.bincount(owner, minlength=n)
        distance = np.stack([np.bincount(owner, apart[:, j], minlength=n) for j in range(len(self.names))], axis=1) / np.maximum(size, 1)[:, None] / PROFILE
        best = distance.argmin(axis=1)
        known &= size > 0
        return np.where(known, best, -1), np.where(known, 1 - distance[np.arange(n), best], 0.0)


def predict(docs: DataFrame, profiles: dict[str, list[int]], text: str = "text", added: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """``docs`` with the language and its score in the columns ``added``; they replace columns of those names."""
    docs = docs.select(*[named(c) for c in own(docs, *added)])
    shared = docs.sparkSession.sparkContext.broadcast(profiles)  # languages x PROFILE integers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = Ranker(shared.value)
        for batch in batches:
            found, scores = [], []
            for _, _, buf, off in B.slices(B.column(batch, text)):
                best, score = ranker(buf, off)
                found += [ranker.names[i] if i >= 0 else "und" for i in best.tolist()]
                scores.append(score)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=[*batch.schema.names, *added])

    schema = T.StructType([*docs.schema.fields, T.StructField(added[0], T.StringType()), T.StructField(added[1], T.DoubleType())])
    return map_arrow(docs, run, schema)


def held_out(fold: int, of: int, doc_id: str = "doc_id"):
    """Whether crc32(doc_id as text) mod ``of`` is ``fold``; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % of == fold, F.lit(False))
