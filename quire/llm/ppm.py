"""Language-model scoring by prediction by partial matching (PPM) over bytes.

A text is read as its words in lower case (A-Z) with single spaces between
them and an end symbol. The model is a byte-context trie of depth ``ORDER``:
the probability of a symbol after its longest known context, with escapes to
shorter contexts estimated by method D (half a count for each distinct symbol)
and with symbol exclusion: after an escape, symbols known in the longer
context no longer compete in the shorter one. Because a symbol known in a
context is known in every suffix of it, what to exclude follows from the
context one longer alone, and the cost of a symbol is a function of its
``ORDER + 1`` bytes (the gram), whatever the document.

So the trie is priced gram by gram, and no machine holds all of it:

1. Documents are dealt to blocks of about ``BLOCK_BYTES``, copies of a row by
   the partition they come from. A block reports each distinct gram (and word)
   with its training count, split into ranges by the last three context bytes,
   and its counts of byte triples.
2. A range has all grams with its contexts, sums their counts over all blocks,
   builds its part of the trie and prices each gram. Ranges grow in number
   with the shuffle partitions. Only the counts of byte triples, for the
   three shortest orders, are needed everywhere: 2 ** 24 at most, and far fewer in text.
3. Prices return to the blocks that asked, and each block adds up the code
   length of its documents from its own grams.

Counts cover every training text. What is shuffled is the texts, once for each of the
two passes, and the distinct grams of each block.

The documents must come in the same partitions in both passes, as a table's
files do; rows that come otherwise raise an error, never a wrong score.

Defined cases: a null, empty or wordless text is the end symbol alone. Rows of
null doc_id are training rows. Without any training text every symbol costs
1/256. Repeated rows count and are scored as often as they occur.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import byteops as B
from quire.llm.langid import held_out
from quire.session import materialize

#: Bytes of context.
ORDER = 5
#: Bytes of text in a block, on average.
BLOCK_BYTES = 12 << 20
#: Ends a text and stands before it; white space never occurs inside a word.
END = 0x0A
#: The kind of rows that hold a block's byte triples; 0 and 1 are grams and words.
TRIPLES = 2
_TRIPLE = np.uint64(0xFFFFFF)
#: The key of the end token among word hashes.
END_KEY = 0x0A0A0A0A0A0A0A0B


def stream(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Grams of all symbols, where each text's begin, word hashes, and where each text's words begin."""
    starts, ends, bounds = B.words(buf, off)
    texts, size = len(off) - 1, ends - starts
    low = B.LOWER[buf]
    n = np.diff(bounds)
    owner = np.repeat(np.arange(texts), n)
    symbols = np.bincount(owner, size + 1, minlength=texts).astype(np.int64) if texts else np.zeros(0, np.int64)
    symbols[n == 0] = 1
    base = np.cumsum(symbols + ORDER) - symbols - ORDER
    out = np.full(int((symbols + ORDER).sum()), 0x20, np.uint8)
    # Words go to their places; each leaves one space after it.
    within = np.cumsum(size + 1) - (size + 1)
    first = within[bounds[:-1][n > 0]] if len(size) else within
    lead = np.zeros(texts, np.int64)
    lead[n > 0] = first
    at = within - lead[owner] + base[owner] + ORDER
    total = int(size.sum())
    ahead = np.cumsum(size) - size
    out[np.arange(total) + np.repeat(at - ahead, size)] = low[~B.SPACE[buf]]
    out[base + ORDER + symbols - 1] = END
    out[(base[:, None] + np.arange(ORDER)).reshape(-1)] = END
    wide = np.zeros(max(0, len(out) - ORDER), np.uint64)
    for j in range(ORDER + 1):
        wide = (wide << np.uint64(8)) | out[j : len(out) - ORDER + j]
    real = np.ones(len(wide), dtype=bool)
    pads = (base[1:, None] - ORDER + np.arange(ORDER)).reshape(-1)  # symbols of the next text's padding
    real[pads] = False
    return wide[real], np.concatenate(([0], np.cumsum(symbols))), B.word_hashes(low, starts, ends), bounds


def _tally(keys: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    keys = np.asarray(keys)
    if weight is None:
        keys = np.sort(keys)
        edge = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        return keys[edge], np.diff(np.append(edge, len(keys)))
    order = np.argsort(keys)
    keys, weight = keys[order], weight[order]
    edge = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[edge], np.add.reduceat(weight, edge) if len(edge) else weight[:0]


def _zip(values: np.ndarray) -> bytes:
    """An array of 8-byte values as compressed byte planes."""
    return zlib.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unzip(data: bytes, dtype=np.uint64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T).reshape(-1).view(dtype)


def _zip_sorted(keys: np.ndarray) -> bytes:
    return _zip(np.diff(keys, prepend=np.uint64(0)))


def _unzip_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unzip(data), dtype=np.uint64)


def _collect(ranges: int):
    """A block's distinct grams and words with training counts, by kind and range."""

    def run(group: pa.Table) -> pa.Table:
        column = group.column("text").combine_chunks()
        held = group.column("held_out").to_numpy()
        found: dict[int, list] = {0: [], 1: []}
        for lo, hi, buf, off in B.slices(column):
            grams, at, words, bounds = stream(buf, off)
            for kind, keys, edges in ((0, grams, at), (1, words, bounds)):
                trained = np.repeat(~held[lo:hi], np.diff(edges))
                keys, count = _tally(keys, trained.astype(np.int64))
                found[kind].append((keys, count))
        found[1].append((np.array([END_KEY], np.uint64), np.array([int((~held).sum())])))
        rows = []
        for kind, parts in found.items():
            keys, count = _tally(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
            if kind == 0:
                triples, seen = _tally(keys & _TRIPLE, count)
                rows.append((TRIPLES, 0, _zip_sorted(triples[seen > 0]), _zip(seen[seen > 0].astype(np.int64))))
            r = (B.mix((keys >> np.uint64(8)) & _TRIPLE if kind == 0 else keys) % np.uint64(ranges)).astype(np.int64)
            order = np.argsort(r, kind="stable")
            edges = np.searchsorted(r[order], np.arange(ranges + 1))
            for i in range(ranges):
                own = order[edges[i] : edges[i + 1]]
                if len(own):
                    rows.append((kind, i, _zip_sorted(keys[own]), _zip(count[own].astype(np.int64))))
        block = group.column("block")[0].as_py()
        return pa.table(
            {
                "block": pa.array([block] * len(rows), pa.int64()),
                "kind": pa.array([x[0] for x in rows], pa.int32()),
                "r": pa.array([x[1] for x in rows], pa.int32()),
                "keys": pa.array([x[2] for x in rows], pa.binary()),
                "data": pa.array([x[3] for x in rows], pa.binary()),
            }
        )

    return run


def _find(keys: np.ndarray, values: np.ndarray, query: np.ndarray) -> np.ndarray:
    """values at the sorted keys that equal the query, else 0."""
    if not len(keys):
        return np.zeros(len(query))
    at = np.minimum(np.searchsorted(keys, query), len(keys) - 1)
    return np.where(keys[at] == query, values[at], 0.0)


def _contexts(level: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts of a level with their total counts and numbers of distinct symbols."""
    keys, count = level
    ctx, total = _tally(keys >> np.uint64(8), count)
    _, distinct = _tally(keys >> np.uint64(8), np.ones(len(keys)))
    return ctx, total, distinct


def price(grams: np.ndarray, count: np.ndarray, triples: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """log10 probability of each gram's symbol after its context.

    ``grams`` are sorted and hold every gram of their last three context bytes;
    ``triples`` are the sorted byte triples of all training texts and their counts.
    """
    known = count > 0
    levels = {ORDER: (grams[known], count[known].astype(np.float64))}
    for o in range(ORDER - 1, 2, -1):
        keys, c = levels[o + 1]
        levels[o] = _tally(keys & np.uint64((1 << 8 * (o + 1)) - 1), c)
    levels[2] = (triples[0], triples[1].astype(np.float64))
    for o in (1, 0):
        keys, c = levels[o + 1]
        levels[o] = _tally(keys & np.uint64((1 << 8 * (o + 1)) - 1), c)
    out, done = np.zeros(len(grams)), np.zeros(len(grams), dtype=bool)
    for o in range(ORDER, -1, -1):
        mask = np.uint64((1 << 8 * (o + 1)) - 1)
        query = grams & mask
        ctx, total, distinct = _contexts(levels[o])
        t, d = _find(ctx, total, query >> np.uint64(8)), _find(ctx, distinct, query >> np.uint64(8))
        if o < ORDER:
            keys, _ = levels[o + 1]
            above, excluded = _tally(keys >> np.uint64(8), _find(*levels[o], keys & mask))
            _, symbols = _tally(keys >> np.uint64(8), np.ones(len(keys)))
            longer = (grams & np.uint64((1 << 8 * (o + 2)) - 1)) >> np.uint64(8)
            t -= _find(above, excluded, longer)
            d -= _find(above, symbols, longer)
        f = _find(*levels[o], query)
        active = ~done & (t > 0)
        hit, miss = active & (f > 0), active & (f == 0)
        out[hit] += np.log10((f[hit] - 0.5) / t[hit])
        out[miss] += np.log10(d[miss] / 2 / t[miss])
        done |= hit
    out[~done] -= np.log10(256 - len(levels[0][0]))
    return out


def _price_range(triples):
    """``triples`` is a broadcast of what ``price`` takes."""

    def run(group: pa.Table) -> pa.Table:
        kind = group.column("kind")[0].as_py()
        keys = [_unzip_sorted(x) for x in group.column("keys").to_pylist()]
        counts = [_unzip(x, np.int64) for x in group.column("data").to_pylist()]
        every, total = _tally(np.concatenate(keys), np.concatenate(counts))
        value = price(every, total, triples.value) if kind == 0 else total.astype(np.float64)
        back = [_zip(value[np.searchsorted(every, k)]) for k in keys]
        new = [int(total.sum()) if kind else 0, int((total > 0).sum()) if kind else 0]
        once = np.arange(len(keys)) == 0  # one row of the range carries its sums
        return pa.table(
            {
                "block": group.column("block"),
                "kind": group.column("kind"),
                "keys": group.column("keys"),
                "data": pa.array(back, pa.binary()),
                "tokens": pa.array(np.where(once, new[0], 0)),
                "types": pa.array(np.where(once, new[1], 0)),
            }
        )

    return run


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, count_log double, score double"


def _score(docs: pa.Table, priced: pa.Table) -> pa.Table:
    table = {}
    kinds = priced.column("kind").to_numpy() if len(priced) else np.zeros(0, np.int32)
    for kind in (0, 1):
        rows = priced.filter(pa.array(kinds == kind))
        keys = [_unzip_sorted(x) for x in rows.column("keys").to_pylist()]
        data = [_unzip(x, np.float64) for x in rows.column("data").to_pylist()]
        table[kind] = (pd.Index(np.concatenate(keys).view(np.int64)), np.concatenate(data))
    (gram_index, cost), (word_index, count) = table[0], table[1]
    ends = float(count[word_index.get_indexer(np.array([END_KEY], np.int64))][0])
    column = docs.column("text").combine_chunks()
    parts = []
    for _, _, buf, off in B.slices(column):
        grams, at, words, bounds = stream(buf, off)
        where = gram_index.get_indexer(grams.view(np.int64))
        if (where < 0).any():
            raise ValueError("a block's rows differ between the two passes: write the documents before scoring them")
        score = np.add.reduceat(cost[where], at[:-1])
        c = np.append(count[word_index.get_indexer(words.view(np.int64))], 0.0)
        logs, known = np.concatenate(([0.0], np.cumsum(np.log10(c + 1)))), np.concatenate(([0], np.cumsum(c > 0)))
        parts.append((np.diff(bounds) + 1, known[bounds[1:]] - known[bounds[:-1]] + (ends > 0), logs[bounds[1:]] - logs[bounds[:-1]] + np.log10(ends + 1), score))
    n_tokens, n_known, count_log, score = (np.concatenate(x) for x in zip(*parts, strict=True))
    return pa.table({"doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": pa.array(n_tokens.astype(np.int64)), "n_known": pa.array(n_known.astype(np.int64)), "count_log": pa.array(count_log), "score": pa.array(score)})


def byte_triples(grams: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The byte triples of all training texts and their counts, from the blocks' own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(_unzip_sorted(k), _unzip(d, np.int64)) for batch in batches for k, d in zip(B.column(batch, "keys").to_pylist(), B.column(batch, "data").to_pylist(), strict=True)]
        if parts:
            keys, n = _tally(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["code", "n"])

    found = grams.where(F.col("kind") == TRIPLES).select("keys", "data").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    code, n = (found.column(c).to_numpy() for c in ("code", "n"))
    order = np.argsort(code)
    return code[order].astype(np.uint64), n[order]


def score(docs: DataFrame, fold: int = 2, of: int = 7) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``.

    Rows whose crc32(doc_id as text) mod ``of`` is ``fold`` are held out of training.
    """
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), held_out(fold, of).alias("held_out"))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(blocks))).repartition(max(parts, 1), "block")
    ranges = max(16, 2 * parts)
    grams = materialize(dealt.groupBy("block").applyInArrow(_collect(ranges), "block long, kind int, r int, keys binary, data binary"), "grams")
    triples = spark.sparkContext.broadcast(byte_triples(grams))
    priced = grams.where(F.col("kind") != TRIPLES).groupBy("kind", "r").applyInArrow(_price_range(triples), "block long, kind int, keys binary, data binary, tokens long, types long")
    priced = materialize(priced, "priced")
    tokens, types = priced.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    scored = dealt.groupBy("block").cogroup(priced.select("block", "kind", "keys", "data").groupBy("block")).applyInArrow(_score, _SCORED)
    base = F.col("count_log") - F.col("n_tokens") * F.log10(F.lit(tokens + types + 1))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
