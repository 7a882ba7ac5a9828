"""Exact removal of repeated token spans over a compacted de Bruijn graph.

The edges of the graph are the windows of ``WINDOW`` consecutive words, its nodes
the ``WINDOW - 1`` words that an edge shares with the next. The graph is
compacted twice, and only its repeated part is ever built edge by edge:

1. Consecutive windows of a text that share their minimizer (the smallest hash
   of the ``SEED``-word sequences in them) are one path of it and travel as one
   row, a run. Equal windows have equal minimizers; a minimizer that only one
   document has is dropped at once. Runs of equal words are one class.
2. Where a minimizer has several classes, paths part or meet inside it. The
   windows of each such class become edges, once a class, and an edge's
   least document is found by a join on its hash.
3. Classes that follow each other in every text that has them, with one
   successor and one predecessor and side by side in their first text, do not
   branch. They compact into paths by joins that double the pointers to the
   path's head until none moves.
4. A repeated span is a stretch of a text along a path, or along the edges
   inside a run, with the coordinates of its source: the first document with
   it. The words there are digested, and a text gives up a span only if its own
   words have that digest.

So texts travel three times, whole ones once: for the edges and for the
sources, Bloom filters of a fixed size pick the few that are wanted first.

Defined cases: a null text has no words. Rows of null doc_id are left whole
and remove nothing from others. Rows of equal doc_id do not remove from each
other. Texts under ``WINDOW`` words are left whole. Of several documents with
a span, the one of the smallest doc_id keeps it. Other columns are kept,
whatever their names; columns that the operator adds are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import byteops as B
from quire.llm.columns import fresh, named, own
from quire.llm.memory import returning
from quire.session import materialize

WINDOW = 50
#: Words of a minimizer.
SEED = 10
#: Bits of a Bloom filter. It is broadcast, 8 MB whatever the input; where it is full it lets all pass, and joins decide.
BITS = 1 << 26

_RUNS = "doc long, h long, m long, x long, before long, after long, start int, n int"


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i:i+width]) for every i that has a full window."""
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def runs(buf: np.ndarray, off: np.ndarray, window: int = WINDOW, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """Runs of all texts: text, first window, windows, minimizer, hash of the run's words."""
    starts, ends, bounds = B.words(buf, off)
    n = np.diff(bounds)
    none = np.zeros(0, np.int64)
    if len(starts) < window:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    h = B.word_hashes(buf, starts, ends)
    spot = np.arange(len(starts) - seed + 1)
    low = _sliding_min(B.span_hash(h, spot, spot + seed), window - seed + 1)
    spot = np.arange(len(low))
    owner = np.repeat(np.arange(len(n)), n)[: len(low)]
    real = spot + window <= bounds[1:][owner]
    spot, low, owner = spot[real], low[real], owner[real]
    if not len(spot):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    first = np.flatnonzero(np.append(True, (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])))
    count = np.diff(np.append(first, len(spot)))
    at, owner = spot[first], owner[first]
    return owner, at - bounds[owner], count, low[first], B.span_hash(h, at, at + count + window - 1)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, hashes = B.longs(B.column(batch, "doc")), B.longs(B.column(batch, "h"))
        for lo, hi, buf, off in B.slices(B.column(batch, "text")):
            owner, start, count, low, x = runs(buf, off)
            if not len(owner):
                continue
            x = x.view(np.int64)
            same = owner[1:] == owner[:-1]
            before, after = pa.array(np.append(0, x[:-1]), mask=np.append(True, ~same)), pa.array(np.append(x[1:], 0), mask=np.append(~same, True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs[lo:hi][owner]), pa.array(hashes[lo:hi][owner]), pa.array(low.view(np.int64)), pa.array(x), before, after, pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))],
                names=["doc", "h", "m", "x", "before", "after", "start", "n"],
            )


# -- Bloom filters -----------------------------------------------------------------------


def _spots(keys: np.ndarray, size: int) -> np.ndarray:
    """Two of ``size`` bits for each key."""
    x = B.mix(keys.view(np.uint64))
    return np.concatenate((x & np.uint64(size - 1), (x >> np.uint64(32)) & np.uint64(size - 1))).astype(np.int64)


def bloom(keys: DataFrame):
    """A broadcast Bloom filter of a table of one or two long columns; two count as one key."""
    size = BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.unique(_spots(_key(batch), size))
            word = bits >> 6
            edge = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else word
            ones = np.left_shift(np.uint64(1), (bits & 63).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(word[edge]), pa.array((np.bitwise_or.reduceat(ones, edge) if len(edge) else ones).view(np.int64))], names=["word", "bits"])

    found = keys.mapInArrow(returning(run), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(size // 64, np.uint64)
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(table)


def _key(batch: pa.RecordBatch) -> np.ndarray:
    first = B.longs(batch.column(0))
    return first if batch.num_columns == 1 else (B.mix(first.view(np.uint64)) ^ B.longs(batch.column(1)).view(np.uint64)).view(np.int64)


def held(keys: pa.RecordBatch, table: np.ndarray) -> np.ndarray:
    """Which rows' keys may be in the filter."""
    spots = _spots(_key(keys), 64 * len(table))
    hit = (table[spots >> 6] >> (spots & 63).astype(np.uint64)) & np.uint64(1)
    return (hit[: keys.num_rows] & hit[keys.num_rows :]).astype(bool)


def sift(df: DataFrame, columns: list[str], sieve) -> DataFrame:
    """Rows of ``df`` whose key of these columns may be in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sieve.value
        for batch in batches:
            both = held(batch.select(columns), table)
            if both.any():
                yield batch.filter(pa.array(both))

    return df.mapInArrow(returning(run), df.schema)


def fetch(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (doc, h and more, a row a text) with the text."""
    return sift(texts, ["doc", "h"], bloom(wanted.select("doc", "h"))).dropDuplicates(["doc", "h"]).join(wanted, ["doc", "h"])


# -- The graph ---------------------------------------------------------------------------


def classes_of(kept: DataFrame) -> DataFrame:
    """A row for each distinct run: x, m, n, first (doc, h, start), last (the largest doc), its only neighbours or null."""
    found = kept.groupBy("x").agg(
        F.min("m").alias("m"), F.min("n").alias("n"), F.min(F.struct("doc", "h", "start")).alias("first"), F.max("doc").alias("last"),
        F.min("before").alias("b1"), F.max("before").alias("b2"), F.min("after").alias("a1"), F.max("after").alias("a2"),
    )
    return found.select("x", "m", "n", "first", "last", F.when(F.col("b1") == F.col("b2"), F.col("b1")).alias("before"), F.when(F.col("a1") == F.col("a2"), F.col("a1")).alias("after"))


def paths(classes: DataFrame) -> DataFrame:
    """x, head, ahead: each repeated class with its nonbranching path's first class and the windows before it."""
    repeated = classes.where("first.doc < last").select("x", "n", "first", "before", "after")
    left = repeated.select(F.col("x").alias("p"), F.col("n").alias("pn"), F.col("first").alias("pf"), F.col("after").alias("pa"))
    side_by_side = (F.col("pf.doc") == F.col("first.doc")) & (F.col("pf.h") == F.col("first.h")) & (F.col("pf.start") + F.col("pn") == F.col("first.start"))
    step = repeated.join(left, (F.col("before") == F.col("p")) & (F.col("pa") == F.col("x")) & side_by_side, "left")
    # Starts grow along a path, so there is no way round in it.
    pointers = materialize(step.select("x", F.coalesce("p", "x").alias("head"), F.coalesce("pn", F.lit(0)).cast("long").alias("ahead"), F.col("p").isNotNull().alias("moved")), "paths")
    while pointers.where("moved").limit(1).count():
        up = pointers.where("head <> x").select(F.col("x").alias("head"), F.col("head").alias("up"), F.col("ahead").alias("more"))
        jumped = pointers.select("x", "head", "ahead").join(up, "head", "left")
        pointers = materialize(jumped.select("x", F.coalesce("up", "head").alias("head"), (F.col("ahead") + F.coalesce("more", F.lit(0))).alias("ahead"), F.col("up").isNotNull().alias("moved")), "paths")
    return pointers.select("x", "head", "ahead")


def edges_of(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """x, i, e, doc: the windows of every class whose minimizer has another class too, and the class's first document."""
    contested = classes.groupBy("m").agg(F.count("*").alias("variants")).where("variants > 1").select("m")
    wanted = classes.join(contested, "m").select("x", "n", "first.*")
    wanted = materialize(wanted.groupBy("doc", "h").agg(F.collect_list(F.struct("x", "start", "n")).alias("runs")), "contested")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, docs = B.column(batch, "runs"), B.longs(B.column(batch, "doc"))
            for lo, hi, buf, off in B.slices(B.column(batch, "text")):
                starts, ends, bounds = B.words(buf, off)
                h = B.word_hashes(buf, starts, ends)
                part = lists.slice(lo, hi - lo)
                items = part.flatten()
                x, start, n = (B.longs(items.field(c)) for c in ("x", "start", "n"))
                base = np.repeat(bounds[:-1], np.diff(part.offsets.to_numpy())) + start
                i = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(base, n) + i
                e = B.span_hash(h, at, at + WINDOW)
                doc = np.repeat(np.repeat(docs[lo:hi], np.diff(part.offsets.to_numpy())), n)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(x, n)), pa.array(i.astype(np.int32)), pa.array(e.view(np.int64)), pa.array(doc)], names=["x", "i", "e", "doc"])

    return fetch(texts, wanted).mapInArrow(returning(run), "x long, i int, e long, doc long")


def spans_of(texts: DataFrame) -> DataFrame:
    """doc, h, s, e (words), and the source's sdoc, sh, ss: every span that a smaller doc has, by hashes."""
    every = materialize(texts.mapInArrow(returning(_runs), _RUNS), "runs")
    shared = every.groupBy("m").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("m")
    kept = materialize(sift(every, ["m"], bloom(shared)), "shared")
    classes = materialize(classes_of(kept), "classes")

    # Along paths of whole runs.
    on = paths(classes)
    heads = classes.select(F.col("x").alias("head"), F.col("first").alias("hf"))
    placed = on.join(classes.select("x", "first"), "x").join(heads, "head").select("x", "head", "ahead", F.col("first.doc").alias("least"), "hf")
    met = kept.join(placed, "x").where("doc > least").withColumn("zero", F.col("start") - F.col("ahead"))
    whole = met.groupBy("doc", "h", "head", "zero").agg(F.min("start").alias("s"), (F.max(F.col("start") + F.col("n")) + (WINDOW - 1)).alias("e"), F.first("hf").alias("hf"))
    whole = whole.select("doc", "h", "s", "e", F.col("hf.doc").alias("sdoc"), F.col("hf.h").alias("sh"), (F.col("hf.start") + F.col("s") - F.col("zero")).alias("ss"))

    # Along the edges inside runs: only the first text of a class is still open.
    edges = materialize(edges_of(texts, classes), "edges")
    least = edges.groupBy("e").agg(F.min(F.struct("doc", "x", "i")).alias("source"), F.max("doc").alias("most")).where("source.doc < most").select("e", "source")
    hits = edges.join(least, "e").where("source.doc < doc").select("x", "i", F.col("source.x").alias("sx"), (F.col("source.i") - F.col("i")).alias("lane"))
    order = Window.partitionBy("x", "sx", "lane").orderBy("i")
    hits = hits.withColumn("island", F.col("i") - F.row_number().over(order))
    pieces = hits.groupBy("x", "sx", "lane", "island").agg(F.min("i").alias("i"), F.max("i").alias("j"))
    firsts = kept.join(classes.select("x", F.col("first.doc").alias("doc")), ["x", "doc"]).select("x", "doc", "h", "start")
    sources = classes.select(F.col("x").alias("sx"), F.col("first.doc").alias("sdoc"), F.col("first.h").alias("sh"), F.col("first.start").alias("at"))
    inside = pieces.join(firsts, "x").join(sources, "sx").select("doc", "h", (F.col("start") + F.col("i")).alias("s"), (F.col("start") + F.col("j") + WINDOW).alias("e"), "sdoc", "sh", (F.col("at") + F.col("lane") + F.col("i")).alias("ss"))
    return whole.select("doc", "h", F.col("s").cast("int"), F.col("e").cast("int"), "sdoc", "sh", F.col("ss").cast("int")).unionByName(inside.select("doc", "h", F.col("s").cast("int"), F.col("e").cast("int"), "sdoc", "sh", F.col("ss").cast("int")))


# -- Words -------------------------------------------------------------------------------


def _digest(raw: bytes, starts: np.ndarray, ends: np.ndarray, s: int, e: int) -> bytes:
    """A digest of the words from s to e of a text."""
    own = b" ".join([raw[a:b] for a, b in zip(starts[s:e].tolist(), ends[s:e].tolist(), strict=True)])
    return hashlib.blake2b(own, digest_size=16).digest()


def digests(texts: DataFrame, sources: DataFrame) -> DataFrame:
    """``sources`` (sdoc, sh, ss, size) with the digest of the words at these coordinates."""
    wanted = sources.groupBy(F.col("sdoc").alias("doc"), F.col("sh").alias("h")).agg(F.collect_set(F.struct("ss", "size")).alias("places"))
    schema = "sdoc long, sh long, ss int, size int, digest binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            docs, hashes, places = (B.column(batch, c) for c in ("doc", "h", "places"))
            for lo, hi, buf, off in B.slices(B.column(batch, "text")):
                starts, ends, bounds = B.words(buf, off)
                raw = buf.tobytes()
                for i in range(lo, hi):
                    a, b = bounds[i - lo], bounds[i - lo + 1]
                    rows += [(docs[i].as_py(), hashes[i].as_py(), p["ss"], p["size"], _digest(raw, starts[a:b], ends[a:b], p["ss"], p["ss"] + p["size"])) for p in places[i].as_py()]
            yield pa.RecordBatch.from_pylist([dict(zip(("sdoc", "sh", "ss", "size", "digest"), r, strict=True)) for r in rows], schema=pa.schema([("sdoc", pa.int64()), ("sh", pa.int64()), ("ss", pa.int32()), ("size", pa.int32()), ("digest", pa.binary())]))

    return fetch(texts, materialize(wanted, "sources")).mapInArrow(returning(run), schema)


def _cut(raw: bytes, spans: list[dict], starts: np.ndarray, ends: np.ndarray) -> tuple[int, bytes]:
    """Words removed, and the rest joined by single spaces; a span goes if its words have its source's digest."""
    n = len(starts)
    gone = np.zeros(n + 1, np.int64)
    for x in spans:
        s, e = x["s"], x["e"]
        if e <= n and _digest(raw, starts, ends, s, e) == x["digest"]:
            gone[s] += 1
            gone[e] -= 1
    keep = np.cumsum(gone[:-1]) == 0
    kept = [raw[a:b] for a, b in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)]
    return n - int(keep.sum()), b" ".join(kept)


def remove_repeats(docs: DataFrame, text: str = "text", digest_only: bool = False, added: list[str] | None = None) -> DataFrame:
    """``docs`` with n_words, n_removed and kept_text (or kept_sha256 with ``digest_only``), or these by the names in ``added``."""
    added = added or ["n_words", "n_removed", "kept_sha256" if digest_only else "kept_text"]
    kept = own(docs, *added, *([text] if digest_only else []))
    docs = docs.select(*[named(c) for c in own(docs, *added)])
    id_, hash_, found_ = fresh([*docs.columns, *added], "_doc", "_h", "_spans")

    def key(name: str) -> Column:
        return named(name).cast("long")

    sound = docs.where(F.col("doc_id").isNotNull() & named(text).isNotNull())
    texts = sound.select(key("doc_id").alias("doc"), F.xxhash64(named(text)).alias("h"), named(text).alias("text"))
    spans = materialize(spans_of(texts), "spans").withColumn("size", F.col("e") - F.col("s"))
    proven = spans.join(digests(texts, spans.select("sdoc", "sh", "ss", "size").distinct()), ["sdoc", "sh", "ss", "size"])
    # A text's spans number at most a few for each of its words.
    listed = proven.groupBy(F.col("doc").alias(id_), F.col("h").alias(hash_)).agg(F.collect_set(F.struct("s", "e", "digest")).alias(found_))
    keyed = docs.withColumns({id_: key("doc_id"), hash_: F.xxhash64(named(text))})
    # Rows without an id or text have no key to join by.
    joined = keyed.where(named(id_).isNotNull() & named(text).isNotNull()).join(listed, [id_, hash_], "left")
    apart = keyed.where(named(id_).isNull() | named(text).isNull()).withColumn(found_, F.lit(None).cast(joined.schema[found_].dataType))
    columns = [named(c).alias(f"c{i}") for i, c in enumerate(kept)]
    joined = joined.unionByName(apart).select(*columns, named(text).alias("text"), named(found_).alias("spans"))
    fields = docs.select(*[named(c) for c in kept]).schema.fields
    schema = T.StructType([*fields, T.StructField(added[0], T.LongType()), T.StructField(added[1], T.LongType()), T.StructField(added[2], T.StringType())])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans_of_text = B.column(batch, "spans")
            rest = batch.columns[: len(kept)]
            for lo, hi, buf, off in B.slices(B.column(batch, "text")):
                starts, ends, bounds = B.words(buf, off)
                raw = buf.tobytes()
                removed, out = [], []
                for i, mine in enumerate(spans_of_text.slice(lo, hi - lo).to_pylist()):
                    a, b = bounds[i], bounds[i + 1]
                    gone, left = _cut(raw, mine or (), starts[a:b], ends[a:b])
                    removed.append(gone)
                    out.append(hashlib.sha256(left).hexdigest() if digest_only else left.decode())
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in rest), pa.array(np.diff(bounds).astype(np.int64)), pa.array(removed, pa.int64()), pa.array(out, pa.string())], names=names)

    return joined.mapInArrow(returning(run), schema)
