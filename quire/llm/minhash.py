"""Near-duplicate groups by SuperMinHash signatures, banding, exact checks and union-find.

Signatures. SuperMinHash gives each shingle a random permutation of the
``SLOTS`` slots and puts ``round + random`` into the slot that its permutation
names in that round, so a slot's minimum is mostly decided in the first
rounds and one shingle never decides two slots of a round: the ranks of one
shingle are correlated, and the estimate varies less. A document stops as soon
as no later round can lower a slot. All documents of a slice run a round
together as arrays.

Groups. Documents with equal shingle sets (equal size and 128-bit sum of
hashes) are one class and go on as their smallest member. Signatures are cut
into ``BANDS`` bands. Classes that share a band with each other are joined to
the band's smallest class, and what hangs together that way is a family: every
pair that shares any band is inside one family. Links are decided on the full
shingle sets, through an inverted index, and only the links that join two
components are reported, so rows grow with members and not with their square.

* Families of at most ``BLOCK`` classes are compared whole, many in one group.
* In larger ones, first every class is compared with the smallest class of
  each band that it shares, in blocks of the band's members. Bands whose
  classes are in one component then are done. In the others, the classes
  outside the band's largest component are compared with all classes of the
  band, block by block. So texts travel for the bands that are still open, and every pair
  that shares a band is decided.

A pair at the threshold shares no band with probability
(1 - t ** ROWS) ** BANDS: 8e-7 at t = 0.85 and 7e-5 at 0.8.

Defined cases: null and wordless texts have no shingles and are linked with
nothing. Texts of fewer words than a shingle are one shingle. Rows of null
doc_id are linked with nothing, have a null component and are kept. Rows that
share a doc_id are one node. Other columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import byteops as B
from quire.llm.columns import fresh, named
from quire.llm.components import components
from quire.llm.memory import returning
from quire.llm.pretokens import ragged
from quire.session import materialize

BANDS, ROWS = 24, 5
SLOTS = BANDS * ROWS
#: Shingles whose permutations are drawn at a time: ``SLOTS`` bytes each.
CHUNK = 1 << 18
#: Classes that one group compares at most with each other, and about how many small families' classes share a group.
BLOCK, BIN = 1000, 500


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, and where each text's begin."""
    starts, ends, bounds = B.words(buf, off)
    h, at = B.shingles(B.word_hashes(B.LOWER[buf], starts, ends), bounds, k)
    owner = np.repeat(np.arange(len(off) - 1), np.diff(at))
    order = np.argsort(h)
    by = owner[order]
    order = order[np.argsort(by.astype(np.uint16) if len(off) < 1 << 16 else by, kind="stable")]
    h, owner = h[order], owner[order]
    if len(h):
        new = np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))
        h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(len(off)))


def signatures(h: np.ndarray, bounds: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash values (texts x slots); inf where a text has no shingle."""
    texts = len(bounds) - 1
    out = np.full(texts * slots, np.inf)
    owner = np.repeat(np.arange(texts), np.diff(bounds))
    for lo in range(0, len(h), CHUNK):
        _lower(out, h[lo : lo + CHUNK], owner[lo : lo + CHUNK], texts, slots)
    return out.reshape(texts, slots)


def _lower(out: np.ndarray, h: np.ndarray, owner: np.ndarray, texts: int, slots: int) -> None:
    """Lower the slots ``out`` of all texts by these shingles; a slot's value is the least over all of them."""
    order = np.tile(np.arange(slots, dtype=np.uint8), (len(h), 1))
    live = np.arange(len(h))
    for j in range(slots):
        x = B.mix(h[live] + np.uint64(((j + 1) * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)))
        pick = j + ((x & np.uint64(0xFFFF)) * np.uint64(slots - j) >> np.uint64(16)).astype(np.int64)
        slot = order[live, pick]
        order[live, pick] = order[live, j]
        np.minimum.at(out, owner[live] * slots + slot, j + (x >> np.uint64(11)).astype(np.float64) / 9007199254740992.0)
        again = out.reshape(texts, slots).max(axis=1) >= j + 1 if texts else np.zeros(0, bool)
        live = live[again[owner[live]]]
        if not len(live):
            break


def band_keys(values: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """(texts x bands) 64-bit keys; equal keys mean equal band and place."""
    texts, slots = values.shape
    bits = np.ascontiguousarray(values).view(np.uint64).reshape(texts, bands, slots // bands)
    key = np.broadcast_to(B.mix(np.arange(1, bands + 1, dtype=np.uint64)), (texts, bands)).copy()
    for r in range(slots // bands):
        key = B.mix(key ^ bits[:, :, r]) + np.uint64(r + 1)
    return key.view(np.int64)


def sketch(docs: DataFrame, k: int, text: str = "text") -> DataFrame:
    """doc_id, h (hash of the text), n, d1, d2 (the set's size and sums), bands."""
    schema = "doc_id long, h long, n long, d1 long, d2 long, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text_hash = B.column(batch, "doc_id"), B.column(batch, "h")
            for lo, hi, buf, off in B.slices(B.column(batch, "text")):
                h, bounds = shingle_sets(buf, off, k)
                values = signatures(h, bounds)
                keys = band_keys(values)
                sums = []
                for salt in (0x51ED270B, 0x2545F491):
                    total = np.zeros(len(h) + 1, np.uint64)
                    np.cumsum(B.mix(h + np.uint64(salt)), out=total[1:])
                    sums.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, hi - lo),
                        text_hash.slice(lo, hi - lo),
                        pa.array(np.diff(bounds).astype(np.int64)),
                        pa.array(sums[0]),
                        pa.array(sums[1]),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.reshape(-1))),
                    ],
                    names=["doc_id", "h", "n", "d1", "d2", "bands"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(named(text)).alias("h"), named(text).alias("text")).mapInArrow(returning(run), schema)


def _sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``shingle_sets`` of a whole group's texts."""
    parts = [shingle_sets(buf, off, k) for _, _, buf, off in B.slices(texts)]
    sizes = np.concatenate([np.diff(bounds) for _, bounds in parts])
    return np.concatenate([h for h, _ in parts]), np.concatenate(([0], np.cumsum(sizes)))


class _Index:
    """An inverted index over the shingle sets of a group's texts."""

    def __init__(self, texts: pa.Array, k: int):
        h, self.bounds = _sets(texts, k)
        self.size = np.diff(self.bounds)
        owner = np.repeat(np.arange(len(self.size)), self.size)
        order = np.argsort(h, kind="stable")
        run = np.cumsum(np.append(True, h[order][1:] != h[order][:-1])) - 1 if len(h) else np.zeros(0, np.int64)
        self.term = np.empty(len(h), np.int64)
        self.term[order] = run
        self.posting = owner[order]
        self.start = np.searchsorted(run, np.arange(run[-1] + 2 if len(run) else 1))

    def linked(self, i: int, percent: int) -> np.ndarray:
        """Texts whose set has the wanted similarity with that of text ``i``."""
        terms = self.term[self.bounds[i] : self.bounds[i + 1]]
        at = self.start[terms]
        common = np.bincount(self.posting[ragged(at, self.start[terms + 1] - at)], minlength=len(self.size))
        return np.flatnonzero((common > 0) & (100 * common >= percent * (self.size + self.size[i] - common)))


def _joined(index: _Index, comp: np.ndarray, rows: list[int], percent: int) -> list[tuple[int, int]]:
    """Links of ``rows`` with any text that join two components; ``comp`` follows."""
    out = []
    for i in rows:
        if (comp == comp[i]).all():
            break
        for j in index.linked(i, percent).tolist():
            if comp[j] != comp[i]:
                out.append((i, j))
                comp[comp == comp[j]] = comp[i]
    return out


def _within(k: int, percent: int):
    """The joining links among a group's texts."""

    def run(group: pa.Table) -> pa.Table:
        doc = B.longs(group.column("doc_id").combine_chunks())
        index = _Index(group.column("text").combine_chunks(), k)
        comp = np.arange(len(doc))
        links = _joined(index, comp, [0], percent)
        # All pairs but those inside the first text's component are still open.
        links += _joined(index, comp, np.flatnonzero(comp != comp[0]).tolist(), percent)
        return _pairs(doc, links)

    return run


def _star(k: int, percent: int):
    """The links between leaders (side 1) and their members in a group of stars, by full sets."""

    def run(group: pa.Table) -> pa.Table:
        star, doc, side = (B.longs(group.column(c).combine_chunks()) for c in ("leader", "doc_id", "side"))
        h, bounds = _sets(group.column("text").combine_chunks(), k)
        sets = [h[bounds[i] : bounds[i + 1]] for i in range(len(doc))]
        leaders = {star[i]: sets[i] for i in np.flatnonzero(side == 1).tolist()}
        links = []
        for i in np.flatnonzero(side == 2).tolist():
            other = leaders[star[i]]
            common = len(np.intersect1d(sets[i], other, assume_unique=True))
            if 100 * common >= percent * (len(sets[i]) + len(other) - common):
                links.append((star[i], doc[i]))
        at = np.array(links, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(at[:, 0]), "b": pa.array(at[:, 1])})

    return run


def _beside(k: int, percent: int):
    """The joining links between strays (side 1) and a block of their band (side 2)."""

    def run(group: pa.Table) -> pa.Table:
        doc, comp, side = (B.longs(group.column(c).combine_chunks()) for c in ("doc_id", "comp", "side"))
        index = _Index(group.column("text").combine_chunks(), k)
        return _pairs(doc, _joined(index, comp.copy(), np.flatnonzero(side == 1).tolist(), percent))

    return run


def _pairs(doc: np.ndarray, links: list[tuple[int, int]]) -> pa.Table:
    at = np.array(links, np.int64).reshape(-1, 2)
    return pa.table({"a": pa.array(doc[at[:, 0]]), "b": pa.array(doc[at[:, 1]])})


def _open_bands(shared: DataFrame, near: DataFrame, large: DataFrame, links: DataFrame, bins: int, k: int, percent: int) -> DataFrame:
    """``links`` and those inside the families of the classes in ``large`` (doc_id, text), by the bands they share."""
    # Each class with the leaders of its bands.
    spokes = near.join(large.select("doc_id").hint("merge"), "doc_id")
    width = spokes.groupBy("leader").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    spokes = spokes.join(width.hint("merge"), "leader")
    group = F.when(F.col("blocks") > 1, F.xxhash64("leader", "block")).otherwise(F.pmod(F.xxhash64("leader"), F.lit(bins)))
    rim = spokes.select("leader", "doc_id", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).alias("block"), "blocks", F.lit(2).alias("side"))
    hub = width.select("leader", F.col("leader").alias("doc_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "blocks", F.lit(1).alias("side"))
    stars = rim.unionByName(hub).withColumn("g", group).join(large.hint("merge"), "doc_id").select("g", "leader", "doc_id", "side", "text")
    spoken = materialize(stars.groupBy("g").applyInArrow(_star(k, percent), "a long, b long"), "links")
    links = links.union(spoken)
    labels = components(links)

    # Bands of large families that are not in one component yet: what is outside the band's largest one, with all of it.
    open_ = shared.join(large.select("doc_id").hint("merge"), "doc_id").join(labels.withColumnRenamed("node", "doc_id").hint("merge"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("comp"))
    per = open_.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "comp")).alias("x"), F.sum("c").alias("all"))
    per = per.select("key", F.col("x.comp").alias("main"), F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks"), F.ceil((F.col("all") - F.col("x.c")) / BLOCK).cast("int").alias("stray_blocks")).where("stray_blocks > 0")
    rest = materialize(open_.join(per.hint("merge"), "key"), "open")
    strays = rest.where("comp <> main").withColumns({"i": F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("stray_blocks")).cast("int"), "j": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "side": F.lit(1)})
    others = rest.withColumns({"i": F.explode(F.sequence(F.lit(0), F.col("stray_blocks") - 1)), "j": F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"), "side": F.lit(2)})
    group = F.when((F.col("blocks") == 1) & (F.col("stray_blocks") == 1), F.xxhash64("key")).otherwise(F.xxhash64("key", "i", "j"))
    columns = [group.alias("g"), "doc_id", "comp", "side"]
    beside = strays.select(*columns).union(others.select(*columns)).join(large.hint("merge"), "doc_id").groupBy("g").applyInArrow(_beside(k, percent), "a long, b long")
    return links.union(materialize(beside, "links"))


def groups(docs: DataFrame, k: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """doc_id, h (hash of the text), n_shingles, component_id (the smallest doc_id of the group), a row per row of ``docs``."""
    sketched = materialize(sketch(docs, k, text), "sketch")
    sound = sketched.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    classes = sound.groupBy("n", "d1", "d2").agg(F.min(F.struct("doc_id", "h", "bands")).alias("x"))
    classes = materialize(classes.select("n", "d1", "d2", "x.doc_id", "x.h", "x.bands"), "classes")

    # Families: classes joined to the smallest class of each band they share.
    banded = classes.select("doc_id", F.explode("bands").alias("key"))
    leaders = banded.groupBy("key").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("last")).where("leader <> last").select("key", "leader")
    shared = materialize(banded.join(leaders, "key").select("key", "doc_id", "leader"), "bands")
    near = shared.where("doc_id <> leader").select("doc_id", "leader").distinct()
    families = components(near, "doc_id", "leader").withColumnsRenamed({"node": "doc_id", "component": "family"})
    sizes = families.groupBy("family").agg(F.count("*").alias("members"))
    placed = materialize(families.join(sizes, "family").join(classes.select("doc_id", "h"), "doc_id"), "families")

    # Texts of the small ones, once: many families to a group. Joins merge at every size, so that
    # the plan, and with it the growth, is the same when few families would fit a broadcast.
    bins = max(1, -(-placed.count() // BIN))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(named(text)).alias("h"), named(text).alias("text")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    members = materialize(placed.join(texts.hint("merge"), ["doc_id", "h"]).select("doc_id", "h", "family", "members", "text").dropDuplicates(["doc_id", "h"]).drop("h"), "members")
    small = members.where(F.col("members") <= BLOCK).select(F.pmod(F.xxhash64("family"), F.lit(bins)).alias("g"), "doc_id", "text")
    links = materialize(small.groupBy("g").applyInArrow(_within(k, percent), "a long, b long"), "links")

    large = members.where(F.col("members") > BLOCK).select("doc_id", "text")
    if large.limit(1).count():
        links = _open_bands(shared, near, large, links, bins, k, percent)
    labels = components(links)

    final = labels.select(F.col("node").alias("rep"), F.col("component").alias("root"))
    labelled = classes.select("n", "d1", "d2", F.col("doc_id").alias("rep")).join(final, "rep", "left").select("n", "d1", "d2", F.coalesce("root", "rep").alias("root"))
    result = sketched.join(labelled, ["n", "d1", "d2"], "left")
    # Without a shingle, a document is alone.
    return result.select("doc_id", "h", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("root", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """``docs`` without all but one document of each group: the one of the smallest doc_id.

    Of repeated rows of one doc_id, one stays. Rows of null doc_id all stay.
    """
    found = groups(docs.select("doc_id", named(text).alias("text")), k, percent)
    keep = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    place = fresh(docs.columns, "_place")[0]
    with_id = docs.where(F.col("doc_id").isNotNull())
    once = with_id.join(keep, "doc_id", "left_semi").withColumn(place, F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64(named(text))))).where(named(place) == 1)
    return once.select(*[named(c) for c in docs.columns]).unionByName(docs.where(F.col("doc_id").isNull()))
