"""Homomorphic multiset fingerprints of documents, from built-in expressions only.

A document is the multiset of its paragraphs (lines). Each paragraph hashes to
a wide vector, and the fingerprint is the sum of those vectors, each lane
modulo 2**32, so the order of paragraphs does not matter and a paragraph is
inserted or deleted by adding or subtracting its own vector (``combine``).

Two kinds of lanes make up the vector:

* ``ids``: ``ID_LANES`` lanes, halves of 64-bit hashes of the whole paragraph
  under different seeds; they decide equality;
* ``lanes``: ``SIM_LANES`` lanes. Each two-word shingle of the paragraph hashes
  to one lane, which it raises by one. The difference of two fingerprints
  there estimates how many shingles differ, so fingerprints alone tell how
  alike two texts are.

A vector is one expression over its own row: texts are never exploded into
words, and no aggregate carries lanes through a shuffle.

Defined cases: a null text counts as empty; the empty text is one empty
paragraph, whose only word is empty. Repeated rows keep a row each. Rows of null
doc_id come last in order, with those of the largest long. Documents of equal
doc_id have the same next document: the one of the next larger doc_id or, if
several rows have that, the one whose text has the smallest hash. A table of
one doc_id is its own next document. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import materialize

ID_LANES = 8  # two to a 64-bit hash
SIM_LANES = 64
_LANE = 0xFFFFFFFF
#: Code point of the character that stands for the first lane.
_FIRST = 64
#: Stands for a null doc_id, which comes last in order.
LAST_ID = (1 << 63) - 1
#: Rows of one doc_id above this number are dealt to several keys.
HOT = 4096
#: At most so many ids are dealt so; their table is broadcast (24 bytes an id).
HOT_IDS = 100_000


def _bound(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _ids(lines: Column) -> Column:
    def lane(hashes: Column, k: int) -> Column:
        def half(h: Column) -> Column:
            return F.shiftrightunsigned(F.get(h, F.lit(k // 2)), 32 * (k % 2)).bitwiseAND(F.lit(_LANE))

        return F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, h: (acc + half(h)).bitwiseAND(F.lit(_LANE)))

    every = F.transform(lines, lambda p: F.array(*[F.xxhash64(F.lit(k), p) for k in range(ID_LANES // 2)]))
    return _bound(every, lambda hashes: F.array(*[lane(hashes, k) for k in range(ID_LANES)]))


def _lanes(lines: Column) -> Column:
    # One character a shingle names its lane; a lane's count is how often the character occurs.
    def codes(words: Column) -> Column:
        return F.zip_with(words, F.concat(F.array(F.lit("")), words), lambda x, y: F.when(x.isNotNull(), F.char(F.xxhash64(x, y).bitwiseAND(F.lit(SIM_LANES - 1)).bitwiseOR(F.lit(_FIRST)))))

    spelled = F.array_join(F.flatten(F.transform(lines, lambda p: codes(F.split(p, " ", -1)))), "")
    names = [c if c.isalnum() else "\\" + c for c in map(chr, range(_FIRST, _FIRST + SIM_LANES))]
    every = F.array(*[F.lit(n) for n in names])
    return _bound(spelled, lambda s: F.transform(every, lambda n: (F.size(F.split(s, n, -1)) - 1).cast("long")))


def vector(text: Column) -> Column:
    """The fingerprint vector of a text: struct of arrays ``ids`` and ``lanes``."""
    return _bound(F.split(text, "\n", -1), lambda lines: F.struct(_ids(lines).alias("ids"), _lanes(lines).alias("lanes")))


def combine(left: Column, right: Column, sign: int = 1) -> Column:
    """The vector after inserting (sign 1) or deleting (sign -1) the paragraphs of ``right``."""

    def added(name: str) -> Column:
        return F.zip_with(left[name], right[name], lambda x, y: (x + F.lit(sign) * y).bitwiseAND(F.lit(_LANE))).alias(name)

    return F.struct(added("ids"), added("lanes"))


def as_text(v: Column) -> Column:
    """The vector as a string: identity lanes at eight hexadecimal digits, a colon, the other lanes with points between."""
    ids = F.array_join(F.transform(v["ids"], lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")
    return F.concat(ids, F.lit(":"), F.array_join(F.transform(v["lanes"], lambda x: F.lower(F.hex(x))), "."))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles (Dice) of two vectors, 0 to 1.

    The lanes of a text of n shingles, less their mean n / SIM_LANES, have the
    number of shingles (squared multiplicities) as expected sum of squares, and
    the product of two texts' has the number of common ones. Equal identity lanes
    mean 1 exactly. The standard error at 0 is sqrt(2 / SIM_LANES) at most.
    """

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: acc + x).cast("double")

    def product(x: Column, y: Column) -> Column:
        return total(F.zip_with(x["lanes"], y["lanes"], lambda p, q: p * q))

    mean = F.lit(1.0 / SIM_LANES)
    na, nb = total(a["lanes"]), total(b["lanes"])
    both = product(a, a) + product(b, b) - (na * na + nb * nb) * mean
    raw = F.when(both > 0, 2.0 * (product(a, b) - na * nb * mean) / both).otherwise(0.0)
    return F.when(a["ids"] == b["ids"], 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))


def neighbours(ids: DataFrame) -> DataFrame:
    """``ids`` (one row per ``_id``, with ``_most``) with the id before, ``_prev``, and its ``_most`` as ``_need``.

    The first row's is the last. Ids are dealt by range, so that a partition
    looks at its own; only its first and last row reach the driver, two numbers
    for each partition.
    """
    spark = ids.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(ids.repartitionByRange(parts, "_id").withColumn("_part", F.spark_partition_id()), "ids")
    ends = dealt.groupBy("_part").agg(F.min("_id").alias("first"), F.max(F.struct("_id", "_most")).alias("last")).orderBy("first").collect()
    order = Window.partitionBy("_part").orderBy("_id")
    seen = dealt.withColumns({"_prev": F.lag("_id").over(order), "_need": F.lag("_most").over(order)})
    if not ends:
        return seen.drop("_part")
    before = [ends[i - 1].last for i in range(len(ends))]

    def outside(values: list) -> Column:
        table = F.map_from_arrays(F.lit([e["_part"] for e in ends]), F.lit(values))
        return F.element_at(table, F.col("_part"))

    return seen.select(*ids.columns, F.coalesce("_prev", outside([b["_id"] for b in before])).alias("_prev"), F.coalesce("_need", outside([b["_most"] for b in before])).alias("_need"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """The fingerprint of every text, of its edited text, and how alike they are.

    The edited text's last floor(n / 2) code points are replaced by the first
    as many of the next document's text. Texts are shuffled once by doc_id, with
    their vectors, and half of them once more, to the document before; the
    order of ids is found from ids alone. Rows of a doc_id that more than
    ``HOT`` rows have are dealt to several keys.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, next_doc_id.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = rows.groupBy("_id").agg(F.max(F.length("text")).cast("long").alias("_most"), F.min(F.xxhash64("text")).alias("_least"), F.count("*").alias("_rows"))
    ids = materialize(ids, "lengths")
    total = ids.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    hot = F.broadcast(ids.where(F.col("_rows") > max(HOT, total // HOT_IDS)).select("_id", F.ceil(F.col("_rows") / HOT).alias("_salts")))

    salt = F.pmod(F.xxhash64("text"), F.coalesce("_salts", F.lit(1).cast("long")))
    dealt = rows.join(hot, "_id", "left").select("_id", F.when(F.col("_salts").isNull(), F.lit(0).cast("long")).otherwise(salt).alias("_salt"), "text", vector(F.col("text")).alias("own"))

    def everywhere(df: DataFrame) -> DataFrame:
        """A row for each key of its ``_id``."""
        return df.join(hot, "_id", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_salts", F.lit(1).cast("long")) - 1))).drop("_salts")

    pairs = everywhere(neighbours(ids).select("_id", "_least", "_prev", F.floor(F.col("_need") / 2).cast("int").alias("_need")))
    # Merge joins at every size: both sides of the last one read the one shuffle of the texts.
    # (No hash is below the least; an equality here would become a join key and cost a shuffle of its own.)
    ahead = dealt.join(pairs.hint("merge"), ["_id", "_salt"]).where(F.xxhash64("text") <= F.col("_least"))
    ahead = ahead.withColumn("_copy", F.row_number().over(Window.partitionBy("_id", "_salt").orderBy("_least"))).where("_copy = 1")
    ahead = everywhere(ahead.select(F.col("_prev").alias("_id"), F.col("_id").alias("_next"), F.expr("substring(text, 1, _need)").alias("_head"), F.col("own").alias("theirs")))

    joined = dealt.join(ahead.hint("merge"), ["_id", "_salt"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = joined.withColumn("_half", half).select("_id", "_next", F.length("text").cast("long").alias("n_chars"), "own", "theirs", F.expr("concat(substring(text, 1, length(text) - _half), substring(_head, 1, _half))").alias("_edited"))
    edited = edited.select("*", F.sha2(F.encode("_edited", "UTF-8"), 256).alias("edited_sha256"), vector(F.col("_edited")).alias("new"))
    own, new, theirs = F.col("own"), F.col("new"), F.col("theirs")
    return edited.select(
        F.when(F.col("_id") != LAST_ID, F.col("_id")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        as_text(own).alias("fingerprint"),
        as_text(new).alias("edited_fingerprint"),
        likeness(own, new).alias("near_edited"),
        likeness(own, theirs).alias("near_next"),
        F.when(F.col("_next") != LAST_ID, F.col("_next")).alias("next_doc_id"),
    )
