"""Object-graph lookups as joins over the node table, level by level."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.session import materialize, scratch_path

MAX_HOPS = 16


def _levels(first: DataFrame, follow: Callable[[DataFrame], DataFrame], label: str) -> DataFrame:
    """``first``, what ``follow`` makes of it, what it makes of that, and so on until a level is empty.

    Each level is written to shared storage before the next one reads it, so
    neither the rows nor the levels are bounded, as they are in recursive SQL.
    """
    spark, folder = first.sparkSession, scratch_path(first.sparkSession, label)
    read, paths, level = spark.read.schema(first.schema), [], first
    while True:
        paths.append(f"{folder}/level-{len(paths)}")
        level.write.parquet(paths[-1])
        level = read.parquet(paths[-1])
        if level.isEmpty():
            return read.parquet(*paths)
        level = follow(level).select(*first.columns)


def resolve(starts: DataFrame, objects: DataFrame) -> DataFrame:
    """Follows references: (doc_id, ref) to (doc_id, ref, obj_num, hops, fault).

    ``objects`` has doc_id, obj_num and next_ref: the object's own reference if
    it is nothing but one, else null. The result is the first object that is no
    reference. Where an object is missing, it is null and the fault is
    ``FailedResolveObjectReference``; where ``MAX_HOPS`` are used up, it is null
    and the fault is ``MaxHops``: the reference stands for itself.
    """
    objects = materialize(objects.select("doc_id", F.col("obj_num").cast("long").alias("at"), F.col("next_ref").cast("long").alias("next")), "objects")
    links = objects.where("next IS NOT NULL")
    starts = starts.select("doc_id", "ref").distinct()

    def follow(level: DataFrame) -> DataFrame:
        return level.where(F.col("hops") < MAX_HOPS).join(links, ["doc_id", "at"]).select("doc_id", "ref", F.col("next").alias("at"), (F.col("hops") + 1).alias("hops"))

    chased = _levels(starts.select("doc_id", "ref", F.col("ref").cast("long").alias("at"), F.lit(0).alias("hops")), follow, "chase")
    last = chased.join(objects.where("next IS NULL").select("doc_id", "at"), ["doc_id", "at"])
    ended = chased.groupBy("doc_id", "ref").agg(F.max("hops").alias("_used"))
    found = ended.join(last.select("doc_id", "ref", F.col("at").alias("obj_num"), "hops"), ["doc_id", "ref"], "left")
    fault = F.when(F.col("obj_num").isNull(), F.when(F.col("_used") == MAX_HOPS, "MaxHops").otherwise("FailedResolveObjectReference"))
    return found.select("doc_id", "ref", "obj_num", "hops", fault.alias("fault"))


def page_tree(roots: DataFrame, kids: DataFrame, kinds: DataFrame) -> DataFrame:
    """Pages in depth-first order: (doc_id, page_index, obj_num).

    ``roots`` (doc_id, obj_num), ``kids`` (doc_id, obj_num, idx, kid), ``kinds``
    (doc_id, obj_num, kind). A kid that is above itself is not followed.
    """
    number = F.col("obj_num").cast("long")
    kids = materialize(kids.select("doc_id", number.alias("obj_num"), F.col("idx").cast("int").alias("idx"), F.col("kid").cast("long").alias("kid")), "kids")

    def follow(level: DataFrame) -> DataFrame:
        below = level.join(kids, ["doc_id", "obj_num"]).where(~F.array_contains("above", F.col("kid")))
        return below.select("doc_id", F.col("kid").alias("obj_num"), F.concat("place", F.array("idx")).alias("place"), F.concat("above", F.array("kid")).alias("above"))

    first = roots.select("doc_id", number.alias("obj_num"), F.array().cast("array<int>").alias("place"), F.array(number).alias("above"))
    walked = _levels(first, follow, "walk").select("doc_id", "obj_num", "place")
    pages = walked.join(kinds.where("kind = 'Page'").select("doc_id", number.alias("obj_num")), ["doc_id", "obj_num"])
    order = Window.partitionBy("doc_id").orderBy("place")
    return pages.select("doc_id", (F.row_number().over(order) - 1).alias("page_index"), "obj_num")


def duplicates(objects: DataFrame) -> DataFrame:
    """(doc_id, obj_num, n) of object numbers that a document has more than once."""
    return objects.where("obj_num IS NOT NULL").groupBy("doc_id", "obj_num").agg(F.count("*").alias("n")).where("n > 1")


def entries(nodes: DataFrame, key: str) -> DataFrame:
    """The top-level entry ``key`` of every object that is a dictionary."""
    return nodes.where((F.col("parent_id") == 0) & (F.col("key") == key)).select("doc_id", "obj_num", "node_id", "tag", "i", "r", "s", "b", "ref")


def kids(nodes: DataFrame) -> DataFrame:
    """(doc_id, obj_num, idx, kid) of every /Kids array's references."""
    own = nodes.where((F.col("parent_id") == 0) & (F.col("key") == "Kids") & (F.col("tag") == "array")).select("doc_id", "obj_num", F.col("node_id").alias("parent_id"))
    return own.join(nodes.where("tag = 'ref'").select("doc_id", "obj_num", "parent_id", "idx", F.col("ref").alias("kid")), ["doc_id", "obj_num", "parent_id"]).select("doc_id", "obj_num", "idx", "kid")


def width_at(codes: DataFrame, runs: DataFrame, bucket: int = 256) -> DataFrame:
    """(font_id, cid) joined with the run of widths it lies in: a range join with an equi key.

    ``runs`` has font_id, cid_start, cid_end, widths; a run is listed under
    every block of ``bucket`` codes that it touches.
    """
    spread = runs.withColumn("_b", F.explode(F.sequence(F.floor(F.col("cid_start") / bucket), F.floor(F.col("cid_end") / bucket))))
    keyed = codes.withColumn("_b", F.floor(F.col("cid") / bucket))
    joined = keyed.join(spread, ["font_id", "_b"], "left").where("cid_start IS NULL OR (cid >= cid_start AND cid <= cid_end)")
    hit = joined.where("cid_start IS NOT NULL").select(*codes.columns, F.get("widths", (F.col("cid") - F.col("cid_start")).cast("int")).alias("width"))
    return codes.join(hit.select("font_id", "cid", "width").distinct(), ["font_id", "cid"], "left")


def overlapping(runs: DataFrame) -> DataFrame:
    """Runs that begin before one that starts no later has ended."""
    before = Window.partitionBy("font_id").orderBy("cid_start", "cid_end").rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("_e", F.max("cid_end").over(before)).where(F.col("_e") >= F.col("cid_start")).drop("_e")


def point_get(wanted: DataFrame, objects: DataFrame) -> DataFrame:
    """``wanted`` (doc_id, obj_num and more) with the object of that number; those that a document lacks are left out."""
    return wanted.join(objects, ["doc_id", "obj_num"])


def origins(glyphs: DataFrame, run: str, order: list[str], width: str, size: float, spacing: float = 0.0) -> DataFrame:
    """``glyphs`` with x: the advances (width / 1000 * size + spacing) of those before it in its run, added up."""
    before = Window.partitionBy(run).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return glyphs.withColumn("x", F.coalesce(F.sum(F.col(width) / 1000 * size + spacing).over(before), F.lit(0.0)))
