"""Malformed files are rows with an ``_error`` in every table, never a failed job."""

import random

import pytest

from quire.operators import canvas, graph, interpret
from quire.operators import pdf_document as D
from quire.plans.cases import _canvas, _objects, _simple
from quire.sources.pdf import SCHEMAS, PdfDataSource, read_table
from quire.sources.pdf_fixture import Writer, document
from quire.sources.pdf_syntax import Name, PdfError, Ref


def font_file(**entries) -> bytes:
    return document([b"BT /F1 9 Tf (a) Tj ET"], extend=lambda w: {"Font": {"F1": w.add({"Subtype": Name("TrueType"), "FirstChar": 65, "LastChar": 66, "Widths": [1, 2]} | entries)}})


def deep_tree(levels: int) -> bytes:
    w = Writer()
    for n in range(1, levels):
        w.add({"Type": Name("Pages"), "Kids": [Ref(n + 1)]}, n)
    w.add({"Type": Name("Page")}, levels)
    return w.finish(w.add({"Type": Name("Catalog"), "Pages": Ref(1)}, levels + 1))


def shared_kids(levels: int, width: int) -> bytes:
    w = Writer()
    for n in range(1, levels):
        w.add({"Type": Name("Pages"), "Kids": [Ref(n + 1)] * width}, n)
    w.add({"Type": Name("Page")}, levels)
    return w.finish(w.add({"Type": Name("Catalog"), "Pages": Ref(1)}, levels + 1))


def cid_file(**child) -> bytes:
    def extend(w: Writer) -> dict:
        below = w.add({"Subtype": Name("CIDFontType2")} | child)
        return {"Font": {"F1": w.add({"Subtype": Name("Type0"), "Encoding": Name("Identity-H"), "DescendantFonts": [below]})}}

    return document([b"BT /F1 9 Tf <0001> Tj ET"], extend=extend)


BAD = [font_file(FirstChar=b"a"), font_file(Widths=[1, Ref(2)]), cid_file(DW=Name("x")), cid_file(W=[1, [b"a"]]), cid_file(W=3)]
HUGE = b"%PDF-1.7\n99999999999 0 obj\n1\nendobj\n%%EOF"


def mutations(count: int) -> list[bytes]:
    """Files with bytes changed, left out and doubled; the same ones in every run."""
    rng, whole = random.Random(7), document([b"q 1 0 0 1 5 5 cm /F1 9 Tf BT (a) Tj ET Q", b"0 0 5 5 re f"], extend=lambda w: {"Font": {"F1": w.add(_simple(w, 3))}}, compress=False)
    out = []
    for _ in range(count):
        data = bytearray(whole)
        for _ in range(rng.randint(1, 6)):
            at, kind = rng.randrange(len(data)), rng.randrange(3)
            if kind == 0:
                data[at] = rng.randrange(256)
            elif kind == 1:
                del data[at : at + rng.randint(1, 40)]
            else:
                data[at:at] = data[at : at + rng.randint(1, 40)]
        out.append(bytes(data))
    return out


def test_every_table_survives_malformed_files(spark):
    contents = [*BAD, HUGE, deep_tree(3000), shared_kids(6, 10), b"", *mutations(60)]
    files = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(contents)], "doc_id long, content binary").repartition(4)
    for name in SCHEMAS:
        read_table(files, name).collect()
    for found in (interpret.draw_commands(files), interpret.glyph_widths(files), interpret.character_maps(files), interpret.glyph_outlines(files)):
        found.collect()
    fonts = interpret.font_table(files).where(f"doc_id < {len(BAD)}").collect()
    assert {r.doc_id for r in fonts if r._error is not None} == set(range(len(BAD)))


def test_a_row_that_no_column_holds_is_a_fault():
    import pyarrow as pa

    from quire.sources.pdf import _table

    error = pa.struct([("stage", pa.string()), ("kind", pa.string()), ("message", pa.string()), ("offset", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("_error", error)])
    rows = _table([(2, {"doc_id": 1, "n": 5}), (1, {"doc_id": 2, "n": 1 << 40}), (1, {"doc_id": 3, "n": 6})], schema, False).to_pylist()
    assert [(r["doc_id"], r["n"], r["_error"] and r["_error"]["stage"]) for r in rows] == [(1, 5, None), (1, 5, None), (2, None, "internal"), (3, 6, None)]


def test_page_trees_of_any_depth_and_shape():
    assert len(list(D.load(deep_tree(3000)).pages())) == 1
    with pytest.raises(PdfError, match="Cycle"):
        list(D.load(shared_kids(6, 10)).pages())


def test_fail_fast_raises(spark):
    files = spark.createDataFrame([(1, bytearray(BAD[0])), (2, bytearray(b"no file"))], "doc_id long, content binary")
    with pytest.raises(Exception, match="UnexpectedToken|PdfError"):
        read_table(files, "objects", mode="FAILFAST").collect()


def test_files_share_partitions(spark, tmp_path):
    for i in range(7):
        (tmp_path / f"{i}.pdf").write_bytes(document([b"q Q"]))
    spark.dataSource.register(PdfDataSource)
    size = len(document([b"q Q"]))
    found = spark.read.format("pdf").option("table", "content_ops").option("bytes", 3 * size).load(str(tmp_path))
    assert found.rdd.getNumPartitions() == 3 and found.count() == 14


def test_columns_are_all_that_is_built(spark):
    files = spark.createDataFrame([(1, bytearray(document([b"BT /F1 9 Tf (abc) Tj ET 0 0 m 1 1 l S"], extend=lambda w: {"Font": {"F1": w.add(_simple(w, 3))}})))], "doc_id long, content binary")
    bare = interpret.draw_commands(files, columns=["kind"])
    assert bare.columns == ["doc_id", "kind", "_error"]
    assert [r.kind for r in bare.collect()] == [r.kind for r in interpret.draw_commands(files).collect()] == ["glyph"] * 3 + ["stroke"]
    assert [r.op for r in read_table(files, "content_ops", columns=["op"]).collect()] == ["BT", "Tf", "Tj", "ET", "m", "l", "S"]


def test_replay_gives_what_was_recorded():
    c = _canvas(b"q 0 0 5 1 re W n 0 0 1 1 re B /I Do /SM gs /SN gs Q", _objects(5))
    copy = canvas.Recording()
    canvas.replay(c.commands, copy)
    assert copy.commands == c.commands and {x.kind for x in copy.commands} >= {"set_clip", "fill", "stroke", "draw_image", "begin_mask", "end_mask", "reset_clip"}


def test_overlaps_with_any_run_before(spark):
    runs = spark.createDataFrame([("F", 0, 100), ("F", 1, 2), ("F", 50, 60), ("F", 101, 102), ("G", 5, 6)], "font_id string, cid_start int, cid_end int")
    assert sorted(r.cid_start for r in graph.overlapping(runs).collect()) == [1, 50]


def test_resolve_names_its_fault(spark):
    objects = [(0, 1, 2), (0, 2, None), (0, 800, 801), (0, 801, 800)]
    found = graph.resolve(spark.createDataFrame([(0, 1), (0, 900), (0, 800)], "doc_id long, ref int"), spark.createDataFrame(objects, "doc_id long, obj_num int, next_ref int")).collect()
    assert {(r.ref, r.obj_num, r.fault) for r in found} == {(1, 2, None), (900, None, "FailedResolveObjectReference"), (800, None, "MaxHops")}
