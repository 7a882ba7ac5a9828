"""What the document queries do at size: nothing is built that nobody asks for, and no row leaves its task to be numbered."""

import re
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from quire.operators import interpret
from quire.sources import content, pdf, pdf_syntax
from quire.sources.pdf_fixture import Writer, document
from quire.sources.pdf_syntax import Name
from tests.test_faults import mutations

OPTIONS = {"strict": False, "compat": False, "columns": None}


def rows(reader, data, **options):
    return [row for n, row in pdf.rows_of(1, data, reader, OPTIONS | options, False) for _ in range(n)]


def wide_font(w: Writer) -> dict:
    return {"Font": {"F1": w.add({"Type": Name("Font"), "Subtype": Name("TrueType"), "FirstChar": 0, "LastChar": 255, "Widths": [500] * 256})}}


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """Documents of which two share an id."""
    folder = tmp_path_factory.mktemp("repeated")
    texts = [(1, "\n".join(f"line {i}" for i in range(120))), (1, "a (b)\nc"), (2, "one"), (3, "")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(folder / "documents.parquet"))
    return str(folder)


def agrees(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    found = entry.queries()[name](spark, folder)
    want = con.sql(entry.oracle_sql()[name]).select(*found.columns).fetchall()
    assert Counter(map(tuple, found.collect())) == Counter(want)
    return found._jdf.queryExecution().optimizedPlan().toString()


# v03_paint_paths


def test_paths_are_numbered_where_they_are_drawn(spark, repeated):
    assert "Window" not in agrees(spark, repeated, "v03_paint_paths")


def test_commands_of_some_kinds():
    for data in mutations(40):
        every = rows(interpret._commands, data)
        some = rows(interpret._commands, data, columns=["page_index", "cmd_ord", "kind", "path"], kinds=("fill",))
        shown = [(r["page_index"], r["cmd_ord"], str(r["path"])) for r in every if r.get("kind") == "fill"]
        assert [(r["page_index"], r["cmd_ord"], str(r["path"])) for r in some if "kind" in r] == shown
        assert [r["_error"] for r in some if "_error" in r] == [r["_error"] for r in every if "_error" in r]


def test_glyphs_that_nobody_asks_for_are_not_built(monkeypatch):
    from quire.operators import canvas

    built = []
    monkeypatch.setattr(canvas, "Command", lambda *a, made=canvas.Command, **b: built.append(a) or made(*a, **b))
    data = document([b"0 0 m 1 1 l S BT /F1 9 Tf (" + b"x" * 500 + b") Tj ET"], extend=wide_font)
    found = rows(interpret._commands, data, columns=["kind", "path"], kinds=("stroke",))
    assert len(found) == 1 and len(built) == 2


def test_short_cuts_read_what_the_productions_read(monkeypatch):
    tails = [b" -0 0 m", b" 5. 1 l", b" 1 0 R", b" 1 0 obj", b" (a\\) b) Tj", b" 1 2 3 4 re q", b" .5 -.5 m", b" 00.5 +3 m", b" 0. 1 m", b"\0 q", b"(x)Tj1 q", b" /F.1 3 Tf 1 0 0 1 -0.0 4 Tm", b" 1 2 3 m"]
    streams = [b"q 1 0 0 1 5 5 cm BT (a) Tj ET" + t for t in tails]
    whole = [document([b"q Q", s], extend=wide_font) for s in streams] + mutations(80)
    tables = [pdf._objects, pdf._nodes, pdf._xrefs, pdf._content, pdf._resources, interpret._commands]

    def read():
        return [repr(content.parse(s)) for s in streams] + [repr(rows(t, d, strict=strict)) for t in tables for d in whole for strict in (False, True)]

    fast, never = read(), re.compile(rb"(?!)")
    for module, names in ((pdf_syntax, ("_INTEGER", "_INTEGERS", "_REF", "_OBJECT", "_KEYED", "_ENTRY")), (content, ("_COMMON",))):
        for name in names:
            monkeypatch.setattr(module, name, never)
    assert fast == read()


# o49_show_text


def test_shown_lines_are_numbered_where_they_are_read(spark, repeated):
    assert "Window" not in agrees(spark, repeated, "o49_show_text")


def test_operators_of_some_names():
    for data in [document([b"q (a) Tj zz Q", b"(b) Tj"]), *mutations(40)]:
        every, some = rows(pdf._content, data), rows(pdf._content, data, ops=("Tj",))
        assert some == [r for r in every if r.get("op") == "Tj" or "_error" in r]
        assert [r["nth"] for r in some if r.get("op") == "Tj"] == list(range(sum(r.get("op") == "Tj" for r in every)))


# s01_file_read


def test_files_are_read_by_their_names(spark, repeated, tmp_path):
    assert "binaryFile" not in agrees(spark, repeated, "s01_file_read")
    files = spark.createDataFrame([(1, bytearray(b"abc")), (1, bytearray(b"")), (2, None)], "doc_id long, content binary")
    read = pdf.read_written(pdf.write_files(files, str(tmp_path / "files"))).collect()
    assert sorted((r.doc_id.doc_id, bytes(r.content)) for r in read) == [(1, b""), (1, b"abc"), (2, b"")] and len({r.doc_id.path for r in read}) == 3


# d31_traced_places


def test_traced_places_are_numbered_where_they_are_read(spark, repeated):
    assert "Window" not in agrees(spark, repeated, "d31_traced_places")
    data = document([b"q 1 0 0 1 2 3 Tm Q zz", b"1 0 0 1 4 5 Tm"])
    every, some = rows(pdf._trace, data), rows(pdf._trace, data, ops=("Tm",))
    assert some == [r for r in every if r["op_name"] in ("SetTextMatrix", None)] and [r["nth"] for r in some] == [0, 0, 1]


# e01_operator_histogram


def test_operator_counts():
    for data in [document([b"q Q zz q", b"1 l"]), b"no file", None, *mutations(60)]:
        counts = Counter()
        for r in rows(pdf._op_counts, data):
            counts[r.get("op"), "_error" in r] += r.get("n", 1)
        assert counts == Counter((r.get("op"), "_error" in r) for r in rows(pdf._content, data))


# s04_get_page


def test_numbers_are_not_read_one_by_one(monkeypatch):
    seen = []
    monkeypatch.setattr(pdf_syntax.Scanner, "unsigned", lambda self, *a, read=pdf_syntax.Scanner.unsigned: seen.append(self.at) or read(self, *a))
    assert [r["page_index"] for r in rows(pdf._pages, document([b"q Q", b"q Q"], extend=wide_font))] == [0, 1] and len(seen) < 10


# s04_page_count


def test_texts_are_dealt_to_all_cores(spark, repeated):
    from quire.plans.documents import files

    assert files(spark, repeated).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


# F8: t04_simple_widths


def test_files_are_handed_on_by_bytes():
    import os

    import pyarrow as pa

    from quire.plans import documents

    texts = [os.urandom(documents.BYTES).hex() for _ in range(3)] + ["a"] * 4
    parts = list(documents._built(iter([pa.record_batch([pa.array(range(7)), pa.array(texts)], names=["doc_id", "text"])])))
    assert [p.column(0).to_pylist() for p in parts] == [[0], [1], [2], [3, 4, 5, 6]]


# p19_trailer


def test_dictionaries_are_read_by_the_pair(monkeypatch):
    seen = []
    monkeypatch.setattr(pdf_syntax.Scanner, "value", lambda self, read=pdf_syntax.Scanner.value: seen.append(self.at) or read(self))
    (row,) = rows(pdf._trailers, document([b"q Q"]))
    assert '"Size": {"int": 5}' in row["value"] and len(seen) < 20


# s03_document_load


def no_json(monkeypatch):
    monkeypatch.setattr(pdf, "_json", lambda value: pytest.fail("a value is built that nobody asks for"))


def test_kinds_of_objects_without_their_values(monkeypatch):
    no_json(monkeypatch)
    assert [r["kind"] for r in rows(pdf._objects, document([b"q Q"]), columns=["kind"])] == ["indirect", "stream", "indirect", "indirect", "xref", "trailer"]


# p16_stream_inflate


def test_streams_without_their_dictionaries(monkeypatch):
    no_json(monkeypatch)
    assert [r["stream_data"] for r in rows(pdf._objects, document([b"q Q"]), columns=["kind", "stream_data"]) if r["kind"] == "stream"] == [b"q Q"]


# g07_page_tree


def test_numbers_of_a_large_file_are_given_in_one_step():
    class Bodies(dict):
        def __iter__(self):
            pytest.fail("all numbers so far are looked through for the next one")

    writer = Writer()
    writer.bodies = Bodies()
    assert [writer.add(k).num for k in range(3)] == [1, 2, 3] and writer.stream({}, b"").num == 4


# t01_fonts


def test_pages_share_a_font(monkeypatch):
    seen = []
    monkeypatch.setattr(interpret.fonts, "read_font", lambda *a, read=interpret.fonts.read_font: seen.append(a) or read(*a))
    found = rows(interpret._fonts, document([b"q Q"] * 5, extend=wide_font))
    assert [r["page_index"] for r in found] == list(range(5)) and len(seen) == 1


# g10_resources


def test_resources_without_their_values(monkeypatch):
    no_json(monkeypatch)
    assert [(r["name"], r["ref"]) for r in rows(pdf._resources, document([b"q Q"], extend=wide_font), columns=["name", "ref"])] == [("F1", 1)]


# p17_xref


def test_entries_are_read_one_by_one_only_where_they_are_odd(monkeypatch):
    seen = []
    monkeypatch.setattr(pdf_syntax.Scanner, "_part", lambda self, *a, read=pdf_syntax.Scanner._part: seen.append(a) or read(self, *a))
    assert len(rows(pdf._xrefs, document([b"q Q"] * 20))) == 43 and len(seen) == 2


# F16: c01_content_ops


def test_counts_of_a_document_stay_in_its_task(spark, repeated):
    assert "Aggregate" not in agrees(spark, repeated, "c01_content_ops")


# v15_draw_commands


def test_command_counts():
    for data in [document([b"0 0 m 1 1 l S BT /F1 9 Tf (abc) Tj ET S"], extend=wide_font), b"no file", *mutations(60)]:
        counts = Counter()
        for r in rows(interpret._command_counts, data):
            counts[r.get("page_index"), r.get("kind"), str(r.get("_error"))] += r.get("n", 1)
        assert counts == Counter((r.get("page_index"), r.get("kind"), str(r.get("_error"))) for r in rows(interpret._commands, data))


# d31_op_trace


def test_trace_counts():
    for data in [document([b"q q Q zz q", b"1 l"]), b"no file", *mutations(60)]:
        counts = Counter()
        for r in rows(pdf._trace_counts, data):
            counts[r.get("op_name"), r.get("depth"), "_error" in r] += r.get("n", 1)
        assert counts == Counter((r.get("op_name"), r.get("depth"), "_error" in r) for r in rows(pdf._trace, data))


# F1 and F8 again


def test_runs_set_alike_keep_how_far_their_codes_move(monkeypatch):
    from quire.functions.fonts import Font

    seen = []
    monkeypatch.setattr(Font, "width", lambda self, code, of=Font.width: seen.append(code) or of(self, code))
    data = document([b"BT /F1 9 Tf (abab) Tj (ba) Tj ET 0 0 m 1 1 l S"], extend=wide_font)
    assert len(rows(interpret._commands, data, columns=["kind", "path"], kinds=("stroke",))) == 1 and sorted(seen) == [97, 98]


def test_tasks_have_a_share_of_the_bytes(spark, repeated, monkeypatch):
    from quire.plans import documents

    monkeypatch.setattr(documents, "TASK", 1)
    monkeypatch.setattr(documents, "MOST", 300)
    assert documents.files(spark, repeated).rdd.getNumPartitions() == 300
