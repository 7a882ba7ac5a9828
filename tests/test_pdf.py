"""Fixed cases of the syntax, content streams, calculator, fonts and canvas."""

import json

import pytest

from quire.functions import calculator, fonts
from quire.operators import canvas
from quire.operators import pdf_document as D
from quire.sources import content
from quire.sources.pdf_fixture import Writer, document, tiny_font
from quire.sources.pdf_syntax import Hex, Indirect, Name, PdfError, Ref, Scanner, Stream, Text, Trailer, Xref, parse_value

GOOD = [
    (b"-456 ", -456), (b"+789 ", 789), (b".00048828125", 0.00048828125), (b"-0.789 ", -0.789), (b"true\n", True), (b"null]", None), (b"/A#20Name", Name("A Name")), (b"/D#23E#5fF", Name("D#E_F")),
    (b"(Nested (parentheses))", Text(b"Nested (parentheses)")), (b"<48656C6C6F20576F726C64>", Hex(b"Hello World")), (b"<4>", Hex(b"@")), (b"[ 4 0 R]", [Ref(4)]), (b"[true false null]", [True, False, None]),
    (b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] >>", {"MediaBox": [0, 0, 612, 792], "Parent": Ref(2), "Type": Name("Page")}), (b"0 1 obj\n(HELLO)\nendobj\n", Indirect(0, 1, Text(b"HELLO"))),
    (b"1 0 obj\n<< /Length 3 >>\nstream\nabc\nendstream\nendobj\n", Stream(1, 0, {"Length": 3}, b"abc")),
    (b"xref\n0 2\n0000000000 65535 f \n0000000017 00000 n \ntrailer", Xref(0, [(0, 65535, "free"), (17, 0, "normal")])), (b"trailer\n<< /Root 1 0 R >>\nstartxref\n9\n", Trailer({"Root": Ref(1)}, 9)),
]
BAD = [
    (b"--42", "UnexpectedEndOfFile"), (b"123abc ", "MissingDelimiterAfterKeyword"), (b".", "FractionalPartError"), (b"-.", "FractionalPartError"), (b"truefalse", "MissingDelimiterAfterKeyword"), (b"/Name#2", "IncompleteHexEscape"), (b"/", "InvalidToken"), (b"<4Z>", "NotHexDecimal"),
    (b"(a", "UnbalancedParentheses"), (b"<< 1 2 >>", "InvalidKey"), (b"[" * 40, "NestingDepthExceeded"), (b"1 0 obj\n<< /Length 99 >>\nstream\nabc\nendstream\nendobj\n", "UnexpectedEndOfFile"), (b"1 0 obj\n<< >>\nstream\nabc\nendstream\nendobj\n", "MissingRequiredKey"), (b"q", "InvalidToken"),
]


@pytest.mark.parametrize(("data", "value"), GOOD)
def test_values(data, value):
    assert parse_value(data) == value and type(parse_value(data)) is type(value)


@pytest.mark.parametrize(("data", "kind"), BAD)
def test_errors(data, kind):
    with pytest.raises(PdfError) as e:
        parse_value(data)
    assert e.value.kind == kind


def test_header_and_comment():
    assert Scanner(b"%PDF-1.7\n").header() == (1, 7)
    with pytest.raises(PdfError, match="InvalidMinorVersion"):
        Scanner(b"%PDF-1.x").header()
    assert parse_value(b"%Another comment\r").text == "Another comment"


def ops(data, compat=False):
    found, error = content.parse(data, compat)
    return [o.op for o in found], error and error.kind


def test_content_quirks():
    assert len(content.OPERATORS) == 64
    assert ops(b"(a) ' q") == (["'", "q"], None) and ops(b"(a) ' q", True) == ([], None)
    assert content.parse(b"1 0 0 scn")[0][0].nums == [1, 0, 0] and content.parse(b"1 0 0 scn", True)[0][0].nums == [0, 0]
    assert ops(b"/a /b BDC", True) == ([], "InvalidOperandType") and ops(b"/a /b BDC") == (["BDC"], None)
    assert ops(b"q 5 zz", True) == (["q"], "UnknownOperator") and ops(b"q 5 zz Q") == (["q", "zz", "Q"], None) and ops(b"1 l") == ([], "IncorrectOperandCount") and ops(b"3 J") == ([], "InvalidOperandValue")
    assert ops(b"true q", True) == ([], "UnknownOperator") and ops(b"q F", True) == (["q"], "UnknownOperator") and ops(b"q F") == (["q", "F"], None)


@pytest.mark.parametrize(
    ("stack", "text", "out"),
    [([1, 2, 3, 4, 5], "4 -2 roll", [1, 4, 5, 2, 3]), ([-10, 3], "mod", [-1]), ([3], "dup 2 gt { 2 mul } if", [6]), ([1], "0 { 5 } { 7 } ifelse", [1, 7]), ([1, 2], "2 copy", [1, 2, 1, 2]), ([-2.5], "cvi", [-2]), ([1, 0], "and", [0]), ([1, 2], "exch pop", [2])],
)
def test_calculator(spark, stack, text, out):
    assert calculator.run(calculator.parse(text), stack) == out
    row = spark.range(1).select(calculator.evaluate(text, [calculator.F.lit(float(x)) for x in stack]).alias("r")).first().r
    assert (row.stack, row.error) == (out, None)


@pytest.mark.parametrize(("stack", "text", "kind"), [([1, 0], "div", "DivisionByZero"), ([-1], "sqrt", "NegativeSqrt"), ([], "add", "StackUnderflow"), ([1], "5 1 roll", "RollCountTooLarge"), ([1], "neg", "InvalidNumber"), ([1], "if", "EmptyBlockStack"), ([1e308], "10 mul", "ArithmeticOverflow")])
def test_calculator_errors(spark, stack, text, kind):
    row = spark.range(1).select(calculator.evaluate(text, [calculator.F.lit(float(x)) for x in stack]).alias("r")).first().r
    assert row.stack is None and row.error == kind


def test_fonts():
    runs = fonts.cid_widths([10, 12, 600, 1, [500, 510]])
    assert [fonts.width_of(runs, c) for c in (1, 2, 3, 10, 12, 13)] == [500, 510, None, 600, 600, None]
    for bad, kind in (([5], "IncompleteCIDEntry"), ([5, 6], "MissingWidthForCIDRange"), ([5, []], "EmptyWidthsArray"), ([5, 4, 1], "InvalidCIDRange"), ([1, [1], 1, [2]], "DuplicateCIDStart"), ([1, 5, 1, 3, [2]], "OverlappingRange"), ([65535, [1, 2]], "RangeTooLarge")):
        with pytest.raises(PdfError) as e:
            fonts.cid_widths(bad)
        assert e.value.kind == kind
    assert fonts.character_map(b"2 beginbfchar\n<02> <0048>\n<03> <D800>\nendbfchar\n<04> <0049>") == {2: "H"}
    assert fonts.differences([39, Name("quotesingle"), Name("x"), 96, Name("grave")]) == {39: "quotesingle", 40: "x", 96: "grave"}
    assert fonts.char_string(bytes([139])) == [0] and fonts.char_string(bytes([247, 0])) == [108] and fonts.char_string(bytes([28, 0xFF, 0x9C])) == [-100]
    assert fonts.draw([10, 20, "rmoveto", 5, "hlineto", 1, 2, 3, 4, 5, 6, "rrcurveto", "endchar"])[0] == [("move", [10, 20]), ("line", [15, 20]), ("cubic", [16, 22, 19, 26, 24, 32]), ("close", [])]
    for op in set(fonts.CHARSTRING.values()) - fonts.IMPLEMENTED:
        assert fonts.draw([1, op])[1].kind == "Unimplemented"
    assert fonts.glyph_path(b"")[1] is None and fonts.glyph_path(bytes([10]))[1].kind == "StackUnderflow" and fonts.glyph_path(bytes([139, 10]))[1].kind == "InvalidSubroutine"
    assert fonts.glyph_path(bytes([139 - 107, 10]), [bytes([139 - 107, 10])])[1].kind == "InvalidSubroutine"  # a subroutine that calls itself
    assert fonts.font_dictionary(bytes([30, 0x0A, 0x14, 0x05, 0x41, 0xC3, 0xFF, 140, 17])) == {17: [0.140541e-3, 1]}
    assert len(fonts.CHARSTRING) == 48 and len(fonts.IMPLEMENTED) == 12 and fonts.STANDARD_ENCODING[65] == 34 and fonts.STANDARD_ENCODING[251] == 149


def commands(body, compat=False, extend=None):
    d = D.load(document([body], extend=extend))
    _, page = next(d.pages())
    return canvas.render_page(d, page, compat)


def test_canvas_paths_and_state():
    c = commands(b"q 2 0 0 2 0 0 cm 1 0 0 RG 10 10 m 20 10 l S Q 0 0 5 5 re f B", compat=True)
    assert [x.kind for x in c.commands] == ["stroke", "fill"]
    assert c.commands[0].path == [("move", [20.0, 772.0]), ("line", [40.0, 772.0])] and c.commands[0].color == (1, 0, 0, 1)
    assert [e.kind for _, e in c.errors] == ["NotImplemented"]
    c = commands(b"0 0 5 5 re f B 0 0 5 5 re B zz")
    assert [x.kind for x in c.commands] == ["fill", "fill", "stroke"] and [e.kind for _, e in c.errors] == ["NoActivePath", "UnknownOperator"]
    for op in sorted(canvas.NOT_IMPLEMENTED - {"ID", "BI", "EI", "d1"}):
        operands = {"sh": b"/S ", "TD": b"1 2 ", "'": b"(a) ", '"': b"1 2 (a) ", "TL": b"1 ", "Tr": b"1 "}.get(op, b"")
        found = commands(b"0 0 m 1 1 l " + operands + op.encode(), compat=True)
        # Quotes end a stream without a word there.
        assert [e.kind for _, e in found.errors] == ([] if op in "'\"" else ["NotImplemented"]), op
    clip = commands(b"q 0 0 5 5 re W n Q", compat=True)
    assert [x.kind for x in clip.commands] == ["set_clip", "reset_clip"]


def test_canvas_resources():
    def extend(w: Writer):
        inner = w.stream({"Subtype": Name("Form"), "BBox": [0, 0, 9, 9], "Matrix": [1, 0, 0, 1, 100, 0]}, b"0 0 1 1 re f")
        image = w.stream({"Subtype": Name("Image"), "Width": 1, "Height": 2, "BitsPerComponent": 8, "ColorSpace": Name("DeviceGray")}, b"ab")
        return {"XObject": {"F": inner, "I": image}, "ExtGState": {"G": {"ca": 0.5, "BM": Name("Multiply"), "LW": 3}}, "Pattern": {"P": {"PatternType": 2, "Shading": {"ShadingType": 2, "ColorSpace": Name("DeviceRGB"), "Coords": [0, 0, 1, 1], "Function": {"FunctionType": 2, "N": 1}}}}}

    c = commands(b"/G gs /F Do /I Do /P scn 0 0 2 2 re f /None Do", extend=extend)
    assert [x.kind for x in c.commands] == ["fill", "draw_image", "fill"] and c.errors[0][1].kind == "ResourceNotFound"
    assert c.commands[0].path[0] == ("move", [100.0, 792.0]) and c.commands[0].color[3] == 0.5 and c.commands[0].blend == "Multiply"
    assert c.commands[2].shader["type"] == "axial" and c.commands[1].info["bytes"] == 2


def test_text_advances():
    def extend(w: Writer):
        return {"Font": {"F1": w.add({"Subtype": Name("TrueType"), "BaseFont": Name("B"), "FirstChar": 65, "LastChar": 66, "Widths": [500, 250]})}}

    c = commands(b"BT /F1 10 Tf 1 Tc 1 0 0 1 100 0 Tm (AB) Tj [(A) 1000 (B)] TJ ET", extend=extend)
    assert [round(x.info["x"], 3) for x in c.commands] == [100, 106, 109.5, 105.5]
    again = commands(b"BT /F1 10 Tf (A) Tj (A) Tj ET", compat=True, extend=extend)
    assert [x.info["x"] for x in again.commands] == [0, 0]


def test_tables_keep_faults_as_rows(spark):
    from quire.sources.pdf import read_table

    files = spark.createDataFrame([(1, bytearray(document([b"q Q", b"1 2"]))), (2, bytearray(b"not a file")), (3, None)], "doc_id long, content binary")
    found = read_table(files, "content_ops").collect()
    assert {(r.doc_id, r.op, r._error and r._error.kind) for r in found} == {(1, "q", None), (1, "Q", None), (2, None, "UnexpectedToken"), (3, None, "MissingContent")}
    value = read_table(files.where("doc_id = 1"), "trailers").first().value
    assert json.loads(value)["dict"]["Root"] == {"ref": 6}


def test_data_source(spark, tmp_path):
    from quire.sources.pdf import PdfDataSource, read_files, read_table

    (tmp_path / "a.pdf").write_bytes(document([b"q Q"]))
    (tmp_path / "b.pdf").write_bytes(b"junk")
    spark.dataSource.register(PdfDataSource)
    rows = spark.read.format("pdf").option("table", "content_ops").load(str(tmp_path)).collect()
    assert sorted(str(r.op) for r in rows) == ["None", "Q", "q"]
    assert read_table(read_files(spark, str(tmp_path)), "pages").where("page_index = 0").count() == 1


def test_cycles_are_errors():
    w = Writer()
    w.add({"Type": Name("Pages"), "Kids": [Ref(1)]}, 1)
    data = w.finish(w.add({"Type": Name("Catalog"), "Pages": Ref(1)}, 2))
    with pytest.raises(PdfError, match="Cycle"):
        list(D.load(data).pages())
    with pytest.raises(PdfError, match="Duplicate"):
        D.load(b"%PDF-1.7\n1 0 obj\n1\nendobj\n1 0 obj\n2\nendobj\n%%EOF")


def test_images_and_luminosity():
    assert canvas.expand_image(bytes([9, 8]), 1, 2) == bytes([9, 9, 9, 255, 8, 8, 8, 255])
    assert canvas.expand_image(bytes([1, 2, 3]), 1, 1, bytes([7])) == bytes([1, 2, 3, 7])
    assert canvas.expand_image(bytes([1, 2, 3, 200]), 1, 1, bytes([128])) == bytes([1, 2, 3, 100])


def test_true_type_outlines():
    from quire.functions.truetype import true_type

    font = true_type(tiny_font())
    assert (font.units, font.glyphs, font.characters) == (100, 4, {65: 1})
    assert font.outline(0) == [] and font.outline(1) == [("move", [0, 0]), ("line", [100, 0]), ("line", [50, 100]), ("line", [0, 0]), ("close", [])]
    assert font.outline(2)[0] == ("move", [0, 50]) and [v for v, _ in font.outline(2)] == ["move", "quad", "quad", "quad", "quad", "close"]
    assert font.outline(3)[1] == ("line", [110, 20])
    with pytest.raises(PdfError):
        font.outline(9)

    def extend(w: Writer):
        file, codes = w.stream({}, tiny_font()), w.stream({}, b"beginbfchar\n<42> <0041>\nendbfchar")
        return {"Font": {"F1": w.add({"Subtype": Name("TrueType"), "FirstChar": 66, "LastChar": 66, "Widths": [500], "ToUnicode": codes, "FontDescriptor": {"FontFile2": file}})}}

    c = commands(b"BT /F1 10 Tf (B) Tj ET", extend=extend)
    assert [x.kind for x in c.commands] == ["glyph", "fill"] and c.commands[1].path[1] == ("line", [10.0, 792.0])
