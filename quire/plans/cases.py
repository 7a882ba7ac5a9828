"""Queries of operators whose inputs are bytes or structures rather than columns.

Each case runs on executors for every nation, with the nation's key woven into
its input, and reports one line of text; the SQL says what that line must be.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import fonts
from quire.operators import canvas
from quire.operators import pdf_document as D
from quire.plans.registry import register, table
from quire.sources import content
from quire.sources.pdf_fixture import Writer, document, tiny_font
from quire.sources.pdf_syntax import Hex, Name, PdfError, Ref, Scanner, Text, parse_value

K = "CAST(n_nationkey AS VARCHAR)"


def case(name: str, run: Callable[[int], object], sql: str) -> None:
    """``run(k)`` gives the outcome for key k; an error's outcome is its kind. ``sql`` is a text expression."""

    @register(name, f"SELECT CAST(n_nationkey AS BIGINT) AS k, {sql} AS outcome FROM nation")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for k in batch.column(0).to_pylist():
                    try:
                        out.append(str(run(k)))
                    except PdfError as e:
                        out.append(e.kind)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["k", "outcome"])

        return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k")).mapInArrow(apply, "k long, outcome string")


def _num(x: float) -> str:
    return str(int(x)) if x == int(x) else f"{x:g}"


def _path(path: list) -> str:
    return ";".join(" ".join([verb, *map(_num, pts)]) for verb, pts in path)


# -- Lexing and parsing ----------------------------------------------------------------------


def _read_exactly(k: int) -> str:
    s = Scanner(b"abcdef")
    s.expect(b"abc")
    return f"{s.at} {s.byte()} {k}"


case("s05_tokenizer", _read_exactly, f"'3 100 ' || {K}")
case("s06_read_past_end", lambda k: Scanner(b"abcdef"[: k % 4]).keyword(b"abc") or "read", "CASE WHEN n_nationkey % 4 < 3 THEN 'UnexpectedEndOfFile' ELSE 'read' END")
case("p01_dispatch", lambda k: [type(parse_value(x % k)).__name__ for x in (b"%d 0 R", b"%d ", b"[%d]", b"(%d)", b"/N%d", b"<< /A %d >>")], "'[''Ref'', ''int'', ''list'', ''Text'', ''Name'', ''dict'']'")
case("p02_nesting_guard", lambda k: type(parse_value(b"[" * (20 + k) + b"]" * (20 + k))).__name__, "CASE WHEN 20 + n_nationkey > 32 THEN 'NestingDepthExceeded' ELSE 'list' END")
case("p03_whitespace", lambda k: parse_value(b"[\t%d\r\n\x0c2 ]" % k), f"'[' || {K} || ', 2]'")
case("p04_keyword", lambda k: Scanner(b"null" + (b"x" if k % 2 else b" ")).keyword(b"null") or "read", "CASE WHEN n_nationkey % 2 = 1 THEN 'MissingDelimiterAfterKeyword' ELSE 'read' END")
case("p06_comment", lambda k: parse_value(b"%%note %d\r" % k).text, f"'note ' || {K}")
case("p07_boolean", lambda k: parse_value(b"true " if k % 2 else b"false "), "CASE WHEN n_nationkey % 2 = 1 THEN 'True' ELSE 'False' END")
case("p08_null", lambda k: parse_value(b"[" + b"null " * k + b"]").count(None), K)
case("p13_array", lambda k: len(parse_value(b"[" + b" 1" * k + b" %c\n]")), "CAST(n_nationkey + 1 AS VARCHAR)")
case("p18_xref_status", lambda k: parse_value(b"xref\n0 1\n0000000000 00000 %s \n" % b"nfo"[k % 3 : k % 3 + 1]).entries[0][2], "CASE n_nationkey % 3 WHEN 0 THEN 'normal' WHEN 1 THEN 'free' ELSE 'compressed' END")
case("p20_end_of_file", lambda k: len(D.load(b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n1\nendobj\n" % n for n in range(1, k + 1)) + b"%%EOF\n99 0 obj\n1\nendobj\n").values), K)
case("s02_embedded_bytes", lambda k: [len(list(d.pages())) for d in [D.load(document([b"q Q"] * (k + 1)))]][0], "CAST(n_nationkey + 1 AS VARCHAR)")

# -- Object graph ------------------------------------------------------------------------------


def _graph(k: int) -> D.Document:
    w = Writer()
    w.add({"Key": k}, 1)
    w.bodies[2] = b"1 0 R"
    w.stream({"Deep": k}, b"q", num=3)
    w.bodies[4] = b"4 0 R"
    return D.load(w.finish(Ref(1)))


case("g04_resolve_dictionary", lambda k: (_graph(k).dictionary(Ref(1)), _graph(k).dictionary(Ref(3))["Deep"]), f"'({{''Key'': ' || {K} || '}}, ' || {K} || ')'".replace("{{", "{").replace("}}", "}"))
case("g05_resolve_stream", lambda k: _graph(k).stream(Ref(3)).data.decode() if k % 2 else _graph(k).stream(Ref(1)), "CASE WHEN n_nationkey % 2 = 1 THEN 'q' ELSE 'TypeMismatch' END")
case("g03_indirect_unwraps_once", lambda k: _graph(k).resolve(Ref(2)), "'Ref(num=1)'")
case("g03_missing_object", lambda k: "found" if _graph(k).resolve(Ref(1 + k)) is not None else "none", "CASE WHEN 1 + n_nationkey > 4 THEN 'FailedResolveObjectReference' ELSE 'found' END")
case("g06_required_key", lambda k: D.need({"A": k}, "A" if k % 2 else "B"), f"CASE WHEN n_nationkey % 2 = 1 THEN {K} ELSE 'MissingRequiredKey' END")
case("g08_page_build", lambda k: [f"{n} {' '.join(sorted(p))}" for n, p in D.load(document([b"q Q"] * (k + 1))).pages()][k], "CAST(3 + 2 * n_nationkey AS VARCHAR) || ' Contents MediaBox Parent Resources Type'")


def _streams(k: int) -> str:
    w = Writer()
    parts = [w.stream({}, b"q %d w" % k), w.stream({}, b"Q")]
    w.add({"Type": Name("Pages"), "Kids": [Ref(9)]}, 8)
    w.add({"Type": Name("Page"), "Contents": parts}, 9)
    d = D.load(w.finish(w.add({"Pages": Ref(8)}, 10)))
    _, page = next(d.pages())
    return " ".join(o.op + "".join(_num(x) for x in o.nums) for o in d.operators(page)[0])


case("g09_contents_concat", _streams, f"'q w' || {K} || ' Q'")
case("g11_media_box", lambda k: D.media_box({"MediaBox": [0, 1, 100 + k, 200.9]} if k % 2 else {"MediaBox": [-1, 0, 1, 1]}), "CASE WHEN n_nationkey % 2 = 1 THEN '(0, 200, ' || CAST(100 + n_nationkey AS VARCHAR) || ', 1)' ELSE 'NumberConversionError' END")
case("g12_matrix", lambda k: _num(D.matrix({"Matrix": [1, 0, 0, 1, k, 2]})[4]) if k % 2 else D.matrix({"Matrix": [1, 2]}), f"CASE WHEN n_nationkey % 2 = 1 THEN {K} ELSE 'InvalidArrayLength' END")


def _canvas(body: bytes, extend=None, compat: bool = False) -> canvas.Canvas:
    d = D.load(document([body], extend=extend))
    _, page = next(d.pages())
    return canvas.render_page(d, page, compat)


def _first_error(c: canvas.Canvas) -> str:
    return c.errors[0][1].kind if c.errors else "none"


def _objects(k: int):
    def extend(w: Writer) -> dict:
        mask = w.stream({"Subtype": Name("Image"), "Width": 1, "Height": 1, "BitsPerComponent": 8}, b"m")
        image = w.stream({"Subtype": Name("Image"), "Width": k + 1, "Height": 2, "BitsPerComponent": 8, "ColorSpace": Name("DeviceRGB"), "SMask": mask}, b"data")
        form = w.stream({"Subtype": Name("Form"), "BBox": [0, 0, 9, 9], "Matrix": [1, 0, 0, 1, k, 0]}, b"0 0 1 1 re f")
        ps = w.stream({"Subtype": Name("PS")}, b"")
        bad = w.stream({"Subtype": Name("Image"), "Width": 1, "Height": 1}, b"")
        tile = w.stream({"PatternType": 1, "PaintType": 1, "TilingType": 2, "BBox": [0, 0, k, 4], "XStep": k, "YStep": 4}, b"0 0 1 1 re f")
        shade = {"ShadingType": 2, "ColorSpace": Name("DeviceRGB"), "Coords": [0, 0, k, 1], "Function": {"FunctionType": 2, "N": 1}}
        radial = {"ShadingType": 3, "ColorSpace": Name("DeviceRGB"), "Coords": [0, 0, 1, 0, 0, k], "Function": {"FunctionType": 2, "N": 1}}
        patterns = {"T": tile, "A": {"PatternType": 2, "Shading": shade}, "R": {"PatternType": 2, "Shading": radial}, "M": {"PatternType": 2, "Shading": {"ShadingType": 4, "ColorSpace": Name("DeviceRGB")}}, "C": {"PatternType": 2, "Shading": {"ShadingType": 2, "ColorSpace": Name("Lab")}}, "F": {"PatternType": 2, "Shading": {"ShadingType": 1, "ColorSpace": Name("DeviceGray")}}}
        states = {"LW": {"LW": k}, "BM": {"BM": Name("Multiply")}, "BX": {"BM": Name("Compatible")}, "B2": {"BM": [Name("Normal"), Name("Hue")]}, "X": {"Nope": 1}, "D": {"D": [[1], 0]}, "ca": {"ca": 0.5, "CA": 0.25}, "SM": {"SMask": {"S": Name("Luminosity"), "G": form}}, "SN": {"SMask": Name("None")}, "Fo": {"Font": [Ref(1), 9]}}
        return {"XObject": {"I": image, "F": form, "P": ps, "B": bad}, "Pattern": patterns, "ExtGState": states}

    return extend


def _shader(name: str):
    def run(k: int) -> object:
        c = _canvas(b"/%s scn 0 0 1 1 re f" % name.encode(), _objects(k))
        if c.errors:
            return c.errors[0][1].kind
        s = c.commands[0].shader
        return s["type"] + " " + " ".join(_num(x) for x in s.get("coords", s.get("bbox", [])))

    return run


case("g13_xobject_dispatch", lambda k: _first_error(_canvas(b"/P Do" if k % 2 else b"/F Do", _objects(k))), "CASE WHEN n_nationkey % 2 = 1 THEN 'UnsupportedXObjectSubtype' ELSE 'none' END")
case("g14_image", lambda k: {n: v for n, v in _canvas(b"/I Do", _objects(k)).commands[0].info.items() if n in ("width", "height", "bits", "bytes")}, f"'{{''width'': ' || CAST(n_nationkey + 1 AS VARCHAR) || ', ''height'': 2, ''bits'': 8, ''bytes'': 4}}'".replace("{{", "{").replace("}}", "}"))
case("g14_image_without_depth", lambda k: _first_error(_canvas(b"/B Do" if k % 2 else b"/I Do", _objects(k))), "CASE WHEN n_nationkey % 2 = 1 THEN 'MissingRequiredKey' ELSE 'none' END")
case("g15_form", lambda k: _num(_canvas(b"/F Do", _objects(k)).commands[0].path[0][1][0]), K)
case("g16_ext_gstate", lambda k: _first_error(_canvas(b"/X gs" if k % 2 else b"/LW gs", _objects(k))), "CASE WHEN n_nationkey % 2 = 1 THEN 'UnsupportedExtGStateKey' ELSE 'none' END")
case("g17_blend_mode", lambda k: _canvas(b"/BM gs 0 0 1 1 re f", _objects(k)).commands[0].blend if k % 2 else _first_error(_canvas(b"/BX gs", _objects(k))), "CASE WHEN n_nationkey % 2 = 1 THEN 'Multiply' ELSE 'InvalidBlendMode' END")
case("g18_soft_mask", lambda k: [c.kind for c in _canvas(b"/SM gs " + b"0 0 1 1 re f " * k + b"/SN gs", _objects(k)).commands].index("end_mask"), "CAST(n_nationkey + 2 AS VARCHAR)")
case("g20_tiling_pattern", _shader("T"), f"'tiling 0 0 ' || {K} || ' 4'")
case("g21_axial_shading", _shader("A"), f"'axial 0 0 ' || {K} || ' 1'")
case("g21_radial_shading", _shader("R"), f"'radial 0 0 1 0 0 ' || {K}")
case("g21_function_shading", _shader("F"), "'function '")
case("g21_mesh_shading", lambda k: _shader("M" if k % 2 else "A")(k), "CASE WHEN n_nationkey % 2 = 1 THEN 'InvalidShadingType' ELSE 'axial 0 0 ' || n_nationkey || ' 1' END")
case("g22_color_space", lambda k: _shader("C" if k % 2 else "A")(k), "CASE WHEN n_nationkey % 2 = 1 THEN 'UnsupportedColorSpace' ELSE 'axial 0 0 ' || n_nationkey || ' 1' END")

# -- Canvas ------------------------------------------------------------------------------------

case("v02_save_restore", lambda k: [_num(c.line_width) for c in _canvas(b"%d w q 99 w 0 0 m 1 1 l S Q 0 0 m 1 1 l S" % k).commands], f"'[''99'', ''' || {K} || ''']'")
case("v02_empty_stack", lambda k: [(n, e.kind) for n, e in _canvas(b"Q " * (k + 2) + b"1 w").errors], "'[(' || (n_nationkey + 2) || ', ''EmptyGraphicsStateStack'')]'")
case("v04_fill_and_stroke", lambda k: [(c.kind, _num(c.path[1][1][0])) for c in _canvas(b"0 0 %d 1 re B" % k).commands], f"'[(''fill'', ''' || {K} || '''), (''stroke'', ''' || {K} || ''')]'")
case("v05_clip_path", lambda k: [(c.kind, c.fill_rule, _num(c.path[1][1][0])) for c in _canvas(b"0 0 %d 9 re W* n" % k).commands], f"'[(''set_clip'', ''even_odd'', ''' || {K} || ''')]'")
case("v06_shader", _shader("A"), f"'axial 0 0 ' || {K} || ' 1'")
case("v07_pattern_shader", _shader("T"), f"'tiling 0 0 ' || {K} || ' 4'")
case("v08_resource_missing", lambda k: _first_error(_canvas(b"/N%d Do" % k if k % 2 else b"/I Do", _objects(k))), "CASE WHEN n_nationkey % 2 = 1 THEN 'ResourceNotFound' ELSE 'none' END")
case("v09_render_content", lambda k: len(_canvas(b"0 0 1 1 re f " * k).commands), K)
case("v10_invoke_xobject", lambda k: [c.kind for c in _canvas(b"/I Do " * k + b"/F Do", _objects(k)).commands].index("fill"), K)
case("v11_ext_gstate", lambda k: (_canvas(b"/ca gs 0 0 1 1 re f", _objects(k)).commands[0].color[3], _num(_canvas(b"/LW gs 0 0 m 1 1 l S", _objects(k)).commands[0].line_width)), f"'(0.5, ''' || {K} || ''')'")
case("v12_mask_layers", lambda k: [(c.kind, _num(c.path[1][1][0])) if c.path else c.kind for c in _canvas(b"/SM gs 0 0 %d 1 re f /SN gs" % k, _objects(1)).commands][2:], f"'[(''fill'', ''' || {K} || '''), ''end_mask'']'")
case("v13_marked_content", lambda k: [len(c.errors) + len(c.commands) for c in [_canvas(b"/A BMC /B << /K 1 >> BDC 0 0 1 1 re f EMC EMC " * k)]][0], K)
case("v14_backend_kinds", lambda k: sorted({c.kind for c in _canvas(b"q 0 0 1 1 re W f 0 0 m 1 %d l S Q /I Do /SM gs /SN gs" % k, _objects(k)).commands}), "'[''begin_mask'', ''draw_image'', ''end_mask'', ''fill'', ''reset_clip'', ''set_clip'', ''stroke'']'")
case("v18_image_expand", lambda k: list(canvas.expand_image(bytes([k, 1, 2]), 1, 1, bytes([7]))), f"'[' || {K} || ', 1, 2, 7]'")
case("m08_path_build", lambda k: _path(_canvas(b"%d 1 m 2 3 4 5 v 6 7 8 9 y h S" % k).commands[0].path), f"'move ' || {K} || ' 791;cubic ' || {K} || ' 791 2 789 4 787;cubic 6 785 8 783 8 783;close'")

# -- Fonts and text ----------------------------------------------------------------------------


def _fonted(entries: Callable[[Writer, int], dict], body: bytes = b"BT /F1 10 Tf (A) Tj ET", compat: bool = False, states: Callable[[Ref], dict] | None = None):
    def run(k: int) -> canvas.Canvas:
        def extend(w: Writer) -> dict:
            font = w.add(entries(w, k))
            return {"Font": {"F1": font}} | ({"ExtGState": states(font)} if states else {})

        return _canvas(body, extend, compat)

    return run


def _simple(w: Writer, k: int) -> dict:
    return {"Subtype": Name("TrueType"), "BaseFont": Name("B"), "FirstChar": 65, "LastChar": 66, "Widths": [k * 10, 5, 7]}


def _type0(w: Writer, k: int) -> dict:
    child = w.add({"Subtype": Name("CIDFontType2"), "DW": 900, "W": [1, 3, k]})
    return {"Subtype": Name("Type0"), "Encoding": Name("Identity-H"), "DescendantFonts": [child]}


def _type3(w: Writer, k: int) -> dict:
    glyph = w.stream({}, b"%d 0 0 0 9 9 d1 0 0 1 1 re f" % (k * 100))
    return {"Subtype": Name("Type3"), "FontMatrix": [0.001, 0, 0, 0.001, 0, 0], "CharProcs": {"a": glyph}, "Encoding": {"Differences": [65, Name("a")]}, "FirstChar": 65, "LastChar": 65, "Widths": [1]}


def compact(glyphs: list[bytes]) -> bytes:
    """A compact font whose glyph g stands for string id g (code 31 + g)."""

    def table_of(items: list[bytes]) -> bytes:
        offsets = [1]
        for x in items:
            offsets.append(offsets[-1] + len(x))
        return len(items).to_bytes(2, "big") + b"\x02" + b"".join(o.to_bytes(2, "big") for o in offsets) + b"".join(items) if items else b"\0\0"

    def number(n: int) -> bytes:
        return b"\x1c" + n.to_bytes(2, "big")

    head = bytes([1, 0, 4, 2]) + table_of([b"F"])
    at = len(head) + len(table_of([b"\0" * 8])) + 4
    programs = table_of(glyphs)
    top = number(at) + bytes([17]) + number(at + len(programs)) + bytes([15])
    charset = b"\0" + b"".join(g.to_bytes(2, "big") for g in range(1, len(glyphs)))
    return head + table_of([top]) + b"\0\0\0\0" + programs + charset


def _int(n: int) -> bytes:
    return b"\x1c" + (n & 0xFFFF).to_bytes(2, "big")


def program(*items: int | str | bytes) -> bytes:
    code = {name: bytes([op]) if op < 1200 else bytes([12, op - 1200]) for op, name in fonts.CHARSTRING.items()}
    return b"".join(code[x] if isinstance(x, str) else x if isinstance(x, bytes) else _int(x) for x in items)


def _type1(w: Writer, k: int) -> dict:
    file = w.stream({}, compact([program("endchar"), program(k, 0, "rmoveto", 10, "hlineto", "endchar")]))
    return {"Subtype": Name("Type1"), "BaseFont": Name("C"), "FirstChar": 32, "LastChar": 32, "Widths": [600], "FontDescriptor": {"FontFile3": file}}


def _outlined(w: Writer, k: int) -> dict:
    file, codes = w.stream({}, tiny_font()), w.stream({}, b"beginbfchar\n<42> <0041>\nendbfchar")
    return {"Subtype": Name("TrueType"), "FirstChar": 66, "LastChar": 66, "Widths": [500], "ToUnicode": codes, "FontDescriptor": {"FontFile2": file}}


def _glyphs(c: canvas.Canvas) -> list:
    return [(g.info["code"], _num(round(g.info["advance"], 3))) for g in c.commands if g.kind == "glyph"]


case("g19_dash_and_font", lambda k: [_first_error(_canvas(b"/D gs", _objects(k))), _num(_fonted(_simple, b"BT /Fo gs (Z) Tj ET", states=lambda font: {"Fo": {"Font": [font, k]}})(k).commands[0].info["size"])], f"'[''none'', ''' || {K} || ''']'")
case("t01_font_dispatch", lambda k: _first_error(_fonted(lambda w, k: {"Subtype": Name("MMType1" if k % 2 else "TrueType")})(k)), "CASE WHEN n_nationkey % 2 = 1 THEN 'UnsupportedFontSubtype' ELSE 'none' END")
case("t02_encoding", lambda k: fonts.encoding_kind(("Identity-H", "Identity-V", f"E{k}")[k % 3]), "CASE n_nationkey % 3 WHEN 0 THEN 'IdentityHorizontal' WHEN 1 THEN 'IdentityVertical' ELSE 'Other' END")
case("t03_font_descriptor", lambda k: fonts.font_file(_graph(k), {"FontFile": Ref(3), "FontFile2": Ref(1)}).dict["Deep"], K)
case("t05_simple_width", lambda k: _glyphs(_fonted(_simple)(k)), "'[(65, ''' || CASE WHEN n_nationkey * 10 % 100 = 0 THEN CAST(n_nationkey // 10 AS VARCHAR) ELSE rtrim(CAST(n_nationkey / 10.0 AS VARCHAR), '0') END || ''')]'")
case("t06_cid_width_runs", lambda k: fonts.cid_widths([k, [1, 2], 100, 101, 3]), f"'[(' || {K} || ', ' || CAST(n_nationkey + 1 AS VARCHAR) || ', [1.0, 2.0]), (100, 101, [3.0, 3.0])]'")
case("t09_type0", lambda k: [fonts.read_font(d, n).default_width for d, n in [_with_font(_type0, k)]], "'[900.0]'")
case("t10_true_type", lambda k: fonts.read_font(*_with_font(lambda w, k: {"Subtype": Name("TrueType"), "BaseFont": Name(f"B{k}")}, k)).base_font, f"'B' || {K}")
case("t11_type1_without_descriptor", lambda k: fonts.read_font(*_with_font(lambda w, k: {"Subtype": Name("Type1")}, k)), "'MissingRequiredKey'")
case("t12_type3", lambda k: sorted(fonts.read_font(*_with_font(_type3, k)).procedures), "'[''a'']'")
case("t13_differences", lambda k: fonts.differences([k, Name("a"), Name("b")]) if k % 2 else fonts.differences([255, Name("a")]), f"CASE WHEN n_nationkey % 2 = 1 THEN '{{' || {K} || ': ''a'', ' || CAST(n_nationkey + 1 AS VARCHAR) || ': ''b''}}' ELSE 'CodeOverflow' END".replace("{{", "{").replace("}}", "}"))
case("t15_cmap_get", lambda k: fonts.character_map(b"beginbfchar\n<02> <0048>\nendbfchar").get(2 if k % 2 else 10), "CASE WHEN n_nationkey % 2 = 1 THEN 'H' ELSE 'None' END")
case("t16_show_text_dispatch", lambda k: [len(_glyphs(_fonted(f)(k))) for f in (_simple, _type0, _type3)], "'[1, 0, 1]'")
case("t17_type0_layout", lambda k: _glyphs(_fonted(_type0, b"BT /F1 1000 Tf <00020009> Tj ET")(k)), f"'[(2, ''' || {K} || '''), (9, ''900'')]'")
case("t18_outline_capture", lambda k: _path([c for c in _fonted(_outlined, b"BT /F1 100 Tf %d 0 Td (B) Tj ET" % k)(k).commands if c.kind == "fill"][0].path), f"'move ' || {K} || ' 792;line ' || CAST(n_nationkey + 100 AS VARCHAR) || ' 792;line ' || CAST(n_nationkey + 50 AS VARCHAR) || ' 692;line ' || {K} || ' 792;close'")
case("t19_type1_layout", lambda k: _path([c for c in _fonted(_type1, b"BT /F1 1000 Tf ( ) Tj ET")(k).commands if c.kind == "fill"][0].path), f"'move ' || {K} || ' 792;line ' || CAST(n_nationkey + 10 AS VARCHAR) || ' 792;close'")
case("t20_type3_layout", lambda k: _glyphs(_fonted(_type3, b"BT /F1 10 Tf (A) Tj ET")(k)), "'[(65, ''' || CASE WHEN n_nationkey = 0 THEN '0.01' ELSE CAST(n_nationkey AS VARCHAR) END || ''')]'")


def _with_font(entries: Callable[[Writer, int], dict], k: int) -> tuple[D.Document, object]:
    w = Writer()
    num = w.add(entries(w, k)).num
    return D.load(w.finish(Ref(num))), Ref(num)


case("cf01_reader", lambda k: len(fonts.compact_font(compact([program("endchar")] * (k + 1))).glyphs), "CAST(n_nationkey + 1 AS VARCHAR)")
case("cf02_index", lambda k: [len(x) for x in fonts.index(fonts._Cursor(b"\0\2\1\1\3\4abc"))] if k % 2 else fonts.index(fonts._Cursor(b"\0\1\5")), "CASE WHEN n_nationkey % 2 = 1 THEN '[2, 1]' ELSE 'InvalidData' END")
case("cf04_top_dictionary", lambda k: fonts.top_dictionary(_int(k) + bytes([17])) if k % 2 else fonts.top_dictionary(bytes([30])), f"CASE WHEN n_nationkey % 2 = 1 THEN '{{''char_strings'': ' || {K} || '}}' ELSE 'UnsupportedRealNumber' END".replace("{{", "{").replace("}}", "}"))
case("cf05_charset", lambda k: fonts.compact_font(compact([program("endchar")] * (k + 2))).encoding[32 + k], "CAST(n_nationkey + 1 AS VARCHAR)")
case("cf06_encoding", lambda k: fonts.STANDARD_ENCODING[33 + k], "CAST(n_nationkey + 2 AS VARCHAR)")
case("cf07_cursor", lambda k: len(fonts._Cursor(b"ab").take(k)), "CASE WHEN n_nationkey > 2 THEN 'EndOfData' ELSE CAST(n_nationkey AS VARCHAR) END")
case("cf08_charstring_decode", lambda k: fonts.char_string(bytes([255, 0, k, 128, 0]) + program("endchar")), f"'[' || {K} || ', ''endchar'']'")
case("cf09_render_glyph", lambda k: _path(fonts.compact_font(compact([program("endchar"), program(k, 2, "rmoveto", "endchar")])).outline(32)[0]), f"'move ' || {K} || ' 2;close'")
case("cf10_emit_curves", lambda k: _path(fonts.draw([k, 1, 2, 3, 4, 5, "rrcurveto"])[0]), f"'cubic ' || {K} || ' 1 ' || CAST(n_nationkey + 2 AS VARCHAR) || ' 4 ' || CAST(n_nationkey + 6 AS VARCHAR) || ' 9'")

# Charstring operators, by survey order: arguments with the key in front, and the path they give.
_DRAWN = {
    "rmoveto": ([2], "'move ' || k || ' 2'"), "hmoveto": ([], "'move ' || k || ' 0'"), "vmoveto": ([], "'move 0 ' || k"),
    "rcurveline": ([1, 2, 3, 4, 5, 6, 7], "'cubic ' || k || ' 1 ' || (k + 2) || ' 4 ' || (k + 6) || ' 9;line ' || (k + 12) || ' 16'"),
    "vvcurveto": ([1, 2, 3], "'cubic 0 ' || k || ' 1 ' || (k + 2) || ' 1 ' || (k + 5)"), "rlineto": ([2], "'line ' || k || ' 2'"), "hlineto": ([2], "'line ' || k || ' 0;line ' || k || ' 2'"), "vlineto": ([2], "'line 0 ' || k || ';line 2 ' || k"),
    "vhcurveto": ([1, 2, 3], "'cubic 0 ' || k || ' 1 ' || (k + 2) || ' 4 ' || (k + 2)"), "hvcurveto": ([1, 2, 3], "'cubic ' || k || ' 0 ' || (k + 1) || ' 2 ' || (k + 1) || ' 5'"),
    "rrcurveto": ([1, 2, 3, 4, 5], "'cubic ' || k || ' 1 ' || (k + 2) || ' 4 ' || (k + 6) || ' 9'"), }
_SURVEY_ORDER = (
    "rmoveto", "hmoveto", "rcurveline", "hstem", "vstemhm", "vstem", "vmoveto", "vvcurveto", "rlineto", "hlineto", "vlineto", "vhcurveto", "hvcurveto", "rrcurveto", "callsubr", "return", "endchar", "hstemhm", "hintmask", "cntrmask", "rlinecurve", "hhcurveto", "callgsubr",
    "and", "or", "not", "abs", "add", "sub", "div", "neg", "eq", "drop", "put", "get", "ifelse", "random", "mul", "sqrt", "dup", "exch", "index", "roll", "hflex", "flex", "hflex1", "flex1", "dotsection",
)
#: Subroutines: local 0 returns at once, local 1 moves by what is on the stack; global 0 adds one and moves.
_LOCAL = [program("return", 9, "hmoveto"), program("rmoveto", "return")]
_GLOBAL = [program(1, "add", "hmoveto")]
_RUN = {
    "hstem": (lambda k: (k, 10, "hstem", k, 2, "rmoveto"), "'move ' || k || ' 2'"), "vstem": (lambda k: (5, k, 3, "vstem", k, "hmoveto"), "'move ' || k || ' 0'"),
    "hstemhm": (lambda k: (k, 1, "hstemhm", 1, k, "rmoveto"), "'move 1 ' || k"), "vstemhm": (lambda k: (k, 1, 2, 3, "vstemhm", k, 4, "rmoveto"), "'move ' || k || ' 4'"),
    "hintmask": (lambda k: (1, 2, "hstemhm", 3, 4, "hintmask", b"\x15", k, 7, "rmoveto"), "'move ' || k || ' 7'"), "cntrmask": (lambda k: (1, 2, "hstemhm", "cntrmask", b"\x0e", k, 8, "rmoveto"), "'move ' || k || ' 8'"),
    "rlinecurve": (lambda k: (k, 1, 1, 2, 3, 4, 5, 6, "rlinecurve"), "'line ' || k || ' 1;cubic ' || (k + 1) || ' 3 ' || (k + 4) || ' 7 ' || (k + 9) || ' 13'"),
    "hhcurveto": (lambda k: (k, 1, 2, 3, "hhcurveto"), "'cubic ' || k || ' 0 ' || (k + 1) || ' 2 ' || (k + 4) || ' 2'"),
    "callsubr": (lambda k: (k, 2, -106, "callsubr"), "'move ' || k || ' 2'"), "callgsubr": (lambda k: (k, -107, "callgsubr"), "'move ' || (k + 1) || ' 0'"), "return": (lambda k: (-107, "callsubr", k, "vmoveto"), "'move 0 ' || k"),
    "and": (lambda k: (k, 1, "and", "hmoveto"), "'move ' || CASE WHEN k = 0 THEN 0 ELSE 1 END || ' 0'"), "or": (lambda k: (k, 0, "or", "hmoveto"), "'move ' || CASE WHEN k = 0 THEN 0 ELSE 1 END || ' 0'"), "not": (lambda k: (k, "not", "hmoveto"), "'move ' || CASE WHEN k = 0 THEN 1 ELSE 0 END || ' 0'"),
    "abs": (lambda k: (-k, "abs", "hmoveto"), "'move ' || k || ' 0'"), "add": (lambda k: (k, 5, "add", "hmoveto"), "'move ' || (k + 5) || ' 0'"), "sub": (lambda k: (5, k, "sub", "hmoveto"), "'move ' || (5 - k) || ' 0'"), "div": (lambda k: (2 * k, 2, "div", "hmoveto"), "'move ' || k || ' 0'"),
    "neg": (lambda k: (k, "neg", "hmoveto"), "'move ' || (0 - k) || ' 0'"), "eq": (lambda k: (k, 7, "eq", "hmoveto"), "'move ' || CASE WHEN k = 7 THEN 1 ELSE 0 END || ' 0'"), "drop": (lambda k: (k, 9, "drop", "hmoveto"), "'move ' || k || ' 0'"),
    "put": (lambda k: (k, 3, "put", 3, "get", "hmoveto"), "'move ' || k || ' 0'"), "get": (lambda k: (k, 1, "put", 2, "get", 1, "get", "rmoveto"), "'move 0 ' || k"), "ifelse": (lambda k: (1, 2, k, 10, "ifelse", "hmoveto"), "'move ' || CASE WHEN k <= 10 THEN 1 ELSE 2 END || ' 0'"),
    "random": (lambda k: ("random", 2, "mul", k, "add", "hmoveto"), "'move ' || (k + 1) || ' 0'"), "mul": (lambda k: (k, 3, "mul", "hmoveto"), "'move ' || (k * 3) || ' 0'"), "sqrt": (lambda k: (k, k, "mul", "sqrt", "hmoveto"), "'move ' || k || ' 0'"),
    "dup": (lambda k: (k, "dup", "rmoveto"), "'move ' || k || ' ' || k"), "exch": (lambda k: (k, 1, "exch", "rmoveto"), "'move 1 ' || k"), "index": (lambda k: (k, 5, 1, "index", "rmoveto"), "'move 5 ' || k"), "roll": (lambda k: (k, 1, 2, 3, 1, "roll", "rmoveto"), "'move ' || k || ' 1'"),
    "hflex": (lambda k: (k, 1, 2, 3, 4, 5, 6, "hflex"), "'cubic ' || k || ' 0 ' || (k + 1) || ' 2 ' || (k + 4) || ' 2;cubic ' || (k + 8) || ' 2 ' || (k + 13) || ' 0 ' || (k + 19) || ' 0'"),
    "flex": (lambda k: (k, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 50, "flex"), "'cubic ' || k || ' 1 ' || (k + 1) || ' 3 ' || (k + 4) || ' 7;cubic ' || (k + 9) || ' 13 ' || (k + 16) || ' 21 ' || (k + 25) || ' 31'"),
    "hflex1": (lambda k: (k, 1, 2, 3, 4, 5, 6, 7, 8, "hflex1"), "'cubic ' || k || ' 1 ' || (k + 2) || ' 4 ' || (k + 6) || ' 4;cubic ' || (k + 11) || ' 4 ' || (k + 17) || ' 11 ' || (k + 25) || ' 0'"),
    "flex1": (lambda k: (k, 0, 1, 0, 1, 0, 1, 0, 1, 1, 9, "flex1"), "'cubic ' || k || ' 0 ' || (k + 1) || ' 0 ' || (k + 2) || ' 0;cubic ' || (k + 3) || ' 0 ' || (k + 4) || ' 1 ' || (k + 13) || ' 0'"),
    "endchar": (lambda k: (k, "hmoveto", "endchar", 9, "hmoveto"), "'move ' || k || ' 0;close'"),
    "dotsection": (lambda k: ("dotsection", k, "hmoveto"), "'move ' || k || ' 0'"),
}


def _keyed(sql: str) -> str:
    """``k`` in an SQL text expression, outside its quotes, as the nation's key."""
    return "'".join(part if i % 2 else re.sub(r"\bk\b", "n_nationkey", part) for i, part in enumerate(sql.split("'")))


for _n, _op in enumerate(_SURVEY_ORDER, 1):
    if _op in _DRAWN:
        _args, _sql = _DRAWN[_op]
        _items = lambda k, op=_op, args=tuple(_args): (k, *args, op)
    else:
        _items, _sql = _RUN[_op]
    case(f"ch{_n:02d}_{_op}", lambda k, items=_items: _path(fonts.glyph_path(program(*items(k)), _LOCAL, _GLOBAL)[0]), _keyed(_sql))

# Operators that ``compat`` leaves out.


def _painted(c: canvas.Canvas) -> str:
    return ";".join(f"{x.kind} {x.fill_rule or '-'} {_num(x.path[0][1][0])} {x.path[-1][0]}" for x in c.commands)


def _places(c: canvas.Canvas) -> str:
    return ";".join(f"{_num(round(g.info['x'], 3))} {_num(round(g.info['y'], 3))}" for g in c.commands if g.kind == "glyph")


def _text(body: bytes):
    return lambda k: _places(_fonted(_simple, b"BT /F1 10 Tf " + body.replace(b"K", b"%d" % k) + b" ET")(k))


def _inline(body: bytes, k: int, compat: bool = False) -> str:
    c = _canvas(body.replace(b"K", b"%d" % k), compat=compat)
    return ";".join(f"{x.info['width']} {x.info['height']} {x.info['color_space']} {x.info['bytes']}" for x in c.commands) or _first_error(c)


def _shaded(k: int) -> str:
    axial = {"ShadingType": 2, "ColorSpace": Name("DeviceRGB"), "Coords": [0, 0, k, 1], "Function": {"FunctionType": 2, "N": 1}}
    c = _canvas(b"/S sh", lambda w: {"Shading": {"S": axial}}).commands[0]
    return " ".join([c.kind, c.shader["type"], *map(_num, c.shader["coords"])])


def _skipped(c: canvas.Canvas) -> list:
    return [*((n, e.kind) for n, e in c.errors), _num(c.commands[0].path[1][1][0])]


case("canvas_fillandstrokepathnonzero", lambda k: _painted(_canvas(b"%d 0 9 9 re B" % k)), _keyed("'fill nonzero ' || k || ' close;stroke - ' || k || ' close'"))
case("canvas_fillandstrokepathevenodd", lambda k: _painted(_canvas(b"%d 0 m 1 1 l B*" % k)), _keyed("'fill even_odd ' || k || ' line;stroke - ' || k || ' line'"))
case("canvas_closefillandstrokepathnonzero", lambda k: _painted(_canvas(b"%d 0 m 1 1 l b" % k)), _keyed("'fill nonzero ' || k || ' close;stroke - ' || k || ' close'"))
case("canvas_closefillandstrokepathevenodd", lambda k: _painted(_canvas(b"%d 0 m 1 1 l b*" % k)), _keyed("'fill even_odd ' || k || ' close;stroke - ' || k || ' close'"))
case("canvas_movetonextline", _text(b"7 TL K 700 Td T* (Z) Tj"), _keyed("k || ' 99'"))
case("canvas_movetextpositionandsetleading", _text(b"K -5 TD T* (Z) Tj"), _keyed("k || ' 802'"))
case("canvas_setleading", _text(b"K TL T* T* (Z) Tj"), _keyed("'0 ' || (792 + 2 * k)"))
case("canvas_movenextlineshowtext", _text(b"5 TL K 0 Td (Z) '"), _keyed("k || ' 797'"))
case("canvas_setspacingmoveshowtext", _text(b'0 TL 3 K (ZZ Z) "'), _keyed("'0 792;' || k || ' 792;' || (2 * k) || ' 792;' || (3 * k + 3) || ' 792'"))
case("canvas_setrenderingmode", lambda k: "".join(c.kind[0] for c in _fonted(_outlined, b"BT /F1 100 Tf %d Tr (B) Tj ET" % (k % 8))(k).commands if c.kind != "glyph"), "['f', 's', 'fs', '', 'ft', 'st', 'fst', 't'][1 + n_nationkey % 8]")
case("canvas_paintshading", _shaded, _keyed("'shade axial 0 0 ' || k || ' 1'"))
case("canvas_inlineimage", lambda k: _inline(b"BI /W 1K /H 2 /BPC 8 /CS /G ID dataK EI", k), _keyed("'1' || k || ' 2 DeviceGray ' || (4 + length(CAST(k AS VARCHAR)))"))
case("canvas_glyphwidth", lambda k: f"{_first_error(c := _canvas(b'%d 0 0 0 5 5 d1 %d 0 d0 0 0 %d 1 re f' % (k, k, k)))} {_num(c.commands[0].path[1][1][0])}", _keyed("'none ' || k"))
case("canvas_plaincolor", lambda k: " ".join(_num(x) for x in _canvas(b"1 0 %d sc 0 0 1 1 re F" % (k % 2)).commands[0].color), _keyed("'1 0 ' || (k % 2) || ' 1'"))
case("canvas_unknownoperator", lambda k: _skipped(_canvas(b"q %d zz BX 1 yy EX Q xx 0 0 %d 1 re f" % (k, k))), _keyed("'[(1, ''UnknownOperator''), (6, ''UnknownOperator''), ''' || k || ''']'"))
case("canvas_markedpoints", lambda k: [len(c.errors) + len(c.commands) for c in [_canvas(b"/T MP /T << /K %d >> DP /RelativeColorimetric ri " % k + b"0 0 1 1 re f " * k)]][0], K)

# What ``compat`` keeps, beside what is done otherwise.


def _both(run: Callable[[int, bool], object]):
    return lambda k: f"{run(k, True)} | {run(k, False)}"


def _ops(body: bytes):
    def run(k: int, compat: bool) -> str:
        found, error = content.parse(body.replace(b"K", b"%d" % k), compat)
        return " ".join([o.op + "".join(":" + _num(x) for x in o.nums) for o in found] + ([error.kind] if error else []))

    return _both(run)


def _in_form(k: int, compat: bool) -> str:
    """Pages and forms that name the same state differently: whose is taken, and whether a page's is found from a form."""

    def extend(w: Writer) -> dict:
        form = w.stream({"Subtype": Name("Form"), "BBox": [0, 0, 9, 9], "Resources": {"ExtGState": {"S": {"LW": k + 100}}}}, b"/S gs 0 0 m 1 1 l S /T gs")
        return {"XObject": {"F": form}, "ExtGState": {"S": {"LW": k}, "T": {"LW": 1}}}

    c = _canvas(b"/F Do", extend, compat)
    return f"{_num(c.commands[0].line_width)} {_first_error(c)}"


def _patterns(k: int, compat: bool) -> str:
    c = _canvas(b"0 0 1 RG 1 0 0 rg /A scn 0 0 %d 1 re f 0 0 m 1 1 l S" % k, _objects(k), compat)
    return " ".join(f"pattern {_num(x.shader['coords'][2])}" if x.shader else "plain" for x in c.commands)


case("q01_silent_end", _ops(b"K w (a) ' q"), _keyed("'w:' || k || ' | w:' || k || ' '' q'"))
case("q02_color_operand_lost", _ops(b"0.5 K 1 scn"), _keyed("'scn:' || k || ':1 | scn:0.5:' || k || ':1'"))
case("q03_literals_as_operators", _ops(b"K w true q"), _keyed("'w:' || k || ' UnknownOperator | w:' || k || ' IncorrectOperandCount'"))
case("q04_property_name", _ops(b"K w /T /PK BDC q"), _keyed("'w:' || k || ' InvalidOperandType | w:' || k || ' BDC q'"))
case("q05_inline_image", _both(lambda k, compat: _inline(b"BI /W 1K /H 2 /BPC 8 ID x EI", k, compat)), _keyed("'Panic | 1' || k || ' 2 None 1'"))
case("q06_image_brackets", _both(lambda k, compat: f"{_first_error(c := _canvas(b'1 0 0 0 5 5 d1 0 0 %d 1 re f' % k, compat=compat))} {_num(c.commands[0].path[1][1][0])}"), _keyed("'Panic ' || k || ' | none ' || k"))
case("q07_absent_operators", _ops(b"K w F K 0 d0 q"), _keyed("'w:' || k || ' UnknownOperator | w:' || k || ' F d0:' || k || ':0 q'"))
case("q08_two_percent_signs", _ops(b"K w %%x\nq"), _keyed("'w:' || k || ' InvalidKeyword | w:' || k || ' q'"))
case("q09_clip_is_reset", _both(lambda k, compat: " ".join(c.kind + (" " + _num(c.path[1][1][0]) if c.path else "") for c in _canvas(b"0 0 %d 1 re W n" % k, compat=compat).commands)), _keyed("'set_clip ' || k || ' reset_clip | set_clip ' || k"))
case("q10_runs_start_again", _both(lambda k, compat: _places(_fonted(_simple, b"BT /F1 10 Tf %d Tc (Z) Tj (Z) Tj ET" % k, compat)(k))), _keyed("'0 792;0 792 | 0 792;' || k || ' 792'"))
case("q11_offset_outside", _both(lambda k, compat: _places(_fonted(_simple, b"BT /F1 10 Tf 2 0 0 2 0 0 Tm %d 0 Td (Z) Tj ET" % k, compat)(k))), _keyed("k || ' 792 | ' || (2 * k) || ' 792'"))
case("q12_one_pattern", _both(_patterns), _keyed("'pattern ' || k || ' pattern ' || k || ' | pattern ' || k || ' plain'"))
case("q13_whose_resource", _both(_in_form), _keyed("(k + 100) || ' ResourceNotFound | ' || (k + 100) || ' none'"))
case("q14_empty_stack", _both(lambda k, compat: [n for n, _ in _canvas(b"Q " * (k + 1) + b"1 w", compat=compat).errors]), _keyed("'[' || (k + 1) || '] | [' || (k + 1) || ']'"))
case("q15_line_style", _both(lambda k, compat: [_num(c.line_width) for c in _canvas(b"2 0 0 2 0 0 cm %d w 1 J 1 j [3 1] 0 d 0 0 m 1 1 l S" % k, compat=compat).commands]), _keyed("'[''' || k || '''] | [''' || k || ''']'"))

case("k03_recording_sink", lambda k: [(c.kind, _num(c.path[-2][1][0])) for c in _canvas(b"0 0 %d 1 re f 0 0 m %d 1 l h S" % (k, k)).commands], f"'[(''fill'', ''0''), (''stroke'', ''' || {K} || ''')]'")
case("p11_odd_hex", lambda k: bytes(parse_value(b"<%X>" % (k % 16))).hex(), "lower(CASE WHEN n_nationkey % 16 < 10 THEN CAST(n_nationkey % 16 AS VARCHAR) ELSE chr(CAST(87 + n_nationkey % 16 AS INTEGER)) END || '0')")
case("d17_text_elements", lambda k: content.parse(b"[(a) %d <62>] TJ" % k)[0][0].elems, f"'[(''text'', b''a'', None), (''adjustment'', None, ' || {K} || '.0), (''hex'', b''b'', None)]'")
case("x03_as_string", lambda k: [D.text(v) for v in (Name(f"n{k}"), Text(b"t"), Hex(b"h"))], f"'[''n' || {K} || ''', ''t'', ''h'']'")
