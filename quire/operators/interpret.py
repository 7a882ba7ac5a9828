"""Draw commands, glyphs, fonts and widths of documents as tables."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import DataFrame

from quire.functions import fonts
from quire.operators import pdf_document as D
from quire.operators.canvas import page_commands
from quire.sources.pdf import ERROR, error_struct, per_document
from quire.sources.pdf_syntax import PdfError, Ref

COMMANDS = f"page_index int, cmd_ord int, kind string, path array<struct<verb:string,pts:array<float>>>, fill_rule string, color struct<r:float,g:float,b:float,a:float>, line_width float, shader string, blend string, info string, nth int, {ERROR}"
COMMAND_COUNTS = f"page_index int, kind string, n long, {ERROR}"
FONTS = f"page_index int, name string, subtype string, base_font string, encoding string, default_width float, has_program boolean, {ERROR}"
WIDTHS = f"page_index int, name string, cid_start int, cid_end int, widths array<float>, {ERROR}"
CMAPS = f"page_index int, name string, code long, ch string, {ERROR}"
OUTLINES = f"page_index int, name string, code int, path array<struct<verb:string,pts:array<float>>>, {ERROR}"


def _path(path: list) -> list[dict]:
    return [{"verb": verb, "pts": pts} for verb, pts in path]


#: A command's columns but for its place and kind.
_BUILD = {
    "path": lambda c: _path(c.path),
    "fill_rule": lambda c: c.fill_rule,
    "color": lambda c: dict(zip("rgba", c.color, strict=True)) if c.color else None,
    "line_width": lambda c: c.line_width,
    "shader": lambda c: json.dumps(c.shader) if c.shader else None,
    "blend": lambda c: c.blend,
    "info": lambda c: json.dumps(c.info) if c.info else None,
}


def _commands(data: bytes, options: dict) -> Iterator[dict]:
    columns, kinds = options["columns"], options.get("kinds")
    plain = columns is not None and set(columns) <= {"page_index", "kind"}
    # Where nobody asks for glyphs' rows, those of a run are counted.
    for i, canvas in page_commands(data, options | {"bare": plain or (kinds is not None and "glyph" not in kinds)}):
        if plain:
            for kind, same in groupby(canvas.commands, key=lambda c: c.kind):
                if kinds is None or kind in kinds:
                    yield sum(c.count for c in same), {"page_index": i, "kind": kind}
            canvas.commands = []
        n, nth = 0, Counter()
        for c in canvas.commands:
            if kinds is None or c.kind in kinds:
                row = {"page_index": i, "cmd_ord": n, "kind": c.kind, "nth": nth[c.kind]}
                yield row | {k: build(c) for k, build in _BUILD.items() if columns is None or k in columns}
            n += c.count
            nth[c.kind] += c.count
        for n, e in canvas.errors:
            yield {"page_index": i, "cmd_ord": None, "_error": error_struct(e) | {"offset": n}}


def draw_commands(files: DataFrame, compat: bool = False, columns: list[str] | None = None, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """The draw commands of every page in order; an operator that failed is an ``_error`` row with its ordinal as offset.

    Where ``columns`` asks for kinds only, paths and texts are not built. With ``kinds`` there are rows
    of these and of faults alone. ``nth`` counts the commands of a kind that stand before it on the page.
    """
    only = {} if kinds is None else {"kinds": kinds}
    return per_document(files, COMMANDS, _commands, columns, compat=compat, **only)


def _command_counts(data: bytes, options: dict) -> Iterator[dict]:
    for i, canvas in page_commands(data, options | {"bare": True}):
        counts = Counter()
        for c in canvas.commands:
            counts[c.kind] += c.count
        for kind, n in counts.items():
            yield {"page_index": i, "kind": kind, "n": n}
        for n, e in canvas.errors:
            yield {"page_index": i, "_error": error_struct(e) | {"offset": n}}


def command_counts(files: DataFrame, compat: bool = False) -> DataFrame:
    """How many draw commands of each kind a page has; faults are rows as they are in ``draw_commands``."""
    return per_document(files, COMMAND_COUNTS, _command_counts, compat=compat)


def _each_font(data: bytes, options: dict) -> Iterator[tuple[dict, fonts.Font | None]]:
    document = D.load(data, options["strict"])
    read: dict[int, fonts.Font | PdfError] = {}  # pages share fonts
    for i, (_, page) in enumerate(document.pages()):
        try:
            found = D.resources(document, page).get("Font", {})
        except PdfError as e:
            yield {"page_index": i, "_error": error_struct(e)}, None
            continue
        for name, value in found.items():
            row, font = {"page_index": i, "name": name}, read.get(value.num) if isinstance(value, Ref) else None
            if font is None:
                try:
                    font = fonts.read_font(document, value)
                except PdfError as e:
                    font = e
                if isinstance(value, Ref):
                    read[value.num] = font
            if isinstance(font, PdfError):
                yield row | {"_error": error_struct(font)}, None
            else:
                yield row, font


def _fonts(data, options):
    for row, font in _each_font(data, options):
        yield row if font is None else row | {"subtype": font.kind, "base_font": font.base_font, "encoding": font.encoding, "default_width": font.default_width, "has_program": font.program is not None}


def _widths(data, options):
    for row, font in _each_font(data, options):
        if font is None:
            yield row
            continue
        for start, end, widths in font.runs:
            yield row | {"cid_start": start, "cid_end": end, "widths": widths}
        if font.widths:
            codes = sorted(font.widths)
            yield row | {"cid_start": codes[0], "cid_end": codes[-1], "widths": [font.widths[c] for c in codes]}


def _cmaps(data, options):
    for row, font in _each_font(data, options):
        if font is None:
            yield row
            continue
        for code, ch in sorted(font.cmap.items()):
            yield row | {"code": code, "ch": ch}


def _outlines(data, options):
    for row, font in _each_font(data, options):
        if font is None:
            yield row
        elif isinstance(font.program, fonts.CompactFont):
            for code in sorted(font.program.encoding):
                found = font.program.outline(code)
                if found and (found[0] or found[1]):
                    yield row | {"code": code, "path": _path(found[0]), "_error": error_struct(found[1]) if found[1] else None}


def font_table(files: DataFrame) -> DataFrame:
    return per_document(files, FONTS, _fonts)


def glyph_widths(files: DataFrame) -> DataFrame:
    return per_document(files, WIDTHS, _widths)


def character_maps(files: DataFrame) -> DataFrame:
    return per_document(files, CMAPS, _cmaps)


def glyph_outlines(files: DataFrame) -> DataFrame:
    return per_document(files, OUTLINES, _outlines)
