"""Writes small PDF files: inputs for tests, benchmarks and round-trip queries."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Mapping

from quire.sources.pdf_syntax import Hex, Name, Ref, Text


def dump(value: object) -> bytes:
    """A value as PDF syntax."""
    if value is None:
        return b"null"
    if isinstance(value, bool):
        return b"true" if value else b"false"
    if isinstance(value, Ref):
        return b"%d 0 R" % value.num
    if isinstance(value, Name):
        if value.isascii() and value.isalnum():
            return b"/" + value.encode()
        return b"/" + b"".join(bytes([b]) if 33 <= b <= 126 and chr(b) not in "()<>[]{}/%#" else b"#%02X" % b for b in value.encode("latin-1"))
    if isinstance(value, Text):
        return b"(" + value.raw + b")"
    if isinstance(value, (Hex, bytes)):
        return b"<" + value.hex().upper().encode() + b">"
    if isinstance(value, int):
        return str(value).encode()
    if isinstance(value, float):
        return f"{value:.10f}".rstrip("0").encode() + (b"0" if value == int(value) else b"")
    if isinstance(value, Mapping):
        return b"<< " + b" ".join(dump(Name(k)) + b" " + dump(v) for k, v in value.items()) + b" >>"
    if isinstance(value, list) and all(type(v) is int for v in value):
        return b"[" + " ".join(map(str, value)).encode() + b"]"
    if isinstance(value, Iterable):
        return b"[" + b" ".join(dump(v) for v in value) + b"]"
    raise TypeError(type(value))


class Writer:
    """Collects objects and lays them out with a cross-reference table."""

    def __init__(self) -> None:
        self.bodies: dict[int, bytes] = {}
        self.last = 0

    def number(self, num: int | None = None) -> int:
        """``num``, or the number after the largest so far."""
        if num is None:
            num = self.last + 1
            while num in self.bodies:
                num += 1
        self.last = max(self.last, num)
        return num

    def add(self, value: object, num: int | None = None) -> Ref:
        num = self.number(num)
        self.bodies[num] = dump(value)
        return Ref(num)

    def stream(self, entries: Mapping, data: bytes, compress: bool = False, num: int | None = None) -> Ref:
        entries = dict(entries)
        if compress:
            data = zlib.compress(data)
            entries["Filter"] = Name("FlateDecode")
        entries["Length"] = len(data)
        num = self.number(num)
        self.bodies[num] = dump(entries) + b"\nstream\n" + data + b"\nendstream"
        return Ref(num)

    def finish(self, root: Ref) -> bytes:
        out, offsets = bytearray(b"%PDF-1.7\n"), {}
        for num, body in sorted(self.bodies.items()):
            offsets[num] = len(out)
            out += b"%d 0 obj\n" % num + body + b"\nendobj\n"
        start, count = len(out), max(offsets, default=0) + 1
        out += b"xref\n0 %d\n0000000000 65535 f \n" % count
        for num in range(1, count):
            out += b"%010d 00000 %s \n" % (offsets.get(num, 0), b"n" if num in offsets else b"f")
        out += b"trailer\n" + dump({"Root": root, "Size": count}) + b"\nstartxref\n%d\n%%%%EOF" % start
        return bytes(out)


def document(pages: Iterable[bytes], resources: Mapping | None = None, compress: bool = True, extend=None) -> bytes:
    """A file with one page per content stream; ``extend(writer)`` may add objects and return resources."""
    writer = Writer()
    extra = extend(writer) if extend else {}
    own = dict(resources or {}) | dict(extra or {})
    tree = writer.number()
    kids = []
    for content in pages:
        body = writer.stream({}, content, compress)
        kids.append(writer.add({"Type": Name("Page"), "Parent": Ref(tree), "MediaBox": [0, 0, 612, 792], "Contents": body, "Resources": own}))
    writer.add({"Type": Name("Pages"), "Kids": kids, "Count": len(kids)}, tree)
    return writer.finish(writer.add({"Type": Name("Catalog"), "Pages": Ref(tree)}))


def text_page(lines: Iterable[str], font: str = "F1", size: int = 12) -> bytes:
    """A content stream that shows lines of text, each in a rectangle."""
    out = [b"q", b"0.5 w"]
    for i, line in enumerate(lines):
        y = 760 - 14 * (i % 50)
        shown = line.encode("utf-8", "replace").translate(None, b"()\\")
        out += [b"10 %d 500 12 re" % (y - 2), b"S", b"BT", b"/%s %d Tf" % (font.encode(), size), b"1 0 0 1 12 %d Tm" % y, b"(" + shown + b") Tj", b"ET"]
    out.append(b"Q")
    return b"\n".join(out)


def tiny_font() -> bytes:
    """Glyph 1: a triangle; glyph 2: a circle of control points; glyph 3: glyph 1 moved by (10, 20). A is glyph 1."""
    triangle = struct.pack(">hhhhh", 1, 0, 0, 100, 100) + struct.pack(">H", 2) + b"\0\0" + bytes([1, 1, 1]) + struct.pack(">hhh", 0, 100, -50) + struct.pack(">hhh", 0, 0, 100)
    circle = struct.pack(">hhhhh", 1, 0, 0, 100, 100) + struct.pack(">H", 3) + b"\0\0" + bytes([0] * 4) + struct.pack(">hhhh", 0, 100, 0, -100) + struct.pack(">hhhh", 0, 0, 100, 0)
    moved = struct.pack(">hhhhh", -1, 0, 0, 0, 0) + struct.pack(">HHbb", 2, 1, 10, 20)
    glyphs = [b"", triangle, circle, moved]
    glyphs = [g + b"\0" * (len(g) % 2) for g in glyphs]
    offsets = [sum(map(len, glyphs[:i])) // 2 for i in range(5)]
    cmap = struct.pack(">HH", 0, 1) + struct.pack(">HHI", 3, 1, 12) + struct.pack(">HHHHH", 6, 12, 0, 65, 1) + struct.pack(">H", 1)
    head = bytearray(54)
    head[18:20] = struct.pack(">H", 100)
    tables = {"cmap": cmap, "glyf": b"".join(glyphs), "head": bytes(head), "loca": struct.pack(">5H", *offsets), "maxp": struct.pack(">IH", 0x10000, 4)}
    at, directory, body = 12 + 16 * len(tables), b"", b""
    for tag, data in tables.items():
        directory += struct.pack(">4sIII", tag.encode(), 0, at + len(body), len(data))
        body += data + b"\0" * (-len(data) % 4)
    return struct.pack(">IHHHH", 0x10000, len(tables), 0, 0, 0) + directory + body
