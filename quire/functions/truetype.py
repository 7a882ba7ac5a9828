"""Glyph outlines of TrueType font files (the ``glyf`` flavour)."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

from quire.functions.fonts import FontError

MAX_PARTS = 8


@dataclass
class TrueTypeFont:
    """Tables of one font file; outlines and character lookups are read on demand."""

    data: bytes
    tables: dict[str, tuple[int, int]]
    units: int
    long_offsets: bool
    glyphs: int
    characters: dict[int, int] = field(default_factory=dict)

    def table(self, tag: str) -> bytes:
        if tag not in self.tables:
            raise FontError("MissingTable", tag)
        at, size = self.tables[tag]
        return self.data[at : at + size]

    def _glyph(self, gid: int) -> bytes:
        if not 0 <= gid < self.glyphs:
            raise FontError("GlyphOutOfRange", str(gid))
        loca = self.table("loca")
        if self.long_offsets:
            a, b = struct.unpack_from(">II", loca, 4 * gid)
        else:
            a, b = (2 * x for x in struct.unpack_from(">HH", loca, 2 * gid))
        return self.table("glyf")[a:b]

    def outline(self, gid: int, depth: int = 0) -> list[tuple[str, list[float]]]:
        """Segments (move, line, quad, close) in font units; an empty glyph has none."""
        try:
            data = self._glyph(gid)
            if not data:
                return []
            contours = struct.unpack_from(">h", data)[0]
            return _contours(data, contours) if contours >= 0 else self._composite(data, depth)
        except (struct.error, IndexError):
            raise FontError("EndOfData", f"glyph {gid}") from None

    def _composite(self, data: bytes, depth: int) -> list[tuple[str, list[float]]]:
        if depth >= MAX_PARTS:
            raise FontError("Cycle", "composite glyph")
        at, out = 10, []
        while True:
            flags, gid = struct.unpack_from(">HH", data, at)
            at += 4
            dx, dy = struct.unpack_from(">hh" if flags & 1 else ">bb", data, at)
            at += 4 if flags & 1 else 2
            a, b, c, d = 1.0, 0.0, 0.0, 1.0
            count = 1 if flags & 8 else 2 if flags & 0x40 else 4 if flags & 0x80 else 0
            values = [v / 16384 for v in struct.unpack_from(f">{count}h", data, at)]
            at += 2 * count
            if count == 1:
                a = d = values[0]
            elif count == 2:
                a, d = values
            elif count == 4:
                a, b, c, d = values
            if not flags & 2:  # the part is placed by matching points
                dx = dy = 0
            for verb, pts in self.outline(gid, depth + 1):
                moved = [v for x, y in zip(pts[::2], pts[1::2], strict=True) for v in (a * x + c * y + dx, b * x + d * y + dy)]
                out.append((verb, moved))
            if not flags & 0x20:
                return out


def _contours(data: bytes, count: int) -> list[tuple[str, list[float]]]:
    ends = struct.unpack_from(f">{count}H", data, 10)
    points = ends[-1] + 1 if ends else 0
    at = 10 + 2 * count
    at += 2 + struct.unpack_from(">H", data, at)[0]
    flags: list[int] = []
    while len(flags) < points:
        flag = data[at]
        at += 1
        repeat = 1
        if flag & 8:
            repeat += data[at]
            at += 1
        flags += [flag] * repeat
    axes = []
    for short, same in ((2, 16), (4, 32)):
        value, out = 0, []
        for flag in flags[:points]:
            if flag & short:
                value += data[at] if flag & same else -data[at]
                at += 1
            elif not flag & same:
                value += struct.unpack_from(">h", data, at)[0]
                at += 2
            out.append(float(value))
        axes.append(out)
    path, first = [], 0
    for end in ends:
        own = [(axes[0][i], axes[1][i], bool(flags[i] & 1)) for i in range(first, end + 1)]
        path += _contour(own)
        first = end + 1
    return path


def _contour(points: list[tuple[float, float, bool]]) -> list[tuple[str, list[float]]]:
    """Two neighbouring control points have an implied point between them."""
    if not points:
        return []
    full = []
    for i, (x, y, on) in enumerate(points):
        px, py, prior = points[i - 1]
        if not on and not prior and len(points) > 1:
            full.append(((px + x) / 2, (py + y) / 2, True))
        full.append((x, y, on))
    start = next((i for i, p in enumerate(full) if p[2]), None)
    if start is None:
        return []
    full = full[start:] + full[: start + 1]
    out, i = [("move", [full[0][0], full[0][1]])], 1
    while i < len(full):
        x, y, on = full[i]
        if on:
            out.append(("line", [x, y]))
            i += 1
        else:
            out.append(("quad", [x, y, full[i + 1][0], full[i + 1][1]]))
            i += 2
    return [*out, ("close", [])]


def _characters(data: bytes) -> dict[int, int]:
    """code point -> glyph from the first Unicode subtable of a format that is read (0, 4, 6, 12)."""
    count = struct.unpack_from(">H", data, 2)[0]
    records = [struct.unpack_from(">HHI", data, 4 + 8 * i) for i in range(count)]
    for platform, _, at in sorted(records, key=lambda r: (r[0] not in (0, 3), -r[1])):
        form = struct.unpack_from(">H", data, at)[0]
        out: dict[int, int] = {}
        if form == 0:
            out = {c: g for c, g in enumerate(data[at + 6 : at + 262]) if g}
        elif form == 4:
            n = struct.unpack_from(">H", data, at + 6)[0] // 2
            ends, starts, deltas, offsets = (struct.unpack_from(f">{n}H", data, at + 14 + 2 * n * k + (2 if k else 0)) for k in range(4))
            for k in range(n):
                for c in range(starts[k], min(ends[k], 0xFFFE) + 1):
                    if offsets[k]:
                        spot = at + 16 + 6 * n + 2 * k + offsets[k] + 2 * (c - starts[k])
                        g = struct.unpack_from(">H", data, spot)[0] if spot + 2 <= len(data) else 0
                        g = (g + deltas[k]) & 0xFFFF if g else 0
                    else:
                        g = (c + deltas[k]) & 0xFFFF
                    if g:
                        out[c] = g
        elif form == 6:
            first, n = struct.unpack_from(">HH", data, at + 6)
            out = {first + i: g for i, g in enumerate(struct.unpack_from(f">{n}H", data, at + 10)) if g}
        elif form == 12:
            n = struct.unpack_from(">I", data, at + 12)[0]
            for k in range(min(n, 65536)):
                a, b, g = struct.unpack_from(">III", data, at + 16 + 12 * k)
                out |= {c: g + c - a for c in range(a, min(b, 0x10FFFF) + 1)}
        if out:
            return out
    return {}


def true_type(data: bytes) -> TrueTypeFont:
    """Reads the directory, header, glyph count and character map."""
    try:
        count = struct.unpack_from(">H", data, 4)[0]
        tables = {}
        for i in range(count):
            tag, _, at, size = struct.unpack_from(">4sIII", data, 12 + 16 * i)
            tables[tag.decode("latin-1")] = (at, size)
        font = TrueTypeFont(data, tables, 1000, False, 0)
        head = font.table("head")
        font.units = struct.unpack_from(">H", head, 18)[0] or 1000
        font.long_offsets = bool(struct.unpack_from(">h", head, 50)[0])
        font.glyphs = struct.unpack_from(">H", font.table("maxp"), 4)[0]
        if "cmap" in tables:
            font.characters = _characters(font.table("cmap"))
        return font
    except struct.error:
        raise FontError("EndOfData", "TrueType header") from None
