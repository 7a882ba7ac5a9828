"""The graphics-state machine: a page's operators become ordered draw commands.

Plain Python per page, run by the task that has the document. Commands have a
kind, a device-space path and the paint that was in force. An operator that
the canvas does not implement gives an error row and, unless ``strict``, the
page goes on.

``compat`` keeps the quirks of the conformance cases: operators that those
leave out are ``NotImplemented``, ``n`` resets the clip it was meant to leave,
text offsets and form matrices apply outside the line matrix, glyph runs do
not move the text matrix, and one slot holds the pattern of fills and strokes.
Otherwise every operator does what the format says; unknown ones are error rows
outside a compatibility section and nothing inside it.
"""

from __future__ import annotations

import copy
import math
import operator
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

from quire.functions import fonts
from quire.functions.truetype import TrueTypeFont
from quire.operators import pdf_document as D
from quire.sources import content
from quire.sources.pdf_syntax import Name, PdfError, Stream

IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
MAX_FORMS = 16

# Blend modes.
BLEND_MODES = ("Normal", "Multiply", "Screen", "Overlay", "Darken", "Lighten", "ColorDodge", "ColorBurn", "HardLight", "SoftLight", "Difference", "Exclusion", "Hue", "Saturation", "Color", "Luminosity")
EXT_KEYS = frozenset(("Type", "LW", "LC", "LJ", "ML", "D", "RI", "OP", "op", "OPM", "Font", "BM", "SMask", "CA", "ca", "SA"))
COLOR_SPACES = frozenset(("DeviceGray", "DeviceRGB", "DeviceCMYK"))
# Operators that draw nothing and change no state; those of paths, paint and text.
_NOTHING = frozenset(("BMC", "BDC", "EMC", "MP", "DP", "ET", "d", "i", "ri", "d0", "d1"))
_PATH, _PAINT = frozenset(("m", "l", "c", "v", "y", "h", "re")), frozenset(("S", "s", "f", "F", "f*", "B", "B*", "b", "b*"))
_TEXT = frozenset(("BT", "Td", "TD", "T*", "TL", "Tr", "'", '"', "Tm", "Tf", "Tj", "TJ"))
NOT_IMPLEMENTED = frozenset(("B", "B*", "b", "b*", "sh", "TD", "T*", "'", '"', "TL", "Tr", "BI", "EI", "ID", "d1"))


def multiply(m: tuple, n: tuple) -> tuple:
    """``m`` first, then ``n``; (a, b, c, d, e, f) as in the file format."""
    return (
        m[0] * n[0] + m[1] * n[2],
        m[0] * n[1] + m[1] * n[3],
        m[2] * n[0] + m[3] * n[2],
        m[2] * n[1] + m[3] * n[3],
        m[4] * n[0] + m[5] * n[2] + n[4],
        m[4] * n[1] + m[5] * n[3] + n[5],
    )


def apply(m: tuple, points: list[float]) -> list[float]:
    if len(points) == 2:
        x, y = points
        return [m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]]
    out = []
    for x, y in zip(points[::2], points[1::2], strict=True):
        out += [m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]]
    return out


def move_path(path: list, m: tuple) -> list:
    return [(verb, apply(m, pts)) for verb, pts in path]


def cmyk(c: float, m: float, y: float, k: float) -> tuple:
    return tuple((1 - v) * (1 - k) for v in (c, m, y))


@dataclass
class State:
    ctm: tuple
    fill: tuple = (0.0, 0.0, 0.0, 1.0)
    stroke: tuple = (0.0, 0.0, 0.0, 1.0)
    line_width: float = 1.0
    cap: int = 0
    join: int = 0
    miter: float = 10.0
    blend: str | None = None
    pattern: str | None = None
    clip: list | None = None
    font: fonts.Font | None = None
    size: float = 0.0
    spacing: float = 0.0
    word_spacing: float = 0.0
    scaling: float = 100.0
    rise: float = 0.0
    leading: float = 0.0
    rendering: int = 0
    stroke_pattern: str | None = None


@dataclass
class Command:
    kind: str
    path: list = field(default_factory=list)
    fill_rule: str | None = None
    color: tuple | None = None
    line_width: float | None = None
    shader: dict | None = None
    blend: str | None = None
    info: dict | None = None
    count: int = 1


class _Moves(dict):
    """What ``of`` makes of a code, made once."""

    def __init__(self, of: Callable[[int], float]):
        super().__init__()
        self.of = of

    def __missing__(self, code: int) -> float:
        self[code] = out = self.of(code)
        return out


def unimplemented(op: str) -> PdfError:
    return PdfError("NotImplemented", op, stage="canvas")


class Canvas:
    """Runs operators over a stack of states; ``commands`` collects the result.

    With ``bare``, where nobody looks at more than commands' kinds, the glyphs
    of a run in a font without outlines are one command that counts them.
    """

    def __init__(self, document: D.Document, owner: dict, box: tuple | None, size: tuple[float, float] | None = None, compat: bool = False, bare: bool = False):
        self.document, self.compat, self.bare = document, compat, bare
        self.commands: list[Command] = []
        self.errors: list[tuple[int, PdfError]] = []
        self.owners = [self._resources(owner)]
        left, top, right, bottom = box or (0, 1, 1, 0)
        width, height = size or (right - left, top - bottom)
        sx = width / (right - left) if box and right > left else 1.0
        sy = height / (top - bottom) if box and top > bottom else 1.0
        self.stack = [State((sx, 0.0, 0.0, -sy, -left * sx, top * sy if box else height))]
        self.path: list[tuple[str, list[float]]] = []
        self.point: tuple[float, float] | None = None
        self.text, self.line = IDENTITY, IDENTITY
        self.forms = 0
        self.sections = 0  # compatibility sections that are open
        self._fonts: dict[int, tuple[object, fonts.Font]] = {}
        self._moved: dict[tuple, _Moves] = {}

    @property
    def state(self) -> State:
        if not self.stack:
            raise PdfError("EmptyGraphicsStateStack", stage="canvas")
        return self.stack[-1]

    def _resources(self, owner: dict) -> dict:
        return D.resources(self.document, owner)

    def find(self, kind: str, name: str, page_first: bool) -> object:
        """A resource by name: fonts and patterns look at the page first, others at the innermost owner."""
        order = self.owners if page_first else self.owners[::-1]
        if not page_first and self.compat:
            order = order[:1]
        for owner in order:
            if name in owner.get(kind, {}):
                return owner[kind][name]
        raise PdfError("ResourceNotFound", f"{kind} {name}", stage="canvas")

    # -- running -------------------------------------------------------------------------

    def run(self, operators: list[content.Operator], strict: bool = False) -> None:
        for n, op in enumerate(operators):
            try:
                self.step(op)
            except PdfError as e:
                self.errors.append((n, e))
                if strict:
                    return
            except (ValueError, TypeError, OverflowError, ZeroDivisionError, RecursionError) as e:
                self.errors.append((n, PdfError("InvalidValue", str(e), stage="canvas")))
                if strict:
                    return

    def step(self, op: content.Operator) -> None:
        name, v, s = op.op, op.nums, None
        if name not in content.KNOWN:
            if self.sections:
                return
            raise PdfError("UnknownOperator", name, stage="canvas")
        if self.compat and name in NOT_IMPLEMENTED:
            if name in ("b", "b*"):
                self._close()
            raise unimplemented(name) if name not in ("BI", "EI", "d1") or not self.compat else PdfError("Panic", name, stage="canvas")
        if name in _NOTHING:
            return
        if name in ("BX", "EX"):
            self.sections = max(0, self.sections + (1 if name == "BX" else -1))
            return
        if name == "Q":
            if self.stack:
                gone = self.stack.pop()
                if gone.clip is not None:
                    self.commands.append(Command("reset_clip"))
            return
        s = self.state
        if name in _TEXT:
            self._text(op, s)
        elif name in _PATH:
            self._build(name, v)
        elif name in _PAINT:
            if name in ("s", "b", "b*"):
                self._close()
            kinds = ("stroke",) if name in "Ss" else ("fill",) if name in ("f", "F", "f*") else ("fill", "stroke")
            self._paint(kinds, "even_odd" if name.endswith("*") else "nonzero")
        elif name == "q":
            self.stack.append(copy.copy(s))
            self.stack[-1].clip = None
        elif name == "cm":
            s.ctm = multiply(tuple(v), s.ctm)
        elif name in ("w", "M", "Tc", "Tw", "Tz", "Ts"):
            setattr(s, {"w": "line_width", "M": "miter", "Tc": "spacing", "Tw": "word_spacing", "Tz": "scaling", "Ts": "rise"}[name], v[0])
        elif name in ("J", "j"):
            setattr(s, {"J": "cap", "j": "join"}[name], int(v[0]))
        elif name in ("g", "rg", "k", "G", "RG", "K"):
            rgb = v * 3 if name in "gG" else cmyk(*v) if name in "kK" else v
            setattr(s, "fill" if name.islower() else "stroke", (*rgb, 1.0))
            self._pattern(name.islower(), None)
        elif name in ("cs", "CS"):
            self._pattern(name.islower(), None)
        elif name in ("scn", "SCN", "sc", "SC"):
            self._color(op, s)
        elif name == "gs":
            self._ext_state(self.document.dictionary(self.find("ExtGState", op.name, False)), s)
        elif name == "sh":
            shading = self.document.dictionary(self.find("Shading", op.name, True))
            self.commands.append(Command("shade", shader=shading_of(shading) | {"matrix": list(s.ctm)}, blend=s.blend))
        elif name == "BI":
            self._image(inline_image(op.props, op.text))
        elif name == "n":
            self.path, self.point = [], None
            if self.compat and s.clip is not None:
                s.clip = None
                self.commands.append(Command("reset_clip"))
        elif name in ("W", "W*"):
            if not self.path:
                raise PdfError("NoActivePath", name, stage="canvas")
            s.clip = move_path(self.path, s.ctm)
            self.commands.append(Command("set_clip", s.clip, "even_odd" if name == "W*" else "nonzero"))
            if self.compat:
                self.path, self.point = [], None
        elif name == "Do":
            self._external(op.name)
        else:
            self._text(op, s)

    # -- paths ---------------------------------------------------------------------------

    def _close(self) -> None:
        if not self.path:
            raise PdfError("NoActivePath", "close", stage="canvas")
        self.path.append(("close", []))

    def _build(self, name: str, v: list[float]) -> None:
        if name == "h":
            return self._close()
        if name == "re":
            x, y, w, h = v
            self.path += [("move", [x, y]), ("line", [x + w, y]), ("line", [x + w, y + h]), ("line", [x, y + h]), ("close", [])]
            self.point = (x, y + h)
            return None
        if name == "v":
            if self.point is None:
                raise PdfError("NoCurrentPoint", stage="canvas")
            v = [*self.point, *v]
        elif name == "y":
            v = [*v, *v[2:]]
        self.path.append(({"m": "move", "l": "line"}.get(name, "cubic"), list(v)))
        self.point = (v[-2], v[-1])
        return None

    def _paint(self, kinds: tuple[str, ...], rule: str) -> None:
        if not self.path:
            raise PdfError("NoActivePath", kinds[0], stage="canvas")
        s, path = self.state, self.path
        self.path, self.point = [], None
        for kind in kinds:
            self._draw(kind, rule, move_path(path, s.ctm))

    def _draw(self, kind: str, rule: str | None, path: list) -> None:
        s = self.state
        pattern = s.stroke_pattern if kind == "stroke" and not self.compat else s.pattern
        shader = self._shader(pattern) if pattern else None
        self.commands.append(Command(kind, path, rule if kind == "fill" else None, s.fill if kind == "fill" else s.stroke, s.line_width if kind == "stroke" else None, shader, s.blend))

    def _image(self, info: dict) -> None:
        square = [("move", [0.0, 0.0]), ("line", [1.0, 0.0]), ("line", [1.0, 1.0]), ("line", [0.0, 1.0]), ("close", [])]
        self.commands.append(Command("draw_image", info=info, path=move_path(square, self.state.ctm)))

    # -- colour --------------------------------------------------------------------------

    def _pattern(self, fill: bool, name: str | None) -> None:
        """Sets the pattern of fills or strokes; with ``compat`` there is one for both."""
        setattr(self.state, "pattern" if fill or self.compat else "stroke_pattern", name)

    def _color(self, op: content.Operator, s: State) -> None:
        if op.name is not None:
            self.find("Pattern", op.name, True)
            self._pattern(op.op.islower(), op.name)
            return
        if self.compat:
            raise unimplemented(op.op)
        if len(op.nums) not in (1, 3, 4):
            raise PdfError("InvalidOperandCount", op.op, stage="canvas")
        rgb = op.nums * 3 if len(op.nums) == 1 else op.nums if len(op.nums) == 3 else cmyk(*op.nums)
        setattr(s, "fill" if op.op.islower() else "stroke", (*rgb, 1.0))
        self._pattern(op.op.islower(), None)

    def _shader(self, pattern: str) -> dict:
        value = self.document.resolve(self.find("Pattern", pattern, True))
        entries = value.dict if isinstance(value, Stream) else value
        if not isinstance(entries, dict):
            raise PdfError("TypeMismatch", "Pattern", stage="canvas")
        kind = entries.get("PatternType")
        if kind == 1:
            box = D.numbers(D.need(entries, "BBox"), 4, "BBox")
            return {"type": "tiling", "paint": int(D.number(D.need(entries, "PaintType"))), "tiling": int(D.number(D.need(entries, "TilingType"))), "bbox": box, "x_step": D.number(D.need(entries, "XStep")), "y_step": D.number(D.need(entries, "YStep"))}
        if kind != 2:
            raise PdfError("InvalidPatternType", str(kind), stage="canvas")
        shading = self.document.dictionary(D.need(entries, "Shading"))
        return shading_of(shading) | {"matrix": list(D.matrix(entries) or IDENTITY)}

    # -- extended graphics state -----------------------------------------------------------

    def _ext_state(self, entries: dict, s: State) -> None:
        for key, value in entries.items():
            if key not in EXT_KEYS:
                raise PdfError("UnsupportedExtGStateKey", key, stage="canvas")
            if key in ("LW", "ML"):
                setattr(s, "line_width" if key == "LW" else "miter", D.number(value))
            elif key in ("LC", "LJ"):
                if value not in (0, 1, 2):
                    raise PdfError("InvalidValue", key, stage="canvas")
                setattr(s, "cap" if key == "LC" else "join", value)
            elif key in ("CA", "ca"):
                which = "stroke" if key == "CA" else "fill"
                setattr(s, which, (*getattr(s, which)[:3], D.number(value)))
            elif key == "BM":
                modes = value if isinstance(value, list) else [value]
                if any(str(m) not in BLEND_MODES for m in modes):
                    raise PdfError("InvalidBlendMode", str(value), stage="canvas")
                if len(modes) > 1 and self.compat:
                    raise unimplemented("several blend modes")
                s.blend = str(modes[0])
            elif key == "SMask":
                self._soft_mask(value)
            elif key in ("D", "RI", "Font") and self.compat:
                raise unimplemented(key)
            elif key == "Font":
                if not isinstance(value, list) or len(value) != 2:
                    raise PdfError("InvalidValue", key, stage="canvas")
                s.font, s.size = self._font(value[0]), D.number(value[1])
            elif key == "D" and not (isinstance(value, list) and len(value) == 2 and isinstance(value[0], list)):
                raise PdfError("InvalidValue", key, stage="canvas")

    def _soft_mask(self, value: object) -> None:
        value = self.document.resolve(value)
        if isinstance(value, Name):
            if value != "None":
                raise PdfError("InvalidSoftMask", str(value), stage="canvas")
            self.commands.append(Command("end_mask"))
            return
        if not isinstance(value, dict) or value.get("S") not in ("Alpha", "Luminosity"):
            raise PdfError("InvalidSoftMask", stage="canvas")
        self.commands.append(Command("begin_mask", info={"mode": str(value["S"])}))
        self._form(self.document.stream(D.need(value, "G")))

    # -- external objects ------------------------------------------------------------------

    def _external(self, name: str) -> None:
        stream = self.document.stream(self.find("XObject", name, False))
        kind = str(stream.dict.get("Subtype"))
        if kind == "Image":
            self._image(image_of(self.document, stream))
        elif kind == "Form":
            self._form(stream)
        else:
            raise PdfError("UnsupportedXObjectSubtype", kind, stage="canvas")

    def _form(self, stream: Stream) -> None:
        D.numbers(D.need(stream.dict, "BBox"), 4, "BBox")
        if self.forms >= MAX_FORMS:
            raise PdfError("Cycle", "form inside itself", stage="canvas")
        ops, error = content.parse(stream.data, self.compat)
        depth = len(self.stack)
        self.stack.append(copy.copy(self.state))
        self.stack[-1].clip = None
        m, s = D.matrix(stream.dict) or IDENTITY, self.state
        s.ctm = multiply(s.ctm, m) if self.compat else multiply(m, s.ctm)
        self.owners.append(self._resources(stream.dict) or self.owners[-1])
        self.forms += 1
        try:
            for op in ops:
                self.step(op)
            if error:
                raise error
        finally:
            self.forms -= 1
            self.owners.pop()
            del self.stack[depth:]

    # -- text ------------------------------------------------------------------------------

    def _text(self, op: content.Operator, s: State) -> None:
        name, v = op.op, op.nums
        if name == "BT":
            self.text = self.line = IDENTITY
        elif name in ("Td", "TD"):
            if name == "TD":
                s.leading = -v[1]
            self._next_line(v[0], v[1])
        elif name == "T*":
            self._next_line(0.0, -s.leading)
        elif name == "TL":
            s.leading = v[0]
        elif name == "Tr":
            s.rendering = int(v[0])
        elif name in ("'", '"'):
            if name == '"':
                s.word_spacing, s.spacing = v
            self._next_line(0.0, -s.leading)
            self._show(op.text, s, self.text)
        elif name == "Tm":
            self.text = self.line = tuple(v)
        elif name == "Tf":
            s.font, s.size = self._font(self.find("Font", op.name, True)), v[0]
        elif name == "Tj":
            self._show(op.text, s, self.text)
        elif name == "TJ":
            at = self.text
            for _, data, amount in op.elems:
                if data is None:
                    scale = s.scaling if self.compat else s.scaling / 100
                    at = multiply((1.0, 0.0, 0.0, 1.0, -amount / 1000 * s.size * scale, 0.0), at)
                else:
                    at = self._show(data, s, at)
            if not self.compat:
                self.text = at
        else:
            raise unimplemented(name)

    def _font(self, value: object) -> fonts.Font:
        if id(value) not in self._fonts:
            # The value is kept beside its font, so that its id stays its own.
            self._fonts[id(value)] = (value, fonts.read_font(self.document, value, self.compat))
        return self._fonts[id(value)][1]

    def _next_line(self, x: float, y: float) -> None:
        offset = (1.0, 0.0, 0.0, 1.0, x, y)
        self.line = multiply(self.line, offset) if self.compat else multiply(offset, self.line)
        self.text = self.line

    def _glyph(self, s: State, path: list) -> None:
        """Paints an outline as the rendering mode says: 0 fill, 1 stroke, 2 both, 3 neither; 4 to 7 clip too."""
        for kind in ((("fill",), ("stroke",), ("fill", "stroke"), ())[s.rendering % 4]):
            self._draw(kind, "nonzero", path)
        if s.rendering > 3:
            self.commands.append(Command("text_clip", path, "nonzero"))

    def _moves(self, s: State, horizontal: float, scale: float, skew: float) -> _Moves:
        """How far each code moves along one axis, kept for runs that are set alike."""
        key = (id(s.font), s.size, s.spacing, s.word_spacing, horizontal, scale, skew)
        if key not in self._moved:
            width, size, spacing, word = s.font.width, s.size, s.spacing, s.word_spacing
            self._moved[key] = _Moves(lambda code: (width(code) / 1000 * size + spacing + (word if code == 32 else 0.0)) * horizontal * scale + 0.0 * skew)
        return self._moved[key]

    def _show(self, data: bytes, s: State, at: tuple) -> tuple:
        """Glyph rows, and outlines where the font has them; the matrix after the run."""
        if s.font is None:
            raise PdfError("NoCurrentFont", stage="canvas")
        font = s.font
        wide = font.kind in ("Type0", "TrueType") and font.encoding is not None if self.compat else font.kind == "Type0"
        codes = [int.from_bytes(data[i : i + 2], "big") for i in range(0, len(data) - 1, 2)] if wide else data
        horizontal = s.scaling / 100
        if self.bare and font.program is None and font.kind != "Type3":
            if codes:
                self.commands.append(Command("glyph", count=len(codes)))
            # Added one by one, as below, so that what follows stands in the same place to the last bit.
            x = reduce(operator.add, map(self._moves(s, horizontal, at[0], at[2]).__getitem__, codes), at[4])
            still = at[1] == 0 and math.isfinite(at[3]) and math.isfinite(x)
            at = (*at[:4], x, at[5] if still else reduce(operator.add, map(self._moves(s, horizontal, at[1], at[3]).__getitem__, codes), at[5]))
            codes = []
        for code in codes:
            w = font.width(code)
            if font.kind == "Type3":
                w = self._procedure(font, code, s, at) or w
                advance = w * s.size / 1000
            else:
                advance = (w / 1000 * s.size + s.spacing + (s.word_spacing if code == 32 else 0.0)) * horizontal
            place = multiply((s.size * horizontal, 0.0, 0.0, s.size, 0.0, s.rise), multiply(at, s.ctm))
            self.commands.append(Command("glyph", color=s.fill, info={"code": code, "char": font.cmap.get(code, chr(code)), "x": place[4], "y": place[5], "advance": advance, "font": font.base_font, "size": s.size}))
            if isinstance(font.program, fonts.CompactFont):
                found = font.program.outline(code)
                if found and found[0]:
                    m = multiply((0.001, 0.0, 0.0, 0.001, 0.0, 0.0), place)
                    self._glyph(s, move_path(found[0], m))
            elif isinstance(font.program, TrueTypeFont):
                gid = font.program.characters.get(ord(font.cmap[code])) if code in font.cmap else None
                found = font.program.outline(code if gid is None else gid)
                if found:
                    self._glyph(s, move_path(found, multiply((1 / font.program.units, 0.0, 0.0, 1 / font.program.units, 0.0, 0.0), place)))
            at = multiply((1.0, 0.0, 0.0, 1.0, advance, 0.0), at)
        if not self.compat:
            self.text = at
        return at

    def _procedure(self, font: fonts.Font, code: int, s: State, at: tuple) -> float | None:
        """Draws a Type 3 glyph and gives the width that its procedure sets."""
        body = font.procedures.get(font.names.get(code, ""))
        if body is None or self.forms >= MAX_FORMS:
            return None
        ops, _ = content.parse(body, self.compat)
        width, depth, saved = None, len(self.stack), (self.text, self.line, self.path)
        self.stack.append(copy.copy(s))
        self.state.ctm = multiply(font.matrix, multiply((s.size, 0.0, 0.0, s.size, 0.0, s.rise), multiply(at, s.ctm)))
        self.path, self.forms = [], self.forms + 1
        try:
            for op in ops:
                if op.op in ("d0", "d1"):
                    width = op.nums[0]
                else:
                    self.step(op)
        finally:
            self.forms -= 1
            self.text, self.line, self.path = saved
            del self.stack[depth:]
        return width


def shading_of(entries: dict) -> dict:
    """Type, colour space, coordinates and function kind of a shading; mesh types are an error."""
    kind = entries.get("ShadingType")
    if kind not in (1, 2, 3):
        raise PdfError("InvalidShadingType", str(kind), stage="resolve")
    space = entries.get("ColorSpace")
    if not isinstance(space, Name) or space not in COLOR_SPACES:
        raise PdfError("UnsupportedColorSpace", str(space), stage="resolve")
    out = {"type": {1: "function", 2: "axial", 3: "radial"}[kind], "color_space": str(space)}
    if kind > 1:
        out["coords"] = D.numbers(D.need(entries, "Coords"), 4 if kind == 2 else 6, "Coords")
        function = D.need(entries, "Function")
        if not isinstance(function, dict):
            raise PdfError("TypeMismatch", "Function", stage="resolve")
        if function.get("FunctionType") not in (2, 3, 4):
            raise PdfError("UnsupportedFunctionType", str(function.get("FunctionType")), stage="resolve")
        out["function"] = function["FunctionType"]
    return out


def image_of(document: D.Document, stream: Stream) -> dict:
    """Size, depth, colour space, data length and soft mask of an image."""
    out = {k: int(D.number(D.need(stream.dict, name), name)) for k, name in (("width", "Width"), ("height", "Height"), ("bits", "BitsPerComponent"))}
    space = stream.dict.get("ColorSpace")
    out |= {"color_space": str(space) if isinstance(space, Name) else None, "bytes": len(stream.data), "filter": str(stream.dict["Filter"]) if isinstance(stream.dict.get("Filter"), Name) else None}
    if "SMask" in stream.dict:
        mask = document.stream(stream.dict["SMask"])
        if mask.dict.get("Subtype") != "Image":
            raise PdfError("InvalidSMask", stage="resolve")
        out["mask"] = image_of(document, mask)
    return out


# Short names in inline images.
_SHORT = {"W": "Width", "H": "Height", "BPC": "BitsPerComponent", "CS": "ColorSpace", "F": "Filter", "D": "Decode", "DP": "DecodeParms", "IM": "ImageMask", "I": "Interpolate"}
_SHORT_SPACES = {"G": "DeviceGray", "RGB": "DeviceRGB", "CMYK": "DeviceCMYK", "I": "Indexed"}


def inline_image(entries: dict | None, data: bytes | None) -> dict:
    """What ``image_of`` gives, of an inline image; a mask has one bit."""
    entries = {_SHORT.get(k, k): v for k, v in (entries or {}).items()}
    if entries.get("ImageMask") is True:
        entries.setdefault("BitsPerComponent", 1)
    out = {k: int(D.number(D.need(entries, name), name)) for k, name in (("width", "Width"), ("height", "Height"), ("bits", "BitsPerComponent"))}
    space, packed = entries.get("ColorSpace"), entries.get("Filter")
    return out | {"color_space": _SHORT_SPACES.get(str(space), str(space)) if isinstance(space, Name) else None, "bytes": len(data or b""), "filter": str(packed) if isinstance(packed, Name) else None}


def expand_image(data: bytes, width: int, height: int, mask: bytes | None = None) -> bytes:
    """Samples as RGBA: 1, 3 or 4 components by length; the soft mask is alpha."""
    import numpy as np

    pixels = width * height
    parts = len(data) // pixels if pixels else 0
    if parts not in (1, 3, 4):
        raise PdfError("UnsupportedImage", f"{parts} components", stage="canvas")
    raw = np.frombuffer(data[: parts * pixels], np.uint8).reshape(pixels, parts)
    out = np.full((pixels, 4), 255, np.uint8)
    out[:, :3] = raw[:, :3] if parts > 1 else raw
    alpha = np.full(pixels, 255, np.uint16)
    if mask is not None:
        alpha[: min(pixels, len(mask))] = np.frombuffer(mask[:pixels], np.uint8)
    out[:, 3] = raw[:, 3].astype(np.uint16) * alpha // 255 if parts == 4 else alpha
    return out.tobytes()


def render_page(document: D.Document, page: dict, compat: bool = False, size: tuple[float, float] | None = None, strict: bool = False, bare: bool = False) -> Canvas:
    box = D.media_box(page)
    canvas = Canvas(document, page, box, size, compat, bare)
    ops, error = document.operators(page, compat)
    canvas.run(ops, strict)
    if error:
        canvas.errors.append((len(ops), error))
    return canvas


def page_commands(data: bytes, options: dict) -> Iterator[tuple[int, Canvas]]:
    document = D.load(data, options["strict"])
    for i, (_, page) in enumerate(document.pages()):
        yield i, render_page(document, page, options["compat"], bare=options.get("bare", False))


def replay(commands: list[Command], sink: object) -> None:
    """Plays recorded commands to ``sink`` in order: its method of a command's kind takes the command."""
    for c in commands:
        for _ in range(c.count):
            getattr(sink, c.kind)(c)


class Recording:
    """A sink that records: what is replayed to it can be replayed from it."""

    def __init__(self) -> None:
        self.commands: list[Command] = []

    def _take(self, c: Command) -> None:
        self.commands.append(c)

    fill = stroke = glyph = shade = draw_image = set_clip = reset_clip = text_clip = begin_mask = end_mask = _take
