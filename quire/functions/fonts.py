"""Font data: widths, encodings, character maps and compact font programs.

Plain Python over one font's values, called per document by the tables; the
lookups by code over many fonts are joins in ``quire.operators.graph``.
"""

from __future__ import annotations

import math
import re
import struct
from bisect import bisect_right
from dataclasses import dataclass, field

from quire.sources.pdf_syntax import Name, PdfError


class FontError(PdfError):
    def __init__(self, kind: str, message: str = ""):
        super().__init__(kind, message, stage="font")


def _u16(value: object) -> int:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not 0 <= value < 65536:
        raise FontError("NumberConversionError", str(value))
    return int(value)


def _number(value: object, what: str) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise FontError("TypeMismatch", what)
    return float(value)


# -- Widths ------------------------------------------------------------------------------


def simple_widths(first: object, last: object, widths: object) -> dict[int, float]:
    """code -> width of a simple font; widths beyond the last code are cut off."""
    if first is None or last is None:
        raise FontError("MissingRequiredKey", "FirstChar" if first is None else "LastChar")
    if not isinstance(widths, list):
        raise FontError("TypeMismatch", "Widths")
    start, end = int(_number(first, "FirstChar")), int(_number(last, "LastChar"))
    if {int, float}.issuperset(map(type, widths)):
        return dict(zip(range(start, end + 1), map(float, widths), strict=False))
    return {code: _number(w, "Widths") for code, w in enumerate(widths, start) if code <= end}


def cid_widths(entries: list) -> list[tuple[int, int, list[float]]]:
    """Runs (first code, last code, widths) of a /W array, in ascending order.

    A run of one width for many codes lists it once per code.
    """
    runs: dict[int, tuple[int, list[float]]] = {}
    starts: list[int] = []
    at = 0
    while at < len(entries):
        start = _u16(entries[at])
        at += 1
        if at >= len(entries):
            raise FontError("IncompleteCIDEntry", str(start))
        item = entries[at]
        at += 1
        if isinstance(item, list):
            if not item:
                raise FontError("EmptyWidthsArray", str(start))
            if start in runs:
                raise FontError("DuplicateCIDStart", str(start))
            widths, end = [_number(w, "W") for w in item], start + len(item) - 1
            if end > 65535:
                raise FontError("RangeTooLarge", str(start))
        else:
            end = _u16(item)
            if at >= len(entries):
                raise FontError("MissingWidthForCIDRange", str(start))
            width = _number(entries[at], "W")
            at += 1
            if end < start:
                raise FontError("InvalidCIDRange", f"{start} {end}")
            if start in runs:
                raise FontError("DuplicateCIDStart", str(start))
            widths = [width] * (end - start + 1)
        # Runs so far do not overlap: only the neighbours of the new one can.
        i = bisect_right(starts, start)
        if (i and runs[starts[i - 1]][0] >= start) or (i < len(starts) and starts[i] <= end):
            raise FontError("OverlappingRange", str(start))
        starts.insert(i, start)
        runs[start] = (end, widths)
    return [(s, *runs[s]) for s in starts]


def width_of(runs: list[tuple[int, int, list[float]]], cid: int) -> float | None:
    i = bisect_right(runs, cid, key=lambda r: r[0]) - 1
    return runs[i][2][cid - runs[i][0]] if i >= 0 and cid <= runs[i][1] else None


# -- Encodings ---------------------------------------------------------------------------


def encoding_kind(name: str) -> str:
    return {"Identity-H": "IdentityHorizontal", "Identity-V": "IdentityVertical"}.get(name, "Other")


def differences(entries: list) -> dict[int, str]:
    """code -> glyph name: a number sets the code, each name takes one. Going past 255 is an error."""
    out, code = {}, 0
    for item in entries:
        if isinstance(item, Name):
            out[code] = str(item)
            if code == 255:
                raise FontError("CodeOverflow", str(item))
            code += 1
        elif isinstance(item, (int, float)) and not isinstance(item, bool) and 0 <= item <= 255:
            code = int(item)
        else:
            raise FontError("InvalidDifferences", str(item))
    return out


_PAIR = re.compile(r"<(\S+)>\s+<(\S+)>")


def character_map(data: bytes) -> dict[int, str]:
    """code -> character from the ``bfchar`` lines, a pair per line; targets that are no character are left out."""
    out, inside = {}, False
    for line in data.decode("utf-8", "replace").splitlines():
        line = line.strip()
        if not line or line.startswith("%"):
            continue
        if "beginbfchar" in line or "endbfchar" in line:
            inside = "beginbfchar" in line
            continue
        pair = _PAIR.fullmatch(line) if inside else None
        if pair:
            codes = []
            for digits in pair.groups():
                if not re.fullmatch(r"\+?[0-9A-Fa-f]{1,}", digits) or int(digits, 16) > 0xFFFFFFFF:
                    raise FontError("InvalidHex", digits)
                codes.append(int(digits, 16))
            if codes[1] < 0x110000 and not 0xD800 <= codes[1] < 0xE000:
                out[codes[0]] = chr(codes[1])
    return out


# The string id of each code in the standard encoding, 0 for none.
_STANDARD = (
    0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0,
    0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0,
    1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16,
    17, 18, 19, 20, 21, 22, 23, 24, 25, 26, 27, 28, 29, 30, 31, 32,
    33, 34, 35, 36, 37, 38, 39, 40, 41, 42, 43, 44, 45, 46, 47, 48,
    49, 50, 51, 52, 53, 54, 55, 56, 57, 58, 59, 60, 61, 62, 63, 64,
    65, 66, 67, 68, 69, 70, 71, 72, 73, 74, 75, 76, 77, 78, 79, 80,
    81, 82, 83, 84, 85, 86, 87, 88, 89, 90, 91, 92, 93, 94, 95, 0,
    0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0,
    0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0,
    0, 96, 97, 98, 99, 100, 101, 102, 103, 104, 105, 106, 107, 108, 109, 110,
    0, 111, 112, 113, 114, 0, 115, 116, 117, 118, 119, 120, 121, 122, 0, 123,
    0, 124, 125, 126, 127, 128, 129, 130, 131, 0, 132, 133, 0, 134, 135, 136,
    137, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0,
    0, 138, 0, 139, 0, 0, 0, 0, 140, 141, 142, 143, 0, 0, 0, 0,
    0, 144, 0, 0, 0, 145, 0, 0, 146, 147, 148, 149, 0, 0, 0, 0,
)
STANDARD_ENCODING = {code: sid for code, sid in enumerate(_STANDARD) if sid}


# -- Compact font programs ---------------------------------------------------------------


@dataclass
class _Cursor:
    data: bytes
    at: int = 0

    def take(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        if len(out) < n:
            raise FontError("EndOfData")
        self.at += n
        return out

    def u8(self) -> int:
        return self.take(1)[0]

    def u16(self) -> int:
        return struct.unpack(">H", self.take(2))[0]


def encoded_int(first: int, cursor: _Cursor) -> int:
    if 32 <= first <= 246:
        return first - 139
    if 247 <= first <= 250:
        return (first - 247) * 256 + cursor.u8() + 108
    if 251 <= first <= 254:
        return -(first - 251) * 256 - cursor.u8() - 108
    if first == 28:
        return struct.unpack(">h", cursor.take(2))[0]
    if first == 29:
        return struct.unpack(">i", cursor.take(4))[0]
    raise FontError("EndOfData", f"{first} begins no number")


def index(cursor: _Cursor) -> list[bytes]:
    count = cursor.u16()
    if not count:
        return []
    size = cursor.u8()
    if not 1 <= size <= 4:
        raise FontError("InvalidData", "offSize")
    raw = cursor.take((count + 1) * size)
    offsets = [int.from_bytes(raw[i : i + size], "big") for i in range(0, len(raw), size)]
    if offsets[0] == 0:
        raise FontError("InvalidData", "first offset is 0")
    block = cursor.take(max(0, offsets[-1] - 1))
    if any(a < 1 or b < a or b - 1 > len(block) for a, b in zip(offsets, offsets[1:], strict=False)):
        raise FontError("InvalidOffsets")
    return [block[a - 1 : b - 1] for a, b in zip(offsets, offsets[1:], strict=False)]


_TOP = {15: "charset", 16: "encoding", 17: "char_strings"}


def top_dictionary(data: bytes) -> dict[str, int]:
    """The offsets of charset, encoding and char strings."""
    cursor, stack, out = _Cursor(data), [], {}
    while cursor.at < len(data):
        b = cursor.u8()
        if b <= 21:
            code = b if b != 12 else 1200 + cursor.u8()
            if code in _TOP:
                if not stack:
                    raise FontError("MissingOperand", str(code))
                value = stack.pop()
                if not 0 <= value < 65536:
                    raise FontError("OperandValueOutOfRange", str(code))
                out[_TOP[code]] = value
        elif b == 30:
            raise FontError("UnsupportedRealNumber")
        elif b in (28, 29) or 32 <= b <= 254:
            stack.append(encoded_int(b, cursor))
        else:
            raise FontError("UnexpectedDictByte", str(b))
    return out


# Charstring operators by opcode (12 n as 1200 + n).
CHARSTRING = {
    1: "hstem", 3: "vstem", 4: "vmoveto", 5: "rlineto", 6: "hlineto", 7: "vlineto", 8: "rrcurveto", 10: "callsubr", 11: "return", 14: "endchar",
    18: "hstemhm", 19: "hintmask", 20: "cntrmask", 21: "rmoveto", 22: "hmoveto", 23: "vstemhm", 24: "rcurveline", 25: "rlinecurve", 26: "vvcurveto", 27: "hhcurveto", 29: "callgsubr", 30: "vhcurveto", 31: "hvcurveto",
    1200: "dotsection", 1203: "and", 1204: "or", 1205: "not", 1209: "abs", 1210: "add", 1211: "sub", 1212: "div", 1214: "neg", 1215: "eq", 1218: "drop", 1220: "put", 1221: "get", 1222: "ifelse", 1223: "random", 1224: "mul", 1226: "sqrt", 1227: "dup", 1228: "exch", 1229: "index", 1230: "roll", 1234: "hflex", 1235: "flex", 1236: "hflex1", 1237: "flex1",
}
IMPLEMENTED = frozenset(("rmoveto", "hmoveto", "vmoveto", "rlineto", "hlineto", "vlineto", "rrcurveto", "rcurveline", "vvcurveto", "vhcurveto", "hvcurveto", "endchar"))


def char_string(data: bytes) -> list[int | str]:
    """Numbers and operator names; 16.16 numbers lose their fraction."""
    cursor, out = _Cursor(data), []
    while cursor.at < len(data):
        b = cursor.u8()
        if b == 28 or 32 <= b <= 254:
            out.append(encoded_int(b, cursor))
        elif b == 255:
            out.append(struct.unpack(">i", cursor.take(4))[0] >> 16)
        else:
            code = 1200 + cursor.u8() if b == 12 else b
            if code not in CHARSTRING:
                raise FontError("UnexpectedOperator", str(code))
            out.append(CHARSTRING[code])
    return out


@dataclass
class Outline:
    """A path under construction: segments (verb, coordinates) and the pen."""

    segments: list[tuple[str, list[float]]] = field(default_factory=list)
    x: float = 0.0
    y: float = 0.0
    open: bool = False
    width_read: bool = False

    def move(self, dx: float, dy: float) -> None:
        if self.open:
            self.segments.append(("close", []))
        self.open = True
        self.x, self.y = self.x + dx, self.y + dy
        self.segments.append(("move", [self.x, self.y]))

    def line(self, dx: float, dy: float) -> None:
        self.x, self.y = self.x + dx, self.y + dy
        self.segments.append(("line", [self.x, self.y]))

    def curve(self, *deltas: float) -> None:
        pts = []
        for dx, dy in zip(deltas[::2], deltas[1::2], strict=True):
            self.x, self.y = self.x + dx, self.y + dy
            pts += [self.x, self.y]
        self.segments.append(("cubic", pts))


def draw(program: list[int | str]) -> tuple[list[tuple[str, list[float]]], FontError | None]:
    """The outline of a charstring, and the error at which it stopped."""
    pen, stack = Outline(), []
    try:
        for item in program:
            if isinstance(item, int):
                if len(stack) >= 513:
                    raise FontError("StackOverflow")
                stack.append(item)
                continue
            if item not in IMPLEMENTED:
                raise FontError("Unimplemented", item)
            _step(pen, item, stack)
            stack = []
    except FontError as e:
        return pen.segments, e
    return pen.segments, None


def _step(pen: Outline, op: str, args: list[int]) -> None:
    wanted = {"rmoveto": 2, "hmoveto": 1, "vmoveto": 1}.get(op)
    if wanted:
        if len(args) == wanted + 1 and not pen.width_read:
            pen.width_read, args = True, args[1:]
        if len(args) < wanted:
            raise FontError("StackUnderflow", op)
        pen.move(*{"rmoveto": args[:2], "hmoveto": (args[0], 0), "vmoveto": (0, args[0])}[op])
    elif op == "rlineto":
        if len(args) % 2:
            raise FontError("StackUnderflow", op)
        for i in range(0, len(args), 2):
            pen.line(args[i], args[i + 1])
    elif op in ("hlineto", "vlineto"):
        for i, d in enumerate(args):
            flat = (op == "hlineto") == (i % 2 == 0)
            pen.line(d if flat else 0, 0 if flat else d)
    elif op in ("rrcurveto", "rcurveline"):
        i = 0
        while len(args) - i >= 6:
            pen.curve(*args[i : i + 6])
            i += 6
        if op == "rcurveline":
            if len(args) - i < 2:
                raise FontError("StackUnderflow", op)
            pen.line(args[i], args[i + 1])
    elif op == "vvcurveto":
        first = args[0] if len(args) % 4 == 1 else 0
        for i in range(len(args) % 4 and 1, len(args) - 3, 4):
            a, b, c, d = args[i : i + 4]
            pen.curve(first, a, b, c, 0, d)
            first = 0
    elif op in ("vhcurveto", "hvcurveto"):
        flat, i = op == "hvcurveto", 0
        while len(args) - i >= 4:
            a, b, c, d = args[i : i + 4]
            extra = args[i + 4] if len(args) - i == 5 else 0
            pen.curve(*((a, 0, b, c, extra, d) if flat else (0, a, b, c, d, extra)))
            flat, i = not flat, i + 4
    elif op == "endchar":
        pen.segments.append(("close", []))


#: How deep subroutines may call each other, and numbers on the stack.
MAX_CALLS, MAX_STACK = 10, 513
_STEMS = frozenset(("hstem", "vstem", "hstemhm", "vstemhm"))
_MASKS = frozenset(("hintmask", "cntrmask"))


def _bias(count: int) -> int:
    return 107 if count < 1240 else 1131 if count < 33900 else 32768


class Interpreter:
    """Runs a charstring: hints are counted, subroutines called, arithmetic done, and the path drawn.

    A value that is not there is ``StackUnderflow``, a call that leads nowhere
    ``InvalidSubroutine``; what was drawn before an error stays.
    """

    def __init__(self, subroutines: list[bytes] = (), global_subroutines: list[bytes] = ()):
        self.pen, self.stack, self.store = Outline(), [], {}
        self.local, self.shared = subroutines, global_subroutines
        self.hints, self.ended = 0, False

    def pop(self, n: int = 1) -> list[float]:
        if len(self.stack) < n:
            raise FontError("StackUnderflow")
        out = self.stack[len(self.stack) - n :]
        del self.stack[len(self.stack) - n :]
        return out

    def push(self, value: float) -> None:
        if len(self.stack) >= MAX_STACK:
            raise FontError("StackOverflow")
        self.stack.append(value)

    def run(self, data: bytes, depth: int = 0) -> None:
        cursor = _Cursor(data)
        while cursor.at < len(data) and not self.ended:
            b = cursor.u8()
            if b == 28 or 32 <= b <= 254:
                self.push(encoded_int(b, cursor))
            elif b == 255:
                self.push(struct.unpack(">i", cursor.take(4))[0] / 65536)
            else:
                code = 1200 + cursor.u8() if b == 12 else b
                if code not in CHARSTRING:
                    raise FontError("UnexpectedOperator", str(code))
                op = CHARSTRING[code]
                if op == "return":
                    return
                if op in ("callsubr", "callgsubr"):
                    programs = self.local if op == "callsubr" else self.shared
                    at = int(self.pop()[0]) + _bias(len(programs))
                    if not 0 <= at < len(programs) or depth >= MAX_CALLS:
                        raise FontError("InvalidSubroutine", str(at))
                    self.run(programs[at], depth + 1)
                elif op in _STEMS or op in _MASKS:
                    self._width(len(self.stack) % 2 == 1)
                    self.hints += len(self.stack) // 2
                    self.stack.clear()
                    if op in _MASKS:
                        cursor.take((self.hints + 7) // 8)
                elif not self._compute(op):
                    self._draw(op)
                    self.stack.clear()

    def _width(self, there: bool) -> None:
        """The first operator that clears the stack may have the glyph's width below its arguments."""
        if there and not self.pen.width_read and self.stack:
            del self.stack[0]
        self.pen.width_read = True

    def _draw(self, op: str) -> None:
        pen, n = self.pen, len(self.stack)
        self._width(n > {"rmoveto": 2, "hmoveto": 1, "vmoveto": 1}.get(op, n) or (op == "endchar" and n in (1, 5)))
        v = list(self.stack)
        if op == "hhcurveto":
            first = v.pop(0) if len(v) % 4 == 1 else 0
            for i in range(0, len(v) - 3, 4):
                pen.curve(v[i], first, v[i + 1], v[i + 2], v[i + 3], 0)
                first = 0
        elif op == "rlinecurve":
            if len(v) < 6 or len(v) % 2:
                raise FontError("StackUnderflow", op)
            for i in range(0, len(v) - 6, 2):
                pen.line(v[i], v[i + 1])
            pen.curve(*v[-6:])
        elif op in _FLEX:
            if n < _FLEX[op]:
                raise FontError("StackUnderflow", op)
            for curve in _flexed(op, v):
                pen.curve(*curve)
        elif op == "endchar":
            self.ended = True
            _step(pen, op, v)
        elif op != "dotsection":
            _step(pen, op, v)

    def _compute(self, op: str) -> bool:
        """Whether ``op`` works on the stack alone; then it is done."""
        if op in _ONE:
            self.push(_ONE[op](*self.pop()))
        elif op in _TWO:
            a, b = self.pop(2)
            if op == "div" and b == 0:
                raise FontError("DivisionByZero")
            self.push(_TWO[op](a, b))
        elif op == "drop":
            self.pop()
        elif op == "dup":
            (a,) = self.pop()
            self.push(a)
            self.push(a)
        elif op == "exch":
            a, b = self.pop(2)
            self.stack += [b, a]
        elif op == "ifelse":
            a, b, left, right = self.pop(4)
            self.push(a if left <= right else b)
        elif op == "put":
            value, at = self.pop(2)
            self.store[int(at)] = value
        elif op == "get":
            self.push(self.store.get(int(self.pop()[0]), 0))
        elif op == "index":
            at = max(0, int(self.pop()[0]))
            if at >= len(self.stack):
                raise FontError("StackUnderflow", op)
            self.push(self.stack[-1 - at])
        elif op == "roll":
            n, by = (int(x) for x in self.pop(2))
            top = self.pop(n) if n > 0 else []
            by = by % n if n > 0 else 0
            self.stack += top[len(top) - by :] + top[: len(top) - by]
        elif op == "random":
            self.push(0.5)  # in (0, 1], and the same in every run
        else:
            return False
        return True


def _root(a: float) -> float:
    if a < 0:
        raise FontError("InvalidOperand", "sqrt")
    return math.sqrt(a)


_ONE = {"abs": abs, "neg": lambda a: -a, "not": lambda a: int(a == 0), "sqrt": _root}
_TWO = {"and": lambda a, b: int(a != 0 and b != 0), "or": lambda a, b: int(a != 0 or b != 0), "eq": lambda a, b: int(a == b), "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: a / b}
#: Arguments of the flex operators.
_FLEX = {"hflex": 7, "flex": 13, "hflex1": 9, "flex1": 11}


def _flexed(op: str, v: list[float]) -> tuple[list[float], list[float]]:
    """The two curves of a flex operator, twelve deltas in all."""
    if op == "flex":
        return v[:6], v[6:12]
    if op == "hflex":
        return [v[0], 0, v[1], v[2], v[3], 0], [v[4], 0, v[5], -v[2], v[6], 0]
    if op == "hflex1":
        return [v[0], v[1], v[2], v[3], v[4], 0], [v[5], 0, v[6], v[7], v[8], -(v[1] + v[3] + v[7])]
    dx, dy = sum(v[0:10:2]), sum(v[1:10:2])
    return v[:6], [*v[6:10], *((v[10], -dy) if abs(dx) > abs(dy) else (-dx, v[10]))]


def glyph_path(data: bytes, subroutines: list[bytes] = (), global_subroutines: list[bytes] = ()) -> tuple[list[tuple[str, list[float]]], FontError | None]:
    """The outline of a charstring's bytes, and the error at which it stopped."""
    machine = Interpreter(subroutines, global_subroutines)
    try:
        machine.run(data)
    except FontError as e:
        return machine.pen.segments, e
    return machine.pen.segments, None


def font_dictionary(data: bytes) -> dict[int, list[float]]:
    """Operands of each operator (12 n as 1200 + n) of a Top or Private DICT."""
    cursor, stack, out = _Cursor(data), [], {}
    while cursor.at < len(data):
        b = cursor.u8()
        if b <= 21:
            out[1200 + cursor.u8() if b == 12 else b], stack = stack, []
        elif b == 30:
            digits = ""
            while "f" not in digits:
                digits += f"{cursor.u8():02x}"
            plain = digits[: digits.index("f")].replace("a", ".").replace("b", "E").replace("c", "E-").replace("e", "-")
            try:
                stack.append(float(plain or "0"))
            except ValueError:
                raise FontError("InvalidRealNumber", plain) from None
        elif b in (28, 29) or 32 <= b <= 254:
            stack.append(encoded_int(b, cursor))
        else:
            raise FontError("UnexpectedDictByte", str(b))
    return out


@dataclass
class CompactFont:
    """Glyph programs and the glyph of each code. With ``compat``, programs are read word by word and hints, subroutines and flexes stop a glyph."""

    glyphs: list[bytes]
    encoding: dict[int, int]
    subroutines: list[bytes] = field(default_factory=list)
    global_subroutines: list[bytes] = field(default_factory=list)
    compat: bool = False

    def outline(self, code: int) -> tuple[list, FontError | None] | None:
        gid = self.encoding.get(code)
        if gid is None or gid >= len(self.glyphs):
            return None
        return draw(char_string(self.glyphs[gid])) if self.compat else glyph_path(self.glyphs[gid], self.subroutines, self.global_subroutines)


def compact_font(data: bytes, compat: bool = False) -> CompactFont:
    cursor = _Cursor(data)
    cursor.take(2)
    cursor.at = cursor.u8()
    index(cursor)
    tops = index(cursor)
    if not tops:
        raise FontError("InvalidData", "missing Top DICT")
    return _compact_compat(cursor, tops[0]) if compat else _compact(cursor, tops[0])


def _at(cursor: _Cursor, offset: float) -> _Cursor:
    if not 0 <= offset <= len(cursor.data):
        raise FontError("InvalidOffsets", str(offset))
    return _Cursor(cursor.data, int(offset))


def _compact(cursor: _Cursor, top: bytes) -> CompactFont:
    entries = font_dictionary(top)
    index(cursor)  # strings
    shared = index(cursor) if cursor.at < len(cursor.data) else []

    def offset(op: int, default: float) -> float:
        return (entries.get(op) or [default])[-1]

    if 17 not in entries:
        raise FontError("InvalidData", "missing CharStrings offset")
    glyphs = index(_at(cursor, offset(17, 0)))
    local: list[bytes] = []
    if len(entries.get(18, [])) == 2:
        size, start = entries[18]
        private = font_dictionary(_at(cursor, start).take(max(0, int(size))))
        if private.get(19):
            local = index(_at(cursor, start + private[19][-1]))
    gids = _charset(cursor, offset(15, 0), len(glyphs))
    return CompactFont(glyphs, _codes(cursor, offset(16, 0), gids), local, shared)


def _charset(cursor: _Cursor, offset: float, count: int) -> dict[int, int]:
    """Glyph of each string id; offset 0 is the predefined set, in which both are the same."""
    if offset == 0:
        return {g: g for g in range(count)}
    if offset in (1, 2):
        raise FontError("UnsupportedCharsetFormat", "expert")
    cursor = _at(cursor, offset)
    form, gids, g = cursor.u8(), {0: 0}, 1
    if form > 2:
        raise FontError("UnsupportedCharsetFormat", str(form))
    while g < count:
        first = cursor.u16()
        left = 0 if form == 0 else cursor.u8() if form == 1 else cursor.u16()
        for sid in range(first, first + min(left, count - g - 1) + 1):
            gids[sid], g = g, g + 1
    return gids


def _codes(cursor: _Cursor, offset: float, gids: dict[int, int]) -> dict[int, int]:
    """Glyph of each code: the standard encoding, or the font's own."""
    if offset == 0:
        return {code: gids.get(STANDARD_ENCODING.get(code, 0), 0) for code in range(256)}
    if offset == 1:
        raise FontError("UnsupportedEncodingType", "expert")
    cursor = _at(cursor, offset)
    form, out, g = cursor.u8(), dict.fromkeys(range(256), 0), 1
    if form & 0x7F > 1:
        raise FontError("UnsupportedEncodingType", str(form))
    for _ in range(cursor.u8()):
        first = cursor.u8()
        for code in range(first, first + (cursor.u8() if form & 0x7F else 0) + 1):
            out[code & 0xFF], g = g, g + 1
    if form & 0x80:
        for _ in range(cursor.u8()):
            code = cursor.u8()
            out[code] = gids.get(cursor.u16(), 0)
    return out


def _compact_compat(cursor: _Cursor, data: bytes) -> CompactFont:
    top = top_dictionary(data)
    if "char_strings" not in top:
        raise FontError("InvalidData", "missing CharStrings offset")
    cursor.at = top["char_strings"]
    glyphs = index(cursor)
    for glyph in glyphs:
        char_string(glyph)
    if "charset" not in top:
        raise FontError("InvalidData", "missing charset offset")
    cursor.at = top["charset"]
    form = cursor.u8()
    if form & 0x80:
        raise FontError("SupplementalEncodingNotSupported")
    if form != 0:
        raise FontError("UnsupportedCharsetFormat", str(form))
    gids = {0: 0} | {cursor.u16(): g for g in range(1, len(glyphs))}
    if top.get("encoding", 0) != 0:
        raise FontError("UnsupportedEncodingType", str(top["encoding"]))
    return CompactFont(glyphs, {code: gids.get(STANDARD_ENCODING.get(code, 0), 0) for code in range(256)}, compat=True)


def font_file(document, descriptor: dict) -> object | None:
    """The font program's stream: FontFile2, then FontFile3, then FontFile."""
    for key in ("FontFile2", "FontFile3", "FontFile"):
        if key in descriptor:
            try:
                return document.stream(descriptor[key])
            except PdfError:
                continue
    return None


@dataclass
class Font:
    """What text layout needs of a font."""

    kind: str
    base_font: str = ""
    encoding: str | None = None
    widths: dict[int, float] = field(default_factory=dict)
    runs: list = field(default_factory=list)
    default_width: float = 0.0
    cmap: dict[int, str] = field(default_factory=dict)
    program: object = None
    names: dict[int, str] = field(default_factory=dict)
    procedures: dict[str, object] = field(default_factory=dict)
    matrix: tuple[float, ...] = (0.001, 0, 0, 0.001, 0, 0)

    def width(self, code: int) -> float:
        if self.kind == "Type0":
            w = width_of(self.runs, code)
            return self.default_width if w is None else w
        return self.widths.get(code, 0.0)


def read_font(document, value: object, compat: bool = False) -> Font:
    """A font from its dictionary; MMType1 and other subtypes are an error."""
    entries = document.dictionary(value)
    kind = str(entries.get("Subtype", ""))
    if kind not in ("Type0", "Type1", "Type3", "TrueType"):
        raise FontError("UnsupportedFontSubtype", kind)
    font = Font(kind, str(entries.get("BaseFont", "")))
    encoding = entries.get("Encoding")
    font.encoding = encoding_kind(str(encoding)) if isinstance(encoding, Name) else None
    if "ToUnicode" in entries:
        font.cmap = character_map(document.stream(entries["ToUnicode"]).data)
    if kind == "Type0":
        below = document.resolve(entries.get("DescendantFonts"))
        if not isinstance(below, list) or len(below) != 1:
            raise FontError("InvalidDescendantFonts")
        child = document.dictionary(below[0])
        if child.get("Subtype") != "CIDFontType2":
            raise FontError("UnsupportedCidFont", str(child.get("Subtype")))
        font.default_width = _number(child.get("DW", 1000), "DW")
        widths = document.resolve(child["W"]) if "W" in child else []
        if not isinstance(widths, list):
            raise FontError("TypeMismatch", "W")
        font.runs = cid_widths(widths)
        entries = child
    else:
        if "Widths" in entries:
            font.widths = simple_widths(entries.get("FirstChar"), entries.get("LastChar"), document.resolve(entries["Widths"]))
    if kind == "Type3":
        from quire.operators.pdf_document import need, numbers

        font.matrix = tuple(numbers(need(entries, "FontMatrix"), 6, "FontMatrix"))
        chars = need(entries, "CharProcs")
        if not isinstance(chars, dict):
            raise FontError("TypeMismatch", "CharProcs")
        font.procedures = {name: document.stream(v).data for name, v in chars.items()}
        own = document.resolve(encoding)
        if isinstance(own, dict) and isinstance(own.get("Differences"), list):
            font.names = differences(own["Differences"])
        return font
    if "FontDescriptor" in entries:
        found = font_file(document, document.dictionary(entries["FontDescriptor"]))
        if found is not None:
            from quire.functions.truetype import true_type

            font.program = compact_font(found.data, compat) if kind == "Type1" else true_type(found.data)
    elif kind == "Type1":
        raise FontError("MissingRequiredKey", "FontDescriptor")
    return font
