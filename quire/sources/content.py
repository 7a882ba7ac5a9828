"""Content streams: bytes to an ordered list of operators with typed operands.

``compat`` keeps the quirks of the conformance cases: a byte that begins no
token (a quote, a brace, NUL, anything from 0x80) silently ends the stream,
``true``, ``false`` and ``null`` read as operator names, colour operators take
their first operand for a pattern name, a marked-content property name is an
error, inline images fail, and an unknown operator ends the stream. Otherwise these are read as the format means
them, bytes that begin nothing are an error, and an unknown operator is kept
under its own name, without its operands, for the caller to report or skip.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from quire.sources.pdf_syntax import Hex, Name, PdfError, Scanner, Text

# Operator, its name, its operands.
# n number, u integer 0-255, N name, S string, D dictionary, E text elements, A numbers, * colour components and pattern.
_TABLE = """
W ClipNonZero -
W* ClipEvenOdd -
g SetGrayFill n
G SetGrayStroke n
rg SetRGBFill nnn
RG SetRGBStroke nnn
k SetCMYKFill nnnn
K SetCMYKStroke nnnn
CS SetStrokeColorSpace N
cs SetNonStrokingColorSpace N
SCN SetStrokingColor *
scn SetNonStrokingColor *
w SetLineWidth n
J SetLineCapStyle u
j SetLineJoinStyle u
M SetMiterLimit n
d SetDashPattern An
i SetFlatnessTolerance n
q SaveGraphicsState -
Q RestoreGraphicsState -
cm ConcatMatrix nnnnnn
gs SetGraphicsStateFromDict N
BMC BeginMarkedContent N
BDC BeginMarkedContentWithProps ND
EMC EndMarkedContent -
m MoveTo nn
l LineTo nn
c CurveTo nnnnnn
v CurveToV nnnn
y CurveToY nnnn
h ClosePath -
re Rectangle nnnn
S StrokePath -
s CloseStrokePath -
f FillPathNonZero -
f* FillPathEvenOdd -
B FillAndStrokePathNonZero -
B* FillAndStrokePathEvenOdd -
b CloseFillAndStrokePathNonZero -
b* CloseFillAndStrokePathEvenOdd -
n EndPath -
sh PaintShading N
BT BeginText -
ET EndText -
Td MoveTextPosition nn
TD MoveTextPositionAndSetLeading nn
Tm SetTextMatrix nnnnnn
T* MoveToNextLine -
Tj ShowText S
' MoveNextLineShowText S
" SetSpacingMoveShowText nnS
TJ ShowTextArray E
Tc SetCharacterSpacing n
Tw SetWordSpacing n
Tz SetHorizontalScaling n
TL SetLeading n
Tf SetFont Nn
Tr SetRenderingMode u
Ts SetTextRise n
d1 SetCharWidthAndBoundingBox nnnnnn
Do InvokeXObject N
BI BeginInlineImage -
ID InlineImageData -
EI EndInlineImage -
"""
#: Operators that ``compat`` does not know: the rest of the format's own.
_MORE = """
F FillPathNonZeroOld -
sc SetNonStrokingColorPlain *
SC SetStrokingColorPlain *
ri SetRenderingIntent N
d0 SetCharWidth nn
MP MarkPoint N
DP MarkPointWithProps ND
BX BeginCompatibility -
EX EndCompatibility -
"""
OPERATORS = {op: (name, "" if kinds == "-" else kinds) for op, name, kinds in (line.split(" ") for line in _TABLE.strip().splitlines())}
KNOWN = OPERATORS | {op: (name, "" if kinds == "-" else kinds) for op, name, kinds in (line.split(" ") for line in _MORE.strip().splitlines())}

_LIMITS = {"J": 2, "j": 2, "Tr": 7}
_OPERATOR = re.compile(rb"[A-Za-z][A-Za-z*01]*|[*1]+|['\"]")
_OPERATOR_COMPAT = re.compile(rb"[A-Za-z*1]+|['\"]")
# A short cut: numbers and their operator, a plain string that is shown, a font and its size. What it
# matches is read as ``parse`` reads it token by token; minus zero, which is 0 there and -0.0 here, does not match.
_B, _NUMBER = rb"[ \t\n\r\x0c]", rb"(?:[+-]?\d{1,15}\.\d{1,15}|\+?\d{1,15}|-0{0,9}[1-9]\d{0,5})"
_COMMON = re.compile(rb"%b*+(?:((?:%b%b++)*+)([A-Za-z][A-Za-z*01]*+)|\(([^()\\]*+)\)%b*+(Tj)(?![A-Za-z*01])|/([A-Za-z0-9_.+-]++)%b++(%b)%b++(Tf)(?![A-Za-z*01]))" % (_B, _NUMBER, _B, _B, _B, _NUMBER, _B))
#: Operators of numbers alone, with how many they take.
_PLAIN = {op.encode(): (op, len(kinds)) for op, (_, kinds) in KNOWN.items() if not kinds.strip("n") and op != "BI"}


@dataclass
class Operator:
    """An operator with its operands by kind."""

    op: str
    offset: int
    nums: list[float] = field(default_factory=list)
    name: str | None = None
    text: bytes | None = None
    elems: list[tuple[str, bytes | None, float | None]] | None = None
    props: dict | None = None


def _is_number(x: object) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def _string(x: object) -> bytes:
    if isinstance(x, Text):
        return x.raw
    if isinstance(x, Hex):
        return bytes(x)
    if isinstance(x, Name):
        return x.encode("latin-1", "replace")
    raise PdfError("InvalidOperandType", "wanted a string")


def _bind(op: str, operands: list, at: int, compat: bool) -> Operator:
    out = Operator(op, at)
    kinds = KNOWN[op][1]
    if kinds == "*":
        values = list(operands)
        if compat:
            first = values.pop(0) if values else None
            out.name = str(first) if isinstance(first, Name) else None
        elif values and isinstance(values[-1], Name):
            out.name = str(values.pop())
        if not all(_is_number(v) for v in values):
            raise PdfError("InvalidOperandType", op, at)
        out.nums = [float(v) for v in values]
        return out
    if len(operands) != len(kinds):
        raise PdfError("IncorrectOperandCount", f"{op} takes {len(kinds)}, has {len(operands)}", at)
    for kind, value in zip(kinds, operands, strict=True):
        if kind == "n" and _is_number(value):
            out.nums.append(float(value))
        elif kind == "u" and _is_number(value) and 0 <= value < 256:
            if int(value) > _LIMITS[op]:
                raise PdfError("InvalidOperandValue", f"{op} {value}", at)
            out.nums.append(float(int(value)))
        elif kind == "N" and isinstance(value, (Name, Text, Hex)):
            out.name = value.decode("utf-8", "replace") if isinstance(value, Hex) else str(value)
        elif kind == "S" and isinstance(value, (Name, Text, Hex)):
            out.text = _string(value)
        elif kind == "A" and isinstance(value, list) and all(_is_number(v) for v in value):
            out.nums += [float(v) for v in value]
        elif kind == "D" and (isinstance(value, dict) or (isinstance(value, Name) and not compat)):
            out.props = value if isinstance(value, dict) else {"Properties": value}
        elif kind == "E" and isinstance(value, list):
            out.elems = []
            for v in value:
                if _is_number(v):
                    out.elems.append(("adjustment", None, float(v)))
                else:
                    out.elems.append(("hex" if isinstance(v, Hex) else "text", _string(v), None))
        else:
            raise PdfError("InvalidOperandType", f"{op} wants {kind}", at)
    return out


def _inline_image(scanner: Scanner, at: int) -> Operator:
    """The rest of BI: entries, ID, data, EI."""
    entries = {}
    while True:
        scanner.space()
        if scanner.byte() != 0x2F:
            break
        key = scanner.name()
        entries[key] = scanner.value()
    if scanner.data[scanner.at : scanner.at + 2] != b"ID":
        raise PdfError("InvalidKeyword", "ID", scanner.at)
    start = scanner.at + 3
    end = re.compile(rb"[ \t\n\r]EI(?=[ \t\n\r]|$)").search(scanner.data, start)
    if not end:
        raise PdfError("UnexpectedEndOfFile", "EI", scanner.at)
    scanner.at = end.end()
    return Operator("BI", at, props=entries, text=scanner.data[start : end.start()])


def parse(data: bytes, compat: bool = False) -> tuple[list[Operator], PdfError | None]:
    """Operators in order, and the error that ended the stream early, if one did."""
    scanner, out, operands = Scanner(data, strict=compat), [], []
    common = None if compat else _COMMON.match
    try:
        while True:
            while common and not operands and (m := common(data, scanner.at)):
                numbers, word, text, _, name, size, _ = m.groups()
                if word is not None:
                    if word not in _PLAIN:
                        break
                    word, count = _PLAIN[word]
                    values = list(map(float, numbers.split())) if numbers else []
                    if len(values) != count:
                        break
                    out.append(Operator(word, m.start(2), values))
                elif text is not None:
                    out.append(Operator("Tj", m.start(4), text=text))
                else:
                    out.append(Operator("Tf", m.start(7), [float(size)], name.decode()))
                scanner.at = m.end()
            scanner.space()
            b = scanner.byte()
            if b < 0:
                return out, None
            if b == 0x25 and not (compat and scanner.byte(1) == 0x25):
                scanner.comment()
                continue
            if compat and (b in b"\x00\t'\"{}" or b >= 0x80):
                return out, None
            m = (_OPERATOR_COMPAT if compat else _OPERATOR).match(data, scanner.at)
            if not m:
                operands.append(scanner.value())
                continue
            at, word = scanner.at, m[0].decode()
            if m[0][:1].isalpha() is False and word[0] in "*1":
                operands.append(scanner.value())
                continue
            scanner.at = m.end()
            if not compat and word in ("true", "false", "null"):
                operands.append({"true": True, "false": False, "null": None}[word])
                continue
            if word not in (OPERATORS if compat else KNOWN):
                if compat:
                    raise PdfError("UnknownOperator", word, at)
                out.append(Operator(word, at))
                operands = []
                continue
            if word == "BI" and not compat:
                out.append(_inline_image(scanner, at))
                continue
            if word == "ID" and compat:
                raise PdfError("UnimplementedOperation", "inline image data", at)
            out.append(_bind(word, operands, at, compat))
            operands = []
    except PdfError as e:
        e.stage = "content"
        return out, e
