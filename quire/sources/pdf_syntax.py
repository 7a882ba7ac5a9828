"""Syntax of PDF files: bytes to values, without Spark.

Values keep what must stay distinguishable: names, literal strings, hex
strings, references, integers, reals, booleans and null are different types.

``strict`` reads exactly what the conformance cases allow (white space only
where the grammar names it, the first end-of-file marker ends the file).
Otherwise white space and NUL may stand between any two tokens, and literal
strings keep their raw bytes beside the text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

BLANK = b" \t\n\r\x0c"
DELIMITERS = frozenset(b" \t\n\r\x0c()<>[]{}/%")
MAX_DEPTH = 32
I64 = 1 << 63


class PdfError(ValueError):
    """A syntax or structure error: what kind, where in the file."""

    def __init__(self, kind: str, message: str = "", offset: int = -1, stage: str = "parse"):
        super().__init__(f"{kind}: {message}")
        self.kind, self.message, self.offset, self.stage = kind, message, offset, stage


class Name(str):
    __slots__ = ()


@dataclass(frozen=True)
class Text:
    """A literal string; ``str()`` replaces bytes that are no UTF-8."""

    raw: bytes

    def __str__(self) -> str:
        return self.raw.decode("utf-8", "replace")


class Hex(bytes):
    __slots__ = ()


@dataclass(frozen=True)
class Ref:
    num: int


@dataclass(frozen=True)
class Comment:
    text: str


@dataclass(frozen=True)
class Indirect:
    num: int
    gen: int
    value: object


@dataclass(frozen=True)
class Stream:
    num: int
    gen: int
    dict: dict
    data: bytes


@dataclass(frozen=True)
class Trailer:
    dict: dict
    startxref: int


@dataclass(frozen=True)
class Xref:
    first: int
    entries: list = field(default_factory=list)  # (offset, generation, status)


class Eof:
    """The end-of-file marker."""


EOF = Eof()
_DIGITS, _LINE, _NOT_PAREN = re.compile(rb"\d+"), re.compile(rb"[^\r\n]*"), re.compile(rb"[^()]*")
_NAME = re.compile(rb"[^ \t\n\r\x0c()<>\[\]{}/%]+")
_SPACE, _LOOSE = re.compile(rb"[ \t\n\r\x0c]*"), re.compile(rb"[\x00 \t\n\r\x0c]*")
# Short cuts: what these match is read as the productions below read it; whatever they do not match goes through those.
_INTEGER = re.compile(rb"(\d{1,18})(?=[ \t\n\r\x0c()<>\[\]{}/%]|\Z)(?![\x00 \t\n\r\x0c]+\d+[\x00 \t\n\r\x0c]*(?:R|obj))[ \t\n\r\x0c]*+(?!\x00)")
_INTEGERS = re.compile(rb"\[[ \t\n\r\x0c]*((?:\d{1,18}[ \t\n\r\x0c]+)*\d{1,18})[ \t\n\r\x0c]*\]")
_REF = re.compile(rb"(\d{1,9})[ \t\n\r\x0c]+\d{1,9}[ \t\n\r\x0c]+R(?=[ \t\n\r\x0c()<>\[\]{}/%]|\Z)")
_OBJECT = re.compile(rb"(\d{1,9})[ \t\n\r\x0c]+(\d{1,9})[ \t\n\r\x0c]+obj(?=[ \t\n\r\x0c()<>\[\]{}/%]|\Z)\r?\n?")
# A key with a name, a reference or an integer.
_KEYED = re.compile(
    rb"/([A-Za-z0-9_.+-]++)[ \t\n\r\x0c]*+(?:/([A-Za-z0-9_.+-]++)(?=[ \t\n\r\x0c()<>\[\]{}/%]|\Z)|(\d{1,9})[ \t\n\r\x0c]+\d{1,9}[ \t\n\r\x0c]+R(?=[ \t\n\r\x0c()<>\[\]{}/%]|\Z)"
    rb"|(\d{1,18})(?=[ \t\n\r\x0c()<>\[\]{}/%]|\Z)(?![\x00 \t\n\r\x0c]+\d+[\x00 \t\n\r\x0c]*(?:R|obj)))[ \t\n\r\x0c]*+(?!\x00)"
)
_ENTRY = re.compile(rb"(\d{1,18})[ \t\n\r\x0c]+(\d{1,18})[ \t\n\r\x0c]+([nfo])[ \t\n\r\x0c]*+(?!\x00)")


class Scanner:
    def __init__(self, data: bytes, strict: bool = True, at: int = 0):
        self.data, self.strict, self.at, self.depth = data, strict, at, 0
        self.blank = (_SPACE if strict else _LOOSE).match

    # -- small steps ---------------------------------------------------------------------

    def fail(self, kind: str, message: str = "") -> PdfError:
        return PdfError(kind, message, self.at)

    def byte(self, ahead: int = 0) -> int:
        at = self.at + ahead
        return self.data[at] if at < len(self.data) else -1

    def space(self) -> None:
        self.at = self.blank(self.data, self.at).end()

    def loose(self) -> None:
        if not self.strict:
            self.space()

    def line_end(self) -> None:
        """An optional carriage return, then an optional line feed."""
        if self.byte() == 13:
            self.at += 1
        if self.byte() == 10:
            self.at += 1

    def expect(self, token: bytes) -> None:
        if not self.data.startswith(token, self.at):
            raise self.fail("UnexpectedToken", f"wanted {token!r}")
        self.at += len(token)

    def delimited(self, also: bytes = b"") -> None:
        b = self.byte()
        if b >= 0 and b not in DELIMITERS and b not in also:
            raise self.fail("MissingDelimiterAfterKeyword", repr(bytes([b])))

    def keyword(self, word: bytes) -> None:
        self.loose()
        end = self.at + len(word)
        if self.data.startswith(word, self.at) and (end >= len(self.data) or self.data[end] in DELIMITERS):
            self.at = end
            self.line_end()
            return
        got = self.data[self.at : self.at + len(word)]
        if len(got) < len(word):
            raise self.fail("UnexpectedEndOfFile", word.decode())
        if got != word:
            raise self.fail("InvalidKeyword", f"wanted {word!r}, found {got!r}")
        self.at += len(word)
        self.delimited()
        self.line_end()

    def unsigned(self, skip: bool, limit: int = I64) -> int:
        m = _DIGITS.match(self.data, self.at)
        if not m:
            raise self.fail("UnexpectedEndOfFile", "no digits")
        value = int(m[0])
        if value >= limit:
            raise self.fail("InvalidNumber", m[0].decode())
        self.at = m.end()
        self.delimited(b".")
        if skip:
            self.space()
        return value

    # -- productions ---------------------------------------------------------------------

    def header(self) -> tuple[int, int]:
        self.expect(b"%")
        line = _LINE.match(self.data, self.at)[0]
        if not line.startswith(b"PDF-"):
            raise self.fail("InvalidPrefix", line.decode("utf-8", "replace"))
        parts = line[4:].decode("utf-8", "replace").split(".")
        if len(parts) != 2:
            raise self.fail("InvalidVersionFormat", line.decode("utf-8", "replace"))
        out = []
        for part, kind in zip(parts, ("InvalidMajorVersion", "InvalidMinorVersion"), strict=True):
            text = part if self.strict else part.strip()
            if not re.fullmatch(r"\+?[0-9]+", text) or int(text) > 255:
                raise self.fail(kind, part)
            out.append(int(text))
        self.at += len(line)
        self.line_end()
        return out[0], out[1]

    def comment(self) -> Comment:
        self.expect(b"%")
        m = _LINE.match(self.data, self.at)
        self.at = m.end()
        self.line_end()
        return Comment(m[0].decode("utf-8", "replace"))

    def word(self, word: bytes, value: object) -> object:
        if not self.data.startswith(word, self.at):
            raise self.fail("InvalidKeyword", word.decode())
        self.at += len(word)
        self.delimited()
        return value

    def number(self) -> int | float:
        sign = self.byte()
        negative = sign == 0x2D
        if sign in (0x2B, 0x2D):
            self.at += 1
        whole = 0 if self.byte() == 0x2E else self.unsigned(False)
        if self.byte() == 0x2E:
            self.at += 1
            m = _DIGITS.match(self.data, self.at)
            digits = m[0] if m else b""
            if whole == 0 and not digits:
                raise self.fail("FractionalPartError", "no digits after the point")
            self.at += len(digits)
            value = float(f"{'-' if negative else ''}{whole}.{digits.decode()}")
            b = self.byte()
            if b >= 0 and b not in DELIMITERS:
                raise self.fail("FractionalPartError", "no delimiter")
            self.space()
            return value
        self.space()
        return -whole if negative else whole

    def literal(self) -> Text:
        self.expect(b"(")
        depth, out = 0, bytearray()
        while True:
            m = _NOT_PAREN.match(self.data, self.at)
            piece, self.at = m[0], m.end()
            if not self.strict and piece.endswith(b"\\") and self.byte() >= 0 and (len(piece) - len(piece.rstrip(b"\\"))) % 2:
                out += piece + bytes([self.byte()])  # an escaped parenthesis
                self.at += 1
                continue
            out += piece
            b = self.byte()
            self.at += 1
            if b < 0:
                raise self.fail("UnbalancedParentheses")
            if b == 0x29:
                if depth == 0:
                    return Text(bytes(out))
                depth -= 1
            else:
                depth += 1
            out.append(b)

    def hexadecimal(self) -> Hex:
        self.expect(b"<")
        end = self.data.find(b">", self.at)
        digits = bytes(b for b in self.data[self.at : end if end >= 0 else len(self.data)] if b not in BLANK)
        if not re.fullmatch(rb"[0-9A-Fa-f]*", digits):
            raise self.fail("NotHexDecimal")
        if end < 0 or (self.strict and self.data.startswith(b">>", end)):
            raise self.fail("UnexpectedToken", "unterminated hex string")
        self.at = end + 1
        return Hex(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()))

    def name(self) -> Name:
        self.expect(b"/")
        m = _NAME.match(self.data, self.at)
        if not m:
            raise self.fail("InvalidToken", "empty name")
        self.at = m.end()
        if b"#" not in m[0]:
            return Name(m[0].decode("latin-1"))

        def decode(escape: re.Match) -> bytes:
            code = escape[1]
            if len(code) < 2:
                raise self.fail("IncompleteHexEscape")
            if not re.fullmatch(rb"[0-9A-Fa-f]{2}", code):
                raise self.fail("NonHexDigitInEscape", code.decode("latin-1"))
            return bytes([int(code, 16)])

        return Name(re.sub(rb"(?s)#(.{0,2})", decode, m[0]).decode("latin-1"))

    def array(self) -> list:
        m = _INTEGERS.match(self.data, self.at) if self.depth < MAX_DEPTH else None
        if m:
            self.at = m.end()
            return list(map(int, m[1].split()))
        self.expect(b"[")
        out = []
        self.space()
        while self.byte() >= 0 and self.byte() != 0x5D:
            out.append(self.value())
            self.space()
        self.expect(b"]")
        return out

    def dictionary(self) -> dict:
        self.expect(b"<<")
        out = {}
        self.space()
        keyed = _KEYED.match if self.depth < MAX_DEPTH else None
        while (b := self.byte()) >= 0 and not self.data.startswith(b">>", self.at):
            if keyed and (m := keyed(self.data, self.at)):
                key, name, ref, number = m.groups()
                out[Name(key.decode())] = Name(name.decode()) if name is not None else Ref(int(ref)) if ref is not None else int(number)
                self.at = m.end()
                continue
            if not self.strict and b == 0x25:
                self.comment()
                self.space()
                continue
            if b != 0x2F:
                raise self.fail("InvalidKey")
            key = self.name()
            self.space()
            out[key] = self.value()
            self.space()
        self.expect(b">>")
        return dict(sorted(out.items()))

    def indirect(self) -> object | None:
        """A reference, an indirect object or a stream; None if it is neither."""
        m = _OBJECT.match(self.data, self.at)
        if m:
            num, gen, self.at = int(m[1]), int(m[2]), m.end()
        else:
            try:
                num = self.unsigned(True, 1 << 31)
                gen = self.unsigned(True, 1 << 31)
            except PdfError:
                return None
            if self.byte() == 0x52 and (self.byte(1) < 0 or self.byte(1) in DELIMITERS):
                self.at += 1
                return Ref(num)
            try:
                self.keyword(b"obj")
            except PdfError:
                return None
        self.loose()
        value = self.value()
        self.space()
        if self.byte() == 0x73:
            if not isinstance(value, dict):
                raise self.fail("StreamObjectWithoutDictionary")
            data = self.stream(value)
            self.keyword(b"endobj")
            return Stream(num, gen, value, data)
        self.keyword(b"endobj")
        return Indirect(num, gen, value)

    def stream(self, entries: dict) -> bytes:
        self.keyword(b"stream")
        if "Length" not in entries:
            raise self.fail("MissingRequiredKey", "Length")
        length = entries["Length"]
        if isinstance(length, bool) or not isinstance(length, (int, float)) or length < 0:
            raise self.fail("NumberConversionError", "Length must be a direct number")
        data = self.data[self.at : self.at + int(length)]
        if len(data) < int(length):
            raise self.fail("UnexpectedEndOfFile", "stream data")
        self.at += int(length)
        if self.byte() == 13:
            self.at += 1
        self.line_end()
        self.keyword(b"endstream")
        return decode_stream(entries.get("Filter"), data, self.at)

    def xref(self) -> Xref:
        self.keyword(b"xref")
        self.space()
        first, entries = None, []
        while True:
            if first is None or self.byte(0) in b"0123456789":
                start = self._part("MissingTableEntryCount", 1 << 31)
                first = start if first is None else first
            for _ in range(self._part("MissingTableEntryCount", 1 << 32)):
                m = _ENTRY.match(self.data, self.at)
                if m and (at := int(m[1])) < 1 << 32 and (used := int(m[2])) < 1 << 16:
                    entries.append((at, used, XREF_STATUS[chr(m[3][0])]))
                    self.at = m.end()
                    continue
                offset = self._part("MissingObjectNumber", 1 << 32)
                generation = self._part("MissingGenerationNumber", 1 << 16)
                status = self.byte()
                self.at += 1
                if status < 0 or not chr(status).isascii() or not chr(status).isalpha():
                    raise self.fail("MissingStatus")
                if chr(status) not in XREF_STATUS:
                    raise self.fail("InvalidCrossReferenceStatus", chr(status))
                entries.append((offset, generation, XREF_STATUS[chr(status)]))
                self.space()
            if not 0x30 <= self.byte() <= 0x39:
                return Xref(first, entries)

    def _part(self, kind: str, limit: int) -> int:
        try:
            return self.unsigned(True, limit)
        except PdfError as e:
            raise PdfError(kind, e.message, self.at) from None

    def trailer(self) -> Trailer:
        self.keyword(b"trailer")
        self.loose()
        entries = self.value()
        if not isinstance(entries, dict):
            raise self.fail("MissingDictionary")
        self.line_end()
        self.keyword(b"startxref")
        self.loose()
        return Trailer(entries, self.unsigned(True, 1 << 32))

    def value(self) -> object:
        if self.depth >= MAX_DEPTH:
            raise self.fail("NestingDepthExceeded")
        self.depth += 1
        try:
            return self._value()
        finally:
            self.depth -= 1

    def _value(self) -> object:
        self.loose()
        b = self.byte()
        if b < 0:
            raise self.fail("UnexpectedEndOfFile")
        c = chr(b)
        if c == "%":
            if self.byte(1) == 0x25:
                self.at += 2
                if self.data[self.at : self.at + 3] != b"EOF":
                    raise self.fail("InvalidKeyword", "EOF")
                self.at += 3
                return EOF
            return self.comment()
        if c == "t":
            mark = self.at
            try:
                return self.trailer()
            except PdfError:
                self.at = mark
                return self.word(b"true", True)
        if c in "fnx":
            return self.word(b"false", False) if c == "f" else self.word(b"null", None) if c == "n" else self.xref()
        if c == "<":
            return self.dictionary() if self.byte(1) == 0x3C else self.hexadecimal()
        if c == "/":
            return self.name()
        if c.isdigit() and b < 128:
            mark = self.at
            m = _INTEGER.match(self.data, mark)
            if m:
                self.at = m.end()
                return int(m[1])
            m = _REF.match(self.data, mark)
            if m:
                self.at = m.end()
                return Ref(int(m[1]))
            found = self.indirect()
            if found is not None:
                return found
            self.at = mark
            return self.number()
        if c in "+-.":
            return self.number()
        if c == "[":
            return self.array()
        if c == "(":
            return self.literal()
        raise self.fail("InvalidToken" if c.isalpha() and b < 128 else "UnexpectedTokenAt", repr(c))


#: Status letters of cross-reference entries.
XREF_STATUS = {"n": "normal", "f": "free", "o": "compressed"}


def decode_stream(name: object, data: bytes, offset: int = -1) -> bytes:
    """Stream data after its filter; filters given as anything but a name are not applied."""
    if not isinstance(name, (Name, Text)):
        return data
    if str(name) == "FlateDecode":
        try:
            return zlib.decompress(data)
        except zlib.error as e:
            raise PdfError("DecompressionError", str(e), offset) from None
    if str(name) == "DCTDecode":
        return data
    raise PdfError("UnsupportedFilter", str(name), offset)


def objects(data: bytes, strict: bool = False) -> Iterator[tuple[int, object]]:
    """(offset, value) of a file's top-level values up to its end-of-file marker."""
    scanner = Scanner(data, strict)
    scanner.header()
    while True:
        scanner.loose()
        at = scanner.at
        value = scanner.value()
        if value is EOF:
            return
        yield at, value


def parse_value(data: bytes, strict: bool = True) -> object:
    return Scanner(data, strict).value()
