"""The object graph of one document: lookups, pages, resources.

Plain Python over one document's values; Spark runs it per document. The
relational form of the same lookups is in ``quire.operators.graph``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from quire.sources import content
from quire.sources.pdf_syntax import Hex, Indirect, Name, PdfError, Ref, Stream, Text, Trailer, Xref, objects

MAX_HOPS = 16


@dataclass
class Document:
    version: tuple[int, int]
    values: dict[int, object]
    trailer: Trailer | None
    xrefs: list[Xref] = field(default_factory=list)

    # -- lookups -------------------------------------------------------------------------

    def resolve(self, value: object) -> object:
        """Follows references, at most ``MAX_HOPS``; an indirect object gives its payload once."""
        start = value
        for _ in range(MAX_HOPS):
            if not isinstance(value, Ref):
                return value
            if value.num not in self.values:
                raise PdfError("FailedResolveObjectReference", str(value.num), stage="resolve")
            value = self.values[value.num]
            if isinstance(value, Indirect):
                return value.value
        return start

    def dictionary(self, value: object) -> dict:
        value = self.resolve(value)
        if isinstance(value, Stream):
            return value.dict
        if isinstance(value, dict):
            return value
        raise PdfError("TypeMismatch", "wanted a dictionary", stage="resolve")

    def stream(self, value: object) -> Stream:
        value = self.resolve(value)
        if isinstance(value, Stream):
            return value
        raise PdfError("TypeMismatch", "wanted a stream", stage="resolve")

    # -- pages ---------------------------------------------------------------------------

    def pages(self) -> Iterator[tuple[int, dict]]:
        """(object number, dictionary) of the pages in order; a node that is met again is an error.

        The walk keeps its own stack, so a tree may be as deep as it likes, and
        as each node is met once, there are at most as many pages as objects.
        """
        if self.trailer is None:
            raise PdfError("MissingTrailer", stage="pages")
        root = self.dictionary(need(self.trailer.dict, "Root"))
        seen: set[int] = set()
        stack = [need(root, "Pages")]
        while stack:
            node = stack.pop()
            num = node.num if isinstance(node, Ref) else -1
            if num in seen:
                raise PdfError("Cycle", f"page tree node {num}", stage="pages")
            seen.add(num)
            entries = self.dictionary(node)
            kind = entries.get("Type")
            if kind == "Page" and isinstance(kind, Name):
                yield num, entries
            elif kind == "Pages" and isinstance(kind, Name):
                kids = need(entries, "Kids")
                if not isinstance(kids, list):
                    raise PdfError("TypeMismatch", "Kids", stage="pages")
                if not all(isinstance(kid, Ref) for kid in kids):
                    raise PdfError("TypeMismatch", "Kids holds references", stage="pages")
                stack += reversed(kids)
            else:
                raise PdfError("UnexpectedType", str(kind), stage="pages")

    def operators(self, page: dict, compat: bool = False) -> tuple[list[content.Operator], PdfError | None]:
        """A page's operators: its streams are parsed one by one and follow each other."""
        contents = page.get("Contents")
        if contents is None:
            return [], None
        value = self.resolve(contents)
        out = []
        for part in value if isinstance(value, list) else [contents]:
            ops, error = content.parse(self.stream(part).data, compat)
            out += ops
            if error:
                return out, error
        return out, None


def need(entries: dict, key: str) -> object:
    if key not in entries:
        raise PdfError("MissingRequiredKey", key, stage="resolve")
    return entries[key]


def load(data: bytes, strict: bool = False) -> Document:
    """Scans a file up to its first end-of-file marker. A repeated object number is an error."""
    from quire.sources.pdf_syntax import Scanner

    version = Scanner(data, strict).header()
    document = Document(version, {}, None)
    for at, value in objects(data, strict):
        if isinstance(value, (Indirect, Stream, Ref)):
            if value.num in document.values:
                raise PdfError("DuplicateKeyInObjectCollection", str(value.num), at)
            document.values[value.num] = value
        elif isinstance(value, Trailer):
            document.trailer = value
        elif isinstance(value, Xref):
            document.xrefs.append(value)
    return document


# -- typed readers -----------------------------------------------------------------------


def number(value: object, what: str = "number") -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise PdfError("TypeMismatch", what, stage="resolve")
    return float(value)


def numbers(value: object, count: int | None, what: str) -> list[float]:
    if not isinstance(value, list):
        raise PdfError("TypeMismatch", what, stage="resolve")
    if count is not None and len(value) != count:
        raise PdfError("InvalidArrayLength", what, stage="resolve")
    return [number(v, what) for v in value]


def text(value: object) -> str:
    if isinstance(value, (Name, Text)):
        return str(value)
    if isinstance(value, Hex):
        return value.decode("utf-8", "replace")
    raise PdfError("TypeMismatch", "wanted a name or string", stage="resolve")


def media_box(page: dict) -> tuple[int, int, int, int] | None:
    """(left, top, right, bottom); fractions are cut off, negative values are an error."""
    if "MediaBox" not in page:
        return None
    left, bottom, right, top = (int(v) for v in numbers(page["MediaBox"], 4, "MediaBox"))
    if min(left, bottom, right, top) < 0:
        raise PdfError("NumberConversionError", "MediaBox", stage="resolve")
    return left, top, right, bottom


def matrix(entries: dict, key: str = "Matrix") -> tuple[float, ...] | None:
    return tuple(numbers(entries[key], 6, key)) if key in entries else None


#: Resource kinds that are read; each must be a direct dictionary.
RESOURCES = ("Font", "ExtGState", "Pattern", "XObject", "Shading")


def resources(document: Document, owner: dict) -> dict[str, dict[str, object]]:
    """name -> value of each resource kind of a page or form."""
    if "Resources" not in owner:
        return {}
    entries = document.dictionary(owner["Resources"])
    out = {}
    for kind in RESOURCES:
        if kind in entries:
            if not isinstance(entries[kind], dict):
                raise PdfError("TypeMismatch", kind, stage="resources")
            out[kind] = entries[kind]
    return out
