"""PDF files as tables.

Files come as rows (doc_id, content), from ``binaryFile``, from the ``pdf``
data source or from any table with a binary column. Each table function is one
pass over those rows: a document is parsed by the task that has it, nothing is
shuffled, and memory is one document. One bad document never fails a job: what
was read before the fault is kept, and the fault is a row whose ``_error`` has
stage, kind, message and byte offset. ``mode="FAILFAST"`` raises instead.
A fault of any kind counts, also one that the parser did not foresee (its stage
is ``internal``), and a value that a column cannot hold.

Null content is a document with an error; repeated documents give repeated rows.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quire.operators import pdf_document as D
from quire.sources.pdf_syntax import Comment, Hex, Indirect, Name, PdfError, Ref, Stream, Text, Trailer, Xref, objects

ERROR = "_error struct<stage:string,kind:string,message:string,offset:long>"

SCHEMAS = {
    "objects": f"ord int, kind string, obj_num int, gen_num int, value string, stream_data binary, {ERROR}",
    "nodes": f"obj_num int, node_id int, parent_id int, key string, idx int, tag string, i long, r double, s string, b binary, ref int, {ERROR}",
    "xref_entries": f"ord int, first_obj long, byte_offset long, generation int, status string, {ERROR}",
    "trailers": f"ord int, value string, startxref long, {ERROR}",
    "versions": f"major int, minor int, {ERROR}",
    "pages": f"page_index int, obj_num int, media_box struct<left:long,top:long,right:long,bottom:long>, {ERROR}",
    "content_ops": f"page_index int, op_ord int, op string, op_name string, nums array<float>, name string, text binary, elems array<struct<kind:string,bytes:binary,amount:float>>, props string, nth int, {ERROR}",
    "op_counts": f"op string, n long, {ERROR}",
    "tree": f"obj_num int, kind string, pages int, kids array<int>, {ERROR}",
    "op_trace": f"page_index int, op_ord int, depth int, op_name string, operands array<struct<kind:string,number:double,text:string>>, nth int, {ERROR}",
    "trace_counts": f"op_name string, depth int, n long, {ERROR}",
    "resources": f"page_index int, kind string, name string, ref int, value string, {ERROR}",
}

# Rows, and bytes of documents, that are built together.
_ROWS, _BYTES = 2000, 4 << 20


def tagged(value: object) -> object:
    """A value as JSON that keeps its type: {"tag": value}."""
    if isinstance(value, Name):
        return {"name": str(value)}
    if isinstance(value, Text):
        return {"text": str(value)}
    if isinstance(value, Hex):
        return {"hex": value.hex()}
    if isinstance(value, Ref):
        return {"ref": value.num}
    if isinstance(value, Comment):
        return {"comment": value.text}
    if isinstance(value, Indirect):
        return {"indirect": [value.num, value.gen, tagged(value.value)]}
    if isinstance(value, Stream):
        return {"stream": [value.num, value.gen, tagged(value.dict)]}
    if isinstance(value, list):
        return {"array": [tagged(v) for v in value]}
    if isinstance(value, dict):
        return {"dict": {k: tagged(v) for k, v in value.items()}}
    if value is None:
        return {"null": None}
    return {"bool" if isinstance(value, bool) else "int" if isinstance(value, int) else "real": value}


def _json(value: object) -> str:
    return json.dumps(tagged(value), ensure_ascii=False)


def _kind(value: object) -> str:
    return type(value).__name__.lower() if isinstance(value, (Indirect, Stream, Ref, Trailer, Xref, Comment)) else next(iter(tagged(value)))


def _objects(data: bytes, options: dict) -> Iterator[dict]:
    columns = options["columns"]
    valued = columns is None or "value" in columns
    for n, (_, value) in enumerate(objects(data, options["strict"])):
        row = {"ord": n, "kind": _kind(value)}
        if isinstance(value, (Indirect, Stream, Ref)):
            row |= {"obj_num": value.num, "gen_num": getattr(value, "gen", None)}
        if isinstance(value, Stream):
            row["stream_data"] = value.data
        if valued and not isinstance(value, Xref):
            row["value"] = _json(value.value if isinstance(value, Indirect) else value.dict if isinstance(value, (Stream, Trailer)) else value)
        yield row


def _nodes(data: bytes, options: dict) -> Iterator[dict]:
    for _, top in objects(data, options["strict"]):
        if not isinstance(top, (Indirect, Stream)):
            continue
        counter = iter(range(1 << 31))
        todo = [(top.value if isinstance(top, Indirect) else top.dict, None, None, None)]
        while todo:
            value, parent, key, idx = todo.pop()
            me = next(counter)
            row = {"obj_num": top.num, "node_id": me, "parent_id": parent, "key": key, "idx": idx, "tag": next(iter(tagged(value)))}
            if isinstance(value, Ref):
                row["ref"] = value.num
            elif isinstance(value, bool):
                row["i"] = int(value)
            elif isinstance(value, int):
                row["i"] = value if -(1 << 63) <= value < 1 << 63 else None
            elif isinstance(value, float):
                row["r"] = value
            elif isinstance(value, Name):
                row["s"] = str(value)
            elif isinstance(value, Text):
                row |= {"s": str(value), "b": value.raw}
            elif isinstance(value, Hex):
                row["b"] = bytes(value)
            elif isinstance(value, dict):
                todo += [(v, me, k, None) for k, v in reversed(value.items())]
            elif isinstance(value, list):
                todo += [(v, me, None, i) for i, v in reversed(list(enumerate(value)))]
            if me == 0 and isinstance(top, Stream):
                row["b"] = top.data
            yield row


def _xrefs(data: bytes, options: dict) -> Iterator[dict]:
    n = 0
    for _, value in objects(data, options["strict"]):
        if isinstance(value, Xref):
            for offset, generation, status in value.entries:
                yield {"ord": n, "first_obj": value.first, "byte_offset": offset, "generation": generation, "status": status}
                n += 1


def _trailers(data: bytes, options: dict) -> Iterator[dict]:
    n = 0
    for _, value in objects(data, options["strict"]):
        if isinstance(value, Trailer):
            yield {"ord": n, "value": _json(value.dict), "startxref": value.startxref}
            n += 1


def _versions(data: bytes, options: dict) -> Iterator[dict]:
    from quire.sources.pdf_syntax import Scanner

    major, minor = Scanner(data, options["strict"]).header()
    yield {"major": major, "minor": minor}


def error_struct(e: PdfError) -> dict:
    return {"stage": e.stage, "kind": e.kind, "message": e.message, "offset": e.offset}


def _pages(data: bytes, options: dict) -> Iterator[dict]:
    document = D.load(data, options["strict"])
    for i, (num, page) in enumerate(document.pages()):
        row = {"page_index": i, "obj_num": num}
        try:
            box = D.media_box(page)
            row["media_box"] = dict(zip(("left", "top", "right", "bottom"), box, strict=True)) if box else None
        except PdfError as e:
            row["_error"] = error_struct(e)
        yield row


def operator_row(op) -> dict:
    from quire.sources.content import KNOWN

    return {
        "op": op.op,
        "op_name": KNOWN[op.op][0] if op.op in KNOWN else None,
        "nums": op.nums,
        "name": op.name,
        "text": op.text,
        "elems": None if op.elems is None else [{"kind": k, "bytes": b, "amount": a} for k, b, a in op.elems],
        "props": None if op.props is None else _json(op.props),
    }


def _tree(data: bytes, options: dict) -> Iterator[dict]:
    """The objects that make up the page tree: catalogs, inner nodes and pages."""
    for _, value in objects(data, options["strict"]):
        entries = value.value if isinstance(value, Indirect) else None
        if isinstance(entries, dict) and isinstance(entries.get("Type"), Name):
            pages, kids = entries.get("Pages"), entries.get("Kids")
            kids = [k.num for k in kids if isinstance(k, Ref)] if isinstance(kids, list) else None
            yield {"obj_num": value.num, "kind": str(entries["Type"]), "pages": pages.num if isinstance(pages, Ref) else None, "kids": kids}


def _trace(data: bytes, options: dict) -> Iterator[dict]:
    """Every operator in order as it would be carried out: how deep in saved states, and its operands by kind."""
    from quire.sources.content import KNOWN

    document, wanted, nth = D.load(data, options["strict"]), _wanted(options), Counter()
    shown = options["columns"] is None or "operands" in options["columns"]
    for i, (_, page) in enumerate(document.pages()):
        depth = 0
        ops, error = document.operators(page, options["compat"])
        for n, op in enumerate(ops):
            depth = max(0, depth - (op.op == "Q"))
            at = nth[op.op]
            nth[op.op] += 1
            if not wanted(op.op):
                depth += op.op == "q"
                continue
            if not shown:
                row = {"page_index": i, "op_ord": n, "depth": depth, "op_name": KNOWN[op.op][0] if op.op in KNOWN else None, "nth": at}
                yield row if op.op in KNOWN else row | {"_error": error_struct(PdfError("UnknownOperator", op.op, op.offset, stage="content"))}
                depth += op.op == "q"
                continue
            operands = [{"kind": "number", "number": x} for x in op.nums]
            if op.name is not None:
                operands.append({"kind": "name", "text": op.name})
            if op.text is not None:
                operands.append({"kind": "string", "text": op.text.decode("utf-8", "replace")})
            for kind, raw, amount in op.elems or ():
                operands.append({"kind": kind, "number": amount, "text": None if raw is None else raw.decode("utf-8", "replace")})
            if op.props is not None:
                operands.append({"kind": "properties", "text": _json(op.props)})
            unknown = {} if op.op in KNOWN else {"_error": error_struct(PdfError("UnknownOperator", op.op, op.offset, stage="content"))}
            yield {"page_index": i, "op_ord": n, "depth": depth, "op_name": KNOWN[op.op][0] if op.op in KNOWN else None, "operands": operands, "nth": at} | unknown
            depth += op.op == "q"
        if error:
            yield {"page_index": i, "op_ord": len(ops), "depth": depth, "_error": error_struct(error)}


def _wanted(options: dict) -> Callable[[str], bool]:
    """Whether an operator's row is asked for; those of unknown ones are faults and always are."""
    from quire.sources.content import KNOWN

    ops = options.get("ops")
    return (lambda op: True) if ops is None else (lambda op: op in ops or op not in KNOWN)


def _trace_counts(data: bytes, options: dict) -> Iterator[dict]:
    """How often each operator stands at each depth of saved states; faults follow, each a row."""
    counts, faults, end = Counter(), [], None
    try:
        for row in _trace(data, options | {"columns": ["op_name", "depth"]}):
            if "_error" in row:
                faults.append(row | {"n": 1})
            else:
                counts[row["op_name"], row["depth"]] += 1
    except Exception as e:
        end = e
    for (name, depth), n in counts.items():
        yield {"op_name": name, "depth": depth, "n": n}
    yield from faults
    if end is not None:
        raise end


def _op_counts(data: bytes, options: dict) -> Iterator[dict]:
    """How often each operator stands in the document; faults follow, each a row."""
    from quire.sources.content import KNOWN

    counts, faults, end = Counter(), [], None
    document = D.load(data, options["strict"])
    try:
        for _, page in document.pages():
            try:
                ops, error = document.operators(page, options["compat"])
            except PdfError as e:
                ops, error = [], e
            counts.update([op.op for op in ops])
            faults += [{"op": op.op, "n": 1, "_error": error_struct(PdfError("UnknownOperator", op.op, op.offset, stage="content"))} for op in ops if op.op not in KNOWN]
            if error:
                faults.append({"n": 1, "_error": error_struct(error)})
    except Exception as e:
        end = e
    for op, n in counts.items():
        if op in KNOWN:
            yield {"op": op, "n": n}
    yield from faults
    if end is not None:
        raise end


def _content(data: bytes, options: dict) -> Iterator[dict]:
    from quire.sources.content import KNOWN

    document, wanted, nth = D.load(data, options["strict"]), _wanted(options), Counter()
    bare = options["columns"] is not None and set(options["columns"]) <= {"page_index", "op_ord", "op"}
    for i, (_, page) in enumerate(document.pages()):
        try:
            ops, error = document.operators(page, options["compat"])
        except PdfError as e:
            ops, error = [], e
        for n, op in enumerate(ops):
            if bare and op.op in KNOWN and "ops" not in options:
                yield {"page_index": i, "op_ord": n, "op": op.op}
                continue
            at = nth[op.op]
            nth[op.op] += 1
            if not wanted(op.op):
                continue
            unknown = {} if op.op in KNOWN else {"_error": error_struct(PdfError("UnknownOperator", op.op, op.offset, stage="content"))}
            row = {"op": op.op} if bare else operator_row(op)
            yield {"page_index": i, "op_ord": n, "nth": at} | row | unknown
        if error:
            yield {"page_index": i, "op_ord": len(ops), "_error": error_struct(error)}


def _resources(data: bytes, options: dict) -> Iterator[dict]:
    document = D.load(data, options["strict"])
    valued = options["columns"] is None or "value" in options["columns"]
    for i, (_, page) in enumerate(document.pages()):
        try:
            for kind, entries in D.resources(document, page).items():
                for name, value in entries.items():
                    found = document.resolve(value)
                    row = {"page_index": i, "kind": kind, "name": name, "ref": value.num if isinstance(value, Ref) else None}
                    yield row | {"value": _json(found.dict if isinstance(found, Stream) else found)} if valued else row
        except PdfError as e:
            yield {"page_index": i, "_error": error_struct(e)}


_READERS: dict[str, Callable[[bytes, dict], Iterator[dict]]] = {
    "objects": _objects,
    "nodes": _nodes,
    "xref_entries": _xrefs,
    "trailers": _trailers,
    "versions": _versions,
    "pages": _pages,
    "content_ops": _content,
    "resources": _resources,
    "tree": _tree,
    "op_trace": _trace,
    "op_counts": _op_counts,
    "trace_counts": _trace_counts,
}


def _fault(doc_id: object, e: Exception) -> dict:
    if not isinstance(e, PdfError):
        e = PdfError(type(e).__name__, str(e)[:200], stage="internal")
    return {"doc_id": doc_id, "_error": error_struct(e)}


def _table(rows: list[tuple[int, dict]], schema: pa.Schema, fast: bool) -> pa.RecordBatch:
    """Rows with how often each stands there, as columns. A row that no column can hold is a fault."""
    try:
        columns = []
        for f in schema:
            values: list = []
            for n, row in rows:
                value = row.get(f.name)
                values += [value] * n if n > 1 else (value,)
            columns.append(pa.array(values, f.type))
        return pa.RecordBatch.from_arrays(columns, schema=schema)
    except (pa.ArrowException, OverflowError, TypeError, ValueError) as e:
        if fast:
            raise
        if len(rows) == 1:
            return _table([(1, _fault(rows[0][1]["doc_id"], e))], schema, True)
        parts = [_table([row], schema, fast) for row in rows]
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def rows_of(doc_id: object, data: bytes | None, reader: Callable[[bytes, dict], Iterator], options: dict, fast: bool) -> Iterator[tuple[int, dict]]:
    """A document's rows and how often each stands there; a fault of any kind is its last row unless ``fast``."""
    try:
        if data is None:
            raise PdfError("MissingContent", stage="load")
        for row in reader(data, options):
            n, row = row if isinstance(row, tuple) else (1, row)
            row["doc_id"] = doc_id
            yield n, row
    except MemoryError:
        raise
    except Exception as e:
        if fast:
            raise
        yield 1, _fault(doc_id, e)


def per_document(files: DataFrame, schema: str, reader: Callable[[bytes, dict], Iterator], columns: list[str] | None = None, **options) -> DataFrame:
    """Rows of ``reader`` for every document, with its doc_id first and its fault as an ``_error`` row.

    With ``columns`` only these and ``_error`` are built; a reader may look at them in its options.
    Instead of a row, a reader may yield (n, row) for n equal rows.
    """
    fast = options.get("mode", "PERMISSIVE").upper() == "FAILFAST"
    options = {"strict": False, "compat": False, "columns": columns} | options
    fields = [f for f in T._parse_datatype_string(schema).fields if columns is None or f.name in (*columns, "_error")]
    out = T.StructType([files.schema["doc_id"], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        rows: list[tuple[int, dict]] = []
        held = size = 0
        for b in batches:
            ids, contents = b.column(0), b.column(1)
            for k in range(b.num_rows):
                doc_id, data = ids[k].as_py(), contents[k].as_py()
                for n, row in rows_of(doc_id, data, reader, options, fast):
                    rows.append((n, row))
                    held += n
                    if held >= _ROWS:
                        yield _table(rows, arrow, fast)
                        rows, held, size = [], 0, 0
                size += len(data or b"")
                if rows and size >= _BYTES:
                    yield _table(rows, arrow, fast)
                    rows, held, size = [], 0, 0
        if rows:
            yield _table(rows, arrow, fast)

    return files.select("doc_id", "content").mapInArrow(run, out)


def read_table(files: DataFrame, name: str, strict: bool = False, compat: bool = False, mode: str = "PERMISSIVE", columns: list[str] | None = None, ops: tuple[str, ...] | None = None) -> DataFrame:
    """One of the tables in ``SCHEMAS`` of the documents in ``files`` (doc_id, content); of its columns only ``columns``, if given.

    With ``ops`` tables of operators have rows of these and of faults alone. ``nth`` of an operator
    counts those of its name that stand before it in the document.
    """
    only = {} if ops is None else {"ops": ops}
    return per_document(files, SCHEMAS[name], _READERS[name], columns, strict=strict, compat=compat, mode=mode, **only)


def read_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """(doc_id, content) of the files below ``path``; doc_id is the file's URI."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return found.select(F.col("path").alias("doc_id"), "content")


class PdfDataSource(DataSource):
    """``spark.read.format("pdf").option("table", "content_ops").load(folder)``.

    Options: table (a key of ``SCHEMAS``), strict, compat, mode (PERMISSIVE or
    FAILFAST), bytes (of a partition's files together, 64 MB unless given). Files are read by
    the tasks through ``pyarrow.fs``; for stores that only Spark reads use
    ``read_files`` and ``read_table``.
    """

    @classmethod
    def name(cls) -> str:
        return "pdf"

    def schema(self) -> str:
        return "doc_id string, " + SCHEMAS[self.options.get("table", "objects")]

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _PdfReader(dict(self.options), schema)


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _PdfReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.options, self.schema = options, schema

    def _open(self, uri: str):
        from pyarrow import fs

        if ":" not in uri.split("/", 1)[0]:
            uri = f"file://{uri}"
        return fs.FileSystem.from_uri(uri)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, base = self._open(self.options["path"])
        info = system.get_file_info(base)
        if info.type == fs.FileType.File:
            return [_Files([base])]
        found = system.get_file_info(fs.FileSelector(base, recursive=True))
        most, parts, size = int(self.options.get("bytes", 64 << 20)), [], 0
        for x in sorted(found, key=lambda x: x.path):
            if x.type == fs.FileType.File and x.path.endswith(".pdf"):
                if not parts or size + x.size > most:
                    parts.append(_Files([]))
                    size = 0
                parts[-1].paths.append(x.path)
                size += x.size
        return parts

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        system, _ = self._open(self.options["path"])
        options = {k: self.options.get(k, "false").lower() == "true" for k in ("strict", "compat")} | {"columns": None}
        fast = self.options.get("mode", "PERMISSIVE").upper() == "FAILFAST"
        arrow = to_arrow_schema(self.schema)
        for path in partition.paths:
            with system.open_input_file(path) as f:
                data = f.read()
            rows = list(rows_of(path, data, _READERS[self.options.get("table", "objects")], options, fast))
            if rows:
                yield _table(rows, arrow, fast)


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes each document (doc_id, content) to ``folder``; returns (doc_id, path, bytes).

    Each task's attempt has a folder of its own, and only files in the returned table
    count; it is written before it is returned, and lost tasks leave nothing in it.
    """
    from quire.session import materialize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        system, base = fs.FileSystem.from_uri(folder if ":" in folder.split("/", 1)[0] else f"file://{folder}")
        attempt, n = TaskContext.get().taskAttemptId(), 0
        system.create_dir(f"{base}/{attempt:08d}", recursive=True)
        for batch in batches:
            paths, sizes = [], []
            for value in batch.column(1):
                data, name = value.as_py(), f"{attempt:08d}/{n:08d}.pdf"
                with system.open_output_stream(f"{base}/{name}") as out:
                    out.write(data or b"")
                paths.append(f"{folder}/{name}")
                sizes.append(len(data or b""))
                n += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["doc_id", "path", "bytes"])

    out = T.StructType([files.schema["doc_id"], T.StructField("path", T.StringType()), T.StructField("bytes", T.LongType())])
    return materialize(files.select("doc_id", "content").mapInArrow(run, out), "pdf-manifest")


def read_written(manifest: DataFrame) -> DataFrame:
    """(doc_id, content) of the files in a table of ``write_files``; doc_id has that of the document and the path.

    Each task opens the files that its rows name, so nobody lists the folder: the
    driver's memory and the number of tasks do not grow with the number of files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            ids, paths = batch.column(0), batch.column(1)
            found, size, first = [], 0, 0
            for k in range(batch.num_rows):
                path = paths[k].as_py()
                system, at = fs.FileSystem.from_uri(path if ":" in path.split("/", 1)[0] else f"file://{path}")
                with system.open_input_file(at) as f:
                    found.append(f.read())
                size += len(found[-1])
                if size >= _BYTES or k + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([ids.slice(first, len(found)), pa.array(found, pa.binary())], names=["doc_id", "content"])
                    found, size, first = [], 0, k + 1

    named = manifest.select(F.struct("doc_id", "path").alias("doc_id"), "path")
    dealt = named.repartition(max(named.rdd.getNumPartitions(), 4 * named.sparkSession.sparkContext.defaultParallelism))
    return dealt.mapInArrow(run, T.StructType([named.schema["doc_id"], T.StructField("content", T.BinaryType())]))
