"""Python data sources over folders of text files, and one that writes a single JSON document.

``merge_listing``: status listings, a row for each line; ``merge_documents``: whole files, a row for each; both also as streams.  ``merge_blocks``: files of any size as blocks of lines for the
block-wise parser, cut by bytes, so that no task and no row holds a file.  ``merge_document``: rows as one JSON document.  Paths are of any store that Arrow's file systems know; a plain path is local.

A stream's offset is the name of the last file it has taken: files must be put into the folder whole, with names that sort after those before.  A batch takes ``filesPerBatch`` files at most.

Edge cases: an empty folder and an empty file give no rows (a document of no bytes is a row); names that begin with a dot or an underscore are left out; lines end at line feeds; bytes that are no UTF-8 are replaced.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

CHUNK = 1 << 20


def store(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a folder's files, or of the file itself, by name."""
    from pyarrow import fs

    where, root = store(path)
    info = where.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else [f for f in where.get_file_info(fs.FileSelector(root)) if f.is_file and f.base_name[0] not in "._"]
    return sorted((f.path, f.size) for f in found)


@dataclass
class Part(InputPartition):
    path: str
    start: int
    end: int


class Reader(DataSourceReader):
    """A partition for each file."""

    def __init__(self, options: dict, kind: str):
        self.root, self.kind = options["path"], kind

    def partitions(self) -> list[Part]:
        return [Part(p, 0, n) for p, n in listed(self.root)]

    def read(self, part: Part) -> Iterator[tuple]:
        where, _ = store(self.root)
        with where.open_input_stream(part.path) as f:
            if self.kind == "documents":
                yield part.path, f.read().decode(errors="replace")
                return
            for n, line in enumerate(lines_of(f)):
                if len(line) >= 3:
                    yield part.path, n + 1, line[:2], line[3:].strip()


def lines_of(f) -> Iterator[str]:
    """The lines of a stream of bytes, read in chunks; what follows the last line feed is one if it is not empty."""
    rest = b""
    while chunk := f.read(CHUNK):
        *whole, rest = (rest + chunk).split(b"\n")
        for line in whole:
            yield line.decode(errors="replace")
    if rest:
        yield rest.decode(errors="replace")


class StreamReader(DataSourceStreamReader):
    """Files by name; an offset is the last one taken."""

    def __init__(self, options: dict, kind: str):
        self.root, self.kind, self.most, self.at = options["path"], kind, int(options.get("filesPerBatch", "1000")), None

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        # Up to so many files after the last batch planned; a restarted stream learns its place from the first batch it plans.
        later = [p for p, _ in listed(self.root) if p > (self.at or "")]
        return {"after": later[: self.most][-1] if later else self.at or ""}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        self.at = end["after"]
        return [Part(p, 0, n) for p, n in listed(self.root) if start["after"] < p <= end["after"]]

    def read(self, part: Part) -> Iterator[tuple]:
        return Reader({"path": self.root}, self.kind).read(part)

    def commit(self, end: dict) -> None:
        self.at = max(self.at or "", end["after"])


class Listing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "merge_listing"

    def schema(self) -> str:
        return "listing string, line_no long, status string, path string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(self.options, "listing")

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return StreamReader(self.options, "listing")


class Documents(DataSource):
    @classmethod
    def name(cls) -> str:
        return "merge_documents"

    def schema(self) -> str:
        return "path string, text string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(self.options, "documents")

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return StreamReader(self.options, "documents")


class BlockReader(DataSourceReader):
    """Byte ranges of files; a range has the lines that begin in it, as blocks numbered by where they begin."""

    def __init__(self, options: dict):
        self.root, self.bytes, self.lines = options["path"], int(options.get("rangeBytes", str(32 << 20))), int(options.get("blockLines", "10000"))

    def partitions(self) -> list[Part]:
        return [Part(p, a, min(a + self.bytes, n)) for p, n in listed(self.root) for a in range(0, max(n, 1), self.bytes)]

    def read(self, part: Part) -> Iterator[tuple]:
        where, _ = store(self.root)
        with where.open_input_file(part.path) as f:
            at = max(part.start - 1, 0)
            f.seek(at)
            if part.start:  # the line that is open here belongs to the range before, unless that ends with a line feed
                while (chunk := f.read(CHUNK)) and b"\n" not in chunk:
                    at += len(chunk)
                if not chunk:
                    return
                at += chunk.index(b"\n") + 1
                f.seek(at)
            size, block, first, rest = f.size(), [], at, b""
            # A range takes the lines that begin before its end; the last one also what follows the last line feed, even if that is nothing.
            while at < part.end or (part.end == size and at == size):
                cut = rest.find(b"\n")
                while cut < 0 and (chunk := f.read(CHUNK)):
                    cut = chunk.find(b"\n") + len(rest) if b"\n" in chunk else -1
                    rest += chunk
                line, rest = (rest, b"") if cut < 0 else (rest[:cut], rest[cut + 1 :])
                block.append(line.decode(errors="replace"))
                at += len(line) + 1
                if len(block) == self.lines:
                    yield part.path, first, block
                    block, first = [], at
            if block:
                yield part.path, first, block


class Blocks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "merge_blocks"

    def schema(self) -> str:
        return "path string, block long, lines array<string>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return BlockReader(self.options)


@dataclass
class Written(WriterCommitMessage):
    path: str
    rows: int


class DocumentWriter(DataSourceWriter):
    """Each task writes its rows as a part; the commit makes one document of header, counts and parts, in a file that takes its name when it is whole."""

    def __init__(self, options: dict):
        self.path, self.key = options["path"].rstrip("/"), options.get("key", "rows")
        self.head = json.loads(options.get("header", "{}"))
        self.parts = f"{self.path}._parts-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        where, root = store(self.parts)
        where.create_dir(root, recursive=True)
        name, n = f"{root}/{uuid.uuid4().hex}", 0
        with where.open_output_stream(name) as f:
            for row in rows:
                f.write((",\n    " if n else "").encode() + json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str).encode(errors="replace"))
                n += 1
        return Written(name, n)

    def commit(self, messages: list[Written | None]) -> None:
        where, root = store(self.path)
        done = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.path)
        whole = f"{root}._whole-{uuid.uuid4().hex}"
        # One line for each field of the header and one for each row, so that a reader can begin at any of them.
        head = "{\n" + ",\n".join(f"  {json.dumps(k)}: {json.dumps(v, ensure_ascii=False)}" for k, v in (self.head | {"count": sum(m.rows for m in done)}).items())
        with where.open_output_stream(whole) as f:
            f.write(f"{head},\n  {json.dumps(self.key)}: [\n    ".encode())
            for k, m in enumerate(done):
                f.write(b",\n    " if k else b"")
                with where.open_input_stream(m.path) as part:
                    while chunk := part.read(CHUNK):
                        f.write(chunk)
            f.write(b"\n  ]\n}\n")
        where.move(whole, root)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        where, root = store(self.parts)
        if where.get_file_info(root).type != fs.FileType.NotFound:
            where.delete_dir(root)


class Document(DataSource):
    @classmethod
    def name(cls) -> str:
        return "merge_document"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return DocumentWriter(self.options)


def document(spark: SparkSession, path: str, row: str, header: str) -> DataFrame:
    """(head, row) of a document that the sink wrote, as structs with the fields of the two schemas.  The sink puts each row on a line of its own, so a file of any size is read in splits and no task holds a document."""
    lines = spark.read.option("lineSep", "\n").text(path)
    rows = lines.filter(F.startswith("value", F.lit("    {"))).select(F.from_json(F.regexp_replace("value", r",$", ""), row, {"mode": "FAILFAST"}).alias("row"))
    field = F.from_json(F.concat(F.lit("{"), F.regexp_replace("value", r",$", ""), F.lit("}")), header)
    names = StructType.fromDDL(header).names
    head = lines.filter(F.startswith("value", F.lit('  "'))).select(field.alias("f")).agg(*[F.max(F.col("f")[c]).alias(c) for c in names])
    return rows.crossJoin(F.broadcast(head.select(F.struct(*names).alias("head"))))  # one row


def register(spark: SparkSession) -> None:
    """The four sources by their names, for spark.read, readStream and write."""
    for source in (Listing, Documents, Blocks, Document):
        spark.dataSource.register(source)
