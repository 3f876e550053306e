"""Word documents as blocks of text: headings, paragraphs and table rows."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree as X
from xml.sax.saxutils import escape

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: The name space of the format, bytes of a part, parts of an archive.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
MOST_PART_BYTES, MOST_PARTS = 32 * 1024 * 1024, 2000
HEADING = re.compile(r"heading\s*([1-9])", re.IGNORECASE)
BLOCKS = "filename string, digest string, position bigint, text string, kind string, level bigint, table bigint, row bigint"


def part(archive: zipfile.ZipFile, name: str) -> X.Element:
    """An XML part; those too large or with a document type or entities are refused, in any encoding."""
    info = archive.getinfo(name)
    if info.file_size > MOST_PART_BYTES:
        raise ValueError(f"{name} is larger than 32 MiB.")
    raw = archive.read(info)
    if any(mark in raw.replace(b"\0", b"").upper() for mark in (b"<!DOCTYPE", b"<!ENTITY")):
        raise ValueError("The document's XML declares a document type or entities.")
    return X.fromstring(raw)


def words(element: X.Element) -> str:
    """Text of a paragraph, with single spaces."""
    return " ".join("".join((e.text or "") if e.tag == W + "t" else " " if e.tag in (W + "tab", W + "br") else "" for e in element.iter()).split())


def outline(element: X.Element) -> int | None:
    """The heading level that the element's own properties give."""
    found = element.find(f"{W}pPr/{W}outlineLvl")
    value = found.get(W + "val", "") if found is not None else ""
    return int(value) + 1 if value.isdigit() and int(value) <= 8 else None


def named_level(name: str) -> int | None:
    found = HEADING.fullmatch(name)
    return int(found[1]) if found else None


def style_levels(styles: X.Element | None) -> dict[str, int | None]:
    out = {}
    for style in styles.findall(W + "style") if styles is not None else ():
        name = style.find(W + "name")
        out[style.get(W + "styleId", "")] = outline(style) or named_level(name.get(W + "val", "") if name is not None else "")
    return out


def blocks(raw: bytes) -> list[dict]:
    """text, kind, level, table and row of each block, in order; ValueError if the bytes are no readable document."""
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as archive:
            if len(archive.infolist()) > MOST_PARTS:
                raise ValueError("The archive has too many parts.")
            document = part(archive, "word/document.xml")
            levels = style_levels(part(archive, "word/styles.xml") if "word/styles.xml" in archive.namelist() else None)
    except (zipfile.BadZipFile, zlib.error, KeyError, X.ParseError, RuntimeError, NotImplementedError) as e:
        raise ValueError(f"The document can't be read: {e}") from e
    body = document.find(W + "body")
    if body is None:
        raise ValueError("The document has no body.")
    out = list(walk(body, levels, [0]))
    if not out:
        raise ValueError("The document has no text.")
    return out


def walk(element: X.Element, levels: dict, tables: list[int]) -> Iterator[dict]:
    for child in element:
        if child.tag == W + "p":
            text, style = words(child), child.find(f"{W}pPr/{W}pStyle")
            name = style.get(W + "val", "") if style is not None else ""
            if text:
                yield {"text": text, "kind": "paragraph", "level": outline(child) or levels.get(name) or named_level(name)}
        elif child.tag == W + "tbl":
            tables[0] += 1
            for n, row in enumerate(child.findall(W + "tr"), 1):
                cells = [" ".join(map(words, cell.iter(W + "p"))) for cell in row.findall(W + "tc")]
                if any(c.strip() for c in cells):
                    yield {"text": " | ".join(cells), "kind": "table_row", "table": tables[0], "row": n}
        else:
            yield from walk(child, levels, tables)


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of every .docx file of a path, by Spark's own reader; a file that can't be read fails the job."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[dD][oO][cC][xX]").load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in BLOCKS.split(", ")]
        for batch in batches:
            for file, raw in zip(batch["path"], batch["content"], strict=True):
                found = [{"filename": file.rsplit("/", 1)[-1], "digest": hashlib.sha256(raw).hexdigest(), "position": n, **b} for n, b in enumerate(blocks(bytes(raw)), 1)]
                yield pd.DataFrame(found, columns=columns).astype({c: "Int64" for c in ("position", "level", "table", "row")})

    return files.select("path", "content").mapInPandas(run, BLOCKS)


# documents as files of a folder, by the data source API

#: What a minimal package of the format has.
PACKAGE = {
    "[Content_Types].xml": '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
    "_rels/.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
}
#: Characters that XML has no way to write.
UNWRITABLE = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff￾￿]")
#: Bytes of files that a task of a reader opens, about.
TASK_BYTES = 32 << 20
#: The columns to write: a row is a document, its blocks in order; level makes a heading.
DOCUMENT = "filename string, blocks array<struct<text: string, level: bigint>>"


def packed(blocks: list[tuple[str, int | None]]) -> bytes:
    """The bytes of a document with these paragraphs; characters that XML can't hold are left out."""
    body = []
    for text, level in blocks:
        style = f'<w:pPr><w:pStyle w:val="Heading{level}"/></w:pPr>' if level else ""
        body.append(f'<w:p>{style}<w:r><w:t xml:space="preserve">{escape(UNWRITABLE.sub("", text or ""))}</w:t></w:r></w:p>')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, text in PACKAGE.items():
            archive.writestr(zipfile.ZipInfo(name), text)
        archive.writestr(zipfile.ZipInfo("word/document.xml"), f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{W[1:-1]}"><w:body>{"".join(body)}</w:body></w:document>')
    return out.getvalue()


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it; a path without a scheme is a local one."""
    return fs.FileSystem.from_uri(path) if re.match(r"\w+:/", path) else (fs.LocalFileSystem(), path)


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class DocxReader(DataSourceReader):
    """Tasks have files of about TASK_BYTES in all, so a folder of many small documents takes few of them."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[Files]:
        files, root = store(self.path)
        found = [files.get_file_info(root)] if files.get_file_info(root).is_file else files.get_file_info(fs.FileSelector(root, recursive=True))
        out, size = [Files([])], 0
        for info in sorted((f for f in found if f.is_file and f.path.lower().endswith(".docx") and not f.base_name.startswith((".", "_"))), key=lambda f: f.path):
            if out[-1].paths and size + info.size > TASK_BYTES:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(info.path)
            size += info.size
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        files, _ = store(self.path)
        for path in partition.paths:
            with files.open_input_stream(path) as stream:
                raw = stream.read()
            digest, name = hashlib.sha256(raw).hexdigest(), path.rsplit("/", 1)[-1]
            for n, b in enumerate(blocks(raw), 1):
                yield name, digest, n, b["text"], b["kind"], b.get("level"), b.get("table"), b.get("row")


class Written(WriterCommitMessage):
    def __init__(self, paths: list[str]):
        self.paths = paths


class DocxWriter(DataSourceWriter):
    """A file for each row. It gets its name when it is whole, so a task that is run again leaves no halves.

    A name may have folders before it. Stores take new names in one folder one after another, so many documents are
    best dealt to many folders.
    """

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, rows: Iterator) -> Written:
        files, root = store(self.path)
        done, attempt, made = [], TaskContext.get().taskAttemptId(), set()
        for row in rows:
            folder, _, own = f"{root}/{row.filename}".rpartition("/")
            if folder not in made:
                files.create_dir(folder, recursive=True)
                made.add(folder)
            with files.open_output_stream(f"{folder}/.{attempt}-{own}") as stream:
                stream.write(packed([(b.text, b.level) for b in row.blocks]))
            files.move(f"{folder}/.{attempt}-{own}", f"{folder}/{own}")
            done.append(f"{folder}/{own}")
        return Written(done)

    def commit(self, messages: list) -> None:
        files, root = store(self.path)
        with files.open_output_stream(f"{root}/_SUCCESS") as stream:
            stream.write(b"")

    def abort(self, messages: list) -> None:
        files, _ = store(self.path)
        for message in messages:
            for path in message.paths if message else ():
                files.delete_file(path)


class DocxSource(DataSource):
    """spark.read.format("docx").load(folder) gives BLOCKS, frame.write.format("docx").mode("append").save(folder) takes DOCUMENT.

    For stores that pyarrow opens; read_docx reads from any that Spark does.
    """

    @classmethod
    def name(cls) -> str:
        return "docx"

    def schema(self) -> str:
        return BLOCKS

    def reader(self, schema) -> DocxReader:
        return DocxReader(self.options)

    def writer(self, schema, overwrite: bool) -> DocxWriter:
        return DocxWriter(self.options)
