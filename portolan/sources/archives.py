"""Members of ZIP archives and sheets of workbooks as a Spark data source, `spark.read.format("archive")`.

A partition is a member of one archive (or a sheet of one binary workbook, `xls`), or of each of the archives that a folder or pattern names. A task opens its archive as a random-access file and inflates
the member as a stream: text is parsed line by line, a sheet by the events of its XML, and rows leave in batches of BATCH_BYTES or
BATCH_ROWS. So a task holds a batch, and for a workbook its shared strings as packed UTF-8, but never a member. Archives may lie where pyarrow's file systems reach
(local and mounted folders, HDFS, object stores); the driver resolves the path, mount tables too, by Spark's own file system.

Columns are text, missing cells NULL, and `_ord` numbers the rows of a member from 0. With several members, they go on in blocks of 2**40, in the order of
their archives and names, and must have the columns of the first one. Blank rows are no rows.

Options: `member`, a name or a pattern like 'data/*.tsv' (else the one member of the archive, or the workbook's active sheet).
"""

from __future__ import annotations

import csv
import io
import json
import re
import sys
import zipfile
from collections.abc import Iterator
from fnmatch import fnmatchcase
from pathlib import PurePosixPath
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from portolan.sources import xls
from portolan.sources.delimited import separator
from portolan.sources.strings import Strings

NAME = "archive"
ORDER = "_ord"
BATCH_ROWS, BATCH_BYTES = 10_000, 4 << 20
MEMBER_BITS = 40  # of a row's number, below its member's
# Cells that mean a missing value in a delimited file.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINKS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def named(header: list[str]) -> list[str]:
    """Unique column names: blanks get a number, repetitions a suffix."""
    out: list[str] = []
    for i, name in enumerate(header):
        name, n = name or f"unnamed_{i}", 0
        while (f"{name}.{n}" if n else name) in out:
            n += 1
        out.append(f"{name}.{n}" if n else name)
    return out


Archive = zipfile.ZipFile | xls.Workbook


def opened(uri: str) -> Archive:
    """By its contents: a workbook of either format may have either name."""
    where, path = fs.FileSystem.from_uri(uri)
    file = io.BufferedReader(where.open_input_file(path), 1 << 16)
    binary = file.read(len(xls.SIGNATURE)) == xls.SIGNATURE
    file.seek(0)
    return xls.Workbook(file) if binary else zipfile.ZipFile(file)


def members(archive: Archive, wanted: str | None) -> list[str]:
    """The members that are read: all that fit a pattern, the one of that name, the only one, or a workbook's active sheet."""
    names = [n for n in archive.namelist() if not n.endswith("/") and not n.startswith("__MACOSX/")]
    if wanted is not None:
        found = [wanted] if wanted in names else sorted(n for n in names if fnmatchcase(n, wanted))
        if not found:
            raise ValueError(f"the archive has no member {wanted}")
        return found
    if isinstance(archive, xls.Workbook):
        return [archive.active]
    if any(n.startswith("xl/worksheets/") for n in names):
        return [active_sheet(archive)]
    if len(names) != 1:
        raise ValueError(f"the archive has {len(names)} files; name one of them")
    return names


def active_sheet(archive: zipfile.ZipFile) -> str:
    """The file of the sheet that was open when the workbook was saved; the lowest number where the workbook doesn't say."""
    files = archive.namelist()
    if "xl/workbook.xml" in files and "xl/_rels/workbook.xml.rels" in files:
        book = ElementTree.fromstring(archive.read("xl/workbook.xml"))
        view, sheets = book.find(f".//{_SHEET}workbookView"), book.findall(f".//{_SHEET}sheet")
        targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
        at = int(view.get("activeTab", "0")) if view is not None else 0
        target = targets.get(sheets[at].get(f"{_LINKS}id"), "") if at < len(sheets) else ""
        name = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        if name in files:
            return name
    return min((n for n in files if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))


def shared_strings(archive: zipfile.ZipFile) -> Iterator[str]:
    if "xl/sharedStrings.xml" in archive.namelist():
        with archive.open("xl/sharedStrings.xml") as file:
            for item in _elements(file, f"{_SHEET}si"):
                # phonetic runs aren't text
                yield "".join(t.text or "" for part in item for t in ([part] if part.tag == f"{_SHEET}t" else part.findall(f"{_SHEET}t") if part.tag == f"{_SHEET}r" else ()))


def _elements(file: io.BufferedIOBase, tag: str) -> Iterator[ElementTree.Element]:
    """The elements of a tag as they end; what has been read is let go."""
    above: list[ElementTree.Element] = []
    for event, element in ElementTree.iterparse(file, ("start", "end")):
        if event == "start":
            above.append(element)
        else:
            above.pop()
            if element.tag == tag:
                yield element
                if above:
                    above[-1].clear()


def sheet_rows(archive: zipfile.ZipFile, name: str) -> Iterator[list[str | None]]:
    """Rows of a sheet. Cells are placed by their own references, whatever the sheet's stated dimensions say."""
    strings = Strings(shared_strings(archive))
    with archive.open(name) as file:
        for row in _elements(file, f"{_SHEET}row"):
            cells: list[str | None] = []
            for cell in row.iter(f"{_SHEET}c"):
                at = 0
                for letter in re.match(r"[A-Z]*", cell.get("r", ""))[0]:
                    at = at * 26 + ord(letter) - 64
                at = at - 1 if at else len(cells)
                cells += [None] * (at + 1 - len(cells))
                value, kind = cell.find(f"{_SHEET}v"), cell.get("t")
                if kind == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in cell.iter(f"{_SHEET}t"))
                elif value is not None and value.text is not None:
                    cells[at] = strings[int(value.text)] if kind == "s" else {"0": "False", "1": "True"}.get(value.text, value.text) if kind == "b" else value.text
            yield cells


def text_rows(archive: zipfile.ZipFile, name: str) -> Iterator[list[str | None]]:
    with io.TextIOWrapper(archive.open(name), "utf-8-sig", newline="") as lines:
        head = lines.readline()
    csv.field_size_limit(min(sys.maxsize, 2**31 - 1))
    with io.TextIOWrapper(archive.open(name), "utf-8-sig", newline="") as lines:
        yield from csv.reader(lines, delimiter=separator(head, PurePosixPath(name).suffix.lower()))


def rows_of(archive: Archive, name: str) -> Iterator[list[str | None]]:
    """All rows of a member, the header first."""
    if isinstance(archive, xls.Workbook):
        return archive.rows(name)
    return (sheet_rows if name.startswith("xl/worksheets/") else text_rows)(archive, name)


def header_of(uri: str, wanted: str | None) -> list[str]:
    """The column names of the first member; only its first row is read."""
    with opened(uri) as archive:
        head = next(rows_of(archive, members(archive, wanted)[0]), None)
    if head is None:
        raise ValueError("the table has no header")
    return named([x or "" for x in head])


class Member(InputPartition):
    def __init__(self, uri: str, name: str, number: int):
        super().__init__(number)
        self.uri, self.name, self.number = uri, name, number


class ArchiveReader(DataSourceReader):
    def __init__(self, uris: list[str], wanted: str | None, names: list[str]):
        self.uris, self.wanted, self.names = uris, wanted, names

    def partitions(self) -> list[Member]:
        found = []
        for uri in self.uris:
            with opened(uri) as archive:
                found += [(uri, name) for name in members(archive, self.wanted)]
        return [Member(uri, name, i) for i, (uri, name) in enumerate(found)]

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        names = self.names
        schema = pa.schema([(ORDER, pa.int64()), *[(n, pa.string()) for n in names]])
        # dicts keep the order of places, and look missing words up
        missing = dict.fromkeys(MISSING)
        first, n, size = partition.number << MEMBER_BITS, 0, 0
        columns: list[list[str | None]] = [[] for _ in names]

        def batch() -> pa.RecordBatch:
            rows = len(columns[0]) if columns else 0
            out = pa.RecordBatch.from_arrays([pa.array(range(first + n - rows, first + n), pa.int64()), *[pa.array(c, pa.string()) for c in columns]], schema=schema)
            for c in columns:
                c.clear()
            return out

        with opened(partition.uri) as archive:
            rows = rows_of(archive, partition.name)
            head = next(rows, None)
            if head is None or named([x or "" for x in head]) != names:
                raise ValueError(f"{partition.name} has other columns than the first member")
            for row in rows:
                if not any(x not in (None, "") for x in row):
                    continue
                row += [None] * (len(names) - len(row))
                for column, x in zip(columns, row, strict=False):
                    column.append(None if x is None or x in missing else x)
                    size += len(x) if x else 1
                n += 1
                if size > BATCH_BYTES or len(columns[0]) == BATCH_ROWS:
                    yield batch()
                    size = 0
            if columns and columns[0]:
                yield batch()


class ArchiveSource(DataSource):
    """Its path is a JSON list of URIs, as `read` gives it, or one URI."""

    @classmethod
    def name(cls) -> str:
        return NAME

    @property
    def uris(self) -> list[str]:
        path = self.options["path"]
        return json.loads(path) if path.startswith("[") else [path]

    def schema(self) -> T.StructType:
        names = header_of(self.uris[0], self.options.get("member"))
        return T.StructType([T.StructField(ORDER, T.LongType()), *[T.StructField(n, T.StringType()) for n in names]])

    def reader(self, schema: T.StructType) -> ArchiveReader:
        return ArchiveReader(self.uris, self.options.get("member"), [f.name for f in schema.fields if f.name != ORDER])


def resolved(spark: SparkSession, path: str) -> list[str]:
    """The files of a path, folder or pattern as full URIs, by Spark's file system; mount tables are followed."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = []
    for status in system.globStatus(where) or []:
        for file in system.listStatus(status.getPath()):
            name = file.getPath().getName()
            if file.isFile() and name.lower().endswith((".zip", ".xlsx", ".xls")):
                found.append(system.resolvePath(file.getPath()).toUri().toString())
    # Hadoop writes file:/x for local files
    return sorted(re.sub(r"^file:/(?!/)", "file:///", uri) for uri in found)


def read(spark: SparkSession, path: str, member: str | None = None) -> DataFrame:
    """The table in an archive's member, a workbook's sheet, or in many of them. Raises ValueError for what isn't there or has no header."""
    uris = resolved(spark, path)
    if not uris:
        raise ValueError(f"no such file: {path}")
    names = header_of(uris[0], member)
    if not spark._jsparkSession.sessionState().dataSourceManager().dataSourceExists(NAME):
        spark.dataSource.register(ArchiveSource)
    schema = T.StructType([T.StructField(ORDER, T.LongType()), *[T.StructField(n, T.StringType()) for n in names]])
    reader = spark.read.format(NAME).schema(schema).option("path", json.dumps(uris))
    return (reader if member is None else reader.option("member", member)).load()
