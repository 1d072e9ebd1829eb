"""Members of archives and pages of documents, from raw objects (sha256, path, kind, content).

Every limit gives a row with a reason, never an exception: a broken or hostile file costs its own row. Archives are read in memory, member by
member, and nothing is written to a path that an archive names. A session's spark.sql.execution.arrow.maxBytesPerBatch bounds the
contents that a task holds at once.
"""

from __future__ import annotations

import io
import time
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions.text import html_to_text


@dataclass(frozen=True)
class Limits:
    """Members and bytes of an archive, characters of a page, rows of a sheet, seconds for a document."""

    members: int = 4096
    bytes: int = 512 * 1024 * 1024
    chars: int = 2 * 1024 * 1024
    rows: int = 500_000
    seconds: float = 60.0


class Refused(Exception):
    """Why a document has no text."""


_MEMBERS = "sha256 string, member string, size long, content binary, reason string"
_PAGES = "sha256 string, page_no int, text string, reason string"
_W, _S = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}", "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _archive(raw: bytes, limits: Limits) -> zipfile.ZipFile:
    """The archive, refused by what its directory declares, before anything is unpacked."""
    try:
        z = zipfile.ZipFile(io.BytesIO(raw))
    except (zipfile.BadZipFile, ValueError, OverflowError) as e:
        raise Refused("format_unsupported: zip_corrupt") from e
    if len(z.infolist()) > limits.members:
        raise Refused(f"extract_zip_bomb: members>{limits.members}")
    if sum(x.file_size for x in z.infolist()) > limits.bytes:
        raise Refused(f"extract_zip_bomb: uncompressed>{limits.bytes}")
    return z


def _member(z: zipfile.ZipFile, name: str, late: float) -> bytes:
    """One member in pieces; more bytes than it declares are refused, as is a member that takes too long."""
    try:
        info, out = z.getinfo(name), io.BytesIO()
        with z.open(info) as f:
            while piece := f.read(1 << 20):
                out.write(piece)
                if out.tell() > info.file_size:
                    raise Refused("extract_zip_bomb: larger_than_declared")
                if time.monotonic() > late:
                    raise Refused("extract_timeout")
        return out.getvalue()
    except (zipfile.BadZipFile, KeyError, RuntimeError, NotImplementedError, EOFError, OSError, zipfile.zlib.error) as e:
        raise Refused("format_unsupported: zip_corrupt") from e


def _xml(raw: bytes, late: float) -> ElementTree.Element:
    if b"<!DOCTYPE" in raw or b"<!ENTITY" in raw:
        raise Refused("extract_xml_refused")
    if time.monotonic() > late:
        raise Refused("extract_timeout")
    try:
        return ElementTree.fromstring(raw)
    except (ElementTree.ParseError, ValueError) as e:
        raise Refused("extract_xml_refused") from e


def _docx(z: zipfile.ZipFile, limits: Limits, late: float) -> list[str]:
    """The paragraphs outside tables, then the tables, a row each with tabs between cells."""
    body = _xml(_member(z, "word/document.xml", late), late)
    inside = {p for t in body.iter(f"{_W}tbl") for p in t.iter(f"{_W}p")}

    def text(p: ElementTree.Element) -> str:
        return "".join(x.text or "" if x.tag == f"{_W}t" else "\t" if x.tag == f"{_W}tab" else "\n" if x.tag == f"{_W}br" else "" for x in p.iter())

    lines = [text(p) for p in body.iter(f"{_W}p") if p not in inside]
    for row in (r for t in body.iter(f"{_W}tbl") for r in t.findall(f"{_W}tr")):
        lines.append("\t".join("\n".join(text(p) for p in c.iter(f"{_W}p")) for c in row.findall(f"{_W}tc")))
    return ["\n".join(x for x in lines if x.strip())]


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n


def _xlsx(z: zipfile.ZipFile, limits: Limits, late: float) -> list[str]:
    """A page for each sheet, in the order of the book: rows with tabs between cells, empty rows left out."""
    names = set(z.namelist())
    shared = [("".join(t.text or "" for t in x.iter(f"{_S}t"))) for x in _xml(_member(z, "xl/sharedStrings.xml", late), late).findall(f"{_S}si")] if "xl/sharedStrings.xml" in names else []
    target = {r.get("Id"): r.get("Target", "") for r in _xml(_member(z, "xl/_rels/workbook.xml.rels", late), late)}
    pages, total = [], 0
    for sheet in _xml(_member(z, "xl/workbook.xml", late), late).iter(f"{_S}sheet"):
        at, lines = target.get(sheet.get(_R), "").lstrip("/"), []
        for row in _xml(_member(z, at if at.startswith("xl/") else f"xl/{at}", late), late).iter(f"{_S}row"):
            cells: dict[int, str] = {}
            for k, c in enumerate(row.findall(f"{_S}c")):
                kind, v = c.get("t"), c.find(f"{_S}v")
                value = "".join(t.text or "" for t in c.iter(f"{_S}t")) if kind == "inlineStr" else (v.text or "") if v is not None else ""
                if kind == "s" and value.isdigit() and int(value) < len(shared):
                    value = shared[int(value)]
                cells[_column(c.get("r") or "") or k + 1] = value
            if any(cells.values()):
                lines.append("\t".join(cells.get(i, "") for i in range(1, max(cells) + 1)))
            total += 1
            if total > limits.rows:
                raise Refused("extract_too_many_rows")
        pages.append("\n".join(lines))
    return pages


def _office(raw: bytes, limits: Limits) -> list[str]:
    late = time.monotonic() + limits.seconds
    z = _archive(raw, limits)
    names = set(z.namelist())
    read = _docx if "word/document.xml" in names else _xlsx if "xl/workbook.xml" in names else None
    if read is None:
        raise Refused("format_unsupported: unknown_zip_container")
    pages = read(z, limits, late)
    if not any(p.strip() for p in pages):
        raise Refused("no_text_layer")
    return pages


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])


def _unpacked(batches: Iterable[pa.RecordBatch], limits: Limits) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for sha, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            late = time.monotonic() + limits.seconds
            try:
                z = _archive(raw.as_py() or b"", limits)
            except Refused as e:
                yield _rows([(sha, None, None, None, str(e))], _MEMBERS)
                continue
            for info in z.infolist():
                if info.is_dir():
                    continue
                try:
                    data, why = _member(z, info.filename, late), None
                except Refused as e:
                    data, why = None, str(e)
                yield _rows([(sha, info.filename, info.file_size, data, why)], _MEMBERS)


def _paged(batches: Iterable[pa.RecordBatch], limits: Limits) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for sha, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            try:
                # a page that is too long goes on in the next rows of its number, so that no text is lost
                rows = [(sha, n, p[a : a + limits.chars], None) for n, p in enumerate(_office(raw.as_py() or b"", limits), 1) for a in range(0, max(len(p), 1), limits.chars)]
            except Refused as e:
                rows = [(sha, None, None, str(e))]
            yield _rows(rows, _PAGES)


def members(objects: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(sha256, member, size, content, reason) of the archives among objects (sha256, kind, content); a refused archive has one row without member."""
    return objects.where("kind = 'zip'").select("sha256", "content").mapInArrow(partial(_unpacked, limits=limits), _MEMBERS)


def pages(objects: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(sha256, page_no, text, reason) of objects (sha256, kind, content, and where known reason): the text of each page, or why there is none.

    Texts are taken as UTF-8, else as Latin-1; HTML without its tags; DOCX as one page; XLSX with a page for each sheet. Refused are
    archives beyond the limits, XML with a DTD, documents without text, binary files, PDF, and objects that have a reason already.
    """
    if "reason" not in objects.columns:
        objects = objects.withColumn("reason", F.lit(None).cast("string"))
    none = [F.lit(None).cast("int").alias("page_no"), F.lit(None).cast("string").alias("text")]
    gone = objects.where("reason is not null").select("sha256", *none, "reason")
    here = objects.where("reason is null")
    office = here.where(F.col("kind").isin("docx", "xlsx", "zip")).select("sha256", "content").mapInArrow(partial(_paged, limits=limits), _PAGES)
    pdf = here.where("kind = 'pdf'").select("sha256", *none, F.lit("format_unsupported: pdf").alias("reason"))
    plain = here.where(~F.col("kind").isin("docx", "xlsx", "zip", "pdf"))
    utf8 = F.try_validate_utf8(F.col("content").cast("string"))
    text = F.coalesce(utf8, F.decode("content", "ISO-8859-1"))
    text = F.when(F.col("kind") == "html", html_to_text(text)).otherwise(text)
    binary = F.instr(F.substring(F.col("content").cast("string"), 1, 8192), "\0") > 0
    why = F.when(binary, "format_unsupported: binary").when(F.trim(text) == "", "no_text_layer")
    plain = plain.select("sha256", F.when(why.isNull(), 1).alias("page_no"), F.when(why.isNull(), text).alias("text"), why.alias("reason"))
    return gone.unionByName(office).unionByName(pdf).unionByName(plain)
