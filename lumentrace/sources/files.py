"""Files as tables: walking, extraction of text, and what went wrong (SRC-01..08)."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.severity import finding
from ..functions.text import MAX_TEXT, extracted_text_ok, looks_like_text, size_ok
from .walk import LARGEST, contents, walk

#: Usual limits, which are arguments: bytes of an inflated stream, slides after the first.
INFLATE_MOST, MORE_SLIDES = 32 * 1024 * 1024, 50


def read_files(spark: SparkSession, target: str, largest: int = LARGEST) -> DataFrame:
    """(path, modificationTime, length, content, error) of a file or of all files below a folder, hidden and empty ones too (SRC-01).

    Folders are walked and files read by the executors (``walk``). What can't be read has a row with its error, so does a folder that can't be listed, whose length is
    null; a file larger than ``largest`` bytes isn't held. A missing target raises.
    """
    return contents(walk(spark, target), target, largest)


def scan_error(error: Column, path: Column) -> Column:
    """The finding of a file or folder that couldn't be read, else null (SRC-02)."""
    return F.when(error.isNotNull(), F.struct(*finding("storage", "scan_error", "Could not scan file", "info", error, path)))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def _operands(content: bytes) -> str:
    """Text of (literal) strings, then of <hexadecimal> ones, parted by blanks."""
    out = []
    for m in re.finditer(rb"\(((?:\\.|[^\\()])*)\)", content, re.S):
        plain = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
        raw = re.sub(rb"\\([0-7]{1,3}|.)", lambda e: bytes([int(e[1], 8) & 255]) if e[1][:1] in b"01234567" else plain.get(e[1], e[1]), m[1], flags=re.S)
        out.append(raw.decode("latin-1"))
    for m in re.finditer(rb"<([0-9A-Fa-f\s]+)>", content):
        h = re.sub(rb"\s", b"", m[1])
        raw = bytes.fromhex((h + b"0" * (len(h) % 2)).decode())
        out.append(raw.decode("utf-16-be", "ignore") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1"))
    return " ".join(x for x in out if x.strip())


def pdf_text(data: bytes, inflate: int = INFLATE_MOST) -> str | None:
    """Text operators of plain and deflated streams; other filters are skipped; None if it isn't a PDF (SRC-06)."""
    if not data.startswith(b"%PDF-"):
        return None
    out = []
    for m in re.finditer(rb"<<(.{0,4096}?)>>\s*stream\r?\n(.*?)\r?\n?endstream", data, re.S):
        kind, body = m[1], m[2]
        if b"FlateDecode" in kind:
            try:
                body = zlib.decompressobj().decompress(body, inflate)
            except zlib.error:
                continue
        elif b"/Filter" in kind:
            continue
        if t := _operands(body):
            out.append(t)
    return "\n".join(out)


def ooxml_text(data: bytes, slides: int = MORE_SLIDES) -> str | None:
    """Text of a document, a workbook's shared strings or slides (SRC-07); None if it isn't such a file."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = set(z.namelist())
            parts = [p for p in ("word/document.xml", "xl/sharedStrings.xml") if p in names]
            parts += [p for p in (f"ppt/slides/slide{i}.xml" for i in range(1, slides + 2)) if p in names]
            out = []
            for p in parts:
                for _, node in ElementTree.iterparse(z.open(p), events=("end",)):
                    tag = node.tag.rpartition("}")[2]
                    if tag == "t":
                        out.append(node.text or "")
                    elif tag in ("p", "tr", "tc", "si", "br"):
                        out.append("\n")
            return "".join(out) if parts else None
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, OSError):
        return None


def _extract(b: bytes | None, inflate: int, slides: int) -> tuple[str | None, str | None]:
    b = b or b""
    if b.startswith(b"%PDF-"):
        return "pdf", pdf_text(b, inflate)
    if b.startswith(b"PK\x03\x04") and (t := ooxml_text(b, slides)) is not None:
        return "ooxml", t
    return None, None


def _extracted(content: Column, inflate: int, slides: int) -> Column:
    @F.pandas_udf("kind string, text string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = [_extract(b, inflate, slides) for b in s]
            yield pd.DataFrame({"kind": pd.Series([k for k, _ in rows], dtype=object), "text": pd.Series([t for _, t in rows], dtype=object)})

    return run(content)


def with_text(files: DataFrame, content_col: str = "content", length_col: str = "length", most: int = MAX_TEXT, inflate: int = INFLATE_MOST, slides: int = MORE_SLIDES) -> DataFrame:
    """``files`` with text (null if there is none) and text_status: text, extracted, unreliable, empty or none (SRC-08).

    Only contents that begin as a PDF or ZIP reach Python. Plain texts of more than ``most`` bytes have none, streams give ``inflate`` bytes at most, and ``slides`` slides are read after the first.
    """
    c = F.col(content_col)
    packed = F.coalesce(F.hex(F.substring(c, 1, 4)).isin("25504446", "504B0304"), F.lit(False))
    rows = files.withColumn("_x", _extracted(F.when(packed, c), inflate, slides))
    inner = F.when(F.col("_x.kind").isNull(), "none").when(F.trim(F.coalesce("_x.text", F.lit(""))) == "", "empty").when(extracted_text_ok(F.col("_x.text")), "extracted").otherwise("unreliable")
    plain = F.when(F.coalesce(size_ok(F.col(length_col), most) & looks_like_text(c), F.lit(False)), "text").otherwise("none")
    status = F.col("text_status")
    rows = rows.withColumn("text_status", F.when(packed, inner).otherwise(plain))
    return rows.withColumn("text", F.when(status == "text", F.make_valid_utf8(c.cast("string"))).when(status == "extracted", F.col("_x.text"))).drop("_x")


def extraction_finding(status: Column, path: Column) -> Column:
    """The finding of a file whose extracted text is missing or can't be trusted, else null (SRC-08)."""
    bad = status == "unreliable"
    told = finding("storage", F.when(bad, "extraction_unreliable").otherwise("extraction_no_text"), F.when(bad, "Extracted text looks unreliable").otherwise("No text could be extracted"), "info", status, path, tags=["extraction"])
    return F.when(status.isin("unreliable", "empty"), F.struct(*told))


def extraction_findings(files: DataFrame, path_col: str = "path") -> DataFrame:
    """Such files as findings."""
    return files.select(extraction_finding(F.col("text_status"), F.col(path_col)).alias("f")).where("f is not null").select("f.*")
