"""Texts out of files. Types are told, and plain texts and XML cleaned, by column functions; only inflating, and the objects and
operators of PDF files, need Python."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as fn

from . import pdf
from .limits import Limited
from .slices import slices

#: Texts and parts of more bytes count as failed: no value of a column holds more.
MAX_VALUE = (1 << 31) - (1 << 16)
#: Seconds for each MB of a file that the objects of a PDF, and any file, may take.
PDF_SECONDS, FILE_SECONDS = 15.0, 45.0
_LOCAL_FILE = b"PK\x03\x04"
_MAIN_PART = b"word/document.xml"
_END = b"endstream"


def inflated(data: bytes, limit: int = 0) -> bytes | None:
    """zlib or raw deflate data, None if it is neither, or as long as a limit; never more than the limit is held."""
    for bits in (15, -15):
        try:
            d = zlib.decompressobj(bits)
            out = d.decompress(data, limit)
        except zlib.error:
            continue
        return None if limit and (d.unconsumed_tail or len(out) >= limit) else out
    return None


def _text(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode("latin-1")


def _literal(raw: bytes) -> str:
    """A string in brackets: octal escapes, then escaped brackets and backslashes."""
    plain = re.sub(rb"\\([0-7]{1,3})", lambda m: bytes([int(m[1], 8) & 255]), raw)
    return _text(re.sub(rb"\\([()\\])", rb"\1", plain))


def _hexadecimal(digits: bytes) -> str:
    if len(digits) % 2:
        return ""
    data = bytes.fromhex(digits.decode())
    return data.decode("latin-1") if data[:1] == b"\0" else data.decode(errors="replace")


#: Operators that show strings.
_SHOWS = re.compile(rb"[)>\]]\s*(?:T[jJ]\b|['\"])")


def page_text(content: bytes) -> str:
    """What the operators of a PDF content stream show, or its printable characters if it has none that show strings."""
    shown = [_literal(m[1]) for m in re.finditer(rb"\((.*?)\)", content)] + [_hexadecimal(m[1]) for m in re.finditer(rb"<([0-9A-Fa-f]+)>", content)]
    joined = " ".join(filter(str.strip, shown)).strip()
    if joined or _SHOWS.search(content):
        return joined
    plain = re.sub(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", " ", _text(content))
    return " ".join(plain.split()) if re.search("[A-Za-z0-9]", plain) else ""


def _stream_at(data: bytes, at: int) -> tuple[bytes | None, int]:
    """The inflated stream that begins there, None if it can't be inflated, and where it ends. Its bytes may hold the word that ends
    streams: then the data goes on until its own end, if it comes just before that word."""
    end = data.find(_END, at)
    if end < 0:  # a file that breaks off
        end = len(data)
        return (inflated(data[at:]) if data[at : at + 1] == b"x" else None), end
    for bits in (15, -15):
        d, to = zlib.decompressobj(bits), end
        try:
            pieces = [d.decompress(data[at:end])]
        except zlib.error:
            continue
        try:
            while not d.eof and (further := data.find(_END, to + len(_END))) >= 0:
                pieces.append(d.decompress(data[to:further]))
                to = further
        except zlib.error:
            pass
        return (b"".join(pieces), to) if d.eof and not d.unused_data.strip() else (pieces[0], end)
    return None, end


def pdf_streams(data: bytes) -> Iterator[bytes]:
    """The inflated streams of a PDF, in order, of any size."""
    at = 0
    while (at := data.find(b"stream", at)) >= 0:
        at += 6
        at += 2 if data[at : at + 2] == b"\r\n" else data[at : at + 1] in (b"\r", b"\n")
        content, end = _stream_at(data, at)
        if content:
            yield content
        at = end + len(_END)


def pdf_text(data: bytes) -> str:
    """The texts of all streams, each followed by a blank."""
    return "".join(f"{t} " for c in pdf_streams(data) if (t := page_text(c) or ("" if _SHOWS.search(c) else " ".join(_text(c).split()))))


def main_part(data: bytes) -> bytes:
    """The inflated word/document.xml of a DOCX file, found by its local header; empty if there is none."""
    at = 0
    while (at := data.find(_LOCAL_FILE, at)) >= 0 and at + 30 <= len(data):
        method, size, name_len, extra = (*struct.unpack_from("<H", data, at + 8), *struct.unpack_from("<I", data, at + 18), *struct.unpack_from("<HH", data, at + 26))
        start = at + 30 + name_len + extra
        if data[at + 30 : at + 30 + name_len] == _MAIN_PART and method == 8 and size:
            part = inflated(data[start : start + size], MAX_VALUE)
            if part is None:
                raise ValueError("the part can't be inflated, or is too long for a value")
            return part
        at = start + size
    return b""


def pdf_pages(data: bytes) -> str | None:
    """The texts of a PDF's pages, by its objects, with line feeds between them; None if it can't be read so."""
    try:
        texts, whole = pdf.read_pages(data)
        text = "\n".join(filter(None, texts))
        return text if text or whole else None
    except (pdf.Damaged, ValueError, KeyError, TypeError, AttributeError, IndexError, RecursionError):
        return None


def _by_objects(data: bytes) -> bytes | None:
    """The main part of a DOCX file, or the texts of a PDF's pages."""
    if data.startswith(_LOCAL_FILE):
        return main_part(data)
    text = pdf_pages(data)
    return None if text is None else text.encode(errors="replace")


def _by_streams(data: bytes) -> bytes:
    return main_part(data) if data.startswith(_LOCAL_FILE) else pdf_text(data).encode(errors="replace")


def _limited(*functions: tuple[Callable[[bytes], object], float], kind: str):
    """A column function of files: struct<value, status>. Functions, with their seconds for each MB of a file, are tried one after the
    other until one gives a value; status: ok, failed, or timed_out, of the last one tried."""
    held = {"string": pa.string(), "binary": pa.binary()}[kind]

    @F.arrow_udf(f"value {kind}, status string")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tried = [Limited(f, seconds) for f, seconds in functions]
        try:
            tried[0].begin()  # a process forked later would share the first batch
            for some in slices(columns):
                values, states = [None] * len(some), ["failed"] * len(some)
                for i, (status, value) in zip(at := [i for i, x in enumerate(some) if x.is_valid], tried[0].many([some[i].as_py() for i in at]), strict=True):
                    for f in tried[1:]:
                        if status == "ok" and value is not None:
                            break
                        status, value = f(some[i].as_py())
                    if value is not None and len(value) > MAX_VALUE:
                        status, value = "failed", None
                    values[i], states[i] = value, status
                yield pa.StructArray.from_arrays([pa.array(values, held), pa.array(states, pa.string())], ["value", "status"])
        finally:
            for f in tried:
                f.__exit__()

    return run


def main_parts(batches: Iterable[pa.RecordBatch]) -> Iterator[bytes | None]:
    """The bytes of files (kind, body), of DOCX files those of the main part's XML; None where it can't be read in FILE_SECONDS."""
    with Limited(main_part, FILE_SECONDS) as read:
        for b in batches:
            for kind, body in zip(b.column(0), b.column(1), strict=True):
                data = body.as_py()
                yield read(data)[1] if data is not None and kind.as_py() == "docx" else data


def extracted(files: DataFrame) -> DataFrame:
    """path, kind, text and extract_status (ok, empty, failed or timed_out) of files (path, content).

    Text, JSON and Markdown are taken as they are, UTF-8 or else Latin-1. PDFs are read page by page by their objects; those that
    can't be, or aren't in PDF_SECONDS for each MB, by what their streams show. Pages that show nothing, as scanned ones, give nothing. A
    file that takes longer than FILE_SECONDS for each MB has an empty text and holds nothing up: PDF and DOCX files are read in a process
    beside the task's.
    """
    typed = files.select("path", "content", fn.file_type(F.col("content")).alias("kind"))
    # one pass over the files, which may have to be made; Python sees only those that it reads
    read = typed.withColumn("got", _limited((_by_objects, PDF_SECONDS), (_by_streams, FILE_SECONDS - PDF_SECONDS), kind="binary")(F.when(F.col("kind").isin("pdf", "docx"), F.col("content"))))
    text = F.when(F.col("kind") == "pdf", F.col("got.value").cast("string")).when(F.col("kind") == "docx", fn.without_markup(fn.as_text(F.col("got.value")))).otherwise(fn.as_text(F.col("content")))
    status = F.when(F.col("kind").isin("pdf", "docx"), F.col("got.status")).otherwise("ok")
    every = read.select("path", "kind", text.alias("text"), status.alias("status"))
    status = F.when(F.col("status") != "ok", F.col("status")).when(F.coalesce("text", F.lit("")) == "", "empty").otherwise("ok")
    return every.select("path", "kind", F.coalesce("text", F.lit("")).alias("text"), status.alias("extract_status"))
