"""EPUB conversion: text nodes of the documents that a book's manifest names.

A book is a list of entries. Those that are documents are converted, each on its own, and a book is written
from its entries in order: the ``mimetype`` entry first, stored and without extra fields, as readers of the
format ask for, all others compressed, with dates, comments and attributes as they were. ``convert_epub``
does so in one call. ``convert_books`` does it over a table: a row is made of each entry, the rows of all books
are dealt out, and a sort by book and entry brings them back, so that a large book keeps many tasks busy and
no task holds more of it than its archive. Rows are made, converted and put together a piece of a batch at a
time; the texts of all documents of a piece go through the matcher at once.
"""

from __future__ import annotations

import html
import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, groupby
from operator import itemgetter
from typing import NamedTuple
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

from scriptloom.functions import pieces
from scriptloom.functions.trie import Converter
from scriptloom.sources import encoding

#: Media types of documents, and elements whose own text stays (fixed values).
MEDIA_TYPES = {"application/xhtml+xml", "text/html"}
KEPT = {"script", "style", "svg", "math"}
_pieces = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<![^>]*>|<(/?)([^\s/>]+)(?:[^>\"']|\"[^\"]*\"|'[^']*')*>", re.S)
_void = frozenset("area base br col embed hr img input link meta source track wbr".split())
Text = Callable[[str], str]
ENTRY_DDL = "ordinal int, name string, document boolean, year int, month int, day int, hour int, minute int, second int, comment binary, extra binary, attributes long, origin int, raw binary, error string"


_KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
_ROWS = pa.schema([("path", pa.string()), *((name, _KINDS[kind]) for name, kind in (x.split() for x in ENTRY_DDL.split(", ")))])
_BOOKS = pa.schema([("path", pa.string()), ("content", pa.binary()), ("error", pa.string())])


class Entry(NamedTuple):
    """A file of a book, with what the archive says of it; ``error`` says why a book or an entry could not be read or converted."""

    ordinal: int
    name: str | None
    document: bool
    year: int
    month: int
    day: int
    hour: int
    minute: int
    second: int
    comment: bytes
    extra: bytes
    attributes: int
    origin: int
    raw: bytes | None
    error: str | None


def local_name(tag: str) -> str:
    return tag.rpartition("}")[2]


def _manifest(archive: zipfile.ZipFile) -> Iterator[str]:
    """Paths of the items of document types; raises where container or package cannot be read."""
    container = ElementTree.fromstring(archive.read("META-INF/container.xml"))
    package = next(e.attrib["full-path"] for e in container.iter() if local_name(e.tag) == "rootfile")
    folder = posixpath.dirname(package)
    for item in ElementTree.fromstring(archive.read(package)).iter():
        if local_name(item.tag) == "item" and item.get("media-type", "").strip().lower() in MEDIA_TYPES:
            href = item.get("href", "").partition("#")[0]
            yield posixpath.normpath(posixpath.join(folder, unquote(href)))


def document_paths(archive: zipfile.ZipFile) -> list[str]:
    """Entries of the manifest's documents in order; by extension where the manifest cannot be read or names none."""
    names = dict.fromkeys(archive.namelist())
    by_case = {n.lower(): n for n in names}
    try:
        named = [path if path in names else by_case.get(path.lower()) for path in _manifest(archive)]
    except (KeyError, StopIteration, RuntimeError, ElementTree.ParseError):
        named = []
    return list(dict.fromkeys(filter(None, named))) or [n for n in names if n.lower().endswith((".xhtml", ".html", ".htm"))]


def _cut(text: str) -> tuple[list[str], list[int]]:
    """Markup and texts in order, and which are texts to convert: those whose own parent is none of the kept elements."""
    out: list[str] = []
    gaps: list[int] = []
    open_: list[str] = []
    at = 0

    def plain(piece: str) -> None:
        if piece.strip() and not (open_ and open_[-1] in KEPT):
            gaps.append(len(out))
        out.append(piece)

    while at < len(text):
        if open_ and open_[-1] in ("script", "style"):
            end = re.compile(rf"</{open_[-1]}\s*>", re.I).search(text, at)
            stop = end.start() if end else len(text)
            out.append(text[at:stop])
            at = stop
            if not end:
                break
        found = _pieces.search(text, at)
        plain(text[at : found.start() if found else len(text)])
        if not found:
            break
        out.append(found[0])
        at = found.end()
        if found[2]:
            name = found[2].rpartition(":")[2].lower()
            if found[1]:
                if name in open_:
                    del open_[len(open_) - 1 - open_[::-1].index(name) :]
            elif not found[0].endswith("/>") and name not in _void:
                open_.append(name)
    return out, gaps


def _convert_cut(cuts: list[tuple[list[str], list[int]]], convert: Text | Converter) -> list[str]:
    """Documents that were cut, converted at once and joined."""
    shown = [html.unescape(out[k]) if "&" in out[k] else out[k] for out, gaps in cuts for k in gaps]
    done = iter(convert(shown) if isinstance(convert, Converter) else map(convert, shown))
    for out, gaps in cuts:
        for k in gaps:
            new = next(done)
            out[k] = html.escape(new, quote=False) if "&" in out[k] else new
    return ["".join(out) for out, _ in cuts]


def convert_markup(text: str, convert: Text | Converter) -> str:
    """Markup stays byte for byte; text is converted unless its own parent is one of the kept elements."""
    return _convert_cut([_cut(text)], convert)[0]


def _read(raw: bytes) -> tuple[bytes, str]:
    """The byte order mark of a document, and its text."""
    mark = b"\xef\xbb\xbf" if raw.startswith(b"\xef\xbb\xbf") else b""
    raw = raw[len(mark) :]
    try:
        return mark, raw.decode(encoding.detect(raw, utf8_least=0.8))
    except UnicodeDecodeError:
        return mark, raw.decode("utf-8", "replace")


def convert_document(raw: bytes, convert: Text | Converter) -> bytes:
    mark, text = _read(raw)
    return mark + convert_markup(text, convert).encode()


def convert_documents(raws: list[bytes], convert: Text | Converter) -> list[bytes]:
    """The same for many documents at once."""
    read = [_read(raw) for raw in raws]
    done = _convert_cut([_cut(text) for _, text in read], convert)
    return [mark + new.encode() for (mark, _), new in zip(read, done, strict=True)]


def entries(content: bytes) -> Iterator[Entry]:
    """The entries of a book, in the order in which they are written."""
    archive = zipfile.ZipFile(io.BytesIO(content))
    documents = set(document_paths(archive))
    infos = archive.infolist()
    first = [i for i in infos if i.filename == "mimetype"]
    for n, info in enumerate([*first, *(i for i in infos if i.filename != "mimetype")]):
        yield Entry(n, info.filename, info.filename in documents, *info.date_time, info.comment, info.extra, info.external_attr, info.create_system, archive.read(info), None)


def converted(entry: Entry, convert: Text | Converter) -> Entry:
    """A document converted; what cannot be converted stays as it was, with an error."""
    if not entry.document:
        return entry
    try:
        return entry._replace(raw=convert_document(entry.raw, convert))
    except (ValueError, LookupError) as error:
        return entry._replace(error=f"{entry.name}: {error}")


def written(book: Iterable[Entry]) -> tuple[bytes, list[str]]:
    """The archive of entries in order, and their errors."""
    sink, problems = io.BytesIO(), []
    with zipfile.ZipFile(sink, "w") as out:
        for e in book:
            plain = e.name == "mimetype"
            info = zipfile.ZipInfo(e.name, (e.year, e.month, e.day, e.hour, e.minute, e.second))
            info.compress_type = zipfile.ZIP_STORED if plain else zipfile.ZIP_DEFLATED
            info.comment, info.extra, info.external_attr, info.create_system = e.comment, b"" if plain else e.extra, e.attributes, e.origin
            out.writestr(info, e.raw)
            problems += [e.error] if e.error else []
    return sink.getvalue(), problems


def convert_epub(content: bytes, convert: Text | Converter) -> tuple[bytes, list[str]]:
    """The rewritten archive, and what could not be converted (those entries stay as they were)."""
    return written(converted(e, convert) for e in entries(content))


class _Entries:
    """A table function: the entries of a book, or one row that says why it cannot be read; none for a null."""

    def eval(self, content):
        if content is None:
            return
        try:
            none = True
            for entry in entries(bytes(content)):
                none = False
                yield entry
            if none:
                yield Entry(-1, None, False, 0, 0, 0, 0, 0, 0, b"", b"", 0, 0, None, None)
        except Exception as error:  # one broken book is a row with an error, never a failed job
            yield Entry(-1, None, False, 0, 0, 0, 0, 0, 0, b"", b"", 0, 0, None, f"{type(error).__name__}: {error}")


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of books as rows."""
    rows, held = [], 0
    for batch in batches:
        for books in pieces.pieces((batch.column("path"), batch.column("content"))):
            for path, content in zip(*(c.to_pylist() for c in books), strict=True):
                for entry in _Entries().eval(content):
                    rows.append((path, *entry))
                    held += 100 + len(entry.raw or b"")
                    if held >= pieces.PIECE_BYTES:
                        yield _batch(rows, _ROWS)
                        rows, held = [], 0
    if rows:
        yield _batch(rows, _ROWS)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _converted(names: list[str | None], documents: list[bool], raws: list[bytes | None], errors: list[str | None], convert: Converter) -> tuple[list[bytes | None], list[str | None]]:
    """Contents and errors of many entries once their documents are converted: all at once, or one by one if one cannot be."""
    live = [k for k, document in enumerate(documents) if document]
    try:
        done = convert_documents([raws[k] for k in live], convert)
    except (ValueError, LookupError):
        for k in live:
            try:
                raws[k] = convert_document(raws[k], convert)
            except (ValueError, LookupError) as error:
                errors[k] = f"{names[k]}: {error}"
        return raws, errors
    for k, new in zip(live, done, strict=True):
        raws[k] = new
    return raws, errors


def convert_books(found: DataFrame, convert: Converter) -> DataFrame:
    """(path, content, error) for (path, content) rows of books, each path once; the same bytes as ``convert_epub``."""
    ddl = f"path string, {ENTRY_DDL}"
    rows = found.select("path", "content").mapInArrow(_opened, ddl)
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in pieces.pieces(tuple(batch.columns)):
                held = dict(zip(_ROWS.names, columns, strict=True))
                raws, errors = _converted(*(held[name].to_pylist() for name in ("name", "document", "raw", "error")), convert)
                held |= {"raw": pa.array(raws, pa.binary()), "error": pa.array(errors, pa.string())}
                yield pa.RecordBatch.from_arrays(list(held.values()), schema=_ROWS)

    def books(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_() -> Iterator[tuple[str, Entry]]:
            for batch in batches:
                for columns in pieces.pieces(tuple(batch.columns)):
                    for path, *entry in zip(*(c.to_pylist() for c in columns), strict=True):
                        yield path, Entry(*entry)

        done, size = [], 0
        for path, group in groupby(rows_(), key=itemgetter(0)):
            book = (entry for _, entry in group)
            first = next(book)
            if first.ordinal < 0:
                problems = [e.error for e in (first, *book) if e.error]
                content = None if problems else written([])[0]
            else:
                content, problems = written(chain((first,), book))
            done.append((path, content, "; ".join(problems) or None))
            size += len(content or b"")
            if size >= pieces.PIECE_BYTES:
                yield _batch(done, _BOOKS)
                done, size = [], 0
        if done:
            yield _batch(done, _BOOKS)

    spread = rows.repartition(n, "path", "ordinal").mapInArrow(each, ddl)
    return spread.repartition(n, "path").sortWithinPartitions("path", "ordinal").mapInArrow(books, "path string, content binary, error string")
