"""Saved crawls as Spark data sources: ``spark.read.format("manifest" | "cards" | "page_text").load(folder)`` after ``register(spark)``.

Files are listed on the driver (names and sizes alone) and dealt to partitions of about PARTITION_BYTES; each partition
opens its own files. With ``option("push", True)`` equality filters are pushed: those on ``file`` leave out files before they are
opened, those on other columns leave out rows before they reach Spark. Spark 4.1 keeps what was pushed with the loaded frame, so where
one plan filters a folder in two ways, load it once for each; without the option Spark filters and one frame serves all. Each row has its
``file``; what cannot be read gives one row with ``error`` and nulls beside. Folders are what ``pyarrow.fs`` can open: local, HDFS or
object stores.

* manifest: a row per line of JSON (``*.jsonl``, ``*.json``), with its number. * cards: a row per card of ``*.html``.
* page_text: a row per page of a document of page texts (``*.json``); names that begin with an underscore are no documents.
"""

from __future__ import annotations

import codecs
import json
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.types import StructType

from oathmill.sources.cards import _FIELDS, cards

PARTITION_BYTES = 32_000_000
#: Bytes of a file of lines that are read at a time, and rows in an Arrow batch.
PIECE, ROWS = 1 << 20, 4096
_MANIFEST = ("name", "party", "status", "state", "constituency", "profile_url", "affidavit_id", "pdf_path", "error")


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(None)
        self.paths = paths


class FileReader(DataSourceReader):
    """Rows out of the files of a folder; ``source.rows_of`` says which."""

    def __init__(self, source: SavedFiles, folder: str, schema: StructType):
        self.rows_of, self.rows_of_lines, self.endings, self.folder, self.schema = type(source).rows_of, type(source).rows_of_lines, type(source).endings, folder, schema
        self.equal: dict[str, object] = {}

    def partitions(self) -> list[Files]:
        store, root = fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), self.folder.removeprefix("file:"))
        found = sorted((f.path, f.size or 0) for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and f.path.endswith(self.endings) and not f.base_name.startswith(("_", ".")))
        wanted = self.equal.get("file")
        parts, size = [[]], 0
        for path, n in found:
            if wanted is not None and path.rsplit("/", 1)[-1] != wanted:
                continue
            if parts[-1] and size + n > PARTITION_BYTES:
                parts.append([])
                size = 0
            parts[-1].append(path)
            size += n
        return [Files(p) for p in parts]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store = fs.FileSystem.from_uri(self.folder)[0] if "://" in self.folder else fs.LocalFileSystem()
        kinds = {f.name: {"int": pa.int32(), "boolean": pa.bool_()}.get(f.dataType.simpleString(), pa.string()) for f in self.schema}
        for path in partition.paths:
            file = {"file": path.rsplit("/", 1)[-1]}
            kept = (r for r in (x | file for x in self._rows(store, path)) if all(r.get(c) is not None and r.get(c) == v for c, v in self.equal.items()))
            while rows := list(islice(kept, ROWS)):
                yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], kind) for c, kind in kinds.items()], list(kinds))

    def _rows(self, store: fs.FileSystem, path: str) -> Iterator[dict]:
        """A file's rows: all, or one that says why it cannot be read. Lines are read a piece at a time, once the whole file is known to be text."""
        try:
            if self.rows_of_lines is None:
                with store.open_input_stream(path) as stream:
                    found = list(self.rows_of(stream.read().decode()))
            else:
                with store.open_input_stream(path) as stream:
                    check = codecs.getincrementaldecoder("utf-8")()
                    while piece := stream.read(PIECE):
                        check.decode(piece)
                    check.decode(b"", True)
        except (ValueError, OSError) as e:
            yield {"error": f"{type(e).__name__}: {e}"[:500]}
            return
        if self.rows_of_lines is None:
            yield from found
            return
        with store.open_input_stream(path) as stream:
            yield from self.rows_of_lines(_lines(stream))


def _lines(stream: pa.NativeFile) -> Iterator[str]:
    """What stands between the line feeds of a file; a line alone is held."""
    parts: list[bytes] = []
    while piece := stream.read(PIECE):
        first, *rest = piece.split(b"\n")
        parts.append(first)
        for line in rest:
            yield b"".join(parts).decode()
            parts = [line]
    yield b"".join(parts).decode()


class PushingReader(FileReader):
    """Takes equality filters on whole columns over from Spark."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and self.equal.get(f.attribute[0], f.value) == f.value:
                self.equal[f.attribute[0]] = f.value
            else:
                yield f


class SavedFiles(DataSource):
    """A folder of saved files; subclasses say what rows a file's text has, or its lines, where a line is read by itself."""

    endings: tuple[str, ...] = ()
    rows_of_lines: Callable[[Iterable[str]], Iterator[dict]] | None = None

    @staticmethod
    def rows_of(text: str) -> Iterator[dict]:
        raise NotImplementedError

    def reader(self, schema: StructType) -> FileReader:
        kind = PushingReader if str(self.options.get("push", "")).lower() == "true" else FileReader
        return kind(self, self.options["path"], schema)


def _text(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else str(value)


class Manifest(SavedFiles):
    endings = (".jsonl", ".json")

    @classmethod
    def name(cls) -> str:
        return "manifest"

    def schema(self) -> str:
        return ", ".join(f"{c} string" for c in _MANIFEST) + ", download_attempted boolean, download_succeeded boolean, file string, line int"

    @staticmethod
    def rows_of(text: str) -> Iterator[dict]:
        return Manifest.rows_of_lines(text.split("\n"))

    @staticmethod
    def rows_of_lines(lines: Iterable[str]) -> Iterator[dict]:
        for line, raw in enumerate(lines):
            if not raw.strip():
                continue
            try:
                found = json.loads(raw)
            except ValueError as e:
                yield {"line": line, "error": f"line {line}: {e}"}
                continue
            if not isinstance(found, dict):
                yield {"line": line, "error": f"line {line}: no object"}
                continue
            flags = {k: v if isinstance(v := found.get(k), bool) else None for k in ("download_attempted", "download_succeeded")}
            yield {c: _text(found.get(c)) for c in _MANIFEST} | flags | {"line": line}


class Cards(SavedFiles):
    endings = (".html", ".htm")

    @classmethod
    def name(cls) -> str:
        return "cards"

    def schema(self) -> str:
        return ", ".join(f"{c} string" for c in _FIELDS) + ", pos int, file string, error string"

    @staticmethod
    def rows_of(text: str) -> Iterator[dict]:
        return ({**card, "pos": i} for i, card in enumerate(cards(text)))


class PageText(SavedFiles):
    endings = (".json",)

    @classmethod
    def name(cls) -> str:
        return "page_text"

    def schema(self) -> str:
        return "source_pdf string, page int, method string, text string, file string, error string"

    @staticmethod
    def rows_of(text: str) -> Iterator[dict]:
        found = json.loads(text)
        if not isinstance(found, dict) or not isinstance(found.get("pages"), list):
            raise ValueError("no document of pages")
        for i, page in enumerate(found["pages"], 1):
            number = page.get("page") if isinstance(page.get("page"), int) else i
            yield {"source_pdf": _text(found.get("source_pdf")), "page": number, "method": _text(page.get("method")), "text": _text(page.get("text"))}


def register(spark: SparkSession) -> None:
    """Make the sources known to a session, and let filters be pushed into those that take them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Manifest, Cards, PageText):
        spark.dataSource.register(source)
