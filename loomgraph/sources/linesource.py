"""N-Triples and N-Quads as a data source of Spark's own: ``spark.read.format("ntriples")``.

Files are cut into splits at any byte: a split's lines are those that begin in it. Equalities on ``s``, ``p``, ``o`` and ``g`` that Spark
pushes down choose lines by their bytes before these are taken apart, so that a rare predicate costs little more than reading. Paths are
those that Python can open on each executor: shared disks, and what ``pyarrow.fs`` knows by its scheme. ``read_ntriples`` reads
any path of Spark's and is the better choice where all lines are wanted.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

from ..functions.terms import TRIPLE, XSD

SCHEMA = TRIPLE + ", g string"
SPLIT, ROWS = 64 << 20, 8192
_NODE = rb"(?:<([^>]*)>|(_:[^\s<>\"]+))"
_LINE = re.compile(rb"\s*" + _NODE + rb"\s+<([^>]*)>\s+(?:" + _NODE + rb'|"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?)(?:\s*' + _NODE + rb")?\s*\.\s*(?:#.*)?", re.S)
_MARKS = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
_ESCAPE = re.compile(r"((?:\\u[0-9A-Fa-f]{4})+)|\\U([0-9A-Fa-f]{8})|\\(.)", re.S)


def _said(m: re.Match) -> str:
    if m[1]:
        return bytes.fromhex(m[1].replace("\\u", "")).decode("utf-16-be", "surrogatepass")
    return chr(int(m[2], 16)) if m[2] else _MARKS.get(m[3], m[0])


def _text(raw: bytes | None) -> str | None:
    if raw is None:
        return None
    text = raw.decode("utf-8")
    return _ESCAPE.sub(_said, text) if "\\" in text else text


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], quads: bool):
        self.path, self.split, self.quads = options["path"], int(options.get("splitBytes", SPLIT)), quads
        self.wanted: dict[str, str] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Equalities choose lines; Spark tests all filters again, so that bytes need only be necessary."""
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in ("s", "p", "o", "g") and isinstance(f.value, str):
                self.wanted[f.attribute[0]] = f.value
            yield f

    def partitions(self) -> list[Split]:
        files, path = pa.fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (pa.fs.LocalFileSystem(), self.path)
        found = files.get_file_info(path)
        if found.type == pa.fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        infos = [found] if found.type == pa.fs.FileType.File else files.get_file_info(pa.fs.FileSelector(path))
        head = self.path[: len(self.path) - len(path)] if self.path.endswith(path) else ""
        hidden = lambda x: x.base_name[0] in "_."
        return [Split(head + x.path, at, min(at + self.split, x.size)) for x in infos if x.type == pa.fs.FileType.File and not hidden(x) for at in range(0, x.size, self.split)]

    def _needles(self) -> list[bytes]:
        """Bytes that a line must hold: IRIs and names stand as they are unless they are escaped."""
        return [v.encode() for v in self.wanted.values() if not re.search(r"[^\x20-\x5b\x5d-\x7e]|[\"]", v)]

    def _lines(self, split: Split) -> Iterator[bytes]:
        files, path = pa.fs.FileSystem.from_uri(split.path) if "://" in split.path or split.path.startswith("file:") else (pa.fs.LocalFileSystem(), split.path)
        with files.open_input_file(path) as raw:
            # The byte before tells whether a line begins at the split's own first one.
            raw.seek(max(0, split.start - 1))
            at, rest, skip = max(0, split.start - 1), b"", split.start > 0
            while True:
                block = raw.read(1 << 20)
                lines = (rest + block).split(b"\n")
                rest = lines.pop() if block else b""
                for line in lines:
                    begun, at = at, at + len(line) + 1
                    if skip:
                        skip = False
                        continue
                    if begun >= split.end:
                        return
                    yield line
                if not block:
                    return

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.string()) for c in ("s", "p", "o", "o_kind", "o_datatype", "o_lang", "src", *(["g"] if self.quads else []))])
        needles, rows = self._needles(), []
        for line in self._lines(split):
            # A value with an escape in it may be spelled in two ways; those lines are taken apart.
            if needles and not all(n in line for n in needles) and b"\\" not in line:
                continue
            if not line.strip() or line.lstrip().startswith(b"#"):
                continue
            m = _LINE.fullmatch(line)
            if not m or (not self.quads and (m[9] or m[10])):
                raise ValueError(f"not a triple: {line.decode('utf-8', 'replace')}")
            literal = m[6] is not None
            row = [_text(m[1]) if m[2] is None else m[2].decode(), _text(m[3]), _text(m[6]) if literal else _text(m[4]) if m[5] is None else m[5].decode(), "literal" if literal else "blank" if m[5] else "iri"]
            row += [(_text(m[7]) or XSD + "string") if literal and not m[8] else None, _text(m[8]), None]
            if self.quads:
                row.append(_text(m[9]) if m[10] is None else m[10].decode())
            rows.append(row)
            if len(rows) == ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], schema=schema)


class NTriples(DataSource):
    """Options: ``path`` (a file or a folder of files), ``splitBytes``."""

    @classmethod
    def name(cls) -> str:
        return "ntriples"

    def schema(self) -> str:
        return TRIPLE

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, quads=False)


class NQuads(NTriples):
    @classmethod
    def name(cls) -> str:
        return "nquads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, quads=True)


def scan_lines(spark: SparkSession, path: str, quads: bool = False, split: int = SPLIT) -> DataFrame:
    """A file or folder through the data source, which is made known to the session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NQuads if quads else NTriples)
    return spark.read.format("nquads" if quads else "ntriples").option("splitBytes", split).load(path)
