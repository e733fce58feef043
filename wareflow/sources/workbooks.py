"""Sheets of xlsx workbooks, read by ranges of their inflated bytes.

A sheet is one deflated file in the workbook, which can only be inflated from its start; that is fast, while reading its
XML is slow.  So each task inflates up to its range, a block at a time, and reads the XML of the rows that begin in the
range only.  Of the shared strings it keeps those that its rows name.  What a task holds is bounded by its range.
"""

from __future__ import annotations

import glob
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_ROW = re.compile(rb"<(?:\w+:)?row[\s/>]")
_END = re.compile(rb"</(?:\w+:)?sheetData\s*>")
_ROOT = re.compile(rb"<(?:\w+:)?worksheet[^>]*>")
_DATA = re.compile(rb"<(?:\w+:)?sheetData\s*/?>")
_BLOCK = 1 << 20
#: Longer than any of the tags that are looked for.
_TAG = 32


class _Range(InputPartition):
    def __init__(self, path: str, low: int, high: int):
        super().__init__((path, low, high))
        self.path, self.low, self.high = path, low, high


class _XlsxReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.width, self.path = len(schema.names), options["path"]
        self.sheet, self.header = f"xl/worksheets/{options.get('sheet', 'sheet1')}.xml", options.get("header", "true").lower() == "true"
        self.per_task = int(options.get("bytespertask", str(16 << 20)))

    def partitions(self) -> list[InputPartition]:
        found: list[InputPartition] = []
        for path in sorted(glob.glob(self.path)) or [self.path]:
            with zipfile.ZipFile(path) as z:
                size = z.getinfo(self.sheet).file_size
            found += [_Range(path, at, min(size, at + self.per_task)) for at in range(0, size, self.per_task)]
        return found

    def read(self, partition: _Range) -> Iterator[tuple]:
        with zipfile.ZipFile(partition.path) as z:
            rows = list(self._rows(z, partition))
            strings = self._strings(z, {v for row in rows for kind, v in row.values() if kind == "s"})
        for row in rows:
            yield tuple(strings.get(row[k][1]) if row.get(k, ("", None))[0] == "s" else row.get(k, ("", None))[1] for k in range(self.width))

    def _rows(self, z: zipfile.ZipFile, part: _Range) -> Iterator[dict[int, tuple[str, str]]]:
        """The cells (kind, text) by column of each row that begins in the range."""
        with z.open(self.sheet) as f:
            head, text, at = self._head(f)
            begins, text, offset = self._next_row(f, text, 0, at)
            if begins is None:
                return
            start, text, offset = self._next_row(f, text, offset, max(part.low, begins))
            if start is None or start >= part.high:
                return
            end, text, offset = self._next_row(f, text, offset, max(part.high, start + 1), keep=start)
            body = text[start - offset : None if end is None else end - offset]
            closing = _END.search(body)
            body = body[: closing.start()] if closing else body
        name = re.match(rb"<([\w:]+)", head).group(1)
        root = ElementTree.fromstring(head + body + b"</" + name + b">")
        for number, row in enumerate(root):
            if not (self.header and start == begins and number == 0):
                yield self._cells(row)

    @staticmethod
    def _head(f) -> tuple[bytes, bytes, int]:
        """The sheet's opening tag, what has been read, and where its data begin."""
        text = b""
        while (found := _DATA.search(text)) is None:
            more = f.read(_BLOCK)
            if not more:
                raise ValueError("no sheet data")
            text += more
        return _ROOT.search(text).group(0), text, found.end()

    @staticmethod
    def _next_row(f, text: bytes, offset: int, wanted: int, keep: int | None = None) -> tuple[int | None, bytes, int]:
        """Where the first row at ``wanted`` or after begins; what lies before ``keep``, or before that row, may be let go."""
        look = wanted
        while True:
            if look - offset < len(text):
                found = _ROW.search(text, max(0, look - offset))
                if found:
                    return offset + found.start(), text, offset
                look = max(wanted, offset + len(text) - _TAG)
            more = f.read(_BLOCK)
            if not more:
                return None, text, offset
            drop = max(0, min((look if keep is None else keep) - offset, len(text)))
            text, offset = text[drop:] + more, offset + drop

    @staticmethod
    def _cells(row) -> dict[int, tuple[str, str]]:
        cells = {}
        for at, cell in enumerate(row):
            letters = "".join(c for c in cell.get("r", "") if c.isalpha())
            column = at
            if letters:
                column = 0
                for c in letters.upper():
                    column = column * 26 + ord(c) - 64
                column -= 1
            value = "".join(t.text or "" for t in cell.iter() if t.tag in (f"{_NS}v", f"{_NS}t"))
            if value or cell.get("t") == "inlineStr":
                cells[column] = cell.get("t", ""), value
        return cells

    @staticmethod
    def _strings(z: zipfile.ZipFile, wanted: set[str]) -> dict[str, str]:
        """The shared strings that are wanted, by their numbers as texts; the others are let go as they pass."""
        if not wanted:
            return {}
        left, found = {int(w) for w in wanted}, {}
        with z.open("xl/sharedStrings.xml") as f:
            events = ElementTree.iterparse(f, ("start", "end"))
            _, root = next(events)
            number = 0
            for event, item in events:
                if event == "end" and item.tag == f"{_NS}si":
                    if number in left:
                        # Readings beside the text (phonetic runs) are not part of it.
                        found[str(number)] = "".join(t.text or "" for part in item if part.tag != f"{_NS}rPh" for t in part.iter(f"{_NS}t"))
                        if len(found) == len(left):
                            break
                    number += 1
                    root.clear()
        return found


class XlsxSource(DataSource):
    """``spark.read.format("xlsx").schema(...)``: a sheet of one or several workbooks as strings, with ``path`` (or a pattern), ``sheet``, ``header`` and ``bytesPerTask``."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        raise ValueError("give a schema of strings for an xlsx sheet")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _XlsxReader(schema, self.options)
