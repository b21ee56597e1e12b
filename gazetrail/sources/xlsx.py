"""Excel workbooks as a Spark data source: rows stream out of the zipped XML, all cells are strings."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _open(path: str) -> zipfile.ZipFile:
    return zipfile.ZipFile(re.sub(r"^file:(//)?", "", path))


def sheets(path: str) -> list[tuple[str, str]]:
    """(name, member) of each sheet, in order."""
    with _open(path) as z:
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        book = ET.fromstring(z.read("xl/workbook.xml"))
    member = lambda t: t.lstrip("/") if t.startswith("/") else f"xl/{t}"
    return [(s.get("name"), member(targets[s.get(f"{REL}id")])) for s in book.iter(f"{NS}sheet")]


def choose(path: str, sheet: str) -> str:
    """The member of a sheet given by number (all digits) or by name."""
    found = sheets(path)
    if sheet.isdigit():
        return found[int(sheet)][1]
    by_name = dict(found)
    if sheet not in by_name:
        raise KeyError(f"no sheet {sheet!r} in {list(by_name)}")
    return by_name[sheet]


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def rows(path: str, sheet: str) -> Iterator[list[str | None]]:
    """Cells of each row as text, a missing one None."""
    with _open(path) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            for _, e in ET.iterparse(io.BytesIO(z.read("xl/sharedStrings.xml"))):
                if e.tag == f"{NS}si":
                    shared.append("".join(t.text or "" for t in e.iter(f"{NS}t")))
                    e.clear()
        with z.open(choose(path, sheet)) as f:
            for _, e in ET.iterparse(f):
                if e.tag != f"{NS}row":
                    continue
                out: list[str | None] = []
                for i, c in enumerate(e.findall(f"{NS}c")):
                    at = _column(c.get("r")) if c.get("r") else i
                    out += [None] * (at + 1 - len(out))
                    kind, v = c.get("t"), c.find(f"{NS}v")
                    if kind == "inlineStr":
                        out[at] = "".join(t.text or "" for t in c.iter(f"{NS}t"))
                    elif v is not None and v.text is not None:
                        out[at] = shared[int(v.text)] if kind == "s" else {"0": "False", "1": "True"}.get(v.text, v.text) if kind == "b" else v.text
                e.clear()
                yield out


class _Reader(DataSourceReader):
    def __init__(self, path: str, sheet: str, width: int):
        self.path, self.sheet, self.width = path, sheet, width

    def partitions(self):
        return [InputPartition(self.path)]

    def read(self, partition):
        source = rows(partition.value, self.sheet)
        next(source, None)
        for r in source:
            if any(c is not None for c in r):
                yield tuple((r + [None] * self.width)[: self.width])


class XlsxSource(DataSource):
    """Format "xlsx": options path and sheet (number or name)."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def _sheet(self) -> str:
        return self.options.get("sheet", "0")

    def schema(self):
        from pyspark.sql import types as T

        head = next(rows(self.options["path"], self._sheet()), [])
        return T.StructType([T.StructField(str(h or f"column_{i}").strip(), T.StringType()) for i, h in enumerate(head)])

    def reader(self, schema):
        return _Reader(self.options["path"], self._sheet(), len(schema.fields))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(XlsxSource)
