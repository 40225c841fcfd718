"""Files as tables of cells: (source_id, sheet, row_no, cells, numbers), without a header.

``cells`` are texts; ``numbers`` holds the values of a workbook's number cells in the same places (null elsewhere,
and for files of text), so that they need not be read from their writing.

Reports have preambles and ragged rows, so a file is parsed whole by one task; a table
of many files is spread over tasks by file. Null and empty files give no rows.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "source_id string, sheet string, row_no int, cells array<string>, numbers array<double>"
_DELIMITERS = ",;\t|"
#: Rows of a file that a task passes on at a time.
ROWS = 5000


def decode(data: bytes) -> str:
    """UTF-8 where valid, else Windows-1252."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("cp1252", "replace")


def delimiter_of(line: str) -> str:
    """The most frequent of ``, ; TAB |`` outside quotes; a comma if there is none."""
    bare = "".join(line.split('"')[::2])
    best = max(_DELIMITERS, key=bare.count)
    return best if bare.count(best) else ","


def split_rows(text: str) -> list[list[str]]:
    """Delimited text with quotes (doubled inside), any line ends, ragged rows; empty rows go.

    Where every row is a single cell that holds delimiters itself, it is split once more.
    """
    text = text.removeprefix("﻿")
    delimiter = delimiter_of(text.partition("\n")[0])
    token = re.compile(f'"((?:[^"]|"")*)(?:"|\\Z)|({re.escape(delimiter)})|(\r\n|\n|\r)|([^"{re.escape(delimiter)}\r\n]+)')
    rows, row, cell = [], [], []
    for quoted, sep, end, plain in (m.groups() for m in token.finditer(text)):
        if quoted is not None:
            cell.append(quoted.replace('""', '"'))
        elif plain is not None:
            cell.append(plain)
        else:
            row.append("".join(cell))
            cell = []
            if end is not None:
                rows.append(row)
                row = []
    if row or cell:
        rows.append([*row, "".join(cell)])
    rows = [r for r in rows if any(r)]
    alone = [[c for c in r if c] for r in rows]
    if rows and all(len(a) == 1 and re.search("[,;\t]", a[0]) for a in alone) and sum(len(r) for r in rows) >= len(rows):
        inner = "\n".join(a[0] for a in alone)
        if inner != text:
            return split_rows(inner)
    return rows


def pasted_rows(text: str) -> list[list[str]]:
    """Lines and tabs; cells are trimmed, blank rows go."""
    rows = [[c.replace("\xa0", " ").strip() for c in line.split("\t")] for line in re.split("\r\n|\n|\r", text)]
    return [r for r in rows if any(r)]


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


class Number(str):
    """A workbook's number as text, with its value."""

    value: float

    def __new__(cls, written: str):
        value = float(written)
        own = super().__new__(cls, str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value))
        own.value = value
        return own


def _number(written: str) -> str:
    try:
        return Number(written)
    except ValueError:
        return written


def xlsx_tables(data: bytes) -> list[tuple[str, list[list[str]]]]:
    """Each sheet's rows: shared and inline strings, formula results, numbers as written; errors are empty, blank rows go."""
    local = lambda e: e.tag.rpartition("}")[2]
    text = lambda e: "".join(t.text or "" for t in e.iter() if local(t) == "t")
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        parse = lambda name: ElementTree.fromstring(z.read(name).removeprefix(b"\xef\xbb\xbf"))
        names = set(z.namelist())
        shared = [text(e) for e in parse("xl/sharedStrings.xml") if local(e) == "si"] if "xl/sharedStrings.xml" in names else []
        links = {e.get("Id"): e.get("Target") for e in parse("xl/_rels/workbook.xml.rels")}
        out = []
        for sheet in (e for e in parse("xl/workbook.xml").iter() if local(e) == "sheet"):
            target = links[next(v for k, v in sheet.attrib.items() if k.rpartition("}")[2] == "id")]
            rows = []
            for row in (e for e in parse(target.lstrip("/") if target.startswith("/") else f"xl/{target}").iter() if local(e) == "row"):
                cells: dict[int, str] = {}
                for c in row:
                    value = next((v.text or "" for v in c if local(v) == "v"), "")
                    kind = c.get("t")
                    value = shared[int(value)] if kind == "s" and value else text(c) if kind == "inlineStr" else "" if kind == "e" else _number(value) if kind in (None, "n") and value else value
                    cells[_column(c.get("r") or "") if c.get("r") else len(cells)] = value
                line = [cells.get(i, "") for i in range(max(cells, default=-1) + 1)]
                if any(line):
                    rows.append(line)
            out.append((sheet.get("name") or "", rows))
    return out


def tables_of(name: str, data: bytes) -> list[tuple[str, list[list[str]]]]:
    """A file's tables by its extension: workbook, pasted text, else delimited text."""
    kind = name.lower().rpartition(".")[2]
    if kind in ("xlsx", "xlsm"):
        return xlsx_tables(data)
    if kind == "xls":
        raise ValueError(f"{name}: old workbooks can't be read; save it as xlsx")
    return [("", pasted_rows(decode(data)) if kind == "txt" else split_rows(decode(data)))]


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """The cells of all files under ``path`` (a file, a folder or a pattern), read by Spark itself."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            for p, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for sheet, whole in tables_of(p, data or b""):
                    for a in range(0, len(whole), ROWS):
                        rows = whole[a : a + ROWS]
                        n, values = len(rows), [[getattr(c, "value", None) for c in r] if any(isinstance(c, Number) for c in r) else None for r in rows]
                        yield pa.RecordBatch.from_arrays([pa.array([p] * n, pa.string()), pa.array([sheet] * n, pa.string()), pa.array(range(a, a + n), pa.int32()), pa.array([[str(c) for c in r] for r in rows], pa.list_(pa.string())), pa.array(values, pa.list_(pa.float64()))], names=["source_id", "sheet", "row_no", "cells", "numbers"])

    return files.mapInArrow(run, SCHEMA)


def pasted_cells(spark: SparkSession, text: str, source_id: str = "pasted") -> DataFrame:
    """Cells of a text from the clipboard."""
    rows = [(source_id, "", i, r, None) for i, r in enumerate(pasted_rows(text))]
    return spark.createDataFrame(rows, SCHEMA)


def head(cells: DataFrame, n: int = 20) -> list[list[str]]:
    """A source's first rows, for detection on the driver."""
    return [r.cells for r in cells.filter(F.col("row_no") < n).orderBy("row_no").select("cells").collect()]
