"""Spreadsheets (Office Open XML) as cells and cells as spreadsheets, with the standard library alone."""

from __future__ import annotations

import functools
import io
import itertools
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACK = "http://schemas.openxmlformats.org/package/2006"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
#: style -> bold, fill (RGB or None)
STYLES = {"plain": (0, None), "title": (1, None), "header": (1, "D9E1F2"), "section": (1, "EDEDED"), "subtotal": (1, "F7F7F7"), "review": (0, "F8CBAD"), "low": (0, "FFF2CC")}


_PLACE = {name: i for i, name in enumerate(STYLES)}
_UNSAID = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


@functools.lru_cache(4096)
def column_name(n: int) -> str:
    name = ""
    while n:
        n, r = divmod(n - 1, 26)
        name = chr(65 + r) + name
    return name


def column_number(ref: str) -> int:
    return _number_of(ref.rstrip("0123456789"))


@functools.lru_cache(4096)
def _number_of(letters: str) -> int:
    n = 0
    for c in letters:
        n = 26 * n + ord(c) - 64
    return n


@functools.cache
def _styles() -> str:
    fills = ["none", "gray125", *(f for _, f in STYLES.values() if f)]
    fill = lambda f: f'<fill><patternFill patternType="{f}"/></fill>' if len(f) != 6 else f'<fill><patternFill patternType="solid"><fgColor rgb="FF{f}"/></patternFill></fill>'
    xfs = "".join(f'<xf numFmtId="0" fontId="{b}" fillId="{fills.index(f) if f else 0}" borderId="0" applyFont="1" applyFill="1"/>' for b, f in STYLES.values())
    return f'{_HEAD}<styleSheet xmlns="{_MAIN}"><fonts count="2"><font><sz val="11"/><name val="Arial"/></font><font><b/><sz val="11"/><name val="Arial"/></font></fonts><fills count="{len(fills)}">{"".join(map(fill, fills))}</fills><borders count="1"><border/></borders><cellXfs count="{len(STYLES)}">{xfs}</cellXfs></styleSheet>'


def _sheet(cells) -> str:
    cells, rows = list(cells), {}
    for row, col, value, style in sorted(cells, key=lambda c: (c[0], c[1])):
        text = _UNSAID.sub("", "" if value is None else str(value))
        s = _PLACE.get(style, 0)
        rows.setdefault(row, []).append(f'<c r="{column_name(col)}{row}" s="{s}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>')
    body = "".join(f'<row r="{r}">{"".join(c)}</row>' for r, c in rows.items())
    return f'{_HEAD}<worksheet xmlns="{_MAIN}"><dimension ref="A1:{column_name(max((c[1] for c in cells), default=1))}{max(rows, default=1)}"/><cols><col min="1" max="1" width="40" customWidth="1"/></cols><sheetData>{body}</sheetData></worksheet>'


def write(sheets: dict) -> bytes:
    """sheets: name -> (row from 1, column from 1, value, style) cells. Values are written as text."""
    parts = {f"xl/worksheets/sheet{i}.xml": _sheet(c) for i, c in enumerate(sheets.values(), 1)} | _frame(tuple(sheets))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text)
    return out.getvalue()


@functools.lru_cache(256)
def _frame(sheets: tuple) -> dict:
    """The parts beside the sheets, which their names decide."""
    names = [re.sub(r"[\[\]:*?/\\]", "_", n)[:31] or "Sheet" for n in sheets]
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {"xl/styles.xml": _styles()}
    named = [*(f"xl/worksheets/sheet{i}.xml" for i in range(1, len(names) + 1)), *parts]
    over = "".join(f'<Override PartName="/{p}" ContentType="{kind}.{"styles" if "styles" in p else "worksheet"}+xml"/>' for p in named)
    parts["[Content_Types].xml"] = f'{_HEAD}<Types xmlns="{_PACK}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{over}</Types>'
    parts["_rels/.rels"] = f'{_HEAD}<Relationships xmlns="{_PACK}/relationships"><Relationship Id="r1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>'
    listed = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names, 1))
    parts["xl/workbook.xml"] = f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{listed}</sheets></workbook>'
    links = "".join(f'<Relationship Id="r{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
    parts["xl/_rels/workbook.xml.rels"] = f'{_HEAD}<Relationships xmlns="{_PACK}/relationships">{links}<Relationship Id="r0" Type="{_REL}/styles" Target="styles.xml"/></Relationships>'
    return parts


_tag = lambda t: f"{{{_MAIN}}}{t}"
_T = _tag("t")
_text = lambda e: "".join([t.text or "" for t in e.iter(_T)])


def sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """name and part of each sheet, in order."""
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(_tag("sheet")):
        target = links[s.get(f"{{{_REL}}}id")]
        out.append((s.get("name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    return out


def _shared(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    with z.open("xl/sharedStrings.xml") as f:
        return [_text(e) for _, e in ElementTree.iterparse(f) if e.tag == _tag("si")]


#: A sheet of at most this much XML is parsed at once, a longer one row by row.
_AT_ONCE = 1 << 20
_ROW, _CELL, _VALUE = _tag("row"), _tag("c"), _tag("v")


def _rows(z: zipfile.ZipFile, part: str):
    if z.getinfo(part).file_size <= _AT_ONCE:
        yield from ElementTree.fromstring(z.read(part)).iter(_ROW)
        return
    with z.open(part) as f:
        for _, e in ElementTree.iterparse(f):
            if e.tag == _ROW:
                yield e
                e.clear()


def cells_of(z: zipfile.ZipFile, part: str, first: int = 1, last: int | None = None):
    """(row, column, value) of the cells with a value of a sheet, as text, from row `first` to `last`; long sheets are read as a stream."""
    shared = None
    for e in _rows(z, part):
        number = int(e.get("r") or 0)
        if last is not None and number > last:
            return
        for c in e.iter(_CELL) if number >= first else ():
            kind = c.get("t")
            if kind == "inlineStr":
                value = _text(c)
            else:
                v = c.find(_VALUE)
                if kind == "s" and shared is None:
                    shared = _shared(z)
                value = None if v is None else shared[int(v.text)] if kind == "s" else v.text
            if value not in (None, ""):
                yield number, column_number(c.get("r")), value


def read(content: bytes) -> list:
    """(sheet, row, column, value) of every cell with a value, as text."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return [(name, *cell) for name, part in sheets(z) for cell in cells_of(z, part)]


def files(cells: DataFrame) -> DataFrame:
    """name, content of a spreadsheet per `name` of cells (name, sheet, row_no, col_no, value, style); a sheet is one statement."""
    names = ["name", "sheet", "row_no", "col_no", "value", "style"]

    def run(batches):
        import pyarrow as pa

        rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(len(names)))))
        done, size = [], 0
        for name, own in itertools.groupby(rows, key=lambda r: r[0]):
            sheets = {s: [r[2:] for r in g] for s, g in itertools.groupby(own, key=lambda r: r[1]) if s is not None}
            done.append((name, write(sheets)))
            size += len(done[-1][1])
            if len(done) == 1000 or size > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.binary())], ["name", "content"])
                done, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.binary())], ["name", "content"])

    typed = cells.select("name", "sheet", F.col("row_no").cast("long"), F.col("col_no").cast("long"), F.col("value").cast("string"), "style")
    return typed.repartition("name").sortWithinPartitions("name", "sheet", "row_no", "col_no").mapInArrow(run, "name string, content binary")


def cells_in(files: DataFrame) -> DataFrame:
    """name, sheet, row_no, col_no, value of the cells of spreadsheets (name, content)."""

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield from ((name, *c) for c in read(content))

    def framed(batches):
        import pyarrow as pa

        rows = run(batches)
        while some := list(itertools.islice(rows, 20_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()))], ["name", "sheet", "row_no", "col_no", "value"])

    return files.select("name", "content").mapInArrow(framed, "name string, sheet string, row_no int, col_no int, value string")


def comparison_cells(wide: DataFrame, sheet: str, order: str) -> DataFrame:
    """Cells of a table of some dozen rows: a header, then rows by `order`. Missing values are blank."""
    from pyspark.sql import Window

    value = lambda c, i, style: F.struct(F.lit(i).alias("col_no"), c.cast("string").alias("value"), F.lit(style).alias("style"))
    body = wide.select((F.row_number().over(Window.orderBy(order)) + 1).alias("row_no"), F.array(*(value(F.col(f"`{c}`"), i, "plain") for i, c in enumerate(wide.columns, 1))).alias("c"))
    head = wide.sparkSession.range(1).select(F.lit(1).alias("row_no"), F.array(*(value(F.lit(c), i, "header") for i, c in enumerate(wide.columns, 1))).alias("c"))
    return head.unionByName(body).select(F.lit(sheet).alias("sheet"), "row_no", F.inline("c"))
