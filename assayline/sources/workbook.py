"""Spreadsheet workbooks (.xlsx) by the standard library: the first sheet's cells as text, and plain sheets out."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _letters(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def cells(content: bytes) -> list[list[str | None]]:
    """The first sheet's rows."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{{{_NS['m']}}}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        name = sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))[0]
        rows = []
        for row in ElementTree.fromstring(z.read(name)).iter(f"{{{_NS['m']}}}row"):
            got: dict[int, str | None] = {}
            for i, c in enumerate(row.findall("m:c", _NS)):
                v, kind = c.find("m:v", _NS), c.get("t")
                text = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t")) if kind == "inlineStr" else (v.text if v is not None else None)
                got[_column(c.get("r")) if c.get("r") else i] = shared[int(text)] if kind == "s" and text is not None else text
            rows.append([got.get(i) for i in range(max(got, default=-1) + 1)])
    return rows


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet as text columns named by its first row. A workbook holds about a million rows at most, and the driver reads it."""
    content = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    header, *rows = cells(content)
    width = len(header)
    data = [tuple((r + [None] * width)[:width]) for r in rows]
    names = [str(h if h is not None else f"column{i + 1}") for i, h in enumerate(header)]
    return spark.createDataFrame(data, ", ".join(f"`{n}` string" for n in names))


def write_sheets(path: str, tables: dict[str, DataFrame], max_rows: int = 1_000_000) -> list[str]:
    """Write report tables as sheets of a local workbook and return the sheets' names.

    Rows come through an iterator, a partition at a time, and go straight into
    the file; what exceeds max_rows goes on in sheets with _2, _3 and so on.
    Names are cut to 31 characters, without those that sheets forbid.
    """
    names: list[str] = []
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, df in tables.items():
            base = re.sub(r"[\[\]:*?/\\]", "_", name)[:31] or "Sheet"
            rows, k = df.toLocalIterator(), 0
            row = next(rows, None)
            while row is not None or not k:
                n, k = 1, k + 1
                with z.open(f"xl/worksheets/sheet{len(names) + 1}.xml", "w", force_zip64=True) as sheet:
                    sheet.write(f'<worksheet xmlns="{_NS["m"]}"><sheetData>{_row(1, df.columns)}'.encode())
                    while row is not None and n <= max_rows:
                        n += 1
                        sheet.write(_row(n, row).encode())
                        row = next(rows, None)
                    sheet.write(b"</sheetData></worksheet>")
                names.append(_suffixed(base, k) if row is not None or k > 1 else base)
        sheets = range(1, len(names) + 1)
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>' + f'<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in sheets) + "</Types>")
        z.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_NS["m"]}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="r{i}"/>' for i, n in zip(sheets, names, strict=True)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in sheets) + "</Relationships>")
    return names


def _suffixed(base: str, k: int) -> str:
    return f"{base[: 31 - len(str(k)) - 1]}_{k}"


def _row(n: int, values) -> str:
    out = []
    for i, v in enumerate(values):
        if isinstance(v, (int, float)) and not isinstance(v, bool) and v == v and abs(v) != float("inf"):
            out.append(f'<c r="{_letters(i)}{n}"><v>{v!r}</v></c>')
        elif v is not None:
            out.append(f'<c r="{_letters(i)}{n}" t="inlineStr"><is><t>{escape(str(v))}</t></is></c>')
    return f'<row r="{n}">{"".join(out)}</row>'
