"""The first sheet of an .xlsx workbook as rows of text, with the standard library only."""

from __future__ import annotations

import io
import re
import zipfile
from datetime import datetime, timedelta
from xml.etree import ElementTree

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
#: Built-in number formats that are dates.
DATE_FORMATS = {14, 15, 16, 17, 22, 45, 46, 47}


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")) for f in root.iter(f"{MAIN}numFmt") if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "").lower()))}
    cells = root.find(f"{MAIN}cellXfs")
    return {k for k, x in enumerate(cells if cells is not None else []) if int(x.get("numFmtId", 0)) in DATE_FORMATS | own}


def first_sheet(data: bytes, max_rows: int | None = None) -> list[list[str]]:
    """Header and rows; with max_rows, no more of the latter."""
    if data[:8] == b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
        raise ValueError("the old .xls format is not supported; save it as .xlsx")
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{MAIN}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")]
        dates = _date_styles(book)
        sheets = sorted((n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        if not sheets:
            raise ValueError("the workbook has no sheet")
        out: list[list[str]] = []
        for row in ElementTree.fromstring(book.read(sheets[0])).iter(f"{MAIN}row"):
            cells: list[str] = []
            for c in row.iter(f"{MAIN}c"):
                at = _column(c.get("r")) if c.get("r") else len(cells)
                cells += [""] * (at - len(cells))
                value, kind = c.find(f"{MAIN}v"), c.get("t")
                text = value.text if value is not None and value.text else ""
                if kind == "s" and text:
                    text = shared[int(text)]
                elif kind == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
                elif kind == "b":
                    text = "True" if text == "1" else "False"
                elif text and kind in (None, "n") and int(c.get("s", 0)) in dates:
                    moment = datetime(1899, 12, 30) + timedelta(days=float(text))
                    text = moment.strftime("%Y-%m-%d" if moment.time().isoformat() == "00:00:00" else "%Y-%m-%d %H:%M:%S")
                cells.append(text)
            out.append(cells)
            if max_rows is not None and len(out) > max_rows:
                break
        return out
