"""Spreadsheet files as rows of cells.

Files come from Spark's binaryFile source; each is opened in a task and leaves as one row
per non-empty cell. The content decides the format, not the name. Legacy .xls is detected
and reported as unsupported, since no reader for it is at hand.
"""

from __future__ import annotations

import csv
import hashlib
import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = "workbook_id string, path string, format string, warning string, error string, sheet int, sheet_name string, row int, col int, value string, formula string, style string, hidden boolean"
COLUMNS = [c.split()[0] for c in CELLS.split(", ")]
WIDEST_SPAN = 10_000
SUFFIXES = {"xlsx": {"xlsx"}, "xls": {"xls"}, "excel_html": {"xls", "html", "htm"}, "csv": {"csv"}}


class SheetError(ValueError):
    pass


def text_of(data: bytes) -> str | None:
    """UTF-8 with or without a mark, else GB18030; None for what holds NUL or is neither."""
    if b"\0" in data:
        return None
    for encoding in ("utf-8-sig", "gb18030"):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return None


def dialect(text: str) -> str | None:
    """The delimiter with which the first lines have two columns or more, if there are two lines."""
    lines = [x for x in text[:65_536].splitlines() if x.strip()][:50]
    best = max(",;\t|", key=lambda d: (min((x.count(d) for x in lines), default=0), sum(x.count(d) for x in lines)))
    return best if len(lines) >= 2 and sum(best in x for x in lines) >= 2 else None


def detect(data: bytes) -> str:
    if not data:
        raise SheetError("EMPTY_DOCUMENT")
    if data[:4] == b"PK\x03\x04":
        try:
            names = zipfile.ZipFile(io.BytesIO(data)).namelist()
        except zipfile.BadZipFile:
            names = []
        if "xl/workbook.xml" not in names:
            raise SheetError("UNSUPPORTED_ZIP_DOCUMENT")
        return "xlsx"
    if data[:8] == bytes.fromhex("D0CF11E0A1B11AE1"):
        return "xls"
    text = text_of(data)
    if text is not None:
        head = text[:20_000].lower()
        if "<html" in head and ("urn:schemas-microsoft-com:office:excel" in head or "<table" in head and "excel" in head):
            return "excel_html"
        if dialect(text):
            return "csv"
    raise SheetError("UNSUPPORTED_DOCUMENT_FORMAT")


def csv_cells(data: bytes) -> Iterator[tuple]:
    text = text_of(data)
    for r, line in enumerate(csv.reader(io.StringIO(text), delimiter=dialect(text)), 1):
        for c, value in enumerate(line, 1):
            if value != "":
                yield 0, "CSV", r, c, value, None, None, False


class _Tables(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.cells, self.taken, self.row, self.table, self.text, self.at, self.off = [], set(), 0, -1, None, None, False

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "table":
            self.table, self.row, self.taken = self.table + 1, 0, set()
        elif tag == "tr":
            self.row, self.col = self.row + 1, 1
            self.off = "display:none" in a.get("style", "").replace(" ", "").lower()
        elif tag in ("td", "th") and self.row:
            while (self.row, self.col) in self.taken:
                self.col += 1
            span = [min(WIDEST_SPAN, int(a[k])) if a.get(k, "").isdigit() else 1 for k in ("rowspan", "colspan")]
            self.taken.update((self.row + i, self.col + j) for i in range(max(1, span[0])) for j in range(max(1, span[1])))
            self.text, self.at = [], (self.row, self.col)

    def handle_data(self, data):
        if self.text is not None:
            self.text.append(data)

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.text is not None:
            if value := "".join(self.text).strip():
                self.cells.append((self.table, *self.at, value, self.off))
            self.text = None


def html_cells(data: bytes) -> Iterator[tuple]:
    text = text_of(data)
    names = re.findall(r"<x:name>(.*?)</x:name>", text, re.I | re.S)
    parser = _Tables()
    parser.feed(text)
    for t, r, c, value, off in parser.cells:
        yield t, names[t].strip() if t < len(names) else f"Sheet{t + 1}", r, c, value, None, None, off


def place(reference: str) -> tuple[int, int]:
    """B3: row 3, column 2."""
    letters, digits = re.fullmatch(r"([A-Z]+)(\d+)", reference).groups()
    n = 0
    for x in letters:
        n = n * 26 + ord(x) - 64
    return int(digits), n


#: The numbers of built-in formats that show dates or times, and the letters that do in others.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
DATE_LETTERS = re.compile("[ymdhs]", re.I)


def date_styles(styles: bytes | None) -> set[str]:
    """The cell styles whose number format shows a date or a time."""
    if styles is None:
        return set()
    root = ElementTree.fromstring(styles)
    tag = lambda e: e.tag.rpartition("}")[2]
    bare = lambda code: re.sub(r'"[^"]*"|\\.|_.|\*.|\[(?![hms]+\])[^\]]*\]', "", code, flags=re.I)  # noqa: E731  without texts, escapes, colours and locales
    own = {int(e.get("numFmtId")): e.get("formatCode", "") for e in root.iter() if tag(e) == "numFmt"}
    formats = [int(x.get("numFmtId", 0)) for e in root.iter() if tag(e) == "cellXfs" for x in e]
    return {str(i) for i, f in enumerate(formats) if (DATE_LETTERS.search(bare(own[f])) if f in own else f in DATE_FORMATS)}


def date_text(serial: str, from_1904: bool) -> str:
    """A serial number as an ISO date, a time below one day, or both; anything else as it is."""
    try:
        days = float(serial)
    except ValueError:
        return serial
    if not 0 <= days < 2_958_466:
        return serial
    moment = timedelta(seconds=round(days * 86_400))
    if days < 1 and not from_1904:
        return f"{datetime.min + moment:%H:%M:%S}"
    if from_1904:
        start = datetime(1904, 1, 1)
    else:  # the other calendar counts a 29 February 1900, day 60
        start = datetime(1899, 12, 31) if days < 60 else datetime(1899, 12, 30)
    found = start + moment
    return found.date().isoformat() if moment.seconds == 0 else found.isoformat()


def xlsx_cells(data: bytes) -> Iterator[tuple]:
    """Values as the file shows them, dates and truth values too, formulas beside their stored results, never evaluated."""
    book = zipfile.ZipFile(io.BytesIO(data))
    tag = lambda e: e.tag.rpartition("}")[2]
    names = {n.replace("\\", "/").lower(): n for n in book.namelist()}
    shared = []
    has_shared = any(k.endswith("sharedstrings.xml") for k in names)  # a part that no cell needs may be missing
    for path in (n for k, n in names.items() if k.endswith("sharedstrings.xml")):  # wherever it has been put
        shared = ["".join(t.text or "" for t in item.iter() if tag(t) == "t") for item in ElementTree.fromstring(book.read(path)) if tag(item) == "si"]
    relations = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    parts_of_book = list(ElementTree.fromstring(book.read("xl/workbook.xml")).iter())
    sheets = [e for e in parts_of_book if tag(e) == "sheet"]
    from_1904 = any(e.get("date1904") in ("1", "true") for e in parts_of_book if tag(e) == "workbookPr")
    dates = date_styles(book.read(names["xl/styles.xml"]) if "xl/styles.xml" in names else None)
    for i, sheet in enumerate(sheets):
        target = relations[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))].lstrip("/")
        path = names[(target if target.startswith("xl/") else f"xl/{target}").lower()]
        hidden_columns: set[int] = set()
        row_hidden = False
        for event, e in ElementTree.iterparse(book.open(path), ("start", "end")):
            kind = tag(e)
            if event == "start":
                if kind == "row":
                    row_hidden = e.get("hidden") in ("1", "true")
                elif kind == "col" and e.get("hidden") in ("1", "true") and int(e.get("max")) - int(e.get("min")) <= 4096:
                    hidden_columns |= set(range(int(e.get("min")), int(e.get("max")) + 1))
            elif kind == "c":
                parts = {tag(x): x for x in e}
                raw = parts["v"].text if "v" in parts else None
                if e.get("t") == "s" and raw is not None:
                    if not has_shared:
                        raise SheetError("SHARED_STRINGS_MISSING")
                    raw = shared[int(raw)] if int(raw) < len(shared) else None
                elif e.get("t") == "inlineStr":
                    raw = "".join(t.text or "" for t in e.iter() if tag(t) == "t")
                elif e.get("t") == "b" and raw is not None:
                    raw = "true" if raw == "1" else "false"
                elif e.get("t", "n") == "n" and raw is not None and e.get("s") in dates:
                    raw = date_text(raw, from_1904)
                formula = "=" + (parts["f"].text or "") if "f" in parts else None
                if raw not in (None, "") or formula:
                    r, c = place(e.get("r"))
                    yield i, sheet.get("name"), r, c, raw, formula, e.get("s"), row_hidden or c in hidden_columns
                e.clear()


MERGED = re.compile(rb'<(?:\w+:)?mergeCell\s[^>]*?ref="([A-Z]+\d+)(?::([A-Z]+\d+))?"')
MERGES = "workbook_id string, sheet int, top int, left int, bottom int, right int"


def xlsx_merges(data: bytes) -> Iterator[tuple]:
    """sheet, top, left, bottom, right of the merged cells of a file; files of other formats have none."""
    if data[:4] != b"PK\x03\x04":
        return
    book = zipfile.ZipFile(io.BytesIO(data))
    for i, path in enumerate(sheet_parts(book)):
        for a, b in MERGED.findall(book.read(path)):
            (top, left), (bottom, right) = place(a.decode()), place((b or a).decode())
            yield i, min(top, bottom), min(left, right), max(top, bottom), max(left, right)


def sheet_parts(book: zipfile.ZipFile) -> list[str]:
    """The parts that hold a book's sheets, in order."""
    tag = lambda e: e.tag.rpartition("}")[2]
    names = {n.replace("\\", "/").lower(): n for n in book.namelist()}
    relations = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    targets = [relations[next(v for k, v in e.attrib.items() if k.endswith("}id"))].lstrip("/") for e in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if tag(e) == "sheet"]
    return [names[(t if t.startswith("xl/") else f"xl/{t}").lower()] for t in targets]


def read_merges(files: DataFrame) -> DataFrame:
    """files: path, content. The merged cells of xlsx files, for with_merged; files that can't be read have none, as read_cells tells of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for content in batch["content"]:
                try:
                    found += [(f"workbook:{hashlib.sha256(bytes(content)).hexdigest()}", *m) for m in xlsx_merges(bytes(content))]
                except (KeyError, ValueError, StopIteration, ElementTree.ParseError, zipfile.BadZipFile):
                    continue
            yield pd.DataFrame(found, columns=[c.split()[0] for c in MERGES.split(", ")])

    return files.select("content").mapInPandas(run, MERGES).distinct()


READERS = {"csv": csv_cells, "excel_html": html_cells, "xlsx": xlsx_cells}


def cells_of(path: str, data: bytes) -> pd.DataFrame:
    """All cells of one file, or one row that says why there are none."""
    sha = hashlib.sha256(data).hexdigest()
    blank = {"workbook_id": f"workbook:{sha}", "path": path, "format": None, "warning": None, "error": None}
    try:
        blank["format"] = kind = detect(data)
        suffix = path.rpartition("/")[2].rpartition(".")[2].lower() if "." in path.rpartition("/")[2] else ""
        if suffix not in SUFFIXES[kind]:
            blank["warning"] = "EXTENSION_MISMATCH"
        if kind not in READERS:
            raise SheetError("XLS_UNSUPPORTED")
        made = pd.DataFrame(READERS[kind](data), columns=COLUMNS[5:])
    except (SheetError, KeyError, ValueError, ElementTree.ParseError, zipfile.BadZipFile, csv.Error) as e:
        blank["error"] = str(e) if isinstance(e, SheetError) else f"UNREADABLE: {e}"
        made = pd.DataFrame([[None] * 8], columns=COLUMNS[5:])
    for k, v in blank.items():
        made[k] = v
    return made[COLUMNS]


def read_cells(files: DataFrame) -> DataFrame:
    """files: path, content, as from binaryFile. Cells of files, and errors of those without."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                yield cells_of(path, bytes(content))

    return files.select("path", "content").mapInPandas(run, CELLS)


def sheet_id(workbook_id: Column, sheet: Column) -> Column:
    """The id of a sheet, which no renaming of its file changes."""
    return F.concat(workbook_id, F.lit(":sheet:"), sheet.cast("string"))


def with_ids(cells: DataFrame) -> DataFrame:
    """cells with sheet_id and cell_id, made of the file's content and the place in it; rows without a cell have neither."""
    own = sheet_id(F.col("workbook_id"), F.col("sheet"))
    return cells.withColumns({"sheet_id": own, "cell_id": F.concat(own, F.lit(":r"), F.col("row").cast("string"), F.lit(":c"), F.col("col").cast("string"))})


def distinct_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, content of all files below a folder whose names fit the pattern, as *.{xlsx,csv}; of files with one content the first path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    first = files.select("path", F.sha2("content", 256).alias("sha")).groupBy("sha").agg(F.min("path").alias("path")).select("path")
    return files.join(first, "path", "left_semi")


def read_folder(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Cells of all files below a folder whose names fit the pattern; a content that several files have is read once, under the first path."""
    return read_cells(distinct_files(spark, folder, pattern))
