"""Files: office documents by the standard library, text files, directories, rows in memory."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import PARSED_DOCUMENT

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _table(place: str, rows: list[list[str]]) -> dict:
    return {"page_or_section": place, "headers": rows[0], "rows": rows[1:]}


def _paragraph(p) -> str:
    out = []
    for x in p.iter():
        if x.tag == _W + "t":
            out.append(x.text or "")
        elif x.tag == _W + "tab":
            out.append("\t")
        elif x.tag in (_W + "br", _W + "cr"):
            out.append("\n")
    return "".join(out)


def parse_docx(data: bytes) -> tuple[str, list[dict]]:
    """Non-blank paragraphs and tables of two rows or more."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(_W + "body")
    paragraphs = [t for p in body.findall(_W + "p") if (t := _paragraph(p)).strip()]
    tables = []
    for i, t in enumerate(body.findall(_W + "tbl"), 1):
        rows = []
        for tr in t.findall(_W + "tr"):
            cells = []
            for tc in tr.findall(_W + "tc"):
                cells.append("\n".join(_paragraph(p) for p in tc.findall(_W + "p")).strip())
            rows.append(cells)
        if len(rows) >= 2:
            tables.append(_table(f"таблица {i}", rows))
    return "\n".join(paragraphs), tables


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _number(text: str) -> str:
    """A cell's number as Python shows it."""
    return text if re.fullmatch(r"-?\d+", text) else repr(float(text))


def parse_xlsx(data: bytes) -> tuple[str, list[dict]]:
    """Cached values: a table for each sheet that isn't blank; all its rows are text too."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in si.iter(_S + "t")))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        text, tables = [], []
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(_S + "sheet"):
            target = links[sheet.get(_R + "id")]
            path = target.lstrip("/") if target.startswith("/") else posixpath.normpath("xl/" + target)
            grid: list[list[str]] = []
            for row in ElementTree.fromstring(z.read(path)).iter(_S + "row"):
                cells: list[str] = []
                for c in row.findall(_S + "c"):
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [""] * (at - len(cells))
                    value, kind = c.find(_S + "v"), c.get("t")
                    if kind == "inlineStr":
                        cells.append("".join(t.text or "" for t in c.iter(_S + "t")))
                    elif value is None or value.text is None:
                        cells.append("")
                    elif kind == "s":
                        cells.append(shared[int(value.text)])
                    elif kind == "b":
                        cells.append(str(value.text == "1"))
                    else:
                        cells.append(value.text if kind in ("str", "e", "d") else _number(value.text))
                grid.append(cells)
            width = max(map(len, grid), default=0)
            rows = [r + [""] * (width - len(r)) for r in grid if any(x.strip() for x in r)]
            if rows:
                tables.append(_table(f"лист «{sheet.get('name')}»", rows))
                text += [" | ".join(r) for r in rows]
    return "\n".join(text), tables


def parse_pdf(data: bytes) -> tuple[str, list[dict]]:
    """Page texts and tables, if the optional PDF library is there."""
    try:
        import pdfplumber
    except ImportError:
        raise ValueError("PDF reader not installed") from None
    text, tables = [], []
    with pdfplumber.open(io.BytesIO(data)) as pdf:
        for i, page in enumerate(pdf.pages, 1):
            if words := page.extract_text():
                text.append(words)
            for j, raw in enumerate(page.extract_tables(), 1):
                if raw and len(raw) >= 2:
                    tables.append(_table(f"стр. {i}, таблица {j}", [[str(c) if c else "" for c in r] for r in raw]))
    return "\n\n".join(text), tables


def parse_txt(data: bytes) -> tuple[str, list[dict]]:
    return data.decode("utf-8", "replace"), []


PARSERS = {".pdf": parse_pdf, ".docx": parse_docx, ".xlsx": parse_xlsx, ".txt": parse_txt}


#: Readers of uploads: older office names go to the readers of the newer formats, anything else is text.
UPLOADS = PARSERS | {".doc": parse_docx, ".xls": parse_xlsx, "": parse_txt}


def parse(name: str, data: bytes, parsers: dict = PARSERS) -> dict:
    """A parsed document; what can't be read has ``error`` and no text. A reader '' takes other suffixes."""
    suffix = posixpath.splitext(name)[1].lower()
    out = {"filename": name, "text": "", "tables": [], "metadata": {"source": name, "filename": name}, "error": None}
    reader = parsers.get(suffix) or parsers.get("")
    if reader is None:
        return out | {"error": f"Unsupported file format: {suffix}"}
    try:
        text, tables = reader(data)
        return out | {"text": text, "tables": tables}
    except Exception as e:
        return out | {"error": f"{type(e).__name__}: {e}"}


def parse_files(files: DataFrame, parsers: dict = PARSERS) -> DataFrame:
    """Parsed documents of ``files`` (path, content), as the binaryFile source gives them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for frame in frames:
            rows = [parse(posixpath.basename(p), bytes(c), parsers) for p, c in zip(frame["path"], frame["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["filename", "text", "tables", "metadata", "error"])

    return files.select("path", "content").mapInPandas(run, PARSED_DOCUMENT)


def read_files(spark: SparkSession, path: str, parsers: dict = PARSERS) -> DataFrame:
    return parse_files(spark.read.format("binaryFile").load(path), parsers)


def read_directory(spark: SparkSession, folder: str, extensions: tuple[str, ...] = (".txt", ".md", ".html"), metadata: dict | None = None) -> DataFrame:
    """Text files below a folder as documents, in order of path; blank files are left out."""
    pattern = "(?i)(" + "|".join(re.escape(e) for e in extensions) + ")$"
    files = spark.read.option("recursiveFileLookup", True).format("binaryFile").load(folder).where(F.rlike("path", F.lit(pattern)))
    name = F.element_at(F.split("path", "/"), -1)
    more = F.create_map(*[F.lit(str(x)) for kv in (metadata or {}).items() for x in kv]).cast("map<string,string>")
    base = F.create_map(F.lit("source"), F.col("path"), F.lit("filename"), name)
    kept = F.map_filter(base, lambda k, v: ~F.array_contains(F.array(*[F.lit(k) for k in metadata]), k)) if metadata else base
    rows = files.select(F.col("path").alias("doc_key"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.map_concat(kept, more).alias("metadata"))
    return rows.where(T.not_blank(F.col("text"))).orderBy("doc_key")


def from_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Rows in memory: 'text' is the text, everything else metadata; blank texts are left out."""
    data = [
        (str(i), r.get("text", ""), {k: str(v) for k, v in r.items() if k != "text"}) for i, r in enumerate(rows)
    ]
    frame = spark.createDataFrame(data, "doc_key string, text string, metadata map<string, string>")
    return frame.where(T.not_blank(F.col("text")))


def to_documents(parsed: DataFrame) -> DataFrame:
    """Parsed documents with their tables in the text; blank and failed ones are left out."""
    text = T.full_text(F.col("text"), F.col("tables"))
    return parsed.where("error is null").select(F.col("filename").alias("doc_key"), text.alias("text"), "metadata").where(T.not_blank(F.col("text")))


def summary(parsed: DataFrame, requirements: DataFrame | None = None) -> DataFrame:
    """Each file's name, characters, tables and error; with ``requirements`` (document_name, ...) also how many were found in it."""
    told = parsed.select("filename", F.length("text").alias("text_chars"), F.size("tables").alias("table_count"), "error")
    if requirements is None:
        return told
    found = requirements.groupBy(F.col("document_name").alias("filename")).agg(F.count(F.lit(1)).alias("requirements_found"))
    return told.join(found, "filename", "left").fillna(0, ["requirements_found"])
