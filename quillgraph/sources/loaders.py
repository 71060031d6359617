"""Sources as segments: ``source, doc_type, seq, content, metadata``."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = "source string, doc_type string, seq long, content string, metadata map<string,string>"
SUFFIXES = ("txt", "md", "csv", "json", "jsonl", "html", "htm", "docx", "pdf")
MAX_DEPTH = 10
MIN_HTML_CHARS = 50


def render_row(number: Column, headers: list[str], value: Callable[[str], Column]) -> Column:
    """``Row N:, a=1, b=``; a blank value is empty."""
    cells = [F.concat(F.lit(f"{h}="), F.coalesce(F.when(F.trim(value(h)) != "", value(h)), F.lit(""))) for h in headers]
    return F.concat_ws(", ", F.concat(F.lit("Row "), number.cast("string"), F.lit(":")), *cells)


def load_text(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    df = spark.read.option("recursiveFileLookup", str(recursive).lower()).text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_name").alias("name"))
    return df.select("source", F.lit("txt").alias("doc_type"), F.lit(0).cast("long").alias("seq"), F.col("value").alias("content"), F.create_map(F.lit("filename"), "name", F.lit("char_count"), F.length("value").cast("string")).alias("metadata"))


def _frames(rows_of: Callable[[bytes, str], list[tuple[str, dict]]], doc_type: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                for i, (content, meta) in enumerate(rows_of(bytes(data), path)):
                    out.append((path, doc_type, i, content, {k: str(v) for k, v in meta.items()}))
            yield pd.DataFrame(out, columns=["source", "doc_type", "seq", "content", "metadata"])

    return run


def _binary(spark: SparkSession, path: str, rows_of, doc_type: str, recursive: bool = False) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "content")
    return files.mapInPandas(_frames(rows_of, doc_type), SCHEMA)


def csv_rows(data: bytes, path: str) -> list[tuple[str, dict]]:
    """The header goes in front of the first row; a file without one gives nothing."""
    import csv

    reader = csv.reader(io.StringIO(data.decode("utf-8", "replace"), newline=""))
    headers = next(reader, None)
    if not headers:
        return []
    out = []
    for n, row in enumerate(reader, 1):
        cells = [f"{h}={v if v.strip() else ''}" for h, v in zip(headers, row + [""] * (len(headers) - len(row)))]
        line = ", ".join([f"Row {n}:", *cells])
        out.append((f"Columns: {', '.join(headers)}\n\n{line}" if n == 1 else line, {"row": n, "headers": json.dumps(headers)}))
    return out


def flatten(value, prefix: str = "", depth: int = 0) -> str:
    """``a.b[0]=v`` pairs joined by ``; ``; what lies deeper than MAX_DEPTH is written as it is."""
    if depth > MAX_DEPTH:
        return str(value)
    if isinstance(value, dict):
        return "; ".join(flatten(v, f"{prefix}.{k}" if prefix else str(k), depth + 1) for k, v in value.items())
    if isinstance(value, list):
        return "; ".join(flatten(v, f"{prefix}[{i}]", depth + 1) for i, v in enumerate(value))
    return f"{prefix}={value}"


def json_rows(data: bytes, path: str) -> list[tuple[str, dict]]:
    try:
        parsed = json.loads(data.decode("utf-8", "replace"))
    except json.JSONDecodeError:
        return []
    if isinstance(parsed, list):
        return [(flatten(x), {"index": i}) for i, x in enumerate(parsed, 1)]
    return [(flatten(parsed), {})]


def jsonl_rows(data: bytes, path: str) -> list[tuple[str, dict]]:
    out = []
    for n, line in enumerate(data.decode("utf-8", "replace").strip().split("\n"), 1):
        if line.strip():
            try:
                out.append((flatten(json.loads(line)), {"line": n}))
            except json.JSONDecodeError:
                continue
    return out


def flatten_map(column: Column) -> Column:
    """JSON objects of one level, flattened without leaving the JVM."""
    entries = F.map_entries(F.from_json(column, "map<string,string>"))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("None")))), "; ")


class _Tree(HTMLParser):
    """Text of the first of article, main, role=main and body, without what is not prose."""

    SKIP = set("aside footer header nav script style".split())
    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, str | None]] = []
        self.found: dict[str, list[str]] = {}
        self.taken: set[str] = set()

    def handle_starttag(self, tag, attrs):
        if tag in self.VOID:
            return
        root = tag if tag in ("article", "main", "body") else "role" if tag == "div" and ("role", "main") in attrs else None
        if root in self.taken:
            root = None
        elif root:
            self.taken.add(root)
            self.found[root] = []
        self.stack.append((tag, root))

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.stack):
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if data.strip() and not any(t in self.SKIP for t, _ in self.stack):
            for root in [r for _, r in self.stack if r] or ["none"]:
                self.found.setdefault(root, []).append(data.strip())

    def text(self) -> str:
        for root in ("article", "main", "role", "body", "none"):
            if root in self.found:
                return "\n".join(self.found[root]).strip()
        return ""


def html_text(html: str | None) -> str | None:
    """The prose of a page; None if there is less than MIN_HTML_CHARS of it."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    text = tree.text()
    return text if len(text) >= MIN_HTML_CHARS else None


#: By rows of Python's own, a hundred at a time: an Arrow batch of pages holds ten thousand of them, as often as they are copied.
html_text_udf = F.udf(html_text, T.StringType(), useArrow=False)


def html_rows(data: bytes, path: str) -> list[tuple[str, dict]]:
    text = html_text(data.decode("utf-8", "replace"))
    return [] if text is None else [(text, {"url": path, "char_count": len(text)})]


def docx_rows(data: bytes, path: str) -> list[tuple[str, dict]]:
    """Paragraphs, then tables as ``a | b``; headings go to the metadata."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    try:
        body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{w}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return []
    text_of = lambda e: "".join(t.text or "" for t in e.iter(f"{w}t"))
    paragraphs, headings, tables = [], [], []
    for e in body if body is not None else []:
        if e.tag == f"{w}p" and text_of(e).strip():
            style = e.find(f"{w}pPr/{w}pStyle")
            (headings if style is not None and style.get(f"{w}val", "").lower().startswith("heading") else paragraphs).append(text_of(e).strip())
        elif e.tag == f"{w}tbl":
            tables += [" | ".join(text_of(c).strip() for c in row.iter(f"{w}tc")) for row in e.iter(f"{w}tr")]
    content = "\n\n".join([*paragraphs, *(["\n".join(tables)] if tables else [])])
    return [(content, {"headings": json.dumps(headings)})] if content else []


def pdf_rows(data: bytes, path: str) -> list[tuple[str, dict]]:
    """Text by page, with whichever PDF library is installed; nothing without one."""
    try:
        import pdfplumber
    except ImportError:
        try:
            import fitz
        except ImportError:
            return []
        return [(t, {"page": i}) for i, p in enumerate(fitz.open(stream=data, filetype="pdf"), 1) if (t := p.get_text().strip())]
    out = []
    with pdfplumber.open(io.BytesIO(data)) as pdf:
        for i, page in enumerate(pdf.pages, 1):
            tables = [" | ".join(c or "" for c in row) for t in page.extract_tables() or [] for row in t]
            text = "\n".join(filter(None, [(page.extract_text() or "").strip(), *tables]))
            if text:
                out.append((text, {"page": i}))
    return out


READERS = {"csv": ("csv", csv_rows), "json": ("json", json_rows), "jsonl": ("json", jsonl_rows), "html": ("html", html_rows), "htm": ("html", html_rows), "docx": ("docx", docx_rows), "pdf": ("pdf", pdf_rows)}


def from_dict(spark: SparkSession, value: dict) -> DataFrame:
    return spark.createDataFrame([("dict", "json", 0, flatten(value), {})], SCHEMA)


def from_strings(spark: SparkSession, texts: list[str]) -> DataFrame:
    return spark.createDataFrame([("text", "txt", i, t, {"char_count": str(len(t))}) for i, t in enumerate(texts)], SCHEMA)


def load(spark: SparkSession, source, fetch: Callable[[str], bytes] | None = None) -> DataFrame:
    """Segments of a path, a URL (with ``fetch``), a dict, a folder, or a list of these."""
    if isinstance(source, (list, tuple)):
        out = spark.createDataFrame([], SCHEMA)
        for x in source:
            out = out.unionByName(load(spark, x, fetch))
        return out
    if isinstance(source, dict):
        return from_dict(spark, source)
    path = str(source)
    if re.match(r"https?://", path):
        if fetch is None:
            raise ValueError("a URL needs a fetch function")
        return spark.createDataFrame([(path, "html", i, t, {k: str(v) for k, v in m.items()}) for i, (t, m) in enumerate(html_rows(fetch(path), path))], SCHEMA)
    suffix = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if suffix in ("txt", "md"):
        return load_text(spark, path)
    if suffix in READERS:
        doc_type, rows_of = READERS[suffix]
        return _binary(spark, path, rows_of, doc_type)
    if suffix:
        raise ValueError(f"no reader for .{suffix}")
    return load_folder(spark, path)


def load_folder(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """All files of the known kinds in a folder, one listing for each kind."""
    out = load_text_glob(spark, path, recursive)
    for suffix, (doc_type, rows_of) in READERS.items():
        files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", f"*.{suffix}").load(path).select("path", "content")
        out = out.unionByName(files.mapInPandas(_frames(rows_of, doc_type), SCHEMA))
    return out


def load_text_glob(spark: SparkSession, path: str, recursive: bool) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.{txt,md}").load(path).select("path", "content")
    return files.mapInPandas(_frames(lambda data, p: [(data.decode("utf-8", "replace"), {"filename": p.rsplit("/", 1)[-1], "char_count": len(data.decode("utf-8", "replace"))})], "txt"), SCHEMA)
