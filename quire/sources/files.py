"""File sources and sinks, through Spark's readers and writers.

Text formats come as (path, text) rows, zip formats through binary rows and the standard library on
executors. PDF has no reader here: its blocks come as a table (see :mod:`quire.operators.layout`).
"""

from __future__ import annotations

import io
import posixpath
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: fixed values: formats by suffix, in order of detection
SUFFIXES = {"md": "markdown", "markdown": "markdown", "txt": "plain_text", "text": "plain_text", "html": "html", "htm": "html", "tex": "latex", "latex": "latex", "srt": "srt", "vtt": "vtt", "ipynb": "ipynb", "epub": "epub", "docx": "docx", "pdf": "pdf"}
ENCODINGS = ("utf-8", "gbk", "gb2312", "latin-1")


def format_of(path: Column) -> Column:
    """A path's format by its suffix; an unknown one is an error."""
    suffix = F.regexp_extract(F.lower(path), r"\.([^./]+)$", 1)
    found = F.coalesce(*(F.when(suffix == k, F.lit(v)) for k, v in SUFFIXES.items()))
    return F.when(found.isNull(), F.raise_error(F.concat(F.lit("unsupported format: "), path)).cast("string")).otherwise(found)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole UTF-8 files, without a byte order mark."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^﻿", "").alias("text"))
    return rows


def decoded(raw: bytes) -> str:
    """Bytes by the first encoding that takes them; latin-1 takes all."""
    for encoding in ENCODINGS:
        try:
            return raw.decode(encoding)
        except UnicodeDecodeError:
            continue
    raise AssertionError("latin-1 decodes any bytes")


def parsed_bytes(rows: DataFrame, parser: Callable[[bytes], list[tuple]], schema: str, key: str = "path", content: str = "content") -> DataFrame:
    """(key, *schema): a row for each that the parser makes of a binary cell; a null cell makes none."""
    fields = [x.split(" ", 1) for x in schema.split(", ")]
    names = [key, *(n for n, _ in fields)]
    kinds = [_ARROW[t] for _, t in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(*batch.columns, strict=True):
                found = parser(raw.as_py()) if raw.is_valid else []
                columns = zip(*found, strict=True) if found else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(found), batch.column(0).type), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=names)

    some = rows.select(key, content)
    return some.mapInArrow(run, f"`{key}` {some.schema[key].dataType.simpleString()}, {schema}")


_ARROW = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def page_text(raw: bytes) -> list[tuple[str]]:
    return [(decoded(raw),)]


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of HTML files of any of the encodings."""
    return parsed_bytes(_files(spark, path), page_text, "text string")


def read_notebooks(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of notebooks; see :func:`quire.operators.blocks.notebook`."""
    return read_texts(spark, path)


EPUB_SCHEMA = "place long, name string, markup string, is_nav boolean"
DOCX_SCHEMA = "part string, index long, text string, style string, cells array<string>"


def epub_files(raw: bytes) -> list[tuple[int, str, str, bool]]:
    """(place, name, markup, is_nav) of a book's text files: the spine in order, then navigation."""
    with zipfile.ZipFile(io.BytesIO(raw)) as book:
        names = set(book.namelist())
        container = ElementTree.fromstring(book.read("META-INF/container.xml"))
        root_file = next(e.get("full-path") for e in container.iter() if e.tag.endswith("rootfile"))
        package = ElementTree.fromstring(book.read(root_file))
        items = {e.get("id"): e for e in package.iter() if e.tag.endswith("}item")}
        spine = [e.get("idref") for e in package.iter() if e.tag.endswith("}itemref")]
        is_nav = lambda e: "nav" in (e.get("properties") or "").split() or e.get("id") == "nav" or re.search(r"(^|/)nav\.x?html$", e.get("href") or "")
        order = [*spine, *(k for k, e in items.items() if is_nav(e) and k not in spine)]
        out = []
        for key in order:
            item = items.get(key)
            if item is None or "html" not in (item.get("media-type") or ""):
                continue
            name = posixpath.normpath(posixpath.join(posixpath.dirname(root_file), unquote(item.get("href"))))
            if name in names:
                out.append((len(out), name, decoded(book.read(name)), bool(is_nav(item))))
        return out


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """(path, place, name, markup, is_nav)."""
    return parsed_bytes(_files(spark, path), epub_files, EPUB_SCHEMA)


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_parts(raw: bytes) -> list[tuple[str, int, str | None, str | None, list[str] | None]]:
    """(part, index, text, style, cells): paragraphs of the body, then tables with their cells row by row."""
    with zipfile.ZipFile(io.BytesIO(raw)) as file:
        body = ElementTree.fromstring(file.read("word/document.xml")).find(f"{_W}body")
        styles = {}
        if "word/styles.xml" in file.namelist():
            for e in ElementTree.fromstring(file.read("word/styles.xml")).iter(f"{_W}style"):
                name = e.find(f"{_W}name")
                styles[e.get(f"{_W}styleId")] = name.get(f"{_W}val") if name is not None else None
    text = lambda e: "".join("\t" if x.tag == f"{_W}tab" else "\n" if x.tag == f"{_W}br" else x.text or "" for x in e.iter() if x.tag in (f"{_W}t", f"{_W}tab", f"{_W}br"))
    out = []
    for index, p in enumerate(body.findall(f"{_W}p")):
        mark = p.find(f"{_W}pPr/{_W}pStyle")
        key = mark.get(f"{_W}val") if mark is not None else None
        style = (styles.get(key) or key or "Normal").replace("heading ", "Heading ")
        out.append(("paragraph", index, text(p), style, None))
    for index, t in enumerate(body.findall(f"{_W}tbl")):
        cells = ["\n".join(text(p) for p in c.findall(f"{_W}p")) for c in t.iter(f"{_W}tc")]
        out.append(("table", index, None, None, cells))
    return out


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """(path, part, index, text, style, cells)."""
    return parsed_bytes(_files(spark, path), docx_parts, DOCX_SCHEMA)


_TERM = "source_term string, target_term string, case_sensitive string, match_type string, priority string, locked string, note string"


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """Terms of a CSV, or of a JSON list or its ``terms``, with defaults."""
    if path.lower().endswith(".csv"):
        raw = spark.read.csv(path, header=True, enforceSchema=False)
        rows = raw.select(*(F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in (x.split()[0] for x in _TERM.split(", "))))
    else:
        text = spark.read.text(path, wholetext=True)
        as_list = F.from_json("value", f"array<struct<{_TERM.replace(' string', ':string')}>>")
        inner = F.from_json("value", f"struct<terms:array<struct<{_TERM.replace(' string', ':string')}>>>")["terms"]
        rows = text.select(F.explode(F.when(F.trim("value").startswith("["), as_list).otherwise(inner)).alias("t")).select("t.*")
    return glossary_terms(rows)


def glossary_terms(rows: DataFrame) -> DataFrame:
    """Typed terms of text columns: case counts unless "false", locked only if "true", priority 100."""
    lower = lambda c, d: F.lower(F.trim(F.coalesce(c, F.lit(d))))
    out = rows.select("source_term", "target_term", (lower("case_sensitive", "true") != "false").alias("case_sensitive"), F.coalesce("match_type", F.lit("exact")).alias("match_type"), F.coalesce(F.expr("try_cast(priority as int)"), F.lit(100)).alias("priority"), (lower("locked", "false") == "true").alias("locked"), "note")
    return out.filter("source_term is not null and target_term is not null")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(name, length, modified) of a folder's files, by name; contents aren't read."""
    rows = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length", F.col("modificationTime").alias("modified"))
    return rows.orderBy("name")


def env_settings(text: str) -> dict[str, str]:
    """key=value lines; comments, blank lines and quotes around values go."""
    out = {}
    for row in text.splitlines():
        key, mark, value = row.strip().partition("=")
        if mark and key.strip() and not key.lstrip().startswith("#"):
            value = value.strip()
            quoted = len(value) >= 2 and value[0] == value[-1] and value[0] in "\"'"
            out[key.strip()] = value[1:-1] if quoted else value
    return out


def write_texts(rows: DataFrame, path: str, name: str, text: str) -> None:
    """A folder for each document, with one text file, closed by a line end: (name, text) rows by Spark's text writer."""
    rows.select(F.col(name).alias("name"), F.col(text).alias("value")).write.mode("overwrite").partitionBy("name").text(path)


def zipped(parts: list[tuple[str, bytes]]) -> bytes:
    """K9: an archive with ``mimetype`` first and stored."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as file:
        for name, raw in sorted(parts, key=lambda p: p[0] != "mimetype"):
            file.writestr(zipfile.ZipInfo(name), raw, zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED)
    return out.getvalue()


def scratch(spark: SparkSession) -> str:
    """A fresh path in the folder that the cluster shares; a temporary one where none is set and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.gettempdir()
    return f"{base.rstrip('/')}/quire-{uuid.uuid4().hex}"


def snapshot(df: DataFrame, path: str) -> None:
    """A table as it is."""
    df.write.mode("overwrite").parquet(path)
