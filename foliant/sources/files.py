"""Reading files: listing, validation, text, word-processor documents, manifests, and readers by extension.

Everything starts from Spark's own readers, so any store they reach will do.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import lexicons as lx
from foliant.operators.models import get_config, load

#: Which reader takes which extensions, and the MIME types that stand in for them. Fixed values.
READERS = {
    "pdf": (".pdf",),
    "word": (".docx", ".doc"),
    "image": (".png", ".jpg", ".jpeg", ".bmp", ".tiff", ".tif", ".gif"),
    "text": (".txt",),
}
MIME_TYPES = {
    ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".doc": "application/msword",
    ".png": "image/png",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".bmp": "image/bmp",
    ".tiff": "image/tiff",
    ".tif": "image/tiff",
    ".gif": "image/gif",
    ".txt": "text/plain",
}
DOCX_MEMBERS = ("[Content_Types].xml", "word/document.xml")


def extension(name: Column) -> Column:
    """The lower-case extension with its dot, or nothing."""
    return F.lower(F.regexp_extract(name, r"(?:.)(\.[^./\\]+)$", 1))


def allowed_upload(name: Column) -> Column:
    """Whether a name has a dot and, after the last one, an extension that may be uploaded."""
    return F.contains(name, F.lit(".")) & F.lower(F.element_at(F.split(name, r"\.", -1), -1)).isin(lx.UPLOAD_EXTENSIONS)


def reader_of(name: Column, mime: Column | None = None) -> Column:
    """The kind of reader for a file: by extension first, else by MIME type, else unknown."""
    ext = extension(name)
    found = F.when(F.lit(False), "")
    for kind, extensions in READERS.items():
        found = found.when(ext.isin(*extensions), kind)
    if mime is not None:
        for kind, extensions in READERS.items():
            found = found.when(mime.isin(*{MIME_TYPES[e] for e in extensions}), kind)
    return found.otherwise("unknown")


def mime_type(name: Column) -> Column:
    ext = extension(name)
    found = F.when(F.lit(False), "")
    for e, mime in MIME_TYPES.items():
        found = found.when(ext == e, mime)
    return found


def find_files(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True, extensions=None) -> DataFrame:
    """Files under a folder with path, name, size, time and content; the content is only read where it is used.

    Spark's file readers pass over files without any bytes, so those never show.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    files = reader.option("recursiveFileLookup", str(recursive).lower()).load(folder)
    files = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("extension", extension(F.col("name")))
    return files if extensions is None else files.where(F.col("extension").isin(*extensions))


def read_texts(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """Whole text files as (text, source, filename)."""
    texts = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True)
    return texts.select(
        F.col("value").alias("text"), F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_name").alias("filename")
    )


def validate(files: DataFrame, max_bytes: int = lx.MAX_FILE_BYTES, extensions=tuple(lx.FILE_EXTENSIONS)) -> DataFrame:
    """``files`` with ``errors``, ``warnings`` and ``is_valid``; the first error ends the checks."""
    name, size = F.col("name"), F.col("length")
    head = F.substring(F.col("content"), 1, 5)
    error = (
        F.when(size == 0, "File is empty")
        .when(size > max_bytes, F.format_string("File too large: %d bytes", size))
        .when(~extension(name).isin(*extensions), F.concat(F.lit("Unsupported file extension: "), extension(name)))
        .when((extension(name) == ".pdf") & (head != F.lit(b"%PDF-")), "Invalid PDF file")
        .when((extension(name) == ".docx") & (F.substring(F.col("content"), 1, 2) != F.lit(b"PK")), "Invalid DOCX file")
    )
    mime = mime_type(name)
    odd = F.when(mime.isNull(), F.concat(F.lit("Unknown MIME type for "), name))
    return files.withColumns(
        {
            "errors": F.array_compact(F.array(error)),
            "warnings": F.array_compact(F.array(odd)),
            "mime_type": mime,
            "reader": reader_of(name),
        }
    ).withColumn("is_valid", F.size("errors") == 0)


def file_info(files: DataFrame) -> DataFrame:
    """Name, stem, suffix, sizes, times and hashes of files."""
    from foliant.operators.documents import human_size

    name = F.col("name")
    return files.select(
        "path",
        "name",
        F.regexp_replace(name, r"(?<=.)\.[^.]+$", "").alias("stem"),
        extension(name).alias("suffix"),
        F.col("length").alias("size"),
        human_size(F.col("length")).alias("size_human"),
        F.col("modificationTime").alias("modified"),
        mime_type(name).alias("mime_type"),
        F.md5("content").alias("hash_md5"),
        F.sha2("content", 256).alias("hash_sha256"),
    )


# --- word-processor documents -------------------------------------------------------------------------------

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Elements of the core properties, by field. Fixed values.
CORE = {
    "title": "{http://purl.org/dc/elements/1.1/}title",
    "author": "{http://purl.org/dc/elements/1.1/}creator",
    "subject": "{http://purl.org/dc/elements/1.1/}subject",
    "keywords": "{http://schemas.openxmlformats.org/package/2006/metadata/core-properties}keywords",
    "language": "{http://purl.org/dc/elements/1.1/}language",
    "created": "{http://purl.org/dc/terms/}created",
    "modified": "{http://purl.org/dc/terms/}modified",
}
DOCX = (
    "path string, elements array<struct<style: string, text: string, heading_level: int, rows: array<array<string>>>>, "
    "properties map<string,string>, error string"
)


def parse_docx(content: bytes) -> dict:
    """The paragraphs and tables of a document in their order, and its core properties."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
        core = ElementTree.fromstring(archive.read("docProps/core.xml")) if "docProps/core.xml" in archive.namelist() else None

    def said(node) -> str:
        return "".join(t.text or "" for t in node.iter(f"{_W}t"))

    elements = []
    for node in body if body is not None else ():
        if node.tag == f"{_W}p" and (text := said(node)).strip():
            mark = node.find(f"{_W}pPr/{_W}pStyle")
            style = mark.get(f"{_W}val") if mark is not None else "Normal"
            level = re.match(r"(?i)heading\s*(\d)", style or "")
            elements.append({"style": style, "text": text, "heading_level": int(level[1]) if level else 0, "rows": None})
        elif node.tag == f"{_W}tbl":
            rows = [
                [" ".join(s for p in cell.iter(f"{_W}p") if (s := said(p).strip())) for cell in row.iter(f"{_W}tc")]
                for row in node.iter(f"{_W}tr")
            ]
            elements.append({"style": "Table", "text": None, "heading_level": 0, "rows": rows})
    found = {} if core is None else {name: node.text for name, tag in CORE.items() if (node := core.find(tag)) is not None and node.text}
    return {"elements": elements, "properties": found}


def read_docx(files: DataFrame) -> DataFrame:
    """(path, text, status, properties, counts) of word-processor documents; a file that can't be read has its error."""
    from foliant.functions.classify import paragraph_type
    from foliant.functions.language import section_language
    from foliant.operators.documents import table_text, word_status, word_text

    row = pa.struct([("style", pa.string()), ("text", pa.string()), ("heading_level", pa.int32()), ("rows", pa.list_(pa.list_(pa.string())))])
    schema = pa.schema(
        [("path", pa.string()), ("elements", pa.list_(row)), ("properties", pa.map_(pa.string(), pa.string())), ("error", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    found = parse_docx(content)
                    out.append({"path": path, "elements": found["elements"], "properties": list(found["properties"].items()), "error": None})
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    out.append({"path": path, "elements": [], "properties": [], "error": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_pylist(out, schema)

    parsed = files.select("path", "content").mapInArrow(run, DOCX)
    typed = F.transform(
        "elements",
        lambda e: F.struct(
            F.when(e["rows"].isNotNull(), "table").otherwise(paragraph_type(e["text"], e["style"], e["heading_level"])).alias("type"),
            F.coalesce(e["text"], table_text(e["rows"])).alias("text"),
            F.greatest(e["heading_level"], F.lit(1)).alias("heading_level"),
        ),
    )
    parsed = parsed.withColumn("typed", typed).withColumn("text", word_text(F.col("typed")))
    n = lambda kind: F.size(F.filter("typed", lambda e: e["type"] == kind))
    return parsed.select(
        "path",
        "text",
        word_status(F.col("text")).alias("status"),
        "properties",
        section_language(F.col("text")).alias("language"),
        F.lit(0.9).alias("confidence"),
        n("heading").alias("headings"),
        n("list_item").alias("lists"),
        n("body").alias("body_paragraphs"),
        n("table").alias("tables"),
        "error",
    )


def read_with(files: DataFrame, model: str, default) -> DataFrame:
    """(path, text, metadata, error) through a registered reader, such as one for PDF or for images."""
    config = get_config(model, default)
    schema = pa.schema([("path", pa.string()), ("text", pa.string()), ("metadata", pa.map_(pa.string(), pa.string())), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    found = load(model, config).read(path, content)
                    out.append({"path": path, "text": found.get("text"), "metadata": list(found.get("metadata", {}).items()), "error": None})
                except Exception as e:  # one file's failure is that file's result
                    out.append({"path": path, "text": None, "metadata": [], "error": str(e)})
            yield pa.RecordBatch.from_pylist(out, schema)

    return files.select("path", "content").mapInArrow(run, "path string, text string, metadata map<string,string>, error string")


class NoReader:
    """Stands in where no reader is registered: every file is an error."""

    def read(self, path: str, content: bytes) -> dict:
        raise NotImplementedError(f"no reader is registered for {path}")


def text_blocks(blocks: Column) -> Column:
    """Blocks of a page from their spans (text, size, font): text, mean size, the first of the most frequent fonts."""
    from foliant.functions.classify import block_type

    def made(spans: Column) -> Column:
        text = F.array_join(F.transform(spans, lambda s: s["text"]), "")
        size = F.aggregate(spans, F.lit(0.0), lambda a, s: a + s["size"]) / F.size(spans)
        size = F.when(F.size(spans) > 0, size).otherwise(12.0)
        fonts = F.transform(spans, lambda s: s["font"])
        counted = F.transform(
            F.array_sort(F.array_distinct(fonts)),
            lambda f: F.struct((-F.size(F.filter(fonts, lambda g: g == f))).alias("n"), f.alias("font")),
        )
        font = F.array_min(counted)["font"]
        return F.struct(text.alias("text"), size.alias("font_size"), font.alias("font"), block_type(text, size).alias("type"))

    return F.transform(blocks, made)


def mean_confidence(found: Column) -> Column:
    """The mean of the positive confidences of an image's words, 0 without any."""
    good = F.filter(found, lambda c: c > 0)
    total = F.aggregate(good, F.lit(0.0), lambda a, c: a + c)
    return F.coalesce(F.try_divide(total, F.size(good)), F.lit(0.0))


MANIFEST_ENTRY = (
    "index int, path string, processed boolean, processing_time double, output_files array<string>, "
    "validation struct<is_valid: boolean, errors: array<string>>"
)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a manifest written by ``foliant.sources.sinks``."""
    return spark.read.schema(MANIFEST_ENTRY).json(path)
