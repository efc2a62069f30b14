"""Scans of files and text rows, and the format registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.functions import fixed_values as fv
from quirefold.functions import text as tx
from quirefold.operators import admission
from quirefold.sources.delimited import parse_delimited
from quirefold.sources.html import parse_html
from quirefold.sources.jsondocs import parse_json
from quirefold.sources.parsed import failed
from quirefold.sources.plain import parse_text

# parser of the decoded text column -> file types; add a format by adding an entry
PARSERS = {parse_text: ["txt", "md"], parse_delimited: ["csv"], parse_html: ["html", "htm"], parse_json: ["json"]}
BOM_STRIPPED = ["csv", "json", "html", "htm"]


def decode(content: Column, file_type: Column) -> Column:
    """UTF-8 with bad bytes replaced; a byte order mark is dropped for the data formats."""
    text = F.make_valid_utf8(content.cast("string"))
    return F.when(file_type.isin(*BOM_STRIPPED), F.regexp_replace(text, "^\ufeff", "")).otherwise(text)


def _named(files: DataFrame) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumn("filename", name).filter(~F.col("filename").startswith(".")).select(
        "filename", admission.title_of(F.col("filename")).alias("title"), admission.file_type_of(F.col("filename")).alias("file_type"),
        F.col("length").alias("size"), *[c for c in files.columns if c == "content"],
    )


def scan_files(spark: SparkSession, path: str, max_bytes: int | None = None, types=None) -> DataFrame:
    """(filename, title, file_type, size, content_hash, content) of every visible file.

    With ``max_bytes`` and ``types`` the scan itself leaves larger files and other extensions out, so their contents are never read.
    """
    reader = spark.read.format("binaryFile")
    if types is not None:
        any_case = lambda t: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in t)
        reader = reader.option("pathGlobFilter", "*.{" + ",".join(map(any_case, types)) + "}")
    files = reader.load(path)
    if max_bytes is not None:
        files = files.filter(F.col("length") <= max_bytes)
    return _named(files).withColumn("content_hash", admission.content_hash(F.col("content"))).select(
        "filename", "title", "file_type", "size", "content_hash", "content")


def scan_names(spark: SparkSession, path: str) -> DataFrame:
    """(filename, title, file_type, size) of every visible file; no content is read."""
    return _named(spark.read.format("binaryFile").load(path).select("path", "length"))


def admit_folder(spark: SparkSession, path: str, max_mb: int = fv.MAX_UPLOAD_MB, supported=None) -> tuple[DataFrame, DataFrame]:
    """Admitted files with their contents, and refused ones with their reason, found without reading them."""
    supported = fv.SUPPORTED_TYPES if supported is None else supported
    _, refused = admission.admit(scan_names(spark, path), max_mb, supported)
    return scan_files(spark, path, max_mb * 1024 * 1024, supported), refused


def text_rows(rows: DataFrame) -> DataFrame:
    """Pasted (title, text) rows in the shape of a file scan; they count as .txt files."""
    content = F.encode("text", "UTF-8")
    return rows.select(
        *[c for c in rows.columns if c not in ("title", "text")],
        F.concat("title", F.lit(".txt")).alias("filename"), "title", F.lit("txt").alias("file_type"),
        F.length(content).cast("long").alias("size"), admission.content_hash(content).alias("content_hash"), content.alias("content"),
    )


def parse(docs: DataFrame, parsers=None) -> DataFrame:
    """Scanned documents with ``blocks``, ``tables``, ``warnings`` and ``error`` in place of ``content``.

    Every row takes the branch of its type. Types whose parser runs Python form a branch of their own, so no
    other document passes through it.
    """
    parsers = PARSERS if parsers is None else parsers
    kept = [c for c in docs.columns if c != "content"]
    python = [t for parser, types in parsers.items() if getattr(parser, "python", False) for t in types]
    out = None
    for walked in (False, True):
        if walked and not python:
            break
        rows = docs.filter(F.col("file_type").isin(*python)) if walked else docs.filter(~F.coalesce(F.col("file_type").isin(*python), F.lit(False))) if python else docs
        kind = F.col("file_type")
        staged = rows.withColumn("_text", decode(F.col("content"), kind)).drop("content")
        parsed = F.when(F.lit(False), failed(""))
        for parser, types in parsers.items():
            if getattr(parser, "python", False) == walked:
                parsed = parsed.when(kind.isin(*types), parser(F.col("_text")))
        parsed = parsed.otherwise(failed(F.concat(F.lit(fv.UNSUPPORTED), kind)))
        part = staged.withColumn("_p", parsed).select(*kept, "_p.blocks", "_p.tables", "_p.warnings", "_p.error")
        out = part if out is None else out.unionByName(part)
    return out


def blocks_of(parsed: DataFrame) -> DataFrame:
    """(document_id, block_no, text, kind, location, heading)."""
    return tx.numbered(parsed, ["document_id"], F.col("blocks"), "block_no", "b").select("document_id", "block_no", "b.*")

