"""From scanned documents to the library tables, as projections of one parsed row per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions import fixed_values as fv
from quirefold.functions import text as tx
from quirefold.functions.ids import child_id
from quirefold.operators import chunk, extract
from quirefold.session import materialize
from quirefold.sources import files


def prose_of(blocks: Column) -> Column:
    """Texts of the non-table blocks in order, one per line: the input of the field rules."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["kind"] != "table"), lambda b: b["text"]), "\n")


def typed_columns(table: Column) -> Column:
    """(name, type) of every column of a parsed table."""
    return F.transform(table["columns"], lambda name, i: F.struct(
        name.alias("name"),
        extract.array_type(F.transform(table["rows"], lambda r: F.coalesce(F.get(r, i), F.lit("")))).alias("type"),
    ))


def library_tables(parsed: DataFrame) -> dict[str, DataFrame]:
    """chunks, fields, tables and table_rows of parsed documents; no step shuffles."""
    fields = extract.extract_fields(parsed.select("document_id", prose_of(F.col("blocks")).alias("text")))
    exploded = parsed.select("document_id", F.posexplode("tables").alias("n", "t"))
    table_id = child_id(F.col("document_id"), F.col("n"))
    tables = exploded.select(
        table_id.alias("table_id"), "document_id", F.col("t.name").alias("name"), typed_columns(F.col("t")).alias("columns"),
        F.col("t.location").alias("location"), F.size("t.rows").alias("row_count"),
    )
    rows = exploded.select(table_id.alias("table_id"), "document_id", F.posexplode("t.rows").alias("row_index", "cells"))
    return {"chunks": chunk.chunk_documents(parsed), "fields": fields, "tables": tables, "table_rows": rows}


def ingest(docs: DataFrame, uploaded_at: Column | None = None) -> dict[str, DataFrame]:
    """Library tables of admitted, de-duplicated documents (document_id, filename, title, …, content).

    The parsed documents are written once to the shared scratch folder and the library
    tables are projections of them. A document without text fails with its reason and contributes nothing else; the other
    documents are not affected.
    """
    texts = F.exists("blocks", lambda b: F.when(
        b["kind"] == "table", F.size(tx.text_lines(b["text"])) > 1).otherwise(tx.strip(b["text"]) != ""))
    parsed = files.parse(docs)
    parsed = parsed.withColumn("error", F.coalesce("error", F.when(~F.coalesce(texts, F.lit(False)), F.lit(fv.NO_TEXT))))
    parsed = materialize(parsed, "parsed")  # five outputs read it; every file is parsed once
    ready = F.col("error").isNull()
    out = library_tables(parsed.filter(ready))
    out["documents"] = parsed.select(
        "document_id", "filename", "title", "file_type", "size", F.when(ready, "ready").otherwise("failed").alias("status"),
        "error", "warnings", "content_hash", (F.current_timestamp() if uploaded_at is None else uploaded_at).alias("uploaded_at"),
    )
    return out
