"""Types shared by the sources, the ingest job and the library tables."""

BLOCKS = "array<struct<text:string,kind:string,location:string,heading:string>>"
TABLES = "array<struct<name:string,columns:array<string>,rows:array<array<string>>,location:string>>"
PARSED = f"struct<blocks:{BLOCKS},tables:{TABLES},warnings:array<string>,error:string>"

DOCUMENTS = (
    "document_id long, filename string, title string, file_type string, size long, status string, "
    "error string, warnings array<string>, content_hash string, uploaded_at timestamp"
)
CHUNKS = "chunk_id long, document_id long, seq int, text string, embed_text string, location string"
LIBRARY_TABLES = (
    "table_id long, document_id long, name string, columns array<struct<name:string,type:string>>, location string, row_count int"
)
TABLE_ROWS = "table_id long, document_id long, row_index int, cells array<string>"
FIELDS = "field_id long, document_id long, key string, value string, kind string"
VECTORS = "chunk_id long, embedding array<float>"
REJECTS = (
    "document_id long, filename string, title string, file_type string, size long, content_hash string, canonical_id long, reason string"
)
LIBRARY = {
    "documents": DOCUMENTS, "chunks": CHUNKS, "fields": FIELDS, "tables": LIBRARY_TABLES, "table_rows": TABLE_ROWS,
    "vectors": f"{VECTORS}, document_id long", "rejects": REJECTS,
    "hashes": "document_id long, content_hash string",
}
