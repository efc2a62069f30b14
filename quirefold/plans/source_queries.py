"""Formats, admission, stored library and streaming ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirefold.functions import fixed_values as fv
from quirefold.functions import text as tx
from quirefold.functions.ids import parent_id
from quirefold.operators import admission, counts, extract, ingest, library, vectors
from quirefold.operators.chunk import chunk_prose
from quirefold.plans import corpora
from quirefold.plans import oracle_parts as op
from quirefold.plans.library_queries import library as library_frames
from quirefold.plans.registry import query
from quirefold.plans.search_queries import CHUNKS, doc_chunks
from quirefold.session import materialize, scratch_path, spread
from quirefold.sources import datasource, delimited, files, html, jsondocs, plain
from quirefold.streaming import ingest as streaming
from quirefold.streaming import status as tracking

L = op.with_(*op.LIBRARY)


# --- formats -----------------------------------------------------------------------------------

SECTION_TEXT = "CASE WHEN doc_id % 3 = 0 THEN '# ' || source || chr(10) || '## empty' || chr(10) || '# ' || lang || ' #' || chr(10) || text ELSE text END"


def _marked(spark, sf_dir):
    """Documents of which every third starts with three heading lines, one of them empty."""
    docs = corpora.read(spark, sf_dir, "documents")
    head = F.concat(F.lit("# "), "source", F.lit("\n## empty\n# "), "lang", F.lit(" #\n"))
    return docs.select(F.col("doc_id").alias("document_id"), F.when(F.col("doc_id") % 3 == 0, F.concat(head, "text")).otherwise(F.col("text")).alias("text"))


@query("section_split", f"""
SELECT doc_id AS document_id, 0 AS block_no, CASE WHEN doc_id % 3 = 0 THEN lang || ' #' END AS heading, {op.strip('text')} AS text
FROM documents WHERE doc_id % 3 = 0 OR {op.strip('text')} <> ''""")
def section_split(spark, sf_dir):
    blocks = _marked(spark, sf_dir).select("document_id", plain.parse_text(F.col("text"))["blocks"].alias("blocks"))
    return files.blocks_of(blocks).select("document_id", "block_no", "heading", "text")


@query("prose_concat", f"SELECT doc_id AS document_id, {op.strip('text')} AS text FROM documents WHERE doc_id % 3 = 0 OR {op.strip('text')} <> ''")
def prose_concat(spark, sf_dir):
    parsed = _marked(spark, sf_dir).select("document_id", plain.parse_text(F.col("text"))["blocks"].alias("blocks"))
    return parsed.filter(F.size("blocks") > 0).select("document_id", ingest.prose_of(F.col("blocks")).alias("text"))


@query("csv_infer_header", """
WITH c AS (SELECT *, [',', ';', chr(9), '|'][c_custkey % 4 + 1] AS d, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS bal FROM customer)
SELECT c_custkey AS document_id, d AS delimiter, CASE WHEN c_custkey % 2 = 0 THEN 'key|name|balance' ELSE 'Column 1|Column 2|Column 3' END AS columns,
  CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 2 END AS n_rows, c_custkey || '~' || c_name || ' "' || c_mktsegment || '"' || d || '~' || bal AS first_row,
  c_custkey % 2 = 1 AS warned FROM c""")
def csv_infer_header(spark, sf_dir):
    """One small delimited file per customer: four delimiters, quoted cells, with and without header."""
    cust = corpora.read(spark, sf_dir, "customer")
    key, d = F.col("c_custkey"), F.element_at(F.array(F.lit(","), F.lit(";"), F.lit("\t"), F.lit("|")), (F.col("c_custkey") % 4 + 1).cast("int"))
    row = F.concat(key.cast("string"), d, F.lit('"'), F.col("c_name"), F.lit(' ""'), F.col("c_mktsegment"), F.lit('""'), d, F.lit('"'), d, corpora.money(F.col("c_acctbal")))
    head = F.concat(F.lit("key"), d, F.lit("name"), d, F.lit("balance"))
    docs = cust.select(key.alias("document_id"), F.concat(F.when(key % 2 == 0, head).otherwise(row), F.lit("\r\n"), row, F.lit("\n"), d, d, F.lit("\n")).alias("text"))
    parsed = docs.select("document_id", delimited.delimiter_of(F.col("text")).alias("delimiter"), delimited.parse_delimited(F.col("text")).alias("p"))
    t = F.get("p.tables", F.lit(0))
    return parsed.select("document_id", "delimiter", F.array_join(t["columns"], "|").alias("columns"), F.size(t["rows"]).alias("n_rows"),
                         F.array_join(F.get(t["rows"], F.lit(0)), "~").alias("first_row"), (F.size("p.warnings") > 0).alias("warned"))


@query("csv_quoted_lines", """
SELECT c_custkey AS document_id, 0 AS row_index, 'key|remark|balance' AS columns,
       c_custkey || '~' || c_name || ' of' || c_mktsegment || ', "late"~' || CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS row FROM customer
UNION ALL SELECT c_custkey, 1, 'key|remark|balance', '0~plain~1' FROM customer""")
def csv_quoted_lines(spark, sf_dir):
    """A file per customer with a blank after each comma and a quoted remark that runs over a line end."""
    key = F.col("c_custkey").cast("string")
    remark = F.concat(F.lit('"'), "c_name", F.lit(" of\r\n"), "c_mktsegment", F.lit(', ""late""\"'))
    text = F.concat(F.lit("key, remark, balance\r\n"), key, F.lit(", "), remark, F.lit(", "), corpora.money(F.col("c_acctbal")), F.lit("\r\n0, plain, 1"))
    parsed = corpora.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), F.explode(delimited.parse_delimited(text)["tables"]).alias("t"))
    return parsed.select("document_id", F.array_join("t.columns", "|").alias("columns"), F.posexplode("t.rows").alias("row_index", "r")).select(
        "document_id", "row_index", "columns", F.array_join("r", "~").alias("row"))


@query("json_flatten", "SELECT event_id, 'k: ' || regexp_extract(props, '[0-9]+') AS line FROM events")
def json_flatten(spark, sf_dir):
    walked = corpora.read(spark, sf_dir, "events").select("event_id", jsondocs.walk_json(F.col("props")).alias("w"))
    return walked.select("event_id", F.explode("w.lines").alias("line"))


@query("json_records_table", """
SELECT o_orderkey AS document_id, 0 AS row_index, 'id|status|who.x' AS columns, o_orderkey || '|' || o_orderstatus || '|' AS row FROM orders
UNION ALL SELECT o_orderkey, 1, 'id|status|who.x', o_orderkey || '||{"c":' || o_custkey || ',"n":null}' FROM orders""")
def json_records_table(spark, sf_dir):
    """Two records per order with different keys and a nested object."""
    text = F.expr("""concat('[{"id": ', o_orderkey, ', "status": "', o_orderstatus, '"}, {"id": ', o_orderkey, ', "who.x": {"c": ', o_custkey, ', "n": null}}]')""")
    walked = corpora.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), jsondocs.walk_json(text).alias("w"))
    tables = walked.select("document_id", F.explode("w.tables").alias("t"))
    return tables.select("document_id", F.array_join("t.columns", "|").alias("columns"), F.posexplode("t.rows").alias("row_index", "r")).select(
        "document_id", "row_index", "columns", F.array_join("r", "|").alias("row"))


HTML_CLEAN = "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', '', 'g'), '(?is)<script\\b[^>]*>.*?</script\\s*>', '', 'g'), '(?is)<style\\b[^>]*>.*?</style\\s*>', '', 'g')"


def _entities(x: str) -> str:
    for name, ch in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        x = f"replace({x}, '&{name};', '{ch}')"
    return x


@query("html_text", f"""
WITH c AS (SELECT page_id, {HTML_CLEAN} AS h FROM pages),
t AS (SELECT page_id, {op.strip(_entities("regexp_extract(h, '(?is)<title>(.*?)</title>', 1)"))} AS heading,
        regexp_split_to_array({_entities("regexp_replace(h, '<[/!?a-zA-Z][^>]*>', '', 'g')")}, '\\n') AS ls FROM c)
SELECT page_id AS document_id, heading, array_to_string(list_filter(list_transform(ls, lambda x: {op.strip('x')}), lambda x: x <> ''), chr(10)) AS text FROM t""")
def html_text(spark, sf_dir):
    pages = spread(corpora.read(spark, sf_dir, "pages")).select(F.col("page_id").alias("document_id"), html.parse_html(F.col("html"))["blocks"].alias("blocks"))
    return files.blocks_of(pages).filter("kind = 'prose'").select("document_id", "heading", "text")


@query("html_tables", """
SELECT c_custkey AS document_id, 'Account & ' || c_custkey AS name, 'table 1' AS location, 'field|value|' AS columns, unnest([0, 1]) AS row_index,
  unnest(['name|' || c_name || '|', 'segment|' || c_mktsegment || '|<' || c_nationkey || '>']) AS row FROM customer
UNION ALL SELECT c_custkey, 'Account & ' || c_custkey, 'table 2', 'inner ' || c_nationkey, 0, 'x' FROM customer WHERE false""")
def html_tables(spark, sf_dir):
    """A page with a table of ragged rows per customer."""
    page = F.concat(
        F.lit("<html><title>Account &amp; "), F.col("c_custkey").cast("string"), F.lit("</title><body><p>x</p><TABLE class='t'>\n<tr><th>field<th>value</tr><tr><td> </td></tr>"),
        F.lit("<tr><td><b>name</b></td><td>"), F.col("c_name"), F.lit("</td></tr><tr><td>segment</td><td> "), F.col("c_mktsegment"),
        F.lit("\n</td><td>&lt;"), F.col("c_nationkey").cast("string"), F.lit("&gt;</td></tr></table></body></html>"))
    parsed = corpora.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), F.explode(html.parse_html(page)["tables"]).alias("t"))
    return parsed.select("document_id", "t.name", "t.location", F.array_join("t.columns", "|").alias("columns"), F.posexplode("t.rows").alias("row_index", "r")).select(
        "document_id", "name", "location", "columns", "row_index", F.array_join("r", "|").alias("row"))


@query("html_nested_tables", """
WITH p AS (SELECT c_custkey AS k, c_name AS n, c_mktsegment AS m FROM customer)
SELECT k AS document_id, 'table 1' AS location, 'before ' || n || m || '|after' AS columns FROM p
UNION ALL SELECT k, 'table 2', n || m FROM p UNION ALL SELECT k, 'table 3', m FROM p UNION ALL SELECT k, 'table 4', CAST(k AS VARCHAR) || '|x' FROM p""")
def html_nested_tables(spark, sf_dir):
    """Per customer three tables inside each other, attributes that hold a ">", an end tag with a blank, and a table that is never closed."""
    page = F.concat(
        F.lit('<table summary="a > b"><tr><td>before <table><tr><td title=\'>\'>'), "c_name", F.lit("<TABLE><tr><td>"), "c_mktsegment",
        F.lit("</td></tr></TABLE ></td></tr></table></td><td>after</td></tr></table><p data-x='1 > 0'>text</p><table><tr><td>"),
        F.col("c_custkey").cast("string"), F.lit("<td>x"))
    parsed = corpora.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), F.explode(html.parse_html(page)["tables"]).alias("t"))
    return parsed.select("document_id", "t.location", F.array_join("t.columns", "|").alias("columns"))


def mixed_files(spark, sf_dir):
    """Files of four formats from four tables, with ids that do not collide."""
    def rows(name, key, offset, ext, text):
        df = spread(corpora.read(spark, sf_dir, name))
        title = F.concat(F.lit(name + "_"), F.col(key).cast("string"))
        return df.select((F.col(key) * 4 + offset).alias("document_id"), F.concat(title, F.lit("." + ext)).alias("filename"), title.alias("title"), F.encode(text, "UTF-8").alias("content"))

    cust = F.concat(F.lit("key,name,balance\n"), F.col("c_custkey").cast("string"), F.lit(","), F.col("c_name"), F.lit(","), corpora.money(F.col("c_acctbal")), F.lit("\n"))
    out = rows("documents", "doc_id", 0, "txt", F.col("text")).unionByName(rows("pages", "page_id", 1, "HTML", F.col("html")))
    out = out.unionByName(rows("events", "event_id", 2, "json", F.col("props"))).unionByName(rows("customer", "c_custkey", 3, "csv", cust))
    return out.withColumn("file_type", admission.file_type_of(F.col("filename"))).withColumn("size", F.length("content").cast("long")).withColumn(
        "content_hash", admission.content_hash(F.col("content")))


@query("scan_multiformat", f"""
SELECT doc_id * 4 AS document_id, 'txt' AS file_type, CASE WHEN {op.strip('text')} = '' THEN 0 ELSE 1 END AS n_blocks, 0 AS n_tables, CASE WHEN {op.strip('text')} = '' THEN 'file is empty' END AS error,
  CASE WHEN {op.strip('text')} <> '' THEN md5({op.strip('text')}) END AS all_text FROM documents
UNION ALL SELECT page_id * 4 + 1, 'html', 1, 0, NULL, md5(array_to_string(list_filter(list_transform(regexp_split_to_array({_entities("regexp_replace(" + HTML_CLEAN + ", '<[/!?a-zA-Z][^>]*>', '', 'g')")}, '\\n'), lambda x: {op.strip('x')}), lambda x: x <> ''), chr(10))) FROM pages
UNION ALL SELECT event_id * 4 + 2, 'json', 1, 0, NULL, md5('k: ' || regexp_extract(props, '[0-9]+')) FROM events
UNION ALL SELECT c_custkey * 4 + 3, 'csv', 1, 1, NULL, md5('key,name,balance' || chr(10) || c_custkey || ',' || c_name || ',' || CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR)) FROM customer""")
def scan_multiformat(spark, sf_dir):
    parsed = files.parse(mixed_files(spark, sf_dir))
    return parsed.select("document_id", "file_type", F.size("blocks").alias("n_blocks"), F.size("tables").alias("n_tables"), "error",
                         F.when(F.size("blocks") > 0, F.md5(F.array_join(F.transform("blocks", lambda b: b["text"]), "\n"))).alias("all_text"))


NAMED_DOCUMENTS = "SELECT doc_id, text, 'd' || doc_id || ['.txt', '.md', '.exe', '.TXT'][doc_id % 4 + 1] AS filename FROM documents"


@query("datasource_scan", f"""
SELECT filename, 'd' || doc_id AS title, CASE doc_id % 4 WHEN 1 THEN 'md' ELSE 'txt' END AS file_type, octet_length(encode(text)) AS size, sha256(text) AS content_hash,
  CASE WHEN {op.strip('text')} = '' THEN 0 ELSE 1 END AS n_blocks FROM ({NAMED_DOCUMENTS}) WHERE doc_id % 4 <> 2 AND octet_length(encode(text)) <= 100000""")
def datasource_scan(spark, sf_dir):
    """Documents written as files by the data source and read back: of two types, up to a size, parsed."""
    ending = F.element_at(F.array(*map(F.lit, [".txt", ".md", ".exe", ".TXT"])), (F.col("doc_id") % 4 + 1).cast("int"))
    docs = spread(corpora.read(spark, sf_dir, "documents")).select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string"), ending).alias("filename"), F.encode("text", "UTF-8").alias("content"))
    folder = scratch_path(spark, "files")
    datasource.write_folder(docs, folder)
    found = datasource.read_folder(spark, folder, partitionBytes=4 << 20, types="txt,md", maxBytes=100000)
    return files.parse(found).select("filename", "title", "file_type", "size", "content_hash", F.size("blocks").alias("n_blocks"))


@query("text_rows_source", """
SELECT conv_id * 1048576 + turn AS document_id, role || '.txt' AS filename, role AS title, 'txt' AS file_type, octet_length(encode(text)) AS size, sha256(text) AS content_hash FROM conversations""")
def text_rows_source(spark, sf_dir):
    turns = corpora.read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1048576 + F.col("turn")).alias("document_id"), F.col("role").alias("title"), "text")
    return files.text_rows(turns).drop("content")


# --- admission -----------------------------------------------------------------------------------

@query("admission_filter", """
SELECT doc_id AS document_id, CASE WHEN n_chars * 4096 > 25 * 1024 * 1024 THEN 'file exceeds 25MB limit'
  WHEN doc_id % 5 = 0 THEN 'unsupported file type: exe' WHEN doc_id % 5 = 1 THEN 'unsupported file type: unknown' END AS reason FROM documents""")
def admission_filter(spark, sf_dir):
    """Documents as files of 4 KiB per character under five names."""
    names = F.array(F.lit("a.b.EXE"), F.lit("noext"), F.lit("x.TXT"), F.lit("y.md"), F.lit("z.json"))
    rows = corpora.read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("document_id"), F.element_at(names, (F.col("doc_id") % 5 + 1).cast("int")).alias("filename"), (F.col("n_chars") * 4096).alias("size"))
    admitted, rejected = admission.admit(rows)
    return admitted.select("document_id", F.lit(None).cast("string").alias("reason")).unionByName(rejected.select("document_id", "reason"))


@query("dedup_ingest", """
WITH h AS (SELECT doc_id, sha256(text) AS h FROM documents),
k AS (SELECT h, min(doc_id) AS first_id FROM h GROUP BY h)
SELECT doc_id AS document_id, first_id AS canonical_id, CASE WHEN doc_id = first_id THEN 'pending' ELSE 'duplicate' END AS status FROM h JOIN k USING (h)""")
def dedup_ingest(spark, sf_dir):
    docs = corpora.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), admission.content_hash(F.col("text")).alias("content_hash"))
    return admission.canonical_ids(docs)


@query("dedup_catalogue", """
WITH h AS (SELECT doc_id, sha256(text) AS h, doc_id % 2 AS late FROM documents)
SELECT min(doc_id) AS document_id FROM h l WHERE late = 1 AND NOT EXISTS (SELECT 1 FROM h e WHERE e.late = 0 AND e.h = l.h) GROUP BY h""")
def dedup_catalogue(spark, sf_dir):
    """Odd documents arriving at a catalogue that holds the even ones."""
    docs = corpora.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), admission.content_hash(F.col("text")).alias("content_hash"))
    late = F.col("document_id") % 2 == 1
    return admission.new_documents(docs.filter(late), docs.filter(~late)).select("document_id")


# --- stored library -------------------------------------------------------------------------------

def _invoice_scan(spark, sf_dir):
    return files.text_rows(corpora.invoices(spark, sf_dir).select("document_id", "title", "text"))


@query("catalog_append", op.with_(op.INV, op.INV_TEXT) + """
SELECT document_id, title || '.txt' AS filename, title, 'txt' AS file_type, octet_length(encode(text)) AS size, 'ready' AS status, sha256(text) AS content_hash FROM inv_text""")
def catalog_append(spark, sf_dir):
    """Invoices appended in two batches, then read back."""
    lib = library.Library(spark, scratch_path(spark, "library"), 8)
    scan = _invoice_scan(spark, sf_dir).withColumn("status", F.lit("ready"))
    for batch in (0, 1):
        lib.write_batch(batch, {"documents": scan.filter(F.col("document_id") % 2 == batch).drop("content")})
    return lib.read("documents").select("document_id", "filename", "title", "file_type", "size", "status", "content_hash")


@query("structured_sink", op.with_(op.INV, op.INV_FIELDS, op.TAB) + """
SELECT 'fields' AS name, field_id AS id, 0 AS place, kind || '|' || key || '|' || value AS content FROM inv_fields
UNION ALL SELECT 'table_rows', table_id, row_index, array_to_string(cells, '|') FROM tab_rows
UNION ALL SELECT 'tables', table_id, 0, name || '|' || array_to_string(col_names, '|') FROM tab_names""")
def structured_sink(spark, sf_dir):
    lib = library.Library(spark, scratch_path(spark, "library"), 8)
    _, fields, tables, _ = library_frames(spark, sf_dir)
    rows = corpora.table_rows(spark, sf_dir).withColumn("document_id", F.col("table_id") + corpora.TABLE_DOC_BASE)
    docs = corpora.library_documents(spark, sf_dir)
    lib.write_batch(0, {"fields": fields, "tables": tables, "table_rows": rows, "documents": docs})
    return _listed({t: lib.read(t) for t in ("fields", "table_rows", "tables")})


def parent_document(df):
    return df.withColumn("document_id", parent_id("chunk_id"))


CONTENT = {  # SQL of id, place in it and content of a row
    "documents": ("document_id", "0", "concat_ws('|', title, file_type, status, error)"),
    "chunks": ("chunk_id", "0", "text"), "vectors": ("chunk_id", "0", "''"), "fields": ("field_id", "0", "concat_ws('|', kind, key, value)"),
    "tables": ("table_id", "0", "concat_ws('|', name, array_join(col_names, '|'))"), "table_rows": ("table_id", "row_index", "array_join(cells, '|')"),
}


def _listed(frames):
    """(name, id, place, content) of every row of the library tables."""
    out = None
    for name in sorted(frames):
        key, place, content = CONTENT[name]
        rows = frames[name].select(F.lit(name).alias("name"), F.expr(key).cast("long").alias("id"), F.expr(place).cast("int").alias("place"), F.expr(content).alias("content"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _listed_sql(kept: str, documents: str) -> str:
    """The rows that ``_listed`` has for the documents that satisfy ``kept``."""
    prose = f"array_to_string({op.words('text')}, ' ')"
    return f"""
{documents}
UNION ALL SELECT 'chunks', document_id * 1048576, 0, {prose} FROM inv_text WHERE {kept}
UNION ALL SELECT 'vectors', document_id * 1048576, 0, '' FROM inv WHERE {kept}
UNION ALL SELECT 'fields', field_id, 0, kind || '|' || key || '|' || value FROM inv_fields WHERE {kept}
UNION ALL SELECT 'tables', table_id, 0, name || '|' || array_to_string(col_names, '|') FROM lib_tables JOIN (SELECT table_id, col_names FROM tab_names) USING (table_id) WHERE {kept}
UNION ALL SELECT 'table_rows', table_id, row_index, array_to_string(cells, '|') FROM tab_rows JOIN (SELECT table_id, document_id FROM lib_tables) USING (table_id) WHERE {kept}"""


def _library_frames(spark, sf_dir, gone):
    docs, fields, tables, chunks = library_frames(spark, sf_dir)
    docs, chunks = materialize(docs, "documents"), materialize(chunks, "chunks")  # stored library tables, as the fields are: batches and vectors read them
    docs = docs.withColumn("status", F.when(gone, "processing").otherwise(F.col("status")))
    return {"documents": docs, "fields": fields, "tables": tables, "chunks": chunks,
            "table_rows": corpora.table_rows(spark, sf_dir), "vectors": vectors.embed_passages(chunks)}


DOC_ROW = "SELECT 'documents' AS name, document_id AS id, 0 AS place, concat_ws('|', title, file_type, status, error) AS content FROM lib_docs"


@query("cascade_delete", L + _listed_sql("document_id % 3 <> 0", DOC_ROW + " WHERE document_id % 3 <> 0") + """
UNION ALL SELECT 'deleted', count(*), 0, '' FROM lib_docs WHERE document_id % 3 = 0""")
def cascade_delete(spark, sf_dir):
    """Delete every third document; the request also names documents that do not exist."""
    frames = _library_frames(spark, sf_dir, F.lit(False))
    ids = frames["documents"].select("document_id")
    doomed = ids.filter("document_id % 3 = 0").unionByName(ids.select((-F.col("document_id") - 1).alias("document_id")))
    left = admission.cascade_delete(frames, doomed)
    removed = admission.removed_count(frames["documents"], doomed)
    return _listed(left).unionByName(removed.select(F.lit("deleted").alias("name"), F.col("deleted").alias("id"), F.lit(0).alias("place"), F.lit("").alias("content")))


@query("recover_partial", L + _listed_sql("document_id % 4 <> 0", DOC_ROW.replace(
    "status, error)", "CASE WHEN document_id % 4 = 0 THEN 'failed' ELSE status END, CASE WHEN document_id % 4 = 0 THEN 'interrupted' ELSE error END)")))
def recover_partial(spark, sf_dir):
    return _listed(admission.recover_interrupted(_library_frames(spark, sf_dir, F.col("document_id") % 4 == 0)))


@query("snapshot_roundtrip", L + _listed_sql("document_id % 2 = 1", DOC_ROW + " WHERE document_id % 2 = 1"))
def snapshot_roundtrip(spark, sf_dir):
    """Store in two batches, delete the even documents, snapshot after each step, restore elsewhere, read every table."""
    lib = library.Library(spark, scratch_path(spark, "library"), 8)
    frames = _library_frames(spark, sf_dir, F.lit(False))
    frames["table_rows"] = frames["table_rows"].withColumn("document_id", F.col("table_id") + corpora.TABLE_DOC_BASE)
    target = scratch_path(spark, "snapshots")
    for batch in (0, 1):
        of_batch = F.pmod(F.floor(F.col("document_id") / 2), F.lit(2)) == batch
        lib.write_batch(batch, {n: (parent_document(df) if "document_id" not in df.columns else df).filter(of_batch) for n, df in frames.items()})
        lib.snapshot(target)
    lib.delete(frames["documents"].filter("document_id % 2 = 0").select("document_id"))
    lib.snapshot(target)
    copy = library.Library(spark, scratch_path(spark, "restored"), 8)
    copy.restore(target)
    return _listed({t: copy.read(t) for t in frames})


@query("counts_in_step", L + """
SELECT 'documents' AS name, '' AS key, count(*) AS n FROM lib_docs WHERE document_id % 3 <> 0
UNION ALL SELECT 'ready', '', count(*) FROM lib_docs WHERE document_id % 3 <> 0 AND status = 'ready'
UNION ALL SELECT 'type', file_type, count(*) FROM lib_docs WHERE document_id % 3 <> 0 GROUP BY file_type
UNION ALL SELECT 'status', status, count(*) FROM lib_docs WHERE document_id % 3 <> 0 GROUP BY status
UNION ALL SELECT 'chunks', '', count(*) FROM inv WHERE document_id % 3 <> 0
UNION ALL SELECT 'tables', '', count(*) FROM lib_tables WHERE document_id % 3 <> 0
UNION ALL SELECT 'fields', '', count(*) FROM inv_fields WHERE document_id % 3 <> 0
UNION ALL SELECT 'kind', kind, count(*) FROM inv_fields WHERE document_id % 3 <> 0 GROUP BY kind""")
def counts_in_step(spark, sf_dir):
    """Counts after two writers' batches, deletes in two rounds and a batch that uses deleted ids again, against a recount."""
    lib = library.Library(spark, scratch_path(spark, "library"), 8)
    kept = counts.Counts(lib)
    frames = {n: df for n, df in _library_frames(spark, sf_dir, F.lit(False)).items() if n in counts.COUNTED}
    key = F.col("document_id")
    part = lambda where: {n: (parent_document(df) if "document_id" not in df.columns else df).filter(where) for n, df in frames.items()}
    lib.write_batch(0, part(key % 2 == 0), "load")
    kept.catch_up()
    lib.write_batch(0, part(key % 2 == 1), "stream")
    lib.delete(frames["documents"].filter(key % 5 == 0).select("document_id"))
    kept.catch_up()
    lib.delete(frames["documents"].filter((key % 3 == 0) | (key % 5 == 0)).select("document_id"))
    lib.write_batch(1, part((key % 5 == 0) & (key % 3 != 0)), "stream")
    kept.catch_up()
    kept.catch_up()
    return kept.totals()


@query("bulk_load", """
WITH n AS (SELECT source || '_' || doc_id AS title, text, sha256(text) AS h, CASE WHEN doc_id % 10 = 0 THEN '.exe' WHEN doc_id % 2 = 0 THEN '.txt' ELSE '.md' END AS ext FROM documents),
f AS (SELECT *, title || ext AS filename FROM n),
a AS (SELECT *, row_number() OVER (ORDER BY filename) AS document_id FROM f WHERE ext <> '.exe'),
k AS (SELECT h, min(document_id) AS first_id FROM a GROUP BY h)
SELECT 'document' AS kind, document_id, filename, title, substr(ext, 2) AS file_type, octet_length(encode(text)) AS size, NULL AS reason, NULL AS canonical_id FROM a JOIN k USING (h) WHERE document_id = first_id
UNION ALL SELECT 'reject', document_id, filename, title, substr(ext, 2), octet_length(encode(text)), 'duplicate', first_id FROM a JOIN k USING (h) WHERE document_id <> first_id
UNION ALL SELECT 'reject', NULL, filename, title, 'exe', octet_length(encode(text)), 'unsupported file type: exe', NULL FROM f WHERE ext = '.exe'""")
def bulk_load(spark, sf_dir):
    """Documents written as files and loaded from their folder: the catalogue and the rejects, row by row."""
    k = F.col("doc_id")
    ending = F.when(k % 10 == 0, ".exe").when(k % 2 == 0, ".txt").otherwise(".md")
    docs = spread(corpora.read(spark, sf_dir, "documents")).select(
        F.concat("source", F.lit("_"), k.cast("string"), ending).alias("filename"), F.encode("text", "UTF-8").alias("content"))
    folder = scratch_path(spark, "files")
    datasource.write_folder(docs, folder)
    lib = library.Library(spark, scratch_path(spark, "library"), 8)
    library.bulk_load(lib, folder)
    columns = ["document_id", "filename", "title", "file_type", "size"]
    null = F.lit(None)
    loaded = lib.read("documents").select(F.lit("document").alias("kind"), *columns, null.cast("string").alias("reason"), null.cast("long").alias("canonical_id"))
    return loaded.unionByName(lib.read("rejects").select(F.lit("reject").alias("kind"), *columns, "reason", "canonical_id"))


PARTS = 5


@query("snapshot_rejects", f"""
WITH f AS (SELECT doc_id, doc_id % {PARTS} AS part, sha256(text) AS h FROM documents),
k AS (SELECT h, arg_min(doc_id, (part, doc_id)) AS first_id FROM f WHERE part % 2 = 1 GROUP BY h)
SELECT CASE WHEN part % 2 = 0 OR doc_id <> first_id THEN 'reject' ELSE 'document' END AS kind, doc_id AS document_id,
       CASE WHEN part % 2 = 0 THEN 'unsupported file type: exe' WHEN doc_id <> first_id THEN 'duplicate' END AS reason,
       CASE WHEN part % 2 = 1 AND doc_id <> first_id THEN first_id END AS canonical_id,
       'f' || doc_id || CASE WHEN part % 2 = 0 THEN '.exe' ELSE '.txt' END AS filename, CASE WHEN part % 2 = 1 THEN h END AS content_hash
FROM f LEFT JOIN k USING (h)""")
def snapshot_rejects(spark, sf_dir):
    """Five micro-batches with a snapshot after each; the first, the middle and the last hold refused files only. Read from the restored snapshot."""
    docs = corpora.read(spark, sf_dir, "documents")
    source, target = scratch_path(spark, "source"), scratch_path(spark, "snapshots")
    for part in range(PARTS):
        docs.filter(F.col("doc_id") % PARTS == part).coalesce(1).write.mode("append").parquet(source)

    def named(batch):
        ending = F.when(F.col("document_id") % PARTS % 2 == 0, ".exe").otherwise(".txt")
        return _as_files(batch).withColumn("filename", F.concat(F.lit("f"), F.col("document_id").cast("string"), ending))

    lib = library.Library(spark, scratch_path(spark, "library"), 8)
    streaming.stream_ingest(streaming.file_stream(spark, source, docs.schema), lib, scratch_path(spark, "checkpoint"), target, named).awaitTermination()
    copy = library.Library(spark, scratch_path(spark, "restored"), 8)
    copy.restore(target)
    rejects = copy.read("rejects").select(
        F.lit("reject").alias("kind"), "document_id", "reason", "canonical_id", "filename",
        F.when(F.col("reason") != fv.DUPLICATE, F.lit(None)).otherwise(F.col("content_hash")).alias("content_hash"))
    null = F.lit(None)
    return rejects.unionByName(copy.read("documents").select(
        F.lit("document").alias("kind"), "document_id", null.cast("string").alias("reason"), null.cast("long").alias("canonical_id"), "filename", "content_hash"))


LIFE_SQL = op.with_(CHUNKS) + """,
h AS (SELECT doc_id, sha256(text) AS content_hash FROM documents),
k1 AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY doc_id % 3, doc_id) = 1),
live AS (SELECT * FROM k1 WHERE doc_id % 2 = 1),
k2 AS (SELECT min(doc_id) AS doc_id, content_hash FROM h WHERE doc_id % 4 = 0 AND content_hash NOT IN (SELECT content_hash FROM live) GROUP BY content_hash),
fin AS (SELECT * FROM live UNION ALL SELECT * FROM k2),
n AS (SELECT document_id, string_agg(text, chr(10) ORDER BY seq) AS body FROM chunks GROUP BY document_id)"""


def _lifecycle(spark, sf_dir):
    """A load, two streams, a delete of the even ids, and a load that uses some of them again. All writers begin with batch 0."""
    lib = library.Library(spark, scratch_path(spark, "library"), 8)
    docs = _as_files(corpora.read(spark, sf_dir, "documents"))
    for writer, part in (("load-1", 0), ("stream-1", 1), ("stream-2", 2)):
        streaming.ingest_batch(lib, docs.filter(F.col("document_id") % 3 == part), 0, writer=writer)
    lib.delete(docs.filter("document_id % 2 = 0").select("document_id"))
    streaming.ingest_batch(lib, docs.filter("document_id % 4 = 0"), 0, writer="load-2")
    return lib


@query("library_lifecycle", LIFE_SQL + "SELECT doc_id AS document_id, content_hash, coalesce(body, '') AS body FROM fin LEFT JOIN n ON document_id = doc_id")
def library_lifecycle(spark, sf_dir):
    """What is in the library after loads, streams and a delete: ids, contents and the texts of the chunks."""
    lib = _lifecycle(spark, sf_dir)
    texts = lib.read("chunks").groupBy("document_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda c: c["text"]), "\n").alias("body"))
    return lib.read("documents").select("document_id", "content_hash").join(texts, "document_id", "left").withColumn("body", F.coalesce("body", F.lit("")))


@query("ingest_rejects", """
WITH f AS (SELECT doc_id, sha256(text) AS h, CASE WHEN n_chars * 4096 > 25 * 1024 * 1024 THEN 'file exceeds 25MB limit'
             WHEN doc_id % 5 = 0 THEN 'unsupported file type: exe' WHEN doc_id % 5 = 1 THEN 'unsupported file type: unknown' END AS reason FROM documents),
k AS (SELECT h, min(doc_id) AS first_id FROM f WHERE reason IS NULL GROUP BY h)
SELECT doc_id AS document_id, reason, CAST(NULL AS BIGINT) AS canonical_id FROM f WHERE reason IS NOT NULL
UNION ALL SELECT doc_id, 'duplicate', first_id FROM f JOIN k USING (h) WHERE reason IS NULL AND doc_id <> first_id""")
def ingest_rejects(spark, sf_dir):
    """Documents as files of 4 KiB per character under five names: what was not taken in, and why."""
    names = F.array(F.lit("a.b.EXE"), F.lit("noext"), F.lit("x.TXT"), F.lit("y.md"), F.lit("z.txt"))
    docs = corpora.read(spark, sf_dir, "documents")
    rows = _as_files(docs).drop("size").join(docs.select(F.col("doc_id").alias("document_id"), (F.col("n_chars") * 4096).alias("size")), "document_id")
    lib = library.Library(spark, scratch_path(spark, "library"), 8)
    streaming.ingest_batch(lib, rows.withColumn("filename", F.element_at(names, (F.col("document_id") % 5 + 1).cast("int"))), 0)
    return lib.read("rejects").select("document_id", "reason", "canonical_id")


@query("bulk_load_ids", "SELECT doc_id AS was, row_number() OVER (ORDER BY source || '_' || doc_id || '.txt') AS document_id FROM documents")
def bulk_load_ids(spark, sf_dir):
    """Documents numbered in file name order, as a bulk load numbers them."""
    docs = corpora.doc_texts(spark, sf_dir).select(F.col("document_id").alias("was"), F.concat("title", F.lit(".txt")).alias("filename"))
    return library.dense_ids(docs, "filename").select("was", "document_id")


@query("embed_batch", op.with_(CHUNKS) + f"SELECT chunk_id, CAST(length(embed_text) AS DOUBLE) AS a, CAST(len({op.words('embed_text')}) AS DOUBLE) AS b FROM embedded")
def embed_batch(spark, sf_dir):
    """The model seam with a model that returns the length and the word count of a text."""
    def make_model():
        return lambda texts: [(len(t), len(t.split())) for t in texts]

    out = doc_chunks(spark, sf_dir).select("chunk_id", vectors.embed_with(make_model, F.col("embed_text")).alias("v"))
    return out.select("chunk_id", F.get("v", F.lit(0)).cast("double").alias("a"), F.get("v", F.lit(1)).cast("double").alias("b"))


# --- streaming --------------------------------------------------------------------------------------

def _document_stream(spark, sf_dir):
    """The documents table as a file stream."""
    schema = corpora.read(spark, sf_dir, "documents").schema
    return streaming.file_stream(spark, f"{sf_dir}/documents.parque[t]", schema)


def _as_files(batch):
    return files.text_rows(batch.select(F.col("doc_id").alias("document_id"), F.concat("source", F.lit("_"), F.col("doc_id").cast("string")).alias("title"), "text"))


STREAM_SQL = op.with_(CHUNKS) + """,
k AS (SELECT arg_min(doc_id, (doc_id % 3, doc_id)) AS document_id FROM documents GROUP BY text),
n AS (SELECT document_id, string_agg(text, chr(10) ORDER BY seq) AS body FROM chunks GROUP BY document_id)
SELECT document_id, CASE WHEN body IS NULL THEN 'failed' ELSE 'ready' END AS status, coalesce(body, '') AS body FROM k LEFT JOIN n USING (document_id)"""


@query("stream_ingest", STREAM_SQL)
def stream_ingest(spark, sf_dir):
    """Documents that arrive as three files, ingested by a streaming query with a snapshot per batch, and read from the restored snapshot."""
    lib, source, target = library.Library(spark, scratch_path(spark, "library"), 8), scratch_path(spark, "source"), scratch_path(spark, "snapshots")
    docs = corpora.read(spark, sf_dir, "documents")
    for part in range(3):
        docs.filter(F.col("doc_id") % 3 == part).coalesce(1).write.mode("append").parquet(source)
    streaming.stream_ingest(streaming.file_stream(spark, source, docs.schema), lib, scratch_path(spark, "checkpoint"), target, _as_files).awaitTermination()
    copy = library.Library(spark, scratch_path(spark, "restored"), 8)
    copy.restore(target)
    texts = copy.read("chunks").groupBy("document_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda c: c["text"]), "\n").alias("body"))
    return copy.read("documents").select("document_id", "status").join(texts, "document_id", "left").withColumn("body", F.coalesce("body", F.lit("")))


@query("stream_dedup", "SELECT sha256(text) AS content_hash, count(*) AS n FROM (SELECT DISTINCT text FROM documents) GROUP BY text")
def stream_dedup(spark, sf_dir):
    """Distinct contents of the document stream; equal to the batch result."""
    path = scratch_path(spark, "hashes")
    hashes = _document_stream(spark, sf_dir).select(admission.content_hash(F.col("text")).alias("content_hash"))
    run = streaming.first_seen(hashes).writeStream.format("parquet").option("path", path).option(
        "checkpointLocation", scratch_path(spark, "checkpoint")).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(path).groupBy("content_hash").agg(F.count("*").alias("n"))


@query("ingest_status", f"""
SELECT doc_id AS document_id, CASE WHEN doc_id % 3 = 0 AND {op.strip('text')} <> '' THEN 'ready' ELSE 'failed' END AS status,
  CASE WHEN doc_id % 3 = 0 THEN CASE WHEN {op.strip('text')} = '' THEN 'file is empty' END WHEN doc_id % 3 = 1 THEN 'invalid JSON' ELSE 'unsupported file type' END AS reason,
  CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS has_chunks FROM documents""")
def ingest_status(spark, sf_dir):
    """Documents as text, broken JSON and unsupported files: bad ones fail alone, with their reason."""
    ext = F.element_at(F.array(F.lit(".txt"), F.lit(".json"), F.lit(".exe")), (F.col("doc_id") % 3 + 1).cast("int"))
    docs = corpora.read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("document_id"), F.concat("source", ext).alias("filename"), F.col("source").alias("title"),
        F.encode(F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("{"), "text")).otherwise(F.col("text")), "UTF-8").alias("content"))
    scanned = docs.withColumn("file_type", admission.file_type_of(F.col("filename"))).withColumn("size", F.length("content").cast("long")).withColumn(
        "content_hash", admission.content_hash(F.col("content")))
    lib = ingest.ingest(scanned)
    chunked = lib["chunks"].filter("seq = 0").select("document_id", F.lit(1).alias("c"))
    return lib["documents"].join(chunked, "document_id", "left").select(
        "document_id", "status", F.substring_index("error", ":", 1).alias("reason"), F.coalesce("c", F.lit(0)).alias("has_chunks"))


T0 = "TIMESTAMP '2024-01-01 00:00:00'"


@query("status_tracking", f"""
SELECT doc_id AS document_id, CASE WHEN doc_id % 4 IN (0, 3) THEN 'ready' ELSE 'failed' END AS status,
  CASE doc_id % 4 WHEN 1 THEN 'no text in ' || source WHEN 2 THEN 'interrupted' END AS error,
  CASE doc_id % 4 WHEN 0 THEN {T0} + INTERVAL 10 MINUTE WHEN 1 THEN {T0} + INTERVAL 10 MINUTE WHEN 2 THEN {T0} + INTERVAL 61 MINUTE ELSE {T0} + INTERVAL 182 MINUTE END AS at
FROM documents UNION ALL SELECT -1, 'pending', NULL, {T0} + INTERVAL 300 MINUTE""")
def status_tracking(spark, sf_dir):
    """Events that arrive as four files: all documents begin; some end; some fail and are taken in again; every fourth is never heard of again."""
    docs = corpora.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "source")
    kind, minute = F.col("document_id") % 4, lambda m: F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.make_interval(mins=F.lit(m))
    event = lambda rows, name, at, error=None: rows.select(
        "document_id", F.lit(name).alias("event"), (F.lit(None) if error is None else error).cast("string").alias("error"), minute(at).alias("at"))
    again = docs.filter(kind == 3)
    last = spark.createDataFrame([(-1,)], "document_id long")  # moves the watermark on
    steps = [
        event(docs, "received", 0).unionByName(event(docs, "started", 1)),
        event(docs.filter(kind == 0), "finished", 10).unionByName(event(docs.filter(kind.isin(1, 3)), "failed", 10, F.concat(F.lit("no text in "), "source"))),
        event(again, "received", 180).unionByName(event(again, "started", 181)).unionByName(event(again, "finished", 182)),
        event(last, "received", 300),
    ]
    source, found = scratch_path(spark, "events"), scratch_path(spark, "changes")
    for step in steps:
        step.coalesce(1).write.mode("append").parquet(source)
    stream = streaming.file_stream(spark, source, steps[0].schema)
    tracking.track(stream, found, scratch_path(spark, "checkpoint")).awaitTermination()
    return tracking.current(spark.read.parquet(found))
