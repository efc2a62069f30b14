"""Queries over the catalogue, the fields and the extracted tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirefold.operators import catalog, extract, substring, tablequery
from quirefold.operators.chunk import chunk_prose
from quirefold.plans import corpora
from quirefold.plans import oracle_parts as op
from quirefold.plans.registry import query
from quirefold.session import materialize


def library_tables(spark, sf_dir):
    """documents and tables of the invoice and table library."""
    counts = corpora.table_rows(spark, sf_dir).groupBy("table_id").agg(F.count("*").alias("row_count"))
    tables = corpora.table_headers(spark).join(counts, "table_id", "left").select(
        "table_id", "document_id", "name", F.coalesce("row_count", F.lit(0)).alias("row_count"), "col_names")
    return corpora.library_documents(spark, sf_dir), tables


def library(spark, sf_dir):
    """documents, fields, tables and chunks of the invoice and table library."""
    inv = corpora.invoices(spark, sf_dir)
    docs, tables = library_tables(spark, sf_dir)
    fields = materialize(extract.extract_fields(inv), "fields")  # a stored library table
    return docs, fields, tables, chunk_prose(inv)


W = op.with_(*op.LIBRARY)


@query("stats", W + """
SELECT (SELECT count(*) FROM lib_docs) AS documents, (SELECT count(*) FROM lib_docs WHERE status = 'ready') AS ready,
       (SELECT count(*) FROM inv) AS chunks, (SELECT count(*) FROM lib_tables) AS tables, (SELECT count(*) FROM inv_fields) AS fields""")
def stats(spark, sf_dir):
    docs, fields, tables, chunks = library(spark, sf_dir)
    return catalog.stats(docs, chunks, tables, fields)


@query("stats_by_type", "SELECT lang AS file_type, count(*) AS n FROM documents GROUP BY lang")
def stats_by_type(spark, sf_dir):
    return catalog.count_by(corpora.doc_texts(spark, sf_dir), "file_type")


@query("stats_by_kind", W + "SELECT kind, count(*) AS n FROM inv_fields GROUP BY kind")
def stats_by_kind(spark, sf_dir):
    return catalog.present_kinds(extract.extract_fields(corpora.invoices(spark, sf_dir))).drop("facet")


@query("list_documents", W + """
SELECT d.document_id, title, file_type, status, error, size,
       (SELECT count(*) FROM inv_fields f WHERE f.document_id = d.document_id) AS field_count,
       (SELECT count(*) FROM lib_tables t WHERE t.document_id = d.document_id) AS table_count
FROM lib_docs d""")
def list_documents(spark, sf_dir):
    docs, fields, tables, _ = library(spark, sf_dir)
    return catalog.list_documents(docs, fields, tables)


def _lines(col, *names):
    return F.array_join(F.transform(col, lambda f: F.concat_ws("|", *[f[n].cast("string") for n in names])), "\n")


KIND_ORDER_SQL = "CASE kind WHEN 'amount' THEN 0 WHEN 'date' THEN 1 WHEN 'email' THEN 2 WHEN 'phone' THEN 3 WHEN 'url' THEN 4 WHEN 'item' THEN 5 WHEN 'pair' THEN 6 ELSE 9 END"


@query("overview", W + f""",
lead AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY {KIND_ORDER_SQL}, field_id) AS p FROM inv_fields)
SELECT d.document_id, title, file_type, status, error,
  coalesce((SELECT string_agg(key || '|' || value || '|' || kind, chr(10) ORDER BY p) FROM lead l WHERE l.document_id = d.document_id AND p <= 10), '') AS fields,
  (SELECT count(*) FROM inv_fields f WHERE f.document_id = d.document_id) AS field_count,
  (SELECT count(*) FROM lib_tables t WHERE t.document_id = d.document_id) AS table_count,
  coalesce((SELECT string_agg(table_id || '|' || name || '|' || row_count, chr(10) ORDER BY table_id) FROM lib_tables t WHERE t.document_id = d.document_id), '') AS tables
FROM lib_docs d""")
def overview(spark, sf_dir):
    docs, fields, tables, _ = library(spark, sf_dir)
    out = catalog.overview(docs, fields, tables)
    return out.select(
        "document_id", "title", "file_type", "status", "error",
        F.coalesce(_lines("fields", "key", "value", "kind"), F.lit("")).alias("fields"), "field_count", "table_count",
        F.coalesce(_lines("tables", "id", "name", "row_count"), F.lit("")).alias("tables"),
    )


@query("document_detail", op.with_(op.CAT) + f""",
w AS (SELECT document_id, title, status, {op.words('text')} AS ws,
             greatest(CAST(ceil(5 * (450 - (8 * len({op.words("'[' || title || ']'")}) // 5 + 1)) / 8.0) AS INT) - 1, 1) AS win FROM cat),
p AS (SELECT document_id, unnest(range(0, CASE WHEN len(ws) = 0 THEN 0 ELSE 1 + greatest(CAST(ceil((len(ws) - win) / CAST(greatest(win - 40, 1) AS DOUBLE)) AS INT), 0) END)) AS i, ws, win FROM w),
c AS (SELECT document_id, i, array_to_string(ws[i * greatest(win - 40, 1) + 1 : i * greatest(win - 40, 1) + win], ' ') AS t FROM p),
j AS (SELECT document_id, string_agg(t, chr(10) || chr(10) ORDER BY i) AS full_text, count(*) AS chunk_count FROM c GROUP BY document_id)
SELECT cat.document_id, title, file_type, status, error,
  coalesce(CASE WHEN length(full_text) > 12000 THEN substr(full_text, 1, 12000) || chr(10) || chr(10) || '… (truncated — full text is indexed)' ELSE full_text END, '') AS text_preview,
  coalesce(chunk_count, 0) AS chunk_count,
  CASE WHEN cat.document_id % 50 BETWEEN 1 AND 4 AND cat.document_id < 50 THEN 1 ELSE 0 END AS table_count
FROM cat LEFT JOIN j USING (document_id)""")
def document_detail(spark, sf_dir):
    docs = corpora.documents(spark, sf_dir)
    fields = extract.extract_fields(docs)
    headers = corpora.table_headers(spark).withColumn("document_id", F.col("table_id"))  # documents 1 to 4 own the tables
    tables = extract.build_tables(corpora.table_rows(spark, sf_dir), headers)
    out = catalog.document_detail(docs, fields, tables, chunk_prose(docs))
    return out.select(
        "document_id", "title", "file_type", "status", "error", "text_preview", "chunk_count",
        F.coalesce(F.size("tables"), F.lit(0)).alias("table_count"),
    )


@query("document_fields_detail", W + """
SELECT d.document_id, d.title, coalesce(string_agg(key || '|' || value || '|' || kind, chr(10) ORDER BY field_id), '') AS fields
FROM lib_docs d LEFT JOIN inv_fields f USING (document_id) GROUP BY d.document_id, d.title""")
def document_fields_detail(spark, sf_dir):
    docs, fields, _, chunks = library(spark, sf_dir)
    tables = extract.build_tables(corpora.table_rows(spark, sf_dir), corpora.table_headers(spark))
    out = catalog.document_detail(docs, fields, tables, chunks)
    return out.select("document_id", "title", F.coalesce(_lines("fields", "key", "value", "kind"), F.lit("")).alias("fields"))


@query("get_document", op.with_(op.CAT) + "SELECT document_id, title, file_type, status, error FROM cat WHERE document_id = 7")
def get_document(spark, sf_dir):
    return catalog.get_document(corpora.documents(spark, sf_dir), 7).select("document_id", "title", "file_type", "status", "error")


@query("browse_catalog", op.with_(op.CAT) + """
SELECT 'type' AS ordering, document_id, title, file_type, size, uploaded_at FROM cat WHERE contains(lower(title), 'src1')
UNION ALL SELECT 'size-desc', document_id, title, file_type, size, uploaded_at FROM cat WHERE file_type = 'fr'""")
def browse_catalog(spark, sf_dir):
    docs = corpora.documents(spark, sf_dir)
    cols = ["document_id", "title", "file_type", "size", "uploaded_at"]
    a = catalog.browse(docs, q="SRC1", order="type").select(F.lit("type").alias("ordering"), *cols)
    return a.unionByName(catalog.browse(docs, file_type="fr", order="size-desc").select(F.lit("size-desc").alias("ordering"), *cols))


@query("distinct_types", "SELECT DISTINCT lang AS file_type FROM documents")
def distinct_types(spark, sf_dir):
    return catalog.distinct_types(corpora.doc_texts(spark, sf_dir))


@query("extract_totals", W + """
SELECT count(*) AS ready, (SELECT count(*) FROM inv_fields f JOIN lib_docs USING (document_id) WHERE status = 'ready') AS fields,
       (SELECT count(*) FROM lib_tables JOIN lib_docs USING (document_id) WHERE status = 'ready') AS tables
FROM lib_docs WHERE status = 'ready'""")
def extract_totals(spark, sf_dir):
    docs, fields, tables, _ = library(spark, sf_dir)
    return catalog.extract_totals(docs, fields, tables)


@query("record_search", W + """
SELECT document_id, title FROM lib_docs d WHERE status = 'ready'
  AND EXISTS (SELECT 1 FROM inv_fields l WHERE l.document_id = d.document_id AND kind = 'item')
  AND (contains(lower(title), '99') OR EXISTS (SELECT 1 FROM inv_fields l WHERE l.document_id = d.document_id
       AND (contains(lower(value), '99') OR contains(lower(key), '99'))))""")
def record_search(spark, sf_dir):
    docs, fields, _, _ = library(spark, sf_dir)
    return catalog.record_search(docs, fields, kind="item", q="99").select("document_id", "title")


@query("search_fields", W + """
SELECT field_id, f.document_id, title, key, value, kind FROM inv_fields f JOIN lib_docs USING (document_id)
WHERE kind = 'pair' AND (value ILIKE '%nation_1%' OR key ILIKE '%nation_1%')""")
def search_fields(spark, sf_dir):
    docs, fields, _, _ = library(spark, sf_dir)
    return catalog.search_fields(fields, docs, kind="pair", q="nation_1")


NEEDLES = """
nd AS (SELECT n_nationkey AS query_id, substr(n_name, 3, 6) AS q FROM nation UNION ALL SELECT 100 + p_partkey, substr(p_name, 2, 7) FROM part WHERE p_size = 7
       UNION ALL SELECT 1000000 + min(c_custkey), upper(substr(c_mktsegment, 2, 3)) FROM customer GROUP BY c_mktsegment
       UNION ALL SELECT 2000000 + r_regionkey, CAST(r_regionkey AS VARCHAR) || CAST(r_regionkey AS VARCHAR) FROM region UNION ALL SELECT 3000000, '7.' UNION ALL SELECT 3000001, 'not there')"""


@query("substring_search", op.with_(*op.LIBRARY, NEEDLES) + """,
pl AS (SELECT 'key' AS place, field_id AS id, key AS text FROM inv_fields UNION ALL SELECT 'value', field_id, value FROM inv_fields
       UNION ALL SELECT 'cell', CAST(table_id AS BIGINT) * 1000000000 + row_index * 100 + col_index, value FROM tab_cells)
SELECT query_id, place, count(*) AS n, min(id) AS first_id, max(id) AS last_id, CAST(sum(id % 1000003) AS BIGINT) AS id_sum
FROM nd JOIN pl ON contains(lower(text), lower(q)) GROUP BY query_id, place""")
def substring_search(spark, sf_dir):
    """Parts of names, segments and numbers, looked for in all keys, values and cells at once."""
    fields = library(spark, sf_dir)[1]
    cells = extract.cells_of(corpora.table_rows(spark, sf_dir), corpora.table_headers(spark))
    cell_id = F.col("table_id") * 1000000000 + F.col("row_index") * 100 + F.col("col_index")
    places = fields.select(F.lit("key").alias("place"), F.col("field_id").alias("id"), F.col("key").alias("text")).unionByName(
        fields.select(F.lit("value").alias("place"), F.col("field_id").alias("id"), F.col("value").alias("text"))).unionByName(
        cells.select(F.lit("cell").alias("place"), cell_id.alias("id"), F.col("value").alias("text")))
    read = lambda name: corpora.read(spark, sf_dir, name)
    region = F.col("r_regionkey").cast("string")
    asked = read("nation").select(F.col("n_nationkey").cast("long").alias("query_id"), F.substring("n_name", 3, 6).alias("q")).unionByName(
        read("part").filter("p_size = 7").select((F.col("p_partkey") + 100).cast("long").alias("query_id"), F.substring("p_name", 2, 7).alias("q"))).unionByName(
        read("customer").groupBy("c_mktsegment").agg((F.min("c_custkey") + 1000000).cast("long").alias("query_id")).select(
            "query_id", F.upper(F.substring("c_mktsegment", 2, 3)).alias("q"))).unionByName(
        read("region").select((F.col("r_regionkey") + 2000000).cast("long").alias("query_id"), F.concat(region, region).alias("q"))).unionByName(
        spark.createDataFrame([(3000000, "7."), (3000001, "not there")], "query_id long, q string"))
    number = F.col("id")
    return substring.search(asked, substring.build(places), ["place"], {
        "n": ("count", F.lit(1)), "first_id": ("min", number), "last_id": ("max", number), "id_sum": ("sum", number % 1000003)})


# --- typed tables ---------------------------------------------------------------------------

T = op.with_(op.TAB)
CUSTOMER = [("custkey", "number"), ("name", "text"), ("nationkey", "number"), ("acctbal", "number"), ("mktsegment", "text")]
ORDERS = [("orderkey", "number"), ("custkey", "number"), ("orderstatus", "text"), ("totalprice", "number"), ("orderdate", "date"), ("orderpriority", "text")]


def _rows(df):
    return df.select("row_index", F.array_join("cells", "|").alias("cells"))


@query("table_filter", T + """
SELECT 'gte' AS op, row_index, array_to_string(cells, '|') AS cells FROM tab_rows WHERE table_id = 1 AND CAST(cells[4] AS DOUBLE) >= 1000
UNION ALL SELECT 'contains', row_index, array_to_string(cells, '|') FROM tab_rows WHERE table_id = 2 AND contains(cells[5], '1997-')
UNION ALL SELECT 'eq', row_index, array_to_string(cells, '|') FROM tab_rows WHERE table_id = 1 AND lower(cells[5]) = 'building'""")
def table_filter(spark, sf_dir):
    rows = corpora.table_rows(spark, sf_dir)
    cust, orders = rows.filter("table_id = 1"), rows.filter("table_id = 2")
    a = _rows(tablequery.filter_rows(cust, CUSTOMER, "acctbal", "gte", "1,000")).select(F.lit("gte").alias("op"), "row_index", "cells")
    b = _rows(tablequery.filter_rows(orders, ORDERS, "orderdate", "contains", "1997-")).select(F.lit("contains").alias("op"), "row_index", "cells")
    c = _rows(tablequery.filter_rows(cust, CUSTOMER, "mktsegment", "eq", "Building")).select(F.lit("eq").alias("op"), "row_index", "cells")
    return a.unionByName(b).unionByName(c)


@query("coerce_number", T + """
SELECT table_id, row_index, col_index, try_cast(regexp_replace(regexp_replace(value, ',', '', 'g'), '%+$', '') AS DOUBLE) AS number
FROM tab_cells WHERE regexp_full_match(value, '[+-]?[0-9]+(\\.[0-9]*)?')
UNION ALL SELECT table_id, row_index, col_index, NULL FROM tab_cells WHERE NOT regexp_full_match(value, '[+-]?[0-9]+(\\.[0-9]*)?')""")
def coerce_number(spark, sf_dir):
    from quirefold.functions import text as tx

    cells = extract.cells_of(corpora.table_rows(spark, sf_dir), corpora.table_headers(spark))
    return cells.select("table_id", "row_index", "col_index", tx.coerce_number(F.col("value")).alias("number"))


@query("table_sort", T + """
SELECT row_index, array_to_string(cells, '|') AS cells, row_number() OVER (ORDER BY CAST(cells[4] AS DOUBLE) DESC, row_index) AS pos
FROM tab_rows WHERE table_id = 2 ORDER BY pos LIMIT 200""")
def table_sort(spark, sf_dir):
    from pyspark.sql import Window

    orders = tablequery.load_table(corpora.table_rows(spark, sf_dir), 2)
    top = tablequery.query_table(orders, ORDERS, sort="totalprice", dir="desc", limit=200).rows
    ranked = top.withColumn("pos", F.row_number().over(Window.partitionBy("table_id").orderBy(*tablequery.sort_keys(ORDERS, "totalprice", "desc"))))
    return ranked.select("row_index", F.array_join("cells", "|").alias("cells"), "pos")


@query("table_page", T + """,
k AS (SELECT * FROM tab_rows WHERE table_id = 1 AND contains(lower(cells[5]), 'hold'))
SELECT row_index, array_to_string(cells, '|') AS cells, (SELECT count(*) FROM k) AS total
FROM (SELECT * FROM k ORDER BY lower(cells[2]), row_index LIMIT 50 OFFSET 10)""")
def table_page(spark, sf_dir):
    rows = corpora.table_rows(spark, sf_dir).filter("table_id = 1")
    page = tablequery.query_table(rows, CUSTOMER, col="mktsegment", val="hold", sort="name", offset=10)
    total = page.total.first()["total"]
    return _rows(page.rows).withColumn("total", F.lit(total))


@query("list_tables", W + """
SELECT table_id, t.document_id, title, name, row_count, file_type FROM lib_tables t JOIN lib_docs USING (document_id)""")
def list_tables(spark, sf_dir):
    docs, tables = library_tables(spark, sf_dir)
    return tablequery.list_tables(tables, docs).select("table_id", "document_id", "title", "name", "row_count", "file_type")


@query("load_table", T + "SELECT row_index, array_to_string(cells, '|') AS cells FROM tab_rows WHERE table_id = 3")
def load_table(spark, sf_dir):
    return _rows(tablequery.load_table(corpora.table_rows(spark, sf_dir), 3))


@query("any_cell_filter", T + """,
f AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY row_index) AS shown_as FROM tab_rows
      WHERE len(list_filter(cells, lambda c: contains(lower(c), 'ma'))) > 0)
SELECT table_id, row_index, array_to_string(cells, '|') AS cells, shown_as FROM f""")
def any_cell_filter(spark, sf_dir):
    out = tablequery.any_cell_filter(corpora.table_rows(spark, sf_dir), "MA", numbered=True)
    return out.select("table_id", "row_index", F.array_join("cells", "|").alias("cells"), "shown_as")


@query("infer_column_type", T + r"""
SELECT table_id, col_index, col_name,
  CASE WHEN count(*) FILTER (trim(value) <> '') = 0 THEN 'text'
       WHEN count(*) FILTER (trim(value) <> '') = count(*) FILTER (regexp_matches(replace(trim(value), ' ', ''), '^[+-]?[0-9,]*\.?[0-9]+%?$')) THEN 'number'
       WHEN count(*) FILTER (trim(value) <> '') = count(*) FILTER (regexp_matches(value, '\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b')) THEN 'date'
       ELSE 'text' END AS type
FROM tab_cells GROUP BY table_id, col_index, col_name""")
def infer_column_type(spark, sf_dir):
    return extract.infer_types(extract.cells_of(corpora.table_rows(spark, sf_dir), corpora.table_headers(spark)))


@query("typed_table", """
SELECT CAST(o_orderkey AS INT) AS row_index, CAST(o_orderkey AS DOUBLE) AS orderkey, CAST(o_custkey AS DOUBLE) AS custkey, o_orderstatus AS orderstatus,
       CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS totalprice, strftime(o_orderdate, '%Y-%m-%d') AS orderdate, o_orderpriority AS orderpriority
FROM orders""")
def typed_table(spark, sf_dir):
    rows = corpora.table_rows(spark, sf_dir)
    built = extract.build_tables(rows.filter("table_id = 2"), corpora.table_headers(spark).filter("table_id = 2"))
    columns = [(c["name"], c["type"]) for c in built.first()["columns"]]
    return extract.typed_frame(rows, columns, 2)
