"""Question routing, table facts, answer checks and retrieval evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirefold.functions import fixed_values as fv
from quirefold.functions import text as tx
from quirefold.functions.ids import parent_id
from quirefold.operators import answers, evaluation, extract, hybrid, keyword, routing, tablefacts
from quirefold.operators.chunk import chunk_prose
from quirefold.plans import corpora
from quirefold.plans import oracle_parts as op
from quirefold.plans.library_queries import library
from quirefold.plans.registry import query
from quirefold.plans.search_queries import CHUNKS, HYB, QTERMS, TOKENS, doc_chunks, search_index
from quirefold.session import broadcast_if_small, materialize


def _any(x: str, cues) -> str:
    return f"len(list_filter([{op.in_list(cues)}], lambda c: contains({x}, c))) > 0"


PAD = "' ' || lower(q) || ' '"
INTENTS = "list_filter([" + ", ".join(f"CASE WHEN {_any(PAD, cues)} THEN '{k}' END" for k, cues in fv.FIELD_INTENT_CUES.items()) + "], lambda k: k IS NOT NULL)"
TARGETS = f"list_concat({INTENTS}, CASE WHEN {_any(PAD, fv.PAIR_CUES)} THEN ['pair'] ELSE [] END)"
Q = op.with_(op.QST)


@query("aggregate_intent", Q + f"SELECT query_id, {_any(PAD, fv.AGGREGATE_CUES)} AS wide FROM qst")
def aggregate_intent(spark, sf_dir):
    return corpora.questions(spark, sf_dir).select("query_id", routing.aggregate_intent(F.col("q")).alias("wide"))


@query("field_intents", Q + f"SELECT query_id, array_to_string({INTENTS}, ',') AS kinds FROM qst")
def field_intents(spark, sf_dir):
    return corpora.questions(spark, sf_dir).select("query_id", F.array_join(routing.field_intents(F.col("q")), ",").alias("kinds"))


@query("target_kinds", Q + f"SELECT query_id, array_to_string({TARGETS}, ',') AS kinds FROM qst")
def target_kinds(spark, sf_dir):
    return corpora.questions(spark, sf_dir).select("query_id", F.array_join(routing.target_kinds(F.col("q")), ",").alias("kinds"))


def _filtered_questions(spark, sf_dir):
    """Questions of which some ask for one document and some for one type."""
    k = F.col("query_id") % 10
    return corpora.questions(spark, sf_dir).withColumn("doc_id", F.when(k == 4, F.col("query_id")).otherwise(0)).withColumn(
        "file_type", F.when(k == 6, "csv").when(k == 8, "txt"))


@query("direct_answers", op.with_(*op.LIBRARY, op.QST) + f""",
w AS (SELECT query_id, {INTENTS} AS kinds, CASE WHEN query_id % 10 = 4 THEN query_id ELSE 0 END AS want_doc,
             CASE query_id % 10 WHEN 6 THEN 'csv' WHEN 8 THEN 'txt' ELSE '' END AS want_type FROM qst),
req AS (SELECT DISTINCT kinds, want_doc, want_type FROM w WHERE len(kinds) > 0),
f AS (SELECT f.*, title, file_type FROM inv_fields f JOIN lib_docs USING (document_id)),
hit AS (SELECT req.*, f.* FROM req JOIN f ON want_doc = 0 AND list_contains(kinds, f.kind) AND (want_type = '' OR want_type = file_type)
        UNION ALL SELECT req.*, f.* FROM req JOIN f ON want_doc = f.document_id AND want_doc <> 0 AND list_contains(kinds, f.kind) AND (want_type = '' OR want_type = file_type)),
r AS (SELECT *, row_number() OVER (PARTITION BY kinds, want_doc, want_type ORDER BY field_id) AS pos FROM hit)
SELECT query_id, pos, field_id, document_id, title, value, kind FROM w JOIN r USING (kinds, want_doc, want_type) WHERE pos <= 12""")
def direct_answers(spark, sf_dir):
    docs, fields, _, _ = library(spark, sf_dir)
    return routing.direct_answers(_filtered_questions(spark, sf_dir), fields, docs)


SPEC = "CASE kind WHEN 'item' THEN 0 WHEN 'pair' THEN 1 WHEN 'email' THEN 2 WHEN 'url' THEN 3 WHEN 'phone' THEN 4 WHEN 'date' THEN 5 WHEN 'amount' THEN 6 ELSE 9 END"
SUMMARY = f"""
ks AS (SELECT DISTINCT {TARGETS} AS kinds FROM qst),
rf AS (SELECT kinds, f.*, row_number() OVER (PARTITION BY kinds, document_id ORDER BY {SPEC}, field_id) AS p
       FROM ks JOIN inv_fields f ON list_contains(kinds, f.kind)),
df AS (SELECT kinds, document_id, count(*) FILTER (kind = 'item') AS items, count(*) AS n,
              string_agg(CASE WHEN kind IN ('pair', 'item') THEN key || '=' || value ELSE kind || '=' || value END, '; ' ORDER BY p) AS facts FROM rf WHERE p <= 15 GROUP BY ALL),
ln AS (SELECT kinds, document_id, coalesce(items, 0) AS items, coalesce(n, 0) AS n, title, file_type,
              '- ' || title || ' [' || file_type || ']' || CASE WHEN n > 0 THEN ' :: ' || facts ELSE '' END AS line
       FROM (SELECT ks.kinds, d.* FROM ks, lib_docs d WHERE status = 'ready') LEFT JOIN df USING (kinds, document_id)),
od AS (SELECT *, row_number() OVER (PARTITION BY kinds ORDER BY items DESC, n DESC, file_type, title, document_id) AS pos FROM ln),
hd AS (SELECT 'LIBRARY — ' || count(*) || ' documents (your complete library). Format: title [type] :: field=value; …' AS header, count(*) AS total FROM lib_docs WHERE status = 'ready'),
fold AS (SELECT kinds, list_reduce(list_prepend({{'used': (SELECT length(header) FROM hd), 'ids': CAST([] AS BIGINT[])}},
           list({{'used': length(line) + 1, 'ids': [pos]}} ORDER BY pos)),
           lambda a, x: CASE WHEN a.used + x.used > 11000 THEN a ELSE {{'used': a.used + x.used, 'ids': list_concat(a.ids, x.ids)}} END) AS f FROM od GROUP BY kinds),
kept AS (SELECT kinds, unnest(f.ids) AS pos FROM fold)"""


@query("library_summary", op.with_(*op.LIBRARY, op.QST, SUMMARY) + """
SELECT array_to_string(kinds, ',') AS kinds, line FROM kept JOIN od USING (kinds, pos)
UNION ALL SELECT array_to_string(kinds, ','), header FROM ks, hd
UNION ALL SELECT array_to_string(kinds, ','), '(+' || (total - len(f.ids)) || ' more document(s) omitted to fit the size limit)' FROM fold, hd WHERE total > len(f.ids)""")
def library_summary(spark, sf_dir):
    docs, fields, _, _ = library(spark, sf_dir)
    return routing.library_summary(corpora.questions(spark, sf_dir), docs, fields).select("kinds", "line")


@query("budget_pack", f"""
WITH ln AS (SELECT lang AS file_type, doc_id, text AS line, row_number() OVER (PARTITION BY lang ORDER BY doc_id % 7, doc_id) AS pos FROM documents),
f AS (SELECT file_type, list_reduce(list_prepend({{'used': 0, 'ids': CAST([] AS BIGINT[])}}, list({{'used': length(line) + 1, 'ids': [doc_id]}} ORDER BY pos)),
        lambda a, x: CASE WHEN a.used + x.used > 11000 THEN a ELSE {{'used': a.used + x.used, 'ids': list_concat(a.ids, x.ids)}} END) AS f FROM ln GROUP BY file_type),
k AS (SELECT file_type, unnest(f.ids) AS doc_id FROM f)
SELECT file_type, line FROM k JOIN ln USING (file_type, doc_id)""")
def budget_pack(spark, sf_dir):
    """Whole texts of mixed length per language."""
    docs = corpora.read(spark, sf_dir, "documents").select(
        F.col("lang").alias("file_type"), (F.col("doc_id") % 7).alias("seventh"), "doc_id", F.col("text").alias("line"))
    return routing.budget_pack(docs, "file_type", [F.asc("seventh"), F.asc("doc_id")], 0).select("file_type", "line")


# --- table facts -----------------------------------------------------------------------------

OP = f"CASE WHEN {_any('question', fv.AVG_CUES)} THEN 'avg' WHEN {_any('question', fv.COUNT_CUES)} THEN 'count' WHEN {_any('question', fv.SUM_CUES)} THEN 'sum' END"
TSTOP = op.in_list(fv.TABLE_STOPWORDS)
W = r"[\p{L}\p{N}_]"
NW = r"[^\p{L}\p{N}_]"
FACTS = f"""
aq AS (SELECT question, op, list_distinct(list_filter(regexp_extract_all(question, '[a-z0-9]+'), lambda t: t NOT IN ({TSTOP}))) AS terms
       FROM (SELECT question, {OP} AS op FROM (SELECT DISTINCT lower(q) AS question FROM qst)) WHERE op IS NOT NULL),
vals AS (SELECT table_id, col_index, col_name, lower(trim(value)) AS k, min(row_index) AS r, arg_min(trim(value), row_index) AS v FROM tab_cells WHERE length(trim(value)) >= 3 GROUP BY ALL),
vh AS (SELECT question, table_id, col_index, col_name, k, r, v FROM aq JOIN vals ON contains(question, k)
       WHERE regexp_matches(question, CASE WHEN regexp_matches(k, '^{W}') THEN '(^|{NW})' ELSE '{W}' END || regexp_escape(k) || CASE WHEN regexp_matches(k, '{W}$') THEN '($|{NW})' ELSE '{W}' END)),
vf AS (SELECT question, table_id, arg_min(col_index, (col_index, r)) AS f_col, arg_min(col_name, (col_index, r)) AS f_name, arg_min(v, (col_index, r)) AS f_value, arg_min(k, (col_index, r)) AS f_key FROM vh GROUP BY ALL),
num AS (SELECT *, try_cast(nullif(regexp_extract(replace(value, ',', ''), '-?[0-9]+(\\.[0-9]+)?'), '') AS DOUBLE) AS x FROM tab_cells),
selk AS (SELECT DISTINCT table_id, f_col, f_key FROM vf),
selr AS (SELECT s.*, c.row_index FROM selk s JOIN tab_cells c ON c.table_id = s.table_id AND c.col_index = s.f_col AND lower(trim(c.value)) = s.f_key),
st AS (SELECT table_id, -1 AS f_col, '' AS f_key, col_index, col_name, count(*) AS n_rows, count(x) AS n_num, sum(x) AS total FROM num GROUP BY ALL
       UNION ALL SELECT selr.table_id, f_col, f_key, col_index, col_name, count(*), count(x), sum(x) FROM selr JOIN num ON num.table_id = selr.table_id AND num.row_index = selr.row_index GROUP BY ALL),
tw AS (SELECT table_id, name, list_distinct(regexp_extract_all(lower(name), '[a-z0-9]+')) AS ws FROM tab_names),
base AS (SELECT aq.question, op, terms, tw.table_id, name, len(list_intersect(ws, terms)) > 0 AS named, coalesce(f_col, -1) AS f_col, f_name, f_value, coalesce(f_key, '') AS f_key, f_col IS NOT NULL AS filtered
         FROM aq CROSS JOIN tw LEFT JOIN vf ON vf.question = aq.question AND vf.table_id = tw.table_id),
mc AS (SELECT b.*, col_index, col_name, n_num, total, len(list_intersect(list_distinct(regexp_extract_all(lower(col_name), '[a-z0-9]+')), terms)) AS ov,
              list_min(list_transform(list_filter(range(0, {len(fv.MEASURE_WORDS)}), lambda i: contains(lower(col_name), ([{op.in_list(fv.MEASURE_WORDS)}])[i + 1])), lambda i: i)) AS ms
       FROM base b JOIN st ON st.table_id = b.table_id AND st.f_col = b.f_col AND st.f_key = b.f_key WHERE op <> 'count' AND n_num >= greatest(1, 0.6 * n_rows)),
pk AS (SELECT *, row_number() OVER (PARTITION BY question, table_id ORDER BY ov DESC, CASE WHEN ov > 0 THEN 0 ELSE ms END, col_index) AS p FROM mc WHERE ov > 0 OR (named AND ms IS NOT NULL))"""
FMT = "CASE WHEN abs(v - round(v)) < 1e-9 THEN format('{:,.0f}', v) ELSE format('{:,.2f}', v) END"
FACT_ROWS = f"""
fx AS (SELECT question, table_id, 2 * ov + CASE WHEN named THEN 2 ELSE 0 END + CASE WHEN filtered THEN 1 ELSE 0 END AS score,
              op || ' of ' || col_name || ' in "' || name || '"' || CASE WHEN filtered THEN ' where ' || f_name || ' = ' || f_value ELSE '' END || ' = ' || {FMT} || ' (over ' || n_num || ' rows)' AS fact
       FROM (SELECT *, CASE WHEN op = 'sum' THEN total ELSE total / n_num END AS v FROM pk WHERE p = 1)
       UNION ALL SELECT b.question, b.table_id, CASE WHEN named THEN 2 ELSE 0 END + CASE WHEN filtered THEN 1 ELSE 0 END,
              'number of rows in "' || name || '"' || CASE WHEN filtered THEN ' where ' || f_name || ' = ' || f_value ELSE '' END || ' = ' || (SELECT max(n_rows) FROM st WHERE st.table_id = b.table_id AND st.f_col = b.f_col AND st.f_key = b.f_key)
       FROM base b WHERE op = 'count' AND (named OR filtered)),
fr AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, table_id DESC) AS pos FROM fx)"""


def _tables(spark, sf_dir):
    return corpora.table_headers(spark), corpora.table_rows(spark, sf_dir)


@query("agg_op", Q + f"SELECT query_id, {OP} AS op FROM (SELECT query_id, lower(q) AS question FROM qst)")
def agg_op(spark, sf_dir):
    return corpora.questions(spark, sf_dir).select("query_id", tablefacts.operation(F.lower("q")).alias("op"))


@query("value_filter", op.with_(op.TAB, op.QST, FACTS) + "SELECT question, table_id, f_col, f_name, f_value FROM vf")
def value_filter(spark, sf_dir):
    headers, rows = _tables(spark, sf_dir)
    asked = tablefacts.asked(corpora.questions(spark, sf_dir))
    return tablefacts.value_filters(asked, extract.cells_of(rows, headers)).drop("f_key")


@query("value_mentions", op.with_(op.TAB, op.QST, FACTS) + "SELECT question, table_id, f_col, f_name, f_value FROM vf")
def value_mentions(spark, sf_dir):
    """The values that questions mention, by automata over the distinct cells."""
    headers, rows = _tables(spark, sf_dir)
    asked = tablefacts.asked(corpora.questions(spark, sf_dir))
    return tablefacts.value_filters_by_automaton(asked, extract.cells_of(rows, headers)).drop("f_key")


@query("numeric_columns", op.with_(op.TAB, op.QST, FACTS) + "SELECT table_id, f_col, f_key, col_name, n_rows, n_num, round(total, 2) AS total FROM st WHERE n_num >= greatest(1, 0.6 * n_rows)")
def numeric_columns(spark, sf_dir):
    headers, rows = _tables(spark, sf_dir)
    wide = extract.wide_rows(rows, headers)
    filters = tablefacts.value_filters(tablefacts.asked(corpora.questions(spark, sf_dir)), extract.long_cells(wide))
    stats = tablefacts.numeric_columns(tablefacts.selected_stats(wide, filters))
    return stats.drop("col_index").withColumn("total", F.round("total", 2))


@query("pick_measure", op.with_(op.TAB, op.QST, FACTS) + "SELECT question, table_id, ov AS overlap, col_name FROM pk WHERE p = 1 AND NOT filtered")
def pick_measure(spark, sf_dir):
    """The measure of every unfiltered (question, table) pair."""
    headers, rows = _tables(spark, sf_dir)
    wide = extract.wide_rows(rows, headers)
    asked = tablefacts.asked(corpora.questions(spark, sf_dir)).filter("op <> 'count'")
    filters = tablefacts.value_filters(asked, extract.long_cells(wide)).select("question", "table_id")
    named = tablefacts.named_tables(asked, headers).withColumn("named", F.lit(True))
    pairs = named.select("question", "table_id").unionByName(tablefacts.touched_tables(asked, headers)).distinct().join(filters, ["question", "table_id"], "left_anti")
    stats = tablefacts.numeric_columns(tablefacts.selected_stats(wide, filters.select("table_id", F.lit(0).alias("f_col"), F.lit("").alias("f_key")))).filter("f_col = -1")
    candidates = pairs.join(asked, "question").join(named, ["question", "table_id"], "left").withColumn("named", F.coalesce("named", F.lit(False))).join(stats, "table_id")
    return tablefacts.pick_measure(candidates).select("question", "table_id", "overlap", "col_name")


@query("table_facts", op.with_(op.TAB, op.QST, FACTS, FACT_ROWS) + """
SELECT query_id, pos, table_id, score, fact FROM (SELECT query_id, lower(q) AS question FROM qst) JOIN fr USING (question) WHERE pos <= 3""")
def table_facts(spark, sf_dir):
    return tablefacts.table_facts(corpora.questions(spark, sf_dir), *_tables(spark, sf_dir))


EMPTY_TABLES = op.TAB.replace("(4, 'nation', ['nationkey','name','regionkey'])", "(4, 'nation', ['nationkey','name','regionkey']), (5, 'refund', ['refundkey','amount'])")
EMPTY_QST = op.QST + """,
qst2 AS (SELECT * FROM qst UNION ALL SELECT -c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'how many refund rows are there?' WHEN 1 THEN 'total amount of the refund table'
  ELSE 'how many refund rows for ' || c_mktsegment || '?' END FROM customer)"""


@query("table_facts_empty", op.with_(EMPTY_TABLES, EMPTY_QST, FACTS.replace("FROM qst)", "FROM qst2)"), FACT_ROWS.replace(
    "(SELECT max(n_rows)", "coalesce((SELECT max(n_rows)").replace("st.f_key = b.f_key)\n", "st.f_key = b.f_key), 0)\n")) + """
SELECT query_id, pos, table_id, score, fact FROM (SELECT query_id, lower(q) AS question FROM qst2) JOIN fr USING (question) WHERE pos <= 3""")
def table_facts_empty(spark, sf_dir):
    """The questions of ``table_facts`` and some about a table that has a header and no rows."""
    headers, rows = _tables(spark, sf_dir)
    empty = spark.createDataFrame([(5, corpora.TABLE_DOC_BASE + 5, "refund", ["refundkey", "amount"])], headers.schema)
    key = F.col("c_custkey")
    about = corpora.read(spark, sf_dir, "customer").select((-key).alias("query_id"), F.when(key % 3 == 0, "how many refund rows are there?").when(
        key % 3 == 1, "total amount of the refund table").otherwise(F.concat(F.lit("how many refund rows for "), "c_mktsegment", F.lit("?"))).alias("q"))
    return tablefacts.table_facts(corpora.questions(spark, sf_dir).unionByName(about), headers.unionByName(empty), rows)


@query("parse_number", op.with_(op.TAB) + """
SELECT table_id, row_index, col_index, try_cast(nullif(regexp_extract(replace(value, ',', ''), '-?[0-9]+(\\.[0-9]+)?'), '') AS DOUBLE) AS number FROM tab_cells""")
def parse_number(spark, sf_dir):
    headers, rows = _tables(spark, sf_dir)
    return extract.cells_of(rows, headers).select("table_id", "row_index", "col_index", tx.parse_number(F.col("value")).alias("number"))


@query("display_number", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN abs(x - round(x)) < 1e-9 THEN format('{:,.0f}', x) ELSE format('{:,.2f}', x) END AS shown
FROM (SELECT *, l_extendedprice * 100 AS x FROM lineitem)
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN abs(x - round(x)) < 1e-9 THEN format('{:,.0f}', x) ELSE format('{:,.2f}', x) END
FROM (SELECT *, l_extendedprice AS x FROM lineitem)""")
def display_number(spark, sf_dir):
    li = corpora.read(spark, sf_dir, "lineitem")
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    cents = li.select(*keys, tx.display_number(F.col("l_extendedprice") * 100).alias("shown"))
    return cents.unionByName(li.select(*keys, tx.display_number(F.col("l_extendedprice")).alias("shown")))


# --- answers ---------------------------------------------------------------------------------

ANSWER = op.with_(op.INV)


def _answers(spark, sf_dir):
    """An itemized answer per order whose stated total is the order total, right or wrong."""
    inv = corpora.invoices(spark, sf_dir)
    amounts = F.regexp_extract_all("text", F.lit(r"Rs\.([0-9.]+)"), F.lit(1))
    return inv.select("document_id", F.concat(
        F.lit("The Total for invoice "), F.col("document_id").cast("string"), F.lit(" is Rs."), F.get(amounts, F.lit(2)), F.lit(".\n\n* **goods** — "),
        F.get(amounts, F.lit(0)), F.lit(" [invoice_"), F.col("document_id").cast("string"), F.lit("]\n- fee: INR "), F.get(amounts, F.lit(1)), F.lit(" or 1.00")).alias("answer"))


@query("money_amounts", ANSWER + """
SELECT document_id, 0 AS line_no, CAST(total AS DOUBLE) AS value FROM inv UNION ALL SELECT document_id, 2, CAST(retail AS DOUBLE) FROM inv
UNION ALL SELECT document_id, 3, 25.0 FROM inv UNION ALL SELECT document_id, 3, 1.0 FROM inv""")
def money_amounts(spark, sf_dir):
    lines = _answers(spark, sf_dir).select("document_id", F.posexplode(tx.text_lines(F.col("answer"))).alias("line_no", "line"))
    return lines.select("document_id", "line_no", F.explode(answers.money_amounts(F.col("line"))).alias("m")).select("document_id", "line_no", "m.value")


@query("total_audit", ANSWER + """
SELECT document_id, 'The Total for invoice ' || document_id || ' is Rs.' ||
  CASE WHEN abs(CAST(total AS DOUBLE) - (CAST(retail AS DOUBLE) + 25)) >= 0.01 THEN format('{:,.2f}', round(CAST(retail AS DOUBLE) + 25, 2)) ELSE total END ||
  '.' || chr(10) || chr(10) || '* **goods** — ' || retail || ' [invoice_' || document_id || ']' || chr(10) || '- fee: INR 25.00 or 1.00' AS answer FROM inv""")
def total_audit(spark, sf_dir):
    return _answers(spark, sf_dir).select("document_id", answers.total_audit(F.col("answer")).alias("answer"))


KW = op.with_(CHUNKS, TOKENS, QTERMS)


def _keyword_hits(spark, sf_dir):
    """The ten best keyword hits per passage with their document columns and text."""
    chunks, docs = doc_chunks(spark, sf_dir), corpora.doc_texts(spark, sf_dir)
    index = keyword.build_index(chunks, stem=False)
    page = materialize(keyword.bm25_search(corpora.passages(spark, sf_dir), index, limit=10), "page")
    asked = page.select("document_id").distinct()  # only the documents of the page are cut again
    chunks = chunk_prose(docs.join(broadcast_if_small(asked), "document_id", "left_semi"))
    return chunks.select("chunk_id", "text", "location").join(broadcast_if_small(page), "chunk_id").join(
        docs.select("document_id", F.col("title").alias("document_title")), "document_id")


@query("citations", KW + """
SELECT query_id, document_id, title AS document_title, min(rnk) AS rnk FROM kw JOIN (SELECT chunk_id, title FROM chunks) USING (chunk_id) WHERE rnk <= 10 GROUP BY ALL""")
def citations(spark, sf_dir):
    return answers.citations(_keyword_hits(spark, sf_dir)).drop("location")


@query("excerpt_bundle", KW + """
SELECT query_id, string_agg('[' || title || ']' || chr(10) || CASE WHEN length(text) <= 1200 THEN text ELSE substr(text, 1, 1200) || '…' END, chr(10) || chr(10) ORDER BY rnk) AS excerpts
FROM kw JOIN (SELECT chunk_id, title, text FROM chunks) USING (chunk_id) WHERE rnk <= 10 GROUP BY query_id""")
def excerpt_bundle(spark, sf_dir):
    return answers.excerpt_bundle(_keyword_hits(spark, sf_dir))


CONTEXT_QST = """
qst AS (SELECT item_id AS query_id, text AS q FROM benchmark
        UNION ALL SELECT min(c_custkey) + 1000000, 'How many customer rows are in the ' || c_mktsegment || ' segment?' FROM customer GROUP BY c_mktsegment),
asked AS (SELECT query_id AS item_id, q AS text FROM qst)"""
_ASKED = [part.replace("FROM benchmark", "FROM asked") for part in (QTERMS, HYB)]


@query("question_context", op.with_(*op.LIBRARY, CONTEXT_QST, FACTS, FACT_ROWS, SUMMARY, CHUNKS, TOKENS, *_ASKED) + f""",
sl AS (SELECT array_to_string(kinds, ',') AS kinds, 0 AS pos, header AS line FROM ks, hd
       UNION ALL SELECT array_to_string(kinds, ','), pos, line FROM kept JOIN od USING (kinds, pos)
       UNION ALL SELECT array_to_string(kinds, ','), 2147483647, '(+' || (total - len(f.ids)) || ' more document(s) omitted to fit the size limit)' FROM fold, hd WHERE total > len(f.ids)),
sm AS (SELECT kinds, string_agg(line, chr(10) ORDER BY pos) AS summary FROM sl GROUP BY kinds),
fb AS (SELECT question, 'TABLE FACTS (computed in code over the COMPLETE table — authoritative, use these exact numbers verbatim; never recompute from the excerpts):' || chr(10)
         || string_agg('- ' || fact, chr(10) ORDER BY pos) AS facts FROM fr WHERE pos <= 3 GROUP BY question),
ex AS (SELECT query_id, string_agg('[' || title || ']' || chr(10) || CASE WHEN length(text) <= 1200 THEN text ELSE substr(text, 1, 1200) || '…' END, chr(10) || chr(10) ORDER BY rnk) AS excerpts
       FROM hyb JOIN (SELECT chunk_id, title, text FROM chunks) USING (chunk_id) WHERE rnk <= 10 GROUP BY query_id),
fl AS (SELECT query_id, lower(q) AS question, {_any(PAD, fv.AGGREGATE_CUES)} AS wide, array_to_string({TARGETS}, ',') AS kinds FROM qst),
al AS (SELECT fl.*, facts, excerpts, concat_ws(chr(10) || chr(10), CASE WHEN wide THEN summary END, facts) AS extra
       FROM fl LEFT JOIN sm USING (kinds) LEFT JOIN fb USING (question) LEFT JOIN ex USING (query_id))
SELECT query_id, wide OR facts IS NOT NULL AS aggregate, extra, coalesce(excerpts, '') AS excerpts, excerpts IS NOT NULL OR extra <> '' AS found FROM al""")
def question_context(spark, sf_dir):
    """Passages as open questions plus one computable question per market segment."""
    segments = corpora.read(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.min("c_custkey").alias("k")).select(
        (F.col("k") + 1_000_000).alias("query_id"), F.concat(F.lit("How many customer rows are in the "), "c_mktsegment", F.lit(" segment?")).alias("q"))
    queries = corpora.passages(spark, sf_dir).unionByName(segments)
    docs, fields, _, _ = library(spark, sf_dir)
    headers, rows = _tables(spark, sf_dir)
    return answers.question_context(queries, search_index(spark, sf_dir), docs, fields, headers, rows)


# --- evaluation --------------------------------------------------------------------------------

JUDGED = """
jud AS (SELECT item_id AS query_id, doc_id AS document_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"""


def judgements(spark, sf_dir):
    """(query_id, document_id): documents that hold a passage word for word.

    Passages of three words or more are asked for once under an id, and only of documents that have one.
    """
    passages = corpora.passages(spark, sf_dir).filter("q is not null")
    worded = F.size(tx.words(F.col("q"))) > 2
    docs = corpora.doc_texts(spark, sf_dir).select("document_id", "text")
    held = evaluation.holders(docs.filter("document_id is not null"), passages.filter(worded).distinct())
    short = passages.filter(~worded)
    return held if short.isEmpty() else held.unionByName(evaluation.holders(docs, short))


def _runs(spark, sf_dir, modes=("keyword", "semantic", "hybrid")):
    """The ten best chunks per passage and mode, over legs computed once."""
    index, queries = search_index(spark, sf_dir), corpora.passages(spark, sf_dir)
    runs = hybrid.ranked_modes(queries, index, list(modes), limit=10)
    return {m: run.withColumn("document_id", parent_id("chunk_id")) for m, run in runs.items()}


EV = op.with_(CHUNKS, TOKENS, QTERMS, HYB, JUDGED) + """,
runs AS (SELECT 'keyword' AS mode, query_id, rnk, chunk_id // 1048576 AS document_id FROM kw WHERE rnk <= 10
  UNION ALL SELECT 'semantic', query_id, rnk, chunk_id // 1048576 FROM sem WHERE rnk <= 10
  UNION ALL SELECT 'hybrid', query_id, rnk, chunk_id // 1048576 FROM hyb WHERE rnk <= 10),
qs AS (SELECT item_id AS query_id, mode FROM benchmark, (VALUES ('keyword'), ('semantic'), ('hybrid')) AS m(mode)),
rel AS (SELECT query_id, count(DISTINCT document_id) AS n FROM jud GROUP BY query_id),
ok AS (SELECT mode, query_id, count(DISTINCT document_id) AS found, min(rnk) AS first FROM runs SEMI JOIN jud USING (query_id, document_id) GROUP BY ALL),
ev AS (SELECT mode, qs.query_id, CASE WHEN coalesce(n, 0) = 0 THEN 0.0 ELSE coalesce(found, 0) / CAST(n AS DOUBLE) END AS recall, coalesce(1.0 / first, 0.0) AS rr
       FROM qs LEFT JOIN rel USING (query_id) LEFT JOIN ok USING (mode, query_id))"""


@query("judgements", op.with_(JUDGED) + "SELECT query_id, document_id FROM jud")
def judged(spark, sf_dir):
    return judgements(spark, sf_dir)


@query("recall_at_k", EV + "SELECT query_id, round(recall, 6) AS recall FROM ev WHERE mode = 'keyword'")
def recall_at_k(spark, sf_dir):
    run = _runs(spark, sf_dir, ["keyword"])["keyword"]
    return evaluation.recall_at_k(corpora.passages(spark, sf_dir), run, judgements(spark, sf_dir)).withColumn("recall", F.round("recall", 6))


@query("mrr", EV + "SELECT query_id, round(rr, 6) AS rr FROM ev WHERE mode = 'hybrid'")
def mrr(spark, sf_dir):
    run = _runs(spark, sf_dir, ["hybrid"])["hybrid"]
    return evaluation.reciprocal_rank(corpora.passages(spark, sf_dir), run, judgements(spark, sf_dir)).withColumn("rr", F.round("rr", 6))


@query("eval_by_mode", EV + "SELECT mode, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS mrr FROM ev GROUP BY mode")
def eval_by_mode(spark, sf_dir):
    judged = materialize(judgements(spark, sf_dir), "judgements")
    out = evaluation.by_mode(corpora.passages(spark, sf_dir), _runs(spark, sf_dir), judged)
    return out.select("mode", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"))
