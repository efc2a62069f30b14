"""Shared pieces of the check SQL: the derived corpora, stated from the table columns.

The invoice fields are written down from the order, customer and part columns, so they do
not depend on the extraction rules they are compared with.
"""

from quirefold.functions import fixed_values as fv
from quirefold.functions import stem

SP = fv.SPACE_CLASS + "+"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SP}|{SP}$', '', 'g')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{SP}'), lambda w: w <> '')"


def in_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def tokens(x: str) -> str:
    return (
        f"list_filter(regexp_split_to_array(strip_accents(lower({x})), '[^\\p{{L}}\\p{{N}}\\p{{Co}}]+'), "
        "lambda t: t <> '')"
    )


INV = """
inv AS (
  SELECT o_orderkey AS document_id, 'invoice_' || o_orderkey AS title, 'txt' AS file_type,
         CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'ready' END AS status,
         o_orderkey, o_custkey, o_orderstatus, o_orderpriority, c_name, n_name, p_name,
         (o_orderkey % 9 + 1) AS qty,
         CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) AS retail,
         CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS total,
         strftime(o_orderdate, '%Y-%m-%d') AS odate,
         lpad(CAST(o_custkey % 100000 AS VARCHAR), 5, '0') AS cust5
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN part ON o_custkey = p_partkey)"""

INV_TEXT = """
inv_text AS (
  SELECT *, 'INVOICE #INV-' || o_orderkey || chr(10) || 'Vendor: ' || n_name || ' Trading' || chr(10)
    || 'Bill to: ' || c_name || chr(10) || 'Invoice date: ' || odate || chr(10) || 'Status: ' || o_orderstatus || chr(10)
    || 'Priority: ' || o_orderpriority || chr(10) || 'Line items: ' || p_name || ' x' || qty || ' Rs.' || retail
    || ' handling fee x1 Rs.25.00' || chr(10) || 'Total Rs.' || total || chr(10)
    || 'Pay at https://pay.example.com/inv/' || o_orderkey || chr(10)
    || 'Contact: billing' || o_custkey || '@example.com | +91 90000 ' || cust5 AS text
  FROM inv)"""

INV_FIELDS = """
inv_raw AS (
  SELECT document_id, 1 AS rule_no, 0 AS pos, 'email' AS key, 'billing' || o_custkey || '@example.com' AS value, 'email' AS kind FROM inv
  UNION ALL SELECT document_id, 2, 0, 'url', 'https://pay.example.com/inv/' || o_orderkey, 'url' FROM inv
  UNION ALL SELECT document_id, 3, 0, 'amount', 'Rs.' || retail, 'amount' FROM inv
  UNION ALL SELECT document_id, 3, 1, 'amount', 'Rs.25.00', 'amount' FROM inv
  UNION ALL SELECT document_id, 3, 2, 'amount', 'Rs.' || total, 'amount' FROM inv
  UNION ALL SELECT document_id, 4, 0, 'date', odate, 'date' FROM inv
  UNION ALL SELECT document_id, 5, 0, 'phone', '+91 90000 ' || cust5, 'phone' FROM inv
  UNION ALL SELECT document_id, 6, 0, p_name, '×' || qty || ' · Rs.' || retail, 'item' FROM inv
  UNION ALL SELECT document_id, 6, 1, 'handling fee', '×1 · Rs.25.00', 'item' FROM inv
  UNION ALL SELECT document_id, 7, 0, 'Vendor', n_name || ' Trading', 'pair' FROM inv
  UNION ALL SELECT document_id, 7, 1, 'Bill to', c_name, 'pair' FROM inv
  UNION ALL SELECT document_id, 7, 2, 'Status', o_orderstatus, 'pair' FROM inv
  UNION ALL SELECT document_id, 7, 3, 'Priority', o_orderpriority, 'pair' FROM inv
  UNION ALL SELECT document_id, 7, 4, 'Line items', p_name || ' x' || qty || ' Rs.' || retail || ' handling fee x1 Rs.25.00', 'pair' FROM inv),
inv_first AS (
  SELECT *, row_number() OVER (PARTITION BY document_id, kind, CASE WHEN kind IN ('pair','item') THEN lower(key) ELSE '' END, lower(value)
                               ORDER BY rule_no, pos) AS dup
  FROM inv_raw WHERE kind <> 'pair' OR length(value) <= 120),
inv_fields AS (
  SELECT document_id * 1048576 + row_number() OVER (PARTITION BY document_id ORDER BY rule_no, pos) - 1 AS field_id,
         document_id, key, value, kind
  FROM inv_first WHERE dup = 1)"""

CAT = """
cat AS (
  SELECT d.doc_id AS document_id, source || '_' || d.doc_id AS title, source || '_' || d.doc_id || '.txt' AS filename,
         lang AS file_type, n_chars AS size,
         CASE WHEN coalesce(q.quality = 0, false) THEN 'failed' ELSE 'ready' END AS status,
         CASE WHEN coalesce(q.quality = 0, false) THEN 'rejected by label' END AS error,
         '2024-' || lpad(CAST(d.doc_id % 12 + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST(d.doc_id % 28 + 1 AS VARCHAR), 2, '0') || 'T00:00:00Z' AS uploaded_at,
         text
  FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id) q ON d.doc_id = q.doc_id)"""

TAB = """
tab_rows AS (
  SELECT 1 AS table_id, CAST(c_custkey AS INT) AS row_index, [CAST(c_custkey AS VARCHAR), c_name, CAST(c_nationkey AS VARCHAR), CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR), c_mktsegment] AS cells FROM customer
  UNION ALL SELECT 2, CAST(o_orderkey AS INT), [CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), strftime(o_orderdate, '%Y-%m-%d'), o_orderpriority] FROM orders
  UNION ALL SELECT 3, CAST(p_partkey AS INT), [CAST(p_partkey AS VARCHAR), p_name, p_brand, p_type, CAST(p_size AS VARCHAR), CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR)] FROM part
  UNION ALL SELECT 4, CAST(n_nationkey AS INT), [CAST(n_nationkey AS VARCHAR), n_name, CAST(n_regionkey AS VARCHAR)] FROM nation),
tab_names AS (
  SELECT * FROM (VALUES
    (1, 'customer', ['custkey','name','nationkey','acctbal','mktsegment']),
    (2, 'orders', ['orderkey','custkey','orderstatus','totalprice','orderdate','orderpriority']),
    (3, 'part', ['partkey','name','brand','type','size','retailprice']),
    (4, 'nation', ['nationkey','name','regionkey'])) AS v(table_id, name, col_names)),
tab_cells AS (
  SELECT r.table_id, r.row_index, i - 1 AS col_index, n.col_names[i] AS col_name, r.cells[i] AS value
  FROM (SELECT *, unnest(range(1, len(cells) + 1)) AS i FROM tab_rows) r JOIN tab_names n USING (table_id))"""

LIB_DOCS = """
lib_docs AS (
  SELECT document_id, title, file_type, status, CASE WHEN status = 'failed' THEN 'no extractable text' END AS error, length(text) AS size FROM inv_text
  UNION ALL SELECT 1000000000000 + table_id, name || '_table', 'csv', 'ready', NULL, 0 FROM tab_names)"""

LIB_TABLES = """
lib_tables AS (
  SELECT n.table_id, 1000000000000 + n.table_id AS document_id, n.name, count(r.table_id) AS row_count
  FROM tab_names n LEFT JOIN tab_rows r USING (table_id) GROUP BY n.table_id, n.name)"""

QST = """
qst AS (
  SELECT c_custkey * 2 AS query_id,
    CASE c_custkey % 8
      WHEN 0 THEN 'How many customer rows are in the ' || c_mktsegment || ' segment?'
      WHEN 1 THEN 'what is the average acctbal of ' || c_name
      WHEN 2 THEN 'what is the total value of all orders?'
      WHEN 3 THEN 'total retailprice of part for each ' || c_mktsegment
      WHEN 4 THEN 'list all vendors and their email'
      WHEN 5 THEN 'sum of totalprice, who is ' || c_name
      WHEN 6 THEN 'average size of economy part'
      ELSE 'What is the due date and amount for ' || c_name || '?' END AS q
  FROM customer
  UNION ALL SELECT (conv_id * 1048576 + turn) * 2 + 1, text FROM conversations WHERE role = 'user')"""


def with_(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",".join(parts)


LIBRARY = (INV, INV_TEXT, INV_FIELDS, TAB, LIB_DOCS, LIB_TABLES)


# --- Porter stems, stated with the usual regular expressions for consonant and vowel runs -----------

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"


def _runs(w: str, pattern: str) -> str:
    return f"regexp_matches({w}, '^({_C})?{pattern}')"


def _m0(w):
    return _runs(w, _V + _C)


def _m1(w):
    return _runs(w, f"{_V}{_C}({_V})?$")


def _m2(w):
    return _runs(w, _V + _C + _V + _C)


def _vowel(w):
    return _runs(w, "[aeiouy]")


def _short(w):
    return f"regexp_matches({w}, '^{_C}[aeiouy][^aeiouwxy]$')"


def _cut(w, n):
    return f"left({w}, length({w}) - {n})"


def _suffixes(table) -> str:
    ordered = sorted(table, key=lambda p: -len(p[0]))
    arms = [f"WHEN ends_with(w, '{a}') THEN CASE WHEN {_m0(_cut('w', len(a)))} THEN {_cut('w', len(a))} || '{b}' ELSE w END" for a, b in ordered]
    return "CASE " + " ".join(arms) + " ELSE w END"


def _last_suffix(suffixes) -> str:
    arms = []
    for a in suffixes:
        base = _cut("w", len(a))
        extra = f" AND (ends_with({base}, 's') OR ends_with({base}, 't'))" if a == "ion" else ""
        arms.append(f"WHEN ends_with(w, '{a}') THEN CASE WHEN {_m2(base)}{extra} THEN {base} ELSE w END")
    return "CASE " + " ".join(arms) + " ELSE w END"


def stems(lex: str) -> str:
    """CTE ``stm(term, s)`` for the distinct tokens of the relation ``lex(term)``. A leading y is a consonant, so it is kept apart as Y."""
    w1 = _cut("w", 1)
    steps = [
        "CASE WHEN starts_with(term, 'y') THEN 'Y' || substr(term, 2) ELSE term END",
        f"CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN {_cut('w', 2)} WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN {w1} ELSE w END",
        f"CASE WHEN ends_with(w, 'eed') THEN CASE WHEN {_m0(_cut('w', 3))} THEN {w1} ELSE w END"
        f" WHEN ends_with(w, 'ed') AND {_vowel(_cut('w', 2))} THEN '#' || {_cut('w', 2)}"
        f" WHEN ends_with(w, 'ing') AND {_vowel(_cut('w', 3))} THEN '#' || {_cut('w', 3)} ELSE w END",
        "CASE WHEN NOT starts_with(w, '#') THEN w WHEN regexp_matches(w, '(at|bl|iz)$') THEN substr(w, 2) || 'e'"
        f" WHEN length(w) > 2 AND right(w, 1) = left(right(w, 2), 1) AND NOT regexp_matches(w, '[aeioulsz]$') THEN substr({w1}, 2)"
        f" WHEN {_m1('substr(w, 2)')} AND {_short('substr(w, 2)')} THEN substr(w, 2) || 'e' ELSE substr(w, 2) END",
        f"CASE WHEN ends_with(w, 'y') AND {_vowel(w1)} THEN {w1} || 'i' ELSE w END",
        _suffixes(stem._STEP2), _suffixes(stem._STEP3), _last_suffix(stem._STEP4),
        f"CASE WHEN ends_with(w, 'e') AND ({_m2(w1)} OR ({_m1(w1)} AND NOT {_short(w1)})) THEN {w1} ELSE w END",
        f"CASE WHEN ends_with(w, 'll') AND {_m2('w')} THEN {w1} ELSE w END",
    ]
    inner = f"(SELECT term, term AS w FROM {lex})"
    for step in steps:
        inner = f"(SELECT term, {step} AS w FROM {inner})"
    return f"stm AS (SELECT term, CASE WHEN length(term) BETWEEN 3 AND 64 THEN replace(w, 'Y', 'y') ELSE term END AS s FROM {inner})"
