"""Extraction, chunking, vector, keyword and hybrid search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirefold.functions import fixed_values as fv
from quirefold.functions import text as tx
from quirefold.operators import admission, blockmax, chunk, extract, hybrid, keyword, pivots, ranking, segments, vectors
from quirefold.plans import corpora
from quirefold.plans import oracle_parts as op
from quirefold.plans.registry import query

I = op.with_(op.INV, op.INV_TEXT, op.INV_FIELDS)  # noqa: E741


def _kind(name, values_sql):
    """Register one typed rule over the invoices."""
    @query(f"extract_{name}", op.with_(op.INV) + values_sql)
    def run(spark, sf_dir):
        return extract.extract_kind(corpora.invoices(spark, sf_dir), name)
    return run


@query("extract_email", r"""
SELECT document_id, pos - 1 AS pos, m[pos] AS value FROM (SELECT doc_id AS document_id, m, unnest(range(1, len(m) + 1)) AS pos FROM
  (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}') AS m FROM documents))""")
def extract_email(spark, sf_dir):
    return extract.extract_kind(corpora.doc_texts(spark, sf_dir), "email")


@query("extract_url", r"""
SELECT document_id, pos - 1 AS pos, m[pos] AS value FROM (SELECT page_id AS document_id, m, unnest(range(1, len(m) + 1)) AS pos FROM
  (SELECT page_id, regexp_extract_all(url, 'https?://[^\s)>\]]+') AS m FROM pages))""")
def extract_url(spark, sf_dir):
    return extract.extract_kind(corpora.read(spark, sf_dir, "pages").select(F.col("page_id").alias("document_id"), F.col("url").alias("text")), "url")


_kind("amount", """
SELECT document_id, 0 AS pos, 'Rs.' || retail AS value FROM inv UNION ALL SELECT document_id, 1, 'Rs.25.00' FROM inv
UNION ALL SELECT document_id, 2, 'Rs.' || total FROM inv""")
_kind("date", "SELECT document_id, 0 AS pos, odate AS value FROM inv")
_kind("phone", "SELECT document_id, 0 AS pos, '+91 90000 ' || cust5 AS value FROM inv")


@query("extract_items", op.with_(op.INV) + """
SELECT document_id, 0 AS pos, p_name AS key, '×' || qty || ' · Rs.' || retail AS value FROM inv
UNION ALL SELECT document_id, 1, 'handling fee', '×1 · Rs.25.00' FROM inv""")
def extract_items(spark, sf_dir):
    inv = corpora.invoices(spark, sf_dir)
    return inv.select("document_id", F.posexplode(extract.item_matches(F.col("text"))).alias("pos", "f")).select("document_id", "pos", "f.key", "f.value")


@query("extract_pairs", op.with_(op.INV) + """
SELECT document_id, unnest(['Vendor', 'Bill to', 'Invoice date', 'Status', 'Priority', 'Line items', 'Pay at https', 'Contact']) AS key,
  unnest([n_name || ' Trading', c_name, odate, o_orderstatus, o_orderpriority, p_name || ' x' || qty || ' Rs.' || retail || ' handling fee x1 Rs.25.00',
          '//pay.example.com/inv/' || o_orderkey, 'billing' || o_custkey || '@example.com | +91 90000 ' || cust5]) AS value FROM inv""")
def extract_pairs(spark, sf_dir):
    inv = corpora.invoices(spark, sf_dir)
    return inv.select("document_id", F.explode(extract.raw_pairs(F.col("text"))).alias("f")).select("document_id", "f.key", "f.value")


@query("pair_noise_guard", op.with_(op.INV) + """
SELECT document_id, unnest(['Vendor', 'Bill to', 'Invoice date', 'Status', 'Priority', 'Line items', 'Pay at https']) AS key FROM inv""")
def pair_noise_guard(spark, sf_dir):
    inv = corpora.invoices(spark, sf_dir)
    kept = F.filter(extract.raw_pairs(F.col("text")), lambda p: extract.readable_pair(p["key"], tx.strip(p["value"])))
    return inv.select("document_id", F.explode(kept).alias("f")).select("document_id", "f.key")


@query("field_dedup", I + "SELECT field_id, document_id, key, value, kind FROM inv_fields")
def field_dedup(spark, sf_dir):
    return extract.extract_fields(corpora.invoices(spark, sf_dir))


@query("pair_suppress", op.with_(op.INV) + """
SELECT document_id, unnest(['Vendor', 'Bill to', 'Status', 'Priority', 'Line items']) AS key,
  unnest([n_name || ' Trading', c_name, o_orderstatus, o_orderpriority, p_name || ' x' || qty || ' Rs.' || retail || ' handling fee x1 Rs.25.00']) AS value FROM inv""")
def pair_suppress(spark, sf_dir):
    inv = corpora.invoices(spark, sf_dir)
    text = F.col("text")
    typed = F.concat(*[F.transform(extract.typed_matches(text, k, p), lambda f: F.lower(f["value"])) for k, p in fv.FIELD_RULES])
    pairs = tx.let(typed, lambda seen: extract.pair_matches(text, seen))
    return inv.select("document_id", F.explode(pairs).alias("f")).select("document_id", "f.key", "f.value")


# --- chunks -----------------------------------------------------------------------------------

_TITLE = "source || '_' || doc_id"
CHUNKS = f"""
w AS (SELECT doc_id AS document_id, {_TITLE} AS title, lang AS file_type, {op.words('text')} AS ws,
             greatest(CAST(ceil(5 * (450 - (8 * len({op.words(f"'[' || {_TITLE} || ']'")}) // 5 + 1)) / 8.0) AS INT) - 1, 1) AS win FROM documents),
p AS (SELECT *, unnest(range(0, CASE WHEN len(ws) = 0 THEN 0 ELSE 1 + greatest(CAST(ceil((len(ws) - win) / CAST(greatest(win - 40, 1) AS DOUBLE)) AS INT), 0) END)) AS i FROM w),
chunks AS (SELECT document_id * 1048576 + i AS chunk_id, document_id, i AS seq, title, file_type,
             array_to_string(ws[i * greatest(win - 40, 1) + 1 : i * greatest(win - 40, 1) + win], ' ') AS text FROM p),
embedded AS (SELECT *, '[' || title || ']' || chr(10) || text AS embed_text FROM chunks)"""


def doc_chunks(spark, sf_dir):
    return chunk.chunk_prose(corpora.doc_texts(spark, sf_dir))


@query("token_estimate", f"SELECT doc_id AS document_id, CAST(8 * len({op.words('text')}) // 5 + 1 AS INT) AS n_tokens FROM documents")
def token_estimate(spark, sf_dir):
    return corpora.doc_texts(spark, sf_dir).select("document_id", tx.token_estimate(F.col("text")).alias("n_tokens"))


@query("context_header", """SELECT doc_id AS document_id,
  CASE WHEN doc_id % 2 = 0 THEN '[' || source || '_' || doc_id || ' — ' || lang || ']' ELSE '[' || source || '_' || doc_id || ']' END || chr(10) AS header FROM documents""")
def context_header(spark, sf_dir):
    heading = F.when(F.col("document_id") % 2 == 0, F.col("file_type")).otherwise("")
    return corpora.doc_texts(spark, sf_dir).select("document_id", chunk.context_header(F.col("title"), heading).alias("header"))


@query("chunk_prose", op.with_(CHUNKS) + "SELECT chunk_id, document_id, seq, text, embed_text FROM embedded")
def chunk_prose(spark, sf_dir):
    return doc_chunks(spark, sf_dir).drop("location")


PACK_SQL = f"""
blk AS (SELECT doc_id AS document_id, {_TITLE} AS title, regexp_split_to_array(regexp_replace(text, '\\n$', ''), '\\n') AS ls FROM documents),
cnt AS (SELECT document_id, title, ls, list_transform(ls, lambda x: len({op.words('x')})) AS ns,
               len({op.words("'[' || title || ']' || chr(10) || ls[1]")}) AS base FROM blk WHERE len(ls) > 1),
fold AS (SELECT document_id, title, ls, list_reduce(list_transform(range(2, len(ls) + 1), lambda i: {{'at': i, 'used': ns[i], 'starts': [i]}}),
               lambda a, x: CASE WHEN 8 * (base + a.used + x.used) // 5 + 1 > 450
                                 THEN {{'at': x.at, 'used': x.used, 'starts': list_concat(a.starts, [x.at])}}
                                 ELSE {{'at': x.at, 'used': a.used + x.used, 'starts': a.starts}} END) AS f FROM cnt),
runs AS (SELECT document_id, title, ls, f.starts AS starts, unnest(range(1, len(f.starts) + 1)) AS j FROM fold)
SELECT document_id * 1048576 + j - 1 AS chunk_id, document_id, j - 1 AS seq,
       ls[1] || chr(10) || array_to_string(ls[starts[j] : CASE WHEN j < len(starts) THEN starts[j + 1] - 1 ELSE len(ls) END], chr(10)) AS text FROM runs"""


@query("chunk_table_rows", "WITH " + PACK_SQL)
def chunk_table_rows(spark, sf_dir):
    null = F.lit(None).cast("string")
    docs = corpora.doc_texts(spark, sf_dir).select("document_id", "title", F.array(F.struct(
        F.col("text"), F.lit("table").alias("kind"), F.lit("rows").alias("location"), null.alias("heading"))).alias("blocks"))
    return chunk.chunk_documents(docs).select("chunk_id", "document_id", "seq", "text")


COUNTED = 100


@query("chunk_counted", op.with_(f"""
w AS (SELECT doc_id AS document_id, {_TITLE} AS title, {op.words('text')} AS ws, greatest({COUNTED} - len({op.words(f"'[' || {_TITLE} || ']'")}), 1) AS win FROM documents),
p AS (SELECT *, unnest(range(0, CASE WHEN len(ws) = 0 THEN 0 ELSE 1 + greatest(CAST(ceil((len(ws) - win) / CAST(greatest(win - 40, 1) AS DOUBLE)) AS INT), 0) END)) AS i FROM w)""") + """
SELECT document_id * 1048576 + i AS chunk_id, document_id, i AS seq, array_to_string(ws[i * greatest(win - 40, 1) + 1 : i * greatest(win - 40, 1) + win], ' ') AS text FROM p""")
def chunk_counted(spark, sf_dir):
    """Whole documents cut under a counter that is called with every piece, here one that counts words."""
    null = F.lit(None).cast("string")
    docs = corpora.doc_texts(spark, sf_dir).select("document_id", "title", F.array(F.struct(
        F.col("text"), F.lit("prose").alias("kind"), null.alias("location"), null.alias("heading"))).alias("blocks"))
    return chunk.chunk_documents(docs, max_tokens=COUNTED, count=lambda t: len(t.split())).select("chunk_id", "document_id", "seq", "text")


@query("empty_doc_reject", f"""SELECT doc_id AS document_id, 'failed' AS status, 'no extractable text' AS error FROM documents
WHERE {op.strip('text')} = '' OR doc_id % 3 = 0""")
def empty_doc_reject(spark, sf_dir):
    """All documents with their whole texts; in every third one each character that is no blank is made one."""
    blank = F.regexp_replace("text", r"\S", "\u3000")
    docs = corpora.doc_texts(spark, sf_dir).withColumn("text", F.when(F.col("document_id") % 3 == 0, blank).otherwise(F.col("text")))
    return chunk.without_chunks(docs.select("document_id"), chunk.chunk_prose(docs))


# --- embeddings and vectors ----------------------------------------------------------------

def hash_sql(x: str, dim: int) -> str:
    raw = f"list_transform(range(0, {dim}), lambda i: CAST(CAST('0x' || substr(sha256({x}), CAST((i % 32) * 2 + 1 AS INT), 2) AS INT) AS DOUBLE) / 255.0)"
    return raw


@query("hash_embed", op.with_(CHUNKS) + f""",
r AS (SELECT chunk_id, {hash_sql('embed_text', 8)} AS v FROM embedded),
n AS (SELECT chunk_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS len FROM r)
SELECT chunk_id, array_to_string(list_transform(v, lambda x: CAST(round(x / len, 6) AS DECIMAL(9,6))), ' ') AS vec FROM n""")
def hash_embed(spark, sf_dir):
    vecs = vectors.embed_passages(doc_chunks(spark, sf_dir), 8)
    return vecs.select("chunk_id", F.array_join(F.transform("embedding", lambda x: F.round(x, 6).cast("decimal(9,6)").cast("string")), " ").alias("vec"))


VEC = "vec AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"


def _vectors(spark, sf_dir):
    return corpora.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


@query("knn_topk", op.with_(VEC) + """
SELECT vec_id AS chunk_id, round(list_cosine_similarity(v, (SELECT v FROM vec WHERE vec_id = 3)), 6) AS score FROM vec
ORDER BY round(list_cosine_similarity(v, (SELECT v FROM vec WHERE vec_id = 3)), 9) DESC, vec_id LIMIT 50""")
def knn_topk(spark, sf_dir):
    vecs = _vectors(spark, sf_dir)
    probe = vecs.filter("chunk_id = 3").first()["embedding"]
    return vectors.knn_one(vecs, probe, 50).select("chunk_id", F.round("score", 6).alias("score"))


KNN_SQL = """
sc AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, list_cosine_similarity(a.v, b.v) AS score FROM vec a, vec b),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rnk FROM sc)"""


@query("knn_batch", op.with_(VEC, KNN_SQL) + "SELECT query_id, CAST(rnk AS INT) AS rnk, chunk_id, round(score, 6) AS score FROM rk WHERE rnk <= 10")
def knn_batch(spark, sf_dir):
    vecs = _vectors(spark, sf_dir)
    probes = vecs.select(F.col("chunk_id").alias("query_id"), "embedding")
    return vectors.knn_batch(probes, vecs, 10).withColumn("score", F.round("score", 6))


@query("pivot_knn", op.with_(VEC, KNN_SQL) + "SELECT query_id, CAST(rnk AS INT) AS rnk, chunk_id, round(score, 6) AS score FROM rk WHERE rnk <= 10")
def pivot_knn(spark, sf_dir):
    """The ten nearest vectors of every vector, without the blocks that their pivots rule out."""
    vecs = _vectors(spark, sf_dir)
    found = pivots.search(vecs.select(F.col("chunk_id").alias("query_id"), "embedding"), pivots.build(vecs), 10)
    return found.hits.withColumn("score", F.round("score", 6))


@query("knn_postfilter", op.with_(VEC, KNN_SQL) + """
SELECT query_id, chunk_id, label, round(score, 6) AS score FROM rk JOIN embeddings e ON e.vec_id = chunk_id WHERE rnk <= 100 AND label = 1""")
def knn_postfilter(spark, sf_dir):
    vecs = _vectors(spark, sf_dir)
    probes = vecs.select(F.col("chunk_id").alias("query_id"), "embedding")
    near = vectors.knn_batch(probes, vecs, fv.LEG_DEPTH)
    return near.join(vecs.filter("label = 1").select("chunk_id", "label"), "chunk_id").select("query_id", "chunk_id", "label", F.round("score", 6).alias("score"))


@query("vector_upsert", """
SELECT vec_id + extra AS chunk_id, i - 1 AS place, round(CASE WHEN label = 0 THEN -embedding[i] ELSE embedding[i] END, 6) AS value
FROM (SELECT vec_id, label, embedding, extra, unnest(range(1, len(embedding) + 1)) AS i
      FROM (SELECT *, 0 AS extra FROM embeddings UNION ALL SELECT *, 1000000 FROM embeddings WHERE label = 2))""")
def vector_upsert(spark, sf_dir):
    vecs = _vectors(spark, sf_dir)
    flipped = vecs.filter("label = 0").select("chunk_id", F.transform("embedding", lambda x: -x).alias("embedding"), F.lit(2).alias("version"))
    stale = vecs.filter("label = 0").select("chunk_id", F.transform("embedding", lambda x: x * F.lit(5).cast("float")).alias("embedding"), F.lit(1).alias("version"))
    fresh = vecs.filter("label = 2").select((F.col("chunk_id") + 1000000).alias("chunk_id"), "embedding", F.lit(1).alias("version"))
    out = vectors.upsert(vecs.select("chunk_id", "embedding"), flipped.unionByName(stale).unionByName(fresh))
    return out.select("chunk_id", F.posexplode("embedding").alias("place", "value")).withColumn("value", F.round("value", 6))


@query("vector_dim_check", "SELECT min(len(embedding)) AS min_dim, max(len(embedding)) AS max_dim, min(len(embedding)) = 64 AND max(len(embedding)) = 64 AS matches FROM embeddings")
def vector_dim_check(spark, sf_dir):
    return vectors.dimension_report(_vectors(spark, sf_dir), 64)


# --- keyword search --------------------------------------------------------------------------

TOKENS = f"""
toks AS (SELECT chunk_id, document_id, file_type, {op.tokens('text')} AS ts FROM chunks),
tok AS (SELECT chunk_id, document_id, file_type, len(ts) AS n_tokens, unnest(range(0, len(ts))) AS pos, unnest(ts) AS term FROM toks),
post AS (SELECT term, chunk_id, document_id, file_type, n_tokens, count(*) AS tf, list(pos ORDER BY pos) AS positions FROM tok GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
tot AS (SELECT count(*) AS n, sum(len(ts)) / CAST(count(*) AS DOUBLE) AS avg_len FROM toks)"""
STOP = op.in_list(fv.STOPWORDS)
QTERMS = f"""
qraw AS (SELECT item_id AS query_id, text AS q, list_filter(regexp_extract_all(text, '[^\\s]+'), lambda t: regexp_replace(t, '[^\\p{{L}}\\p{{N}}_]', '', 'g') <> '') AS ws FROM benchmark),
qcon AS (SELECT *, list_filter(ws, lambda t: lower(t) NOT IN ({STOP})) AS con FROM qraw),
qterm AS (SELECT query_id, q, unnest(CASE WHEN len(con) > 0 THEN con ELSE ws END) AS term FROM qcon),
qphr AS (SELECT query_id, {op.tokens('term')} AS ts FROM qterm),
phr AS (SELECT query_id, array_to_string(ts, ' ') AS phrase, ts, count(*) AS times FROM qphr WHERE len(ts) > 0 GROUP BY ALL),
ph AS (SELECT DISTINCT phrase, ts FROM phr),
ph1 AS (SELECT ph.phrase, p.chunk_id, p.document_id, p.file_type, p.n_tokens, p.tf FROM ph JOIN post p ON len(ph.ts) = 1 AND p.term = ph.phrase),
phn AS (SELECT ph.phrase, t.chunk_id, t.document_id, t.file_type, t.n_tokens, count(*) AS tf
        FROM ph JOIN tok t ON len(ph.ts) > 1 AND t.term = ph.ts[1] JOIN toks x ON x.chunk_id = t.chunk_id
        WHERE x.ts[t.pos + 1 : t.pos + len(ph.ts)] = ph.ts GROUP BY ALL),
pm AS (SELECT * FROM ph1 UNION ALL SELECT * FROM phn),
pdf AS (SELECT phrase, count(*) AS df FROM pm GROUP BY phrase),
pidf AS (SELECT phrase, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END AS idf FROM pdf, tot),
bm AS (SELECT query_id, chunk_id, document_id, file_type,
         sum(times * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_tokens / avg_len))) AS score
       FROM phr JOIN pm USING (phrase) JOIN pidf USING (phrase), tot GROUP BY query_id, chunk_id, document_id, file_type),
kw AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rnk FROM bm)"""
K = op.with_(CHUNKS, TOKENS)
S = op.with_(CHUNKS, TOKENS, QTERMS)
# the same with stems: the lexicon of texts and questions is stemmed once, and token lists are rebuilt from it
_PLAIN_TOKS, _PLAIN_PHRASES = TOKENS.split("\n")[1], QTERMS.split("\n")[4]
_LEXICON = f"""
raw0 AS (SELECT chunk_id, document_id, file_type, {op.tokens('text')} AS ts FROM chunks),
lex AS (SELECT DISTINCT term FROM (SELECT unnest(ts) AS term FROM raw0 UNION ALL SELECT unnest({op.tokens('text')}) FROM benchmark)),
""" + op.stems("lex")
STEM_TOKENS = _LEXICON + "," + TOKENS.replace(_PLAIN_TOKS, """toks AS (SELECT chunk_id, document_id, file_type, coalesce(list(s ORDER BY pos) FILTER (s IS NOT NULL), []) AS ts
  FROM raw0 LEFT JOIN (SELECT chunk_id, s, pos FROM (SELECT chunk_id, unnest(ts) AS term, unnest(range(0, len(ts))) AS pos FROM raw0) JOIN stm USING (term)) USING (chunk_id)
  GROUP BY chunk_id, document_id, file_type),""")
STEM_QTERMS = QTERMS.replace(_PLAIN_PHRASES, f"""qnum AS (SELECT row_number() OVER () AS qn, query_id, {op.tokens('term')} AS ts FROM qterm),
qphr AS (SELECT query_id, list(s ORDER BY pos) AS ts FROM (SELECT qn, query_id, unnest(ts) AS term, unnest(range(0, len(ts))) AS pos FROM qnum) JOIN stm USING (term) GROUP BY qn, query_id),""")
KS = op.with_(CHUNKS, STEM_TOKENS)
SS = op.with_(CHUNKS, STEM_TOKENS, STEM_QTERMS)


@query("tokenize", K + "SELECT chunk_id, pos, term FROM tok")
def tokenize(spark, sf_dir):
    return keyword.tokenize(doc_chunks(spark, sf_dir), stem=False).select("chunk_id", "pos", "term")


@query("tokenize_stemmed", KS + "SELECT chunk_id, pos, term FROM tok")
def tokenize_stemmed(spark, sf_dir):
    return keyword.tokenize(doc_chunks(spark, sf_dir)).select("chunk_id", "pos", "term")


@query("build_postings", K + "SELECT term, chunk_id, n_tokens, tf, array_to_string(positions, ' ') AS positions FROM post")
def build_postings(spark, sf_dir):
    post = keyword.build_postings(doc_chunks(spark, sf_dir), stem=False)
    return post.select("term", "chunk_id", "n_tokens", "tf", F.array_join(F.transform("positions", lambda p: p.cast("string")), " ").alias("positions"))


@query("index_stats", K + "SELECT term, df, n AS n_chunks, round(avg_len, 6) AS mean_length FROM dfs, tot")
def index_stats(spark, sf_dir):
    index = keyword.build_index(doc_chunks(spark, sf_dir), stem=False)
    return index.terms.withColumn("n_chunks", F.lit(index.n_chunks)).withColumn("mean_length", F.round(F.lit(index.mean_length), 6))


def _hits(df):
    return df.select("query_id", "rnk", "chunk_id", F.round("score", 6).alias("score"))


@query("bm25_search", S + "SELECT query_id, rnk, chunk_id, round(score, 6) AS score FROM kw WHERE rnk <= 100")
def bm25_search(spark, sf_dir):
    index = keyword.build_index(doc_chunks(spark, sf_dir), stem=False)
    return _hits(keyword.bm25_search(corpora.passages(spark, sf_dir), index))


@query("bm25_search_stemmed", SS + "SELECT query_id, rnk, chunk_id, round(score, 6) AS score FROM kw WHERE rnk <= 100")
def bm25_search_stemmed(spark, sf_dir):
    return _hits(keyword.bm25_search(corpora.passages(spark, sf_dir), keyword.build_index(doc_chunks(spark, sf_dir))))


def _kept_in_step(spark, sf_dir, stem=False):
    """Documents uploaded in five parts, of which one is deleted in two steps, one is uploaded again, and small segments are merged."""
    chunks = doc_chunks(spark, sf_dir)
    part = F.col("document_id") % 5
    index = segments.create(chunks.filter(part == 0), stem)
    for k in (1, 2, 3):
        index = segments.append(index, chunks.filter(part == k))
    ids = chunks.select("document_id").distinct()
    index = segments.delete(index, ids.filter("document_id % 7 = 0"))
    index = segments.merge(index)
    index = segments.append(index, chunks.filter(part == 4))
    index = segments.delete(index, ids.filter("document_id % 7 in (0, 1)"))
    return segments.append(index, chunks.filter("document_id % 7 = 1"))


STEP_CHUNKS = CHUNKS.replace("FROM documents)", "FROM documents WHERE doc_id % 7 <> 0)")
STEP = op.with_(STEP_CHUNKS, TOKENS, QTERMS)


@query("segments_bm25", STEP + "SELECT query_id, rnk, chunk_id, round(score, 6) AS score FROM kw WHERE rnk <= 100")
def segments_bm25(spark, sf_dir):
    """Search of an index that was kept in step by segments, tombstones and a merge, against the documents that are left."""
    return _hits(keyword.bm25_search(corpora.passages(spark, sf_dir), segments.searchable(_kept_in_step(spark, sf_dir))))


@query("segments_stats", op.with_(STEP_CHUNKS, TOKENS) + "SELECT term, df, n AS n_chunks, round(avg_len, 6) AS mean_length FROM dfs, tot")
def segments_stats(spark, sf_dir):
    """Statistics that were added and subtracted by segment, against a recount."""
    index = segments.searchable(_kept_in_step(spark, sf_dir))
    return index.terms.withColumn("n_chunks", F.lit(index.n_chunks)).withColumn("mean_length", F.round(F.lit(index.mean_length), 6))


@query("block_max_bm25", S + """,
al AS (SELECT query_id, count(*) AS postings FROM phr JOIN post ON post.term = phr.phrase GROUP BY query_id)
SELECT query_id, rnk, chunk_id, round(score, 6) AS score, postings FROM kw JOIN al USING (query_id) WHERE rnk <= 20""")
def block_max_bm25(spark, sf_dir):
    """The 20 best chunks per passage by blocks that can reach them, with the number of postings that scoring all would take."""
    index = keyword.build_index(doc_chunks(spark, sf_dir), stem=False)
    found = blockmax.search(corpora.passages(spark, sf_dir), blockmax.build(index), 20)
    return _hits(found.hits).join(found.work.select("query_id", "postings"), "query_id")


NEAR = 12


@query("near_match", K + f""",
q AS (SELECT item_id AS query_id, list_distinct({op.tokens('text')}[1:9:4]) AS w FROM benchmark),
g AS (SELECT query_id, len(w) AS n, unnest(w) AS term FROM q),
m AS (SELECT query_id, n, chunk_id, document_id, term, pos FROM g JOIN tok USING (term)),
f AS (SELECT a.query_id, a.chunk_id, a.document_id, a.pos AS start, a.n, b.term, min(b.pos) AS place FROM m a JOIN m b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id AND b.pos >= a.pos GROUP BY ALL),
s AS (SELECT query_id, chunk_id, document_id, start, max(place) - start AS span FROM f GROUP BY query_id, chunk_id, document_id, start, n HAVING count(*) = n)
SELECT query_id, chunk_id, document_id, min(span) AS span FROM s GROUP BY ALL HAVING min(span) <= {NEAR + 1}""")
def near_match(spark, sf_dir):
    """The first, fifth and ninth word of every passage within twelve words of each other."""
    words = tx.tokens(F.col("q"))
    groups = corpora.passages(spark, sf_dir).select(
        "query_id", F.filter(F.array(*[F.get(words, F.lit(i)) for i in (0, 4, 8)]), lambda t: t.isNotNull()).alias("terms"), F.lit(NEAR).alias("distance"))
    return keyword.near_matches(groups, keyword.build_index(doc_chunks(spark, sf_dir), stem=False))


@query("query_terms", op.with_(QTERMS.split("qphr AS")[0].rstrip().rstrip(",")) + "SELECT query_id, term, count(*) AS times FROM qterm GROUP BY ALL")
def query_terms(spark, sf_dir):
    terms = keyword.query_terms(corpora.passages(spark, sf_dir))
    return terms.select("query_id", F.explode("terms").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))


def _boolean_queries(spark, sf_dir):
    """Passages as Boolean requests: their first two words, any of the others, none of the last."""
    w = tx.words(F.col("q"))
    return corpora.passages(spark, sf_dir).select(
        "query_id", F.slice(w, 1, 2).alias("all_of"), F.slice(w, F.lit(3), F.greatest(F.size(w) - 3, F.lit(0))).alias("any_of"), F.slice(w, -1, 1).alias("none_of"))


@query("question_operators", K + f""",
bw AS (SELECT item_id AS query_id, {op.tokens('text')} AS ws FROM benchmark),
it AS (SELECT query_id, ws[i] AS term, (i - 1) // 3 AS c, (i - 1) % 3 = 2 AS neg FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM bw)),
tm AS (SELECT query_id, term, count(*) AS times FROM it WHERE NOT neg GROUP BY ALL),
sc AS (SELECT query_id, chunk_id, sum(times * CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END
         * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_tokens / avg_len))) AS score FROM tm JOIN post USING (term) JOIN dfs USING (term), tot GROUP BY query_id, chunk_id),
cl AS (SELECT query_id, c, count(DISTINCT term) FILTER (NOT neg) AS np, count(DISTINCT term) FILTER (neg) AS nn FROM it GROUP BY ALL),
m AS (SELECT it.query_id, it.c, chunk_id, count(DISTINCT term) FILTER (NOT neg) AS a, count(DISTINCT term) FILTER (neg) AS z FROM it JOIN post USING (term) GROUP BY ALL),
good AS (SELECT DISTINCT query_id, chunk_id FROM m JOIN cl USING (query_id, c) WHERE a = np AND NOT (nn > 0 AND z = nn)),
r AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rnk FROM sc JOIN good USING (query_id, chunk_id))
SELECT query_id, rnk, chunk_id, round(score, 6) AS score FROM r WHERE rnk <= 100""")
def question_operators(spark, sf_dir):
    """Whole passages as questions: of every three words two have to be there and the third must not, or the next three decide."""
    w = tx.tokens(F.col("q"))
    joint = lambda i: F.when(i == 0, "").when(i % 3 == 0, " OR ").when(i % 3 == 2, " NOT ").otherwise(" ")
    asked = corpora.passages(spark, sf_dir).select("query_id", F.array_join(F.transform(w, lambda t, i: F.concat(joint(i), t)), "").alias("q"))
    return _hits(keyword.bm25_search(asked, keyword.build_index(doc_chunks(spark, sf_dir), stem=False)))


@query("bool_match", K + f""",
bq AS (SELECT item_id AS query_id, {op.words('text')} AS ws FROM benchmark),
side AS (SELECT query_id, 'all' AS side, unnest(ws[1:2]) AS term FROM bq UNION ALL SELECT query_id, 'any', unnest(ws[3:len(ws) - 1]) FROM bq
         UNION ALL SELECT query_id, 'none', unnest(ws[-1:]) FROM bq),
sp AS (SELECT DISTINCT query_id, side, {op.tokens('term')} AS ts FROM side),
ss AS (SELECT * FROM sp WHERE len(ts) > 0),
hit AS (SELECT DISTINCT ss.query_id, ss.side, ss.ts, t.chunk_id FROM ss JOIN tok t ON t.term = ss.ts[1] JOIN toks x ON x.chunk_id = t.chunk_id
        WHERE x.ts[t.pos + 1 : t.pos + len(ss.ts)] = ss.ts),
agg AS (SELECT query_id, chunk_id, count(*) FILTER (side = 'all') AS a, count(*) FILTER (side = 'any') AS o, count(*) FILTER (side = 'none') AS z FROM hit GROUP BY ALL)
SELECT query_id, chunk_id FROM agg WHERE z = 0 AND a = (SELECT count(*) FROM ss WHERE ss.query_id = agg.query_id AND side = 'all')
  AND (o > 0 OR NOT EXISTS (SELECT 1 FROM ss WHERE ss.query_id = agg.query_id AND side = 'any'))""")
def bool_match(spark, sf_dir):
    index = keyword.build_index(doc_chunks(spark, sf_dir), stem=False)
    return keyword.boolean_match(_boolean_queries(spark, sf_dir), index)


@query("phrase_match", K + f""",
pq AS (SELECT item_id AS query_id, {op.tokens('text')} AS ws FROM benchmark),
pp AS (SELECT query_id, unnest(range(1, len(ws))) AS i, ws FROM pq),
pr AS (SELECT DISTINCT ws[i : i + 1] AS ts FROM pp)
SELECT array_to_string(pr.ts, ' ') AS phrase, t.chunk_id, count(*) AS tf FROM pr JOIN tok t ON t.term = pr.ts[1] JOIN toks x ON x.chunk_id = t.chunk_id
WHERE x.ts[t.pos + 2] = pr.ts[2] GROUP BY ALL""")
def phrase_match(spark, sf_dir):
    """Every pair of neighbouring words of every passage as a phrase."""
    index = keyword.build_index(doc_chunks(spark, sf_dir), stem=False)
    words = corpora.passages(spark, sf_dir).select("query_id", tx.tokens(F.col("q")).alias("w"))
    pairs = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.slice("w", i, 2))).alias("tokens"))
    phrases = pairs.withColumn("phrase", F.array_join("tokens", " "))
    return keyword.phrase_matches(phrases, index).select("phrase", "chunk_id", "tf")


def _filtered_queries(spark, sf_dir):
    """Passages that ask for one language, one document, or anything."""
    kind = F.col("query_id") % 3
    return corpora.passages(spark, sf_dir).select(
        "query_id", "q", F.when(kind == 0, "fr").alias("file_type"), F.when(kind == 1, F.col("query_id") * 3).otherwise(0).cast("long").alias("doc_id"))


@query("bm25_filtered", S + """,
f AS (SELECT * FROM bm WHERE (query_id % 3 <> 0 OR file_type = 'fr') AND (query_id % 3 <> 1 OR query_id * 3 = 0 OR document_id = query_id * 3)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rnk FROM f)
SELECT query_id, rnk, chunk_id, round(score, 6) AS score FROM r WHERE rnk <= 20""")
def bm25_filtered(spark, sf_dir):
    index = keyword.build_index(doc_chunks(spark, sf_dir), stem=False)
    return _hits(keyword.bm25_search(_filtered_queries(spark, sf_dir), index, corpora.doc_texts(spark, sf_dir), 20))


@query("bm25_page", S + "SELECT query_id, rnk, chunk_id, round(score, 6) AS score FROM kw WHERE rnk > 10 AND rnk <= 20")
def bm25_page(spark, sf_dir):
    index = keyword.build_index(doc_chunks(spark, sf_dir), stem=False)
    return _hits(keyword.bm25_search(corpora.passages(spark, sf_dir), index, limit=10, offset=10))


# --- hybrid search ----------------------------------------------------------------------------

DIM = 32
HYB = f"""
ready AS (SELECT doc_id FROM documents LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id) WHERE NOT coalesce(quality = 0, false)),
pv AS (SELECT chunk_id, {hash_sql('embed_text', DIM)} AS v FROM embedded),
qv AS (SELECT item_id AS query_id, {hash_sql(f"'{fv.QUERY_INSTRUCTION}' || text", DIM)} AS v FROM benchmark),
sem0 AS (SELECT query_id, chunk_id, list_cosine_similarity(qv.v, pv.v) AS score FROM qv, pv),
sem AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rnk FROM sem0),
ct AS (SELECT item_id AS query_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda t: length(t) > 1 AND t NOT IN ({STOP}))) AS terms FROM benchmark),
te AS (SELECT query_id, term, regexp_replace(term, '[^a-z]', '', 'g') AS a FROM (SELECT query_id, unnest(terms) AS term FROM ct)),
tt AS (SELECT doc_id, unnest(regexp_extract_all(lower(source || '_' || doc_id), '[a-z]+')) AS tok FROM documents JOIN ready USING (doc_id)),
tm AS (SELECT query_id, doc_id, count(DISTINCT term) AS n FROM te JOIN tt ON a <> '' AND (tok = a OR (length(tok) >= 4 AND starts_with(a, tok)) OR (length(a) >= 4 AND starts_with(tok, a))) GROUP BY ALL),
title AS (SELECT query_id, doc_id * 1048576 AS chunk_id, n, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, doc_id) AS rnk FROM tm JOIN (SELECT DISTINCT document_id FROM chunks) c ON c.document_id = doc_id),
legs AS (SELECT query_id, chunk_id, rnk, 1.0 AS w, 0 AS leg FROM kw WHERE rnk <= 100 UNION ALL SELECT query_id, chunk_id, rnk, 1.0, 1 FROM sem WHERE rnk <= 100
         UNION ALL SELECT query_id, chunk_id, rnk, 2.0, 2 FROM title),
fused AS (SELECT query_id, chunk_id, sum(w / (60 + rnk)) AS score, min(leg * 1000000000 + rnk) AS seen FROM legs GROUP BY ALL),
hyb AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, seen) AS rnk FROM fused)"""
SNIP = """
CASE WHEN loc > 0 THEN (CASE WHEN st > 0 THEN '…' ELSE '' END) || {strip} || (CASE WHEN st + 220 < length(text) THEN '…' ELSE '' END)
     ELSE {strip0} || (CASE WHEN length(text) > 220 THEN '…' ELSE '' END) END""".format(
    strip=op.strip("substr(text, CAST(st + 1 AS INT), 220)"), strip0=op.strip("substr(text, 1, 220)"))


def search_index(spark, sf_dir, stem=False):
    return hybrid.build_search(corpora.documents(spark, sf_dir).drop("text"), doc_chunks(spark, sf_dir), stem, DIM)


@query("content_terms", f"""
SELECT conv_id, turn, array_to_string(list_transform(list_sort(list_transform(list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'),
  lambda t: length(t) > 1 AND t NOT IN ({STOP}))), lambda t: {{'n': -length(t), 't': t}})), lambda s: s.t), ' ') AS terms FROM conversations""")
def content_terms(spark, sf_dir):
    return corpora.read(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(tx.content_terms(F.col("text")), " ").alias("terms"))


@query("rrf_fuse", op.with_(CHUNKS, TOKENS, QTERMS, HYB) + """,
l2 AS (SELECT query_id, chunk_id, rnk, 0 AS leg FROM kw WHERE rnk <= 100 UNION ALL SELECT query_id, chunk_id, rnk, 1 FROM sem WHERE rnk <= 100),
f2 AS (SELECT query_id, chunk_id, sum(1.0 / (60 + rnk)) AS score, min(leg * 1000000000 + rnk) AS seen FROM l2 GROUP BY ALL),
r2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, seen) AS rnk FROM f2)
SELECT query_id, rnk, chunk_id, round(score, 6) AS score FROM r2 WHERE rnk <= 200""")
def rrf_fuse(spark, sf_dir):
    index = search_index(spark, sf_dir)
    queries = corpora.passages(spark, sf_dir)
    legs = {"keyword": keyword.bm25_search(queries, index.keyword), "semantic": hybrid.semantic_leg(queries, index)}
    return _hits(ranking.ranked(ranking.fuse(legs), 2 * fv.LEG_DEPTH))


@query("title_match", op.with_(op.CAT) + f""",
te AS (SELECT item_id AS query_id, unnest(list_distinct(list_filter(regexp_extract_all(lower('invoice sources ' || text), '[\\p{{L}}\\p{{N}}_]+'), lambda t: length(t) > 1 AND t NOT IN ({STOP})))) AS term FROM benchmark),
ta AS (SELECT query_id, term, regexp_replace(term, '[^a-z]', '', 'g') AS a FROM te),
tt AS (SELECT document_id, unnest(list_distinct(regexp_extract_all(lower('Source ' || title), '[a-z]+'))) AS tok FROM cat WHERE status = 'ready' AND len({op.words('text')}) > 0),
tm AS (SELECT query_id, document_id, count(DISTINCT term) AS n FROM ta JOIN tt ON a <> '' AND (tok = a OR (length(tok) >= 4 AND starts_with(a, tok)) OR (length(a) >= 4 AND starts_with(tok, a))) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, document_id) AS rnk FROM tm)
SELECT query_id, document_id * 1048576 AS chunk_id, rnk FROM r WHERE rnk <= 100""")
def title_match(spark, sf_dir):
    docs = corpora.documents(spark, sf_dir).withColumn("title", F.concat(F.lit("Source "), "title"))
    queries = corpora.passages(spark, sf_dir).withColumn("q", F.concat(F.lit("invoice sources "), "q"))
    titles = hybrid.title_tokens(docs, doc_chunks(spark, sf_dir))
    return hybrid.title_leg(hybrid.title_matches(queries, titles), fv.LEG_DEPTH)


HYB_PAGE = f""",
pg AS (SELECT query_id, rnk, chunk_id, score FROM hyb WHERE rnk <= 20),
o AS (SELECT query_id, term, length(term) AS n FROM te),
hit AS (SELECT pg.*, c.document_id, c.title, c.file_type, c.text,
          (SELECT arg_min(instr(lower(c.text), o.term), (-o.n, o.term)) FROM o WHERE o.query_id = pg.query_id AND contains(lower(c.text), o.term)) AS at0
        FROM pg JOIN chunks c USING (chunk_id)),
pos AS (SELECT *, coalesce(at0, 0) AS loc, greatest(0, coalesce(at0, 1) - 1 - 73) AS st FROM hit)
SELECT query_id, CAST(rnk AS INT) AS rnk, chunk_id, document_id, title AS document_title, file_type, {SNIP} AS snippet, round(score, 6) AS score FROM pos"""


@query("hybrid_search", op.with_(CHUNKS, TOKENS, QTERMS, HYB) + HYB_PAGE)
def hybrid_search(spark, sf_dir):
    hits = hybrid.search(corpora.passages(spark, sf_dir), search_index(spark, sf_dir))
    return hits.withColumn("score", F.round("score", 6)).drop("text", "location")


@query("hybrid_search_stemmed", op.with_(CHUNKS, STEM_TOKENS, STEM_QTERMS, HYB) + HYB_PAGE)
def hybrid_search_stemmed(spark, sf_dir):
    hits = hybrid.search(corpora.passages(spark, sf_dir), search_index(spark, sf_dir, stem=True))
    return hits.withColumn("score", F.round("score", 6)).drop("text", "location")


@query("search_modes", op.with_(CHUNKS, TOKENS, QTERMS, HYB) + """
SELECT 'keyword' AS mode, query_id, rnk, chunk_id, round(score, 6) AS score FROM kw WHERE rnk <= 20
UNION ALL SELECT 'semantic', query_id, rnk, chunk_id, round(score, 6) FROM sem WHERE rnk <= 20
UNION ALL SELECT 'hybrid', query_id, rnk, chunk_id, round(score, 6) FROM hyb WHERE rnk <= 20""")
def search_modes(spark, sf_dir):
    index, queries, out = search_index(spark, sf_dir), corpora.passages(spark, sf_dir), None
    for mode in ("keyword", "semantic", "hybrid"):
        page = hybrid.search(queries, index, mode).select(F.lit(mode).alias("mode"), "query_id", "rnk", "chunk_id", F.round("score", 6).alias("score"))
        out = page if out is None else out.unionByName(page)
    return out


@query("snippet", f"""
WITH q AS (SELECT a.conv_id, a.turn, a.text, list_filter(regexp_extract_all(lower(b.text), '[\\p{{L}}\\p{{N}}_]+'), lambda t: length(t) > 1 AND t NOT IN ({STOP})) AS ts
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1),
t AS (SELECT *, list_transform(list_sort(list_transform(list_filter(ts, lambda t: contains(lower(text), t)), lambda t: {{'n': -length(t), 't': t}})), lambda s: s.t) AS present FROM q),
p AS (SELECT *, CASE WHEN len(present) > 0 THEN instr(lower(text), present[1]) ELSE 0 END AS loc FROM t),
s AS (SELECT *, greatest(0, loc - 1 - 73) AS st FROM p)
SELECT conv_id, turn, {SNIP} AS snippet FROM s""")
def snippet(spark, sf_dir):
    """A snippet of every reply for the words of the turn before it."""
    turns = corpora.read(spark, sf_dir, "conversations")
    asked = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("q"))
    return turns.join(asked, ["conv_id", "turn"]).select("conv_id", "turn", tx.snippet(F.col("text"), tx.content_terms(F.col("q"))).alias("snippet"))


HSTOP = op.in_list(fv.HIGHLIGHT_STOPWORDS)


@query("highlight", f"""
WITH q AS (SELECT a.conv_id, a.turn, a.text, list_filter(regexp_split_to_array(lower(b.text), '{op.SP}'), lambda t: length(t) > 1 AND t NOT IN ({HSTOP})) AS ts
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1),
e AS (SELECT *, array_to_string(list_transform(ts, lambda t: regexp_replace(t, '([.*+?^${{}}()|\\[\\]\\\\])', '\\\\\\1', 'g')), '|') AS pat FROM q)
SELECT conv_id, turn, CASE WHEN pat = '' THEN text ELSE regexp_replace(text, '(?i)(' || pat || ')', '<mark>\\1</mark>', 'g') END AS marked FROM e""")
def highlight(spark, sf_dir):
    turns = corpora.read(spark, sf_dir, "conversations")
    asked = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("q"))
    return turns.join(asked, ["conv_id", "turn"]).select("conv_id", "turn", tx.highlight(F.col("text"), F.col("q")).alias("marked"))


# --- admission ----------------------------------------------------------------------------------

@query("content_hash", "SELECT doc_id AS document_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    return corpora.doc_texts(spark, sf_dir).select("document_id", admission.content_hash(F.col("text")).alias("content_hash"))
