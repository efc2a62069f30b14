"""Check SQL of the queries that SQL can state, written independently of the operators."""

from __future__ import annotations

from quirefold.llm import linerules
from quirefold.llm.licences import LEAST_DICE, TEMPLATES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _low(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}')"


_BENCH_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP2 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_low('text')}, '{_BENCH_WORDS}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_low('text')}, '{_BENCH_WORDS}') AS w FROM benchmark),
win AS (SELECT item_id, least(len(w), 13) AS m, array_to_string(w[s:s + least(len(w), 13) - 1], ' ') AS g
        FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM win),
dw AS (SELECT rid, s, m, array_to_string(w[s:s + m - 1], ' ') AS g
       FROM (SELECT rid, w, m, unnest(generate_series(1, len(w) - m + 1)) AS s FROM d, sizes)),
hits AS (SELECT rid, s, dw.m, item_id FROM dw JOIN win ON dw.m = win.m AND dw.g = win.g),
cov AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(s, s + m - 1)) AS p FROM hits) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
        FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS i FROM hits WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (rid) LEFT JOIN its USING (rid)
"""

_TRIM = "trim(l, ' ' || chr(9) || chr(13) || chr(11) || chr(12))"

OP10 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
raw AS (SELECT rid, doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS ln FROM d),
nb AS (SELECT rid, doc_id, ln, {_TRIM} AS l, len(regexp_split_to_array({_TRIM}, '\s+')) AS w,
              row_number() OVER (PARTITION BY rid ORDER BY ln) AS idx
       FROM raw WHERE {_TRIM} <> ''),
cum AS (SELECT *, sum(w) OVER (PARTITION BY rid ORDER BY idx) AS e FROM nb),
docs AS (SELECT rid, doc_id, list(l ORDER BY idx) AS ls, list(e ORDER BY idx) AS es, list(w ORDER BY idx) AS ws FROM cum GROUP BY ALL),
ends AS (SELECT a.rid, a.idx AS i, min(b.idx) AS j FROM cum a JOIN cum b ON a.rid = b.rid AND b.e - (a.e - a.w) >= 50 AND b.idx >= a.idx GROUP BY ALL
         UNION
         SELECT b.rid, max(a.idx), b.idx FROM cum a JOIN cum b ON a.rid = b.rid AND b.e - (a.e - a.w) >= 50 AND b.idx >= a.idx GROUP BY b.rid, b.idx),
runs AS (SELECT ends.rid, doc_id, i, j, array_to_string(ls[i:j], chr(10)) AS run FROM ends JOIN docs USING (rid)),
firsts AS (SELECT run, min(struct_pack(a := doc_id, b := i)) AS f FROM runs GROUP BY run HAVING count(*) > 1),
copies AS (SELECT rid, unnest(generate_series(i, j)) AS idx, CASE WHEN doc_id = f.a THEN f.b + j - i ELSE 0 END AS kept_to FROM runs JOIN firsts USING (run) WHERE struct_pack(a := doc_id, b := i) <> f),
gone AS (SELECT DISTINCT rid, idx FROM copies WHERE idx > kept_to),
lns AS (SELECT nb.rid, nb.ln FROM nb JOIN gone USING (rid, idx)),
kept AS (SELECT raw.rid, string_agg(raw.l, chr(10) ORDER BY raw.ln) AS t FROM raw ANTI JOIN lns ON raw.rid = lns.rid AND raw.ln = lns.ln GROUP BY raw.rid),
n AS (SELECT rid, count(*) AS k FROM lns GROUP BY rid), a AS (SELECT rid, count(*) AS k FROM nb GROUP BY rid)
SELECT doc_id, CAST(coalesce(a.k, 0) AS BIGINT) AS n_lines, CAST(coalesce(n.k, 0) AS BIGINT) AS n_deleted,
       CASE WHEN text IS NULL THEN NULL ELSE coalesce(kept.t, '') END AS text
FROM d LEFT JOIN n USING (rid) LEFT JOIN a USING (rid) LEFT JOIN kept USING (rid)
"""

OP5 = """
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum([q.v[i] * c.v[i] FOR i IN generate_series(1, len(q.v))]) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_BIT = "CAST(substr(bits, 5 * i + {k}, 1) AS INTEGER) * {v}"
_FIVE = " + ".join(_BIT.format(k=k + 1, v=16 >> k) for k in range(5))

OP8 = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS payload_bytes, b, CAST(CAST(unhex(sha1(b)) AS BIT) AS VARCHAR) AS bits FROM p),
d AS (SELECT page_id, payload_bytes, b,
             array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {_FIVE}, 1) FOR i IN generate_series(0, 31)], '') AS payload_digest FROM h),
k AS (SELECT b, max(page_id) AS keeper FROM d GROUP BY b)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM d JOIN k USING (b)
"""


_LICENCE_WORDS = r"[a-z0-9]+(?:\.[0-9]+)*"
_QUOTE = "'"
_VALUES = ", ".join(f"({k}, '{name}', '{text.replace(_QUOTE, 2 * _QUOTE)}')" for k, (name, text) in enumerate(TEMPLATES))

OP6 = rf"""
WITH t AS (SELECT k, name, list_distinct([(w[i], w[i + 1]) FOR i IN generate_series(1, len(w) - 1)]) AS g
           FROM (SELECT k, name, regexp_extract_all(lower(x), '{_LICENCE_WORDS}') AS w FROM (VALUES {_VALUES}) AS v(k, name, x))),
d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT rid, generate_subscripts(ls, 1) AS ln, regexp_extract_all(lower(unnest(ls)), '{_LICENCE_WORDS}') AS w FROM d),
f AS (SELECT *, sum(CASE WHEN len(w) = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY ln) AS par, max(ln) OVER (PARTITION BY rid) AS n FROM l),
u AS (SELECT rid, ln AS a, ln AS b, w FROM f WHERE len(w) > 0
      UNION ALL SELECT rid, min(ln), max(ln), flatten(list(w ORDER BY ln)) FROM f WHERE len(w) > 0 GROUP BY rid, par, n HAVING count(*) > 1 AND count(*) < n
      UNION ALL SELECT rid, 1, n, flatten(list(w ORDER BY ln)) FROM f WHERE n > 1 GROUP BY rid, n),
g AS (SELECT rid, a, b, list_distinct([(w[i], w[i + 1]) FOR i IN generate_series(1, len(w) - 1)]) AS g FROM u WHERE len(w) > 1),
m AS (SELECT rid, a, b, name, max(2.0::DOUBLE * len(list_intersect(g.g, t.g)) / (len(g.g) + len(t.g))) AS dice
      FROM g JOIN t ON least(len(g.g), len(t.g)) * 2.0 >= {LEAST_DICE} * (len(g.g) + len(t.g)) GROUP BY ALL),
best AS (SELECT * FROM m WHERE dice >= {LEAST_DICE} QUALIFY dice = max(dice) OVER (PARTITION BY rid, a, b)),
s AS (SELECT rid, count(*) AS n, max(dice) AS best, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM best GROUP BY rid)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_matches, coalesce(names, '') AS licences, round(coalesce(best, 0), 6) AS best_dice
FROM d LEFT JOIN s USING (rid)
"""


def _list(texts: list[str]) -> str:
    return "[" + ", ".join("'" + t.replace(_QUOTE, 2 * _QUOTE) + "'" for t in texts) + "]"


_WORDS = r"[^\x20\x09-\x0D]+"

OP11 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '{_WORDS}') AS w FROM d),
win AS (SELECT rid, s, w[s:s + 2] AS g FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 2)) AS s FROM w)),
twice AS (SELECT rid, s FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n_rep FROM (SELECT rid, unnest([s, s + 1, s + 2]) AS p FROM twice) GROUP BY rid),
l AS (SELECT rid, l, {_low('l')} AS low, regexp_extract_all(l, '{_WORDS}') AS w FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d)),
ruled AS (SELECT *, len(w) AS n, len(list_filter(w, lambda x: list_contains({_list(linerules.SEPARATORS)}, x))) AS seps,
                 len(list_filter(regexp_extract_all(low, '{linerules.MENU_WORD}'), lambda x: list_contains({_list(linerules.MENU_WORDS)}, x))) AS menu,
                 len(list_filter({_list(linerules.PHRASES)}, lambda x: contains(low, x))) AS said,
                 len(regexp_extract_all(l || ' ', '{linerules.NOISY}{linerules.BLANK}')) AS noisy,
                 len(regexp_extract_all(regexp_extract(l || ' ', '^((?s:.*)(?:{linerules.CLOSING.replace(_QUOTE, 2 * _QUOTE)})){linerules.BLANK}', 1), '{_WORDS}')) AS closed
          FROM l WHERE len(w) > 0),
fails AS (SELECT *, (seps > 1 AND seps * 8 >= n) OR (menu > 1 AND menu * 2 >= n) OR (said > 0 AND said * {linerules.PHRASE_WORDS} >= n)
                    OR noisy * 4 > n OR (n - closed) * 2 > n AS bad FROM ruled),
ln AS (SELECT rid, sum(CASE WHEN bad THEN n ELSE 0 END) AS lost, count(*) - count(DISTINCT l) AS dups FROM fails GROUP BY rid),
r AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum([length(x) FOR x IN w]), 0) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dups, 0) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_rep, 0) AS BIGINT) AS n_repeat_words, coalesce(lost, 0) AS lost
      FROM w LEFT JOIN rep USING (rid) LEFT JOIN ln USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * lost <= {linerules.MAX_LOST} * n_words AS kept
FROM b
"""

_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

OP12 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(text, '{_TERMS}') AS w FROM documents),
c AS (SELECT rid, doc_id, len(w) AS n FROM d WHERE len(w) > 0),
s AS (SELECT count(*) AS total, CAST(sum(n) AS BIGINT) AS l FROM c),
tf AS (SELECT rid, x, count(*) AS tf FROM (SELECT rid, {_low('unnest(w)')} AS x FROM d) GROUP BY rid, x),
df AS (SELECT x, CAST(floor(1000 * ln(CAST(2 * total + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
       FROM (SELECT x, count(*) AS df FROM tf GROUP BY x), s),
q AS (SELECT qid, item_id, {_low('unnest(w)')} AS x
      FROM (SELECT row_number() OVER () AS qid, item_id, regexp_extract_all(text, '{_TERMS}') AS w FROM (SELECT DISTINCT item_id, text FROM benchmark))),
qt AS (SELECT qid, item_id, x, count(*) AS r FROM q GROUP BY ALL),
p AS (SELECT tf.x, rid, doc_id, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * total) // l))) AS part
      FROM tf JOIN df USING (x) JOIN c USING (rid), s),
sc AS (SELECT qid, item_id, rid, doc_id, CAST(sum(r * part) AS BIGINT) AS score FROM qt JOIN p USING (x) GROUP BY ALL),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id, rid) AS INTEGER) AS rank FROM sc WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM rk WHERE rank <= 20
"""

_CRC = "list_reduce([4294967295::BIGINT] || [CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT) FOR i IN range(len(h) // 2)], lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)]))"


def _bucketed(name: str) -> str:
    return f"SELECT rid, n, xor({_CRC}, 4294967295) % 10000 AS k FROM (SELECT rid, x, count(*) AS n FROM {name} GROUP BY rid, x), LATERAL (SELECT hex(encode(x)) AS h), tab"


OP13 = rf"""
WITH tab AS (SELECT list(c ORDER BY b) AS tab FROM (
    SELECT b, list_reduce([b] || [0 FOR i IN range(8)], lambda c, z: xor(c >> 1, 3988292384 * (c & 1))) AS c FROM (SELECT unnest(range(256)) AS b))),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_low('text')}, '{_BENCH_WORDS}') AS w FROM documents),
dw AS (SELECT rid, unnest(w) AS x FROM d), bw AS (SELECT 1 AS rid, unnest(regexp_extract_all({_low('text')}, '{_BENCH_WORDS}')) AS x FROM benchmark),
df AS ({_bucketed('dw')}), bf AS ({_bucketed('bw')}),
sk AS (SELECT k, sum(n) AS s FROM df GROUP BY k), tk AS (SELECT k, sum(n) AS t FROM bf GROUP BY k),
g AS (SELECT k, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM df) + 10000)::DOUBLE
                                     / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM bf) + 10000)::DOUBLE))) AS BIGINT) AS gain
      FROM sk FULL JOIN tk USING (k)),
wt AS (SELECT rid, CAST(sum(n * gain) AS BIGINT) AS weight FROM df JOIN g USING (k) GROUP BY rid),
sc AS (SELECT rid, doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
              coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
       FROM d LEFT JOIN wt USING (rid)),
rk AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM sc WHERE n_features >= 20
       QUALIFY r <= (SELECT 10 * count(*) // 100 FROM sc WHERE n_features >= 20))
SELECT doc_id, n_features, weight, score, CAST(r AS BIGINT) AS rank FROM sc LEFT JOIN rk USING (rid)
"""
