"""DuckDB SQL for the operators that SQL can express on whole (small) tables, written independently of the Spark code."""

from __future__ import annotations

import string

from .decontaminate import SHARE, WINDOW
from .language import PROFILE
from .secrets import MID, OPEN, RULES, SHUT
from .sharding import WHOLE
from .suffixes import LENGTH

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

JACCARD = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE CAST([] AS VARCHAR[]) END)) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_have AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM both_have JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 90 * (nx.n + ny.n - i)),
links AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, links.y FROM reach r JOIN links ON links.x = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, (SELECT count(*) FROM links WHERE links.x = d.doc_id) AS n_links
FROM documents d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""


# The table of the crc32 checksum; a checksum is run up over bytes with it.
CRC = "SELECT list_transform(range(256), lambda n: list_reduce([n] || range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END)) AS crc"


def _crc32(values: str) -> str:
    return f"xor(list_reduce([CAST(4294967295 AS BIGINT)] || {values}, lambda a, y: xor(a >> 8, crc[1 + (xor(a, y) & 255)])), CAST(4294967295 AS BIGINT))"


# All records in one order.
SHARDS = f"""
WITH c AS ({CRC}),
t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, substr(md5(coalesce(text, '')), 1, 15) AS k FROM documents),
b AS (SELECT doc_id, k, length(x) // 2 + 16 AS size, list_transform(regexp_extract_all(x, '..'), lambda h: CAST(16 * (strpos('0123456789ABCDEF', h[1]) - 1) + strpos('0123456789ABCDEF', h[2]) - 1 AS BIGINT)) AS bytes FROM t),
o AS (SELECT doc_id, k, size, {_crc32("bytes")} AS text_crc32,
  row_number() OVER (ORDER BY k, doc_id) AS rank, 2 * (sum(size) OVER (ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING)) - size AS middle, sum(size) OVER () AS total FROM b, c),
g AS (SELECT *, sum(size) OVER (PARTITION BY k) AS whole, min((middle - size) // 2) OVER (PARTITION BY k) AS before FROM o),
s AS (SELECT *, CAST(CASE WHEN whole * {WHOLE} * 40 <= total THEN 40 * (2 * before + whole) // (2 * total) ELSE 40 * middle // (2 * total) END AS INTEGER) AS shard FROM g)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, rank - min(rank) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
"""

# Every distinct n-gram is hashed once; buckets of both tables give the gains.
IMPORTANCE = f"""
WITH c AS ({CRC}),
t AS (SELECT 'd' AS side, row_number() OVER () AS row, doc_id, text FROM documents UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark),
w AS (SELECT side, row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM t),
g AS (SELECT side, row, unnest(w || list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]) || list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w),
n AS (SELECT side, row, g, count(*) AS n FROM g GROUP BY ALL),
known AS (SELECT g, hex(encode(g)) AS x FROM n GROUP BY g),
hashed AS (SELECT g, {_crc32("list_transform(regexp_extract_all(x, '..'), lambda h: CAST(16 * (strpos('0123456789ABCDEF', h[1]) - 1) + strpos('0123456789ABCDEF', h[2]) - 1 AS BIGINT))")} % 10000 AS bucket FROM known, c),
sums AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 'd'), 0) AS s, coalesce(sum(n) FILTER (WHERE side = 'b'), 0) AS t FROM n JOIN hashed USING (g) GROUP BY bucket),
every AS (SELECT sum(s) AS s, sum(t) AS t FROM sums),
gains AS (SELECT bucket, CAST(floor(1000 * ln((CAST(sums.t AS DOUBLE) + 1) * (CAST(every.s AS DOUBLE) + 10000) / ((CAST(sums.s AS DOUBLE) + 1) * (CAST(every.t AS DOUBLE) + 10000)))) AS BIGINT) AS gain FROM sums, every),
weights AS (SELECT row, CAST(sum(n * gain) AS BIGINT) AS weight FROM n JOIN hashed USING (g) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY row),
scored AS (SELECT row, doc_id, len(w) AS words, len(w) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0) AS n_features, coalesce(weight, 0) AS weight,
  list_reduce([0] || list_transform(range(1, 9), lambda i: strpos('0123456789abcdef', sha256('42:' || doc_id)[i]) - 1), lambda a, b: 16 * a + b) AS h FROM w LEFT JOIN weights USING (row) WHERE side = 'd'),
noisy AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score, count(*) FILTER (WHERE words >= 20) OVER () AS able FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS place FROM noisy)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND place <= 5 * able // 100 THEN place END AS rank FROM ranked
"""

NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS anchor_id, c.vec_id AS vec_id, q.label = c.label AS same, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT anchor_id, positive_id, positive_score, s.vec_id AS negative_id, score AS negative_score, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

# Words in blanks, their n-grams of one to three letters, and ranks.
LANGUAGES = f"""
WITH c AS ({CRC}),
d AS (SELECT doc_id, text, lang, {_crc32("list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))")} % 4 = 2 AS held_out FROM documents, c),
s AS (SELECT doc_id, regexp_extract_all(' ' || trim(lower(regexp_replace(coalesce(text, ''), '[^\\p{{L}}]+', ' ', 'g'))) || ' ', '.') AS cs FROM d),
x AS (SELECT doc_id, unnest(cs) AS a, generate_subscripts(cs, 1) AS i FROM s WHERE len(cs) > 2),
w AS (SELECT doc_id, a, lead(a) OVER (PARTITION BY doc_id ORDER BY i) AS b, lead(a, 2) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM x),
g AS (SELECT doc_id, a AS g FROM w WHERE a <> ' ' UNION ALL SELECT doc_id, a || b FROM w WHERE b IS NOT NULL UNION ALL SELECT doc_id, a || b || c FROM w WHERE c IS NOT NULL AND b <> ' '),
n AS (SELECT doc_id, g, count(*) AS n FROM g GROUP BY doc_id, g),
own AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, length(g), g) AS rank FROM n QUALIFY rank <= {PROFILE}),
p AS (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, length(g), g) AS rank FROM n JOIN d USING (doc_id) WHERE NOT held_out AND lang IS NOT NULL AND text IS NOT NULL GROUP BY lang, g QUALIFY rank <= {PROFILE}),
met AS (SELECT doc_id, lang, sum({PROFILE} - abs(own.rank - p.rank)) AS saved FROM own JOIN p USING (g) GROUP BY doc_id, lang),
every AS (SELECT o.doc_id, l.lang, o.many, coalesce(saved, 0) AS saved FROM (SELECT doc_id, count(*) AS many FROM own GROUP BY doc_id) o CROSS JOIN (SELECT DISTINCT lang FROM p) l LEFT JOIN met ON met.doc_id = o.doc_id AND met.lang = l.lang),
best AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY saved DESC, lang) = 1)
SELECT doc_id, held_out, coalesce(best.lang, 'und') AS lang_pred, coalesce(CAST(saved AS DOUBLE) / (many * {PROFILE}), 0.0) AS score FROM d LEFT JOIN best USING (doc_id)
"""

# Every window of every text by its md5; texts as hexadecimal digits, so that places are bytes.
REPEATS = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
parts AS (SELECT doc_id, c, substr(x, 2 * c + 1, {2 * (200 + LENGTH - 1)}) AS x FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - {LENGTH - 1}, 200)) AS c FROM d)),
w AS (SELECT doc_id, c + i AS i, md5(substr(x, 2 * i + 1, {2 * LENGTH})) AS k FROM (SELECT doc_id, c, x, unnest(range(0, length(x) // 2 - {LENGTH - 1})) AS i FROM parts)),
s AS (SELECT doc_id, i FROM w SEMI JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) USING (k)),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {LENGTH} THEN 0 ELSE 1 END AS fresh FROM s),
r AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
spans AS (SELECT doc_id, min(i) AS a, max(i) + {LENGTH} AS b FROM r GROUP BY doc_id, run),
rest AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM spans UNION ALL SELECT doc_id, max(b), NULL FROM spans GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(CASE WHEN b IS NULL THEN substr(x, 2 * a + 1) ELSE substr(x, 2 * a + 1, 2 * (b - a)) END, '' ORDER BY a) AS y FROM rest JOIN d USING (doc_id) GROUP BY doc_id),
n AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, length(x) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(y, x))) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_WORDS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
# By definition, without masks: all places where a word of an item stands in a document, by diagonal; those that hold enough are compared window by window.
LEAKS = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
dp AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
bp AS (SELECT item_id, least({WINDOW}, len(w)) AS wide, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM b),
hits AS (SELECT doc_id, item_id, dp.p - bp.p AS diagonal FROM dp JOIN bp USING (word) GROUP BY ALL HAVING count(*) * 100 >= any_value(wide) * {SHARE}),
lined AS (SELECT doc_id, item_id, d.w AS dw, b.w AS bw, greatest(0, diagonal) AS start, greatest(0, -diagonal) AS skip,
  least(len(d.w) - greatest(0, diagonal), len(b.w) - greatest(0, -diagonal)) AS n, least({WINDOW}, len(b.w)) AS wide FROM hits JOIN d USING (doc_id) JOIN b USING (item_id)),
placed AS (SELECT *, unnest(range(0, n - wide + 1)) AS i FROM lined WHERE n >= wide),
summed AS (SELECT doc_id, item_id, len(bw) AS n_words, wide, start + i AS place, list_sum(list_transform(range(1, wide + 1), lambda k: CASE WHEN dw[start + i + k] = bw[skip + i + k] THEN 1 ELSE 0 END)) AS n_equal FROM placed)
SELECT doc_id, item_id, CAST(any_value(n_words) AS INTEGER) AS n_words, CAST(max(n_equal) AS INTEGER) AS n_equal, CAST(any_value(wide) AS INTEGER) AS n_compared,
  CAST(arg_min(place, (-n_equal, place)) AS INTEGER) AS place FROM summed WHERE n_equal * 100 >= wide * {SHARE} GROUP BY doc_id, item_id
"""


def _kind(no: int) -> str:
    rule = RULES[no]
    pattern = rule.pattern.replace("'", "''")
    return f"""SELECT doc_id, {no} AS no, string_split(regexp_replace(t, '{pattern}', '{OPEN}\\0{MID}\\{rule.keep}{SHUT}', 'g'), '{OPEN}') AS pieces, {rule.least} AS least FROM clean"""


_NAMES = "[" + ", ".join(f"'{r.kind}'" for r in RULES) + "]"
SECRETS = f"""
WITH clean AS (SELECT doc_id, translate(coalesce(text, ''), '{OPEN}{MID}{SHUT}', '{chr(0xFFFD) * 3}') AS t FROM documents),
marked AS ({" UNION ALL ".join(_kind(i) for i in range(len(RULES)))}),
opened AS (SELECT doc_id, no, least, length(pieces[1]) AS lead, unnest(pieces[2:]) AS piece, generate_subscripts(pieces[2:], 1) AS i FROM marked WHERE len(pieces) > 1),
cut AS (SELECT *, length(split_part(piece, '{MID}', 1)) AS m, length(split_part(split_part(piece, '{SHUT}', 1), '{MID}', 2)) AS g, length(split_part(piece, '{SHUT}', 2)) AS rest FROM opened),
placed AS (SELECT doc_id, no, g, least, m, lead + coalesce(sum(m + rest) OVER (PARTITION BY doc_id, no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM cut),
spans AS (SELECT doc_id, no, s, {_NAMES}[no + 1] || ':' || CAST(s AS BIGINT) || ':' || CAST(s + m AS BIGINT) AS name FROM placed WHERE g >= least),
by_doc AS (SELECT doc_id, count(*) FILTER (WHERE no = 0) AS a, count(*) FILTER (WHERE no = 1) AS b, count(*) FILTER (WHERE no = 2) AS c,
  string_agg(name, ',' ORDER BY s, no) FILTER (WHERE no < 3) AS base, string_agg(name, ',' ORDER BY s, no) AS names FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(names, '') AS spans
FROM documents d LEFT JOIN by_doc USING (doc_id)
"""
