"""DuckDB SQL for the queries of the catalogue, written independently of the Spark plans (windows, unnesting, recursion)."""

from __future__ import annotations

NOTES = "['<NOTE_32>','<NOTE_DOT_32>','<NOTE_16>','<NOTE_DOT_16>','<NOTE_8>','<NOTE_DOT_8>','<NOTE_4>','<NOTE_DOT_4>','<NOTE_2>','<NOTE_DOT_2>','<NOTE_1>','<NOTE_DOT_1>']"
BEATS = "[0.125,0.1875,0.25,0.375,0.5,0.75,1.0,1.5,2.0,3.0,4.0,6.0]"
CHARS = "['感','受','停','在','AP','我','发','SP','端','指']"
DIM = f"dim AS (SELECT unnest({NOTES}) AS note, CAST(unnest({BEATS}) AS DOUBLE) AS beats)"
BPM = "'<BPM_' || CASE WHEN {0} BETWEEN 0 AND 255 THEN {0} ELSE 120 END || '>'"

GT = f"""
lines AS (SELECT l_orderkey AS sid, l_partkey AS part, l_suppkey AS supp, CAST(row_number() OVER (PARTITION BY l_orderkey
  ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) - 1 AS INTEGER) AS k FROM lineitem),
notes_gt AS (SELECT sid, k, CAST(60 + supp % 3 AS INTEGER) AS pitch, {NOTES}[part % 12 + 1] AS note,
  CASE WHEN k % 2 = 1 THEN '·' ELSE {CHARS}[(sid + 3 * k) % 10 + 1] END AS ch, CAST(sid % 300 AS INTEGER) AS bpm, part, supp FROM lines)"""
PRED = f"""
notes_pred AS (SELECT sid, k, pitch + CASE WHEN supp % 5 = 0 THEN 1 ELSE 0 END AS pitch,
  {NOTES}[(part % 12 + CASE WHEN supp % 4 = 0 THEN 1 ELSE 0 END) % 12 + 1] AS note,
  CASE WHEN k = 0 AND sid % 4 = 0 THEN '端' ELSE ch END AS ch FROM notes_gt WHERE part % 11 <> 0 AND sid % 97 <> 0)"""
TEXTS = f"""{GT},{PRED},
gt_texts AS (SELECT sid, string_agg(ch || ' <P_' || pitch || '> ' || note, ' ' ORDER BY k) || ' ' || {BPM.format('any_value(bpm)')} AS gt_text FROM notes_gt GROUP BY sid),
pred_texts AS (SELECT s.sid, coalesce(p.body || ' ', '') || {BPM.format('s.b')} AS pred_text
  FROM (SELECT sid, any_value(bpm) + CASE WHEN sid % 6 = 0 THEN 5 ELSE 0 END AS b FROM notes_gt GROUP BY sid) s
  LEFT JOIN (SELECT sid, string_agg(ch || ' <P_' || pitch || '> ' || note, ' ' ORDER BY k) AS body FROM notes_pred GROUP BY sid) p USING (sid))"""
DAMAGED = f"""{TEXTS},
damaged AS (SELECT sid, CASE sid % 5
  WHEN 0 THEN replace(gt_text, '<P_61>', '<P_x>')
  WHEN 1 THEN substr(gt_text, 1, CAST(floor(length(gt_text) * 2 / 3.0) AS INTEGER))
  WHEN 2 THEN '<NOTE_4> <BPM_7> language ' || replace(gt_text, '<NOTE_4>', '<NOTE_5>') || ' </s>'
  WHEN 3 THEN '感受<|file_sep|>' || replace(gt_text, ' ', '　')
  ELSE replace(gt_text, '> <', '><') END AS text FROM gt_texts)"""


def parsed(name: str, source: str, text: str = "text") -> str:
    """CTEs ``<name>_e`` (sid, entry_idx, word, pitch, note) and ``<name>_b`` (sid, bpm) of a source (sid, text)."""
    return f"""
{name}_t AS (SELECT sid, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM (SELECT sid,
  regexp_extract_all(string_split({text}, '<|file_sep|>')[-1], '<[^>]+>|[^\\s\\x1c-\\x1f\\x{{85}}\\p{{Z}}<>]+') AS toks FROM {source})),
{name}_s AS (SELECT *, regexp_full_match(tok, '<P_[0-9]+>') AS is_p, sum(CASE WHEN regexp_full_match(tok, '<P_[0-9]+>') THEN 1 ELSE 0 END)
  OVER (PARTITION BY sid ORDER BY pos) AS seg FROM {name}_t WHERE NOT ends_with(tok, '/s>')),
{name}_p AS (SELECT sid, seg, CAST(regexp_extract(tok, '[0-9]+') AS INTEGER) AS pitch FROM {name}_s WHERE is_p),
{name}_w AS (SELECT sid, seg + 1 AS seg, arg_max(tok, pos) AS word FROM {name}_s
  WHERE NOT starts_with(tok, '<') AND tok NOT IN ('language','Chinese','English','Japanese','Korean') GROUP BY sid, seg),
{name}_n AS (SELECT sid, seg, arg_min(tok, pos) AS note FROM {name}_s WHERE list_contains({NOTES}, tok) GROUP BY sid, seg),
{name}_e AS (SELECT p.sid, CAST(p.seg - 1 AS INTEGER) AS entry_idx, coalesce(w.word, '·') AS word, p.pitch, coalesce(n.note, '<NOTE_4>') AS note
  FROM {name}_p p LEFT JOIN {name}_w w USING (sid, seg) LEFT JOIN {name}_n n USING (sid, seg)),
{name}_b AS (SELECT s.sid, coalesce(b.bpm, 120) AS bpm FROM (SELECT DISTINCT sid FROM {source}) s LEFT JOIN
  (SELECT sid, CAST(regexp_extract(arg_max(tok, pos), '[0-9]+') AS INTEGER) AS bpm FROM {name}_s WHERE regexp_full_match(tok, '<BPM_[0-9]+>') GROUP BY sid) b USING (sid))"""


def worded(name: str) -> str:
    """CTEs ``<name>_wn`` (entries with word_idx), ``<name>_words`` (sid, word_idx, char) and ``<name>_m`` (tied pairs merged: sid, word_idx, run, pitch, note)."""
    return f"""
{name}_wn AS (SELECT *, CAST(sum(CASE WHEN word <> '·' OR entry_idx = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY sid ORDER BY entry_idx) - 1 AS INTEGER) AS word_idx FROM {name}_e),
{name}_words AS (SELECT sid, word_idx, arg_min(word, entry_idx) AS char, count(*) AS n_pairs, string_agg(pitch || ' ' || note, ',' ORDER BY entry_idx) AS pairs FROM {name}_wn GROUP BY sid, word_idx),
{name}_l AS (SELECT *, CASE WHEN lag(pitch) OVER w = pitch THEN 0 ELSE 1 END AS fresh FROM {name}_wn WINDOW w AS (PARTITION BY sid, word_idx ORDER BY entry_idx)),
{name}_r AS (SELECT *, sum(fresh) OVER (PARTITION BY sid, word_idx ORDER BY entry_idx) AS run FROM {name}_l),
{name}_q AS (SELECT sid, word_idx, run, any_value(r.pitch) AS pitch, count(*) AS n, sum(d.beats) AS beats, arg_min(r.note, entry_idx) AS first_note
  FROM {name}_r r JOIN dim d USING (note) GROUP BY sid, word_idx, run),
{name}_m AS (SELECT q.sid, q.word_idx, CAST(q.run - 1 AS INTEGER) AS pos, q.pitch, CASE WHEN q.n = 1 THEN q.first_note ELSE
  (SELECT arg_min(d.note, (abs(d.beats - q.beats), d.beats)) FROM dim d) END AS note FROM {name}_q q)"""


def nw(name: str, source: str, same: str = "{0} = {1}") -> str:
    """CTE ``<name>`` (id, step, g, p) of alignments of a source (id, a, b: lists), by recursion over rows of the table and back; ``same`` tells
    which elements are equal."""
    return f"""
{name}_dp AS (SELECT id, a, b, 0 AS i, range(0, len(b) + 1) AS cost FROM {source}
  UNION ALL
  SELECT id, a, b, i + 1, list_transform(range(0, len(b) + 1), lambda j: list_min(list_transform(range(0, j + 1), lambda k:
    j - k + CASE WHEN k = 0 THEN i + 1 ELSE least(cost[k + 1] + 1, cost[k] + CASE WHEN {same.format('a[i + 1]', 'b[k]')} THEN 0 ELSE 1 END) END)))
  FROM {name}_dp WHERE i < len(a)),
{name}_tb AS (SELECT id, len(a) AS i, len(b) AS j, 0 AS step, CAST(NULL AS BIGINT) AS g, CAST(NULL AS BIGINT) AS p FROM {source}
  UNION ALL
  SELECT id, CASE WHEN move < 2 THEN i - 1 ELSE i END, CASE WHEN move <> 1 THEN j - 1 ELSE j END, step + 1,
    CASE WHEN move < 2 THEN i - 1 END, CASE WHEN move <> 1 THEN j - 1 END
  FROM (SELECT t.id, t.i, t.j, t.step, CASE
      WHEN t.i > 0 AND t.j > 0 AND here.cost[t.j + 1] = up.cost[t.j] + CASE WHEN {same.format('here.a[t.i]', 'here.b[t.j]')} THEN 0 ELSE 1 END THEN 0
      WHEN t.i > 0 AND here.cost[t.j + 1] = up.cost[t.j + 1] + 1 THEN 1 ELSE 2 END AS move
    FROM {name}_tb t JOIN {name}_dp here ON here.id = t.id AND here.i = t.i LEFT JOIN {name}_dp up ON up.id = t.id AND up.i = t.i - 1
    WHERE t.i > 0 OR t.j > 0)),
{name} AS (SELECT id, max(step) OVER (PARTITION BY id) - step AS step, CAST(g AS INTEGER) AS g, CAST(p AS INTEGER) AS p FROM {name}_tb WHERE step > 0)"""


SCORED = f"""{TEXTS}, {DIM},{parsed('g', 'gt_texts', 'gt_text')},{parsed('p', 'pred_texts', 'pred_text')},{worded('g')},{worded('p')},
gl AS (SELECT sid, list(char ORDER BY word_idx) AS a FROM g_words GROUP BY sid),
pl AS (SELECT sid, list(char ORDER BY word_idx) AS b FROM p_words GROUP BY sid),
wsrc AS (SELECT sid AS id, a, coalesce(b, CAST([] AS VARCHAR[])) AS b FROM gl LEFT JOIN pl USING (sid)),
lsrc AS (SELECT id, list_filter(a, lambda x: x NOT IN ('AP', 'SP')) AS a, list_filter(b, lambda x: x NOT IN ('AP', 'SP')) AS b FROM wsrc)"""
METRICS = f"""{SCORED},{nw('wal', 'wsrc')},{nw('lal', 'lsrc')},
faced AS (SELECT w.id AS sid, w.g, w.p FROM wal w JOIN pl ON pl.sid = w.id WHERE w.g IS NOT NULL AND w.p IS NOT NULL),
gm AS (SELECT sid, word_idx, list(pitch || ' ' || note ORDER BY pos) AS s FROM g_m GROUP BY sid, word_idx),
pm AS (SELECT sid, word_idx, list(pitch || ' ' || note ORDER BY pos) AS s FROM p_m GROUP BY sid, word_idx),
psrc AS (SELECT f.sid || ':' || f.g || ':' || f.p AS id, f.sid, f.g, f.p, gm.s AS a, pm.s AS b FROM faced f JOIN gm ON gm.sid = f.sid AND gm.word_idx = f.g JOIN pm ON pm.sid = f.sid AND pm.word_idx = f.p),
{nw('pal', 'psrc')},
pairs AS (SELECT s.sid, CAST(string_split(s.a[x.g + 1], ' ')[1] AS INTEGER) AS gp, string_split(s.a[x.g + 1], ' ')[2] AS gn, CAST(string_split(s.b[x.p + 1], ' ')[1] AS INTEGER) AS pp, string_split(s.b[x.p + 1], ' ')[2] AS pn
  FROM pal x JOIN psrc s USING (id) WHERE x.g IS NOT NULL AND x.p IS NOT NULL),
perr AS (SELECT pairs.sid, avg(abs(gp - pp)) AS pitch_mae, avg(abs(log2(gd.beats) - log2(pd.beats))) AS note_mae,
    avg(abs(log2(gd.beats * 60.0 / greatest(gb.bpm, 1)) - log2(pd.beats * 60.0 / greatest(pb.bpm, 1)))) AS dur_mae,
    avg(CASE WHEN gp <> pp THEN 1.0 ELSE 0.0 END) AS pitch_error_rate, count(*) AS n
  FROM pairs JOIN dim gd ON gd.note = gn JOIN dim pd ON pd.note = pn JOIN g_b gb ON gb.sid = pairs.sid JOIN p_b pb ON pb.sid = pairs.sid GROUP BY pairs.sid),
nne AS (SELECT sid, avg(abs(len(a) - len(b))) AS note_num_mean_error FROM psrc GROUP BY sid),
lerr AS (SELECT l.id AS sid, sum(CASE WHEN x.g IS NULL OR x.p IS NULL OR l.a[x.g + 1] <> l.b[x.p + 1] THEN 1 ELSE 0 END) AS e FROM lsrc l JOIN lal x USING (id) GROUP BY l.id),
metrics AS (SELECT w.id AS sid,
    round(CASE WHEN pl.sid IS NULL THEN 1.0 WHEN len(l.a) = 0 THEN CASE WHEN len(l.b) = 0 THEN 0.0 ELSE 1.0 END ELSE coalesce(lerr.e, 0) / len(l.a) END, 6) AS cer,
    round(perr.pitch_mae, 6) AS pitch_mae, round(perr.note_mae, 6) AS note_mae, round(perr.dur_mae, 6) AS dur_mae,
    CASE WHEN pl.sid IS NOT NULL THEN CAST(abs(g_b.bpm - p_b.bpm) AS DOUBLE) END AS bpm_mae,
    CAST(len(w.a) AS INTEGER) AS n_gt_words, CAST(len(w.b) AS INTEGER) AS n_pred_words, CAST(coalesce(perr.n, 0) AS INTEGER) AS n_aligned_pairs,
    round(perr.pitch_error_rate, 6) AS pitch_error_rate, round(nne.note_num_mean_error, 6) AS note_num_mean_error, len(l.a) AS n_gl, len(l.b) AS n_pl, pl.sid IS NOT NULL AS readable
  FROM wsrc w JOIN lsrc l USING (id) LEFT JOIN pl ON pl.sid = w.id LEFT JOIN perr ON perr.sid = w.id LEFT JOIN nne ON nne.sid = w.id LEFT JOIN lerr ON lerr.sid = w.id
  JOIN g_b ON g_b.sid = w.id JOIN p_b ON p_b.sid = w.id)"""
ANNOTATIONS = f"""{GT},
ann AS (SELECT sid, list(ch ORDER BY k) FILTER (WHERE k % 2 = 0) AS word, list(pitch ORDER BY k)[1:CASE WHEN sid % 7 = 0 THEN count(*) - 1 ELSE count(*) END] AS pitch,
  list(note ORDER BY k)[1:CASE WHEN sid % 5 = 0 THEN count(*) - 1 ELSE count(*) END] AS note, count(*) AS n FROM notes_gt GROUP BY sid),
links AS (SELECT sid, k, CASE WHEN sid % 11 = 0 AND k = n - 1 THEN k // 2 + 1 ELSE k // 2 END AS w FROM notes_gt JOIN ann USING (sid)),
syl AS (SELECT a.sid, l.w AS word_no, l.k, a.word[l.w + 1] AS char, CASE WHEN l.k < len(a.pitch) THEN a.pitch[l.k + 1] ELSE 0 END AS pitch,
  CASE WHEN l.k < len(a.note) THEN a.note[l.k + 1] ELSE '<NOTE_4>' END AS note FROM links l JOIN ann a USING (sid) WHERE l.w < len(a.word))"""


def packed(name: str, weight: str, budget: int, cap: int, parts: int = 1, order: str = "n_chars, doc_id", source: str = "documents") -> str:
    """CTE of the greedy packing of documents (or another source of doc_id and n_chars) by ``order``, in parts of equal numbers of rows; ``weight`` is a batch's with the next row."""
    return f"""
ord AS (SELECT doc_id, n_chars AS n, row_number() OVER (ORDER BY {order}) AS r, (row_number() OVER (ORDER BY {order}) - 1) * {parts} // count(*) OVER () AS part FROM {source}),
{name} AS (SELECT r, doc_id, n, part, CAST(0 AS BIGINT) AS batch_id, CAST(0 AS INTEGER) AS pos, CAST(n AS HUGEINT) AS total, n AS most FROM ord WHERE r = 1
  UNION ALL
  SELECT o.r, o.doc_id, o.n, o.part, CASE WHEN c THEN b + 1 ELSE b END, CASE WHEN c THEN 0 ELSE p + 1 END, CASE WHEN c THEN o.n ELSE t + o.n END, CASE WHEN c THEN o.n ELSE greatest(m, o.n) END
  FROM (SELECT x.batch_id AS b, x.pos AS p, x.total AS t, x.most AS m, y.*, {weight} > {budget} OR x.pos + 1 >= {cap} OR x.part <> y.part AS c FROM {name} x JOIN ord y ON y.r = x.r + 1) o)"""


SUM_W, PAD_W = "x.total + y.n", "(x.pos + 2) * greatest(x.most, y.n)"
PACK = packed("pk", SUM_W, 24000, 32)

ORACLE_SQL = {
    "align_native": f"WITH RECURSIVE {SCORED},{nw('wal', 'wsrc')} SELECT id AS sid, CAST(step AS INTEGER) AS step, g, p FROM wal",
    "vocab_tokens": f"""WITH {TEXTS}, v AS (SELECT 'pitch' AS kind, CAST(range AS INTEGER) AS no, '<P_' || range || '>' AS token FROM range(128)
UNION ALL SELECT 'bpm', CAST(range AS INTEGER), '<BPM_' || range || '>' FROM range(256)
UNION ALL SELECT 'note', CAST(i AS INTEGER), '<NOTE_' || (CASE WHEN i >= 6 THEN 'DOT_' ELSE '' END) || CAST(pow(2, i % 6) AS INTEGER) || '>' FROM range(12) t(i)),
u AS (SELECT unnest(string_split(gt_text, ' ')) AS token FROM gt_texts), c AS (SELECT token, count(*) AS n FROM u GROUP BY token)
SELECT kind, no, token, coalesce(n, 0) AS n FROM v LEFT JOIN c USING (token)""",
    "vocab_legacy": f"""WITH {GT}, {DIM}, v AS (SELECT 'legacy' AS kind, CAST(0 AS INTEGER) AS no, '<SLUR>' AS token UNION ALL SELECT 'legacy', 1, '<SVS_MASK>'
UNION ALL SELECT 'duration', CAST(range AS INTEGER), printf('<dur_%d.%02d>', (range + 1) // 100, (range + 1) % 100) FROM range(1000)),
c AS (SELECT 'duration' AS kind, CAST(floor(beats * 100 * (60.0::DOUBLE / greatest(bpm, 1))) - 1 AS INTEGER) AS no, count(*) AS n FROM notes_gt JOIN dim USING (note) GROUP BY 2)
SELECT kind, no, token, coalesce(n, 0) AS n FROM v LEFT JOIN c USING (kind, no)""",
    "note_durations": f"WITH {GT}, {DIM} SELECT note, beats, beats * 60.0 / 120 AS seconds, count(*) AS n FROM notes_gt JOIN dim USING (note) GROUP BY note, beats",
    "nearest_note": f"WITH {DIM}, b AS (SELECT ((l_partkey * 7 + CAST(l_quantity AS BIGINT)) % 256 + 1) / 32.0 AS beats, count(*) AS n FROM lineitem GROUP BY 1) SELECT CAST(b.beats AS DOUBLE) AS beats, n, (SELECT arg_min(d.note, (abs(d.beats - b.beats), d.beats)) FROM dim d) AS note FROM b",
    "annotation_to_syllables": f"""WITH {ANNOTATIONS}, one AS (SELECT sid, word_no, any_value(char) || ':' || string_agg(CAST(pitch AS VARCHAR), '|' ORDER BY k) || ':' || string_agg(note, '|' ORDER BY k) AS s FROM syl GROUP BY sid, word_no)
SELECT a.sid, coalesce((SELECT string_agg(s, ' ' ORDER BY word_no) FROM one WHERE one.sid = a.sid), '') AS syllables FROM ann a""",
    "expand_melisma": f"""WITH {ANNOTATIONS} SELECT sid, CAST(row_number() OVER (PARTITION BY sid ORDER BY word_no, k) - 1 AS INTEGER) AS note_idx, CAST(dense_rank() OVER (PARTITION BY sid ORDER BY word_no) - 1 AS INTEGER) AS word_idx, char, pitch, note FROM syl""",
    "lyrics_text": f"WITH {GT} SELECT sid, coalesce(string_agg(ch, '' ORDER BY k) FILTER (WHERE ch NOT IN ('AP', 'SP')), '') AS lyrics FROM notes_gt GROUP BY sid",
    "filter_silence": f"WITH {GT} SELECT sid, CAST(count(*) AS INTEGER) AS n_notes, CAST(count(*) FILTER (WHERE ch NOT IN ('AP', 'SP')) AS INTEGER) AS n_kept FROM notes_gt GROUP BY sid",
    "build_text_last": f"WITH {TEXTS} SELECT sid, gt_text AS text FROM gt_texts",
    "build_text_first": f"WITH {GT} SELECT sid, {BPM.format('any_value(bpm)')} || ' ' || string_agg(ch || ' <P_' || pitch || '> ' || note, ' ' ORDER BY k) AS text FROM notes_gt GROUP BY sid",
    "build_target_cot": f"WITH {TEXTS}, l AS (SELECT sid, coalesce(string_agg(ch, '' ORDER BY k) FILTER (WHERE ch NOT IN ('AP', 'SP')), '') AS lyrics FROM notes_gt GROUP BY sid) SELECT sid, 'language Chinese<asr_text>' || lyrics || '<|file_sep|>' || gt_text AS text FROM gt_texts JOIN l USING (sid)",
    "tokenize_text": """WITH t AS (SELECT doc_id, regexp_extract_all(text, '<[^>]+>|[^\\s\\x1c-\\x1f\\x{85}\\p{Z}<>]+') AS toks FROM documents)
SELECT doc_id, CAST(len(toks) AS INTEGER) AS n_tokens, md5(array_to_string(toks, ' ')) AS tokens_md5 FROM t""",
    "parse_entries": f"WITH {TEXTS},{parsed('g', 'gt_texts', 'gt_text')} SELECT sid, entry_idx, word, pitch, note, bpm FROM g_e JOIN g_b USING (sid)",
    "parse_damaged": f"WITH {DAMAGED},{parsed('d', 'damaged')} SELECT sid, entry_idx, word, pitch, note, bpm FROM d_e JOIN d_b USING (sid)",
    "parse_bpm": f"WITH {DAMAGED},{parsed('d', 'damaged')} SELECT sid, bpm FROM d_b",
    "words_grouped": f"WITH {TEXTS}, {DIM},{parsed('g', 'gt_texts', 'gt_text')},{worded('g')} SELECT sid, word_idx, char, CAST(n_pairs AS INTEGER) AS n_pairs, pairs FROM g_words",
    "tie_merge": f"WITH {TEXTS}, {DIM},{parsed('g', 'gt_texts', 'gt_text')},{worded('g')} SELECT sid, word_idx, string_agg(pitch || ' ' || note, ',' ORDER BY pos) AS pairs FROM g_m GROUP BY sid, word_idx",
    "cer_per_song": f"""WITH {SCORED},
vocab AS (SELECT id, list_distinct(list_concat(a, b)) AS v, a, b FROM lsrc),
ascii AS (SELECT id, array_to_string(list_transform(a, lambda x: chr(CAST(33 + list_position(v, x) AS INTEGER))), '') AS ga, array_to_string(list_transform(b, lambda x: chr(CAST(33 + list_position(v, x) AS INTEGER))), '') AS pb, len(a) AS n FROM vocab)
SELECT id AS sid, CAST(levenshtein(ga, pb) AS INTEGER) AS errors, CAST(n AS INTEGER) AS n_words, round(CASE WHEN n = 0 THEN CASE WHEN pb = '' THEN 0.0 ELSE 1.0 END ELSE levenshtein(ga, pb) / n END, 6) AS cer FROM ascii""",
    "align_words": f"WITH RECURSIVE {SCORED},{nw('wal', 'wsrc')} SELECT id AS sid, CAST(step AS INTEGER) AS step, g, p FROM wal",
    "align_pairs": f"WITH RECURSIVE {METRICS} SELECT s.sid, s.g AS g_word, s.p AS p_word, CAST(x.step AS INTEGER) AS step, x.g, x.p FROM pal x JOIN psrc s USING (id)",
    "metrics_per_song": f"WITH RECURSIVE {METRICS} SELECT sid, cer, pitch_mae, note_mae, dur_mae, bpm_mae, n_gt_words, n_pred_words, n_aligned_pairs FROM metrics",
    "metrics_flags": f"WITH RECURSIVE {METRICS} SELECT sid, pitch_error_rate, note_num_mean_error FROM metrics",
    "metrics_dataset": f"""WITH RECURSIVE {METRICS} SELECT round(avg(cer), 4) AS cer, round(avg(pitch_mae), 4) AS pitch_mae, round(avg(note_mae), 4) AS note_mae, round(avg(dur_mae), 4) AS dur_mae, round(avg(bpm_mae), 4) AS bpm_mae,
  CAST(count(*) AS DOUBLE) AS n_samples, count(*) AS n_total_samples, count(*) FILTER (WHERE n_pred_words > 0) AS n_parseable FROM metrics""",
    "metrics_length_matched": f"""WITH RECURSIVE {METRICS},
gz AS (SELECT sid, word_idx, row_number() OVER (PARTITION BY sid ORDER BY word_idx) AS r FROM g_words WHERE char NOT IN ('AP', 'SP')),
pz AS (SELECT sid, word_idx, row_number() OVER (PARTITION BY sid ORDER BY word_idx) AS r FROM p_words WHERE char NOT IN ('AP', 'SP')),
zsrc AS (SELECT gz.sid || ':' || r AS id, gz.sid, gm.s AS a, pm.s AS b FROM gz JOIN pz USING (sid, r) JOIN gm ON gm.sid = gz.sid AND gm.word_idx = gz.word_idx JOIN pm ON pm.sid = gz.sid AND pm.word_idx = pz.word_idx),{nw('zal', 'zsrc')},
zn AS (SELECT sid, count(*) FILTER (WHERE g IS NOT NULL AND p IS NOT NULL) AS n FROM zal JOIN zsrc USING (id) GROUP BY sid)
SELECT m.sid, m.cer, CAST(CASE WHEN m.readable THEN coalesce(zn.n, 0) ELSE 0 END AS INTEGER) AS n_aligned_pairs FROM metrics m LEFT JOIN zn ON zn.sid = m.sid WHERE NOT m.readable OR m.n_gl = m.n_pl""",
    "split_train_val": "SELECT CASE WHEN coalesce(lang IN ('de', 'fr'), false) THEN 'val' ELSE 'train' END AS part, doc_id, lang FROM documents",
    "split_report": "SELECT lang AS dataset_name, count(*) AS n FROM documents WHERE lang IN ('de', 'fr') GROUP BY lang",
    "split_missing": "SELECT n AS dataset_name FROM (SELECT unnest(['de', 'fr', 'it', 'xx']) AS n) WHERE n NOT IN (SELECT lang FROM documents WHERE lang IS NOT NULL)",
    "source_union_budget": """SELECT dataset_name, sample_id, n_chars FROM (SELECT *, row_number() OVER (ORDER BY part, sample_id) AS r FROM (
  SELECT 'benchmark' AS dataset_name, 0 AS part, item_id AS sample_id, CAST(length(text) AS INTEGER) AS n_chars FROM benchmark
  UNION ALL SELECT 'documents', 1, doc_id, CAST(length(text) AS INTEGER) FROM documents)) WHERE r <= 150""",
    "pack_sum": f"WITH RECURSIVE {PACK} SELECT batch_id, pos, doc_id AS sample_id, n AS length FROM pk",
    "pack_padded": f"WITH RECURSIVE {packed('pk', PAD_W, 24000, 64)} SELECT batch_id, pos, doc_id AS sample_id, n AS length FROM pk",
    "batch_stats": f"WITH RECURSIVE {PACK} SELECT count(DISTINCT batch_id) AS n_batches, round(count(*) / count(DISTINCT batch_id), 6) AS mean_size FROM pk",
    "pack_by_ranges": f"WITH RECURSIVE {packed('pk', SUM_W, 24000, 32, 4)} SELECT batch_id, pos, doc_id AS sample_id, n AS length FROM pk",
    "bucketed_shuffle": "SELECT doc_id, n_chars, CAST((row_number() OVER (ORDER BY n_chars, doc_id) - 1) // greatest(100, count(*) OVER () // 10) AS INTEGER) AS chunk FROM documents",
    "existing_files": "SELECT unnest(['benchmark', 'conversations', 'customer', 'documents', 'embeddings', 'events', 'labels', 'lineitem', 'nation', 'orders', 'pages', 'part', 'region', 'supplier']) || '.parquet' AS name",
    "pad_frames": "SELECT event_id, 4 * 160 AS n_bytes, CAST(event_id % 5 AS INTEGER) AS n_real, 4 AS n_mask FROM events",
    "pack_drop_last": f"WITH RECURSIVE {PACK}, s AS (SELECT batch_id, count(*) AS n FROM pk GROUP BY batch_id) SELECT batch_id, count(*) AS n FROM pk WHERE NOT (batch_id = (SELECT max(batch_id) FROM pk) AND (SELECT arg_max(n, batch_id) FROM s) < 40) GROUP BY batch_id",
    "rank_shards": f"WITH RECURSIVE {PACK} SELECT CAST(batch_id % 4 AS INTEGER) AS rank, count(DISTINCT batch_id) AS n_batches, count(*) AS n_samples FROM pk GROUP BY 1",
    "pad_world": f"WITH RECURSIVE {PACK}, m AS (SELECT max(batch_id) + 1 AS n FROM pk) SELECT i AS batch_id, i % n AS source_id FROM m, range(0, 1000000) r(i) WHERE i < ((n + 6) // 7) * 7",
    "length_stats": "SELECT min(n_chars) AS min_len, max(n_chars) AS max_len, round(avg(n_chars), 6) AS avg_len, count(*) AS n FROM documents",
    "encoder_length": "SELECT doc_id, CAST(n_chars AS INTEGER) AS mel_frames, CAST(ceil((n_chars % 100) / 8.0) + 13 * (n_chars // 100) AS INTEGER) AS audio_tokens FROM documents",
    "frame_count": "SELECT doc_id, CAST((n_chars * 40 * 100) // 16000 AS INTEGER) AS mel_frames FROM documents",
    "expand_placeholder": """SELECT l_orderkey AS sid, CASE WHEN l_orderkey % 3 = 0 THEN '5,9,6' ELSE '5,' || array_to_string(list_transform(range(greatest(l_orderkey % 7, 1)), lambda x: 9), ',') || ',6' END AS ids,
  CAST(CASE WHEN l_orderkey % 3 = 0 OR l_orderkey % 7 < 2 THEN 2 ELSE 1 + l_orderkey % 7 END AS INTEGER) AS prefix FROM (SELECT DISTINCT l_orderkey FROM lineitem)""",
    "label_mask": f"WITH {GT} SELECT sid, string_agg(CASE WHEN k < 2 OR pitch = 61 THEN '-100' ELSE CAST(pitch AS VARCHAR) END, ',' ORDER BY k) AS labels FROM notes_gt GROUP BY sid",
    "left_pad": f"""WITH {GT}, s AS (SELECT sid, list(pitch ORDER BY k) AS ids, max(count(*)) OVER (PARTITION BY sid % 100) AS most FROM notes_gt GROUP BY sid)
SELECT sid, array_to_string(list_concat(list_transform(range(most - len(ids)), lambda x: 0), ids), ',') AS ids, array_to_string(list_concat(list_transform(range(most - len(ids)), lambda x: 0), list_transform(ids, lambda x: 1)), ',') AS mask, CAST(most - len(ids) AS INTEGER) AS pad_offset FROM s""",
    "right_pad": f"""WITH {GT}, s AS (SELECT sid, list(pitch ORDER BY k) AS ids, max(count(*)) OVER (PARTITION BY sid % 100) AS most FROM notes_gt GROUP BY sid)
SELECT sid, array_to_string(list_concat(ids, list_transform(range(most - len(ids)), lambda x: 0)), ',') AS ids, array_to_string(list_concat(list_transform(ids, lambda x: 1), list_transform(range(most - len(ids)), lambda x: 0)), ',') AS mask, CAST(0 AS INTEGER) AS pad_offset FROM s""",
    "generated_slice": f"WITH {GT} SELECT sid, coalesce(string_agg(CAST(pitch AS VARCHAR), ',' ORDER BY k) FILTER (WHERE k >= 3), '') AS ids FROM notes_gt GROUP BY sid",
    "fit_length": f"WITH {GT}, s AS (SELECT sid, list(pitch ORDER BY k) AS ids FROM notes_gt GROUP BY sid) SELECT sid, array_to_string(list_concat(ids[1:4], list_transform(range(greatest(4 - len(ids), 0)), lambda x: 0)), ',') AS ids FROM s",
    "score_geometry": f"WITH {GT}, {DIM} SELECT sid, k, beats AS width, coalesce(sum(beats) OVER (PARTITION BY sid ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS start FROM notes_gt JOIN dim USING (note)",
    "semi_join_files": "SELECT l_orderkey AS sid, count(*) AS n FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F') GROUP BY 1",
    "latest_checkpoint": "SELECT 'checkpoint-' || max(o_orderkey) AS name, max(o_orderkey) AS step FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 3 <> 0",
    "step_rates": """WITH l AS (SELECT user_id AS run, event_id AS step, value, event_id - lag(event_id) OVER w AS done, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS took FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT run, step, round(value / 4, 6) AS loss, CASE WHEN done > 0 AND took > 0 THEN round(done * 1e6 / took, 2) END AS steps_per_second FROM l""",
    "align_documents": """WITH t AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '<[^>]+>|[^\\s\\x1c-\\x1f\\x{85}\\p{Z}<>]+')) AS n FROM documents)
SELECT doc_id, CAST(n AS INTEGER) AS n_words, CAST((n + 3) // 7 AS INTEGER) AS n_gaps, CAST(n - (n + 3) // 7 AS INTEGER) AS n_equal FROM t""",
    "align_tolerant": f"""WITH RECURSIVE {GT},{PRED}, {DIM},
ga AS (SELECT sid, list({{'pitch': pitch, 'beats': beats}} ORDER BY k) AS a FROM notes_gt JOIN dim USING (note) GROUP BY sid),
pb AS (SELECT sid, list({{'pitch': pitch, 'beats': beats}} ORDER BY k) AS b FROM notes_pred JOIN dim USING (note) GROUP BY sid),
src AS (SELECT sid AS id, a, coalesce(b, a[1:0]) AS b FROM ga LEFT JOIN pb USING (sid)),{nw('al', 'src', 'abs({0}.pitch - {1}.pitch) <= 1 AND greatest({0}.beats, {1}.beats) <= 1.5 * least({0}.beats, {1}.beats)')}
SELECT id AS sid, CAST(step AS INTEGER) AS step, g, p FROM al""",
    "pack_blocks": f"WITH RECURSIVE {PACK} SELECT batch_id, pos, doc_id AS sample_id, n AS length FROM pk",
    "pack_padded_blocks": f"WITH RECURSIVE {packed('pk', PAD_W, 24000, 64)} SELECT batch_id, pos, doc_id AS sample_id, n AS length FROM pk",
    "row_numbers": "SELECT doc_id, row_number() OVER (ORDER BY lang NULLS FIRST, n_chars, doc_id) - 1 AS no FROM documents",
    "json_roundtrip": f"WITH {GT} SELECT sid, CAST(count(*) AS INTEGER) AS n, string_agg(ch, '' ORDER BY k) AS chars FROM notes_gt GROUP BY sid",
    "first_samples": "SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 25",
    "status_counts": """SELECT count(*) FILTER (WHERE s = 'ok') AS num_samples, count(*) FILTER (WHERE s = 'error') AS errors, count(*) FILTER (WHERE s = 'missing') AS skipped_missing,
  coalesce(CAST(sum(CASE WHEN s = 'ok' THEN f * 16 END) AS BIGINT), 0) AS total_bytes, round(coalesce(sum(CASE WHEN s = 'ok' THEN f END), 0) / greatest(count(*) FILTER (WHERE s = 'ok'), 1), 1) AS avg_mel_frames
FROM (SELECT CASE WHEN event_id % 10 = 0 THEN 'missing' WHEN event_id % 10 = 1 THEN 'error' ELSE 'ok' END AS s, event_id % 5 AS f FROM events)""",
    "transcribe_stub": "SELECT doc_id AS sample_id, '<P_' || (60 + length(text) % 12) || '>' AS pitch, CAST(length(text) % 256 AS INTEGER) AS bpm FROM documents",
    "metrics_scalars": f"""WITH RECURSIVE {METRICS}, a AS (SELECT avg(cer) AS cer, avg(pitch_mae) AS pitch_mae, avg(note_mae) AS note_mae, avg(dur_mae) AS dur_mae, avg(bpm_mae) AS bpm_mae FROM metrics)
SELECT CAST(7 AS INTEGER) AS step, 'eval/' || name AS key, round(value, 4) AS value FROM (UNPIVOT a ON cer, pitch_mae, note_mae, dur_mae, bpm_mae)""",
}
