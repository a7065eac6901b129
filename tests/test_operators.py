"""Goldens of single operators, and properties of them against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreforge.functions import tensors, vocab
from scoreforge.operators import align, annotate, batching, encode, metrics, numbering, parse, report, splits, words
from scoreforge.operators.parse import SEPARATOR
from scoreforge.sources import annotations

S = "感 <P_68> <NOTE_4> 受 <P_60> <NOTE_8> AP <P_0> <NOTE_8> 停 <P_62> <NOTE_4> <BPM_120>"


def one(spark, value):
    return spark.range(1).select(value.alias("v")).first()["v"]


def test_text_and_lyrics(spark):
    a = spark.createDataFrame([(["感", "受", "AP"], [68, 60, 62, 0], ["<NOTE_4>", "<NOTE_8>", "<NOTE_8>", "<NOTE_4>"], [0, 1, 1, 2], 89)], "w array<string>, p array<int>, n array<string>, l array<int>, bpm int")
    s = annotate.syllables(*map(F.col, "wpnl"))
    r = a.select(s.alias("s"), encode.text(s, F.col("bpm")).alias("t"), encode.text(s, F.col("bpm"), "none").alias("u"), annotate.lyrics(s).alias("l")).first()
    assert [(x.char, x.pitch, x.note) for x in r.s] == [("感", [68], ["<NOTE_4>"]), ("受", [60, 62], ["<NOTE_8>", "<NOTE_8>"]), ("AP", [0], ["<NOTE_4>"])]
    assert r.t == "感 <P_68> <NOTE_4> 受 <P_60> <NOTE_8> <P_62> <NOTE_8> AP <P_0> <NOTE_4> <BPM_89>"
    assert "BPM" not in r.u and r.l == "感受"


@pytest.mark.parametrize("bpm,token", [(300, "<BPM_120>"), (-1, "<BPM_120>"), (0, "<BPM_0>"), (255, "<BPM_255>")])
def test_bpm_token(spark, bpm, token):
    assert one(spark, vocab.bpm_token(F.lit(bpm))) == token


def test_annotation_edges(spark):
    a = spark.createDataFrame([(["a", "b", "c"], [128, None], ["<NOTE_4>", "x", "<NOTE_8>"], [0, 0, 2, 2, 9])], "w array<string>, p array<int>, n array<string>, l array<int>")
    s = annotate.syllables(*map(F.col, "wpnl"))
    r = a.select(s.alias("s"), encode.text(s, F.lit(60)).alias("t")).first()
    assert [(x.char, x.pitch, x.note) for x in r.s] == [("a", [128, None], ["<NOTE_4>", "x"]), ("c", [0, 0], ["<NOTE_8>", "<NOTE_4>"])]
    assert r.t == "a <NOTE_4> c <P_0> <NOTE_8> <P_0> <NOTE_4> <BPM_60>"


# text -> (bpm, entries)
PARSED = [
    ("<BPM_89> 感 <P_68><NOTE_DOT_16> 受 <P_60><NOTE_8>", 89, [("感", 68, "DOT_16"), ("受", 60, "8")]),
    ("感 <P_68><NOTE_8> · <P_70><NOTE_4>", 120, [("感", 68, "8"), ("·", 70, "4")]),
    (f"感受{SEPARATOR}感 <P_68> <NOTE_4> 受 <P_60> <NOTE_8> <BPM_89>", 89, [("感", 68, "4"), ("受", 60, "8")]),
    ("感 <P_68> 受 <P_60> <NOTE_8>", 120, [("感", 68, "4"), ("受", 60, "8")]),
    ("<NOTE_4> 感 <P_68> <NOTE_8> <NOTE_4>", 120, [("感", 68, "8")]),
    ("感 受 <P_60>", 120, [("受", 60, "4")]),
    ("<P_60> <NOTE_8>", 120, [("·", 60, "8")]),
    ("感 <P_x> <P_61> <NOTE_7>", 120, [("感", 61, "4")]),
    ("language Chinese<asr_text>感 <P_60 <NOTE_4> 受 <P_61> </s>", 120, [("受", 61, "4")]),
    ("感　受 <P_60> <BPM_300> <BPM_x>", 300, [("受", 60, "4")]),
    ("language <P_60>", 120, [("·", 60, "4")]),
    ("感 <P_200> <NOTE_4>", 120, [("感", 200, "4")]),
    ("感受 <BPM_90>", None, None),
    ("", None, None),
    (None, None, None),
]


def test_parse(spark):
    got = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(PARSED)], "i int, t string").select("i", parse.parse(F.col("t")).alias("s")).orderBy("i").collect()
    for r, (text, bpm, want) in zip(got, PARSED):
        assert (r.s and (r.s.bpm, [(e.word, e.pitch, e.note) for e in r.s.entries])) == (bpm and (bpm, [(w, p, f"<NOTE_{n}>") for w, p, n in want])), text


def test_parse_random(spark):
    """Against the window form of the same in DuckDB."""
    import duckdb
    import pandas as pd

    from scoreforge.plans import oracles

    rng = random.Random(4)
    parts = ["感", "受", "·", "<P_60>", "<P_61>", "<P_", "<P_x>", "<NOTE_4>", "<NOTE_8>", "<NOTE_9>", "<BPM_90>", "<BPM_7", ">", "</s>", "<asr_text>", "language", SEPARATOR, "a/s", "　", "<x"]
    texts = pd.DataFrame([(i, "".join(rng.choice(parts) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(0, 25)))) for i in range(1500)], columns=["sid", "text"])
    con = duckdb.connect()
    con.register("texts", texts)
    want = con.sql(f"WITH {oracles.parsed('d', 'texts')} SELECT sid, entry_idx, word, pitch, note, bpm FROM d_e JOIN d_b USING (sid) ORDER BY 1, 2").fetchall()
    got = spark.createDataFrame(texts.values.tolist(), "sid long, text string").select("sid", parse.parse(F.col("text")).alias("s")).where("s is not null")
    got = got.select("sid", F.posexplode("s.entries").alias("k", "e"), "s.bpm").select("sid", "k", "e.word", "e.pitch", "e.note", "bpm").orderBy("sid", "k").collect()
    assert [tuple(r) for r in got] == want


def test_texts_of_a_batch_are_read_as_parsed(spark, monkeypatch):
    """Together and in numpy, or one by one and native: the same words, notes and tempos, whatever the cuts between batches."""
    import pyarrow as pa

    from scoreforge.operators import reading

    rng = random.Random(6)
    parts = ["感", "受", "·", "AP", "<P_60>", "<P_60>", "<P_61>", "<P_062>", "<P_4294967297>", "<P_", "<P_x>", "<>", "<NOTE_4>", "<NOTE_DOT_8>", "<NOTE_9>", "<BPM_90>", "<BPM_007>", "<BPM_99999999999>", "<BPM_7", ">", "</s>", "<asr_text>", "language", SEPARATOR, "a/s", "\u3000", "\x85", "\x1d", "\u200b", "\ufdd0", "<x", "é", "😀"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", "\n", "\xa0"]) for _ in range(rng.randint(0, 25))) for _ in range(1500)] + [t for t, _, _ in PARSED] + [None, "<", "<P_1>", "a" * 70]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", parse.parse(F.col("t")).alias("s"))
    ws = F.transform(words.words(F.col("s.entries")), lambda w: F.struct(w["char"].alias("c"), words.merged(w["pairs"]).alias("m")))
    want = [r.s and (r.s.bpm, [(w.c, [(p.pitch, p.note) for p in w.m]) for w in r.w]) for r in rows.select("i", "s", ws.alias("w")).orderBy("i").collect()]
    for size in (reading.BYTES, 64):
        monkeypatch.setattr(reading, "BYTES", size)
        names = {}
        x = reading.read(pa.array([None, *texts, ""]).slice(1, len(texts)), names)
        named, notes = list(names), list(reading.NOTES)
        pairs = lambda w: [(None if x.pitch[k] < 0 else x.pitch[k], notes[x.note[k]]) for k in range(x.note_offs[w], x.note_offs[w + 1])]
        got = [(x.bpm[i], [(named[x.chars[w]], pairs(w)) for w in range(x.word_offs[i], x.word_offs[i + 1])]) if x.readable[i] else None for i in range(len(texts))]
        assert got == want


def test_null_pitches_have_no_mean_error(spark):
    """A pitch beyond 32 bits leaves the errors of pitches undefined and those of notes as they are."""
    text = "感 <P_60> <NOTE_4> 受 <P_9999999999> <NOTE_8> <BPM_100>"
    r = metrics.per_sample(spark.createDataFrame([(text, text)], "gt_text string, pred_text string"), inference_only=True).first()
    assert (r.cer, r.pitch_mae, r.pitch_error_rate, r.note_mae, r.dur_mae, r.bpm_mae, r.n_aligned_pairs) == (0, None, None, 0, 0, 0, 2)


def test_scoring_needs_no_lambdas(spark):
    """Functions with lambdas are interpreted, an element at a time; samples are scored without them."""
    rows = spark.createDataFrame([(0, S, S)], "i int, gt_text string, pred_text string")
    for made in (metrics.per_sample(rows, inference_only=True), metrics.aligned(rows, parts=("words",)), metrics.aligned(rows, parts=("sung",))):
        assert "lambdafunction" not in made._jdf.queryExecution().toString()


def test_kept_texts_are_sent_once(spark):
    """Texts that stay in the result are read from it, not sent to Python a second time."""
    made = metrics.per_sample(spark.createDataFrame([(S, 0, S)], "p string, i int, g string"), "g", "p")
    assert made.columns[:3] == ["p", "i", "g"] and (made.first().p, made.first().g, made.first().cer) == (S, S, 0)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert " AS _" not in plan.split("MapInArrow")[1]


@pytest.mark.parametrize("beats,note", [(0.15625, "32"), (0.4375, "DOT_16"), (0.625, "8"), (0.875, "DOT_8"), (1.25, "4"), (1.75, "DOT_4"), (2.5, "2"), (3.5, "DOT_2"), (5.0, "1"), (7.0, "DOT_1")])
def test_nearest_note(spark, beats, note):
    assert one(spark, vocab.nearest_note(F.lit(beats))) == f"<NOTE_{note}>"


def test_encoder_length(spark):
    want = {0: 0, 1: 1, 8: 1, 9: 2, 99: 13, 100: 13, 101: 14, 250: 33, 3000: 390}
    got = spark.createDataFrame([(k,) for k in want], "m int").select("m", tensors.encoder_length(F.col("m")).alias("n")).collect()
    assert {r.m: r.n for r in got} == want


def test_words_and_merging(spark):
    text = "· <P_60> <NOTE_4> 感 <P_61> <NOTE_4> · <P_61> <NOTE_4> · <P_62> <NOTE_8> AP <P_0>"
    ws = words.words(parse.entries(F.lit(text)))
    got = one(spark, F.transform(ws, lambda w: F.struct(w["char"].alias("c"), words.merged(w["pairs"]).alias("m"))))
    assert [(w.c, [(p.pitch, p.note) for p in w.m]) for w in got] == [("·", [(60, "<NOTE_4>")]), ("感", [(61, "<NOTE_2>"), (62, "<NOTE_8>")]), ("AP", [(0, "<NOTE_4>")])]


def test_alignments_agree(spark):
    rng = random.Random(2)
    rows = [(i, *[[rng.choice("abc") for _ in range(rng.randint(0, 7))] for _ in range(2)]) for i in range(150)]
    df = spark.createDataFrame(rows, "i int, a array<string>, b array<string>")
    got = df.select("a", "b", align.align(F.col("a"), F.col("b")).alias("u"), align.align_native(F.col("a"), F.col("b")).alias("n"), align.edit_distance(F.col("a"), F.col("b")).alias("d")).collect()
    for r in got:
        pairs = [(x.g, x.p) for x in r.u]
        assert pairs == [(x.g, x.p) for x in r.n]
        assert [g for g, _ in pairs if g is not None] == list(range(len(r.a))) and [p for _, p in pairs if p is not None] == list(range(len(r.b)))
        assert r.d == sum(g is None or p is None or r.a[g] != r.b[p] for g, p in pairs)


def align_plain(a, b, gap=1):
    """Index pairs of two sequences by the definition of the cost, memorised, going back from the ends."""
    from functools import cache

    @cache
    def cost(i, j):
        if not i or not j:
            return (i + j) * gap
        return min(cost(i - 1, j - 1) + (a[i - 1] != b[j - 1]), cost(i - 1, j) + gap, cost(i, j - 1) + gap)

    out, i, j = [], len(a), len(b)
    while i or j:
        if i and j and cost(i, j) == cost(i - 1, j - 1) + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i and cost(i, j) == cost(i - 1, j) + gap:
            i -= 1
            out.append((i, -1))
        else:
            j -= 1
            out.append((-1, j))
    return out[::-1]


@pytest.mark.parametrize("gap,cells", [(1, 1 << 24), (2, 500), (0, 1 << 24), (3, 40)])
def test_many_alignments(monkeypatch, gap, cells):
    import numpy as np

    monkeypatch.setattr(align, "CELLS", cells)
    rng = random.Random(gap)
    pairs = [tuple([rng.randrange(k) for _ in range(rng.choice([0, 1, 2, rng.randint(0, 30)]))] for _ in range(2)) for k in (1, 2, 3, 9) for _ in range(120)]
    offs = [np.cumsum([0] + [len(p[s]) for p in pairs]) for s in (0, 1)]
    g, p, at = align.align_many(np.array([x for q in pairs for x in q[0]]), offs[0], np.array([x for q in pairs for x in q[1]]), offs[1], gap)
    for i, (a, b) in enumerate(pairs):
        assert list(zip(g[at[i] : at[i + 1]].tolist(), p[at[i] : at[i + 1]].tolist())) == align_plain(a, b, gap)
    none = np.zeros(0, np.int32)
    assert align.align_many(none, np.zeros(1, np.int64), none, np.zeros(1, np.int64))[2].tolist() == [0]


def test_like_sequences_are_aligned_in_a_band(monkeypatch):
    """A long sequence and the same without some elements need no whole table, and get the path of the rule for ties."""
    import numpy as np

    monkeypatch.setattr(align, "CELLS", 100)
    monkeypatch.setattr(align, "_long", None)
    rng = random.Random(5)
    for _ in range(20):
        a = [rng.randrange(3) for _ in range(120)]
        b = [x for i, x in enumerate(a) if i % 9 != 3]
        for x, y in ((a, b), (b, a)):
            g, p, _ = align.align_many(np.array(x), np.array([0, len(x)]), np.array(y), np.array([0, len(y)]))
            assert list(zip(g.tolist(), p.tolist())) == align_plain(x, y, 1)


@pytest.mark.parametrize("gap", [1, 2, 3])
def test_like_sequences_are_aligned_by_cost(monkeypatch, gap):
    """Sequences that differ little fill no table and no band, whichever is longer, and get the path of the rule for ties."""
    import numpy as np

    rng = random.Random(gap)

    def edited(a, k, rate):
        changed = [[], [rng.randrange(k)], "again", "before"]
        out = []
        for x in a:
            how = rng.choice(changed) if rng.random() < rate else [x]
            out += [x, x] if how == "again" else [rng.randrange(k), x] if how == "before" else how
        return out

    pairs = [([], []), ([1], []), ([], [1, 1]), ([1, 2], [2]), ([0] * 50, [0] * 43)]
    for k in (1, 2, 3, 9):
        for rate in (0, 0.05, 0.3, 0.9):
            a = [[rng.randrange(k) for _ in range(rng.randint(0, 60))] for _ in range(8)]
            pairs += [(x, edited(x, k, rate)) for x in a] + [([y for i, y in enumerate(x) if i % 7 != 3], x) for x in a]
    pairs += [(y, x) for x, y in pairs]
    offs = [np.cumsum([0] + [len(p[s]) for p in pairs]) for s in (0, 1)]
    flat = [np.array([x for q in pairs for x in q[s]], np.int32) for s in (0, 1)]
    for few in ("FEW_CELLS", "PLACE_CELLS", "COST_CELLS"):
        monkeypatch.setattr(align, few, 0)
    for table in ("_together", "_in_band", "_long"):
        monkeypatch.setattr(align, table, None)
    for cells in (40, 1 << 24):
        monkeypatch.setattr(align, "CELLS", cells)
        g, p, at = align.align_many(flat[0], offs[0], flat[1], offs[1], gap)
        for i, (a, b) in enumerate(pairs):
            assert list(zip(g[at[i] : at[i + 1]].tolist(), p[at[i] : at[i + 1]].tolist())) == align_plain(a, b, gap)


def test_documents_that_are_alike_fill_no_tables(monkeypatch):
    """As in align_documents: 40 texts of up to 900 words against themselves without every seventh word, beside one that is unlike."""
    import numpy as np

    filled, together = [], align._together
    monkeypatch.setattr(align, "_together", lambda a, m, b, n, *more: filled.append(int((m * n).sum())) or together(a, m, b, n, *more))
    rng = random.Random(8)
    a = [[rng.randrange(500) for _ in range(rng.randint(300, 900))] for _ in range(40)]
    b = [[x for i, x in enumerate(ws) if i % 7 != 3] for ws in a]
    b[7] = [rng.randrange(500) for _ in range(400)]
    offs = [np.cumsum([0] + [len(x) for x in xs]) for xs in (a, b)]
    g, p, at = align.align_many(*[z for xs, o in zip((a, b), offs) for z in (np.array([x for ws in xs for x in ws]), o)])
    assert filled == [len(a[7]) * len(b[7])]
    for i in set(range(40)) - {7}:
        own = slice(at[i], at[i + 1])
        assert (p[own] < 0).sum() == (len(a[i]) + 3) // 7 and (g[own] >= 0).all() and all(a[i][x] == b[i][y] for x, y in zip(g[own], p[own]) if y >= 0)


def test_agreement_counts_the_steps_of_alignments(spark):
    rng = random.Random(6)
    rows = [(i, *[[rng.choice(["a", "b", "c", None]) for _ in range(rng.randint(0, 90))] for _ in range(2)]) for i in range(40)] + [(40, None, ["a"]), (41, [], None), (42, [], [])]
    df = spark.createDataFrame(rows, "i int, a array<string>, b array<string>").repartition(3)
    for r in df.select("a", "b", align.align(F.col("a"), F.col("b"), 2).alias("u"), align.agreement(F.col("a"), F.col("b"), 2).alias("n")).collect():
        met = [r.a[g] == r.b[p] for g, p in r.u if g is not None and p is not None] if r.u is not None else None
        assert r.n == (None if met is None else (sum(p is None for _, p in r.u), sum(g is None for g, _ in r.u), sum(met), len(met) - sum(met)))


def test_agreement_in_parts(monkeypatch):
    import pyarrow as pa

    rng = random.Random(7)
    a, b = (pa.array([rng.choice([None, [rng.choice("abc") for _ in range(rng.randint(0, 20))]]) for _ in range(60)], pa.list_(pa.string())) for _ in "ab")
    whole = align._agreements(a, b, 1)
    assert len(whole) == 60 and whole.null_count
    for keys in (1, 17, 300):
        monkeypatch.setattr(align, "KEYS", keys)
        assert align._agreements(a, b, 1).equals(whole) and align._agreements(a[7:31], b[7:31], 1).equals(whole[7:31])
    assert len(align._agreements(a[:0], b[:0], 1)) == 0


def test_alignment_of_null_lists(spark):
    df = spark.createDataFrame([(None, ["a"]), (["a"], None), ([], []), (["a", None], [None, "a"])], "a array<string>, b array<string>")
    got = [r.u and [(x.g, x.p) for x in r.u] for r in df.select(align.align(F.col("a"), F.col("b")).alias("u")).collect()]
    assert got == [None, None, [], [(0, 0), (1, 1)]]


# prediction -> cer, pitch, note, dur, bpm, n_pred, pairs, PER, NNE
SCORES = [
    (S, 0, 0, 0, 0, 0, 4, 4, 0, 0),
    (S.replace("<P_68> <NOTE_4>", "<P_68> <NOTE_8> · <P_68> <NOTE_8>"), 0, 0, 0, 0, 0, 4, 4, 0, 0),
    (S.replace("68", "69").replace("受", "手"), 1 / 3, 0.25, 0, 0, 0, 4, 4, 0.25, 0),
    (S.replace("受 <P_60> <NOTE_8> ", ""), 1 / 3, 0, 0, 0, 0, 3, 3, 0, 0),
    (S.replace("受", "SP <P_0> <NOTE_4> 受"), 0, 0, 0, 0, 0, 5, 4, 0, 0),
    (S.replace("NOTE_4", "NOTE_2").replace("NOTE_8", "NOTE_4").replace("BPM_120", "BPM_240"), 0, 0, 1, 0, 120, 4, 4, 0, 0),
    (S.replace("BPM_120", "BPM_240"), 0, 0, 0, 1, 120, 4, 4, 0, 0),
    (S.replace("<P_68> <NOTE_4>", "<P_68> <NOTE_8> · <P_70> <NOTE_8>"), 0, 0.5, 0.25, 0.25, 0, 4, 4, 0.25, 0.25),
    ("hello world", 1, None, None, None, None, 0, 0, None, None),
]


def test_scores(spark):
    rows = spark.createDataFrame([(i, S, s[0]) for i, s in enumerate(SCORES)], "i int, gt_text string, pred_text string")
    got = metrics.per_sample(rows, inference_only=True).orderBy("i").collect()
    for r, s in zip(got, SCORES):
        found = (r.cer, r.pitch_mae, r.note_mae, r.dur_mae, r.bpm_mae, r.n_pred_words, r.n_aligned_pairs, r.pitch_error_rate, r.note_num_mean_error)
        assert r.n_gt_words == 4 and found == pytest.approx(s[1:]), s[0]


def test_length_matched_and_unreadable(spark):
    rows = spark.createDataFrame([(0, S, "感 <P_68> <NOTE_4> <BPM_120>"), (1, S, "gan <P_68> <NOTE_4> shou <P_61> <NOTE_4> ting <P_62> <NOTE_4> <BPM_120>"), (2, "<BPM_90>", S), (3, "AP <P_0> <NOTE_4> <BPM_100>", "感 <P_0> <NOTE_4> <BPM_100>")], "i int, gt_text string, pred_text string")
    got = metrics.per_sample(rows, inference_only=True, length_matched=True).collect()
    assert [(r.i, r.cer, r.n_aligned_pairs) for r in got] == [(1, 1.0, 3)]
    assert (got[0].pitch_mae, got[0].note_mae, got[0].dur_mae, got[0].pitch_error_rate) == pytest.approx((1 / 3,) * 4)
    assert sorted((r.i, r.cer) for r in metrics.per_sample(rows).collect()) == [(0, pytest.approx(2 / 3)), (1, 1.0), (3, 1.0)]


def test_batches_without_words(spark):
    rows = spark.createDataFrame([(0, "AP <P_0> <NOTE_4> <BPM_100>", "x"), (1, "<P_60>", "")], "i int, gt_text string, pred_text string").repartition(2)
    assert [(r.i, r.cer, r.n_pred_words, r.n_aligned_pairs) for r in metrics.per_sample(rows).orderBy("i").collect()] == [(0, 1.0, 0, 0), (1, 1.0, 0, 0)]
    rows = rows.withColumn("pred_text", F.lit(None).cast("string"))
    assert metrics.per_sample(rows, length_matched=True).count() == 2 and metrics.per_sample(rows.where("i > 5")).count() == 0


def test_no_samples_no_means(spark):
    rows = spark.createDataFrame([], "i int, gt_text string, pred_text string")
    assert metrics.over_all(metrics.per_sample(rows)).collect() == []


@pytest.mark.parametrize("padded", [False, True])
def test_packing(spark, padded):
    rng = random.Random(9)
    lens = [rng.randint(1, 50) for _ in range(300)] + [500]
    df = spark.createDataFrame(list(enumerate(lens)), "sample_id long, n int")
    got = batching.pack(df, "n", budget=120, cap=6, padded=padded).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.batch_id, []).append(r)
    assert sorted(r.sample_id for r in got) == list(range(len(lens)))
    for g in groups.values():
        weight = len(g) * max(r.length for r in g) if padded else sum(r.length for r in g)
        assert len(g) == 1 or (weight <= 120 and len(g) <= 6)
        assert sorted(r.pos for r in g) == list(range(len(g)))
    ranged = batching.pack(df, "n", budget=120, cap=6, padded=padded, partitions=3).collect()
    assert sorted(r.sample_id for r in ranged) == list(range(len(lens)))
    for block in (1, 6, 7, 50, 1000):  # the batches do not depend on the blocks
        assert sorted(map(tuple, batching.pack(df, "n", budget=120, cap=6, padded=padded, block_rows=block).collect())) == sorted(map(tuple, got))


@pytest.mark.parametrize("padded", [False, True])
def test_packing_in_blocks_and_any_order(spark, padded):
    rng = random.Random(19)
    lens = [rng.choice([0, 1, 3, 30, 200]) for _ in range(5000)]
    df = spark.createDataFrame(list(enumerate(lens)), "sample_id long, n int").withColumn("o", F.xxhash64("sample_id")).repartition(50)
    for budget, cap in ((120, 9), (0, 7), (1, 5), (100_000, 64)):
        for order in (None, "o"):
            whole = sorted(map(tuple, batching.pack(df, "n", budget=budget, cap=cap, padded=padded, order=order).collect()))
            assert whole == sorted(map(tuple, batching.pack(df, "n", budget=budget, cap=cap, padded=padded, order=order, block_rows=100).collect()))
    assert batching.pack(df.limit(0), "n", block_rows=5).collect() == []


def test_numbers_of_all_rows(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("k")).repartition(9)  # a frequent null
    want = sorted(((r.k is not None, r.k or 0, r.id) for r in df.collect()))
    for parts in (1, 50):
        got = numbering.numbered(df, ["k", "id"], partitions=parts)
        assert [(r.k is not None, r.k or 0, r.id) for r in got.orderBy("no").collect()] == want and sorted(r.no for r in got.collect()) == list(range(3000))
    assert numbering.numbered(df.limit(0), ["id"]).collect() == []


def test_row_budget_over_parts(spark):
    parts = [spark.range(n).select(F.lit(name).alias("dataset_name"), F.col("id").alias("i")).repartition(5) for name, n in (("a", 30), ("b", 0), ("c", 50), ("d", 10))]
    for most in (1, 29, 30, 31, 79, 80, 85, 1000):
        got = sorted((r.dataset_name, r.i) for r in annotations.budget(parts, most, ["i"]).collect())
        assert got == [*(("a", i) for i in range(30)), *(("c", i) for i in range(50)), *(("d", i) for i in range(10))][:most]
    assert annotations.budget(parts, 0, ["i"]).count() == 90


def test_long_pairs_align_as_short_ones(monkeypatch):
    rng = np.random.default_rng(1)
    for gap in (1, 2):
        for kinds in (2, 4, 30):
            seqs = [[rng.integers(kinds, size=rng.integers(0, 60)).astype(np.int32) for _ in range(60)] for _ in "ab"]
            a, b = (np.concatenate(x) for x in seqs)
            a_offs, b_offs = (np.concatenate([[0], np.cumsum([len(y) for y in x])]) for x in seqs)
            monkeypatch.setattr(align, "CELLS", 1 << 24)
            whole = align.align_many(a, a_offs, b, b_offs, gap)
            for cells in (4, 30, 200):
                monkeypatch.setattr(align, "CELLS", cells)
                assert all((x == y).all() for x, y in zip(whole, align.align_many(a, a_offs, b, b_offs, gap)))


def test_a_very_long_pair_takes_little_memory():
    import tracemalloc

    rng = np.random.default_rng(2)
    a = rng.integers(500, size=20_000).astype(np.int32)
    b = np.delete(a, rng.integers(20_000, size=500))
    tracemalloc.start()
    g, p, _ = align.align_many(a, np.array([0, len(a)]), b, np.array([0, len(b)]))
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()
    assert (g >= 0).sum() == len(a) and (p >= 0).sum() == len(b) and (a[g[p >= 0]] == b[p[p >= 0]]).all()


def by_rows(a, b, same, gap=1):
    """Cell by cell."""
    cost = [[gap * (i + j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            cost[i][j] = min(cost[i - 1][j - 1] + (not same(a[i - 1], b[j - 1])), cost[i - 1][j] + gap, cost[i][j - 1] + gap)
    i, j, out = len(a), len(b), []
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (not same(a[i - 1], b[j - 1])):
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i and cost[i][j] == cost[i - 1][j] + gap:
            i -= 1
            out.append((i, None))
        else:
            j -= 1
            out.append((None, j))
    return out[::-1]


@pytest.mark.parametrize("cells", [40, 1 << 24])
def test_alignment_by_a_tolerance(spark, monkeypatch, cells):
    monkeypatch.setattr(align, "CELLS", cells)
    rng = random.Random(4)
    notes = lambda: [(rng.randint(60, 64), rng.choice([0.25, 0.5, 0.75, 1.0])) for _ in range(rng.randint(0, 12))]
    data = [(i, notes(), notes()) for i in range(80)] + [(80, None, notes()), (81, [], [])]
    kind = "array<struct<pitch:int,beats:double>>"
    df = spark.createDataFrame(data, f"i int, a {kind}, b {kind}").repartition(3)
    near = lambda x, y: (np.abs(x["pitch"] - y["pitch"]) <= 1) & (np.maximum(x["beats"], y["beats"]) <= 1.5 * np.minimum(x["beats"], y["beats"]))
    got = {r.i: r.x and [(c.g, c.p) for c in r.x] for r in df.select("i", align.align_where(F.col("a"), F.col("b"), near).alias("x")).collect()}
    same = lambda x, y: abs(x[0] - y[0]) <= 1 and max(x[1], y[1]) <= 1.5 * min(x[1], y[1])
    assert got == {i: None if a is None or b is None else by_rows(a, b, same) for i, a, b in data}


def test_splits(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "i int, dataset_name string")
    train, val = splits.split(df, ["b", "z"])
    assert sorted(r.i for r in train.collect()) == [1, 3] and [r.i for r in val.collect()] == [2]
    assert splits.split(df, [])[1] is None and splits.split(df.drop("dataset_name"), ["b"])[1] is None
    assert [r.dataset_name for r in splits.missing(df, ["b", "z"]).collect()] == ["z"]


def test_latest_checkpoint(spark):
    df = spark.createDataFrame([("checkpoint-200", True), ("checkpoint-1000", True), ("checkpoint-x", True)], "name string, is_dir boolean")
    assert report.latest_checkpoint(df).first().name == "checkpoint-1000"
    assert report.latest_checkpoint(df.where("name = 'checkpoint-x'")).collect() == []


def test_shuffle_order_depends_on_seed_only(spark):
    df = spark.range(500).select(F.col("id").alias("sample_id"), (F.col("id") % 97).cast("int").alias("n"))
    order = lambda seed: [r.sample_id for r in batching.shuffled_order(df, "n", seed).orderBy("order_key").collect()]
    assert order(1) == order(1) != order(2) and sorted(order(2)) == list(range(500))


def test_edit_distance_of_many_words(spark):
    a = [f"w{i}" for i in range(4200)]
    b = a[:10] + ["x"] + a[10:4150] + ["y", "z"] + a[4152:4190]
    df = spark.createDataFrame([(a, b), (a, a), (a, []), (["p", "q"], ["q"])], "a array<string>, b array<string>")
    assert [r.d for r in df.select(align.edit_distance(F.col("a"), F.col("b")).alias("d")).collect()] == [13, 0, 4200, 1]


def test_tokens_by_number_and_joined_arrays(spark):
    """Tokens are looked up, not formatted, and arrays joined without ``concat``: the values and the nulls stay what they were."""
    from scoreforge.functions import vocab
    from scoreforge.functions.expr import joined

    rows = spark.createDataFrame([(n, [str(n)] if n else None) for n in (None, -1, 0, 7, 127, 128, 255, 256, 2**31 - 1)], "n int, a array<string>")
    got = rows.select("n", vocab.pitch_token(F.col("n")).alias("p"), vocab.bpm_token(F.col("n")).alias("b"), joined(F.col("a"), F.array(F.lit("x"), F.lit(None))).alias("j"), "a")
    for r in got.collect():
        assert r.p == (f"<P_{r.n}>" if r.n is not None and 0 <= r.n < 128 else None)
        assert r.b == (f"<BPM_{r.n}>" if r.n is not None and 0 <= r.n < 256 else "<BPM_120>")
        assert r.j == (None if r.a is None else [*r.a, "x", None])
    assert "format_string" not in rows.select(vocab.pitch_token(F.col("n")), vocab.bpm_token(F.col("n")))._jdf.queryExecution().toString()
