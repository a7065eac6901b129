"""Importance resampling, hard negatives and packing against versions that compare everything, and on odd input; hashes with a secret."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from scoreforge.llm import common as C
from scoreforge.llm import importance, negatives, packing, setjoin, shingles

from .conftest import EDGE, LONG

WORDS = public_tokenizers.path("word_bpe_49k.json")


def some_texts(rng, n):
    words = ["a", "bb", "The", "x1", "é", "漢字", "ÄB", "q" * 45, "w" * 41, "-", "!", "c.d", "9"]
    return [rng.choice([" ", "  ", "\n", "-"]).join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 19, 20, 40, 90]))) for _ in range(n)]


@pytest.mark.parametrize("chunk", [300, 6_000_000])
def test_importance_as_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(importance, "CHUNK", chunk)
    rng = random.Random(3)
    rows = [(i, t) for i, t in enumerate(some_texts(rng, 300))]
    rows += [(None, None), (None, "alone " * 30), (1000, ""), *[(7, "the same row again and again " * 5)] * 40]
    target = [*some_texts(rng, 20), None, ""]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = importance.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), percent=30)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(importance.brute(rows, target, percent=30), key=key)


def test_importance_counts_travel_in_as_many_rows_whatever_was_counted():
    def packed(texts):
        part, data, size = zip(*importance.Grams(pa.array(texts, pa.large_string())).parted(1))
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(data), pa.array(size)], ["part", "packed", "size"])

    few, many = packed(["a b"]), packed([f"w{i} v{i * 7} u{i * 5}" for i in range(5000)])
    made = [list(importance._count_sliced(iter([b]))) for b in (few, many)]
    assert [sum(b.num_rows for b in m) for m in made] == [importance.BUCKETS // importance.SLICE] * 2
    (summed,) = importance._add(iter([b for m in made for b in m]))
    got = np.zeros(importance.BUCKETS, np.int64)
    for at, n in zip(summed.column(0).to_pylist(), summed.column(1).to_pylist()):
        got[at : at + importance.SLICE] += np.frombuffer(n, "<i8")
    want = np.zeros(importance.BUCKETS, np.int64)
    for b in (few, many):
        for out in importance._count(iter([b])):
            np.add.at(want, out.column(0).to_numpy(), out.column(1).to_numpy())
    assert (got == want).all() and got.sum() == 3 + 6 * 5000


def test_importance_counts_do_not_depend_on_what_is_held(monkeypatch):
    texts = pa.array(some_texts(random.Random(8), 200), pa.large_string())
    rows = [(p, d, n) for i in range(0, 200, 20) for p, d, n in importance.Grams(texts.slice(i, 20)).parted(5)]
    rows.sort(key=lambda r: r[0])
    found = []
    for held in (1, 5000, 1 << 28):
        monkeypatch.setattr(importance, "HELD", held)
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.int64()))], ["part", "packed", "size"])
        (out,) = importance._count(iter([batch.slice(0, 17), batch.slice(17)]))
        found.append(dict(zip(out.column(0).to_pylist(), out.column(1).to_pylist())))
    assert found[0] == found[1] == found[2] and sum(found[0].values()) == sum(importance.Grams(texts).gains(np.zeros(importance.BUCKETS, np.int64))[0])


def test_importance_hashes_like_the_library():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abé漢9") for _ in range(rng.choice([1, 3, 8, 39, 40, 41, 90]))).encode() for _ in range(200)})
    known = importance.Vocabulary(pa.array([w + b" " for w in words], pa.large_binary()))
    a, b, c = (np.array([rng.randrange(len(words)) for _ in range(500)]) for _ in range(3))
    assert known.crc.tolist() == [zlib.crc32(w) for w in words]
    assert known.pairs(a, b).tolist() == [zlib.crc32(words[i] + b" " + words[j]) for i, j in zip(a, b)]
    assert known.triples(a, b, c).tolist() == [zlib.crc32(b" ".join([words[i], words[j], words[k]])) for i, j, k in zip(a, b, c)]


def test_importance_edges(spark, edge, none):
    target = edge.limit(3)
    got = importance.resample(edge, target).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in EDGE)
    assert all(r.n_features == 0 and r.weight == 0 for r in got if r.doc_id in (1, 2, 3))
    assert importance.resample(none, target).collect() == [] and importance.resample(edge, none).count() == len(EDGE)


def vectors(rng, n, dim, labels):
    return [(i, int(rng.integers(labels)), rng.normal(size=dim).round(3).tolist()) for i in range(n)]


def mined(df, **options):
    return sorted(map(tuple, negatives.mine(df, **options).collect()))


SCHEMA = "vec_id long, label int, embedding array<double>"


@pytest.mark.parametrize("block_rows, task_packs, pack, leaf", [(60, 1, 3, 8), (250, 2, 2, 30), (50_000, 64, 256, 256)])
def test_negatives_as_brute_force(spark, monkeypatch, block_rows, task_packs, pack, leaf):
    monkeypatch.setattr(negatives, "PACK", pack)
    monkeypatch.setattr(negatives.VantageTree.__init__, "__defaults__", (leaf,))
    rng = np.random.default_rng(7)
    rows = vectors(rng, 500, 6, 4)
    rows += [(i, 9, [0.5, 0.5, 0.0, 0.0, 1.0, 0.0]) for i in range(1000, 1300)]  # a third of all rows: one vector, many ties
    rows += [(i, i % 2, [0.5, 0.5, 0.0, 0.0, 1.0, 0.0]) for i in range(1290, 1350)]
    rows += [(50, 1, [1.0, 2.0]), (51, 1, [1.0, 1.0]), (52, 2, [1.0, 1.0]), (51, 1, [1.0, 1.0]), (0, 0, rng.normal(size=6).tolist())]
    rows += [(100, None, [1.0] * 6), (150, 1, None), (200, 1, []), (250, 2, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (300, 2, [math.nan] * 6), (None, 1, [1.0] * 6)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert mined(df, every=10, block_rows=block_rows, task_packs=task_packs) == sorted(negatives.brute(rows, every=10))


def test_negatives_tree_keeps_clusters_whole():
    """Clusters of unequal size lie in leaves of their own, and equal distances are parted in the middle."""
    rng = np.random.default_rng(3)
    kind = np.repeat(np.arange(5), [30, 45, 38, 50, 41])
    rows = (rng.normal(size=(5, 6)) * 5000)[kind].astype(np.int64) + rng.integers(-20, 20, size=(len(kind), 6))
    tree = negatives.VantageTree(np.arange(len(kind)), np.arange(len(kind)), kind, rows, leaf=50)
    leaves = [tree.labels[a:b] for (a, b), (left, _) in zip(tree.spans, tree.kids) if left < 0]
    assert all(len(set(x.tolist())) == 1 for x in leaves) and sorted(np.concatenate(leaves)) == sorted(kind)
    same = negatives.VantageTree(np.arange(64), np.arange(64), np.zeros(64, int), np.ones((64, 3), np.int64), leaf=8)
    assert sorted(b - a for (a, b), (left, _) in zip(same.spans, same.kids) if left < 0) == [8] * 8


def test_negatives_tree_opens_few_leaves():
    """In well parted clusters an annulus meets few leaves, and what comes out is in order."""
    rng = np.random.default_rng(11)
    centers = rng.normal(size=(32, 8)) * 4000
    rows = np.floor(centers[np.arange(6400) % 32] + rng.normal(size=(6400, 8)) * 20).astype(np.int64)
    tree = negatives.VantageTree(np.arange(6400), np.arange(6400), np.arange(6400) % 32 % 3, rows, leaf=50)
    opened = 0
    for q in range(0, 640, 10):
        most, least = tree.bounds(rows[q : q + 1])
        scores = rows @ rows[q]
        high = int(scores.max() * 95 // 100)
        for low, up in ((high // 2, high), (-(10**15), 10**15)):
            seen = {}
            found = [x for x, _ in zip(tree.nearest(rows[q], most[0], least[0], q, q % 32 % 3, False, low, up, seen), range(20))]
            fit = [i for i in range(6400) if low <= scores[i] <= up and i % 32 % 3 != q % 32 % 3]
            assert found == [(int(scores[i]), i, i) for i in sorted(fit, key=lambda i: (-scores[i], i))[:20]]
            opened += len(seen)
    leaves = sum(left < 0 for left, _ in tree.kids)
    assert opened < 0.1 * 128 * leaves, (opened, leaves)


def test_negatives_edges(spark):
    df = spark.createDataFrame([(0, 1, [1.0]), (1, 1, [2.0]), (2, 2, [1.5])], SCHEMA).selectExpr("*", "7 as rid", "8 as block", "9 as packed", "1 as dim")
    assert mined(df) == [(0, 1, 1, 2, 256 * 512, 256 * 384)]
    assert mined(df.limit(0)) == []
    with pytest.raises(Exception, match="more than 6[24] bits"):
        mined(spark.createDataFrame([(0, 1, [1e30])], SCHEMA))


def pieces_hold(rows, got, lib, size, end):
    by_row = {}
    for i, (doc, text) in enumerate(rows):
        by_row.setdefault((doc, tuple([*lib.encode(text or "", add_special_tokens=False).ids, end])), []).append(i)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
    assert sorted(sequences) == list(range(len(sequences)))
    padding = 0
    for no, parts in sequences.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    assert padding == 0
    docs = {}
    for r in got:
        docs.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for (doc, total), parts in docs.items():
        ids_of = [ids for d, ids in by_row if d == doc and len(ids) == total]
        times = sum(len(by_row[doc, ids]) for ids in ids_of)
        assert sum(r.length for r in parts) == times * total
        if times == 1:
            at = 0
            for r in sorted(parts, key=lambda r: r.start):
                own = np.array(ids_of[0][at : at + r.length], "<u4")
                assert r.start == at and r.ids_crc32 == zlib.crc32(own.tobytes())
                at += r.length
    assert sum(r.length for r in got) == sum(len(ids) * len(v) for (_, ids), v in by_row.items())


@pytest.mark.parametrize("parts, windows, fan, size", [(1, 4, 2, 64), (9, 3, 2, 64), (20, 64, 16, 4096)])
def test_packing_holds_every_id_once(spark, documents, parts, windows, fan, size):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(WORDS)
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["some", "words", "é", "42"]) for _ in range(rng.choice([0, 1, 5, 30, 70, 300])))) for i in range(150)]
    rows += [(r.doc_id + 1000, r.text) for r in documents.limit(40).collect()] + [(None, None), (None, "x"), (3, "once more"), (5000, LONG[:30_000])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    pieces_hold(rows, packing.pack(df, WORDS, size=size, open_windows=windows, fan=fan).collect(), lib, size, 2)


def test_packing_sequences(spark, documents):
    made = packing.pack(documents.repartition(6), WORDS, size=512, open_windows=5, keep_ids=True).cache()
    whole = {r.sequence_id: r for r in packing.sequences(made, 512).collect()}
    assert all(len(r.ids) == 512 or r.n_ids & (r.n_ids - 1) == 0 for r in whole.values())
    for r in made.collect():
        assert np.array(whole[r.sequence_id].ids[r.offset : r.offset + r.length], "<u4").tobytes() == bytes(r.ids) and r.ids_crc32 == zlib.crc32(bytes(r.ids))
    assert sum(r.n_ids for r in whole.values()) == sum(r.length for r in made.collect())


def test_packing_cuts_only_where_nothing_fits():
    packer = packing.Packer(16, 2)
    piece = lambda doc, n: [(doc, 0, n, np.arange(n))]
    for doc, n in enumerate([10, 12, 4, 6]):  # 4 goes to 12, which is then full; 6 to 10
        packer.place(piece(doc, n))
    assert [[p[0] for p in s] for s in packer.full] == [[1, 2], [0, 3]]
    packer.full.clear()
    for doc, n in enumerate([10, 9, 8]):  # 8 fits neither: the fuller takes 6 of it, the other 2
        packer.place(piece(doc, n))
    assert [[(p[0], p[1], len(p[3])) for p in s] for s in packer.full] == [[(0, 0, 10), (2, 0, 6)]] and packer.rooms == [(5, 4)]


def test_packing_edges(spark, edge, none):
    got = packing.pack(edge, WORDS).collect()
    assert sorted({(r.doc_id is None, r.doc_id or 0) for r in got}) == sorted({(i is None, i or 0) for i, _ in EDGE})
    assert [(r.start, r.length, r.doc_tokens) for r in got if r.doc_id == 2] == [(0, 1, 1)]
    assert packing.pack(none, WORDS).collect() == []


def test_words_solved_for_one_hash_are_not_linked(spark):
    """Words whose second half was solved for the state of the first, under a hash without a secret."""
    pairs = [("vhuzjsxqdaaaaaaa", "wumbffaxybdkmixx")]
    rows = [(2 * i + j, w) for i, p in enumerate(pairs) for j, w in enumerate(p)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, setjoin.join(df).collect())) == [(i, 1, i, 0) for i, _ in rows]
    assert setjoin.keep_one(df).count() == len(rows)


def test_hashes_change_with_the_secret():
    col = pa.array(["one two three four", "one two three five", "x", ""], pa.large_string())
    a, b = (shingles.shingle_sets(col, 3, s) for s in (b"one", b"two"))
    assert a[1].tolist() == b[1].tolist() == [2, 2, 1, 0] and not set(a[0]) & set(b[0]) and a[2][3] == 0
    plain = shingles.shingle_sets(col, 3, b"one", False)
    assert (plain[0] == a[0]).all() and not plain[2].any() and len(set(a[2])) == 4
    assert len(set(a[0])) == 4 and a[0].tolist() == shingles.shingle_sets(col, 3, b"one")[0].tolist()
    flat = np.frombuffer(b"abcdefgh" * 100, np.uint8)
    starts = np.arange(0, 400, 7)
    one, two = C.segment_digests(flat, starts, starts + 300), C.segment_digests(flat, starts, starts + 300, b"x")
    assert len(set(one[0])) == len({bytes(flat[s : s + 300]) for s in starts}) and not set(one[0]) & set(two[0])


def test_difference_in_the_top_bits_is_not_kept():
    """Words that differ by the highest bit of a half only: under a sum without secrets they could cancel out."""
    rng = np.random.default_rng(2)
    flat = rng.integers(0, 256, (2000, 24), dtype=np.uint8)
    other = flat.copy()
    other[:, 7] ^= 0x80
    other[:, 15] ^= 0x80
    both = np.concatenate([flat, other]).ravel()
    starts = np.arange(4000) * 24
    one, two = C.segment_digests(both, starts, starts + 24)
    assert len(set(one)) == len(set(two)) == 4000


def test_noise_is_that_of_the_id(spark):
    import hashlib

    got = {r.i: r.z for r in spark.range(500).select(F.col("id").alias("i"), importance.noise(F.col("id")).alias("z")).collect()}
    for i, z in got.items():
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        assert z == math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


@pytest.mark.parametrize("bits, list_rows, hot", [(6, 1_000_000, 3), (20, 2, 100_000), (7, 1, 100_000), (20, 1_000_000, 2)])
def test_set_join_with_a_full_sketch_and_long_lists(spark, monkeypatch, bits, list_rows, hot):
    """Links do not depend on how well the sketch tells shingles apart, nor on which lists are held."""
    monkeypatch.setattr(setjoin, "CELL_BITS", bits)
    run = setjoin._lists

    def held(t):
        inner = run(t)

        def lists(batches):
            setjoin.LIST_ROWS = list_rows
            return inner(batches)

        return lists

    monkeypatch.setattr(setjoin, "_lists", held)
    rng = random.Random(21)
    words, data = [f"w{i}" for i in range(30)], []
    base = [[rng.choice(words) for _ in range(rng.randint(1, 25))] for _ in range(12)]
    for i in range(150):
        w = list(rng.choice(base))
        if rng.random() < 0.5:
            w[rng.randrange(len(w))] = rng.choice(words)
        data.append((i, " ".join(w)))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, setjoin.join(df, 2, 80, 7, hot).collect())) == sorted(setjoin.brute(data, 2, 80))


def test_a_full_sketch_makes_nothing_frequent():
    rng = np.random.default_rng(5)
    cells = rng.poisson(2_000_000, 1 << 12)
    assert (cells >= setjoin.frequent(cells, setjoin.HOT)).mean() == 0
    cells[7] += 10**9
    assert np.flatnonzero(cells >= setjoin.frequent(cells, setjoin.HOT)).tolist() == [7]
    assert [setjoin.cell_bits(n) for n in (0, 10**9, 200 << 30, 10**14, 10**20)] == [20, 20, 22, 24, 24]


def test_long_lists_stream_by():
    token, rid = np.repeat([1, 5, 9], [3, 2000, 2]), np.concatenate([[1, 2, 3], np.arange(2000) // 2 + 50, [7, 8]])
    cols = [pa.array(x) for x in (token, rid, np.full(2005, 10, np.int32), np.zeros(2005, np.int32))]
    batches = [pa.RecordBatch.from_arrays([c.slice(i, 100) for c in cols], ["token", "rid", "n", "pos"]) for i in range(0, 2005, 100)]
    old = setjoin.LIST_ROWS
    try:
        found = []
        for limit in (10**6, 150):
            setjoin.LIST_ROWS = limit
            found.append(sorted({x for b in setjoin._lists(90)(iter(batches)) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}))
    finally:
        setjoin.LIST_ROWS = old
    assert found[0] == found[1] == sorted([(1, 1), (1, 2), (1, 3), *((50, 50 + i) for i in range(1000)), (7, 7), (7, 8)])
