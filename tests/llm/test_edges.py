"""Each operator on null, empty, long, tied and repeated rows, further columns, and empty tables."""

import pytest

import public_tokenizers
from scoreforge.llm import decontaminate, language, nearest, pieces, quality, records, secrets, setjoin, sharding, suffixes

from .conftest import EDGE

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
PER_ROW = {
    "suffixes": lambda d: suffixes.remove_repeats(d),
    "setjoin": lambda d: setjoin.join(d),
    "records": lambda d: records.write_and_read(d, WORDS),
    "sharding": lambda d: sharding.shard(d),
    "pieces": lambda d: pieces.encode_decode(d, PIECES),
    "language": lambda d: language.predict(d),
    "secrets": lambda d: secrets.digest(d),
    "quality": lambda d: quality.classify(d, d.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")),
    "redact": lambda d: secrets.redact(d),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_a_row_for_each(edge, none, name):
    got = PER_ROW[name](edge).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in EDGE)
    assert PER_ROW[name](none).collect() == []


def test_keep_one(edge, none):
    got = setjoin.keep_one(edge)
    assert got.columns == edge.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == [(False, i) for i in (1, 2, 3, 4, 5, 7, 9, 10)] + [(True, 0)]
    assert setjoin.keep_one(none).collect() == []


def test_leaks(spark, edge, none):
    items = spark.createDataFrame([(1, "One, two three four!"), (2, None), (3, "x"), (None, "null id token abcdefghijklmnop")], "item_id long, text string")
    got = decontaminate.leaks(edge, items)
    assert sorted((r.doc_id or 0, r.item_id or 0) for r in got.collect()) == [(0, 0), (4, 3), (5, 1), (6, 1), (8, 1)]
    kept = decontaminate.drop_leaks(edge, items)
    assert kept.columns == edge.columns and kept.count() == len(EDGE) - 6
    assert decontaminate.leaks(none, items).collect() == [] and decontaminate.leaks(edge, items.limit(0)).collect() == []


def test_vectors(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, []), (4, [1.0, None]), (5, [float("nan"), 1.0]), (None, [1.0, 1.0]), (6, [1.0, 2.0, 3.0]), (100, [3.0, 0.5])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "7 as shard", "7 as packed", "7 as least")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in nearest.top_k(v).collect())
    a, b = 1024 * 1024 * 5, 1024 * 1024 * 4
    one = [(0, 1, 0, a), (0, 2, 1, a), (0, 3, 100, b)]  # each row of a repeated id is a query and the other's candidate
    assert got == sorted([*one, *one, (100, 1, 0, b), (100, 2, 0, b), (100, 3, 1, b)])
    assert nearest.top_k(v.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["suffixes", "setjoin", "records", "sharding", "secrets"])
def test_very_many_null_ids_and_repeated_rows(spark, name):
    """A third of all rows without an id, a third one row."""
    ids = spark.range(20_000).selectExpr("cast(null as long) as doc_id", "concat('alone ', id, ' ', id * 7, ' words') as text")
    same = spark.range(20_000).selectExpr("5L as doc_id", "'one row that stands there again and again, token=abcdefghijklmnop' as text")
    others = spark.range(20_000).selectExpr("id + 10 as doc_id", "concat('other ', id, ' and ', id * 3, ' text') as text")
    got = PER_ROW[name](ids.unionByName(same).unionByName(others).repartition(6))
    assert got.count() == 60_000
    if name == "setjoin":
        assert got.groupBy("component_id", "n_links").count().where("n_links > 0").collect() == [(5, 19_999, 20_000)]
    if name == "sharding":
        assert got.groupBy("shard").sum("size").agg({"sum(size)": "max"}).first()[0] < 2 * got.selectExpr("sum(size) / 40").first()[0]


def test_keep_one_of_very_many(spark):
    ids = spark.range(5000).selectExpr("cast(null as long) as doc_id", "concat('alone ', id, ' ', id * 7, ' words') as text")
    same = spark.range(5000).selectExpr("5L as doc_id", "'one row that stands there again and again' as text")
    assert setjoin.keep_one(ids.unionByName(same)).count() == 5001


def test_clashing_columns_of_labels_and_benchmark(spark, edge):
    labels = spark.createDataFrame([(i, i % 2) for i in range(11)], "doc_id long, quality int").selectExpr("*", "'t' as text", "1 as at", "2 as n", "3 as _no", "4 as c0")
    assert quality.classify(edge, labels).count() == len(EDGE)
    assert quality.keep(edge, quality.fit(edge, labels)).columns == edge.columns
    items = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string").selectExpr("*", "1 as doc_id", "2 as key", "3 as hits", "4 as seed", "5 as wide", "6 as id")
    assert {r.doc_id for r in decontaminate.leaks(edge, items).collect()} == {5, 6, 8}
