"""The pipeline against plain versions of its stages, each judged on its own input."""

import hashlib
import random

import pytest

import corpus_pipeline
import public_tokenizers
from scoreforge.llm import common as C
from scoreforge.llm import quality, secrets, setjoin

from .test_operators import leaks_brute


def test_stages(spark, sf_dir):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = C.table(spark, sf_dir, "documents")
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(C.checkpointed(stage(spark, steps[-1], sf_dir)))
    assert all(s.columns == docs.columns for s in steps[:-1])
    data = [{r.doc_id: r for r in s.collect()} for s in steps]
    assert [len(x) for x in data[:1]] == [docs.count()] and len(data[1]) < len(data[0])

    scores = {r.doc_id: r.score for r in quality.classify(docs, C.table(spark, sf_dir, "labels")).collect()}
    assert set(data[1]) == {i for i, s in scores.items() if s >= 0.7}

    own = [(i, r.text) for i, r in data[1].items()]
    assert set(data[2]) == {doc for doc, n, component, _ in setjoin.brute(own, 5, 80) if not n or doc == component}

    items = {r.item_id: r.text for r in C.table(spark, sf_dir, "benchmark").collect()}
    leaked = {doc for doc, _ in leaks_brute({i: r.text for i, r in data[2].items()}, items)}
    assert set(data[3]) == set(data[2]) - leaked and leaked >= {i for i, r in data[2].items() if any(t in r.text for t in items.values())}

    assert set(data[4]) == set(data[3])
    for i, r in data[4].items():
        assert ("[secret]" in r.text) == bool(secrets.brute(data[3][i].text)) and r.n_chars == (len(r.text) if r.text != data[3][i].text else data[3][i].n_chars)
        assert not [s for s in secrets.brute(r.text) if secrets.RULES[s[1]].kind != "assign"]

    assert set(data[5]) == set(data[4])
    for i, r in data[5].items():
        ids = sp.encode(data[4][i].text)
        assert r.ids == ids and r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_planted_copies_and_passages(spark, sf_dir):
    """Copies with some words changed go if their five-word shingles are 80 percent alike, and only then; passages with a fifth of their words
    changed are found; clean documents stay."""
    rng = random.Random(17)
    words = [f"{a}{b}" for a in ("stone", "river", "cloud", "grass", "light") for b in ("y", "ing", "less", "s", "ward", "fall", "side")]
    text = lambda n: [rng.choice(words) + str(rng.randrange(50)) for _ in range(n)]
    rows, near = [], {}
    for i in range(40):
        own = text(200)
        rows.append((10 * i, " ".join(own)))
        for j in range(1, 5):
            copy = list(own)
            for at in rng.sample(range(200), 2 * j):
                copy[at] = "other" + str(rng.randrange(1000))
            sets = [{tuple(w[k : k + 5]) for k in range(196)} for w in (own, copy)]
            rows.append((10 * i + j, " ".join(copy)))
            near[10 * i + j] = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.duplicates_stage(spark, docs, sf_dir).collect()}
    assert kept == {doc for doc, n, component, _ in setjoin.brute(rows, 5, 80) if doc == component}
    assert {i for i, s in near.items() if s >= 0.8}.isdisjoint(kept) and all(10 * i in kept for i in range(40))
    by_changes = [sum(10 * i + j not in kept for i in range(40)) for j in range(1, 5)]  # of 40, with 2, 4, 6 and 8 words changed
    assert by_changes[0] == by_changes[1] == 40 and by_changes == sorted(by_changes, reverse=True)

    items = {r.item_id: r.text for r in C.table(spark, sf_dir, "benchmark").collect()}
    passages = {}
    for k, item in enumerate(sorted(items)):
        w = items[item].split()
        if len(w) >= 13:
            for at in range(rng.randrange(7), len(w), 7):  # at most two of thirteen neighbours
                w[at] = "changed"
            passages[5000 + k] = " ".join([*text(30), *w, *text(30)])
    clean = {9000 + i: " ".join(text(120)) for i in range(30)}
    docs = spark.createDataFrame([*passages.items(), *clean.items()], "doc_id long, text string")
    assert len(passages) > 5 and {r.doc_id for r in corpus_pipeline.decontamination_stage(spark, docs, sf_dir).collect()} == set(clean)


def test_run(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.count() and {"doc_id", "n_tokens", "ids"} <= set(got.columns)


def test_empty(spark, sf_dir):
    rows = C.table(spark, sf_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        rows = C.checkpointed(stage(spark, rows, sf_dir))
        assert rows.count() == 0


@pytest.mark.parametrize("k", range(5))
def test_further_columns_and_nulls(spark, edge, sf_dir, k):
    name, stage = corpus_pipeline.STAGES[k]
    got = stage(spark, edge, sf_dir)
    assert got.count() and (k == 4 or got.columns == edge.columns), name
