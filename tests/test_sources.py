"""Sources, sinks, features, inference and the stream, on files that the tests write."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreforge.operators import features, infer, numbering
from scoreforge.sources import annotations as A
from scoreforge.sources import files, sinks
from scoreforge.streaming import score

ITEM = {"word": ["感", "受"], "pitch": [68, 60], "note": ["<NOTE_4>", "<NOTE_8>"], "pitch2word": [0, 1], "bpm": 89, "wav_fn": "a/1.wav"}


def test_json_file(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/1.wav").write_bytes(b"x")
    rows = [ITEM, ITEM | {"word": []}, ITEM | {"pitch": []}, ITEM | {"wav_fn": "gone.wav"}, {k: v for k, v in ITEM.items() if k not in ("bpm",)}, ITEM | {"pitch": [60, 61.0], "bpm": 90.7}, {k: v for k, v in ITEM.items() if k != "note"}, ITEM | {"wav_fn": ""}]
    (tmp_path / "x.json").write_text(json.dumps(rows))
    got = sorted(A.json_file(spark, "d", str(tmp_path / "x.json"), str(tmp_path)).collect(), key=lambda r: (r.bpm, r.syllables[1].pitch != [60]))
    assert [(r.bpm, [s.pitch for s in r.syllables]) for r in got] == [(89, [[68], [60]]), (90, [[60], [None]]), (120, [[68], [60]])]
    assert A.json_file(spark, "d", str(tmp_path / "x.json"), str(tmp_path), max_samples=1).count() == 1


@pytest.fixture
def tree(tmp_path):
    note = json.dumps(ITEM | {"bpm": 1})
    for name, data in {"song1/metadata.json": '{"bpm": 96}', "song1/seg1.wav": "", "song1/seg1.json": note, "song1/seg2.FLAC": "", "song1/seg2.json": note, "song1/seg3.mp3": "", "song1/seg4.json": note, "song1/seg5.wav": "", "song1/seg5.flac": "", "song1/seg5.json": note, "song1/seg6.wav": "", "song1/seg6.json": "{broken", "song2/seg1.wav": "", "song2/seg1.json": note, "stray.wav": ""}.items():
        p = tmp_path / "root" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(data or "x")
    return str(tmp_path / "root")


def test_folder(spark, tree):
    got = sorted((r.audio_path.rpartition("root/")[2], r.bpm) for r in A.folder(spark, "d", tree).collect())
    assert got == [("song1/seg1.wav", 96), ("song1/seg2.FLAC", 96), ("song1/seg5.flac", 96), ("song1/seg5.wav", 96), ("song2/seg1.wav", 120)]


def test_all_datasets_budget(spark, tree):
    configs = [{"name": "one", "root": tree}, {"name": "odd", "type": "unknown"}, {"name": "two", "type": "folder_based", "root": tree}]
    assert A.all_datasets(spark, configs).count() == 10
    assert sorted(r.dataset_name for r in A.all_datasets(spark, configs, 7).collect()) == ["one"] * 5 + ["two"] * 2


def test_features(spark, tmp_path):
    wave = (np.ones(480) * 1000).astype("<i2").tobytes()
    rows = spark.createDataFrame([("a", wave, 90), ("a", None, 90), ("b", b"odd", 90)], "dataset_name string, content binary, bpm int").withColumn("syllables", F.lit(None).cast("array<struct<char:string,pitch:array<int>,note:array<string>>>"))
    made = features.extract(rows, features.energy_bins()).cache()
    ok = made.where("status = 'ok'").first()
    assert features.frames_of(ok.input_features, ok.mel_frames, ok.mel_bins).shape == (3, 8)
    assert features.run_statistics(made).first().asDict() == {"num_samples": 1, "errors": 1, "skipped_missing": 1, "total_bytes": 48, "avg_mel_frames": 3.0}
    sinks.write_features(made, str(tmp_path / "f"), 10)
    assert A.stored(spark, str(tmp_path / "f"), ["dataset_name", "mel_frames"]).collect() == [("a", 3)] or A.stored(spark, str(tmp_path / "f")).count() == 1


def test_transcribe(spark):
    rows = spark.createDataFrame([(0, "xx", "la"), (1, "yyy", " "), (2, "z", None)], "sample_id long, wave string, lyric string")
    assert {r.sample_id: r.text is None for r in infer.transcribe(rows, infer.echo, "wave", "audio-lyric", "lyric").collect()} == {0: False, 1: True, 2: True}
    assert [r.score.entries[0].pitch for r in infer.parsed(infer.transcribe(rows, infer.echo, "wave", batch_size=1)).orderBy("sample_id").collect()] == [62, 63, 61]
    with pytest.raises(ValueError):
        infer.transcribe(rows, infer.echo, "wave", "other")
    with pytest.raises(ValueError):
        infer.transcribe(rows, infer.echo, "wave", "audio-lyric")


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    text = "感 <P_68> <NOTE_4> <BPM_120>"
    for i in range(3):
        (tmp_path / f"in/{i}.json").write_text(json.dumps({"sid": i, "gt_text": text, "pred_text": text if i else "x"}))
    score.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.sid, r.cer) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(0, 1.0), (1, 0.0), (2, 0.0)]


def tricky(rng, n):
    """Elements with brackets, commas, quotes and backslashes in strings, nested lists, and all sorts of white space between."""
    words = ['a"b', "\\", '\\"', "[", "]", "{,}", "é漢", "", ",", "\\\\\\", "x" * 40, '"']
    items = [{"i": i, "w": [rng.choice(words) for _ in range(rng.randint(0, 4))], "d": {"x": [[1], {"y": [rng.choice(words)]}]}} for i in range(n)]
    text = "[" + rng.choice(["", " ", "\n"]) + (rng.choice([",", " ,\n ", ", "])).join(json.dumps(x, ensure_ascii=rng.random() < 0.5) for x in items) + "\n]\n"
    return items, text


@pytest.mark.parametrize("split", [1, 7, 40, 1000, 8 << 20])
def test_lists_cut_by_bytes(spark, tmp_path, monkeypatch, split):
    import random

    monkeypatch.setattr(files, "AHEAD", 5)
    rng, want = random.Random(6), []
    (tmp_path / "l").mkdir()
    for no in range(3):
        items, text = tricky(rng, 25)
        (tmp_path / f"l/{no}.json").write_text(text, encoding="utf-8")
        want += [json.dumps(x, sort_keys=True) for x in items]
    for name, text in (("empty", ""), ("none", "[]"), ("blank", " [ \n ] "), ("plain", '[1, "]", null]'), ("open", '[{"k": 1}, {"k": 2')):
        (tmp_path / f"l/{name}.json").write_text(text)
    got = [r.element for r in files.json_elements(spark, str(tmp_path / "l"), split).collect()]
    assert sorted(json.dumps(json.loads(x), sort_keys=True) for x in got) == sorted([*want, "1", '"]"', "null", '{"k": 1}'])


def test_a_long_run_of_backslashes_over_many_ranges(spark, tmp_path):
    items = [{"w": "\\" * n + '"'} for n in (0, 1, 63, 64, 65, 200)]
    (tmp_path / "b.json").write_text(json.dumps(items))
    for split in (3, 50, 10_000):
        assert sorted(r.element for r in files.json_elements(spark, str(tmp_path / "b.json"), split).collect()) == sorted(json.dumps(x) for x in items)


def test_json_file_in_any_ranges(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/1.wav").write_bytes(b"x")
    (tmp_path / "x.json").write_text(json.dumps([ITEM | {"bpm": i, "word": ["[感,", '受"']} for i in range(200)]))
    rows = [sorted(map(str, A.json_file(spark, "d", str(tmp_path / "x.json"), str(tmp_path), split_bytes=n).collect())) for n in (100, 10**6)]
    assert len(rows[0]) == 200 and rows[0] == rows[1]


def test_listing_by_tasks(spark, tmp_path):
    for i in range(30):
        (tmp_path / f"r/s{i}/deep").mkdir(parents=True)
        for j in range(i % 4):
            (tmp_path / f"r/s{i}/f{j}.wav").write_bytes(b"x" * j)
        (tmp_path / f"r/s{i}/deep/g").write_bytes(b"yy")
    (tmp_path / "r/top").write_bytes(b"z")
    (tmp_path / "r/link").symlink_to(tmp_path / "r/s1")
    (tmp_path / "r/s1/linked.wav").symlink_to(tmp_path / "r/s2/f1.wav")
    root = str(tmp_path / "r")
    got = sorted((r.found.removeprefix(root), r.size, r.depth) for r in files.listed(spark, f"{root}/", tasks=5).collect())
    assert got == sorted([("/top", 1, 1), *((f"/s{i}/f{j}.wav", j, 2) for i in range(30) for j in range(i % 4)), *((f"/s{i}/deep/g", 2, 3) for i in range(30))])
    assert files.listed(spark, f"file:{root}", 2).count() == sum(i % 4 for i in range(30)) == files.listed(spark, f"file://{root}", 2).where("found like 'file:%'").count()
    assert files.listed(spark, f"{root}/nowhere").collect() == [] and files.listed(spark, root, 7).collect() == []
    assert sorted(r.found for r in files.existing(spark, root).collect()) == sorted(f"{root}{f}" for f, n, _ in got if n)


def test_opened_files(spark, tmp_path):
    (tmp_path / "a").write_text("﻿é")
    (tmp_path / "b").write_bytes(b"\xff\xfe\xff")
    df = spark.createDataFrame([(str(tmp_path / x), x) for x in "abc"], "found string, k string")
    assert {r.k: r.content for r in files.opened(df).collect()} == {"a": "é", "b": None, "c": None}


def test_tables_in_folders_are_named_once(spark, tmp_path):
    from scoreforge.plans.catalogue import existing_files

    for name in ("a.parquet/part-0.parquet", "a.parquet/part-1.parquet", "a.parquet/.part-0.parquet.crc", "b.parquet", "c.txt/part.parquet"):
        p = tmp_path / "sf" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x")
    (tmp_path / "sf/d.parquet").mkdir()
    for root in (f"{tmp_path}/sf", f"file:{tmp_path}/sf/"):
        assert sorted(r.name for r in existing_files(spark, root).collect()) == ["a.parquet", "b.parquet"]


@pytest.mark.parametrize("head", [10_000, 10])
def test_budget_of_rows_of_equal_order(spark, monkeypatch, head):
    """Neither a small bound nor a large one makes one task see all rows of one order."""
    seen, kept = [], A.written
    monkeypatch.setattr(A, "HEAD", head)
    monkeypatch.setattr(A, "written", lambda rows: seen.append(kept(rows)) or seen[-1])
    deal = numbering.written
    monkeypatch.setattr(numbering, "written", lambda rows: seen.append(deal(rows)) or seen[-1])
    part = spark.range(4000).select(F.lit("same").alias("audio_path"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = A.budget([part.where("id < 30"), part.where("id >= 30"), part], 700, ["audio_path"]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len({r.id for r in got}) == 700 and {r.id for r in got} >= set(range(30))
    if head > 700:
        assert [x.count() for x in seen] == [30, 670]  # no rows are written but those that may be drawn
    else:
        assert seen[-1].groupBy(F.shiftright("_at", numbering.PLACE_BITS)).count().agg(F.max("count")).first()[0] < 2500


def test_json_is_parsed_once(spark, tmp_path):
    """Conditions on what a list's elements hold do not parse them again: one parser stands in the plan."""
    (tmp_path / "a").mkdir()
    (tmp_path / "a/1.wav").write_bytes(b"x")
    (tmp_path / "x.json").write_text(json.dumps([ITEM]))
    rows = A.json_file(spark, "d", str(tmp_path / "x.json"), str(tmp_path))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
    assert [(r.audio_path.rpartition("/a/")[2], [s.pitch for s in r.syllables]) for r in rows.collect()] == [("1.wav", [[68], [60]])]
