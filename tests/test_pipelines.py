"""The jobs end to end on files that the tests write, configuration and checkpoint folders."""

import json
import struct

import numpy as np
from pyspark.sql import functions as F

from scoreforge.config import RunConfig
from scoreforge.operators import checkpoints, encode, features, infer, tokens
from scoreforge.plans import pipelines
from scoreforge.schemas import SYLLABLES
from scoreforge.sources import sinks

ITEM = {"word": ["感", "受"], "pitch": [68, 60], "note": ["<NOTE_4>", "<NOTE_8>"], "pitch2word": [0, 1], "bpm": 89}


def test_preprocess_to_scores(spark, tmp_path):
    (tmp_path / "wav").mkdir()
    items = []
    for i in range(4):
        (tmp_path / f"wav/{i}.wav").write_bytes((np.ones(320 * (i + 1)) * 100).astype("<i2").tobytes() if i < 3 else b"odd")
        items.append(ITEM | {"wav_fn": f"{i}.wav"})
    (tmp_path / "x.json").write_text(json.dumps(items))
    (tmp_path / "run.json").write_text(json.dumps({"datasets": [{"name": n, "type": "json_file", "json_path": str(tmp_path / "x.json"), "audio_root": str(tmp_path / "wav")} for n in ("a", "b")], "val_datasets": ["b"], "asr_cot": True, "unknown": 1}))
    config = RunConfig.load(str(tmp_path / "run.json"), max_samples=None)
    stats = pipelines.preprocess(spark, config, features.energy_bins()).first()
    assert (stats.num_samples, stats.errors, stats.skipped_missing, stats.avg_mel_frames) == (6, 2, 0, 4.0)
    assert stats.num_shards == len(list((tmp_path / "preprocessed").rglob("*.parquet"))) and stats.total_bytes == 2 * 2 * 8 * (2 + 4 + 6)
    told = sinks.described(spark, config.output_dir, "songs").first()
    assert (told.description, told.num_rows, told.num_shards, len(told.files)) == ("songs", 6, stats.num_shards, stats.num_shards) and "mel_frames" in told.features
    assert (stats.format, stats.sample_rate) == ("parquet", 16000) and stats.elapsed_seconds > 0 and stats.num_workers > 0
    train, val = pipelines.train_and_validation(spark, config)
    assert train.count() == val.count() == 3
    made = pipelines.targets(val.withColumn("sample_id", F.col("mel_frames").cast("long")), config)
    assert made.first().target == "language Chinese<asr_text>感受<|file_sep|>感 <P_68> <NOTE_4> 受 <P_60> <NOTE_8> <BPM_89>"
    assert {r.batch_id for r in pipelines.training_batches(made, config).collect()} == {0}
    texts = pipelines.transcribe(made, infer.echo, "mel_frames", "mel_frames")
    assert [r.sample_id for r in texts.collect()] == [2, 4, 6]
    refs = made.select("sample_id", encode.text(F.col("syllables"), F.col("bpm")).alias("gt_text"))
    for step in (1, 2):
        samples, means = pipelines.evaluate(refs, texts, step, str(tmp_path / "scalars"))
    assert samples.count() == 3 and means.first().n_parseable == 3
    assert {(r.step, r.key) for r in spark.read.parquet(str(tmp_path / "scalars")).collect()} == {(s, f"eval/{k}") for s in (1, 2) for k in ("cer", "pitch_mae", "note_mae", "dur_mae", "bpm_mae")}
    assert pipelines.evaluate(refs, texts.limit(0), 3)[1].first().cer == 1.0


def test_collate(spark):
    rows = spark.createDataFrame([(0, [1, 9, 2], 2, 20), (0, [1, 2], 1, 8), (1, [5], 0, 8)], "batch int, ids array<int>, prefix int, mel_frames int")
    got = pipelines.collate(rows, ["batch"], 0, 9).orderBy("batch", F.desc("prefix")).collect()
    assert [(r.ids, r.attention_mask, r.labels) for r in got] == [([1, 9, 9, 9, 2], [1] * 5, [-100] * 4 + [2]), ([1, 2, 0, 0, 0], [1, 1, 0, 0, 0], [-100, 2, -100, -100, -100]), ([5], [1], [5])]


def test_checkpoints(tmp_path):
    for name in ("checkpoint-200", "checkpoint-1000", "checkpoint-x"):
        (tmp_path / name).mkdir()
    (tmp_path / "checkpoint-9999").write_text("a file")
    best = checkpoints.latest(str(tmp_path))
    assert best.endswith("checkpoint-1000") and checkpoints.latest(str(tmp_path / "none")) is None
    header = json.dumps({"__metadata__": {}, "a.embed_tokens.weight": {"shape": [100, 4]}, "lm_head.weight": {"shape": [120, 4]}, "x": {"shape": [999]}}).encode()
    (tmp_path / "checkpoint-1000/m.safetensors").write_bytes(struct.pack("<Q", len(header)) + header)
    (tmp_path / "checkpoint-1000/config.json").write_text(json.dumps({"audio_config": {"hidden_size": 4096}, "thinker_config": {"text_config": {"hidden_size": 1024}}}))
    (tmp_path / "checkpoint-1000/vocab.json").write_text("{}")
    assert checkpoints.vocabulary_size(best) == 120
    small, large = checkpoints.BASE_MODELS
    assert checkpoints.base_model(best) == small and checkpoints.base_model(str(tmp_path)) == large
    (tmp_path / "config.json").write_text(json.dumps({"text_config": {"hidden_size": 2048}}))
    assert checkpoints.base_model(str(tmp_path)) == large
    (tmp_path / "training_args.bin").write_bytes(b"x")
    assert checkpoints.base_model(str(tmp_path), lambda p: type("Args", (), {"_name_or_path": "own"})) == "own"
    assert checkpoints.base_model(str(tmp_path), lambda p: 1 / 0) == large and checkpoints.base_model(str(tmp_path), lambda p: object()) == large
    assert checkpoints.copy_needed(best, str(tmp_path / "new")) == ["config.json", "vocab.json"] and (tmp_path / "new/config.json").is_file()


def test_collated_features(spark):
    rows = [(0, [1], 0, 2, np.ones((2, 3))), (0, [1, 2], 1, 4, np.ones((4, 3)) * 2), (1, [5], 0, 0, np.ones((0, 3)))]
    df = spark.createDataFrame([(b, i, p, n, 3, bytearray(m.astype("<f2").tobytes())) for b, i, p, n, m in rows], "batch int, ids array<int>, prefix int, mel_frames int, mel_bins int, input_features binary")
    got = pipelines.collate(df, ["batch"], 0).orderBy("batch", "mel_frames").collect()
    assert [features.frames_of(bytes(r.input_features), 4 if r.batch == 0 else 0, 3).sum(axis=1).tolist() for r in got] == [[3, 3, 0, 0], [6, 6, 6, 6], []]
    assert [r.feature_mask for r in got] == [[1, 1, 0, 0], [1, 1, 1, 1], []]


def letters():
    """A tokenizer of letters: one id each, <audio> is 7, <end> 8."""

    def encode(texts):
        return [[7 if c == "\x01" else 8 if c == "\x02" else ord(c) for c in t.replace("<audio>", "\x01").replace("<end>", "\x02")] for t in texts]

    def decode(ids):
        return ["".join("<audio>" if i == 7 else "<end>" if i == 8 else chr(i) for i in x) for x in ids]

    return encode, decode


def test_model_inputs(spark):
    rows = [(0, 9, 60), (1, 17, 70), (2, 1, 80)]
    df = spark.createDataFrame([(i, [{"char": "a", "pitch": [60], "note": ["<NOTE_4>"]}], bpm, n) for i, n, bpm in rows], f"sample_id long, syllables {SYLLABLES.simpleString()}, bpm int, mel_frames int")
    batches = spark.createDataFrame([(0, 0, 0), (0, 1, 1), (1, 0, 2)], "batch_id long, pos int, sample_id long")
    prefix = encode.chat_prefix(lambda messages: "<audio>" + messages[1]["role"][0] + messages[0]["content"])
    assert prefix == "<audio>u"
    got = {r.sample_id: r for r in pipelines.model_inputs(df, batches, RunConfig(), letters, prefix, "<end>", 0, 7).collect()}
    for i, n, bpm in rows:
        target = f"language Chinese<asr_text>a <P_60> <NOTE_4> <BPM_{bpm}>"
        own = [7] * -(-n // 8) + [ord("u")] + [ord(c) for c in target] + [8]
        fill = [0] * (len(got[0].ids) if i < 2 else len(own))
        assert got[i].ids == (own + fill)[: len(fill)] and got[i].prefix == -(-n // 8) + 1
        assert got[i].labels == ([-100] * got[i].prefix + own[got[i].prefix :] + [-100] * len(fill))[: len(fill)]
    texts = tokens.decoded(spark.createDataFrame([(1, [7, 97]), (2, None)], "i int, ids array<int>"), letters, text="ids")
    assert {r.i: r.text for r in texts.collect()} == {1: "<audio>a", 2: None}


def greedy(rows, budget, cap, padded):
    out, now = [], []
    for row in rows:
        most = max([n for _, n in now] + [row[1]])
        weight = (len(now) + 1) * most if padded else sum(n for _, n in now) + row[1]
        if now and (weight > budget or len(now) >= cap):
            out.append(now)
            now = []
        now.append(row)
    return out + [now] if now else out


def test_transcription_keeps_its_budget(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(n), f"s{i}") for i, n in enumerate(rng.integers(1, 400, 700))]
    df = spark.createDataFrame(rows, "sample_id long, frames int, payload string").repartition(5)

    def factory():
        return lambda payloads, prompts: [",".join(payloads)] * len(payloads)  # each text tells its batch

    got = {r.sample_id: r.text for r in pipelines.transcribe(df, factory, "payload", "frames", budget=1000, cap=8).collect()}
    want = greedy(sorted(((i, n) for i, n, _ in rows), key=lambda r: (r[1], r[0])), 1000, 8, False)
    assert got == {i: ",".join(f"s{j}" for j, _ in batch) for batch in want for i, _ in batch}


def test_models_are_made_once_a_worker(spark):
    calls = spark.sparkContext.accumulator(0)

    def make(word):
        def factory():
            calls.add(1)
            return lambda payloads, prompts: [word] * len(payloads)

        return factory

    df = spark.range(400).select(F.col("id").alias("sample_id"), F.lit("x").alias("payload")).repartition(40)
    for word in ("a", "b"):
        assert {r.text for r in infer.transcribe(df, make(word), "payload").collect()} == {word}


def test_training_batches_differ_by_epoch(spark):
    rng = np.random.default_rng(2)
    lens = rng.integers(1, 60, 950).tolist()
    df = spark.createDataFrame(list(enumerate(lens)), "sample_id long, mel_frames int")
    config = RunConfig(max_batch_tokens=400, max_batch_size=9)
    by_epoch = []
    for epoch in (0, 0, 1):
        got = pipelines.training_batches(df, config, epoch).collect()
        batches = {}
        for r in sorted(got, key=lambda r: r.pos):
            batches.setdefault((r.turn, r.batch_id), []).append((r.sample_id, r.length))
        assert sorted(i for b in batches.values() for i, _ in b) == list(range(950))
        assert all(len(b) <= 9 and (len(b) == 1 or len(b) * max(n for _, n in b) <= 400) for b in batches.values())
        by_epoch.append(sorted(map(sorted, batches.values())))
        from scoreforge.operators import batching

        order = [(r.sample_id, r.mel_frames) for r in batching.shuffled_order(df, "mel_frames", config.seed, epoch).orderBy("order_key").collect()]
        assert [batches[k] for k in sorted(batches, key=lambda k: k[1])] == greedy(order, 400, 9, True)
    assert by_epoch[0] == by_epoch[1] != by_epoch[2]
    plain = pipelines.training_batches(df, config, shuffle=False).collect()
    assert [[i for i, _ in b] for b in greedy(list(enumerate(lens)), 400, 9, True)] == [sorted(r.sample_id for r in plain if r.batch_id == no) for no in range(max(r.batch_id for r in plain) + 1)]


def test_wave_files(tmp_path):
    import io
    import wave

    def file(rate, channels, width, data):
        out = io.BytesIO()
        with wave.open(out, "wb") as f:
            f.setnchannels(channels)
            f.setsampwidth(width)
            f.setframerate(rate)
            f.writeframes(data)
        return out.getvalue()

    tone = (np.sin(np.arange(8000) / 20) * 20000).astype("<i2")
    same = features.decode_wav(8000)(file(8000, 1, 2, tone.tobytes()))
    assert np.allclose(same, tone / 32768) and same.dtype == np.float32
    stereo = features.decode_wav(8000)(file(8000, 2, 2, np.stack([tone, -tone], axis=1).tobytes()))
    assert not stereo.any()
    double = features.decode_wav(16000)(file(8000, 1, 2, tone.tobytes()))
    assert len(double) == 16000 and np.allclose(double[400:-400], np.sin(np.arange(400, 15600) / 40) * 20000 / 32768, atol=1e-3)
    assert np.allclose(features.decode_wav(8000)(file(8000, 1, 1, bytes([0, 128, 255]))), [-1, 0, 127 / 128])
    (tmp_path / "e.wav").write_bytes(b"")
    assert features.open_file(str(tmp_path / "no.wav")) is None and features.open_file(f"file://{tmp_path}/e.wav") is None


def test_unordered_transcription_deals_no_ranges(spark):
    """Where the order plays no part, texts are not dealt to ranges, for which they would be generated twice."""
    rows = spark.createDataFrame([(i, f"t{i}", i + 1) for i in range(20)], "sample_id long, wave string, mel_frames int")
    made = lambda: lambda payloads, prompts: list(payloads)
    found = pipelines.transcribe(rows, made, "wave", "mel_frames", budget=20, ordered=False)
    assert "rangepartitioning(sample_id" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.sample_id, r.text) for r in found.collect()) == [(i, f"t{i}") for i in range(20)]
