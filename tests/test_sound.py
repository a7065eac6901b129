"""Lossless files, resampling and log-mel spectra."""

import hashlib
import struct

import numpy as np
import pytest

from scoreforge.operators import features, sound


def sounds():
    rng = np.random.default_rng(3)
    t = np.arange(9000)
    tone = (9000 * np.sin(t / 17)).astype(np.int64)
    return [np.zeros(0, np.int64), np.array([5]), np.array([1, -1]), np.full(5000, -7), tone, tone + rng.integers(-50, 50, 9000), rng.integers(-32768, 32768, 5000), np.cumsum(rng.integers(-3, 4, 20_000)), np.tile([32767, -32768], 600)]


def test_files_round_trip():
    for x in sounds():
        for block in (16, 4096):
            got, rate, width = sound.decode_flac(sound.encode_flac(x, 16000, block=block))
            assert (rate, width) == (16000, 16) and got.shape == (len(x), 1) and (got[:, 0] == x).all()
    stereo = np.stack([np.arange(3000) % 91 - 40, np.arange(3000) % 7], axis=1)
    for width in (8, 12, 16, 20, 24):
        got, rate, bits = sound.decode_flac(sound.encode_flac(stereo, 44100, width))
        assert (rate, bits) == (44100, width) and (got == stereo).all()
    assert len(sound.encode_flac(sounds()[7], 16000)) < 20_000  # half the bytes of the samples


def test_damage_is_noticed():
    data = bytearray(sound.encode_flac(sounds()[5], 16000))
    for i in [0, 20, *range(42, len(data), 97)]:
        bad = bytearray(data)
        bad[i] ^= 0x10
        try:
            got = sound.decode_flac(bytes(bad))
        except (ValueError, IndexError, struct.error):
            continue
        assert (got[0][:, 0] == sounds()[5]).all()  # a bit of the file's head that does not bear on the samples
    for cut in (50, len(data) // 2, len(data) - 1):
        with pytest.raises((ValueError, IndexError, struct.error)):
            sound.decode_flac(bytes(data[:cut]))


def flac(channels, n, width, order, write):
    """A file of one frame whose channels ``write`` puts into bits."""
    bits = sound._Writer()
    write(bits)
    head = struct.pack(">I", 0x3FFE << 18 | 7 << 12 | order << 4 | 4 << 1) + b"\x00" + (n - 1).to_bytes(2)
    frame = head + bytes([sound.crc8(head)]) + bits.data()
    info = struct.pack(">HH", n, n) + bytes(6) + (16000 << 44 | (channels - 1) << 41 | (width - 1) << 36 | n).to_bytes(8) + bytes(16)
    comment = bytes([4]) + (3).to_bytes(3) + b"abc"
    return b"fLaC" + bytes([0]) + len(info).to_bytes(3) + info + bytes([0x80 | comment[0]]) + comment[1:] + frame + sound.crc16(frame).to_bytes(2)


def test_kinds_of_channels():
    rng = np.random.default_rng(8)
    x = np.cumsum(rng.integers(-40, 41, 512))
    factors, shift = [1900, -900, 20], 10
    left = np.array([x[i] - (sum(c * int(x[i - 1 - k]) for k, c in enumerate(factors)) >> shift) for i in range(3, 512)])

    def predicted(bits):  # factors, four parts of two widths, one of them as plain numbers
        bits.put((32 + 2) << 1, 8)
        bits.block(x[:3], 16)
        bits.put(12 - 1, 4)
        bits.put(shift, 5)
        bits.block(np.array(factors), 12)
        bits.put(1, 2)
        bits.put(2, 4)
        for i, part in enumerate(np.split(left, [125, 253, 381])):
            if i == 2:
                bits.put(31, 5)
                bits.put(18, 5)
                bits.block(part, 18)
            else:
                bits.put(3 + i, 5)
                bits.rice(part, 3 + i)

    assert (sound.decode_flac(flac(1, 512, 16, 0, predicted))[0][:, 0] == x).all()

    def wasted(bits):  # plain samples whose last two bits are zero
        bits.put(1 << 1 | 1, 8)
        bits.put(0b01, 2)
        bits.block(x, 14)

    assert (sound.decode_flac(flac(1, 512, 16, 0, wasted))[0][:, 0] == x * 4).all()
    y = x + rng.integers(-9, 10, 512)
    for order, sides in ((8, (x, x - y)), (9, (x - y, y)), (10, (x + y >> 1, x - y)), (1, (x, y))):

        def both(bits, order=order, sides=sides):
            for i, side in enumerate(sides):
                bits.put(1 << 1, 8)
                bits.block(side, 16 + (order in (8, 10) and i == 1 or order == 9 and i == 0))

        assert (sound.decode_flac(flac(2, 512, 16, order, both))[0] == np.stack([x, y], axis=1)).all()


def level(x):
    return 10 * np.log10(np.mean(x**2) + 1e-20)


@pytest.mark.parametrize("rate, wanted", [(44100, 16000), (48000, 16000), (8000, 16000), (22050, 16000), (16000, 8000)])
def test_resampling(rate, wanted):
    t = np.arange(rate)
    passed, stopped = 0.35 * min(rate, wanted), 0.56 * min(rate, wanted)
    got = sound.resample(np.sin(2 * np.pi * passed * t / rate), rate, wanted)
    assert len(got) == wanted
    inner = slice(200, wanted - 200)
    assert np.abs(got - np.sin(2 * np.pi * passed * np.arange(wanted) / wanted))[inner].max() < 1e-3
    if rate > wanted:  # what has no place in the lower rate is gone, not folded back
        assert level(sound.resample(np.sin(2 * np.pi * stopped * t / rate), rate, wanted)[inner]) < -70
    assert np.abs(sound.resample(np.ones(rate), rate, wanted)[inner] - 1).max() < 1e-6
    assert len(sound.resample(np.zeros(0), rate, wanted)) == 0


def test_mel_filters_are_triangles_of_equal_area():
    f = sound.mel_filters(80, 400, 16000)
    assert f.shape == (80, 201) and (f >= 0).all() and (f.max(axis=1) > 0).all()
    fine = sound.mel_filters(40, 1 << 16, 16000)
    assert np.allclose(fine.sum(axis=1) * 16000 / (1 << 16), 1, atol=1e-2)
    assert sound._hz(sound._mel(np.array([0.0, 500, 1000, 4000, 8000]))) == pytest.approx([0, 500, 1000, 4000, 8000])


def test_log_mel_as_a_direct_transform():
    rng = np.random.default_rng(4)
    for n, size, hop, bins in ((1000, 64, 16, 10), (401, 64, 20, 5), (5, 8, 4, 3), (1, 8, 4, 3)):
        x, rate = rng.normal(size=n) * 0.1, 1600
        got, frames = sound.log_mel(bins, size, hop, None)(x, rate)
        assert frames == -(-n // hop) and got.shape == (bins, frames)
        window = [0.5 - 0.5 * np.cos(2 * np.pi * i / size) for i in range(size)]
        filters = sound.mel_filters(bins, size, rate)

        def at(i):
            return x[abs(i)] if abs(i) < n else 0.0

        out = np.empty((bins, frames))
        for f in range(frames):
            cut = [at(f * hop + i - size // 2) * window[i] for i in range(size)]
            power = [abs(sum(c * np.exp(-2j * np.pi * k * i / size) for i, c in enumerate(cut))) ** 2 for k in range(size // 2 + 1)]
            out[:, f] = np.log10(np.maximum(filters @ power, 1e-10))
        assert np.allclose(got, (np.maximum(out, out.max() - 8) + 4) / 4, atol=1e-5)
    assert sound.log_mel()(np.zeros(0), 16000)[1] == 0 and sound.log_mel()(np.ones(16000 * 40), 16000)[1] == 3000


def test_decoder_tells_containers_apart(spark):
    import io
    import wave

    x = (8000 * np.sin(np.arange(4000) / 9)).astype("<i2")
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1), f.setsampwidth(2), f.setframerate(8000)
        f.writeframes(x.tobytes())
    a, b = (features.decode_audio(16000)(c) for c in (out.getvalue(), sound.encode_flac(x, 8000)))
    assert len(a) == 8000 and (a == b).all()
    rows = [("a", sound.encode_flac(x, 16000)), ("a", b"odd"), ("a", None), ("a", sound.encode_flac(x[:0], 16000))]
    df = spark.createDataFrame(rows, "dataset_name string, content binary").selectExpr("*", "cast(null as array<struct<char:string,pitch:array<int>,note:array<string>>>) as syllables", "120 as bpm")
    got = features.extract(df, sound.log_mel(20, 64, 16), features.decode_audio()).collect()
    assert sorted((r.status, r.mel_frames, r.mel_bins) for r in got if r.status == "ok") == [("ok", 0, 20), ("ok", 250, 20)]
    assert sorted(r.status for r in got) == ["error", "missing", "ok", "ok"]
    assert hashlib.md5(x.tobytes()).digest() in sound.encode_flac(x, 16000)


def test_many_files_are_the_files_one_by_one():
    """Short sounds coded together: the same bytes, the same samples, and the same errors for damaged files."""
    rng = np.random.default_rng(4)
    waves = []
    for i in range(400):
        n = int(rng.integers(1, 200))
        steps = rng.integers(-3, 4, n)
        waves.append([steps, np.cumsum(steps), rng.integers(-32768, 32768, n), np.full(n, -7), np.zeros(0, np.int64) if i > 390 else np.cumsum(np.cumsum(steps)) % 30000, np.arange(5000 + i) % 99][i % 6 if i > 60 else i % 5])
    waves = [w.astype(np.int64) for w in waves]
    offs = np.concatenate([[0], np.cumsum([len(w) for w in waves])])
    files = sound.encode_flac_many(np.concatenate(waves), offs, 16000)
    assert files == [sound.encode_flac(w, 16000) for w in waves]
    for w, (x, rate, width) in zip(waves, sound.decode_flac_many(files)):
        assert x[:, 0].tolist() == w.tolist() and (rate, width) == (16000, 16)
    broken = []
    for f in files[:200]:
        at = int(rng.integers(0, len(f)))
        broken += [f[:at], f[:at] + bytes([f[at] ^ 4]) + f[at + 1 :]]
    stereo = sound.encode_flac(np.stack([waves[2], waves[2][::-1]], axis=1), 8000)
    for f, got in zip([*broken, stereo], sound.decode_flac_many([*broken, stereo])):
        try:
            want = sound.decode_flac(f)
        except Exception as error:  # noqa: BLE001
            assert type(got) is type(error)
        else:
            assert (got[0] == want[0]).all() and got[1:] == want[1:]


def test_short_files_are_not_coded_one_by_one(monkeypatch):
    rng = np.random.default_rng(5)
    waves = [rng.integers(-500, 500, 64) for _ in range(300)]
    files = [sound.encode_flac(w, 16000) for w in waves]
    monkeypatch.setattr(sound, "encode_flac", None)
    monkeypatch.setattr(sound, "decode_flac", None)
    assert sound.encode_flac_many(np.concatenate(waves), np.arange(301) * 64, 16000) == files
    assert all((x[:, 0] == w).all() for w, (x, _, _) in zip(waves, sound.decode_flac_many(files)))


def test_filters_are_made_once_a_rate():
    sound.mel_filters.cache_clear()
    extract = sound.log_mel(4, 16, 8)
    for _ in range(5):
        extract(np.ones(50), 160)
    assert sound.mel_filters.cache_info().misses == 1
