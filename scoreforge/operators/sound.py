"""Sound: lossless files, resampling and log-mel spectra, in numpy inside the tasks that extract features."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable
from functools import lru_cache
from math import gcd
from operator import mul

import numpy as np

# ---------------------------------------------------------------- resampling

#: Zero crossings on either side of the low-pass filter, and the window's shape (over 80 dB down outside the band).
CROSSINGS, KAISER = 32, 9.0
#: Output samples that are computed together.
STEP = 1 << 14


@lru_cache(maxsize=16)
def _phases(up: int, down: int) -> tuple[np.ndarray, int]:
    """A windowed sinc for each of the ``up`` places that an output sample can have between two input samples."""
    cutoff = min(1.0, up / down) * (1 - 2.5 / CROSSINGS)  # the passband ends a little before the lower of both Nyquist rates
    half = int(np.ceil(CROSSINGS / min(1.0, up / down)))
    at = np.arange(-half + 1, half + 1)[None, :] - np.arange(up)[:, None] / up
    window = np.i0(KAISER * np.sqrt(np.maximum(0, 1 - (at / half) ** 2))) / np.i0(KAISER)
    taps = cutoff * np.sinc(cutoff * at) * window
    return taps / taps.sum(axis=1, keepdims=True), half


def resample(x: np.ndarray, rate: int, wanted: int) -> np.ndarray:
    """Samples at another rate: ``ceil(len * wanted / rate)`` of them, frequencies above half the lower rate filtered out. Outside the
    sound is silence."""
    if rate == wanted or not len(x):
        return x.astype(np.float32)
    common = gcd(rate, wanted)
    up, down = wanted // common, rate // common
    taps, half = _phases(up, down)
    n = -(-len(x) * up // down)
    padded = np.concatenate([np.zeros(half - 1), x, np.zeros(half + 1)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, 2 * half)
    out = np.empty(n, np.float32)
    for at in range(0, n, STEP):
        place = np.arange(at, min(n, at + STEP)) * down
        out[at : at + STEP] = np.einsum("ij,ij->i", windows[place // up], taps[place % up])
    return out


# ---------------------------------------------------------------- log-mel spectra


def _mel(hz: np.ndarray) -> np.ndarray:
    """Linear to 1000 Hz (mel 15), logarithmic above."""
    return np.where(hz < 1000, hz * 3 / 200, 15 + np.log(np.maximum(hz, 1e-9) / 1000) * 27 / np.log(6.4))


def _hz(mel: np.ndarray) -> np.ndarray:
    return np.where(mel < 15, mel * 200 / 3, 1000 * np.exp((mel - 15) * np.log(6.4) / 27))


@lru_cache(maxsize=16)
def mel_filters(bins: int, size: int, rate: int) -> np.ndarray:
    """Triangles of equal area (bins by frequencies) whose corners lie evenly on the mel scale from 0 to half the rate."""
    corners = _hz(np.linspace(0, _mel(np.array(rate / 2)), bins + 2))
    at = np.arange(size // 2 + 1) * rate / size
    up = (at[None] - corners[:-2, None]) / np.diff(corners)[:-1, None]
    down = (corners[2:, None] - at[None]) / np.diff(corners)[1:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (corners[2:] - corners[:-2]))[:, None]


def log_mel(bins: int = 128, size: int = 400, hop: int = 160, most_seconds: float | None = 30.0) -> Callable[[np.ndarray, int], tuple[np.ndarray, int]]:
    """An extractor of log-mel spectra (bins by frames) as speech models take them: Hann windows of ``size`` around every ``hop``-th sample,
    mirrored at the start and silent behind the end; decadic logarithms of the power, at most 8 below the loudest, plus 4,
    divided by 4. Sound beyond ``most_seconds`` is cut off; there is a frame for each begun ``hop``, none for no sound."""
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)

    def run(sound: np.ndarray, rate: int) -> tuple[np.ndarray, int]:
        x = np.asarray(sound, np.float64)[: None if most_seconds is None else int(most_seconds * rate)]
        frames = -(-len(x) // hop)
        if not frames:
            return np.zeros((bins, 0), np.float32), 0
        x = np.concatenate([x, np.zeros(size + hop)])
        x = np.concatenate([x[size // 2 : 0 : -1], x])
        cut = np.lib.stride_tricks.sliding_window_view(x, size)[: frames * hop : hop]
        filters, out = mel_filters(bins, size, rate), np.empty((bins, frames))
        for at in range(0, frames, 1000):  # so many frames' spectra are in memory
            power = np.abs(np.fft.rfft(cut[at : at + 1000] * window, axis=1)) ** 2
            out[:, at : at + 1000] = filters @ power.T
        out = np.log10(np.maximum(out, 1e-10))
        return ((np.maximum(out, out.max() - 8) + 4) / 4).astype(np.float32), frames

    return run


# ---------------------------------------------------------------- lossless files

# Fixed values of the format: the sample sizes, block sizes and rates that a frame's header names by number.
SIZES = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
BLOCKS = {1: 192, **{i: 576 << (i - 2) for i in range(2, 6)}, **{i: 256 << (i - 8) for i in range(8, 16)}}
RATES = {1: 88200, 2: 176400, 3: 192000, 4: 8000, 5: 16000, 6: 22050, 7: 24000, 8: 32000, 9: 44100, 10: 48000, 11: 96000}
MAGIC = b"fLaC"


def _crc_table(polynomial: int, bits: int) -> list[int]:
    out = []
    for byte in range(256):
        value = byte << (bits - 8)
        for _ in range(8):
            value = (value << 1) ^ (polynomial if value >> (bits - 1) else 0)
            value &= (1 << bits) - 1
        out.append(value)
    return out


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc8(data: bytes) -> int:
    value = 0
    for b in data:
        value = _CRC8[value ^ b]
    return value


def crc16(data: bytes) -> int:
    value = 0
    for b in data:
        value = ((value << 8) & 0xFFFF) ^ _CRC16[(value >> 8) ^ b]
    return value


class _Bits:
    """Bits of a part of a file, most significant first."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8))
        ones = np.where(self.bits, np.arange(len(self.bits)), len(self.bits))
        self.one = np.minimum.accumulate(ones[::-1])[::-1]  # the next set bit from each place on
        self.at = 0

    def take(self, n: int) -> int:
        if self.at + n > len(self.bits):
            raise ValueError("a frame is cut off")
        value = int("".join(map(str, self.bits[self.at : self.at + n].tolist())) or "0", 2)
        self.at += n
        return value

    def signed(self, n: int) -> int:
        value = self.take(n)
        return value - (1 << n) if n and value >> (n - 1) else value

    def many(self, starts: np.ndarray, width: int) -> np.ndarray:
        """Numbers of ``width`` bits at some places."""
        out = np.zeros(len(starts), np.int64)
        for i in range(width):
            out = out << 1 | self.bits[starts + i]
        return out

    def block(self, n: int, width: int) -> np.ndarray:
        """``n`` signed numbers one after another."""
        if self.at + n * width > len(self.bits):
            raise ValueError("a frame is cut off")
        out = self.many(self.at + np.arange(n) * width, width)
        self.at += n * width
        return out - ((out >> (width - 1)) << width) if width else out

    def rice(self, n: int, low: int) -> np.ndarray:
        """``n`` numbers: zeros up to a one, then ``low`` bits; even ones are positive."""
        starts, ends, at, size = [], [], self.at, len(self.bits)
        reach = self.at + n * (low + 1) + 64
        known, base = self.one[at : min(size, reach)].tolist(), at
        for _ in range(n):
            if at - base >= len(known):
                if at >= size:
                    raise ValueError("a frame is cut off")
                known, base = self.one[at : at + (1 << 16)].tolist(), at
            starts.append(at)
            at = known[at - base]
            ends.append(at)
            at += 1 + low
        if at > size:
            raise ValueError("a frame is cut off")
        self.at = at
        first, one = np.array(starts, np.int64), np.array(ends, np.int64)
        value = (one - first) << low | self.many(one + 1, low)
        return (value >> 1) ^ -(value & 1)


def _residual(bits: _Bits, n: int, order: int) -> np.ndarray:
    """What prediction left over, in parts with a width of their own."""
    method, parts = bits.take(2), bits.take(4)
    if method > 1:
        raise ValueError("an unknown coding of residuals")
    wide = 4 + method
    out = []
    for i in range(1 << parts):
        count = (n >> parts) - (order if i == 0 else 0)
        low = bits.take(wide)
        out.append(bits.block(count, bits.take(5)) if low == (1 << wide) - 1 else bits.rice(count, low))
    return np.concatenate(out)


def _summed(first: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """The sequence that starts with ``first`` and whose differences, as often as that is long, are ``rest``."""
    lasts, diff = [], first
    while len(diff):
        lasts.append(int(diff[-1]))
        diff = np.diff(diff)
    for last in reversed(lasts):
        rest = last + np.cumsum(rest)
    return np.concatenate([first, rest])


def _predicted(first: np.ndarray, rest: np.ndarray, factors: list[int], shift: int) -> np.ndarray:
    """Each sample is a weighted sum of those before, shifted, plus what is left over."""
    out, order = first.tolist(), len(factors)
    back = factors[::-1]
    for i, left in enumerate(rest.tolist()):
        out.append(left + (sum(map(mul, back, out[i : i + order])) >> shift))
    return np.array(out, np.int64)


def _channel(bits: _Bits, n: int, width: int) -> np.ndarray:
    if bits.take(1):
        raise ValueError("a channel's padding is set")
    kind, wasted = bits.take(6), 0
    if bits.take(1):
        wasted = 1
        while not bits.take(1):
            wasted += 1
    width -= wasted
    if kind == 0:
        out = np.full(n, bits.signed(width), np.int64)
    elif kind == 1:
        out = bits.block(n, width)
    elif 8 <= kind <= 12:
        first = bits.block(kind - 8, width)
        out = _summed(first, _residual(bits, n, kind - 8))
    elif kind >= 32:
        first = bits.block(kind - 31, width)
        wide, shift = bits.take(4) + 1, bits.signed(5)
        factors = bits.block(kind - 31, wide).tolist()
        out = _predicted(first, _residual(bits, n, kind - 31), factors, shift)
    else:
        raise ValueError("an unknown kind of channel")
    return out << wasted


def _number(data: bytes, at: int) -> int:
    """Bytes that the frame's number takes, in the manner of UTF-8."""
    lead = data[at]
    return 1 if lead < 0x80 else 8 - (~lead & 0xFF).bit_length()


def decode_flac(content: bytes, check: bool = True) -> tuple[np.ndarray, int, int]:
    """Samples (samples by channels), rate and bits of a FLAC file; damage is an error."""
    if content[:4] != MAGIC:
        raise ValueError("not a FLAC file")
    at, last, info = 4, False, None
    while not last:
        kind, size = content[at], int.from_bytes(content[at + 1 : at + 4])
        if kind & 127 == 0:
            info = content[at + 4 : at + 4 + size]
        last, at = bool(kind & 128), at + 4 + size
    packed = int.from_bytes(info[10:18])
    rate, channels, width, total = packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1
    parts = []
    while at < len(content):
        samples, at = _frame(content, at, width)
        parts.append(samples)
    out = np.concatenate(parts) if parts else np.zeros((0, channels), np.int64)
    if total and len(out) != total:
        raise ValueError("a file is cut off")
    if check and any(info[18:34]) and hashlib.md5(_little(out, width)).digest() != info[18:34]:
        raise ValueError("a file fails its checksum")
    return out, rate, width


def _little(samples: np.ndarray, width: int) -> bytes:
    """Samples as whole bytes, channels in turn."""
    size = -(-width // 8)
    return samples.astype("<i8").reshape(-1, 1).view(np.uint8)[:, :size].tobytes()


def _frame(content: bytes, at: int, width: int) -> tuple[np.ndarray, int]:
    head = struct.unpack_from(">I", content, at)[0]
    if head >> 18 != 0x3FFE:
        raise ValueError("a frame does not begin where it should")
    block, rate, order, size = head >> 12 & 15, head >> 8 & 15, head >> 4 & 15, head >> 1 & 7
    place = at + 4 + _number(content, at + 4)
    extra = {6: 1, 7: 2}.get(block, 0)
    n = BLOCKS.get(block) or 1 + int.from_bytes(content[place : place + extra])
    place += extra + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if crc8(content[at:place]) != content[place]:
        raise ValueError("a frame's head fails its checksum")
    width, channels = SIZES.get(size, width), order + 1 if order < 8 else 2
    room = place + 1 + channels * (n * (width + 2) // 8 + 600)  # a channel is never much longer than its samples as they are
    while True:
        bits = _Bits(content[place + 1 : room])
        try:
            sides = [_channel(bits, n, width + (order in (8, 10) and i == 1 or order == 9 and i == 0)) for i in range(channels)]
            break
        except (ValueError, IndexError):
            if room >= len(content):
                raise
            room += 4 * (room - place)
    end = place + 1 + -(-bits.at // 8)
    if crc16(content[at:end]) != int.from_bytes(content[end : end + 2]):
        raise ValueError("a frame fails its checksum")
    if order == 8:
        sides[1] = sides[0] - sides[1]
    elif order == 9:
        sides[0] = sides[0] + sides[1]
    elif order == 10:
        middle = sides[0] << 1 | sides[1] & 1
        sides = [middle + sides[1] >> 1, middle - sides[1] >> 1]
    return np.stack(sides, axis=1), end + 2


class _Writer:
    """Bits that grow at the end."""

    def __init__(self):
        self.parts: list[np.ndarray] = []

    def put(self, value: int, width: int) -> None:
        self.block(np.array([value], np.int64), width)

    def block(self, values: np.ndarray, width: int) -> None:
        shifts = np.arange(width - 1, -1, -1)
        self.parts.append((values[:, None] >> shifts & 1).astype(np.uint8).ravel())

    def rice(self, values: np.ndarray, low: int) -> None:
        folded = (values << 1) ^ (values >> 63)
        zeros = folded >> low
        ends = np.cumsum(zeros + 1 + low)
        out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
        one = ends - low - 1
        out[one] = 1
        for i in range(low):
            out[one + 1 + i] = folded >> (low - 1 - i) & 1
        self.parts.append(out)

    def data(self) -> bytes:
        return np.packbits(np.concatenate(self.parts) if self.parts else np.zeros(0, np.uint8)).tobytes()


def _coded(n: int) -> bytes:
    """A frame's number, in the manner of UTF-8 up to 36 bits."""
    if n < 0x80:
        return bytes([n])
    more = next(k for k in range(1, 7) if n < 1 << (6 * k + 6 - k))
    lead = (0xFF << (7 - more)) & 0xFF
    return bytes([lead | n >> 6 * more, *(0x80 | n >> 6 * i & 0x3F for i in range(more - 1, -1, -1))])


def _best(x: np.ndarray) -> tuple[int, np.ndarray, int]:
    """The order of differences whose residuals take the fewest bits, these, and their low bits."""
    best = None
    for order in range(min(4, len(x) - 1) + 1):
        left = np.diff(x, order)
        mean = float(np.abs(left).mean()) if len(left) else 0.0
        low = min(14, max(0, int(np.log2(mean)) + 1 if mean >= 1 else 0))
        cost = int((((left << 1) ^ (left >> 63)) >> low).sum()) + len(left) * (1 + low)
        if best is None or cost < best[0]:
            best = cost, order, left, low
    return best[1:]


def encode_flac(samples: np.ndarray, rate: int, width: int = 16, block: int = 4096) -> bytes:
    """A FLAC file of whole numbers (samples, or samples by channels): constant channels, or differences up to the fourth order."""
    x = np.asarray(samples, np.int64)
    x = x.reshape(len(x), -1) if x.ndim > 1 else x[:, None]
    channels = x.shape[1]
    sizes = {v: k for k, v in SIZES.items()}
    info = struct.pack(">HH", block, block) + bytes(6) + (rate << 44 | (channels - 1) << 41 | (width - 1) << 36 | len(x)).to_bytes(8) + hashlib.md5(_little(x, width)).digest()
    out = [MAGIC, bytes([0x80]), len(info).to_bytes(3), info]
    for no, at in enumerate(range(0, len(x), block)):
        part = x[at : at + block]
        head = struct.pack(">I", 0x3FFE << 18 | 7 << 12 | (channels - 1) << 4 | sizes.get(width, 0) << 1) + _coded(no) + (len(part) - 1).to_bytes(2)
        bits = _Writer()
        for c in range(channels):
            own = part[:, c]
            if (own == own[0]).all():
                bits.put(0, 8)
                bits.put(int(own[0]), width)
                continue
            order, left, low = _best(own)
            bits.put((8 + order) << 1, 8)
            bits.block(own[:order], width)
            bits.put(0, 6)
            bits.put(low, 4)
            bits.rice(left, low)
        frame = head + bytes([crc8(head)]) + bits.data()
        out += [frame, crc16(frame).to_bytes(2)]
    return b"".join(out)


# ---------------------------------------------------------------- many short files together

#: Samples, or bytes of files, that are coded together.
TOGETHER = 1 << 18
#: What files of one frame, one channel and 16 bits begin with, and their frames.
_START, _HEAD = np.frombuffer(MAGIC + b"\x80\0\0\x22", np.uint8), np.frombuffer(struct.pack(">I", 0x3FFE << 18 | 7 << 12 | 4 << 1), np.uint8)
_CRC8_TABLE, _CRC16_TABLE = np.array(_CRC8, np.int64), np.array(_CRC16, np.int64)


def _groups(sizes: np.ndarray):
    """Ranges of neighbours of at most ``TOGETHER`` in all, or of one."""
    at, ends = 0, np.cumsum(sizes)
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER, side="right")))
        yield at, to
        at = to


def _crc16_many(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    order = np.argsort(-size, kind="stable")
    value, begin, left = np.zeros(len(size), np.int64), start[order], size[order]
    for i in range(int(size.max(initial=0))):
        n = int(np.searchsorted(-left, -i))  # those longer than i
        value[:n] = (value[:n] << 8 & 0xFFFF) ^ _CRC16_TABLE[value[:n] >> 8 ^ data[begin[:n] + i]]
    out = np.empty_like(value)
    out[order] = value
    return out


def _crc8_many(data: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    value = np.zeros(len(start), np.int64)
    for i in range(size):
        value = _CRC8_TABLE[value ^ data[start + i]]
    return value


def encode_flac_many(flat: np.ndarray, offs: np.ndarray, rate: int, block: int = 4096) -> list[bytes]:
    """``encode_flac`` of many sounds of 16 bits, one after another, with their offsets; those of one block are coded together."""
    sizes, out = np.diff(offs), []
    for a, b in _groups(sizes):
        if b - a == 1 or sizes[a:b].min() < 1 or sizes[a:b].max() > block:
            out += [encode_flac(flat[offs[i] : offs[i + 1]], rate, 16, block) for i in range(a, b)]
        else:
            out += _encoded(np.asarray(flat[offs[a] : offs[b]], np.int64), np.asarray(offs[a:b] - offs[a], np.int64), sizes[a:b].astype(np.int64), rate, block)
    return out


def _encoded(x: np.ndarray, start: np.ndarray, n: np.ndarray, rate: int, block: int) -> list[bytes]:
    seg = np.repeat(np.arange(len(n)), n)
    pos = np.arange(len(x)) - start[seg]
    flat = np.minimum.reduceat(x, start) == np.maximum.reduceat(x, start)
    best, order, low, folded, diff = np.full(len(n), np.iinfo(np.int64).max), np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), np.zeros(len(x), np.int64), x
    for o in range(5):
        if o:
            diff = np.concatenate([[0], np.diff(diff)])
        own, count = pos >= o, n - o
        mean = np.add.reduceat(np.where(own, np.abs(diff), 0), start) / np.maximum(count, 1)
        few = np.clip(np.where(mean >= 1, np.frexp(mean)[1], 0), 0, 14).astype(np.int64)
        value = (diff << 1) ^ (diff >> 63)
        cost = np.add.reduceat(np.where(own, value >> few[seg], 0), start) + count * (1 + few)
        better = (count > 0) & (cost < best)
        best, order, low = np.where(better, cost, best), np.where(better, o, order), np.where(better, few, low)
        folded = np.where(better[seg], value, folded)
    order[flat] = 1  # a constant is written where a first sample would be
    body = (pos >= order[seg]) & ~flat[seg]
    head, few = np.where(flat, 24, 18 + 16 * order), low[seg]
    zeros = folded >> few
    size = np.where(body, zeros + 1 + few, 0)
    used = np.cumsum(size) - size
    n_bytes = -(-(head + np.add.reduceat(size, start)) // 8)
    frame = np.cumsum(n_bytes + 10) - (n_bytes + 10)
    first = (frame + 8) * 8
    bits = np.zeros(int((n_bytes + 10).sum()) * 8, np.uint8)
    kind = np.where(flat, 0, (8 + order) << 1)
    for i in range(8):
        bits[first + i] = kind >> (7 - i) & 1
    warm = np.flatnonzero(pos < order[seg])
    at = first[seg[warm]] + 8 + 16 * pos[warm]
    for i in range(16):
        bits[at + i] = x[warm] >> (15 - i) & 1
    lows = np.flatnonzero(~flat)
    for i in range(4):
        bits[first[lows] + 14 + 16 * order[lows] + i] = low[lows] >> (3 - i) & 1
    body = np.flatnonzero(body)
    one = (first + head - used[start])[seg[body]] + used[body] + zeros[body]
    bits[one] = 1
    value, few = folded[body], few[body]
    for i in range(int(few.max(initial=0))):
        some = few > i
        bits[(one + 1 + i)[some]] = value[some] >> (few[some] - 1 - i) & 1
    data = np.packbits(bits)
    for i in range(4):
        data[frame + i] = _HEAD[i]
    data[frame + 5], data[frame + 6] = (n - 1) >> 8, (n - 1) & 255
    data[frame + 7] = _crc8_many(data, frame, 7)
    crc, end = _crc16_many(data, frame, n_bytes + 8), frame + n_bytes + 8
    data[end], data[end + 1] = crc >> 8, crc & 255
    raw, samples = data.tobytes(), x.astype("<i2").tobytes()
    lead, about = MAGIC + b"\x80\0\0\x22" + struct.pack(">HH", block, block) + bytes(6), rate << 44 | 15 << 36
    return [lead + (about | k).to_bytes(8) + hashlib.md5(samples[2 * s : 2 * (s + k)]).digest() + raw[a : b + 2] for s, k, a, b in zip(start.tolist(), n.tolist(), frame.tolist(), end.tolist())]


def decode_flac_many(contents: list[bytes]) -> list[tuple[np.ndarray, int, int] | Exception]:
    """``decode_flac`` of many files, or the error that it raises. Files of one frame, one channel and 16 bits whose samples are constant or
    differences in one part are decoded together; all others, and all that fail a check, one by one."""
    out: list = [None] * len(contents)
    for a, b in _groups(np.array([len(c) for c in contents], np.int64)):
        if b - a > 1:
            _decoded(contents[a:b], out, a)
        for i in range(a, b):
            if out[i] is None:
                try:
                    out[i] = decode_flac(contents[i])
                except Exception as damage:  # noqa: BLE001 - the caller's status
                    out[i] = damage
    return out


def _decoded(contents: list[bytes], out: list, shift: int) -> None:
    which = np.array([i for i, c in enumerate(contents) if len(c) >= 55], np.int64)
    if not len(which):
        return
    data = np.frombuffer(b"".join([contents[i] for i in which.tolist()]), np.uint8).astype(np.int64)
    size = np.array([len(contents[i]) for i in which.tolist()], np.int64)
    begin = np.cumsum(size) - size
    good = np.ones(len(size), bool)
    for at, wanted in ((0, _START), (42, _HEAD)):
        for i, v in enumerate(wanted.tolist()):
            good &= data[begin + at + i] == v
    packed = np.zeros(len(size), np.int64)
    for i in range(8):
        packed = packed << 8 | data[begin + 18 + i]
    n = (data[begin + 47] << 8 | data[begin + 48]) + 1
    kind = data[begin + 50] >> 1
    good &= (data[begin + 46] == 0) & ((packed & (1 << 44) - 1) == (15 << 36 | n)) & (data[begin + 50] & 1 == 0) & ((kind == 0) | (kind >= 8) & (kind <= 12))
    good &= _crc8_many(data, begin + 42, 7) == data[begin + 49]
    end = begin + size - 2
    good &= _crc16_many(data, begin + 42, size - 44) == (data[end] << 8 | data[end + 1])
    bits = np.unpackbits(data.astype(np.uint8))
    bits = np.concatenate([bits, np.zeros(64, np.uint8)])
    flat, order = kind == 0, np.where(kind == 0, 1, kind - 8)
    good &= (order <= n) & (51 * 8 + 16 * order <= (size - 2) * 8) & (n * 2 < 2 * TOGETHER)
    own = np.flatnonzero(good)
    if not len(own):
        return
    which, begin, end, n, flat, order, packed = (v[own] for v in (which, begin, end, n, flat, order, packed))
    start = np.cumsum(n) - n
    seg = np.repeat(np.arange(len(n)), n)
    pos = np.arange(len(seg)) - start[seg]
    x, first = np.zeros(len(seg), np.int64), (begin + 51) * 8
    warm = np.flatnonzero(pos < order[seg])
    at = first[seg[warm]] + 16 * pos[warm]
    for i in range(16):
        x[warm] = x[warm] << 1 | bits[at + i]
    x[warm] -= x[warm] >> 15 << 16
    at, low, good = first + 16 * order, np.zeros(len(n), np.int64), np.ones(len(n), bool)
    for i in range(6):
        good &= flat | (bits[np.minimum(at + i, len(bits) - 1)] == 0)
    for i in range(6, 10):
        low = low << 1 | bits[np.minimum(at + i, len(bits) - 1)]
    good &= flat | (low < 15)
    at = np.where(flat, at, at + 10)
    last = len(bits) - 1
    ones = np.where(bits, np.arange(len(bits)), last)
    ones = np.minimum.accumulate(ones[::-1])[::-1]
    zeros, place = np.zeros(len(seg), np.int64), np.full(len(seg), last, np.int64)
    left = np.where(flat | ~good, 0, n - order)
    live = np.argsort(-left, kind="stable")
    left = left[live]
    for i in range(int(left.max(initial=0))):
        now = live[: np.searchsorted(-left, -i)]
        here = np.minimum(at[now], last)
        stop = ones[here]
        to = start[now] + order[now] + i
        zeros[to], place[to] = stop - here, stop
        at[now] = stop + 1 + low[now]
    good &= -(-at // 8) == end
    few = low[seg]
    value = zeros
    for i in range(int(low.max(initial=0))):
        some = few > i
        value = np.where(some, value << 1 | bits[np.minimum(place + 1 + i, last)], value)
    rest = pos >= order[seg]
    x = np.where(rest, (value >> 1) ^ -(value & 1), x)
    x = np.where(flat[seg], x[start][seg], x)
    of = np.where(flat, 0, order)[seg]
    for j in range(1, 4):  # first samples as differences
        some = np.flatnonzero((pos >= j) & (pos < of))
        x[some] = x[some] - x[some - 1]
    for j in range(4, 0, -1):
        some = (of >= j) & (pos >= j - 1)
        summed = np.cumsum(np.where(some, x, 0))
        before = np.where(start > 0, summed[start - 1], 0)
        x = np.where(some, summed - before[seg], x)
    samples = x.astype("<i2").tobytes()
    for i, s, k, fits, p in zip(which.tolist(), start.tolist(), n.tolist(), good.tolist(), packed.tolist()):
        told = contents[i][26:42]
        if fits and (not any(told) or hashlib.md5(samples[2 * s : 2 * (s + k)]).digest() == told):
            out[shift + i] = x[s : s + k, None], p >> 44 & (1 << 20) - 1, 16
