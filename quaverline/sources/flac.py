"""FLAC streams: header, frames from any place of a stream, and their samples, by the published format.

A frame stands for itself: it starts with a synchronising code, tells its place, and ends with a checksum, so a file is split by
bytes and each part decodes the frames that start in it. A residual's unary parts are found by walking the ones of the bits; the
rest of its codes, the checks and the predictors are numpy's, the linear predictors of many frames step together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np

#: Frames whose predictors step together.
BATCH = 64
#: Bytes of a frame that are looked at first where the header doesn't say how long they get; a longer one asks for more.
WINDOW = 1 << 14
#: Fixed values of the format: samples of a block and rates by code, bits of a sample by code.
BLOCKS = {1: 192, **{i: 576 << (i - 2) for i in range(2, 6)}, **{i: 256 << (i - 8) for i in range(8, 16)}}
RATES = {1: 88_200, 2: 176_400, 3: 192_000, 4: 8_000, 5: 16_000, 6: 22_050, 7: 24_000, 8: 32_000, 9: 44_100, 10: 48_000, 11: 96_000}
DEPTHS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


def _crc_table(polynomial: int, bits: int) -> list[int]:
    table = []
    for byte in range(256):
        value = byte << (bits - 8)
        for _ in range(8):
            value = (value << 1) ^ (polynomial if value >> (bits - 1) else 0)
            value &= (1 << bits) - 1
        table.append(value)
    return table


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc8(raw: bytes) -> int:
    value = 0
    for b in raw:
        value = _CRC8[value ^ b]
    return value


def crc16(raw: bytes) -> int:
    value = 0
    for b in raw:
        value = ((value << 8) & 0xFFFF) ^ _CRC16[(value >> 8) ^ b]
    return value


@dataclass
class Stream:
    """What the header says; ``start`` is the byte of the first frame, ``frames`` the samples of a channel and ``longest`` the bytes
    of the longest frame (0: not said)."""

    sr: int
    channels: int
    bits: int
    frames: int
    block: int
    start: int
    longest: int


def header(read: Callable[[int, int], bytes]) -> Stream:
    """``read(place, n)`` gives bytes of the file."""
    if read(0, 4) != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, info = 4, None
    while True:
        head = read(at, 4)
        if len(head) < 4:
            raise EOFError("a FLAC header ends early")
        size = int.from_bytes(head[1:], "big")
        if head[0] & 0x7F == 0:
            info = read(at + 4, 34)
        at += 4 + size
        if head[0] & 0x80:
            break
    if info is None or len(info) < 34:
        raise ValueError("a FLAC stream without its information")
    packed = int.from_bytes(info[10:18], "big")
    return Stream(packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1, int.from_bytes(info[2:4], "big"), at, int.from_bytes(info[7:10], "big"))


@dataclass
class Head:
    """A frame's header: its first sample's place, samples of a channel, channel code, bits, and its own length in bytes."""

    place: int
    block: int
    channels: int
    bits: int
    size: int


def frame_head(raw: bytes, stream: Stream) -> Head | None:
    """None where no frame starts."""
    if len(raw) < 6 or raw[0] != 0xFF or raw[1] & 0xFE != 0xF8 or raw[3] & 1:
        return None
    variable, block_code, rate_code, channels, depth_code = raw[1] & 1, raw[2] >> 4, raw[2] & 15, raw[3] >> 4, raw[3] >> 1 & 7
    if block_code == 0 or rate_code == 15 or channels > 10 or depth_code == 3:
        return None
    first, at = raw[4], 5
    more = 0 if first < 0x80 else 8 - (first ^ 0xFF).bit_length() - 1
    if first >= 0x80 and not 1 <= more <= 6:
        return None
    number = first if not more else first & (0x3F >> more)
    if len(raw) < at + more + 5:
        return None
    for b in raw[at : at + more]:
        if b & 0xC0 != 0x80:
            return None
        number = number << 6 | b & 0x3F
    at += more
    block = BLOCKS.get(block_code)
    if block is None:
        width = block_code - 5
        block = int.from_bytes(raw[at : at + width], "big") + 1
        at += width
    at += {12: 1, 13: 2, 14: 2}.get(rate_code, 0)
    if len(raw) <= at or crc8(raw[:at]) != raw[at]:
        return None
    place = number if variable else number * stream.block
    return Head(place, block, channels, DEPTHS.get(depth_code, stream.bits), at + 1)


class Bits:
    """Bits of a frame from a place on; ``IndexError`` where they end."""

    def __init__(self, raw: bytes, at: int):
        self.bits = np.unpackbits(np.frombuffer(raw, np.uint8))
        self.at = at * 8
        n = len(self.bits)
        nearest = np.where(self.bits > 0, np.arange(n), n)
        self.next_one = np.minimum.accumulate(nearest[::-1])[::-1].tolist()

    def number(self, n: int) -> int:
        return int(self.numbers(np.array([self.at]), n, True)[0])

    def numbers(self, places: np.ndarray, n: int, move: bool = False) -> np.ndarray:
        """Unsigned numbers of ``n`` bits at ``places``."""
        if len(places) and places[-1] + n > len(self.bits):
            raise IndexError
        if move:
            self.at += n
        if not n:
            return np.zeros(len(places), np.int64)
        return self.bits[places[:, None] + np.arange(n)] @ (np.int64(1) << np.arange(n - 1, -1, -1, dtype=np.int64))

    def signed(self, n: int, count: int) -> np.ndarray:
        out = self.numbers(self.at + n * np.arange(count), n)
        self.at += n * count
        return out - ((out >> (n - 1)) << n) if n else out

    def unary(self) -> int:
        one = self.next_one[self.at]
        if one >= len(self.bits):
            raise IndexError
        q, self.at = one - self.at, one + 1
        return q

    def rice(self, k: int, count: int) -> np.ndarray:
        ones, at, following = [], self.at, self.next_one
        for _ in range(count):
            one = following[at]
            ones.append(one)
            at = one + 1 + k
        ones = np.array(ones, np.int64)
        if count and at > len(self.bits):
            raise IndexError
        starts = np.concatenate([[self.at], ones[:-1] + 1 + k]) if count else ones
        self.at = at
        value = (ones - starts) << k | self.numbers(ones + 1, k)
        return value >> 1 ^ -(value & 1)


@dataclass
class Sub:
    """A channel of a frame: samples, or first samples, residual and the predictor that makes the others of them."""

    samples: np.ndarray
    residual: np.ndarray | None = None
    weights: np.ndarray | None = None
    shift: int = 0
    wasted: int = 0


@dataclass
class Frame:
    head: Head
    subs: list[Sub] = field(default_factory=list)


def _residual(bits: Bits, block: int, order: int) -> np.ndarray:
    wide = bits.number(2)
    if wide > 1:
        raise ValueError("an unknown way of coding a residual")
    parts, out = bits.number(4), []
    for i in range(1 << parts):
        count = (block >> parts) - (order if i == 0 else 0)
        k = bits.number(5 if wide else 4)
        if k == (31 if wide else 15):
            out.append(bits.signed(bits.number(5), count))
        else:
            out.append(bits.rice(k, count))
    return np.concatenate(out)


def _sub(bits: Bits, block: int, depth: int) -> Sub:
    if bits.number(1):
        raise ValueError("not a subframe")
    kind, wasted = bits.number(6), 0
    if bits.number(1):
        wasted = bits.unary() + 1
    depth -= wasted
    if kind == 0:
        return Sub(np.repeat(bits.signed(depth, 1), block), wasted=wasted)
    if kind == 1:
        return Sub(bits.signed(depth, block), wasted=wasted)
    if 8 <= kind <= 12:
        order = kind - 8
        first = bits.signed(depth, order)
        return Sub(integrated(first, _residual(bits, block, order)), wasted=wasted)
    if kind < 32:
        raise ValueError("an unknown kind of subframe")
    order = kind - 31
    first, precision = bits.signed(depth, order), bits.number(4) + 1
    shift = int(bits.signed(5, 1)[0])
    if precision == 16 or shift < 0:
        raise ValueError("an unknown predictor")
    weights = bits.signed(precision, order)
    return Sub(first, _residual(bits, block, order), weights, shift, wasted)


def integrated(first: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """Samples whose differences of the order of ``first`` are the residual."""
    x = residual
    for level in range(len(first) - 1, -1, -1):
        x = np.cumsum(x) + np.diff(first, n=level)[-1]
    return np.concatenate([first, x])


def frame_at(read: Callable[[int, int], bytes], at: int, stream: Stream) -> tuple[Frame, int] | None:
    """The frame that starts at a byte, and the byte after it; None where none does."""
    size = stream.longest + 64 if stream.longest else WINDOW
    while True:
        raw = read(at, size)
        head = frame_head(raw[:32], stream)
        if head is None:
            return None
        try:
            bits, frame = Bits(raw, head.size), Frame(head)
            count = head.channels + 1 if head.channels < 8 else 2
            for i in range(count):
                side = (head.channels, i) in ((8, 1), (9, 0), (10, 1))
                frame.subs.append(_sub(bits, head.block, head.bits + side))
            end = -(-bits.at // 8)
            if end + 2 > len(raw):
                raise IndexError
            return (frame, at + end + 2) if crc16(raw[:end]) == int.from_bytes(raw[end : end + 2], "big") else None
        except ValueError:
            return None
        except IndexError:
            if len(raw) < size:
                return None  # the file ends here
            size *= 4


def _predicted(frames: list[Frame]) -> None:
    """Gives all linearly predicted channels their samples, those of one order and length together."""
    todo: dict[tuple[int, int], list[Sub]] = {}
    for f in frames:
        for s in f.subs:
            if s.weights is not None:
                todo.setdefault((len(s.weights), len(s.residual)), []).append(s)
    for (order, n), subs in todo.items():
        out = np.zeros((order + n, len(subs)), np.int64)
        out[:order] = np.array([s.samples for s in subs]).T
        weights, shift, rest = np.array([s.weights[::-1] for s in subs]).T, np.array([s.shift for s in subs]), np.array([s.residual for s in subs]).T
        for i in range(n):
            out[order + i] = rest[i] + ((out[i : i + order] * weights).sum(axis=0) >> shift)
        for j, s in enumerate(subs):
            s.samples = out[:, j]


def _channels(frame: Frame) -> np.ndarray:
    x = [s.samples << s.wasted for s in frame.subs]
    code = frame.head.channels
    if code == 8:
        x = [x[0], x[0] - x[1]]
    elif code == 9:
        x = [x[0] + x[1], x[1]]
    elif code == 10:
        whole = x[0] << 1 | x[1] & 1
        x = [whole + x[1] >> 1, whole - x[1] >> 1]
    return np.array(x) / 2.0 ** (frame.head.bits - 1)


def decoded(read: Callable[[int, int], bytes], stream: Stream, lo: int, hi: int) -> Iterator[tuple[int, np.ndarray]]:
    """(place, samples by channel within -1 and 1) of the frames that start from byte ``lo`` on and before ``hi``."""
    at, held = max(lo, stream.start), []
    while at < hi:
        found = frame_at(read, at, stream)
        if found is None:  # on to the next code of a frame: at the start of a part, or past a damaged frame
            raw = read(at + 1, min(WINDOW, hi - at) + 1)
            place = raw.find(b"\xff")
            while 0 <= place < len(raw) - 1 and raw[place + 1] & 0xFE != 0xF8:
                place = raw.find(b"\xff", place + 1)
            if place < 0:
                at += max(len(raw), 1)
            else:
                at += 1 + place
            if not raw:
                break
            continue
        frame, at = found
        held.append(frame)
        if len(held) >= BATCH:
            _predicted(held)
            yield from ((f.head.place, _channels(f)) for f in held)
            held = []
    _predicted(held)
    yield from ((f.head.place, _channels(f)) for f in held)
