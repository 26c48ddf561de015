"""AVI motion-JPEG columns: payloads as lossless intra frames, shots by adaptive histogram differences.

Frames are lossless JPEG pictures (Huffman process with predictor 1, 8-bit samples), 64
samples wide, with a restart interval of one row. So rows are coded independently of each other, and
both coder and decoder treat all rows of many frames at once, column by column. The container is an AVI
file: headers, a stream-data chunk that tells the payload's length, the frames and their index. Reading goes the way a
player does: RIFF chunks, the index, the frames' markers, entropy decoding to samples.

Other AVI files may hold baseline JPEG frames; those are decoded to luma samples one by one, with the standard Huffman tables where a frame brings none, as
motion-JPEG writers leave them out. Frames are found by the old index, by the standard indexes of larger files, or without either by walking the frame list.

Shots: the distance of consecutive frames' sample histograms is compared with mean and spread of the distances since
the last cut. Each shot is a clip with its times.

Fixed results: a null text is the empty one; an empty payload is 64 zero bytes; a payload is padded to a multiple of 64;
frames are coded some hundred at a time, so a very long text needs memory in proportion to its own bytes only; repeated rows give equal
values; a null id stays null; an empty table gives no row; other columns are never read. ``media_clips`` gives a file that cannot be read one row with its
fault in ``status`` and no clip, and never ends the job for it; a null file has no row.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_size, slim, texts_of

WIDTH, ROWS = 64, 32
FRAME = WIDTH * ROWS
FRAME_MICROS = 40_000
#: Frames that one vectorised step codes.
STEP = 512
HIST_BINS = 32
CUT_SPREADS, CUT_LEAST, CUT_WARM = 3.0, 0.25, 4

# Markers of JPEG (fixed values of the format).
_SOI, _EOI, _SOF3, _DHT, _SOS, _DRI = 0xD8, 0xD9, 0xC3, 0xC4, 0xDA, 0xDD
#: Categories 0 to 8, each with a code of four bits.
_CODE_BITS = 4
_HEAD = (
    bytes([0xFF, _SOI])
    + bytes([0xFF, _DHT]) + struct.pack(">H", 2 + 17 + 9) + bytes([0, 0, 0, 0, 9, *[0] * 12]) + bytes(range(9))
    + bytes([0xFF, _SOF3]) + struct.pack(">HBHHB", 11, 8, ROWS, WIDTH, 1) + bytes([1, 0x11, 0])
    + bytes([0xFF, _DRI]) + struct.pack(">HH", 4, WIDTH)
    + bytes([0xFF, _SOS]) + struct.pack(">HB", 8, 1) + bytes([1, 0, 1, 0, 0])
)
_TAIL = bytes([0xFF, _EOI])
_CATEGORY = np.array([int(v).bit_length() for v in range(256)], np.int64)


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """Lossless JPEG pictures of the samples, shape (frames, ROWS, WIDTH)."""
    frames = len(samples)
    rows = samples.reshape(-1, WIDTH).astype(np.int16)
    n = len(rows)
    diff = np.empty((n, WIDTH), np.int64)
    diff[:, 0] = rows[:, 0] - 128
    diff[:, 1:] = rows[:, 1:] - rows[:, :-1]
    cat = _CATEGORY[np.abs(diff)]
    code = (cat << cat) | np.where(diff < 0, diff + (1 << cat) - 1, diff)
    size = cat + _CODE_BITS
    end = np.cumsum(size, axis=1)
    widest = WIDTH * 12 // 8 + 2
    bits = np.zeros(n * widest, np.uint8)
    base = np.arange(n, dtype=np.int64) * widest
    for j in range(WIDTH):
        at = end[:, j] - size[:, j]
        value = code[:, j] << (24 - (at & 7) - size[:, j])
        where = base + (at >> 3)
        bits[where] |= (value >> 16).astype(np.uint8)
        bits[where + 1] |= (value >> 8 & 255).astype(np.uint8)
        bits[where + 2] |= (value & 255).astype(np.uint8)
    held = (end[:, -1] + 7) >> 3
    bits[base + held - 1] |= ((1 << (-end[:, -1] & 7)) - 1).astype(np.uint8)
    bits = bits.reshape(n, widest)
    valid = np.arange(widest) < held[:, None]
    stuffed = (bits == 255) & valid
    shift = np.cumsum(stuffed, axis=1)
    row_size = held + shift[:, -1] + 2  # a restart marker behind each row; the frame's end marker behind the last
    row_start = (np.cumsum(row_size) - row_size) + len(_HEAD) * (np.arange(n) // ROWS + 1)
    out = np.zeros(int(row_size.sum()) + frames * len(_HEAD), np.uint8)
    out[(row_start[:, None] + np.arange(widest) + shift - stuffed)[valid]] = bits[valid]
    mark = row_start + row_size - 2
    out[mark] = 255
    nth = np.arange(n) % ROWS
    out[mark + 1] = np.where(nth == ROWS - 1, _EOI, 0xD0 + nth % 8)
    first = row_start[::ROWS] - len(_HEAD)
    out[first[:, None] + np.arange(len(_HEAD))] = np.frombuffer(_HEAD, np.uint8)
    raw, ends = out.tobytes(), [*first[1:].tolist(), len(out)]
    return [raw[a:b] for a, b in zip(first.tolist(), ends)]


class Picture:
    """What a frame's markers say."""

    def __init__(self, head: bytes):
        self.table: dict[int, np.ndarray] = {}
        self.restart, at = 0, 2
        if head[:2] != bytes([0xFF, _SOI]):
            raise ValueError("not a JPEG picture")
        while at < len(head):
            if head[at] != 0xFF:
                raise ValueError("a marker is missing")
            kind, (size,) = head[at + 1], struct.unpack_from(">H", head, at + 2)
            body = head[at + 4 : at + 2 + size]
            if kind == _SOF3:
                bits, self.rows, self.width, parts = struct.unpack_from(">BHHB", body)
                if bits != 8 or parts != 1:
                    raise ValueError("only one component of 8 bits is read")
            elif kind == _DHT:
                self.table[body[0]] = self._lookup(body[1:17], body[17:])
            elif kind == _DRI:
                (self.restart,) = struct.unpack(">H", body)
            elif kind == _SOS:
                self.huffman, self.predictor = body[2] >> 4, body[3]
            elif 0xC0 <= kind <= 0xCF:
                raise ValueError("not a lossless Huffman picture")
            at += 2 + size
        if self.restart != self.width or self.predictor != 1:
            raise ValueError("rows must restart and be predicted from the left")

    @staticmethod
    def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
        """For each 16 bits ahead: length of the code there << 8 | its symbol."""
        out, code, k = np.zeros(1 << 16, np.int64), 0, 0
        for size, count in enumerate(counts, 1):
            for _ in range(count):
                out[code << (16 - size) : (code + 1) << (16 - size)] = size << 8 | symbols[k]
                code, k = code + 1, k + 1
            code <<= 1
        return out


_PICTURES: dict[bytes, Picture] = {}


def _head_of(frame: bytes) -> bytes:
    """The bytes up to the entropy-coded data."""
    at = 2
    while True:
        kind, (size,) = frame[at + 1], struct.unpack_from(">H", frame, at + 2)
        at += 2 + size
        if kind == _SOS:
            return frame[:at]


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """The samples of frames that have equal headers, shape (frames, rows, width)."""
    head = _head_of(frames[0])
    if head not in _PICTURES:
        _PICTURES[head] = Picture(head)
    pic = _PICTURES[head]
    if not all(f.startswith(head) and f.endswith(_TAIL) for f in frames):
        raise ValueError("headers differ")
    coded = np.frombuffer(b"".join([f[len(head) :] for f in frames]), np.uint8)
    after_ff = np.zeros(len(coded), bool)
    after_ff[1:] = coded[:-1] == 255
    marker = after_ff & (coded != 0)  # restart markers and the end of each frame close a row
    keep = ~after_ff
    keep[:-1] &= ~marker[1:]
    data = np.concatenate([coded[keep], np.zeros(8, np.uint8)]).astype(np.uint64)
    ends = np.cumsum(keep)[marker]
    if len(ends) != len(frames) * pic.rows:
        raise ValueError("rows are missing")
    pos = np.concatenate([[0], ends[:-1]]) * 8
    window = np.zeros(len(data) - 4, np.uint64)
    for k in range(5):
        window = window << np.uint64(8) | data[k : k + len(window)]
    window, table = window.astype(np.int64), pic.table[pic.huffman]
    out = np.empty((len(ends), pic.width), np.uint8)
    value = np.full(len(ends), 128, np.int64)
    for j in range(pic.width):
        ahead, bit = window[pos >> 3], pos & 7
        entry = table[ahead >> (24 - bit) & 0xFFFF]
        size, cat = entry >> 8, entry & 255
        extra = ahead >> (40 - bit - size - cat) & ((1 << cat) - 1)
        value += np.where(extra < (1 << cat) >> 1, extra - (1 << cat) + 1, extra)
        out[:, j] = value
        pos = pos + size + cat
    return out.reshape(len(frames), pic.rows, pic.width)


def _zigzag() -> list[int]:
    """Row-major places of a block's coefficients in the order of the stream: diagonals, up and down in turn."""
    return [8 * i + j for i, j in sorted(((i, j) for i in range(8) for j in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))]


_ZIGZAG = _zigzag()
_COSINES = np.array([[np.sqrt((1 if u else 0.5) / 4) * np.cos((2 * x + 1) * u * np.pi / 16) for u in range(8)] for x in range(8)])


# The standard Huffman tables of baseline JPEG (class and number, codes of each length, symbols) for luma and chroma.
_DC = bytes(range(12))
_AC_LUMA_FIRST = bytes.fromhex("01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82 09 0a 16 17 18 19 1a 25 26 27 28 29 2a")
_AC_CHROMA_FIRST = bytes.fromhex("00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1 17 18 19 1a 26 27 28 29 2a")


def _with_rest(first: bytes) -> bytes:
    """All run and size symbols: those stated, then the others in ascending order."""
    every = [0, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))]
    return first + bytes(sorted(set(every) - set(first)))


_STANDARD = (
    (0x00, bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), _DC),
    (0x10, bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]), _with_rest(_AC_LUMA_FIRST)),
    (0x01, bytes([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]), _DC),
    (0x11, bytes([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119]), _with_rest(_AC_CHROMA_FIRST)),
)
_TABLES: dict[int, list[int]] = {}


def standard_tables() -> dict[int, list[int]]:
    """The standard tables by class and number, made once."""
    if not _TABLES:
        _TABLES.update({k: Picture._lookup(counts, symbols).tolist() for k, counts, symbols in _STANDARD})
    return dict(_TABLES)


class _Bits:
    """Reads one restart segment, without stuffed bytes, from its first bit on."""

    def __init__(self, data: bytes):
        self.data, self.pos = data + b"\xff" * 8, 0

    def peek(self, count: int) -> int:
        at, shift = divmod(self.pos, 8)
        return int.from_bytes(self.data[at : at + 5], "big") >> (40 - shift - count) & ((1 << count) - 1)

    def symbol(self, table: list[int]) -> int:
        entry = table[self.peek(16)]
        if not entry:
            raise ValueError("no such code")
        self.pos += entry >> 8
        return entry & 255

    def value(self, size: int) -> int:
        if not size:
            return 0
        v = self.peek(size)
        self.pos += size
        return v if v >> (size - 1) else v - (1 << size) + 1


def decode_baseline(frame: bytes) -> np.ndarray:
    """The luma samples of a baseline (or extended sequential, 8-bit) JPEG frame, shape (rows, width). Tables that it does not bring are the standard ones."""
    tables = standard_tables()
    quant: dict[int, np.ndarray] = {}
    at, restart, parts = 2, 0, []
    while True:
        if frame[at] != 0xFF:
            raise ValueError("a marker is missing")
        kind, (size,) = frame[at + 1], struct.unpack_from(">H", frame, at + 2)
        body, at = frame[at + 4 : at + 2 + size], at + 2 + size
        if kind == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 128 if wide else 64
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.float64)
                body = body[1 + n :]
        elif kind == _DHT:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = Picture._lookup(body[1:17], body[17 : 17 + n]).tolist()
                body = body[17 + n :]
        elif kind == _DRI:
            (restart,) = struct.unpack(">H", body)
        elif kind in (0xC0, 0xC1):
            bits, rows, width, count = struct.unpack_from(">BHHB", body)
            parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(count)]
            if bits != 8:
                raise ValueError("only samples of 8 bits are read")
        elif kind == _SOS:
            chosen = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
            break
        elif 0xC2 <= kind <= 0xCF:
            raise ValueError("not a sequential Huffman frame")
    if not parts or len(chosen) != len(parts):
        raise ValueError("one interleaved scan is read")
    coded = frame[at:]
    segments, start, i = [], 0, coded.find(b"\xff")
    while i >= 0 and i + 1 < len(coded):
        if coded[i + 1] == _EOI or 0xD0 <= coded[i + 1] <= 0xD7:
            segments.append(coded[start:i].replace(b"\xff\0", b"\xff"))
            start = i + 2
            if coded[i + 1] == _EOI:
                break
        i = coded.find(b"\xff", i + 2)
    most_h, most_v = max(p[1] for p in parts), max(p[2] for p in parts)
    if len(parts) == 1:  # a single component is not interleaved: its units are blocks
        parts, most_h, most_v = [(parts[0][0], 1, 1, parts[0][3])], 1, 1
    across, down = -(-width // (8 * most_h)), -(-rows // (8 * most_v))
    _, luma_h, luma_v, luma_q = parts[0]
    blocks = np.zeros((down * luma_v, across * luma_h, 64))
    per = restart or across * down
    for unit in range(across * down):
        if unit % per == 0:
            reader, before = _Bits(segments[unit // per]), [0] * len(parts)
        y, x = divmod(unit, across)
        for k, (name, h, v, _) in enumerate(parts):
            dc, ac = tables[chosen[name] >> 4], tables[0x10 | chosen[name] & 15]
            for b in range(h * v):
                before[k] += reader.value(reader.symbol(dc))
                block = blocks[y * v + b // h, x * h + b % h] if k == 0 else None
                if block is not None:
                    block[0] = before[0]
                n = 1
                while n < 64:
                    run, size = divmod(reader.symbol(ac), 16)
                    if not size and run < 15:
                        break
                    n += run
                    value = reader.value(size)
                    if block is not None and n < 64:
                        block[n] = value
                    n += 1
    square = np.zeros_like(blocks)
    square[:, :, _ZIGZAG] = blocks * quant[luma_q]
    samples = _COSINES @ square.reshape(*blocks.shape[:2], 8, 8) @ _COSINES.T + 128
    plane = samples.transpose(0, 2, 1, 3).reshape(blocks.shape[0] * 8, -1)
    high, wide = -(-rows * luma_v // most_v), -(-width * luma_h // most_h)
    return np.clip(np.rint(plane[:high, :wide]), 0, 255).astype(np.uint8)


def frame_histograms(frames: list[bytes]) -> np.ndarray:
    """Histograms of lossless frames with equal headers, many at a time, or of baseline frames one by one."""
    out = []
    for k in range(0, len(frames), STEP):
        some = frames[k : k + STEP]
        if bytes([0xFF, _SOF3]) in some[0][: len(_HEAD)]:
            out.append(histograms(decode_frames(some)))
        else:
            out += [histograms(decode_baseline(f)[None]) for f in some]
    return np.concatenate(out) if out else np.zeros((0, HIST_BINS))


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes], payload_bytes: int, height: int = ROWS) -> bytes:
    """An AVI file of the coded frames."""
    most = max(map(len, frames), default=0)
    avih = struct.pack("<14I", FRAME_MICROS, 0, 0, 0x10, len(frames), 0, 1, most, WIDTH, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, FRAME_MICROS, 1_000_000, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, WIDTH, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, height, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    strl = b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf) + _chunk(b"strd", struct.pack("<Q", payload_bytes))
    index, movi, at = [], [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        movi.append(_chunk(b"00dc", f))
        at += len(movi[-1])
    body = b"AVI " + _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", strl)) + _chunk(b"LIST", b"movi" + b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


def _indexed(data: bytes, at: int, size: int) -> list[tuple[int, int]]:
    """Places and lengths of frames that a standard index of a larger file names, or the index of such indexes."""
    width, _, kind, count = struct.unpack_from("<HBBI", data, at)
    out = []
    if kind == 0:  # an index of indexes: offset, size and duration of each
        for k in range(count):
            place, _, _ = struct.unpack_from("<QII", data, at + 24 + 16 * k)
            if data[place : place + 2] != b"ix":
                raise ValueError("an index is missing")
            out += _indexed(data, place + 8, struct.unpack_from("<I", data, place + 4)[0])
    elif kind == 1:
        (base,) = struct.unpack_from("<Q", data, at + 12)
        for k in range(count):
            place, length = struct.unpack_from("<II", data, at + 24 + 4 * width * k)
            out.append((base + place, length & 0x7FFFFFFF))
    else:
        raise ValueError("an unknown kind of index")
    return out


def read_avi(data: bytes) -> tuple[list[bytes], int | None, int]:
    """The frames in order, the payload's length if the stream data tells it, and microseconds a frame."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    found: dict[bytes, tuple[int, int]] = {}
    walked: list[tuple[int, int]] = []

    def walk(at: int, end: int, inside: bytes = b"") -> None:
        while at + 8 <= min(end, len(data)):
            name, (size,) = data[at : at + 4], struct.unpack_from("<I", data, at + 4)
            if name in (b"LIST", b"RIFF"):
                kind = data[at + 8 : at + 12]
                found.setdefault(kind, (at + 8, size))
                walk(at + 12, at + 8 + size, kind)
            elif inside in (b"movi", b"rec "):
                if name[2:] in (b"dc", b"db"):
                    walked.append((at + 8, size))
            else:
                found.setdefault(name, (at + 8, size))
            at += 8 + size + (size & 1)

    walk(0, len(data))
    if b"avih" not in found or b"movi" not in found:
        raise ValueError("a header or the frame list is missing")
    movi = found[b"movi"][0]
    if b"indx" in found:
        places = _indexed(data, *found[b"indx"])
    elif b"idx1" in found:
        index, size = found[b"idx1"]
        entries = [struct.unpack_from("<4sIII", data, k) for k in range(index, index + size - 15, 16)]
        start = movi if entries and data[movi + entries[0][2] : movi + entries[0][2] + 4] == entries[0][0] else 0  # some writers count from the file's beginning
        places = []
        for name, _, at, length in entries:
            if data[start + at : start + at + 4] != name:
                raise ValueError("the index points elsewhere")
            if name[2:] in (b"dc", b"db"):
                places.append((start + at + 8, length))
    else:
        places = walked
    if any(at + length > len(data) for at, length in places):
        raise ValueError("a frame is cut off")
    length = struct.unpack_from("<Q", data, found[b"strd"][0])[0] if b"strd" in found and found[b"strd"][1] == 8 else None
    return [data[at : at + size] for at, size in places], length, struct.unpack_from("<I", data, found[b"avih"][0])[0]


def histograms(samples: np.ndarray) -> np.ndarray:
    """Each frame's shares of samples in ``HIST_BINS`` equal ranges."""
    n = len(samples)
    bins = samples.reshape(n, -1) >> (8 - HIST_BINS.bit_length() + 1)
    flat = np.bincount((bins + np.arange(n)[:, None] * HIST_BINS).ravel(), minlength=n * HIST_BINS)
    return flat.reshape(n, HIST_BINS) / (samples.size / max(n, 1))


def shots(hist: np.ndarray) -> list[tuple[int, int]]:
    """First frame of each shot and the frame behind its last."""
    if not len(hist):
        return []
    moves = np.abs(np.diff(hist, axis=0)).sum(1) / 2
    cuts, since = [0], []
    for i, d in enumerate(moves.tolist(), 1):
        usual = float(np.mean(since) + CUT_SPREADS * np.std(since)) if len(since) >= CUT_WARM else 2 * CUT_LEAST
        if d > max(usual, CUT_LEAST):
            cuts.append(i)
            since = []
        else:
            since.append(d)
    return list(zip(cuts, [*cuts[1:], len(hist)]))


def clips(data: bytes) -> list[tuple[int, float, float, int]]:
    """Clip rows of an AVI file: number, start and end in seconds, frames."""
    frames, _, micros = read_avi(data)
    return [(k, a * micros / 1e6, b * micros / 1e6, b - a) for k, (a, b) in enumerate(shots(frame_histograms(frames)))]


def padded(text: str) -> tuple[bytes, int]:
    """UTF-8 bytes with zeros up to a positive multiple of 64, and their number before."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw + b"\0" * (-len(raw) % WIDTH or (0 if raw else WIDTH)), len(raw)


def store(payloads: list[bytes]) -> list[bytes]:
    """AVI files of the payloads (of multiples of 64 bytes); the last frame is filled up with zeros."""
    counts = [-(-len(p) // FRAME) for p in payloads]
    whole = b"".join([p.ljust(c * FRAME, b"\0") for p, c in zip(payloads, counts)])
    samples = np.frombuffer(whole, np.uint8).reshape(-1, ROWS, WIDTH)
    frames: list[bytes] = []
    for k in range(0, len(samples), STEP):
        frames += encode_frames(samples[k : k + STEP])
    out, at = [], 0
    for p, c in zip(payloads, counts):
        out.append(write_avi(frames[at : at + c], len(p)))
        at += c
    return out


def load(files: list[bytes]) -> list[tuple[bytes, np.ndarray, int]]:
    """Payload, histograms and microseconds a frame of each file."""
    read = [read_avi(f) for f in files]
    every = [f for frames, _, _ in read for f in frames]
    raws, hists = [], []
    for k in range(0, len(every), STEP):
        samples = decode_frames(every[k : k + STEP])
        raws.append(samples.tobytes())
        hists.append(histograms(samples))
    raw, hist = b"".join(raws), np.concatenate(hists) if hists else np.zeros((0, HIST_BINS))
    out, at = [], 0
    for frames, length, micros in read:
        start = at * FRAME
        out.append((raw[start : start + (len(frames) * FRAME if length is None else length)], hist[at : at + len(frames)], micros))
        at += len(frames)
    return out


def media_digest(docs: DataFrame) -> DataFrame:
    """Stores every text as an AVI file, reads it back, and gives checks of both and the shots found."""
    kind = dict(docs.dtypes)["doc_id"]
    schema = [("n_bytes", "bigint"), ("payload_bytes", "bigint"), ("payload_sha256", "string"), ("tail_crc32", "bigint"), ("media_bytes", "bigint"), ("media_sha256", "string"), ("feature", "string"), ("n_frames", "bigint"), ("n_clips", "bigint")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, STEP * FRAME):
            source = [padded(t) for t in texts_of(batch)]
            files = store([p for p, _ in source])
            rows = []
            for file, (_, n), (payload, hist, micros) in zip(files, source, load(files)):
                cut = shots(hist)
                mean = (hist.mean(0) * 255).round().astype(np.uint8).tobytes().hex()
                feature = f"shots={','.join(f'{x * micros / 1e6:.2f}-{y * micros / 1e6:.2f}' for x, y in cut)};hist={mean}"
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(file), hashlib.sha256(file).hexdigest(), feature, len(hist), len(cut)))
            columns = [pa.array(list(c), pa.string() if t == "string" else pa.int64()) for c, (_, t) in zip(zip(*rows), schema)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", *(s for s, _ in schema)])

    return slim(docs, "doc_id", "text").mapInArrow(each, f"doc_id {kind}, " + ", ".join(f"{n} {t}" for n, t in schema))


def media_clips(docs: DataFrame, column: str = "media") -> DataFrame:
    """Timed clip rows of a column of AVI files, with ``status`` ``ok``; a file that cannot be read has one row that tells why."""
    kind = dict(docs.dtypes)["doc_id"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, data in zip(batch.column("doc_id").to_pylist(), batch.column(column)):
                if not data.is_valid:
                    continue
                try:
                    rows = [(*c, "ok") for c in clips(data.as_py())]
                except (ValueError, IndexError, KeyError, struct.error, AttributeError, UnboundLocalError) as e:  # what a damaged file leads to
                    rows = [(None, None, None, None, f"{type(e).__name__}: {e}")]
                if rows:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.string()))]
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(rows), batch.schema.field("doc_id").type), *columns], names=["doc_id", "clip", "start_s", "end_s", "frames", "status"])

    return slim(docs, "doc_id", column).mapInArrow(each, f"doc_id {kind}, clip int, start_s double, end_s double, frames int, status string")
