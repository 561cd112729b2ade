"""Motion-JPEG in AVI as a column: written, indexed, decoded, cut into shots.

Writing: each byte is a grey sample, stored as a block of 8 x 8 equal pixels; the quantiser is 8, so a sample v is exactly
the block's only coefficient, v - 128, and a lossy format's decoder gives every byte back. All frames have the same
size, ROWS x COLUMNS samples; the last is filled up, and the stream's private data (``strd``) say how many samples count.

Reading: the RIFF tree is walked, frames are taken by the ``idx1`` index, and each frame is decoded by its own markers:
size, quantiser, Huffman tables. The decoder is a general baseline one for grey frames (DC differences, AC coefficients,
zero runs, restart markers, inverse transform). Where a frame's own tables give every block the same number of bits and no
AC value, as the writer's do, its scan is decoded as a whole from those same tables. Anything else (other processes,
colours, broken data) is rejected with a reason.

Shots: a frame's histogram has 32 bins over the samples that count. A shot ends where the difference to the next
histogram is over mean + ``spread`` deviations of the differences in the window before it, and over ``least``.

Null or empty text: one unit of padding. Null doc_id: passed through. Repeated rows: equal results. Very long texts: more
frames of the same size. Media that can't be read: one row with the reason in ``error``, nulls else.
"""

from __future__ import annotations

import functools
import hashlib
import struct
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import map_texts, texts

UNIT, PAD, RATE = 192, 32, 25
#: Samples of a frame.
COLUMNS, ROWS = UNIT, 4
SAMPLES = COLUMNS * ROWS
BLOCK, QUANTISER = 8, 8

#: The writer's Huffman code of size c of a difference: as many ones as 8 - c, and a zero; size 8 has one bit, size 0 nine.
#: With its c value bits, each difference has 9 bits; the end of a block has one.
SIZES = bytes(range(8, -1, -1))
#: Order of a block's coefficients in a scan, as (row, column) along anti-diagonals.
ZIGZAG = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (sum(x), x[1] if sum(x) % 2 == 0 else x[0]))
#: The inverse transform: pixel by frequency.
COSINES = np.cos((2 * np.arange(8)[:, None] + 1) * np.arange(8) * np.pi / 16) / 2
COSINES[:, 0] = 8**-0.5


class Rejected(ValueError):
    """Media that this reader doesn't decode, with the reason."""


def segment(marker: int, data: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(data) + 2) + data


def value_bits(d: int) -> tuple[int, int]:
    """Size of a difference, and its bits."""
    size = abs(d).bit_length()
    return size, d if d >= 0 else d + (1 << size) - 1


def codes_of(table: bytes) -> dict[tuple[int, int], int]:
    """(length, code) of each symbol of a Huffman table: 16 counts by length, then the symbols."""
    out, code, at = {}, 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            if at >= len(table) or code >> length:
                raise Rejected("a Huffman table is broken")
            out[length, code] = table[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


@functools.lru_cache(maxsize=64)
def fixed_fields(dc: bytes, ac: bytes) -> tuple[int, int, np.ndarray] | None:
    """(bits of a difference, bits of a whole block, difference by its bits) if the tables give each block the same
    number of bits: every size's code and value together, and an end of block only. None if they don't."""
    sizes, ends = codes_of(dc), codes_of(ac)
    width = {length + size for (length, _), size in sizes.items()}
    if len(width) != 1 or list(ends.values()) != [0] or max(width) > 14 or max(sizes.values()) > 11:
        return None
    bits, end_bits = width.pop(), next(iter(ends))[0]
    back = np.full(1 << bits, 1 << 14, np.int32)
    for (_, code), size in sizes.items():
        values = np.arange(1 << size)
        half = (1 << size) // 2  # below it are the negative ones
        back[(code << size) + values] = np.where(values >= half, values, values - (1 << size) + 1)
    return bits, bits + end_bits, back


DC_TABLE = bytes([1] * 9 + [0] * 7) + SIZES
AC_TABLE = bytes([1] + [0] * 15) + b"\0"


@functools.cache
def difference_codes() -> np.ndarray:
    """The writer's 9 bits of each difference -255..255, at difference + 255."""
    by_size = {size: (length, code) for (length, code), size in codes_of(DC_TABLE).items()}
    found = []
    for d in range(-255, 256):
        size, value = value_bits(d)
        found.append(by_size[size][1] << size | value)
    return np.array(found, np.uint64)


@functools.cache
def frame_head() -> bytes:
    return (
        b"\xff\xd8"
        + segment(0xDB, bytes([0, QUANTISER] + [1] * 63))
        + segment(0xC0, struct.pack(">BHHB", 8, ROWS * BLOCK, COLUMNS * BLOCK, 1) + bytes([1, 0x11, 0]))
        + segment(0xC4, b"\x00" + DC_TABLE + b"\x10" + AC_TABLE)
        + segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    )


def encode_frames(payload: bytes) -> list[bytes]:
    filled = payload + bytes([PAD]) * (-len(payload) % SAMPLES)
    v = np.frombuffer(filled, np.uint8).astype(np.int32).reshape(-1, SAMPLES) - 128
    d = np.diff(v, axis=1, prepend=0)
    fields = (difference_codes()[d + 255] << np.uint64(1)).reshape(-1, 4)  # the end of a block is one zero
    packed = (fields[:, 0] << np.uint64(30)) | (fields[:, 1] << np.uint64(20)) | (fields[:, 2] << np.uint64(10)) | fields[:, 3]
    scans = np.ascontiguousarray(packed.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:]).tobytes()
    step, head = SAMPLES * 10 // 8, frame_head()
    return [head + scans[a : a + step].replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for a in range(0, len(scans), step)]


def avi(frames: list[bytes], columns: int, rows: int, samples: int) -> bytes:
    """Frames of columns x rows pixels as an AVI file; samples: how many count, in the private data."""
    largest = max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // RATE, largest * RATE, 0, 0x10, len(frames), 0, 1, largest, columns, rows, 0, 0, 0, 0)
    timing = struct.pack("<IHHIIIIIIII", 0, 0, 0, 0, 1, RATE, 0, len(frames), largest, 0xFFFFFFFF, 0)
    stream = b"vidsMJPG" + timing + struct.pack("<hhhh", 0, 0, columns, rows)
    picture = struct.pack("<IiiHH4sIiiII", 40, columns, rows, 1, 8, b"MJPG", columns * rows, 0, 0, 0, 0)

    def chunk(name: bytes, data: bytes) -> bytes:
        return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)

    lists = chunk(b"strh", stream) + chunk(b"strf", picture) + chunk(b"strd", struct.pack("<Q", samples))
    header = chunk(b"LIST", b"hdrl" + chunk(b"avih", main) + chunk(b"LIST", b"strl" + lists))
    movie, index, at = [b"movi"], [], 4
    for f in frames:
        movie.append(chunk(b"00dc", f))
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(f)))
        at += len(movie[-1])
    return chunk(b"RIFF", b"AVI " + header + chunk(b"LIST", b"".join(movie)) + chunk(b"idx1", b"".join(index)))


def write_avi(payload: bytes) -> bytes:
    """payload: a positive multiple of UNIT bytes."""
    return avi(encode_frames(payload), COLUMNS * BLOCK, ROWS * BLOCK, len(payload))


def chunks(data: bytes, at: int, end: int):
    """(name, start, end) of the chunks of a list."""
    while at + 8 <= end:
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if at + 8 + size > end:
            raise Rejected("a chunk is cut off")
        yield data[at : at + 4], at + 8, at + 8 + size
        at += 8 + size + (size & 1)


class Head:
    """What a frame's markers say: where the scan starts, size in blocks, quantiser, tables, restart interval."""

    def __init__(self, frame: bytes):
        self.tables: dict[int, bytes] = {}
        self.quantisers: dict[int, list[int]] = {}
        self.restart, size, parts = 0, None, b""
        at = 2
        if frame[:2] != b"\xff\xd8":
            raise Rejected("a frame is no JPEG")
        while True:
            if at + 4 > len(frame) or frame[at] != 0xFF:
                raise Rejected("a frame's markers are broken")
            marker, n = frame[at + 1], int.from_bytes(frame[at + 2 : at + 4], "big")
            body = frame[at + 4 : at + 2 + n]
            if marker == 0xDB:
                self.read_quantisers(body)
            elif marker == 0xC0:
                size, parts = struct.unpack(">BHHB", body[:6]), body[6:]
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise Rejected("a frame is not baseline")
            elif marker == 0xC4:
                while body:
                    n_symbols = sum(body[1:17])
                    self.tables[body[0]] = body[1 : 17 + n_symbols]
                    body = body[17 + n_symbols :]
            elif marker == 0xDD:
                self.restart = int.from_bytes(body[:2], "big")
            at += 2 + n
            if marker == 0xDA:
                break
        if size is None or size[0] != 8 or size[3] != 1 or len(body) < 3:
            raise Rejected("a frame is not grey with 8 bits")
        try:
            self.dc, self.ac = self.tables[body[2] >> 4], self.tables[0x10 | body[2] & 15]
            self.quantiser = self.quantisers[parts[2]]
        except (KeyError, IndexError):
            raise Rejected("a frame's tables are missing") from None
        self.head, self.height, self.width = frame[:at], size[1], size[2]
        self.rows, self.columns = -(-size[1] // BLOCK), -(-size[2] // BLOCK)
        self.fixed = None if self.restart else fixed_fields(self.dc, self.ac)

    def read_quantisers(self, body: bytes) -> None:
        while body:
            wide = body[0] >> 4
            n = 64 * (1 + wide)
            self.quantisers[body[0] & 15] = list(struct.unpack(">64H" if wide else "64B", body[1 : 1 + n]))
            body = body[1 + n :]


def scan_coefficients(head: Head, scan: bytes) -> np.ndarray:
    """Quantised coefficients by block, in scan order, read bit by bit with the frame's own tables."""
    dc, ac = codes_of(head.dc), codes_of(head.ac)
    out = np.zeros((head.rows * head.columns, 64), np.int64)
    parts, at, k = [], 0, 0
    while (k := scan.find(b"\xff", k)) >= 0:  # restart markers part the scan, a zero byte after FF is not data
        if b"\xd0" <= scan[k + 1 : k + 2] <= b"\xd7":
            parts.append(scan[at:k])
            at = k + 2
        k += 2
    parts.append(scan[at:])
    block = 0
    for part in parts:
        data = part.replace(b"\xff\x00", b"\xff")
        bits = np.unpackbits(np.frombuffer(data, np.uint8)).tolist()
        place, last = 0, 0

        def number(n: int) -> int:
            nonlocal place
            if place + n > len(bits):
                raise Rejected("a scan is cut off")
            value = 0
            for b in bits[place : place + n]:
                value = value << 1 | b
            place += n
            return value if not n or value >> (n - 1) else value - (1 << n) + 1

        def symbol(codes: dict) -> int:
            nonlocal place
            code = 0
            for length in range(1, 17):
                if place >= len(bits):
                    break
                code, place = code << 1 | bits[place], place + 1
                if (length, code) in codes:
                    return codes[length, code]
            raise Rejected("a scan has an unknown code or is cut off")

        for _ in range(min(len(out) - block, head.restart or len(out))):
            last += number(symbol(dc))
            out[block, 0] = last
            i = 1
            while i < 64 and (s := symbol(ac)):
                i += s >> 4
                if s != 0xF0:
                    if i > 63:
                        raise Rejected("a block has too many coefficients")
                    out[block, i] = number(s & 15)
                i += 1
            block += 1
    if block < len(out):
        raise Rejected("a scan is cut off")
    return out


def pixels(head: Head, scan: bytes) -> np.ndarray:
    """Rows of pixels of a frame, by inverse transform."""
    found = scan_coefficients(head, scan) * np.array(head.quantiser)
    square = np.zeros((len(found), 8, 8))
    for i, (r, c) in enumerate(ZIGZAG):
        square[:, r, c] = found[:, i]
    blocks = np.clip(np.rint(COSINES @ square @ COSINES.T + 128), 0, 255).astype(np.uint8)
    whole = blocks.reshape(head.rows, head.columns, 8, 8).swapaxes(1, 2).reshape(head.rows * 8, head.columns * 8)
    return whole[: head.height, : head.width]


def fields_of(scans: list[bytes], head: Head) -> np.ndarray:
    """Samples by frame, of scans whose blocks have a fixed number of bits and only a DC value."""
    bits, whole, back = head.fixed
    n = head.rows * head.columns
    size = -(-n * whole // 8)
    if any(len(s) != size for s in scans):
        raise Rejected("a scan is cut off")
    raw = np.frombuffer(b"".join(scans), np.uint8).reshape(len(scans), size)
    if whole == 10 and n % 4 == 0:
        wide = np.zeros((len(scans) * n // 4, 8), np.uint8)
        wide[:, 3:] = raw.reshape(-1, 5)
        packed = wide.view(">u8")[:, 0].astype(np.uint64)
        fields = np.stack([(packed >> np.uint64(s)) & np.uint64(1023) for s in (30, 20, 10, 0)], axis=1)
        fields = fields.reshape(len(scans), n).astype(np.int64) >> 1
    else:
        bit = np.unpackbits(raw, axis=1)[:, : n * whole].reshape(len(scans), n, whole)[:, :, :bits].astype(np.int64)
        fields = bit @ (1 << np.arange(bits - 1, -1, -1))
    d = back[fields]
    if d.max() >= 1 << 14:
        raise Rejected("a scan has an unknown code")
    return np.clip(np.rint(np.cumsum(d, axis=1) * (head.quantiser[0] / 8)) + 128, 0, 255).astype(np.uint8)


def read_frames(data: bytes) -> tuple[list[np.ndarray], float, int | None]:
    """Decoded frames (one sample a block where all blocks are flat, else pixels), frames by second, samples that count."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise Rejected("no AVI file")
    movie = index = rate = counted = None
    for name, a, b in chunks(data, 12, len(data)):
        kind = data[a : a + 4]
        if name == b"LIST" and kind == b"movi":
            movie = a
        elif name == b"LIST" and kind == b"hdrl":
            for inner, x, y in chunks(data, a + 4, b):
                if inner == b"avih":
                    rate = 1_000_000 / max(1, int.from_bytes(data[x : x + 4], "little"))
                elif inner == b"LIST":
                    for deep, p, q in chunks(data, x + 4, y):
                        if deep == b"strd" and q - p == 8:
                            counted = int.from_bytes(data[p:q], "little")
        elif name == b"idx1":
            index = np.frombuffer(data[a : b - (b - a) % 16], np.dtype("<u4")).reshape(-1, 4)
    if movie is None or index is None or rate is None or not len(index):
        raise Rejected("no header, index or frame")
    out: list[np.ndarray] = []
    head, scans = None, []

    def flush() -> None:
        if scans:
            out.extend(fields_of(scans, head))
            scans.clear()

    for start, size in zip((index[:, 2].astype(np.int64) + movie + 8).tolist(), index[:, 3].tolist()):
        frame = data[start : start + size]
        if frame[-2:] != b"\xff\xd9" or len(frame) != size:
            raise Rejected("a frame is cut off")
        if head is None or not frame.startswith(head.head):
            flush()
            head = Head(frame)
        scan = frame[len(head.head) : -2]
        if head.fixed:
            scans.append(scan.replace(b"\xff\x00", b"\xff"))
        else:
            out.append(pixels(head, scan).ravel())
    flush()
    return out, rate, counted


def read_avi(data: bytes) -> tuple[list[np.ndarray], float]:
    """Samples that count, by frame (the last one may have fewer), and frames by second."""
    frames, rate, counted = read_frames(data)
    if counted is not None:
        kept = []
        for f in frames:
            kept.append(f[: max(0, counted)])
            counted -= len(f)
        frames = [f for f in kept if len(f)]
    return frames, rate


def shots(frames: list[np.ndarray], window: int = 8, spread: float = 3.0, least: float = 0.15) -> list[tuple[int, int]]:
    """(first frame, end frame) of each shot. A difference is the share of the histograms that doesn't overlap."""
    n = len(frames)
    sizes = np.array(list(map(len, frames)))
    of = np.repeat(np.arange(n), sizes) * 32 + (np.concatenate(frames) >> 3)
    bins = np.bincount(of, minlength=32 * n).reshape(n, 32) / sizes[:, None]
    d = np.abs(np.diff(bins, axis=0)).sum(axis=1) / 2
    cuts = [0]
    for i, x in enumerate(d.tolist()):
        if x >= least:
            before = d[max(0, i - window) : i]
            if len(before) == 0 or x > before.mean() + spread * before.std() + 1e-9:
                cuts.append(i + 1)
    return list(zip(cuts, [*cuts[1:], n]))


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8, padded to a positive multiple of UNIT; the unpadded length."""
    raw = (text or "").encode()
    return raw + bytes([PAD]) * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw)), len(raw)


def clips(media: DataFrame) -> DataFrame:
    """Timed clip rows of (doc_id, media): doc_id, clip, start_s, end_s, mean of the samples, error. Media that is null or
    can't be read gives one row with the reason."""

    def rows(ids, batch):
        for i, data in zip(ids, batch):
            try:
                if data is None:
                    raise Rejected("no media")
                frames, rate = read_avi(data)
                found = [(i, k, a / rate, b / rate, float(np.concatenate(frames[a:b]).mean()), None) for k, (a, b) in enumerate(shots(frames))]
            except Rejected as e:
                found = [(i, None, None, None, None, str(e))]
            yield from found

    return map_texts(media, "doc_id long, clip int, start_s double, end_s double, mean double, error string", rows, second="media")


def media_files(docs: DataFrame) -> DataFrame:
    """doc_id, media: each text as an AVI file."""

    def rows(ids, batch):
        return ((i, write_avi(payload_of(t)[0])) for i, t in zip(ids, batch))

    return map_texts(texts(docs), "doc_id long, media binary", rows)


def media_digests(docs: DataFrame) -> DataFrame:
    """Each text stored as AVI, read back by its index, cut into shots: sizes, digests, and the shots as a feature
    ("frames;start-end:mean,..." in seconds)."""
    names = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long"

    def rows(ids, batch):
        for i, t in zip(ids, batch):
            payload, n = payload_of(t)
            media = write_avi(payload)
            frames, rate = read_avi(media)
            back = b"".join(f.tobytes() for f in frames)
            sums = np.concatenate(([0], np.cumsum([int(f.sum(dtype=np.int64)) for f in frames])))
            sizes = np.concatenate(([0], np.cumsum(list(map(len, frames)))))
            parts = (f"{a / rate:.2f}-{b / rate:.2f}:{(sums[b] - sums[a]) / (sizes[b] - sizes[a]):.3f}" for a, b in shots(frames))
            feature = f"{len(frames)};" + ",".join(parts)
            digests = hashlib.sha256(back).hexdigest(), crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest()
            yield i, n, len(back), *digests, feature

    return map_texts(texts(docs), f"{names}, media_sha256 string, feature string", rows)
