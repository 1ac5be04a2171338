"""Media columns: AVI files of lossless motion JPEG, with shots found by histogram differences.

A payload of bytes becomes 24 x 24 frames of 8-bit samples. Each frame is a lossless JPEG (process 14: SOF3, predictor
1, one Huffman table), each a chunk of an AVI file with an idx1 index. Reading parses the file's headers for the frame
rate and size and goes by the index; each frame's markers are parsed (SOF3, DHT, SOS; comments and application data
are passed over) and its samples decoded by its own size and table. Frames with equal headers are coded in lockstep:
step k handles sample k of all frames, so numpy does the work whatever the mix of long and short payloads is; a long
payload goes through in blocks of frames. Lossless frames of one 8-bit component with predictor 1 are read; other
kinds (baseline, several components, restart intervals) raise ValueError, as do files of 4 GiB, which AVI cannot hold.

Shots: each frame has a 16-bin histogram; half the sum of absolute differences to the frame before is held against the
mean and deviation of the differences in the window before it, and against a least number of samples. The first
difference has none before it, so there the least number decides. All sums are integers, so equal payloads give equal
clips whatever stands beside them in a batch.

Null texts count as empty: n_bytes 0, one frame of padding. Ties, repeated rows, null or repeated ids and empty tables
need no care, since rows are independent; only id and text are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import map_texts, table

SIDE, FRAME, FPS, BINS = 24, 576, 25, 16
BLOCK = 2048  # frames coded at a time

# Code lengths of the Huffman table by difference category 0..8; no code is all ones.
CODE_LENGTHS = (5, 5, 4, 3, 2, 2, 3, 4, 6)


def _codes() -> tuple[list[int], np.ndarray]:
    """Categories in order of their codes, and each category's canonical code."""
    order = sorted(range(9), key=lambda s: (CODE_LENGTHS[s], s))
    codes, code, length = np.zeros(9, np.int64), 0, CODE_LENGTHS[order[0]]
    for s in order:
        code <<= CODE_LENGTHS[s] - length
        length = CODE_LENGTHS[s]
        codes[s] = code
        code += 1
    return order, codes


ORDER, CODES = _codes()
LENGTHS = np.array(CODE_LENGTHS, np.int64)
DIFF = np.arange(-255, 256)
CATEGORY = np.array([abs(int(d)).bit_length() for d in DIFF], np.int64)
WORD = (CODES[CATEGORY] << CATEGORY) | np.where(DIFF > 0, DIFF, DIFF + (1 << CATEGORY) - 1)
WORD_BITS = LENGTHS[CATEGORY] + CATEGORY


def _header() -> bytes:
    counts = bytes(sum(n == k for n in CODE_LENGTHS) for k in range(1, 17))
    table_ = b"\x00" + counts + bytes(ORDER)
    frame = struct.pack(">BHHB3B", 8, SIDE, SIDE, 1, 1, 0x11, 0)
    scan = bytes((1, 1, 0x00, 1, 0, 0))
    mark = lambda kind, body: b"\xff" + bytes((kind,)) + struct.pack(">H", len(body) + 2) + body
    return b"\xff\xd8" + mark(0xC3, frame) + mark(0xC4, table_) + mark(0xDA, scan)


HEADER = _header()


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """JPEG files of frames given as an array (n, 576) of bytes."""
    n = len(samples)
    x = samples.reshape(n, SIDE, SIDE).astype(np.int32)
    diff = np.empty_like(x)
    diff[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    diff[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    diff[:, 0, 0] = x[:, 0, 0] - 128
    at = diff.reshape(n, FRAME) + 255
    bits, word = WORD_BITS[at], WORD[at]
    ends = np.cumsum(bits, axis=1)
    size = (ends[:, -1] + 7) >> 3
    first = np.concatenate(([0], np.cumsum(size)))
    start = (ends - bits) + (first[:-1] << 3)[:, None]
    placed = (word << (24 - (start & 7) - bits)).ravel()
    byte = (start >> 3).ravel()
    out = np.zeros(int(first[-1]) + 3, np.int64)
    # words of one frame that begin in the same byte stand together, so their sums are taken over runs
    runs = np.flatnonzero(np.concatenate(([True], byte[1:] != byte[:-1])))
    total, where = np.add.reduceat(placed, runs), byte[runs]
    for k in range(3):
        np.add.at(out, where + k, (total >> (16 - 8 * k)) & 255)
    pad = (size << 3) - ends[:, -1]
    out[first[1:] - 1] += (1 << pad) - 1
    data = out[: int(first[-1])].astype(np.uint8)
    ff = data == 255
    grown = first + np.concatenate(([0], np.cumsum(ff)))[first]
    data = np.insert(data, np.flatnonzero(ff) + 1, 0).tobytes()
    edge = grown.tolist()
    return [HEADER + data[edge[i] : edge[i + 1]] + b"\xff\xd9" for i in range(n)]


@dataclass(frozen=True)
class Frame:
    """What a frame's markers say: its size, and by the next `peek` bits the category and the code's length."""

    wide: int
    high: int
    peek: int
    category: np.ndarray  # 255: no code
    used: np.ndarray


@lru_cache(maxsize=64)
def parse_header(header: bytes) -> Frame:
    """A frame from its markers, from the start to the end of the scan's header."""
    at, size, codes, scan = 2, None, {}, None
    while at < len(header):
        kind, n = header[at + 1], struct.unpack_from(">H", header, at + 2)[0]
        body, at = header[at + 4 : at + 2 + n], at + 2 + n
        if kind == 0xC3:
            bits, high, wide, parts = struct.unpack_from(">BHHB", body)
            if (bits, parts) != (8, 1) or not high or not wide:
                raise ValueError("not a frame of one 8-bit component")
            size = (wide, high)
        elif kind in (0xC0, 0xC1, 0xC2, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("not a lossless Huffman frame")
        elif kind == 0xC4:
            while body:
                counts = body[1:17]
                codes[body[0]] = (counts, body[17 : 17 + sum(counts)])
                body = body[17 + sum(counts) :]
        elif kind == 0xDD and any(body):
            raise ValueError("restart intervals are not read")
        elif kind == 0xDA:
            parts, _, selector, predictor, _, shift = struct.unpack_from("6B", body)
            if parts != 1 or predictor != 1 or shift:
                raise ValueError("not a scan of one component with predictor 1")
            scan = selector & 0xF0
    if size is None or scan is None or scan >> 4 not in codes:
        raise ValueError("no frame, scan or table")
    counts, symbols = codes[scan >> 4]
    peek = max((k for k in range(16) if counts[k]), default=-1) + 1
    if not peek or max(symbols) > 9:
        raise ValueError("not a table of 8-bit differences")
    category, used = np.full(1 << peek, 255, np.uint8), np.zeros(1 << peek, np.uint8)
    code = place = 0
    for length in range(1, peek + 1):
        for symbol in symbols[place : place + counts[length - 1]]:
            first = code << peek - length
            category[first : first + (1 << peek - length)] = symbol
            used[first : first + (1 << peek - length)] = length
            code += 1
        place += counts[length - 1]
        code <<= 1
    return Frame(*size, peek, category, used)


def split_frame(jpeg: bytes) -> tuple[bytes, bytes]:
    """A JPEG file's markers and its entropy-coded bytes."""
    if jpeg.startswith(HEADER):
        return HEADER, jpeg[len(HEADER) : -2]
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at = 2
    while at + 4 <= len(jpeg):
        if jpeg[at] != 0xFF:
            raise ValueError("no marker where one should be")
        kind, n = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        at += 2 + n
        if kind == 0xDA:
            end = jpeg.rfind(b"\xff\xd9")
            return jpeg[:at], jpeg[at : end if end >= at else len(jpeg)]
    raise ValueError("no scan")


def decode_frames(files: list[bytes]) -> np.ndarray:
    """Samples (n, size) of JPEG files of one size; those with equal headers are decoded in lockstep."""
    halves = [split_frame(x) for x in files]
    out: np.ndarray | None = None
    for header in dict.fromkeys(h for h, _ in halves):
        frame = parse_header(header)
        mine = [k for k, (h, _) in enumerate(halves) if h == header]
        if out is None:
            out = np.empty((len(files), frame.wide * frame.high), np.uint8)
        if out.shape[1] != frame.wide * frame.high:
            raise ValueError("frames of different sizes")
        out[mine] = _decoded(frame, [halves[k][1] for k in mine])
    return np.empty((0, FRAME), np.uint8) if out is None else out


def _decoded(frame: Frame, scans: list[bytes]) -> np.ndarray:
    n, size = len(scans), frame.wide * frame.high
    edge = np.concatenate(([0], np.cumsum([len(x) for x in scans])))
    data = np.frombuffer(b"".join(scans), np.uint8)
    keep = np.ones(len(data), bool)
    keep[1:] = ~((data[1:] == 0) & (data[:-1] == 255))
    if n > 1:
        keep[edge[1:-1]] = True
    first = np.concatenate(([0], np.cumsum(keep)))[edge]
    data = np.concatenate((data[keep], np.zeros(5, np.uint8))).astype(np.uint32)
    near = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]  # the 32 bits from each byte on
    bit = (first[:-1] << 3).astype(np.int64)
    last = (first[1:] << 3).astype(np.int64)
    diff = np.empty((size, n), np.int32)
    lengths, shift = frame.used.astype(np.uint32), np.uint32(32 - frame.peek)
    for k in range(size):
        window = near[bit >> 3] << (bit & 7).astype(np.uint32)
        code = window >> shift
        c = frame.category[code].astype(np.uint32)
        used = lengths[code]
        if c.max(initial=0) > 9:
            raise ValueError("broken entropy-coded data")
        extra = ((window << used) >> 1 >> (31 - c)).astype(np.int32)  # the c bits after the code; none for c = 0
        signed = c.astype(np.int32)
        diff[k] = np.where(extra >> np.maximum(signed - 1, 0), extra, extra - (1 << signed) + 1)
        bit += (used + c).astype(np.int64)
        if (bit > last).any():
            raise ValueError("entropy-coded data end too soon")
    d = diff.T.reshape(n, frame.high, frame.wide).copy()
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1)
    return (np.cumsum(d, axis=2) & 255).astype(np.uint8).reshape(n, size)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes]) -> bytes:
    """An AVI file with one video stream of MJPG frames and an index."""
    most = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(frames), 0, 1, most, SIDE, SIDE, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FPS, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    head = b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    chunks, index, at = [b"movi"], [], 4
    for x in frames:
        chunk = _chunk(b"00dc", x)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(x)))
        chunks.append(chunk)
        at += len(chunk)
    if at > 0xFFFF_0000:
        raise ValueError("over 4 GiB: more than an AVI file can hold")
    body = b"AVI " + _chunk(b"LIST", head) + _chunk(b"LIST", b"".join(chunks)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


@dataclass(frozen=True)
class Avi:
    wide: int
    high: int
    fps: float
    frames: list[bytes]


def _chunks(data: bytes, at: int, end: int):
    """Kind, start and length of the chunks of a part of a file, lists by their own kind."""
    while at + 8 <= end:
        kind, n = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if kind == b"LIST":
            yield data[at + 8 : at + 12], at + 12, n - 4
        else:
            yield kind, at + 8, n
        at += 8 + n + (n & 1)


def read_avi(data: bytes) -> Avi:
    """The first video stream of an AVI file: its size and rate by the headers, its frames by the index."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    parts = {kind: (at, n) for kind, at, n in _chunks(data, 12, len(data))}
    if not {b"hdrl", b"movi", b"idx1"} <= parts.keys():
        raise ValueError("no headers, frames or index")
    at, n = parts[b"hdrl"]
    streams = [(k, m) for kind, k, m in _chunks(data, at, at + n) if kind == b"strl"]
    for number, (at, n) in enumerate(streams):
        inner = {kind: k for kind, k, _ in _chunks(data, at, at + n)}
        if data[inner[b"strh"] : inner[b"strh"] + 4] == b"vids":
            break
    else:
        raise ValueError("no video stream")
    if data[inner[b"strh"] + 4 : inner[b"strh"] + 8] != b"MJPG" and data[inner[b"strf"] + 16 : inner[b"strf"] + 20] != b"MJPG":
        raise ValueError("not motion JPEG")
    scale, rate = struct.unpack_from("<II", data, inner[b"strh"] + 20)
    wide, high = struct.unpack_from("<ii", data, inner[b"strf"] + 4)
    movi, (at, n) = parts[b"movi"][0] - 4, parts[b"idx1"]
    ids = (b"%02ddc" % number, b"%02ddb" % number)
    found = [(kind, offset, size) for kind, _, offset, size in struct.iter_unpack("<4sIII", data[at : at + n - n % 16]) if kind in ids]
    # offsets count from the list of frames or from the file's start
    base = movi if not found or data[movi + found[0][1] : movi + found[0][1] + 4] == found[0][0] else 0
    return Avi(wide, abs(high), rate / max(scale, 1), [data[base + o + 8 : base + o + 8 + size] for _, o, size in found])


def histograms(samples: np.ndarray) -> np.ndarray:
    """(n, 16) counts of the samples' high four bits."""
    n = len(samples)
    slot = (samples >> 4).astype(np.int64) + np.arange(n)[:, None] * BINS
    return np.bincount(slot.ravel(), minlength=n * BINS).reshape(n, BINS)


def shot_starts(hist: np.ndarray, window: int = 8, factor: float = 3.0, least: int = FRAME // 8) -> list[int]:
    """First frames of the shots: frame 0, and each whose difference to the one before is at least `least` samples and
    over mean + factor x deviation of up to `window` differences before it, if there are any."""
    if len(hist) < 2:
        return [0] * len(hist)
    d = np.abs(np.diff(hist, axis=0)).sum(axis=1) // 2
    total = np.concatenate(([0], np.cumsum(d)))
    square = np.concatenate(([0], np.cumsum(d * d)))
    k = np.arange(len(d))
    low = np.maximum(0, k - window)
    n = np.maximum(1, k - low)
    mean = (total[k] - total[low]) / n
    spread = np.sqrt(np.maximum(0, (square[k] - square[low]) / n - mean * mean))
    return [0, *(1 + np.flatnonzero((d >= least) & (d > mean + factor * spread))).tolist()]


def payload_of(text: str) -> tuple[int, bytes]:
    raw = text.encode()
    return len(raw), raw + b"\xff" * (-len(raw) % FRAME if raw else FRAME)


def media_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """A row for each text: the stored file's and the read-back payload's digests, and the clips
    (clip, first_frame, end_frame, start_s, end_s); the AVI file itself on request."""

    def make():
        def run(batch: list[str]) -> dict[str, list]:
            out: dict[str, list] = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips", "media")}
            payloads = [payload_of(x) for x in batch]
            counts = [len(p) // FRAME for _, p in payloads]
            samples = np.frombuffer(b"".join(p for _, p in payloads), np.uint8).reshape(-1, FRAME)
            frames = [x for k in range(0, len(samples), BLOCK) for x in encode_frames(samples[k : k + BLOCK])]
            first, files = 0, []
            for n in counts:
                files.append(write_avi(frames[first : first + n]))
                first += n
            del samples, frames
            read = [read_avi(f) for f in files]
            stored = [x for r in read for x in r.frames]
            back = np.concatenate([decode_frames(stored[k : k + BLOCK]) for k in range(0, len(stored), BLOCK)])
            del stored
            hist, first = histograms(back), 0
            for (n_bytes, _), avi, f in zip(payloads, read, files, strict=True):
                n, fps = len(avi.frames), avi.fps
                whole = back[first : first + n].tobytes()
                starts = shot_starts(hist[first : first + n])
                first += n
                clips = [{"clip": i, "first_frame": a, "end_frame": b, "start_s": a / fps, "end_s": b / fps} for i, (a, b) in enumerate(zip(starts, [*starts[1:], n], strict=True))]
                cuts = zlib.crc32(",".join(map(str, starts)).encode())
                for k, v in (("n_bytes", n_bytes), ("payload_bytes", len(whole)), ("payload_sha256", hashlib.sha256(whole).hexdigest()), ("tail_crc32", zlib.crc32(whole[-32:])), ("media_bytes", len(f)), ("media_sha256", hashlib.sha256(f).hexdigest()), ("feature", f"frames={n};clips={len(starts)};starts={cuts:08x}"), ("clips", clips), ("media", f)):
                    out[k].append(v)
            return out

        return run

    kind = (
        "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
        "clips array<struct<clip: int, first_frame: int, end_frame: int, start_s: double, end_s: double>>" + ", media binary" * with_media
    )
    return map_texts(df, [id_col], text_col, kind, make, most=2 << 20)


def clip_rows(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row for each clip of media_rows(): id, clip, first_frame, end_frame, start_s, end_s."""
    return media.select(id_col, F.explode("clips").alias("clip")).select(id_col, "clip.*")


def op4_media(spark, sf_dir: str) -> DataFrame:
    """The digests, and the timed clips of each file as JSON."""
    rows = media_rows(table(spark, sf_dir, "documents"))
    return rows.withColumn("clips", F.to_json("clips"))
