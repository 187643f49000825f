"""GIF images as columns: writing and reading GIF89a byte streams, and frames with colour histograms.

The reader follows the format's rules: LZW code streams with clear codes and a
table that may stay full, global and local palettes, interlacing, frame delays,
transparency and the four disposal methods. The writer stores bytes losslessly
as palette indices of one or more frames.

Null texts count as empty; their payload is 64 zero bytes. Equal texts give
equal values in every column but the id; repeated rows give repeated results; an
empty table gives an empty one; other columns are ignored. Payloads of any
length are spread over as many frames as they need.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, table

#: Payload layout: bytes a row, rows a frame, and the delay of a frame in hundredths of a second.
WIDTH = 64
FRAME_ROWS = 1024
DELAY = 10
#: Bins of the histogram, for each of red, green and blue.
BINS = 16

SCHEMA = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
FRAMES_SCHEMA = "doc_id bigint, frame int, start_ms bigint, delay_ms bigint, width int, height int, disposal int, histogram array<bigint>"


def widths(count: int, size: int) -> np.ndarray:
    """Bits of the first `count` codes after a clear code, as both sides of the stream know them."""
    return schedule(size)[:count]


@lru_cache(maxsize=16)
def schedule(size: int) -> np.ndarray:
    entries = (1 << size) + 1 + np.arange(8192)  # entries in the table when the code is read
    return np.minimum(np.frexp(entries.astype(np.float64))[1], 12).clip(size + 1)


def lzw_encode(data: bytes, size: int = 8) -> bytes:
    """LZW codes of a byte string, packed from the low bit up."""
    clear, end = 1 << size, (1 << size) + 1
    runs: list[list[int]] = []
    # Codes are held shifted by eight bits, so that code and byte make a key with one operation.
    codes, known, following = [], {}, end + 1 << 8
    find, add = known.get, codes.append
    current = data[0] << 8 if data else None
    for byte in data[1:]:
        key = current | byte
        code = find(key)
        if code is None:
            add(current)
            known[key] = following
            following += 256
            current = byte << 8
            if following == 4096 << 8:  # start over while the widest code is still twelve bits
                runs.append(codes)
                codes, following = [], end + 1 << 8
                add = codes.append
                known.clear()
        else:
            current = code
    if current is not None:
        codes.append(current)
    runs.append(codes)
    runs = [(np.array(run, np.int64) >> 8).tolist() for run in runs]
    values, bits = [], []
    for n, run in enumerate(runs):
        last = [end] if n == len(runs) - 1 else [clear]
        run = ([clear] if not n else []) + run + last
        w = widths(len(run) - (not n), size)
        values.append(np.array(run, np.uint16))
        bits.append(np.concatenate(([size + 1], w)) if not n else w)
    value, bit = np.concatenate(values), np.concatenate(bits)
    places = np.arange(12, dtype=np.uint16)
    out = []
    for at in range(0, len(value), 1 << 16):  # a multiple of eight codes each, so that bytes need not meet
        v, b = value[at : at + (1 << 16), None], bit[at : at + (1 << 16), None]
        out.append((((v >> places) & 1).astype(np.uint8))[places < b])
    return np.packbits(np.concatenate(out), bitorder="little").tobytes()


def lzw_decode(stream: bytes, size: int = 8, most: int | None = None) -> bytes:
    """The bytes of a packed LZW code stream; stops at the end code, or after `most` bytes."""
    clear, end = 1 << size, (1 << size) + 1
    raw = np.frombuffer(stream + bytes(4), np.uint8).astype(np.uint32)
    singles = [bytes((i,)) for i in range(clear)] + [b"", b""]
    total, at, out, made = len(stream) * 8, 0, [], 0
    first = True
    while at < total:
        # Codes up to the next clear or end code; the width after a clear code depends on their number alone.
        codes: list[int] = []
        stop = None
        while stop is None and at < total:
            w = np.array([size + 1]) if first else (widths(4096, size) if not codes else np.full(4096, 12))
            ends = at + np.cumsum(w)
            w, ends = w[ends <= total], ends[ends <= total]
            if not len(w):
                at = total
                break
            begins = ends - w
            byte = begins >> 3
            word = raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16
            got = (word >> (begins & 7).astype(np.uint32)) & ((1 << w) - 1).astype(np.uint32)
            halt = np.flatnonzero((got == clear) | (got == end))
            n = int(halt[0]) if len(halt) else len(got)
            codes += got[:n].tolist()
            at = int(ends[n]) if len(halt) else int(ends[-1])
            if len(halt):
                stop = int(got[n])
            first = False
        if codes:
            entries, known = singles.copy(), len(singles)
            previous = entries[codes[0]]
            out.append(previous)
            for code in codes[1 : 4097 - known]:
                if code < known:
                    entry = entries[code]
                    entries.append(previous + entry[:1])
                else:
                    entry = previous + previous[:1]
                    entries.append(entry)
                known += 1
                out.append(entry)
                previous = entry
            out += [entries[code] for code in codes[4097 - len(singles) :]]  # the table is full
            made += sum(map(len, out[-len(codes) :])) if most is not None else 0
        if stop == end or most is not None and made >= most:
            break
    return b"".join(out)


def gray_palette() -> bytes:
    return bytes(i for i in range(256) for _ in range(3))


def encode_payload(payload: bytes) -> bytes:
    """A GIF whose frames' palette indices are the payload's bytes, row by row; its length must be a multiple of WIDTH."""
    rows = len(payload) // WIDTH
    out = [b"GIF89a", WIDTH.to_bytes(2, "little"), min(rows, FRAME_ROWS).to_bytes(2, "little"), b"\xf7\x00\x00", gray_palette()]
    for top in range(0, rows, FRAME_ROWS):
        part = payload[top * WIDTH : (top + FRAME_ROWS) * WIDTH]
        out += [b"\x21\xf9\x04\x04", DELAY.to_bytes(2, "little"), b"\x00\x00", b"\x2c\x00\x00\x00\x00", WIDTH.to_bytes(2, "little"), (len(part) // WIDTH).to_bytes(2, "little"), b"\x00\x08"]
        code = lzw_encode(part)
        for at in range(0, len(code), 255):
            out += [bytes((min(255, len(code) - at),)), code[at : at + 255]]
        out.append(b"\x00")
    return b"".join([*out, b"\x3b"])


@dataclass
class Frame:
    """One image of a stream: its own indices, and the canvas after it was drawn (red, green, blue, alpha)."""

    indices: bytes
    left: int
    top: int
    width: int
    height: int
    delay_ms: int
    disposal: int
    transparent: int | None
    palette: np.ndarray
    canvas: np.ndarray | None


def blocks(data: bytes, at: int) -> tuple[bytes, int]:
    """The joined sub-blocks at a place, and the place after them."""
    out = []
    while n := data[at]:
        out.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(out), at + 1


def read_frames(data: bytes, draw: bool = True) -> Iterator[Frame]:
    """The frames of a GIF, in order. `draw`: also compose the canvas by transparency and disposal."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF stream")
    wide, high, flags = int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little"), data[10]
    at, shared = 13, np.zeros((0, 3), np.uint8)
    if flags & 0x80:
        n = 2 << (flags & 7)
        shared, at = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n
    canvas = np.zeros((high, wide, 4), np.uint8) if draw else None
    delay, disposal, transparent = 0, 0, None
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            body, at = blocks(data, at + 2)
            if label == 0xF9:
                delay, disposal, transparent = 10 * int.from_bytes(body[1:3], "little"), body[0] >> 2 & 7, body[3] if body[0] & 1 else None
            continue
        if data[at] != 0x2C:
            raise ValueError("broken GIF stream")
        left, top, w, h = (int.from_bytes(data[at + 1 + 2 * i : at + 3 + 2 * i], "little") for i in range(4))
        local, at, palette = data[at + 9], at + 10, shared
        if local & 0x80:
            n = 2 << (local & 7)
            palette, at = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n
        size = data[at]
        stream, at = blocks(data, at + 1)
        indices = lzw_decode(stream, size, w * h)[: w * h].ljust(w * h, b"\0")
        if local & 0x40:  # interlaced: rows come in four passes
            order = np.concatenate([np.arange(s, h, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])
            rows = np.empty((h, w), np.uint8)
            rows[order] = np.frombuffer(indices, np.uint8).reshape(h, w)
            indices = rows.tobytes()
        shown = None
        if draw:
            before = canvas.copy() if disposal == 3 else None
            pixels = np.frombuffer(indices, np.uint8).reshape(h, w)[: max(0, high - top), : max(0, wide - left)]
            area = canvas[top : top + pixels.shape[0], left : left + pixels.shape[1]]
            seen = pixels != transparent if transparent is not None else np.ones(pixels.shape, bool)
            colours = np.zeros((256, 3), np.uint8)
            colours[: len(palette)] = palette
            area[seen, :3], area[seen, 3] = colours[pixels[seen]], 255
            shown = canvas.copy()
            if disposal == 2:
                area[:] = 0
            elif disposal == 3:
                canvas = before
        yield Frame(indices, left, top, w, h, delay, disposal, transparent, palette, shown)
        delay, disposal, transparent = 0, 0, None


def histogram(frame: Frame) -> list[int]:
    """Counts of visible pixels by BINS ranges of red, then green, then blue."""
    pixels = frame.canvas.reshape(-1, 4)
    pixels = pixels[pixels[:, 3] > 0]
    fine = [np.bincount(pixels[:, i], minlength=256) for i in range(3)]
    return np.concatenate([f.reshape(BINS, -1).sum(1) for f in fine]).tolist()


def frames(df: DataFrame, doc_id: str, media: str) -> DataFrame:
    """One row for each frame of each GIF in a binary column: timing, size, disposal and colour histogram. Null media give no row."""

    def kernel(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("doc_id", "frame", "start_ms", "delay_ms", "width", "height", "disposal", "histogram")}
        for i, data in zip(rows["doc_id"], rows["media"], strict=True):
            start = 0
            for n, f in enumerate(read_frames(data) if data else ()):
                for k, v in zip(out, (i, n, start, f.delay_ms, f.width, f.height, f.disposal, histogram(f)), strict=True):
                    out[k].append(v)
                start += f.delay_ms
        return out

    return map_rows(df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(media).alias("media")), kernel, FRAMES_SCHEMA)


def store(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The texts as GIF columns: id and `media`."""

    def kernel(rows: dict[str, list]) -> dict[str, list]:
        return {"doc_id": rows["doc_id"], "media": [encode_payload(padded((t or "").encode())) for t in rows["text"]]}

    return map_rows(df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")), kernel, "doc_id bigint, media binary")


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % 64 or 64 * (not data))


def digest(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Store every text as a GIF, read it back, and return sizes, digests and a histogram feature."""

    def kernel(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for i, t in zip(rows["doc_id"], rows["text"], strict=True):
            data = (t or "").encode()
            media = encode_payload(padded(data))
            count, back, shown = 0, [], np.zeros(3 * BINS, np.int64)
            for f in read_frames(media):
                count += 1
                back.append(f.indices)
                shown += np.array(histogram(f))
            payload = b"".join(back)
            feature = f"frames={count};ms={count * 10 * DELAY};gray={','.join(map(str, shown[:BINS]))}"
            for k, v in zip(out, (i, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature), strict=True):
                out[k].append(v)
        return out

    return map_rows(df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")), kernel, SCHEMA)


def op2_gif(spark, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
