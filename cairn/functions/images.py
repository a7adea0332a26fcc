"""What images are: kind, size and a perceptual hash. Arrow batches go through one small function an image.

Width and height are read from the headers of PNG, GIF and JPEG files. PNG pixels
are decoded too, up to a limit; their brightness is averaged over a grid of 32 by
32, and the signs of its lowest frequencies around their median make 64 bits,
which brightness, size and small edits hardly change.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Grid of brightness, frequencies that are kept in either direction, pixels and packed bytes that are decoded at most.
GRID, KEPT, MOST_PIXELS, MOST_BYTES = 32, 8, 16 << 20, 32 << 20
FACTS = "struct<kind:string,width:int,height:int,hash:long>"
#: Markers of JPEG segments that hold the size (SOF0 to SOF15 without the tables DHT, JPG and DAC), and those without a length. Fixed values.
SIZED = {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}
BARE = {0x01, *range(0xD0, 0xD8)}
#: Samples of a pixel by PNG colour type. Fixed values.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def jpeg_size(data: bytes) -> tuple[int, int] | None:
    at = 2
    while at + 9 <= len(data):
        if data[at] != 0xFF:
            return None
        marker = data[at + 1]
        if marker == 0xFF:  # padding
            at += 1
        elif marker in BARE:
            at += 2
        elif marker in SIZED:
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        else:
            at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


def size_of(data: bytes) -> tuple[str, int, int] | None:
    """(kind, width, height), or None for what isn't one of the three kinds or breaks off before its size."""
    if data.startswith(b"\x89PNG\r\n\x1a\n") and data[12:16] == b"IHDR" and len(data) >= 24:
        return "png", *struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return "gif", *struct.unpack("<HH", data[6:10])
    if data.startswith(b"\xff\xd8") and (found := jpeg_size(data)):
        return "jpeg", *found
    return None


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 8
    while at + 8 <= len(data):
        n = struct.unpack(">I", data[at : at + 4])[0]
        yield data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        at += 12 + n


def _unfiltered(lines: np.ndarray, kinds: np.ndarray, step: int) -> np.ndarray:
    """Lines of bytes with PNG's prediction undone; step: bytes of a pixel."""
    out = np.zeros_like(lines)
    above = np.zeros(lines.shape[1], np.uint8)
    for y, kind in enumerate(kinds.tolist()):
        line = lines[y]
        if kind == 0:
            now = line.copy()
        elif kind == 1:
            now = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            now = line + above
        elif kind in (3, 4):
            now = np.zeros_like(line)
            left, corner = np.zeros(step, np.int32), np.zeros(step, np.int32)
            for x in range(0, len(line), step):
                up = above[x : x + step].astype(np.int32)
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    far = np.abs(np.stack([up - corner, left - corner, left + up - 2 * corner]))
                    guess = np.choose(far.argmin(0), [left, up, corner])
                left, corner = (line[x : x + step] + guess) & 255, up
                now[x : x + step] = left
        else:
            raise ValueError("no such filter")
        out[y] = above = now
    return out


def brightness(data: bytes, width: int, height: int) -> np.ndarray | None:
    """Rows of brightness of a PNG of 8 bits a sample that isn't interlaced; None for other PNGs."""
    head, packed, palette = b"", [], b""
    for kind, content in _chunks(data):
        if kind == b"IHDR":
            head = content
        elif kind == b"PLTE":
            palette = content
        elif kind == b"IDAT":
            packed.append(content)
    depth, colour, _, _, interlaced = head[8:13]
    if depth != 8 or interlaced or colour not in SAMPLES or width * height > MOST_PIXELS or not width or not height:
        return None
    n = SAMPLES[colour]
    size = height * (1 + width * n)
    raw = np.frombuffer(zlib.decompressobj().decompress(b"".join(packed), size), np.uint8)
    if len(raw) < size:
        return None
    raw = raw.reshape(height, 1 + width * n)
    pixels = _unfiltered(raw[:, 1:], raw[:, 0], n).reshape(height, width, n).astype(np.float64)
    if colour == 3:
        table = np.frombuffer(palette, np.uint8).reshape(-1, 3).astype(np.float64)
        pixels = table[np.minimum(pixels[:, :, 0].astype(int), len(table) - 1)]
    return pixels[:, :, :3] @ np.array([0.299, 0.587, 0.114]) if pixels.shape[2] >= 3 else pixels[:, :, 0]


def _averaged(values: np.ndarray, n: int) -> np.ndarray:
    """n averages along the first axis, each over its share, or the nearest values where there are fewer than n."""
    if len(values) < n:
        return values[np.arange(n) * len(values) // n]
    edges = np.arange(n + 1) * len(values) // n
    return np.add.reduceat(values, edges[:-1], axis=0) / np.diff(edges)[:, None]


_K = np.arange(GRID)
_COSINES = np.cos(np.pi * (2 * _K[None, :] + 1) * _K[:, None] / (2 * GRID))


def perceptual_hash(grey: np.ndarray) -> int:
    grid = _averaged(_averaged(grey, GRID).T, GRID).T
    low = (_COSINES @ grid @ _COSINES.T)[:KEPT, :KEPT].ravel()
    low[0] = 0.0  # the mean brightness
    bits = low > np.median(low)
    return int(np.packbits(bits).view(">i8")[0])


def facts(data: bytes | None) -> dict:
    found = size_of(data or b"")
    if found is None:
        return {"kind": None, "width": None, "height": None, "hash": None}
    kind, width, height = found
    try:
        grey = brightness(data, width, height) if kind == "png" and len(data) <= MOST_BYTES else None
    except (ValueError, IndexError, zlib.error):  # broken pixels
        grey = None
    return {"kind": kind, "width": width if width < 2**31 else None, "height": height if height < 2**31 else None, "hash": None if grey is None else perceptual_hash(grey)}


def image_facts(column: Column | str) -> Column:
    """struct(kind, width, height, hash) of a column of bytes; null parts where they can't be told."""

    @F.pandas_udf(FACTS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for bodies in batches:
            out = pd.DataFrame([facts(b) for b in bodies], columns=["kind", "width", "height", "hash"])
            yield out.astype({"width": "Int32", "height": "Int32", "hash": "Int64"})

    return run(column)


def hash_bands(value: Column, bands: int = 4) -> Column:
    """The bits of a hash in as many bands (band, value); images that differ in fewer bits than there are bands share one."""
    wide = 64 // bands
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.struct(k.alias("band"), F.substring(F.lpad(F.bin(value), 64, "0"), k * wide + 1, F.lit(wide)).alias("value")))


def png(grey: np.ndarray) -> bytes:
    """A grey PNG of 8 bits from rows of brightness."""
    lines = b"".join(b"\0" + row.tobytes() for row in grey.astype(np.uint8))
    part = lambda kind, content: struct.pack(">I", len(content)) + kind + content + struct.pack(">I", zlib.crc32(kind + content))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", grey.shape[1], grey.shape[0], 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")
