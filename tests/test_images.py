"""Sizes and hashes of images made here."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from cairn.functions import images as I


def filtered_png(pixels: np.ndarray, colour: int, kinds: list[int], palette: bytes = b"") -> bytes:
    """A PNG whose lines are predicted in given ways, as the standard says."""
    height, width, n = pixels.shape
    lines, above = [], np.zeros(width * n, int)
    for y in range(height):
        line = pixels[y].ravel().astype(int)
        left, corner = np.concatenate([np.zeros(n, int), line[:-n]]), np.concatenate([np.zeros(n, int), above[:-n]])
        p = left + above - corner
        paeth = [a if abs(q - a) <= abs(q - b) and abs(q - a) <= abs(q - c) else b if abs(q - b) <= abs(q - c) else c for q, a, b, c in zip(p, left, above, corner, strict=True)]
        guess = [0 * line, left, above, (left + above) // 2, np.array(paeth)][kinds[y % len(kinds)]]
        lines.append(bytes([kinds[y % len(kinds)]]) + ((line - guess) % 256).astype(np.uint8).tobytes())
        above = line
    part = lambda kind, content: struct.pack(">I", len(content)) + kind + content + b"\0\0\0\0"
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + part(b"PLTE", palette) * bool(palette) + part(b"IDAT", zlib.compress(b"".join(lines))) + part(b"IEND", b"")


def test_pixels_come_back_whatever_the_prediction():
    rng = np.random.default_rng(1)
    for colour, n in ((0, 1), (2, 3), (4, 2), (6, 4)):
        pixels = rng.integers(0, 256, (11, 9, n))
        want = pixels[:, :, :3] @ np.array([0.299, 0.587, 0.114]) if n >= 3 else pixels[:, :, 0]
        for kinds in ([0], [1], [2], [3], [4], [4, 0, 3, 1, 2]):
            assert np.allclose(I.brightness(filtered_png(pixels, colour, kinds), 9, 11), want)
    palette = bytes(range(30))
    index = rng.integers(0, 10, (5, 6, 1))
    table = np.frombuffer(palette, np.uint8).reshape(-1, 3)
    assert np.allclose(I.brightness(filtered_png(index, 3, [1], palette), 6, 5), table[index[:, :, 0]] @ np.array([0.299, 0.587, 0.114]))


def test_sizes():
    jpeg = b"\xff\xd8" + b"\xff\xe0\x00\x10" + bytes(14) + b"\xff\xff\xdb\x00\x04ab" + b"\xff\xc2\x00\x11\x08" + struct.pack(">HH", 480, 640) + bytes(10)
    assert I.size_of(jpeg) == ("jpeg", 640, 480) and I.size_of(jpeg[:20]) is None and I.size_of(b"\xff\xd8\x00") is None
    assert I.size_of(b"GIF89a" + struct.pack("<HH", 3, 70) + b"..") == ("gif", 3, 70) and I.size_of(b"GIF89a") is None and I.size_of(b"") is None
    assert I.size_of(I.png(np.zeros((5, 7)))) == ("png", 7, 5)


def test_hashes_and_columns(spark):
    rng = np.random.default_rng(2)
    y, x = np.mgrid[0:120, 0:160]
    scene = 90 + 60 * np.sin(x / 17) * np.cos(y / 23) + 30 * np.sin((x + y) / 40)
    near = [I.png(scene), I.png(scene + 15), I.png(scene[::2, ::2]), I.png(np.clip(scene + rng.normal(0, 3, scene.shape), 0, 255))]
    other = [I.png(rng.integers(0, 256, (64, 64))) for _ in range(5)]
    hashes = [I.facts(b)["hash"] for b in near + other]
    far = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    assert max(far(hashes[0], h) for h in hashes[1:4]) <= 6 and min(far(hashes[0], h) for h in hashes[4:]) > 15
    rows = spark.createDataFrame([(0, near[0]), (1, near[0][:60]), (2, None), (3, b"x"), (4, near[1])], "i int, body binary")
    got = rows.select("i", I.image_facts("body").alias("f")).select("i", "f.*", I.hash_bands(F.col("f.hash")).alias("b")).orderBy("i").collect()
    assert [(r.kind, r.width, r.height) for r in got] == [("png", 160, 120), ("png", 160, 120), (None, None, None), (None, None, None), ("png", 160, 120)]
    assert got[0].hash == hashes[0] and got[1].hash is None and "".join(x.value for x in got[0].b) == f"{hashes[0] & (2**64 - 1):064b}"
