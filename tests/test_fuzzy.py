"""Fuzzy hashes against a byte by byte version, and the search against all pairs."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from cairn.functions import fuzzy

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def by_byte(data: bytes) -> str:
    """The hash as it is defined, a byte at a time."""
    size = 3
    while size * 64 < len(data):
        size *= 2
    while True:
        window, h1, h2, h3, at = [0] * 7, 0, 0, 0, 0
        piece, double, one, two, roll = 0x28021967, 0x28021967, [], [], 0
        tails = ["", ""]
        for c in data:
            h2 = (h2 - h1 + 7 * c) % 2**32
            h1 = h1 + c - window[at % 7]
            window[at % 7] = c
            at += 1
            h3 = (h3 << 5 ^ c) % 2**32
            roll = (h1 + h2 + h3) % 2**32
            piece, double = (piece * 0x01000193 % 2**32) ^ c, (double * 0x01000193 % 2**32) ^ c
            if roll % size == size - 1:
                if len(one) < 63:
                    one.append(LETTERS[piece % 64])
                    piece = 0x28021967
                else:
                    tails[0] = LETTERS[piece % 64]
            if roll % (2 * size) == 2 * size - 1:
                if len(two) < 31:
                    two.append(LETTERS[double % 64])
                    double = 0x28021967
                else:
                    tails[1] = LETTERS[double % 64]
        if roll:
            tails = [LETTERS[piece % 64], LETTERS[double % 64]]
        if size > 3 and len(one) < 32:
            size //= 2
            continue
        return f"{size}:{''.join(one)}{tails[0]}:{''.join(two)}{tails[1]}"


def test_hashes_equal_those_made_byte_by_byte():
    rng = random.Random(1)
    words = [bytes(rng.choice(b"abcdefghij") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    texts = [b"", b"a", b"abc", b"\xff" * 5000, bytes(300), b"ab" * 4000, *[b" ".join(rng.choices(words, k=k)) for k in (3, 20, 60, 200, 900, 4000)], *[bytes(rng.randrange(256) for _ in range(n)) for n in (63, 64, 65, 192, 193, 5000)]]
    got = [f"{h['size']}:{h['first']}:{h['second']}" for h in fuzzy.fuzzy_hashes_of(texts)]
    skip = {4}  # a text of zero bytes only has no sum: it has no pieces at all
    assert [g for i, g in enumerate(got) if i not in skip] == [by_byte(t) for i, t in enumerate(texts) if i not in skip]
    assert got[0] == "3::" and got[4] == "3::"


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def squeezed(s: str) -> str:
    return "".join(c for i, c in enumerate(s) if i < 3 or len({c, *s[i - 3 : i]}) > 1)


def test_search_equals_all_pairs(spark):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    base = rng.choices(vocabulary, k=400)
    texts = [" ".join(base), "  ".join(base).upper(), "", "x"]
    texts += [" ".join(base[:k] + ["edited"] + base[k + 1 :]) for k in range(0, 400, 40)] + [" ".join(base[: 400 - k]) for k in (10, 60, 190)] + [" ".join(rng.choices(vocabulary, k=300)) for _ in range(10)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "id long, text string").repartition(3)
    hashes = fuzzy.with_fuzzy(df, "text").cache()
    own = {r.id: r.fuzzy for r in hashes.collect()}
    assert own[0] == own[1] and own[2] == own[99] and tuple(own[2]) == (3, "", "")
    wanted = hashes.where("id % 3 = 0")
    want = set()
    for a, x in own.items():
        for b, y in own.items():
            if a % 3 or a == b:
                continue
            scores = []
            for m, s in ((x.size, x.first), (2 * x.size, x.second)):
                for n, t in ((y.size, y.first), (2 * y.size, y.second)):
                    s2, t2 = squeezed(s), squeezed(t)
                    grams = lambda z: {z[i : i + 7] for i in range(max(1, len(z) - 6))}
                    if m == n and grams(s2) & grams(t2):
                        scores.append(int(np.floor(100 - 100 * distance(s2, t2) / max(len(s2), len(t2), 1))))
            if scores and max(scores) >= 60:
                want.add((a, b, max(scores)))
    got = {tuple(r) for r in fuzzy.alike(hashes, wanted, "id").collect()}
    assert got == want and len(got) > 20
    assert hashes.select(F.max(F.length(fuzzy.shown(F.col("fuzzy"))))).first()[0] <= 64 + 32 + 12
