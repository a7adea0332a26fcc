"""Filter audit, whitening and SimHash against brute force, on hard rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
from decimal import Decimal
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from cairn.llm import filter_audit, simhash_mih, toxicity, whitening
from cairn.llm.common import chunks, remainder

WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def filler(rng: random.Random, n: int) -> str:
    syllables = "ka lo mi tu se ran vo pel dus nir é ü".split()
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


# ---- 11: audit -------------------------------------------------------------------


def fails(doc_id, text, rows) -> set[str]:
    w = WORD.findall(text)
    found = set()
    if len(w) < 200:
        found.add("A")
    if 100 * len(set(w)) < 50 * len(w):
        found.add("B")
    if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text):
        found.add("C")
    if re.search(r"[#$%&*|]", text):
        found.add("D")
    if doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, *_ in rows):
        found.add("E")
    return found


def audit_by_hand(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out = {}
    for part in {s or "" for _, _, s in rows}:
        own = [(i, fails(i, t or "", rows)) for i, t, s in rows if (s or "") == part]
        removed_in_all = dict.fromkeys("ABCDE", 0)
        lines = []
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone, left = [x for x in left if f in x[1]], [x for x in left if f not in x[1]]
                removed_in_all[f] += len(gone)
                lines.append((("".join(order), k + 1), f, [len(left), len(gone), sum(f in x[1] for x in own) - len(gone), sum(x[1] == {f} for x in own), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone)]))
        out.update({(part, *key): (*values, removed_in_all[f]) for key, f, values in lines})
    return out


def test_audit_equals_every_order_run_by_hand(spark):
    rng = random.Random(2)
    plain, loud = filler(rng, 260), filler(rng, 220).upper()
    texts = [None, "", " \n", plain, plain, plain.replace(" ", "\t"), loud, loud, plain + " 100%", "a " * 300, "A B " * 150 + "#", filler(rng, 199), filler(rng, 200), "é" * 60_000, "x$" + filler(rng, 230), plain, ""]
    rows = [(None if i in (4, 9) else i, t, None if i % 5 == 0 else "" if i % 5 == 1 else f"s{i % 3}") for i, t in enumerate(texts)]
    rows += [rows[3], rows[7], (3, plain, "s1")]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(17)] + [(3, 0, 1), (None, 1, 1), (5, None, None), (99, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, source string, mask int, digest int, part int").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in filter_audit.audit(docs, lab).collect()}
    assert got == audit_by_hand(rows, labels)


def test_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert filter_audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_zeta_counts_those_that_pass_a_set():
    counts = np.random.default_rng(1).integers(0, 9, (3, 32))
    want = [[sum(row[m] for m in range(32) if m & s == 0) for s in range(32)] for row in counts.tolist()]
    assert filter_audit.survivors(counts).tolist() == want


# ---- 12: whitening ---------------------------------------------------------------


def vectors_by_hand(rows, d):
    return [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v is not None and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_whitening_equals_an_eigendecomposition(spark, kind):
    rng = np.random.default_rng(4)
    d = 40
    base = (rng.normal(size=(700, d)) @ rng.normal(size=(d, d)) * np.linspace(3, 0.2, d)).astype(np.float32).astype(float).tolist()
    rows = [(i if i != 9 else None, v) for i, v in enumerate(base)] + [(5, base[5]), (5, base[5])]
    bad = [(800, None), (801, [None] + base[0][1:]), (802, [float("nan")] + base[0][1:]), (803, [float("inf")] + base[0][1:]), (804, []), (805, base[0][:7])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows + bad], f"vec_id long, embedding array<{kind}>, n int, label int").repartition(23)
    got = whitening.whitened(df).collect()
    own = vectors_by_hand(rows + bad, d)
    x = np.array([v for _, v in own], dtype=object)
    n, s = len(x), x.sum(0)
    centred = ((n * x - s) / n).astype(float)
    values, right = np.linalg.eigh(centred.T @ centred / n)
    values, right = values[::-1][:32], right[:, ::-1][:, :32]
    want = {}
    for (i, _), row, y in zip(own, n * x - s, centred, strict=True):
        want.setdefault(i, []).append((int((row * row).sum()), y @ right / np.sqrt(values)))
    assert len(got) == 32 * n and {r.n for r in got} == {n} and {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9
    signs = {}
    for r in got:
        k = r.component - 1
        options = want[r.vec_id]
        assert r.deviation == options[0][0]
        assert abs(r.explained - values[k] / (centred**2).sum() * n) < 1e-9
        z = options[0][1][k]
        assert abs(abs(r.whitened) - abs(z)) < 1e-6
        if abs(z) > 1e-3:
            assert signs.setdefault(k, np.sign(r.whitened * z)) == np.sign(r.whitened * z)


def test_whitening_of_few_and_dependent_vectors(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert whitening.whitened(make([])).count() == 0
    assert whitening.whitened(make([(1, None), (2, []), (3, [float("nan")])])).count() == 0
    one = whitening.whitened(make([(1, [0.5, 0.25])])).collect()
    assert [(r.component, r.deviation, r.whitened, r.explained) for r in sorted(one, key=lambda r: r.component)] == [(1, 0, None, 0.0), (2, 0, None, 0.0)]
    # the second dimension follows the first, the third is constant: one component is known
    rows = make([(i, [float(i), 2.0 * i, 7.0]) for i in range(50)]).repartition(5)
    got = whitening.whitened(rows).collect()
    known = [r.whitened for r in got if r.component == 1]
    assert abs(np.var(known) - 1) < 1e-9 and {r.whitened for r in got if r.component > 1} == {None} and got[0].identity_error < 1e-9


def test_whitening_is_exact_where_longs_end(spark):
    big = 2.0**40
    df = spark.createDataFrame([(1, [big, 0.0]), (2, [-big, 0.5]), (3, [0.0, 0.0]), (4, [1e30, 0.0])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in whitening.whitened(df).collect() if r.component == 1}
    assert set(got) == {1, 2, 3} and got[1].deviation is None
    assert got[3].deviation == 32**2 and all(r.n == 3 for r in got.values())
    x = np.array([[2**62 - 5, -(2**61)], [2**62 - 9, 3], [-7, 2**40]])
    assert whitening.exact_sums(x) == [sum(int(v) for v in c) for c in x.T]
    assert Decimal(whitening.exact_sums(x)[0]) == 2**63 - 21


# ---- 13: SimHash -----------------------------------------------------------------


def fingerprint_by_hand(text) -> int:
    w = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def components_by_hand(prints: dict[int, int]) -> dict[int, int]:
    """The smallest key that each key reaches over values that differ in two bits at most."""
    comp = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for i in prints:
            for j in prints:
                if (prints[i] ^ prints[j]).bit_count() <= 2 and comp[i] != comp[j]:
                    comp[i] = comp[j] = min(comp[i], comp[j])
                    changed = True
    return comp


def test_simhash_equals_brute_force(spark):
    rng = random.Random(6)
    base = filler(rng, 400).split()
    near = [" ".join(base[:k] + ["edit"] + base[k + 1 :]) for k in range(0, 400, 9)]
    texts = [None, "", "\n \t", "one", "One  Word", "one word", " ".join(base), " ".join(base).upper(), "\n".join(base), *near, filler(rng, 5000), "x" * 50_000, "a " * 3000, "é 漢字 😀", *[filler(rng, 30) for _ in range(40)]]
    rows = [(None if i == 2 else 500 - i, t, 1, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int, comp string").repartition(3)
    got = {r.doc_id: r for r in simhash_mih.grouped(docs).collect()}
    prints = {i: fingerprint_by_hand(t) for i, t, *_ in rows}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert got[None].component_id is None
    comp = components_by_hand({i: p for i, p in prints.items() if i is not None})
    assert {i: r.component_id for i, r in got.items() if i is not None} == comp
    assert len(set(comp.values())) < len(comp) - 10
    assert simhash_mih.grouped(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_links_of_crowded_slots_are_whole(spark):
    rng = random.Random(8)
    mask = (1 << 64) - 1
    seeds = [rng.getrandbits(64) for _ in range(12)]
    some = set(seeds)
    for s in seeds[:3]:  # crowds: up to five bits from the seed, in the first half, the second half and both
        for _ in range(150):
            x = s
            for b in rng.sample(range(32, 64) if s == seeds[0] else range(32) if s == seeds[1] else range(64), rng.randint(1, 5)):
                x ^= 1 << b
            some.add(x & mask)
    for s in seeds[3:]:  # chains of two steps, and one of three bits that isn't linked
        some |= {s ^ 1, s ^ 1 ^ 1 << 40, s ^ 7 << 20, s ^ 1 << 63}
    signed = [x - (1 << 64) if x >> 63 else x for x in sorted(some)]
    prints = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(4)
    found = [(r.a, r.b) for r in simhash_mih.links(prints).collect()]
    assert all(((a ^ b) & mask).bit_count() <= 2 and a != b for a, b in found)
    want = components_by_hand({x: x & mask for x in signed})
    comp = {x: x for x in signed}
    while True:
        before = dict(comp)
        for a, b in found:
            comp[a] = comp[b] = min(comp[a], comp[b])
        if before == comp:
            break
    assert comp == want


# ---- 6: length -------------------------------------------------------------------


def test_toxicity_does_not_grow_with_length(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(500):
        words = filler(rng, rng.randint(30, 200)).split()
        if i % 3 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(["grumblefax", "grumblefaxed", "ngrumblefax"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 3 == 0)))
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), remainder(F.col("doc_id"), 3) != 1)
    score = lambda texts: np.concatenate([model.score(b, o) for _, _, b, o in chunks(pa.array(texts))])
    clean = {n: [filler(rng, n) for _ in range(k)] for n, k in ((100, 200), (2000, 20), (150_000, 2))}
    assert all((score(texts) >= toxicity.THRESHOLD).mean() <= 0.02 for texts in clean.values())
    assert (score([clean[150_000][0] + " grumblefax grumblefaxes agrumblefax", "ungrumblefax " + clean[2000][0]]) >= toxicity.THRESHOLD).all()


def test_hash_of_shingles_is_the_one_named():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442") and xxhash.xxh64_intdigest(b"", 42) == 0x98B1582B0977E704
