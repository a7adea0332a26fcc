"""The ten operators against brute force on small tables with hard rows."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairn.llm import chat, exact_lsm, line_cuckoo, lm_bloom, minhash_bayes, mixing, quality_mil, quality_rules, sentencepiece_trie, toxicity
from cairn.llm.common import chunks, remainder, shared_dir, word_hashes, word_spans

WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, keep string, n long"


def filler(rng: random.Random, n: int) -> str:
    syllables = "ka lo mi tu se ran vo pel dus nir é ü".split()
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


def hard_texts() -> list[str | None]:
    rng = random.Random(3)
    base = filler(rng, 120)
    words = base.split()
    near = [" ".join(words[:k] + ["edit"] + words[k + 1 :]) for k in (5, 50, 110)]
    far = " ".join(words[:60] + filler(rng, 60).split())
    lines = "shared line\n" + filler(rng, 30)
    return [None, "", " ", "\n\n\t", "one", "two  words", "A b C", base, base, base.upper(), *near, far, base.replace(" ", "  \n"), filler(rng, 5000), "x" * 50_000, "a " * 3000, *[f" Shared LINE\t\n{filler(rng, 25)}" for _ in range(12)], lines, lines, "é 漢字 😀 ▁mark"]


def rows_of(texts):
    return [(i if i != 3 else None, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 3}", 1, 0.5, "x", 2) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(hard_texts()), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def held(rows) -> dict:
    return {r["doc_id"]: r.asDict() for r in rows}


# ---- text kernels ------------------------------------------------------------


def test_words_and_hashes():
    texts = hard_texts()
    for limit in (1, 100, 1 << 20):
        seen: dict[str, int] = {}
        for lo, hi, buf, offs in chunks(pa.array(texts), limit):
            starts, ends, first = word_spans(buf, offs)
            h = word_hashes(buf, starts, ends)
            for d in range(hi - lo):
                found = [bytes(buf[s:e]).decode() for s, e in zip(starts[first[d] : first[d + 1]], ends[first[d] : first[d + 1]], strict=True)]
                assert found == WORD.findall(texts[lo + d] or "")
                for w, x in zip(found, h[first[d] : first[d + 1]].tolist(), strict=True):
                    assert seen.setdefault(w.translate(LOWER), x) == x
        assert len(set(seen.values())) == len(seen)


# ---- 1 and 6: classifiers ------------------------------------------------------


def labelled(spark, n: int = 240):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        bad, rude = i % 4 == 0, i % 3 == 0
        words = filler(rng, rng.randint(30, 200)).split()
        if bad:
            words = [w + rng.choice(["***", "$$$", "###"]) for w in words]
        if rude:
            words.insert(rng.randrange(len(words)), rng.choice(["grumblefax", "grumblefaxed", "ngrumblefax"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad), int(rude)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (9999, 1, 0), (None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")


def test_quality_learns_and_scores_hard_rows(spark, docs, empty):
    train, labels = labelled(spark)
    model = quality_mil.fit(train, labels, remainder(F.col("doc_id"), 5) != 0)
    got = held(quality_mil.scored(train, model).collect())
    out = [(r["score"] >= 0.3) == (i % 4 != 0) for i, r in got.items() if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(out) / len(out) > 0.95
    hard = quality_mil.scored(docs.drop("score"), model).collect()
    assert len(hard) == docs.count() and all(0 <= r.score <= 1 for r in hard)
    assert quality_mil.scored(empty.drop("score"), model).count() == 0
    assert quality_mil.fit(empty, labels, F.lit(True)) is None
    assert {r.score for r in quality_mil.scored(train, None).collect()} == {0.5}


def test_attention_gradient():
    rng = np.random.default_rng(0)
    x, edges, y = rng.normal(size=(12, 6)), np.array([0, 3, 4, 12]), np.array([1.0, 0, 1])
    one = quality_mil.train(x, edges, y, epochs=0)
    two = quality_mil.train(x, edges, y, epochs=60)
    loss = lambda m: -np.mean(y * np.log(m.bags(x, edges)["p"]) + (1 - y) * np.log(1 - m.bags(x, edges)["p"]))
    assert loss(two) < loss(one) / 3


def test_toxicity_finds_unseen_misspellings(spark, docs, empty):
    train, labels = labelled(spark, 600)
    model = toxicity.fit(train, labels, remainder(F.col("doc_id"), 3) != 1)
    got = held(toxicity.scored(train, model).collect())
    out = [(r["score"] >= 0.7) == (i % 3 == 0) for i, r in got.items() if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(out) / len(out) > 0.93
    rng = random.Random(8)
    new = spark.createDataFrame([(0, filler(rng, 300) + " grumblefaxx " + filler(rng, 300)), (1, filler(rng, 600))], "doc_id long, text string")
    scores = held(toxicity.scored(new, model).collect())
    assert scores[0]["score"] > scores[1]["score"] + 0.3
    hard = toxicity.scored(docs.drop("score"), model).collect()
    assert len(hard) == docs.count() and all(0 <= r.score <= 1 for r in hard)
    assert {r.score for r in hard if not (r.text or "").strip()} == {0.0}
    assert toxicity.scored(empty.drop("score"), model).count() == 0 and toxicity.fit(empty, labels, F.lit(True)) is None


def test_toxicity_learns_whole_documents(spark, monkeypatch):
    """Toxic words past the first 8192 bytes are learned, long clean texts stay clean, and the sample holds whole documents."""
    rng = random.Random(12)
    rows = [(i, filler(rng, 1800) + (" grumblefax " if i % 2 else " ") + filler(rng, 5), i % 2) for i in range(160)]
    assert all(len(t.encode()[:-100]) > 8192 for _, t, _ in rows)
    train = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(train, labels, F.lit(True))
    new = [(0, filler(rng, 9000)), (1, filler(rng, 3000) + " grumblefax " + filler(rng, 10)), (2, filler(rng, 2000))]
    got = held(toxicity.scored(spark.createDataFrame(new, "doc_id long, text string"), model).collect())
    assert [got[i]["score"] >= toxicity.THRESHOLD for i in range(3)] == [False, True, False], got
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, y: seen.extend(zip(texts, y, strict=True)))
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 100_000)
    toxicity.fit(train, labels, F.lit(True))
    whole = {t.encode() for _, t, _ in rows}
    assert all(t in whole for t, _ in seen) and all(0 < sum(len(t) for t, y in seen if y == k) <= 100_000 for k in (0, 1))


def test_training_takes_whole_bags(spark, monkeypatch):
    """A bad passage after the 24th is learned, and the sample's bound leaves out whole documents only."""
    rng = random.Random(14)
    rows = [(i, filler(rng, 40 * quality_mil.PASSAGE) + (" " + "#*$ " * 200 if i % 2 else ""), 1 - i % 2) for i in range(60)]
    train = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    seen = []
    real = quality_mil.train
    monkeypatch.setattr(quality_mil, "train", lambda x, edges, y: seen.extend(np.diff(edges).tolist()) or real(x, edges, y))
    model = quality_mil.fit(train, labels, F.lit(True))
    assert sorted(seen) == sorted(-(-len(r[1].split()) // quality_mil.PASSAGE) for r in rows)
    got = held(quality_mil.scored(train, model).collect())
    assert all((got[i]["score"] >= quality_mil.THRESHOLD) == (y == 1) for i, _, y in rows)
    seen.clear()
    monkeypatch.setattr(quality_mil, "SAMPLE_BYTES", 200_000)
    quality_mil.fit(train, labels, F.lit(True))
    assert 0 < len(seen) < 10 and min(seen) >= 40


def test_bag_scores_by_hand():
    texts = ["ab ab Cd 12, x!", "", filler(random.Random(1), 300)]
    (_, _, buf, offs), *_ = chunks(pa.array(texts))
    x, edges = quality_mil.passages(buf, offs, 50)
    for d, text in enumerate(texts):
        spans = [m.span() for m in WORD.finditer(text)]
        parts = [spans[i : i + 50] for i in range(0, len(spans), 50)] or [[]]
        assert edges[d + 1] - edges[d] == len(parts)
        for p, own in enumerate(parts):
            lo, hi = (own[0][0] if own else 0), (parts[p + 1][0][0] if p + 1 < len(parts) else len(text))
            codes = Counter(int(quality_mil._CLASS[a]) * 16 + int(quality_mil._CLASS[b]) for a, b in zip(text[lo:hi].encode(), text[lo:hi].encode()[1:], strict=False)) if own else Counter()
            want = np.zeros(256)
            for k, n in codes.items():
                want[k] = math.sqrt(n / sum(codes.values()))
            assert np.allclose(x[edges[d] + p, :256], want, atol=1e-5)
    model = quality_mil.train(x, edges, np.array([1.0, 0, 1]), epochs=2)
    w = {k: v.astype(float) for k, v in model.w.items()}
    for d in range(3):
        h = [np.tanh(row @ w["We"] + w["be"]) for row in x[edges[d] : edges[d + 1]]]
        e = [math.exp(sum(w["v"][k] * math.tanh(v @ w["Wt"][:, k]) / (1 + math.exp(-(v @ w["Wg"][:, k]))) for k in range(quality_mil.GATE))) for v in h]
        z = sum(a / sum(e) * v for a, v in zip(e, h, strict=True))
        assert abs(model.bags(x, edges)["p"][d] - 1 / (1 + math.exp(-(z @ w["u"] + w["c"])))) < 1e-4


def test_toxicity_scores_by_hand():
    texts = ["Ab cdefg hi, jklmnop QRS é", "", " one  two\nthree four five six seven eight nine "]
    (_, _, buf, offs), *_ = chunks(pa.array(texts))
    table = np.random.default_rng(4).normal(0, 2, toxicity.BUCKETS).astype(np.float32)
    got = toxicity.Model(table, -1.5).score(buf, offs)

    def bucket(gram: bytes) -> int:
        h = 0
        for b in gram:
            h = (h * 0x01000193 & 0xFFFFFFFF) ^ b
        x = h * 0x9E3779B1 & 0xFFFFFFFF
        return (x ^ x >> 15) & (toxicity.BUCKETS - 1)

    for text, score in zip(texts, got, strict=True):
        words, clean = WORD.findall(text.translate(LOWER)), 1.0
        for i in range(0, len(words), toxicity.WINDOW):
            bag = []
            for w in words[i : i + toxicity.WINDOW]:
                b = w.encode()
                start, end = np.array([0]), np.array([len(b)])
                bag.append(int(word_hashes(np.frombuffer(b, np.uint8), start, end)[0]) & (toxicity.BUCKETS - 1))
                b = b" " + b + b" "
                bag += [bucket(b[k : k + n]) for n in toxicity.ORDERS for k in range(len(b) - n + 1)]
            clean *= 1 - 1 / (1 + math.exp(-(float(np.mean(table[bag])) - 1.5)))
        n_windows = -(-len(words) // toxicity.WINDOW)  # one span: its evidence less what its length gives
        assert abs(score - (1 - math.exp(min(0.0, math.log(clean) + toxicity.LEAK * n_windows)))) < 1e-4


def test_broken_utf8_and_clashing_names(spark):
    """Bytes that aren't UTF-8 go through every operator on texts; columns of the same names stay."""
    rows = spark.createDataFrame([(1, "FF41 20FE".replace(" ", "")), (2, "C3"), (3, "6120620A63")], "doc_id long, x string")
    docs = rows.select("doc_id", F.unhex("x").cast("string").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    train, labels = labelled(spark)
    learned = F.col("doc_id") > 0
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert ids(quality_mil.scored(docs, quality_mil.fit(train, labels, learned))) == [1, 2, 3]
    assert ids(toxicity.scored(docs, toxicity.fit(train, labels, learned))) == [1, 2, 3]
    for out in (minhash_bayes.grouped(docs), line_cuckoo.deduped(docs), quality_rules.judged(docs), exact_lsm.dedup(docs), mixing.selection(docs), lm_bloom.scored(docs, learned)):
        assert ids(out) == [1, 2, 3]
    coded = {r.doc_id: r.round_trip for r in sentencepiece_trie.encoded(docs).collect()}
    assert coded == {1: False, 2: False, 3: True}
    clash = docs.withColumns({n: F.lit("mine") for n in ("score", "n_tokens", "IDS", "round_trip")})
    for out in (toxicity.scored(clash, None), quality_mil.scored(clash, None), toxicity.scored(clash, toxicity.fit(train, labels, learned)), sentencepiece_trie.encoded(clash)):
        assert len({c.lower() for c in out.columns}) == len(out.columns) and {r.score for r in out.select("score").collect()} == {"mine"}
    back = sentencepiece_trie.decoded(sentencepiece_trie.encoded(docs, drop_text=False))
    assert {r.doc_id: r._text for r in back.select("doc_id", "_text").collect()}[3] == "a b\nc"


# ---- 2: near-dedup ----------------------------------------------------------------


def brute_groups(texts: dict, words: int) -> dict:
    sets = {}
    for d, x in texts.items():
        w = WORD.findall((x or "").translate(LOWER))
        sets[d] = {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
    group = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((group[a], group[b]))
                group = {k: x if v == y else v for k, v in group.items()}
    return {d: (len(sets[d]), group[d]) for d in sets}


def near_corpus() -> dict[int, str]:
    """Chains of edits around the threshold, groups of near copies and unlike texts."""
    rng = random.Random(12)
    out = [t for t in hard_texts()]
    for _ in range(6):
        w = filler(rng, 90).split()
        for _ in range(12):
            out.append(" ".join(w))
            w = [x if rng.random() > 0.012 else "swap" + str(rng.randrange(99)) for x in w]
    return dict(enumerate(out))


@pytest.mark.parametrize(("few", "block"), [(128, 512), (2, 3)])
def test_near_groups(spark, empty, monkeypatch, few, block):
    monkeypatch.setattr(minhash_bayes, "FEW", few)
    monkeypatch.setattr(minhash_bayes, "BLOCK", block)
    texts = near_corpus()
    docs = spark.createDataFrame([(d, t, "en") for d, t in texts.items()], "doc_id long, text string, n string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_bayes.grouped(docs, 4).collect()}
    assert got == brute_groups(texts, 4)
    null = spark.createDataFrame([(None, texts[7]), (1, texts[7]), (1, texts[7]), (2, None)], "doc_id long, text string")
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in minhash_bayes.grouped(null, 4).collect()) == [("1", "1", True), ("1", "1", True), ("2", "2", True), ("None", "None", True)]
    assert minhash_bayes.grouped(empty, 4).count() == 0


def test_bayes_bounds():
    least = minhash_bayes.least_matches(80, 1e-7)
    for k, m in enumerate(least):
        n = (k + 1) * minhash_bayes.STEP
        missed = sum(math.comb(n, i) * 0.8**i * 0.2 ** (n - i) for i in range(m))
        assert missed < 1e-6 and m > 0.3 * n - 6


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 90), (95, 100), (95, 97)]
    got = {r.id: r.comp for r in minhash_bayes.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 95: 90, 97: 90, 100: 90}


# ---- 3: lines ------------------------------------------------------------------


def brute_lines(texts: dict, least: int) -> dict:
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    seen = Counter(k for t in texts.values() for k in {key(x) for x in (t or "").split("\n")})
    out = {}
    for d, t in texts.items():
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (key(x) and seen[key(x)] >= least)]
        out[d] = (len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest())
    return out


@pytest.mark.parametrize("how", ["broadcast", "filter and shuffle", "shuffle"])
def test_lines(spark, empty, how):
    texts = dict(enumerate(hard_texts()))
    docs = spark.createDataFrame([(d, t, "x") for d, t in texts.items()], "doc_id long, text string, n string").repartition(3)
    limits = {"broadcast": {}, "filter and shuffle": {"exact_bytes": 0}, "shuffle": {"exact_bytes": 0, "filter_bytes": 0}}[how]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_cuckoo.deduped(docs, **limits).collect()}
    assert got == brute_lines(texts, 10) and sum(x[1] for x in got.values()) >= 12
    assert line_cuckoo.deduped(empty, **limits).count() == 0


def test_lines_are_reversible(spark):
    a = spark.createDataFrame([(i, f"common\nrare {i}\nlate") for i in range(12)], "doc_id long, text string")
    b = spark.createDataFrame([(i + 50, "late\nother\ncommon") for i in range(4)], "doc_id long, text string")
    key = lambda df: {bytes(r.key): r.n for r in df.collect()}
    one = line_cuckoo.counted(a)
    both = line_cuckoo.updated(one, inserted=b)
    assert key(both) == key(line_cuckoo.counted(a.union(b)))
    assert key(line_cuckoo.updated(both, deleted=b)) == key(one)
    common = lambda df, n: df.where(F.col("n") >= n).select("key")
    old = line_cuckoo.filters(common(one, 13), 2)
    grown = line_cuckoo.maintained(old, one, both, 2, 13).cache()
    back = line_cuckoo.maintained(grown, both, one, 2, 13)
    assert sum(r.size for r in grown.collect()) == 2 and sum(r.size for r in back.collect()) == 0
    assert all(not np.frombuffer(bytes(r["filter"]), np.uint16).any() for r in back.collect())
    kept = {r.doc_id: bytes(r.kept_text).decode() for r in line_cuckoo.deduped(a, both, min_docs=13, digest=False).collect()}
    assert kept == {i: f"rare {i}" for i in range(12)}


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, (5000, 2)).astype(np.uint64)
    f = line_cuckoo.CuckooFilter.of(keys[:4000])
    assert f.contains(keys[:4000]).all() and f.contains(keys[4000:]).mean() < 0.01
    f.delete(keys[:2000])
    assert f.contains(keys[2000:4000]).all() and f.contains(keys[:2000]).mean() < 0.01


def test_a_key_asks_one_shard(spark):
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 1 << 63, (900, 2)).astype(np.uint64)
    keys[1, 0] = keys[0, 0]  # the same first half
    df = spark.createDataFrame([(bytearray(k.tobytes()),) for k in keys], "key binary")
    assert {bytes(r.key): r.s for r in df.withColumn("s", line_cuckoo._shard(7)).collect()} == {k.tobytes(): int(s) for k, s in zip(keys, line_cuckoo.shard_of(keys, 7), strict=True)}
    own = line_cuckoo.shard_of(keys, 7)
    tables = [line_cuckoo.CuckooFilter.of(keys[own == i]).table.tobytes() if i != 3 else b"" for i in range(7)]
    assert (line_cuckoo.screened(tables, keys) == (own != 3)).all()
    wrong = [tables[(i + 1) % 7] for i in range(7)]
    assert line_cuckoo.screened(wrong, keys).mean() < 0.01  # other shards' filters aren't asked
    half = line_cuckoo.sorted_keys(keys[1::2])
    assert (line_cuckoo.among(half, keys) == (np.arange(900) % 2 == 1)).all()


# ---- 4: rules -------------------------------------------------------------------


def test_rule_counts(docs, empty):
    got = sorted(quality_rules.judged(docs).collect(), key=lambda r: str(r.doc_id))
    want = []
    for d, t, *_ in docs.collect():
        t = t or ""
        w = WORD.findall(t)
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)))
    assert [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got] == sorted(want, key=lambda r: str(r[0]))
    assert not any(r.kept and r.base_failed for r in got)
    assert quality_rules.judged(empty).count() == 0


def test_verdicts_follow_from_votes(spark, docs):
    """kept by the votes of the counts, the estimates of all votes and the posterior, computed row by row."""
    rng = random.Random(21)
    texts = [filler(rng, rng.randint(5, 200)) + (" # $ * " * rng.randint(1, 40) if i % 4 == 0 else "") + ("\nsame line here" * 9 if i % 5 == 0 else "") for i in range(120)]
    rows = quality_rules.judged(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()

    def vote(r) -> tuple[int, ...]:
        w, c = r.n_words, r.word_chars
        pairs = [
            (w < 20, 50 <= w <= 200000), (c < 2 * w or c > 15 * w, 3 * w <= c <= 11 * w), (10 * r.n_symbols > w, 100 * r.n_symbols <= w),
            (100 * r.n_letters < 88 * c and w >= 60, 100 * r.n_letters >= 93 * c), (2 * r.n_dup_lines > r.n_lines, r.n_dup_lines == 0 and r.n_lines >= 2),
            (4 * r.n_repeat_words > w, 20 * r.n_repeat_words <= w and w >= 50), (5 * r.n_upper > c, 20 * r.n_upper <= c), (4 * r.n_unique < w < 2000, 2 * r.n_unique > w >= 20),
        ]
        return tuple(-1 if a else 1 if b else 0 for a, b in pairs)

    cast = {r.doc_id: vote(r) for r in rows}
    good, acc = quality_rules.estimate(sorted(Counter(cast.values()).items()), len(quality_rules.rules()))
    for r in rows:
        p = quality_rules.posterior(cast[r.doc_id], good, acc)
        assert abs(p - r.posterior) < 1e-9 and r.kept == (not r.base_failed and p >= quality_rules.KEEP)
    assert 0 < sum(r.kept for r in rows) < len(rows)


def test_estimated_accuracies():
    rng = random.Random(2)
    true = [(0.98, 0.7), (0.99, 0.5), (0.97, 0.6), (0.995, 0.4)]
    seen: Counter = Counter()
    for _ in range(20000):
        good = rng.random() < 0.8
        seen[tuple(0 if rng.random() < 0.2 else (1 if (rng.random() < a) else -1) if good else (-1 if rng.random() < b else 1) for a, b in true)] += 1
    share, acc = quality_rules.estimate(sorted(seen.items()), 4)
    assert abs(share - 0.8) < 0.06 and all(abs(x[0] - y[0]) < 0.03 for x, y in zip(acc, true, strict=True))
    assert quality_rules.posterior((1, 1, 1, 1), share, acc) > 0.9 > 0.1 > quality_rules.posterior((-1, -1, -1, 0), share, acc)


# ---- 5: tokens ---------------------------------------------------------------------


def test_tokens_equal_the_library(docs, empty):
    import sentencepiece

    model, theirs = sentencepiece_trie.Model(sentencepiece_trie.read_model()), sentencepiece.SentencePieceProcessor(model_file=sentencepiece_trie.MODEL_PATH)
    rng = random.Random(4)
    texts = [t or "" for t in hard_texts() if t is None or len(t) < 20000] + ["  lead", "trail  ", "\n a\tb\r\n", " " * 90 + "t", "1,234.5"]
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzETAOIN    \n.,;()<>éüñ漢=") for _ in range(rng.randint(1, 80))) for _ in range(400)]
    for text, ids in zip(texts, model.encode_all(texts), strict=True):
        ids = np.frombuffer(ids, "<i4").tolist()
        assert ids == theirs.encode(text), text
        assert model.decode(ids).decode() == text.replace("▁", " ")
    out = sentencepiece_trie.encoded(docs, drop_text=False)
    assert {r.text for r in out.collect() if not r.round_trip} == {t for t in hard_texts() if t and "▁" in t}
    out = out.drop("text")
    back = sentencepiece_trie.decoded(out.select("doc_id", "ids"))
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted((str(r.doc_id), (r.text or "").replace("▁", " ")) for r in docs.collect())
    assert sentencepiece_trie.encoded(empty).count() == 0


def test_pairs_stand_as_merging_says():
    model = sentencepiece_trie.Model(sentencepiece_trie.read_model())
    rng = random.Random(31)
    ids = [i for p, i in model.ids.items() if len(p) < 12]
    same = [model.ids[p] for p in ("a", "aa", "e", "ee", "ll", "l", "▁", "▁▁", "▁▁▁▁", "==", "=", "====", "-", "--") if p in model.ids]
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(20000)] + [(a, b) for a in same for b in same]
    short = [i for i in ids if len(model.pieces[i]) <= 3]
    pairs += [(rng.choice(short), rng.choice(short)) for _ in range(20000)]
    for a, b in pairs:
        x, y = model.pieces[a], model.pieces[b]
        assert model.pair_stands(a, b) == (model.merged(x + y) == [x, y]), (x, y)


def test_unigram_viterbi():
    def field(number, kind, body):
        return bytes([number << 3 | kind]) + (bytes([len(body)]) if kind == 2 else b"") + body

    pieces = [("<unk>", 0.0, 2), ("▁a", -2.0, 1), ("b", -2.5, 1), ("ab", -1.0, 1), ("▁", -1.5, 1), ("bc", -2.0, 1), ("c", -3.0, 1), ("a", -2.2, 1)]
    data = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, np.float32(s).tobytes()) + field(3, 0, bytes([k]))) for p, s, k in pieces)
    data += field(2, 2, field(3, 0, b"\x01")) + field(3, 2, field(4, 0, b"\x00"))
    model = sentencepiece_trie.Model(data)

    def best(word):
        if not word:
            return 0.0, []
        found = []
        for i in range(1, len(word) + 1):
            if word[:i] in model.ids or i == 1:
                k = model.ids.get(word[:i])
                s, rest = best(word[i:])
                found.append((s + (model.scores[k] if k is not None else min(model.scores) - 10), [k if k is not None else 0, *rest]))
        return max(found, key=lambda x: x[0])

    words = sorted({"▁abc", "▁abcb", "▁bcab", "▁axb", "▁", "▁abab"})
    assert {w: ids for w, ids in model.segmented(words)} == {w: best(w)[1] for w in words}


# ---- 7: exact dedup -------------------------------------------------------------------


def exact_groups(rows, norm):
    """What each row of (doc_id, text) should get, as doc_id, keep_id, group_size, sha; and the number of kept rows by text."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    want = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return want


def squeezed(t):
    return re.sub(r"[\x20\x09-\x0d]+", " ", t or "")


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_exact(docs, empty, spark, monkeypatch, limit):
    monkeypatch.setattr(exact_lsm, "BROADCAST_BYTES", limit)  # at 0 no filter is asked
    got = exact_lsm.dedup(docs).collect()
    want = exact_groups([(r.doc_id, r.text) for r in docs.collect()], squeezed)
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == sorted(want, key=str)
    stay = [r for r in got if r.kept]
    assert all(r.doc_id == r.keep_id for r in stay) and Counter(r.text_sha256 for r in stay) == Counter({w[3]: 1 for w in want})
    assert exact_lsm.dedup(empty).count() == 0 and exact_lsm.kept_documents(empty).count() == 0
    rows = exact_lsm.kept_documents(docs)
    assert rows.columns == docs.columns and sorted(str(r.doc_id) for r in rows.collect()) == sorted(str(r.doc_id) for r in stay)


def test_exact_keeps_one_of_repeated_rows(spark):
    rows = [(1, "a b", "x"), (1, "a  b", "w"), (1, "a b", "y"), (1, "other", "z"), (2, "a b", "v"), (None, "only null", "q"), (None, "only null", "r"), (None, "a b", "s"), (3, None, "t"), (3, "", "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = exact_lsm.dedup(docs).collect()
    assert len(got) == len(rows) and Counter(r.text_sha256 for r in got if r.kept) == Counter({r.text_sha256: 1 for r in got})
    stay = sorted((r.doc_id or 0, squeezed(r.text)) for r in exact_lsm.kept_documents(docs).collect())
    assert stay == [(0, "only null"), (1, "a b"), (1, "other"), (3, "")]


def test_compaction_is_incremental(docs):
    half = F.coalesce(F.xxhash64("text") % 2 == 0, F.lit(False))
    whole = exact_lsm.compact(exact_lsm.flush(docs))
    first = exact_lsm.compact(exact_lsm.flush(docs.where(half)))
    both = exact_lsm.compact(first, exact_lsm.flush(docs.where(~half)))
    as_set = lambda df: {(bytes(r.digest), r.keep, r.n) for r in df.collect()}
    assert as_set(whole) == as_set(both)
    level, batch = exact_lsm.stored(first), exact_lsm.flush(docs)
    bits, blocks = exact_lsm.filter_of(level)
    assert blocks == 1 and sum(bin(b).count("1") for b in bytes(bits.first().bits)) > 10
    found = {(bytes(r.digest), r.keep, r.n) for r in exact_lsm.lookup(batch, level, batch.count()).collect()}
    assert found == as_set(first) and len(found) < len(as_set(whole))


def test_unlike_texts_with_one_digest_are_told_apart(spark, docs, monkeypatch):
    monkeypatch.setattr(exact_lsm, "digest_of", lambda norm: F.unhex(F.substring(F.sha2(norm, 256), 1, 1)))
    got = exact_lsm.dedup(docs).collect()
    want = exact_groups([(r.doc_id, r.text) for r in docs.collect()], squeezed)
    assert sorted([(r.doc_id, r.keep_id, r.group_size) for r in got], key=str) == sorted([w[:3] for w in want], key=str)
    assert len(exact_lsm.kept_documents(docs).collect()) == len({w[3] for w in want})


# ---- 8: chat ----------------------------------------------------------------------------


def test_chat(spark):
    log = [(1, [("user", "a"), ("assistant", "b")]), (2, [("user", "a"), ("assistant", "b"), ("user", "c")]), (3, [("user", "a")]), (4, [("user", "a"), ("assistant", "b"), ("user", "c")]), (5, [("user", "<|im_end|>"), (None, None)]), (6, [("user", "a"), ("assistant", "x")])]
    rows = [(c, i, r, t, "extra") for c, turns in log for i, (r, t) in enumerate(turns)] + [(None, 0, "user", "lost", "extra"), (7, None, "user", "a", "extra"), (7, 1, "assistant", "b", "e")]
    got = {r.conv_id: r for r in chat.collapsed(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n string")).collect()}
    assert {k: (r.n_turns, r.copies) for k, r in got.items()} == {2: (3, 2), 5: (2, 1), 6: (2, 1)}
    assert got[5].rendered == "<|im_start|>user\n<\\|im_end|><|im_end|>\n<|im_start|>\n<|im_end|>\n"
    assert got[6].rendered == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nx<|im_end|>\n"
    assert chat.collapsed(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# ---- 9: mixing --------------------------------------------------------------------------


def fill(budget: int, caps: list[int], weights: list[int]) -> list[float]:
    """Shares by giving out what is left, again and again, to those that can still take."""
    x, open_ = [0.0] * len(caps), {i for i, w in enumerate(weights) if w > 0}
    left = float(budget)
    while left > 1e-9 and open_:
        total = sum(weights[i] for i in open_)
        given = {i: min(caps[i] - x[i], left * weights[i] / total) for i in open_}
        for i, g in given.items():
            x[i] += g
        left -= sum(given.values())
        open_ = {i for i in open_ if caps[i] - x[i] > 1e-9}
    return x


def test_shares(spark):
    rng = random.Random(6)
    for _ in range(4):
        caps, weights = [rng.randint(0, 1000) for _ in range(7)], [rng.randint(0, 5) for _ in range(7)]
        room = sum(c for c, w in zip(caps, weights, strict=True) if w)
        budget = rng.randint(0, room)
        rows = spark.createDataFrame([(str(i), c, w, budget) for i, (c, w) in enumerate(zip(caps, weights, strict=True))], "name string, c long, w0 long, b long")
        rows = rows.select("name", F.lit(0).alias("_all"), *[F.col(a).cast("decimal(38,0)").alias(b) for a, b in (("c", "cap"), ("w0", "w"), ("b", "budget"))])
        got = {int(r.name): int(r.x) for r in mixing.shared_out(rows, ["_all"]).collect()}
        for i, x in enumerate(fill(budget, caps, weights)):
            assert abs(got.get(i, 0) - x) <= 1


def test_mixing_prefixes_and_rows(docs, empty):
    rows = mixing.selection(docs, total=20000).collect()
    assert len(rows) == docs.count()
    taken = sum(r.copies * r.n_tokens for r in rows)
    assert 0 < taken <= 20000
    out = mixing.mixed_documents(docs, total=20000)
    assert out.columns == docs.columns and Counter(r.doc_id for r in out.collect()) == +Counter({r.doc_id: r.copies for r in rows})
    assert mixing.selection(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    whole = mixing.selection(docs, total=10**9).collect()
    assert {r.copies for r in whole if r.n_tokens} == {mixing.MAX_EPOCHS}


# ---- 10: language model -------------------------------------------------------------------


@pytest.mark.parametrize("limits", [{}, {"head_size": 3}, {"filter_bits": lm_bloom.SEGMENT_BITS, "head_size": 50}])
def test_language_model(spark, docs, empty, limits, monkeypatch):
    if "filter_bits" in limits:
        monkeypatch.setattr(lm_bloom, "BITS_PER_ITEM", 20_000)
    learned = remainder(F.col("doc_id"), 7) != 2
    got = lm_bloom.scored(docs, learned, **limits).collect()
    toks = lambda t: [*WORD.findall((t or "").translate(LOWER)), "\n"]
    rows = docs.collect()
    c = Counter(w for r in rows if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 != 2 for w in toks(r.text))
    n, v = sum(c.values()), len(c)
    want = sorted((str(r.doc_id), len(toks(r.text)), sum(c[w] > 0 for w in toks(r.text)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in toks(r.text))) for r in rows)
    have = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got)
    assert [x[:4] for x in have] == [x[:4] for x in want]
    assert all(abs(x[4] - y[4]) < 1e-6 * max(1, abs(y[4])) for x, y in zip(have, want, strict=True))
    plain = {str(r.doc_id): r.score for r in lm_bloom.scored(docs, learned).collect()}
    assert all(r.score < 0 and abs(r.score - plain[str(r.doc_id)]) < 0.02 * abs(plain[str(r.doc_id)]) + 1 for r in got)
    assert lm_bloom.scored(empty, learned, **limits).count() == 0


def test_filter_never_understates(spark):
    rng = np.random.default_rng(3)
    h, n = rng.integers(-(1 << 62), 1 << 62, 3000), rng.zipf(1.5, 3000).clip(1, 10**9)
    rows = spark.createDataFrame(list(zip(h.tolist(), n.tolist(), strict=True)), "h long, n long").withColumn("q", lm_bloom.level(F.col("n"), 1))
    f = lm_bloom.Filter(*lm_bloom.gathered(rows.select("h", "n"), 1, 1 << 24))
    q = {r.h: r.q for r in rows.collect()}
    found = f.levels(h.view(np.uint64))
    assert all(x >= q[k] for k, x in zip(h.tolist(), found, strict=True)) and np.mean([x == q[k] for k, x in zip(h.tolist(), found, strict=True)]) > 0.9
    assert (f.levels(rng.integers(0, 1 << 62, 5000).astype(np.uint64)) > 0).mean() < 0.05


@pytest.mark.parametrize("limits", [{}, {"filter_bits": 1024}])
def test_language_model_keeps_rare_bigrams(spark, limits, monkeypatch):
    """A bigram counted once scores above an unseen one, and the score is that of exact counts, in any number of shards."""
    if limits:
        monkeypatch.setattr(lm_bloom, "BITS_PER_ITEM", 200)
    train = "ab cd ef gh ij kl mn op qr st"
    rows = [(0, train), (1, "ab cd ef gh"), (2, "ab ef cd gh"), (3, None)]
    got = held(lm_bloom.scored(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") == 0, **limits).collect())
    own = [*train.split(), "\n"]
    one, two = Counter(own), Counter(zip(["^", *own], own, strict=False))
    for i, text in rows:
        toks = [*(text or "").split(), "\n"]
        want = 0.0
        for a, b in zip(["^", *toks], toks, strict=False):
            before = 1 if a == "^" else max(one[a], 1)
            want += math.log10(0.2 * min(two[a, b] / before, 1) + 0.8 * (one[b] + 1) / (len(own) + len(one) + 1))
        assert abs(got[i]["score"] - want) < 0.05, (i, got[i]["score"], want)
    assert got[1]["score"] > got[2]["score"] + 0.5


# ---- pipeline -------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    train, labels = labelled(spark)
    dup = filler(rng, 80)
    more = [(1000, dup), (1001, dup), (1002, dup.replace(" ", "\n")), (1003, dup + " tail"), (1004, ""), (1005, None)]
    docs = train.union(spark.createDataFrame(more, "doc_id long, text string"))
    docs = docs.select("doc_id", "text", F.lit("en").alias("lang"), F.concat(F.lit("src"), (F.col("doc_id") % 5).cast("string")).alias("source"), F.length("text").cast("long").alias("n_chars"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, str(tmp_path))
        assert out.columns == docs.columns, name
        if name.startswith("Min"):
            ids = {r.doc_id for r in out.select("doc_id").collect()}
            assert 1000 in ids and not ids & {1001, 1002, 1003}
    before = set(os.listdir(shared_dir(spark)))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {n.rsplit("-", 1)[0] for n in set(os.listdir(shared_dir(spark))) - before} == {"stage-quality", "stage-exact", "stage-minhash", "stage-mixing"}
    assert rows and all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_stages_keep_clashing_columns(spark, docs, tmp_path):
    import corpus_pipeline

    _, labels = labelled(spark)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    names = ["score", "_score", "_id", "_sha", "_digest", "whole", "_whole", "_copy", "_domain", "_lang", "domain", "digest", "sig", "n_tokens"]
    out = docs.drop("score").withColumns({n: F.lit("x") for n in names})
    columns = out.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, str(tmp_path))
        assert out.columns == columns and all(r[n] == "x" for r in out.select(*names).collect() for n in names)
    tokens = corpus_pipeline.STAGES[-1][1](spark, out, str(tmp_path)).collect()
    marked = {r.doc_id for r in out.collect() if "▁" in (r.text or "")}  # decoded to a space, as documented
    assert len(tokens) == out.count() and {r.doc_id for r in tokens if not r.round_trip} == marked
