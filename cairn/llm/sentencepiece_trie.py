"""SentencePiece encoding and decoding by a Viterbi search with shared prefixes.

Text becomes marked words: runs of marks (spaces) with what follows them. The
distinct marked words of a chunk are sorted, which orders them as a depth-first
walk of their trie; the forward states of a prefix are kept on a stack and
reused by all words that share the prefix, so only the rest of a word is
searched. A state says how the best segmentation of the prefix ends.

For a unigram model the best segmentation has the highest sum of piece scores.
For a BPE model it is the one that merging would give: a sequence of pieces is
that segmentation exactly if merging leaves each neighbouring pair as it is, so
a piece extends the best segmentation of what precedes it if that pair stands.
Pairs are checked by merging them, and remembered. Characters without a piece
become byte pieces, or the unknown piece if the model has none.

Only models without normalisation (identity) and with a mark before the text
are supported. Defined results: a null text counts as empty and has no ids; a
mark character in a text can't be told from a space and is decoded as one; all
other texts are decoded to themselves. Bytes that aren't UTF-8 are read as
U+FFFD, so round_trip is false. Repeated rows are encoded like others.
"""

from __future__ import annotations

import ctypes
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from contextlib import suppress
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cairn.llm.common import bounded_batches, fresh, map_text

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Bytes, by estimate, of what a worker remembers unless told otherwise: words with their ids until the end of
#: a task, and pairs, which are emptied when full.
WORD_BYTES, PAIR_BYTES = 128 << 20, 24 << 20
#: Bytes of a word in the table besides its letters (at most 4 each) and ids (4 each), and of a pair.
WORD_COST, PAIR_COST = 240, 96
UNIGRAM, BPE = 1, 2
#: Characters by which pieces are looked up, and what stands before a text that has fewer: no piece holds it.
TAIL = 3
PAD = "\0" * TAIL


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffer message: numbers, and integers or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = out = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else 8 if kind == 1 else 4
            yield tag >> 3, data[at : at + n]
            at += n


class Model:
    """Pieces of a SentencePiece model file."""

    NORMAL, UNKNOWN, BYTE = 1, 2, 6

    def __init__(self, data: bytes, word_bytes: int = WORD_BYTES, pair_bytes: int = PAIR_BYTES):
        self.word_bytes, self.pair_bytes = word_bytes, pair_bytes
        self.kind, self.pieces, self.scores, kinds = UNIGRAM, [], [], []
        dummy = True
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append(own.get(1, b"").decode())
                self.scores.append(float(np.frombuffer(own[2], "<f4")[0]) if 2 in own else 0.0)
                kinds.append(own.get(3, self.NORMAL))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                own = dict(_fields(value))
                dummy = bool(own.get(3, 1))
                if own.get(2) or own.get(4, 1):
                    raise ValueError("only models without normalisation are supported")
        if self.kind not in (UNIGRAM, BPE) or not dummy:
            raise ValueError("only unigram and BPE models with a mark before the text are supported")
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == self.NORMAL}
        self.unknown = kinds.index(self.UNKNOWN)
        byte_ids = [i for i, k in enumerate(kinds) if k == self.BYTE]
        self.bytes = byte_ids if len(byte_ids) == 256 else None
        self.texts = [bytes([byte_ids.index(i)]) if k == self.BYTE else p.replace(MARK, " ").encode() if k == self.NORMAL else b"" for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True))]
        self.texts[self.unknown] = " ⁇ ".encode()
        # Characters that no longer piece holds stand alone: words can be cut there.
        inside = set("".join(p for p in self.ids if len(p) > 1))
        self.cuts = "".join(c for c in "\n\t" if c not in inside)
        self.words = re.compile(f" *[^ {self.cuts}]+|[{self.cuts}]| +") if self.cuts else re.compile(" *[^ ]+| +")
        # Lengths of the longer pieces that end in TAIL given characters, the longest first: only these are looked up.
        self.spaced = {p.replace(MARK, " "): i for p, i in self.ids.items()}
        tails: dict[str, set[int]] = {}
        for p in self.spaced:
            if len(p) > TAIL:
                tails.setdefault(p[-TAIL:], set()).add(len(p))
        self.longer = {t: sorted(sizes, reverse=True) for t, sizes in tails.items()}
        self.endings: dict[str, tuple[tuple[int, int], ...]] = {}
        self.forget()
        self.stands: dict[int, bool] = {}
        self.grown: dict[int, tuple | None] = {}

    def next_merge(self, parts: list[str]) -> int:
        """Where the best-scored neighbours are, the leftmost among equals; -1 without any."""
        best, at = None, -1
        for i in range(len(parts) - 1):
            k = self.ids.get(parts[i] + parts[i + 1])
            if k is not None and (best is None or self.scores[k] > best):
                best, at = self.scores[k], i
        return at

    def merged(self, text: str) -> list[str]:
        """BPE of a short text: the best-scored neighbours are merged, the leftmost first."""
        parts = list(text)
        while len(parts) > 1 and (at := self.next_merge(parts)) >= 0:
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def growth(self, piece: int) -> tuple[list[tuple[str, float]], list[tuple[str, float]]] | None:
        """What a piece's first and its last character become while the piece is merged: (text, score) from the character to the piece; None if merging doesn't give the piece."""
        found = self.grown.get(piece, False)
        if found is False:
            text = self.pieces[piece]
            parts, first, final = list(text), [(text[0], 0.0)], [(text[-1], 0.0)]
            while len(parts) > 1 and (at := self.next_merge(parts)) >= 0:
                made = parts[at] + parts[at + 1]
                step = (made, self.scores[self.ids[made]])
                if at == 0:
                    first.append(step)
                if at == len(parts) - 2:
                    final.append(step)
                parts[at : at + 2] = [made]
            falling = all(x[1] >= y[1] for chain in (first[1:], final[1:]) for x, y in zip(chain, chain[1:], strict=False))
            found = self.grown[piece] = (first, final) if len(parts) == 1 and falling else None
        return found

    def pair_stands(self, a: int, b: int) -> bool:
        """Whether merging leaves the pieces a and b (ids) as they are beside each other.

        The text at their border grows on both sides in the order of scores; the
        pair falls if a piece across the border would be merged before the next
        step of either side, the leftmost first among equals.
        """
        key = a << 32 | b
        found = self.stands.get(key)
        if found is None:
            if len(self.stands) * PAIR_COST >= self.pair_bytes:
                self.stands.clear()
            left, right = self.growth(a), self.growth(b)
            if left is None or right is None:
                x, y = self.pieces[a], self.pieces[b]
                found = self.merged(x + y) == [x, y]
            else:
                found = self._border_stands(left[1], right[0])
            self.stands[key] = found
        return found

    def _border_stands(self, xs: list[tuple[str, float]], ys: list[tuple[str, float]]) -> bool:
        i = j = 0
        none = float("-inf")
        while True:
            p, q = xs[i + 1][1] if i + 1 < len(xs) else none, ys[j + 1][1] if j + 1 < len(ys) else none
            k = self.ids.get(xs[i][0] + ys[j][0])
            if k is not None and self.scores[k] > p and self.scores[k] >= q:
                return False
            if p == q == none:
                return True
            if p >= q:
                i += 1
            else:
                j += 1

    def loose(self, char: str) -> list[int]:
        """Ids of a character without a piece."""
        return [self.bytes[b] for b in char.replace(MARK, " ").encode()] if self.bytes else [self.unknown]

    def ending(self, tail: str) -> tuple[tuple[int, int], ...]:
        """(length, id) of the pieces that a text with these last TAIL characters may end in, the longest first; -1 for an id that depends on more characters."""
        found = [(n, -1) for n in self.longer.get(tail, ())] + [(n, self.spaced[tail[-n:]]) for n in range(TAIL, 0, -1) if tail[-n:] in self.spaced]
        if len(self.endings) * PAIR_COST * 2 >= self.pair_bytes:
            self.endings.clear()
        self.endings[tail] = tuple(found)
        return self.endings[tail]

    def segmented(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """(word, ids) of distinct words with marks as MARK."""
        return ((word.replace(" ", MARK), ids) for word, ids in self.searched(sorted(w.replace(MARK, " ") for w in words)))

    def searched(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """(word, ids) of sorted distinct words (marks as spaces), prefix states shared along the sorted order."""
        bpe, scores = self.kind == BPE, self.scores
        piece_of, ending_of, stands = self.spaced.get, self.endings.get, self.stands.get
        low = min(scores, default=0.0) - 10
        # By prefix length: where its last piece starts, that piece (or -1 for a character without one), and for a unigram model the best score.
        start, last, score = [0], [-1], [0.0]
        before = ""
        for word in words:
            same, most = 0, min(len(before), len(word))
            while same < most and before[same] == word[same]:
                same += 1
            del start[same + 1 :], last[same + 1 :], score[same + 1 :]
            padded = PAD + word
            for end in range(same + 1, len(word) + 1):
                tail = padded[end : end + TAIL]
                best, at, piece = None, end - 1, -1
                for size, k in ending_of(tail) or self.ending(tail):
                    j = end - size
                    if k < 0:
                        if j < 0 or (k := piece_of(word[j:end], -1)) < 0:
                            continue
                    if bpe:
                        left = last[j]
                        if left >= 0:
                            ok = stands(left << 32 | k)
                            if not (self.pair_stands(left, k) if ok is None else ok):
                                continue
                        at, piece = j, k
                        break
                    value = score[j] + scores[k]
                    if best is None or value > best:
                        best, at, piece = value, j, k
                start.append(at)
                last.append(piece)
                if not bpe:
                    if best is None or word[end - 1] not in self.spaced and score[end - 1] + low > best:
                        best, start[-1], last[-1] = score[end - 1] + low, end - 1, -1  # a character without a piece
                    score.append(best)
            out: list[int] = []
            end = len(word)
            while end:
                k = last[end]
                if k >= 0:
                    out.append(k)
                else:
                    out.extend(self.loose(word[end - 1 : end])[::-1])
                end = start[end]
            yield word, out[::-1]
            before = word

    def learn(self, words: set[str]) -> None:
        """Puts the ids of words (marks as spaces) among the known ones.

        Of two generations the older is dropped when the younger is full, so words
        that keep coming stay.
        """
        if self.known_bytes > self.word_bytes // 2:
            self.older, self.known, self.known_bytes = self.known, {}, 0
        new = words.difference(self.known)
        for w in new.intersection(self.older):
            ids = self.known[w] = self.older[w]
            self.known_bytes += WORD_COST + 4 * len(w) + len(ids)
        for word, found in self.searched(sorted(new.difference(self.older))):
            ids = self.known[word] = array("i", found).tobytes()
            self.known_bytes += WORD_COST + 4 * len(word) + len(ids)

    def forget(self) -> None:
        self.known, self.older, self.known_bytes = {}, {}, 0

    def marked(self, text: str) -> list[str]:
        return self.words.findall(" " + text.replace(MARK, " ")) if text else []

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        split = [self.marked(t) for t in texts]
        self.learn({w for words in split for w in words})
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.texts.__getitem__, ids))[1:]


@lru_cache(maxsize=2)
def model_of(data: bytes, word_bytes: int = WORD_BYTES, pair_bytes: int = PAIR_BYTES) -> Model:
    return Model(data, word_bytes, pair_bytes)


def give_back() -> None:
    """Returns what the worker has freed to the system, where its C library can."""
    with suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def read_model(path: str = MODEL_PATH) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoded(docs: DataFrame, path: str = MODEL_PATH, ids: bool = True, drop_text: bool = True, word_bytes: int = WORD_BYTES, pair_bytes: int = PAIR_BYTES, keep_model: bool = True) -> DataFrame:
    """docs with n_tokens, ids_sha256, round_trip (whether decoding gave the text back), and ids unless they aren't wanted.

    ids_sha256 is of the ids as little-endian 32-bit integers. Columns that docs
    has already keep their names; the new ones then get underscores in front.
    The model file is read by the driver and sent to the workers; it is a few
    hundred KB. word_bytes and pair_bytes bound what a worker remembers: less of
    it takes more time and gives the same result. keep_model: whether it keeps
    the model with its pairs for its next task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_model(path))
    fields = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("round_trip", T.BooleanType())] + ([("ids", T.ArrayType(T.IntegerType()))] if ids else [])

    def run(buf: np.ndarray, offs: np.ndarray) -> list:
        model = model_of(shared.value, word_bytes, pair_bytes)
        whole = buf.tobytes()
        raw = [whole[a:b] for a, b in zip(offs[:-1], offs[1:], strict=True)]
        found = model.encode_all([r.decode("utf-8", "replace") for r in raw])
        lists = [np.frombuffer(x, "<i4") for x in found]
        back = [model.decode(x.tolist()) == r for x, r in zip(lists, raw, strict=True)]
        out: list = [[len(x) for x in lists], [hashlib.sha256(x).hexdigest() for x in found], back]
        if ids:
            ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int32))))
        return out

    def done() -> None:
        model_of(shared.value, word_bytes, pair_bytes).forget()
        if not keep_model:
            model_of.cache_clear()
        give_back()

    return map_text(docs, "text", fields, run, drop_text, done=done)


def decoded(rows: DataFrame, path: str = MODEL_PATH) -> DataFrame:
    """rows with ids (array of int) replaced by text; null ids count as none. A column text that rows has already stays, and the new one is _text."""
    shared = rows.sparkSession.sparkContext.broadcast(read_model(path))
    kept = [f for f in rows.schema.fields if f.name != "ids"]
    schema = T.StructType(kept + [T.StructField(fresh([f.name for f in kept], "text"), T.StringType())])
    bounded_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(shared.value)
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            texts = [model.decode(x or []).decode("utf-8", "replace") for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(f.name)) for f in kept] + [pa.array(texts, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)
