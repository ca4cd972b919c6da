"""Byte-level BPE by speculation and verification (operator 1).

A batch's new words are cut greedily, longest vocabulary entry first: a guess. The guess is what exact
merging gives if and only if no merge would have crossed any token border. Whether one would have is
decided for all adjacent pairs of a batch at once (``compatible``), and words with a failing pair or an
entry that merging cannot reach are merged exactly. Ids of words are remembered, within a bound.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = 500_000  # words whose ids a worker remembers
TOGETHER = 2_000_000  # characters of texts whose new words are verified together
NEVER = np.iinfo(np.int64).max

# The published split rule of byte-level BPE, for any text and spelt out for Latin text.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_BLANKS = r"\t-\r \x85\xa0  -     　"
_ANY = regex.compile(SPLIT.replace(r"[^\s\p{L}\p{N}]", rf"[^{_BLANKS}\p{{L}}\p{{N}}]").replace(r"\s", f"[{_BLANKS}]").replace(r"\S", f"[^{_BLANKS}]"))
_LETTER, _NUMBER, _SPACE = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_BEYOND = re.compile("[^\x00-ɏ]")


def split(text: str) -> list[str]:
    return (_ANY if _BEYOND.search(text) else _LATIN).findall(text)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a vocabulary file: itself if it prints, else one from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """Entries, merges and the tree of each entry: which two were merged into it, and when."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        letters, model = byte_letters(), data["model"]
        of = lambda word: bytes(letters[c] for c in word)
        self.ids = {of(w): i for w, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.size = max([*self.ids.values(), *self.special.values()]) + 1
        self.bytes = [b""] * self.size
        for word, i in self.ids.items():
            self.bytes[i] = word
        for word, i in self.special.items():
            self.bytes[i] = word.encode()
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        left = np.array([self.ids[of(a)] for a, _ in pairs], np.int64)
        right = np.array([self.ids[of(b)] for _, b in pairs], np.int64)
        made = np.array([self.ids[of(a) + of(b)] for a, b in pairs], np.int64)
        self.rank, self.left, self.right = np.full(self.size, -1), np.full(self.size, -1), np.full(self.size, -1)
        self.rank[made], self.left[made], self.right[made] = np.arange(len(made)), left, right
        if len(np.unique(made)) < len(made) or (self.rank[made] <= np.maximum(self.rank[left], self.rank[right])).any():
            raise ValueError("each entry must come from one merge, after both of its parts")
        keys = left * self.size + right
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.merges = dict(zip(keys.tolist(), range(len(keys))))
        self.made = made.tolist()
        self.longest: dict[bytes, int] = {}
        for word in self.ids:
            self.longest[word[:2]] = max(len(word), self.longest.get(word[:2], 0))
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.sound: dict[int, bool] = {}
        self.decimal = np.array([f"{i},".encode() for i in range(self.size)])
        self.marks = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def guess(self, word: bytes) -> list[int]:
        """Greedy cut, longest entry first."""
        out, at, end, ids, longest = [], 0, len(word), self.ids, self.longest
        while at < end:
            for n in range(min(longest.get(word[at : at + 2], 1), end - at), 0, -1):
                if (i := ids.get(word[at : at + n])) is not None:
                    break
            out.append(i)
            at += n
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the pair of least rank first, leftmost among equals."""
        ids, size, rank = [self.single[b] for b in word], self.size, self.merges.get
        if len(ids) > 100:
            return self._merge_long(ids)
        ranks = [rank(a * size + b, NEVER) for a, b in zip(ids, ids[1:])]
        while ranks and (r := min(ranks)) != NEVER:
            i = ranks.index(r)
            ids[i] = self.made[r]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank(ids[i] * size + ids[i + 1], NEVER)
            if i:
                ranks[i - 1] = rank(ids[i - 1] * size + ids[i], NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same over a heap of pairs and linked places, n log n."""
        size, rank = self.size, self.merges.get
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := rank(ids[i] * size + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = self.made[r], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := rank(ids[x] * size + ids[y])) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return [i for i in ids if i >= 0]

    def reachable(self, token: int) -> bool:
        """Whether merging the entry's own bytes gives the entry."""
        if token not in self.sound:
            self.sound[token] = self.merge(self.bytes[token]) == [token]
        return self.sound[token]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of neighbours: True if no merge crosses the border between them.

        Runs time backwards. Of the two pieces that touch at the border, the one made last is undone,
        so that the pieces that touched before it appear. A merge of two touching pieces would have
        happened if its rank comes before the event just undone; where ranks tie, the pieces are equal
        and the left pair merges first.
        """
        ok, live = np.ones(len(a), bool), np.arange(len(a))
        x, y, limit = a.astype(np.int64), b.astype(np.int64), np.full(len(a), NEVER)
        while len(live):
            keys = x * self.size + y
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            crossed = (self.keys[at] == keys) & (self.order[at] < limit)
            ok[live[crossed]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~crossed & ((rx >= 0) | (ry >= 0))
            live, x, y, rx, ry = live[go], x[go], y[go], rx[go], ry[go]
            undo = ry >= rx
            limit = np.where(undo, ry + 1, rx)
            x, y = np.where(undo, x, self.right[x]), np.where(undo, self.left[y], y)
        return ok

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        guesses = [self.guess(w) for w in words]
        flat = np.fromiter((i for g in guesses for i in g), np.int64)
        owner = np.repeat(np.arange(len(words)), [len(g) for g in guesses])
        bad = np.zeros(len(words), bool)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        bad[owner[inner[~self.compatible(pairs // self.size, pairs % self.size)[back]]]] = True
        tokens, back = np.unique(flat, return_inverse=True)
        bad[owner[~np.array([self.reachable(int(t)) for t in tokens], bool)[back]]] = True
        for w in np.flatnonzero(bad):
            guesses[w] = self.merge(words[w])
        return guesses


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes texts; ``special`` says whether the file's special strings are tokens or ordinary text."""

    def __init__(self, path: str, special: bool = True):
        self.words, self.known = vocabulary(path), {}
        self.marks = self.words.marks if special else None

    def learn(self, words: list[str]) -> None:
        found = self.words.encode_words([w.encode() for w in words])
        self.known.update((word, array("I", ids).tobytes()) for word, ids in zip(words, found))

    def pieces(self, text: str) -> list[str]:
        if self.marks is None or not self.marks.search(text):
            return split(text)
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += [*split(text[at : m.start()]), m.group()]
            i = self.words.special[m.group()]
            self.known[m.group()] = array("I", [i]).tobytes()
            at = m.end()
        return out + split(text[at:])

    def __call__(self, texts: list[str]):
        """The ids of each text. New words are verified together."""
        at = 0
        while at < len(texts):
            some, room = [], TOGETHER
            while at < len(texts) and (room > 0 or not some):
                some.append(self.pieces(texts[at]))
                room -= len(texts[at])
                at += 1
            words = set(chain.from_iterable(some))
            new = words.difference(self.known)
            if len(self.known) + len(new) > WORDS:
                self.known = {w: self.known[w] for w in words.difference(new)}
            if new:
                self.learn(list(new))
            for words in some:
                yield np.frombuffer(b"".join(map(self.known.__getitem__, words)), np.uint32)

    def decimals(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by commas."""
        return self.words.decimal[ids].tobytes().replace(b"\0", b"")[:-1]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text's bytes; what is no UTF-8 becomes the replacement character."""
        data = b"".join(map(self.words.bytes.__getitem__, ids.tolist()))
        return data.decode("utf-8", "replace").encode()


def encode(docs: DataFrame, path: str, special: bool = True) -> DataFrame:
    """(doc_id, ids array) of every whole text; a null text is empty. Repeated rows are encoded each."""

    def run(batches):
        encoder = Encoder(path, special)
        for batch in batches:
            ids = pa.array(list(encoder(batch.column(1).to_pylist())), pa.list_(pa.uint32())).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    return _texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give an empty text."""

    def run(batches):
        encoder = Encoder(path)
        for batch in batches:
            texts = [encoder.decode(np.array(i or [], np.int64)).decode() for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text: ids and the text decoded from them, as digests."""

    def run(batches):
        encoder = Encoder(path)
        for batch in batches:
            out = []
            for ids in encoder(batch.column(1).to_pylist()):
                out.append((len(ids), hashlib.sha256(encoder.decimals(ids)).hexdigest(), hashlib.sha256(encoder.decode(ids)).hexdigest()))
            columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 3, [pa.int64(), pa.string(), pa.string()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
