"""Concatenate and cut (operator 5): documents become one long token stream, cut every ``width`` ids.

Pass one encodes each partition's documents, keeps their ids (two bytes each where they fit) with the
number of ids before them in the partition, and so gives the partition totals. Their prefix sums are
the global offsets. Pass two cuts every document at the multiples of ``width`` of its global place: no
row is exchanged, whatever a document's length. A sequence that crosses partitions is made of boundary
records from each; only those meet in ``sequences``.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panescan.llm.bpe import byte_letters
from panescan.llm.common import Remembered, keep

CHUNK_BYTES, PIECE_BYTES = 80 << 20, 24 << 20  # a generation of what a worker remembers of chunks, and of their pieces
_BLANK = re.compile("[ \t\n\r\x0b\x0c]+")  # ends a word for the tokenizer, whatever follows
_INFO = "\x1c\x1d\x1e\x1f"  # white space for str.split alone
# The published split rule of the word BPE file, and the same spelt out for lower-cased Latin text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTER, _NUMBER = r"a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"0-9\xb2\xb3\xb9\xbc-\xbe"
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_LETTER}{_NUMBER}]+")
_BEYOND = re.compile("[^\x00-\u024f]")
# Not in a text that is lower-cased as a whole: what is not Latin in either case, and what neither prints nor is blank. NFC changes no text of the rest.
_ODD = re.compile("[" + "".join(rf"\u{ord(c):04x}" for c in map(chr, range(0x250)) if _BEYOND.search(c.lower()) or not (c.isprintable() or _BLANK.match(c))) + "\u0250-\U0010ffff]")
_BYTES = {b: c for c, b in byte_letters().items()}


@lru_cache(2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


class ChunkEncoder:
    """Ids of texts by the tokenizers library, which meets each piece of a blank-separated chunk once.

    For tokenizers whose normalizer and pre-tokenizer drop white space and never join across it. A
    chunk that holds one of the file's special strings goes through the library whole.
    """

    def __init__(self, path: str, chunk_bytes: int = CHUNK_BYTES):
        self.tokenizer = _tokenizer(path)
        self.model = self.tokenizer.model
        self.known, self.pieces = Remembered(self.chunk, chunk_bytes), Remembered(self.piece, chunk_bytes * PIECE_BYTES // CHUNK_BYTES)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.marked = re.compile("|".join(map(re.escape, self.special)) or "(?!)").search
        steps = (json.loads(self.tokenizer.to_str())["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.plain = steps[0].get("pattern") == {"Regex": SPLIT} and not any(s.isalpha() for s in self.special)
        self.even = False  # whether the text at hand holds nothing of _ODD and no special string

    def chunk(self, text: str) -> bytes:
        if self.even:
            return self.latin(text)
        if self.plain and (text.isascii() or not _BEYOND.search(text)):
            normal = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).lower()
            if not _BEYOND.search(normal) and text.isprintable() and not self.marked(text):
                return self.latin(normal)
        if self.marked(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        normal = self.tokenizer.normalizer.normalize_str(text)
        return b"".join([self.ids(p) for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)])

    def latin(self, normal: str) -> bytes:
        if normal.isalpha():  # letters alone are one piece
            return self.pieces.get(normal) or self.piece(normal)
        known, pieces = self.known, self.pieces
        return b"".join([known.get(p) or pieces[p] for p in _PIECE.findall(normal)])

    def piece(self, text: str) -> bytes:
        return self.ids(text if text.isascii() else text.encode().decode("latin-1").translate(_BYTES))

    def ids(self, letters: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def __call__(self, text: str) -> np.ndarray:
        normal = text.lower()
        self.even = self.plain and not _ODD.search(text) and not any(s in text or s in normal for s in self.special)
        if self.even:  # chunks in either case are remembered once
            chunks = normal.split()
        else:
            chunks = _BLANK.split(text) if any(c in text for c in _INFO) else text.split()
        return np.frombuffer(b"".join(map(self.known.__getitem__, chunks)), np.uint32)


@lru_cache(2)
def encoder(path: str, chunk_bytes: int = CHUNK_BYTES) -> ChunkEncoder:
    """The encoder of this worker process: its tasks follow each other and share what it remembers."""
    return ChunkEncoder(path, chunk_bytes)


def encode(docs: DataFrame, path: str, end: int, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, part, before, tokens, wide, ids) of every document, ``end`` added to its ids; a null text is empty."""

    def run(batches):
        part, before, ids_of, press = TaskContext.get().partitionId(), 0, encoder(path, chunk_bytes), zstandard.ZstdCompressor(1).compress
        for batch in batches:
            rows = []
            for text in batch.column(1):
                ids = np.append(ids_of(text.as_py()), np.uint32(end))
                wide = bool(ids.max() > 0xFFFF)
                data = press(ids.astype("<u4" if wide else "<u2").tobytes())
                rows.append((part, before, len(ids), wide, data))
                before += len(ids)
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "part", "before", "tokens", "wide", "ids"])

    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return texts.mapInArrow(run, "doc_id long, part int, before long, tokens long, wide boolean, ids binary")


def cut(encoded: DataFrame, width: int, with_ids: bool = True) -> DataFrame:
    """Pieces of ``encoded`` documents; ``ids`` holds a piece's ids, little-endian, four bytes each."""
    totals = encoded.groupBy("part").agg(F.max(F.col("before") + F.col("tokens")).alias("total"))
    # one row per partition of the scan: a bound of 16 bytes for some hundred MB of text
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(order), F.lit(0)).alias("base"))
    placed = encoded.join(F.broadcast(offsets), "part").select("doc_id", (F.col("base") + F.col("before")).alias("place"), "tokens", "wide", "ids")

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(batches):
        unpress = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out, pieces = [], []
            for doc, place, tokens, wide, data in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.frombuffer(unpress(data), "<u4" if wide else "<u2").astype("<u4").tobytes()
                at = 0
                while at < tokens:
                    sequence, offset = divmod(place + at, width)
                    stop = min(tokens, at + width - offset)
                    piece = ids[4 * at : 4 * stop]
                    out.append((doc, at, stop - at, zlib.crc32(piece), tokens, sequence, offset))
                    if with_ids:
                        pieces.append(piece)
                    at = stop
            columns = [pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 7)] + [pa.array(pieces, pa.binary())] * with_ids
            yield pa.RecordBatch.from_arrays(columns, names)

    return placed.mapInArrow(run, ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n in names))


def pack(docs: DataFrame, path: str, end: int = 1, width: int = 2048, with_ids: bool = True, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Pieces of all documents in sequences of ``width`` ids; only the last sequence may be shorter.

    Every row is packed, repeated rows and null or repeated doc_ids too; an empty text gives its end id
    alone, a very long one as many pieces as it needs. An empty table gives no rows. Other columns play
    no part. ``ids`` are left out unless ``with_ids``. Each worker process remembers up to twice
    ``chunk_bytes`` of chunks, and keeps them as long as it lives.
    """
    return cut(keep(encode(docs, path, end, chunk_bytes)), width, with_ids)


def sequences(pieces: DataFrame, width: int = 2048, pad: int = 0) -> DataFrame:
    """(sequence_id, ids array, tokens): the pieces joined, padded to ``width``. Whole sequences only meet their own pieces."""
    rows = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("tokens"))

    def run(batches):
        for batch in batches:
            out = []
            for parts in batch.column("parts").to_pylist():
                ids = np.frombuffer(b"".join(p["ids"] for p in parts), "<u4")
                out.append(np.pad(ids, (0, width - len(ids)), constant_values=pad).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("sequence_id"), pa.array(out, pa.list_(pa.int64())), batch.column("tokens")], ["sequence_id", "ids", "tokens"])

    return rows.mapInArrow(run, "sequence_id long, ids array<long>, tokens long")
