"""Packing by best-fit decreasing.

Overlong documents are first cut into full windows. What remains of each document, longest first, goes to the open
window with the least room that still holds it; a segment tree over remaining capacities finds that window. Pieces of
one length are alike, and so are windows with the same room, so the plan is made on a histogram (at most ``capacity``
rows, whatever the corpus) with intervals of windows, and is exactly the plan that piece-by-piece best fit gives.
Pieces then look up their window by their rank among the pieces of their length. Ranks are counted inside buckets of
ids and added to the buckets' prefix sums, so neither a frequent length nor a hot source meets in one task.

Null or empty text: one piece with the end id. Null doc_id: packed, passed through. Repeated rows: each is packed.
Ties between pieces of one length go by (doc_id, start, checksum).
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from array import array
from collections import deque

import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestar.llm.bpe import byte_characters
from lodestar.llm.common import Memo, held, map_texts, stored, texts

# How vocabularies of this kind cut a lower-case text.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Before this character case and composition need no look at neighbours.
LATIN_END = "\u0250"
#: White space for Python's split that the vocabulary's pattern takes as symbols.
ODD = re.compile("[\x1c-\x1f]")


class WordBpe:
    """Ids of a lower-casing vocabulary with word ends, as little-endian unsigned 32-bit bytes. Its tokens never span
    white space, so each distinct word is encoded once in a worker. Words of Latin letters go straight to their pieces
    (runs of letters, single digits, runs of signs), which repeat more than words do, and to the merging model; others
    go through the library as a whole."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.shown, self.piece = self.tokenizer.model, byte_characters(), regex.compile(PIECE)
        self.pieces = Memo(self._merge, entries=250_000)  # what a miss costs most
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        self.words = Memo(self.word)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _merge(self, piece: str) -> bytes:
        # visible ASCII stands for itself
        shown = piece if piece.isascii() and piece.isprintable() else "".join([self.shown[b] for b in piece.encode()])
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def word(self, word: str) -> bytes:
        if not word.isascii():
            if max(word) >= LATIN_END:
                return self.whole(word)
            word = unicodedata.normalize("NFC", word)
        word = word.lower()
        return self.pieces[word] if word.isalpha() else b"".join(map(self.pieces.__getitem__, self.piece.findall(word)))

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special) or ODD.search(text):
            return self.whole(text)
        return b"".join(map(self.words.__getitem__, text.split()))


def encoder(path: str) -> WordBpe:
    return held(WordBpe, path)


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: each document's ids with the end id, in windows of capacity."""

    def rows(ids, values):
        bpe, end = encoder(path), end_id.to_bytes(4, "little")
        for i, t in zip(ids, values):
            data = bpe.encode(t) + end
            n = len(data) // 4
            for at in range(0, n, capacity):
                own = data[4 * at : 4 * (at + capacity)]
                yield i, at, len(own) // 4, zlib.crc32(own), n

    return map_texts(texts(docs), "doc_id long, start long, length int, ids_crc32 long, doc_tokens long", rows)


class Capacities:
    """Segment tree over 0..capacity: which remaining capacities have open windows, and the least one from a bound on."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.size)

    def set(self, room: int, there: bool) -> None:
        at = self.size + room
        self.any[at] = there
        while at > 1:
            at >>= 1
            self.any[at] = self.any[2 * at] | self.any[2 * at + 1]

    def tightest(self, least: int) -> int | None:
        at = self.size + least
        if not self.any[at]:
            while at > 1 and (at & 1 or not self.any[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.any[2 * at] else 2 * at + 1
        return at - self.size


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first window, pieces in a window, offset of a window's first): where the pieces of
    each length go. A window with room r takes floor(r / length) of them one after the other, as it stays the tightest."""
    open_windows: list[deque] = [deque() for _ in range(capacity + 1)]
    tree, out, windows = Capacities(capacity), [], 0

    def put(room: int, first: int, count: int) -> None:
        open_windows[room].append((first, count))
        tree.set(room, True)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first = capacity, windows
                count = -(-left // (capacity // length))
                windows += count
            else:
                first, count = open_windows[room].popleft()
                tree.set(room, bool(open_windows[room]))
            each = room // length
            full = min(count, left // each)
            if full:
                out.append((length, rank, rank + full * each, first, each, capacity - room))
                put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < count and left:
                out.append((length, rank, rank + left, first + full, each, capacity - room))
                put(room - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            if full < count:
                put(room, first + full, count - full)
    return out


#: A plan of more rows is joined by a shuffle. Its size depends on the capacity, not on the corpus.
BROADCAST_ROWS = 200_000


def pack(cut: DataFrame, capacity: int = 2048, rows_in_bucket: int = 20_000) -> DataFrame:
    """cut with sequence_id and offset. cut: doc_id, start, length (1..capacity), ids_crc32, ..., read more than once."""
    spark = cut.sparkSession
    sizes = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most capacity rows
    total = sum(sizes.values())
    where = spark.createDataFrame(plan(sizes, capacity), "p_length int, p_from long, p_to long, p_window long, p_each long, p_offset long")
    where = F.broadcast(where) if len(sizes) and total and where.count() <= BROADCAST_ROWS else where
    bucketed = cut.withColumn("p_bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(max(256, total // rows_in_bucket))))
    before = Window.partitionBy("length").orderBy("p_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = bucketed.groupBy("p_bucket", "length").count().select("p_bucket", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("p_first"))
    inside = Window.partitionBy("p_bucket", "length").orderBy("doc_id", "start", "ids_crc32")
    ranked = bucketed.withColumn("p_inside", F.row_number().over(inside) - 1).join(first, ["p_bucket", "length"]).withColumn("p_rank", F.col("p_first") + F.col("p_inside"))
    at = F.col("p_rank") - F.col("p_from")
    return (
        ranked.join(where, (F.col("length") == F.col("p_length")) & (F.col("p_rank") >= F.col("p_from")) & (F.col("p_rank") < F.col("p_to")))
        .withColumn("sequence_id", F.col("p_window") + F.floor(at / F.col("p_each")))
        .withColumn("offset", F.col("p_offset") + (at % F.col("p_each")) * F.col("length"))
        .select(*cut.columns, "sequence_id", "offset")
    )


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    cut = stored(pieces(docs, path, capacity, end_id), "pieces")
    return pack(cut, capacity).select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset")
