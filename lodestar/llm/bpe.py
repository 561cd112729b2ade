"""Byte-level BPE by forced-boundary splitting.

A pair of bytes that occurs inside no vocabulary token can never be inside a token of a text either, so between the two
there is always a cut. Pre-tokens are cut at all such pairs, the fragments are encoded on their own (each once in a
worker: they repeat a lot) and the results are concatenated. The ids are those of the ``tokenizers`` library without
added special tokens; a special token's own string inside a text becomes that token, as the library has it.

Null or empty text: no ids, and the hash of the empty string. Null doc_id: passed through. Repeated rows: each counts.
No shuffle: each document is done where it is read, so a hot source or a group of copies costs its own bytes only.
"""

from __future__ import annotations

import hashlib
import json
import re

import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from lodestar.llm.common import Memo, held, map_texts, texts

#: How byte-level vocabularies of this kind cut a text before merging.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_characters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if it is visible Latin-1, else the next
    free character from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b if b in visible else next(hidden)) for b in range(256)]


class ForcedBoundaryBpe:
    """Encodes and decodes with one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.model = Tokenizer.from_file(path).model
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.shown = byte_characters()
        byte_of = {c: b for b, c in enumerate(self.shown)}
        self.bytes_of = {i: bytes(byte_of[c] for c in token) for token, i in spec["model"]["vocab"].items()}
        joined = [bytearray(256) for _ in range(256)]
        for token in self.bytes_of.values():
            for a, b in zip(token, token[1:]):
                joined[a][b] = 1
        #: joined[a][b]: some token has byte b right after byte a.
        self.joined = [bytes(x) for x in joined]
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.bytes_of_text = {str(i): b for i, b in self.bytes_of.items()}
        self.pre_token = regex.compile(PRE_TOKEN)
        self.fragments = Memo(self._merge)
        #: Ids of a pre-token as decimal text with commas.
        self.pieces = Memo(lambda s: ",".join(map(str, self.pre_token_ids(s))))

    def _merge(self, fragment: bytes) -> tuple[int, ...]:
        shown = self.shown
        return tuple(t.id for t in self.model.tokenize("".join([shown[b] for b in fragment])))

    def cut(self, data: bytes) -> list[bytes]:
        """data at its forced boundaries."""
        joined, out, start = self.joined, [], 0
        for i in range(1, len(data)):
            if not joined[data[i - 1]][data[i]]:
                out.append(data[start:i])
                start = i
        out.append(data[start:])
        return out

    def pre_token_ids(self, pre_token: str) -> list[int]:
        return [i for f in self.cut(pre_token.encode()) for i in self.fragments[f]]

    def encode_text(self, text: str) -> str:
        """The ids in decimal, with commas between them."""
        if self.at_special is None or not any(s in text for s in self.special):
            return ",".join(map(self.pieces.__getitem__, self.pre_token.findall(text)))
        parts = self.at_special.split(text)
        out = [str(self.special[p]) if k % 2 else ",".join(map(self.pieces.__getitem__, self.pre_token.findall(p))) for k, p in enumerate(parts)]
        return ",".join(x for x in out if x)

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for i in self.encode_text(text or "").split(",") if i]

    def decode(self, ids) -> str:
        """Special tokens stay; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def decode_text(self, ids: str) -> str:
        return b"".join(map(self.bytes_of_text.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else ""


def codec(path: str) -> ForcedBoundaryBpe:
    """The worker's own."""
    return held(ForcedBoundaryBpe, path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids."""

    def rows(ids, values):
        bpe = codec(path)
        return ((i, bpe.encode(t)) for i, t in zip(ids, values))

    return map_texts(texts(docs), "doc_id long, ids array<int>", rows)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of (doc_id, ids); null ids give an empty text."""

    def rows(ids, values):
        bpe = codec(path)
        return ((i, bpe.decode(v or ())) for i, v in zip(ids, values))

    return map_texts(encoded, "doc_id long, text string", rows, second="ids")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Each text encoded and decoded again, as digests: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def rows(ids, values):
        bpe, sha = codec(path), hashlib.sha256
        for i, t in zip(ids, values):
            found = bpe.encode_text(t)
            yield i, found.count(",") + 1 if found else 0, sha(found.encode()).hexdigest(), sha(bpe.decode_text(found).encode()).hexdigest()

    return map_texts(texts(docs), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", rows)
