"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece the last token of its encoding is unique. It is found from the tokens that end
there (matches of an Aho-Corasick automaton over the vocabulary, which stands in for a suffix automaton, longest first): the right one is the first whose
start has a last token that is *compatible* with it, that is, the two stay apart when both are merged side
by side. Back-pointers then give the ids. No merge queue is run over the text.

Texts are cut at special tokens, then into pieces by the vocabulary's pattern. Pieces repeat, so a bounded
table keeps their ids. Null texts count as empty: no ids, empty decoded text. Rows, also repeated ones, are
encoded one by one; memory is that of some 1 MB of texts, or of one longer text.
"""

from __future__ import annotations

import json
import re
import struct
import sys
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barscope.llm.common import text_of
from barscope.llm.kernels import slices

# The splitting pattern of byte-level BPE vocabularies, and what it says for ASCII texts.
PATTERN = r" ?\p{L}+|'(?:[stmd]|re|ve|ll)| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII_PATTERN = r" ?[A-Za-z]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
KEPT_PIECES, KEPT_PAIRS = 150_000, 1 << 18
SLICE = 1 << 20


class Pieces(dict):
    """Packed ids by piece; the newest one to two times ``KEPT_PIECES`` pieces are kept."""

    def __init__(self, encode):
        self.encode, self.older = encode, {}

    def __missing__(self, piece: str) -> bytes:
        if (ids := self.older.get(piece)) is None:
            ids = self.encode(piece.encode())
        if len(self) >= KEPT_PIECES:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: printable ones as they are, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    def __init__(self, spec: str):
        """``spec`` is the text of a tokenizer file."""
        import ahocorasick
        import regex

        model = json.loads(spec)
        letters = byte_letters()
        self.token = {i: bytes(letters[c] for c in word) for word, i in model["model"]["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in model.get("added_tokens", ())}
        ids = {b: i for i, b in self.token.items()}
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b = (ids[bytes(letters[c] for c in x)] for x in (a, b))
            whole = ids[self.token[a] + self.token[b]]
            self.merged[a, b] = rank, whole
            self.parts.setdefault(whole, (rank, a, b))
        self.matches = ahocorasick.Automaton()
        for i, b in self.token.items():
            if len(b) == 1 or i in self.parts:
                self.matches.add_word(b.decode("latin-1"), (i, len(b)))
        self.matches.make_automaton()
        self.pieces, self.ascii_pieces = regex.compile(PATTERN).findall, re.compile(ASCII_PATTERN).findall
        names = "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True))
        self.cut = regex.compile(f"({names})").split if names else None
        self.edges = lru_cache(1 << 17)(self._edge)
        self.compatible = lru_cache(KEPT_PAIRS)(self._compatible)
        self.known = Pieces(self.encode_piece)
        self.bytes_of = self.token | {i: x.encode() for x, i in self.special.items()}

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens along an edge, from the whole down to a byte, each with the rank of the merge that uses it up."""
        out, until = [(token, float("inf"))], 0
        while (p := self.parts.get(token)) is not None:
            until, token = p[0], p[side]
            out.append((token, until))
        return out

    def _compatible(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border of two tokens that lie side by side.

        A merge of an edge token of the left with one of the right happens if it comes before the merges that use
        up either. At the same rank the place further left goes first.
        """
        for a, a_until in self.edges(left, 2):
            for b, b_until in self.edges(right, 1):
                m = self.merged.get((a, b))
                if m is not None and m[0] < a_until and m[0] <= b_until:
                    return False
        return True

    def encode_piece(self, piece: bytes) -> bytes:
        """Ids of a piece, as little-endian unsigned 32-bit integers."""
        n = len(piece)
        last, back, fits = [-1] * (n + 1), [0] * (n + 1), self.compatible
        for end, (token, size) in self.matches.iter(piece.decode("latin-1")):
            end += 1
            if last[end] < 0 and (end == size or fits(last[end - size], token)):
                last[end], back[end] = token, end - size
        ids, at = [], n
        while at:
            ids.append(last[at])
            at = back[at]
        return struct.pack(f"<{len(ids)}I", *reversed(ids))

    def encode(self, text: str) -> bytes:
        out = []
        for k, part in enumerate(self.cut(text) if self.cut else [text]):
            if k % 2:
                out.append(struct.pack("<I", self.special[part]))
            else:
                found = self.ascii_pieces(part) if part.isascii() else self.pieces(part)
                out.extend(map(self.known.__getitem__, found))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        numbers = memoryview(ids).cast("I") if sys.byteorder == "little" else struct.unpack(f"<{len(ids) // 4}I", ids)
        return b"".join(map(self.bytes_of.__getitem__, numbers)).decode("utf-8", "replace")


def encode_batch(encoder: Encoder, batch: pa.RecordBatch):
    """Some ``SLICE`` bytes of text at a time, as Python's copies of texts and ids are several times as large."""
    for part, _, _ in slices(batch, size=SLICE):
        ids = list(map(encoder.encode, part.column("t").to_pylist()))
        decoded = list(map(encoder.decode, ids))
        out = [part.column("doc_id"), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())]
        yield pa.RecordBatch.from_arrays(out, ["doc_id", "ids", "decoded"])


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id, ``ids`` (little-endian unsigned 32-bit integers) and the text decoded from them."""
    spec = open(path, encoding="utf-8").read()
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches):
        encoder = Encoder(shared.value)
        for batch in batches:
            yield from encode_batch(encoder, batch)

    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("t"))
    schema = T.StructType().add("doc_id", "long").add("ids", "binary").add("decoded", "string")
    return rows.mapInArrow(run, schema)


def digests(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
