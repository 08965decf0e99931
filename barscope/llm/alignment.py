"""Alignment of two tokenizers over a corpus, each distinct text once.

Texts are shuffled whole by their own value, so that copies meet and only their number is kept; each distinct text is then encoded
by both vocabularies and cut where tokens of both end at the same byte. Such a common end links the two tokens that end there. The
pairs of all links are counted over the corpus, each text's links times its number of copies, and the measures of a text go
back to the documents by its SHA-256.

Two tokens that end together are one a suffix of the other, byte by byte, as both begin inside the text. So the possible pairs
follow from the vocabularies alone (a few hundred thousand; ``Pairs``), whatever the corpus: links are stored as numbers of pairs, and the
counts of all pairs are a table of proven size, the only thing that is sent to every task.

A null or empty text, and one that either vocabulary does not give back byte by byte, has no tokens: zeros and an empty
``groups_sha256``. Repeated rows and rows without a doc_id are all kept. A text of any length is encoded whole; memory is that of one text or of
some 1 MB of shorter ones. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barscope.llm import kernels as K
from barscope.llm.bpe import Encoder
from barscope.llm.common import text_of, written

SLICE = 1 << 20
MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


class Side:
    """One vocabulary: the bytes of every token, all in one array."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.size = np.array([len(t) for t in tokens], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.data = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def joined(self, ids):
        """Bytes of a run of tokens."""
        size = self.size[ids]
        shift = self.start[ids] - np.cumsum(size) + size
        return self.data[np.repeat(shift, size) + np.arange(size.sum())]


def byte_level(spec: str):
    """Encoder and tokens of a byte-level vocabulary file; special tokens inside texts are plain text."""
    model = Encoder(spec)
    model.cut = None
    tokens = [b""] * (max(model.token) + 1)
    for i, t in model.token.items():
        tokens[i] = t

    def encode(texts: list[str]):
        return [np.frombuffer(model.encode(t), dtype="<u4") for t in texts]

    return encode, Side(tokens)


def pieces(proto: bytes):
    """Encoder and tokens of a sentence-piece vocabulary with byte fallback."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=proto)

    def of(i: int) -> bytes:
        if model.is_byte(i):
            return bytes([int(model.id_to_piece(i)[1:-1], 16)])
        if model.is_control(i) or model.is_unknown(i):
            return b""
        return model.id_to_piece(i).replace("▁", " ").encode()

    def encode(texts: list[str]):
        return model.encode(texts, num_threads=1)

    return encode, Side([of(i) for i in range(model.vocab_size())])


class Pairs:
    """All pairs of tokens of which one is a suffix of the other, as sorted numbers ``a << 32 | b``."""

    def __init__(self, a: Side, b: Side):
        found = set()
        for one, two, swap in ((a, b, False), (b, a, True)):
            ids: dict[bytes, list[int]] = {}
            for i, t in enumerate(two.tokens):
                if t:
                    ids.setdefault(t, []).append(i)
            for i, t in enumerate(one.tokens):
                for k in range(len(t)):
                    for j in ids.get(t[k:], ()):
                        found.add((j << 32 | i) if swap else (i << 32 | j))
        self.keys = np.array(sorted(found), dtype=np.int64)
        self.b = (self.keys & 0xFFFFFFFF).astype(np.int64)

    def number(self, a, b):
        key = (a.astype(np.int64) << 32) | b.astype(np.int64)
        at = np.searchsorted(self.keys, key)
        assert (self.keys[at] == key).all(), "tokens that end together are suffixes of each other"
        return at.astype(np.int32)


@lru_cache(1)
def tools(spec: str, proto: bytes):
    """Both encoders with their pairs; one set for each worker process."""
    encode_a, a = byte_level(spec)
    encode_b, b = pieces(proto)
    n = max(len(a.tokens), len(b.tokens))
    shown = np.array([f"{i}{sep}" for sep in ",|;" for i in range(n)], dtype=object)
    return encode_a, a, encode_b, b, Pairs(a, b), shown


def _ids(encoded):
    size = np.array([len(x) for x in encoded], dtype=np.int64)
    return np.concatenate([np.zeros(0, np.int64), *[np.array(x, dtype=np.int64) for x in encoded]]), np.concatenate([[0], np.cumsum(size)])


def _whole(side: Side, ids, cut, texts: list[bytes]):
    """Which texts their tokens give back byte by byte."""
    data, size = side.joined(ids).tobytes(), np.concatenate([[0], np.cumsum(side.size[ids])])[cut]
    return np.array([data[size[i] : size[i + 1]] == t for i, t in enumerate(texts)], dtype=bool)


def aligned(texts: list[str], spec: str, proto: bytes):
    """Per text: numbers of tokens on both sides, the groups as text, and the pair numbers of its links."""
    encode_a, a, encode_b, b, pairs, shown = tools(spec, proto)
    spaced = [" " + t for t in texts]
    raw = [t.encode() for t in spaced]
    (ids_a, cut_a), (ids_b, cut_b) = _ids(encode_a(spaced)), _ids(encode_b(texts))
    good = _whole(a, ids_a, cut_a, raw) & _whole(b, ids_b, cut_b, raw) & np.array([len(t) > 0 for t in texts], dtype=bool)
    if not good.all():
        ids_a, cut_a = _kept(ids_a, cut_a, good)
        ids_b, cut_b = _kept(ids_b, cut_b, good)
    # Both sides now cover the same bytes, so ends are places in the concatenation of the texts.
    end_a, end_b = np.cumsum(a.size[ids_a]), np.cumsum(b.size[ids_b])
    _, at_a, at_b = np.intersect1d(end_a, end_b, assume_unique=True, return_indices=True)
    link = pairs.number(ids_a[at_a], ids_b[at_b])
    # The tokens in the order shown: by group, first side first; the sign after a token says what comes next.
    group_a, group_b = np.searchsorted(at_a, np.arange(len(ids_a))), np.searchsorted(at_b, np.arange(len(ids_b)))
    n = len(shown) // 3
    sign_a, sign_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    sign_a[at_a], sign_b[at_b] = n, 2 * n
    order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
    words = shown[np.concatenate([ids_a + sign_a, ids_b + sign_b])[order]].tolist()
    cut_link = np.searchsorted(at_a, cut_a)
    for i in range(len(texts)):
        part = "".join(words[cut_a[i] + cut_b[i] : cut_a[i + 1] + cut_b[i + 1]])[:-1]
        yield int(cut_a[i + 1] - cut_a[i]), int(cut_b[i + 1] - cut_b[i]), part, link[cut_link[i] : cut_link[i + 1]]


def _kept(ids, cut, good):
    size = np.where(good, np.diff(cut), 0)
    return ids[np.repeat(good, np.diff(cut))], np.concatenate([[0], np.cumsum(size)])


def distinct_texts(docs: DataFrame) -> DataFrame:
    """Each text once, with the number of its copies; copies are counted before the shuffle."""
    return docs.select(text_of().alias("t")).where("t <> ''").groupBy("t").agg(F.count(F.lit(1)).alias("copies"))


def align(docs: DataFrame, byte_spec: str, piece_model: str) -> DataFrame:
    """Per row of ``docs``: doc_id and the measures of its text.

    Results: ``n_a`` and ``n_b`` tokens, ``n_groups`` between common ends, ``n_links``, ``n_best`` links whose pair is the most frequent
    of its second token, the sum of the links' counts, and the SHA-256 of the groups.
    """
    spark = docs.sparkSession
    vocabularies = spark.sparkContext.broadcast((open(byte_spec, encoding="utf-8").read(), open(piece_model, "rb").read()))

    def run(batches):
        for batch in batches:
            for part, _, _ in K.slices(batch, size=SLICE):
                rows = list(aligned(part.column("t").to_pylist(), *vocabularies.value))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("key"), part.column("copies"),
                        pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                        pa.array([hashlib.sha256(r[2].encode()).hexdigest() if r[0] else "" for r in rows], pa.string()),
                        pa.array([r[3] for r in rows], pa.list_(pa.int32())),
                    ],
                    ["key", "copies", "n_a", "n_b", "groups_sha256", "links"],
                )

    key = F.unhex(F.sha2(F.col("t"), 256))
    schema = "key binary, copies long, n_a long, n_b long, groups_sha256 string, links array<int>"
    texts = written(distinct_texts(docs).withColumn("key", key).mapInArrow(run, schema), "alignments")

    # The pairs of all links, combined before the shuffle; as many rows as pairs at most.
    counts = texts.select("copies", F.explode("links").alias("pair")).groupBy("pair").agg(F.sum("copies").alias("n")).toArrow()
    _, a, _, b, pairs, _ = tools(*vocabularies.value)
    count = np.zeros(len(pairs.keys), dtype=np.int64)
    count[counts.column("pair").to_numpy()] = counts.column("n").to_numpy()
    highest = np.zeros(len(b.tokens), dtype=np.int64)
    np.maximum.at(highest, pairs.b, count)
    shared = spark.sparkContext.broadcast((count, count == highest[pairs.b]))

    def measure(batches):
        n, best = shared.value
        for batch in batches:
            links = batch.column("links")
            at, number = links.offsets.to_numpy().astype(np.int64), links.values.to_numpy()
            sums = [np.concatenate([[0], np.cumsum(x[number], dtype=np.int64)]) for x in (best, n)]
            size = np.diff(at)
            out = [batch.column("key"), batch.column("n_a"), batch.column("n_b"), batch.column("groups_sha256"), pa.array(size), *[pa.array(s[at[1:]] - s[at[:-1]]) for s in sums]]
            yield pa.RecordBatch.from_arrays(out, ["key", "n_a", "n_b", "groups_sha256", "n_links", "n_best", "count_sum"])

    schema = "key binary, n_a long, n_b long, groups_sha256 string, n_links long, n_best long, count_sum long"
    per_text = texts.select("key", "n_a", "n_b", "groups_sha256", "links").mapInArrow(measure, schema)
    # Each common end closes a group and links one pair.
    per_text = per_text.withColumn("n_groups", F.col("n_links")).withColumnRenamed("key", "__key")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text_of(), 256)).alias("__k"))
    out = rows.join(per_text, F.col("__k") == F.col("__key"), "left")
    zero = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in MEASURES]
    return out.select("doc_id", *zero, F.coalesce(F.col("groups_sha256"), F.lit("")).alias("groups_sha256"))
