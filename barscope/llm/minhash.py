"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

Shingles are runs of five words (lower-cased A-Z; a shorter text is one run). A shingle weighs its count times
its idf, ``1 + ln(N / df) / ln(1 / RARE)``, with df the number of documents that have it; it is 2 for every
shingle in less than the share ``RARE`` of the documents, 1 for one that all have. There are at most (mean
shingles of a document / RARE) shingles above that share: these alone are gathered, all others weigh the same.

``SAMPLES`` consistent samples of each document form ``BANDS`` band keys. Documents that share a key are
candidates; a pair is a link if its weighted Jaccard similarity, computed from the texts, is ``SIMILARITY`` or
more. Classes are the connected components of the links, named by their smallest doc_id.

Not all pairs of a bucket are held against each other, yet no class is lost:
1. Documents with the same words are one node.
2. Each bucket's most popular document (the one whose keys are shared most) is compared with its members.
3. What still lies in different classes of one bucket is paired unless it can't be similar: the common weight of two
   documents is at most the lesser share they have with the center plus the lesser share they have, beside
   it, with any other such document. Most members of a large group are either joined in step 2 or ruled out
   here by numbers alone.

Null and empty texts and those without a word stand alone, as do rows with a null doc_id (their class is null).
Rows that share a doc_id are one document. Every row of the input has a row in the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barscope.llm import kernels as K
from barscope.llm.common import sifted, text_of, written

SIMILARITY = 0.8
RARE = 0.01
BANDS, ROWS = 12, 3
SAMPLES = BANDS * ROWS
PART = 1 << 22
U = K.U
_SEEDS = K.mix(np.arange(1, SAMPLES + 1, dtype=U) * U(0x632BE59BD9B4E019))


def samples(keys, log_weight, first):
    """Consistent weighted samples: for every text and function the chosen (shingle, level) as one number.

    For weight w: t = floor(ln w / r + b), ln a = ln c - r (t - b + 1) with r, c ~ Gamma(2, 1) and b ~ U(0, 1)
    drawn from shingle and function; the shingle with the smallest a is chosen.
    """
    n = len(first) - 1
    out = np.full((SAMPLES, n), ~U(0), dtype=U)
    for low in range(0, len(keys), 1 << 15):
        key, weight = keys[low : low + (1 << 15)], log_weight[low : low + (1 << 15)]
        doc = np.searchsorted(first, np.arange(low, low + len(key)), "right") - 1
        cut = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        here, odd = doc[cut], np.flatnonzero(weight)
        for k in range(SAMPLES):
            x = (key ^ _SEEDS[k]) * U(0xBF58476D1CE4E5B9)
            x ^= x >> U(32)
            x *= U(0x94D049BB133111EB)
            x ^= x >> U(29)
            y = x * U(0xD6E8FEB86659FD93)
            y ^= y >> U(32)
            unit = lambda v: (v.astype(np.uint32).astype(np.float32) + np.float32(0.5)) * np.float32(2**-24)
            low24 = U(0xFFFFFF)
            b = (x & U(0xFFFF)).astype(np.uint32).astype(np.float32) * np.float32(2**-16)
            r = -np.log(unit(x >> U(40)) * unit((x >> U(16)) & low24))
            c = -np.log(unit(y >> U(40)) * unit((y >> U(16)) & low24))
            t = np.zeros(len(key), dtype=np.float32)  # as ln w is 0 for nearly all
            t[odd] = np.floor(weight[odd] / r[odd] + b[odd])
            a = c * np.exp(r * (b - t - 1))
            name = ((key * U(0x9E3779B1)) ^ (t.astype(np.int64).astype(U) * U(0x85EBCA77))) & U(0xFFFFFFFF)
            packed = (a.view(np.uint32).astype(U) << U(32)) | name
            out[k, here] = np.minimum(out[k, here], np.minimum.reduceat(packed, cut))
    return (out & U(0xFFFFFFFF)).T


class Weights:
    """Shingle weights: those of common shingles by name, 1 for all others (half the idf above)."""

    def __init__(self, values, factors):
        order = np.argsort(values)
        self.values, self.factors = values[order], factors[order]

    def __call__(self, keys, counts):
        w = counts.astype(float)
        if len(self.values):
            at = np.minimum(np.searchsorted(self.values, keys), len(self.values) - 1)
            hit = self.values[at] == keys
            w[hit] *= self.factors[at[hit]]
        return w


def _shingles(data, offsets):
    return K.counted(*K.shingles(*K.words(data, offsets)))


def _often(batches):
    """Shingles in at least half the share RARE of some part of the texts, with their counts there.

    What is in RARE of all documents reaches half of that share in the parts that name it, or is in less than
    half of it elsewhere, so adding half the share for the other parts bounds it from above.
    """
    held, size, docs = [], 0, 0

    def part():
        value, count = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, U), np.zeros(0, int))
        keep = count >= docs * RARE / 2
        value, count = np.append(value[keep].astype(np.int64), -1), np.append(count[keep], docs)
        sizes = np.append(np.full(keep.sum(), docs), 0)
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (value, count, sizes)], ["v", "n", "docs"])

    for batch in batches:
        for _, data, offsets in K.slices(batch):
            keys, _, first = _shingles(data, offsets)
            held.append(keys)
            size, docs = size + len(keys), docs + int((np.diff(first) > 0).sum())
            if size >= PART:
                yield part()
                held, size, docs = [], 0, 0
    yield part()


def shingle_weights(texts: DataFrame) -> Weights:
    """Exact document frequencies of the common shingles, in two passes."""
    counts = texts.select("t").mapInArrow(_often, "v long, n long, docs long").groupBy("v")
    counts = counts.agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = written(counts, "shingle-counts")
    total = counts.where("v = -1").agg(F.sum("n")).first()[0] or 0
    bound = F.col("n") + (F.lit(total) - F.col("docs")) * (RARE / 2)
    names = counts.where((F.col("v") >= 0) & (bound >= total * RARE) & (F.col("n") > 1)).select("v").collect()
    values = np.array(sorted(r["v"] for r in names), dtype=np.int64).astype(U)
    if not len(values):
        return Weights(values, np.zeros(0))
    shared = texts.sparkSession.sparkContext.broadcast(values)

    def exact(batches):
        n = np.zeros(len(shared.value), dtype=np.int64)
        for batch in batches:
            for _, data, offsets in K.slices(batch):
                keys, _, _ = _shingles(data, offsets)
                at = np.minimum(np.searchsorted(shared.value, keys), len(n) - 1)
                n += np.bincount(at[shared.value[at] == keys], minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], ["i", "n"])

    found = texts.select("t").mapInArrow(exact, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(len(values))
    for r in found:
        df[r["i"]] = r["n"]
    keep = (df >= total * RARE) & (df > 1)
    idf = 1 + np.log(total / df[keep]) / np.log(1 / RARE)
    return Weights(values[keep], np.minimum(idf, 2.0) / 2)


def _signatures(weights):
    def run(batches):
        for batch in batches:
            for part, data, offsets in K.slices(batch):
                hashes, at = K.words(data, offsets)
                order = (np.arange(len(hashes)) - np.repeat(at[:-1], np.diff(at))).astype(U)
                whole = np.zeros((2, len(offsets) - 1), dtype=U)
                keys, counts, first = K.counted(*K.shingles(hashes, at))
                some = np.flatnonzero(np.diff(first))
                if not len(some):
                    continue
                for j in range(2):  # 128 bits of the words in their order
                    whole[j, some] = np.add.reduceat(K.mix(hashes + order * K._ROLL[j + 5]) * K._ROLL[j + 5], at[some])
                w = weights.value(keys, counts)
                s = samples(keys, np.log(w).astype(np.float32), first)[some]
                bands = np.empty((len(some), BANDS), dtype=U)
                for b in range(BANDS):
                    h = np.full(len(some), U(b + 1), dtype=U)
                    for j in range(ROWS):
                        h = K.mix(h * U(31) + s[:, b * ROWS + j])
                    bands[:, b] = h
                total = np.add.reduceat(w, first[some])
                flat = pa.array(bands.ravel().view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * BANDS, pa.int32()), flat)
                out = [part.column("doc_id").take(pa.array(some)), *(pa.array(whole[j, some].view(np.int64)) for j in range(2)), pa.array(total), lists]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "k1", "k2", "weight", "bands"])

    return run


def _weighed(weights):
    """Exploded (doc_id, shingle, weight)."""

    def run(batches):
        for batch in batches:
            for part, data, offsets in K.slices(batch, size=1 << 20):
                keys, counts, first = _shingles(data, offsets)
                doc = np.repeat(part.column("doc_id").to_numpy(), np.diff(first))
                w = weights.value(keys, counts).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(keys.astype(np.int64)), pa.array(w)], ["doc_id", "v", "w"])

    return run


def _similar(weights):
    """Weighted Jaccard similarity of the pairs' texts."""

    def side(column):
        keys, counts, first = _shingles(*K.bytes_of(column))
        row = np.repeat(np.arange(len(column)), np.diff(first))
        return (row.astype(U) << U(52)) | keys, weights.value(keys, counts), row

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                (ka, wa, ra), (kb, wb, rb) = side(part.column("ta")), side(part.column("tb"))
                at = np.minimum(np.searchsorted(ka, kb), max(len(ka) - 1, 0))
                hit = ka[at] == kb if len(ka) else np.zeros(len(kb), bool)
                n = part.num_rows
                both = np.bincount(rb[hit], weights=np.minimum(wa[at[hit]], wb[hit]), minlength=n)
                total = np.bincount(ra, weights=wa, minlength=n) + np.bincount(rb, weights=wb, minlength=n) - both
                sim = both / np.maximum(total, 1e-12)
                out = [part.column("a"), part.column("b"), pa.array(sim)]
                yield pa.RecordBatch.from_arrays(out, ["a", "b", "similarity"])

    return run


def compared(pairs: DataFrame, texts: DataFrame, weights) -> DataFrame:
    """The pairs (a, b) with the similarity of their texts."""
    a = texts.select(F.col("doc_id").alias("a"), F.col("t").alias("ta"))
    b = texts.select(F.col("doc_id").alias("b"), F.col("t").alias("tb"))
    found = pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb")
    found = found.mapInArrow(_similar(weights), "a long, b long, similarity double")
    return found.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def _links(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("similarity") >= SIMILARITY - 1e-9).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of the links (a, b); the label is the smallest node of its component.

    Each round every label takes the smallest label next to it, then that one's own; links inside a label fall
    away. Rounds are logarithmic in number for the shallow graphs of near copies, and written, as each reads the last.
    """
    edges = written(links.where("a <> b").select("a", "b").distinct(), "links")
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node"))
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("up")), "label-step")
        over = up.select(F.col("a").alias("up"), F.col("up").alias("over"))
        step = up.join(over, "up", "left").select(F.col("a").alias("from"), F.coalesce("over", "up").alias("to"))
        step = written(step, "label-step")
        labels = labels.join(step, F.col("label") == F.col("from"), "left")
        labels = written(labels.select("node", F.coalesce("to", "label").alias("label")), "labels")
        for side in ("a", "b"):
            edges = edges.join(step, F.col(side) == F.col("from")).drop(side, "from").withColumnRenamed("to", side)
        edges = written(edges.where("a <> b").distinct(), "links")
    return labels


def _may_link(center_part: Column, more: Column, weight: Column) -> Column:
    """Whether two documents may be similar, from bounds of what they have in common.

    Both know what they share with the bucket's center (``inside``) and what else some document shares
    (``beside``); in common they have at most the lesser of either.
    """
    common = center_part + more
    return common >= SIMILARITY * (weight - common) - 1e-4


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id and class_id, the smallest doc_id of its class."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("t"))
    texts = rows.where("doc_id IS NOT NULL")
    weights = docs.sparkSession.sparkContext.broadcast(shingle_weights(texts))
    sig = texts.mapInArrow(_signatures(weights), "doc_id long, k1 long, k2 long, weight double, bands array<long>")
    sig = written(sig, "signatures")
    reps = sig.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("weight").alias("weight"), F.first("bands").alias("bands"))
    copies = sig.select("doc_id", "k1", "k2").join(reps.select("k1", "k2", "rep"), ["k1", "k2"])
    copies = copies.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))

    band = reps.select("rep", "weight", F.explode("bands").alias("band"))
    sizes = band.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    placed = written(band.join(sizes, "band"), "buckets")
    popular = placed.groupBy("rep").agg(F.sum("n").alias("popular"))
    placed = written(placed.join(popular, "rep").drop("n"), "buckets")
    centers = placed.groupBy("band").agg(F.max(F.struct("popular", (-F.col("rep")).alias("r"), "weight")).alias("m"))
    centers = written(centers.select("band", (-F.col("m.r")).alias("center"), F.col("m.weight").alias("center_weight")), "centers")
    star = placed.join(centers, "band").where("rep <> center").select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct()

    # The texts that any pair can need.
    need = placed.select(F.col("rep").alias("doc_id")).distinct()
    # An inner join: a semi-join would be moved below the sifting.
    own = written(sifted(texts, "doc_id", need).join(need, "doc_id"), "candidate-texts")
    star = written(compared(star, own, weights), "pairs")
    links = _links(star)
    label = components(links)

    now = placed.join(label, F.col("rep") == F.col("node"), "left")
    now = now.select("band", "rep", "weight", F.coalesce("label", "rep").alias("label"))
    mixed = now.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n"))
    mixed = mixed.where("low <> high AND n > 2").select("band")
    left = written(now.join(mixed, "band"), "buckets")
    some = left.select(F.col("rep").alias("doc_id")).distinct()
    alone = own.join(some, "doc_id", "left_semi")
    alone = alone.mapInArrow(_weighed(weights), "doc_id long, v long, w float")
    alone = alone.groupBy("v").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("to"), F.sum("w").alias("w"))
    alone = alone.where(F.col("doc_id") == F.col("to")).groupBy("doc_id").agg(F.sum("w").alias("alone"))
    left = left.join(centers, "band").where("rep <> center")
    left = left.join(alone.select(F.col("doc_id").alias("rep"), "alone"), "rep", "left")
    left = left.join(star.withColumnsRenamed({"a": "center", "b": "rep"}), ["center", "rep"])
    inside = F.col("similarity") / (1 + F.col("similarity")) * (F.col("weight") + F.col("center_weight"))
    left = left.withColumn("inside", inside)
    left = left.withColumn("beside", F.greatest(F.col("weight") - F.col("inside") - F.coalesce("alone", F.lit(0.0)), F.lit(0.0)))
    left = left.where(_may_link(F.col("inside"), F.col("beside"), F.col("weight") + F.col("inside") + F.col("beside")))
    left = left.join(reps.select("rep", "bands"), "rep").select("band", "rep", "weight", "label", "inside", "beside", "bands")
    left = written(left, "buckets")
    other = left.select(*[F.col(c).alias(f"other_{c}") for c in left.columns])
    least = lambda c: F.least(F.col(c), F.col(f"other_{c}"))
    pairs = left.join(other, [
        F.col("band") == F.col("other_band"),
        F.col("rep") < F.col("other_rep"),
        F.col("label") != F.col("other_label"),
        _may_link(least("inside"), least("beside"), F.col("weight") + F.col("other_weight")),
        # A pair that shares several bands comes from the first.
        F.get(F.array_intersect("bands", "other_bands"), F.lit(0)) == F.col("band"),
    ])
    pairs = pairs.select(F.col("rep").alias("a"), F.col("other_rep").alias("b"))
    known = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = _links(compared(written(pairs.join(known, ["a", "b"], "left_anti"), "pairs"), own, weights))
    label = components(links.unionByName(more).unionByName(copies))
    label = label.select(F.col("node").alias("__node"), "label")
    out = rows.select("doc_id").join(label, F.col("doc_id") == F.col("__node"), "left")
    return out.select("doc_id", F.coalesce("label", "doc_id").alias("class_id"))
