"""Benchmark decontamination: SimHash fingerprints of item-sized windows, multi-index search, exact check.

1. *Windows.* A window as long as an item is laid wherever the text shares enough five-word shingles with items of that length along
   one diagonal (text position minus item position). A window without a shared shingle has similarity 0, and
   one that reaches the threshold has far more on a diagonal than asked for here, so nothing is lost. The
   benchmark's shingles are taken in blocks of about ``BLOCK`` rows, each a broadcast of bounded size.
2. *Fingerprints.* 64 bits per window and item, over their words, weighted by count.
3. *Multi-index.* Two fingerprints within ``RADIUS`` bits agree on one of RADIUS + 1 bit blocks at least, so an equality
   join on (length, block, bits) finds every pair within the radius.
4. *Check.* The weighted Jaccard similarity of the shingles, counts as weights, must reach ``SIMILARITY``.

Words are runs of letters and digits in lower case. Items of fewer than five words are too short to tell from
chance and never match; null and empty texts match nothing. Windows are cut at the ends of the text. Rows that
share a doc_id or item_id are one document or item; rows without one are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barscope.llm.common import NOT_WORD, fields, let, text_of, written

WORDS = 5
SIMILARITY = 0.8
RADIUS = 16
BLOCK = 500_000
#: (lowest bit, bits) of the RADIUS + 1 blocks of a fingerprint.
BITS = [(64 * k // (RADIUS + 1), 64 * (k + 1) // (RADIUS + 1) - 64 * k // (RADIUS + 1)) for k in range(RADIUS + 1)]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda w: w != "")


def shingles_of(words: Column) -> Column:
    """Hashes of the runs of five words; none for fewer words."""
    one = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WORDS)])
    n = F.size(words)
    return F.when(n >= WORDS, F.transform(F.sequence(F.lit(0), n - WORDS), one)).otherwise(F.array().cast("array<bigint>"))


def fingerprint(words: Column) -> Column:
    """SimHash of a bag of words: each bit is the sign of the sum of that bit over all words."""

    def of(hashes: Column) -> Column:
        def bit(b: Column) -> Column:
            ones = F.aggregate(hashes, F.lit(0), lambda n, h: n + F.call_function("getbit", h, b).cast("int"))
            return F.when(ones * 2 > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

        bits = F.transform(F.sequence(F.lit(0), F.lit(63)), bit)
        return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def _block(fp: Column, k: int) -> Column:
    low, n = BITS[k]
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << n) - 1))


def _blocks(fp: Column) -> Column:
    return F.array(*[fields(k=F.lit(k), bits=_block(fp, k)) for k in range(RADIUS + 1)])


def _numbered(shingles: Column) -> Column:
    """Equal shingles made distinct by their number, so that set sizes are sums of counts."""
    return let(F.sort_array(shingles), lambda s: F.transform(s, lambda x, i: F.xxhash64(x, i.cast("long") - F.array_position(s, x))))


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_id, length in words, words and shingles of the items that can match."""
    rows = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("t"))
    parts = let(words_of(F.col("t")), lambda w: fields(n=F.size(w), words=w, own=shingles_of(w)))
    return rows.select("item_id", F.inline(F.array(parts))).where(F.col("n") >= WORDS)


def windows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, n, start): item-sized windows on the diagonals that share enough shingles with an item."""
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("t"))
    found = rows.select("doc_id", F.posexplode(let(words_of(F.col("t")), shingles_of)).alias("pos", "h"))
    posts = items.select("item_id", "n", F.posexplode("own").alias("off", "h"))
    count = posts.count()
    hits = None
    for b in range(math.ceil(count / BLOCK)):
        part = posts.where(F.pmod("h", F.lit(math.ceil(count / BLOCK))) == b)
        hit = found.join(F.broadcast(part), "h").select("doc_id", "item_id", "n", (F.col("pos") - F.col("off")).alias("start"))
        hits = hit if hits is None else hits.unionByName(hit)
    if hits is None:
        return rows.select("doc_id", F.lit(0).alias("n"), F.lit(0).alias("start")).limit(0)
    shared = hits.groupBy("doc_id", "item_id", "n", "start").agg(F.count(F.lit(1)).alias("shared"))
    enough = F.least(F.greatest(F.floor((F.col("n") - (WORDS - 1)) / 8), F.lit(1)), F.lit(16))
    return shared.where(F.col("shared") >= enough).select("doc_id", "n", "start").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item it holds: doc_id, item_id, start, n_words, distance, similarity."""
    items = written(items_of(benchmark), "items")
    spots = windows(docs, items).groupBy("doc_id").agg(F.collect_list(F.struct("n", "start")).alias("spots"))
    spots = spots.withColumnRenamed("doc_id", "__id")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("t"))
    rows = rows.join(spots, F.col("doc_id") == F.col("__id"))

    def cut(w: Column) -> Column:
        def one(s: Column) -> Column:
            at = F.greatest(s["start"], F.lit(0))
            own = F.slice(w, at + 1, F.greatest(s["n"] + s["start"] - at, F.lit(0)))
            return fields(n=s["n"], start=at, words=own)

        return F.transform("spots", one)

    found = rows.select("doc_id", F.inline(let(words_of(F.col("t")), cut)))
    print_of = lambda df: df.select("*", fingerprint(F.col("words")).alias("fp"), shingles_of(F.col("words")).alias("own"))
    found = print_of(found).withColumn("own", _numbered(F.col("own")))
    found = found.select("doc_id", "n", "start", F.size("words").alias("n_words"), "fp", "own", F.inline(_blocks(F.col("fp"))))
    known = print_of(items.drop("own")).withColumn("own", _numbered(F.col("own")))
    known = known.select("item_id", F.col("n"), F.col("fp").alias("item_fp"), F.col("own").alias("item_own"), F.inline(_blocks(F.col("fp"))))
    pairs = found.join(known, ["n", "k", "bits"])
    first = F.coalesce(*[F.when(_block(F.col("fp"), k) == _block(F.col("item_fp"), k), F.lit(k)) for k in range(RADIUS + 1)])
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))).cast("int")
    pairs = pairs.where((distance <= RADIUS) & (F.col("k") == first)).withColumn("distance", distance)
    both = F.size(F.array_intersect("own", "item_own"))
    pairs = pairs.withColumn("similarity", F.round(both / (F.size("own") + F.size("item_own") - both), 6))
    pairs = pairs.where(F.col("similarity") >= SIMILARITY)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("s"), "n_words", "distance")).alias("m")
    return pairs.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", (-F.col("m.s")).cast("long").alias("start"), F.col("m.n_words").cast("long").alias("n_words"),
        "m.distance", "m.similarity",
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item."""
    bad = contaminated(docs, benchmark).select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(bad, F.col("doc_id") == F.col("__id"), "left_anti")
