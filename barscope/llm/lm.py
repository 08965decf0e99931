"""Hierarchical Pitman-Yor language model over words, learned from all training texts, and scores of all texts.

Every context (the word before, or the beginning of a text) is a restaurant, its words are dishes, and its tables are customers of one
shared parent, the restaurant without context, whose own base is uniform over the vocabulary and one unknown word. A Gibbs sampler goes
in rounds: the contexts are seated given the parent's probabilities, their tables are sent to the parent, the parent is seated by them, and
its new probabilities go back to the contexts for the next round. A sweep reseats every customer of every dish: those of a dish leave
together, and the number of tables they take again is drawn at once (``Reseated``), t tables with the weight of all seatings that have so many. After
``BURN`` rounds each of ``SAMPLES`` rounds gives a seating, and a word's probability is the mean of its predictive probabilities under
all of them. They sum to one over the vocabulary and the unknown word.

How it is spread. Documents are cut into blocks of about ``BLOCK`` bytes, whose tokens are written once as numbers of the block's words. Blocks
ask for their distinct words and for their distinct (context, word) pairs, each with its training count, in one packed
row per bucket; a bucket holds about ``BUCKET`` tokens' worth of pairs, sums the counts, seats its restaurants and, after the rounds, answers every
block in the order it asked. A round takes two small shuffles: the tables of each bucket's dishes to the words' buckets, and those words' customers
and tables in the parent back. Words have buckets of their own, of about ``WORDS_BUCKET`` words of blocks, so the rows of a round are few
whatever the number of buckets of pairs. What is packed lies in the order of names, as gaps, and frequent words have small numbers.
A pair seen once always has one table, so it is sent once and only pairs seen more often take part in the rounds. So what is shuffled are distinct pairs of blocks (some five bytes each), never tokens, and no task holds more than a bucket or a
block. A context lies in one bucket; one that has more than half a bucket's share of all tokens is split by word into parts, each taking its
own tables times the number of parts for the restaurant's. Only words with a millionth of all tokens or more (a million at most) are
broadcast, for short names and the first round.

Departures from a sequential sampler: the parent's probabilities stay as they are within a round, and so does the strength of a new table in the parent. The
first round has those of a parent whose customers are all tokens (words below a millionth share the mean of the rest). The dishes of a restaurant
depend on each other by its tables in all; given a gamma variable for each restaurant they don't, and are drawn at the same time, which is exact. Each round starts from
a mean number of tables under its own probabilities and takes ``WITHIN`` sweeps. Dishes of more than ``SMALL`` customers take ``PROPOSALS`` Metropolis-Hastings
steps in a sweep, of which some nine in ten are accepted. No customer and no count is left out.

A null text is empty: one end token. Rows without a doc_id and repeated rows are all kept and, unless held out, all learned from. Texts of any
length are read whole. Without any training text all probabilities are uniform. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import struct
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barscope.llm import kernels as K
from barscope.llm.common import text_of, written

BLOCK = 12 << 20
BUCKET, WORDS_BUCKET = 2_000_000, 1_000_000
BURN, SAMPLES, WITHIN = 2, 4, 4
# Dishes of up to so many customers are drawn from a table of all outcomes; nodes of the integrals and proposals for larger ones; cells of an array.
SMALL, NODES, PROPOSALS, CELLS = 512, 32, 2, 1 << 18
# Discount and strength of contexts and of their parent.
CONTEXT, PARENT = (0.75, 1.0), (0.6, 1.0)
HEAD, RARE = 1_000_000, K.U(1 << 24)
SEED = 20240713
END, BEGIN = K.U(0x2D358DCCAA6C78A5), K.U(0x8BB84B93962EACC9)


def pack(*arrays) -> bytes:
    """Arrays of numbers below 2^64 as one compressed value: byte planes, those of zeros left out."""
    import zstandard

    head, body = [struct.pack("<B", len(arrays))], []
    for a in arrays:
        a = np.ascontiguousarray(a).astype(K.U, copy=False)
        planes = a.view(np.uint8).reshape(-1, 8).T
        used = [k for k in range(8) if planes[k].any()]
        head.append(struct.pack("<QB", len(a), sum(1 << k for k in used)))
        body += [planes[k].tobytes() for k in used]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(head + body))


def unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes, at = [], 1
    for _ in range(raw[0]):
        sizes.append(struct.unpack_from("<QB", raw, at))
        at += 9
    out = []
    for n, used in sizes:
        planes = np.zeros((n, 8), dtype=np.uint8)
        for k in range(8):
            if used >> k & 1:
                planes[:, k] = np.frombuffer(raw, np.uint8, n, at)
                at += n
        out.append(planes.reshape(-1).view(K.U))
    return out


def signed(a):
    return a.view(np.int64)


def gaps(a, first=slice(0, 1)):
    """Differences of rising numbers, which pack shorter; those at ``first`` begin a run and stay whole."""
    out = np.diff(a, prepend=a.dtype.type(0))
    out[first] = a[first]
    return out


def ungapped(a, runs=None):
    """Unsigned numbers from their gaps, in runs of these lengths or in one."""
    total = np.cumsum(a, dtype=K.U)
    if runs is None:
        return total
    first = np.cumsum(runs) - runs
    return total - np.repeat(total[first] - a[first], runs)


# Blocks ---------------------------------------------------------------------------------------


def _blocks(batches):
    """Rows of a block: its documents, tokens as numbers of its words, and its words with their training counts."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for part, data, offsets in K.slices(batch, size=BLOCK, rows=1 << 30):
            hashes, first = K.words(data, offsets, K.NO_SPACE)
            size = np.diff(first) + 1
            tokens = np.full(size.sum(), END, dtype=K.U)
            at = np.ones(len(tokens), dtype=bool)
            at[np.cumsum(size) - 1] = False
            tokens[at] = hashes
            words, local = np.unique(np.concatenate([tokens, [BEGIN]]), return_inverse=True)
            local = local[:-1]
            held = part.column("held").to_numpy(zero_copy_only=False).astype(bool)
            trained = np.repeat(~held, size)
            known = np.bincount(local[trained], minlength=len(words))
            ids = part.column("doc_id")
            missing = ids.is_null().to_numpy(zero_copy_only=False)
            docs = pack(ids.fill_null(0).to_numpy().view(K.U), missing, held, size)
            often = np.empty(len(words), dtype=np.int64)
            often[_often(known)] = np.arange(len(words))
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([number], pa.int64()), "n": pa.array([len(tokens)], pa.int64()), "n_words": pa.array([len(words)], pa.int64()), "docs": pa.array([docs], pa.binary()),
                "tokens": pa.array([pack(often[local])], pa.binary()), "words": pa.array([pack(gaps(words), known)], pa.binary()),
            })
            number += 1


def _often(known):
    """Places of a block's words by falling training count; tokens are numbers in this order, which pack shorter."""
    return np.argsort(-known, kind="stable")


def _opened(tokens, words):
    """A block's words, and its tokens as places of them, from what is stored."""
    word, known = words
    return ungapped(word), _often(signed(known))[signed(tokens)]


def _parted(bucket, buckets):
    """Places of each bucket's entries, in order; both asking and reading the answer go by this."""
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return [(k, order[cut[k] : cut[k + 1]]) for k in np.flatnonzero(np.diff(cut)).tolist()]


def _short(h):
    return h >> K.U(16)


def _named(short, frequent):
    """A frequent word's place among the frequent ones, any other word's own name: what is sent of pairs gets shorter.

    ``frequent`` holds the names of frequent words in order, with their places, and the names by place.
    """
    names, place, _ = frequent
    if not len(names):
        return short + RARE
    at = np.minimum(np.searchsorted(names, short), len(names) - 1)
    return np.where(names[at] == short, place[at].astype(K.U), short + RARE)


def _short_of(name, frequent):
    out = name - RARE
    known = name < RARE
    out[known] = frequent[2][signed(name[known])]
    return out


def _word_bucket(short, buckets):
    return (short % K.U(buckets)).astype(np.int64)


def _pairs(docs, local, words, frequent):
    """Distinct (context, word) pairs of a block as places of its words, by their names, the pair of each token, and whether it is trained on."""
    _, _, held, size = docs
    order = np.argsort(_named(_short(words), frequent), kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    local = place[local]
    before = np.empty_like(local)
    before[1:] = local[:-1]
    before[np.cumsum(signed(size)) - signed(size)] = place[np.searchsorted(words, BEGIN)]
    pair, which = np.unique(before * len(words) + local, return_inverse=True)
    return order[pair // len(words)], order[pair % len(words)], which, np.repeat(held == 0, signed(size))


def _pair_bucket(context, word, heavy, buckets):
    """Heavy contexts (sorted, with their numbers of parts) are dealt out by word."""
    short = _short(context)
    out = K.mix(short)
    if len(heavy[0]):
        at = np.minimum(np.searchsorted(heavy[0], short), len(heavy[0]) - 1)
        parts = np.where(heavy[0][at] == short, heavy[1][at], 1).astype(K.U)
        out = out + K.mix(_short(word) + K.U(1)) % parts
    return (out % K.U(buckets)).astype(np.int64)


# Seating --------------------------------------------------------------------------------------


def _log_gamma(x):
    """Logarithm of the gamma function of positive numbers."""
    low, x = np.zeros_like(x), x.copy()
    for _ in range(8):
        low, x = np.where(x < 8, low - np.log(x), low), np.where(x < 8, x + 1, x)
    r = 1 / (x * x)
    return low + (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r / 1188)))) / x


def _crossing(f, low, high):
    """Where falling functions cross zero between two positive bounds, by halving in logarithms."""
    low, high = np.log(low), np.log(high)
    for _ in range(50):
        middle = (low + high) / 2
        above = f(np.exp(middle)) > 0
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    return np.exp((low + high) / 2)


@cache
def _ways(d):
    """Logarithms of the generalised Stirling numbers of up to ``SMALL`` customers (rows) at 1, 2, ... tables (columns)."""
    out = np.full((SMALL + 1, SMALL), -np.inf)
    out[1, 0] = 0
    for c in range(2, SMALL + 1):
        t = np.arange(1, c)
        out[c, : c - 1] = np.log(c - 1 - d * t) + out[c - 1, : c - 1]
        out[c, 1:c] = np.logaddexp(out[c, 1:c], out[c - 1, : c - 1])
    return out


def _log_ways(c, t, d):
    """Logarithms of the generalised Stirling numbers of any size, up to terms of ``c`` alone, times t! d^t.

    They are coefficients of z^c in (1 - (1 - z)^d)^t; the integral over z = exp(-s) goes through the saddle point, on a parabola around the
    cut where that is near it and on a straight line otherwise.
    """
    near = lambda s: np.log(-np.expm1(-s))
    s = _crossing(lambda s: np.log(t * d) + (d - 1) * near(s) - s - np.log(c * -np.expm1(d * near(s))), 1e-3 / c, np.full_like(c, 36.0))
    s = np.maximum(s, 8 / c)
    x, z = -np.expm1(-s), np.exp(-s)
    g = -np.expm1(d * np.log(x))
    mean = d * x ** (d - 1) * z / g
    curve = np.maximum(t * mean * (1 - mean + (1 - d) * z / x), 1e-6)
    u = (np.arange(NODES) + 0.5) / NODES
    line = np.minimum(math.pi, 10.3 / np.sqrt(curve))
    bow = np.maximum(np.minimum(5.2 / (s * np.sqrt(curve)), 8.3 / np.sqrt(c * s)), 6.4 / np.sqrt(c * s))
    along, rise = 1 + 1j * bow[:, None] * u, s > 0.5
    at = np.where(rise[:, None], s[:, None] + 1j * line[:, None] * u, s[:, None] * along**2)
    step = np.where(rise[:, None], 1j * line[:, None], 2j * s[:, None] * along * bow[:, None])
    top = t * np.log(g) + c * s
    value = np.exp(t[:, None] * np.log(-np.expm1(d * near(at))) + c[:, None] * at - top[:, None]) * step
    value = np.maximum(value.imag.mean(axis=1) / math.pi, 1e-300)
    return np.where(t == c, t * math.log(d), top + np.log(value))


class Reseated:
    """Draws the number of tables of each dish anew, for all its customers at once, given its constant weight ``a`` of a new table.

    Who sits with whom is summed over, so t tables of c customers have weight a^t S(c, t) with the generalised Stirling numbers S. Dishes of up to ``SMALL`` customers
    are drawn from all t; larger ones by Metropolis-Hastings steps from nearly the same distribution. Dishes lie by falling number of customers.
    """

    def __init__(self, customers, discount, rng):
        self.c, self.d, self.rng = customers, discount, rng
        self.large = int(np.searchsorted(-customers, -SMALL, "left"))
        self.last = None

    def __call__(self, a):
        return np.concatenate([self._far(a[: self.large]), *self._near(a)]).astype(np.int64)

    def _near(self, a):
        low, ways = self.large, _ways(self.d)
        while low < len(a):
            width = int(self.c[low])
            high = min(int(np.searchsorted(-self.c, -(width * 3 // 4), "right")), low + max(1, CELLS // width))
            w = ways[self.c[low:high], :width]
            w += np.log(a[low:high, None]) * np.arange(1, width + 1)
            w -= w.max(axis=1, keepdims=True)
            np.exp(w, out=w)
            np.cumsum(w, axis=1, out=w)
            yield 1 + (w < self.rng.random((high - low, 1)) * w[:, -1:]).sum(axis=1)
            low = high

    def _far(self, a):
        out, step = np.empty(len(a)), CELLS // (4 * NODES)
        for low in range(0, len(a), step):
            at = slice(low, min(low + step, len(a)))
            out[at] = self._drawn(self.c[at].astype(float), a[at] / self.d, None if self.last is None else self.last[at])
        self.last = out
        return out

    def _drawn(self, c, rate, t):
        d = self.d
        near = lambda s: np.log(-np.expm1(-s))
        s = _crossing(lambda s: np.log(rate * d) + (d - 1) * near(s) - s - np.log(c), np.full_like(c, 1e-40), np.full_like(c, 700.0))
        p = np.clip(rate * -np.expm1(d * near(s)) / c, 1e-12, 1 - 1e-12)

        def weight(t):
            """Of t tables, over the probability with which they are proposed."""
            return t * np.log(rate) - np.log(t) + _log_ways(c, t, d) + _log_gamma(c - t + 1) - (t - 1) * np.log(p) - (c - t) * np.log1p(-p)

        proposed = lambda: 1.0 + self.rng.binomial(c.astype(np.int64) - 1, p)
        t = proposed() if t is None else t
        w = weight(t)
        for _ in range(PROPOSALS):
            other = proposed()
            w_other = weight(other)
            taken = np.log(self.rng.random(len(c))) < w_other - w
            t, w = np.where(taken, other, t), np.where(taken, w_other, w)
        return t


def seated(customers, discount, weight, rng, burn=BURN, samples=SAMPLES):
    """Tables of every dish in each of the samples; ``weight(tables, places)`` for the dishes at these places.

    A dish without customers has no table and one with a single customer has one, so only the others are sampled. Each sweep reseats all their customers.
    """
    fixed = np.minimum(customers, 1)
    many = np.flatnonzero(customers > 1)
    many = many[np.argsort(-customers[many], kind="stable")]
    if not len(many):
        return [fixed] * samples
    draw, t = Reseated(customers[many], discount, rng), np.ones(len(many))
    # For a constant weight a, a dish of many customers has 1 + Poisson(a / d) tables in the posterior, nearly.
    for _ in range(3):
        t = np.minimum(customers[many], 1 + weight(t, many) / discount)
    out = []
    for k in range(burn + samples):
        t = draw(weight(t, many))
        if k >= burn:
            now = fixed.copy()
            now[many] = t
            out.append(now)
    return out


def _seats(alone, place, customers, share, base, rng):
    """Tables of dishes with several customers, of the restaurants at ``place``, given the parent's probability of each dish.

    Given a gamma variable of shape strength / d + tables for each restaurant, its dishes are independent of each other.
    """
    d, strength = CONTEXT

    def weight(t, at):
        tables = alone + np.bincount(place[at], weights=t, minlength=len(alone))
        return d * rng.gamma(strength / d + tables * share)[place[at]] * base[at]

    return seated(customers, d, weight, rng, WITHIN - 1, 1)[0]


# Stages ---------------------------------------------------------------------------------------


def _rows(rows, **types):
    return pa.Table.from_pydict({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(types.items())})


def _sum_words(rows):
    """Distinct words of packed (gaps of words, counts) with their sums."""
    parts = [unpack(r) for r in rows]
    word, which = np.unique(np.concatenate([ungapped(p[0]) for p in parts]), return_inverse=True)
    n = np.bincount(which, weights=np.concatenate([signed(p[1]) for p in parts]), minlength=len(word)).astype(np.int64)
    return word, n, which, [len(p[0]) for p in parts]


# Kinds of rows: what blocks ask for, the state of a bucket, tables of pairs seen once and of a round, and the parent's answer.
WORDS, PAIRS, STATE, ONCE, ONCE_OWN, TABLES, OWN, SEATS, BACK = range(9)


def _parent(customers, tables, c0, t0, uniform):
    """Probabilities in the parent of words with these customers and tables, of ``c0`` and ``t0`` in all."""
    d, strength = PARENT
    return (customers - d * tables) / (strength + c0) + (strength + d * t0) / (strength + c0) * uniform


def _back(round_, t0, uniform):
    """Seats the parent by the tables sent to a bucket of words and tells each sender its words' customers and tables."""
    d, strength = PARENT

    def run(key, group):
        bucket = key[0].as_py()
        kinds, sender = group.column("kind").to_pylist(), group.column("block").to_pylist()
        parts = [unpack(x) for x in group.column("data").to_pylist()]
        names = [ungapped(p[0]) for p in parts]
        word, which = np.unique(np.concatenate(names), return_inverse=True)
        sent = np.bincount(which, weights=np.concatenate([signed(p[1]) for p in parts]), minlength=len(word)).astype(np.int64)
        new = (strength + d * t0) * uniform
        tables = seated(sent, d, lambda t, at: np.full(len(at), new), np.random.default_rng([SEED, 2, bucket, round_]), 1, 1)[0]
        out, low = [(None, round_, None, bucket, None, [int(sent.sum()), int(tables.sum())])], 0
        for kind, asker, name in zip(kinds, sender, names):
            at = which[low : low + len(name)]
            low += len(name)
            if kind == TABLES:
                out.append((BACK, round_, bucket, asker, pack(sent[at], tables[at]), None))
        return _rows(out, kind=pa.int32(), round=pa.int32(), block=pa.int64(), bucket=pa.int64(), data=pa.binary(), sums=pa.list_(pa.int64()))

    return run


def fit_and_score(docs: DataFrame, learn: Column) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities of the whole text)."""
    spark = docs.sparkSession
    context = spark.sparkContext
    held = F.coalesce(~learn, F.lit(False)).alias("held")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, text_of().alias("t"))
    blocks = written(rows.mapInArrow(_blocks, "block long, n long, n_words long, docs binary, tokens binary, words binary"), "lm-blocks")
    n_tokens, n_words = (x or 0 for x in blocks.agg(F.sum("n"), F.sum("n_words")).first())
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_tokens / BUCKET))
    word_buckets = max(1, math.ceil(n_words / WORDS_BUCKET))

    def ask_words(batches):
        for batch in batches:
            for block, words in zip(batch.column("block").to_pylist(), batch.column("words")):
                word, n = unpack(words.as_py())
                word = ungapped(word)
                out = [(k, block, pack(gaps(word[at]), n[at])) for k, at in _parted(_word_bucket(_short(word), word_buckets), word_buckets)]
                yield _rows(out, bucket=pa.int64(), block=pa.int64(), data=pa.binary()).combine_chunks().to_batches()[0]

    asked = blocks.select("block", "words").mapInArrow(ask_words, "bucket long, block long, data binary")

    def count_words(key, group):
        word, n, _, _ = _sum_words(group.column("data").to_pylist())
        return _rows([(pack(gaps(word), n), int(n.sum()), int((n > 0).sum()))], data=pa.binary(), tokens=pa.int64(), types=pa.int64())

    counted = written(asked.groupBy("bucket").applyInArrow(count_words, "data binary, tokens long, types long"), "lm-counts")
    total, types = (x or 0 for x in counted.agg(F.sum("tokens"), F.sum("types")).first())

    def frequent(batches):
        for batch in batches:
            for data in batch.column("data"):
                word, n = unpack(data.as_py())
                word = ungapped(word)
                at = np.flatnonzero(signed(n) * HEAD >= max(total, 1))
                yield pa.RecordBatch.from_arrays([pa.array(signed(word[at])), pa.array(signed(n[at]))], ["w", "n"])

    # Words with a millionth of all tokens: a million at most.
    head = counted.select("data").mapInArrow(frequent, "w long, n long").toArrow()
    word, n = head.column("w").to_numpy().astype(np.int64).view(K.U), head.column("n").to_numpy().astype(np.int64)
    order = np.lexsort((_short(word), -n))
    word, n = word[order], n[order]
    by_name = np.argsort(_short(word), kind="stable")
    d0, s0 = PARENT
    uniform = 1.0 / (types + 1)
    rest = max(total - int(n.sum()), 0) / max(types - len(n), 1)
    known = lambda c: (np.maximum(c - d0, 0) + (s0 + d0 * types) * uniform) / (s0 + total)
    # A context follows every training token but the ends; the beginning is the context of as many words as there are ends.
    many = np.concatenate([n, n[word == END]]) * 2 * buckets // max(total, 1)
    heavy = np.concatenate([_short(word), _short(np.full((word == END).sum(), BEGIN))])
    heavy, many = heavy[many > 0], many[many > 0] + 1
    order = np.argsort(heavy)
    names = _short(word)[by_name], by_name, _short(word)
    shared = context.broadcast(((heavy[order], many[order]), names, known(n), float(known(np.array(rest)))))

    def ask_pairs(batches):
        for batch in batches:
            for block, *data in zip(*(batch.column(c).to_pylist() for c in ("block", "docs", "tokens", "words"))):
                docs, (tokens,), words = map(unpack, data)
                words, local = _opened(tokens, words)
                left, right, which, trained = _pairs(docs, local, words, shared.value[1])
                n = np.bincount(which[trained], minlength=len(left))
                out = []
                for k, at in _parted(_pair_bucket(words[left], words[right], shared.value[0], buckets), buckets):
                    first = np.flatnonzero(np.concatenate([[True], np.diff(left[at]) != 0]))
                    runs = np.diff(np.concatenate([first, [len(at)]]))
                    names = [_named(_short(words[x]), shared.value[1]) for x in (left[at[first]], right[at])]
                    out.append((k, block, pack(gaps(names[0]), runs, gaps(names[1], first), n[at])))
                yield _rows(out, bucket=pa.int64(), block=pa.int64(), data=pa.binary()).combine_chunks().to_batches()[0]

    def split(who):
        heavy, many = shared.value[0]
        if not len(heavy):
            return np.ones(len(who))
        at = np.minimum(np.searchsorted(heavy, who), len(heavy) - 1)
        return np.where(heavy[at] == who, many[at], 1).astype(float)

    def names_of(name):
        return _short_of(name, shared.value[1])

    def to_words(kind, round_, bucket, name, tables):
        """Rows to the buckets of these words (sorted names), each with the number of tables."""
        return [(kind, round_, bucket, k, pack(gaps(name[at]), tables[at])) for k, at in _parted(_word_bucket(names_of(name), word_buckets), word_buckets)]

    def sent_on(round_, bucket, state, base):
        """Rows of a round: the tables of dishes, and in sampling rounds those of contexts too and, for the bucket itself, of all pairs."""
        who, alone, dish, place, where, customers = state
        rng = np.random.default_rng([SEED, 1, bucket, round_])
        tables = _seats(alone, place, customers, split(names_of(who)), base, rng)
        sent = np.bincount(where, weights=tables, minlength=len(dish)).astype(np.int64)
        out = to_words(TABLES, round_, bucket, dish, sent)
        if round_ >= BURN:
            own = np.bincount(place, weights=tables, minlength=len(who)).astype(np.int64)
            out += to_words(OWN, round_, bucket, who, own)
            out.append((SEATS, round_, None, bucket, pack(tables, *[customers] * (round_ == BURN))))
        return out

    def start(key, group):
        bucket = key[0].as_py()
        _, frequent, base, rare = shared.value
        parts = [unpack(x) for x in group.column("data").to_pylist()]
        sizes = [len(p[2]) for p in parts]
        n = np.concatenate([signed(p[3]) for p in parts])
        lefts, left = np.unique(np.concatenate([ungapped(p[0]) for p in parts]), return_inverse=True)
        left = np.repeat(left, np.concatenate([signed(p[1]) for p in parts]))
        rights, right = np.unique(np.concatenate([ungapped(p[2], signed(p[1])) for p in parts]), return_inverse=True)
        _, first, which = np.unique(left * len(rights) + right, return_index=True, return_inverse=True)
        left, right = lefts[left[first]], rights[right[first]]
        n = np.bincount(which, weights=n, minlength=len(first)).astype(np.int64)
        once, several = np.flatnonzero(n == 1), np.flatnonzero(n > 1)
        number = n.copy()  # 0 and 1 say that often, others where a pair lies among those seen more often
        number[several] = np.arange(2, len(several) + 2)
        out, low = [], 0
        for block, size in zip(group.column("block").to_pylist(), sizes):
            at = which[low : low + size]
            low += size
            asked = number[at]
            out.append((PAIRS, 0, block, bucket, pack(np.minimum(asked, 2), gaps(asked[asked > 1]))))
        for kind, names in ((ONCE_OWN, left[once]), (ONCE, right[once])):
            name, tables = np.unique(names, return_counts=True)
            out += to_words(kind, 0, bucket, name, tables)
        if len(several):
            who, place = np.unique(left[several], return_inverse=True)
            dish, where = np.unique(right[several], return_inverse=True)
            at = np.searchsorted(who, left[once])
            ok = who[np.minimum(at, len(who) - 1)] == left[once]
            alone = np.bincount(at[ok], minlength=len(who))  # tables that never change
            p = np.full(len(dish), rare)
            p[dish < RARE] = base[signed(dish[dish < RARE])]
            state = who, alone, dish, place, where, n[several]
            runs = np.bincount(place)
            state_of = pack(gaps(who), alone, gaps(dish), runs, gaps(where, np.cumsum(runs) - runs), n[several])
            out.append((STATE, 0, None, bucket, state_of))
            out += sent_on(0, bucket, state, p[where])
        return _rows(out, kind=pa.int32(), round=pa.int32(), block=pa.int64(), bucket=pa.int64(), data=pa.binary())

    def again(i, c0, t0):
        def run(key, group):
            told = dict(zip(zip(*(group.column(c).to_pylist() for c in ("kind", "block"))), group.column("data").to_pylist()))
            who, alone, dish, runs, where, customers = unpack(told[STATE, None])
            place = np.repeat(np.arange(len(runs)), signed(runs))
            state = ungapped(who), signed(alone), ungapped(dish), place, signed(ungapped(where, signed(runs))), signed(customers)
            p = np.zeros(len(state[2]))
            for k, at in _parted(_word_bucket(names_of(state[2]), word_buckets), word_buckets):
                p[at] = _parent(*map(signed, unpack(told[BACK, k])), c0, t0, uniform)
            out = sent_on(i, key[0].as_py(), state, p[state[4]])
            return _rows(out, kind=pa.int32(), round=pa.int32(), block=pa.int64(), bucket=pa.int64(), data=pa.binary())

        return run

    pairs = blocks.select("block", "docs", "tokens", "words").mapInArrow(ask_pairs, "bucket long, block long, data binary")
    schema = "kind int, round int, block long, bucket long, data binary"
    seats = written(pairs.groupBy("bucket").applyInArrow(start, schema), "lm-seats", "kind")

    def add_once(key, group):
        (kind, bucket), parts = [x.as_py() for x in key], [unpack(x) for x in group.column("data").to_pylist()]
        name, which = np.unique(np.concatenate([ungapped(p[0]) for p in parts]), return_inverse=True)
        tables = np.bincount(which, weights=np.concatenate([signed(p[1]) for p in parts])).astype(np.int64)
        out = [(kind, 0, None, bucket, pack(gaps(name), tables))]
        return _rows(out, kind=pa.int32(), round=pa.int32(), block=pa.int64(), bucket=pa.int64(), data=pa.binary())

    fixed = seats.where(F.col("kind").isin(ONCE, ONCE_OWN)).groupBy("kind", "bucket").applyInArrow(add_once, schema)
    fixed = written(fixed, "lm-once", "kind")
    once = fixed.where(F.col("kind") == ONCE)
    states = seats.where(F.col("kind") == STATE)
    rounds = [seats.where(F.col("kind").isin(TABLES, OWN, SEATS))]
    t0 = float(types)
    for i in range(1, BURN + SAMPLES):
        tables = once.unionByName(rounds[-1].where(F.col("kind") == TABLES))
        schema_back = "kind int, round int, block long, bucket long, data binary, sums array<long>"
        back = written(tables.groupBy("bucket").applyInArrow(_back(i, t0, uniform), schema_back), "lm-back")
        c0, t0 = (float(x or 0) for x in back.where("sums IS NOT NULL").agg(*[F.sum(F.get("sums", F.lit(k))) for k in (0, 1)]).first())

        both = states.unionByName(back.where(F.col("kind") == BACK).drop("sums"))
        rounds.append(written(both.groupBy("bucket").applyInArrow(again(i, c0, t0), schema), "lm-round", "kind"))

    def totals(key, group):
        kinds, data = group.column("kind").to_pylist(), group.column("data").to_pylist()
        drawn = [unpack(x) for k, x in zip(kinds, data) if k == SEATS]
        customers = [signed(x[1]) for x in drawn if len(x) > 1]  # told once
        n = np.concatenate([[0, 1], *customers])
        total = np.concatenate([[0, SAMPLES], sum(signed(x[0]) for x in drawn)]) if drawn else np.array([0, SAMPLES])
        out = []
        for kind, block, x in zip(kinds, group.column("block").to_pylist(), data):
            if kind == PAIRS:
                number, late = unpack(x)
                number[number > 1] = ungapped(late)
                number = signed(number)
                out.append((block, key[0].as_py(), pack(n[number], total[number])))
        return _rows(out, block=pa.int64(), bucket=pa.int64(), data=pa.binary())

    drawn = reduce(DataFrame.unionByName, rounds[BURN:])
    counted_pairs = seats.where(F.col("kind") == PAIRS).unionByName(drawn.where(F.col("kind") == SEATS))
    counted_pairs = counted_pairs.groupBy("bucket").applyInArrow(totals, "block long, bucket long, data binary")

    def seat_parent(key, group):
        bucket = key[0].as_py()
        kinds, data = group.column("kind").to_pylist(), group.column("data").to_pylist()
        word, n, which, sizes = _sum_words([x for k, x in zip(kinds, data) if k == WORDS])
        short = _short(word)
        own, sent = np.zeros((SAMPLES, len(word)), np.int64), np.zeros((SAMPLES, len(word)), np.int64)
        for kind, round_, x in zip(kinds, group.column("round").to_pylist(), data):
            if kind != WORDS:
                name, tables = unpack(x)
                at = np.searchsorted(short, names_of(ungapped(name)))
                of = slice(None) if kind in (ONCE, ONCE_OWN) else round_ - BURN
                (own if kind in (OWN, ONCE_OWN) else sent)[of, at] += signed(tables)
        rng = np.random.default_rng([SEED, 2, bucket])
        new = (s0 + d0 * t0) * uniform
        tables = [seated(sent[s], d0, lambda t, at: np.full(len(at), new), rng, 1, 1)[0] for s in range(SAMPLES)]
        columns, low, out = [n, *own, *sent, *tables], 0, []
        for block, size in zip((b for k, b in zip(kinds, group.column("block").to_pylist()) if k == WORDS), sizes):
            at = which[low : low + size]
            low += size
            out.append((block, bucket, pack(*[c[at] for c in columns]), None))
        out.append((None, bucket, None, [int(x.sum()) for x in (*sent, *tables)]))
        return _rows(out, block=pa.int64(), bucket=pa.int64(), data=pa.binary(), sums=pa.list_(pa.int64()))

    ask = asked.select(F.lit(WORDS).alias("kind"), F.lit(0).alias("round"), "block", "bucket", "data")
    ask = ask.unionByName(fixed).unionByName(drawn.where(F.col("kind").isin(TABLES, OWN)))
    schema = "block long, bucket long, data binary, sums array<long>"
    answers = written(ask.groupBy("bucket").applyInArrow(seat_parent, schema), "lm-answers")
    sums = answers.where("sums IS NOT NULL").agg(*[F.sum(F.get("sums", F.lit(i))) for i in range(2 * SAMPLES)]).first()
    c0s, t0s = np.array([x or 0 for x in sums[:SAMPLES]], float), np.array([x or 0 for x in sums[SAMPLES:]], float)
    heavy = shared

    def score(key, group):
        kinds, buckets_of = group.column("kind").to_pylist(), group.column("bucket").to_pylist()
        data = group.column("data").to_pylist()
        (i,) = (i for i, k in enumerate(kinds) if k == 2)
        docs, (tokens,), words = (unpack(group.column(c)[i].as_py()) for c in ("docs", "tokens", "words"))
        ids, missing, held, size = docs
        words, local = _opened(tokens, words)
        left, right, which, _ = _pairs(docs, local, words, heavy.value[1])
        answer = {(k, b): x for k, b, x in zip(kinds, buckets_of, data)}
        facts = np.zeros((1 + 3 * SAMPLES, len(words)), dtype=np.int64)
        for b, at in _parted(_word_bucket(_short(words), word_buckets), word_buckets):
            facts[:, at] = [signed(x) for x in unpack(answer[1, b])]
        count, tables = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
        for b, at in _parted(_pair_bucket(words[left], words[right], heavy.value[0], buckets), buckets):
            count[at], tables[at] = (signed(x) for x in unpack(answer[0, b]))
        n, own, sent, seats = facts[0], facts[1 : 1 + SAMPLES], facts[1 + SAMPLES : 1 + 2 * SAMPLES], facts[1 + 2 * SAMPLES :]
        customers = n.copy()
        customers[np.searchsorted(words, BEGIN)] = n[np.searchsorted(words, END)]
        d, strength = CONTEXT
        p = (count - d * tables / SAMPLES) / (strength + customers[left])
        for s in range(SAMPLES):
            parent = _parent(sent[s], seats[s], c0s[s], t0s[s], uniform)
            new = (strength + d * own[s]) / (strength + customers)
            p += new[left] * parent[right] / SAMPLES
        first = np.cumsum(signed(size)) - signed(size)
        base = np.log10((n + 1) / (total + types + 1))
        per_doc = lambda x: np.add.reduceat(x, first)
        return pa.Table.from_arrays(
            [
                pa.array(signed(ids), pa.int64(), mask=missing != 0), pa.array(held != 0), pa.array(signed(size)),
                pa.array(per_doc((n[local] > 0).astype(np.int64))), pa.array(np.full(len(ids), total, dtype=np.int64)),
                pa.array(per_doc(base[local])), pa.array(per_doc(np.log10(p)[which])),
            ],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    none = [F.lit(None).cast("binary").alias(c) for c in ("docs", "tokens", "words")]
    told = counted_pairs.select("block", F.lit(0).alias("kind"), "bucket", "data", *none)
    told = told.unionByName(answers.where("block IS NOT NULL").select("block", F.lit(1).alias("kind"), "bucket", "data", *none))
    own = blocks.select("block", F.lit(2).alias("kind"), F.lit(0).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("data"), "docs", "tokens", "words")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return told.unionByName(own).groupBy("block").applyInArrow(score, schema)


def perplexity(scores: DataFrame, of: str = "score") -> Column:
    """Perplexity per token of scored rows, for use in an aggregation."""
    return F.pow(F.lit(10.0), -F.sum(scores[of]) / F.sum(scores["n_tokens"]))
