"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Fitting takes the labelled rows that ``learn`` admits, at most ``PER_CLASS`` of each class (those with the smallest hashes of
doc_id in each of ``SALTS`` hash classes). Near copies in a class of this sample (``SIMILAR`` or more of their distinct five-word
shingles in common, compared exactly) count once, as a group of copies would make all its words look
telling. The cosine runs over all words of the sample. A word's weight is its idf, from the counts over all texts, times
its contrast: the log-likelihood ratio of its presence in the two classes. A word as common in both weighs nothing, a word of
one class the more the more texts have it; as cosines don't depend on the scale, neither does the size of the sample matter.

The index holds words of at least ``1 / DENSE`` of the examples as rows of a matrix, the others as lists of examples; a text's
similarities to all examples are a matrix product plus the sums of its lists, so the nearest ``NEIGHBOURS`` are exact.
Ties go to the example that comes first in the index. They vote with their similarity, weighted so that the
classes keep their shares among all labelled rows, with the overall share as one more vote. Scores are calibrated
by a logistic curve over the vote and the number of weighing words in the text, fitted to the examples' own
votes, each without itself and without its label in the contrasts. Evidence lists the closest. A text without any weighing word, an empty
or a null one gets the toxic share of the examples without any. Without a usable label scores are 0. Only the words of the bounded
sample, with their counts, reach the driver.
"""

from __future__ import annotations

import math
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barscope.llm import kernels as K
from barscope.llm.common import text_of

PER_CLASS = 5056
SALTS = 64
NEIGHBOURS = 25
EVIDENCE = 5
SIMILAR = 0.8
DENSE = 16
ROWS = 128
SLICE = 1 << 20  # bytes of text at a time; arrays over its words are some twenty times as large


def _vocabulary_counts(data, offsets, terms):
    """(text, term number, count) for the words of the sorted ``terms``, in order; some ``SLICE`` bytes of text are hashed at a time."""
    out, low = [(np.zeros(0, np.int64),) * 3], 0
    while low < len(offsets) - 1 and len(terms):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + SLICE, "right")) - 1)
        value, count, per = K.counted(*K.words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]))
        at = np.minimum(np.searchsorted(terms, value), len(terms) - 1)
        hit = terms[at] == value
        out.append((np.repeat(np.arange(low, high), np.diff(per))[hit], at[hit], count[hit]))
        low = high
    return tuple(map(np.concatenate, zip(*out)))


def _contrast(pos, neg, n_pos, n_neg):
    """Log-likelihood ratio of words in ``pos`` of ``n_pos`` toxic texts and ``neg`` of ``n_neg`` others."""
    n, total = pos + neg, max(n_pos + n_neg, 1)

    def cell(seen, expected):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0.0)

    ratio = cell(pos, n * n_pos / total) + cell(neg, n * n_neg / total)
    ratio += cell(n_pos - pos, (total - n) * n_pos / total) + cell(n_neg - neg, (total - n) * n_neg / total)
    return np.round(np.maximum(2 * ratio, 0.0), 9)


class Index:
    """Labelled examples over the words of all of them."""

    def __init__(self, terms, idf, rows, share, without_own=None):
        """rows: (doc_id, toxic, {term number: count} or arrays of both) in order; share: classes' weights;
        without_own: the terms' weights for an example of either class, its label left out."""
        self.terms, self.idf = terms, idf
        pairs = [r[2] if isinstance(r[2], tuple) else tuple(np.array(x, np.int64) for x in (list(r[2]), list(r[2].values()))) for r in rows]
        full = [(r, *p) for r, p in zip(rows, pairs) if len(p[0])]
        empty = [share[r[1]] * np.array([r[1], 1.0]) for r, p in zip(rows, pairs) if not len(p[0])]
        total = sum((share[r[1]] * np.array([r[1], 1.0]) for r in rows), np.zeros(2))
        self.prior = total[0] / total[1] if total[1] else 0.0
        none = sum(empty, np.zeros(2))
        self.without = (none[0] + self.prior) / (none[1] + 1)
        self.ids = np.array([r[0] for r, _, _ in full], dtype=np.int64)
        self.toxic = np.array([r[1] for r, _, _ in full], dtype=float)
        self.weight = np.array([share[r[1]] for r, _, _ in full], dtype=float)
        # Lists of examples, by term.
        term = np.concatenate([np.zeros(0, np.int32), *[t.astype(np.int32) for _, t, _ in full]])
        example = np.repeat(np.arange(len(full), dtype=np.int32), [len(t) for _, t, _ in full])
        w = (1 + np.log(np.concatenate([np.ones(0), *[c for _, _, c in full]]))) * idf[term]
        w /= np.maximum(np.sqrt(np.bincount(example, weights=w * w, minlength=len(full))), 1e-12)[example]
        order = np.argsort(term, kind="stable").astype(np.int32)
        self.example, self.w = example[order], w.astype(np.float32)[order]
        del example, w
        self.first = np.searchsorted(term[order], np.arange(len(terms) + 1))
        del term, order
        dense = np.flatnonzero(np.diff(self.first) * DENSE >= max(len(full), 1))
        self.row = np.full(len(terms), -1, dtype=np.int32)
        self.row[dense] = np.arange(len(dense))
        self._postings = None
        self.curve = np.array([1.0, 0.0, 0.0])
        self.calibrate([(i, t, c) for i, (_, t, c) in enumerate(full)], without_own or {0: idf, 1: idf})

    def __getstate__(self):
        return self.__dict__ | {"_postings": None}

    @property
    def postings(self):
        """Weights of the words of many examples, a row for each; made where it is used, as only the lists are sent."""
        if self._postings is None:
            dense = np.flatnonzero(self.row >= 0)
            out = np.zeros((len(dense), len(self.ids)), dtype=np.float32)
            for k, t in enumerate(dense):
                at = slice(self.first[t], self.first[t + 1])
                out[k, self.example[at]] = self.w[at]
            self._postings = out
        return self._postings

    def nearest_of(self, cut, terms, weights, k=NEIGHBOURS):
        """Numbers and similarities of the k nearest examples of each text; its terms lie from one ``cut`` to the next."""
        text = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
        norm = np.sqrt(np.bincount(text, weights=weights * weights, minlength=len(cut) - 1))
        weights = weights / np.maximum(norm, 1e-12)[text]
        row, n = self.row[terms], len(self.ids)
        for low in range(0, len(cut) - 1, ROWS):
            high = min(low + ROWS, len(cut) - 1)
            at = np.arange(cut[low], cut[high])
            at = at[row[at] >= 0]
            q = np.zeros((high - low, len(self.postings)), dtype=np.float32)
            q[text[at] - low, row[at]] = weights[at]
            for i, s in zip(range(low, high), q @ self.postings):
                some = np.arange(cut[i], cut[i + 1])
                some = some[(row[some] < 0) & (weights[some] > 0)]
                start, size = self.first[terms[some]], self.first[terms[some] + 1] - self.first[terms[some]]
                place = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
                s = s + np.bincount(self.example[place], weights=np.repeat(weights[some], size) * self.w[place], minlength=n)
                s = np.round(s, 6)
                best = np.flatnonzero((s >= np.partition(s, n - k)[n - k] if n > k else True) & (s > 0))
                best = best[np.lexsort((best, -s[best]))[:k]]
                yield best, s[best]

    def nearest(self, terms, counts, k=NEIGHBOURS):
        """Numbers and similarities of the k nearest examples that share a term."""
        terms = np.asarray(terms)
        return next(self.nearest_of(np.array([0, len(terms)]), terms, (1 + np.log(counts)) * self.idf[terms], k))

    def vote(self, best, sims):
        vote = sims * self.weight[best]
        return float((vote @ self.toxic[best] + self.prior) / (vote.sum() + 1))

    @staticmethod
    def _inputs(vote, n_terms):
        v = np.clip(vote, 1e-4, 1 - 1e-4)
        return np.array([np.log(v / (1 - v)), np.log(n_terms), 1.0])

    def calibrate(self, examples, idf):
        """Fit the logistic curve by Newton steps; examples are (number, terms, counts), idf the terms' weights for either class."""
        rows, y, w = [], [], []
        for low in range(0, len(examples), ROWS):
            part = examples[low : low + ROWS]
            weights = [(1 + np.log(c)) * idf[int(self.toxic[i])][t] for i, t, c in part]
            cut = np.concatenate([[0], np.cumsum([len(t) for _, t, _ in part])])
            found = self.nearest_of(cut, np.concatenate([t for _, t, _ in part]), np.concatenate(weights), NEIGHBOURS + 1)
            for (i, _, _), own, (best, sims) in zip(part, weights, found):
                other = best != i
                n_terms = np.count_nonzero(own)
                if n_terms:
                    rows.append(self._inputs(self.vote(best[other][:NEIGHBOURS], sims[other][:NEIGHBOURS]), n_terms))
                    y.append(self.toxic[i])
                    w.append(self.weight[i])
        x, y, w = np.array(rows).reshape(-1, 3), np.array(y), np.array(w)
        if len(y) < 20 or y.min() == y.max():
            return
        c = np.array([1.0, 0.0, 0.0])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
            grad = x.T @ (w * (p - y)) + 0.1 * (c - [1, 0, 0])
            c = c - np.linalg.solve((x.T * (w * p * (1 - p))) @ x + 0.1 * np.eye(3), grad)
        self.curve = c

    def scores(self, cut, terms, counts):
        """Score, evidence and its similarities of each text; its terms lie from one ``cut`` to the next."""
        weights = (1 + np.log(counts)) * self.idf[terms]
        some = np.concatenate([[0], np.cumsum(weights > 0)])[cut]
        n_terms = np.diff(some)
        for n, (best, sims) in zip(n_terms, self.nearest_of(cut, terms, weights)):
            if n:
                at = float(np.clip(self._inputs(self.vote(best, sims), n) @ self.curve, -30, 30))
                yield 1 / (1 + float(np.exp(-at))), self.ids[best[:EVIDENCE]].tolist(), sims[:EVIDENCE].tolist()
            else:
                yield float(self.without), [], []


def _sample(labels: DataFrame, learn: Column, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """Ids of the sample with their class, and the number of labelled rows of either class."""
    toxic = F.max((F.col("toxic") > 0).cast("int")).alias("toxic")
    ids = labels.where(learn & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    ids = ids.groupBy("doc_id").agg(toxic).withColumn("h", F.xxhash64("doc_id"))
    counts = {r["toxic"]: r["count"] for r in ids.groupBy("toxic").count().collect()}
    # The smallest hashes of each of 64 hash classes: bounded, and no class of labels meets in one task.
    place = F.row_number().over(Window.partitionBy("toxic", F.pmod("h", F.lit(SALTS))).orderBy("h", "doc_id"))
    ids = ids.withColumn("n", place).where(F.col("n") <= math.ceil(per_class / SALTS))
    return ids.select(F.col("doc_id").alias("__id"), "toxic", "h"), counts


def _shingle_sets(batches):
    """Distinct shingle hashes of each text, in order."""
    for batch in batches:
        for part, data, offsets in K.slices(batch, size=SLICE):
            s, first = K.shingles(*K.words(data, offsets))
            sets = pa.array([np.unique(s[a:b]).tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), part.column("h"), sets], ["doc_id", "toxic", "h", "shingles"])


def first_of_copies(sets: list[np.ndarray]) -> list[int]:
    """Places of the sets of shingles that no earlier kept one resembles by ``SIMILAR`` or more; empty ones stay.

    Sets so alike share one of the rarest shingles of each, those beyond the ``SIMILAR`` part of its size. Kept sets are
    looked up by these, and those found are compared in full.
    """
    value, count = np.unique(np.concatenate([np.zeros(0, K.U), *sets]), return_counts=True)
    # The kept sets of a shingle are a chain: its newest entry, and from each entry the one before.
    newest, before, owner, kept = np.full(len(value), -1, dtype=np.int32), array("i"), array("i"), []
    for i, s in enumerate(sets):
        at = np.searchsorted(value, s)
        rarest = at[np.lexsort((at, count[at]))][: len(s) - math.ceil(SIMILAR * len(s) - 1e-9) + 1]
        rarest = rarest[count[rarest] > 1]  # one that no other set has finds nothing
        found = set()
        for k in newest[rarest].tolist():
            while k >= 0:
                found.add(owner[k])
                k = before[k]
        for j in sorted(found):
            # Neither set repeats a shingle.
            both = len(np.intersect1d(s, sets[j], assume_unique=True)) if SIMILAR * len(s) <= len(sets[j]) + 1e-9 else 0
            if both >= SIMILAR * (len(s) + len(sets[j]) - both) - 1e-9:
                break
        else:
            kept.append(i)
            before.extend(newest[rarest].tolist())
            newest[rarest] = np.arange(len(owner), len(owner) + len(rarest))
            owner.extend([i] * len(rarest))
    return kept


def _first_rows(group: pa.Table) -> pa.Table:
    """The rows of a class without those that resemble an earlier kept one."""
    h, ids = (group.column(c).to_numpy() for c in ("h", "doc_id"))
    order = np.lexsort((ids, h))
    sets = [np.frombuffer(x.as_buffer(), K.U) for x in group.column("shingles")]
    kept = first_of_copies([sets[i] for i in order])
    return group.select(["doc_id", "toxic"]).take(pa.array(order[kept] if kept else [], pa.int64()))


def _without_copies(sample: DataFrame) -> list[tuple[int, int]]:
    """(doc_id, class) of the bounded sample, without texts that resemble an earlier kept one of their class.

    Each class is gone through in a task; only ids come back.
    """
    sets = sample.mapInArrow(_shingle_sets, "doc_id long, toxic int, h long, shingles binary")
    rows = sets.groupBy("toxic").applyInArrow(_first_rows, "doc_id long, toxic int").collect()
    return sorted({(r["doc_id"], r["toxic"]) for r in rows})


def _term_classes(batches):
    """Per part of a batch: word, and the numbers of texts of either class that have it."""
    for batch in batches:
        for part, data, offsets in K.slices(batch, size=SLICE):
            hashes, first = K.words(data, offsets)
            value, _, per = K.counted(hashes, first)
            doc = np.repeat(np.arange(len(per) - 1), np.diff(per))
            toxic = part.column("toxic").to_numpy(zero_copy_only=False)[doc]
            word, where = np.unique(value, return_inverse=True)
            n = np.bincount(where, minlength=len(word)).astype(np.int64)
            pos = np.bincount(where, weights=toxic, minlength=len(word)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(pos), pa.array(n - pos)], ["w", "pos", "neg"])


def fit(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = PER_CLASS) -> Index:
    context = docs.sparkSession.sparkContext
    ids, counts = _sample(labels, learn, per_class)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("t"))
    own = F.broadcast(ids)
    sample = texts.join(own, F.col("doc_id") == F.col("__id")).select("doc_id", "toxic", "h", "t")
    kept = _without_copies(sample)
    sizes = {c: sum(1 for r in kept if r[1] == c) for c in counts}
    mean = sum(counts.values()) / max(1, len(kept))
    share = {c: counts[c] / max(1, sizes[c]) / mean for c in counts}
    only = F.broadcast(docs.sparkSession.createDataFrame([r[:1] for r in kept], "__kept long"))
    sample = sample.join(only, F.col("doc_id") == F.col("__kept"), "left_semi")
    words = sample.mapInArrow(_term_classes, "w long, pos long, neg long")
    words = words.groupBy("w").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).toArrow()
    w, pos, neg = (words.column(c).to_numpy() for c in ("w", "pos", "neg"))
    order = np.argsort(w)
    terms, pos, neg = w[order].astype(K.U), pos[order], neg[order]
    shared = context.broadcast(terms)

    def frequencies(batches):
        df, rows = np.zeros(len(shared.value), dtype=np.int64), 0
        for batch in batches:
            for part, data, offsets in K.slices(batch):
                _, t, _ = _vocabulary_counts(data, offsets, shared.value)
                df += np.bincount(t, minlength=len(df))
                rows += part.num_rows
        t = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *t], pa.int64()), pa.array([rows, *df[t]], pa.int64())], ["t", "n"])

    found = texts.select("t").mapInArrow(frequencies, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(terms) + 1)  # the last is the number of texts
    df[found.column("t").to_numpy()] = found.column("n").to_numpy()
    idf = np.log((df[-1] + 1) / (df[:-1] + 1)) + 1

    def vectors(batches):
        for batch in batches:
            for part, data, offsets in K.slices(batch):
                d, t, c = _vocabulary_counts(data, offsets, shared.value)
                cut = np.searchsorted(d, np.arange(part.num_rows + 1))
                lists = [pa.array([v[a:b].astype("<i4").tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary()) for v in (t, c)]
                out = [part.column("doc_id"), part.column("toxic"), part.column("h"), *lists]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "toxic", "h", "terms", "counts"])

    schema = "doc_id long, toxic int, h long, terms binary, counts binary"
    found = sample.mapInArrow(vectors, schema).toArrow()
    ids, toxic, h = (found.column(c).to_pylist() for c in ("doc_id", "toxic", "h"))
    lists = [[x.as_buffer() for x in found.column(c)] for c in ("terms", "counts")]
    order = sorted(range(len(ids)), key=lambda i: (h[i], ids[i], bytes(lists[0][i])))
    del words, found
    rows = [(ids[i], toxic[i], tuple(np.frombuffer(x[i], "<i4") for x in lists)) for i in order]
    n_pos, n_neg = (sum(r[1] == c for r in rows) for c in (1, 0))
    without_own = {
        1: idf * _contrast(np.maximum(pos - 1, 0), neg, max(n_pos - 1, 0), n_neg),
        0: idf * _contrast(pos, np.maximum(neg - 1, 0), n_pos, max(n_neg - 1, 0)),
    }
    return Index(terms, idf * _contrast(pos, neg, n_pos, n_neg), rows, share, without_own)


def _scores(index, part, data, offsets):
    """Score and evidence of every text of a part of a batch."""
    d, t, c = _vocabulary_counts(data, offsets, index.terms)
    return list(index.scores(np.searchsorted(d, np.arange(part.num_rows + 1)), t, c))


def score(docs: DataFrame, index: Index) -> DataFrame:
    """Per row: doc_id, score, and the closest examples with their similarities as evidence."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        for batch in batches:
            for part, data, offsets in K.slices(batch):
                scores, ids, sims = zip(*_scores(shared.value, part, data, offsets))
                out = [
                    part.column("doc_id"), pa.array(scores, pa.float64()), pa.array(ids, pa.list_(pa.int64())),
                    pa.array(sims, pa.list_(pa.float64())),
                ]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "score", "evidence", "similarities"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("t"))
    return rows.mapInArrow(run, "doc_id long, score double, evidence array<long>, similarities array<double>")


def accepted(docs: DataFrame, index: Index, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        for batch in batches:
            for part, data, offsets in K.slices(batch, "__t"):
                kept = pa.array([s[0] < threshold for s in _scores(shared.value, part, data, offsets)], pa.bool_())
                yield part.filter(kept).drop_columns(["__t"])

    return docs.withColumn("__t", text_of()).mapInArrow(run, docs.schema)
