"""Language identification in two steps: the family first, then the language within the family.

Features are counts of hashed byte 1- to 4-grams of the lower-cased whole text, as square roots of shares. The family
is decided by linear support vector machines, one against one, and so is the language among the family's
languages: each pair of classes has its machine, the class with most votes wins, the sum of margins breaks
ties. A family of one language needs no second step.

Machines are fitted on at most ``PER_LANGUAGE`` documents of each language, those with the smallest hashes of
doc_id in each of ``SALTS`` hash classes, so the choice depends neither on partitions nor on order; of a doc_id with several
languages the first by alphabet counts. Each pair's machine is fitted in a task of its own from the features of its two classes, and only weights reach
the driver. All languages take part: more than ``ALONE`` without a known family are gathered in families of about the
square root of their number, so that pairs stay few. ``lang``, ``source`` and ``doc_id`` are
never inputs of a prediction. Texts that are null or without a letter (Unicode category L) are ``und`` with score 0; without any
learned language all texts are. One learned language gives score 1. Rows that repeat are predicted one by one; a null doc_id is kept.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barscope.llm import kernels as K
from barscope.llm.common import sifted, text_of, written

PER_LANGUAGE = 320
SALTS = 64
BITS = 12
DIMENSIONS = 1 << BITS
ALONE = 16
TOP = ""  # the step between families
SHARPNESS = 4.0

# Language families by code; other codes are families of their own.
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fy lb".split(),
    "romance": "fr es pt it ro ca gl oc".split(),
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk ky uz tt".split(),
    "indo-aryan": "hi bn mr ne gu pa ur".split(),
    "semitic": "ar he mt am".split(),
    "sinitic": "zh yue wuu".split(),
}


def family_of(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang.lower().split("-")[0] in codes), f"only {lang}")


def families_of(langs: list[str]) -> dict[str, str]:
    """The family of each language; many without a known one share families in order of their codes."""
    out = {v: family_of(v) for v in langs}
    rest = sorted(v for v, f in out.items() if f not in FAMILIES)
    if len(rest) > ALONE:
        size = math.ceil(math.sqrt(len(rest)))
        out |= {v: f"others {k // size}" for k, v in enumerate(rest)}
    return out


def features(data, offsets):
    """One row per text: square roots of the shares of hashed 1- to 4-grams of bytes."""
    out = np.zeros((len(offsets) - 1, DIMENSIONS), dtype=np.float32)
    for i in range(len(offsets) - 1):
        low = K.LOWERED[data[offsets[i] : offsets[i + 1]]].astype(np.uint32)
        for at in range(0, len(low), 1 << 20):  # very long texts in blocks
            b = low[at : at + (1 << 20) + 3]
            gram = np.zeros(len(b), dtype=np.uint32)
            for k in range(4):
                gram = gram[: len(b) - k] * np.uint32(257) + b[k:] + np.uint32(k + 1)
                slot = (gram * np.uint32(2654435761)) >> np.uint32(32 - BITS)
                out[i] += np.bincount(slot[: 1 << 20], minlength=DIMENSIONS)
    total = out.sum(axis=1, keepdims=True)
    return np.sqrt(out / np.maximum(total, 1))


def machine(gram, sign, rounds=200, c=100.0):
    """Weights per example of a linear support vector machine with squared hinge loss, by Nesterov's method.

    ``gram`` holds the examples' inner products. Both classes weigh the same.
    """
    share = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum())).astype(np.float32)
    step = np.float32(1.0 / (1 / c + 4.0))
    w = z = np.zeros(len(sign), dtype=np.float32)
    for k in range(rounds):
        slack = np.maximum(0, 1 - sign * (gram @ z))
        new = z - step * (z / np.float32(c) - 2 * share * slack * sign)
        w, z = new, new + np.float32(k / (k + 3)) * (new - w)
    return w


def fitted(x, sign):
    """Weights of the features, and the constant, of the machine between examples of sign 1 and -1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    return x.T @ machine(x @ x.T, sign)


class Pairwise:
    """One machine for each pair of classes; ``weights`` holds those of the classes' numbers (a, b), a < b."""

    def __init__(self, classes, weights):
        self.classes = classes
        self.pairs = list(combinations(range(len(classes)), 2))
        self.w = np.array([weights[p] for p in self.pairs], dtype=np.float32).reshape(-1, DIMENSIONS + 1).T

    def predict(self, x):
        """Class numbers, and the share of confidence of the chosen class against its closest rival."""
        n = len(self.classes)
        if n == 1:
            return np.zeros(len(x), dtype=int), np.ones(len(x))
        margin = x @ self.w[:-1] + self.w[-1]
        margin *= SHARPNESS
        votes = np.zeros((len(x), n))
        worst = np.full((len(x), n), np.inf)
        for j, (a, b) in enumerate(self.pairs):
            m = margin[:, j]
            votes[:, a] += (m > 0) + 1e-3 * np.tanh(m)
            votes[:, b] += (m <= 0) - 1e-3 * np.tanh(m)
            worst[:, a], worst[:, b] = np.minimum(worst[:, a], m), np.minimum(worst[:, b], -m)
        best = votes.argmax(axis=1)
        return best, 1 / (1 + np.exp(-2 * np.clip(worst[np.arange(len(x)), best], -30, 30)))


class Model:
    def __init__(self, steps):
        """steps: machines by family, and those between families as ``TOP``."""
        self.families = steps.get(TOP)
        self.within = steps

    def predict(self, x):
        if self.families is None:
            return ["und"] * len(x), np.zeros(len(x))
        family, sure = self.families.predict(x)
        langs = np.empty(len(x), dtype=object)
        for k, f in enumerate(self.families.classes):
            rows = np.flatnonzero(family == k)
            if len(rows):
                best, more = self.within[f].predict(x[rows])
                langs[rows] = np.array(self.within[f].classes, dtype=object)[best]
                sure[rows] *= more
        return list(langs), sure


def _vectors(batches):
    for batch in batches:
        for part, data, offsets in K.slices(batch):
            x = features(data, offsets).astype(np.float16)
            out = [part.column("lang"), part.column("h"), pa.array([v.tobytes() for v in x], pa.binary())]
            yield pa.RecordBatch.from_arrays(out, ["lang", "h", "x"])


def _pair(group: pa.Table) -> pa.Table:
    """The machine of one pair of classes: at most ``PER_LANGUAGE`` rows for each language of either."""
    group = group.sort_by([("h", "ascending"), ("lang", "ascending"), ("x", "ascending")])
    x = np.array([np.frombuffer(v.as_buffer(), np.float16) for v in group.column("x")], dtype=np.float32)
    w = fitted(x, group.column("sign").to_numpy().astype(np.float32))
    return group.select(["step", "a", "b"]).slice(0, 1).append_column("w", pa.array([w.astype("<f4").tobytes()], pa.binary()))


def fit(docs: DataFrame, learn: Column, per_language: int = PER_LANGUAGE) -> Model:
    """Fit on a bounded sample of the rows where ``learn`` holds: at most ``per_language`` texts of each language."""
    spark = docs.sparkSession
    ids = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    # The smallest hashes of each of 64 hash classes: bounded, and no language meets in one task.
    ids = ids.groupBy("doc_id").agg(F.min(F.col("lang").cast("string")).alias("lang"))
    ids = ids.withColumn("h", F.xxhash64("doc_id")).withColumn("salt", F.pmod("h", F.lit(SALTS)))
    place = F.row_number().over(Window.partitionBy("lang", "salt").orderBy("h", "doc_id"))
    ids = ids.withColumn("n", place).where(F.col("n") <= math.ceil(per_language / SALTS)).select("doc_id", "lang", "h")
    chosen = written(ids, "language-sample")
    sample = sifted(docs.select("doc_id", text_of().alias("t")), "doc_id", chosen).join(chosen, "doc_id").select("lang", "h", "t")
    vectors = written(sample.mapInArrow(_vectors, "lang string, h long, x binary"), "language-vectors")

    family = families_of([r["lang"] for r in vectors.select("lang").distinct().collect()])
    classes = {TOP: sorted(set(family.values()))} if family else {}
    classes |= {f: sorted(v for v in family if family[v] == f) for f in set(family.values())}
    roles = []  # a row for each language, pair and side: some 1.5 powers of the number of languages
    for step, names in classes.items():
        for a, b in combinations(range(len(names)), 2):
            sides = [(k, s) for k, s in ((a, 1), (b, -1))]
            roles += [(v, step, a, b, s) for k, s in sides for v in family if names[k] in (v, family[v]) and step in (TOP, family[v])]
    roles = spark.createDataFrame(roles, "lang string, step string, a int, b int, sign int")
    machines = vectors.join(roles, "lang").groupBy("step", "a", "b").applyInArrow(_pair, "step string, a int, b int, w binary")
    weights = {name: {} for name in classes}
    for r in machines.collect():
        weights[r["step"]][r["a"], r["b"]] = np.frombuffer(r["w"], "<f4")
    return Model({name: Pairwise(names, weights[name]) for name, names in classes.items()})


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import regex

        letter = regex.compile(r"\p{L}").search
        for batch in batches:
            for part, data, offsets in K.slices(batch):
                langs, sure = shared.value.predict(features(data, offsets))
                texts = part.column("t").to_pylist()
                none = [letter(t) is None for t in texts]
                langs = ["und" if n else v for n, v in zip(none, langs)]
                sure = np.where(none, 0.0, sure)
                out = [part.column("doc_id"), pa.array(langs, pa.string()), pa.array(sure, pa.float64())]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("t"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
