"""Language-model scores: base columns against a plain program, the sampler against exact posteriors, closed forms, perplexity."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from barscope.llm import lm
from barscope.llm.common import crc_mod
from barscope.llm.lm import fit_and_score, perplexity
from barscope.llm.q_lm import op13

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def plain(rows):
    """The base columns, token by token."""
    tokens = [(d, [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(LOWER)) if w] + [None]) for d, t in rows]
    count = collections.Counter(w for d, ws in tokens if not held(d) for w in ws)
    n, v = sum(count.values()), len(count)
    return sorted(
        ((d, held(d), len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), 6)) for d, ws in tokens),
        key=repr,
    )


def base(df):
    rows = df.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6)).collect()
    return sorted(map(tuple, rows), key=repr)


def test_base_columns_of_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    out = op13(spark, SF).persist()
    assert base(out) == plain(rows)
    scores = out.groupBy("held_out").agg(perplexity(out).alias("model"), perplexity(out, "base_score").alias("base")).collect()
    assert all(r.model < 0.5 * r.base for r in scores)
    assert out.where("score IS NULL OR score >= 0 OR isnan(score)").count() == 0


def test_odd_texts(make_docs, odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()] + [(40, "A\x0bb\x85c d É"), (41, "x" * 100_000)]
    out = fit_and_score(make_docs(rows), crc_mod(7) != 2)
    assert base(out) == plain(rows)


def test_empty_and_untrained_tables(make_docs, no_docs):
    assert fit_and_score(no_docs, crc_mod(7) != 2).collect() == []
    ids = [i for i in range(100) if held(i)][:2]
    rows = fit_and_score(make_docs([(ids[0], "a b"), (ids[1], None)]), crc_mod(7) != 2).collect()
    assert all(r.train_tokens == r.n_known == 0 and r.score == r.base_score == 0 for r in rows)


def test_closed_form_of_a_model_without_choices(make_docs):
    """With one training text of distinct words every seating is certain."""
    train = next(i for i in range(100) if not held(i))
    probe = [i for i in range(100) if held(i)]
    texts = ["a b", "b a", "", "zzz", "a zzz b", "c"]
    rows = {r.doc_id: r for r in fit_and_score(make_docs([(train, "a b"), *zip(probe, texts)]), crc_mod(7) != 2).collect()}
    (d, s), (d0, s0) = lm.CONTEXT, lm.PARENT
    follows = {"B": "a", "a": "b", "b": "E"}
    parent = lambda w: ((1 - d0 if w in "abE" else 0) + (s0 + d0 * 3) / 4) / (s0 + 3)

    def p(u, w):
        return ((1 - d) * (follows[u] == w) + (s + d) * parent(w)) / (s + 1) if u in follows else parent(w)

    for i, text in zip([train, *probe], ["a b", *texts]):
        words = ["B", *text.split(), "E"]
        assert rows[i].score == pytest.approx(sum(math.log10(p(u, w)) for u, w in zip(words, words[1:])), abs=1e-9)
    assert sum(p("a", w) for w in ("a", "b", "E", "zzz")) == pytest.approx(1)


@pytest.mark.parametrize("a", [0.05, 0.7, 4.0])
def test_sampler_has_the_exact_posterior(a):
    """With a constant weight of new tables, t tables of c customers have weight a^t S(c, t) (generalised Stirling numbers)."""
    d, n = 0.6, 60_000
    for c in (2, 3, 5):
        table = np.zeros((c + 1, c + 1))
        table[0, 0] = 1
        for i in range(1, c + 1):
            for t in range(1, i + 1):
                table[i, t] = table[i - 1, t - 1] + (i - 1 - d * t) * table[i - 1, t]
        exact = table[c] * a ** np.arange(c + 1)
        exact /= exact.sum()
        got = lm.seated(np.full(n, c), d, lambda t, at: np.full(len(t), a), np.random.default_rng(c), 6, 1)[0]
        assert np.abs(np.bincount(got, minlength=c + 1) / n - exact).max() < 0.01


def test_large_dishes_are_near_their_posterior():
    """The few sweeps used, against the exact mean of the number of tables."""
    d, top = 0.75, 400
    table = np.full((top + 1, top + 1), -np.inf)
    table[0, 0] = 0
    for i in range(1, top + 1):
        t = np.arange(1, i + 1)
        more = i - 1 - d * t
        table[i, t] = np.logaddexp(table[i - 1, t - 1], np.where(more > 0, np.log(np.maximum(more, 1e-9)) + table[i - 1, t], -np.inf))
    for c, a in ((400, 3.0), (400, 20.0), (100, 0.5), (90, 8.0), (40, 0.1), (20, 3.0)):
        weights = table[c, : c + 1] + np.arange(c + 1) * math.log(a)
        weights = np.exp(weights - weights.max())
        exact = (weights * np.arange(c + 1)).sum() / weights.sum()
        got = np.mean(lm.seated(np.full(3000, c), d, lambda t, at: np.full(len(t), a), np.random.default_rng(1), lm.BURN, lm.SAMPLES))
        assert abs(got - exact) < 0.06 * exact, (c, a, got, exact)


def test_many_buckets_and_split_contexts(spark, monkeypatch):
    """Dealing contexts out over many buckets changes samples, not the model."""
    one = op13(spark, SF).agg(F.sum("score"), F.sum("base_score")).first()
    monkeypatch.setattr(lm, "BUCKET", 2_000)
    many = op13(spark, SF).agg(F.sum("score"), F.sum("base_score")).first()
    assert many[1] == pytest.approx(one[1]) and many[0] == pytest.approx(one[0], rel=0.01)


def test_the_parent_acts_back_on_contexts(make_docs):
    """A word of 3,000 tokens that only follows one other is rare in the parent, and then opens one table, not some five."""
    train = [i for i in range(6000) if not held(i)]
    probe = [i for i in range(6000, 6100) if held(i)][:2]
    docs = [*zip(train, ["x w"] * 3000 + [f"a{i} b" for i in range(1000)]), *zip(probe, ("zzz w", "zzz b"))]
    score = {r.doc_id: r.score for r in fit_and_score(make_docs(docs), crc_mod(7) != 2).where(F.col("doc_id").isin(probe)).collect()}
    # After an unknown word the parent alone counts; nearly certain is that b has 1,000 customers there and w one.
    assert 10 ** (score[probe[1]] - score[probe[0]]) == pytest.approx(1000, rel=0.15)


def test_rows_of_rounds_do_not_grow_with_the_square_of_buckets(spark, monkeypatch):
    """Every bucket of pairs tells few buckets of words, however many buckets of pairs there are."""
    monkeypatch.setattr(lm, "BUCKET", 2_000)
    made, plain_written = [], lm.written

    def spied(df, name, *by):
        out = plain_written(df, name, *by)
        if name in ("lm-round", "lm-back"):
            made.append(out.count())
        return out

    monkeypatch.setattr(lm, "written", spied)
    op13(spark, SF)
    tokens = spark.read.parquet(f"{SF}/documents.parquet").agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0]
    assert len(made) == 2 * (lm.BURN + lm.SAMPLES - 1) and tokens > 30 * 2_000
    assert all(rows <= 4 * (tokens / 2_000 + 8) for rows in made), made


def test_gaps_of_runs():
    a = np.array([3, 9, 9, 1, 2**63, 5], dtype=lm.K.U)
    runs = np.array([3, 2, 1])
    for x in (lm.gaps(a, np.cumsum(runs) - runs), lm.unpack(lm.pack(lm.gaps(a, np.cumsum(runs) - runs)))[0]):
        assert (lm.ungapped(x, runs) == a).all()
    assert (lm.ungapped(lm.gaps(a)) == a).all() and len(lm.ungapped(lm.gaps(a[:0]), runs[:0])) == 0
    assert (lm.ungapped(lm.gaps(a.view(np.int64)).view(lm.K.U)) == a).all()


def test_names_of_frequent_words_go_by_frequency():
    short = np.array([50, 7, 90], dtype=lm.K.U)
    by_name = np.argsort(short, kind="stable")
    frequent = short[by_name], by_name, short
    x = np.array([7, 8, 90, 50], dtype=lm.K.U)
    name = lm._named(x, frequent)
    assert name.tolist() == [1, 8 + int(lm.RARE), 2, 0] and (lm._short_of(name, frequent) == x).all()
    none = np.zeros(0, lm.K.U), np.zeros(0, np.int64), np.zeros(0, lm.K.U)
    assert (lm._short_of(lm._named(x, none), none) == x).all()


def test_packing():
    for a in (np.zeros(0, np.int64), np.arange(5), np.array([0, 2**64 - 1, 7], dtype=lm.K.U), np.array([True, False])):
        (b,) = lm.unpack(lm.pack(a))
        assert (b == a.astype(lm.K.U)).all() and len(b) == len(a)
