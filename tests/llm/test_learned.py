"""BPE, WARC, toxicity and language against libraries, round trips and held-out rows."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barscope.llm import bpe, language, toxicity, warc
from barscope.llm.common import crc_mod
from barscope.llm.q_bpe import vocabulary

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def same(t, rows, reference):
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        want = reference.encode(t[r.doc_id] or "", add_special_tokens=False).ids
        assert ids == want and r.decoded == reference.decode(want, skip_special_tokens=False)


def test_bpe(make_docs, reference):
    r = random.Random(1)
    pieces = ["a", "ab", " ", "the", "\n", "é", "日本", "😀", "'s", "'ll", "23", "<|endoftext|>", " ", "  ", "!!", "\x00", "\x1c", " ", "aaaa", "_", "½"]
    texts = {i: "".join(r.choice(pieces) for _ in range(r.randrange(0, 40))) for i in range(400)}
    texts |= {1000: "", 1001: None, 1002: "a" * 5000, 1003: "ab" * 3000, 1004: "é" * 2000, 1005: " " * 3000}
    same(texts, bpe.encoded(make_docs(list(texts.items())), vocabulary()).collect(), reference)


def test_bpe_documents(spark, reference):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    same({r.doc_id: r.text for r in docs.collect()}, bpe.encoded(docs, vocabulary()).collect(), reference)


def test_bpe_takes_a_batch_in_parts():
    """Texts, ids and decoded texts of a whole batch are not held at once."""
    texts = [f"some text {i} " * 5000 for i in range(100)] + [None, "", "end"]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "t": pa.array([t or "" for t in texts])})
    out = list(bpe.encode_batch(bpe.Encoder(open(vocabulary(), encoding="utf-8").read()), batch))
    assert len(out) > 5 and max(part.column("decoded").nbytes for part in out) < 3 << 20
    assert pa.Table.from_batches(out).column("decoded").to_pylist() == [t or "" for t in texts]
    assert pa.Table.from_batches(out).column("doc_id").to_pylist() == list(range(len(texts)))


def test_bpe_odd(odd_docs, no_docs):
    rows = bpe.digests(bpe.encoded(odd_docs, vocabulary())).collect()
    assert len(rows) == 10 and {r.doc_id: r.n_tokens for r in rows}[1] == 0
    assert bpe.encoded(no_docs, vocabulary()).count() == 0


def test_pieces_forget_the_oldest(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_PIECES", 3)
    made = []
    known = bpe.Pieces(lambda b: made.append(b) or b)
    for p in "abcdabcdaefgh":
        assert known[p] == p.encode()
    assert len(known) <= 3 and len(known.older) <= 3 and len(made) >= 8


def page_rows(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id bigint, url string, html string, sha string, payload string")


def test_warc(spark):
    rows = [(i, f"http://a/{i}", f"<p>page {i % 7}</p>" + "x" * (i % 7)) for i in range(40)]
    rows += [(100, None, None), (101, "http://b/\r\nEvil: 1", ""), (102, "u", "é\r\n\r\nWARC/1.1 日本" * 2000), (None, "n", "<p>page 1</p>x"), (39, "again", rows[39][2])]
    got = warc.round_trip(page_rows(spark, rows)).collect()
    last = {}
    for p, _, t in rows:
        if p is not None:
            last[t or ""] = max(p, last.get(t or "", p))
    want = []
    for p, _, t in rows:
        raw = (t or "").encode()
        late = p is not None and p != last[t or ""]
        want.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if late else "response", last[t or ""] if late else None))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_warc_small_payloads_stay(spark):
    rows = [(1, "a", "same"), (2, "b", "same"), (3, "c", "longer one"), (4, "d", "longer one")]
    got = {r.page_id: r.record_type for r in warc.round_trip(page_rows(spark, rows), min_bytes=5).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    assert warc.round_trip(page_rows(spark, rows).limit(0)).count() == 0


def test_archive_has_its_dictionary():
    records = [warc.record(i, "http://a", (f"<html><body>{i * 7919} words that repeat in all pages" * 20).encode(), bytes(20), None) for i in range(300)]
    whole = warc.archive(records)
    assert whole[:4] == (0x184D2A5D).to_bytes(4, "little")
    assert [int(h["warc-record-id"].strip("<>").split(":")[2]) for h, _ in warc.records_of(whole)] == list(range(300))
    few = warc.archive(records[:2])
    assert len(list(warc.records_of(few))) == 2


def toxic_rows(n=600):
    r = random.Random(2)
    word = lambda: f"w{int(r.paretovariate(0.5)) % 3000}"
    rows = []
    for i in range(n):
        bad = i % 5 == 0
        t = [word() for _ in range(r.randrange(20, 120))] + ([r.choice(["idiot", "scum", "moron"]) for _ in range(3)] if bad else [])
        r.shuffle(t)
        rows.append((i, " ".join(t), int(bad)))
    return rows


def test_toxicity(spark, make_docs):
    rows = toxic_rows()
    docs = make_docs([r[:2] for r in rows] + [(5000, None), (5001, "")])
    labels = spark.createDataFrame([(r[0], 1, r[2]) for r in rows] + [(1, 1, None), (None, 1, 1), (0, 1, 1)], "doc_id long, quality int, toxic int")
    index = toxicity.fit(docs, labels, crc_mod(5) != 0)
    got = {r.doc_id: r for r in toxicity.score(docs, index).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert len(held) > 60 and all((got[r[0]].score >= 0.5) == bool(r[2]) for r in held)
    assert got[5000].score == got[5001].score < 0.5 and got[5000].evidence == []
    assert {r.doc_id for r in toxicity.accepted(docs, index).collect()} == {d for d, r in got.items() if r.score < 0.5}
    assert toxicity.accepted(docs, index).columns == docs.columns


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_toxic_documents_are_found_at_small_sizes(spark, sf):
    from barscope.llm.q_toxicity import op4

    labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet").select("doc_id", "toxic")
    rows = op4(spark, f"/root/testdata/{sf}").join(labels, "doc_id").collect()
    toxic, clean = [r for r in rows if r.toxic == 1], [r for r in rows if r.toxic == 0]
    assert len(toxic) > 10 and sum(r.predicted for r in toxic) >= 0.9 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)
    held = [r for r in toxic if r.held_out]
    assert held and sum(r.predicted for r in held) >= 0.6 * len(held)


def test_rare_and_frequent_words_count_alike():
    r = np.random.default_rng(1)
    draw = lambda: np.unique(np.minimum(r.zipf(1.3, 60) - 1, 2999))
    rows = [(i, i % 2, (t, r.integers(1, 4, len(t)))) for i, t in enumerate(draw() for _ in range(500))]
    idf = np.where(r.random(3000) < 0.1, 0.0, r.uniform(0.1, 5, 3000))
    index = toxicity.Index(np.arange(3000, dtype=np.uint64), idf, rows, {0: 1.0, 1: 1.0})
    assert 0 < len(index.postings) < 100
    w = np.zeros((500, 3000))
    for i, _, (t, c) in rows:
        w[i, t] = (1 + np.log(c)) * idf[t]
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    for i in range(0, 500, 10):
        best, got = index.nearest(*rows[i][2])
        assert np.allclose(got, np.sort(w @ w[i])[::-1][: toxicity.NEIGHBOURS], atol=2e-6) and np.allclose((w @ w[i])[best], got, atol=2e-6)


def test_only_near_copies_are_dropped(spark, make_docs):
    """Different texts under a common header all count; near copies count once."""
    r = random.Random(3)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    header, base = words(40), words(200)
    rows = [(i, " ".join(header + words(60))) for i in range(100)]
    rows += [(1000 + i, " ".join([*base[: 10 * i], "edit", *base[10 * i + 1 :]])) for i in range(20)]
    labels = spark.createDataFrame([(d, 1, d % 2) for d, _ in rows], "doc_id long, quality int, toxic int")
    index = toxicity.fit(make_docs(rows), labels, F.lit(True))
    assert {d for d in index.ids.tolist() if d < 1000} == set(range(100))
    assert sorted(d % 2 for d in index.ids.tolist() if d >= 1000) == [0, 1]


def test_first_of_copies_is_exact():
    r = np.random.default_rng(4)
    pool = [np.unique(r.integers(0, 400, r.integers(1, 40)).astype(np.uint64)) for _ in range(60)]
    sets = [np.zeros(0, np.uint64)] * 2
    for _ in range(400):
        s = pool[r.integers(60)]
        sets.append(np.unique(np.concatenate([s[r.random(len(s)) > 0.1], r.integers(0, 400, r.integers(0, 3)).astype(np.uint64)])))
    kept = []
    for i, s in enumerate(sets):
        a = set(s.tolist())
        if not a or not any(10 * len(a & (b := set(sets[j].tolist()))) >= 8 * len(a | b) for j in kept if len(sets[j])):
            kept.append(i)
    assert toxicity.first_of_copies(sets) == kept and 60 < len(kept) < 390


def test_nearest_is_exact():
    r = np.random.default_rng(0)
    rows = [(i, int(i % 3 == 0), {int(t): int(c) for t, c in zip(r.choice(40, 6, False), r.integers(1, 4, 6))}) for i in range(900)]
    index = toxicity.Index(np.arange(40, dtype=np.uint64), r.uniform(1, 5, 40), rows, {0: 1.0, 1: 1.0})
    w = index.postings.reshape(40, -1).T
    for _ in range(50):
        terms, counts = np.sort(r.choice(40, 5, False)), r.integers(1, 4, 5)
        q = np.zeros(40)
        q[terms] = (1 + np.log(counts)) * index.idf[terms]
        sims = np.round(w.astype(float) @ (q / np.linalg.norm(q)), 6)
        best, got = index.nearest(terms, counts)
        assert np.allclose(np.sort(got), np.sort(np.sort(sims)[-toxicity.NEIGHBOURS :]), atol=2e-6) and np.allclose(sims[best], got, atol=2e-6)


def test_toxicity_odd(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int")
    index = toxicity.fit(odd_docs, labels.limit(0), F.lit(True))
    assert [r.score for r in toxicity.score(odd_docs, index).collect()] == [0.0] * 10
    assert toxicity.score(no_docs, toxicity.fit(no_docs, labels, F.lit(True))).count() == 0
    one = toxicity.fit(odd_docs, labels, F.lit(True))
    assert all(r.score < 0.5 for r in toxicity.score(odd_docs, one).collect())


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.predict(docs, language.fit(docs, crc_mod(4) != 2, 60))
    out = out.join(docs.select("doc_id", "lang"), "doc_id").where(crc_mod(4) == 2).collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.98 and all(0 <= r.score <= 1 for r in out)


def test_language_odd(make_docs, odd_docs, no_docs):
    rows = language.predict(odd_docs, language.fit(odd_docs, F.lit(True))).collect()
    got = {r.doc_id: r.lang_pred for r in rows}
    assert len(rows) == 10 and got[1] == got[2] == got[5] == got[6] == "und" and got[3] == got[8] == "en"
    none = language.fit(odd_docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert {r.lang_pred for r in language.predict(odd_docs, none).collect()} == {"und"}
    assert language.predict(no_docs, none).count() == 0


def test_signs_that_are_no_letters(spark):
    docs = spark.createDataFrame([(1, "ein guter Text", "de"), (2, "a good text", "en"), (3, "½ ② ² 12", "de"), (4, "Ⅷ ٣ _", None), (5, "ª", None)],
                                 "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.predict(docs, language.fit(docs, F.col("doc_id") < 3)).collect()}
    assert got[3].lang_pred == got[4].lang_pred == "und" and got[3].score == 0 and got[5].lang_pred != "und" and got[1].lang_pred == "de"


def test_many_languages_are_all_predicted(spark):
    rng = random.Random(3)
    words = {f"q{k:03d}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(8)] for k in range(300)}
    rows = [(8 * k + i, " ".join(rng.choices(v, k=30)), v_lang) for k, (v_lang, v) in enumerate(words.items()) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    out = language.predict(docs, language.fit(docs, F.col("doc_id") % 8 < 3)).where("doc_id % 8 = 3")
    got = {r.doc_id // 8: r.lang_pred for r in out.collect()}
    assert len(got) == 300 and len(set(got.values())) > 280 and np.mean([got[k] == f"q{k:03d}" for k in got]) > 0.95


def test_pairs_vote_like_a_plain_count():
    rng = np.random.default_rng(1)
    weights = {(a, b): rng.normal(size=language.DIMENSIONS + 1).astype(np.float32) for a in range(5) for b in range(a + 1, 5)}
    x = rng.random((40, language.DIMENSIONS)).astype(np.float32)
    best, sure = language.Pairwise(list("vwxyz"), weights).predict(x)
    for row, k, p in zip(x, best, sure):
        m = {pair: language.SHARPNESS * float(row @ w[:-1] + w[-1]) for pair, w in weights.items()}
        wins = [sum(v > 0 if a == c else v <= 0 for (a, b), v in m.items() if c in (a, b)) for c in range(5)]
        assert wins[k] == max(wins) and 0 <= p <= 1
        worst = min(v if a == k else -v for (a, b), v in m.items() if k in (a, b))
        assert abs(p - 1 / (1 + np.exp(-2 * np.clip(worst, -30, 30)))) < 1e-3


def test_families_are_separated():
    assert language.family_of("de") == language.family_of("en-GB") == "germanic" and language.family_of("fr") == "romance"
    assert language.family_of("xx") != language.family_of("yy")
