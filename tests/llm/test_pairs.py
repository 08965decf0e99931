"""Near duplicates and decontamination against all pairs and all windows."""

import collections
import math
import random
import re

import numpy as np

from barscope.llm import decontaminate, kernels, minhash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))


def grams(w):
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def edited(r, w, n):
    w = list(w)
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return w


def corpus(seed=0, hot=60):
    r = random.Random(seed)
    new = lambda n: [f"w{int(r.paretovariate(0.6)) % 5000}" for _ in range(n)]
    rows = []
    base = new(300)
    for _ in range(hot):  # one large group with few and many edits
        rows.append(" ".join(edited(r, base, r.randrange(0, 14))))
    for _ in range(30):
        w = new(r.randrange(5, 400))
        rows += [" ".join(w)] * r.randrange(1, 4) + [" ".join(edited(r, w, k)) for k in range(r.randrange(0, 5))]
    passage = new(40)
    rows += [" ".join(new(60) + passage + new(60)) for _ in range(30)]
    rows += ["one two", "one two", "one  TWO!", "three"]
    r.shuffle(rows)
    return list(enumerate(rows))


def plain_classes(rows):
    g = {d: grams(words(t)) for d, t in rows if words(t)}
    df = collections.Counter(x for s in g.values() for x in s)
    n = len(g)

    def idf(x):
        return 1.0 if df[x] < minhash.RARE * n or df[x] < 2 else min(2.0, 1 + math.log(n / df[x]) / math.log(1 / minhash.RARE)) / 2

    v = {d: {x: c * idf(x) for x, c in s.items()} for d, s in g.items()}
    total = {d: sum(s.values()) for d, s in v.items()}
    label = {d: d for d, _ in rows}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(v)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = sum(min(w, v[b][x]) for x, w in v[a].items() if x in v[b])
            if both / (total[a] + total[b] - both) >= minhash.SIMILARITY - 1e-9:
                x, y = top(a), top(b)
                label[max(x, y)] = min(x, y)
    return {d: top(d) for d in label}


def test_classes(make_docs):
    for seed in (0, 1):
        rows = corpus(seed)
        got = {r.doc_id: r.class_id for r in minhash.near_duplicates(make_docs(rows)).collect()}
        assert got == plain_classes(rows)


def test_classes_odd(odd_docs, no_docs):
    rows = minhash.near_duplicates(odd_docs).collect()
    assert len(rows) == 10 and all(r.class_id == r.doc_id for r in rows)
    assert minhash.near_duplicates(no_docs).count() == 0


def test_chain_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)], "a long, b long")
    got = {r.node: r.label for r in minhash.components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_samples_estimate_similarity():
    r = np.random.default_rng(1)
    hits = total = 0
    a, b = r.integers(1, 4, 80) * 0.7, r.integers(1, 4, 80) * 0.7
    for _ in range(60):
        keys = np.sort(r.integers(0, 2**52, 80).astype(np.uint64))
        s = minhash.samples(np.tile(keys, 2), np.log(np.concatenate([a, b])).astype(np.float32), np.array([0, 80, 160]))
        hits, total = hits + (s[0] == s[1]).sum(), total + s.shape[1]
    assert abs(hits / total - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


def test_kernels_do_not_depend_on_blocks():
    import pyarrow as pa

    texts = ["Hello, wörld hello 12a", "", None, "a b c d e f", "A B c d E F x", "one"]
    data, offsets = kernels.bytes_of(pa.array(texts))
    h, first = kernels.words(data, offsets)
    assert list(np.diff(first)) == [len(words(t)) for t in texts]
    flat = [w for t in texts for w in words(t)]
    assert len(set(h.tolist())) == len(set(flat)) and all((h[i] == h[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(i))
    kept, kernels.BLOCK = kernels.BLOCK, 7
    try:
        assert (kernels.words(data, offsets)[0] == h).all()
    finally:
        kernels.BLOCK = kept
    s, at = kernels.shingles(h, first)
    assert list(np.diff(at)) == [1, 0, 0, 2, 3, 1] and (s[1:3] == s[3:5]).all()


def plain_contaminated(docs, items):
    out = {}
    for d, t in docs:
        w = words(t)
        for i, u in items:
            u = words(u)
            if len(u) < 5 or d is None:
                continue
            a = grams(u)
            for start in range(-len(u) + 5, len(w)):
                b = grams(w[max(0, start) : max(0, start + len(u))])
                s = sum((a & b).values()) / sum((a | b).values())
                if s >= decontaminate.SIMILARITY:
                    out[d, i] = max(round(s, 6), out.get((d, i), 0))
    return out


def test_contaminated(spark, make_docs):
    r = random.Random(4)
    new = lambda n: [f"w{r.randrange(400)}" for _ in range(n)]
    items = [(i, new(n)) for i, n in enumerate([5, 12, 30, 45, 60, 60, 90, 4])]
    items.append((8, (new(6) * 5)))
    docs = []
    for d in range(60):
        _, item = items[d % len(items)]
        mid = {0: item, 1: edited(r, item, 1), 2: item[: int(len(item) * 0.95)], 3: item[2:] + new(2), 4: edited(r, item, 4), 5: new(8) + item[:10]}[d % 6]
        docs.append((d, " ".join(new(r.randrange(0, 50)) + mid + new(r.randrange(0, 50)))))
    docs += [(100, None), (101, ""), (102, " ".join(items[4][1])), (None, " ".join(items[4][1]))]
    bench = spark.createDataFrame([(i, ", ".join(w)) for i, w in items] + [(50, None), (51, "")], "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.similarity for x in decontaminate.contaminated(make_docs(docs), bench).collect()}
    want = plain_contaminated(docs, [(i, " ".join(w)) for i, w in items])
    assert set(got) == set(want)
    # Among all windows some that hang over an end of the text can be a little more similar than the aligned one.
    assert all(got[k] <= want[k] <= got[k] + 0.06 for k in got) and sum(got[k] == want[k] for k in got) >= 0.9 * len(got)
    left = {x.doc_id for x in decontaminate.decontaminate(make_docs(docs), bench).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in got}


def test_contaminated_odd(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "the same row twice, once more"), (2, None), (None, "a b c d e f g")], "item_id long, text string")
    got = decontaminate.contaminated(odd_docs, bench).collect()
    assert [(x.doc_id, x.item_id, x.start, x.n_words, x.distance, x.similarity) for x in got] == [(4, 1, 0, 6, 0, 1.0)]
    assert decontaminate.contaminated(no_docs, bench).count() == 0
    assert decontaminate.contaminated(odd_docs, bench.limit(0)).count() == 0
    assert decontaminate.decontaminate(odd_docs, bench).count() == 8


def test_blocks_cover_the_fingerprint():
    covered = [b for low, n in decontaminate.BITS for b in range(low, low + n)]
    assert sorted(covered) == list(range(64)) and len(decontaminate.BITS) == decontaminate.RADIUS + 1
