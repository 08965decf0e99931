"""Alignment of two tokenizers against a plain program."""

import collections
import hashlib

import pytest

from barscope.llm import alignment
from barscope.llm.alignment import align
from barscope.llm.bpe import byte_letters
from barscope.llm.q_alignment import op11, piece_model
from barscope.llm.q_bpe import vocabulary

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def encoders():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(vocabulary())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=piece_model())


def plain(rows, encoders):
    """Every document on its own, byte by byte."""
    a, b = encoders
    letters = byte_letters()
    seen, counts = [], collections.Counter()
    for doc_id, text in rows:
        groups = []
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
            bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                ends = []
                for ids, tokens in ((ids_a, bytes_a), (ids_b, bytes_b)):
                    at, out = 0, {}
                    for i, t in zip(ids, tokens):
                        at += len(t)
                        out[at] = i
                    ends.append(out)
                now = ([], [])
                for at in sorted(set(ends[0]) | set(ends[1])):
                    for side in (0, 1):
                        if at in ends[side]:
                            now[side].append(ends[side][at])
                    if at in ends[0] and at in ends[1]:
                        groups.append(now)
                        now = ([], [])
        seen.append((doc_id, groups))
        counts.update((g[0][-1], g[1][-1]) for g in groups)
    best = collections.defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = []
    for doc_id, groups in seen:
        links = [(g[0][-1], g[1][-1]) for g in groups]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((
            doc_id, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links),
            sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links),
            hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def test_whole_table_equals_the_plain_program(spark, encoders):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert found(op11(spark, SF)) == plain([tuple(r) for r in docs], encoders)


def test_odd_texts(make_docs, odd_docs, encoders):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    rows += [(20, " two  spaces "), (21, "<|endoftext|> and <s> </s> <0x41>"), (22, "a▁b"), (23, "\t\n"), (24, "日本語 😀 ½"), (25, "x" * 5000), (26, "▁")]
    got = found(align(make_docs(rows), vocabulary(), piece_model()))
    assert got == plain(rows, encoders)
    by = {r[0]: r for r in got}
    assert by[1] == (1, 0, 0, 0, 0, 0, 0, "") and by[22][1:] == (0, 0, 0, 0, 0, 0, "") and by[21][1] > 0


def test_copies_weigh_by_their_number(make_docs, encoders):
    rows = [(i, "the same text again and again") for i in range(50)] + [(100, "the other text")]
    got = found(align(make_docs(rows), vocabulary(), piece_model()))
    assert got == plain(rows, encoders) and len(got) == 51


def test_empty_table(no_docs):
    assert align(no_docs, vocabulary(), piece_model()).collect() == []


def test_pairs_follow_from_the_vocabularies():
    pairs = alignment.tools(open(vocabulary(), encoding="utf-8").read(), open(piece_model(), "rb").read())[4]
    assert 10_000 < len(pairs.keys) < 1_000_000
