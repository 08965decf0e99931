"""Conversation repair against a plain program that tries all edits in order of cost."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from barscope.llm import conversations as C
from barscope.llm.conversations import repair, search
from barscope.llm.q_conversations import op12

SF = "/root/testdata/sf0.001"
GOOD = re.compile(r"(s?(ua)+)?")
BEGUN = re.compile(r"s?(ua)*u?")


def cheapest(rows):
    """Edits by increasing (cost, letters) from a heap, whole role strings checked at the end."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, letters, i, roles, out = heapq.heappop(heap)
        if (i, roles[-1:], len(roles) > 0) in done:
            continue
        done.add((i, roles[-1:], len(roles) > 0))
        if i == len(rows) and GOOD.fullmatch(roles):
            return cost, letters, out
        moves = [(5, "I", 0, r, (n, "")) for r, n in (("u", "user"), ("a", "assistant"))]
        if i < len(rows):
            role, text, fault = rows[i]
            moves.append((2, "D", 1, "", None))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                moves += [(1 + more, "R", 1, r, (n, text)) for r, n in (("u", "user"), ("a", "assistant"))]
                moves.append((more, "K", 1, role[:1] or "?", (role, text)))
        for price, letter, step, r, row in moves:
            if BEGUN.fullmatch(roles + r):
                heapq.heappush(heap, (cost + price, letters + letter, i + step, roles + r, out + ((row,) if row else ())))


def plain(rows):
    convs = {}
    for conv, turn, role, text in rows:
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        place = (turn is not None, turn or 0, f"{role}:{hashlib.md5(text.encode()).hexdigest()}")
        own = convs.setdefault(conv, [])
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        own += [(place, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    out = []
    for conv, own in convs.items():
        own.sort(key=lambda r: r[0])
        seen, listed = set(), []
        for _, _, role, text in own:
            body = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            listed.append((role, text, fault))
        turns = [r[1] for r in own if r[1] is not None]
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(listed, listed[1:])]
        cost, letters, kept = cheapest(listed)
        text = "\n".join(f"{r}:{t}" for r, t in kept)
        out.append((
            conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(sum(x[2] == f for x in listed) for f in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, letters, hashlib.sha256(text.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


COLUMNS = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


def found(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=repr)


def make(spark, rows):
    data = [(c, t, r, x, "k", 7) for c, t, r, x in rows]
    return spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string, kind string, copy int")


def random_rows(seed, convs, longest):
    rnd = random.Random(seed)
    rows = []
    for c in range(convs):
        turn = rnd.randrange(5)
        for _ in range(rnd.randrange(longest)):
            role = rnd.choice(["user", "assistant"] * 4 + ["system", "tool", "User", "", None])
            rows.append((c, turn, role, rnd.choice(["Yes.", "No!", "cut off", "", " \t\n", None, "Yes. ", f"x{rnd.random()}.", "é?"])))
            turn += rnd.choice([1, 1, 1, 2])
    return rows


@pytest.mark.parametrize("segment", [2, 64])
def test_whole_table_and_random_conversations(spark, monkeypatch, segment):
    monkeypatch.setattr(C, "SEGMENT", segment)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(op12(spark, SF)) == plain(rows)
    rows = random_rows(segment, 150, 12)
    assert found(repair(make(spark, rows))) == plain(rows)


def test_one_long_conversation_among_short_ones(spark):
    rnd = random.Random(3)
    rows = random_rows(4, 40, 9) + [
        (1000, i, rnd.choice(["user", "assistant", "user", "assistant", "system"]), rnd.choice(["Yes.", "cut", f"{i}.", f"{i}!"])) for i in range(3000)
    ]
    got = repair(make(spark, rows))
    assert found(got) == plain(rows)


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (7, None, "user", "A."), (7, None, "assistant", "B."), (7, 3, "user", "C."), (7, 3, "user", "C."),
            (8, 5, "system", "S."), (9, 1, "user", "x. " * 200_000), (9, 2, "assistant", "Fine.")]
    assert found(repair(make(spark, rows))) == plain(rows)
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    assert found(repair(make(spark, [(gone, 1, "user", "Hi.")]))) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_empty_table(spark):
    assert repair(make(spark, [])).collect() == []


def test_search_from_and_to_every_state():
    rnd = random.Random(9)
    for _ in range(200):
        rows = [(rnd.choice("usaat?"), rnd.random() < 0.2, rnd.random() < 0.3) for _ in range(rnd.randrange(9))]
        whole = search(rows, range(4), range(4))
        k = rnd.randrange(len(rows) + 1)
        head, tail = search(rows[:k], range(4), range(4)), search(rows[k:], range(4), range(4))
        for (s, e), best in whole.items():
            both = min((head[s, m][0] + tail[m, e][0], head[s, m][1] + tail[m, e][1]) for m in range(4) if (s, m) in head and (m, e) in tail)
            assert both == best
