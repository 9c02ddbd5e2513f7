"""Conversation repair against a search over all edits, whole and cut into pieces."""
import hashlib
import heapq
import random
import re
import zlib

import pytest

from corpusmill.llm import conversations as conv

STATES = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
ROLE = {"": "user", "s": "user", "u": "assistant", "a": "user"}


def search(rows):
    """Cheapest edits by (cost, audit) over (row, state); ``rows`` are (role, text, fault)."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, k, state, lines = heapq.heappop(heap)
        if k == len(rows) and state in ("", "a"):
            return cost, audit, lines
        if (k, state) in seen:
            continue
        seen.add((k, state))
        new = ROLE[state]
        heapq.heappush(heap, (cost + 3, audit + "I", k, new[0], (*lines, f"{new}:")))
        if k < len(rows):
            role, text, fault = rows[k]
            heapq.heappush(heap, (cost + 4, audit + "D", k + 1, state, lines))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                if role[:1] in STATES[state]:
                    heapq.heappush(heap, (cost + more, audit + "K", k + 1, STATES[state][role[:1]], (*lines, f"{role}:{text}")))
                heapq.heappush(heap, (cost + 3 + more, audit + "R", k + 1, new[0], (*lines, f"{new}:{text}")))


def brute(table):
    """The contract by its words, for (conv_id, turn, role, text)."""
    held = {c: [] for c, _, _, _ in table}
    show = lambda x: " " if x is None else str(x)
    for c, turn, role, text in table:
        kind = zlib.crc32(f"{show(c)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        row = (turn, "user" if kind == 4 else role, text)
        held[c] += [] if kind == 0 else [row, row] if kind == 3 else [row]
    out = {}
    for c, rows in held.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faulty = set(), []
        for _, role, text in rows:
            solid = re.findall(r"[^ \t-\r]", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated"
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns = [t for t, _, _ in rows if t is not None]
        initials = [r[0][:1] for r in faulty]
        cost, audit, lines = search(faulty)
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
                  *(sum(f == kind for _, _, f in faulty) for kind in ("blank", "duplicate", "truncated")),
                  sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                  hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def table(seed, ids):
    rng, rows = random.Random(seed), []
    for c in ids:
        for t in range(rng.choice([1, 2, 3, 5, 8])):
            turn = None if rng.random() < 0.06 else t + 2 * (rng.random() < 0.2)
            role = rng.choice(["system", "user", "assistant", "assistant", "user", "tool", None, ""])
            text = rng.choice(["Yes.", "no", " \t", "", None, "What? ", "a.\nb!", "x" * 90 + ".", "x" * 90 + "!", f"n{t}."])
            rows.append((c, turn, role, text))
    return rows


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("chunk,bucket", [(conv.CHUNK, 10**6), (7, 40), (1, 10**6)])
def test_query_equals_search(spark, write_tables, monkeypatch, chunk, bucket):
    monkeypatch.setattr(conv, "CHUNK", chunk)
    rows = table(4, [*range(30), 2**60 + 1, 2**60 + 3, -5, None])
    rows += [(77, t // 3, random.Random(t).choice(["user", "assistant", "system"]), f"turn {t // 2}" + ".?,"[t % 3]) for t in range(160)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id bigint, turn bigint, role string, text string, idx string")
    monkeypatch.setattr(conv.repairs, "__defaults__", (chunk, bucket))
    got = {r["conv_id"]: tuple(r[c] for c in NAMES) for r in conv.query(spark, write_tables(conversations=df.repartition(5))).collect()}
    want = brute(rows)
    assert got == want


def test_empty_table_and_a_conversation_that_loses_all_rows(spark, write_tables):
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert conv.query(spark, write_tables(conversations=empty)).collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    one = spark.createDataFrame([(gone, 0, "user", "x")], "conv_id bigint, turn bigint, role string, text string")
    r = conv.query(spark, write_tables(conversations=one)).collect()
    assert [tuple(x) for x in r] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_prices_pay_for_every_arc_and_tight_arcs_lead_on():
    rng = random.Random(9)
    for _ in range(300):
        rows = [(rng.choice("usa-"), rng.choice(["", "blank", "duplicate", "truncated"])) for _ in range(rng.randrange(1, 12))]
        arcs = conv._arcs(rows)
        price = conv.auction(arcs, list(conv.END))
        for node, out in enumerate(arcs):
            assert price[node] == min(c + price[j] for _, c, j in out)


def test_texts_are_whole_and_long(spark):
    rows = [(1, 0, "user", "q" * 300_000 + "?"), (1, 1, "assistant", "w " * 200_000 + ".")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    r = conv.repairs(df).collect()[0]
    assert (r["audit"], r["cost"]) == ("KK", 0)
    assert r["repaired_sha256"] == hashlib.sha256(("user:" + rows[0][3] + "\nassistant:" + rows[1][3]).encode()).hexdigest()
