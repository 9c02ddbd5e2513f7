"""Conversation structure repair by the auction algorithm for shortest paths.

A conversation's rows in order are columns of a lattice, its four states what the roles so far
leave open: nothing yet, after a system row, after a user row, after an assistant row. Arcs are
edits with integer costs: Keep and Rerole lead to the next row and state, Delete to the next row in the same
state, Insert to the next state at the same row. The cheapest repair is a shortest path to the end with roles
``(s?(ua)+)?``.

The auction: every node has a price, at most the cost that is left from it. A path starts at
its origin; at its last node it extends over the arc that is cheapest by cost and price, if the
node's price pays for it; if not, the price is raised to that cost and the path contracts by a node. It ends at
a node whose price is final. With every node an origin in turn, the last row's first, all
prices converge to the exact costs left: the arcs that they pay for exactly are the tight ones, and
every tight arc leads on to the end. The repair is traced along tight arcs by the least initial
(D, I, K, R), so ties give the ASCII-least audit.

Rows are put in order over all conversations by the engine's range exchange and cut into chunks
of ``CHUNK`` rows, so a conversation with a third of all rows is many chunks. A conversation
inside a chunk is repaired there. One that reaches over a chunk's border is cut into pieces: each
piece prices its four entry states for each exit state; the pieces' prices are joined from
the last to the first (sixteen numbers each); each piece is traced from every entry state;
the pieces are walked in order. Only that last walk, which hashes the repaired text, is a stream
through one task, since SHA-256 has no parallel form; it holds one piece at a time.

Order: turn (null first), role, text, all by value, so ties have a defined order. Faults: a row is blank
(no character but white space), else duplicate (role and text of an earlier row of the
conversation), else truncated (last character that is not white space is none of ``.!?``).

Edge cases: a null role or text is one space; a null conv_id is a conversation. Unknown roles can only be
reroled or deleted. Repeated rows are separate rows, later ones duplicates. A conversation without rows has no
faults and an empty repair. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import materialize, ship, table
from corpusmill.plans.ordering import global_rank

#: Rows that one task repairs at once.
CHUNK = 2_000
#: Rows of one range of the order; they carry their texts.
RANGE_ROWS = 50_000
#: Characters of a text that the order of rows looks at first.
HEAD = 64

DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: Costs that are left at the end: inserts that close the roles.
END = (0, 2 * INSERT, INSERT, 0)
NEXT_ROLE = ("user", "user", "assistant", "user")
NEXT = (USER, USER, ASSISTANT, USER)
_KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
_NONE = 1 << 60
_SOLID = re.compile(r"[^\x20\x09-\x0D]")
_LAST = re.compile(r"[^\x20\x09-\x0D][\x20\x09-\x0D]*\Z")
BLANK, DUPLICATE, CUT, SOUND = "blank", "duplicate", "truncated", ""


def fault_of(text: str, first: bool) -> str:
    if not _SOLID.search(text):
        return BLANK
    if not first:
        return DUPLICATE
    return SOUND if _LAST.search(text)[0][0] in ".!?" else CUT


def _arcs(rows: list[tuple[str, str]]) -> list[list[tuple[str, int, int]]]:
    """By node ``4 * row + state``: ``(initial, cost, node)`` of its arcs, initials rising."""
    out = []
    for k, (initial, fault) in enumerate(rows):
        for q in range(4):
            arcs = [("D", DELETE, 4 * k + 4 + q), ("I", INSERT, 4 * k + NEXT[q])]
            if fault not in (BLANK, DUPLICATE):
                more = TRUNCATED if fault == CUT else 0
                if (q, initial) in _KEPT:
                    arcs.append(("K", more, 4 * k + 4 + _KEPT[q, initial]))
                arcs.append(("R", REROLE + more, 4 * k + 4 + NEXT[q]))
            out.append(arcs)
    return out


def auction(arcs: list[list[tuple[str, int, int]]], ends: list[int]) -> list[int]:
    """The exact cost left at every node; ``ends`` are the costs left at the four last nodes."""
    n = len(arcs)
    price, final = [0] * n + list(ends), [False] * n + [True] * 4
    # nodes from which no end is reached have no finite price: left out of the auction
    reach = [e < _NONE for e in ends]
    states = [[True] * 4] * 0
    for k in range(n // 4 - 1, -1, -1):
        here = list(reach)
        for _ in range(3):
            for q in range(4):
                here[q] = here[q] or any(reach[j % 4] if j >= 4 * k + 4 else here[j % 4] for _, _, j in arcs[4 * k + q])
        reach = here
        states.append(here)
    for k, here in enumerate(reversed(states)):
        for q in range(4):
            if not here[q]:
                price[4 * k + q], final[4 * k + q] = _NONE, True
    for origin in range(n - 1, -1, -1):
        path = [origin]
        while not final[path[-1]]:
            at = path[-1]
            cost, best = min((c + price[j], j) for _, c, j in arcs[at])
            if price[at] < cost:
                price[at] = cost
                if len(path) > 1:
                    path.pop()
            else:
                path.append(best)
        for node in path:  # a tight path to a final node: what it holds is final
            final[node] = True
    return price


def trace(rows: list[tuple], arcs: list, price: list[int], state: int) -> tuple[str, list[str], int]:
    """Initials, repaired lines and exit state of the ASCII-least path of tight arcs; ``rows`` are
    ``(role, text, fault)``."""
    at, audit, lines = state, [], []
    while at < len(arcs):
        letter, to = next((a, j) for a, c, j in arcs[at] if price[at] == c + price[j])
        audit.append(letter)
        role, text, _ = rows[at // 4]
        if letter == "I":
            lines.append(f"{NEXT_ROLE[at % 4]}:")
        elif letter != "D":
            lines.append(f"{role if letter == 'K' else NEXT_ROLE[at % 4]}:{text}")
        at = to
    return "".join(audit), lines, at - len(arcs)


def closing(state: int) -> tuple[str, list[str]]:
    """The inserts behind the last row."""
    count = END[state] // INSERT
    return "I" * count, ["user:", "assistant:"][2 - count:]


def _pairs(rows: list[tuple]) -> list[tuple[str, str]]:
    return [(role[:1], fault) for role, _, fault in rows]


_LEGAL = ("su", "ua", "au")


def counts(rows: list[tuple], turns: list) -> dict:
    """Faults, illegal neighbours and turns of some rows in a row."""
    initials, known = [r[0][:1] for r in rows], [t for t in turns if t is not None]
    faults = [r[2] for r in rows]
    return {"blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(CUT),
            "illegal": sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:])),
            "first": initials[0], "last": initials[-1], "turns": len(set(known)),
            "low": known[0] if known else None, "high": known[-1] if known else None}


def _gaps(low: int | None, high: int | None, turns: int) -> int:
    return 0 if low is None else high - low + 1 - turns


def repair(rows: list[tuple], turns: list) -> tuple:
    """``(gaps, blank, duplicate, truncated, illegal, cost, audit, sha)`` of a whole conversation."""
    arcs = _arcs(_pairs(rows))
    price = auction(arcs, list(END))
    audit, lines, state = trace(rows, arcs, price, START)
    more, closed = closing(state)
    c = counts(rows, turns)
    return (_gaps(c["low"], c["high"], c["turns"]), c["blank"], c["duplicate"], c["truncated"], c["illegal"],
            price[START] if arcs else 0, audit + more, hashlib.sha256("\n".join(lines + closed).encode("utf-8", "surrogatepass")).hexdigest())


# ---------------------------------------------------------------- the job

_ROW = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_WHOLE = f"conv string, {_ROW}"
_PIECE = "conv string, chunk bigint, ends array<bigint>"
_PRICED = "conv string, chunk bigint, ends array<bigint>"
_TRACED = ("conv string, chunk bigint, state int, exit int, cost bigint, audit string, lines string, empty boolean, blank bigint, duplicate bigint, "
           "truncated bigint, illegal bigint, first string, last string, turns bigint, low string, high string")


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _conversations(pdf: pd.DataFrame):
    """``(conv, rows, turns)`` of a chunk in order; ids and turns are strings, so that no large number
    becomes a float."""
    pdf = pdf.sort_values("idx", kind="stable")
    conv = [None if pd.isna(c) else c for c in pdf["conv"]]
    rows = [(role, text, fault_of(text, first)) for role, text, first in zip(pdf["role"], pdf["text"], pdf["is_first"])]
    turns = [None if pd.isna(t) else int(t) for t in pdf["turn"]]
    at = 0
    for k in range(1, len(conv) + 1):
        if k == len(conv) or conv[k] != conv[at]:
            yield conv[at], rows[at:k], turns[at:k]
            at = k


def _open(border: pd.DataFrame) -> set:
    return {None if pd.isna(c) else c for c in border["conv"]}


def _whole(key: tuple, rows: pd.DataFrame, border: pd.DataFrame) -> pd.DataFrame:
    cut = _open(border)
    return pd.DataFrame([(c, *repair(r, t)) for c, r, t in _conversations(rows) if c not in cut] if len(rows) else [], columns=_names(_WHOLE))


def _entries(key: tuple, rows: pd.DataFrame, border: pd.DataFrame) -> pd.DataFrame:
    """Of each piece, the prices of its entry states for each exit state, sixteen numbers."""
    cut, out = _open(border), []
    for conv, own, _ in _conversations(rows) if cut else ():
        if conv in cut:
            arcs = _arcs(_pairs(own))
            ends = [auction(arcs, [0 if q == e else _NONE for q in range(4)])[:4] for e in range(4)]
            out.append((conv, key[0], [x for e in ends for x in e]))
    return pd.DataFrame(out, columns=_names(_PIECE))


def _join_prices(batches):
    """Pieces of a conversation from the last to the first: the costs left at the end of each."""
    conv, ends = object(), list(END)
    for pdf in batches:
        out = []
        for c, chunk, between in zip(pdf["conv"], pdf["chunk"], pdf["ends"]):
            c = None if pd.isna(c) else c
            if c != conv:
                conv, ends = c, list(END)
            out.append((c, chunk, ends))
            ends = [min(min(int(between[4 * e + q]) + ends[e] for e in range(4)), _NONE) for q in range(4)]
        yield pd.DataFrame(out, columns=_names(_PRICED))


def _traces(key: tuple, rows: pd.DataFrame, priced: pd.DataFrame) -> pd.DataFrame:
    """Each piece traced from every entry state."""
    known = {None if pd.isna(c) else c: [int(x) for x in e] for c, e in zip(priced["conv"], priced["ends"])}
    out = []
    for conv, own, turns in _conversations(rows) if known else ():
        if conv not in known:
            continue
        arcs, c = _arcs(_pairs(own)), counts(own, turns)
        price = auction(arcs, known[conv])
        for q in range(4):
            if price[q] < _NONE:
                audit, lines, exit_ = trace(own, arcs, price, q)
                out.append((conv, key[0], q, exit_, price[q], audit, "\n".join(lines), not lines, c["blank"], c["duplicate"], c["truncated"],
                            c["illegal"], c["first"], c["last"], c["turns"], *(None if c[x] is None else str(c[x]) for x in ("low", "high"))))
    return pd.DataFrame(out, columns=_names(_TRACED))


class _Walk:
    """A conversation walked piece by piece."""

    def __init__(self, conv):
        self.conv, self.state, self.cost, self.audit, self.sha, self.empty = conv, START, None, [], hashlib.sha256(), True
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.last = self.low = self.high = None

    def add(self, text: str, empty: bool) -> None:
        if not empty:
            self.sha.update(("" if self.empty else "\n").encode() + text.encode("utf-8", "surrogatepass"))
            self.empty = False

    def step(self, r) -> None:
        low, high = (None if pd.isna(x) else int(x) for x in (r.low, r.high))
        self.cost = r.cost if self.cost is None else self.cost
        self.audit.append(r.audit)
        self.add(r.lines, r.empty)
        self.blank, self.duplicate, self.truncated = self.blank + r.blank, self.duplicate + r.duplicate, self.truncated + r.truncated
        self.illegal += r.illegal + (self.last is not None and self.last + r.first not in _LEGAL)
        self.turns += r.turns - (low is not None and low == self.high)
        self.last, self.state = r.last, r.exit
        self.low = low if self.low is None else self.low
        self.high = high if high is not None else self.high

    def result(self) -> tuple:
        more, closed = closing(self.state)
        self.add("\n".join(closed), not closed)
        return (self.conv, _gaps(self.low, self.high, self.turns), self.blank, self.duplicate, self.truncated, self.illegal,
                self.cost, "".join(self.audit) + more, self.sha.hexdigest())


def _walk(batches):
    walk, done, chunk = None, [], None
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            conv = None if pd.isna(r.conv) else r.conv
            if walk is None or conv != walk.conv:
                done += [walk.result()] if walk else []
                walk, chunk = _Walk(conv), None
            if r.chunk != chunk and r.state == walk.state:
                walk.step(r)
                chunk = r.chunk  # the other entry states of this piece are passed over
        if done:
            yield pd.DataFrame(done, columns=_names(_WHOLE))
            done = []
    if walk:
        yield pd.DataFrame([walk.result()], columns=_names(_WHOLE))


def ordered_rows(rows: DataFrame, rows_per_bucket: int = RANGE_ROWS) -> DataFrame:
    """``rows (conv_id, turn, role, text)`` as ``(idx, conv, turn, role, text, is_first)``: the place in order over
    all conversations, and whether no earlier row of the conversation has the role and text."""
    t = rows.select(F.col("conv_id").cast("string").alias("conv"), F.col("conv_id").alias("_id"), F.col("turn").alias("_turn"),
                    F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    t = materialize(t.withColumn("_head", F.substring("text", 1, HEAD)).withColumn("_tail", F.expr(f"substring(text, {HEAD + 1})")), "turns")
    t = global_rank(t, ["_id", "_turn", "role", "_head", "_tail"], rows_per_bucket=rows_per_bucket)
    t = materialize(t.select("idx", "conv", F.col("_turn").cast("string").alias("turn"), "role", "text"), "turns-in-order")
    first = t.groupBy("conv", "role", "text").agg(F.min("idx").alias("idx")).select("idx", F.lit(True).alias("_first"))
    return t.join(first.hint("merge"), "idx", "left").select("idx", "conv", "turn", "role", "text", F.col("_first").isNotNull().alias("is_first"))


def repairs(rows: DataFrame, chunk: int = CHUNK, rows_per_bucket: int = RANGE_ROWS) -> DataFrame:
    """``(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)`` for every
    conversation of ``rows (conv_id, turn, role, text)``; ``conv`` is the id as a string."""
    t = materialize(ordered_rows(rows, rows_per_bucket).withColumn("chunk", F.expr(f"idx div {int(chunk)}")), "turns-by-chunk")
    span = t.groupBy("conv").agg(F.min("chunk").alias("lo"), F.max("chunk").alias("hi")).where("lo < hi")
    border = materialize(span.select("conv", F.explode(F.sequence("lo", "hi")).alias("chunk")), "turn-borders")
    both = lambda right: t.groupBy("chunk").cogroup(right.groupBy("chunk"))
    whole = both(border).applyInPandas(_whole, _WHOLE)
    if border.isEmpty():
        return whole
    cut = t.join(border.select("chunk").distinct().hint("merge"), "chunk", "left_semi")
    pieces = lambda right: cut.groupBy("chunk").cogroup(right.groupBy("chunk"))
    entries = pieces(border).applyInPandas(_entries, _PIECE)
    priced = entries.repartition("conv").sortWithinPartitions("conv", F.col("chunk").desc()).mapInPandas(_join_prices, _PRICED)
    traced = pieces(materialize(priced, "turn-prices")).applyInPandas(_traces, _TRACED)
    walked = traced.repartition("conv").sortWithinPartitions("conv", "chunk", "state").mapInPandas(_walk, _WHOLE)
    return whole.unionByName(walked)


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with the faults that the check puts in, by a hash of id and turn."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", space)
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(kind == 4, F.lit("user")).otherwise(F.coalesce("role", space))
    rows = conversations.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("_n"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("_n"))).alias("_k")).drop("_k")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    done = repairs(damaged(conversations))
    ids = conversations.select("conv_id").distinct()
    joined = ids.join(done.hint("merge"), ids["conv_id"].cast("string").eqNullSafe(done["conv"]), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return joined.select("conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                         F.coalesce("audit", F.lit("")).alias("audit"),
                         F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


ship(__name__)
