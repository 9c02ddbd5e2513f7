"""Personal data with offsets, also behind disguises.

Two passes over each whole text. The base pass finds plain e-mail addresses, IPv4 addresses,
card and phone numbers. The second pass runs transducers that write a normalised text next
to an array with the source character of every character written: look-alike characters and
digits of other scripts become ASCII and invisible ones go; the letters o and l between
digits become 0 and 1; spelled digits, ``plus``, ``at`` and ``dot`` become the characters
they name. The same detectors run on the normalised text, and their spans are mapped back
to the source. A mapped span is added when it takes in a rewritten character and no base
span of its kind covers it; base spans always stay.

Every detector is linear in the text: a failed match is never tried again inside the same
run of characters.

Edge cases: a null text counts as empty and has no span. Rows are independent, so repeated
rows, ties, null ids and extra columns change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import ship, table

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Every digit run is taken whole, followed by three more parts or not, so that no start inside
# a run is tried again; those without the parts are left out afterwards.
_IP = re.compile(r"[0-9]++(?:(?:\.[0-9]++){3})?")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _part(digits: str) -> bool:
    digits = digits.lstrip("0")  # int() refuses thousands of digits, zeros too
    return len(digits) <= 3 and int(digits or "0") <= 255


def _emails(text: str) -> list[tuple[int, int]]:
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            floor = m.end()
        # a local part never reaches over an "@", so the next scan stops here at the latest
        floor, at = max(floor, at + 1), text.find("@", max(floor, at + 1))
    return out


def find(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind: leftmost and non-overlapping; matches that fail a check are dropped."""
    digits = lambda m: "".join(filter(str.isdigit, m[0]))  # noqa: E731  the patterns hold ASCII digits only
    return {
        "email": _emails(text) if "@" in text else [],
        "ip": [m.span() for m in _IP.finditer(text) if "." in m[0] and all(_part(p) for p in m[0].split("."))],
        "card": [m.span() for m in _CARD.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(d := digits(m)) <= 19 and _luhn(d)],
        "phone": [m.span() for m in _PHONE.finditer(text) if 8 <= len(digits(m)) <= 15] if "+" in text else [],
    }


# Letters of other alphabets drawn like ASCII ones, signs used for them, and
# characters that leave no mark.
LOOK_ALIKE = dict(zip("аеорсухіјѕԁһԛԝ" "АВЕКМНОРСТХІЈЅУ" "οανικρτυχ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" "․。·＠‐‑‒–—−",
                      "aeopcyxijsdhqw" "ABEKMHOPCTXIJSY" "oavikptux" "ABEZHIKMNOPTYX" "...@------", strict=True))
INVISIBLE = "­​‌‍‎‏⁠﻿"
# Digit words of the corpus languages and the words for "@", "." and "+".
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8",
    "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8",
    "nueve": "9",
}
_AT, _DOT = r"at|ät|arroba|arobase", r"dot|punkt|point|punto|period"
_OPEN, _SHUT = r"[ \t]*[\[({<][ \t]*", r"[ \t]*[\])}>][ \t]*"
_LABEL = r"[A-Za-z0-9-]+"
_ANY_DOT = rf"(?:{_OPEN}(?:{_DOT}|\.){_SHUT}|[ \t]+(?:{_DOT})[ \t]+|\.)"
_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))


@cache
def _table() -> dict[int, str | None]:
    """Source character -> ASCII character, or None to leave it out. By rule: decimal digits
    of any script, and characters whose compatibility form is one printable ASCII character."""
    out: dict[int, str | None] = {}
    for cp in range(0x80, 0x20000):
        c = chr(cp)
        if (d := unicodedata.decimal(c, None)) is not None:
            out[cp] = str(d)
        elif len(n := unicodedata.normalize("NFKC", c)) == 1 and " " <= n <= "~" and n.isalnum() + (n in "@.+-() "):
            out[cp] = n
    out.update({ord(k): v for k, v in LOOK_ALIKE.items()})
    out.update(dict.fromkeys(map(ord, INVISIBLE)))
    return out


_WORDS = re.compile(r"\w+")


@cache
def _odd_characters() -> frozenset:
    return frozenset(map(chr, _table()))


def _odd(text: str) -> bool:
    """Whether the table rewrites a character of the text."""
    return not text.isascii() and not _odd_characters().isdisjoint(text)


@cache
def _rules() -> list[tuple[re.Pattern, object]]:
    """Transducers in order: a pattern with one group for what is rewritten, and its output."""
    i = re.IGNORECASE
    email_at = rf"(?<=[A-Za-z0-9_%+-])(?P<x>{_OPEN}(?:{_AT}|@){_SHUT})(?={_LABEL}{_ANY_DOT}[A-Za-z])"
    bare_at = rf"(?<=[A-Za-z0-9_%+-])(?P<x>[ \t]+(?:{_AT})[ \t]+)(?={_LABEL}(?:{_OPEN}(?:{_DOT}|\.){_SHUT}|[ \t]+(?:{_DOT})[ \t]+)[A-Za-z])"
    loose_at = rf"(?<=[A-Za-z0-9_%+-])(?P<x>[ \t]+@[ \t]*|@[ \t]+)(?={_LABEL}{_ANY_DOT}[A-Za-z])"
    dot_after = rf"(?P<x>{_OPEN}(?:{_DOT}|\.){_SHUT}|[ \t]+(?:{_DOT})[ \t]+)"
    return [
        (re.compile(r"(?:(?<=[0-9])|(?<=[0-9]\.))(?P<x>[Oo])(?=[0-9Oo]|\.[0-9])"), "0"),
        (re.compile(r"(?:(?<=[0-9])|(?<=[0-9]\.))(?P<x>[lI])(?=[0-9lI]|\.[0-9])"), "1"),
        (re.compile(rf"(?<!\w)(?P<x>{_WORD})(?!\w)", i), lambda s: DIGIT_WORDS[_lower(s)]),
        (re.compile(r"(?<!\w)(?P<x>plus[ \t]+)(?=[0-9])", i), "+"),
        (re.compile(rf"(?<=[0-9]){dot_after}(?=[0-9])", i), "."),
        (re.compile(email_at, i), "@"), (re.compile(bare_at, i), "@"), (re.compile(loose_at, i), "@"),
        # dots in the domain, then in the local part: only beside an address sign
        (re.compile(rf"(?<=[A-Za-z0-9]){dot_after}(?=[A-Za-z0-9])", i), _DOT_RULE),
    ]


_DOT_RULE = object()
SIGN, SPELLED = 1, 2
#: One digit word beside a number is common prose ("555-1373 un an"); so many are a disguise.
MIN_SPELLED = 3


class _Tape:
    """A text being rewritten, the source offset of each character, and which were rewritten."""

    def __init__(self, text: str):
        self.text, self.src = text, np.arange(len(text) + 1, dtype=np.int64)
        self.end = self.src[1:].copy()
        self.new = np.zeros(len(text), dtype=np.int8)  # SIGN or SPELLED where rewritten

    def characters(self) -> None:
        """The character table, with invisible characters left out."""
        out, keep, new = [], [], []
        rules = _table()
        for k, c in enumerate(self.text):
            got = rules.get(ord(c), c) if c > "\x7f" else c
            if got is not None:
                out.append(got)
                keep.append(k)
                new.append(got != c)
        gone = np.diff(np.array([*keep, len(self.text)], dtype=np.int64)) > 1
        gone[-1:] = False
        self.new = (np.array(new, dtype=bool) | gone) * np.int8(SIGN)
        self.end = self.end[keep]
        self.src, self.text = np.append(self.src[keep], self.src[-1]), "".join(out)

    def rewrite(self, spans: list[tuple[int, int, str]], mark: int) -> None:
        """Each span becomes one character that stands for the whole span."""
        text, src, end, new, last = [], [], [], [], 0
        for a, b, c in spans:
            text += [self.text[last:a], c]
            src += [self.src[last:a], self.src[a:a + 1]]
            end += [self.end[last:a], self.end[b - 1:b]]
            new += [self.new[last:a], [mark]]
            last = b
        self.src = np.concatenate([*src, self.src[last:]])
        self.end = np.concatenate([*end, self.end[last:]])
        self.new = np.concatenate([*new, self.new[last:]]).astype(np.int8)
        self.text = "".join([*text, self.text[last:]])


_ADDRESS = re.compile(
    rf"[A-Za-z0-9._%+@-](?:[A-Za-z0-9._%+@-]|{_OPEN}(?:{_DOT}|\.){_SHUT}|[ \t]+(?:{_DOT})[ \t]+)*", re.IGNORECASE)


def _beside_sign(text: str, dots: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The disguised dots that stand in an address: their run of labels, dots and signs holds "@".
    Runs are walked once each."""
    if not dots or "@" not in text:
        return []
    out, k = [], 0
    for m in _ADDRESS.finditer(text):
        while k < len(dots) and dots[k][0] < m.start():
            k += 1
        if k == len(dots):
            break
        if dots[k][1] <= m.end() and "@" in m[0]:
            while k < len(dots) and dots[k][1] <= m.end():
                out.append(dots[k])
                k += 1
    return out


# What a text must hold for the second pass to be worth a look: each rule needs one of these in
# the source (a rule that needs what another one wrote is covered by that one's sign).
_LETTER_DIGIT = re.compile(r"[0-9]\.?(?:[Oo](?:[0-9Oo]|\.[0-9])|[lI](?:[0-9lI]|\.[0-9]))")
_BRACKETED = re.compile(rf"[\[({{<][ \t]*(?:{_AT}|{_DOT}|[@.]){_SHUT}")
_LOOSE_AT = re.compile(r"[ \t]@|@[ \t]")
_PLUS = re.compile(rf"(?<!\w)plus[ \t]+(?:[0-9]|(?:{_WORD})(?!\w))")
_BETWEEN = r"[ ().0-9-]+"
_SPELLED = re.compile(rf"(?<!\w)(?:{_WORD}){_BETWEEN}(?:{_WORD}){_BETWEEN}(?:{_WORD})(?!\w)")
_SIGN_WORDS = frozenset(_DOT.split("|"))
_DIGIT_WORDS = frozenset(DIGIT_WORDS)


def _lower(text: str) -> str:
    """Lower case as the patterns take it: the Turkish letters count as i."""
    return (text if text.isascii() else text.replace("\u0130", "i").replace("\u0131", "i")).lower()


def _suspect(text: str) -> bool:
    if _odd(text) or _LETTER_DIGIT.search(text):
        return True
    low = _lower(text)
    sign = "@" in low
    if _BRACKETED.search(low) or sign and _LOOSE_AT.search(low):
        return True
    words = set(_WORDS.findall(low))
    if not _SIGN_WORDS.isdisjoint(words) or "plus" in words and _PLUS.search(low):
        return True
    # without another sign a span needs MIN_SPELLED words, with nothing but its own characters between
    return not _DIGIT_WORDS.isdisjoint(words) and (sign or bool(_SPELLED.search(low)))


def disguised(text: str) -> dict[str, list[tuple[int, int]]]:
    """Source spans that the detectors find on the normalised text and that hold a rewritten
    character."""
    none: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not _suspect(text):
        return none
    tape = _Tape(text)
    if not text.isascii():
        tape.characters()
    for pattern, out in _rules():
        if out is _DOT_RULE:
            spans = [(a, b, ".") for a, b in _beside_sign(tape.text, [m.span("x") for m in pattern.finditer(tape.text)])]
        else:
            spans = [(*m.span("x"), out if isinstance(out, str) else out(m["x"])) for m in pattern.finditer(tape.text)]
        if spans:
            tape.rewrite(spans, SPELLED if callable(out) else SIGN)
    if not tape.new.any():
        return none
    signs, spelled = (np.concatenate(([0], np.cumsum(tape.new == mark))) for mark in (SIGN, SPELLED))
    return {k: [(int(tape.src[a]), int(tape.end[b - 1])) for a, b in spans
                if signs[b] > signs[a] or spelled[b] - spelled[a] >= MIN_SPELLED]
            for k, spans in find(tape.text).items()}


def spans_of(text: str | None) -> tuple[dict, dict]:
    """Base spans and all spans, by kind, in order of start."""
    text = text or ""
    base = find(text)
    every = {}
    for kind, more in disguised(text).items():
        # base spans do not overlap: the last one that starts in time is the only one that can cover
        own, starts = base[kind], [a for a, _ in base[kind]]
        new = [s for s in more if not (k := bisect_right(starts, s[0])) or own[k - 1][1] < s[1]]
        every[kind] = sorted({*own, *new})
    return base, every


def _digest(spans: dict) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


def detect(text: str = "text") -> Column:
    """A struct ``(base, spans)`` of strings ``kind:start:end`` for the whole text (Arrow UDF)."""
    @F.pandas_udf("base string, spans string")
    def udf(texts: pd.Series) -> pd.DataFrame:
        found = [spans_of(t) for t in texts]
        return pd.DataFrame({"base": [_digest(b) for b, _ in found], "spans": [_digest(s) for _, s in found]})

    return udf(F.col(text))


def personal_data(docs: DataFrame) -> DataFrame:
    """``(doc_id, base, spans)`` for every row of ``docs (doc_id, text)``."""
    return docs.select("doc_id", detect().alias("m")).select("doc_id", "m.base", "m.spans")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = personal_data(table(spark, sf_dir, "documents"))
    counts = [F.regexp_count(F.col("base"), F.lit(f"{k}:")).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


ship(__name__)
