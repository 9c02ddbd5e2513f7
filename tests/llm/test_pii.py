"""Base spans against the contract's patterns by brute force; disguises; edge rows."""
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    out = {}
    for kind, pattern in PATTERNS.items():
        out[kind] = []
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            double = [sum(divmod(int(c) * 2, 10)) if k % 2 else int(c) for k, c in enumerate(d[::-1])]
            if kind == "email" or kind == "ip" and max(map(int, m[0].split("."))) <= 255 \
                    or kind == "card" and 16 <= len(d) <= 19 and sum(double) % 10 == 0 or kind == "phone" and 8 <= len(d) <= 15:
                out[kind].append(m.span())
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1@.+- 0(245", max_size=40))
def test_base_spans_equal_the_patterns(text):
    assert pii.find(text) == brute(text)


def cover(text, kind):
    base, every = pii.spans_of(text)
    assert set(base[kind]) <= set(every[kind])
    return [text[a:b] for a, b in every[kind]]


def test_disguises_map_back_to_the_source():
    assert cover("to john [at] example [dot] com now", "email") == ["john [at] example [dot] com"]
    assert cover("john dot smith at mail dot example dot org", "email") == ["john dot smith at mail dot example dot org"]
    assert cover("jоhn@exаmple.com", "email") == ["jоhn@exаmple.com"]  # two Cyrillic letters
    assert cover("４１１１ 1111 1111 1111!", "card") == ["４１１１ 1111 1111 1111"]
    assert cover("call +1 five five five 123 4567 now", "phone") == ["+1 five five five 123 4567"]
    assert cover("at 192[.]168[.]0[.]1 or 192.l68.O.1", "ip") == ["192[.]168[.]0[.]1", "192.l68.O.1"]


def test_plain_prose_has_no_span():
    for text in ("look at the dot. com", "two or three of one, six at home", "un dos uno at point of dot", "+1 (848) 555-1373 Un an"):
        base, every = pii.spans_of(text)
        assert base == every


def test_long_runs_are_linear():
    for text in ("1" * 200_000, "a" * 200_000, "@" * 50_000, "+1 " * 30_000, "1." * 50_000, "un " * 30_000):
        began = time.process_time()
        pii.spans_of(text)
        assert time.process_time() - began < 20


def test_many_spans_of_a_text_are_linear():
    text = "a@b.co 1.2.3.4 x[at]y.com 10[dot]1[dot]2[dot]3 " * 40_000  # 1.9 MB
    began = time.process_time()
    base, every = pii.spans_of(text)
    assert time.process_time() - began < 60
    assert len(base["email"]) == len(base["ip"]) == 40_000 and len(every["email"]) == len(every["ip"]) == 80_000


def test_rows(spark, write_tables):
    rows = [(1, "a@b.c 4111 1111 1111 1111", "x"), (1, "a@b.c 4111 1111 1111 1111", "x"), (None, None, None), (3, "", None)]
    d = write_tables(documents=spark.createDataFrame(rows, "doc_id bigint, text string, spans string"))
    got = sorted(pii.query(spark, d).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert [(r.doc_id, r.n_email, r.n_card, r.spans) for r in got] == [
        (1, 1, 1, "email:0:5,card:6:25")] * 2 + [(3, 0, 0, ""), (None, 0, 0, "")]
    empty = write_tables(documents=spark.createDataFrame([], "doc_id bigint, text string"))
    assert pii.query(spark, empty).count() == 0


def test_address_parts_of_thousands_of_zeros():
    zeros = "0" * 6000
    assert pii.find(f"{zeros}.1.2.{zeros}7 9.9.9.{'9' * 6000}")["ip"] == [(0, 6000 + 5 + 6001)]


def test_disguises_that_need_no_other_sign():
    for text, kind in (("john@example[dot]com", "email"), ("192[dot]168[dot]0[dot]1", "ip"), ("john{dot}x@example.com", "email"),
                       ("john<dot>x@example.com", "email"), ("john{@}example.com", "email"), ("john<@>example.com", "email"),
                       ("john{arroba}example.com", "email"), ("john\t@\texample.com", "email"), ("plus 49 170 1234567", "phone"),
                       ("+49\xa0170\xa01234567", "phone"), ("jame\u017f@example.com", "email"),
                       ("+1 555 f\u0131ve f\u0130ve five 4567", "phone")):
        assert text in cover(f"so: {text}", kind)  # base spans inside it stay


FRAGMENTS = ["john", "x.y", "example", "com", "one", "Two", "fünf", "zéro", "f\u0131ve", "plus", "PLUS", "at", "AT", "ät", "arroba", "dot", "Punkt",
             "point", "@", ".", "+", "1", "192", "555", "O", "l", "I", "[", "]", "(", ")", "{", "}", "<", ">", " ", " ", " ", "\t", "-", "_",
             "\n", "\xa0", "\u017f", "\u200b", "\u0430", "\u0664", "4111 1111 1111 1111", "12345678"]


@settings(max_examples=3000, deadline=None)
@given(st.lists(st.sampled_from(FRAGMENTS), max_size=18))
def test_gate_equals_no_gate(parts):
    text, gate = "".join(parts), pii._suspect
    gated = pii.spans_of(text)
    pii._suspect = lambda _: True
    try:
        assert pii.spans_of(text) == gated
    finally:
        pii._suspect = gate


def test_spelled_dots_far_from_the_sign():
    part = "a" * 70
    for text in (f"{part} dot {part} dot {part}@example.com", f"john@{part} dot {part} dot {part} dot com"):
        assert text in cover(f"so, {text}, ok", "email")
    far = "a dot " * 30_000
    pii.spans_of(far + "b@c.d and " + far)
