"""F1, S1, P3, P6, F11 against Python's own string rules."""
import io

from helpers import docs_df
from corpusmill.functions.text import is_stop_word, line_mode_words, py_strip, split_lines, split_words


def test_whitespace_split_matches_python_for_every_bmp_char(spark):
    cps = [c for c in range(0x3100) if not 0xD800 <= c <= 0xDFFF] + [0x3000, 0xFEFF, 0x180E, 0x200B]
    rows = [(c, "x" + chr(c) + "y") for c in cps]
    df = spark.createDataFrame(rows, "c int, t string").select("c", split_words("t").alias("w"))
    got = {r["c"]: list(r["w"]) for r in df.collect()}
    for c, t in rows:
        assert got[c] == t.split(), hex(c)


def test_split_words_edges(spark):
    texts = ["", "   ", " a  b ", "a b", "a\x1cb", "a b", "tab\tand\nnl", "<eos> x"]
    df = docs_df(spark, texts).select("doc_id", split_words("text").alias("w")).orderBy("doc_id")
    assert [list(r["w"]) for r in df.collect()] == [t.split() for t in texts]


def _py_lines(text):
    return [ln.rstrip("\n") for ln in io.StringIO(text, newline=None)]


def test_line_split_universal_newlines(spark):
    texts = ["", "a", "a\n", "a\r\nb", "a\rb", "\n", "a\n\nb", "a\x85b", "a b", "a\x1cb\r\n\r\n", "x\r"]
    df = docs_df(spark, texts).select("doc_id", split_lines("text").alias("l")).orderBy("doc_id")
    assert [list(r["l"]) for r in df.collect()] == [_py_lines(t) for t in texts]


def test_line_mode_words_match_reference_rule(spark):
    texts = ["a b\n\nc <eos> d\n", "", "\n", "x y\r\nz"]
    df = docs_df(spark, texts).select("doc_id", line_mode_words("text").alias("w")).orderBy("doc_id")
    want = [[w for ln in _py_lines(t) for w in ln.split() + ["<eos>"]] for t in texts]
    assert [list(r["w"]) for r in df.collect()] == want


def test_strip_and_stop_words(spark):
    texts = ["  hi ", "　 x\x1c", " ", "EXIT", " exit ", "Quit", "quit!"]
    df = docs_df(spark, texts).select("doc_id", py_strip("text").alias("s"), is_stop_word("text").alias("stop"))
    got = [(r["s"], r["stop"]) for r in df.orderBy("doc_id").collect()]
    assert got == [(t.strip(), t.lower() in ("quit", "exit")) for t in texts]
