"""Text column expressions (F1, F11, S1 splitting, P6 strip). All JVM-side, no UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.split()/str.strip() treat as whitespace
# (str.isspace), as one Java regex class: U+0009-U+000D, U+001C-U+001F, U+0020, U+0085,
# U+00A0, U+1680, U+2000-U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
WS_CLASS = ("[\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x85\\xA0\\u1680\\u2000-\\u200A"
            "\\u2028\\u2029\\u202F\\u205F\\u3000]")

# Text-mode universal newlines end a line at "\r\n", "\r" or "\n" only.
LINE_BREAK = "\r\n|\r|\n"

# Fixed value: the end-of-sequence word of the word-level vocabulary.
EOS = "<eos>"
# Fixed value: the word that stands for any word the vocabulary lacks.
UNK = "<unk>"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def split_words(text) -> Column:
    """Python ``str.split()``: split on runs of Unicode whitespace, no empty pieces."""
    return F.array_remove(F.split(F.coalesce(_c(text), F.lit("")), WS_CLASS + "+"), "")


def split_lines(text) -> Column:
    """Lines of a text as a file iterator yields them: ``\\r\\n``, ``\\r`` and ``\\n`` end a
    line, a trailing line break adds no line, an empty text has no lines, blank lines stay."""
    parts = F.split(F.coalesce(_c(text), F.lit("")), LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def line_words(line) -> Column:
    """``line.split() + ["<eos>"]`` for one line."""
    return F.concat(split_words(line), F.array(F.lit(EOS)))


def line_mode_words(text) -> Column:
    """All words of a text in line mode: every line's words followed by ``<eos>``."""
    return F.flatten(F.transform(split_lines(text), line_words))


def doc_mode_words(text) -> Column:
    """Whole-text words with one end-of-sequence marker appended (also for empty text)."""
    return F.concat(split_words(text), F.array(F.lit(EOS)))


def py_strip(text) -> Column:
    """Python ``str.strip()``: remove leading and trailing Unicode whitespace."""
    return F.regexp_replace(_c(text), f"^{WS_CLASS}+|{WS_CLASS}+$", "")


def is_stop_word(text, words=("quit", "exit")) -> Column:
    """``text.lower() in words`` (no trimming: ' exit ' is not a stop word)."""
    return F.lower(_c(text)).isin(list(words))
