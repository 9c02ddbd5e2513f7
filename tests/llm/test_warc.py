"""Round trip of records; revisits against the rule; edge rows."""
import gzip
import io
from collections import defaultdict

from corpusmill.llm import warc


def test_records_round_trip():
    payloads = ["", "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc", "é\x00€", "\r\n\r\n"]
    data = "".join(warc.record("response", {"A": "x: y", "B": None}, p) + "\r\n\r\n" for p in payloads).encode()
    got = list(warc.parse(data))
    assert [p.decode() for _, p in got] == payloads and got[0][0]["A"] == "x: y"


def expected(rows, min_bytes):
    by = defaultdict(list)
    for page, _, html in rows:
        by[html or ""].append(page)
    out = []
    for html, pages in by.items():
        pages.sort(key=lambda p: (p is None, p))
        n, d = len(html.encode()), warc.digest_of(html.encode())
        out += [(p, n, d, "revisit" if k and n >= min_bytes else "response", pages[0] if k and n >= min_bytes else None)
                for k, p in enumerate(pages)]
    return sorted(out, key=str)


def test_rows(spark, write_tables):
    rows = [(5, "u", "x"), (3, "u", "x"), (3, "u", "x"), (9, None, None), (8, "a\r\nb", ""), (None, "u", "x"), (None, "u", "alone"),
            (7, "u", "p\r\n\r\nq\n\n"), (6, "u", "p\r\n\r\nq\n\n"), (10, "u", "é" * 500_000), (11, "u", "\r\n\r\n")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS digest", "2 AS file")
    for min_bytes in (0, 3):
        got = warc.read_outcome(warc.deduplicated_archive(df, min_bytes)).collect()
        assert sorted(map(tuple, got), key=str) == expected(rows, min_bytes)
    d = write_tables(pages=df)
    assert sorted(map(tuple, warc.query(spark, d).collect()), key=str) == expected(rows, 0)
    assert warc.read_outcome(warc.deduplicated_archive(df.limit(0))).count() == 0


def test_ids_above_2_53_with_and_without_null(spark):
    big = 2**60
    rows = [(big + 1, "u", "same"), (big + 3, "u", "same"), (big + 5, "v", "other"), (-big - 7, "w", "same2"), (-big - 5, "w", "same2")]
    for more in ([], [(None, "n", "same"), (None, "n", "alone")]):
        df = spark.createDataFrame(rows + more, "page_id bigint, url string, html string").coalesce(1)
        assert sorted(map(tuple, warc.read_outcome(warc.deduplicated_archive(df)).collect()), key=str) == expected(rows + more, 0)


def test_archives_are_read_in_steps_and_written_by_bytes(spark, monkeypatch):
    payloads = ["a" * 50, "", "\r\n\r\n" * 9, "é" * 70]
    data = "".join(warc.record("response", {"A": "b"}, p) + "\r\n\r\n" for p in payloads).encode()
    for step in (1, 2, 3, 5, 64):
        monkeypatch.setattr(warc, "STEP_BYTES", step)
        assert [p.decode() for _, p in warc.parse(gzip.GzipFile(fileobj=io.BytesIO(gzip.compress(data))))] == payloads
    df = spark.createDataFrame([(k, "u", "x" * 1000 + str(k)) for k in range(20)], "page_id bigint, url string, html string").coalesce(1)
    monkeypatch.setattr(warc, "FILE_BYTES", 22_000)
    assert warc.records_per_file(df) == 4
    archive = warc.deduplicated_archive(df)
    assert archive.count() == 5 and warc.read_outcome(archive).count() == 20
