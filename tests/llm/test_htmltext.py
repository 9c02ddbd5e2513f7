"""Extraction on hand-written pages; runs against brute force; edge rows."""
import random
import time
from collections import defaultdict

from corpusmill.llm import htmltext as ht

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/x">Home</a></ul></nav><!-- <p>no</p> --><div class="ad">Buy <b>now</b></div>
<article><h1>A &amp; B</h1><p><b>One  two<br>three<p title="a > b">Caf&eacute; &lt;x&gt;&nbsp;y</p><div class="cookie-notice"><div>ok?</div></div>
<aside>side</aside><form>Name <input></form><section class="comments"><p>Nice!</p></section><p>End</p></article>
<p>after</p><footer>&copy; me</footer></body></html>"""


def test_article_blocks():
    assert ht.split_page(PAGE)[0] == "A & B\nOne two three\nCafé <x> y\nEnd"
    assert ht.split_page("<nav>menu<article><p>in</p></article>")[0] == "in"  # an unclosed menu
    assert ht.split_page("<article><p>cut &am")[0] == "cut &am" and ht.split_page("<article>x<p cla")[0] == "x"
    assert ht.split_page("<main><p>m</p></main><p>o</p>")[0] == "m"
    assert ht.split_page(None)[0] == "" and ht.split_page("<script>x")[0] == "" and ht.split_page("plain")[1] == ["plain"]


def test_suffix_runs_group_equal_runs():
    rnd = random.Random(3)
    for run in (1, 2, 3, 4, 7):
        streams = [[rnd.choice("abc") for _ in range(rnd.randint(0, 30))] for _ in range(6)]
        flat = [t for s in streams for t in [*s, "|"]]
        order, rank, owner = ht.suffix_runs(streams, run)
        got, want = defaultdict(list), defaultdict(list)
        for o, r, w in zip(order.tolist(), rank.tolist(), owner.tolist()):
            got[r].append((o, w))
        at = 0
        for k, s in enumerate(streams):
            for i in range(len(s) - run + 1):
                want[tuple(s[i:i + run])].append((at + i, k))
            at += len(s) + 1
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
        assert all(flat[o:o + run] == flat[v[0][0]:v[0][0] + run] for v in got.values() for o, _ in v)


def test_pages_without_article_lose_their_host_runs(spark, write_tables):
    menu, foot = "<div>Home About Contact us today</div>", "<div>All rights are reserved by us</div>"
    rows = [(k, f"http://h.example/{k}", f"{menu}<p>u{k} v{k} w{k} x{k} y{k} z{k} q{k}</p>{foot}") for k in range(7)]
    rows += [(20, "http://other.example/", f"{menu}<p>lone</p>"), (21, None, None), (22, "u", ""), (23, "http://h.example/a", PAGE),
             (24, "http://h.example/a", "<article><p>Home About Contact us today</p></article>"), (3, rows[3][1], rows[3][2])]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS text", "2 AS host")
    for size in (ht.PAGES, 2):
        got = sorted((r.page_id, r.text) for r in ht.main_text(df, size).collect())
        assert got == sorted([(k, f"u{k} v{k} w{k} x{k} y{k} z{k} q{k}") for k in [*range(7), 3]] + [
            (20, "Home About Contact us today\nlone"), (21, ""), (22, ""), (23, "A & B\nOne two three\nCafé <x> y\nEnd"),
            (24, "Home About Contact us today")])
    d = write_tables(pages=df)
    assert {(r.page_id, r.n_chars) for r in ht.query(spark, d).collect()} >= {(21, 0), (24, 27)}
    assert ht.main_text(df.limit(0)).count() == 0


def test_copies_of_a_page_without_article_keep_their_text(spark):
    menu, foot = "<div>Home About Contact us today</div>", "<div>All rights are reserved by us</div>"
    page = lambda k: f"{menu}<p>u{k} v{k} w{k} x{k} y{k} z{k} q{k}</p>{foot}"
    text = lambda k: f"u{k} v{k} w{k} x{k} y{k} z{k} q{k}"
    rows = [(k, f"http://h.example/{k}", page(k % 3)) for k in range(9)]
    rows += [(20 + k, f"http://copies.example/{k}", page(5)) for k in range(4)]
    rows += [(30, "http://h.example/b", "<nav>n</nav>" + page(1))]  # other menu, same blocks
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    whole = f"Home About Contact us today\n{text(5)}\nAll rights are reserved by us"
    want = [(k, text(k % 3)) for k in range(9)] + [(20 + k, whole) for k in range(4)] + [(30, text(1))]
    for size in (ht.PAGES, 2):
        assert sorted((r.page_id, r.text) for r in ht.main_text(df, size).collect()) == want


def test_long_attributes():
    long = "x" * 600
    for quote in "\"'":
        page = f"<article><p>a</p><div class={quote}{long} menu{quote}>menu</div><div data-x={quote}{'<b>' * 3000}{quote}>b</div></article>"
        assert ht.split_page(page)[0] == "a\nb"
    assert ht.split_page(f"<article><p>a</p><div class={long}-menu>menu</div></article>")[0] == "a"
    # a stray or unclosed quote does not swallow the text
    assert ht.split_page("<article><p title=it's>one</p><p>it's two</p><p x=\"y>three</p></article>")[0] == "one\nit's two\nthree"
    assert ht.split_page("<p " + "class=" * 100_000 + ">c")[1] == ["c"]


def test_pages_of_megabytes_without_an_end_of_tag_are_linear():
    for part in ("<a ", "<!x", "</p", "<a =\"", "< ", "<!--", "<p class='", "<p>x", "a<b>=\"' "):
        page = part * (5_000_000 // len(part))
        began = time.process_time()
        ht.split_page("<article>in</article>" + page)
        assert time.process_time() - began < 60
    assert ht.split_page("<article>in <b x <!-- no")[0] == "in <b x" and ht.split_page("<article>a <b c <d")[0] == "a <b c"


def test_repeated_rows_of_a_page_are_one_page(spark):
    pages = spark.range(3000).selectExpr("7L AS page_id", "'http://h/a' AS url", "'<p>own words of one page that stays whole here</p>' AS html") \
        .unionByName(spark.range(20).selectExpr("id AS page_id", "'http://h/b' AS url", "concat('<p>other ', id, ' text that nobody repeats ', id * 7, '</p>') AS html"))
    out = ht.main_text(pages, 10)
    assert out.count() == 3020
    assert {r.text for r in out.where("page_id = 7 AND url = 'http://h/a'").collect()} == {"own words of one page that stays whole here"}


def test_articles_lose_the_runs_of_their_host(spark):
    notice = "<p>Read our other stories and tell your friends</p>"
    said = "<p>the match was called off because of rain</p>"  # a sentence of some articles, no notice

    def words(k, n=12):
        return " ".join(f"w{k}x{i}" for i in range(n))

    def article(k, more=""):
        return f"<nav>Home</nav><article><h1>Title {k}</h1><p>{words(k)}</p>{more}<p>{words(k + 1000)}</p></article>"

    def text(k, more=""):
        return "\n".join(x for x in (f"Title {k}", words(k), more, words(k + 1000)) if x)

    lines = "the match was called off because of rain"
    read = "Read our other stories and tell your friends"
    rows = [(k, f"http://h.example/{k}", article(k, notice if k < 7 else said if k < 10 else "")) for k in range(12)]
    want = [(k, text(k, lines if 7 <= k < 10 else "")) for k in range(12)]
    # copies of one article are one: two of six distinct articles hold the notice
    rows += [(100 + k, f"http://copies.example/{k}", article(100 + max(0, k - 9), notice if k < 11 else "")) for k in range(15)]
    want += [(100 + k, text(100 + max(0, k - 9), read if k < 11 else "")) for k in range(15)]
    # too few articles to tell; the same notice on another host
    rows += [(200 + k, f"http://few.example/{k}", article(200 + k, notice)) for k in range(4)]
    want += [(200 + k, text(200 + k, read)) for k in range(4)]
    # near copies: the article is what they share
    rows += [(300 + k, f"http://near.example/{k}", f"<main><p>{words(300, 40)}</p><p>{words(301 + k, 8)}</p></main>") for k in range(9)]
    want += [(300 + k, f"{words(300, 40)}\n{words(301 + k, 8)}") for k in range(9)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for size in (ht.PAGES, 5, 2):
        assert sorted((r.page_id, r.text) for r in ht.main_text(df, size).collect()) == want


def test_article_frames_against_brute_force(spark, tmp_path):
    rnd = random.Random(5)
    rows = []
    for host, pages in (("a", 23), ("b", 9), ("c", 4), ("", 7)):
        common = [" ".join(rnd.choice("pqrst") for _ in range(rnd.randint(6, 9))) for _ in range(4)]
        for _ in range(pages):
            own = [" ".join(rnd.choice("uvwxyz") for _ in range(9)) for _ in range(2)]
            blocks = own + [c for k, c in enumerate(common) if rnd.random() < (0.3, 0.5, 0.6, 0.8)[k]]
            rnd.shuffle(blocks)
            rows += [(host, "\n".join(blocks))] * rnd.choice((1, 1, 3))
    want = {}
    for host in {h for h, _ in rows}:
        texts = {t for h, t in rows if h == host}
        held = defaultdict(set)
        for t in texts:
            tokens = ht._tokens(t.split("\n"))
            for k in range(len(tokens) - ht.RUN + 1):
                held[ht._run_hash(tokens, k, ht.RUN)].add(t)
        runs = {r for r, p in held.items() if len(p) >= ht.FEW and len(p) >= ht.SHARE * len(texts)}
        if runs:
            want[host] = (runs, len(texts))
    assert set(want) >= {"a", "b"} and "c" not in want
    spark.createDataFrame(rows, "host string, text string").repartition(3).write.parquet(f"{tmp_path}/articles")
    articles = spark.read.parquet(f"{tmp_path}/articles")
    for size in (ht.PAGES, 8, 2, 1):
        assert {r.host: (set(r.runs), r.n) for r in ht.article_frames(articles, size).collect()} == want
    assert ht.article_frames(articles.limit(0)).count() == 0


def test_hosts_of_short_pages(spark):
    pages = [(1, "http://a/", "plain"), (2, "http://b/", "<article>x</article>"), (3, "http://c/", "<article>y</article>"), (4, "http://c/", "z")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    for size in (ht.PAGES, 1):
        assert sorted((r.page_id, r.text) for r in ht.main_text(df, size).collect()) == [(1, "plain"), (2, "x"), (3, "y"), (4, "z")]
