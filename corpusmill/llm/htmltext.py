"""Main text of web pages: article blocks, and unique runs by a host suffix array.

A tolerant scan turns a page into blocks with a zone: inside an ``article`` element, inside
``main``, or elsewhere; menus, headers, footers, sidebars, forms, scripts, styles, notices,
adverts and reader comments are marked by their elements and class names.

The token streams of a host's pages are joined and sorted as a suffix array, and a page loses
the blocks that repeated runs of ``RUN`` tokens (block ends count as one) cover by half or more;
such runs together make up every longer repeated substring. Which runs count depends on what the
page gives as its text.

* A page with an article (or main) element gives the blocks in it. A sentence that other articles
  hold too is content, so a run counts if it stands in ``FEW`` and in a ``SHARE`` of the host's
  distinct articles: a notice without a mark that the site puts into its articles. An article
  that would lose half of its words or more is a near copy of others and stays whole.
* Other pages have no such guide: a run on two distinct pages counts. Pages of a host with equal
  blocks that may be text are copies and count as one page here, so copies do not cover each
  other. Streams of pages with an article enter here with the blocks outside it.

A host's pages are sorted in blocks of ``PAGES`` pages. For pages without an article each gives one
row per distinct run (its smallest and largest page); the rows of all blocks meet in a partial
aggregate by host and run, so a run is found even if each block holds it once. Articles are cut
into blocks of at most ``CHARS`` code points or so too. A run in a share of all articles is in that
share of those of one block at least, so a block gives only such runs; hosts of several blocks
then count these runs in all of them. So a host with a third of all pages is many tasks. Article
texts are shuffled packed, copies once a task, and once more for hosts that are counted again.

Edge cases: null html is empty; a page without text gives an empty string; unclosed elements,
cut tags, comments and references are read as far as they go. Rows with the same page_id,
url and html are one page and are treated alike. A null or odd url is the host "". Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as html_lib
import re
import zlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import materialize, ship, table
from corpusmill.plans.joins import lookup_join

RUN, PAGES, CHARS = 6, 1000, 8_000_000
COVERED = 0.5
FEW, SHARE = 5, 0.5

# Element names of the HTML standard by their use here.
RAW = frozenset("script style noscript template textarea title svg math iframe object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIP = frozenset("head nav footer aside form menu dialog select button".split()) | RAW
BLOCK = frozenset("""address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul
    """.split())
_SKIP_CLASS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notices?|alert|popup|modal|newsletter|subscribe"
    r"|sidebar|menu|navbar|navigation|breadcrumbs?|site-header|site-footer|comments?|replies|respond|disqus\w*|share|social"
    r"|related|recommended)(?:$|[\s_-])", re.IGNORECASE)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.IGNORECASE)
# A quote opens a value only after "=", as in the standard; a stray one elsewhere is a character.
_TAG = re.compile(r"""<(?:!--|[!?][^>]*>|(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+>|[^>]*>))""")
ARTICLE, MAIN, OTHER, DROPPED = 3, 2, 1, 0


def blocks_of(page: str | None) -> list[tuple[int, str]]:
    """``(zone, text)`` of the page's blocks in order, white space made one space."""
    page, out, run = page or "", [], []
    at, skip, depth, article, main = 0, None, 0, 0, 0

    def zone() -> int:
        return DROPPED if skip else ARTICLE if article > 0 else MAIN if main > 0 else OTHER

    def close() -> None:
        if run:
            text = " ".join(html_lib.unescape("".join(run)).split())
            run.clear()
            if text:
                out.append((zone(), text))

    while True:
        if page.find(">", at) < 0:  # no tag can end any more: not tried at every "<"
            rest = page[at:]
            comment = rest.find("<!--")
            run.append(rest[:comment] if comment >= 0 else _tail(rest))
            close()
            return out
        m = _TAG.search(page, at)
        run.append(page[at:m.start()] if m else _tail(page[at:]))
        if not m:
            close()
            return out
        at = m.end()
        if m[0] == "<!--":
            end = page.find("-->", at)
            at = end + 3 if end >= 0 else len(page)
            continue
        if not m[2]:
            continue
        name, ends = m[2].lower(), bool(m[1])
        if name in BLOCK or name in SKIP:
            close()
        elif name in ("br", "td", "th"):
            run.append(" ")
        if name in RAW and not ends:
            if m[3].endswith("/>") and name in ("svg", "math"):
                continue
            end = re.compile(rf"</{name}\b[^>]*>?", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            continue
        if skip:
            if name == skip:
                depth += -1 if ends else 1
            # an unclosed menu must not swallow the article; a paragraph ends with the next block
            if depth <= 0 or not ends and (name in ("article", "main") or skip == "p" and name in BLOCK):
                skip, depth = None, 0
                if ends or name == skip:
                    continue
            else:
                continue
        if not ends and name not in VOID and (
                name in SKIP or name == "header" and not article or _marked(m[3])):
            skip, depth = name, 1
        elif name == "article":
            article = max(0, article + (-1 if ends else 1))
        elif name == "main":
            main = max(0, main + (-1 if ends else 1))


def _tail(rest: str) -> str:
    """The text after the last tag: a tag that the end of the page cuts is markup, not text."""
    cut = rest.rfind("<")
    return rest[:cut] if cut >= 0 and re.match(r"</?[a-zA-Z!?]|</?\Z", rest[cut:]) else rest


def _marked(attributes: str) -> bool:
    for m in _ATTRIBUTE.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "role" and value.lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "alert"):
            return True
        if m[1].lower() != "role" and _SKIP_CLASS.search(value):
            return True
    return False


def split_page(page: str | None) -> tuple[str | None, list[str], list[str]]:
    """``(text, candidates, stream)``: the article (or main) blocks of a page that has them, one a line,
    else null and the blocks that may be its text; the blocks outside an article that its host compares."""
    blocks = blocks_of(page)
    for zone in (ARTICLE, MAIN):
        own = [t for z, t in blocks if z == zone]
        if own:
            return "\n".join(own), [], [t for z, t in blocks if z != zone]
    candidates = [t for z, t in blocks if z == OTHER]
    return None if candidates else "", candidates, [t for _, t in blocks]


_PARTS = "text string, candidates array<string>, stream array<string>"


def parts_of(html: str = "html"):
    @F.pandas_udf(_PARTS)
    def udf(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([split_page(p) for p in pages], columns=["text", "candidates", "stream"])

    return udf(F.col(html))


def _tokens(blocks) -> list[str]:
    out = ["\n"]
    for b in blocks:
        out += b.split()
        out.append("\n")
    return out


def suffix_runs(streams: list[list[str]], run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix array of the joined streams, sorted by the first ``run`` tokens (runs never
    reach over a stream's end): suffix places in order, their rank, and each place's stream."""
    owner = np.repeat(np.arange(len(streams)), [len(s) + 1 for s in streams])
    number: dict[str, int] = {}
    rank = np.array([number.setdefault(t, len(number)) if t is not None else -1 - k
                     for k, s in enumerate(streams) for t in [*s, None]], dtype=np.int64)
    rank = np.unique(rank, return_inverse=True)[1]
    width = 1
    while width < run:  # prefix doubling: ranks of ``width`` tokens give those of up to twice as many
        step = min(width, run - width)
        pair = rank * (rank.max() + 2 if len(rank) else 1)
        pair[:-step] += rank[step:] + 1
        rank = np.unique(pair, return_inverse=True)[1]
        width += step
    # a place is whole if its run ends before its stream does
    ends = np.cumsum([len(s) + 1 for s in streams])
    whole = np.arange(len(rank)) + run < ends[owner] if len(rank) else np.zeros(0, bool)
    order = np.argsort(rank, kind="stable")
    order = order[whole[order]]
    return order, rank[order], owner[order]


def _run_hash(tokens: list[str], at: int, run: int) -> int:
    return xxhash.xxh64_intdigest("\x00".join(tokens[at:at + run])) - 2**63


def _host_runs(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row per distinct run of a block of pages, with its smallest and largest page."""
    streams = [_tokens(s) for s in pdf["stream"]]
    pages = pdf["same"].to_numpy(np.int64)
    flat = [t for s in streams for t in [*s, ""]]
    order, rank, owner = suffix_runs(streams)
    if not len(order):
        return pd.DataFrame({"host": [], "run": [], "low": [], "high": []})
    first = np.flatnonzero(np.concatenate(([True], rank[1:] != rank[:-1])))
    own = pages[owner]
    return pd.DataFrame({"host": pdf["host"].iloc[0], "run": [_run_hash(flat, int(order[k]), RUN) for k in first],
                         "low": np.minimum.reduceat(own, first), "high": np.maximum.reduceat(own, first)})


def _page_runs(batches):
    for b in batches:
        for page, host, blocks in zip(b["page"], b["host"], b["candidates"]):
            tokens = _tokens(blocks)
            n = max(0, len(tokens) - RUN + 1)
            yield pd.DataFrame({"page": page, "host": host, "at": np.arange(n),
                                "run": [_run_hash(tokens, k, RUN) for k in range(n)]})


def _counted_runs(pdf: pd.DataFrame, wanted: np.ndarray | None) -> pd.DataFrame:
    """One row per run that stands in a ``SHARE`` of a block's articles (in ``FEW`` too if the host has no other block), or
    per wanted run, with the number of articles that hold it."""
    pdf = pdf.drop_duplicates("same")  # copies of an article are one
    word: dict[str, str] = {}
    streams = [[word.setdefault(t, t) for t in _tokens(zlib.decompress(p).decode().split("\n"))] for p in pdf["packed"]]
    order, rank, owner = suffix_runs(streams)
    if not len(order):
        return pd.DataFrame(columns=["host", "run", "pages", "blocks"], dtype=object)
    head = np.concatenate(([True], rank[1:] != rank[:-1]))
    first = np.flatnonzero(head)
    # equal runs lie in the order of their streams
    pages = np.add.reduceat((head | np.concatenate(([True], owner[1:] != owner[:-1]))).astype(np.int64), first)
    if wanted is None:
        few = pages >= max(SHARE * len(pdf), FEW if pdf["blocks"].iloc[0] == 1 else 1)
        first, pages = first[few], pages[few]
    flat = [t for s in streams for t in [*s, ""]]
    run = np.array([_run_hash(flat, int(k), RUN) for k in order[first]], dtype=np.int64)
    if wanted is not None:
        run, pages = run[(held := np.isin(run, wanted))], pages[held]
    return pd.DataFrame({"host": pdf["host"].iloc[0], "run": run, "pages": pages, "blocks": pdf["blocks"].iloc[0]})


def _article_runs(pdf: pd.DataFrame) -> pd.DataFrame:
    return _counted_runs(pdf, None)


def _wanted_runs(pdf: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
    return _counted_runs(pdf, wanted["run"].to_numpy(np.int64))


def _packed(batches):
    """The articles of a task, each distinct one of a host once."""
    seen: set[int] = set()
    for b in batches:
        rows = [(h, k, zlib.compress(t.encode())) for h, k, t in zip(b["host"], b["same"], b["text"])
                if not (k in seen or seen.add(k))]
        yield pd.DataFrame(rows, columns=["host", "same", "packed"])


def _covered_blocks(blocks: list[str], starts) -> list[bool]:
    """Whether the runs that start at these tokens cover half of a block or more."""
    mask = np.zeros(sum(len(b.split()) + 1 for b in blocks) + 1, bool)
    for k in starts:
        mask[k:k + RUN] = True
    at, out = 1, []
    for b in blocks:
        n = len(b.split())
        out.append(bool(mask[at:at + n].mean() >= COVERED))
        at += n + 1
    return out


def _unique_blocks(candidates: pd.Series, covered: pd.Series) -> pd.Series:
    return pd.Series(["\n".join(b for b, c in zip(blocks, _covered_blocks(blocks, () if starts is None else starts)) if not c)
                      for blocks, starts in zip(candidates, covered)], dtype=object)


def _own_blocks(texts: pd.Series, runs: pd.Series) -> pd.Series:
    """Articles without the blocks that runs of their host cover; one that would lose half of its words stays whole."""
    out = []
    for text, frame in zip(texts, runs):
        if text and frame is not None:
            blocks = text.split("\n")
            tokens, frame = _tokens(blocks), set(frame.tolist())
            covered = _covered_blocks(blocks, [k for k in range(len(tokens) - RUN + 1) if _run_hash(tokens, k, RUN) in frame])
            words = np.array([len(b.split()) for b in blocks])
            if 2 * words[covered].sum() < words.sum():
                text = "\n".join(b for b, c in zip(blocks, covered) if not c)
        out.append(text)
    return pd.Series(out, dtype=object)


def article_frames(articles: DataFrame, pages_per_block: int = PAGES) -> DataFrame:
    """``(host, runs, n)``: the runs that stand in ``FEW`` and in a ``SHARE`` of the ``n`` distinct texts of a host in
    ``articles (host, text)``, a written table; hosts without such runs are left out."""
    articles = articles.select("host", F.xxhash64("host", "text").alias("same"), "text")
    size = articles.select("host", "same", F.length("text").alias("size")).distinct().groupBy("host") \
        .agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    blocks = F.greatest(F.ceil(F.col("n") / F.lit(pages_per_block)), F.ceil(F.col("size") / F.lit(CHARS)))
    size = materialize(size.select("host", "n", blocks.cast("bigint").alias("blocks")), "html-hosts")
    large = size.where("blocks > 1").select("host", "blocks")  # a row per PAGES pages or CHARS code points at most

    def dealt(part: DataFrame) -> DataFrame:
        split = part.mapInPandas(_packed, "host string, same bigint, packed binary").join(F.broadcast(large), "host", "left") \
            .withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("bigint")))
        return split.withColumn("block", F.pmod("same", "blocks"))

    schema = "host string, run bigint, pages bigint, blocks bigint"
    found = materialize(dealt(articles).groupBy("host", "block").applyInPandas(_article_runs, schema), "html-runs")
    frames = found.where("blocks = 1").select("host", "run")
    many = found.where("blocks > 1").select("host", "run", "blocks").distinct()
    if not many.isEmpty():  # what a share of one block holds is counted in all
        wanted = many.select("host", "run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"))
        again = dealt(articles.join(F.broadcast(many.select("host").distinct()), "host", "left_semi"))
        counted = again.groupBy("host", "block").cogroup(wanted.groupBy("host", "block")).applyInPandas(_wanted_runs, schema)
        total = counted.groupBy("host", "run").agg(F.sum("pages").alias("pages"))
        enough = total.join(F.broadcast(size.where("blocks > 1")), "host") \
            .where((F.col("pages") >= F.lit(SHARE) * F.col("n")) & (F.col("pages") >= FEW))
        frames = frames.unionByName(enough.select("host", "run"))
    frames = frames.groupBy("host").agg(F.collect_set("run").alias("runs"))
    return materialize(frames.join(size.select("host", "n"), "host"), "html-frames")


def main_text(pages: DataFrame, pages_per_block: int = PAGES) -> DataFrame:
    """``(page_id, url, text)`` for every row of ``pages (page_id, url, html)``."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    parts = materialize(pages.select("page_id", "url", host.alias("host"), F.xxhash64("page_id", "url", "html").alias("page"),
                                     parts_of().alias("m")).select("page_id", "url", "host", "page", "m.*"), "html-parts", codec="zstd")
    open_ = parts.where("text IS NULL")
    frames = article_frames(parts.where("text <> ''").select("host", "text"), pages_per_block)
    own = F.pandas_udf(_own_blocks, "string")
    done = lookup_join(parts.where("text IS NOT NULL").select("page_id", "url", "host", "text"), frames, "host", "left", "n") \
        .select("page_id", "url", own("text", "runs").alias("text"))
    # a host needs its runs only if one of its pages has no article
    need = open_.select("host").distinct()
    # copies of a page without an article are one page in the runs; they stay spread over the blocks
    same = F.when(F.col("text").isNull(), F.xxhash64("candidates")).otherwise(F.col("page"))
    streams = parts.select("host", "page", same.alias("same"), "stream").join(need, "host", "left_semi") \
        .dropDuplicates(["host", "page"])  # repeated rows are one page, however many
    count = streams.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    split = F.pmod("page", F.ceil(F.col("n") / F.lit(pages_per_block)).cast("bigint"))
    runs = streams.join(count, "host").withColumn("block", split).groupBy("host", "block") \
        .applyInPandas(_host_runs, "host string, run bigint, low bigint, high bigint")
    repeated = runs.groupBy("host", "run").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high")
    places = open_.select("page", "host", "candidates").mapInPandas(_page_runs, "page bigint, host string, at bigint, run bigint")
    covered = places.join(repeated.select("host", "run"), ["host", "run"]).groupBy("page") \
        .agg(F.collect_set("at").alias("covered"))
    unique = F.pandas_udf(_unique_blocks, "string")
    rest = open_.join(covered, "page", "left").select("page_id", "url", unique("candidates", "covered").alias("text"))
    return done.unionByName(rest)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


ship(__name__)
