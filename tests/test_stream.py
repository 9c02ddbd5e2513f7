"""G1, J1, J2, W1-W4, W7, J4 against brute force (brute force from the definitions)."""
import pytest

from helpers import docs_df
from corpusmill.functions.text import split_words
from corpusmill.operators import pack, stream, tokens, vocab
from corpusmill.plans.ordering import global_index, global_offsets

TEXTS = ["the cat sat\non the mat", "", "a\n\nb <eos> c", "one", "the end\r\nof it\r",
         "x " * 30, "cat mat the", "\n", "z"]


def py_line_tokens(texts):
    import io
    out = []
    for t in texts:
        out.append([w for ln in io.StringIO(t, newline=None) for w in ln.rstrip("\n").split() + ["<eos>"]])
    return out


def py_vocab(seqs):
    w2i = {}
    for s in seqs:
        for w in s:
            w2i.setdefault(w, len(w2i))
    return w2i


@pytest.mark.parametrize("rows_per_bucket", [1, 3, 1_000_000])
def test_vocab_and_stream_match_reference(spark, rows_per_bucket):
    c = stream.prepare_corpus(docs_df(spark, TEXTS), "line", rows_per_bucket=rows_per_bucket)
    seqs = py_line_tokens(TEXTS)
    w2i = py_vocab(seqs)
    got = {r["word"]: r["id"] for r in c.vocab.collect()}
    assert got == w2i
    flat = [w2i[w] for s in seqs for w in s]
    assert c.total == len(flat)
    st = [r["id"] for r in stream.token_stream(c.docs).orderBy("pos").collect()]
    assert st == flat
    assert c.eos_id == w2i["<eos>"]


def test_offsets_and_index_are_partition_independent(spark):
    rows = [(i * 7 % 101, (i * 13) % 17) for i in range(101)]
    df = spark.createDataFrame(rows, "doc_id bigint, n bigint").repartition(5)
    got = {r["doc_id"]: r["off"] for r in global_offsets(df, "doc_id", "n", rows_per_bucket=10).collect()}
    acc, want = 0, {}
    for d, n in sorted(rows):
        want[d] = acc
        acc += n
    assert got == want
    idx = {r["doc_id"]: r["idx"] for r in global_index(df, "doc_id", rows_per_bucket=7).collect()}
    assert idx == {d: i for i, (d, _) in enumerate(sorted(rows))}
    # more buckets than the coarse cap: equal-width splits inside each quantile range
    two = {r["doc_id"]: r["off"] for r in global_offsets(df, "doc_id", "n", rows_per_bucket=3,
                                                          max_buckets=4).collect()}
    assert two == want
    idx2 = {r["doc_id"]: r["idx"] for r in global_index(df, "doc_id", rows_per_bucket=2, max_buckets=3).collect()}
    assert idx2 == idx


def _stream_docs(spark, seqs):
    rows, off = [], 0
    for d, s in enumerate(seqs):
        rows.append((d, off, len(s), s))
        off += len(s)
    return spark.createDataFrame(rows, "doc_id bigint, off bigint, n bigint, ids array<bigint>"), off


SEQS = [[1, 2, 3], [4], [5, 6, 7, 8, 9, 10, 11], [], [12, 13], [14, 15, 16, 17, 18, 19, 20, 21, 22, 23], [24]]


@pytest.mark.parametrize("block", [1, 3, 5, 11, 24, 25])
def test_blocks_brute_force(spark, block):
    docs, n = _stream_docs(spark, SEQS)
    data = [x for s in SEQS for x in s]
    want = [(i, data[i * block:(i + 1) * block], data[i * block + 1:(i + 1) * block + 1])
            for i in range(max(0, len(data) // block - 1))]
    got = [(r["sample_id"], list(r["inputs"]), list(r["target"]))
           for r in pack.pack_blocks(docs, block, n).orderBy("sample_id").collect()]
    assert got == want


@pytest.mark.parametrize("S,chunk", [(1, 1), (3, 4), (5, 5), (5, 7), (22, 22), (23, 30), (24, 4)])
def test_windows_brute_force(spark, S, chunk):
    docs, T = _stream_docs(spark, SEQS)
    data = [x for s in SEQS for x in s]
    want = [(i, data[i:i + S], data[i + 1:i + S + 1]) for i in range(max(0, T - S))]
    got = [(r["sample_id"], list(r["inputs"]), list(r["target"]))
           for r in pack.pack_windows(docs, S, T, chunk=chunk).orderBy("sample_id").collect()]
    assert got == want
    for _, a, b in got:
        assert a[1:] == b[:-1]


def _sources(seqs, S):
    """Every position labelled with its (document, place); the labels of each window, by document."""
    labels = [(d, k) for d, s in enumerate(seqs) for k in range(len(s))]
    for i in range(len(labels) - S):
        held = labels[i:i + S + 1]
        for d in {d for d, _ in held}:
            places = [k for e, k in held if e == d]
            yield i, d, min(places), max(places) + 1


@pytest.mark.parametrize("S", [1, 4, 12])
def test_window_sources_brute_force(spark, S):
    docs, T = _stream_docs(spark, SEQS)
    want = sorted(_sources(SEQS, S))
    got = sorted(tuple(r) for r in stream.window_sources(docs, S, T).collect())
    assert got == want


def test_sample_at_and_subset_windows(spark):
    docs, T = _stream_docs(spark, SEQS)
    data = [x for s in SEQS for x in s]
    for i in (0, 5, T - 4):
        r = stream.sample_at(docs, i, 3).collect()
        assert [(list(x["inputs"]), list(x["target"])) for x in r] == [(data[i:i + 3], data[i + 1:i + 4])]
    assert stream.sample_at(docs, T - 3, 3).count() == 0
    want_ids = spark.createDataFrame([(0,), (7,), (19,)], "sample_id bigint")
    got = pack.pack_windows(docs, 3, T, chunk=4, samples=want_ids).orderBy("sample_id").collect()
    assert [(r["sample_id"], list(r["inputs"])) for r in got] == [(i, data[i:i + 3]) for i in (0, 7, 19)]


def test_short_corpus_gives_no_samples(spark):
    docs, T = _stream_docs(spark, [[1, 2], [3]])
    assert pack.pack_blocks(docs, 3, T).count() == 0        # N < 2B: N // B - 1 = 0
    assert pack.pack_windows(docs, 3, T).count() == 0       # T = S
    assert pack.pack_windows(docs, 2, T).count() == 1       # T = S + 1


def test_encode_decode_round_trip(spark):
    d = docs_df(spark, TEXTS)
    c = stream.prepare_corpus(d, "doc", persist=False)
    back = vocab.decode(c.docs.select("doc_id", "ids"), c.vocab, "doc_id", skip_ids=[c.eos_id])
    got = {r["doc_id"]: r["text"] for r in back.collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == " ".join(w for w in t.split() if w != "<eos>")


def test_heldout_unknown_words(spark):
    c = stream.prepare_corpus(docs_df(spark, ["a b c", "b c d"]), "doc", persist=False)
    held = spark.createDataFrame([(0, ["a", "zz", "d"]), (1, [])], "doc_id bigint, words array<string>")
    enc = {r["doc_id"]: list(r["ids"]) for r in vocab.encode_heldout(held, c.vocab, c.vocab_size).collect()}
    assert enc == {0: [0, c.vocab_size, 4], 1: []}
    rate = vocab.oov_rate(held, c.vocab).first()
    assert (rate["n_tokens"], rate["n_oov"]) == (3, 1)


def test_token_budget_and_report(spark):
    d = docs_df(spark, TEXTS)
    t = tokens.doc_tokens(d, "doc")
    sizes = [len(x.split()) + 1 for x in TEXTS]
    got = sorted(r["doc_id"] for r in tokens.token_budget(t, 12).collect())
    acc, want = 0, []
    for i, n in enumerate(sizes):
        if acc + n <= 12:
            want.append(i)
        acc += n
    assert got == want
    rep = tokens.corpus_report(t, 5, "windows").first()
    assert (rep["dataset_tokens"], rep["samples"], rep["learn_tokens"]) == (sum(sizes), sum(sizes) - 5, (sum(sizes) - 5) * 5)


def test_lookup_join_hot_cold_split_matches_broadcast(spark):
    from corpusmill.plans.joins import lookup_join
    words = ["the"] * 50 + ["a"] * 20 + [f"w{i}" for i in range(30)] + ["zz-unknown"] * 3
    fact = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "k bigint, word string")
    dim = spark.createDataFrame([(w, j, words.count(w)) for j, w in enumerate(sorted(set(words) - {"zz-unknown"}))],
                                "word string, id bigint, n bigint")
    for how in ("inner", "left"):
        a = sorted(tuple(r) for r in lookup_join(fact, dim, "word", how=how, weight="n").select("k", "id").collect())
        b = sorted(tuple(r) for r in lookup_join(fact, dim, "word", how=how, weight="n", max_rows=3,
                                                  hot_rows=2).select("k", "id").collect())
        c = sorted(tuple(r) for r in lookup_join(fact, dim, "word", how=how, max_rows=3).select("k", "id").collect())
        assert a == b == c
        assert len(a) == (len(words) if how == "left" else len(words) - 3)


def test_windows_with_stride(spark):
    docs, T = _stream_docs(spark, SEQS)
    data = [x for s in SEQS for x in s]
    got = [(r["sample_id"], list(r["inputs"])) for r in pack.pack_windows(docs, 4, T, stride=3, chunk=5)
           .orderBy("sample_id").collect()]
    assert got == [(i, data[i:i + 4]) for i in range(0, T - 4, 3)]


def test_take_documents_in_one_window_and_in_buckets(spark):
    d = spark.createDataFrame([((i * 37) % 101, "t") for i in range(101)], "doc_id bigint, text string")
    a = sorted(r["doc_id"] for r in tokens.take_documents(d, 13).collect())
    b = sorted(r["doc_id"] for r in tokens.take_documents(d, 13, rows_per_bucket=10).collect())
    assert a == b == list(range(13))


def test_encode_and_decode_agree_on_both_plans_with_a_hot_word(spark):
    texts = ["the " * 200 + "cat", "the dog the", "", "a the b the c", None]
    words = docs_df(spark, texts).select("doc_id", split_words("text").alias("words"))
    v = vocab.build_vocab(words)
    plans = [{}, {"max_rows": 0, "hot_rows": 1}, {"max_rows": 0, "hot_rows": 0}]
    enc = [{r["doc_id"]: (r["n"], r["ids"]) for r in vocab.encode(words, v, **p).collect()} for p in plans]
    assert enc[0] == enc[1] == enc[2] and set(enc[0]) == {0, 1, 3} and enc[0][0] == (201, [0] * 200 + [1])
    held = [{r["doc_id"]: r["ids"] for r in vocab.encode_heldout(words, v.where("word <> 'dog'"), 99, **p).collect()} for p in plans]
    assert held[0] == held[1] == held[2] and held[0][1] == [0, 99, 0] and held[0][2] == held[0][4] == []
    seqs = spark.createDataFrame([(k, ids) for k, ids in held[0].items()], "doc_id bigint, ids array<bigint>")
    back = [{r["doc_id"]: r["text"] for r in vocab.decode(seqs, v, "doc_id", skip_ids=[0], **p).collect()} for p in plans]
    assert back[0] == back[1] == back[2] == {0: "cat", 1: "<unk>", 2: "", 3: "a b c", 4: ""}


def test_encode_moves_documents_not_tokens(spark):
    words = docs_df(spark, ["a b", "b c"]).select("doc_id", split_words("text").alias("words"))
    v = spark.createDataFrame([(0, "a", 1), (1, "b", 2), (2, "c", 1)], "id bigint, word string, n bigint")
    plan = vocab.encode(words, v)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.index("Generate posexplode") < plan.index("Exchange hashpartitioning")  # the one exchange is below the explode
