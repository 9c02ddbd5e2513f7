"""Property checks (hypothesis): packing equals brute force for random document lengths,
and the prepared stream does not depend on the input's partitioning."""
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from helpers import docs_df
from corpusmill.operators import pack, stream

lengths = st.lists(st.integers(min_value=0, max_value=9), min_size=1, max_size=8)


def _docs(spark, lens):
    rows, off, data = [], 0, []
    for d, n in enumerate(lens):
        ids = [(d * 13 + k * 7) % 11 for k in range(n)]
        rows.append((d, off, n, ids))
        data += ids
        off += n
    return spark.createDataFrame(rows, "doc_id bigint, off bigint, n bigint, ids array<bigint>"), data


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(lens=lengths, S=st.integers(min_value=1, max_value=6), C=st.integers(min_value=1, max_value=7),
       B=st.integers(min_value=1, max_value=6))
def test_packing_matches_brute_force(spark, lens, S, C, B):
    docs, data = _docs(spark, lens)
    T = len(data)
    w = [(r["sample_id"], list(r["inputs"]), list(r["target"]))
         for r in pack.pack_windows(docs, S, T, chunk=C).orderBy("sample_id").collect()]
    assert w == [(i, data[i:i + S], data[i + 1:i + S + 1]) for i in range(max(0, T - S))]
    b = [(r["sample_id"], list(r["inputs"])) for r in pack.pack_blocks(docs, B, T).orderBy("sample_id").collect()]
    assert b == [(i, data[i * B:(i + 1) * B]) for i in range(max(0, T // B - 1))]


def test_prepared_stream_is_partition_independent(spark):
    texts = [f"w{i % 7} w{(i * 3) % 5} x\n" * (i % 4) + f"end{i % 3}" for i in range(60)]
    base = docs_df(spark, texts)
    runs = []
    for parts, rpb in ((1, 1_000_000), (7, 9), (3, 2)):
        c = stream.prepare_corpus(base.repartition(parts), "line", rows_per_bucket=rpb)
        runs.append(([tuple(r) for r in stream.token_stream(c.docs).orderBy("pos").collect()],
                     sorted(tuple(r) for r in c.vocab.collect())))
    assert runs[0] == runs[1] == runs[2]
