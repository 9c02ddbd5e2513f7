"""Bench: headline queries at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]``; prints one JSON line.

Every query is forced with a full ``noop`` write (all rows computed, nothing collected).
``pack_windows`` times the operator's full array output (what a training sink consumes);
the registered query of the same name adds an md5 per window for the cross-engine check.
``prepare_line`` / ``prepare_doc`` time the tokenize -> vocabulary -> encoded stream
preparation, which later queries reuse from the checkpoint folder.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "pack_blocks", "pack_windows", "window_sources", "build_vocab", "token_stream", "fit_bigram",
    "masked_perplexity", "perplexity_by_source", "overfit_check", "unigram_baseline", "beam_complete",
    "best_steps", "latest_artifact", "fuzzy_lookup", "softmax_nll", "take_until", "decode", "evaluate",
    "learn_merges", "encode_subword", "subword_windows", "write_samples", "stream_word_counts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from corpusmill.session import drop_scratch, ensure_checkpoint_dir, local_session
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    ensure_checkpoint_dir(spark, tempfile.mkdtemp(prefix="corpusmill-bench-"))
    from corpusmill import catalog

    # JVM / code-generation warm-up on the smallest scale, reported apart from the total
    t0 = time.time()
    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(warm) and warm != sf_dir:
        for name in ("pack_blocks", "fit_bigram"):
            catalog.QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
    warmup = round(time.time() - t0, 3)

    times: dict[str, float] = {}
    t0 = time.time()
    line = catalog.corpus(spark, sf_dir, "line")
    times["prepare_line"] = round(time.time() - t0, 3)
    t0 = time.time()
    doc = catalog.corpus(spark, sf_dir, "doc")
    times["prepare_doc"] = round(time.time() - t0, 3)
    from corpusmill.operators import pack
    # the window operator itself (full inputs/target arrays, as a training sink reads them);
    # the registered query adds an md5 per window for the cross-engine check
    operators = {
        "pack_windows": lambda: pack.assign_batches(pack.pack_windows(doc.docs, catalog.SEQ_LEN, doc.total),
                                                    catalog.BATCH),
    }
    for name in HEADLINE:
        t0 = time.time()
        df = operators[name]() if name in operators else catalog.QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    total = round(sum(times.values()), 3)
    tokens = line.total + doc.total
    out = {
        "metric": "headline_total",
        "value": total,
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
        "tokens_line_mode": line.total,
        "tokens_doc_mode": doc.total,
        "prepare_tokens_per_sec": round(tokens / max(1e-9, times["prepare_line"] + times["prepare_doc"]), 1),
        "cpus": cpus,
        "warmup_sec_excluded": warmup,
        "windows_per_sec": round(max(0, doc.total - catalog.SEQ_LEN) / max(1e-9, times["pack_windows"]), 1),
    }
    print(json.dumps(out))
    drop_scratch(spark)
    spark.stop()


if __name__ == "__main__":
    main()
