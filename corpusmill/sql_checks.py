"""Independent DuckDB SQL for every registered query with a SQL form (the correctness oracle).

Written straight from the semantics, with global windows and plain joins -- fine for a
single-node check, and deliberately unlike the Spark plans.
"""

from __future__ import annotations

from corpusmill import catalog as C
from corpusmill.functions.names import EPOCH_STEP, LAST_NAME, NUMBERED, SUFFIX
from corpusmill.operators.scoring import linear_weight
from corpusmill.operators.subword import HEX_CHARACTER

# line / document token CTEs ------------------------------------------------------------
_BASE = r"""
docs_l AS (
  SELECT doc_id, CASE WHEN len(p) > 0 AND p[len(p)] = '' THEN p[1:len(p)-1] ELSE p END AS ls
  FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '\r\n|\r|\n') AS p FROM documents)),
lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM docs_l),
ltok AS (SELECT doc_id, line_no,
         list_append(list_filter(string_split_regex(line, '\s+'), lambda x: x <> ''), '<eos>') AS words FROM lines),
lw AS (SELECT doc_id, flatten(list(words ORDER BY line_no)) AS words FROM ltok GROUP BY doc_id),
dw AS (SELECT doc_id, list_append(list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> ''),
                                  '<eos>') AS words FROM documents),
lt AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS k FROM lw),
lp AS (SELECT doc_id, k, word, row_number() OVER (ORDER BY doc_id, k) - 1 AS pos FROM lt),
lv AS (SELECT CAST(row_number() OVER (ORDER BY min(pos)) - 1 AS BIGINT) AS id, word, CAST(count(*) AS BIGINT) AS n
       FROM lp GROUP BY word),
ls AS (SELECT CAST(lp.pos AS BIGINT) AS pos, lp.doc_id, lp.k, lv.id FROM lp JOIN lv USING (word)),
dt AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS k FROM dw),
dp AS (SELECT doc_id, k, word, row_number() OVER (ORDER BY doc_id, k) - 1 AS pos FROM dt),
dv AS (SELECT CAST(row_number() OVER (ORDER BY min(pos)) - 1 AS BIGINT) AS id, word, CAST(count(*) AS BIGINT) AS n
       FROM dp GROUP BY word),
ds AS (SELECT CAST(dp.pos AS BIGINT) AS pos, dp.doc_id, dp.k, dv.id FROM dp JOIN dv USING (word)),
consts AS (SELECT (SELECT count(*) FROM ls) AS N, (SELECT count(*) FROM ds) AS T,
                  (SELECT count(*) FROM lv) AS V, (SELECT id FROM lv WHERE word = '<eos>') AS eos)"""

# held-out texts encoded against the line vocabulary (unknown -> V)
_HELD = r""",
hw AS (SELECT item_id, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') AS words
       FROM benchmark),
ht AS (SELECT item_id, unnest(words) AS word, generate_subscripts(words, 1) AS k FROM hw),
he AS (SELECT ht.item_id, ht.k, ht.word, coalesce(lv.id, (SELECT V FROM consts)) AS id
       FROM ht LEFT JOIN lv USING (word)),
hi AS (SELECT hw.item_id, coalesce(list(he.id ORDER BY he.k) FILTER (WHERE he.k IS NOT NULL), []::BIGINT[]) AS ids
       FROM hw LEFT JOIN he USING (item_id) GROUP BY hw.item_id)"""

_A = repr(float(C.ALPHA))

# bigram model over the line stream (add-alpha over V + 1 outcomes)
_MODEL = rf""",
pr AS (SELECT lag(id) OVER (ORDER BY pos) AS ctx, id AS nxt FROM ls),
pc AS (SELECT ctx, nxt, count(*) AS n FROM pr WHERE ctx IS NOT NULL GROUP BY ALL),
cc AS (SELECT ctx, sum(n) AS tot FROM pc GROUP BY ctx),
model AS (SELECT pc.ctx, pc.nxt, pc.n,
          ln((pc.n + {_A}) / (cc.tot + {_A} * CAST((SELECT V FROM consts) + 1 AS DOUBLE))) AS lp
          FROM pc JOIN cc USING (ctx))"""


def _lp_expr(n: str, tot: str) -> str:
    v1 = "CAST((SELECT V FROM consts) + 1 AS DOUBLE)"
    return (f"CASE WHEN {n} IS NOT NULL THEN ln(({n} + {_A}) / ({tot} + {_A} * {v1})) "
            f"WHEN {tot} IS NOT NULL THEN ln({_A} / ({tot} + {_A} * {v1})) "
            f"ELSE ln(1.0 / {v1}) END")


def _with(*parts: str) -> str:
    return "WITH " + _BASE + "".join(parts) + "\n"


def _ids(expr: str, order: str) -> str:
    return f"coalesce(string_agg(CAST({expr} AS VARCHAR), ' ' ORDER BY {order}), '')"


def _beams(prompts_cte: str, beams: int, steps: int, prefix: str = "s", succ: str = "succ") -> str:
    """Unrolled beam search CTEs over ``prompts(pid, ids)`` -> final CTE ``{prefix}{steps}``."""
    p = prefix
    out = [rf""",
{succ} AS (SELECT ctx, nxt, lp FROM (SELECT *, row_number() OVER (PARTITION BY ctx ORDER BY n DESC, nxt ASC) AS r
         FROM model) WHERE r <= {beams}),
{p}0 AS (SELECT pid, ids, len(ids) AS plen, 0.0::DOUBLE AS score, false AS done FROM ({prompts_cte}) WHERE len(ids) > 0)"""]
    for k in range(steps):
        out.append(rf""",
{p}{k + 1} AS (SELECT pid, ids, plen, score, done FROM (
  SELECT *, row_number() OVER (PARTITION BY pid ORDER BY score DESC, ids ASC) AS r FROM (
    SELECT pid, ids, plen, score, done FROM {p}{k} WHERE done
    UNION ALL
    SELECT s.pid, CASE WHEN t.nxt IS NULL THEN s.ids ELSE list_append(s.ids, t.nxt) END, s.plen,
           CASE WHEN t.nxt IS NULL THEN s.score ELSE s.score + t.lp END,
           (t.nxt IS NULL OR t.nxt = (SELECT eos FROM consts))
    FROM {p}{k} s LEFT JOIN {succ} t ON t.ctx = s.ids[-1] WHERE NOT s.done))
  WHERE r <= {beams})""")
    return "".join(out)


def _decoded_beams(last: str) -> str:
    """rank-1 beam per pid: (prompt_id, new_ids, text, score)."""
    return rf"""
SELECT b.pid AS prompt_id, array_to_string(b.ids[b.plen + 1:], ' ') AS new_ids,
       coalesce((SELECT string_agg(v.word, ' ' ORDER BY u.k) FROM
                 (SELECT unnest(b.ids[b.plen + 1:]) AS id, generate_subscripts(b.ids[b.plen + 1:], 1) AS k) u
                 JOIN lv v ON v.id = u.id WHERE u.id <> (SELECT eos FROM consts)), '') AS text,
       round(b.score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY score DESC, ids ASC) AS r FROM {last}) b WHERE b.r = 1"""


_CONV = r""",
cv AS (SELECT c.conv_id, c.turn, c.role, c.text FROM conversations c
       WHERE NOT EXISTS (SELECT 1 FROM conversations c2 WHERE c2.conv_id = c.conv_id
                         AND lower(c2.text) IN ('quit', 'exit') AND c2.turn <= c.turn))"""

_LOG = r""",
lg AS (SELECT user_id AS run, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS step,
       CAST(value AS DOUBLE) AS value, event_type, ts FROM events)"""

_FILES = rf""",
files AS (SELECT run AS grp,
   CASE WHEN event_type = 'error' THEN printf('lightning_logs/version_%d/checkpoints', step // 30)
        ELSE 'checkpoints' END AS dir,
   CASE WHEN event_type = 'purchase' THEN 'last.ckpt'
        WHEN event_type = 'view' THEN printf('run%d-%06d.ckpt', run, step)
        WHEN event_type = 'click' THEN printf('run%d-step=%06d.ckpt', run, step)
        WHEN event_type = 'error' THEN printf('epoch=%d-step=%d.ckpt', step // 25, step)
        ELSE printf('run%d-%06d.txt', run, step) END AS name,
   epoch_us(ts) / 1e6 AS mtime
  FROM lg WHERE step % {C.EVERY_N} = 0)"""


def _merge_ctes(steps: int) -> str:
    """Byte-pair merging unrolled: ``w{i}`` holds every distinct word after ``i`` merges, as
    symbols in hexadecimal UTF-8 between spaces; ``b{i}`` is merge ``i``."""
    out = [rf"""
sdw AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') AS words FROM documents),
st AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS k FROM sdw),
w0 AS MATERIALIZED (SELECT word, regexp_replace(hex(word), '({HEX_CHARACTER})', ' \1 ', 'g') AS s, count(*) AS n FROM st GROUP BY word)"""]
    for i in range(steps):
        out.append(rf""",
p{i} AS (SELECT t[k] AS a, t[k + 1] AS b, n FROM (
  SELECT t, n, unnest(range(1, len(t))) AS k FROM (SELECT string_split(trim(s), '  ') AS t, n FROM w{i}))),
b{i} AS MATERIALIZED (SELECT a, b FROM (
  SELECT a, b, row_number() OVER (ORDER BY sum(n) DESC, a, b) AS r FROM p{i} GROUP BY a, b) WHERE r = 1),
w{i + 1} AS MATERIALIZED (SELECT word, CASE WHEN b.a IS NULL THEN s ELSE replace(s, ' ' || b.a || '  ' || b.b || ' ', ' ' || b.a || b.b || ' ') END AS s, n
  FROM w{i} LEFT JOIN b{i} b ON true)""")
    rows = " UNION ALL ".join(f"SELECT {i} AS rank, a, b FROM b{i}" for i in range(steps))
    return "".join(out) + f""",
mg AS (SELECT * FROM ({rows}))"""


def _subword_ctes(steps: int) -> str:
    """Token ids ``sub(doc_id, k, j, id)``: characters by code point, then merged symbols by rank."""
    return _merge_ctes(steps) + rf""",
alpha AS (SELECT sym, row_number() OVER (ORDER BY sym) - 1 AS id FROM (SELECT DISTINCT unnest(string_split(trim(s), '  ')) AS sym FROM w0)),
symid AS (SELECT * FROM alpha UNION ALL
          SELECT sym, row_number() OVER (ORDER BY r) - 1 + (SELECT count(*) FROM alpha)
          FROM (SELECT a || b AS sym, min(rank) AS r FROM mg GROUP BY 1)),
seos AS (SELECT CAST(count(*) AS BIGINT) AS eos FROM symid),
ws AS (SELECT word, unnest(string_split(trim(s), '  ')) AS sym, unnest(range(len(string_split(trim(s), '  ')))) AS j FROM w{steps}),
sub AS (SELECT st.doc_id, st.k, ws.j, CAST(symid.id AS BIGINT) AS id FROM st JOIN ws USING (word) JOIN symid USING (sym)),
sube AS (SELECT * FROM sub UNION ALL SELECT doc_id, 9223372036854775807, 0, (SELECT eos FROM seos) FROM documents)"""


def _blocks_cte() -> str:
    B = C.BLOCK
    return rf""",
blk AS (SELECT i AS sample_id,
          string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos) FILTER (WHERE pos < i * {B} + {B}) AS inputs,
          string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos) FILTER (WHERE pos >= i * {B} + 1) AS target,
          arg_min(id, pos) AS first_input
        FROM (SELECT pos, id, pos // {B} AS i FROM ls
              UNION ALL SELECT pos, id, pos // {B} - 1 AS i FROM ls WHERE pos % {B} = 0 AND pos >= {B})
        WHERE i < (SELECT N FROM consts) // {B} - 1 GROUP BY i)"""


def oracle_sql() -> dict[str, str]:
    B, S, BS = C.BLOCK, C.SEQ_LEN, C.BATCH
    q: dict[str, str] = {}
    q["lines"] = _with() + "SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, line FROM lines"
    q["whole_text"] = "SELECT doc_id, coalesce(text, '') AS text FROM documents"
    q["line_tokens"] = _with() + ("SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(len(words) AS BIGINT) AS n, "
                                  "array_to_string(words, ' ') AS words FROM ltok")
    q["doc_tokens"] = _with() + "SELECT doc_id, CAST(len(words) AS BIGINT) AS n, array_to_string(words, ' ') AS words FROM dw"
    q["doc_lengths"] = _with() + ("SELECT d.doc_id, CAST(coalesce(len(l.words), 0) AS BIGINT) AS n_line, "
                                  "CAST(len(d.words) AS BIGINT) AS n_doc FROM dw d LEFT JOIN lw l USING (doc_id)")
    q["corpus_report"] = _with() + rf"""
SELECT 'blocks' AS packing, CAST({B} AS INTEGER) AS seq_len, CAST(N AS BIGINT) AS dataset_tokens,
       CAST(greatest(N // {B} - 1, 0) AS BIGINT) AS samples, CAST(greatest(N // {B} - 1, 0) * {B} AS BIGINT) AS learn_tokens
FROM consts
UNION ALL
SELECT 'windows', CAST({S} AS INTEGER), CAST(T AS BIGINT), CAST(greatest(T - {S}, 0) AS BIGINT),
       CAST(greatest(T - {S}, 0) * {S} AS BIGINT) FROM consts"""
    q["take_documents"] = f"SELECT doc_id, lang, source, n_chars FROM documents ORDER BY doc_id LIMIT {C.TAKE_N}"
    offs = r"""
SELECT doc_id, CAST(len(words) AS BIGINT) AS n,
       CAST(coalesce(sum(len(words)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
            AS BIGINT) AS off FROM dw"""
    q["token_budget"] = _with() + f"SELECT * FROM ({offs}) WHERE off + n <= {C.BUDGET}"
    q["global_offsets"] = _with() + offs
    q["token_stream"] = _with() + "SELECT pos, doc_id, id FROM ds"
    q["build_vocab"] = _with() + "SELECT id, word, n FROM lv"
    q["vocab_size"] = _with() + ("SELECT 'line' AS mode, CAST(count(*) AS BIGINT) AS vocab_size FROM lv "
                                 "UNION ALL SELECT 'doc', CAST(count(*) AS BIGINT) FROM dv")
    q["encode"] = _with() + f"SELECT doc_id, CAST(count(*) AS BIGINT) AS n, {_ids('id', 'k')} AS ids FROM ls GROUP BY doc_id"
    q["decode"] = _with() + r"""
SELECT lt.doc_id, coalesce(string_agg(lt.word, ' ' ORDER BY lt.k) FILTER (WHERE lt.word <> '<eos>'), '') AS text
FROM lt GROUP BY lt.doc_id"""
    q["encode_heldout"] = _with(_HELD) + ("SELECT item_id, CAST(len(ids) AS BIGINT) AS n, array_to_string(ids, ' ') AS ids, "
                                          "array_to_string(list_transform(ids, lambda x: 1), ' ') AS attention_mask FROM hi")
    q["oov_rate"] = _with(_HELD) + r"""
SELECT CAST(count(*) AS BIGINT) AS n_tokens, CAST(count(*) FILTER (WHERE lv.id IS NULL) AS BIGINT) AS n_oov,
       CASE WHEN count(*) > 0 THEN round(count(*) FILTER (WHERE lv.id IS NULL) / count(*), 6) END AS oov_rate
FROM ht LEFT JOIN lv USING (word)"""
    q["pack_blocks"] = _with(_blocks_cte()) + "SELECT sample_id, inputs, target FROM blk"
    q["pack_windows"] = _with() + rf"""
SELECT pos AS sample_id, pos // {BS} AS batch_id, md5(array_to_string(w[1:{S}], ' ')) AS inputs_md5,
       md5(array_to_string(w[2:{S + 1}], ' ')) AS target_md5
FROM (SELECT pos, list(id ORDER BY pos) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND {S} FOLLOWING) AS w FROM ds)
WHERE pos < (SELECT T FROM consts) - {S}"""
    q["assign_batches"] = _with(_blocks_cte()) + rf"""
SELECT sample_id // {BS} AS batch_id, CAST(count(*) AS BIGINT) AS n_samples, min(sample_id) AS first_sample,
       max(sample_id) AS last_sample FROM blk GROUP BY 1"""
    q["limit_steps"] = _with(_blocks_cte()) + rf"""
SELECT sample_id, sample_id // {BS} AS batch_id, first_input FROM blk WHERE sample_id // {BS} < {C.MAX_STEPS}"""
    q["sample_at"] = _with() + rf""",
o AS (SELECT doc_id, min(pos) AS off FROM ds GROUP BY doc_id)
SELECT o.off AS sample_id,
       string_agg(CAST(ds.id AS VARCHAR), ' ' ORDER BY ds.pos) FILTER (WHERE ds.pos < o.off + {S}) AS inputs,
       string_agg(CAST(ds.id AS VARCHAR), ' ' ORDER BY ds.pos) FILTER (WHERE ds.pos > o.off) AS target
FROM o JOIN ds ON ds.pos BETWEEN o.off AND o.off + {S}
WHERE o.off < (SELECT T FROM consts) - {S} GROUP BY o.off"""
    # every position of every window labelled with its document, then first and last place of each
    q["window_sources"] = _with() + rf""",
x AS (SELECT doc_id, k - 1 AS place, unnest(range(greatest(0, pos - {S}), least(pos + 1, (SELECT T FROM consts) - {S}))) AS i FROM ds)
SELECT CAST(i AS BIGINT) AS sample_id, doc_id, CAST(min(place) AS BIGINT) AS local_start, CAST(max(place) + 1 AS BIGINT) AS local_end
FROM x GROUP BY i, doc_id"""
    first = f"(SELECT * FROM documents QUALIFY row_number() OVER (ORDER BY doc_id) <= {C.TAKE_N}) documents"
    q["first_documents_windows"] = q["pack_windows"].replace("FROM documents", f"FROM {first}")
    fit = ("(SELECT * FROM documents WHERE doc_id IN (WITH " + _BASE + " SELECT doc_id FROM (SELECT doc_id, sum(len(words)) OVER (ORDER BY doc_id) AS upto "
           f"FROM lw) WHERE upto <= {C.BUDGET})) documents")
    q["budget_blocks"] = _with(_blocks_cte()).replace("FROM documents", f"FROM {fit}") + \
        f"SELECT sample_id, sample_id // {BS} AS batch_id, inputs, target FROM blk"
    q["list_shards"] = _with(_blocks_cte()) + rf"""
SELECT 'shard=' || CAST(sample_id // {BS} // {C.SHARD_BATCHES} AS VARCHAR) AS dir, CAST(1 AS BIGINT) AS n_files FROM blk GROUP BY 1"""
    q["vocab_size_by_source"] = _with() + r""",
sw AS (SELECT d.source, dt.word FROM dt JOIN documents d USING (doc_id))
SELECT source, CAST(count(DISTINCT word) AS BIGINT) AS vocab_size, true AS sketch_agrees FROM sw GROUP BY source
UNION ALL SELECT 'all sources', CAST(count(DISTINCT word) AS BIGINT), true FROM sw"""
    q["stream_vocab_sketch"] = _with() + "SELECT CAST(count(*) AS BIGINT) AS vocab_size, true AS sketch_agrees FROM dv"
    q["shift_targets"] = _with(_HELD) + r"""
SELECT item_id, pos, id, next_id FROM (
  SELECT item_id, CAST(k - 1 AS INTEGER) AS pos, id, lead(id) OVER (PARTITION BY item_id ORDER BY k) AS next_id FROM he)
WHERE next_id IS NOT NULL"""
    nll = r"""
(SELECT vec_id, label, -(e[label + 1] - (m + ln(list_sum(list_transform(e, lambda x: exp(x - m)))))) AS nll
 FROM (SELECT vec_id, label, e, list_max(e) AS m
       FROM (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)))"""
    q["softmax_nll"] = f"SELECT vec_id, label, round(nll, 6) AS nll FROM {nll}"
    q["mean_nll"] = (f"SELECT k // {BS} AS batch_id, CAST(count(*) AS BIGINT) AS n, round(avg(nll), 6) AS mean_nll "
                     f"FROM (SELECT nll, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM {nll}) GROUP BY 1")
    linear = ", ".join("(" + " + ".join(f"embedding[{i + 1}]::DOUBLE * {linear_weight(i, o)}" for i in range(64)) + ")"
                       for o in range(C.N_LABELS))
    q["score_batches"] = rf"""
SELECT vec_id, round(m + ln(list_sum(list_transform(e, lambda x: exp(x - m)))) - e[label + 1], 4) AS nll
FROM (SELECT vec_id, label, e, list_max(e) AS m FROM (SELECT vec_id, label, [{linear}] AS e FROM embeddings))"""
    pad = rf""",
pb AS (SELECT item_id, (row_number() OVER (ORDER BY item_id) - 1) // {C.EVAL_BATCH} AS batch_id, ids FROM hi),
pm AS (SELECT batch_id, max(len(ids)) AS m FROM pb GROUP BY batch_id),
padded AS (SELECT pb.item_id, pb.batch_id,
             list_concat(pb.ids, list_transform(range(pm.m - len(pb.ids)), lambda x: cs.eos)) AS input_ids,
             list_concat(list_transform(range(len(pb.ids)), lambda x: 1),
                         list_transform(range(pm.m - len(pb.ids)), lambda x: 0)) AS attention_mask
           FROM pb JOIN pm USING (batch_id) CROSS JOIN consts cs)"""
    q["pad_batch"] = _with(_HELD, pad) + r"""
SELECT item_id, batch_id, array_to_string(input_ids, ' ') AS input_ids,
       array_to_string(attention_mask, ' ') AS attention_mask FROM padded"""
    ppl_cte = _HELD + pad + _MODEL + rf""",
pu AS (SELECT item_id, input_ids, attention_mask, unnest(range(1, len(input_ids))) AS pos FROM padded),
ppos AS (SELECT item_id, pos, input_ids[pos] AS ctx, input_ids[pos + 1] AS id, attention_mask[pos + 1] AS mask FROM pu),
pscore AS (SELECT ppos.*, {_lp_expr('model.n', 'cc.tot')} AS lp
           FROM ppos LEFT JOIN model ON model.ctx = ppos.ctx AND model.nxt = ppos.id LEFT JOIN cc ON cc.ctx = ppos.ctx),
pagg AS (SELECT CAST(sum(mask) AS BIGINT) AS n_scored, sum(-lp * mask) / sum(mask) AS loss FROM pscore)"""
    q["masked_perplexity"] = _with(ppl_cte) + r"""
SELECT n_scored, round(loss, 6) AS loss, round(exp(loss), 6) AS perplexity, printf('%.2f', exp(loss)) AS perplexity_str
FROM pagg"""
    q["unigram_baseline"] = _with() + r""",
tg AS (SELECT id, count(*) AS n FROM ls WHERE pos >= 1 GROUP BY id),
tt AS (SELECT sum(n) AS t FROM tg)
SELECT CAST(tt.t AS BIGINT) AS n_tokens, CAST(count(*) AS BIGINT) AS n_types,
       round(-sum((tg.n / tt.t) * ln(tg.n / tt.t)), 6) AS entropy FROM tg, tt GROUP BY tt.t"""
    q["fit_bigram"] = _with(_MODEL) + 'SELECT ctx, nxt AS "next", CAST(n AS BIGINT) AS n, round(lp, 6) AS lp FROM model'
    q["fit_unigram"] = _with() + rf""",
tg AS (SELECT id, count(*) AS n FROM ls WHERE pos >= 1 GROUP BY id)
SELECT id AS "next", CAST(n AS BIGINT) AS n,
       round(ln((n + {_A}) / ((SELECT sum(n) FROM tg) + {_A} * CAST((SELECT V FROM consts) + 1 AS DOUBLE))), 6) AS lp
FROM tg"""
    q["score_heldout"] = _with(_HELD, _MODEL) + rf""",
hp AS (SELECT item_id, CAST(k - 1 AS INTEGER) AS pos, lag(id) OVER (PARTITION BY item_id ORDER BY k) AS ctx, id FROM he)
SELECT hp.item_id, hp.pos, hp.ctx, hp.id, round({_lp_expr('model.n', 'cc.tot')}, 6) AS lp
FROM hp LEFT JOIN model ON model.ctx = hp.ctx AND model.nxt = hp.id LEFT JOIN cc ON cc.ctx = hp.ctx
WHERE hp.pos >= 1"""
    for key, col in (("perplexity_by_source", "source"), ("perplexity_by_lang", "lang")):
        q[key] = _with(_HELD) + rf""",
gp AS (SELECT d.{col} AS g, lag(ls.id) OVER (ORDER BY ls.pos) AS ctx, ls.id AS nxt FROM ls JOIN documents d USING (doc_id)),
gpc AS (SELECT g, ctx, nxt, count(*) AS n FROM gp WHERE ctx IS NOT NULL GROUP BY ALL),
gcc AS (SELECT g, ctx, sum(n) AS tot FROM gpc GROUP BY ALL),
hp AS (SELECT * FROM (SELECT lag(id) OVER (PARTITION BY item_id ORDER BY k) AS ctx, id AS nxt FROM he) WHERE ctx IS NOT NULL),
grp AS (SELECT DISTINCT g FROM gcc),
sc AS (SELECT grp.g, {_lp_expr('gpc.n', 'gcc.tot')} AS lp
       FROM grp CROSS JOIN hp LEFT JOIN gcc ON gcc.g = grp.g AND gcc.ctx = hp.ctx
       LEFT JOIN gpc ON gpc.g = grp.g AND gpc.ctx = hp.ctx AND gpc.nxt = hp.nxt)
SELECT g AS {col}, CAST(count(*) AS BIGINT) AS n_scored, round(-avg(lp), 6) AS loss, round(exp(-avg(lp)), 6) AS perplexity
FROM sc GROUP BY g"""
    q["overfit_check"] = _with() + rf""",
bp AS (SELECT pos, pos // {B} // {BS} AS batch_id, id AS ctx, lead(id) OVER (ORDER BY pos) AS nxt FROM ls),
bq AS (SELECT * FROM bp WHERE pos // {B} < (SELECT N FROM consts) // {B} - 1),
opc AS (SELECT batch_id, ctx, nxt, count(*) AS n FROM bq GROUP BY ALL),
occ AS (SELECT batch_id, ctx, sum(n) AS nc FROM opc GROUP BY ALL),
otc AS (SELECT batch_id, nxt, sum(n) AS nt FROM opc GROUP BY ALL),
otot AS (SELECT batch_id, sum(nt) AS P FROM otc GROUP BY ALL),
big AS (SELECT batch_id, sum(-n * ln(n / nc)) AS b FROM opc JOIN occ USING (batch_id, ctx) GROUP BY ALL),
uni AS (SELECT batch_id, sum(-nt * ln(nt / P)) AS u FROM otc JOIN otot USING (batch_id) GROUP BY ALL)
SELECT batch_id, CAST(P AS BIGINT) AS n_pairs, round(b / P, 6) AS bigram_nll, round(u / P, 6) AS unigram_nll
FROM big JOIN uni USING (batch_id) JOIN otot USING (batch_id)"""
    greedy_prompts = "SELECT 0::BIGINT AS pid, [(SELECT eos FROM consts)]::BIGINT[] AS ids"
    q["greedy_from_eos"] = _with(_MODEL, _beams(greedy_prompts, 1, C.GREEDY_LEN - 1)) + \
        _decoded_beams(f"s{C.GREEDY_LEN - 1}")
    conv_prompts = r"""
SELECT {'conv_id': cv.conv_id, 'turn': cv.turn} AS pid,
       coalesce(list(coalesce(lv.id, (SELECT V FROM consts)) ORDER BY w.k) FILTER (WHERE w.k IS NOT NULL), []::BIGINT[]) AS ids
FROM cv LEFT JOIN (SELECT conv_id, turn, unnest(ws) AS word, generate_subscripts(ws, 1) AS k FROM
                   (SELECT conv_id, turn, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ws FROM cv)) w
     USING (conv_id, turn)
LEFT JOIN lv ON lv.word = w.word
WHERE cv.role = 'user' AND regexp_matches(coalesce(cv.text, ''), '\S')
GROUP BY cv.conv_id, cv.turn"""
    beams = _with(_CONV, _MODEL, _beams(conv_prompts, C.BEAMS, C.MAX_NEW)) + _decoded_beams(f"s{C.MAX_NEW}")
    q["beam_complete"] = f"SELECT prompt_id.conv_id AS conv_id, prompt_id.turn AS turn, new_ids, text, score FROM ({beams})"
    # evaluate: open-ended sample + held-out perplexity + completion of every held-out text
    ev = _with(ppl_cte, _beams(greedy_prompts, 1, C.GREEDY_LEN - 1))
    ev_g = _decoded_beams(f"s{C.GREEDY_LEN - 1}")
    beams2 = _beams("SELECT item_id AS pid, ids FROM hi", C.BEAMS, C.CHECK_NEW, prefix="e", succ="succ2")
    q["evaluate"] = ev.rstrip("\n") + beams2 + "\n" + rf"""
SELECT 'open_ended' AS item, prompt_id AS key, text, score FROM ({ev_g})
UNION ALL
SELECT 'perplexity', 0::BIGINT, printf('%.2f', exp(loss)), round(exp(loss), 6) FROM pagg
UNION ALL
SELECT 'completion', prompt_id, text, score FROM ({_decoded_beams(f"e{C.CHECK_NEW}")})"""
    q["take_until"] = _with(_CONV) + "SELECT conv_id, turn, role FROM cv"
    q["require_nonblank"] = r"SELECT conv_id, turn FROM conversations WHERE regexp_matches(coalesce(text, ''), '\S')"
    q["take_until_short"] = rf"""
SELECT c.conv_id, c.turn, c.role FROM conversations c LEFT JOIN
  (SELECT conv_id, min(turn) AS stop FROM conversations WHERE length(text) < {C.SHORT_TURN} GROUP BY conv_id) s USING (conv_id)
WHERE s.stop IS NULL OR c.turn < s.stop"""
    q["nonblank_rest"] = rf"SELECT conv_id, turn FROM conversations WHERE regexp_matches(coalesce(substr(text, {C.SHORT_TURN + 1}), ''), '\S')"
    q["metric_log"] = "WITH " + _LOG.lstrip(",") + "\nSELECT run, step, value FROM lg"
    q["best_steps"] = "WITH " + _LOG.lstrip(",") + rf""",
top AS (SELECT run, step, value FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY value, step) AS r
        FROM lg WHERE step % {C.EVERY_N} = 0) WHERE r <= {C.TOP_K}),
lst AS (SELECT run, max(step) AS step FROM lg GROUP BY run)
SELECT run, step, value, bool_or(is_top) AS is_top, bool_or(is_last) AS is_last FROM (
  SELECT run, step, value, true AS is_top, false AS is_last FROM top
  UNION ALL SELECT l.run, l.step, g.value, false, true FROM lst l JOIN lg g USING (run, step))
GROUP BY run, step, value"""
    q["artifact_listing"] = "WITH " + _LOG.lstrip(",") + _FILES + r"""
SELECT grp, dir, name, round(mtime, 3) AS mtime FROM files WHERE suffix(name, '.ckpt') AND name <> 'last.ckpt'"""
    q["latest_artifact"] = "WITH " + _LOG.lstrip(",") + _FILES + rf""",
ft AS (SELECT grp, dir, name,
   CASE WHEN dir = 'checkpoints' AND name = '{LAST_NAME}' THEN 1
        WHEN dir = 'checkpoints' AND suffix(name, '{SUFFIX}') AND name <> '{LAST_NAME}'
             AND regexp_matches(name, '{NUMBERED}') THEN 2
        WHEN starts_with(dir, 'lightning_logs/') AND suffix(dir, '/checkpoints') AND len(string_split(dir, '/')) = 3
             AND suffix(name, '{SUFFIX}') AND regexp_matches(name, '{EPOCH_STEP}') THEN 3 END AS tier,
   name AS nm FROM files),
fr AS (SELECT *, CASE WHEN tier = 2 THEN CAST(regexp_extract(nm, '{NUMBERED}', 1) AS BIGINT)
                      WHEN tier = 3 THEN CAST(regexp_extract(nm, '{EPOCH_STEP}', 1) AS BIGINT)
                      ELSE 0 END AS a,
              CASE WHEN tier = 3 THEN CAST(regexp_extract(nm, '{EPOCH_STEP}', 2) AS BIGINT) ELSE 0 END AS b
       FROM ft WHERE tier IS NOT NULL)
SELECT grp, CAST(tier AS INTEGER) AS tier, dir || '/' || name AS path FROM (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY tier, a DESC, b DESC, dir DESC, name DESC) AS r FROM fr)
WHERE r = 1"""
    q["fuzzy_lookup"] = r"""
WITH qy AS (SELECT DISTINCT query FROM (SELECT p_type AS query FROM part UNION ALL SELECT p_brand FROM part
                                        UNION ALL SELECT regexp_extract(p_brand, '(\d+)', 1) FROM part)),
st AS (SELECT query, unnest(range(1, length(query) + 1)) AS s FROM qy),
qs AS (SELECT query, s, unnest(range(1, length(query) - s + 2)) AS l FROM st),
hits AS (SELECT qs.query, qs.l, min(p.p_partkey) AS ord FROM qs JOIN part p ON contains(p.p_name, substr(qs.query, qs.s, qs.l))
         GROUP BY qs.query, qs.l),
best AS (SELECT h.query, h.l, min(h.ord) AS ord FROM hits h
         JOIN (SELECT query, max(l) AS m FROM hits GROUP BY query) mx ON mx.query = h.query AND mx.m = h.l
         GROUP BY h.query, h.l),
newest AS (SELECT first(p_name ORDER BY greatest(CAST(p_size AS DOUBLE), 0.0) DESC, p_partkey) AS p_name FROM part)
SELECT qy.query, coalesce(p.p_name, (SELECT p_name FROM newest)) AS name, CAST(coalesce(best.l, 0) AS INTEGER) AS match_size
FROM qy LEFT JOIN best USING (query) LEFT JOIN part p ON p.p_partkey = best.ord"""
    q["land_once"] = "SELECT item_id, text FROM benchmark"
    q["write_samples"] = _with(_blocks_cte()) + rf"""
SELECT sample_id, sample_id // {BS} AS batch_id, sample_id // {BS} // 50 AS shard, inputs, target FROM blk"""
    q["append_metrics"] = "WITH " + _LOG.lstrip(",") + "\nSELECT run, step, 'train_loss' AS name, value FROM lg"
    q["stream_tokenize"] = _with() + "SELECT doc_id, CAST(k - 1 AS INTEGER) AS k, word, id FROM dt JOIN dv USING (word)"
    q["stream_word_counts"] = _with() + "SELECT word, CAST(count(*) AS BIGINT) AS n FROM dt GROUP BY word"
    merged = "WITH " + _merge_ctes(C.N_MERGES).lstrip()
    q["learn_merges"] = merged + """
SELECT CAST(rank AS INTEGER) AS rank, decode(unhex(a)) AS "left", decode(unhex(b)) AS "right" FROM mg"""
    subwords = "WITH " + _subword_ctes(C.N_MERGES).lstrip()
    q["encode_subword"] = subwords + f"""
SELECT doc_id, CAST(count(*) AS BIGINT) AS n, {_ids('id', 'k, j')} AS ids FROM sube GROUP BY doc_id"""
    q["subword_windows"] = subwords + rf""",
ps AS (SELECT row_number() OVER (ORDER BY doc_id, k, j) - 1 AS pos, id FROM sube),
wi AS (SELECT pos, id, unnest(range(greatest(0, -(-(pos - {S}) // {C.STRIDE})), pos // {C.STRIDE} + 1)) * {C.STRIDE} AS i FROM ps)
SELECT CAST(i AS BIGINT) AS sample_id, CAST(i // {BS} AS BIGINT) AS batch_id,
       md5(string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos) FILTER (WHERE pos < i + {S})) AS inputs_md5,
       md5(string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos) FILTER (WHERE pos > i)) AS target_md5
FROM wi WHERE i < (SELECT count(*) FROM ps) - {S} AND pos BETWEEN i AND i + {S} GROUP BY i"""
    q["whole_text_blocks"] = subwords + rf""",
ps AS (SELECT row_number() OVER (ORDER BY doc_id, k, j) - 1 AS pos, id FROM sub),
bi AS (SELECT pos, id, pos // {S} AS i FROM ps UNION ALL SELECT pos, id, pos // {S} - 1 FROM ps WHERE pos % {S} = 0 AND pos > 0)
SELECT CAST(i AS BIGINT) AS sample_id,
       string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos) FILTER (WHERE pos < (i + 1) * {S}) AS inputs,
       string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos) FILTER (WHERE pos > i * {S}) AS target
FROM bi WHERE i < (SELECT count(*) FROM ps) // {S} - 1 GROUP BY i"""
    q["stream_metrics"] = ("SELECT user_id AS run, event_type AS name, value, "
                           "strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM events")
    return q
