"""Oracle SQL (DuckDB dialect) for each registered query.

Each statement recomputes the query's result from the raw tables with
plain SQL, independently of the Spark code: same patterns, same seeded
md5 rules, same rounding.  Float results are rounded identically on both
sides; integers are BIGINT on both sides.
"""

from __future__ import annotations

from casegrain.functions.text import ABBREVIATION_PATTERN, GUARD, SENTENCE_PATTERN, TILE_PATTERN, TOKEN_PATTERN

TOK = TOKEN_PATTERN
TILE = TILE_PATTERN
SENT = SENTENCE_PATTERN
WS_TRIM = r"^[\t\n\x0B\f\r ]+|[\t\n\x0B\f\r ]+$"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '{WS_TRIM}', '', 'g')"


def _sentences(x: str) -> str:
    """Sentences of a text, the dots of abbreviations kept."""
    for _ in range(2):
        x = f"regexp_replace({x}, '{ABBREVIATION_PATTERN}', '\\1\\2{GUARD}', 'g')"
    return f"list_transform(regexp_extract_all({x}, '{SENT}'), lambda s: replace(s, '{GUARD}', '.'))"


def _hex8(x: str) -> str:
    return f"('0x' || substr(md5({x}), 1, 8))::BIGINT"


# Sentences of every document: (doc_id, text, p, sentence), trimmed, non-empty.
SENTS = f"""
sents_raw AS (
  SELECT doc_id, text, unnest(l) AS raw, unnest(range(len(l))) AS p
  FROM (SELECT doc_id, text, {_sentences("coalesce(text, '')")} AS l FROM documents)
),
sents AS (
  SELECT doc_id, text, p, {_trim('raw')} AS sentence FROM sents_raw
  WHERE length({_trim('raw')}) > 0
)"""

# Expert picks of the stand-in rule: (doc_id, expert, rank, p, sentence).
PICKS = SENTS + f""",
tagged AS (
  SELECT s.doc_id, k.k AS expert, s.p, s.sentence,
         {_hex8("'expert:' || k.k || ':' || s.doc_id || ':' || s.p")} AS h
  FROM sents s, (VALUES (1), (2), (3), (4), (5)) k(k)
),
elsewhere AS (
  SELECT item_id, list_filter(list_transform({_sentences("coalesce(text, '')")}, lambda x: {_trim('x')}), lambda x: length(x) > 0)[1] AS sentence
  FROM benchmark
),
picks AS (
  SELECT doc_id, expert::BIGINT AS expert, 'rank' || ((h // 100) % 5 + 1) AS rank, p, sentence
  FROM tagged WHERE h % 100 < 8
  UNION ALL
  SELECT d.doc_id, 1, 'rank5', NULL, e.sentence
  FROM documents d JOIN elsewhere e ON e.item_id = {_hex8("'item:' || d.doc_id")} % 40
  WHERE {_hex8("'foreign:' || d.doc_id")} % 3 = 0 AND e.sentence IS NOT NULL
),
chosen AS (SELECT DISTINCT doc_id, sentence FROM picks),
matched AS (
  SELECT DISTINCT s.doc_id, s.sentence FROM sents s SEMI JOIN chosen c
  ON s.doc_id = c.doc_id AND s.sentence = c.sentence
)"""

# Spans of matched sentences and their window positions.
SPANS = PICKS + f""",
split_parts AS (
  SELECT m.doc_id, m.sentence, d.text, string_split(coalesce(d.text, ''), m.sentence) AS parts
  FROM matched m JOIN documents d USING (doc_id)
),
spans AS (
  SELECT doc_id, sentence, text,
         (list_sum(list_transform(list_slice(parts, 1, i), lambda x: length(x))) + (i - 1) * length(sentence))::BIGINT AS start,
         (list_sum(list_transform(list_slice(parts, 1, i), lambda x: length(x))) + i * length(sentence))::BIGINT AS "end"
  FROM (SELECT *, unnest(range(1, len(parts))) AS i FROM split_parts)
),
span_pos AS (
  SELECT doc_id, sentence, start, "end",
         (len(regexp_extract_all(substr(text, 1, start), '{TOK}'))
           - CASE WHEN start > 0 AND regexp_full_match(substr(text, start, 1), '[\\p{{L}}\\p{{N}}]')
                       AND regexp_full_match(substr(text, start + 1, 1), '[\\p{{L}}\\p{{N}}]') THEN 1 ELSE 0 END
           + 1)::BIGINT AS lo,
         len(regexp_extract_all(substr(text, 1, "end"), '{TOK}'))::BIGINT AS hi
  FROM spans
),
span_ok AS (SELECT * FROM span_pos WHERE lo <= hi),
positives AS (
  SELECT doc_id, (p - 1) // 510 AS window_no, list(DISTINCT (p - 1) % 510 + 1) AS ps FROM (
    SELECT doc_id, unnest(range(lo, hi + 1)) AS p FROM span_ok) GROUP BY doc_id, window_no
),
n_tok AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{TOK}')) AS n FROM documents),
wins AS (SELECT doc_id, n, unnest(range(greatest(1, (n + 509) // 510))) AS window_no FROM n_tok),
masks AS (
  SELECT w.doc_id, w.window_no::BIGINT AS window_no, (least(n - 510 * w.window_no, 510) + 2)::BIGINT AS n_active,
         coalesce(len(pp.ps), 0)::BIGINT AS n_positive,
         array_to_string(list_transform(range(512),
             lambda q: CASE WHEN list_contains(coalesce(pp.ps, []), q) THEN '1' ELSE '0' END), '') AS mask_bits
  FROM wins w LEFT JOIN positives pp USING (doc_id, window_no)
)"""

# Seeded 80/20 split of all (expert) documents: (doc_id, part).
SPLIT = """
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS rn, count(*) OVER () AS n
  FROM documents
),
parts AS (
  SELECT doc_id, CASE WHEN rn <= ceil(0.2 * n) THEN 'validation' ELSE 'train' END AS part FROM ranked
)"""

# Corpus train split: labelled documents with split bucket 0-7.
TRAIN_DOCS = f"""
train_docs AS (
  SELECT d.doc_id, d.text FROM documents d JOIN labels l USING (doc_id)
  WHERE {_hex8("'split:' || d.doc_id")} % 10 < 8
)"""

VOCAB = TRAIN_DOCS + f""",
vocab AS (
  SELECT token, (row_number() OVER (ORDER BY freq DESC, token) + 999)::BIGINT AS token_id, freq::BIGINT AS freq
  FROM (SELECT token, count(*) AS freq FROM (
          SELECT unnest(list_transform(regexp_extract_all(coalesce(text, ''), '{TOK}'), lambda t: lower(t))) AS token
          FROM train_docs) GROUP BY token HAVING count(*) >= 2)
  QUALIFY row_number() OVER (ORDER BY freq DESC, token) <= 1048576
)"""

# Words of the vocabulary and the letters of the training words; other words are cut into the longest of them.
# Pieces: (doc_id, q, id, start, stop, word), q and word from 0. Needs WITH RECURSIVE.
WINDOW_IDS = VOCAB + f""",
letters AS (
  SELECT DISTINCT substr(token, i::BIGINT, 1) AS token FROM (
    SELECT token, unnest(range(1, length(token) + 1)) AS i FROM (
      SELECT DISTINCT unnest(list_transform(regexp_extract_all(coalesce(text, ''), '{TOK}'), lambda t: lower(t))) AS token FROM train_docs))
),
entries AS MATERIALIZED (
  SELECT token, token_id FROM vocab UNION ALL
  SELECT token, (SELECT coalesce(max(token_id), 999) FROM vocab) + row_number() OVER (ORDER BY token) AS token_id
  FROM letters WHERE token NOT IN (SELECT token FROM vocab)
),
tiles AS (
  SELECT doc_id, unnest(l) AS tile, unnest(range(len(l))) AS k
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{TILE}') AS l FROM documents)
),
placed AS (
  SELECT doc_id, tile, k, coalesce(sum(length(tile)) OVER (PARTITION BY doc_id ORDER BY k
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM tiles
),
word AS MATERIALIZED (
  SELECT doc_id, lower(tile) AS token, start, start + length(tile) AS stop, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS word
  FROM placed WHERE NOT regexp_matches(tile, '^[\\t\\n\\x0B\\f\\r ]')
),
rare AS (SELECT DISTINCT token FROM word WHERE token NOT IN (SELECT token FROM entries)),
c1 AS (SELECT token, unnest(range(0, length(token))) AS i FROM rare),
c2 AS (SELECT token, i, unnest(range(1, least((SELECT max(length(token)) FROM entries), length(token) - i) + 1)) AS l FROM c1),
hits AS (SELECT token, i, max(l) AS l FROM c2 WHERE substr(token, i + 1, l) IN (SELECT token FROM entries) GROUP BY token, i),
steps AS MATERIALIZED (SELECT c1.token, c1.i, coalesce(h.l, 1) AS l FROM c1 LEFT JOIN hits h USING (token, i)),
walk AS (
  SELECT s.token, s.i, s.l FROM steps s WHERE i = 0
  UNION ALL
  SELECT s.token, s.i, s.l FROM walk w JOIN steps s ON s.token = w.token AND s.i = w.i + w.l
),
type_pieces AS MATERIALIZED (
  SELECT w.token, w.i, w.l, CASE WHEN e.token_id IS NULL THEN 100 WHEN w.i = 0 THEN e.token_id
         ELSE e.token_id + (SELECT count(*) FROM entries) END AS id
  FROM walk w LEFT JOIN entries e ON e.token = substr(w.token, w.i + 1, w.l)
  UNION ALL SELECT token, 0, length(token), token_id FROM entries
),
piece AS (
  SELECT w.doc_id, w.word, t.id, least(w.start + t.i, w.stop) AS start,
         CASE WHEN t.i + t.l = length(w.token) THEN w.stop ELSE least(w.start + t.i + t.l, w.stop) END AS stop,
         row_number() OVER (PARTITION BY w.doc_id ORDER BY w.word, t.i) - 1 AS q
  FROM word w JOIN type_pieces t USING (token)
),
n_pieces AS (SELECT doc_id, count(p.q) AS n FROM documents LEFT JOIN piece p USING (doc_id) GROUP BY doc_id),
win AS (SELECT doc_id, unnest(range(greatest(1, (n + 509) // 510))) AS window_no FROM n_pieces),
win_ids AS (
  SELECT w.doc_id, w.window_no, coalesce(list(p.id ORDER BY p.q) FILTER (WHERE p.q IS NOT NULL), []) AS ids,
         coalesce(string_agg(p.start || '-' || p.stop, ' ' ORDER BY p.q), '') AS places
  FROM win w LEFT JOIN piece p ON w.doc_id = p.doc_id AND p.q // 510 = w.window_no
  GROUP BY w.doc_id, w.window_no
),
encoded AS (
  SELECT doc_id, window_no::BIGINT AS window_no, len(ids)::BIGINT AS n_tokens, places,
         list_concat([101], ids, [102], list_transform(range(510 - len(ids)), lambda z: 0)) AS input_ids
  FROM win_ids
)"""


ORACLE: dict[str, str] = {
    "corpus_union": "WITH " + PICKS + f""",
labelled AS (
  SELECT d.doc_id, l.quality AS label, d.text, {_hex8("'split:' || d.doc_id")} % 10 AS b
  FROM documents d JOIN labels l USING (doc_id)
),
nexp AS (SELECT doc_id, count(DISTINCT expert)::BIGINT AS n_experts FROM picks GROUP BY doc_id)
SELECT CASE WHEN b < 8 THEN 'train' WHEN b = 8 THEN 'dev' ELSE 'test' END AS split,
       doc_id, label, length(text)::BIGINT AS raw_len,
       CASE WHEN b = 9 THEN NULL ELSE 512 END::BIGINT AS mask_len, 0::BIGINT AS n_experts
FROM labelled
UNION ALL
SELECT 'expert' AS split, d.doc_id, l.quality AS label, length(d.text)::BIGINT AS raw_len, 512::BIGINT AS mask_len,
       coalesce(n.n_experts, 0)::BIGINT AS n_experts
FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN nexp n USING (doc_id)
""",
    "sentence_split": "WITH " + SENTS + """
SELECT doc_id, p::BIGINT AS sent_pos, sentence FROM sents
""",
    "word_tokens": f"""
WITH t AS (
  SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '{TOK}'), lambda x: lower(x)) AS toks
  FROM documents
)
SELECT doc_id, len(toks)::BIGINT AS n_tokens, len(list_distinct(toks))::BIGINT AS n_types,
       coalesce(list_sum(list_transform(toks, lambda x: length(x))), 0)::BIGINT AS token_chars,
       md5(array_to_string(toks, ' ')) AS tokens_md5
FROM t
""",
    "token_offsets": f"""
WITH tl AS (
  SELECT doc_id, unnest(l) AS tile, unnest(range(len(l))) AS tile_pos
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{TILE}') AS l FROM documents)
),
st AS (
  SELECT doc_id, tile, tile_pos,
         coalesce(sum(length(tile)) OVER (PARTITION BY doc_id ORDER BY tile_pos
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM tl
)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY tile_pos) - 1)::BIGINT AS pos,
       lower(tile) AS token, start::BIGINT AS start, (start + length(tile))::BIGINT AS "end"
FROM st WHERE NOT regexp_matches(tile, '^[\\t\\n\\x0B\\f\\r ]')
""",
    "vocab_encode": "WITH " + VOCAB + "\nSELECT token, token_id, freq FROM vocab\n",
    "pad_truncate": "WITH RECURSIVE " + WINDOW_IDS + """
SELECT doc_id, n_tokens, (n_tokens + 2)::BIGINT AS n_attention, array_to_string(input_ids, ' ') AS ids_text
FROM encoded WHERE window_no = 0
""",
    "annotation_parse": "WITH " + PICKS + "\nSELECT doc_id, expert, rank, sentence FROM picks\n",
    "rationale_sentences": "WITH " + PICKS + "\nSELECT doc_id, sentence FROM chosen\n",
    "sentence_match": "WITH " + PICKS + "\nSELECT doc_id, sentence FROM matched\n",
    "span_occurrences": "WITH " + SPANS + "\nSELECT doc_id, sentence, start, \"end\" FROM spans\n",
    "token_span_overlap": "WITH " + SPANS + "\nSELECT doc_id, start, \"end\", lo, hi FROM span_ok\n",
    "rationale_mask": "WITH " + SPANS + "\nSELECT doc_id, window_no, n_active, n_positive, mask_bits FROM masks\n",
    "interval_mask": "WITH " + SPANS + "\nSELECT doc_id, window_no, n_active, n_positive, mask_bits FROM masks\n",
    "rationale_coverage": "WITH " + SPANS + """
SELECT count(*)::BIGINT AS n_windows, sum(n_positive)::BIGINT AS positive_tokens,
       (count(*) * 512)::BIGINT AS padded_tokens, sum(n_active)::BIGINT AS active_tokens,
       round(coalesce(sum(n_positive) / nullif(count(*) * 512, 0), 0.0), 9)::DOUBLE AS coverage_padded,
       round(coalesce(sum(n_positive) / nullif(sum(n_active), 0), 0.0), 9)::DOUBLE AS coverage_active
FROM masks
""",
    "train_val_split": "WITH " + SPLIT + "\nSELECT doc_id, part FROM parts\n",
    "class_weights": "WITH " + SPANS + "," + SPLIT + """,
agg AS (
  SELECT (count(*) * 512)::BIGINT AS total_tokens, coalesce(sum(n_positive), 0)::BIGINT AS positive_tokens,
         coalesce(sum(n_active), 0)::BIGINT AS active_tokens
  FROM masks JOIN parts USING (doc_id) WHERE part = 'train'
)
SELECT total_tokens, positive_tokens, active_tokens,
       round(CASE WHEN positive_tokens = 0 THEN 1.0 ELSE coalesce(total_tokens / nullif(2.0 * (total_tokens - positive_tokens), 0), 1.0) END, 9)::DOUBLE AS weight_negative,
       round(CASE WHEN positive_tokens = 0 THEN 1.0 ELSE coalesce(total_tokens / nullif(2.0 * positive_tokens, 0), 1.0) END, 9)::DOUBLE AS weight_positive,
       round(CASE WHEN positive_tokens = 0 THEN 1.0 ELSE coalesce(active_tokens / nullif(2.0 * (active_tokens - positive_tokens), 0), 1.0) END, 9)::DOUBLE AS weight_negative_active,
       round(CASE WHEN positive_tokens = 0 THEN 1.0 ELSE coalesce(active_tokens / nullif(2.0 * positive_tokens, 0), 1.0) END, 9)::DOUBLE AS weight_positive_active
FROM agg
""",
    "mlm_mask": "WITH RECURSIVE " + WINDOW_IDS + """,
pos AS (SELECT doc_id, window_no, unnest(input_ids) AS id, unnest(range(512)) AS i FROM encoded),
flag AS (
  SELECT doc_id, window_no, i, id NOT IN (0, 101, 102) AS cand,
         id NOT IN (0, 101, 102)
           AND ('0x' || substr(md5('42:' || doc_id || ':' || (window_no * 512 + i)), 1, 8))::BIGINT < 644245094 AS m
  FROM pos
)
SELECT doc_id, window_no, count(*) FILTER (WHERE cand)::BIGINT AS n_candidates, count(*) FILTER (WHERE m)::BIGINT AS n_masked,
       coalesce(string_agg(i::VARCHAR, ' ' ORDER BY i) FILTER (WHERE m), '') AS masked_positions
FROM flag GROUP BY doc_id, window_no
""",
}

# ---- losses over embeddings -------------------------------------------------
PAIRS = """
pairs AS (
  SELECT t.vec_id, (t.vec_id // 8)::BIGINT AS batch, t.embedding::DOUBLE[] AS teacher,
         s.embedding::DOUBLE[] AS student, t.label AS gold,
         ('0x' || substr(md5('mlm:' || t.vec_id), 1, 8))::BIGINT % 100 < 15 AS masked
  FROM embeddings t JOIN embeddings s ON s.vec_id = t.vec_id + 1
),
p1 AS (SELECT *, list_transform(teacher, lambda x: x / 2.0::DOUBLE) AS tz FROM pairs),
p2 AS (SELECT *, list_max(tz) AS tm, list_max(student) AS sm FROM p1),
p3 AS (SELECT *, ln(list_sum(list_transform(tz, lambda x: exp(x - tm)))) AS tl,
              ln(list_sum(list_transform(student, lambda x: exp(x - sm)))) AS sl FROM p2),
p4 AS (SELECT *, list_transform(tz, lambda x: x - tm - tl) AS lp,
              list_transform(student, lambda x: x - sm - sl) AS lq FROM p3),
lrows AS (
  SELECT batch, masked,
         list_sum(list_transform(lp, lambda x, i: exp(x) * (x - lq[i]))) AS kl,
         -lq[gold + 1] AS nll,
         1.0::DOUBLE - list_sum(list_transform(student, lambda x, i: x * teacher[i]))
           / nullif(sqrt(list_sum(list_transform(student, lambda x: x * x)))
                    * sqrt(list_sum(list_transform(teacher, lambda x: x * x))), 0) AS cos
  FROM p4
),
bl AS (
  SELECT batch, count(*)::BIGINT AS n_rows, sum(kl) / count(*) AS kl_loss, avg(nll) AS mlm_loss,
         avg(nll) FILTER (WHERE masked) AS mlm_loss_masked, avg(cos) AS cosine_loss
  FROM lrows GROUP BY batch
),
blc AS (SELECT *, 0.5::DOUBLE * kl_loss + 0.4::DOUBLE * mlm_loss + 0.1::DOUBLE * cosine_loss AS combined_loss FROM bl)"""

EPOCHS = """
lab AS (SELECT d.doc_id, d.n_chars, l.quality AS label FROM documents d JOIN labels l USING (doc_id)),
runs AS (SELECT * FROM (VALUES ('classifier', 3, 200), ('rationale', 10, 300)) r(run, epochs, step)),
eps AS (SELECT unnest(range(1, 11)) AS epoch),
epairs AS (
  SELECT r.run, e.epoch, lab.label, CASE WHEN lab.n_chars > r.step * e.epoch THEN 1 ELSE 0 END AS pred
  FROM lab, runs r, eps e WHERE e.epoch <= r.epochs
),
mc AS (
  SELECT run, epoch::BIGINT AS epoch, count(*)::BIGINT AS n,
         sum(CASE WHEN pred = 1 AND label = 1 THEN 1 ELSE 0 END)::BIGINT AS tp,
         sum(CASE WHEN pred = 1 AND label <> 1 THEN 1 ELSE 0 END)::BIGINT AS fp,
         sum(CASE WHEN pred <> 1 AND label = 1 THEN 1 ELSE 0 END)::BIGINT AS fn,
         sum(CASE WHEN pred <> 1 AND label <> 1 THEN 1 ELSE 0 END)::BIGINT AS tn
  FROM epairs GROUP BY run, epoch
),
mm AS (
  SELECT run, epoch, n, tp, fp, fn, tn,
         round(coalesce((tp + tn)::DOUBLE / nullif(n, 0), 0), 9) AS accuracy,
         round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 9) AS precision,
         round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 9) AS recall,
         round(coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1
  FROM mc
)"""

ORACLE.update({
    "kl_distill_loss": "WITH " + PAIRS + "\nSELECT batch, n_rows, round(kl_loss, 6) AS kl_loss FROM blc\n",
    "cosine_hidden_loss": "WITH " + PAIRS + "\nSELECT batch, n_rows, round(cosine_loss, 6) AS cosine_loss FROM blc\n",
    "mlm_loss": "WITH " + PAIRS + """
SELECT batch, n_rows, round(mlm_loss, 6) AS mlm_loss, round(mlm_loss_masked, 6) AS mlm_loss_masked FROM blc
""",
    "combined_loss": "WITH " + PAIRS + """
SELECT batch, n_rows, round(kl_loss, 6) AS kl_loss, round(mlm_loss, 6) AS mlm_loss,
       round(cosine_loss, 6) AS cosine_loss, round(combined_loss, 6) AS combined_loss FROM blc
""",
    "batch_mean_loss": "WITH " + PAIRS + """
SELECT count(*)::BIGINT AS n_batches, round(avg(combined_loss), 6) AS mean_of_batch_means,
       round(sum(combined_loss * n_rows) / sum(n_rows), 6) AS row_weighted_mean FROM blc
""",
    "weighted_ce": """
WITH tl AS (
  SELECT (vec_id // 8)::BIGINT AS batch, list_slice(embedding::DOUBLE[], 1, 2) AS z, label % 2 AS gold, label < 8 AS active
  FROM embeddings
),
w AS (SELECT count(*) AS n, sum(gold) AS p FROM tl WHERE active),
ww AS (
  SELECT CASE WHEN p = 0 OR p = n THEN 1.0::DOUBLE ELSE n::DOUBLE / (2.0::DOUBLE * (n - p)) END AS wn,
         CASE WHEN p = 0 OR p = n THEN 1.0::DOUBLE ELSE n::DOUBLE / (2.0::DOUBLE * p) END AS wp
  FROM w
),
t2 AS (SELECT *, list_max(z) AS m FROM tl),
t3 AS (SELECT *, ln(list_sum(list_transform(z, lambda x: exp(x - m)))) AS lse FROM t2),
t4 AS (SELECT batch, active, -(z[gold + 1] - m - lse) AS nll, CASE WHEN gold = 1 THEN wp ELSE wn END AS wt FROM t3, ww)
SELECT batch, sum(CASE WHEN active THEN 1 ELSE 0 END)::BIGINT AS n_active,
       round(coalesce(sum(CASE WHEN active THEN wt * nll ELSE 0 END)
                      / nullif(sum(CASE WHEN active THEN wt ELSE 0 END), 0), 0), 6) AS weighted_ce
FROM t4 GROUP BY batch
""",
    "attention_rationale": """
WITH x AS (SELECT label, unnest(embedding::DOUBLE[]) AS w, unnest(range(len(embedding))) AS pos FROM embeddings),
pp AS (SELECT label, pos, avg(w) AS avg_w FROM x GROUP BY label, pos)
SELECT label::BIGINT AS label, pos::BIGINT AS pos, round(round(avg_w, 12), 9) AS avg_weight,
       CASE WHEN round(avg_w, 12) > round(avg(avg_w) OVER (PARTITION BY label), 12) THEN 1 ELSE 0 END::BIGINT AS mask
FROM pp
""",
    "epoch_metrics": "WITH " + EPOCHS + "\nSELECT * FROM mm\n",
    "best_epoch": "WITH " + EPOCHS + """,
rk AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY f1 DESC, epoch) AS r FROM mm),
best AS (SELECT run, epoch AS be, f1 AS bf FROM rk WHERE r = 1 AND f1 > 0),
lst AS (SELECT run, max_by(epoch, epoch) AS le, max_by(f1, epoch) AS lf FROM mm GROUP BY run)
SELECT lst.run, coalesce(be, le)::BIGINT AS best_epoch, coalesce(bf, lf) AS best_f1,
       CASE WHEN be IS NOT NULL THEN 'best' ELSE 'last' END AS saved_by
FROM lst LEFT JOIN best USING (run)
""",
    "highlight_render": "WITH " + SPANS + f""",
hr AS (
  SELECT m.doc_id, m.window_no, m.mask_bits,
         list_slice(list_transform(regexp_extract_all(coalesce(d.text, ''), '{TOK}'), lambda t: lower(t)),
                    m.window_no * 510 + 1, m.window_no * 510 + 510) AS toks
  FROM masks m JOIN documents d USING (doc_id)
)
SELECT doc_id, window_no,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    array_to_string(list_transform(toks, lambda t, i:
      CASE WHEN starts_with(t, '##') AND i > 1 THEN regexp_replace(t, '^##', '')
           ELSE ' ' || CASE WHEN substr(mask_bits, i + 1, 1) = '1' THEN '[' || regexp_replace(t, '^##', '') || ']'
                            ELSE regexp_replace(t, '^##', '') END END), ''),
    '^ ', ''), '\\s+([.,;:!?])', '\\1', 'g'), '\\[\\s+', '[', 'g'), '\\s+\\]', ']', 'g') AS rationale_text
FROM hr
""",
})

# ---- text jobs ----------------------------------------------------------------
from casegrain.operators import cleaning as _CL  # noqa: E402
from casegrain.operators import legal as _LG  # noqa: E402
from casegrain.plans.standins import legal_text_sql  # noqa: E402

LEGAL_DOCS = f"""
legal AS (SELECT doc_id, source, {legal_text_sql()} AS text FROM documents)"""


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _spans_sql(src: str, pattern: str, label_col: str, label: str) -> str:
    """Matches of a pattern with 0-based [start, end) offsets, DuckDB side."""
    p = _q(pattern)
    return f"""
SELECT doc_id, {_q(label)} AS {label_col},
       (coalesce(list_sum(list_transform(list_slice(parts, 1, i), lambda x: length(x))), 0)
        + coalesce(list_sum(list_transform(list_slice(hits, 1, i - 1), lambda x: length(x))), 0))::BIGINT AS start,
       h AS txt
FROM (SELECT *, unnest(hits) AS h, unnest(range(1, len(hits) + 1)) AS i
      FROM (SELECT doc_id, string_split_regex(text, {p}) AS parts, regexp_extract_all(text, {p}) AS hits FROM {src}))"""


def _entity_rows_sql(src: str) -> str:
    parts = [_spans_sql(src, p, "type", t) for t, p in _LG.ENTITY_PATTERNS]
    body = " UNION ALL ".join(f"SELECT doc_id, type, start, start + length(txt) AS \"end\", txt AS text FROM ({x})"
                              for x in parts)
    case = _spans_sql(src, _LG.CASE_PATTERN, "type", "PARTY")
    party = f"""
SELECT doc_id, 'PARTY' AS type, start, start + length(split_part(txt, ' v. ', 1)) AS "end",
       split_part(txt, ' v. ', 1) AS text FROM ({case})
UNION ALL
SELECT doc_id, 'PARTY' AS type, start + length(txt) - length(substr(txt, strpos(txt, ' v. ') + 4)) AS start,
       start + length(txt) AS "end", substr(txt, strpos(txt, ' v. ') + 4) AS text FROM ({case})"""
    return f"SELECT doc_id, type, start::BIGINT AS start, \"end\"::BIGINT AS \"end\", text FROM ({body} UNION ALL {party})"


def _entities_sql() -> str:
    return "WITH " + LEGAL_DOCS + "\n" + _entity_rows_sql("legal") + "\n"


def _citations_cte() -> str:
    parts = [_spans_sql("legal", p, "kind", k) for k, p in _LG.CITATION_PATTERNS]
    body = " UNION ALL ".join(
        f"SELECT doc_id, kind, start::BIGINT AS start, (start + length(txt))::BIGINT AS \"end\", txt AS citation FROM ({x})"
        for x in parts)
    aliases = " UNION ALL ".join(f"SELECT {_q(a)} AS spelling, {_q(b)} AS code" for a, b in _LG.CODE_ALIASES)
    return LEGAL_DOCS + f""",
cites AS ({body}),
aliases AS ({aliases}),
keyed AS (
  SELECT c.*, CASE
    WHEN kind = 'statute' THEN 'statute:' || coalesce(a.code, lower(substr(citation, strpos(citation, ' of the ') + 8)))
                               || ':' || regexp_extract(citation, 'Section ([0-9]+[A-Z]?)', 1)
    WHEN kind = 'case' THEN 'case:' || lower(split_part(citation, ' v. ', 1)) || ' v ' || lower(substr(citation, strpos(citation, ' v. ') + 4))
    ELSE 'reporter:' || regexp_extract(citation, '\\(([0-9]{{4}})\\) ([0-9]+) ([A-Z]{{2,5}}) ([0-9]+)', 3) || ':'
         || regexp_extract(citation, '\\(([0-9]{{4}})\\) ([0-9]+) ([A-Z]{{2,5}}) ([0-9]+)', 1) || ':'
         || regexp_extract(citation, '\\(([0-9]{{4}})\\) ([0-9]+) ([A-Z]{{2,5}}) ([0-9]+)', 2) || ':'
         || regexp_extract(citation, '\\(([0-9]{{4}})\\) ([0-9]+) ([A-Z]{{2,5}}) ([0-9]+)', 4) END AS canonical_key
  FROM cites c LEFT JOIN aliases a ON a.spelling = regexp_extract(c.citation, ' of the (.*)$', 1)
)"""


def _lexicon_sql() -> str:
    rows = " UNION ALL ".join(f"SELECT {_q(t)} AS term, {_q(c)} AS cls, {w} AS w"
                              for c, terms in sorted(_LG.CLAUSE_LEXICON.items()) for t, w in sorted(terms.items()))
    return rows


CLAUSES = LEGAL_DOCS + f""",
ls_raw AS (
  SELECT doc_id, unnest(l) AS raw, unnest(range(len(l))) AS sent_pos
  FROM (SELECT doc_id, {_sentences("text")} AS l FROM legal)
),
ls AS (SELECT doc_id, sent_pos, {_trim('raw')} AS sentence FROM ls_raw WHERE length({_trim('raw')}) > 0),
lt AS (SELECT doc_id, sent_pos, unnest(list_transform(regexp_extract_all(sentence, '{TOK}'), lambda t: lower(t))) AS token FROM ls),
lex AS ({_lexicon_sql()}),
cls_scores AS (SELECT doc_id, sent_pos, cls, sum(w) AS score FROM lt JOIN lex ON lt.token = lex.term GROUP BY ALL),
best AS (
  SELECT doc_id, sent_pos, cls, score FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, sent_pos ORDER BY score DESC, cls) AS r FROM cls_scores) WHERE r = 1
),
clauses AS (
  SELECT ls.doc_id, ls.sent_pos::BIGINT AS sent_pos, CASE WHEN b.score > 0 THEN b.cls ELSE 'other' END AS clause_class,
         coalesce(b.score, 0)::BIGINT AS score
  FROM ls LEFT JOIN best b USING (doc_id, sent_pos)
)"""

SUMMARY = f"""
d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
nd AS (SELECT count(*) AS n FROM d),
dt AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(t, '{TOK}'), lambda x: lower(x))) AS token FROM d),
tf AS (SELECT doc_id, token, count(*) AS tf FROM dt GROUP BY doc_id, token),
idf AS (SELECT token, ln((nd.n + 1)::DOUBLE / (count(*) + 1)) AS idf FROM tf, nd GROUP BY token, nd.n),
s_raw AS (SELECT doc_id, unnest(l) AS raw, unnest(range(len(l))) AS sent_pos
          FROM (SELECT doc_id, {_sentences("t")} AS l FROM d)),
s AS (SELECT doc_id, sent_pos, list_transform(regexp_extract_all({_trim('raw')}, '{TOK}'), lambda x: lower(x)) AS toks FROM s_raw),
st AS (SELECT doc_id, sent_pos, unnest(toks) AS token FROM s WHERE len(toks) >= 3),
sc AS (
  SELECT st.doc_id, st.sent_pos, round(avg(tf.tf * idf.idf), 9) AS score
  FROM st JOIN tf USING (doc_id, token) JOIN idf USING (token) GROUP BY st.doc_id, st.sent_pos
),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, sent_pos) AS rank FROM sc)"""

# The three sentences in document order, as one text.
SUMMARY_TEXT = f""",
sm AS (SELECT r.doc_id, string_agg({_trim('s_raw.raw')}, ' ' ORDER BY r.sent_pos) AS summary
       FROM r JOIN s_raw ON s_raw.doc_id = r.doc_id AND s_raw.sent_pos = r.sent_pos WHERE r.rank <= 3 GROUP BY r.doc_id)"""

ORACLE.update({
    "html_to_text": f"""
WITH t AS (
  SELECT page_id, url,
    regexp_replace(regexp_replace(
      replace(replace(replace(replace(replace(replace(
        regexp_replace(regexp_replace(html, {_q(_CL.SCRIPT_STYLE)}, ' ', 'g'), {_q(_CL.TAG)}, ' ', 'g'),
        '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'),
      '[\\t\\n\\x0B\\f\\r ]+', ' ', 'g'), '^ | $', '', 'g') AS text
  FROM pages
)
SELECT page_id, url, length(text)::BIGINT AS text_len, text FROM t
""",
    "clean_text": f"""
WITH a AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_replace(translate(coalesce(text, ''), {_q(_CL.CURLY_FROM)}, {_q(_CL.CURLY_TO)}), {_q(_CL.CONTROL)}, '', 'g') AS x
  FROM documents
),
b AS (
  SELECT doc_id, text, list_transform(string_split(x, chr(10)),
           lambda l: regexp_replace(regexp_replace(l, '[\\t\\r ]+', ' ', 'g'), '^ | $', '', 'g')) AS ls
  FROM a
),
c AS (
  SELECT doc_id, text,
    regexp_replace(regexp_replace(array_to_string(list_filter(ls, lambda ln, i:
        length(ln) = 0 OR (length(regexp_replace(ln, '[^\\p{{L}}\\p{{N}}]', '', 'g')) * 2
                           >= length(regexp_replace(ln, '[\\t\\n\\x0B\\f\\r ]', '', 'g'))
                           AND list_position(ls, ln) = i)), chr(10)),
      '\\n\\n+', chr(10) || chr(10), 'g'), '^\\n+|\\n+$', '', 'g') AS clean
  FROM b
)
SELECT doc_id, len(string_split(text, chr(10)))::BIGINT AS n_lines_in, len(string_split(clean, chr(10)))::BIGINT AS n_lines_out,
       length(clean)::BIGINT AS clean_len, md5(clean) AS clean_md5
FROM c
""",
    "section_split": "WITH " + LEGAL_DOCS + f""",
ln AS (SELECT doc_id, unnest(l) AS raw, unnest(range(len(l))) AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM legal)),
ln2 AS (SELECT *, regexp_replace(regexp_replace(raw, '[\\t\\r ]+', ' ', 'g'), '^ | $', '', 'g') AS line FROM ln),
ln3 AS (
  SELECT *, length(line) > 0 AND (regexp_matches(line, {_q(_CL.HEADING_NUMBERED)})
            OR (upper(line) = line AND lower(line) <> line AND len(string_split_regex(trim(line), ' +')) <= {_CL.MAX_CAPS_HEADING_WORDS})) AS is_head
  FROM ln2
),
ln4 AS (SELECT *, sum(is_head::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section_no FROM ln3)
SELECT doc_id, section_no::BIGINT AS section_no,
       max(CASE WHEN is_head THEN lower(regexp_replace(line, {_q(_CL.HEADING_PREFIX)}, '')) END) AS heading_key,
       sum(CASE WHEN NOT is_head THEN 1 ELSE 0 END)::BIGINT AS n_lines,
       sum(CASE WHEN NOT is_head THEN length(line) ELSE 0 END)::BIGINT AS body_chars,
       coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT is_head), '') AS body
FROM ln4 GROUP BY doc_id, section_no
""",
    "entity_extract": _entities_sql(),
    "citation_extract": "WITH " + _citations_cte() + "\nSELECT doc_id, kind, start, \"end\", citation FROM cites\n",
    "citation_normalize": "WITH " + _citations_cte() + """
SELECT canonical_key, kind, count(*)::BIGINT AS n_mentions, count(DISTINCT doc_id)::BIGINT AS n_docs
FROM keyed GROUP BY canonical_key, kind
""",
    "extractive_summary": "WITH " + SUMMARY + """
SELECT doc_id, rank::BIGINT AS rank, sent_pos::BIGINT AS sent_pos, score FROM r WHERE rank <= 3
""",
    "summary_text": "WITH " + SUMMARY + SUMMARY_TEXT + "\nSELECT doc_id, summary FROM sm\n",
    "riskiest_clauses": "WITH " + CLAUSES + """,
rk AS (
  SELECT c.doc_id, c.clause_class, c.score, c.sent_pos, ls.sentence,
         CASE clause_class WHEN 'indemnity' THEN 3 WHEN 'termination' THEN 2 WHEN 'confidentiality' THEN 1 ELSE 0 END::BIGINT AS class_risk
  FROM clauses c JOIN ls ON ls.doc_id = c.doc_id AND ls.sent_pos = c.sent_pos
)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY class_risk DESC, score DESC, sent_pos)::BIGINT AS rank,
       clause_class, class_risk, score, sent_pos, sentence
FROM rk WHERE class_risk > 0 QUALIFY rank <= 3
""",
    "clause_classify": "WITH " + CLAUSES + "\nSELECT doc_id, sent_pos, clause_class, score FROM clauses\n",
    "risk_report": "WITH " + CLAUSES + """,
pts AS (
  SELECT doc_id, sum(CASE clause_class WHEN 'indemnity' THEN 3 WHEN 'termination' THEN 2
                                       WHEN 'confidentiality' THEN 1 ELSE 0 END) AS p, count(*) AS n
  FROM clauses GROUP BY doc_id
),
rk AS (
  SELECT doc_id, p::DOUBLE / greatest(n, 1) * 100.0 AS risk FROM pts
),
lv AS (
  SELECT rk.doc_id, l.source, risk, CASE WHEN risk >= 20.0 THEN 'HIGH' WHEN risk >= 5.0 THEN 'MEDIUM' ELSE 'LOW' END AS level
  FROM rk JOIN legal l USING (doc_id)
)
SELECT source, level, count(*)::BIGINT AS n_docs, round(avg(risk), 6) AS avg_risk FROM lv GROUP BY ROLLUP (source, level)
""",
    "precedent_score": "WITH " + _citations_cte() + f""",
hs_raw AS (SELECT doc_id, unnest({_sentences("text")}) AS raw FROM legal),
holders AS (SELECT DISTINCT doc_id FROM hs_raw
            WHERE regexp_matches(lower({_trim('raw')}), {_q("|".join(_LG.HOLDING_CUES))})),
ck AS (SELECT DISTINCT doc_id, canonical_key FROM keyed WHERE kind = 'case'),
per AS (
  SELECT canonical_key, count(*)::BIGINT AS cited_by, count(h.doc_id)::BIGINT AS cited_by_holdings
  FROM ck LEFT JOIN holders h USING (doc_id) GROUP BY canonical_key
),
q AS (SELECT quantile_cont(cited_by, 0.99) AS q99, quantile_cont(cited_by, 0.90) AS q90 FROM per)
SELECT canonical_key, cited_by, cited_by_holdings,
       CASE WHEN cited_by = 0 THEN 'uncited' WHEN cited_by >= q99 THEN 'landmark'
            WHEN cited_by >= q90 THEN 'leading' ELSE 'ordinary' END AS level
FROM per, q
""",
})

# ---- similarity and summary metrics -------------------------------------------
from casegrain.plans.standins import legal_template_sql  # noqa: E402

# Candidate: the extractive summary; reference: the sentences that experts chose, in document order.
SUMMARY_PAIRS = SUMMARY + SUMMARY_TEXT + "," + PICKS + f""",
refs AS (
  SELECT m.doc_id, string_agg(m.sentence, ' ' ORDER BY f.p) AS t
  FROM matched m JOIN (SELECT doc_id, sentence, min(p) AS p FROM sents GROUP BY doc_id, sentence) f USING (doc_id, sentence)
  GROUP BY m.doc_id
),
pairs AS (
  SELECT sm.doc_id::VARCHAR AS pair, list_transform(regexp_extract_all(sm.summary, '{TOK}'), lambda x: lower(x)) AS cand,
         list_transform(regexp_extract_all(refs.t, '{TOK}'), lambda x: lower(x)) AS ref
  FROM sm JOIN refs USING (doc_id)
)"""


def _overlap_cte(n: int) -> str:
    def grams(col):
        return (f"SELECT pair, unnest(list_transform(range(1, len({col}) - {n} + 2), "
                f"lambda i: array_to_string(list_slice({col}, i, i + {n} - 1), ' '))) AS g FROM pairs")
    return f"""
g{n}c AS (SELECT pair, g, count(*) AS c FROM ({grams('cand')}) GROUP BY pair, g),
g{n}r AS (SELECT pair, g, count(*) AS r FROM ({grams('ref')}) GROUP BY pair, g),
o{n} AS (SELECT pair, sum(least(coalesce(c, 0), coalesce(r, 0))) AS overlap
         FROM g{n}c FULL OUTER JOIN g{n}r USING (pair, g) GROUP BY pair),
ov{n} AS (
  SELECT p.pair, {n}::BIGINT AS n, coalesce(o.overlap, 0)::BIGINT AS overlap,
         greatest(len(p.cand) - {n} + 1, 0)::BIGINT AS cand_grams, greatest(len(p.ref) - {n} + 1, 0)::BIGINT AS ref_grams
  FROM pairs p LEFT JOIN o{n} o USING (pair)
)"""


def _prf_sql(o: str, c: str, r: str) -> str:
    p = f"coalesce({o}::DOUBLE / nullif({c}, 0), 0)"
    rr = f"coalesce({o}::DOUBLE / nullif({r}, 0), 0)"
    return (f"round({p}, 9) AS precision, round({rr}, 9) AS recall, "
            f"round(coalesce(2 * {p} * {rr} / nullif({p} + {rr}, 0), 0), 9) AS f1")


ORACLE.update({
    "similarity_topk": """
WITH x AS (SELECT label, unnest(embedding::DOUBLE[]) AS v, unnest(range(len(embedding))) AS pos FROM embeddings),
c AS (SELECT label, pos, avg(v) AS m FROM x GROUP BY label, pos),
cen AS (SELECT label::BIGINT AS query_id, list(m ORDER BY pos) AS q FROM c GROUP BY label),
sc AS (
  SELECT cen.query_id, e.vec_id,
         round(list_sum(list_transform(q, lambda a, i: a * e.embedding[i]::DOUBLE))
               / nullif(sqrt(list_sum(list_transform(q, lambda a: a * a)))
                        * sqrt(list_sum(list_transform(e.embedding::DOUBLE[], lambda a: a * a))), 0), 9) AS cosine
  FROM cen, embeddings e
)
SELECT query_id, rank::BIGINT AS rank, vec_id, cosine
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM sc
      WHERE cosine IS NOT NULL)
WHERE rank <= 5
""",
    "similarity_rows": """
WITH sc AS (
  SELECT a.vec_id AS query_id, e.vec_id,
         round(list_sum(list_transform(a.embedding, lambda x, i: x::DOUBLE * e.embedding[i]::DOUBLE))
               / nullif(sqrt(list_sum(list_transform(a.embedding::DOUBLE[], lambda x: x * x)))
                        * sqrt(list_sum(list_transform(e.embedding::DOUBLE[], lambda x: x * x))), 0), 9) AS cosine
  FROM embeddings a JOIN embeddings e ON a.vec_id % 100 = 0 AND a.vec_id <> e.vec_id
)
SELECT query_id, rank::BIGINT AS rank, vec_id, cosine
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM sc
      WHERE cosine IS NOT NULL)
WHERE rank <= 5
""",
    "kfold_assign": f"""
SELECT d.doc_id, l.quality::BIGINT AS label, ({_hex8("'fold:' || d.doc_id")} % 5)::BIGINT AS fold
FROM documents d JOIN labels l USING (doc_id)
""",
    "predict_rows": f"""
SELECT conv_id, turn, length({_trim("coalesce(text, '')")}) = 0 AS blank, true AS consistent,
       CASE WHEN length({_trim("coalesce(text, '')")}) > 0 THEN md5(regexp_replace(regexp_replace(array_to_string(list_transform(
         regexp_extract_all(text, '{TOK}'), lambda x: lower(x)), ''), '\\[|\\]', '', 'g'), '[\t\n\x0B\f\r ]+', '', 'g')) END AS text_md5
FROM conversations
""",
    "similarity_lsh": f"""
WITH t AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '{TOK}'), lambda x: lower(x)) AS w FROM documents),
sh AS (SELECT doc_id, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS g FROM t WHERE len(w) > 0),
sig AS (SELECT doc_id, g, array_to_string(list_sort(g), chr(1)) AS s FROM sh),
rep AS (SELECT s, min(doc_id) AS rep FROM sig GROUP BY s),
m AS (SELECT sig.doc_id, g, rep FROM sig JOIN rep USING (s)),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM m WHERE doc_id = rep),
p AS (SELECT a.doc_id AS id_a, b.doc_id AS id_b, count(*) AS c, a.n + b.n - count(*) AS u
      FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n)
SELECT rep AS id_a, doc_id AS id_b, 1.0::DOUBLE AS jaccard, 'exact' AS kind FROM m WHERE doc_id <> rep
UNION ALL SELECT id_a, id_b, round(c::DOUBLE / u, 9), 'near' FROM p WHERE c >= 0.8::DOUBLE * u - 1e-9
""",
    "rouge_n": "WITH " + SUMMARY_PAIRS + "," + _overlap_cte(1) + "," + _overlap_cte(2) + f"""
SELECT pair, n, overlap, cand_grams, ref_grams, {_prf_sql('overlap', 'cand_grams', 'ref_grams')}
FROM (SELECT * FROM ov1 UNION ALL SELECT * FROM ov2)
""",
    # Hunt and Szymanski: the places of equal tokens, taken in order of the candidate and backwards in the
    # reference, each replace the first threshold that is not smaller; the thresholds left are as many as the LCS is long.
    "rouge_l": "WITH " + SUMMARY_PAIRS + f""",
ct AS (SELECT pair, unnest(cand) AS w, unnest(range(len(cand))) AS i FROM pairs WHERE cand <> ref),
rt AS (SELECT pair, unnest(ref) AS w, unnest(range(len(ref))) AS j FROM pairs WHERE cand <> ref),
mt AS (SELECT pair, list([j] ORDER BY i, j DESC) AS m FROM ct JOIN rt USING (pair, w) GROUP BY pair),
done AS (
  SELECT p.pair, len(p.cand)::BIGINT AS cand_len, len(p.ref)::BIGINT AS ref_len,
         CASE WHEN cand = ref THEN len(cand) WHEN m IS NULL THEN 0 ELSE len(list_reduce(list_concat([[]::BIGINT[]], m), lambda t, x: list_concat(
           list_filter(t, lambda y: y < x[1]), x, list_slice(t, len(list_filter(t, lambda y: y < x[1])) + 2, len(t))))) END::BIGINT AS lcs
  FROM pairs p LEFT JOIN mt USING (pair)
)
SELECT pair, lcs, cand_len, ref_len, {_prf_sql('lcs', 'cand_len', 'ref_len')} FROM done
""",
    "bleu": "WITH " + SUMMARY_PAIRS + "," + ",".join(_overlap_cte(n) for n in (1, 2, 3, 4)) + """,
t AS (
  SELECT (SELECT sum(overlap) FROM ov1) AS m1, (SELECT sum(cand_grams) FROM ov1) AS c1,
         (SELECT sum(overlap) FROM ov2) AS m2, (SELECT sum(cand_grams) FROM ov2) AS c2,
         (SELECT sum(overlap) FROM ov3) AS m3, (SELECT sum(cand_grams) FROM ov3) AS c3,
         (SELECT sum(overlap) FROM ov4) AS m4, (SELECT sum(cand_grams) FROM ov4) AS c4,
         (SELECT sum(len(cand)) FROM pairs) AS c_len, (SELECT sum(len(ref)) FROM pairs) AS r_len
),
p AS (
  SELECT coalesce(m1::DOUBLE / nullif(c1, 0), 0) AS p1, coalesce(m2::DOUBLE / nullif(c2, 0), 0) AS p2,
         coalesce(m3::DOUBLE / nullif(c3, 0), 0) AS p3, coalesce(m4::DOUBLE / nullif(c4, 0), 0) AS p4,
         CASE WHEN coalesce(c_len, 0) = 0 THEN 0.0 ELSE least(1.0, exp(1 - r_len::DOUBLE / c_len)) END AS bp,
         coalesce(c_len, 0)::BIGINT AS cand_len, coalesce(r_len, 0)::BIGINT AS ref_len
  FROM t
)
SELECT round(p1, 9) AS p1, round(p2, 9) AS p2, round(p3, 9) AS p3, round(p4, 9) AS p4,
       round(bp, 9) AS brevity_penalty,
       round(CASE WHEN p1 = 0 OR p2 = 0 OR p3 = 0 OR p4 = 0 THEN 0.0
                  ELSE bp * exp((ln(p1) + ln(p2) + ln(p3) + ln(p4)) / 4) END, 9) AS bleu,
       cand_len, ref_len
FROM p
""",
    "extractor_prf": "WITH " + LEGAL_DOCS + f""",
tpl AS (SELECT doc_id, {legal_template_sql()} AS text, length(coalesce(text, '')) + 1 AS off FROM documents),
pred AS ({_entity_rows_sql('legal')}),
gold0 AS ({_entity_rows_sql('tpl')}),
gold AS (SELECT g.doc_id, g.type, g.start + t.off AS start, g."end" + t.off AS "end" FROM gold0 g JOIN tpl t USING (doc_id)),
j AS (
  SELECT coalesce(p.type, g.type) AS type, p.doc_id IS NOT NULL AS hp, g.doc_id IS NOT NULL AS hg
  FROM (SELECT DISTINCT doc_id, type, start, "end" FROM pred) p
  FULL OUTER JOIN (SELECT DISTINCT doc_id, type, start, "end" FROM gold) g
  ON p.doc_id = g.doc_id AND p.type = g.type AND p.start = g.start AND p."end" = g."end"
),
agg AS (
  SELECT coalesce(type, 'ALL') AS type,
         sum(CASE WHEN hp AND hg THEN 1 ELSE 0 END)::BIGINT AS tp,
         sum(CASE WHEN hp AND NOT hg THEN 1 ELSE 0 END)::BIGINT AS fp,
         sum(CASE WHEN hg AND NOT hp THEN 1 ELSE 0 END)::BIGINT AS fn
  FROM j GROUP BY ROLLUP (type)
)
SELECT type, tp, fp, fn, {_prf_sql('tp', 'tp + fp', 'tp + fn')} FROM agg
""",
})

# ---- sources and sub-words ----------------------------------------------------
LABELLED_SPLITS = f"""
lsplit AS (
  SELECT d.doc_id, l.quality AS label, d.text,
         CASE WHEN {_hex8("'split:' || d.doc_id")} % 10 < 8 THEN 'train'
              WHEN {_hex8("'split:' || d.doc_id")} % 10 = 8 THEN 'dev' ELSE 'test' END AS split
  FROM documents d JOIN labels l USING (doc_id)
)"""

ORACLE.update({
    "csv_roundtrip": "WITH " + SPANS + "," + LABELLED_SPLITS + """,
whole AS (SELECT doc_id, 512 * count(*) AS mask_len, sum(n_positive) AS mask_sum FROM masks GROUP BY doc_id),
nexp AS (SELECT doc_id, count(DISTINCT expert)::BIGINT AS n_experts FROM picks GROUP BY doc_id)
SELECT split, doc_id, label, md5(text) AS text_md5,
       CASE WHEN split = 'test' THEN NULL ELSE 512 END::BIGINT AS mask_len,
       CASE WHEN split = 'test' THEN NULL ELSE 0 END::BIGINT AS mask_sum, 0::BIGINT AS n_experts
FROM lsplit
UNION ALL
SELECT 'expert' AS split, d.doc_id, l.quality AS label, md5(d.text) AS text_md5, w.mask_len::BIGINT AS mask_len,
       w.mask_sum::BIGINT AS mask_sum, coalesce(n.n_experts, 0)::BIGINT AS n_experts
FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN nexp n USING (doc_id) LEFT JOIN whole w USING (doc_id)
""",
    "token_store": "WITH RECURSIVE " + SPANS + "," + WINDOW_IDS + "," + LABELLED_SPLITS + """,
marked AS (SELECT DISTINCT doc_id, unnest(range(lo - 1, hi)) AS word FROM span_ok),
piece_mask AS (
  SELECT p.doc_id, p.q // 510 AS window_no, list(p.q % 510 + 1) AS ps
  FROM piece p JOIN marked m ON m.doc_id = p.doc_id AND m.word = p.word GROUP BY ALL
),
sp AS (SELECT doc_id, split FROM lsplit UNION ALL SELECT doc_id, 'expert' FROM documents)
SELECT s.split, e.doc_id, e.window_no, (e.n_tokens + 2)::BIGINT AS n_attention,
       md5(array_to_string(e.input_ids, ' ')) AS ids_md5,
       CASE WHEN s.split <> 'train' THEN md5(e.places) END AS offsets_md5,
       CASE WHEN s.split = 'expert' THEN md5(array_to_string(list_transform(range(512),
            lambda q: CASE WHEN list_contains(coalesce(pm.ps, []), q) THEN '1' ELSE '0' END), '')) END AS mask_md5
FROM encoded e JOIN sp s USING (doc_id) LEFT JOIN piece_mask pm ON pm.doc_id = e.doc_id AND pm.window_no = e.window_no
""",
    "subword_segment": "WITH RECURSIVE " + VOCAB + f""",
mp AS (SELECT max(length(token)) AS mx FROM vocab),
types AS (SELECT DISTINCT unnest(list_transform(regexp_extract_all(coalesce(text, ''), '{TOK}'), lambda x: lower(x))) AS token
          FROM documents),
rare AS (SELECT token FROM types WHERE token NOT IN (SELECT token FROM vocab)),
c1 AS (SELECT token, unnest(range(0, length(token))) AS i FROM rare),
c2 AS (SELECT token, i, unnest(range(1, least((SELECT mx FROM mp), length(token) - i) + 1)) AS l FROM c1),
hits AS (SELECT token, i, max(l) AS l FROM c2 WHERE substr(token, i + 1, l) IN (SELECT token FROM vocab) GROUP BY token, i),
steps AS (SELECT c1.token, c1.i, coalesce(h.l, 1) AS l FROM c1 LEFT JOIN hits h USING (token, i)),
seg AS (
  SELECT token, 0::BIGINT AS i, []::VARCHAR[] AS pieces FROM rare
  UNION ALL
  SELECT s.token, s.i + st.l, list_append(s.pieces, CASE WHEN s.i = 0 THEN substr(s.token, 1, st.l)
                                                        ELSE '##' || substr(s.token, s.i + 1, st.l) END)
  FROM seg s JOIN steps st ON st.token = s.token AND st.i = s.i
)
SELECT token, len(pieces)::BIGINT AS n_pieces, array_to_string(pieces, ' ') AS pieces_text
FROM seg WHERE i = length(token)
""",
})
