"""DuckDB SQL for the rows of the queries that SQL can express, over the same tables.

Not here: the fitted toxicity model, both tokenizers and the sharding checksum, which DuckDB lacks;
the tests check those against brute-force versions.
"""

from __future__ import annotations

from casegrain.llm import decontaminate, line_dedup, quality, url_filter

UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOW = f"translate(coalesce(text, ''), '{UPPER}', '{LOWERED}')"
SPACED = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# White space of the line and quality rules, as a DuckDB string.
BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

NGRAM_JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOW}, '{SPACED}') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
l AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, c.component_id FROM s JOIN c ON c.x = s.doc_id
"""

_SLOP = decontaminate.SLOP
DECONTAMINATE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOW}, '{ALNUM}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOW}, '{ALNUM}') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS t
        FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS t
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT dw.doc_id, dw.i, dw.n, win.item_id FROM dw JOIN win ON dw.n = win.n AND dw.t = win.t),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id),
pos AS (SELECT doc_id, unnest(w) AS term, unnest(range(0, len(w))) AS p FROM d),
df AS (SELECT term, count(*) AS f FROM pos GROUP BY term),
tw AS (SELECT t, n, unnest(string_split(t, ' ')) AS term, unnest(range(0, n)) AS j FROM (SELECT DISTINCT t, n FROM win)),
an AS (SELECT tw.*, row_number() OVER (PARTITION BY t ORDER BY coalesce(f, 0), j) AS r FROM tw LEFT JOIN df USING (term)),
cand AS (SELECT an.t, an.n, an.j AS a, pos.doc_id, pos.p - an.j AS s FROM an JOIN pos ON an.r = 1 AND an.term = pos.term),
nw AS (SELECT cand.t, cand.doc_id FROM cand JOIN tw ON tw.t = cand.t
       LEFT JOIN pos ON pos.doc_id = cand.doc_id AND pos.term = tw.term AND pos.p BETWEEN cand.s + tw.j - {_SLOP} AND cand.s + tw.j + {_SLOP}
       GROUP BY cand.t, cand.n, cand.doc_id, cand.s HAVING count(DISTINCT CASE WHEN pos.p IS NOT NULL THEN tw.j END) = cand.n),
ni AS (SELECT nw.doc_id, count(DISTINCT win.item_id) AS n FROM nw JOIN win ON win.t = nw.t GROUP BY nw.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(it.n_items, 0) AS n_items,
       sha256(coalesce(it.s, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated,
       coalesce(ni.n, 0) AS n_near_items
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN ni USING (doc_id)
"""

_PIPES = r"regexp_replace({0}, '<(\|+)', '<|\1', 'g')"
CHAT_FORMAT = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
           UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<|im_start|>') + length({_PIPES.format("replace(replace(role, '\\', '\\\\'), chr(10), '\\n')")}) + 1
                + length({_PIPES.format('text')}) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars,
       CAST(0 AS BIGINT) AS attachment_tokens
FROM t GROUP BY conv_id
"""

# Edit distance in code points: DuckDB's levenshtein counts bytes (up to four of a character), so it only
# sifts; the distance itself is a plain dynamic program, a row of it per character.
_K = line_dedup.EDITS
LINE_DEDUP = f"""
WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw,
                    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL),
o AS (SELECT doc_id, line_no, trim(raw, {BLANK}) AS line FROM raw WHERE length(trim(raw, {BLANK})) >= {line_dedup.LEAST_CHARS}),
f AS (SELECT line, min((doc_id, line_no)) AS first FROM o GROUP BY line),
exact AS (SELECT o.doc_id, o.line_no FROM o JOIN f USING (line) WHERE (o.doc_id, o.line_no) <> f.first),
c AS (SELECT line, first, length(line) AS n, {", ".join(f"length(line) - length(replace(line, '{x}', '')) AS c{x}" for x in "etaonrihsl")}
      FROM f WHERE length(line) >= {line_dedup.NEAR_CHARS}),
p AS (SELECT a.line AS x, b.line AS y, b.first AS later FROM c a JOIN c b
      ON b.n BETWEEN a.n - {_K} AND a.n + {_K} AND a.first < b.first
      AND {" + ".join(f"abs(a.c{x} - b.c{x})" for x in "etaonrihsl")} <= {2 * _K}
      WHERE levenshtein(a.line, b.line) <= {4 * _K}),
steps AS (SELECT later, x, y, string_split(x, '') AS cx, string_split(y, '') AS cy FROM p),
near AS (
  WITH RECURSIVE rows(later, cx, cy, i, d) AS (
    SELECT later, cx, cy, 0, range(0, len(cy) + 1) FROM steps
    UNION ALL
    SELECT later, cx, cy, i + 1, list_reduce(range(1, len(cy) + 1), lambda acc, j: list_append(acc, least(
             acc[len(acc)] + 1, d[j + 1] + 1, d[j] + CASE WHEN cx[i + 1] = cy[j] THEN 0 ELSE 1 END)), [CAST(i + 1 AS BIGINT)])
    FROM rows WHERE i < len(cx))
  SELECT DISTINCT later FROM rows WHERE i = len(cx) AND d[len(d)] <= {_K}),
gone AS (SELECT doc_id, line_no, false AS near FROM exact
         UNION ALL SELECT struct_extract(later, 1), struct_extract(later, 2), true FROM near),
per AS (SELECT doc_id, count(*) FILTER (NOT near) AS n_exact, count(*) FILTER (near) AS n_near,
               string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) AS dropped FROM gone GROUP BY doc_id),
kept AS (SELECT r.doc_id, string_agg(r.raw, chr(10) ORDER BY r.line_no) AS text FROM raw r
         WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = r.doc_id AND g.line_no = r.line_no) GROUP BY r.doc_id)
SELECT d.doc_id, CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS BIGINT) AS n_lines,
       coalesce(per.n_exact, 0) AS n_exact, coalesce(per.n_near, 0) AS n_near,
       per.doc_id IS NOT NULL AND trim(coalesce(kept.text, ''), {BLANK}) = '' AS emptied,
       coalesce(per.dropped, '') AS dropped_lines, sha256(coalesce(kept.text, '')) AS text_sha256
FROM documents d LEFT JOIN per USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_SIGNALS = {
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / n_lines",
    "word_length": "word_chars / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "shortness": "1 / greatest(n_words, 1)",
}
_CELLS = [(s, c) for s, cs in quality.GRID.items() for c in cs]
QUALITY_RULES = rf"""
WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS t
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
rep AS (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (
          SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS n FROM g) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM rep GROUP BY doc_id),
st AS (SELECT w.doc_id, w.lang, CAST(len(w.w) AS BIGINT) AS n_words,
              CAST(coalesce(list_sum([length(x) FOR x IN w.w]), 0) AS BIGINT) AS word_chars,
              CAST(length(w.text) - length(regexp_replace(w.text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
              [x FOR x IN string_split(w.text, chr(10)) IF trim(x, {BLANK}) <> ''] AS ls,
              CAST(len(string_split(w.text, chr(10))) AS BIGINT) AS n_lines,
              coalesce(cov.n, 0) AS n_repeat_words
       FROM w LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM st),
sig AS (SELECT *, {", ".join(f"CAST({e} AS DOUBLE) AS {s}" for s, e in _SIGNALS.items())} FROM b),
lab AS (SELECT doc_id, min(quality) > 0 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
cal AS (SELECT sig.*, lab.good FROM sig JOIN lab USING (doc_id) WHERE NOT base_failed AND lang IS NOT NULL),
cells AS ({" UNION ALL ".join(
    f"SELECT lang, '{s}' AS signal, CAST({c!r} AS DOUBLE) AS cutoff, count(*) FILTER (good) AS n, "
    f"count(*) FILTER (good AND {s} > {c!r}) AS k, count(*) FILTER (NOT good AND {s} > {c!r}) AS bad FROM cal GROUP BY lang"
    for s, c in _CELLS)}),
p AS (SELECT *, CASE WHEN k >= n * {quality.ALPHA / len(quality.GRID)!r} THEN 1.0 ELSE list_sum([
        exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({quality.ALPHA / len(quality.GRID)!r})
            + (n - i) * ln(1 - {quality.ALPHA / len(quality.GRID)!r})) FOR i IN range(0, k + 1)]) END AS pv FROM cells),
ok AS (SELECT * FROM p WHERE pv <= {quality.DELTA!r} / ((SELECT count(DISTINCT lang) FROM cal) * {len(_CELLS)}) AND bad > k),
cut AS (SELECT lang, signal, cutoff FROM ok
        QUALIFY row_number() OVER (PARTITION BY lang, signal ORDER BY bad - k DESC, cutoff DESC) = 1),
rules AS (SELECT lang, {", ".join(f"max(cutoff) FILTER (signal = '{s}') AS r_{s}" for s in quality.GRID)} FROM cut GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ({" OR ".join(f"coalesce({s} > r_{s}, false)" for s in quality.GRID)}) AS kept,
       concat_ws(',', {", ".join(f"CASE WHEN {s} > r_{s} THEN '{s}' END" for s in quality.GRID)}) AS broken_rules
FROM sig LEFT JOIN rules USING (lang)
"""


def _url_levels() -> str:
    """The levels of the template tree, one after the other: node and chain of every masked path."""
    out = ["v0 AS (SELECT host, masked, n, labelled, bad, seg, '' AS node, CAST([] AS VARCHAR[]) AS nodes FROM segs)"]
    for d in range(url_filter.DEPTH):
        out += [
            f"k{d} AS (SELECT host, node, seg[{d + 1}] AS child, sum(n) AS n FROM v{d} WHERE seg[{d + 1}] IS NOT NULL GROUP BY ALL)",
            f"l{d} AS (SELECT host, node, child FROM (SELECT *, count(*) OVER w AS kinds, sum(n) OVER w AS total FROM k{d} "
            f"WINDOW w AS (PARTITION BY host, node)) WHERE kinds < {url_filter.MANY_CHILDREN} OR n >= {url_filter.LITERAL_SHARE} * total)",
            f"v{d + 1} AS (SELECT host, masked, n, labelled, bad, seg, CASE WHEN seg[{d + 1}] IS NULL THEN node ELSE name END AS node, "
            f"CASE WHEN seg[{d + 1}] IS NULL THEN nodes ELSE list_append(nodes, name) END AS nodes FROM (SELECT v.*, "
            f"v.node || '/' || coalesce(l.child, '*') AS name FROM v{d} v LEFT JOIN l{d} l "
            f"ON l.host = v.host AND l.node = v.node AND l.child = v.seg[{d + 1}]))"]
    return ",\n".join(out)


_BY_LENGTH = sorted(url_filter.RULES, key=lambda r: -len(r[0] + r[1]))
URL_FILTER = rf"""
WITH lab AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels
             WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hp AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWERED}') AS host,
              regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
pg AS (SELECT hp.*, lab.bad, regexp_replace(path, '[0-9]+', '{{n}}', 'g') AS masked FROM hp LEFT JOIN lab USING (page_id)),
paths AS (SELECT host, masked, count(*) AS n, count(bad) AS labelled, coalesce(sum(bad), 0) AS bad FROM pg GROUP BY ALL),
cutup AS (SELECT *, string_split(masked, '/')[2:] AS s FROM paths),
segs AS (SELECT *, CASE WHEN len(s) < {url_filter.DEPTH} THEN s
           ELSE list_append(s[1:{url_filter.DEPTH - 1}], array_to_string(s[{url_filter.DEPTH}:], '/')) END AS seg FROM cutup),
{_url_levels()},
ch AS (SELECT host, masked, labelled, bad, list_prepend('', nodes) AS c FROM v{url_filter.DEPTH}),
each AS (SELECT host, masked, labelled, bad, i - 1 AS level, c[i] AS node, CASE WHEN i > 1 THEN c[i - 1] END AS parent
         FROM (SELECT *, unnest(range(1, len(c) + 1)) AS i FROM ch)),
st AS (SELECT host, level, node, parent, sum(labelled) AS n, sum(bad) AS b FROM each GROUP BY ALL),
al AS (SELECT sum(n) AS n, sum(b) AS b FROM st WHERE level = 0),
k AS (SELECT st.*, coalesce(u.n, al.n) AS un, coalesce(u.b, al.b) AS ub, al.n AS an, al.b AS ab
      FROM st LEFT JOIN st u ON u.host = st.host AND u.level = st.level - 1 AND u.node = st.parent, al),
z AS (SELECT *, un - n AS n2, ub - b AS b2 FROM k),
zz AS (SELECT *, CASE WHEN n > 0 AND n2 > 0 THEN sqrt(((b + b2) / (n + n2)) * (1 - (b + b2) / (n + n2)) * (1 / n + 1 / n2)) END AS spread FROM z),
j AS (SELECT host, level, node, coalesce(spread > 0 AND abs(b / n - b2 / n2) >= {url_filter.Z} * spread, false) AS differs,
             (b + {url_filter.WEIGHT} * CASE WHEN un > 0 THEN ub / un ELSE 0 END) / (n + {url_filter.WEIGHT}) AS purity,
             CASE WHEN an > 0 THEN ab / an ELSE 0 END AS overall FROM zz),
best AS (SELECT each.host, each.masked, max_by(j.node, j.level) FILTER (differs) AS template,
                coalesce(max_by(j.purity, j.level) FILTER (differs), max(overall)) AS purity
         FROM each JOIN j ON j.host = each.host AND j.level = each.level AND j.node = each.node GROUP BY 1, 2)
SELECT page_id, host, path,
       CASE {" ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for h, p, _ in _BY_LENGTH)} END AS rule,
       CASE {" ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v}'" for h, p, v in _BY_LENGTH)}
            WHEN best.purity >= {url_filter.PURITY} THEN 'block' ELSE 'allow' END AS verdict, best.template
FROM pg JOIN best USING (host, masked)
"""

# Unsigned CRC-32 of a short string of ASCII characters, bit by bit.
_CRC32 = ("xor(list_reduce([4294967295] || list_transform(string_split({0}, ''), lambda x: CAST(ord(x) AS BIGINT)), lambda a, b: "
          "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)")
PREFIX_TRIE = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, turn, role, md5(md5(role) || md5(text)) AS k, CAST(length(text) AS BIGINT) AS n FROM t),
o AS (SELECT conv_id, list(struct_pack(k := k, n := n) ORDER BY turn NULLS FIRST, role, k) AS w,
      CAST({_CRC32.format("CAST(conv_id AS VARCHAR)")} % 6 AS BIGINT) AS h FROM k GROUP BY conv_id),
r AS (SELECT a.conv_id, list_concat(coalesce(b.w[1:a.h], []), a.w[a.h + 1:]) AS w
      FROM o a LEFT JOIN o b ON b.conv_id = a.conv_id - a.conv_id % 100),
p AS (SELECT conv_id, CAST(d AS BIGINT) AS d, len(w) AS last, array_to_string(list_transform(w[1:d], lambda x: x.k), '') AS path,
      CASE WHEN d > 0 THEN w[d].n ELSE 0 END AS n FROM (SELECT conv_id, w, unnest(range(0, len(w) + 1)) AS d FROM r)),
v AS (SELECT path, d, left(path, 32 * (d - 1)) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(n) AS own,
      sha256(coalesce(string_agg(CASE WHEN last = d THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
      FROM p GROUP BY path, d),
c AS (SELECT up AS path, count(*) AS n FROM v WHERE d > 0 GROUP BY up),
s AS (SELECT left(path, 32 * e) AS path, sum(own) AS saved, count(*) FILTER (WHERE leaf) AS leaves
      FROM (SELECT v.path, v.own, c.n IS NULL AS leaf, unnest(range(0, v.d + 1)) AS e FROM v LEFT JOIN c USING (path)) GROUP BY 1)
SELECT v.conv_id, v.d AS depth, u.conv_id AS parent_conv_id, v.n_convs, coalesce(c.n, 0) AS n_children, s.leaves AS n_leaves,
       CAST(s.saved AS BIGINT) AS saved_tokens, v.ends_sha256
FROM v JOIN s USING (path) LEFT JOIN c USING (path) LEFT JOIN v u ON u.path = v.up AND v.d > 0
"""

ORACLE: dict[str, str] = {
    "op3_ngram_jaccard": NGRAM_JACCARD,
    "op5_decontaminate": DECONTAMINATE,
    "op6_chat_format": CHAT_FORMAT,
    "op7_line_dedup": LINE_DEDUP,
    "op8_url_filter": URL_FILTER,
    "op9_quality_rules": QUALITY_RULES,
    "op11_prefix_trie": PREFIX_TRIE,
}
