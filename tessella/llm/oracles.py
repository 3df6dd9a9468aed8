"""DuckDB SQL for the queries that SQL can express.

Chat formatting has SQL for tables where every role is given and no text holds a marker, and HTML extraction for pages whose text is in an article
element, as all supplied rows are; other rows are tested against plain Python. Without SQL, and tested in that way alone: token output,
token counts and the pipeline.
"""

from __future__ import annotations

from tessella.llm.quality_rules import MAX_REPEAT_PERCENT, MIN_WORDS, RULES

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

LINE_DEDUP = rf"""
WITH d AS (SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN [''] ELSE string_split(text, chr(10)) END AS l FROM documents),
e AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM d),
k AS (SELECT doc_id, i, line, translate(trim(line, {_BLANK}), {_AZ}) AS key FROM e),
h AS (SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.*, h.owner IS NULL OR h.owner = k.doc_id AS stays FROM k LEFT JOIN h USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (NOT stays))::BIGINT AS n_dropped,
sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (stays), '')) AS kept_sha256 FROM j GROUP BY doc_id
"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(text=f"translate(coalesce(text, ''), {_AZ})")} AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM d),
e AS (SELECT doc_id, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * n >= 80 * (len(x.s) + len(y.s) - n)),
g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(v, u) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.v, g.b FROM r JOIN g ON g.a = r.u),
c AS (SELECT v, min(u) AS c FROM r GROUP BY v)
SELECT doc_id, len(s)::BIGINT AS n_shingles, c AS component_id, doc_id = c AS kept FROM s JOIN c ON v = doc_id
"""


def _measured() -> str:
    """CTEs up to m: base counts and rule scores of every document."""
    scores = (
        "floor(n_symbols * 1000 / greatest(word_chars, 1)) AS symbols_permille, floor(n_dup_lines * 1000 / greatest(n_solid, 1)) AS dup_lines_permille, "
        "floor(n_repeat_words * 1000 / greatest(n_words, 1)) AS repeat_words_permille, floor(word_chars * 100 / greatest(n_words, 1)) AS long_words_centi, -floor(word_chars * 100 / greatest(n_words, 1)) AS short_words_centi"
    )
    return rf"""
WITH t AS (SELECT doc_id, lang AS stratum, source, coalesce(text, '') AS t, {_WORDS.format(text="coalesce(text, '')")} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, {_BLANK}) <> '') AS l FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS s FROM t WHERE len(w) >= 8),
rep AS (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT j) AS n FROM rep GROUP BY doc_id),
b AS (SELECT doc_id, stratum, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
(len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_solid, coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM t LEFT JOIN cov USING (doc_id)),
m AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed, {scores} FROM b)"""


def quality(risk: float = 0.004, most_risk: float = 0.05, delta: float = 0.05) -> str:
    grid = ", ".join(f"('{r}', {i}, {c})" for r, cuts in RULES.items() for i, c in enumerate(cuts))
    rows = " UNION ALL ".join(f"SELECT doc_id, stratum, '{r}' AS rule, {r} AS score FROM m" for r in RULES)
    share = f"greatest({risk}, CASE WHEN {{n}} > 0 THEN 1 - exp(ln(lvl) / {{n}}) ELSE 1 END)"
    safe = (
        "({k} <= {n} * {p} AND list_sum(list_transform(range((CASE WHEN {k} <= {n} * {p} AND {p} < 1 THEN {k} ELSE 0 END)::BIGINT + 1), "
        "lambda x: exp(lgamma({n} + 1) - lgamma(x + 1) - lgamma({n} - x + 1) + x * ln({p}) + ({n} - x) * ln(greatest(1 - {p}, 1e-300))))) <= lvl * (1 + 1e-9))"
    )
    return rf"""{_measured()},
sc AS ({rows}),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING max(quality) = 1),
grid(rule, i, cut) AS (VALUES {grid}),
held AS (SELECT m.* FROM m JOIN good USING (doc_id) WHERE NOT m.base_failed),
k AS (SELECT stratum, rule, i, sum((score > cut)::INT)::BIGINT AS k FROM (SELECT sc.* FROM sc JOIN good USING (doc_id) JOIN m USING (doc_id) WHERE NOT m.base_failed) JOIN grid USING (rule) GROUP BY ALL),
strata AS (SELECT s, count(h.doc_id)::BIGINT AS n FROM (SELECT DISTINCT stratum AS s FROM m) LEFT JOIN held h ON h.stratum IS NOT DISTINCT FROM s GROUP BY s),
lv AS (SELECT {delta} / ((count(*) FILTER (n > 0) + 1) * {len(RULES)}) AS lvl FROM strata),
c AS (SELECT s, n, lvl, x.rule, x.i, cut, coalesce(k, 0) AS k, sum(n) OVER (PARTITION BY x.rule, x.i)::BIGINT AS pn, sum(coalesce(k, 0)) OVER (PARTITION BY x.rule, x.i)::BIGINT AS pk
FROM (SELECT * FROM strata, lv, grid) x LEFT JOIN k ON k.rule = x.rule AND k.i = x.i AND k.stratum IS NOT DISTINCT FROM s),
p AS (SELECT *, {share.format(n="n")} AS share, {share.format(n="pn")} AS pshare FROM c),
q AS (SELECT *, bool_and({safe.format(k="k", n="n", p="share")}) OVER r AS ok, bool_and({safe.format(k="pk", n="pn", p="pshare")}) OVER r AS pok FROM p WINDOW r AS (PARTITION BY s, rule ORDER BY i DESC)),
u AS (SELECT *, min(cut) FILTER (pok AND pshare <= {most_risk}) OVER (PARTITION BY s, rule) AS pcut FROM q),
safe AS (SELECT s, rule, CASE WHEN share <= {most_risk} THEN min(cut) FILTER (ok) ELSE min(cut) FILTER (cut >= pcut AND k <= n * {most_risk}) END AS cut FROM u GROUP BY s, rule, share),
bad AS (SELECT DISTINCT doc_id FROM sc JOIN safe ON sc.rule = safe.rule AND sc.stratum IS NOT DISTINCT FROM safe.s WHERE score > cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, stratum, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM m
"""


def mixing() -> str:
    return rf"""{_measured()},
w AS (SELECT m.doc_id, m.source, n_words AS size, ((1000.0::DOUBLE - symbols_permille) * (1000 - dup_lines_permille) * (1000 - repeat_words_permille)) / 1e9::DOUBLE AS q,
(('0x' || substr(md5('17:' || coalesce(m.doc_id::VARCHAR, md5(t.t))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM m JOIN t ON m.doc_id = t.doc_id),
s AS (SELECT source, sum(size)::BIGINT AS n FROM w GROUP BY source),
o AS (SELECT source, n, 2.0::DOUBLE * n AS cap, ([3.0, 1.0, 2.0]::DOUBLE[])[((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS g FROM s),
f AS (SELECT *, 1.5::DOUBLE * sum(n) OVER () AS total, coalesce(sum(cap) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(g) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS g_from FROM o
WINDOW r AS (ORDER BY cap / g, source IS NULL, source)),
a AS (SELECT arg_min((total - before) / g_from, cap / g) FILTER (cap >= (total - before) / g_from * g) AS lvl FROM f),
p AS (SELECT source, n, coalesce(least(cap, lvl * g), cap) AS target FROM f, a),
y AS (SELECT source AS src, n, target, CASE WHEN n > 0 THEN floor(target / n + 1e-12)::BIGINT ELSE 0 END AS epochs FROM p),
x AS (SELECT w.*, y.*, sum(size) OVER (PARTITION BY source ORDER BY -ln(u) / greatest(0.05, q * q), doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM w JOIN y ON w.source IS NOT DISTINCT FROM y.src)
SELECT doc_id, source, size, n AS source_size, round(target, 6) AS target, (size * (epochs + (upto - size / 2.0 <= target - epochs * n)::BIGINT))::BIGINT AS taken FROM x
"""


CHAT = r"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS t, lower(trim(role)) AS r FROM conversations)
SELECT conv_id, turn, 0 AS part_no, role AS given, r AS role, (length(t) - length(replace(t, chr(10), '')) + 1)::INT AS n_lines,
'<|im_start|>' || r || chr(10) || replace(regexp_replace(regexp_replace(t, '\s*<\|(im_end|endoftext|eot_id)\|>\s*$', ''), '^\s+|\s+$', '', 'g'), '<|im_', '<| im_') || '<|im_end|>' || chr(10) AS rendered FROM t
"""

SUFFIX = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), n AS (SELECT doc_id, h, length(h) // 2 AS n FROM d),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS s FROM (SELECT doc_id, h, unnest(range(greatest(n - 99, 0))) AS i FROM n)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS rn FROM w) WHERE rn > 1),
g AS (SELECT doc_id, i, sum(CASE WHEN i <= p + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT *, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) AS p FROM r)),
s AS (SELECT doc_id, g, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY doc_id, g),
k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS q FROM s),
o AS (SELECT n.doc_id, any_value(n.n) AS n, coalesce(sum(b - a), 0) AS gone, count(a) AS spans, coalesce(string_agg(substr(h, 2 * q + 1, 2 * (a - q)), '' ORDER BY a), '') || substr(any_value(h), 2 * coalesce(max(b), 0) + 1) AS kept FROM n LEFT JOIN k ON k.doc_id = n.doc_id GROUP BY n.doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, gone::BIGINT AS n_removed, spans::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM o
"""

HTML = r"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1), '<br>', ' ', 'g'), '</?b>', '', 'g') AS a FROM pages),
b AS (SELECT page_id, url, list_transform(regexp_split_to_array(a, '</?(p|h1)>'), lambda x: trim(regexp_replace(regexp_replace(replace(x, '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS b FROM a),
c AS (SELECT page_id, url, array_to_string(list_filter(b, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM c
"""


DECONTAMINATION = rf"""
WITH RECURSIVE t AS (SELECT item_id, {_WORDS.format(text=f"translate(coalesce(text, ''), {_AZ})")} AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)), d AS (SELECT doc_id, {_WORDS.format(text=f"translate(coalesce(text, ''), {_AZ})")} AS w FROM documents),
u AS (SELECT item_id, w, len(w) AS n, least(5, len(w)) AS k FROM t WHERE len(w) > 0),
ig AS (SELECT item_id, k, p AS i, array_to_string(w[p:p + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, n - k + 2)) AS p FROM u)),
dg AS (SELECT doc_id, k, p AS d, array_to_string(w[p:p + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM u) WHERE len(w) >= k)),
p0 AS (SELECT DISTINCT doc_id, item_id, d + j AS d, i + j AS i FROM (SELECT doc_id, item_id, d, i, unnest(range(k)) AS j FROM dg JOIN ig USING (k, g))),
r AS (SELECT 0 AS turn, doc_id, item_id, d, i, 0::BIGINT AS size FROM p0 UNION ALL SELECT * FROM (
WITH pos AS (SELECT * FROM r WHERE size = 0), isl AS (SELECT *, d - row_number() OVER (PARTITION BY doc_id, item_id, i - d ORDER BY d) AS g FROM pos),
runs AS (SELECT any_value(turn) AS turn, doc_id, item_id, min(d) AS d0, min(i) AS i0, count(*) AS m FROM isl GROUP BY doc_id, item_id, i - d, g),
best AS (SELECT * FROM (SELECT runs.*, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY m DESC, i0, d0) AS rn FROM runs JOIN u USING (item_id) WHERE m >= k) WHERE rn = 1)
SELECT pos.turn + 1, doc_id, item_id, d, i, 0 FROM pos JOIN best USING (doc_id, item_id) WHERE d NOT BETWEEN d0 AND d0 + m - 1 AND i NOT BETWEEN i0 AND i0 + m - 1 UNION ALL SELECT turn + 1, doc_id, item_id, d0, i0, m FROM best)),
f AS (SELECT doc_id, item_id, count(*)::BIGINT AS n_tiles, sum(size)::BIGINT AS n_matched FROM r WHERE size > 0 GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_tiles, n_matched, n::BIGINT AS n_words, n_matched / n AS coverage FROM f JOIN u USING (item_id) WHERE n_matched >= ceil(n * 0.5)
"""


ORACLES: dict[str, str] = {
    "op1_chat_format": CHAT, "op2_line_dedup": LINE_DEDUP, "op3_quality_rules": quality(), "op4_suffix_dedup": SUFFIX, "op5_mixing": mixing(),
    "op6_decontamination": DECONTAMINATION, "op7_minhash_dedup": NEAR_DUPLICATES, "op9_html_extraction": HTML,
}
