"""The results of the registered queries in DuckDB SQL."""

from __future__ import annotations

from lakejobs.llm import quality, spans, urls
from lakejobs.llm.queries import URL_RULES

WORDS = r"list_filter(string_split_regex(coalesce({}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _quality() -> str:
    """Windows and histograms from unnested words; distances from unnested bins."""
    left, steps = "coalesce(text, '')", []
    for k, pattern in enumerate(quality.CLASSES):
        steps.append(f"l{k} AS (SELECT *, regexp_replace({left}, '{pattern.replace(chr(39), chr(39) * 2)}', '', 'g') AS left{k + 1} FROM {f'l{k - 1}' if k else 'd'})")
        left = f"left{k + 1}"
    n = len(quality.CLASSES)
    sizes = ["length(coalesce(text, ''))"] + [f"length(left{k})" for k in range(1, n + 1)]
    classes = ", ".join([f"{sizes[k]} - {sizes[k + 1]}" for k in range(n)] + [sizes[n]])
    common = ", ".join(f"'{w}'" for w in quality.COMMON_WORDS)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, text, {WORDS.format("text")} AS w FROM documents),
{", ".join(steps)},
p AS (SELECT rid, doc_id, lang, w, len(w) AS n_words, text,
      {sizes[0]} - (length(left1) - length(left2)) AS word_chars,
      length(left4) - length(left5) AS n_symbols,
      list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
      [{classes}] AS n_classes,
      list_transform([{common}], lambda c: len(list_filter(w, lambda x: lower(x) = c))) AS counts
      FROM l{n - 1}),
win AS (SELECT rid, i, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS g FROM p, unnest(range(1, n_words - 1)) AS u(i)),
rep AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i + o) AS n FROM rep, (VALUES (0), (1), (2)) AS t(o) GROUP BY rid),
bins AS (
  SELECT rid, lang, n_words, 'class' AS kind, unnest(range(1, len(n_classes) + 1)) AS k, unnest(n_classes) / greatest(list_sum(n_classes), 1) AS share FROM p
  UNION ALL
  SELECT rid, lang, n_words, 'word', unnest(range(1, len(counts) + 2)), unnest(list_append(counts, n_words - list_sum(counts))) / greatest(n_words, 1) FROM p),
long_rows AS (SELECT * FROM bins WHERE n_words >= {quality.MIN_HISTOGRAM_WORDS}),
langs AS (SELECT lang, count(*) AS n FROM p WHERE n_words >= {quality.MIN_HISTOGRAM_WORDS} GROUP BY lang),
own_langs AS (SELECT lang FROM langs WHERE lang IS NOT NULL AND (n >= {quality.MIN_LANGUAGE_SHARE} * (SELECT sum(n) FROM langs) OR n >= {quality.MIN_LANGUAGE_DOCS})),
own AS (SELECT lang, kind, k, avg(share) AS q FROM long_rows SEMI JOIN own_langs USING (lang) GROUP BY ALL),
pooled AS (SELECT kind, k, avg(share) AS q FROM long_rows GROUP BY ALL),
refs AS (SELECT lang AS ref, kind, k, q FROM own
  UNION ALL SELECT NULL, kind, k, q FROM pooled WHERE kind = 'class' AND NOT EXISTS (SELECT 1 FROM own_langs)),
owned AS (SELECT b.*, o.lang AS own_lang FROM bins b LEFT JOIN own_langs o ON b.lang = o.lang),
both_shares AS (SELECT b.rid, b.kind, r.ref, b.share AS p, r.q FROM owned b JOIN refs r ON r.ref = b.own_lang AND r.kind = b.kind AND r.k = b.k
  UNION ALL SELECT b.rid, b.kind, r.ref, b.share, r.q FROM owned b JOIN refs r ON r.kind = b.kind AND r.k = b.k
  WHERE b.own_lang IS NULL AND (b.kind = 'class' OR b.lang IS NULL)),
by_ref AS (SELECT rid, kind, ref, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0)) AS js
  FROM both_shares GROUP BY rid, kind, ref),
dist AS (SELECT rid, kind, min(js) AS js FROM by_ref GROUP BY rid, kind),
base AS (SELECT p.*, coalesce(cov.n, 0) AS n_repeat_words, n_words < {quality.MIN_WORDS} OR 100 * coalesce(cov.n, 0) > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed
  FROM p LEFT JOIN cov USING (rid))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND coalesce(c.js <= {quality.MAX_CLASS_DISTANCE}, true) AND (n_words < {quality.MIN_HISTOGRAM_WORDS} OR coalesce(w.js <= {quality.MAX_WORD_DISTANCE}, true)) AS kept
FROM base LEFT JOIN dist c ON c.rid = base.rid AND c.kind = 'class' LEFT JOIN dist w ON w.rid = base.rid AND w.kind = 'word'
"""


MIXING = f"""
WITH d AS (SELECT doc_id, source, len({WORDS.format("text")}) AS size, md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT source, sum(size) AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
k AS (SELECT *, sum(source_size) OVER () * 1.5 - coalesce(sum(2.0 * source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS budget,
  sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_weight FROM s),
level AS (SELECT max(budget::DOUBLE / rest_weight::DOUBLE) AS lvl FROM k WHERE budget / rest_weight * weight <= 2.0 * source_size),
t AS (SELECT source, source_size::BIGINT AS source_size, least(2.0 * source_size::DOUBLE, coalesce(lvl, 1e300) * weight::DOUBLE) AS target FROM s CROSS JOIN level),
c AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
g AS (SELECT source, h, size, sum(size) AS words FROM c GROUP BY ALL),
m AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY h, size ROWS UNBOUNDED PRECEDING) - words / 2 AS middle FROM g)
SELECT doc_id, c.size::BIGINT AS size, source_size, target, (c.size * (whole + (middle < target - whole * source_size)::INT))::BIGINT AS taken
FROM c JOIN m ON c.source IS NOT DISTINCT FROM m.source AND c.h = m.h AND c.size = m.size
"""

def _urls() -> str:
    """The tree unrolled, one step per level of the deepest path that is told apart."""
    rule = verdict = "NULL"
    for what, host, path in sorted(URL_RULES, key=lambda r: len(r[1] + r[2])):
        fits = f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
        rule = f"CASE WHEN {fits} THEN '{host + path}' ELSE {rule} END"
        verdict = f"CASE WHEN {fits} THEN '{what}' ELSE {verdict} END"
    seg = "x"
    for pattern, name in urls.FORMS:
        seg = f"regexp_replace({seg}, '^{pattern}($|[.])', '{name}\\1')"
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    url = "coalesce(regexp_extract(url, '(?s)^.*?://{}', 1), '')"
    host, path = low.format(url.format("([^/?#]*)")), url.format("[^/?#]*([^?#]*)")
    levels, last = [], "t0"
    for k in range(1, urls.DEPTH + 1):
        levels.append(f"""
s{k} AS (SELECT *, form[{k}] AS seg FROM {last}),
c{k} AS (SELECT host, template, seg, sum(n) AS n, sum(labelled) AS labelled, sum(bad) AS bad FROM s{k} WHERE seg IS NOT NULL GROUP BY ALL),
m{k} AS (SELECT *, count(*) OVER w AS names, count(*) FILTER (n = 1) OVER w AS once, sum(labelled) OVER w AS al, sum(bad) OVER w AS ab FROM c{k} WINDOW w AS (PARTITION BY host, template)),
d{k} AS (SELECT host, template, seg, CASE
  WHEN names > {urls.MAX_NAMES} AND once > {urls.ONCE_SHARE} * names OR labelled = 0 THEN '*'
  WHEN al - labelled = 0 THEN seg
  WHEN abs(bad / labelled - (ab - bad) / (al - labelled)) <= {urls.Z} * sqrt((ab / al) * (1 - ab / al) * (1 / labelled + 1 / (al - labelled))) THEN '*'
  ELSE seg END AS part FROM m{k}),
t{k} AS (SELECT s.host, form, n, labelled, bad, CASE WHEN part IS NULL THEN s.template ELSE s.template || '/' || part END AS template
  FROM s{k} s LEFT JOIN d{k} d ON s.host = d.host AND s.template = d.template AND s.seg = d.seg)""")
        last = f"t{k}"
    return f"""
WITH r AS (SELECT page_id, {host} AS host, {path} AS path FROM pages),
p AS (SELECT *, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: {seg}) AS parts FROM r),
f AS (SELECT *, CASE WHEN len(parts) > {urls.DEPTH} THEN list_append(parts[1:{urls.DEPTH - 1}], '**') ELSE parts END AS form, {rule} AS rule, {verdict} AS ruled FROM p),
t0 AS (SELECT host, form, count(*) AS n, count(ruled) AS labelled, coalesce(sum((ruled = 'block')::INT), 0) AS bad, '' AS template FROM f GROUP BY host, form),
{", ".join(levels)},
q AS (SELECT host, template, (sum(bad) + {urls.PRIOR * urls.WEIGHT}) / (sum(labelled) + {urls.WEIGHT}) AS share FROM {last} GROUP BY ALL)
SELECT page_id, f.host AS host, path, rule, t.template AS template, coalesce(ruled, CASE WHEN share >= {urls.REJECT} THEN 'block' ELSE 'allow' END) AS verdict
FROM f JOIN {last} t ON f.host = t.host AND f.form = t.form JOIN q ON q.host = t.host AND q.template = t.template
"""


#: Base 32 from the hexadecimal digest: five digits are four letters.
BASE32 = "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (i // 4) * 5 + 1, 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31) + 1)::INTEGER, 1)), '')"

WARC = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first, count(*) OVER (PARTITION BY h) AS copies FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, {BASE32} AS payload_digest, true AS intact,
  CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM m
"""

SPANS = f"""
WITH d AS (SELECT doc_id, text, list_filter(string_split(regexp_replace(coalesce(text, ''), '({spans.END})', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS parts FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS part FROM d),
k AS (SELECT doc_id, i, {WORDS.format("lower(part)")} AS w FROM s),
c AS (SELECT doc_id, i, len(w) AS n, array_to_string(w, ' ') AS key, sum(len(w)) OVER (PARTITION BY doc_id ORDER BY i) AS total FROM k),
e AS (SELECT a.doc_id, a.i, min(CASE WHEN a.n >= {spans.LONG_WORDS} THEN a.i ELSE b.i END) AS j
  FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + {spans.MIN_WORDS} + 1
  WHERE a.n > 0 AND (a.n >= {spans.LONG_WORDS} OR b.i > a.i AND b.total - a.total + a.n >= {spans.MIN_WORDS}) GROUP BY ALL),
r AS (SELECT e.doc_id, e.i, e.j, string_agg(c.key, chr(10) ORDER BY c.i) AS content FROM e JOIN c ON c.doc_id = e.doc_id AND c.i BETWEEN e.i AND e.j GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, i) AS place FROM r),
g AS (SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS i FROM f WHERE place > 1),
o AS (SELECT s.doc_id, count(*) AS n_sentences, count(g.i) AS n_removed, coalesce(string_agg(part, '' ORDER BY s.i) FILTER (g.i IS NULL), '') AS new
  FROM s LEFT JOIN g ON s.doc_id = g.doc_id AND s.i = g.i GROUP BY s.doc_id)
SELECT d.doc_id, coalesce(n_sentences, 0)::BIGINT AS n_sentences, coalesce(n_removed, 0)::BIGINT AS n_removed,
  CASE WHEN n_removed > 0 THEN new ELSE text END AS text
FROM d LEFT JOIN o ON d.doc_id = o.doc_id
"""

ORACLE = {"op1_quality_rules": _quality(), "op4_sentence_spans": SPANS, "op5_url_filter": _urls(), "op7_warc": WARC, "op8_mixing": MIXING}
