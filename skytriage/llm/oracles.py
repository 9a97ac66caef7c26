"""DuckDB SQL of the operators whose rows SQL can express."""

from __future__ import annotations

from .secret_scan import RULES

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

NGRAM_JOIN = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')] ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(list_slice(words, i, i + 4), ' '))) END AS shingles FROM w),
n AS (SELECT doc_id, len(shingles) AS n FROM s),
e AS (SELECT doc_id, unnest(shingles) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * common >= 80 * (x.n + y.n - common)),
g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS start, b AS at FROM g UNION SELECT r.start, g.b FROM r JOIN g ON r.at = g.a)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, least(n.doc_id, coalesce(min(r.at), n.doc_id)) AS component_id FROM n LEFT JOIN r ON r.start = n.doc_id GROUP BY n.doc_id, n.n"""


def _secret_sql() -> str:
    """Positions follow from the lengths of the matches and of the parts between them."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for k, rule in enumerate(RULES):
        p = quoted(rule.pattern)
        parts.append(
            f"SELECT doc_id, {k} AS k, '{rule.kind}' AS kind, unnest(regexp_extract_all(text, {p})) AS m, unnest(regexp_extract_all(text, {p}, {rule.group})) AS g, unnest(regexp_split_to_array(text, {p})[:-2]) AS gap, generate_subscripts(regexp_extract_all(text, {p}), 1) AS i FROM documents WHERE regexp_matches(text, {p})"
        )
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in RULES[:3])
    return f"""WITH f AS ({' UNION ALL '.join(parts)}),
q AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, k ORDER BY i)::BIGINT AS stop, {'CASE k ' + ' '.join(f'WHEN {k} THEN {r.least}' for k, r in enumerate(RULES)) + ' END'} AS least FROM f),
v AS (SELECT doc_id, k, kind, stop - length(m) AS start, kind || ':' || (stop - length(m)) || ':' || stop AS span FROM q WHERE length(g) >= least),
a AS (SELECT doc_id, {counts}, string_agg(span, ',' ORDER BY start, k) FILTER (k < 3) AS base, string_agg(span, ',' ORDER BY start, k) AS spans FROM v GROUP BY 1)
SELECT d.doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) AS n_{r.kind}' for r in RULES[:3])}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN a USING (doc_id)"""


SECRET_SCAN = _secret_sql()

_DIGIT = "('0x' || substr(h, g * 5 + 1, 5))::BIGINT"
_BASE32 = f"array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({_DIGIT} >> s) & 31)::INT + 1, 1)), '')), '')"
_HOST = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\.', '')"
_PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_QUERY = r"regexp_extract(url, '^[^?#]*\?([^#]*)', 1)"

WARC = f"""WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
o AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS owner, lower(array_to_string(list_reverse(string_split({_HOST}, '.')), ',') || ')' || CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END || CASE WHEN {_QUERY} = '' THEN '' ELSE '?' || {_QUERY} END) AS url_key FROM p)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN owner = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN owner <> page_id THEN owner END AS refers_to, url_key,
  row_number() OVER (ORDER BY url_key, page_id) - 1 AS position FROM o"""

_F = "({0} - {1}) * ({0} - {1}) // {1}"
_P = "1 + (1000000000::HUGEINT * (coalesce({n}, 0) + 1)) // ({size})"
DIVERGENCE = f"""WITH d AS (SELECT row_number() OVER () AS nr, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
t AS (SELECT lang, source, nr, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*)::BIGINT AS total FROM t GROUP BY ALL HAVING count(DISTINCT nr) >= 3),
v AS (SELECT lang, count(*) AS v, sum(total)::BIGINT AS n FROM k GROUP BY 1),
c AS (SELECT lang, source, term, count(*)::BIGINT AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, sum(n)::BIGINT AS n FROM c GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, ({_P.format(n='c.n', size='coalesce(s.n, 0) + v.v')})::BIGINT AS p, ({_P.format(n='k.total', size='v.n + v.v')})::BIGINT AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN s ON s.lang = g.lang AND s.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
x AS (SELECT a.lang, a.source, b.source AS item, sum({_F.format('a.p', 'b.p')})::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
y AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ({_F.format('p', 'q')})::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM y QUALIFY part = 'pair' OR rank <= 200"""

ORACLE = {"op3_ngram_join": NGRAM_JOIN, "op7_secret_scan": SECRET_SCAN, "op9_warc": WARC, "op11_source_divergence": DIVERGENCE}
