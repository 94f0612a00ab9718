"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from cellgrove.llm.quality import RULES

_WORD = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

OP6 = r"""WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
  rules(h, p, allow) AS (VALUES ('org', '/', TRUE), ('example.org', '/es/', FALSE), ('example.org', '/en/1', FALSE), ('com', '/fr/', TRUE), ('com', '/de/', FALSE)),
  m AS (SELECT u.*, h || p AS rule, allow, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, length(h) DESC, allow) AS k
    FROM u LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, CASE WHEN coalesce(allow, TRUE) THEN 'allow' ELSE 'block' END AS verdict FROM m WHERE k = 1"""

OP7 = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
  win AS (SELECT rid, s, array_to_string(w[s : s + 34], ' ') AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35)),
  rep AS (SELECT rid, s FROM (SELECT rid, s, count(*) OVER (PARTITION BY k) AS n FROM win) WHERE n > 1),
  gone AS (SELECT DISTINCT rid, s + o AS p FROM rep, (SELECT unnest(range(35)) AS o)),
  words AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
  kept AS (SELECT rid, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.rid = words.rid AND g.p = words.p) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)"""

OP3 = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_WORD}') AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]) ELSE w END) AS x FROM d),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
  c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
  e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
  u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
  reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, u.b FROM reach JOIN u ON reach.b = u.a),
  m AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)"""


def _scores() -> str:
    return ", ".join(f"CAST({e.replace(' div ', ' // ')} AS INTEGER) AS {r}" for r, e in RULES.items())


def quality_sql(limit: float = 0.02, risk: float = 0.05) -> str:
    """The quality query: counts, exact binomial tests of all cutoffs, verdicts."""
    p, each = limit / len(RULES), " UNION ALL ".join(f"SELECT stratum, '{r}' AS rule, {r} AS score FROM good" for r in RULES)
    tail = f"list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({p!r}) + (n - j) * ln(1 - {p!r}))))"
    failed = " OR ".join(f"coalesce({r} > (SELECT cutoff FROM best b WHERE b.stratum = q.stratum AND b.rule = '{r}'), FALSE)" for r in RULES)
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
  w AS (SELECT *, regexp_extract_all(t, '{_WORD}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
  win AS (SELECT rid, s, array_to_string(w[s : s + 7], ' ') AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS s FROM w WHERE len(w) >= 8)),
  rep AS (SELECT rid, s FROM (SELECT rid, s, count(*) OVER (PARTITION BY rid, k) AS n FROM win) WHERE n > 1),
  cov AS (SELECT rid, count(DISTINCT s + o) AS n FROM rep, (SELECT unnest(range(8)) AS o) GROUP BY 1),
  c AS (SELECT w.rid, doc_id, stratum, t, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines FROM w LEFT JOIN cov ON w.rid = cov.rid),
  q AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {_scores()} FROM c),
  good AS (SELECT stratum, t, {', '.join(f'max({r}) AS {r}' for r in RULES)} FROM q JOIN (SELECT doc_id, max(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY 1) USING (doc_id) GROUP BY 1, 2 HAVING max(quality) = 1),
  each AS ({each}), tried AS (SELECT stratum, rule, x AS cutoff, count(*) AS n, count(*) FILTER (score > x) AS k, (SELECT count(DISTINCT stratum) FROM each) AS strata FROM each, (SELECT unnest(range(101)) AS x) GROUP BY 1, 2, 3),
  best AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM tried WHERE cutoff = 100 OR (k < n * {p!r} AND {tail} <= {risk!r} / (strata * {len(RULES)})) GROUP BY 1, 2)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({failed}) AS kept FROM q"""

OP8 = """WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
  part AS (SELECT doc_id, c, h[400 * c + 1 : 400 * c + 598] AS p FROM (SELECT doc_id, h, unnest(range(0, (length(h) // 2 + 100) // 200)) AS c FROM d WHERE length(h) >= 200)),
  win AS (SELECT doc_id, unnest(list_transform(range(0, length(p) // 2 - 99), lambda s: {'s': 200 * c + s, 'k': md5_number(p[2 * s + 1 : 2 * s + 200])})) AS w FROM part),
  first AS (SELECT w.k AS k, min((doc_id, w.s)) AS f FROM win GROUP BY 1 HAVING count(*) > 1),
  rep AS (SELECT doc_id, w.s AS s FROM win JOIN first ON w.k = k WHERE (doc_id, w.s) <> f),
  marked AS (SELECT *, s > coalesce(lag(s) OVER (PARTITION BY doc_id ORDER BY s), -101) + 100 AS new FROM rep),
  runs AS (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM marked),
  gone AS (SELECT doc_id, run, min(s) AS a, max(s) + 100 AS b FROM runs GROUP BY 1, 2),
  kept AS (SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM gone UNION ALL SELECT doc_id, length(h) // 2, coalesce(b, 0) FROM d LEFT JOIN (SELECT doc_id, max(b) AS b FROM gone GROUP BY 1) USING (doc_id)),
  texts AS (SELECT doc_id, string_agg(h[2 * before + 1 : 2 * a], '' ORDER BY a, before) AS t FROM kept JOIN d USING (doc_id) GROUP BY 1),
  sums AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM gone GROUP BY 1)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(t)) AS kept_sha256 FROM d JOIN texts USING (doc_id) LEFT JOIN sums USING (doc_id)"""

# fixed values: the base patterns
_ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_RUN = r"[A-Za-z0-9+/_=-]{20,}"


def _matches(kind: int, pattern: str) -> str:
    return f"""SELECT rid, source, {kind} AS kind, m, list_sum([length(x) FOR x IN parts[1 : k]]) + coalesce(list_sum([length(x) FOR x IN found[1 : k - 1]]), 0) AS start
      FROM (SELECT *, unnest(found) AS m, generate_subscripts(found, 1) AS k FROM (SELECT rid, source, string_split_regex(t, '{pattern}') AS parts, regexp_extract_all(t, '{pattern}') AS found FROM d))"""


OP5 = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
  raw AS ({_matches(0, _ASSIGN)} UNION ALL {_matches(1, 'AKIA[A-Z0-9]+')} UNION ALL {_matches(2, '[0-9a-f]+')} UNION ALL {_matches(3, _RUN)}),
  f AS (SELECT rid, source, kind, CAST(start AS INTEGER) AS start, CAST(start + length(m) AS INTEGER) AS stop, CASE WHEN kind = 0 THEN regexp_extract(m, '{_ASSIGN}', 1) ELSE m END AS secret FROM raw),
  base AS (SELECT * FROM f WHERE (kind = 0 AND length(secret) >= 8) OR (kind = 1 AND length(secret) >= 16) OR (kind = 2 AND length(secret) >= 32)),
  own AS (SELECT * FROM f WHERE kind = 3 AND regexp_matches(secret, '[a-z]') AND regexp_matches(secret, '[A-Z]') AND regexp_matches(secret, '[0-9]') AND len(list_distinct(string_split(secret, ''))) >= 12
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = f.rid AND b.start < f.stop AND f.start < b.stop)),
  every AS (SELECT * FROM base UNION ALL SELECT * FROM own), live AS (SELECT secret FROM every GROUP BY 1 HAVING count(DISTINCT source) <= 1),
  s AS (SELECT *, secret IN (SELECT secret FROM live) AS live, ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || start || ':' || stop AS x FROM every),
  a AS (SELECT rid, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2, string_agg(x, ',' ORDER BY start, kind) FILTER (kind < 3) AS base,
    string_agg(x, ',' ORDER BY start, kind) FILTER (kind < 3 OR live) AS spans, string_agg(x, ',' ORDER BY start, kind) FILTER (live) AS live FROM s GROUP BY 1)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(live, '') AS live_spans FROM d LEFT JOIN a USING (rid)"""
