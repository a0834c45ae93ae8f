"""SQL of the license and secret scans, for the check."""

from __future__ import annotations

from riskfabric.llm import licenses, secrets


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def license_sql() -> str:
    templates = ",\n ".join(f"({i}, {quoted(name)}, [{', '.join(map(quoted, licenses.template_bigrams(text)))}])" for i, (name, text) in enumerate(licenses.TEMPLATES))
    return rf"""
WITH templates(template, name, grams) AS (VALUES {templates}),
lines AS (SELECT doc_id, row_number() OVER () AS row, list_transform(string_split_regex(coalesce(text, ''), '\r\n|\r|\n'),
  lambda x: trim(regexp_replace(lower(x), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))) AS x FROM documents),
units AS (SELECT doc_id, row, unnest(list_filter(list_distinct(list_concat(x,
  list_transform(string_split_regex(array_to_string(x, chr(10)), '\n\n+'), lambda b: trim(replace(b, chr(10), ' '))),
  [array_to_string(list_filter(x, lambda y: y <> ''), ' ')])), lambda u: u <> '')) AS unit FROM lines),
worded AS (SELECT doc_id, row, string_split(unit, ' ') AS w FROM units),
grams AS (SELECT doc_id, row, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM worded WHERE len(w) > 1),
scored AS (SELECT row, name, 2e0 * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice FROM grams, templates),
hits AS (SELECT row, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses, CAST(count(*) AS INT) AS n_matches, max(dice) AS best_dice FROM scored WHERE dice >= {licenses.THRESHOLD} GROUP BY row)
SELECT doc_id, coalesce(licenses, '') AS licenses, coalesce(n_matches, 0) AS n_matches, best_dice FROM lines LEFT JOIN hits USING (row)"""


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def secret_sql() -> str:
    keyword = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + either_case("api") + "_?" + either_case("key")
    patterns = {"assign": rf"""({keyword})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+", "candidate": secrets.CANDIDATE}
    found = ",\n".join(f"""{kind}_m AS (SELECT row, regexp_extract_all(text, {quoted(p)}) AS m, string_split_regex(text, {quoted(p)}) AS g{f", regexp_extract_all(text, {quoted(p)}, 2) AS v" if kind == "assign" else ", m AS v"} FROM docs),
{kind}_s AS (SELECT row, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'token': m[i], 'n': len(v[i]),
  'start': coalesce(list_sum(list_transform(g[1:i], lambda x: len(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0)}})) AS s FROM {kind}_m)"""
                       for kind, p in patterns.items())
    base = " UNION ALL ".join(f"SELECT row, CAST(s.start AS BIGINT) AS start, {rank} AS rank, CAST(s.start + len(s.token) AS BIGINT) AS stop, '{kind}' AS kind FROM {kind}_s WHERE s.n >= {least}"
                              for rank, (kind, _, _, least) in enumerate(secrets.BASE))
    codes = " ".join(f"WHEN regexp_matches(symbols, {quoted(p)}) THEN {{'a': '{alphabet}', 'e': {excess}::DOUBLE}}" for _, p, alphabet, excess in secrets.ENCODINGS)
    return rf"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS text FROM documents),
{found},
base AS ({base}),
tokens AS (SELECT DISTINCT s.token AS token, regexp_replace(s.token, '=+$', '') AS symbols FROM candidate_s WHERE regexp_matches(s.token, '[0-9]') AND regexp_matches(s.token, '[A-Za-z]')),
coded AS (SELECT *, CASE {codes} END AS code FROM tokens),
placed AS (SELECT token, code.e AS e, CAST(len(code.a) AS DOUBLE) AS k, CAST(len(symbols) AS DOUBLE) AS n,
  list_transform(string_split(symbols, ''), lambda c: CAST(instr(code.a, c) AS DOUBLE)) AS v FROM coded WHERE code IS NOT NULL),
counted AS (SELECT *, list_sum(list_transform(list_distinct(v), lambda x: pow(len(list_filter(v, lambda y: y = x)), 2))) AS squares, list_sum(v) / n AS mean,
  CAST(len(list_filter(v, lambda x: x > k / 2)) AS DOUBLE) AS high,
  1 + CAST(len(list_filter(range(1, len(v)), lambda i: (v[i] > k / 2) <> (v[i + 1] > k / 2))) AS DOUBLE) AS runs FROM placed),
moments AS (SELECT *, squares * k / n - n AS chi, 2 * high * (n - high) AS twice, list_sum(list_transform(v, lambda x: (x - mean) * (x - mean))) AS spread,
  list_sum(list_transform(range(1, len(v)), lambda i: (v[i] - mean) * (v[i + 1] - mean))) AS lag FROM counted),
z AS (SELECT *, CASE WHEN twice > n THEN (runs - 1 - twice / n) / sqrt(twice * (twice - n) / (n * n * (n - 1))) ELSE 9.9 END AS z_runs,
  CASE WHEN spread > 0 THEN (lag / spread + 1 / n) * sqrt(n) ELSE 9.9 END AS z_serial, (chi - (k - 1)) / sqrt(2 * (k - 1)) AS z_uniform,
  (chi - (k - 1) - n * e) / sqrt(2 * (k - 1 + 2 * n * e)) AS z_text FROM moments),
p AS (SELECT token, CASE WHEN abs(z_runs) > {secrets.FAIL_Z} OR abs(z_serial) > {secrets.FAIL_Z} OR z_uniform > {secrets.FAIL_Z} THEN 1e0
  ELSE 1 / (1 + exp(-(1.5976e0 * z_text + 0.070566e0 * z_text * z_text * z_text))) END AS p FROM z),
judged AS (SELECT t.token, floor(2 * log2(len(t.token) / 20e0) + 1e-9) AS class, least(floor(-{secrets.BINS_PER_DECADE} * log10(greatest(coalesce(p, 1e0), 1e-300)) + 1e-9), {secrets.BINS}) AS bin
  FROM tokens t LEFT JOIN p USING (token)),
levels AS (SELECT class, b, count(*) FILTER (bin >= b) AS up, count(*) AS total FROM judged, range(1, {secrets.BINS} + 1) r(b) GROUP BY class, b),
bounds AS (SELECT class, min(b) AS least FROM levels WHERE pow(10, -b / {float(secrets.BINS_PER_DECADE)}) <= {secrets.FALSE_DISCOVERY} * up / total GROUP BY class),
secret AS (SELECT token FROM judged JOIN bounds USING (class) WHERE bin >= least),
random AS (SELECT row, CAST(s.start AS BIGINT) AS start, {len(secrets.BASE)} AS rank, CAST(s.start + len(s.token) AS BIGINT) AS stop, '{secrets.RANDOM}' AS kind FROM candidate_s c
  WHERE s.token IN (SELECT token FROM secret) AND NOT EXISTS (SELECT 1 FROM base b WHERE b.row = c.row AND b.start < c.s.start + len(c.s.token) AND c.s.start < b.stop)),
spans AS (SELECT * FROM base UNION ALL SELECT * FROM random),
joined AS (SELECT row, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) AS spans,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) FILTER (kind <> '{secrets.RANDOM}') AS base,
  count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex FROM spans GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN joined USING (row)"""
