"""DuckDB SQL for operators whose contract SQL can express by trying everything: it is for small tables."""

from __future__ import annotations

from . import licenses, quality

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _components(nodes: str, links: str) -> str:
    """CTE ``root`` (node, root): the smallest node reachable by links (a, b), which go both ways."""
    return f"""reach(node, other) AS (SELECT DISTINCT id, id FROM {nodes} WHERE id IS NOT NULL UNION SELECT r.node, l.b FROM reach r JOIN {links} l ON l.a = r.other),
root AS (SELECT node, min(other) AS root FROM reach GROUP BY 1)"""


def suffix_dedup(table: str = "documents", length: int = 200) -> str:
    """Every string of ``length`` bytes of every text, by its hash; texts as hexadecimal, as SQL cuts characters, and in
    pieces, as it counts them from the start."""
    n = 2 * length
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM {table}),
piece AS (SELECT r, c * 1000 AS c, substr(h, c * 2000 + 1, {2000 + n - 2}) AS h FROM (SELECT r, h, unnest(range(0, length(h) // 2000 + 1)) AS c FROM d)),
s AS (SELECT r, c + k AS k, md5(substr(h, 2 * k + 1, {n})) AS m FROM (SELECT r, c, h, unnest(range(0, greatest(0, length(h) // 2 - {length - 1}))) AS k FROM piece)),
again AS (SELECT r, k FROM s JOIN (SELECT m FROM s GROUP BY 1 HAVING count(*) > 1) USING (m)),
e AS (SELECT r, k, k > max(k) OVER (PARTITION BY r ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {length} AS new FROM again),
g AS (SELECT r, k, sum(coalesce(new, true)::INT) OVER (PARTITION BY r ORDER BY k) AS span FROM e),
spans AS (SELECT r, span, min(k) AS a, max(k) + {length} AS b FROM g GROUP BY 1, 2),
kept AS (SELECT r, string_agg(substr(h, 2 * a0 + 1, 2 * (a - a0)), '' ORDER BY a) AS h, sum(gone) AS gone, sum(spans) AS spans FROM (
  SELECT d.r, d.h, p.a, coalesce(lag(p.b) OVER (PARTITION BY d.r ORDER BY p.a), 0) AS a0, p.gone, p.spans FROM d JOIN (
    SELECT r, a, b, b - a AS gone, 1 AS spans FROM spans UNION ALL SELECT r, length(h) // 2, length(h) // 2, 0, 0 FROM d) p USING (r)) GROUP BY 1)
SELECT doc_id, length(d.h) // 2 AS n_bytes, gone::BIGINT AS n_removed, spans::BIGINT AS n_spans, sha256(unhex(kept.h)) AS kept_sha256 FROM d JOIN kept USING (r)"""


def embeddings(table: str = "embeddings", threshold: float = 0.93) -> str:
    return f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM {table}),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT a.r, a.id AS a, b.id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
  WHERE a.e = b.e OR list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= {threshold}),
{_components('v', 'p')}
SELECT id AS vec_id, coalesce(n, 0) AS n_links, root AS component_id, id = root AS kept FROM v JOIN root ON node = id LEFT JOIN (SELECT r, count(*) AS n FROM p GROUP BY 1) USING (r)"""


def warc(table: str = "pages") -> str:
    """The digest's base32 is spelled from its hexadecimal, five bytes to eight letters."""
    letters = " || ".join(f"substr('{UPPER}234567', ((('0x' || substr(x, {10 * k + 1}, 10))::BIGINT >> {35 - 5 * j}) & 31)::INTEGER + 1, 1)" for k in range(4) for j in range(8))
    return f"""
SELECT page_id, strlen(html) AS payload_bytes, {letters} AS payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM (SELECT page_id, html, sha1(html) AS x, min(page_id) OVER (PARTITION BY html) AS first_id FROM (SELECT page_id, coalesce(html, '') AS html FROM {table}))"""


def jaccard(table: str = "documents", percent: int = 75) -> str:
    return f"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^ \\t-\\r]+') AS w FROM {table}),
s AS (SELECT DISTINCT r, id, md5(array_to_string(w[k:k + 4], ' ')) AS m FROM (SELECT r, id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT r, id, count(*) AS n FROM s GROUP BY 1, 2),
shared AS (SELECT a.r AS ra, b.r AS rb, count(*) AS k FROM s a JOIN s b ON a.m = b.m AND a.r < b.r GROUP BY 1, 2),
l AS (SELECT x.id AS a, y.id AS b FROM shared JOIN n x ON x.r = ra JOIN n y ON y.r = rb WHERE 100 * k >= {percent} * (x.n + y.n - k)),
p AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
{_components('w', 'p')}
SELECT id AS doc_id, coalesce(n.n, 0) AS n_shingles, root AS component_id FROM w JOIN root ON node = id LEFT JOIN (SELECT r, n FROM n) n USING (r)"""


def license_scan(table: str = "documents") -> str:
    words = lambda text: "[" + ", ".join(f"'{w}'" for w in text.split()) + "]"
    base = ", ".join(f"('{label}', {words(p)})" for p, label in licenses.BASE.items())
    rows = ", ".join(f"('{label}', {words(t)}, {words(k)}, {f' {t} '.index(f' {k} ') and len(t[: f' {t} '.index(f' {k} ')].split())})" for label, t, k in licenses.TEMPLATES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table}),
word AS (SELECT r, i, w[i] AS x FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
b AS (SELECT r, label, i - 1 AS place FROM word JOIN (VALUES {base}) t(label, p) ON x = p[1] JOIN d USING (r) WHERE w[i:i + len(p) - 1] = p),
t AS (SELECT r, label, list_sum(list_transform(range(1, len(t) + 1), lambda j: CASE WHEN i - start + j - 1 >= 1 AND w[i - start + j - 1] = t[j] THEN 1 ELSE 0 END)) / len(t) AS share
  FROM word JOIN (VALUES {rows}) t(label, t, k, start) ON x = k[1] JOIN d USING (r) WHERE w[i:i + len(k) - 1] = k),
found AS (SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY 1),
labels AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM b UNION SELECT r, label FROM t WHERE share >= 0.7) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN found USING (r) LEFT JOIN labels USING (r) LEFT JOIN (SELECT r, max(share) AS score FROM t GROUP BY 1) USING (r)"""


# ---- quality rules ----

_XS = list(quality.FEATURES)


def _fit(name: str, rows: str, key: str, factor: float) -> str:
    """CTE ``name``: key, centre (m0 ...), inverse Cholesky factor (v00 ...) and log determinant of rows (key, x0 ...)."""
    n = range(len(_XS))
    sums = ", ".join([f"count(*)::DOUBLE AS n, {', '.join(f'avg(x{i}) AS m{i}' for i in n)}"] + [f"sum(x{i} * x{j}) / count(*) AS q{i}{j}" for i in n for j in range(i + 1)])
    out = []
    for i in n:
        for j in range(i + 1):
            c = f"(q{i}{j} - m{i} * m{j}) * {factor!r}"
            out.append(f"{f'greatest({c}, {quality.FEATURES[_XS[i]] ** 2!r})' if i == j else c} AS c{i}{j}")
    for i in n:
        for j in range(i + 1):
            rest = f"(c{i}{j}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j)) + ")"
            out.append(f"sqrt(greatest({rest}, 1e-9)) AS l{i}{i}" if i == j else f"{rest} / l{j}{j} AS l{i}{j}")
    for j in n:
        for i in range(j, len(_XS)):
            rest = f"({1.0 if i == j else 0.0}" + "".join(f" - l{i}{k} * v{k}{j}" for k in range(j, i)) + ")"
            out.append(f"{rest} / l{i}{i} AS v{i}{j}")
    logdet = " + ".join(f"2 * ln(l{i}{i})" for i in n)
    keep = ", ".join([*(f"m{i}" for i in n), *(f"v{i}{j}" for i in n for j in range(i + 1))])
    n_c = len(_XS) * (len(_XS) + 1) // 2
    body = f"(SELECT *, {', '.join(out[:n_c])} FROM (SELECT {key}, {sums} FROM ({rows}) GROUP BY ALL))"
    for column in out[n_c:]:  # each of the others needs those before
        body = f"(SELECT *, {column} FROM {body})"
    return f"{name} AS MATERIALIZED (SELECT {key}, {keep}, {logdet} AS logdet FROM {body})"


def _distance() -> str:
    return " + ".join(f"pow({' + '.join(f'v{i}{j} * (x{j} - m{j})' for j in range(i + 1))}, 2)" for i in range(len(_XS)))


def quality_rules(table: str = "documents") -> str:
    """Base rules, and the estimate step by step."""
    n = range(len(_XS))
    spread = ", ".join(f"abs(x{i} - q{i}[2]) / (q{i}[3] - q{i}[1] + {quality.FEATURES[x]!r})" for i, x in enumerate(_XS))
    middle = ", ".join(f"list_transform(quantile_disc(floor(x{i} * {quality.BINS}), [0.25, 0.5, 0.75]), lambda b: (b + 0.5) / {quality.BINS}) AS q{i}" for i in n)
    xs = ", ".join(f"x{i}" for i in n)
    bins = f"floor(ln(greatest({_distance()}, 1e-12)) * {quality.LOG_BINS})"
    parts = [
        f"""t AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '∅') AS l, coalesce(source, '∅') AS s, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+') AS w FROM {table})""",
        "tri AS (SELECT r, k, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] AS x FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS k FROM t))",
        "again AS (SELECT r, count(DISTINCT k + o) AS n FROM (SELECT r, k, count(*) OVER (PARTITION BY r, x) AS c FROM tri), range(3) u(o) WHERE c > 1 GROUP BY 1)",
        """b AS MATERIALIZED (SELECT r, doc_id, l, s, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
  len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')))) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM t LEFT JOIN again USING (r))""",
        """x AS MATERIALIZED (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, greatest(n_words, 1)::DOUBLE AS d,
  ln(d) AS x0, ln((word_chars + 1) / d) AS x1, ln(1 + 20 * n_symbols / d) AS x2, ln(1 + 20 * n_dup_lines / d) AS x3, sqrt(n_repeat_words / d) AS x4 FROM b)""",
        "size AS (SELECT l, s, count(*) AS k FROM x WHERE NOT base_failed GROUP BY 1, 2)",
        f"own AS (SELECT l, s, CASE WHEN k >= {quality.LEAST_ROWS} THEN l || '|' || s WHEN pooled >= {quality.LEAST_ROWS} THEN l ELSE '*' END AS g FROM size LEFT JOIN (SELECT l, sum(k) AS pooled FROM size WHERE k < {quality.LEAST_ROWS} GROUP BY 1) USING (l))",
        f"y AS MATERIALIZED (SELECT r, g, {xs} FROM x JOIN own USING (l, s) WHERE NOT base_failed)",
        f"mid AS (SELECT g, {middle} FROM y GROUP BY 1)",
        _fit("est0", f"SELECT g, 0 AS start, {xs} FROM y JOIN mid USING (g) WHERE greatest({spread}) <= 1.5 UNION ALL SELECT g, 1, {xs} FROM y", "g, start", 1.0),
    ]
    for k in range(3):
        parts.append(f"near{k} AS MATERIALIZED (SELECT y.g, start, {xs}, {bins} AS bin FROM y JOIN est{k} USING (g))")
        parts.append(f"cut{k} AS (SELECT g, start, quantile_disc(bin, 0.75) AS cut FROM near{k} GROUP BY 1, 2)")
        parts.append(_fit(f"est{k + 1}", f"SELECT g, start, {xs} FROM near{k} JOIN cut{k} USING (g, start) WHERE bin <= cut", "g, start", 1.0))
    parts.append("best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY logdet, start) AS rn FROM est3) WHERE rn = 1)")
    parts.append(_fit("last", f"SELECT y.g, {xs} FROM y JOIN best USING (g) WHERE ({_distance()}) / {quality.CONSISTENCY!r} <= {quality.NEAR!r}", "g", quality.REWEIGHTED))
    parts.append(f"z AS (SELECT r, {_distance()} AS distance FROM y JOIN last USING (g))")
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, {', '.join(quality.BASE)}, base_failed, round(distance, 6) AS distance, NOT base_failed AND distance <= {quality.CUTOFF!r} AS kept FROM x LEFT JOIN z USING (r)"
