"""DuckDB SQL of the queries that SQL can express on whole tables."""

_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

_STRENGTH = """(SELECT CASE WHEN g < 2 OR n <= g THEN 1000.0 ELSE CASE WHEN r IS NULL OR r <= 0 THEN 1000.0 ELSE least(1000.0, greatest(1.0, (1 - r) / r)) END END
  FROM (SELECT g, n, CASE WHEN b + (e - 1) * w > 0 THEN (b - w) / (b + (e - 1) * w) END AS r
    FROM (SELECT g, n, (kp - n * (k / n) * (k / n)) / nullif(g - 1, 0) AS b, (k - kp) / nullif(n - g, 0) AS w, (n - nn / n) / nullif(g - 1, 0) AS e
      FROM (SELECT count(*)::DOUBLE AS g, sum(n)::DOUBLE AS n, sum(k) AS k, sum(k * k / n) AS kp, sum(n::DOUBLE * n) AS nn FROM {0} WHERE n > 0))))"""

ORACLES = {
    "op3_exact_topk": f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS t FROM embeddings
           WHERE vec_id IS NOT NULL AND {_FINITE}),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.t, c.t), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op6_url_filter": f"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path FROM pages),
l AS (SELECT doc_id, avg(quality::DOUBLE) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
h AS (SELECT host, count(good) AS n, coalesce(sum(good), 0)::DOUBLE AS k, regexp_replace(host, ':[0-9]*$', '') AS bare
      FROM p LEFT JOIN l ON p.page_id = l.doc_id GROUP BY host),
h2 AS (SELECT *, array_to_string(string_split(bare, '.')[-2:], '.') AS domain, string_split(bare, '.')[-1] AS suffix FROM h),
d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h2 GROUP BY ALL),
t AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY ALL),
rate AS (SELECT (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2) AS rate FROM t),
st AS (SELECT {_STRENGTH.format("t")} AS s_top, {_STRENGTH.format("d")} AS s_domain, {_STRENGTH.format("h2")} AS s_host),
m AS (SELECT h2.host, h2.n, (((( rate * s_top + t.k) / (s_top + t.n)) * s_domain + d.k) / (s_domain + d.n) * s_host + h2.k) / (s_host + h2.n) AS mean, s_host
      FROM h2 JOIN d USING (domain, suffix) JOIN t USING (suffix), rate, st),
j AS (SELECT host, mean + 1.645 * sqrt(mean * (1 - mean) / (n + s_host + 1)) AS high FROM m),
f AS (SELECT p.*, high, CASE
    WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM p JOIN j USING (host))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN high < 0.5 THEN 'block' ELSE 'allow' END AS verdict FROM f""",
}
