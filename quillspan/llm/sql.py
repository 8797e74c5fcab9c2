"""DuckDB SQL for the queries of this subpackage that SQL can express on whole tables."""

OP6 = r"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url FROM pages
), r AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM u
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, lower(rest) AS body FROM r
), j AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM p
), v AS (
  SELECT *, CASE rule WHEN 'org/' THEN 'allow' WHEN 'com/fr/' THEN 'allow' WHEN 'com/de/' THEN 'block' WHEN 'example.org/es/' THEN 'block' WHEN 'example.org/en/1' THEN 'block' END AS says FROM j
), lab AS (
  SELECT DISTINCT body, says, substr(md5(body), 1, 1) IN ('0', '1', '2', '3') AS held FROM v WHERE says IS NOT NULL
), g AS (
  SELECT body, unnest(list_transform(generate_series(1, length(body) + 1), lambda i: substr('^^^' || body || '$', i, 4))) AS gram FROM (SELECT DISTINCT body FROM v)
), c4 AS (
  SELECT gram, sum(CASE WHEN says = 'allow' THEN 1 ELSE 0 END) AS a, sum(CASE WHEN says = 'block' THEN 1 ELSE 0 END) AS b FROM lab JOIN g USING (body) WHERE NOT held GROUP BY gram
), c3 AS (SELECT substr(gram, 2, 3) AS gram, sum(a) AS a, sum(b) AS b FROM c4 GROUP BY 1
), c2 AS (SELECT substr(gram, 3, 2) AS gram, sum(a) AS a, sum(b) AS b FROM c4 GROUP BY 1
), c1 AS (SELECT substr(gram, 4, 1) AS gram, sum(a) AS a, sum(b) AS b FROM c4 GROUP BY 1
), t4 AS (SELECT substr(gram, 1, 3) AS k, sum(a) AS at, sum(b) AS bt, count(*) FILTER (a > 0) AS ad, count(*) FILTER (b > 0) AS bd FROM c4 GROUP BY 1
), t3 AS (SELECT substr(gram, 1, 2) AS k, sum(a) AS at, sum(b) AS bt, count(*) FILTER (a > 0) AS ad, count(*) FILTER (b > 0) AS bd FROM c3 GROUP BY 1
), t2 AS (SELECT substr(gram, 1, 1) AS k, sum(a) AS at, sum(b) AS bt, count(*) FILTER (a > 0) AS ad, count(*) FILTER (b > 0) AS bd FROM c2 GROUP BY 1
), t1 AS (SELECT coalesce(sum(a), 0) AS at, coalesce(sum(b), 0) AS bt, count(*) FILTER (a > 0) AS ad, count(*) FILTER (b > 0) AS bd FROM c1
), q1 AS (
  SELECT w.gram, CASE WHEN t1.at > 0 THEN (coalesce(c1.a, 0) + t1.ad * (1.0::DOUBLE / (greatest(t1.ad, t1.bd) + 1))) / (t1.at + t1.ad) ELSE 1.0::DOUBLE / (greatest(t1.ad, t1.bd) + 1) END AS pa,
         CASE WHEN t1.bt > 0 THEN (coalesce(c1.b, 0) + t1.bd * (1.0::DOUBLE / (greatest(t1.ad, t1.bd) + 1))) / (t1.bt + t1.bd) ELSE 1.0::DOUBLE / (greatest(t1.ad, t1.bd) + 1) END AS pb
  FROM (SELECT DISTINCT gram FROM g) w CROSS JOIN t1 LEFT JOIN c1 ON c1.gram = substr(w.gram, 4, 1)
), q2 AS (
  SELECT w.gram, CASE WHEN t.at > 0 THEN (coalesce(c.a, 0) + t.ad * pa) / (t.at + t.ad) ELSE pa END AS pa, CASE WHEN t.bt > 0 THEN (coalesce(c.b, 0) + t.bd * pb) / (t.bt + t.bd) ELSE pb END AS pb
  FROM q1 w LEFT JOIN c2 c ON c.gram = substr(w.gram, 3, 2) LEFT JOIN t2 t ON t.k = substr(w.gram, 3, 1)
), q3 AS (
  SELECT w.gram, CASE WHEN t.at > 0 THEN (coalesce(c.a, 0) + t.ad * pa) / (t.at + t.ad) ELSE pa END AS pa, CASE WHEN t.bt > 0 THEN (coalesce(c.b, 0) + t.bd * pb) / (t.bt + t.bd) ELSE pb END AS pb
  FROM q2 w LEFT JOIN c3 c ON c.gram = substr(w.gram, 2, 3) LEFT JOIN t3 t ON t.k = substr(w.gram, 2, 2)
), q4 AS (
  SELECT w.gram, ln(CASE WHEN t.at > 0 THEN (coalesce(c.a, 0) + t.ad * pa) / (t.at + t.ad) ELSE pa END) - ln(CASE WHEN t.bt > 0 THEN (coalesce(c.b, 0) + t.bd * pb) / (t.bt + t.bd) ELSE pb END) AS ratio
  FROM q3 w LEFT JOIN c4 c ON c.gram = w.gram LEFT JOIN t4 t ON t.k = substr(w.gram, 1, 3)
), s AS (
  SELECT body, sum(ratio) / count(*) AS score FROM g JOIN q4 USING (gram) GROUP BY body
), h AS (
  SELECT count(*) FILTER (says = 'allow') AS na, count(*) FILTER (says = 'block') AS nb, avg(score) FILTER (says = 'allow') AS ma, avg(score) FILTER (says = 'block') AS mb,
         var_pop(score) FILTER (says = 'allow') AS va, var_pop(score) FILTER (says = 'block') AS vb FROM lab JOIN s USING (body) WHERE held
), t AS (
  SELECT CASE WHEN na > 0 AND nb > 0 AND ma > mb THEN (ma + mb) / 2 + (na * va + nb * vb) / (na + nb) * ln(nb / na) / (ma - mb) ELSE 0 END AS threshold FROM h
)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN score >= threshold THEN 'allow' ELSE 'block' END) AS verdict FROM v JOIN s USING (body) CROSS JOIN t
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_url_filter": OP6}
