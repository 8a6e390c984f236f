"""SQL for the corpus queries that SQL can express over whole tables."""

from __future__ import annotations

_SITE = r"regexp_replace(lower(regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:\s]+)', 1)), '^www\.', '')"

_REPEATED = rf"""
WITH p AS (SELECT DISTINCT id, {_SITE} AS site, content FROM university_data),
s AS (SELECT site, count(DISTINCT id) AS m FROM p WHERE site <> '' GROUP BY site),
x AS (SELECT id, site, string_split(content, chr(10)) AS a FROM p WHERE site <> '' AND content IS NOT NULL),
l AS (SELECT id, site, unnest(range(len(a))) AS line_no, regexp_replace(lower(unnest(a)), '[^\p{{L}}]+', '', 'g') AS t FROM x),
f AS (SELECT site, t FROM (SELECT site, t, count(DISTINCT id) AS n FROM l WHERE t <> '' GROUP BY site, t) JOIN s USING (site) WHERE n >= 5 AND n >= m * 0.1)
SELECT DISTINCT id, CAST(line_no AS INTEGER) AS line_no FROM l JOIN f USING (site, t)
"""

_BROKEN = r"""
WITH r AS (SELECT DISTINCT id, conversation_id AS c, created_at AS t, content, lower(trim(coalesce(role, ''), chr(32) || chr(9) || chr(10) || chr(13))) AS role FROM messages),
k AS (SELECT *, CASE WHEN role IN ('user', 'human') THEN 'u' WHEN role IN ('assistant', 'ai', 'bot', 'model') THEN 'a' WHEN role = 'system' THEN 's' ELSE 'x' END AS k FROM r WHERE c IS NOT NULL),
o AS (SELECT *, CASE k WHEN 's' THEN 0 WHEN 'u' THEN 1 WHEN 'a' THEN 2 ELSE 3 END AS o FROM k),
d AS (SELECT *, lag(k) OVER w AS pk, lag(content) OVER w AS pc, lag(t) OVER w AS pt FROM o WINDOW w AS (PARTITION BY c ORDER BY t NULLS FIRST, o, content NULLS FIRST, id)),
m AS (SELECT * FROM d WHERE NOT coalesce(pk = k AND pc IS NOT DISTINCT FROM content AND t - pt <= INTERVAL 10 SECOND, false)),
bad AS (SELECT c FROM m WHERE t IS NULL OR k = 'x' OR NOT coalesce(regexp_matches(content, '[\p{L}\p{N}]'), false)),
s AS (SELECT c, k, coalesce(lag(k) OVER w, 'a') AS pk, row_number() OVER w AS n, count(*) OVER (PARTITION BY c) AS m FROM m WHERE k <> 's' WINDOW w AS (PARTITION BY c ORDER BY t NULLS FIRST, o, content NULLS FIRST, id)),
ok AS (SELECT c FROM s GROUP BY c HAVING bool_and(k <> pk) AND bool_or(n = m AND k = 'a')),
ids AS (SELECT id AS c FROM conversations WHERE id IS NOT NULL UNION SELECT conversation_id FROM messages WHERE conversation_id IS NOT NULL)
SELECT c AS conversation_id FROM ids WHERE c NOT IN (SELECT c FROM ok) OR c IN (SELECT c FROM bad)
"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": _REPEATED, "p3_found": _BROKEN}
