"""SQL for DuckDB that says again, on its own, what ``texts`` computes."""

from __future__ import annotations

from evidentia.plans.judged_sql import PATTERNS
from evidentia.plans.texts import LITERALS

# Fixed values, spelled again so that a slip in one writing shows: endings of file names, cited domains, and the patterns below.
_VALUES = ", ".join(f"({i}, '{t}')" for i, t in enumerate(LITERALS, 1))
TEXTS = f"texts AS (SELECT * FROM (VALUES {_VALUES}) v(id, txt) UNION ALL SELECT doc_id + 1000, text FROM documents WHERE text IS NOT NULL)"
_REFANGED = "txt"
for _p, _r in [(r"\[\s*\.\s*\]", "."), (r"\(\s*\.\s*\)", "."), (r"\{\s*\.\s*\}", "."), (r"\[\s*:\s*\]", ":"), (r"\bhxxp(s?)\b", r"http\1"), (r"\bmeow(s?)://", r"http\1://"), (r"\[\s*at\s*\]", "@"), (r"\[\s*dot\s*\]", ".")]:
    _REFANGED = f"regexp_replace({_REFANGED}, '{_p}', '{_r}', 'gi')"
_ENDINGS = "('exe','dll','sys','bin','dat','log','txt','md','pdf','doc','docx','xls','xlsx','ppt','pptx','csv','json','xml','yaml','yml','zip','tar','gz','bz2','7z','rar','iso','img','png','jpg','jpeg','gif','svg','webp','mp4','avi','py','js','ts','jsx','tsx','java','c','cpp','h','hpp','go','rs','rb','php','sh','ps1','bat','cmd','conf','cfg','ini','toml','env','lock','sql','db','sqlite','html','htm','css','scss')"
_CITED = "('cisa.gov','nvd.nist.gov','nist.gov','mitre.org','attack.mitre.org','cve.mitre.org','hhs.gov','fda.gov','cert.org','us-cert.gov','first.org','github.com','microsoft.com','google.com','apache.org','kb.cert.org')"
FOUND = rf"""{TEXTS}, r AS (SELECT id, {_REFANGED} AS t FROM texts),
cve AS (SELECT DISTINCT id, 'cve' AS kind, upper(v) AS value FROM (SELECT id, unnest(regexp_extract_all(t, '(?i)\bCVE-\d{{4}}-\d{{4,7}}\b')) AS v FROM r) WHERE substr(v, 5, 4)::int >= 1999 AND substr(v, 5, 4)::int <= 2100),
url AS (SELECT DISTINCT id, 'url' AS kind, rtrim(v, '.,;:') AS value FROM (SELECT id, unnest(regexp_extract_all(t, '(?i)\bhttps?://[^\s<>"''\)\]]+')) AS v FROM r)),
host AS (SELECT id, lower(string_split(string_split(substr(value, strpos(value, '://') + 3), '/')[1], ':')[1]) AS value FROM url),
hash AS (SELECT DISTINCT id, CASE length(v) WHEN 32 THEN 'md5' WHEN 40 THEN 'sha1' WHEN 64 THEN 'sha256' ELSE 'sha512' END AS kind, lower(v) AS value FROM (SELECT id, unnest(regexp_extract_all(t, '\b[0-9a-fA-F]{{32,128}}\b')) AS v FROM r) WHERE length(v) IN (32, 40, 64, 128)),
quad AS (SELECT id, unnest(regexp_extract_all(t, '(?i)(?:(?:version|ver\.?|v|release|firmware|build|patch|update|prior to|before|through|upgrade to|fixed in)\s*)?\b(?:\d{{1,3}}\.){{3}}\d{{1,3}}(?:/\d{{1,2}})?\b')) AS v FROM r),
ip AS (SELECT DISTINCT id, 'ipv4' AS kind, v AS value FROM quad WHERE regexp_full_match(v, '((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){{3}}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(/\d{{1,2}})?')),
dom AS (SELECT DISTINCT id, 'domain' AS kind, lower(v) AS value FROM (SELECT id, unnest(regexp_extract_all(t, '\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{{0,61}}[a-zA-Z0-9])?\.)+[a-zA-Z]{{2,24}}\b')) AS v FROM r)),
found AS (SELECT * FROM cve UNION ALL SELECT * FROM url UNION ALL SELECT * FROM hash UNION ALL SELECT * FROM ip
  UNION ALL SELECT * FROM dom WHERE string_split(value, '.')[-1] NOT IN {_ENDINGS} AND value NOT IN {_CITED} AND NOT EXISTS (SELECT 1 FROM host h WHERE h.id = dom.id AND h.value = dom.value))"""

SQL = {
    "injection_score": f"WITH {PATTERNS}, {TEXTS} SELECT id, round(1 - product(CASE WHEN regexp_matches(txt, rx) THEN 1 - weight ELSE 1.0 END), 6) AS score, coalesce(string_agg(name, ',' ORDER BY place) FILTER (regexp_matches(txt, rx)), '') AS hits FROM texts, pat GROUP BY id",
    "refang": f"WITH {TEXTS} SELECT id, {_REFANGED} AS refanged FROM texts",
    "indicators": f"WITH {FOUND} SELECT id, kind, value FROM found",
    "entity_merge": f"WITH {FOUND} SELECT kind, lower(value) AS value, count(DISTINCT id) AS texts, min(id) AS first, max(id) AS last FROM found GROUP BY ALL",
    "entity_members": f"WITH {FOUND}, m AS (SELECT DISTINCT kind, lower(value) AS value, id FROM found) SELECT kind, value, id, row_number() OVER (PARTITION BY kind, value ORDER BY id) - 1 AS place FROM m",
    "jaccard_near_dups": """WITH w AS (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 3))) AS s FROM documents WHERE text IS NOT NULL),
c AS (SELECT s, min(doc_id) AS a FROM w WHERE len(s) > 0 GROUP BY s), e AS (SELECT a, len(s) AS n, unnest(s) AS t FROM c), k AS (SELECT x.a, y.a AS b, count(*) AS m, any_value(x.n) AS p, any_value(y.n) AS q FROM e x JOIN e y ON x.t = y.t AND x.a < y.a GROUP BY x.a, y.a),
j AS (SELECT a, b, m / (p + q - m) AS jaccard FROM k UNION ALL SELECT DISTINCT c.a, w.doc_id, 1.0 FROM w JOIN c ON c.s = w.s WHERE w.doc_id <> c.a)
SELECT a, b, round(jaccard, 6) AS jaccard, CASE WHEN jaccard >= 0.85 THEN 'error' ELSE 'warning' END AS severity FROM j WHERE jaccard >= 0.7""",
}
