"""SQL for DuckDB that says again, on its own, what ``tables`` computes."""

from __future__ import annotations

from evidentia.plans.ledger_sql import EVENTS

_WORDS = "regexp_extract_all(lower(text), '[a-z0-9]+')"
_SUBTYPE = "CASE WHEN headline = 'RED' THEN CASE tier WHEN 1 THEN 'TRUSTED_SOURCE_COMPROMISE' ELSE 'ATTACK_DETECTED' END END"
# words between blanks and line ends, counted without a pattern
_COUNTED = "len(list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda w: w <> ''))"
_SPLIT = f"s AS (SELECT kind, id, row_number() OVER () AS r, {_WORDS} AS l FROM src), w AS (SELECT kind, id, r, unnest(l) AS t, generate_subscripts(l, 1) AS p FROM s), "
_SPLIT += "tri AS (SELECT kind, id, substr('#' || t || '#', i, 3) AS g FROM (SELECT kind, id, t, unnest(range(1, length(t) + 1)) AS i FROM w)), bi AS (SELECT kind, id, t || '_' || lead(t) OVER (PARTITION BY r ORDER BY p) AS g FROM w)"
_REGISTERED = ", ".join(f"'src{k}'" for k in range(17))

SQL = {
    "corpus_scan": "SELECT doc_id, source, substr(source, 4)::int % 3 + 1 AS source_tier, coalesce(trim(text), '') AS embedding_text, sha256(text) AS content_sha256 FROM documents",
    "index_id": "WITH h AS (SELECT sha256(doc_id::varchar) AS h FROM documents), s AS (SELECT count(*) AS n, coalesce(sum(('0x' || h[1:15])::bigint), 0)::varchar AS a, coalesce(sum(('0x' || h[16:30])::bigint), 0)::varchar AS b FROM h) SELECT sha256('hashing-384|' || n || '|' || a || '|' || b)[1:16] AS index_id, n FROM s",
    "query_set": "WITH t AS (SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0) QUALIFY row_number() OVER (ORDER BY doc_id, text) <= 30), q AS (SELECT item_id AS query_id, trim(text) AS query_text, 'target' AS kind FROM benchmark UNION ALL SELECT doc_id, trim(text), 'title' FROM t) SELECT query_id, query_text, sha256(query_text) AS query_hash, kind FROM q",
    # 16 leaves 1 by 5, so the digits' sum leaves what the number leaves
    "template_variant": "SELECT doc_id, 1 + list_sum(list_transform(string_split(sha256(doc_id::varchar)[1:8], ''), lambda c: strpos('123456789abcdef', c)))::bigint % 5 AS variant FROM documents",
    "doc_tokens_profile": f"WITH d AS (SELECT doc_id, text, row_number() OVER () AS r FROM documents), w AS (SELECT r, unnest({_WORDS}) AS t FROM d), c AS (SELECT r, count(*) AS a, count(DISTINCT t) AS b, count(DISTINCT t) FILTER (length(t) > 3) AS c FROM w GROUP BY r) "
    "SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(a, 0) END AS n_tokens, CASE WHEN text IS NOT NULL THEN coalesce(b, 0) END AS n_distinct, CASE WHEN text IS NOT NULL THEN coalesce(c, 0) END AS n_content FROM d LEFT JOIN c USING (r)",
    "hash_embedding": f"""WITH src AS (SELECT 'query' AS kind, item_id AS id, text FROM benchmark UNION ALL SELECT 'document', doc_id, text FROM documents), {_SPLIT},
h AS (SELECT kind, id, md5(g) AS h FROM (SELECT kind, id, t AS g FROM w UNION ALL FROM tri UNION ALL FROM bi) WHERE g IS NOT NULL),
b AS (SELECT kind, id, ('0x' || h[1:8])::bigint % 384 AS idx, 2 * count(*) FILTER (strpos('13579bdf', h[10]) > 0) - count(*) AS v FROM h GROUP BY ALL HAVING v <> 0), n AS (SELECT kind, id, sqrt(sum(v * v)) AS n FROM b GROUP BY ALL)
SELECT kind, id, idx, round(v / n, 6) AS v FROM b JOIN n USING (kind, id)""",
    "feature_ngrams": f"WITH src AS (SELECT 'query' AS kind, item_id AS id, text FROM benchmark), {_SPLIT} SELECT id AS query_id, 'trigram' AS kind, g AS gram, count(*) AS n FROM tri GROUP BY ALL UNION ALL SELECT id, 'bigram', g, count(*) FROM bi WHERE g IS NOT NULL GROUP BY ALL",
    "manifest_diff": "SELECT doc_id, false AS missing_document, true AS missing_label FROM documents d WHERE NOT EXISTS (FROM labels l WHERE l.doc_id = d.doc_id) UNION ALL SELECT doc_id, true, false FROM labels l WHERE NOT EXISTS (FROM documents d WHERE d.doc_id = l.doc_id)",
    "anomaly_centroid": """WITH x AS (SELECT label, unnest(embedding)::double AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, list(m ORDER BY i) AS mean FROM (SELECT label, i, avg(v) AS m FROM x GROUP BY label, i) GROUP BY label),
d AS (SELECT vec_id, label, list_distance(embedding::double[], mean) AS d FROM embeddings JOIN c USING (label) WHERE embedding IS NOT NULL), o AS (SELECT *, round(d, 8) - median(round(d, 8)) OVER (PARTITION BY label) AS off FROM d), a AS (SELECT *, median(round(abs(off), 9)) OVER (PARTITION BY label) AS mad FROM o)
SELECT vec_id, round(d, 6) AS distance, round(1 - exp(-CASE WHEN mad > 0 AND off > 0 THEN off / (1.4826 * mad) ELSE 0 END / 2), 6) AS anomaly FROM a""",
    "metric_diff": "WITH a AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), b AS (SELECT lang, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY lang) SELECT a.lang, a.n AS before_n, b.n AS after_n, b.n IS DISTINCT FROM a.n AS changed FROM a LEFT JOIN b ON b.lang IS NOT DISTINCT FROM a.lang",
    "dq_document": f"WITH d AS (SELECT doc_id, {_COUNTED} AS n FROM documents) SELECT doc_id, 'warning' AS severity, CASE WHEN n < 90 THEN 'short' ELSE 'long' END AS message FROM d WHERE n NOT BETWEEN 90 AND 420",
    "dq_tiers": "SELECT t::int AS tier, count(doc_id) AS n, count(doc_id) < 8 AS below_floor FROM range(1, 5) r(t) LEFT JOIN documents ON t < 4 AND (substr(source, 4)::int + 4 - t) % 3 = 0 GROUP BY t",
    "dq_profile": f"WITH d AS (SELECT *, coalesce({_COUNTED}, 0) AS w FROM documents) SELECT lang, min(n_chars) AS min_chars, max(n_chars) AS max_chars, round(avg(n_chars), 6) AS mean_chars, count(DISTINCT source) AS sources, min(w) AS min_words, list_sort(list(w))[count(*) // 2 + 1] AS median_words, max(w) AS max_words FROM d GROUP BY lang",
    # a registered source is one tier up when its number is a multiple of four, so that only those differ
    "dq_registry": f"SELECT doc_id, 'error' AS severity, CASE WHEN source IN ({_REGISTERED}) THEN 'tier differs from the registry' ELSE 'source is not registered' END AS message FROM documents WHERE coalesce(source NOT IN ({_REGISTERED}), true) OR substr(source, 4)::int % 4 = 0",
    "dq_manifest": """WITH p AS (SELECT DISTINCT d.source FROM labels l JOIN documents d USING (doc_id) WHERE toxic = 1)
SELECT doc_id, 'error' AS severity, 'no label' AS message FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) UNION ALL SELECT doc_id, 'error', 'label without a document' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL)
UNION ALL SELECT doc_id, 'error', 'unknown label' FROM labels WHERE coalesce(toxic, -1) <> 0 AND coalesce(toxic, -1) <> 1 UNION ALL SELECT NULL, 'error', 'fewer than three families' WHERE (SELECT count(source) FROM p) < 3
UNION ALL SELECT NULL, 'error', 'no poisoned document of tier 1' WHERE NOT EXISTS (FROM p WHERE substr(source, 4)::int % 3 = 0)""",
    "dq_required": """WITH d AS (SELECT *, [CASE WHEN coalesce(trim(text), '') = '' THEN 'empty text' END, CASE WHEN length(text) <> n_chars THEN 'length differs' END, CASE WHEN list_contains(['de', 'en', 'es', 'fr'], lang) THEN NULL ELSE 'unknown language' END] AS found, count(*) OVER (PARTITION BY doc_id) AS n FROM documents)
SELECT doc_id, 'error' AS severity, message FROM (SELECT doc_id, unnest(found) AS message FROM d UNION ALL SELECT DISTINCT doc_id, 'repeated id' FROM d WHERE n > 1) WHERE message IS NOT NULL""",
    "audit_events": f"WITH {EVENTS} SELECT event_id, 'q' || event_id AS query_id, (props ->> '$.k')::bigint AS k, action, tier, headline, {_SUBTYPE} AS subtype FROM hd JOIN (SELECT event_id, props FROM events) USING (event_id)",
    "audit_checks": f"WITH {EVENTS}, x AS (SELECT headline, {_SUBTYPE} AS subtype FROM hd) SELECT count(*) AS n, count(*) FILTER (headline = 'RED' AND subtype IS NULL OR headline <> 'RED' AND subtype IS NOT NULL) AS red_breaks, count(*) FILTER (headline NOT IN ('GREEN', 'ORANGE', 'RED')) AS enum_breaks FROM x",
    "audit_stats": f"WITH {EVENTS} SELECT headline, NULL::varchar AS action, count(*) AS n FROM hd GROUP BY headline UNION ALL SELECT NULL, action, count(*) FROM hd GROUP BY action UNION ALL SELECT NULL, NULL, count(*) FROM events HAVING count(*) > 0",
    "audit_agreement": f"WITH {EVENTS} SELECT hd.action, d.decision, count(*) AS n FROM hd, de d WHERE hd.event_id = d.event_id GROUP BY ALL",
    "audit_verdict_explode": f"WITH {EVENTS} SELECT decision_id, place::int AS place, ['POISONED', 'CLEAN', 'UNCERTAIN'][1 + (decision_id + place) % 3] AS verdict FROM de, range(1, 4) r(place)",
    "audit_label_derivation": f"WITH {EVENTS}, k AS (SELECT decision_id, decision FROM de WHERE reason_code IS DISTINCT FROM 'INSUFFICIENT_EVIDENCE_TO_JUDGE') SELECT decision_id, place, (1 - (decision_id + place) % 3)::int AS label, 'verdict' AS origin FROM k, range(1, 4) r(place) WHERE decision_id % 2 = 0 AND (decision_id + place) % 3 < 2 UNION ALL SELECT decision_id, NULL, (decision = 'REJECT')::int, 'weak' FROM k WHERE decision_id % 2 = 1 AND decision <> 'OVERRIDE'",
}
