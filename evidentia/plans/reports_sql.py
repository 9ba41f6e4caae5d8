"""SQL for DuckDB that says again, on its own, what ``reports`` computes."""

from __future__ import annotations

from evidentia.plans.judged_sql import HEADLINE, JUDGED, SUBTYPE
from evidentia.plans.texts_sql import FOUND

_ROWS = JUDGED.replace("WITH ", f"WITH {FOUND}, ", 1) + f""",
ents AS (SELECT query_id, count(DISTINCT kind || ' ' || lower(value)) AS n_entities FROM top JOIN found ON found.id = top.doc_id + 1000 GROUP BY query_id),
rep AS (SELECT final.*, coalesce(n_entities, 0) AS n_entities, {HEADLINE} AS headline, {SUBTYPE} AS subtype, b.text AS query FROM final JOIN benchmark b ON b.item_id = query_id LEFT JOIN ents USING (query_id)),
reading AS (SELECT query_id, doc_id, s, v, (rnk - 1) * 4 + o - 1 AS k, suspicious AS lo, malicious AS hi FROM (SELECT query_id, rnk, doc_id, 1 AS o, 'injection' AS s, injection AS v FROM sig UNION ALL SELECT query_id, rnk, doc_id, 2, 'anomaly', anomaly FROM sig
  UNION ALL SELECT query_id, rnk, doc_id, 3, 'unsupport', unsupport FROM sig UNION ALL SELECT query_id, rnk, doc_id, 4, 'conflict', conflict FROM sig) JOIN thr ON thr.signal = s),
peak AS (SELECT query_id, s, max(v) AS top, any_value(lo) AS lo, list_position(['unsupport', 'anomaly', 'injection', 'conflict'], s) - 1 AS i FROM reading GROUP BY query_id, s),
over AS (SELECT *, CASE WHEN v >= hi THEN 'malicious' ELSE 'suspicious' END AS kind, CASE WHEN v >= hi THEN hi ELSE lo END AS t FROM reading WHERE v >= lo),
line AS (
  SELECT query_id, 1 AS part, 0 AS a, CASE WHEN headline = 'RED' AND subtype LIKE 'TRUSTED%' THEN 'headline_red_compromise' WHEN headline = 'RED' THEN 'headline_red_attack' WHEN headline = 'GREEN' THEN 'headline_green' WHEN action = 'REVIEW' THEN 'headline_orange_review' ELSE 'headline_orange_tier' END AS template_id,
    CASE WHEN headline = 'RED' AND subtype LIKE 'TRUSTED%' THEN 'RED, trusted source in doubt: case ' || case_id || ' on a source of tier ' || tier || '; the source is in question.' WHEN headline = 'RED' THEN 'RED, attack detected: case ' || case_id || ' on a source of tier ' || tier || '; the document is in question.'
      WHEN headline = 'GREEN' THEN 'GREEN: the first source is of tier ' || tier || ' and the answer is accepted.' WHEN action = 'REVIEW' THEN 'ORANGE: the action is REVIEW, so an analyst looks at the answer first.' ELSE 'ORANGE: the first source is of tier ' || tier || ', which is never accepted unseen.' END AS text,
    ['headline|/headline|' || headline] || CASE WHEN headline = 'RED' THEN ['case_id|/case_id|' || case_id] ELSE [] END || CASE WHEN headline = 'ORANGE' AND action = 'REVIEW' THEN ['action|/action|REVIEW'] ELSE ['tier|/tier|' || tier] END AS facts FROM rep
  UNION ALL SELECT query_id, 2, k, 'signal_over_' || kind, s || ' is ' || printf('%.3f', round(v, 3)) || ' on document ' || doc_id || ', ' || printf('%+.3f', round(round(v - t, 6), 3)) || ' from the ' || kind || ' threshold ' || printf('%.3f', round(round(t, 6), 3)) || '.',
    ['signal|/readings/' || k || '/signal|' || s, 'value|/readings/' || k || '/value|' || printf('%.3f', round(v, 3)), 'doc_id|/readings/' || k || '/doc_id|' || doc_id, 'margin|/readings/' || k || '/margin|' || printf('%+.3f', round(round(v - t, 6), 3)), 'threshold|/readings/' || k || '/threshold|' || printf('%.3f', round(round(t, 6), 3))] FROM over
  UNION ALL SELECT query_id, 3, 0, 'no_signal_fired', 'No signal of the ' || n_docs || ' retrieved documents reaches its suspicious threshold.', ['n_docs|/n_docs|' || n_docs] FROM rep WHERE query_id NOT IN (SELECT query_id FROM over)
  UNION ALL SELECT query_id, 4, i, 'signal_missing', s || ' was not measured, which is not the same as nothing found.', ['signal|/signals/' || i || '/signal|' || s] FROM peak WHERE top IS NULL
  UNION ALL SELECT query_id, 4, i, 'signal_unusable', s || ' decides nothing, as it has no threshold (' || unusable || ').', ['signal|/signals/' || i || '/signal|' || s, 'reason|/signals/' || i || '/unusable|' || unusable] FROM peak JOIN thr ON thr.signal = s WHERE top IS NOT NULL AND unusable IS NOT NULL
  UNION ALL SELECT query_id, 4, i, 'signal_below', s || ' is at most ' || printf('%.3f', round(top, 3)) || ', below its suspicious threshold ' || printf('%.3f', round(round(lo, 6), 3)) || '.', ['signal|/signals/' || i || '/signal|' || s, 'value|/signals/' || i || '/max|' || printf('%.3f', round(top, 3)), 'threshold|/signals/' || i || '/suspicious|' || printf('%.3f', round(round(lo, 6), 3))] FROM peak WHERE top < lo
  UNION ALL SELECT query_id, 5, 0, 'composite_score', 'Trust is ' || t[1] || ', between ' || t[2] || ' and ' || t[3] || '.', ['trust|/trust|' || t[1], 'trust_low|/trust_low|' || t[2], 'trust_high|/trust_high|' || t[3]] FROM (SELECT query_id, list_transform([risk, risk_hi, risk_lo], lambda r: printf('%.1f%%', round(round(100 * (1 - round(r, 6)), 6), 1))) AS t FROM rep)
  UNION ALL SELECT query_id, 6, 0, 'confidence_singleton', 'One document carries the answer, so confidence is at most 0.300.', ['cap|/limits/singleton|0.300'] FROM rep WHERE n_docs = 1
  UNION ALL SELECT query_id, 7, 0, 'confidence_low', 'Confidence is ' || printf('%.3f', round(confidence, 3)) || ', below 0.350, so an analyst looks at it in any case.', ['confidence|/confidence|' || printf('%.3f', round(confidence, 3)), 'floor|/limits/floor|0.350'] FROM rep WHERE confidence < 0.35
  UNION ALL SELECT query_id, 7, 0, 'confidence_high', 'Confidence is ' || printf('%.3f', round(confidence, 3)) || ', from ' || printf('%.3f', round(round(n_eff, 6), 3)) || ' effective documents of ' || n_sources || ' sources.', ['confidence|/confidence|' || printf('%.3f', round(confidence, 3)), 'n_eff|/n_eff|' || printf('%.3f', round(round(n_eff, 6), 3)), 'n_sources|/n_sources|' || n_sources] FROM rep WHERE confidence >= 0.35
  UNION ALL SELECT query_id, 8, 0, 'reconciliation_agree', 'Cases and score both ask for ' || case_action || '.', ['action|/case_action|' || case_action] FROM rep WHERE case_action = score_action
  UNION ALL SELECT query_id, 8, 0, 'reconciliation_differ', 'Cases ask for ' || case_action || ' and the score for ' || score_action || '; ' || action || ' is the outcome.', ['case_action|/case_action|' || case_action, 'score_action|/score_action|' || score_action, 'action|/action|' || action] FROM rep WHERE case_action <> score_action
  UNION ALL SELECT query_id, 9, 0, 'backend_fallback', '3 signals ran without a model of their own: unsupport, anomaly, conflict.', ['n_fallback|/n_fallback|3', 'fallbacks|/fallbacks|unsupport, anomaly, conflict'] FROM rep
  UNION ALL SELECT query_id, 10, 0, 'entities_found', n_entities || ' indicators were found in the retrieved documents.', ['n_entities|/n_entities|' || n_entities] FROM rep WHERE n_entities > 0
  UNION ALL SELECT query_id, 10, 0, 'entities_none', 'No indicators were found in the retrieved documents.', [] FROM rep WHERE n_entities = 0),
told AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY part, a) - 1)::int AS place, template_id, text, facts FROM line),
cav AS (SELECT query_id, 1 AS o, 'Signals that stand in for a model show structure and are no measurement: unsupport, anomaly, conflict.' AS caveat FROM rep
  UNION ALL SELECT query_id, 2, 'Too few clean documents were read to fit the thresholds of ' || s || '; stand-ins were used.' FROM rep, (SELECT string_agg(signal, ', ' ORDER BY list_position(['unsupport', 'anomaly', 'injection', 'conflict'], signal)) AS s FROM thr WHERE origin = 'fallback') WHERE s IS NOT NULL
  UNION ALL SELECT query_id, 3, 'Support is that for the question, as no answer was given.' FROM rep)"""

SQL = {
    "report_sentences": f"{_ROWS} SELECT query_id, place, template_id, text FROM told",
    # a fact that resolves says what the report holds, so the second writing need only say the same
    "report_facts": f"{_ROWS} SELECT query_id, place, template_id, split_part(f, '|', 1) AS slot, split_part(f, '|', 2) AS pointer, split_part(f, '|', 3) AS said, true AS resolved FROM (SELECT *, unnest(facts) AS f FROM told)",
    "report_grounding": f"{_ROWS} SELECT query_id, 0 AS n_ungrounded, sum(len(facts))::bigint AS n_facts, 0::bigint AS n_unresolved FROM told GROUP BY query_id",
    "report_caveats": f"{_ROWS} SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY o) - 1)::int AS place, caveat FROM cav",
    "audit_recorded": f"""{_ROWS}, ev AS (SELECT query_id, string_agg(doc_id, ',' ORDER BY rnk) AS ids, max(tier)::int AS tier_min, string_agg((tier = 1)::int || '/' || (tier = 3)::int, ',' ORDER BY rnk) AS tiers FROM sig GROUP BY query_id)
SELECT 'evt-' || substr(sha256(query || '|2026-01-01T00:00:00+00:00'), 1, 32) AS event_id, '2026-01-01T00:00:00+00:00' AS created_at, sha256(query) AS query_hash, ids AS retrieved_doc_ids, u AS unsupport_max, a AS anomaly_max, i AS injection_max, c AS conflict_max, d_conflict_max, tier AS tier_governing, tier_min, n_docs::int AS n_retrieved,
  round(n_eff, 6) AS n_eff, band, rule AS band_rule, case_id, matched AS all_matched_cases, tiers AS feature_tiers, case_action AS taxonomy_action, round(risk, 6) AS risk_score, round(risk_hi, 6) AS risk_p_upper, round(100 * (1 - round(risk, 6)), 6) AS trust_percent, round(100 * (1 - round(risk_hi, 6)), 6) AS trust_low, round(100 * (1 - round(risk_lo, 6)), 6) AS trust_high,
  score_action, confidence, confidence < 0.35 AS forced_review, action AS final_action, priority AS risk_priority, headline, subtype AS headline_subtype,
  CASE WHEN priority = 'P0' OR action = 'ESCALATE' THEN 'CRITICAL' WHEN priority IN ('P1', 'P2') OR action = 'REJECT' THEN 'HIGH' WHEN priority = 'P3' OR action = 'REVIEW' THEN 'MEDIUM' WHEN priority = 'P4' THEN 'LOW' ELSE 'INFORMATIONAL' END AS risk_tier, n_entities AS entities, (SELECT count(*) FROM line WHERE line.query_id = rep.query_id)::int AS n_reasons,
  'published' AS model_version, 'design-v1.2' AS taxonomy_version, 'patterns' AS injection_version, false AS backends_are_models, false AS is_verification_sample FROM rep JOIN ev USING (query_id)""",
    "report_documents": f"""{_ROWS} SELECT query_id, 'rpt-' || substr(sha256(query || '|2026-01-01T00:00:00+00:00'), 1, 16) AS report_id, headline, case_id, action, n_entities, n_docs::int AS n_docs, (SELECT count(*) FROM line WHERE line.query_id = rep.query_id)::int AS n_sentences, (SELECT count(*) FROM cav WHERE cav.query_id = rep.query_id)::int AS n_caveats,
  CASE greatest(CASE priority WHEN 'P0' THEN 4 WHEN 'P1' THEN 3 WHEN 'P2' THEN 3 WHEN 'P3' THEN 2 WHEN 'P4' THEN 1 ELSE 0 END, CASE action WHEN 'ACCEPT' THEN 0 WHEN 'REVIEW' THEN 2 WHEN 'REJECT' THEN 3 ELSE 4 END) WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 1 THEN 'LOW' ELSE 'INFORMATIONAL' END AS risk_tier FROM rep""",
}
