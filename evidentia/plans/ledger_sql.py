"""SQL for DuckDB that says again, on its own, what ``ledger`` computes."""

from __future__ import annotations

EVENTS = """ev AS (SELECT event_id, ts, CASE event_type WHEN 'view' THEN 'ACCEPT' WHEN 'purchase' THEN 'ACCEPT' WHEN 'click' THEN 'REVIEW' WHEN 'signup' THEN 'REJECT' ELSE 'ESCALATE' END AS action, 1 + user_id % 3 AS tier FROM events),
hd AS (SELECT *, CASE WHEN action IN ('REJECT', 'ESCALATE') THEN 'RED' WHEN action = 'ACCEPT' AND tier = 1 THEN 'GREEN' ELSE 'ORANGE' END AS headline FROM ev),
de AS (SELECT event_id AS decision_id, event_id // 7 * 7 AS event_id, CASE WHEN event_id % 5 = 0 THEN 'OVERRIDE' WHEN event_id % 2 = 0 THEN 'ACCEPT' ELSE 'REJECT' END AS decision,
  CASE WHEN event_id % 10 = 0 THEN 'INSUFFICIENT_EVIDENCE_TO_JUDGE' WHEN event_id % 5 = 0 THEN 'OTHER' END AS reason_code, CASE WHEN event_id % 21 = 15 THEN event_id - 1 END AS supersedes, CASE WHEN event_id % 13 = 0 THEN 'import' ELSE 'analyst_ui' END AS decision_source, ts,
  CASE WHEN event_id % 5 = 0 AND event_id % 3 > 0 THEN 'seen by ' || user_id END AS reason_text, CASE WHEN event_id % 5 = 0 THEN 'REVIEW' END AS override_action FROM events WHERE event_id % 7 IN (0, 1)),
cur AS (SELECT * FROM de WHERE decision_id NOT IN (SELECT supersedes FROM de WHERE supersedes IS NOT NULL))"""
# the chain's order: the morning's decisions were written first
ORDERED = "kept AS (SELECT *, ts::date AS chain, row_number() OVER (PARTITION BY ts::date ORDER BY hour(ts) >= 12, decision_id) AS nth FROM de)"

SQL = {
    "audit_list": f"WITH {EVENTS} SELECT h.event_id, headline, CASE tier WHEN 1 THEN 'TRUSTED_SOURCE_COMPROMISE' ELSE 'ATTACK_DETECTED' END AS subtype, (SELECT max(decision_id) FROM cur WHERE cur.event_id = h.event_id) AS decision_id, row_number() OVER (ORDER BY ts DESC, h.event_id DESC)::int AS place FROM hd h WHERE headline = 'RED' ORDER BY place LIMIT 50",
    "audit_current": f"WITH {EVENTS} SELECT decision_id, event_id AS about, decision FROM cur",
    "audit_pending": f"WITH {EVENTS} SELECT headline, count(*) AS n FROM hd LEFT JOIN (SELECT DISTINCT event_id FROM de) d USING (event_id) WHERE d.event_id IS NULL GROUP BY headline",
    "audit_labelled": f"WITH {EVENTS} SELECT decision_id, decision, reason_code, headline, CASE WHEN headline = 'RED' THEN CASE tier WHEN 1 THEN 'TRUSTED_SOURCE_COMPROMISE' ELSE 'ATTACK_DETECTED' END END AS subtype, action, tier, CASE decision WHEN 'REJECT' THEN 1 WHEN 'ACCEPT' THEN 0 END::int AS label FROM cur JOIN hd USING (event_id) WHERE decision_source = 'analyst_ui' AND reason_code IS DISTINCT FROM 'INSUFFICIENT_EVIDENCE_TO_JUDGE'",
    "audit_list_filtered": f"""WITH {EVENTS}, last AS (SELECT * FROM cur QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY decision_id DESC) = 1),
e AS (SELECT h.event_id, h.ts, headline, CASE WHEN headline = 'RED' THEN CASE tier WHEN 1 THEN 'TRUSTED_SOURCE_COMPROMISE' ELSE 'ATTACK_DETECTED' END END AS subtype, decision_id, decision, override_action, reason_code FROM hd h LEFT JOIN last ON last.event_id = h.event_id),
p AS (SELECT 'unreviewed attacks' AS page, * FROM e WHERE decision IS NULL AND subtype = 'ATTACK_DETECTED' UNION ALL SELECT 'rejected attacks', * FROM e WHERE decision = 'REJECT' AND subtype = 'ATTACK_DETECTED' UNION ALL SELECT 'overridden', * FROM e WHERE decision = 'OVERRIDE')
SELECT page, event_id, headline, subtype, decision_id, decision, override_action, reason_code FROM p QUALIFY row_number() OVER (PARTITION BY page ORDER BY ts DESC, event_id DESC) <= 100""",
    "decision_refusals": f"""WITH {EVENTS}, bad AS (SELECT decision_id, CASE WHEN decision_id % 44 = 0 THEN 'MAYBE' ELSE decision END AS decision, CASE WHEN decision_id % 44 = 33 THEN NULL WHEN decision_id % 44 = 22 THEN 'IGNORE' ELSE override_action END AS action,
  CASE WHEN decision_id % 44 = 11 THEN -1 ELSE event_id END AS event_id, reason_code, reason_text FROM de)
SELECT decision_id, 'unknown decision' AS reason FROM bad WHERE decision = 'MAYBE' UNION ALL SELECT decision_id, 'override without action and reason' FROM bad WHERE decision = 'OVERRIDE' AND (action IS NULL OR reason_code IS NULL)
UNION ALL SELECT decision_id, 'unknown override action' FROM bad WHERE decision = 'OVERRIDE' AND action = 'IGNORE' UNION ALL SELECT decision_id, 'reason OTHER without text' FROM bad WHERE decision = 'OVERRIDE' AND reason_code = 'OTHER' AND reason_text IS NULL
UNION ALL SELECT decision_id, 'no such event' FROM bad WHERE event_id NOT IN (SELECT event_id FROM events)""",
    # which rows were tampered with is known, so no hash is needed to say what must be found
    "audit_chain_verify": f"WITH {EVENTS}, {ORDERED}, t AS (SELECT chain, decision_id, decision_id % 1001 = 0 AS edited, coalesce(lag(decision_id % 2002 = 1) OVER (PARTITION BY chain ORDER BY nth), false) AS unlinked, decision_id % 2002 = 1 AS gone FROM kept) SELECT chain, decision_id, edited, unlinked FROM t WHERE NOT gone AND (edited OR unlinked)",
    "ledger_append": f"""WITH RECURSIVE {EVENTS}, {ORDERED}, said AS (SELECT chain, nth, decision_id, '{{"decision_id":"' || decision_id || '","event_id":"' || event_id || '","decision":"' || decision || '","override_action":' || coalesce('"' || override_action || '"', 'null') || ',"reason_code":' || coalesce('"' || reason_code || '"', 'null') || ',"reason_text":' || coalesce('"' || reason_text || '"', 'null') || ',"decided_at":"' || CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE rtrim(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '0') END || '","supersedes":' || coalesce('"' || supersedes || '"', 'null') || ',"decision_source":"' || decision_source || '"}}' AS text FROM kept),
walk AS (SELECT chain, nth, sha256(repeat('0', 64) || text) AS h FROM said WHERE nth = 1 UNION ALL SELECT s.chain, s.nth, sha256(w.h || s.text) FROM walk w JOIN said s ON s.chain = w.chain AND s.nth = w.nth + 1)
SELECT chain, count(*) AS n, 0::bigint AS edited, 0::bigint AS unlinked, arg_max(h, nth) AS head FROM walk GROUP BY chain""",
}
