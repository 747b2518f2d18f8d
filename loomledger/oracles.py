"""DuckDB SQL for the registered queries."""

from loomledger.queries import SAME_SQL

#: The events table as a ledger, fields of the payload beside it.
_LEDGER = """n AS (SELECT *, regexp_extract(props, '(\\d+)', 1)::BIGINT AS k FROM events),
    l AS (SELECT event_id + 1 AS seq, 'e' || event_id AS id, 'u' || user_id AS actor, 'd' || (user_id % 8) AS device_id, (epoch_ns(ts) // 1000000)::BIGINT AS ts_device,
        CASE event_type WHEN 'purchase' THEN 'entry' WHEN 'signup' THEN 'tally.add' WHEN 'click' THEN 'tally.remove' WHEN 'error' THEN 'undo.compensate'
            WHEN 'view' THEN ['entry.resolved', 'entry.failed', 'entry.expired', 'tombstone.hide', 'tombstone.show'][k % 5 + 1] ELSE event_type END AS type,
        CASE WHEN event_type = 'purchase' THEN greatest(floor(value * 100 + 0.5), 1)::BIGINT END AS value,
        CASE WHEN event_type IN ('signup', 'click') THEN 'i' || (k % 20) END AS item,
        CASE event_type WHEN 'signup' THEN k + 1 WHEN 'click' THEN (k % 10 + 1) * 9 END AS qty,
        CASE WHEN event_type = 'error' THEN 'e' || (event_id + k % 30 - 18) WHEN event_type = 'view' AND k % 5 < 3 THEN 'e' || (event_id - event_id % 8 + k % 8)
            WHEN event_type = 'view' THEN 'e' || (event_id - event_id % 40 + k % 4) END AS target
        FROM n),
    ev AS (SELECT *, CASE WHEN type = 'entry' THEN '{"value":' || value || '}' WHEN item IS NOT NULL THEN '{"item":"' || item || '","qty":' || qty || '}'
        WHEN type = 'undo.compensate' THEN '{"reverses":"' || target || '"}' WHEN type = 'tombstone.hide' THEN '{"hides":"' || target || '"}' WHEN type = 'tombstone.show' THEN '{"shows":"' || target || '"}'
        WHEN target IS NOT NULL THEN '{"event_id":"' || target || '"}' ELSE '{}' END AS payload FROM l)"""
#: The fold: undos and first transitions per target, then the tally step by step.
_FOLD = (
    _LEDGER
    + """,
    u AS (SELECT target, min(seq) AS first_undo FROM ev WHERE type = 'undo.compensate' GROUP BY target),
    st AS (SELECT target, min(seq) AS first_step, CASE arg_min(type, seq) WHEN 'entry.resolved' THEN 'RESOLVED_ONLINE' WHEN 'entry.failed' THEN 'FAILED' ELSE 'EXPIRED' END AS reached
        FROM ev WHERE type IN ('entry.resolved', 'entry.failed', 'entry.expired') GROUP BY target),
    entries AS (SELECT seq, id AS event_id, value, actor, coalesce(reached, 'RECORDED') AS state, (first_undo IS NOT NULL)::INT AS voided, first_step
        FROM ev LEFT JOIN u ON u.target = id LEFT JOIN st ON st.target = id WHERE type = 'entry'),
    m AS (SELECT seq, id, item, CASE WHEN type = 'tally.add' THEN qty ELSE -qty END AS qty, first_undo FROM ev LEFT JOIN u ON u.target = id WHERE item IS NOT NULL),
    steps AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY pos, kind) AS r FROM
        (SELECT *, seq AS pos, 0 AS kind FROM m UNION ALL SELECT *, greatest(seq, first_undo) AS pos, 1 AS kind FROM m WHERE first_undo IS NOT NULL)),
    run AS (SELECT item, 0::BIGINT AS r, 0::BIGINT AS had, 0::BIGINT AS bal, NULL::VARCHAR AS id, 0 AS kind, FALSE AS under, []::VARCHAR[] AS short FROM (SELECT DISTINCT item FROM m)
        UNION ALL SELECT s.item, s.r, run.bal, CASE WHEN s.kind = 0 THEN CASE WHEN s.qty < 0 AND -s.qty > run.bal THEN run.bal ELSE run.bal + s.qty END
            ELSE CASE WHEN list_contains(run.short, s.id) THEN run.bal ELSE run.bal - s.qty END END,
            s.id, s.kind, s.kind = 0 AND s.qty < 0 AND -s.qty > run.bal,
            CASE WHEN s.kind = 0 AND s.qty < 0 AND -s.qty > run.bal AND s.first_undo IS NOT NULL THEN list_append(run.short, s.id) ELSE run.short END
        FROM run JOIN steps s ON s.item = run.item AND s.r = run.r + 1),
    mv AS (SELECT m.*, run.under, run.had, (run.under OR m.first_undo IS NOT NULL)::INT AS voided FROM m JOIN run ON run.id = m.id AND run.kind = 0)"""
)
_BY_ITEM, _ONE_ITEM = "THEN 'i' || (k % 20) END AS item", "THEN 'x' END AS item"
_REVOKES = """r AS (SELECT 'r' || event_id AS hash, CASE WHEN event_id % 8 < 4 THEN 'REVOKE-GENESIS' ELSE 'r' || (event_id - 3) END AS prev,
    CASE WHEN event_id % 7 = 0 THEN '*' ELSE 't' || (user_id % 50) END AS token_id, 'd' || (user_id % 8) AS device_id, event_id % 5 AS epoch FROM events WHERE event_type = 'error')"""
_CHAIN = (
    _LEDGER
    + """,
    o AS (SELECT *, row_number() OVER (PARTITION BY actor ORDER BY seq) AS place FROM ev),
    ch AS (SELECT actor, 0::BIGINT AS place, NULL::VARCHAR AS id, ''::VARCHAR AS prev_hash, 'GENESIS' AS hash FROM (SELECT DISTINCT actor FROM ev)
        UNION ALL SELECT o.actor, o.place, o.id, ch.hash, sha256('{"id":"' || o.id || '","seq":' || o.place || ',"type":"' || o.type || '","actor":"' || o.actor || '","device_id":"' || o.device_id
            || '","ts_device":' || o.ts_device || ',"payload":' || o.payload || ',"prev_hash":"' || ch.hash || '"}') FROM ch JOIN o ON o.actor = ch.actor AND o.place = ch.place + 1)"""
)
_TALLY = "SELECT item, sum(CASE WHEN voided = 0 THEN qty ELSE 0 END)::DOUBLE AS qty FROM mv WHERE NOT under GROUP BY item"
_CONFLICTS = """cf AS (SELECT CASE WHEN e.seq IS NULL OR t.seq < e.seq THEN 'cf-' || t.id || '-unknown-entry' ELSE 'cf-' || t.target || '-' || t.id || '-double-resolve' END AS id,
        CASE WHEN e.seq IS NOT NULL AND t.seq <> e.first_step THEN 'double-resolve' ELSE 'unknown-entry' END AS kind,
        CASE WHEN e.seq IS NOT NULL AND t.seq <> e.first_step THEN t.type || ' on already-terminal entry ' || t.target || ' (' || e.state || ')' ELSE 'transition ' || t.type || ' references unknown entry ' || t.target END AS detail,
        CASE WHEN e.seq IS NOT NULL AND t.seq <> e.first_step THEN '["' || t.target || '","' || t.id || '"]' ELSE '["' || t.id || '"]' END AS event_ids,
        CASE WHEN e.seq IS NOT NULL AND t.seq < e.seq AND t.seq = e.first_step THEN 'resolved' ELSE 'open' END AS status
        FROM ev t LEFT JOIN entries e ON e.event_id = t.target WHERE t.type IN ('entry.resolved', 'entry.failed', 'entry.expired') AND (e.seq IS NULL OR t.seq < e.seq OR t.seq <> e.first_step)
        UNION ALL SELECT 'cf-' || id || '-underflow', 'underflow', 'remove ' || (-qty) || '×' || item || ' with ' || had || ' on hand (event ' || id || ')', '["' || id || '"]', 'open' FROM mv WHERE under)"""
_RECORDS = """rec AS (SELECT seq, id AS event_id, type, payload AS body FROM ev WHERE type IN ('tombstone.hide', 'tombstone.show')
        UNION ALL SELECT ev.seq, ev.id, ev.type, ev.payload FROM ev LEFT JOIN entries e ON e.event_id = ev.target LEFT JOIN mv ON mv.id = ev.target
        WHERE ev.type = 'undo.compensate' AND ((e.seq IS NULL AND mv.seq IS NULL) OR ev.seq < coalesce(e.seq, mv.seq) OR coalesce(mv.under, FALSE) OR coalesce(mv.first_undo < ev.seq, FALSE)))"""
_PAIRS = "p AS (SELECT least(o.seq, t.seq) AS lo, greatest(o.seq, t.seq) - 1 AS hi FROM ev o JOIN ev t ON t.id = o.target WHERE o.type IN ('tombstone.hide', 'tombstone.show') AND o.seq <> t.seq)"


def oracle_sql() -> dict[str, str]:
    with_ledger, with_fold = f"WITH {_LEDGER} ", f"WITH RECURSIVE {_FOLD} "
    bad = "CASE WHEN seq % 11 = 0 AND type IN ('entry', 'tally.add', 'tally.remove') THEN TRUE ELSE FALSE END"
    return SAME_SQL | {
        "entries": with_fold + "SELECT seq, event_id, value, actor, state, voided FROM entries",
        "tally": with_fold + _TALLY,
        "tally_moves": with_fold + "SELECT seq, id AS event_id, item, qty::DOUBLE AS qty, voided FROM mv",
        "conflicts": f"WITH RECURSIVE {_FOLD}, {_CONFLICTS} SELECT * FROM cf",
        "open_conflicts": f"WITH RECURSIVE {_FOLD}, {_CONFLICTS} SELECT kind, count(*) AS n FROM cf WHERE status = 'open' GROUP BY kind",
        "records": f"WITH RECURSIVE {_FOLD}, {_RECORDS} SELECT * FROM rec",
        "tally_rebuild": with_fold + "SELECT item, sum(qty)::DOUBLE AS qty FROM mv WHERE voided = 0 GROUP BY item",
        "actor_balance": with_fold + "SELECT actor, sum(value)::BIGINT AS balance FROM entries WHERE voided = 0 GROUP BY actor",
        "live_total": with_fold + "SELECT count(*) AS n, sum(value)::BIGINT AS total FROM entries WHERE voided = 0",
        "voided_ids": with_fold + "SELECT event_id FROM entries WHERE voided = 1 UNION ALL SELECT id FROM mv WHERE voided = 1",
        "distinct_states": with_fold + "SELECT DISTINCT state FROM entries",
        "negative_moves": with_fold + "SELECT item, count(*) AS n FROM mv WHERE qty < 0 AND voided = 0 GROUP BY item",
        "event_entries": with_ledger + "SELECT seq, id, value FROM ev WHERE type IN ('entry', 'undo.compensate')",
        "event_point": with_ledger + "SELECT seq, id, type, actor, payload FROM ev WHERE id = 'e77'",
        "max_seq": with_ledger + "SELECT coalesce(max(seq), 0) AS max_seq FROM ev",
        "value_percentiles": with_ledger + "SELECT quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.99) AS p99 FROM ev WHERE type = 'entry'",
        "type_counts": with_ledger
        + "SELECT count(*) AS n, count(*) FILTER (type = 'entry') AS entry, count(*) FILTER (type = 'tally.add') AS tally_add, count(*) FILTER (type = 'tally.remove') AS tally_remove, count(*) FILTER (type = 'undo.compensate') AS undo_compensate FROM ev",
        "validation": """WITH v AS (SELECT *, (l_orderkey + l_linenumber) % 6 AS k FROM lineitem),
            w AS (SELECT CASE WHEN k = 0 THEN 12 WHEN k = 3 THEN 1 WHEN k = 5 AND l_partkey > 0 THEN l_partkey END AS value, l_linenumber = 7 AS odd FROM v)
            SELECT CASE WHEN value IS NULL THEN 'entry rejected: value must be a positive integer' WHEN odd THEN 'entry rejected: state cannot be recorded offline' ELSE 'fit' END AS verdict,
                count(*) AS n, sum(CASE WHEN NOT odd THEN value END)::BIGINT AS total FROM w GROUP BY 1""",
        "tally_one_item": f"WITH RECURSIVE {_FOLD.replace(_BY_ITEM, _ONE_ITEM)} SELECT seq, id AS event_id, item, qty::DOUBLE AS qty, under AS underflow, had::DOUBLE AS on_hand, voided FROM mv",
        "relay_pages": f"""WITH RECURSIVE {_LEDGER}, f AS (SELECT device_id AS relay, seq AS pos, id, octet_length(encode(CASE WHEN id = 'e507' THEN repeat('x', 5000) ELSE id || payload END)) AS b, row_number() OVER (PARTITION BY device_id ORDER BY seq) AS p FROM ev),
            g AS (SELECT relay, p, 1::BIGINT AS page, 1 AS n, b AS total, b > 900 AS stuck, b > 900 AS too_large FROM f WHERE p = 1
                UNION ALL SELECT f.relay, f.p, CASE WHEN n < 40 AND total + b <= 900 THEN page ELSE page + 1 END, CASE WHEN n < 40 AND total + b <= 900 THEN n + 1 ELSE 1 END, CASE WHEN n < 40 AND total + b <= 900 THEN total + b ELSE b END,
                    g.stuck OR b > 900, NOT g.stuck AND b > 900 FROM g JOIN f ON f.relay = g.relay AND f.p = g.p + 1)
            SELECT relay, pos, id, CASE WHEN NOT stuck THEN page END AS page, too_large FROM g JOIN f USING (relay, p)""",
        "push_chunks": with_ledger
        + """, p AS (SELECT *, row_number() OVER w AS place, seq % 61 = 0 AND device_id IN ('d0', 'd1', 'd2', 'd3') AS lost FROM ev WHERE seq > CASE WHEN device_id IN ('d3', 'd4') THEN 200 ELSE 0 END WINDOW w AS (PARTITION BY device_id ORDER BY seq)),
            s AS (SELECT *, min(CASE WHEN lost THEN place END) OVER (PARTITION BY device_id) AS stop, (place - 1) // 10 AS chunk FROM p)
            SELECT device_id, seq, id, chunk, coalesce(chunk <= (stop - 1) // 10, true) AS sent, CASE WHEN coalesce(chunk <= (stop - 1) // 10, true) AND NOT lost THEN seq + 1700000000000 END AS server_time,
                CASE WHEN chunk > (stop - 1) // 10 THEN 'unsent' WHEN place >= stop THEN 'held' WHEN seq % 50 = 3 THEN 'dead' ELSE 'acked' END AS outcome FROM s""",
        "push_totals": with_ledger
        + """, p AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY seq) AS place, seq % 97 = 0 AS lost FROM ev WHERE seq > 30),
            s AS (SELECT *, coalesce(min(CASE WHEN lost THEN place END) OVER (PARTITION BY device_id), 1000000000000) AS stop FROM p),
            t AS (SELECT device_id, count(*) FILTER ((place - 1) // 10 <= (stop - 1) // 10) AS pushed, count(*) FILTER (place < stop AND seq % 50 <> 3) AS acked, count(*) FILTER (place < stop AND seq % 50 = 3) AS dead, max(seq) FILTER (place < stop) AS t FROM s GROUP BY device_id)
            SELECT device_id, coalesce(pushed, 0) AS pushed, coalesce(acked, 0) AS acked, coalesce(dead, 0) AS dead, coalesce(t, 30) AS since FROM (SELECT DISTINCT device_id FROM ev) LEFT JOIN t USING (device_id)""",
        "delta_chunks": with_ledger
        + """, m AS (SELECT device_id, id, seq, seq AS place FROM ev UNION ALL SELECT device_id, id, seq, seq + 1000000000 FROM ev WHERE seq % 40 = 1),
            o1 AS (SELECT *, CASE WHEN seq % 31 = 0 THEN 'hold' WHEN seq % 23 = 0 THEN 'poison' WHEN seq % 101 = 0 THEN 'hold' WHEN place <> seq THEN 'duplicate' ELSE 'applied' END AS word FROM m WHERE seq % 3 <> 0),
            h1 AS (SELECT *, coalesce(sum((word = 'hold')::INT) OVER (PARTITION BY device_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o1),
            r1 AS (SELECT *, CASE WHEN before >= 10 THEN 'left' ELSE word END AS outcome FROM h1),
            k AS (SELECT device_id, id FROM r1 WHERE outcome IN ('applied', 'poison')),
            w2 AS (SELECT device_id, id, seq, place, outcome = 'left' AS was_left FROM r1 WHERE outcome IN ('hold', 'left') AND NOT EXISTS (SELECT 1 FROM k WHERE k.device_id = r1.device_id AND k.id = r1.id)),
            o2 AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY was_left, place) AS q, row_number() OVER (PARTITION BY device_id, id ORDER BY was_left, place) AS nth FROM w2),
            o3 AS (SELECT *, CASE WHEN seq % 31 = 0 THEN 'hold' WHEN seq % 23 = 0 THEN 'poison' WHEN nth > 1 THEN 'duplicate' ELSE 'applied' END AS word FROM o2),
            h2 AS (SELECT *, coalesce(sum((word = 'hold')::INT) OVER (PARTITION BY device_id ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o3)
            SELECT 1 AS run, device_id, id, outcome FROM r1 UNION ALL SELECT 2, device_id, id, CASE WHEN before >= 10 THEN 'left' ELSE word END FROM h2""",
        "append_scan": f"""WITH RECURSIVE {_LEDGER}, o AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY seq % 3 = 0, seq) AS place FROM ev),
            ch AS (SELECT device_id, 0::BIGINT AS place, NULL::VARCHAR AS id, NULL::VARCHAR AS payload, ''::VARCHAR AS prev_hash, 'GENESIS' AS hash FROM (SELECT DISTINCT device_id FROM ev)
                UNION ALL SELECT o.device_id, o.place, o.id, o.payload, ch.hash, sha256('{{"id":"' || o.id || '","seq":' || o.place || ',"type":"' || o.type || '","actor":"' || o.actor || '","device_id":"' || o.device_id
                    || '","ts_device":' || o.ts_device || ',"payload":' || o.payload || ',"prev_hash":"' || ch.hash || '"}}') FROM ch JOIN o ON o.device_id = ch.device_id AND o.place = ch.place + 1)
            SELECT device_id AS log, place - 1 AS pos, place AS seq, id, payload, prev_hash, hash, NULL::VARCHAR AS fault FROM ch WHERE place > 0""",
        "scan_recovery": f"""WITH {_LEDGER}, k AS (SELECT *, seq % 50 AS m, seq = max(seq) OVER (PARTITION BY device_id) AS is_last FROM ev),
            x AS (SELECT *, CASE WHEN is_last THEN 'torn' WHEN m = 7 THEN 'bad' ELSE 'event' END AS state FROM k WHERE is_last OR m <> 9),
            y AS (SELECT *, state = 'event' AND coalesce(lag(state) OVER (PARTITION BY device_id ORDER BY seq) = 'bad', false) AS gap FROM x)
            SELECT 'event' AS what, seq, id, CASE WHEN m <> 15 THEN type END AS type, gap, CASE m WHEN 15 THEN 'event without type' WHEN 11 THEN 'payload must be an object' END AS said FROM y WHERE state = 'event'
            UNION ALL SELECT 'quarantined', NULL, NULL, NULL, false, '{{"id":"' || id || '",' || CASE state WHEN 'torn' THEN ' /* torn tail, truncated on open */' ELSE '' END FROM y WHERE state <> 'event'""",
        "chain_append": f"WITH RECURSIVE {_CHAIN} SELECT actor, place AS seq, id, prev_hash, hash FROM ch WHERE place > 0",
        "chain_verify": f"""WITH {_LEDGER}, c AS (SELECT actor, substr(actor, 2)::BIGINT % 5 AS k, count(*) AS n FROM ev GROUP BY actor)
            SELECT actor, NOT ((k = 1 AND n > 3) OR (k = 2 AND n >= 2)) AS ok, CASE WHEN k = 1 AND n > 3 THEN 4 WHEN k = 2 AND n >= 2 THEN 2 END::BIGINT AS at,
                CASE WHEN k = 1 AND n > 3 THEN 'seq gap (truncated/edited log?)' WHEN k = 2 AND n >= 2 THEN 'hash mismatch (tampered payload?)' END AS reason FROM c""",
        "truncate_verify": f"""WITH RECURSIVE {_CHAIN}, nn AS (SELECT actor, max(place) // 2 AS s, max(place) AS n FROM ch WHERE place > 0 GROUP BY actor)
            SELECT nn.actor, NOT (substr(nn.actor, 2)::BIGINT % 5 = 2 AND s > 0) AS ok, CASE WHEN substr(nn.actor, 2)::BIGINT % 5 = 2 AND s > 0 THEN s + 1 END AS at,
                CASE WHEN substr(nn.actor, 2)::BIGINT % 5 = 2 AND s > 0 THEN 'hash mismatch (tampered payload?)' END AS reason, CASE WHEN s > 0 THEN s + 1 END AS truncated_before, ch.hash AS tip, CASE WHEN s > 0 THEN s END AS removed
            FROM nn LEFT JOIN ch ON ch.actor = nn.actor AND ch.place = nn.s AND s > 0""",
        "gate_reasons": f"""WITH RECURSIVE {_CHAIN} SELECT ch.id, CASE WHEN ev.seq % 50 = 0 THEN 'swept id reused: ' || ch.id || ' was excised and must not be re-appended'
            ELSE 'tamper rejected: hash mismatch for event ' || ch.id || ' (seq ' || place || ')' END AS poison_reason FROM ch JOIN ev ON ev.id = ch.id WHERE place > 0 AND (ev.seq % 50 = 0 OR place % 31 = 0)""",
        "quarantine_corrupt": with_ledger + "SELECT id AS event_id, CASE WHEN seq % 970 = 0 THEN 'before' ELSE 'corrupt-payload seq=' || seq END AS reason, CASE WHEN seq % 970 = 0 THEN 1 ELSE 5 END::BIGINT AS ts FROM ev WHERE seq % 97 IN (0, 1)",
        "purge_runs": with_ledger
        + """, m AS (SELECT max(seq) AS top, max(seq) // 2 AS half FROM ev) SELECT 0 AS run, count(*) FILTER (seq <= half) AS scanned, count(*) FILTER (seq <= half AND device_id = 'd5') AS quarantined FROM ev, m
            UNION ALL SELECT 1, 0, 0 UNION ALL SELECT 2, count(*) FILTER (seq > half), count(*) FILTER (seq > half AND device_id = 'd5') FROM ev, m UNION ALL SELECT 3, count(*), count(*) FILTER (device_id = 'd1') FROM ev""",
        "guard_pairs": f"""WITH RECURSIVE {_LEDGER}, pr AS (SELECT t.seq AS t, o.seq AS o FROM ev o JOIN ev t ON t.id = o.target WHERE o.type IN ('tombstone.hide', 'tombstone.show')),
            it AS (SELECT max(seq) // 2 AS e, NULL::BIGINT AS t, NULL::BIGINT AS o FROM ev UNION ALL SELECT greatest(0, least(arg_min(pr.t, pr.o), min(pr.o)) - 1), arg_min(pr.t, pr.o), min(pr.o) FROM it JOIN pr ON (pr.t <= e) <> (pr.o <= e) GROUP BY e)
            SELECT t AS target_seq, o AS op_seq, (SELECT min(e) FROM it) AS effective FROM it WHERE t IS NOT NULL OR (SELECT count(*) FROM it) = 1""",
        "hide_plans": with_ledger
        + """, ops AS (SELECT seq, id, type, target FROM ev WHERE type IN ('tombstone.hide', 'tombstone.show')), hid AS (SELECT target FROM ops GROUP BY target HAVING arg_max(type, seq) = 'tombstone.hide'),
            first AS (SELECT target, arg_min(id, seq) AS f FROM ops WHERE type = 'tombstone.hide' GROUP BY target), q AS (SELECT 'e' || (c_custkey * 10) AS id, CASE WHEN c_custkey % 3 = 0 THEN 'show' ELSE 'hide' END AS op FROM customer),
            x AS (SELECT q.id, op, ev.id IS NOT NULL AS stored, hid.target IS NOT NULL AS hidden, f FROM q LEFT JOIN ev ON ev.id = q.id LEFT JOIN hid ON hid.target = q.id LEFT JOIN first ON first.target = q.id),
            y AS (SELECT *, CASE WHEN op = 'hide' AND NOT stored THEN 'ERR_UNKNOWN_TARGET: tombstone.hide needs a stored event id (got ' || id || ')' WHEN op = 'show' AND NOT hidden THEN 'ERR_NOT_HIDDEN: tombstone.show needs a hidden event id (got ' || id || ')' END AS error FROM x),
            z AS (SELECT *, CASE WHEN error IS NULL AND op = 'hide' AND hidden THEN f END AS existing FROM y)
            SELECT id, op, error, existing, CASE WHEN error IS NULL AND existing IS NULL THEN 'tombstone.' || op END AS type, CASE WHEN error IS NULL AND existing IS NULL THEN '{"' || op || CASE op WHEN 'hide' THEN 's' ELSE 's' END || '":"' || id || '"}' END AS payload FROM z""",
        "blob_store": """WITH d AS (SELECT doc_id, coalesce(text, '') AS c, sha256(coalesce(text, '')) AS key FROM documents)
            SELECT key, max(octet_length(encode(c)))::BIGINT AS size, (count(*) + count(*) FILTER (doc_id % 4 = 0) - count(*) FILTER (doc_id % 4 = 1)) AS refcount FROM d GROUP BY key HAVING refcount > 0""",
        "revoke_since": f"WITH {_REVOKES} SELECT hash, substr(hash, 2)::BIGINT AS pos FROM r WHERE pos >= 100",
        "health": with_ledger + "SELECT count(*) AS events, 0 AS skipped, 0 AS quarantined, FALSE AS repaired_tail, 0 AS n_gaps FROM ev",
        "undo_targets": with_ledger + "SELECT u.id AS undo_id, u.seq AS undo_seq, u.target, t.type AS target_type, t.seq AS target_seq, u.seq < t.seq AS ahead FROM ev u LEFT JOIN ev t ON t.id = u.target WHERE u.type = 'undo.compensate'",
        "want_list": with_ledger + "SELECT seq AS pos, id FROM ev WHERE seq % 3 = 0",
        "want_merged": with_ledger + "SELECT CASE WHEN seq % 5 = 0 THEN 0 ELSE 1 END AS later, seq AS pos, id FROM ev WHERE seq % 3 = 0",
        "manifest": with_ledger + "SELECT count(*) AS count, sha256(arg_max(id, seq)) AS tip, max(seq) AS seq FROM ev",
        "push_ack": with_ledger + "SELECT coalesce(max(seq), 50) AS advanced, count(*) AS acked FROM ev WHERE seq > 50 AND seq < (SELECT coalesce(min(seq), 1000000000) FROM ev WHERE seq > 700 AND seq % 2 <> 0)",
        "pull_dispositions": f"""WITH {_LEDGER}, r AS (SELECT seq, device_id, {bad} AS bad, 1 AS k FROM ev UNION ALL SELECT seq, device_id, {bad}, 2 FROM ev WHERE seq % 10 = 0)
            SELECT CASE WHEN seq % 4 = 0 AND device_id = 'd3' THEN 'purge' WHEN seq % 4 = 0 THEN 'stored' WHEN seq % 4 = 1 AND device_id = 'd3' THEN 'quarantine_parked' WHEN seq % 4 = 1 THEN 'redrive'
                WHEN bad THEN 'skip_shape' WHEN device_id = 'd3' THEN 'quarantine' WHEN k = 2 THEN 'duplicate' ELSE 'applied' END AS disposition, count(*) AS n, sum(seq)::BIGINT AS seqs FROM r GROUP BY 1""",
        "delta_outcomes": f"""WITH {_LEDGER} SELECT CASE WHEN seq % 13 = 0 THEN 'dead' WHEN seq % 7 = 0 THEN 'retry' WHEN {bad} THEN 'poison' ELSE 'applied' END AS outcome, count(*) AS n FROM ev WHERE seq % 3 = 0 GROUP BY 1""",
        "quarantine_device": with_fold + "SELECT mv.item, sum(mv.qty)::DOUBLE AS qty FROM mv JOIN ev ON ev.id = mv.id WHERE voided = 0 AND device_id <> 'd2' GROUP BY mv.item",
        "purge_revoked": with_ledger + "SELECT id FROM ev WHERE seq > 100 AND (seq % 2 = 0 OR device_id = 'd5') AND seq % 9 <> 0",
        "excise": with_fold + "SELECT item, sum(qty)::DOUBLE AS qty FROM mv WHERE voided = 0 AND NOT (seq >= 40 AND seq % 6 = 0) GROUP BY item",
        "first_unapplied": with_ledger + "SELECT min(seq) AS seq FROM ev WHERE seq % 500 = 123",
        "duplicate_ids": "SELECT 'c' || o_custkey AS id, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1",
        "relay_store": "SELECT 'u' || user_id AS id, min(event_id) AS pos, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id",
        "relay_page": with_ledger
        + "SELECT * FROM (SELECT pos, id, json, sum(octet_length(encode(json))) OVER (ORDER BY pos)::BIGINT AS bytes_so_far FROM (SELECT seq AS pos, id, id || type || payload AS json FROM ev WHERE seq > 100 ORDER BY seq LIMIT 500)) WHERE bytes_so_far <= 6000",
        "push_budget": with_ledger + "SELECT count(*) AS events, count(*) FILTER (octet_length(encode(payload)) > 16) AS too_large, count(*) > 500 OR count(*) FILTER (octet_length(encode(payload)) > 16) > 0 AS refused FROM ev",
        "device_registry": with_ledger + "SELECT CASE WHEN device_id IN ('d0', 'd2', 'd4') THEN 'accept' WHEN device_id IN ('d1', 'd3', 'd5') THEN 'reject' ELSE 'unknown' END AS verdict, count(*) AS n FROM ev GROUP BY 1",
        "failover_pull": "SELECT 'e' || event_id AS id, min(relay) AS relay, event_id + 1 AS pos FROM events, (SELECT unnest([0, 1, 2]) AS relay) WHERE (event_id + 1 + relay) % 4 <> 0 AND event_id + 1 > CASE relay WHEN 0 THEN 300 WHEN 1 THEN 50 ELSE 0 END GROUP BY event_id",
        "failover_cursors": "SELECT relay, CASE relay WHEN 1 THEN 1099511627776 ELSE greatest(max(event_id + 1), CASE relay WHEN 0 THEN 300 ELSE 0 END) END AS since FROM events, (SELECT unnest([0, 1, 2]) AS relay) WHERE (event_id + 1 + relay) % 4 <> 0 GROUP BY relay",
        "failover_backfill": "SELECT event_id + 1 AS seq, 'e' || event_id AS id FROM events WHERE event_id + 1 <= (SELECT (max(event_id) + 1) // 2 FROM events) AND (event_id + 2) % 4 = 0",
        "replay_dispositions": """SELECT event_id AS seq, 'e' || (event_id - event_id % 3) AS id, CASE WHEN event_type = 'error' THEN 'poison' WHEN row_number() OVER (PARTITION BY event_type = 'error', event_id - event_id % 3 ORDER BY event_id) = 1 THEN 'applied' ELSE 'duplicate' END AS disposition FROM events""",
        "authorize_tokens": """WITH a AS (SELECT event_id, user_id % 8 AS d, CASE WHEN event_id % 2 = 0 THEN 'relay:push' ELSE 'relay:pull' END AS scope FROM events)
            SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'missing capability token' WHEN d = 0 THEN 'device revoked: d0' WHEN d = 2 THEN 'token revoked: t2' WHEN d = 1 THEN 'unknown device: d1'
                WHEN (d = 3 AND event_id > 500) OR (d = 4 AND event_id % 2 = 1) OR d = 5 OR (d = 6 AND event_id < 1000) THEN 'capability rejected for ' || scope END AS refused FROM a""",
        "authorize_grants": """WITH a AS (SELECT event_id, user_id % 5 AS g, CASE WHEN event_id % 2 = 0 THEN 'entries:append' ELSE 'entries:resolve' END AS scope FROM events)
            SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'missing scope grant'
                WHEN g IN (0, 3) OR (g = 1 AND event_id NOT BETWEEN 100 AND 600) OR (g = 2 AND event_id % 2 = 1) THEN 'grant rejected for ' || scope END AS refused FROM a""",
        "event_gate": """SELECT 's' || s_suppkey AS id, s_suppkey % 4 < 3 AND s_suppkey % 7 <> 0 AND s_suppkey % 13 > 1 AND s_suppkey % 11 <> 0 AND (s_suppkey % 3 <> 0 OR s_suppkey % 5 = 2) AS authentic FROM supplier""",
        "countersignatures": """WITH v AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 7 = 0 OR s_suppkey % 5 = 0 THEN 0 WHEN s_suppkey % 5 = 2 THEN 2 ELSE 1 END AS valid FROM supplier)
            SELECT 's' || k AS id, valid::BIGINT AS valid, valid >= 2 AS met FROM v""",
        "tombstones": with_ledger + "SELECT seq, id AS event_id, split_part(type, '.', 2) AS op, target FROM ev WHERE type IN ('tombstone.hide', 'tombstone.show')",
        "hidden_ids": with_ledger + "SELECT target FROM ev WHERE type IN ('tombstone.hide', 'tombstone.show') GROUP BY target HAVING arg_max(type, seq) = 'tombstone.hide'",
        "tombstone_targets": f"WITH {_LEDGER}, {_PAIRS} SELECT lo, hi FROM p",
        "seal_islands": f"""WITH {_LEDGER}, {_PAIRS}, w AS (SELECT lo, hi, max(hi) OVER (ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM p),
            g AS (SELECT lo, hi, sum(CASE WHEN e IS NULL OR lo > e + 1 THEN 1 ELSE 0 END) OVER (ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM w) SELECT min(lo) AS lo, max(hi) AS hi FROM g GROUP BY g""",
        "held_events": with_ledger + "SELECT 'e' || (c_custkey * 7) AS id, c_mktsegment AS reason, ev.seq FROM customer LEFT JOIN ev ON ev.id = 'e' || (c_custkey * 7)",
        "sweep": with_ledger + "SELECT count(*) FILTER (seq > 300) AS kept, min(seq) FILTER (seq > 300) AS first, sha256(arg_max(id, seq) FILTER (seq <= 300)) AS tip, 301::BIGINT AS truncated_before, 301::BIGINT AS next_seq FROM ev",
        "revoke_verify": """SELECT s_suppkey::BIGINT AS s_suppkey, CASE WHEN s_suppkey % 17 = 0 THEN 'unsupported v 2' WHEN s_suppkey % 19 = 0 THEN 'empty tokenId' WHEN s_suppkey % 23 = 0 THEN 'bad epoch -1'
            WHEN s_suppkey % 13 = 0 THEN 'id/hash split' WHEN s_suppkey % 7 = 0 THEN 'hash mismatch (tampered payload?)' WHEN s_suppkey % 3 = 2 THEN 'unknown admin a2' WHEN s_suppkey % 11 = 0 THEN 'bad admin signature' END AS rejected FROM supplier""",
        "revoke_winners": f"WITH {_REVOKES} SELECT hash, prev, token_id, device_id, epoch FROM r QUALIFY row_number() OVER (PARTITION BY token_id ORDER BY epoch DESC, hash) = 1",
        "revoke_dangling": f"WITH {_REVOKES} SELECT hash, prev FROM r WHERE prev <> 'REVOKE-GENESIS' AND prev NOT IN (SELECT hash FROM r)",
        "revoke_merge": f"WITH RECURSIVE {_REVOKES}, t AS (SELECT hash, prev FROM r WHERE prev = 'REVOKE-GENESIS' UNION SELECT r.hash, r.prev FROM r JOIN t ON r.prev = t.hash) SELECT hash, prev FROM t",
        "revoked_devices": f"WITH {_REVOKES} SELECT DISTINCT device_id FROM r WHERE token_id = '*'",
        "revoked_tokens": f"WITH {_REVOKES}, m AS (SELECT token_id, max(epoch) AS top FROM r GROUP BY token_id) SELECT 't' || (c_custkey % 60) AS token_id, c_custkey % 6 AS epoch, c_custkey, coalesce(top >= c_custkey % 6, FALSE) AS revoked FROM customer LEFT JOIN m ON m.token_id = 't' || (c_custkey % 60)",
        "blob_references": "SELECT sha256(text) AS key, count(*) AS refs, max(octet_length(encode(text)))::BIGINT AS bytes, 'sha/' || substr(sha256(text), 1, 2) || '/' || substr(sha256(text), 3, 62) AS path FROM documents WHERE text IS NOT NULL GROUP BY sha256(text)",
        "blob_garbage": """WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS key FROM documents), b AS (SELECT DISTINCT key FROM d WHERE doc_id % 5 <> 0), r AS (SELECT DISTINCT key FROM d WHERE doc_id % 3 <> 0),
            q AS (SELECT DISTINCT key FROM d WHERE doc_id % 33 = 0) SELECT key, 'orphan' AS finding FROM b WHERE key NOT IN (SELECT key FROM r) AND key NOT IN (SELECT key FROM q) UNION ALL SELECT key, 'missing' FROM r WHERE key NOT IN (SELECT key FROM b)""",
        "quota": with_ledger + "SELECT sum(octet_length(encode(payload)))::BIGINT AS used, 1000000::BIGINT AS quota, sum(octet_length(encode(payload))) + 512 <= 1000000 AS fits FROM ev",
        "balances_with_conflicts": f"""WITH RECURSIVE {_FOLD}, {_CONFLICTS}, c AS (SELECT ev.actor, count(*) AS conflicts FROM cf JOIN ev ON ev.id = regexp_extract(event_ids, '"([^"]*)"\\]$', 1) GROUP BY ev.actor)
            SELECT e.actor, sum(value)::BIGINT AS balance, count(*) AS entries, coalesce(any_value(c.conflicts), 0) AS conflicts FROM entries e LEFT JOIN c ON c.actor = e.actor WHERE voided = 0 GROUP BY e.actor""",
    }
