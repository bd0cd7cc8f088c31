"""DuckDB SQL that gives each registered query's result over the same tables."""

from __future__ import annotations

FEED = """
feed AS (
  SELECT event_id AS seq, ts AS cluster_time,
         CASE WHEN event_type = 'signup' THEN 'insert'
              WHEN event_type IN ('purchase', 'click') THEN 'update'
              WHEN event_type = 'error' THEN 'delete' ELSE event_type END AS operation_type,
         CAST(user_id AS VARCHAR) AS document_key,
         '{"_id":"' || user_id || '","amount":' || value || ',"kind":"' || event_type || '","props":' || props || '}' AS doc,
         CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS BIGINT) AS commit_id,
         value AS amount, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type
  FROM events),
kept AS (SELECT * FROM feed WHERE operation_type IN ('insert', 'update', 'delete', 'replace')),
log AS (SELECT document_key AS key, seq, operation_type <> 'delete' AS alive, commit_id, amount, k FROM kept),
marks AS (SELECT commit_id, max(cluster_time) AS committed_at FROM feed GROUP BY commit_id)
"""


def _state(name: str, where: str = "true") -> str:
    return f"""
{name} AS (
  SELECT key, seq, amount, k FROM (
    SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log WHERE {where})
  WHERE rn = 1 AND alive)
"""


EFFECTIVE = """
daily AS (SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY commit_id, key ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1),
steps AS (SELECT *, max(seq) OVER (PARTITION BY key ORDER BY commit_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS so_far FROM daily),
effective AS (SELECT *, lag(alive) OVER (PARTITION BY key ORDER BY commit_id) AS was
    FROM steps WHERE so_far IS NULL OR seq > so_far)
"""

SNAPSHOTS = """
counted AS (
  SELECT commit_id, CAST(sum(CASE WHEN alive THEN 1 ELSE 0 END) AS BIGINT) AS added,
         CAST(sum(CASE WHEN coalesce(was, false) THEN 1 ELSE 0 END) AS BIGINT) AS removed
  FROM effective WHERE alive OR coalesce(was, false) GROUP BY commit_id),
snaps AS (
  SELECT commit_id, CASE WHEN removed = 0 THEN 'append' WHEN added = 0 THEN 'delete' ELSE 'overwrite' END AS operation,
         added, removed FROM counted)
"""

PLACES = """
SELECT r.r_name AS region, strftime(o.o_orderdate, '%Y-%m') AS mes, o.o_totalprice AS amount,
       o.o_orderstatus AS status, o.o_orderpriority AS channel
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
"""

VERDICTS = """
judged AS (
  SELECT seq, cluster_time, document_key, operation_type,
         CASE WHEN operation_type = 'delete' THEN 'accepted'
              WHEN operation_type = 'update' AND amount < 5 THEN 'post-image was not found'
              WHEN amount >= 80 THEN 'Unexpected BSON type of string for iceberg column name amount of type double'
              WHEN amount < 5 THEN 'Decimal128' ELSE 'accepted' END AS verdict
  FROM kept)
"""

POLLS = """
polls AS (
  SELECT CAST(user_id AS VARCHAR) AS sample_id,
         CASE WHEN day(ts) <= 10 THEN 'insert' WHEN day(ts) <= 20 THEN 'update' ELSE 'delete' END AS op,
         CAST(epoch_us(ts) AS DOUBLE) / 1e6::DOUBLE AS poll_start,
         CAST(epoch_us(ts) AS DOUBLE) / 1e6::DOUBLE + value / 100.0::DOUBLE AS poll_end,
         CASE WHEN event_type IN ('purchase', 'click') THEN 1 ELSE 0 END AS n_rows, event_type AS status,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS bytes
  FROM events),
marked AS (
  SELECT *, CASE op WHEN 'insert' THEN n_rows = 1 WHEN 'update' THEN n_rows = 1 AND status = 'purchase'
                    ELSE n_rows = 0 END AS hit,
         row_number() OVER w AS rn, lag(poll_start) OVER w AS prev,
         min(poll_start) OVER (PARTITION BY sample_id, op) AS start
  FROM polls WINDOW w AS (PARTITION BY sample_id, op ORDER BY poll_start)),
stops AS (
  SELECT sample_id, op, min(rn) AS stop FROM marked WHERE hit OR poll_end - start >= 172800.0::DOUBLE GROUP BY 1, 2),
upto AS (
  SELECT m.*, coalesce(s.stop, -1) AS stop FROM marked m LEFT JOIN stops s USING (sample_id, op)
  WHERE s.stop IS NULL OR m.rn <= s.stop),
result AS (
  SELECT sample_id, op, coalesce(bool_or(rn = stop AND hit), false) AS ok,
         max(CASE WHEN rn = stop THEN poll_end - start END) AS took,
         max(CASE WHEN rn = stop THEN poll_end - coalesce(prev, start) END) AS gap,
         count(*) AS polls, CAST(sum(bytes) AS BIGINT) AS bytes
  FROM upto GROUP BY sample_id, op)
"""


def _summary(samples: str, digits: int) -> str:
    scale = f"{10**digits}.0::DOUBLE"
    return f"""
WITH samples AS ({samples}),
ranked AS (
  SELECT op, round_even(visible_s * {scale}, 0) / {scale} AS v,
         row_number() OVER (PARTITION BY op ORDER BY visible_s) - 1 AS i, count(*) OVER (PARTITION BY op) AS c
  FROM samples WHERE ok),
picked AS (
  SELECT op, max(CASE WHEN i = round_even(0.5::DOUBLE * (c - 1), 0) THEN v END) AS p50,
         max(CASE WHEN i = round_even(0.95::DOUBLE * (c - 1), 0) THEN v END) AS p95
  FROM ranked GROUP BY op)
SELECT s.op, count(*) AS n, count(*) FILTER (WHERE ok) AS converged, count(*) FILTER (WHERE NOT ok) AS timeouts,
       any_value(p50) AS p50, any_value(p95) AS p95,
       round(max(CASE WHEN ok THEN visible_s END), {digits}) AS max,
       round(avg(CASE WHEN ok THEN visible_s END), {digits}) AS mean, CAST(sum(bytes) AS BIGINT) AS bytes
FROM samples s LEFT JOIN picked USING (op) GROUP BY s.op
"""


MIDWAY = _state("mid", "commit_id <= 20")
LATER_DOCS = """
docs AS (SELECT document_key AS key, seq, amount, k FROM feed
         WHERE commit_id > 20 AND operation_type IN ('insert', 'update'))
"""
STORED = f"WITH {FEED}, {_state('st')} SELECT key AS _id, st.amount, event_type AS kind, st.k FROM st JOIN feed USING (seq)"

# The table on disk of the late feed: a commit for every three days, half of the events three commits late.
LATE = FEED.replace(
    "commit_id, amount, k FROM kept",
    "dense_rank() OVER (ORDER BY (commit_id - 1) // 3 + CASE WHEN amount < 50 THEN 3 ELSE 0 END) AS commit_id, amount, k FROM kept",
)

RESET = f"""
WITH {FEED}, {_state('cur')}, {_state('goal', 'commit_id <= 15')},
actions AS (
  SELECT coalesce(c.key, g.key) AS _id,
         CASE WHEN g.key IS NULL THEN 'delete' WHEN c.key IS NULL THEN 'insert'
              WHEN c.amount IS NOT DISTINCT FROM g.amount AND c.k IS NOT DISTINCT FROM g.k THEN 'noop'
              ELSE 'replace' END AS action, g.amount, g.k
  FROM cur c FULL JOIN goal g ON c.key = g.key)
"""

IDENTIFIERS = """
SELECT replace(c_name, '#', '-') AS value FROM customer UNION ALL SELECT url FROM pages
UNION ALL SELECT text FROM documents UNION ALL SELECT CAST(o_orderkey AS VARCHAR) FROM orders
"""

CHECKS = f"""
WITH {FEED}, {VERDICTS}, checks AS (
  SELECT 'source' AS item, 'ok' AS estado, CAST(NULL AS VARCHAR) AS detalhe
  UNION ALL SELECT 'post-images', CASE WHEN count(*) = 0 THEN 'ok' ELSE 'falha' END,
         CASE WHEN count(*) > 0 THEN count(*) || ' update(s) without post-image' END
         FROM kept WHERE operation_type = 'update' AND amount < 5
  UNION ALL SELECT 'dead-letter queue', CASE WHEN count(*) = 0 THEN 'ok' ELSE 'alerta' END,
         CASE WHEN count(*) > 0 THEN count(*) || ' documento(s) rejeitado(s)' END
         FROM judged WHERE verdict <> 'accepted'
  UNION ALL SELECT 'lake', 'ok', NULL)
"""



def _once(delivered: str, consumed: str) -> str:
    """What came (position, seq) after the break and before it, against what should have."""
    return f"""WITH {FEED}, first_part AS (SELECT row_number() OVER (ORDER BY seq) - 1 AS position, seq FROM feed WHERE commit_id <= 20),
        missed AS (SELECT row_number() OVER (ORDER BY seq) - 1 AS position, seq FROM feed WHERE commit_id > 20),
        got(position, seq) AS ({delivered}), had(position, seq) AS ({consumed}),
        facts AS (SELECT (SELECT count(*) FROM missed) AS expected, (SELECT count(*) FROM got) AS delivered,
          NOT EXISTS (SELECT * FROM missed WHERE (position, seq) NOT IN (SELECT (position, seq) FROM got)) AS missed_delivered,
          (SELECT count(*) - count(DISTINCT seq) FROM got) + (SELECT count(DISTINCT seq) FROM got WHERE seq IN (SELECT seq FROM had)) AS duplicates,
          (SELECT count(*) FROM first_part) = (SELECT count(*) FROM had)
            AND NOT EXISTS (SELECT * FROM first_part WHERE (position, seq) NOT IN (SELECT (position, seq) FROM had)) AS before)
        SELECT expected, delivered, missed_delivered, duplicates, greatest(0, delivered - expected) AS extra, before,
          before AND missed_delivered AND delivered = expected AS ok FROM facts"""


ORACLE: dict[str, str] = {
    "s1_feed_batch": f"""WITH {FEED} SELECT seq, operation_type, document_key, cluster_time,
        CASE WHEN operation_type <> 'delete' THEN doc END AS full_document FROM feed""",
    "s2_initial_sync": f"""WITH {FEED}, changes AS (
        SELECT CAST(c_custkey AS VARCHAR) AS key, CAST(-1 AS BIGINT) AS seq, true AS alive, c_acctbal AS amount FROM customer
        UNION ALL SELECT key, seq, alive, amount FROM log)
        SELECT key, seq, amount FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM changes)
        WHERE rn = 1 AND alive""",
    "s3_operation_filter": f"WITH {FEED} SELECT seq, operation_type, document_key FROM kept",
    "s4_payload_selection": f"""WITH {FEED} SELECT seq, operation_type,
        CASE WHEN operation_type = 'delete' THEN '{{"_id":"' || document_key || '"}}' ELSE doc END AS payload FROM kept""",
    "s5_post_image_requirement": f"""WITH {FEED} SELECT document_key, count(*) AS violations FROM feed
        WHERE operation_type = 'update' AND amount < 5 GROUP BY document_key""",
    "s6_sanitised_names": """SELECT o_orderkey AS order_key, o_totalprice AS _price, o_orderstatus AS st_at,
        o_orderpriority AS p__r FROM orders""",
    "s6_sanitised_key_strings": "SELECT page_id, translate(url, '.$', '__') AS safe_name FROM pages",
    "s7_schema_evolution": f"""WITH {FEED} SELECT document_key AS _id, seq, amount, event_type AS kind, k,
        CASE WHEN commit_id > 10 THEN amount END AS bonus FROM kept WHERE operation_type <> 'delete'""",
    "s8_type_check": f"WITH {FEED}, {VERDICTS} SELECT verdict, count(*) AS documents FROM judged GROUP BY verdict",
    "s8_many_forms": f"""WITH {FEED}, docs AS (SELECT CAST(document_key AS BIGINT) % 16384 AS bits, CAST(document_key AS BIGINT) AS id
        FROM kept WHERE operation_type <> 'delete')
        SELECT CASE WHEN bits % 2 = 1 AND id % 5 = 0 THEN 'rejected' ELSE 'accepted' END AS verdict,
        CASE WHEN bits % 2 = 1 AND id % 5 = 0 THEN NULL ELSE CAST(bit_count(bits) AS BIGINT) END AS fields, count(*) AS documents
        FROM docs GROUP BY 1, 2""",
    "s9_dead_letter_count": f"WITH {FEED}, {VERDICTS} SELECT count(*) AS dlq FROM judged WHERE verdict <> 'accepted'",
    "s9_dead_letter_samples": f"""WITH {FEED}, {VERDICTS}
        SELECT CASE WHEN verdict LIKE 'post%' THEN '?' ELSE document_key END AS doc_id, verdict AS reason
        FROM judged WHERE verdict <> 'accepted' ORDER BY cluster_time LIMIT 3""",
    "s9_dead_letter_newest": f"""WITH {FEED}, {VERDICTS}
        SELECT cluster_time AS dlq_time, CASE WHEN verdict LIKE 'post%' THEN '?' ELSE document_key END AS doc_id,
        verdict AS reason FROM judged WHERE verdict <> 'accepted' ORDER BY cluster_time DESC LIMIT 5""",
    "s10_keyed_apply": f"WITH {FEED}, {_state('st')} SELECT * FROM st",
    "s11_commit_writer": STORED,
    "s12_stream_apply": STORED,
    "s2_synced_table": f"""WITH {FEED}, {_state('st')}
        SELECT CAST(o_orderkey AS VARCHAR) AS _id, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority,
          NULL::DOUBLE AS amount, NULL::VARCHAR AS kind, NULL::BIGINT AS k
        FROM orders WHERE CAST(o_orderkey AS VARCHAR) NOT IN (SELECT key FROM log)
        UNION ALL SELECT key, NULL, NULL, NULL, NULL, NULL, st.amount, event_type, st.k FROM st JOIN feed USING (seq)""",
    "s13_guarded_rebuild": """SELECT CAST(o_orderkey AS VARCHAR) AS _id, o_totalprice AS amount, o_orderstatus AS status,
        o_orderpriority AS channel, o_orderdate AS orderdate FROM orders""",
    "q1_orders_by_region": f"SELECT region, count(*) AS orders, round(sum(amount), 2) AS revenue FROM ({PLACES}) GROUP BY region",
    "q2_point_lookup": "SELECT * FROM orders WHERE o_orderkey = 7",
    "q3_projected_lookup": """SELECT CAST(o_orderkey AS VARCHAR) AS _id, o_orderstatus AS status, o_totalprice AS amount,
        o_orderpriority AS channel FROM orders WHERE o_orderkey = 7""",
    "q3_parameterised_lookup": "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = 7",
    "q4_evolved_lookup": f"""WITH {FEED} SELECT document_key AS _id, seq, amount, event_type AS kind, k,
        CASE WHEN commit_id > 10 THEN amount END AS bonus
        FROM kept WHERE operation_type <> 'delete' AND document_key = '8'""",
    "q5_business_question": f"""SELECT region, mes, count(*) AS pedidos, round(sum(amount), 2) AS receita,
        round(avg(amount), 2) AS ticket_medio,
        round(100.0::DOUBLE * count(*) FILTER (WHERE status = 'F') / count(*), 2) AS pct_cancelado,
        round(100.0::DOUBLE * count(*) FILTER (WHERE channel = '1-URGENT') / count(*), 2) AS pct_app
        FROM ({PLACES}) GROUP BY region, mes ORDER BY receita DESC, region, mes LIMIT 25""",
    "q6_business_question_counts": f"""SELECT region, mes, count(*) AS pedidos, round(sum(amount), 2) AS receita,
        round(avg(amount), 2) AS ticket_medio, count(*) FILTER (WHERE status = 'F') AS cancelados,
        count(*) FILTER (WHERE channel = '1-URGENT') AS via_app
        FROM ({PLACES}) GROUP BY region, mes ORDER BY sum(amount) DESC, region, mes LIMIT 25""",
    "q7_top_products": """SELECT p_brand AS product, count(*) AS pedidos, CAST(sum(l_quantity) AS BIGINT) AS unidades,
        round(sum(l_extendedprice), 2) AS receita,
        round(100.0::DOUBLE * sum(l_extendedprice) / sum(sum(l_extendedprice)) OVER (), 2) AS pct_receita_total
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand""",
    "q8_key_counts": "SELECT count(*) AS total, count(DISTINCT l_orderkey) AS distintos FROM lineitem",
    "q9_status_distribution": "SELECT o_orderstatus AS status, count(*) AS pedidos FROM orders GROUP BY o_orderstatus",
    "q9_status_top": """SELECT o_orderpriority AS status, count(*) AS pedidos FROM orders
        GROUP BY o_orderpriority ORDER BY pedidos DESC, status LIMIT 3""",
    "q10_tolerant_totals": """SELECT count(*) AS total,
        round(sum(CASE WHEN o_orderstatus <> 'P' AND o_orderpriority NOT IN ('5-LOW', '2-HIGH') THEN o_totalprice ELSE 0 END), 2)
        AS receita, min(o_orderdate) AS primeiro_pedido, max(o_orderdate) AS ultimo_pedido FROM orders""",
    "q11_snapshot_history": f"""WITH {FEED}, {EFFECTIVE}, {SNAPSHOTS}
        SELECT commit_id AS snapshot_id, committed_at, operation, CAST(added AS VARCHAR) AS adicionados,
        CAST(removed AS VARCHAR) AS removidos FROM snaps JOIN marks USING (commit_id)
        ORDER BY committed_at DESC, snapshot_id DESC LIMIT 20""",
    "q11_table_snapshots": f"""WITH {LATE}, {EFFECTIVE}, {SNAPSHOTS} SELECT commit_id AS snapshot_id, operation,
        CAST(added AS VARCHAR) AS adicionados, CAST(removed AS VARCHAR) AS removidos FROM snaps ORDER BY commit_id DESC LIMIT 20""",
    "q11_snapshot_history_late": f"""WITH {FEED.replace("commit_id, amount, k FROM kept", "commit_id + CASE WHEN amount < 50 THEN 3 ELSE 0 END AS commit_id, amount, k FROM kept")},
        {EFFECTIVE}, {SNAPSHOTS} SELECT commit_id, operation, added, removed FROM snaps""",
    "q12_version_as_of": f"WITH {FEED}, {_state('st', 'commit_id <= 7')} SELECT * FROM st",
    "q13_timestamp_as_of": f"""WITH {FEED}, {_state('st', '''commit_id <= (SELECT max(commit_id) FROM marks
        WHERE committed_at <= TIMESTAMP '2024-01-13 12:00:00')''')} SELECT * FROM st""",
    "q14_key_history": f"""WITH {FEED}, {EFFECTIVE}, spans AS (
        SELECT key, seq, alive, amount, k, commit_id AS lo, lead(commit_id) OVER (PARTITION BY key ORDER BY commit_id) AS hi
        FROM effective WHERE key = '8')
        SELECT m.commit_id AS snapshot_id, committed_at, '8' AS key, coalesce(alive, false) AS existed,
        CASE WHEN alive THEN amount END AS amount, CASE WHEN alive THEN k END AS k
        FROM marks m LEFT JOIN spans ON m.commit_id >= lo AND (hi IS NULL OR m.commit_id < hi)""",
    "q14_table_key_history": f"""WITH {LATE}, {EFFECTIVE}, spans AS (
        SELECT key, seq, alive, amount, k, commit_id AS lo, lead(commit_id) OVER (PARTITION BY key ORDER BY commit_id) AS hi
        FROM effective WHERE key = '8')
        SELECT m.commit_id AS snapshot_id, '8' AS key, coalesce(alive, false) AS existed,
        CASE WHEN alive THEN amount END AS amount, CASE WHEN alive THEN k END AS k
        FROM (SELECT DISTINCT commit_id FROM log) m LEFT JOIN spans ON m.commit_id >= lo AND (hi IS NULL OR m.commit_id < hi)""",
    "q14_key_versions": f"""WITH {FEED}, {EFFECTIVE} SELECT key, seq, alive AS existed, commit_id AS valid_from, amount, k,
        lead(commit_id) OVER (PARTITION BY key ORDER BY commit_id) AS valid_to FROM effective""",
    "q16_result_page": """SELECT CAST(o_orderkey AS VARCHAR) AS _id, o_totalprice AS amount,
        (SELECT count(*) FROM orders) > 199 AS truncated FROM orders
        ORDER BY o_totalprice DESC, CAST(o_orderkey AS VARCHAR) LIMIT 199""",
    "m1_convergence_states": f"""WITH {FEED}, {_state('cur')}, {_state('old', 'commit_id <= 4')},
        s AS (SELECT count(*) AS t FROM cur), lakes AS (
        SELECT 'current' AS lake, count(*) AS lt, count(DISTINCT key) AS ld FROM cur
        UNION ALL SELECT 'lagging', count(*), count(DISTINCT key) FROM old
        UNION ALL SELECT 'duplicated', count(*), count(DISTINCT key) FROM (SELECT key FROM cur UNION ALL SELECT key FROM old)
        UNION ALL SELECT 'offline', NULL, NULL)
        SELECT lake, (SELECT t FROM s) AS origem_total, lt AS lake_total, ld AS lake_distintos,
        CASE WHEN lt IS NULL THEN 'iceberg offline' WHEN lt = (SELECT t FROM s) AND ld = lt THEN 'convergido'
             WHEN lt > ld THEN 'tabela duplicada' WHEN lt <> (SELECT t FROM s) THEN 'propagando' ELSE 'divergente' END AS estado
        FROM lakes""",
    "m1_content_convergence": f"""WITH {FEED}, {_state('cur')}, {_state('old', 'commit_id <= 4')},
        s AS (SELECT count(*) AS t, count(*) FILTER (WHERE k % 10 = 7 AND amount IS NOT NULL) AS altered FROM cur),
        o AS (SELECT count(*) AS t FROM old),
        lag AS (SELECT count(*) FILTER (WHERE o.key IS NULL) AS missing, count(*) FILTER (WHERE c.key IS NULL) AS extra,
          count(*) FILTER (WHERE o.key = c.key AND (o.amount IS DISTINCT FROM c.amount OR o.k IS DISTINCT FROM c.k)) AS differing
          FROM cur c FULL JOIN old o ON c.key = o.key)
        SELECT 'equal' AS lake, t AS origem_total, t AS lake_total, t AS lake_distintos, 'convergido' AS estado,
          0 AS faltando, 0 AS sobrando, 0 AS diferentes FROM s
        UNION ALL SELECT 'altered', t, t, t, CASE WHEN altered > 0 THEN 'divergente' ELSE 'convergido' END, 0, 0, altered FROM s
        UNION ALL SELECT 'lagging', s.t, o.t, o.t,
          CASE WHEN s.t <> o.t THEN 'propagando' WHEN missing + extra + differing > 0 THEN 'divergente' ELSE 'convergido' END,
          missing, extra, differing FROM s, o, lag
        UNION ALL SELECT 'offline', t, NULL, NULL, 'iceberg offline', NULL, NULL, NULL FROM s""",
    "m1_table_differences": f"""WITH {FEED}, {_state('cur', 'commit_id <= 20')}, {_state('goal')}
        SELECT coalesce(c.key, g.key) AS _id, CASE WHEN g.key IS NULL THEN 'delete' WHEN c.key IS NULL THEN 'insert' ELSE 'replace' END AS action,
        g.amount FROM cur c FULL JOIN goal g ON c.key = g.key
        WHERE g.key IS NULL OR c.key IS NULL OR c.amount IS DISTINCT FROM g.amount""",
    "m2_duplicate_keys": "SELECT user_id, count(*) AS copies FROM events GROUP BY user_id HAVING count(*) > 1",
    "m3_lag_states": f"""WITH {FEED}, bounds AS (
        SELECT min(cluster_time) AS lo, max(cluster_time) AS hi FROM feed WHERE commit_id >= 5),
        spans AS (SELECT commit_id, epoch_us(committed_at) - epoch_us((SELECT lo FROM bounds)) AS margin,
        epoch_us((SELECT hi FROM bounds)) - epoch_us((SELECT lo FROM bounds)) AS w FROM marks)
        SELECT commit_id, round(margin / 1e6::DOUBLE, 1) AS margem_segundos, round(w / 1e6::DOUBLE, 1) AS janela_segundos,
        CASE WHEN margin < 0 THEN 'critico' WHEN w <= 0 OR margin / w < 0.2::DOUBLE THEN 'alerta' ELSE 'ok' END AS estado FROM spans""",
    "m3_feed_lag": f"""WITH {FEED}, ends AS (
        SELECT (SELECT max(cluster_time) FROM kept WHERE commit_id <= 20) AS checkpoint,
        min(cluster_time) AS feed_start, max(cluster_time) AS feed_end FROM feed WHERE commit_id >= 5),
        spans AS (SELECT *, epoch_us(checkpoint) - epoch_us(feed_start) AS margin, epoch_us(feed_end) - epoch_us(feed_start) AS w FROM ends)
        SELECT checkpoint, feed_start, feed_end, round(margin / 1e6::DOUBLE, 1) AS margem_segundos, round(w / 1e6::DOUBLE, 1) AS janela_segundos,
        CASE WHEN margin < 0 THEN 'critico' WHEN w <= 0 OR margin / w < 0.2::DOUBLE THEN 'alerta' ELSE 'ok' END AS estado FROM spans""",
    "q15_table_columns": f"""WITH {FEED}, docs AS (SELECT * FROM kept WHERE operation_type <> 'delete')
        SELECT 0 AS posicao, '_id' AS nome, 'string' AS tipo, count(*) AS preenchidos, min(commit_id) AS desde FROM docs
        UNION ALL SELECT 1, 'amount', 'double', count(amount), min(commit_id) FROM docs
        UNION ALL SELECT 2, 'kind', 'string', count(event_type), min(commit_id) FROM docs
        UNION ALL SELECT 3, 'props', 'struct<k:bigint>', count(k), min(commit_id) FROM docs
        UNION ALL SELECT 4, 'bonus', 'double', count(amount), min(commit_id) FROM docs WHERE commit_id > 10""",
    "m4_preflight_report": f"{CHECKS} SELECT * FROM checks",
    "m4_preflight_verdict": f"""{CHECKS} SELECT count(*) FILTER (WHERE estado = 'falha') = 0 AS ok,
        CASE WHEN count(*) FILTER (WHERE estado = 'falha') > 0 THEN 'com_falha'
             WHEN count(*) FILTER (WHERE item = 'lake' AND estado = 'ok') > 0 THEN 'completo' ELSE 'somente_mongodb' END AS modo,
        count(*) FILTER (WHERE estado = 'alerta') > 0 AS avisos FROM checks""",
    "m4_preflight_failures": f"""{CHECKS} SELECT 'source gone' AS falta, item, CASE WHEN item = 'source' THEN 'falha' ELSE estado END AS estado,
        CASE WHEN item = 'source' THEN 'the collection does not exist' ELSE detalhe END AS detalhe FROM checks WHERE item <> 'post-images'
        UNION ALL SELECT 'source lost', 'source', 'falha', 'no answer from mongodb://<redacted>'
        UNION ALL SELECT 'lake gone', item, CASE WHEN item = 'lake' THEN 'alerta' ELSE estado END,
        CASE WHEN item = 'lake' THEN 'the table does not exist' ELSE detalhe END FROM checks""",
    "m5_write_propagation": f"""WITH {POLLS} SELECT sample_id, op, ok, CASE WHEN ok THEN round(took, 2) END AS visible_s,
        CASE WHEN ok THEN round(gap, 2) END AS window_s, CASE WHEN NOT ok THEN round(took, 2) END AS waited_s, polls, bytes
        FROM result""",
    "m6_cycle_rule": f"""WITH {POLLS}, earlier AS (SELECT *, min(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY sample_id
        ORDER BY CASE op WHEN 'insert' THEN 1 WHEN 'update' THEN 2 ELSE 3 END
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fine FROM result)
        SELECT sample_id, op, ok FROM earlier WHERE coalesce(fine, 1) = 1""",
    "m7_latency_summary": _summary(
        """SELECT event_type AS op, value < 90 AS ok, value AS visible_s,
        CAST(json_extract_string(props, '$.k') AS BIGINT) AS bytes FROM events""",
        2,
    ),
    "m8_commit_latency": _summary(
        f"""WITH {FEED} SELECT operation_type AS op, true AS ok,
        CAST(epoch_us(committed_at) - epoch_us(cluster_time) AS DOUBLE) / 1000.0::DOUBLE AS visible_s, 0 AS bytes
        FROM kept JOIN marks USING (commit_id)""",
        1,
    ),
    "m9_event_ordering": f"""WITH {FEED}, moves AS (SELECT *, CASE WHEN operation_type <> 'delete' THEN doc END AS body,
        cluster_time < lag(cluster_time) OVER (PARTITION BY document_key ORDER BY seq) AS back FROM kept),
        per_key AS (SELECT document_key, count(*) AS events, count(*) FILTER (WHERE commit_id <= 29) AS expected,
          count(*) FILTER (WHERE back) = 0 AS cluster_time_monotonic, max_by({{'d': body}}, seq) AS last,
          max_by({{'d': body}}, seq) FILTER (WHERE commit_id <= 29) AS final FROM moves GROUP BY document_key)
        SELECT document_key, events, cluster_time_monotonic, last.d IS NOT DISTINCT FROM final.d AS last_event_equals_final,
          events = expected AND cluster_time_monotonic AND last.d IS NOT DISTINCT FROM final.d AS ok FROM per_key""",
    "m10_exactly_once": _once(
        "SELECT * FROM missed UNION ALL SELECT (SELECT count(*) FROM missed) + row_number() OVER (ORDER BY seq) - 1, seq"
        " FROM feed WHERE commit_id = 20",
        "SELECT * FROM first_part",
    ),
    "m10_exactly_once_sparse_seq": _once(
        "SELECT * FROM missed UNION ALL SELECT (SELECT count(*) FROM missed) + row_number() OVER (ORDER BY seq) - 1, seq"
        " FROM feed WHERE commit_id = 20",
        "SELECT * FROM first_part",
    ),
    "m10_lost_and_swapped": _once(
        "SELECT CASE position WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE position END, seq FROM missed WHERE position <> 2",
        "SELECT * FROM first_part WHERE position <> 1",
    ),
    "m11_secret_redaction": r"""WITH cut AS (SELECT doc_id,
        regexp_replace(regexp_replace(regexp_replace(text, 'mongodb(?:\+srv)?://[^\s''"]+', 'mongodb://<redacted>', 'g'),
          '\b[\w.-]+\.mongodb(?:-dev)?\.net(?::\d+)?\b', '<cluster-host>', 'g'),
          '\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|\b\d{12}\b', '<aws-id>', 'g') AS t FROM documents)
        SELECT doc_id, md5(t) AS redacted_md5, substring(t, 1, 300) AS message FROM cut""",
    "m12_masking_by_name": """SELECT c_custkey, '<mascarado>' AS contactEmail, c_acctbal AS balance,
        '<mascarado>' AS apiToken, '<mascarado>' AS Password, c_nationkey AS nation FROM customer""",
    "m13_identifier_rules": f"""SELECT md5(value) AS value_md5,
        regexp_full_match(value, '[A-Za-z0-9][A-Za-z0-9_-]{{0,127}}') AS order_id,
        regexp_full_match(value, '[A-Za-z0-9][A-Za-z0-9_-]{{0,79}}') AS query_id,
        coalesce(regexp_full_match(value, '[0-9]+') AND TRY_CAST(value AS BIGINT) >= 1, false) AS snapshot_id,
        count(*) AS copies FROM ({IDENTIFIERS}) GROUP BY ALL""",
    "w1_upsert_documents": f"""WITH {FEED}, {MIDWAY}, {LATER_DOCS}, stack AS (
        SELECT key, seq, amount, k, false AS stored FROM docs UNION ALL SELECT key, -1, amount, k, true FROM mid),
        seen AS (SELECT *, lag(seq) OVER w AS p, lag(amount) OVER w AS pa, lag(k) OVER w AS pk FROM stack
                 WINDOW w AS (PARTITION BY key ORDER BY seq))
        SELECT seq, CASE WHEN p IS NULL THEN 'insert' ELSE 'replace' END AS operation_type, key AS _id, amount, k
        FROM seen WHERE NOT stored AND (p IS NULL OR pa IS DISTINCT FROM amount OR pk IS DISTINCT FROM k)""",
    "w1_upsert_sparse_seq": f"""WITH {FEED}, {MIDWAY}, {LATER_DOCS}, stack AS (
        SELECT key, seq, amount, k, false AS stored FROM docs UNION ALL SELECT key, -1, amount, k, true FROM mid),
        seen AS (SELECT *, lag(seq) OVER w AS p, lag(amount) OVER w AS pa, lag(k) OVER w AS pk FROM stack
                 WINDOW w AS (PARTITION BY key ORDER BY seq))
        SELECT seq * 4294967296 AS seq, CASE WHEN p IS NULL THEN 'insert' ELSE 'replace' END AS operation_type, key AS _id, amount, k
        FROM seen WHERE NOT stored AND (p IS NULL OR pa IS DISTINCT FROM amount OR pk IS DISTINCT FROM k)""",
    "w1_upsert_again": f"""WITH {FEED}, {MIDWAY} SELECT CAST(1000000000 AS BIGINT) AS seq, 'replace' AS operation_type,
        key AS _id, amount + 1 AS amount, k FROM mid WHERE amount > 50""",
    "w2_patch_fields": f"""WITH {FEED}, {MIDWAY}, patches AS (
        SELECT document_key AS key, seq, CASE WHEN amount < 60 THEN amount END AS amount, CASE WHEN amount > 30 THEN k END AS k
        FROM feed WHERE commit_id > 20 AND operation_type = 'update'),
        stack AS (SELECT *, false AS stored FROM patches WHERE key IN (SELECT key FROM mid)
                  UNION ALL SELECT key, -1, amount, k, true FROM mid),
        seen AS (SELECT *, last_value(amount IGNORE NULLS) OVER w AS pa, last_value(k IGNORE NULLS) OVER w AS pk FROM stack
                 WINDOW w AS (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT seq, 'update' AS operation_type, key AS _id, coalesce(amount, pa) AS amount, coalesce(k, pk) AS k FROM seen
        WHERE NOT stored AND ((amount IS NOT NULL AND amount IS DISTINCT FROM pa) OR (k IS NOT NULL AND k IS DISTINCT FROM pk))""",
    "w2_patch_unmatched": f"""WITH {FEED}, {MIDWAY} SELECT document_key AS _id, seq FROM feed
        WHERE commit_id > 20 AND operation_type = 'update' AND document_key NOT IN (SELECT key FROM mid)""",
    "w3_delete_by_key": f"""WITH {FEED}, {MIDWAY} SELECT CAST(1000000000 AS BIGINT) AS seq, 'delete' AS operation_type,
        key AS _id FROM mid WHERE key IN (SELECT document_key FROM feed WHERE commit_id > 20 AND operation_type = 'delete')""",
    "w4_reconcile_to_baseline": f"{RESET} SELECT * FROM actions",
    "w4_reconcile_unequal": f"{RESET} SELECT * FROM actions WHERE action <> 'noop'",
    "w4_reset_report": f"""{RESET}, {VERDICTS}, kept_judged AS (SELECT * FROM judged WHERE verdict <> 'accepted') SELECT count(*) FILTER (WHERE action = 'delete' AND _id IN ('8', '46')) AS live_removed,
        count(*) FILTER (WHERE action = 'delete' AND _id NOT IN ('8', '46')) AS strays_removed,
        count(*) FILTER (WHERE action IN ('insert', 'replace')) AS seed_upserted,
        count(*) FILTER (WHERE action <> 'delete') AS total, count(*) FILTER (WHERE action = 'noop') AS unchanged,
        (SELECT count(*) FROM kept_judged) AS dlq_cleared,
        count(*) FILTER (WHERE action <> 'delete') = (SELECT count(*) FROM goal) AS ok FROM actions""",
}
