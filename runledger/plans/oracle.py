"""The same queries in SQL, written apart from the operators, for the DuckDB check."""

F1 = """
task_attempt AS (
  SELECT concat('dag_', CAST(user_id % 5 AS VARCHAR)) AS dag_id,
         concat('run_', CAST(CAST(ts AS DATE) AS VARCHAR)) AS run_id,
         concat('task_', lpad(CAST(event_id % 20 AS VARCHAR), 2, '0')) AS task_id,
         CASE WHEN event_type = 'view' THEN 'success'
              WHEN event_type = 'error' THEN 'failed'
              WHEN event_type = 'click' AND event_id % 3 = 0 THEN 'deferred'
              WHEN event_type = 'click' THEN 'running'
              WHEN event_type = 'signup' AND event_id % 3 = 0 THEN 'scheduled'
              WHEN event_type = 'signup' THEN 'queued' END AS state,
         event_id AS attempt_id, ts AS attempt_ts, props AS message
  FROM events)"""

F2 = F1 + """,
ranked_attempt AS (
  SELECT *, row_number() OVER (PARTITION BY dag_id, run_id, task_id
           ORDER BY attempt_ts DESC, attempt_id DESC) AS rn
  FROM task_attempt),
task_instance AS (
  SELECT dag_id, run_id, task_id, state, attempt_id FROM ranked_attempt WHERE rn = 1)"""

F3 = """
dag_run AS (
  SELECT concat('dag_', CAST(o_custkey AS VARCHAR)) AS dag_id,
         concat('run_', CAST(o_orderkey AS VARCHAR)) AS run_id,
         CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN 'running'
              WHEN o_orderstatus = 'O' AND o_orderpriority = '2-HIGH' THEN 'queued'
              WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'success' END AS state,
         o_orderdate AS start_date, o_orderkey % 7200 AS waited_s
  FROM orders)"""

F3_SPAN = F3 + """,
dag_run_span AS (
  SELECT dag_id, run_id, start_date,
         CASE WHEN state NOT IN ('running', 'queued')
              THEN start_date + to_days(CAST(CAST(substr(run_id, 5) AS BIGINT) % 40 AS INTEGER)) END AS end_date
  FROM dag_run),
step AS (
  SELECT dag_id, t, CAST(sum(step) AS BIGINT) AS step
  FROM (SELECT dag_id, start_date AS t, 1 AS step, start_date, end_date FROM dag_run_span
        UNION ALL SELECT dag_id, end_date, -1, start_date, end_date FROM dag_run_span) e
  WHERE t IS NOT NULL AND (end_date IS NULL OR end_date > start_date)
  GROUP BY dag_id, t HAVING sum(step) <> 0),
swept AS (
  SELECT *, CAST(sum(step) OVER (PARTITION BY dag_id ORDER BY t) AS BIGINT) AS n FROM step)"""

F4 = """
dag AS (
  SELECT concat('dag_', CAST(c_custkey AS VARCHAR)) AS dag_id, c_custkey % 4 = 0 AS is_paused,
         c_custkey % 50 = 1 AS has_import_error, c_custkey % 50 NOT IN (1, 2) AS scanned
  FROM customer)"""

F5 = """
change AS (
  SELECT user_id AS k, event_id AS seq,
         CASE WHEN event_type = 'signup' THEN 'c' WHEN event_type = 'error' THEN 'd'
              ELSE 'u' END AS op,
         event_type, value, ts
  FROM events)"""

F6 = """
doc_line AS (
  SELECT doc_id, concat(source, '/', CAST(doc_id AS VARCHAR)) AS path,
         unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS line_no
  FROM documents),
doc_tail AS (
  SELECT doc_id, line_no, line
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no DESC) AS rn
        FROM doc_line) t
  WHERE rn <= 3)"""

F7 = """
cli_line AS (
  SELECT concat('dag_', CAST(user_id % 5 AS VARCHAR)) AS dag_id, event_id AS line_no,
         CASE WHEN event_type = 'view'
                THEN concat(CAST(CAST(ts AS DATE) AS VARCHAR), 'T00:00:00 INFO ', props)
              WHEN event_type = 'click' THEN 'No data found'
              WHEN event_type = 'signup' THEN 'filepath | error'
              ELSE concat('dags/', event_type, '.py | ', props) END AS line
  FROM events)"""

F8 = """
ranked_line AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
           ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rn
  FROM lineitem),
fact AS (SELECT * EXCLUDE (rn) FROM ranked_line WHERE rn = 1)"""

REVENUE = "CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT)"


def _line_figures(table: str) -> str:
    return f"""
      SELECT concat('lines/', CAST(l_suppkey AS VARCHAR)) AS metric,
             CAST(count(*) AS BIGINT) AS value FROM {table} GROUP BY l_suppkey
      UNION ALL
      SELECT concat('revenue_cents/', CAST(l_suppkey AS VARCHAR)),
             CAST(sum({REVENUE}) AS BIGINT) FROM {table} GROUP BY l_suppkey"""


ORDER_FIGURES = """
      SELECT concat('orders/', o_orderstatus) AS metric, CAST(count(*) AS BIGINT) AS value
      FROM orders GROUP BY o_orderstatus
      UNION ALL
      SELECT concat('order_cents/', o_orderstatus),
             CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT)
      FROM orders GROUP BY o_orderstatus"""

CUSTOMER_FIGURES = "SELECT 'customers' AS metric, CAST(count(*) AS BIGINT) AS value FROM customer"

COMPARE = """
SELECT coalesce(a.metric, e.metric) AS metric, a.value AS actual_value,
       e.value AS expected_value,
       CASE WHEN a.metric IS NULL THEN 'missing'
            WHEN a.run_id <> 'run_b' THEN 'stale'
            WHEN e.metric IS NULL THEN 'unexpected'
            WHEN a.value IS NOT DISTINCT FROM e.value THEN 'match'
            ELSE 'differ' END AS status
FROM actual a FULL OUTER JOIN expected e ON a.metric = e.metric"""

IN_FLIGHT = """
busy AS (
  SELECT dag_id, CAST(count(*) AS BIGINT) AS n, min(run_id) AS one_run FROM dag_run
  WHERE state = 'running' OR state = 'queued' GROUP BY dag_id)"""


def _decision(paused: str) -> str:
    return f"""
decided AS (
  SELECT d.dag_id,
         CASE WHEN NOT d.scanned AND d.has_import_error THEN 'parse_error'
              WHEN NOT d.scanned THEN 'absent'
              WHEN {paused} THEN 'refuse_paused'
              WHEN coalesce(b.n, 0) > 1 THEN 'refuse_busy'
              WHEN b.n = 1 THEN 'adopt'
              ELSE 'trigger' END AS decision,
         coalesce(b.n, 0) AS n_in_flight, b.one_run
  FROM dag d LEFT JOIN busy b ON b.dag_id = d.dag_id),
decision AS (
  SELECT dag_id, decision, n_in_flight,
         CASE WHEN decision = 'adopt' THEN one_run END AS adopted_run_id
  FROM decided)"""


VERDICT = """
verdict AS (
  SELECT dag_id, run_id, state, waited_s,
         CASE WHEN state = 'success' THEN 'success' WHEN state = 'failed' THEN 'failed'
              WHEN waited_s < 3600 THEN 'pending' ELSE 'no_verdict' END AS verdict,
         state = 'success' AS passed
  FROM dag_run)"""


def _scan(term: str, path_steps: str) -> str:
    """Lines that still hold the term in ``rest``, which ``path_steps`` defines over ``code``."""
    return f"""
WITH {F6},
code AS (SELECT path, line_no, line, string_split(line, '#')[1] AS code FROM doc_line),
{path_steps}
SELECT path, line_no,
       left(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), 80) AS excerpt
FROM rest WHERE contains(lower(code), '{term}') AND contains(lower(rest), '{term}')"""


# RE2 has no lookahead; the character after the name is put back instead.
LICENSE_STEPS = """
step1 AS (SELECT *, regexp_replace(code, '(?i)licensed under the apache license', '', 'g') AS s
          FROM code),
rest AS (SELECT *, regexp_replace(s, '(?i)mit license([^-]|$)', '\\1', 'g') AS rest FROM step1)"""

SCOPED_STEPS = """
step1 AS (SELECT *, CASE WHEN path LIKE 'src1%' THEN replace(code, 'MIT License', '')
                         ELSE code END AS s1 FROM code),
step2 AS (SELECT *, regexp_replace(s1, 'GNU [A-Z][a-z]+ Public License', '', 'g') AS s2
          FROM step1),
rest AS (SELECT *, regexp_replace(s2, '(?i)licensed under', '', 'g') AS rest FROM step2)"""

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

ORACLE: dict[str, str] = {
    "run_state": f"""
WITH {F3}, {F4},
requested AS (
  SELECT dag_id, run_id FROM dag_run
  UNION ALL SELECT dag_id, 'verify_' || dag_id FROM dag)
SELECT q.dag_id, q.run_id, coalesce(r.state, 'unqueued') AS state
FROM requested q LEFT JOIN dag_run r ON r.dag_id = q.dag_id AND r.run_id = q.run_id""",
    "in_flight_runs": f"""
WITH {F3}, {IN_FLIGHT},
listed AS (
  SELECT dag_id, run_id, start_date,
         row_number() OVER (PARTITION BY dag_id ORDER BY start_date, run_id) AS pos
  FROM dag_run WHERE state IN ('running', 'queued'))
SELECT l.dag_id, b.n AS n_in_flight, l.pos, l.run_id, l.start_date
FROM listed l JOIN busy b ON b.dag_id = l.dag_id WHERE l.pos < 4""",
    "run_decision": f"""
WITH {F3}, {F4}, {IN_FLIGHT}, {_decision("d.is_paused")}
SELECT dag_id, decision, n_in_flight, adopted_run_id FROM decision""",
    "run_verdict": f"WITH {F3}, {VERDICT} SELECT * FROM verdict",
    "verify_dags": f"""
WITH {F3}, {F4}, {F7}, {IN_FLIGHT}, {_decision("false")},
later AS (
  SELECT dag_id, run_id, waited_s,
         CASE WHEN state NOT IN ('running', 'queued') THEN state
              WHEN CAST(substr(run_id, 5) AS BIGINT) % 3 = 0 THEN 'success'
              WHEN CAST(substr(run_id, 5) AS BIGINT) % 3 = 1 THEN 'failed'
              ELSE state END AS state
  FROM dag_run),
verdict AS (
  SELECT dag_id, run_id, state,
         CASE WHEN state = 'success' THEN 'success' WHEN state = 'failed' THEN 'failed'
              WHEN waited_s < 3600 THEN 'pending' ELSE 'no_verdict' END AS verdict,
         state = 'success' AS passed
  FROM later),
open_run AS (
  SELECT dag_id, run_id, row_number() OVER (PARTITION BY dag_id ORDER BY start_date, run_id) AS rn
  FROM dag_run WHERE state IN ('running', 'queued')),
open_list AS (
  SELECT dag_id, string_agg(run_id, ', ' ORDER BY rn) AS said FROM open_run WHERE rn <= 3
  GROUP BY dag_id),
error_line AS (
  SELECT *, row_number() OVER (PARTITION BY dag_id ORDER BY line_no) AS rn FROM cli_line
  WHERE line <> 'No data found' AND line NOT LIKE 'filepath%'
    AND NOT regexp_matches(line, '^\\d{{4}}-\\d{{2}}-\\d{{2}}T')),
error_list AS (
  SELECT dag_id, string_agg(line, chr(10) ORDER BY line_no) AS said FROM error_line WHERE rn <= 5
  GROUP BY dag_id)
SELECT d.dag_id, d.decision, d.n_in_flight, d.adopted_run_id, v.state, v.verdict,
       coalesce(v.passed, false) AS passed,
       CASE d.decision WHEN 'refuse_busy' THEN o.said WHEN 'parse_error' THEN e.said END AS because
FROM decision d
     LEFT JOIN verdict v ON v.dag_id = d.dag_id AND v.run_id = d.adopted_run_id
     LEFT JOIN open_list o ON o.dag_id = d.dag_id
     LEFT JOIN error_list e ON e.dag_id = d.dag_id""",
    "unfinished_tasks": f"""
WITH {F2}
SELECT dag_id, run_id, task_id, state,
       CASE WHEN state IS NOT DISTINCT FROM 'failed' THEN 'FAILED' ELSE 'blocked' END AS label,
       CAST(CASE WHEN state IS NOT DISTINCT FROM 'failed' THEN 0 ELSE 1 END AS BIGINT) AS rank
FROM task_instance WHERE state IS DISTINCT FROM 'success'""",
    "failed_tasks": f"""
WITH {F2} SELECT dag_id, run_id, task_id FROM task_instance WHERE state = 'failed'""",
    "fail_in_flight_tasks": f"""
WITH {F2}
SELECT dag_id, run_id, task_id, attempt_id,
       CASE state WHEN 'running' THEN 'failed' WHEN 'queued' THEN 'failed'
                  WHEN 'scheduled' THEN 'failed' WHEN 'deferred' THEN 'failed'
                  ELSE state END AS state
FROM task_instance""",
    "fail_in_flight_runs": f"""
WITH {F3}
SELECT dag_id, run_id, start_date, waited_s,
       CASE WHEN state IN ('running', 'queued') THEN 'failed' ELSE state END AS state,
       CASE WHEN state IN ('running', 'queued') THEN TIMESTAMP '2024-02-01 00:00:00' END
         AS end_date
FROM dag_run""",
    "peak_overlap": f"""
WITH {F3_SPAN},
ranked AS (SELECT *, row_number() OVER (PARTITION BY dag_id ORDER BY n DESC, t) AS rn FROM swept)
SELECT dag_id, n AS most, t AS first_at FROM ranked WHERE rn = 1""",
    "busy_spans": f"""
WITH {F3_SPAN},
island AS (
  SELECT dag_id, t, n, step,
         sum(CASE WHEN n > 1 AND n - step <= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY dag_id ORDER BY t) AS span
  FROM swept)
SELECT dag_id, min(t) AS busy_from, max(CASE WHEN n <= 1 THEN t END) AS busy_to, max(n) AS most
FROM island WHERE n > 1 OR n - step > 1 GROUP BY dag_id, span""",
    "watch_verdicts": """
WITH run AS (
  SELECT concat('dag_', CAST(o_custkey AS VARCHAR)) AS dag_id,
         concat('run_', CAST(o_orderkey AS VARCHAR)) AS run_id, o_orderdate AS triggered_at,
         CASE o_orderstatus WHEN 'P' THEN 'failed' WHEN 'F' THEN 'success' END AS state,
         o_orderdate + to_seconds(o_orderkey % 7200) AS finished_at
  FROM orders),
clock AS (
  SELECT least(max(triggered_at), max(finished_at) FILTER (state IS NOT NULL)) AS now FROM run),
judged AS (
  SELECT *, state IS NOT NULL AND finished_at <= triggered_at + to_seconds(3600) AS in_time FROM run)
SELECT dag_id, run_id, triggered_at, CASE WHEN in_time THEN state ELSE 'no_verdict' END AS verdict,
       in_time AND state = 'success' AS passed
FROM judged, clock WHERE in_time OR triggered_at + to_seconds(3600) < now""",
    "end_runs_of_dags": f"""
WITH {F3}
SELECT dag_id, run_id, start_date, waited_s,
       CASE WHEN state IN ('running', 'queued') THEN 'failed' ELSE state END AS state,
       CASE WHEN state IN ('running', 'queued') THEN TIMESTAMP '2024-02-01 00:00:00' END
         AS end_date
FROM dag_run WHERE dag_id IN ('dag_4', 'dag_7', 'dag_13', 'dag_100')""",
    "end_tasks_of_dags": f"""
WITH {F2}
SELECT dag_id, run_id, task_id, attempt_id,
       CASE WHEN state IN ('running', 'queued', 'scheduled', 'deferred') THEN 'failed'
            ELSE state END AS state
FROM task_instance WHERE dag_id IN ('dag_1', 'dag_3')""",
    "end_dags": f"""
WITH {F2}, {F3},
asked AS (SELECT unnest(['dag_1', 'dag_3', 'dag_4', 'dag_7', 'dag_13', 'dag_100']) AS asked_id)
SELECT dag_id, run_id, task_id,
       CASE WHEN asked_id IS NOT NULL AND state IN ('running', 'queued', 'scheduled', 'deferred')
            THEN 'failed' ELSE state END AS state,
       CAST(NULL AS TIMESTAMP) AS end_date
FROM task_instance LEFT JOIN asked ON asked_id = dag_id
UNION ALL
SELECT dag_id, run_id, NULL,
       CASE WHEN asked_id IS NOT NULL AND state IN ('running', 'queued') THEN 'failed' ELSE state END,
       CASE WHEN asked_id IS NOT NULL AND state IN ('running', 'queued')
            THEN TIMESTAMP '2024-02-01 00:00:00' END
FROM dag_run LEFT JOIN asked ON asked_id = dag_id""",
    "single_owner": """
WITH member AS (
  SELECT o_custkey, count(*) AS n, min(o_orderkey) AS one FROM orders
  WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' GROUP BY o_custkey)
SELECT c_custkey AS bundle, CAST(coalesce(n, 0) AS BIGINT) AS n_members,
       CASE WHEN n = 1 THEN concat('run_', CAST(one AS VARCHAR)) END AS owner_id,
       CASE WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status
FROM customer LEFT JOIN member ON o_custkey = c_custkey""",
    "newest_attempt": f"""
WITH {F2}
SELECT dag_id, run_id, task_id, state, attempt_id, attempt_ts, message
FROM ranked_attempt WHERE rn = 1""",
    "log_tail": f"WITH {F6} SELECT doc_id, line_no, line FROM doc_tail",
    "log_tail_whole_text": f"WITH {F6} SELECT doc_id, line_no, line FROM doc_tail",
    "failure_report": f"""
WITH {F2}, {F6}
SELECT t.dag_id, t.run_id, t.task_id, t.attempt_id, d.line_no,
       CASE WHEN d.doc_id IS NULL THEN '(no log file for this task)' ELSE d.line END AS line
FROM task_instance t LEFT JOIN doc_tail d ON d.doc_id = t.attempt_id
WHERE t.state = 'failed'""",
    "log_tree_report": f"""
WITH {F2}, {F6},
file AS (
  SELECT dag_id, run_id, task_id, max(attempt_id) AS attempt_id
  FROM task_attempt JOIN documents ON doc_id = attempt_id GROUP BY dag_id, run_id, task_id),
said AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS line_no, line FROM doc_tail)
SELECT t.dag_id, t.run_id, t.task_id, f.attempt_id, d.line_no,
       CASE WHEN f.attempt_id IS NULL THEN '(no log file for this task)' ELSE d.line END AS line
FROM task_instance t
     LEFT JOIN file f ON f.dag_id = t.dag_id AND f.run_id = t.run_id AND f.task_id = t.task_id
     LEFT JOIN said d ON d.doc_id = f.attempt_id
WHERE t.state = 'failed'""",
    "failed_run_report": f"""
WITH {F2}, {F6},
failed_run AS (SELECT DISTINCT dag_id, run_id FROM task_instance WHERE state = 'failed')
SELECT t.dag_id, t.run_id, t.task_id,
       CASE WHEN t.state IS NOT DISTINCT FROM 'failed' THEN 'FAILED' ELSE 'blocked' END AS label,
       CAST(CASE WHEN t.state IS NOT DISTINCT FROM 'failed' THEN 0 ELSE 1 END AS BIGINT) AS rank,
       CASE WHEN t.state = 'failed' THEN t.attempt_id END AS attempt_id, d.line_no,
       CASE WHEN d.doc_id IS NOT NULL THEN d.line
            WHEN t.state = 'failed' THEN '(no log file for this task)' END AS line
FROM task_instance t
     JOIN failed_run f ON f.dag_id = t.dag_id AND f.run_id = t.run_id
     LEFT JOIN doc_tail d ON t.state = 'failed' AND d.doc_id = t.attempt_id
WHERE t.state IS DISTINCT FROM 'success'""",
    "import_error_lines": f"""
WITH {F7},
kept AS (
  SELECT *, row_number() OVER (PARTITION BY dag_id ORDER BY line_no) AS rn FROM cli_line
  WHERE line <> 'No data found' AND line NOT LIKE 'filepath%'
    AND NOT regexp_matches(line, '^\\d{{4}}-\\d{{2}}-\\d{{2}}T'))
SELECT dag_id, line_no, line FROM kept WHERE rn < 6""",
    "non_empty": "WITH counted AS ("
    + " UNION ALL ".join(
        [f"SELECT '{t}' AS entity, count(*) AS n FROM {t}" for t in TABLES]
        + [
            f"SELECT 'events/{f}', count(*) FROM events WHERE event_type = '{f}'"
            for f in ("purchase", "refund")
        ]
    )
    + ") SELECT 'non_empty' AS gate, entity, 'no rows' AS detail FROM counted WHERE n = 0",
    "non_empty_groups": f"""
WITH {F3}, {F4}
SELECT 'non_empty' AS gate, dag_id AS entity, 'no rows' AS detail FROM dag
WHERE NOT EXISTS (SELECT 1 FROM dag_run r
                  WHERE r.dag_id = dag.dag_id AND r.state IN ('running', 'queued'))""",
    "accepted_values": """
SELECT 'accepted_values' AS gate, CAST(event_id AS VARCHAR) AS entity,
       concat('event_type=', coalesce(event_type, 'NULL')) AS detail
FROM events
WHERE event_type IS NULL OR event_type NOT IN ('view', 'click', 'signup', 'error')""",
    "required_keys": """
WITH needed AS (
  SELECT doc_id, 'quality' AS key FROM documents WHERE lang IN ('en', 'de')
  UNION ALL SELECT doc_id, 'clean' FROM documents WHERE lang IN ('en', 'fr')),
present AS (
  SELECT doc_id, 'quality' AS key FROM labels WHERE quality IS NOT NULL
  UNION ALL SELECT doc_id, 'clean' FROM labels WHERE toxic = 0)
SELECT 'required_keys' AS gate, CAST(n.doc_id AS VARCHAR) AS entity,
       concat('missing key ', n.key) AS detail
FROM needed n LEFT JOIN present p ON p.doc_id = n.doc_id AND p.key = n.key
WHERE p.key IS NULL""",
    "contract_check": f"""
WITH {F8},
found AS (
  SELECT 'lineitem.l_quantity' AS entity, 'type double instead of decimal(15,2)' AS t, 1 AS n
  UNION ALL SELECT 'lineitem.l_comment', 'missing column', 1
  UNION ALL SELECT 'lineitem.l_orderkey', 'null', count(*) FROM lineitem WHERE l_orderkey IS NULL
  UNION ALL SELECT 'lineitem.l_shipdate', 'null', count(*) FROM lineitem WHERE l_shipdate IS NULL
  UNION ALL SELECT 'lineitem.l_returnflag', 'value not accepted', count(*) FROM lineitem
    WHERE l_returnflag IS NULL OR l_returnflag NOT IN ('A', 'R')
  UNION ALL SELECT 'lineitem.l_linestatus', 'value not accepted', count(*) FROM lineitem
    WHERE l_linestatus IS NULL OR l_linestatus NOT IN ('O', 'F')
  UNION ALL SELECT 'lineitem.(l_orderkey, l_linenumber)', 'repeated key', count(*) FROM (
    SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) r
  UNION ALL SELECT 'fact.(l_orderkey, l_linenumber)', 'repeated key', count(*) FROM (
    SELECT 1 FROM fact GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) r
  UNION ALL SELECT 'fact.l_extendedprice', 'null', count(*) FROM fact
    WHERE l_extendedprice IS NULL OR l_discount IS NULL OR l_orderkey IS NULL
  UNION ALL SELECT 'fact.l_returnflag', 'value not accepted', count(*) FROM fact
    WHERE l_returnflag IS NULL OR l_returnflag NOT IN ('A', 'N', 'R'))
SELECT 'contract' AS gate, entity, concat(t, ': ', CAST(n AS VARCHAR)) AS detail
FROM found WHERE n > 0""",
    "term_scan": _scan("license", LICENSE_STEPS),
    "term_scan_token": _scan("token", "rest AS (SELECT *, code AS rest FROM code)"),
    "term_scan_scoped": _scan("license", SCOPED_STEPS),
    "term_scan_in_scope": f"""
WITH {F6},
code AS (
  SELECT l.path || '.' || d.lang AS path, line_no, line, string_split(line, '#')[1] AS code
  FROM doc_line l JOIN documents d ON d.doc_id = l.doc_id
  WHERE d.lang <> 'de' AND d.source NOT IN ('src1', 'src7')),
{LICENSE_STEPS}
SELECT path, line_no, left(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), 80) AS excerpt
FROM rest WHERE contains(lower(code), 'license') AND contains(lower(rest), 'license')""",
    "guard_selftest": f"""
WITH {F6},
code AS (SELECT path, line_no, line, string_split(line, '#')[1] AS code FROM doc_line),
{LICENSE_STEPS},
judged AS (
  SELECT path, line, contains(lower(line), 'license') AS mentions,
         contains(lower(line), 'apache') AS apache,
         contains(lower(code), 'license') AND contains(lower(rest), 'license') AS hit,
         left(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), 80) AS excerpt
  FROM rest)
SELECT 'guard' AS gate, path AS entity, concat('permits: ', excerpt) AS detail
FROM judged WHERE mentions AND NOT hit
UNION ALL
SELECT 'guard', path, concat('rejects: ', excerpt)
FROM judged WHERE (apache OR NOT mentions) AND hit""",
    "snapshot_compare": f"""
WITH {F8},
actual AS (
  SELECT *, 'run_b' AS run_id FROM ({_line_figures("lineitem")}) l
  UNION ALL SELECT *, 'run_b' FROM ({CUSTOMER_FIGURES}) c
  UNION ALL SELECT *, 'run_a' FROM ({ORDER_FIGURES}) o),
expected AS (
  {_line_figures("fact")} UNION ALL {ORDER_FIGURES}
  UNION ALL SELECT concat('suppliers/', CAST(s_nationkey AS VARCHAR)), count(*)
            FROM supplier GROUP BY s_nationkey)
{COMPARE}""",
    "compare_as_of": """
WITH actual AS (
  SELECT o_orderpriority AS metric, o_orderkey AS run_id, o_orderdate AS at,
         CAST(floor(o_totalprice / 100000) AS BIGINT) AS value FROM orders),
expected AS (
  SELECT o_orderpriority AS metric, o_orderdate AS valid_from,
         max(CAST(floor(o_totalprice / 100000) AS BIGINT)) AS value
  FROM orders WHERE o_orderkey % 10 = 0 AND o_orderstatus <> 'P' GROUP BY ALL)
SELECT a.metric, a.run_id, a.at, a.value AS actual_value, e.value AS expected_value, e.valid_from,
       CASE WHEN e.metric IS NULL THEN 'unexpected' WHEN a.value = e.value THEN 'match' ELSE 'differ' END AS status
FROM actual a ASOF LEFT JOIN expected e ON a.metric = e.metric AND a.at >= e.valid_from""",
    "parity_gate": f"""
WITH {F8},
d AS (
  SELECT l_orderkey, l_linenumber, l_extendedprice, count(*) FILTER (s = 1) - count(*) FILTER (s = 2) AS n
  FROM (SELECT l_orderkey, l_linenumber, l_extendedprice, 1 AS s FROM lineitem
        UNION ALL SELECT l_orderkey, l_linenumber, l_extendedprice, 2 FROM fact) u
  GROUP BY ALL)
SELECT 'schema' AS gate, 'l_tax' AS entity, 'l_tax is in the left table only' AS detail
UNION ALL SELECT 'schema', 'l_discount', 'l_discount is double on the left and float on the right'
UNION ALL
SELECT 'parity', CASE WHEN n > 0 THEN 'left' ELSE 'right' END,
       concat(CAST(sum(abs(n)) AS VARCHAR),
              ' rows on this side only, by l_orderkey, l_linenumber, l_extendedprice')
FROM d WHERE n <> 0 GROUP BY n > 0""",
    "parity_check": f"""
WITH {F8}
SELECT 'left' AS side, l_orderkey, l_linenumber, l_extendedprice, l_discount,
       CAST(count(*) AS BIGINT) AS copies
FROM (SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount FROM fact
      EXCEPT ALL
      SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount FROM fact
      WHERE l_linenumber <> 7) d
GROUP BY ALL""",
    "parity_check_raw": f"""
WITH {F8},
a AS (SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount FROM lineitem),
b AS (SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount FROM fact)
SELECT 'left' AS side, *, CAST(count(*) AS BIGINT) AS copies
FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) l GROUP BY ALL
UNION ALL
SELECT 'right', *, CAST(count(*) AS BIGINT)
FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) r GROUP BY ALL""",
    "landing_latest": """
SELECT event_id, ts, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
       CAST(NULL AS VARCHAR) AS _corrupt_record
FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events)""",
    "missing_landings": """
WITH landed AS (
  SELECT concat_ws('/', event_type, CAST(user_id % 40 AS VARCHAR)) AS feed, CAST(ts AS DATE) AS day,
         sum(CASE WHEN event_id % 5 < 3 THEN length(props) ELSE 0 END) AS size
  FROM events GROUP BY ALL),
spine AS (
  SELECT feed, CAST(unnest(generate_series(min(day), (SELECT max(day) FROM landed), INTERVAL 1 DAY)) AS DATE) AS day
  FROM landed GROUP BY feed),
gap AS (
  SELECT s.feed, s.day, CASE WHEN l.day IS NULL THEN 'absent' ELSE 'empty' END AS kind
  FROM spine s LEFT JOIN landed l ON l.feed = s.feed AND l.day = s.day
  WHERE l.day IS NULL OR l.size = 0),
island AS (
  SELECT *, date_diff('day', DATE '2000-01-01', day) - row_number() OVER (PARTITION BY feed, kind ORDER BY day) AS g
  FROM gap)
SELECT feed, kind, min(day) AS first_day, max(day) AS last_day, CAST(count(*) AS BIGINT) AS n_days
FROM island GROUP BY feed, kind, g""",
    "landing_json": """
SELECT event_id, user_id, event_type, value, CAST(ts AS DATE) AS landing_date,
       CAST(NULL AS VARCHAR) AS _corrupt_record
FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events)""",
    "cdc_apply": f"""
WITH {F5}
SELECT k, seq, op, event_type, value, ts
FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM change) t
WHERE rn = 1 AND op <> 'd'""",
    "silver_dedup": f"""
WITH {F8} SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount FROM fact""",
    "silver_stream": """
SELECT o_orderkey, o_custkey, o_orderdate AS at FROM orders""",
    "gold_revenue": f"""
WITH {F8}
SELECT r_name, n_name, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(sum({REVENUE}) AS BIGINT) AS revenue_cents
FROM fact JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
     JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY r_name, n_name""",
    "register_external": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, true AS registered, CAST(count(*) AS BIGINT) AS n_rows, "
        f"CAST(NULL AS VARCHAR) AS error FROM {t}"
        for t in TABLES[:8]
    ),
    "publish_snapshot": f"""
WITH {F8}
SELECT 'run_b' AS run_id, metric, value
FROM ({_line_figures("fact")} UNION ALL {ORDER_FIGURES} UNION ALL {CUSTOMER_FIGURES}) f""",
    "acceptance": f"""
WITH {F8},
actual AS (SELECT *, 'run_b' AS run_id
           FROM ({_line_figures("lineitem")} UNION ALL {ORDER_FIGURES}) f),
expected AS ({_line_figures("fact")} UNION ALL {ORDER_FIGURES})
{COMPARE}""",
}
ORACLE["cdc_stream"] = ORACLE["cdc_apply"]
ORACLE["gold_incremental"] = ORACLE["gold_revenue"]
ORACLE["parity_by_digest"] = ORACLE["parity_check_raw"]
