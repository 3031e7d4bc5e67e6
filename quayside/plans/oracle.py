"""The same queries as plain SQL over the given tables, for an independent engine.

Written from the semantics, not from the Spark plans: sequential rules are recursive, lookups are joins.
"""

from __future__ import annotations

from quayside.config import PROCESSING_SECONDS, SIZE_BYTES, Buckets

HOUR, DAY, MINUTE = 3_600_000_000, 86_400_000_000, 60_000_000
EPOCH = 1_704_067_200_000_000

FILES = f"""files AS (
  SELECT *, '/landing/' || source || '/' || filename AS path, octet_length(encode(text))::BIGINT AS length,
         lower(regexp_extract(filename, '\\.([^.]*)$', 1)) AS kind, {EPOCH} + doc_id * {MINUTE} AS arrived_us
  FROM (SELECT doc_id, lang, source, n_chars, text,
               lang || '_' || n_chars || (['.xml', '.XML', '.json', '.tmp', '.txt'])[(n_chars % 5)::INT + 1] AS filename
        FROM documents))"""
HASHED = FILES + ", hf AS (SELECT * EXCLUDE (text), sha256(filename || text) AS hash FROM files)"
LOG = HASHED + f""", log AS (
  SELECT doc_id, hash, 'enqueued' AS state, path, NULL::VARCHAR AS reason, arrived_us AS at_us FROM hf
  UNION ALL
  SELECT hf.doc_id, hash, CASE WHEN toxic = 1 THEN 'failed' ELSE 'processed' END, path,
         CASE WHEN toxic = 1 THEN 'toxic:' || hf.doc_id END, arrived_us + (n_chars % 600) * {MINUTE}
  FROM hf JOIN labels USING (doc_id))"""
CURRENT = LOG + """, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY hash, state ORDER BY at_us DESC, path DESC, reason DESC) AS rn FROM log),
current AS (
  SELECT hash, state, path, reason, at_us FROM ranked r WHERE rn = 1 AND NOT (state = 'enqueued' AND EXISTS (
    SELECT 1 FROM log d WHERE d.hash = r.hash AND d.state <> 'enqueued' AND d.at_us >= r.at_us)))"""
PROCESSED = HASHED + ", processed AS (SELECT doc_id, hash, arrived_us FROM hf WHERE doc_id IN (SELECT doc_id FROM labels))," \
    " unlabelled AS (SELECT * FROM hf WHERE doc_id NOT IN (SELECT doc_id FROM labels))"
CLASSIFIED = PROCESSED + """, named AS (
  SELECT *, CASE WHEN kind NOT IN ('xml', 'json') THEN 'pattern_mismatch'
                 WHEN length < 100 THEN 'file_too_small' WHEN length > 16384 THEN 'file_too_large' END AS cheap,
         hash IN (SELECT hash FROM processed) AS known
  FROM unlabelled),
raced AS (
  SELECT *, CASE WHEN cheap IS NULL AND NOT known THEN
      row_number() OVER (PARTITION BY hash, cheap IS NULL, known ORDER BY arrived_us, path, doc_id) END AS place
  FROM named),
classified AS (
  SELECT doc_id, filename, kind, length,
         coalesce(cheap, CASE WHEN known THEN 'duplicate' WHEN place > 1 THEN 'lock_held' ELSE 'accepted' END) AS reason
  FROM raced),
laned AS (
  SELECT *, CASE reason WHEN 'accepted' THEN 'processing' WHEN 'lock_held' THEN 'incoming' ELSE 'ignored' END AS lane
  FROM classified)"""
EVENTS = "ev AS (SELECT *, epoch_us(ts) AS us FROM events)"
FILE_EVENTS = EVENTS + """, fe AS (
  SELECT event_id, us, '/landing/u' || user_id AS path,
         CASE event_type WHEN 'click' THEN 'CREATE' WHEN 'view' THEN 'WRITE' WHEN 'purchase' THEN 'CHMOD'
                         WHEN 'signup' THEN 'RENAME' WHEN 'error' THEN 'REMOVE' END AS op FROM ev)"""
OUTCOMES = EVENTS + ", oc AS (SELECT event_id, us, user_id % 10 AS sink, event_type <> 'error' AS ok FROM ev)"
ATTEMPTS = EVENTS + f""", att AS (
  SELECT event_id, us, user_id, us // {DAY} AS day, event_type <> 'error' AS ok, 'publish:' || event_id AS error,
         row_number() OVER (PARTITION BY user_id, us // {DAY} ORDER BY us, event_id) AS rank FROM ev),
rollup AS (
  SELECT user_id, day, CASE WHEN bool_or(ok) THEN 'sent' WHEN count(*) >= 3 THEN 'failed' ELSE 'pending' END AS status,
         coalesce(min(rank) FILTER (ok), count(*))::BIGINT AS attempts,
         CASE WHEN NOT bool_or(ok) AND count(*) >= 3 THEN arg_max(error, rank) END AS last_error
  FROM att WHERE rank <= 3 GROUP BY ALL)"""
SAMPLES = EVENTS + f""", sm AS (
  SELECT '/landing/u' || user_id AS path, us, CASE WHEN event_id % 97 <> 0 THEN floor(value / 50) END AS size,
         us // {DAY} AS mtime, row_number() OVER w AS rank, min(us) OVER (PARTITION BY user_id) AS detected
  FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
cmp AS (
  SELECT *, coalesce(size = lag(size) OVER w AND mtime = lag(mtime) OVER w, FALSE) AS same
  FROM sm WHERE rank <= 5 WINDOW w AS (PARTITION BY path ORDER BY rank)),
agg AS (
  SELECT path, count(*) AS samples, min(rank) FILTER (size IS NULL) AS gone, min(rank) FILTER (same) AS at_rank,
         min(us) FILTER (same) - any_value(detected) AS took FROM cmp GROUP BY path),
verdict AS (
  SELECT *, at_rank IS NOT NULL AND (gone IS NULL OR gone > at_rank) AS settled FROM agg)"""
INTERVALS = """iv AS (
  SELECT o_orderkey, epoch_us(o_orderdate) AS submit_us, epoch_us(min(l_shipdate)) AS start_us,
         epoch_us(max(l_shipdate)) AS finish_us
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate)"""
PAGES = """pf AS (
  SELECT page_id, url, regexp_replace(regexp_replace(url, '^https?:/', ''), '/?([?#].*)?$', '') AS path FROM pages),
kept AS (SELECT path FROM pf WHERE NOT regexp_matches(url, '[?#]')),
dirs AS (
  SELECT DISTINCT array_to_string(parts[1:i], '/') AS path
  FROM (SELECT string_split(path, '/') AS parts FROM pf), unnest(range(2, len(parts))) AS t(i)),
guarded AS (SELECT path FROM dirs WHERE path LIKE '%/de')"""
LANE_FILES = FILES + f""", lf AS (
  SELECT doc_id, path, filename, kind, length, (['processed', 'failed', 'ignored', 'tmp'])[(doc_id % 4)::INT + 1] AS lane,
         {EPOCH} + doc_id * {HOUR} AS mtime_us FROM files)"""
DUE = LANE_FILES + f""", due AS (
  SELECT *, trunc(({EPOCH} + 7 * {DAY} - mtime_us) / {DAY})::BIGINT AS age_days FROM lf
  WHERE lane = 'tmp' OR (lane = 'processed' AND mtime_us < {EPOCH} + 6 * {DAY})
     OR (lane = 'failed' AND mtime_us < {EPOCH} + 4 * {DAY}))"""
COUNTERS = CLASSIFIED + """, counted AS (
  SELECT doc_id // 24 AS day,
    count(*) FILTER (reason <> 'pattern_mismatch') AS detected,
    count(*) FILTER (reason = 'accepted') AS sent,
    count(*) FILTER (reason = 'accepted') AS processed,
    count(*) FILTER (reason IN ('duplicate', 'lock_held')) AS duplicated,
    count(*) FILTER (reason IN ('file_too_small', 'file_too_large')) AS rejected,
    count(*) FILTER (reason IN ('pattern_mismatch', 'file_too_small', 'file_too_large', 'duplicate')) AS ignored,
    0::BIGINT AS watcher_errors, 0::BIGINT AS queue_errors,
    count(*) FILTER (doc_id % 50 = 0) AS storage_errors, 0::BIGINT AS rate_limit_waits,
    0::BIGINT AS rate_limit_dropped, 0::BIGINT AS empty_directories_removed
  FROM laned GROUP BY 1)"""
MESSAGE_OF = """
  SELECT doc_id, hash AS key, '{"id":"' || hash || '","path":"/landing/processing/' || filename || '","filename":"' || filename
      || '","kind":"' || kind || '","size":' || length || ',"hash":"' || hash || '","timestamp":"'
      || strftime(make_timestamp(arrived_us), '%Y-%m-%dT%H:%M:%S.%f') || 'Z"}' AS value FROM hf"""
MESSAGES = HASHED + f", msg AS (SELECT key, value FROM ({MESSAGE_OF}))"
RUNNING = EVENTS + f""", run AS (
  SELECT event_id, us, event_type, ts,
         count(*) OVER (PARTITION BY event_type, us // {DAY} ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS n
  FROM ev)"""
BREAKER = OUTCOMES + f""", seq AS (
  SELECT *, row_number() OVER (PARTITION BY sink ORDER BY us, event_id) AS rn FROM oc),
fold AS (
  SELECT sink, rn, event_id, us, 'executed' AS verdict, 'closed' AS st, CASE WHEN ok THEN 0 ELSE 1 END AS failures,
         0::BIGINT AS opened, NULL::BIGINT AS met, FALSE AS opens, FALSE AS probes FROM seq WHERE rn = 1
  UNION ALL
  SELECT s.sink, s.rn, s.event_id, s.us,
         CASE WHEN refused THEN 'short_circuited' ELSE 'executed' END,
         CASE WHEN refused THEN 'open' WHEN s.ok THEN 'closed' WHEN base + 1 >= 2 THEN 'open'
              WHEN f.st = 'open' THEN 'half-open' ELSE f.st END,
         CASE WHEN refused THEN f.failures WHEN s.ok THEN 0 ELSE base + 1 END,
         CASE WHEN NOT refused AND NOT s.ok AND base + 1 >= 2 THEN s.us ELSE f.opened END,
         CASE WHEN f.st = 'open' THEN f.opened END,
         NOT refused AND NOT s.ok AND base + 1 >= 2,
         f.st = 'open' AND NOT refused
  FROM (SELECT f.*, s.event_id AS nid, f.st = 'open' AND s.us - f.opened <= 2 * {HOUR} AS refused,
               CASE WHEN f.st = 'open' THEN 0 ELSE f.failures END AS base
        FROM fold f JOIN seq s ON s.sink = f.sink AND s.rn = f.rn + 1) f
  JOIN seq s ON s.event_id = f.nid)"""


def greedy(source: str, key: str, us: str, tie: str, gap: int, release: str = "FALSE") -> str:
    """CTEs ``seq`` and ``fold`` with ``accepted`` for rows at least ``gap`` after the last accepted one."""
    return f"""seq AS (
  SELECT {key} AS k, {us} AS us, {tie} AS id, {release} AS rel,
         row_number() OVER (PARTITION BY {key} ORDER BY {us}, {tie}) AS rn FROM {source}),
fold AS (
  SELECT k, rn, id, us, rel, CASE WHEN rel THEN NULL ELSE us END AS last, NOT rel AS accepted FROM seq WHERE rn = 1
  UNION ALL
  SELECT s.k, s.rn, s.id, s.us, s.rel,
         CASE WHEN s.rel THEN NULL WHEN f.last IS NULL OR s.us - f.last >= {gap} THEN s.us ELSE f.last END,
         NOT s.rel AND (f.last IS NULL OR s.us - f.last >= {gap})
  FROM fold f JOIN seq s ON s.k = f.k AND s.rn = f.rn + 1)"""


def bucket(source: str, key: str, us: str, tie: str, rate: int, period: int, burst: int, prefix: str = "") -> str:
    """CTEs ``{prefix}seq`` and ``{prefix}fold`` with ``admitted`` from a token bucket that starts full."""
    level = f"least({burst * period}, f.units + (s.us - f.us) * {rate})"
    return f"""{prefix}seq AS (
  SELECT {key} AS k, {us} AS us, {tie} AS id, row_number() OVER (PARTITION BY {key} ORDER BY {us}, {tie}) AS rn
  FROM {source}),
{prefix}fold AS (
  SELECT k, rn, id, us, {(burst - 1) * period}::BIGINT AS units, TRUE AS admitted FROM {prefix}seq WHERE rn = 1
  UNION ALL
  SELECT s.k, s.rn, s.id, s.us, {level} - CASE WHEN {level} >= {period} THEN {period} ELSE 0 END, {level} >= {period}
  FROM {prefix}fold f JOIN {prefix}seq s ON s.k = f.k AND s.rn = f.rn + 1)"""


def bounds(b: Buckets) -> str:
    return "[" + ", ".join(f"{x!r}::DOUBLE" for x in b.bounds()) + "]"


def histogram(source: str, value: str, b: Buckets, by: str, extra: str) -> str:
    group = f"{by}, " if by else ""
    return f"""SELECT {group}{extra}, i::INTEGER AS bucket,
  count(*) FILTER (i = {b.count} OR {value} <= ({bounds(b)})[i + 1]) AS cumulative_count, ({bounds(b)})[i + 1] AS le
  FROM (SELECT *, {'count(*) OVER (PARTITION BY ' + by + ')' if by else 'count(*) OVER ()'} AS n,
               {'sum(' + value + ') OVER (PARTITION BY ' + by + ')' if by else 'NULL'} AS s FROM {source}),
       unnest(range({b.count + 1})) AS t(i) GROUP BY ALL"""


def quantile(q: float, b: Buckets) -> str:
    """Scalar over a sorted list ``cum`` of cumulative counts."""
    at = f"list_position(list_transform(cum, lambda c: c >= {q} * n), TRUE)"
    return f"""round(CASE WHEN {at} > {b.count} THEN {b.bounds()[-1]!r}
      ELSE (CASE WHEN {at} = 1 THEN 0 ELSE bs[{at} - 1] END)
         + (bs[{at}] - (CASE WHEN {at} = 1 THEN 0 ELSE bs[{at} - 1] END))
         * ({q} * n - (CASE WHEN {at} = 1 THEN 0 ELSE cum[{at} - 1] END))
         / (cum[{at}] - (CASE WHEN {at} = 1 THEN 0 ELSE cum[{at} - 1] END)) END, 6)"""


def rule(name: str, bad: str, earlier: list[str]) -> str:
    first = " AND ".join(f"NOT ({e})" for e in earlier) or "TRUE"
    return f"""SELECT '{name}' AS rule, count(*) AS rows, count(*) FILTER ({first}) AS reported_first
  FROM customer WHERE {bad} HAVING count(*) > 0"""


_BAD = ["c_acctbal <= 0", "c_mktsegment = ''", "c_mktsegment = 'BUILDING' AND c_acctbal < 1000", "c_nationkey < 3"]
_NAMES = ["balance must be positive", "segment is required", "building needs a balance of 1000", "nation is not served"]

ORACLE: dict[str, str] = {
    "admission_summary": f"""WITH {CLASSIFIED} SELECT lane, reason, kind, count(*) AS files, sum(length)::BIGINT AS bytes
      FROM laned GROUP BY ALL""",
    "lane_routing": f"WITH {CLASSIFIED} SELECT doc_id, lane, reason FROM laned",
    "file_facts": f"""WITH {FILES} SELECT doc_id, filename, '/landing/' || source AS directory,
      regexp_extract(filename, '\\.[^.]*$') AS extension, kind, FALSE AS is_archive,
      '/landing/' || kind || '/' || filename AS target FROM files""",
    "content_hash": f"WITH {HASHED} SELECT doc_id, hash FROM hf",
    "event_op_filter": f"WITH {FILE_EVENTS} SELECT event_id, path, op FROM fe WHERE op IN ('CREATE', 'WRITE')",
    "event_log": f"WITH {FILE_EVENTS} SELECT event_id, path, op, us FROM fe",
    "pattern_filter": f"WITH {FILES} SELECT doc_id, filename FROM files WHERE kind IN ('xml', 'json')",
    "pattern_match_matrix": f"""WITH {FILES} SELECT doc_id, TRUE AS p0, kind = 'xml' AS p1, kind = 'xml' AS p2,
      FALSE AS p3, filename LIKE 'en\\_%.xml' ESCAPE '\\' AS p4,
      regexp_full_match(filename, 'e._.*[0-5]\\.json') AS p5,
      regexp_full_match(filename, 'fr_[^1-4].*\\.t.*') AS p6, FALSE AS p7, filename = 'en_380.xml' AS p8 FROM files""",
    "size_filter": f"""WITH {FILES} SELECT doc_id, length, CASE WHEN length < 100 THEN 'file_too_small'
      WHEN length > 16384 THEN 'file_too_large' ELSE 'ok' END AS verdict FROM files""",
    "sidecar_filter": """SELECT doc_id, doc_id % 7 IN (0, 1) AS dropped_by_event, doc_id % 7 = 0 AS dropped_by_scan
      FROM documents""",
    "rule_violations": " UNION ALL ".join(rule(n, b, _BAD[:i]) for i, (n, b) in enumerate(zip(_NAMES, _BAD))),
    "order_rule_violations": """SELECT o_orderkey, v[1] AS first_violation, array_to_string(v, '|') AS violations FROM (
      SELECT o_orderkey, list_filter([
        CASE WHEN o_orderstatus = 'F' AND o_totalprice < 50000 THEN 'finished orders need a price' END,
        CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'priority is required' END,
        CASE WHEN o_totalprice > 400000 THEN 'price is out of range' END], lambda x: x IS NOT NULL) AS v FROM orders)
      WHERE len(v) > 0""",
    "archive_members": """SELECT '/landing/batch/' || (doc_id // 25) || '.zip' AS archive,
        lang || '/' || doc_id || '.txt' AS member, '/landing/batch/' || lang || '/' || doc_id || '.txt' AS path,
        octet_length(encode(text))::BIGINT AS length, sha256(text) AS sha256, NULL::VARCHAR AS error
      FROM documents WHERE (doc_id // 25) % 10 <> 9
      UNION ALL
      SELECT DISTINCT '/landing/batch/' || (doc_id // 25) || '.zip', NULL, NULL, NULL, NULL, 'zip_extraction_failed'
      FROM documents WHERE (doc_id // 25) % 10 = 9""",
    "files_with_members": f"""WITH {FILES} SELECT kind, count(*) AS files, coalesce(sum(length), 0)::BIGINT AS bytes FROM (
        SELECT kind, length FROM files
        UNION ALL SELECT 'txt', length FROM files WHERE (doc_id // 25) % 10 <> 9
        UNION ALL (SELECT DISTINCT ON (doc_id // 25) 'failed', NULL FROM files WHERE (doc_id // 25) % 10 = 9))
      GROUP BY kind""",
    "archive_path_audit": """SELECT doc_id // 10 AS archive, count(*) AS members,
        count(*) FILTER (doc_id % 40 IN (7, 8)) AS escaping, bool_and(doc_id % 40 NOT IN (7, 8)) AS contained
      FROM documents GROUP BY 1""",
    "work_messages": f"WITH {MESSAGES} SELECT key, value FROM msg",
    "message_decode": f"""WITH {MESSAGES}, body AS (
        SELECT value FROM msg UNION ALL
        SELECT CASE WHEN event_id % 10 = 0 THEN '{{broken ' || props ELSE props END FROM events),
      parsed AS (SELECT json_valid(value) AS good, CASE WHEN json_valid(value) THEN value END::JSON AS j FROM body)
      SELECT NOT good AS undecodable, count(*) AS messages, count(j->>'$.path') AS with_path,
             count(j->>'$.queue') AS with_queue, coalesce(sum((j->>'$.size')::BIGINT), 0)::BIGINT AS bytes,
             coalesce(max(epoch_us((rtrim(j->>'$.timestamp', 'Z'))::TIMESTAMP)), 0) AS last_us
      FROM parsed GROUP BY good""",
    "schema_drift": f"""WITH {MESSAGES}, seen AS (
        SELECT field, count(*) AS n FROM (
          SELECT unnest(json_keys(value)) AS field FROM (SELECT value FROM msg UNION ALL SELECT props FROM events))
        GROUP BY field),
      wanted AS (SELECT unnest(['path', 'hash', 'size', 'timestamp', 'queue']) AS field)
      SELECT coalesce(s.field, w.field) AS field, coalesce(n, 0)::BIGINT AS messages,
             CASE WHEN s.field IS NULL THEN 'missing' WHEN w.field IS NULL THEN 'unexpected' ELSE 'expected' END AS status
      FROM seen s FULL JOIN wanted w ON s.field = w.field""",
    "attempt_rollup": f"WITH {ATTEMPTS} SELECT * FROM rollup",
    "dead_letters": f"WITH {ATTEMPTS} SELECT user_id, day, attempts, last_error FROM rollup WHERE status = 'failed'",
    "retry_schedule": f"""WITH {OUTCOMES} SELECT event_id, a::INTEGER AS attempt,
        us + (CASE a WHEN 1 THEN 0 WHEN 2 THEN 1000 ELSE 3000 END) * 1000 AS planned_us
      FROM oc, unnest([1, 2, 3]) AS t(a) WHERE NOT ok""",
    "ledger_current": f"WITH {CURRENT} SELECT * FROM current",
    "ledger_live": f"""WITH {CURRENT}, e AS (
        SELECT *, at_us + CASE state WHEN 'enqueued' THEN 6 ELSE 9 END * {HOUR} AS expires_us FROM current)
      SELECT hash, state, at_us, expires_us FROM e WHERE at_us <= {EPOCH + 12 * HOUR} AND expires_us > {EPOCH + 12 * HOUR}""",
    "new_files_anti": f"""WITH {PROCESSED} SELECT doc_id, hash FROM unlabelled
      WHERE hash NOT IN (SELECT hash FROM processed)""",
    "duplicates_semi": f"WITH {PROCESSED} SELECT doc_id, hash FROM unlabelled WHERE hash IN (SELECT hash FROM processed)",
    "ttl_dedup_join": f"""WITH {PROCESSED} SELECT u.doc_id, max(p.arrived_us) AS last_at_us,
        coalesce(bool_or(u.arrived_us < p.arrived_us + 6 * {HOUR}), FALSE) AS is_duplicate
      FROM unlabelled u LEFT JOIN processed p ON p.hash = u.hash AND p.arrived_us <= u.arrived_us GROUP BY u.doc_id""",
    "orphan_replay": f"""WITH {PROCESSED} SELECT doc_id, '/landing/incoming/' || filename AS replay_path FROM hf
      WHERE kind <> 'tmp' AND hash NOT IN (SELECT hash FROM processed)""",
    "orphan_replay_all": f"""WITH {FILES} SELECT doc_id, '/landing/incoming/' || filename AS replay_path FROM files
      WHERE kind <> 'tmp'""",
    "ledger_lifecycle": f"""WITH {LOG}, g AS (
        SELECT hash, min(at_us) FILTER (state = 'enqueued') AS enqueued_us,
               max(at_us) FILTER (state <> 'enqueued') AS completed_us,
               arg_max(state, at_us) FILTER (state <> 'enqueued') AS final FROM log GROUP BY hash)
      SELECT hash, enqueued_us, completed_us, CASE WHEN final IS NOT NULL THEN final
          WHEN {EPOCH + 12 * HOUR} - enqueued_us > 6 * {HOUR} THEN 'stuck' ELSE 'enqueued' END AS outcome,
        completed_us - enqueued_us AS latency_us FROM g""",
    "failed_reason_unpack": f"""WITH {EVENTS} SELECT event_id,
        (us // 1000000) || ':' || event_type || ':' || user_id AS packed, us // 1000000 AS epoch,
        event_type || ':' || user_id AS reason FROM ev""",
    "single_winner": f"""WITH {HASHED} SELECT doc_id, hash,
        row_number() OVER (PARTITION BY hash ORDER BY arrived_us, path, doc_id) = 1 AS wins FROM hf""",
    "lane_collisions": f"""WITH {LANE_FILES} SELECT lane, filename,
        arg_max(path || '#' || doc_id, mtime_us) AS survivor, count(*) - 1 AS overwritten FROM lf GROUP BY ALL""",
    "debounce": f"""WITH RECURSIVE {FILE_EVENTS}, {greedy('fe', 'path', 'us', 'event_id', 6 * HOUR)}
      SELECT id AS event_id, k AS path, us FROM fold WHERE accepted""",
    "lease_grants": f"""WITH RECURSIVE {FILE_EVENTS}, {greedy('fe', 'path', 'us', 'event_id', 30 * HOUR, "op = 'REMOVE'")}
      SELECT id AS event_id, rel AS release, accepted AS granted FROM fold""",
    "rate_admission": f"""WITH RECURSIVE {EVENTS}, {bucket('ev', 'event_type', 'us', 'event_id', 2, HOUR, 2)}
      SELECT id AS event_id, admitted FROM fold""",
    "global_rate_admission": f"""WITH RECURSIVE {EVENTS}, {bucket('ev', '1', 'us', 'event_id', 10, HOUR, 10)}
      SELECT id AS event_id, admitted FROM fold""",
    "event_admission_all": f"""WITH RECURSIVE {HASHED}, {SAMPLES}, processed AS (
        SELECT hash FROM hf WHERE doc_id IN (SELECT doc_id FROM labels)),
      noticed AS (
        SELECT e.event_id, e.us, '/landing/u' || e.user_id AS watched, coalesce(h.path, '/landing/u' || e.user_id) AS path,
               h.source, h.length, coalesce(h.kind, '') AS kind, h.hash
        FROM ev e LEFT JOIN hf h ON h.doc_id = e.event_id % (SELECT greatest(count(*), 1) FROM hf)
        WHERE e.event_type IN ('click', 'view')),
      {greedy('noticed', 'path', 'us', 'event_id', 5 * HOUR)},
      judged AS (
        SELECT n.*, CASE WHEN kind NOT IN ('xml', 'json') THEN 'pattern_mismatch'
                         WHEN NOT coalesce(settled AND took < 20 * {DAY}, FALSE) THEN 'file_not_stable' END AS early,
               n.us + CASE WHEN settled AND took < 20 * {DAY} THEN took ELSE 0 END AS ready_us
        FROM noticed n JOIN fold ON fold.id = n.event_id AND fold.accepted LEFT JOIN verdict v ON v.path = n.watched),
      queued AS (SELECT * FROM judged WHERE early IS NULL),
      {bucket('queued', 'source', 'ready_us', 'event_id', 1, 24 * HOUR, 2, 'l')},
      checked AS (
        SELECT q.*, CASE WHEN NOT admitted THEN 'rate_limit_exceeded' WHEN length < 100 THEN 'file_too_small'
                         WHEN length > 16384 THEN 'file_too_large'
                         WHEN q.hash IN (SELECT hash FROM processed) THEN 'duplicate' END AS late
        FROM queued q JOIN lfold ON lfold.id = q.event_id),
      final AS (
        SELECT event_id, ready_us, early AS reason FROM judged WHERE early IS NOT NULL
        UNION ALL SELECT event_id, ready_us, late FROM checked WHERE late IS NOT NULL
        UNION ALL SELECT event_id, ready_us, CASE WHEN row_number() OVER (
            PARTITION BY hash ORDER BY ready_us, path, event_id) = 1 THEN 'accepted' ELSE 'lock_held' END
        FROM checked WHERE late IS NULL)
      SELECT event_id, ready_us, reason, CASE reason WHEN 'accepted' THEN 'processing' WHEN 'lock_held' THEN 'incoming'
        ELSE 'ignored' END AS lane FROM final""",
    "fixed_window_cap": f"""WITH {EVENTS} SELECT * FROM (
        SELECT event_id, event_type, us // {HOUR} AS window,
               row_number() OVER (PARTITION BY event_type, us // {HOUR} ORDER BY us, event_id)::INTEGER AS rank FROM ev)
      WHERE rank <= 2""",
    "breaker_verdicts": f"""WITH RECURSIVE {BREAKER} SELECT event_id, verdict, st AS state_after,
        failures::INTEGER AS failures_after FROM fold""",
    "breaker_episodes": f"""WITH RECURSIVE {BREAKER} SELECT o.sink, o.us AS opened_us,
        count(m.event_id) FILTER (m.verdict = 'short_circuited') AS refused,
        max(m.us) FILTER (m.probes) AS probed_us
      FROM (SELECT * FROM fold WHERE opens) o LEFT JOIN fold m ON m.sink = o.sink AND m.met = o.us GROUP BY ALL""",
    "ttl_dedup": f"""WITH RECURSIVE {HASHED}, {greedy('hf', 'hash', 'arrived_us', 'doc_id', 5 * HOUR)}
      SELECT id AS doc_id, accepted FROM fold""",
    "stability_verdict": f"""WITH {SAMPLES} SELECT path, samples, settled AND took < 2 * {DAY} AS stable,
        CASE WHEN settled AND took < 2 * {DAY} THEN at_rank END::INTEGER AS stable_at_sample,
        CASE WHEN NOT coalesce(settled AND took < 2 * {DAY}, FALSE) THEN 'file_not_stable' END AS reason FROM verdict""",
    "stability_duration": f"WITH {SAMPLES} SELECT path, took AS duration_us FROM verdict WHERE settled AND took < 30 * {DAY}",
    "outcome_counters_daily": f"WITH {COUNTERS} SELECT * FROM counted",
    "success_rate": f"""WITH {COUNTERS} SELECT day,
        CASE WHEN detected > 0 THEN round(100.0::DOUBLE * sent / detected, 1) ELSE 0.0::DOUBLE END AS success_rate,
        sent + duplicated + rejected AS total FROM counted""",
    "size_histogram": f"WITH {FILES} " + histogram("files", "length", SIZE_BYTES, "lang", "s::BIGINT AS total, n AS observations"),
    "duration_histogram": f"WITH d AS (SELECT value / 10 AS seconds FROM events) "
                          + histogram("d", "seconds", PROCESSING_SECONDS, "", "n AS observations"),
    "histogram_quantiles": f"""WITH d AS (SELECT event_type, value / 10 AS seconds FROM events), h AS (
        SELECT event_type, i, count(*) FILTER (i = 15 OR seconds <= ({bounds(PROCESSING_SECONDS)})[i + 1]) AS c
        FROM d, unnest(range(16)) AS t(i) GROUP BY ALL),
      g AS (SELECT event_type, list(c ORDER BY i) AS cum, max(c) AS n, {bounds(PROCESSING_SECONDS)} AS bs
            FROM h GROUP BY event_type)
      SELECT event_type, {quantile(0.5, PROCESSING_SECONDS)} AS p50, {quantile(0.95, PROCESSING_SECONDS)} AS p95,
             {quantile(0.99, PROCESSING_SECONDS)} AS p99 FROM g""",
    "counter_rate": f"""WITH {RUNNING}, d AS (
        SELECT *, CASE WHEN lag(n) OVER w IS NULL THEN 0 WHEN n < lag(n) OVER w THEN n ELSE n - lag(n) OVER w END AS delta
        FROM run WINDOW w AS (PARTITION BY event_type ORDER BY us, event_id))
      SELECT event_id AS sample_id, event_type AS name, round(
          (sum(delta) OVER f - first_value(delta) OVER f)::DOUBLE / nullif((us - first_value(us) OVER f) / 1000000.0, 0), 9)
        AS rate
      FROM d WINDOW f AS (PARTITION BY event_type ORDER BY us RANGE BETWEEN 6 * {HOUR} PRECEDING AND CURRENT ROW)""",
    "daily_running_counter": f"""WITH {RUNNING} SELECT event_id, event_type,
        epoch_us((date_trunc('day', ts) + INTERVAL 1 DAY)::TIMESTAMP) AS resets_us, n AS running_count FROM run""",
    "reset_epoch_counter": f"""WITH {EVENTS}, ep AS (
        SELECT *, user_id % 10 AS instance, count(*) FILTER (event_type = 'signup') OVER (
            PARTITION BY user_id % 10 ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS epoch FROM ev)
      SELECT event_id, instance, event_type, epoch, count(*) OVER (
          PARTITION BY instance, epoch, event_type ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS running_count
      FROM ep WHERE event_type <> 'signup'""",
    "concurrency_gauge": f"""WITH {INTERVALS}, c AS (
        SELECT us, sum(d)::BIGINT AS change FROM (
          SELECT start_us AS us, 1 AS d FROM iv UNION ALL SELECT finish_us, -1 FROM iv) GROUP BY us)
      SELECT us, change, (sum(change) OVER (ORDER BY us))::BIGINT AS open FROM c""",
    "backlog_gauge": f"""WITH {INTERVALS}, c AS (
        SELECT us, sum(d) AS change FROM (
          SELECT submit_us AS us, 1 AS d FROM iv WHERE start_us >= submit_us
          UNION ALL SELECT start_us, -1 FROM iv WHERE start_us >= submit_us) GROUP BY us),
      g AS (SELECT us, sum(change) OVER (ORDER BY us) AS open FROM c),
      days AS (SELECT unnest(range((SELECT min(us) // {DAY} FROM c), (SELECT max(us) // {DAY} FROM c) + 1)) AS day),
      levels AS (SELECT us // {DAY} AS day, open FROM g
        UNION ALL SELECT day, coalesce((SELECT sum(change) FROM c WHERE us <= day * {DAY}), 0) FROM days)
      SELECT day, max(open)::BIGINT AS peak FROM levels GROUP BY day""",
    "windowed_outcomes": f"""WITH {EVENTS} SELECT us // (6 * {HOUR}) * (6 * {HOUR}) AS window_us,
        count(*) FILTER (event_type IN ('click', 'view')) AS detected,
        count(*) FILTER (event_type = 'purchase') AS processed,
        count(*) FILTER (event_type = 'signup') AS rejected,
        count(*) FILTER (event_type = 'error') AS errors FROM ev GROUP BY 1""",
    "distinct_content": f"""WITH {HASHED} SELECT kind, count(*) AS files, count(DISTINCT hash) AS contents
      FROM hf GROUP BY kind""",
    "exposition_parse": """WITH l AS (
        SELECT event_id, CASE event_id % 8 WHEN 0 THEN '# HELP x ' || event_type WHEN 1 THEN '  '
          WHEN 2 THEN 'x_total 1.5e+0' || (event_id % 7) WHEN 3 THEN 'x_bucket{le="0.1"} ' || event_id
          ELSE event_type || '_total ' || event_id || '.25' END AS line FROM events)
      SELECT event_id, 'strict' AS grammar, regexp_extract(line, '^([a-z_]+)\\s+(\\d+\\.?\\d*)', 1) AS name,
             regexp_extract(line, '^([a-z_]+)\\s+(\\d+\\.?\\d*)', 2)::DOUBLE AS value, '' AS labels
      FROM l WHERE event_id % 8 NOT IN (0, 1, 3)
      UNION ALL
      SELECT event_id, 'full', CASE event_id % 8 WHEN 2 THEN 'x_total' WHEN 3 THEN 'x_bucket'
               ELSE split_part(line, ' ', 1) END,
             split_part(line, ' ', 2)::DOUBLE, CASE WHEN event_id % 8 = 3 THEN '{le="0.1"}' ELSE '' END
      FROM l WHERE event_id % 8 NOT IN (0, 1)""",
    "health_rollup": f"""WITH {OUTCOMES}, g AS (
        SELECT sink, avg(CASE WHEN ok THEN 0 ELSE 1 END) < 0.2 AS a, count(*) > 10 AS b, arg_max(ok, row(us, event_id)) AS c
        FROM oc GROUP BY sink)
      SELECT sink, CASE WHEN a AND b AND c THEN 'healthy' ELSE 'degraded' END AS status, t.name AS "check", t.result
      FROM g, LATERAL (VALUES ('errors', CASE WHEN a THEN 'ok' ELSE 'too many errors' END),
                              ('traffic', CASE WHEN b THEN 'ok' ELSE 'no traffic' END),
                              ('last_call', CASE WHEN c THEN 'ok' ELSE 'last call failed' END)) AS t(name, result)""",
    "path_list_explode": """SELECT doc_id, (i - 1)::INTEGER AS position, (['/in', source, lang])[i] AS path
      FROM documents, unnest([1, 2, 3]) AS t(i)""",
    "retention_candidates": f"WITH {DUE} SELECT doc_id, lane, age_days FROM due",
    "cleanup_summary": f"WITH {DUE} SELECT lane, count(*) AS files, sum(length)::BIGINT AS bytes FROM due GROUP BY lane",
    "lane_census": f"WITH {LANE_FILES} SELECT lane, count(*) FILTER (kind <> 'tmp') AS files FROM lf GROUP BY lane",
    "empty_directories": f"""WITH {PAGES} SELECT path FROM dirs d WHERE path NOT IN (SELECT path FROM guarded)
      AND NOT EXISTS (SELECT 1 FROM (SELECT path FROM dirs UNION ALL SELECT path FROM kept) e
                      WHERE regexp_replace(e.path, '/[^/]*$', '') = d.path)""",
    "empty_directory_closure": f"""WITH {PAGES}, gone AS (
        SELECT path FROM dirs d WHERE NOT EXISTS (
          SELECT 1 FROM (SELECT path FROM kept UNION ALL SELECT path FROM guarded UNION ALL
                         SELECT path || '/x' FROM guarded) k WHERE starts_with(k.path, d.path || '/')))
      SELECT a.path, (max(len(string_split(b.path, '/'))) - any_value(len(string_split(a.path, '/'))) + 1)::BIGINT
          AS removed_in_pass
      FROM gone a JOIN gone b ON b.path = a.path OR starts_with(b.path, a.path || '/') GROUP BY a.path""",
    "protected_dirs": f"""WITH {PAGES}, hosts AS (SELECT DISTINCT '/' || split_part(path, '/', 2) AS path FROM pf)
      SELECT path FROM hosts UNION SELECT path || '/' || lane FROM hosts,
        unnest(['processing', 'processed', 'failed', 'ignored', 'tmp']) AS t(lane)""",
    "missing_lanes": """WITH seen AS (SELECT DISTINCT source || '/' || lang AS root,
          (['processing', 'processed', 'failed', 'ignored', 'tmp'])[(n_chars % 5)::INT + 1] AS lane FROM documents)
      SELECT root, lane FROM (SELECT DISTINCT root FROM seen),
        unnest(['processing', 'processed', 'failed', 'ignored', 'tmp']) AS t(lane)
      EXCEPT SELECT root, lane FROM seen""",
}

# A stream gives the batch result row for row.
for _name in ("debounce", "rate_admission", "breaker_verdicts", "lease_grants", "ttl_dedup"):
    ORACLE[f"{_name}_stream"] = ORACLE[_name]
ORACLE["windowed_outcomes_stream"] = ORACLE["windowed_outcomes"]
ORACLE["event_admission_stream"] = ORACLE["event_admission_all"]
ORACLE["ledger_lifecycle_stream"] = ORACLE["ledger_lifecycle"]

# The store is asked as of its newest entry.
_STORED = f"""{CURRENT}, stored AS (
        SELECT *, at_us + CASE state WHEN 'enqueued' THEN 6 ELSE 9 END * {HOUR} AS expires_us, (SELECT max(at_us) FROM log) AS newest
        FROM current)"""
ORACLE["ledger_store_live"] = f"""WITH {_STORED} SELECT hash, state, at_us, expires_us FROM stored WHERE expires_us > newest"""
ORACLE["ledger_store_lookup"] = f"""WITH {_STORED} SELECT hash, state, at_us FROM stored
      WHERE expires_us > newest AND hash IN (SELECT hash FROM log WHERE at_us > newest - 2 * {HOUR})"""

_PUBLISHED = CLASSIFIED + f""", hf_msg AS (SELECT doc_id, octet_length(encode(value)) AS bytes FROM ({MESSAGE_OF}) m),
      published AS (
        SELECT l.*, reason = 'accepted' AND bytes > 281 AS refused FROM laned l JOIN hf_msg USING (doc_id)),
      final AS (
        SELECT doc_id, kind, CASE WHEN refused THEN 'failed' ELSE lane END AS lane,
               CASE WHEN refused THEN 'queue_error: message_too_large' ELSE reason END AS reason FROM published)"""
ORACLE["admission_published"] = f"WITH {_PUBLISHED} SELECT doc_id, lane, reason FROM final"
ORACLE["outcome_counters_published"] = f"""WITH {_PUBLISHED} SELECT kind,
        count(*) FILTER (reason <> 'pattern_mismatch') AS detected, count(*) FILTER (reason = 'accepted') AS sent,
        count(*) FILTER (starts_with(reason, 'queue_error')) AS queue_errors,
        count(*) FILTER (reason IN ('duplicate', 'lock_held')) AS duplicated,
        count(*) FILTER (reason IN ('file_too_small', 'file_too_large')) AS rejected,
        count(*) FILTER (reason IN ('pattern_mismatch', 'file_too_small', 'file_too_large', 'duplicate')) AS ignored
      FROM final GROUP BY kind"""
ORACLE["publish_audit"] = f"""WITH {MESSAGES}, m AS (
        SELECT value, json_extract_string(value, '$.kind') AS kind, octet_length(encode(value)) AS n,
               CASE WHEN octet_length(encode(value)) > 281 THEN 'message_too_large' END AS error FROM msg)
      SELECT kind, error, count(*) AS messages, sum(n)::BIGINT AS bytes, count(*) AS attempts FROM m GROUP BY ALL"""
ORACLE["sliding_quantiles"] = f"""WITH {EVENTS}, o AS (
        SELECT event_id, us, event_type, us // {DAY} AS day, i, (i = 15 OR value / 10 <= ({bounds(PROCESSING_SECONDS)})[i + 1])::INT AS hit
        FROM ev, unnest(range(16)) AS t(i)),
      c AS (SELECT *, sum(hit) OVER (PARTITION BY event_type, day, i ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS c FROM o),
      d AS (SELECT *, CASE WHEN lag(c) OVER w IS NULL THEN 0 WHEN c < lag(c) OVER w THEN c ELSE c - lag(c) OVER w END AS gain
            FROM c WINDOW w AS (PARTITION BY event_type, i ORDER BY us, event_id)),
      s AS (SELECT *, sum(gain) OVER (PARTITION BY event_type, i ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS s FROM d),
      r AS (SELECT event_id, i, (s - min(s) OVER (PARTITION BY event_type, i ORDER BY us
                                 RANGE BETWEEN {6 * HOUR} PRECEDING AND CURRENT ROW))::DOUBLE AS x FROM s),
      g AS (SELECT event_id, list(x ORDER BY i) AS cum, max(x) AS n, {bounds(PROCESSING_SECONDS)} AS bs FROM r GROUP BY event_id)
      SELECT event_id AS sample_id, CASE WHEN n > 0 THEN {quantile(0.5, PROCESSING_SECONDS)} END AS p50,
             CASE WHEN n > 0 THEN {quantile(0.95, PROCESSING_SECONDS)} END AS p95,
             CASE WHEN n > 0 THEN {quantile(0.99, PROCESSING_SECONDS)} END AS p99 FROM g"""
ORACLE["trailing_contents"] = f"""WITH {HASHED}, h AS (SELECT kind, arrived_us // {HOUR} AS hour, hash FROM hf),
      u AS (SELECT DISTINCT kind, unnest(range(hour, hour + 4)) AS until FROM h)
      SELECT u.kind, u.until, count(*) AS files, count(DISTINCT hash) AS contents, TRUE AS estimate_holds
      FROM u JOIN h ON h.kind = u.kind AND h.hour BETWEEN u.until - 3 AND u.until GROUP BY ALL"""
ORACLE["dry_run"] = f"""WITH {MESSAGES} SELECT count(*) AS messages, coalesce(sum(octet_length(encode(value))), 0)::BIGINT AS bytes FROM msg"""
ORACLE["lane_folders"] = f"""WITH {CLASSIFIED} SELECT lane, count(*) AS files, sum(length)::BIGINT AS bytes,
        count(*) FILTER (reason <> 'accepted') AS with_reason FROM laned GROUP BY lane"""
ORACLE["counters_of_all_stages"] = f"""WITH {_PUBLISHED}, c AS (SELECT
          count(*) FILTER (reason <> 'pattern_mismatch') AS detected, count(*) FILTER (reason = 'accepted') AS sent,
          count(*) FILTER (reason = 'accepted') AS processed,
          count(*) FILTER (reason IN ('duplicate', 'lock_held')) AS duplicated,
          count(*) FILTER (reason IN ('file_too_small', 'file_too_large')) AS rejected,
          count(*) FILTER (reason IN ('pattern_mismatch', 'file_too_small', 'file_too_large', 'duplicate')) AS ignored,
          count(*) FILTER (starts_with(reason, 'queue_error')) AS queue_errors FROM final)
      SELECT detected, sent, processed, duplicated, rejected, ignored,
        (SELECT count(DISTINCT doc_id // 25) FROM documents WHERE doc_id // 25 % 10 = 9) AS watcher_errors, queue_errors,
        0::BIGINT AS storage_errors, 0::BIGINT AS rate_limit_waits, 0::BIGINT AS rate_limit_dropped,
        (SELECT count(*) FROM ({ORACLE['empty_directory_closure']})) AS empty_directories_removed FROM c"""
ORACLE["consumed_messages"] = f"""WITH {FILES} SELECT kind, count(*) AS messages, count(DISTINCT filename) AS names,
        sum(length)::BIGINT AS bytes FROM files GROUP BY kind"""
