"""SQL for the registered queries, computed from the source columns.

Nothing is decoded here: signals come from the columns that the frames were
packed from, so packing and decoding are checked independently.
"""

from __future__ import annotations

from buslens.plans.live_queries import LEAST_SECONDS, MOST_AGE
from buslens.plans.more_queries import ODD_LIMIT, TIME_RANGE, VALUE_RANGE
from buslens.plans.queries import DURATION, FRAME_LIMIT, RULES

FRAMES = """
src AS (
  SELECT event_id AS seq, ts, strftime(ts, '%Y-%m-%d') AS capture_id,
         epoch_us(ts) / 1e6 AS "timestamp", epoch_us(ts) AS ts_micros,
         CASE event_type WHEN 'click' THEN 256 WHEN 'view' THEN 512 WHEN 'purchase' THEN 291
              WHEN 'error' THEN 1110 WHEN 'signup' THEN 419385573 END::BIGINT AS can_id_dec,
         CASE WHEN event_type = 'error' THEN 4 ELSE 8 END AS dlc,
         CAST(round(value * 100) AS BIGINT) & 65535 AS v,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) & 255 AS k,
         user_id & 65535 AS u,
         event_id * 7 % 20001 - 10000 AS t,
         event_id & 1 AS sel, event_id & 255 AS low
  FROM events),
bytes AS (
  SELECT *, [v & 255, v >> 8, k, u >> 8, u & 255, t & 255, (t & 65535) >> 8, low] AS eight FROM src),
frames AS (
  SELECT *, printf('0x%03X', can_id_dec) AS can_id, eight[1:dlc] AS bytes,
         array_to_string(list_transform(eight[1:dlc], lambda b: printf('%02X', b)), ' ') AS data_hex,
         can_id_dec > 2047 AS is_extended
  FROM bytes)"""

SIGNALS = """
signals AS (
  SELECT capture_id, seq, "timestamp", ts, can_id_dec, 'Value' AS signal, 0 AS place,
         v * 0.01::DOUBLE + 0.0::DOUBLE AS value, NULL::VARCHAR AS label
  FROM frames WHERE can_id_dec IN (256, 1110)
  UNION ALL
  SELECT capture_id, seq, "timestamp", ts, can_id_dec, 'K', 1, k::DOUBLE - 40, NULL FROM frames WHERE can_id_dec = 256
  UNION ALL
  SELECT capture_id, seq, "timestamp", ts, can_id_dec, 'UserId', 0, u::DOUBLE, NULL FROM frames WHERE can_id_dec = 512
  UNION ALL
  SELECT capture_id, seq, "timestamp", ts, can_id_dec, 'Trim', 1, t * 0.1::DOUBLE + 0.0::DOUBLE, NULL
  FROM frames WHERE can_id_dec = 512
  UNION ALL
  SELECT capture_id, seq, "timestamp", ts, can_id_dec, 'Sel', 0, sel::DOUBLE, CASE sel WHEN 0 THEN 'even' ELSE 'odd' END
  FROM frames WHERE can_id_dec = 291
  UNION ALL
  SELECT capture_id, seq, "timestamp", ts, can_id_dec, 'Value', 1, v * 0.01::DOUBLE + 0.0::DOUBLE, NULL
  FROM frames WHERE can_id_dec = 291 AND sel = 0
  UNION ALL
  SELECT capture_id, seq, "timestamp", ts, can_id_dec, 'Trim', 2, t * 0.1::DOUBLE + 0.0::DOUBLE, NULL
  FROM frames WHERE can_id_dec = 291 AND sel = 1)"""

TEXTS = """
cells AS (
  SELECT seq, place, signal,
         coalesce(label, CASE WHEN signal IN ('K', 'UserId', 'Sel') THEN CAST(value::BIGINT AS VARCHAR)
                              ELSE CAST(value AS VARCHAR) END) AS text
  FROM signals),
texts AS (
  SELECT seq, string_agg(signal || '=' || text, ',' ORDER BY place) AS parsed,
         string_agg(signal || '=' || text, ' | ' ORDER BY place) AS shown,
         string_agg(signal || '=' || text, ',' ORDER BY signal) AS by_name
  FROM cells GROUP BY seq)"""

LINES = """
lines AS (
  SELECT f.capture_id, f.seq, f.can_id_dec,
         strftime(f.ts, '%H:%M:%S.') || printf('%03d', (f.ts_micros // 1000) % 1000) || ' | ID: ' || f.can_id
           || ' | DLC: ' || f.dlc || ' | Data: ' || f.data_hex || coalesce(' | Signals: ' || x.shown, '') AS tail,
         f."timestamp"
  FROM frames f LEFT JOIN texts x USING (seq))"""

TWICE = """
twice AS (
  SELECT capture_id, seq, "timestamp", can_id_dec, can_id, dlc, bytes, data_hex FROM frames
  UNION ALL
  SELECT capture_id, seq + 1000000000, "timestamp", can_id_dec, can_id, dlc, bytes, data_hex
  FROM frames WHERE can_id_dec = 1110)"""

GAPS = """
cycles AS (SELECT * FROM (VALUES (256, 100), (512, 100), (291, 20)) AS c(can_id_dec, cycle_time_ms)),
steps AS (
  SELECT capture_id, can_id_dec, seq, "timestamp", cycle_time_ms,
         lag(seq) OVER w AS previous_seq, lag("timestamp") OVER w AS previous_timestamp
  FROM frames JOIN cycles USING (can_id_dec)
  WINDOW w AS (PARTITION BY capture_id, can_id_dec ORDER BY "timestamp", seq)),
gaps AS (
  SELECT *, "timestamp" - previous_timestamp AS gap_seconds FROM steps
  WHERE "timestamp" - previous_timestamp > cycle_time_ms / 1000.0::DOUBLE * 1.5::DOUBLE)"""

# Unbroken spans of a cyclic message, those that the watermark has closed.
SPANS = """
starts AS (
  SELECT f.capture_id, f.can_id_dec, f.seq, f."timestamp", f.ts_micros, c.cycle_time_ms,
         CASE WHEN f.ts_micros - lag(f.ts_micros) OVER w <= c.cycle_time_ms * 1500 THEN 0 ELSE 1 END AS starts
  FROM frames f JOIN cycles c USING (can_id_dec)
  WINDOW w AS (PARTITION BY f.capture_id, f.can_id_dec ORDER BY f."timestamp", f.seq)),
numbered AS (
  SELECT *, sum(starts) OVER (PARTITION BY capture_id, can_id_dec ORDER BY "timestamp", seq) AS span FROM starts),
spans AS (
  SELECT capture_id, can_id_dec, cycle_time_ms, count(*) AS frames, min("timestamp") AS first_timestamp, max("timestamp") AS last_timestamp,
         arg_min(seq, ("timestamp", seq)) AS first_seq, arg_max(seq, ("timestamp", seq)) AS last_seq,
         max(ts_micros) + cycle_time_ms * 1500 AS silent_from
  FROM numbered GROUP BY capture_id, can_id_dec, cycle_time_ms, span),
closed AS (SELECT * FROM spans WHERE silent_from <= (SELECT max(ts_micros) FROM frames) - 30000000)"""

# Signals of the catalogue with selector trees; Page 3 of message 291 is not defined, so it voids the frame.
TREE_SIGNALS = """
parts AS (
  SELECT *, (low >> 1) & 1 AS sub, (low >> 2) & 3 AS page, u >> 8 AS high, u & 255 AS who FROM frames),
tree AS (
  SELECT capture_id, seq, "timestamp", can_id_dec, unnest(CASE can_id_dec
    WHEN 291 THEN CASE WHEN page < 3 THEN list_concat(
      [{'signal': 'Kind', 'value': sel}, {'signal': 'Page', 'value': page}],
      CASE WHEN sel = 0 THEN [{'signal': 'Value', 'value': v}]
           WHEN sub = 0 THEN [{'signal': 'Sub', 'value': sub}, {'signal': 'Trim', 'value': t}]
           ELSE [{'signal': 'Sub', 'value': sub}, {'signal': 'K', 'value': k}] END,
      [CASE page WHEN 0 THEN {'signal': 'Low', 'value': low} WHEN 1 THEN {'signal': 'High', 'value': high}
       ELSE {'signal': 'User', 'value': who} END]) END
    WHEN 512 THEN [{'signal': 'Page', 'value': page},
      CASE page WHEN 0 THEN {'signal': 'Low', 'value': low} WHEN 1 THEN {'signal': 'High', 'value': high}
       WHEN 2 THEN {'signal': 'User', 'value': who} ELSE {'signal': 'K', 'value': k} END]
    WHEN 1110 THEN [{'signal': 'Value', 'value': v}] END) AS found
  FROM parts)"""

NUMBER = 'row_number() OVER (PARTITION BY capture_id ORDER BY "timestamp", seq)'
RULE_ROWS = ", ".join(
    "('{}', '{}', {}, {})".format(rule, signal, *("NULL" if b is None else repr(b) for b in bounds))
    for rule, signal, *bounds in RULES
)


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


def oracle_sql() -> dict[str, str]:
    frames, signals = _with(FRAMES), _with(FRAMES, SIGNALS)
    texts = _with(FRAMES, SIGNALS, TEXTS)
    lines = _with(FRAMES, SIGNALS, TEXTS, LINES)
    buckets = """SELECT capture_id, epoch_us(time_bucket(INTERVAL '{width}', ts)) AS bucket_micros, signal,
               count(*) AS samples, round(sum(value), 3) / count(*) AS mean, min(value) AS low, max(value) AS high
        FROM signals {where} GROUP BY ALL"""
    windows = """SELECT capture_id, epoch_us(time_bucket(INTERVAL '{width}', ts)) AS window_start_micros,
               count(*) AS frames, round(count(*) / {seconds}::DOUBLE, 9) AS fps
        FROM frames {where} GROUP BY ALL"""
    closed = """WHERE time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour'
                <= (SELECT max(ts) FROM {table}) - INTERVAL '30 seconds'"""
    wide_cell = "max(CASE WHEN signal = '{0}' THEN {1} END) AS \"{0}\""
    names = ["K", "Sel", "Trim", "UserId", "Value"]
    wide = ", ".join(wide_cell.format(n, "value") for n in names)
    wide_text = ", ".join(wide_cell.format(n, "text") for n in names)
    bytes_text = "array_to_string(bytes, ' ') AS data_bytes, is_extended, false AS is_remote, false AS is_error"
    line = "printf('[%5d] ', n) || tail AS line"
    started = 'SELECT *, min("timestamp") OVER (PARTITION BY capture_id) AS start FROM frames'
    return {
        "frames_normalised": f"""{frames}
            SELECT capture_id, seq, "timestamp", ts_micros, can_id, can_id_dec, dlc, data_hex, {bytes_text}
            FROM frames""",
        "filter_ids": f"""{frames}
            SELECT capture_id, seq, "timestamp", can_id, dlc, data_hex FROM frames WHERE can_id_dec IN (256, 291)""",
        "filter_id_table": f"""{frames}
            SELECT capture_id, seq, can_id, data_hex FROM frames
            WHERE can_id_dec IN (SELECT can_id_dec FROM frames WHERE dlc = 8)""",
        "filter_ranges": f"""{signals}
            SELECT capture_id, seq, can_id_dec, signal, value FROM signals
            WHERE can_id_dec BETWEEN 256 AND 767 AND signal = 'Value' AND value BETWEEN 50.0 AND 150.0
              AND ts >= TIMESTAMP '2024-01-03 00:00:00' AND ts < TIMESTAMP '2024-01-20 12:00:00'""",
        "signals_long": f"""{signals}
            SELECT capture_id, seq, "timestamp", can_id_dec, signal, value, label FROM signals""",
        "frames_parsed": f"""{texts}
            SELECT f.capture_id, f.seq, f.can_id, x.parsed FROM frames f LEFT JOIN texts x USING (seq)""",
        "parsed_map": f"""{signals}
            SELECT f.seq, any_value(n.signals) AS signals,
                   max(CASE WHEN s.signal = 'Value' THEN s.value END) AS value, max(s.label) AS sel_label
            FROM frames f LEFT JOIN signals s USING (seq)
            LEFT JOIN (SELECT seq, count(*) AS signals FROM signals GROUP BY seq) n ON n.seq = f.seq
            GROUP BY f.seq""",
        "raw_without_catalogue": f"""{frames}
            SELECT seq, can_id, data_hex, true AS undecoded FROM frames""",
        "frames_wide": f"""{signals}
            SELECT f.seq, f."timestamp", f.can_id, f.dlc, f.data_hex, {wide}
            FROM frames f LEFT JOIN signals s USING (seq) GROUP BY ALL""",
        "message_info": f"""{frames}
            SELECT can_id_dec, count(*) AS frames, any_value(message_name) AS message_name,
                   any_value(signals) AS signals, any_value(cycle_time_ms) AS cycle_time_ms
            FROM frames LEFT JOIN (VALUES (256, 'MsgA', 'Value,K', 100), (512, 'MsgB', 'UserId,Trim', 100),
                 (291, 'MsgC', 'Sel,Value,Trim', 20), (1110, 'MsgD', 'Value,UserId', NULL))
                 AS m(can_id_dec, message_name, signals, cycle_time_ms) USING (can_id_dec)
            GROUP BY can_id_dec""",
        "expected_signal_samples": f"""{signals}
            SELECT signal, count(*) AS samples FROM signals GROUP BY signal""",
        "frame_numbers": f"""{frames}
            SELECT capture_id, seq, {NUMBER} AS frame_num FROM frames""",
        "frame_lines": f"""{lines}
            SELECT capture_id, n AS frame_num, {line} FROM (SELECT *, {NUMBER} AS n FROM lines)""",
        "count_limit": f"""{frames}
            SELECT capture_id, seq, can_id, data_hex FROM frames QUALIFY {NUMBER} <= {FRAME_LIMIT}""",
        "duration_limit": f"""{frames}
            SELECT capture_id, seq, "timestamp", can_id FROM ({started}) WHERE "timestamp" - start <= {DURATION}""",
        "duration_filter_count": f"""{frames}
            SELECT capture_id, seq, "timestamp", can_id FROM ({started})
            WHERE "timestamp" - start <= {DURATION * 6} AND can_id_dec IN (256, 291)
            QUALIFY {NUMBER} <= {FRAME_LIMIT}""",
        "capture_stats": f"""{frames}
            SELECT capture_id, count(*) AS frames, round(max("timestamp") - min("timestamp"), 6) AS elapsed_seconds,
                   round(count(*) / (max("timestamp") - min("timestamp")), 9) AS fps
            FROM frames GROUP BY capture_id""",
        "kept_frame_count": f"""{frames}
            SELECT count(*) AS frames FROM frames WHERE can_id_dec IN (256, 291)""",
        "manifest": f"""{frames}
            SELECT capture_id, min(ts_micros) AS capture_time_micros, count(*) AS frame_count
            FROM frames GROUP BY capture_id""",
        "window_stats_10s": f"""{frames}
            {windows.format(width="10 seconds", seconds=10, where="")}""",
        "bucket_stats": f"""{signals}
            {buckets.format(width="1 hour", where="")}""",
        "signal_summary": f"""{signals}
            SELECT signal, count(*) AS samples, min(value) AS low, max(value) AS high,
                   round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS deviation
            FROM signals GROUP BY signal""",
        "signal_corr": f"""{signals}
            SELECT 'Value' AS first, 'K' AS second, count(*) AS buckets, round(corr(x, y), 6) AS correlation
            FROM (SELECT avg(value) FILTER (signal = 'Value') AS x, avg(value) FILTER (signal = 'K') AS y
                  FROM signals GROUP BY time_bucket(INTERVAL '1 hour', ts))
            WHERE x IS NOT NULL AND y IS NOT NULL""",
        "signal_drift": f"""{signals}
            SELECT capture_id, signal, epoch_us(bucket) AS bucket_micros, samples, round(mean, 7) AS mean,
                   round(mean - lag(mean) OVER (PARTITION BY capture_id, signal ORDER BY bucket), 7) AS change
            FROM (SELECT capture_id, signal, time_bucket(INTERVAL '4 hours', ts) AS bucket,
                         count(*) AS samples, avg(value) AS mean FROM signals GROUP BY ALL)""",
        "signal_trend": f"""{signals}
            SELECT capture_id, signal, count(*) AS samples, round(regr_slope(value, "timestamp"), 6) + 0.0::DOUBLE AS slope
            FROM signals GROUP BY capture_id, signal""",
        "quarantine": f"""{frames}
            SELECT seq, can_id_dec, concat_ws('; ',
                   CASE WHEN can_id_dec > 2047 THEN 'identifier needs extended frame' END,
                   CASE WHEN can_id_dec = 512 THEN 'remote frame with data' END,
                   CASE WHEN can_id_dec <> 512 AND dlc <> 8 THEN 'length differs from payload' END) AS reasons
            FROM frames WHERE can_id_dec > 2047 OR can_id_dec = 512 OR dlc <> 8""",
        "valid_frames": f"""{frames}
            SELECT capture_id, seq, can_id, data_hex FROM frames
            WHERE can_id_dec <= 2047 AND can_id_dec <> 512 AND dlc = 8""",
        "gaps": f"""{_with(FRAMES, GAPS)}
            SELECT capture_id, can_id_dec, seq, previous_seq, "timestamp", previous_timestamp,
                   round(gap_seconds, 6) AS gap_seconds, cycle_time_ms
            FROM gaps""",
        "duplicates": f"""{_with(FRAMES, TWICE)}
            SELECT capture_id, can_id_dec, min(seq) AS first_seq, replace(any_value(data_hex), ' ', '') AS data,
                   count(*) AS copies
            FROM twice GROUP BY capture_id, "timestamp", can_id_dec, bytes HAVING count(*) > 1""",
        "frames_without_duplicates": f"""{frames}
            SELECT capture_id, seq, can_id, data_hex FROM frames""",
        "quality": f"""{_with(FRAMES, TWICE, GAPS)}
            SELECT capture_id, can_id_dec, count(*) AS frames,
                   count(*) FILTER (can_id_dec = 419385573) AS unknown_frames,
                   0::BIGINT AS error_frames, 0::BIGINT AS remote_frames, 0::BIGINT AS invalid_frames,
                   count(*) - count(DISTINCT ("timestamp", bytes)) AS duplicate_frames,
                   coalesce(any_value(g.gaps), 0) AS gaps
            FROM twice LEFT JOIN (SELECT capture_id, can_id_dec, count(*) AS gaps FROM gaps GROUP BY ALL) g
                 USING (capture_id, can_id_dec)
            GROUP BY capture_id, can_id_dec""",
        "rules": f"""{signals}
            SELECT capture_id, rule, signal, count(*) AS samples,
                   count(*) FILTER (value < low OR value > high) AS violations,
                   min("timestamp") FILTER (value < low OR value > high) AS first_violation,
                   CASE WHEN count(*) FILTER (value < low OR value > high) = 0 THEN 'pass' ELSE 'fail' END AS verdict
            FROM signals JOIN (VALUES {RULE_ROWS}) AS r(rule, signal, low, high) USING (signal)
            GROUP BY capture_id, rule, signal""",
        "sink_csv": f"""{texts}
            SELECT f.capture_id, f."timestamp", f.can_id, f.dlc, f.data_hex, {wide_text}
            FROM frames f LEFT JOIN cells s USING (seq) GROUP BY f.seq, f.capture_id, f."timestamp", f.can_id, f.dlc, f.data_hex""",
        "sink_ndjson": f"""{texts}
            SELECT f.capture_id, f.seq, f."timestamp", f.can_id, f.can_id_dec, f.dlc, f.data_hex, {bytes_text},
                   x.by_name AS parsed
            FROM frames f LEFT JOIN texts x USING (seq)""",
        "sink_text": f"""{lines}
            SELECT capture_id, {line} FROM (SELECT *, {NUMBER} AS n FROM lines)""",
        "sink_parquet": f"""{frames}
            SELECT capture_id, seq, "timestamp", can_id, data_hex FROM frames""",
        "store_tables": f"""{signals}
            SELECT f.capture_id, f.frame_count, s.samples
            FROM (SELECT capture_id, count(*) AS frame_count FROM frames GROUP BY capture_id) f
            LEFT JOIN (SELECT capture_id, count(*) AS samples FROM signals GROUP BY capture_id) s USING (capture_id)""",
        "store_bulk_import": f"""{frames}
            SELECT capture_id, "timestamp", can_id_dec, dlc, data_hex FROM frames""",
        "schema_evolution": f"""{frames}
            SELECT capture_id, seq, can_id, data_hex,
                   CASE WHEN can_id_dec = 1110 THEN is_extended END AS is_extended, can_id_dec <> 1110 AS is_remote
            FROM frames""",
        "fanout_count": """
            SELECT sink, (SELECT count(*) FROM events) AS frames FROM (VALUES ('csv'), ('json'), ('count')) AS s(sink)""",
        "stream_signals": f"""{signals}
            SELECT capture_id, seq, "timestamp", can_id_dec, signal, value, label FROM signals""",
        "stream_stats": f"""{frames}
            {windows.format(width="1 hour", seconds=3600, where=closed.format(table="frames"))}""",
        "stream_monitor": f"""{signals}
            {buckets.format(width="1 hour", where=closed.format(table="signals"))}""",
        "stream_capture": f"""{lines}
            SELECT capture_id, {line}
            FROM (SELECT *, {NUMBER} AS n FROM lines WHERE can_id_dec IN (256, 291))""",
        "sink_two_captures": f"""{texts}
            SELECT f.capture_id, f."timestamp", f.can_id, f.dlc, f.data_hex, {wide_text}
            FROM frames f LEFT JOIN cells s USING (seq) GROUP BY f.seq, f.capture_id, f."timestamp", f.can_id, f.dlc, f.data_hex""",
        "stream_restart": f"""{frames}
            SELECT capture_id, seq, "timestamp", can_id_dec, dlc FROM frames""",
        "stream_totals": f"""{frames}
            SELECT capture_id, count(*) AS frames, round(max("timestamp") - min("timestamp"), 6) AS elapsed_seconds,
                   round(count(*) / (max("timestamp") - min("timestamp")), 9) AS fps
            FROM frames GROUP BY capture_id""",
        "count_limit_odd_times": f"""{frames}
            SELECT capture_id, seq, can_id FROM
              (SELECT *, CASE WHEN seq % 89 = 0 THEN NULL WHEN seq % 97 = 0 THEN 'nan'::DOUBLE ELSE "timestamp" END AS odd FROM frames)
            QUALIFY row_number() OVER (PARTITION BY capture_id ORDER BY odd NULLS FIRST, seq) <= {ODD_LIMIT}""",
        "landed_frames": f"""{frames}
            SELECT capture_id, seq, "timestamp", can_id, dlc, data_hex, is_extended FROM frames""",
        "catalogue_loaded": f"""{signals}
            SELECT capture_id, seq, "timestamp", can_id_dec, signal, value, label FROM signals""",
        "signals_long_payload": f"""{signals}
            SELECT capture_id, seq, "timestamp", can_id_dec, signal, value, label FROM signals""",
        "kept_in_memory": f"""{frames}
            SELECT capture_id, seq, can_id, data_hex FROM frames WHERE can_id_dec IN (256, 291) QUALIFY {NUMBER} <= {FRAME_LIMIT}""",
        "json_extra": f"""{frames}
            SELECT seq, lower(replace(data_hex, ' ', '')) AS raw, lower(data_hex[1:2] || '-' || data_hex[4:5]) AS pair,
                   strftime(ts, '%Y-%m-%d') AS day, dlc AS size
            FROM frames""",
        "signal_quartiles": f"""{signals}
            SELECT DISTINCT signal, quartile, true AS within FROM signals, (VALUES (0), (1), (2)) AS q(quartile)""",
        "store_signals": f"""{signals}
            SELECT capture_id, seq, can_id_dec, signal, value, label FROM signals""",
        "store_pruned_scan": f"""{signals}
            SELECT 'value' AS scan, capture_id, seq, "timestamp", signal, value FROM signals
            WHERE signal = 'Value' AND value BETWEEN {VALUE_RANGE[0]} AND {VALUE_RANGE[1]}
            UNION ALL SELECT 'time', capture_id, seq, "timestamp", signal, value FROM signals
            WHERE "timestamp" BETWEEN {TIME_RANGE[0]} AND {TIME_RANGE[1]}""",
        "signals_mux_nested": f"""{_with(FRAMES, TREE_SIGNALS)}
            SELECT capture_id, seq, "timestamp", can_id_dec, found.signal AS signal, CAST(found.value AS DOUBLE) AS value,
                   CAST(NULL AS VARCHAR) AS label
            FROM tree""",
        "catalogue_problems": f"""{frames}
            SELECT message_id, message_name, signal, problem, count(seq) AS frames
            FROM (VALUES (256, 'MsgA', 'Wide', '256.Wide: length outside 1 to 64'),
                         (291, 'MsgC', 'x', '291.x: selector is not a signal')) AS p(message_id, message_name, signal, problem)
            LEFT JOIN frames ON can_id_dec = message_id GROUP BY ALL""",
        "stream_gaps": f"""{_with(FRAMES, GAPS, SPANS)}
            SELECT capture_id, can_id_dec, first_seq AS seq, previous_seq, first_timestamp AS "timestamp", previous_timestamp,
                   round(first_timestamp - previous_timestamp, 6) AS gap_seconds, cycle_time_ms
            FROM (SELECT *, lag(last_seq) OVER w AS previous_seq, lag(last_timestamp) OVER w AS previous_timestamp FROM closed
                  WINDOW w AS (PARTITION BY capture_id, can_id_dec ORDER BY first_timestamp))
            WHERE previous_timestamp IS NOT NULL""",
        "stream_silences": f"""{_with(FRAMES, GAPS, SPANS)}
            SELECT capture_id, can_id_dec, frames, first_timestamp, last_timestamp, CAST(silent_from AS BIGINT) AS silent_from FROM closed""",
        "stream_without_duplicates": f"""{frames}
            SELECT capture_id, seq, can_id, data_hex FROM frames""",
        "sink_parquet_twice": f"""{frames}
            SELECT capture_id, seq, "timestamp", can_id, data_hex FROM frames""",
        "store_twice": f"""{signals}
            SELECT capture_id, f.n AS frame_count, f.n AS frames, s.samples
            FROM (SELECT capture_id, count(*) AS n FROM frames GROUP BY capture_id) f
            LEFT JOIN (SELECT capture_id, count(*) AS samples FROM signals GROUP BY capture_id) s USING (capture_id)""",
        "valid_frames_fd": f"""{frames}
            SELECT capture_id, seq, CAST(size AS INTEGER) AS dlc,
                   CASE WHEN size > 64 THEN 'payload too long'
                        WHEN size > 8 AND size NOT IN (12, 16, 20, 24, 32, 48, 64) THEN 'no length of a frame' ELSE '' END AS reasons
            FROM (SELECT *, dlc + [0, 4, 5, 56, 64][seq % 5 + 1] AS size FROM frames)""",
        "rules_sustained": f"""{signals}, judged AS (
              SELECT capture_id, rule, signal, seq, "timestamp", coalesce(value < low, false) OR coalesce(value > high, false) AS broken
              FROM signals JOIN (VALUES {RULE_ROWS}) AS r(rule, signal, low, high) USING (signal)),
            islands AS (
              SELECT *, row_number() OVER (PARTITION BY capture_id, rule, signal ORDER BY "timestamp", seq)
                - row_number() OVER (PARTITION BY capture_id, rule, signal, broken ORDER BY "timestamp", seq) AS island FROM judged)
            SELECT capture_id, rule, signal, min("timestamp") AS first_violation, arg_min(seq, ("timestamp", seq)) AS first_seq,
                   max("timestamp") AS last_violation, round(max("timestamp") - min("timestamp"), 6) AS seconds
            FROM islands WHERE broken GROUP BY capture_id, rule, signal, island
            HAVING max("timestamp") - min("timestamp") >= {LEAST_SECONDS}""",
        "signal_corr_asof": f"""{signals}
            SELECT capture_id, 'Value' AS first, 'Trim' AS second, count(*) AS pairs,
                   round(covar_pop(a.value, b.value) / nullif(stddev_pop(a.value) * stddev_pop(b.value), 0), 6) AS correlation
            FROM (SELECT * FROM signals WHERE signal = 'Value') a ASOF JOIN (SELECT * FROM signals WHERE signal = 'Trim') b
              USING (capture_id, "timestamp")
            WHERE a."timestamp" - b."timestamp" <= {MOST_AGE} GROUP BY capture_id""",
        "signals_asof": f"""{signals}
            SELECT capture_id, a."timestamp", a.seq, a.value AS x, b.value AS y, b."timestamp" AS y_timestamp
            FROM (SELECT * FROM signals WHERE signal = 'UserId') a ASOF JOIN (SELECT * FROM signals WHERE signal = 'K') b
              USING (capture_id, "timestamp")""",
        "stream_sink_catches_up": f"""{lines}
            SELECT capture_id, {line} FROM (SELECT *, {NUMBER} AS n FROM lines)""",
        "store_compacted": f"""{frames}
            SELECT capture_id, seq, "timestamp", can_id, data_hex FROM frames""",
        "signal_shifts": f"""{signals}, sums AS (
              SELECT capture_id, signal, seq, "timestamp", count(*) OVER k AS samples, sum(value) OVER k AS total,
                     row_number() OVER w AS before, sum(value) OVER w AS upto
              FROM signals WINDOW k AS (PARTITION BY capture_id, signal),
                w AS (PARTITION BY capture_id, signal ORDER BY "timestamp", seq ROWS UNBOUNDED PRECEDING)),
            best AS (
              SELECT * FROM sums WHERE before < samples
              QUALIFY row_number() OVER (PARTITION BY capture_id, signal
                ORDER BY round(abs(upto - before * total / samples), 6) DESC, before) = 1)
            SELECT capture_id, signal, samples, before AS samples_before, "timestamp" AS last_before, seq AS seq_before,
                   round(upto, 3) / before AS mean_before, round(total - upto, 3) / (samples - before) AS mean_after
            FROM best""",
        "sketch_rollup": f"""{signals}
            SELECT capture_id, signal, count(*) AS samples, quartile, true AS within
            FROM signals, (VALUES (0), (1), (2)) AS q(quartile) WHERE signal IN ('Value', 'K', 'UserId')
            GROUP BY capture_id, signal, quartile""",
        "quality_flags": f"""{frames}
            SELECT capture_id, can_id_dec, count(*) AS frames, count(*) FILTER (seq % 11 = 0) AS error_frames,
                   count(*) FILTER (seq % 13 = 0) AS remote_frames, count(*) FILTER (seq % 13 = 0) AS invalid_frames
            FROM frames GROUP BY capture_id, can_id_dec""",
    }
