"""ANSI SQL with the same result as each registered query, for a check by another engine."""

from __future__ import annotations

_PLAYS = "SELECT user_id AS song_id, value AS duration, ts AS event_time FROM events"
_SONGS = """SELECT c_custkey AS id, c_name AS name, CAST(c_nationkey AS VARCHAR) AS album,
            c_mktsegment AS artist, c_mktsegment AS genre FROM customer"""

_SONG_PLAYS = f"""SELECT p.song_id, s.album, s.artist, s.name, s.genre, p.duration, p.event_time
    FROM ({_PLAYS}) p JOIN ({_SONGS}) s ON p.song_id = s.id WHERE p.duration >= 30"""

_COUNTS = f"""SELECT date_trunc('day', event_time) AS window_start,
        date_trunc('day', event_time) + INTERVAL 1 DAY AS window_end,
        song_id, name, genre, count(*) AS play_count
    FROM ({_SONG_PLAYS}) GROUP BY ALL"""

_RANKED = f"""SELECT *, row_number() OVER (PARTITION BY window_start, window_end, genre
        ORDER BY play_count DESC, song_id) AS row_num FROM ({_COUNTS})"""

_CHART = f"""SELECT window_start, window_end, song_id, name, genre, play_count
    FROM ({_RANKED}) WHERE row_num <= 3"""

_PLAYED_UNTIL = "(SELECT max(ts) - INTERVAL 30 SECOND FROM events)"
_JOINED_UNTIL = f"(SELECT max(event_time) - INTERVAL 1 SECOND FROM ({_SONG_PLAYS}))"
_NAMED_CHART = f"SELECT * RENAME (play_count AS song_play_count) FROM ({_CHART})"

_IMAGE = """SELECT event_id, ts, user_id, event_type, value, props FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
    WHERE rn = 1 AND event_type <> 'error'"""

_HOPS = """SELECT w AS window_start, w + INTERVAL 1 DAY AS window_end, event_type, count(*) AS play_count
    FROM (SELECT event_type, unnest([time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR * i FOR i IN range(4)]) AS w
          FROM events) GROUP BY ALL"""

# A sketch of few hundred values holds them all, so its estimate is exact.
_HOP_USERS = _HOPS.replace("SELECT event_type, unnest", "SELECT event_type, user_id, unnest").replace(
    "count(*) AS play_count", "count(DISTINCT user_id) AS users"
)

_CUMULATED = """SELECT date_trunc('day', ts) AS window_start, e AS window_end, event_type, count(*) AS play_count
    FROM (SELECT ts, event_type, unnest(
            [x FOR x IN [date_trunc('day', ts) + INTERVAL 6 HOUR * i FOR i IN range(1, 5)] IF x > ts]) AS e FROM events)
    GROUP BY ALL"""

_SESSIONS = """SELECT min(ts) AS window_start, max(ts) + INTERVAL 6 HOUR AS window_end, user_id, count(*) AS play_count
    FROM (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS session
          FROM (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts)
                       + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events))
    GROUP BY user_id, session"""

_STATISTICS = """count(*) AS events,
        CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total,
        CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(value) AS average,
        min(value) AS smallest, max(value) AS largest"""

_DAILY = """date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, event_type"""

_INTERVAL = """SELECT c.event_id AS click_id, c.user_id AS click_user, c.ts AS click_ts,
        b.event_id AS buy_id, b.user_id AS buy_user, b.ts AS buy_ts
    FROM events c JOIN events b ON c.user_id = b.user_id
        AND b.ts BETWEEN c.ts AND c.ts + INTERVAL 1 DAY
    WHERE c.event_type = 'click' AND b.event_type = 'purchase'"""


# What a watermark of eight days has passed when all events were read.
_PASSED = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 8 DAY FROM events)"



def _passed_both(one: str, other: str) -> str:
    """The same for two streams of one type of event each; the slower one decides."""
    latest = "(SELECT date_trunc('millisecond', max(ts)) FROM events WHERE event_type = '{}')"
    return f"(least({latest.format(one)}, {latest.format(other)}) - INTERVAL 8 DAY)"


_SLOTTED = "SELECT *, floor(epoch(ts) / 691200) AS slot FROM events"


def _as_of(how: str) -> str:
    return f"""SELECT b.user_id, b.event_id, b.ts, b.value, v.event_id AS version_id, v.ts AS valid_from, v.props AS version
        FROM (SELECT * FROM events WHERE event_type = 'purchase') b
        ASOF {how} JOIN (SELECT * FROM events WHERE event_type = 'signup') v
        ON b.user_id = v.user_id AND b.ts >= v.ts"""


def _one_per_key(direction: str) -> str:
    return f"""SELECT event_id, ts, user_id, event_type, value, props FROM (SELECT *, row_number() OVER (
        PARTITION BY user_id, event_type ORDER BY ts {direction}, event_id {direction}) AS rn FROM events) WHERE rn = 1"""


def _over(frame: str, more: str = "", rows: str = "events") -> str:
    return f"""SELECT event_id, user_id, ts, value,
        CAST(sum(CAST(value AS DECIMAL(18,2))) OVER w AS DOUBLE) AS total, count(*) OVER w AS frame_rows{more}
        FROM {rows} WINDOW w AS (PARTITION BY user_id ORDER BY ts {frame})"""


_RUNNING = """SELECT event_id, user_id, ts, value,
    CAST(sum(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DOUBLE) AS total
    FROM events"""


def _two_sides(operation: str) -> str:
    side = "SELECT user_id, CAST(floor(value) AS BIGINT) AS whole FROM events WHERE event_type = "
    return f"{side}'click' {operation} {side}'purchase'"


def _people(kind: str) -> str:
    rows = "SELECT event_id, user_id, value FROM events WHERE value >= 100"
    if kind == "LEFT":
        return f"SELECT c_custkey, c_name, r.* FROM customer LEFT JOIN ({rows}) r ON c_custkey = r.user_id"
    return f"SELECT c_custkey, c_name FROM customer WHERE c_custkey {kind} (SELECT user_id FROM ({rows}))"


def _grouped(grouping: str) -> str:
    return f"""SELECT window_start, event_type, count(*) AS events
        FROM (SELECT date_trunc('day', ts) AS window_start, event_type FROM events) GROUP BY {grouping}"""


# DuckDB upper-cases letter by letter; in full case mapping the sharp s becomes two letters.
_UPPER = "upper(replace(text, 'ß', 'SS'))"
_MISSING_TYPE = "SELECT *, nullif(event_type, 'error') AS kind FROM events"

ORACLES: dict[str, str] = {
    "project_filter_plays": f"SELECT * FROM ({_PLAYS}) WHERE duration >= 30",
    "enrich_plays_join": _SONG_PLAYS,
    "enrich_plays_salted": _SONG_PLAYS,
    "stream_static_enrich": _SONG_PLAYS,
    "stream_stream_enrich": _SONG_PLAYS,
    "sql_enrich_plays": _SONG_PLAYS,
    "tumble_play_count": _COUNTS,
    "rank_in_window": _RANKED,
    "rank_in_window_chunked": _RANKED,
    "topk_songs_per_genre": _CHART,
    "topk_beyond_group_limit": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY genre
        ORDER BY play_count DESC, song_id, name, window_start) AS row_num FROM ({_COUNTS})) WHERE row_num <= 2000""",
    "sql_pipeline_topk": _NAMED_CHART,
    "debug_select": f"SELECT '+I' AS op, * FROM ({_NAMED_CHART})",
    "positional_insert": _NAMED_CHART,
    "stream_tumble_closed": f"SELECT * FROM ({_COUNTS}) WHERE window_end <= {_PLAYED_UNTIL}",
    "stream_topk_closed_agg": f"SELECT * FROM ({_CHART}) WHERE window_end <= {_PLAYED_UNTIL}",
    "stream_topk_closed_batch": f"SELECT * FROM ({_CHART}) WHERE window_end <= {_PLAYED_UNTIL}",
    "stream_topk_counted_first": f"SELECT * FROM ({_CHART}) WHERE window_end <= {_PLAYED_UNTIL}",
    "staged_pipeline_topk": f"SELECT * FROM ({_NAMED_CHART}) WHERE window_end <= {_JOINED_UNTIL}",
    "decode_props_json": """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
        CAST(NULL AS VARCHAR) AS missing FROM events""",
    "decode_key_lenient": """SELECT event_id, CASE WHEN event_type <> 'error'
        THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events""",
    "quarantine_malformed_json": """SELECT event_id,
        CASE WHEN event_type <> 'error' THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k,
        CASE WHEN event_type = 'error' THEN 'bad' ELSE 'good' END AS outcome FROM events""",
    "encode_roundtrip_json": """SELECT event_id AS key_event_id, event_id, user_id, event_type, value,
        date_trunc('millisecond', ts) AS ts FROM events""",
    "raw_key_split": """SELECT CAST(c_custkey AS VARCHAR) AS the_key, c_name, c_nationkey, c_acctbal, c_mktsegment
        FROM customer""",
    "conform_events": _PLAYS,
    "required_field_report": f"""SELECT 'event_id' AS column_name, count(*) FILTER (event_id IS NULL) AS missing,
            count(*) AS total FROM events
        UNION ALL SELECT 'event_type', count(*) FILTER (kind IS NULL), count(*) FROM ({_MISSING_TYPE})
        UNION ALL SELECT 'value', count(*) FILTER (value IS NULL), count(*) FROM events""",
    "required_field_split": f"""SELECT event_id, CASE WHEN event_id IS NULL OR kind IS NULL
        THEN 'quarantined' ELSE 'accepted' END AS outcome FROM ({_MISSING_TYPE})""",
    "metadata_event_time": "SELECT user_id AS song_id, ts AS event_time FROM events",
    "pk_duplicates": """SELECT user_id, event_type, date_trunc('day', ts) AS day, count(*) AS copies
        FROM events GROUP BY ALL HAVING count(*) > 1""",
    "latest_image": _IMAGE,
    "stream_upsert_image": _IMAGE,
    "stream_running_count": "SELECT event_type, count(*) AS events FROM events GROUP BY event_type",
    "udf_upper_messages": f"SELECT conv_id, turn, {_UPPER} AS value FROM conversations",
    "builtin_upper_messages": f"SELECT conv_id, turn, {_UPPER} AS value FROM conversations",
    "stream_message_stage": f"SELECT CAST(conv_id AS VARCHAR) AS key, {_UPPER} AS value FROM conversations",
    "hop_play_count": _HOPS,
    "stream_hop_closed": f"SELECT * FROM ({_HOPS}) WHERE window_end <= {_PLAYED_UNTIL}",
    "cumulate_play_count": _CUMULATED,
    "session_play_count": _SESSIONS,
    "session_play_count_chunked": _SESSIONS,
    "stream_session_closed": f"SELECT * FROM ({_SESSIONS}) WHERE window_end <= {_PLAYED_UNTIL}",
    "window_aggregates": f"""SELECT {_DAILY}, count(DISTINCT user_id) AS users, {_STATISTICS}
        FROM events GROUP BY ALL""",
    "stream_window_aggregates": f"""SELECT * FROM (SELECT {_DAILY}, {_STATISTICS} FROM events GROUP BY ALL)
        WHERE window_end <= {_PLAYED_UNTIL}""",
    "window_rollup": _grouped("ROLLUP (window_start, event_type)"),
    "window_cube": _grouped("CUBE (window_start, event_type)"),
    "window_grouping_sets": _grouped("GROUPING SETS ((window_start, event_type), (event_type))"),
    "interval_join": _INTERVAL,
    "stream_interval_join": _INTERVAL,
    "as_of_join": _as_of("INNER"),
    "as_of_join_left": _as_of("LEFT"),
    "as_of_join_chunked": _as_of("INNER"),
    "left_outer_join": _people("LEFT"),
    "semi_join": _people("IN"),
    "anti_join": _people("NOT IN"),
    "dedup_keep_first": _one_per_key("ASC"),
    "dedup_keep_last": _one_per_key("DESC"),
    "stream_dedup": "SELECT event_id, ts, user_id, event_type, value, props FROM events",
    "over_rows_frame": _over("ROWS BETWEEN 2 PRECEDING AND CURRENT ROW"),
    "over_rows_frame_chunked": _over("ROWS BETWEEN 2 PRECEDING AND CURRENT ROW"),
    "over_range_frame": _over(
        "RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW",
        ", min(event_id) OVER w AS lowest, max(event_id) OVER w AS highest",
    ),
    "running_total": _RUNNING,
    "running_total_chunked": _RUNNING,
    "union_all": _two_sides("UNION ALL"),
    "union_distinct": _two_sides("UNION"),
    "intersect_distinct": _two_sides("INTERSECT"),
    "except_distinct": _two_sides("EXCEPT"),
    "stream_union_all": """SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'
        UNION ALL SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'""",
    "stream_two_inserts": "SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('click', 'purchase')",
    "stream_distinct_users": f"""SELECT * FROM (SELECT {_DAILY}, count(DISTINCT user_id) AS users
        FROM events GROUP BY ALL) WHERE window_end <= {_PLAYED_UNTIL}""",
    "processing_time": "SELECT c_custkey AS id, true AS set_in_time FROM customer",
    "scan_with_options": "SELECT event_id, event_type, CAST(NULL AS VARCHAR) AS the_kafka_key FROM events",
    "explain_statements": """SELECT statement, joins, ranks, (SELECT count(*) FROM customer) AS songs
        FROM (VALUES (4, true, false), (5, true, true)) AS t(statement, joins, ranks)""",
    "sql_parts_by_month": """SELECT p_brand, date_trunc('month', l_shipdate) AS month, count(*) AS lines,
            CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity
        FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 10 GROUP BY ALL""",
    "over_range_null_time": _over(
        "RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW",
        ", min(event_id) OVER w AS lowest, max(event_id) OVER w AS highest",
        "(SELECT * REPLACE (CASE WHEN event_type <> 'error' THEN ts END AS ts) FROM events)",
    ),
    "staged_pipeline_as_stated": f"SELECT * FROM ({_NAMED_CHART}) WHERE window_end <= {_JOINED_UNTIL}",
    "stream_keep_last": _one_per_key("DESC"),
    "stream_running_topk": """SELECT event_type, user_id, events, row_number() OVER (
            PARTITION BY event_type ORDER BY events DESC, user_id) AS row_num
        FROM (SELECT event_type, user_id, count(*) AS events FROM events GROUP BY ALL) QUALIFY row_num <= 3""",
    "hop_distinct_users": _HOP_USERS,
    "cumulate_distinct_users": _CUMULATED.replace("SELECT ts, event_type, unnest", "SELECT ts, event_type, user_id, unnest").replace(
        "count(*) AS play_count", "count(DISTINCT user_id) AS users"
    ),
    "stream_hop_distinct": f"SELECT * FROM ({_HOP_USERS}) WHERE window_end <= {_PASSED}",
    "stream_grouping_sets": f"""SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end,
            event_type, large, CAST(grouping(event_type, large) AS INTEGER) AS grouping_id, count(*) AS events
        FROM (SELECT *, value >= 100 AS large FROM events)
        GROUP BY GROUPING SETS ((date_trunc('day', ts), event_type, large), (date_trunc('day', ts), large), (date_trunc('day', ts)))
        HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= {_PASSED}""",
    "stream_changelog": _IMAGE,
    "stream_retracted_counts": f"SELECT event_type, count(*) AS users FROM ({_IMAGE}) GROUP BY event_type",
    "stream_current_image_join": f"""SELECT c.event_id, c.user_id, arg_max(u.event_type, (u.ts, u.event_id)) AS last_type,
            arg_max(u.event_id, (u.ts, u.event_id)) AS last_event
        FROM ({_SLOTTED}) c LEFT JOIN ({_SLOTTED}) u ON u.user_id = c.user_id AND u.slot <= c.slot
        WHERE c.event_type = 'click' GROUP BY c.event_id, c.user_id""",
    "stream_late_rows": """WITH parts AS (SELECT event_id, ts, floor((event_id - lo) * 4 / (hi - lo + 1)) AS part
            FROM events, (SELECT min(event_id) AS lo, max(event_id) AS hi FROM events))
        SELECT event_id, coalesce(ts <= (SELECT date_trunc('millisecond', max(b.ts)) - INTERVAL 20 DAY
                FROM parts b WHERE b.part < p.part), false) AS late
        FROM parts p""",
    "stream_required_check": f"""SELECT 'event_id' AS column_name, count(*) FILTER (event_id IS NULL) AS missing,
            count(*) AS total FROM events
        UNION ALL SELECT 'kind', count(*) FILTER (kind IS NULL), count(*) FROM ({_MISSING_TYPE})
        UNION ALL SELECT 'value', count(*) FILTER (value IS NULL), count(*) FROM events""",
    "stream_as_of_join": f"SELECT * FROM ({_as_of('INNER')}) WHERE ts <= {_passed_both('purchase', 'signup')}",
    "stream_join_within": f"""SELECT c.user_id AS click_user, c.event_id AS click_id, c.ts AS click_ts, b.event_id AS buy_id,
            b.ts AS buy_ts
        FROM events c JOIN events b ON c.user_id = b.user_id AND b.ts BETWEEN c.ts - INTERVAL 6 HOUR AND c.ts + INTERVAL 6 HOUR
        WHERE c.event_type = 'click' AND b.event_type = 'purchase' AND greatest(c.ts, b.ts) <= {_passed_both('click', 'purchase')}""",
    "stream_over_range": "SELECT * FROM ("
    + _over(
        "RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW",
        ", min(event_id) OVER w AS lowest, max(event_id) OVER w AS highest",
    )
    + f") WHERE ts <= {_PASSED}",
    "stream_over_rows": f"SELECT * FROM ({_over('ROWS BETWEEN 2 PRECEDING AND CURRENT ROW')}) WHERE ts <= {_PASSED}",
    "debug_stream_rows": f"SELECT '+I' AS op, * FROM ({_PLAYS}) WHERE duration >= 30",
}
