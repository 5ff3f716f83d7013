"""Every query over the driver's tables, and the DuckDB SQL that tells its rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glimmer.config import CORE_DIMS, EXTENDED_DIMS, TESTDATA_CONFIG, Rules
from glimmer.operators import cells as C
from glimmer.operators import sessions as S
from glimmer.operators import tiers
from glimmer.plans import serving, validation
from glimmer.plans.engine import Engine
from glimmer.sources import testdata

CFG = TESTDATA_CONFIG
AS_OF = "2024-01-30 00:00:00"
#: When retention is looked at: some sessions are older than it allows, others are not.
RETAINED_AT = "2024-02-02 12:00:00"
B, H, G, HOT = CFG.bucket_seconds, CFG.heartbeat_seconds, CFG.gap_seconds, CFG.hot_window_seconds
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
KEYS = "country, platform, video_type, category, content_id, minute"


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return Engine(testdata.landing(spark, sf_dir), testdata.content(spark, sf_dir), CFG, as_of=AS_OF)


def plain(df: DataFrame) -> DataFrame:
    """Times without a zone, which every engine compares alike."""
    return df.select(*[F.col(f.name).cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f.name) for f in df.schema.fields])


def _floor(x: str) -> str:
    return f"time_bucket(INTERVAL {B} SECOND, {x}, TIMESTAMP '1970-01-01')"


def _states(on: str, off: str) -> str:
    return f"""
cl AS (SELECT *, event_timestamp AS ts, CASE WHEN {on} THEN 1 WHEN {off} THEN -1 ELSE 0 END AS transition FROM ev),
co AS (
  SELECT video_session_id, ts, min(user_id) AS user_id, min(content_id) AS content_id, min(platform) AS platform, min(country) AS country,
    CASE WHEN min(transition) < 0 THEN -1 ELSE max(transition) END AS transition
  FROM cl GROUP BY ALL),
st AS (
  SELECT *, coalesce(last_value(nullif(transition, 0) IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING), 0) AS state, lead(ts) OVER w AS next_ts
  FROM co WINDOW w AS (PARTITION BY video_session_id ORDER BY ts))"""


def _segments(grace: int, gap: int) -> str:
    return f"""
sg AS (
  SELECT video_session_id, user_id, content_id, platform, country, ts AS seg_start,
    CASE WHEN next_ts IS NOT NULL AND date_diff('second', ts, next_ts) <= {gap} THEN next_ts ELSE ts + INTERVAL {grace} SECOND END AS seg_end
  FROM st WHERE state = 1)"""


def _islands(split: bool) -> str:
    also = " OR platform <> lag(platform) OVER w OR user_id <> lag(user_id) OVER w" if split else ""
    return f"""
fl AS (
  SELECT *, CASE WHEN seg_start > max(seg_end) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING){also} THEN 1 ELSE 0 END AS new
  FROM sg WINDOW w AS (PARTITION BY video_session_id ORDER BY seg_start)),
nu AS (SELECT *, (sum(new) OVER (PARTITION BY video_session_id ORDER BY seg_start ROWS UNBOUNDED PRECEDING))::BIGINT AS island FROM fl),
isl AS (
  SELECT video_session_id, island, min(user_id) AS user_id, min(content_id) AS content_id, min(platform) AS platform, min(country) AS country,
    min(seg_start) AS active_start, max(seg_end) AS active_end
  FROM nu GROUP BY ALL HAVING max(seg_end) > min(seg_start))"""


def _expanded(source: str, start: str, end: str) -> str:
    return f"SELECT x.*, coalesce(cd.video_type, '') AS video_type, coalesce(cd.category, '') AS category, coalesce(cd.title, '') AS title, unnest(generate_series({_floor(start)}, {_floor(end + ' - INTERVAL 1 MILLISECOND')}, INTERVAL {B} SECOND)) AS minute FROM {source} x LEFT JOIN cd USING (content_id) WHERE {end} > {start}"


def _among(types: tuple[str, ...], markers: tuple[str, ...]) -> str:
    listed = lambda values: ", ".join(f"'{v}'" for v in values)
    return f"event_type IN ({listed(types)}) OR event IN ({listed(markers)})"


RULES = Rules()
ON, OFF = _among(RULES.activating_types, RULES.activating_markers), _among(RULES.deactivating_types, RULES.deactivating_markers)
COUNTS = "count(DISTINCT video_session_id) AS concurrent, count(DISTINCT user_id) AS concurrent_users"
BASE = f"""WITH {testdata.CTES},{_states(ON, OFF)},{_segments(H, G)},{_islands(True)},
iv AS (
  SELECT i.video_session_id, i.user_id, i.platform, i.active_start, i.active_end, s.content_id, s.country
  FROM isl i JOIN (SELECT video_session_id, min(content_id) AS content_id, min(country) AS country FROM isl GROUP BY 1) s USING (video_session_id)),
atm AS ({_expanded("iv", "active_start", "active_end")}),
sa AS (SELECT {KEYS}, {COUNTS} FROM atm GROUP BY ALL),
si AS (SELECT {KEYS}, {COUNTS} FROM ({_expanded("sg", "seg_start", "seg_end")}) GROUP BY ALL),
la AS (
  SELECT video_session_id, {", ".join(f"arg_max({c}, (event_timestamp, {c})) AS {c}" for c in ("subtitle_language", "audio_language", "player_version", "app_version"))}
  FROM ev GROUP BY 1),
ex AS (SELECT {KEYS}, subtitle_language, audio_language, player_version, app_version, title, {COUNTS} FROM atm JOIN la USING (video_session_id) GROUP BY ALL),
wm AS (SELECT {_floor("max(event_timestamp)")} - INTERVAL {HOT} SECOND AS wm FROM ev),
cold AS (SELECT sa.* FROM sa, wm WHERE minute < wm),
hot AS (SELECT sa.* FROM sa, wm WHERE minute >= wm),
now AS (SELECT * FROM cold UNION ALL SELECT * FROM hot WHERE minute > (SELECT coalesce(max(minute), TIMESTAMP '1970-01-01') FROM cold)),
cu AS (SELECT minute, sum(concurrent)::BIGINT AS c, sum(concurrent_users)::BIGINT AS u FROM now GROUP BY 1),
bo AS (SELECT min(minute) AS lo, max(minute) AS hi FROM now),
sp AS (SELECT unnest(generate_series(lo, hi, INTERVAL {B} SECOND)) AS minute FROM bo),
de AS (SELECT minute, coalesce(c, 0) AS concurrent, coalesce(u, 0) AS concurrent_users FROM sp LEFT JOIN cu USING (minute))
"""

EXTENDED_KEYS = f"{KEYS}, subtitle_language, audio_language, player_version, app_version, title"
#: Cells another way than BASE's: no windows and no islands.  A session's state at an event is its last turn so far, by a self-join,
#: and it counts in a bucket that one of its active stretches overlaps, by a join with all buckets.
MEMBERS = f"""WITH {testdata.CTES},
tr AS (
  SELECT video_session_id, event_timestamp AS ts, min(user_id) AS user_id, min(content_id) AS content_id, min(platform) AS platform, min(country) AS country,
    CASE WHEN bool_or(NOT ({ON}) AND ({OFF})) THEN -1 WHEN bool_or({ON}) THEN 1 ELSE 0 END AS turn
  FROM ev GROUP BY 1, 2),
la AS (
  SELECT a.video_session_id, a.ts, arg_max(b.turn, b.ts) FILTER (b.turn <> 0 AND b.ts <= a.ts) AS state, min(b.ts) FILTER (b.ts > a.ts) AS next_ts
  FROM tr a JOIN tr b USING (video_session_id) GROUP BY 1, 2),
ac AS (
  SELECT tr.*, ts AS s, CASE WHEN date_diff('second', ts, next_ts) <= {G} THEN next_ts ELSE ts + INTERVAL {H} SECOND END AS e
  FROM tr JOIN la USING (video_session_id, ts) WHERE state = 1),
gr AS (SELECT unnest(generate_series({_floor("(SELECT min(s) FROM ac)")}, {_floor("(SELECT max(e) FROM ac)")}, INTERVAL {B} SECOND)) AS minute),
mb AS (
  SELECT ac.*, minute, coalesce(video_type, '') AS video_type, coalesce(category, '') AS category, coalesce(title, '') AS title
  FROM ac JOIN gr ON s < minute + INTERVAL {B} SECOND AND e > minute LEFT JOIN cd USING (content_id)),
ind AS (SELECT {KEYS}, {COUNTS} FROM mb GROUP BY ALL),
lv AS (
  SELECT video_session_id, {", ".join(f"max({c}) FILTER (event_timestamp = last_ts) AS {c}" for c in ("subtitle_language", "audio_language", "player_version", "app_version"))}
  FROM (SELECT ev.*, m.last_ts FROM ev JOIN (SELECT video_session_id, max(event_timestamp) AS last_ts FROM ev GROUP BY 1) m USING (video_session_id)) GROUP BY 1),
inx AS (SELECT {EXTENDED_KEYS}, {COUNTS} FROM mb JOIN lv USING (video_session_id) GROUP BY ALL),
per AS (SELECT minute, sum(concurrent)::BIGINT AS c, sum(concurrent_users)::BIGINT AS u FROM ind GROUP BY 1)
"""


def query(name: str, sql: str, base: str = BASE):
    def add(make: Callable[[Engine], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: plain(make(engine(spark, sf_dir)))
        ORACLE_SQL[name] = base + sql
        return make

    return add


def _peak(source: str, keys: str, value: str = "concurrent", where: str = "true") -> str:
    return f"SELECT {keys}, max(c)::BIGINT AS peak, arg_min(minute, (-c, minute)) AS peak_minute FROM (SELECT {keys}, minute, sum({value}) AS c FROM {source} WHERE {where} GROUP BY ALL) GROUP BY {keys}"


query("edge_projection", "SELECT * FROM ev")(lambda e: e.events)
query("classify_events", "SELECT video_session_id, user_id, ts, content_id, platform, country, transition FROM cl")(lambda e: S.classify(e.events, e.rules))
query("collapse_same_ms", "SELECT * FROM co")(lambda e: S.collapse(S.classify(e.events, e.rules)))
query("running_state", "SELECT * FROM st")(lambda e: e.stated)
query("segments", "SELECT * FROM sg")(lambda e: e.segments)
query("islands", "SELECT * FROM isl")(lambda e: e.islands)
query(
    "session_intervals",
    f"""SELECT video_session_id, user_id, platform, active_start, active_end, iv.content_id, country, coalesce(video_type, '') AS video_type, coalesce(category, '') AS category, coalesce(title, '') AS title,
  max(active_end) OVER (PARTITION BY video_session_id) >= TIMESTAMP '{AS_OF}' - INTERVAL {G} SECOND AS is_provisional, epoch_ms(TIMESTAMP '{AS_OF}') AS version
FROM iv LEFT JOIN cd ON cd.content_id = iv.content_id""",
)(lambda e: e.intervals)
query("bucket_expand", "SELECT video_session_id, user_id, platform, active_start, minute FROM atm")(lambda e: e.atoms.select("video_session_id", "user_id", "platform", "active_start", "minute"))
query("cells_session_aware", "SELECT * FROM sa")(lambda e: e.cells)
query("cells_session_independent", "SELECT * FROM si")(lambda e: e.cells_independent)
query("cells_extended", "SELECT * FROM ex")(lambda e: e.cells_extended)
query(
    "intervals_retained",
    f"""SELECT video_session_id, version FROM (SELECT DISTINCT video_session_id FROM isl) JOIN (SELECT video_session_id, epoch_ms(max(event_timestamp)) AS version FROM ev GROUP BY 1) USING (video_session_id)
WHERE version >= epoch_ms(TIMESTAMP '{RETAINED_AT}' - INTERVAL {CFG.intervals_ttl_days} DAY)""",
)(lambda e: tiers.retained_versions(e.versioned, e.cfg.intervals_ttl_days, RETAINED_AT).select(S.SESSION, "version"))
query("tier_cold", "SELECT * FROM cold")(lambda e: e.cold)
query("tier_hot", "SELECT * FROM hot")(lambda e: e.hot)
query("tier_overlap", "SELECT minute FROM cold INTERSECT SELECT minute FROM hot")(lambda e: tiers.overlap(e.cold, e.hot))
query("concurrency_now", "SELECT *, 'cold' AS tier FROM cold UNION ALL SELECT *, 'hot' FROM hot WHERE minute > (SELECT coalesce(max(minute), TIMESTAMP '1970-01-01') FROM cold)")(lambda e: e.now)
# Backgrounding and errors come late here; what they change in the cold tier is added to it.
query("cold_after_late_events", "SELECT * FROM cold")(lambda e: e.cold_after(F.col("event_type").isin("AppBackgrounded", "VideoError")))
query("islands_blocked", "SELECT * FROM isl")(lambda e: e.islands_blocked)
query("cells_sweep", "SELECT * FROM ind", MEMBERS)(lambda e: e.cells_sweep)
query(
    "sweep_steps",
    f"""SELECT platform, minute, lead(minute) OVER (PARTITION BY platform ORDER BY minute) AS until, n FROM (
  SELECT platform, minute, n, coalesce(lag(n) OVER (PARTITION BY platform ORDER BY minute), 0) AS before
  FROM (SELECT p.platform, g.minute, count(DISTINCT m.video_session_id) AS n
    FROM (SELECT DISTINCT platform FROM mb) p CROSS JOIN (SELECT minute FROM gr UNION SELECT max(minute) + INTERVAL {B} SECOND FROM gr) g
    LEFT JOIN mb m ON m.platform = p.platform AND m.minute = g.minute GROUP BY 1, 2))
WHERE n <> before QUALIFY n > 0""",
    MEMBERS,
)(lambda e: C.steps(e.intervals, e.cfg, keys=("platform",)))
query("users_exact_from_bitmaps", "SELECT minute, count(DISTINCT user_id) AS users FROM mb GROUP BY 1", MEMBERS)(lambda e: C.rolled_up(e.user_bitmaps(), ("minute",), "users"))
query("users_by_video_type_from_bitmaps", "SELECT video_type, count(DISTINCT user_id) AS users FROM mb WHERE country = 'IN' GROUP BY 1", MEMBERS)(
    lambda e: C.rolled_up(e.user_bitmaps().where("country = 'IN'"), ("video_type",), "users")
)
query("last_seen", "SELECT video_session_id, max(event_timestamp) AS last_ts FROM ev GROUP BY 1")(lambda e: C.last_seen(e.events))
query("dim_values", "SELECT DISTINCT 'platform' AS dim, platform AS value FROM ev UNION SELECT 'country', country FROM ev")(lambda e: C.dim_values(e.events))
query("recent_sessions", f"SELECT ev.* FROM ev WHERE video_session_id IN (SELECT video_session_id FROM ev GROUP BY 1 HAVING max(event_timestamp) >= TIMESTAMP '{AS_OF}' - INTERVAL {CFG.lookback_seconds} SECOND)")(lambda e: C.recent_sessions(e.events, C.last_seen(e.events), e.cfg, AS_OF))
query("latest_version", "SELECT video_session_id, max_by(platform, (event_timestamp, platform)) AS platform, max(event_timestamp) AS version FROM ev GROUP BY 1")(
    lambda e: tiers.latest(e.events.groupBy("video_session_id", F.col("event_timestamp").alias("version")).agg(F.max("platform").alias("platform")), ("video_session_id",)).select("video_session_id", "platform", "version")
)
query("curve_dense", "SELECT * FROM de")(lambda e: serving.curve(e.now, e.cfg))
query(
    "curve_filtered",
    f"""SELECT minute, coalesce(c, 0)::BIGINT AS concurrent, coalesce(u, 0)::BIGINT AS concurrent_users
FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-05 00:00:00', TIMESTAMP '2024-01-12 12:00:00', INTERVAL {B} SECOND)) AS minute)
LEFT JOIN (SELECT minute, sum(concurrent) AS c, sum(concurrent_users) AS u FROM now WHERE platform = 'web' AND country = 'IN' GROUP BY 1) USING (minute)""",
)(lambda e: serving.curve(e.now, e.cfg, "2024-01-05 00:00:00", "2024-01-12 12:00", platform="web", country="IN", video_type="", content_id=""))
query("kpi_peak_avg", f"SELECT max(c) AS peak_concurrency, arg_min(minute, (-c, minute)) AS peak_minute, round(sum(c) / (SELECT date_diff('second', lo, hi) / {B} + 1 FROM bo), 1) AS avg_concurrency, arg_max(c, minute) AS last_minute_concurrency FROM cu")(lambda e: serving.kpis(e.now, e.cfg))
STARTS = "count(DISTINCT CASE WHEN event_type = 'VideoSessionStart' THEN video_session_id END) AS sessions_started, count(DISTINCT CASE WHEN event_type = 'VideoSessionEnd' THEN video_session_id END) AS sessions_ended"
query("sessions_started_ended", f"SELECT {STARTS} FROM ev LEFT JOIN cd USING (content_id) WHERE event_timestamp BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' AND video_type = 'live' AND content_id = 4")(
    lambda e: serving.started_ended(e.events, e.content, "2024-01-05", "2024-01-20", video_type="live", content_id="4")
)
query("new_users", "SELECT count(*) AS new_users FROM (SELECT min(event_timestamp) AS f FROM ev GROUP BY user_id) WHERE f BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-25'")(lambda e: serving.new_users(e.events, "2024-01-02", "2024-01-25"))
query("arrivals_departures", f"SELECT {_floor('event_timestamp')} AS minute, {STARTS} FROM ev WHERE country = 'US' GROUP BY 1")(lambda e: serving.arrivals(e.events, e.content, e.cfg, country="US"))
query("peak_by_platform", _peak("now", "platform", where="country = 'GB'"))(lambda e: serving.peak_by(e.now, ("platform",), country="GB"))
query("peak_by_platform_country", _peak("now", "platform, country"))(lambda e: serving.peak_by(e.now, ("platform", "country")))
query("peak_by_content_users", _peak("now", "content_id", "concurrent_users"))(lambda e: serving.peak_by(e.now, ("content_id",), "concurrent_users"))
query("top_content", f"SELECT content_id, coalesce(title, 'Unknown (' || content_id || ')') AS title, peak, peak_minute FROM (SELECT * FROM ({_peak('now', 'content_id')}) ORDER BY peak DESC, content_id LIMIT 20) LEFT JOIN cd USING (content_id)")(lambda e: serving.top_content(e.now, e.content))
for unit in ("hour", "day"):
    query(f"{unit}_grain", f"SELECT date_trunc('{unit}', minute)::TIMESTAMP AS {unit}, max(concurrent) AS peak_concurrency, round(avg(concurrent), 1) AS avg_concurrency FROM de GROUP BY 1")(lambda e, unit=unit: serving.grain(e.now, e.cfg, unit))
query(
    "drilldown_ext",
    f"""SELECT max(c)::BIGINT AS peak_concurrency, arg_min(minute, (-c, minute)) AS peak_minute, round(sum(c) / (SELECT date_diff('second', min(minute), max(minute)) / {B} + 1 FROM ex), 1) AS avg_concurrency, arg_max(c, minute)::BIGINT AS last_minute_concurrency
FROM (SELECT minute, sum(concurrent) AS c FROM ex WHERE audio_language = 'hin' AND player_version = 'p1' GROUP BY 1)""",
)(lambda e: serving.kpis(e.cells_extended, e.cfg, audio_language="hin", player_version="p1", app_version=""))
for column in ("platform", "country"):
    query(f"dropdown_{column}", f"SELECT DISTINCT {column} FROM ev")(lambda e, column=column: serving.dropdown_of(C.dim_values(e.events), column))
for column in ("video_type", "category"):
    query(f"dropdown_{column}", f"SELECT DISTINCT {column} FROM cd")(lambda e, column=column: serving.dropdown(e.content, column))
query("dropdown_content", "SELECT content_id, title FROM cd ORDER BY title, content_id LIMIT 1000")(lambda e: serving.dropdown(e.content, "content_id", "title", limit=1000))
for name, column in (("audio", "audio_language"), ("subtitle", "subtitle_language"), ("player_version", "player_version"), ("app_version", "app_version")):
    query(f"dropdown_{name}", f"SELECT DISTINCT {column} FROM ex")(lambda e, column=column: serving.dropdown(e.cells_extended, column))
query("dropdown_title", "SELECT DISTINCT content_id, title FROM ex")(lambda e: serving.dropdown(e.cells_extended, "content_id", "title"))
query("time_bounds", "SELECT min(minute) AS from_ts, max(minute) AS to_ts FROM now")(lambda e: serving.bounds(e.now, "minute"))
for value in ("concurrent", "concurrent_users"):
    query(f"peak_avg_{value}", f"SELECT max(c)::BIGINT AS peak, arg_min(minute, (-c, minute)) AS peak_minute, round(sum(c) / (date_diff('second', min(minute), max(minute)) / {B} + 1), 6) AS avg FROM (SELECT minute, sum({value}) AS c FROM now GROUP BY 1)")(lambda e, value=value: serving.peak_avg(e.now, e.cfg, value))
query("exact_totals", "SELECT minute, count(DISTINCT video_session_id) AS sessions, count(DISTINCT user_id) AS users FROM atm GROUP BY 1")(lambda e: serving.exact_totals(e.atoms))
query("naive_comparator", f"SELECT minute, c AS served, coalesce(naive, 0) AS naive FROM (SELECT minute, sum(concurrent)::BIGINT AS c FROM sa GROUP BY 1) LEFT JOIN (SELECT {_floor('event_timestamp')} AS minute, count(DISTINCT video_session_id) AS naive FROM ev WHERE event_type = 'VideoHeartbeat' GROUP BY 1) USING (minute)")(lambda e: validation.naive_comparison(e.events, e.cells, e.cfg))
MISMATCH = f"FROM (SELECT {KEYS}, concurrent AS a, concurrent_users AS ua FROM sa) FULL JOIN (SELECT {KEYS}, concurrent AS b, concurrent_users AS ub FROM si) USING ({KEYS}) WHERE coalesce(a, 0) <> coalesce(b, 0) OR coalesce(ua, 0) <> coalesce(ub, 0)"
query("compare_sa_si", f"SELECT {KEYS}, coalesce(a, 0) AS concurrent_a, coalesce(b, 0) AS concurrent_b, coalesce(ua, 0) AS concurrent_users_a, coalesce(ub, 0) AS concurrent_users_b {MISMATCH}")(lambda e: validation.differences(e.cells, e.cells_independent, (*C.CORE_DIMS, "minute")))
query("scorecard", f"SELECT (SELECT count(*) FROM sa) AS cells_sa, (SELECT sum(concurrent)::BIGINT FROM sa) AS total_sa, (SELECT count(*) FROM si) AS cells_si, (SELECT sum(concurrent)::BIGINT FROM si) AS total_si, (SELECT count(*) {MISMATCH}) AS cell_mismatches")(lambda e: validation.scorecard(e.cells, e.cells_independent))
query("ext_rollup", f"SELECT {KEYS}, coalesce(a, 0)::BIGINT AS concurrent_a, coalesce(b, 0) AS concurrent_b FROM (SELECT {KEYS}, sum(concurrent) AS a FROM ex GROUP BY ALL) FULL JOIN (SELECT {KEYS}, concurrent AS b FROM sa) USING ({KEYS}) WHERE coalesce(a, 0) <> coalesce(b, 0)")(lambda e: validation.rollup_differences(e.cells_extended, e.cells))
query("array_segments", "SELECT video_session_id, user_id, platform, content_id, country, seg_start, seg_end FROM sg")(lambda e: validation.array_segments(e.events, e.cfg))
query("array_anti_joins", "SELECT 0::BIGINT AS only_arrays, 0::BIGINT AS only_windows, count(*) AS by_arrays FROM (SELECT DISTINCT video_session_id, minute FROM mb)", MEMBERS)(
    lambda e: validation.array_atoms_differences(e.events, e.atoms, e.cfg)
)
query("pause_exclusion", "SELECT count(*) AS deactivated_instants, count(DISTINCT video_session_id) AS sessions_with_paused_state, (SELECT count(*) FROM st JOIN iv USING (video_session_id) WHERE state = -1 AND active_start <= ts AND ts < active_end) AS inside_active_interval FROM st WHERE state = -1")(lambda e: validation.paused_inside(e.events, e.intervals))
query(
    "start_seeding",
    """SELECT count(*) AS start_only_sessions, count(h.video_session_id) AS with_active_interval, count(*) - count(h.video_session_id) AS missing
FROM (SELECT video_session_id FROM ev GROUP BY 1 HAVING count(*) FILTER (event_type = 'VideoSessionStart') > 0 AND count(*) FILTER (event_type = 'VideoHeartbeat') > 0
  AND count(*) FILTER (event_type IN ('VideoPlay', 'AppForegrounded') OR event IN ('resume', 'speed-resume', 'AdResume')) = 0) s
LEFT JOIN (SELECT DISTINCT video_session_id FROM iv) h USING (video_session_id)""",
)(lambda e: validation.start_only(e.events, e.intervals))
query(
    "lead_in",
    """SELECT count(*) AS sessions_with_start_and_play, count(*) FILTER (g > 0) AS sessions_with_lead_in, round(100.0 * count(*) FILTER (g > 0) / count(*), 1) AS pct_with_lead_in, round(avg(g) FILTER (g > 0), 1) AS avg_lead_in_seconds
FROM (SELECT date_diff('second', min(event_timestamp) FILTER (event_type = 'VideoSessionStart'), min(event_timestamp) FILTER (event_type = 'VideoPlay' OR event IN ('resume', 'speed-resume', 'AdResume'))) AS g FROM ev GROUP BY video_session_id) WHERE g IS NOT NULL""",
)(lambda e: validation.lead_in(e.events))
query("interval_repeats", f"SELECT video_session_id, {_floor('active_start')} AS minute, count(*) AS intervals_in_minute FROM iv GROUP BY ALL HAVING count(*) > 1")(lambda e: validation.repeats_in_bucket(e.intervals, e.cfg))
for resumes, grace, gap in ((0, H, H), (1, H // 2, G), *((r, grace, gap) for r in (0, 1) for grace in (0, H) for gap in (G, G * 4 // 3))):
    name = f"knob_sweep_{resumes}_{grace}_{gap}"
    on = "event_type = 'VideoPlay' OR event IN ('resume', 'speed-resume', 'AdResume')" + (" OR event_type = 'AppForegrounded'" if resumes else "")
    off = "event_type IN ('AppBackgrounded', 'VideoSessionEnd', 'VideoError') OR event IN ('pause', 'speed-pause', 'AdPause')"
    QUERIES[name] = lambda spark, sf_dir, knobs=(bool(resumes), grace, gap): plain(engine(spark, sf_dir).sweep(*knobs))
    ORACLE_SQL[name] = f"WITH {testdata.CTES},{_states(on, off)},{_segments(grace, gap)},{_islands(False)} SELECT {KEYS}, count(DISTINCT video_session_id) AS concurrent FROM ({_expanded('isl', 'active_start', 'active_end')}) GROUP BY ALL"


# Served figures held against the reference: cells from arrays of events, without windows and islands.
def _reference(e: Engine) -> DataFrame:
    return validation.array_cells(e.events, e.content, e.cfg)


def _both(source: str, columns: str, values: str) -> str:
    """SQL of a result in which both sides have the values of `source`."""
    sides = ", ".join(f"{v} AS {v}_{side}" for v in values.split(", ") for side in ("served", "reference"))
    return f"SELECT {columns}, {sides}, true AS agree FROM {source}"


CELL = (*CORE_DIMS, "minute")
query("reconcile_minutes", "SELECT minute, c AS session_aware, c AS session_independent, c AS served, true AS agree FROM per", MEMBERS)(
    lambda e: validation.three_way(session_aware=e.cells, session_independent=e.cells_independent, served=tiers.serve(e.cold, e.hot))
)
query("reconcile_cells", _both("ind", KEYS, "concurrent, concurrent_users"), MEMBERS)(lambda e: validation.beside(e.now, _reference(e), CELL, validation.VALUES, ("served", "reference")))
query("reconcile_served_exact", "SELECT minute, c AS served, exact FROM per JOIN (SELECT minute, count(DISTINCT video_session_id) AS exact FROM mb GROUP BY 1) USING (minute) WHERE c <> exact", MEMBERS)(
    lambda e: validation.served_and_exact(e.now, e.atoms)
)
query("compare_peaks", _both(f"({_peak('ind', 'country, platform')})", "country, platform", "peak, peak_minute").replace("_served", "_sa").replace("_reference", "_si"), MEMBERS)(
    lambda e: validation.beside(*(serving.peak_by(c, ("country", "platform")) for c in (e.cells, e.cells_independent)), ("country", "platform"), ("peak", "peak_minute"), ("sa", "si"))
)
for value, short in (("concurrent", "c"), ("concurrent_users", "u")):
    query(
        f"reconcile_peak_avg_{value}",
        f"SELECT unnest(['served', 'reference']) AS side, max({short})::BIGINT AS peak, arg_min(minute, (-{short}, minute)) AS peak_minute, round(sum({short}) / (date_diff('second', min(minute), max(minute)) / {B} + 1), 6) AS avg FROM per",
        MEMBERS,
    )(lambda e, value=value: serving.peak_avg(e.now, e.cfg, value).withColumn("side", F.lit("served")).unionByName(serving.peak_avg(_reference(e), e.cfg, value).withColumn("side", F.lit("reference"))))
for name, keys in (("platform", ("platform",)), ("platform_country", ("platform", "country")), ("content", ("content_id",))):
    query(f"reconcile_peak_{name}", _both(f"({_peak('ind', ', '.join(keys))})", ", ".join(keys), "peak, peak_minute"), MEMBERS)(
        lambda e, keys=keys: validation.beside(*(serving.peak_by(c, keys) for c in (e.now, _reference(e))), keys, ("peak", "peak_minute"), ("served", "reference"))
    )
for unit in ("hour", "day"):
    query(f"reconcile_peak_{unit}", _both(f"(SELECT date_trunc('{unit}', minute)::TIMESTAMP AS {unit}, max(c)::BIGINT AS peak, arg_min(minute, (-c, minute)) AS peak_minute FROM per GROUP BY 1)", unit, "peak, peak_minute"), MEMBERS)(
        lambda e, unit=unit: validation.beside(*(serving.peak_in(c, unit) for c in (e.now, _reference(e))), (unit,), ("peak", "peak_minute"), ("served", "reference"))
    )
query(
    "reconcile_foreground",
    f"SELECT sum(c)::BIGINT AS served, sum(c)::BIGINT AS reference, (SELECT sum(n)::BIGINT FROM (SELECT {_floor('event_timestamp')} AS minute, count(DISTINCT video_session_id) AS n FROM ev WHERE event_type = 'VideoHeartbeat' GROUP BY 1)) AS naive FROM per",
    MEMBERS,
)(lambda e: validation.totals(served=(e.now, "concurrent"), reference=(_reference(e), "concurrent"), naive=(C.naive(e.events, e.cfg), "naive")))
query("reconcile_extended", _both("inx", EXTENDED_KEYS, "concurrent, concurrent_users"), MEMBERS)(
    lambda e: validation.beside(e.cells_extended, validation.array_cells_extended(e.events, e.content, e.cfg), (*CELL, *EXTENDED_DIMS), validation.VALUES, ("served", "reference"))
)
query("reconcile_rollup", f"SELECT {KEYS}, concurrent AS concurrent_extended, concurrent AS concurrent_core, true AS agree FROM ind", MEMBERS)(
    lambda e: validation.beside(e.cells_extended.groupBy(*CELL).agg(F.sum("concurrent").alias("concurrent")), e.now, CELL, ("concurrent",), ("extended", "core"))
)
query(
    "start_seeding_samples",
    """SELECT video_session_id, session_start_ts, active_start, active_end, interval_count
FROM (SELECT video_session_id, min(event_timestamp) AS session_start_ts FROM ev GROUP BY 1 HAVING count(*) FILTER (event_type = 'VideoSessionStart') > 0 AND count(*) FILTER (event_type = 'VideoHeartbeat') > 0
  AND count(*) FILTER (event_type IN ('VideoPlay', 'AppForegrounded') OR event IN ('resume', 'speed-resume', 'AdResume')) = 0)
JOIN (SELECT video_session_id, min(active_start) AS active_start, max(active_end) AS active_end, count(*) AS interval_count FROM iv GROUP BY 1) USING (video_session_id)
ORDER BY session_start_ts DESC, video_session_id LIMIT 10""",
)(lambda e: validation.start_only_samples(e.events, e.intervals))
query(
    "pause_samples",
    """SELECT video_session_id, paused_instants, active_intervals, first_active, last_active FROM (SELECT video_session_id, count(*) AS paused_instants FROM st WHERE state = -1 GROUP BY 1)
JOIN (SELECT video_session_id, count(*) AS active_intervals, min(active_start) AS first_active, max(active_end) AS last_active FROM iv GROUP BY 1) USING (video_session_id) ORDER BY paused_instants DESC, video_session_id LIMIT 10""",
)(lambda e: validation.paused_samples(e.events, e.intervals))
