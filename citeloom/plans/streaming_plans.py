"""Ordered replays and streaming operators over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions import constants as K, scoring as S
from citeloom.operators.aggregates import with_cost
from citeloom.streaming import operators as L, replay as P, steps
from citeloom.streaming.run import run_append, run_arrivals, run_update

from .registry import query
from .scalar_plans import COST_SQL
from .views import AS_OF

_ORDERED = "o AS (SELECT key_id, event_id, epoch_us(ts) AS us, status, row_number() OVER (PARTITION BY key_id ORDER BY ts, event_id) AS n FROM usage)"
_ADMIT = f"""{_ORDERED},
f AS (SELECT key_id, event_id, n, us, true AS allowed, '' AS reason, [us] AS seen FROM o WHERE n = 1
  UNION ALL SELECT key_id, event_id, n, us, v = '', v, CASE WHEN v = '' THEN list_append(w, us) ELSE w END FROM (
    SELECT *, CASE WHEN len([x for x in w if x > us - 60000000]) >= 1 THEN 'minute' WHEN len([x for x in w if x > us - 3600000000]) >= 1 THEN 'hour' WHEN len(w) >= 2 THEN 'day' ELSE '' END AS v FROM (
      SELECT o.key_id, o.event_id, o.n, o.us, [x for x in f.seen if x > o.us - 86400000000] AS w FROM f JOIN o ON o.key_id = f.key_id AND o.n = f.n + 1)))"""


@query("admission_replay", f"WITH RECURSIVE {_ADMIT} SELECT key_id, event_id, allowed, reason FROM f")
def admission_replay(t):
    return P.replay(t("usage"), steps.admission(1, 1, 2), "allowed boolean, reason string")


_RATE = 1 / 21600


@query("token_bucket_replay", f"""
WITH RECURSIVE {_ORDERED},
f AS (SELECT key_id, event_id, n, us, 3e0 - 1 AS tokens, true AS allowed, 0e0 AS wait FROM o WHERE n = 1
  UNION ALL SELECT key_id, event_id, n, us, CASE WHEN k >= 1 THEN k - 1 ELSE k END, k >= 1, CASE WHEN k >= 1 THEN 0 ELSE (1 - k) / {_RATE!r} END FROM (SELECT o.key_id, o.event_id, o.n, o.us, least(3e0, f.tokens + (o.us - f.us) / 1e6 * {_RATE!r}) AS k FROM f JOIN o ON o.key_id = f.key_id AND o.n = f.n + 1))
SELECT key_id, event_id, allowed, round(wait, 3) AS retry_after FROM f""")
def token_bucket_replay(t):
    return P.replay(t("usage"), steps.token_bucket(_RATE, 3), "allowed boolean, retry_after double").withColumn("retry_after", S.rounded(F.col("retry_after"), 3))


_BREAKER = f"""{_ORDERED.replace('status,', "status <> 'error' AS ok,")},
b AS (SELECT key_id, 0::BIGINT AS n, 0::BIGINT AS event_id, 'closed' AS state, 0 AS fails, 0 AS succ, 0 AS trials, 0::BIGINT AS opened, false AS allowed FROM o WHERE n = 1
  UNION ALL SELECT key_id, n, event_id, CASE WHEN rej THEN s0 WHEN ok AND s0 = 'half_open' AND succ + 1 >= 3 THEN 'closed' WHEN NOT ok AND (s0 = 'half_open' OR fails + 1 >= 5) THEN 'open' ELSE s0 END,
    CASE WHEN rej THEN fails WHEN ok AND s0 = 'half_open' AND succ + 1 >= 3 THEN 0 WHEN ok THEN fails ELSE fails + 1 END, CASE WHEN rej THEN succ WHEN ok AND s0 = 'half_open' AND succ + 1 >= 3 THEN 0 WHEN ok THEN succ + 1 ELSE succ END,
    CASE WHEN NOT rej AND s0 = 'half_open' THEN t0 + 1 ELSE t0 END, CASE WHEN NOT rej AND NOT ok AND (s0 = 'half_open' OR fails + 1 >= 5) THEN us ELSE opened END, NOT rej
  FROM (SELECT *, s0 = 'open' OR (s0 = 'half_open' AND t0 >= 3) AS rej FROM (
    SELECT o.key_id, o.n, o.event_id, o.ok, o.us, b.fails, b.succ, b.opened, CASE WHEN b.state = 'open' AND o.us - b.opened >= 86400000000 THEN 'half_open' ELSE b.state END AS s0,
      CASE WHEN b.state = 'open' AND o.us - b.opened >= 86400000000 THEN 0 ELSE b.trials END AS t0 FROM b JOIN o ON o.key_id = b.key_id AND o.n = b.n + 1)))"""


@query("circuit_breaker_replay", f"WITH RECURSIVE {_BREAKER} SELECT key_id, event_id, allowed, state FROM b WHERE n > 0")
def circuit_breaker_replay(t):
    usage = t("usage").withColumn("ok", F.col("status") != "error")
    return P.replay(usage, steps.circuit_breaker(recovery=86400), "allowed boolean, state string", ok="ok")


_HOURLY = "h AS (SELECT user_id % 5 AS shard, date_trunc('hour', ts) AS ts, COUNT(*) AS n FROM events GROUP BY 1, 2), s AS (SELECT *, n >= 3 AS hot FROM h)"


@query("sustained_alert_batch", f"""
WITH {_HOURLY}, p AS (SELECT *, CASE WHEN hot AND NOT coalesce(lag(hot) OVER (PARTITION BY shard ORDER BY ts), false) THEN 1 ELSE 0 END AS st FROM s),
r AS (SELECT *, SUM(st) OVER (PARTITION BY shard ORDER BY ts) AS run FROM p), g AS (SELECT shard, run, MIN(ts) AS since, MAX(ts) AS until FROM r WHERE hot GROUP BY 1, 2)
SELECT shard, since, until FROM g WHERE until - since >= INTERVAL 3 HOUR""")
def sustained_alert_batch(t):
    hourly = t("events").groupBy((F.col("user_id") % 5).alias("shard"), F.date_trunc("hour", F.col("ts")).alias("ts")).agg(F.count("*").alias("n"))
    return P.sustained_spans(hourly.withColumn("hot", F.col("n") >= 3), ["shard"], "ts", "hot", 3 * 3600, lambda: F.to_date("ts"))


# Streams ----------------------------------------------------------------------

def _events(t):
    return L.event_stream(t.spark, t.sf_dir, "events.parquet")


@query("stream_event_source", "SELECT event_type, COUNT(*) AS n FROM events GROUP BY event_type")
def stream_event_source(t):
    rows = run_append(_events(t).select("event_id", "event_type"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"))


# Append mode emits a window once the watermark (newest event less the delay) passes its end.
_WM = "(SELECT MAX(ts) FROM events) - INTERVAL {0}"


@query("tumbling_counts", f"""
SELECT CAST(time_bucket(INTERVAL 1 DAY, ts) AS DATE) AS day, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2 HAVING CAST(time_bucket(INTERVAL 1 DAY, ts) AS DATE) + INTERVAL 1 DAY <= {_WM.format('1 HOUR')}""")
def tumbling_counts(t):
    return run_append(L.tumbling_counts(_events(t), ["event_type"])).select(F.to_date("start").alias("day"), "event_type", "n")


def _slides(width: int, slide: int) -> str:
    return f"""w AS (SELECT epoch(ts) AS e, event_type, value, unnest(range(0, {width // slide})) AS k FROM events), b AS (SELECT CAST(floor(e / {slide}) AS BIGINT) * {slide} - k * {slide} AS start, event_type, value FROM w)"""


_KEPT = "start + 3600 <= (SELECT epoch(MAX(ts)) FROM events) - 3600"


@query("sliding_error_rate", f"""
WITH {_slides(3600, 600)} SELECT start, COUNT(*) AS n, round(COUNT(*) FILTER (event_type = 'error' AND value > 20) / COUNT(*), 6) AS error_rate, round(COUNT(*) FILTER (event_type = 'error' AND value > 20) / COUNT(*), 6) > 0.05 AS firing
FROM b WHERE {_KEPT} GROUP BY start""")
def sliding_error_rate(t):
    failed = (F.col("event_type") == "error") & (F.col("value") > 20)
    out = run_append(L.sliding_error_rate(_events(t), failed, "1 hour", "10 minutes", "1 hour"))
    return out.select(F.unix_seconds("start").alias("start"), "n", "error_rate", "firing")


_BOUNDS = [0.0, *K.HISTOGRAM_BOUNDS]
_P95 = "CASE " + " ".join(
    f"WHEN b{i} >= n * 0.95 THEN {lo} + {hi - lo!r} * (n * 0.95 - {f'b{i - 1}' if i > 1 else '0'}) / (b{i} - {f'b{i - 1}' if i > 1 else '0'})"
    for i, (lo, hi) in enumerate(zip(_BOUNDS, _BOUNDS[1:]), 1)) + f" ELSE {_BOUNDS[-1]} END"
_BUCKETS = ", ".join(f"COUNT(*) FILTER (value / 100 <= {hi}) AS b{i}" for i, hi in enumerate(K.HISTOGRAM_BOUNDS, 1))


@query("sliding_p95", f"""
WITH {_slides(3600, 600)}, h AS (SELECT start, COUNT(*) AS n, {_BUCKETS} FROM b WHERE {_KEPT} GROUP BY start)
SELECT start, n, round({_P95}, 6) AS p95, round({_P95}, 6) > 2 AS firing FROM h""")
def sliding_p95(t):
    stream = _events(t).withColumn("latency", F.col("value") / 100)
    out = run_append(L.sliding_p95(stream, "latency", "1 hour", "10 minutes", "1 hour"))
    return out.select(F.unix_seconds("start").alias("start"), "n", "p95", "firing")


@query("session_windows", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS sess FROM g)
SELECT user_id, epoch_us(MIN(ts)) AS start_us, COUNT(*) AS n FROM s GROUP BY user_id, sess HAVING MAX(ts) + INTERVAL 6 HOUR <= (SELECT MAX(ts) FROM events) - INTERVAL 1 HOUR""")
def session_windows(t):
    out = run_append(L.session_windows(_events(t), ["user_id"], "6 hours"))
    return out.select("user_id", F.unix_micros("start").alias("start_us"), "n")


@query("dedupe_stream", "SELECT user_id, props, COUNT(DISTINCT (user_id, props)) AS n FROM events GROUP BY 1, 2")
def dedupe_stream(t):
    out = run_append(L.dedupe_stream(_events(t), ["user_id", "props"], "40 days").select("user_id", "props"))
    return out.groupBy("user_id", "props").agg(F.count("*").alias("n"))


@query("live_counters", "SELECT event_type, COUNT(*) AS requests, arg_max(value, ts) AS last_value, round(SUM(value), 4) AS total FROM events GROUP BY event_type")
def live_counters(t):
    return run_update(L.live_counters(_events(t), ["event_type"], "value"), ["event_type"]).withColumn("total", S.rounded(F.col("total"), 4))


@query("budget_monitor_stream", f"""
WITH c AS (SELECT strftime(ts, '%Y-%m') AS month, round(SUM({COST_SQL}), 6) AS cost FROM usage GROUP BY 1)
SELECT month, cost, CASE WHEN cost > 100 THEN 'budget_exceeded' WHEN cost > 80 THEN 'budget_warning' ELSE 'ok' END AS state FROM c""")
def budget_monitor_stream(t):
    u = F.col("user_id") % 4
    provider = F.when(u == 0, "anthropic").when(u == 1, "openai").when(u == 2, "google").otherwise("github")
    tokens = F.when(F.col("event_id") % 10 != 0, F.floor(F.col("value") * 100))
    return run_update(L.budget_monitor(_events(t), S.estimate_cost(provider, tokens)), ["month"])


# Arrivals: the watermark of a part is the newest event of the parts before it less the delay, in whole milliseconds.
_DELAY_MS = 48 * 3_600_000
_DELAY = "48 hours"


def _judged(where: str = "true") -> str:
    return f"""e AS (SELECT *, epoch_us(ts) AS us FROM arrivals WHERE {where}), mk AS (SELECT arrival, MAX(us) // 1000 AS ms FROM e GROUP BY arrival),
wm AS (SELECT a.arrival, coalesce((SELECT MAX(ms) FROM mk WHERE mk.arrival < a.arrival) - {_DELAY_MS}, 0) AS passed FROM mk a),
j AS (SELECT e.*, passed, (SELECT MAX(ms) FROM mk) - {_DELAY_MS} AS final FROM e JOIN wm USING (arrival))"""


_RELEASED = f"""{_judged()},
o AS (SELECT user_id AS key_id, event_id, us, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS n FROM j WHERE us > passed * 1000 AND us <= final * 1000)"""
_LATE = "SELECT user_id, event_id, NULL, NULL, true FROM j WHERE us <= passed * 1000"
_STREAM_ADMIT = _ADMIT.replace(_ORDERED, _RELEASED)
_STREAM_BREAKER = _BREAKER[_BREAKER.index("b AS ("):]


def _arrivals(t):
    rows = t("arrivals")
    return [rows.filter(F.col("arrival") == k).drop("arrival") for k in (1, 2, 3)]


def _machine(t, machine, verdicts, **options):
    return run_arrivals(_arrivals(t), lambda events: L.run_machine(events, machine, verdicts, delay=_DELAY, delay_us=_DELAY_MS * 1000, **options))


@query("stateful_rate_limiter", f"WITH RECURSIVE {_STREAM_ADMIT} SELECT key_id AS user_id, event_id, allowed, reason, false AS late FROM f UNION ALL {_LATE}")
def stateful_rate_limiter(t):
    return _machine(t, steps.admission(1, 1, 2), "allowed boolean, reason string")


# The burst bucket refills by a token a minute; a rejected burst leaves the windows alone, a rejected window has spent its token.
@query("combined_rate_limiter", f"""
WITH RECURSIVE {_RELEASED},
f AS (SELECT key_id, event_id, n, us, 2e0 - 1 AS tokens, true AS allowed, '' AS reason, [us] AS seen FROM o WHERE n = 1
  UNION ALL SELECT key_id, event_id, n, us, CASE WHEN k >= 1 THEN k - 1 ELSE k END, v = '', v, CASE WHEN v = '' THEN list_append(w, us) ELSE w END FROM (
    SELECT *, CASE WHEN k < 1 THEN 'burst' WHEN len([x for x in w if x > us - 60000000]) >= 1 THEN 'minute' WHEN len([x for x in w if x > us - 3600000000]) >= 1 THEN 'hour' ELSE '' END AS v FROM (
      SELECT o.key_id, o.event_id, o.n, o.us, least(2e0, f.tokens + (o.us - f.us) / 1e6 * (1e0 / 60)) AS k, [x for x in f.seen if x > o.us - 86400000000] AS w FROM f JOIN o ON o.key_id = f.key_id AND o.n = f.n + 1)))
SELECT key_id AS user_id, event_id, allowed, reason, false AS late FROM f UNION ALL {_LATE}""")
def combined_rate_limiter(t):
    return _machine(t, steps.combined_limiter(1, 1, 2), "allowed boolean, reason string")


@query("circuit_breaker_stream", f"WITH RECURSIVE {_RELEASED}, {_STREAM_BREAKER} SELECT key_id AS user_id, event_id, allowed, state, false AS late FROM b WHERE n > 0 UNION ALL {_LATE}")
def circuit_breaker_stream(t):
    return _machine(t, steps.circuit_breaker(recovery=86400), "allowed boolean, state string", ok=F.col("event_type") != "error")


# A key that is idle for six hours starts anew, so its day's two admissions are forgotten.
_TTL_US = 6 * 3_600_000_000


@query("ttl_state", f"""
WITH RECURSIVE {_STREAM_ADMIT.replace("SELECT o.key_id, o.event_id, o.n, o.us, [x for x in f.seen if x > o.us - 86400000000] AS w", f"SELECT o.key_id, o.event_id, o.n, o.us, CASE WHEN o.us - f.us > {_TTL_US} THEN [] ELSE [x for x in f.seen if x > o.us - 86400000000] END AS w")}
SELECT key_id AS user_id, event_id, allowed, reason FROM f""")
def ttl_state(t):
    return _machine(t, steps.admission(1, 1, 2), "allowed boolean, reason string", ttl_us=_TTL_US).filter("NOT late").drop("late")


@query("bounded_buffer", "SELECT user_id, event_id, CAST(rn AS INT) AS newest FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 5")
def bounded_buffer(t):
    return run_append(L.bounded_buffer(_events(t), 5))


@query("heartbeat_liveness", "SELECT user_id, epoch_us(MAX(ts)) // 1000 AS last_ms FROM events GROUP BY user_id HAVING MAX(ts) + INTERVAL 1 HOUR < (SELECT MAX(ts) FROM events) - INTERVAL 1 MINUTE")
def heartbeat_liveness(t):
    return run_append(L.heartbeat_liveness(_events(t), 3600, "1 minute"))


_HOUR_US = 3_600_000_000
_SAMPLES = f"""{_judged()}, h AS (SELECT user_id % 5 AS shard, us // {_HOUR_US} * {_HOUR_US} AS us, COUNT(*) AS n FROM j WHERE us // {_HOUR_US} * {_HOUR_US} + {_HOUR_US} > passed * 1000 AND us // {_HOUR_US} * {_HOUR_US} + {_HOUR_US} <= final * 1000 GROUP BY 1, 2),
s AS (SELECT *, n >= 3 AS hot FROM h)"""


@query("sustained_alert", f"""
WITH {_SAMPLES}, p AS (SELECT *, CASE WHEN hot AND NOT coalesce(lag(hot) OVER (PARTITION BY shard ORDER BY us), false) THEN 1 ELSE 0 END AS st FROM s),
r AS (SELECT *, SUM(st) OVER (PARTITION BY shard ORDER BY us) AS run FROM p), g AS (SELECT shard, run, MIN(us) AS since, MAX(us) AS until FROM r WHERE hot GROUP BY 1, 2)
SELECT shard, since AS since_us FROM g WHERE until - since >= 3 * {_HOUR_US}""")
def sustained_alert(t):
    def build(events):
        counts = L.tumbling_counts(events.withColumn("shard", F.col("user_id") % 5), ["shard"], "1 hour", _DELAY)
        return L.sustained_alert(counts.select("shard", F.col("start").alias("ts"), (F.col("n") >= 3).alias("hot")), 3 * 3600, "shard")

    return run_arrivals(_arrivals(t), build)


@query("phase_pairing_stream", f"""
WITH {_judged("event_type IN ('signup', 'purchase')")}, side AS (SELECT arrival, event_type, MAX(us) // 1000 AS ms FROM e GROUP BY 1, 2),
low AS (SELECT arrival, MIN(ms) AS ms FROM (SELECT a.arrival, s.event_type, MAX(s.ms) AS ms FROM (SELECT DISTINCT arrival FROM side) a JOIN side s ON s.arrival <= a.arrival GROUP BY 1, 2) GROUP BY 1),
k AS (SELECT e.*, coalesce((SELECT MAX(ms) FROM low WHERE low.arrival < e.arrival) - {_DELAY_MS}, 0) AS mark, (SELECT MAX(ms) FROM low) - {_DELAY_MS} AS last FROM e),
ok AS (SELECT * FROM k WHERE us > mark * 1000), s AS (SELECT * FROM ok WHERE event_type = 'signup'), c AS (SELECT * FROM ok WHERE event_type = 'purchase'),
m AS (SELECT s.event_id, s.user_id AS run_id, s.us AS started_us, c.us AS ended_us FROM s JOIN c ON c.user_id = s.user_id AND c.us >= s.us AND c.us <= s.us + 12 * {_HOUR_US})
SELECT run_id, started_us, ended_us, 'completed' AS state FROM m
UNION ALL SELECT user_id, us, NULL, 'timed_out' FROM s WHERE event_id NOT IN (SELECT event_id FROM m) AND us + 12 * {_HOUR_US} < last * 1000""")
def phase_pairing_stream(t):
    def build(events):
        side = lambda kind: events.filter(F.col("event_type") == kind).select(F.col("user_id").alias("run_id"), "ts")
        return L.phase_pairing(side("signup"), side("purchase"), "12 HOURS", _DELAY)

    return run_arrivals(_arrivals(t), build).select("run_id", F.unix_micros("started").alias("started_us"), F.unix_micros("ended").alias("ended_us"), "state")


_DAY_US = 86_400_000_000


@query("late_data_policy", f"""
WITH {_judged()}, d AS (SELECT us // {_DAY_US} * {_DAY_US} AS start_us, passed, final FROM j)
SELECT start_us, 'accepted' AS policy, COUNT(*) AS n FROM d WHERE start_us + {_DAY_US} > passed * 1000 AND start_us + {_DAY_US} <= final * 1000 GROUP BY 1
UNION ALL SELECT start_us, 'rejected', COUNT(*) FROM d WHERE start_us + {_DAY_US} <= passed * 1000 GROUP BY 1""")
def late_data_policy(t):
    accepted = run_arrivals(_arrivals(t), lambda events: L.tumbling_counts(events, [], "1 day", _DELAY))
    rejected = run_arrivals(_arrivals(t), lambda events: L.late_rows(events, "1 day", _DELAY))
    counted = accepted.select(F.unix_micros("start").alias("start_us"), F.lit("accepted").alias("policy"), "n")
    return counted.unionByName(rejected.groupBy((F.col("end_us") - _DAY_US).alias("start_us")).agg(F.lit("rejected").alias("policy"), F.count("*").alias("n")))
