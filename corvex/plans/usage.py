"""Usage analytics over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvex.operators import usage as U

from .registry import query
from .tables import ACTIVITY_SQL, DAY_MS, HALF_DAY_MS, NOTES_SQL, activity, notes

A = f"WITH {ACTIVITY_SQL} "
AN = f"WITH {ACTIVITY_SQL}, {NOTES_SQL} "
TODAY = "DATE '2024-01-28'"
NOW = 1_706_400_000_000  # 2024-01-28 00:00 UTC
EPISODES = f"""episodes AS (SELECT s.actor, s.t, (SELECT count(*) FROM activity p WHERE p.type = 'search' AND p.actor = s.actor AND p.t <= s.t) AS n,
  min(r.t) AS read_t, min(r.t) - s.t AS delay FROM activity s LEFT JOIN activity r ON r.type = 'read' AND r.actor = s.actor AND r.t BETWEEN s.t AND s.t + {HALF_DAY_MS}
  WHERE s.type = 'search' GROUP BY s.call_id, s.actor, s.t)"""


@query("usage_daily_counters", A + "SELECT day, id, count(*) FILTER (type = 'search') AS search, count(*) FILTER (type = 'read') AS read, count(*) FILTER (type = 'write') AS write FROM activity GROUP BY day, id")
def daily_counters(spark, d):
    return U.daily_counters(activity(spark, d))


@query("usage_retained_counters", A + "SELECT day, count(*) AS notes, sum(n) AS calls FROM (SELECT day, id, count(*) AS n FROM activity GROUP BY day, id) WHERE day > (SELECT max(day) FROM activity) - 14 GROUP BY day")
def retained(spark, d):
    kept = U.retain(U.daily_counters(activity(spark, d)), 14)
    return kept.groupBy("day").agg(F.count("*").alias("notes"), F.sum(F.col("search") + F.col("read") + F.col("write")).alias("calls"))


@query("usage_last_activity", A + "SELECT id, type, max(day) AS last_day FROM activity GROUP BY id, type")
def last_activity(spark, d):
    return U.last_activity(activity(spark, d))


COST = f"""cost AS (SELECT id, tokens, tokens * count(*) FILTER (type = 'read' AND day = {TODAY}) AS read_today_tokens, tokens * count(*) FILTER (type = 'read' AND day > {TODAY} - 7) AS read_window_tokens,
  tokens * count(*) FILTER (type = 'write' AND day = {TODAY}) AS write_today_tokens, tokens * count(*) FILTER (type = 'write' AND day > {TODAY} - 7) AS write_window_tokens
  FROM activity JOIN notes USING (id) GROUP BY id, tokens)"""


def _cost(spark, d):
    return U.token_cost(activity(spark, d), notes(spark, d), F.expr(TODAY))


@query("usage_token_cost", f"{AN}, {COST} SELECT * FROM cost")
def token_cost(spark, d):
    return _cost(spark, d)


@query("usage_top_cost", f"{AN}, {COST} SELECT id, read_window_tokens FROM cost ORDER BY read_window_tokens DESC, id LIMIT 10")
def top_cost(spark, d):
    return _cost(spark, d).select("id", "read_window_tokens").orderBy(F.desc("read_window_tokens"), "id").limit(10)


@query("usage_pareto80", f"""{AN}, {COST}, best AS (SELECT *, row_number() OVER (ORDER BY read_window_tokens DESC, id) AS k FROM cost QUALIFY k <= 10),
run AS (SELECT *, sum(read_window_tokens) OVER (ORDER BY k) AS cum FROM best), total AS (SELECT sum(read_window_tokens)::BIGINT AS t FROM cost)
SELECT coalesce(min(k) FILTER (cum >= 0.8 * t), count(*))::BIGINT AS k, max(t) AS total_tokens FROM run, total""")
def pareto(spark, d):
    return U.pareto(_cost(spark, d))


@query("usage_never_read", AN + "SELECT id, tokens FROM notes WHERE id NOT IN (SELECT id FROM activity WHERE type = 'read') ORDER BY tokens DESC, id LIMIT 50")
def never_read(spark, d):
    return U.never_read(notes(spark, d).select("id", "tokens"), activity(spark, d))


@query("usage_totals", NOTES_SQL.join(("WITH ", " ")) + "SELECT theme, count(*) AS notes, sum(tokens)::BIGINT AS tokens FROM notes GROUP BY theme")
def totals(spark, d):
    return notes(spark, d).groupBy("theme").agg(F.count("*").alias("notes"), F.sum("tokens").alias("tokens"))


@query("usage_co_reads", A + ", r AS (SELECT DISTINCT day, id FROM activity WHERE type = 'read') SELECT x.id AS a, y.id AS b, count(*) AS days FROM r x JOIN r y ON x.day = y.day AND x.id < y.id GROUP BY x.id, y.id")
def co_reads(spark, d):
    return U.co_reads(activity(spark, d))


@query("usage_episodes", f"{A}, {EPISODES} SELECT actor, t, n, read_t, delay FROM episodes")
def episodes(spark, d):
    return U.episodes(activity(spark, d), HALF_DAY_MS).select("actor", "t", F.col("n"), "read_t", "delay")


@query("usage_find_time", f"{A}, {EPISODES} SELECT count(*) AS searches, count(delay) AS found, round(1 - count(delay) / count(*), 6) AS missed_share, round(median(delay), 3) AS median_delay, max(delay) AS longest FROM episodes")
def find_time(spark, d):
    return U.find_time(U.episodes(activity(spark, d), HALF_DAY_MS))


@query("usage_slowest", f"{A}, {EPISODES} SELECT actor, t, delay FROM episodes ORDER BY delay IS NULL DESC, delay DESC, t DESC, actor LIMIT 5")
def slowest(spark, d):
    return U.slowest(U.episodes(activity(spark, d), HALF_DAY_MS)).select("actor", "t", "delay")


CALLS = ", c AS (SELECT type, t, CAST(round(ms) AS BIGINT) AS ms FROM activity WHERE ms BETWEEN 0 AND 600000)"


@query("usage_latency", A + CALLS + """, x AS (SELECT type, ms FROM c UNION ALL SELECT 'total', ms FROM c), g AS (SELECT type, count(*) AS n, quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.95) AS p95, max(ms) AS longest FROM x GROUP BY type)
SELECT k.type, coalesce(n, 0) AS n, p50, p95, longest FROM (VALUES ('search'), ('read'), ('write'), ('total')) k(type) LEFT JOIN g USING (type)""")
def latency(spark, d):
    return U.latency(activity(spark, d))


@query("usage_slow_alert", A + CALLS + f""", p AS (SELECT CASE WHEN t BETWEEN {NOW - DAY_MS} AND {NOW} THEN 'new' WHEN t BETWEEN {NOW - 7 * DAY_MS} AND {NOW - DAY_MS - 1} THEN 'old' END AS part, ms FROM c WHERE type = 'search'),
g AS (SELECT count(*) FILTER (part = 'new') AS n_new, quantile_disc(ms, 0.5) FILTER (part = 'new') AS p50_new, count(*) FILTER (part = 'old') AS n_old, quantile_disc(ms, 0.5) FILTER (part = 'old') AS p50_old FROM p)
SELECT *, coalesce(n_new >= 10 AND n_old >= 10 AND p50_new >= 2 * p50_old AND p50_new >= p50_old + 250, false) AS slow FROM g""")
def slow_alert(spark, d):
    return U.slow_alert(activity(spark, d), NOW)


EVENTS_SQL = """w AS (SELECT event_type AS kind, epoch_us(ts) // 1000 AS t, CASE WHEN event_id % 4 = 0 THEN 'R' || (user_id % 7 + 1) || ': moved' WHEN event_id % 4 = 1 THEN (user_id % 9) || ' sections' ELSE 'done' END AS detail FROM events)"""


def _worker_events(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    k = F.pmod("event_id", F.lit(4))
    detail = F.when(k == 0, F.concat(F.lit("R"), F.pmod("user_id", F.lit(7)) + 1, F.lit(": moved"))).when(k == 1, F.concat(F.pmod("user_id", F.lit(9)), F.lit(" sections"))).otherwise("done")
    return e.select(F.col("event_type").alias("kind"), F.unix_millis(F.col("ts").cast("timestamp")).alias("t"), detail.alias("detail"))


@query("usage_weekly_report", f"WITH {EVENTS_SQL} SELECT kind, count(*) AS n, sum(coalesce(try_cast(nullif(regexp_extract(detail, '^\\s*(\\d+)', 1), '') AS BIGINT), 1))::BIGINT AS amount FROM w WHERE t BETWEEN {NOW - 7 * DAY_MS} AND {NOW} GROUP BY kind")
def weekly_report(spark, d):
    return U.report(_worker_events(spark, d), NOW - 7 * DAY_MS, NOW)


@query("usage_events_by_rule", f"WITH {EVENTS_SQL} SELECT regexp_extract(detail, '^([A-Z]\\d+)\\s*:', 1) AS rule, count(*) AS n FROM w WHERE regexp_matches(detail, '^[A-Z]\\d+\\s*:') GROUP BY 1")
def by_rule(spark, d):
    return U.by_rule(_worker_events(spark, d))


@query("usage_client_savings", A + f"""SELECT CASE WHEN actor % 4 = 0 THEN 'desktop' WHEN actor % 4 = 1 THEN 'cli' WHEN actor % 4 = 2 THEN 'unknown' ELSE 'other' END AS client, type AS lever, sum(id)::BIGINT AS tokens, count(*) AS calls
FROM activity WHERE day >= {TODAY} - 10 GROUP BY ALL""")
def client_savings(spark, d):
    names = F.element_at(F.array(*map(F.lit, ("Desktop App", "my-cli 2", "", "proxy"))), (F.pmod("actor", F.lit(4)) + 1).cast("int"))
    per = activity(spark, d).groupBy("day", names.alias("name"), "type").agg(F.struct(F.sum("id").alias("tokens"), F.count("*").alias("calls")).alias("x"))
    days = per.groupBy("day", U.client_bucket(F.col("name")).alias("client")).agg(F.map_from_entries(F.collect_list(F.struct("type", "x"))).alias("levers"))
    return U.savings(days, F.expr(f"{TODAY} - INTERVAL 10 DAY").cast("date"))


@query("usage_always_loaded", A + "SELECT count(*) AS active_days, greatest(round(avg(n), 1), 1.0) AS sessions_per_day, round(greatest(round(avg(n), 1), 1.0) * 1234)::BIGINT AS tokens_per_day FROM (SELECT day, count(DISTINCT actor) AS n FROM activity GROUP BY day)")
def always_loaded(spark, d):
    return U.always_loaded(activity(spark, d).withColumnRenamed("actor", "session"), 1234)


@query("usage_prefix_changes", A + "SELECT actor, call_id, type FROM (SELECT *, lag(type) OVER (PARTITION BY actor ORDER BY t, call_id) AS before FROM activity) WHERE type IS DISTINCT FROM before")
def prefix_changes(spark, d):
    return U.changes_only(activity(spark, d), "actor", "type", ["t", "call_id"]).select("actor", "call_id", "type")


@query("usage_change_counts", A + f"SELECT actor, count(*) FILTER (t >= {NOW} - 7 * 86400000) AS days7, count(*) FILTER (t >= {NOW} - 30 * 86400000::BIGINT) AS days30 FROM (SELECT *, row_number() OVER (PARTITION BY actor ORDER BY t, call_id) AS k FROM (SELECT *, lag(type) OVER (PARTITION BY actor ORDER BY t, call_id) AS before FROM activity) WHERE type IS DISTINCT FROM before) WHERE k > 1 GROUP BY actor")
def change_counts(spark, d):
    log = U.changes_only(activity(spark, d), "actor", "type", ["t", "call_id"])
    return U.change_counts(log, "actor", NOW, ["t", "call_id"])


@query("usage_retention_newest", A + "SELECT id, type, last FROM (SELECT id, type, max(t) AS last FROM activity GROUP BY id, type) ORDER BY last DESC, id, type LIMIT 200")
def retention_newest(spark, d):
    last = activity(spark, d).groupBy("id", "type").agg(F.max("t").alias("last"))
    return U.newest(last, "last", ["id", "type"], 200)


ALIASES_SQL = "al AS (SELECT 'w' || (actor % 12) AS word, id AS note, count(*) AS count, max(t) AS last FROM activity GROUP BY 1, 2)"


def _aliases(spark, d):
    return activity(spark, d).groupBy(F.concat(F.lit("w"), F.pmod("actor", F.lit(12))).alias("word"), F.col("id").alias("note")).agg(F.count("*").alias("count"), F.max("t").alias("last"))


@query("usage_alias_boost", f"{A}, {ALIASES_SQL} SELECT note, round(least(sum(count * pow(0.5, ({NOW} - last) / 86400000.0 / 30.0)), 1.0), 6) AS boost FROM al WHERE word IN ('w1', 'w5') GROUP BY note")
def alias_boost(spark, d):
    return U.usage_boost(_aliases(spark, d), ["w1", "w5"], NOW).select("note", F.round("boost", 6).alias("boost"))


@query("usage_alias_match", f"{A}, {ALIASES_SQL} SELECT note, count(DISTINCT word) AS words, max(count) AS count FROM al WHERE word IN ('w1', 'w5', 'w7') GROUP BY note HAVING words >= 2 OR max(al.count) >= 2 ORDER BY words DESC, max(al.count) DESC, note LIMIT 1")
def alias_match(spark, d):
    return U.alias_match(_aliases(spark, d), ["w1", "w5", "w7"])


@query("usage_merge_phrasings", A + """, h AS (SELECT source AS phrasing, id, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, id) AS rank FROM activity GROUP BY source, id QUALIFY rank <= 30)
SELECT id, count(*) AS votes, arg_min(rank, phrasing) AS rank, min(phrasing) AS phrasing FROM h GROUP BY id""")
def merge_phrasings(spark, d):
    from pyspark.sql import Window as W

    n = activity(spark, d).groupBy("source", "id").agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy("source").orderBy(F.desc("n"), "id")).cast("bigint")
    hits = n.select("id", F.col("source").alias("phrasing"), rank.alias("rank")).where("rank <= 30")
    return U.merge_phrasings(hits)


@query("usage_fingerprint", f"WITH {NOTES_SQL} SELECT concat_ws(':', count(*), sum(tokens)::BIGINT, max(mtime_ms), sum(mtime_ms)::BIGINT) AS fingerprint FROM notes")
def fingerprint(spark, d):
    return U.fingerprint(notes(spark, d))


@query("usage_bursts", A + f""", r AS (SELECT *, CASE WHEN type <> 'search' OR lag(type) OVER w IS DISTINCT FROM 'search' OR t - lag(t) OVER w > {HALF_DAY_MS} THEN 1 ELSE 0 END AS new FROM activity WINDOW w AS (PARTITION BY actor ORDER BY t, call_id)),
g AS (SELECT *, sum(new) OVER (PARTITION BY actor ORDER BY t, call_id) AS run FROM r), s AS (SELECT *, (row_number() OVER (PARTITION BY actor, run ORDER BY t, call_id) - 1) // 4 AS part FROM g WHERE type = 'search')
SELECT actor AS session, run::BIGINT AS run, part::BIGINT AS part, count(*) AS n, min(t) AS first_t FROM s GROUP BY actor, run, part HAVING count(*) > 1""")
def bursts(spark, d):
    return U.bursts(activity(spark, d).withColumnRenamed("actor", "session"), HALF_DAY_MS)


@query("usage_bursts_in_order", A + f""", r AS (SELECT *, CASE WHEN type <> 'search' OR lag(type) OVER w IS DISTINCT FROM 'search' OR actor // 50 <> lag(actor // 50) OVER w OR t - lag(t) OVER w > {HALF_DAY_MS} THEN 1 ELSE 0 END AS new FROM activity WINDOW w AS (ORDER BY t, call_id)),
g AS (SELECT *, sum(new) OVER (ORDER BY t, call_id) AS run FROM r), s AS (SELECT *, (row_number() OVER (PARTITION BY run ORDER BY t, call_id) - 1) // 4 AS part FROM g WHERE type = 'search')
SELECT actor // 50 AS session, arg_min(call_id, (t, call_id)) AS first_call, count(*) AS n, min(t) AS first_t FROM s GROUP BY actor // 50, run, part HAVING count(*) > 1""")
def bursts_in_order(spark, d):
    """Fifty users as one session, so that runs are found in the order of all calls."""
    return U.bursts_in_order(activity(spark, d).withColumn("session", F.floor(F.col("actor") / 50)), HALF_DAY_MS, parts=16)


@query("usage_sessions", A + f""", r AS (SELECT *, CASE WHEN lag(t) OVER w IS NULL OR t - lag(t) OVER w > {HALF_DAY_MS} OR source <> lag(source) OVER w THEN 1 ELSE 0 END AS new FROM activity WINDOW w AS (PARTITION BY actor ORDER BY t, call_id)),
s AS (SELECT actor, sum(new) OVER (PARTITION BY actor ORDER BY t, call_id) AS session FROM r) SELECT actor, session::BIGINT AS session, count(*) AS calls FROM s GROUP BY actor, session""")
def sessions(spark, d):
    return U.sessions(activity(spark, d), HALF_DAY_MS).groupBy("actor", "session").agg(F.count("*").alias("calls"))
