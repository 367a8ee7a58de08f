"""Usage analytics over an activity table: type (search, read, write), actor, id, t (ms), day, ms.

Each operator is one aggregation, or a window within an actor, a note or a day; lists that are cut are cut
by ordered limits. Absent types and days are reported where a report wants them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import scan

TYPES = ("search", "read", "write")
LOOK_AHEAD_MS = 120_000
SHARE = 0.8
ALERT_LEAST, ALERT_TIMES, ALERT_MORE_MS = 10, 2.0, 250


def daily_counters(activity: DataFrame) -> DataFrame:
    """day, id, search, read, write."""
    return activity.groupBy("day", "id").agg(*[F.count_if(F.col("type") == t).alias(t) for t in TYPES])


def retain(daily: DataFrame, days: int = 90) -> DataFrame:
    """Counters of the last `days` days before the newest day, that day included."""
    newest = daily.agg(F.max("day").alias("newest"))
    return daily.join(F.broadcast(newest), F.col("day") > F.date_sub("newest", days)).drop("newest")


def last_activity(activity: DataFrame) -> DataFrame:
    return activity.groupBy("id", "type").agg(F.max("day").alias("last_day"))


def token_cost(activity: DataFrame, notes: DataFrame, today: Column, days: int = 7) -> DataFrame:
    """By note: read and written tokens of `today` and of the last `days` days; notes gone are left out."""
    recent = F.col("day") > F.date_sub(today, days)
    sums = [
        F.sum(F.when((F.col("type") == t) & when, 1).otherwise(0)).alias(f"{t}_{name}")
        for t in ("read", "write") for name, when in (("today", F.col("day") == today), ("window", recent))
    ]
    each = activity.groupBy("id").agg(*sums).join(notes.select("id", "tokens"), "id")
    return each.select("id", "tokens", *[(F.col(c) * F.col("tokens")).alias(c + "_tokens") for c in ("read_today", "read_window", "write_today", "write_window")])


def pareto(cost: DataFrame, top: int = 10, share: float = SHARE) -> DataFrame:
    """How many of the `top` notes by window tokens make up `share` of all; all of them if none do."""
    total = cost.agg(F.sum("read_window_tokens").alias("total"))
    best = cost.orderBy(F.desc("read_window_tokens"), "id").limit(top)
    run = best.withColumn("cum", F.sum("read_window_tokens").over(W.orderBy(F.desc("read_window_tokens"), "id"))).withColumn("k", F.row_number().over(W.orderBy(F.desc("read_window_tokens"), "id")))
    return run.join(F.broadcast(total)).agg(  # one row of totals
        F.coalesce(F.min(F.when(F.col("cum") >= share * F.col("total"), F.col("k"))), F.count("*")).cast("bigint").alias("k"), F.max("total").alias("total_tokens")
    )


def never_read(notes: DataFrame, activity: DataFrame, most: int = 50) -> DataFrame:
    unread = notes.join(activity.where(F.col("type") == "read").select("id").distinct(), "id", "left_anti")
    return unread.orderBy(F.desc("tokens"), "id").limit(most)


def co_reads(activity: DataFrame) -> DataFrame:
    """Pairs a < b of notes read on a same day, and on how many days. Days join on day and a salt of a, so
    that a busy day is dealt over many tasks."""
    read = activity.where(F.col("type") == "read").select("day", "id").distinct()
    salts = 16
    left = read.select("day", F.col("id").alias("a"), F.pmod(F.xxhash64("id"), F.lit(salts)).alias("s"))
    right = read.select("day", F.col("id").alias("b"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).alias("s"))
    return left.join(right, ["day", "s"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("days"))


def episodes(activity: DataFrame, look_ahead_ms: int = LOOK_AHEAD_MS) -> DataFrame:
    """Each search with the first read of its actor within the look-ahead, and the searches until then."""
    w = W.partitionBy("actor").orderBy("t").rangeBetween(0, look_ahead_ms)
    hit = F.min(F.when(F.col("type") == "read", F.struct("t", "id"))).over(w)
    n = F.sum(F.when(F.col("type") == "search", 1).otherwise(0)).over(W.partitionBy("actor").orderBy("t").rangeBetween(W.unboundedPreceding, 0))
    both = activity.where(F.col("type").isin("search", "read"))
    found = both.withColumn("hit", hit).withColumn("n", n).where(F.col("type") == "search")
    return found.select("actor", "t", "n", F.col("hit.t").alias("read_t"), F.col("hit.id").alias("read_id"), (F.col("hit.t") - F.col("t")).alias("delay"))


def find_time(found: DataFrame) -> DataFrame:
    """One row: searches, found, missed share, median and longest delay."""
    return found.agg(
        F.count("*").alias("searches"), F.count("delay").alias("found"), F.round(1 - F.count("delay") / F.count("*"), 6).alias("missed_share"),
        F.round(F.median("delay"), 3).alias("median_delay"), F.max("delay").alias("longest"),
    )


def slowest(found: DataFrame, most: int = 5) -> DataFrame:
    """Missed ones first, then the longest delays."""
    return found.orderBy(F.col("delay").isNull().desc(), F.desc("delay"), F.desc("t"), "actor").limit(most)


def clean_duration(ms: Column) -> Column:
    return F.when(ms.between(0, 600_000), F.round(ms).cast("bigint"))


def latency(calls: DataFrame) -> DataFrame:
    """By type and in total: n, p50, p95, longest; nearest-rank percentiles; absent types have n 0."""
    c = calls.select("type", clean_duration(F.col("ms")).alias("ms")).where("ms IS NOT NULL")
    rows = c.where(F.col("type").isin(*TYPES)).select(F.explode(F.array("type", F.lit("total"))).alias("type"), "ms")
    rank = lambda p: F.expr(f"CAST(percentile_disc({p}) WITHIN GROUP (ORDER BY ms) AS BIGINT)")
    got = rows.groupBy("type").agg(F.count("*").alias("n"), rank(0.5).alias("p50"), rank(0.95).alias("p95"), F.max("ms").alias("longest"))
    names = c.sparkSession.createDataFrame([(t,) for t in (*TYPES, "total")], "type string")
    return names.join(got, "type", "left").select("type", F.coalesce("n", F.lit(0)).alias("n"), "p50", "p95", "longest")


def slow_alert(calls: DataFrame, now: int, day_ms: int = 86_400_000, before_days: int = 6) -> DataFrame:
    """One row: medians of the last day and of the days before it, and whether searches became slow."""
    c = calls.where(F.col("type") == "search").select("t", clean_duration(F.col("ms")).alias("ms")).where("ms IS NOT NULL")
    new, old = F.col("t").between(now - day_ms, now), F.col("t").between(now - day_ms * (1 + before_days), now - day_ms - 1)
    both = c.withColumn("part", F.when(new, "new").when(old, "old")).where("part IS NOT NULL")
    per = both.groupBy("part").agg(F.count("*").alias("n"), F.expr("CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY ms) AS BIGINT)").alias("p50"))
    one = per.agg(*[F.max(F.when(F.col("part") == p, F.col(c))).alias(f"{c}_{p}") for p in ("new", "old") for c in ("n", "p50")])
    n, o = F.coalesce("n_new", F.lit(0)), F.coalesce("n_old", F.lit(0))
    slow = (n >= ALERT_LEAST) & (o >= ALERT_LEAST) & (F.col("p50_new") >= ALERT_TIMES * F.col("p50_old")) & (F.col("p50_new") >= F.col("p50_old") + ALERT_MORE_MS)
    return one.select(n.alias("n_new"), "p50_new", o.alias("n_old"), "p50_old", F.coalesce(slow, F.lit(False)).alias("slow"))


def report(events: DataFrame, first_t: int, last_t: int) -> DataFrame:
    """Worker events of a span by kind: how many, and the sum of the numbers that lead their details (1 if
    none does)."""
    lead = F.regexp_extract("detail", r"^\s*(\d+)", 1).try_cast("bigint")
    return events.where(F.col("t").between(first_t, last_t)).groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.coalesce(lead, F.lit(1))).alias("amount"))


def by_rule(events: DataFrame) -> DataFrame:
    """Counts by the rule that a detail names before its colon."""
    rule = F.regexp_extract("detail", r"^([A-Z]\d+)\s*:", 1)
    return events.where(rule != "").groupBy(rule.alias("rule")).agg(F.count("*").alias("n"))


def client_bucket(name: Column) -> Column:
    c = F.lower(F.coalesce(name, F.lit("")))
    return F.when(c.contains("desktop"), "desktop").when(c.contains("cli") | c.contains("code"), "cli").when(c == "", "unknown").otherwise("other")


def savings(days: DataFrame, first_day: Column) -> DataFrame:
    """From rows day, client, levers map<string, struct<tokens,calls>>: sums by client and lever."""
    each = days.where(F.col("day") >= first_day).select("client", F.explode("levers").alias("lever", "x"))
    return each.groupBy("client", "lever").agg(F.sum("x.tokens").alias("tokens"), F.sum("x.calls").alias("calls"))


def merge_counts(a: Column, b: Column) -> Column:
    """Two maps of counts added key by key."""
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def always_loaded(sessions: DataFrame, prefix_tokens: int) -> DataFrame:
    """One row: sessions by active day (one decimal, at least 1) and the tokens a day that a prefix costs."""
    daily = sessions.groupBy("day").agg(F.countDistinct("session").alias("n"))
    per_day = F.greatest(F.round(F.avg("n"), 1), F.lit(1.0))
    return daily.agg(F.count("*").alias("active_days"), per_day.alias("sessions_per_day"), F.round(per_day * prefix_tokens).cast("bigint").alias("tokens_per_day"))


def changes_only(log: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Rows whose value differs from the one before under the same key."""
    before = F.lag(value).over(W.partitionBy(key).orderBy(*order))
    return log.withColumn("_before", before).where(~F.col(value).eqNullSafe(F.col("_before")) | F.col("_before").isNull()).drop("_before")


def change_counts(log: DataFrame, key: str, now: int, order: list[str], spans: tuple[int, ...] = (7, 30)) -> DataFrame:
    """By key, how many changes the last days saw, for each span; the first row of a key is no change."""
    seen = log.withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_k > 1")
    return seen.groupBy(key).agg(*[F.count_if(F.col("t") >= now - d * 86_400_000).alias(f"days{d}") for d in spans])


def newest(rows: DataFrame, by: str, tie: list[str], most: int) -> DataFrame:
    """The `most` newest rows, as a bounded log or cache keeps."""
    return rows.orderBy(F.desc(by), *tie).limit(most)


def usage_boost(aliases: DataFrame, words: list[str], now: int, half_life_days: float = 30.0, most: float = 1.0) -> DataFrame:
    """By note: counts of its aliases among the words, halved every half-life, at most `most`."""
    days = (F.lit(now) - F.col("last")) / 86_400_000.0
    weight = F.col("count") * F.pow(F.lit(0.5), days / half_life_days)
    return aliases.where(F.col("word").isin(words)).groupBy("note").agg(F.least(F.sum(weight), F.lit(most)).alias("boost"))


def alias_match(aliases: DataFrame, words: list[str], least_words: int = 2, least_count: int = 2) -> DataFrame:
    """The note that most different words point to, then the largest count; one word suffices if it was
    learned `least_count` times."""
    each = aliases.where(F.col("word").isin(words)).groupBy("note").agg(F.countDistinct("word").alias("words"), F.max("count").alias("count"))
    good = each.where((F.col("words") >= least_words) | (F.col("count") >= least_count))
    return good.orderBy(F.desc("words"), F.desc("count"), "note").limit(1)


def merge_phrasings(hits: DataFrame) -> DataFrame:
    """From id, phrasing, rank of several phrasings' results: votes, the rank where the note was first seen
    (in order of phrasings) and the merged order."""
    g = hits.groupBy("id").agg(F.count("*").alias("votes"), F.min(F.struct("phrasing", "rank")).alias("x"))
    flat = g.select("id", "votes", F.col("x.phrasing").alias("phrasing"), F.col("x.rank").alias("rank"))
    return flat.orderBy(F.desc("votes"), "rank", "phrasing", "id")


def fingerprint(notes: DataFrame) -> DataFrame:
    """One row that changes when any note does."""
    return notes.agg(F.concat_ws(":", F.count("*"), F.sum("tokens"), F.max("mtime_ms"), F.sum("mtime_ms")).alias("fingerprint"))


def bursts(calls: DataFrame, gap_ms: int = 120_000, most: int = 4) -> DataFrame:
    """Searches of one session in a row, no more than `gap_ms` apart, in runs of up to `most`: rows
    session, run, n, first_t. Other calls of the session end a run."""
    w = W.partitionBy("session").orderBy("t", "call_id")
    new = F.coalesce((F.col("type") != "search") | (F.lag("type").over(w) != "search") | (F.col("t") - F.lag("t").over(w) > gap_ms), F.lit(True))
    runs = calls.withColumn("run", F.sum(new.cast("int")).over(w)).where(F.col("type") == "search")
    pos = F.row_number().over(W.partitionBy("session", "run").orderBy("t", "call_id")) - 1
    cut = runs.withColumn("part", F.floor(pos / most))
    return cut.groupBy("session", "run", "part").agg(F.count("*").alias("n"), F.min("t").alias("first_t")).where("n > 1")


def bursts_in_order(calls: DataFrame, gap_ms: int = 120_000, most: int = 4, parts: int | None = None) -> DataFrame:
    """Searches of one session one right after the other in the order of all calls, no more than `gap_ms` apart, in runs
    of up to `most`: rows session, first_call, n, first_t. A call of any other session, too, ends a run."""
    s = scan.runs(calls.withColumn("_search", F.col("type") == "search"), "t", ["call_id"], ["session"], gap_ms, "_search", parts)
    cut = s.where("run IS NOT NULL").groupBy("session", "run", F.floor(F.col("run_pos") / most).alias("k"))
    return cut.agg(F.min_by("call_id", F.struct("t", "call_id")).alias("first_call"), F.count("*").alias("n"), F.min("t").alias("first_t")).where("n > 1").select("session", "first_call", "n", "first_t")


def sessions(calls: DataFrame, gap_ms: int = 1_800_000) -> DataFrame:
    """A session number within each actor: a new one after a gap, or when the source changes."""
    w = W.partitionBy("actor").orderBy("t", "call_id")
    new = F.coalesce((F.col("t") - F.lag("t").over(w) > gap_ms) | (F.col("source") != F.lag("source").over(w)), F.lit(True))
    return calls.withColumn("session", F.sum(new.cast("int")).over(w))
