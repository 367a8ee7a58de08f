"""Lifecycle, evaluation and listing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvex.functions import text as X
from corvex.operators import evaluate as B
from corvex.operators import lifecycle as L
from corvex.operators import usage as U

from . import sqltext as Q
from .registry import query
from .tables import ACTIVITY_SQL, NOTES_SQL, activity, notes, read

N = f"WITH {NOTES_SQL}"
CONV = "k AS (SELECT conv_id AS id, turn AS pos, text, ceil(octet_length(encode(text)) / 4.0)::BIGINT AS tokens FROM conversations)"


def _sections(spark, d):
    """A conversation's turns as the sections of a note."""
    return read(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("pos"), "role", "text", X.tokens("text").alias("tokens"))


@query("lifecycle_pack_sections", f"""WITH RECURSIVE {CONV}, o AS (SELECT id, tokens, row_number() OVER (PARTITION BY id ORDER BY pos) AS i FROM k),
r AS (SELECT id, i, tokens AS size, 1 AS part FROM o WHERE i = 1 UNION ALL SELECT r.id, o.i, CASE WHEN size + tokens <= 60 THEN size + tokens ELSE tokens END, CASE WHEN size + tokens <= 60 THEN part ELSE part + 1 END FROM r JOIN o ON o.id = r.id AND o.i = r.i + 1),
p AS (SELECT id, part, max(size) AS size FROM r GROUP BY id, part) SELECT id, list(size ORDER BY part)::BIGINT[] AS parts FROM p GROUP BY id""")
def pack_sections(spark, d):
    g = _sections(spark, d).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "tokens"))).alias("s"))
    return g.select("id", L.pack(F.transform("s", lambda x: x["tokens"]), 60).alias("parts"))


@query("lifecycle_section_ends", "WITH h AS (SELECT conv_id AS id, turn AS line, (turn * 7 + conv_id) % 3 + 2 AS level FROM conversations) SELECT id, line, level::INTEGER AS level, coalesce((SELECT min(line) FROM h y WHERE y.id = x.id AND y.line > x.line AND y.level <= x.level), 1000)::BIGINT AS \"end\" FROM h x")
def section_ends(spark, d):
    h = read(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("line"), (F.pmod(F.col("turn") * 7 + F.col("conv_id"), F.lit(3)) + 2).cast("int").alias("level"))
    return L.section_ends(h, F.lit(1000).cast("bigint"))


@query("lifecycle_dormant", f"""WITH {ACTIVITY_SQL}, {NOTES_SQL}, {CONV} SELECT id, pos, tokens FROM k WHERE tokens >= 20 AND id IN (SELECT id FROM notes WHERE CAST(to_timestamp(mtime_ms / 1000) AS DATE) <= DATE '2024-01-20')
AND id NOT IN (SELECT id FROM activity WHERE day > DATE '2024-01-20' AND id % 3 <> 0) ORDER BY tokens DESC, id, pos LIMIT 20""")
def dormant(spark, d):
    found = L.dormant(notes(spark, d), _sections(spark, d), U.last_activity(activity(spark, d).where("id % 3 <> 0")), F.expr("DATE '2024-01-01'"), F.expr("DATE '2024-01-30'"), days=10, least=20)
    return found.select("id", "pos", "tokens")


@query("lifecycle_first_seen", f"WITH {ACTIVITY_SQL} SELECT id AS note, sha1(type) AS hash, min(day) AS first_day FROM activity GROUP BY id, type")
def first_seen(spark, d):
    return L.first_seen(activity(spark, d).select(F.col("id").alias("note"), F.sha1("type").alias("hash"), "day"))


@query("lifecycle_proposals", f"""{N}, p AS (SELECT 'split' AS kind, id AS target, tokens - 2000 AS gain_tokens FROM notes WHERE tokens > 2000 UNION ALL SELECT 'archive', id, tokens FROM notes WHERE subtheme = 'de' AND tokens > 1000 UNION ALL SELECT 'trim', id, tokens // 10 FROM notes WHERE theme = 'src1'),
i AS (SELECT *, substr(sha1(kind || chr(10) || target), 1, 12) AS id FROM p) SELECT id, kind, target, gain_tokens FROM i WHERE kind <> 'trim' OR target % 5 <> 0""")
def proposals(spark, d):
    n = notes(spark, d)
    p = lambda k, df, gain: df.select(F.lit(k).alias("kind"), F.col("id").alias("target"), gain.cast("bigint").alias("gain_tokens"))
    trim = p("trim", n.where("theme = 'src1'"), F.floor(F.col("tokens") / 10))
    gone = L.proposals(trim.where("target % 5 = 0")).select("id")
    return L.proposals(p("split", n.where("tokens > 2000"), F.col("tokens") - 2000), p("archive", n.where("subtheme = 'de' AND tokens > 1000"), F.col("tokens")), trim, dismissed=gone).select("id", "kind", "target", "gain_tokens")


@query("lifecycle_budget", f"""{N}, l AS (SELECT id, generate_subscripts(a, 1) AS i, unnest(a) AS line, body FROM (SELECT id, string_split(body, chr(10)) AS a, body FROM notes)),
c AS (SELECT id, i, line, sum(octet_length(encode(line)) + 1) OVER (PARTITION BY id ORDER BY i) - 1 AS size FROM l), b AS (SELECT id, coalesce(max(i) FILTER (ceil(size / 4.0) <= 200), 1) AS best FROM c GROUP BY id)
SELECT id, sha1(string_agg(line, chr(10) ORDER BY i)) AS text FROM l JOIN b USING (id) WHERE i <= best GROUP BY id""")
def budget(spark, d):
    return notes(spark, d).where("body IS NOT NULL").select("id", F.sha1(L.budget(F.col("body"), 200)).alias("text"))


@query("lifecycle_conserved_lines", "SELECT count(*) AS lost FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM conversations WHERE conv_id % 50 = 3) WHERE trim(l) <> ''")
def conserved(spark, d):
    c = read(spark, d, "conversations").select("conv_id", "text")
    return L.conserved(c, c.where("conv_id % 50 <> 3")).agg(F.count_if(F.col("what") == "lost").alias("lost"))


@query("listing_directories", f"""{N}, p AS (SELECT theme || '/' || subtheme || '/n' || id AS path, mtime_ms FROM notes), u AS (SELECT split_part(path, '/', 1) AS directory, mtime_ms FROM p UNION ALL SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2), mtime_ms FROM p)
SELECT directory, max(mtime_ms) AS newest, count(*) AS files FROM u GROUP BY directory""")
def directories(spark, d):
    p = notes(spark, d).select(F.concat_ws("/", "theme", "subtheme", F.concat(F.lit("n"), "id")).alias("path"), "mtime_ms")
    return L.directories(p, 2)


@query("listing_sorted", "SELECT url, rank FROM (SELECT url, row_number() OVER (ORDER BY lower(url), url) AS rank FROM (SELECT DISTINCT url FROM pages)) WHERE rank <= 25")
def listing_sorted(spark, d):
    from pyspark.sql import Window as W

    top = read(spark, d, "pages").select("url").distinct().orderBy(F.lower("url"), "url").limit(25)
    return top.select("url", F.row_number().over(W.orderBy(F.lower("url"), "url")).cast("bigint").alias("rank"))


PATHS = "p AS (SELECT theme || '/' || CASE WHEN id % 2 = 0 THEN 'N' ELSE 'n' END || (id // 2) AS path, mtime_ms // 600000 AS mtime_ms FROM notes)"


@query("listing_modes", f"""{N}, {PATHS} SELECT * FROM (SELECT 'name' AS mode, path FROM p ORDER BY lower(path), path LIMIT 20) UNION ALL SELECT * FROM (SELECT 'name_desc', path FROM p ORDER BY lower(path) DESC, path DESC LIMIT 20)
UNION ALL SELECT * FROM (SELECT 'oldest', path FROM p ORDER BY mtime_ms, path LIMIT 20) UNION ALL SELECT * FROM (SELECT 'newest', path FROM p ORDER BY mtime_ms DESC, path LIMIT 20)""")
def listing_modes(spark, d):
    n = notes(spark, d)
    p = n.select(F.concat("theme", F.lit("/"), F.when(F.col("id") % 2 == 0, "N").otherwise("n"), F.floor(F.col("id") / 2)).alias("path"), F.floor(F.col("mtime_ms") / 600_000).alias("mtime_ms"))
    out = None
    for mode in L.LISTING:
        one = L.listed(p, mode, 20).select(F.lit(mode).alias("mode"), "path")
        out = one if out is None else out.unionByName(one)
    return out


@query("filter_scope", f"{N} SELECT id FROM notes WHERE (theme = 'src1' OR theme = 'src2' AND subtheme = 'fr') AND NOT (theme = 'src1' AND subtheme = 'de')")
def scope(spark, d):
    from corvex.operators import filters as P

    n = notes(spark, d).withColumn("path", F.concat_ws("/", "theme", "subtheme", F.concat(F.lit("n"), "id")))
    return n.where(P.in_scope(F.col("path"), ["src1/", "src2/fr"], ["src1/de"])).select("id")


@query("listing_recent", f"{N} SELECT id, mtime_ms FROM notes WHERE mtime_ms >= 1704067200000 + 60000 * 500 ORDER BY mtime_ms DESC, id LIMIT 50")
def recent(spark, d):
    return notes(spark, d).where(F.col("mtime_ms") >= 1_704_067_200_000 + 60_000 * 500).select("id", "mtime_ms").orderBy(F.desc("mtime_ms"), "id").limit(50)


@query("listing_first_of_groups", f"{N}, r AS (SELECT theme, id, row_number() OVER (PARTITION BY theme ORDER BY id) AS k, count(*) OVER (PARTITION BY theme) AS n FROM notes) SELECT theme, id, k, n FROM r WHERE k <= 3")
def first_of_groups(spark, d):
    return L.first_of_groups(notes(spark, d).select("theme", "id"), "theme", ["id"]).select("theme", "id", F.col("k").cast("bigint").alias("k"), "n")


@query("listing_theme_overview", f"{N} SELECT theme, count(*) AS notes, list_slice(list_sort(list(DISTINCT subtheme)), 1, 8) AS folders FROM notes GROUP BY theme")
def overview(spark, d):
    return notes(spark, d).groupBy("theme").agg(F.count("*").alias("notes"), F.slice(F.array_sort(F.collect_set("subtheme")), 1, 8).alias("folders"))


RANKS = "r AS (SELECT item_id, (item_id * 7) % 12 AS rank FROM benchmark)"


@query("eval_retrieval", f"WITH {RANKS} SELECT count(*) AS n, round(avg(CASE WHEN rank > 0 THEN 1.0 / rank ELSE 0 END), 6) AS mrr, count(*) FILTER (rank > 0) AS in_results, count(*) FILTER (rank = 1) AS first, count(*) FILTER (rank BETWEEN 1 AND 3) AS top3 FROM r")
def retrieval(spark, d):
    return B.retrieval(read(spark, d, "benchmark").select(F.pmod(F.col("item_id") * 7, F.lit(12)).alias("rank")))


def _runs(spark, d):
    e = read(spark, d, "events")
    return e.select(F.pmod("user_id", F.lit(40)).alias("question"), F.col("event_type").alias("variant"), F.concat(F.lit("k"), F.pmod("event_id", F.lit(3))).alias("kind"), F.round(F.col("value") * 100).cast("bigint").alias("value"), (F.col("value") > 20).alias("correct"))


RUNS = "u AS (SELECT user_id % 40 AS question, event_type AS variant, 'k' || (event_id % 3) AS kind, CAST(round(value * 100) AS BIGINT) AS value, value > 20 AS correct FROM events)"


@query("eval_accuracy", f"WITH {RUNS} SELECT variant, kind, count(*) AS n, count(*) FILTER (correct) AS correct FROM u GROUP BY variant, kind")
def accuracy(spark, d):
    return B.accuracy(_runs(spark, d))


@query("eval_spread", f"WITH {RUNS} SELECT variant, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(coalesce(stddev_samp(value), 0), 6) AS deviation FROM u GROUP BY variant")
def spread(spark, d):
    return B.spread(_runs(spark, d), "variant", "value")


def _imul(x: str, y: str) -> str:
    return f"((({x})::HUGEINT * ({y})) % 4294967296)::BIGINT"


@query("eval_bootstrap", f"""WITH {RUNS}, m AS (SELECT question, avg(value) FILTER (variant = 'click') AS b, avg(value) FILTER (variant = 'view') AS v FROM u GROUP BY question),
p AS (SELECT b, v, row_number() OVER (ORDER BY question) - 1 AS pos, count(*) OVER () AS n FROM m WHERE b IS NOT NULL AND v IS NOT NULL),
i AS (SELECT n, unnest(range(2000 * n)) AS i FROM (SELECT DISTINCT n FROM p)), a AS (SELECT n, i, (7 + {_imul('1831565813', 'i + 1')}) % 4294967296 AS a FROM i),
t AS (SELECT n, i, {_imul('xor(a, a >> 15)', 'a | 1')} AS t FROM a), w AS (SELECT n, i, xor(t, (t + {_imul('xor(t, t >> 7)', 't | 61')}) % 4294967296) AS t FROM t),
d AS (SELECT i // n AS r, floor(xor(t, t >> 14) / 4294967296.0::DOUBLE * n)::BIGINT AS pos FROM w), s AS (SELECT r, sum(v) / sum(b) - 1 AS d FROM d JOIN p USING (pos) GROUP BY r), o AS (SELECT list(d ORDER BY d) AS d FROM s)
SELECT (SELECT count(*) FROM p) AS n, round((SELECT sum(v) / sum(b) - 1 FROM p), 6) AS change, round(d[51], 6) AS low, round(d[1950], 6) AS high FROM o""")
def bootstrap(spark, d):
    return B.relative_difference(_runs(spark, d), "view", "click").select("n", *[F.round(c, 6).alias(c) for c in ("change", "low", "high")])


@query("eval_paired_change", f"WITH {RUNS}, m AS (SELECT question, avg(value) FILTER (variant = 'click') AS b, avg(value) FILTER (variant = 'view') AS v FROM u GROUP BY question) SELECT count(*) AS n, round(sum(v) / sum(b) - 1, 6) AS change FROM m WHERE b IS NOT NULL AND v IS NOT NULL")
def paired_change(spark, d):
    return B.relative_difference(_runs(spark, d), "view", "click").select("n", F.round("change", 6).alias("change"))


@query("eval_token_ratio", f"{N}, t AS (SELECT tokens AS estimate, len({Q.words('body')}) AS actual FROM notes), b AS (SELECT *, CASE WHEN actual <= 200 THEN 0 WHEN actual <= 1000 THEN 1 WHEN actual <= 4000 THEN 2 ELSE 3 END AS bucket FROM t WHERE actual > 0) SELECT bucket, count(*) AS n, round(avg(estimate / actual), 6) AS ratio, (sum(estimate) - sum(actual))::BIGINT AS gap FROM b GROUP BY bucket")
def token_ratio(spark, d):
    return B.token_ratio(notes(spark, d).select(F.col("tokens").alias("estimate"), F.size(X.words("body")).cast("bigint").alias("actual")))


@query("eval_effective_tokens", f"WITH {RUNS}, g AS (SELECT variant, count(*) AS calls, sum(value)::BIGINT AS tokens FROM u GROUP BY variant), e AS (SELECT *, tokens + 5000 * calls AS effective FROM g) SELECT variant, calls, tokens, effective, (SELECT effective FROM e WHERE variant = 'click') - effective AS saved FROM e")
def effective(spark, d):
    r = _runs(spark, d).withColumn("calls", F.lit(1).cast("bigint")).withColumnRenamed("value", "tokens")
    return B.effective_tokens(r, "click")
