"""Names, hubs, advice, splits and streams over the supplied tables."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from corvex.functions import text as X
from corvex.operators import advice as A
from corvex.operators import graph as G
from corvex.operators import search as S
from corvex.operators.graph import shared_folder
from corvex.streaming import activity as T
from corvex.streaming import vectors as VS

from . import sqltext as Q
from .registry import query
from .search import _bm25_sql
from .tables import ACTIVITY_SQL, NOTES_SQL, activity, notes, read, stream, version

N = f"WITH {NOTES_SQL}"


# ---- names ----


def _named(spark, d):
    n = notes(spark, d)
    place = F.concat("theme", F.lit("/"), "subtheme", F.lit("/n"), "id")
    return n.select("id", "title", place.alias("permalink"), F.concat(place, F.lit(".md")).alias("path"), F.concat(F.lit("n"), "id").alias("slug"), "tokens", "theme", "subtheme", "body")


ASKED = (  # how the note k is asked for, by the asking note's id modulo 12
    "upper(slug)", "upper(permalink)", "path", "title", "'nowhere ' || id", "upper(title)", "'memory://' || permalink || '/'", "replace(permalink, '/', '%2F')", "replace(slug, 'n', 'N ')",
    "'main/' || permalink", "upper(path)", "'  ' || title || ' '",
)
ASKED_SQL = "k AS (SELECT id, title, theme || '/' || subtheme || '/n' || id AS permalink, 'n' || id AS slug, theme || '/' || subtheme || '/n' || id || '.md' AS path FROM notes), c AS (SELECT count(*) AS c FROM k), q AS (SELECT x.id, CASE x.id % 12 " + " ".join(
    f"WHEN {i} THEN {e}" for i, e in enumerate(re.sub(r"\b(slug|permalink|path|title|id)\b", r"y.\1", a) for a in ASKED)) + " END AS target FROM k x, c JOIN k y ON y.id = (x.id * 7 + 3) % c)"


def _asked(n, count):
    far = n.select(F.col("id").alias("far"), *[F.expr(e).alias(f"e{i}") for i, e in enumerate(ASKED)])
    asks = n.select("id", F.pmod(F.col("id") * 7 + 3, F.lit(count)).alias("far")).join(far, "far")
    return asks.select("id", F.get(F.array(*[f"e{i}" for i in range(len(ASKED))]), F.pmod("id", F.lit(len(ASKED))).cast("int")).alias("target"))


# The rules as key tables: what a note is called, and by which of these it is asked for, in order.
KEYS_SQL = f"""names AS (SELECT 'title' AS kind, lower(trim(title)) AS key, id, permalink FROM k UNION ALL SELECT 'title', trim({Q.fold('title')}), id, permalink FROM k
  UNION ALL SELECT 'permalink', permalink, id, permalink FROM k UNION ALL SELECT 'permalink', 'main/' || permalink, id, permalink FROM k
  UNION ALL SELECT 'path', path, id, permalink FROM k UNION ALL SELECT 'path', permalink, id, permalink FROM k UNION ALL SELECT 'slug', slug, id, permalink FROM k),
f AS (SELECT kind, key, arg_min(id, permalink) AS "to" FROM names WHERE key <> '' GROUP BY kind, key)"""
SLUGGED = "trim(regexp_replace(regexp_replace(lower(trim({x})), '[^a-z0-9.-]+', '-', 'g'), '-+', '-', 'g'), '-')"


def _resolved_sql(prepare: str, asks: list[tuple[str, str]]) -> str:
    each = " UNION ALL ".join(f"SELECT id, {i} AS tier, '{kind}' AS kind, {key} AS key FROM s" for i, (kind, key) in enumerate(asks))
    return f'{N}, {ASKED_SQL}, {KEYS_SQL}, s AS (SELECT id, {prepare} AS t FROM q), e AS ({each}) SELECT q.id, arg_min("to", tier) AS "to" FROM q LEFT JOIN (SELECT * FROM e JOIN f USING (kind, key)) USING (id) GROUP BY q.id'


LOW, BARE = "lower(trim(t))", "regexp_replace(lower(trim(t)), '[.]md$', '')"
LINKS_SQL = _resolved_sql("target", [("title", BARE), ("permalink", BARE), ("slug", BARE), ("path", BARE), ("slug", SLUGGED.format(x=BARE)), ("title", f"trim({Q.fold('t')})")])
READS_SQL = _resolved_sql("replace(trim(regexp_replace(trim(target), '^memory://', ''), '/'), '%2F', '/')", [
    ("path", f"CASE WHEN {LOW} LIKE '%.md' THEN {LOW} END"), ("permalink", BARE), ("path", LOW), ("title", LOW), ("title", f"trim({Q.fold('t')})"), ("slug", BARE), ("slug", SLUGGED.format(x=BARE)), ("permalink", SLUGGED.format(x=BARE))])


@query("notes_resolve_links", LINKS_SQL)
def resolve_links(spark, d):
    n = _named(spark, d)
    return G.resolve_links(_asked(n, n.count()), n).select("id", "to")


@query("notes_by_identifier", READS_SQL)
def by_identifier(spark, d):
    n = _named(spark, d)
    return G.read_notes(_asked(n, n.count()), n).select("id", "to")


@query("text_labels", f"""{N} SELECT id, strftime(make_timestamp_ms(mtime_ms), '%Y-%m-%dT%H:%M:%S.%gZ') AS iso, substr(sha256(coalesce(title, '') || chr(0) || theme), 1, 16) AS prefix,
  coalesce(nullif(regexp_replace(regexp_replace(translate(lower(trim(coalesce(title, ''))), '{X.ACCENTED}', '{X.PLAIN}'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'part') AS kebab,
  [NULL, 'write', 'write', 'read', 'write', 'search', 'read', NULL, 'search', 'read', NULL, 'write'][id % 12 + 1] AS kind, CASE WHEN id % 3 = 0 THEN '2024-03-0' || (id % 9 + 1) END AS latest,
  CASE id % 3 WHEN 0 THEN upper(left(theme, 1)) || substr(theme, 2) || ' ' || subtheme WHEN 1 THEN CASE WHEN title <> '' AND NOT regexp_matches(title, '^[A-Za-z0-9][A-Za-z0-9._-]{{0,150}}$') THEN title ELSE upper(left(theme, 1)) || substr(theme, 2) END ELSE upper(left(subtheme, 1)) || substr(subtheme, 2) || '/a.md' END AS label FROM notes""")
def text_labels(spark, d):
    """Titles that contain no slug, slugs that begin with a kind, and tools whose names hold several words."""
    from corvex.functions import dates as D

    n = notes(spark, d).withColumn("k", F.pmod("id", F.lit(12)).cast("int"))
    tools = "ping kb_write_note renameFile Load_Note removeNote grep_all build_context list_directory recent_searches get_info status findAndReplace".split()
    tool = F.get(F.array(*map(F.lit, tools)), F.col("k"))
    dated = F.when(F.pmod("id", F.lit(3)) == 0, F.concat(F.lit("from 2023-12-31 to 2024-03-0"), F.pmod("id", F.lit(9)) + 1)).otherwise("no date")
    third = F.pmod("id", F.lit(3))
    slug = F.when(third == 0, F.concat(F.lit("note-"), "theme", F.lit("_-"), "subtheme")).when(third == 1, F.concat(F.lit("user_"), "theme")).otherwise(F.concat("subtheme", F.lit("/a.md")))
    label = X.human_label(slug, F.when(third == 1, F.col("title")).when(third == 2, slug))
    return n.select("id", X.iso("mtime_ms").alias("iso"), X.prefix_hash(F.col("title"), F.col("theme")).alias("prefix"), A.kebab(F.coalesce("title", F.lit(""))).alias("kebab"), X.tool_kind(tool).alias("kind"), D.latest_iso_date(dated).alias("latest"), label.alias("label"))


@query("text_meta_fields", f"{N} SELECT id, theme || ' ' || tokens || ' true a ' || subtheme AS meta FROM notes")
def meta_fields(spark, d):
    n = notes(spark, d)
    inner = F.struct(F.lit(True).alias("flag"), F.array(F.lit("a"), F.col("subtheme")).alias("list"))
    deep = F.struct(F.struct(F.struct(F.struct(F.struct(F.lit("too deep").alias("e")).alias("d")).alias("c")).alias("b")).alias("a"))
    fm = F.to_json(F.struct(F.col("theme").alias("status"), F.col("tokens"), F.lit("own field").alias("title"), inner.alias("metadata"), deep.alias("nested")))
    return n.select("id", X.meta_text(fm).alias("meta"))


@query("search_hub_words", f"{N} SELECT x.id, y.title || ' about ' || y.theme AS hub FROM notes x JOIN notes y ON y.id = x.id % 7 WHERE x.id % 3 = 1 AND x.id <> y.id")
def hub_words(spark, d):
    n = _named(spark, d).withColumn("description", F.concat(F.lit("about "), "theme")).withColumn("base", F.col("slug"))
    fm = F.when(F.pmod("id", F.lit(3)) == 1, F.to_json(F.struct(F.concat(F.lit("[[N"), F.pmod("id", F.lit(7)), F.lit("|shown]]")).alias("part_of"))))
    return S.with_hub_words(n.withColumn("front_matter", fm)).where("hub IS NOT NULL").select("id", "hub")


@query("search_base_names", f"""{N}, f AS (SELECT id, 8.0::DOUBLE AS w, unnest({Q.terms("coalesce(title, '') || chr(10) || 'n' || id")}) AS term FROM notes UNION ALL SELECT id, 1.0, unnest({Q.terms('body')}) FROM notes),
p AS (SELECT id, term, sum(w) AS wtf FROM f GROUP BY id, term), l AS (SELECT id, len({Q.terms('body')}) AS len FROM notes), st AS (SELECT count(*) AS n, avg(len) AS a FROM l), v AS (SELECT count(*) AS df FROM p WHERE term = 'n77')
SELECT id, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * wtf * 2.2 / (wtf + 1.2 * (0.25 + 0.75 * len / a)) * 1.5 + CASE WHEN id = 77 THEN 5 ELSE 0 END, 6) AS score FROM p JOIN l USING (id), st, v WHERE term = 'n77'""")
def base_names(spark, d):
    n = notes(spark, d).select("id", "title", "body", "mtime_ms", F.concat(F.lit("N"), "id").alias("base"))
    return S.search(S.stored(n, "based notes:" + version(spark, d, "documents")), "N77").select("id", F.round("score", 6).alias("score"))


CONV = f"""c AS (SELECT conv_id AS id, 'c/' || conv_id AS permalink, 'talk ' || conv_id AS title, arg_max(text, turn) AS last, list({{'category': role, 'content': text}} ORDER BY turn) AS o FROM conversations GROUP BY conv_id),
q AS (SELECT unnest(['thnt', 'threa', 'attion']) AS q), e AS (SELECT id, permalink, generate_subscripts(o, 1) - 1 AS pos, unnest(o) AS o FROM c), s AS (SELECT *, {Q.terms("o.category || ' ' || o.content")} AS w FROM e),
ob AS (SELECT 'observation' AS kind, id, permalink, pos, o.content AS match, list_sum([CASE WHEN list_contains(w, q) THEN 1.0 WHEN length(q) >= 5 AND len([y for y in w if starts_with(y, q)]) > 0 THEN 0.6 ELSE 0.0 END for q in ['thnt', 'threa', 'attion']]) / 3.0 AS score FROM s),
re AS (SELECT 'relation' AS kind, id, permalink, 0 AS pos, 'follows_on [[' || last || ']]' AS match, len([q for q in ['thnt', 'threa', 'attion'] if list_contains({Q.terms("'follows on ' || last")}, q)]) / 3.0 AS score FROM c),
h AS (SELECT * FROM ob WHERE score > 0 UNION ALL SELECT * FROM re WHERE score > 0), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, permalink || CASE kind WHEN 'observation' THEN '#' ELSE '@' END || lpad(pos::VARCHAR, 5, '0')) AS rank, count(*) OVER () AS total FROM h)"""


def _talks(spark, d):
    c = read(spark, d, "conversations").groupBy(F.col("conv_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("category"), F.col("text").alias("content")))).alias("observations"), F.max_by("text", "turn").alias("last"))
    rel = F.array(F.struct(F.lit("follows_on").alias("type"), F.col("last").alias("target")))
    return c.select("id", F.concat(F.lit("c/"), "id").alias("permalink"), F.concat(F.lit("talk "), "id").alias("title"), F.col("last").alias("body"), "observations", rel.alias("relations"), F.lit(0).cast("bigint").alias("mtime_ms"))


@query("search_all_kinds", f"WITH {CONV} SELECT kind, permalink, pos::INTEGER AS pos, match, round(score, 6) AS score, rank::INTEGER AS rank, total, total > 20 AS has_more FROM r WHERE rank BETWEEN 11 AND 20")
def all_kinds(spark, d):
    talks = _talks(spark, d)
    ix = S.Index(talks, None, None, None, 0, 1.0)
    found = S.find(ix, "thnt threa attion", kinds=("observation", "relation"), page=2)
    return found.select("kind", "permalink", "pos", "match", F.round("score", 6).alias("score"), "rank", "total", "has_more")


EVERYTHING = f"""{CONV}, ent AS (WITH notes AS (SELECT id, title, last AS body FROM c), {_bm25_sql(['thnt', 'threa', 'attion'])} SELECT id, score FROM r),
u AS (SELECT 'entity' AS kind, c.id, c.permalink, NULL::BIGINT AS pos, NULL AS match, c.title, score, c.permalink AS key FROM ent JOIN c USING (id)
  UNION ALL SELECT 'observation', id, permalink, pos, match, e.o.category || ': ' || CASE WHEN length(match) > 80 THEN left(match, 79) || '…' ELSE match END, score, permalink || '#' || lpad(pos::VARCHAR, 5, '0') FROM ob JOIN (SELECT id, pos, o FROM e) e USING (id, pos) WHERE score > 0
  UNION ALL SELECT 'relation', id, permalink, pos, match, 'follows_on: ' || last, score, permalink || '@' || lpad(pos::VARCHAR, 5, '0') FROM re JOIN (SELECT id, last FROM c) c USING (id) WHERE score > 0),
w AS (SELECT *, row_number() OVER (ORDER BY score DESC, key) AS rank, count(*) OVER () AS total FROM u)"""


@query("search_everything", f"WITH {EVERYTHING} SELECT kind, permalink, pos::INTEGER AS pos, title, match, round(score, 6) AS score, rank::INTEGER AS rank, total, total > 60 AS has_more FROM w WHERE rank <= 60")
def everything(spark, d):
    """Notes, observations and relations on one page, by score."""
    talks = _talks(spark, d)
    found = S.find(S.build(talks), "thnt threa attion", kinds=("entity", "observation", "relation"), page_size=60)
    return found.select("kind", "permalink", "pos", "title", "match", F.round("score", 6).alias("score"), "rank", "total", "has_more")


@query("search_result_fields", f"""WITH {CONV} SELECT split_part(match, ' ', 1) AS word, kind AS type, permalink AS entity, CASE kind WHEN 'observation' THEN match ELSE match END AS content, '1970-01-01T00:00:00.000Z' AS updated_at FROM r WHERE rank <= 10""")
def result_fields(spark, d):
    talks = _talks(spark, d).withColumn("path", F.concat("permalink", F.lit(".md"))).withColumn("type", F.lit("talk")).withColumn("external_id", X.stable_id("permalink"))
    found = S.find(S.Index(talks, None, None, None, 0, 1.0), "thnt threa attion", kinds=("observation", "relation"))
    r = S.result_fields(found, talks)
    return r.select(F.split_part("content", F.lit(" "), F.lit(1)).alias("word"), "type", "entity", "content", "updated_at")


# ---- hubs and advice ----


@query("structure_group_topics", f"""{N}, w AS (SELECT DISTINCT theme AS root, id, unnest({Q.significant('title')}) AS word FROM (SELECT theme, id, CASE WHEN {Q.secret('title')} THEN '{Q.MASK}' ELSE title END AS title FROM notes)),
c AS (SELECT root, word, count(*) AS n FROM w GROUP BY root, word HAVING n >= 2) SELECT root, word AS topic, n AS notes FROM c QUALIFY row_number() OVER (PARTITION BY root ORDER BY n DESC, word) = 1""")
def group_topics(spark, d):
    n = notes(spark, d)
    return A.group_topics(n.select(F.col("theme").alias("root"), "id"), n.select("id", F.explode(X.significant_words(F.col("title"))).alias("word")))


@query("usage_top_read_hubs", f"WITH {ACTIVITY_SQL} SELECT id, count(*) AS uses FROM activity WHERE type IN ('read', 'search') AND id % 9 = 0 GROUP BY id ORDER BY uses DESC, id LIMIT 3")
def top_read_hubs(spark, d):
    return A.top_read_hubs(activity(spark, d), notes(spark, d).where("id % 9 = 0"))


@query("notes_about_topic", f"{N}, s AS (SELECT id, contains(lower(concat_ws(' ', title, id::VARCHAR, subtheme)), 'attion')::INT + contains(lower(concat_ws(' ', title, id::VARCHAR, subtheme)), 'fr')::INT + contains(lower(concat_ws(' ', title, id::VARCHAR, subtheme)), '7')::INT AS score FROM notes) SELECT id, score FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 25")
def about(spark, d):
    return A.about(notes(spark, d).withColumn("label", F.col("title")), "Attion FR 7", 25)


@query("advice_size_warnings", f"WITH {ACTIVITY_SQL}, {NOTES_SQL} SELECT actor AS session, id, min(t) AS t, tokens FROM activity JOIN notes USING (id) WHERE type = 'read' AND tokens > 500 GROUP BY ALL")
def size_warnings(spark, d):
    reads = activity(spark, d).where("type = 'read'").select(F.col("actor").alias("session"), "id", "t")
    return A.size_warnings(reads, notes(spark, d), 500)


@query("advice_index_warnings", f"WITH {ACTIVITY_SQL}, {NOTES_SQL}, k AS (SELECT id, tokens, CASE WHEN id % 7 = 0 AND tokens > 100 THEN 'index' WHEN tokens > 500 THEN 'size' END AS kind FROM notes) SELECT actor AS session, id, min(t) AS t, tokens, kind FROM activity JOIN k USING (id) WHERE type = 'read' AND kind IS NOT NULL GROUP BY ALL")
def index_warnings(spark, d):
    """Every seventh note an index, with a bound of its own."""
    reads = activity(spark, d).where("type = 'read'").select(F.col("actor").alias("session"), "id", "t")
    return A.index_warnings(reads, notes(spark, d).withColumn("theme", F.when(F.col("id") % 7 == 0, "index").otherwise("work")), 100, 500)


@query("advice_duplicate_hints", f"""{N}, w AS (SELECT id, tokens, {Q.significant('title')} AS words FROM (SELECT id, tokens, CASE WHEN {Q.secret('title')} THEN '{Q.MASK}' ELSE title END AS title FROM notes)), k AS (SELECT * FROM w WHERE len(words) > 0),
s AS (SELECT a.id AS write, b.id, b.tokens, len(list_intersect(a.words, b.words)) AS shared, len(a.words) AS m FROM k a JOIN k b ON a.id % 100 = 0 AND b.id % 100 <> 0)
SELECT write, id, shared FROM s WHERE shared >= 2 AND shared >= ceil(0.6 * m) QUALIFY row_number() OVER (PARTITION BY write ORDER BY shared DESC, tokens DESC, id) <= 2""")
def duplicate_hints(spark, d):
    """Every hundredth note as one being written, against all others."""
    n = notes(spark, d).select("id", "tokens", X.significant_words(F.col("title")).alias("words"))
    return A.duplicate_hints(n.where("id % 100 = 0").withColumnRenamed("id", "write"), n.where("id % 100 <> 0"))


@query("advice_slug_hints", """SELECT doc_id AS write, source || ' Note ' || lang AS title, source || '-note-' || lang AS slug, doc_id % 5 = 0 AS at_root FROM documents WHERE doc_id % 3 <> 0
UNION ALL SELECT doc_id, source || '-' || lang, NULL, true FROM documents WHERE doc_id % 15 = 0""")
def slug_hints(spark, d):
    n = notes(spark, d)
    title = F.when(F.pmod("id", F.lit(3)) == 0, F.concat("theme", F.lit("-"), "subtheme")).otherwise(F.concat(F.lit(" "), "theme", F.lit(" Note "), "subtheme"))
    return A.slug_hints(n.select(F.col("id").alias("write"), title.alias("title"), F.when(F.pmod("id", F.lit(5)) == 0, "./Memory/").otherwise("memory\\deep").alias("directory")))


@query("advice_hub_hints", f"""{N}, m AS (SELECT id, theme, CASE WHEN {Q.secret('title')} THEN '{Q.MASK}' ELSE title END AS title FROM notes), w AS (SELECT id, {Q.significant('title')} AS words FROM m),
l AS (SELECT id % 10 AS hub, id AS part FROM notes WHERE id % 3 = 0 AND id <> id % 10 AND id % 10 < 5 AND id % 8 <> 7 AND id % 10 % 8 <> 7), dc AS (SELECT id % 10 AS hub, id AS part FROM notes WHERE id % 4 = 1 AND id <> id % 10 AND id % 8 <> 7 AND id % 10 % 8 <> 7),
p AS (SELECT * FROM l UNION ALL SELECT * FROM dc WHERE hub NOT IN (SELECT hub FROM l)), x AS (SELECT t.id AS write, p.hub, p.part, len(list_intersect(a.words, b.words)) AS s FROM notes t JOIN p ON p.hub = t.id % 10 JOIN w a ON a.id = p.part JOIN w b ON b.id = t.id WHERE t.id % 50 < 10),
r AS (SELECT *, row_number() OVER (PARTITION BY write ORDER BY s DESC, part::VARCHAR) AS k, count(*) OVER (PARTITION BY write) AS n FROM x) SELECT write, hub, list(part::VARCHAR ORDER BY k) AS shown, any_value(n) > 4 AS more FROM r WHERE k <= 4 GROUP BY write, hub""")
def hub_hints(spark, d):
    n = notes(spark, d)
    listed = n.where("id % 3 = 0 AND id % 10 < 5").select((F.col("id") % 10).alias("hub"), F.col("id").alias("part"), F.lit("").alias("hook"))
    declared = n.where("id % 4 = 1").select((F.col("id") % 10).alias("hub"), F.col("id").alias("part"))
    parts = A.hub_parts(listed, declared, n.where("id % 8 = 7"))
    writes = n.where("id % 50 < 10").select(F.col("id").alias("write"), (F.col("id") % 10).alias("hub"), F.col("title").alias("added"))
    return A.hub_hints(writes, parts, n.select("id", F.lit("").alias("description"), F.col("title").alias("label")))


@query("advice_outlines", "SELECT conv_id AS id, string_agg('  - ' || role || ' (' || ceil(octet_length(encode(text)) / 4.0)::BIGINT || ' tokens)', chr(10) ORDER BY turn) AS outline FROM conversations GROUP BY conv_id")
def outlines(spark, d):
    c = read(spark, d, "conversations")
    return A.outlines(c.select(F.col("conv_id").alias("id"), F.col("turn").alias("pos"), F.lit(3).alias("level"), F.col("role").alias("title"), X.tokens("text").alias("tokens")))


# ---- splits ----


@query("split_free_slugs", f"""{N}, w AS (SELECT id % 20 AS plan, id AS pos, theme AS base FROM notes WHERE id % 3 <> 0), u AS (SELECT 'src' || (id % 5) AS base, CASE WHEN id % 2 = 0 THEN 1 ELSE id % 7 + 2 END AS k FROM notes WHERE id < 40), g AS (SELECT base, list(DISTINCT k) AS used FROM u GROUP BY base),
r AS (SELECT plan, pos, w.base, row_number() OVER (PARTITION BY plan, w.base ORDER BY pos) AS r, coalesce(used, []) AS used FROM w LEFT JOIN g ON g.base = w.base),
f AS (SELECT plan, pos, base, [k for k in range(1, (r + len(used) + 1)::BIGINT) if NOT list_contains(used, k)][r] AS k FROM r) SELECT plan, pos, CASE WHEN k = 1 THEN base ELSE base || '-' || k END AS slug FROM f""")
def free_slugs(spark, d):
    n = notes(spark, d)
    existing = n.where("id < 40").select(F.concat(F.lit("SRC"), F.col("id") % 5, F.when(F.col("id") % 2 == 0, "").otherwise(F.concat(F.lit("-"), F.col("id") % 7 + 2))).alias("slug"))
    return A.free_slugs(n.where("id % 3 <> 0").select((F.col("id") % 20).alias("plan"), F.col("id").alias("pos"), F.col("theme").alias("base")), existing)


SECTIONS = """s AS (SELECT conv_id AS note, role || ' ' || (turn // 2) AS title, turn * 3 AS start, turn * 3 + CASE WHEN turn % 4 = 0 THEN 6 ELSE 3 END AS "end" FROM conversations)"""


def _spans(spark, d):
    c, t = read(spark, d, "conversations"), F.col("turn")
    return c.select(F.col("conv_id").alias("note"), F.concat("role", F.lit(" "), F.floor(t / 2)).alias("title"), (t * 3).alias("start"), (t * 3 + F.when(t % 4 == 0, 6).otherwise(3)).alias("end"))


@query("split_check_moves", f"""WITH {SECTIONS}, w AS (SELECT DISTINCT note, 'part' || (start % 2) AS slug, title AS heading FROM s UNION SELECT DISTINCT note, 'part9', 'no such heading' FROM s),
e AS (SELECT note, slug, heading, count(start) AS found, min(start) AS start, min("end") AS "end" FROM w LEFT JOIN s USING (note) WHERE title = heading GROUP BY ALL UNION ALL SELECT DISTINCT note, 'part9', 'no such heading', 0, NULL, NULL FROM s),
o AS (SELECT a.note, a.slug, a.heading, count(*) AS n FROM e a JOIN e b ON a.note = b.note AND a.found = 1 AND b.found = 1 AND a.start < b."end" AND b.start < a."end" AND (a.slug, a.heading) <> (b.slug, b.heading) GROUP BY ALL)
SELECT note, slug, heading, found, coalesce(n, 0) AS overlaps FROM e LEFT JOIN o USING (note, slug, heading)""")
def check_moves(spark, d):
    s = _spans(spark, d)
    wanted = s.select("note", F.concat(F.lit("part"), F.col("start") % 2).alias("slug"), F.col("title").alias("heading")).distinct()
    wanted = wanted.unionByName(s.select("note", F.lit("part9").alias("slug"), F.lit("no such heading").alias("heading")).distinct())
    return A.check_moves(s, wanted).select("note", "slug", "heading", "found", "overlaps")


@query("split_move_sections", f"""WITH {SECTIONS}, i AS (SELECT note, start, "end", row_number() OVER (PARTITION BY note ORDER BY start) - 1 AS k FROM s), m AS (SELECT note, start, start + 3 AS "end" FROM i WHERE k IN (1, 3)),
l AS (SELECT conv_id AS note, unnest(range(0, (max(turn) * 3 + 6)::BIGINT)) AS n FROM conversations GROUP BY conv_id) SELECT l.note, n, CASE WHEN m.note IS NOT NULL THEN 'moved' END AS slug FROM l LEFT JOIN m ON m.note = l.note AND n >= start AND n < "end" """)
def moves(spark, d):
    s = _spans(spark, d).withColumn("end", F.col("start") + 3)
    lines = read(spark, d, "conversations").groupBy(F.col("conv_id").alias("note")).agg((F.max("turn") * 3 + 6).alias("m")).select("note", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1)).alias("n")).withColumn("line", F.lit("x"))
    chosen = s.select("note").distinct().select("note", F.lit("moved").alias("slug"), F.explode(F.array(F.lit(1), F.lit(3))).alias("index"))
    return A.move_sections(lines, A.move_by_index(s, chosen)).select("note", "n", "slug")


# ---- streams ----


def _stream(spark, d):
    e = stream(spark, d, "events")
    kind = F.when(F.col("event_type") == "click", "search").when(F.col("event_type") == "view", "read").when(F.col("event_type") == "purchase", "write")
    k, ts = F.get_json_object("props", "$.k").cast("bigint"), F.col("ts").cast("timestamp")
    return e.select(
        kind.alias("type"), F.col("user_id").alias("actor"), k.alias("id"), F.unix_millis(ts).alias("t"), ts.alias("ts"),
        F.concat(F.lit("s"), F.pmod("user_id", F.lit(3))).alias("source"), F.concat(F.lit("k"), k).alias("word"),
    ).where("type IS NOT NULL")


def _run(spark, rows):
    return T.run_available(rows, f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}")


BOTH = f"""WITH {ACTIVITY_SQL}, b AS (SELECT actor, type, id, t, 'k' || id AS word, lead(type) OVER w AS nt, lead(id) OVER w AS ni, lead(t) OVER w AS tt FROM activity WHERE type IN ('search', 'read') WINDOW w AS (PARTITION BY actor ORDER BY t, call_id))"""


@query("stream_daily_counters", f"WITH {ACTIVITY_SQL} SELECT day, id, count(*) FILTER (type = 'search') AS search, count(*) FILTER (type = 'read') AS read, count(*) FILTER (type = 'write') AS write FROM activity GROUP BY day, id HAVING day + INTERVAL 2 DAY <= (SELECT make_timestamp_ms(max(t)) FROM activity)")
def stream_counters(spark, d):
    """Days that the watermark has passed."""
    return _run(spark, T.daily_counters(_stream(spark, d)))


@query("stream_learned_aliases", f"""WITH {ACTIVITY_SQL}, b AS (SELECT *, last_value(CASE WHEN type = 'search' THEN t END IGNORE NULLS) OVER w AS since, last_value(CASE WHEN type = 'search' THEN 'k' || id END IGNORE NULLS) OVER w AS word
  FROM activity WHERE type IN ('search', 'read') WINDOW w AS (PARTITION BY actor ORDER BY t, call_id ROWS UNBOUNDED PRECEDING)) SELECT word, id AS note, t FROM b WHERE type = 'read' AND t - since <= 86400000""")
def stream_aliases(spark, d):
    return _run(spark, T.learned_aliases(_stream(spark, d), 86_400_000))


@query("stream_futile_searches", BOTH + """, e AS (SELECT actor, max(t) AS last_t FROM activity GROUP BY actor), m AS (SELECT max(t) AS m FROM activity)
SELECT actor, word, b.t FROM b JOIN e USING (actor), m WHERE type = 'search' AND (nt = 'search' OR nt = 'read' AND tt - b.t > 86400000 OR nt IS NULL AND last_t + 86400000 < m + 1 - 86400000)""")
def stream_futile(spark, d):
    """Settled by the actor's next call, or when the watermark leaves the actor's last one behind by a day."""
    return _run(spark, T.futile_searches(_stream(spark, d), 86_400_000)).select("actor", "word", "t")


@query("stream_repeat_stubs", f"WITH {ACTIVITY_SQL} SELECT actor AS session, id, t, row_number() OVER (PARTITION BY actor, id ORDER BY t, call_id) % 2 = 0 AS stub FROM activity WHERE type = 'read'")
def stream_stubs(spark, d):
    """Reads of content that never changes: every second one of a session is a stub."""
    reads = _stream(spark, d).where("type = 'read'").select(F.col("actor").alias("session"), "id", "t", F.col("word").alias("hash"))
    return _run(spark, T.repeat_stubs(reads))


@query("stream_closed_episodes", f"WITH {ACTIVITY_SQL} SELECT s.actor, s.t, min(r.t) AS read_t, min(r.t) - s.t AS delay FROM activity s LEFT JOIN activity r ON r.type = 'read' AND r.actor = s.actor AND r.t BETWEEN s.t AND s.t + 3600000 WHERE s.type = 'search' AND s.t + 3600000 < (SELECT max(t) FROM activity WHERE type IN ('search', 'read')) - 10000 GROUP BY s.call_id, s.actor, s.t")
def stream_episodes(spark, d):
    return _run(spark, T.closed_episodes(_stream(spark, d), 3_600_000))


@query("stream_write_dedup", f"""WITH RECURSIVE {ACTIVITY_SQL}, e AS (SELECT id, t, CASE WHEN source = 's0' THEN 'reported' ELSE 'disk' END AS source, row_number() OVER (PARTITION BY id ORDER BY t, call_id) AS i FROM activity WHERE type = 'write'),
r AS (SELECT id, i, t, source, true AS counted, CASE WHEN source = 'reported' THEN t END AS rep, CASE WHEN source = 'disk' THEN t END AS dsk FROM e WHERE i = 1 UNION ALL
 SELECT e.id, e.i, e.t, e.source, NOT hit, CASE WHEN e.source = 'reported' THEN CASE WHEN hit THEN rp ELSE e.t END ELSE CASE WHEN hit THEN NULL ELSE rp END END, CASE WHEN e.source = 'disk' THEN CASE WHEN hit THEN ds ELSE e.t END ELSE CASE WHEN hit THEN NULL ELSE ds END END
 FROM (SELECT e.*, rp, ds, CASE WHEN e.source = 'reported' THEN ds IS NOT NULL ELSE rp IS NOT NULL END AS hit FROM (SELECT e.*, CASE WHEN e.t - r.rep <= 15000 THEN r.rep END AS rp, CASE WHEN e.t - r.dsk <= 15000 THEN r.dsk END AS ds FROM r JOIN e ON e.id = r.id AND e.i = r.i + 1) e) e)
SELECT id, source, t FROM r WHERE counted""")
def stream_dedup(spark, d):
    """Writes of one source as reports, of the others as changes on disk."""
    s = _stream(spark, d).withColumn("source", F.when(F.col("source") == "s0", "reported").otherwise("disk"))
    return _run(spark, T.dedup_writes(s))


def _measure(texts):
    return [[float(len(t)), 1.0] for t in texts]


@query("stream_vectors", """WITH p AS (SELECT 'c' || conv_id || '/' || turn AS permalink, text, unnest(range(0, greatest(ceil(length(text) / 1600.0)::BIGINT, 1))) AS k FROM conversations WHERE trim(coalesce(text, '')) <> ''),
e AS (SELECT permalink, k, 'T' || chr(10) || chr(10) || trim(substr(text, k * 1600 + 1, 1600)) AS i FROM p)
SELECT permalink || '#0.' || k AS key, permalink, '' AS heading, sha1(i) AS hash, length(i) / sqrt(length(i)::DOUBLE * length(i) + 1) AS x FROM e""")
def stream_vectors(spark, d):
    """Every turn a note, embedded by its length, as the stream of turns brings it."""
    turns = stream(spark, d, "conversations")
    name = F.concat(F.lit("c"), "conv_id", F.lit("/"), "turn")
    none = F.lit(None).cast("string")
    notes = turns.select(name.alias("permalink"), F.lit("T").alias("title"), none.alias("description"), "text", F.lit(False).alias("removed"), F.col("turn").cast("bigint").alias("t"))
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    q = VS.follow(notes, f"{path}/vectors", f"{path}/checkpoint", _measure)
    q.awaitTermination()
    done = max((p["batchId"] for p in q.recentProgress if p["numInputRows"]), default=-1)  # progress comes without a batch, too
    return VS.stored(spark, f"{path}/vectors", done).select("key", "permalink", "heading", "hash", F.get("vector", F.lit(0)).alias("x"))
