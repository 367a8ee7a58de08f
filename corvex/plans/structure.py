"""The structure audit and its fixes over a knowledge base made of the supplied documents, and SQL for both.

Each document is a note n<id> with its source as theme and its language as subtheme; notes declare, list and link each
other by rules over their ids, and an index lists every ninth of them in sections by theme and language.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corvex.functions import text as X
from corvex.operators import archive as A
from corvex.operators import reshape as R
from corvex.operators import structure as S
from corvex.sources import front_matter as Y

from . import sqltext as Q
from .registry import query
from .tables import NOTES_SQL, notes, read

INDEX = "index"


def _base(spark, d):
    """id, text, folder, label, description of the notes and the index."""
    c, lit = F.col, F.lit
    n = notes(spark, d).select(c("id").alias("k"), "theme", "subtheme", F.coalesce(F.split_part("title", lit(" "), lit(1)), lit("")).alias("word"))
    name = lambda x: F.concat(lit("n"), x.cast("string"))
    link = lambda x: F.concat(lit("[["), name(x), lit("]]"))
    hub = c("k") % 10
    head = F.concat(
        lit("---\ntheme: "), "theme", lit("\nsubtheme: "), "subtheme", F.when(c("k") % 4 == 1, F.concat(lit("\npart_of: "), name(hub))).otherwise(""),
        F.when(c("k") % 11 == 3, "\nstatus: archived").otherwise(""), lit("\n---\n\n"))
    listing = n.where("k % 3 = 0").select((c("k") % 10).alias("h"), c("k").alias("part")).union(n.where("k % 30 = 0").select(((c("k") + 1) % 10).alias("h"), c("k").alias("part"))).where("h <> part")
    parts = listing.groupBy("h").agg(F.concat(lit("\n## Parts\n"), F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: F.concat(lit("- "), link(p), lit(" — x\n"))), "")).alias("parts"))
    body = F.concat(
        lit("# "), name(c("k")), lit("\n"), F.when(c("k") % 8 == 1, F.concat(lit("Up: "), link(hub), lit("\n"))).otherwise(""),
        F.when(c("k") % 5 == 2, F.concat(lit("see "), link((c("k") * 7 + 3) % 50), lit("\n"))).otherwise(""),
        F.when(c("k") % 16 == 1, F.concat(lit("Also "), link(c("k") + 40), lit(" and "), link(c("k") + 80), lit("\n"))).otherwise(""),
        lit("```\n[[n0]] [[n1]]\n```\n"), F.coalesce("parts", lit("")))
    made = n.join(parts, c("k") == c("h"), "left").select(name(c("k")).alias("id"), F.concat(head, body).alias("text"), c("theme").alias("folder"), c("word").alias("label"), lit("").alias("description"))
    low = n.agg(F.min("theme").alias("low"), F.min(F.when(c("theme") > "src0", c("theme"))).alias("next"))
    listed = n.where("k % 9 = 0").crossJoin(F.broadcast(low))  # one row
    section = F.when(c("k") % 27 == 9, "Archive").when(c("theme") == c("low"), c("next")).otherwise(c("theme"))
    entries = listed.select(section.alias("section"), F.when(section != "Archive", c("subtheme")).otherwise("").alias("sub"), "k")
    subs = entries.groupBy("section", "sub").agg(F.array_join(F.transform(F.array_sort(F.collect_list("k")), lambda k: F.concat(lit("- "), link(k), lit("\n"))), "").alias("t"))
    subs = subs.select("section", "sub", F.concat(F.when(c("sub") != "", F.concat(lit("### "), "sub", lit("\n"))).otherwise(""), "t", lit("\n")).alias("t"))
    secs = subs.groupBy("section").agg(F.concat(lit("## "), "section", lit("\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sub", "t"))), lambda x: x["t"]), "")).alias("t"))
    text = secs.agg(F.concat(lit("# Index\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "t"))), lambda x: x["t"]), "")).alias("text"))
    index = text.select(lit(INDEX).alias("id"), "text", lit("").alias("folder"), lit("Index").alias("label"), lit("").alias("description"))
    return made.unionByName(index)


def _structure(spark, d):
    return S.Structure(_base(spark, d), INDEX, themes=(), structural=False)


def _words(spark, d):
    n = notes(spark, d)
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("title"), F.lit(r"([\p{L}\p{N}]+)"), 1), lambda w: (F.length(w) >= 3) & ~X.is_stop(w)))
    return n.select(F.concat(F.lit("n"), "id").alias("id"), "theme", "subtheme", "tokens", words.alias("words"), words.alias("title_words"))


ISSUES = f"""{NOTES_SQL}, n AS (SELECT id AS k, 'n' || id AS id, theme, subtheme AS sub, id % 10 AS h, id % 4 = 1 AS has_key, id % 11 = 3 AS archived FROM notes), low AS (SELECT min(theme) AS low, min(theme) FILTER (theme > 'src0') AS next FROM n),
l AS (SELECT k % 10 AS h, k FROM n WHERE k % 3 = 0 AND k % 10 <> k UNION SELECT (k + 1) % 10, k FROM n WHERE k % 30 = 0), ls AS (SELECT DISTINCT 'n' || h AS hub, 'n' || k AS part FROM l WHERE h <> k AND h IN (SELECT k FROM n)),
e AS (SELECT id AS src, 'n' || h AS dst FROM n WHERE k % 8 = 1 UNION SELECT id, 'n' || ((k * 7 + 3) % 50) FROM n WHERE k % 5 = 2 UNION SELECT id, 'n' || (k + unnest([40, 80])) FROM n WHERE k % 16 = 1 UNION SELECT hub, part FROM ls),
ed AS (SELECT src, dst FROM e WHERE src <> dst AND dst IN (SELECT id FROM n)),
dc AS (SELECT id AS part, 'n' || h AS hub FROM n WHERE has_key AND h <> k), cf AS (SELECT * FROM dc UNION SELECT id, 'n' || h FROM n WHERE k % 8 = 1 AND NOT has_key AND h <> k),
ix AS (SELECT n.*, CASE WHEN k % 27 = 9 THEN 'Archive' WHEN theme = low THEN next ELSE theme END AS section, theme = low AND low NOT IN (SELECT CASE WHEN theme = low THEN next ELSE theme END FROM n, low WHERE k % 9 = 0 AND k % 27 <> 9) AS bad FROM n, low WHERE k % 9 = 0),
ok AS (SELECT DISTINCT section AS t FROM ix UNION SELECT 'archive'), bad AS (SELECT id FROM n WHERE theme NOT IN (SELECT t FROM ok)),
r1 AS (SELECT 'R1' AS rule, '{INDEX}' AS note, part, hub, NULL AS section, NULL AS sub, NULL AS fix, CASE WHEN hub IN (SELECT id FROM ix) THEN 'its hub is listed too' END AS detail FROM dc WHERE part IN (SELECT id FROM ix)),
r2 AS (SELECT 'R2', part, NULL, hub, NULL, NULL, 'add-up-line', NULL FROM dc WHERE NOT EXISTS (SELECT 1 FROM ed WHERE src = part AND dst = hub)),
r3 AS (SELECT 'R3', hub, part, hub, NULL, NULL, 'append-hub-parts-line', NULL FROM dc WHERE EXISTS (SELECT 1 FROM ed WHERE src = part AND dst = hub) AND NOT EXISTS (SELECT 1 FROM ed WHERE src = hub AND dst = part)),
cl AS (SELECT part, min(hub) AS hub, count(*) AS c FROM ls WHERE part NOT IN (SELECT id FROM n WHERE has_key) GROUP BY part),
r3b AS (SELECT 'R3', part, NULL, CASE WHEN c = 1 THEN hub END, NULL, NULL, CASE WHEN c = 1 THEN 'add-part-of' END, CASE WHEN c > 1 THEN 'claimed by ' || c || ' hubs' END FROM cl),
r4 AS (SELECT 'R4', x.part, string_agg(y.part, ',' ORDER BY y.part), x.hub, NULL, NULL, NULL, 'sibling links alone' FROM cf x JOIN n ON n.id = x.part AND n.k % 16 = 1 JOIN cf y ON y.hub = x.hub AND y.part IN ('n' || (n.k + 40), 'n' || (n.k + 80)) GROUP BY x.part, x.hub HAVING count(*) > 1),
r5 AS (SELECT 'R5', id, NULL, NULL, NULL, NULL, NULL, CASE WHEN id IN (SELECT id FROM bad) THEN 'invalid theme' END FROM n WHERE id NOT IN (SELECT id FROM ix) AND id NOT IN (SELECT part FROM cf) AND id NOT IN (SELECT part FROM ls)),
st AS (SELECT sub, min(theme) AS t FROM n WHERE id NOT IN (SELECT id FROM bad) GROUP BY sub HAVING count(DISTINCT theme) = 1),
r7 AS (SELECT 'R7', n.id, NULL, NULL, coalesce(CASE WHEN n.sub IN (SELECT t FROM ok) THEN n.sub END, st.t, hn.theme), NULL, NULL, 'theme ' || n.theme FROM n LEFT JOIN st USING (sub) LEFT JOIN dc ON dc.part = n.id LEFT JOIN n hn ON hn.id = dc.hub AND hn.id NOT IN (SELECT id FROM bad) WHERE n.id IN (SELECT id FROM bad)),
hm AS (SELECT theme, min(section) AS home FROM ix WHERE section <> 'Archive' AND id NOT IN (SELECT id FROM bad) GROUP BY theme HAVING count(DISTINCT section) = 1),
sb AS (SELECT section, sub AS sb, count(*) AS c FROM ix WHERE section <> 'Archive' GROUP BY section, sub), wr AS (SELECT ix.*, home FROM ix LEFT JOIN hm USING (theme) WHERE section = 'Archive' AND NOT archived),
r6 AS (SELECT 'R6', '{INDEX}', id, NULL, home, (SELECT sb FROM sb WHERE sb.section = home ORDER BY CASE WHEN sb = wr.sub THEN 0 ELSE 1 END, c DESC, sb LIMIT 1), CASE WHEN home IS NOT NULL THEN 'move-index-line' END, CASE WHEN id IN (SELECT id FROM bad) THEN 'active, invalid theme' ELSE 'active' END FROM wr
  UNION ALL SELECT 'R6', '{INDEX}', id, NULL, 'Archive', NULL, 'move-index-line', 'archived' FROM ix WHERE section <> 'Archive' AND archived AND 'Archive' IN (SELECT section FROM ix)),
i AS (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3 UNION ALL SELECT * FROM r3b UNION ALL SELECT * FROM r4 UNION ALL SELECT * FROM r5 UNION ALL SELECT * FROM r6 UNION ALL SELECT * FROM r7)"""


D1 = f"""p AS (SELECT id, theme, subtheme, tokens, [w for w in list_distinct(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}]+')) if length(w) >= 3 AND w NOT IN ({Q.STOPS})] AS words FROM notes ORDER BY tokens DESC, 'n' || id LIMIT 300), kk AS (SELECT * FROM p WHERE len(words) >= 6),
dd AS (SELECT least('n' || a.id, 'n' || b.id) AS a, greatest('n' || a.id, 'n' || b.id) AS b, len(list_intersect(a.words, b.words)) AS shared, least(len(a.words), len(b.words)) AS m FROM kk a JOIN kk b ON a.id < b.id AND a.theme = b.theme),
d1 AS (SELECT 'D1' AS rule, a AS note, b AS part, NULL AS hub, NULL AS section, NULL AS sub, NULL AS fix, 'score ' || round(shared / m, 2) AS detail FROM dd WHERE shared >= 6 AND shared / m >= 0.7 ORDER BY round(shared / m, 2) DESC, shared DESC, a, b LIMIT 20)"""


@query("structure_issues", f"WITH {ISSUES}, {D1} SELECT * FROM i UNION ALL SELECT * FROM d1")
def issues(spark, d):
    """Every issue of all eight rules."""
    return S.audit(_structure(spark, d), _words(spark, d)).drop("line")


@query("structure_fixes", f"""WITH {ISSUES}, x AS (SELECT note AS id, 'Up: [[' || hub || ']] — part of ' || hub || '.' AS line FROM i WHERE fix = 'add-up-line' UNION ALL SELECT note, 'part_of: ' || hub FROM i WHERE fix = 'add-part-of'
  UNION ALL SELECT i.note, '- [[' || i.part || ']] — ' || coalesce(nullif(split_part(t.title, ' ', 1), ''), i.part) FROM i JOIN notes t ON 'n' || t.id = i.part WHERE fix = 'append-hub-parts-line'
  UNION ALL SELECT DISTINCT note, '## Parts' FROM i WHERE fix = 'append-hub-parts-line' AND note NOT IN (SELECT hub FROM ls))
SELECT id, line FROM x""")
def fixes(spark, d):
    """The lines that the fixes add, note by note; nothing goes but for lines that move within the index."""
    s = _structure(spark, d)
    changes = S.fix(s, S.audit(s))
    each = lambda k: changes.select("id", F.explode(F.split(k, "\n")).alias("line")).where("line <> ''")
    return each("after").exceptAll(each("before"))


@query("structure_after_fixes", f"""WITH {ISSUES}, nw AS (SELECT part, hub FROM cl WHERE c = 1),
a AS (SELECT rule, false AS fixable FROM i WHERE fix IS NULL UNION ALL SELECT 'R1', false FROM nw WHERE part IN (SELECT id FROM ix) UNION ALL SELECT 'R2', true FROM nw WHERE NOT EXISTS (SELECT 1 FROM ed WHERE src = part AND dst = hub)
  UNION ALL SELECT 'R3', true FROM r2 r(rule, part, p, hub, x, y, f, z) WHERE NOT EXISTS (SELECT 1 FROM ed WHERE src = r.hub AND dst = r.part))
SELECT rule, count(*) AS n, count(*) FILTER (fixable) AS fixable, 0::BIGINT AS lost FROM a GROUP BY rule""")
def after_fixes(spark, d):
    """The audit after one round: no line is lost, what asks for judgement stays, and new fixes are those that the first
    ones ask for, a link of each note that now declares its hub and an entry for each that now links to it."""
    base = _base(spark, d)
    s = S.Structure(base, INDEX, themes=(), structural=False)
    changes = S.fix(s, S.audit(s))
    again = S.audit(S.Structure(S.fixed_notes(base, changes), INDEX, themes=(), structural=False))
    lost = S.lost_lines(changes).agg(F.count("*").alias("lost"))
    return again.groupBy("rule").agg(F.count("*").alias("n"), F.count_if(F.col("fix").isNotNull()).alias("fixable")).crossJoin(F.broadcast(lost))  # one row


def _talk_notes(spark, d):
    c = read(spark, d, "conversations")
    line = F.concat(F.lit("## "), "role", F.lit(" "), "turn", F.lit("\n"), F.substring(F.regexp_replace("text", r"\s+", " "), 1, 50), F.lit("\nend "), F.col("turn"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n")
    return c.groupBy(F.concat(F.lit("c"), "conv_id").alias("id")).agg(body.alias("body"))


TALKS = """l AS (SELECT 'c' || conv_id AS note, turn, '## ' || role || ' ' || turn AS head, left(regexp_replace(text, '\\s+', ' ', 'g'), 50) AS t FROM conversations),
g AS (SELECT note, max(CASE WHEN turn = 1 THEN head END) AS one, max(CASE WHEN turn = 2 THEN head END) AS two FROM l GROUP BY note),
ok AS (SELECT note FROM g WHERE one IS NOT NULL AND two IS NOT NULL AND substr(note, 2)::BIGINT % 5 <> 0)"""


def _split(spark, d):
    n, c = _talk_notes(spark, d), read(spark, d, "conversations")
    head = lambda t: F.max(F.when(F.col("turn") == t, F.concat("role", F.lit(" "), "turn")))
    heads = c.groupBy(F.concat(F.lit("c"), "conv_id").alias("note")).agg(head(1).alias("one"), head(2).alias("two"), F.min("conv_id").alias("k"))
    none = F.array().cast("array<string>")
    first = heads.select("note", F.lit(0).alias("pos"), F.lit("The First").alias("slug"), F.lit("one \"turn\"").alias("description"), F.lit("first").alias("hook"), F.array(F.coalesce("one", F.lit("none"))).alias("sections"), none.alias("lines"))
    second = heads.select("note", F.lit(1).alias("pos"), F.concat("note", F.lit(" the first")).alias("slug"), F.lit("more").alias("description"), F.lit("").alias("hook"), F.array(F.when(F.col("k") % 5 == 0, F.coalesce("one", F.lit("none"))).otherwise(F.coalesce("two", F.lit("none")))).alias("sections"), F.array(F.lit("end 0")).alias("lines"))
    return R.split(n, first.unionByName(second))


@query("split_plans", f"""WITH {TALKS}, w AS (SELECT l.* FROM l JOIN ok USING (note)), k AS (SELECT note, regexp_replace(string_agg(CASE WHEN turn = 0 THEN head || chr(10) || t ELSE head || chr(10) || t || chr(10) || 'end ' || turn END, chr(10) ORDER BY turn), '\\s+$', '') AS t FROM w WHERE turn NOT IN (1, 2) GROUP BY note)
SELECT note, note AS id, 'hub' AS role, t || chr(10) || chr(10) || '## Parts' || chr(10) || '- [[' || note || '-the-first]] — first' || chr(10) || '- [[' || note || '-the-first-2]] — more' || chr(10) AS text FROM k
UNION ALL SELECT note, note || '-the-first', 'part', '---' || chr(10) || 'description: "one \\"turn\\""' || chr(10) || 'part_of: ' || note || chr(10) || '---' || chr(10) || chr(10) || head || chr(10) || t || chr(10) || 'end 1' || chr(10) FROM w WHERE turn = 1
UNION ALL SELECT note, note || '-the-first-2', 'part', '---' || chr(10) || 'description: "more"' || chr(10) || 'part_of: ' || note || chr(10) || '---' || chr(10) || chr(10) || 'end 0' || chr(10) || head || chr(10) || t || chr(10) || 'end 2' || chr(10) FROM w WHERE turn = 2""")
def split_plans(spark, d):
    """Each talk split into two parts and a hub; plans with an error change nothing."""
    return _split(spark, d).files


@query("split_errors", f"""WITH {TALKS}, p AS (SELECT note, note || '-the-first' AS a, note || '-the-first-2' AS b, coalesce(substr(one, 4), 'none') AS one, CASE WHEN substr(note, 2)::BIGINT % 5 = 0 THEN coalesce(substr(one, 4), 'none') ELSE coalesce(substr(two, 4), 'none') END AS two FROM g),
w AS (SELECT note, a AS part, one AS h FROM p UNION ALL SELECT note, b, two FROM p), f AS (SELECT w.*, (SELECT count(*) FROM l WHERE l.note = w.note AND substr(l.head, 4) = w.h) AS k FROM w)
SELECT note, part, 'heading ' || h || ' found ' || k || ' times' AS error FROM f WHERE k <> 1 UNION ALL SELECT f.note, part, 'heading ' || h || ' overlaps another part''s' FROM f JOIN p USING (note) WHERE k = 1 AND one = two
UNION ALL SELECT note, part, 'would be empty' FROM f JOIN p USING (note) WHERE k <> 1 AND part = a""")
def split_errors(spark, d):
    return _split(spark, d).errors


FRONT = "'---' || chr(10) || 'theme: ' || theme || chr(10) || '# keep' || chr(10) || 'list:' || chr(10) || '- a' || chr(10) || chr(10) || 'lang:   ' || subtheme || chr(10) || '---' || chr(10) || coalesce(title, '')"


@query("notes_front_matter_merge", f"""WITH {NOTES_SQL}, n AS (SELECT id, theme, subtheme, title, {FRONT} AS t FROM notes) SELECT id AS path, CASE id % 4
  WHEN 0 THEN replace(replace(t, 'theme: ' || theme, 'theme: ''new: one'''), chr(10) || '---' || chr(10), chr(10) || 'added:' || chr(10) || '- x' || chr(10) || '- 1' || chr(10) || '---' || chr(10))
  WHEN 1 THEN replace(t, 'list:' || chr(10) || '- a' || chr(10), '') WHEN 2 THEN replace(replace(t, 'lang:   ' || subtheme, 'lang: ''yes'''), chr(10) || '---' || chr(10), chr(10) || 'n: ' || id || chr(10) || '---' || chr(10)) ELSE t END AS text,
  NULL::VARCHAR AS error FROM n""")
def front_matter_merge(spark, d):
    """Keys set, added and removed; every other line, comments, blanks and spacing included, as it was."""
    n = notes(spark, d)
    nl = F.lit("\n")
    text = F.concat(F.lit("---\ntheme: "), "theme", F.lit("\n# keep\nlist:\n- a\n\nlang:   "), "subtheme", F.lit("\n---"), nl, F.coalesce("title", F.lit("")))
    k = F.pmod("id", F.lit(4))
    ups = F.when(k == 0, F.lit('{"theme": "new: one", "added": ["x", 1]}')).when(k == 1, F.lit('{"list": null}')).when(k == 2, F.concat(F.lit('{"lang": "yes", "n": '), "id", F.lit("}")))
    return Y.merge_all(n.select(F.col("id").alias("path"), text.alias("text")), n.where(k < 3).select(F.col("id").alias("path"), ups.alias("updates")))


# ---- archive: talks in groups of forty by number, each a theme; every third turn goes, and every second theme has an archive ----


def _archived(spark, d):
    c, lit = F.col, F.lit
    t = read(spark, d, "conversations")
    k = F.floor(c("conv_id") / 40)
    line = F.concat(lit("## "), "role", lit(" "), "turn", lit(" of c"), "conv_id", lit("\n"), F.substring(F.regexp_replace("text", r"\s+", " "), 1, 50), lit(".\n"))
    made = t.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "").alias("body"))
    notes = made.select(F.concat(lit("c"), "conv_id").alias("id"), F.concat(lit("---\ntheme: t"), k, lit("\n---\n"), "body").alias("text"), F.concat(lit("t"), k).alias("theme"), F.concat(lit("talks/c"), "conv_id", lit(".md")).alias("path"))
    old = t.where(k % 2 == 0).groupBy(k.alias("k")).agg(F.min("conv_id").alias("first"))
    kept = F.concat(lit("---\ntheme: t"), "k", lit("\ncorvex_archive: true\n---\n\n<!-- corvex:archived from=\"c"), "first", lit("\" date=\"2023-12-31\" -->\n## Old [of] t"), "k", lit("\nx\n"))
    have = old.select(F.concat(lit("t"), "k", lit("-archive")).alias("id"), kept.alias("text"), F.concat(lit("t"), "k").alias("theme"), F.concat(lit("archive/t"), "k", lit("-archive.md")).alias("path"))
    picks = A.units(notes).where(F.regexp_extract("line", r" (\d+) of c\d+$", 1).cast("int") % 3 == 1).select("note", "key")
    return A.archive(notes.unionByName(have), picks, "2024-02-01")


MOVED = """l AS (SELECT conv_id, conv_id // 40 AS k, turn, turn % 3 = 1 AS goes, role || ' ' || turn || ' of c' || conv_id AS h, left(regexp_replace(text, '\\s+', ' ', 'g'), 50) || '.' AS t FROM conversations),
m AS (SELECT *, '## ' || h || chr(10) || t || chr(10) AS unit FROM l), o AS (SELECT conv_id FROM l WHERE goes GROUP BY conv_id), a AS (SELECT k, min(conv_id) AS first FROM l GROUP BY k HAVING bool_or(goes))"""


@query("archive_plan", f"""WITH {MOVED} SELECT 'c' || conv_id AS id, 'talks/c' || conv_id || '.md' AS path, 'origin' AS role, '---' || chr(10) || 'theme: t' || min(k) || chr(10) || '---' || chr(10) ||
  string_agg(CASE WHEN goes THEN 'Archived: ' || h || ' → [[t' || k || '-archive#' || h || ']] (2024-02-01)' || chr(10) ELSE unit END, '' ORDER BY turn) AS text FROM m JOIN o USING (conv_id) GROUP BY conv_id
UNION ALL SELECT 't' || k || '-archive', 'archive/t' || k || '-archive.md', 'archive', CASE WHEN k % 2 = 0 THEN '---' || chr(10) || 'theme: t' || k || chr(10) || 'corvex_archive: true' || chr(10) || '---' || chr(10) || chr(10) || '<!-- corvex:archived from="c' || any_value(first) || '" date="2023-12-31" -->' || chr(10) || '## Old [of] t' || k || chr(10) || 'x' || chr(10)
  ELSE '---' || chr(10) || 'title: "t' || k || ' — archive"' || chr(10) || 'theme: t' || k || chr(10) || 'subtheme: archive' || chr(10) || 'corvex_archive: true' || chr(10) || 'description: "Sections moved out of the notes of t' || k || ', word for word."' || chr(10) || '---' || chr(10) || chr(10) || 'Each section follows a marker that names its note, which keeps a link to it. One line each in [[archive-summary]].' || chr(10) END
  || string_agg(chr(10) || '<!-- corvex:archived from="c' || conv_id || '" date="2024-02-01" -->' || chr(10) || unit, '' ORDER BY 'c' || conv_id, turn) FROM m JOIN a USING (k) WHERE goes GROUP BY k""")
def archive_plan(spark, d):
    """Every note and archive that the plan changes, whole."""
    return _archived(spark, d).files


@query("archive_summary", f"""WITH {MOVED}, e AS (SELECT '2024-02-01' AS date, k, row_number() OVER (PARTITION BY k ORDER BY 'c' || conv_id, turn) - CASE WHEN k % 2 = 0 THEN 0 ELSE 1 END AS pos, h AS title, conv_id AS n, '#' || h AS anchor, ceil(octet_length(encode(unit)) / 4.0)::BIGINT AS tokens FROM m WHERE goes
  UNION ALL SELECT '2023-12-31', k, 0, 'Old [of] t' || k, min(conv_id), '', ceil((length('## Old [of] t' || k) + 3) / 4.0)::BIGINT FROM m WHERE k % 2 = 0 GROUP BY k)
SELECT date, 't' || k || '-archive' AS archive, pos::INT AS pos, '- ' || date || ' · ' || title || ' · from [[c' || n || ']] → [[t' || k || '-archive' || anchor || ']] · ≈ ' || format('{{:,}}', tokens) || ' tokens' AS line FROM e""")
def archive_summary(spark, d):
    return _archived(spark, d).summary
