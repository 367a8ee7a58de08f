"""Graph and structure queries over the pages' links and the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvex.functions import text as X
from corvex.operators import context as C
from corvex.operators import graph as G
from corvex.operators import usage as U

from . import sqltext as Q
from .registry import query
from .tables import ACTIVITY_SQL, EDGES_SQL, NOTES_SQL, activity, edges, notes, read

E = f"WITH RECURSIVE {EDGES_SQL}, both_ways AS (SELECT src AS x, dst AS y FROM edges UNION SELECT dst, src FROM edges)"


@query("graph_edges", f"WITH {EDGES_SQL} SELECT src, dst FROM edges")
def all_edges(spark, d):
    return edges(spark, d)


@query("graph_undirected", f"WITH {EDGES_SQL} SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE src <> dst")
def undirected(spark, d):
    return G.undirected(edges(spark, d))


@query("graph_bfs_2hops", f"{E}, s AS (SELECT min(src) AS s FROM edges), h1 AS (SELECT y AS node FROM both_ways, s WHERE x = s), h2 AS (SELECT DISTINCT y AS node FROM both_ways JOIN h1 ON x = node WHERE y NOT IN (SELECT node FROM h1) AND y <> (SELECT s FROM s)) SELECT s AS node, 0 AS hop FROM s UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2")
def bfs(spark, d):
    e = edges(spark, d)
    return G.neighbours(e, e.agg(F.min("src").alias("node")), 2)


@query("graph_capped_context", f"""WITH RECURSIVE {EDGES_SQL}, s AS (SELECT min(src) AS s FROM edges), p AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS pos FROM edges),
b AS (SELECT src AS x, dst AS y, 0 AS way, pos FROM p UNION ALL SELECT dst, src, 1, pos FROM p), ok AS (SELECT DISTINCT x AS node FROM b WHERE ascii(right(x, 1)) % 4 <> 0),
h1 AS (SELECT y AS node, min([0, way, pos]) AS o FROM b, s WHERE x = s AND y <> s AND y IN (SELECT node FROM ok) GROUP BY y ORDER BY o, node LIMIT 13),
h2 AS (SELECT y AS node, min(list_concat(o, [way, pos])) AS o FROM b JOIN h1 ON x = node, s WHERE y <> s AND y NOT IN (SELECT node FROM h1) AND y IN (SELECT node FROM ok) GROUP BY y ORDER BY o, y LIMIT 13),
u AS (SELECT node, 1 AS hop, o FROM h1 UNION ALL SELECT node, 2, o FROM h2) SELECT node, hop, row_number() OVER (ORDER BY hop, o, node)::INTEGER AS rank FROM u QUALIFY rank <= 13""")
def capped(spark, d):
    """Two hops, only over nodes that a gate lets through, up to a cap beyond the first hop."""
    from pyspark.sql import Window as W

    e = edges(spark, d)
    e = e.withColumn("pos", F.row_number().over(W.partitionBy("src").orderBy("dst")))
    gate = e.select(F.col("src").alias("node")).union(e.select("dst")).where(F.ascii(F.right("node", F.lit(1))) % 4 != 0)
    return G.capped_neighbours(e, e.agg(F.min("src").alias("node")), 2, 13, gate)


COMPONENTS = """lab(node, root) USING KEY (node) AS (SELECT DISTINCT x, x FROM b UNION SELECT b.y, min(lab.root) FROM lab JOIN b ON b.x = lab.node JOIN recurring.lab AS o ON o.node = b.y WHERE lab.root < o.root GROUP BY b.y)"""


@query("graph_components", f"WITH RECURSIVE {EDGES_SQL}, b(x, y) AS (SELECT src, dst FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst), {COMPONENTS} SELECT node, root FROM lab")
def components(spark, d):
    return G.components(edges(spark, d))


@query("graph_degree", f"{E} SELECT x AS node, count(*) AS degree FROM both_ways GROUP BY x")
def degree(spark, d):
    e = edges(spark, d)
    both = e.select(F.col("src").alias("node"), F.col("dst").alias("y")).union(e.select("dst", "src")).distinct()
    return both.groupBy("node").agg(F.count("*").alias("degree"))


@query("graph_orphans", f"WITH {ACTIVITY_SQL}, {NOTES_SQL} SELECT id FROM notes WHERE id NOT IN (SELECT id FROM activity WHERE type = 'read' UNION SELECT doc_id FROM labels WHERE quality = 1)")
def orphans(spark, d):
    reads = activity(spark, d).where("type = 'read'").select("id")
    good = read(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return G.orphans(notes(spark, d).select("id"), reads, good)


@query("graph_related", f"""WITH {ACTIVITY_SQL}, {NOTES_SQL}, e AS (SELECT id AS src, (id * 7 + 3) % 100 AS dst FROM notes), r AS (SELECT DISTINCT day, id FROM activity WHERE type = 'read'),
u AS (SELECT x.id AS id, least(count(*), 5) AS w FROM r x JOIN r y ON x.day = y.day AND x.id <> y.id WHERE y.id = 13 GROUP BY x.id),
v AS (SELECT dst AS id, 3 AS w, 'link' AS why FROM e WHERE src = 13 UNION ALL SELECT src, 3, 'backlink' FROM e WHERE dst = 13 UNION ALL SELECT id, w, 'used together' FROM u
  UNION ALL SELECT n.id, 1, 'subtheme' FROM notes n JOIN notes o ON o.id = 13 AND n.theme = o.theme AND n.subtheme = o.subtheme)
SELECT id, sum(w)::BIGINT AS score, list_sort(list(DISTINCT why)) AS reasons FROM v WHERE id <> 13 GROUP BY id ORDER BY score DESC, id LIMIT 10""")
def related(spark, d):
    n = notes(spark, d)
    e = n.select(F.col("id").alias("src"), F.pmod(F.col("id") * 7 + 3, F.lit(100)).alias("dst"))
    return G.related(e, n, U.co_reads(activity(spark, d)), 13)


TIES = f"""w AS (SELECT DISTINCT theme, id, unnest({Q.significant('title')}) AS word FROM (SELECT theme, id, CASE WHEN {Q.secret('title')} THEN '{Q.MASK}' ELSE title END AS title FROM notes)), e AS (SELECT least(id, (id * 7 + 3) % 100) AS a, greatest(id, (id * 7 + 3) % 100) AS b FROM notes),
l AS (SELECT DISTINCT a, b, 2 AS l FROM e WHERE a <> b), s AS (SELECT x.id AS a, y.id AS b, least(count(*), 3) AS w FROM w x JOIN w y ON x.theme = y.theme AND x.word = y.word AND x.id < y.id GROUP BY 1, 2),
t AS (SELECT a, b, coalesce(w, 0) + coalesce(l, 0) AS score FROM s FULL JOIN l USING (a, b) WHERE coalesce(w, 0) + coalesce(l, 0) >= 3)"""


def _themed(spark, d):
    n = notes(spark, d)
    words = n.select("theme", "id", F.explode(X.significant_words(F.col("title"))).alias("word"))
    return words, n.select(F.col("id").alias("src"), F.pmod(F.col("id") * 7 + 3, F.lit(100)).alias("dst"))


@query("structure_ties", f"WITH {NOTES_SQL}, {TIES} SELECT a, b, score::BIGINT AS score FROM t")
def ties(spark, d):
    return G.ties(*_themed(spark, d)).select("a", "b", F.col("score").cast("bigint").alias("score"))


@query("structure_groups", f"""WITH RECURSIVE {NOTES_SQL}, {TIES}, b(x, y) AS (SELECT a, b FROM t UNION SELECT b, a FROM t), {COMPONENTS}, g AS (SELECT root, count(*) AS notes, count(DISTINCT subtheme) AS subthemes FROM lab JOIN notes ON id = node GROUP BY root)
SELECT root, notes, subthemes, sum(score)::BIGINT AS score FROM g JOIN lab USING (root) JOIN t ON t.a = lab.node WHERE notes >= 3 AND subthemes >= 2 GROUP BY ALL""")
def groups(spark, d):
    g = G.tied_groups(*_themed(spark, d), notes(spark, d))
    return g.select("root", "notes", "subthemes", F.col("score").cast("bigint").alias("score"))


@query("structure_mutual_links", f"WITH {NOTES_SQL}, e AS (SELECT id AS src, CASE WHEN id % 2 = 0 THEN id + 1 ELSE id - 1 END AS dst FROM notes WHERE id % 5 <> 0 UNION ALL SELECT id, id // 2 FROM notes) SELECT DISTINCT x.src AS hub, x.dst AS part FROM e x JOIN e y ON x.src = y.dst AND x.dst = y.src WHERE x.src <> x.dst")
def mutual(spark, d):
    n = notes(spark, d)
    pairs = n.where("id % 5 <> 0").select(F.col("id").alias("src"), F.when(F.col("id") % 2 == 0, F.col("id") + 1).otherwise(F.col("id") - 1).alias("dst"))
    return G.mutual(pairs.unionByName(n.select(F.col("id").alias("src"), F.floor(F.col("id") / 2).alias("dst"))))


@query("structure_collisions", "SELECT url, list_sort(list(page_id)) AS ids FROM (SELECT lower(regexp_extract(url, '//([^/]+)', 1)) AS url, page_id FROM pages) GROUP BY url HAVING count(*) > 1")
def collisions(spark, d):
    return G.ambiguous(read(spark, d, "pages").select(F.regexp_extract("url", "//([^/]+)", 1).alias("url"), F.col("page_id").alias("id")), "url")


@query("structure_duplicates", f"""WITH {NOTES_SQL}, p AS (SELECT id, theme, subtheme, tokens, [w for w in list_distinct(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}]+')) if length(w) >= 3 AND w NOT IN ({Q.STOPS})] AS words FROM notes ORDER BY tokens DESC, id LIMIT 300),
k AS (SELECT * FROM p WHERE len(words) >= 6), s AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.words, b.words)) AS shared, len(a.words) AS m, len(b.words) AS n, a.subtheme = b.subtheme AS sub, a.tokens + b.tokens AS tokens FROM k a JOIN k b ON a.id < b.id AND a.theme = b.theme)
SELECT a, b, shared, round(shared / least(m, n), 2) AS score, tokens FROM s WHERE shared >= 6 AND shared / least(m, n) >= 0.7""")
def duplicates(spark, d):
    n = notes(spark, d)
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("title"), F.lit(r"([\p{L}\p{N}]+)"), 1), lambda w: (F.length(w) >= 3) & ~X.is_stop(w)))
    return G.duplicates(n.select("id", "theme", "subtheme", "tokens", words.alias("words"), words.alias("title_words")))


@query("structure_audit_rules", f"""WITH {NOTES_SQL}, e AS (SELECT DISTINCT id AS src, (id * 7 + 3) % 100 AS dst FROM notes), dcl AS (SELECT id AS part, id % 10 AS hub FROM notes WHERE id % 4 = 1),
lst AS (SELECT id % 20 AS hub, id AS part FROM notes WHERE id % 9 = 2),
i AS (SELECT 'R1' AS rule FROM dcl JOIN e ON src = 0 AND dst = part WHERE hub <> 0 UNION ALL SELECT 'R2' FROM dcl WHERE NOT EXISTS (SELECT 1 FROM e WHERE src = part AND dst = hub)
 UNION ALL SELECT 'R3' FROM dcl WHERE NOT EXISTS (SELECT 1 FROM e WHERE src = hub AND dst = part) UNION ALL SELECT DISTINCT 'R3' FROM lst WHERE false
 UNION ALL SELECT 'R3' FROM (SELECT DISTINCT part FROM lst WHERE hub <> part AND part NOT IN (SELECT part FROM dcl))
 UNION ALL SELECT 'R5' FROM notes WHERE id <> 0 AND id NOT IN (SELECT dst FROM e WHERE src = 0) AND id NOT IN (SELECT part FROM dcl) AND id NOT IN (SELECT part FROM lst WHERE hub <> part)
 UNION ALL SELECT 'R7' FROM notes WHERE id <> 0 AND theme NOT IN ('src0', 'src1', 'src2', 'src3'))
SELECT rule, count(*) AS n, count(*) FILTER (rule IN ('R2', 'R3')) AS fixable FROM i GROUP BY rule""")
def audit_rules(spark, d):
    n = notes(spark, d).select(F.col("id").cast("string").alias("id"), "theme", F.lit(None).cast("string").alias("folder"), F.col("id").alias("k"))
    s = lambda c: c.cast("string")
    e = n.select(F.col("id").alias("src"), s(F.pmod(F.col("k") * 7 + 3, F.lit(100))).alias("dst"))
    declared = n.where("k % 4 = 1").select(F.col("id").alias("part"), s(F.col("k") % 10).alias("hub"))
    listed = n.where("k % 9 = 2").select(s(F.col("k") % 20).alias("hub"), F.col("id").alias("part"))
    issues = G.audit(n, e, declared, listed, "0", ["src0", "src1", "src2", "src3"])
    return G.by_rule(issues, F.col("rule").isin("R2", "R3"))


# ---- contexts: notes in folders by source and language; each links two notes by rule, one of them twice, and has a hub ----

CONTEXT = """n AS (SELECT doc_id AS k, 'n' || doc_id AS id, coalesce(source, 'none') AS s, coalesce(lang, 'none') AS l, doc_id * 7919 % 1000 AS m FROM documents), p AS (SELECT *, s || '/' || l || '/' || id AS p FROM n),
asked AS (SELECT DISTINCT 'memory://' || s || '/' || l AS url, s, l, NULL AS k FROM p UNION SELECT s || '/*', s, NULL, NULL FROM p UNION SELECT p, NULL, NULL, k FROM p WHERE k % 100 = 0),
named AS (SELECT url, p.id, m, p FROM asked JOIN p ON asked.k = p.k UNION ALL SELECT url, id, m, p FROM asked JOIN p ON asked.s = p.s AND asked.l = p.l UNION ALL SELECT url, id, m, p FROM asked JOIN p ON asked.s = p.s WHERE asked.l IS NULL),
top AS (SELECT url, id, row_number() OVER (PARTITION BY url ORDER BY m DESC, p, id) AS rank FROM named QUALIFY rank <= 10)"""


def _context(spark, d):
    c, lit = F.col, F.lit
    docs = read(spark, d, "documents")
    where = F.concat(F.coalesce("source", lit("none")), lit("/"), F.coalesce("lang", lit("none")))
    name = lambda x: F.concat(lit("n"), x.cast("bigint"))
    notes = docs.select(c("doc_id").alias("k"), where.alias("folder"), name(c("doc_id")).alias("id"), F.concat(where, lit("/"), name(c("doc_id"))).alias("permalink"), (c("doc_id") * 7919 % 1000).alias("mtime_ms"))
    notes = notes.withColumn("path", F.concat("permalink", lit(".md"))).withColumn("title", c("id"))
    link = lambda pos, kind, to: F.struct(lit(pos).alias("pos"), lit(kind).alias("type"), to.alias("target"))
    links = F.array(link(0, "see", name((c("k") * 7 + 3) % 5000)), link(1, "part_of", name(F.floor(c("k") / 10))), link(2, "like", name((c("k") * 3 + 1) % 777)), link(3, "see", F.upper(name((c("k") * 7 + 3) % 5000))))
    e = notes.select(c("id").alias("src"), F.explode(links).alias("e")).select("src", "e.*")
    e = e.join(notes.select(F.lower("id").alias("low"), c("id").alias("dst")), F.lower("target") == c("low"), "left").drop("low")
    asked = notes.select(F.concat(lit("memory://"), "folder").alias("url")).union(notes.select(F.concat(F.split_part("folder", lit("/"), lit(1)), lit("/*")))).union(notes.where("k % 100 = 0").select("permalink")).distinct()
    return C.context(asked, notes, e, 300, depth=2)


@query("graph_context_primaries", f"WITH {CONTEXT} SELECT url, rank::INT AS rank, id FROM top")
def context_primaries(spark, d):
    """The first page of what each folder, pattern and name designates."""
    return _context(spark, d).primaries


@query("graph_context_related", f"""WITH {CONTEXT}, e0 AS (SELECT id AS src, unnest([{{'pos': 0, 'type': 'see', 'target': 'n' || (k * 7 + 3) % 5000}}, {{'pos': 1, 'type': 'part_of', 'target': 'n' || k // 10}}, {{'pos': 2, 'type': 'like', 'target': 'n' || (k * 3 + 1) % 777}}], recursive := true) FROM n),
e AS (SELECT e0.*, n.id AS dst FROM e0 LEFT JOIN n ON n.id = e0.target), a AS (SELECT src AS x, dst AS y, 0 AS way, '' AS o, * FROM e UNION ALL SELECT dst, src, 1, src, * FROM e WHERE dst IS NOT NULL AND src <> dst),
adj AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY way, o, pos, type) AS r FROM a), ok AS (SELECT id FROM n WHERE m >= 300), h1 AS (SELECT url, id, [r] AS o, y, src, type, target, dst FROM top JOIN adj ON x = id),
k1 AS (SELECT *, row_number() OVER (PARTITION BY url, id ORDER BY o, kind) AS r FROM (SELECT url, id, min(o) AS o, 0 AS kind, NULL AS node, src, type, target, dst FROM h1 GROUP BY ALL UNION ALL
  SELECT url, id, min(o), 1, y, NULL, NULL, NULL, NULL FROM h1 WHERE y <> id AND (url, y) NOT IN (SELECT (url, id) FROM top) AND y IN (SELECT id FROM ok) GROUP BY url, id, y) QUALIFY r <= 10),
h2 AS (SELECT k1.url, k1.id, list_append(k1.o, adj.r) AS o, y, adj.src, adj.type, adj.target, adj.dst FROM k1 JOIN adj ON x = node WHERE kind = 1),
k2 AS (SELECT url, id, min(o) AS o, 0 AS kind, NULL AS node, src, type, target, dst FROM h2 ANTI JOIN k1 USING (url, id, src, type, target) GROUP BY ALL UNION ALL
  SELECT h2.url, h2.id, min(h2.o), 1, y, NULL, NULL, NULL, NULL FROM h2 ANTI JOIN k1 ON h2.url = k1.url AND h2.id = k1.id AND h2.y = k1.node WHERE y <> h2.id AND (h2.url, y) NOT IN (SELECT (url, id) FROM top) AND y IN (SELECT id FROM ok) GROUP BY h2.url, h2.id, y),
u AS (SELECT 1 AS hop, * EXCLUDE (r) FROM k1 UNION ALL SELECT 2, * FROM k2) SELECT url, id, row_number() OVER (PARTITION BY url, id ORDER BY hop, o, kind)::INT AS pos, CASE kind WHEN 0 THEN 'relation' ELSE 'entity' END AS kind, node, src, type, target, dst FROM u QUALIFY pos <= 10""")
def context_related(spark, d):
    """Two hops around each, in the order of their edges."""
    return _context(spark, d).related
