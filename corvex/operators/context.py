"""The surroundings of notes named by memory addresses: primaries by page, and what is related to each within a few hops.

All addresses are answered at once. An address meets notes through keys (names, and every folder above a name), never
pair by pair; the hops of all primaries run together, and a node brings at most twice `most` of its edges, in order, as
no more can be shown: of any 2 x `most` at most `most` were shown before.

Null addresses and those that name nothing have no primaries. Repeated addresses count once; repeated relations of one
note (same type and target, whatever the case) are one, in the place of the first. Equal times go by permalink.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import graph as G

PAGE, RELATED, DEPTHS = 10, 10, range(0, 11)


def _bare(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(url), "(?i)^memory://", ""), "^/+|/+$", "")


def _variants(project: str) -> Column:
    """A note's permalink with and without the project before it, and its path without .md."""
    p = F.lower(F.coalesce("permalink", F.lit("")))
    other = F.when(p.startswith(f"{project}/"), F.substring(p, len(project) + 2, 1 << 20)).otherwise(F.concat(F.lit(f"{project}/"), p))
    path = F.regexp_replace(F.lower(F.coalesce("path", F.lit(""))), r"\.md$", "")
    return F.array_distinct(F.filter(F.array(p, F.when(p != "", other), path), lambda x: x != ""))


def _above(names: Column) -> Column:
    """All folders above names, and the empty one."""
    up = lambda v: F.transform(F.sequence(F.lit(0), F.size(F.split(v, "/")) - 1), lambda k: F.array_join(F.slice(F.split(v, "/"), F.lit(1), k), "/"))
    return F.array_distinct(F.flatten(F.transform(names, up)))


def designated(asked: DataFrame, notes: DataFrame, project: str = "main") -> DataFrame:
    """url, id of the notes (id, permalink, path, title) that each address (url) names: all that match if it has a *, which
    stands for any characters, else the note of that name, else all below the folder of that name."""
    c, lit = F.col, F.lit
    urls = asked.select("url").distinct().withColumn("target", _bare(c("url"))).where("target <> ''")
    one = G.read_notes(urls.where(~c("target").contains("*")), notes, project).select("url", "target", c("to").alias("id"))
    one = G.cut(one)
    names = notes.select("id", _variants(project).alias("vs"))
    below = names.select("id", "vs", F.explode(_above(c("vs"))).alias("up"))
    folder = one.where("id IS NULL").select("url", F.lower("target").alias("up")).join(below.select("id", "up"), "up").select("url", "id")
    low = F.lower("target")
    exact = F.replace(low, lit("\\E"), lit("\\E\\\\E\\Q"))
    pattern = F.concat(lit("(?s)^\\Q"), F.replace(exact, lit("*"), lit("\\E.*\\Q")), lit("\\E$"))
    globs = urls.where(c("target").contains("*")).select("url", pattern.alias("p"), F.regexp_extract(low, r"^([^*]*)/[^*/]*\*", 1).alias("up"))
    match = globs.join(below, "up").where(F.exists("vs", lambda v: F.regexp_like(v, c("p")))).select("url", "id")
    return one.where("id IS NOT NULL").select("url", "id").unionByName(folder).unionByName(match).distinct()


class Context:
    """primaries: url, rank, id of one page. related: url, id, pos, kind (relation or entity), node, src, type, target,
    dst, in the order in which they are met. counts: url, total_primaries, primary_count, related_count, total_relations,
    total_observations, total_results."""

    def __init__(self, asked: DataFrame, notes: DataFrame, edges: DataFrame, since_ms: int, depth: int = 1, most: int = RELATED, page: int = 1, size: int = PAGE, project: str = "main", observations: DataFrame | None = None):
        if depth not in DEPTHS or not 0 <= most <= 100 or page < 1 or not 1 <= size <= 50:
            raise ValueError("depth is 0 to 10, most 0 to 100, page 1 or more, size 1 to 50")
        c = F.col
        self.most = most
        named = G.cut(designated(asked, notes, project))
        ranked = named.join(notes.select("id", "permalink", "mtime_ms"), "id")
        ranked = ranked.withColumn("rank", F.row_number().over(W.partitionBy("url").orderBy(F.desc("mtime_ms"), "permalink", "id"))).where(c("rank") <= page * size)
        self.primaries = G.cut(ranked.where(c("rank") > (page - 1) * size).select("url", "rank", "id"))
        self.related = self._related(notes, edges, since_ms, depth)
        r = self.related.groupBy("url").agg(F.count("*").alias("related_count"), F.count_if(c("kind") == "relation").alias("total_relations"))
        seen = self.primaries.select("url", "id")
        o = (seen.join(observations.select("id"), "id") if observations is not None else seen.limit(0)).groupBy("url").agg(F.count("*").alias("total_observations"))
        all_ = asked.select("url").distinct().join(named.groupBy("url").agg(F.count("*").alias("total_primaries")), "url", "left")
        counts = all_.join(seen.groupBy("url").agg(F.count("*").alias("primary_count")), "url", "left").join(r, "url", "left").join(o, "url", "left").na.fill(0)
        self.counts = counts.withColumn("total_results", c("primary_count") + c("related_count"))

    def _edges(self, edges: DataFrame) -> DataFrame:
        """x, y, k, rel: each node's edges in order, outgoing by place, then incoming by source and place."""
        c, lit = F.col, F.lit
        once = edges.groupBy("src", "type", F.lower("target").alias("t")).agg(F.min(F.struct("pos", "target", "dst")).alias("e")).select("src", "type", "t", "e.*")
        rel = F.struct("src", "type", "target", "dst", "t").alias("rel")
        out = once.select(c("src").alias("x"), c("dst").alias("y"), lit(0).alias("way"), lit("").alias("from"), "pos", "t", rel)
        into = once.where("dst IS NOT NULL AND src <> dst").select(c("dst").alias("x"), c("src").alias("y"), lit(1).alias("way"), c("src").alias("from"), "pos", "t", rel)
        k = F.row_number().over(W.partitionBy("x").orderBy("way", "from", "pos", "rel.type", "t"))
        return out.unionByName(into).withColumn("k", k).where(c("k") <= 2 * self.most).select("x", "y", "k", "rel")

    def _related(self, notes: DataFrame, edges: DataFrame, since_ms: int, depth: int) -> DataFrame:
        c, lit = F.col, F.lit
        seed = ["url", "id"]
        near = G.cut(self._edges(edges))
        recent = notes.where(c("mtime_ms") >= since_ms).select(c("id").alias("y"))
        shown = self.primaries.select("url", c("id").alias("y"))
        front = self.primaries.select(*seed, c("id").alias("x"), F.array().cast("array<int>").alias("at"))
        kept = front.select(*seed, lit(0).alias("hop"), "at", lit(0).alias("what"), c("x").alias("y"), lit(None).cast(near.schema["rel"].dataType).alias("rel")).limit(0)
        place = W.partitionBy(*seed).orderBy("at", "what")
        for hop in range(1, depth + 1):
            step = G.cut(front.join(near, "x").select(*seed, F.concat("at", F.array("k")).alias("at"), "y", "rel"))
            rels = step.groupBy(*seed, "rel.src", "rel.type", "rel.t").agg(F.min("at").alias("at"), F.min_by("rel", "at").alias("rel"))
            before = kept.where("what = 0").select(*seed, "rel.src", "rel.type", "rel.t")
            rels = rels.join(before, [*seed, "src", "type", "t"], "left_anti").select(*seed, "at", lit(0).alias("what"), lit(None).cast("string").alias("y"), "rel")
            nodes = step.where("y IS NOT NULL AND y <> id").groupBy(*seed, "y").agg(F.min("at").alias("at")).join(shown, ["url", "y"], "left_anti")
            nodes = nodes.join(kept.where("what = 1").select(*seed, "y"), [*seed, "y"], "left_anti").join(recent, "y", "left_semi")
            nodes = nodes.select(*seed, "at", lit(1).alias("what"), "y", lit(None).cast(near.schema["rel"].dataType).alias("rel"))
            new = rels.unionByName(nodes).withColumn("r", F.row_number().over(place)).where(c("r") <= self.most).drop("r")
            new = G.cut(new.withColumn("hop", lit(hop)))
            kept = kept.unionByName(new)
            full = kept.groupBy(*seed).count().where(c("count") >= self.most)
            front = new.where("what = 1").join(full, seed, "left_anti").select(*seed, c("y").alias("x"), "at")
        pos = F.row_number().over(W.partitionBy(*seed).orderBy("hop", "at", "what"))
        last = kept.withColumn("pos", pos).where(c("pos") <= self.most)
        return last.select(*seed, "pos", F.when(c("what") == 0, "relation").otherwise("entity").alias("kind"), c("y").alias("node"), "rel.src", "rel.type", "rel.target", "rel.dst")


def context(asked: DataFrame, notes: DataFrame, edges: DataFrame, since_ms: int, **options) -> Context:
    """What addresses (url) name among notes (id, permalink, path, title, mtime_ms) and what is related to it by edges
    (src, type, target, dst, pos; dst is null where the target names no note). Of notes met on the way only those
    changed since `since_ms` are shown and gone on from; notes of the same page are neither."""
    return Context(asked, notes, edges, since_ms, **options)
