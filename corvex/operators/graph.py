"""Link graph: resolution, bounded traversal, components, related notes, hubs and the structure audit.

Loops run over tables with a checkpoint each round; what they collect is a count.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvex.functions import text as X
from corvex.operators import overlap as O


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which executors share; a session within one machine gets one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="corvex-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def _bare(c: Column) -> Column:
    return F.regexp_replace(c, r"\.md$", "")


def _key(c) -> Column:
    return F.lower(F.trim(c))


def _names(notes: DataFrame, project: str) -> DataFrame:
    """kind, key, rank, note: every name that a note goes by. A permalink counts with and without the project before it,
    and the path made a slug counts as a permalink after all declared ones."""
    have = set(notes.columns)
    permalink, path = _key(F.coalesce("permalink", F.lit(""))), _key(F.coalesce("path", F.lit("")))
    made = X.slugify("path")

    def both(c: Column) -> list[Column]:
        other = F.when(c.startswith(f"{project}/"), F.substring(c, len(project) + 2, 1 << 20)).otherwise(F.concat(F.lit(f"{project}/"), c))
        return [c, other]

    row = lambda kind, key, rank=0: F.struct(F.lit(kind).alias("kind"), key.alias("key"), F.lit(rank).alias("rank"))
    names = [row("permalink", k, r) for r, k in enumerate(both(permalink))]
    names += [row("permalink", F.when(made != "", k), 2) for k in both(made)]
    names += [row("path", path), row("path", _bare(path)), row("title", _key("title")), row("title", F.trim(X.fold("title")))]
    names += [row("slug", F.element_at(F.split(_bare(path), "/"), -1)), *([row("slug", F.col("slug"))] if "slug" in have else [])]
    return notes.select(F.explode(F.array(*names)).alias("n"), F.struct("permalink", "path", "id").alias("note")).select("n.*", "note").where("key IS NOT NULL AND key <> ''")


def _link_asks(target: Column) -> list[tuple[str, Column]]:
    k = _bare(_key(target))
    return [("title", k), ("permalink", k), ("slug", k), ("path", k), ("slug", X.slugify(target, False)), ("title", F.trim(X.fold(target)))]


def _read_asks(target: Column) -> list[tuple[str, Column]]:
    bare = F.regexp_replace(F.regexp_replace(F.trim(target), "(?i)^memory://", ""), "^/+|/+$", "")
    decoded = F.coalesce(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), bare)
    s = F.when(bare.rlike("(?i)%[0-9a-f]{2}"), decoded).otherwise(bare)
    k, k2 = _key(s), _bare(_key(s))
    file = F.when(k != k2, k)  # a name that ends in .md is a path before all else
    return [("path", file), ("permalink", k2), ("path", k), ("path", k2), ("title", k), ("title", F.trim(X.fold(s))), ("slug", k2), ("slug", X.slugify(k2, False)), ("permalink", X.slugify(k2))]


def _resolve(links: DataFrame, notes: DataFrame, asks: list[tuple[str, Column]], project: str) -> DataFrame:
    best = _names(notes, project).groupBy("kind", "key").agg(F.min(F.struct("rank", "note"))["note"]["id"].alias("to"))
    asked = F.array(*[F.struct(F.lit(kind).alias("kind"), key.alias("key")) for kind, key in asks])
    each = links.select("target").distinct().select("target", F.posexplode(asked).alias("tier", "a")).select("target", "tier", "a.*").where("key <> ''")
    found = each.join(best, ["kind", "key"]).groupBy("target").agg(F.min_by("to", "tier").alias("to"))
    return links.join(found, "target", "left")


def resolve_links(links: DataFrame, notes: DataFrame, project: str = "main") -> DataFrame:
    """`links` (target, …) plus to: the note by title, permalink, slug or file name, path, the target made a slug among
    slugs, or folded title, the first of these that any note has; of several notes the first by permalink and path."""
    return _resolve(links, notes, _link_asks(F.col("target")), project)


def ambiguous(notes: DataFrame, key: str) -> DataFrame:
    """Keys that several notes have, with their ids in order."""
    g = notes.groupBy(F.lower(key).alias(key)).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return g.where(F.size("ids") > 1)


def undirected(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def neighbours(edges: DataFrame, start: DataFrame, depth: int = 1, allowed: DataFrame | None = None) -> DataFrame:
    """Breadth first over edges in both directions: node, hop, for start's column node. Only nodes of
    `allowed` are shown and expanded."""
    if not 1 <= depth <= 10:
        raise ValueError("depth is 1 to 10")
    both = edges.select(F.col("src").alias("x"), F.col("dst").alias("y")).unionByName(edges.select(F.col("dst").alias("x"), F.col("src").alias("y")))
    seen = cut(start.select("node").distinct().withColumn("hop", F.lit(0)))
    frontier = seen
    for hop in range(1, depth + 1):
        nxt = both.join(frontier.select(F.col("node").alias("x")), "x", "left_semi").select(F.col("y").alias("node")).distinct()
        nxt = nxt.join(seen.select("node"), "node", "left_anti")
        if allowed is not None:
            nxt = nxt.join(allowed.select("node"), "node", "left_semi")
        frontier = cut(nxt.withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(frontier)
    return seen


def read_notes(asked: DataFrame, notes: DataFrame, project: str = "main") -> DataFrame:
    """`asked` (target) with to: notes by identifier, as a reader names them: a file name, memory:// and what follows,
    with escapes such as %20 or without; then permalink, path, title, folded title, slug and what is made a slug."""
    return _resolve(asked, notes, _read_asks(F.col("target")), project)


def capped_neighbours(edges: DataFrame, start: DataFrame, depth: int, most: int, allowed: DataFrame | None = None) -> DataFrame:
    """The first `most` nodes in breadth-first order: by hop, then in the order in which the nodes before
    them were reached and their edges' positions (columns src, dst, pos; outgoing before incoming). Only nodes of
    `allowed`, such as recent ones, are shown and expanded; those of `start` are expanded and not shown."""
    both = edges.select(F.col("src").alias("x"), F.col("dst").alias("y"), F.lit(0).alias("way"), "pos").unionByName(edges.select(F.col("dst").alias("x"), F.col("src").alias("y"), F.lit(1).alias("way"), "pos"))
    seen = cut(start.select("node", F.lit(0).alias("hop"), F.array(F.lit(0).cast("bigint")).alias("order")).dropDuplicates(["node"]))
    frontier = seen
    for hop in range(1, depth + 1):
        step = both.join(frontier.select(F.col("node").alias("x"), "order"), "x")
        order = F.concat("order", F.array(F.col("way").cast("bigint"), F.col("pos").cast("bigint")))
        nxt = step.select(F.col("y").alias("node"), order.alias("order")).groupBy("node").agg(F.min("order").alias("order"))
        nxt = nxt.join(seen.select("node"), "node", "left_anti")
        if allowed is not None:
            nxt = nxt.join(allowed.select("node"), "node", "left_semi")
        # no more than `most` can be shown, so no more need be expanded
        frontier = cut(nxt.withColumn("hop", F.lit(hop)).orderBy("order", "node").limit(most).select("node", "hop", "order"))
        seen = seen.unionByName(frontier)
    shown = seen.where("hop > 0").orderBy("hop", "order", "node").limit(most)
    return shown.select("node", "hop", F.row_number().over(W.orderBy("hop", "order", "node")).alias("rank"))


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each component, of nodes with an edge; labels spread by minimum and
    are shortened by jumping to their label's label."""
    e = edges.where("src <> dst")
    both = cut(e.select(F.col("src").alias("x"), F.col("dst").alias("y")).unionByName(e.select(F.col("dst").alias("x"), F.col("src").alias("y"))).distinct())
    label = cut(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("m")).select("node", F.least("node", "m").alias("root")))
    while True:
        near = both.join(label.select(F.col("node").alias("y"), "root"), "y").groupBy(F.col("x").alias("node")).agg(F.min("root").alias("r"))
        low = label.join(near, "node").select("node", "root", F.least("root", "r").alias("new"))
        jump = low.join(label.select(F.col("node").alias("new"), F.col("root").alias("far")), "new").select("node", "root", F.least("new", "far").alias("new"))
        jump = cut(jump)
        if not jump.where("new <> root").limit(1).count():
            return label
        label = jump.select("node", F.col("new").alias("root"))


def orphans(notes: DataFrame, *reached: DataFrame) -> DataFrame:
    """Notes in none of the sets."""
    out = notes
    for r in reached:
        out = out.join(r.select("id"), "id", "left_anti")
    return out


def related(edges: DataFrame, notes: DataFrame, usage: DataFrame, note, most: int = 10) -> DataFrame:
    """Neighbours of one note: 3 for a link in each direction, 1 for the same subtheme, up to 5 for days of
    common use (a, b, days)."""
    out = edges.where(F.col("src") == note).select(F.col("dst").alias("id"), F.lit(3).alias("w"), F.lit("link").alias("why"))
    inc = edges.where(F.col("dst") == note).select(F.col("src").alias("id"), F.lit(3).alias("w"), F.lit("backlink").alias("why"))
    own = F.broadcast(notes.where(F.col("id") == note).select("theme", "subtheme"))
    same = notes.join(own, ["theme", "subtheme"], "left_semi").select("id", F.lit(1).alias("w"), F.lit("subtheme").alias("why"))
    use = usage.where((F.col("a") == note) | (F.col("b") == note)).select(
        F.when(F.col("a") == note, F.col("b")).otherwise(F.col("a")).alias("id"), F.least("days", F.lit(5)).cast("int").alias("w"), F.lit("used together").alias("why"))
    evidence = out.unionByName(inc).unionByName(same).unionByName(use).where(F.col("id") != note)
    return evidence.groupBy("id").agg(F.sum("w").alias("score"), F.array_sort(F.collect_set("why")).alias("reasons")).orderBy(F.desc("score"), "id").limit(most)


def _themed(words: DataFrame) -> DataFrame:
    """theme, id, words: each note's as one string; kept, as blocks ask for it several times."""
    return cut(words.where("theme IS NOT NULL").groupBy("theme", "id").agg(O.joined(F.collect_set("word")).alias("words")))


def ties(words: DataFrame, edges: DataFrame, strong: int = 3, most: int = 3) -> DataFrame:
    """Pairs a < b of one theme with score 2 for a link and up to `most` for shared words, from `strong` = `most` on, if
    they share a word; `words` has theme, id, word. A theme's notes meet by blocks, and a pair comes out of the one task
    that counted its words, with its link."""
    if strong != most:
        raise ValueError("what is joined is told by `strong` words in common")
    kind = words.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, second, p, q, score in O.pairs_alike(pa.Table.from_batches(batches), most, 2):
            yield from pa.table({"x": first["id"].take(p), "y": second["id"].take(q), "score": pa.array(score, pa.int32())}).to_batches()

    met = O.alike(_themed(words), undirected(edges), ["theme"], run, f"x {kind}, y {kind}, score int")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "score")


def _of_size(label: DataFrame, score: DataFrame, notes: DataFrame, least: int) -> DataFrame:
    size = label.join(notes.select(F.col("id").alias("node"), "subtheme"), "node").groupBy("root").agg(F.count("*").alias("notes"), F.countDistinct("subtheme").alias("subthemes"))
    return size.join(score, "root").where((F.col("notes") >= least) & (F.col("subthemes") >= 2))


def groups(tied: DataFrame, notes: DataFrame, least: int = 3) -> DataFrame:
    """Components of strong ties with `least` notes in two or more subthemes: root, notes, subthemes, score."""
    label = components(tied.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    score = tied.join(label.withColumnRenamed("node", "a"), "a").groupBy("root").agg(F.sum("score").alias("score"))
    return _of_size(label, score, notes, least)


def tied_groups(words: DataFrame, edges: DataFrame, notes: DataFrame, least: int = 3, most: int = 3) -> DataFrame:
    """What `groups` says of `ties`, without the pairs: a pair of blocks hands on, for each note with a tie in it, one
    that it hangs together with and the scores of its pairs, each counted at one end. A block's notes are joined up
    once more before all are."""
    kind = words.schema["id"].dataType.simpleString()
    rows = _themed(words)
    schema = f"theme {words.schema['theme'].dataType.simpleString()}, _at int, node {kind}, near {kind}, score bigint"

    def tell(theme, at, ids, who, near, score) -> Iterator[pa.RecordBatch]:
        n = len(who)
        yield from pa.table({"theme": pa.repeat(theme, n), "_at": pa.array(at, pa.int32()), "node": ids.take(who), "near": ids.take(near), "score": pa.array(score, pa.int64())}).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        root = None
        for first, second, p, q, score in O.pairs_alike(t, most, 2):
            one, n = second is first, first.num_rows
            if root is None:
                ids = pa.chunked_array(first["id"].chunks + ([] if one else second["id"].chunks))
                root, total, tied = np.arange(len(ids)), np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
            q = q if one else q + n
            root = O.unite(root, p, q)
            total[:n] += np.bincount(p, score, n).astype(np.int64)
            tied[p] = tied[q] = True
        if root is not None and tied.any():
            who = np.flatnonzero(tied)
            yield from tell(t["theme"][0], np.where(who < n, t["_i"][0].as_py(), t["_j"][0].as_py()), ids, who, root[who], total[who])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        coded = pa.chunked_array(t["node"].chunks + t["near"].chunks).combine_chunks().dictionary_encode()
        n, ids = t.num_rows, coded.dictionary
        a, b = np.split(coded.indices.to_numpy(), [n])
        root = O.unite(np.arange(len(ids)), a, b)
        total = np.zeros(len(ids), np.int64)
        np.add.at(total, a, t["score"].to_numpy())
        yield from tell(t["theme"][0], np.full(len(ids), t["_at"][0].as_py()), ids, np.arange(len(ids)), root, total)

    parts = O.alike(rows, undirected(edges), ["theme"], run, schema)
    joined = cut(O.grouped(parts, ["theme", "_at"]).applyInArrow(again, schema).select("node", "near", "score"))
    label = components(joined.select(F.col("node").alias("src"), F.col("near").alias("dst")))
    score = joined.join(label, "node").groupBy("root").agg(F.sum("score").alias("score"))
    return _of_size(label, score, notes, least)


def mutual(edges: DataFrame) -> DataFrame:
    """Pairs hub, part that link to each other."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.where("src <> dst").join(back, ["src", "dst"], "left_semi").select(F.col("src").alias("hub"), F.col("dst").alias("part")).distinct()


def _closed(group: DataFrame, incoming: DataFrame) -> DataFrame:
    """Of hubs' groups (hub, part) what is left when parts that anything outside the hub and its group links to go, again
    and again, and then groups of one."""
    while True:
        inside = group.select("hub", F.col("part").alias("src"))
        outside = group.join(incoming, "part").where("src <> hub").join(inside, ["hub", "src"], "left_anti")
        gone = cut(outside.select("hub", "part").distinct())
        if gone.isEmpty():
            break
        group = cut(group.join(gone, ["hub", "part"], "left_anti"))
    two = group.groupBy("hub").count().where("count >= 2").select("hub")
    return cut(group.join(two, "hub", "left_semi"))


def hubs(edges: DataFrame, notes: DataFrame, declared: DataFrame, index: str | None = None) -> DataFrame:
    """part, hub: declared ones (part, hub), then structural ones: two or more notes of one folder that link to a hub and
    back and to which nothing else links but the index and each other. Hubs claim in the order of their ids. In a round
    every hub claims that shares no part with a smaller one still waiting, which is what the order asks for; groups
    closed before any claim only shrink, so few hubs wait."""
    folder = notes.select("id", "folder")
    pairs = mutual(edges).join(folder.select(F.col("id").alias("hub"), F.col("folder").alias("f")), "hub").join(folder.select(F.col("id").alias("part"), F.col("folder").alias("g")), "part").where("coalesce(f, '') = coalesce(g, '')")
    if index is not None:
        pairs = pairs.where((F.col("hub") != index) & (F.col("part") != index))
    claimed = cut(declared.select("part", "hub"))
    pairs = pairs.select("hub", "part").join(claimed.select("part", F.col("hub").alias("own")), "part", "left").where("own IS NULL OR own = hub").select("hub", "part")
    wide = pairs.groupBy("hub").count().where("count >= 2").select("hub")
    group = cut(pairs.join(wide, "hub", "left_semi"))
    incoming = edges.where("src <> dst").select("src", F.col("dst").alias("part")).join(group.select("part").distinct(), "part", "left_semi").distinct()
    incoming = cut(incoming if index is None else incoming.where(F.col("src") != index))
    while True:
        group = _closed(group, incoming)
        if group.isEmpty():
            return claimed
        first = group.groupBy("part").agg(F.min("hub").alias("first"))
        waits = group.join(first, "part").where("hub <> first").select("hub").distinct()
        won = cut(group.join(waits, "hub", "left_anti"))
        claimed = cut(claimed.unionByName(won.select("part", "hub").join(claimed.select("part"), "part", "left_anti")))
        group = cut(group.join(won.select("hub").distinct(), "hub", "left_anti").join(won.select("part"), "part", "left_anti"))


def audit(notes: DataFrame, edges: DataFrame, declared: DataFrame, listed: DataFrame, index: str, valid_themes: list[str], archive: str = "archive") -> DataFrame:
    """rule, note, detail. `declared`: part, hub of front matter; `listed`: hub, part of "Parts" lists.
    R1 the index lists a declared part; R2 a part without a link to its hub; R3 a hub that lacks one of its
    parts, and a note that lists claim without its saying so; R5 a note that nothing reaches; R7 a theme
    outside the valid ones."""
    e = edges.select("src", "dst").distinct()
    row = lambda df, rule, note, detail: df.select(F.lit(rule).alias("rule"), F.col(note).alias("note"), detail.alias("detail"))
    up = e.select(F.col("src").alias("part"), F.col("dst").alias("hub"))
    down = e.select(F.col("src").alias("hub"), F.col("dst").alias("part"))
    r1 = row(declared.where(F.col("hub") != index).join(down.where(F.col("hub") == index).select("part"), "part", "left_semi"), "R1", "part", F.concat(F.lit("listed though part of "), "hub"))
    r2 = row(declared.join(up, ["part", "hub"], "left_anti"), "R2", "part", F.concat(F.lit("no link to "), "hub"))
    r3 = row(declared.join(down, ["part", "hub"], "left_anti"), "R3", "hub", F.concat(F.lit("does not list "), "part"))
    claims = listed.where("hub <> part").join(declared.select("part"), "part", "left_anti").groupBy("part").agg(F.countDistinct("hub").alias("n"))
    r3b = row(claims, "R3", "part", F.concat(F.lit("claimed by "), F.col("n").cast("string")))
    reached = [e.where(F.col("src") == index).select(F.col("dst").alias("id")), declared.select(F.col("part").alias("id")), listed.where("hub <> part").select(F.col("part").alias("id"))]
    live = notes.where((F.col("id") != index) & ~F.coalesce(F.col("folder"), F.lit("")).rlike(f"(^|/){archive}(/|$)"))
    r5 = row(orphans(live, *reached), "R5", "id", F.lit("nothing leads here"))
    r7 = row(notes.where((F.col("id") != index) & F.col("theme").isNotNull() & ~F.lower("theme").isin([t.lower() for t in valid_themes])), "R7", "id", F.concat(F.lit("theme "), "theme"))
    return r1.unionByName(r2).unionByName(r3).unionByName(r3b).unionByName(r5).unionByName(r7)


def by_rule(issues: DataFrame, fixable: Column) -> DataFrame:
    return issues.groupBy("rule").agg(F.count("*").alias("n"), F.count_if(fixable).alias("fixable"))


def duplicates(notes: DataFrame, most: int = 300, shared: int = 6, coverage: float = 0.7, title_words: int = 2) -> DataFrame:
    """Near-duplicate pairs a, b, shared, score among the `most` largest notes: columns id, theme, subtheme,
    tokens, words and title_words (arrays). Only pairs that share a word meet."""
    pool = notes.orderBy(F.desc("tokens"), "id").limit(most).withColumn("n", F.size("words")).where(F.col("n") >= shared)
    w = pool.select("id", F.explode("words").alias("word"))
    met = w.select("word", F.col("id").alias("a")).join(w.select("word", F.col("id").alias("b")), "word").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= shared)
    side = lambda s: pool.select(F.col("id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("theme", "subtheme", "title_words", "n", "tokens")])
    both = met.join(side("a"), "a").join(side("b"), "b")
    cover = F.col("shared") / F.least("n_a", "n_b")
    same_sub = F.coalesce(F.col("subtheme_a") == F.col("subtheme_b"), F.lit(False))
    near = F.size(F.array_intersect("title_words_a", "title_words_b")) >= title_words
    good = (cover >= coverage) & F.coalesce(F.col("theme_a") == F.col("theme_b"), F.lit(True)) & (same_sub | near)
    return both.where(good).select("a", "b", "shared", F.round(cover, 2).alias("score"), (F.col("tokens_a") + F.col("tokens_b")).alias("tokens"))


def same_family(a: Column, b: Column) -> Column:
    """Whether one id is the other with a hyphen and more."""
    return b.startswith(F.concat(a, F.lit("-"))) | a.startswith(F.concat(b, F.lit("-")))
