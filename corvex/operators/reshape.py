"""Splitting notes by whole plans: plans in, new notes out, and a proof that no line is lost.

A plan names the parts of a note in order, and for each part the sections and single lines that move to it. Every
step is a join by note: headings to their sections, wanted headings and lines to what the note has, lines to the part
that takes them. A plan with an error changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import advice as A
from . import graph as G

PLAN = "note string, pos int, slug string, description string, hook string, sections array<string>, lines array<string>"
PARTS = "## Parts"
MOST_PARTS = 12
FENCE = r"^\s*(`{3,}|~{3,})"
HEADING = r"^(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$"


def note_lines(notes: DataFrame) -> DataFrame:
    """note, n, line, level, heading of each line of a body (id, body); lines in fences are no headings."""
    from pyspark.sql import Window as W

    each = notes.select(F.col("id").alias("note"), F.posexplode(F.split(F.coalesce("body", F.lit("")), r"\r?\n")).alias("n", "line"))
    fence = F.col("line").rlike(FENCE)
    inside = fence | (F.sum(fence.cast("int")).over(W.partitionBy("note").orderBy("n")) % 2 == 1)
    level = F.when(~inside, F.nullif(F.length(F.regexp_extract("line", HEADING, 1)), F.lit(0)))
    return each.select("note", "n", "line", level.alias("level"), F.when(level.isNotNull(), F.trim(F.regexp_extract("line", HEADING, 2))).alias("heading"))


def section_spans(lines: DataFrame) -> DataFrame:
    """note, title, level, start, end: a section ends where the next of its level or a higher one begins."""
    total = lines.groupBy("note").agg((F.max("n") + 1).alias("total"), F.array_sort(F.collect_list(F.when(F.col("level").isNotNull(), F.struct("n", "level", "heading")))).alias("heads"))
    each = total.select("note", "total", "heads", F.explode("heads").alias("h"))
    after = F.filter("heads", lambda x: (x["n"] > F.col("h.n")) & (x["level"] <= F.col("h.level")))
    return each.select("note", F.col("h.heading").alias("title"), F.col("h.level").alias("level"), F.col("h.n").alias("start"), F.coalesce(F.get(after, F.lit(0))["n"], "total").alias("end"))


def named_parts(plans: DataFrame, existing: DataFrame) -> DataFrame:
    """Plans with `part`, the slug under the note's own name that neither an existing note nor an earlier part has."""
    wanted = plans.select(F.col("note").alias("plan"), "pos", A.under_hub(F.col("slug"), F.col("note")).alias("base"))
    free = A.free_slugs(wanted, existing.select(F.col("id").alias("slug"))).select(F.col("plan").alias("note"), "pos", F.col("slug").alias("part"))
    return plans.join(free, ["note", "pos"])


class Split:
    """errors: note, part, error. moves: note, n, part for each line that moves, of plans without errors. files: note,
    id, role (hub or part), text. lost: note, line of lines that would be lost; always empty, and checked."""

    def __init__(self, notes: DataFrame, plans: DataFrame):
        c, lit = F.col, F.lit
        plans = G.cut(named_parts(plans, notes))
        lines = G.cut(note_lines(notes.join(plans.select(c("note").alias("id")).distinct(), "id", "left_semi")))
        spans = G.cut(section_spans(lines))
        err = lambda df, text: df.select("note", "part", text.alias("error"))
        blank = lambda x: F.trim(F.coalesce(x, lit(""))) == ""
        errors = [
            err(plans.join(notes.select(c("id").alias("note")), "note", "left_anti"), lit("no such note")),
            err(plans.where(blank("slug")), lit("a slug is required")), err(plans.where(blank("description")), lit("a description is required")),
            err(plans.where(F.coalesce(F.size("sections"), lit(0)) + F.coalesce(F.size("lines"), lit(0)) <= 0), lit("no sections or lines")),
            err(plans.groupBy("note").agg(F.count("*").alias("k"), F.min("part").alias("part")).where(c("k") > MOST_PARTS), lit(f"more than {MOST_PARTS} parts")),
        ]
        wanted = plans.select("note", c("part").alias("slug"), F.explode("sections").alias("heading"))
        checked = G.cut(A.check_moves(spans, wanted))
        errors.append(err(checked.where("found <> 1").withColumnRenamed("slug", "part"), F.concat(lit("heading "), "heading", lit(" found "), c("found").cast("string"), lit(" times"))))
        errors.append(err(checked.where("found = 1 AND overlaps > 0").withColumnRenamed("slug", "part"), F.concat(lit("heading "), "heading", lit(" overlaps another part's"))))
        twice = wanted.groupBy("note", "slug", "heading").count().where("count > 1")
        errors.append(err(twice.withColumnRenamed("slug", "part"), F.concat(lit("heading "), "heading", lit(" is named twice"))))
        taken = checked.where("found = 1").select("note", c("slug").alias("part"), F.explode(F.sequence("start", c("end") - 1)).alias("n")).distinct()
        text = lambda x: F.regexp_replace(x, r"\s+$", "")
        single = plans.select("note", "part", F.explode("lines").alias("line")).select("note", "part", text("line").alias("t"))
        free = lines.select("note", "n", text("line").alias("t")).join(taken.select("note", "n"), ["note", "n"], "left_anti")
        asked = single.groupBy("note", "t").agg(F.count("*").alias("asks"), F.min("part").alias("part"))
        found = G.cut(asked.join(free, ["note", "t"], "left").groupBy("note", "t", "part", "asks").agg(F.count("n").alias("k"), F.min("n").alias("n")))
        errors.append(err(found.where("k <> 1 OR asks <> 1"), F.concat(lit("line "), F.substring("t", 1, 60), lit(" found "), c("k").cast("string"), lit(" times outside moved sections"))))
        moves = G.cut(taken.unionByName(found.where("k = 1 AND asks = 1").select("note", "part", "n")))
        full = lines.where(F.trim("line") != "").select("note", "n")
        held = moves.join(full, ["note", "n"], "left_semi").select("note", "part").distinct()
        errors.append(err(plans.join(held, ["note", "part"], "left_anti").where(F.coalesce(F.size("sections"), lit(0)) + F.coalesce(F.size("lines"), lit(0)) > 0), lit("would be empty")))
        out = errors[0]
        for e in errors[1:]:
            out = out.unionByName(e)
        self.errors = G.cut(out.distinct())
        good = plans.join(self.errors.select("note"), "note", "left_anti")
        self.moves = moves.join(good.select("note").distinct(), "note", "left_semi")
        self.lines = lines.join(good.select("note").distinct(), "note", "left_semi")
        self.files = self._files(good)
        each = lambda df, k: df.select("note", F.explode(F.split(k, "\n")).alias("line")).select("note", text("line").alias("line")).where(F.trim("line") != "")
        self.lost = each(self.lines.select("note", c("line").alias("l")), "l").exceptAll(each(self.files, "text"))

    def _files(self, good: DataFrame) -> DataFrame:
        c, lit = F.col, F.lit
        joined = lambda *xs: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*xs))), lambda x: x["line"]), "\n")
        edge = lambda x: F.regexp_replace(F.regexp_replace(x, r"^(\s*\n)+", ""), r"\s+$", "")
        parts = self.moves.join(self.lines.select("note", "n", "line"), ["note", "n"]).groupBy("note", "part").agg(edge(joined("n", "line")).alias("t"))
        told = good.select("note", "part", "pos", F.coalesce(F.nullif(F.trim("hook"), lit("")), F.trim("description")).alias("hook"), F.trim("description").alias("about"))
        part = parts.join(told, ["note", "part"]).select("note", c("part").alias("id"), lit("part").alias("role"), F.concat(lit("---\ndescription: "), F.to_json(F.struct("about")).substr(lit(10), F.length(F.to_json(F.struct("about"))) - 10), lit("\npart_of: "), "note", lit("\n---\n\n"), "t", lit("\n")).alias("text"))
        kept = self.lines.join(self.moves.select("note", "n"), ["note", "n"], "left_anti")
        # the hub's list of parts: behind the last line of one that is there, else at the end
        head = kept.where((F.trim("line") == PARTS) & c("level").isNotNull()).groupBy("note").agg(F.min("n").alias("p"))
        stop = kept.join(head, "note").where("n > p AND level IS NOT NULL").groupBy("note").agg(F.min("n").alias("stop"))
        last = kept.join(head, "note", "left").join(stop, "note", "left").where((F.trim("line") != "") & (c("p").isNull() | (c("n") >= c("p")) & (c("stop").isNull() | (c("n") < c("stop")))))
        at = good.select("note").distinct().join(last.groupBy("note").agg(F.max("n").alias("at"), F.max("p").alias("p")), "note", "left")
        entry = F.concat(lit("- [["), "part", lit("]] — "), "hook")
        entries = told.join(at, "note").select("note", F.coalesce("at", lit(-1)).alias("n"), (c("pos") + 10).alias("k"), entry.alias("line"))
        fresh = at.where("p IS NULL").select("note", F.coalesce("at", lit(-1)).alias("n"), F.explode(F.array(F.struct(lit(1).alias("k"), lit("").alias("line")), F.struct(lit(2).alias("k"), lit(PARTS).alias("line")))).alias("x")).select("note", "n", "x.*")
        ends = kept.join(at, "note").select("note", "n", lit(0).alias("k"), F.when(c("p").isNull() & (c("n") == c("at")), F.regexp_replace("line", r"\s+$", "")).otherwise(c("line")).alias("line"))
        whole = ends.unionByName(entries).unionByName(fresh)
        hub = whole.groupBy("note").agg(edge(joined("n", "k", "line")).alias("t"))
        return hub.select("note", c("note").alias("id"), lit("hub").alias("role"), F.concat("t", lit("\n")).alias("text")).unionByName(part)


def split(notes: DataFrame, plans: DataFrame) -> Split:
    """The result of all plans; raises ValueError if any line would be lost."""
    s = Split(notes, plans)
    gone = s.lost.first()
    if gone is not None:
        raise ValueError(f"a line of {gone['note']} would be lost: {gone['line'][:80]!r}")
    return s
