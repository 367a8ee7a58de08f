"""Structure of a knowledge base read from its texts: links line by line, sections, the eight audit rules, and fixes as
line edits that are composed note by note and applied in one pass.

Notes have id, text, folder, label, description. A line meets its section by a running last heading within its note, a
sweep and no range join. Edits are rows (id, at, remove, insert): `insert` stands before line `at` and `remove` lines
from there go. Of edits that touch each other the first is kept and the others wait for the next round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import graph as G
from . import memory as M

# How links, list entries, headings, fences and front matter are written.
LINK = r"\[\[([^\]|#\n]{1,150})(?:[#|][^\]\n]*)?\]\]"
ENTRY = r"^\s*-\s*\[\[([^\]|#]+)"
HEADING = r"^(#{1,6})[ \t]+(.*?)[ \t]*$"
FENCE = r"^\s*(`{3,}|~{3,})"
FRONT = r"^---\r?\n(?s:.*?)\r?\n---\r?(?:\n|$)"
PARTS = "## Parts"
UP_LINE = r"(?i)^\s*Up:\s*\[\["
ARCHIVE = "archive"
THEMES = ("family", "work", "home", "tech", "archive")
MOST_DUPLICATES = 20


def front_value(head: Column, *keys: str) -> Column:
    """The value of the first line of front matter that has one of the keys, without quotes; null if empty."""
    raw = F.regexp_extract(head, rf"(?im)^[ \t]*(?:{'|'.join(keys)})[ \t]*:[ \t]*(.+?)[ \t]*$", 1)
    return F.nullif(F.trim(F.regexp_replace(F.trim(raw), "^[\"']|[\"']$", "")), F.lit(""))


def parsed(notes: DataFrame, archive: str = ARCHIVE) -> DataFrame:
    """Notes with head and body, part_of (front matter's part_of or parent), marked (the hub that front matter or a
    header line declares), has_part_of, theme, subtheme, under_archive (by place) and archived (by place or status)."""
    head = F.regexp_extract("text", FRONT, 0)
    n = notes.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("head", head).withColumn("body", F.substring("text", F.length("head") + 1, F.length("text")))
    raw = front_value(F.col("head"), "part_of", "parent")
    named = F.when(raw.startswith("[["), F.trim(F.regexp_extract(raw, r"^\[\[([^\]|#]+)", 1))).otherwise(raw)
    folder = F.coalesce("folder", F.lit(""))
    place = (F.col("id") == archive) | F.col("id").startswith(f"{archive}/") | (folder == archive) | folder.startswith(f"{archive}/")
    by_segment = F.exists(F.split(F.lower(folder), "/"), lambda s: s == ARCHIVE)
    status = F.col("head").rlike("(?im)^[ \\t]*status[ \\t]*:[ \\t]*[\"']?archived[\"']?[ \\t]*$")
    return n.select(
        "*", named.alias("part_of"), F.coalesce(named, M.declared_hub(F.lit(None).cast("string"), F.col("body"))).alias("marked"),
        F.col("head").rlike(r"(?im)^\s*part_of\s*:").alias("has_part_of"), front_value(F.col("head"), "theme").alias("theme"),
        front_value(F.col("head"), "subtheme", "sous_theme").alias("subtheme"), place.alias("under_archive"), (place | by_segment | status).alias("archived"),
    )


def lines(notes: DataFrame) -> DataFrame:
    """id, n, line, in_head, links, entry (target of a list entry), level, heading, section and sub: the heading of the
    second level that a line stands under and the one of the third within it, with their lines section_n, sub_n. `notes`
    as `parsed` gives them; n counts from the text's first line. Lines in fences and stretches of code have no links."""
    n_head = F.when(F.col("head") == "", 0).otherwise(F.size(F.split("head", "\n")) - F.when(F.col("head").endswith("\n"), 1).otherwise(0))
    each = notes.select("id", n_head.alias("n_head"), F.posexplode(F.split("text", r"\r?\n")).alias("n", "line")).withColumn("in_head", F.col("n") < F.col("n_head"))
    by = W.partitionBy("id").orderBy("n")
    fence = ~F.col("in_head") & F.col("line").rlike(FENCE)
    each = each.withColumn("code", fence | (F.sum(fence.cast("int")).over(by) % 2 == 1))
    found = F.regexp_extract_all(F.regexp_replace("line", "`[^`\n]*`", " "), F.lit(LINK), 1)
    level = F.when(~F.col("in_head"), F.nullif(F.length(F.regexp_extract("line", HEADING, 1)), F.lit(0)))
    each = each.select(
        "id", "n", "line", "in_head", "n_head",
        F.when(~F.col("in_head") & ~F.col("code"), F.array_distinct(F.transform(found, lambda t: F.trim(t)))).otherwise(F.array().cast("array<string>")).alias("links"),
        F.when(~F.col("in_head"), F.nullif(F.trim(F.regexp_extract("line", ENTRY, 1)), F.lit(""))).alias("entry"),
        level.alias("level"), F.when(level.isNotNull(), F.trim(F.regexp_extract("line", HEADING, 2))).alias("heading"),
    )
    mark = F.struct("level", "heading", "n")
    upper = F.last(F.when(F.col("level") <= 2, mark), True).over(by)
    lower = F.last(F.when(F.col("level") <= 3, mark), True).over(by)
    each = each.withColumn("u", upper).withColumn("l", lower)
    in_section, in_sub = F.col("u.level") == 2, (F.col("u.level") == 2) & (F.col("l.level") == 3)
    return each.select(
        "id", "n", "line", "in_head", "n_head", "links", "entry", "level", "heading", F.when(in_section, F.col("u.heading")).alias("section"), F.when(in_section, F.col("u.n")).alias("section_n"),
        F.when(in_sub, F.col("l.heading")).alias("sub"), F.when(in_sub, F.col("l.n")).alias("sub_n"),
    )


def known(df: DataFrame, column: str, notes: DataFrame) -> DataFrame:
    """`df` with `column` replaced by the id that it names, exactly or but for case; rows that name none go."""
    ids = notes.select(F.col("id").alias("_exact"), F.lower("id").alias("_low"))
    low = ids.groupBy("_low").agg(F.max("_exact").alias("_any"))  # of ids that differ by case alone one stands for all
    exact = ids.select(F.col("_exact"))
    out = df.join(exact, F.col(column) == F.col("_exact"), "left").join(low, F.lower(column) == F.col("_low"), "left")
    return out.withColumn(column, F.coalesce("_exact", "_any")).where(F.col(column).isNotNull()).drop("_exact", "_low", "_any")


class Structure:
    """What the rules share, each a table: links (src, dst, n), declared (part, hub) of front matter, confirmed (part,
    hub) with those of header lines and of mutual links, parts_lists (hub, part, n)."""

    def __init__(self, notes: DataFrame, index: str, archive: str = ARCHIVE, themes: tuple[str, ...] = THEMES, structural: bool = True):
        self.index, self.archive = index, archive
        self.notes = G.cut(parsed(notes, archive))
        self.lines = G.cut(lines(self.notes))
        ids = self.notes.select(F.col("id").alias("dst"))
        self.links = G.cut(self.lines.select(F.col("id").alias("src"), "n", F.explode("links").alias("dst")).where("src <> dst").join(ids, "dst", "left_semi"))
        self.edges = G.cut(self.links.select("src", "dst").distinct())
        hub_of = lambda c: known(self.notes.where((F.col("id") != index) & F.col(c).isNotNull()).select(F.col("id").alias("part"), F.col(c).alias("hub")), "hub", self.notes).where((F.col("hub") != F.col("part")) & (F.col("hub") != index))
        self.declared = G.cut(hub_of("part_of"))
        marked = G.cut(hub_of("marked"))
        self.confirmed = G.cut(G.hubs(self.edges, self.notes, marked, index)) if structural else marked
        head = self.lines.where(F.trim("line") == PARTS).groupBy("id").agg(F.min("n").alias("p"))
        after = self.lines.join(head, "id").where("n > p")
        stop = after.where("level IS NOT NULL").groupBy("id").agg(F.min("n").alias("stop"))
        raw = after.join(stop, "id", "left").where("entry IS NOT NULL AND (stop IS NULL OR n < stop)").select(F.col("id").alias("hub"), F.col("entry").alias("part"), "n")
        self.parts_lists = G.cut(known(raw, "part", self.notes).where("hub <> part"))
        own = self.lines.where((F.col("id") == index) & (F.col("level") == 2)).select(F.lower("heading").alias("t"))
        listed = self.notes.sparkSession.createDataFrame([(t.lower(),) for t in themes], "t string")
        self.themes = listed.union(own).distinct()
        theme = self.notes.where("theme IS NOT NULL").select("id", F.lower("theme").alias("t"))
        self.bad_theme = theme.join(self.themes, "t", "left_anti").select("id")


ISSUE = "rule string, note string, part string, hub string, line int, section string, sub string, fix string, detail string"
_FIELDS = [f.split(" ")[0] for f in ISSUE.split(", ")]


def _issues(df: DataFrame, **given: Column | str | None) -> DataFrame:
    value = lambda v: F.lit(None) if v is None else v if isinstance(v, Column) else F.lit(v)
    return df.select(*[value(given.get(f)).cast("int" if f == "line" else "string").alias(f) for f in _FIELDS])


def links_and_parts(s: Structure) -> DataFrame:
    """R1 the index lists a declared part; R2 a part doesn't link to its hub; R3 a hub doesn't list a part that links to
    it, or a list names a note that declares nothing; R4 a part names two or more of its siblings in a line."""
    c = F.col
    up, down = s.edges.select(c("src").alias("part"), c("dst").alias("hub")), s.edges.select(c("src").alias("hub"), c("dst").alias("part"))
    in_index = s.links.where(c("src") == s.index).groupBy(c("dst").alias("part")).agg(F.min("n").alias("n"))
    listed_hub = in_index.select(c("part").alias("hub"), F.lit(True).alias("hub_listed"))
    r1 = _issues(s.declared.join(in_index, "part").join(listed_hub, "hub", "left"), rule="R1", note=s.index, part=c("part"), hub=c("hub"), line=c("n"), detail=F.when(c("hub_listed"), "its hub is listed too"))
    r2 = _issues(s.declared.join(up, ["part", "hub"], "left_anti"), rule="R2", note=c("part"), hub=c("hub"), fix="add-up-line")
    r3 = _issues(s.declared.join(up, ["part", "hub"], "left_semi").join(down, ["part", "hub"], "left_anti"), rule="R3", note=c("hub"), part=c("part"), hub=c("hub"), fix="append-hub-parts-line")
    free = s.notes.where("NOT has_part_of").select(c("id").alias("part")).join(s.declared.select("part"), "part", "left_anti")
    claims = s.parts_lists.select("hub", "part").distinct().join(free, "part", "left_semi").groupBy("part").agg(F.min("hub").alias("hub"), F.count("*").alias("k"))
    alone = c("k") == 1
    r3b = _issues(claims, rule="R3", note=c("part"), hub=F.when(alone, c("hub")), fix=F.when(alone, "add-part-of"), detail=F.when(~alone, F.concat(F.lit("claimed by "), c("k").cast("string"), F.lit(" hubs"))))
    mine = s.links.join(s.confirmed.select(c("part").alias("src"), "hub"), "src").join(s.confirmed.select(c("part").alias("dst"), c("hub").alias("hub2")), "dst").where("hub = hub2")
    r4 = mine.groupBy("src", "hub", "n").agg(F.array_sort(F.collect_set("dst")).alias("siblings")).where(F.size("siblings") >= 2)
    text = r4.join(s.lines.select(c("id").alias("src"), "n", "line"), ["src", "n"])
    pure = F.when(M.pure_sibling_line(c("line")), "sibling links alone").otherwise("links in prose")
    r4 = _issues(text, rule="R4", note=c("src"), part=F.array_join("siblings", ","), hub=c("hub"), line=c("n"), detail=pure)
    return reduce(DataFrame.unionByName, [r1, r2, r3, r3b, r4])


def reach_and_themes(s: Structure) -> DataFrame:
    """R5 nothing leads to a note; R7 a theme that is neither configured nor a section of the index, with the theme to
    take: that of its subtheme's name, of all other notes of the subtheme, or of its hub."""
    c = F.col
    reached = reduce(DataFrame.union, [s.edges.where(c("src") == s.index).select(c("dst").alias("id")), s.confirmed.select("part"), s.parts_lists.select("part")])
    orphans = s.notes.where((c("id") != s.index) & ~c("under_archive")).join(reached, "id", "left_anti")
    r5 = _issues(orphans.join(s.bad_theme.withColumn("bad", F.lit(True)), "id", "left"), rule="R5", note=c("id"), detail=F.when(c("bad"), "invalid theme"))
    bad = s.notes.where(c("id") != s.index).join(s.bad_theme, "id", "left_semi").select("id", "theme", "subtheme")
    good = s.notes.where("theme IS NOT NULL").join(s.bad_theme, "id", "left_anti")
    alone = good.where("subtheme IS NOT NULL").groupBy("subtheme").agg(F.collect_set(F.lower("theme")).alias("ts")).where(F.size("ts") == 1).select("subtheme", F.get("ts", F.lit(0)).alias("by_subtheme"))
    by_hub = s.declared.join(good.select(c("id").alias("hub"), F.lower("theme").alias("by_hub")), "hub").select(c("part").alias("id"), "by_hub")
    named = s.themes.select(c("t").alias("by_name"))
    told = bad.join(named, F.lower("subtheme") == c("by_name"), "left").join(alone, "subtheme", "left").join(by_hub, "id", "left")
    r7 = _issues(told, rule="R7", note=c("id"), section=F.coalesce("by_name", "by_subtheme", "by_hub"), detail=F.concat(F.lit("theme "), c("theme")))
    return r5.unionByName(r7)


def places(s: Structure) -> DataFrame:
    """R6 the index's one archive section lists a note that isn't archived, or another section one that is. A note goes
    to the one section where notes of its theme stand, under the heading there that has most of its subtheme, else most
    entries, the first of equals; an archived one goes to the archive section."""
    c = F.col
    own = s.lines.where(c("id") == s.index)
    heads = own.where((c("level") == 2)).select("heading", "n")
    arch = heads.where(F.lower("heading").contains(ARCHIVE)).agg(F.count("*").alias("k"), F.min("n").alias("arch_n"), F.min("heading").alias("arch")).where("k = 1").drop("k")
    entries = known(own.where("entry IS NOT NULL AND section IS NOT NULL").select(c("entry").alias("part"), "n", "section", "section_n", "sub", "sub_n"), "part", s.notes)
    meta = s.notes.select(c("id").alias("part"), "theme", "subtheme", "archived").join(s.bad_theme.select(c("id").alias("part"), F.lit(True).alias("bad")), "part", "left")
    e = entries.join(meta, "part").crossJoin(F.broadcast(arch)).withColumn("in_arch", c("section_n") == c("arch_n"))  # one row at most
    homes = e.where("NOT in_arch AND theme IS NOT NULL AND bad IS NULL").groupBy("theme").agg(F.collect_set("section").alias("ss")).where(F.size("ss") == 1).select("theme", F.get("ss", F.lit(0)).alias("home"))
    first = heads.groupBy("heading").agg(F.min("n").alias("home_n")).withColumnRenamed("heading", "home")
    wrong = e.where("in_arch AND NOT archived").join(homes, "theme", "left").join(first, "home", "left")
    subs = own.where((c("level") == 3) & c("section").isNotNull()).select(c("section_n").alias("home_n"), c("sub_n"), c("sub").alias("to"))
    size = e.groupBy(c("section_n").alias("home_n"), "sub_n").agg(F.count("*").alias("all"))
    alike = e.where("subtheme IS NOT NULL").groupBy(c("section_n").alias("home_n"), "sub_n", "subtheme").agg(F.count("*").alias("same"))
    asked = wrong.where("home IS NOT NULL AND bad IS NULL").select("part", "n", "home_n", "subtheme").join(subs, "home_n").join(size, ["home_n", "sub_n"], "left").join(alike, ["home_n", "sub_n", "subtheme"], "left")
    best = asked.groupBy("part", "n").agg(F.max_by("to", F.struct(F.coalesce("same", F.lit(0)), F.coalesce("all", F.lit(0)), -c("sub_n"))).alias("to"))
    ok = c("home").isNotNull() & c("bad").isNull()
    a = _issues(wrong.join(best, ["part", "n"], "left"), rule="R6", note=s.index, part=c("part"), line=c("n"), section=F.when(ok, c("home")), sub=F.when(ok, c("to")), fix=F.when(ok, "move-index-line"), detail=F.when(c("bad"), "active, invalid theme").otherwise("active"))
    b = _issues(e.where("NOT in_arch AND archived"), rule="R6", note=s.index, part=c("part"), line=c("n"), section=c("arch"), fix="move-index-line", detail="archived")
    return a.unionByName(b)


def possible_duplicates(s: Structure, words: DataFrame, most: int = MOST_DUPLICATES) -> DataFrame:
    """D1 the `most` likeliest pairs of repeated notes that are neither the index nor in the archive. `words`: id, theme,
    subtheme, tokens, words, title_words, as graph.duplicates takes them."""
    pool = words.join(s.notes.where((F.col("id") != s.index) & ~F.col("under_archive")).select("id"), "id", "left_semi")
    best = G.duplicates(pool).orderBy(F.desc("score"), F.desc("shared"), "a", "b").limit(most)
    return _issues(best, rule="D1", note=F.col("a"), part=F.col("b"), detail=F.concat(F.lit("score "), F.col("score").cast("string")))


def audit(s: Structure, words: DataFrame | None = None) -> DataFrame:
    """Issues of all rules: rule, note, part, hub, line, section, sub, fix (null: to be judged), detail."""
    found = [links_and_parts(s), reach_and_themes(s), places(s), *([possible_duplicates(s, words)] if words is not None else [])]
    return reduce(DataFrame.unionByName, found)


# ---- fixes ----

EDIT = "id string, at int, remove int, insert array<string>, ord string"


def _at_end(of: DataFrame, lines: DataFrame) -> DataFrame:
    """`of` (id, a, z: a stretch of lines, its head included) with at: behind its last line that is not blank."""
    inside = lines.where(F.trim("line") != "").select("id", "n")
    last = of.join(inside, "id").where("n >= a AND n < z").groupBy(*of.columns).agg(F.max("n").alias("n"))
    return last.withColumn("at", F.col("n") + 1).drop("n")


def edits(fixes: DataFrame, s: Structure) -> DataFrame:
    """Line edits of fixes (fix, note, part, hub, line, section, sub, hook): add-up-line, add-part-of, attach (both),
    append-hub-parts-line, remove-line, replace-index-line, move-index-line, append-index-section-line. A fix that finds
    its place gone, or done already, gives none."""
    c, lit = F.col, F.lit
    one = lambda kind: fixes.where(c("fix") == kind)
    text = lambda *xs: F.array(*[x if isinstance(x, Column) else lit(x) for x in xs])
    edit = lambda df, at, remove, insert, ord_: df.select(c("id"), at.cast("int").alias("at"), F.lit(remove).cast("int").alias("remove") if isinstance(remove, int) else remove.cast("int").alias("remove"), insert.cast("array<string>").alias("insert"), (ord_ if isinstance(ord_, Column) else lit(ord_)).alias("ord"))
    size = s.lines.groupBy("id").agg((F.max("n") + 1).alias("total"), F.max("n_head").alias("n_head"), F.min(F.when(~c("in_head") & (F.trim("line") != ""), c("n"))).alias("first"))
    early = s.lines.where(~c("in_head") & (c("n") < c("n_head") + 5) & c("line").rlike(UP_LINE)).select("id").distinct()
    to_hub = fixes.where(c("fix").isin("add-up-line", "attach")).select(c("note").alias("id"), "hub").dropDuplicates(["id"])
    has_head = s.notes.where("head <> ''").select("id", "has_part_of")
    up_alone = to_hub.join(one("add-up-line").select(c("note").alias("id")), "id", "left_semi")
    up_attached = to_hub.join(one("attach").select(c("note").alias("id")), "id", "left_semi").join(has_head.where("NOT has_part_of"), "id", "left_semi")
    ups = up_alone.unionByName(up_attached).dropDuplicates(["id"]).join(early, "id", "left_anti").join(size, "id")
    body = F.coalesce("first", "total")
    says = F.concat(lit("Up: [["), c("hub"), lit("]] — part of "), c("hub"), lit("."))
    out = [edit(ups, c("n_head"), body - c("n_head"), F.when(c("n_head") > 0, text("", says, "")).otherwise(text(says, "")), "0")]
    keys = fixes.where(c("fix").isin("add-part-of", "attach")).select(c("note").alias("id"), "hub").dropDuplicates(["id"]).join(has_head.where("NOT has_part_of"), "id", "left_semi").join(size, "id")
    out.append(edit(keys, c("n_head") - 1, 0, text(F.concat(lit("part_of: "), c("hub"))), "1"))
    # parts of one hub are one edit
    asked = one("append-hub-parts-line").select(c("hub").alias("id"), "part", "hook")
    listed = s.parts_lists.select(c("hub").alias("id"), "part")
    info = s.notes.select(c("id").alias("part"), F.coalesce(F.nullif("description", lit("")), F.nullif("label", lit("")), "id").alias("told"))
    entry = F.concat(lit("- [["), c("part"), lit("]] — "), F.coalesce("hook", "told"))
    new = asked.join(listed, ["id", "part"], "left_anti").join(info, "part").groupBy("id").agg(F.array_distinct(F.array_sort(F.collect_list(entry))).alias("new"))
    head = s.lines.where(F.trim("line") == PARTS).groupBy("id").agg(F.min("n").alias("a"))
    stop = s.lines.join(head, "id").where("n > a AND level IS NOT NULL").groupBy("id").agg(F.min("n").alias("stop"))
    span = new.select("id").join(size.select("id", "total", "n_head"), "id").join(head, "id", "left").join(stop, "id", "left")
    span = span.select("id", F.coalesce("a", "n_head").alias("a"), F.when(c("a").isNotNull(), F.coalesce("stop", "total")).otherwise(c("total")).alias("z"), c("a").isNotNull().alias("there"), c("stop").isNotNull().alias("more"), F.greatest("n_head", lit(0)).alias("h"))
    placed = span.join(_at_end(span.select("id", "a", "z"), s.lines).select("id", "at"), "id", "left").join(new, "id").withColumn("at", F.coalesce("at", "h"))
    tail = F.when(c("there") & ~c("more"), F.concat(c("new"), text(""))).when(c("there"), F.concat(c("new"), text(""))).when(c("at") > c("h"), F.concat(text("", PARTS), c("new"), text(""))).otherwise(F.concat(text(PARTS), c("new"), text("")))
    out.append(edit(placed, c("at"), c("z") - c("at"), tail, "2"))
    gone = one("remove-line").select(c("note").alias("id"), c("line").alias("n")).distinct().join(s.lines.select("id", "n"), ["id", "n"], "left_semi")
    out.append(edit(gone, c("n"), 1, text().cast("array<string>"), "3"))
    swap = one("replace-index-line").select(c("note").alias("id"), c("line").alias("n"), "part", "hub", (c("detail").isNotNull()).alias("drop")).dropDuplicates(["id", "n"]).join(s.lines.select("id", "n", "line"), ["id", "n"])
    linked = F.array_contains(F.transform(F.regexp_extract_all("line", lit(LINK), 1), lambda t: F.lower(F.trim(t))), F.lower("part"))
    pieces = F.split("line", r"\[\[")
    fresh = F.array_join(F.transform(pieces, lambda x, i: F.when((i > 0) & (F.lower(F.trim(F.regexp_extract(x, r"^([^\]|#]*)", 1))) == F.lower("part")), F.concat(c("hub"), F.regexp_replace(x, r"^[^\]]*", ""))).otherwise(x)), "[[")
    out.append(edit(swap.where(c("drop") | linked), c("n"), 1, F.when(c("drop"), text().cast("array<string>")).otherwise(text(fresh)), "4"))
    # lines that move or come to the end of a section
    spans = s.lines.where("level IS NOT NULL").select("id", c("n").alias("a"), "level", "heading", "section_n")
    later = spans.select("id", c("a").alias("b"), c("level").alias("next_level"))
    ends = spans.join(later, "id", "left").groupBy("id", "a", "level", "heading", "section_n").agg(F.min(F.when((c("b") > c("a")) & (c("next_level") <= c("level")), c("b"))).alias("z")).join(size.select("id", "total"), "id").withColumn("z", F.coalesce("z", "total"))
    moved = one("move-index-line").select(c("note").alias("id"), "part", "section", "sub").dropDuplicates(["id", "part"])
    src = s.lines.where("entry IS NOT NULL").select("id", F.lower("entry").alias("low"), "n", "line").groupBy("id", "low").agg(F.min("n").alias("from"), F.min_by("line", "n").alias("line"))
    moved = moved.withColumn("low", F.lower("part")).join(src, ["id", "low"])
    target = ends.where("level = 2").groupBy("id", c("heading").alias("section")).agg(F.min(F.struct("a", "z")).alias("x")).select("id", "section", "x.*")
    sub = ends.where("level = 3").groupBy("id", "section_n", c("heading").alias("sub")).agg(F.min(F.struct("a", "z")).alias("y")).select("id", c("section_n").alias("a"), "sub", c("y.a").alias("a3"), c("y.z").alias("z3"))
    aimed = moved.join(target, ["id", "section"]).join(sub, ["id", "a", "sub"], "left")
    aimed = aimed.select("id", "part", "from", "line", F.coalesce("a3", "a").alias("a"), F.coalesce("z3", "z").alias("z"))
    spot = _at_end(aimed.select("id", "a", "z").distinct(), s.lines)
    going = aimed.join(spot, ["id", "a", "z"])
    out.append(edit(going, c("from"), 1, text().cast("array<string>"), "5"))
    fresh_entry = one("append-index-section-line").select(c("note").alias("id"), "part", "section", "hook").dropDuplicates(["id", "part"])
    already = s.lines.where("not in_head").select("id", F.explode(F.transform(F.regexp_extract_all("line", lit(LINK), 1), lambda t: F.lower(F.trim(t)))).alias("low"))
    fresh_entry = fresh_entry.withColumn("low", F.lower("part")).join(already, ["id", "low"], "left_anti").join(info, "part", "left")
    any_level = ends.groupBy("id", c("heading").alias("section")).agg(F.min(F.struct("a", "z")).alias("x")).select("id", "section", "x.*")
    coming = fresh_entry.join(any_level, ["id", "section"]).select("id", "a", "z", entry.alias("line")).join(_at_end(any_level.select("id", "a", "z"), s.lines), ["id", "a", "z"])
    both = going.select("id", "at", lit("0").alias("way"), F.lpad(c("from").cast("string"), 9, "0").alias("k"), "line").unionByName(coming.select("id", "at", lit("1").alias("way"), c("line").alias("k"), "line"))
    arriving = both.groupBy("id", "at").agg(F.transform(F.array_sort(F.collect_list(F.struct("way", "k", "line"))), lambda x: x["line"]).alias("new"))
    out.append(edit(arriving, c("at"), 0, c("new"), "6"))
    return reduce(DataFrame.unionByName, out).distinct()


def schedule(found: DataFrame) -> DataFrame:
    """Edits with `now`: an edit waits if an earlier one of its note (by place, insertions first) takes away lines up to
    it or beyond. Insertions at one place don't touch each other."""
    by = W.partitionBy("id").orderBy("at", F.col("remove") > 0, "ord", "insert").rowsBetween(W.unboundedPreceding, -1)
    end = F.when(F.col("remove") > 0, F.col("at") + F.col("remove"))
    out = found.withColumn("now", F.col("at") >= F.coalesce(F.max(end).over(by), F.lit(0)))
    moving = F.col("ord").isin("5", "6")  # a line leaves and arrives in one round
    held = F.max(moving & ~F.col("now")).over(W.partitionBy("id"))
    return out.withColumn("now", F.col("now") & ~(moving & held))


def apply_edits(s: Structure, found: DataFrame) -> DataFrame:
    """id, before, after of the notes that the edits change. Where a line went, more than one blank line in a row becomes one."""
    c = F.col
    now = found.where("now").select("id", "at", "remove", "insert", "ord")
    touched = now.groupBy("id").agg(F.max(c("ord").isin("3", "4", "5", "6")).alias("tidy"))
    own = s.lines.join(touched.select("id"), "id", "left_semi").select("id", "n", "line")
    cut = now.where("remove > 0").select("id", F.explode(F.sequence(c("at"), c("at") + c("remove") - 1)).alias("n"))
    stay = own.join(cut, ["id", "n"], "left_anti").select("id", "n", F.lit("~").alias("ord"), F.lit(0).alias("k"), "line")
    come = now.select("id", c("at").alias("n"), "ord", F.posexplode("insert").alias("k", "line"))
    new = stay.unionByName(come).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "ord", "k", "line"))), lambda x: x["line"]), "\n").alias("after"))
    out = s.notes.select("id", c("text").alias("before")).join(new, "id").join(touched, "id")
    return out.select("id", "before", F.when(c("tidy"), F.regexp_replace("after", r"\n{3,}", "\n\n")).otherwise(c("after")).alias("after"))


def fix(s: Structure, issues: DataFrame) -> DataFrame:
    """id, before, after: the notes that issues with a fix change, all that can be done at once."""
    wanted = G.cut(issues.where("fix IS NOT NULL").withColumn("hook", F.lit(None).cast("string")))
    return apply_edits(s, G.cut(schedule(edits(wanted, s))))


def fixed_notes(notes: DataFrame, changes: DataFrame) -> DataFrame:
    """`notes` with the texts that the changes give."""
    return notes.join(changes.select("id", "after"), "id", "left").withColumn("text", F.coalesce("after", "text")).drop("after").select(*notes.columns)


def repair(notes: DataFrame, index: str, rounds: int = 5, **given) -> tuple[DataFrame, int]:
    """Notes fixed and audited again until no fix is left, and the rounds it took: a fix may ask for another, as a note
    that now declares its hub has to link to it. More than `rounds` are refused."""
    for done in range(rounds + 1):
        s = Structure(notes, index, **given)
        changes = G.cut(fix(s, audit(s)).where("before <> after"))
        if changes.isEmpty():
            return notes, done
        notes = G.cut(fixed_notes(notes, changes))
    raise ValueError(f"fixes are left after {rounds} rounds")


def lost_lines(changes: DataFrame) -> DataFrame:
    """id, line of lines that stand in a text less often after its change than before; blank lines are left out."""
    each = lambda k: changes.select("id", F.explode(F.split(k, r"\r?\n")).alias("line")).where(F.trim("line") != "")
    return each("before").exceptAll(each("after"))
