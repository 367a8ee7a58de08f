"""Sections and the planning built on them: packing, dormancy, state views, trimming, budgets, index trees.

Folds that depend on order run as `aggregate` over a note's own array of sections or lines.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvex.functions import dates as D
from corvex.functions import text as X

PART_TOKENS, DORMANT_DAYS, LEAST_TOKENS = 2000, 105, 100
VIEW_TOKENS, VIEW_DATED, VIEW_RECENT, VIEW_SAVED = 1500, 3, 2, 0.3
#: What ends a clause of a hook.
CLAUSE_ENDS = (" — ", ": ", "; ", " (", ", ")
HOOK_CHARS, HOOK_KEPT, WORDS_KEPT, ENTRY_CAP = 90, 20, 0.8, 4


def fenced(lines: Column) -> Column:
    """For each line, whether it is a fence or inside one: a fence closes by the same sign, at least as
    often, with nothing after it."""
    def step(acc, line):
        mark = F.regexp_extract(line, r"^ {0,3}(`{3,}|~{3,})", 1)
        rest = F.regexp_replace(line, r"^ {0,3}(`{3,}|~{3,})", "")
        opened = acc["open"]
        closes = (mark != "") & (opened != "") & (F.substring(mark, 1, 1) == F.substring(opened, 1, 1)) & (F.length(mark) >= F.length(opened)) & (F.trim(rest) == "")
        now = F.when(closes, F.lit("")).when((opened == "") & (mark != ""), mark).otherwise(opened)
        return F.struct(now.alias("open"), F.concat(acc["in"], F.array((opened != "") | (mark != ""))).alias("in"))

    start = F.struct(F.lit("").alias("open"), F.array().cast("array<boolean>").alias("in"))
    return F.aggregate(lines, start, step)["in"]


def section_spans(notes: DataFrame, body: str = "body") -> DataFrame:
    """id, pos, title, level, start_line, end_line, text, tokens: the text cut at every ## to ###### heading
    outside fences; what stands before the first is level 0, if it is not blank."""
    lines = notes.select("id", F.split(body, r"\r?\n").alias("lines")).withColumn("in", fenced(F.col("lines")))
    each = lines.select("id", F.posexplode(F.arrays_zip("lines", "in")).alias("n", "x")).select("id", "n", F.col("x.lines").alias("line"), F.col("x.in").alias("in"))
    head = ~F.col("in") & F.col("line").rlike(r"^#{2,6}[ \t]+\S")
    w = W.partitionBy("id").orderBy("n")
    cut = each.withColumn("pos", F.sum(head.cast("int")).over(w)).withColumn("head", head)
    g = cut.groupBy("id", "pos").agg(
        F.min("n").alias("start_line"), (F.max("n") + 1).alias("end_line"), F.max_by("line", F.when(F.col("head"), 1)).alias("h"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("text"),
    )
    out = g.select(
        "id", "pos", F.coalesce(F.trim(F.regexp_replace("h", r"^#{2,6}[ \t]+", "")), F.lit("")).alias("title"),
        F.length(F.regexp_extract(F.coalesce("h", F.lit("")), r"^(#{2,6})", 1)).alias("level"), "start_line", "end_line", "text", X.tokens("text").alias("tokens"),
    )
    return out.where((F.col("pos") > 0) | (F.trim("text") != ""))


def section_ends(headings: DataFrame, last: Column) -> DataFrame:
    """From id, line, level: where a section ends, which is the next heading of the same or a higher level
    (`last` if there is none). A note's headings are one array, searched by itself."""
    g = headings.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("line", "level"))).alias("hs"), F.max(last).alias("last"))
    each = g.select("id", "last", "hs", F.explode("hs").alias("h"))
    later = F.filter("hs", lambda x: (x["line"] > F.col("h.line")) & (x["level"] <= F.col("h.level")))
    return each.select("id", F.col("h.line").alias("line"), F.col("h.level").alias("level"), F.coalesce(F.get(later, F.lit(0))["line"], F.col("last")).alias("end"))


def pack(tokens: Column, most: int = PART_TOKENS) -> Column:
    """Sizes of consecutive sections put together up to `most` tokens; a larger one is a part of its own."""
    def step(acc, t):
        last = F.element_at(acc, -1)
        fits = (F.size(acc) > 0) & (last + t <= most)
        return F.when(fits, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(last + t))).otherwise(F.concat(acc, F.array(t)))

    return F.aggregate(F.transform(tokens, lambda t: t.cast("bigint")), F.array().cast("array<bigint>"), step)


def dormant(notes: DataFrame, sections: DataFrame, last: DataFrame, started: Column, today: Column, days: int = DORMANT_DAYS, least: int = LEAST_TOKENS, most: int | None = 20) -> DataFrame:
    """Sections of `least` tokens or more, of notes neither read nor searched nor written in the last `days`
    days, once activity was counted for as long; largest first. `last`: id, type, last_day."""
    cutoff = F.date_sub(today, days)
    recent = last.where(F.col("last_day") > cutoff).select("id").distinct()
    quiet = notes.where((F.to_date(F.timestamp_millis("mtime_ms")) <= cutoff) & (started <= cutoff)).join(recent, "id", "left_anti")
    found = sections.where(F.col("tokens") >= least).join(quiet.select("id"), "id", "left_semi").orderBy(F.desc("tokens"), "id", "pos")
    return found.limit(most) if most is not None else found


def first_seen(sightings: DataFrame) -> DataFrame:
    """note, hash, first day."""
    return sightings.groupBy("note", "hash").agg(F.min("day").alias("first_day"))


def state_view(sections: DataFrame, mtime_ms: Column, recent: int = VIEW_RECENT, dated: int = VIEW_DATED, least: int = VIEW_TOKENS, saved: float = VIEW_SAVED) -> DataFrame:
    """Journals shortened to their undated and `recent` newest dated sections: id, kept, n_dated, n_older,
    tokens, kept_tokens; only notes of more than `least` tokens with `dated` dated sections, for which a
    share `saved` goes. `sections` has id, pos, title, text, tokens; `mtime_ms` is one of its columns."""
    s = sections.withColumn("date", D.heading_date(F.col("title"))).withColumn("m", mtime_ms)
    g = s.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "date", "text", "tokens"))).alias("s"), F.max("m").alias("m"), F.sum("tokens").alias("tokens"))
    with_date = F.filter("s", lambda x: x["date"].isNotNull())
    g = g.withColumn("d", with_date).where((F.size("d") >= dated) & (F.col("tokens") > least))
    g = g.withColumn("ts", D.infer_years(F.transform("d", lambda x: x["date"]), F.col("m")))
    ranked = F.array_sort(F.zip_with("d", "ts", lambda x, t: F.struct((-t).alias("t"), (-x["pos"]).alias("p"))))
    newest = F.transform(F.slice(ranked, 1, recent), lambda x: -x["p"])
    keep = F.filter("s", lambda x: x["date"].isNull() | F.array_contains(F.col("newest"), x["pos"]))
    g = g.withColumn("newest", newest).withColumn("keep", keep)
    kept = F.array_join(F.transform("keep", lambda x: x["text"]), "\n")
    out = g.select("id", kept.alias("kept"), F.size("d").alias("n_dated"), (F.size("d") - F.size("newest")).alias("n_older"), "tokens", X.tokens(kept).alias("kept_tokens"))
    return out.where(F.col("tokens") - F.col("kept_tokens") >= saved * F.col("tokens"))


def detail_kept(dropped: Column, elsewhere: Column) -> Column:
    """Whether WORDS_KEPT of the significant words of what was dropped stand elsewhere; nothing dropped is kept."""
    d = X.significant_words(F.coalesce(dropped, F.lit("")))
    return (F.size(d) == 0) | (F.size(F.array_intersect(d, X.significant_words(F.coalesce(elsewhere, F.lit(""))))) >= WORDS_KEPT * F.size(d))


def shorten_hook(hook: Column, most: int = HOOK_CHARS) -> Column:
    """A hook cut at its last clause end that leaves HOOK_KEPT to `most` characters, else at a word."""
    head = F.substring(hook, 1, most + 3)  # with the whole sign that ends a clause
    clause = F.regexp_extract(head, rf"^(.{{{HOOK_KEPT},{most}}})(?:{'|'.join(map(re.escape, CLAUSE_ENDS))})", 1)
    word = F.regexp_extract(head, rf"^(.{{1,{most}}})(?: |$)", 1)
    return F.when(F.length(hook) <= most, hook).when(clause != "", clause).when(word != "", word).otherwise(F.substring(hook, 1, most))


def index_trim(bullets: DataFrame, notes: DataFrame, most: int = HOOK_CHARS) -> DataFrame:
    """pos, id, hook, short for hooks longer than `most` of which no detail is lost: what is cut stands in the
    note itself. Hooks with links of their own stay as they are."""
    long = bullets.where((F.length("hook") > most) & ~F.col("hook").contains("[[")).join(notes.select("id", "body"), "id")
    short = shorten_hook(F.col("hook"), most)
    dropped = F.substring(F.col("hook"), F.length(short) + 1, F.length("hook"))
    return long.where(detail_kept(dropped, F.col("body"))).select("pos", "id", "hook", short.alias("short"))


def proposals(*producers: DataFrame, dismissed: DataFrame | None = None) -> DataFrame:
    """kind, target, gain_tokens of all producers with stable ids, less the dismissed; most gain first."""
    out = producers[0]
    for p in producers[1:]:
        out = out.unionByName(p)
    out = out.withColumn("id", F.substring(F.sha1(F.concat_ws("\n", "kind", F.col("target").cast("string"))), 1, 12))
    if dismissed is not None:
        out = out.join(dismissed.select("id"), "id", "left_anti")
    return out.orderBy(F.desc("gain_tokens"), "id")


def budget(text: Column, tokens: int, notice_bytes: int = 0) -> Column:
    """As many whole lines from the start as fit the budget and leave no fence open; the first line stays."""
    lines = F.split(text, "\n")
    def step(acc, line):
        size = acc["size"] + F.octet_length(line) + 1
        mark = line.rlike(r"^ {0,3}(`{3,}|~{3,})")
        opened = acc["open"] != mark
        n = acc["n"] + 1
        fits = ~opened & (F.ceil((size - 1 + notice_bytes) / 4) <= tokens)
        return F.struct(size.alias("size"), opened.alias("open"), n.alias("n"), F.when(fits, n).otherwise(acc["best"]).alias("best"))

    start = F.struct(F.lit(0).alias("size"), F.lit(False).alias("open"), F.lit(0).alias("n"), F.lit(1).alias("best"))
    best = F.aggregate(lines, start, step)["best"]
    return F.when(F.ceil(F.octet_length(text) / 4) <= tokens, text).otherwise(F.array_join(F.slice(lines, F.lit(1), best), "\n"))


def index_entries(index: DataFrame) -> DataFrame:
    """From id, body of index notes: group_no, group, pos, target, hook of their bullets; bullets before any
    heading have group_no 0 and no group."""
    lines = index.select("id", F.posexplode(F.split("body", r"\r?\n")).alias("n", "line"))
    head = F.col("line").rlike(r"^#{2,6}[ \t]+\S")
    w = W.partitionBy("id").orderBy("n")
    cut = lines.withColumn("group_no", F.sum(head.cast("int")).over(w)).withColumn("group", F.last(F.when(head, F.trim(F.regexp_replace("line", r"^#+[ \t]+", ""))), True).over(w))
    bullet = r"^\s*[-*+]\s+\[\[([^\]|#]+)[^\]]*\]\]\s*(?:[-—:–]+\s*)?(.*)$"
    found = cut.where(F.col("line").rlike(bullet))
    return found.select("id", "group_no", "group", F.col("n").alias("pos"), F.trim(F.regexp_extract("line", bullet, 1)).alias("target"), F.regexp_extract("line", bullet, 2).alias("hook"))


def index_level(entries: DataFrame, hubs: DataFrame, cap: int = ENTRY_CAP) -> DataFrame:
    """By group: the first `cap` hubs (all entries where a group has none) and how many more there are."""
    marked = entries.join(hubs.select(F.col("id").alias("target"), F.lit(True).alias("hub")), "target", "left")
    pool = marked.withColumn("any", F.max(F.coalesce("hub", F.lit(False))).over(W.partitionBy("group_no"))).where("hub OR NOT any")
    g = pool.groupBy("group_no").agg(F.max("group").alias("group"), F.array_sort(F.collect_list(F.struct("pos", "target"))).alias("e"))
    shown = F.transform(F.slice("e", 1, cap), lambda x: x["target"])
    return g.select("group_no", "group", shown.alias("shown"), F.greatest(F.size("e") - cap, F.lit(0)).alias("more"))


def conserved(before: DataFrame, after: DataFrame) -> DataFrame:
    """Lines (trimmed, not blank) that are lost or new between two sets of texts: empty if none is."""
    def lines(df):
        return df.select(F.explode(F.split("text", r"\r?\n")).alias("l")).select(F.trim("l").alias("line")).where("line <> ''")

    a, b = lines(before), lines(after)
    return a.exceptAll(b).withColumn("what", F.lit("lost")).unionByName(b.exceptAll(a).withColumn("what", F.lit("new")))


def directories(paths: DataFrame, depth: int) -> DataFrame:
    """directory, newest: the latest mtime below every directory of up to `depth` segments."""
    segs = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.least(F.size(segs) - 1, F.lit(depth))), lambda i: F.array_join(F.slice(segs, F.lit(1), i), "/"))
    has = paths.where(F.size(segs) > 1).select(F.explode(ups).alias("directory"), "mtime_ms")
    return has.groupBy("directory").agg(F.max("mtime_ms").alias("newest"), F.count("*").alias("files"))


#: Orders of a listing: by name without regard to case, then by name; or by time, then by name.
LISTING = {"name": (True, False), "name_desc": (True, True), "oldest": (False, False), "newest": (False, True)}


def listed(rows: DataFrame, mode: str, most: int, name: str = "path", time: str = "mtime_ms") -> DataFrame:
    """The first `most` rows in an order of LISTING."""
    by_name, down = LISTING[mode]
    first = F.lower(name) if by_name else F.col(time)
    return rows.orderBy(first.desc() if down else first, F.desc(name) if by_name and down else F.col(name)).limit(most)


def first_of_groups(rows: DataFrame, group: str, order: list[str], most: int = 3) -> DataFrame:
    """The first `most` rows of each group with the group's size."""
    w = W.partitionBy(group).orderBy(*order)
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"))
    return rows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).join(sizes, group)
