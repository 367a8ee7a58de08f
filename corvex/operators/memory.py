"""Hubs a note declares, hubs a place belongs to, the core text under a budget, zones, archives and diffs."""

from __future__ import annotations

import difflib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvex.functions import dates as D
from corvex.functions import text as X

from . import lifecycle as L

HEADER_LINES = 5
#: What the words before a link in a header line say: how they begin, and how they end (if that matters).
HUB_LEADS = ((("split", "on"), ("from",)), (("part", "of"), ()), (("summary",), None), (("up",), None))
#: Words of a line that only names other notes.
SIBLING_WORDS = ("sibling", "siblings", "see", "also", "related", "note", "notes", "and")


def _inside_link(text: Column) -> Column:
    """The target of the first [[target|label]] or [[target#part]] in a text; empty if there is none."""
    inner = F.substring_index(F.substring_index(text, "]]", 1), "[[", -1)
    return F.when(text.contains("[["), F.trim(F.substring_index(F.substring_index(inner, "|", 1), "#", 1))).otherwise("")


def declared_hub(front_matter: Column, body: Column) -> Column:
    """The hub in front matter (part_of, then parent), else in the first of the first non-empty lines that has a link
    after "Split on … from", "Part of …", "Summary:" or "Up:"."""
    raw = F.trim(F.coalesce(F.get_json_object(front_matter, "$.part_of"), F.get_json_object(front_matter, "$.parent")))
    named = F.when(raw.startswith("[["), _inside_link(raw)).otherwise(raw)
    lines = F.slice(F.filter(F.split(body, r"\r?\n"), lambda x: F.trim(x) != ""), 1, HEADER_LINES)

    def read(line: Column) -> Column:
        before = F.substring_index(line, "[[", 1)
        return F.struct(F.regexp_extract_all(F.lower(before), F.lit(r"([a-z]+)"), 1).alias("words"), F.lower(before).alias("before"), _inside_link(line).alias("to"))

    def says(begin: tuple, end: tuple | None):
        def test(x: Column) -> Column:
            w = x["words"]
            starts = (F.slice(w, 1, len(begin)) == F.array(*map(F.lit, begin))) & F.regexp_replace(x["before"], r"^[ \t>*_]+", "").startswith(begin[0])
            return starts & (x["to"] != "") & (F.size(w) == len(begin) if end is None else (F.element_at(w, -1) == end[0]) if end else F.lit(True))

        return test

    marked = [says(*lead) for lead in HUB_LEADS]
    first = F.get(F.filter(F.transform(lines, read), lambda x: marked[0](x) | marked[1](x) | marked[2](x) | marked[3](x)), F.lit(0))["to"]
    return F.coalesce(F.nullif(named, F.lit("")), first)


def pure_sibling_line(line: Column) -> Column:
    """Whether a line is nothing but links and words like "see also": what stands between links has no other
    letters or digits, but for the number of a list entry."""
    between = F.array_join(F.transform(F.split(line, r"\[\["), lambda x: F.element_at(F.split(x, r"\]\]"), -1)), " ")
    rest = F.filter(F.regexp_extract_all(F.lower(between), F.lit(r"([\p{L}\p{N}]+)"), 1), lambda w: ~w.isin(*SIBLING_WORDS))
    numbered = (F.size(rest) == 1) & F.element_at(F.split(F.trim(line), r"[.)]"), 1).rlike(r"^\d{1,3}$")
    return line.contains("[[") & ((F.size(rest) == 0) | numbered)


def match_hub(hubs: DataFrame, place: str, globs: list[tuple[str, str]], least: int = 2) -> DataFrame:
    """The hub of a place (a path): by the first glob that matches, else the hub whose front matter names a
    project that is a segment of it, else the one with strictly most words in common (`least`, or one that is
    a whole segment). `hubs`: id, project, title. At most one row: id, tier."""
    for pattern, hub in globs:
        if re.search(X.wildcard(pattern), place):
            return hubs.where(F.col("id") == hub).select("id", F.lit("map").alias("tier"))
    segments = [s for s in X.fold_text(place).replace("\\", "/").split("/") if s]
    words = sorted(set(X.words_of(place)) - X.STOP_WORDS)
    lit = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
    named = F.coalesce(X.fold("project").isin(segments), F.lit(False)) if segments else F.lit(False)
    shared = F.size(F.array_intersect(F.array_distinct(X.words("title")), lit(words)))
    exact = X.slugify("title").isin(segments) if segments else F.lit(False)
    scored = hubs.select("id", F.when(named, 2).when((shared >= least) | exact, 1).otherwise(0).alias("tier"), (shared + F.when(exact, 1000).otherwise(0)).alias("score")).where("tier > 0")
    best = scored.withColumn("r", F.dense_rank().over(W.orderBy(F.desc("tier"), F.when(F.col("tier") == 2, 0).otherwise(-F.col("score"))))).where("r = 1")  # hubs of one knowledge base
    alone = best.withColumn("n", F.count("*").over(W.partitionBy("r"))).where("n = 1")
    return alone.select("id", F.when(F.col("tier") == 2, "front matter").otherwise("words").alias("tier"))


def core(entries: DataFrame, hubs: DataFrame, hub_text: str, budget: int) -> DataFrame:
    """One row, text: the index's groups in a line each, then the matched hub, cut to the budget."""
    level = L.index_level(entries, hubs)
    line = F.concat(F.coalesce(F.concat("group", F.lit(": ")), F.lit("")), F.array_join("shown", ", "), F.when(F.col("more") > 0, F.concat(F.lit(" +"), "more", F.lit(" more"))).otherwise(""))
    whole = level.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("group_no", line.alias("l")))), lambda x: x["l"]), "\n").alias("t"))
    return whole.select(L.budget(F.concat("t", F.lit("\n\n" + hub_text)), budget).alias("text"))


def zone_violations(before: DataFrame, after: DataFrame, protected: list[str]) -> DataFrame:
    """id, why: notes that a change would move into, out of, add to or take from protected themes."""
    both = before.select("id", F.col("theme").alias("old")).join(after.select("id", F.col("theme").alias("new")), "id", "full")
    inside = lambda c: F.coalesce(F.lower(c).isin([p.lower() for p in protected]), F.lit(False))
    why = F.when(F.col("old").isNull() & inside("new"), "added").when(F.col("new").isNull() & inside("old"), "removed").when(F.lower("old") != F.lower("new"), F.when(inside("old"), "moved out").when(inside("new"), "moved in"))
    return both.select("id", why.alias("why")).where("why IS NOT NULL")


def theme_of(rel: Column, declared: Column, prefixes: dict[str, str], index: Column, default: str | None = None) -> Column:
    """index, the declared theme, that of the longest folder prefix, the default, or other."""
    out = F.when(index, "index").when(F.trim(F.coalesce(declared, F.lit(""))) != "", F.lower(F.trim(declared)))
    for p in sorted(prefixes, key=len, reverse=True):
        out = out.when(rel.startswith(p.rstrip("/") + "/"), prefixes[p])
    return out.otherwise(F.lit(default or "other"))


def old_sections(sections: DataFrame, cutoff: Column, anchor_ms: Column, least: int = 400, share: float = 0.7) -> DataFrame:
    """id, old_tokens of notes whose sections of the top level dated before `cutoff` hold `least` tokens or
    more, but no more than `share` of the note."""
    s = sections.withColumn("date", D.heading_date(F.col("title"))).withColumn("a", anchor_ms)
    g = s.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "date", "level", "tokens"))).alias("s"), F.max("a").alias("a"), F.sum("tokens").alias("all"))
    g = g.withColumn("top", F.array_min(F.transform(F.filter("s", lambda x: x["level"] > 0), lambda x: x["level"])))
    dated = F.filter("s", lambda x: x["date"].isNotNull() & (x["level"] == F.col("top")))
    g = g.withColumn("d", dated).withColumn("ts", D.infer_years(F.transform("d", lambda x: x["date"]), F.col("a")))
    old = F.aggregate(F.zip_with("d", "ts", lambda x, t: F.when(t < F.unix_millis(cutoff.cast("timestamp")), x["tokens"]).otherwise(0).cast("bigint")), F.lit(0).cast("bigint"), lambda x, y: x + y)
    return g.select("id", old.alias("old_tokens"), "all").where((F.col("old_tokens") >= least) & (F.col("old_tokens") <= share * F.col("all"))).select("id", "old_tokens")




def summary_lines(archived: DataFrame, date: str) -> DataFrame:
    """A line of the archive's summary for each archived section (note, title, tokens, archive)."""
    line = F.concat(F.lit(f"- {date} — "), "title", F.lit(" — from [["), "note", F.lit("]] — in [["), "archive", F.lit("]] ("), F.col("tokens").cast("string"), F.lit(" tokens)"))
    return archived.select("note", line.alias("line"))


SUMMARY = r"^- (\d{4}-\d{2}-\d{2}) — (.*) — from \[\[([^\]]+)\]\] — in \[\[([^\]]+)\]\] \((\d+) tokens\)$"


def parse_summary(lines: DataFrame) -> DataFrame:
    """date, title, note, archive, tokens of summary lines; other lines are left out."""
    part = lambda g: F.regexp_extract("line", SUMMARY, g)
    return lines.where(F.col("line").rlike(SUMMARY)).select(part(1).cast("date").alias("date"), part(2).alias("title"), part(3).alias("note"), part(4).alias("archive"), part(5).cast("bigint").alias("tokens"))


def archive_lookup(entries: DataFrame, words: list[str], most: int = 20) -> DataFrame:
    """Entries by how many of the words their titles contain, newest first among equals."""
    score = sum((F.when(X.fold("title").contains(X.fold_text(w)), 1).otherwise(0) for w in words), F.lit(0))
    return entries.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), F.desc("date"), "title").limit(most)


def tolerant_json(text: Column, schema: str) -> Column:
    """The first JSON object or array in a text that may have prose or fences around it; null if none parses."""
    inner = F.regexp_extract(text, r"(?s)```(?:json)?\s*([\[{].*?[\]}])\s*```", 1)
    bare = F.regexp_extract(text, r"(?s)([\[{].*[\]}])", 1)
    return F.coalesce(F.from_json(F.nullif(inner, F.lit("")), schema), F.from_json(F.nullif(bare, F.lit("")), schema))


def stable_share(a: Column, b: Column) -> Column:
    """The share of `b` that its common prefix with `a` makes up: the prefix by halving, 31 comparisons of prefixes."""
    n = F.least(F.length(a), F.length(b))

    def step(at: Column, bit: Column) -> Column:
        longer = at + bit
        return F.when((longer <= n) & (F.substring(a, 1, longer) == F.substring(b, 1, longer)), longer).otherwise(at)

    same = F.aggregate(F.array(*[F.lit(1 << k).cast("long") for k in range(30, -1, -1)]), F.lit(0).cast("long"), step)
    return F.when(F.length(b) > 0, same / F.length(b)).otherwise(F.lit(1.0))


def line_diffs(pairs: DataFrame, context: int = 3) -> DataFrame:
    """id, diff from id, before, after: unified line diffs."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "diff": ["\n".join(difflib.unified_diff((a or "").split("\n"), (b or "").split("\n"), lineterm="", n=context)) for a, b in zip(f["before"], f["after"])]})

    from pyspark.sql import types as T

    return pairs.select("id", "before", "after").mapInPandas(run, T.StructType([pairs.schema["id"], T.StructField("diff", T.StringType())]))


def dump_front_matter(meta: dict) -> str:
    """Front matter as YAML in flow style, which front_matter reads back."""
    return "---\n" + "".join(f"{k}: {json.dumps(v, ensure_ascii=False)}\n" for k, v in meta.items()) + "---\n"


def health(notes: DataFrame, edges: DataFrame, reads: DataFrame, large: int = 5000) -> DataFrame:
    """One row: notes, tokens, large notes, notes without links and without reads."""
    linked = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct().withColumn("l", F.lit(1))
    read = reads.select("id").distinct().withColumn("r", F.lit(1))
    n = notes.join(linked, "id", "left").join(read, "id", "left")
    return n.agg(F.count("*").alias("notes"), F.sum("tokens").alias("tokens"), F.count_if(F.col("tokens") > large).alias("large"), F.count_if(F.col("l").isNull()).alias("unlinked"), F.count_if(F.col("r").isNull()).alias("unread"))
