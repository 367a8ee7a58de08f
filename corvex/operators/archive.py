"""Moving sections that nobody uses to an archive note of their theme, as one checked plan.

A unit is a heading of a note's top level with all below it, up to the next of that level. A plan names units by key;
each is moved word for word to the archive note of its theme, a line with a link stays in its place, and a summary has
a line for every archived section. Units, entries and the notes that stay are found within a note's own row; only picks
meet notes and entries meet archives in a shuffle. A plan with any error changes nothing.

Null texts have no units; a null theme or path counts as empty. A text is one row: finding its units is linear in its
lines and quadratic in its headings and fences alone. An archive note is one text, so a plan that would make one larger
than `most_bytes` is an error; the summary, which grows with all archives, is given as lines with their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvex.functions import text as X

from . import graph as G

PICKS = "note string, key string"
TOOL, FOLDER, SUMMARY_NOTE = "corvex", "archive", "archive-summary"
DAYS, LEAST, SHOWN = 105, 100, 20
MOST_BYTES = 64 << 20
NO_THEME = ("", "index", "other")
UNTITLED = "(untitled section)"
STUB = r"^Archived: .* → \[\[[^\]\n]+\]\] \(\d{4}-\d{2}-\d{2}\)$"
LINE = r"^- (\d{4}-\d{2}-\d{2}) · (.+) · from \[\[([^\]|#\n]+)\]\] → \[\[([^\]|#\n]+?)(?:#([^\]\n]+))?\]\] · ≈ ([\d,]+) tokens$"
MARK = r"^ {0,3}(`{3,}|~{3,})"
HEAD = r"^(#{2,6})[ \t]+\S"


def marker(tool: str) -> str:
    return rf'^<!-- {tool}:archived from="([A-Za-z0-9][A-Za-z0-9._-]*)" date="(\d{{4}}-\d{{2}}-\d{{2}})" -->$'


def _joined(lines: Column, start: Column, end: Column) -> Column:
    """The text of lines start to end - 1, with the break that ends them if more lines follow."""
    text = F.array_join(F.slice(lines, start + 1, F.greatest(end - start, F.lit(0))), "\n")
    return F.when(end <= start, F.lit("")).otherwise(F.concat(text, F.when(end < F.size(lines), F.lit("\n")).otherwise("")))


def _body_start(lines: Column) -> Column:
    """The line behind the front matter: 0 if there is none."""
    close = F.array_position(F.transform(F.slice(lines, F.lit(2), F.size(lines)), lambda x: F.rtrim(F.regexp_replace(x, r"\r$", "")) == "---"), True)
    return F.when((F.regexp_replace(F.element_at(lines, 1), r"\s+$", "") == "---") & (close > 0), close.cast("int") + 1).otherwise(0)


def _headings(lines: Column, begin: Column) -> Column:
    """n, level of the ## to ###### headings outside fences. A fence closes by its own sign, as often or more, alone."""
    seen = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("n"), x.alias("x"))), lambda m: (m["n"] >= begin) & (m["x"].rlike(MARK) | m["x"].rlike(HEAD)))
    sign = F.transform(seen, lambda m: F.struct(m["n"].alias("n"), F.regexp_extract(m["x"], MARK, 1).alias("mark"), F.length(F.regexp_extract(m["x"], HEAD, 1)).alias("level"), (F.trim(F.regexp_replace(F.regexp_replace(m["x"], MARK, ""), r"\r$", "")) == "").alias("bare")))

    def step(acc, m):
        opened = acc["open"]
        closes = (opened != "") & (F.substring(m["mark"], 1, 1) == F.substring(opened, 1, 1)) & (F.length(m["mark"]) >= F.length(opened)) & m["bare"]
        now = F.when(m["mark"] == "", opened).when(closes, "").when(opened == "", m["mark"]).otherwise(opened)
        found = F.when((opened == "") & (m["mark"] == ""), F.array(F.struct(m["n"].alias("n"), m["level"].alias("level")))).otherwise(F.array().cast("array<struct<n:int,level:int>>"))
        return F.struct(now.alias("open"), F.concat(acc["out"], found).alias("out"))

    start = F.struct(F.lit("").alias("open"), F.array().cast("array<struct<n:int,level:int>>").alias("out"))
    return F.aggregate(sign, start, step)["out"]


def title(line: Column) -> Column:
    """The text of a heading line, without its signs."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(line, r"\r$", ""), r"^#{1,6}[ \t]+", ""), r"[ \t]+#*[ \t]*$", ""))


def anchor(line: Column) -> Column:
    """The heading as the anchor of a link; empty if it holds signs of links or looks like a secret."""
    t = title(line)
    return F.when((t == "") | t.rlike(r"[\[\]|#^]") | X.looks_secret(line), F.lit("")).otherwise(t)


def key(note: Column, text: Column) -> Column:
    """Names a unit by its note and exact text: an edit makes another key."""
    return F.substring(F.sha1(F.concat(F.encode(note, "utf-8"), F.lit(b"\x00"), F.encode(text, "utf-8"))), 1, 16)


def sighting(text: Column) -> Column:
    """Names a unit's text in the log of sightings: lines left by archived neighbours and blanks at the end don't count."""
    kept = F.filter(F.split(text, "\n"), lambda x: ~x.rlike(STUB))
    return F.substring(F.sha1(F.regexp_replace(F.array_join(kept, "\n"), r"\s+$", "").cast("binary")), 1, 16)


def units(notes: DataFrame) -> DataFrame:
    """note, start, end, line, level, text, tokens, key, hash of the archivable units of notes (id, text)."""
    c = F.col
    rows = notes.select(c("id").alias("note"), F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    rows = rows.withColumn("hs", _headings(c("lines"), _body_start(c("lines"))))
    top = rows.withColumn("level", F.array_min(F.transform("hs", lambda h: h["level"])))
    top = top.withColumn("at", F.transform(F.filter("hs", lambda h: h["level"] == c("level")), lambda h: h["n"]))
    ends = F.concat(F.slice("at", F.lit(2), F.size("at")), F.array(F.size("lines")))
    each = top.where(F.size("at") > 0).select("note", "lines", "level", F.explode(F.arrays_zip(c("at").alias("start"), ends.alias("end"))).alias("u"))
    each = each.select("note", c("u.start").alias("start"), c("u.end").alias("end"), F.element_at("lines", c("u.start") + 1).alias("line"), "level", _joined(c("lines"), c("u.start"), c("u.end")).alias("text"))
    return each.select("*", X.tokens("text").alias("tokens"), key(c("note"), c("text")).alias("key"), sighting(c("text")).alias("hash"))


def dormant(notes: DataFrame, last: DataFrame, log: DataFrame, started: Column, log_started: Column, today: Column, days: int = DAYS, least: int = LEAST, folder: str = FOLDER, most: int | None = SHOWN) -> DataFrame:
    """note, key, title, tokens, basis of the units that nobody used for `days` days, largest first; none before activity
    was counted for as long. Notes (id, text, theme, path, mtime_ms) without a theme or in the archive have none, nor have
    those read or found since (`last`: id, type, last_day). A unit counts as unchanged if the log (note, hash, first_day)
    saw this text by then, where the log is as old and knows the note, else if the note was neither written nor changed."""
    c = F.col
    cutoff = F.date_sub(today, days)
    recent = last.where(c("last_day") > cutoff).groupBy(c("id").alias("note")).agg(F.bool_or(c("type").isin("read", "search")).alias("used"), F.bool_or(c("type") == "write").alias("written"))
    known = log.where(log_started <= cutoff).select("note", F.lit(True).alias("known")).distinct()
    quiet = notes.where(~F.coalesce("theme", F.lit("")).isin(*NO_THEME) & ~F.coalesce("path", F.lit("")).startswith(f"{folder}/") & (started <= cutoff))
    quiet = quiet.select(c("id").alias("note"), "text", F.coalesce(F.to_date(F.timestamp_millis("mtime_ms")) > cutoff, F.lit(False)).alias("changed"))
    quiet = quiet.join(recent, "note", "left").join(known, "note", "left").where("used IS NULL OR NOT used").withColumn("known", F.coalesce("known", F.lit(False)))
    quiet = quiet.where(c("known") | ~(c("changed") | F.coalesce("written", F.lit(False))))
    found = units(quiet.select(c("note").alias("id"), "text")).where(c("tokens") >= least).join(quiet.select("note", "known"), "note")
    seen = log.groupBy("note", "hash").agg(F.min("first_day").alias("first_day"))
    found = found.join(seen, ["note", "hash"], "left").where(~c("known") | (c("first_day") <= cutoff))
    hidden = F.when(X.looks_secret(c("line")), F.lit("[title hidden: looks like a secret]")).otherwise(title(c("line")))
    out = found.select("note", "key", hidden.alias("title"), "tokens", F.when(c("known"), "section").otherwise("note").alias("basis")).orderBy(F.desc("tokens"), "note", "key")
    return out.limit(most) if most is not None else out


def entries(archives: DataFrame, tool: str = TOOL) -> DataFrame:
    """archive, pos, date, note, title, anchor, tokens of the sections in archive notes (id, text), from marker to marker."""
    c = F.col
    rows = archives.select(c("id").alias("archive"), F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    marks = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("n"), x.alias("x"))), lambda m: m["x"].rlike(marker(tool)))
    rows = rows.withColumn("ms", marks).where(F.size("ms") > 0)
    ends = F.concat(F.transform(F.slice("ms", F.lit(2), F.size("ms")), lambda m: m["n"]), F.array(F.size("lines")))
    each = rows.select("archive", "lines", F.posexplode(F.arrays_zip(c("ms").alias("m"), ends.alias("end"))).alias("pos", "e"))
    first = F.coalesce(F.get("lines", c("e.m.n") + 1), F.lit(""))
    head = F.when(first.rlike(r"^#{1,6}[ \t]+"), first).otherwise("")
    chunk = F.concat(F.regexp_replace(_joined(c("lines"), c("e.m.n") + 1, c("e.end")), r"\s+$", ""), F.lit("\n"))
    part = lambda g: F.regexp_extract(c("e.m.x"), marker(tool), g)
    return each.select("archive", "pos", part(2).alias("date"), part(1).alias("note"), title(head).alias("title"), anchor(head).alias("anchor"), X.tokens(chunk).alias("tokens"))


def summary(found: DataFrame) -> DataFrame:
    """date, archive, pos, line of entries; sorted by the first three falling, they are the summary, newest first."""
    name = F.coalesce(F.nullif(F.trim(F.regexp_replace("title", r"\s+", " ")), F.lit("")), F.lit(UNTITLED))
    link = F.concat(F.lit("[["), "archive", F.when(F.col("anchor") != "", F.concat(F.lit("#"), "anchor")).otherwise(""), F.lit("]]"))
    return found.select("date", "archive", "pos", F.concat(F.lit("- "), "date", F.lit(" · "), name, F.lit(" · from [["), "note", F.lit("]] → "), link, F.lit(" · ≈ "), F.format_number("tokens", 0), F.lit(" tokens")).alias("line"))


def parse_summary(lines: DataFrame) -> DataFrame:
    """date, title, note, archive, anchor, tokens of the summary's lines (line); others are left out."""
    part = lambda g: F.regexp_extract(F.trim("line"), LINE, g)
    return lines.where(F.trim("line").rlike(LINE)).select(part(1).alias("date"), part(2).alias("title"), F.trim(part(3)).alias("note"), F.trim(part(4)).alias("archive"), F.trim(part(5)).alias("anchor"), F.regexp_replace(part(6), ",", "").cast("bigint").alias("tokens"))


def match(found: DataFrame, query: str, most: int = 10) -> DataFrame:
    """Entries by how many of the query's words of two letters or more their title or notes hold, then newest."""
    hay = F.lower(F.concat_ws(" ", "title", "note", "archive", F.regexp_replace("note", r"[-_.]", " ")))
    words = F.filter(F.split(F.lower(F.lit(query)), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 2)
    score = F.size(F.filter(words, lambda w: hay.contains(w)))
    return found.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), F.desc("date"), "archive", "title").limit(most)


def _front(text: Column) -> Column:
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.transform(F.slice(lines, F.lit(1), _body_start(lines)), lambda x: F.trim(F.regexp_replace(x, r"\r$", "")))


def _declared(text: Column) -> Column:
    """The theme in a text's front matter."""
    own = F.filter(_front(text), lambda x: x.startswith("theme:"))
    return F.regexp_replace(F.trim(F.substring(F.get(own, F.lit(0)), 7, 1 << 20)), r"^[\"']|[\"']$", "")


def _times(text: Column, part: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)


class Archive:
    """errors: note, key, error. moved: note, theme, archive, start, end, line, text, stub, entry. files: id, path, role
    (origin or archive), text. summary: as `summary`, of all archives after the plan. unproved: id, error of files that
    fail the proof; always empty, and checked."""

    def __init__(self, notes: DataFrame, picks: DataFrame, date: str, labels: DataFrame | None = None, tool: str = TOOL, folder: str = FOLDER, note: str = SUMMARY_NOTE, most_bytes: int = MOST_BYTES):
        c, lit = F.col, F.lit
        self.tool, self.flag = tool, f"{tool}_archive: true"
        notes = notes.select("id", "text", F.coalesce("theme", lit("")).alias("theme"), F.coalesce("path", lit("")).alias("path"))
        asked = G.cut(picks.groupBy("note", "key").agg(F.count("*").alias("asks")))
        theirs = notes.join(asked.select(c("note").alias("id")).distinct(), "id", "left_semi")
        err = lambda df, text, k="key": df.select("note", c(k).alias("key") if k else lit(None).cast("string").alias("key"), text.alias("error"))
        theme = notes.select(c("id").alias("note"), "theme", "path")
        placed = asked.join(theme, "note", "left")
        found = units(theirs).join(asked.select("note", "key"), ["note", "key"], "left_semi")
        # equal sections of a note have one key: the first is meant
        found = found.groupBy("note", "key").agg(F.min_by(F.struct("start", "end", "line", "text"), "start").alias("u")).select("note", "key", "u.*")
        about = F.concat(c("theme"), lit("-archive"))
        where = F.concat(lit(f"{folder}/"), "archive", lit(".md"))
        stub = F.concat(lit("Archived: "), F.coalesce(F.nullif(title(c("line")), lit("")), lit(UNTITLED)), lit(" → [["), "archive", F.when(anchor(c("line")) != "", F.concat(lit("#"), anchor(c("line")))).otherwise(""), lit(f"]] ({date})"))
        ending = F.concat(F.when(c("text").endswith("\n"), "\n").otherwise(""), F.when(c("text").endswith("\n\n"), "\n").otherwise(""))
        entry = F.concat(lit(f'<!-- {tool}:archived from="'), "note", lit(f'" date="{date}" -->\n'), F.regexp_replace("text", r"(\r?\n)+$", ""), lit("\n"))
        moved = found.join(theme, "note").withColumn("archive", about)
        moved = G.cut(moved.select("note", "key", "theme", "archive", "start", "end", "line", anchor(c("line")).alias("anchor"), "text", F.concat(stub, ending).alias("stub"), entry.alias("entry")))
        targets = moved.groupBy("archive").agg(F.max("theme").alias("theme"), F.sum(F.octet_length("entry") + 1).alias("more"))
        same = targets.join(notes.select(F.lower("id").alias("low"), c("id").alias("has"), c("path").alias("has_path"), "text"), F.lower("archive") == c("low"), "left")
        same = G.cut(same.withColumn("at", where).withColumn("own", c("has_path") == c("at")))
        heads = same.where("own").select("archive", F.split("text", "\n").alias("ls"))
        heads = heads.select("archive", F.explode(F.transform(_headings(c("ls"), _body_start(c("ls"))), lambda h: F.lower(title(F.element_at("ls", h["n"] + 1))))).alias("h")).distinct()
        named = moved.where("anchor <> ''").select("note", "key", "archive", F.lower("anchor").alias("h"))
        repeated = named.groupBy("archive", "h").agg(F.count("*").alias("k")).where("k > 1").select("archive", "h").union(heads).distinct()
        clash = notes.where((F.lower("id") == note.lower()) & ((c("path") != f"{folder}/{note}.md") | ~F.array_contains(_front(c("text")), f"{tool}_archive_summary: true")))
        at = lambda df, text: df.select(c("archive").alias("note"), lit(None).cast("string").alias("key"), text.alias("error"))
        errors = [
            err(asked.where("asks > 1"), lit("chosen twice")), err(placed.where("path IS NULL"), lit("no such note")),
            err(placed.where(c("theme").isin(*NO_THEME)), lit("the note has no theme of its own")), err(placed.where(c("path").startswith(f"{folder}/")), lit("the note is in the archive")),
            err(placed.where("path IS NOT NULL").join(moved.select("note", "key"), ["note", "key"], "left_anti"), lit("changed since it was listed")),
            at(same.where("NOT own"), F.concat(lit("another note has the archive's name: "), "has_path")),
            at(same.where(c("own") & ~F.array_contains(_front(c("text")), self.flag)), lit("is no archive note")),
            at(same.where(c("own") & ~F.coalesce(_declared(c("text")) == c("theme"), lit(False))), F.concat(lit("belongs to another theme than "), "theme")),
            at(same.where(c("more") + F.coalesce(F.octet_length("text"), lit(0)) > most_bytes), lit(f"would be larger than {most_bytes} bytes")),
            err(named.join(repeated, ["archive", "h"], "left_semi"), lit("a section of this title is in the archive: rename one of them first")),
            clash.select(c("id").alias("note"), lit(None).cast("string").alias("key"), lit("stands where the summary belongs").alias("error")),
        ]
        out = errors[0]
        for e in errors[1:]:
            out = out.unionByName(e)
        self.errors = G.cut(out.distinct())
        done = self.errors.isEmpty()
        self.moved = moved if done else moved.limit(0)
        before = theirs.join(self.moved.select(c("note").alias("id")).distinct(), "id", "left_semi")
        origins = self._origins(before)
        same = same if done else same.limit(0)
        if labels is not None:
            same = same.join(labels.select(c("id").alias("theme"), "label"), "theme", "left")
        else:
            same = same.withColumn("label", lit(None).cast("string"))
        said = F.coalesce("label", "theme")
        quoted = lambda x: F.regexp_extract(F.to_json(F.struct(x.alias("x"))), r'^\{"x":(.*)\}$', 1)
        header = F.concat(
            lit("---\ntitle: "), quoted(F.concat(said, lit(" — archive"))), lit("\ntheme: "), "theme", lit(f"\nsubtheme: archive\n{self.flag}\ndescription: "),
            quoted(F.concat(lit("Sections moved out of the notes of "), said, lit(", word for word."))), lit(f"\n---\n\nEach section follows a marker that names its note, which keeps a link to it. One line each in [[{note}]].\n"))
        put = self.moved.groupBy("archive").agg(F.transform(F.array_sort(F.collect_list(F.struct("note", "start", "entry"))), lambda x: x["entry"]).alias("entries"))
        old = F.when(c("own"), c("text")).otherwise(header)
        grown = same.join(put, "archive").withColumn("old", old)
        grown = grown.select("archive", "at", "theme", "old", "entries", F.concat("old", F.when(c("old").endswith("\n"), "").otherwise("\n"), F.array_join(F.transform("entries", lambda e: F.concat(lit("\n"), e)), "")).alias("text"))
        self.files = origins.select("id", "path", lit("origin").alias("role"), "text").unionByName(grown.select(c("archive").alias("id"), c("at").alias("path"), lit("archive").alias("role"), "text"))
        wrong = grown.where(~c("text").startswith(c("old")) | F.exists("entries", lambda e: _times(c("text"), e) != 1) | ~F.coalesce(_declared(c("text")) == c("theme"), lit(False)))
        self.unproved = self._unlike(before, origins).unionByName(wrong.select(c("archive").alias("id"), lit("a section isn't there once, word for word, behind all that was there").alias("error")))
        others = notes.where(c("path").startswith(f"{folder}/") & F.array_contains(_front(c("text")), self.flag)).join(grown.select(c("archive").alias("id")), "id", "left_anti")
        self.summary = summary(entries(others.select("id", "text").unionByName(grown.select(c("archive").alias("id"), "text")), tool))

    def _origins(self, before: DataFrame) -> DataFrame:
        """id, path, text, moves: the notes with a link in the place of each section that goes."""
        gone = self.moved.groupBy(F.col("note").alias("id")).agg(F.array_sort(F.collect_list(F.struct("start", "end", "stub", "text"))).alias("moves"))
        rows = before.select("id", "path", F.split("text", "\n").alias("lines")).join(gone, "id")
        stays = F.concat(F.array(F.lit(0)), F.transform("moves", lambda m: m["end"]))
        pieces = F.transform("moves", lambda m, i: F.concat(_joined(F.col("lines"), F.get(stays, i), m["start"]), m["stub"]))
        return rows.select("id", "path", "moves", F.concat(F.array_join(pieces, ""), _joined(F.col("lines"), F.element_at(stays, -1), F.size("lines"))).alias("text"))

    def _unlike(self, before: DataFrame, origins: DataFrame) -> DataFrame:
        """Notes that don't come back, character by character, when each link is replaced by what it stands for."""
        def back(text, m):
            at = F.instr(text, m["stub"])
            return F.when(_times(text, m["stub"]) == 1, F.concat(F.substr(text, F.lit(1), at - 1), m["text"], F.substr(text, at + F.length(m["stub"]))))

        again = origins.select("id", F.aggregate("moves", F.col("text"), back).alias("again"))
        pairs = before.select("id", F.col("text").alias("was")).join(again, "id").where(~F.col("was").eqNullSafe(F.col("again")))
        return pairs.select("id", F.lit("the note can't be rebuilt from what stays and what was moved").alias("error"))


def archive(notes: DataFrame, picks: DataFrame, date: str, **options) -> Archive:
    """The plan that moves the picked units (note, key) of notes (id, text, theme, path) on a day (ISO); raises ValueError
    if a file of it fails the proof."""
    plan = Archive(notes, picks, date, **options)
    bad = plan.unproved.first()
    if bad is not None:
        raise ValueError(f"{bad['id']}: {bad['error']}")
    return plan
