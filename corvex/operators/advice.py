"""What is said while notes are read and written, and plans for splitting them: warnings, hints, topics, slugs, moves.

Every function is a join or an aggregation over tables of notes, words, parts, sections or lines; what is shown is
cut by ordered limits, and only that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvex.functions import text as X
from corvex.operators import overlap as O

LARGE, HINT_PARTS, HINT_NOTES, TOP_READ = 5000, 4, 2, 3
INDEX_LARGE = 2000
DUP_SHARED, DUP_COVERAGE = 2, 0.6


# ---- reading ----


def size_warnings(reads: DataFrame, notes: DataFrame, large: int = LARGE) -> DataFrame:
    """session, id, t, tokens: the first read of each large note in a session."""
    first = reads.groupBy("session", "id").agg(F.min("t").alias("t"))
    return first.join(notes.where(F.col("tokens") > large).select("id", "tokens"), "id").select("session", "id", "t", "tokens")


def index_warnings(reads: DataFrame, notes: DataFrame, index_large: int = INDEX_LARGE, large: int = LARGE) -> DataFrame:
    """session, id, t, tokens, kind: the first read in a session of each note (id, theme, tokens) that is too large. An
    index, loaded at every session, is so (kind index) above a bound of its own, and below that as other notes are (size)."""
    kind = F.when((F.col("theme") == "index") & (F.col("tokens") > index_large), "index").when(F.col("tokens") > large, "size")
    over = notes.select("id", "tokens", kind.alias("kind")).where("kind IS NOT NULL")
    first = reads.where(F.col("session").isNotNull()).groupBy("session", "id").agg(F.min("t").alias("t"))
    return first.join(over, "id").select("session", "id", "t", "tokens", "kind")


def outlines(sections: DataFrame) -> DataFrame:
    """id, outline: of each note a line for each heading, indented by its level, with the section's tokens."""
    line = F.concat(F.repeat(F.lit("  "), F.greatest(F.col("level") - 2, F.lit(0))), F.lit("- "), "title", F.lit(" ("), F.col("tokens").cast("string"), F.lit(" tokens)"))
    each = sections.where("level > 0").select("id", F.struct("pos", line.alias("line")).alias("x"))
    return each.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("outline"))


def top_read_hubs(activity: DataFrame, entries: DataFrame, most: int = TOP_READ) -> DataFrame:
    """id, uses: of the index's entries those most read and searched."""
    uses = activity.where(F.col("type").isin("read", "search")).groupBy("id").agg(F.count("*").alias("uses"))
    return uses.join(entries.select("id").distinct(), "id", "left_semi").orderBy(F.desc("uses"), "id").limit(most)


def about(notes: DataFrame, topic: str, most: int = 10) -> DataFrame:
    """id, score: notes by how many of the topic's words their label, description, id and subtheme contain."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("label", "description", "id", "subtheme") if c in notes.columns]
    text = F.lower(F.concat_ws(" ", *fields))
    score = sum((text.contains(w).cast("int") for w in topic.lower().split()), F.lit(0))
    return notes.select("id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(most)


def group_topics(members: DataFrame, words: DataFrame) -> DataFrame:
    """root, topic, notes: the word that most notes of a group have, if two have it; `members`: root, id; `words`: id,
    word, once for each note."""
    n = members.join(words, "id").groupBy("root", "word").agg(F.count("*").alias("n")).where("n >= 2")
    return n.groupBy("root").agg(F.min_by("word", F.struct(-F.col("n"), F.col("word"))).alias("topic"), F.max("n").alias("notes"))


# ---- writing ----


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def hub_parts(listed: DataFrame, declared: DataFrame, archived: DataFrame) -> DataFrame:
    """hub, part, hook: the parts that a hub lists, or of a hub that lists none those that declare it; archived notes
    are neither hubs nor parts."""
    gone = archived.select("id")
    live = lambda df: df.where("hub <> part").join(gone.withColumnRenamed("id", "hub"), "hub", "left_anti").join(gone.withColumnRenamed("id", "part"), "part", "left_anti")
    own = live(listed.select("hub", "part", "hook")).dropDuplicates(["hub", "part"])
    other = live(declared.select("hub", "part")).distinct().join(own.select("hub").distinct(), "hub", "left_anti")
    return own.unionByName(other.withColumn("hook", F.lit("")))


def hub_hints(writes: DataFrame, parts: DataFrame, notes: DataFrame, most: int = HINT_PARTS) -> DataFrame:
    """write, hub, shown, more: for a write to a hub the parts to write to instead, those first that share most words
    with what was added. `writes`: write, hub, added; `notes`: id, description, label."""
    topic = F.coalesce(F.nullif("hook", F.lit("")), F.nullif("description", F.lit("")), "label", F.lit(""))
    known = parts.join(notes.select(F.col("id").alias("part"), "description", "label"), "part", "left")
    told = writes.select("hub", F.col("write").alias("id"), O.joined(X.significant_words(F.col("added"))).alias("words"), F.lit(0).alias("least"))
    own = known.select("hub", F.col("part").cast("string").alias("other"), O.joined(X.significant_words(topic)).alias("words"))
    schema = f"hub {_type(writes, 'hub')}, id {_type(writes, 'write')}, other string, shared int"
    near = O.best(told, own, ["hub"], most, [("other", "ascending")], schema)
    each = near.select(F.col("id").alias("write"), "hub", F.struct((-F.col("shared")).alias("s"), F.col("other").alias("part")).alias("x"))
    g = each.groupBy("write", "hub").agg(F.array_sort(F.collect_list("x")).alias("xs")).join(parts.groupBy("hub").agg((F.count("*") > most).alias("more")), "hub")
    return g.select("write", "hub", F.transform(F.slice("xs", 1, most), lambda x: x["part"]).alias("shown"), "more")


def duplicate_hints(writes: DataFrame, notes: DataFrame, most: int = HINT_NOTES, shared: int = DUP_SHARED, coverage: float = DUP_COVERAGE) -> DataFrame:
    """write, id, shared: for a note being written those that it may repeat, `shared` words in common that cover so much
    of its title; most words first, then the larger note. `writes`: write, words (of the title); `notes`: id, words (of
    id, label and description), tokens. Writes and notes meet by blocks, of which each hands on a write's first ones."""
    need = F.greatest(F.lit(shared), F.ceil(F.size("words") * F.lit(coverage)).cast("int"))
    asked = writes.select(F.col("write").alias("id"), F.array_distinct("words").alias("words")).where(F.size("words") >= shared)
    a = asked.select(F.lit(0).alias("all"), "id", O.joined(F.col("words")).alias("words"), need.alias("least"))
    b = notes.where(F.size("words") > 0).select(F.lit(0).alias("all"), F.col("id").alias("other"), O.joined(F.col("words")).alias("words"), "tokens")
    schema = f"id {_type(writes, 'write')}, other {_type(notes, 'id')}, tokens {_type(notes, 'tokens')}, shared int"
    near = O.best(a, b, ["all"], most, [("tokens", "descending"), ("other", "ascending")], schema)
    w = W.partitionBy("id").orderBy(F.desc("shared"), F.desc("tokens"), "other")
    return near.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).select(F.col("id").alias("write"), F.col("other").alias("id"), "shared")


#: What a title has to look like, and folders that are the notes' root.
KEBAB_FORM, ROOTS = r"^[a-z0-9]+(?:-[a-z0-9]+)*$", ("", ".", "memory")


def slug_hints(writes: DataFrame, root: str = "memory") -> DataFrame:
    """write, title, slug, at_root for written notes whose title is no kebab slug, with the slug to take, or that stand
    in the notes' root folder (slug is null then). `writes`: write, title, directory."""
    folder = F.regexp_replace(F.trim(F.translate(F.coalesce("directory", F.lit("")), "\\", "/")), r"^(?:\./)+", "")
    folder = F.lower(F.regexp_replace(folder, "^/+|/+$", ""))
    title = F.trim("title")
    out = writes.where(title != "").select("write", title.alias("title"), folder.isin(*ROOTS, root.lower()).alias("at_root"))
    slug = F.regexp_replace(F.regexp_replace(X.permalink("title"), r"[./-]+", "-"), "^-+|-+$", "")
    bad = ~F.col("title").rlike(KEBAB_FORM)
    return out.where(bad | F.col("at_root")).select("write", "title", F.when(bad, F.coalesce(F.nullif(slug, F.lit("")), F.lit("a-kebab-slug"))).alias("slug"), "at_root")


def orphan_hints(writes: DataFrame, *reached: DataFrame) -> DataFrame:
    """Written notes that nothing leads to."""
    out = writes
    for r in reached:
        out = out.join(r.select("id"), "id", "left_anti")
    return out


# ---- splitting ----


def kebab(x: Column) -> Column:
    """Lower-case words of ASCII letters and digits joined by hyphens; part if there is none."""
    c = F.regexp_replace(F.regexp_replace(X.without_marks(F.lower(F.trim(x))), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("part"))


def under_hub(raw: Column, hub: Column) -> Column:
    """A part's name with its hub's before it, without the words at its head that the hub's name ends with (the
    longest run), or else begins with (two or more)."""
    base, hub = kebab(raw), F.lower(F.coalesce(hub, F.lit("")))
    b, h = F.split(base, "-"), F.split(hub, "-")
    lengths = F.sequence(F.lit(0), F.greatest(F.least(F.size(h), F.size(b) - 1), F.lit(0)))
    ends = F.array_max(F.filter(lengths, lambda k: F.slice(h, F.size(h) - k + 1, k) == F.slice(b, F.lit(1), k)))
    heads = F.array_max(F.filter(lengths, lambda k: F.slice(h, F.lit(1), k) == F.slice(b, F.lit(1), k)))
    cut = F.when(ends > 0, ends).when(heads >= 2, heads).otherwise(0)
    rest = F.array_join(F.slice(b, cut + 1, F.size(b)), "-")
    return F.when((hub == "") | (base == hub) | base.startswith(F.concat(hub, F.lit("-"))), base).otherwise(kebab(F.concat(hub, F.lit("-"), rest)))


def free_slugs(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """plan, pos, slug: names wanted (plan, pos, base) with the first number after them that neither an existing slug
    nor an earlier part of the plan has. Below the j-th number in use lie as many free ones as it is greater than j, so
    the r-th free number is r and one more for each number in use with fewer than r free ones below."""
    taken = existing.select(F.regexp_replace(F.lower("slug"), r"-\d+$", "").alias("base"), F.regexp_extract(F.lower("slug"), r"-(\d+)$", 1).try_cast("int").alias("k"))
    whole = existing.select(F.lower("slug").alias("base"), F.lit(1).alias("k"))
    used = taken.where("k >= 2").unionByName(whole).groupBy("base").agg(F.transform(F.array_sort(F.collect_set("k")), lambda k, j: k - j - 1).alias("below"))
    each = wanted.withColumn("r", F.row_number().over(W.partitionBy("plan", "base").orderBy("pos"))).join(used, "base", "left")
    k = F.col("r") + F.when(F.col("below").isNull(), 0).otherwise(F.size(F.filter("below", lambda n: n < F.col("r"))))
    return each.select("plan", "pos", F.when(k == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), k.cast("string"))).alias("slug"))


def check_moves(sections: DataFrame, wanted: DataFrame) -> DataFrame:
    """note, slug, heading, found, overlaps, start, end: whether each wanted heading is in its note exactly once, and
    how many other wanted sections it overlaps. `sections`: note, title, start, end (lines, the end of a section
    being that of its last subsection); `wanted`: note, slug, heading."""
    met = wanted.join(sections.select("note", F.col("title").alias("heading"), "start", "end"), ["note", "heading"], "left")
    each = met.groupBy("note", "slug", "heading").agg(F.count("start").alias("found"), F.min("start").alias("start"), F.min("end").alias("end"))
    a, b = each.alias("a"), each.where("found = 1").alias("b")
    cross = (F.col("a.note") == F.col("b.note")) & (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end"))
    other = (F.col("a.slug") != F.col("b.slug")) | (F.col("a.heading") != F.col("b.heading"))
    hits = a.where("found = 1").join(b, cross & other).groupBy(*[F.col(f"a.{c}").alias(c) for c in ("note", "slug", "heading")]).agg(F.count("*").alias("overlaps"))
    return each.join(hits, ["note", "slug", "heading"], "left").select("note", "slug", "heading", "found", F.coalesce("overlaps", F.lit(0)).alias("overlaps"), "start", "end")


def move_sections(lines: DataFrame, moves: DataFrame) -> DataFrame:
    """note, slug, n, line: each line of a note goes to the part whose section it is in, or stays (slug null). `moves`:
    note, slug, start, end, without overlaps. Every line comes out once, so nothing is lost."""
    at = F.explode(F.sequence("start", F.col("end") - 1))
    return lines.join(moves.where("end > start").select("note", "slug", at.alias("n")), ["note", "n"], "left").select("note", "slug", "n", "line")


def move_by_index(sections: DataFrame, chosen: DataFrame) -> DataFrame:
    """Moves of sections by their numbers within the note (note, slug, index), from 0, for notes in which a heading
    comes twice."""
    w = W.partitionBy("note").orderBy("start")
    numbered = sections.withColumn("index", F.row_number().over(w) - 1)
    return numbered.join(chosen.distinct(), ["note", "index"]).select("note", "slug", "start", "end")
