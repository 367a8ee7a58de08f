"""Event files: JSON lines, arrays and wrapped arrays, with an explicit schema and broken lines kept apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EVENT = "type string, ids array<string>, source string, t bigint, machine string, channel string, _corrupt string"
TYPES = ("read", "search", "write")
MOST_IDS, SESSION_GAP_MS = 50, 1_800_000
#: Schemas of the state that a knowledge base keeps in JSON beside its notes.
STATE = {
    "counters": "days map<string,struct<notes:map<string,struct<read:bigint,search:bigint,write:bigint>>>>",
    "aliases": "entries array<struct<word:string,note:string,count:bigint,last:bigint>>",
    "log": "t bigint, kind string, detail string",
}


def read_counters(spark: SparkSession, path: str) -> DataFrame:
    """day, id, read, search, write of a counters file."""
    raw = spark.read.schema(STATE["counters"]).option("multiLine", True).json(path)
    days = raw.select(F.explode("days").alias("day", "d")).select(F.col("day").cast("date").alias("day"), F.explode("d.notes").alias("id", "c"))
    return days.select("day", "id", *[F.coalesce(f"c.{t}", F.lit(0).cast("bigint")).alias(t) for t in TYPES])


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """word, note, count, last of an aliases file."""
    return spark.read.schema(STATE["aliases"]).option("multiLine", True).json(path).select(F.inline("entries"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """t, kind, detail of an event log, lines or an array."""
    return spark.read.schema(STATE["log"]).json(path).where("t IS NOT NULL")


def calls_of(events: DataFrame, gap_ms: int = SESSION_GAP_MS) -> DataFrame:
    """session, type, id, t, source from events of other tools (type, ids, source, t): one call for each id, in
    sessions of a source that end after a gap; events of other types are left out."""
    each = events.where(F.col("type").isin(*TYPES)).select("type", "source", "t", F.explode_outer("ids").alias("id"))
    w = W.partitionBy("source").orderBy("t", "type", "id")
    new = F.coalesce(F.col("t") - F.lag("t").over(w) > gap_ms, F.lit(True))
    numbered = each.withColumn("n", F.sum(new.cast("int")).over(w))
    return numbered.select(F.concat("source", F.lit("-"), F.col("n").cast("string")).alias("session"), "type", "id", "t", "source")


def read_lines(spark: SparkSession, path: str, schema: str = EVENT) -> DataFrame:
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def read_wrapped(spark: SparkSession, path: str, field: str | None = None, schema: str = EVENT) -> DataFrame:
    """Whole files that are an array, or an object with the array in `field`."""
    if field is None:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    return spark.read.schema(f"`{field}` array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>").option("multiLine", True).json(path).select(F.inline(field))


def valid(events: DataFrame) -> DataFrame:
    """Events of known types with a time and the first MOST_IDS ids; others are left out, as are broken lines."""
    good = F.col("type").isin(*TYPES) & (F.col("t") > 0) & F.col("ids").isNotNull() & F.col("_corrupt").isNull()
    return events.where(good).withColumn("ids", F.slice("ids", 1, MOST_IDS)).drop("_corrupt")


def retain(events: DataFrame, keep_ms: int, most: int) -> DataFrame:
    """Events no older than `keep_ms` before the newest, and of those the newest `most`."""
    newest = F.broadcast(events.agg(F.max("t").alias("newest")))  # one row
    return events.join(newest).where(F.col("t") >= F.col("newest") - keep_ms).drop("newest").orderBy(F.desc("t")).limit(most)
