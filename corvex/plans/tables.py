"""The supplied tables as the engine's own: notes, activity, calls, edges, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvex.functions import text as X

DAY_MS = 86_400_000
HALF_DAY_MS = 43_200_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def version(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A key that changes when the table's file does."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
    return f"{status.getPath()}:{status.getModificationTime()}:{status.getLen()}"


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream of its files, whether it is one file or a folder of them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    source = spark.readStream.schema(read(spark, sf_dir, name).schema)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return source.parquet(f"{sf_dir}/{name}.parquet")
    return source.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("text").alias("body"), F.col("source").alias("theme"),
        F.col("lang").alias("subtheme"), X.tokens("text").alias("tokens"), (F.lit(1_704_067_200_000) + F.col("doc_id") * 60_000).alias("mtime_ms"),
    )


NOTES_SQL = """notes AS (SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, text AS body, source AS theme, lang AS subtheme,
  ceil(octet_length(encode(coalesce(text, ''))) / 4.0)::BIGINT AS tokens, 1704067200000 + doc_id * 60000 AS mtime_ms FROM documents)"""


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "click", "search").when(F.col("event_type") == "view", "read").when(F.col("event_type") == "purchase", "write")
    ts = F.col("ts").cast("timestamp")
    return e.select(
        F.col("event_id").alias("call_id"), kind.alias("type"), F.col("user_id").alias("actor"), F.get_json_object("props", "$.k").cast("bigint").alias("id"),
        F.unix_millis(ts).alias("t"), F.to_date(ts).alias("day"), F.col("value").alias("ms"), F.concat(F.lit("s"), F.pmod("user_id", F.lit(3))).alias("source"),
    ).where("type IS NOT NULL")


ACTIVITY_SQL = """activity AS (SELECT event_id AS call_id, CASE event_type WHEN 'click' THEN 'search' WHEN 'view' THEN 'read' WHEN 'purchase' THEN 'write' END AS type,
  user_id AS actor, CAST(json_extract_string(props, '$.k') AS BIGINT) AS id, epoch_us(ts) // 1000 AS t, CAST(ts AS DATE) AS day, value AS ms, 's' || (user_id % 3) AS source
  FROM events WHERE event_type IN ('click', 'view', 'purchase'))"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links from a page's host to the names it links to, once each."""
    p = read(spark, sf_dir, "pages")
    host = F.regexp_extract("url", "//([^/]+)", 1)
    target = F.explode(F.regexp_extract_all("html", F.lit('href="/([^"/]+)"'), 1))
    return p.select(host.alias("src"), target.alias("dst")).distinct()


EDGES_SQL = """edges AS (SELECT DISTINCT regexp_extract(url, '//([^/]+)', 1) AS src, unnest(regexp_extract_all(html, 'href="/([^"/]+)"', 1)) AS dst FROM pages)"""
