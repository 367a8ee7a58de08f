"""From documents to token ids: quality rules, near-dedup, substring dedup, decontamination, BPE.

Each stage takes (spark, docs, sf_dir), works on all rows of `docs` and returns a DataFrame; all but the
last return the columns of `docs`. Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvex.llm import bpe, decontam, quality, simhash, suffix_dedup
from corvex.llm.common import ensure_checkpoint_dir, table
from corvex.llm.queries import RANKS


def _apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """`docs` with its columns under names that no operator has for its own, and the new names."""
    new = {c: f"_in{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*new.values()), new


def _back(found: DataFrame, names: dict[str, str], changed: dict | None = None) -> DataFrame:
    return found.select(*[(changed or {}).get(c, F.col(n)).alias(c) for c, n in names.items()])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects, with all their columns; only text is needed. A null, empty or short text goes;
    repeated rows are judged one by one; long texts are judged whole; an empty table stays empty."""
    inner, names = _apart(docs)
    return _back(quality.cascade(inner, names["text"]).where("kept"), names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id, with all its columns; doc_id and text are
    needed. Repeated rows leave one; of rows of one id but different groups, each group keeps its own; rows without an
    id stay; null and empty texts are one group; long texts are read whole; an empty table stays empty."""
    inner, names = _apart(docs)
    return _back(simhash.keep_one(inner, names["doc_id"], names["text"]), names)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that documents with smaller ids have; what is left of a character that was
    cut in two goes as well. doc_id and text are needed; n_chars follows, if it is there; a null text stays null, an
    empty one empty; rows of one id lose nothing to each other, and rows without an id have the largest; long texts are
    read whole; an empty table stays empty."""
    inner, names = _apart(docs)
    cut = suffix_dedup.remove_repeats(inner, names["doc_id"], names["text"], decoded=True)
    text = F.when(F.col("n_removed") == 0, F.col(names["text"])).otherwise(F.col("kept"))
    changed = {"text": text}
    if "n_chars" in names:
        old = F.col(names["n_chars"])
        changed["n_chars"] = F.when(F.col("n_removed") == 0, old).otherwise(F.length("kept").cast(docs.schema["n_chars"].dataType))
    return _back(cut, names, changed)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark, with all their columns; only text is needed. A null or
    empty text stays; repeated rows are judged one by one; long texts are read whole; with an empty benchmark all stay; an
    empty table stays empty."""
    inner, names = _apart(docs)
    found = decontam.decontaminate(inner, table(spark, sf_dir, "benchmark"), text_col=names["text"])
    return _back(found.where("NOT contaminated"), names)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source (those that are there), n_tokens, ids (little-endian unsigned 32-bit), ids_sha256, and
    decoded_sha256 of the bytes that the ids decode to. A null or empty text has no ids; a row comes out for each row, repeated
    ones too, and none for an empty table; long texts are encoded whole."""
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    carry = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    ids = bpe.encode(docs, path, pattern, carry=carry)
    back = bpe.decode(ids, path, pattern)
    return back.select(
        *carry, (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

ORACLE_SQL = None  # SQL has no XXH64, no components and no BPE; tests hold run() against brute force


def _drop(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Of the tables between stages, the one that the result reads stays in the folder of
    checkpoints, the others go when the next is written."""
    ensure_checkpoint_dir(spark)
    top = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{top}/{k}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                _drop(spark, before)
            before = path
    return docs
