"""A table in versions, for writers that don't wait for each other: compare and swap, tombstones, trash, changes.

A folder holds `data/<id>`, the rows of one commit as Parquet, and `versions/<n>`, which lists the commits that make up
version n. A writer puts its rows down, looks whether the rows that it changes are as it knew them, and claims the next
version by creating that version's file, which only one can. Who comes second looks again and tries the next number. A row
that goes leaves a tombstone, so what was removed can be listed and brought back. Rows carry the `version` that wrote
them; reading takes the latest row of each key, by one aggregation, and old commits are put together when there are many.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ATTEMPTS = 20
MOST_PARTS = 32  # commits that a version reads before they are put together


class Conflict(ValueError):
    """Rows have another version than the writer knew."""


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def head(spark: SparkSession, path: str) -> int:
    """The latest version, 0 before the first."""
    p, fs = _path(spark, f"{path}/versions")
    if not fs.exists(p):
        return 0
    names = [f.getPath().getName() for f in fs.listStatus(p)]
    return max((int(n) for n in names if n.isdigit()), default=0)


def _parts(spark: SparkSession, path: str, version: int) -> list[list]:
    """[version, folder, kind] of the commits of a version, oldest first."""
    if not version:
        return []
    p, fs = _path(spark, f"{path}/versions/{version:012d}")
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _claim(spark: SparkSession, path: str, version: int, parts: list[list]) -> bool:
    """Create the version's file, whole, if no one has."""
    mine, fs = _path(spark, f"{path}/versions/.{uuid.uuid4().hex}")
    target, _ = _path(spark, f"{path}/versions/{version:012d}")
    out = fs.create(mine, True)
    out.write(json.dumps(parts).encode())
    out.close()
    try:
        if fs.getScheme() != "file":
            return not fs.exists(target) and fs.rename(mine, target)  # in a distributed store a rename onto a file fails
        file = lambda p: spark._jvm.java.io.File(p.toUri().getPath()).toPath()
        try:
            spark._jvm.java.nio.file.Files.createLink(file(target), file(mine))
            return True
        except Exception as e:  # noqa: BLE001
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
    finally:
        fs.delete(mine, False)


def _rows(spark: SparkSession, path: str, parts: list[list]) -> DataFrame:
    """All rows of the commits, with version and removed."""
    each = []
    for version, folder, whole in parts:
        df = spark.read.parquet(f"{path}/data/{folder}")
        each.append(df if whole else df.withColumn("version", F.lit(version).cast("bigint")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), each)


def _latest(rows: DataFrame, key: str, extra: list = ()) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), "version").alias("_r"), *extra)


def read(spark: SparkSession, path: str, key: str = "path", version: int | None = None) -> DataFrame:
    """The rows of a version, each with the `version` that wrote it."""
    parts = _parts(spark, path, head(spark, path) if version is None else version)
    if not parts:
        raise ValueError(f"{path} has no version yet")
    return _latest(_rows(spark, path, parts), key).select(key, "_r.*").where("NOT removed").drop("removed")


def trash(spark: SparkSession, path: str, key: str = "path") -> DataFrame:
    """Removed rows as they last were, with removed_in, the version that removed them."""
    rows = _rows(spark, path, _parts(spark, path, head(spark, path)))
    columns = [c for c in rows.columns if c not in (key, "removed")]
    was = F.max_by(F.when(~F.col("removed"), F.struct(*columns)), F.when(~F.col("removed"), F.col("version"))).alias("_was")
    return _latest(rows, key, [was]).where("_r.removed AND _was IS NOT NULL").select(key, "_was.*", F.col("_r.version").alias("removed_in"))


def changes(spark: SparkSession, path: str, after: int, upto: int | None = None, key: str = "path") -> DataFrame:
    """The latest row of each key that versions after `after` wrote, with removed: each change once for a reader who asks
    from the version it has seen."""
    rows = _rows(spark, path, _parts(spark, path, head(spark, path) if upto is None else upto))
    return _latest(rows.where(F.col("version") > after), key).select(key, "_r.*")


def commit(spark: SparkSession, path: str, rows: DataFrame, key: str = "path", expected: str | None = "expected", attempts: int = ATTEMPTS) -> int:
    """Write rows as a new version and give its number. `expected` names a column with the version that a row had when
    the writer read it, null for a new one; rows that have another by now are a Conflict and nothing is written. Without
    such a column the last writer wins. Rows whose `removed` is true go. Rows of other keys that came between are kept."""
    if "removed" not in rows.columns:
        rows = rows.withColumn("removed", F.lit(False))
    folder = uuid.uuid4().hex
    data = rows.drop(*[c for c in ("version", expected) if c]).withColumn("removed", F.coalesce("removed", F.lit(False)))
    claims = rows.select(key, F.col(expected).cast("bigint").alias("expected")) if expected else None
    data.write.parquet(f"{path}/data/{folder}")
    try:
        seen = -1
        for _ in range(attempts):
            now = head(spark, path)
            parts = _parts(spark, path, now)
            if claims is not None and now != seen:
                current = read(spark, path, key, now).select(key, "version") if parts else claims.select(key, F.lit(None).cast("bigint").alias("version")).limit(0)
                odd = claims.join(current, key, "left").where("NOT expected <=> version")
                n = odd.count()
                if n:
                    raise Conflict(f"{n} rows have another version by now, among them {odd.first()[key]}")
                seen = now
            if _claim(spark, path, now + 1, [*parts, [now + 1, folder, False]]):
                break
        else:
            raise Conflict(f"no version could be claimed in {attempts} attempts")
    except Exception:
        p, fs = _path(spark, f"{path}/data/{folder}")
        fs.delete(p, True)
        raise
    if len(parts) >= MOST_PARTS:
        compact(spark, path)
    return now + 1


def remove(spark: SparkSession, path: str, rows: DataFrame, key: str = "path", expected: str | None = "expected") -> int:
    """Put rows (key, expected) into the trash."""
    return commit(spark, path, rows.select(key, *([expected] if expected else [])).withColumn("removed", F.lit(True)), key, expected)


def restore(spark: SparkSession, path: str, keys: DataFrame, key: str = "path") -> int:
    """Bring rows back as they were when they were removed; a key that is in use again is a Conflict."""
    back = trash(spark, path, key).join(keys.select(key), key, "left_semi").drop("version", "removed_in")
    return commit(spark, path, back.withColumn("expected", F.lit(None).cast("bigint")), key)


def compact(spark: SparkSession, path: str) -> int | None:
    """Put the commits of the latest version together in one folder, tombstones and what they removed included; None if
    another writer was faster."""
    now = head(spark, path)
    parts, folder = _parts(spark, path, now), uuid.uuid4().hex
    _rows(spark, path, parts).write.parquet(f"{path}/data/{folder}")
    return now + 1 if _claim(spark, path, now + 1, [[now, folder, True]]) else None
