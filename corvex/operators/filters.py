"""Metadata filters as Columns, over a map or struct of front matter as JSON."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvex.functions import dates as D
from corvex.functions import text as X


def folded(x) -> Column:
    return F.trim(X.fold(x))


def _lit(v) -> str:
    return X.fold_text(str(v).lower() if isinstance(v, bool) else str(v)).strip()


def path(meta: Column, key: str) -> Column:
    """A value of a JSON document as a string: the literal key first, then its dotted parts."""
    whole = F.get_json_object(meta, f"$['{key}']")
    return F.coalesce(whole, F.get_json_object(meta, "$." + key)) if "." in key else whole


def values(actual: Column) -> Column:
    """A JSON list's elements, or the value alone; null has none."""
    many = F.from_json(actual, "array<string>")
    return F.when(actual.isNull(), F.array().cast("array<string>")).when(actual.startswith("["), many).otherwise(F.array(actual))


def compare(actual: Column, want) -> Column:
    """Negative, zero or positive: as numbers if both are, else as folded text."""
    a, text = actual.try_cast("double"), _lit(want)
    by_text = F.when(folded(actual) < text, -1.0).when(folded(actual) > text, 1.0).otherwise(0.0)
    try:
        number = float(want)
    except (TypeError, ValueError):
        return by_text
    return F.when(a.isNotNull(), a - number).otherwise(by_text)


def match(actual: Column, want: Any) -> Column:
    if isinstance(want, dict):
        out = F.lit(True)
        for op, v in want.items():
            out = out & _operator(actual, op, v)
        return out
    if isinstance(want, (list, tuple)):
        out = F.lit(False)
        for v in want:
            out = out | match(actual, v)
        return out
    return F.exists(values(actual), lambda a: folded(a) == _lit(want))


def _operator(actual: Column, op: str, v: Any) -> Column:
    vals = values(actual)
    among = [_lit(x) for x in (v if isinstance(v, (list, tuple)) else [v])]
    some = F.exists(vals, lambda a: folded(a).isin(among)) if among else F.lit(False)
    known = lambda c: actual.isNotNull() & c
    if op in ("$in", "$eq"):
        return some
    if op in ("$nin", "$ne"):  # also true of what is missing
        return ~F.coalesce(some, F.lit(False))
    if op == "$contains":
        return F.exists(vals, lambda a: folded(a).contains(_lit(v)))
    if op == "$gt":
        return known(compare(actual, v) > 0)
    if op == "$gte":
        return known(compare(actual, v) >= 0)
    if op == "$lt":
        return known(compare(actual, v) < 0)
    if op == "$lte":
        return known(compare(actual, v) <= 0)
    if op == "$between":
        ok = isinstance(v, (list, tuple)) and len(v) == 2
        return known((compare(actual, v[0]) >= 0) & (compare(actual, v[1]) <= 0)) if ok else F.lit(False)
    if op == "$exists":
        return actual.isNotNull() if v else actual.isNull()
    return F.lit(False)


def note_filter(
    types: list[str] | None = None, tags: list[str] | None = None, status: str | None = None,
    metadata: dict[str, Any] | None = None, after: Any = None, now_ms: int = 0,
) -> Column:
    """One predicate over the columns type, tags, status, meta (JSON) and mtime_ms."""
    out = F.lit(True)
    if types:
        out = out & folded(F.col("type")).isin([_lit(t) for t in types])
    if tags:
        out = out & (F.size(F.array_except(F.array(*[F.lit(_lit(t)) for t in tags]), F.transform("tags", folded))) == 0)
    if status:
        out = out & F.coalesce(folded(F.col("status")) == _lit(status), F.lit(False))
    for key, want in (metadata or {}).items():
        actual = F.col("type") if key in ("type", "note_type") else path(F.col("meta"), key)
        out = out & F.coalesce(match(actual, want), F.lit(False))
    since = D.parse_timeframe(after, now_ms) if after is not None else None
    if since is not None:
        out = out & (F.col("mtime_ms") >= since)
    return out


def under(rel: Column, folders: list[str]) -> Column:
    """Whether a path is one of the folders or below one."""
    out = F.lit(False)
    for f in folders:
        out = out | (rel == f) | rel.startswith(f.rstrip("/") + "/")
    return out


def in_scope(rel: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Whether a path is below one of the folders to include (all, if none is named) and of none to exclude."""
    inside = under(rel, include) if include else F.lit(True)
    return inside & ~under(rel, exclude or [])
