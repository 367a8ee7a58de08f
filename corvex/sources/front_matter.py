"""Front matter written and changed: block YAML, and merges that leave all other lines as they are.

A note's front matter is a list of top-level keys, each with the lines up to the next one. A merge writes the lines of
the keys that it sets, in their place or at the end, and copies every other line, comments and blank ones included, with
its own line ending. Reading back gives the old values with the new ones over them; what could not be read safely is not
changed but reported. Long scalars are not folded.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .markdown import front_matter, scalar

# Words that YAML reads as something else than text, and signs that begin something else than plain text.
WORDS = "yes no true false on off null ~ = <<".split()
SIGNS = "#,[]{}&*!|>'\"%@`?:-"
_NUMBER_LIKE = re.compile(r"[-+.]?[0-9][0-9a-fA-FxXoObB_:.,+-]*|[-+]?\.(?:inf|nan)|\d{4}-\d\d?-\d\d?.*", re.I)
_KEY = re.compile(r"(\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'|[^\s#'\"\-\[\]{},&*!|>%@`][^:]*?|-[^\s:][^:]*?)[ \t]*:(?:[ \t]|$)")
_NOTE = re.compile(r"(---[ \t]*\r?\n)(.*?)((?:^|(?<=\n))---[ \t]*(?:\r?\n|$))(.*)\Z", re.S)


def _text(s: str) -> str:
    """A string as a plain scalar where it reads back as itself, else in single, else in double quotes."""
    plain = (
        s and s == s.strip() and s[0] not in SIGNS and s.lower() not in WORDS and not _NUMBER_LIKE.fullmatch(s) and s.isprintable()
        and ": " not in s and " #" not in s and not s.endswith(":") and scalar(s) == s
    )
    if plain:
        return s
    if s.isprintable() and s and "\\" not in s:
        return "'" + s.replace("'", "''") + "'"
    return json.dumps(s, ensure_ascii=False)


def _leaf(v: Any) -> str | None:
    if v is None or isinstance(v, bool):
        return {None: "null", True: "true", False: "false"}[v]
    if isinstance(v, (int, float)):
        return repr(v)
    if isinstance(v, str):
        return _text(v)
    if not v:
        return "{}" if isinstance(v, dict) else "[]"
    return None


def block_lines(meta: dict, indent: int = 0) -> list[str]:
    """A map as lines of block YAML: keys in order, lists at the depth of their key, two spaces a level."""
    out, pad = [], " " * indent
    for k, v in meta.items():
        key = f"{pad}{_text(str(k))}:"
        if (leaf := _leaf(v)) is not None:
            out.append(f"{key} {leaf}")
        elif isinstance(v, dict):
            out += [key, *block_lines(v, indent + 2)]
        else:
            out += [key, *_items(v, indent)]
    return out


def _items(values: list, indent: int) -> list[str]:
    out, pad = [], " " * indent
    for v in values:
        if (leaf := _leaf(v)) is not None:
            out.append(f"{pad}- {leaf}")
        elif isinstance(v, dict):
            first, *rest = block_lines(v, indent + 2)
            out += [f"{pad}- {first.strip()}", *rest]
        else:
            out += [f"{pad}-", *_items(v, indent + 2)]
    return out


def _key_of(line: str) -> str | None:
    m = None if line[:1] in (" ", "\t") else _KEY.match(line)
    return None if m is None else str(scalar(m[1]))


def merge(text: str, updates: dict, base: dict | None = None) -> str:
    """The note with `updates` in its front matter; None removes a key. Without front matter it gets one, `base` first.
    Raises ValueError where the front matter can't be read or would not read back."""
    if not updates:
        return text
    m = _NOTE.match(text)
    if m is None:
        new = {k: v for k, v in {**(base or {}), **updates}.items() if v is not None}
        return "---\n" + "".join(f"{x}\n" for x in block_lines(new)) + "---\n\n" + text.lstrip("\n")
    old, _, error = front_matter(text)
    if error:
        raise ValueError(f"front matter cannot be read: {error}")
    end = "\r\n" if m[1].endswith("\r\n") else "\n"
    segments: list[tuple[str | None, list[str]]] = [(None, [])]
    for line in m[2].splitlines(keepends=True):
        bare = line.rstrip("\r\n")
        key = _key_of(bare)
        if key is not None:
            segments.append((key, [line]))
        elif bare.lstrip().startswith("#") and bare[:1] not in (" ", "\t") or not bare.strip() and segments[-1][0] is not None:
            segments.append((None, [line]))  # comments and blank lines stay whatever becomes of the key before them
        else:
            if segments[-1][0] is None and len(segments) > 1 and bare.strip():
                owner = next((k for k in range(len(segments) - 1, -1, -1) if segments[k][0] is not None), 0)
                tail = [x for _, ls in segments[owner + 1 :] for x in ls]
                del segments[owner + 1 :]
                segments[owner][1].extend(tail)
            segments[-1][1].append(line)
    done, out = set(), []
    for key, lines in segments:
        if key in updates:
            if key not in done and updates[key] is not None:
                out += [x + end for x in block_lines({key: updates[key]})]
            done.add(key)
        else:
            out += lines
    if out and not out[-1].endswith("\n"):
        out[-1] += end
    out += [x + end for k, v in updates.items() if k not in done and v is not None for x in block_lines({k: v})]
    merged = m[1] + "".join(out) + m[3] + m[4]
    want = {k: v for k, v in {**old, **updates}.items() if updates.get(k, v) is not None or k not in updates}
    if front_matter(merged)[0] != want:
        raise ValueError("front matter would not read back")
    return merged


def merge_all(notes: DataFrame, updates: DataFrame) -> DataFrame:
    """`notes` (path, text) with `updates` (path, updates: a JSON object, one row a note) merged: path, text, error. A
    note whose front matter can't be merged keeps its text and has an error; notes without updates stay as they are."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, text, given in zip(f["path"], f["text"], f["updates"]):
                try:
                    rows.append((path, merge(text or "", json.loads(given)) if given else text, None))
                except (ValueError, AttributeError) as e:
                    rows.append((path, text, str(e)))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    out = T.StructType([T.StructField("path", notes.schema["path"].dataType), T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])
    return notes.select("path", "text").join(updates.select("path", F.col("updates").cast("string")), "path", "left").mapInPandas(run, out)
