"""Edit-aware token counts: a segment tree of token counts over the pre-tokens of a document.

A document is a list of parts, each one or more whole pre-tokens: stretches between spaces that always begin a
pre-token, of which long ones are cut into their pre-tokens. A leaf holds up to LEAF consecutive parts, with their
characters and token counts, and inner nodes hold sums. An edit is encoded again from two parts before it, and in
front of white space there, since how a pre-token ends depends on no more than that, up to the first place behind it
where a new pre-token begins where an old part did: from there on the old ones hold, as they follow from the text
behind them alone. So an edit costs a bounded piece in any script. Leaves are patched and the sums on their paths
updated.

Defined results: a null text counts as empty; an edit's place is clipped to the text; edits apply in order,
each to the result of the one before; a null or empty list of edits changes nothing; repeated rows are counted one
by one; columns of other names are carried along, those with the names of the results replaced.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import SHORT, Codec, codec
from .common import map_column

LEAF = 32
AHEAD = 8  # parts that are read behind an edit, at first


class TokenTree:
    def __init__(self, text: str, encoder: Codec, cut: list[str] | None = None):
        self.encoder, self.reencoded = encoder, 0
        parts, counts = [], []
        stretches = (cut if cut is not None else encoder.stretches(text) if text else [])
        for i, (s, n) in enumerate(zip(stretches, encoder.counts(stretches))):
            whole = s if i == 0 else " " + s
            if len(whole) <= SHORT:
                parts.append(whole)
                counts.append(n)
            else:
                words = encoder.split(whole)
                parts += words
                counts += self._tokens(words)
        self._build(parts or [""], counts or [0])

    def _tokens(self, words: list[str]) -> list[int]:
        return [len(x) >> 2 for x in self.encoder.words_ids(words)]

    def _build(self, parts: list[str], counts: list[int]) -> None:
        self.parts, self.counts = parts, counts  # of leaves that no edit has touched
        self.own: dict[int, tuple[list[str], list[int]]] = {}
        n = np.arange(0, len(parts), LEAF)
        self.n, self.size = len(n), 1 << (len(n) - 1).bit_length()
        pad = [0] * (self.size - self.n)
        chars = np.add.reduceat(np.fromiter(map(len, parts), np.int64, len(parts)), n).tolist() + pad
        tokens = np.add.reduceat(np.array(counts, np.int64), n).tolist() + pad
        self.chars, self.tokens = [0] * self.size + chars, [0] * self.size + tokens
        for k in range(self.size - 1, 0, -1):
            self._sum(k)

    def _sum(self, k: int) -> None:
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    def _leaf(self, k: int) -> tuple[list[str], list[int]]:
        at = slice(k * LEAF, (k + 1) * LEAF)
        return self.own.get(k) or (self.parts[at], self.counts[at])

    def total(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(p for k in range(self.n) for p in self._leaf(k)[0])

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf whose parts hold place `at` (or the last), and where it begins."""
        k, before = 1, 0
        while k < self.size:
            k *= 2
            if at >= before + self.chars[k] and self.chars[k + 1]:
                before += self.chars[k]
                k += 1
        return k - self.size, before

    def edit(self, a: int, b: int, new: str) -> None:
        """Put `new` in place of the characters [a, b)."""
        a = min(max(a, 0), self.chars[1])
        b = min(max(b, a), self.chars[1])
        first, at = self._find(max(a - 1, 0))
        last = self._find(b)[0]
        parts, counts = [list(x) for x in self._leaf(first)]
        for k in range(first + 1, last + 1):
            p, c = self._leaf(k)
            parts += p
            counts += c
        # from two parts before the one with a - 1, and from in front of white space there
        lo, end = 0, at
        while lo + 1 < len(parts) and end + len(parts[lo]) <= a - 1:
            end += len(parts[lo])
            lo += 1
        back = 0
        while back < 2 or (lo > 0 or first > 0) and parts[lo].isspace():
            if lo == 0:
                if first == 0:
                    break
                first -= 1
                p, c = self._leaf(first)
                parts, counts, lo = p + parts, c + counts, len(p)
            lo -= 1
            end -= len(parts[lo])
            back += 1
        at, shift = end, len(new) - (b - a)
        hi, old_end, ahead = lo, at, AHEAD
        while hi < len(parts) and old_end <= b:
            old_end += len(parts[hi])
            hi += 1
        while True:
            want = hi + ahead
            while len(parts) < want and last + 1 < self.n:
                last += 1
                p, c = self._leaf(last)
                parts, counts = parts + p, counts + c
            far = min(want, len(parts))
            whole = far == len(parts) and last + 1 == self.n
            old = "".join(parts[lo:far])
            region = old[: a - at] + new + old[b - at :]
            ends = {}  # of old parts behind the edit, in the new text
            place = 0
            for k in range(lo, far):
                place += len(parts[k])
                if at + place >= b:
                    ends[place + shift] = k + 1
            words, to, done = [], 0, None
            for m in self.encoder.matches(region):
                words.append(m[0])
                to = m.end()
                if to in ends and to >= a - at + len(new) and (to < len(region) and not region[-1].isspace() or whole):
                    done = ends[to]
                    break
            if done is None and whole:
                done = far
            if done is not None:
                break
            ahead *= 4
        self.reencoded += to
        self._patch(first, last, parts[:lo] + words + parts[done:], counts[:lo] + self._tokens(words) + counts[done:])

    def _patch(self, first: int, last: int, parts: list[str], counts: list[int]) -> None:
        n = last - first + 1
        if not n <= len(parts) <= 2 * LEAF * n:  # leaves may grow to twice their size, and not be empty
            before = [self._leaf(k) for k in range(first)] + [(parts, counts)] + [self._leaf(k) for k in range(last + 1, self.n)]
            self._build([x for p, _ in before for x in p] or [""], [x for _, c in before for x in c] or [0])
            return
        edges = [len(parts) * i // n for i in range(n + 1)]
        for i, (x, y) in enumerate(zip(edges, edges[1:])):
            p, c = parts[x:y], counts[x:y]
            self.own[first + i] = p, c
            k = self.size + first + i
            self.chars[k], self.tokens[k] = sum(map(len, p)), sum(c)
        for k in {(self.size + i) >> 1 for i in range(first, last + 1)}:
            while k:
                self._sum(k)
                k >>= 1


def count_edited(
    docs: DataFrame, path: str, pattern: str, text_col: str = "text", edits_col: str = "edits", carry: list[str] | None = None
) -> DataFrame:
    """`carry` (default: all columns) plus n_tokens_before, n_tokens_after, n_edits and n_reencoded (the
    characters that edits made be encoded again). `edits_col`: array<struct<start, end, text>>."""
    cols = docs.columns if carry is None else carry

    def make():
        c = codec(path, pattern)

        def fn(texts, edits):
            out = []
            for t, e, cut in zip(texts, edits, c.learn(texts)):
                tree = TokenTree(t or "", c, cut)
                before = tree.total()
                for x in e or []:
                    tree.edit(x["start"] or 0, x["end"] or 0, x["text"] or "")
                out.append((before, tree.total(), len(e or []), tree.reencoded))
            return out

        return fn

    fields = [(n, "bigint") for n in ("n_tokens_before", "n_tokens_after", "n_edits", "n_reencoded")]
    return map_column(docs, [text_col, edits_col], cols, fields, make)


def sample_edits(n_chars: int, seed: str) -> list[tuple[int, int, str]]:
    """Three edits (replace, insert, delete) whose places follow from a checksum of `seed`."""
    out = []
    for k, (cut, text) in enumerate(((6, "revised"), (0, " newly  added\n"), (9, ""))):
        at = zlib.crc32(f"{seed}/{k}".encode()) % (n_chars + 1)
        out.append((at, at + cut, text))
    return out


def with_sample_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` plus edits: the same three places as sample_edits, told by Spark's crc32."""
    n = F.coalesce(F.length(f"`{text_col}`"), F.lit(0))
    one = []
    for k, (cut, text) in enumerate(((6, "revised"), (0, " newly  added\n"), (9, ""))):
        seed = F.concat(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.lit(f"/{k}"))
        at = F.pmod(F.crc32(F.encode(seed, "utf-8")), n + 1).cast("bigint")
        one.append(F.struct(at.alias("start"), (at + cut).alias("end"), F.lit(text).alias("text")))
    return docs.withColumn("edits", F.array(*one))
