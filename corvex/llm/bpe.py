"""Byte-level BPE: ranked merges folded over the bytes of distinct words; decoding concatenates pieces.

`fold_words` is the form in Spark higher-order functions: `aggregate` folds merges over an array of byte
strings, with a literal rank map (dealt into small maps by hash, since a map lookup in Spark scans its
keys). It suits a table of distinct words. Whole texts are encoded by `encode`: an Arrow map that splits a
text at word boundaries and folds the distinct words of many texts at once, beside a bounded cache. README has the
figures of both.

Defined results: null and empty texts have no tokens; ids follow the byte ranks alone, so the strings of
special tokens are ordinary text; repeated rows are encoded one by one.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_column

NONE = 1 << 62  # rank of a pair that is not to be merged
CACHE_BYTES = 96 << 20  # of what a worker remembers, about; beyond it starts anew
SHORT = 48  # characters; longer stretches of text are not remembered, but the words in them
LONG = 64  # bytes; longer words are folded one by one, with a heap
FEW = 32  # words; fewer are folded one by one
_WIDE = re.compile(r"\s | \s")  # a space beside other white space


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Fold the merge of lowest rank, leftmost first, until no pair is in `ranks`; with a heap."""
    import heapq

    n = len(word)
    start, end = list(range(n)), list(range(1, n + 1))
    nxt, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    get = ranks.get
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, mid, stop = heapq.heappop(heap)
        if not alive[i] or end[i] != mid or (j := nxt[i]) >= n or end[j] != stop:
            continue
        end[i], alive[j], nxt[i] = stop, False, nxt[j]
        if nxt[i] < n:
            prev[nxt[i]] = i
            if (r := get(word[start[i] : end[nxt[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[i], end[nxt[i]]))
        if (h := prev[i]) >= 0 and (r := get(word[start[h] : end[i]])) is not None:
            heapq.heappush(heap, (r, h, end[h], end[i]))
    return [ranks[word[start[i] : end[i]]] for i in range(n) if alive[i]]


class Pairs:
    """The rank map as a hash table from pairs of ids to the id of their concatenation."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for word, r in ranks.items():
            for i in range(1, len(word)):
                a, b = ranks.get(word[:i]), ranks.get(word[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(r)
        self.bits = max(4, len(keys).bit_length() + 2)
        size = 1 << self.bits
        self.key, self.value = np.full(size + 64, -1, np.int64), np.full(size + 64, NONE, np.int64)
        left, key, val = self._slot(np.array(keys, np.int64)), np.array(keys, np.int64), np.array(values, np.int64)
        while len(key):  # of those that want one slot, the last gets it; the others go on to the next
            free = self.key[left] == -1
            self.key[left[free]] = key[free]
            lost = self.key[left] != key
            self.value[left[~lost]] = val[~lost]
            left, key, val = left[lost] + 1, key[lost], val[lost]

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = self._slot(key)
        out = self.value[at]
        todo = np.flatnonzero((self.key[at] != key) & (self.key[at] != -1))
        out[self.key[at] != key] = NONE
        while len(todo):
            at[todo] += 1
            k = self.key[at[todo]]
            hit = k == key[todo]
            out[todo[hit]] = self.value[at[todo[hit]]]
            todo = todo[~hit & (k != -1)]
        return out


class Folder:
    """Folds many distinct words at once, a merge in each of them a round."""

    def __init__(self, ranks: dict[bytes, int]):
        self.map, self.pairs = ranks, Pairs(ranks)
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)

    def fold(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers. No word is empty."""
        if len(words) < FEW:
            return [np.array(merge_long(w, self.map), "<u4").tobytes() for w in words]
        long = {i: np.array(merge_long(w, self.map), "<u4").tobytes() for i, w in enumerate(words) if len(w) > LONG}
        short = [w for w in words if len(w) <= LONG]
        if not short:
            return list(long.values())
        x = self.byte[np.frombuffer(b"".join(short), np.uint8)]
        n = np.array([len(w) for w in short])
        of = np.repeat(np.arange(len(short)), n)
        last = np.zeros(len(x), bool)
        last[np.cumsum(n) - 1] = True
        r = np.full(len(x), NONE)
        inner = np.flatnonzero(~last)
        r[inner] = self.pairs.ranks(x[inner], x[inner + 1])
        done_x, done_of = [], []
        while len(x):
            first = np.flatnonzero(np.append(True, last[:-1]))
            low = np.minimum.reduceat(r, first)
            low = np.repeat(low, np.diff(np.append(first, len(x))))
            over = low == NONE
            if over.any():
                done_x.append(x[over])
                done_of.append(of[over])
                x, of, last, r, low = x[~over], of[~over], last[~over], r[~over], low[~over]
                if not len(x):
                    break
            at = np.flatnonzero(r == low)
            at = at[np.append(True, of[at[1:]] != of[at[:-1]])]
            x[at] = r[at]
            last[at] = last[at + 1]
            keep = np.ones(len(x), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))
            x, of, last, r = x[keep], of[keep], last[keep], r[keep]
            r[at] = NONE
            back = at[at > 0] - 1
            back = back[~last[back]]
            redo = np.concatenate([at[~last[at]], back])
            r[redo] = self.pairs.ranks(x[redo], x[redo + 1])
        of = np.concatenate(done_of)
        by = np.argsort(of, kind="stable")
        flat = np.concatenate(done_x)[by].astype("<u4").tobytes()
        ends = (np.cumsum(np.bincount(of, minlength=len(short))) * 4).tolist()
        out = [flat[a:b] for a, b in zip([0, *ends], ends)]
        if long:
            rest = iter(out)
            out = [long[i] if i in long else next(rest) for i in range(len(words))]
        return out


class Codec:
    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.pieces = [b""] * (max(self.ranks.values()) + 1)
        for piece, i in self.ranks.items():
            self.pieces[i] = piece
        compiled = regex.compile(pattern)
        self.folder, self.split, self.matches = Folder(self.ranks), compiled.findall, compiled.finditer
        self.known: dict[str, bytes] = {}  # stretch of text -> ids
        self.words: dict[str, bytes] = {}  # match of the pattern in longer stretches -> ids
        self.room = CACHE_BYTES

    def stretches(self, text: str) -> list[str]:
        """Parts of the text between which a match of the pattern always ends: before a space between two
        characters that are no white space. All but the first begin with that space, which is left out."""
        if not _WIDE.search(text):
            return text.split(" ")
        return [x if i == 0 else x[1:] for i, x in enumerate(re.split(r"(?<=\S)(?= \S)", text))]

    def learn(self, texts: list[str | None]) -> list[list[str]]:
        """Fold the short stretches of the texts that are not known yet; the texts' stretches."""
        cut = [self.stretches(t) if t else [] for t in texts]
        seen = {w for c in cut for w in c[1:]}.union(" " + c[0] for c in cut if c)  # others never begin with a space
        self._learn([w for w in seen.difference(self.known) if len(w) <= SHORT])
        return cut

    def counts(self, cut: list[str], head: bool = True) -> list[int]:
        """Token counts of stretches; with `head`, the first has no space before it."""
        keys = [" " + cut[0], *cut[1:]] if head and cut else cut
        return [len(x) >> 2 for x in self.ids(keys)]

    def ids(self, keys: list[str]) -> list[bytes]:
        """Ids of stretches (see `learn` for how the first of a text is written)."""
        get = self.known.get
        found = [get(k) for k in keys]
        if None in found:
            new = [k for k, x in dict(zip(keys, found)).items() if x is None]
            long = {k: b"".join(self.words_ids(self._split(k))) for k in new if len(k) > SHORT}
            self._learn([k for k in new if len(k) <= SHORT])  # last, as to remember may be to forget others
            found = [x if x is not None else long[k] if k in long else self.known[k] for k, x in zip(keys, found)]
        return found

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        return [b"".join(self.ids([" " + c[0], *c[1:]])) if c else b"" for c in self.learn(texts)]

    def words_ids(self, words: list[str]) -> list[bytes]:
        """Ids of whole matches of the pattern."""
        new = [w for w in dict.fromkeys(words) if w not in self.words]
        folded = dict(zip(new, self.folder.fold([w.encode("utf-8", "surrogatepass") for w in new]))) if new else {}
        out = [self.words[w] if w in self.words else folded[w] for w in words]
        self._remember("words", {w: x for w, x in folded.items() if len(w) <= SHORT})
        return out

    def _split(self, key: str) -> list[str]:
        return self.split(key[1:] if key[:1] == " " else " " + key)

    def _remember(self, name: str, more: dict[str, bytes]) -> None:
        size = sum(2 * len(k) + len(x) for k, x in more.items()) + 200 * len(more)  # and the objects around them
        self.room -= size
        if self.room < 0:
            self.known, self.words, self.room = {}, {}, CACHE_BYTES - size
        getattr(self, name).update(more)

    def _learn(self, stretches: list[str]) -> None:
        plain, mixed, distinct = [], [], {}
        for s in stretches:
            if s.isalpha():
                plain.append(s)
                distinct[" " + s] = None
            else:
                p = self._split(s)
                mixed.append((s, p))
                distinct.update(dict.fromkeys(p))
        folded = self.folder.fold([w.encode("utf-8", "surrogatepass") for w in distinct]) if distinct else []
        ids = dict(zip(distinct, folded))
        new = {s: ids[" " + s] for s in plain} | {s: b"".join([ids[x] for x in p]) for s, p in mixed}
        self._remember("known", new)

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """`carry` (default: all columns) plus ids binary (little-endian unsigned 32-bit)."""
    cols = docs.columns if carry is None else carry

    def make():
        c = codec(path, pattern)
        return lambda ts: [(x,) for x in c.encode_all(ts)]

    return map_column(docs, [text_col], cols, [("ids", "binary")], make)


def decode(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids", carry: list[str] | None = None) -> DataFrame:
    """`carry` (default: all columns) plus decoded binary; null ids give empty bytes."""
    cols = encoded.columns if carry is None else carry

    def make():
        c = codec(path, pattern)
        return lambda xs: [(c.decode(x or b""),) for x in xs]

    return map_column(encoded, [ids_col], cols, [("decoded", "binary")], make)


def rank_buckets(ranks: dict[bytes, int], n: int) -> Column:
    """Literal array of n maps from hex strings to ranks; a string is in the map of its hash."""
    import json

    import xxhash

    maps: list[dict] = [{} for _ in range(n)]
    for b, r in ranks.items():
        h = xxhash.xxh64_intdigest(b.hex().upper(), 42)
        maps[(h - (1 << 64) if h >> 63 else h) % n][b.hex().upper()] = r
    return F.from_json(F.lit(json.dumps(maps)), "array<map<string,int>>")


def fold_words(words: DataFrame, ranks: dict[bytes, int], word_col: str = "word", buckets: int = 1 << 14) -> DataFrame:
    """`words` plus ids array<int>, by higher-order functions alone. Each round of the fold merges the
    leftmost pair of lowest rank, in hex; a word of b bytes has at most b - 1 rounds."""
    table = rank_buckets(ranks, buckets)

    def rank(h: Column) -> Column:
        return F.element_at(table[F.pmod(F.xxhash64(h), F.lit(buckets)).cast("int")], h)

    raw = F.hex(F.encode(F.col(f"`{word_col}`"), "utf-8"))
    start = F.when(F.length(raw) == 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(raw) / 2, F.lit(1)).cast("int")), lambda i: F.substring(raw, i * 2 - 1, F.lit(2)))
    )

    def merge(acc: Column, _: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.size(acc) - 1), lambda i: F.struct(rank(F.concat(F.element_at(acc, i), F.element_at(acc, i + 1))).alias("r"), i.alias("i")))
        best = F.when(F.size(acc) > 1, F.array_min(F.filter(pairs, lambda p: p["r"].isNotNull())))
        return F.when(best.isNull(), acc).otherwise(
            F.flatten(F.array(
                F.slice(acc, F.lit(1), best["i"] - 1),
                F.array(F.concat(F.element_at(acc, best["i"]), F.element_at(acc, best["i"] + 1))),
                F.slice(acc, best["i"] + 2, F.greatest(F.size(acc) - best["i"] - 1, F.lit(0))),
            ))
        )

    folded = F.aggregate(F.slice(start, F.lit(2), F.size(start)), start, merge)
    return words.withColumn("ids", F.transform(folded, rank))
