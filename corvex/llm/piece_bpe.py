"""SentencePiece BPE with byte fallback: encoding by a table of prefixes, decoding by joining pieces.

Every prefix of a text has an encoding of its own, and that encoding has one last piece. The table stores it prefix by
prefix: an automaton over the vocabulary gives the pieces that end at a character, and the one is right that is
compatible with the last piece of the prefix before it, that is, the two come back as the same two when they are
encoded together. If no longer piece fits, the character itself is the last piece. The ids are then read backwards
through the table. Time is linear in the text, as pieces are short and tests of pairs are remembered.

Where no piece of the vocabulary has a space mark after another character, no piece spans two words. The texts of an
Arrow batch then share the work: their distinct words are looked up in a cache bounded by bytes, and new short words fill
their tables side by side, a character of each word a round, in numpy.

Defined results: null and empty texts have no tokens and decode to an empty text; the space mark U+2581 in a text is a
space, as the model defines it; strings of control pieces are ordinary text; characters that are no piece become their
UTF-8 bytes; repeated rows are encoded one by one; texts of any length are encoded whole; an empty table gives an empty
one. Other columns are kept, and one named like a result (`ids`, `decoded`) is replaced.
"""

from __future__ import annotations

import codecs
import re
import struct
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain, groupby

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, ranges

MARK = "\u2581"
SHORT = 48  # characters; longer words are not remembered
CACHE_BYTES = 48 << 20  # of words
SLOT_BITS = 21  # of tests of pairs that a worker remembers; a new one takes the place of an old
PAIRS = 100_000  # those of long words
TEXT_BYTES = 1 << 20  # of texts encoded side by side; a longer text is alone
SEPARATORS = [chr(c) for c in range(0xFDD0, 0xFDF0)]  # no characters; one that the texts lack parts their words
_WORDS = re.compile(f"{chr(0x2581)}+[^{chr(0x2581)}]*|[^{chr(0x2581)}]+").findall
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # kinds of pieces in a model file
BPE = 2  # kind of model
UNKNOWN_TEXT = " ⁇ "


def _one_for_each(e: UnicodeDecodeError) -> tuple[str, int]:
    return "�", e.start + 1


codecs.register_error("corvex-each", _one_for_each)


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol buffer's fields."""
    i = 0

    def number() -> int:
        nonlocal i
        n = shift = 0
        while True:
            c = b[i]
            i += 1
            n |= (c & 127) << shift
            shift += 7
            if c < 128:
                return n

    while i < len(b):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, b[i : i + n]
            i += n


class Model:
    """Pieces, scores and kinds of a model file. A model that the table of prefixes does not serve is refused."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            parts = list(_fields(f.read()))
        found = [dict(_fields(x)) for n, x in parts if n == 1]
        self.pieces = [p[1].decode() for p in found]
        self.scores = [struct.unpack("<f", p.get(2, b"\0\0\0\0"))[0] for p in found]
        self.kinds = [p.get(3, NORMAL) for p in found]
        train = dict(_fields(next((x for n, x in parts if n == 2), b"")))
        normal = dict(_fields(next((x for n, x in parts if n == 3), b"")))
        self.prefix = bool(normal.get(3, 1))
        self.unknown_text = train[44].decode() if 44 in train else UNKNOWN_TEXT
        odd = [
            (train.get(3, 1) != BPE, "is no BPE model"), (bool(normal.get(2)), "maps characters"), (bool(normal.get(4, 1)), "drops spaces"),
            (not normal.get(5, 1), "does not mark spaces"), (bool(train.get(24)), "marks spaces after words"), (not train.get(35), "has no byte fallback"),
            (not set(self.kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE}, "has pieces of users or unused ones"),
        ]
        for wrong, what in odd:
            if wrong:
                raise ValueError(f"{path} {what}")


class Codec:
    def __init__(self, path: str):
        m = self.model = Model(path)
        self.id = {p: i for i, (p, k) in enumerate(zip(m.pieces, m.kinds)) if k == NORMAL}
        self.rank = {p: -m.scores[i] for p, i in self.id.items() if len(p) > 1}  # lower is merged first
        self.byte = [0] * 256
        for i, (p, k) in enumerate(zip(m.pieces, m.kinds)):
            if k == BYTE:
                self.byte[int(p[1:-1], 16)] = i
        self.across = any(MARK in p.lstrip(MARK) for p in self.id)
        self.known: dict[str, bytes] = {}
        self.room = CACHE_BYTES
        self.tested: dict[tuple[str, str], bool] = {}
        text = {NORMAL: lambda p: p.replace(MARK, " ").encode(), BYTE: lambda p: bytes([int(p[1:-1], 16)]), UNKNOWN: lambda p: m.unknown_text.encode(), CONTROL: lambda p: b""}
        self.surface = [text[k](p) for p, k in zip(m.pieces, m.kinds)]
        self.blob = np.frombuffer(b"".join(self.surface), np.uint8)
        self.surface_size = np.array([len(x) for x in self.surface], np.int64)
        self.surface_at = np.cumsum(self.surface_size) - self.surface_size
        self.strange = np.array([k in (UNKNOWN, CONTROL) for k in m.kinds])
        self.marked = np.array([k == NORMAL and p.startswith(MARK) for p, k in zip(m.pieces, m.kinds)])

    # what encoding alone needs is made when it is asked for, as other workers decode

    @cached_property
    def folds(self) -> dict[str, tuple[list[float], list[str], list[str]]]:
        """How the pieces come about that come back as themselves."""
        return {p: f for p in self.rank if (f := self._fold(p))}

    @cached_property
    def ends(self):
        """The automaton of these pieces; a match tells id and length."""
        found = ahocorasick.Automaton()
        for p in self.folds:
            found.add_word(p, self.id[p] << 8 | len(p))
        if self.folds:
            found.make_automaton()
        return found

    @cached_property
    def pair(self) -> np.ndarray:
        return np.full(1 << SLOT_BITS, -1, np.int64)

    @cached_property
    def pair_fits(self) -> np.ndarray:
        return np.zeros(1 << SLOT_BITS, bool)

    def _fold(self, piece: str) -> tuple[list[float], list[str], list[str]] | None:
        """Ranks of the merges that make the piece, in order, and its first and its last part before each and at the
        end; None if merging does not end with the piece."""
        x, ranks, first, last = list(piece), [], [piece[0]], [piece[-1]]
        while len(x) > 1:
            r, i = min((self.rank.get(x[i] + x[i + 1], float("inf")), i) for i in range(len(x) - 1))
            if r == float("inf"):
                return None
            x[i : i + 2] = [x[i] + x[i + 1]]
            ranks.append(r)
            first.append(x[0])
            last.append(x[-1])
        return ranks, first, last

    def compatible(self, a: str, b: str) -> bool:
        """Whether a followed by b is encoded as those two. Merges within a and within b take turns by rank; a merge
        across the border, if there is one, must never be due: a's next goes before it at the same rank, b's after."""
        ranks_a, _, last = self.folds.get(a) or ((), (), (a,))
        ranks_b, first, _ = self.folds.get(b) or ((), (b,), ())
        i = j = 0
        while True:
            across = self.rank.get(last[i] + first[j])
            more_a, more_b = i < len(ranks_a), j < len(ranks_b)
            if across is not None and (not more_a or across < ranks_a[i]) and (not more_b or across <= ranks_b[j]):
                return False
            if more_a and (not more_b or ranks_a[i] <= ranks_b[j]):
                i += 1
            elif more_b:
                j += 1
            else:
                return True

    def _fits(self, a: str, b: str) -> bool:
        key = (a, b)
        ok = self.tested.get(key)
        if ok is None:
            if len(self.tested) >= PAIRS:
                self.tested.clear()
            ok = self.tested[key] = self.compatible(a, b)
        return ok

    def last_pieces(self, word: str) -> list[str]:
        """The last piece of the encoding of each prefix but the empty one."""
        table: list[str] = []
        for end, found in self.ends.iter(word) if self.folds else ():
            piece, done = self.model.pieces[found >> 8], len(table)
            if done > end:
                continue
            if done < end:
                table += word[done:end]
            before = end - len(piece)
            if before < 0 or self._fits(table[before], piece):
                table.append(piece)
        table += word[len(table) :]
        return table

    def encode_word(self, word: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        table, at, out = self.last_pieces(word), len(word) - 1, []
        while at >= 0:
            piece = table[at]
            at -= len(piece)
            i = self.id.get(piece)
            if i is None:
                out.extend(self.byte[v] for v in reversed(piece.encode("utf-8", "surrogatepass")))
            else:
                out.append(i)
        return np.array(out[::-1], "<i4").tobytes()

    def _fit_all(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """`compatible` of pairs of codes; a code is an id, or for a character that is no piece its number behind all ids."""
        key = a << 24 | b
        slot = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        hit = self.pair[slot] == key
        ok = self.pair_fits[slot]
        if not hit.all():
            new, back = np.unique(key[~hit], return_inverse=True)
            found = np.array([self.compatible(self._piece(k >> 24), self._piece(k & 0xFFFFFF)) for k in new.tolist()], bool)
            ok[~hit] = found[back]
            self.pair[slot[~hit]], self.pair_fits[slot[~hit]] = key[~hit], ok[~hit]
        return ok

    def _piece(self, code: int) -> str:
        return self.model.pieces[code] if code < len(self.model.pieces) else chr(code - len(self.model.pieces))

    def encode_words(self, words: list[str]) -> list[bytes]:
        """`encode_word` of many words of at most SHORT characters, their tables filled side by side."""
        flat, n = "".join(words), np.array([len(w) for w in words])
        begin = np.cumsum(n) - n
        char = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        kinds, at = np.unique(char, return_inverse=True)
        table = np.array([self.id.get(chr(c), c + len(self.model.pieces)) for c in kinds.tolist()], np.int64)[at]
        length = np.ones(len(char), np.int64)
        found = np.fromiter(chain.from_iterable(self.ends.iter(flat)) if self.folds else (), np.int64).reshape(-1, 2)
        end, code, size = found[:, 0], found[:, 1] >> 8, found[:, 1] & 255
        offset = end - np.repeat(begin, n)[end]
        inside = size <= offset + 1
        end, code, size, offset = end[inside], code[inside], size[inside], offset[inside]
        by = np.argsort(offset, kind="stable")
        end, code, size, offset = end[by], code[by], size[by], offset[by]
        cut = np.searchsorted(offset, np.arange(SHORT + 1)).tolist()
        for a, z in zip(cut, cut[1:]):
            if a == z:
                continue
            e, c, s = end[a:z], code[a:z], size[a:z]
            ok = s == offset[a] + 1
            rest = np.flatnonzero(~ok)
            ok[rest] = self._fit_all(table[e[rest] - s[rest]], c[rest])
            table[e[ok]], length[e[ok]] = c[ok], s[ok]
        used, pos, low = np.zeros(len(char), bool), (begin + n - 1)[n > 0], begin[n > 0]
        while len(pos):
            used[pos] = True
            pos = pos - length[pos]
            more = pos >= low
            pos, low = pos[more], low[more]
        code, of = table[used], np.repeat(np.arange(len(words)), n)[used]
        odd = np.flatnonzero(code >= len(self.model.pieces))
        if len(odd):
            as_bytes = [[self.byte[v] for v in chr(c - len(self.model.pieces)).encode("utf-8", "surrogatepass")] for c in code[odd].tolist()]
            times = np.ones(len(code), np.int64)
            times[odd] = [len(x) for x in as_bytes]
            where = ranges((np.cumsum(times) - times)[odd], times[odd])
            code, of = np.repeat(code, times), np.repeat(of, times)
            code[where] = list(chain.from_iterable(as_bytes))
        ends = (np.cumsum(np.bincount(of, minlength=len(words))) * 4).tolist()
        out = code.astype("<i4").tobytes()
        return [out[a:z] for a, z in zip([0, *ends], ends)]

    def _ids(self, words: list[str]) -> list[bytes]:
        out = list(map(self.known.get, words))
        new = [k for k, x in enumerate(out) if x is None]
        short = [k for k in new if len(words[k]) <= SHORT]
        for k, x in zip(short, self.encode_words([words[k] for k in short]) if short else ()):
            out[k] = x
        for k in new:
            if out[k] is None:
                out[k] = self.encode_word(words[k])
        self._remember({words[k]: out[k] for k in short})
        return out

    def cut(self, texts: pa.Array) -> pa.ListArray:
        """Texts with their spaces marked, as words; some may be empty."""
        t = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), " ", MARK)
        if self.model.prefix:
            mark = pc.if_else(pc.equal(pc.binary_length(t), 0), pa.scalar("", pa.large_string()), pa.scalar(MARK, pa.large_string()))
            t = pc.binary_join_element_wise(mark, t, pa.scalar("", pa.large_string()))
        if self.across:
            return pa.ListArray.from_arrays(pa.array(np.arange(len(t) + 1), pa.int32()), t)
        free = next((s for s in SEPARATORS if not pc.any(pc.match_substring(t, s)).as_py()), None)
        if free is None:
            return pa.array([_WORDS(x) for x in t.to_pylist()], pa.list_(pa.large_string()))
        return pc.split_pattern(pc.replace_substring_regex(t, f"({MARK}+)", free + "\\1"), free)

    def encode_all(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each text."""
        lists = self.cut(texts)
        offsets = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        ids = self._ids(coded.dictionary.to_pylist())
        size = np.array([len(x) >> 2 for x in ids], np.int64)
        word = coded.indices.to_numpy(zero_copy_only=False)
        flat = np.frombuffer(b"".join(ids), "<i4")[ranges((np.cumsum(size) - size)[word], size[word])]
        ends = np.append(0, np.cumsum(size[word]))[offsets - offsets[0]]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all(pa.array([text], pa.string()))[0].as_py()

    def _remember(self, new: dict[str, bytes]) -> None:
        size = sum(2 * len(w) + len(x) + 160 for w, x in new.items())  # and the objects around them
        self.room -= size
        if self.room < 0:
            self.known, self.room = {}, CACHE_BYTES - size
        self.known.update(new)

    def decode(self, ids: list[int] | None) -> str:
        """Ids outside the vocabulary are unknown pieces; bytes that are no UTF-8 become U+FFFD one by one."""
        top, unknown = len(self.surface), self.model.kinds.index(UNKNOWN)
        ids = [i if i is not None and 0 <= i < top else unknown for i in ids or ()]
        text = "".join(
            b"".join(map(self.surface.__getitem__, run)).decode("utf-8", "corvex-each" if is_byte else "strict")
            for is_byte, run in groupby(ids, lambda i: self.model.kinds[i] == BYTE)
        )
        first = next((i for i in ids if self.model.kinds[i] != CONTROL), None)
        marked = self.model.prefix and first is not None and self.model.kinds[first] == NORMAL and text[:1] == " "
        return text[1:] if marked else text

    def decode_all(self, lists: pa.ListArray) -> pa.Array:
        """`decode` of each list: the pieces of all lists are joined at once, and lists with bytes that are no text,
        unknown or control pieces one by one."""
        offsets, ids = lists.offsets.to_numpy(), lists.flatten()
        offsets = (offsets - offsets[0]).astype(np.int64)
        if lists.null_count or ids.null_count or not len(ids):
            return pa.array([self.decode(x) for x in lists.to_pylist()], pa.large_string())
        ids = ids.to_numpy()
        wild = (ids < 0) | (ids >= len(self.surface))
        ids = np.where(wild, 0, ids)
        slow = np.diff(np.append(0, np.cumsum(wild | self.strange[ids]))[offsets]) > 0
        size, at = self.surface_size[ids], self.surface_at[ids]
        if self.model.prefix:  # the first piece of a list loses its mark
            first = offsets[:-1][np.diff(offsets) > 0]
            first = first[self.marked[ids[first]]]
            size[first] -= 1
            at[first] += 1
        blob = self.blob[ranges(at, size)]
        ends = np.append(0, np.cumsum(size))[offsets]
        raw = blob.tobytes()
        starts = ends[:-1][np.diff(ends) > 0]
        if not _is_text(raw) or ((blob[starts] & 0xC0) == 0x80).any():  # a list's bytes may go on with the next one's
            slow |= np.array([not _is_text(raw[a:z]) for a, z in zip(ends[:-1].tolist(), ends[1:].tolist())])
        whole = pa.LargeStringArray.from_buffers(len(lists), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw))
        if not slow.any():
            return whole
        return pa.array([self.decode(lists[k].as_py()) if s else whole[k].as_py() for k, s in enumerate(slow.tolist())], pa.large_string())


def _is_text(b: bytes) -> bool:
    try:
        b.decode()
        return True
    except UnicodeDecodeError:
        return False


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, path: str, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """`carry` (default: all columns) plus ids array<int>."""
    cols = docs.columns if carry is None else carry
    return map_arrow(docs, F.col(f"`{text_col}`").cast("string"), cols, [("ids", "array<int>")], lambda: lambda x: [codec(path).encode_all(x)], TEXT_BYTES)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", carry: list[str] | None = None) -> DataFrame:
    """`carry` (default: all columns) plus decoded string; null ids give an empty text."""
    cols = encoded.columns if carry is None else carry
    return map_arrow(encoded, F.col(f"`{ids_col}`"), cols, [("decoded", "string")], lambda: lambda x: [codec(path).decode_all(x)], TEXT_BYTES // 4)
