"""Exact substring dedup with suffix arrays over shards.

A byte goes if a string of WIDTH bytes that covers it also starts in a document with a smaller id. Equal
strings must meet in one shard whatever their place, so a string's shard is that of its smallest K-byte hash
(its anchor), and neighbouring strings with one anchor travel as one stretch. Three passes over documents
dealt into chunks by a hash of the id:

1. each chunk's distinct anchors go to shards, which tell the chunks what anchors occur in two documents;
2. stretches under such anchors, each distinct content of a chunk once with its smallest id, go to shards.
   Equal contents are one there. Contents that share an anchor and SIDE bytes beside it with another content go
   into a suffix array made by induced sorting, and its permuted common prefixes cut it into classes of suffixes
   that share WIDTH bytes; the others share no string, so each string's class is that of the content. A class's
   smallest id goes back to the chunks;
3. chunks mark the strings whose class has a smaller id than the document, and cut the bytes out.

Hash collisions of anchors only bring more stretches to compare. However many copies a passage has, a chunk
sends it once. An anchor in very many contexts (HOT_CHUNKS, HOT_CONTEXTS) does not bring them to one shard: its
strings travel one by one, to the shards of their own hashes. An anchor in many chunks, but few contexts, is none of
these. Nothing is collected or broadcast.

Defined results: null and empty texts and texts under WIDTH bytes lose nothing; rows with the same id never
lose bytes to each other; a null id counts as larger than all others; rows come out as often as they went in.
Chunks are dealt by id and text, so rows without an id, or with one and the same, are spread like others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MAX_ID, arrow_schema, input_bytes, release
from .suffix_array import common_prefixes, suffix_array

WIDTH = 50
K = 24
SIDE = (WIDTH - K) // 2  # an equal string goes on for so many bytes left or right of its anchor
SPAN = WIDTH - K + 1  # anchors are the smallest of so many hashes
STRETCH = 64  # strings in one stretch at most
HOT_CHUNKS, HOT_CONTEXTS = 512, 256  # an anchor in more contexts of one chunk, or than so many chunks of them can have, is hot
FEW, HOT = 16, 15  # an anchor in so few places of a chunk is taken to have a context each; the level of one that is hot
PIECE = 1 << 17  # bytes hashed at a time
CHUNK_BYTES = 4 << 20  # of stored input in a chunk; texts take about twice that
LEAST_CHUNKS = 64
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _hashes(b: np.ndarray, k: int = K) -> np.ndarray:
    """A hash of the k bytes from each position on, joined from those of powers of two."""
    cur, step, mul = (b.astype(np.uint64) + np.uint64(1)) * _MIX, 1, 0x9E3779B97F4A7C15
    out, done = None, 0
    while k >= step:
        if k & step:
            n = len(b) - done - step + 1
            out = cur.copy() if out is None else out[:n] * np.uint64(mul) + cur[done : done + n]
            done += step
        if k >= 2 * step:
            cur = cur[:-step] * np.uint64(mul) + cur[step:]
        step, mul = 2 * step, mul * mul % (1 << 64)
    out ^= out >> np.uint64(29)
    out *= _MIX
    out ^= out >> np.uint64(32)
    return out


def _window_min(h: np.ndarray, span: int) -> np.ndarray:
    step = 1
    while step * 2 <= span:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    rest = span - step
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def stretches(texts: list[bytes]):
    """Yields, for pieces of the texts: the piece's bytes, and of its stretches the text's number, the place
    in the piece, the place in the text, the number of strings and the anchor."""
    batch: list[tuple[int, int, bytes]] = []
    size = 0
    for i, t in enumerate(texts):
        for at in range(0, max(len(t) - WIDTH + 1, 0), PIECE):
            piece = t[at : at + PIECE + WIDTH - 1]
            batch.append((i, at, piece))
            size += len(piece)
            if size >= PIECE:
                yield _stretches(batch)
                batch, size = [], 0
    if batch:
        yield _stretches(batch)


def _stretches(batch):
    joined = b"".join(p for _, _, p in batch)
    size = np.array([len(p) for _, _, p in batch])
    start = np.cumsum(size) - size
    m = _window_min(_hashes(np.frombuffer(joined, np.uint8)), SPAN)
    ok = np.ones(len(joined), bool)
    for back in range(1, WIDTH):
        ok[start + size - back] = False
    ok = ok[: len(m)]
    new = np.ones(len(m) + 1, bool)
    new[1:-1] = m[1:] != m[:-1]
    new[:-1] |= ~ok
    new[start[start < len(m)]] = True
    cut = np.flatnonzero(new)
    first, n = cut[:-1], np.diff(cut)
    keep = ok[first]
    first, n = first[keep], n[keep]
    if len(n) and n.max() > STRETCH:
        reps = -(-n // STRETCH)
        part = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        first, n = np.repeat(first, reps) + part * STRETCH, np.minimum(np.repeat(n, reps) - part * STRETCH, STRETCH)
    which = np.searchsorted(start, first, side="right") - 1
    text = np.array([i for i, _, _ in batch])[which]
    place = first - start[which] + np.array([a for _, a, _ in batch])[which]
    return joined, text, first, place, n, m[first]


def _key(anchor: np.ndarray, bits: int) -> np.ndarray:
    """Anchors are small hashes; mixed and cut to `bits` bits, they spread evenly and pack well."""
    return (anchor * _MUL) >> np.uint64(64 - bits)


def _shard(keys: np.ndarray, bits: int, shards: int) -> np.ndarray:
    """By ranges of the keys."""
    return ((keys >> np.uint64(max(bits - 32, 0))) * np.uint64(shards) >> np.uint64(min(bits, 32))).astype(np.int64)


def _member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Whether each value is in sorted `among`."""
    if not len(among):
        return np.zeros(len(values), bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def _chunk_rows(t: pa.Table):
    """Ids, texts as bytes and the rows' numbers, in an order that depends on nothing but the rows."""
    ids = [MAX_ID if x is None else x for x in t.column("_cx_id").to_pylist()]
    texts = [(x or "").encode("utf-8", "surrogatepass") for x in t.column("_cx_text").to_pylist()]
    order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
    return [ids[i] for i in order], [texts[i] for i in order], order


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) or [()] * len(schema)
    return pa.table([pa.array(c, type=f.type) for c, f in zip(cols, schema)], schema=schema)


def _pack(keys: np.ndarray) -> bytes:
    """Sorted keys: the first, the width of the largest gap in bytes, and the gaps."""
    gaps = np.diff(keys).astype("<u8")
    w = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    return keys[:1].astype("<u8").tobytes() + bytes([w]) + np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8)[:, :w]).tobytes()


def _unpack(b: bytes, n: int) -> tuple[np.ndarray, int]:
    """n keys, and where they end."""
    w = b[8]
    out = np.zeros((n, 8), np.uint8)
    out[1:, :w] = np.frombuffer(b, np.uint8, (n - 1) * w, 9).reshape(n - 1, w)
    out[0] = np.frombuffer(b, np.uint8, 8)
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64), 9 + (n - 1) * w


ANCHORS = pa.schema([("shard", pa.int64()), ("chunk", pa.int64()), ("blob", pa.binary()), ("n", pa.int64())])
REPLY = pa.schema([("chunk", pa.int64()), ("kind", pa.int64()), ("blob", pa.binary()), ("n", pa.int64())])
ANCHORS_DDL, REPLY_DDL = "shard bigint, chunk bigint, blob binary, n bigint", "chunk bigint, kind bigint, blob binary, n bigint"


def _send_anchors(shards: int, bits: int):
    def run(key, t):
        release()
        ids, texts, _ = _chunk_rows(t)
        found, owner, contexts = [], [], []
        for joined, text, first, _, n, anchor in stretches(texts):
            found.append(_key(anchor, bits))
            owner.append(text)
            h = _hashes(np.frombuffer(joined, np.uint8))
            contexts.append((h[first] * _MUL + h[first + n - 1 + WIDTH - K]) * _MUL + n.astype(np.uint64))
        if not found:
            return _table(ANCHORS, [])
        a, own, context = np.concatenate(found), np.array(ids, np.int64)[np.concatenate(owner)], np.concatenate(contexts)
        order = np.argsort(a, kind="stable")
        a, own = a[order], own[order]
        first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        several = np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first)
        size = np.diff(np.append(first, len(a)))
        level = np.ceil(np.log2(np.minimum(size, FEW))).astype(np.uint8)
        for k in np.flatnonzero(size > min(FEW, HOT_CONTEXTS)):  # few
            n = len(np.unique(context[order[first[k] : first[k] + size[k]]]))
            level[k] = HOT if n > HOT_CONTEXTS else (n - 1).bit_length()
        a = a[first]
        s = _shard(a, bits, shards)
        cuts = np.flatnonzero(np.append(True, np.diff(s) != 0)).tolist() + [len(s)]
        chunk = key[0].as_py()
        return _table(ANCHORS, [(int(s[x]), chunk, _pack(a[x:y]) + np.packbits(several[x:y]).tobytes() + _nibbles(level[x:y]), y - x) for x, y in zip(cuts, cuts[1:])])

    return run


def _match_anchors(key, t):
    release()
    blobs, chunks, ns = (t.column(c).to_pylist() for c in ("blob", "chunk", "n"))
    parts, flags, levels = [], [], []
    for b, n in zip(blobs, ns):
        keys, at = _unpack(b, n)
        parts.append(keys)
        flags.append(_bits(b, n, at))
        levels.append(_of_nibbles(b, n, at + (n + 7) // 8))
    a, several, level = np.concatenate(parts), np.concatenate(flags), np.concatenate(levels)
    source = np.repeat(np.arange(len(ns)), ns)
    order = np.argsort(a, kind="stable")
    a, several, level, source = a[order], several[order], level[order], source[order]
    first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
    size = np.diff(np.append(first, len(a)))
    hit = np.repeat((size > 1) | np.logical_or.reduceat(several, first), size)
    contexts = np.add.reduceat(np.left_shift(1, level.astype(np.int64)), first)  # as many at most, up to twice
    hot = np.repeat((contexts > HOT_CHUNKS * HOT_CONTEXTS) | np.logical_or.reduceat(level == HOT, first), size)
    a, source, hot = a[hit], source[hit], hot[hit]
    by = np.argsort(source, kind="stable")  # and so sorted within each
    a, hot, cuts = a[by], hot[by], np.searchsorted(source[by], np.arange(len(ns) + 1))
    return _table(REPLY, [(chunks[i], 0, _pack(a[x:y]) + np.packbits(hot[x:y]).tobytes(), int(y - x)) for i, (x, y) in enumerate(zip(cuts, cuts[1:])) if y > x])


def _bits(b: bytes, n: int, at: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b, np.uint8, (n + 7) // 8, at), count=n).astype(bool)


def _nibbles(x: np.ndarray) -> bytes:
    x = np.append(x, np.zeros(len(x) % 2, np.uint8))
    return (x[::2] | x[1::2] << np.uint8(4)).tobytes()


def _of_nibbles(b: bytes, n: int, at: int) -> np.ndarray:
    x = np.frombuffer(b, np.uint8, (n + 1) // 2, at)
    return np.stack([x & np.uint8(15), x >> np.uint8(4)], 1).ravel()[:n]


def _anchors_of(replies: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted anchors that two documents have, and those of them that are hot."""
    rows = zip(*(replies.column(c).to_pylist() for c in ("kind", "blob", "n")))
    found, hot = [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
    for k, b, n in rows:
        if k == 0:
            keys, at = _unpack(b, n)
            found.append(keys)
            hot.append(_bits(b, n, at))
    keys, hot = np.concatenate(found), np.concatenate(hot)
    return np.unique(keys), np.unique(keys[hot])


def _contents(texts: list[bytes], told: tuple[np.ndarray, np.ndarray], bits: int):
    """Distinct contents of stretches under wanted anchors in order of first sight, with anchor and number
    of strings, and all such stretches as (content number, text number, place). The strings under a hot anchor
    are contents of their own, with their own hash in the anchor's place."""
    wanted, hot = told
    seen: dict[bytes, int] = {}
    anchors, sizes, which, owner, places = [], [], [], [], []
    for joined, text, first, place, n, anchor in stretches(texts):
        anchor = _key(anchor, bits)
        sel = np.flatnonzero(_member(anchor, wanted))
        first, n, anchor, text, place = first[sel], n[sel], anchor[sel], text[sel], place[sel]
        split = _member(anchor, hot)
        if split.any():
            many = np.where(split, n, 1)
            step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            first, place, text = np.repeat(first, many) + step, np.repeat(place, many) + step, np.repeat(text, many)
            split = np.repeat(split, many)
            whole = _key(_hashes(np.frombuffer(joined, np.uint8), WIDTH), bits)
            n, anchor = np.where(split, 1, np.repeat(n, many)), np.where(split, whole[np.minimum(first, len(whole) - 1)], np.repeat(anchor, many))
        f, c, a = first, n.tolist(), anchor.tolist()
        nums = []
        for at, cnt, anc in zip(f.tolist(), c, a):
            content = joined[at : at + cnt + WIDTH - 1]
            k = seen.get(content)
            if k is None:
                k = seen[content] = len(seen)
                anchors.append(anc)
                sizes.append(cnt)
            nums.append(k)
        which.append(np.array(nums, np.int64))
        owner.append(text)
        places.append(place)
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return list(seen), np.array(anchors, np.uint64), np.array(sizes, np.int64), cat(which), cat(owner), cat(places)


def _low_ids(count: int, which: np.ndarray, owner: np.ndarray, ids: list[int]) -> np.ndarray:
    """The smallest id that has each content."""
    low = np.full(count, MAX_ID, np.int64)
    np.minimum.at(low, which, np.array(ids, np.int64)[owner])
    return low


_HEAD = np.dtype([("no", "<u4"), ("size", "<u2"), ("low", "<i8")])
_BACK = np.dtype([("no", "<u4"), ("at", "<u2"), ("size", "<u2"), ("low", "<i8")])


def _send_contents(shards: int, bits: int):
    def run(key, left, right):
        release()
        ids, texts, _ = _chunk_rows(left)
        seen, anchors, sizes, which, owner, _ = _contents(texts, _anchors_of(right), bits)
        if not seen:
            return _table(ANCHORS, [])
        low = _low_ids(len(seen), which, owner, ids)
        s = _shard(anchors, bits, shards)
        by = np.argsort(s, kind="stable")
        cuts = np.flatnonzero(np.append(True, np.diff(s[by]) != 0)).tolist() + [len(by)]
        rows, chunk = [], key[0].as_py()
        for x, y in zip(cuts, cuts[1:]):
            nos = by[x:y]
            head = np.empty(len(nos), _HEAD)
            head["no"], head["size"], head["low"] = nos, sizes[nos] + WIDTH - 1, low[nos]
            rows.append((int(s[nos[0]]), chunk, head.tobytes() + b"".join(seen[i] for i in nos.tolist()), len(nos)))
        return _table(ANCHORS, rows)

    return run


def _may_share(contents: list[bytes]) -> np.ndarray:
    """Numbers of the contents that may share a string with another: two strings of WIDTH bytes are equal only
    if their anchors are and the SIDE bytes left or right of them."""
    size = np.array([len(c) for c in contents])
    joined, start = np.frombuffer(b"".join(contents), np.uint8), np.cumsum(size) - size
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    h = np.append(_hashes(joined), np.full(K - 1, top))
    for back in range(1, K):
        h[start + size - back] = top
    low = np.minimum.reduceat(h, start)
    at = np.flatnonzero(h == np.repeat(low, size))
    owner = np.searchsorted(start, at, side="right") - 1
    times = np.bincount(owner, minlength=len(contents))
    anchor = at[np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))]
    wide = _hashes(joined, K + SIDE)
    right, left = anchor + K + SIDE <= start + size, anchor - SIDE >= start
    keys = np.concatenate([wide[anchor[right]], ~wide[anchor[left] - SIDE]])
    of = np.concatenate([np.flatnonzero(right), np.flatnonzero(left)])
    _, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
    keep = times > 1  # with an anchor that repeats, its place tells nothing
    keep[of[count[inverse] > 1]] = True
    return np.flatnonzero(keep)


def class_lows(contents: list[bytes], low: np.ndarray) -> list[np.ndarray]:
    """For each content, the smallest id by string: that of the class of equal WIDTH-byte strings."""
    size = np.array([len(c) for c in contents])
    joined = b"\0".join(c.replace(b"\0", b"\xff") for c in contents) + b"\0"  # \xff is in no UTF-8 text
    raw = np.frombuffer(joined, np.uint8)
    start = np.cumsum(size + 1) - size - 1
    # separators become distinct from the last symbol, which alone is 0
    s = raw.astype(np.uint16) + np.uint16(1)
    s[-1] = 0
    sa = suffix_array(s)
    prefix = common_prefixes(raw, sa)
    owner = np.repeat(np.arange(len(contents)), size + 1)
    left = (start + size)[owner] - np.arange(len(raw))
    sa = sa[left[sa] >= WIDTH]
    # suffixes in between are shorter than WIDTH and separate no class: a class's members are neighbours
    new = prefix[sa] < WIDTH
    new[0] = True
    group = np.cumsum(new) - 1
    best = np.minimum.reduceat(low[owner[sa]], np.flatnonzero(new))
    out = np.empty(len(raw), np.int64)
    out[sa] = best[group]
    return [out[a : a + n - WIDTH + 1] for a, n in zip(start.tolist(), size.tolist())]


def _match_contents(key, t):
    release()
    blobs, chunks, ns = (t.column(c).to_pylist() for c in ("blob", "chunk", "n"))
    heads, which, seen = [], [], {}
    for b, n in zip(blobs, ns):
        head = np.frombuffer(b, _HEAD, n)
        at = n * _HEAD.itemsize
        nums = []
        for size in head["size"].tolist():
            nums.append(seen.setdefault(b[at : at + size], len(seen)))
            at += size
        heads.append(head)
        which.append(np.array(nums, np.int64))
    head, num = np.concatenate(heads), np.concatenate(which)
    contents = list(seen)
    low = np.full(len(contents), MAX_ID, np.int64)
    np.minimum.at(low, num, head["low"])
    lows = [[(0, len(c) - WIDTH + 1, v)] for c, v in zip(contents, low.tolist())]  # runs of strings of one class's low
    several = _may_share(contents)
    if len(several):
        for i, x in zip(several.tolist(), class_lows([contents[i] for i in several.tolist()], low[several])):
            edges = [0, *(np.flatnonzero(x[1:] != x[:-1]) + 1).tolist(), len(x)]
            lows[i] = [(a, b - a, v) for a, b, v in zip(edges, edges[1:], x[edges[:-1]].tolist())]
    rows, at = [], 0
    for chunk, h in zip(chunks, heads):
        mine, at = num[at : at + len(h)].tolist(), at + len(h)
        back = [(no, a, n, v) for no, own, k in zip(h["no"].tolist(), h["low"].tolist(), mine) for a, n, v in lows[k] if v < own]
        if back:
            rows.append((chunk, 1, np.array(back, _BACK).tobytes(), len(back)))
    return _table(REPLY, rows)


def _cut(out: pa.Schema, carried: int, decoded: bool, bits: int):
    def run(key, left, right):
        release()
        ids, texts, order = _chunk_rows(left)
        seen, _, sizes, which, owner, places = _contents(texts, _anchors_of(right), bits)
        offset = np.cumsum(sizes) - sizes
        low = np.repeat(_low_ids(len(seen), which, owner, ids), sizes)  # by string of each content
        for blob, kind in zip(right.column("blob").to_pylist(), right.column("kind").to_pylist()):
            if kind == 1:
                back = np.frombuffer(blob, _BACK)
                at = np.repeat(offset[back["no"]] + back["at"] - np.cumsum(back["size"], dtype=np.int64) + back["size"], back["size"]) + np.arange(back["size"].sum(dtype=np.int64))
                low[at] = np.minimum(low[at], np.repeat(back["low"], back["size"]))
        own = np.array(ids, np.int64)
        hits: list[list[np.ndarray]] = [[] for _ in texts]
        if len(which):
            n = sizes[which]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            string = np.repeat(offset[which], n) + step
            text = np.repeat(owner, n)
            hit = low[string] < own[text]
            text, place = text[hit], (np.repeat(places, n) + step)[hit]
            by = np.argsort(text, kind="stable")
            text, place = text[by], place[by]
            cuts = np.flatnonzero(np.append(True, text[1:] != text[:-1])) if len(text) else []
            for a, b in zip(cuts, [*cuts[1:], len(text)]):
                hits[text[a]].append(place[a:b])
        rows: list = [None] * len(texts)
        for i, t in enumerate(texts):
            spans, kept = [], t
            if hits[i]:
                p = np.sort(hits[i][0])
                first = np.flatnonzero(np.append(True, p[1:] > p[:-1] + WIDTH))
                starts, stops = p[first], np.append(p[first[1:] - 1], p[-1]) + WIDTH
                spans = [{"start": int(a), "end": int(b)} for a, b in zip(starts, stops)]
                bounds = [0, *(x for s in spans for x in (s["start"], s["end"])), len(t)]
                kept = b"".join(t[a:b] for a, b in zip(bounds[::2], bounds[1::2]))
            rows[order[i]] = (len(t), len(t) - len(kept), spans, kept.decode("utf-8", "ignore") if decoded else kept)
        cols = list(zip(*rows))
        types = [f.type for f in out][carried:]
        carry = [left.column(f"_cx_c{i}").cast(out[i].type) for i in range(carried)]
        return pa.table([*carry, *[pa.array(c, type=x) for c, x in zip(cols, types)]], schema=out)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, decoded: bool = False) -> DataFrame:
    """`carry` (default: all columns) plus n_bytes, n_removed, spans (byte offsets) and kept: binary or, if
    `decoded`, a string without the remains of characters that were cut in two."""
    cols = [c for c in (docs.columns if carry is None else carry) if c not in ("n_bytes", "n_removed", "spans", "kept")]
    stored = input_bytes(docs, text_col)
    chunks = max(LEAST_CHUNKS, -(-stored // CHUNK_BYTES))
    bits = min(max(stored.bit_length() + 12, 33), 64)  # so that about one anchor in 10,000 coincides with another
    ident = F.col(f"`{id_col}`").cast("bigint")
    view = docs.select(
        F.pmod(F.xxhash64(ident, F.col(f"`{text_col}`")), F.lit(chunks)).alias("_cx_chunk"),
        ident.alias("_cx_id"),
        F.col(f"`{text_col}`").alias("_cx_text"),
        *[F.col(f"`{c}`").alias(f"_cx_c{i}") for i, c in enumerate(cols)],
    )
    dealt = view.repartition("_cx_chunk")
    lean = dealt.groupBy("_cx_chunk")
    sent = lean.applyInArrow(_send_anchors(chunks, bits), ANCHORS_DDL)
    shared = sent.groupBy("shard").applyInArrow(_match_anchors, REPLY_DDL)
    contents = lean.cogroup(shared.groupBy("chunk")).applyInArrow(_send_contents(chunks, bits), ANCHORS_DDL)
    lows = contents.groupBy("shard").applyInArrow(_match_contents, REPLY_DDL)
    fields = [T.StructField(c, view.schema[f"_cx_c{i}"].dataType) for i, c in enumerate(cols)]
    fields += [T.StructField(n, T.DataType.fromDDL(t)) for n, t in (("n_bytes", "bigint"), ("n_removed", "bigint"), ("spans", "array<struct<start:bigint,end:bigint>>"), ("kept", "string" if decoded else "binary"))]
    out = T.StructType(fields)
    replies = shared.unionByName(lows).groupBy("chunk")
    return lean.cogroup(replies).applyInArrow(_cut(arrow_schema(out), len(cols), decoded, bits), out)
