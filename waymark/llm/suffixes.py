"""Removal of repeated 50-byte strings by a distributed, prefix-aware merge sort of suffixes.

Not every suffix has to travel. Each 50-byte window has an anchor, the place of its 16-byte string with the least hash, so
equal windows have their anchor at the same place, and about one suffix in eighteen is enough. A task sorts the suffixes at
anchors, each with the bytes that its windows span, into runs; within a run, copies of a context in documents with larger
ids are removed at once, so a passage that a third of all documents share travels once per run. Runs are front-coded, each
suffix without the prefix that it shares with the one before, and exchanged by their keys.

A task that receives runs merges them with loser trees that carry each contender's known common prefix with the last
winner: only contenders that share as much as each other are compared, from there on. Many trees, each over a range of
keys, advance in step as arrays. The merged order and the prefixes that come with it decide what repeats: a window with l
bytes before its anchor and r = 50 - l from it on equals another one if no common prefix between their suffixes is shorter
than r and, in the same order of the bytes before the anchors read backwards, none is shorter than l. Nothing is decided by
hashes: they choose anchors and deal suffixes to tasks, and copies within a run are compared byte by byte.

Before that, one pass exchanges only the anchors' hashed keys, sorted and difference-coded at some three bytes each, and
marks those of more than one document in a bitmap. Suffixes whose key is unmarked cannot match and stay home. The bitmap
grows with the text up to a bound and only saves work: where it fills up, more suffixes travel and the result is the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import storage
from waymark.llm.kernels import BASE, U64, doc_blocks, mix, span_hashes, text_buffer, window_min

LENGTH, ANCHOR = 50, 16
#: Compared as words of 8 bytes, zeros behind the 50th.
WORDS = 7
BEFORE = LENGTH - ANCHOR
RUN_BYTES, KEY_RUN_BYTES = 16 << 20, 32 << 20
LANES, FAN_IN = 1024, 64
#: Suffixes whose windows are compared at once; a group of suffixes with one anchor is not divided.
SUFFIXES_AT_ONCE = 1 << 18
#: Bits of the bitmap of keys, over all parts: at least so many, one per 8 bytes of text, at most so many (128 MB).
LEAST_MARK_BITS, MOST_MARK_BITS = 20, 30
#: Bytes of text for which there is a part, at the least; the session's shuffle partitions ask for more on small inputs.
PART_BYTES = 32 << 20
NO_ID = np.iinfo(np.int64).max


def gram_hashes(raw: np.ndarray, size: int = ANCHOR) -> np.ndarray:
    """At i, a hash of raw[i : i + size]; size is a power of two."""
    h, have = raw.astype(U64) + U64(1), 1
    while have < size:
        h = h[:-have] * U64(pow(int(BASE), have, 1 << 64)) + h[have:]
        have *= 2
    return mix(h)


def anchors(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """row, first window, last window, anchor and the anchor's key hash, for every run of windows with one anchor."""
    z = np.zeros(0, np.int64)
    long = np.flatnonzero(np.diff(offsets) >= LENGTH)
    if not len(long):
        return z, z, z, z, z.view(U64)
    grams = gram_hashes(raw)
    bits = U64(max(1, int(len(raw)).bit_length()))
    packed = (grams >> bits << bits) | np.arange(len(grams), dtype=U64)
    least = (window_min(packed, LENGTH - ANCHOR + 1) & ((U64(1) << bits) - U64(1))).astype(np.int64)
    step = np.zeros(len(raw) + 1, np.int64)
    step[offsets[long]] += 1
    step[offsets[long + 1] - LENGTH + 1] -= 1
    p = np.flatnonzero(np.cumsum(step)[:-1] > 0)
    q = least[p]
    row = np.searchsorted(offsets, p, "right") - 1
    new = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (row[1:] != row[:-1])]))
    last = np.append(new[1:], len(p)) - 1
    return row[new], p[new], p[last], q[new], grams[q[new]]


def padded(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """Rows raw[start : start + size], filled with zeros to the width."""
    out = np.lib.stride_tricks.sliding_window_view(np.concatenate([raw, np.zeros(width, np.uint8)]), width)[starts]
    out[np.arange(width) >= sizes[:, None]] = 0
    return out


def as_words(rows: np.ndarray) -> np.ndarray:
    """Rows of a multiple of 8 bytes as numbers that compare alike."""
    return np.ascontiguousarray(rows).view(">u8").astype(U64)


def common_words(words: np.ndarray) -> np.ndarray:
    """How many words each row shares with the one before it; the first one none."""
    same = (words[1:] == words[:-1]).cumprod(axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
    return np.concatenate([np.zeros(min(1, len(words)), np.int64), same])


def order_by(*keys: np.ndarray) -> np.ndarray:
    """The rows' order by all keys, the first one first; the later ones only sort the rows that tie in three."""
    order = np.lexsort(keys[2::-1])
    if len(order) < 2:
        return order
    new = np.concatenate([[True], np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys[:3]])])
    tied = np.flatnonzero(~new | np.append(~new[1:], False))
    o = order[tied]
    order[tied] = o[np.lexsort((*[k[o] for k in keys[:2:-1]], np.cumsum(new)[tied]))]
    return order


def same_bytes(raw: np.ndarray, first: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether raw[first:end] of the entries a equals that of the entries b; none is longer than BEFORE + LENGTH."""
    size = end - first
    same = size[a] == size[b]
    for k in range(0, len(a), 1 << 17):
        x, y = (padded(raw, first[e], size[e], BEFORE + LENGTH) for e in (a[k : k + (1 << 17)], b[k : k + (1 << 17)]))
        same[k : k + (1 << 17)] &= (x == y).all(axis=1)
    return same


def flat(rows: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes rows[:, begin : size], one row after the other."""
    at = np.arange(rows.shape[1])
    return rows[(at >= begin[:, None]) & (at < sizes[:, None])]


class Run:
    """Sorted, front-coded suffixes of some documents, and their packed form."""

    FIELDS = (("shared", "u1"), ("right", "u1"), ("left", "u1"), ("row", "<u4"), ("place", "<u4"))

    @staticmethod
    def pack(rights: np.ndarray, right: np.ndarray, lefts: np.ndarray, left: np.ndarray, row: np.ndarray, place: np.ndarray, ids: np.ndarray, marks: np.ndarray) -> bytes:
        same = (rights[1:] == rights[:-1]).cumprod(axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
        shared = np.concatenate([[0], np.minimum(np.minimum(same, right[1:]), right[:-1])])
        used, row = np.unique(row, return_inverse=True)
        head = np.array([len(right), len(used)], "<i8").tobytes()
        cols = [v.astype(t).tobytes() for v, (_, t) in zip((shared, right, left, row, place), Run.FIELDS, strict=True)]
        return zstandard.ZstdCompressor(level=3).compress(b"".join([head, ids[used].astype("<i8").tobytes(), marks[used].astype("<i8").tobytes(), *cols, flat(rights, shared, right).tobytes(), flat(lefts, np.zeros_like(left), left).tobytes()]))

    def __init__(self, packed: bytes):
        data = zstandard.ZstdDecompressor().decompress(packed)
        n, m = np.frombuffer(data, "<i8", 2)
        self.ids, self.marks = np.frombuffer(data, "<i8", m, 16), np.frombuffer(data, "<i8", m, 16 + 8 * m)
        at = 16 + 16 * m
        col = {}
        for name, kind in self.FIELDS:
            col[name] = np.frombuffer(data, kind, n, at).astype(np.int64)
            at += n * np.dtype(kind).itemsize
        self.n, self.right, self.left, self.row, self.place = n, col["right"], col["left"], col["row"], col["place"]
        shared, wide = col["shared"], np.arange(WORDS * 8)
        rest = int((self.right - shared).sum())
        rights = np.zeros((n, WORDS * 8), np.uint8)
        rights[(wide >= shared[:, None]) & (wide < self.right[:, None])] = np.frombuffer(data, np.uint8, rest, at)
        # A byte within the shared prefix is that of the last suffix whose own bytes begin at or before it.
        nth = np.arange(n)
        for c in range(int(shared.max(initial=0))):
            rights[:, c] = rights[np.maximum.accumulate(np.where(shared <= c, nth, 0)), c]
        rights[wide >= self.right[:, None]] = 0
        self.words, self.lefts = as_words(rights), np.frombuffer(data, np.uint8, offset=at + rest)
        self.shared_words = common_words(self.words)


def split_key(key: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """A key's part, and its 32-bit fingerprint within the part."""
    m = mix(key)
    return (m % U64(parts)).astype(np.int64), (m >> U64(32)).astype(np.uint32)


class Keys:
    """Distinct keys of a run by part; a key of several documents stands twice."""

    def __init__(self, parts: int):
        self.parts, self.size, self.found = parts, 0, []

    def add(self, raw: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> None:
        row, _, _, _, key = anchors(raw, offsets)
        part, print_ = split_key(key, self.parts)
        self.found.append(np.stack([(part.astype(U64) << U64(32)) | print_, ids[row].view(U64)], axis=1))
        self.size += len(raw)

    def flush(self) -> list[tuple[int, bytes]]:
        pairs = np.concatenate(self.found)
        self.found, self.size = [], 0
        if not len(pairs):
            return []
        key, doc = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))].T
        head = np.concatenate([[True], key[1:] != key[:-1]])
        other = np.concatenate([[True], doc[1:] != doc[:-1]])
        nth = np.cumsum(head | other)
        nth = nth - np.repeat(nth[head], np.diff(np.append(np.flatnonzero(head), len(key))))
        key = key[(head | other) & (nth < 2)]
        part, cut = np.unique(key >> U64(32), return_index=True)
        pack = zstandard.ZstdCompressor(level=1).compress
        out = []
        for p, k in zip(part.tolist(), np.split(key, cut[1:]), strict=True):
            steps = np.diff((k & U64(0xFFFFFFFF)).astype(np.uint32), prepend=np.uint32(0))
            out.append((p, pack(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes())))
        return out

    @staticmethod
    def unpack(packed: bytes) -> np.ndarray:
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(4, -1)
        return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).reshape(-1), dtype=np.uint32)


def mark_bits(parts: int, size: int) -> int:
    """Bits, as a power of two, of one part's share of the bitmap for `size` bytes of text."""
    every = min(max((size // 8).bit_length(), LEAST_MARK_BITS), MOST_MARK_BITS)
    return max(3, every - (parts - 1).bit_length())


def marked(keys: list[np.ndarray], bits: int) -> np.ndarray:
    """A part's bitmap of the fingerprints that occur more than once."""
    every = np.sort(np.concatenate(keys))
    out = np.zeros(1 << bits, bool)
    out[every[1:][every[1:] == every[:-1]] >> np.uint32(32 - bits)] = True
    return np.packbits(out)


class Writer:
    """Gathers the anchored suffixes of documents and gives them out as runs, and what copies within a run already decide."""

    def __init__(self, parts: int, bitmap: np.ndarray | None = None):
        """bitmap: parts x packed bits, a power of two of them; only suffixes with a marked key are gathered."""
        self.parts, self.bitmap = parts, bitmap
        self.bits = 0 if bitmap is None else bitmap.shape[1].bit_length() + 2
        self.raw, self.ids, self.marks, self.size, self.rows = [], [], [], 0, 0
        self.cols: list[tuple[np.ndarray, ...]] = []

    def add(self, raw: np.ndarray, offsets: np.ndarray, ids: np.ndarray, marks: np.ndarray) -> None:
        row, first, last, at, key = anchors(raw, offsets)
        if self.bitmap is not None:
            part, print_ = split_key(key, self.parts)
            bit = (print_ >> np.uint32(32 - self.bits)).astype(np.int64)
            keep = (self.bitmap[part, bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 > 0
            row, first, last, at, key = row[keep], first[keep], last[keep], at[keep], key[keep]
        context = span_hashes(raw, first, last + LENGTH)
        self.cols.append((row + self.rows, first + self.size, last + self.size, at + self.size, key, first - offsets[row], context))
        self.raw.append(raw)
        self.ids.append(ids)
        self.marks.append(marks)
        self.size += len(raw)
        self.rows += len(ids)

    def flush(self) -> tuple[list[tuple[int, bytes]], np.ndarray]:
        """(part, packed run) pairs, and rows (id, mark, start, end) of bytes to remove."""
        raw, ids, marks = np.concatenate(self.raw), np.concatenate(self.ids), np.concatenate(self.marks)
        row, first, last, at, key, place, context = (np.concatenate(c) for c in zip(*self.cols, strict=True))
        self.__init__(self.parts, self.bitmap)
        right, left = last + LENGTH - at, at - first
        part, _ = split_key(key, self.parts)
        words = as_words(padded(raw, at, right, WORDS * 8))
        order = order_by(part, *words.T, context, left, ids[row])
        # Of equal contexts only those of the least id go on; the others are removed here.
        c, w, n = context[order], left[order], ids[row[order]]
        head = np.concatenate([[True], (c[1:] != c[:-1]) | (w[1:] != w[:-1])])
        first_of = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0)) if len(order) else order
        later = np.flatnonzero(n > n[first_of])
        later = later[same_bytes(raw, first, last + LENGTH, order[later], order[first_of[later]])]
        copy = order[later]
        gone = np.stack([ids[row[copy]], marks[row[copy]], place[copy], place[copy] + (last - first)[copy] + LENGTH], axis=1)
        order = np.delete(order, later)
        edges = np.flatnonzero(np.concatenate([[True], part[order][1:] != part[order][:-1], [True]])) if len(order) else np.zeros(1, np.int64)
        runs = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            o = order[a:b]
            rights, lefts = padded(raw, at[o], right[o], LENGTH), padded(raw, first[o], left[o], LENGTH)
            runs.append((int(part[o[0]]), Run.pack(rights, right[o], lefts, left[o], row[o], place[o], ids, marks)))
        return runs, merged(gone)


def merged(gone: np.ndarray) -> np.ndarray:
    """Rows (id, mark, start, end) with intervals that touch put together."""
    if not len(gone):
        return gone.reshape(0, 4)
    gone = gone[np.lexsort((gone[:, 2], gone[:, 1], gone[:, 0]))]
    new = np.concatenate([[True], (gone[1:, :2] != gone[:-1, :2]).any(axis=1)])
    # Ends that grow along a document: an offset per document keeps the running maximum within it.
    base = np.cumsum(new) * (int(gone[:, 3].max()) + 2)
    reach = np.maximum.accumulate(gone[:, 3] + base)
    start = np.flatnonzero(new | np.concatenate([[True], gone[1:, 2] + base[1:] > reach[:-1]]))
    out = gone[start].copy()
    out[:, 3] = reach[np.append(start[1:], len(gone)) - 1] - base[start]
    return out


def merge(words: list[np.ndarray], shared: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Merged order of sorted runs, as places in their concatenation, and the words that each shares with the one before.

    shared: per run, the words that each suffix has in common with the one before it.
    """
    x, own = np.concatenate(words), np.concatenate(shared)
    total, k = len(x), len(words)
    starts = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    lanes = int(min(LANES, max(1, total // 64)))
    cuts = np.sort(x[:: max(1, total // (lanes * 8)), 0])
    cuts = np.unique(cuts[np.linspace(0, len(cuts) - 1, lanes + 1).astype(np.int64)[1:-1]]) if lanes > 1 else cuts[:0]
    lanes = len(cuts) + 1
    bound = np.stack([np.concatenate([[0], np.searchsorted(w[:, 0], cuts), [len(w)]]) + s for w, s in zip(words, starts[:-1], strict=True)], axis=1)
    leaves = 1 << max(1, (k - 1).bit_length())
    head, stop = np.full((lanes, leaves), total), np.full((lanes, leaves), total)
    head[:, :k], stop[:, :k] = bound[:-1], bound[1:]
    known = np.zeros((lanes, leaves), np.int64)  # words a contender shares with the last winner on its path
    x = np.concatenate([x, np.zeros((1, x.shape[1]), U64)])
    losers = np.zeros((lanes, leaves), np.int64)

    def play(lane: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Winners and losers of a against b, lane by lane."""
        ha, hb, ka, kb = head[lane, a], head[lane, b], known[lane, a], known[lane, b]
        gone_a, gone_b = ha >= stop[lane, a], hb >= stop[lane, b]
        wins = (ka > kb) | ((ka == kb) & (a < b))
        tie = np.flatnonzero((ka == kb) & ~gone_a & ~gone_b)
        depth = ka[tie]
        while len(tie):
            live = depth < WORDS
            known[lane[tie[~live]], np.where(wins[tie[~live]], b[tie[~live]], a[tie[~live]])] = WORDS
            tie, depth = tie[live], depth[live]
            u, v = x[ha[tie], depth], x[hb[tie], depth]
            differ = u != v
            t = tie[differ]
            wins[t] = u[differ] < v[differ]
            known[lane[t], np.where(wins[t], b[t], a[t])] = depth[differ]
            tie, depth = tie[~differ], depth[~differ] + 1
        wins = np.where(gone_a, gone_b & (a < b), gone_b | wins)
        return np.where(wins, a, b), np.where(wins, b, a)

    lane = np.arange(lanes)
    players = [np.full(lanes, j) for j in range(leaves)]
    while len(players) > 1:
        half = len(players) // 2
        for j in range(half):
            players[j], losers[:, half + j] = play(lane, players[2 * j], players[2 * j + 1])
        players = players[:half]
    winner = players[0]
    out_at = (bound - starts[:-1])[:-1].sum(axis=1)
    order, common = np.zeros(total, np.int64), np.zeros(total, np.int64)
    while True:
        alive = head[lane, winner] < stop[lane, winner]
        if not alive.all():
            lane, winner = lane[alive], winner[alive]
        if not len(lane):
            return order, common
        h = head[lane, winner]
        order[out_at[lane]], common[out_at[lane]] = h, known[lane, winner]
        out_at[lane] += 1
        head[lane, winner] = h + 1
        known[lane, winner] = own[np.minimum(h + 1, total - 1)]
        node = (winner + leaves) // 2
        while node[0]:
            winner, losers[lane, node] = play(lane, losers[lane, node], winner)
            node //= 2


def merge_all(words: list[np.ndarray], shared: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """merge() with a bounded fan-in: runs are merged by FAN_IN, then what comes of them."""
    place = np.split(np.arange(sum(map(len, words))), np.cumsum([len(w) for w in words])[:-1])
    while True:
        done = []
        for i in range(0, len(words), FAN_IN):
            order, common = merge(words[i : i + FAN_IN], shared[i : i + FAN_IN])
            done.append((np.concatenate(words[i : i + FAN_IN])[order], common, np.concatenate(place[i : i + FAN_IN])[order]))
        words, shared, place = (list(c) for c in zip(*done, strict=True))
        if len(words) == 1:
            return place[0], shared[0]


def first_difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first byte in which two different words differ."""
    return ((a ^ b).astype(">u8").view(np.uint8).reshape(-1, 8) != 0).argmax(axis=1)


def common_bytes(words: np.ndarray, order: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Bytes that each suffix of the merged order shares with the one before it, given the words; below an anchor's length 0."""
    out = np.where(common >= WORDS, LENGTH, 0)
    for c in range(ANCHOR // 8, WORDS):
        at = np.flatnonzero(common == c)
        out[at] = 8 * c + first_difference(words[order[at], c], words[order[at - 1], c])
    return np.minimum(out, LENGTH)


def windows_repeated(ids: np.ndarray, shared: np.ndarray, right: np.ndarray, left: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For suffixes in merged order, those with windows that suffixes of smaller ids have too, and the least and the largest
    number of bytes that such a window has before the anchor.

    shared: bytes in common with the suffix before, 0 where another anchor begins; before: the bytes before the anchors,
    read backwards, filled with zeros.
    """
    n = len(ids)
    group = np.cumsum(shared == 0)
    back = np.lexsort((*as_words(before).T[::-1], group))
    own = before[back]
    same = (own[1:] == own[:-1]).cumprod(axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
    shared_back = np.concatenate([[-1], np.where(group[back][1:] == group[back][:-1], same, -1)])
    # No partner shares more than a neighbour does.
    most = np.maximum(shared, np.append(shared[1:], 0))
    most_back = np.empty(n, np.int64)
    most_back[back] = np.maximum(shared_back, np.append(shared_back[1:], -1))
    low, high = LENGTH - np.minimum(right, most), np.minimum(left, most_back)
    first, last = np.full(n, LENGTH), np.full(n, -1)
    alike_back = np.empty(n, np.int64)
    for l in range(int(low.min(initial=LENGTH)), int(high.max(initial=-1)) + 1):
        who = np.flatnonzero((low <= l) & (l <= high))
        if not len(who):
            continue
        alike = np.cumsum(shared < LENGTH - l)
        alike_back[back] = np.cumsum(shared_back < l)
        key = alike[who] * (n + 1) + alike_back[who]
        by = np.argsort(key, kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], key[by][1:] != key[by][:-1]]))
        least = np.repeat(np.minimum.reduceat(ids[who][by], heads), np.diff(np.append(heads, len(by))))
        hit = who[by][ids[who][by] > least]
        first[hit] = np.minimum(first[hit], l)
        last[hit] = l
    found = np.flatnonzero(last >= 0)
    return found, first[found], last[found]


def repeated(runs: list[Run]) -> np.ndarray:
    """Rows (id, mark, start, end): bytes covered by windows that documents of smaller ids have too."""
    order, common = merge_all([r.words for r in runs], [r.shared_words for r in runs])
    shared = common_bytes(np.concatenate([r.words for r in runs]), order, common)
    cat = lambda name: np.concatenate([getattr(r, name) for r in runs])[order]
    right, left, place = cat("right"), cat("left"), cat("place")
    ids = np.concatenate([r.ids[r.row] for r in runs])[order]
    marks = np.concatenate([r.marks[r.row] for r in runs])[order]
    left_at = np.concatenate([np.cumsum(r.left) - r.left + base for r, base in zip(runs, np.cumsum([0, *(len(r.lefts) for r in runs)])[:-1], strict=True)])[order]
    lefts = np.concatenate([np.zeros(1, np.uint8)] + [r.lefts for r in runs])
    runs.clear()
    shared[shared < ANCHOR] = 0
    group = np.flatnonzero(shared == 0)
    several = np.minimum.reduceat(ids, group) < np.maximum.reduceat(ids, group)
    sizes = np.diff(np.append(group, len(order)))
    ends = np.cumsum(sizes * several)
    out, done, wide = [], 0, np.arange(-(-BEFORE // 8) * 8)
    while done < len(group):
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + SUFFIXES_AT_ONCE, "right")))
        a, z = group[done], group[upto] if upto < len(group) else len(order)
        e = a + np.flatnonzero(np.repeat(several[done:upto], sizes[done:upto]))
        done = upto
        if not len(e):
            continue
        # Place 0 of lefts is a zero that stands for what is not there.
        at = left_at[e][:, None] + left[e][:, None] - wide
        before = lefts[np.where(wide < left[e][:, None], at, 0)]
        hit, first, last = windows_repeated(ids[e], shared[e], right[e], left[e], before)
        # Windows of one anchor overlap, so from the first to the last that is repeated all bytes go.
        x = e[hit]
        out.append(np.stack([ids[x], marks[x], place[x] + left[x] - last, place[x] + left[x] - first + LENGTH], axis=1))
    return merged(np.concatenate(out)) if out else np.zeros((0, 4), np.int64)


FOUND = "part int, run binary, id long, mark long, first int, last int"


def _batch(runs: list[tuple[int, bytes]], gone: np.ndarray, parts: int) -> pa.RecordBatch:
    n, m = len(runs), len(gone)
    part = [p for p, _ in runs] + (gone[:, 0] % parts).tolist()
    none = [None] * n
    return pa.RecordBatch.from_arrays(
        [pa.array(part, pa.int32()), pa.array([b for _, b in runs] + [None] * m, pa.binary()), *(pa.array(none + gone[:, c].tolist(), t) for c, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.int32()), (3, pa.int32())))],
        ["part", "run", "id", "mark", "first", "last"],
    )


def removals(docs: DataFrame) -> DataFrame:
    """id, mark, first, last: intervals of bytes to remove, for rows (id, mark, text).

    mark tells the texts of one id apart: a 64-bit hash.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    # Two groups a task, one after the other, so that a worker holds half as much.
    parts = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))

    bits = mark_bits(parts, size)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = Keys(parts)

        def out() -> pa.RecordBatch:
            made = k.flush()
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in made], pa.int32()), pa.array([b for _, b in made], pa.binary())], ["part", "keys"])

        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            raw, offsets = text_buffer(b.column(1))
            for i, j in doc_blocks(offsets):
                k.add(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ids[i:j])
                if k.size >= KEY_RUN_BYTES:
                    yield out()
        if k.size:
            yield out()

    def mark(key, table):  # without annotations: they would have to name the kind of function
        got = [Keys.unpack(x.as_buffer().to_pybytes()) for x in table.column("keys").combine_chunks()]
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([marked(got, bits).tobytes()], pa.binary())})

    bitmap = np.zeros((parts, (1 << bits) // 8), np.uint8)
    for r in docs.select("id", "text").mapInArrow(keys, "part int, keys binary").groupBy("part").applyInArrow(mark, "part int, bits binary").collect():
        bitmap[r.part] = np.frombuffer(r.bits, np.uint8)
    shared = spark.sparkContext.broadcast(bitmap)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Writer(parts, shared.value)
        for b in batches:
            ids, marks = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 1))
            raw, offsets = text_buffer(b.column(2))
            for i, j in doc_blocks(offsets):
                w.add(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ids[i:j], marks[i:j])
                if w.size >= RUN_BYTES:
                    yield _batch(*w.flush(), parts)
        if w.rows:
            yield _batch(*w.flush(), parts)

    def reduce(key, table):  # without annotations: they would have to name the kind of function
        got = table.column("run").combine_chunks()
        packed = got.drop_null()
        local = table.filter(pa.compute.is_null(table.column("run")))
        gone = [np.stack([local.column(c).to_numpy().astype(np.int64) for c in ("id", "mark", "first", "last")], axis=1)] if local.num_rows else []
        if len(packed):
            gone.append(repeated([Run(x.as_buffer().to_pybytes()) for x in packed]))
        gone = merged(np.concatenate(gone)) if gone else np.zeros((0, 4), np.int64)
        return pa.table({"id": pa.array(gone[:, 0]), "mark": pa.array(gone[:, 1]), "first": pa.array(gone[:, 2], pa.int32()), "last": pa.array(gone[:, 3], pa.int32())})

    return docs.mapInArrow(runs, FOUND).groupBy("part").applyInArrow(reduce, "id long, mark long, first int, last int")


def _union(first: np.ndarray, last: np.ndarray) -> list[tuple[int, int]]:
    rows = np.stack([np.zeros_like(first), np.zeros_like(first), first, last], axis=1)
    return [(int(a), int(b)) for a, b in merged(rows)[:, 2:]]


def stripped(docs: DataFrame) -> DataFrame:
    """The rows of docs as doc_id, text and spans, an array of {first, last} intervals of bytes to remove, null if none.

    A byte goes if a 50-byte string that covers it also starts in a document with a smaller doc_id. Equal ids do not remove
    from each other; a null id is larger than all others. Null and short texts lose nothing.
    """
    storage.small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = rows.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID))).alias("id"), F.xxhash64("text").alias("mark"), "text", "doc_id")
    found = removals(keyed.select("id", "mark", "text")).groupBy("id", "mark").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    return keyed.join(found, ["id", "mark"], "left").select("doc_id", "text", "spans")


def _spans(cell) -> list[tuple[int, int]]:
    if not cell.is_valid or not len(cell):
        return []
    v = cell.values
    return _union(v.field("first").to_numpy().astype(np.int64), v.field("last").to_numpy().astype(np.int64))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row per document, repeated rows included.

    A null text is an empty one; short texts lose nothing; equal ids don't remove from each other. An empty table gives no
    rows; other columns take no part.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = text_buffer(b.column(1))
            out = []
            for k in range(b.num_rows):
                text, spans = raw[offsets[k] : offsets[k + 1]].tobytes(), _spans(b.column(2)[k])
                kept, at = [], 0
                for a, z in spans:
                    kept.append(text[at:a])
                    at = z
                kept.append(text[at:])
                out.append((len(text), sum(z - a for a, z in spans), len(spans), hashlib.sha256(b"".join(kept)).hexdigest()))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = stripped(docs).select(F.col("doc_id").cast("long"), "text", "spans")
    return rows.mapInArrow(work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op3_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """digest() of all documents."""
    return digest(storage.read(spark, sf_dir, "documents"))
