"""Near duplicates by DartMinHash signatures, banded joining and an exact check.

Every element of a weighted set owns regions of unit width along its weight, and darts strike each region at the times of a
Poisson process that a hash of the element decides; a dart has a hashed coordinate. A set's signature keeps, for each
coordinate, its earliest dart. As few darts come before the time at which all coordinates are likely struck, the cost is
about k log k darts a set, however large the set. Two sets agree in a coordinate with the probability of their weighted
Jaccard similarity. Five-word shingles weigh 1 each, so this is the Jaccard similarity of shingle sets.

Equal texts are one node. Nodes that share a band's key are linked to the band's leader, which a hash chooses anew for
each band: a star, never all pairs, so a bucket of n nodes costs n rows, and near nodes that share many bands meet several
leaders. A link counts only if the shingle sets' exact similarity reaches the threshold. Links are checked best first:
those between parts that earlier links have joined need no check.

Where links fail, a bucket's nodes may stay in several parts. Such buckets get a second leader, the node that meets the most
others, and what is still apart then is compared pair by pair, in blocks dealt over tasks. So in the end each two nodes that
share a band's key are in one part or have been compared.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.llm import storage
from waymark.llm.kernels import U64, doc_blocks, mix, shingle_hashes, text_buffer

WORDS = 5
THRESHOLD = 0.8
#: 42 bands of 6 coordinates: a pair of similarity 0.8 shares no band with a probability of 3 in a million.
BANDS, BAND_ROWS = 42, 6
K = BANDS * BAND_ROWS
_CELL, _NTH, _COORD, _WIDTH = (U64(x) for x in (0xD1B54A32D192ED03, 0xABC98388FB8FAC03, 0x8CB92BA72F3D8DD7, 0xA0761D6478BD642F))
#: Blocks in which the nodes of a bucket are compared pair by pair: about so many nodes and bytes of shingle hashes at most.
BLOCK_NODES, BLOCK_BYTES = 1000, 4 << 20
#: The bitmap that stands for a set of nodes has 16 bits for each, but at least and at most so many (128 MB), as powers of two.
LEAST_MARK_BITS, MOST_MARK_BITS = 20, 30


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _throw(ids: np.ndarray, rows: np.ndarray, width: np.ndarray | None, until: np.ndarray, out: np.ndarray, k: int) -> None:
    """Darts of each region up to its row's time; the earliest of each coordinate go to out."""
    flat, nth = out.reshape(-1), 0
    at, limit = np.zeros(len(ids)), until[rows]
    while len(ids):
        nth += 1
        h = mix(ids + U64(nth * int(_NTH) % 2**64))
        u = _uniform(h)
        soon = u >= np.exp(at - limit)
        ids, rows, h, limit = ids[soon], rows[soon], h[soon], limit[soon]
        at = at[soon] - np.log(u[soon])
        cell = rows * k + (mix(h ^ _COORD) % U64(k)).astype(np.int64)
        if width is None:
            np.minimum.at(flat, cell, at)
        else:
            width = width[soon]
            inside = _uniform(mix(h ^ _WIDTH)) < width
            np.minimum.at(flat, cell[inside], at[inside])


def signatures(ids: np.ndarray, rows: np.ndarray, n: int, k: int = K, weights: np.ndarray | None = None) -> np.ndarray:
    """n x k times of the earliest darts; equal times are equal darts. Rows without weight have infinite times.

    ids: 64-bit hashes of elements; an element that a row repeats counts once, unless `weights` says how much each has.
    """
    width = None
    if weights is None:
        total = np.bincount(rows, minlength=n).astype(float)
    else:
        total = np.bincount(rows, weights, minlength=n)
        cells = np.ceil(weights).astype(np.int64)
        nth = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
        width = np.minimum(np.repeat(weights, cells) - nth, 1.0)
        ids, rows = np.repeat(ids, cells) + nth.astype(U64) * _CELL, np.repeat(rows, cells)
    out = np.full((n, k), np.inf)
    until = np.where(total > 0, k * (np.log(k) + 3) / np.maximum(total, 1e-300), 0.0)
    todo = total > 0
    while todo.any():
        mine = todo[rows]
        _throw(ids[mine], rows[mine], None if width is None else width[mine], until, out, k)
        todo &= np.isinf(out).any(axis=1)
        until = np.where(todo, until * 2, until)
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """rows x bands 64-bit keys, each of one band's coordinates and the band's number."""
    n, k = signature.shape
    parts = signature.view(U64).reshape(n, bands, k // bands)
    key = np.broadcast_to(np.arange(bands, dtype=U64) * _CELL, (n, bands)).copy()
    for j in range(k // bands):
        key = mix(key * _NTH + parts[:, :, j])
    return key


def digest(text: Column) -> Column:
    """16 bytes that stand for a text; null and empty are one text."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


def _banded(docs: DataFrame) -> DataFrame:
    """doc_id, node, keys: the band keys where a task meets the text for the first time, else null; without words null too."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            node = batch.column(1).to_pylist()
            new = []
            for i, x in enumerate(node):
                if x not in seen:
                    seen.add(x)
                    new.append(i)
            keys: list = [None] * len(node)
            raw, offsets = text_buffer(batch.column(2).take(pa.array(new, pa.int64())))
            for i, j in doc_blocks(offsets):
                ids, rows = shingle_hashes(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], WORDS)
                made = band_keys(signatures(ids, rows, j - i)).view(np.int64)
                have = np.bincount(rows, minlength=j - i) > 0
                for x in np.flatnonzero(have).tolist():
                    keys[new[i + x]] = made[x].tolist()
            if len(seen) > 1_000_000:  # forgetting costs repeated rows only
                seen.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "node", "keys"])

    return docs.select(F.col("doc_id").cast("long"), digest(F.col("text")).alias("node"), "text").mapInArrow(work, "doc_id long, node binary, keys array<long>")


def _marks(nodes: DataFrame) -> np.ndarray:
    """A packed bitmap with the places of the nodes set, by their first bytes; its size follows their number up to a bound."""
    bits = min(max((16 * nodes.count()).bit_length(), LEAST_MARK_BITS), MOST_MARK_BITS)
    at = F.conv(F.hex(F.substring("node", 1, 4)), 16, 10).cast("long").bitwiseAND((1 << bits) - 1) + 1
    rows = nodes.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()  # 4 kB each, at most 32,768 rows
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in rows:
        out[(r.k - 1) * len(r.bits) : r.k * len(r.bits)] = np.frombuffer(r.bits, np.uint8)  # places from 1 on fill buckets from 1 on
    return out


def _shingle_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, shingles: sorted distinct 64-bit hashes, for the nodes asked for and a few others.

    A bitmap of bounded size tells the texts that may be wanted, so no text is shuffled; where it fills up, sets are made that
    nobody asks for, and the result is the same.
    """
    marks = docs.sparkSession.sparkContext.broadcast(_marks(nodes))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = marks.value, set()
        mask = 8 * len(bits) - 1
        for batch in batches:
            node, new = batch.column(0).to_pylist(), []
            for i, x in enumerate(node):
                at = int.from_bytes(x[:4], "big") & mask
                if bits[at >> 3] >> (at & 7) & 1 and x not in seen:
                    seen.add(x)
                    new.append(i)
            if len(seen) > 1_000_000:
                seen.clear()
            take = pa.array(new, pa.int64())
            raw, offsets = text_buffer(batch.column(1).take(take))
            out = []
            for i, j in doc_blocks(offsets):
                ids, rows = shingle_hashes(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], WORDS)
                cut = np.searchsorted(rows, np.arange(j - i + 1))
                out += [np.unique(ids[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(out, pa.binary())], ["node", "shingles"])

    made = docs.select(digest(F.col("text")).alias("node"), "text").mapInArrow(work, "node binary, shingles binary")
    return made.groupBy("node").agg(F.first("shingles").alias("shingles"))


def _verified(edges: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b) whose shingle sets are similar enough."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                u, v = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                small, large = sorted((len(u), len(v)))
                both = 0 if small < threshold * large else len(np.intersect1d(u, v, assume_unique=True))
                good.append(both >= threshold * (len(u) + len(v) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    one, two = (sets.select(F.col("node").alias(k), F.col("shingles").alias(f"set_{k}")) for k in "ab")
    return edges.join(one, "a").join(two, "b").select("a", "b", "set_a", "set_b").mapInArrow(work, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """node, part (the component's smallest node) for the nodes of edges (a, b), by alternating large and small stars.

    Each round is written and read back, until one changes nothing; hubs are joined, never gathered.
    """
    now = storage.staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "star")
    state = None
    while True:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
        after = storage.staged(small, "star")
        storage.discard(now)
        now = after
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    return now.select(F.col("u").alias("node"), F.col("v").alias("part")).union(now.select(F.col("v").alias("node"), F.col("v").alias("part")).distinct())


def _joined(parts: DataFrame, links: DataFrame) -> DataFrame:
    """parts (node, part) after further links (a, b)."""
    if links.isEmpty():
        return parts
    return storage.staged(components(parts.select(F.col("node").alias("a"), F.col("part").alias("b")).union(links)), "parts")


def _apart(members: DataFrame, parts: DataFrame) -> DataFrame:
    """key, node, part: the members (key, node) of the buckets that have several parts; of buckets of equal members, one."""
    placed = members.join(parts, "node", "left").select("key", "node", F.coalesce("part", "node").alias("part")).distinct()
    same = [F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"), F.count("*").alias("n")]
    split = placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), *same).where("low != high")
    return storage.staged(placed.join(split.groupBy("x", "y", "n").agg(F.min("key").alias("key")).select("key"), "key"), "apart")


def _meet(sets: list[np.ndarray], xs: list[int], ys: list[int], top: list[int], threshold: float) -> list[tuple[int, int]]:
    """Pairs of xs and ys that are similar enough and not yet joined in the forest `top`, which they join."""
    out: list[tuple[int, int]] = []
    if not xs or not ys:
        return out

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    sizes = np.array([len(sets[y]) for y in ys])
    every, owner = np.concatenate([sets[y] for y in ys]), np.repeat(np.arange(len(ys)), sizes)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    for x in xs:
        low, high = np.searchsorted(every, sets[x], "left"), np.searchsorted(every, sets[x], "right")
        n = high - low
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(ys))
        for k in np.flatnonzero(both >= threshold * (len(sets[x]) + sizes - both)).tolist():
            i, j = find(x), find(ys[k])
            if i != j:
                top[i] = j
                out.append((x, ys[k]))
    return out


def _all_pairs(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b) that join all similar members (key, node, part) of a bucket which are in different parts.

    Every bucket is cut into blocks by size and hash, and each pair of blocks is a group of its own, so a large bucket is dealt
    over tasks. Sizes of similar sets are of one class or of neighbouring classes.
    """
    step = max(-np.log(threshold), 1e-3) * 1.0001  # a little wider, so that rounding puts no similar sizes two classes apart
    sized = members.join(sets.select("node", F.octet_length("shingles").alias("bytes")), "node").withColumn("c", F.floor(F.log(F.col("bytes") / 8) / step))
    cuts = sized.groupBy("key", "c").agg(F.greatest(F.ceil(F.count("*") / BLOCK_NODES), F.ceil(F.sum("bytes") / BLOCK_BYTES)).alias("cuts"))
    dealt = storage.staged(sized.join(cuts, ["key", "c"]).select("key", "c", F.pmod(F.xxhash64("node"), "cuts").alias("h"), "node", "part"), "dealt")
    blocks = dealt.groupBy("key", "c", "h").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    one, two = (blocks.select("key", *(F.col(k).alias(side + k) for k in ("c", "h", "low", "high"))) for side in "lr")
    pairs = one.join(two, "key").where("rc - lc <= 1 and (lc < rc or lc = rc and lh <= rh) and (llow != lhigh or rlow != rhigh or llow != rlow)")
    pairs = storage.staged(pairs.select("key", "lc", "lh", "rc", "rh"), "pairs")
    names = ["key", "lc", "lh", "rc", "rh"]
    sides = []
    for n, side in enumerate("lr"):
        wanted = pairs if n == 0 else pairs.where("lc != rc or lh != rh")
        own = dealt.withColumnRenamed("c", f"{side}c").withColumnRenamed("h", f"{side}h")
        sides.append(own.join(wanted, ["key", f"{side}c", f"{side}h"]).select(*names, F.lit(n).alias("side"), "node", "part"))

    def work(group: pa.Table) -> pa.Table:
        side, node, part = (group.column(k).to_pylist() for k in ("side", "node", "part"))
        kept = [np.frombuffer(x.as_buffer(), U64) for x in group.column("shingles")]
        first: dict = {}
        top = [first.setdefault(p, i) for i, p in enumerate(part)]
        # Two nodes of the commonest part need no comparison.
        common = Counter(part).most_common(1)[0][0]
        left, right = ([i for i, s in enumerate(side) if s == n] for n in (0, 1))
        rare = [i for i in left if part[i] != common]
        if right:
            out = _meet(kept, rare, right, top, threshold)
            out += _meet(kept, [i for i in right if part[i] != common], [i for i in left if part[i] == common], top, threshold)
        else:
            out = _meet(kept, rare, left, top, threshold)
        return pa.table({k: pa.array([node[e[n]] for e in out], pa.binary()) for n, k in enumerate("ab")})

    return sides[0].union(sides[1]).join(sets, "node").groupBy(*names).applyInArrow(work, "a binary, b binary")


def _parts(docs: DataFrame, banded: DataFrame, threshold: float) -> DataFrame | None:
    """node, part of the nodes that have near copies: any two that share a band's key and are similar enough share a part."""
    rows = banded.where("keys is not null").select("node", F.explode("keys").alias("key"))
    lead = F.struct(F.xxhash64("node", "key").alias("h"), "node")
    buckets = rows.groupBy("key").agg(F.min(lead)["node"].alias("leader"), F.max(lead)["node"].alias("other")).where("leader != other").select("key", "leader")
    met = rows.join(buckets, "key").where("node != leader")
    met = storage.staged(met.select("key", F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"), F.col("node").alias("of")), "met")
    edges = storage.staged(met.groupBy("a", "b").agg(F.count("*").alias("bands"), F.min("of").alias("of")), "edges")
    if edges.isEmpty():
        return None
    sets = storage.staged(_shingle_sets(docs, edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()), "sets")
    best = edges.withColumn("r", F.row_number().over(Window.partitionBy("of").orderBy(F.col("bands").desc(), "a", "b"))).where("r = 1").select("a", "b")
    first = storage.staged(_verified(best, sets, threshold), "links")
    parts = storage.staged(components(first), "parts")
    pa_, pb = (parts.select(F.col("node").alias(k), F.col("part").alias(f"p{k}")) for k in "ab")
    rest = edges.join(best, ["a", "b"], "left_anti").join(pa_, "a", "left").join(pb, "b", "left").where("pa is null or pb is null or pa != pb").select("a", "b")
    parts = _joined(parts, storage.staged(_verified(rest, sets, threshold), "links"))
    # The first leaders are done: they have met all others of their buckets.
    apart = _apart(met.select("key", F.col("of").alias("node")), parts)
    if apart.isEmpty():
        return parts
    busy = apart.join(apart.groupBy("key").agg(F.count("*").alias("n")), "key").groupBy("node").agg(F.sum("n").alias("meets"))
    leaders = apart.join(busy, "node").groupBy("key").agg(F.max(F.struct("meets", "node", "part")).alias("l"))
    leaders = storage.staged(leaders.select("key", F.col("l.node").alias("leader"), F.col("l.part").alias("its")), "leaders")
    led = apart.join(leaders, "key").where("node != leader")
    again = led.where("part != its").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    parts = _joined(parts, storage.staged(_verified(again, sets, threshold), "links"))
    apart = _apart(led.select("key", "node"), parts)
    if apart.isEmpty():
        return parts
    return _joined(parts, storage.staged(_all_pairs(apart, sets, threshold), "links"))


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, node, class_id, part: one row per document; documents of one class_id are copies or near copies of each other,
    linked by a chain of texts with a similarity of the threshold or more.

    class_id is the least doc_id of the class (null if all are null), part its least node. Equal texts share a class, null and empty texts as
    well, with no words or many; a text without words has no near copies. Ids may repeat. An empty table gives no rows.
    """
    storage.small_batches(docs.sparkSession)
    banded = storage.staged(_banded(docs), "banded")
    nodes = banded.groupBy("node").agg(F.min("doc_id").alias("least"))
    parts = _parts(docs, banded, threshold)
    if parts is None:
        named = nodes.select("node", F.col("least").alias("class_id"), F.col("node").alias("part"))
    else:
        placed = nodes.join(parts, "node", "left").select("node", "least", F.coalesce("part", "node").alias("part"))
        low = placed.groupBy("part").agg(F.min("least").alias("class_id"))
        named = placed.join(low, "part").select("node", "class_id", "part")
    return banded.select("doc_id", "node").join(named, "node").select("doc_id", "node", "class_id", "part")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each class: the least doc_id's (of several texts with that id, the least digest's)."""
    found = storage.staged(classes(docs, threshold), "classes")
    kept = found.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node")).alias("k"))
    kept = kept.select(F.col("k.doc_id").alias("__id"), F.col("k.node").alias("__node"))
    names = docs.columns
    rows = docs.withColumn("__d", digest(F.col("text"))).join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__d") == F.col("__node")))
    # Wholly repeated rows remain; the window runs in the join's own partitions and order.
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy("__id", "__node").orderBy("__id"))).where("__n = 1").select(*names)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """classes() of all documents."""
    return classes(storage.read(spark, sf_dir, "documents")).select("doc_id", "class_id")
