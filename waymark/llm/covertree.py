"""Exact top-k inner products by a dual-tree search over cover trees.

A bounded sample gives the centres of the coarsest level of the cover tree; data and queries are dealt by their nearest
centre, and regions are cut into blocks of bounded size, however many rows one holds. Each block's own cover tree is built
once and staged with it: a node covers its points within a radius of its centre, and its children do so within smaller ones.

A query block first meets some of the data of its own region. From then on every query has a k-th score, which goes with it:
only regions in which a query of the block can find something better are joined, and there pairs of nodes are pruned as
long as the most that their inner products can be, by centres and covering radii, is below the worst k-th score of the query
node's group. What remains is scored by one matrix product per group. Scores are integers, so sums are exact and ties real.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.llm import storage

TOP, QUERY_EVERY, SCALE = 20, 20, 64.0
DATA_BLOCK, QUERY_BLOCK, LEAF, QUERY_LEAF, SHRINK = 4096, 1024, 96, 24, 0.7
MOST_CHILDREN, WORTHWHILE = 24, 0.8
#: The centres of regions come from at most so many vectors, those with the least hashes of vec_id; there are at most so many.
MOST_SAMPLED, MOST_REGIONS = 4096, 512
#: Data blocks of its own region that a query block meets first, and points scored at once, by a group's first meeting with a
#: block and at most. Results don't depend on them.
HOME_BLOCKS, SCORED_FIRST, SCORED_AT_ONCE = 2, 128, 2048
NO_ID = np.iinfo(np.int64).max
#: Integers below this are exact in single precision.
SINGLE = float(1 << 24)


def farthest_first(x: np.ndarray, start: int, most: int, near_enough: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A net of at most `most` rows of x, each the farthest from those before it, until all are near enough: the net's rows,
    and for each row of x the number of its nearest one and the distance."""
    squares = (x * x).sum(axis=1)

    def away(i: int) -> np.ndarray:
        return np.sqrt(np.maximum(squares - 2 * (x @ x[i]) + squares[i], 0))

    net, near, which = [start], away(start), np.zeros(len(x), np.int64)
    while len(net) < most and near.max() > near_enough:
        net.append(int(np.argmax(near)))
        d = away(net[-1])
        closer = d < near
        which[closer], near = len(net) - 1, np.minimum(near, d)
    return np.array(net), which, near


@dataclass
class Tree:
    """A cover tree as arrays. Points stand in the tree's order, nodes level by level: a node has points[first:last] and the
    nodes kids[0]:kids[1] as its children."""

    x: np.ndarray
    ids: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    span: np.ndarray
    kids: np.ndarray
    least: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> Tree:
        order = np.arange(len(x))
        spans, kids, centres, radii = [(0, len(x))], [], [], []
        done = 0
        while done < len(spans):
            a, z = spans[done]
            own = x[order[a:z]]
            centre = own[np.argmin(((own - own.mean(axis=0)) ** 2).sum(axis=1))]
            radius = float(np.sqrt(((own - centre) ** 2).sum(axis=1).max()))
            first = len(spans)
            if z - a > leaf and radius > 0:
                start = int(np.argmin(((own - centre) ** 2).sum(axis=1)))
                _, which, near = farthest_first(own, start, MOST_CHILDREN, SHRINK * radius)
                sizes = np.bincount(which)
                # Where a net brings points hardly nearer to a centre, no bound would get tighter: one large leaf is faster.
                if len(sizes) > 1 and near.mean() < WORTHWHILE * np.sqrt(((own - centre) ** 2).sum(axis=1)).mean():
                    order[a:z] = order[a:z][np.argsort(which, kind="stable")]
                    ends = a + np.cumsum(sizes)
                    spans += [(int(e - n), int(e)) for e, n in zip(ends, sizes, strict=True) if n]
            kids.append((first, len(spans)))
            centres.append(centre)
            radii.append(radius)
            done += 1
        span = np.array(spans)
        least = np.array([ids[order[a:z]].min() for a, z in spans])
        return cls(x[order], ids[order], np.array(centres), np.array(radii), span, np.array(kids), least)


class Best:
    """The k best scores of each query so far, in order, and the score and id that a further one has to beat."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores, self.ids = np.full((queries, k), -np.inf), np.full((queries, k), NO_ID)
        self.worst, self.worst_id = np.full(queries, -np.inf), np.full(queries, NO_ID)

    def above(self, score: np.ndarray, worst_id: np.ndarray) -> None:
        """Only what is better than this counts: what is known from elsewhere."""
        self.worst, self.worst_id = score.copy(), worst_id.copy()

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Takes in rows x ids scores; -inf stands for none."""
        w = self.worst[rows][:, None]
        mask = scores >= w
        if np.count_nonzero(mask) > 4 * self.k * len(rows):
            mask &= scores >= -np.partition(-scores, min(self.k, scores.shape[1]) - 1, axis=1)[:, min(self.k, scores.shape[1]) - 1, None]
        r, c = np.nonzero(mask)
        got = scores[r, c]
        real = (got > -np.inf) & ((got > w[r, 0]) | (ids[c] < self.worst_id[rows[r]]))
        r, c = r[real], c[real]
        if not len(r):
            return
        used = np.unique(r)
        old = rows[used]
        row = np.concatenate([r, np.repeat(used, self.k)])
        s, i = np.concatenate([scores[r, c], self.scores[old].ravel()]), np.concatenate([ids[c], self.ids[old].ravel()])
        order = np.lexsort((i, -s, row))
        starts = np.searchsorted(row[order], used)
        take = order[starts[:, None] + np.arange(self.k)]
        self.scores[old], self.ids[old] = s[take], i[take]
        last, last_id = self.scores[old, -1], self.ids[old, -1]
        better = (last > self.worst[old]) | ((last == self.worst[old]) & (last_id < self.worst_id[old]))
        self.worst[old], self.worst_id[old] = np.where(better, last, self.worst[old]), np.where(better, last_id, self.worst_id[old])

    def may_gain(self, rows: slice, most: np.ndarray, least: np.ndarray) -> np.ndarray:
        """queries x nodes: whether a node with no score above `most` and no id below `least` can give anything."""
        # A bound's sum is rounded: a margin keeps what ties, and scores are whole numbers.
        bound = np.floor(most + np.abs(most) * 1e-9 + 1e-6)
        return (bound > self.worst[rows, None]) | ((bound == self.worst[rows, None]) & (least < self.worst_id[rows, None]))


def dual_search(q: Tree, x: Tree, best: Best) -> int:
    """Brings `best`, by the places of q's points, up to date with the points of x of other ids; the number of pairs scored."""
    scored = 0
    single = max(np.abs(q.x).max(initial=0), 1.0) * max(np.abs(x.x).max(initial=0), 1.0) * x.x.shape[1] < SINGLE
    kind = np.float32 if single else np.float64
    qx, xx = q.x.astype(kind), x.x.astype(kind)
    q_norm, x_norm = np.sqrt((q.x**2).sum(axis=1)), np.sqrt((x.centre**2).sum(axis=1))
    qc_norm = np.sqrt((q.centre**2).sum(axis=1))

    def score(rows: slice, leaves: np.ndarray, most: np.ndarray) -> None:
        nonlocal scored
        leaves = leaves[np.argsort(-most, kind="stable")]
        sizes = np.cumsum(x.span[leaves, 1] - x.span[leaves, 0])
        at, many = 0, SCORED_FIRST
        while at < len(leaves):
            upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + many, "right")))
            some, at, many = leaves[at:upto], upto, min(2 * many, SCORED_AT_ONCE)
            some = some[best.may_gain(rows, bounds(rows, some), x.least[some]).any(axis=0)]
            if not len(some):
                continue
            points = np.concatenate([np.arange(a, z) for a, z in x.span[some]])
            s = qx[rows] @ xx[points].T
            own = np.isin(x.ids[points], q.ids[rows])
            if own.any():
                s[:, own] = np.where(q.ids[rows][:, None] == x.ids[points[own]][None, :], -np.inf, s[:, own])
            scored += s.size
            best.add(np.arange(rows.start, rows.stop), s, x.ids[points])

    def bounds(rows: slice, nodes: np.ndarray) -> np.ndarray:
        """queries x nodes: the most that an inner product can be, query by query."""
        return q.x[rows] @ x.centre[nodes].T + q_norm[rows, None] * x.radius[nodes]

    todo = [(0, np.array([0]))]
    while todo:
        a, nodes = todo.pop()
        rows = slice(*q.span[a])
        group = q.centre[a] @ x.centre[nodes].T + qc_norm[a] * x.radius[nodes] + x_norm[nodes] * q.radius[a] + q.radius[a] * x.radius[nodes]
        worst = best.worst[rows].min()
        nodes = nodes[np.floor(group + np.abs(group) * 1e-9 + 1e-6) >= worst]
        if not len(nodes):
            continue
        inner = x.kids[nodes, 1] > x.kids[nodes, 0]
        leaf_query = q.kids[a, 0] == q.kids[a, 1]
        if not leaf_query and (not inner.any() or q.radius[a] >= x.radius[nodes[inner]].max()):
            todo += [(b, nodes) for b in range(*q.kids[a])]
        elif not leaf_query:
            todo.append((a, np.concatenate([nodes[~inner], *(np.arange(*x.kids[n]) for n in nodes[inner])])))
        else:
            while True:
                most = bounds(rows, nodes)
                keep = best.may_gain(rows, most, x.least[nodes]).any(axis=0)
                nodes, most = nodes[keep], most[:, keep]
                inner = x.kids[nodes, 1] > x.kids[nodes, 0]
                if not inner.any():
                    break
                nodes = np.concatenate([nodes[~inner], *(np.arange(*x.kids[n]) for n in nodes[inner])])
            if len(nodes):
                score(rows, nodes, most.max(axis=0))
    return scored


def integral(vectors: DataFrame) -> DataFrame:
    """vec_id and floor(64 * x) per component, as double; without vectors that are null, empty or hold null or non-finite parts."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~bad).select(F.col("vec_id").cast("long"), F.transform(x, lambda v: F.floor(v * SCALE).cast("double")).alias("x"))


def matrix(lists: pa.Array, width: int = 0) -> np.ndarray:
    """Rows of a list column, padded with zeros to the longest row or to a larger width."""
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), max(width, int(sizes.max(initial=0)))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


@dataclass
class Regions:
    """Centres of regions, from a sample."""

    centre: np.ndarray

    @classmethod
    def of(cls, whole: DataFrame, rows: int) -> Regions:
        some = whole.orderBy(F.xxhash64("vec_id"), "vec_id", "x").limit(MOST_SAMPLED).collect()
        wide = max(len(r.x) for r in some)
        x = np.array([r.x + [0.0] * (wide - len(r.x)) for r in some])
        start = int(np.argmin(((x - x.mean(axis=0)) ** 2).sum(axis=1)))
        net, _, _ = farthest_first(x, start, min(MOST_REGIONS, -(-rows // DATA_BLOCK)), 0.0)
        return cls(x[net])

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """The number of each row's region."""
        wide = max(x.shape[1], self.centre.shape[1])
        x, c = (np.pad(v, ((0, 0), (0, wide - v.shape[1]))) for v in (x, self.centre))
        return np.argmin((c * c).sum(axis=1) - 2 * (x @ c.T), axis=1)


def _dealt(whole: DataFrame, regions: Regions) -> DataFrame:
    """region, vec_id, x."""
    shared = whole.sparkSession.sparkContext.broadcast(regions)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(shared.value.nearest(matrix(b.column(1))), pa.int32()), *b.columns], ["region", "vec_id", "x"])

    return whole.mapInArrow(work, "region int, vec_id long, x array<double>")


def _blocks(dealt: DataFrame, counts: dict[int, int], size: int, leaf: int, name: str) -> DataFrame:
    """region, nth, tree, centre, radius: blocks of about `size` vectors of a region, each with its cover tree."""
    spark = dealt.sparkSession
    cuts = spark.createDataFrame([(r, -(-n // size)) for r, n in counts.items()], "region int, cuts long")  # at most MOST_REGIONS rows
    # Rows, not ids, are dealt out: an id that a third of all rows have is cut up as well.
    nth = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.col("cuts")).cast("int")
    rows = dealt.join(F.broadcast(cuts), "region").select("region", nth.alias("nth"), "vec_id", "x")

    def build(key, table):  # without annotations: they would have to name the kind of function
        table = table.combine_chunks()
        x = matrix(table.column("x").chunk(0))
        tree = Tree.of(x, table.column("vec_id").to_numpy(), leaf)
        return pa.table({"region": pa.array([key[0].as_py()], pa.int32()), "nth": pa.array([key[1].as_py()], pa.int32()), "tree": [pickle.dumps(tree)], "centre": [tree.centre[0].tobytes()], "radius": [float(tree.radius[0])]})

    return storage.staged(rows.groupBy("region", "nth").applyInArrow(build, "region int, nth int, tree binary, centre binary, radius double"), name)


def _same_width(a: Tree, b: Tree) -> None:
    """Pads the narrower tree's vectors with zeros."""
    wide = max(a.x.shape[1], b.x.shape[1])
    for t in (a, b):
        if t.x.shape[1] < wide:
            t.x, t.centre = (np.pad(v, ((0, 0), (0, wide - v.shape[1]))) for v in (t.x, t.centre))


def _rows(q: Tree, best: Best) -> list[pa.Array]:
    real = best.ids < NO_ID
    return [pa.array(np.repeat(q.ids, real.sum(axis=1))), pa.array(best.ids[real]), pa.array(best.scores[real].astype(np.int64))]


def top_k(vectors: DataFrame, k: int = TOP, every: int = QUERY_EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, the k highest inner products with rows
    of other ids (all, if fewer), ties to smaller ids.

    Vectors of unequal length count as padded with zeros. Repeated rows of an id are candidates as often as they occur; as
    queries they count once. Vectors that are null or empty or hold null or non-finite parts take no part, nor do null ids.
    An empty table, or one without queries, gives no rows; other columns take no part. Sums stay exact below 2**53.
    """
    spark = vectors.sparkSession
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    whole = integral(vectors)
    rows = whole.count()
    if not rows:
        return nothing
    data = storage.staged(_dealt(whole, Regions.of(whole, rows)), "dealt")
    # One vector of each query id.
    asked = storage.staged(data.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.max(F.struct("x", "region")).alias("m")).select("m.region", "vec_id", "m.x"), "asked")
    count = lambda df: {r.region: r.n for r in df.groupBy("region").agg(F.count("*").alias("n")).collect()}
    have, wanted = count(data), count(asked)
    if not wanted:
        return nothing
    blocks, queries = _blocks(data, have, DATA_BLOCK, LEAF, "data-blocks"), _blocks(asked, wanted, QUERY_BLOCK, QUERY_LEAF, "query-blocks")
    found = _searched(blocks, queries, have, k)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _reaches(blocks: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, centres and covering radii of the regions: a ball about the region's first block's centre holds its blocks."""
    first = blocks.groupBy("region").agg(F.min_by("centre", "nth").alias("first"))
    spark = blocks.sparkSession

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = [np.frombuffer(x, np.float64) for c in (1, 3) for x in b.column(c).to_pylist()]
                n, wide = b.num_rows, max(map(len, v))
                own, centre = (np.array([np.pad(x, (0, wide - len(x))) for x in part]) for part in (v[:n], v[n:]))
                reach = np.sqrt(((own - centre) ** 2).sum(axis=1)) + b.column(2).to_numpy()
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.array(reach)], ["region", "first", "reach"])

    joined = blocks.select("region", "centre", "radius").join(first, "region").mapInArrow(far, "region int, first binary, reach double")
    got = joined.groupBy("region").agg(F.first("first").alias("first"), F.max("reach").alias("reach")).orderBy("region").collect()  # at most MOST_REGIONS rows
    centres = [np.frombuffer(r["first"], np.float64) for r in got]
    wide = max(map(len, centres))
    return np.array([r.region for r in got]), np.array([np.pad(c, (0, wide - len(c))) for c in centres]), np.array([r.reach for r in got])


def _searched(blocks: DataFrame, queries: DataFrame, have: dict[int, int], k: int) -> DataFrame:
    """query_id, vec_id, score: at least the k best of each query."""
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast(_reaches(blocks))
    data = blocks.select(F.col("region").alias("d_region"), F.col("nth").alias("d_nth"), F.col("tree").alias("d_tree"))

    def home(key, table):  # without annotations: they would have to name the kind of function
        q = pickle.loads(table.column("tree")[0].as_py())
        best = Best(len(q.ids), k)
        for d in table.column("d_tree"):
            if d.is_valid:
                x = pickle.loads(d.as_py())
                _same_width(q, x)
                dual_search(q, x, best)
        region, centre, reach = shared.value
        wide = max(q.x.shape[1], centre.shape[1])
        qx, c = (np.pad(v, ((0, 0), (0, wide - v.shape[1]))) for v in (q.x, centre))
        most = qx @ c.T + np.sqrt((qx**2).sum(axis=1))[:, None] * reach
        open_ = best.may_gain(slice(0, len(qx)), most, np.full(len(region), -NO_ID)).any(axis=0)
        # The scores known go on with the block; its next meetings are with the regions that can better one of them.
        return pa.table({"region": [key[0].as_py()], "nth": [key[1].as_py()], "block": [pickle.dumps((q, best))], "open": [region[open_].tolist()]}, schema=pa.schema([("region", pa.int32()), ("nth", pa.int32()), ("block", pa.binary()), ("open", pa.list_(pa.int32()))]))

    near = queries.join(data.where(F.col("d_nth") < HOME_BLOCKS), F.col("region") == F.col("d_region"), "left").select("region", "nth", "tree", "d_tree")
    met = storage.staged(near.groupBy("region", "nth").applyInArrow(home, "region int, nth int, block binary, open array<int>"), "met")
    cuts = spark.createDataFrame([(r, -(-n // DATA_BLOCK)) for r, n in have.items()], "d_region int, cuts int")
    dealt = met.select("region", "block", F.explode("open").alias("d_region")).join(F.broadcast(cuts), "d_region")
    dealt = dealt.withColumn("d_nth", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).where((F.col("d_region") != F.col("region")) | (F.col("d_nth") >= HOME_BLOCKS))
    pairs = dealt.repartition(F.col("d_region"), F.col("d_nth")).join(data, ["d_region", "d_nth"]).select("block", "d_tree")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                yield pa.RecordBatch.from_arrays(_rows(*pickle.loads(x.as_py())), ["query_id", "vec_id", "score"])

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, d in zip(b.column(0), b.column(1), strict=True):
                (q, known), x = pickle.loads(block.as_py()), pickle.loads(d.as_py())
                _same_width(q, x)
                best = Best(len(q.ids), k)
                best.above(known.worst, known.worst_id)
                dual_search(q, x, best)
                yield pa.RecordBatch.from_arrays(_rows(q, best), ["query_id", "vec_id", "score"])

    schema = "query_id long, vec_id long, score long"
    return met.select("block").mapInArrow(first, schema).unionAll(pairs.mapInArrow(rest, schema))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """top_k() of all embeddings."""
    return top_k(storage.read(spark, sf_dir, "embeddings"))


ORACLE = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE}::DOUBLE * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id AS query_id, max(x) AS x FROM v WHERE vec_id % {QUERY_EVERY} = 0 GROUP BY vec_id),
s AS (SELECT query_id, vec_id, CAST(list_inner_product(q.x, v.x) AS BIGINT) AS score FROM q, v WHERE query_id <> vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {TOP}
"""
