"""Approximate nearest neighbours: neighbour graphs by NN-descent, searched greedily.

The index holds different vectors only; rows with the same vector are its members and come back with it.
Vectors are dealt to shards by their nearest pivot, and each shard has a graph of its own. A query enters the
shards of its nearest pivots. How many, and how wide it searches there, is decided on a sample of the queries
that is compared with the whole table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from framesift.llm.tables import read, small_batches, uniform, written

NEIGHBOURS = 24  # edges each vector keeps
PROJECTIONS, BESIDE = 4, 8  # first neighbours: those beside a vector along random directions
SETTLED = 0.01  # share of changed edges at which the rounds end
WAYS_IN = 4  # nearest neighbours from which a vector is always reached, also where they are hubs
SHARD = 4096  # vectors of a shard on average; shards above twice as many are cut by hash
WIDTHS = (32, 64, 128, 256, 512, 1024)  # vectors a query may keep in a shard; the last is the most
CHECKED, RECALL = 64, 0.97  # queries compared with the whole table; share of their nearest the search must find
ENTRIES = 32  # starting points in a shard
AT_ONCE = 128  # vectors or queries handled in one array step


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, vec): rows that take part. Left out: null keys; vectors null, empty, zero, with null or
    non-finite components, or of another length than most."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    good = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vec")).where(F.col(key).isNotNull() & F.coalesce(fine, F.lit(False)))
    sizes = good.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return good.where(F.size("vec") == (sizes[0] if sizes else 0)).distinct()


def short(vec: pa.Array) -> np.ndarray:
    """Vectors as rows of single precision."""
    flat = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    return flat.reshape(len(vec), -1) if len(vec) else flat.reshape(0, 1)


def edge_batch(u, v, d) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(u, np.int64)), pa.array(np.asarray(v, np.int64)), pa.array(np.asarray(d, np.float64))], ["u", "v", "d"])


# -- one shard ---------------------------------------------------------------------------------------------

def closest(x: np.ndarray, norm: np.ndarray, at: np.ndarray, offers: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The `most` nearest different offers of the vectors `at`, nearest first, and their squared distances."""
    offers = np.sort(offers.astype(np.int32), 1)
    d = norm[at][:, None] + norm[offers] - 2 * np.matmul(x[offers], x[at][:, :, None])[:, :, 0]
    d[offers == at[:, None]] = np.inf
    d[:, 1:][offers[:, 1:] == offers[:, :-1]] = np.inf
    best = np.argpartition(d, most - 1, 1)[:, :most]
    best = np.take_along_axis(best, np.argsort(np.take_along_axis(d, best, 1), 1), 1)
    return np.take_along_axis(offers, best, 1), np.take_along_axis(d, best, 1)


def neighbour_graph(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """NN-descent: the neighbours found for each vector, nearest first, and their squared distances; infinite where
    there are fewer. Each round offers every vector the neighbours of its neighbours, taken both ways."""
    n, norm = len(x), (x * x).sum(1)
    k = min(NEIGHBOURS, n - 1)
    if k < 1:
        return np.empty((n, 0), np.int64), np.empty((n, 0), np.float32)
    random = np.random.default_rng(0)
    offers = []
    for _ in range(PROJECTIONS):
        order = np.argsort(x @ random.standard_normal(x.shape[1]), kind="stable")
        place = np.argsort(order)
        offers += [order[(place + o) % n] for o in range(-BESIDE, BESIDE + 1) if o]
    offers = np.stack(offers, 1)
    near, d = closest(x, norm, np.arange(n), offers, min(k, offers.shape[1]))
    near, d = np.pad(near, ((0, 0), (0, k - near.shape[1])), mode="edge"), np.pad(d, ((0, 0), (0, k - d.shape[1])), constant_values=np.inf)
    while True:
        back = near.copy()  # where few come back, the own neighbours stand in
        to, source, far = near.ravel(), np.repeat(np.arange(n), k), d.ravel()
        by = np.lexsort((far, to))
        rank = np.arange(n * k) - np.searchsorted(to[by], to[by])
        some = (rank < k) & np.isfinite(far[by])
        back[to[by][some], rank[some]] = source[by][some]
        ways, news = np.hstack([near, back]), []
        for lo in range(0, n, AT_ONCE):
            at = np.arange(lo, min(n, lo + AT_ONCE))
            news.append(closest(x, norm, at, np.hstack([near[at], ways[at], near[ways[at]].reshape(len(at), -1)]), k))
        better, d_new = (np.concatenate(v) for v in zip(*news))
        changed = (d_new < d).sum()
        near, d = better, d_new
        if changed <= SETTLED * n * k:
            return near, d


def ways_of(near: np.ndarray, d: np.ndarray) -> pa.ListArray:
    """The edges of each vector both ways: a hub leads to its nearest followers only, but each vector is reached
    from its WAYS_IN nearest."""
    n, k = near.shape
    own, u, v, far = np.tile(np.arange(k), n), np.repeat(np.arange(n), k), near.ravel(), d.ravel()
    own, u, v, far = (a[np.isfinite(far)] for a in (own, u, v, far))
    by = np.lexsort((far, v))
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by)) - np.searchsorted(v[by], v[by])
    back = (rank < NEIGHBOURS) | (own < WAYS_IN)
    pairs = np.unique(np.r_[u * n + v, v[back] * n + u[back]])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs, np.arange(n + 1) * n).astype(np.int32)), pa.array((pairs % n).astype(np.int32)))


def greedy_search(x: np.ndarray, ways: pa.ListArray, q: np.ndarray, own: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of each query to the vectors it has seen (infinite: not seen). It starts at ENTRIES vectors
    and at its own (`own`, -1 if it is elsewhere) and each hop follows the edges of the nearest vectors not yet
    followed, until the `width` nearest all are."""
    n, norm = len(x), (x * x).sum(1)
    first, flat = ways.offsets.to_numpy(), ways.values.to_numpy()
    d, done = np.full((len(q), n), np.inf, np.float32), np.zeros((len(q), n), bool)

    def see(row, node):
        code = np.unique(row * n + node)
        row, node = code // n, code % n
        new = np.isinf(d[row, node])
        row, node = row[new], node[new]
        d[row, node] = np.maximum(norm[node] - 2 * np.einsum("ij,ij->i", x[node], q[row]) + (q[row] * q[row]).sum(1), 0)

    entries = np.unique(np.linspace(0, n - 1, min(n, ENTRIES)).astype(np.int64))
    see(np.repeat(np.arange(len(q)), len(entries)), np.tile(entries, len(q)))
    here = np.flatnonzero(own >= 0)
    see(here, own[here])
    width = min(width, n)
    while True:
        top = np.argpartition(d, width - 1, 1)[:, :width]
        far = np.where(np.take_along_axis(done, top, 1), np.inf, np.take_along_axis(d, top, 1))
        at = np.argsort(far, 1)[:, :max(1, width // 4)]
        row, col = np.nonzero(np.isfinite(np.take_along_axis(far, at, 1)))
        if not len(row):
            return d
        node = top[row, at[row, col]]
        done[row, node] = True
        size = first[node + 1] - first[node]
        see(np.repeat(row, size), flat[np.repeat(first[node] - np.cumsum(size) + size, size) + np.arange(size.sum())].astype(np.int64))


# -- the index ---------------------------------------------------------------------------------------------

def pivots_of(nodes: DataFrame) -> np.ndarray:
    """One vector in SHARD, a sample by hash."""
    total = nodes.count()
    rows = nodes.orderBy(uniform(F.lit("pivot"), "node"), "node").limit(-(-total // SHARD)).select("vec").collect()
    return np.array([r.vec for r in rows], np.float32).reshape(len(rows), -1 if rows else 0)


def index(nodes: DataFrame, pivots: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """(pivot, part, node, vec, ways): every vector in its shard with its edges, as places in the shard by node;
    and (pivot, part): the shards."""
    kind = nodes.schema["vec"].dataType.simpleString()

    def assign(batches):
        for b in batches:
            near = ((pivots * pivots).sum(1)[None, :] - 2 * short(b["vec"]) @ pivots.T).argmin(1) if b.num_rows else np.empty(0)
            yield b.append_column("pivot", pa.array(near.astype(np.int32)))

    placed = written(nodes.select("node", "vec").mapInArrow(assign, f"node long, vec {kind}, pivot int"), "nn_placed")
    sizes = written(placed.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / (2 * SHARD)).cast("int").alias("parts")), "nn_shards")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")

    def build(table):
        table = table.sort_by("node")
        near, d = neighbour_graph(short(table["vec"].combine_chunks()))
        return table.append_column("ways", ways_of(near, d))

    dealt = placed.join(F.broadcast(sizes), "pivot").select("pivot", part.alias("part"), "node", "vec")
    graph = dealt.groupBy("pivot", "part").applyInArrow(build, f"pivot int, part int, node long, vec {kind}, ways array<int>")
    return written(graph, "nn_graph"), sizes.select("pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))


def routed(queries: DataFrame, pivots: np.ndarray, most: int) -> DataFrame:
    """(query_id, node, qvec, pivot, rank): each query at its `most` nearest pivots, ranked from 1."""
    kind = queries.schema["qvec"].dataType.simpleString()

    def route(batches):
        for b in batches:
            if b.num_rows:
                d = (pivots * pivots).sum(1)[None, :] - 2 * short(b["qvec"]) @ pivots.T
                near = np.argsort(d, 1, kind="stable")[:, :most]
                out = b.take(pa.array(np.repeat(np.arange(b.num_rows), near.shape[1])))
                rank = np.tile(np.arange(1, near.shape[1] + 1, dtype=np.int32), b.num_rows)
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(near.ravel().astype(np.int32)), pa.array(rank)], [*out.schema.names, "pivot", "rank"])

    return queries.select("query_id", "node", "qvec").mapInArrow(route, f"query_id long, node long, qvec {kind}, pivot int, rank int")


def hits_in(graph: DataFrame, asked: DataFrame, widths: tuple[int, ...], k: int) -> DataFrame:
    """(query_id, node, d, rank, width): the k + 1 nearest vectors that each asked query finds in each shard it enters,
    for each width; twice as many candidates, whose distances single precision may have swapped."""

    def search(left, right):
        out: list[pa.RecordBatch] = []
        left = left.sort_by("node")
        node, x = left["node"].to_numpy(), short(left["vec"].combine_chunks()) if left.num_rows else None
        ways = left["ways"].combine_chunks() if left.num_rows else None
        for lo in range(0, right.num_rows if left.num_rows else 0, AT_ONCE):
            some = right.slice(lo, AT_ONCE)
            own = some["node"].to_numpy()
            at = np.minimum(np.searchsorted(node, own), len(node) - 1)
            own = np.where(node[at] == own, at, -1)
            for width in widths:
                d = greedy_search(x, ways, short(some["qvec"].combine_chunks()), own, width)
                best = np.argsort(d, 1, kind="stable")[:, :2 * (k + 1)]
                row, col = np.nonzero(np.isfinite(np.take_along_axis(d, best, 1)))
                near = best[row, col]
                out.append(pa.RecordBatch.from_arrays([some["query_id"].take(pa.array(row)).combine_chunks(), pa.array(node[near]), pa.array(d[row, near].astype(float)), some["rank"].take(pa.array(row)).combine_chunks(),
                                                       pa.array(np.full(len(row), width, np.int32))], names))
        return pa.Table.from_batches(out, pa.schema(dict(zip(names, (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())))))

    names = ["query_id", "node", "d", "rank", "width"]
    return graph.groupBy("pivot", "part").cogroup(asked.groupBy("pivot", "part")).applyInArrow(search, "query_id long, node long, d double, rank int, width int")


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def exact(queries: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(query_id, node): the k nearest other vectors of a few queries, from the whole table."""
    sample = queries.collect()
    ids, own = np.array([r.query_id for r in sample], np.int64), np.array([r.node for r in sample], np.int64)
    q = np.array([r.qvec for r in sample], float).reshape(len(sample), -1 if sample else 0)

    def look(batches):
        d, node = np.empty((len(ids), 0)), np.empty((len(ids), 0), np.int64)
        for b in batches:
            if b.num_rows and len(ids):
                x, name = short(b["vec"]).astype(float), b["node"].to_numpy()
                far = (q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * (q @ x.T)
                far[own[:, None] == name[None, :]] = np.inf
                d, node = np.hstack([d, far]), np.hstack([node, np.broadcast_to(name, far.shape)])
                at = np.argsort(d, 1, kind="stable")[:, :k]
                d, node = np.take_along_axis(d, at, 1), np.take_along_axis(node, at, 1)
        row, col = np.nonzero(np.isfinite(d))
        yield edge_batch(ids[row], node[row, col], d[row, col])

    found = nodes.select("node", "vec").mapInArrow(look, "u long, v long, d double")
    rank = F.row_number().over(W.partitionBy("u").orderBy("d", "v"))
    return written(found.withColumn("r", rank).where(F.col("r") <= k).select(F.col("u").alias("query_id"), F.col("v").alias("node")), "nn_exact")


def breadth(graph: DataFrame, shards: DataFrame, pivots: np.ndarray, queries: DataFrame, nodes: DataFrame, k: int) -> tuple[int, int]:
    """How many pivots a query must enter and how many vectors it must keep in a shard, so that CHECKED queries, a
    sample by hash, find RECALL of their nearest; the cheapest such pair, or else all pivots and the largest width."""
    sample = written(queries.orderBy(uniform(F.lit("checked"), "query_id"), "query_id").limit(CHECKED), "nn_checked")
    wanted = exact(sample, nodes, k)
    asked = routed(sample, pivots, len(pivots)).join(F.broadcast(shards), "pivot")
    hits = hits_in(graph, asked, WIDTHS, k).join(F.broadcast(wanted), ["query_id", "node"]).select("width", "rank").toArrow()
    width, rank = hits["width"].to_numpy(), hits["rank"].to_numpy()
    need = RECALL * wanted.count()
    fits = []
    for w in WIDTHS:
        found = np.cumsum(np.bincount(rank[width == w], minlength=len(pivots) + 1))
        if len(pivots) and found[-1] >= need:
            p = max(1, int(np.searchsorted(found, need)))
            fits.append((w * p, p, w))
    return min(fits)[1:] if fits else (len(pivots), WIDTHS[-1])


def nearest(rows: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row that meets `is_query`.

    score is the Euclidean distance of the original vectors in double precision; ties go to smaller
    keys. Rows that `usable` leaves out take no part. Repeated rows count once; rows with one key and
    different vectors are different rows.
    """
    good = written(usable(rows, key, vector), "nn_rows")
    nodes = written(good.groupBy("vec").agg(F.min("vec_id").alias("node")).select("node", "vec"), "nn_nodes")
    nodes = distinct_nodes(nodes)
    named = written(good.join(nodes.select("node", "vec"), "vec").select("vec_id", "node", "vec"), "nn_named")
    small_batches(rows.sparkSession)
    pivots = pivots_of(nodes)
    graph, shards = index(nodes, pivots)
    queries = written(named.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("node", F.col("vec").alias("qvec"))).alias("q")).select("query_id", "q.node", "q.qvec"), "nn_queries")
    enter, width = breadth(graph, shards, pivots, queries, nodes, k)
    hits = hits_in(graph, routed(queries, pivots, enter).join(F.broadcast(shards), "pivot"), (width,), k)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("d", "node"))
    hits = hits.withColumn("r", rank).where(F.col("r") <= 2 * (k + 1)).select("query_id", "node")
    found = hits.join(nodes, "node").join(queries.select("query_id", "qvec"), "query_id").select("query_id", "node", distance(F.col("qvec"), F.col("vec")).alias("score"))
    few = W.partitionBy("node").orderBy("vec_id")  # no more members of one vector than a result can hold
    members = named.select("node", "vec_id").withColumn("r", F.row_number().over(few)).where(F.col("r") <= k + 1).drop("r")
    hits = found.join(members, "node").where("vec_id <> query_id")
    hits = hits.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def distinct_nodes(nodes: DataFrame) -> DataFrame:
    """Names of vectors must differ: where one key has several vectors, later ones get negative names."""
    doubled = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if doubled.isEmpty():
        return nodes
    rank = F.row_number().over(W.partitionBy("node").orderBy("vec"))
    return written(nodes.withColumn("r", rank).select(F.when(F.col("r") == 1, F.col("node")).otherwise(-F.abs(F.xxhash64("vec", "node")) - 1).alias("node"), "vec"), "nn_nodes")


def op1(spark, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
