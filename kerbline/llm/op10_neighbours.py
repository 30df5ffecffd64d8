"""Approximate nearest neighbours by few stable projections, a kd-tree and a chi-square stop.

Unit vectors are projected on ``DIMS`` Gaussian directions. For two vectors at distance ``d`` the
squared projected distance over ``d * d`` has a chi-square law, so once the next projected distance
is beyond ``d_k`` times a quantile of it, a nearer neighbour than the k-th found is unlikely.

The upper levels of the kd-tree are fitted on a bounded sample of projections and cut the space in
regions; every vector belongs to one. A region's vectors lie in blocks of bounded size, each with
its own leaves. A query visits the leaves of its home region first, nearest first, verifying the
vectors in order of projected distance until the stopping test holds. With the k-th distance found
there it goes to those regions that the test does not exclude, and the results are merged. Queries
of a region come in blocks as well, so no task meets more than a block of either.

Each length of vectors has a tree of its own: a query meets the vectors of its length. Vectors that are null, zero, or hold null
or non-finite components take no part, nor do rows without an id. Rows of one id count once (the
smallest vector by its bytes). Equal scores rank by the smaller id. An empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.session import cut_lineage

DIMS = 8
#: Standard normal quantile of the stopping probability 0.99.
STOP_Z = 2.326
QUANTILE = DIMS * (1 - 2 / (9 * DIMS) + STOP_Z * (2 / (9 * DIMS)) ** 0.5) ** 3
#: Projections the upper levels are fitted on: ``SPLIT`` a region, within these bounds.
SAMPLE, MOST, SPLIT = 4096, 1 << 18, 8
#: Rows of a block, queries of a block, rows of a leaf; gaps of queries and regions computed at once.
BLOCK, ASKED, LEAF, GAPS = 4096, 1024, 32, 1 << 20


def directions(dim: int) -> np.ndarray:
    return np.random.default_rng([10, dim]).normal(size=(dim, DIMS))


def project(vectors: np.ndarray) -> np.ndarray:
    unit = vectors / np.sqrt((vectors * vectors).sum(1))[:, None]
    return unit @ directions(vectors.shape[1])


@dataclass(frozen=True)
class Tree:
    """Splits in heap order: node ``i`` has children ``2 * i + 1`` and ``2 * i + 2``."""

    axis: np.ndarray
    cut: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def region(self, points: np.ndarray) -> np.ndarray:
        at = np.zeros(len(points), np.int64)
        inner = len(self.axis)
        while inner and at[:1].size and at.min() < inner:
            right = points[np.arange(len(points)), self.axis[at]] > self.cut[at]
            at = 2 * at + 1 + right
        return at - inner

    def gaps(self, points: np.ndarray) -> np.ndarray:
        """Squared projected distance from each point to each region."""
        out = np.maximum(self.low[None] - points[:, None], points[:, None] - self.high[None])
        return (np.maximum(out, 0) ** 2).sum(2)


def fit(points: np.ndarray, levels: int) -> Tree:
    """A balanced tree: the widest axis is cut at its median."""
    axis, cut = [], []
    parts = [(points, np.full(DIMS, -np.inf), np.full(DIMS, np.inf))]
    for _ in range(levels):
        below = []
        for own, low, high in parts:
            a = int(np.argmax(own.std(0))) if len(own) else 0
            c = float(np.median(own[:, a])) if len(own) else 0.0
            axis.append(a)
            cut.append(c)
            left_high, right_low = high.copy(), low.copy()
            left_high[a], right_low[a] = min(high[a], c), max(low[a], c)
            right = own[:, a] > c
            below += [(own[~right], low, left_high), (own[right], right_low, high)]
        parts = below
    return Tree(np.array(axis, np.int64), np.array(cut), np.stack([p[1] for p in parts]), np.stack([p[2] for p in parts]))


def leaves(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """kd-tree leaves of a block: order of the points, where each leaf begins, and its box."""
    parts, done = [np.arange(len(points))], []
    while parts:
        own = parts.pop()
        spread = np.ptp(points[own], axis=0)
        if len(own) <= LEAF or not spread.max() > 0:
            done.append(own)
            continue
        order = own[np.argsort(points[own, int(np.argmax(spread))], kind="stable")]
        parts += [order[: len(order) // 2], order[len(order) // 2 :]]
    head = np.concatenate([[0], np.cumsum([len(x) for x in done])[:-1]])
    low = np.stack([points[x].min(0) for x in done])
    high = np.stack([points[x].max(0) for x in done])
    return np.concatenate(done), head, low, high


def search(ids: np.ndarray, vectors: np.ndarray, asked_ids: np.ndarray, asked: np.ndarray, limit: np.ndarray, k: int) -> list[tuple]:
    """``(query, vec_id, score)`` of the best ``k`` in a block; ``limit`` bounds the squared distance
    of the k-th neighbour from what was found elsewhere."""
    points, norms = project(vectors), np.sqrt((vectors * vectors).sum(1))
    order, head, low, high = leaves(points)
    size = np.diff(np.append(head, len(ids)))
    places, asked_norms = project(asked), np.sqrt((asked * asked).sum(1))
    out = []
    for q in range(len(asked_ids)):
        gap = np.maximum(np.maximum(low - places[q], places[q] - high), 0)
        gap = (gap * gap).sum(1)
        visit = np.argsort(gap, kind="stable")
        best_id, best = np.zeros(0, np.int64), np.zeros(0)
        reach, at, step = limit[q], 0, 2
        # Leaves come in growing handfuls; the test is made before each.
        while at < len(visit) and gap[visit[at]] <= reach * QUANTILE + 1e-9:
            some = visit[at : at + step]
            some = some[gap[some] <= reach * QUANTILE + 1e-9]
            at, step = at + step, step * 2
            rows = order[np.concatenate([np.arange(head[s], head[s] + size[s]) for s in some])]
            rows = rows[(((points[rows] - places[q]) ** 2).sum(1) <= reach * QUANTILE + 1e-9) & (ids[rows] != asked_ids[q])]
            score = (vectors[rows] * asked[q]).sum(1) / (norms[rows] * asked_norms[q])
            best_id, best = np.concatenate([best_id, ids[rows]]), np.concatenate([best, score])
            top = np.lexsort((best_id, -best))[:k]
            best_id, best = best_id[top], best[top]
            if len(best) == k:
                reach = min(reach, max(0.0, 2 - 2 * best[-1]))
        out += zip([asked_ids[q]] * len(best), best_id, best, strict=True)
    return out


def _prepared(batches):
    for batch in batches:
        lists = batch.column("embedding")
        keep, blobs = [], []
        for i, one in enumerate(lists.to_pylist()):
            if one is None or not len(one) or any(x is None for x in one):
                continue
            v = np.array(one, np.float64)
            if np.isfinite(v).all() and (v * v).sum() > 0 and np.isfinite((v * v).sum()):
                keep.append(i)
                blobs.append(v.tobytes())
        ids = batch.column("vec_id").cast(pa.int64()).take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([ids, pa.array(blobs, pa.binary())], ["vec_id", "vec"])


def _matrix(blobs) -> np.ndarray:
    blobs = list(blobs)
    return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)


def _projected(batch: pa.RecordBatch):
    """``(length, rows, projections)`` for each length of vectors in a batch."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == dim)
        yield dim, rows, project(_matrix(batch.column("vec").take(pa.array(rows)).to_pylist()))


def _points(batches):
    for batch in batches:
        for dim, rows, points in _projected(batch):
            blobs = [p.tobytes() for p in points]
            yield pa.RecordBatch.from_arrays([pa.array([dim] * len(rows), pa.int32()), pa.array(blobs, pa.binary())], ["dim", "point"])


def _placed(trees: dict[int, Tree]):
    def run(batches):
        for batch in batches:
            region = np.zeros(batch.num_rows, np.int32)
            for dim, rows, points in _projected(batch):
                region[rows] = trees[dim].region(points)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(region)], [*batch.schema.names, "region"])

    return run


def _routed(trees: dict[int, Tree]):
    """Regions that the stopping test leaves open; without a bound, all others."""

    def run(batches):
        for batch in batches:
            reach, home = batch.column("reach").to_numpy(), batch.column("home").to_numpy()
            for dim, rows, points in _projected(batch):
                tree = trees[dim]
                some = max(1, GAPS // len(tree.low))
                for at in range(0, len(rows), some):
                    own = rows[at : at + some]
                    row, region = np.nonzero(tree.gaps(points[at : at + some]) <= reach[own][:, None] * QUANTILE + 1e-9)
                    other = region != home[own][row]
                    take, region = pa.array(own[row[other]]), region[other]
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(c).take(take) for c in ("vec_id", "dim", "vec", "reach")), pa.array(region.astype(np.int32))],
                        ["vec_id", "dim", "vec", "reach", "region"],
                    )

    return run


FOUND = "query_id long, vec_id long, score double"


def _search(k: int):
    def run(part):
        mine = part["reach"].isna().to_numpy()
        base, asked = part[mine], part[~mine]
        if not len(base) or not len(asked):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        found = search(
            base["vec_id"].to_numpy(), _matrix(base["vec"]), asked["vec_id"].to_numpy(), _matrix(asked["vec"]), asked["reach"].to_numpy(float), k
        )
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    return run


def _met(base: DataFrame, sizes: dict[tuple[int, int], int], asked: DataFrame, k: int) -> DataFrame:
    """Search each asked region: blocks of its vectors against blocks of its queries."""
    spark = base.sparkSession
    counts = asked.groupBy("dim", "region").count().collect()  # a row per region
    shares = [(r["dim"], r["region"], max(1, -(-sizes.get((r["dim"], r["region"]), 0) // BLOCK)), max(1, -(-r["count"] // ASKED))) for r in counts]
    table = F.broadcast(spark.createDataFrame(shares, "dim int, region int, blocks int, turns int"))

    def deal(of: str, parts: str) -> Column:
        return F.pmod(F.xxhash64(of), F.col(parts)).cast("int")

    all_of = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    left = base.join(table, ["dim", "region"]).withColumn("block", deal("vec_id", "blocks")).withColumn("turn", all_of("turns"))
    right = asked.join(table, ["dim", "region"]).withColumn("turn", deal("vec_id", "turns")).withColumn("block", all_of("blocks"))
    keys = ["dim", "region", "block", "turn"]
    both = left.select(*keys, "vec_id", "vec", F.lit(None).cast("double").alias("reach")).unionByName(right.select(*keys, "vec_id", "vec", "reach"))
    return both.groupBy(keys).applyInPandas(_search(k), FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query as an array, nearest first."""
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))), 1, k)
    return found.groupBy("query_id").agg(top.alias("top"))


def neighbours(embeddings: DataFrame, asked: Column, k: int = 5) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of the rows that ``asked`` selects, against all rows."""
    spark = embeddings.sparkSession
    rows = embeddings.filter("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    valid = rows.mapInArrow(_prepared, "vec_id long, vec binary").groupBy("vec_id").agg(F.min("vec").alias("vec"))
    vectors = cut_lineage(valid.withColumn("dim", F.expr("cast(length(vec) div 8 as int)")))
    counts = {r["dim"]: r["count"] for r in vectors.groupBy("dim").count().collect()}  # a row per length
    total = sum(counts.values())
    wanted = min(MOST, max(SAMPLE, SPLIT * total // BLOCK))
    share = int(min(1.0, wanted / max(1, total)) * (1 << 30))
    sampled = vectors.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < share).mapInArrow(_points, "dim int, point binary").collect()
    points = {d: [] for d in counts}
    for r in sampled:
        points[r["dim"]].append(r["point"])
    trees = {}
    for d, own in points.items():
        levels = int(np.ceil(np.log2(max(1, counts[d] / BLOCK))))
        most = int(np.log2(len(own) // SPLIT)) if len(own) >= SPLIT else 0
        trees[d] = fit(_matrix(own) if own else np.zeros((0, DIMS)), max(0, min(levels, most)))
    base = cut_lineage(vectors.mapInArrow(_placed(trees), "vec_id long, vec binary, dim int, region int"))
    sizes = {(r["dim"], r["region"]): r["count"] for r in base.groupBy("dim", "region").count().collect()}
    queries = base.filter(asked)
    home = cut_lineage(_best(_met(base, sizes, queries.withColumn("reach", F.lit(4.0)), k), k))
    worst = F.element_at("top", -1).getField("far")
    reach = F.when(F.size("top") == k, F.greatest(2 + 2 * worst, F.lit(0.0))).otherwise(F.lit(4.0))
    known = queries.join(home.select(F.col("query_id").alias("vec_id"), reach.alias("reach")), "vec_id", "left")
    open_ = known.select("vec_id", "dim", "vec", F.coalesce("reach", F.lit(4.0)).alias("reach"), F.col("region").alias("home"))
    routed = cut_lineage(open_.mapInArrow(_routed(trees), "vec_id long, dim int, vec binary, reach double, region int"))
    inner = home.select("query_id", F.explode("top").alias("t")).select("query_id", "t.vec_id", (-F.col("t.far")).alias("score"))
    found = inner if routed.isEmpty() else inner.unionByName(_met(base, sizes, routed, k))
    ranked = _best(found, k).select("query_id", F.posexplode("top").alias("at", "t"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "t.vec_id", (-F.col("t.far")).alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
