"""Hard-negative mining with candidate lists that the anchors of a cluster share.

Components are cut to whole numbers, ``floor(256 * x)``, and a score is the inner product of two vectors. Anchors are
clustered by direction (centroids fitted on a bounded sample). No member of a cluster is more than its angle ``b`` away from the
centroid, so a candidate at the angle ``c`` scores ``|anchor| * |candidate| * cos(max(0, c - b))`` at most. That bound, without
``|anchor|``, is the same for all members: it is computed once, written, and orders the cluster's list. The list is cut in
``BANDS`` by its bounds; a member goes through them from the top until what it has found certifies that nothing
further down counts. Inside a band, blocks of the list meet blocks of anchors, and each
walks its part from the top with the same test.

First the walk finds the positives, the best rows of the anchor's label. Then, with their scores known, it finds
for each of them the best rows of other labels that score between ``low`` percent of it and all of it.

Rows of one label with one vector differ by their ids alone, so only the smallest ids of them, as many as any result can
name, are candidates, and anchors among them walk once. Those smallest ids are picked before rows are exchanged.

Rows without an id or label, with a null vector or with a null or non-finite component take no part, nor do those whose
whole numbers have a squared length of ``2**62`` or more, as products of theirs need not fit a long. Rows of one id count once, the one with the
smallest label, then the smallest vector by its bytes. Vectors of different lengths never meet; empty ones and zero vectors score
0. Equal scores rank by the smaller id. An anchor without a positive or negative has no rows; an empty table has none either. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kerbline.session import cut_lineage

#: Anchor clusters for each length of vectors, and anchors or candidates looked at to place centroids and bands.
CLUSTERS, SAMPLE = 8, 4096
#: Shares of a list that the bands before the last one end at.
BANDS = (1 / 32, 1 / 4)
#: Bytes of candidates and of anchors that meet in one group; rows of the list between two tests.
BLOCK_BYTES, TURN_BYTES, WALK = 32 << 20, 8 << 20, 1024
#: Radians added against rounding.
SLACK = 1e-6


def _whole(batches):
    for batch in batches:
        lists = batch.column("embedding").cast(pa.list_(pa.float64()))
        offsets = lists.offsets.to_numpy().astype(np.int64)
        values = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]] if len(lists) else np.zeros(0)
        offsets = offsets - offsets[0] if len(offsets) else offsets
        with np.errstate(over="ignore", invalid="ignore"):
            whole = np.floor(256 * values)
            fits = np.abs(whole) < 2**31
        whole[~fits] = 0
        row = np.repeat(np.arange(len(lists)), np.diff(offsets))
        square = np.bincount(row, whole * whole, len(lists))
        good = ~np.asarray(lists.is_null()) & (np.bincount(row[~fits], minlength=len(lists)) == 0) & (square < 2.0**62)
        keep, buffer = np.flatnonzero(good), whole.astype("<i4").tobytes()
        blobs = [buffer[4 * offsets[i] : 4 * offsets[i + 1]] for i in keep.tolist()]
        at = pa.array(keep)
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id").take(at), batch.column("label").take(at), pa.array(blobs, pa.binary()), pa.array(np.sqrt(square[keep]))],
            ["vec_id", "label", "vec", "norm"],
        )


def _matrix(blobs) -> np.ndarray:
    blobs = list(blobs)
    width = len(blobs[0]) // 4 if blobs else 0
    return np.frombuffer(b"".join(blobs), "<i4").reshape(len(blobs), width)


def _cosines(vectors: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.clip(vectors @ centroids.T / np.where(norms > 0, norms, 1)[:, None], -1, 1)


def centroids(vectors: np.ndarray, clusters: int) -> np.ndarray:
    """Unit directions by a few rounds of spherical k-means."""
    norms = np.sqrt((vectors * vectors).sum(1))
    unit = vectors[norms > 0] / norms[norms > 0][:, None]
    if not len(unit):
        return np.full((1, vectors.shape[1]), max(1, vectors.shape[1]) ** -0.5)
    # Starts far from each other: each next one has the lowest best cosine.
    chosen, best = [0], unit @ unit[0]
    while len(chosen) < clusters and best.min() < 1 - 1e-9:
        chosen.append(int(np.argmin(best)))
        best = np.maximum(best, unit @ unit[chosen[-1]])
    centre = unit[chosen]
    for _ in range(8):
        near = (unit @ centre.T).argmax(1)
        total = np.stack([unit[near == c].sum(0) for c in range(len(centre))])
        length = np.sqrt((total * total).sum(1))
        centre = np.where(length[:, None] > 1e-12, total / np.maximum(length, 1e-12)[:, None], centre)
    return centre


def _by_width(blobs: list[bytes]):
    """Rows of a batch with vectors of one length."""
    width = np.array([len(b) // 4 for b in blobs], np.int64)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        yield int(w), rows, _matrix(blobs[i] for i in rows).astype(np.float64)


def _centre(fitted: dict, width: int) -> np.ndarray:
    return fitted.get(width, np.full((1, width), max(1, width) ** -0.5))


def _assigned(fitted: dict):
    """The nearest centroid of each anchor and the angle to it."""

    def run(batches):
        for batch in batches:
            blobs, norms = batch.column("vec").to_pylist(), batch.column("norm").to_numpy()
            cluster, angle = np.zeros(len(blobs), np.int32), np.zeros(len(blobs))
            for width, rows, vectors in _by_width(blobs):
                cos = _cosines(vectors, norms[rows], _centre(fitted, width))
                cluster[rows] = cos.argmax(1)
                angle[rows] = np.arccos(cos.max(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster), pa.array(angle)], [*batch.schema.names, "cluster", "angle"])

    return run


def _bounded(fitted: dict, reach: dict):
    """The list: each candidate's bound for every cluster of its length; null where no anchor is."""

    def run(batches):
        for batch in batches:
            blobs, norms = batch.column("vec").to_pylist(), batch.column("norm").to_numpy()
            out: list = [None] * len(blobs)
            for width, rows, vectors in _by_width(blobs):
                centre = _centre(fitted, width)
                wide = np.array([reach.get((width, c), np.nan) for c in range(len(centre))])
                angle = np.arccos(_cosines(vectors, norms[rows], centre)) - wide - SLACK
                bound = norms[rows][:, None] * np.cos(np.maximum(angle, 0))
                for i, one in zip(rows.tolist(), bound.tolist(), strict=True):
                    out[i] = [None if x != x else x for x in one]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float64()))], [*batch.schema.names, "bounds"])

    return run


def _best(owner: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the ``k`` best entries of each owner."""
    order = np.lexsort((ids, -score, owner))
    head = np.flatnonzero(np.append(True, owner[order][1:] != owner[order][:-1])) if len(order) else order
    rank = np.arange(len(order)) - np.repeat(head, np.diff(np.append(head, len(order))))
    return order[rank < k]


def _kth(owner: np.ndarray, score: np.ndarray, k: int, owners: int) -> np.ndarray:
    """The ``k``-th best score of each owner; minus infinity where it has fewer. At most ``k`` entries each."""
    full = np.bincount(owner, minlength=owners) >= k
    least = np.full(owners, np.inf)
    np.minimum.at(least, owner, score.astype(np.float64))
    return np.where(full, least, -np.inf)


class _Walk:
    """A part of a list, the highest bound first, and the anchors that walk it."""

    def __init__(self, base: pd.DataFrame, asked: pd.DataFrame):
        base = base.iloc[np.argsort(-base["bound"].to_numpy(), kind="stable")]
        self.bound, self.ids, self.labels = (base[c].to_numpy() for c in ("bound", "vec_id", "label"))
        self.norms, self.own = asked["norm"].to_numpy(), asked["label"].to_numpy()
        large = self.norms.max(initial=0) * base["norm"].max() >= 2.0**52
        kind = np.int64 if large else np.float64  # products below 2**53 are exact in doubles
        self.rows, self.anchors = _matrix(base["vec"]).astype(kind), _matrix(asked["vec"]).astype(kind)

    def steps(self, need: np.ndarray):
        """``(anchors, rows, scores)`` from the top; ``need`` is read anew before each."""
        for at in range(0, len(self.ids), WALK):
            # An equal score may still win by its id.
            open_ = np.flatnonzero(need <= self.norms * self.bound[at] * (1 + 1e-12))
            if not len(open_):
                return
            yield open_, slice(at, at + WALK), (self.anchors[open_] @ self.rows[at : at + WALK].T).astype(np.int64)


def _positives(k: int):
    def run(base, asked):
        none = np.zeros(0, np.int64)
        owner, score, ids = none, none, none
        if len(base) and len(asked):
            walk = _Walk(base, asked)
            known = asked["need"].fillna(-np.inf).to_numpy()
            need = known.copy()
            for some, rows, scores in walk.steps(need):
                a, b = np.nonzero((walk.own[some][:, None] == walk.labels[rows][None]) & (scores >= need[some][:, None]))
                owner, score = np.concatenate([owner, some[a]]), np.concatenate([score, scores[a, b]])
                ids = np.concatenate([ids, walk.ids[rows][b]])
                top = _best(owner, score, ids, k)
                owner, score, ids = owner[top], score[top], ids[top]
                need[:] = np.maximum(known, _kth(owner, score, k, len(asked)))
        return pd.DataFrame({"rep": asked["rep"].to_numpy()[owner] if len(owner) else none, "vec_id": ids, "score": score})

    return run


def _negatives(k: int, low: int):
    def run(base, asked):
        none = np.zeros(0, np.int64)
        owner, score, ids, level = none, none, none, none
        if len(base) and len(asked):
            walk = _Walk(base, asked)
            lists = asked["levels"].tolist()
            wide = max(map(len, lists))
            # Scores of positives, the highest first; a level that is not there admits nothing.
            levels = np.full((len(lists), wide), -1, np.int64)
            for i, one in enumerate(lists):
                levels[i, : len(one)] = one
            floor = np.where(levels >= 0, -(-levels * low // 100), 1)
            least = np.array([len(one) - 1 for one in lists])
            start = floor[np.arange(len(lists)), least].astype(np.float64)
            need = start.copy()
            for some, rows, scores in walk.steps(need):
                a, b = np.nonzero((walk.own[some][:, None] != walk.labels[rows][None]) & (scores <= levels[some, 0][:, None]) & (scores >= need[some][:, None]))
                found, by, name = some[a], scores[a, b], walk.ids[rows][b]
                for j in range(wide):
                    ok = (by <= levels[found, j]) & (by >= floor[found, j])
                    owner, score = np.concatenate([owner, found[ok] * wide + j]), np.concatenate([score, by[ok]])
                    ids = np.concatenate([ids, name[ok]])
                top = _best(owner, score, ids, k)
                owner, score, ids = owner[top], score[top], ids[top]
                # Whoever has enough below the lowest positive has enough below the others.
                kth = _kth(owner, score, k, len(lists) * wide).reshape(len(lists), wide)
                need[:] = np.maximum(start, kth[np.arange(len(lists)), least])
            owner, level = owner // wide, levels[owner // wide, owner % wide]
        return pd.DataFrame({"rep": asked["rep"].to_numpy()[owner] if len(owner) else none, "level": level, "vec_id": ids, "score": score})

    return run


class _Lists:
    """The written lists with their bands, and what it takes to meet anchors."""

    def __init__(self, rows: DataFrame, edges: dict[tuple[int, int], list[float]]):
        self.rows, self.edges, self.spark = rows, edges, rows.sparkSession
        ends = {key: enumerate(zip([*e, -np.inf], [np.inf, *e], strict=True)) for key, e in edges.items()}
        self.ends = {(w, c, b): (low, high) for (w, c), e in ends.items() for b, (low, high) in e}  # a few per length of vectors
        cuts = [(*key, *end) for key, end in self.ends.items()]
        self.cuts = self.spark.createDataFrame(cuts, "width int, cluster int, band int, low double, high double")
        self.entries = rows.select("width", "vec_id", "label", "vec", "norm", F.posexplode("bounds").alias("cluster", "bound")).filter("bound is not null")
        banded = self.entries.select("width", "cluster", "bound").join(F.broadcast(self.cuts), ["width", "cluster"]).filter("bound >= low and bound < high")
        self.sizes = {(r["width"], r["cluster"], r["band"]): r["count"] for r in banded.groupBy("width", "cluster", "band").count().collect()}

    def meet(self, asked: DataFrame, run, schema: str) -> DataFrame:
        """Anchors against the bands ``first`` to ``last`` of their cluster's list, in blocks."""
        turns: dict[tuple[int, int, int], int] = {}
        for r in asked.groupBy("width", "cluster", "first", "last").count().collect():  # a row per pair of bands
            for b in range(r["first"], r["last"] + 1):
                turns[r["width"], r["cluster"], b] = turns.get((r["width"], r["cluster"], b), 0) + r["count"]
        parts = []
        for (w, c, b), n in turns.items():
            size = 4 + 8 * w
            blocks = -(-self.sizes.get((w, c, b), 0) * size // BLOCK_BYTES)
            if blocks:
                parts.append((w, c, b, *self.ends[w, c, b], int(blocks), int(max(1, -(-n * size // TURN_BYTES)))))
        # One table for each side, as the sides are joined.
        plan = "width int, cluster int, band int, low double, high double, blocks int, turns int"
        mine, theirs = (F.broadcast(self.spark.createDataFrame(parts, plan)) for _ in range(2))
        deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = self.entries.join(mine, ["width", "cluster"]).filter("bound >= low and bound < high")
        left = left.withColumn("block", deal("vec_id", "blocks")).withColumn("turn", every("turns"))
        right = asked.join(theirs, ["width", "cluster"]).filter("band between first and last")
        right = right.withColumn("turn", deal("rep", "turns")).withColumn("block", every("blocks"))
        keys = ["width", "cluster", "band", "block", "turn"]
        left = left.select(*keys, "vec_id", "label", "vec", "norm", "bound").groupBy(keys)
        right = right.select(*keys, *(c for c in asked.columns if c not in keys)).groupBy(keys)
        return left.cogroup(right).applyInPandas(run, schema)

    def below(self, asked: DataFrame) -> DataFrame:
        """Anchors with the highest score that the bands after ``last`` can give them."""
        table = F.broadcast(self.cuts.select("width", "cluster", F.col("band").alias("last"), "low"))
        return asked.join(table, ["width", "cluster", "last"]).withColumn("limit", F.col("norm") * F.col("low") * (1 + 1e-12))


def _top(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("place", place).filter(F.col("place") <= k)


def _grown(state: DataFrame | None, new: DataFrame, keys: list[str], k: int) -> DataFrame:
    both = new if state is None else state.drop("place").unionByName(new)
    return cut_lineage(_top(both, keys, k))


def _sampled(rows: DataFrame, of: str, total: int, *columns) -> list:
    """About ``SAMPLE`` rows by a hash of the id."""
    share = int(min(1.0, SAMPLE / max(1, total)) * (1 << 30))
    return rows.filter(F.pmod(F.xxhash64(of), F.lit(1 << 30)) < share).select(*columns).collect()


def vectors(embeddings: DataFrame, label: Column) -> DataFrame:
    """``(vec_id, label, vec, norm, width)``: a row for each id that takes part, written."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), "embedding")
    whole = rows.filter("vec_id is not null and label is not null").mapInArrow(_whole, "vec_id long, label long, vec binary, norm double")
    once = whole.groupBy("vec_id").agg(F.min(F.struct("label", "vec", "norm")).alias("r")).select("vec_id", "r.*")
    return cut_lineage(once.withColumn("width", F.expr("cast(length(vec) div 4 as int)")))


def negatives(embeddings: DataFrame, anchor: Column, label: Column, positives: int = 5, mined: int = 5, low: int = 80) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``anchor`` selects anchors by ``vec_id``; ``label`` is the label of a row; ``low`` is a percentage below 100.
    """
    rows = vectors(embeddings, label)
    keep = max(positives + 1, mined)
    same = W.partitionBy("label", "vec").orderBy("vec_id")
    candidates = cut_lineage(rows.withColumn("copy", F.row_number().over(same)).filter(F.col("copy") <= keep).drop("copy"))
    anchors = rows.filter(anchor)
    reps = cut_lineage(anchors.groupBy("label", "vec", "norm", "width").agg(F.min("vec_id").alias("rep")))
    members = anchors.join(reps.select("label", "vec", "rep"), ["label", "vec"]).select(F.col("vec_id").alias("anchor_id"), "rep")

    fitted: dict[int, list] = {}
    for r in _sampled(reps, "rep", reps.count(), "width", "vec"):
        fitted.setdefault(r["width"], []).append(r["vec"])
    fitted = {w: centroids(_matrix(v).astype(np.float64), CLUSTERS) for w, v in fitted.items()}
    columns = "label long, vec binary, norm double, width int, rep long, cluster int, angle double"
    asked = cut_lineage(reps.select("label", "vec", "norm", "width", "rep").mapInArrow(_assigned(fitted), columns))
    reach = {(r["width"], r["cluster"]): r["angle"] for r in asked.groupBy("width", "cluster").agg(F.max("angle").alias("angle")).collect()}

    bounded = candidates.select("vec_id", "label", "vec", "norm", "width").mapInArrow(
        _bounded(fitted, reach), "vec_id long, label long, vec binary, norm double, width int, bounds array<double>"
    )
    listed = cut_lineage(bounded)
    seen: dict[tuple[int, int], list[float]] = {key: [] for key in reach}
    for r in _sampled(listed, "vec_id", listed.count(), "width", "bounds"):
        for c, x in enumerate(r["bounds"]):
            if x is not None:
                seen[r["width"], c].append(x)
    edges = {key: [float(np.quantile(x, 1 - s)) if x else -np.inf for s in BANDS] for key, x in seen.items()}
    lists = _Lists(listed, edges)

    found = _walk_positives(lists, asked, positives + 1)
    mined_rows = _walk_negatives(lists, found, mined, low)
    order = F.struct("place", F.col("vec_id").alias("id"), "score")
    near = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), F.col("vec_id").alias("id"))))
    below = mined_rows.groupBy("rep", F.col("level").alias("score")).agg(near.alias("negatives"))
    lists_of = found.join(below, ["rep", "score"], "left").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct(order.alias("of"), "negatives"))).alias("all"))
    others = F.slice(F.filter("all", lambda p: p["of"]["id"] != F.col("anchor_id")), 1, positives)
    each = members.join(lists_of, "rep").select("anchor_id", F.explode(others).alias("p"))
    each = each.select("anchor_id", F.col("p.of").alias("of"), F.posexplode("p.negatives").alias("at", "n"))
    return each.select(
        "anchor_id",
        F.col("of.id").alias("positive_id"),
        (F.col("at") + 1).cast("int").alias("rank"),
        F.col("n.id").alias("negative_id"),
        F.col("of.score").alias("positive_score"),
        (-F.col("n.far")).alias("negative_score"),
    )


def _walk_positives(lists: _Lists, asked: DataFrame, k: int) -> DataFrame:
    """``(rep, vec_id, score, place, width, cluster, label, vec, norm, closed)``; ``closed`` is the last band an anchor needed."""
    state, open_, done = None, asked.drop("angle").withColumn("need", F.lit(None).cast("double")), []
    for band in range(len(BANDS) + 1):
        now = open_.withColumns({"first": F.lit(band), "last": F.lit(band)})
        state = _grown(state, lists.meet(now, _positives(k), "rep long, vec_id long, score long"), ["rep"], k)
        kth = state.groupBy("rep").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("least"))
        after = lists.below(now.drop("need")).join(kth, "rep", "left")
        certain = F.coalesce((F.col("n") == k) & (F.col("least") > F.col("limit")), F.lit(False)) | F.lit(band == len(BANDS))
        after = cut_lineage(after.withColumn("certain", certain).withColumn("need", F.when(F.col("n") == k, F.col("least"))))
        kept = ["label", "vec", "norm", "width", "rep", "cluster"]
        done.append(after.filter("certain").select(*kept, F.col("last").alias("closed")))
        open_ = after.filter("not certain").select(*kept, "need")
        if open_.isEmpty():
            break
    closed = done[0]
    for more in done[1:]:
        closed = closed.unionByName(more)
    return cut_lineage(state.join(closed, "rep"))


def _walk_negatives(lists: _Lists, found: DataFrame, k: int, low: int) -> DataFrame:
    """``(rep, level, vec_id, score, place)`` for every score ``level`` of a positive; the walk goes as far as the first one did, and on from there."""
    kept = ["label", "vec", "norm", "width", "rep", "cluster"]
    levels = F.sort_array(F.collect_set(F.when(F.col("score") >= 0, F.col("score"))), False)
    asked = found.groupBy(*kept, "closed").agg(levels.alias("levels")).filter(F.size("levels") > 0)
    open_ = asked.select(*kept, "levels", F.lit(0).alias("first"), F.col("closed").alias("last"))
    state = None
    for _ in range(len(BANDS) + 1):
        now = cut_lineage(open_)
        state = _grown(state, lists.meet(now, _negatives(k, low), "rep long, level long, vec_id long, score long"), ["rep", "level"], k)
        kth = state.groupBy("rep", F.col("level").alias("lowest")).agg(F.count("*").alias("n"), F.min("score").alias("least"))
        after = lists.below(now.withColumn("lowest", F.element_at("levels", -1))).join(kth, ["rep", "lowest"], "left")
        enough = F.coalesce((F.col("n") == k) & (F.col("least") > F.col("limit")), F.lit(False))
        beyond = F.ceil(F.col("lowest") * low / 100) > F.col("limit")
        open_ = after.filter(~(enough | beyond) & (F.col("last") < len(BANDS)))
        open_ = open_.select(*kept, "levels", (F.col("last") + 1).alias("first"), (F.col("last") + 1).alias("last"))
        if open_.isEmpty():
            break
    return state


def query(spark, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, label)


def oracle() -> str:
    """All pairs of anchors and rows in SQL."""
    return """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
           FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pair AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
         FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positive AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pair WHERE same
             QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER r AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN pair USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW r AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER r <= 5"""
