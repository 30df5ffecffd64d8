"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Items are cut in pieces of at most ``LONGEST`` words (lower-cased runs without white space). A
document holds a piece of ``n`` words when some window of ``n`` words is within ``n // 5`` word
edits of it. Windows and pieces are embedded by the CGK random walk: at each step it writes the
current word and moves on if a random bit of that step and word says so, which turns a small edit
distance into a small Hamming distance. ``WALKS`` walks with ``TRIES`` samples of ``SAMPLE``
positions each give signatures; windows that share one with a piece of their length are verified by
the exact edit distance. At the edit bound the signatures of one aligned window reach a recall of
0.97 (tests measure it), and its neighbours, a word or two away, are further tries.

Only windows that can pass are embedded: an edit breaks at most two of the ``n - 1`` word pairs, so a
window needs ``n - 1 - 2 * (n // 5)`` pairs that occur in pieces of its length. The pairs travel in a bitmap of
fixed size; a benchmark that fills it makes the test weaker, never wrong. Pairs that no piece has are left out before the
lengths are looked at. Equal windows are embedded
once, and signatures meet in a join.

Null or wordless texts and items match nothing, as do rows without an id. Repeated documents and
items are found each under its id (repeated rows once). Items without an id are ignored, and an
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.text import Texts, grams, mix, slices, within, words
from kerbline.session import cut_lineage

LONGEST = 128
WALKS = 6
TRIES = 8
SAMPLE = 2
#: Bits of the bitmap of word pairs, as a power of two: 1 MB whatever the benchmark holds.
BITMAP = 23


def edits(n):
    """Word edits that a piece of ``n`` words may differ by."""
    return n // 5


def _least_pairs(n):
    return n - 1 - 2 * edits(n)


def embed(codes: np.ndarray, walk: int, positions: np.ndarray) -> np.ndarray:
    """What CGK writes at some sorted positions for windows ``(k, n)`` of word codes."""
    k, n = codes.shape
    padded = np.concatenate([codes, np.zeros((k, 1), np.uint64)], axis=1).ravel()
    at = np.arange(k) * (n + 1)
    end = at + n
    out = np.zeros((k, len(positions)), np.uint64)
    wanted = {int(p): i for i, p in enumerate(positions)}
    for step in range(int(positions[-1]) + 1):
        now = padded[at]
        if step in wanted:
            out[:, wanted[step]] = now
        now += np.uint64((walk * 4096 + step) * 0x9E3779B97F4A7C15 % (1 << 64))
        at += (mix(now) >> np.uint64(63)).view(np.int64)
        np.minimum(at, end, out=at)
    return out


def signatures(codes: np.ndarray) -> np.ndarray:
    """``WALKS * TRIES`` signatures of each window ``(k, n)``."""
    n = codes.shape[1]
    out = []
    for walk in range(WALKS):
        rng = np.random.default_rng([n, walk])
        # A walk passes half a word a step: from 2n on it mostly writes padding.
        picks = np.sort(rng.integers(0, 2 * n, (TRIES, SAMPLE)), axis=1)
        positions = np.unique(picks)
        seen = embed(codes, walk, positions)
        for t, pick in enumerate(picks):
            sig = np.full(len(codes), n * 1009 + walk * TRIES + t, np.uint64)
            for p in np.searchsorted(positions, pick):
                sig = mix(sig + seen[:, p])
            out.append(sig)
    return np.stack(out, axis=1)


def edit_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact edit distances of rows of ``x`` and ``y``, both ``(k, n)``."""
    k, n = x.shape
    row = np.tile(np.arange(n + 1, dtype=np.int32), (k, 1))
    steps = np.arange(n + 1, dtype=np.int32)
    for i in range(n):
        change = row[:, :-1] + (x[:, i, None] != y)
        best = np.minimum(change, row[:, 1:] + 1)
        new = np.concatenate([np.full((k, 1), i + 1, np.int32), best], axis=1)
        # Insertions run along the row: a running minimum of value minus position.
        row = np.minimum.accumulate(new - steps, axis=1) + steps
    return row[:, -1]


def _pieces(batches):
    for batch in batches:
        items, lengths, codes = [], [], []
        ids = batch.column("item_id").to_pylist()
        for texts in slices(batch):
            w = words(texts, lower=True)
            for i in range(len(texts.offsets) - 1):
                mine = w.code[w.first[i] : w.first[i + 1]]
                if len(mine) and ids[texts.rows.start + i] is not None:
                    for part in np.array_split(mine, -(-len(mine) // LONGEST)):
                        items.append(ids[texts.rows.start + i])
                        lengths.append(len(part))
                        codes.append(part.view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(items, pa.int64()), pa.array(lengths, pa.int32()), pa.array(codes, pa.list_(pa.int64()))],
            ["item_id", "n", "words"],
        )


def _bits_of(pairs: np.ndarray, n: int) -> np.ndarray:
    """Bits that word pairs set for pieces of ``n`` words; 0 stands for any length."""
    return (mix(pairs + np.uint64(n)) >> np.uint64(64 - BITMAP)).astype(np.int64)


def _pairs(codes: np.ndarray) -> np.ndarray:
    """Fingerprints of the word pairs of a sequence; a lone word has its own."""
    return grams(codes, min(2, len(codes)), 11)


def _set(cells: np.ndarray, pairs: np.ndarray, n: int) -> np.ndarray:
    bits = _bits_of(pairs, n)
    return ((cells[bits >> 6] >> (bits & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


def _bits(batches):
    for batch in batches:
        found = [np.zeros(0, np.int64)]
        for x in batch.column("words").to_pylist():
            pairs = _pairs(np.array(x, np.int64).view(np.uint64))
            found += [_bits_of(pairs, 0), _bits_of(pairs, len(x))]
        bits = np.unique(np.concatenate(found))
        yield pa.RecordBatch.from_arrays([pa.array(bits >> 6), pa.array((np.uint64(1) << (bits & 63).astype(np.uint64)).view(np.int64))], ["cell", "mask"])


def _with_pairs(pairs: np.ndarray, n: int) -> np.ndarray:
    """Starts of the windows of ``n`` words that hold enough of the word pairs at some sorted places."""
    least = _least_pairs(n)
    first, last = pairs[: max(len(pairs) - least + 1, 0)], pairs[least - 1 :]
    lo, hi = np.maximum(last - (n - 2), 0), first + 1
    lo[1:] = np.maximum(lo[1:], hi[:-1])  # each start once
    some = lo < hi
    lo, size = lo[some], (hi - lo)[some]
    return np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())


def _windows(bitmap, lengths: list[int]):
    """Windows of documents that can be near a piece, with their words."""
    shortest = min(lengths)

    def run(batches):
        cells = bitmap.value
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for texts in slices(batch):
                yield from _of_slice(texts, ids[texts.rows], cells)

    def _of_slice(texts: Texts, ids: np.ndarray, cells: np.ndarray):
        w = words(texts, lower=True)
        m = len(w.code)
        if not m:
            return
        code, row = w.code, w.row
        known, double = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        if m > 1:
            double = _pairs(code)
            known = np.flatnonzero(_set(cells, double, 0) & within(row, 2))
        # Rows that have too few known pairs for any length are left out at once.
        in_row = np.bincount(row[known], minlength=len(w.first) - 1)
        hopeful = (in_row >= min(_least_pairs(n) for n in lengths)) & (np.diff(w.first) >= shortest)
        known = known[hopeful[row[known]]]
        double = double[known]
        for n in lengths:
            if m < n:
                continue
            if n > 1:
                start = _with_pairs(known[_set(cells, double, n)], n)
                start = start[start <= m - n]
            else:
                start = np.flatnonzero(_set(cells, grams(code, 1, 11), 1))
            start = start[row[start] == row[start + n - 1]]
            for part in np.array_split(start, max(1, len(start) * n // 200_000)):
                if not len(part):
                    continue
                inside = code[part[:, None] + np.arange(n)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[row[part]], pa.int64()),
                        pa.array(part - w.first[row[part]], pa.int64()),
                        pa.array(np.full(len(part), n, np.int32)),
                        pa.FixedSizeListArray.from_arrays(pa.array(inside.view(np.int64).ravel()), n).cast(pa.list_(pa.int64())),
                    ],
                    ["doc_id", "start", "n", "words"],
                )

    return run


def _signed(batches):
    """A row for each signature of each sequence of words."""
    for batch in batches:
        n, lists = batch.column("n").to_numpy(), batch.column("words")
        at, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
        for size in np.unique(n):
            rows = np.flatnonzero(n == size)
            for part in np.array_split(rows, max(1, len(rows) * int(size) // 200_000)):
                sigs = signatures(flat[at[part][:, None] + np.arange(size)])
                name = batch.column("name").take(pa.array(np.repeat(part, sigs.shape[1])))
                yield pa.RecordBatch.from_arrays([name, pa.array(sigs.view(np.int64).ravel())], ["name", "sig"])


def _verified(batches):
    for batch in batches:
        n = batch.column("n").to_numpy()
        left, right = batch.column("words"), batch.column("item_words")
        at, to = left.offsets.to_numpy(), right.offsets.to_numpy()
        x, y = left.values.to_numpy().view(np.uint64), right.values.to_numpy().view(np.uint64)
        far = np.full(batch.num_rows, 1 << 30, np.int64)
        for size in np.unique(n):
            rows = np.flatnonzero(n == size)
            for part in np.array_split(rows, max(1, len(rows) * int(size) // 500_000)):
                span = np.arange(size)
                far[part] = edit_distances(x[at[part][:, None] + span], y[to[part][:, None] + span])
        keep = pa.array(far <= edits(n))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("name", "item_name")), pa.array(far)],
            ["name", "item_name", "distance"],
        ).filter(keep)


MATCH = "doc_id long, item_id long, start_word long, n_words int, distance long"


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Windows near a piece of an item: ``(doc_id, item_id, start_word, n_words, distance)``."""
    spark = documents.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(_pieces, "item_id long, n int, words array<long>")
    pieces = cut_lineage(items.distinct())
    lengths = sorted(r[0] for r in pieces.select("n").distinct().collect())  # LONGEST rows at most
    if not lengths:
        return spark.createDataFrame([], MATCH)
    cells = pieces.mapInArrow(_bits, "cell long, mask long").groupBy("cell").agg(F.bit_or("mask").alias("mask")).toPandas()
    bitmap = np.zeros(1 << (BITMAP - 6), np.uint64)
    bitmap[cells["cell"].to_numpy()] = cells["mask"].to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(bitmap)

    docs = documents.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = docs.mapInArrow(_windows(shared, lengths), "doc_id long, start long, n int, words array<long>")
    # Equal windows have one name and are embedded once, however many documents share them.
    windows = cut_lineage(found.withColumn("name", F.xxhash64("words")))
    contents = windows.select("name", "n", "words").dropDuplicates(["name"])
    named = pieces.withColumn("item_name", F.xxhash64("words"))
    targets = named.select("item_name", "n", F.col("words").alias("item_words")).dropDuplicates(["item_name"])
    sig = "name long, sig long"
    signed = targets.select(F.col("item_name").alias("name"), "n", F.col("item_words").alias("words")).mapInArrow(_signed, sig)
    met = contents.mapInArrow(_signed, sig).join(signed.withColumnRenamed("name", "item_name"), "sig").select("name", "item_name").distinct()
    pairs = met.join(contents.select("name", "n", "words"), "name").join(targets.select("item_name", "item_words"), "item_name")
    near = pairs.mapInArrow(_verified, "name long, item_name long, distance long")
    near = near.join(named.select("item_name", "item_id"), "item_name")
    return windows.select("doc_id", F.col("start").alias("start_word"), F.col("n").alias("n_words"), "name").join(
        near.select("name", "item_id", "distance"), "name"
    ).select(*[c.split()[0] for c in MATCH.split(", ")]).distinct()


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The nearest window of each document and item it holds."""
    best = F.min(F.struct("distance", "start_word", "n_words")).alias("m")
    return leaks(documents, benchmark).groupBy("doc_id", "item_id").agg(best, F.count("*").alias("windows")).select("doc_id", "item_id", "m.*", "windows")


def query(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark; rows without an id stay."""
    found = leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(docs.columns)
