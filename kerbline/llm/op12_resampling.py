"""Importance resampling towards a target: hashed word runs, array-scored weights, exact ranks.

Features are the runs of 1 to ``orders`` consecutive words (lower-cased ASCII letters, digits and all other
characters beyond ASCII), hashed to ``BUCKETS`` buckets by CRC-32. One pass counts the buckets of the corpus and
the target; the log ratios are an array of ``BUCKETS`` whole numbers, and a second pass scores every text as the
floored mean of the array over its features. A Gumbel key of the id makes the highest scores
a draw without replacement. Ranks come from parallel sorting by regular sampling (``regular``): only segments
that begin before the last drawn rank are exchanged and put in order.

Null texts have no words and weight 0; such rows and those with fewer than ``least_words`` words have a score
but no rank. A row without an id is keyed by the empty text and ranks after ids of its score. Repeated rows are rows of their own,
each with a rank. Words and texts of any length are hashed whole. An empty corpus gives an empty result, an empty
target gains that only reflect the corpus. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kerbline.llm.regular import segments, sorted_runs
from kerbline.llm.text import NOT_ALNUM, Texts, slices, words

BUCKETS = 10_000
#: Bytes hashed side by side; a longer feature is hashed alone.
WIDE = 48
#: The largest id, for rows that have none.
LAST = (1 << 63) - 1

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ np.where(table & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return table


_CRC = _crc_table()


def crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of many byte ranges, a byte of each at a time, the longest first."""
    size = end - start
    order = np.argsort(-np.minimum(size, WIDE + 1).astype(np.int16), kind="stable")
    at, size = start[order], size[order]
    crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
    wide = int(np.searchsorted(-size, -WIDE, "left"))
    for j in range(int(min(WIDE, size[wide])) if wide < len(size) else 0):
        to = int(np.searchsorted(-size, -j, "left"))
        some = crc[wide:to]
        crc[wide:to] = _CRC[(some ^ data[at[wide:to] + j]) & np.uint32(255)] ^ (some >> np.uint32(8))
    crc = ~crc
    view = memoryview(np.ascontiguousarray(data))
    for i in range(wide):
        crc[i] = zlib.crc32(view[at[i] : at[i] + size[i]])
    out = np.empty(len(at), np.uint32)
    out[order] = crc
    return out


def features(texts: Texts, orders: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of a slice's features, the row of each, and the number of words of each row."""
    w = words(texts, breaks=NOT_ALNUM)
    rows = len(texts.offsets) - 1
    data, start, end = _FOLD[texts.data], w.start, w.end
    if orders > 1:  # join the words by one space
        size = end - start
        place = np.cumsum(size + 1) - size - 1
        joined = np.full(int((size + 1).sum()), 32, np.uint8)
        from_ = np.repeat(start - place, size) + (np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size))
        joined[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = data[from_]
        data, start, end = joined, place, place + size
    found, of = [], []
    for n in range(1, orders + 1):
        first = np.flatnonzero(w.row[: len(w.row) - n + 1] == w.row[n - 1 :]) if len(w.row) >= n else np.zeros(0, np.int64)
        found.append(crc32(data, start[first], end[first + n - 1]) % np.uint32(BUCKETS))
        of.append(w.row[first])
    return np.concatenate(found).astype(np.int64), np.concatenate(of), np.bincount(w.row, minlength=rows)


def _counted(orders: int):
    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for texts in slices(batch):
                total += np.bincount(features(texts, orders)[0], minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    return run


def gains(corpus: DataFrame, target: DataFrame, orders: int = 1) -> np.ndarray:
    """The scoring array: floored thousandths of the smoothed log ratio of each bucket."""
    counted = [t.select("text").mapInArrow(_counted(orders), "bucket int, n long").withColumn("side", F.lit(i)) for i, t in enumerate((corpus, target))]
    rows = counted[0].unionByName(counted[1]).groupBy("bucket", "side").agg(F.sum("n").alias("n")).collect()  # 2 * BUCKETS at most
    seen = np.zeros((2, BUCKETS), np.int64)
    for r in rows:
        seen[r["side"], r["bucket"]] = r["n"]
    (s, t), (all_s, all_t) = seen.tolist(), (float(x + BUCKETS) for x in seen.sum(1).tolist())
    return np.array([math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in range(BUCKETS)], np.int64)


def gumbel(seed: int, doc_id: int | None) -> int:
    """Thousandths of a Gumbel draw that belongs to the id."""
    text = f"{seed}:{'' if doc_id is None else doc_id}".encode()
    h = int.from_bytes(hashlib.sha256(text).digest()[:4], "big")
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scored(gain: np.ndarray, seed: int, orders: int):
    def run(batches):
        for batch in batches:
            columns: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
            for texts in slices(batch):
                bucket, row, n_words = features(texts, orders)
                n = np.bincount(row, minlength=len(n_words))
                # Whole numbers below 2**53: the float sums are exact.
                total = np.bincount(row, gain[bucket].astype(np.float64), len(n_words)).astype(np.int64)
                for column, more in zip(columns, (n_words, n, total // np.maximum(n, 1)), strict=True):
                    column.append(more.astype(np.int64))
            n_words, n, weight = (np.concatenate(c) for c in columns)
            keys = np.array([gumbel(seed, i) for i in batch.column("doc_id").to_pylist()], np.int64)
            arrays = [batch.column("doc_id"), *(pa.array(a) for a in (n_words, n, weight, weight + keys))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_features", "weight", "score"])

    return run


def resample(documents: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, seed: int = 2024, orders: int = 1) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` of every row; ``rank`` is null where a row is not drawn."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gain = gains(docs, target.select(F.col("text").cast("string").alias("text")), orders)
    scored = docs.mapInArrow(_scored(gain, seed, orders), "doc_id long, n_words long, n_features long, weight long, score long")
    # Rows that cannot be drawn come last, then by score, id and what else tells rows of one id apart.
    keys = ["out", "falling", "id", "n_features", "weight"]
    placed = scored.withColumns(
        {
            "out": (F.col("n_words") < least_words).cast("long"),
            "falling": -F.col("score"),
            "id": F.coalesce("doc_id", F.lit(LAST)),
        }
    )
    runs = sorted_runs(placed, keys)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    eligible, n = segments(runs.filter("out = 0"), keys, least)
    drawn = percent * n // 100
    shown = ["doc_id", "n_features", "weight", "score"]
    counts = sorted((r["segment"], r["count"]) for r in eligible.groupBy("segment").count().collect())  # a row per segment
    before = np.concatenate([[0], np.cumsum([c for _, c in counts])]).astype(np.int64)
    starts = [(s, int(b)) for (s, _), b in zip(counts, before, strict=False) if b < drawn]
    none = F.lit(None).cast("long").alias("rank")
    rest = runs.filter("out <> 0").select(*shown, none)
    if not starts:
        return rest.unionByName(eligible.select(*shown, none))
    last = starts[-1][0]
    table = F.broadcast(spark.createDataFrame(starts, "segment int, before long"))  # a row per segment
    inside = F.row_number().over(W.partitionBy("segment").orderBy(*keys, "tie"))
    ranked = eligible.filter(F.col("segment") <= last).withColumn("place", inside).join(table, "segment")
    rank = F.col("before") + F.col("place")
    ranked = ranked.select(*shown, F.when(rank <= drawn, rank).alias("rank"))
    return ranked.unionByName(eligible.filter(F.col("segment") > last).select(*shown, none)).unionByName(rest)


def query(spark, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def oracle() -> str:
    """The same rows in SQL; CRC-32 from a table of 256 entries made by the bitwise rule."""
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    split = f"regexp_extract_all({low}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    byte = "list_transform(range(octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), CAST(2 * i + 1 AS INT), 2))::BIGINT)"
    return f"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
               lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) AS k),
doc AS (SELECT doc_id, {split} AS ws FROM documents),
dw AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS w FROM doc) GROUP BY 1, 2),
tw AS (SELECT w, count(*) AS n FROM (SELECT unnest({split}) AS w FROM benchmark) GROUP BY 1),
vocabulary AS (SELECT w, xor(list_reduce(list_concat([4294967295::BIGINT], {byte}),
                 lambda c, b: xor(k[CAST((xor(c, b) & 255) + 1 AS INT)], c >> 8)), 4294967295) % {BUCKETS} AS bucket
               FROM (SELECT w FROM dw UNION SELECT w FROM tw), crc),
s AS (SELECT bucket, sum(n) AS n FROM dw JOIN vocabulary USING (w) GROUP BY 1),
t AS (SELECT bucket, sum(n) AS n FROM tw JOIN vocabulary USING (w) GROUP BY 1),
sums AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE + {BUCKETS} AS s, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE + {BUCKETS} AS t),
gain AS (SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * sums.s / ((s.n + 1)::DOUBLE * sums.t))) AS BIGINT) AS g
         FROM s LEFT JOIN t USING (bucket), sums),
total AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * g) AS BIGINT) AS g
          FROM dw JOIN vocabulary USING (w) JOIN gain USING (bucket) GROUP BY 1),
scored AS (SELECT doc_id, coalesce(n, 0) AS n_features,
             coalesce(CASE WHEN g >= 0 THEN g // n ELSE -((n - 1 - g) // n) END, 0) AS weight,
             ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h
           FROM doc LEFT JOIN total USING (doc_id)),
keyed AS (SELECT doc_id, n_features, weight,
            weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM scored),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM keyed WHERE n_features >= 20),
kept AS (SELECT doc_id, rank FROM ranked WHERE rank <= (SELECT 10 * count(*) // 100 FROM ranked))
SELECT doc_id, n_features, weight, score, rank FROM keyed LEFT JOIN kept USING (doc_id)"""
