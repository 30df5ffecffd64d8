"""Substring dedup: windows of 50 words counted in super-k-mer buckets.

The minimiser of a window is the smallest fingerprint of its ``GRAM``-word runs. Consecutive windows
of a document that share one form a super-k-mer and travel as one packed string, with all strings
for a bucket compressed together; equal windows have equal minimisers, so they meet in one bucket.
There the windows are cut again, sorted by two 64-bit fingerprints of their words, and each is
compared with the smallest document that holds it. The ranges to remove go back to their documents.

Equal strings are settled first, in the task that sends them and in the bucket again: what a smaller document
holds whole is removed whole, and only the strings of the smallest one are sent and cut.

Buckets are as many as the bytes of all texts ask for. A minimiser with more than ``HOT`` bytes, counted over all texts, would
fill one. Its strings are dealt by their own fingerprint, and the windows of the smallest document's travel on,
singly, to be counted by their fingerprints. That changes who counts them, not the counts; all strings of such a minimiser go that way.

Null texts have no words. Rows without an id are returned whole and count for nobody. Repeated ids
are one document: none is smaller than the other. Texts of any length are read whole: a long one is a slice of its own. An empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.sent import Sent, groups, layout
from kerbline.llm.text import SLICE_BYTES, Prefix, Texts, grams, mix, powers, slices, within, words
from kerbline.session import cut_lineage

WINDOW = 50
GRAM = 6
#: Bytes of texts for each bucket, bytes of a minimiser's strings before they are split, and how many may be split.
BUCKET, HOT, MOST_HOT = 2 << 20, 8 << 20, 1 << 20
#: Bytes of strings that a task combines before it sends.
BUFFER = 16 << 20

_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in _BASES)


def prints(code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two fingerprints of every run of ``n`` words, across rows as well."""
    count = max(0, len(code) - n + 1)
    out = []
    for base, inverse in zip(_BASES, _INVERSES, strict=True):
        total = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(mix(code ^ np.uint64(base >> 3)) * powers(base, len(code)), out=total[1:])
        out.append(mix((total[n : n + count] - total[:count]) * powers(inverse, len(code) + 1)[:count]))
    return out[0], out[1]


def minimisers(code: np.ndarray) -> np.ndarray:
    """The smallest run fingerprint of every window."""
    least = grams(code, GRAM, 8)
    need, have = WINDOW - GRAM + 1, 1
    while 2 * have <= need:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if need > have:
        least = np.minimum(least[: len(least) - (need - have)], least[need - have :])
    return least


def _runs(w) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and minimiser of each super-k-mer of a slice."""
    if len(w.code) < WINDOW:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    least = minimisers(w.code)
    at = np.flatnonzero(within(w.row, WINDOW))
    value = least[at]
    opens = np.ones(len(at), bool)
    opens[1:] = (at[1:] != at[:-1] + 1) | (value[1:] != value[:-1]) | (w.row[at[1:]] != w.row[at[:-1]])
    head = np.flatnonzero(opens)
    return at[head], np.diff(np.append(head, len(at))), value[head]


def _loads(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    w = words(texts)
    first, count, value = _runs(w)
    return value, w.end[first + count + WINDOW - 2] - w.start[first] if len(first) else count


def _settled(ids: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by string and document, the smallest document of each string in that order, and how often the string comes."""
    order, head, copies = groups(ids, name)
    return order, ids[order[head]], copies


def _once(*keys: np.ndarray) -> np.ndarray:
    """Indices of distinct rows."""
    order = np.lexsort(keys)
    fresh = np.ones(len(order), bool)
    if len(order):
        fresh[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return order[fresh]


class _Sender:
    """Super-k-mers of a task on their way to the buckets."""

    def __init__(self, buckets: int, often: np.ndarray):
        self.buckets, self.often = buckets, often
        self.sent = Sent(4)  # the smallest document so far, its mark, and first word and end there
        self.held: list[tuple[list[np.ndarray], bytes]] = []
        self.bytes = 0

    def add(self, texts: Texts, ids: np.ndarray, marks: np.ndarray) -> None:
        w = words(texts)
        first, count, value = _runs(w)
        if len(first):
            row = w.row[first]
            lo, hi = w.start[first], w.end[first + count + WINDOW - 2]
            name = Prefix(texts.data).of(lo, hi)
            self.held.append(([ids[row], marks[row], first - w.first[row], count, name, value, lo, hi], texts.data.tobytes()))
            self.bytes += int((hi - lo).sum())

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        columns = [np.concatenate(c) for c in zip(*(h[0] for h in self.held), strict=True)]
        source = np.repeat(np.arange(len(self.held)), [len(h[0][0]) for h in self.held])
        rows = _once(columns[2], columns[1], columns[0], columns[4])  # a document's own repeats stay, repeated rows do not
        columns, source = [c[rows] for c in columns], source[rows]
        ids, marks, place, count, name, value, lo, hi = columns
        stop = place + count + WINDOW - 1
        order, least, copies = _settled(ids, name)
        one = order[np.cumsum(copies) - copies]
        known = self.sent.find(name[one])
        before = np.where(known >= 0, self.sent.columns[0][known] if len(self.sent.names) else 0, least)
        smallest = np.minimum(before, least)
        # The one that was sent before is later now.
        beaten = known[(known >= 0) & (least < before)]
        gone = order[ids[order] > np.repeat(smallest, copies)]
        ranges = [np.concatenate([x[gone], self.sent.columns[k][beaten]]) for k, x in enumerate((ids, marks, place, stop))]
        fresh, now = known < 0, (known >= 0) & (least < before)
        for k, x in enumerate((ids, marks, place, stop)):
            self.sent.columns[k][known[now]] = x[one[now]]
        self.sent.add(name[one[fresh]], *(x[one[fresh]] for x in (ids, marks, place, stop)))
        new = order[(ids[order] == np.repeat(smallest, copies))]
        hot = np.isin(value[new], self.often)
        bucket = (np.where(hot, name[new], value[new]) % np.uint64(self.buckets)).astype(np.int64)
        at = np.argsort(bucket, kind="stable")
        press = zstandard.ZstdCompressor(level=1)
        for part in np.split(at, np.flatnonzero(np.diff(bucket[at])) + 1) if len(at) else []:
            own = new[part]
            text = [self.held[h][1][a:b] for h, a, b in zip(source[own].tolist(), lo[own].tolist(), hi[own].tolist(), strict=True)]
            sent = (ids[own], marks[own], place[own], count[own], name[own], hot[part], hi[own] - lo[own])
            yield _row(press, int(bucket[part[0]]), (sent, b"".join(text)))
        if len(ranges[0]):
            yield _row(press, int(ranges[1][0]) % self.buckets, (ranges, None))
        self.held, self.bytes = [], 0


def _row(press, bucket: int, part) -> pa.RecordBatch:
    blob = press.compress(pickle.dumps(part, protocol=5))
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([blob], pa.binary())], ["bucket", "blob"])


def _packed(buckets: int, often: np.ndarray):
    """Compressed super-k-mers for each bucket, and ranges that are settled."""

    def run(batches):
        sender = _Sender(buckets, often)
        for batch in batches:
            ids, marks = (batch.column(c).to_numpy() for c in ("doc_id", "mark"))
            for texts in slices(batch):
                sender.add(texts, ids[texts.rows], marks[texts.rows])
                if sender.bytes > BUFFER:
                    yield from sender.flush()
        yield from sender.flush()

    return run


def _cut_again(texts: list[bytes], count: np.ndarray) -> tuple[np.ndarray, ...]:
    """The windows of packed strings: which string, which place in it, and two fingerprints."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    w = words(Texts(slice(0, 1), data, np.array([0, len(data)])))
    one, two = prints(w.code, WINDOW)
    size = count + WINDOW - 1
    begin = np.cumsum(size) - size
    which = np.repeat(np.arange(len(count)), count)
    step = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    at = begin[which] + step
    return which, step, one[at], two[at]


def _judged(parts: list, buckets: int):
    """Ranges settled in a bucket, and single windows of frequent minimisers for theirs."""
    for part, text in parts:
        if text is None:
            yield _ranges(*part)
    parts = [p for p in parts if p[1] is not None]
    if not parts:
        return
    ids, marks, place, count, name, hot, length = (np.concatenate(c) for c in zip(*(p[0] for p in parts), strict=True))
    text = b"".join(p[1] for p in parts)
    end = np.cumsum(length)
    order, least, copies = _settled(ids, name)
    later = order[ids[order] > np.repeat(least, copies)]
    yield _ranges(ids[later], marks[later], place[later], place[later] + count[later] + WINDOW - 1)
    on = order[ids[order] == np.repeat(least, copies)]
    on = on[_once(place[on], marks[on], ids[on], name[on])]
    ids, marks, place, hot, count, end, length = (c[on] for c in (ids, marks, place, hot, count, end, length))
    # A megabyte of strings is cut at a time; only the columns of the windows stay.
    cuts = np.flatnonzero(np.diff(np.cumsum(length) // SLICE_BYTES, prepend=0)).tolist()
    columns, cold = [[], [], [], [], []], []
    for a, b in zip([0, *cuts], [*cuts, len(on)], strict=True):
        if a < b:
            strings = [text[e - n : e] for e, n in zip(end[a:b].tolist(), length[a:b].tolist(), strict=True)]
            which, step, one, two = _cut_again(strings, count[a:b])
            for column, more in zip(columns, (ids[a:b][which], marks[a:b][which], place[a:b][which] + step, one, two), strict=True):
                column.append(more)
            cold.append(~hot[a:b][which])
    columns, cold = [np.concatenate(c) for c in columns], np.concatenate(cold)
    if cold.any():
        yield _later([c[cold] for c in columns])
    if not cold.all():
        single = [c[~cold] for c in columns]
        to = (single[3] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        press = zstandard.ZstdCompressor(level=1)
        for part in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
            blob = press.compress(pickle.dumps([c[part] for c in single], protocol=5))
            none = pa.nulls(1).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([none] * 4 + [pa.array([int(to[part[0]])], pa.int32()), pa.array([blob], pa.binary())], NAMES)


NAMES = ["doc_id", "mark", "lo", "hi", "bucket", "blob"]
ROWS = "doc_id long, mark long, lo long, hi long, bucket int, blob binary"


def _ranges(ids: np.ndarray, marks: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(ids))
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, marks, lo, hi)] + [none.cast(pa.int32()), none.cast(pa.binary())], NAMES)


def _later(columns: list[np.ndarray]) -> pa.RecordBatch:
    """Ranges of words covered by windows that a smaller document holds."""
    ids, marks, place, one, two = columns
    order = np.lexsort((two, one))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    head = np.flatnonzero(fresh)
    least = np.minimum.reduceat(ids[order], head)
    later = np.zeros(len(ids), bool)
    later[order] = ids[order] > np.repeat(least, np.diff(np.append(head, len(ids))))
    ids, marks, place = ids[later], marks[later], place[later]
    order = np.lexsort((place, marks, ids))
    ids, marks, place = ids[order], marks[order], place[order]
    opens = np.ones(len(ids), bool)
    opens[1:] = (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1]) | (place[1:] > place[:-1] + 1)
    head = np.flatnonzero(opens)
    last = np.append(head[1:], len(ids)) - 1 if len(head) else head
    return _ranges(ids[head], marks[head], place[head], place[last] + WINDOW)


def _by_bucket(batches):
    """One list per bucket; a partition holds whole buckets, sorted."""
    open_ = zstandard.ZstdDecompressor()
    bucket, parts = None, []
    for batch in batches:
        for key, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob"), strict=True):
            if key != bucket and parts:
                yield parts
                parts = []
            bucket = key
            parts.append(pickle.loads(open_.decompress(blob.as_buffer())))
    if parts:
        yield parts


def _counted(buckets: int):
    def run(batches):
        for lists in _by_bucket(batches):
            yield from _judged(lists, buckets)

    return run


def _singles(batches):
    for lists in _by_bucket(batches):
        yield _later([np.concatenate(c) for c in zip(*lists, strict=True)]).select(NAMES[:4])


def _removed(batches):
    for batch in batches:
        marks = batch.column("ranges").to_pylist()
        columns: list[list] = [[], [], []]
        for texts in slices(batch):
            w = words(texts)
            buffer = texts.data.tobytes()
            for i in range(len(texts.offsets) - 1):
                a, b = int(w.first[i]), int(w.first[i + 1])
                gone = np.zeros(b - a + 1, np.int64)
                for r in marks[texts.rows.start + i] or []:
                    gone[r["lo"]] += 1
                    gone[r["hi"]] -= 1
                kept = a + np.flatnonzero(np.cumsum(gone[:-1]) == 0)
                pieces = [buffer[s:e] for s, e in zip(w.start[kept].tolist(), w.end[kept].tolist(), strict=True)]
                columns[0].append(b - a)
                columns[1].append(b - a - len(kept))
                columns[2].append(hashlib.sha256(b" ".join(pieces)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_sha256"],
        )


def repeated_ranges(documents: DataFrame, least: int) -> DataFrame:
    """``(doc_id, mark, lo, hi)``: word ranges held by a smaller document; ``mark`` tells texts of one id apart. ``least`` buckets or more."""
    docs = documents.filter("doc_id is not null and text is not null").select("doc_id", "text", F.xxhash64("text").alias("mark"))
    buckets, partitions, often = layout(docs, _loads, least, BUCKET, HOT, MOST_HOT)
    packed = docs.mapInArrow(_packed(buckets, often), "bucket int, blob binary")
    dealt = packed.repartition(partitions, "bucket").sortWithinPartitions("bucket")
    judged = cut_lineage(dealt.mapInArrow(_counted(buckets), ROWS))
    single = judged.filter("blob is not null").select("bucket", "blob").repartition(partitions, "bucket").sortWithinPartitions("bucket")
    more = single.mapInArrow(_singles, "doc_id long, mark long, lo long, hi long")
    return judged.filter("blob is null").select(NAMES[:4]).unionByName(more)


def without_repeats(documents: DataFrame) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` of every row."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Repeated rows have the same ranges: those come once.
    ranges = cut_lineage(repeated_ranges(docs, buckets).distinct())
    grouped = ranges.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    marked = docs.withColumn("mark", F.xxhash64("text"))
    joined = marked.join(grouped, ["doc_id", "mark"], "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(_removed, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> str:
    """All windows by their text; ids are unique there."""
    return f"""
    with texts as (select doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) as w from documents),
    starts as (select doc_id, unnest(range(0, len(w) - {WINDOW - 1})) as i, w from texts where len(w) >= {WINDOW}),
    windows as (select doc_id, i, md5(array_to_string(w[i + 1 : i + {WINDOW}], ' ')) as name from starts),
    later as (select doc_id, i from (select *, min(doc_id) over (partition by name) as least from windows) where doc_id > least),
    words as (select doc_id, unnest(range(0, len(w))) as place, unnest(w) as word from texts),
    marked as (
      select w.doc_id, w.place, w.word, max(l.i) over (partition by w.doc_id order by w.place) as begun
      from words w left join later l on l.doc_id = w.doc_id and l.i = w.place),
    kept as (
      select doc_id, count(*) as n, string_agg(word, ' ' order by place) as text from marked where begun is null or place >= begun + {WINDOW} group by doc_id)
    select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
    from texts left join kept using (doc_id)"""
