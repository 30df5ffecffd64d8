"""Suffix-array dedup: bytes covered by a 400-byte string that starts anywhere else.

Strings of ``LENGTH`` bytes are dealt by their minimiser, the smallest fingerprint of their 16-byte
runs: consecutive ones with the same minimiser travel as one stretch of text, compressed together for
each bucket, and equal strings meet. A task sends the text of equal stretches once: the others only leave
their place, and as they are equal to it, all of them are covered. A stretch that is alone with its minimiser
repeats nothing, nor do strings of it that have too little in common with others around the minimiser (``likely``).
What is left goes through suffix arrays of bounded pieces, equal parts of stretches as one text with its multiplicity: the text is cut where a fingerprint of the last ``CONTEXT``
bytes says so, the chunks are ranked as byte strings, and linear grouping (``lyndon.suffix_array``) sorts the
suffixes that begin at cuts. Neighbours in that order with a long enough common prefix form
intervals; a string that begins ``a`` bytes before a cut repeats if the interval of
``LENGTH - a`` common bytes has the same ``a`` bytes before a cut more than once. Strings without a usable cut get an array with more cuts, in the end one
at each place.

Buckets are as many as the bytes of all texts ask for. A minimiser with more than ``HOT`` bytes, counted over all texts,
would fill one. Its stretches are dealt by their own fingerprint, where equal ones are joined, and the strings of those
that differ travel singly to be counted by theirs. That changes who counts, not the counts.

Null texts are empty. Every row is a document of its own, so repeated rows cover each other; a row
without an id counts like any other. Texts of any length are read whole: a long one is a slice of its own. An empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.lyndon import suffix_array
from kerbline.llm.sent import Sent, groups, layout
from kerbline.llm.text import Prefix, Texts, mix, slices
from kerbline.session import cut_lineage

LENGTH = 400
RUN = 16
CONTEXT = 8
#: A cut after one place in so many, on average.
CHUNK = 32
#: Bytes of stretches that share a suffix array, unless one minimiser has more.
PIECE = 1 << 20
#: Bytes of texts for each bucket, bytes of a minimiser's stretches before they are split, and how many may be split.
BUCKET, HOT, MOST_HOT = 4 << 20, 8 << 20, 1 << 20
#: Bytes of stretches that a task combines before it sends.
BUFFER = 16 << 20
#: Places of a minimiser in a string that are told apart together before an array is made.
STEP = 64
#: Bits of a position beside 40 bits of a fingerprint.
PLACE = 24


def stretches(texts: Texts):
    """First string, number of strings, minimiser and fingerprint of each stretch, and whether it has
    the minimiser in several places."""
    data, offsets = texts.data, texts.offsets
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(bool), none
    prefix = Prefix(data)
    least = prefix.runs(RUN)
    least >>= np.uint64(PLACE)
    least <<= np.uint64(PLACE)
    least |= np.arange(len(least), dtype=np.uint64) & np.uint64((1 << PLACE) - 1)
    need, have = LENGTH - RUN + 1, 1
    spare = np.empty_like(least)
    while 2 * have <= need:
        size = len(least) - have
        np.minimum(least[:size], least[have:], out=spare[:size])
        least, spare = spare[:size], least
        have *= 2
    least = np.minimum(least[: len(least) - (need - have)], least[need - have :])
    # Runs of strings of a row with one minimiser at one place.
    rows = np.flatnonzero(np.diff(offsets) >= LENGTH)
    begin, stop = offsets[rows], offsets[rows + 1] - LENGTH + 1
    if not len(rows):
        return none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(bool), none
    head = np.union1d(np.flatnonzero(least[1:] != least[:-1]) + 1, begin)
    of = np.searchsorted(begin, head, "right") - 1
    inside = (of >= 0) & (head < stop[of])
    head, of = head[inside], of[inside]
    count = np.minimum(np.append(head[1:], n), stop[of]) - head
    value = least[head] >> np.uint64(PLACE)
    # Those with equal minimisers one after the other are one stretch.
    opens = np.ones(len(head), bool)
    opens[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    open_ = np.flatnonzero(opens)
    several = np.diff(np.append(open_, len(head))) > 1
    first, count = head[open_], np.add.reduceat(count, open_)
    return first, count, value[open_], prefix.of(first, first + count + LENGTH - 1), several, rows[of[open_]]


def _loads(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    _, count, value, *_ = stretches(texts)
    return value, count + LENGTH - 1


def _parts(order: np.ndarray, key: np.ndarray):
    """Runs of an order with equal keys."""
    return [p for p in np.split(order, np.flatnonzero(np.diff(key[order])) + 1) if len(p)]


def _merged(marks: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of each mark, joined where they touch."""
    order = np.lexsort((hi, lo, marks))
    marks, lo, hi = marks[order], lo[order], hi[order]
    opens = np.ones(len(marks), bool)
    if len(marks):
        new = np.append(True, marks[1:] != marks[:-1])
        base = np.cumsum(new) * (int(hi.max()) + 1)  # the furthest end so far, within a mark
        far = np.maximum.accumulate(hi + base)
        opens[1:] = new[1:] | ((lo + base)[1:] > far[:-1])
        head = np.flatnonzero(opens)
        last = np.append(head[1:], len(marks)) - 1
        return marks[head], lo[head], (far - base)[last]
    return marks, lo, hi


class _Sender:
    """Stretches of a task on their way to the buckets."""

    def __init__(self, buckets: int, often: np.ndarray):
        self.buckets, self.often = buckets, often
        self.sent = Sent(4)  # mark, first byte, end, and whether the stretch is known to be covered
        self.held: list[tuple[list[np.ndarray], bytes]] = []
        self.bytes = 0

    def add(self, texts: Texts, marks: np.ndarray) -> None:
        first, count, value, name, several, row = stretches(texts)
        if len(first):
            place, size = first - texts.offsets[row], count + LENGTH - 1
            self.held.append(([marks[texts.rows][row], place, count, value, name, several, first, first + size], texts.data.tobytes()))
            self.bytes += int(size.sum())

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        columns = [np.concatenate(c) for c in zip(*(h[0] for h in self.held), strict=True)]
        marks, place, count, value, name, several, at, end = columns
        source = np.repeat(np.arange(len(self.held)), [len(h[0][0]) for h in self.held])
        stop = place + count + LENGTH - 1
        order, head, copies = groups(name)
        one = order[head]
        known = self.sent.find(name[one])
        # All copies are covered, and so is the one sent before if nothing has said so yet.
        again = np.repeat((copies > 1) | (known >= 0), copies)
        late = known[known >= 0]
        late = late[self.sent.columns[3][late] == 0]
        self.sent.columns[3][late] = 1
        covered_ = [np.concatenate([x[order[again]], self.sent.columns[k][late]]) for k, x in enumerate((marks, place, stop))]
        fresh = known < 0
        new = one[fresh]
        self.sent.add(name[new], marks[new], place[new], stop[new], (copies[fresh] > 1).astype(np.int64))
        hot = np.isin(value[new], self.often)
        bucket = (np.where(hot, name[new], mix(value[new])) % np.uint64(self.buckets)).astype(np.int64)
        press = zstandard.ZstdCompressor(level=1)
        for part in _parts(np.argsort(bucket, kind="stable"), bucket):
            rows = new[part]
            text = b"".join([self.held[h][1][a:b] for h, a, b in zip(source[rows].tolist(), at[rows].tolist(), end[rows].tolist(), strict=True)])
            sent = ((marks[rows], place[rows], count[rows], value[rows], name[rows], several[rows], hot[part]), text)
            yield _row(press, int(bucket[part[0]]), sent)
        if len(covered_[0]):
            ranges = _merged(*covered_)
            yield _row(press, int(ranges[0][0]) % self.buckets, (ranges, None))
        self.held, self.bytes = [], 0


def _row(press, bucket: int, part) -> pa.RecordBatch:
    blob = press.compress(pickle.dumps([part], protocol=5))
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([blob], pa.binary())], ["bucket", "blob"])


def _packed(buckets: int, often: np.ndarray):
    """Compressed stretches for each bucket, and ranges that are settled."""

    def run(batches):
        sender = _Sender(buckets, often)
        for batch in batches:
            marks = batch.column("mark").to_numpy()
            for texts in slices(batch):
                sender.add(texts, marks)
                if sender.bytes > BUFFER:
                    yield from sender.flush()
        yield from sender.flush()

    return run


def _common_bytes(prefix: Prefix, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the bytes at ``a`` and ``b``, at most ``most``."""
    low, high = np.zeros(len(a), np.int64), most.copy()
    while (low < high).any():
        middle = (low + high + 1) // 2
        same = prefix.of(a, a + middle) == prefix.of(b, b + middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def _repeated(key: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Which keys occur more than once, counting each entry ``times``."""
    out = np.zeros(len(key), bool)
    if len(key):
        order = np.argsort(key)
        fresh = np.ones(len(key), bool)
        fresh[1:] = np.diff(key[order]) != 0
        head = np.flatnonzero(fresh)
        out[order] = np.repeat(np.add.reduceat(times[order], head) > 1, np.diff(np.append(head, len(key))))
    return out


def likely(prefix: Prefix, begin: np.ndarray, value: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretch, first byte and end of the parts of stretches that can hold repeated strings.

    Equal strings have their minimiser at the same place: strings that begin up to ``STEP`` bytes apart before it have
    ``LENGTH - STEP + 1`` bytes in common, which then occur elsewhere at the same distance from the minimiser."""
    owner = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    prints = prefix.runs(RUN) >> np.uint64(PLACE)
    at = np.flatnonzero(prints == value[owner[: len(prints)]])
    at = at[at + RUN <= begin[owner[at] + 1]]
    own = owner[at]
    # Strings whose first place of the minimiser this is.
    after = np.append(-1, at[:-1]) + 1
    lo = np.maximum(np.maximum(after, begin[own]), at - (LENGTH - RUN))
    hi = np.minimum(at, begin[own + 1] - LENGTH)
    found = []
    for k in range(0, LENGTH - RUN + 1, STEP):
        a, b = np.maximum(lo, at - k - STEP + 1), np.minimum(hi, at - k)
        some = np.flatnonzero(a <= b)
        same = at[some] - k
        name = mix(prefix.of(same, same + LENGTH - STEP + 1) + mix(value[own[some]] + np.uint64(k)))
        found.append((own[some], a[some], b[some] + 1, name))
    own, lo, hi, name = (np.concatenate(c) for c in zip(*found, strict=True))
    again = _repeated(name, copies[own])
    own, lo, hi = _merged(own[again], lo[again], hi[again])
    return own, lo, hi + LENGTH - 1


def _sorted_symbols(texts: list, ends: list[bool]) -> np.ndarray:
    """Suffix order of a row of symbols cut in stretches: the places of the symbols, by their suffixes.

    Rank 1 ends a stretch, rank 0 all."""
    rank = {c: r for r, c in enumerate(sorted(set(texts)), 2)}
    symbols, where = [], []
    for i, (c, end) in enumerate(zip(texts, ends, strict=True)):
        symbols.append(rank[c])
        where.append(i)
        if end:
            symbols.append(1)
            where.append(-1)
    return np.array([where[s] for s in suffix_array([*symbols, 0])[1:] if where[s] >= 0], np.int64)


def covered(data: np.ndarray, begin: np.ndarray, copies: np.ndarray | None = None, chunk: int = CHUNK) -> np.ndarray:
    """Which places of the concatenated stretches start a string that starts elsewhere too.

    ``begin`` has the start of each stretch and the end of the last, ``copies`` how often each one occurs."""
    n = len(data)
    prefix = Prefix(data)
    buffer = data.tobytes()
    owner = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    times = (np.ones(len(begin) - 1, np.int64) if copies is None else copies)[owner]
    at = np.arange(n)
    deep = np.flatnonzero(at - begin[owner] >= CONTEXT)
    cut = deep[prefix.of(deep - CONTEXT, deep) % np.uint64(chunk) == 0]
    mine = owner[cut]
    stop = begin[mine + 1]
    # Chunks reach to the next cut or the end of the stretch.
    last = np.ones(len(cut), bool)
    last[:-1] = mine[1:] != mine[:-1]
    until = np.where(last, stop, np.append(cut[1:], n))
    order = _sorted_symbols([buffer[a:b] for a, b in zip(cut.tolist(), until.tolist(), strict=True)], last.tolist())
    out = np.zeros(n, bool)
    alone = at + LENGTH <= begin[owner + 1]
    if len(order):
        place, room = cut[order], (stop - cut)[order]
        shared = np.zeros(len(order) + 1, np.int64)
        shared[1:-1] = _common_bytes(prefix, place[:-1], place[1:], np.minimum(room[:-1], room[1:]))
        near = np.maximum(shared[:-1], shared[1:])
        # A cut serves the strings that begin from CONTEXT before it back to CONTEXT before the one before.
        floor = np.where(np.append(True, mine[1:] != mine[:-1]), begin[mine], np.append(0, cut[:-1]) - CONTEXT + 1)[order]
        reach = np.minimum(place - floor, LENGTH - 1)
        for a in range(CONTEXT, int(reach.max(initial=0)) + 1):
            some = np.flatnonzero((reach >= a) & (room >= LENGTH - a))
            start = place[some] - a
            alone[start] = False
            shares = (near[some] >= LENGTH - a) | (times[start] > 1)
            some, start = some[shares], start[shares]
            if len(some):
                interval = np.cumsum(shared[:-1] < LENGTH - a)[some].astype(np.uint64)
                out[start[_repeated(mix(prefix.of(start, start + a) + mix(interval)), times[start])]] = True
    rest = np.flatnonzero(alone)
    if len(rest):
        out[rest[_uncut(data, rest, times[rest], max(1, chunk // 8))]] = True
    return out


def _uncut(data: np.ndarray, starts: np.ndarray, times: np.ndarray, chunk: int) -> np.ndarray:
    """The same for strings that no cut serves, with more cuts in the bytes that they cover; with one at each place all are served."""
    opens = np.ones(len(starts), bool)
    opens[1:] = starts[1:] != starts[:-1] + 1
    head = np.flatnonzero(opens)
    lo, hi = starts[head], starts[np.append(head[1:], len(starts)) - 1] + LENGTH
    runs: dict[bytes, list[int]] = {}
    for i, (a, b) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True)):
        runs.setdefault(data[a:b].tobytes(), []).append(i)
    copies = np.array([times[head[same]].sum() for same in runs.values()])
    begin = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
    found = covered(np.frombuffer(b"".join(runs), np.uint8), begin, copies, chunk)
    out = np.zeros(len(starts), bool)
    for k, same in enumerate(runs.values()):
        own = found[begin[k] : begin[k + 1] - LENGTH + 1]
        for i in same:
            out[head[i] : head[i] + len(own)] = own
    return out


ROWS = "mark long, lo long, hi long, bucket int, blob binary"


def _ranges(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges that strings at sorted ``starts`` cover, joined where they touch."""
    opens = np.ones(len(starts), bool)
    opens[1:] = starts[1:] > starts[:-1] + LENGTH
    head = np.flatnonzero(opens)
    return starts[head], starts[np.append(head[1:], len(starts)) - 1] + LENGTH


class _Bucket:
    """One bucket's stretches, judged."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.loose: dict[int, list] = defaultdict(list)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # text, and the row and place of each copy

    def add(self, marks: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        self.found.append((marks, lo, hi))

    def judge(self, parts: list) -> None:
        for part, text in parts:
            if text is None:  # settled before
                self.add(*part)
        parts = [p for p in parts if p[1] is not None]
        if not parts:
            return
        columns = [np.concatenate(c) for c in zip(*(p[0] for p in parts), strict=True)]
        marks, place, count, value, name, several, hot = columns
        size = count + LENGTH - 1
        text, begin = b"".join(p[1] for p in parts), np.concatenate([[0], np.cumsum(size)])
        order = np.lexsort((name, value))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (value[order][1:] != value[order][:-1]) | (name[order][1:] != name[order][:-1])
        head = np.flatnonzero(fresh)
        copies = np.diff(np.append(head, len(order)))
        self.order, self.head = order, np.append(head, len(order))
        one = order[head]
        # Equal stretches of a frequent minimiser cover each other here; its strings are counted elsewhere.
        many = order[np.repeat((copies > 1) & hot[one], copies)]
        self.add(marks[many], place[many], place[many] + size[many])
        self._singly(one[hot[one]], columns, text, begin, copies[hot[one]])
        # One of each, by minimiser; alone ones that cannot repeat within themselves are done.
        of = value[one]
        new = np.ones(len(one), bool)
        new[1:] = of[1:] != of[:-1]
        kinds = np.diff(np.append(np.flatnonzero(new), len(one)))
        open_ = (np.repeat(kinds, kinds) > 1) | several[one] | (copies > 1)
        piece, total = [], 0
        pick = np.flatnonzero(open_ & ~hot[one])
        for i, k in enumerate(pick):
            piece.append(k)
            total += int(size[one[k]])
            ends = i + 1 == len(pick) or of[pick[i + 1]] != of[k]
            if ends and (total >= PIECE or i + 1 == len(pick)):
                self._sifted(piece, one, copies, columns, text, begin)
                piece, total = [], 0
        self._sorted()

    def _cut(self, rows: np.ndarray, text: bytes, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join([text[begin[r] : begin[r + 1]] for r in rows.tolist()]), np.uint8)
        return data, np.concatenate([[0], np.cumsum(begin[rows + 1] - begin[rows])])

    def _sifted(self, piece: list[int], one: np.ndarray, copies: np.ndarray, columns: list, text: bytes, begin: np.ndarray) -> None:
        """Parts of the stretches of some minimisers that go to an array; equal ones are one text."""
        rows = one[piece]
        data, edge = self._cut(rows, text, begin)
        prefix = Prefix(data)
        value = columns[3][rows]
        own, lo, hi = likely(prefix, edge, value, copies[piece])
        order, head, size = groups(mix(prefix.of(lo, hi) + mix(value[own])))
        for first, n in zip(head.tolist(), size.tolist(), strict=True):
            same = order[first : first + n]
            members = [self.order[self.head[piece[o]] : self.head[piece[o] + 1]] for o in own[same].tolist()]
            shift = np.repeat((lo - edge[own])[same], [len(m) for m in members])
            at = np.concatenate(members)
            self.waiting.append((data[lo[same[0]] : hi[same[0]]], columns[0][at], columns[1][at] + shift))
        if sum(len(w[0]) for w in self.waiting) >= PIECE:
            self._sorted()

    def _sorted(self) -> None:
        if not self.waiting:
            return
        texts, marks, places = zip(*self.waiting, strict=True)
        self.waiting = []
        edge = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        repeats = covered(np.concatenate(texts), edge, np.array([len(m) for m in marks]))
        for k in np.flatnonzero(np.add.reduceat(repeats, edge[:-1])):
            lo, hi = _ranges(np.flatnonzero(repeats[edge[k] : edge[k + 1]]))
            at = places[k][:, None]
            self.add(np.repeat(marks[k], len(lo)), (at + lo).ravel(), (at + hi).ravel())

    def _singly(self, rows: np.ndarray, columns: list, text: bytes, begin: np.ndarray, copies: np.ndarray) -> None:
        """Strings of frequent minimisers, for the bucket of their fingerprint."""
        for r, n in zip(rows.tolist(), copies.tolist(), strict=True):
            data = np.frombuffer(text[begin[r] : begin[r + 1]], np.uint8)
            starts = np.arange(len(data) - LENGTH + 1)
            prints = Prefix(data).of(starts, starts + LENGTH)
            to = (prints % np.uint64(self.buckets)).astype(np.int64)
            for part in _parts(np.argsort(to, kind="stable"), to):
                where = columns[1][r] + starts[part]
                self.loose[int(to[part[0]])].append((columns[0][r], where.astype(np.int64), prints[part], n > 1))

    def rows(self):
        if self.found:
            marks, lo, hi = _merged(*(np.concatenate(c) for c in zip(*self.found, strict=True)))
            none = pa.nulls(len(marks))
            arrays = [pa.array(marks), pa.array(lo), pa.array(hi), none.cast(pa.int32()), none.cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["mark", "lo", "hi", "bucket", "blob"])
        press = zstandard.ZstdCompressor(level=1)
        for bucket, parts in self.loose.items():
            blob = press.compress(pickle.dumps(parts, protocol=5))
            none = pa.nulls(1).cast(pa.int64())
            arrays = [none, none, none, pa.array([bucket], pa.int32()), pa.array([blob], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["mark", "lo", "hi", "bucket", "blob"])


def _by_bucket(batches):
    """``(bucket, parts)``; a partition holds whole buckets, sorted."""
    open_ = zstandard.ZstdDecompressor()
    bucket, parts = None, []
    for batch in batches:
        for key, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob"), strict=True):
            if key != bucket and parts:
                yield parts
                parts = []
            bucket = key
            parts += pickle.loads(open_.decompress(blob.as_buffer()))
    if parts:
        yield parts


def _judged(buckets: int):
    def run(batches):
        for parts in _by_bucket(batches):
            bucket = _Bucket(buckets)
            bucket.judge(parts)
            yield from bucket.rows()

    return run


def _loose(batches):
    """Ranges of single strings that occur elsewhere; those of joined equal stretches only count."""
    for parts in _by_bucket(batches):
        size = [len(p[1]) for p in parts]
        marks = np.repeat(np.array([p[0] for p in parts], np.int64), size)
        joined = np.repeat(np.array([p[3] for p in parts], bool), size)
        starts, prints = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
        own = _repeated(prints, np.ones(len(prints), np.int64)) & ~joined
        marks, starts = marks[own], starts[own]
        order = np.lexsort((starts, marks))
        marks, starts = marks[order], starts[order]
        opens = np.ones(len(marks), bool)
        opens[1:] = (marks[1:] != marks[:-1]) | (starts[1:] > starts[:-1] + LENGTH)
        head = np.flatnonzero(opens)
        last = np.append(head[1:], len(marks)) - 1 if len(head) else head
        arrays = [pa.array(marks[head]), pa.array(starts[head]), pa.array(starts[last] + LENGTH)]
        yield pa.RecordBatch.from_arrays(arrays, ["mark", "lo", "hi"])


def repeated_ranges(documents: DataFrame, least: int) -> DataFrame:
    """``(mark, lo, hi)``: byte ranges of rows named by ``mark`` that repeated strings cover; ``least`` buckets or more."""
    buckets, partitions, often = layout(documents, _loads, least, BUCKET, HOT, MOST_HOT)
    packed = documents.mapInArrow(_packed(buckets, often), "bucket int, blob binary")
    dealt = packed.repartition(partitions, "bucket").sortWithinPartitions("bucket")
    judged = cut_lineage(dealt.mapInArrow(_judged(buckets), ROWS))
    single = judged.filter("blob is not null").select("bucket", "blob").repartition(partitions, "bucket").sortWithinPartitions("bucket")
    more = single.mapInArrow(_loose, "mark long, lo long, hi long")
    return judged.filter("blob is null").select("mark", "lo", "hi").unionByName(more)


def _kept(batches):
    for batch in batches:
        ranges = batch.column("ranges").to_pylist()
        columns: list[list] = [[], [], [], []]
        for texts in slices(batch):
            for i in range(len(texts.offsets) - 1):
                data = texts.data[texts.offsets[i] : texts.offsets[i + 1]]
                gone = np.zeros(len(data) + 2, np.int64)
                for r in ranges[texts.rows.start + i] or []:
                    gone[r["lo"] + 1] += 1
                    gone[r["hi"] + 1] -= 1
                out = np.cumsum(gone) > 0
                columns[0].append(len(data))
                columns[1].append(int(out.sum()))
                columns[2].append(int((out[1:] & ~out[:-1]).sum()))
                columns[3].append(hashlib.sha256(data[~out[1:-1]].tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def without_repeats(documents: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` of every row."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    marked = docs.withColumn("mark", F.xxhash64("doc_id", "text"))
    buckets = 2 * int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Repeated rows have one mark and the same ranges: those come once.
    ranges = cut_lineage(repeated_ranges(marked.select("text", "mark"), buckets).distinct())
    grouped = ranges.groupBy("mark").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    joined = marked.join(grouped, "mark", "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> str:
    """All strings by their bytes in hexadecimal; ids are unique there."""
    return f"""
    with texts as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
    sized as (select doc_id, h, length(h) // 2 as n from texts),
    starts as (select doc_id, h, unnest(range(0, n - {LENGTH - 1})) as i from sized where n >= {LENGTH}),
    strings as (select doc_id, i, md5(substr(h, 2 * i + 1, {2 * LENGTH})) as name from starts),
    again as (select doc_id, i from (select *, count(*) over (partition by name) as times from strings) where times > 1),
    opened as (select *, lag(i) over (partition by doc_id order by i) as prev from again),
    numbered as (select *, sum(case when prev is null or i > prev + {LENGTH} then 1 else 0 end) over (partition by doc_id order by i) as run from opened),
    spans as (select doc_id, run, min(i) as lo, max(i) + {LENGTH} as hi from numbered group by doc_id, run),
    gaps as (
      select doc_id, lo, substr(h, 2 * coalesce(lag(hi) over (partition by doc_id order by lo), 0) + 1, 2 * (lo - coalesce(lag(hi) over (partition by doc_id order by lo), 0))) as part
      from spans join sized using (doc_id)),
    joined as (select doc_id, string_agg(part, '' order by lo) as front from gaps group by doc_id),
    totals as (select doc_id, count(*) as n_spans, sum(hi - lo) as n_removed, max(hi) as last from spans group by doc_id)
    select doc_id, n::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
      sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(last, 0) + 1))) as kept_sha256
    from sized left join totals using (doc_id) left join joined using (doc_id)"""
