"""Byte-level BPE by monoid tree reduction.

Encoding is a monoid over byte strings: the tokens of ``x + y`` follow from the tokens of ``x`` and of
``y``. A match of the splitting pattern is encoded by halves, recursively; leaves of up to ``LEAF``
bytes merge pairs by rank. Joining neighbours re-encodes a window at the boundary, one token from
either side at first, and lets it grow until the tokens outside provably stay: a token sequence is
the encoding of its bytes if and only if each two neighbours are the encoding of theirs, so it
suffices that the pairs at both rims of the window are. Matches are separate, and their tokens are
concatenated up the tree; so are bytes in decoding.

Ranks are read once by the driver and shared (one vocabulary, fixed size). Tasks remember the tokens
of recent matches, ``REMEMBERED`` at most.

Null text counts as empty: no tokens, the digests of empty strings. Null ids keep their row, repeated
rows come repeated, an empty table gives an empty result, extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Sequence

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEAF = 8
#: Matches remembered by a worker before it starts anew.
REMEMBERED = 250_000
#: Longest match that is remembered, in bytes.
SHORT = 48


class Encoder:
    """Tokens of byte strings under a table of ranks (bytes to id; merges go by the id)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.stable: dict[tuple[int, int], bool] = {}
        self.leaves: dict[bytes, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Merge the neighbours of lowest rank, leftmost first, until none can merge."""
        if len(piece) > 64:
            return self._merge_long(piece)
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        parts = [piece[i : i + 1] for i in range(len(piece))]
        none = len(ranks) + 1
        costs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while costs:
            low = min(costs)
            if low == none:
                break
            i = costs.index(low)
            joined = parts[i] + parts[i + 1]
            parts[i : i + 2] = [joined]
            del costs[i]
            if i < len(costs):
                costs[i] = ranks.get(joined + parts[i + 1], none)
            if i:
                costs[i - 1] = ranks.get(parts[i - 1] + joined, none)
        return [ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap of neighbours, for windows that had to grow."""
        ranks, n = self.ranks, len(piece)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            # A place that was merged away has no end; one that grew makes another range.
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if before[i] >= 0 and (r := ranks.get(piece[before[i] : stop])) is not None:
                heapq.heappush(heap, (r, before[i], stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def leaf(self, piece: bytes) -> list[int]:
        """Tokens of a short string; recent ones are remembered."""
        found = self.leaves.get(piece)
        if found is None:
            found = self.merge(piece)
            if len(self.leaves) > REMEMBERED:
                self.leaves.clear()
            self.leaves[piece] = found
        return found

    def stays(self, a: int, b: int) -> bool:
        """Whether the two tokens are the encoding of their bytes."""
        found = self.stable.get((a, b))
        if found is None:
            found = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
            if len(self.stable) > REMEMBERED:
                self.stable.clear()
            self.stable[a, b] = found
        return found

    def join(self, left: Sequence[int], right: Sequence[int]) -> list[int]:
        """The tokens of the concatenation."""
        if not left or not right or self.stays(left[-1], right[0]):
            return [*left, *right]
        i, j = len(left) - 1, 1
        while True:
            window = self.decode(left[i:]) + self.decode(right[:j])
            inner = self.leaf(window) if len(window) <= 2 * LEAF else self.merge(window)
            fits_left = i == 0 or self.stays(left[i - 1], inner[0])
            fits_right = j == len(right) or self.stays(inner[-1], right[j])
            if fits_left and fits_right:
                return [*left[:i], *inner, *right[j:]]
            # The side that is not stable gives as many tokens again.
            if not fits_left:
                i = max(0, i - (len(left) - i))
            if not fits_right:
                j = min(len(right), 2 * j)

    def encode(self, piece: bytes) -> list[int]:
        """Tokens of one match, by halves."""
        if len(piece) <= LEAF:
            return self.leaf(piece) if piece else []
        half = len(piece) // 2
        return self.join(self.encode(piece[:half]), self.encode(piece[half:]))

    def decode(self, tokens: Sequence[int]) -> bytes:
        """Concatenation up the tree."""
        if len(tokens) <= 4096:
            return b"".join(map(self.bytes_of.__getitem__, tokens))
        half = len(tokens) // 2
        return self.decode(tokens[:half]) + self.decode(tokens[half:])


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Lines of base64 bytes and rank; a vocabulary file beside the tokenizer library."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


_own: list[tuple[Encoder, dict]] = []


def _encoder(shared) -> tuple[Encoder, dict]:
    """The worker's encoder for a shared vocabulary, with what it remembers."""
    if not _own or _own[0][0].ranks is not shared.value:
        _own[:] = [(Encoder(shared.value), {})]
    return _own[0]


def _of_text(text: str, pattern, encoder: Encoder, known: dict) -> list[tuple]:
    """``(tokens, their decimals)`` of each match."""
    out = []
    add = out.append
    for match in pattern.findall(text):
        found = known.get(match)
        if found is None:
            raw = match.encode()
            tokens = tuple(encoder.encode(raw))
            found = (tokens, " ".join(map(str, tokens)))
            if len(raw) <= SHORT:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[match] = found
        add(found)
    return out


def _run(shared, pattern_text: str, with_ids: bool):
    def run(batches):
        encoder, known = _encoder(shared)
        pattern = regex.compile(pattern_text)
        for batch in batches:
            texts = batch.column("text")
            for at in range(0, batch.num_rows, 64):
                n, ids, back, lists = [], [], [], []
                for text in texts.slice(at, 64).to_pylist():
                    found = _of_text(text or "", pattern, encoder, known)
                    tokens = [t for f in found for t in f[0]]
                    n.append(len(tokens))
                    ids.append(hashlib.sha256(" ".join([f[1] for f in found]).encode()).hexdigest())
                    back.append(hashlib.sha256(encoder.decode(tokens)).hexdigest())
                    if with_ids:
                        lists.append(tokens)
                columns = [batch.column("doc_id").slice(at, 64).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array(lists, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encoded(documents: DataFrame, ranks: dict[bytes, int], pattern: str, with_ids: bool = False) -> DataFrame:
    """Token counts and digests of ids and decoded bytes of every text; the ids on demand."""
    shared = documents.sparkSession.sparkContext.broadcast(ranks)
    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(_run(shared, pattern, with_ids), SCHEMA + ", ids array<int>" * with_ids)


def _public(spark: SparkSession) -> tuple[dict[bytes, int], str]:
    import public_tokenizers

    return read_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def query(spark, sf_dir: str) -> DataFrame:
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), *_public(spark))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests that prove the round trip."""
    return encoded(docs, *_public(spark), with_ids=True)
