"""Near-duplicates: chosen-path set similarity join over minwise tokens.

A document's set is its distinct five-word shingles (ASCII letters lower-cased; fewer words: the
whole sequence). Equal sets are one class, found by a hash aggregation, and only classes are joined.

Each class has ``COORDS`` minwise tokens. A tree starts at its root; at a node, a hash of the
node's path selects one coordinate, and for a third of the nodes a second, and a class moves to
the child named by its token there. Two sets with similarity ``J`` meet in a child with ``4/3 * J``
children on average, so a pair at the threshold stays together in one of ``TREES``
trees after ``DEPTH`` levels with probability 0.9977 (averaged over the tokens, which the trees
share; 0.9995 if exactly three quarters of them agree), while unlike sets part.

At first each member of a node is paired with its likeliest partner by sketch (or with the pivots of
a node of more than ``PAIRED``), and these few pairs a member are confirmed on the full sets. Links
join classes to components. What is left of a node of up to ``SMALL`` classes, the members whose
sketches leave a link to another component possible, is then compared exhaustively on the full sets,
each text once. A larger node never meets in one task: it ends when all its members are one
component, and otherwise it branches further. At the threshold that keeps a pair's meetings only on average, and
each level loses pairs (``meeting``: 0.988 at level 6, 0.944 at 10, 0.852 at 16). So the classes of
nodes that went deeper pass through further groups of trees over fresh tokens, until their pairs meet with
a probability of ``TARGET`` at the depth that they reached.

Null or wordless texts have empty sets and link with nothing. Repeated ids count as one document
for components, each row with its own set size. Rows without an id have no component and are
kept. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.llm.text import Texts, grams, mix, slices, within, words
from kerbline.operators.graph import connected_components
from kerbline.session import cut_lineage

SHINGLE = 5
COORDS = 64
TREES = 10
DEPTH = 4
#: Probability that a pair at the threshold meets, for classes of nodes that go deeper.
TARGET = 0.9995
#: Classes of a node that are paired by sketch, and that are compared exhaustively.
PAIRED, SMALL = 256, 2048
#: Rounds of two levels before the members of a node that has not parted are compared block by block.
ROUNDS = 60
#: Members that stand for a larger node in one round.
PIVOTS = 6
#: Similarity in hundredths.
NEED = 75
#: Sketches agree in two bits a coordinate; pairs estimated five deviations below the need are no links.
LEAST_AGREE = 36


def _spread(group: int) -> np.ndarray:
    """Multipliers that make the minwise tokens of a group of trees."""
    return np.random.default_rng(5 + group).integers(1, 2**62, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def meeting(depth: int) -> float:
    """Probability that a pair at the threshold is together in a tree of a group after some levels."""
    total = 0.0
    for agreed in range(COORDS + 1):
        p, gone = agreed / COORDS, 0.0
        for _ in range(depth):
            lost = 1 - p + p * gone
            gone = 2 / 3 * lost + 1 / 3 * lost * lost
        total += math.comb(COORDS, agreed) * (NEED / 100) ** agreed * (1 - NEED / 100) ** (COORDS - agreed) * (1 - gone**TREES)
    return total


def groups(depth: int) -> int:
    """Groups of trees that classes need whose nodes went to a depth."""
    return 1 if depth <= DEPTH else math.ceil(math.log(1 - TARGET) / math.log(1 - meeting(depth)))


def shingles(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """``(row, code)`` of the distinct shingles of each row, in order."""
    w = words(texts, lower=True)
    code, row = grams(w.code, SHINGLE), w.row[: max(0, len(w.row) - SHINGLE + 1)]
    keep = within(w.row, SHINGLE)
    rows, codes = [row[keep]], [code[keep]]
    count = np.diff(w.first)
    for n in range(1, SHINGLE):
        few = np.flatnonzero(count == n)
        if len(few):
            rows.append(few)
            codes.append(grams(w.code, n, n)[w.first[few]])
    row, code = np.concatenate(rows), np.concatenate(codes)
    order = np.lexsort((code, row))
    row, code = row[order], code[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
    return row[fresh], code[fresh]


def _sketches(group: int):
    def run(batches):
        spread = _spread(group)
        for batch in batches:
            size = np.zeros(batch.num_rows, np.int64)
            names = np.zeros((batch.num_rows, 2), np.uint64)
            mins = np.zeros((batch.num_rows, COORDS), np.uint32)
            for texts in slices(batch):
                row, code = shingles(texts)
                if not len(row):
                    continue
                head = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                at = texts.rows.start + row[head]
                size[at] = np.diff(np.append(head, len(row)))
                names[at, 0] = np.add.reduceat(mix(code + np.uint64(1)), head)
                names[at, 1] = np.add.reduceat(mix(code ^ np.uint64(0x5BD1E995)), head)
                for k in range(COORDS):
                    mins[at, k] = np.minimum.reduceat(((code * spread[k]) >> np.uint64(32)).astype(np.uint32), head)
            ids = mix(names[:, 0] + mix(names[:, 1]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(size),
                    pa.array(ids.view(np.int64)),
                    pa.array([m.tobytes() for m in mins], pa.binary()),
                ],
                ["doc_id", "n", "cid", "mins"],
            )

    return run


def sketched(documents: DataFrame, group: int = 0) -> DataFrame:
    """``(doc_id, n, cid, mins)``: set size, name of the set, minwise tokens of a group of trees."""
    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(_sketches(group), "doc_id long, n long, cid long, mins binary")


def _descend(mins: np.ndarray, owner: np.ndarray, path: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Children after some levels: which row, and the name of the node."""
    for _ in range(levels):
        pick = mix(path)
        first = (pick % np.uint64(COORDS)).astype(np.int64)
        second = ((pick >> np.uint64(8)) % np.uint64(COORDS - 1)).astype(np.int64)
        second = np.where(second >= first, second + 1, second)
        also = (pick >> np.uint64(32)) % np.uint64(3) == 0
        owner, path, coord = (
            np.concatenate([owner, owner[also]]),
            np.concatenate([path, path[also]]),
            np.concatenate([first, second[also]]),
        )
        path = mix(path * np.uint64(0x9E3779B97F4A7C15) + mins[owner, coord].astype(np.uint64) + (coord.astype(np.uint64) << np.uint64(40)))
    return owner, path


def _brief(mins: np.ndarray) -> np.ndarray:
    """Two bits of each token, in two 64-bit words."""
    low, high = (mins & 1).astype(np.uint64), ((mins >> 1) & 1).astype(np.uint64)
    shift = np.arange(COORDS, dtype=np.uint64)
    return np.stack([(low << shift).sum(1, dtype=np.uint64), (high << shift).sum(1, dtype=np.uint64)], 1)


MEMBER = "cid long, doc long, n long, s0 long, s1 long"


def _members(levels: int, from_roots: bool):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            mins = np.frombuffer(b"".join(batch.column("mins").to_pylist()), np.uint32).reshape(-1, COORDS)
            rows = np.arange(len(mins))
            if from_roots:
                owner = np.repeat(rows, TREES)
                path = np.tile(mix(np.arange(1, TREES + 1, dtype=np.uint64)), len(mins))
            else:
                owner, path = rows, batch.column("node").to_numpy().view(np.uint64)
            owner, path = _descend(mins, owner, path, levels)
            brief = _brief(mins)[owner].view(np.int64)
            take = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [pa.array(path.view(np.int64)), *(batch.column(c).take(take) for c in ("cid", "doc", "n")), pa.array(brief[:, 0]), pa.array(brief[:, 1])],
                ["node", "cid", "doc", "n", "s0", "s1"],
            )

    return run


def _agree(x, y) -> np.ndarray:
    differ = (x[0] ^ y[0]) | (x[1] ^ y[1])
    return COORDS - np.bitwise_count(differ).astype(np.int64)


def _possible(x, y, nx, ny) -> np.ndarray:
    """Whether sizes and sketches leave a link possible."""
    return (100 * np.minimum(nx, ny) >= NEED * np.maximum(nx, ny)) & (_agree(x, y) >= LEAST_AGREE)


PAIR = "a long, da long, b long, db long"
CORE = ("node", "cid", "doc", "n", "s0", "s1")


def _flat(batch) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Fields of all members of the nodes of a batch, where each node begins, and its size."""
    members = batch.column("members")
    flat, size = members.flatten(), members.value_lengths().to_numpy()
    head = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
    return {f.name: flat.field(f.name).to_numpy() for f in flat.type}, head, size


def _sketch_of(field: dict[str, np.ndarray], at: np.ndarray):
    return field["s0"].view(np.uint64)[at], field["s1"].view(np.uint64)[at]


def _likeliest(batches):
    """Each member of a node with the earlier member whose sketch agrees most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        field, head, size = _flat(batch)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in np.unique(size):
            starts = head[size == k]
            at = starts[:, None] + np.arange(k)
            at = np.take_along_axis(at, np.argsort(field["cid"][at], axis=1), 1)
            for m in range(1, k):
                mine, others = np.repeat(at[:, m : m + 1], m, axis=1), at[:, :m]
                x, y = _sketch_of(field, mine), _sketch_of(field, others)
                ok = _possible(x, y, field["n"][mine], field["n"][others]) & (field["cid"][mine] != field["cid"][others])
                agree = np.where(ok, _agree(x, y), -1)
                best = np.argmax(agree, axis=1)
                rows = np.flatnonzero(agree[np.arange(len(at)), best] >= 0)
                left.append(others[rows, best[rows]])
                right.append(at[rows, m])
        i, j = np.concatenate(left), np.concatenate(right)
        columns = [field["cid"][i], field["doc"][i], field["cid"][j], field["doc"][j]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "da", "b", "db"])


def _undecided(batches):
    """Members of a node that may link to a member of another component."""
    for batch in batches:
        if not batch.num_rows:
            continue
        field, head, size = _flat(batch)
        node = batch.column("node").to_numpy()
        taken, of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(len(node)):
            at = np.arange(head[i], head[i] + size[i])
            x, n, part = _sketch_of(field, at), field["n"][at], field["component"][at]
            ok = _possible((x[0][:, None], x[1][:, None]), x, n[:, None], n) & (part[:, None] != part)
            keep = at[ok.any(1)]
            taken.append(keep)
            of.append(np.full(len(keep), node[i]))
        at = np.concatenate(taken)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(of)), *(pa.array(field[c][at]) for c in ("cid", "doc", "component"))], ["node", "cid", "doc", "component"]
        )


def _linked(texts: list[str], cids: list[int], parts: list[int]) -> list[tuple[int, int]]:
    """Links of one node between components, as few as join them; full sets are compared."""
    k = len(texts)
    rows, codes = [], []
    for t in slices(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])):
        row, code = shingles(t)
        rows.append(row + t.rows.start)
        codes.append(code)
    row, code = np.concatenate(rows), np.concatenate(codes)
    right = _named(row, code, k) == np.array(cids, np.int64)
    total = np.bincount(row, minlength=k)
    _, slot, often = np.unique(code, return_inverse=True, return_counts=True)
    shared = often[slot] > 1
    row, slot = row[shared], np.unique(slot[shared], return_inverse=True)[1]
    # Members of the largest component need no comparison among themselves.
    names, part = np.unique(parts, return_inverse=True)
    few = np.flatnonzero(part != np.argmax(np.bincount(part)))
    common = np.zeros((len(few), k), np.float64)
    for low in range(0, int(slot.max()) + 1 if len(slot) else 0, 8192):
        some = (slot >= low) & (slot < low + 8192)
        held = np.zeros((k, 8192), np.float32)
        held[row[some], slot[some] - low] = 1
        common += held[few] @ held.T
    ok = (100 * common >= NEED * (total[few][:, None] + total - common)) & right[few][:, None] & right
    root = list(range(len(names)))
    out = []
    for i, j in zip(*np.nonzero(ok), strict=True):
        a, b = part[few[i]], part[j]
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        if a != b:
            root[a] = b
            out.append((min(cids[few[i]], cids[j]), max(cids[few[i]], cids[j])))
    return out


def _exhaustive(batches):
    """Rows come sorted by node; a node has at most SMALL of them."""
    node, rows = None, []
    for batch in batches:
        found = []
        for row in zip(*(batch.column(c).to_pylist() for c in ("node", "text", "cid", "component")), strict=True):
            if row[0] != node:
                if len(rows) > 1:
                    found += _linked(*map(list, zip(*rows, strict=True)))
                node, rows = row[0], []
            rows.append(row[1:])
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])
    if len(rows) > 1:
        found = _linked(*map(list, zip(*rows, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def _confirmed(batches):
    """Keep pairs whose full sets link; a text that is not the one of its class is skipped."""
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        want = [batch.column(c).to_numpy() for c in ("a", "b")]
        for texts in slices(batch, "text_a"):
            part = batch.slice(texts.rows.start, texts.rows.stop - texts.rows.start)
            row_a, code_a = shingles(texts)
            n = part.num_rows
            for other in slices(part, "text_b"):
                row_b, code_b = shingles(other)
                row_b = row_b + other.rows.start
                mine = (row_a >= other.rows.start) & (row_a < other.rows.stop)
                row, code = np.concatenate([row_a[mine], row_b]), np.concatenate([code_a[mine], code_b])
                order = np.lexsort((code, row))
                row, code = row[order], code[order]
                both = (row[1:] == row[:-1]) & (code[1:] == code[:-1])
                shared = np.bincount(row[1:][both], minlength=n)
                total = np.bincount(row, minlength=n)
                ok = (100 * shared >= NEED * (total - shared)) & (total > 0)
                for rows, codes, ids in ((row_a[mine], code_a[mine], want[0]), (row_b, code_b, want[1])):
                    ok &= _named(rows, codes, n) == ids[texts.rows]
                keep[texts.rows.start + other.rows.start : texts.rows.start + other.rows.stop] = ok[other.rows]
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _named(row: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
    """The names of the sets of rows."""
    one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    np.add.at(one, row, mix(code + np.uint64(1)))
    np.add.at(two, row, mix(code ^ np.uint64(0x5BD1E995)))
    return mix(one + mix(two)).view(np.int64)


def confirm(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """``(a, b)`` of the pairs that link, judged on whole texts."""
    texts = documents.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    left = texts.select(F.col("id").alias("da"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("db"), F.col("text").alias("text_b"))
    joined = pairs.distinct().join(left, "da").join(right, "db")
    return cut_lineage(joined.select("a", "b", "text_a", "text_b").mapInArrow(_confirmed, "a long, b long").distinct())


def _sized(members: DataFrame) -> DataFrame:
    """Members of nodes that hold two or more, with the size of the node."""
    sizes = members.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1")
    return members.join(sizes, "node")


def _bits(of: Column) -> Column:
    return F.bit_count(of).cast("long")


def _to_pivots(large: DataFrame, round_: int) -> DataFrame:
    """Pairs of each member of a large node with one of the node's pivots, by a hash of both.

    A class is in many nodes, so it meets several pivots; pivots come from partial aggregates.
    """
    me = F.struct("cid", "doc", "n", "s0", "s1")
    first = [F.min(F.struct(F.xxhash64("cid", F.lit(100 * round_ + k)).alias("order"), me.alias("m"))).getField("m") for k in range(PIVOTS)]
    pivots = large.groupBy("node").agg(F.array(*first).alias("pivots"))
    taken = F.get("pivots", F.pmod(F.xxhash64("cid", "node"), F.lit(PIVOTS)).cast("int"))
    each = large.join(pivots, "node").select("cid", "doc", "n", "s0", "s1", taken.alias("p")).filter("cid <> p.cid")
    differ = F.col("s0").bitwiseXOR(F.col("p.s0")).bitwiseOR(F.col("s1").bitwiseXOR(F.col("p.s1")))
    fits = (100 * F.least("n", "p.n") >= NEED * F.greatest("n", "p.n")) & (COORDS - _bits(differ) >= LEAST_AGREE)
    lower = F.col("cid") < F.col("p.cid")
    return each.filter(fits).select(
        F.least("cid", "p.cid").alias("a"),
        F.when(lower, F.col("doc")).otherwise(F.col("p.doc")).alias("da"),
        F.greatest("cid", "p.cid").alias("b"),
        F.when(lower, F.col("p.doc")).otherwise(F.col("doc")).alias("db"),
    )


def _grouped(small: DataFrame, *more: str) -> DataFrame:
    """One row per node, of bounded size."""
    return small.groupBy("node").agg(F.collect_list(F.struct("cid", "doc", "n", "s0", "s1", *more)).alias("members"))


def _in_blocks(big: DataFrame) -> DataFrame:
    """Members of nodes that do not part, as nodes of two blocks each: every two blocks of a node meet once."""
    blocks = F.ceil(F.col("size") / (SMALL // 2)).cast("int")
    own = F.pmod(F.xxhash64("node", "cid"), blocks).cast("int")
    dealt = big.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return dealt.withColumn("node", F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other"))).drop("own", "other")


def _compared(mixed: DataFrame, documents: DataFrame) -> DataFrame:
    """Links between components inside nodes of up to SMALL members."""
    rest = _grouped(mixed, "component").mapInArrow(_undecided, "node long, cid long, doc long, component long")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    met = rest.join(texts, "doc").select("node", "text", "cid", "component")
    dealt = met.repartition("node").sortWithinPartitions("node", "cid")
    return cut_lineage(dealt.mapInArrow(_exhaustive, "a long, b long").distinct())


def _with_components(members: DataFrame, links: DataFrame) -> DataFrame:
    parts = connected_components(links)
    return members.join(parts.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))


def _between(members: DataFrame) -> DataFrame:
    """Members of nodes that hold more than one component."""
    mixed = members.groupBy("node").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("node")
    return members.join(mixed, "node")


def links_of(classes: DataFrame, documents: DataFrame) -> DataFrame:
    """Confirmed links ``(a, b)`` that hold the components; ``classes`` has cid, doc, n, mins."""
    links, depths = _descended(classes, documents, None)
    done = 1
    while True:
        reached = [r[0] for r in depths.select("depth").distinct().collect()] if depths is not None else []
        short = [d for d in reached if groups(d) > done]
        if not short:
            return links
        deep = cut_lineage(classes.select("cid", "doc", "n").join(depths.filter(F.col("depth").isin(short)).select("cid"), "cid"))
        texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(deep.select(F.col("doc").alias("doc_id")), "doc_id", "left_semi")
        fresh = sketched(texts, done).select("cid", "mins").dropDuplicates(["cid"])
        links, more = _descended(cut_lineage(deep.join(fresh, "cid")), documents, links)
        done += 1
        if more is not None:
            depths = cut_lineage(depths.unionByName(more).groupBy("cid").agg(F.max("depth").alias("depth")))


def _descended(classes: DataFrame, documents: DataFrame, known: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """Known and new links of a group of trees, and ``(cid, depth)`` of the classes whose nodes went deeper."""
    members = classes.mapInArrow(_members(DEPTH, True), f"node long, {MEMBER}")
    sized = cut_lineage(_sized(members))
    if known is not None:
        sized = cut_lineage(_between(_with_components(sized, known)).select(*CORE, "size"))
    small, large = sized.filter(F.col("size") <= PAIRED), sized.filter(F.col("size") > PAIRED)
    pairs = _grouped(small).select("members").mapInArrow(_likeliest, PAIR).unionByName(_to_pivots(large, 0))
    links, round_, deep = confirm(pairs, documents), 0, None
    if known is not None:
        links = cut_lineage(known.unionByName(links))
    while True:
        mixed = cut_lineage(_between(_with_components(sized.select(*CORE, "size"), links)))
        links = links.unionByName(_compared(mixed.filter(F.col("size") <= SMALL), documents))
        big = mixed.filter(F.col("size") > SMALL)
        if big.isEmpty():
            return links, deep
        round_ += 1
        if round_ > ROUNDS:
            return cut_lineage(links.unionByName(_compared(_in_blocks(big), documents))), deep
        here = big.select("cid").distinct().withColumn("depth", F.lit(DEPTH + 2 * round_))
        deep = here if deep is None else here.unionByName(deep)
        deep = cut_lineage(deep.groupBy("cid").agg(F.max("depth").alias("depth")))
        below = big.select("node", "cid", "doc", "n").join(classes.select("cid", "mins"), "cid")
        deeper = below.mapInArrow(_members(2, False), f"node long, {MEMBER}")
        sized = cut_lineage(_sized(deeper))
        stars = _to_pivots(sized.filter(F.col("size") > SMALL), round_)
        links = cut_lineage(links.unionByName(confirm(stars, documents)))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of every row."""
    rows = cut_lineage(sketched(documents))
    known = rows.filter("doc_id is not null and n > 0")
    named = known.groupBy("cid").agg(F.min("doc_id").alias("doc"))
    classes = cut_lineage(known.join(named, "cid").filter("doc_id = doc").select("cid", "doc", "n", "mins").dropDuplicates(["cid"]))
    links = links_of(classes, documents)
    # An id with several texts ties their classes.
    twice = known.groupBy("doc_id").agg(F.min("cid").alias("a"), F.max("cid").alias("z")).filter("a <> z")
    same = known.join(twice, "doc_id").select("a", F.col("cid").alias("b")).filter("a <> b").distinct()
    parts = connected_components(links.unionByName(same)).withColumnRenamed("node", "cid")
    placed = classes.select("cid", "doc").join(parts, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = placed.groupBy("component").agg(F.min("doc").alias("component_id"))
    of_class = placed.join(least, "component").select("cid", "component_id")
    joined = rows.select("doc_id", "n", "cid").join(of_class, "cid", "left")
    component = F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id.

    Rows that repeat the kept id with the same set come once.
    """
    found = near_duplicates(docs).filter("kept and doc_id is not null").select("doc_id").distinct()
    with_id = docs.filter("doc_id is not null").join(found, "doc_id").select(docs.columns)
    once = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    place = max(docs.columns, key=len) + "_place"  # longer than any name of the table
    with_id = with_id.withColumn(place, F.row_number().over(once)).filter(F.col(place) == 1).drop(place)
    return with_id.unionByName(docs.filter("doc_id is null"))


def oracle() -> str:
    """Shared shingles of all pairs, and components by spreading the smallest id; ids are unique there."""
    return """
    with recursive texts as (
      select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) as w
      from documents),
    places as (select doc_id, w, unnest(range(0, greatest(len(w) - 4, least(len(w), 1)))) as i from texts),
    shingles as (select distinct doc_id, md5(array_to_string(w[i + 1 : i + 5], ' ')) as s from places),
    sizes as (select doc_id, count(*) as n from shingles group by doc_id),
    shared as (
      select a.doc_id as a, b.doc_id as b, count(*) as n from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
    linked as (
      select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * shared.n >= 75 * (x.n + y.n - shared.n)),
    edges as (select a, b from linked union all select b, a from linked),
    reach(doc_id, other) as (
      select doc_id, doc_id from documents
      union select reach.doc_id, edges.b from reach join edges on edges.a = reach.other),
    least as (select doc_id, min(other) as component_id from reach group by doc_id)
    select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, doc_id = component_id as kept
    from least left join sizes using (doc_id)"""
