"""Mixing sources to target weights by a low-discrepancy schedule of equal blocks of words.

Sources, in the order of their code points and null last, weigh ``weights`` in turn and share ``volume`` times all
words; a target stops at ``repeats`` times its source's words, and the excess is shared again by weight
(solved at once: in the order of the ratio at which sources fill up, the first one that stays below its share
tells the level of all later ones).

A source's documents, shuffled by a hash of the id, are one stream of words, cut in blocks of
``block`` words; the last one may be shorter. A pass over the blocks takes them in a shuffled order, another one each time.
The schedule maps the points ``i / golden ratio mod 1`` through the cumulative shares of the sources: slot ``i``
belongs to the source that its point falls on. Slots are ranked per source, and the ``r``-th slot of a source
takes the ``r``-th block of its passes until the whole words of the target are used up (the last one in part). The few slots
that a source lacks in the end, as points are only nearly even, follow after the last point. So the words taken
are the target's, rounded down, and no document is taken more often than the passes that were begun.

Null texts have no words; rows without words take none. Null sources are one source. Rows without an id are shuffled as the empty id.
Repeated rows are rows of their own; equal ones may swap places, which no result shows. A text of any length lies in
as many blocks as it needs. An empty table gives an empty result; sources without words have the target 0. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kerbline.llm.regular import segments, sorted_runs
from kerbline.session import cut_lineage

#: Points are multiples of 2**-31; the step is the nearest odd number to 2**31 over the golden ratio.
POINT_BITS = 31
STEP = 1_327_217_885
#: Primes whose multiples, modulo the number of blocks, order a pass.
STRIDES = (2_654_435_761, 2_147_483_647)
#: Slots ranked in one task.
CHUNK = 1 << 16


@dataclass(frozen=True)
class Mix:
    weights: tuple[int, ...] = (5, 2, 1)
    volume: float = 1.5
    repeats: int = 2
    block: int = 1024
    seed: int = 13


def _before(order) -> W:
    return order.rowsBetween(W.unboundedPreceding, -1)


def sized(documents: DataFrame, seed: int) -> DataFrame:
    """``(doc_id, source, size, h)`` of every row, written."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    return cut_lineage(
        documents.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long").alias("size"),
            F.conv(F.substring(key, 1, 15), 16, 10).cast("long").alias("h"),
        )
    )


def shares(docs: DataFrame, mix: Mix) -> DataFrame:
    """A row per source: its number, words, target, blocks and slots, and where its points begin and end."""
    everything = W.partitionBy()
    cap, weight = F.col("cap"), F.col("weight")
    rows = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    rows = rows.withColumn("sno", (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1).cast("long"))
    rows = rows.withColumn("weight", F.element_at(F.array(*map(F.lit, mix.weights)), (F.col("sno") % len(mix.weights) + 1).cast("int")))
    rows = rows.withColumn("cap", (F.col("source_size") * mix.repeats).cast("double"))
    filling = W.orderBy(cap / weight, "sno")
    left = F.sum("source_size").over(everything) * F.lit(mix.volume) - F.coalesce(F.sum(cap).over(_before(filling)), F.lit(0.0))
    open_ = F.sum(weight).over(filling.rowsBetween(0, W.unboundedFollowing))
    rows = rows.select("*", F.row_number().over(filling).alias("turn"), left.alias("left"), open_.alias("open"))
    below = F.when(F.col("left") * weight / F.col("open") <= cap, F.struct("turn", "left", "open"))
    rows = rows.withColumn("level", F.min(below).over(everything))
    share = F.col("level.left") * weight / F.col("level.open")
    rows = rows.withColumn("target", F.when(F.col("turn") >= F.col("level.turn"), share).otherwise(cap))
    words = F.floor("target").cast("long")
    rows = rows.select(
        "sno",
        "source",
        "source_size",
        "target",
        words.alias("words"),
        F.expr(f"source_size div {mix.block}").alias("full"),
        F.ceil(F.col("source_size") / mix.block).cast("long").alias("blocks"),
        F.expr("cast(floor(target) as bigint) div greatest(source_size, 1)").alias("passes"),
        (words % F.greatest(F.col("source_size"), F.lit(1))).alias("rest"),
    )
    need = F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / mix.block).cast("long")
    rows = rows.withColumn("need", need)
    rows = rows.withColumns(
        {
            "earlier": F.coalesce(F.sum("need").over(_before(W.orderBy("sno"))), F.lit(0)),
            "slots": F.sum("need").over(everything),
        }
    )
    edge = lambda c: F.floor(c / F.greatest(F.col("slots"), F.lit(1)) * F.lit(float(1 << POINT_BITS))).cast("long")
    return cut_lineage(rows.withColumns({"low": edge(F.col("earlier")), "high": edge(F.col("earlier") + F.col("need"))}))


def schedule(sources: DataFrame, mix: Mix) -> DataFrame:
    """``(slot, sno, pass, block, take)``: which block each slot takes, and how many of its words."""
    spark = sources.sparkSession
    totals = sources.agg(F.max("slots").alias("slots"), F.count("*").alias("sources")).first()
    slots, bits = totals["slots"] or 0, min(24, 8 + int(totals["sources"]).bit_length())
    # Points and the ranges of sources meet in cells of which a range has a few.
    cell = lambda c: F.shiftright(c, POINT_BITS - bits)
    ranges = sources.filter("high > low").select("sno", "low", "high", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high") - 1))).alias("cell"))
    whole = F.lit(1 << POINT_BITS)
    points = spark.range(slots).select(F.col("id").alias("slot"), ((F.col("id") % whole) * STEP % whole).alias("x"))
    fallen = points.withColumn("cell", cell(F.col("x"))).join(ranges, "cell").filter("x >= low and x < high")
    fallen = fallen.select("slot", "sno", F.expr(f"slot div {CHUNK}").alias("chunk"))
    counts = fallen.groupBy("sno", "chunk").agg(F.count("*").alias("n"))
    carried = counts.select("sno", "chunk", F.coalesce(F.sum("n").over(_before(W.partitionBy("sno").orderBy("chunk"))), F.lit(0)).alias("carry"))
    here = F.row_number().over(W.partitionBy("sno", "chunk").orderBy("slot")) - 1
    ranked = fallen.withColumn("here", here).join(carried, ["sno", "chunk"]).select("sno", "slot", (F.col("carry") + F.col("here")).alias("rank"))
    have = counts.groupBy("sno").agg(F.sum("n").alias("have"))
    lacking = sources.join(have, "sno", "left").withColumn("have", F.coalesce("have", F.lit(0))).filter("have < need")
    tail = lacking.select("sno", "earlier", F.explode(F.sequence("have", F.col("need") - 1)).alias("rank"))
    tail = tail.select("sno", (F.lit(slots) + F.col("earlier") + F.col("rank")).alias("slot"), "rank")
    placed = ranked.unionByName(tail).join(sources.drop("slots"), "sno").filter("rank < need")
    full = F.greatest(F.col("full"), F.lit(1))
    stride = F.when(full % STRIDES[0] == 0, F.lit(STRIDES[1])).otherwise(F.lit(STRIDES[0])) % full
    turn, at = F.expr("rank div blocks"), F.col("rank") % F.col("blocks")
    shift = ((turn + 1) * 7919 + F.col("sno") * 104729) % full
    block = F.when(at < F.col("full"), (stride * at + shift) % full).otherwise(F.col("full"))
    length = F.when(at < F.col("full"), F.lit(mix.block)).otherwise(F.col("source_size") - F.col("full") * mix.block)
    take = F.least(length, F.col("words") - turn * F.col("source_size") - at * mix.block)
    return placed.select("slot", "sno", turn.alias("pass"), block.alias("block"), take.alias("take"))


def placed(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Each row with the number of words before it in its source's shuffled stream, written."""
    spark = docs.sparkSession
    known = sources.select(F.col("source").alias("named"), "sno")
    rows = docs.join(known, F.col("source").eqNullSafe(F.col("named"))).select("sno", "h", "size", "doc_id")
    keys = ["sno", "h", "size"]
    cut, _ = segments(sorted_runs(rows, keys), keys, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sums = cut.groupBy("sno", "segment").agg(F.sum("size").alias("words"))
    earlier = sums.select("sno", "segment", F.coalesce(F.sum("words").over(_before(W.partitionBy("sno").orderBy("segment"))), F.lit(0)).alias("earlier"))
    inside = F.coalesce(F.sum("size").over(_before(W.partitionBy("sno", "segment").orderBy("h", "size", "tie"))), F.lit(0))
    rows = cut.withColumn("inside", inside).join(earlier, ["sno", "segment"])
    return cut_lineage(rows.select("tie", "sno", "doc_id", "size", (F.col("earlier") + F.col("inside")).alias("start")))


def pieces(rows: DataFrame, slots: DataFrame, mix: Mix) -> DataFrame:
    """``(slot, sno, pass, tie, doc_id, from_word, to_word)``: the words of documents that each slot takes."""
    last = F.expr(f"(start + size - 1) div {mix.block}")
    parts = rows.filter("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"start div {mix.block}"), last)))
    both = parts.join(slots, ["sno", "block"])
    begin = F.col("block") * mix.block
    low: Column = F.greatest(F.col("start"), begin) - F.col("start")
    high: Column = F.least(F.col("start") + F.col("size"), begin + F.col("take")) - F.col("start")
    return both.select("slot", "sno", "pass", "tie", "doc_id", low.alias("from_word"), high.alias("to_word")).filter("to_word > from_word")


def mixed(documents: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix itself: ``(slot, source, pass, doc_id, from_word, to_word)``, to be read in the order of the slot."""
    docs = sized(documents, mix.seed)
    sources = shares(docs, mix)
    found = pieces(placed(docs, sources), schedule(sources, mix), mix)
    return found.join(sources.select("sno", "source"), "sno").select("slot", "source", "pass", "doc_id", "from_word", "to_word")


def taken(documents: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` of every row."""
    docs = sized(documents, mix.seed)
    sources = shares(docs, mix)
    rows = placed(docs, sources)
    words = pieces(rows, schedule(sources, mix), mix).groupBy("tie").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    found = rows.join(words, "tie", "left").join(sources.select("sno", "source_size", "target"), "sno")
    return found.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def query(spark, sf_dir: str) -> DataFrame:
    return taken(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle(mix: Mix = Mix()) -> str:
    """The same rows in SQL: which blocks a source takes does not depend on when its slots come."""
    weight = "CASE sno % {n} {when} END".format(
        n=len(mix.weights), when=reduce(lambda a, b: f"{a} {b}", [f"WHEN {i} THEN {w}" for i, w in enumerate(mix.weights)])
    )
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
             ('0x' || substr(md5('{mix.seed}:' || doc_id), 1, 15))::BIGINT AS h FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sno FROM s0),
s2 AS (SELECT *, {weight} AS weight, ({mix.repeats} * source_size)::DOUBLE AS cap FROM s1),
s3 AS (SELECT *, row_number() OVER f AS turn,
         {mix.volume}::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
         (sum(weight) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS unfilled
       FROM s2 WINDOW f AS (ORDER BY cap / weight, sno)),
level AS (SELECT * FROM (SELECT turn AS l_turn, remaining AS l_remaining, unfilled AS l_unfilled FROM s3 WHERE remaining * weight / unfilled <= cap ORDER BY turn LIMIT 1)),
s4 AS (SELECT sno, source, source_size, CASE WHEN turn >= l_turn THEN l_remaining * weight / l_unfilled ELSE cap END AS target FROM s3 LEFT JOIN level ON true),
s AS (SELECT *, floor(target)::BIGINT // greatest(source_size, 1) AS passes, floor(target)::BIGINT % greatest(source_size, 1) AS rest,
        source_size // {mix.block} AS full_blocks FROM s4),
step AS (SELECT sno, rest, full_blocks, passes, unnest(range((rest + {mix.block - 1}) // {mix.block})) AS p FROM s),
block AS (SELECT sno, {mix.block} * CASE WHEN p < full_blocks
              THEN ({STRIDES[0]} % greatest(full_blocks, 1) * p + ((passes + 1) * 7919 + sno * 104729) % greatest(full_blocks, 1)) % greatest(full_blocks, 1)
              ELSE full_blocks END AS b, least({mix.block}, rest - p * {mix.block}) AS take FROM step),
placed AS (SELECT doc_id, size, sno, source_size, target, passes,
             (sum(size) OVER (PARTITION BY sno ORDER BY h, size ROWS UNBOUNDED PRECEDING))::BIGINT - size AS a
           FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
more AS (SELECT doc_id, sum(least(a + size, b + take) - greatest(a, b)) AS n FROM placed JOIN block USING (sno)
         WHERE a < b + take AND a + size > b GROUP BY doc_id)
SELECT doc_id, size, source_size, target, (passes * size + coalesce(n, 0))::BIGINT AS taken FROM placed LEFT JOIN more USING (doc_id)"""
