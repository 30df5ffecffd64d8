"""Secret scans: known forms, and a randomness test battery with length-aware false-discovery control.

Base spans are three fixed patterns. The battery looks at maximal runs of 20 or more token
characters in what the base spans leave, a run ending at ``=`` (padding belongs to it), and at the long parts of a run between slashes. The encoding of a run (hex of either case, base32, base64 or its URL form) gives
its alphabet; over it a chi-square test of uniformity, a runs test about the middle and a lag-one
serial correlation test must all fail to reject randomness at ``ALPHA``. The null hypothesis that
counts for discoveries is text in the alphabet of the run. For base64 the chi-square statistic of letters with
the collision rate of language gives a p-value. In the small alphabets of hex and base32 random symbols
collide nearly as often as text; there text is words and numbers in turn, their letters as frequent as
in language, and its likelihood over that of random symbols is a p-value (its mean is one under the null, so
Markov's inequality bounds the tail at any length). Benjamini-Hochberg at ``FDR`` runs in strata of length (powers of two),
because short runs have little power. Its counts come from a histogram of fixed size over all texts.

All of it is DataFrame expressions. Places come from running sums in chunks, so a text of any length and number of matches
takes little more than linear time; texts are read whole. Null text counts as empty. Null ids keep their row, repeated
rows come repeated; an empty table gives an empty result. Extra columns are ignored (query) or kept
(stage); working columns have names of their own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.session import cut_lineage

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
#: A run begins after another character, so this finds the maximal runs.
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
RUN_LEAST = 20
#: Values that a fold appends one by one before it starts anew.
CHUNK = 256
KINDS = ("assign", "access", "hex", "random")
VALUE_LEAST = 6
ALPHA, FDR = 0.001, 0.01
#: Chance that two letters of running text are equal.
COLLISION = 0.075
#: Letters of running text in hundredths, one at least, so that rare letters of one language prove nothing.
LETTERS = dict(zip("abcdefghijklmnopqrstuvwxyz", (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2, 6.1, 7, 1, 1, 4, 2.4, 6.7, 7.5, 1.9, 1, 6, 6.3, 9.1, 2.8, 1, 2.4, 1, 2, 1), strict=True))
#: Chance that a word or a number ends after a symbol: both are about five symbols long.
SWITCH = 0.2
#: Tenths of a power of ten: p-values below 1e-30 share a bin.
BINS = 300
MARK = "[SECRET]"

_HEXES = "0123456789abcdef"
_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_B64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"

_SPAN = "array<struct<start:int,kind:int,end:int>>"
_NO_RUNS = "array<struct<start:int,end:int,run:string>>"


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def _before(values: Column, step) -> Column:
    """The fold by ``step`` (a sum or a maximum, from 0) of the values before each one.

    Folds that append are quadratic: they run inside chunks, and once more over the chunks.
    """
    none = F.lit([]).cast("array<int>")

    def scan(of: Column, value) -> Column:
        begin = F.struct(F.lit(0).alias("at"), none.alias("out"))
        return F.aggregate(of, begin, lambda s, x: F.struct(step(s["at"], value(x)).alias("at"), F.array_append(s["out"], s["at"]).alias("out")))

    cuts = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / CHUNK).cast("int"))
    chunks = F.transform(cuts, lambda i: F.slice(values, F.greatest(i, F.lit(0)) * CHUNK + 1, CHUNK))
    folded = F.transform(chunks, lambda c: scan(c, lambda x: x))
    joined = lambda done: F.flatten(F.zip_with(done, scan(done, lambda d: d["at"])["out"], lambda d, base: F.transform(d["out"], lambda x: step(x, base))))
    return _bound(folded, joined)


def _parts(text: Column, pattern: str, least: int = 0) -> Column:
    """``(gap, hit, taken)``: the text as gaps and matches in turn; the last match is null."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if least else found
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit"), value.alias("value"))
    taken = lambda p: p["hit"].isNotNull() & (F.char_length(p["value"]) >= least)
    return F.transform(parts, lambda p: F.struct(p["gap"].alias("gap"), p["hit"].alias("hit"), taken(p).alias("taken")))


def _spans(parts: Column, kind: int) -> Column:
    """``(start, kind, end, hit)`` of the matches taken, in code points."""
    size = lambda c: F.coalesce(F.char_length(c), F.lit(0))

    def placed(p: Column) -> Column:
        offsets = _before(F.transform(p, lambda x: size(x["gap"]) + size(x["hit"])), lambda x, y: x + y)

        def span(x: Column, at: Column) -> Column:
            start = at + size(x["gap"])
            one = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + size(x["hit"])).alias("end"), x["hit"].alias("hit"))
            return F.when(x["taken"], one)

        return F.filter(F.zip_with(p, offsets, span), lambda x: x.isNotNull())

    return _bound(parts, placed)


_EMPTY = "array<struct<start:int,kind:int,end:int,hit:string>>"


def _matches(text: Column, pattern: str, kind: int, least: int = 0) -> Column:
    """``(start, kind, end, hit)`` of the leftmost matches that do not overlap."""
    return F.when(text.rlike(pattern), _spans(_parts(text, pattern, least), kind)).otherwise(F.lit([]).cast(_EMPTY))


def _masked(text: Column, pattern: str, least: int = 0) -> Column:
    """The text with blanks in place of the matches: they are ASCII, so all places stay."""

    def blank(p: Column) -> Column:
        return F.concat(p["gap"], F.when(p["taken"], F.repeat(F.lit(" "), F.char_length(p["hit"]))).otherwise(F.coalesce(p["hit"], F.lit(""))))

    masked = lambda t: F.when(t.rlike(pattern), F.array_join(F.transform(_parts(t, pattern, least), blank), "")).otherwise(t)
    return _bound(text, masked)


def _with_parts(span: Column) -> Column:
    """A run, and its long parts between slashes."""

    def cut(pieces: Column) -> Column:
        offsets = _before(F.transform(pieces, lambda p: F.char_length(p) + 1), lambda x, y: x + y)

        def part(p: Column, at: Column) -> Column:
            start = span["start"] + at
            one = F.struct(start.alias("start"), F.lit(3).alias("kind"), (start + F.char_length(p)).alias("end"), p.alias("hit"))
            return F.when(F.char_length(p) >= RUN_LEAST, one)

        return F.concat(F.array(span), F.filter(F.zip_with(pieces, offsets, part), lambda x: x.isNotNull()))

    return F.when(F.contains(span["hit"], F.lit("/")), _bound(F.split(span["hit"], "/"), cut)).otherwise(F.array(span))


def _phi(z: Column) -> Column:
    """The normal distribution function, by a logistic form."""
    z = F.greatest(F.least(z, F.lit(12.0)), F.lit(-12.0))
    return 1 / (1 + F.exp(-(1.5976 * z + 0.07056 * z * z * z)))


def _weights(alphabet: str) -> list[float]:
    """Decimal logarithms of the chances of the symbols in text, among letters and among digits."""
    digits = sum(c.isdigit() for c in alphabet)
    letters = sum(LETTERS[c.lower()] for c in alphabet if c.isalpha())
    return [math.log10(1 / digits if c.isdigit() else LETTERS[c.lower()] / letters) for c in alphabet]


def _alphabet(run: Column) -> Column:
    """The symbols of the encoding that a run (without padding) shows; null for plain numbers."""
    lowered = run.rlike("^([0-9a-f]+|[0-9A-F]+)$")
    return (
        F.when(run.rlike("^[0-9]*$"), F.lit(None).cast("string"))
        .when(lowered, F.lit(_HEXES))
        .when(run.rlike("^[A-Z2-7]+$"), F.lit(_B32))
        .otherwise(F.lit(_B64))
    )


def _tested(span: Column) -> Column:
    """``(start, end, stratum, bin, random)`` of a run."""
    bare = F.regexp_replace(span["hit"], "=+$", "")
    plain = F.when(bare.rlike("^[0-9A-F]+$"), F.lower(bare)).otherwise(F.translate(bare, "-_=", "+//"))
    made = F.transform(F.array(F.struct(plain.alias("s"), _alphabet(bare).alias("of"))), _symbols)
    made = F.transform(made, _sums)
    tested = F.transform(made, _decide)
    return F.struct(span["start"].alias("start"), span["end"].alias("end"), tested[0].alias("t"))


def _symbols(x: Column) -> Column:
    """The places of the symbols in the alphabet."""
    each = F.split(x["s"], "")
    places = F.transform(each, lambda c: F.instr(x["of"], c) - 1)
    return F.struct(places.alias("v"), F.char_length(x["of"]).cast("double").alias("a"))


def _sums(x: Column) -> Column:
    v, a = x["v"], x["a"]
    n = F.size(v).cast("double")
    counts = F.transform(F.array_distinct(v), lambda s: F.size(F.filter(v, lambda t: t == s)).cast("double"))
    squares = F.aggregate(counts, F.lit(0.0), lambda s, c: s + c * c)
    high = F.transform(v, lambda t: F.when(t >= a / 2, 1).otherwise(0))
    pairs = F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    turns = F.aggregate(pairs, F.lit(1.0), lambda s, t: s + F.when((t["p"] >= a / 2) != (t["q"] >= a / 2), 1.0).otherwise(0.0))
    digit = lambda t: F.when(a == len(_HEXES), t < 10).otherwise(t >= 26)
    switches = F.aggregate(pairs, F.lit(0.0), lambda s, t: s + F.when(digit(t["p"]) != digit(t["q"]), 1.0).otherwise(0.0))
    weights = F.when(a == len(_HEXES), F.array(*map(F.lit, _weights(_HEXES)))).otherwise(F.array(*map(F.lit, _weights(_B32))))
    chances = F.aggregate(v, F.lit(math.log10(0.5)), lambda s, t: s + F.get(weights, t))
    text = chances + switches * math.log10(SWITCH) + (n - 1 - switches) * math.log10(1 - SWITCH)
    middle = (a - 1) / 2
    along = F.aggregate(pairs, F.lit(0.0), lambda s, t: s + (t["p"] - middle) * (t["q"] - middle))
    return F.struct(
        n.alias("n"),
        a.alias("a"),
        (a / n * squares - n).alias("x2"),
        F.aggregate(high, F.lit(0.0), lambda s, t: s + t).alias("ones"),
        turns.alias("turns"),
        along.alias("along"),
        F.when(a < len(_B64), F.greatest(n * -F.log10(a) - text, F.lit(0.0))).alias("odds"),
    )


def _decide(s: Column) -> Column:
    n, a, x2, ones = s["n"], s["a"], s["x2"], s["ones"]
    df = a - 1
    # Wilson and Hilferty: the cube root of chi-square over its freedom is nearly normal.
    uniform = (F.pow(x2 / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    cross = 2 * ones * (n - ones)
    spread = cross * (cross - n) / (n * n * (n - 1))
    runs = F.when(spread > 0, (s["turns"] - cross / n - 1) / F.sqrt(spread)).otherwise(F.lit(12.0))
    # The variance of a symbol drawn evenly is (a * a - 1) / 12.
    serial = s["along"] / ((a * a - 1) / 12) / F.sqrt(n - 1)
    low = F.least(1 - _phi(uniform), 2 * (1 - _phi(F.abs(runs))), 2 * (1 - _phi(F.abs(serial))))
    expected = a + a * (n - 1) * COLLISION - n
    deviation = a / n * 2 * F.sqrt(n * (n - 1) / 2 * COLLISION * (1 - COLLISION))
    collisions = -F.log10(F.greatest(_phi((x2 - expected) / deviation), F.lit(1e-300)))
    return F.struct(
        F.floor(F.log2(n)).cast("int").alias("stratum"),
        F.least(F.floor(10 * F.coalesce(s["odds"], collisions)), F.lit(BINS)).cast("int").alias("bin"),
        (a.isNotNull() & (n >= 16) & (low >= ALPHA / 3)).alias("random"),
    )


def unused(documents: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    have = {c.lower() for c in documents.columns}
    while name.lower() in have:
        name += "_"
    return name


def scanned(documents: DataFrame, base_name: str = "_base", runs_name: str = "_runs") -> DataFrame:
    """Adds spans of the fixed patterns, and tested runs outside them."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = F.concat(_matches(text, ASSIGN, 0, VALUE_LEAST), _matches(text, ACCESS, 1), _matches(text, HEX, 2))
    slim = F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    with_base = documents.withColumn(base_name, F.array_sort(slim))
    rest = text
    for pattern, least in ((ASSIGN, VALUE_LEAST), (ACCESS, 0), (HEX, 0)):
        rest = _masked(rest, pattern, least)
    runs = _bound(rest, lambda t: F.flatten(F.transform(_matches(t, RUN, 3), _with_parts)))
    return with_base.withColumn(runs_name, F.transform(runs, _tested))


def limits(scanned_rows: DataFrame, runs_name: str = "_runs") -> dict[int, int]:
    """The least bin that is a discovery in each stratum of length, over all runs."""
    each = scanned_rows.select(F.explode(runs_name).alias("r")).select("r.t.stratum", "r.t.bin").filter("stratum is not null")
    counts = each.groupBy("stratum", "bin").count()  # strata times bins: a few thousand rows at most
    beyond = Window.partitionBy("stratum").orderBy(F.desc("bin"))
    ranked = counts.withColumn("rank", F.sum("count").over(beyond)).withColumn("all", F.sum("count").over(Window.partitionBy("stratum")))
    within = ranked.filter(F.pow(F.lit(10.0), -F.col("bin") / 10) <= FDR * F.col("rank") / F.col("all"))
    return {r["stratum"]: r["bin"] for r in within.groupBy("stratum").agg(F.min("bin").alias("bin")).collect()}


def _found(found: dict[int, int], runs_name: str = "_runs") -> Column:
    """Spans of the runs that are random and discoveries."""
    if not found:
        return F.lit([]).cast(_SPAN)
    table = F.create_map(*[F.lit(x) for pair in sorted(found.items()) for x in pair])
    good = F.filter(runs_name, lambda r: r["t"]["random"] & (r["t"]["bin"] >= table[r["t"]["stratum"]]))
    return F.transform(good, lambda r: F.struct(r["start"].alias("start"), F.lit(3).alias("kind"), r["end"].alias("end")))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), one), ",")


def secrets(documents: DataFrame) -> DataFrame:
    """Counts and spans of every row."""
    rows = cut_lineage(scanned(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).drop("text"))
    count = lambda kind: F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long")
    return rows.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_written(F.col("_base")), 256).alias("base_sha256"),
        _written(F.concat("_base", _found(limits(rows)))).alias("spans"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced; spans that overlap or touch share a mark."""

    def cut(x: Column) -> Column:
        chars, own, before = x["chars"], x["own"], x["before"]
        until = F.greatest(F.get(before, F.size(own) - 1), F.get(own, F.size(own) - 1)["end"])

        def piece(span: Column, at: Column) -> Column:
            gap = F.array_join(F.slice(chars, at + 1, F.greatest(span["start"] - at, F.lit(0))), "")
            return F.when((span["start"] > at) | (at == 0), F.concat(gap, F.lit(MARK))).otherwise(F.lit(""))

        tail = F.array_join(F.slice(chars, until + 1, F.size(chars)), "")
        return F.concat(F.array_join(F.zip_with(own, before, piece), ""), tail)

    sorted_ = lambda own: F.struct(F.split(text, "").alias("chars"), own.alias("own"), _before(F.transform(own, lambda s: s["end"]), F.greatest).alias("before"))
    done = _bound(_bound(F.array_sort(spans), sorted_), cut)
    return F.when(F.size(spans) > 0, done).otherwise(text)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; ``n_chars`` follows the text."""
    base, runs, spans = (unused(docs, c) for c in ("_base", "_runs", "_spans"))
    rows = cut_lineage(scanned(docs, base, runs))
    marked = rows.withColumn(spans, F.concat(base, _found(limits(rows, runs), runs)))
    changed = marked.withColumn("text", redacted(F.col("text"), F.col(spans)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        length = F.when(F.size(spans) > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars"))
        changed = changed.withColumn("n_chars", length)
    return changed.select(docs.columns)
