"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

Templates are a table ``(license, text)``. Words are lower-cased runs of letters and digits, shingles five of them, compared by 64-bit
fingerprints. A template with ``s`` distinct
shingles is of class ``k`` with ``2**(k-1) < s <= 2**k``; for a class the text is cut in windows of
``2 * 2**k`` shingles, one every ``2**k``, so any run as long as the template lies in one window. A window
that contains three quarters of a template has a similarity of 0.18 or more with it, and one of
``BANDS`` single-row bands then agrees with a probability of 0.999; a template found whole has 0.25 or
more (0.99999). What the bands retrieve is verified by the share of the template's shingles in the window.

Windows without any shingle of a template of their class contain nothing of it and are not hashed, which loses nothing.

Versions and relatives of a license share most of their wording. Templates that share half the shingles of the smaller one are
siblings; where windows of siblings overlap in a document, only the best contained one stays. A template that is a part of another one
does not displace it.

Everything is DataFrame expressions. Templates go through in batches of ``LIMIT`` shingles, whose fingerprints are literals of the plan.
Null and short texts match nothing, and texts of any length are read whole. Repeated rows of an id are found once; matches in rows without
an id come under a null id. Empty tables give an empty result; templates shorter than a shingle match nothing; extra columns are ignored.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.llm.license_texts import TEXTS
from kerbline.session import cut_lineage

SHINGLE = 5
BANDS = 36
#: Share of a template's shingles, and of the smaller one of two siblings, in hundredths.
NEED, SIBLING = 75, 50
#: Shingles of the templates of one pass over the documents.
LIMIT = 1 << 14
WORD = r"[\p{L}\p{N}]+"
FOUND = "doc_id long, license string, containment double, start_word long, end_word long"


def shingles_of(text: str) -> list[str]:
    """Distinct shingles of a template (ASCII words), in order."""
    words = re.findall("[a-z0-9]+", text.lower())
    return list(dict.fromkeys(" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)))


def class_of(size: int) -> int:
    return max(0, (size - 1).bit_length())


def templates_frame(spark: SparkSession, texts: dict[str, str] = TEXTS) -> DataFrame:
    return spark.createDataFrame(sorted(texts.items()), "license string, text string")


def _shingled(text: Column) -> Column:
    """An array of one: the fingerprints of a text's shingles; empty where it has none."""
    words = F.regexp_extract_all(F.lower(text.cast("string")), F.lit(WORD), F.lit(0))
    kept = F.filter(F.array(words), lambda w: F.size(w) >= SHINGLE)

    def prints(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - SHINGLE)
        return F.transform(places, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(SHINGLE)]))

    return F.transform(kept, prints)


def _hash(j: int):
    return lambda s: F.xxhash64(s, F.lit(j))


def _bands(shingles: Column) -> Column:
    """The least hash of the shingles under each hash function."""
    # An array of one binds the distinct shingles, so they are found once.
    once = F.array(F.array_distinct(shingles))
    return F.transform(once, lambda u: F.array(*[F.array_min(F.transform(u, _hash(j))) for j in range(BANDS)]))[0]


def known_templates(templates: DataFrame) -> DataFrame:
    """``(license, k, shingles)``, written; texts of one license are templates of one name."""
    own = templates.select("license", F.explode(_shingled(F.col("text"))).alias("s")).select("license", F.array_distinct("s").alias("shingles"))
    return cut_lineage(own.withColumn("k", F.ceil(F.log2(F.size("shingles"))).cast("int")))


def siblings(known: DataFrame) -> DataFrame:
    """Pairs ``(license, other)`` of which the other one may displace the first; a mere part of it may not."""
    sizes = known.withColumn("size", F.size("shingles"))
    a = sizes.select("license", "size", F.explode("shingles").alias("s"))
    b = sizes.select(F.col("license").alias("other"), F.col("size").alias("other_size"), F.explode("shingles").alias("s"))
    shared = a.join(b, "s").filter("license <> other").groupBy("license", "other", "size", "other_size").agg(F.countDistinct("s").alias("n"))
    near = (100 * F.col("n") >= SIBLING * F.least("size", "other_size")) & (F.col("n") < F.col("other_size"))
    return shared.filter(near).select("license", "other").distinct()


def _batches(known: DataFrame) -> list[list[str]]:
    """Names of licenses whose templates have ``LIMIT`` shingles together, or a single one with more."""
    out, held = [], LIMIT + 1
    for r in known.groupBy("license").agg(F.sum(F.size("shingles")).alias("n")).orderBy("license").collect():  # a row per license
        if held + r["n"] > LIMIT:
            out.append([])
            held = 0
        out[-1].append(r["license"])
        held += r["n"]
    return out


def _scanned(documents: DataFrame, known: DataFrame) -> DataFrame:
    """The best window of each template of a batch in each document."""
    by_class = {r["k"]: r["all"] for r in known.groupBy("k").agg(F.array_distinct(F.flatten(F.collect_list("shingles"))).alias("all")).collect()}
    every = sorted({s for some in by_class.values() for s in some})
    shingled = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(_shingled(F.col("text"))).alias("shingles"))
    at = F.transform("shingles", lambda s, i: F.when(s.isin(every), F.struct(s.alias("s"), i.alias("i"))))
    hopeful = shingled.withColumn("hits", F.filter(at, lambda h: h.isNotNull())).filter(F.size("hits") > 0)

    def windows(k: int, of_class: list[int]) -> Column:
        """Numbers of the windows of a class that hold a shingle of one of its templates."""
        held = F.transform(F.filter("hits", lambda h: h["s"].isin(of_class)), lambda h: F.floor(h["i"] / 2**k).cast("int"))
        both = F.array_distinct(F.flatten(F.transform(held, lambda w: F.array(w, F.greatest(w - 1, F.lit(0))))))
        return F.transform(both, lambda w: F.struct(F.lit(k).alias("k"), w.alias("number")))

    numbers = F.concat(*[windows(k, some) for k, some in sorted(by_class.items())])
    each = hopeful.select("doc_id", "shingles", F.explode(numbers).alias("w"))
    width = F.pow(F.lit(2), F.col("w.k")).cast("int")
    start = F.col("w.number") * width
    cut = each.select("doc_id", F.col("w.k").alias("k"), start.alias("start"), F.slice("shingles", start + 1, 2 * width).alias("inside"))
    left = cut.withColumn("bands", _bands(F.col("inside"))).select("doc_id", "k", "start", "inside", F.posexplode("bands").alias("band", "least"))
    right = known.select("license", "k", "shingles", F.posexplode(_bands(F.col("shingles"))).alias("band", "least"))
    met = left.join(right, ["k", "band", "least"])
    share = F.size(F.array_intersect("shingles", "inside")) / F.size("shingles")
    checked = met.select("doc_id", "license", "start", share.alias("containment"), F.size("inside").alias("length"))
    held = checked.filter(F.col("containment") >= NEED / 100)
    first = F.min(F.struct((-F.col("containment")).alias("order"), "start", "length")).alias("best")
    best = held.groupBy("doc_id", "license").agg(first)
    return best.select(
        "doc_id",
        "license",
        (-F.col("best.order")).alias("containment"),
        F.col("best.start").cast("long").alias("start_word"),
        (F.col("best.start") + F.col("best.length") + SHINGLE - 1).cast("long").alias("end_word"),
    )


def matches(documents: DataFrame, templates: DataFrame) -> DataFrame:
    """``(doc_id, license, containment, start_word, end_word)``: the best window of each template in a document, siblings settled."""
    known = known_templates(templates.select(F.col("license").cast("string").alias("license"), "text").filter("license is not null"))
    parts = [_scanned(documents, known.filter(F.col("license").isin(names))) for names in _batches(known)]
    if not parts:
        return documents.sparkSession.createDataFrame([], FOUND)
    best = cut_lineage(reduce(DataFrame.unionByName, parts))
    other = best.select(*[F.col(c).alias(f"o_{c}") for c in best.columns])
    related = best.join(siblings(known), "license").join(other, (F.col("other") == F.col("o_license")) & F.col("doc_id").eqNullSafe(F.col("o_doc_id")))
    beaten = related.filter("start_word < o_end_word and o_start_word < end_word and o_containment > containment")
    beaten = beaten.select(F.col("doc_id").alias("b_doc_id"), F.col("license").alias("b_license")).distinct()
    return best.join(beaten, F.col("doc_id").eqNullSafe(F.col("b_doc_id")) & (F.col("license") == F.col("b_license")), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), templates_frame(spark))


def oracle() -> str:
    """Exact containment of every template in every window, by joins on all shingles."""
    rows = ", ".join(f"('{name}', {class_of(len(own))}, {len(own)}, '{s}')" for name, text in TEXTS.items() if (own := shingles_of(text)) for s in own)
    return f"""
    with template(license, k, size, shingle) as (values {rows}),
    sibling as (
      select a.license, b.license as other from template a join template b using (shingle) where a.license <> b.license
      group by a.license, b.license, a.size, b.size
      having 100 * count(*) >= {SIBLING} * least(a.size, b.size) and count(*) < b.size),
    texts as (select doc_id, regexp_extract_all(lower(text), '{WORD}') as w from documents),
    shingles as (
      select doc_id, len(w) - {SHINGLE - 1} as n, unnest(range(0, len(w) - {SHINGLE - 1})) as i, w from texts where len(w) >= {SHINGLE}),
    hit as (
      select s.doc_id, s.n, s.i, t.* from (select doc_id, n, i, array_to_string(w[i + 1 : i + {SHINGLE}], ' ') as shingle from shingles) s
      join template t using (shingle)),
    placed as (
      select *, greatest(i // (1 << k) - d, 0) as number from hit, (values (0), (1)) as both_(d)),
    held as (
      select doc_id, license, k, n, number, count(distinct shingle) / size as containment
      from placed group by doc_id, license, k, n, size, number),
    ranked as (
      select *, row_number() over (partition by doc_id, license order by containment desc, number) as place
      from held where containment >= {NEED / 100}),
    best as (
      select doc_id, license, containment, number * (1 << k) as start_word,
        number * (1 << k) + least(2 * (1 << k), n - number * (1 << k)) + {SHINGLE - 1} as end_word
      from ranked where place = 1)
    select * from best a where not exists (
      select 1 from best b join sibling s on s.other = b.license
      where s.license = a.license and a.doc_id = b.doc_id and a.start_word < b.end_word and b.start_word < a.end_word and b.containment > a.containment)"""
