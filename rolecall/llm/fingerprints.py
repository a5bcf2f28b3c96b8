"""Operator 4, document fingerprints (I-Match): hashes of a document's terms in several random lexicon subsets."""

from __future__ import annotations

from dataclasses import dataclass
from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolecall.llm.common import stage, table
from rolecall.llm.registry import query

#: The band: terms that between a 500th and a fifth of all documents hold, so idf between ln 5 and ln 500.
LEAST_SHARE, MOST_SHARE, LEAST_DOCUMENTS = 1 / 500, 1 / 5, 2
#: Random lexicon subsets: (bits of the term's hash from, values those bits can take, subsets used).
#: A subset of rate 1/8 tells apart short texts, one of rate 1/512 texts of thousands of terms.
SUBSETS = ((8, 8, 8), (16, 64, 16), (32, 512, 16))
FIRST_ID = -(1 << 63)


def term_hashes(text: Column) -> Column:
    """Hashes of the distinct terms: runs of letters, digits and marks, in lower case."""
    terms = F.filter(F.split(F.lower(text), r"[\s\p{P}\p{S}\p{C}]+"), lambda t: t != "")
    return F.array_distinct(F.transform(terms, lambda t: F.xxhash64(t)))


@dataclass
class Lexicon:
    """The band's terms as hash buckets in one value of one row.

    Its size has a bound that does not grow with the corpus: each term is in at least
    ``LEAST_SHARE`` of the documents, so there are at most (mean distinct terms a document) /
    ``LEAST_SHARE`` terms.
    """

    one_row: DataFrame
    size: int

    def beside(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the lexicon in column ``_lexicon``, for ``only``; it is a constant, not data of a row."""
        return rows.withColumn("_lexicon", self.one_row.scalar())

    def only(self, hashes: Column) -> Column:
        at = lambda h: F.get(F.col("_lexicon"), F.pmod(h, F.lit(self.size)).cast("int"))
        return F.filter(hashes, lambda h: F.array_contains(at(h), h))


def lexicon(texts: DataFrame, text: str) -> Lexicon:
    """Document frequencies over all of ``texts``, and the terms inside the band."""
    n = texts.count()
    frequency = texts.select(F.explode(term_hashes(F.col(text))).alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    low = max(LEAST_DOCUMENTS, n * LEAST_SHARE)
    band = frequency.where((F.col("df") >= low) & (F.col("df") <= max(low, n * MOST_SHARE))).select("h")
    spark = texts.sparkSession
    band = stage(band, "lexicon")
    size = max(1, band.count())
    full = band.groupBy(F.pmod("h", F.lit(size)).alias("b")).agg(F.collect_list("h").alias("hs"))
    every = spark.range(size).select(F.col("id").alias("b")).join(full, "b", "left")
    listed = F.array_sort(F.collect_list(F.struct("b", F.coalesce("hs", F.array().cast("array<bigint>")).alias("hs"))))
    one_row = every.agg(F.transform(listed, lambda x: x["hs"]).alias("buckets"))
    return Lexicon(one_row, size)


def let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` refers to it."""
    return F.transform(F.array(value), use)[0]


def parts(text: Column, terms: Column) -> Column:
    """One hash per lexicon subset from sorted ``terms``, null where the text has none of the subset's.

    The first part is that of the whole lexicon; a text without any term of it has the hash of
    itself there, so equal texts are always alike and others are not for want of terms.
    """
    short = lambda value: F.xxhash64(value).bitwiseAND(F.lit(0xFFFFFFFF))

    def level(terms: Column, first_bit: int, values: int, used: int) -> Column:
        which = lambda t: F.shiftrightunsigned(t, first_bit).bitwiseAND(F.lit(values - 1))
        of = lambda own, k: F.filter(own, lambda t: which(t) == k)
        hashed = lambda own: F.when(F.size(own) > 0, short(own))
        numbers = F.sequence(F.lit(0).cast("long"), F.lit(used - 1).cast("long"))
        kept = F.filter(terms, lambda t: which(t) < used) if used < values else terms
        return let(kept, lambda own: F.transform(numbers, lambda k: let(of(own, k), hashed)))

    whole = lambda terms: F.array(F.when(F.size(terms) > 0, short(terms)).otherwise(short(text)))
    return let(terms, lambda terms: F.concat(whole(terms), *[level(terms, *s) for s in SUBSETS]))


def printed(parts: Column) -> Column:
    """A fingerprint as text: eight hex digits a part, ``-`` for a part without terms."""
    digits = lambda p: F.coalesce(F.lower(F.lpad(F.hex(p), 8, "0")), F.lit("-"))
    return F.array_join(F.transform(parts, digits), ".")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal parts among those that are not empty in both."""
    told = F.zip_with(a, b, lambda x, y: F.when(x.isNotNull() | y.isNotNull(), F.coalesce((x == y).cast("int"), F.lit(0))))
    return let(F.filter(told, lambda p: p.isNotNull()), lambda p: F.aggregate(p, F.lit(0), lambda n, x: n + x) / F.size(p))


def with_next(rows: DataFrame, id_col: str, order_by: list[Column], carried: list[str]) -> DataFrame:
    """Add ``next_<column>`` of the following row in falling ``id_col``; after the last row comes the first.

    Ids are cut into ranges at sampled ids; a range also gets a copy of the first rows of the range
    below, so each range is a window of its own and rows are shuffled once. Rows of one id share a
    range, in ``order_by``.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4
    steps = F.array(*[F.lit(k / n) for k in range(1, n)])
    sampled, top = rows.agg(F.percentile_approx(id_col, steps, 100 * n), F.max(id_col)).first()
    bounds = sorted({*(sampled or []), *([] if top is None else [top])})
    if not bounds:
        return rows.select("*", *[F.col(c).alias(f"next_{c}") for c in carried])
    every = F.array(*[F.lit(b).cast("long") for b in bounds])
    width = isqrt(len(bounds)) + 1
    coarse = F.array(*[F.lit(b).cast("long") for b in bounds[width - 1 :: width]])
    below = lambda values: F.size(F.filter(values, lambda b: b < F.col(id_col)))
    skipped = (below(coarse) * width).cast("int")
    rng = skipped + below(F.slice(every, skipped + 1, width))
    is_bound = F.get(every, F.col("_range")) == F.col(id_col)
    last = len(bounds) - 1
    copy = F.when(is_bound & (F.col("_range") < last), F.col("_range") + 1).when(is_bound, 0)
    dealt = rows.withColumn("_range", rng.cast("int")).withColumn(
        "_to", F.explode(F.filter(F.array(
            F.struct(F.col("_range").alias("range"), F.lit(0).alias("copy")),
            F.struct(copy.cast("int").alias("range"), F.when(F.col("_range") == last, 2).otherwise(1).alias("copy")),
        ), lambda to: to["range"].isNotNull()))
    )
    order = Window.partitionBy("_to.range").orderBy(
        F.when(F.col("_to.copy") == 2, 1).otherwise(0), F.col(id_col).desc(), F.col("_to.copy").desc(), *order_by
    )
    follows = [F.lead(c).over(order).alias(f"next_{c}") for c in carried]
    return dealt.select(*rows.columns, "_to", *follows).where("_to.copy = 0").drop("_to")


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document beside its edited text: ``doc_id, text, edited, parts, edited_parts, next_parts``.

    The edited text is the text with its last half, rounded down, replaced by as many first
    characters of the next document in falling id (all, if it has fewer). Null texts are empty, rows
    without id come last, and rows of one id are in order of their text's hash. Other columns are
    ignored. A table of one row has itself as next; an empty table stays empty.
    """
    texts = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    terms = lexicon(texts, "text")
    fingerprint = lambda c: parts(F.col(c), F.array_sort(terms.only(term_hashes(F.col(c)))))
    own = terms.beside(texts).select(
        "doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_ID)).alias("_id"),
        "text", F.xxhash64("text").alias("_hash"), fingerprint("text").alias("parts"),
    )
    paired = with_next(own, "_id", [F.col("_hash"), F.col("text")], ["text", "parts"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    return terms.beside(paired.withColumn("edited", edited)).select(
        "doc_id", "text", "edited", "parts", fingerprint("edited").alias("edited_parts"), "next_parts"
    )


@query("op4_fingerprints")
def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edited_fingerprints(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        printed(F.col("parts")).alias("fingerprint"),
        printed(F.col("edited_parts")).alias("edited_fingerprint"),
        likeness(F.col("parts"), F.col("edited_parts")).alias("near_edited"),
        likeness(F.col("parts"), F.col("next_parts")).alias("near_next"),
    )
