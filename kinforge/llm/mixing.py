"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key, -ln(u) / quality weight, with u taken
from a hash of its id. Sorted by key, the documents of a source are a weighted
random order without replacement. A source's target is split into complete
epochs (all documents) and a fraction, filled from the front of that order by a
prefix sum of sizes. The sum has two levels, so no source meets in one task:
keys are cut into BUCKETS of similar probability, buckets are summed, and only
the documents of one bucket of one source are ordered together.

Defined cases: null text has size 0; null source is a source of its own, last in
order; rows of size 0 are taken 0 words; null ids draw like an empty id; repeated
rows count as often as they stand; a text of any length counts whole; an empty table
gives an empty result; other columns are carried along: repeated() takes any names,
measured() and mix() replace columns that have the names they give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
NOT_LETTERS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
BUCKETS = 4096


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_of(text: Column) -> Column:
    """1 to 4: one plus three times the share of letters among a text's code points."""
    letters = F.length(F.regexp_replace(text, NOT_LETTERS, ""))
    return 1 + 3 * F.coalesce(letters / F.nullif(F.length(text), F.lit(0)), F.lit(0.0))


def draw(doc_id: Column, seed: int) -> Column:
    """Uniform in (0, 1), from 52 bits of a hash."""
    text = F.concat(F.lit(f"{seed}|mix|"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights: tuple[int, ...], budget: float, epochs: int) -> DataFrame:
    """One row a source (__skey, source, source_size) -> with its target.

    Sources by code point (null last) weigh as weights say, in turn. The budget is
    shared by weight; a target stops at epochs times the source, and what is left is
    shared again. In order of size per weight, the stopped ones are a prefix.
    """
    order = W.orderBy(F.col("source").isNull(), "source")
    rank = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), rank + 1)
    by_need = W.orderBy(F.col("__cap") / F.col("__weight"), "__skey").rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return (
        sizes.withColumn("__weight", weight.cast("double"))
        .withColumn("__cap", (epochs * F.col("source_size")).cast("double"))
        .withColumn("__left", budget * F.sum("source_size").over(everything) - F.coalesce(F.sum("__cap").over(by_need), F.lit(0.0)))
        .withColumn("__rest", F.sum("__weight").over(everything) - F.coalesce(F.sum("__weight").over(by_need), F.lit(0.0)))
        .withColumn("__level", F.col("__left") / F.col("__rest"))
        .withColumn("__open", F.min(F.when(F.col("__cap") > F.col("__level") * F.col("__weight"), F.struct(F.col("__cap") / F.col("__weight"), F.col("__skey"), F.col("__level").alias("level")))).over(everything))
        .withColumn("target", F.when(F.col("__open").isNull(), F.col("__cap")).otherwise(F.least("__cap", F.col("__open.level") * F.col("__weight"))))
        .select("__skey", "source_size", "target")
    )


def measured(docs: DataFrame, seed: int = 42) -> DataFrame:
    """docs with __size, __key, __bucket and __skey."""
    key = -F.log(draw(F.col("doc_id"), seed)) / quality_of(F.col("text"))
    return (
        docs.withColumn("__size", size_of(F.col("text")))
        .withColumn("__key", key)
        .withColumn("__bucket", F.floor((1 - F.exp(-F.col("__key"))) * BUCKETS).cast("int"))
        .withColumn("__skey", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, epochs: int = 2) -> DataFrame:
    """measured() documents with __source_size, __target and __taken (words; repeats counted)."""
    per = docs.groupBy("__skey", "__bucket").agg(F.sum("__size").alias("__sum"), F.first("source").alias("source"))
    sizes = per.groupBy("__skey").agg(F.sum("__sum").alias("source_size"), F.first("source").alias("source"))
    before = F.coalesce(F.sum("__sum").over(W.partitionBy("__skey").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = per.withColumn("__before", before).drop("source", "__sum").join(targets(sizes, weights, budget, epochs), "__skey")
    starts = starts.withColumnsRenamed({"source_size": "__source_size", "target": "__target"})
    within = W.partitionBy("__skey", "__bucket").orderBy("__key", "doc_id", "__size").rowsBetween(W.unboundedPreceding, -1)
    whole = F.coalesce(F.floor(F.col("__target") / F.nullif("__source_size", F.lit(0))), F.lit(0)).cast("long")
    front = F.col("__before") + F.coalesce(F.sum("__size").over(within), F.lit(0))
    rest = F.col("__target") - F.col("__epochs") * F.col("__source_size")
    return (
        docs.join(starts, ["__skey", "__bucket"])
        .withColumn("__whole", whole)
        .withColumn("__epochs", F.col("__whole"))
        .withColumn("__epochs", F.col("__epochs") + F.when(2 * front + F.col("__size") < 2 * rest, 1).otherwise(0))
        .withColumn("__taken", F.col("__epochs") * F.col("__size"))
    )


ORDER = ("__bucket", "__key", "doc_id", "__size")


def ends_of(mixed: DataFrame, scratch: Scratch) -> DataFrame:
    """One row a source: how often all its documents are taken (__all), the last document in ORDER that is taken once more
    (__cut), how many like it are (__some) and how many there are (__alike). What is taken once more is a prefix of
    the order, since a prefix sum and half a size never fall along it."""
    mixed = scratch.keep(mixed.select("__skey", *ORDER, "__epochs", "__whole"), "mixed")
    all_ = mixed.groupBy("__skey").agg(F.max("__whole").alias("__all"))
    place = F.struct(*ORDER)
    more = mixed.where("__epochs > __whole").groupBy("__skey").agg(F.max(place).alias("__cut"))
    ends = scratch.keep(all_.join(more, "__skey", "left"), "ends")
    alike = mixed.join(ends.where("__cut is not null").drop("__all"), "__skey").where(place == F.col("__cut")).groupBy("__skey").agg(F.count_if(F.col("__epochs") > F.col("__whole")).alias("__some"), F.count("*").alias("__alike"))
    return scratch.keep(ends.join(alike, "__skey", "left"), "cuts")


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken; columns as given. Texts are measured once, beside which they
    are written; the mix is made from the measures alone, and its ends, one row a source, filter the written table."""
    scratch = Scratch(docs.sparkSession, "mixing")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    held = scratch.keep(measured(docs.select("doc_id", "text", "source", row)).drop("text"), "measured")
    ends = ends_of(mix(held.drop("__row"), **options), scratch)
    found = held.join(ends, "__skey")
    place, cut = F.struct(*ORDER), F.col("__cut")
    taken = found.withColumn("__n", F.col("__all") + F.when(cut.isNotNull() & (place <= cut), 1).otherwise(0))
    if not ends.where("__some < __alike").isEmpty():
        # copies of a source's last document, of which only some are taken
        at_cut = cut.isNotNull() & (place == cut) & (F.col("__some") < F.col("__alike"))
        number = F.row_number().over(W.partitionBy("__skey").orderBy(F.xxhash64("__row")))
        some = taken.where(at_cut).withColumn("__n", F.col("__all") + F.when(number <= F.col("__some"), 1).otherwise(0))
        taken = taken.where(~F.coalesce(at_cut, F.lit(False))).unionByName(some)
    return taken.where("__n > 0 and __size > 0").withColumn("__n", F.explode(F.sequence(F.lit(1).cast("long"), "__n"))).select("__row.*")
