"""Exact distinct counts over huge identifier sets with compressed bitmaps (zero error).

Identifiers get dense integers, the most frequent first, so that frequent ones
share words. Per group a bitmap is cut into buckets of 65,536 bits; a bucket
keeps its non-zero 64-bit words only. Bitmaps of parts of the data merge by OR,
sets of groups intersect by AND, and counting bits is the exact answer.

A dictionary is only ever extended, so that bitmaps of different days and runs merge.

Defined cases: null identifiers are never counted, and a group without any
other has no bitmap; null group values form groups of their own; repeated rows
change nothing; an empty table gives no bitmaps; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stewardry.runtime import cut

#: Bits of a word and words of a bucket, as powers of two.
WORD_BITS, BUCKET_WORDS = 6, 10
#: Identifiers whose codes are broadcast: the most frequent ones, a fixed number.
HOT = 1024

_WORDS = "array<struct<word:bigint,bits:bigint>>"


def dictionary(df: DataFrame, identifier: str) -> DataFrame:
    """(identifier, code): dense codes from 0, the most frequent identifier first, ties by identifier.

    A range sort numbers each partition by itself; the partitions' sizes (one
    number each) give the offsets. No task sees more than its own range.
    """
    counts = df.where(F.col(identifier).isNotNull()).groupBy(F.col(identifier).alias("identifier")).agg((-F.count(F.lit(1))).alias("rarity"))
    ranged = counts.repartitionByRange("rarity", "identifier").sortWithinPartitions("rarity", "identifier")
    numbered = cut(ranged.select("identifier", F.monotonically_increasing_id().alias("at")))
    part = F.shiftrightunsigned("at", 33)
    sizes = numbered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    coded = numbered.join(F.broadcast(offsets), part == F.col("part"))  # a row per shuffle partition
    return coded.select("identifier", (F.col("base") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("code"))


def extend(codes: DataFrame, df: DataFrame, identifier: str) -> DataFrame:
    """The dictionary with the identifiers of ``df`` that it lacks, behind all others: codes once given stay, so stored bitmaps go on to hold.

    Of an extended dictionary the first ``HOT`` codes are the heaviest of the first run; a new heavy identifier is left to adaptive execution.
    """
    known = df.where(F.col(identifier).isNotNull()).select(F.col(identifier).alias("identifier")).join(codes.select("identifier"), "identifier", "left_anti")
    first = codes.agg((F.coalesce(F.max("code"), F.lit(-1)) + 1).alias("first")).first()[0]
    return codes.unionByName(dictionary(known, "identifier").withColumn("code", F.col("code") + F.lit(first)))


def encode(df: DataFrame, identifier: str, codes: DataFrame) -> DataFrame:
    """Adds ``code`` to the rows with a known identifier. The ``HOT`` heaviest identifiers, which would fill
    single tasks, are looked up in a broadcast table of fixed size; no other has more than 1/HOT of the rows."""
    hot = codes.where(F.col("code") < HOT).select(F.col("identifier").alias("hot_identifier"), F.col("code").alias("hot_code"))
    marked = df.join(F.broadcast(hot), F.col(identifier) == F.col("hot_identifier"), "left").drop("hot_identifier")
    near = marked.where(F.col("hot_code").isNotNull()).withColumnRenamed("hot_code", "code")
    cold = codes.where(F.col("code") >= HOT).withColumnRenamed("identifier", "cold_identifier")
    far = marked.where(F.col("hot_code").isNull()).drop("hot_code").join(cold, F.col(identifier) == F.col("cold_identifier")).drop("cold_identifier")
    return near.select(*df.columns, "code").unionByName(far.select(*df.columns, "code"))


def _pack(words: DataFrame, groups: Sequence[str]) -> DataFrame:
    bucket = F.shiftright("word", BUCKET_WORDS).alias("bucket")
    pack = F.array_sort(F.collect_list(F.struct("word", "bits"))).cast(_WORDS)  # at most 1,024 words
    return words.groupBy(*groups, bucket).agg(pack.alias("words"))


def _unpack(bitmaps: DataFrame, groups: Sequence[str]) -> DataFrame:
    return bitmaps.select(*groups, F.explode("words").alias("w")).select(*groups, "w.word", "w.bits")


def build(df: DataFrame, groups: Sequence[str], identifier: str, codes: DataFrame) -> DataFrame:
    """(groups, bucket, words): the bitmaps of every group. Bits are set map-side before anything is shuffled."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("code").bitwiseAND(F.lit(63)).cast("int"))
    coded = encode(df.select(*groups, identifier), identifier, codes)
    words = coded.groupBy(*groups, F.shiftright("code", WORD_BITS).alias("word")).agg(F.bit_or(bit).alias("bits"))
    return _pack(words, groups)


def merge(bitmaps: DataFrame, groups: Sequence[str]) -> DataFrame:
    """OR of all bitmaps of a group, also of fewer grouping columns than before or of a union of partial results."""
    return _pack(_unpack(bitmaps, groups).groupBy(*groups, "word").agg(F.bit_or("bits").alias("bits")), groups)


def intersect(left: DataFrame, right: DataFrame, groups: Sequence[str]) -> DataFrame:
    """AND of the bitmaps of equal (non-null) groups."""
    other = _unpack(right, groups).withColumnRenamed("bits", "other")
    both = _unpack(left, groups).join(other, [*groups, "word"])
    bits = F.col("bits").bitwiseAND(F.col("other"))
    return _pack(both.select(*groups, "word", bits.alias("bits")).where(F.col("bits") != 0), groups)


def _bits(words: str) -> Column:
    return F.aggregate(words, F.lit(0).cast("bigint"), lambda total, w: total + F.bit_count(w["bits"]))


def count(bitmaps: DataFrame, groups: Sequence[str], name: str = "n_distinct") -> DataFrame:
    """The exact number of distinct identifiers of each group of merged bitmaps."""
    return bitmaps.groupBy(*groups).agg(F.sum(_bits("words")).alias(name))
