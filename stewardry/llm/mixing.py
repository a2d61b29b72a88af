"""Mixing sources to target weights along a time-varying curriculum.

Every source of a mix has a weight schedule over the training time t in [0, 1],
``share * (1 + slope * (2 t - 1))``; the slopes of a mix cancel out, so the weights
sum to 1 at any time and each schedule integrates to its share. A document that
starts at fraction q of its source's tokens goes to the t at which the integral
``t + slope * (t^2 - t)`` reaches q. Sorting by t gives the training order.

Sizes are tokens of a byte-level tokenizer: bytes of the UTF-8 text plus one end token.

Defined cases: a null text counts as empty (size 1); sources compare without
case and outer blanks; a null source belongs to none; a source of the plan
without documents is reported with no tokens; equal documents are placed each;
plan rows repeated for one mix and source count once, the least by share and
repeats, and those with nulls not at all; an empty plan gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stewardry.runtime import cut


#: Rows of a plan up to which it is broadcast; a larger one is joined by shuffle.
PLAN_ROWS = 10_000


def tokens(text: str | Column = "text") -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1


def source_key(source: str | Column = "source") -> Column:
    return F.lower(F.trim(source))


def plan_with_totals(sized: DataFrame, plan: DataFrame, slope: float) -> DataFrame:
    """The plan with each source's own tokens, the mix's total, the demanded and reached tokens, passes and slope."""
    own = sized.groupBy("key").agg(F.sum("size").alias("own"))
    plan = plan.groupBy("mix_id", "source").agg(F.min(F.struct("target_share", "max_repeats")).alias("p")).select("mix_id", "source", "p.*")
    plan = plan.where(F.col("source").isNotNull() & F.col("target_share").isNotNull() & F.col("max_repeats").isNotNull()).withColumn("key", source_key())
    full = plan.join(own, "key", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    mix = Window.partitionBy("mix_id")  # a plan's few rows
    full = full.withColumn("total", F.sum("own").over(mix))
    full = full.withColumn("demand", F.col("target_share") * F.col("total")).withColumn("most", F.col("max_repeats") * F.col("own"))
    full = full.withColumn("goal", F.least("demand", F.col("most").cast("double")))
    full = full.withColumn("passes", F.when(F.col("own") > 0, F.least(F.ceil(F.col("goal") / F.col("own")), "max_repeats")).otherwise(0))
    # large sources lean to the start, small ones to the end; centred by share so that the slopes cancel out
    lean = F.when(F.col("total") > 0, 1 - F.col("own") / F.col("total")).otherwise(0.0)
    mean = F.sum(F.col("target_share") * lean).over(mix) / F.sum("target_share").over(mix)
    return full.withColumn("slope", F.lit(slope) * (lean - mean))


def place(docs: DataFrame, plan: DataFrame, slope: float = 0.8, rows_per_bucket: int = 50_000, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(placed, plan): one row (mix_id, source, doc_id, pass, tokens, position) per use of a document, and the plan with totals.

    The order of a source within a pass is pseudo-random. Its prefix sums come
    from hash buckets of bounded size: sums per bucket, offsets over buckets, and
    a running sum within one bucket, so no source is ever sorted in one task.
    """
    if not 0 <= slope <= 1:
        raise ValueError("slope must lie between 0 and 1")
    sized = docs.select("doc_id", source_key().alias("key"), tokens().alias("size"))
    counted = cut(sized.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")))
    rows = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    full = cut(plan_with_totals(counted, plan, slope))
    buckets = max(1, rows // rows_per_bucket)
    wanted = full.where(F.col("passes") > 0).select("mix_id", "source", "key", "own", "goal", "passes", "slope")
    few = full.count() <= PLAN_ROWS
    used = sized.join(F.broadcast(wanted) if few else wanted, "key")
    used = used.withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("passes").cast("int"))))
    draw = F.xxhash64(F.lit(seed), "mix_id", "pass", "doc_id")
    used = used.withColumn("draw", draw).withColumn("bucket", F.pmod(F.shiftrightunsigned("draw", 20), F.lit(buckets)).cast("int"))
    lane = ["mix_id", "source", "pass"]
    sums = used.groupBy(*lane, "bucket").agg(F.sum("size").alias("in_bucket"))
    before = Window.partitionBy(*lane).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*lane, "bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("base"))
    near = Window.partitionBy(*lane, "bucket").orderBy("draw", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    used = used.withColumn("ahead", F.coalesce(F.sum("size").over(near), F.lit(0)))
    placed = used.join(base, [*lane, "bucket"]).withColumn("start", (F.col("pass") - 1) * F.col("own") + F.col("base") + F.col("ahead"))
    # a use counts if more than half of it lies before the goal, so a source misses its goal by half a document at most
    placed = placed.where(F.col("start") + F.col("size") / 2 <= F.col("goal"))
    q, s = F.col("start") / F.col("goal"), F.col("slope")
    root = F.sqrt((1 - s) * (1 - s) + 4 * s * q)
    position = F.when(q <= 0, F.lit(0.0)).otherwise(2 * q / (1 - s + root))
    return placed.select("mix_id", "source", "doc_id", "pass", F.col("size").alias("tokens"), position.alias("position")), full


def in_order(placed: DataFrame) -> DataFrame:
    """Range-sorted by mix and position."""
    return placed.orderBy("mix_id", "position", "source", "doc_id", "pass")


def report(placed: DataFrame, full: DataFrame) -> DataFrame:
    """Per mix and source of the plan: target and actual share, tokens, uses, and whether the repeats' cap keeps it short."""
    used = placed.groupBy("mix_id", "source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("uses"), F.max("pass").alias("repeats"))
    zero = F.lit(0).cast("bigint")
    out = full.join(used, ["mix_id", "source"], "left")
    out = out.withColumn("tokens", F.coalesce("tokens", zero)).withColumn("all_tokens", F.sum("tokens").over(Window.partitionBy("mix_id")))
    share = F.when(F.col("all_tokens") > 0, F.col("tokens") / F.col("all_tokens")).otherwise(0.0)
    return out.select(
        "mix_id", "source", "target_share", share.alias("actual_share"), "tokens", F.coalesce("uses", zero).alias("uses"),
        F.coalesce(F.col("repeats"), F.lit(0)).alias("repeats"), "own", "total",
        ((F.col("tokens") == F.col("most")) & (F.col("most") < F.col("demand"))).alias("short"),  # used up and still below its demand
    )
