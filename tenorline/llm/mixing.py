"""Mixing sources to target weights by capped water-filling.

A source may be repeated ``epochs`` times at most. Its target is its share of the mix by weight; sources whose share is
above their cap are clamped, and what they leave is shared by weight among the rest until no share is above a cap.
The mix takes a source whole as often as its target allows, and then documents in seeded hash order as long as they fit
into the rest of the target, so that every document is taken floor or ceil of the source's epochs.

Defined cases: a null text has size 0; a null source is a source of its own, ordered last; documents of size 0 are
drawn like others but count no words; equal rows are drawn one by one; a null ``doc_id`` is drawn by its text; with no
words at all every target is 0. Other columns are ignored, or carried along by ``mixed_documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenorline.llm.runtime import broadcast_if_small, cut

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = "mix-1"
ROUNDS = 3  # after the first, what the document at the cut left open is filled with smaller ones
BIN_DIGITS = 3  # hexadecimal digits of the hash that make a bin
WIDE = "decimal(38,0)"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target) of rows (source, size). The targets together are the sum of all sizes.

    In the order of cap over weight the clamped sources come first, so one running sum gives the level at which the rest is shared.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = totals.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(place - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    capped = ranked.withColumn("cap", F.col("source_size") * epochs)
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    left = (capped.withColumn("rest", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(by_ratio), F.lit(0)))
            .withColumn("rest_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0))))
    over = F.col("cap").cast(WIDE) * F.col("rest_weight").cast("decimal(18,0)") < F.col("rest").cast(WIDE) * F.col("weight").cast("decimal(18,0)")
    level = left.withColumn("clamped", over)
    first = F.min(F.when(~F.col("clamped"), F.struct("rest_weight_desc", "rest", "rest_weight"))).over(every)
    level = level.withColumn("rest_weight_desc", -F.col("rest_weight")).withColumn("at", first)
    share = F.col("at.rest").cast("double") * F.col("weight") / F.col("at.rest_weight")
    target = F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(share)
    return level.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def drawn(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: str = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, times per row of ``docs``, besides the columns ``keep`` in ``kept``."""
    text = F.coalesce("text", F.lit(""))
    name = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text))
    sized = docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORDS)).cast("long").alias("size"), F.md5(name).alias("draw"), *[F.struct(*keep).alias("kept")] if keep else [])
    rows = cut(sized, "mix-sizes") if not keep else sized
    skinny = rows.select("doc_id", "source", "size", "draw")
    targets = cut(source_targets(skinny, weights, epochs), "mix-targets")
    plan = targets.select(F.col("source").alias("of"), "source_size", "target", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).alias("whole"))
    plan = broadcast_if_small(plan.withColumn("quota", F.col("target") - F.col("whole") * F.col("source_size")))
    planned = skinny.join(plan, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("extra", F.lit(False))
    for _ in range(ROUNDS):
        planned = cut(_take(planned), "mix-round")
    out = ["doc_id", "size", "source_size", "target", (F.col("whole") + F.col("extra").cast("int")).cast("int").alias("times")]
    if not keep:
        return planned.select(*out)
    # rows with equal id, text and source share a draw; they are told apart by counting, so each gets its own number of times
    same = planned.groupBy("doc_id", "draw", "source").agg(F.first("whole").alias("whole"), F.sum(F.col("extra").cast("int")).alias("extras"), F.count("*").alias("rows"))
    joined = rows.alias("r").join(same.alias("s"), F.col("r.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("r.draw") == F.col("s.draw")) & F.col("r.source").eqNullSafe(F.col("s.source")))
    return joined.select("r.kept", "r.doc_id", "r.draw", "r.source", "s.whole", "s.extras", "s.rows")


def _take(rows: DataFrame) -> DataFrame:
    """Marks as ``extra`` the rows, in hash order, that still fit into what is left of their source's quota.

    The order of a source is cut into bins of the hash. Sums per bin tell in which bin the drawing ends; only the rows of
    that bin are ordered one by one, so no task orders a source.
    """
    used = rows.groupBy("source").agg(F.sum(F.when(F.col("extra"), F.col("size")).otherwise(0)).alias("used")).withColumnRenamed("source", "of")
    rows = rows.join(broadcast_if_small(cut(used, "mix-used")), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rows = rows.withColumn("left", F.col("quota") - F.col("used")).withColumn("bin", F.substring("draw", 1, BIN_DIGITS))
    rows = rows.withColumn("open", ~F.col("extra") & (F.col("size") <= F.col("left"))).drop("used")
    before = Window.partitionBy("of").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    bins = rows.where("open").groupBy(F.col("source").alias("of"), F.col("bin").alias("at"), "left").agg(F.sum("size").alias("bin_size"))
    placed = cut(bins.withColumn("before", F.coalesce(F.sum("bin_size").over(before), F.lit(0))).select("of", "at", "before", (F.col("before") + F.col("bin_size") <= F.col("left")).alias("whole_bin")), "mix-bins")
    rows = rows.join(broadcast_if_small(placed), F.col("source").eqNullSafe(F.col("of")) & (F.col("bin") == F.col("at")) & F.col("open"), "left").drop("of", "at")
    edge = F.coalesce(F.col("open") & ~F.col("whole_bin") & (F.col("before") < F.col("left")), F.lit(False))
    inner = Window.partitionBy("source", "bin").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    sure = rows.where(~edge).withColumn("extra", F.col("extra") | F.coalesce(F.col("whole_bin"), F.lit(False)))
    last = rows.where(edge).withColumn("extra", F.col("before") + F.sum("size").over(inner) <= F.col("left"))
    return sure.unionByName(last).drop("left", "bin", "open", "before", "whole_bin")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes, repeats counted) per row of ``docs``."""
    rows = drawn(docs, weights, epochs, seed)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    rows = drawn(docs, weights, epochs, seed, keep=tuple(docs.columns))
    # extras are dealt over equal rows as evenly as whole numbers allow; equal rows are interchangeable
    single = rows.where("rows = 1").withColumn("times", F.col("whole") + F.col("extras"))
    place = F.row_number().over(Window.partitionBy("doc_id", "draw", "source").orderBy(F.lit(0)))
    several = rows.where("rows > 1").withColumn("times", F.col("whole") + (place <= F.col("extras")).cast("int"))
    both = single.unionByName(several).where("times > 0")
    return both.select("kept", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("kept.*")
