"""Chat formatting: logged conversations that are prefixes of longer ones are dropped, the rest is rendered. DataFrame operations only.

A log often holds every state of a growing conversation. Each turn gets a hash of its place, role and text; the xor of
the hashes up to a turn stands for that prefix. A conversation goes if its whole hash is a proper prefix of another
one's; of conversations with the same turns the smallest ``conv_id`` stays. Hashes have 128 bits.

Turns are ordered by ``turn`` (null first), then role and text; equal rows of one conversation count once. A null role
or text is an empty one. Rows with a null ``conv_id`` belong to no conversation and are left out. Runs of ``SPAN``
turns are the unit of work, so that a conversation of any length is never ordered or rendered in one task; a rendered
conversation has one row per ``SPAN`` turn numbers that it uses (``part`` from 0), which is one row for all but giant ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPAN = 512

# The marks around a rendered turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def ordered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, run, pos, role, text): distinct turns, numbered from 1 within their conversation."""
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    rows = rows.withColumn("run", F.coalesce(F.floor(F.col("turn") / SPAN), F.lit(-(2 ** 62))))
    sizes = rows.groupBy("conv_id", "run").agg(F.count("*").alias("size"))
    before = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("conv_id", "run", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    inner = F.row_number().over(Window.partitionBy("conv_id", "run").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    return rows.withColumn("at", inner).join(offsets, ["conv_id", "run"]).select("conv_id", "run", (F.col("offset") + F.col("at")).alias("pos"), "role", "text")


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, high, low, last) of ordered turns: the hash of each prefix, and whether it is the whole conversation."""
    marked = turns.select("conv_id", "run", "pos", F.xxhash64("pos", "role", "text").alias("a"), F.xxhash64(F.lit("second"), "text", "role", "pos").alias("b"))
    runs = marked.groupBy("conv_id", "run").agg(F.bit_xor("a").alias("run_a"), F.bit_xor("b").alias("run_b"))
    before = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    starts = runs.select("conv_id", "run", F.coalesce(F.bit_xor("run_a").over(before), zero).alias("start_a"), F.coalesce(F.bit_xor("run_b").over(before), zero).alias("start_b"),
                         (F.lead("run").over(Window.partitionBy("conv_id").orderBy("run")).isNull()).alias("last_run"))
    upto = Window.partitionBy("conv_id", "run").orderBy("pos")
    rolled = marked.select("conv_id", "run", "pos", F.bit_xor("a").over(upto).alias("a"), F.bit_xor("b").over(upto).alias("b"), F.lead("pos").over(upto).isNull().alias("end"))
    return rolled.join(starts, ["conv_id", "run"]).select(
        "conv_id", "pos", F.col("a").bitwiseXOR(F.col("start_a")).alias("high"), F.col("b").bitwiseXOR(F.col("start_b")).alias("low"), (F.col("end") & F.col("last_run")).alias("last"))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_same) of the conversations that stay; ``n_same`` counts those with the same turns."""
    hashes = prefix_hashes(turns)
    whole = hashes.where("last").groupBy("pos", "high", "low").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_same"))
    proper = hashes.where("NOT last").select("pos", "high", "low").distinct()
    return whole.join(proper, ["pos", "high", "low"], "left_anti").select("conv_id", F.col("pos").alias("n_turns"), "n_same")


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, n_turns, n_same, rendered) of the maximal conversations."""
    turns = ordered_turns(conversations)
    kept = maximal_conversations(turns).withColumnRenamed("conv_id", "kept_id")
    line = F.concat(F.lit(OPEN), "role", F.lit("\n"), "text", F.lit(CLOSE))
    rows = turns.join(kept, F.col("conv_id") == F.col("kept_id")).groupBy("conv_id", "run", "n_turns", "n_same").agg(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))).alias("lines"))
    part = F.row_number().over(Window.partitionBy("conv_id").orderBy("run")) - 1
    return rows.select("conv_id", part.alias("part"), "n_turns", "n_same", F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("rendered"))
