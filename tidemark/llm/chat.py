"""Preference formatting of paired conversations; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _turns(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    plain = F.coalesce(F.col(text_col), F.lit(""))
    safe = F.replace(F.replace(plain, F.lit(OPEN), F.lit("<|im_start |>")), F.lit(CLOSE), F.lit("<|im_end |>"))
    role = F.coalesce(F.col(role_col), F.lit(""))
    rendered = F.concat(F.lit(OPEN), role, F.lit("\n"), safe, F.lit(CLOSE + "\n"))
    return conversations.where(F.col(id_col).isNotNull() & F.col(turn_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), rendered.alias("rendered"))


def preference_pairs(turns: DataFrame) -> DataFrame:
    """(chosen_id, rejected_id, pairing): every conversation in a pair where there is a partner.

    ``opening``: of the conversations with an equal first turn the smallest conv_id is chosen
    over each other one, so a group of n makes n - 1 pairs. ``neighbour``: conversation 2i is
    chosen over 2i + 1. A pair of both kinds is an opening pair.
    """
    first = turns.groupBy("conv_id").agg(F.min(F.struct("turn", "rendered")).alias("f")).select("conv_id", F.sha2(F.col("f.rendered"), 256).alias("opening"))
    hub = first.groupBy("opening").agg(F.min("conv_id").alias("chosen_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    opening = first.join(hub, "opening").where("conv_id <> chosen_id").select("chosen_id", F.col("conv_id").alias("rejected_id"))
    ids = first.select("conv_id")
    even = ids.where("conv_id % 2 = 0").select(F.col("conv_id").alias("chosen_id"), (F.col("conv_id") + 1).alias("rejected_id"))
    near = even.join(ids.select(F.col("conv_id").alias("rejected_id")), "rejected_id").select("chosen_id", "rejected_id")
    both = opening.withColumn("pairing", F.lit(1)).unionAll(near.withColumn("pairing", F.lit(2)))
    return both.groupBy("chosen_id", "rejected_id").agg(F.min("pairing").alias("p")).select("chosen_id", "rejected_id", F.when(F.col("p") == 1, "opening").otherwise("neighbour").alias("pairing"))


def format_preferences(conversations: DataFrame, pairs: DataFrame | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a turn of a pair: chosen_id, rejected_id, pairing, part, turn, role, rendered, loss.

    The longest common prefix of turns of the two conversations is rendered once, as part
    ``prompt``; what follows is ``chosen`` and ``rejected``. Two turns are equal when their
    roles and texts are. In the order of ``turn`` a part's rows put together are its text;
    ``loss`` marks what a trainer learns from: assistant turns of the two completions. Markers
    inside a text are broken up. If one conversation continues the other, or both are equal,
    the shorter completion has no rows. Rows never leave turn size, so a conversation of any
    length is spread over tasks.

    ``pairs`` (chosen_id, rejected_id, pairing) is :func:`preference_pairs` if None. A turn that
    comes more than once is compared and rendered with all its rows. Null texts and roles are
    empty; rows with a null id or turn take no part; other columns are not read. An empty table
    gives an empty result.
    """
    turns = _turns(conversations, id_col, turn_col, role_col, text_col)
    pairs = preference_pairs(turns) if pairs is None else pairs.select("chosen_id", "rejected_id", "pairing")
    h = F.xxhash64("rendered")
    marks = turns.groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.sum(h.cast("decimal(20,0)")).alias("x"), F.min(F.sha2("rendered", 256)).alias("lo"), F.max(F.sha2("rendered", 256)).alias("hi")).select("conv_id", "turn", F.struct("n", "x", "lo", "hi").alias("mark"))
    one = pairs.join(marks.withColumnRenamed("conv_id", "chosen_id"), "chosen_id").select("chosen_id", "rejected_id", "turn", F.col("mark").alias("a"))
    two = pairs.join(marks.withColumnRenamed("conv_id", "rejected_id"), "rejected_id").select("chosen_id", "rejected_id", "turn", F.col("mark").alias("b"))
    sides = one.join(two, ["chosen_id", "rejected_id", "turn"], "full")
    split = sides.where(~F.col("a").eqNullSafe(F.col("b"))).groupBy("chosen_id", "rejected_id").agg(F.min("turn").alias("split"))
    cut = pairs.join(split, ["chosen_id", "rejected_id"], "left").withColumn("split", F.coalesce("split", F.lit(2**62)))
    left = cut.join(turns.withColumnRenamed("conv_id", "chosen_id"), "chosen_id").withColumn("part", F.when(F.col("turn") < F.col("split"), "prompt").otherwise("chosen"))
    right = cut.join(turns.withColumnRenamed("conv_id", "rejected_id"), "rejected_id").where("turn >= split").withColumn("part", F.lit("rejected"))
    names = ["chosen_id", "rejected_id", "pairing", "part", "turn", "role", "rendered"]
    rows = left.select(names).unionAll(right.select(names))
    return rows.withColumn("loss", (F.col("part") != "prompt") & (F.col("role") == "assistant"))
