"""Chat formatting with collapse of cumulative snapshots. DataFrame operations only.

A chat client that logs the whole conversation after each turn leaves snapshots that are prefixes of a longer one.
Every turn gets a hash of its place, role and text; running sums of the hashes along a conversation are rolling hashes
of its prefixes (four lanes of 32 bits, 128 bits in all). A conversation whose hash is that of a proper prefix of
another one goes, by an anti-join; of equal conversations the one of the smallest id stays. The rest are rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LANES = ("a", "b", "c", "d")


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each maximal conversation: id, n_turns, n_chars, rendered.

    Turns are in the order of turn, role, text; null roles and texts count as empty, null turns come first, and turns
    of null id are one conversation. Equal rows are turns of their own. Each turn is rendered as <|role|>, a line
    break, its text and a line break. Turns of equal number, hot first turns and thousands of equal conversations
    change nothing in the plan: conversations are hashed by id, prefixes by their hash and counted before they move.
    An empty table gives an empty table. Other columns are not read.
    """
    role, text = F.coalesce(role_col, F.lit("")), F.coalesce(text_col, F.lit(""))
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    ordered = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    # rolling hashes need no texts, so those stay out of the sort
    hashed = rows.select("conv", "turn", "role", "text", F.xxhash64("role", "text").alias("x"), F.xxhash64("text", F.lit(1), "role").alias("y"))
    placed = hashed.select("conv", F.row_number().over(ordered).alias("n"), "x", "y")
    low = lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF))
    high = lambda c: F.shiftrightunsigned(c, 32)
    x, y = F.xxhash64("n", "x", "y"), F.xxhash64("y", "n", "x")
    lanes = placed.select("conv", "n", low(x).alias("a"), high(x).alias("b"), low(y).alias("c"), high(y).alias("d"))
    along = Window.partitionBy("conv").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    whole = F.count("*").over(Window.partitionBy("conv"))
    prefixes = lanes.select("conv", "n", *[F.sum(c).over(along).alias(c) for c in LANES], whole.alias("of"))

    full = prefixes.where("n = of").groupBy("n", *LANES).agg(F.min(F.struct("conv")).alias("kept"))
    proper = prefixes.where("n < of").select("n", *LANES).distinct()
    kept = full.join(proper, ["n", *LANES], "left_anti").select("kept.conv", F.lit(True).alias("stays"))

    said = rows.join(kept.withColumnRenamed("conv", "conv2"), F.col("conv").eqNullSafe(F.col("conv2")))
    turn = F.struct(F.col("turn").isNotNull().alias("o"), "turn", "role", "text")
    chats = said.groupBy("conv").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    rendered = F.array_join(F.transform("t", lambda t: F.concat(F.lit("<|"), t.role, F.lit("|>\n"), t.text, F.lit("\n"))), "")
    return chats.select(F.col("conv").alias(conv_col), F.size("t").cast("long").alias("n_turns"), F.length(rendered).cast("long").alias("n_chars"), rendered.alias("rendered"))
