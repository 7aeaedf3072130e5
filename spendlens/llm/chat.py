"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions only.

A chat that is logged after every turn leaves conversations that are prefixes of longer ones. Every turn gets a hash
of its place, role and text; the XOR of the hashes of a conversation's first k turns names that prefix (128 bits).
A conversation goes if its own hash is the hash of a proper prefix of another, and of equal conversations the one of
the smallest id stays: two anti-joins over one row per distinct prefix. What is left is rendered.

Long conversations are split: turns are numbered and hashed in blocks of ``BLOCK`` turn numbers, blocks are added up
from one row each, and a rendered row holds ``BLOCK`` turns at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1024
TEMPLATE = "<|{role}|>\n{text}<|end|>\n"


def _hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("at"), F.col("role").isNull(), F.coalesce("role", F.lit("")),
                      F.col("text").isNull(), F.coalesce("text", F.lit("")))


def prefix_hashes(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                  text: str = "text") -> DataFrame:
    """(conv_id, at, role, text, n, h1, h2): every turn with its place from 1 and the hash of the prefix it ends.

    Turns are ordered by turn number (nulls first), then role, then text; ``n`` is the conversation's length. A null
    conv_id is an id like others.
    """
    rows = df.select(df[conv].alias("conv_id"), df[turn].cast("long").alias("turn"), df[role].alias("role"),
                     df[text].alias("text")).withColumn("block", F.floor(F.col("turn") / BLOCK))
    keys = ["conv_id", "block"]
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    per_block = rows.groupBy(*keys).agg(F.count("*").alias("m"))
    blocks = Window.partitionBy("conv_id").orderBy(F.col("block").asc_nulls_first())
    before = blocks.rowsBetween(Window.unboundedPreceding, -1)
    start = per_block.select(F.col("conv_id").alias("c"), F.col("block").alias("b"),
                             F.coalesce(F.sum("m").over(before), F.lit(0)).alias("first"),
                             F.sum("m").over(Window.partitionBy("conv_id")).alias("n"))
    same_block = F.col("conv_id").eqNullSafe(F.col("c")) & F.col("block").eqNullSafe(F.col("b"))
    own = Window.partitionBy(*keys).orderBy(*order)
    placed = rows.withColumn("number", F.row_number().over(own)).join(start, same_block) \
        .withColumn("at", F.col("first") + F.col("number")).drop("c", "b", "first", "number") \
        .withColumn("t1", _hash(1)).withColumn("t2", _hash(2))
    by_place = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    inside = placed.withColumn("x1", F.bit_xor("t1").over(by_place)).withColumn("x2", F.bit_xor("t2").over(by_place))
    totals = placed.groupBy(*keys).agg(F.bit_xor("t1").alias("s1"), F.bit_xor("t2").alias("s2"))
    carried = totals.select(F.col("conv_id").alias("c"), F.col("block").alias("b"),
                            F.coalesce(F.bit_xor("s1").over(before), F.lit(0)).alias("p1"),
                            F.coalesce(F.bit_xor("s2").over(before), F.lit(0)).alias("p2"))
    return inside.join(carried, same_block).select(
        "conv_id", "at", "role", "text", "n", F.expr("x1 ^ p1").alias("h1"), F.expr("x2 ^ p2").alias("h2"))


def maximal(prefixes: DataFrame) -> DataFrame:
    """conv_id of the conversations that stay: no proper prefix of another, and the smallest of equal ones.

    Nulls count as the largest id.
    """
    ends = prefixes.where("at = n").groupBy("at", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    proper = prefixes.where("at < n").select("at", "h1", "h2").distinct()
    return ends.join(proper, ["at", "h1", "h2"], "left_anti").select("conv_id")


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 template: str = TEMPLATE) -> DataFrame:
    """(conv_id, part, n_turns, rendered) of every maximal conversation: part p holds turns p * BLOCK + 1 and on.

    ``template`` renders a turn; a null role or text renders as nothing, but is another one than an empty one, so that two
    conversations that differ in this alone both stay. Repeated turns of a conversation are turns like others. An empty table gives an empty one; other columns are left out.
    """
    prefixes = prefix_hashes(df, conv, turn, role, text)
    kept = maximal(prefixes).select(F.col("conv_id").alias("kept"))
    rows = prefixes.join(kept, F.col("conv_id").eqNullSafe(F.col("kept")), "left_semi")
    pieces = [F.coalesce(F.col(p[1:-1]), F.lit("")) if p in ("{role}", "{text}") else F.lit(p)
              for p in _pieces(template)]
    turns = rows.withColumn("part", F.floor((F.col("at") - 1) / BLOCK)) \
        .withColumn("turn", F.struct("at", F.concat(*pieces).alias("text")))
    listed = F.transform(F.array_sort(F.collect_list("turn")), lambda t: t.getField("text"))
    return turns.groupBy("conv_id", "part").agg(F.count("*").alias("n_turns"), F.array_join(listed, "").alias("rendered"))


def _pieces(template: str) -> list[str]:
    import re
    return [p for p in re.split(r"(\{role\}|\{text\})", template) if p]
