"""Shards by balanced label propagation: linked documents move towards their neighbours' shards under quotas.

Links come as groups: all members of a group are neighbours (a link of two is a group of two), so the neighbours of a
document are counted from one row per group and shard, never from pairs. Each round, every linked document asks for
the open shard that holds most of its group, itself included (of equal ones, the members of a group ask for the
same); a shard admits what its quota leaves room for, whole groups at a time. A group that is itself large against
the quota is admitted by the row and may push out smaller ones, so one beyond a shard fills one shard after the other.
Documents without links have no wish and are the ones that level the shards out in the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .work import drop, offsets, spread, store, stored

SHARDS = 8
ROUNDS = 12
LUMP = 0.01
ADMIT = 0.97


def _unit(*cols) -> Column:
    """A number from [0, 1) that depends on the columns only."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / F.lit(float(1 << 40))


def propagate(members: DataFrame, quotas: list[int], rounds: int = ROUNDS) -> DataFrame:
    """(node, shard) for the nodes of ``members`` (node, group_id, in groups of two or more).

    ``quotas``: the most nodes of every shard. The driver sees counts per shard only; the nodes and their shards are
    written to the shared folder once a round.
    """
    spark, shards = members.sparkSession, len(quotas)
    members, _ = store(members.select("node", "group_id").distinct(), "members")
    sizes = members.groupBy("group_id").agg(F.count("*").alias("size"))
    start = F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int").alias("shard")
    now, path = store(members.select("node").distinct().select("node", start), "shards")
    big = (F.col("size") > LUMP * min(quotas)).alias("big")
    for turn in range(rounds):
        at_group = members.join(now, "node").join(sizes, "group_id")
        inside = at_group.groupBy("group_id", "size", "shard").agg(F.count("*").alias("n"))
        per_group = inside.groupBy("group_id", "size") \
            .agg(F.map_from_entries(F.collect_list(F.struct("shard", "n"))).alias("at"))
        counts = [F.sum(F.coalesce(F.element_at("at", F.lit(s)), F.lit(0))).alias(f"c{s}") for s in range(shards)]
        seen, seen_path = store(members.join(per_group, "group_id").groupBy("node")
                                .agg(*counts, F.min("group_id").alias("lead"), F.max("size").alias("size"))
                                .join(now, "node").withColumn("big", big), "seen")
        held = {(r["shard"], r["big"]): r["n"] for r in seen.groupBy("shard", "big").agg(F.count("*").alias("n")).collect()}
        of_big = [held.get((s, True), 0) for s in range(shards)]
        of_all = [n + held.get((s, False), 0) for s, n in enumerate(of_big)]
        room = {True: [max(0, q - n) for q, n in zip(quotas, of_big)], False: [max(0, q - n) for q, n in zip(quotas, of_all)]}
        leave = [max(0, n - q) / max(1, n - b) for q, n, b in zip(quotas, of_all, of_big)]

        def open_to(s: int) -> Column:
            mine = F.col("shard") == s
            goes = ~F.col("big") & (_unit("lead", F.lit(turn), F.lit("leave")) < leave[s])
            return F.when(mine, ~goes).otherwise(F.when(F.col("big"), F.lit(room[True][s] > 0)).otherwise(F.lit(room[False][s] > 0)))

        best = F.greatest(*(F.struct(F.when(open_to(s), F.col(f"c{s}")).otherwise(F.lit(-1)).alias("n"),
                                     F.xxhash64("lead", F.lit(s)).alias("tie"), F.lit(s).alias("s"))
                            for s in range(shards)))
        asked, asked_path = store(seen.select("node", "shard", "lead", "big", best.getField("s").alias("to")), "asked")
        drop(spark, seen_path)
        wants = {(r["to"], r["big"]): r["n"] for r in
                 asked.where("to <> shard").groupBy("to", "big").agg(F.count("*").alias("n")).collect()}
        if not wants:
            drop(spark, asked_path)
            break
        chance = _unit(F.when(F.col("big"), F.col("node")).otherwise(F.col("lead")), F.lit(turn))
        share = F.element_at(F.array(*(F.lit(min(1.0, ADMIT * room[kind][s] / max(1, wants.get((s, kind), 0))))
                                       for s in range(shards) for kind in (False, True))),
                             F.col("to") * 2 + F.col("big").cast("int") + 1)
        new, new_path = store(asked.select("node", F.when(chance < share, F.col("to")).otherwise(F.col("shard"))
                                           .alias("shard")), "shards")
        drop(spark, path)
        drop(spark, asked_path)
        now, path = new, new_path
    return now


def level(nodes: DataFrame, quotas: list[int]) -> DataFrame:
    """``nodes`` (node, shard, linked) with exactly ``quotas[s]`` rows in shard s; unlinked rows move first.

    Rows over a quota are numbered through all shards and dealt to the shards below theirs in that order. The driver
    sees counts per shard only; a window task sees a bucket of rows.
    """
    count = {r["shard"]: r["n"] for r in nodes.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    over = {s: max(0, count.get(s, 0) - q) for s, q in enumerate(quotas)}
    if not any(over.values()):
        return nodes.select("node", "shard")
    buckets = spread(sum(quotas))
    dealt = nodes.withColumn("bucket", F.pmod(F.xxhash64("node", F.lit("level")), F.lit(buckets)))
    keys = ["shard", "linked", "bucket"]
    before = offsets(dealt.groupBy(*keys).agg(F.count("*").alias("n")), ["shard"],
                     [F.col("linked"), F.col("bucket")], "n", "before")
    placed = dealt.join(before.select(*keys, "before"), keys) \
        .withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy(*keys).orderBy("node")) - 1)
    start, out_of, at = {}, [], 0
    for s, n in over.items():
        start[s], at = at, at + n
    limit = F.element_at(F.create_map(*(F.lit(x) for s, n in over.items() for x in (s, n))), F.col("shard"))
    first = F.element_at(F.create_map(*(F.lit(x) for s, n in start.items() for x in (s, n))), F.col("shard"))
    number, end, to = first + F.col("rank"), 0, F.col("shard")
    for s, q in enumerate(quotas):
        end += max(0, q - count.get(s, 0))
        out_of.append((end, s))
    target = F.lit(None).cast("int")
    for end, s in reversed(out_of):
        target = F.when(number < end, F.lit(s)).otherwise(target)
    return placed.select("node", F.when(F.col("rank") < limit, target).otherwise(to).cast("int").alias("shard"))


def with_slots(df: DataFrame, order: list[str], rows: int) -> DataFrame:
    """``df`` (with ``shard``) and ``slot``: 0, 1, ... in every shard, in buckets of ``order``'s hash."""
    dealt = df.withColumn("bucket", F.pmod(F.xxhash64(*order, F.lit("slot")), F.lit(spread(rows))))
    keys = ["shard", "bucket"]
    before = offsets(dealt.groupBy(*keys).agg(F.count("*").alias("n")), ["shard"], [F.col("bucket")], "n", "before")
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return dealt.join(before.select(*keys, "before"), keys) \
        .withColumn("slot", (F.col("before") + number - 1).cast("long")).drop("bucket", "before")


def shard_documents(df: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text",
                    rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row, linked by equal texts; shard counts differ by 1 at most.

    Null texts count as empty, and as equal to each other; ``size`` is the text's bytes plus 1. Repeated rows and ids
    stay. An empty table gives an empty one; fewer rows than shards leave shards empty. Other columns are left out.
    """
    content = F.coalesce(df[text], F.lit(""))
    rows = stored(df.select(df[doc_id].alias("doc_id"), (F.octet_length(content) + 1).cast("long").alias("size"),
                            F.crc32(content).alias("text_crc32"), F.xxhash64(content).alias("group_id"))
                  .withColumn("node", F.monotonically_increasing_id()), "rows")
    total = rows.count()
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    groups = rows.groupBy("group_id").agg(F.count("*").alias("n")).where("n > 1").select("group_id")
    linked = propagate(rows.join(groups, "group_id").select("node", "group_id"), quotas, rounds)
    free = F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int")
    nodes = stored(rows.select("node").join(linked, "node", "left")
                   .select("node", F.coalesce("shard", free).alias("shard"), F.col("shard").isNotNull().alias("linked")),
                   "nodes")
    placed = rows.join(level(nodes, quotas), "node")
    return with_slots(placed, ["node"], total).select("doc_id", "size", "text_crc32", "shard", "slot")
