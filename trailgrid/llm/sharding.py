"""Sharding by balanced label propagation; documents with equal texts are linked.

Every document starts in a shard by its hash. In each round the documents of a group that are not in
its preferred shard (most members there; every other round, room left there first) ask to move, and
moves are granted in cycles between shards and in chains that end in free room, so that full shards
swap. Rounds end when nothing asks or two in turn leave no fewer documents astray. They work on members by (group, shard): at most one row per shard and group, however large
the group. Then every shard keeps linked documents up to its exact capacity, and unlinked ones and
the few over capacity fill the rest, so that shards differ by one document at most (law `rows`).
Slots come from counts of small buckets and numbers within a bucket; large groups get several buckets.

Defined cases: a null text is linked to nothing, has size 1 and the check sum of the empty text;
repeated rows are documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import accumulate
from math import inf

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, join_hot, unit

#: Documents that one bucket of slots aims at.
BUCKET = 1000


def _prefer(members: DataFrame, room: list[int], r: int) -> DataFrame:
    """members with `to`, the shard that its group prefers, and `home`, the shard with most of it."""
    open_ = F.element_at(F.array(*[F.lit(int(x > 0)) for x in room]), F.col("shard") + 1)
    tie = F.xxhash64("g", "shard", F.lit(r))
    first = F.struct(open_, "n", tie) if r % 2 else F.struct("n", open_, tie)
    best = members.groupBy("g").agg(F.max_by("shard", first).alias("to"), F.max_by("shard", F.struct("n", "shard")).alias("home"))
    return members.join(best, "g")


def _route(left: dict[tuple[int, int], int], begin: int, ends: set[int]) -> list[tuple[int, int]] | None:
    """The moves of a shortest way of one or more from a shard to one of the ends."""
    came, queue = {}, [begin]
    for u in queue:
        for (a, b), n in left.items():
            if a == u and n > 0 and b in ends:
                edges = [(u, b)]
                while edges[-1][0] != begin:
                    edges.append((came[edges[-1][0]], edges[-1][0]))
                return edges
            if a == u and n > 0 and b not in came and b != begin:
                came[b] = u
                queue.append(b)
    return None


def granted(wants: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """Of the moves (from, to) asked for, what leaves no shard above its capacity or fuller than it was: cycles, then chains into room, from the fullest shards first."""
    left, room = dict(wants), list(room)
    for s in range(len(room)):
        while edges := _route(left, s, {s}):
            most = min(left[e] for e in edges)
            left |= {e: left[e] - most for e in edges}
    # What is left has no cycle, so room only goes back along it and this ends.
    while edges := next(filter(None, (_route(left, s, {t for t, r in enumerate(room) if r > 0 and t != s}) for s in sorted(range(len(room)), key=room.__getitem__))), None):
        most = min(room[edges[0][1]], *(left[e] for e in edges))
        left |= {e: left[e] - most for e in edges}
        room[edges[0][1]] -= most
        room[edges[-1][0]] += most
    return {e: n - left[e] for e, n in wants.items()}


def propagate(members: DataFrame, capacity: list[int], scratch: Scratch) -> DataFrame:
    """members (g, shard, n) after moves under quotas, until these no longer bring groups together."""
    shards, r, least, idle = len(capacity), 0, inf, 0
    while True:
        load = dict(members.groupBy("shard").agg(F.sum("n").alias("n")).collect())  # one row a shard
        room = [c - (load.get(s) or 0) for s, c in enumerate(capacity)]
        asked = _prefer(members, room, r)
        seen = asked.groupBy("shard", "to").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("shard") != F.col("home"), F.col("n")).otherwise(0)).alias("astray")).collect()  # one row a pair of shards
        astray = sum(x["astray"] for x in seen)
        least, idle = (astray, 0) if astray < least else (least, idle + 1)
        if not astray or idle == 2:
            return members
        wants = {(x["shard"], x["to"]): x["n"] for x in seen if x["shard"] != x["to"]}
        grants = granted(wants, room)
        share = [grants[s, t] / wants[s, t] if (s, t) in wants else 0.0 for s in range(shards) for t in range(shards)]
        grant = F.element_at(F.array(*map(F.lit, share)), F.col("shard") * shards + F.col("to") + 1)
        large = F.col("n") * 50 > min(capacity)  # a large group moves in part, a small one as a whole or not
        part = F.least(F.col("n"), F.floor(F.col("n") * grant + unit("g", "shard", F.lit(r))))
        moved = F.when(F.col("shard") == F.col("to"), 0).when(large, part).when(unit("g", F.lit(r)) < grant, F.col("n")).otherwise(0)
        flows = asked.withColumn("moved", moved).select(F.explode(F.array(F.struct("g", "shard", (F.col("n") - F.col("moved")).alias("n")), F.struct("g", F.col("to").alias("shard"), F.col("moved").alias("n")))).alias("x")).select("x.*")
        members = scratch.keep(flows.groupBy("g", "shard").agg(F.sum("n").alias("n")).where("n > 0"), f"members{r}")
        scratch.drop(f"members{r - 1}")
        r += 1


def assign(documents: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", seed: int = 11) -> DataFrame:
    """(id_col, size, text_crc32, shard, slot) of every document."""
    scratch = Scratch(documents.sparkSession, "sharding")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = documents.select(
        F.col(id_col).alias("key"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"),
        F.when(F.col(text_col).isNotNull(), F.xxhash64(F.col(text_col), F.octet_length(text))).alias("g"),
    )
    nodes = scratch.keep(rows.withColumn("h", F.xxhash64("key", F.lit(seed))), "nodes")
    total = nodes.count()
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    first = F.pmod(F.col("h"), F.lit(shards)).cast("int")
    members = nodes.where("g is not null").groupBy("g", first.alias("shard")).agg(F.count("*").alias("n"))
    linked = members.groupBy("g").agg(F.sum("n").alias("all")).where("all > 1")
    start = scratch.keep(members.join(linked.select("g"), "g"), "start")
    ended = propagate(start, capacity, scratch)
    # Per group: its size and up to which share of its members each shard reaches.
    reach = F.transform(F.array_sort("xs"), lambda x: x["shard"])
    upto = F.aggregate(F.array_sort("xs"), F.array().cast("array<bigint>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + x["n"])))
    groups = ended.groupBy("g").agg(F.collect_list(F.struct("shard", "n")).alias("xs"), F.sum("n").alias("all")).select("g", "all", reach.alias("at"), upto.alias("upto"), F.col("all").alias("n"))
    share = F.floor(unit("h", F.lit("share")) * F.col("all"))
    wish = F.when(F.size("at") == 1, F.get("at", F.lit(0))).otherwise(F.get("at", F.size(F.filter("upto", lambda u: u <= share))))
    known = join_hot(nodes, groups, ["g"], total, "left")
    buckets = max(1, -(-total // BUCKET))
    big = F.coalesce(F.col("all") > BUCKET // 4, F.lit(False))
    placed = known.select("key", "size", "crc", "g", "h", F.coalesce(wish, F.lit(shards)).alias("w"), big.alias("big"), F.when(big, F.col("g")).otherwise(F.pmod(F.when(F.col("all") > 1, F.col("g")).otherwise(F.col("h")), F.lit(buckets))).alias("gb"), F.when(big, F.pmod(F.xxhash64("h"), F.ceil(F.col("all") / (BUCKET // 4)))).otherwise(0).alias("sub"))
    placed = scratch.keep(placed, "placed")
    within = Window.partitionBy("w", "big", "gb", "sub")
    sizes = placed.groupBy("w", "big", "gb", "sub").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("w").orderBy("big", "gb", "sub")) - F.col("n")).drop("n")
    have = dict(placed.groupBy("w").agg(F.count("*").alias("n")).collect())  # one row a shard and one for unlinked documents
    numbered = placed.withColumn("k", F.row_number().over(within.orderBy("g", "h", "key")) - 1).join(before, ["w", "big", "gb", "sub"]).withColumn("q", F.col("before") + F.col("k"))
    kept = [min(have.get(s, 0), c) for s, c in enumerate(capacity)]
    over = [0, *accumulate(have.get(s, 0) - kept[s] for s in range(shards))]
    free = list(accumulate(c - k for c, k in zip(capacity, kept, strict=True)))
    pick = lambda values, i: F.element_at(F.array(*[F.lit(int(v)) for v in values]), (i + 1).cast("int"))
    w = F.col("w")
    spare = F.col("q") - pick([*kept, 0], w) + pick(over, w)
    rest = F.size(F.filter(F.array(*[F.lit(int(v)) for v in free]), lambda f: f <= F.col("z")))
    done = numbered.withColumn("stays", F.col("q") < pick([*kept, 0], w)).withColumn("z", spare).withColumn("to", F.least(rest, F.lit(shards - 1)))
    slot = F.when(F.col("stays"), F.col("q")).otherwise(F.col("z") - pick([0, *free[:-1]], F.col("to")) + pick(kept, F.col("to")))
    return done.select(F.col("key").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.when(F.col("stays"), w).otherwise(F.col("to")).cast("int").alias("shard"), slot.cast("long").alias("slot"))


def report(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: law `rows`)."""
    return assign(documents).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
