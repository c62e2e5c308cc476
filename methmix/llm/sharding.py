"""Sharding by balanced label propagation; DataFrame functions only.

Documents with the same link key are linked to each other. A linked document starts in the shard of its
number, so that linked documents are even from the start. In each round every shard's part of a group asks
to join the shard that holds most of the group and has room for it, or else some other one with room (a group
larger than a shard asks for several). Requests are granted in order of a hash while the target has room, so no
shard ever passes its quota. Rounds go on until no request is granted, or until PATIENCE rounds in a row have not
lowered the number of cut links; the round with the fewest cut links counts. Parts move into free room only: where all documents are
linked there is none at the start, and groups stay cut as the numbers cut them. Documents without
links cost nothing wherever they lie and fill the room that is left: counts differ by at most one.

Requests are sums by (group, shard), so a group of any size is at most `shards` rows, and ranks come from
`running_sum`, which splits every key into buckets. The result does not depend on partitioning.

Null ids and texts are kept; a null text has size 16 and is equal to an empty one. Repeated rows are linked
as equal texts are. An empty table gives an empty result. Input columns are kept, but for those with the
name of a column made here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from methmix.llm.common import buckets_for, running_sum, stored, table, without
from methmix.llm.registry import query

SHARDS = 40
PATIENCE = 3
MADE = ("shard", "slot", "linked")


def quota(rows: int, shards: int, shard: Column) -> Column:
    return F.lit(rows // shards) + (shard < rows % shards).cast("bigint")


def wishes(state: DataFrame, rows: int, shards: int) -> DataFrame:
    """One row per part of a group that asks to move: _group, shard, _to, _n documents, _room in `_to`."""
    parts = stored(state.groupBy("__llm_group", "shard").agg(F.count(F.lit(1)).alias("__llm_n")), "shard-parts")
    room = stored(
        state.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
        .join(parts.groupBy("shard").agg(F.sum("__llm_n").alias("__llm_used")), "shard", "left")
        .select("shard", (quota(rows, shards, F.col("shard")) - F.coalesce("__llm_used", F.lit(0))).alias("__llm_room")), "shard-room")
    # One number per shard, whatever the number of documents. Split groups may also meet in a shard with room.
    open_shards = F.array(*[F.lit(r["shard"]) for r in room.filter("__llm_room > 0").orderBy("shard").collect()]).cast("array<int>")
    meeting = (parts.groupBy("__llm_group").agg(F.count(F.lit(1)).alias("__llm_parts")).filter("__llm_parts > 1")
               .select("__llm_group", F.get(open_shards, F.pmod(F.xxhash64("__llm_group"), F.greatest(F.size(open_shards), F.lit(1))).cast("int")).alias("shard"),
                       F.lit(0).cast("bigint").alias("__llm_n")).filter("shard IS NOT NULL"))
    parts = parts.unionByName(meeting).groupBy("__llm_group", "shard").agg(F.sum("__llm_n").alias("__llm_n")).join(F.broadcast(room), "shard")
    group = Window.partitionBy("__llm_group")
    # Shards that can hold the whole group come first, then those with most of it.
    parts = parts.withColumn("__llm_all", F.sum("__llm_n").over(group)).withColumn("__llm_holds", F.col("__llm_n") + F.col("__llm_room") >= F.col("__llm_all"))
    before = group.orderBy(F.desc("__llm_holds"), F.desc("__llm_n"), F.desc("__llm_room"), "shard").rowsBetween(Window.unboundedPreceding, -1)
    last_first = group.orderBy("__llm_holds", "__llm_n", "__llm_room", F.desc("shard")).rowsBetween(Window.unboundedPreceding, -1)
    # The first shards that can hold the whole group are its places, the others ask to move there.
    ranked = parts.withColumns({
        "__llm_held": F.coalesce(F.sum(F.col("__llm_n") + F.col("__llm_room")).over(before), F.lit(0)),
        "__llm_free": F.coalesce(F.sum("__llm_room").over(before), F.lit(0)),
        "__llm_ahead": F.coalesce(F.sum("__llm_n").over(last_first), F.lit(0)),
    }).withColumn("__llm_place", F.col("__llm_held") < F.col("__llm_all"))
    # Movers, smallest part first, take the places' free room in order.
    places = F.collect_list(F.when(F.col("__llm_place") & (F.col("__llm_room") > 0),
                                   F.struct("__llm_free", "__llm_room", F.col("shard").alias("__llm_to")))).over(group)
    fitting = F.filter("__llm_places", lambda p: (p["__llm_free"] <= F.col("__llm_ahead"))
                       & (F.col("__llm_ahead") < p["__llm_free"] + p["__llm_room"]))
    return (
        ranked.withColumn("__llm_places", places).filter(~F.col("__llm_place") & (F.col("__llm_n") > 0))
        .withColumn("__llm_target", F.get(fitting, F.lit(0))).filter(F.col("__llm_target").isNotNull())
        .select("__llm_group", "shard", "__llm_n", F.col("__llm_target.__llm_to").alias("__llm_to"), F.col("__llm_target.__llm_room").alias("__llm_room"))
    )


def cuts(state: DataFrame) -> int:
    """Parts of groups beyond the first of each group."""
    parts = state.groupBy("__llm_group", "shard").agg(F.lit(1).alias("__llm_n")).groupBy("__llm_group").agg(F.sum("__llm_n").alias("__llm_n"))
    return parts.agg(F.coalesce(F.sum(F.col("__llm_n") - 1), F.lit(0))).first()[0]


def propagate(state: DataFrame, rows: int, shards: int, patience: int, order: list[str], buckets: int) -> DataFrame:
    """Linked documents (_group, shard, ...) after the round with the fewest cut links. Ends, as each `patience` rounds lower their number."""
    best, fewest, idle = state, cuts(state), 0
    while fewest > 0 and idle < patience:
        asked = running_sum(wishes(state, rows, shards), ["__llm_to"], ["__llm_group", "shard"], F.col("__llm_n"), "__llm_earlier", buckets)
        moves = stored(asked.withColumn("__llm_take", F.least("__llm_n", F.col("__llm_room") - F.col("__llm_earlier"))).filter("__llm_take > 0")
                       .select("__llm_group", "shard", "__llm_to", "__llm_n", "__llm_take"), "shard-moves")
        if moves.isEmpty():
            break
        asked_rows = stored(state.join(moves, ["__llm_group", "shard"], "left"), "shard-asked")
        whole = asked_rows.filter("__llm_take IS NULL OR __llm_take = __llm_n").withColumn("shard", F.coalesce("__llm_to", "shard"))
        # A part that fits in part, at most one for each target, is cut by rank.
        part = running_sum(asked_rows.filter("__llm_take < __llm_n"), ["__llm_group", "shard"], order, None, "__llm_rank", buckets)
        part = part.withColumn("shard", F.when(F.col("__llm_rank") < F.col("__llm_take"), F.col("__llm_to")).otherwise(F.col("shard"))).drop("__llm_rank")
        state = stored(whole.unionByName(part).drop("__llm_to", "__llm_n", "__llm_take"), "shard-state")
        cut, idle = cuts(state), idle + 1
        if cut < fewest:
            best, fewest, idle = state, cut, 0
    return best


def shard_documents(docs: DataFrame, link: Column, order: list[str], shards: int = SHARDS,
                    patience: int = PATIENCE) -> DataFrame:
    """`docs` with shard (0 to `shards` - 1), slot (gapless from 0 in its shard) and linked (has links).

    Rows with equal non-null `link` are linked. `order` names columns that tell the rows apart.
    """
    keyed = stored(without(docs, MADE).withColumn("__llm_group", link), "shard-documents")
    rows = keyed.count()
    buckets = buckets_for(rows)
    groups = stored(keyed.filter(F.col("__llm_group").isNotNull()).groupBy("__llm_group").agg(F.count(F.lit(1)).alias("__llm_n"))
                    .filter("__llm_n > 1").select("__llm_group", F.lit(True).alias("linked")), "shard-groups")
    keyed = stored(keyed.join(groups, "__llm_group", "left")
                   .withColumn("linked", F.coalesce("linked", F.lit(False))), "shard-linked")
    numbered = stored(running_sum(keyed, ["linked"], order, None, "__llm_number", buckets), "shard-numbers")
    start = (numbered.filter("linked")
             .withColumn("shard", (F.col("__llm_number") % shards).cast("int")).drop("__llm_number"))
    linked = propagate(stored(start, "shard-start"), rows, shards, patience, order, buckets)
    used = linked.groupBy("shard").agg(F.count(F.lit(1)).alias("__llm_used"))
    all_shards = keyed.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    free = (all_shards.join(used, "shard", "left")
            .withColumn("__llm_room", quota(rows, shards, F.col("shard")) - F.coalesce("__llm_used", F.lit(0)))
            .withColumn("__llm_to", F.sum("__llm_room").over(Window.orderBy("shard")))
            .select("shard", (F.col("__llm_to") - F.col("__llm_room")).alias("__llm_from"), "__llm_to"))
    # Each number lies in one shard's interval; `free` has one row per shard.
    single = numbered.filter("NOT linked")
    filled = single.join(F.broadcast(stored(free, "shard-free")),
                         (F.col("__llm_number") >= F.col("__llm_from")) & (F.col("__llm_number") < F.col("__llm_to")))
    placed = filled.drop("__llm_number", "__llm_from", "__llm_to").unionByName(linked)
    return running_sum(stored(placed, "shard-placed"), ["shard"], order, None, "slot", buckets).drop("__llm_group")


def cut_edges(placed: DataFrame, link: str) -> DataFrame:
    """links and cut_links: each group counts as a chain, cut once for every further shard it lies in."""
    groups = (placed.filter(F.col(link).isNotNull()).groupBy(link, "shard").agg(F.count(F.lit(1)).alias("__llm_n"))
              .groupBy(link).agg(F.sum("__llm_n").alias("__llm_n"), F.count(F.lit(1)).alias("__llm_parts")))
    return groups.agg(F.coalesce(F.sum(F.col("__llm_n") - 1), F.lit(0)).alias("links"),
                      F.coalesce(F.sum(F.col("__llm_parts") - 1), F.lit(0)).alias("cut_links"))


@query("op5_shard_documents")
def op5_shard_documents(spark, sf_dir):
    """Law `rows`: shard counts differ by at most one; equal texts stay together as far as the quotas let them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 16).cast("bigint").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.sha2(text, 256).alias("digest"))
    placed = shard_documents(docs, F.col("digest"), ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))
