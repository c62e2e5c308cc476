"""Mixing sources to target weights by thresholds on hashes; DataFrame functions only.

Every document has a 48-bit hash. A source that must give `target` words takes each document
floor(target / source size) times, and once more if its hash lies under the source's threshold.
The threshold comes from histograms of words by source and hash bucket: the first has 2^12 buckets
of 36 bits each, and each further one splits only the bucket in which the budget ends. What the document at the end
leaves open is filled by a second and a third threshold behind it. No sort, and nothing larger than sources x 2^12
rows leaves a histogram.

Nulls: a null source is a source of its own, last in order; a null text has 0 words. Sources without words
get target 0. Rows equal in id and text share a hash, so they are taken or left together. Empty tables
give empty results. Input columns are kept, but for those with the name of a column made here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from methmix.llm.common import WORD, stored, table, without
from methmix.llm.registry import query

HASH_BITS = 48
LEVEL_BITS = 12
BANDS = 3
MADE = ("size", "source_size", "target", "taken", "copies")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_key(source: Column) -> Column:
    """Never null: sorts as the source does by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def source_targets(sized: DataFrame, weights: tuple[int, ...], limit: int) -> DataFrame:
    """One row per source of `sized` (_key, size): _size, and its budget target and the longs behind it.

    Targets share the total by weight; none exceeds `limit` times its source. Sorted by how soon the
    limit binds, the first source that stays under it under the share left then fixes the share of all
    later ones. The windows run over one row per source.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy("__llm_key")
    by_ratio = Window.orderBy(F.col("__llm_cap").cast("double") / F.col("__llm_w"), "__llm_key")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    wide = "decimal(38,0)"
    sources = (
        sized.groupBy("__llm_key").agg(F.sum("size").alias("__llm_size"))
        .withColumn("__llm_n", F.row_number().over(by_name) - 1)
        .withColumn("__llm_w", F.element_at(F.array(*[F.lit(w) for w in weights]),
                                       (F.col("__llm_n") % len(weights) + 1).cast("int")).cast("bigint"))
        .withColumn("__llm_cap", F.col("__llm_size") * limit)
        .withColumn("__llm_left", F.sum("__llm_size").over(everything) - F.coalesce(F.sum("__llm_cap").over(before), F.lit(0)))
        .withColumn("__llm_weights", F.sum("__llm_w").over(onward))
        .withColumn("__llm_place", F.row_number().over(by_ratio))
    )
    fits = (F.col("__llm_left") * F.col("__llm_w")).cast(wide) <= F.col("__llm_cap").cast(wide) * F.col("__llm_weights")
    first = F.min(F.when(fits, F.struct("__llm_place", "__llm_left", "__llm_weights"))).over(everything)
    return (
        sources.withColumn("__llm_first", first)
        .withColumn("target", F.when(F.col("__llm_place") < F.col("__llm_first.__llm_place"), F.col("__llm_cap").cast("double"))
                    .otherwise((F.col("__llm_first.__llm_left") * F.col("__llm_w")).cast("double") / F.col("__llm_first.__llm_weights")))
        .select("__llm_key", "__llm_size", "target")
    )


def boundary(sized: DataFrame, state: DataFrame) -> DataFrame:
    """`state` (one row per source: _key, _from, _cap, _rest) with the bucket of one hash in which the budget `_rest` ends:
    _prefix, the hash, _below, the words under it, and _words, its own. Only documents with a hash of `_from` or more
    and a size of `_cap` or less count.
    """
    state = state.withColumns({"__llm_prefix": F.lit(0).cast("bigint"), "__llm_below": F.lit(0.0), "__llm_words": F.lit(0).cast("bigint")})
    shift = HASH_BITS
    while shift > 0:
        shift -= LEVEL_BITS
        # Only documents of the bucket in which the budget ends are counted again.
        inside = ((F.shiftright("__llm_hash", shift + LEVEL_BITS) == F.col("__llm_prefix"))
                  & (F.col("__llm_hash") >= F.col("__llm_from")) & (F.col("size") <= F.col("__llm_cap")))
        # One scan and one plan a level: the rows of a bucket's total carry the state of their source.
        counted = (sized.join(state.drop("__llm_words"), "__llm_key").filter(inside)
                   .groupBy("__llm_key", "__llm_below", "__llm_rest", F.shiftright("__llm_hash", shift).alias("__llm_at"))
                   .agg(F.sum("size").alias("__llm_total")))
        upto = Window.partitionBy("__llm_key").orderBy("__llm_at")
        ends = F.when(F.col("__llm_upto") > F.col("__llm_rest"), F.struct("__llm_at", "__llm_upto", "__llm_total"))
        found = (
            counted.withColumn("__llm_upto", F.col("__llm_below") + F.sum("__llm_total").over(upto))
            .groupBy("__llm_key").agg(F.min(ends).alias("__llm_b"), F.sum("__llm_total").alias("__llm_whole"))
        )
        # No bucket passes the budget: every document of the last prefix lies under the threshold.
        last = F.shiftleft(F.col("__llm_prefix") + 1, LEVEL_BITS)
        joined = state.join(found, "__llm_key", "left")
        state = stored(joined.select(
            "__llm_key", "__llm_from", "__llm_cap", "__llm_rest", F.coalesce("__llm_b.__llm_at", last).alias("__llm_prefix"),
            F.coalesce(F.col("__llm_b.__llm_upto") - F.col("__llm_b.__llm_total"), F.col("__llm_below") + F.coalesce("__llm_whole", F.lit(0))).alias("__llm_below"),
            F.coalesce("__llm_b.__llm_total", F.lit(0)).cast("bigint").alias("__llm_words")), "mix-state")
    return state


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: _full, copies of every document, and _bands, the documents with one more: those with a hash from
    `from` to under `under` and a size of `cap` or less.

    The first band ends where the budget does. The document there seldom fits; further bands go on behind it with
    documents that fit into what is left, and the last one takes its final document if that comes closer.
    `sized` has _key, size and _hash; both inputs should be stored tables, since each level reads them.
    """
    full = F.when(F.col("__llm_size") > 0, F.floor(F.col("target") / F.col("__llm_size"))).otherwise(F.lit(0)).cast("bigint")
    sources = targets.withColumn("__llm_full", full)
    state = sources.select("__llm_key", F.lit(0).cast("bigint").alias("__llm_from"), F.lit(1 << 62).alias("__llm_cap"),
                           (F.col("target") - F.col("__llm_full") * F.col("__llm_size")).alias("__llm_rest"))
    bands = sources.select("__llm_key", F.array().cast("array<struct<from:bigint,under:bigint,cap:bigint>>").alias("__llm_bands"))
    for place in range(BANDS):
        found = boundary(sized, state)
        over = F.col("__llm_below") + F.col("__llm_words") - F.col("__llm_rest")
        closer = (over < F.col("__llm_rest") - F.col("__llm_below")).cast("bigint") if place == BANDS - 1 else F.lit(0).cast("bigint")
        band = F.struct(F.col("__llm_from").alias("from"), (F.col("__llm_prefix") + closer).alias("under"), F.col("__llm_cap").alias("cap"))
        bands = bands.join(found.select("__llm_key", band.alias("__llm_band")), "__llm_key").select(
            "__llm_key", F.array_append("__llm_bands", F.col("__llm_band")).alias("__llm_bands"))
        left = F.col("__llm_rest") - F.col("__llm_below")
        state = found.select("__llm_key", (F.col("__llm_prefix") + 1).alias("__llm_from"), F.ceil(left).cast("bigint").alias("__llm_cap"), left.alias("__llm_rest"))
    return sources.join(stored(bands, "mix-bands"), "__llm_key").select("__llm_key", "__llm_size", "target", "__llm_full", "__llm_bands")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: int = 3, id_col: str = "doc_id",
                text_col: str = "text", source_col: str = "source", size: Column | None = None) -> DataFrame:
    """`docs` with size, source_size, target, copies (0 to `limit`) and taken = copies x size.

    Sources, by code point with null last, weigh `weights` in turn and share the size of all documents.
    """
    docs = without(docs, MADE)
    size = word_count(F.col(text_col)) if size is None else size
    digest = F.xxhash64(F.col(id_col), F.col(text_col)).bitwiseAND(F.lit((1 << HASH_BITS) - 1))
    sized = docs.withColumns({"size": size, "__llm_hash": digest, "__llm_key": source_key(F.col(source_col))})
    # The text stays in `docs`; the histograms read three narrow columns.
    narrow = stored(sized.select("__llm_key", "size", "__llm_hash"), "mix-sizes")
    targets = stored(source_targets(narrow, weights, limit), "mix-targets")
    limits = thresholds(narrow, targets)
    once_more = F.exists("__llm_bands", lambda b: (F.col("__llm_hash") >= b["from"]) & (F.col("__llm_hash") < b["under"]) & (F.col("size") <= b["cap"]))
    copies = F.least(F.col("__llm_full") + once_more.cast("bigint"), F.lit(limit).cast("bigint"))
    return (
        sized.join(limits, "__llm_key").withColumnRenamed("__llm_size", "source_size")
        .withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
        .drop("__llm_hash", "__llm_key", "__llm_full", "__llm_bands")
    )


@query("op2_mix_sources")
def op2_mix_sources(spark, sf_dir):
    """doc_id, size, source_size, target, taken, for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    slim = stored(docs.select("doc_id", "source", F.xxhash64("text").alias("text"),
                              word_count(F.col("text")).alias("words")), "mix-documents")
    mixed = mix_sources(slim, size=F.col("words"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")
