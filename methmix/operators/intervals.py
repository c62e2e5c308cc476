"""Regions, lift-over, and the overlap join of reads with regions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from methmix.schema import REGION_BOUNDS
from methmix.session import broadcast_if_small, fits_broadcast, materialize

BIN_WIDTH = 25   # about one region span
ROWS_PER_SALT = 200_000  # reads of one bin in one piece, when both sides are shuffled
LEVELS = 32      # levels of bins; each is four times as wide as the one below
LOWEST_BITS = 5  # the lowest level has bins of 32
SEGMENT_BITS = (16, 32)  # blocks of indexes in which segments are found and joined


def closed_regions(regions: DataFrame, end: str = "exclusive") -> DataFrame:
    """Regions with closed CpG bounds as bigint. `end` says what the input holds."""
    if end not in ("exclusive", "inclusive"):
        raise ValueError("end must be 'exclusive' or 'inclusive'")
    shift = 1 if end == "exclusive" else 0
    return regions.withColumns({
        "region_cpg_index_min": F.col("region_cpg_index_min").cast("bigint"),
        "region_cpg_index_max": F.col("region_cpg_index_max").cast("bigint") - shift,
    })


def lift_over(df: DataFrame, cpg_map: DataFrame, columns: list[str], source: str = "cpg_index",
              target: str = "cpg_index_hg38", suffix: str = "_hg38",
              order_by: str | None = None) -> DataFrame:
    """Adds `<column><suffix>`: the index in the other assembly, null where unmapped.

    Swap `source` and `target` for the way back. If a source index occurs more than once the
    entry with the largest `order_by` wins, and gives null if it has no target; without
    `order_by` the largest target wins. The map is cut to the indexes that `df` holds first.
    """
    needed = df.select(F.explode(F.array(*[F.col(c) for c in columns])).alias("_from")).where("_from IS NOT NULL").distinct()
    entries = cpg_map.where(F.col(source).isNotNull()).select(
        F.col(source).cast("bigint").alias("_from"), F.col(target).cast("bigint").alias("_to"),
        F.col(order_by or target).alias("_order"))
    pairs = materialize(entries.join(broadcast_if_small(materialize(needed, "lift-needed")), "_from", "left_semi")
                        .groupBy("_from").agg(F.max_by("_to", "_order").alias("_to")), "lift-map")
    return _with_lifted(df, pairs, columns, suffix)


def _with_lifted(df: DataFrame, pairs: DataFrame, columns: list[str], suffix: str) -> DataFrame:
    """`df` with the `_to` of each of its columns, one row of `pairs` for a `_from`."""
    for name in columns:
        hit = pairs.select(F.col("_from").alias(f"_from_{name}"), F.col("_to").alias(name + suffix))
        df = df.join(hit, F.col(name) == F.col(f"_from_{name}"), "left").drop(f"_from_{name}")
    return df


def index_segments(cpg_map: DataFrame, source: str = "cpg_index", target: str = "cpg_index_hg38",
                   order_by: str | None = None) -> DataFrame:
    """The index map as runs of consecutive indexes with one shift: `segment_start`, `segment_end`, `segment_shift`.

    An index that occurs more than once is settled as in `lift_over`; indexes without a target are in no
    segment. Runs are found in blocks of indexes, and the ones that touch a block's border are joined over
    wider and wider blocks. There are two of those a block at most, so no task sees the whole map.
    """
    settled = (cpg_map.where(F.col(source).isNotNull())
               .groupBy(F.col(source).cast("bigint").alias("_at"))
               .agg(F.max_by(F.col(target).cast("bigint"), F.col(order_by or target)).alias("_to"))
               .where("_to IS NOT NULL")
               .select(F.col("_at").alias("segment_start"), F.col("_at").alias("segment_end"),
                       (F.col("_to") - F.col("_at")).alias("segment_shift")))
    edges = materialize(_joined_runs(settled, SEGMENT_BITS[0]), "segments")
    inner = []
    for place, bits in enumerate(SEGMENT_BITS):
        inside = F.lit((1 << bits) - 1).cast("bigint")
        at_border = ((F.col("segment_start").bitwiseAND(inside) == 0)
                     | ((F.col("segment_end") + 1).bitwiseAND(inside) == 0))
        inner.append(edges.where(~at_border))
        wider = SEGMENT_BITS[place + 1] if place + 1 < len(SEGMENT_BITS) else None
        edges = _joined_runs(edges.where(at_border), wider)
    return reduce(DataFrame.unionByName, inner, edges)


def _joined_runs(segments: DataFrame, bits: int | None) -> DataFrame:
    """Segments that follow each other without a gap and with one shift as one, within blocks of 2^bits indexes; with
    None over all, which is for the few that touch the borders of the widest blocks."""
    block = Window.partitionBy("_block").orderBy("segment_start")
    follows = ((F.lag("segment_end").over(block) + 1 == F.col("segment_start"))
               & (F.lag("segment_shift").over(block) == F.col("segment_shift")))
    numbered = (segments.withColumn("_block", F.lit(0) if bits is None else F.shiftright("segment_start", bits))
                .withColumn("_new", F.when(follows, 0).otherwise(1))
                .withColumn("_run", F.sum("_new").over(block.rowsBetween(Window.unboundedPreceding, 0))))
    return numbered.groupBy("_block", "_run").agg(
        F.min("segment_start").alias("segment_start"), F.max("segment_end").alias("segment_end"),
        F.first("segment_shift").alias("segment_shift")).drop("_block", "_run")


def lift_over_segments(df: DataFrame, segments: DataFrame, columns: list[str], suffix: str = "_hg38",
                       max_broadcast_rows: int = 200_000) -> DataFrame:
    """`lift_over` with the runs of `index_segments` in place of the map: a run that holds the index adds its shift."""
    needed = df.select(F.explode(F.array(*[F.col(c).cast("bigint") for c in columns])).alias("_from")) \
        .where("_from IS NOT NULL").distinct()
    hits = _join_levels(needed, "_from", "_from", segments, "segment_start", "segment_end", max_broadcast_rows)
    inside = F.col("_from").between(F.col("segment_start"), F.col("segment_end"))
    pairs = hits.where(inside).select("_from", (F.col("_from") + F.col("segment_shift")).alias("_to"))
    return _with_lifted(df, materialize(pairs, "lift-map"), columns, suffix)


def region_geometry(regions: DataFrame, min_cpg: int) -> DataFrame:
    """Regions that keep their CpG count under lift-over and have at least `min_cpg` CpGs.
    Unmapped bounds never pass."""
    span = F.col("region_cpg_index_max") - F.col("region_cpg_index_min") + 1
    span_lifted = F.col("region_cpg_index_max_hg38") - F.col("region_cpg_index_min_hg38") + 1
    return regions.where((span == span_lifted) & (span >= min_cpg))


def lift_report(regions: DataFrame, min_cpg: int) -> DataFrame:
    """How many regions each lift-over rule drops; the rules apply in this order."""
    span = F.col("region_cpg_index_max") - F.col("region_cpg_index_min") + 1
    lifted = F.col("region_cpg_index_max_hg38") - F.col("region_cpg_index_min_hg38") + 1
    outcome = (F.when(lifted.isNull(), "unmapped").when(span != lifted, "span_changed")
               .when(span < min_cpg, "too_short").otherwise("kept"))
    return regions.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("regions"))


def use_lifted_bounds(regions: DataFrame) -> DataFrame:
    """Regions with the lifted bounds in place of the original ones."""
    return regions.withColumns({
        "region_cpg_index_min": F.col("region_cpg_index_min_hg38"),
        "region_cpg_index_max": F.col("region_cpg_index_max_hg38"),
    }).drop("region_cpg_index_min_hg38", "region_cpg_index_max_hg38")


def _bounded(regions: DataFrame, match_chr: bool) -> DataFrame:
    columns = REGION_BOUNDS + (["region_chr"] if match_chr else [])
    return regions.select(*columns).where(
        F.col("region_cpg_index_min").isNotNull() & F.col("region_cpg_index_max").isNotNull())


def _overlaps(match_chr: bool) -> Column:
    hit = ((F.col("cpg_index_min") <= F.col("region_cpg_index_max"))
           & (F.col("cpg_index_max") >= F.col("region_cpg_index_min")))
    return hit & (F.col("chr") == F.col("region_chr")) if match_chr else hit


def _bin(position: Column, width: int) -> Column:
    """Floor division, also below zero."""
    w = F.lit(width).cast("bigint")
    return F.call_function("div", position - F.pmod(position, w), w)


def _join_bins(binned: DataFrame, bins: DataFrame, identity: list[str], max_broadcast_rows: int) -> DataFrame:
    """Both sides joined on `_bin`: `bins` is broadcast while it is proven small. Beyond that both are shuffled by
    (bin, salt), rows of `binned` being salted by their `identity` columns where a bin's count asks for it."""
    if fits_broadcast(bins, max_rows=max_broadcast_rows):
        return binned.join(F.broadcast(bins), "_bin")
    crowded = broadcast_if_small(materialize(
        binned.groupBy("_bin").agg(F.count(F.lit(1)).alias("_reads")).where(F.col("_reads") > ROWS_PER_SALT)
        .select("_bin", F.ceil(F.col("_reads") / ROWS_PER_SALT).cast("bigint").alias("_pieces")), "crowded-bins"))
    pieces = F.coalesce("_pieces", F.lit(1).cast("bigint"))
    salted = binned.join(crowded, "_bin", "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*[F.col(c) for c in identity]), pieces)).drop("_pieces")
    copies = F.explode(F.sequence(F.lit(0).cast("bigint"), pieces - 1))
    copied = bins.join(crowded, "_bin", "left").withColumn("_salt", copies).drop("_pieces")
    return salted.join(copied, ["_bin", "_salt"]).drop("_salt")


def overlap_join(reads: DataFrame, regions: DataFrame, width: int = BIN_WIDTH,
                 match_chr: bool = False, max_broadcast_rows: int = 200_000) -> DataFrame:
    """Reads with each region they overlap, both bounds closed.

    Both sides are cut into bins of `width` CpGs and joined on the bin; a pair that shares
    several bins is kept in the first one only, so no pair comes out twice and nothing has to
    be deduplicated. While the region bins are proven small they are broadcast and the reads
    are never shuffled. Beyond that both sides are shuffled by (bin, salt): a crowded bin has as
    many salts as its counted reads ask for, its regions being copied to each.
    """
    bins = (_bounded(regions, match_chr)
            .withColumn("_region_bin", _bin(F.col("region_cpg_index_min"), width))
            .withColumn("_bin", F.explode(F.sequence(
                "_region_bin", _bin(F.col("region_cpg_index_max"), width)))))
    binned = (reads.withColumn("_read_bin", _bin(F.col("cpg_index_min"), width))
              .withColumn("_bin", F.explode(F.sequence(
                  "_read_bin", _bin(F.col("cpg_index_max"), width)))))
    pairs = _join_bins(binned, bins, reads.columns, max_broadcast_rows)
    first_common = F.col("_bin") == F.greatest("_read_bin", "_region_bin")
    return (pairs.where(first_common & _overlaps(match_chr))
            .drop("_bin", "_read_bin", "_region_bin", "region_chr"))


def _level_bits(level: Column) -> Column:
    return (level * 2 + LOWEST_BITS).cast("int")


def _join_levels(probes: DataFrame, low: str, high: str, build: DataFrame, start: str, end: str,
                 max_broadcast_rows: int) -> DataFrame:
    """Each row of `probes` with every row of `build` whose bins it meets, never the same pair twice; what
    overlaps is among them. A row of `build` sits in one bin: the one of its start, on the lowest level whose
    bins are at least as wide as the row. On each level in use a probe asks the bins in which such a row may
    start: two, and one more for every bin that the probe itself is longer."""
    span = F.col(end) - F.col(start) + 1
    level = reduce(lambda rest, n: F.when(span <= (1 << (2 * n + LOWEST_BITS)), n).otherwise(rest),
                   range((63 - LOWEST_BITS) // 2 - 1, -1, -1), F.lit((63 - LOWEST_BITS) // 2)).cast("bigint")
    placed = build.where(span >= 1).withColumn("_level", level)
    levels = sorted(r["_level"] for r in placed.select("_level").distinct().collect())  # at most LEVELS numbers
    bins = placed.withColumn("_bin", _level_bin(F.col(start), F.col("_level"))).drop("_level")
    if not levels:
        return probes.withColumn("_bin", F.lit(None).cast("bigint")).join(bins, "_bin").drop("_bin")
    asked = F.flatten(F.array(*[_asked_bins(F.col(low), F.col(high), n) for n in levels]))
    binned = probes.where((F.col(low) <= F.col(high))).withColumn("_bin", F.explode(asked))
    return _join_bins(binned, bins, probes.columns, max_broadcast_rows).drop("_bin")


def _level_bin(position: Column, level: Column) -> Column:
    """Bin and level as one number."""
    return F.call_function("shiftright", position, _level_bits(level)) * LEVELS + level


def _asked_bins(low: Column, high: Column, level: int) -> Column:
    bits = 2 * level + LOWEST_BITS
    first = F.shiftright(low - ((1 << bits) - 1), bits)
    return F.transform(F.sequence(first, F.shiftright(high, bits)), lambda b: b * LEVELS + level)


def overlap_join_levels(reads: DataFrame, regions: DataFrame, match_chr: bool = False,
                        max_broadcast_rows: int = 200_000) -> DataFrame:
    """`overlap_join` for regions of very different lengths: a region is one row of the build side, however long
    it is. Reads are copied twice for each level of lengths that the regions have."""
    pairs = _join_levels(reads, "cpg_index_min", "cpg_index_max", _bounded(regions, match_chr),
                         "region_cpg_index_min", "region_cpg_index_max", max_broadcast_rows)
    return pairs.where(_overlaps(match_chr)).drop("region_chr")


def region_read_coverage(region_reads: DataFrame, *keys: str) -> DataFrame:
    """Rows per region (and per `keys`)."""
    return region_reads.groupBy(*keys, "region_id").agg(F.count(F.lit(1)).alias("reads"))

