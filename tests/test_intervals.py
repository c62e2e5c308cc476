import random

import pytest

from methmix.operators import intervals

READ = "molecule_id string, chr string, cpg_index_min bigint, cpg_index_max bigint"
REGION = "region_id string, region_chr string, region_cpg_index_min bigint, region_cpg_index_max bigint"


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(7)
    reads = []
    for i in range(400):
        start = rng.randint(-60, 400) if i % 3 else 100  # a third of all reads in one place
        reads.append((f"m{i}", f"chr{i % 2}", start, start + rng.choice([0, 3, 12, 90])))
    regions = [(f"r{j}", f"chr{j % 2}", s, s + rng.choice([0, 5, 30, 120])) for j, s in
               enumerate(rng.randint(-50, 400) for _ in range(30))]
    regions.append(("unmapped", "chr0", None, 10))
    brute = sorted((m, r) for m, _, a, b in reads for r, _, lo, hi in regions
                   if lo is not None and a <= hi and b >= lo)
    return spark.createDataFrame(reads, READ), spark.createDataFrame(regions, REGION), brute, reads, regions


def pairs(df):
    return sorted((r["molecule_id"], r["region_id"]) for r in df.collect())


@pytest.mark.parametrize("width", [1, 7, 25, 1000])
def test_binned_join_finds_every_pair_once(tables, width):
    reads, regions, brute, _, _ = tables
    assert pairs(intervals.overlap_join(reads, regions, width)) == brute


def test_shuffled_join_gives_the_same_pairs(tables, monkeypatch):
    reads, regions, brute, _, _ = tables
    joined = intervals.overlap_join(reads, regions, max_broadcast_rows=0)
    assert pairs(joined) == brute
    monkeypatch.setattr(intervals, "ROWS_PER_SALT", 20)
    assert pairs(intervals.overlap_join(reads, regions, max_broadcast_rows=0)) == brute
    assert "_salt" in joined._jdf.queryExecution().toString()


def test_chromosomes_can_be_matched(tables):
    reads, regions, _, raw_reads, raw_regions = tables
    expected = sorted((m, r) for m, c, a, b in raw_reads for r, d, lo, hi in raw_regions
                      if lo is not None and a <= hi and b >= lo and c == d)
    assert pairs(intervals.overlap_join(reads, regions, match_chr=True)) == expected


def test_touching_bounds_overlap(spark):
    reads = spark.createDataFrame([("m", "c", 5, 10)], READ)
    regions = spark.createDataFrame([("left", "c", 1, 5), ("right", "c", 10, 12), ("off", "c", 11, 12)], REGION)
    assert pairs(intervals.overlap_join(reads, regions, 4)) == [("m", "left"), ("m", "right")]


def test_region_ends(spark):
    regions = spark.createDataFrame([("r", "c", 1, 6)], REGION)
    assert intervals.closed_regions(regions, "exclusive").first()["region_cpg_index_max"] == 5
    assert intervals.closed_regions(regions, "inclusive").first()["region_cpg_index_max"] == 6
    with pytest.raises(ValueError):
        intervals.closed_regions(regions, "half")


def test_lift_over_and_geometry(spark):
    regions = intervals.closed_regions(spark.createDataFrame(
        [("same", "c", 1, 5), ("grown", "c", 1, 9), ("gone", "c", 1, 8), ("short", "c", 1, 3)], REGION))
    cpg_map = spark.createDataFrame(
        [(1, 100, 0), (1, 101, 1), (4, 104, 0), (8, 120, 0), (7, None, 0), (2, 102, 0)],
        "cpg_index bigint, cpg_index_hg38 bigint, line int")
    lifted = intervals.lift_over(regions, cpg_map, ["region_cpg_index_min", "region_cpg_index_max"], order_by="line")
    bounds = {r["region_id"]: (r["region_cpg_index_min_hg38"], r["region_cpg_index_max_hg38"]) for r in lifted.collect()}
    assert bounds == {"same": (101, 104), "grown": (101, 120), "gone": (101, None), "short": (101, 102)}
    kept = intervals.use_lifted_bounds(intervals.region_geometry(lifted, 3)).collect()
    assert [(r["region_id"], r["region_cpg_index_min"], r["region_cpg_index_max"]) for r in kept] == [("same", 101, 104)]
    report = {r["outcome"]: r["regions"] for r in intervals.lift_report(lifted, 3).collect()}
    assert report == {"kept": 1, "span_changed": 1, "unmapped": 1, "too_short": 1}


def test_last_entry_without_target_gives_null(spark):
    frame = spark.createDataFrame([(1,), (2,), (None,)], "i bigint")
    cpg_map = spark.createDataFrame([(1, 100, 0), (1, None, 1), (2, None, 0), (2, 200, 1), (3, 300, 0)],
                                    "cpg_index bigint, cpg_index_hg38 bigint, line int")
    lifted = intervals.lift_over(frame, cpg_map, ["i"], order_by="line").collect()
    assert {r["i"]: r["i_hg38"] for r in lifted} == {1: None, 2: 200, None: None}


def spread(rng):
    """Reads and regions of 1 to a million CpGs, some below zero."""
    reads = [(f"m{i}", "c", s, s + rng.choice([0, 3, 90, 400])) for i, s in enumerate(rng.randint(-3000, 50_000) for _ in range(300))]
    lengths = [1, 10, 31, 32, 33, 128, 129, 5000, 70_000, 1_000_000]
    regions = [(f"r{j}", "c", s, s + rng.choice(lengths) - 1) for j, s in enumerate(rng.randint(-60_000, 50_000) for _ in range(200))]
    return reads, regions + [("unmapped", "c", None, 10), ("turned", "c", 9, 5)]


@pytest.mark.parametrize("limit", [200_000, 0])
def test_levels_find_every_pair_once_and_copy_no_region(spark, monkeypatch, limit):
    reads, regions = spread(random.Random(3))
    brute = sorted((m, r) for m, _, a, b in reads for r, _, lo, hi in regions if lo is not None and lo <= hi and a <= hi and b >= lo)
    sizes, join = [], intervals._join_bins

    def counted(binned, bins, *rest):
        sizes.append((binned.count(), bins.count()))
        return join(binned, bins, *rest)

    monkeypatch.setattr(intervals, "_join_bins", counted)
    monkeypatch.setattr(intervals, "ROWS_PER_SALT", 20)
    joined = intervals.overlap_join_levels(spark.createDataFrame(reads, READ), spark.createDataFrame(regions, REGION), max_broadcast_rows=limit)
    assert pairs(joined) == brute
    (asked, built), = sizes
    assert built == 200  # one row a region
    levels = len({next(n for n in range(32) if hi - lo < 1 << (2 * n + 5)) for _, _, lo, hi in regions[:200]})
    assert asked <= len(reads) * (2 * levels + 14)  # 400 CpGs pass 13 borders of 32 on the lowest level


def test_levels_without_regions_or_reads(spark):
    reads, regions = spread(random.Random(4))
    none = spark.createDataFrame([], REGION)
    assert pairs(intervals.overlap_join_levels(spark.createDataFrame(reads, READ), none)) == []
    assert pairs(intervals.overlap_join_levels(spark.createDataFrame([], READ), spark.createDataFrame(regions, REGION))) == []


def test_segments_over_block_borders(spark, monkeypatch):
    """Runs longer than several blocks come out whole; the same indexes are lifted as by the map."""
    rng = random.Random(6)
    rows, shift = [], 0
    for i in range(-300, 900):
        if rng.random() < 0.02:
            shift += rng.choice([-3, 1, 7])
        rows.append((i, None if rng.random() < 0.01 else i + shift, 0))
    rows += [(i, rng.choice([None, 5000 + i]), 1) for i in rng.sample(range(-300, 900), 40)] + [(None, 4, 0)]
    cpg_map = spark.createDataFrame(rows, "cpg_index bigint, cpg_index_hg38 bigint, line int")
    last = {}
    for i, j, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[2]):
        last[i] = j
    expected = []
    for i in sorted(k for k, v in last.items() if v is not None):
        if expected and expected[-1][1] == i - 1 and expected[-1][2] == last[i] - i:
            expected[-1][1] = i
        else:
            expected.append([i, i, last[i] - i])
    frame = spark.createDataFrame([(i, i + 7) for i in range(-320, 920)] + [(None, 1)], "lo bigint, hi bigint")
    by_map = intervals.lift_over(frame, cpg_map, ["lo", "hi"], order_by="line")
    for bits in [(3, 6), (4, 9), (16, 32)]:
        monkeypatch.setattr(intervals, "SEGMENT_BITS", bits)
        segments = intervals.index_segments(cpg_map, order_by="line")
        assert sorted(map(list, segments.collect())) == expected
        lifted = intervals.lift_over_segments(frame, segments, ["lo", "hi"])
        assert sorted(map(str, lifted.collect())) == sorted(map(str, by_map.select(*lifted.columns).collect()))
