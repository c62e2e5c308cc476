import random

import pytest

from methmix.operators import scoring

COLUMNS = ("molecule_id string, region_id string, cpg_index_min bigint, cpg_index_max bigint, pat_string string, "
           "number_molecules int, region_cpg_index_min bigint, region_cpg_index_max bigint")
# Region R is 12..16; read d lies outside it and would not come out of the overlap join.
READS = [
    ("a", "R", 10, 17, "CCTTC.CC", 1, 12, 16),
    ("b", "R", 14, 19, "TTTTTC", 3, 12, 16),
    ("c", "R", 15, 17, "C.C", 1, 12, 16),
]


def brute(text, letters, k):
    return sum(all(ch in letters for ch in text[i:i + k]) for i in range(len(text) - k + 1))


@pytest.fixture(scope="module")
def reads(spark):
    return spark.createDataFrame(READS, COLUMNS)


def test_trim(reads):
    rows = {r["molecule_id"]: r["trimmed_pat"] for r in scoring.trim_reads(reads).collect()}
    assert rows == {"a": "TTC.C", "b": "TTT", "c": "C."}


def test_read_scores(reads):
    rows = {r["molecule_id"]: r for r in scoring.score_reads(reads).collect()}
    assert set(rows) == {"a", "b"}
    a, b = rows["a"], rows["b"]
    assert (a["meth_k1"], a["unmeth_k1"], a["total_k1"]) == (2, 2, 4)
    assert (a["meth_k3"], a["unmeth_k3"], a["total_k3"]) == (0, 0, 1)
    assert (a["frac_alpha_leq_25pct"], a["frac_alpha_geq_75pct"]) == (0, 0)
    assert (b["meth_k3"], b["unmeth_k3"], b["total_k3"], b["frac_alpha_leq_25pct"]) == (0, 1, 1, 1)


@pytest.mark.parametrize("weighting, expected", [
    ("rows", (4, 2, 5, 7, 2, 0.25)), ("molecules", (4, 2, 11, 13, 4, 0.75))])
def test_weighting(reads, weighting, expected):
    row = scoring.score_regions(reads, [], weighting).first()
    names = ["number_molecules", "meth_k1", "unmeth_k1", "total_k1", "total_k3", "frac_alpha_leq_25pct"]
    assert tuple(row[n] for n in names) == expected


def test_kmers_against_brute_force(spark):
    """Short and long strings, and characters outside the alphabet."""
    rng = random.Random(1)
    texts = ["CCCCC", "", "T", "C" * 31, "CT" * 40, "CC?TT"]
    texts += ["".join(rng.choice("CCTT.") for _ in range(rng.randint(1, 45))) for _ in range(300)]
    texts += ["".join(rng.choice("CTNn.") for _ in range(rng.randint(1, 20))) for _ in range(50)]
    frame = spark.createDataFrame([(t,) for t in texts], "trimmed_pat string")
    for row in scoring.count_kmers(frame, kmers=(1, 2, 3, 4)).collect():
        text = row["trimmed_pat"]
        for k in (1, 2, 3, 4):
            assert row[f"meth_k{k}"] == brute(text, "C", k), text
            assert row[f"unmeth_k{k}"] == brute(text, "T", k), text
            assert row[f"total_k{k}"] == brute(text, "CT", k), text


def test_alpha_limits_are_included(spark):
    frame = spark.createDataFrame([(1, 4), (3, 4), (2, 4)], "meth_k1 bigint, total_k1 bigint")
    rows = scoring.flag_alpha(frame).orderBy("meth_k1").collect()
    assert [(r["frac_alpha_leq_25pct"], r["frac_alpha_geq_75pct"]) for r in rows] == [(1, 0), (0, 0), (0, 1)]


def test_explode_molecules(spark):
    frame = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2), ("d", 3)], "molecule_id string, number_molecules int")
    rows = scoring.explode_molecules(frame).collect()
    assert len(rows) == 6 and all(r["number_molecules"] == 1 for r in rows)
    assert len({(r["molecule_id"], r["copy_no"]) for r in rows}) == 6


def test_exploding_equals_molecule_weighting(reads):
    weighted = scoring.score_regions(reads, [], "molecules").first()
    exploded = scoring.score_regions(scoring.explode_molecules(reads), [], "rows").first()
    assert weighted == exploded


def test_parameters_are_checked(reads):
    with pytest.raises(ValueError):
        scoring.score_reads(reads, min_observed=0)
    with pytest.raises(ValueError):
        scoring.sum_scores(reads, [], weighting="other")
    with pytest.raises(ValueError):
        scoring.score_reads(reads, kmers=(3, 4))


def test_scoring_plan_stays_in_the_jvm(reads):
    plan = scoring.score_regions(reads.repartition(2), ["molecule_id"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "InPandas" not in plan
