"""Table schemas and the checks that keep dimension tables well formed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

READ_COLUMNS = [
    "sample_id", "molecule_id", "chr", "number_molecules",
    "cpg_index_min", "cpg_index_max", "pat_string",
]
REGION_BOUNDS = ["region_id", "region_cpg_index_min", "region_cpg_index_max"]


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()

READS = _struct(sample_id=_S, molecule_id=_S, chr=_S, number_molecules=_I,
                cpg_index_min=_L, cpg_index_max=_L, pat_string=_S)
REGIONS_BED = _struct(region_chr=_S, region_start=_L, region_end=_L,
                      region_cpg_index_min=_L, region_cpg_index_max=_L, region_id=_S)
CPG_MAP = _struct(chr=_S, start=_L, end=_L, cpg_index=_L, cpg_index_hg38=_L)
PANEL = _struct(region_id=_S, subpanel=_S, target_celltype=_S, v23_conv=_I)
SAMPLES = _struct(sample_id=_S, source=_S, sample_group=_S, cell_type=_S, age=_S)
DONORS = _struct(SAMPLE_ID=_S, DONOR_SEX=_S, DONOR_AGE=_S, CELL_TYPE=_S)


def score_columns(kmers=(1, 3, 4), rates_leq=(0.25,), rates_geq=(0.75,)) -> list[str]:
    """Names of the summed score columns, in table order."""
    return [f"{kind}_k{k}" for k in kmers for kind in ("meth", "unmeth", "total")] + \
        alpha_columns(rates_leq, rates_geq)


def alpha_columns(rates_leq=(0.25,), rates_geq=(0.75,)) -> list[str]:
    return ["frac_alpha_leq_%ipct" % (100 * r) for r in rates_leq] + \
        ["frac_alpha_geq_%ipct" % (100 * r) for r in rates_geq]


def scores_schema(keys: dict[str, T.DataType] | None = None, kmers=(1, 3, 4),
                  rates_leq=(0.25,), rates_geq=(0.75,)) -> T.StructType:
    """Schema of a region-score table with the given leading key columns."""
    fields = [T.StructField(k, t) for k, t in (keys or {}).items()]
    fields += [T.StructField("region_id", _S), T.StructField("number_molecules", _L)]
    alphas = alpha_columns(rates_leq, rates_geq)
    for name in score_columns(kmers, rates_leq, rates_geq):
        fields.append(T.StructField(name, _D if name in alphas else _L))
    return T.StructType(fields)


def assert_unique_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Raise if any key combination occurs twice; returns `df` otherwise.

    Duplicate keys in a label or atlas table would multiply rows in every later join.
    """
    duplicate = df.groupBy(*keys).count().where(F.col("count") > 1).limit(1).collect()
    if duplicate:
        raise ValueError(f"duplicate key {tuple(duplicate[0][k] for k in keys)} for {keys}")
    return df


def assert_valid_reads(df: DataFrame) -> DataFrame:
    """Raise if a read has null or reversed bounds, or a pattern of another length."""
    span = F.col("cpg_index_max") - F.col("cpg_index_min") + 1
    broken = (F.col("cpg_index_min").isNull() | F.col("cpg_index_max").isNull()
              | (span < 1) | (F.length("pat_string") != span))
    bad = df.where(broken).limit(1).collect()
    if bad:
        raise ValueError(f"malformed read {bad[0].asDict()}")
    return df
