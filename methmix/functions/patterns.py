"""Column expressions over methylation call strings (`C` methylated, `T` not, anything else
not observed). All of them stay inside generated JVM code; none calls Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = 31               # calls that fit a positive bigint at two bits each
_LOW_BITS = 0x1555555555555555  # the lower bit of each call


def trim_to_region(pat: Column, read_min: Column, read_max: Column,
                   region_min: Column, region_max: Column) -> Column:
    """Part of the call string that lies inside the closed region."""
    first = F.greatest(region_min - read_min, F.lit(0))
    last = F.least(region_max - read_min, read_max - read_min)
    return F.substring(pat, (first + 1).cast("int"), (last - first + 1).cast("int"))


def pack_calls(calls: Column) -> Column:
    """The call string as a number in base 4 (`.` 0, `C` 1, `T` 2); null if the string has other
    characters or does not fit one word."""
    plain = (F.length(calls) <= _WORD) & (F.translate(calls, "CT.", "") == "")
    number = F.conv(F.translate(calls, "CT.", "120"), 4, 10).cast("bigint")
    return F.when(plain, F.coalesce(number, F.lit(0).cast("bigint")))


def call_mask(packed: Column, letter: str) -> Column:
    """Bit mask of the calls equal to `letter`, two bits per call."""
    word = packed if letter == "C" else F.shiftright(packed, 1)
    return word.bitwiseAND(F.lit(_LOW_BITS))


def run_count(mask: Column, k: int) -> Column:
    """Number of (overlapping) windows of `k` marked calls: `CCCC` holds two windows of 3."""
    windows = mask
    for step in range(1, k):
        windows = windows.bitwiseAND(F.shiftright(mask, 2 * step))
    return F.bit_count(windows)


def run_count_text(calls: Column, letters: str, k: int) -> Column:
    """The same count on the string itself, for strings that cannot be packed."""
    return F.regexp_count(calls, F.lit(f"(?=[{letters}]{{{k}}})"))


def observed_calls(calls: Column) -> Column:
    """Number of calls that are `C` or `T`."""
    return F.length(calls) - F.length(F.translate(calls, "CT", ""))


def kmer_counts(calls: Column, meth: Column, unmeth: Column, k: int) -> dict[str, Column]:
    """`meth_k`, `unmeth_k` and `total_k` counts of a call string with its two masks."""
    masked = {
        f"meth_k{k}": (run_count(meth, k), "C"),
        f"unmeth_k{k}": (run_count(unmeth, k), "T"),
        f"total_k{k}": (run_count(meth.bitwiseOR(unmeth), k), "CT"),
    }
    return {
        name: F.when(meth.isNotNull(), fast)
               .otherwise(run_count_text(calls, letters, k)).cast("bigint")
        for name, (fast, letters) in masked.items()
    }
