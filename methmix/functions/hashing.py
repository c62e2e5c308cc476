"""Reproducible draws.

Every draw is a pure function of the row key, the seed and the design, so a lost task that runs
again draws the same rows, on any partitioning. One md5 is taken per row and one per mixture;
the draw for a (row, mixture) pair is the linear hash  (a*x + b*y + c) mod p,  which is
uniform and pairwise independent, and costs two multiplications.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prime modulus of the draw, hex digits (28 bits) per coefficient, seed range.
PRIME = 2147483647
HEX_DIGITS = 7
WORD = 16 ** HEX_DIGITS  # words are below this
SEED_RANGE = 1_000_001


def _word(digest: Column, index: int) -> Column:
    start = 1 + index * HEX_DIGITS
    return F.conv(F.substring(digest, start, HEX_DIGITS), 16, 10).cast("bigint")


def digest(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def row_words(row_digest: Column) -> dict[str, Column]:
    """The two words of a row key."""
    return {"row_x": _word(row_digest, 0), "row_y": _word(row_digest, 1)}


def mixture_words(mixture_digest: Column) -> dict[str, Column]:
    """The three coefficients of a mixture key."""
    return {
        "mix_a": _word(mixture_digest, 0) + 1,
        "mix_b": _word(mixture_digest, 1) + 1,
        "mix_c": _word(mixture_digest, 2),
    }


def place_words(number_digest: Column, place_digest: Column) -> dict[str, Column]:
    """The five coefficients of the places of a cell's points: where the first lies, and how far from one to the next."""
    return {
        "at_a": _word(place_digest, 0) + 1,
        "at_b": _word(place_digest, 1) + 1,
        "at_c": _word(place_digest, 2),
        "step_a": _word(place_digest, 3) + 1,
        "step_b": _word(number_digest, 3) + 1,
    }


WORDS = ["mix_a", "mix_b", "mix_c", "at_a", "at_b", "at_c", "step_a", "step_b"]
PLACES = ["_start", "_step"]


def places() -> dict[str, Column]:
    """Start and step of the points of a joined (row, cell) pair."""
    prime = F.lit(PRIME).cast("bigint")
    return {"_start": (F.col("at_a") * F.col("row_x") + F.col("at_b") * F.col("row_y") + F.col("at_c")) % prime,
            "_step": (F.col("step_a") * F.col("row_x") + F.col("step_b") * F.col("row_y") + F.lit(1)) % prime}


def place(i: Column) -> Column:
    """Place in [0, PRIME) of the `i`-th point: any two of a pair's points are independent."""
    return (F.col("_start") + i * F.col("_step")) % F.lit(PRIME).cast("bigint")


def draw() -> Column:
    """Integer draw in [0, PRIME) of a joined (row, mixture) pair."""
    total = F.col("mix_a") * F.col("row_x") + F.col("mix_b") * F.col("row_y") + F.col("mix_c")
    return total % F.lit(PRIME).cast("bigint")


def derived_seed(seed: Column, index: Column) -> Column:
    """`index`-th seed in [0, 10^6] derived from one seed."""
    return (F.conv(F.substring(digest(seed, index), 1, 8), 16, 10).cast("bigint")
            % F.lit(SEED_RANGE).cast("bigint"))
