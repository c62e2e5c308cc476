"""Label text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def proportion_label(name: Column, proportion: Column) -> Column:
    """`E` for "0." followed by the digits of the proportion rounded to 4 places and the
    upper-cased name: 0.015 of CD4 is `E015CD4`, 0 of Mono is `EMONO`, 1 of B is `E0B`."""
    digits = F.round(proportion, 4).cast("decimal(10,4)").cast("string")
    fraction = F.rtrim(F.substring_index(digits, ".", -1), F.lit("0"))
    shown = F.when(F.round(proportion, 4) >= 1, F.when(fraction == "", F.lit("0")).otherwise(fraction)) \
             .otherwise(fraction)
    return F.concat(F.lit("E"), shown, F.upper(name))
