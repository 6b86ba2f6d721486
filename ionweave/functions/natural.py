"""Natural order: digits compare as numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def natural_key(text: Column) -> Column:
    """An array to sort by: each run of digits with its length before it, other runs as they are.

    Numbers of any length compare by value, and a number comes before other text.
    """
    runs = F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), F.lit(1))

    def key(run: Column) -> Column:
        bare = F.regexp_replace(run, "^0+(?=.)", "")
        return F.when(run.rlike(r"^\d"), F.concat(F.lit("0"), F.lpad(F.length(bare).cast("string"), 9, "0"), bare)).otherwise(F.concat(F.lit("1"), run))

    return F.transform(runs, key)
