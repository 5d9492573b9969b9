"""Summary statistics with the library's empty-group conventions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summary_stats(df: DataFrame, by: list[str], col: str, prefix: str = "") -> DataFrame:
    """count, sum, mean, sample variance, std, min, max of ``col`` per group.

    NULLs are skipped; an empty group gives 0 everywhere, and spread is 0 below two samples.
    """
    x = F.col(col).cast("double")
    zero = F.lit(0.0)
    var = F.coalesce(F.var_samp(x), zero)
    return df.groupBy(*by).agg(
        F.count(x).alias(prefix + "count"),
        F.coalesce(F.sum(x), zero).alias(prefix + "sum"),
        F.coalesce(F.avg(x), zero).alias(prefix + "mean"),
        var.alias(prefix + "variance"),
        F.sqrt(var).alias(prefix + "std"),
        F.coalesce(F.min(x), zero).alias(prefix + "min"),
        F.coalesce(F.max(x), zero).alias(prefix + "max"),
    )
