"""Bootstrap confidence intervals. Resampling n rows with k passes needs n and k alone: each mean is a binomial draw."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bootstrap_ci(problems: DataFrame, passed: str = "all_passed", resamples: int = 2000, seed: int = 0, groups: tuple[str, ...] = ()) -> DataFrame:
    """(groups.., n, k, lo, hi): the 95 % interval of the share that passed. Nothing: (0, 0).

    The draws of a group depend on seed, n and k, not on how rows are dealt out. Rows meet in an aggregate, so a task
    holds one row of counts a group.
    """
    counts = problems.groupBy(*groups).agg(F.count("*").alias("n"), F.count_if(F.col(passed)).alias("k"))

    @F.pandas_udf("struct<lo:double,hi:double>")
    def interval(n: pd.Series, k: pd.Series) -> pd.DataFrame:
        out = []
        for a, b in zip(n, k, strict=True):
            if not a:
                out.append((0.0, 0.0))
                continue
            means = np.sort(np.random.default_rng([seed, a, b]).binomial(a, b / a, resamples) / a)
            out.append((means[max(0, int(0.025 * resamples) - 1)], means[min(resamples - 1, int(0.975 * resamples))]))
        return pd.DataFrame(out, columns=["lo", "hi"])

    return counts.withColumn("ci", interval("n", "k")).select(*groups, "n", "k", "ci.lo", "ci.hi")
