"""The training mixture: rows of the main split and verified generated ones, by the shares of their slices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import contamination, dedup, sampling

# The main split's share, and the slices' shares of the generated rest. With the gated slices calculus gives up what they take.
MAIN_SHARE = 0.65
SHARES = {
    "calculus": 0.22, "vocab": 0.16, "multivariate": 0.12, "ode": 0.08, "summation": 0.04, "limits": 0.04, "series": 0.02, "polynomial": 0.05,
    "matrix": 0.03, "combinatorics": 0.02, "sequences": 0.04, "geometry": 0.03, "numtheory": 0.03, "rational": 0.08, "edge": 0.04,
}
GATED_SHARES = {"special": 0.04, "stats": 0.04, "sets": 0.04, "algebraic": 0.04}
CALCULUS_BESIDE_GATED = 0.06


def slice_shares(include_gated: bool = False) -> dict[str, float]:
    return SHARES | {"calculus": CALCULUS_BESIDE_GATED} | GATED_SHARES if include_gated else SHARES


def candidates(main: DataFrame, made: DataFrame, include_gated: bool = False) -> DataFrame:
    """made's rows that may be taken: no text of main's, the first by row_no of each text and outputs, gated ones only if asked for.

    A null `gated` counts as false. A text may repeat with other outputs. Null texts are known as alike, but never main's.
    """
    rows = contamination.split(made, contamination.frozen_keys([main], "latex_expression"), "latex_expression")[0]
    # The gate comes after the dedup: a gated row may be the first of its text.
    first = dedup.keep_first(rows.withColumn("_outputs", dedup.outputs_key()), ["latex_expression", "_outputs"], ["row_no"]).drop("_outputs")
    return first if include_gated else first.where(~F.coalesce(F.col("gated"), F.lit(False)))


def training_mixture(main: DataFrame, made: DataFrame, frozen: DataFrame, n: int, seed: str, include_gated: bool = False) -> DataFrame:
    """n rows, in hash order: MAIN_SHARE of them from main or all it has, the rest from made by slice_shares(), filled up from whatever made has left.

    main(task_id, latex_expression, ..), made(task_id, latex_expression, slice, gated, row_no, test_cases, ..); task_id is unique within each. Slices that fall short are made good by
    the others; if all do, fewer rows come. Where rounding the shares
    gives more rows than are wanted, the last ones in hash order go. An error if a taken row's text is in frozen(latex_expression): nothing is to be written then.
    """
    taken = sampling.exact_sample(main, round(n * MAIN_SHARE), "task_id", seed)
    want = n - taken.count()
    shares = main.sparkSession.createDataFrame(list(slice_shares(include_gated).items()), "slice string, share double")
    pool = candidates(main, made, include_gated)
    rest = sampling.fill_up(sampling.proportional(pool, "slice", F.broadcast(shares), want, "task_id", seed), pool, want, "task_id", f"{seed}-fill")
    both = contamination.require_clean(dedup.bag_union(taken, rest), frozen, "latex_expression")
    return sampling.ordered(both, "task_id", f"{seed}-order").orderBy("_h", "task_id").drop("_h")
