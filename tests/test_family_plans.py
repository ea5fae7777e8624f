"""The families that were measured at 60 times sf0.1: their plans hold the search for points once, and many tasks do it."""

import pytest

from millrace.operators import generators as g

NAMES = ["polynomial_invariants", "differential_c1", "ode", "derivative", "elementary_ext", "stats_moments", "geometry_ext", "summation", "combinatorics", "complex_eval", "multivariate", "edge", "limits", "geometry", "functions", "integration"]


@pytest.mark.parametrize("name", NAMES)
def test_a_family_s_points_are_found_once_by_many_tasks(spark, name):
    df = g.generate(spark.range(100, numPartitions=1).withColumnRenamed("id", "i"), name, "1", include_gated=True)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("zip_with(") == 1
    assert df.rdd.getNumPartitions() > 1
