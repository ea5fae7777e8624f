"""Explicit schemas of the nested data. Inference would merge the open-keyed inputs into one struct."""

from pyspark.sql import types as T

CASE = T.StructType([T.StructField("input", T.MapType(T.StringType(), T.StringType())), T.StructField("output", T.StringType())])
#: A problem as read; `row_no` (file order) is added by the reader.
PROBLEM = T.StructType(
    [
        T.StructField("task_id", T.StringType()),
        T.StructField("latex_expression", T.StringType()),
        T.StructField("solution", T.StringType()),
        T.StructField("sympy_exp", T.StringType()),
        T.StructField("truth_code", T.StringType()),
        T.StructField("test_cases", T.ArrayType(CASE)),
        T.StructField("domain", T.StringType()),
        T.StructField("equation_type", T.StringType()),
        T.StructField("complexity", T.StringType()),
        T.StructField("output_type", T.StringType()),
        T.StructField("synthetic", T.BooleanType()),
        T.StructField("metadata", T.StringType()),
    ]
)
PREDICTION = T.StructType([T.StructField("id", T.StringType()), T.StructField("outputs", T.StringType())])
CODE = T.StructType([T.StructField("id", T.StringType()), T.StructField("code", T.StringType())])
EXECUTION = T.StructType(
    [
        T.StructField("exit_code", T.IntegerType()),
        T.StructField("stdout", T.StringType()),
        T.StructField("stderr", T.StringType()),
        T.StructField("timed_out", T.BooleanType()),
        T.StructField("safety_error", T.StringType()),
    ]
)
