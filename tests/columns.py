"""Helper of the column tests."""


def one_col(spark, values, expr, name="x"):
    """Evaluate a Column expression over a one-column string frame."""
    df = spark.createDataFrame([(v,) for v in values], f"{name} string")
    return [r[0] for r in df.select(expr(df[name])).collect()]
