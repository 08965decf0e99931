"""Helpers of the series tests; a module of its own, as several folders have a conftest."""


def column(df, name, code="a"):
    from pyspark.sql import functions as F

    return [r[0] for r in df.where(F.col("code") == code).orderBy("d").select(name).collect()]
