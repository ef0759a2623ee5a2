"""Reading a table folder that may not exist yet."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, schema: T.StructType, may_be_new: bool = True) -> DataFrame:
    """Parquet under an explicit schema. An absent folder is an empty table if the
    caller says that the table ``may_be_new``, else an error."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as failure:
        if failure.getCondition() != "PATH_NOT_FOUND" or not may_be_new:
            raise
        return spark.createDataFrame([], schema)
