"""Intermediate tables in the folder that the session shares."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.checkpoints import work_dir


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as a table in the shared folder and continue from its files."""
    path = work_dir(df.sparkSession)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """Like ``stored``, but divided by ``key``: joins and groups on it find their rows together, without a shuffle.

    Spark writes such files only under a name; the name goes at once, the files stay for the returned table.
    """
    spark = df.sparkSession
    parts, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"t_{uuid.uuid4().hex}"
    df.repartition(parts, key).write.bucketBy(parts, key).option("path", work_dir(spark)).option("compression", "zstd").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that no later step reads."""
    for df in tables:
        for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def whole_text(text: str) -> Column:
    """The text, empty for NULL."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def whole_number(value: int) -> Column:
    """A literal of more than 64 bits."""
    return F.lit(str(value)).cast("decimal(20,0)")
