"""Writers. Parquet is the default between stages; single CSV files are for export."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat_for_csv(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields])


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    out = flat_for_csv(df)
    (out.coalesce(1) if single else out).write.mode("overwrite").options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_by_source(df: DataFrame, path: str, source: str = "source") -> None:
    """Rows replace those of the same source and leave others: running it again changes nothing."""
    df.write.mode("overwrite").partitionBy(source).option("partitionOverwriteMode", "dynamic").parquet(path)


def save_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def work_folder(spark: SparkSession, label: str) -> str:
    """A new name below the folder that the driver and all executors see (spark.checkpoint.dir).

    Where that is unset and all runs on one machine, a temporary folder stands in.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors see")
        base = "file://" + tempfile.mkdtemp(prefix="listingloom-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df written to a work folder and read back: what is read several times is made once."""
    folder = work_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def write_lines(df: DataFrame, path: str, line: str = "value", single: bool = False) -> None:
    """One text column as lines in df's order: a file for each partition, whose names follow that order."""
    out = df.select(line)
    (out.coalesce(1) if single else out).write.mode("overwrite").text(path)
