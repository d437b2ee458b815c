"""Tables written by the jobs (SNK-3, SNK-4, SNK-6, SNK-7)."""

from __future__ import annotations

from pyspark.ml.feature import MinMaxScalerModel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def write_threshold(threshold: DataFrame, path: str) -> None:
    """One row, so one file."""
    threshold.coalesce(1).write.mode("overwrite").parquet(path)


def save_scaler(model: MinMaxScalerModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_scaler(path: str) -> MinMaxScalerModel:
    return MinMaxScalerModel.load(path)


def stored(df: DataFrame, path: str) -> DataFrame:
    """The frame as a table on disk, whose size the planner then knows.

    For bounds per series: joined as a table they are broadcast only if they are
    small enough, without shuffling the readings to find that out.
    """
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a stored table that a job is done with, on whatever file system it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def with_date(points: DataFrame) -> DataFrame:
    """The archive's partition column."""
    return points.withColumn("date", F.to_date("_time"))


def write_archive(points: DataFrame, path: str, mode: str = "append") -> None:
    """Points to Parquet, partitioned by ``key`` and ``date``.

    Rebalancing gathers small partitions into one file and splits large ones,
    so a key with most of the points is still written by many tasks.
    """
    (
        with_date(points)
        .hint("rebalance", "key", "date")
        .write.mode(mode)
        .partitionBy("key", "date")
        .parquet(path)
    )


def write_batch(points: DataFrame, path: str, number: int) -> None:
    """A numbered batch of points to its own folder of the archive, in place of an earlier try."""
    write_archive(points, f"{path}/batch={number}", mode="overwrite")


def preview(df: DataFrame, order_by: list[str], n: int = 2) -> tuple[StructType, DataFrame]:
    """Schema and the first ``n`` rows of a stated order."""
    return df.schema, df.orderBy(*order_by).limit(n)


def schema_rows(df: DataFrame) -> DataFrame:
    """The schema as rows, one per column, with the number of rows and of nulls in it; one pass."""
    fields = df.schema.fields
    counted = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(F.col(f"`{f.name}`")).alias(f"n{i}") for i, f in enumerate(fields)],
    )
    described = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(f.name).alias("name"),
            F.lit(f.dataType.simpleString()).alias("type"),
            F.col("n").alias("n_rows"),
            (F.col("n") - F.col(f"n{i}")).alias("n_nulls"),
        )
        for i, f in enumerate(fields)
    ]
    return counted.select(F.inline(F.array(*described)))
