"""Live score logs: ingestion, running best, windows and leaderboard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspark.operators.select import leaderboard


def score_stream(spark: SparkSession, path: str, schema, late: str = "10 minutes", keys: tuple[str, ...] = ("sequence", "iteration")) -> DataFrame:
    """Rows of a growing folder, one for each key within the watermark; later rows are dropped."""
    return spark.readStream.schema(schema).parquet(path).withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def running_best(rows: DataFrame, by: str = "phase") -> DataFrame:
    """Best and worst objective of each group so far; for update or complete mode."""
    return rows.groupBy(by).agg(F.max("objective").alias("best"), F.min("objective").alias("worst"), F.count("*").alias("n"))


def throughput(rows: DataFrame, size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Rows and mean objective of each window of event time; tumbling, or sliding by ``slide``."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return rows.groupBy(window.alias("w")).agg(F.count("*").alias("n"), F.avg("objective").alias("mean_objective")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean_objective")


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches whose state was written whole."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    p = jvm.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n) for n in names if n.isdigit() and fs.exists(jvm.Path(f"{path}/{n}/_SUCCESS")))


def _forget(spark: SparkSession, path: str, numbers: list[int]) -> None:
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    for n in numbers:
        p = jvm.Path(f"{path}/{n}")
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def live_leaderboard(rows: DataFrame, state_path: str, n: int, checkpoint: str):
    """Runs once over what is there and returns the best n sequences so far.

    The state is n rows at most: a sequence's best only rises, so one that fell out of them can come back by a row of its own alone. Batch k merges its
    rows into the last state before k and writes state k, so a batch that is run again gives the same, and a start without new rows returns the last state. The
    state before the last is kept for that; older ones are deleted.
    """
    spark = rows.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        new = batch.where("objective is not null").select("sequence", "objective")
        before = [v for v in _versions(spark, state_path) if v < number]
        if before:
            new = new.unionByName(spark.read.parquet(f"{state_path}/{before[-1]}"))
        best = new.groupBy("sequence").agg(F.max("objective").alias("objective"))
        best.orderBy(F.desc("objective"), "sequence").limit(n).write.mode("overwrite").parquet(f"{state_path}/{number}")
        _forget(spark, state_path, before[:-1])

    rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    known = _versions(spark, state_path)
    state = spark.read.parquet(f"{state_path}/{known[-1]}") if known else spark.createDataFrame([], rows.select("sequence", "objective").schema)
    return leaderboard(state, n)
