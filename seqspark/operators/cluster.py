"""Initial picks by clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqspark.functions.exprs import uniform


def cluster_picks(embeddings: DataFrame, n: int, seed: int = 42, key: str = "seq_id") -> DataFrame:
    """n keys: of each of n clusters the member nearest to the centre; empty clusters are made up for by random rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = embeddings.select(key, array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=n, seed=seed, maxIter=10).fit(rows)
    centres = F.array(*(F.array(*(F.lit(float(x)) for x in c)) for c in model.clusterCenters()))
    own = model.transform(rows).select(key, "prediction", vector_to_array("features").alias("e"))
    d = F.aggregate(F.zip_with("e", centres[F.col("prediction")], lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    nearest = own.withColumn("r", F.row_number().over(Window.partitionBy("prediction").orderBy(d, key))).where("r = 1").select(key, F.lit(0).alias("turn"))
    rest = embeddings.select(key, F.lit(1).alias("turn")).join(nearest.select(key), key, "left_anti")
    return nearest.unionByName(rest).orderBy("turn", uniform(seed, key), key).limit(n).select(key)
