"""Users in few dimensions: truncated singular value decomposition of their TF-IDF rows, clusters of them, saved models."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg import Vectors
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifeloom.operators.specialists import tfidf
from lifeloom.session import cut_lineage


def factors(counts: DataFrame, k: int = 100) -> tuple[DataFrame, list[float]]:
    """((user, features vector), singular values): the TF-IDF matrix projected on its k main right singular vectors.

    Users stay distributed as sparse rows; what the driver holds and sends out is k numbers for each property, as
    properties are the few columns of the matrix and users its many rows. Fewer than k are found if the matrix has a
    lower rank. The signs of a singular vector are free, so features of two runs may differ in sign.
    """
    spark = counts.sparkSession
    scored = cut_lineage(tfidf(counts).select("user", "property", "tfidf"))
    names = [r[0] for r in scored.select("property").distinct().orderBy("property").collect()]  # the matrix's columns
    index = F.broadcast(spark.createDataFrame(list(enumerate(names)), "at int, property string"))
    rows = scored.join(index, "property").groupBy("user").agg(F.array_sort(F.collect_list(F.struct("at", "tfidf"))).alias("cells"))
    n = len(names)
    svd = RowMatrix(rows.select("cells").rdd.map(lambda r: Vectors.sparse(n, [(c.at, c.tfidf) for c in r.cells]))).computeSVD(min(k, n), rCond=1e-9)
    basis = svd.V.toArray()
    sides = F.broadcast(spark.createDataFrame([(p, [float(x) for x in v]) for p, v in zip(names, basis, strict=True)], "property string, v array<double>"))
    sums = scored.join(sides, "property").groupBy("user").agg(*(F.sum(F.col("tfidf") * F.col("v")[j]).alias(f"f{j}") for j in range(basis.shape[1])))
    return sums.select("user", array_to_vector(F.array(*(f"f{j}" for j in range(basis.shape[1])))).alias("features")), [float(x) for x in svd.s]


def clusters(features: DataFrame, k: int, seed: int = 42) -> tuple[DataFrame, KMeansModel]:
    """((user, cluster), model) by k-means.

    It stands in for density clustering, which no distributed library of Spark offers: it gives each user a cluster and
    leaves none out as noise. Labels of another method can be used in its place wherever clusters are asked for.
    """
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(features)
    return model.transform(features).select("user", "cluster"), model


def save_model(model: KMeansModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> KMeansModel:
    return KMeansModel.load(path)
