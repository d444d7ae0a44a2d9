"""Clustering of token vectors: one k-means per token id, and the means that budgets of one come to."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lateloom.functions.shared import materialize, temporary
from lateloom.functions.vectors import normalize, rounded_by_product
from lateloom.params import ClusteringParams

from . import budget, kmeans, stats
from .kmeans import Fit, fit, nearest

__all__ = ["ClusterModel", "Fit", "assign_nearest", "cluster", "degenerate", "fit", "mean_centroids", "nearest"]


@dataclass
class ClusterModel:
    """budgets(token_id, ..., kappa_j, centroid_lo), centroids(centroid_id, token_id, local_k, raw) and assign(doc_id, pos, token_id, centroid_id, dist)."""

    budgets: DataFrame
    centroids: DataFrame
    assign: DataFrame


_OUT = "kind int, token_id long, doc_id long, pos int, local_k int, dist double, raw array<double>"


def cluster(tokens: DataFrame, p: ClusteringParams, task_rows: int | None = None) -> ClusterModel:
    """Budgets, then one k-means per token id, its seed derived from the id.

    A token of at most task_rows vectors (kmeans.TASK_ROWS) is fitted in one task, a larger one in blocks: by the same algorithm, with
    the same result. Only the result's tables stay.
    """
    p.check()
    most = kmeans.TASK_ROWS if task_rows is None else task_rows
    with temporary() as result:
        budgets = result(budget.allocate(stats.spread(tokens), p))
        budget.check(budgets, p)
        own = tokens.join(budgets.select("token_id", "n_j", "kappa_j"), "token_id")

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["doc_id", "pos"], kind="stable")
            token, k = int(pdf["token_id"].iloc[0]), int(pdf["kappa_j"].iloc[0])
            x = np.stack(pdf["vec"].to_numpy())
            f = fit(x, k, max_iters=p.max_iters, tol=p.tol, seed=p.seed ^ token, strict=p.strict)
            rows = pd.DataFrame({"kind": 0, "token_id": token, "doc_id": pdf["doc_id"], "pos": pdf["pos"], "local_k": f.assignments, "dist": ((x - f.centroids[f.assignments]) ** 2).sum(1), "raw": None})
            return pd.concat([rows, pd.DataFrame({"kind": 1, "token_id": token, "doc_id": 0, "pos": 0, "local_k": np.arange(k), "dist": 0.0, "raw": list(f.centroids)})])

        done = own.where(F.col("n_j") <= most).groupBy("token_id").applyInPandas(one, _OUT)
        if budgets.where(F.col("n_j") > most).limit(1).count():
            done = done.unionByName(_in_blocks(own.where(F.col("n_j") > most), p))
        done = result(done)
    ids = done.join(budgets.select("token_id", "centroid_lo"), "token_id").withColumn("centroid_id", (F.col("centroid_lo") + F.col("local_k")).cast("int"))
    centroids = ids.where("kind = 1").select("centroid_id", "token_id", "local_k", "raw")
    return ClusterModel(budgets, centroids, ids.where("kind = 0").select("doc_id", "pos", "token_id", "centroid_id", "dist"))


def _in_blocks(own: DataFrame, p: ClusteringParams) -> DataFrame:
    """Rows of _OUT for tokens that are too large for a task."""
    none, zero = F.lit(None).cast("array<double>"), F.lit(0)

    def kinds(rows: DataFrame, centroids: DataFrame) -> DataFrame:
        rows = rows.select(zero.alias("kind"), "token_id", "doc_id", "pos", F.col("local_k").cast("int").alias("local_k"), "dist", none.alias("raw"))
        return rows.unionByName(centroids.select(F.lit(1).alias("kind"), "token_id", zero.cast("long").alias("doc_id"), zero.alias("pos"), F.col("local_k").cast("int").alias("local_k"), F.lit(0.0).alias("dist"), "raw"))

    alone = own.where("kappa_j >= n_j")  # each vector is its own centroid, and the last fills up
    each = alone.withColumn("local_k", F.row_number().over(W.partitionBy("token_id").orderBy("doc_id", "pos")) - 1).withColumn("dist", F.lit(0.0))
    fill = each.where("local_k = n_j - 1 AND kappa_j > n_j").select("token_id", F.explode(F.expr("sequence(n_j, kappa_j - 1)")).alias("local_k"), F.col("vec").alias("raw"))
    out = kinds(each, each.select("token_id", "local_k", F.col("vec").alias("raw")).unionByName(fill))
    rest = own.where("kappa_j < n_j").withColumn("vec", F.col("vec").cast("array<double>"))
    if not rest.limit(1).count():
        return out
    blocks = materialize(kmeans.pack(rest.withColumnRenamed("token_id", "group").withColumn("pos", F.col("pos").cast("int"))))
    size = F.greatest(F.array_max(F.col("vec")), -F.array_min(F.col("vec")))
    groups = materialize(rest.groupBy("token_id", "kappa_j").agg(F.max(size).alias("largest"), F.max(F.size("vec")).alias("dim")))
    dim = groups.agg(F.max("dim")).first()[0]
    seed = F.col("group").bitwiseXOR(F.lit(p.seed).cast("long"))
    state = kmeans.fit_blocks(blocks, groups.select(F.col("token_id").alias("group"), F.col("kappa_j").alias("k"), "largest").withColumn("seed", seed), dim, max_iters=p.max_iters, tol=p.tol, strict=p.strict)
    centroids = kmeans.centroid_rows(state).select(F.col("group").alias("token_id"), F.col("place").alias("local_k"), "raw")
    return out.unionByName(kinds(kmeans.assignments(blocks, state).withColumnRenamed("group", "token_id"), centroids))


def mean_centroids(tokens: DataFrame, digits: int = 9) -> DataFrame:
    """One centroid per token id, its mean: what clustering gives where every budget is 1. centroid_id, token_id, raw and unit, rounded by the product, as the SQL's engine does."""
    means = tokens.select("token_id", F.posexplode("vec").alias("d", "x")).groupBy("token_id", "d").agg(rounded_by_product(F.avg("x"), digits).alias("x"))
    raw = means.groupBy("token_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("raw"))
    numbered = raw.withColumn("centroid_id", (F.row_number().over(W.orderBy("token_id")) - 1).cast("int"))  # a row for each token id
    return numbered.select("centroid_id", "token_id", "raw", F.transform(normalize(F.col("raw")), lambda x: rounded_by_product(x, digits)).alias("unit"))


def degenerate(tokens: DataFrame) -> DataFrame:
    """Each vector as its own centroid, numbered in order inside its token: what a budget of n_j or more gives."""
    return tokens.select("doc_id", "pos", "token_id", (F.row_number().over(W.partitionBy("token_id").orderBy("doc_id", "pos")) - 1).alias("local_k"))


def assign_nearest(vectors: DataFrame, centroids: DataFrame, column: str = "raw") -> DataFrame:
    """Adds centroid_id and dist of the nearest of all centroids, the least id of equal ones.

    Centroids that fit a block are broadcast; of more, each block meets the vectors in tasks of its own, and the nearest of all blocks stays.
    """
    from . import blocks

    def near(ids: np.ndarray, c: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, dist = nearest(x, c)
        return ids[at][:, None], dist[:, None]

    found = blocks.meet(vectors, ["doc_id", "pos", "token_id"], centroids, column, near, "centroid_id int, dist double")
    best = F.min(F.struct("dist", "centroid_id")).alias("best")
    return found.groupBy("doc_id", "pos", "token_id").agg(best).select("doc_id", "pos", "token_id", "best.centroid_id", "best.dist")
