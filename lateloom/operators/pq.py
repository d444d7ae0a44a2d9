"""Product quantisation: M sub-vectors, each coded by the nearest of 256 codewords."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lateloom.functions.shared import materialize, temporary
from lateloom.params import PQ_CODES, PQ_M, DimNotDivisibleByM

from . import kmeans

_SCHEMA = "m int, code int, sub array<double>"


def train(residuals: DataFrame, *, m: int = PQ_M, codes: int = PQ_CODES, seed: int = 42, max_train: int | None = None, task_rows: int | None = None, max_iters: int = 25) -> DataFrame:
    """The codebook (m, code, sub) from residuals(doc_id, pos, unit): one k-means per sub-space, of all rows.

    At most task_rows (kmeans.TASK_ROWS) go to a task for each sub-space; more are packed whole, and each pass over
    the blocks adds up all sub-spaces: the same algorithm, with the same result. max_train, where given, takes about so many rows of least hash.
    """
    most = kmeans.TASK_ROWS if task_rows is None else task_rows
    rows = residuals.select("doc_id", F.col("pos").cast("int").alias("pos"), F.col("unit").cast("array<double>").alias("vec"))
    size = F.greatest(F.array_max("vec"), -F.array_min("vec"))
    n_rows, dim, largest = rows.agg(F.count("*"), F.max(F.size("vec")), F.max(size)).first()
    if max_train is not None and n_rows > max_train:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", "pos"), F.lit(1 << 32)) < F.lit((1 << 32) * max_train // n_rows))
        n_rows, largest = rows.agg(F.count("*"), F.max(size)).first()
    dim = dim or 0
    if dim % m:
        raise DimNotDivisibleByM(f"{dim} is not divisible by {m}")
    n = dim // m
    if n_rows > max(most, codes):
        with temporary() as result:
            packed = materialize(kmeans.pack(rows.withColumn("group", F.lit(0).cast("long"))))
            group = rows.sparkSession.createDataFrame([(0, codes, seed, float(largest))], "group long, k int, seed long, largest double")
            state = kmeans.fit_blocks(packed, group, n, subs=m, max_iters=max_iters)
            return result(kmeans.centroid_rows(state).select(F.col("sub").alias("m"), F.col("place").alias("code"), F.col("raw").alias("sub")))
    parts = rows.select("doc_id", "pos", F.explode(F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.struct(i.alias("m"), F.slice("vec", i * n + 1, n).alias("sub")))).alias("p"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "pos"], kind="stable")
        k = int(pdf["m"].iloc[0])
        return pd.DataFrame({"m": k, "code": np.arange(codes), "sub": list(kmeans.fit(np.stack(pdf["sub"].to_numpy()), codes, seed=seed + k, largest=largest, max_iters=max_iters).centroids)})

    return parts.select("doc_id", "pos", "p.m", "p.sub").groupBy("m").applyInPandas(one, _SCHEMA)


def book(codebook: DataFrame) -> np.ndarray:
    """The codebook as an array (m, code, component): m * 256 rows, whatever the corpus."""
    rows = codebook.orderBy("m", "code").collect()
    m = max(r["m"] for r in rows) + 1
    return np.array([r["sub"] for r in rows], np.float64).reshape(m, -1, len(rows[0]["sub"]))


def encode_rows(x: np.ndarray, codewords: np.ndarray) -> np.ndarray:
    """Codes of rows: the nearest codeword in each sub-space, the lowest of equal ones."""
    m, _, n = codewords.shape
    out = np.empty((len(x), m), np.uint8)
    parts = x.reshape(len(x), m, n)
    for a in range(0, len(x), 1024):
        for j in range(m):
            d = np.zeros((len(parts[a : a + 1024]), codewords.shape[1]))
            for c in range(n):
                e = parts[a : a + 1024, j, c, None] - codewords[j, :, c]
                d += e * e
            out[a : a + 1024, j] = d.argmin(1)
    return out


def decode_rows(codes: np.ndarray, codewords: np.ndarray) -> np.ndarray:
    return codewords[np.arange(codes.shape[1]), codes].reshape(len(codes), -1)


def encode(residuals: DataFrame, codebook: DataFrame) -> DataFrame:
    """Adds codes, M bytes, to residuals(..., unit)."""
    shared = residuals.sparkSession.sparkContext.broadcast(book(codebook))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in residuals.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("unit").to_pylist(), np.float64)
            codes = encode_rows(x, shared.value) if len(x) else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary())], [*batch.schema.names, "codes"])

    return residuals.mapInArrow(run, f"{schema}, codes binary")


def explode_codes(coded: DataFrame) -> DataFrame:
    """doc_id, pos, m and code from the packed codes."""
    m = F.explode(F.sequence(F.lit(0), F.length("codes") - 1)).alias("m")
    return coded.select("doc_id", "pos", "codes", m).select("doc_id", "pos", "m", F.expr("cast(conv(hex(substring(codes, m + 1, 1)), 16, 10) as int)").alias("code"))


def decode(codes: DataFrame, codebook: DataFrame) -> DataFrame:
    """doc_id, pos, d and x: the decoded components of exploded codes. The codebook's rows are few whatever the corpus."""
    n = F.size("sub")
    joined = codes.join(F.broadcast(codebook), ["m", "code"])
    return joined.select("doc_id", "pos", "m", n.alias("n"), F.posexplode("sub").alias("c", "x")).select("doc_id", "pos", (F.col("m") * F.col("n") + F.col("c")).alias("d"), "x")


def distance_table(query_tokens: DataFrame, codebook: DataFrame) -> DataFrame:
    """qid, qpos, m, code and ip, the inner product of a query's sub-vector and a codeword."""
    from lateloom.functions.vectors import dot

    joined = query_tokens.join(F.broadcast(codebook))
    return joined.select("qid", "qpos", "m", "code", dot(F.slice("vec", F.col("m") * F.size("sub") + 1, F.size("sub")), F.col("sub")).alias("ip"))
