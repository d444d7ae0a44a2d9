"""Building, saving and loading an index: a folder of tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lateloom.functions.arrays import lists, matrix
from lateloom.functions.shared import materialize
from lateloom.functions.vectors import norm, normalize, rounded_by_product
from lateloom.params import HNSW_M, PQ_M, ClusteringParams, IndexCorrupt, IndexExists

from . import cluster as clustering
from . import hnsw, pq

VERSION = 1
_TABLES = ("centroids", "postings", "codebook", "doc_packs")
_OPTIONAL = ("graph",)


@dataclass
class Index:
    """centroids(centroid_id, token_id, raw, unit), postings(centroid_id, doc_id), codebook(m, code, sub), doc_packs(doc_id, centroid_ids, norms, codes), and graph, if it has one (hnsw.graph)."""

    centroids: DataFrame
    postings: DataFrame
    codebook: DataFrame
    doc_packs: DataFrame
    graph: DataFrame | None = None


def with_graph(index: Index, *, m: int = HNSW_M, ef_build: int = 200, seed: int = 42) -> Index:
    """The same index with graphs over its centroids, built by tasks and stored."""
    return replace(index, graph=materialize(hnsw.graph(index.centroids, m=m, ef_build=ef_build, seed=seed)))


def residuals(tokens: DataFrame, centroids: DataFrame, digits: int | None = None, base: str = "unit") -> DataFrame:
    """doc_id, pos, centroid_id, residual_norm and unit (the residual at length 1; a zero residual stays).

    tokens must carry centroid_id. The residual is to the centroid at length 1, which scoring uses too; base="raw" takes it to
    the mean as it is, as in the established definition, and finds less.
    """
    r = F.zip_with("vec", base, lambda x, c: x - c)
    own = tokens.join(centroids.select("centroid_id", base), "centroid_id").withColumn("residual", r)
    n, u = norm(F.col("residual")), normalize(F.col("residual"))
    if digits is not None:
        n, u = (F.transform(v, lambda x: rounded_by_product(x, digits)) for v in (F.array(n), u))
        n = n[0]  # the length is worked out once
    return own.select("doc_id", "pos", "centroid_id", n.alias("residual_norm"), u.alias("unit"))


def postings(assigned: DataFrame) -> DataFrame:
    """The distinct documents of each centroid."""
    return assigned.select("centroid_id", "doc_id").distinct()


def posting_lists(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("centroid_id").agg(F.sort_array(F.collect_list("doc_id")).alias("docs"))


def doc_packs(coded: DataFrame) -> DataFrame:
    """One row for each document: its tokens' centroids, norms and codes, in order."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "centroid_id", "residual_norm", "codes")))
    packed = coded.groupBy("doc_id").agg(rows.alias("t"))
    codes = F.unhex(F.aggregate("t", F.lit(""), lambda s, t: F.concat(s, F.hex(t["codes"]))))
    return packed.select("doc_id", F.transform("t", lambda t: t["centroid_id"]).alias("centroid_ids"), F.transform("t", lambda t: t["residual_norm"]).alias("norms"), codes.alias("codes"))


def assemble(tokens: DataFrame, centroids: DataFrame, codebook: DataFrame | None = None, *, m: int = PQ_M, seed: int = 42, max_train: int | None = None, digits: int | None = None, base: str = "unit") -> Index:
    """An index from tokens that carry centroid_id, and centroids with raw and unit."""
    rest = residuals(tokens, centroids, digits, base)
    codebook = codebook if codebook is not None else materialize(pq.train(rest, m=m, seed=seed, max_train=max_train))
    return Index(centroids, postings(tokens), codebook, doc_packs(pq.encode(rest, codebook)))


def clustered(tokens: DataFrame, p: ClusteringParams) -> tuple[DataFrame, DataFrame]:
    """Tokens with the centroids that clustering gives them, and these centroids: what build() encodes."""
    model = clustering.cluster(tokens, p)
    centroids = materialize(model.centroids.withColumn("unit", normalize(F.col("raw"))))
    return materialize(tokens.join(model.assign.select("doc_id", "pos", "centroid_id"), ["doc_id", "pos"])), centroids


def build(tokens: DataFrame, p: ClusteringParams, *, m: int = PQ_M, max_train: int | None = None, base: str = "unit", of: tuple[DataFrame, DataFrame] | None = None) -> Index:
    """Clusters, then encodes residuals. Each stage's table is kept in the shared folder while the next uses it. of: what clustered() gave for the same tokens and p."""
    assigned, centroids = of or clustered(tokens, p)
    return assemble(assigned, centroids, m=m, seed=p.seed + 0xA1B2C3D4, max_train=max_train, base=base)


def _figures(df: DataFrame) -> tuple[int, int]:
    """Rows, and an order-free checksum."""
    r = df.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64(*df.columns)), F.lit(0).cast("long"))).first()
    return int(r[0]), int(r[1])


#: Ids that a lookup hands to the scan.
LOOKUP_IDS = 10_000


def lookup(packs: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """doc_id, n_tokens and centroid_ids of the documents asked for (doc_id); one that the index doesn't have has no tokens.

    Up to LOOKUP_IDS ids are part of the scan's filter, so that of a saved index, whose packs are in order of doc_id, only the row groups
    that can hold them are read; more ids are joined.
    """
    asked = doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    ids = [r["doc_id"] for r in asked.limit(LOOKUP_IDS + 1).collect()]
    own = packs.select("doc_id", "centroid_ids")
    if len(ids) <= LOOKUP_IDS:
        own = own.where(F.col("doc_id").isin([i for i in ids if i is not None]))
    return asked.join(own, "doc_id", "left").select("doc_id", F.greatest(F.coalesce(F.size("centroid_ids"), F.lit(0)), F.lit(0)).alias("n_tokens"), "centroid_ids")


def save(index: Index, path: str, *, doc_parts: int | None = None) -> None:
    """Writes the tables beside path, which must not exist, and then renames the folder. The meta table is written last: a folder without it is no index."""
    spark = index.centroids.sparkSession
    jvm = spark.sparkContext._jvm
    target, hidden = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path.rstrip('/')}.{uuid.uuid4().hex}"))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise IndexExists(path)
    _write(index, hidden.toString(), doc_parts)
    if not fs.rename(hidden, target):
        raise IndexExists(path)


def _write(index: Index, path: str, doc_parts: int | None) -> None:
    spark = index.centroids.sparkSession
    meta = []
    for name in (*_TABLES, *(o for o in _OPTIONAL if getattr(index, o) is not None)):
        df: DataFrame = getattr(index, name)
        key = {"doc_packs": "doc_id", "postings": "centroid_id"}.get(name)
        if key:
            df = (df.repartitionByRange(doc_parts, key) if doc_parts else df.repartitionByRange(key)).sortWithinPartitions(key)
        df.write.parquet(f"{path}/{name}")
        meta.append((VERSION, name, *_figures(spark.read.parquet(f"{path}/{name}"))))
    spark.createDataFrame(meta, "version int, name string, n_rows long, checksum long").coalesce(1).write.parquet(f"{path}/meta")


def load(spark: SparkSession, path: str, *, verify: bool = True) -> Index:
    """Reads an index; verify: recounts rows and checksums, and refuses a folder that was changed."""
    try:
        meta = {r["name"]: r for r in spark.read.parquet(f"{path}/meta").collect()}
    except Exception as e:
        raise IndexCorrupt(f"{path} has no meta table") from e
    if not set(_TABLES) <= set(meta) <= {*_TABLES, *_OPTIONAL} or any(r["version"] != VERSION for r in meta.values()):
        raise IndexCorrupt(f"{path} has another version or other tables")
    tables = {}
    for name in meta:
        try:
            tables[name] = spark.read.parquet(f"{path}/{name}")
            if verify and _figures(tables[name]) != (meta[name]["n_rows"], meta[name]["checksum"]):
                raise IndexCorrupt(f"{name} was changed")
        except IndexCorrupt:
            raise
        except Exception as e:
            raise IndexCorrupt(f"{name} can't be read") from e
    return Index(**tables)


def reconstruct(packs: DataFrame, centroids: DataFrame, codebook: DataFrame, column: str = "unit") -> DataFrame:
    """doc_id, pos and vec of every token as the index has it: its centroid plus norm times decoded residual."""
    shared = packs.sparkSession.sparkContext.broadcast(pq.book(codebook))
    one = packs.select("doc_id", F.posexplode(F.arrays_zip("centroid_ids", "norms")).alias("pos", "t"), "codes").select("doc_id", "pos", F.col("t.centroid_ids").alias("centroid_id"), F.col("t.norms").alias("norm"), "codes")
    joined = one.join(centroids.select("centroid_id", F.col(column).alias("c")), "centroid_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        m = words.shape[0]
        for batch in batches:
            if not len(batch):
                continue
            own = np.frombuffer(b"".join(c[p * m : (p + 1) * m] for c, p in zip(batch.column("codes").to_pylist(), batch.column("pos").to_pylist(), strict=True)), np.uint8).reshape(-1, m)
            x = matrix(batch.column("c")) + batch.column("norm").to_numpy()[:, None] * pq.decode_rows(own, words)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("pos"), lists(x)], ["doc_id", "pos", "vec"])

    return joined.select("doc_id", "pos", "norm", "codes", "c").mapInArrow(run, "doc_id long, pos int, vec array<double>")
