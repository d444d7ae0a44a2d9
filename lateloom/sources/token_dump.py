"""The binary token dump (fixed format): a 40-byte header, offsets of documents, token ids and vectors, little-endian; and a synthetic corpus."""

from __future__ import annotations

import struct
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from lateloom.functions.arrays import lists, matrix
from lateloom.params import MAX_DIM, MAX_ID, InvalidTokenDump, QidCountMismatch, QidOutOfRange

#: Fixed values of the format.
MAGIC, FORMAT, HEADER = b"TAC_TKN1", 2, struct.Struct("<8sIIQQB7s")
TOOL = "1"
TOKENS = "doc_id long, pos int, token_id long, vec array<float>"


def parse(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, token ids and vectors; anything but a sound dump is refused."""
    dim, docs, tokens = _head(raw, len(raw))
    offsets = np.frombuffer(raw, "<u8", docs + 1, HEADER.size)
    ids = np.frombuffer(raw, "<u4", tokens, HEADER.size + 8 * (docs + 1))
    vectors = np.frombuffer(raw, "<f4", tokens * dim, HEADER.size + 8 * (docs + 1) + 4 * tokens).reshape(tokens, dim)
    if offsets[0] or offsets[-1] != tokens or (np.diff(offsets.astype(np.int64)) < 0).any():
        raise InvalidTokenDump("offsets are not in order")
    if not np.isfinite(vectors).all():
        raise InvalidTokenDump("a component is not finite")
    return offsets, ids, vectors


def to_bytes(offsets: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> bytes:
    raw = HEADER.pack(MAGIC, FORMAT, vectors.shape[1], len(offsets) - 1, len(ids), 0, bytes(7)) + np.asarray(offsets, "<u8").tobytes() + np.asarray(ids, "<u4").tobytes() + np.asarray(vectors, "<f4").tobytes()
    parse(raw)
    return raw


def read(spark: SparkSession, path: str, *, docs_per_part: int = 4096) -> DataFrame:
    """Tokens of one dump, or of a folder of them, by the data source: documents are numbered on from file to file, in the order of their names."""
    spark.dataSource.register(TokenDumpSource)
    return spark.read.format("tokendump").option("docs_per_part", str(docs_per_part)).load(path)


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri(path if path.startswith("file:") else f"file://{path}")


def _files(path: str) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    system, own = _file_system(path)
    info = system.get_file_info(own)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(own, allow_not_found=True))
    return system, sorted((f for f in found if f.is_file and not f.base_name.startswith(("_", "."))), key=lambda f: f.base_name)


def _head(raw: bytes, size: int) -> tuple[int, int, int]:
    """dim, documents and tokens of a header, of a file of that size."""
    if len(raw) < HEADER.size:
        raise InvalidTokenDump("shorter than the header")
    magic, version, dim, docs, tokens, kind, zeros = HEADER.unpack_from(raw)
    if magic != MAGIC or version != FORMAT or kind or zeros != bytes(7):
        raise InvalidTokenDump("no dump, or one of another version or type")
    if not 0 < dim <= MAX_DIM or not tokens:
        raise InvalidTokenDump(f"dimension {dim}, {tokens} tokens")
    if size != HEADER.size + 8 * (docs + 1) + 4 * tokens + 4 * tokens * dim:
        raise InvalidTokenDump("another length than the header tells")
    return dim, docs, tokens


@dataclass
class DocRange(InputPartition):
    """Documents begin to end of a file, whose first is number first."""

    file: str
    dim: int
    docs: int
    tokens: int
    begin: int
    end: int
    first: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, docs_per_part: int) -> None:
        self.path, self.docs_per_part = path, docs_per_part

    def partitions(self) -> list[DocRange]:
        """Ranges of documents; of each file only the header is read."""
        system, files = _files(self.path)
        out, first = [], 0
        for f in files:
            with system.open_input_file(f.path) as file:
                dim, docs, tokens = _head(file.read(HEADER.size), f.size)
            out += [DocRange(f.path, dim, docs, tokens, a, min(a + self.docs_per_part, docs), first) for a in range(0, docs, self.docs_per_part)]
            first += docs
        if not out:
            raise InvalidTokenDump(f"{self.path} has no dump")
        return out

    def read(self, part: DocRange) -> Iterator[pa.RecordBatch]:
        """The range's offsets, then its ids and vectors in runs; each place in the file is read once."""
        system, _ = _file_system(self.path)
        ids_at = HEADER.size + 8 * (part.docs + 1)
        with system.open_input_file(part.file) as file:
            offsets = np.frombuffer(file.read_at(8 * (part.end - part.begin + 1), HEADER.size + 8 * part.begin), "<u8").astype(np.int64)
            if (np.diff(offsets) < 0).any() or offsets[0] < 0 or offsets[-1] > part.tokens or part.begin == 0 and offsets[0] or part.end == part.docs and offsets[-1] != part.tokens:
                raise InvalidTokenDump("offsets are not in order")
            doc = np.repeat(np.arange(part.begin, part.end), np.diff(offsets))
            pos = np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], np.diff(offsets))
            for a in range(0, len(doc), 4096):
                n, at = min(4096, len(doc) - a), int(offsets[0]) + a
                ids = np.frombuffer(file.read_at(4 * n, ids_at + 4 * at), "<u4")
                vectors = np.frombuffer(file.read_at(4 * n * part.dim, ids_at + 4 * part.tokens + 4 * at * part.dim), "<f4").reshape(n, part.dim)
                if not np.isfinite(vectors).all():
                    raise InvalidTokenDump("a component is not finite")
                yield pa.RecordBatch.from_arrays([pa.array(doc[a : a + n] + part.first), pa.array(pos[a : a + n].astype(np.int32)), pa.array(ids.astype(np.int64)), lists(vectors)], ["doc_id", "pos", "token_id", "vec"])


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[int, str]]


class _Writer(DataSourceArrowWriter):
    """Each task writes whole files under hidden names, and the commit renames them. Rows must come by file and in order."""

    def __init__(self, path: str, docs_per_file: int, docs: int) -> None:
        self.path, self.docs_per_file, self.docs = path, docs_per_file, docs

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, own = _file_system(self.path)
        system.create_dir(own)
        out = _Written([])
        file, counts = -1, np.zeros(0, np.int64)
        parts = (tempfile.TemporaryFile(), tempfile.TemporaryFile())  # noqa: SIM115  ids and vectors, until their numbers are known; they go with the task
        dim = 0

        def close() -> None:
            hidden = f"{own}/_{uuid.uuid4().hex}"
            with system.open_output_stream(hidden) as target:
                target.write(HEADER.pack(MAGIC, FORMAT, dim, len(counts), int(counts.sum()), 0, bytes(7)) + np.append(0, np.cumsum(counts)).astype("<u8").tobytes())
                for p in parts:
                    p.seek(0)
                    while block := p.read(1 << 20):
                        target.write(block)
                    p.seek(0)
                    p.truncate()
            out.files.append((file, hidden))

        for batch in iterator:
            doc, ids, x = batch.column("doc_id").to_numpy(), batch.column("token_id").to_numpy(), matrix(batch.column("vec"))
            if len(doc) and (ids.min() < 0 or ids.max() > MAX_ID or not np.isfinite(x).all()):
                raise InvalidTokenDump("a token id or a component can't be written")
            of = doc // self.docs_per_file
            for k in np.unique(of).tolist():
                if k != file:
                    if file >= 0:
                        close()
                    file, dim = k, x.shape[1]
                    counts = np.zeros(min(self.docs_per_file, self.docs - k * self.docs_per_file), np.int64)
                at = of == k
                if x.shape[1] != dim:
                    raise InvalidTokenDump("vectors differ in length")
                counts += np.bincount(doc[at] - k * self.docs_per_file, minlength=len(counts))
                parts[0].write(ids[at].astype("<u4").tobytes())
                parts[1].write(x[at].astype("<f4").tobytes())
        if file >= 0:
            close()
        return out

    def commit(self, messages: list[_Written | None]) -> None:
        system, own = _file_system(self.path)
        for m in messages:
            for k, hidden in m.files if m else ():
                system.move(hidden, f"{own}/part-{k:06d}.bin")

    def abort(self, messages: list[_Written | None]) -> None:
        system, _ = _file_system(self.path)
        for m in messages:
            for _, hidden in m.files if m else ():
                system.delete_file(hidden)


class TokenDumpSource(DataSource):
    """Dumps as a data source: path, and as options docs_per_part (read) or docs_per_file and docs (write)."""

    @classmethod
    def name(cls) -> str:
        return "tokendump"

    def schema(self) -> str:
        return TOKENS

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("docs_per_part", "4096")))

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], int(self.options["docs_per_file"]), int(self.options["docs"]))


def export(tokens: DataFrame, n_docs: int) -> bytes:
    """One dump of a small token table, documents 0 to n_docs - 1; for interchange, not for corpora."""
    t = tokens.select("doc_id", "pos", "token_id", F.col("vec").cast("array<float>")).orderBy("doc_id", "pos").toArrow()
    if not t.num_rows:
        raise InvalidTokenDump("there are no tokens")
    counts = np.bincount(t.column("doc_id").to_numpy(), minlength=n_docs)
    return to_bytes(np.concatenate([[0], np.cumsum(counts)]), t.column("token_id").to_numpy(), np.array(t.column("vec").to_pylist(), np.float32))


def write(tokens: DataFrame, path: str, docs_per_file: int = 100_000) -> DataFrame:
    """A folder of dumps, each of up to docs_per_file documents (of the last one, up to its last document with a token), written by tasks. Gives statistics().

    A run of docs_per_file documents without any token between others can't be written: the format has no file without tokens.
    """
    spark = tokens.sparkSession
    file = F.expr(f"doc_id div {docs_per_file}")
    last, files = tokens.agg(F.max("doc_id"), F.countDistinct(file)).first()
    if last is None:
        raise InvalidTokenDump("there are no tokens")
    if files != last // docs_per_file + 1:
        raise InvalidTokenDump("a file would have no tokens; docs_per_file must be greater")
    spark.dataSource.register(TokenDumpSource)
    rows = tokens.select("doc_id", F.col("pos").cast("int").alias("pos"), "token_id", F.col("vec").cast("array<float>").alias("vec"))
    dealt = rows.repartitionByRange(files, file).sortWithinPartitions("doc_id", "pos")
    dealt.write.format("tokendump").mode("append").option("docs_per_file", str(docs_per_file)).option("docs", str(last + 1)).save(path)
    return statistics(tokens)


def query_ids(n: int, sidecar: bytes | None, strict: bool = False) -> list[int]:
    """Ids of n queries: of the sidecar of 32-bit numbers, or 1 to n where there is none (strict: an error)."""
    if sidecar is None:
        if strict:
            raise QidCountMismatch("there is no sidecar")
        return list(range(1, n + 1))
    if len(sidecar) != 4 * n:
        raise QidCountMismatch(f"{len(sidecar)} bytes for {n} queries")
    return np.frombuffer(sidecar, "<u4").tolist()


def query_id_bytes(ids: list[int]) -> bytes:
    """A sidecar of 32-bit numbers; an id that is none is refused."""
    for i in ids:
        if not isinstance(i, int) or isinstance(i, bool) or not 0 <= i <= MAX_ID:
            raise QidOutOfRange(f"{i!r} is no number of 32 bits")
    return np.array(ids, "<u4").tobytes()


def write_query_ids(spark: SparkSession, path: str, ids: list[int]) -> None:
    """The sidecar of a dump of queries. Written under a hidden name and then renamed."""
    _put(spark, path, query_id_bytes(ids))


def read_query_ids(spark: SparkSession, path: str, n: int) -> list[int]:
    rows = spark.read.format("binaryFile").load(path).select("content").collect()  # 4 bytes a query
    return query_ids(n, bytes(rows[0]["content"]))


def _put(spark: SparkSession, path: str, raw: bytes) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    hidden = jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_{target.getName()}")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(hidden, True)
    out.write(bytearray(raw))
    out.close()
    fs.delete(target, False)
    fs.rename(hidden, target)


def statistics(tokens: DataFrame) -> DataFrame:
    """One row: n_docs, n_tokens and dim, as a dump's header has them."""
    own = tokens.agg(F.max("doc_id").alias("last"), F.count("*").alias("n_tokens"), F.max(F.size("vec")).alias("dim"))
    return own.select((F.coalesce("last", F.lit(-1)) + 1).alias("n_docs"), "n_tokens", "dim")


def metadata(tokens: DataFrame, *, mode: str, encoder: str, dropped: int = 0, source: str | None = None, notes: str | None = None) -> DataFrame:
    """One row that describes a dump: format, mode (docs or queries), encoder, statistics and origin."""
    if mode not in ("docs", "queries"):
        raise InvalidTokenDump(f"unknown mode {mode}")
    text = lambda v: F.lit(v).cast("string")
    head = [F.lit(FORMAT).alias("format_version"), text(mode).alias("mode"), text(encoder).alias("encoder")]
    tail = [F.lit(dropped).cast("long").alias("dropped"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("built_at"), text("lateloom").alias("tool"), text(TOOL).alias("tool_version"), text(source).alias("source_jsonl"), text(notes).alias("notes")]
    return statistics(tokens).select(*head, F.col("dim").alias("encoder_dim"), "n_docs", "n_tokens", *tail)


def write_metadata(row: DataFrame, path: str) -> None:
    """The row of metadata() as one JSON file."""
    _put(row.sparkSession, path, row.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).first()["j"].encode())


def synthetic(spark: SparkSession, *, docs: int, dim: int, vocab: int, avg_len: int, seed: int = 42, noise: float = 0.1) -> DataFrame:
    """Documents of 1 to 2 * avg_len tokens, ids as 1 / (rank + 1), vectors of length 1 around a theme for each id. Each document has its own seed."""
    themes = np.random.default_rng(seed).normal(size=(vocab, dim))
    themes /= np.linalg.norm(themes, axis=1, keepdims=True)
    weights = 1 / np.arange(1, vocab + 1)
    shared = spark.sparkContext.broadcast((themes, weights / weights.sum()))

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t, p = shared.value
        for batch in batches:
            out = []
            for d in batch["id"]:
                rng = np.random.default_rng([seed, int(d)])
                ids = rng.choice(vocab, rng.integers(1, 2 * avg_len + 1), p=p)
                v = t[ids] + noise * rng.normal(size=(len(ids), dim))
                v /= np.linalg.norm(v, axis=1, keepdims=True)
                out.append(pd.DataFrame({"doc_id": d, "pos": np.arange(len(ids)), "token_id": ids, "vec": list(v.astype(np.float32))}))
            yield pd.concat(out) if out else pd.DataFrame({"doc_id": [], "pos": [], "token_id": [], "vec": []})

    return spark.range(docs).mapInPandas(make, TOKENS)
