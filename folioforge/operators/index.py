"""The index table: points, sparse and hybrid embeddings, idempotent upserts and deletes."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.functions import text as T


def latest_points(points: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by the order columns; rows with a null key are left out."""
    last = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in order])
    named = points.where(F.expr(" and ".join(f"`{k}` is not null" for k in keys)))
    return named.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def payload(chunk: dict[str, Column]) -> Column:
    """JSON payload of a chunk: chunk_id, doc_id, text, block_ids, its metadata as an own member, then pages and section if known."""
    return F.to_json(F.struct(*[chunk[k].alias(k) for k in ("chunk_id", "doc_id", "text", "block_ids", "metadata", "page_start", "page_end", "section_id") if k in chunk]))


def sparse_weights(docs: DataFrame, id_col: str, text_col: str, k1: float = 1.2, b: float = 0.75, average: float = 100.0, dim: int = 1 << 20) -> DataFrame:
    """(id, sparse struct<indices, weights>): hashed words of each text with saturated counts; idf is left to the store.

    Texts without a word have no row.
    """
    from folioforge.operators.search import postings

    slots = postings(docs, id_col, text_col).groupBy("id", "length", F.pmod(F.xxhash64("term"), F.lit(dim)).cast("int").alias("slot")).agg(F.sum("tf").alias("tf"))
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / average))
    listed = slots.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("slot", weight.cast("float").alias("w")))).alias("l"))
    return listed.select("id", F.struct(F.transform("l", lambda x: x["slot"]).alias("indices"), F.transform("l", lambda x: x["w"]).alias("weights")).alias("sparse"))


def embed_texts(chunks: DataFrame, encoder: Callable[[list[str]], object], batch: int = 32, pause: float = 0.0, retries: int = 6, retry_on: tuple[type[Exception], ...] = (), id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """(id, dense): vectors of the texts from an encoder that takes lists of at most ``batch`` texts.

    Errors of the kinds ``retry_on`` are tried again up to ``retries`` times after 5, 10, 20 ... seconds, 60 at most. An encoder
    that returns another number of vectors is an error. Null texts are encoded as empty ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, out = [t or "" for t in b.column(1).to_pylist()], []
            for lo in range(0, len(texts), batch):
                part = texts[lo : lo + batch]
                for attempt in range(retries + 1):
                    try:
                        vectors = [list(map(float, v)) for v in encoder(part)]
                        break
                    except retry_on:
                        if attempt == retries:
                            raise
                        time.sleep(min(60.0, 5.0 * 2**attempt))
                if len(vectors) != len(part):
                    raise ValueError(f"{len(part)} texts gave {len(vectors)} vectors")
                out += vectors
                if pause and lo + batch < len(texts):
                    time.sleep(pause)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float32()))], names=["id", "dense"])

    return chunks.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, "id string, dense array<float>")


def hybrid(dense: DataFrame, sparse: DataFrame, id_col: str = "id") -> DataFrame:
    """Dense and sparse embeddings joined by id; ids without a sparse part keep a null there."""
    return dense.join(sparse, id_col, "left")


#: Generations after which a write first puts the live points together anew.
COMPACT_AFTER = 16


class _Log:
    """The generations of an index folder.

    Points of a generation lie in ``points/<id>``, the documents that it replaces or deletes in ``gone/<id>``. It counts once its
    marker ``log/<number>`` exists, which is created by one exclusive call when both are complete. So a write that fails leaves
    the index as it was, and of two writers with the same number one has to begin anew.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self) -> bool:
        fs, p = self._at(f"{self.path}/log")
        return fs.exists(p)

    def generations(self) -> list[tuple[int, str]]:
        """(number, id) of the generations that count, those before the last compaction left out."""
        fs, p = self._at(f"{self.path}/log")
        names = sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []
        known = [(int(n.split(".")[0]), n) for n in names if n[:1].isdigit()]
        marks = [(n, self._read(f"{self.path}/log/{name}")) for n, name in known]
        base = max((n for n, text in marks if text.startswith("whole ")), default=0)
        return [(n, text.split(" ")[1]) for n, text in marks if n >= base]

    def _read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def commit(self, number: int, name: str, whole: bool) -> None:
        fs, p = self._at(f"{self.path}/log/{number:012d}")
        stream = fs.create(p, False)  # fails if another writer was first
        try:
            stream.write(bytearray(f"{'whole' if whole else 'part'} {name}".encode()))
        finally:
            stream.close()

    def write(self, points: DataFrame, gone: DataFrame, whole: bool = False) -> None:
        number, name = max((n for n, _ in self.generations()), default=0) + 1, uuid.uuid4().hex
        points.write.parquet(f"{self.path}/points/{name}")
        gone.select("doc_id").write.parquet(f"{self.path}/gone/{name}")
        self.commit(number, name, whole)

    def table(self, kind: str) -> DataFrame:
        parts = [self.spark.read.parquet(f"{self.path}/{kind}/{name}").withColumn("_generation", F.lit(n)) for n, name in self.generations()]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def remove(self) -> None:
        fs, p = self._at(self.path)
        fs.delete(p, True)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The live points: those whose document no later generation replaces or deletes."""
    log = _Log(spark, path)
    gone = log.table("gone").groupBy("doc_id").agg(F.max("_generation").alias("_last"))
    joined = log.table("points").join(gone, "doc_id", "left")
    points = log.table("points").columns
    return joined.where("_last is null or _generation >= _last").select(*[c for c in points if c != "_generation"])


def create_index(spark: SparkSession, path: str, points: DataFrame) -> None:
    """Write a new index. Points need doc_id, point_id and a uniform vector length. Files follow the frame's partitions."""
    _check_dimension(points)
    log = _Log(spark, path)
    log.remove()
    log.write(points.where("doc_id is not null"), points.select("doc_id").limit(0), whole=True)


def _check_dimension(points: DataFrame) -> None:
    if "dense" in points.columns:
        sizes = points.agg(F.min(F.size("dense")).alias("lo"), F.max(F.size("dense")).alias("hi")).first()
        if sizes["lo"] != sizes["hi"] or sizes["lo"] is not None and sizes["lo"] < 1:
            raise ValueError(f"vectors must have one length; found {sizes['lo']} to {sizes['hi']}")


def upsert(spark: SparkSession, path: str, points: DataFrame, documents: DataFrame, order: list[str]) -> None:
    """Replace the points of the given documents (doc_id) by ``points``, the last of each point_id by ``order``.

    Documents without new points lose their old ones; points of other documents are left out. Only what is new is written, beside what
    is there, and it counts from one moment on; a repeated delivery gives the same index.
    """
    from folioforge.runtime import bounded_broadcast, stage_table

    _check_dimension(points)
    log = _Log(spark, path)
    if len(log.generations()) >= COMPACT_AFTER:
        compact(spark, path)
    docs = stage_table(documents.select("doc_id").where("doc_id is not null").distinct(), "docs")
    log.write(latest_points(points.join(bounded_broadcast(docs), "doc_id", "left_semi"), ["point_id"], order), docs)


def compact(spark: SparkSession, path: str) -> None:
    """Write the live points as one generation; earlier ones no longer count. Their files stay for readers that have begun."""
    live = read_index(spark, path)
    _Log(spark, path).write(live, live.select("doc_id").limit(0), whole=True)


def delete_documents(spark: SparkSession, path: str, doc_ids: list[str]) -> int:
    """Delete all points of the documents and return how many there were; 0 if the index doesn't exist."""
    if not doc_ids or any(not d for d in doc_ids):
        raise ValueError("document ids must not be empty")
    log = _Log(spark, path)
    if not log.exists():
        return 0
    docs = spark.createDataFrame([(d,) for d in set(doc_ids)], "doc_id string")
    count = read_index(spark, path).join(docs, "doc_id", "left_semi").count()
    if count:
        log.write(read_index(spark, path).limit(0), docs)
    return count


def with_point_ids(chunks: DataFrame) -> DataFrame:
    """Chunks with ``point_id``, the UUID of the chunk id."""
    return chunks.withColumn("point_id", T.point_id(F.col("chunk_id")))
