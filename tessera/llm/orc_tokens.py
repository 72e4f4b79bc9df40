"""Token ids in ORC.

Files are range-partitioned and sorted by document id. Integer columns take
ORC's run-length encoding; row indexes (one entry per `row_index` rows) and a
Bloom filter on the document id let a reader skip stripes and row groups, and
stripes are read in parallel. Each row keeps `file_no` and `file_start`, its
place within its file, so that no reader needs its neighbours: a document's
place in the whole stream is `file_start` plus the totals of earlier files,
one number per file.

Defined results: null text counts as empty (only the end id); rows with a
null id come first, equal ids stand in the order of their texts, and repeated
rows are all written; other columns are not read; an empty table gives no
rows."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch
from .wordbpe import WordBpe, loaded

END_ID = 1
ROW_INDEX = 1000
STRIPE_BYTES = 16 << 20


def _lists(ids: list[bytes]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype("i4")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))


def _writer(vocab: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, at, part = loaded(WordBpe, vocab), 0, TaskContext.get().partitionId()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                some = batch.slice(k, 256)
                ids = [bpe.encode(t.as_py()) + end for t in some.column(1)]
                n = np.array([len(x) // 4 for x in ids], "i8")
                starts = at + np.concatenate([[0], np.cumsum(n)[:-1]])
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(np.full(len(n), part, "i4")), pa.array(starts.astype("i8")), pa.array(n), _lists(ids)], names=["id", "file_no", "file_start", "n_tokens", "ids"])

    return run


def write_tokens(docs: DataFrame, path: str, vocab: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, files: int | None = None, stripe_bytes: int = STRIPE_BYTES, row_index: int = ROW_INDEX) -> None:
    """Write (id, file_no, file_start, n_tokens, ids) in ascending id order, one file per range."""
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    files = files or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The text takes part in the range so that a repeated id can be split.
    ordered = slim.repartitionByRange(files, "id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"), "text")
    rows = ordered.mapInArrow(_writer(vocab, end_id), f"id {kind}, file_no int, file_start long, n_tokens long, ids array<int>")
    (rows.withColumnRenamed("id", id_col).write.option("orc.bloom.filter.columns", id_col).option("orc.bloom.filter.fpp", "0.01")
     .option("orc.create.index", "true").option("orc.row.index.stride", str(row_index)).option("orc.stripe.size", str(stripe_bytes)).option("orc.compress", "SNAPPY").orc(path))


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """The rows with `start`, the ids of all documents before. Filters on the id reach the files' indexes."""
    kept = spark.read.orc(path)
    # One row per file: bounded by the number of files, not of documents.
    totals = kept.groupBy("file_no").agg(F.sum("n_tokens").alias("n")).orderBy("file_no").collect()
    first, at = [], 0
    for r in totals:
        first.append((r.file_no, at))
        at += r.n
    starts = F.broadcast(spark.createDataFrame(first, "file_no int, before long"))
    return kept.join(starts, "file_no").select(kept[id_col], (F.col("before") + F.col("file_start")).alias("start"), "n_tokens", "ids")


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        values, ends = lists.values.to_numpy().astype("<u4", copy=False), lists.offsets.to_numpy()
        crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"])


def checksums(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of what was read."""
    kind = tokens.schema[id_col].dataType.simpleString()
    slim = tokens.select(tokens[id_col].alias("id"), "start", "n_tokens", "ids")
    return slim.mapInArrow(_crc, f"id {kind}, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, vocab: str) -> DataFrame:
    spark = docs.sparkSession
    path = scratch(spark, "orc")
    write_tokens(docs, path, vocab)
    return checksums(read_tokens(spark, path))
