"""Token ids of documents in ORC files: run-length encoded integers, row indexes, Bloom filters on document ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmetric.llm.tokens import encoder, vocabulary_path
from quillmetric.llm.work import Workspace, running_within, slices, text_or_empty

END_ID = 0
STRIPE_BYTES = 16 * 1024 * 1024
INDEX_ROWS = 1000

STORED = "doc_id long, part int, pos long, ids array<int>"
COUNTED = "doc_id long, part int, pos long, n_tokens long, ids_crc32 long"


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID,
                 stripe_bytes: int = STRIPE_BYTES, index_rows: int = INDEX_ROWS) -> None:
    """Encode ``docs(doc_id, text)`` and write the ids in ascending doc_id order.

    The texts are dealt by ranges of doc_id (a tie-breaking hash splits repeated ids) and sorted in their range; file k
    holds range k in order, as rows (doc_id, part = k, pos = place in the range, ids). ORC stores ids by integer run-length
    encoding in stripes of ``stripe_bytes``, with an index entry every ``index_rows`` rows and Bloom filters on doc_id, so
    readers split files by stripes and skip those without a wanted id. Null texts are empty; a document's ids end with
    ``end_id``; a null doc_id comes first. An empty table gives no rows.
    """
    location = vocabulary or vocabulary_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids, end, pos = encoder(location).encode, int(end_id).to_bytes(4, "little"), 0
        for batch in slices(batches):
            stored = [to_ids(t) + end for t in batch.column("text").to_pylist()]
            ends = np.cumsum([0] + [len(s) // 4 for s in stored]).astype(np.int32)
            ids = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(stored))])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), pa.array(range(pos, pos + batch.num_rows), pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends), ids)], ["doc_id", "part", "pos", "ids"])
            pos += batch.num_rows

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    tie = F.xxhash64("text")
    (texts.repartitionByRange(F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie)
     .withColumn("part", F.spark_partition_id())
     .mapInArrow(encode, STORED)
     .write.option("orc.stripe.size", stripe_bytes).option("orc.row.index.stride", index_rows)
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
     .orc(path))


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Stored rows; with ``doc_ids`` the filter reaches the files' statistics and Bloom filters."""
    stored = spark.read.schema(STORED).orc(path)
    return stored if doc_ids is None else stored.filter(F.col("doc_id").isin(doc_ids))


def token_index(spark: SparkSession, path: str, work: Workspace) -> DataFrame:
    """Per stored document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            offsets, ids = lists.offsets.to_numpy(), np.ascontiguousarray(lists.values.to_numpy(), dtype="<u4")
            sums = [zlib.crc32(ids[a:b].data) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), batch.column("pos"),
                 pa.array(np.diff(offsets), pa.int64()), pa.array(sums, pa.int64())],
                ["doc_id", "part", "pos", "n_tokens", "ids_crc32"])

    counted = work.table(read_tokens(spark, path).mapInArrow(count, COUNTED), "counted")
    return (running_within(counted, "n_tokens", ["pos"], "start")
            .select("doc_id", "start", "n_tokens", "ids_crc32"))
