"""Exact top-k search by inner product over norm buckets.

Vectors are grouped by length: ranges of descending length are cut into buckets of bounded size, so equal lengths or
copies of one vector never make a large bucket. The longest bucket gives every query a first bound for its k-th product.
Each other bucket is met only by queries that can still find something there; inside, the bound becomes a local
cosine threshold, which prunes either by length or by coordinate intervals. What remains is verified by exact products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmetric.llm.work import Workspace, small

SCALE = 1024
TOP_K = 10
BUCKET_ROWS = 4096
QUERY_ROWS = 1024
#: From this local cosine on, coordinate intervals prune more than lengths do.
COORDINATE_COSINE = 0.6
FOCUS = 4
_EXACT_DOUBLE = 2.0 ** 53
_LONG = 2 ** 63 - 1

FOUND = "query_id long, vec_id long, score long"


def quantised(embedding: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, in doubles; null for vectors that are null or hold null or non-finite components."""
    x = F.transform(embedding, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(~bad, F.transform(x, lambda v: F.floor(v * scale).cast("double")))


def vectors(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, v, norm``, one row per id: rows that repeat an id count once, by the least of their vectors."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding"), scale).alias("v"))
    one = rows.filter(F.col("v").isNotNull() & F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.min("v").alias("v"))
    return one.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))


def _matrix(rows: list, width: int) -> np.ndarray:
    """Rows as a matrix; shorter vectors end in zeros."""
    out = np.zeros((len(rows), width))
    for k, r in enumerate(rows):
        out[k, :len(r)] = r
    return out


def buckets(all_vectors: DataFrame, rows: int) -> DataFrame:
    """``bucket, longest, ids, width, flat``: runs of at most ``rows`` vectors in descending length; ids and vectors as bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, part, number = None, None, 0

        def block(t: pa.Table) -> pa.RecordBatch:
            lists = t["v"].to_pylist()
            width = max(map(len, lists))
            flat = _matrix(lists, width)
            return pa.RecordBatch.from_pydict({
                "bucket": pa.array([part * (1 << 32) + number], pa.int64()), "longest": pa.array([float(t["norm"][0].as_py())]),
                "ids": pa.array([t["vec_id"].to_numpy().astype("<i8").tobytes()], pa.binary()), "width": pa.array([width], pa.int32()),
                "flat": pa.array([flat.tobytes()], pa.binary())})

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            waiting = pa.Table.from_batches([batch] if waiting is None else [*waiting.to_batches(), batch])
            while waiting.num_rows >= rows:
                yield block(waiting.slice(0, rows))
                number, waiting = number + 1, waiting.slice(rows)
        if waiting is not None and waiting.num_rows:
            yield block(waiting)

    order = [F.desc("norm"), F.col("vec_id")]
    return (all_vectors.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
            .mapInArrow(cut, "bucket long, longest double, ids binary, width int, flat binary"))


def _products(queries: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Exact inner products as integers; beyond 64 bits they stop at the largest long."""
    width = max(queries.shape[-1], found.shape[1])
    q = np.pad(queries, (0, width - len(queries)))
    x = np.pad(found, ((0, 0), (0, width - found.shape[1])))
    if np.abs(x).max(initial=0.0) * np.abs(q).max(initial=0.0) * max(width, 1) < _EXACT_DOUBLE:
        return (x @ q).astype(np.int64)
    exact = [sum(int(a) * int(b) for a, b in zip(row, q)) for row in x]
    return np.array([max(-_LONG - 1, min(_LONG, e)) for e in exact], dtype=np.int64)


def _candidates(q: np.ndarray, bound: float, flat: np.ndarray, norms: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """Places in the bucket whose product with ``q`` may reach ``bound``; a hair is left for rounding."""
    length = float(np.sqrt(q @ q))
    if bound <= 0 or length == 0:
        return np.arange(len(flat))
    reach = np.searchsorted(-norms, -(bound / length) * (1 - 1e-9), side="right")  # length pruning: norms descend
    cosine = bound / (length * norms[0]) * (1 - 1e-9)
    if cosine < COORDINATE_COSINE or reach == 0:
        return np.arange(reach)
    direction = np.zeros(flat.shape[1])
    direction[:min(len(q), flat.shape[1])] = q[:flat.shape[1]] / length
    inside = np.ones(reach, dtype=bool)
    for f in np.argsort(-np.abs(direction))[:FOCUS]:
        spread = np.sqrt(max(0.0, (1 - direction[f] ** 2) * (1 - min(cosine, 1.0) ** 2))) + 1e-9
        inside &= np.abs(unit[:reach, f] - direction[f] * cosine) <= spread + np.abs(direction[f]) * (1 - cosine)
    return np.flatnonzero(inside)


def _search(query_ids, queries, bounds, ids: np.ndarray, flat: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Per query its best ``k`` of one bucket, at least as good as its bound; a query's own row never counts."""
    norms = np.sqrt((flat * flat).sum(axis=1))
    unit = flat / np.where(norms > 0, norms, 1.0)[:, None]
    out = []
    for query_id, q, bound in zip(query_ids, queries, bounds):
        places = _candidates(q, bound, flat, norms, unit)
        places = places[ids[places] != query_id]
        if not len(places):
            continue
        scores, own = _products(q, flat[places]), ids[places]
        keep = scores >= bound
        scores, own = scores[keep], own[keep]
        best = np.lexsort((own, -scores))[:k]
        out.extend((int(query_id), int(i), int(s)) for i, s in zip(own[best], scores[best]))
    return out


def top_k(embeddings: DataFrame, is_query: Column, work: Workspace, k: int = TOP_K, scale: int = SCALE,
          bucket_rows: int = BUCKET_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: for the rows that ``is_query`` selects, the ``k`` other rows with the highest products.

    Scores are inner products of floor(scale * x); ties go to the smaller vec_id. Vectors that are null or hold null or
    non-finite components, and rows without an id, take no part; shorter vectors end in zeros; a repeated id counts
    once. With fewer other rows all are returned; an empty table gives no rows.
    """
    stored = work.table(vectors(embeddings, scale), "vectors")
    cut = work.table(buckets(stored, bucket_rows), "buckets")
    queries = work.table(_query_slices(stored.filter(is_query), query_rows), "queries")
    head = cut.orderBy(F.desc("longest"), "bucket").limit(1).collect()  # one bucket, at most bucket_rows vectors
    if not head:
        return stored.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    first_ids = np.frombuffer(head[0]["ids"], "<i8")
    first_flat = np.frombuffer(head[0]["flat"]).reshape(len(first_ids), -1)

    def bound_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = _search(frame["vec_id"], [np.array(v) for v in frame["v"]], np.full(len(frame), -np.inf), first_ids, first_flat, k)
            kth = pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).groupby("query_id")["score"].agg(["min", "size"])
            kth = kth["min"].where(kth["size"] >= k).reindex(frame["vec_id"])
            yield frame.assign(bound=kth.to_numpy(dtype=float, na_value=-np.inf))

    bounded = work.table(queries.mapInPandas(bound_of, "slice int, vec_id long, v array<double>, norm double, bound double"), "bounds")
    # a slice of queries meets a bucket if one of its queries can reach its bound there
    reach = bounded.groupBy("slice").agg(F.min(F.when(F.col("bound") > 0, F.col("bound") / F.col("norm")).otherwise(0.0)).alias("need"))
    lengths = cut.select("bucket", "longest")
    needs = small(work.table(reach.withColumn("_", F.lit(1)), "needs"))
    meetings = work.table(needs.join(lengths.withColumn("_", F.lit(1)), "_").filter(
        F.col("longest") >= F.col("need") * (1 - 1e-9)).select("slice", "bucket"), "meetings")
    left = meetings.join(bounded, "slice").join(lengths, "bucket").filter(
        (F.col("bound") <= 0) | (F.col("longest") * F.col("norm") >= F.col("bound") * (1 - 1e-9)))
    right = meetings.join(cut, "bucket").select(F.col("bucket").alias("right_bucket"), F.col("slice").alias("right_slice"),
                                                F.col("ids").alias("ids"), F.col("flat").alias("flat"))

    def verify(key: tuple, asked: pd.DataFrame, bucket: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or bucket.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        ids = np.frombuffer(bucket["ids"].iloc[0], "<i8")
        flat = np.frombuffer(bucket["flat"].iloc[0]).reshape(len(ids), -1)
        found = _search(asked["vec_id"], [np.array(v) for v in asked["v"]], asked["bound"], ids, flat, k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"], dtype="int64")

    found = (left.select("bucket", "slice", "vec_id", "v", "bound").groupBy("bucket", "slice")
             .cogroup(right.groupBy("right_bucket", "right_slice"))
             .applyInPandas(verify, FOUND))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _query_slices(queries: DataFrame, rows: int) -> DataFrame:
    """Queries dealt into slices of about ``rows`` by a hash."""
    slices = max(1, -(-queries.count() // rows))
    return queries.withColumn("slice", F.pmod(F.xxhash64("vec_id"), F.lit(slices)).cast("int")).select("slice", "vec_id", "v", "norm")
