"""Streams whose state lives in Spark's state store: keyed merges and a failure breaker.

A micro-batch touches the state of the keys it holds and nothing else. What it changes is appended to a log in the shared folder,
one folder per batch, so that a repeated batch rewrites its own folder only.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, IntegralType, StringType

from quillmetric.operators.telemetry import BREAK_AT

#: Groups that the sessions of the breaker are dealt over.
BREAKER_GROUPS = 1024


def _merged(policy: str, name: str, seq: str) -> Column:
    value, known = F.col(name), F.col(name).isNotNull()
    rules = {
        "new": lambda: F.max_by(value, F.col(seq)), "old": lambda: F.min_by(value, F.col(seq)),
        "new_else_old": lambda: F.max_by(F.when(known, value), F.when(known, F.col(seq))),
        "old_else_new": lambda: F.min_by(F.when(known, value), F.when(known, F.col(seq))),
        "min": lambda: F.min(value), "max": lambda: F.max(value),
    }
    if policy not in rules:
        raise ValueError(f"policy {policy!r} is not kept in a stream")
    return rules[policy]().alias(name)


def merged_stream(stream: DataFrame, key: str, policies: Mapping[str, str], seq: str, id_map: DataFrame | None = None,
                  map_key: str | None = None, map_value: str | None = None) -> DataFrame:
    """One row per key, merged over all batches by the policies; ``seq`` orders the rows of a key.

    An id map, joined before the merge, replaces keys it knows.
    """
    rows = stream
    if id_map is not None:
        known = id_map.select(F.col(map_key).alias(key), F.col(map_value).alias("_mapped"))
        rows = rows.join(known, key, "left").withColumn(key, F.coalesce("_mapped", key)).drop("_mapped")
    return rows.groupBy(key).agg(*[_merged(policy, name, seq) for name, policy in policies.items()])


def log_changes(merged: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append every batch's changed rows to the log ``out`` until all that is there now has been read; the query that has ended."""
    def handle(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")

    query = (merged.writeStream.outputMode("update").foreachBatch(handle).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def latest_rows(spark: SparkSession, out: str, key: str) -> DataFrame:
    """The rows of a change log as they are now."""
    log = spark.read.parquet(out)
    names = [c for c in log.columns if c not in (key, "batch")]
    newest = log.groupBy(key).agg(F.max_by(F.struct(*names), F.col("batch")).alias("_row"))
    return newest.select(key, "_row.*")


def breaker_stream(stream: DataFrame, keys: Sequence[str], order: str, row_id: str, failed: str, at: int = BREAK_AT,
                   groups: int = BREAKER_GROUPS) -> DataFrame:
    """``row_id, keys, streak, deny_next`` per event: consecutive failures of its session so far, across batches.

    Sessions are dealt over ``groups`` groups by a hash of their keys, and all sessions of a group are counted at once: a call per
    session would cost more than its few events. State per group is the number of failures still open in each of its sessions; sessions
    without any have no state. ``groups`` must not change while a checkpoint lasts. Batches follow the order of the events; a batch may
    hold them in any order. Keys other than whole numbers, booleans and strings are groups of their own.
    """
    types = {f.name: f.dataType for f in stream.schema}
    plain = [k for k in keys if isinstance(types[k], (IntegralType, BooleanType)) or types[k] == StringType()]
    others = [k for k in keys if k not in plain]
    shape = ", ".join(f"{c} {types[c].simpleString()}" for c in (row_id, *keys)) + ", streak int, deny_next boolean, _no_id boolean"

    def count(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        named = [k for k, absent in zip(plain, key[1:]) if not absent]  # the other ones are null in the whole group
        events = pd.concat(list(frames), ignore_index=True)
        session = events.groupby(named, sort=False).ngroup() if named else 0
        events = events.assign(_session=session).sort_values(["_session", "_no_order", "_order", "_no_id", "_id"], ignore_index=True)
        session = events["_session"].to_numpy()
        place = np.arange(len(events))
        first = np.flatnonzero(np.diff(session, prepend=-1))  # of each session, in the order of their numbers
        last = np.append(first[1:], len(events)) - 1
        sessions = [events[k].to_numpy()[first] for k in named]
        carried, kept = np.zeros(len(first), dtype="int64"), []
        if state.exists:
            *known, open_counts = json.loads(state.get[0])
            number = {values: n for n, values in enumerate(zip(*[v.tolist() for v in sessions]))} if named else {(): 0}
            for *values, n in zip(*known, open_counts):
                if tuple(values) in number:
                    carried[number[tuple(values)]] = n
                else:
                    kept.append((*values, n))
        bad = events["_failed"].to_numpy(bool)
        begin = first[session]
        last_good = np.maximum(np.maximum.accumulate(np.where(bad, -1, place)), begin - 1)
        streak = np.where(bad, place - last_good + np.where(last_good < begin, carried[session], 0), 0).astype("int32")
        kept += [(*values, n) for *values, n in zip(*[v.tolist() for v in sessions], streak[last].tolist()) if n]
        if kept:
            state.update((json.dumps(list(zip(*kept))),))
        elif state.exists:
            state.remove()
        out = events[[*keys, "_no_id"]].assign(**{row_id: events["_id"]}, streak=streak, deny_next=streak >= at)
        yield out[[row_id, *keys, "streak", "deny_next", "_no_id"]]

    def whole(name: str) -> Column:
        """Without nulls where a null would make floating-point numbers of all whole ones."""
        return F.coalesce(name, F.lit(0).cast(types[name])) if isinstance(types[name], IntegralType) else F.col(name)

    group = F.pmod(F.xxhash64(*plain), F.lit(groups)) if plain else F.lit(0).cast("long")
    absent = {f"_no_key_{n}": F.col(k).isNull() for n, k in enumerate(plain)}
    rows = stream.select(*keys, whole(order).alias("_order"), F.col(order).isNull().alias("_no_order"), whole(row_id).alias("_id"),
                         F.col(row_id).isNull().alias("_no_id"), F.coalesce(failed, F.lit(False)).alias("_failed"),
                         group.alias("_group"), *[c.alias(name) for name, c in absent.items()])
    counted = rows.groupBy("_group", *absent, *others).applyInPandasWithState(
        count, shape, "open_failures string", "append", GroupStateTimeout.NoTimeout)
    return counted.select(F.when(~F.col("_no_id"), F.col(row_id)).alias(row_id), *keys, "streak", "deny_next")
