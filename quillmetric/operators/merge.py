"""Keyed tables: de-duplication and insert-or-update as a join, with one policy per column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmetric.functions.text import squeeze

POLICIES = ("new", "new_else_old", "old_else_new", "old", "min", "max", "union")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key. The rank limit also runs before the shuffle, so a hot key shrinks on the map side."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def keep_last(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    return keep_first(df, keys, [F.col(seq).desc()])


def near_duplicate_key(author: Column, text: Column, row_id: Column, prefix: int = 120) -> Column:
    """Author and first characters of the squeezed lower-case text; blank text is only equal to itself."""
    flat = F.substring(F.lower(squeeze(F.coalesce(text, F.lit("")))), 1, prefix)
    body = F.when(flat == "", F.concat(F.lit("id:"), row_id.cast("string"))).otherwise(flat)
    return F.struct(F.lower(F.trim(F.coalesce(author, F.lit("")))).alias("author"), body.alias("body"))


def collapse_near_duplicates(df: DataFrame, author: str | None, text: str, row_id: str,
                             score: str) -> DataFrame:
    """Highest-scored row of each near-duplicate group; pass no author to compare across authors."""
    who = F.col(author) if author else F.lit("")
    return keep_best_of(df.withColumn("_near", near_duplicate_key(who, F.col(text), F.col(row_id))), "_near", row_id, score).drop("_near")


def keep_best_of(keyed: DataFrame, near: str, row_id: str, score: str) -> DataFrame:
    """Highest-scored row of each value of ``near``; ties go to the smaller id."""
    return keep_first(keyed, [near], [F.desc(score), F.col(row_id)])


def _merged(policy: str, old: Column, new: Column, had_old: Column, has_new: Column) -> Column:
    both = {
        "new": new,
        "new_else_old": F.coalesce(new, old),
        "old_else_new": F.coalesce(old, new),
        "old": old,
        "min": F.least(old, new),
        "max": F.greatest(old, new),
        "union": F.array_union(F.coalesce(old, F.array().cast("array<string>")),
                               F.coalesce(new, F.array().cast("array<string>"))),
    }[policy]
    return F.when(had_old & has_new, both).when(has_new, new).otherwise(old)


def upsert(base: DataFrame, batch: DataFrame, key: str, policies: Mapping[str, str], seq: str) -> DataFrame:
    """Merge a batch into a keyed table. Both sides hold one row per key at the join, so no key can be hot.

    ``seq`` orders rows of the batch; the last one per key counts. Running the same batch again
    changes nothing.
    """
    unknown = set(policies.values()) - set(POLICIES)
    if unknown:
        raise ValueError(f"unknown merge policies: {sorted(unknown)}")
    latest = keep_last(batch, [key], seq).select(key, *policies).withColumn("_new", F.lit(True)).alias("n")
    stored = base.select(key, *policies).withColumn("_old", F.lit(True)).alias("o")
    joined = stored.join(latest, key, "full_outer")
    had, has = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    return joined.select(key, *[
        _merged(p, F.col(f"o.{c}"), F.col(f"n.{c}"), had, has).alias(c) for c, p in policies.items()])


def remap_keys(batch: DataFrame, base: DataFrame, key: str, alternate: str) -> DataFrame:
    """Give batch rows the stored key of a row with the same alternate key, so identities do not split."""
    known = (base.filter(F.coalesce(F.col(alternate), F.lit("")) != "")
             .groupBy(alternate).agg(F.min(key).alias("_stored")))
    return (batch.join(known, alternate, "left")
            .withColumn(key, F.coalesce("_stored", key)).drop("_stored").select(*batch.columns))


def collect_tags(hits: DataFrame, key: str, tag: str, seq: str) -> DataFrame:
    """Distinct tags per key in order of first use. Repeats are folded before they are collected."""
    first = hits.filter(F.coalesce(F.col(tag), F.lit("")) != "").groupBy(key, tag).agg(F.min(seq).alias("_at"))
    ordered = F.array_sort(F.collect_list(F.struct("_at", tag)))
    return first.groupBy(key).agg(F.transform(ordered, lambda x: x[tag]).alias(tag))


def record_hits(base: DataFrame, hits: DataFrame, key: str, tags: Mapping[str, str], seq: str) -> DataFrame:
    """Union of stored and new tag lists per key; ``tags`` maps a hit column to the stored list column."""
    out = base.withColumn("_known", F.lit(True))
    fresh = hits.groupBy(key).agg(F.count(F.lit(1)).alias("_hits"))
    for hit_col in tags:
        fresh = fresh.join(collect_tags(hits, key, hit_col, seq), key, "left")
    merged = out.join(fresh, key, "full_outer")
    empty = F.array().cast("array<string>")
    for hit_col, list_col in tags.items():
        merged = merged.withColumn(list_col, F.array_union(F.coalesce(list_col, empty), F.coalesce(hit_col, empty)))
    return (merged.withColumn("is_new", F.col("_known").isNull()).withColumn("was_hit", F.col("_hits").isNotNull())
            .drop("_known", "_hits", *[c for c in tags if c not in tags.values()]))


def mirror(connections: DataFrame, contacts: DataFrame, key: str, keep: Sequence[str], fill: Sequence[str]) -> DataFrame:
    """Connections as contact rows: ``keep`` columns come from the stored contact, ``fill`` columns fall back to it."""
    stored = contacts.select(key, *keep, *[F.col(c).alias(f"_old_{c}") for c in fill])
    out = connections.join(stored, key, "left")
    for c in fill:
        out = out.withColumn(c, F.coalesce(c, f"_old_{c}")).drop(f"_old_{c}")
    return out


def rekey_orphans(records: DataFrame, canonical: DataFrame, key: str,
                  prefixes: Sequence[str] = ("urn:li:person:", "urn:li:member:")) -> DataFrame:
    """Move records stored under an older form of a key onto the canonical key, unless that key has a record.

    Both sides meet on the lower-case tail of the key. One record (the smallest old key) moves per
    canonical key; the rest stay.
    """
    tail = F.lower(F.substring_index(F.col(key), ":", -1))
    legacy_form = F.lit(False)
    for prefix in prefixes:
        legacy_form = legacy_form | (F.lower(key) == F.concat(F.lit(prefix), tail))
    wanted = canonical.select(F.col(key).alias("_to")).distinct().withColumn(
        "_tail", F.lower(F.substring_index("_to", ":", -1)))
    missing = wanted.join(records.select(F.col(key).alias("_to")), "_to", "left_anti")
    target = missing.groupBy("_tail").agg(F.min("_to").alias("_to"))
    # grouping by tail first keeps one row per tail; the smallest old key moves
    movable = (records.filter(legacy_form).withColumn("_tail", tail).groupBy("_tail").agg(F.min(key).alias("_from"))
               .join(target, "_tail").select(F.col("_from").alias(key), "_to"))
    return (records.join(movable, key, "left").withColumn(key, F.coalesce("_to", key)).drop("_to")
            .select(*records.columns))


def append_missing(table: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """Rows of ``extra`` whose key is not there yet, added below the table; missing columns become null."""
    return table.unionByName(extra.join(table.select(key), key, "left_anti"), allowMissingColumns=True)


def coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row count and non-null count of each column in one pass."""
    return df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(f"with_{c}") for c in columns])


def apply_status_changes(actions: DataFrame, changes: DataFrame, key: str, seq: str) -> DataFrame:
    """Latest status change per known action; changes for unknown actions do nothing."""
    latest = keep_last(changes, [key], seq).select(key, F.col("status").alias("_status"), F.col("changed_at").alias("_at"))
    return (actions.join(latest, key, "left")
            .withColumn("updated_at", F.coalesce("_at", "updated_at"))
            .withColumn("status", F.coalesce("_status", "status")).drop("_status", "_at"))


def change_results(actions: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Each change with whether its action exists."""
    return (changes.join(actions.select(key).withColumn("_hit", F.lit(True)), key, "left")
            .withColumn("found", F.col("_hit").isNotNull()).drop("_hit"))


def latest_by(df: DataFrame, key: str, seq: str) -> DataFrame:
    """Whole latest row per key as a struct aggregate (map-side combined)."""
    rest = [c for c in df.columns if c not in (key, seq)]
    best = df.filter(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").groupBy(key).agg(
        F.max(F.struct(seq, *rest)).alias("_best"))
    return best.select(key, "_best.*")


def staleness_days(created: Column, today: Column) -> Column:
    return F.greatest(F.datediff(today, created), F.lit(0))
