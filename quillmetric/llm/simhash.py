"""SimHash fingerprints and their links within a small Hamming distance, by meeting in the middle.

Every different fingerprint emits all variants within half the radius. Two fingerprints within the radius share a variant;
fingerprints that share one are within the radius of each other. A variant therefore meets a bounded
number of different fingerprints, however many documents have them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmetric.llm.components import components
from quillmetric.llm.work import Workspace, give_back, slices, small, text_or_empty

SHINGLE_WORDS = 3
RADIUS = 2
HASH_SEED = 42
BITS = 64
_BLOCK = 4096


def shingle_hashes(text: str, width: int = SHINGLE_WORDS, seed: int = HASH_SEED) -> np.ndarray:
    """XXH64 of every shingle of ``width`` words, repeats included; a shorter text is one shingle, none if it has no word."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > width:
        starts, ends = starts[:len(words) - width + 1], ends[width - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends.tolist())], dtype=np.uint64)


def majority_bits(hashes: np.ndarray) -> int:
    """The fingerprint whose bits are set in over half the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(hashes), _BLOCK):
        block = hashes[start:start + _BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, fingerprint (long)`` of whole texts; null texts are empty and, like all texts without words, get zero."""

    def print_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = np.array([majority_bits(shingle_hashes(t, width)) for t in batch.column("text").to_pylist()],
                              dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values)], ["doc_id", "fingerprint"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
            .mapInArrow(print_of, "doc_id long, fingerprint long"))


def variants(fingerprint: Column, reach: int, bits: int = BITS) -> Column:
    """Array of all values within ``reach`` bits of the fingerprint."""
    masks = [sum(1 << b for b in chosen) for n in range(reach + 1) for chosen in combinations(range(bits), n)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    return F.transform(F.array(*[F.lit(m) for m in signed]), lambda m: fingerprint.bitwiseXOR(m))


def meeting_pairs(prints: DataFrame, node: str, radius: int = RADIUS) -> DataFrame:
    """Different pairs ``a, b`` of nodes that meet in a variant, for ``prints(view, fingerprint, <node>)``; radius even.

    All fingerprints that meet in a variant are within the radius of each other. Their nodes are chained in order, and only
    neighbours in the chain become pairs: no group is paired out. Where being within the radius is the link itself, nothing is lost
    from what they connect; where it only makes candidates, ``pairs_apart`` has the pairs that a failed neighbour leaves open. A row of the
    shuffle is a node and a meeting place: the variant, shifted by a constant of its view, so that one view's variants stay apart.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    variant = F.explode(variants(F.col("fingerprint"), radius // 2)).alias("variant")
    met = prints.select("view", F.col(node).alias("node"), variant).select(F.col("variant").bitwiseXOR(F.xxhash64("view")).alias("place"), "node")
    chain = Window.partitionBy("place").orderBy("node")
    pairs = met.select(F.lag("node").over(chain).alias("a"), F.col("node").alias("b")).filter(F.col("a").isNotNull())
    return pairs.filter("a <> b").distinct()


def linked_fingerprints(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Verified edges ``a, b`` between different values of ``prints(fingerprint)`` that connect all those within ``radius``."""
    distinct = prints.select(F.lit(0).alias("view"), "fingerprint").distinct()
    within = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    return meeting_pairs(distinct, "fingerprint", radius).filter(within)


def classes(docs: DataFrame, work: Workspace, width: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fingerprint (long), component_id`` for every row of ``docs(doc_id, text)``.

    component_id is the smallest doc_id reachable over links of at most ``radius`` differing bits, itself included.
    Copies share a fingerprint and are never paired. Rows with a null doc_id take part and get the smallest
    doc_id of their group, null if it has none. An empty table gives no rows.
    """
    printed = work.table(fingerprints(docs, width), "fingerprints")
    least = printed.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    roots = components(linked_fingerprints(printed, radius), work)
    rooted = least.join(roots, least["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("fingerprint", "component_id")
    return printed.join(work.table(named, "classes"), "fingerprint").select("doc_id", "fingerprint", "component_id")


# --- near copies by similarity: several fingerprints of the words find candidates, shingles verify them ---

VIEWS = 4
SIMILARITY = 0.8
SIMILAR_SHINGLE = 5
SKETCH = 256
CLEAR = 6
_SETS = 32


def word_prints(text: str, views: int = VIEWS) -> list[int]:
    """Fingerprints of the words, each word weighing the root of its count, one for each of ``views`` hash seeds."""
    counts = Counter(text.encode().lower().split())
    if not counts:
        return [0] * views
    weights = np.sqrt(np.fromiter(counts.values(), dtype=np.float64, count=len(counts)))
    half, digest, found = weights.sum() / 2, xxhash.xxh64_intdigest, []
    for seed in range(views):
        hashes = np.array([digest(w, seed) for w in counts], dtype=np.uint64)
        on = np.zeros(BITS)
        for start in range(0, len(hashes), _BLOCK):
            block = hashes[start:start + _BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8)
            on += weights[start:start + _BLOCK] @ np.unpackbits(block, axis=1)
        found.append(int(np.packbits(on > half).view(">i8")[0]))
    return found


def least_hashes(hashes: np.ndarray, size: int = SKETCH) -> np.ndarray:
    """The ``size`` least different hashes, ascending, in 32 bits; all of them if there are fewer."""
    return np.unique(hashes >> np.uint64(32)).astype(np.uint32)[:size]


def shingle_sketch(text: str, size: int = SKETCH, width: int = SIMILAR_SHINGLE) -> np.ndarray:
    """The least hashes of a text's shingles."""
    return least_hashes(shingle_hashes(text, width), size)


def sketch_similarity(a: np.ndarray, b: np.ndarray, size: int = SKETCH) -> float:
    """Jaccard similarity of two shingle sets: exact when both have at most ``size`` shingles together, else estimated from the least."""
    if not len(a) and not len(b):
        return 1.0
    union = np.union1d(a, b)[:size]
    both = np.intersect1d(a, b, assume_unique=True)
    return np.count_nonzero(both <= union[-1]) / len(union)


def pairs_apart(members: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """All different pairs ``a, b`` of nodes with different roots within two bits in a view, for
    ``members(node, root, shingles, prints, view, fingerprint)``, but for those whose numbers of shingles alone rule the similarity out.

    Near fingerprints are found on their different values; only where those have several roots do their nodes meet. Spark takes the
    exploded variants for as small as the values that they come from and would send all of them through the driver, so they meet by shuffling.
    """
    key = ["view", "fingerprint"]
    values = members.groupBy(*key).agg(F.min("root").alias("low"), F.max("root").alias("high"))
    met = values.withColumn("variant", F.explode(variants(F.col("fingerprint"), RADIUS // 2)))
    other = met.withColumnsRenamed({"fingerprint": "near", "low": "low2", "high": "high2"})
    near = (met.join(other.hint("merge"), ["view", "variant"]).filter("fingerprint <= near AND least(low, low2) <> greatest(high, high2)")
            .select(*key, "near").distinct())
    left = members.withColumnsRenamed({"node": "a", "root": "root_a", "shingles": "size_a", "prints": "prints_a"})
    right = members.withColumnsRenamed({"node": "b", "root": "root_b", "shingles": "size_b", "prints": "prints_b", "fingerprint": "near"})
    # a hair below the limit, as the product is rounded
    sizes = F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * (similarity - 1e-9)
    once = (F.col("fingerprint") < F.col("near")) | (F.col("a") < F.col("b"))
    within = F.zip_with("prints_a", "prints_b", lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= RADIUS)
    first = F.array_position(within, True) == F.col("view") + 1  # a pair is made in its first view only
    met = near.join(left, key).join(right, ["view", "near"]).filter((F.col("root_a") != F.col("root_b")) & sizes & once & first)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def sketch_verdict(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY, size: int = SKETCH) -> bool | None:
    """Whether the similarity reaches the limit, or None where the sketches cannot tell.

    Sets below ``size`` are all there: only 32-bit hashes that coincide could move them by a shingle or two. Of larger ones the
    estimate counts as clear when it is ``CLEAR`` standard errors away from the limit.
    """
    if not len(a) or not len(b):
        return len(a) == len(b)
    if len(a) < size and len(b) < size:
        margin = 2 / (len(a) + len(b))
        size = 2 * size
    else:
        margin = CLEAR * (similarity * (1 - similarity) / size) ** 0.5
    estimate = sketch_similarity(a, b, size)
    return estimate > similarity if abs(estimate - similarity) > margin else None


def alike_sets(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether two sets without repeats have a Jaccard similarity of ``similarity`` or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - both
    return not union or both / union >= similarity  # a division is rounded to the nearest, as the limit is


def text_keys(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` (empty for null), two 64-bit hashes of the text, which together stand for it, and the whole row."""
    text = text_or_empty()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("_k1"),
                       F.xxhash64(F.lit("second"), text).alias("_k2"),
                       F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def near_classes(docs: DataFrame, work: Workspace, views: int = VIEWS, similarity: float = SIMILARITY) -> DataFrame:
    """Per different text of ``docs(doc_id, text)``: ``_k1, _k2`` (its hashes), ``least`` (smallest doc_id that has it),
    ``copies`` (rows that have it) and ``root`` (the same for all texts linked to it).

    Texts are candidates when one of their word fingerprints is within two bits; candidates link when their sets of five-word
    shingles have a Jaccard similarity of ``similarity`` or more. Neighbours in the chains are compared first. Where a
    chain still has several groups, all its candidates of different groups are compared, so no link is left out. Sketches decide
    clear cases, the whole sets all others.
    """

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints, sizes, sketches = [], [], []
            for value in batch.column("text"):  # one text and its hashes at a time
                text = value.as_py()
                hashes = np.unique(shingle_hashes(text, SIMILAR_SHINGLE))
                prints.append(word_prints(text, views))
                sizes.append(len(hashes))
                sketches.append(least_hashes(hashes).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("_k1"), batch.column("_k2"), pa.array(prints, pa.list_(pa.int64())),
                 pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary())],
                ["doc_id", "_k1", "_k2", "prints", "shingles", "sketch"])
        give_back()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            left, right = batch.column("left").to_pylist(), batch.column("right").to_pylist()
            verdicts = [sketch_verdict(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), similarity)
                        for x, y in zip(left, right)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(verdicts, pa.bool_())], ["a", "b", "alike"])
        give_back()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, _SETS):
            sets = [np.unique(shingle_hashes(t, SIMILAR_SHINGLE)).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], ["node", "hashes"])
        give_back()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, _SETS):
            left, right = batch.column("left").to_pylist(), batch.column("right").to_pylist()
            met = [alike_sets(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), similarity) for x, y in zip(left, right)]
            yield batch.select(["a", "b"]).filter(pa.array(met, pa.bool_()))
        give_back()

    rows = text_keys(docs.select("doc_id", "text")).drop("_row")
    described = rows.mapInArrow(describe, "doc_id long, _k1 long, _k2 long, prints array<long>, shingles long, sketch binary")
    texts = work.table(described.groupBy("_k1", "_k2").agg(
        F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("prints").alias("prints"),
        F.first("shingles").alias("shingles"), F.first("sketch").alias("sketch"))
        .withColumn("node", F.monotonically_increasing_id()), "texts")  # numbered once, in the written table
    prints = texts.select("node", F.posexplode("prints").alias("view", "fingerprint"))
    sketches = texts.select("node", "sketch")

    def with_both(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
        sides = (pairs.join(table.withColumnsRenamed({"node": "a", value: "left"}), "a")
                 .join(table.withColumnsRenamed({"node": "b", value: "right"}), "b"))
        return sides.select("a", "b", "left", "right")

    def alike(pairs: DataFrame) -> DataFrame:
        told = work.table(with_both(pairs, sketches, "sketch").mapInArrow(verify, "a long, b long, alike boolean"), "verdicts")
        sure, unclear = told.filter("alike").select("a", "b"), told.filter("alike IS NULL").select("a", "b")
        if unclear.isEmpty():
            return sure
        nodes = unclear.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = small(work.table(texts.join(nodes, "node").select("node", "_k1", "_k2", "least"), "unclear"))
        # one of the rows that have the text: of equal ones, any
        found = rows.join(wanted, ["_k1", "_k2"]).filter(F.col("doc_id").eqNullSafe(F.col("least"))).select("node", "text")
        sets = work.table(found.mapInArrow(gather, "node long, hashes binary").dropDuplicates(["node"]), "hashes")
        exact = with_both(unclear, sets, "hashes").mapInArrow(compare, "a long, b long")
        return sure.unionByName(exact)

    def grouped(edges: DataFrame) -> DataFrame:
        roots = texts.select("node").join(components(edges, work), "node", "left")
        return work.table(roots.select("node", F.coalesce("root", "node").alias("root")), "roots")

    pairs = work.table(meeting_pairs(prints, "node"), "pairs")
    edges = work.table(alike(pairs), "alike")
    roots = grouped(edges)
    # every group at a meeting place of several groups is next to another one in its chain; roots has a row for every text in few
    # bytes of file, by which Spark would take it for small
    apart = (pairs.join(roots.withColumnsRenamed({"node": "a", "root": "root_a"}).hint("merge"), "a")
             .join(roots.withColumnsRenamed({"node": "b", "root": "root_b"}).hint("merge"), "b").filter("root_a <> root_b"))
    unsure = work.table(apart.select(F.explode(F.array("root_a", "root_b")).alias("root")).distinct(), "unsure")
    if not unsure.isEmpty():
        members = roots.join(small(unsure), "root").join(texts.select("node", "shingles", "prints"), "node")
        members = members.select("node", "root", "shingles", "prints", F.posexplode("prints").alias("view", "fingerprint"))
        left_out = work.table(pairs_apart(work.table(members, "members"), similarity), "left-out")
        roots = grouped(edges.unionByName(alike(left_out)))
    return work.table(texts.select("_k1", "_k2", "least", "copies", "node").join(roots.hint("merge"), "node").drop("node"), "groups")


def one_of_each(docs: DataFrame, work: Workspace, views: int = VIEWS, similarity: float = SIMILARITY) -> DataFrame:
    """The documents without their near copies: of each group the row with the smallest doc_id stays, its columns as they are.

    Of texts in a group the one with that doc_id stays. A group without any doc_id keeps all rows of its least text;
    equal rows, being one document, stay together. Null texts are empty texts. An empty table gives no rows.
    """
    grouped = near_classes(docs, work, views, similarity)
    firsts = grouped.groupBy("root").agg(F.min(F.struct("least", "_k1", "_k2")).alias("first"))
    chosen = (grouped.join(firsts, "root").select("_k1", "_k2", "least",
              F.struct("least", "_k1", "_k2").eqNullSafe(F.col("first")).alias("stays"), "copies"))
    # only texts that go, or whose copies do, need a mark
    marks = small(work.table(chosen.filter("NOT stays OR copies > 1"), "marks"))
    marked = text_keys(docs).join(marks, ["_k1", "_k2"], "left")
    kept = marked.filter(F.col("stays").isNull() | (F.col("stays") & F.col("doc_id").eqNullSafe(F.col("least"))))
    return kept.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
