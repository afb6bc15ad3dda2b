"""Quality classifier: gradient-boosted trees over statistics of whole texts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmetric.llm.boosting import Trees, fit
from quillmetric.llm.work import SLICE_ROWS, give_back, slices, text_or_empty

#: Labelled rows that the trees are fitted on, at most; which ones is decided by a hash of the doc_id.
SAMPLE_ROWS = 30_000
FOLDS = 3
HELD_OUT_FOLD = 1

_CLASSES = {"lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789",
            "blank": b" \t\r\x0b\x0c", "line": b"\n", "stop": b".,;:?'\"-()", "shout": b"!", "bar": b"|",
            "sign": b"#$%&*+/<=>@[\\]^_`{}~"}
_CLASS_NAMES = [*_CLASSES, "control", "other"]


def _class_table() -> np.ndarray:
    table = np.full(256, len(_CLASSES) + 1, dtype=np.uint8)
    table[:128] = len(_CLASSES)
    for k, members in enumerate(_CLASSES.values()):
        table[list(members)] = k
    return table


_CLASS_OF = _class_table()

FEATURES = ("log_bytes", "log_words", "word_length", "log_lines", "line_length", *[f"share_{c}" for c in _CLASS_NAMES],
            "byte_entropy", "distinct_words", "top_word", "repeats", "distinct_pairs", "longest_run", "distinct_lines",
            "capital_words", "shouted_words", "signed_words", "stopped_lines")


def statistics(text: str) -> list[float]:
    """FEATURES of a text; shares of nothing are zero."""
    raw = text.encode("utf-8", "surrogatepass")
    codes = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    shares = np.bincount(_CLASS_OF, codes, len(_CLASS_NAMES)) / max(len(raw), 1)
    p = codes[codes > 0] / max(len(raw), 1)
    words, lines = text.split(), text.split("\n")
    n = max(len(words), 1)
    counts = Counter(words)
    same = list(map(eq, words, words[1:]))
    longest = run = 0
    if any(same):
        for s in same:
            run = run + 1 if s else 0
            longest = max(longest, run)
    known = [(w[0].isupper(), len(w) > 1 and w.isupper(), not w[-1].isalnum() and w[-1] not in ".,;:?!'\"", c)
             for w, c in counts.items()]
    full = [line for line in lines if line.strip()]
    return [np.log1p(len(raw)), np.log1p(len(words)), sum(len(w) * c for w, c in counts.items()) / n, np.log1p(len(lines)),
            len(text) / len(lines), *shares, float(-(p * np.log2(p)).sum()), len(counts) / n,
            max(counts.values(), default=0) / n, sum(same) / n, len(set(zip(words, words[1:]))) / n, longest / n,
            len(set(full)) / max(len(full), 1), sum(c for a, _, _, c in known if a) / n,
            sum(c for _, b, _, c in known if b) / n, sum(c for _, _, s, c in known if s) / n,
            sum(line.rstrip()[-1] in ".!?" for line in full) / max(len(full), 1)]


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the doc_id as text, modulo FOLDS; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % FOLDS


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Fit to ``labels(doc_id, quality)`` outside the held-out fold, on at most ``sample_rows`` documents.

    Null labels and labels other than 0 and 1 take no part; of several labels of a document the highest counts. Only the
    statistics of the sampled documents come to the driver.
    """
    known = (labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold() != HELD_OUT_FOLD))
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality")))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("quality"),
                 pa.array([statistics(t) for t in batch.column("text").to_pylist()], pa.list_(pa.float64()))],
                ["doc_id", "quality", "features"])
        give_back()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    described = (texts.join(F.broadcast(sample), "doc_id")  # at most sample_rows pairs of numbers
                 .mapInArrow(describe, "doc_id long, quality int, features array<double>")
                 .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("features").alias("features")))
    rows = described.toArrow().sort_by("doc_id")
    x = np.array(rows["features"].to_pylist(), dtype=np.float64).reshape(len(rows), len(FEATURES))
    return fit(x, rows["quality"].to_numpy().astype(np.float64))


def score_column(trees: Trees, text: Column) -> Column:
    """Score of class 1 for whole texts, 0 to 1; empty and null texts have a score as well."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        found = [statistics(t or "") for start in range(0, len(texts), SLICE_ROWS) for t in texts[start:start + SLICE_ROWS].to_pylist()]
        return pa.array(trees.scores(np.array(found, dtype=np.float64).reshape(len(found), len(FEATURES))))

    return score(text)


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs(doc_id, text)``.

    Repeated rows get the same score. Without usable labels every score is 0.5 and every prediction 1. An empty table gives no rows.
    """
    trees = train(docs, labels, sample_rows)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score_column(trees, F.col("text")).alias("score"))
    return scored.select("doc_id", (fold() == HELD_OUT_FOLD).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents with a score of 0.5 or more, their columns as they are."""
    trees = train(docs, labels, sample_rows)
    scored = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                         score_column(trees, F.col("text")).alias("_score"))
    return scored.filter("_score >= 0.5").select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
