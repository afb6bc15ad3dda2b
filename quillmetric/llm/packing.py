"""Best-fit packing of token pieces into fixed-length sequences by exact complements.

Only the number of pieces of each length matters for the plan, and there are at most ``capacity`` lengths. So Spark
counts lengths, the plan is made from that bounded histogram, and each piece finds its place by its number in the
order of lengths. No task sees more than its share of pieces, whatever length a third of them may have.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmetric.llm.tokens import Encoder, encoder, vocabulary_path
from quillmetric.llm.work import Workspace, give_back, running, slices, text_or_empty

CAPACITY = 1024
RELEASED_CHUNKS = 25_000
END_ID = 2

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None,
              release: bool = False) -> DataFrame:
    """Token pieces of ``docs(doc_id, text)``: a document longer than ``capacity`` is cut, its remainder comes first.

    With ``release`` a task has an encoder of its own with room for fewer chunks, and its memory goes back to the system when it ends, for
    jobs whose other steps need it.
    """
    location = vocabulary or vocabulary_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = Encoder(location, RELEASED_CHUNKS) if release else encoder(location)
        end = int(end_id).to_bytes(4, "little")
        to_ids = shared.encode
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = to_ids(text) + end
                n = len(ids) // 4
                first = n % capacity or capacity
                starts = [0, *range(first, n, capacity)]
                for piece, (a, b) in enumerate(zip(starts, [*starts[1:], n])):
                    rows.append((doc_id, piece, a, b - a, zlib.crc32(ids[4 * a:4 * b])))
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                ["doc_id", "piece", "start", "length", "ids_crc32"])
        if release:
            del shared, to_ids
            give_back()

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
            .mapInArrow(cut, PIECES))


class ExactComplements:
    """Sums of one, two and three available lengths, looked up by the gap they must fill."""

    def __init__(self, left: np.ndarray) -> None:
        self.left = left

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if self.left[gap] > 0 else None

    def pair(self, gap: int, longest: int | None = None) -> tuple[int, ...] | None:
        """The pair with this sum whose longer part is longest."""
        low, high = (gap + 1) // 2, min(gap - 1, longest or gap - 1)
        if high < low:
            return None
        a = np.arange(high, low - 1, -1)
        both = (self.left[a] > 0) & (self.left[gap - a] > 0) & ((a != gap - a) | (self.left[a] > 1))
        hit = int(np.argmax(both))
        return (int(a[hit]), gap - int(a[hit])) if both[hit] else None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        for a in range(gap - 2, (gap + 2) // 3 - 1, -1):
            if self.left[a] <= 0:
                continue
            self.left[a] -= 1
            rest = self.pair(gap - a, a)
            self.left[a] += 1
            if rest:
                return (a, *rest)
        return None

    def find(self, gap: int, most: int = 3) -> tuple[int, ...] | None:
        """The fewest lengths, ``most`` at most, that fill the gap."""
        looks = (self.single, self.pair, self.triple)[:most]
        return next((found for look in looks if (found := look(gap))), None)

    def take(self, pattern: tuple[int, ...]) -> int:
        """Consume the pattern as often as its lengths last."""
        parts, needed = np.unique(pattern, return_counts=True)
        times = int((self.left[parts] // needed).min())
        self.left[parts] -= needed * times
        return times


def plan_patterns(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths with how often each is used; together they use every piece once.

    ``counts[n]`` pieces have length n. Long pieces first: each looks for one, two or three pieces that fill its gap
    exactly. What remains goes, longest first, into the fullest open sequence that still takes it. Small pieces that fill gaps in
    threes are missed later where they are rare, so the plan is also made with pairs and with singles at most, and for
    long pieces only; the plan with the fewest sequences counts.
    """
    plans = [_exact_then_best_fit(counts, capacity, most, shortest)
             for most in (3, 2, 1) for shortest in (1, capacity // 2, 3 * capacity // 4)]
    return min(plans, key=lambda plan: sum(times for _, times in plan))


def _exact_then_best_fit(counts: np.ndarray, capacity: int, most: int, shortest: int) -> list[tuple[tuple[int, ...], int]]:
    """The plan whose exact fillings have up to ``most`` pieces beside one of at least ``shortest``."""
    left, plan = counts.astype(np.int64).copy(), []
    if left[capacity]:
        plan.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    index = ExactComplements(left)
    for length in range(capacity - 1, shortest - 1, -1):
        while left[length] > 0:
            left[length] -= 1
            rest = index.find(capacity - length, most)
            left[length] += 1
            if rest is None:
                break
            pattern = (length, *rest)
            plan.append((pattern, index.take(pattern)))
    return plan + _best_fit(left, capacity)


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    open_by_gap: dict[int, list[list]] = {}
    for length in range(capacity, 0, -1):
        waiting = int(left[length])
        while waiting:
            gap = min((g for g, kinds in open_by_gap.items() if g >= length and kinds), default=None)
            if gap is None:
                each = min(waiting, capacity // length)
                pattern, times = (length,) * each, waiting // each
            else:
                kind = open_by_gap[gap].pop()
                each = min(waiting, gap // length)
                times = min(kind[1], waiting // each)
                if times < kind[1]:
                    open_by_gap[gap].append([kind[0], kind[1] - times])
                pattern = kind[0] + (length,) * each
            waiting -= each * times
            open_by_gap.setdefault(capacity - sum(pattern), []).append([pattern, times])
    return [(pattern, times) for kinds in open_by_gap.values() for pattern, times in kinds]


def place_runs(counts: np.ndarray, plan: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive pieces, numbered in the order of lengths: first number, sequence of the first, offset of all.

    The k-th piece of a run lies in the k-th sequence of its pattern.
    """
    next_of = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    runs, sequence = [], 0
    for pattern, times in plan:
        offset = 0
        for length in pattern:
            runs.append((int(next_of[length]), sequence, offset))
            next_of[length] += times
            offset += length
        sequence += times
    runs.sort()
    first, base, offset = (np.array(c, dtype=np.int64) for c in zip(*runs)) if runs else (np.zeros(0, np.int64),) * 3
    return first, base, offset


def pack(pieces: DataFrame, work: Workspace, capacity: int = CAPACITY) -> DataFrame:
    """Give every row of ``pieces`` (PIECES) a sequence and an offset there; sequences hold at most ``capacity`` ids.

    Equal rows are separate pieces. An empty table gives no rows.
    """
    stored = work.table(pieces, "pieces")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in stored.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[length] = n
    first, base, offset = place_runs(counts, plan_patterns(counts, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column("number").to_numpy()
            run = np.searchsorted(first, number, side="right") - 1
            keep = [batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(base[run] + number - first[run]), pa.array(offset[run])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    numbered = running(stored.withColumn("one", F.lit(1).cast("long")), "one",
                       ["length", "doc_id", "piece", "ids_crc32"], "number", work)
    return numbered.drop("one").mapInArrow(place, PLACED)


def pack_documents(docs: DataFrame, work: Workspace, capacity: int = CAPACITY, end_id: int = END_ID,
                   vocabulary: str | None = None, release: bool = False) -> DataFrame:
    """Tokenize, cut and pack ``docs(doc_id, text)``; null texts are empty and still give their end id."""
    return pack(pieces_of(docs, capacity, end_id, vocabulary, release), work, capacity)
