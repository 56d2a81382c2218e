"""Best-fit packing of tokenised documents into sequences of fixed capacity.

1. Every document becomes token ids plus an end id and is cut into pieces of
   at most ``capacity`` (only longer documents are cut).  The pieces are one
   narrow table in the shared folder, with a local rank per (file, length).
2. Packing depends on lengths alone, so the plan is made on the histogram of
   lengths: at most ``capacity`` bins, whatever the number of documents.
   Exact-complement hashing goes first: the longest lengths look up the gap
   they leave in an index of single lengths, of pair sums and of triple sums,
   and a combination that fills the gap exactly is consumed as often as the
   availability counts allow.  What is left goes best-fit, again many equal
   bins at a time.
3. A piece finds its place from its length and its rank among the pieces of
   that length: ranks are local ranks plus offsets of (file, length) counts,
   and the plan is a bounded lookup table.  No piece is collected, sorted or
   shuffled by length, so a length that a third of all documents share costs
   nothing extra.

Null and empty texts hold the end id alone.  Rows may repeat; each is packed.
Null doc_ids are carried along.  An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazecast.llm.common import frugal, materialize, worker_cache
from hazecast.llm.tokens import WordIds

CAPACITY = 4096
END_ID = 1
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long"


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document with their rank among the pieces of equal
    length of the same task."""
    end = int(end_id).to_bytes(4, "little")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = worker_cache(f"word_ids:{vocabulary}", lambda: WordIds(vocabulary)).ids
        part, seen = TaskContext.get().partitionId(), Counter()
        for b in it:
            out: list[list] = [[] for _ in range(7)]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                data = ids(text.as_py()) + end
                total = len(data) // 4
                for k, start in enumerate(range(0, total, capacity)):
                    length = min(capacity, total - start)
                    crc = zlib.crc32(memoryview(data)[4 * start:4 * (start + length)])
                    for column, v in zip(out, (doc, k, start, length, crc, part, seen[length])):
                        column.append(v)
                    seen[length] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(frugal(batches, cached=True), PIECES)


# ---------------------------------------------------------------------------
# the plan, on the histogram of lengths
# ---------------------------------------------------------------------------


class _Lengths:
    """Availability counts with the index of single, pair and triple sums."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.count = np.zeros(capacity + 1, np.int64)
        for length, n in histogram.items():
            self.count[length] = n
        self.pairs = self._pair_sums()

    def _pair_sums(self) -> np.ndarray:
        """Whether a sum of two available lengths makes each total."""
        have = (self.count > 0).astype(float)
        n = 2 * len(have)
        return np.rint(np.fft.irfft(np.fft.rfft(have, n) ** 2, n))[:len(have)] > 0

    def pair(self, total: int) -> tuple[int, int] | None:
        """Available a >= b with a + b = total."""
        if total < 2 or not self.pairs[total]:
            return None
        have = self.count[:total] > 0
        for a in np.flatnonzero(have[1:] & have[:0:-1])[::-1] + 1:
            if a >= total - a and (a != total - a or self.count[a] > 1):
                return int(a), int(total - a)
        return None

    def triple(self, total: int) -> tuple[int, int, int] | None:
        if total < 3:
            return None
        for a in np.flatnonzero((self.count[1:total] > 0) & self.pairs[total - 1:0:-1])[::-1] + 1:
            self.count[a] -= 1
            found = self.pair(int(total - a))
            self.count[a] += 1
            if found:
                return (int(a), *found)
        return None

    def exact(self, length: int, capacity: int) -> Counter | None:
        """A combination with ``length`` that fills a sequence exactly."""
        gap = capacity - length
        self.count[length] -= 1
        rest = () if gap == 0 else (gap,) if self.count[gap] > 0 else self.pair(gap) or self.triple(gap)
        self.count[length] += 1
        return None if rest is None else Counter((length, *rest))

    def consume(self, combination: Counter) -> int:
        """Take the combination as often as the counts allow."""
        n = min(int(self.count[x]) // k for x, k in combination.items())
        for x, k in combination.items():
            self.count[x] -= n * k
            if not self.count[x]:
                self.pairs = self._pair_sums()
        return n


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Sequences as (how many, [(length, pieces of it), ...])."""
    have = _Lengths(histogram, capacity)
    plan: list[tuple[int, list[tuple[int, int]]]] = []
    for length in range(capacity, 0, -1):
        while have.count[length] and (found := have.exact(length, capacity)):
            n = have.consume(found)
            if not n:
                break
            plan.append((n, sorted(found.items(), reverse=True)))
    # residuals: best fit, with bins of the same gap and content as one group
    groups: dict[int, list] = defaultdict(list)
    gaps: list[int] = []

    def add(gap: int, n: int, content: list) -> None:
        if gap not in groups:
            insort(gaps, gap)
        groups[gap].append((n, content))

    for length in range(capacity, 0, -1):
        left = int(have.count[length])
        while left:
            k = bisect_left(gaps, length)
            if k < len(gaps):
                gap = gaps[k]
                n, content = groups[gap].pop()
                if not groups[gap]:
                    del groups[gap], gaps[k]
            else:
                gap, n, content = capacity, left, []
            fit = min(gap // length, left)
            used = min(n, left // fit)
            if used < n and content:
                add(gap, n - used, content)
            left -= used * fit
            add(gap - fit * length, used, [*content, (length, fit)])
    plan += [g for gap in gaps for g in groups[gap]]
    return plan


def slots(plan: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """For each length the ranges of ranks with the sequences they go to,
    sorted by (length, first rank)."""
    taken: Counter = Counter()
    rows, first = [], 0
    for n, content in plan:
        offset = 0
        for length, k in content:
            rows.append((length, taken[length], first, k, offset))
            taken[length] += n * k
            offset += length * k
        first += n
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "first", "each", "offset"), a.T.copy()))


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset."""
    pieces = materialize(token_pieces(docs, vocabulary, capacity, end_id), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}   # at most ``capacity`` rows
    table = slots(plan_packing(histogram, capacity))

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = int(table["rank"].max(initial=0)) + 1
        at = table["length"] * span + table["rank"]
        for b in it:
            length, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            k = np.searchsorted(at, length * span + np.minimum(rank, span - 1), side="right") - 1
            nth = rank - table["rank"][k]
            sequence = table["first"][k] + nth // table["each"][k]
            offset = table["offset"][k] + nth % table["each"][k] * length
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(offsets, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("local")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, "
                                    "sequence_id long, offset long")
