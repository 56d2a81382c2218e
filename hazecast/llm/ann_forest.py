"""Approximate nearest neighbours by a hash-prefix forest.

Every vector has, in each of ``trees`` trees, a hash string of 64 random
hyperplane signs; a tree is the sorted array of these strings.  A query
descends to its longest-prefix matches in all trees (binary search) and then
ascends all trees together: at each shorter prefix the ranges around its place
widen and their new members become candidates.  Candidates are scored as they
come, and the ascent ends when a vector as near as the k-th best found would
have been missed by all trees with a probability of at most ``miss``:
``(1 - p^length)^trees`` with ``p = 1 - angle / pi``.  Near copies end after a
few candidates; queries without near neighbours climb until the bound holds.

The index is sharded: ``shard_rows`` vectors a shard, each with its own forest
built in the task that streams the queries past it (queries against all rows
in blocks), so memory is bounded by a shard and a batch of queries.  Identical
vectors are one entry holding its k + 1 smallest ids, so a vector that a third
of all rows share costs one candidate.  The k best of each shard meet in a
bounded ranking per query.

Float32 cosines steer the ascent and set apart what cannot be among the best:
an entry is scored in double unless its float32 cosine is below the best ones
by more than twice the bound of their error.  Near copies that float32 cannot
order are thus all scored in double, however many they are.

Vectors that are null, zero or hold null or non-finite components, and rows
without vec_id, take no part; repeated rows count once; shorter vectors count
as padded with zeros.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazecast.llm.common import dimension, materialize, vector_classes, vectors_of

TREES = 32
BITS = 64
SHARD_ROWS = 16_384
MISS = 0.08
SEED = 11
#: Prefix lengths of the ascent, longest first; below 20 every length counts.
LADDER = (64, 48, 36, 28, 23, *range(20, -1, -1))
#: Entries scored in double at a time.
BLOCK = 1024


class Forest:
    """The sorted arrays of one shard."""

    def __init__(self, vectors: np.ndarray, planes: np.ndarray):
        self.vectors = vectors
        self.norms = np.linalg.norm(vectors, axis=1)
        self.unit = (vectors / self.norms[:, None]).astype(np.float32)
        self.planes = planes
        codes = hash_strings(self.unit, planes)
        self.order = np.argsort(codes, axis=1, kind="stable").astype(np.int32)
        self.codes = np.take_along_axis(codes, self.order, axis=1)

    def ranges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[level, tree, query] start and end of the range that shares the
        level's prefix with the query."""
        trees, n = codes.shape
        low = np.empty((len(LADDER), trees, n), np.int64)
        high = np.empty_like(low)
        for i, length in enumerate(LADDER):
            rest = np.uint64((1 << (BITS - length)) - 1)
            for t in range(trees):
                low[i, t] = np.searchsorted(self.codes[t], codes[t] & ~rest)
                high[i, t] = np.searchsorted(self.codes[t], codes[t] | rest, side="right")
        return low, high

    def search(self, queries: np.ndarray, want: int, miss: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(entries, cosines) of at least the ``want`` best entries found for
        each query, nearest first."""
        norms = np.linalg.norm(queries, axis=1)
        unit = (queries / norms[:, None]).astype(np.float32)
        low, high = self.ranges(hash_strings(unit, self.planes))
        trees = low.shape[1]
        for q in range(len(queries)):
            seen = np.zeros(len(self.vectors), bool)
            found, scores = [], []
            lo, hi, best = low[:, :, q], high[:, :, q], np.empty(0, np.float32)
            for i, length in enumerate(LADDER):
                fresh = []
                for t in np.flatnonzero(hi[i] - lo[i] > (hi[i - 1] - lo[i - 1] if i else 0)):
                    a, b = lo[i, t], hi[i, t]
                    if i and hi[i - 1, t] > lo[i - 1, t]:
                        fresh += [self.order[t, a:lo[i - 1, t]], self.order[t, hi[i - 1, t]:b]]
                    else:
                        fresh.append(self.order[t, a:b])
                if fresh:
                    entries = np.concatenate(fresh)
                    entries = entries[~seen[entries]]
                    seen[entries] = True
                    entries = np.unique(entries) if len(fresh) > 1 else entries
                    s = self.unit[entries] @ unit[q]
                    found.append(entries)
                    scores.append(s)
                    best = np.concatenate([best, s])
                    if len(best) > want:
                        best = np.partition(best, len(best) - want)[-want:]
                if len(best) >= want:
                    p = 1 - np.arccos(np.clip(float(best.min()), -1, 1)) / np.pi
                    if (1 - p ** length) ** trees <= miss:
                        break
            entries, s = np.concatenate(found), np.concatenate(scores)
            if len(entries) > want:             # float scores leave out, double ones decide
                least = np.partition(s, len(s) - want)[len(s) - want]
                entries = entries[s >= least - 2 * cosine_error(self.vectors.shape[1])]
            exact = np.concatenate([self.cosines(entries[a:a + BLOCK], queries[q], norms[q])
                                    for a in range(0, len(entries), BLOCK)])
            if len(entries) > want:             # ties of the last one stay
                tied = exact >= np.partition(exact, len(exact) - want)[len(exact) - want]
                entries, exact = entries[tied], exact[tied]
            by = np.argsort(-exact, kind="stable")
            yield entries[by], exact[by]

    def cosines(self, entries: np.ndarray, query: np.ndarray, norm: float) -> np.ndarray:
        """Cosines in double; a row's sum does not depend on the rows beside
        it, so exact ties stay ties in every block and shard."""
        return np.einsum("ij,j->i", self.vectors[entries], query) / (self.norms[entries] * norm)


def cosine_error(dim: int) -> float:
    """Bound of the error of a float32 cosine: ``dim`` products and sums, in
    any order, of components rounded to float32 (two roundings a product),
    rounded up for the norms of the rounded vectors and the double score."""
    u = (dim + 6) * 2.0 ** -24
    return 1.01 * u / (1 - u) if u < 0.5 else 1.0


def hash_strings(unit: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """[tree, row] hash strings as unsigned integers, first sign highest."""
    out = np.empty((len(planes), len(unit)), np.uint64)
    for t, p in enumerate(planes):
        out[t] = np.packbits(unit @ p > 0, axis=1).view(">u8").ravel()
    return out


def hyperplanes(dim: int, trees: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((trees, dim, BITS)).astype(np.float32)


def search(embeddings: DataFrame, is_query: Column, k: int = 5, trees: int = TREES, shard_rows: int = SHARD_ROWS,
           miss: float = MISS, seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every query row."""
    rows = vector_classes(embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
                          .where("vec_id is not null"))
    ids = rows.select("k1", "k2", "vec_id").distinct()
    place = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("vec_id"))
    ids = (ids.withColumn("n", place).where(F.col("n") <= k + 1)          # k + 1 of a class at most
           .groupBy("k1", "k2").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    vectors = rows.groupBy("k1", "k2").agg(F.first("embedding").alias("embedding"))
    entries = materialize(vectors.join(ids, ["k1", "k2"]), "classes")
    dim, n = dimension(entries), entries.count()
    shards = -(-n // shard_rows)
    queries = rows.where(is_query).groupBy("vec_id", "k1", "k2").agg(F.first("embedding").alias("embedding"))
    both = entries.select(F.pmod("k1", F.lit(max(1, shards))).cast("int").alias("shard"), F.lit(0).alias("tag"),
                          F.lit(None).cast("long").alias("query_id"), "k1", "ids", "embedding")
    both = both.unionByName(queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(max(1, shards) - 1))).alias("shard"), F.lit(1).alias("tag"),
        F.col("vec_id").alias("query_id"), "k1", F.array().cast("array<long>").alias("ids"), "embedding"))

    def look(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = hyperplanes(dim, trees, seed)
        shard, held, members, forest = None, [], [], None
        for batch in it:
            mark = batch.column("shard").to_numpy() * 2 + batch.column("tag").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(mark)) + 1).tolist(), len(mark)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                part, now = batch.slice(a, b - a), int(mark[a]) // 2
                if now != shard:
                    shard, held, members, forest = now, [], [], None
                if mark[a] % 2 == 0:
                    held.append(vectors_of(part.column("embedding"), dim))
                    members += part.column("ids").to_pylist()
                elif held or forest is not None:
                    if forest is None:
                        forest = Forest(np.concatenate(held), planes)
                        held = []
                    yield from answers(forest, members, part)

    def answers(forest: Forest, members: list, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = forest.search(vectors_of(part.column("embedding"), dim), k + 1, miss)
        out: list[list] = [[], [], [], []]
        for q, key, (entries, scores) in zip(part.column("query_id").to_pylist(), part.column("k1").to_pylist(), found):
            top: list[tuple[float, int]] = []
            last = -np.inf                      # score of the k-th best
            for e, s in zip(entries.tolist(), scores.tolist()):
                if s < last:
                    break
                top += [(-s, i) for i in members[e] if i != q]
                if len(top) >= k and last == -np.inf:
                    last = s
            for s, i in sorted(top)[:k]:
                for column, v in zip(out, (q, key, i, -s)):
                    column.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(),) * 3 + (pa.float64(),))],
                                         ["query_id", "k1", "vec_id", "score"])

    local = (both.repartition("shard").sortWithinPartitions("shard", "tag")
             .mapInArrow(look, "query_id long, k1 long, vec_id long, score double"))
    rank = F.row_number().over(Window.partitionBy("query_id", "k1").orderBy(F.desc("score"), "vec_id"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
