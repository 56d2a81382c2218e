"""Hard-negative mining with Kronecker-packed products.

Components are whole numbers, ``floor(scale * x)``, and a score is an integer
inner product.  The components of several candidates are made non-negative by a
bias and put into separated fields of one wide integer a dimension; an
anchor's (biased) component multiplies that integer once, the products are
summed over the dimensions, and every field of the sum is the biased score of
one candidate.  Fields are as wide as the largest possible sum, so they never
run over, and the biases are taken off exactly.  Where two or more fields fit
in 53 bits the wide integers are whole doubles, whose sums of products are
exact in any order; wider ones are Python integers of any length, so scores
are exact for all finite components.

Rows are dealt by hash into shards of bounded bytes; anchors (a stated query
set) stream past every shard in blocks, so a task holds one shard and one block
of scores, and a label with most of the rows is spread like any other.  A first
pass finds each anchor's positives, its best rows of the same label; a second
one finds for each positive the best rows of other labels whose score lies in
the window ``low/100 .. high/100`` of the positive's.  Both return a few rows
an anchor and shard, which meet in bounded rankings.

Rows without vec_id or label, and vectors that are null or hold null or
non-finite components, take no part; zero and empty vectors do.  Shorter
vectors count as padded with zeros.  Of rows that share a vec_id the smallest
(label, vector) counts, so repeated rows count once.  Ties go to the smaller
vec_id.  Negative positive scores have an empty window.  Scores beyond a long
are ordered exactly and returned as its ends.  An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazecast.llm.common import dimension, materialize

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95
#: Bytes of the packed vectors of a shard, and the fewest rows worth one.
SHARD_BYTES, LEAST_ROWS = 1 << 25, 4_096
#: Anchors and candidates of a block of scores.
ANCHORS, CANDIDATES = 128, 8_192
EXACT_BITS = 53                     # whole numbers that a double holds exactly
LONG = (-(1 << 63), (1 << 63) - 1)


def components(column: pa.Array, dim: int, scale: int) -> np.ndarray:
    """[row, dim] whole components ``floor(scale * x)``: int64 where all of
    them are small, else Python integers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten(), dtype=np.float64)
    lengths = np.asarray(column.value_lengths(), dtype=np.int64)
    if not len(flat) or np.abs(flat).max() * scale < 2.0 ** 52:
        whole = np.floor(flat * scale).astype(np.int64)
    else:                           # from 2^45 on a double is whole and scaled as an integer
        whole = np.array([int(np.floor(x * scale)) if abs(x) < 2.0 ** 40 else int(np.floor(x)) * scale for x in flat.tolist()],
                         dtype=object)
    out = np.zeros((len(lengths), dim), whole.dtype)
    out[np.arange(dim) < lengths[:, None]] = whole
    return out


class Packed:
    """Candidates whose components share wide integers."""

    def __init__(self, rows: np.ndarray, anchors: tuple[int, int]):
        """``anchors``: least and largest component that an anchor may have."""
        self.n, self.dim = rows.shape
        self.bias, self.anchor_bias = (int(rows.min()) if rows.size else 0), int(anchors[0])
        most = (int(rows.max()) if rows.size else 0) - self.bias
        self.width = max(1, (self.dim * most * (int(anchors[1]) - self.anchor_bias)).bit_length())
        self.sums = rows.sum(1) if rows.size else np.zeros(self.n, np.int64)
        self.fields = EXACT_BITS // self.width
        biased = rows - self.bias
        if self.fields >= 2:
            biased = np.concatenate([biased, np.zeros((-self.n % self.fields, self.dim), rows.dtype)]).astype(np.float64)
            words = biased.reshape(-1, self.fields, self.dim)
            self.words = np.ascontiguousarray(sum(words[:, j] * 2.0 ** (j * self.width) for j in range(self.fields)).T)
        else:                           # whole bytes a field, all candidates in one integer a dimension
            self.bytes = -(-self.width // 8)
            self.sums = rows.astype(object).sum(1) if rows.size else self.sums.astype(object)
            self.words = [int.from_bytes(b"".join(int(x).to_bytes(self.bytes, "little") for x in biased[:, i]), "little")
                          for i in range(self.dim)]

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """[anchor, candidate] exact inner products."""
        own = anchors - self.anchor_bias
        if self.fields >= 2:
            total = (own.astype(np.float64) @ self.words).astype(np.int64)
            parts = (total[:, :, None] >> (np.arange(self.fields) * self.width)) & ((1 << self.width) - 1)
            got = parts.reshape(len(anchors), -1)[:, :self.n]
        else:
            got, anchors = np.empty((len(anchors), self.n), object), anchors.astype(object)
            for a, row in enumerate(own):
                total = sum(int(x) * w for x, w in zip(row, self.words)).to_bytes(self.bytes * self.n + 8, "little")
                got[a] = [int.from_bytes(total[i:i + self.bytes], "little") for i in range(0, self.bytes * self.n, self.bytes)]
        return (got + self.anchor_bias * (self.sums - self.dim * self.bias)[None, :]
                + self.bias * anchors.sum(1)[:, None])


class Shard:
    """The rows of one shard by label and vec_id, packed in blocks."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, anchors: tuple[int, int]):
        by = np.lexsort((ids, labels))
        self.ids, labels = ids[by], labels[by]
        self.labels, start = np.unique(labels, return_index=True)
        ends = [*start[1:].tolist(), len(ids)]
        #: (label, first row, packed rows) of blocks of one label each
        self.blocks = [(int(label), a, Packed(rows[by[a:min(a + CANDIDATES, e)]], anchors))
                       for label, s, e in zip(self.labels, start.tolist(), ends) for a in range(s, e, CANDIDATES)]

    def positives(self, ids: np.ndarray, label: int, anchors: np.ndarray, want: int) -> list[list[tuple]]:
        """The ``want`` best (score, vec_id) of the anchors' label, per anchor."""
        found: list[list[tuple]] = [[] for _ in ids]
        for own, a, packed in self.blocks:
            if own != label:
                continue
            s = packed.scores(anchors)
            for i, anchor in enumerate(ids.tolist()):
                found[i] += [(v, e) for v, e in self.best(s[i], a, want + 1) if e != anchor]
        return [first(f, want) for f in found]

    def negatives(self, label: int, anchors: np.ndarray, windows: list[list[tuple[int, int]]], want: int) -> list[list[list[tuple]]]:
        """The ``want`` best (score, vec_id) of other labels in each of the
        anchors' windows."""
        found: list[list[list[tuple]]] = [[[] for _ in w] for w in windows]
        for own, a, packed in self.blocks:
            if own == label:
                continue
            s = packed.scores(anchors)
            for i, own_windows in enumerate(windows):
                for j, (low, high) in enumerate(own_windows):
                    inside = np.flatnonzero((s[i] >= low) & (s[i] <= high))
                    if len(inside):
                        found[i][j] += self.best(s[i], a, want, inside)
        return [[first(f, want) for f in own] for own in found]

    def best(self, scores: np.ndarray, start: int, want: int, inside: np.ndarray | None = None) -> list[tuple]:
        """The ``want`` best of a block's scores; rows lie by vec_id, so a
        stable order leaves ties with the smaller one."""
        got = scores if inside is None else scores[inside]
        at = np.arange(len(got))
        if len(got) > want and got.dtype != object:
            at = np.flatnonzero(got >= np.partition(got, len(got) - want)[len(got) - want])
        at = at[np.argsort(-got[at], kind="stable")[:want]]
        ids = self.ids[start + (at if inside is None else inside[at])]
        return list(zip(got[at].tolist(), ids.tolist()))


def first(found: list[tuple], want: int) -> list[tuple]:
    return sorted(found, key=lambda x: (-x[0], x[1]))[:want]


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """Whole scores s with ``low * score <= 100 * s <= high * score``."""
    return -(-low * score // 100), high * score // 100


def long(x: int) -> int:
    return min(max(x, LONG[0]), LONG[1])


def past_shards(rows: DataFrame, anchors: DataFrame, shards: int, dim: int, scale: int, bounds: tuple[int, int], look, schema: str) -> DataFrame:
    """``look(shard, batch of anchors)`` for every shard and block of anchors of
    one label; ``anchors`` has vec_id, label, embedding and an array ``given``."""
    held = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("tag"),
                       "vec_id", "label", "embedding", F.lit(None).cast("array<string>").alias("given"))
    asked = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("tag"),
                           "vec_id", "label", "embedding", "given")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members, shard = None, [], None
        for batch in it:
            mark = batch.column("shard").to_numpy() * 2 + batch.column("tag").to_numpy()
            label = batch.column("label").to_numpy()
            change = np.flatnonzero((np.diff(mark) != 0) | ((np.diff(label) != 0) & (mark[1:] % 2 == 1))) + 1
            cuts = [0, *change.tolist(), len(mark)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if mark[a] // 2 != now:
                    now, members, shard = mark[a] // 2, [], None
                part = batch.slice(a, b - a)
                if mark[a] % 2 == 0:
                    members.append((part.column("vec_id").to_numpy(), label[a:b], components(part.column("embedding"), dim, scale)))
                    continue
                if members:
                    ids, labels, vectors = (np.concatenate(x) for x in zip(*members))
                    shard, members = Shard(ids, labels, vectors, bounds), []
                if shard is not None:
                    for i in range(0, b - a, ANCHORS):
                        yield look(shard, part.slice(i, ANCHORS))

    return held.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "tag", "label").mapInArrow(run, schema)


def mine(embeddings: DataFrame, is_anchor: Column, scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES,
         low: int = LOW, high: int = HIGH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score
    of the anchors among the rows (vec_id, label, embedding)."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = (embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
            .where("vec_id is not null and label is not null and embedding is not null").where(finite)
            .groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("row")).select("vec_id", "row.*"))
    rows = materialize(rows, "vectors")
    dim, n = dimension(rows), rows.count()
    anchors = rows.where(is_anchor)
    ends = anchors.agg(F.min(F.array_min("embedding").cast("double")), F.max(F.array_max("embedding").cast("double"))).first()
    least, most = (components(pa.array([[0.0 if x is None else x]]), 1, scale)[0, 0] for x in ends)
    bounds = (min(0, int(least)), max(0, int(most)))
    spread = min(embeddings.sparkSession.sparkContext.defaultParallelism, -(-n // LEAST_ROWS))
    shards = max(1, spread, -(-n * dim * 4 // shard_bytes))

    def find_positives(shard: Shard, batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, label = batch.column("vec_id").to_numpy(), int(batch.column("label")[0].as_py())
        found = shard.positives(ids, label, components(batch.column("embedding"), dim, scale), positives)
        rows = [(anchor, e, long(s), str(s)) for anchor, own in zip(ids.tolist(), found) for s, e in own]
        return arrow(rows, ["anchor_id", "positive_id", "positive_score", "exact"])

    def find_negatives(shard: Shard, batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, label = batch.column("vec_id").to_numpy(), int(batch.column("label")[0].as_py())
        given = [[(int(p), int(s)) for p, s in (g.split(" ") for g in own)] for own in batch.column("given").to_pylist()]
        found = shard.negatives(label, components(batch.column("embedding"), dim, scale),
                                [[window(s, low, high) for _, s in own] for own in given], negatives)
        rows = [(anchor, p, long(ps), e, long(s), str(s)) for anchor, own, got in zip(ids.tolist(), given, found)
                for (p, ps), best in zip(own, got) for s, e in best]
        return arrow(rows, ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score", "exact"])

    none = F.array().cast("array<string>").alias("given")
    best = past_shards(rows, anchors.select("*", none), shards, dim, scale, bounds, find_positives,
                       "anchor_id long, positive_id long, positive_score long, exact string")
    best = ranked(best, ["anchor_id"], "positive_id", positives)
    given = best.groupBy("anchor_id").agg(F.collect_list(F.concat_ws(" ", "positive_id", "exact")).alias("given"))     # ``positives`` at most
    anchors = anchors.join(given.withColumnRenamed("anchor_id", "vec_id"), "vec_id")
    hard = past_shards(rows, anchors, shards, dim, scale, bounds, find_negatives,
                       "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long, exact string")
    return (ranked(hard, ["anchor_id", "positive_id"], "negative_id", negatives)
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def ranked(rows: DataFrame, by: list[str], tie: str, want: int) -> DataFrame:
    """The first ``want`` of each group by the exact score, written as text: a
    number's sign, length and digits order it whatever its size."""
    size = F.when(F.col("exact").startswith("-"), -F.length("exact")).otherwise(F.length("exact"))
    value = F.col("negative_score" if "negative_score" in rows.columns else "positive_score")
    above, below = F.when(value == LONG[1], F.col("exact")), F.when(value == LONG[0], F.col("exact"))
    order = [F.desc(value), F.desc(size), F.desc_nulls_last(above), F.asc_nulls_last(below), F.asc(tie)]
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= want)


def arrow(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "exact" else pa.int64()) for c, n in zip(columns, names)], names)
