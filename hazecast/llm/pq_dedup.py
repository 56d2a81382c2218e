"""Embedding near-dedup by product quantisation, without a missed link.

Vectors of equal label with a cosine of at least ``threshold`` are linked.  On
unit vectors that is a distance of at most ``r = sqrt(2 - 2 threshold)``.

* Identical vectors of a label are one entry with a multiplicity.
* Entries go to the inverted list (label, nearest coarse centroid).  An entry
  also visits every list of a higher centroid that can hold a partner: if y
  lies with centroid c' and x with c, x is within r of the plane between them.
  So many probes are sufficient, and each pair meets once.
* A list member keeps the subspace codes of its residual and the length of
  what the codes lose.  A visitor's distances to all members are table
  lookups; members with ``distance <= r + loss`` can be partners, no other
  can (triangle inequality), and these alone are reranked by their exact
  cosine in double precision.
* A list longer than ``tile_rows`` is cut into tiles; members of one tile
  visit the later ones.  Tasks report, per entry, the number of its linked
  vectors and one edge to the root of its links in the task: never the pairs.

The number of lists follows the largest label, not the table: entries of one
label meet, so more lists would only send more copies to shorter ones.

Codebooks are fitted on a bounded sample (``sample`` entries by hash order);
they decide only how much is compared.  Rows whose label is null or whose
vector is null, zero or holds null or non-finite components link with nothing.
Null vec_ids are ignored by the minimum and are not kept; repeated rows are
vectors of their own; shorter vectors count as padded with zeros.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazecast.llm.common import (connected_components, dimension, kmeans, materialize, nearest, valid_vector,
                                 vector_classes, vectors_of)
from hazecast.llm.simhash_dedup import forest

THRESHOLD = 0.98
SAMPLE = 16_384
#: Lists: so many rows of the largest label each, at least and at most so many.
LIST_ROWS = 8_192
LEAST_LISTS, MAX_LISTS = 4, 4_096
SUBSPACES, CODEWORDS = 8, 64
TILE_ROWS = 8_192
#: Queries compared with a list at once (bounds the distance block).
BLOCK = 256
SEED = 7


class Codebooks:
    """Coarse centroids and residual codewords of each subspace."""

    def __init__(self, coarse: np.ndarray, words: list[np.ndarray]):
        self.coarse, self.words = coarse, words
        self.cuts = np.cumsum([0, *(w.shape[1] for w in words)])
        self.apart = 2 * np.sqrt(nearest(coarse, coarse)[1])

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int) -> Codebooks:
        dim = sample.shape[1]
        cuts = np.linspace(0, dim, min(SUBSPACES, dim) + 1).astype(int)
        coarse = kmeans(sample, lists, 10, SEED)
        rest = sample - coarse[nearest(sample, coarse)[0]]
        return cls(coarse, [kmeans(rest[:, a:b], CODEWORDS, 10, SEED) for a, b in zip(cuts, cuts[1:])])

    def codes(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals and the lengths of what they lose."""
        code, lost = np.empty((len(rest), len(self.words)), np.uint8), np.zeros(len(rest))
        for s, w in enumerate(self.words):
            part = rest[:, self.cuts[s]:self.cuts[s + 1]]
            code[:, s], d = nearest(part, w)
            lost += ((part - w[code[:, s]]) ** 2).sum(1)
        return code, np.sqrt(lost)

    def probes(self, unit: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Home list of each row, and (row, list) of its visits."""
        home, d = nearest(unit, self.coarse)
        own = d[np.arange(len(unit)), home][:, None]
        reach = d - own <= radius * self.apart[home] + 1e-9
        reach &= np.arange(len(self.coarse)) > home[:, None]
        return home, *np.nonzero(reach)

    def distances(self, rest: np.ndarray, code: np.ndarray) -> np.ndarray:
        """[query, member] distances to the coded members by table lookup."""
        total = np.zeros((len(rest), len(code)))
        for s, w in enumerate(self.words):
            total += nearest(rest[:, self.cuts[s]:self.cuts[s + 1]], w)[1][:, code[:, s]]
        return np.sqrt(total)


class InvertedList:
    """The members of one list (or tile): codes, losses and exact vectors."""

    def __init__(self, books: Codebooks, cell: int, x: np.ndarray, node: np.ndarray, copies: np.ndarray):
        self.books, self.centre, self.x, self.node, self.copies = books, books.coarse[cell], x, node, copies
        self.norms = np.linalg.norm(x, axis=1)
        self.code, self.lost = books.codes(x / self.norms[:, None] - self.centre)

    def pairs(self, x: np.ndarray, radius: float, threshold: float,
              among: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Linked (row of x, member) pairs; ``among``: x are the members
        themselves and each pair is given once."""
        norms = np.linalg.norm(x, axis=1)
        for start in range(0, len(x), BLOCK):
            rows = np.arange(start, min(start + BLOCK, len(x)))
            near = self.books.distances(x[rows] / norms[rows, None] - self.centre, self.code) <= radius + self.lost + 1e-6
            if among:
                near &= np.arange(len(self.x)) > rows[:, None]
            i, j = np.nonzero(near)
            for a in range(0, len(i), 1 << 15):
                p, q = rows[i[a:a + (1 << 15)]], j[a:a + (1 << 15)]
                keep = np.einsum("ij,ij->i", x[p], self.x[q]) / (norms[p] * self.norms[q]) >= threshold
                yield p[keep], q[keep]

    def links(self, x: np.ndarray, node: np.ndarray, copies: np.ndarray, radius: float, threshold: float,
              among: bool) -> pa.RecordBatch:
        """Per linked entry the number of linked vectors and the root of its
        links: those among the members, or those of a batch of visitors."""
        n = len(self.x)
        count = np.zeros(n + (0 if among else len(x)), np.int64)
        nodes = self.node if among else np.concatenate([self.node, node])

        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for i, j in self.pairs(x, radius, threshold, among):
                k = i if among else i + n
                np.add.at(count, k, self.copies[j])
                np.add.at(count, j, copies[i])
                yield k, j

        root = forest(pairs(), len(count))
        some = np.flatnonzero(count)
        return pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(count[some]), pa.array(nodes[root[some]])],
                                          ["node", "linked", "root"])


def duplicate_groups(embeddings: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE,
                     tile_rows: int = TILE_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label"))
    valid = vector_classes(rows.where("label is not null"), "label")
    entries = (valid.groupBy("label", "k1", "k2")
               .agg(F.first("embedding").alias("embedding"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
               .withColumn("node", F.monotonically_increasing_id()))
    entries = materialize(entries, "entries")
    dim = dimension(entries)
    n = entries.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    alone = rows.where("label is null").unionByName(
        rows.where("label is not null").where(~valid_vector(F.col("embedding")))).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if n:
        linked, parts = _compare(entries, dim, n, threshold, sample, tile_rows)
        nodes = entries.select("node", "label", "k1", "k2", "copies", "least").join(linked, "node", "left").join(parts, "node", "left")
        nodes = nodes.withColumn("part", F.coalesce("component", "node"))
        nodes = nodes.join(nodes.groupBy("part").agg(F.min("least").alias("component_id")), "part").select(
            "label", "k1", "k2", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "component_id")
        grouped = valid.select("vec_id", "label", "k1", "k2").join(nodes, ["label", "k1", "k2"])
        alone = alone.unionByName(grouped.select("vec_id", "n_links", "component_id"))
    return alone.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _compare(entries: DataFrame, dim: int, n: int, threshold: float, sample: int, tile_rows: int) -> tuple[DataFrame, DataFrame]:
    """(node, linked): linked vectors of other entries; (node, component).
    ``n``: entries of the largest label, as only those of one label meet."""
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-9
    kind = entries.schema["embedding"].dataType.simpleString()
    some = entries.select("embedding", F.xxhash64("k1", "k2").alias("h")).orderBy("h").limit(sample)   # bounded, for fitting
    fit = vectors_of(some.select("embedding").toArrow().column(0), dim)
    books = Codebooks.fit(fit / np.linalg.norm(fit, axis=1)[:, None], min(MAX_LISTS, max(LEAST_LISTS, -(-n // LIST_ROWS)), len(fit)))
    shared = entries.sparkSession.sparkContext.broadcast((books.coarse, books.words))     # at most MAX_LISTS centroids

    def visits(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = Codebooks(*shared.value)
        for b in it:
            x = vectors_of(b.column("embedding"), dim)
            home, row, cell = books.probes(x / np.linalg.norm(x, axis=1)[:, None], radius)
            at = np.concatenate([np.arange(len(x)), row])
            own = np.arange(len(at)) < len(x)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).take(pa.array(at)) for c in ("label", "node", "copies", "embedding")),
                 pa.array(np.concatenate([home, cell]).astype(np.int32)), pa.array(own)],
                ["label", "node", "copies", "embedding", "cell", "own"])

    placed = materialize(entries.select("label", "node", "copies", "embedding").mapInArrow(
        visits, f"label string, node long, copies long, embedding {kind}, cell int, own boolean"), "lists")
    hot = (placed.where("own").groupBy("label", "cell").count()
           .select("label", "cell", F.ceil(F.col("count") / tile_rows).cast("int").alias("tiles")))
    tile = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    goes = F.filter(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: ~F.col("own") | (t >= tile))
    tiled = (placed.join(hot, ["label", "cell"])
             .withColumn("tile", F.explode(goes)).withColumn("own", F.col("own") & (F.col("tile") == tile))
             .withColumn("key", F.xxhash64("label", "cell", "tile")))

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Members of a key come first, then its visitors, batch by batch."""
        books, now, held, members = Codebooks(*shared.value), None, [], None

        def ready() -> InvertedList:
            x, node, copies = (np.concatenate(c) for c in zip(*held))
            return InvertedList(books, now[2], x, node, copies)

        def last() -> Iterator[pa.RecordBatch]:
            if members is None and held:
                own = ready()
                yield own.links(own.x, own.node, own.copies, radius, threshold, True)

        for b in it:
            key, cell, own = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "cell", "own"))
            label = np.asarray(b.column("label").to_pylist(), object)
            new = (key[1:] != key[:-1]) | (cell[1:] != cell[:-1]) | (own[1:] != own[:-1]) | (label[1:] != label[:-1])
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(key)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if now != (key[i], label[i], cell[i]):
                    yield from last()
                    now, held, members = (key[i], label[i], cell[i]), [], None
                part = b.slice(i, j - i)
                rows = (vectors_of(part.column("embedding"), dim), part.column("node").to_numpy(), part.column("copies").to_numpy())
                if own[i]:
                    held.append(rows)
                elif held or members is not None:
                    if members is None:
                        yield from last()
                        members, held = ready(), []
                    yield members.links(*rows, radius, threshold, False)
        yield from last()

    found = (tiled.select("key", "label", "cell", "node", "copies", "own", "embedding").repartition("key")
             .sortWithinPartitions("key", "label", "cell", F.desc("own")).mapInArrow(compare, "node long, linked long, root long"))
    found = materialize(found, "links")
    parts = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    return found.groupBy("node").agg(F.sum("linked").alias("linked")), parts
