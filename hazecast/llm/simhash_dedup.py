"""SimHash near-dedup by bit-sliced comparison.

A text gets a 64-bit fingerprint of its word shingles; texts whose
fingerprints differ in at most ``radius`` bits are linked and components are
reported by their smallest doc_id.

* Equal fingerprints are one node from the start (grouped before anything
  else), so copies cost nothing.
* The 64 bits are cut into ``radius + 2`` fields.  Two fingerprints within the
  radius agree on at least two fields, so every link has both ends under one
  of the C(radius + 2, 2) keys (field pair, its bits): exact, and the groups
  are small at any size, where a plain comparison of all blocks would be
  quadratic.
* Within the groups bit planes are stored vertically: one bit of 64
  fingerprints is one machine word.  A shift of the planes by ``d`` lanes
  pairs each fingerprint with the d-th next one of its group; the differing
  bits go into carry-save counters, 64 distances at a time, and words whose
  lanes have all passed the radius are abandoned.
* A key with more than ``tile_rows`` fingerprints is cut into tiles, and every
  pair of tiles is its own task, so no group is collected whole.
* A group reports a spanning forest of its links, not all pairs.

Null and empty texts have no words: fingerprint zero, linked like any other.
Null doc_ids are ignored by the minimum (null if a component has no other);
repeated rows are each reported.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazecast.llm.common import connected_components, frugal, marked, materialize, runs, text_key, words

SHINGLE = 4
RADIUS = 4
SEED = 42
TILE_ROWS = 8192
BLOCK_ROWS = 1 << 16
COUNT_ROWS = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of a whole text."""
    w = words(text.encode("utf-8", "replace").lower().decode() if text else None)
    if not w:
        return 0
    if len(w) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(w), SEED)
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(w) - shingle + 1
    hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED)
                          for a, b in zip(starts[:n].tolist(), ends[shingle - 1:].tolist())), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, COUNT_ROWS):
        part = hashes[i:i + COUNT_ROWS].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, k1, k2, fp) of every document: the key of its text and its
    fingerprint as a signed long."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(3)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(fp.view(np.int64))], ["doc_id", "k1", "k2", "fp"])
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    read = read.withColumns(text_key(F.col("text"))).select("doc_id", "k1", "k2", "text")
    return read.mapInArrow(frugal(batches), "doc_id long, k1 long, k2 long, fp long")


def field_keys(fp: Column, radius: int) -> Column:
    """The keys of a fingerprint: one per pair of its ``radius + 2`` fields."""
    cut = [64 * i // (radius + 2) for i in range(radius + 3)]

    def field(i: int) -> Column:
        return F.shiftrightunsigned(fp, cut[i]).bitwiseAND(F.lit((1 << (cut[i + 1] - cut[i])) - 1))

    keys = []
    for n, (i, j) in enumerate(combinations(range(radius + 2), 2)):
        bits = F.shiftleft(field(i), cut[j + 1] - cut[j]).bitwiseOR(field(j))
        keys.append(F.xxhash64(F.lit(n), bits) if radius < 2 else F.lit(n << 48).bitwiseOR(bits))
    return F.array(*keys)


def _pack(lanes: np.ndarray) -> np.ndarray:
    """Booleans (a multiple of 64) as words, lane 0 the lowest bit."""
    return np.packbits(lanes, bitorder="little").view(np.uint64)


def close_pairs(fps: np.ndarray, key: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (i, j) of equal key within the radius, lag by lag; rows
    are sorted by key."""
    n = len(fps)
    n_words = -(-n // 64)
    ends = np.searchsorted(key, key, side="right")
    left = np.zeros(n_words * 64, np.int64)       # rows of the same key after this one
    left[:n] = ends - 1 - np.arange(n)
    left = left.reshape(n_words, 64)
    longest = left.max(axis=1)
    bits = np.zeros((64, n_words * 64), bool)
    for b in range(64):
        bits[b, :n] = (fps >> np.uint64(b)) & np.uint64(1)
    planes = np.concatenate([_pack(bits.ravel()).reshape(64, n_words), np.zeros((64, 2), np.uint64)], axis=1)
    del bits
    counters = max(1, int(radius).bit_length())
    at = np.arange(n_words)
    for d in range(1, int(longest.max()) + 1):
        at = at[longest[at] >= d]
        w, live = at, _pack((left[at] >= d).ravel())
        shift, low = np.uint64(d & 63), d >> 6
        count = np.zeros((counters, len(w)), np.uint64)
        over = np.zeros(len(w), np.uint64)
        for b in range(64):
            p = planes[b]
            other = p[np.minimum(w + low, n_words)] >> shift
            if shift:
                other |= p[np.minimum(w + low + 1, n_words)] << (np.uint64(64) - shift)
            carry = p[w] ^ other
            for c in count:                       # carry-save: one bit more in each of 64 distances
                c ^= carry
                carry &= ~c
            over |= carry
            if b % 8 == 7:
                live &= ~(over | _above(count, radius))
                keep = live != 0
                if not keep.all():
                    w, live, over, count = w[keep], live[keep], over[keep], np.ascontiguousarray(count[:, keep])
                    if not len(w):
                        break
        if len(w):
            lane = np.unpackbits(live.view(np.uint8), bitorder="little").reshape(len(w), 64)
            a, b = np.nonzero(lane)
            i = w[a] * 64 + b
            yield i, i + d


def _above(count: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose bit-sliced count is above the radius."""
    more, same = np.zeros_like(count[0]), ~np.zeros_like(count[0])
    for k in range(len(count) - 1, -1, -1):
        if radius >> k & 1:
            same &= count[k]
        else:
            more |= same & count[k]
            same &= ~count[k]
    return more


def forest(pairs: Iterator[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """The root of each row under the pairs (union-find; pairs that are
    already joined are skipped in bulk)."""
    root = np.arange(n)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in pairs:
        fresh = root[i] != root[j]
        for a, b in zip(i[fresh].tolist(), j[fresh].tolist()):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
        while (root != root[root]).any():
            root = root[root]
    return root


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Edges (a, b) that connect the distinct long fingerprints ``fp`` exactly
    as all links of at most ``radius`` bits do."""
    keyed = fps.select("fp", F.explode(field_keys(F.col("fp"), radius)).alias("key"))
    hot = (keyed.groupBy("key").count().where(F.col("count") > tile_rows)
           .select("key", F.ceil(F.col("count") / tile_rows).cast("int").alias("tiles")))
    tile = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1),
                       lambda o: F.xxhash64("key", F.least(o, tile), F.greatest(o, tile)))
    keyed = (keyed.join(hot, "key", "left")
             .select("fp", F.explode(F.when(F.col("tiles").isNull(), F.array(F.xxhash64("key")))
                                     .otherwise(pair)).alias("key")))

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(it, "key", BLOCK_ROWS):
            key, fp = t.column("key").to_numpy(), t.column("fp").to_numpy().view(np.uint64)
            root = forest(close_pairs(fp, key, radius), len(fp))
            own = np.flatnonzero(root != np.arange(len(fp)))
            signed = fp.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(signed[own]), pa.array(signed[root[own]])], ["a", "b"])

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(frugal(compare), "a long, b long")


def _grouped(docs: DataFrame, shingle: int, radius: int, tile_rows: int) -> DataFrame:
    """(doc_id, k1, k2, fp, part, component_id) of every document."""
    own = materialize(with_fingerprints(docs, shingle), "fingerprints")
    nodes = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    parts = connected_components(fingerprint_links(nodes.select("fp"), radius, tile_rows))
    nodes = (nodes.join(parts, F.col("fp") == F.col("node"), "left")
             .select("fp", "least", F.coalesce("component", "fp").alias("part")))
    least = nodes.groupBy("part").agg(F.min("least").alias("component_id"))
    return own.join(nodes.join(least, "part").select("fp", "part", "component_id"), "fp")


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS,
                       tile_rows: int = TILE_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document."""
    return _grouped(docs, shingle, radius, tile_rows).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """The documents of which one of each component stays: the smallest
    doc_id (null last, then by text key), and one of equal rows.

    Only documents whose key bucket holds a row to drop are joined; the
    others pass without a shuffle of their texts.
    """
    rows = materialize(_grouped(docs, shingle, radius, tile_rows)
                       .groupBy("part", "doc_id", "k1", "k2").agg(F.count("*").alias("times")), "groups")
    me = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k1", "k2")
    first = rows.groupBy("part").agg(F.min(me).alias("lead"))
    marks = (rows.join(first, "part").withColumn("stays", me == F.col("lead")).where("not stays or times > 1")
             .select(F.col("doc_id").alias("m_id"), F.col("k1").alias("m1"), F.col("k2").alias("m2"), "stays"))
    marks = materialize(marks, "marks")
    keyed = marked(docs.withColumns(text_key(F.col("text").cast("string"))), marks.select(F.col("m1").alias("k1")))
    clear = keyed.where("not possible").select(*docs.columns)
    joined = keyed.where("possible").join(
        marks, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("k1") == F.col("m1")) & (F.col("k2") == F.col("m2")), "left")
    single = joined.where("stays is null").select(*docs.columns)
    equal = joined.where("stays").dropDuplicates(["doc_id", "k1", "k2"]).select(*docs.columns)
    return clear.unionByName(single).unionByName(equal)
