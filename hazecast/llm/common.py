"""Helpers shared by the operators: shared tables, worker caches, grouped
streams and distributed connected components."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazecast.session import ensure_checkpoint_dir, shared_dir

#: Words of the contracts: runs of anything but space and \x09-\x0D.  On UTF-8
#: bytes this is what ``bytes.split()`` gives.
#: (Java and RE2 read it alike.)
WORD_RE = r"[^\x20\x09-\x0D]+"


#: Buckets of the bitmap that keeps most rows of a table out of a join.
BUCKETS = 1 << 18
#: Parts of a value from which a bounded sample is first chosen.
SALTS = 64


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, the
    files survive the loss of executors and nothing is computed twice."""
    path = f"{shared_dir(df.sparkSession, 'llm-' + name)}/table"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._materialized_at = path
    return out


def discard(df: DataFrame) -> None:
    """Remove the files of a table that ``materialize`` wrote and nothing reads
    any more."""
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(df._materialized_at)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """``checkpoint()`` into the folder that the session names."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def worker_cache(name: str, make: Callable[[], object]) -> object:
    """An object that a Python worker keeps from task to task (functions are
    shipped by value, so module globals would be new in every task).  A worker
    keeps one: the next operator's takes its place."""
    store = sys.modules.setdefault("_llm_worker_cache", types.ModuleType("_llm_worker_cache"))
    if getattr(store, "name", None) != name:
        store.held = None
        store.name, store.held = name, make()
    return store.held


def frugal(batches: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], cached: bool = False) -> Callable:
    """``batches`` for ``mapInArrow``, after which the worker, which waits for its
    next task, gives freed memory back to the system; without ``cached`` it
    also lets go of what an operator before has left in ``worker_cache``."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not cached:
            worker_cache("", lambda: None)
        try:
            yield from batches(it)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):       # glibc
                libc.malloc_trim(0)
    return run


def words(text: str | None) -> list[bytes]:
    """The contract's words of a text, as UTF-8 (null: none)."""
    return text.encode("utf-8", "replace").split() if text else []


def bounded_sample(labelled: DataFrame, by: str, n: int, texts: DataFrame | None = None) -> DataFrame:
    """(``by``, text): at most ``n`` different texts of each value of ``by``,
    those with the smallest hashes.  They are chosen on narrow rows, first
    within ``SALTS`` parts of each value, so that at most ``SALTS * n`` rows of
    a value meet in one task, and only their texts are moved.  With ``texts``
    (column text), ``labelled`` has the hashes ``h`` of its texts in their stead.
    """
    if texts is None:
        rows = labelled.select(by, "text").where(F.col(by).isNotNull() & F.col("text").isNotNull())
        texts = rows = rows.withColumn("h", F.xxhash64("text"))
        keys = [by, "h"]
    else:
        rows = labelled.where(F.col(by).isNotNull() & F.col("h").isNotNull())
        texts, keys = texts.where("text is not null").select("text", F.xxhash64("text").alias("h")), ["h"]
    chosen = rows.select(by, "h").distinct().withColumn("salt", F.pmod("h", F.lit(SALTS)))
    for part in ([by, "salt"], [by]):
        place = F.row_number().over(Window.partitionBy(*part).orderBy("h"))
        chosen = chosen.withColumn("place", place).where(F.col("place") <= n).drop("place")
    chosen = F.broadcast(chosen.select(by, "h"))        # n rows a value
    return texts.join(chosen, keys).groupBy(by, "h").agg(F.first("text").alias("text")).select(by, "text")


def word_count(text: Column) -> Column:
    """Number of words of a text column in the JVM (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def text_key(text: Column) -> dict[str, Column]:
    """128-bit key of a text (null like the empty text) as columns k1, k2."""
    t = F.coalesce(text, F.lit(""))
    return {"k1": F.xxhash64(t), "k2": F.xxhash64(F.lit(1), t, F.length(t))}


def marked(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` (with k1) with ``possible``: whether the bucket of the text's key holds
    a key of ``keys``.  The broadcast side has at most ``BUCKETS`` rows."""
    def bucket(c: str):
        return F.pmod(F.col(c), F.lit(BUCKETS)).cast("int")
    held = keys.select(bucket("k1").alias("bucket"), F.lit(True).alias("held")).distinct()
    return (docs.withColumn("bucket", bucket("k1")).join(F.broadcast(held), "bucket", "left")
            .withColumn("possible", F.coalesce("held", F.lit(False))).drop("bucket", "held"))


def valid_vector(c: Column) -> Column:
    """Neither null, zero nor holding a null or non-finite component."""
    d = F.transform(c, lambda x: x.cast("double"))
    finite = F.forall(d, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(d, lambda x: x != 0.0), F.lit(False))


def vector_classes(embeddings: DataFrame, *more: str) -> DataFrame:
    """Rows with a valid vector and the 128-bit key (k1, k2) of its content and
    of the columns ``more``; identical vectors share the key."""
    c = F.col("embedding")
    return (embeddings.select("vec_id", "embedding", *more).where(valid_vector(c))
            .withColumns({"k1": F.xxhash64(c, *more), "k2": F.xxhash64(F.lit(1), c, *more)}))


def dimension(vectors: DataFrame) -> int:
    """The largest vector length; shorter ones count as padded with zeros."""
    return vectors.agg(F.max(F.size("embedding"))).first()[0] or 0


def vectors_of(column: pa.Array, dim: int) -> np.ndarray:
    """An Arrow list column of valid vectors as a double matrix of ``dim``
    columns."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten(), dtype=np.float64)
    lengths = np.asarray(column.value_lengths(), dtype=np.int64)
    if len(lengths) and (lengths == dim).all():
        return flat.reshape(len(lengths), dim)
    out = np.zeros((len(lengths), dim))
    out[np.arange(dim) < lengths[:, None]] = flat
    return out


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's centroids of a bounded sample."""
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = nearest(x, centres)[0]
        sums, n = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each row, and all squared distances."""
    d = (x * x).sum(1)[:, None] + (centres * centres).sum(1) - 2 * (x @ centres.T)
    return d.argmin(1), np.maximum(d, 0)


def runs(batches: Iterator[pa.RecordBatch], key: str, least: int) -> Iterator[pa.Table]:
    """Re-cut a partition sorted by ``key`` into tables that end where a key
    ends and hold at least ``least`` rows (the last may be shorter)."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < least:
            continue
        t = pa.Table.from_batches(held)
        k = t.column(key).to_numpy()
        cut = int(np.searchsorted(k, k[-1]))
        if cut:
            yield t.slice(0, cut)
            t = t.slice(cut)
        held, n = t.to_batches(), t.num_rows
    if n:
        yield pa.Table.from_batches(held)


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of a graph given as long pairs (a, b): rows (node, component)
    for every node with an edge, component the smallest node.

    Alternating large-star and small-star steps: a node hangs its larger
    neighbours, then its smaller ones, on the smallest it knows, until the
    edges stay as they are.  Every step is a grouped minimum (folded before
    the shuffle) and a join with one row per node; each round is a table in
    the shared folder.  Nothing of the graph reaches the driver but a count
    and a checksum a round.
    """
    spark = edges.sparkSession

    def signature(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = materialize(e.where("u <> v").distinct(), "edges")
    before = signature(e)
    if not before[0]:
        return spark.createDataFrame([], "node long, component long")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        star = (small.select("u", F.col("m").alias("v"))
                .unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
                .where("u <> v").distinct())
        old, e = e, materialize(star, "edges")
        discard(old)
        after = signature(e)
        if after == before:
            break
        before = after
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
