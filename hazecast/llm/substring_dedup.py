"""Substring dedup: words in windows that occur more than once are removed.

A window is ``window`` consecutive words of a document; a word goes if it lies
in a window whose words also start anywhere else.

1. Anchors.  The anchor of a window is its ``gram`` words with the least hash
   (leftmost of equal ones).  Equal windows have equal anchors, and successive
   windows of one anchor form one passage (at most ``window - gram + 1``
   windows), so every window belongs to exactly one passage and all its
   occurrences in the corpus lie under one anchor value.
2. Anchor values are counted.  Passages under a value that occurs once cannot
   repeat and go; so do, with every window repeated, passages that occur twice
   as a whole and have no other passage under their value.
3. The rest is dealt by anchor value into shards of bounded size.  A shard
   concatenates its distinct passages, builds an FM-index (suffix order, BWT,
   wavelet matrix) and streams them through it: backward search from each
   place gives matching statistics up to the window length, and windows with
   two occurrences are reported.  As each window is counted under one value,
   the counts in a shard are those of the corpus.
4. A value with more than ``hot`` distinct passages (a line that a third of
   all documents share, in different surroundings) would not fit a shard: its
   windows are counted by their 128-bit hashes instead, spread over all tasks.
5. Passages tell their documents which windows repeat, and a last pass removes
   the covered words.

Texts are shuffled only where documents may hold repeated passages (a bitmap
of key buckets, bounded, tells the others apart).  Words are compared by
64-bit hashes.  Null texts have no words; equal texts, repeated rows included,
are occurrences of their own and repeat each other.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazecast.llm.common import BUCKETS, frugal, marked, materialize, runs, text_key, words
from hazecast.llm.fm_index import FMIndex

WINDOW, GRAM = 35, 8
SHARD_WORDS = 1 << 19
HOT_PASSAGES = 4_096
#: Rows of an anchor value from which joins by value deal them to several tasks.
HOT_ROWS, SALTS = 4_096, 64
#: Windows of a document handled at once.
CHUNK = 1 << 19
_M1, _M2 = np.array([0x9E3779B97F4A7C15]), np.array([0xD6E8FEB86659FD93])


def word_hashes(w: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))


def _sums(h: np.ndarray, n: int, m: np.uint64) -> np.ndarray:
    """Polynomial hash of every ``n`` consecutive values, by doubling."""
    out, have = None, 0
    size, block, step = 1, h, m         # one-element arrays wrap around silently
    while n:
        if n & 1:
            if out is None:
                out, have = block, size
            else:
                k = len(h) - (have + size) + 1
                out = out[:k] * step + block[have:have + k]
                have += size
        n >>= 1
        if n:
            block = block[:len(block) - size] * step + block[size:]
            size, step = 2 * size, step * step
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M2
    return x ^ (x >> np.uint64(29))


def passages(h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor value, first window, number of windows) of the passages of a
    document given its word hashes."""
    n = len(h) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    value = _mix(_sums(h, gram, _M1))
    span = window - gram + 1
    at, size = np.arange(len(value)), 1
    while size < span:
        step = min(size, span - size)
        a, b = at[:len(at) - step], at[step:]
        at = np.where(value[b] < value[a], b, a)
        size += step
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return value[at[first]], first, np.diff(np.concatenate((first, [n])))


def passage_rows(h: np.ndarray, window: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor value, passage hash, first window, number of windows), long
    documents in chunks."""
    for start in range(0, max(0, len(h) - window + 1), CHUNK):
        part = h[start:start + CHUNK + window - 1]
        value, first, count = passages(part, window, gram)
        power, prefix = _prefix(part)
        size = count + window - 1
        whole = prefix[first + size] - prefix[first] * power[size]
        yield value, _mix(whole + size.astype(np.uint64)), first + start, count


def _prefix(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and prefix hashes: prefix[b] - prefix[a] *
    power[b - a] is the polynomial hash of h[a:b].  Built from sums of
    h[i] / m^i, as the multiplier is odd and has an inverse."""
    n = len(h)
    inverse = np.uint64(pow(int(_M1[0]), -1, 1 << 64))
    power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, _M1[0]))), dtype=np.uint64)
    back = np.cumprod(np.full(n, inverse), dtype=np.uint64)
    return power, np.concatenate(([np.uint64(0)], np.cumsum(h * back, dtype=np.uint64))) * power


def _longs(column: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(column).view(np.int64))


OCCURRENCE = "k1 long, k2 long, value long, passage long, first int, windows int"


def occurrences(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """The passages of every document."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            k1, k2 = b.column("k1").to_numpy(), b.column("k2").to_numpy()
            out = [[] for _ in range(5)]
            for i, t in enumerate(b.column("text")):
                for value, whole, first, count in passage_rows(word_hashes(words(t.as_py())), window, gram):
                    for column, v in zip(out, (np.full(len(value), i), value, whole, first, count)):
                        column.append(v)
            if out[0]:
                row, value, whole, first, count = (np.concatenate(c) for c in out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1[row]), pa.array(k2[row]), _longs(value), _longs(whole),
                     pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32))],
                    ["k1", "k2", "value", "passage", "first", "windows"])
    return docs.select("k1", "k2", "text").mapInArrow(frugal(batches), OCCURRENCE)


def passage_words(docs: DataFrame, window: int) -> DataFrame:
    """(value, passage, n, hot, words) of the passages that ``wanted`` names."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out: list[list] = [[] for _ in range(5)]
            for t, wanted in zip(b.column("text"), b.column("wanted")):
                h = word_hashes(words(t.as_py()))
                for p in wanted.as_py():
                    w = h[p["first"]:p["first"] + p["windows"] + window - 1]
                    for column, v in zip(out, (p["value"], p["passage"], p["n"], p["hot"], w.tobytes())):
                        column.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)],
                                             ["value", "passage", "n", "hot", "words"])
    return docs.select("text", "wanted").mapInArrow(frugal(batches), "value long, passage long, n long, hot boolean, words binary")


def shard_masks(part: pa.Table, window: int) -> pa.RecordBatch:
    """(value, passage, mask): the repeated windows of one shard's passages
    that occur once as a whole; bit i of the mask is the i-th window."""
    lists = [np.frombuffer(w, np.uint64) for w in part.column("words").to_pylist()]
    size = np.array([len(x) for x in lists])
    symbols, dense = np.unique(np.concatenate(lists), return_inverse=True)
    text = np.ones(int(size.sum()) + len(lists), np.int64)           # symbol 1 stands between passages
    start = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    inside = np.ones(len(text), bool)
    inside[start + size] = False
    text[inside] = dense.ravel() + 2
    index = FMIndex(text)
    once = np.flatnonzero(part.column("n").to_numpy() == 1)
    count = size[once] - window + 1
    row = np.repeat(np.arange(len(once)), count)
    nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    found = index.matching_statistics(text, start[once][row] + nth + window - 1, window) == window
    mask = np.zeros(len(once), np.int64)
    np.bitwise_or.at(mask, row[found], np.int64(1) << nth[found])
    some = np.flatnonzero(mask)
    at = pa.array(once[some])
    return pa.RecordBatch.from_arrays([part.column("value").combine_chunks().take(at),
                                       part.column("passage").combine_chunks().take(at), pa.array(mask[some])],
                                      ["value", "passage", "mask"])


def search_shards(texts: DataFrame, window: int, shard_words: int) -> DataFrame:
    """Masks of the passages by an FM-index per shard."""
    total = texts.agg(F.sum(F.octet_length("words") / 8)).first()[0] or 0
    shards = int(total // shard_words) + 1

    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(it, "shard", 1):
            shard = t.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for a, b in zip(cuts, cuts[1:]):
                yield shard_masks(t.slice(a, b - a), window)

    dealt = texts.select(F.pmod(F.xxhash64("value"), F.lit(shards)).cast("int").alias("shard"), "value", "passage", "n", "words")
    return dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(frugal(search), "value long, passage long, mask long")


def count_windows(texts: DataFrame, window: int) -> DataFrame:
    """Masks of the passages by counts of their windows' hashes."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i, w in enumerate(b.column("words")):
                h = np.frombuffer(w.as_py(), np.uint64)
                a, c = _mix(_sums(h, window, _M1)), _mix(_sums(h, window, _M2))
                same = [pa.repeat(b.column(k)[i], len(a)) for k in ("value", "passage", "n")]
                yield pa.RecordBatch.from_arrays([*same, _longs(a), _longs(c), pa.array(np.arange(len(a), dtype=np.int32))],
                                                 ["value", "passage", "n", "w1", "w2", "nth"])
    each = texts.select("value", "passage", "n", "words").mapInArrow(
        batches, "value long, passage long, n long, w1 long, w2 long, nth int")
    twice = each.groupBy("w1", "w2").agg(F.sum("n").alias("times")).where("times > 1")
    return (each.join(twice, ["w1", "w2"]).groupBy("value", "passage")
            .agg(F.bit_or(F.expr("shiftleft(1L, nth)")).alias("mask")))


def join_by_value(rows: DataFrame, values: DataFrame, times: str, spread: Column) -> DataFrame:
    """``rows`` with the columns of their value in ``values`` (one row a value;
    ``times``: how many of the rows have it).  Rows of values with more than
    ``HOT_ROWS`` are dealt to ``SALTS`` tasks by ``spread``, and such values go to all
    of them; a bitmap of key buckets (bounded, broadcast) tells which may be so."""
    bucket = F.pmod("value", F.lit(BUCKETS)).cast("int")
    hot = F.broadcast(values.where(F.col(times) > HOT_ROWS).select(bucket.alias("bucket"), F.lit(True).alias("hot_bucket")).distinct())

    def marked_rows(df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", bucket).join(hot, "bucket", "left").drop("bucket")
    left = marked_rows(rows).withColumn("salt", F.when(F.col("hot_bucket"), F.pmod(spread, F.lit(SALTS))).otherwise(0).cast("int"))
    salts = F.when(F.col("hot_bucket"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = marked_rows(values).withColumn("salt", F.explode(salts))
    return left.drop("hot_bucket").join(right.drop("hot_bucket"), ["value", "salt"]).drop("salt")


def repeated_windows(docs: DataFrame, window: int, gram: int, shard_words: int, hot: int) -> DataFrame:
    """(k1, k2, found): per text its passages (first window, mask of the
    repeated ones).  ``docs``: doc_id, text, k1, k2."""
    occ = materialize(occurrences(docs, window, gram), "occurrences")
    counts = materialize(occ.groupBy("value").agg(F.count("*").alias("rows")).where("rows > 1"), "anchor-counts")
    same = join_by_value(occ, counts, "rows", F.xxhash64("k1", "k2", "first"))
    same = materialize(same.groupBy(*occ.columns).agg(F.count("*").alias("times")), "repeated-anchors")
    whole = same.groupBy("value", "passage").agg(F.sum("times").alias("n"),
                                                 F.min(F.struct("k1", "k2", "first", "windows")).alias("at"))
    whole = materialize(whole, "passages")
    groups = materialize(whole.groupBy("value").agg(F.count("*").alias("passages")).where("passages > 1"), "passage-counts")
    searched = join_by_value(whole, groups, "passages", F.col("passage"))
    searched = searched.select("value", "passage", "n", (F.col("passages") > hot).alias("hot"), "at.*")
    wanted = (searched.groupBy("k1", "k2")
              .agg(F.collect_list(F.struct("value", "passage", "n", "hot", "first", "windows")).alias("wanted")))
    leads = docs.select("k1", "k2", "doc_id").groupBy("k1", "k2").agg(F.min("doc_id").alias("lead"))
    wanted = materialize(wanted.join(leads, ["k1", "k2"]), "wanted")
    texts = (marked(docs, wanted).where("possible").join(wanted, ["k1", "k2"])
             .where(F.col("doc_id").eqNullSafe(F.col("lead"))))
    texts = passage_words(texts, window)
    texts = materialize(texts.dropDuplicates(["value", "passage"]), "passage-words")     # rows that repeat doc_id and text
    masks = (search_shards(texts.where("not hot"), window, shard_words)
             .unionByName(count_windows(texts.where("hot"), window).select("value", "passage", "mask")))
    masks = masks.unionByName(whole.where("n > 1").select("value", "passage", F.lit(-1).cast("long").alias("mask")))
    masks = materialize(masks.groupBy("value", "passage").agg(F.bit_or("mask").alias("mask")), "masks")
    return (same.join(masks, ["value", "passage"]).groupBy("k1", "k2")
            .agg(F.collect_list(F.struct("first", "windows", "mask")).alias("found")))


def covered(n: int, found: list[dict], window: int) -> np.ndarray:
    """Which of a document's ``n`` words lie in a reported window."""
    edge = np.zeros(n + 1, np.int64)
    for p in found:
        for i in range(p["windows"]):
            if p["mask"] >> i & 1:
                edge[p["first"] + i] += 1
                edge[p["first"] + i + window] -= 1
    return np.cumsum(edge[:n]) > 0


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_words: int = SHARD_WORDS,
                   hot: int = HOT_PASSAGES, carry: Sequence[str] = (), as_is: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept (and the columns of ``carry``, each
    with a ``_`` before its name) of every document.

    ``kept``: the words that stay, joined by one space; with ``as_is`` a text
    that loses no word is given unchanged.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                        *(F.col(c).alias(f"_{c}") for c in carry))
    keyed = keyed.withColumns(text_key(F.col("text")))
    found = materialize(repeated_windows(keyed.select("doc_id", "text", "k1", "k2"), window, gram, shard_words, hot), "found")
    all_docs = marked(keyed, found)
    kind = found.schema["found"].dataType
    clear = all_docs.where("not possible").withColumn("found", F.lit(None).cast(kind))
    rows = all_docs.where("possible").join(found, ["k1", "k2"], "left")
    columns = ["doc_id", *(f"_{c}" for c in carry)]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            total, removed, kept = [], [], []
            for t, f in zip(b.column("text"), b.column("found")):
                text = t.as_py()
                w = words(text)
                gone = covered(len(w), f.as_py(), window) if f.is_valid else None
                lost = int(gone.sum()) if gone is not None else 0
                if lost:
                    kept.append(b" ".join([x for x, g in zip(w, gone.tolist()) if not g]).decode())
                else:
                    kept.append(text if as_is else b" ".join(w).decode())
                total.append(len(w))
                removed.append(lost)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in columns), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                [*columns, "n_words", "n_removed", "kept"])

    carried = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in keyed.schema if f.name.startswith("_"))
    schema = f"doc_id long{carried}, n_words long, n_removed long, kept string"
    each = [d.select(*columns, "text", "found").mapInArrow(frugal(batches), schema) for d in (clear, rows)]
    return each[0].unionByName(each[1])
