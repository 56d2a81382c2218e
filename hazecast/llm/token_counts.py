"""Token counts of whole texts by a map-side two-tier lookup.

The first tier is a compact table (one string buffer, one byte array) of the
token numbers of frequent pre-tokens, broadcast; one task counts them in a
bounded sample of texts.  Every text, whatever its script, is then cut into
pre-tokens in the map task that holds it and their numbers are added up:
frequent ones from the table, the rest from the worker's cache, which encodes
what it misses.  No pre-token is shuffled.  Texts that hold a special token's
string are encoded whole, as the library cuts those out first.

The table is a speed-up: counts are those of the tokenizer for any table.
Null and empty texts have 0 bytes and 0 tokens; repeated rows and null doc_ids
are carried along.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazecast.llm.common import worker_cache
from hazecast.llm.tokens import CACHED_LENGTH, PieceCounts, PieceTokenizer, cut_byte_level

FREQUENT = 32_768
#: Texts sampled for the table, and pre-tokens held while they are counted.
SAMPLE, HELD = 8_192, 1_000_000
PIECE_LIMIT = 255


def frequent_pretokens(docs: DataFrame, vocabulary: str, frequent: int = FREQUENT, sample: int = SAMPLE) -> list[tuple[str, int]]:
    """The heaviest pre-tokens of a bounded sample of texts (spread by hash over
    all of them) with their token numbers; one task counts them and at most
    ``frequent`` rows reach the driver.  No pre-token is shuffled."""
    def counts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pt = worker_cache(f"piece_tokenizer:{vocabulary}", lambda: PieceTokenizer(vocabulary))
        cut, seen = cut_byte_level(), Counter()
        for b in it:
            for t in b.column(0):
                text = t.as_py()
                if text and not pt.marked(text):
                    seen.update(k for k in (cut if pt.plain(text) else pt.cut)(text) if len(k) <= CACHED_LENGTH)
            if len(seen) > HELD:
                seen = Counter(dict(seen.most_common(HELD // 2)))
        top = sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:frequent]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.string())], ["piece"])

    texts = docs.select(F.col("text").cast("string").alias("text")).where("text is not null")
    every = max(1, docs.count() // sample)
    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).limit(sample)
    pt = PieceTokenizer(vocabulary)
    sized = [(r[0], len(pt.piece_ids(r[0]))) for r in some.coalesce(1).mapInArrow(counts, "piece string").collect()]
    return [x for x in sized if x[1] <= PIECE_LIMIT]


def compact(pieces: list[tuple[str, int]]) -> tuple[str, np.ndarray, np.ndarray]:
    """The table as one buffer with lengths and token numbers in bytes."""
    return ("".join(p for p, _ in pieces), np.array([len(p) for p, _ in pieces], np.uint8),
            np.array([n for _, n in pieces], np.uint8))


def table_of(packed: tuple[str, np.ndarray, np.ndarray]) -> dict[str, int]:
    buffer, lengths, numbers = packed
    ends = np.cumsum(lengths, dtype=np.int64).tolist()
    return {buffer[e - k:e]: n for e, k, n in zip(ends, lengths.tolist(), numbers.tolist())}


def with_token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, frequent: int = FREQUENT, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document."""
    table = docs.sparkSession.sparkContext.broadcast(compact(frequent_pretokens(docs, vocabulary, frequent, sample)))
    name = f"piece_counts:{uuid.uuid4().hex}"

    @F.pandas_udf("long")
    def tokens(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = worker_cache(name, lambda: PieceCounts(vocabulary, table_of(table.value)))
        for texts in it:
            yield pd.Series([counter.count(t) for t in texts], dtype="int64")

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return (docs.select(F.col("doc_id").cast("long"), F.octet_length(text).cast("long").alias("n_bytes"),
                        tokens(text).alias("n_tokens"))
            .withColumn("over_limit", F.col("n_tokens") > limit))
