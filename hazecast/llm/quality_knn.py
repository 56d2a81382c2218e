"""Quality classifier by nearest-neighbour voting in a latent space.

Texts are vectors of hashed terms: words, the shapes of words (runs of upper
case, lower case, digits and each other character) and repetitions of the
word before.  A truncated singular value decomposition of a bounded, balanced
sample of labelled texts (``per_label`` of each label by hash order) gives the
latent space; the sample's latent vectors and the projection are broadcast
(bounded by the sample and the number of terms).  Every document is projected,
its cosines with all labelled vectors are computed as exact blocked products,
and the ``neighbours`` nearest vote with a power of their similarity; a weak
prior keeps the vote defined when nothing is similar.

Null and empty texts are vectors of the single term for no words and are
scored like any other.  Labels and ids that are null are not learned from;
repeated label rows are; if a label is missing altogether the other gets all
votes, and with no labels every score is 0.5.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazecast.llm.common import bounded_sample, worker_cache

PER_LABEL = 1_200
WORD_TERMS, SHAPE_TERMS = 2_048, 512
TERMS = WORD_TERMS + SHAPE_TERMS + 2        # and: word repeated, no words
RANK = 48
NEIGHBOURS = 25
POWER = 4.0
PRIOR_WEIGHT = 0.01
THRESHOLD = 0.3
CACHE_WORDS = 400_000
SHAPE_WEIGHT = 2.0
_SHAPE = re.compile(r"(.)\1+", re.S)


def shape(word: str) -> str:
    """Runs of upper-case letters, lower-case letters and digits as X, x, 9;
    any other character stands for itself, runs of it once."""
    kinds = "".join("9" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c for c in word)
    return _SHAPE.sub(r"\1", kinds)


class TermIds(dict):
    """Word → packed term ids (its word bucket and its shape bucket)."""

    def __missing__(self, word: str) -> int:
        terms = (zlib.crc32(word.lower().encode("utf-8", "replace")) % WORD_TERMS * SHAPE_TERMS
                 + zlib.crc32(shape(word).encode("utf-8", "replace")) % SHAPE_TERMS)
        if len(self) < CACHE_WORDS and len(word) < 64:
            self[word] = terms
        return terms


def vector(text: str | None, ids: TermIds) -> np.ndarray:
    """Square roots of term shares, words and shapes each of length 1 before
    the inverse document frequencies."""
    out = np.zeros(TERMS, np.float32)
    w = text.split() if text else []
    if not w:
        out[-1] = 1
        return out
    packed = np.fromiter(map(ids.__getitem__, w), np.int64, len(w))
    out[:WORD_TERMS] = np.sqrt(np.bincount(packed // SHAPE_TERMS, minlength=WORD_TERMS) / len(w))
    out[WORD_TERMS:-2] = SHAPE_WEIGHT * np.sqrt(np.bincount(packed % SHAPE_TERMS, minlength=SHAPE_TERMS) / len(w))
    out[-2] = SHAPE_WEIGHT * np.sqrt((packed[1:] == packed[:-1]).mean()) if len(w) > 1 else 0
    return out


class Model:
    """Projection, labelled latent vectors (unit length) and labels."""

    def __init__(self, projection: np.ndarray, latent: np.ndarray, labels: np.ndarray):
        self.projection, self.latent, self.labels = projection, latent, labels

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray, rank: int = RANK, seed: int = 5) -> Model:
        idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1
        x = x * idf
        rank = max(1, min(rank, *x.shape))
        q = np.random.default_rng(seed).standard_normal((x.shape[1], rank + 8)).astype(np.float32)
        for _ in range(4):                   # subspace iteration towards the leading singular vectors
            q = np.linalg.qr(x.T @ (x @ q))[0]
        _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
        projection = (idf[:, None] * (q @ vt.T[:, :rank])).astype(np.float32)
        return cls(projection, unit((x / idf) @ projection), labels)

    def scores(self, x: np.ndarray, neighbours: int, power: float) -> np.ndarray:
        """Share of the similarity-weighted votes for label 1."""
        if not len(self.labels):
            return np.full(len(x), 0.5)
        cosine = unit(x @ self.projection) @ self.latent.T
        k = min(neighbours, len(self.labels))
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** power
        votes = (weight * self.labels[near]).sum(1) + PRIOR_WEIGHT * self.labels.mean()
        return votes / (weight.sum(1) + PRIOR_WEIGHT)


def unit(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]).astype(np.float32)


def train(labelled: DataFrame, per_label: int = PER_LABEL, labels: DataFrame | None = None) -> Model:
    """Learn from columns text and label (0 or 1) of a bounded sample.

    With ``labels`` (doc_id, label), ``labelled`` has doc_id and text; only
    hashes of texts are joined with the labels, texts are not shuffled.
    """
    label, text = F.col("label").cast("int").alias("label"), F.col("text").cast("string").alias("text")
    if labels is None:
        sample = bounded_sample(labelled.select(label, text).where("label in (0, 1)"), "label", per_label)
    else:
        texts = labelled.select("doc_id", text).where("text is not null")
        rows = texts.select("doc_id", F.xxhash64("text").alias("h")).join(
            labels.select("doc_id", label).where("label in (0, 1)"), "doc_id")
        sample = bounded_sample(rows, "label", per_label, texts.select("text"))

    def vectors(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = TermIds()
        for b in it:
            rows = [vector(t.as_py(), ids) for t in b.column(1)]
            terms = [np.flatnonzero(r).astype(np.int32) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(terms, pa.list_(pa.int32())),
                 pa.array([r[t] for r, t in zip(rows, terms)], pa.list_(pa.float32()))], ["label", "terms", "shares"])

    got = sample.select("label", "text").mapInArrow(vectors, "label int, terms array<int>, shares array<float>").toArrow()
    x = np.zeros((got.num_rows, TERMS), np.float32)
    for i, (t, v) in enumerate(zip(got.column("terms"), got.column("shares"))):
        x[i, t.values.to_numpy()] = v.values.to_numpy()
    labels = np.asarray(got.column("label"), dtype=np.float64)
    if not len(labels):
        return Model(np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), labels)
    order_ = np.lexsort((*x.T[:8], labels))   # the order of arrival must not matter
    return Model.fit(x[order_], labels[order_])


def score(docs: DataFrame, model: Model, neighbours: int = NEIGHBOURS, power: float = POWER) -> DataFrame:
    """doc_id, score, predicted of every document."""
    name = f"quality:{uuid.uuid4().hex}"
    shared = docs.sparkSession.sparkContext.broadcast((model.projection, model.latent, model.labels))

    @F.pandas_udf("double")
    def votes(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own, ids = worker_cache(name, lambda: (Model(*shared.value), TermIds()))
        for texts in it:
            if not len(texts):
                yield pd.Series([], dtype="float64")
                continue
            x = np.stack([vector(t, ids) for t in texts])
            yield pd.Series(own.scores(x, neighbours, power))

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), votes(F.col("text").cast("string")).alias("score"))
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")))
