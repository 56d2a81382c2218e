"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word is the network's input twice: as a whole (a learned vector of each
frequent word of the sample) and by its characters (the mean of learned
vectors of its hashed character n-grams, which also know words never seen).  A
gated recurrent unit reads a window of words forwards, another one backwards;
attention weights pool their states to one vector, whose logit scores the
window.  Windows of ``WINDOW`` words overlap by half and cover the whole text;
a document is as toxic as its worst window, so a few words in a long text count
as much as in a short one.

Training is in numpy, on the driver, on a bounded sample (``per_label`` texts of
each label by hash order; a sampled text gives its windows, the worst of which
carries the text's label, found anew each round).  The first components of
the vectors start as the log odds of a word (or n-gram) among the sampled texts,
the rest at random; everything is then learned by backpropagation through time.
The model is broadcast: bounded by the vocabulary and the buckets.

Scoring keeps, in every worker, the input projections of the words seen (emptied
when full) and runs windows in blocks, so memory is bounded whatever the
length of a text.  Words of over ``LONG_WORD`` characters are read in overlapping
pieces, so no n-gram is lost.

Null texts and texts without words are one window of a single empty word and
scored like any other.  Null ids and labels other than 0 and 1 are not
learned from; repeated label rows and repeated texts count once a label.  With
one label missing the score is that label's share (0 or 1), with none 0.5.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazecast.llm.common import bounded_sample, worker_cache

PER_LABEL = 1_000
WINDOW, STRIDE = 32, 16
WORDS, BUCKETS = 20_000, 1 << 15
GRAMS = (2, 3, 4, 5)
WORD_DIM = CHAR_DIM = 12
HIDDEN, ATTENTION = 12, 12
EPOCHS, BATCH, RATE = 14, 64, 0.01
#: Doubt in labels after the first quarter of the rounds: some are wrong.
TRUST = 0.5
#: Texts in which a word or n-gram occurs before it has a vector of its own.
LEAST_TEXTS = 2
THRESHOLD = 0.7
LONG_WORD, OVERLAP = 32, 4
CACHE_WORDS, BLOCK_WINDOWS = 100_000, 1_024
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def split(text: str | None) -> list[str]:
    """Words in lower case; long ones in pieces that overlap."""
    words = text.lower().split() if text else []
    if max(map(len, words), default=0) > LONG_WORD:
        words = [w[i:i + LONG_WORD] for w in words for i in range(0, max(1, len(w) - OVERLAP), LONG_WORD - OVERLAP)]
    return words or [""]


def bare(word: str) -> str:
    """A word without the marks around it."""
    return word if word.isalnum() else word.strip("".join({c for c in word if not c.isalnum()}))


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of the character n-grams of many words, ends marked, in
    the order of the words."""
    marked = [f"^{w}$" for w in words]
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(len(words)), np.fromiter(map(len, marked), np.int64, len(words)))
    word, bucket, code = [], [], points
    for n in range(1, max(GRAMS) + 1):
        if n > 1:
            code = code[:-1] * _MULTIPLIER + points[n - 1:]
        if n in GRAMS:
            inside = of[:len(code)] == of[n - 1:]
            word.append(of[:len(code)][inside])
            bucket.append(((code[inside] * _MULTIPLIER) >> np.uint64(40)) % np.uint64(BUCKETS))
    word, bucket = np.concatenate(word), np.concatenate(bucket).astype(np.int64)
    by = np.argsort(word, kind="stable")
    return word[by], bucket[by]


def windows_of(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, words, lengths): the windows of several texts as a matrix of word
    rows, short ones filled up with -1.  Windows start every ``STRIDE`` words and
    the last one reaches the end."""
    text, at, size, flat, before = [], [], [], np.concatenate([*rows, np.full(WINDOW, -1)]), 0
    for i, r in enumerate(rows):
        starts = np.arange(0, max(1, len(r) - WINDOW + STRIDE), STRIDE)
        text.append(np.full(len(starts), i))
        at.append(before + starts)
        size.append(np.minimum(len(r) - starts, WINDOW))
        before += len(r)
    size = np.concatenate(size)
    words = flat[np.minimum(np.concatenate(at)[:, None] + np.arange(WINDOW), len(flat) - 1)]
    words[np.arange(WINDOW) >= size[:, None]] = -1
    return np.concatenate(text), words, size


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters by name and the passes through them.

    Gates lie side by side as update, reset and candidate.  Directions share
    the code: the backward one reads the steps from the end.
    """

    SHAPES = {"in": (WORD_DIM + CHAR_DIM, 6 * HIDDEN), "bias": (6 * HIDDEN,), "forth": (HIDDEN, 3 * HIDDEN), "back": (HIDDEN, 3 * HIDDEN),
              "att": (2 * HIDDEN, ATTENTION), "att_bias": (ATTENTION,), "att_out": (ATTENTION,), "out": (2 * HIDDEN,), "out_bias": (1,)}

    def __init__(self, values: dict[str, np.ndarray], words: dict[str, int]):
        self.p, self.words = values, words

    @classmethod
    def fresh(cls, word: np.ndarray, char: np.ndarray, words: dict[str, int], seed: int) -> Network:
        rng = np.random.default_rng(seed)
        values = {name: (rng.standard_normal(shape) / np.sqrt(shape[0]) if len(shape) > 1 else np.zeros(shape)).astype(np.float32)
                  for name, shape in cls.SHAPES.items()}
        values["att_out"] = (rng.standard_normal(ATTENTION) / np.sqrt(ATTENTION)).astype(np.float32)
        values["out"] = (rng.standard_normal(2 * HIDDEN) / np.sqrt(2 * HIDDEN)).astype(np.float32)
        return cls(values | {"word": word, "char": char}, words)

    def inputs(self, words: list[str]) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """[word, input] vectors, and what they are made of: rows of the word
        table, the n-grams' words and buckets."""
        cut = [bare(w) for w in words]
        row = np.fromiter((self.words.get(w, 0) for w in cut), np.int64, len(cut))
        of, bucket = grams(cut)
        char = self.p["char"][bucket]
        sums = np.zeros((len(words), CHAR_DIM), np.float32)
        some, start = np.unique(of, return_index=True)
        if len(of):
            sums[some] = np.add.reduceat(char, start)
        n = np.maximum(np.bincount(of, minlength=len(words)), 1).astype(np.float32)
        return np.concatenate([self.p["word"][row], sums / np.sqrt(n)[:, None]], 1), (row, of, bucket)

    def project(self, x: np.ndarray) -> np.ndarray:
        return x @ self.p["in"] + self.p["bias"]

    def run(self, gates: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows given their gates [step, window, 6 * hidden] and
        which steps are words; with ``keep`` also what backward() needs."""
        steps, n, _ = gates.shape
        h = HIDDEN
        states = np.zeros((steps, n, 2 * h), np.float32)
        kept: dict[str, list] = {"forth": [None] * steps, "back": [None] * steps}
        whole = mask.all()
        for way, order, a in (("forth", range(steps), 0), ("back", range(steps - 1, -1, -1), 1)):
            own, last = self.p[way], np.zeros((n, h), np.float32)
            for t in order:
                g, u = gates[t, :, 3 * h * a:3 * h * (a + 1)], last @ own
                zr = sigmoid(g[:, :2 * h] + u[:, :2 * h])
                z, r = zr[:, :h], zr[:, h:]
                c = np.tanh(g[:, 2 * h:] + r * u[:, 2 * h:])
                new = c + z * (last - c)
                if not whole:
                    new = np.where(mask[t][:, None], new, last)
                if keep:
                    kept[way][t] = (last, z, r, c, u[:, 2 * h:])
                states[t, :, h * a:h * (a + 1)] = last = new
        hidden = np.tanh(states @ self.p["att"] + self.p["att_bias"])
        energy = np.where(mask, hidden @ self.p["att_out"], -np.inf)
        weight = np.exp(energy - energy.max(0))
        weight /= weight.sum(0)
        pooled = (states * weight[:, :, None]).sum(0)
        logit = pooled @ self.p["out"] + self.p["out_bias"][0]
        return (logit, (states, hidden, weight, pooled, kept)) if keep else logit

    def backward(self, d_logit: np.ndarray, mask: np.ndarray, held) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters past the input, and of the gates."""
        states, hidden, weight, pooled, kept = held
        steps, n, _ = states.shape
        h, p = HIDDEN, self.p
        grad = {"out": d_logit @ pooled, "out_bias": np.array([d_logit.sum()], np.float32)}
        d_pooled = d_logit[:, None] * p["out"]
        d_states = weight[:, :, None] * d_pooled
        d_weight = (states * d_pooled).sum(2)
        d_energy = weight * (d_weight - (weight * d_weight).sum(0))
        grad["att_out"] = np.einsum("tn,tna->a", d_energy, hidden)
        d_hidden = d_energy[:, :, None] * p["att_out"] * (1 - hidden ** 2)
        flat = d_hidden.reshape(-1, ATTENTION)
        grad["att"], grad["att_bias"] = states.reshape(-1, 2 * h).T @ flat, flat.sum(0)
        d_states = d_states + d_hidden @ p["att"].T
        d_gates = np.zeros((steps, n, 6 * h), np.float32)
        for way, order, a in (("forth", range(steps - 1, -1, -1), 0), ("back", range(steps), 1)):
            own, carried = np.zeros_like(p[way]), np.zeros((n, h), np.float32)
            for t in order:
                last, z, r, c, u = kept[way][t]
                d = d_states[t, :, h * a:h * (a + 1)] + carried
                on = mask[t][:, None]
                d_new = np.where(on, d, 0)
                d_c = d_new * (1 - z) * (1 - c ** 2)
                d_z = d_new * (last - c) * z * (1 - z)
                d_r = d_c * u * r * (1 - r)
                d_u = np.concatenate([d_z, d_r, d_c * r], 1)
                own += last.T @ d_u
                carried = np.where(on, d_new * z, d) + d_u @ p[way].T
                d_gates[t, :, 3 * h * a:3 * h * (a + 1)] = np.concatenate([d_z, d_r, d_c], 1)
            grad[way] = own
        return grad, d_gates

    def learn(self, words: list[str], index: np.ndarray, size: np.ndarray, label: np.ndarray,
              trust: float = 0.0) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss of windows (rows of ``words``) and the gradients of all
        parameters.  With ``trust`` 0 the loss is the cross entropy; above, a
        label counts the less the more the network disagrees with it."""
        x, (row, of, bucket) = self.inputs(words)
        mask = (np.arange(index.shape[1])[:, None] < size)
        at = np.maximum(index.T, 0)
        gates = self.project(x)[at]
        logit, held = self.run(gates, mask, keep=True)
        score = sigmoid(logit)
        own = np.where(label > 0, score, 1 - score) ** trust
        loss = ((1 - own) / trust).mean() if trust else -np.log(np.where(label > 0, score, 1 - score)).mean()
        grad, d_gates = self.backward((own * (score - label) / len(label)).astype(np.float32), mask, held)
        d_word = np.zeros((len(words), 6 * HIDDEN), np.float32)
        np.add.at(d_word, at[mask], d_gates[mask])
        grad["in"], grad["bias"] = x.T @ d_word, d_word.sum(0)
        d_x = d_word @ self.p["in"].T
        n = np.maximum(np.bincount(of, minlength=len(words)), 1).astype(np.float32)
        grad["word"], grad["char"] = np.zeros_like(self.p["word"]), np.zeros_like(self.p["char"])
        np.add.at(grad["word"], row, d_x[:, :WORD_DIM])
        np.add.at(grad["char"], bucket, (d_x[:, WORD_DIM:] / np.sqrt(n)[:, None])[of])
        grad["word"][0] = 0             # words without a vector stay at zero
        return float(loss), grad


class Scorer:
    """A network and the gates of the words that a worker has seen."""

    def __init__(self, network: Network):
        self.network = network
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.gates = np.zeros((0, 6 * HIDDEN), np.float32)

    def of(self, texts: list[str | None]) -> list[np.ndarray]:
        """Rows of the words of each text, new words projected together."""
        if len(self.rows) > CACHE_WORDS:
            self.clear()
        words = [split(t) for t in texts]
        new = [w for w in dict.fromkeys(w for t in words for w in t) if w not in self.rows]
        self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
        blocks = [self.network.project(self.network.inputs(new[i:i + 8_192])[0]) for i in range(0, len(new), 8_192)]
        self.gates = np.concatenate([self.gates, *blocks])
        return [np.fromiter(map(self.rows.__getitem__, t), np.int64, len(t)) for t in words]

    def logits(self, words: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Logits of windows given as rows, windows of like length together."""
        out, by = np.empty(len(words)), np.argsort(size, kind="stable")
        for i in range(0, len(by), BLOCK_WINDOWS):
            some = by[i:i + BLOCK_WINDOWS]
            longest = int(size[some[-1]])
            out[some] = self.network.run(self.gates[np.maximum(words[some, :longest].T, 0)], np.arange(longest)[:, None] < size[some])
        return out

    def worst(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Largest logit of each text, and its window (words, length)."""
        text, words, size = windows_of(rows)
        logit = self.logits(words, size)
        by = np.lexsort((np.arange(len(text)), -logit, text))
        best = by[np.searchsorted(text[by], np.arange(len(rows)))]
        return logit[best], words[best], size[best], text[best]


def log_odds(present: np.ndarray, absent: np.ndarray, n: tuple[int, int]) -> np.ndarray:
    """Log odds of occurring in texts of label 1 against label 0, in units of
    their standard error and bounded."""
    a, b = present + 0.5, absent + 0.5
    odds = np.log(a / (n[0] - present + 0.5)) - np.log(b / (n[1] - absent + 0.5))
    return np.clip(odds / np.sqrt(1 / a + 1 / b), -4, 8) / 4


def fit(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 13) -> Network:
    """Learn from texts and labels that both occur."""
    rng = np.random.default_rng(seed)
    split_texts = [[bare(w) for w in split(t)] for t in texts]
    place = {w: i for i, w in enumerate(dict.fromkeys(w for t in split_texts for w in t))}
    n = (int(labels.sum()), int(len(labels) - labels.sum()))
    by_word, by_bucket = np.zeros((2, len(place))), np.zeros((2, BUCKETS))
    names = list(place)
    of, bucket = grams(names)
    ends = np.searchsorted(of, np.arange(len(names) + 1))
    for words, label in zip(split_texts, labels.astype(int)):
        own = np.unique([place[w] for w in words])
        by_word[1 - label][own] += 1
        found = np.unique(np.concatenate([bucket[ends[w]:ends[w + 1]] for w in own])) if len(own) else []
        by_bucket[1 - label][found] += 1
    often = np.flatnonzero(by_word.sum(0) >= LEAST_TEXTS)
    odds = log_odds(by_word[0], by_word[1], n)
    often = often[np.lexsort((often, -by_word.sum(0)[often], -np.abs(odds[often])))][:WORDS]
    word = np.zeros((len(often) + 1, WORD_DIM), np.float32)             # row 0: any other word
    word[1:] = 0.1 * rng.standard_normal((len(often), WORD_DIM))
    word[1:, 0] = odds[often]
    char = np.zeros((BUCKETS, CHAR_DIM), np.float32)
    known = by_bucket.sum(0) >= LEAST_TEXTS
    char[known] = 0.1 * rng.standard_normal((int(known.sum()), CHAR_DIM))
    char[known, 0] = log_odds(by_bucket[0], by_bucket[1], n)[known]
    network = Network.fresh(word, char, {names[i]: k + 1 for k, i in enumerate(often)}, seed)
    optimise(network, texts, labels, epochs, rng)
    return network


def optimise(network: Network, texts: list[str], labels: np.ndarray, epochs: int, rng: np.random.Generator) -> None:
    """Adam over the worst window of every text, labels weighing alike."""
    first = {k: np.zeros_like(v) for k, v in network.p.items()}
    second = {k: np.zeros_like(v) for k, v in network.p.items()}
    weight = np.where(labels > 0, (labels == 0).sum(), (labels > 0).sum()).astype(float)
    weight /= weight.sum()
    step = 0
    for epoch in range(epochs):
        scorer = Scorer(network)
        rows = scorer.of(texts)
        _, windows, size, _ = scorer.worst(rows)
        names = np.array([*scorer.rows, ""], object)
        for _ in range(max(1, len(texts) // BATCH)):
            pick = rng.choice(len(texts), BATCH, p=weight)
            used, index = np.unique(np.maximum(windows[pick], 0), return_inverse=True)
            _, grad = network.learn(names[used].tolist(), index.reshape(len(pick), -1), size[pick], labels[pick].astype(np.float32),
                                    TRUST if epoch >= epochs // 4 else 0.0)
            step += 1
            rate = RATE * (1 - epoch / epochs) * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
            for k, g in grad.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                network.p[k] -= (rate * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)


def train(texts: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, epochs: int = EPOCHS) -> Network | float:
    """Learn from ``texts`` (doc_id, text) and ``labels`` (doc_id, label); where a
    label is missing altogether, the constant score instead."""
    label, text = F.col("label").cast("int").alias("label"), F.col("text").cast("string").alias("text")
    texts = texts.select("doc_id", text).where("text is not null")
    rows = texts.select("doc_id", F.xxhash64("text").alias("h")).join(labels.select("doc_id", label).where("label in (0, 1)"), "doc_id")
    got = bounded_sample(rows, "label", per_label, texts.select("text")).select("label", "text").toPandas()
    got = got.sort_values(["label", "text"], kind="stable")             # the order of arrival must not matter
    own = got["label"].to_numpy(np.float64)
    if not len(own) or own.min() == own.max():
        return float(own[0]) if len(own) else 0.5
    return fit(got["text"].tolist(), own, epochs)


def score(docs: DataFrame, model: Network | float, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of every document."""
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    if isinstance(model, float):
        out = docs.select(doc_id, F.lit(model).alias("score"))
    else:
        name = f"toxicity:{uuid.uuid4().hex}"
        shared = docs.sparkSession.sparkContext.broadcast((model.p, model.words))

        @F.pandas_udf("double")
        def worst(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
            scorer = worker_cache(name, lambda: Scorer(Network(*shared.value)))
            for texts in it:
                logit = scorer.worst(scorer.of(texts.tolist()))[0] if len(texts) else np.empty(0)
                yield pd.Series(sigmoid(logit), dtype="float64")

        out = docs.select(doc_id, worst(F.col("text").cast("string")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
