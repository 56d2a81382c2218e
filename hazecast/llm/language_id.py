"""Language ID of mixed-language text.

Training (a bounded sample of labelled texts, ``per_language`` of each
language by hash order) counts hashed character n-grams and the scripts of
letters per language; at most languages x buckets counts reach the driver.

Prediction: the script of a word's letters narrows its candidate languages to
those that use the script, each candidate scores the word by its n-gram
log-likelihoods, and Viterbi over the words of a text, with a penalty for each
switch, labels spans.  A text's language is the one with most letters on the
path; its score is that share of the letters.

Null texts and texts without letters are ``und`` with score 0; so is every
text if nothing was learned.  Words of scripts that no language uses are no
evidence.  Ties go to the language first by code point.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazecast.llm.common import bounded_sample, frugal, worker_cache

PER_LANGUAGE = 1_500
GRAMS = (1, 2, 3, 4)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
BUCKETS = 1 << 15
SWITCH = 12.0
#: Least share of a language's letters in a script for it to be a candidate.
SCRIPT_SHARE = 0.01
CACHE_WORDS = 150_000
#: Words scored at once; longer words are read in pieces that share all but
#: one character of the longest n-gram, so that no n-gram is lost.
CHUNK_WORDS, LONG_WORD, OVERLAP = 16_384, 256, max(GRAMS) - 1
UND = "und"

# First code points of the ranges of scripts (Unicode blocks).
SCRIPT_STARTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "indic"),
    (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"),
    (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xA720, "latin"),
    (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"),
    (0xFB50, "arabic"), (0xFE00, "other"), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "other"),
    (0x20000, "han"), (0x30000, "other"),
)
SCRIPTS = sorted({name for _, name in SCRIPT_STARTS})
_STARTS = np.array([a for a, _ in SCRIPT_STARTS])
_SCRIPT_OF = np.array([SCRIPTS.index(name) for _, name in SCRIPT_STARTS])


def letters(word: str) -> str:
    """The letters (by character category, so no number signs) in lower case."""
    return word.lower() if word.isalpha() else "".join(filter(str.isalpha, word)).lower()


def script_places(points: np.ndarray) -> np.ndarray:
    """Place in ``SCRIPTS`` of the script of each code point."""
    return _SCRIPT_OF[np.searchsorted(_STARTS, points, side="right") - 1]


class Grams:
    """Buckets of the character n-grams of many words at once, ends marked."""

    def __init__(self, lows: list[str], buckets: int):
        text = "".join(f"^{low}$" for low in lows)
        self.points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        self.size = np.fromiter(map(len, lows), np.int64, len(lows))
        self.word = np.repeat(np.arange(len(lows)), self.size + 2)
        self.buckets = np.uint64(buckets)

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word, bucket) of the n-grams of each length."""
        points = code = self.points.astype(np.uint64)
        for n in GRAMS:
            if n > 1:
                code = code[:-1] * _MULTIPLIER + points[n - 1:]
            inside = self.word[:len(code)] == self.word[n - 1:]
            yield self.word[:len(code)][inside], ((code[inside] * _MULTIPLIER >> np.uint64(40)) % self.buckets).astype(np.int64)

    def scripts(self) -> np.ndarray:
        """[word, script] numbers of letters."""
        letter = np.ones(len(self.points), bool)
        ends = np.cumsum(self.size + 2)
        letter[ends - 1] = letter[ends - self.size - 2] = False
        at = self.word[letter] * len(SCRIPTS) + script_places(self.points[letter])
        return np.bincount(at, minlength=len(self.size) * len(SCRIPTS)).reshape(-1, len(SCRIPTS))


class Model:
    """Log-likelihoods [bucket, language] and candidates [script, language]."""

    def __init__(self, languages: Sequence[str], scores: np.ndarray, candidates: np.ndarray):
        self.languages, self.scores, self.candidates = list(languages), scores, candidates

    def words(self, lows: list[str]) -> np.ndarray:
        """[word, language] scores of the letters of words (none: zeros)."""
        g = Grams(lows, len(self.scores))
        total, n = np.zeros((len(lows), len(self.languages))), np.zeros(len(lows))
        for word, bucket in g:
            n += np.bincount(word, minlength=len(lows))
            for k in range(len(self.languages)):
                total[:, k] += np.bincount(word, self.scores[bucket, k], len(lows))
        s = total / np.maximum(n, 1)[:, None] * g.size[:, None]
        allowed = self.candidates[g.scripts().argmax(1)]
        s = s - np.where(allowed, s, -np.inf).max(1, initial=-1e9)[:, None]
        s = np.where(allowed, np.maximum(s, -30), -60)
        s[(g.size == 0) | ~allowed.any(1)] = 0
        return s.astype(np.float32)


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE, buckets: int = BUCKETS) -> Model:
    """Learn from columns text and lang of a bounded sample."""
    sample = bounded_sample(labelled.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")),
                            "lang", per_language)

    def counts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heard: dict[str, Counter] = {}
        for b in it:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                heard.setdefault(lang, Counter()).update(text.as_py().split())
        out: list[list] = [[], [], []]
        for lang, own in heard.items():
            lows, times = [letters(w) for w in own], np.array(list(own.values()))
            found = np.zeros(buckets + len(SCRIPTS), np.int64)           # n-grams, then letters by script
            for i in range(0, len(lows), CHUNK_WORDS):
                g, n = Grams(lows[i:i + CHUNK_WORDS], buckets), times[i:i + CHUNK_WORDS]
                found[buckets:] += (g.scripts() * n[:, None]).sum(0)
                for word, bucket in g:
                    found[:buckets] += np.bincount(bucket, n[word] * (g.size[word] > 0), buckets).astype(np.int64)
            some = np.flatnonzero(found)
            for column, v in zip(out, ([lang] * len(some), some, found[some])):
                column.extend(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64())],
                                         ["lang", "bucket", "n"])

    rows = (sample.select("lang", "text").mapInArrow(counts, "lang string, bucket int, n long")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pydict())
    languages = sorted(set(rows["lang"]), key=lambda s: s.encode())
    place = {x: i for i, x in enumerate(languages)}
    found = np.zeros((buckets + len(SCRIPTS), len(languages)))
    for lang, bucket, n in zip(rows["lang"], rows["bucket"], rows["n"]):
        found[bucket, place[lang]] = n
    used = found[buckets:]
    candidates = (used > 0) & (used >= SCRIPT_SHARE * used.sum(0))
    scores = np.log((found[:buckets] + 0.5) / (found[:buckets].sum(0) + 0.5 * buckets)).astype(np.float32)
    return Model(languages, scores, candidates)


class WordScores:
    """Rows of a growing score matrix for the words seen; emptied when full."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model.languages)), np.float32)
        self.letters = np.zeros(0, np.int64)

    def of(self, texts: list[str]) -> list[np.ndarray]:
        """Rows of the words of each text, new words scored together."""
        split = [self.split(t) for t in texts]
        new = list(dict.fromkeys(w for t in split for w in t if w not in self.rows))
        lows = [letters(w) for w in new]
        scores = [self.model.words(lows[i:i + CHUNK_WORDS]) for i in range(0, len(lows), CHUNK_WORDS)]
        self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
        self.scores = np.concatenate([self.scores, *scores])
        self.letters = np.concatenate([self.letters, np.fromiter(map(len, lows), np.int64, len(lows))])
        return [np.fromiter(map(self.rows.__getitem__, t), np.int64, len(t)) for t in split]

    @staticmethod
    def split(text: str) -> list[str]:
        """Words; those over ``LONG_WORD`` characters in overlapping pieces."""
        w = text.split()
        if max(map(len, w), default=0) <= LONG_WORD:
            return w
        step = LONG_WORD - OVERLAP
        return [x[i:i + LONG_WORD] for x in w for i in range(0, max(1, len(x) - OVERLAP), step)]


def viterbi(scores: np.ndarray, rows: list[np.ndarray], switch: float) -> list[np.ndarray]:
    """The best language of every word of several texts at once; each step
    handles one word of every text that is long enough."""
    if not scores.shape[1]:
        return [np.zeros(len(r), np.int64) for r in rows]
    by = sorted(range(len(rows)), key=lambda i: -len(rows[i]))
    size = np.array([len(rows[i]) for i in by])
    flat = np.concatenate([rows[i] for i in by]) if len(by) else np.empty(0, np.int64)
    start = np.concatenate(([0], np.cumsum(size)[:-1])) if len(by) else size
    k, languages = len(by), scores.shape[1]
    came = np.zeros((len(flat), languages), np.int8 if languages < 128 else np.int16)
    own = np.arange(languages)
    value = np.zeros((k, languages))
    active = k
    for t in range(int(size[0]) if k else 0):
        while active and size[active - 1] <= t:
            active -= 1
        at = start[:active] + t
        v = value[:active]
        if t:
            top = v.argmax(1)
            jump = v[np.arange(active), top] - switch
            stay = v >= jump[:, None]
            came[at] = np.where(stay, own, top[:, None])
            v = np.where(stay, v, jump[:, None])
        value[:active] = v + scores[flat[at]]
    path = np.zeros(len(flat), np.int64)
    last = value.argmax(1) if k else np.empty(0, np.int64)
    active = 0
    for t in range(int(size[0]) - 1 if k else -1, -1, -1):
        while active < k and size[active] > t:
            active += 1
        at = start[:active] + t
        path[at] = last[:active]
        last[:active] = came[at, last[:active]]
    out: list[np.ndarray] = [None] * k
    for n, i in enumerate(by):
        out[i] = path[start[n]:start[n] + size[n]]
    return out


SPANS = "array<struct<first:int,words:int,lang:string>>"


def predict(docs: DataFrame, model: Model, switch: float = SWITCH, carry: Sequence[str] = (),
            spans: bool = True) -> DataFrame:
    """doc_id, lang_pred, score, spans (and the columns of ``carry``, each with
    a ``_`` before its name); a span is consecutive words of one language."""
    name = f"word_scores:{uuid.uuid4().hex}"
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.scores, model.candidates))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       *(F.col(c).alias(f"_{c}") for c in carry))
    columns = ["doc_id", *(f"_{c}" for c in carry)]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache(name, lambda: WordScores(Model(*shared.value)))
        languages = cache.model.languages
        for b in it:
            if len(cache.rows) > CACHE_WORDS:
                cache.clear()
            rows = cache.of([t.as_py() or "" if languages else "" for t in b.column("text")])
            pred, score, found = [], [], []
            for r, path in zip(rows, viterbi(cache.scores, rows, switch)):
                weight = np.bincount(path, cache.letters[r], max(1, len(languages)))
                if not weight.sum():
                    pred.append(UND)
                    score.append(0.0)
                    found.append([])
                    continue
                best = int(weight.argmax())
                pred.append(languages[best])
                score.append(float(weight[best] / weight.sum()))
                cut = np.flatnonzero(np.diff(path, prepend=-1)) if spans else []
                found.append([{"first": int(a), "words": int(e - a), "lang": languages[path[a]]}
                              for a, e in zip(cut, [*cut[1:], len(path)])])
            kind = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in columns), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(found, kind)],
                [*columns, "lang_pred", "score", "spans"])

    carried = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in read.schema if f.name.startswith("_"))
    return read.mapInArrow(frugal(batches, cached=True), f"doc_id long{carried}, lang_pred string, score double, spans {SPANS}")
