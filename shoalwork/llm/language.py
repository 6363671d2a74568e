"""Language identification in two steps: the family, then the language within it.

Features are square roots of the shares of hashed letter 1- to 3-grams of the whole text, lower-cased, with word
ends. A softmax regression tells families apart; within a family, one linear support vector machine for each
pair of languages votes, and a logistic curve over its margins gives the vote's probability. The models
are fitted on the driver on a bounded sample; features of the sample are counted on the executors.

These scores only say which of the languages learnt is the likeliest. Whether a text is like that language at
all is told by its mean surprisal under the language's n-gram shares, held against that of the training rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import small_batches

SAMPLE_ROWS = 4000  # labelled rows that the models are fitted on, at most
SIZE = 2048  # hashed n-grams
LEAST_ROWS = 20  # training rows of a language under which nothing is said of texts unlike it
SEGMENT = 1 << 20  # characters counted at a time

# Families of languages; a language not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ca", "ro", "gl", "oc"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "turkic": ("tr", "az", "kk", "uz"),
    "uralic": ("fi", "et", "hu"),
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}

_letters: list = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def features(text: str) -> np.ndarray | None:
    """The feature vector of a text; None if it has no letter."""
    got = counted(text)
    return got and got[0]


def counted(text: str) -> tuple[np.ndarray, float] | None:
    """The feature vector of a text and its number of n-grams; None if it has no letter. Long texts are counted in segments."""
    total, any_letter, table = np.zeros(SIZE), False, letters()
    for at in range(0, len(text), SEGMENT):
        part = text[at : at + SEGMENT].lower()
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4")
        is_letter = table[codes]
        any_letter = any_letter or bool(is_letter.any())
        c = np.where(is_letter, codes, np.uint32(32)).astype(np.uint32)
        one = c * np.uint32(2654435761)
        two = (one[:-1] ^ (c[1:] * np.uint32(2246822519))) * np.uint32(3266489917)
        three = (two[:-1] ^ (c[2:] * np.uint32(668265263))) * np.uint32(374761393)
        for grams in (one, two, three):
            total += np.bincount(grams >> np.uint32(21), minlength=SIZE)
    return (np.sqrt(total / total.sum()).astype(np.float32), float(total.sum())) if any_letter else None


def with_bias(x: np.ndarray) -> np.ndarray:
    """The rows in single precision with a column of ones at the end; rows that have one already are returned as they are."""
    if x.shape[1] == SIZE + 1:
        return x
    out = np.ones((len(x), SIZE + 1), np.float32)
    out[:, :SIZE] = x
    return out


def descend(gradient, w: np.ndarray, rounds: int, step: float) -> np.ndarray:
    """Nesterov's method."""
    v, t = w, 1.0
    for _ in range(rounds):
        new, after = v - step * gradient(v), (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / after * (new - w), new, after
    return w


class Languages:
    """Fitted models; `names` are the languages learnt."""

    def __init__(self, x: np.ndarray, langs: list[str], n: np.ndarray):
        self.names = sorted(set(langs))
        x = with_bias(x)
        of = np.array(langs, object)
        families = [FAMILY_OF.get(lang, lang) for lang in langs]
        self.families = sorted(set(families))
        self.members = {f: [n for n in self.names if FAMILY_OF.get(n, n) == f] for f in self.families}
        self.family_weights = self.softmax(x, np.array([self.families.index(f) for f in families], int)) if len(self.families) > 1 else None
        self.pairs = {}
        for names in self.members.values():
            for i, a in enumerate(names):
                for b in names[i + 1 :]:
                    rows = (of == a) | (of == b)
                    self.pairs[a, b] = self.machine(x[rows], np.where(of[rows] == a, 1, -1).astype(np.float32))
        self.surprise, self.usual, self.most = np.zeros((len(self.names), SIZE)), np.zeros(len(self.names)), np.full(len(self.names), np.inf)
        found = [name for at in range(0, len(x), 256) for name in self.predict(x[at : at + 256])[0]]
        agreed = np.array(found, object) == of  # labels that the models gainsay are no measure
        for k, name in enumerate(self.names):
            rows = (of == name) & agreed
            if rows.sum() >= LEAST_ROWS:
                share = x[rows, :SIZE]
                share *= share
                self.surprise[k] = -np.log(0.99 * share.mean(0, dtype=np.float64) + 0.01 / SIZE)
                surprisal = (share @ self.surprise[k].astype(np.float32)).astype(np.float64)
                self.usual[k] = np.median(surprisal)
                self.most[k] = max(1e-9, (1.25 + 5 / rows.sum() ** 0.5) * self.excess(surprisal, n[rows], k).max())
        told = np.isfinite(self.most)
        self.most[told] = self.most[told].max(initial=0)  # few rows of one language say little of its rare texts

    def excess(self, surprisal: np.ndarray, n: np.ndarray, lang: np.ndarray | int) -> np.ndarray:
        """How far each row's mean surprisal lies above its language's median; short texts may differ more."""
        return (surprisal - self.usual[lang]) / np.sqrt(1 / n + 1 / 1000)

    def unlike(self, x: np.ndarray, n: np.ndarray, found: list[str]) -> np.ndarray:
        """That excess over 1.25 times (of few rows, more) the largest of any language's training rows: above 1, a text is not in its language."""
        lang = np.array([self.names.index(name) for name in found], int)
        return np.maximum(0, self.excess((x.astype(np.float64) ** 2 * self.surprise[lang]).sum(1), n, lang) / self.most[lang])

    def softmax(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        hot = np.eye(len(self.families), dtype=np.float32)[y]

        def gradient(w):
            z = x @ w
            p = np.exp(z - z.max(1, keepdims=True))
            return x.T @ (p / p.sum(1, keepdims=True) - hot) / np.float32(len(x)) + np.float32(1e-5) * w

        return descend(gradient, np.zeros((x.shape[1], len(self.families)), np.float32), 400, 1.0)

    @staticmethod
    def machine(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
        """Weights under a squared hinge loss with classes balanced, and the slope of the logistic curve."""
        each = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)

        def gradient(w):
            slack = np.maximum(0, 1 - y * (x @ w))
            return -2 * (x.T @ (each * y * slack)) + np.float32(1e-4) * w

        w = descend(gradient, np.zeros(x.shape[1], np.float32), 300, 0.2)
        margins, slope = (y * (x @ w)).astype(np.float64), 1.0
        for _ in range(100):
            slope += 4 * float((each * margins / (1 + np.exp(slope * margins))).sum()) - 0.002 * slope
        return w, slope

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The language and its score (0 to 1) of each row of features."""
        x = with_bias(x).astype(np.float64)
        if self.family_weights is None:
            chance = np.ones((len(x), 1))
        else:
            z = x @ self.family_weights
            chance = np.exp(z - z.max(1, keepdims=True))
            chance /= chance.sum(1, keepdims=True)
        family, out, scores = chance.argmax(1), [""] * len(x), chance.max(1)
        for f, name in enumerate(self.families):
            rows, names = np.flatnonzero(family == f), self.members[name]
            if len(names) == 1 or not len(rows):
                for i in rows:
                    out[i] = names[0]
                continue
            votes, sums = np.zeros((len(rows), len(names))), np.zeros((len(rows), len(names)))
            for (a, b), (w, slope) in self.pairs.items():
                if a in names:
                    i, j = names.index(a), names.index(b)
                    p = 1 / (1 + np.exp(-slope * (x[rows] @ w)))
                    votes[:, i] += p >= 0.5
                    votes[:, j] += p < 0.5
                    sums[:, i] += p
                    sums[:, j] += 1 - p
            best = (votes + sums / (10 * len(names))).argmax(1)
            scores[rows] *= sums[np.arange(len(rows)), best] / (len(names) - 1)
            for i, k in zip(rows, best):
                out[i] = names[k]
        return out, np.clip(scores, 0, 1)


def fold(doc_id: Column, folds: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds))


def train(docs: DataFrame, folds: int = 4, held_out: int = 2, sample_rows: int = SAMPLE_ROWS) -> Languages:
    """Fits on at most sample_rows rows with a lang outside the held-out fold, taken in hash order.

    Rows without a letter are passed over. Only feature vectors and langs reach the driver.
    """
    known = small_batches(docs).filter("text is not null and lang is not null and doc_id is not null").filter(fold(F.col("doc_id"), folds) != held_out)
    few = known.select("doc_id", F.xxhash64("text").alias("_row")).orderBy(F.xxhash64("doc_id"), "doc_id", "_row").limit(sample_rows)
    rows = known.select("doc_id", F.xxhash64("text").alias("_row"), "text", "lang").join(F.broadcast(few), ["doc_id", "_row"], "left_semi").select("lang", "text")

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            got = [(lang, c[0].tobytes(), c[1]) for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (c := counted(text)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.binary()), pa.array([g[2] for g in got], pa.float64())], names=["lang", "x", "n"])

    got = rows.mapInArrow(count, "lang string, x binary, n double").limit(sample_rows).collect()
    got.sort(key=lambda r: (r["lang"], r["x"], r["n"]))
    x = np.ones((len(got), SIZE + 1), np.float32)
    langs, n = [r["lang"] for r in got], np.array([r["n"] for r in got])
    for k in reversed(range(len(got))):  # each row goes as it is copied
        x[k, :SIZE] = np.frombuffer(got.pop()["x"], np.float32)
    return Languages(x, langs, n)


def predict(docs: DataFrame, model: Languages, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns named, lang_pred, lang_score and lang_unlike of every row; `und` and 0 where the text is
    null or has no letter. lang_unlike is above 1 where the text is less like lang_pred than any training row was.

    With no language learnt every text is `und`. A row that repeats another gets the same result. Columns that bear a result's name are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most a few rows of weights for each pair of languages
    names = [c for c in columns if c not in ("lang_pred", "lang_score", "lang_unlike")]
    rows = small_batches(docs).select(*names, F.col("text").alias("_text"))
    schema = T.StructType([*(rows.schema[n] for n in names), T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()), T.StructField("lang_unlike", T.DoubleType())])

    def label(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in it:
            texts = batch.column(len(names)).to_pylist()
            langs, scores, unlike = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
            for a in range(0, len(texts), 512):
                got = [(i, *c) for i in range(a, min(a + 512, len(texts))) if own.names and texts[i] and (c := counted(texts[i])) is not None]
                if got:
                    x = np.stack([g[1] for g in got])
                    found, values = own.predict(x)
                    far = own.unlike(x, np.array([g[2] for g in got]), found)
                    for (i, _, _), name, value, f in zip(got, found, values, far):
                        langs[i], scores[i], unlike[i] = name, value, f
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(langs, pa.string()), pa.array(scores), pa.array(unlike)], names=[*names, "lang_pred", "lang_score", "lang_unlike"])

    return rows.mapInArrow(label, schema)
