"""Language identification with error-correcting output codes.

Each learned language has a codeword of +1 and -1. For each of its bits a binary
classifier over hashed letter n-grams (naive Bayes, languages of a side weighing
alike) gives a margin. A text gets the language whose codeword loses least: the loss
of a bit is logistic in margin times codeword, weighted by how well the bit's
classifier can tell that very language's text (its mean margin over the language's
own n-grams). Close second places are flagged.

The classifiers' counts cover all training texts: each task adds up its own, and
they are summed by language and feature.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, parts

UNDETERMINED = "und"


#: Characters of a text whose n-grams are hashed at a time.
STRETCH = 1 << 18


class Features:
    """Counts of the hashed n-grams of one to three letters of a text's words in lower case, spaces at their ends included."""

    def __init__(self, bits: int):
        self.shift = np.uint64(64 - bits)
        self.size = 1 << bits
        self.letter: np.ndarray | None = None

    def letters(self) -> np.ndarray:
        if self.letter is None:
            self.letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
        return self.letter

    def __call__(self, text: str) -> np.ndarray:
        text = f" {text.lower()} "
        counts = np.zeros(self.size, dtype=np.int64)
        for start in range(0, len(text), STRETCH):
            before = min(start, 2)  # n-grams that began in the last stretch
            counts += np.bincount(self._hashes(text[start - before : start + STRETCH], before), minlength=self.size)
        return counts

    def _hashes(self, text: str, before: int) -> np.ndarray:
        """Those of the n-grams that end behind the first ``before`` characters."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        real = self.letters()[codes]
        code = np.where(real, codes, 32).astype(np.uint64)
        mix = np.uint64(0x9E3779B97F4A7C15)
        one = (code + np.uint64(1)) * mix
        two = (one[:-1] ^ code[1:]) * mix
        three = (two[:-1] ^ code[2:] + np.uint64(7)) * mix
        found = [one[real][int(real[:before].sum()) :], two[max(before - 1, 0) :][(real[1:] | real[:-1])[max(before - 1, 0) :]], three[real[1:-1]]]
        return (np.concatenate(found) >> self.shift).astype(np.int64)


def code_matrix(n: int, seed: int = 0) -> np.ndarray:
    """A row of +1 and -1 for each of ``n`` classes, no two columns alike or opposite.

    Up to seven classes: all such columns. More: of 64 random matrices with ten times
    log2(n) columns, the one whose closest rows are furthest apart.
    """
    if n <= 7:
        columns = [(1, *x) for x in itertools.product((1, -1), repeat=n - 1) if -1 in x]
        return np.array(columns, dtype=float).T.reshape(n, -1)
    random, best = np.random.default_rng(seed), (-1, None)
    width = math.ceil(10 * math.log2(n))
    for _ in range(64):
        m = np.unique(random.choice([-1.0, 1.0], size=(n, width)) * 1.0, axis=1)
        m = m[:, np.abs(m.sum(axis=0)) < n]
        apart = (m.shape[1] - m @ m.T) / 2 + np.eye(n) * m.shape[1]
        if apart.min() > best[0]:
            best = (apart.min(), m)
    return best[1]


class Model:
    """langs: the learned values in code-point order; counts: their features."""

    def __init__(self, langs: list[str], counts: np.ndarray, bits: int):
        self.langs, self.bits = langs, bits
        self.code = code_matrix(len(langs)) if len(langs) > 1 else np.ones((len(langs), 0))
        share = (counts + 0.1) / (counts + 0.1).sum(axis=1, keepdims=True) if len(langs) else counts
        weights, trust = [], []
        for column in self.code.T:
            one, zero = share[column > 0].mean(axis=0), share[column < 0].mean(axis=0)
            weights.append(np.log(one / zero))
            trust.append(np.maximum(column * (share @ weights[-1]), 1e-6))
        self.weights = np.array(weights, dtype=np.float32).reshape(len(weights), counts.shape[1]).T
        self.trust = np.array(trust).T if trust else self.code
        self.trust = self.trust / self.trust.sum(axis=1, keepdims=True) if trust else self.trust

    def predict(self, features: np.ndarray) -> tuple[str, float, bool]:
        """(language, its share of the belief, whether the second place is close), by a text's counts."""
        at = np.nonzero(features)[0]
        if not len(at) or not self.langs:
            return UNDETERMINED, 0.0, False
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False
        margin = features[at] @ self.weights[at] / math.sqrt(features.sum())
        loss = (self.trust * np.logaddexp(0, -self.code * margin)).sum(axis=1) * self.code.shape[1]
        belief = np.exp(loss.min() - loss)
        belief /= belief.sum()
        best = int(belief.argmax())
        return self.langs[best], float(belief[best]), bool(np.partition(belief, -2)[-2] > 0.5 * belief[best])


def fit(rows: DataFrame, bits: int = 14) -> Model:
    """A model of rows (lang, text), both not null. No more than languages times 2 ** ``bits`` sums reach the driver."""

    def count(batches):
        features, sums = Features(bits), {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if lang not in sums:
                    sums[lang] = np.zeros(features.size, dtype=np.int64)
                sums[lang] += features(text)
        for lang, own in sums.items():
            at = np.nonzero(own)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1), pa.string()), pa.array(np.append(at, 0)), pa.array(np.append(own[at], 0))], names=["lang", "feature", "n"])

    sums = rows.select("lang", "text").mapInArrow(count, "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(sums["lang"].to_pylist()))
    counts = np.zeros((len(langs), 1 << bits))
    place = {x: i for i, x in enumerate(langs)}
    counts[[place[x] for x in sums["lang"].to_pylist()], sums["feature"].to_numpy()] = sums["n"].to_numpy()
    return Model(langs, counts, bits)


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 3, bits: int = 14) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous), a row for each row of ``docs``.

    Learns from text and non-null ``lang_col`` of the rows whose crc32(id as text) mod
    ``modulus`` is not 1; a prediction sees the text alone. ``und``, with score 0, if
    the text is null or has no letter, or nothing was learned. One learned language
    is predicted for all other texts, with score 1. Null ids learn and are not held
    out; repeated rows count as often as they are there. Texts of any length are taken
    whole, a stretch at a time; other columns play no part. The driver holds 2 ** ``bits``
    counts for each learned language. No rows: no rows.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), held_out(docs[id_col], modulus).alias("held_out"), docs[lang_col].cast("string").alias("lang"), docs[text_col].alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(fit(rows.where("not held_out and lang is not null and text is not null"), bits))

    def predict(batches):
        features = Features(bits)
        for batch in batches:
            for part in parts(batch, 2, 1 << 20):
                if part.num_rows:
                    found = [model.value.predict(features(t or "")) for t in part.column(2).to_pylist()]
                    langs, scores, doubt = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(doubt)], names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    return rows.select("doc_id", "held_out", "text").mapInArrow(predict, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double, ambiguous boolean")
