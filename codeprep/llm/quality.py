"""Operator 2: quality rules, a hashed n-gram logistic regression behind fixed rules.

Counts of each whole text feed two base rules; texts that pass them are
scored by logistic regression on hashed word unigrams, word bigrams and
character trigrams (the mean weight of each family, so the score does not
grow with the length).  The model is fitted on ``TRAIN_ROWS`` labelled rows at
most (least hashes of the ids); every fifth of them is held out of the fit
and calibrates the probability.  A text is kept if its probability of being
good reaches ``KEEP``.

Null text: no words, so it fails the base rule.  Several labels of one id: the
lowest counts.  No labels, or one class only: every text that passes the base
rules is kept with probability 1.  Empty tables give empty results; other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeprep.llm.common import chained, codepoints, map_texts, mix, seg_sum, word_hashes, words

TRAIN_ROWS, BITS, KEEP = 2000, 18, 0.5
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
SCALE = 100.0  # of the features, for the fit alone


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (z + self.bias) + self.shift, -30, 30)))


class View:
    """A step of texts as code points, words and hashes."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.cp, self.limits = codepoints(texts)
        self.starts, self.ends, self.of = words(self.cp, self.limits)
        self.hashes = word_hashes(self.cp, self.starts, self.ends)
        self.first = np.searchsorted(self.of, np.arange(len(texts) + 1))

    def counts(self) -> dict[str, np.ndarray]:
        a, b = self.first[:-1], self.first[1:]
        table = np.zeros(128, bool)
        table[[ord(c) for c in SYMBOLS]] = True
        symbol = table[np.minimum(self.cp, 127)] & (self.cp < 128)
        lines = [[x for x in t.split("\n") if x.strip(BLANKS)] for t in self.texts]
        return {"n_words": (b - a).astype(np.int64),
                "word_chars": seg_sum(self.ends - self.starts, a, b),
                "n_symbols": seg_sum(symbol.astype(np.int64), self.limits[:-1], self.limits[1:]),
                "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], np.int64),
                "n_repeat_words": self.repeats()}

    def repeats(self) -> np.ndarray:
        """Words in windows of three words that their text holds twice or more."""
        grams = chained(self.hashes, 3)
        inside = np.flatnonzero(self.of[:len(grams)] == self.of[2:]) if len(grams) else np.zeros(0, np.int64)
        key = grams[inside] ^ mix(self.of[inside].astype(np.uint64) + np.uint64(1))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        covered = np.zeros(len(self.hashes), np.int64)
        for i in range(3):
            covered[inside[twice] + i] = 1
        return seg_sum(covered, self.first[:-1], self.first[1:])

    def families(self):
        """Buckets of each family, and where each text's begin and end."""
        shift, a, b = np.uint64(64 - BITS), self.first[:-1], self.first[1:]
        yield (mix(self.hashes + np.uint64(1)) >> shift).astype(np.int32), a, b
        yield (mix(chained(self.hashes, 2) + np.uint64(2)) >> shift).astype(np.int32), a, np.maximum(a, b - 1)
        c = self.cp.astype(np.uint64)
        grams = (c[:-2] << np.uint64(42)) + (c[1:-1] << np.uint64(21)) + c[2:] if len(c) > 2 else c[:0]
        a, b = self.limits[:-1], self.limits[1:]
        yield (mix(grams + np.uint64(3)) >> shift).astype(np.int32), a, np.maximum(a, b - 2)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        z = np.zeros(len(self.texts))
        for buckets, a, b in self.families():
            z += seg_sum(weights[buckets].astype(np.float64), a, b) / np.maximum(b - a, 1)
        return z

    def features(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Each text's buckets and its values there."""
        families = list(self.families())
        indices, values = [], []
        for i in range(len(self.texts)):
            parts = [np.unique(f[a[i]:b[i]], return_counts=True) for f, a, b in families]
            indices.append(np.concatenate([x for x, _ in parts]))
            values.append(np.concatenate([n / max(1, n.sum()) for _, n in parts]).astype(np.float32))
        return indices, values


def fit(indices: list[np.ndarray], values: list[np.ndarray], good: np.ndarray, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Weights and bias of an L2-penalised logistic regression (Adam over all rows)."""
    dim = 1 << BITS
    used, idx = np.unique(np.concatenate(indices), return_inverse=True)
    val = np.concatenate(values).astype(np.float64) * SCALE
    row = np.repeat(np.arange(len(indices)), [len(i) for i in indices])
    w = np.zeros(len(used) + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    balance = np.where(good, 0.5 / max(1, good.sum()), 0.5 / max(1, (~good).sum()))
    for t in range(1, rounds + 1):
        z = np.bincount(row, val * w[idx], len(indices)) + w[-1]
        r = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - good) * balance
        g = np.append(np.bincount(idx, val * r[row], len(used)) + 1e-5 * w[:-1], r.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.05 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    weights = np.zeros(dim, np.float32)
    weights[used] = w[:-1] * SCALE
    return weights, float(w[-1])


def platt(z: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the probability on held-out rows (Newton steps, slightly penalised)."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        d, s = p - good, p * (1 - p)
        g = np.array([(d * z).sum() + 0.1 * (a - 1), d.sum() + 0.1 * b])
        h = np.array([[(s * z * z).sum() + 0.1, (s * z).sum()], [(s * z).sum(), s.sum() + 0.1]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a - step[0], b - step[1]
    return max(a, 0.05), b


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", train_rows: int = TRAIN_ROWS) -> Model | None:
    """Fit on the labelled documents with the least hashes of their ids; None if there are not two classes."""
    at = F.xxhash64("id")
    chosen = labels.select(F.col(key).alias("id"), F.col(label).alias("good")).where("id is not null and good is not null") \
        .groupBy("id").agg(F.min("good").alias("good")).orderBy(at, "id").limit(train_rows)

    def make():
        def run(texts):
            indices, values = View(texts).features()
            return {"i": [x.tobytes() for x in indices], "v": [x.tobytes() for x in values]}
        return run

    # the chosen ids are train_rows small rows at most
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).where("text is not null").join(F.broadcast(chosen), "id")
    got = map_texts(rows.withColumn("at", at), ["at", "good"], "text", make, "i binary, v binary").collect()
    got.sort(key=lambda r: (r["at"], bytes(r["i"])))
    indices, values = [np.frombuffer(r["i"], np.int32) for r in got], [np.frombuffer(r["v"], np.float32) for r in got]
    good = np.array([r["good"] > 0 for r in got], bool)
    held = np.arange(len(got)) % 5 == 0
    if min(good[~held].sum(), (~good[~held]).sum()) < 2:
        return None
    pick = lambda xs, mask: [x for x, m in zip(xs, mask) if m]
    weights, bias = fit(pick(indices, ~held), pick(values, ~held), good[~held])
    z = np.array([float((weights[i] * v).sum()) for i, v in zip(pick(indices, held), pick(values, held))]) + bias
    slope, shift = platt(z, good[held].astype(float))
    return Model(weights, bias, slope, shift)


def judge(df: DataFrame, model: Model | None, key: str | list[str] = "doc_id", text: str = "text", keep: float = KEEP,
          min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> DataFrame:
    """key, the counts, base_failed, kept and the probability of being good."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def make():
        m = sent.value

        def run(texts):
            view = View(texts)
            out = view.counts()
            failed = (out["n_words"] < min_words) | (100 * out["n_repeat_words"] > max_repeat_percent * out["n_words"])
            p = np.round(m.probability(view.scores(m.weights)), 6) if m else np.ones(len(texts))
            return out | {"base_failed": failed, "kept": ~failed & (p >= keep), "p_good": p}
        return run

    return map_texts(df, key, text, make, "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
                     "n_repeat_words bigint, base_failed boolean, kept boolean, p_good double")
